"""Queries of the transcript operators and of text and clock functions, and the flagship chain."""

from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.functions import clock as ck
from timespan.functions import text as tx
from timespan.operators import intervals as iv
from timespan.operators import transcripts as tr
from timespan.plans.interval_queries import FLAT, complemented, merged
from timespan.registry import query

NORM = "trim(lower(trim(text)), '，。,.!?！？；;：:…')"
HITS = f"""hits AS (SELECT media_id, greatest(start_us - 80000, 0) AS start_us, greatest(least(end_us + 80000, total_us), greatest(start_us - 80000, 0)) AS end_us FROM words JOIN word_totals USING (media_id) WHERE {NORM} IN ('the', 'of', 'and'))"""
CUT = HITS + ", " + merged("hits", 120_000, "cut") + ", " + complemented("cut", "word_totals", "kept")
OFFSET = "off AS (SELECT *, coalesce(sum(end_us - start_us) OVER (PARTITION BY media_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - start_us AS delta FROM kept)"
FRAGMENTS = "frag AS (SELECT w.media_id, w.seg_idx, w.word_idx, w.text, (greatest(w.start_us, k.start_us) + delta)::BIGINT AS start_us, (least(w.end_us, k.end_us) + delta)::BIGINT AS end_us, conf FROM words w JOIN off k ON w.media_id = k.media_id AND w.start_us < k.end_us AND w.end_us > k.start_us)"


def _cut(spark, d):
    return tr.delete_ranges(fx.words(spark, d), list(fx.STOP_WORDS), fx.word_totals(spark, d))


def _kept(spark, d):
    return iv.complement(_cut(spark, d), fx.word_totals(spark, d))


def _segments(spark, d):
    """Segments of the timed words."""
    return tr.rebuild_segments(fx.words(spark, d))


SEGS = "segs AS (SELECT media_id, seg_idx, min(start_us) AS start_us, max(end_us) AS end_us, string_agg(text, ' ' ORDER BY start_us, end_us, word_idx) AS text, count(*) AS n_words FROM words GROUP BY media_id, seg_idx)"


@query(fx.sql("words", query="SELECT * FROM words"))
def words(spark, d):
    return fx.words(spark, d)


@query(fx.sql("words", "word_totals", query=FLAT + "cut WHERE end_us > start_us", more=CUT))
def delete_ranges(spark, d):
    return _cut(spark, d)


@query(fx.sql("words", "word_totals", query=FLAT + "kept", more=CUT))
def keep_by_complement(spark, d):
    return _kept(spark, d)


@query(fx.sql("words", "word_totals", query="SELECT * FROM frag", more=", ".join([CUT, OFFSET, FRAGMENTS])))
def rebased_words(spark, d):
    return tr.rebase(fx.words(spark, d), _kept(spark, d))


@query(fx.sql("words", "word_totals", query="SELECT media_id, seg_idx, min(start_us) AS start_us, arg_max(end_us, (start_us, end_us, word_idx)) AS end_us, string_agg(text, ' ' ORDER BY start_us, end_us, word_idx) AS text, count(*) AS n_words FROM frag GROUP BY media_id, seg_idx", more=", ".join([CUT, OFFSET, FRAGMENTS])))
def rebase_after_cuts(spark, d):
    """What each conversation looks like after its stop words are cut: the flagship chain."""
    return tr.rebuild_segments(tr.rebase(fx.words(spark, d), _kept(spark, d)))


_SURVIVE = """c AS (SELECT *, seg_idx || ':' || word_idx AS id FROM words), v AS (SELECT c.media_id, id, sum(least(c.end_us, d.end_us) - greatest(c.start_us, d.start_us)) AS cov FROM c JOIN cut d ON c.media_id = d.media_id AND c.start_us < d.end_us AND c.end_us > d.start_us GROUP BY c.media_id, id),
alive AS (SELECT c.media_id, c.start_us, c.end_us FROM c LEFT JOIN v USING (media_id, id) WHERE c.end_us > c.start_us AND coalesce(cov, 0) < c.end_us - c.start_us - 1000),
m AS (SELECT *, max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) AS rid FROM alive),
x AS (SELECT DISTINCT m.media_id, m.rid FROM m JOIN cut d ON m.media_id = d.media_id AND m.start_us > m.last_us AND d.start_us < m.start_us AND d.end_us > m.last_us),
b AS (SELECT m.*, CASE WHEN start_us > last_us + 50000 OR x.rid IS NOT NULL THEN 1 ELSE 0 END AS brk FROM m LEFT JOIN x USING (media_id, rid)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b)"""


@query(fx.sql("words", "word_totals", query="SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY media_id, island", more=CUT + ", " + _SURVIVE))
def keep_by_word(spark, d):
    return tr.keep_by_word(fx.words(spark, d), _cut(spark, d), fx.word_totals(spark, d))


@query(fx.sql("words", "word_totals", query="""SELECT a.media_id, count(*) AS candidates, any_value(n) AS merged, round((1 - any_value(n) / count(*)) * 100, 6) AS reduction FROM alive a JOIN (SELECT media_id, count(DISTINCT island) AS n FROM i GROUP BY media_id) USING (media_id) GROUP BY a.media_id""", more=CUT + ", " + _SURVIVE))
def merge_reduction(spark, d):
    words, cut, totals = fx.words(spark, d), _cut(spark, d), fx.word_totals(spark, d)
    ids = words.withColumn("id", F.concat_ws(":", "seg_idx", "word_idx"))
    alive = iv.surviving(ids, cut).groupBy("media_id").agg(F.count(F.lit(1)).alias("candidates"))
    kept = tr.keep_by_word(words, cut, totals).groupBy("media_id").agg(F.count(F.lit(1)).alias("merged"))
    return alive.join(kept, "media_id").withColumn("reduction", F.round((1 - F.col("merged") / F.col("candidates")) * 100, 6))


@query(fx.sql("words", "word_totals", query="""SELECT q.media_id, q.start_us, q.end_us, greatest(q.start_us - coalesce(b.end_us, q.start_us), 0)::BIGINT AS gap_before_us, greatest(coalesce(a.start_us, q.end_us) - q.end_us, 0)::BIGINT AS gap_after_us
FROM q LEFT JOIN sp b ON b.media_id = q.media_id AND b.k = q.k - 1 LEFT JOIN sp a ON a.media_id = q.media_id AND a.k = q.k WHERE q.end_us - q.start_us + 1000 >= 1200000""", more=merged("words", 0, "speech") + ", " + complemented("speech", "word_totals", "quiet") + """,
q AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us) - 1 AS k FROM quiet), sp AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us) - 1 AS k FROM speech)"""))
def silence_candidates(spark, d):
    return tr.silences(fx.words(spark, d), fx.word_totals(spark, d))


@query(fx.sql("words", query="SELECT * FROM segs", more=SEGS))
def rebuilt_segments(spark, d):
    return _segments(spark, d)


@query(fx.sql("words", query="""SELECT media_id, seg_idx, k AS word_idx, x AS text, (start_us + (end_us - start_us) * k // n)::BIGINT AS start_us, CASE WHEN k = n - 1 THEN end_us ELSE start_us + (end_us - start_us) * (k + 1) // n END::BIGINT AS end_us, NULL::DOUBLE AS conf
FROM (SELECT media_id, seg_idx, start_us, end_us, len(w) AS n, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS x FROM (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM segs))""", more=SEGS))
def even_words(spark, d):
    return tr.even_words(_segments(spark, d))


@query(fx.sql("words", query="SELECT media_id, seg_idx, word_idx, text, start_us, end_us, conf FROM words"))
def flattened_words(spark, d):
    w = F.struct("text", "start_us", "end_us", "conf")
    nested = fx.words(spark, d).groupBy("media_id", "seg_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", w.alias("w")))), lambda x: x["w"]).alias("words"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return tr.flatten_words(nested.withColumn("text", F.lit("")))


@query(fx.sql("words", query="SELECT media_id, max(end_us) AS duration_us FROM words GROUP BY media_id"))
def transcript_duration(spark, d):
    return tr.duration(_segments(spark, d))


@query(fx.sql("words", "word_totals", query="SELECT media_id, sum(end_us - start_us)::BIGINT AS kept_us FROM kept GROUP BY media_id", more=CUT))
def kept_duration(spark, d):
    return tr.kept_duration(_kept(spark, d), strict=True)


@query(fx.sql("words", query="SELECT media_id, seg_idx, start_us, end_us, text, n_words, total FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS n, count(*) OVER (PARTITION BY media_id) AS total FROM segs) WHERE n >= 2 AND n < 7", more=SEGS))
def segment_page(spark, d):
    return tr.page(_segments(spark, d), 2, 5)


@query(fx.sql("words", query="SELECT media_id, max(total) AS total, count(*) AS returned, sum(octet_length(encode(text)))::BIGINT AS text_bytes FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS n, count(*) OVER (PARTITION BY media_id) AS total FROM segs) WHERE n >= 2 AND n < 7 GROUP BY media_id", more=SEGS))
def page_summary(spark, d):
    return tr.page_summary(tr.page(_segments(spark, d), 2, 5))


def _chunks(spark, d):
    return fx.words(spark, d).select("media_id", F.col("seg_idx").alias("chunk_idx"), (F.col("seg_idx") * 200_000_000).alias("start_us")).distinct()


@query(fx.sql("words", query="SELECT media_id, seg_idx AS chunk_idx, word_idx, text, start_us + 200000000 * seg_idx AS start_us, end_us + 200000000 * seg_idx AS end_us, conf FROM words"))
def shifted_words(spark, d):
    return tr.shift(fx.words(spark, d).withColumnRenamed("seg_idx", "chunk_idx"), _chunks(spark, d))


_RESULTS = "res AS (SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS chunk_idx, text, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS language FROM conversations)"


def _results(spark, d):
    return fx.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("chunk_idx"), "text", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("language"))


@query(f"WITH {_RESULTS} SELECT media_id, string_agg(text, ' ' ORDER BY chunk_idx, text) AS text, arg_min(language, chunk_idx) AS language, count(*) AS n_chunks FROM res GROUP BY media_id")
def merged_chunks(spark, d):
    return tr.merge_chunks(_results(spark, d))


@query(f"WITH {_RESULTS} SELECT media_id, coalesce(arg_min(language, chunk_idx) FILTER (length(language) > 0), 'auto') AS language FROM res GROUP BY media_id")
def language_vote(spark, d):
    return tr.language_vote(_results(spark, d), "auto")


@query(fx.sql("words", query="SELECT DISTINCT media_id, t AS t_us FROM (SELECT media_id, start_us AS t FROM words UNION ALL SELECT media_id, end_us FROM words)"))
def token_boundaries(spark, d):
    return tr.boundaries(fx.words(spark, d))


@query(fx.sql("words", query="SELECT media_id, seg_idx, string_agg(text, ' ' ORDER BY word_idx) AS text FROM words GROUP BY media_id, seg_idx"))
def clean_text_join(spark, d):
    return tr.clean_join(fx.words(spark, d), "en")


_LINES = "lines AS (SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS line_idx, text, CASE WHEN turn % 7 = 6 THEN '' ELSE role || (turn % 4) END AS speaker FROM conversations)"


def _lines(spark, d):
    return fx.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("line_idx"), "text", F.when(F.col("turn") % 7 == 6, "").otherwise(F.concat("role", (F.col("turn") % 4).cast("string"))).alias("speaker"))


@query(f"WITH {_LINES} SELECT media_id, speaker, '說話者' || row_number() OVER (PARTITION BY media_id ORDER BY speaker) AS name FROM (SELECT DISTINCT media_id, speaker FROM lines WHERE speaker <> '')")
def speaker_names(spark, d):
    return tr.speakers(_lines(spark, d))


@query(fx.sql("words", query="SELECT w.media_id, t AS t_us, seg_idx, word_idx, start_us, end_us FROM words w JOIN (SELECT media_id, (i * 1000000)::BIGINT AS t FROM (SELECT DISTINCT media_id FROM words), range(0, 30) r(i)) p ON w.media_id = p.media_id AND start_us <= t AND t < end_us"))
def token_at_point(spark, d):
    points = fx.words(spark, d).select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i")).select("media_id", (F.col("i") * 1_000_000).cast("long").alias("t_us"))
    return tr.token_at(points, fx.words(spark, d))


@query(fx.sql("words", "word_totals", query="SELECT media_id, seg_idx, word_idx, text, start_us, end_us, conf FROM words w WHERE EXISTS (SELECT 1 FROM cut c WHERE c.media_id = w.media_id AND least(w.end_us, c.end_us) - greatest(w.start_us, c.start_us) > 500)", more=CUT))
def tokens_in_ranges(spark, d):
    return tr.tokens_in_ranges(fx.words(spark, d), _cut(spark, d))


@query(fx.sql("words", query=f"SELECT media_id, seg_idx, word_idx, {NORM} AS norm, seg_idx || ':' || word_idx AS key, printf('silence:%.3f-%.3f', start_us / 1e6, end_us / 1e6) AS silence_key FROM words"))
def token_keys(spark, d):
    return fx.words(spark, d).select("media_id", "seg_idx", "word_idx", tx.normalised_token(F.col("text")).alias("norm"), tx.word_key("seg_idx", "word_idx").alias("key"), tx.silence_key("start_us", "end_us").alias("silence_key"))


@query("""SELECT doc_id, translate(translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '、､･※,，.;:!?', '，，，，，，。；：！？') AS wide, translate('a。b，c', '。，、！？；：', '.,,!?;:') AS half FROM documents""")
def punctuation_width(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.wide_punctuation(F.col("text")).alias("wide"), F.translate(F.lit("a。b，c"), tx.FULL_MARKS, tx.HALF_MARKS).alias("half"))


_MS = "round_even(greatest(start_us, 0) / 1000.0, 0)::BIGINT"


@query(fx.sql("words", query=f"""SELECT media_id, seg_idx, word_idx, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt, ms * 1000 AS back_us,
printf('%d:%02d', s // 60, s % 60) AS m_ss, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS h_mm_ss FROM (SELECT *, {_MS} AS ms, start_us // 1000000 AS s FROM words)"""))
def clock_formats(spark, d):
    us = F.col("start_us")
    return fx.words(spark, d).select("media_id", "seg_idx", "word_idx", ck.clock(us).alias("srt"), ck.clock(us, ".").alias("vtt"), ck.parse_clock(ck.clock(us)).alias("back_us"), ck.minutes(us).alias("m_ss"), ck.hours(us).alias("h_mm_ss"))


@query(fx.sql("ranges", "totals", query="""SELECT media_id, CASE WHEN total_us / 60000000.0 < 20 THEN 1 ELSE greatest(2, floor(total_us / 60000000.0 / 2.5 + 0.5)) END::BIGINT AS chunks, total_us >= 1200000000 AS split_video, total_us > 1800000000 AS split_audio,
CASE WHEN media_id % 4 = 0 THEN 'unknown' WHEN media_id % 10 < 1.5 THEN 'static' WHEN media_id % 10 > 8 THEN 'active' ELSE 'review' END AS motion FROM totals"""))
def presplit_and_motion(spark, d):
    us, m = F.col("total_us"), F.col("media_id")
    score = F.when(m % 4 != 0, (m % 10).cast("double"))
    return fx.totals(spark, d).select("media_id", ck.chunk_count(us).alias("chunks"), ck.needs_presplit(us, F.lit("video")).alias("split_video"), ck.needs_presplit(us, F.lit("audio")).alias("split_audio"), ck.motion_class(score).alias("motion"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1f MB', round(n_chars / 1048576.0, 1)) WHEN n_chars >= 10240 THEN printf('%.0f KB', round(n_chars / 1024.0)) WHEN n_chars >= 1024 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE n_chars || ' B' END AS size,
CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'De' WHEN 'fr' THEN 'Fr' WHEN 'es' THEN 'Es' END AS language, trim(source) AS marked, doc_id AS id FROM documents""")
def display_formats(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", ck.byte_size(F.col("n_chars")).alias("size"), tx.language_name(F.col("lang")).alias("language"), tx.after_marker(F.concat(F.lit("x <asr_text> "), F.col("source"), F.lit(" "))).alias("marked"), F.col("doc_id").alias("id"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Japanese' WHEN 1 THEN '中文' WHEN 2 THEN 'Greek' ELSE 'Klingon' END AS name, CASE doc_id % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'zh' WHEN 2 THEN 'gr' ELSE 'kl' END AS code, doc_id % 4 IN (0, 2) AS recognised FROM documents""")
def language_codes(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("Japanese", "中文", "Greek", "Klingon"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", names.alias("name")).select("doc_id", "name", tx.language_code(F.col("name")).alias("code"), tx.recognised(F.col("name")).alias("recognised"))


@query(fx.sql("words", query="""SELECT media_id, t_us, seg_idx, word_idx FROM (SELECT p.media_id, t_us, seg_idx, word_idx, row_number() OVER (PARTITION BY p.media_id, t_us ORDER BY abs((start_us + end_us) / 2.0 - t_us), (start_us + end_us) / 2.0) AS r
FROM (SELECT media_id, (i * 1700001)::BIGINT AS t_us FROM (SELECT DISTINCT media_id FROM words), range(0, 20) r(i)) p JOIN words w ON w.media_id = p.media_id) WHERE r = 1"""))
def nearest_tokens(spark, d):
    points = fx.words(spark, d).select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("media_id", (F.col("i") * 1_700_001).cast("long").alias("t_us"))
    return tr.nearest_token(points, fx.words(spark, d))


@query(fx.sql("words", query="SELECT media_id, string_agg(CASE (length(text) % 26) WHEN 1 THEN 'b' ELSE 'x' END, '' ORDER BY p) AS text FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, word_idx) AS p FROM words) WHERE length(text) % 26 <> 0 GROUP BY media_id"))
def decoded_ids(spark, d):
    from pyspark.sql import Window

    ids = fx.words(spark, d).select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx", "word_idx")).alias("pos"), (F.length("text") % 26).alias("id"))
    vocabulary = ids.select("id").distinct().select("id", F.when(F.col("id") == 1, "b").otherwise("x").alias("piece"), (F.col("id") == 0).alias("special"))
    return tr.decode_ids(ids, vocabulary)


#: Byte-level pieces by id, and their bytes: whole characters, parts of them, and bytes that no character has.
_PIECES = {1: ("\u0120a", "2061"), 2: ("ä¸", "E4B8"), 3: ("\u0143", "AD"), 4: ("é", "E9"), 5: ("b", "62"), 6: ("ð\u0141\u013a", "F09F98"), 7: ("\u0122", "80")}
_UTF8 = "|".join([
    "[0-7][0-9A-F]", "(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]", "E0[AB][0-9A-F][89AB][0-9A-F]", "(?:E[1-9A-CEF])(?:[89AB][0-9A-F]){2}", "ED[89][0-9A-F][89AB][0-9A-F]",
    "F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}", "F[1-3](?:[89AB][0-9A-F]){3}", "F48[0-9A-F](?:[89AB][0-9A-F]){2}",
])
_BROKEN = "F0[9AB][0-9A-F](?:[89AB][0-9A-F])?|F[1-3](?:[89AB][0-9A-F]){1,2}|F48[0-9A-F](?:[89AB][0-9A-F])?|E0[AB][0-9A-F]|(?:E[1-9A-CEF])[89AB][0-9A-F]|ED[89][0-9A-F]|.."


@query(fx.sql("words", query=f"""SELECT media_id, decode(unhex(array_to_string(list_transform(regexp_extract_all(h, '{_UTF8}|{_BROKEN}'), lambda x: CASE WHEN regexp_full_match(x, '{_UTF8}') THEN x ELSE 'EFBFBD' END), ''))) AS text FROM
(SELECT media_id, string_agg(CASE (length(text) + word_idx) % 8 {" ".join(f"WHEN {k} THEN '{h}'" for k, (_, h) in _PIECES.items())} ELSE '' END, '' ORDER BY seg_idx, word_idx) AS h FROM words GROUP BY media_id)"""))
def decoded_bytes(spark, d):
    """Byte-level ids whose pieces split characters and leave broken ones."""
    w = fx.words(spark, d)
    ids = w.select("media_id", (F.col("seg_idx") * 100_000 + F.col("word_idx")).alias("pos"), ((F.length("text") + F.col("word_idx")) % 8).alias("id"))
    vocabulary = spark.createDataFrame([(0, "x", True), *((k, piece, False) for k, (piece, _) in _PIECES.items())], "id int, piece string, special boolean")
    return tr.decode_ids(ids, vocabulary, byte_level=True)


@query("""SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS seg_idx, CASE WHEN turn % 5 = 0 THEN 0 ELSE turn * 1500000 END::BIGINT AS start_us, greatest(CASE WHEN turn % 5 = 0 THEN 0 ELSE turn * 1500000 END, turn * 1000000)::BIGINT AS end_us,
CASE WHEN turn % 2 = 0 THEN 'ab' ELSE trim(role) END AS text, 2::BIGINT AS n_words FROM conversations""")
def cleaned_external_segments(spark, d):
    c = fx.table(spark, d, "conversations")
    t = F.col("turn")
    word = lambda s, x: F.struct(F.lit(s).alias("s"), F.lit("1").alias("e"), F.lit(x).alias("text"))
    outside = c.select(F.col("conv_id").cast("long").alias("media_id"), t.cast("long").alias("seg_idx"), F.when(t % 5 == 0, "bad").otherwise((t * 1.5).cast("string")).alias("start_s"), t.cast("string").alias("end_s"), F.when(t % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "role")).alias("text"), F.array(word("0", "a"), word("x", "lost"), word("2", "b")).alias("words"))
    return tr.clean_external(outside)


@query(fx.sql("words", query="SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, word_idx) - 1)::INTEGER AS pos, text, start_us, end_us FROM words"))
def merged_chunk_words(spark, d):
    w = fx.words(spark, d).withColumnRenamed("seg_idx", "chunk_idx")
    chunks = w.groupBy("media_id", "chunk_idx").agg(F.min("start_us").alias("start_us"))
    own = w.join(chunks.withColumnRenamed("start_us", "from_us"), ["media_id", "chunk_idx"])
    local = own.select("media_id", "chunk_idx", "word_idx", "text", (F.col("start_us") - F.col("from_us")).alias("start_us"), (F.col("end_us") - F.col("from_us")).alias("end_us"))
    return tr.merge_chunk_words(local, chunks).select("media_id", F.posexplode("words").alias("pos", "w")).select("media_id", "pos", "w.*")
