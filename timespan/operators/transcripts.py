"""Operators over words and segments of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timespan.functions.text import normalised_token, strip
from timespan.operators import intervals as iv


def even_words(segments: DataFrame, srt: bool = False) -> DataFrame:
    """Words of segments from their text, dealt evenly over the segment. srt: none where the segment has no duration."""
    parts = F.filter(F.split(strip(F.col("text")), r"(?U)\s+"), lambda x: x != "")
    dur = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))
    df = segments.withColumn("parts", parts).withColumn("dur", dur)
    if srt:
        df = df.filter("dur > 0")
    n = F.size("parts")
    words = df.select("media_id", "seg_idx", "start_us", "end_us", "dur", n.alias("n"), F.posexplode("parts").alias("word_idx", "word"))

    def at(k: Column) -> Column:
        return F.col("start_us") + F.floor(F.col("dur") * k / F.col("n"))

    start = F.when(F.col("dur") > 0, at(F.col("word_idx"))).otherwise(F.when(F.col("word_idx") == 0, F.col("start_us")).otherwise(F.col("end_us")))
    end = F.when((F.col("word_idx") == F.col("n") - 1) | (F.col("dur") == 0), F.col("end_us")).otherwise(at(F.col("word_idx") + 1))
    return words.select("media_id", "seg_idx", "word_idx", F.col("word").alias("text"), start.alias("start_us"), end.alias("end_us"), F.lit(None).cast("double").alias("conf"))


def flatten_words(segments: DataFrame) -> DataFrame:
    """All words in order: those that a segment has, else even ones from its text."""
    own = segments.filter(F.size("words") > 0).select("media_id", "seg_idx", F.posexplode("words").alias("word_idx", "w")).select("media_id", "seg_idx", "word_idx", "w.text", "w.start_us", "w.end_us", "w.conf")
    return own.unionByName(even_words(segments.filter(F.coalesce(F.size("words"), F.lit(0)) <= 0)))


def matching_words(words: DataFrame, targets: list[str]) -> DataFrame:
    """Words that equal one of the targets, both normalised. targets is a short list of the caller's."""
    spark = words.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets], "target string").select(normalised_token(F.col("target")).alias("norm")).filter("norm <> ''").distinct()
    return words.withColumn("norm", normalised_token(F.col("text"))).join(F.broadcast(wanted), "norm", "left_semi").drop("norm")


def delete_ranges(words: DataFrame, targets: list[str], totals: DataFrame, pad: int = 80_000, gap: int = 120_000) -> DataFrame:
    """What to cut for the targets: padded hits, clamped to the medium, merged within gap."""
    hits = matching_words(words, targets).select("media_id", (F.col("start_us") - pad).alias("start_us"), (F.col("end_us") + pad).alias("end_us"))
    return iv.merge(iv.clamp(hits, totals), gap).filter("end_us > start_us")


def rebase(words: DataFrame, keeps: DataFrame) -> DataFrame:
    """Words on the shortened timeline; one that spans two kept ranges becomes two."""
    k = iv.with_offsets(keeps).withColumnRenamed("delta_us", "delta")
    pairs = iv.clip(words, k, iv.BIN_US)
    return pairs.select("media_id", "seg_idx", "word_idx", "text", (F.col("start_us") + F.col("r_delta")).alias("start_us"), (F.col("end_us") + F.col("r_delta")).alias("end_us"), "conf")


def rebuild_segments(words: DataFrame, sep: str = " ") -> DataFrame:
    """Segments of words sorted by time: the start of the first, the end of the last, the text of all."""
    item = F.struct("start_us", "end_us", "word_idx", "text")
    return words.groupBy("media_id", "seg_idx").agg(F.sort_array(F.collect_list(item)).alias("w")).select(
        "media_id", "seg_idx", F.col("w")[0]["start_us"].alias("start_us"), F.element_at("w", -1)["end_us"].alias("end_us"), F.array_join(F.col("w.text"), sep).alias("text"), F.size("w").cast("long").alias("n_words")
    )


def keep_by_word(words: DataFrame, deletes: DataFrame, totals: DataFrame, tolerance: int = 1_000, gap: int = 50_000) -> DataFrame:
    """Kept ranges from the words that deletes don't cover; neighbours merge within gap unless a delete lies between."""
    ids = words.withColumn("id", F.concat_ws(":", "seg_idx", "word_idx")).select("media_id", "id", "start_us", "end_us")
    return iv.guarded_merge(iv.surviving(iv.clamp(ids, totals), deletes, tolerance), deletes, gap)


def silences(words: DataFrame, totals: DataFrame, least: int = 1_200_000, near: int = 1_000) -> DataFrame:
    """Gaps of speech of `least` or more, with their distances to the speech ranges of the same place in order.

    Place k compares with speech ranges k - 1 and k; where speech starts at 0 that is one too early.
    """
    speech = iv.merge(words.filter("end_us > start_us").select("media_id", "start_us", "end_us"))
    w = Window.partitionBy("media_id").orderBy("start_us")
    numbered = speech.withColumn("k", F.row_number().over(w) - 1)
    quiet = iv.complement(speech, totals.join(speech.select("media_id").distinct(), "media_id", "left_semi")).withColumn("k", F.row_number().over(w) - 1)
    before = numbered.select("media_id", (F.col("k") + 1).alias("k"), F.col("end_us").alias("prev_end"))
    after = numbered.select("media_id", "k", F.col("start_us").alias("next_start"))
    j = quiet.join(before, ["media_id", "k"], "left").join(after, ["media_id", "k"], "left").filter(F.col("end_us") - F.col("start_us") + near >= least)
    return j.select(
        "media_id", "start_us", "end_us", F.greatest(F.col("start_us") - F.coalesce("prev_end", "start_us"), F.lit(0)).alias("gap_before_us"),
        F.greatest(F.coalesce("next_start", "end_us") - F.col("end_us"), F.lit(0)).alias("gap_after_us"),
    )


def duration(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(F.coalesce(F.max("end_us"), F.lit(0)).alias("duration_us"))


def kept_duration(keeps: DataFrame, strict: bool = False) -> DataFrame:
    out = keeps.groupBy("media_id").agg(F.sum(F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))).alias("kept_us"))
    return out.withColumn("kept_us", F.when(F.col("kept_us") <= 0, F.raise_error(F.lit("nothing is kept"))).otherwise(F.col("kept_us")).cast("long")) if strict else out


def page(segments: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """Segments from offset on, limit at most (None: the rest), with the total of the medium and the bytes of the page's texts."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")) - 1
    counted = segments.withColumn("n", n).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("media_id")))
    low = max(offset, 0)
    return counted.filter((F.col("n") >= low) & (F.lit(True) if limit is None else F.col("n") < low + max(limit, 0))).drop("n")


def page_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("media_id").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("returned"), F.sum(F.octet_length("text")).alias("text_bytes"))


def union_pages(words: DataFrame) -> DataFrame:
    """Words of a transcript's pages (page_idx, and seg_idx within the page) as those of one transcript, segments numbered through."""
    place = F.dense_rank().over(Window.partitionBy("media_id").orderBy("page_idx", "seg_idx")) - 1
    return words.withColumn("seg_idx", place.cast("long")).drop("page_idx")


def shift(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-local times moved by each chunk's start; missing times count as 0."""
    moved = words.join(chunks.select("media_id", "chunk_idx", F.col("start_us").alias("offset_us")), ["media_id", "chunk_idx"])
    return moved.withColumn("start_us", F.coalesce("start_us", F.lit(0)) + F.col("offset_us")).withColumn("end_us", F.coalesce("end_us", F.lit(0)) + F.col("offset_us")).drop("offset_us")


def merge_chunks(results: DataFrame) -> DataFrame:
    """One transcript of a medium's chunk results: texts joined in chunk order, the language of the first chunk."""
    item = F.struct("chunk_idx", "text")
    return results.groupBy("media_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"), F.min_by("language", "chunk_idx").alias("language"), F.count(F.lit(1)).alias("n_chunks"))


def merge_chunk_words(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """media_id, words: those of all chunks (chunk_idx, word_idx, text, chunk-local times) as one transcript's, in order and on the medium's timeline."""
    item = F.struct("chunk_idx", "word_idx", "text", "start_us", "end_us")
    merged = shift(words, chunks).groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias("w"))
    return merged.select("media_id", F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start_us"].alias("start_us"), x["end_us"].alias("end_us"))).alias("words"))


def language_vote(results: DataFrame, asked: str) -> DataFrame:
    """The first language that was found, else the one asked for."""
    return results.groupBy("media_id").agg(F.coalesce(F.min_by("language", F.when(F.length("language") > 0, F.col("chunk_idx"))), F.lit(asked)).alias("language"))


def boundaries(tokens: DataFrame) -> DataFrame:
    """The distinct starts and ends of tokens that have a duration."""
    return tokens.filter("end_us > start_us").select("media_id", F.explode(F.array("start_us", "end_us")).alias("t_us")).distinct()


def clean_join(words: DataFrame, language: str) -> DataFrame:
    item = F.struct("word_idx", "text")
    sep = " " if language in ("en", "english") else ""
    return words.groupBy("media_id", "seg_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), sep).alias("text"))


def clean_external(segments: DataFrame) -> DataFrame:
    """Segments from outside: castable times, the end not before the start, trimmed text or the words' texts; empty ones go."""
    start = F.coalesce(F.expr("try_cast(start_s AS DOUBLE)"), F.lit(0.0))
    end = F.greatest(start, F.coalesce(F.expr("try_cast(end_s AS DOUBLE)"), start))
    text = strip(F.coalesce("text", F.lit("")))
    good = F.filter("words", lambda w: w["s"].try_cast("double").isNotNull() & w["e"].try_cast("double").isNotNull())
    df = segments.withColumn("good", good).withColumn("t", F.when(text == "", F.array_join(F.transform("good", lambda w: w["text"]), "")).otherwise(text))
    return df.filter((F.size("good") > 0) | (F.col("t") != "")).select("media_id", "seg_idx", F.rint(start * 1e6).cast("long").alias("start_us"), F.rint(end * 1e6).cast("long").alias("end_us"), F.col("t").alias("text"), F.size("good").cast("long").alias("n_words"))


def speakers(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """speaker, name: known names stay; each medium's other speakers are numbered in order."""
    ids = lines.filter("speaker <> ''").select("media_id", "speaker").distinct()
    if known is not None:
        ids = ids.join(known.select("media_id", "speaker", F.col("name").alias("own")), ["media_id", "speaker"], "left")
    else:
        ids = ids.withColumn("own", F.lit(None).cast("string"))
    rank = F.row_number().over(Window.partitionBy("media_id", F.col("own").isNull()).orderBy("speaker"))
    return ids.select("media_id", "speaker", F.coalesce("own", F.concat(F.lit("說話者"), rank.cast("string"))).alias("name"))


def align(words: DataFrame, stamps: DataFrame) -> DataFrame:
    """Words with the stamps of the same place, up to the shorter list."""
    return words.join(stamps, ["media_id", "chunk_idx", "pos"])


def token_at(points: DataFrame, tokens: DataFrame) -> DataFrame:
    """The tokens that hold each point (their start inclusive, their end not); they meet in time bins."""
    p = points.withColumns({"start_us": F.col("t_us"), "end_us": F.col("t_us") + 1})
    own = ["seg_idx", "word_idx", "start_us", "end_us"]
    met = iv.interval_join(p, tokens.select("media_id", *own), iv.BIN_US)
    return met.select(*points.columns, *(F.col(f"r_{c}").alias(c) for c in own))


def tokens_in_ranges(tokens: DataFrame, ranges: DataFrame, least: int = 500) -> DataFrame:
    """Tokens that a range overlaps by more than least: of what is longer, those whose inner part, less `least` at both ends, is touched."""
    def longer(df: DataFrame) -> DataFrame:
        return df.filter(F.col("end_us") - F.col("start_us") > least)

    inner = longer(tokens).withColumns({"start_us": F.col("start_us") + least, "end_us": F.col("end_us") - least})
    return iv.overlap_violations(inner, longer(ranges)).withColumns({"start_us": F.col("start_us") - least, "end_us": F.col("end_us") + least})


def nearest_token(points: DataFrame, tokens: DataFrame) -> DataFrame:
    """The token whose middle is nearest to each point, the first of equals: as-of from both sides."""
    mid = (F.col("start_us") + F.col("end_us")) / 2
    t = tokens.select("media_id", mid.alias("at"), F.lit(0).alias("kind"), F.struct(mid.alias("mid"), "seg_idx", "word_idx").alias("token"), F.lit(None).cast("long").alias("t_us"))
    p = points.select("media_id", F.col("t_us").cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<mid:double,seg_idx:bigint,word_idx:int>").alias("token"), "t_us")
    both = t.withColumn("token", F.col("token").cast("struct<mid:double,seg_idx:bigint,word_idx:int>")).unionByName(p)
    order = [F.col("at"), F.col("kind"), F.col("token.seg_idx"), F.col("token.word_idx")]
    before = F.last("token", ignorenulls=True).over(Window.partitionBy("media_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("token", ignorenulls=True).over(Window.partitionBy("media_id").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    df = both.withColumn("b", before).withColumn("a", after).filter("kind = 1")
    pick = F.when(F.col("a").isNull() | (F.col("t_us") - F.col("b.mid") <= F.col("a.mid") - F.col("t_us")), F.col("b")).otherwise(F.col("a"))
    return df.withColumn("token", F.coalesce(pick, "a")).select("media_id", "t_us", "token.seg_idx", "token.word_idx")


#: The byte-level alphabet: bytes that aren't printable in Latin-1 stand as the characters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN_AS, _HIDDEN_CHARS = "".join(chr(256 + k) for k in range(1, len(_HIDDEN))), "".join(map(chr, _HIDDEN[1:]))


def bytes_of_pieces(text: Column) -> Column:
    """The bytes that byte-level pieces stand for; characters outside the alphabet are left out."""
    known = F.regexp_replace(text, r"[^\x21-\x7E\u00A1-\u00AC\u00AE-\u0143]", "")
    shown = F.replace(F.translate(known, _SHOWN_AS, _HIDDEN_CHARS), F.lit("\u0100"), F.lit("\0"))  # to translate() a zero means nothing
    return F.encode(shown, "ISO-8859-1")


def decode_ids(ids: DataFrame, vocabulary: DataFrame, byte_level: bool = False) -> DataFrame:
    """Texts of token ids (media_id, pos, id): special ids go, pieces of the vocabulary (id, piece, special) are joined in order.

    byte_level: pieces are bytes, which may be parts of characters; what isn't UTF-8 in the end becomes U+FFFD.
    """
    v = vocabulary.filter("NOT special").select("id", "piece")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    held = ids.join(v, "id").groupBy("media_id").agg(joined.alias("text"))
    return held.withColumn("text", F.make_valid_utf8(bytes_of_pieces(F.col("text")).cast("string"))) if byte_level else held
