"""Hand-written cases of the folds and of the edges of interval operators."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from timespan import queries
from timespan.functions import text as tx
from timespan.operators import history as hs
from timespan.operators import intervals as iv
from timespan.operators import matching as mt
from timespan.operators import segmentation as sm
from timespan.operators import signal as sg
from timespan.operators import tokens as tk
from timespan.operators import transcripts as tr
from timespan.plans import signal_queries
from timespan.sources import documents as dc
from timespan.sources import subtitles as sb
from timespan.streaming import blocks as bl
from timespan.streaming import ingest as ig
from timespan.streaming import live
from timespan.streaming import progress as pg
from timespan.streaming import state as st

S = 1_000_000


def ranges(spark, *pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "media_id long, start_us long, end_us long")


def total(spark, t):
    return spark.createDataFrame([(1, t)], "media_id long, total_us long")


def pairs(df):
    return sorted((r.start_us, r.end_us) for r in df.collect())


def twin(spark, folder, name, **tables):
    """The sorted rows of a query over small tables (rows, schema), which are those of its SQL."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    found = queries.QUERIES[name](spark, str(folder))
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(want)
    return got


def test_merge_touching_nested_equal(spark):
    assert pairs(iv.merge(ranges(spark, (0, 5), (5, 7), (1, 2), (9, 9), (20, 30)))) == [(0, 7), (9, 9), (20, 30)]
    assert pairs(iv.merge(iv.merge(ranges(spark, (0, 5), (4, 9))))) == [(0, 9)]


def test_complement_caps_ranges_past_the_end(spark):
    assert pairs(iv.complement(ranges(spark, (-3, 2), (4, 6), (12, 15)), total(spark, 10))) == [(2, 4), (6, 10)]
    nothing = ranges(spark, (0, 1)).filter("false")
    assert pairs(iv.complement(nothing, total(spark, 10))) == [(0, 10)]


def test_complement_of_complement_is_merge(spark):
    rng = np.random.default_rng(5)
    r = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 900, 60), rng.integers(1, 40, 60), strict=True)]
    df, t = ranges(spark, *r), total(spark, 1000)
    assert pairs(iv.complement(iv.complement(df, t), t)) == pairs(iv.merge(df))


def test_overlapping_deletes_count_twice(spark):
    word = ranges(spark, (0, 10 * S)).withColumn("id", F.lit(1))
    assert pairs(iv.surviving(word, ranges(spark, (0, 5 * S), (0, 5 * S)))) == []


def test_guarded_merge_stops_at_deletes(spark):
    words = ranges(spark, (0, S), (1_020_000, 2 * S), (3 * S, 4 * S))
    assert pairs(iv.guarded_merge(words, ranges(spark, (2_100_000, 2_900_000)))) == [(0, 2 * S), (3 * S, 4 * S)]
    assert pairs(iv.guarded_merge(words, ranges(spark, (1_005_000, 1_010_000)))) == [(0, S), (1_020_000, 2 * S), (3 * S, 4 * S)]


def test_word_over_two_keeps_becomes_two(spark):
    words = spark.createDataFrame([(1, 0, 0, "a", 0, 10, None)], "media_id long, seg_idx long, word_idx int, text string, start_us long, end_us long, conf double")
    assert pairs(tr.rebase(words, ranges(spark, (1, 3), (6, 9)))) == [(0, 2), (2, 5)]


def test_binned_join_equals_plain(spark):
    rng = np.random.default_rng(6)
    r = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 5000, 200), rng.integers(0, 700, 200), strict=True)]
    left, right = ranges(spark, *r[:100]), ranges(spark, *r[100:])
    plain = sorted(map(tuple, iv.clip(left, right, None).collect()))
    assert sorted(map(tuple, iv.clip(left, right, 100).collect())) == sorted(map(tuple, iv.clip(left, right).collect())) == plain
    touched = {x for x in r[:100] if any(x[0] < e and b < x[1] for b, e in r[100:])}
    assert set(pairs(iv.overlap_violations(left, right))) == touched and set(pairs(iv.outside(left, right))) == set(r[:100]) - touched


def test_keyframes_before_and_after_all(spark):
    k = spark.createDataFrame([(1, 10), (1, 20), (1, 20)], "media_id long, t_us long")
    assert pairs(iv.snap_to_keyframes(ranges(spark, (12, 15)), k)) == [(10, 20)]
    assert pairs(iv.snap_to_keyframes(ranges(spark, (12, 15)), k.filter("false"))) == [(12, 15)]


def words_of(spark, *rows):
    return spark.createDataFrame([(1, 0, k, *r) for k, r in enumerate(rows)], "media_id long, seg_idx long, word_idx int, text string, start_us long, end_us long")


@pytest.mark.parametrize(("gap", "n"), [(600_000, 1), (610_000, 2)])
def test_sentence_gap(spark, gap, n):
    df = sm.sentences(words_of(spark, ("a", 0, S), ("b", S + gap, 2 * S + gap)))
    assert df.count() == n


def test_sentence_marks_and_joins(spark):
    df = sm.sentences(words_of(spark, ("hi", 0, 1), ("。", 1, 2), ("next", 2, 3), ("世", 3, 4), ("界", 4, 5)))
    assert [r.text for r in df.orderBy("sent_idx").collect()] == ["hi .", "next 世界"]


@pytest.mark.parametrize(("raw", "words", "marked"), [
    ("Hello，world。再见！", ["hello", "world", "再见"], ["hello,", "world.", "再见！"]),
    ("abc", ["x", "abc"], ["x", "abc"]),
    ("a b. c?!", ["a", "no", "c", "b"], ["a", "no", "c", "b"]),  # without marks or a next word, the text is used up
    ("a, b. c?!", ["a", "no", "c."], ["a,", "no", "c."]),
    ("一、二。 三", ["一,", "一", "二", "三"], ["一,", "一、", "二。", "三"]),
    ("", ["a"], ["a"]),
    (None, ["a."], ["a."]),
])
def test_marks_restored(spark, raw, words, marked):
    stamps = spark.createDataFrame([(1, 0, k, w, k, k + 1) for k, w in enumerate(words)], "media_id long, chunk_idx long, pos int, text string, start_us long, end_us long")
    chunks = spark.createDataFrame([(1, 0, raw)], "media_id long, chunk_idx long, text string")
    assert [r.text for r in sm.with_marks(stamps, chunks).orderBy("pos").collect()] == marked


def test_lines():
    assert sm.lines_of("你好，世界。hello big world") == ["你好", "世界", "hello big world"]
    assert max(map(len, sm.lines_of("字" * 55))) == 20
    assert sm.lines_of("x<asr_text> a b ") == ["a b"]


def test_speech_runs_of_15_and_16(spark):
    def runs(probs):
        vad = spark.createDataFrame([(1, k, p) for k, p in enumerate(probs)], "media_id long, chunk_idx long, prob double")
        return [(r["first"], r["last"]) for r in sm.speech_runs(vad).collect()]

    assert runs([0.0] * 10 + [0.9] * 15 + [0.0] * 10) == []
    assert runs([0.0] * 10 + [0.9] * 16 + [0.0] * 10) == [(5, 31)]
    assert runs([0.9] * 16 + [0.0] * 26 + [0.9] * 16) == [(0, 58)]
    assert runs([0.9] * 16 + [0.0] * 27 + [0.9] * 16) == [(0, 21), (38, 59)]


def test_utterance_needs_25_silent_chunks(spark):
    def found(probs, **k):
        vad = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "stream_id long, chunk_idx long, prob double")
        return [(r.first_chunk, r.chunks) for r in live.utterances(vad, **k).collect()]

    assert found([0.0, 0.9] + [0.0] * 24) == []
    assert found([0.0, 0.9] + [0.0] * 25) == [(1, 26)]
    assert found([0.9] * 50, cap=10) == []
    assert found([0.9] * 50, cap=10, hard_cap=True) == [(k, 10) for k in range(0, 50, 10)]


def chunks_of(rows):
    """Rows (stream, chunk, probability) a second apart."""
    return [(s, k, datetime(2024, 1, 1) + timedelta(seconds=k), p) for s, k, p in rows]


def held_state(spark, folder):
    return spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "held").load().count()


def test_state_ends_with_the_watermark(spark, tmp_path):
    schema, folder = "stream_id long, chunk_idx long, event_time timestamp, prob double", str(tmp_path)

    def feed(*rows):
        spark.createDataFrame(chunks_of(rows), schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        st.drain(live.utterance_stream(stream, silence=2, cap=9, idle_ms=30_000), folder)
        return sorted((r.stream_id, r.first_chunk, r.chunks) for r in spark.read.schema(live.UTTERANCE).parquet(f"{folder}/out").collect())

    assert feed((1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.1), (3, 0, 0.9)) == [] and held_state(spark, folder) == 2  # silence alone is no state
    assert feed((1, 2, 0.1), (1, 3, 0.1)) == [(1, 0, 3)] and held_state(spark, folder) == 1  # a flushed stream has none
    assert feed((4, 500, 0.1)) == [(1, 0, 3)] and held_state(spark, folder) == 0  # the tail of an idle one goes unflushed


def test_resampled_whatever_the_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema, signal, folder = "stream_id long, block_idx long, event_time timestamp, samples array<double>", {s: rng.normal(size=60) for s in (1, 2)}, str(tmp_path)
    rows = []
    for s, v in signal.items():
        ends = [0, *sorted(rng.choice(np.arange(1, 60), 8, replace=False)), 60, 60]
        rows += [(s, k, datetime(2024, 1, 1) + timedelta(seconds=k), v[a:b].tolist()) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    for low, high in ((0, 3), (3, 7), (7, 99)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).write.mode("append").parquet(f"{folder}/in")
        st.drain(bl.resampled_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), 5, 3, "1 hour"), folder)
    found = spark.read.schema(bl.SAMPLE).parquet(f"{folder}/out").collect()
    for s, v in signal.items():
        own = [r.v for r in sorted(found, key=lambda r: r.sample_idx) if r.stream_id == s]
        assert np.allclose(own, np.interp(np.arange(0, 59.0001, 5 / 3), np.arange(60), v))
    whole = spark.createDataFrame([(s, k, float(x)) for s, v in signal.items() for k, x in enumerate(v)], "stream_id long, sample_idx long, v double")
    want = sorted((r.stream_id, r.sample_idx, round(r.v, 9)) for r in bl.resampled_signal(whole, 5, 3).collect())
    assert sorted((r.stream_id, r.sample_idx, round(r.v, 9)) for r in found) == want


def test_progress_never_goes_back(spark, tmp_path):
    sink, path = pg.upsert(str(tmp_path / "p")), str(tmp_path / "p")

    def rows(*r):
        return spark.createDataFrame(list(r), "task_id long, progress double, status string, seq long")

    sink(rows((1, 0.5, "running", 3), (2, 0.2, "running", 1)), 0)
    sink(rows((1, 0.9, "completed", 8)), 1)
    sink(rows((1, 0.5, "running", 3), (2, 0.2, "running", 1)), 0)  # comes again
    sink(rows((2, 0.1, "failed", 4)), 2)
    want = {(1, 0.9, "completed", 8), (2, 0.2, "failed", 4)}
    assert set(map(tuple, pg.current(spark, path).collect())) == want
    pg.compact(spark, path, str(tmp_path / "c"))
    assert set(map(tuple, pg.current(spark, str(tmp_path / "c")).collect())) == want
    kinds = spark.createDataFrame([("transcribe", 2.0), ("transcribe", 0.5), ("cut", -1.0), ("cut", 0.4), ("cut", 5.0), ("other", 0.4)], "kind string, p double")
    assert [r[0] for r in kinds.select(pg.shown(F.col("kind"), F.col("p"))).collect()] == [0.95, 0.5, 0.1, 0.1 + 0.75 * 0.4, 0.85, None]


def test_media_files_are_ingested_as_they_come(spark, tmp_path):
    log, seen, stop = str(tmp_path / "log"), [], []
    (tmp_path / "in" / "deep").mkdir(parents=True)

    def work(items):
        names = sorted(r.item.rsplit("/", 1)[1] for r in items.collect())
        seen.append(names)
        return items.select("item", F.when(~F.contains("item", F.lit("bad")), "text").alias("result"))

    def feed(*names):
        for n in names:
            (tmp_path / "in" / n).write_bytes(b"x")
        items = ig.media_stream(spark, str(tmp_path / "in"))
        stopped = (lambda s: s.createDataFrame([(f"file:{tmp_path}/in/{n}",) for n in stop], "item string")) if stop else None
        items.writeStream.foreachBatch(ig.ingest(work, log, stopped)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {(r.item.rsplit("/", 1)[1], r.status, r.message) for r in ig.statuses(spark, log).collect()}

    stop.append("a.MP3")
    assert feed("a.MP3", "deep/b.webm", "bad.wav", "notes.txt", "old.avi") == {("a.MP3", "pending", "stopped"), ("b.webm", "done", None), ("bad.wav", "failed", "empty result")}
    stop.clear()
    assert ("a.MP3", "done", None) in feed("c.ogg")
    assert seen == [["b.webm", "bad.wav"], ["a.MP3", "bad.wav", "c.ogg"]]  # what was stopped or failed runs in the next batch
    stages = {(r.status, r.step) for r in spark.read.parquet(log).collect()}
    assert ("running", 0) in stages and ("pending", 0) in stages


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(s, k, float(p)) for s in (1, 2) for k, p in enumerate(rng.choice([0.1, 0.9], 200, p=[0.6, 0.4]))]
    schema, folder = "stream_id long, chunk_idx long, event_time timestamp, prob double", str(tmp_path)
    for n in range(4):
        spark.createDataFrame(chunks_of(r for r in rows if r[1] // 50 == n), schema).write.mode("append").parquet(f"{folder}/in")
        st.drain(live.utterance_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), silence=3, cap=12), folder)
    batch = live.utterances(spark.createDataFrame(chunks_of(rows), schema), silence=3, cap=12)
    found = spark.read.schema(live.UTTERANCE).parquet(f"{folder}/out")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect())) and found.count() > 10


def test_clusters():
    base = np.eye(4)
    x = np.array([base[0], base[0] + 0.05, base[1], base[1] + 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = sg.average_linkage(x, 0.38)
    assert labels[0] == labels[1] != labels[2] == labels[3]
    assert len(set(sg.average_linkage(x, 0.38, clusters=9))) == 4
    assert len(set(sg.average_linkage(x, 0.38, clusters=1))) == 1


def test_srt_oddities(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000 align:left\nhi\nthere\r\n\r\n00:00:03,000 --> 00:00:04,000\n\n\nbad block\n\n7\n00:00:05,000 --> 00:00:06,000\nend"
    rows = sb.parse_srt(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("start_us").collect()
    assert [(r.start_us // S, r.text) for r in rows] == [(1, "hi\nthere"), (3, ""), (5, "end")]


def test_flagship_at_two_partitionings(spark, sf_dir):
    from timespan.queries import QUERIES

    a = sorted(map(tuple, QUERIES["rebase_after_cuts"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = sorted(map(tuple, QUERIES["rebase_after_cuts"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_joined_phrases_of_any_length(spark):
    from timespan.operators import matching

    chars = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    rows = [("m", k, "word", c) for k, c in enumerate("頭" + chars + "尾" + chars[:19])] + [("n", 0, "word", "Ab"), ("n", 1, "word", "c"), ("n", 2, "pause", ""), ("n", 3, "word", "a"), ("n", 4, "word", "bcd")]
    tokens = spark.createDataFrame(rows, "media_id string, pos int, type string, text string")
    assert [tuple(r) for r in matching.match_joined(tokens, chars).collect()] == [("m", 1, len(chars))]
    assert [tuple(r) for r in matching.match_joined(tokens, "a b c").collect()] == [("n", 0, 1)]
    assert sorted(r.pos for r in matching.match_fillers(tokens, [chars]).collect()) == list(range(1, len(chars) + 1))


def test_fillers_of_the_query_are_whole_tokens(spark, tmp_path):
    rows = [(1, 0, "user", "a nd and of the an d andand"), (2, 0, "user", "And, AND o f the of"), (2, 1, "user", "the and")]
    assert twin(spark, tmp_path, "filler_matches", conversations=(rows, "conv_id long, turn long, role string, text string")) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 5), (2, 6), (2, 7)]
    tokens = spark.createDataFrame([(1, k, "word", t) for k, t in enumerate("a nd and".split())], "media_id long, pos int, type string, text string")
    assert sorted(r.pos for r in mt.match_fillers(tokens, ["and"]).collect()) == [0, 1, 2]  # the operator joins tokens unless told not to


def test_near_duplicates_are_of_what_was_kept_last(spark):
    # the second is a near duplicate of the first; the third of neither, as it is 100 from the kept one; the fourth meets the grown range
    assert pairs(iv.merge_near_duplicates(ranges(spark, (0, 1000), (50, 1099), (100, 1100), (110, 1150), (2000, 2001)))) == [(0, 1150), (2000, 2001)]
    assert pairs(iv.merge_near_duplicates(ranges(spark, (0, 1000), (99, 1099)))) == [(0, 1000)]
    assert pairs(iv.merge_near_duplicates(ranges(spark, (0, 1000), (60, 1060), (120, 1120)))) == [(0, 1120)]


def test_export_names_are_free(spark):
    def names(*given, existing=None):
        rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(given)], "project_id long, seq long, name string")
        held = existing and spark.createDataFrame([(x,) for x in existing], "export string")
        return [r.export for r in hs.export_names(rows, held or None).orderBy("seq").collect()]

    assert names("a", "a", "a_1") == ["a", "a_1", "a_1_1"]
    assert names("a_1", "a", "a", "b", "b") == ["a_1", "a", "a_2", "b", "b_1"]
    assert names("a", "a", existing=["a", "a_2"]) == ["a_1", "a_3"]


def test_ingest_runs_what_is_left_and_isolates_failures(spark, tmp_path):
    seen = []

    def work(items):
        got = sorted(r.item for r in items.collect())
        seen.append(got)
        if "boom" in got and len(seen) == 2:
            raise ValueError("no such item")
        rows = [(i, "" if i == "empty" else f"r{i}", "unreadable" if i == "bad" else None) for i in got]
        return spark.createDataFrame([(i, None if e else x, e) for i, x, e in rows], "item string, result string, error string")

    (tmp_path / "in").mkdir()
    schema, log = "item string", str(tmp_path / "log")

    def feed(n, *items):
        spark.createDataFrame([(i,) for i in items], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(ig.ingest(work, log)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.item, r.status, r.message) for r in ig.statuses(spark, log).collect()}

    assert feed(0, "a", "bad", "empty") == {("a", "done", None), ("bad", "failed", "unreadable"), ("empty", "failed", "empty result")}
    assert {x for x in feed(1, "boom", "c") if x[1] == "failed"} == {(i, "failed", "no such item") for i in ("bad", "boom", "c", "empty")}
    left = feed(2, "a", "bad", "c")
    assert {x for x in left if x[1] == "failed"} == {("bad", "failed", "unreadable"), ("empty", "failed", "empty result")}
    again = ["bad", "boom", "c", "empty"]
    assert seen == [["a", "bad", "empty"], again, again]  # what has failed runs again, what is done doesn't
    ig.ingest(work, log)(spark.createDataFrame([("c",)], schema), 2)  # a batch that is run again replaces its rows
    assert sorted(r.item for r in spark.read.parquet(log).filter("batch = 2 AND step = 1").collect()) == again
    assert {(r.item, r.status, r.message) for r in ig.statuses(spark, log).collect()} == left


def token_list(spark, segments, words):
    """(kind, text, start, end, seg_idx, attached) in milliseconds of segments (start, end, text) and words (segment, start, end)."""
    s = spark.createDataFrame([(1, k, a * 1000, b * 1000, t) for k, (a, b, t) in enumerate(segments)], "media_id long, seg_idx long, start_us long, end_us long, text string")
    w = spark.createDataFrame([(1, s, k, "", None if a is None else a * 1000, None if b is None else b * 1000) for k, (s, a, b) in enumerate(words)],
                              "media_id long, seg_idx long, word_idx int, text string, start_us long, end_us long")
    return [(r.kind, r.text, r.start_us / 1000, r.end_us / 1000, r.seg_idx, r.attached) for r in tk.segment_tokens(s, w).orderBy("pos").collect()]


@pytest.mark.parametrize(("gap", "between"), [(590, None), (600, "，"), (1090, "，"), (1100, "。"), (1590, "。"), (1600, "silence")])
def test_pauses_inside_a_segment(spark, gap, between):
    found = token_list(spark, [(0, 2000 + gap, "a b")], [(0, 0, 1000), (0, 1000 + gap, 2000 + gap)])
    pause = {None: [], "silence": [("silence", None, 1000, 1000 + gap, 0, False)]}.get(between, [("punctuation", between, 1000, 1000 + gap, 0, False)])
    first = ("word", "a", 0, 1000 if pause else 1000 + gap, 0, False)
    assert found == [first, *pause, ("word", "b", 1000 + gap, 2000 + gap, 0, False)]


@pytest.mark.parametrize(("gap", "mark"), [(0.1, None), (10, "，"), (1090, "，"), (1100, "。"), (9000, "。")])
def test_pauses_between_segments_belong_to_the_one_before(spark, gap, mark):
    a = 1000 + gap
    s = spark.createDataFrame([(1, 0, 0, 1_000_000, "a"), (1, 1, int(a * 1000), int(a * 1000) + 500_000, "b")], "media_id long, seg_idx long, start_us long, end_us long, text string")
    w = spark.createDataFrame([], "media_id long, seg_idx long, word_idx int, text string, start_us long, end_us long")
    found = [(r.kind, r.text, r.seg_idx, r.attached) for r in tk.segment_tokens(s, w).orderBy("pos").collect()]
    assert found == [("word", "a", 0, False), *([("punctuation", mark, 0, True)] if mark else []), ("word", "b", 1, False)]


def test_equal_marks_join_and_leading_marks_move_back(spark):
    # a pause between segments and one before the first word are one comma; other marks stay apart
    found = token_list(spark, [(0, 1000, "a"), (1700, 4000, "b")], [(0, 0, 1000), (1, 2400, 4000)])
    assert found == [("word", "a", 0, 1000, 0, False), ("punctuation", "，", 1000, 2400, 0, True), ("word", "b", 2400, 4000, 1, False)]
    found = token_list(spark, [(0, 1000, "a"), (1700, 4000, "b")], [(0, 0, 1000), (1, 2900, 4000)])
    assert [x[1:] for x in found if x[0] == "punctuation"] == [("，", 1000, 1700, 0, True), ("。", 1700, 2900, 0, True)]
    # a mark at the head of a text belongs to the segment before
    found = token_list(spark, [(0, 1000, "a"), (1000, 2000, ", b.")], [(0, 0, 1000), (1, 1500, 1800)])
    assert found[1:] == [("punctuation", "，", 1000, 1500, 0, True), ("word", "b", 1500, 1800, 1, False), ("punctuation", "。", 1800, 2000, 1, False)]


def test_marks_of_the_text_words_without_stamps_and_missing_times(spark):
    found = token_list(spark, [(0, 3000, "Hi, Big 世!")], [(0, 0, 1000), (0, 2000, None)])
    assert found == [("word", "hi", 0, 1000, 0, False), ("punctuation", "，", 1000, 2000, 0, False), ("word", "big", 2000, 2010, 0, False),
                     ("word", "世", 2010, 2505, 0, False), ("punctuation", "！", 2505, 3000, 0, False)]
    found = token_list(spark, [(0, 540, "a b c")], [(0, None, None), (0, 100, 500), (0, 510, None), (0, None, None)])  # nothing is known of the first
    assert [x[2:4] for x in found] == [(100, 510), (510, 520), (520, 540)]
    assert token_list(spark, [(0, 1000, "  "), (5000, 6000, "b")], []) == [("punctuation", "。", 1000, 5000, 0, True), ("word", "b", 5000, 6000, 1, False)]


def test_phrases_in_one_pass_equal_one_by_one(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "ab", "ba", "c", "A", " ", "b"]
    tokens = [(m, k, words[rng.integers(len(words))], "silence" if rng.random() < 0.1 else "word") for m in (1, 2) for k in range(150)]
    phrases = sorted({" ".join(words[i] for i in rng.integers(0, 6, rng.integers(1, 5))) for _ in range(1000)} | {"abab", "cab", "b", "\0a", "  "})
    df = spark.createDataFrame(tokens, "media_id long, pos long, text string, type string")
    found = {(r.media_id, r.phrase, r.first_pos, r.last_pos) for r in mt.match_phrases(df, phrases).collect()}
    want, live = set(), [[x for x in tokens if x[0] == m] for m in (1, 2)]
    for own in live:
        runs, run = [], []
        for x in own:
            if x[3] == "silence" or not x[2].strip():
                runs.append(run)
                run = []
            else:
                run.append((x[1], x[2].lower()))
        for run in [*runs, run]:
            for i in range(len(run)):
                for j in range(i, min(len(run), i + 8)):
                    lows = [t for _, t in run[i : j + 1]]
                    for p in phrases:
                        parts = p.lower().split()
                        if parts and (lows == parts if len(parts) > 1 else "".join(lows) == p.strip().lower()):
                            want.add((own[0][0], p.strip(), run[i][0], run[j][0]))
    assert found == want and len(want) > 500
    single = {(r.media_id, r.first_pos, r.last_pos) for p in ("a b", "abab") for r in (mt.match_parts(df, p.split()) if " " in p else mt.match_joined(df, p)).collect()}
    assert single == {(m, a, b) for m, p, a, b in found if p in ("a b", "abab")}


def brute_linkage(unit, cut, clusters):
    """Average linkage by merging the two nearest clusters, all distances kept."""
    groups, d = [[k] for k in range(len(unit))], np.clip(1 - unit @ unit.T, 0, 2)
    while len(groups) > max(1, clusters or 1):
        best = min((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if clusters is None and best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("clusters", [None, 1, 4, 50])
def test_linkage_equals_brute_force(clusters):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40):
        x = rng.normal(size=(n, 6)) + 2 * np.eye(6)[rng.integers(0, 3, n)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        labels = sg.average_linkage(x, 0.38, clusters)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == brute_linkage(x, 0.38, clusters)
    assert len(sg.average_linkage(np.zeros((0, 4)), 0.38)) == 0


def test_speaker_turns(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0, 0, 1000, a), (1, 1, 1100, 2000, [0.99, 0.1]), (1, 2, 2000, 2700, b), (1, 3, 2300, 3200, a), (1, 4, 3600, 4600, a), (1, 5, 4600, 6000, b), (1, 6, 6000, 7000, None), (2, 0, 0, 900, b)]
    spans = spark.createDataFrame([(m, k, s * 1000, e * 1000, v) for m, k, s, e, v in rows], "media_id long, span_idx long, start_us long, end_us long, embedding array<double>")
    turns = [(r.media_id, r.start_us // 1000, r.end_us // 1000, r.speaker) for r in sg.speaker_turns(spans).orderBy("media_id", "start_us").collect()]
    assert turns == [(1, 0, 2000, 1), (1, 2300, 3200, 1), (1, 3600, 4600, 1), (1, 4600, 6000, 2), (2, 0, 900, 1)]  # the short one and that without a vector are gone


def test_near_duplicates_against_a_plain_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(m, int(s), int(s + n)) for m in range(30) for s, n in zip(rng.integers(-50, 900, 25), rng.choice([0, 3, 60, 90, 200], 25), strict=True)]
    got = sorted(map(tuple, iv.merge_near_duplicates(spark.createDataFrame(rows, "media_id long, start_us long, end_us long")).collect()))
    want = []
    for m in range(30):
        kept = []
        for s, e in sorted((max(s, 0), max(e, 0)) for k, s, e in rows if k == m and e > s):
            same = kept and abs(s - kept[-1][0]) < 100 and abs(e - kept[-1][1]) < 100
            if not same and kept and s <= kept[-1][1]:
                kept[-1] = (kept[-1][0], max(kept[-1][1], e))
            elif not same:
                kept.append((s, e))
        want += [(m, *x) for x in kept]
    assert got == sorted(want)


@pytest.mark.parametrize(("raw", "words", "lines"), [
    ("你好，世界。hello big world", ["你", "好", "世", "界", "hello", "big", "world"], ["你好", "世界", "hello big world"]),
    ("， 你好", ["你", "好"], ["你好"]),
    ("ab c, d", ["ab", "c", "d"], ["ab c", "d"]),
    ("a,b c", ["ab", "c"], ["ab c"]),  # a mark inside a word ends nothing
    (None, ["a", "b"], ["a b"]),
    ("", [str(k) + "x" for k in range(12)], [" ".join(f"{k}x" for k in range(9)), "9x 10x 11x"]),
    ("", ["字" * 5] * 9, ["字" * 25, "字" * 20]),
])
def test_aligned_lines(spark, raw, words, lines):
    stamps = spark.createDataFrame([(1, 0, k, w, 10 * k, 10 * k + 5) for k, w in enumerate(words)], "media_id long, chunk_idx long, pos int, text string, start_us long, end_us long")
    rows = sm.aligned_lines(stamps, spark.createDataFrame([(1, 0, raw)], "media_id long, chunk_idx long, text string")).orderBy("line_idx").collect()
    assert [r.text for r in rows] == lines and [r.line_idx for r in rows] == list(range(len(lines)))
    assert rows[0].start_us == 0 and rows[-1].end_us == 10 * len(words) - 5


def test_marker(spark):
    texts = ["x <asr_text> a b ", "abc<asr_text>", "none", " <asr_text>a<asr_text>b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.after_marker(F.col("t"))).collect()] == ["a b", "", "none", "a<asr_text>b"]
    assert sm.lines_of("abc<asr_text>") == []


def test_bytes_of_pieces(spark):
    every = bytes(range(256)).decode("latin-1")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    text = "".join(alphabet[b] for b in every.encode("latin-1")) + "漢 "
    (found,) = spark.createDataFrame([(text,)], "t string").select(tr.bytes_of_pieces(F.col("t"))).first()
    assert bytes(found) == bytes(range(256))


def test_range_files_by_preference(spark):
    def read(prefer, *values):
        df = spark.createDataFrame(list(enumerate(values)), "media_id long, value string")
        return sorted((r.media_id, r.start_us // S, r.end_us // S) for r in dc.range_files(df, prefer).collect())

    both = '{"total_duration": 10, "keep_ranges": [{"start": 0, "end": 4}], "delete_ranges": [{"start": 6, "end": 8}, {"start": 3, "end": 3}]}'
    cut, kept, bare = '{"total_duration": 10, "delete_ranges": [{"start": 6, "end": 8}]}', '{"total_duration": 10, "keep_ranges": [{"start": 0, "end": 4}]}', '[{"start": 2, "end": 5}, {"start": 7, "end": 9}]'
    assert read("keep", both, cut, kept, bare) == [(0, 0, 4), (1, 0, 6), (1, 8, 10), (2, 0, 4), (3, 2, 5), (3, 7, 9)]
    assert read("delete", both, cut, kept, bare) == [(0, 6, 8), (1, 6, 8), (2, 4, 10), (3, 0, 2), (3, 5, 7)]
    with pytest.raises(Exception, match="unsupported range file: 0"):
        read("keep", '{"other": 1}')


def test_samples_of_raw_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dc, "SLICE", 3)
    np.arange(8, dtype="<f4").tofile(tmp_path / "a.f32")
    (tmp_path / "b.f32").write_bytes(np.array([1.5], "<f4").tobytes() + b"xy")
    rows = dc.read_samples(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5], r.sample_idx, r.v) for r in rows) == [("a", k, float(k)) for k in range(8)] + [("b", 0, 1.5)]


def test_chunks_kept_whole_cut_or_skipped(spark):
    chunks = spark.createDataFrame([(1, k, 10_000 * k, 10_000 * (k + 1)) for k in range(5)], "media_id long, chunk_idx int, start_us long, end_us long")
    local = spark.createDataFrame([(1, 0, 0, 10_000), (1, 1, 500, 9_500), (1, 2, 0, 4_000), (1, 2, 5_000, 10_000), (1, 4, 0, 9_000)], "media_id long, chunk_idx int, start_us long, end_us long")
    assert [r.plan for r in iv.chunk_plans(chunks, local).orderBy("chunk_idx").collect()] == ["copy", "cut", "cut", "skip", "cut"]
    assert [r.plan for r in iv.chunk_plans(chunks, local, 1_000).orderBy("chunk_idx").collect()] == ["copy", "copy", "cut", "skip", "cut"]


LONG = 10**18  # in bins of a minute it would be too many for an array
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(*rows):
    """Rows of events of user 1: type, microseconds since the origin, value (600 s each)."""
    return [(k, datetime(2024, 1, 1) + timedelta(microseconds=at), 1, kind, value) for k, (kind, at, value) in enumerate(rows)], EVENTS


@pytest.mark.parametrize("run", [1, 3, 10_000])
def test_ranked_join_equals_plain(spark, monkeypatch, run):
    monkeypatch.setattr(iv, "_RUN", run)
    rng = np.random.default_rng(run)
    rows = [(int(m), int(a), int(a + n), None if n % 4 == 0 else f"n{n}") for m, a, n in zip(rng.integers(0, 3, 240), rng.integers(-20, 60, 240), rng.integers(-4, 30, 240), strict=True)]  # ties, empty, reversed and equal ones
    rows += [(None, 0, 50, "a"), (1, None, 50, "b"), (1, 0, None, "c"), (1, -LONG, LONG, "d")]
    schema = "media_id long, start_us long, end_us long, name string"
    left, right = spark.createDataFrame(rows[:130] + rows[-4:], schema), spark.createDataFrame(rows[110:], schema)
    for a, b in ((left, right), (right, left), (left.drop("name"), right), (left, right.drop("name")), (left.drop("name"), right.drop("name"))):
        plain, found = iv.interval_join(a, b, None), iv.interval_join(a, b)
        assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert iv.clip(left, right).count() > 1000


def test_clipped_pairs_of_long_ranges(spark, tmp_path):
    rows = events(("click", 0, 1e9), ("view", 5, 0.0), ("error", 7, 1e9), ("error", 5, 0.0), ("error", 3, 0.01), ("signup", 0, 5.0))
    assert len(twin(spark, tmp_path, "clipped_pairs", events=rows)) == 4


def test_chunk_plans_of_long_chunks(spark):
    chunks = spark.createDataFrame([(1, k, LONG * k, LONG * (k + 1)) for k in range(4)], "media_id long, chunk_idx int, start_us long, end_us long")
    kept = ranges(spark, (0, LONG + 999), (2 * LONG + 5_000, 3 * LONG - 7), (2 * LONG - 400, 2 * LONG + 400))
    found = iv.chunk_plans(chunks, iv.to_chunks(kept, chunks), near=1_000)
    assert [(r.plan, r.ranges) for r in found.orderBy("chunk_idx").collect()] == [("copy", 1), ("skip", 0), ("cut", 1), ("skip", 0)]


def test_ranges_in_long_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, 0, LONG), (1, 1, LONG, 2 * LONG), (2, 0, 0, LONG)], "media_id long, chunk_idx int, start_us long, end_us long")
    found = iv.to_chunks(ranges(spark, (5, LONG + 1_000), (-500, 1_500), (LONG - 999, LONG), (2 * LONG, 3 * LONG)), chunks)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 1_500), (1, 0, 5, LONG), (1, 1, 0, 1_000)]


def test_clips_in_long_uniform_chunks(spark):
    chunks = iv.uniform_chunks(total(spark, 2 * LONG), LONG)
    found = iv.in_uniform_chunks(ranges(spark, (5, LONG), (0, 4), (0, 4), (7, 7)), chunks)
    size = chunks.filter("chunk_idx = 0").first().end_us
    rest = LONG - size
    assert sorted(map(tuple, found.collect())) == sorted([(1, 0, 0, 4, size + 3), (1, 0, 0, 4, size + 3), (1, 0, 5, size, size + 3), (1, 0, 7, 7, size + 3), (1, 1, 0, rest, rest)])


def test_fixed_chunk_clip_has_short_last_chunks(spark, tmp_path):
    size = 300_000_000_000
    rows = events(("click", size - 5_999_900_000, 10.0), ("view", 100, 0.0), ("error", 9, 1.0))  # ends 0.1 s into the second chunk
    assert twin(spark, tmp_path, "fixed_chunk_clip", events=rows) == [(1, 0, 100, 100, 5_999_900_000), (1, 0, size - 5_999_900_000, size, 5_999_900_000), (1, 1, 0, 100_000, 100_000)]


def embeddings(spark, folder, rows):
    """An embeddings table of these (vec_id, label, embedding)."""
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_cosine_distances_has_all_pairs_of_a_label(spark, tmp_path):
    ids = [0, 1, 1999, 2000, 4001]  # beyond 2,000 ids
    folder = embeddings(spark, tmp_path, [(k, 7, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in ids])
    got = {(r.a_idx, r.b_idx): r.distance for r in signal_queries.cosine_distances(spark, folder).collect()}
    assert got == {(a, b): float((a + b) % 2) for a in ids for b in ids if a < b}


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_cosine_distances_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    x = {(m, k): rng.normal(size=4).tolist() for m, n in ((1, 9), (2, 1), (3, 4)) for k in range(n)}
    x[1, 9], x[1, 10], x[1, 11] = None, [1.0, None, 0.0, 0.0], [float("nan")] * 4
    v = spark.createDataFrame([(m, k, e) for (m, k), e in x.items()] + [(1, None, x[1, 0]), (None, 1, x[1, 0])], "media_id long, span_idx long, embedding array<double>")
    want = {}
    for (m, a), (n, b) in [(p, q) for p in x for q in x if p[0] == q[0] and p[1] < q[1]]:
        p, q = x[m, a], x[n, b]
        known = p is not None and q is not None and None not in p and None not in q
        d = 1 - float(np.dot(p, q)) if known else 0.0
        want[m, a, b] = 2.0 if np.isnan(d) else min(max(d, 0.0), 2.0)
    got = [tuple(r) for r in sg.cosine_distances(v, block).collect()]
    assert len(got) == len(want) and {r[:3]: round(r[3], 9) for r in got} == {k: round(d, 9) for k, d in want.items()}


@pytest.mark.parametrize("block", [2, 5, 100])
def test_cosine_distances_send_a_span_to_few_groups(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    v = spark.createDataFrame([(m, k, x[k].tolist()) for m, n in ((1, 40), (2, 3)) for k in range(n)], "media_id long, span_idx long, embedding array<float>")
    sent, join = [], type(v).groupBy
    monkeypatch.setattr(type(v), "groupBy", lambda self, *by: (sent.append(self), join(self, *by))[1])
    found = sg.cosine_distances(v, block, 4)
    monkeypatch.undo()
    assert sent[-1].count() == 40 * min(4, -(-40 // block)) + 3 * min(4, -(-3 // block))
    want = {(m, a, b): round(min(max(1 - float(np.float32(x[a]).astype(float) @ np.float32(x[b]).astype(float)), 0), 2), 9) for m, n in ((1, 40), (2, 3)) for a in range(n) for b in range(a + 1, n)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {r[:3]: round(r[3], 9) for r in got} == want


def test_mean_centred_takes_the_mean_of_a_whole_label(spark, tmp_path):
    ids = [0, 1999, 2000, 5000]  # beyond 2,000 ids
    folder = embeddings(spark, tmp_path, [(k, 7, [float(k), 1.0]) for k in ids] + [(3, None, [4.0]), (4, None, [6.0]), (5, 7, None)])
    got = {(r.media_id, r.span_idx, r.dim): r.x for r in signal_queries.mean_centred(spark, folder).collect()}
    mean = sum(ids) / len(ids)
    assert got == {(7, k, d): k - mean if d == 0 else 0.0 for k in ids for d in (0, 1)} | {(None, 3, 0): -1.0, (None, 4, 0): 1.0}
