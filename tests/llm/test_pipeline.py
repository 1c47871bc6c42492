"""The pipeline on odd rows: nulls, empty and repeated ones, clashing columns, linked copies, and an empty table; memory of long texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from timespan.llm import common, lm_scoring, ngram_jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, content string, rank long"
PLAIN = [" ".join(f"word{i}x{k}" for k in range(30)) for i in range(6)]
PASSAGE = " ".join(f"bench{k}" for k in range(20))
ROWS = [
    (0, PLAIN[0]), (0, PLAIN[0]), (1, PLAIN[0]), (2, PLAIN[1]), (3, None), (4, ""), (5, "too short"), (None, PLAIN[2]), (6, PLAIN[3] + " AKIA" + "ABCDEFGH12345678"),
    (7, PASSAGE), (8, PLAIN[1] + " one"), (9, PLAIN[4] + "\n" + PLAIN[5]), (9, PLAIN[5]),
]


def documents(spark, rows):
    return spark.createDataFrame([(k, t, None if k == 2 else "en", None if k == 3 else "s", len(t or ""), "a", "b", 1) for k, t in rows], SCHEMA)


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_decide_on_odd_rows(spark, tables):
    docs = documents(spark, ROWS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        docs = out.checkpoint()
        seen[name] = sorted((r.doc_id if r.doc_id is not None else -1 for r in docs.collect()))
    assert seen["quality_rules"] == [-1, 0, 0, 1, 2, 6, 7, 8, 9, 9]  # null, empty and short texts go
    assert seen["ngram_jaccard"] == [-1, 0, 2, 6, 7, 9, 9]  # of copies and near copies one stays
    assert seen["decontamination"] == [-1, 0, 2, 6, 9, 9]  # the passage goes
    assert seen["secret_scans"] == seen["decontamination"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "AKIA" not in texts[6] and "[SECRET]" in texts[6] and texts[2] == PLAIN[1] and texts[None] == PLAIN[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in packed) == seen["secret_scans"] and len({r.sequence_id for r in packed}) == 1


def test_whole_run_and_empty_table(spark, tables):
    documents(spark, ROWS).write.parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.run(spark, tables).count() == 6
    documents(spark, []).write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.run(spark, tables).count() == 0


def test_one_long_text_beside_short_ones_takes_little_memory():
    model = lm_scoring.Model.start(np.ones(lm_scoring.CLASSES * lm_scoring.CLASS_WORDS))
    rng = np.random.default_rng(1)
    short = [rng.integers(0, 2000, 5) for _ in range(255)]
    alone = [lm_scoring.score_texts(model, [t])[0] for t in short[:5]]
    tracemalloc.start()
    out = lm_scoring.score_texts(model, [rng.integers(0, 2000, 20_000), *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and np.allclose(out[1:6], alone, rtol=1e-4)  # 256 lanes of 20,000 places were 20 MB of ids alone
    assert 256 * 500_000 * 4 > 100e6 > lm_scoring.PADDED * 4


def test_stages_send_texts_to_python_in_small_batches(spark, tables):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "concat(id, repeat(' word', 1000)) AS text", "'en' AS lang", "'s' AS source", "5004L AS n_chars")
    corpus_pipeline.STAGES[0][1](spark, docs, tables)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 15e6 and max(r.n for r in sizes) < 1.1 * common.BATCH_BYTES  # one batch of 15 MB before


def test_tokens_are_met_again_in_whatever_batches_they_come():
    texts = [" ".join(f"w{k % 3}x{j}" for j in range(30)).encode() for k in range(50)] + [b"own words of this text alone"] * 9
    whole = pa.RecordBatch.from_pydict({"text": texts})
    met = lambda batches: sorted((t, n) for out in ngram_jaccard._met_again(iter(batches)) for t, n in zip(*(c.to_pylist() for c in out.columns), strict=True))
    apart = [pa.RecordBatch.from_pydict({"text": [a, b]}) for a, b in zip(texts[::2], texts[1::2] + [b""])]
    varied = [pa.RecordBatch.from_pydict({"text": [f"{k} a b c d e f".encode()]}) for k in range(4)]
    assert met([whole]) == met(apart) == [] and [n for _, n in met(varied)] == [4, 4]  # nothing was met in batches of one before
    assert [n for _, n in met([whole, *varied])] == [4, 4]


def test_an_update_visits_only_the_words_of_its_window():
    model = lm_scoring.Model.start(np.ones(lm_scoring.CLASSES * lm_scoring.CLASS_WORDS))
    trainer, met = lm_scoring.Trainer(model), np.array([3, 70, 3, 900])
    unmet = np.setdiff1d(np.arange(len(model.w["x"])), met)
    trainer.seen["x"][unmet] = 0  # a visit divides by it
    with np.errstate(invalid="ignore"):
        trainer.run([met])
    assert np.array_equal(trainer.model.w["x"][unmet], model.w["x"][unmet]) and not np.array_equal(trainer.model.w["x"][met], model.w["x"][met])


def test_padding_of_a_window_is_not_computed():
    rng, model = np.random.default_rng(18), lm_scoring.Model.start(np.ones(lm_scoring.CLASSES * lm_scoring.CLASS_WORDS))
    ids, mask, h = np.zeros((32, 5), np.int64), np.zeros((32, 5), bool), rng.standard_normal((5, 32)).astype(np.float32)
    for lane, n in enumerate((3, 32, 1, 32, 7)):
        ids[:n, lane], mask[:n, lane] = rng.integers(1, 2000, n), True
    model.w["x"][0] = np.nan  # the id that stands in places without one
    loss, grad, after = model.window(ids, mask, h)
    assert np.isfinite(loss) and np.isfinite(after).all() and all(np.isfinite(g).all() for g in grad.values())  # padding made all of them NaN before
    alone = [model.window(ids[:, k : k + 1], mask[:, k : k + 1], h[k : k + 1]) for k in range(5)]
    assert np.isclose(loss, sum(a[0] for a in alone)) and np.allclose(after, np.concatenate([a[2] for a in alone]), atol=1e-6)
    assert all(np.allclose(g, sum(a[1][name] for a in alone), atol=1e-4) for name, g in grad.items())


def test_sums_by_id_and_softmax_of_large_logits():
    rng = np.random.default_rng(19)
    ids, rows = np.concatenate([np.full(100, 7), rng.integers(0, 900, 400), np.full(16, 3), np.full(17, 2000)]), rng.standard_normal((533, 6))
    want = np.zeros((2001, 6))
    np.add.at(want, ids, rows)
    distinct, sums = lm_scoring.sums_by_id(ids, rows)
    assert sorted(distinct) == sorted(set(ids.tolist())) and np.allclose(sums, want[distinct])
    out, slopes = lm_scoring.softmax(np.array([[500.0, 499.0], [-900.0, -900.0]]), np.array([0, 1]), True)
    assert np.allclose(out, [-np.log1p(np.exp(-1)), -np.log(2)]) and np.allclose(slopes[1], [0.5, -0.5])


def test_tokens_are_words_split_at_six_kinds_of_space(monkeypatch):
    texts = [b"", b" \t\n", b" A B\x0bc\x0cd\re\n", b"x\x1cy\x00 z\xc2\xa0q \xff\xfeQ\x85 ", "É ü 中　文".encode(), b"one", b"the THE " * 500]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})
    want = [[*t.lower().split(), b""] for t in texts]
    for size in (1, 10, 1 << 20):
        monkeypatch.setattr(lm_scoring, "TOGETHER", size)
        got = [words.to_pylist()[at:end] for _, words, edges in lm_scoring.tokens([batch.slice(1), batch.slice(0, 0)]) for at, end in zip(edges, edges[1:], strict=False)]
        assert got == want[1:]
    counted = lm_scoring.tokens([batch])
    assert sum(len(words) for _, words, _ in counted) == sum(map(len, want))
