"""Quality classifier (operator 2): a weak-label model and a hashed linear scorer, for low quality and for toxicity.

Heuristic labellers that overlap vote on every document; where a table of labels covers it, that is one more labeller.
Word lists vote against toxicity only in their own language. Expectation-maximisation over the counts of vote patterns
estimates how reliable each is. Posterior labels of a bounded sample (`sample` documents of each class that some
labeller votes on, chosen by hash over the whole corpus) train a linear scorer over hashed words, their beginnings and shapes, which then
scores every document. It keeps the features that differ most between the classes: with all of them, it learns single
documents by heart, and word lists in one language say nothing of the others.
Posterior and score are combined; a document is kept if neither target reaches `threshold`.

Defined results: a null or empty text has no votes but that it is too short; repeated rows get equal results; a table without
rows gives no rows; repeated labels of a
doc_id count as their largest; only doc_id and text, and doc_id, quality and toxic of labels are read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import ALNUM, stored, table, utf8
from timespan.llm.weak_labels import ABSTAIN, NO, YES, fit_label_model, score, train_selected

DIMENSIONS = 1 << 18
#: Documents of each class that the scorer is trained on, at most.
SAMPLE = 3000
TARGETS = ("low", "toxic")
#: Features that the scorer keeps, and training documents that must have one.
TELLING, LEAST_ROWS = 1000, 5
#: Distinct words of a document that share a beginning often enough to count as a family, as the words for one thing do.
FAMILY = 3
LOW_LABELLERS = 10

#: Common insults of English, in three lists that overlap.
INSULTS = (
    frozenset(b"idiot moron stupid loser clown trash dumb fool imbecile garbage".split()),
    frozenset(b"disgusting pathetic worthless scum trash idiot stupid filth vermin useless".split()),
    frozenset(b"loser clown moron scum pathetic worthless disgusting jerk creep coward".split()),
)
#: Frequent function words: of English, and of Spanish, French and German with it.
ENGLISH = frozenset(b"the of and to in is that it was with as be by are this from".split())
FUNCTION_WORDS = ENGLISH | frozenset("the of and to in a is that it for on was with as be by are this at from de la el en y que los las un una por le les des et est pour dans qui der die das und ist von den mit zu ein eine".encode().split())


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#*$%&|<>!{}[]~^=_\\"
#: Words that end in a mark.
_ODD = re.compile(rb"[#*$%&|<>!=_~^](?=[ \t-\r]|$)")


def _yes(value: float, least: float) -> int:
    return YES if value >= least else ABSTAIN


def votes(text: bytes) -> tuple[list[int], list[int]]:
    """The labellers' votes on low quality and on toxicity."""
    words = text.split()
    n = len(words)
    plain = text.translate(ALNUM).split()
    if not n:
        return [YES] + [ABSTAIN] * (LOW_LABELLERS - 1), [ABSTAIN] * len(INSULTS)
    letters = sum(map(len, plain)) or 1
    upper = len(text) - len(text.translate(None, _UPPER))
    marks = len(text) - len(text.translate(None, _MARKS))
    odd = len(_ODD.findall(text)) / n if marks else 0.0
    # where there is less than a capital for two words, no share of words in capitals counts
    caps = sum(1 for w in words if len(w) > 1 and w.isupper()) / n if 2 * upper > n else 0.0
    repeated = 1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    function = sum(map(FUNCTION_WORDS.__contains__, plain)) / max(1, len(plain))
    prose = 1 - odd - caps
    quality = [
        _yes(-n, -19),
        _yes(marks / len(text), 0.04),
        _yes(odd, 0.2),
        _yes(upper / letters, 0.4),
        _yes(caps, 0.3),
        _yes(repeated, 0.4),
        _yes(-len(set(words)) / n, -0.35) if n > 40 else ABSTAIN,
        _yes(text.count(b"|") / n, 0.15),
        YES if prose < 0.75 else NO if prose >= 0.97 and n >= 20 and repeated < 0.25 else ABSTAIN,
        YES if function < 0.02 else NO if function >= 0.08 and repeated < 0.25 else ABSTAIN,
    ]
    own = set(plain)
    english = sum(map(ENGLISH.__contains__, plain)) >= 0.04 * len(plain)
    return quality, [YES if own & some else NO if english else ABSTAIN for some in INSULTS]


class WordIds(dict):
    """Feature ids of a word and its beginnings, kept for words seen lately; those that `needed` doesn't have are left out."""

    def __init__(self, needed: np.ndarray | None = None):
        super().__init__()
        self.needed = needed

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        ids = (zlib.crc32(x) % DIMENSIONS for x in (w, *(b"\1" + w[:k] for k in (5, 6, 7, 8) if len(w) > k)))
        own = self[w] = tuple(ids) if self.needed is None else tuple(x for x in ids if self.needed[x])
        return own


def _shared(ids: np.ndarray) -> np.ndarray:
    """The features of beginnings that a family of words has."""
    return ids * 40_503 % DIMENSIONS


def needed_ids(weights: list[np.ndarray]) -> np.ndarray:
    """Which ids of words and beginnings have weights, by themselves or as shared ones; the others add nothing to a score."""
    used = np.any([w[:DIMENSIONS] != 0 for w in weights], axis=0)
    return used | used[_shared(np.arange(DIMENSIONS))]


_WORD_IDS = WordIds()


def features(text: bytes, word_ids: WordIds = _WORD_IDS) -> np.ndarray:
    """Hashed distinct words with their beginnings, those beginnings again that FAMILY words or more share, and shapes of the text as a whole."""
    words = text.split()
    n = len(words)
    shapes = [b"\0n%d" % min(12, n.bit_length())]
    if n:
        shapes += [b"\0%s%d" % (c, min(9, int(20 * text.count(c) / n))) for c in (b"#", b"*", b"|", b"!", b"$", b"%", b"&", b"@")]
        shapes.append(b"\0u%d" % min(40, int(10 * (len(text) - len(text.translate(None, _UPPER))) / n)))
        shapes.append(b"\0d%d" % int(10 * len(set(words)) / n))
        shapes.append(b"\0r%d" % int(10 * len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)))
    ids = list(itertools.chain.from_iterable(map(word_ids.__getitem__, set(text.translate(ALNUM).split()))))
    own, times = np.unique(np.array(ids, np.int64), return_counts=True)
    return np.unique(np.concatenate([own, _shared(own[times >= FAMILY]), np.array([zlib.crc32(x) % DIMENSIONS for x in shapes], np.int64)])).astype(np.int32)


def label_votes(docs: DataFrame) -> DataFrame:
    """doc_id, pick (a hash of the text), low and toxic: each row's votes as digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [votes(x.as_py()) for x in batch.column(2)]
            low, toxic = (["".join(map(str, x[k])) for x in each] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.string()), pa.array(toxic, pa.string())], ["doc_id", "pick", "low", "toxic"])

    return _read(docs).mapInArrow(run, "doc_id long, pick long, low string, toxic string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("pick"), utf8().alias("text"))


def classify_quality(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, low_posterior, toxic_posterior, low_score, toxic_score, kept."""
    spark = docs.sparkSession
    voted = label_votes(docs)
    if labels is not None:
        each = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("q"), F.max(F.col("toxic").cast("int")).alias("t"))
        voted = voted.join(each, "doc_id", "left")

        def vote(no):
            return F.when(no, NO).when(~no, YES).otherwise(ABSTAIN).cast("string")

        voted = voted.select("doc_id", "pick", F.concat("low", vote(F.col("q") > 0)).alias("low"), F.concat("toxic", vote(F.col("t") <= 0)).alias("toxic"))
    voted = stored(voted)
    more = labels is not None
    models, weights = {}, {}
    for target in TARGETS:
        patterns = [(r[0], r[1]) for r in voted.groupBy(target).agg(F.count(F.lit(1))).orderBy(target).collect()]  # 3 ** labellers at most
        width = (LOW_LABELLERS if target == "low" else len(INSULTS)) + more
        matrix = np.array([[int(c) for c in p] for p, _ in patterns], np.int64).reshape(-1, width)
        models[target] = fit_label_model(matrix, np.array([n for _, n in patterns], np.float64))
        posterior = dict(zip([p for p, _ in patterns], models[target].posterior(matrix).tolist(), strict=True)) if patterns else {}
        weights[target] = _train(docs, voted, target, posterior, models[target].prior, sample)
    shared = spark.sparkContext.broadcast((models, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, learned = shared.value
        word_ids = WordIds(needed_ids(list(learned.values())))
        known: dict[tuple[str, str], float] = {}  # a posterior for each pattern of votes
        for batch in batches:
            out: dict[str, list[float]] = {f"{t}_{what}": [] for t in TARGETS for what in ("posterior", "score")}
            for cell in batch.column(2):
                text = cell.as_py()
                own = features(text, word_ids)
                for target, ballot in zip(TARGETS, votes(text), strict=True):
                    key = target, "".join(map(str, ballot))
                    if key not in known:  # a label is used in training alone
                        known[key] = float(fitted[target].posterior(np.array([ballot + [ABSTAIN] * more]))[0])
                    out[f"{target}_posterior"].append(known[key])
                    out[f"{target}_score"].append(score(own, learned[target]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in out.values())], ["doc_id", *out])

    scored = _read(docs).mapInArrow(run, "doc_id long, low_posterior double, low_score double, toxic_posterior double, toxic_score double")
    bad = [F.greatest(F.col(f"{t}_score"), (F.col(f"{t}_posterior") + F.col(f"{t}_score")) / 2) >= threshold for t in TARGETS]
    return scored.withColumn("kept", ~(bad[0] | bad[1]))


def _train(docs: DataFrame, voted: DataFrame, target: str, posterior: dict[str, float], prior: float, sample: int) -> np.ndarray:
    """The scorer for target, from the posterior labels of 2 * sample documents at most.

    Documents on which no labeller votes tell nothing and train nothing. Without documents of both classes to train on,
    the scorer is the share of class 1.
    """
    plain = np.zeros(DIMENSIONS + 1, np.float32)
    plain[-1] = np.log(prior) - np.log1p(-prior)
    voted_on = [(pattern, p) for pattern, p in posterior.items() if set(pattern) != {str(ABSTAIN)}]
    if not voted_on:
        return plain
    spark = docs.sparkSession
    labels = F.broadcast(spark.createDataFrame(voted_on, f"{target} string, p double"))  # 3 ** labellers at most
    rows = voted.select("pick", target).join(labels, target).groupBy("pick").agg(F.max("p").alias("p"))
    # the confident rows of each class with the least hashes
    picked = [rows.filter(which).orderBy("pick").limit(sample).select("pick", "p") for which in ("p >= 0.8", "p <= 0.2")]
    classes = [part.collect() for part in picked]
    if not all(classes):
        return plain
    chosen = {r["pick"]: r["p"] for part in classes for r in part}
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in chosen], "pick long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x.as_py()) for x in batch.column(1)], pa.list_(pa.int32()))], ["pick", "own"])

    texts = _read(docs).select("pick", "text").join(wanted, "pick", "left_semi").dropDuplicates(["pick"])
    got = texts.mapInArrow(run, "pick long, own array<int>").toArrow().combine_chunks()
    found = dict(zip(got.column(0).to_pylist(), (x.values.to_numpy() for x in got.column(1)), strict=True))
    order = sorted(found)
    return train_selected([found[k] for k in order], np.array([chosen[k] for k in order]), DIMENSIONS, TELLING, LEAST_ROWS)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
