"""Sampled signals, frames, labels and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timespan.operators import intervals as iv


def peaks(samples: DataFrame, points: int) -> DataFrame:
    """The envelope of each medium in at most `points` places, clipped to [0, 1]; values that aren't finite are 0."""
    v = F.abs(F.when(F.isnan("v") | F.abs("v").isin(float("inf")), 0.0).otherwise(F.coalesce("v", F.lit(0.0))))
    n = samples.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    sized = samples.withColumn("v", v).join(n, "media_id").withColumn("width", F.greatest(F.ceil(F.col("n") / points), F.lit(1)))
    return sized.groupBy("media_id", F.floor(F.col("sample_idx") / F.col("width")).alias("place")).agg(F.least(F.max("v"), F.lit(1.0)).alias("peak")).filter(F.col("place") < points)


def peak_range(envelope: DataFrame) -> DataFrame:
    """low and high of each medium's envelope."""
    return envelope.groupBy("media_id").agg(F.min("peak").alias("low"), F.max("peak").alias("high"))


def display_envelope(samples: DataFrame, rate: int = 16_000, most: int = 2000, dense: int = 64) -> DataFrame:
    """The envelope that is drawn: place, peak of the channels (media_id, channel, sample_idx, v) in places of equal strides.

    60 places a second, at least 500 and at most `most`, but never less than 256 or more than there are samples. A
    stride longer than 2 * dense samples is looked at in steps of its `dense`-th part; the last place takes what is left.
    """
    n = samples.groupBy("media_id").agg((F.max("sample_idx") + 1).alias("n"))
    wanted = F.greatest(F.lit(256), F.least(F.lit(most), F.greatest(F.lit(500), F.ceil(F.greatest(F.col("n") / rate, F.lit(0.1)) * 60))))
    sized = n.withColumn("places", F.greatest(F.lit(1), F.least("n", wanted)))
    sized = sized.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("places"))))
    sized = sized.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("stride") / dense)))
    place = F.least(F.floor(F.col("sample_idx") / F.col("stride")), F.col("places") - 1)
    df = samples.join(sized, "media_id").withColumn("place", place)
    seen = df.filter((F.col("sample_idx") - F.col("place") * F.col("stride")) % F.col("step") == 0)
    v = F.abs(F.when(F.isnan("v"), 0.0).otherwise(F.coalesce("v", F.lit(0.0))))
    return seen.groupBy("media_id", "place").agg(F.least(F.max(v), F.lit(1.0)).alias("peak"))


def motion_score(frames: DataFrame) -> DataFrame:
    """Mean absolute difference of neighbouring frames, and the number of frames; one frame scores 0."""
    before = F.lag("pixels").over(Window.partitionBy("media_id").orderBy("frame_idx"))
    diff = F.aggregate(F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    df = frames.withColumn("before", before).withColumn("diff", diff).withColumn("pairs", F.when(F.col("before").isNotNull(), F.size("pixels")))
    return df.groupBy("media_id").agg(F.coalesce(F.sum("diff") / F.sum("pairs"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("frames"))


def label_runs(frames: DataFrame, window_us: int = 10_000_000) -> DataFrame:
    """Runs of equal labels in each window, without label 0; frames are 270 samples of 16 kHz apart, from sample 721 on."""
    w = Window.partitionBy("media_id", "window_idx").orderBy("frame_idx")
    change = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1))
    runs = frames.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    grouped = runs.groupBy("media_id", "window_idx", "run", "label").agg(F.min("frame_idx").alias("first"), (F.max("frame_idx") + 1).alias("last")).filter("label <> 0")

    def at(frame: str):
        return F.rint(F.col("window_idx") * window_us + (F.lit(721) + 270 * F.col(frame)) * 62.5).cast("long")

    return grouped.select("media_id", "window_idx", "label", at("first").alias("start_us"), at("last").alias("end_us"))


def zero_crossings(samples: DataFrame) -> DataFrame:
    """pos of each sign change, by the share of the values on its sides."""
    nxt = F.lead("v").over(Window.partitionBy("media_id").orderBy("sample_idx"))
    df = samples.withColumn("next", nxt).filter((F.col("v") * F.col("next") < 0) | (F.col("v") == 0))
    part = F.when(F.col("v") == 0, 0.0).otherwise(F.abs("v") / (F.abs("v") + F.abs("next")))
    return df.select("media_id", (F.col("sample_idx") + part).alias("pos"))


def snap_to_zero(targets: DataFrame, samples: DataFrame, reach: int) -> DataFrame:
    """Each target moved to the nearest crossing within reach, else to the quietest sample there, else kept.

    A target meets only the samples of its bin of `reach` places and of the bins beside it.
    """
    width = max(reach, 1)

    def place(c: str):
        return F.floor(F.col(c) / width)

    near_bins = F.explode(F.sequence(place("target") - 1, place("target") + 1)).alias("bin")
    t = targets.select("media_id", "target").distinct().select("media_id", "target", near_bins)
    crossings = zero_crossings(samples).withColumn("bin", place("pos"))
    near = t.join(crossings, ["media_id", "bin"]).filter(F.abs(F.col("pos") - F.col("target")) <= reach)
    best = near.groupBy("media_id", "target").agg(F.min_by("pos", F.struct(F.abs(F.col("pos") - F.col("target")), "pos")).alias("crossing"))
    quiet = t.join(samples.withColumn("bin", place("sample_idx")), ["media_id", "bin"]).filter(F.abs(F.col("sample_idx") - F.col("target")) <= reach)
    least = quiet.groupBy("media_id", "target").agg(F.min_by("sample_idx", F.struct(F.abs("v"), "sample_idx")).cast("double").alias("quietest"))
    moved = targets.join(best, ["media_id", "target"], "left").join(least, ["media_id", "target"], "left")
    return moved.select("media_id", "target", F.coalesce("crossing", "quietest", F.col("target").cast("double")).alias("snapped"))


def snap_ranges_to_zero(ranges: DataFrame, samples: DataFrame, reach: int) -> DataFrame:
    """Ranges (media_id, first, last, in samples) with both ends snapped; one that would be empty or reversed stays as it was."""
    ends = ranges.select("media_id", F.explode(F.array("first", "last")).alias("target")).distinct()
    moved = snap_to_zero(ends, samples, reach)
    a, b = (moved.select("media_id", F.col("target").alias(c), F.col("snapped").alias(f"{c}_at")) for c in ("first", "last"))
    df = ranges.join(a, ["media_id", "first"]).join(b, ["media_id", "last"])
    good = F.col("last_at") > F.col("first_at")
    return df.select("media_id", "first", "last", *(F.when(good, F.col(f"{c}_at")).otherwise(F.col(c).cast("double")).alias(f"{c}_at") for c in ("first", "last")))


def mono(samples: DataFrame) -> DataFrame:
    return samples.groupBy("media_id", "sample_idx").agg(F.avg("v").alias("v"))


def resample(samples: DataFrame, src: int, dst: int) -> DataFrame:
    """Linear interpolation at n * dst / src places from the first sample to the last."""
    n = samples.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.floor(F.col("n") * dst / src))
    places = n.filter("m > 0").select("media_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    pos = F.when(F.col("m") > 1, F.col("k") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))
    places = places.withColumn("pos", pos).withColumn("low", F.floor("pos")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    a, b = (samples.select("media_id", F.col("sample_idx").alias(c), F.col("v").alias(f"v_{c}")) for c in ("low", "high"))
    joined = places.join(a, ["media_id", "low"]).join(b, ["media_id", "high"])
    return joined.select("media_id", F.col("k").alias("sample_idx"), (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("pos") - F.col("low"))).alias("v"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; those of length 1e-9 or less stay."""
    norm = F.sqrt(_dot("embedding", "embedding"))
    return vectors.withColumn("norm", norm).withColumn("embedding", F.when(F.col("norm") > 1e-9, F.transform("embedding", lambda x: x / F.col("norm"))).otherwise(F.col("embedding").cast("array<double>")))


def mean_centred(vectors: DataFrame) -> DataFrame:
    """Values of each dimension less their mean in the medium, of which tasks add up their own part first."""
    each = vectors.select("media_id", "span_idx", F.posexplode("embedding").alias("dim", "x"))
    means = each.groupBy(F.col("media_id").alias("of"), F.col("dim").alias("its")).agg(F.avg("x").alias("mean"))
    return each.join(means, F.col("media_id").eqNullSafe(F.col("of")) & (F.col("dim") == F.col("its"))).select("media_id", "span_idx", "dim", (F.col("x") - F.col("mean")).alias("x"))


#: Spans of a medium in a block, about, until it has BLOCKS; beyond that its blocks grow. Distances are taken of so many spans by so many.
BLOCK = 1_000
#: Blocks of a medium at most, and so copies of a span in the shuffle: each two blocks are a task's group.
BLOCKS = 8


def _stacked(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span numbers in order, vectors as rows (short ones filled with 0), and their lengths: -1 for null vectors and those with nulls."""
    ids, column = side.column("span_idx").to_numpy(), side.column("embedding").combine_chunks()
    flat = column.flatten()
    if len(column) and not column.null_count and not flat.null_count and len(set(column.value_lengths().to_pylist())) == 1:
        x = flat.to_numpy().reshape(len(column), -1)
        length = np.full(len(x), x.shape[1], np.int64)
    else:
        vectors = column.to_pylist()
        length = np.array([-1 if v is None or None in v else len(v) for v in vectors], np.int64)
        x = np.zeros((len(vectors), max(0, length.max(initial=0))))
        for row, v, n in zip(x, vectors, length, strict=True):
            if n > 0:
                row[:n] = v
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order], length[order]


def _tile(media: int, one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
    """Distances of some spans to others, or, in the same block, to those after them. Unlike lengths and nulls count as 0, as in the SQL twin's greatest."""
    d = np.clip(1 - x.astype(np.float64) @ y.astype(np.float64).T, 0, 2)
    d[np.isnan(d)] = 2
    d[(m[:, None] != n) | (m[:, None] < 0)] = 0
    p, q = np.nonzero(one[:, None] < two if same else np.ones(d.shape, bool))
    arrays = [np.full(len(p), media, np.int64), np.minimum(one[p], two[q]), np.maximum(one[p], two[q]), d[p, q]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["media_id", "a_idx", "b_idx", "distance"])


def cosine_distances(vectors: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Distances of all pairs of a medium's spans, however many.

    They are dealt into blocks; each two blocks meet in a group of their own, which holds them alone: its pairs leave
    it a tile at a time. A span is sent to as many groups as there are blocks, so the shuffle grows with the spans
    although the pairs grow with their square.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media, i, j = (k.as_py() for k in key)
        rows = pa.Table.from_batches(batches)
        own = rows.column("block").to_numpy()
        one, x, m = a = _stacked(rows.filter(pa.array(own == i)))
        two, y, n = a if i == j else _stacked(rows.filter(pa.array(own == j)))
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (x, y))
        for p in range(0, len(one), block):
            for q in range(p if i == j else 0, len(two), block):  # in order, so what comes before is no pair
                s, t = slice(p, p + block), slice(q, q + block)
                yield _tile(media, one[s], two[t], x[s], y[t], m[s], n[t], i == j)

    sizes = vectors.groupBy("media_id").agg(F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(blocks)).cast("int").alias("blocks"))
    rows = vectors.filter("span_idx IS NOT NULL").join(sizes, "media_id").withColumn("block", F.pmod(F.xxhash64("span_idx"), "blocks").cast("int"))
    sent = rows.select("media_id", "span_idx", "embedding", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = sent.select("media_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "span_idx", "embedding")
    key = ["media_id", "i", "j"]
    # else a medium's groups stay in one task if the join before has dealt its rows by media_id
    return met.repartition(*key).groupBy(*key).applyInArrow(run, "media_id long, a_idx long, b_idx long, distance double")


def linkage(unit: np.ndarray) -> list[tuple[float, int, int]]:
    """The merges of average linkage over cosine distances: height, and a member of each of the two clusters.

    The mean distance of two clusters follows from the sums of their vectors, so no matrix of distances is kept: memory
    grows with the vectors alone. A chain of nearest neighbours finds each merge with a few products of one sum with all.
    """
    m = len(unit)
    sums, size, alive, merges, chain = unit.copy(), np.ones(m), np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            top = chain[-1]
            d = np.clip(1 - (sums @ sums[top]) / (size * size[top]), 0, 2)
            d[~alive] = np.inf
            d[top] = np.inf
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[a if top == b else b]), a, b))
        sums[a] += sums[b]
        size[a] += size[b]
        alive[b], sums[b], size[b] = False, 0, 1
    return merges


def average_linkage(unit: np.ndarray, cut: float, clusters: int | None = None) -> np.ndarray:
    """Labels from 1 on by average linkage of cosine distances, up to distance `cut` or a number of clusters. Equal heights merge in the order they are found."""
    m = len(unit)
    merges = sorted(linkage(unit), key=lambda x: x[0]) if m and (clusters is None or clusters < m) else []
    merges = [x for x in merges if x[0] <= cut] if clusters is None else merges[: m - max(1, clusters)]
    root = list(range(m))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for _, a, b in merges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return np.unique([top(k) for k in range(m)], return_inverse=True)[1].reshape(-1) + 1


def cluster_spans(vectors: DataFrame, cut: float = 0.38, clusters: int | None = None) -> DataFrame:
    """speaker of each span; a medium's spans are clustered by themselves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span_idx")
        x = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        speaker = average_linkage(np.where(norm > 1e-9, x / np.maximum(norm, 1e-12), x), cut, clusters)
        return pd.DataFrame({"media_id": pdf["media_id"], "span_idx": pdf["span_idx"], "speaker": speaker.astype("int64")})

    return vectors.select("media_id", "span_idx", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("media_id").applyInPandas(run, "media_id long, span_idx long, speaker long")


def speaker_turns(spans: DataFrame, cut: float = 0.38, clusters: int | None = None, least: int = 800_000, gap: int = 300_000) -> DataFrame:
    """media_id, start_us, end_us, speaker: spans (span_idx, start_us, end_us, embedding) by who speaks, neighbours of one speaker joined.

    Spans shorter than `least` and those without a vector are dropped first; a medium's only span is speaker 1.
    """
    kept = spans.filter((F.col("end_us") - F.col("start_us") >= least) & F.col("embedding").isNotNull())
    heard = kept.drop("embedding").join(cluster_spans(kept, cut, clusters), ["media_id", "span_idx"])
    return iv.merge_labelled(heard.select("media_id", "start_us", "end_us", "speaker"), gap, 0, "speaker").select("media_id", "start_us", "end_us", "speaker")


def score_chunks(chunks: DataFrame, load, score, schema: str) -> DataFrame:
    """A caller's function over chunks: load() runs once in a task, score(model, pdf) for each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield score(model, pdf)

    return chunks.mapInPandas(run, schema)
