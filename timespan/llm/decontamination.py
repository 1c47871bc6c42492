"""Benchmark decontamination (operator 7): a distributed positional inverted index of the training tokens.

Test windows are `window` consecutive words of an item, or the whole of a shorter item. One pass over the training
texts writes the posting lists of the windows' terms to the shared folder, for each block of some hundred documents. The
rest reads this index only: terms are counted, every window is searched from its rarest term, and the posting lists of
its other terms, the next rarest first, are adjusted by their offsets and intersected, so that exact phrases remain.
Proximity matches are places of a window's rarest term (the first in byte order of equally rare ones) with its next
rarest one within `near` words and no exact phrase there; terms that no training text has are left out of this choice,
so a window that has one is still searched.

The index is partitioned by blocks of documents, so that no term's postings, however frequent, meet in one task. Windows
are sent to the tasks in blocks of at most `block_windows` distinct windows; a larger benchmark takes several passes,
each with the index of its own terms.

Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. Defined results: a null or
empty text has no words, no hits and isn't contaminated; items without words have no windows; repeated rows and null
doc_ids are judged row by row; items that share a window all occur; null item_ids are left out of items_sha256; only
doc_id, text, item_id are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import ALNUM, counted, freed, shared_dir, stored, table, utf8

WINDOW, NEAR = 13, 26
#: Distinct test windows that a pass over the training texts looks for (about 150 bytes each in a task).
BLOCK_WINDOWS = 200_000


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (the window's), items (sorted distinct ids as strings): one row per distinct window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = text.translate(ALNUM).split()
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    ids.append(item)
                    words.append(b" ".join(own[k : k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary())], ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")).mapInArrow(cut, "item_id string, words binary")
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


#: Documents and words of a block of the index, about.
BLOCK_DOCS, BLOCK_WORDS = 512, 1 << 20
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    """doc_ids, keys and words of each block."""
    ids, keys, texts, held = [], [], [], 0
    for batch in batches:
        for doc_id, key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = cell.as_py().translate(ALNUM).split()
            ids.append(doc_id)
            keys.append(key)
            texts.append(words)
            held += len(words)
            if len(ids) >= BLOCK_DOCS or held >= BLOCK_WORDS:
                yield ids, keys, texts
                ids, keys, texts, held = [], [], [], 0
    if ids:
        yield ids, keys, texts


def write_index(docs: DataFrame, terms: list[bytes], gap: int) -> DataFrame:
    """The inverted index, written to the shared folder: a row for each block of documents.

    doc_ids, keys, n_words, first (place of each document's first word in the block), and the posting lists of the terms:
    terms (places in `terms`, ascending), ends (of each one's postings), postings (places in the block, ascending for
    each term). Documents of a block are `gap` places apart, so that no phrase or proximity match reaches into another.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # of at most BLOCK_WINDOWS windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for ids, keys, texts in _blocks(batches):
            sizes = np.array([len(words) for words in texts], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            tokens, places = [], []
            for words, start in zip(texts, first.tolist(), strict=True):
                own = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
                at = np.flatnonzero(own >= 0)
                tokens.append(own[at])
                places.append(at + start)
            token, place = np.concatenate(tokens), np.concatenate(places).astype(np.int32)
            order = np.argsort(token, kind="stable")
            own, n = counted(token)
            values = [(ids, _LONGS), (keys, _LONGS), (sizes, _LONGS), (first, _LONGS), (own, _INTS), (np.cumsum(n), _INTS), (place[order], _INTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in values], _INDEX)

    folder = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    _read(docs).mapInArrow(freed(run), ", ".join(f"{c} array<{'long' if k < 4 else 'int'}>" for k, c in enumerate(_INDEX))).write.parquet(folder)
    return spark.read.parquet(folder)


_INDEX = ["doc_ids", "keys", "n_words", "first", "terms", "ends", "postings"]


def posting_counts(index: DataFrame, n_terms: int) -> DataFrame:
    """term (its place), n: the postings of each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                total[terms.values.to_numpy()] += np.diff(ends.values.to_numpy(), prepend=0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "n"])

    return index.select("terms", "ends").mapInArrow(freed(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _among(values: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Which values are among these, which ascend and aren't empty."""
    return these[np.minimum(np.searchsorted(these, values), len(these) - 1)] == values


class Queries:
    """Test windows over term ids, each with its terms' offsets from the rarest on."""

    def __init__(self, windows: list[list[bytes]], terms: list[bytes], counts: np.ndarray):
        place = {t: k for k, t in enumerate(terms)}
        self.ids = [np.array([place[w] for w in words], np.int32) for words in windows]
        self.order, self.whole, self.second = [], [], []
        self.by_anchor: dict[int, list[int]] = {}
        for k, ids in enumerate(self.ids):
            order = np.lexsort((ids, counts[ids])).astype(np.int32)
            there = order[counts[ids[order]] > 0]  # a term that no training text has rules exact phrases out
            others = ids[there][ids[there] != ids[there[0]]] if len(there) else there
            self.order.append(there)
            self.whole.append(len(there) == len(ids))
            self.second.append(int(others[0]) if len(others) else None)
            if self.whole[k] or len(others):
                self.by_anchor.setdefault(int(ids[there[0]]), []).append(k)

    def search(self, postings: dict[int, np.ndarray], near: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window with matches: the window, starts of its exact phrases, starts of its proximity matches, and places of the rarest term in these.

        A proximity match starts where the window would around its rarest term, which can be before the document's start.
        """
        none = np.zeros(0, np.int32)
        for anchor in postings.keys() & self.by_anchor.keys():
            places = postings[anchor]
            for k in self.by_anchor[anchor]:
                ids, order = self.ids[k], self.order[k]
                starts = places - order[0]
                exact = starts if self.whole[k] else none
                for o in order[1:]:
                    if not len(exact):
                        break
                    other = postings.get(int(ids[o]))
                    exact = none if other is None else exact[_among(exact + o, other)]
                by, other = none, postings.get(self.second[k])
                if other is not None:
                    at = np.searchsorted(other, places - near)
                    close = (at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= places + near)
                    if len(exact):
                        close &= ~_among(starts, exact)
                    by = places[close]
                if len(exact) or len(by):
                    yield k, exact, by - order[0], by


def search_index(index: DataFrame, queries: Queries, keys: list[int], items: list[list[str]], near: int = NEAR) -> DataFrame:
    """doc_id, key, n_words, spans (hit word positions of each phrase), items and near (proximity matches) of every document. keys, items: those of each window."""
    shared = index.sparkSession.sparkContext.broadcast((queries, keys, items))  # at most BLOCK_WINDOWS windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, of = shared.value
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                doc_ids, doc_keys, sizes = (x.values for x in row[:3])
                first, terms, ends, postings = (x.values.to_numpy() for x in row[3:])
                cuts = [0, *ends.tolist()]
                lists = {t: postings[x:y] for t, x, y in zip(terms.tolist(), cuts[:-1], cuts[1:], strict=True)}
                spans, found, close = ([[] for _ in first] for _ in range(3))
                for k, exact, starts, by in q.search(lists, near):
                    n = len(q.ids[k])
                    for start, doc in zip(exact.tolist(), (np.searchsorted(first, exact, "right") - 1).tolist(), strict=True):
                        spans[doc].append((start - int(first[doc]), start - int(first[doc]) + n))
                        found[doc] += of[k]
                    for start, doc in zip(starts.tolist(), (np.searchsorted(first, by, "right") - 1).tolist(), strict=True):
                        close[doc].append({"window": names[k], "start": start - int(first[doc])})
                columns = [[[{"s": x, "e": y} for x, y in sorted(set(own))] for own in spans], [sorted(set(own)) for own in found], close]
                kinds = [pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("window", pa.int64()), ("start", pa.int64())]))]
                arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, doc_keys, sizes, *arrays], ["doc_id", "key", "n_words", "spans", "items", "near"])

    return index.mapInArrow(freed(run), f"doc_id long, key long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, near {_NEAR_TYPE}")


_NEAR_TYPE = "array<struct<window:long,start:long>>"


def _read(docs: DataFrame) -> DataFrame:
    """key: rows that share doc_id and key have the same words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("key"), utf8().alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, key, n_words, spans, items, near: the exact phrases and proximity matches of every document."""
    windows = stored(test_windows(benchmark, window).withColumn("window", F.xxhash64("words")))
    blocks = -(-windows.count() // block_windows) or 1
    passes = []
    for k in range(blocks):
        rows = windows.filter(F.pmod(F.col("window"), F.lit(blocks)) == k).collect()  # block_windows, about
        phrases = [bytes(r["words"]).split() for r in rows]
        terms = sorted({w for p in phrases for w in p})
        counts = np.zeros(len(terms), np.int64)
        index = write_index(docs, terms, near + window)
        for r in posting_counts(index, len(terms)).collect() if terms else ():
            counts[r["term"]] = r["n"]
        passes.append(search_index(index, Queries(phrases, terms, counts), [r["window"] for r in rows], [list(r["items"]) for r in rows], near))
    if blocks == 1:
        return passes[0]
    found = stored(passes[0])
    for more in passes[1:]:
        found = found.unionByName(stored(more.filter((F.size("items") > 0) | (F.size("near") > 0) | (F.size("spans") > 0)).dropDuplicates(["doc_id", "key"]).withColumn("n_words", F.lit(None).cast("long"))))
    # the first pass has a row for each document, repeated rows included; the others add to rows of the same content
    first, more = found.filter("n_words IS NOT NULL"), found.filter("n_words IS NULL")
    more = more.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"), F.flatten(F.collect_list("near")).alias("n2"))
    more = more.withColumnsRenamed({"doc_id": "d2", "key": "k2"})
    none = F.expr("cast(array() AS array<struct<s:long,e:long>>)"), F.expr("cast(array() AS array<string>)"), F.expr(f"cast(array() AS {_NEAR_TYPE})")
    return first.join(more, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")), "left").select(
        "doc_id", "key", "n_words", F.array_sort(F.array_distinct(F.concat("spans", F.coalesce("s2", none[0])))).alias("spans"),
        F.array_distinct(F.concat("items", F.coalesce("i2", none[1]))).alias("items"), F.concat("near", F.coalesce("n2", none[2])).alias("near"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, near (window and start of each proximity match; window is xxhash64 of its words)."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(state, x):
        return F.struct(F.greatest(state["end"], x["e"]).alias("end"), (state["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], state["end"]))).alias("n"))

    found = matches(docs, benchmark, window, near, block_windows).withColumn("n_hit", F.aggregate("spans", zero, cover)["n"])
    return found.select(
        "doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "near",
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per proximity match: doc_id, key, start, words (the window's), items."""
    found = matches(docs, benchmark, window, near, block_windows).select("doc_id", "key", F.explode("near").alias("n")).select("doc_id", "key", F.col("n.window").alias("window"), F.col("n.start").alias("start"))
    windows = test_windows(benchmark, window).withColumn("window", F.xxhash64("words"))
    return found.join(windows, "window").select("doc_id", "key", "start", "words", "items")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_near", F.size("near").cast("long")).drop("key", "near")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bi AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM bw, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 12)),
     lens AS (SELECT DISTINCT n FROM bi),
     di AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM dw, lens, range(1, 100000) r(i) WHERE i + n - 1 <= len(w)),
     m AS (SELECT doc_id, i, n, g, item_id FROM di JOIN bi USING (n, g)),
     hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, range(13) s(k) WHERE k < n GROUP BY doc_id),
     it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS j FROM m GROUP BY doc_id),
     words AS (SELECT doc_id, i, w[i] AS t FROM dw, range(1, 100000) r(i) WHERE i <= len(w)),
     wins AS (SELECT DISTINCT g, string_split(g, ' ') AS gw FROM bi),
     wt AS (SELECT g, gw[k] AS t, min(k) AS k FROM wins, range(1, 14) r(k) WHERE k <= len(gw) GROUP BY ALL),
     tc AS (SELECT t, count(*) AS c FROM words WHERE t IN (SELECT t FROM wt) GROUP BY t),
     ranked AS (SELECT g, t, k, row_number() OVER (PARTITION BY g ORDER BY c, t) AS rank FROM wt JOIN tc USING (t)),
     pairs AS (SELECT a.g, a.t AS t1, a.k, b.t AS t2 FROM ranked a JOIN ranked b ON a.g = b.g AND a.rank = 1 AND b.rank = 2),
     close AS (SELECT DISTINCT x.doc_id, x.i, t1, t2 FROM (SELECT DISTINCT t1, t2 FROM pairs) p JOIN words x ON x.t = t1 JOIN words y ON y.t = t2 AND y.doc_id = x.doc_id AND abs(x.i - y.i) <= 26),
     near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, g, i - k + 1 AS s FROM close JOIN pairs USING (t1, t2)) c ANTI JOIN (SELECT DISTINCT doc_id, g, i AS s FROM m) e USING (doc_id, g, s) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(j, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""
