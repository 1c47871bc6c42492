"""Quality rules (operator 1): cross-document line frequency.

Every document is read once: a task computes the base figures of each text and the hashes of its normalised
lines. The lines (a few per document, never the texts) are then counted per host over distinct contents, so that
exact copies count once; the host's size, which the share is taken of, is counted in the same way. Lines in more
documents of a host than the limits are removed with all their repetitions, and a document that has lost lines and keeps
fewer than `min_words` words is depleted and rejected. `clean` gives the documents that are kept, without those lines.

Defined results: a null or empty text has no words and fails the base rules; rows with the same or a null doc_id
are judged each by itself; a null source is a host of its own; only doc_id, text and the host column are read, so
other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timespan.llm.common import LOWER, SMALL_ROWS, freed, hashes, signed, small, stored, utf8

#: Words below which a text fails, and at which a document is depleted.
MIN_WORDS = 20
#: A line is boilerplate in a host where more documents than this, and a larger share than MAX_SHARE, have it.
MAX_DOCS, MAX_SHARE = 50, 0.001
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"
_SCHEMA = (
    "doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, lines array<long>, line_words array<int>"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = hashes(words)
    rolling = np.zeros(n, np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        rolling ^= rolling >> np.uint64(29)
    order = np.argsort(rolling, kind="stable")
    same = rolling[order][1:] == rolling[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated windows of a UTF-8 text."""
    words = text.split()
    chars = len(text.translate(None, _CONTINUATION + _WHITE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 30 * n_words


def line_hash(words: list[bytes]) -> int:
    """Of a line's words in lower case."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def without_lines(text: bytes, removed: set[int]) -> bytes:
    """The text without the lines of these hashes; blank lines stay."""
    return b"\n".join(x for x in text.split(b"\n") if not (words := x.translate(LOWER).split()) or line_hash(words) not in removed)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for cell in batch.column(3):
            text = cell.as_py()
            n, chars, symbols, dup, rep = base_figures(text)
            lines: dict[int, int] = {}
            for line in text.translate(LOWER).split(b"\n"):
                if words := line.split():
                    hashed = line_hash(words)
                    lines[hashed] = lines.get(hashed, 0) + len(words)  # a removed line goes with all its repetitions
            for column, value in zip(out, (n, chars, symbols, dup, rep, failed(n, rep), list(lines), list(lines.values())), strict=True):
                column.append(value)
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "line_words"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)


def frequent_lines(rows: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """host, line: those above the limits, a host has 1 / max_share times the lines of a mean document at most. rows: host, content, lines (distinct hashes) of each document."""
    host = F.coalesce("host", F.lit("\0")).alias("host")
    contents = rows.select(host, "content", F.explode("lines").alias("line")).groupBy("host", "line", "content").agg(F.count(F.lit(1)).alias("copies"))
    counted = contents.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") > max_docs)
    hosts = rows.groupBy(host).agg(F.countDistinct("content").alias("host_docs"))
    return stored(counted.join(hosts, "host").filter(F.col("line_docs") > max_share * F.col("host_docs")).select("host", "line"))


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, content, the base figures, base_failed, n_lines, n_removed_lines, n_left_words, kept, host, removed_lines (their hashes)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(utf8()).alias("content"), utf8().alias("text"))
    rows = stored(read.mapInArrow(_features, _SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", F.coalesce("host", F.lit("\0")).alias("host"), F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")
    )
    over = frequent_lines(rows.select("host", "content", "lines"), max_docs, max_share)
    # the lines over the limits are the most frequent ones: sent to all tasks if few, else Spark splits their partitions
    removed = lines.join(small(over), ["host", "line"]).groupBy("row").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("words").alias("removed_words"), F.sort_array(F.collect_set("line")).alias("removed_lines"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return rows.join(removed, "row", "left").select(
        "doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), left.alias("n_left_words"),
        (~F.col("base_failed") & (F.col("n_removed_lines").isNull() | (left >= min_words))).alias("kept"), "host", "removed_lines",
    )


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [list({line_hash(words) for line in cell.as_py().translate(LOWER).split(b"\n") if (words := line.split())}) for cell in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int64()))], batch.schema.names[:2] + ["lines"])


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that quality_rules keeps, without the lines above the limits; columns (whatever their names) stay, and n_chars, if there, follows the text.

    Lines are counted first; then each document is judged and cut where it is read, against the lines above the limits
    of its host. Beyond SMALL_ROWS of those, each host's are joined to its documents instead of sent to all tasks.
    """
    read = docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(utf8()).alias("content"), utf8().alias("text"))
    over = frequent_lines(stored(read.mapInArrow(freed(_line_hashes), "host string, content long, lines array<long>")), max_docs, max_share)
    few = over.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    known: dict[str, frozenset[int]] = {}
    if few:
        known = {r["host"]: frozenset(r["lines"]) for r in over.groupBy("host").agg(F.collect_list("line").alias("lines")).collect()}  # SMALL_ROWS lines at most
    shared = docs.sparkSession.sparkContext.broadcast(known)
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names, schema = [f"c{k}" for k in range(len(docs.columns))], docs.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hosts, lists = batch.columns[: len(names)], batch.column(len(names)).to_pylist(), batch.column(len(names) + 1)
            kept, texts = [], []
            for cell, host_name, lines in zip(own[text_at].cast(pa.binary()), hosts, lists, strict=True):
                text = cell.as_py() or b""
                removed = frozenset(lines.as_py()) if lines.is_valid else shared.value.get(host_name, frozenset())
                less = without_lines(text, removed) if removed else text
                words = text.split()
                kept.append(not failed(len(words), repeated_words(words)) and (len(less) == len(text) or len(less.split()) >= min_words))
                texts.append(None if len(less) == len(text) or not kept[-1] else less.decode())
            changed = pa.array([t is not None for t in texts], pa.bool_())
            own[text_at] = pc.if_else(changed, pa.array(texts, own[text_at].type), own[text_at])
            if chars_at is not None:
                own[chars_at] = pc.if_else(changed, pa.array([None if t is None else len(t) for t in texts], own[chars_at].type), own[chars_at])
            yield pa.RecordBatch.from_arrays(own, names).filter(pa.array(kept, pa.bool_()))

    own = docs.toDF(*names).withColumn("host", F.coalesce(F.col(names[docs.columns.index(host)]).cast("string"), F.lit("\0")))
    if few:
        own = own.withColumn("lines", F.lit(None).cast("array<long>"))
    else:
        own = _with_their_lines(own, over, names[text_at])
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema, strict=True)])
    return own.select(*names, "host", "lines").mapInArrow(freed(judge), renamed).toDF(*docs.columns)


def _with_their_lines(own: DataFrame, over: DataFrame, text: str) -> DataFrame:
    """own with the hashes of those of its lines that are over the limits, from a join by line: no host's list is gathered."""
    own = stored(own.withColumn("row", F.monotonically_increasing_id()))
    schema = "host string, row long, lines array<long>"
    has = own.select("host", "row", utf8(text).alias("text")).mapInArrow(freed(_line_hashes), schema).select("row", "host", F.explode("lines").alias("line"))
    removed = has.join(over, ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("lines"))
    return own.join(removed, "row", "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() AS array<bigint>)")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from timespan.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents")).drop("content", "host", "removed_lines")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, chr(0)) AS host FROM documents),
     w AS (SELECT doc_id, body, host, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM d),
     g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM w, range(1, 100000) r(i) WHERE i + 7 <= len(w)),
     again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
     rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) s(k) GROUP BY doc_id),
     l AS (SELECT doc_id, host, body, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
           FROM (SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
     u AS (SELECT doc_id, host, body, array_to_string(lw, ' ') AS line, sum(len(lw)) AS n FROM l GROUP BY ALL),
     hosts AS (SELECT host, count(DISTINCT body) AS host_docs FROM d GROUP BY host),
     over_limit AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT body) AS line_docs FROM u GROUP BY host, line) JOIN hosts USING (host) WHERE line_docs > 50 AND line_docs > 0.001 * host_docs),
     kept_lines AS (SELECT u.doc_id, count(*) AS n_lines, count(o.line) AS n_removed_lines, coalesce(sum(n) FILTER (o.line IS NULL), 0) AS n_left_words, FROM u LEFT JOIN over_limit o USING (host, line) GROUP BY u.doc_id),
     f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT f.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_left_words, 0)::BIGINT AS n_left_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (coalesce(n_removed_lines, 0) = 0 OR n_left_words >= 20) AS kept
FROM f LEFT JOIN kept_lines USING (doc_id)
"""
