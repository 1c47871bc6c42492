"""Best-fit packing (operator 9): documents into sequences of at most 2,048 tokens by best-fit decreasing.

Every task tokenises the documents it reads and returns lengths and check sums only. Which bin a piece goes to
depends on lengths alone, so best-fit decreasing over all documents is planned from the histogram of lengths, at
most `capacity` numbers however large the corpus is. The plan works on runs of bins with equal remaining capacity,
and a segment tree over remaining capacities finds the tightest open bin in logarithmic time. Spark then ranks the
pieces of each length (salted, so that a length with a third of all pieces is no hot group), and a piece's rank
gives its sequence and offset by arithmetic. The result is that of best-fit decreasing run over all pieces at once.

Defined results: a null or empty text is a document of its end id alone; repeated rows and null doc_ids are packed
row by row; ties between pieces of one length go by doc_id and piece; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timespan.llm.common import LOWER, freed, partitions, single_thread, stored, table, utf8

CAPACITY = 2048
#: Plan rows up to which the plan is broadcast (48 bytes each); beyond it, it is joined by shuffle.
PLAN_ROWS = 300_000
#: Plan rows of a length that a piece is compared with, about.
SLICE_ROWS = 16

#: Runs of ASCII or Latin-1 letters, runs of ASCII punctuation, ASCII digits, or anything else. The tokenizer splits at these borders itself.
_PARTS = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++(?=[!-&(-@\[-`{-~]|$)|[!-&(-/:-@\[-`{-~]+(?=[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|$)|[0-9](?=[!-~]|$)|.+$", re.S)

_PLAIN = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++|[!-&(-/:-@\[-`{-~]+|[0-9]")
#: Bytes of a part up to which the faster library merges it.
SHORT = 200
#: The byte-level alphabet: bytes that aren't printable in Latin-1 stand as the characters from 256 on.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


#: By the number of ids.
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _packed(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)


class Recent(dict):
    """What was looked up lately, made by `make`: between `limit` and 2 * `limit` entries when full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Ids:
    """Token ids of white-space separated chunks, as little-endian bytes.

    Chunks and their parts are kept for a task, about 200 bytes each. Plain parts are merged in a faster library, if the tokenizer's merges are in the order of their ids.
    """

    def __init__(self, path: str, chunks: int = 200_000, parts: int = 300_000):
        single_thread()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_text, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.parts = Recent(self.part, parts)
        self.chunks = Recent(self.chunk, chunks)
        self.ranked = self._ranked(path, tokenizer)

    @staticmethod
    def _ranked(path: str, tokenizer):
        """The faster library's encoding of a word in UTF-8 with a space behind it, which stands for the mark of a word's end; None if it wouldn't give the same ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary.get(x + y) for x, y in merges]
        chars = {chr(c): b for b, c in _BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in _BYTE_CHARS}
        single = [vocabulary.get(c + end) for end in ("", mark or "") for c in chars]
        if not mark or None in ids + single or ids != sorted(ids) or ids[:1] <= [max(single)]:
            return None
        special = set(tokenizer.get_added_tokens_decoder())
        ranks = {bytes(chars[c] for c in t.removesuffix(mark)) + b" " * t.endswith(mark): n for t, n in vocabulary.items() if n not in special}
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def forget(self) -> None:
        self.parts.forget()
        self.chunks.forget()

    def encode(self, chunk: bytes) -> bytes:
        return _packed(self.encode_text(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def part(self, part: bytes) -> bytes:
        if part.isalpha() or _PLAIN.fullmatch(part):  # one word to the tokenizer already: only its merges are left to do
            if self.ranked is not None and len(part) <= SHORT:
                return _packed(self.ranked(part + b" "))
            text = part.decode("ascii") if part.isascii() else part.decode("latin-1").translate(_BYTE_CHARS)
            return _packed([t.id for t in self.merge(text)])
        return self.encode(part)

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and self.ranked is not None and len(chunk) <= SHORT:  # ASCII letters
            return _packed(self.ranked(chunk.lower() + b" "))
        if b"'" in chunk or b"<|" in chunk:  # an apostrophe joins with what follows it, and a special token is one only as it is written
            return self.encode(chunk)
        parts = _PARTS.findall(chunk.translate(LOWER))
        return self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[x] for x in parts])

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))


_IDS: dict[str, Ids] = {}


def ids_of(path: str | None) -> Ids:
    """The worker's tokenizer, loaded once. path: None is the public vocabulary that is installed."""
    if path not in _IDS:
        if path is None:
            import public_tokenizers

            _IDS[path] = Ids(public_tokenizers.path("word_bpe_49k.json"))
        else:
            _IDS[path] = Ids(path)
    return _IDS[path]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and its end id, cut only where longer than capacity."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        try:
            for batch in batches:
                rows: list[tuple[int, int, int, int, int]] = []
                for at, cell in enumerate(batch.column(1)):
                    own = ids.text(cell.as_py()) + end
                    for piece, start in enumerate(range(0, len(own) // 4, capacity)):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((at, piece, start, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(x, k) for x, k in zip(columns[1:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:  # Spark uses a worker for many tasks, of other stages too
            ids.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(freed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """A segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that holds length."""
        at = self.size + length
        while not self.open[at]:
            while at & 1:  # a right child: nothing to its right here
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces. Rows (length, first rank, end rank, pieces a bin, first bin, first offset)."""
    tree, runs, plan, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            tree.add(remaining, n)
            runs[remaining].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[remaining].pop()
                tree.add(remaining, -n)
            each = remaining // length  # a bin that was just used stays the tightest until it holds no more
            placed = min(left, each * n)
            plan.append((length, rank, rank + placed, each, first, capacity - remaining))
            full, rest = divmod(placed, each)
            leave(remaining - each * length, first, full)
            if rest:
                leave(remaining - rest * length, first + full, 1)
            leave(remaining, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return plan


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    salts = 4 * partitions(spark)
    pieces = stored(token_pieces(docs, capacity, end_id, tokenizer).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = stored(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(histogram, capacity)
    # a piece meets the plan rows of its length and of its slice of ranks only, SLICE_ROWS of them about
    slices = {length: max(1, -(-n // SLICE_ROWS)) for length, n in Counter(row[0] for row in plan).items()}
    width = {length: -(-histogram[length] // n) for length, n in slices.items()}
    rows = [(*row, width[row[0]], part) for row in plan for part in range(row[1] // width[row[0]], (row[2] - 1) // width[row[0]] + 1)]
    planned = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, each long, bin long, place long, width long, part long")
    widths = spark.createDataFrame(list(width.items()), "length long, width long")  # at most `capacity` rows
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).join(F.broadcast(widths), "length").withColumn("rank", F.col("before") + F.col("own"))
    ranked = ranked.withColumn("part", F.floor(F.col("rank") / F.col("width"))).drop("width")
    at = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(planned) if len(rows) <= PLAN_ROWS else planned, ["length", "part"])
        .filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"))
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
