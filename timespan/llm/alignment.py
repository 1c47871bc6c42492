"""Cross-tokenizer alignment (operator 12): where the tokens of two tokenizers end together.

Tokenizer A is a byte-level BPE that gets a space and the text, B a sentencepiece BPE that gets the text and puts the
space before it itself. Byte offsets at which tokens of both end cut the tokens into groups.

A document up to CHUNK bytes is read by one task. A longer one is cut into byte ranges, which go to different tasks; a
range owns the tokens that end in it. What a range yields is a fragment: the open prefix (tokens up to its first common
end), the closed groups, and the open suffix (tokens after its last one). Fragments compose associatively: a suffix and
the prefix behind it are one group. So a tree reduction over neighbours, FAN at a time, gives the document's groups,
whatever the borders. Links are pairs of tokens with the same end, so each is found within one fragment.

Neither tokenizer joins anything across a space that follows a character other than white space: A splits there
before it merges, and no piece of B's vocabulary has its space mark behind another character (this is checked as it is
loaded). So a byte range needs no more around it than the stretches between such spaces that its ends cut. A border is
moved on where there is no such space within REACH bytes; to both tokenizers what has none is one word, however long.

Pair counts are summed by pair with partial sums. To bring them back, pairs in many documents (at most HOT_PAIRS of
them can have a HOT_PAIRS-th of all rows) are broadcast and the others joined by shuffle, so no pair is a hot key.

Defined results: null and empty texts, and those whose tokens don't give their bytes back, have no tokens and count
nowhere; repeated rows count as often as they come; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import SMALL_ROWS, partitions, shared_dir, single_thread, small, stored, table
from timespan.llm.warc import remove

#: Bytes of a text that one task reads, and bytes around a border in which both its stretches must end.
CHUNK, REACH = 32_768, 4_096
#: Fragments that one step of the tree composes.
FAN = 8
HOT_PAIRS = 100_000
#: Documents whose groups and links a task holds at once.
ROWS = 200
#: A pair of ids as one number: A's id times this plus B's.
PAIR = 1 << 32
#: B's mark of a space. Fixed value.
SPACE = "▁"

#: A space behind a character that isn't white space, in UTF-8.
#: Texts of which both libraries for A find the same words: ASCII but for control characters, and Latin-1 letters.
_PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]+")
_BYTE_BORDER = re.compile(
    rb" (?<=[!-~\x80-\xbf] )(?<!\xc2[\x85\xa0] )(?<!\xe1\x9a\x80 )(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf] )(?<!\xe2\x81\x9f )(?<!\xe3\x80\x80 )"
)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both of the tokens that end together."""
    at = np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b_ends) - 1))
    a_last = np.flatnonzero(b_ends[at] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    return a_last, at[a_last]


def written(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


@dataclass
class Fragment:
    """What a byte range yields. cut: it has a common end; without one, all its tokens are in the prefix."""

    cut: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    closed: list[str] = field(default_factory=list)
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))

    def __add__(self, other: Fragment) -> Fragment:
        if not self.cut:
            return Fragment(other.cut, _joined(self.prefix, other.prefix), other.closed, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.closed, _joined(self.suffix, other.prefix))
        return Fragment(True, self.prefix, [*self.closed, written(*_joined(self.suffix, other.prefix)), *other.closed], other.suffix)

    def text(self) -> str:
        """The groups of a whole document."""
        return ";".join([written(*self.prefix), *self.closed] + ([written(*self.suffix)] if any(self.suffix) else []))


def _joined(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


class Aligner:
    """Both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        single_thread()
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = {n: t for t, n in self.a.get_vocab().items()}
        self.a_bytes = [bytes(chars.get(c, 0) for c in vocabulary.get(n, "")) for n in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        if any(y == SPACE and x != SPACE for p in pieces for x, y in zip(p, p[1:], strict=False)):
            raise ValueError("a piece has a space behind another character: stretches can't be tokenised by themselves")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        names = [str(n) for n in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = {mark: np.array([n + mark for n in names], object) for mark in ",|;"}
        self.plain_a = self._ranked(a_path)

    def _ranked(self, a_path: str):
        """A's encoding of plain texts by a faster library, if its merges are in the order of their ids."""
        import tiktoken
        from public_tokenizers import PATTERN

        with open(a_path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        ids = [self.a.token_to_id(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in merges]
        if None in ids or ids != sorted(ids):
            return lambda x: self.a.encode(x, add_special_tokens=False).ids
        special = set(self.a.get_added_tokens_decoder())
        ranks = {self.a_bytes[n]: n for n in self.a.get_vocab().values() if n not in special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of texts, which are given without the space before them."""
        a = [self.plain_a(" " + t) if _PLAIN.fullmatch(t) else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        return a, [own or [self.b.piece_to_id(SPACE)] for own in self.b.encode(texts, num_threads=1)]  # B puts no space before nothing

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the bytes of both are those of the text."""
        data = (" " + text).encode()
        return b"".join([self.a_bytes[n] for n in a]) == data and b"".join([self.b_bytes[n] for n in b]) == data

    def documents(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray, np.ndarray] | None]:
        """Tokens of A and B, groups, linked pairs and how often each; none of empty texts and those whose bytes aren't given back."""
        found: list[tuple | None] = [None] * len(texts)
        filled = [k for k, t in enumerate(texts) if t]
        a, b = self.ids([texts[k] for k in filled])
        good = [n for n, k in enumerate(filled) if self.whole(texts[k], a[n], b[n])]
        if not good:
            return found
        # all tokens in a row: every text ends with both, so offsets agree throughout and no group lies over two texts
        a_all, b_all = (np.concatenate([np.asarray(x[n], np.int64) for n in good]) for x in (a, b))
        a_last, b_last = common_ends(np.cumsum(self.a_sizes[a_all]), np.cumsum(self.b_sizes[b_all]))
        tokens, links = self.grouped(a_all, b_all, a_last, b_last), a_all[a_last] * PAIR + b_all[b_last]
        groups, from_token, from_group = np.searchsorted(a_last, np.cumsum([len(a[n]) for n in good])), 0, 0
        for n, to_group in zip(good, groups.tolist(), strict=True):
            to_token = from_token + len(a[n]) + len(b[n])
            pairs, times = np.unique(links[from_group:to_group], return_counts=True)
            found[filled[n]] = len(a[n]), len(b[n]), "".join(tokens[from_token:to_token])[:-1], pairs, times
            from_token, from_group = to_token, to_group
        return found

    def grouped(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> list[str]:
        """The ids of closed groups as they are written, each with the mark behind it; the last tokens of both close a group."""
        own = np.arange(len(a)), np.arange(len(b))
        a_at = own[0] + np.concatenate([[0], b_last + 1])[np.searchsorted(a_last, own[0])]  # behind the tokens of B in the groups before
        b_at = own[1] + (a_last + 1)[np.searchsorted(b_last, own[1])]
        out = np.empty(len(a) + len(b), object)
        out[a_at], out[b_at] = self.written[","][a], self.written[","][b]
        out[a_at[a_last]], out[b_at[b_last]] = self.written["|"][a[a_last]], self.written[";"][b[b_last]]
        return out.tolist()

    def fragment(self, span: bytes, low: int, high: int) -> tuple[int, int, Fragment, np.ndarray, np.ndarray] | None:
        """The same of the tokens that end behind byte low and at byte high at most, of a span of whole stretches."""
        text = span.decode()[1:]
        (a,), (b,) = self.ids([text])
        if not self.whole(text, a, b):
            return None
        sides = []
        for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes)):
            ends = np.cumsum(sizes[np.asarray(ids, np.int64)])
            kept = (ends > low) & (ends <= high)
            sides.append((np.asarray(ids, np.int64)[kept], ends[kept]))
        (a, a_ends), (b, b_ends) = sides
        a_last, b_last = common_ends(a_ends, b_ends)
        pairs, times = np.unique(a[a_last] * PAIR + b[b_last], return_counts=True)
        if not len(a_last):
            return len(a), len(b), Fragment(False, (a.tolist(), b.tolist())), pairs, times
        i, j, x, y = a_last[0] + 1, b_last[0] + 1, a_last[-1] + 1, b_last[-1] + 1
        closed = ["".join(self.grouped(a[i:x], b[j:y], a_last[1:] - i, b_last[1:] - j))[:-1]] if len(a_last) > 1 else []
        return len(a), len(b), Fragment(True, (a[:i].tolist(), b[:j].tolist()), closed, (a[x:].tolist(), b[y:].tolist())), pairs, times


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """The worker's tokenizers, loaded once. None: the public vocabularies that are installed."""
    if (a_path, b_path) not in _ALIGNERS:
        import public_tokenizers as public

        _ALIGNERS[a_path, b_path] = Aligner(a_path or public.path("byte_bpe_50k.json"), b_path or public.path("piece_bpe_32k.model"))
    return _ALIGNERS[a_path, b_path]


def byte_ranges(data: bytes, chunk: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Ranges of a text in UTF-8 with its space: start, end, and the whole stretches around them."""
    borders = [(0, 0, 0)]
    for at in range(chunk, len(data), chunk):
        before = [m.start() for m in _BYTE_BORDER.finditer(data, max(0, at - reach), at + 1)]
        after = _BYTE_BORDER.search(data, max(at, 1), min(len(data), at + reach))
        if before and after:
            borders.append((at, before[-1], after.start()))
    borders.append((len(data), len(data), len(data)))
    return [(x[0], y[0], x[1], y[2]) for x, y in zip(borders, borders[1:], strict=False)]


_ROW = "key long, doc_id long, ok boolean, n_a long, n_b long, n_links long, pairs array<long>, times array<int>"
_FRAGMENT = "struct<cut: boolean, pa: array<int>, pb: array<int>, closed: array<string>, sa: array<int>, sb: array<int>>"


def _record(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LISTS = [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
_COUNTS = [("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), *_LISTS]
_KEYS = [("key", pa.int64()), ("doc_id", pa.int64())]


def _counted(found: tuple | None) -> tuple:
    """The columns of _COUNTS."""
    if found is None:
        return False, 0, 0, 0, [], []
    return True, found[0], found[1], int(found[4].sum()), found[3], found[4]


def _short(docs: DataFrame, paths: tuple[str | None, str | None]) -> DataFrame:
    """Documents (key, doc_id, text) that one task reads, with the digest of their groups."""
    schema = pa.schema([*_KEYS, *_COUNTS, ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = both.documents(batch.column(2).to_pylist())
            digests = [sha256(x[2].encode()).hexdigest() if x else "" for x in found]
            rows = zip(*map(_counted, found), strict=True)
            yield _record([batch.column(0), batch.column(1), *rows, digests], schema)

    return docs.mapInArrow(run, f"{_ROW}, groups_sha256 string")


def _ranges(docs: DataFrame, chunk: int, reach: int) -> DataFrame:
    """The byte ranges of long documents: key, doc_id, node, span, low, high."""
    schema = pa.schema([*_KEYS, ("node", pa.int64()), ("span", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (" " + text).encode()
                for node, (start, end, first, last) in enumerate(byte_ranges(data, chunk, reach)):
                    yield _record([[key], [doc_id], [node], [data[first:last]], [start - first], [end - first]], schema)

    return docs.mapInArrow(run, "key long, doc_id long, node long, span binary, low long, high long")


def _fragments(ranges: DataFrame, paths: tuple[str | None, str | None]) -> DataFrame:
    ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
    kind = pa.struct([("cut", pa.bool_()), ("pa", ints), ("pb", ints), ("closed", texts), ("sa", ints), ("sb", ints)])
    schema = pa.schema([*_KEYS, *_COUNTS, ("node", pa.int64()), ("fragment", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for batch in batches:
            for key, doc_id, node, span, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = both.fragment(span, low, high)
                f = found[2] if found else Fragment()
                own = {"cut": f.cut, "pa": f.prefix[0], "pb": f.prefix[1], "closed": f.closed, "sa": f.suffix[0], "sb": f.suffix[1]}
                yield _record([[key], [doc_id], *([x] for x in _counted(found)), [node], [own]], schema)

    return ranges.mapInArrow(run, f"{_ROW}, node long, fragment {_FRAGMENT}")


def _group(a: Column, b: Column) -> Column:
    return F.concat(F.array_join(a, ","), F.lit("|"), F.array_join(b, ","))


def _composed(x: Column, y: Column) -> Column:
    """Fragment.__add__ in columns."""
    both = x["cut"] & y["cut"]
    group = F.array(_group(F.concat(x["sa"], y["pa"]), F.concat(x["sb"], y["pb"])))

    def side(p: str, s: str) -> tuple[Column, Column]:
        prefix = F.when(x["cut"], x[p]).otherwise(F.concat(x[p], y[p]))
        return prefix, F.when(x["cut"] & ~y["cut"], F.concat(x[s], y[p])).otherwise(y[s])

    (pa_, sa), (pb, sb) = side("pa", "sa"), side("pb", "sb")
    closed = F.when(both, F.concat(x["closed"], group, y["closed"])).when(x["cut"], x["closed"]).otherwise(y["closed"])
    return F.struct((x["cut"] | y["cut"]).alias("cut"), pa_.alias("pa"), pb.alias("pb"), closed.alias("closed"), sa.alias("sa"), sb.alias("sb")).cast(_FRAGMENT)


def _reduced(fragments: DataFrame, fan: int) -> DataFrame:
    """One row per long document, by a tree over its fragments: _ROW's columns without the pairs, and the digest of its groups."""
    sums = ["n_a", "n_b", "n_links"]
    df = fragments.select("key", "doc_id", "node", "ok", *sums, "fragment")
    most = df.agg(F.max("node")).first()[0] or 0
    identity = F.expr(f"cast(named_struct('cut', false, 'pa', array(), 'pb', array(), 'closed', array(), 'sa', array(), 'sb', array()) AS {_FRAGMENT})")
    while True:  # log(fragments of the longest document) steps
        df = df.groupBy("key", F.floor(F.col("node") / fan).alias("node")).agg(
            F.first("doc_id").alias("doc_id"), F.min("ok").alias("ok"), *(F.sum(c).alias(c) for c in sums), F.sort_array(F.collect_list(F.struct("node", "fragment"))).alias("own")
        )
        df = df.withColumn("fragment", F.aggregate("own", identity, lambda s, x: _composed(s, x["fragment"]))).drop("own")
        most //= fan
        if not most:
            break
    f = F.col("fragment")
    tail = F.when((F.size(f["sa"]) > 0) | (F.size(f["sb"]) > 0), F.array(_group(f["sa"], f["sb"]))).otherwise(F.expr("cast(array() AS array<string>)"))
    text = F.array_join(F.concat(F.array(_group(f["pa"], f["pb"])), f["closed"], tail), ";")
    return df.select("key", "doc_id", "ok", *(F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in sums), F.when(F.col("ok"), F.sha2(text, 256)).otherwise("").alias("groups_sha256"))


@dataclass
class Alignment:
    """documents: key, doc_id, ok, n_a, n_b, n_links, groups_sha256; links: key, pairs, times (a document's linked pairs and how often)."""

    documents: DataFrame
    links: DataFrame


def align(docs: DataFrame, folder: str, a_tokenizer: str | None = None, b_tokenizer: str | None = None, chunk: int = CHUNK, reach: int = REACH, fan: int = FAN) -> Alignment:
    """Groups and links of all documents; what is found is written below folder, which must be shared."""
    spark, paths = docs.sparkSession, (a_tokenizer, b_tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select((F.monotonically_increasing_id() * 2).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    long = F.octet_length("text") > chunk
    _short(keyed.filter(~long), paths).write.parquet(f"{folder}/short")
    ranges = _ranges(keyed.filter(long).withColumn("key", F.col("key") + 1), chunk, reach)
    _fragments(ranges.repartition(partitions(spark), "key", "node"), paths).write.parquet(f"{folder}/fragments")
    short, fragments = spark.read.parquet(f"{folder}/short"), spark.read.parquet(f"{folder}/fragments")
    whole = stored(_reduced(fragments, fan))
    lost = small(stored(whole.filter("NOT ok").select("key")))
    return Alignment(short.drop("pairs", "times").unionByName(whole), short.select("key", "pairs", "times").unionByName(fragments.join(lost, "key", "left_anti").select("key", "pairs", "times")))


def _rows(links: DataFrame) -> DataFrame:
    return links.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def link_counts(links: DataFrame) -> DataFrame:
    """pair, count, rows, best: how often each pair is linked in all documents, and whether no pair of its B id is linked more often."""
    counts = stored(_rows(links).groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("rows")))
    b = F.col("pair") % PAIR
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # B's vocabulary at most
    return stored(counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "count", "rows", (F.col("count") == F.col("highest")).alias("best")))


def link_sums(links: DataFrame, counts: DataFrame, few: int = SMALL_ROWS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """key, n_best, count_sum of each document with links."""
    rows, known = _rows(links), counts.select("pair", "count", "best")
    if counts.limit(few + 1).count() <= few:
        met = rows.join(F.broadcast(known), "pair")
    else:
        total = counts.agg(F.sum("rows")).first()[0]
        hot = known.join(counts.filter(F.col("rows") * hot_pairs >= total).select("pair"), "pair", "left_semi")
        met = rows.join(F.broadcast(hot), "pair").unionByName(rows.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(known, "pair"))
    return met.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def cross_tokenizer_alignment(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row. how: see align()."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    found = align(docs, folder, **how)
    sums = link_sums(found.links, link_counts(found.links))
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    out = stored(found.documents.join(sums, "key", "left").select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", *filled, "groups_sha256"))
    remove(spark, folder)
    return out


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"))
