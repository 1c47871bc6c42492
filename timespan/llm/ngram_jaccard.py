"""N-gram Jaccard join (operator 4) with token-combination prefixes.

A document's set is its distinct five-word shingles (64-bit hashes). Two sets x, y with 100 * |x & y| >= 80 * |x | y|
and n = |x| satisfy 5a + 4b <= n, where a tokens of x are missing in y and b tokens of y in x. All sets are ordered by
one global order: rare tokens first, frequent tokens last, each class by hash. A prefix is extended until every
allowed (a, b) leaves an index key in common:

* rare tokens are keys by themselves; more than n / 5 of them can't all be missing;
* where a set has no more, each rare one is a key, and the frequent tokens that follow are keyed in combinations of
  k = 2, neighbours in the order. A missing token breaks two combinations, an extra one breaks one, so with r rare
  tokens and R = n - 5r, 2 * (R div 5) + (1 if R mod 5 = 4) + 2 frequent tokens leave one whole.

Of two sets, the one whose prefix ends first has its surviving key in the other's prefix as well, whatever tokens are
called frequent; so the classes only steer speed. They come from one pass: a task reports the tokens that it meets
twice or more, and the most frequent of their sums, at most `frequent_limit`, are sent to all tasks as a bitmap.

The smaller of two similar sets misses n / 9 of its tokens at most, so it has the common keys in a shorter, inner
prefix: n / 9 + 1 rare tokens or, with b = n div 9 and r fewer rare tokens, these and 2 * (b - r) + (n - 5b) div 4 + 1
combinations. Keys that no content has in its inner prefix are dropped, and a pair counts for a key only if its smaller
set has it there. That keeps apart the documents of one template that differ in more than it allows.

A prefix that is two keys longer makes three keys common, so pairs with fewer are no candidates (sets of fewer than 20
tokens need one).

Documents with equal word sequences are one content from the start. Keys that one content alone has are dropped. Hub
rounds compare each content with the most central content of its keys (the one with most keys in common with others),
later with others of them, which connects groups of near copies without listing their pairs; they stop when few pairs
with keys in common are left between different components, and all of those are compared, in blocks of a bounded number
of contents; keys with the same first content meet in one task, which returns each pair once with the number of its keys.
Length and position filters and parity sketches (512 bits, of which no more can differ than tokens do) drop
pairs before their sets are compared. Components come from large-star and small-star steps.

Defined results: texts without words, null texts among them, have an empty set and are linked with nothing (each is
its own component, also when repeated); fewer than five words are one shingle; equal sets are linked; the smallest
doc_id ignores nulls; repeated rows are linked and keep a row each; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timespan.llm.common import LOWER, SMALL_ROWS, counted, freed, hashes, small, stored, table, utf8, without

SHINGLE = 5
#: Tokens called frequent: how many at most, the least count, and the bitmap's bits as a power of two (8 MB).
FREQUENT_LIMIT, FREQUENT_COUNT, FREQUENT_BITS = 4_000_000, 8, 26

#: Prefixes of sets of LONG tokens or more are extended until similar sets have COMMON keys in common.
COMMON, LONG = 3, 20


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of n-word windows; of the whole if there are fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes(words)
    size = max(1, len(ids) - n + 1)
    rolling = np.full(size, len(words) if len(words) < n else n, np.uint64)
    for k in range(min(n, len(ids))):
        rolling = (rolling ^ ids[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        rolling ^= rolling >> np.uint64(32)
    return counted(rolling)[0]


def common_keys(n: int) -> int:
    """Keys that a set of n tokens has in common, at least, with any set that is similar and has as many or more."""
    return COMMON if n >= LONG else 1


def is_frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the token's bit is set in a bitmap of 64-bit words (a power of two of them; none: no token is frequent)."""
    if not len(bitmap):
        return np.zeros(len(tokens), bool)
    bit = tokens >> np.uint64(64 - (len(bitmap) * 64 - 1).bit_length())
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def signature(tokens: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, int]:
    """Index keys of a sorted set in the global order, and how many of them, the first ones, are its inner prefix.

    A key's place is that of its (first) token in the global order.
    """
    n = len(tokens)
    if n < 4:  # different sets of three tokens or fewer can't be similar enough; equal ones need one key in common
        return tokens[:1], min(n, 1)
    often = is_frequent(tokens, bitmap)
    more = common_keys(n) - 1
    rare = tokens[~often][: n // 5 + 1 + more]
    inner = min(len(rare), n // 9 + 1 + more)
    if len(rare) == n // 5 + 1 + more:
        return rare, inner
    gone = max(0, len(rare) - more)  # rare tokens that are missing in the other set, at least, if fewer than more + 1 are common
    left = n - 5 * gone
    last = tokens[often][: 2 * (left // 5) + (left % 5 == 4) + 2 + more]
    pairs = (last[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ last[1:] ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    least = n // 9
    if inner == len(rare) and gone <= least:
        inner += min(len(pairs), 2 * (least - gone) + (n - 5 * least) // 4 + 1 + more)
    return np.concatenate([rare, pairs]), inner


#: Bits of a set's parity sketch.
SKETCH = 512


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of SKETCH residues of the hashes, whether an odd number of tokens has it: as many bits of two sets differ as tokens do, at most."""
    odd = np.bincount(((tokens >> np.uint64(33)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


#: Rows in which a task looks for what it meets again, however many batches they come in.
MET_ROWS = 10_000


def _met_again(batches: Iterator[pa.RecordBatch], rows: int = MET_ROWS) -> Iterator[pa.RecordBatch]:
    """token, n: the tokens of two or more different texts of `rows` rows. At most two copies of their tokens are held."""

    def found(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate([np.empty(0, np.uint64), *sets])
        sets.clear()
        tokens.sort()
        again, n = counted(tokens[1:][tokens[1:] == tokens[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(n + 1)], ["token", "n"])

    sets, seen, held = [], set(), 0
    for batch in (x.slice(at, rows) for x in batches for at in range(0, len(x), rows)):
        if held and held + len(batch) > rows:
            yield found(sets)
            seen, held = set(), 0
        for cell in batch.column(0).unique():
            text = cell.as_py()
            if (digest := xxhash.xxh3_128_digest(text)) not in seen:
                seen.add(digest)
                sets.append(shingles(_words_of(text)))
        held += len(batch)
    yield found(sets)


def frequent_tokens(docs: DataFrame, limit: int = FREQUENT_LIMIT, least: int = FREQUENT_COUNT) -> np.ndarray:
    """A bitmap of the tokens in many documents. Which ones it names (a few share the bit of another) changes no result."""

    found = _texts(docs).select("text").mapInArrow(freed(_met_again), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = stored(found.select(F.shiftrightunsigned("token", 64 - FREQUENT_BITS).alias("bit"), F.floor(F.log2("n")).cast("int").alias("size")))
    sizes = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}  # 64 rows at most
    from_size, listed = 64, 0
    for k in sorted(sizes, reverse=True):
        if listed + sizes[k] > limit:
            break
        from_size, listed = k, listed + sizes[k]
    words = found.filter(F.col("size") >= from_size).groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    rows = words.toArrow()  # as large as the bitmap, at most
    bitmap = np.zeros(1 << (FREQUENT_BITS - 6), np.uint64)
    bitmap[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bitmap


def _texts(docs: DataFrame) -> DataFrame:
    """key: rows that share doc_id and key have the same words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


#: Documents that one batch of signatures has.
SIGNED = 1_000


def signatures(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, key, content (128-bit hash of the words; null without words), n, inner, keys, bits of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 ** FREQUENT_BITS bits
    names = ["doc_id", "key", "content", "n", "inner", "keys", "bits"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in (x.slice(at, SIGNED) for x in batches for at in range(0, len(x), SIGNED)):
            contents, sizes, inner, keys, bits = [], [], [], [], []
            for cell in batch.column(2):
                words = _words_of(cell.as_py())
                tokens = shingles(words)
                own, first = signature(tokens, often)
                contents.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(tokens))
                inner.append(first)
                keys.append(own.view(np.int64))
                bits.append(parities(tokens))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            arrays = [pa.array(contents, pa.binary()), pa.array(sizes, pa.int64()), pa.array(inner, pa.int64()), lists, pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return _texts(docs).mapInArrow(freed(sign), "doc_id long, key long, content binary, n long, inner long, keys array<long>, bits array<long>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, salt and member, the hub's own text first: the members whose sets are similar to the hub's."""
    at, own = None, np.empty(0, np.uint64)
    for batch in batches:
        hubs, ids = [], []
        for hub, salt, member, node, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            tokens = shingles(_words_of(text.as_py()))
            if not member:
                at, own = (hub, salt), tokens
            elif at == (hub, salt):
                both = len(np.intersect1d(own, tokens, assume_unique=True))
                if 100 * both >= 80 * (len(own) + len(tokens) - both):
                    hubs.append(hub)
                    ids.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(ids, pa.int64())], ["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar. A text is read where it is stored and sent once per pair it is in."""
    pairs = stored(pairs)
    hubs = small(stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))))
    members = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("node"))
    owners = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("node"))
    wanted = members.unionByName(owners).join(nodes.select(F.col("row").alias("node"), F.col("doc_id").alias("d"), F.col("key").alias("k")), "node")
    wanted = small(stored(wanted))
    found = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("a", "salt", "member", "node", "text")
    dealt = found.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "node")
    return stored(dealt.mapInArrow(freed(_compare), "a long, b long"))


#: Edges that one task unites, at most (16 bytes each, and about 200 in its table).
FEW_EDGES = 200_000
#: Members of a hub that one task compares with it at once.
MEMBERS = 1000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the few edges (a, b) of one task, without the nodes that name their component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, component (its least node) of every other node that has an edge: in one task up to `few` edges, beyond that by large-star and small-star steps."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if edges.limit(few + 1).count() <= few:
        return stored(edges.coalesce(1).mapInArrow(_united, "node long, component long"))
    edges = stored(edges.distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        edges = stored(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = now


#: Contents that make a key hot, at least, and how many keys can be hot.
HOT_CONTENTS, HOT_KEYS = 2_000, 20_000


def _hot_keys(firsts: DataFrame) -> DataFrame:
    """at: keys in very many contents, HOT_KEYS at most. Tasks report those that they meet often; which ones are named changes no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(lists: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = counted(np.concatenate([np.empty(0, np.int64), *lists]))
            lists.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 7]), pa.array(n[n > 7].astype(np.int64))], ["at", "n"])

        lists, held = [], 0
        for batch in batches:
            if held and held + len(batch) > MET_ROWS:
                yield often(lists)
                held = 0
            lists.append(batch.column(0).flatten().to_numpy())
            held += len(batch)
        yield often(lists)

    found = firsts.select("keys").mapInArrow(freed(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_CONTENTS)
    return stored(found.orderBy(F.desc("n"), "at").limit(HOT_KEYS).select("at"))


def shared_keys(signed_rows: DataFrame, copies: DataFrame) -> DataFrame:
    """at, id, n, place, inner, hot: the keys that two contents or more have, one of them in its inner prefix.

    Keys are dealt by hash. Hot ones needn't be: that they are shared is known, so they stay in their tasks.
    """
    firsts = signed_rows.filter("content IS NOT NULL").join(small(copies), "row", "left_anti")
    hot = _hot_keys(firsts)
    index = firsts.select(F.col("row").alias("id"), "n", "inner", F.posexplode("keys").alias("place", "at"))
    packed = (F.shiftleft("n", 32) + F.shiftleft(F.col("place").cast("long"), 1) + (F.col("place") < F.col("inner")).cast("long")).alias("packed")
    index = index.select("at", "id", packed)
    own = Window.partitionBy("at")
    inner = F.col("packed") % 2
    cold = index.join(F.broadcast(hot), "at", "left_anti").withColumn("low", F.min("id").over(own)).withColumn("high", F.max("id").over(own)).withColumn("any", F.max(inner).over(own))
    cold = cold.filter("low < high AND any = 1").select("at", "id", "packed", F.lit(False).alias("hot"))
    shared = cold.unionByName(index.join(F.broadcast(hot), "at").withColumn("hot", F.lit(True)))
    place = F.shiftright("packed", 1).bitwiseAND(F.lit((1 << 31) - 1))
    return shared.select("at", "id", F.shiftright("packed", 32).alias("n"), place.alias("place"), (inner == 1).alias("inner"), "hot")


def similar_documents(docs: DataFrame, frequent_limit: int = FREQUENT_LIMIT) -> DataFrame:
    """One row per document: row, doc_id, key, n_shingles, group (null without words) and component_id."""
    signed_rows = stored(signatures(docs, frequent_tokens(docs, frequent_limit)).withColumn("row", F.monotonically_increasing_id()))
    repeated = signed_rows.filter("content IS NOT NULL").groupBy("content").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    repeated = small(stored(repeated.select("content", "first")), SMALL_ROWS // 2)
    plain = signed_rows.select("row", "doc_id", "key", "n", "content")
    # contents that one row has need no partner, so only repeated ones meet; Spark splits those that are large
    nodes = stored(plain.join(repeated, "content", "left").select("row", "doc_id", "key", "n", F.when(F.col("content").isNotNull(), F.coalesce("first", "row")).alias("id")))
    shared = shared_keys(signed_rows, nodes.filter("row <> id").select("row"))
    # the more of its keys others have, the more central a content is in its group; with fewer than COMMON it is similar to none that has LONG tokens
    shared = shared.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("id")))
    shared = stored(shared.filter((F.col("ties") >= COMMON) | (4 * F.col("n") < 5 * LONG)))
    sketches = signed_rows.select(F.col("row").alias("id"), "n", "bits")
    rows, groups, done, turn = shared.count(), None, None, 0
    while True:
        open_rows, most = _open_rows(shared, groups)
        if not most or turn and most <= rows or turn == HUB_ROUNDS:
            break
        pairs = _alike_pairs(_hub_pairs(open_rows, turn), sketches)
        pairs = stored(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        links = verified(docs, pairs, nodes)
        groups = components(links if groups is None else links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        turn += 1
    if most:
        pairs = stored(_all_pairs(open_rows, sketches).join(done, ["a", "b"], "left_anti").join(done.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            links = verified(docs, pairs, nodes)
            groups = components(links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    if groups is None:  # no two contents have keys in common
        grouped = nodes.withColumn("group", F.col("id"))
    else:
        grouped = nodes.join(small(groups.withColumnRenamed("node", "id")), "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = grouped.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return grouped.join(small(stored(least.select("group", "least"))), "group", "left").select(
        "row", "doc_id", "key", F.col("n").alias("n_shingles"), "group", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


#: Rounds that compare the contents of a key with one of them, before all pairs that are left are compared.
HUB_ROUNDS = 2
#: Contents of a key that meet at once where all its pairs are compared.
BLOCK = 2_000


def _open_rows(shared: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, int]:
    """The rows of keys whose contents are in several components yet, with those, their number and the first of them; how many pairs of them are left at most.

    Keys that aren't hot are dealt by hash once, whatever is asked of them; of hot ones only sums leave their tasks.
    """
    if groups is None:
        labelled = shared.withColumn("component", F.col("id"))
    else:
        labelled = shared.join(small(groups.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    key, inner = Window.partitionBy("at"), F.col("inner").cast("long")

    def cold(*columns: str) -> DataFrame:
        """With the pairs that a row may have as the one that has the key in its inner prefix, in its own component and in all."""
        rows = labelled.filter("NOT hot").select("at", "component", "inner", *columns)
        rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("at", "component"))).withColumn("contents", F.count(F.lit(1)).over(key))
        return rows.withColumn("left", inner * (F.col("contents") - F.col("m"))).drop("m")

    hot = labelled.filter("hot")
    own = hot.groupBy("at", "component").agg(F.count(F.lit(1)).alias("m"), F.sum(inner).alias("i"), F.min("id").alias("first"))
    mixed = own.groupBy("at").agg(F.min("first").alias("first"), *(F.sum(x).alias(c) for x, c in ((F.col("m"), "all"), (F.col("i"), "inside"), (F.col("m") * F.col("i"), "within"))))
    mixed = stored(mixed.withColumn("left", F.col("all") * F.col("inside") - F.col("within")).filter("left > 0").select("at", F.col("all").alias("contents"), "first", "left"))
    most = sum(x.agg(F.sum("left")).first()[0] or 0 for x in (mixed, cold()))
    columns = ["at", "id", "n", "place", "inner", "ties", "component", "contents", "first"]
    rows = cold("id", "n", "place", "ties").withColumn("first", F.min("id").over(key)).withColumn("left", F.sum("left").over(key)).filter("left > 0")
    hot = hot.join(F.broadcast(mixed.drop("left")), "at")  # HOT_KEYS at most
    return rows.select(*columns, F.lit(False).alias("hot")).unionByName(hot.select(*columns, F.lit(True).alias("hot"))), int(most)


def _near(n1: str, place1: str, inner1: str, n2: str, place2: str, inner2: str):
    """Length, position and prefix filters of two sets that have a key in common at these places."""
    overlap = F.least(place1, place2) + F.least(F.col(n1) - F.col(place1), F.col(n2) - F.col(place2))
    inside = (F.col(inner1) & (F.col(n1) <= F.col(n2))) | (F.col(inner2) & (F.col(n2) <= F.col(n1)))
    return inside & (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * overlap >= 4 * (F.col(n1) + F.col(n2)))


def _enough(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows that have as many keys in common as similar sets of their sizes have."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"), F.min(F.least("n1", "n2")).alias("n"))
    return counted.filter((F.col("keys") >= COMMON) | (F.col("n") < LONG)).select("a", "b")


def _hub_pairs(open_rows: DataFrame, turn: int) -> DataFrame:
    """Each content of a key with the key's hub: the most central content at first, one chosen by hash later."""
    order = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 44)) + (F.shiftleft(F.col("ties").cast("long"), 44) if not turn else F.lit(0))
    rows = open_rows.withColumn("order", order)
    of_hub = {"a": "id", "n1": "n", "place1": "place", "inner1": "inner", "component1": "component"}
    hubs = rows.filter("hot").groupBy("at").agg(*(F.max_by(c, "order").alias(name) for name, c in of_hub.items()))  # HOT_KEYS at most
    hot = rows.filter("hot").join(F.broadcast(stored(hubs)), "at")
    cold = rows.filter("NOT hot").select("*", *(F.max_by(c, "order").over(Window.partitionBy("at")).alias(name) for name, c in of_hub.items()))
    pairs = hot.unionByName(cold).filter((F.col("component") != F.col("component1")) & _near("n1", "place1", "inner1", "n", "place", "inner"))
    return _enough(pairs.select("a", F.col("id").alias("b"), "n1", F.col("n").alias("n2")))


def _alike(n1: str, n2: str, bits1: str, bits2: str):
    """No more bits differ than tokens can in similar sets: a ninth of both sizes."""
    differ = sum((F.bit_count(F.col(bits1)[k].bitwiseXOR(F.col(bits2)[k])) for k in range(SKETCH // 64)), F.lit(0))
    return 9 * differ <= F.col(n1) + F.col(n2)


def _alike_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    pairs = small(stored(pairs))
    for k, name in ((1, "a"), (2, "b")):
        pairs = sketches.select(F.col("id").alias(name), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")).join(pairs, name)
    return pairs.filter(_alike("n1", "n2", "bits1", "bits2")).select("a", "b")


#: Pairs that a task keeps before it counts them.
PENDING = 500_000


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by home, i, j and at: the pairs of a key's rows that the filters let through, with the number of keys that did.

    A pair has most of its keys in one home, so it leaves a task once or a few times, and not once for every key.
    """
    names = ["home", "i", "j", "at", "side", "id", "n", "place", "inner", "component"]
    found, size = [], 0

    def pairs_of(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
        _, i, j, _, side, ids, n, place, inner, component, bits = rows
        first = np.flatnonzero(starts(rows))
        end = np.repeat(np.append(first[1:], len(ids)), np.diff(first, append=len(ids)))
        x, step = np.arange(len(ids)), 1
        while True:
            x = x[end[x] > x + step]
            if not len(x):
                return
            y = x + step
            step += 1
            new = (component[x] != component[y]) & (ids[x] != ids[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
            p, q = x[new], y[new]
            overlap = np.minimum(place[p], place[q]) + np.minimum(n[p] - place[p], n[q] - place[q])
            inside = (inner[p] & (n[p] <= n[q])) | (inner[q] & (n[q] <= n[p]))
            near = inside & (5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q])) & (9 * overlap >= 4 * (n[p] + n[q]))
            p, q = p[near], q[near]
            alike = 9 * np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= n[p] + n[q]
            p, q = p[alike], q[alike]
            if len(p):
                yield np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), np.ones(len(p), np.int64), np.minimum(n[p], n[q])])

    def starts(rows: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0)
        return new

    def summed() -> np.ndarray:
        a, b, keys, n = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b, keys, n = a[order], b[order], keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return np.stack([a[new], b[new], np.add.reduceat(keys, new), n[new]])

    def sent(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in total], ["a", "b", "keys", "n"])

    rest: list[np.ndarray] | None = None
    for batch in _and_none(batches):
        if batch is None:
            rows, rest = rest, None
        else:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rows.append(batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64))
            rows = [np.concatenate(c) for c in zip(rest, rows, strict=True)] if rest is not None else rows
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero(starts(rows))[-1])  # the last key may go on in the next batch
            rest, rows = [c[last:] for c in rows], [c[:last] for c in rows]
        if rows is None or not len(rows[0]):
            continue
        for part in pairs_of(rows):
            found.append(part)
            size += part.shape[1]
            if size > PENDING:
                total = summed()
                found, size = [total], total.shape[1]
                if size > PENDING // 2:
                    yield sent(total)
                    found, size = [], 0
    if found:
        yield sent(summed())


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _all_pairs(open_rows: DataFrame, sketches: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of contents with keys in common and in different components that the filters let through.

    Keys with the same first content are at home in one task, as long as they have few contents; more share a home less.
    A key's contents are dealt into blocks of `block`; each two blocks meet in a group of their own.
    """
    shares = F.ceil(F.col("contents") * F.col("contents") / (1 << 14))
    blocks = F.ceil(F.col("contents") / block).cast("int")
    rows = open_rows.select("at", "id", "n", "place", "inner", "component", F.xxhash64("first", F.pmod(F.xxhash64("at"), shares)).alias("home"), blocks.alias("blocks"))
    rows = rows.join(sketches.select("id", "bits"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = (F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).alias("side"))
    rows = rows.select("home", "at", "id", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "inner", "component", "bits", *places)
    rows = rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "at")
    pairs = rows.mapInArrow(freed(_counted_pairs), "a long, b long, keys long, n long").groupBy("a", "b").agg(F.sum("keys").alias("keys"), F.min("n").alias("n"))
    return pairs.filter((F.col("keys") >= COMMON) | (F.col("n") < LONG)).select("a", "b")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked with another of a smaller doc_id (nulls last); columns stay, whatever their names."""
    rows = stored(similar_documents(docs).filter("group IS NOT NULL").select("row", "doc_id", "key", "group"))
    least = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    least = small(stored(least.select("group", F.col("first.row").alias("first"))))
    judged = stored(rows.join(least, "group").select("doc_id", "key", (F.col("row") == F.col("first")).alias("stays")))
    judged = stored(judged.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows")))
    content = F.xxhash64(utf8())
    kept = without(docs, judged.filter("NOT stays OR rows > 1").select("doc_id", "key"), content)
    repeated = judged.filter("stays AND rows > 1")  # rows that are equal in doc_id and text: one of them stays
    if not repeated.isEmpty():
        keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("d"), content.alias("c"))
        wanted = small(stored(repeated.select(F.col("doc_id").alias("d2"), F.col("key").alias("c2"))))
        again = keyed.join(wanted, F.col("d").eqNullSafe(F.col("d2")) & (F.col("c") == F.col("c2")), "left_semi")
        kept = kept.unionByName(again.groupBy("d", "c").agg(F.first("doc").alias("doc")).select("doc.*"))
    return kept


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g, least(len(w), 5) AS k FROM w, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 4)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     both_sets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM both_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
