"""Merkle dataset manifest (operator 11) over concatenated-level strings.

A document's leaf is the SHA-256 of its length-prefixed fields. The leaves of a source, in the order of doc_id, are cut
into aligned blocks of ARITY ** BLOCK_LEVELS. A block keeps each level of its part of the tree as one string of hex
digests: parents are hashes of its fixed-width substrings, a node's siblings are the substrings that flank it in its
run, and what is left of a block is a node of the next tier, whose blocks are built alike. The subroots of the sources
are the leaves of one more such tree.

Aligned blocks depend on nothing outside them, so a source with a third of all documents is as many groups as it has
blocks; a group never has more than a block's rows. Places come from ranges of (source, doc_id). Proofs are handed
down tier by tier, a block's path once for the block.

Defined results: null fields are `-`; rows with equal doc_ids are ordered by leaf, null doc_ids come first; a lone leaf
is its subroot, a lone subroot the root; a tree of one document has the proof of no siblings; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import crc32_sql, ranked, small, stored, table

ARITY, DIGEST = 3, 64
#: Levels of a block: 729 leaves, 46 KB as a string.
BLOCK_LEVELS = 6
#: Paths of blocks, of up to 3 KB each, up to which they are broadcast.
HEADS = 20_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, in order: `-` if null, else their UTF-8 byte count, `:` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _parents(level: Column, arity: int) -> Column:
    """The level above a level: the hashes of its runs, concatenated. Levels are binary, so substrings are found at once."""
    width = arity * DIGEST
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda k: F.sha2(F.substr(level, k * width + 1, F.lit(width)), 256)), "").cast("binary")


def _tier(nodes: DataFrame, arity: int, levels: int) -> tuple[DataFrame, bool]:
    """Blocks of nodes (tree, rank, digest, held): tree, block, items, levels, root; and whether a tree has several."""
    size = arity**levels
    several = stored(nodes.filter(F.col("rank") == size).select(F.col("tree").alias("more_tree"), F.lit(0).cast("long").alias("more_block")))
    blocks = nodes.groupBy("tree", F.floor(F.col("rank") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "held"))).alias("items"))
    blocks = blocks.join(small(several), (F.col("tree") == F.col("more_tree")) & (F.col("block") == F.col("more_block")), "left")  # one row per tree
    alone = (F.col("block") == 0) & F.col("more_tree").isNull()

    def up(own: Column, _: Column) -> Column:
        top = F.element_at(own, -1)
        return F.when(alone & (F.octet_length(top) == DIGEST), own).otherwise(F.concat(own, F.array(_parents(top, arity))))

    start = F.array(F.array_join("items.digest", "").cast("binary"))
    blocks = blocks.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, up))
    return stored(blocks.select("tree", "block", "items", "levels", F.element_at("levels", -1).cast("string").alias("root"))), not several.isEmpty()


def _up(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of the trees of nodes, and tree, root of each."""
    tiers = []
    while True:
        tier, more = _tier(nodes, arity, levels)
        tiers.append(tier)
        if not more:
            return tiers, tier.select("tree", "root")
        nodes = tier.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("held"))


def _path(rank: Column, levels: Column, arity: int, size: int) -> Column:
    """The siblings to the left and right of a node's ancestors in its block, level by level."""
    width = arity * DIGEST

    def beside(level: Column, k: Column) -> Column:
        at = F.floor(rank % size / F.pow(F.lit(arity), k)).cast("int")
        run, own = F.substr(level, F.floor(at / arity).cast("int") * width + 1, F.lit(width)), at % arity * DIGEST
        left, right = F.substr(run, F.lit(1), own), F.substr(run, own + DIGEST + 1, F.lit(width))
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _down(tiers: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """rank, digest, held, path and the rest of above, of the lowest tier's nodes. above: tree, path of its root, and what goes down unchanged."""
    rest = [c for c in above.columns if c not in ("tree", "path")]
    heads = above.select(F.col("tree").alias("head_tree"), F.lit(0).cast("long").alias("head"), F.col("path").alias("above"), *rest)
    for tier in reversed(tiers):
        met = tier.drop("root").join(small(stored(heads), HEADS), (F.col("tree") == F.col("head_tree")) & (F.col("block") == F.col("head")))  # unique on both sides
        nodes = F.transform("items", lambda x: F.struct(
            x["rank"].alias("rank"), x["digest"].alias("digest"), x["held"].alias("held"),
            F.concat(_path(x["rank"], F.col("levels"), arity, arity**levels), F.col("above")).alias("path"),
        ))
        each = met.select("tree", F.explode(nodes).alias("x"), *rest).select("tree", "x.*", *rest)
        heads = each.select(F.col("tree").alias("head_tree"), F.col("rank").alias("head"), F.col("path").alias("above"), *rest)
    return each


def manifest(leaves: DataFrame, arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, held, subroot, root, path of leaves (doc_id, source, leaf, held): the manifest with every proof.

    path has the siblings to the left and right, level by level, from the leaf by its subroot to the root; held is any
    text that goes with a leaf.
    """
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # null comes first
    placed = ranked(stored(leaves.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("digest"), "held")), ["tree"], ["doc_id", "digest"])
    tiers, subroots = _up(placed.select("tree", "rank", "digest", F.struct("doc_id", "held").alias("held")), arity, levels)
    named = stored(subroots.select(F.lit("").alias("all"), F.col("tree").alias("held"), F.col("root").alias("digest")))
    upper, root = _up(ranked(named, ["all"], ["held"]).withColumnRenamed("all", "tree"), arity, levels)
    top = root.select("tree", F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("path"), "root")
    sources = _down(upper, top, arity, levels).select(F.col("held").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return _down(tiers, sources, arity, levels).select("held.doc_id", F.col("digest").alias("leaf"), "held.held", "subroot", "root", "path")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    leaves = docs.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(tampered & F.contains("text", F.lit("\n")), changed).alias("held"))
    df = manifest(leaves).withColumn("folded_root", fold(F.coalesce("held", "leaf"), F.col("path")))
    return df.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _up_sql(name: str, nodes: str) -> str:
    return f"""{name} AS (SELECT 0 AS j, tree, i, d, n FROM {nodes} UNION ALL
SELECT j + 1, tree, i // {ARITY}, sha256(string_agg(d, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY j, tree, i // {ARITY}, n)"""


def _path_sql(name: str, nodes: str, ups: str, first: str) -> str:
    """Siblings of each node of `nodes` at each step of its path."""
    side = "coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i {} x.i // {}), '')"
    power = f"({ARITY}::BIGINT ** u.j)::BIGINT"
    return f"""{name} AS (SELECT x.tree, x.i, {first} + u.j AS step, {side.format("<", power)} AS l, {side.format(">", power)} AS r
FROM {nodes} x JOIN {ups} u ON u.tree = x.tree AND u.n > 1 AND u.i // {ARITY} = x.i // ({ARITY} * {power}) GROUP BY x.tree, x.i, u.j)"""


ORACLE_SQL = f"""WITH RECURSIVE {crc32_sql("documents", "coalesce(doc_id::VARCHAR, '')", "*")},
leaves AS (SELECT *, coalesce('=' || source, '-') AS tree, {_leaf_sql("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown FROM crcs),
placed AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_up_sql("up", "placed")},
subs AS (SELECT '' AS tree, tree AS own, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
{_up_sql("over", "subs")},
{_path_sql("lower_path", "placed", "up", "0")}, {_path_sql("upper_path", "subs", "over", "1000")},
steps AS (SELECT tree, i, row_number() OVER (PARTITION BY tree, i ORDER BY step) AS step, l, r FROM (SELECT * FROM lower_path UNION ALL
SELECT p.tree, p.i, u.step, u.l, u.r FROM placed p JOIN subs s ON s.own = p.tree JOIN upper_path u ON u.i = s.i)),
proofs AS (SELECT tree, i, string_agg(l || r, '' ORDER BY step) AS proof, count(*) AS steps FROM steps GROUP BY tree, i),
folded AS (SELECT tree, i, 0 AS step, shown AS d FROM placed UNION ALL SELECT f.tree, f.i, f.step + 1, sha256(l || f.d || r) FROM folded f JOIN steps s ON s.tree = f.tree AND s.i = f.i AND s.step = f.step + 1)
SELECT doc_id, leaf, s.d AS subroot, o.d AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.d AS folded_root, f.d = o.d AS verified
FROM placed p JOIN subs s ON s.own = p.tree JOIN over o ON o.n = 1 LEFT JOIN proofs q ON q.tree = p.tree AND q.i = p.i JOIN folded f ON f.tree = p.tree AND f.i = p.i AND f.step = coalesce(q.steps, 0)"""
