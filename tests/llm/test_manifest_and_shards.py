"""The Merkle manifest and jump hashing against plain versions."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from timespan.llm import merkle, sharding
from timespan.llm.common import ranked, stored

DOCS = "text string, doc_id long, source string, lang string, n_chars long, leaf string, rank string, shard string"
ODD = [
    (None, 1, None, None, None), ("", 2, None, "en", 0), ("a\nb", 6, None, "en", 3), ("a\nb", 4, "s", "en", 3), ("a\nb", 4, "s", "en", 3), ("x" * 5000 + "\n", 8, "s", None, 5001),
    ("é\n", None, "s", "fr", 2), ("é", None, "s", "fr", 2), ("lone\n", 10, "é", "en", 5), ("lone", 11, "", "en", 4),
] + [(f"text {k}\n", k, "big", "de", 7 + k % 3) for k in range(100, 190)]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "l", "r", "s") for r in rows], DOCS)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and the siblings of each leaf, by whole levels."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for p, k in zip(paths, at, strict=True):
            run = k - k % 3
            p.append((level[run:k], level[k + 1 : run + 3]))
        level, at = [h(*level[k : k + 3]) for k in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def expected(rows):
    sources = defaultdict(list)
    for text, doc_id, source, lang, n_chars in rows:
        sources[source].append(((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text)), (doc_id, source, lang, n_chars, text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[0][2] for x in sorted(sources[s], key=lambda x: x[0])]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (order, fields), below in zip(sorted(sources[s], key=lambda x: x[0]), trees[s][1], strict=True):
            doc_id, text = fields[0], fields[4]
            changed = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            own = leaf(*fields[:4], text.replace("\n", "") if changed else text)
            for left, right in below + above:
                own = h(*left, own, *right)
            proof = h(*(d for left, right in below + above for d in left + right))
            out.append((doc_id, order[2], trees[s][0], root, proof, own, own == root))
    return sorted(out, key=str)


def manifest_of(spark, rows, **how):
    docs = documents(spark, rows)
    fields = [F.col(c) for c in merkle.FIELDS]
    other = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    held = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.leaf(other))
    df = merkle.manifest(docs.select("doc_id", "source", merkle.leaf(fields).alias("leaf"), held.alias("held")), **how)
    folded = merkle.fold(F.coalesce("held", "leaf"), F.col("path"))
    return df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), folded.alias("f"), (folded == F.col("root")).alias("v"))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_of_odd_rows(spark, levels):
    """Blocks of 3, 9 and 729 leaves: five tiers, three and one."""
    assert sorted(map(tuple, manifest_of(spark, ODD, levels=levels).collect()), key=str) == expected(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_trees_of_all_sizes(spark, n):
    rows = [(f"{k}\n", k, "s", "en", 1) for k in range(n)]
    assert sorted(map(tuple, manifest_of(spark, rows, levels=1).collect()), key=str) == expected(rows)


def test_query_on_the_given_documents(spark, sf_dir):
    rows = [(r.text, r.doc_id, r.source, r.lang, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = merkle.op11_merkle_manifest(spark, sf_dir).select(*"doc_id leaf subroot root proof_sha256 folded_root verified".split())
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_empty_tables(spark):
    assert manifest_of(spark, []).count() == 0
    assert sharding.placed(documents(spark, [])).count() == 0


def plain_jump(key, shards):
    state, at, reached = key % (1 << 64), -1, 0
    while reached < shards:
        at = reached
        state = (state * sharding.MULTIPLIER + 1) % (1 << 64)
        reached = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def test_jump():
    keys = np.array([0, 1, -1, 7, 50, 2**63 - 1, -(2**63), *range(1000, 1200)])
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_growth_moves_only_into_the_new_shard_and_sizes_are_near():
    keys = np.arange(50_000) * 50
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new]) == {8} and abs((old != new).mean() - 1 / 9) < 0.01
    assert np.ptp(np.bincount(old)) < 0.05 * len(keys) / 8


def test_places_of_odd_rows(spark):
    rows = [*ODD, *[("same", 77, "s", "en", 4)] * 30, *[("same", None, "s", "en", 4)] * 30]
    found = sharding.placed(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    want = sorted(((doc_id or 0, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for text, doc_id, *_ in rows))
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        assert (r["shard"], r.grown_shard) == (plain_jump(r.doc_id or 0, 8), plain_jump(r.doc_id or 0, 9))
        slots[r["shard"]].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.text_crc32)))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)


def test_written_shards_and_moves(spark, tmp_path):
    docs = spark.createDataFrame([(f"t{k}", k) for k in range(200)], "text string, doc_id long")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r["shard"]) for r in back.collect()) == [(k, f"t{k}", plain_jump(k, 4)) for k in range(200)]
    moved = sharding.moves(docs.select("doc_id"), 4, 6).collect()
    assert {(r.key, r.from_shard, r.to_shard) for r in moved} == {(k, plain_jump(k, 4), plain_jump(k, 6)) for k in range(200) if plain_jump(k, 4) != plain_jump(k, 6)}


def test_ranks_of_a_hot_group(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else None, k % 7) for k in range(2000)], "g string, o long")
    found = ranked(stored(rows.repartition(4)), ["g"], ["o"]).collect()
    for g in ("hot", None):
        own = sorted((r["rank"], r.o) for r in found if r.g == g)
        assert [r for r, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
