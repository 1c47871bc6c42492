"""The alignment of two tokenizers against whole texts tokenised at once and cut byte by byte."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timespan.llm import alignment as al

TEXT = st.text(st.one_of(st.sampled_from("  \n\tab'Zé。▁<|>"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def both():
    return al.aligner(None, None)


def brute(both, text):
    """n_a, n_b, groups as text, and links of a text."""
    if not text:
        return 0, 0, "", Counter()
    whole = (" " + text).encode()
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    if b"".join(both.a_bytes[n] for n in a) != whole or b"".join(both.b_bytes[n] for n in b) != whole:
        return 0, 0, "", Counter()
    a_at = {int(e): k for k, e in enumerate(np.cumsum([len(both.a_bytes[n]) for n in a]))}
    b_at = {int(e): k for k, e in enumerate(np.cumsum([len(both.b_bytes[n]) for n in b]))}
    groups, links, i, j = [], Counter(), 0, 0
    for e in sorted(set(a_at) & set(b_at)):
        groups.append(",".join(map(str, a[i : a_at[e] + 1])) + "|" + ",".join(map(str, b[j : b_at[e] + 1])))
        i, j = a_at[e] + 1, b_at[e] + 1
        links[a[i - 1] * al.PAIR + b[j - 1]] += 1
    return len(a), len(b), ";".join(groups), links


def counted(found):
    return (*found[:3], Counter(dict(zip(found[3].tolist(), found[4].tolist(), strict=True)))) if found else (0, 0, "", Counter())


def expected(both, rows):
    found = [(doc_id, *brute(both, text)) for doc_id, text in rows]
    counts = sum((x[4] for x in found), Counter())
    highest = Counter()
    for pair, n in counts.items():
        highest[pair % al.PAIR] = max(highest[pair % al.PAIR], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        best = sum(n for p, n in links.items() if counts[p] == highest[p % al.PAIR])
        n = sum(links.values())
        out.append((doc_id, n_a, n_b, n, n, best, sum(n * counts[p] for p, n in links.items()), sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_documents_of_a_batch(both, text):
    """Also next to others, and by the faster library for plain texts."""
    for own in ([text], [None, "a b", text, "", text + " c.", "▁"]):
        for t, found in zip(own, both.documents(own), strict=True):
            assert counted(found) == brute(both, t)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(1, 30))
def test_fragments_compose_to_the_document(both, text, chunk, reach):
    data = (" " + text).encode()
    parts = [both.fragment(data[first:last], start - first, end - first) for start, end, first, last in al.byte_ranges(data, chunk, reach)]
    want = brute(both, text)
    if None in parts:
        assert want == (0, 0, "", Counter())
        return
    left, right = al.Fragment(), al.Fragment()
    for x, y in zip(parts, reversed(parts), strict=True):
        left, right = left + x[2], y[2] + right  # associative: from either end
    assert left.text() == right.text()
    if text:
        assert (sum(x[0] for x in parts), sum(x[1] for x in parts), left.text(), sum((counted(x)[3] for x in parts), Counter())) == want


def test_borders_move_on_where_nothing_can_be_cut():
    data = b" " + b"x" * 50 + b" ab cd ef gh"
    assert al.byte_ranges(data, 10, 8) == [(0, 60, 0, 60), (60, 63, 60, 63)] or len(al.byte_ranges(data, 10, 8)) <= 3
    assert al.byte_ranges(data, 10, 8)[0][:1] == (0,) and al.byte_ranges(data, 10, 8)[-1][1] == len(data)
    assert len(al.byte_ranges(b" " + b"x" * 100, 10, 8)) == 1


ODD = [
    (1, None), (2, ""), (3, " "), (4, "one ▁ mark"), (5, "a <|endoftext|> b </s> <s>"), (5, "a <|endoftext|> b </s> <s>"), (None, "no id"),
    (7, "x" * 3000), (8, "  two  spaces \n and lines\n\n" * 30), (9, "Ünïcödé 漢字かな交じり文 не " * 40), (10, "the end of the line " * 200), (11, "bad ▁ " + "word " * 300),
]


@pytest.mark.parametrize("how", [{}, {"chunk": 64, "reach": 32, "fan": 2}, {"chunk": 500, "reach": 100, "fan": 3}])
def test_documents_whole_and_in_ranges(spark, both, how):
    docs = spark.createDataFrame([(t, d, "x", "y") for d, t in ODD], "text string, doc_id long, key string, pairs string")
    assert rows_of(al.cross_tokenizer_alignment(docs, **how)) == expected(both, ODD)


def test_counts_by_shuffle_equal_those_by_broadcast(spark, both):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = al.align(docs, f"{al.shared_dir(spark)}/by-shuffle")
    counts = al.link_counts(found.links)
    few, many = (rows_of(al.link_sums(found.links, counts, few=n, hot_pairs=20)) for n in (10**6, 0))
    assert few == many and len(few) == 8


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert al.cross_tokenizer_alignment(docs).count() == 0


def test_query_on_the_given_documents(spark, sf_dir, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(al.op12_cross_tokenizer_alignment(spark, sf_dir).select(*"doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split())) == expected(both, rows)
