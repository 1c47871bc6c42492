"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator; and brute force."""

import re
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timespan.llm import decontamination as dc
from timespan.llm import license_scans as ls
from timespan.llm import lm_scoring as lm
from timespan.llm import ngram_jaccard as nj
from timespan.llm import packing as pk
from timespan.llm import pii
from timespan.llm import quality_classifier as qc
from timespan.llm import quality_rules as qr
from timespan.llm import secret_scans as ss
from timespan.llm import warc
from timespan.llm.weak_labels import ABSTAIN, NO, YES, fit_label_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row long, spans string, host string, n long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, 2, "x", "h", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
ODD = [None, "", " \t\n", "one", "é ü 中文　x", "a b c d e", "a b c d e", LONG, "x" * 100_000, "1" * 20_000, "the cat " * 50]
IDS = [0, 1, 2, 3, 4, 5, 5, 7, None, None, 10]

BENCH_SCHEMA = "item_id long, text string, key long"
OPERATORS = {
    "quality_rules": qr.quality_rules,
    "quality_classifier": qc.classify_quality,
    "pii": pii.personal_data,
    "ngram_jaccard": nj.similar_documents,
    "secret_scans": ss.scan_secrets,
    "decontamination": lambda d: dc.decontaminate(d, d.sparkSession.createDataFrame([(1, "the cat the cat", 0), (2, None, 0), (None, "a b c d e", 0)], BENCH_SCHEMA)),
    "license_scans": ls.scan_licenses,
    "packing": pk.best_fit_packing,
    "lm_scoring": lm.score_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_kept(spark, name):
    out = OPERATORS[name](docs(spark, ODD, IDS))
    rows = out.filter("piece = 0") if name == "packing" else out
    assert Counter(r.doc_id for r in rows.collect()) == Counter(IDS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, ODD).filter("false")).count() == 0


def words(text):
    return (text or "").encode().lower().split()


def test_quality_base_against_brute_force(spark):
    rng = random.Random(1)
    texts = [rng.choice(["\n", " "]).join(rng.choice(["a", "b#", "a b c d e f g h i", "é", "", "a b c d e f g h i j"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = {r.doc_id: r for r in qr.quality_rules(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_frequent_lines_deplete_documents(spark):
    common = " ".join(f"c{k}" for k in range(25))
    own = [" ".join(f"u{i}x{k}" for k in range(25)) for i in range(12)]
    texts = [common + f"\nshort {i}" for i in range(6)] + [common + "\n" + x for x in own[:6]] + [own[6]] * 9
    kept = {r.doc_id: r.kept for r in qr.quality_rules(docs(spark, texts), max_docs=5).collect()}
    assert [kept[k] for k in range(21)] == [False] * 6 + [True] * 15  # copies of one text count once


def test_columns_with_names_of_the_operators_own(spark):
    names = ["_own", "_key", "_text", "_d", "_lines", "doc", "body", "kept", "hit", "spans", "masked", "own_id", "gone_id", "rank", "content"]
    line = "every page of this host has this line of many words at its end and more"
    texts = [f"{' '.join(f'a{k}x{j}' for j in range(30))} password = abcdefgh{k}\n{line}" for k in range(60)]
    rows = docs(spark, texts + texts[:1]).withColumns({n: F.lit(n) for n in names if n not in docs(spark, []).columns})
    out = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "/root/testdata/sf0.001")
        assert out.columns == rows.columns, name
        got = out.collect()
        assert len(got) == (61 if name == "quality_rules" else 60), name
        assert all(r[n] == n for r in got for n in names if n != "spans")
    assert all("[SECRET]" in r.text and line not in r.text for r in got)


def test_words_of_repeated_lines_that_stay_count_each(spark):
    common = "a line that all documents of the host have in common"
    texts = [common + "\n" + "\n".join([f"ten words of text{k} that stand here five times over"] * 5) for k in range(60)]
    assert {(r.n_left_words, r.n_removed_lines) for r in qr.quality_rules(docs(spark, texts)).collect()} == {(50, 1)}


def test_frequent_lines_leave_the_text(spark, monkeypatch):
    own = [" ".join(f"u{i}x{k}" for k in range(25)) for i in range(8)]
    texts = [f"{x}\n Accept  ALL cookies é\n\nend {i}\naccept all cookies é" for i, x in enumerate(own)] + [own[0], None, "short\naccept all cookies é", own[7] + "\nother"]
    ids = [*range(8), None, 9, 10, 7]
    table = docs(spark, texts, ids)
    got = qr.clean(table, max_docs=5).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in qr.quality_rules(table, max_docs=5).filter("kept").collect())
    monkeypatch.setattr(qr, "SMALL_ROWS", 0)  # as if there were too many lines to send to all tasks
    assert sorted(qr.clean(table, max_docs=5).collect(), key=repr) == sorted(got, key=repr)
    want = [(i, f"{x}\n\nend {i}") for i, x in enumerate(own)] + [(None, own[0]), (7, own[7] + "\nother")]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((k, t, len(t)) for k, t in want)


def test_pipeline_stage_writes_texts_without_frequent_lines(spark):
    texts = [" ".join(f"u{i}x{k}" for k in range(25)) for i in range(60)]
    got = corpus_pipeline.quality(spark, docs(spark, [t + "\nshare this page" for t in texts]), "").collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts))


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        alphabet = rng.choice(["ab.@-1", "0123456789-  ", "1.2.5", "+12() -.5", "a@b.c1.2+3 -é"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_adds_spans(spark):
    texts = ["call phone (555) 234-9876 now", "write john at example dot com", "Dear Mr. John Smith hello", "version 123-45-6789x"] * 8
    rows = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    assert rows[0].spans == "local_phone:11:25" and rows[0].base == ""
    assert rows[3].spans == ""


def test_label_model_finds_the_unreliable_labeller():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.55)], 1)
    votes = np.where(rng.random(votes.shape) < 0.2, ABSTAIN, np.where(votes, YES, NO))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit_label_model(patterns, counts.astype(float))
    assert np.argmin(model.accuracy) == 3 and model.accuracy[0] > 0.9
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def brute_components(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return top, [len(s) for s in sets]


@pytest.mark.parametrize("limit", [0, 40, 100_000])
def test_near_duplicates_against_brute_force(spark, limit):
    rng = random.Random(4)
    base = [[f"b{k}x{i}" for i in range(n)] for k, n in enumerate((8, 12, 30, 60, 90))]
    texts = [None, "", "a b", "A b", "a b c"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        texts.append(" ".join(w[: len(w) - rng.randint(0, 3)]))
    texts += texts[-5:]
    top, sizes = brute_components(texts)
    got = {r.doc_id: r for r in nj.similar_documents(docs(spark, texts), limit).collect()}
    assert [got[k].component_id for k in range(len(texts))] == top
    assert [got[k].n_shingles for k in range(len(texts))] == sizes


def test_signatures_share_keys_for_every_allowed_edit():
    rng = np.random.default_rng(5)
    for turn in range(4000):
        x = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 200)), dtype=np.uint64))
        n = len(x)
        a = int(rng.integers(0, n // 5 + 1))
        b = (n - 5 * a) // 4 if turn % 2 else int(rng.integers(0, (n - 5 * a) // 4 + 1))
        y = np.unique(np.concatenate([x[a:] if turn % 3 else np.delete(x, rng.choice(n, a, replace=False)), rng.integers(1, 1 << 40, b, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (n + len(y) - both):
            continue
        pool = np.union1d(x, y)
        frequent = rng.choice(pool, int(len(pool) * rng.random()), replace=False)
        bitmap = np.zeros(1 << 10, np.uint64)
        np.bitwise_or.at(bitmap, (frequent >> np.uint64(54)).astype(np.int64), np.uint64(1) << (frequent >> np.uint64(48) & np.uint64(63)))
        assert nj.is_frequent(frequent, bitmap).all()
        (of_x, inner_x), (of_y, inner_y) = nj.signature(x, bitmap), nj.signature(y, bitmap)
        shared = len(np.intersect1d(of_x, of_y))
        assert shared >= min(nj.common_keys(n), nj.common_keys(len(y)))
        if n >= len(y):  # the smaller set has them in its inner prefix
            assert len(np.intersect1d(of_x, of_y[:inner_y])) >= nj.common_keys(len(y))
        if len(y) >= n:
            assert len(np.intersect1d(of_y, of_x[:inner_x])) >= nj.common_keys(n)
        assert 9 * sum(int(v).bit_count() for v in (nj.parities(x) ^ nj.parities(y)).view(np.uint64)) <= n + len(y)


def test_components_by_stars_equal_those_of_one_task(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "a long, b long")
    assert sorted(map(tuple, nj.components(edges, few=0).collect())) == sorted(map(tuple, nj.components(edges.filter("a <> b")).collect()))


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(30))
    kept = nj.one_of_each_group(docs(spark, [text, text, text + " more", "other words here and there again", None, None], [3, 3, 1, 9, 4, 4]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 9]
    assert [r.doc_id for r in nj.one_of_each_group(docs(spark, [text, text], [3, 3])).collect()] == [3]
    assert kept.columns == docs(spark, []).columns


def test_trigram_queries():
    assert ss.trigram_query("[0-9a-f]{32,}") == []
    assert ss.trigram_query("AKIA[A-Z0-9]+") == [(frozenset({"aki", "kia"}),)]
    assert ss.trigram_query("(abcd|xyz)?[0-9]+q") == []
    assert ss.trigram_query("x(?:ab|cd)y") == [(frozenset({"xab", "aby"}), frozenset({"xcd", "cdy"}))]


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["token", "=", ":", "PassWord", " ", "abcdefgh", "'", '"', "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "api_key", "apikey", "x", "\n", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = {r.doc_id: r.spans for r in ss.scan_secrets(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [brute_secrets(t) for t in texts]
    clean = ss.redact_secrets(docs(spark, texts))
    assert clean.columns == docs(spark, []).columns
    for r in clean.collect():
        assert all(s not in r.text for s in re.findall(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", texts[r.doc_id]))
        assert r.n_chars == len(r.text)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x" * 200_000, "<p>é</p>", None]
    pages = spark.createDataFrame([(i, f"http://a/{i} b\r\n", h, 1) for i, h in zip([1, 2, 3, 4, 5, 6, None], html, strict=True)], "page_id long, url string, html string, path long")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder, range_bytes=1000, gap_bytes=0).collect()}
    assert {k: (r.payload_bytes, r.record_type, r.refers_to) for k, r in got.items()} == {
        1: (9, "revisit", 6), 2: (9, "revisit", 6), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (200_000, "response", None), 6: (9, "response", None), None: (0, "revisit", 4),
    }
    assert got[1].payload_digest == warc.sha1_base32("<p>é</p>".encode())
    (at,), (to,) = (index.filter(f"page_id = {k}").select("path", "offset", "length").collect() for k in (1, 6))
    heads = [warc.parse(open(x.path, "rb").read()[x.offset : x.offset + x.length])[0] for x in (at, to)]
    assert heads[0]["WARC-Refers-To"] == heads[1]["WARC-Record-ID"]
    empty = warc.write_archives(pages.filter("false"), f"{folder}-empty")
    assert warc.read_records(empty, f"{folder}-empty").count() == 0
    some = warc.read_records(index.filter("page_id IN (2, 5)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [2, 5]
    assert warc.ranges(index).count() <= index.select("path").distinct().count()


def brute_hits(text, items, window=13):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        grams = {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 5])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 25)))) for k in range(12)] + [(40, None)]
    texts = [" ".join(rng.choice([rng.choice("abcdefgxyz"), rng.choice(items)[1] or ""]) for _ in range(30)) for _ in range(25)] + [None, "", "a-b A.b"]
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], BENCH_SCHEMA)
    got = {r.doc_id: r for r in dc.decontaminate(docs(spark, texts), bench, block_windows=block).collect()}
    import hashlib

    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
        assert got[k].contaminated == (hit > 0 and 20 * hit >= n)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_returns_proximity_matches(spark, block):
    passage = [f"p{k}" for k in range(13)]
    changed = passage[:6] + ["other"] + passage[7:]  # p6 is in no training text
    texts = [" ".join(["x"] * 9 + changed + ["x"] * 40), " ".join(["x"] * 60), " ".join(passage[7:9] + ["x"] * 80 + passage[9:])]
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate([" ".join(passage), "x y", "q r s", "u v", "only"])], BENCH_SCHEMA)
    got = dc.proximity_matches(docs(spark, texts), bench, block_windows=block).collect()
    assert {(r.doc_id, r.start, bytes(r.words).decode(), tuple(r["items"])) for r in got if r.doc_id == 0} == {(0, 9, " ".join(passage), ("0",))}
    assert not [r for r in got if r.doc_id == 1]
    n = {r.doc_id: r.n_hit for r in dc.decontaminate(docs(spark, texts), bench, block_windows=block).collect()}
    assert n == {0: 0, 1: 0, 2: 0}


def test_decontamination_index_holds_the_postings(spark):
    index = dc.write_index(docs(spark, ["a b a", None, "c d c C", "c a"]).coalesce(1), [b"a", b"c", b"none"], gap=10)
    (r,) = index.collect()
    assert (r.doc_ids, r.n_words, r.first) == ([0, 1, 2, 3], [3, 0, 4, 2], [0, 13, 23, 37])
    assert (r.terms, r.ends, r.postings) == ([0, 1], [3, 7], [0, 2, 38, 23, 25, 26, 37])
    assert {r.term: r.n for r in dc.posting_counts(index, 3).collect()} == {0: 3, 1: 4}


def decided(block):
    """The labels that any span of a block decides for."""
    every = [(label, set(ls.words_of(x.encode())), set(d.encode().split())) for label, texts in ls.TEMPLATES.items() for x, d in zip(texts, ls.DECIDING[label], strict=True)]
    out = set()
    for i in range(len(block)):
        for j in range(i, len(block)):
            span = set(block[i : j + 1])
            for label, own, d in every:
                if len(span & own) >= 0.8 * len(own) - 1e-9 and d <= span and not any(other != label and d < e <= span for other, _, e in every):
                    out.add(label)
    return out


@pytest.mark.parametrize(("text", "labels"), [
    ("released under the Apache license", "apache-2"),
    ("the film was released under the license of the studio", ""),
    ("the film was distributed under the license of the studio and the school", ""),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under the Mozilla Public License, Version 2.0", "mpl-2"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "postgresql"),
])
def test_each_notice_gets_its_own_label_alone(spark, text, labels):
    around = f"some words before\n{text}\nand some after it"
    assert [r.labels for r in ls.scan_licenses(docs(spark, [text, around])).collect()] == [labels, labels]


def test_every_notice_of_the_list_gets_its_own_label(spark):
    notices = [(label, t) for label, texts in ls.TEMPLATES.items() for t in texts]
    both = " \n".join(t for label, t in notices if label in ("gpl", "lgpl", "agpl"))
    got = [r.labels for r in ls.scan_licenses(docs(spark, [t for _, t in notices] + [both])).collect()]
    base = {k: {label for p, label in ls.BASE_PHRASES.items() if f" {p} " in " " + " ".join(x.decode() for x in ls.words_of(t.encode())) + " "} for k, (_, t) in enumerate(notices)}
    assert got == [",".join(sorted({label} | base[k])) for k, (label, _) in enumerate(notices)] + ["agpl,gpl,lgpl"]


def test_license_join_loses_no_block(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        t = rng.choice([x for v in ls.TEMPLATES.values() for x in v]).split()
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = "z"
        texts.append("intro words\n" + " ".join(t) + "\nend")
    texts += ["under the MIT license, apache license version 2.0 and CC-BY-NC", None, ""]
    got = {r.doc_id: r for r in ls.scan_licenses(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        base = {label for p, label in ls.BASE_PHRASES.items() if f" {p} " in " " + " ".join(x.decode() for x in ls.words_of((t or "").encode())) + " "}
        want = set(base)
        for line in (t or "").encode().split(b"\n"):
            want |= decided(ls.words_of(line))
        assert got[k].labels == ",".join(sorted(want)) and got[k].base_labels == ",".join(sorted(base))
    r = got[60]
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (13, 3, 0, 10)


def test_license_filters_reject_and_lose_nothing():
    rng = random.Random(12)
    pool = [b"%d" % k for k in range(30)]
    templates = [(str(k), rng.sample(pool, rng.randint(3, 12))) for k in range(40)]
    frequency = {w: rng.randint(0, 9) for w in pool}
    join, rejected = ls.Join(templates, frequency, 0.8), 0
    for _ in range(2000):
        block = {join.rank[w] for w in rng.sample(pool, rng.randint(0, 12)) if w in join.rank}
        passed = join.candidates(sorted(block))
        for k, own in enumerate(join.words):
            assert k in passed or len(block & own) < join.need[k]
            in_prefix = any(k == t for w in block for _, t in join.prefix.get(w, ()))
            rejected += in_prefix and len(block) >= join.need[k] and k not in passed
    assert rejected  # the positional filter alone rejects


def test_wrapped_license_notices_are_found(spark):
    rng = random.Random(17)
    notices = [(label, t) for label, texts in ls.TEMPLATES.items() for t in texts]
    filler = [f"v{k}" for k in range(300)]
    texts, want = [], []
    for label, t in notices:
        for columns, mark in ((30, ""), (72, "# "), (45, " * ")):
            lines = [mark + x for x in textwrap.wrap(t, columns, break_long_words=False)]
            texts.append("\n".join([" ".join(rng.choices(filler, k=rng.randint(0, 90))), *lines, " ".join(rng.choices(filler, k=rng.randint(0, 90)))]))
            want.append(label)
        # the same words far from each other are no notice
        texts.append("\n".join(w + "\n" + " ".join(rng.choices(filler, k=3 * len(t.split()))) for w in t.split()))
        want.append(None)
    got = {r.doc_id: r for r in ls.scan_licenses(docs(spark, texts)).collect()}
    for k, label in enumerate(want):
        labels = set(filter(None, got[k].labels.split(",")))
        assert (label in labels and got[k].score == 1.0) if label else not labels, (texts[k], got[k])


def test_packing_is_best_fit_decreasing():
    import bisect

    rng = random.Random(10)
    counts = {rng.randint(1, 2048): rng.randint(1, 30) for _ in range(400)}
    left, bins = [], 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = bisect.bisect_left(left, n)
            bins, rest = (bins + 1, 2048 - n) if at == len(left) else (bins, left.pop(at) - n)
            if rest:
                bisect.insort(left, rest)
    used = {}
    for n, a, b, each, first, place in pk.best_fit_plan(counts):
        for i in range(b - a):
            used.setdefault(first + i // each, []).append((place + i % each * n, n))
    assert len(used) == bins and sum(map(len, used.values())) == sum(counts.values())
    for pieces in used.values():
        at = 0
        for place, n in sorted(pieces):
            assert place == at
            at += n
        assert at <= 2048


def test_tokens_and_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    alphabet = [*"aZé'’ßÉ!=&.,-_09²̸́　 \x1c\x85—€中<|>\n\t x", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "İ", "Σ", "×"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids = pk.ids_of(None)
    for x in texts:
        assert list(np.frombuffer(ids.text(x.encode()), "<u4")) == t.encode(x, add_special_tokens=False).ids, x
    out = pk.best_fit_packing(docs(spark, [*texts[:50], LONG, None])).toPandas()
    for k, x in enumerate([*texts[:50], LONG, ""]):
        own = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        rows = out[out.doc_id == k].sort_values("piece")
        assert rows.length.tolist() == [len(own[i : i + 2048]) for i in range(0, len(own), 2048)]
        assert rows.ids_crc32.tolist() == [zlib.crc32(own[i : i + 2048].tobytes()) for i in range(0, len(own), 2048)]
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048


def test_plain_chunks_have_the_ids_of_the_named_tokenizer():
    """Every plain word of the vocabulary, whole and with its neighbours, also where tokens could be reached in other ways; none of them is merged slowly."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, ids = Tokenizer.from_file(path), pk.Ids(path)
    with open(path, encoding="utf-8") as f:
        words = [w for w in (x.removesuffix("</w>") for x in json.load(f)["model"]["vocab"]) if re.fullmatch("[!-&(-~]+", w) and "<|" not in w]
    assert len(words) > 30_000
    ids.merge = None  # what the plain ones did without before
    mixed = [x + y for x, y in zip(words, words[7:], strict=False) if "<|" not in x + y] + [f"{w}3é{w}.ü9!" for w in words[::5]] + ["x" * 150]
    for w, own in zip(words + mixed, t.encode_batch(words + mixed, add_special_tokens=False), strict=True):
        assert list(np.frombuffer(ids.text(w.encode()), "<u4")) == own.ids, w


def test_gradients_of_the_recurrent_model():
    rng = np.random.default_rng(12)
    model = lm.Model.start(np.arange(lm.CLASSES * lm.CLASS_WORDS)[::-1] + 1.0, hidden=4)
    model.w = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in model.w.items()}
    ids, mask = rng.integers(0, 40, (5, 3)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    h = rng.standard_normal((3, 4)) * 0.1
    loss, grad, _ = model.window(ids, mask, h)
    for name, at in (("u", (1, 5)), ("x", (ids[1, 0], 2)), ("wc", (2, 0)), ("b", (7,)), ("ww", (0, 1, ids[0, 0] % lm.CLASS_WORDS)), ("bw", (0, 3))):
        before = model.w[name][at]
        model.w[name][at] = before + 1e-5
        up = model.window(ids, mask, h)[0]
        model.w[name][at] = before - 1e-5
        down = model.window(ids, mask, h)[0]
        model.w[name][at] = before
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at])), name


def test_lm_base_score_and_held_out_gain(spark):
    rng = random.Random(13)
    cycle = [f"w{k}" for k in range(12)]

    def text():
        k = rng.randrange(12)
        return " ".join(cycle[(k + i) % 12] for i in range(60))

    texts = [text() for _ in range(700)] + ["rare Word", None]
    for top in (400_000, 5):
        out = lm.score_documents(docs(spark, texts), top_words=top).toPandas().set_index("doc_id")
        held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 == 2}
        counts = Counter(w for k, t in enumerate(texts) if k not in held for w in [*(x.decode() for x in words(t)), ""])
        n, v = sum(counts.values()), len(counts)
        for k in (0, 1, 2, 3, len(texts) - 2, len(texts) - 1):
            own = [*(x.decode() for x in words(texts[k])), ""]
            assert out.held_out[k] == (k in held) and out.train_tokens[k] == n and out.n_tokens[k] == len(own) and out.n_known[k] == sum(counts[w] > 0 for w in own)
            assert abs(out.base_score[k] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        if top > 5:
            some = out[out.held_out & (out.n_tokens > 50)]
            assert len(some) > 20 and some.score.mean() > 0.7 * some.base_score.mean()  # words follow each other in a cycle


def test_lm_trains_on_every_window_with_the_state_carried(monkeypatch):
    rng, seen, window = np.random.default_rng(16), [], lm.Model.window
    model = lm.Model.start(np.ones(lm.CLASSES * lm.CLASS_WORDS), hidden=4)
    monkeypatch.setattr(lm.Model, "window", lambda self, ids, mask, h: (seen.append((ids, mask, h)), window(self, ids, mask, h))[1])
    texts = [rng.integers(0, 1000, n) for n in (5, 100, 1000, 33, 64, 1, 32, 700)]
    lm.Trainer(model).run(iter(texts), lanes=3)
    assert Counter(np.concatenate([ids[mask] for ids, mask, _ in seen]).tolist()) == Counter(np.concatenate(texts).tolist())
    starts = sum(int((~h.any(1)).sum()) for _, _, h in seen)
    assert starts == len(texts)  # every other window goes on from the state before it


def test_lm_round_trains_on_every_document(spark):
    texts = [" ".join(f"w{(k * 7 + j) % 40}" for j in range(5 + 30 * k)) for k in range(12)]
    ids = {b"w%d" % k: k for k in range(40)}
    model = lm.Model.start(np.ones(lm.CLASSES * lm.CLASS_WORDS), hidden=4)
    local = lm.Trainer(model)
    local.run(np.array([ids.get(w, lm.CLASSES * lm.CLASS_WORDS - 1) for w in [*words(t), b""]]) for t in texts)
    got = lm.train_round(docs(spark, texts).select(lm.utf8().alias("text")).coalesce(1), model, ids)
    assert all(np.allclose(got.w[k], local.model.w[k], atol=1e-5) for k in lm.Model.names)


def test_lm_scores_are_a_distribution():
    model = lm.Model.start(np.ones(lm.CLASSES * lm.CLASS_WORDS), hidden=4)
    h = np.random.default_rng(14).standard_normal((1, 4)).astype(np.float32)
    every = np.arange(lm.CLASSES * lm.CLASS_WORDS)
    p = np.exp(model.losses(np.repeat(h, len(every), 0), every)[0])
    assert abs(p.sum() - 1) < 1e-4


def test_pipeline(spark, tmp_path):
    rng = random.Random(15)
    clean = [" ".join(f"v{rng.randrange(5000)}" for _ in range(60)) for _ in range(8)]
    bench = " ".join(f"q{k}" for k in range(20))
    texts = [*clean, clean[0] + " more", "too short", clean[3][:120] + " " + bench, clean[4] + " token=abcdefgh1234"]
    texts[4] = " ".join(f"n{k}" for k in range(40))
    d = str(tmp_path)
    docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert sorted({r.doc_id for r in out.collect()}) == [0, 1, 2, 3, 4, 5, 6, 7, 11]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontamination", "secret_scans", "best_fit_packing"]


def test_quality_labels_improve_nothing_that_is_empty(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    out = qc.classify_quality(docs(spark, ODD, IDS), labels)
    assert out.count() == len(ODD) and out.filter(F.col("kept").isNull()).count() == 0


def test_language_model_beats_the_base_score_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_documents(table).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert r.score - r.base > 0.1 * r.n


def _labels_model_row_by_row(votes, start=0.85, prior=0.1, strength=20.0, rounds=60):
    """Expectation-maximisation over rows, one vote at a time: accuracies, share of class 1, posterior of each row."""
    n = len(votes[0])
    accuracy, share = [start] * n, prior

    def posteriors():
        out = []
        for row in votes:
            yes, no = share, 1 - share
            for vote, a in zip(row, accuracy, strict=True):
                yes *= {ABSTAIN: 1, YES: a, NO: 1 - a}[vote]
                no *= {ABSTAIN: 1, YES: 1 - a, NO: a}[vote]
            out.append(yes / (yes + no))
        return out

    for _ in range(rounds):
        p = posteriors()
        new = []
        for j in range(n):
            right = sum(q if row[j] == YES else 1 - q for row, q in zip(votes, p, strict=True) if row[j] != ABSTAIN)
            cast = sum(row[j] != ABSTAIN for row in votes)
            new.append(min(0.995, max(0.55, (right + start * strength) / (cast + strength))))
        accuracy, share = new, min(0.6, max(0.005, (sum(p) + prior * strength) / (len(votes) + strength)))
    return accuracy, share, posteriors()


def test_quality_posteriors_and_decisions_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in qc.classify_quality(docs, labels).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = {}
    for r in labels.collect():
        q, t = known.get(r.doc_id, (0, 0))
        known[r.doc_id] = max(q, r.quality), max(t, r.toxic)
    assert got.keys() == texts.keys()
    ids = sorted(texts)
    for k, target in enumerate(qc.TARGETS):
        rows = []
        for i in ids:
            label = ABSTAIN
            if i in known:
                bad = known[i][0] <= 0 if target == "low" else known[i][1] > 0
                label = YES if bad else NO
            rows.append(qc.votes(texts[i])[k] + [label])
        accuracy, share, _ = _labels_model_row_by_row(rows)
        for i, row in zip(ids, rows, strict=True):  # a label is used in training alone
            yes, no = share, 1 - share
            for vote, a in zip(row[:-1], accuracy, strict=False):
                yes *= {ABSTAIN: 1, YES: a, NO: 1 - a}[vote]
                no *= {ABSTAIN: 1, YES: 1 - a, NO: a}[vote]
            assert abs(got[i][f"{target}_posterior"] - yes / (yes + no)) < 1e-9
    for r in got.values():
        worst = max(max(r[f"{t}_score"], (r[f"{t}_posterior"] + r[f"{t}_score"]) / 2) for t in qc.TARGETS)
        assert r.kept == (worst < 0.5)


@pytest.mark.parametrize("votes", [[[YES, YES, YES]] * 9, [[ABSTAIN] * 3] * 4, [[YES, NO, ABSTAIN], [NO, YES, ABSTAIN]] * 5])
def test_label_model_with_ties_and_empty_classes(votes):
    each = [list(x) for x in dict.fromkeys(map(tuple, votes))]
    model = fit_label_model(np.array(each), np.array([votes.count(x) for x in each], float))
    accuracy, share, posteriors = _labels_model_row_by_row(votes)
    assert np.allclose(model.accuracy, accuracy) and abs(model.prior - share) < 1e-9
    assert np.allclose(model.posterior(np.array(votes)), posteriors)


def test_scores_need_the_features_with_weights_only():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "alphabet", "alphabets", "alphabetic", "beta", "gamma9", "x"], 30)).encode() for _ in range(40)]
    weights = [np.where(rng.random(qc.DIMENSIONS + 1) < 0.3, rng.normal(size=qc.DIMENSIONS + 1), 0).astype(np.float32) for _ in range(2)]
    some = qc.WordIds(qc.needed_ids(weights))
    for t in texts:
        for w in weights:
            assert abs(qc.score(qc.features(t), w) - qc.score(qc.features(t, some), w)) < 1e-6


def test_quality_of_documents_whose_labels_are_held_out(spark):
    """Floors against regressions; half of the labels are given, the other half is held out."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 2 = 1")
    got = qc.classify_quality(docs, labels.filter("doc_id % 2 = 0")).join(held.select("doc_id", "quality", "toxic"), "doc_id").toPandas()
    for target, bad, floors in (("low", got.quality <= 0, (0.9, 0.85)), ("toxic", got.toxic > 0, (0.8, 0.9))):
        found = np.maximum(got[f"{target}_score"], (got[f"{target}_posterior"] + got[f"{target}_score"]) / 2) >= 0.5
        recall, precision = (found & bad).sum() / bad.sum(), (found & bad).sum() / found.sum()
        print(target, bad.sum(), recall, precision)
        assert recall >= floors[0] and precision >= floors[1]


def test_quality_without_votes_of_both_classes_keeps_plain_documents(spark):
    plain = [" ".join(f"mot{k}x{j}" for j in range(40)) for k in range(30)]  # no labeller votes on toxicity, nor on one class
    assert qc.classify_quality(docs(spark, plain)).filter("toxic_score >= 0.5 OR NOT kept AND low_score < 0.5").count() == 0


@pytest.mark.parametrize("block", [3, 2_000])
def test_pairs_leave_a_task_once(spark, block):
    """A group that has 40 keys in common: a row for each of its pairs, not for each key; the same with blocks."""
    members, keys = 12, 40
    schema = "at long, id long, n long, place int, inner boolean, component long, contents long, first long"
    rows = spark.createDataFrame([(k, m, 200, k, True, m // 2, members, 0) for k in range(keys) for m in range(members)], schema)
    sketches = spark.createDataFrame([(m, 200, [0] * 7 + [-1 if m == 5 else 0]) for m in range(members)], "id long, n long, bits array<long>")
    want = {(a, b) for a in range(members) for b in range(a + 1, members) if a // 2 != b // 2 and (5 not in (a, b) or 9 * 64 <= 400)}
    assert sorted(tuple(r) for r in nj._all_pairs(rows, sketches, block).collect()) == sorted(want)
    if block > members:
        part = ["home", "i", "j", "at", "side", "id", "n", "place", "inner", "component", "bits"]
        one = rows.join(sketches.select("id", "bits"), "id").selectExpr("0L home", "0 i", "0 j", "at", "false side", "id", "n", "place + 0L place", "inner", "component", "bits").select(part)
        out = one.coalesce(1).sortWithinPartitions("home", "i", "j", "at").mapInArrow(nj._counted_pairs, "a long, b long, keys long, n long").collect()
        assert len(out) == len(want)
        assert {r["keys"] for r in out} == {keys}


def _key_rows(spark):
    """Keys of 1 to 12 contents, every third of them hot; each content has a component in groups."""
    rng = random.Random(5)
    rows = [(k, m, 12 + m % 5, rng.randrange(6), rng.random() < 0.4, k % 3 == 0, m * 7 % 41) for k in range(60) for m in rng.sample(range(40), rng.randrange(1, 13))]
    return rows, spark.createDataFrame(rows, "at long, id long, n long, place int, inner boolean, hot boolean, ties long").coalesce(2)


@pytest.mark.parametrize("grouped", [False, True])
def test_open_keys_of_the_join_by_brute_force(spark, grouped):
    rows, shared = _key_rows(spark)
    component = {m: m // 3 * 3 if grouped else m for m in range(40)}
    groups = spark.createDataFrame([(m, c) for m, c in component.items() if m != c], "node long, component long") if grouped else None
    want, pairs, most = set(), set(), 0
    for key in range(60):
        own = [r for r in rows if r[0] == key]
        left = sum(r[4] and component[r[1]] != component[x[1]] for r in own for x in own)
        most += left
        if left:
            _, a, n1, place1, inner1, *_ = max(own, key=lambda r: r[6])
            want |= {(key, r[1], component[r[1]], len(own), min(x[1] for x in own)) for r in own}
            for _, b, n, place, inner, *_ in own:
                inside = inner1 and n1 <= n or inner and n <= n1
                if component[a] != component[b] and inside and 5 * min(n, n1) >= 4 * max(n, n1) and 9 * (min(place, place1) + min(n - place, n1 - place1)) >= 4 * (n + n1):
                    pairs.add((a, b))
    found, left = nj._open_rows(shared, groups)
    assert left == most
    assert {(r["at"], r["id"], r["component"], r["contents"], r["first"]) for r in found.collect()} == want
    assert {(r["a"], r["b"]) for r in nj._hub_pairs(found, 0).collect()} == pairs
    assert pairs


def test_keys_are_dealt_once_for_the_pairs_with_their_hubs(spark):
    """Rows of keys cross one exchange by key, however many things are asked of them; there is no join by key beside that with a broadcast."""
    found, _ = nj._open_rows(nj.stored(_key_rows(spark)[1]), None)
    plan = nj._hub_pairs(found, 0)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(at#\d+L?, \d+\)", plan)) == 1
    assert "SortMergeJoin" not in plan


def test_tokens_met_again_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(300)] * 2 + [" ".join(f"same{k}" for k in range(40)) + f" {n}" for n in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["text"])
    want = Counter(int(t) for x in set(texts) for t in nj.shingles(x.encode().split()).view(np.int64))
    got = {t: n for x in nj._met_again([batch]) for t, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    assert got == {t: n for t, n in want.items() if n > 1}
    assert len(got) == 36
    tracemalloc.start()
    list(nj._met_again([batch]))
    assert tracemalloc.get_traced_memory()[1] < 22 * len(want)  # bytes a token; it was 48
    tracemalloc.stop()
