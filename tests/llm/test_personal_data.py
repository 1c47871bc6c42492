"""Planted personal data of all kinds beyond the base ones: recall, precision, time, and which spans may be added."""

import random
import time
from collections import Counter

import pytest

from timespan.llm import pii

FIRST = ["Maria", "Jean", "Hans", "Linda", "José", "Claire", "Oleg", "Priya"]
LAST = ["Gómez", "Dupont", "Müller", "Smith", "Okafor", "Lee"]
FILLER = "the plan was late and people of the town went home before noon while it rained over old roofs".split()


def iban(rng):
    body = "DE00" + "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
    plain = f"DE{check:02d}{body[4:]}"
    return " ".join(plain[k : k + 4] for k in range(0, 22, 4)) if rng.random() < 0.5 else plain


def planted(rng, kind):
    """(text before, span) of a kind."""
    number = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    if kind == "at_email":
        return rng.choice(["write to", "mail", "contact", "Kontakt:", "correo"]), f"{rng.choice(FIRST[:4]).lower()}.{number(2)} at {rng.choice(['example', 'mail-host'])} dot {rng.choice(['com', 'org', 'de'])}"
    if kind == "local_phone":
        return rng.choice(["call", "phone", "Telefon", "teléfono", "fax"]), rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"])
    if kind == "ssn":
        return rng.choice(["SSN", "social security number", "taxpayer"]), f"{rng.choice('2345')}{number(2)}-{number(2)}-{number(4)}"
    if kind == "iban":
        return rng.choice(["IBAN", "Konto", "account", "cuenta", "virement sur compte"]), iban(rng)
    if kind == "name":
        title = rng.choice(["Mr.", "Mrs.", "Dr.", "Herr", "Frau", "Señora", "Monsieur", "Mme"])
        return rng.choice(["dear", "hello", "signed", "sehr geehrter", "estimado"]), f"{title} {rng.choice(FIRST)} {rng.choice(LAST)}"
    return rng.choice(["lives at", "address", "wohnt", "domicilio", "habite"]), rng.choice([
        f"{number(2)} Oak Hill Road", f"{number(3)} Elm Street", f"Bahnhofstraße {number(2)}", f"{number(2)} rue de Rivoli", f"Calle Mayor {number(2)}", f"Lindenweg {number(1)}a",
    ])


def decoy(rng, kind):
    """What looks like a kind and isn't."""
    return {
        "at_email": lambda: f"met at {rng.choice(FILLER)} dot {rng.choice(['net', 'zz', 'page'])}s", "local_phone": lambda: f"part 1{rng.randint(10, 99)}-0{rng.randint(10, 99)}-{rng.choice(['1111', '0000'])}",
        "ssn": lambda: f"lot 000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "iban": lambda: "key AB12 " + " ".join(f"C{rng.randint(100, 999)}" for _ in range(4)),
        "name": lambda: "the Dr was late", "street": lambda: f"{rng.randint(2, 9)} of the roads",
    }[kind]()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(900):
        kind = pii.MORE_KINDS[k % len(pii.MORE_KINDS)]
        around = [" ".join(rng.choices(FILLER, k=rng.randint(4, 12))) for _ in range(2)]
        if rng.random() < 0.67:
            before, span = planted(rng, kind)
            text = f"{around[0]} {before} {span}, {around[1]}"
            at = text.index(span)
            rows.append((k, text, f"{kind}:{at}:{at + len(span)}"))
        else:
            rows.append((k, f"{around[0]} {decoy(rng, kind)} {around[1]}", None))
    return rows


def test_planted_spans_of_every_kind_are_found(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(docs).collect()}
    wanted, hit, added, right = Counter(), Counter(), Counter(), Counter()
    for k, _, span in corpus:
        if span:
            kind = span.split(":")[0]
            wanted[kind] += 1
            hit[kind] += span in got[k]
        for x in got[k]:
            added[x.split(":")[0]] += 1
            right[x.split(":")[0]] += x == span
    assert {k: hit[k] / wanted[k] >= 0.9 for k in pii.MORE_KINDS} == dict.fromkeys(pii.MORE_KINDS, True), (hit, wanted)
    assert {k: right[k] / added[k] >= 0.9 for k in pii.MORE_KINDS} == dict.fromkeys(pii.MORE_KINDS, True), (right, added)


def test_added_spans_are_candidates_that_overlap_nothing(spark, corpus):
    """Against a plain version: in order, candidates clear of base spans and of what was added before, each decided by itself."""
    texts = [t for _, t, _ in corpus[:200]] + ["mail a@b.co at x dot com (555) 234-9876 Mr. John Smith", "call 234-555-9876 234-555-9876", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        text = texts[r.doc_id] or ""
        base = [f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in pii.base_spans(text)]
        spans = list(filter(None, r.spans.split(",")))
        assert r.base == ",".join(base) and set(base) <= set(spans)
        free = {f"{kind}:{a}:{b}" for a, b, kind in pii.candidates(text) if not any(x < b and a < y for x, _, y in pii.base_spans(text))}
        own = [x for x in spans if x not in base]
        assert set(own) <= free and len(own) == r.n_added
        ends = [tuple(map(int, x.split(":")[1:])) for x in own]
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))


def test_sweep_equals_comparing_all():
    rng = random.Random(3)
    for _ in range(500):
        spans = [(a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, 12))]
        taken = [(a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, 12))]
        assert pii.clear_of(spans, taken) == [all(e <= a or s >= b for a, b in taken) for s, e in spans]


def test_many_spans_in_one_text_take_linear_time():
    n = 8000
    spans, taken = [(10 * k, 10 * k + 4) for k in range(n)], [(10 * k + 5, 10 * k + 9) for k in range(n)]
    began = time.time()
    assert all(pii.clear_of(spans, taken))
    assert time.time() - began < 0.5


def test_every_kind_has_its_own_accuracies():
    # the third labeller is right on kind a and wrong on kind b
    a = [("a", v, n) for v, n in (("222000", 300), ("111000", 700))]
    b = [("b", v, n) for v, n in (("221000", 300), ("112000", 700))]
    p = pii.kind_posteriors(a + b)
    assert p["a", "222000"] > 0.9 and p["b", "221000"] > 0.9 and p["b", "112000"] < 0.1
    assert p == pii.kind_posteriors(a) | pii.kind_posteriors(b)
