r"""Personal data (operator 3): labellers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans (e-mail, IPv4, payment card, phone with a plus sign) follow fixed rules and always stay. The method looks for
six kinds more: e-mail addresses written out, local phone numbers, social security numbers, bank accounts, names with a
title, and street addresses. Each text is read once and gives candidate spans with the votes of regex labellers (strict
shapes, check digits, borders, repeated digits), gazetteer labellers (given names, top-level domains, street words) and
context labellers (words before a span), in four languages. Counts of vote patterns fit the labellers' accuracies, for
each kind by itself; the posteriors of a bounded sample of candidates train a hashed linear span classifier over
shapes, words around and votes, which alone decides on every candidate. Candidates are stored, texts aren't read again.

Spans are code points, end exclusive. Defined results: a null text is empty and has no spans; repeated rows get equal
results; of added spans that overlap a base span or an earlier added one, the later is dropped; numbers of any length
are handled; the written-out address is looked for with local parts of up to 64 and labels of up to 63 characters, names
and street names with words of up to 30; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import stored, table
from timespan.llm.weak_labels import ABSTAIN, NO, YES, fit_label_model, score, train_scorer

KINDS = ("email", "ip", "card", "phone")
DIMENSIONS = 1 << 14
#: Candidates that the span classifier is trained on, at most, for each class.
SAMPLE = 5000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    spans = []
    at = text.find("@")
    free = 0  # where the last match of the kind ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                length = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    spans.append((at, 1, at + length))
                at += length + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


#: Given names that are frequent in the four languages. Fixed values.
NAMES = frozenset("""
james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew george kevin
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily donna michelle carol laura
antonio jose manuel francisco juan javier carlos miguel alejandro rafael pedro luis fernando pablo jorge alberto diego ramon
maria carmen ana isabel dolores pilar teresa rosa cristina lucia elena raquel marta beatriz sofia ines
jean pierre michel andré philippe rené louis alain jacques bernard marcel daniel roger claude françois henri nicolas julien
marie jeanne françoise monique catherine nathalie sylvie isabelle jacqueline anne martine nicole camille chloé élodie céline
peter wolfgang klaus jürgen hans günter stefan andreas dieter uwe werner matthias frank bernd horst heinz markus sebastian
ursula karin helga sabine ingrid renate monika petra gisela birgit anna andrea claudia heike katrin julia
""".split())
#: Words that stand before personal data of a kind. Fixed values.
CONTEXT = {
    "at_email": frozenset("email mail e-mail contact write reach address correo correos escribe contacto courriel contacter écrire adresse kontakt schreiben".split()),
    "local_phone": frozenset("phone tel telephone call fax mobile cell number dial teléfono telefono móvil llame téléphone portable appeler telefon handy ruf rufnummer anrufen".split()),
    "ssn": frozenset("ssn social security taxpayer identification seguridad sociale sécurité sozialversicherung".split()),
    "iban": frozenset("iban account accounts bank transfer konto bankkonto cuenta compte bancaire überweisung transferencia virement".split()),
    "name": frozenset("name dear hello signed regards sincerely from by contact attention estimado estimada atentamente cher chère bonjour signé sehr geehrter geehrte hallo gruß grüßen".split()),
    "street": frozenset("address at live lives living home street residence dirección vive domicilio calle adresse habite domicile wohnt wohnhaft anschrift".split()),
}
#: Words that stand before numbers of things. Fixed values.
OTHER_NUMBERS = frozenset("part item lot order ref reference invoice version id serial model artikel teil pedido pieza référence commande article".split())
TLDS = frozenset("com org net edu gov io de fr es uk eu info".split())
#: Words for streets in the four languages. Fixed values.
STREETS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd court way calle avenida plaza paseo camino rue place chemin allée impasse quai straße strasse str weg platz gasse allee".split())

_NAME = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,29}"
#: Candidates beyond the base kinds: their shapes.
_CANDIDATES = {
    "at_email": re.compile(r"\b[A-Za-z0-9._-]{1,64}(?: at | \(at\) | \[at\] |\(at\)|\[at\])[A-Za-z0-9-]{1,63}(?: dot | \(dot\) | \[dot\] |\(dot\)|\[dot\]|\.)[A-Za-z]{2,10}\b"),
    "local_phone": re.compile(r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z.-])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "name": re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|Don|Doña|Mme|Sra?)\.? {_NAME}(?:[ -]{_NAME}){{0,2}}"),
    "street": re.compile(
        rf"\b[0-9]{{1,5}}[a-z]?,? (?:{_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way)\b"
        rf"|\b[0-9]{{1,5}},? (?:rue|avenue|place|chemin|allée|impasse|quai|boulevard) (?:de |du |des |de la |d')?{_NAME}(?:[ -]{_NAME})?"
        rf"|\b(?:Calle|Avenida|Plaza|Paseo|Camino|calle|avenida|plaza) (?:de |del |de la )?{_NAME}(?: {_NAME})?,? (?:n[.º°]? ?)?[0-9]{{1,5}}\b"
        rf"|\b[A-ZÄÖÜ][a-zäöüß]{{1,29}}(?:straße|strasse|str\.|weg|platz|gasse|allee) [0-9]{{1,4}}[a-z]?\b"
    ),
}
#: What a text must hold for a shape to be looked for at all.
_NEEDS = {
    "at_email": re.compile(r" at |\(at\)|\[at\]"), "local_phone": re.compile(r"[0-9]{3}[-. ][0-9]{4}"), "ssn": re.compile(r"-[0-9]{2}-"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "name": re.compile(r"\b(?:M|D|P|H|F|S)[a-zñ]+\.? [A-ZÀ-Þ]"),
    "street": re.compile(r"[0-9] ?,? ?(?:[A-Z]|rue|avenue|place|chemin|all|impasse|quai|boulevard)|[a-zß.º°,] [0-9]"),
}
MORE_KINDS = tuple(_CANDIDATES)
_WORDS = re.compile(r"\w+(?:-\w+)?")


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ballot(kind: str, text: str, start: int, end: int) -> list[int]:
    """Votes on a candidate: shape, check digits or blocks, gazetteer, words before it, its borders, repetition of digits."""
    span, before = text[start:end], _WORDS.findall(text[max(0, start - 60) : start].lower())[-4:]
    low, digits = _WORDS.findall(span.lower()), re.sub("[^0-9]", "", span)
    shape = check = lists = ABSTAIN
    if kind == "at_email":
        shape = YES if "dot" in low or "(" in span or "[" in span else NO
        lists = YES if low[-1] in TLDS else NO
    elif kind == "local_phone":
        shape = YES if "(" in span else ABSTAIN
        check = YES if digits[0] > "1" and digits[3] > "1" else NO
    elif kind == "ssn":
        check = NO if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else YES
    elif kind == "iban":
        shape = YES if 15 <= len(span.replace(" ", "")) <= 34 else NO
        check = YES if _iban_valid(span) else NO
    elif kind == "name":
        shape = YES if len(low) >= 3 else ABSTAIN
        lists = YES if NAMES.intersection(low[1:]) else ABSTAIN
    else:
        shape = YES if digits and digits[0] != "0" else NO
        lists = YES if STREETS.intersection(low) or low[0].endswith(("straße", "strasse", "str", "weg", "platz", "gasse", "allee")) else NO
    context = YES if CONTEXT[kind].intersection(before) else NO if kind in ("at_email", "iban", "ssn") or OTHER_NUMBERS.intersection(before[-1:]) else ABSTAIN
    border = NO if end < len(text) and (text[end].isalnum() or text[end] in "_/=") or start and text[start - 1] in "_/=#" else ABSTAIN
    variety = ABSTAIN if kind in ("name", "street", "at_email") or not digits else NO if len(set(digits)) <= 2 else YES
    return [shape, check, lists, context, border, variety]


def span_features(kind: str, text: str, start: int, end: int, votes: list[int]) -> np.ndarray:
    span = text[start:end]
    shape = re.sub("[a-zß-ÿ]+", "a", re.sub("[A-ZÀ-Þ]", "A", re.sub("[0-9]", "0", span)))
    before = re.findall(r"\w+|[^\w\s]", text[max(0, start - 30) : start].lower())[-3:]
    after = re.findall(r"\w+|[^\w\s]", text[end : end + 20].lower())[:2]
    own = [f"k{kind}", f"s{kind}{shape}", *(f"b{kind}{w}" for w in before), *(f"a{kind}{w}" for w in after), *(f"v{kind}{k}{v}" for k, v in enumerate(votes))]
    return np.unique(np.array([zlib.crc32(x.encode()) % DIMENSIONS for x in own], np.int32))


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for kind, pattern in _CANDIDATES.items() if _NEEDS[kind].search(text) for m in pattern.finditer(text)]


def clear_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps none of those that are taken, by the stretches that these cover."""
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    at = (bisect_right(ends, s) for s, _ in spans)
    return [k == len(ends) or starts[k] >= e for k, (_, e) in zip(at, spans, strict=True)]


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.string()), ("own", pa.list_(pa.int32()))]))
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("end", pa.int32())]))


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, more = [], []
        for cell in batch.column(1):
            text = cell.as_py()
            own = base_spans(text)
            base.append([{"start": s, "n": n, "end": e} for s, n, e in own])
            spans, found = candidates(text), []
            for (s, e, kind), free in zip(spans, clear_of([x[:2] for x in spans], [(s, e) for s, _, e in own]), strict=True):
                if free:
                    votes = ballot(kind, text, s, e)
                    found.append({"start": s, "end": e, "kind": kind, "votes": "".join(map(str, votes)), "own": span_features(kind, text, s, e, votes).tolist()})
            more.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(more, _FOUND)], ["doc_id", "base", "more"])


def kind_posteriors(patterns: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """P(personal) of each vote pattern (kind, votes, rows); every kind has accuracies and a prior of its own."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes = np.array([[int(c) for c in v] for v, _ in own], np.int64)
        model = fit_label_model(votes, np.array([n for _, n in own], np.float64), prior=0.3)
        out |= {(kind, v): float(p) for (v, _), p in zip(own, model.posterior(votes), strict=True)}
    return out


def personal_data(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added: spans (start, kind, end) of every document, in order."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = "array<struct<start:int,n:int,end:int>>, more array<struct<start:int,end:int,kind:string,votes:string,own:array<int>>>"
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_read_texts, f"doc_id long, base {kind}"))
    each = rows.filter(F.size("more") > 0).select(F.explode("more").alias("x")).select("x.kind", "x.votes", "x.own")
    patterns = [(r["kind"], r["votes"], r["n"]) for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()]
    labels = kind_posteriors(patterns)
    weights = np.zeros(DIMENSIONS + 1, np.float32)
    if labels:
        known = F.broadcast(spark.createDataFrame([(k, v, p) for (k, v), p in labels.items()], "kind string, votes string, p double"))
        labelled = each.join(known, ["kind", "votes"]).withColumn("pick", F.xxhash64("own", "votes"))
        chosen = [r for which in ("p >= 0.5", "p < 0.5") for r in labelled.filter(which).orderBy("pick", "own").limit(sample).select("own", "p").collect()]
        weights = train_scorer([np.array(r["own"], np.int32) for r in chosen], np.array([r["p"] for r in chosen]), DIMENSIONS)
    shared = spark.sparkContext.broadcast(weights)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            added = []
            for found in batch.column(2).to_pylist():
                kept, free = [], -1
                for x in sorted(found, key=lambda x: (x["start"], x["kind"])):
                    if x["start"] >= free and score(np.array(x["own"], np.int32), learned) >= threshold:
                        kept.append({"start": x["start"], "n": len(KINDS) + MORE_KINDS.index(x["kind"]), "end": x["end"]})
                        free = x["end"]
                added.append(kept)
            base = batch.column(1)
            names = pa.array([*KINDS, *MORE_KINDS])
            spans = [x.as_py() for x in base]
            texts = [pa.array([_joined(x, y if k else [], names) for x, y in zip(spans, added, strict=True)], pa.string()) for k in (0, 1)]
            counts = [pa.array([sum(s["n"] == k for s in x) for x in spans], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *texts, *counts, pa.array([len(x) for x in added], pa.int64())], ["doc_id", "base", "spans", *(f"n_{x}" for x in KINDS), "n_added"])

    counts = ", ".join(f"n_{x} long" for x in (*KINDS, "added"))
    return rows.mapInArrow(decide, f"doc_id long, base string, spans string, {counts}")


def _joined(base: list[dict], more: list[dict], names: pa.Array) -> str:
    return ",".join(f"{names[x['n']].as_py()}:{x['start']}:{x['end']}" for x in sorted(base + more, key=lambda x: (x["start"], x["n"])))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
