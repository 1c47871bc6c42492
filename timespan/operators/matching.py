"""Phrases in token sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timespan.functions.text import search_phrase, search_text


def _live(tokens: DataFrame) -> DataFrame:
    """Tokens in order; run changes where a token that can't match (blank, or no word) breaks the sequence."""
    w = Window.partitionBy("media_id").orderBy("pos")
    ok = F.col("type").isin("word", "punctuation") & (F.btrim("text") != "")
    return tokens.withColumn("run", F.sum((~ok).cast("int")).over(w)).filter(ok).withColumn("low", search_text(F.col("text")))


def match_parts(tokens: DataFrame, parts: list[str]) -> DataFrame:
    """Places where contiguous tokens equal the parts, overlapping ones included: first and last position."""
    w = Window.partitionBy("media_id", "run").orderBy("pos")
    df = _live(tokens)
    hit = F.col("low") == search_phrase(parts[0])
    for k, part in enumerate(parts[1:], 1):
        hit = hit & (F.lead("low", k).over(w) == search_phrase(part))
    last = F.lead("pos", len(parts) - 1).over(w) if len(parts) > 1 else F.col("pos")
    return df.withColumn("hit", hit).withColumn("last_pos", last).filter("hit").select("media_id", F.col("pos").alias("first_pos"), "last_pos")


def match_joined(tokens: DataFrame, phrase: str) -> DataFrame:
    """Places where contiguous tokens, joined, equal the phrase without its spaces."""
    wanted = "".join(search_phrase(phrase).split())
    w = Window.partitionBy("media_id", "run").orderBy("pos")
    ends = _live(tokens).withColumn("end", F.sum(F.length("low")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # each token has a character or more, so a match has as many tokens as the phrase has characters at most
    ahead = ends.withColumn("ahead", F.collect_list(F.struct("low", "end", "pos")).over(w.rowsBetween(0, len(wanted) - 1)))
    last = F.filter("ahead", lambda x: x["end"] == F.col("end") - F.length("low") + len(wanted))
    found = ahead.filter(F.startswith(F.array_join(F.col("ahead.low"), ""), F.lit(wanted))).withColumn("last_pos", F.get(last, F.lit(0))["pos"])
    return found.filter("last_pos IS NOT NULL").select("media_id", F.col("pos").alias("first_pos"), "last_pos")


#: Stands between tokens where phrases of several parts are looked for; no live token has it.
_BETWEEN = "\0"


def _automata(phrases: list[str], joined: bool = True) -> tuple[Automaton, Automaton]:
    """Phrases of several parts as `|part|part|`, single ones as the characters they are; not joined: these as `|part|` too."""
    found: tuple[dict, dict] = {}, {}
    for k, phrase in enumerate(phrases):
        own = search_phrase(phrase)
        several = not joined or len(phrase.split()) > 1
        key = _BETWEEN + "".join(p + _BETWEEN for p in own.split()) if several else own
        found[not several].setdefault(key, ([], len(own.split()) if several else len(own)))[0].append(k)
    automata = Automaton(), Automaton()
    for automaton, words in zip(automata, found, strict=True):
        for key, value in words.items():
            automaton.add_word(key, value)
        if words:
            automaton.make_automaton()
    return automata


def _found(automata: tuple[Automaton, Automaton], lows: list[str]) -> list[tuple[int, int, int]]:
    """(phrase, first, last token) of all matches in a run of tokens, in one pass for each automaton."""
    parts, joined = automata
    out = []
    if len(parts):
        text = _BETWEEN + "".join(x + _BETWEEN for x in lows)
        ends = {e: k for k, e in enumerate(accumulate(len(x) + 1 for x in lows))}  # where the mark behind token k stands
        out += [(k, ends[end] - n + 1, ends[end]) for end, (own, n) in parts.iter(text) for k in own]
    if len(joined):
        ends = {e: k for k, e in enumerate(accumulate(map(len, lows)))}
        starts = {0: 0} | {e: k + 1 for e, k in ends.items()}
        for end, (own, n) in joined.iter("".join(lows)):
            if end + 1 in ends and end + 1 - n in starts:
                out += [(k, starts[end + 1 - n], ends[end + 1]) for k in own]
    return out


def match_phrases(tokens: DataFrame, phrases: list[str], joined: bool = True) -> DataFrame:
    """media_id, phrase, first_pos, last_pos of all places of all phrases: a phrase of several parts matches token by token, a single one what tokens are joined.

    Not joined: a single one matches whole tokens only.

    All phrases are in two automata, which a task builds once; a run of tokens without a break between them is read
    once, however many phrases there are. phrases is the caller's list.
    """
    wanted = list(dict.fromkeys(p.strip() for p in phrases if p.strip() and _BETWEEN not in p))
    kinds = [("phrase", pa.string()), ("first_pos", pa.int64()), ("last_pos", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(wanted, joined)
        for batch in batches:
            rows, at = [], []
            for k, own in enumerate(batch.column(1).to_pylist()):
                for p, a, b in _found(automata, [x["low"].replace(_BETWEEN, "\ufffe") for x in own]):
                    at.append(k)
                    rows.append((wanted[p], own[a]["pos"], own[b]["pos"]))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            media = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([media, *(pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True))], ["media_id", *(n for n, _ in kinds)])

    held = _live(tokens).groupBy("media_id", "run").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "low"))).alias("own"))
    kind = tokens.schema["media_id"].dataType.simpleString()
    return held.select("media_id", "own").mapInArrow(run, f"media_id {kind}, phrase string, first_pos long, last_pos long")


def match_fillers(tokens: DataFrame, phrases: list[str], joined: bool = True) -> DataFrame:
    """The distinct positions that any of the phrases covers. phrases is the caller's list; repeated ones count once."""
    found = match_phrases(tokens, phrases, joined)
    return found.select("media_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).distinct()


def silence_ranges(tokens: DataFrame) -> DataFrame:
    """media_id, start_us, end_us of all silence tokens, to be cut."""
    return tokens.filter("kind = 'silence'").select("media_id", "start_us", "end_us")


def keys_between(tokens: DataFrame, picks: DataFrame) -> DataFrame:
    """Positions from one picked key to another, in either order; only the end where the start isn't known."""
    at = tokens.select("media_id", "key", "pos")
    ends = picks.join(at.withColumnRenamed("key", "to_key").withColumnRenamed("pos", "b"), ["media_id", "to_key"])
    both = ends.join(at.withColumnRenamed("key", "from_key").withColumnRenamed("pos", "a"), ["media_id", "from_key"], "left").withColumn("a", F.coalesce("a", "b"))
    return both.select("media_id", "from_key", "to_key", F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))).alias("pos"))
