"""Segmentation of words, texts and speech. Folds whose state depends on earlier breaks run per medium; the rest are windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timespan.functions.clock import chunk_count
from timespan.functions.text import FULL_MARKS, HALF_MARKS, half_after_latin
from timespan.operators import intervals as iv

#: Marks that end a sentence, that end a clause, and that end a subtitle line. Fixed values.
SENTENCE_MARKS, CLAUSE_MARKS, LINE_MARKS = "。！？.!?", "，；,;：:", "，。？！；：…—、.,!?;:"
_HALF = str.maketrans(FULL_MARKS, HALF_MARKS)
#: Marks that give way to a mark that follows them. Fixed values.
_YIELDING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "。，、！？；："


def token_classes(words: DataFrame) -> DataFrame:
    """words with what joining them asks for: mark (no letters or digits), head and tail (Latin at its start, end but for marks)."""
    return words.withColumns({
        "mark": F.regexp_like("text", F.lit(r"(?U)^[^\w\s]+$")), "head": F.regexp_like("text", F.lit(r"(?U)^[^\w\s]*[a-zA-Z0-9]")),
        "tail": F.regexp_like("text", F.lit(r"(?U)[a-zA-Z0-9][^\w\s]*$")),
    })


class Sentence:
    """Tokens that are joined as they come."""

    def __init__(self, token) -> None:
        self.start, self.end, self.text, self.tail, self.n = token.start_us, token.end_us, token.text, token.tail, 1

    def add(self, token) -> None:
        if token.mark:
            self.text = self.text.rstrip(_YIELDING)
        between = " " if (self.tail or token.head) and not self.text.endswith(" ") else ""
        self.text += between + (token.text.translate(_HALF) if token.mark and self.tail else token.text)
        self.end, self.tail, self.n = token.end_us, token.tail, self.n + 1

    def closed(self, chars: int, longest: int) -> bool:
        """Whether its last mark ends it: marks of clauses only where it is half full."""
        said = self.text.strip()
        half_full = len(said) >= chars / 2 or self.end - self.start >= longest / 2
        return said.endswith(tuple(SENTENCE_MARKS)) or (half_full and said.endswith(tuple(CLAUSE_MARKS)))

    def takes(self, token, chars: int, longest: int) -> bool:
        return len(self.text) + len(token.text) <= chars and token.end_us - self.start <= longest and not self.closed(chars, longest)


def sentences(words: DataFrame, chars: int = 40, longest: int = 7_000_000, gap: int = 600_000) -> DataFrame:
    """Sentences of each medium's words: sent_idx, start_us, end_us, text, n_words. Gaps are found by a window, the rest by a fold."""
    order = ["start_us", "end_us", "seg_idx", "word_idx"]
    apart = F.coalesce(F.col("start_us") - F.lag("end_us").over(Window.partitionBy("media_id").orderBy(*order)) > gap, F.lit(True))
    classed = token_classes(words.select("media_id", "seg_idx", "word_idx", "text", "start_us", "end_us")).withColumn("apart", apart)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[Sentence] = []
        for w in pdf.sort_values(order).itertuples():
            if w.apart or not out[-1].takes(w, chars, longest):
                out.append(Sentence(w))
            else:
                out[-1].add(w)
        return pd.DataFrame([(pdf["media_id"].iloc[0], k, x.start, x.end, x.text.strip(), x.n) for k, x in enumerate(out)], columns=["media_id", "sent_idx", "start_us", "end_us", "text", "n_words"])

    return classed.groupBy("media_id").applyInPandas(run, "media_id long, sent_idx long, start_us long, end_us long, text string, n_words long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _folded(text: Column) -> Column:
    """text in lower case, character by character."""
    return F.lower(F.translate(text, "İ", "i"))


def marked_words(raw: Column, words: Column, low: Column, lows: Column) -> Column:
    """The array of words (raw and words in lower case are low and lows), each with the first mark that follows it in raw, in half width after Latin; others stay.

    A fold over the words keeps the place in raw from which the next one is looked for, without regard to case. It is
    behind a found word's marks or, without marks, where the next word stands (behind the text if it stands nowhere).
    """
    def step(state: Column, k: Column) -> Column:
        def marks_of(gap: Column) -> Column:
            return F.regexp_extract(F.substr(raw, gap["end"], gap["next"] - gap["end"]), r"(?U)^[^\w\s]*", 0)

        def kept(at: Column, mark: Column) -> Column:
            return F.struct(at.alias("at"), F.concat(state["marks"], F.array(mark)).alias("marks"))

        def gap_after(place: Column) -> Column:
            end = place + F.length(F.element_at(lows, k))
            following = F.nullif(F.position(F.get(lows, k), low, end), F.lit(0))
            return F.struct(end.alias("end"), F.coalesce(following, F.length(raw) + 1).alias("next"))

        def found(place: Column) -> Column:
            return _let(gap_after(place), lambda gap: _let(marks_of(gap), lambda m: kept(
                F.when(m == "", gap["next"]).otherwise(gap["end"] + F.length(m)), F.left(m, F.lit(1))
            )))

        place = F.position(F.element_at(lows, k), low, state["at"])
        return _let(place, lambda p: F.when(p > 0, found(p)).otherwise(kept(state["at"], F.lit(""))))

    start = F.expr("struct(1 AS at, cast(array() AS array<string>) AS marks)")
    marks = F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step, lambda state: state["marks"])
    return F.zip_with(words, marks, lambda w, m: F.when(m == "", w).otherwise(
        F.concat(F.rtrim(w, F.lit(_YIELDING)), half_after_latin(m, w))
    ))


def with_marks(stamps: DataFrame, chunks: DataFrame) -> DataFrame:
    """stamps with the marks of their chunk's text; those of a chunk without a text stay."""
    item = F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), "start_us", "end_us")
    held = stamps.groupBy("media_id", "chunk_idx").agg(F.sort_array(F.collect_list(item)).alias("w"))
    raw = chunks.select("media_id", "chunk_idx", F.coalesce("text", F.lit("")).alias("raw"))
    df = held.join(raw, ["media_id", "chunk_idx"], "left").fillna("", ["raw"])
    df = df.withColumns({"low": _folded(F.col("raw")), "words": F.col("w.text"), "lows": F.transform("w.text", _folded)})
    df = df.withColumn("said", marked_words(*(F.col(c) for c in ("raw", "words", "low", "lows"))))
    each = df.select("media_id", "chunk_idx", F.explode(F.arrays_zip("w", "said")).alias("x"))
    return each.select("media_id", "chunk_idx", "x.w.pos", F.col("x.said").alias("text"), "x.w.start_us", "x.w.end_us")


_LINE_ENDS = re.compile(f"[{re.escape(LINE_MARKS)}]")
_SPACED_UNITS = re.compile("( *)([A-Za-z]+|[^A-Za-z ])", re.S)


def lines_of(text: str, chars: int = 20) -> list[str]:
    """Lines of a text: marks end them and go, Latin words stay whole, and no line is longer than chars but for one word or a character right after a word."""
    before, marker, after = text.partition("<asr_text>")
    said, out = after if marker else before, []
    for piece in _LINE_ENDS.split(said.strip()):
        line, after_word = "", False
        for space, unit in _SPACED_UNITS.findall(piece):
            word = unit.isascii() and unit.isalpha()
            between = " " if line and (space or word) else ""
            fits = len(line + between + unit) <= chars if word else len(line) < chars or after_word and not space
            if not fits and (line.strip() or not word):
                out.append(line)
                line, between = "", ""
            line, after_word = line + between + unit, word
        out.append(line)
    return [x.strip() for x in out if x.strip()]


def text_lines(texts: DataFrame, chars: int = 20) -> DataFrame:
    """line_idx, line of each text."""

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: lines_of(t, chars))

    return texts.select("media_id", "seg_idx", F.posexplode(split("text")).alias("line_idx", "line"))


def hard_lines(texts: DataFrame, chars: int = 20) -> DataFrame:
    """The plainer split: pieces between marks, in lengths of chars at most. Built-in functions only."""
    pieces = F.filter(F.transform(F.split("text", r"[，。？！；：…—、.,!?;:\n]+"), lambda x: F.btrim(x)), lambda x: x != "")
    cut = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / chars).cast("int")), lambda i: F.substr(p, i * chars + 1, F.lit(chars)))))
    return texts.select("media_id", "seg_idx", F.posexplode(cut).alias("line_idx", "line"))


def _line_numbers(items: Column, words: int, chars: int) -> Column:
    """The line of each word (chars, latin): one that has too many words, or characters if none is Latin, is the last of its line."""
    start = F.expr("struct(0 AS line, 0 AS n, 0 AS chars, false AS latin, cast(array() AS array<int>) AS lines)")

    def add(s: Column, x: Column) -> Column:
        n, size, latin = s["n"] + 1, s["chars"] + x["chars"], s["latin"] | x["latin"]
        full = F.when(latin, n > words).otherwise(size > chars)
        zero = F.lit(0)
        return F.struct(
            (s["line"] + full.cast("int")).alias("line"), F.when(full, zero).otherwise(n).alias("n"), F.when(full, zero).otherwise(size).alias("chars"),
            (latin & ~full).alias("latin"), F.concat(s["lines"], F.array(s["line"])).alias("lines"),
        )

    return F.aggregate(items, start, add, lambda s: s["lines"])


def aligned_lines(stamps: DataFrame, chunks: DataFrame, words: int = 8, chars: int = 20) -> DataFrame:
    """Subtitle lines of aligned words: marks before a word in the chunk's text end a line, as do too many words or characters.

    A word stands where as many characters of the text, marks and spaces left out, come before it as the words before it
    have; marks are at the running lengths of the pieces between them. Between marks a fold counts words and characters.
    """
    chunk = ["media_id", "chunk_idx"]
    w = Window.partitionBy(*chunk).orderBy("pos")
    placed = stamps.select(*chunk, "pos", "text", "start_us", "end_us").filter("text <> ''").withColumn("place", F.sum(F.length("text")).over(w) - F.length("text"))
    pieces = chunks.select(*chunk, F.posexplode(F.split(F.replace("text", F.lit(" ")), f"[{re.escape(LINE_MARKS)}]+", -1)).alias("nth", "piece"))
    ends = pieces.withColumn("place", F.sum(F.length("piece")).over(Window.partitionBy(*chunk).orderBy("nth")))
    ends = ends.withColumn("last", F.max("nth").over(Window.partitionBy(*chunk))).filter("nth < last").select(*chunk, "place", F.lit(1).alias("ends")).distinct()
    runs = placed.join(ends, [*chunk, "place"], "left").withColumn("run", F.sum(F.coalesce("ends", F.lit(0))).over(w))
    item = F.struct("pos", "text", "start_us", "end_us", F.length("text").alias("chars"), F.regexp_like("text", F.lit("[A-Za-z]")).alias("latin"))
    held = runs.groupBy(*chunk, "run").agg(F.sort_array(F.collect_list(item)).alias("own"))
    each = held.select(*chunk, "run", F.explode(F.arrays_zip("own", _line_numbers(F.col("own"), words, chars).alias("line"))).alias("x"))
    each = each.select(*chunk, "run", "x.line", "x.own.*")
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    edges = F.min("pos").alias("pos"), F.min_by("start_us", "pos").alias("start_us"), F.max_by("end_us", "pos").alias("end_us")
    lines = each.groupBy(*chunk, "run", "line").agg(*edges, said.alias("said"), F.bool_or("latin").alias("latin"))
    lines = lines.withColumn("text", F.btrim(F.when(F.col("latin"), F.array_join("said", " ")).otherwise(F.array_join("said", ""))))
    lines = lines.filter("text <> '' AND end_us > start_us")
    return lines.select(*chunk, (F.row_number().over(w) - 1).alias("line_idx"), "start_us", "end_us", "text")


def speech_runs(vad: DataFrame, threshold: float = 0.5, least: int = 16, pad: int = 5, join: int = 16) -> DataFrame:
    """Padded runs of speech chunks, merged where at most `join` chunks apart: first and end chunk."""
    w = Window.partitionBy("media_id").orderBy("chunk_idx")
    total = vad.groupBy("media_id").agg((F.max("chunk_idx") + 1).alias("n"))
    marked = vad.withColumn("on", (F.col("prob") >= threshold).cast("int"))
    runs = marked.withColumn("run", F.sum((F.col("on") != F.coalesce(F.lag("on").over(w), F.lit(-1))).cast("int")).over(w)).filter("on = 1")
    runs = runs.groupBy("media_id", "run").agg(F.min("chunk_idx").alias("a"), (F.max("chunk_idx") + 1).alias("b")).filter(F.col("b") - F.col("a") >= least)
    padded = runs.join(total, "media_id").select("media_id", F.greatest(F.col("a") - pad, F.lit(0)).alias("start_us"), F.least(F.col("b") + F.when(F.col("b") == F.col("n"), 0).otherwise(pad), "n").alias("end_us"))
    return iv.merge(padded, join).select("media_id", F.col("start_us").alias("first"), F.col("end_us").alias("last"))


def speech_groups(runs: DataFrame, chunk: int = 512, rate: int = 16_000, longest_s: int = 20, whole_seconds: bool = True, least_s: float = 1.0) -> DataFrame:
    """Neighbouring runs grouped while a group is no longer than longest_s, from a fold over each medium's few runs."""
    ordered = F.sort_array(F.collect_list(F.struct((F.col("first") * chunk).alias("s"), (F.col("last") * chunk).alias("e"))))
    start = F.expr("struct(cast(array() AS array<struct<s:bigint,e:bigint>>) AS done, cast(null AS bigint) AS s, cast(null AS bigint) AS e)")

    def add(state: Column, x: Column) -> Column:
        over = state["s"].isNotNull() & (x["e"] - state["s"] > longest_s * rate)
        done = F.when(over, F.concat(state["done"], F.array(F.struct(state["s"].alias("s"), state["e"].alias("e"))))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(over | state["s"].isNull(), x["s"]).otherwise(state["s"]).alias("s"), x["e"].alias("e"))

    folded = runs.groupBy("media_id").agg(F.aggregate(ordered, start, add).alias("f"))
    groups = folded.select("media_id", F.explode(F.concat("f.done", F.array(F.struct(F.col("f.s").alias("s"), F.col("f.e").alias("e"))))).alias("g"))
    length = F.greatest(F.floor((F.col("g.e") - F.col("g.s")) / rate), F.lit(1)) * rate if whole_seconds else F.col("g.e") - F.col("g.s")
    df = groups.select("media_id", F.col("g.s").alias("start"), length.cast("long").alias("samples"), (F.col("g.e") - F.col("g.s")).alias("has"))
    df = df.filter(F.col("has") >= least_s * rate)
    return df.select("media_id", F.rint(F.col("start") * 1e6 / rate).cast("long").alias("start_us"), F.rint((F.col("start") + F.col("samples")) * 1e6 / rate).cast("long").alias("end_us"))


def keyframe_splits(totals: DataFrame, keyframes: DataFrame, least_us: int = 1_200_000_000, count: int | None = None) -> DataFrame:
    """0, a keyframe at least 0.9 of the target length after the last cut for each further piece, and the end."""
    times = keyframes.groupBy("media_id").agg(F.sort_array(F.collect_set("t_us")).alias("ks"))
    n = F.lit(count).cast("long") if count and count >= 2 else chunk_count(F.col("total_us"))
    df = totals.join(times, "media_id", "left").withColumn("n", n).withColumn("ks", F.coalesce("ks", F.expr("cast(array() AS array<bigint>)")))
    df = df.withColumn("need", F.col("total_us") / F.col("n") * 0.9)
    start = F.array(F.lit(0).cast("long"))

    def cut(points: Column, t: Column) -> Column:
        take = (F.size(points) < F.col("n")) & (t - F.element_at(points, -1) >= F.col("need"))
        return F.when(take, F.concat(points, F.array(t))).otherwise(points)

    points = F.when(F.col("total_us") < least_us, start).otherwise(F.aggregate("ks", start, cut))
    points = F.when(F.element_at(points, -1) == F.col("total_us"), points).otherwise(F.concat(points, F.array("total_us")))
    return df.select("media_id", F.posexplode(points).alias("point_idx", "t_us"))


def line_times(lines: DataFrame, least: int = 600_000, pause: int = 80_000) -> DataFrame:
    """Lines of a span (g0_us, g1_us) timed by their lengths, each at least `least`, with pauses between."""
    w = Window.partitionBy("media_id", "seg_idx")
    o = w.orderBy("line_idx")
    df = lines.withColumn("len", F.length("line")).withColumn("sum", F.sum("len").over(w)).filter("sum > 0")
    own = F.greatest(F.lit(least), F.rint((F.col("g1_us") - F.col("g0_us")) * F.col("len") / F.col("sum")).cast("long"))
    df = df.withColumn("own", own).withColumn("k", F.row_number().over(o) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    end = F.col("g0_us") + F.sum("own").over(o) + F.col("k") * pause
    df = df.withColumn("end_us", end).withColumn("start_us", F.col("end_us") - F.col("own"))
    return df.select("media_id", "seg_idx", "line_idx", "line", "start_us", F.when(F.col("k") == F.col("n") - 1, F.greatest("end_us", "g1_us")).otherwise(F.col("end_us")).alias("end_us"))


def fixed_slots(lines: DataFrame, slot: int = 5_000_000, pause: int = 0) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("media_id").orderBy("line_idx")) - 1
    return lines.withColumn("k", k).select("media_id", "line_idx", (F.col("k") * (slot + pause)).cast("long").alias("start_us"), (F.col("k") * (slot + pause) + slot).cast("long").alias("end_us"))


def spread(tokens: DataFrame, least: int = 10_000) -> DataFrame:
    """Tokens of a span (g0_us, g1_us) timed by their characters; the last ends with it. An empty span counts as 10 ms a token."""
    w = Window.partitionBy("media_id", "seg_idx")
    o = w.orderBy("pos")
    df = tokens.withColumn("weight", F.greatest(F.length("text"), F.lit(1))).withColumn("all", F.sum("weight").over(w)).withColumn("run", F.sum("weight").over(o)).withColumn("n", F.count(F.lit(1)).over(w))
    dur = F.when(F.col("g1_us") > F.col("g0_us"), F.col("g1_us") - F.col("g0_us")).otherwise(F.col("n") * least)

    def at(run: Column) -> Column:
        return F.col("g0_us") + F.floor(dur * run / F.col("all"))

    return df.select("media_id", "seg_idx", "pos", "text", at(F.col("run") - F.col("weight")).alias("start_us"), at(F.col("run")).alias("end_us"))


def allot_stamps(units: DataFrame, stamps: DataFrame) -> DataFrame:
    """Times of word units (media_id, seg_idx, pos, text) from stamps (media_id, seg_idx, k, start_us, end_us) in order.

    Each unit takes one stamp while there are any. More stamps than units go round the Latin units, the longest first;
    without Latin units, to the last one. A unit's time is that of its first stamp's start and its last one's end.
    """
    seg = Window.partitionBy("media_id", "seg_idx")
    counted = stamps.groupBy("media_id", "seg_idx").agg(F.count(F.lit(1)).alias("stamps"))
    df = units.join(counted, ["media_id", "seg_idx"]).withColumn("latin", F.regexp_like("text", F.lit("^[A-Za-z0-9]+$")))
    df = df.withColumn("extra", F.greatest(F.col("stamps") - F.count(F.lit(1)).over(seg), F.lit(0))).withColumn("n_latin", F.sum(F.col("latin").cast("int")).over(seg))
    df = df.withColumn("rank", F.row_number().over(seg.orderBy(F.desc("latin"), F.when(F.col("latin"), -F.length("text")), "pos")) - 1).withColumn("back", F.row_number().over(seg.orderBy(F.desc("pos"))))
    share = F.floor(F.col("extra") / F.col("n_latin")) + (F.col("rank") < F.col("extra") % F.col("n_latin")).cast("int")
    more = F.when(F.col("n_latin") > 0, F.when(F.col("latin"), share).otherwise(0)).otherwise(F.when(F.col("back") == 1, F.col("extra")).otherwise(0))
    df = df.withColumn("take", more + 1).withColumn("last", F.sum("take").over(seg.orderBy("pos"))).withColumn("first", F.col("last") - F.col("take") + 1)
    df = df.filter("first <= stamps").withColumn("last", F.least("last", "stamps"))
    s = stamps.select("media_id", "seg_idx", (F.row_number().over(seg.orderBy("k"))).alias("nth"), "start_us", "end_us")
    a = s.select("media_id", "seg_idx", F.col("nth").alias("first"), "start_us")
    b = s.select("media_id", "seg_idx", F.col("nth").alias("last"), "end_us")
    return df.join(a, ["media_id", "seg_idx", "first"]).join(b, ["media_id", "seg_idx", "last"]).select("media_id", "seg_idx", "pos", "text", "start_us", "end_us")


def pause_tokens(words: DataFrame, near: int = 100, short: int = 600_000, comma: int = 1_100_000, silence: int = 1_600_000) -> DataFrame:
    """Words and the tokens that their gaps become: kind, text, start_us, end_us, attached (to the segment before).

    In a segment a gap shorter than `short` lengthens the word before it, one of `silence` or more is a silence, and
    others are marks. A gap between segments is always a mark, attached to the segment before.
    """
    w = Window.partitionBy("media_id").orderBy("seg_idx", "word_idx")
    df = words.select("media_id", "seg_idx", "word_idx", "text", "start_us", "end_us").withColumn("prev_end", F.lag("end_us").over(w)).withColumn("prev_seg", F.lag("seg_idx").over(w)).withColumn("next_start", F.lead("start_us").over(w)).withColumn("next_seg", F.lead("seg_idx").over(w))
    after = F.col("next_start") - F.col("end_us")
    longer = (F.col("next_seg") == F.col("seg_idx")) & (after > 0) & (after < short)
    spoken = df.select("media_id", "seg_idx", "word_idx", F.lit("word").alias("kind"), "text", "start_us", F.when(longer, F.col("next_start")).otherwise(F.col("end_us")).alias("end_us"), F.lit(False).alias("attached"))
    gap, inner = F.col("start_us") - F.col("prev_end"), F.col("prev_seg") == F.col("seg_idx")
    kind = F.when(inner & (gap >= silence), "silence").otherwise("punctuation")
    mark = F.when(kind == "punctuation", F.when(gap < comma, "，").otherwise("。"))
    gaps = df.filter((inner & (gap >= short)) | (~inner & (gap > near)))
    return spoken.unionByName(gaps.select("media_id", F.col("prev_seg").alias("seg_idx"), "word_idx", kind.alias("kind"), mark.alias("text"), F.col("prev_end").alias("start_us"), F.col("start_us").alias("end_us"), (~inner).alias("attached")))
