"""Column expressions for clock strings, durations and sizes. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(us: Column, mark: str = ",", floor: bool = True) -> Column:
    """HH:MM:SS,mmm, rounded half to even. floor: negative times are 0."""
    ms = F.rint((F.greatest(us, F.lit(0)) if floor else us) / 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_clock(text: Column) -> Column:
    """Microseconds of H:M:S,mmm or H:M:S.mmm; null if it can't be read."""
    parts = [F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+)[,.](\d{3})\s*$", k) for k in (1, 2, 3, 4)]
    h, m, s, ms = (F.when(p != "", p).cast("long") for p in parts)
    return ((h * 3600 + m * 60 + s) * 1000 + ms) * 1000


def minutes(us: Column) -> Column:
    """m:ss of whole seconds."""
    s = F.floor(us / 1_000_000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def hours(us: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(us / 1_000_000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def byte_size(n: Column) -> Column:
    """1.5 KB: one decimal under 10, none from 10 on and for bytes."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**k)
        out = F.when(n >= 1024**k, F.when(v >= 10, F.format_string(f"%.0f {unit}", v)).otherwise(F.format_string(f"%.1f {unit}", v))).otherwise(out)
    return out


def motion_class(score: Column, static: float = 1.5, active: float = 8.0) -> Column:
    return F.when(score.isNull(), "unknown").when(score < static, "static").when(score > active, "active").otherwise("review")


def needs_presplit(us: Column, kind: Column) -> Column:
    return F.when(kind == "video", us >= 1_200_000_000).otherwise(us > 1_800_000_000)


def chunk_count(us: Column) -> Column:
    m = us / 60_000_000.0
    return F.when(m < 20, 1).otherwise(F.greatest(F.lit(2), F.floor(m / 2.5 + 0.5))).cast("long")
