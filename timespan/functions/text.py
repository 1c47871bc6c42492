"""Column expressions over text: tokens, punctuation, markers, names and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stripped from both ends of a token before it is compared. Fixed values.
TOKEN_MARKS = "，。,.!?！？；;：:…"
#: Full-width marks and the half-width ones that stand after Latin text. Fixed values.
FULL_MARKS, HALF_MARKS = "。，、！？；：", ".,,!?;:"

#: Language names of codes. Fixed values.
LANGUAGES = {"zh": "Chinese", "zh-cn": "Chinese", "zh-tw": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "yue": "Cantonese"}

#: Codes of languages by their names, in English and Chinese. Fixed values.
LANGUAGE_CODES = {
    "Chinese": "zh", "English": "en", "Japanese": "ja", "Korean": "ko", "Cantonese": "yue", "French": "fr", "German": "de", "Spanish": "es", "Portuguese": "pt", "Russian": "ru", "Arabic": "ar",
    "Thai": "th", "Vietnamese": "vi", "Indonesian": "id", "Malay": "ms", "中文": "zh", "英文": "en", "日文": "ja", "韓文": "ko", "法文": "fr", "德文": "de", "西班牙文": "es", "葡萄牙文": "pt",
    "俄文": "ru", "阿拉伯文": "ar", "泰文": "th", "越南文": "vi",
}
#: Languages that are recognised. Fixed values.
RECOGNISED = (
    "Chinese English Cantonese Arabic German French Spanish Portuguese Indonesian Italian Korean Russian Thai Vietnamese Japanese Turkish Hindi Malay Dutch Swedish Danish Finnish Polish Czech "
    "Filipino Persian Greek Romanian Hungarian Macedonian"
).split()

VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "avi", "webm", "flv", "wmv", "m4v")
AUDIO_SUFFIXES = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "wma", "opus")
#: What a batch of files to be transcribed takes. Fixed values.
INGEST_SUFFIXES = ("mp3", "wav", "m4a", "flac", "ogg", "aac", "opus", "wma", "mp4", "mkv", "webm")


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised_token(c: Column) -> Column:
    return F.btrim(F.lower(strip(c)), F.lit(TOKEN_MARKS))


#: Marks of searched text, and what they count as. Fixed values.
SEARCH_MARKS, SEARCH_AS = "、､･※,，.;:!?", "，，，，，，。；：！？"


def wide_punctuation(c: Column) -> Column:
    """White space collapsed, ASCII lower case, marks in full width."""
    plain = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    lowered = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.translate(lowered, SEARCH_MARKS, SEARCH_AS)


def search_text(c: Column) -> Column:
    """Text as it is searched: trimmed, in lower case, marks in full width; inner white space stays."""
    return F.translate(F.lower(strip(c)), SEARCH_MARKS, SEARCH_AS)


def search_phrase(phrase: str) -> str:
    """The same of a caller's phrase."""
    return phrase.strip().lower().translate(str.maketrans(SEARCH_MARKS, SEARCH_AS))


def half_after_latin(mark: Column, before: Column) -> Column:
    """A mark in half width where the text before it ends in Latin letters or digits."""
    return F.when(F.regexp_like(before, F.lit("[A-Za-z0-9]$")), F.translate(mark, FULL_MARKS, HALF_MARKS)).otherwise(mark)


def after_marker(c: Column, marker: str = "<asr_text>") -> Column:
    """What follows the first marker, trimmed; a text without one stays whole."""
    return strip(F.when(F.contains(c, F.lit(marker)), F.substr(c, F.instr(c, marker) + len(marker))).otherwise(c))


def language_name(code: Column) -> Column:
    key = F.lower(strip(code))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(key == "auto", None).otherwise(F.coalesce(known[key], F.initcap(key)))


def language_code(name: Column) -> Column:
    """The code of a language's name; of one that isn't listed, its first two letters."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(known[name], F.lower(F.left(name, F.lit(2))))


def recognised(name: Column) -> Column:
    return name.isin(*RECOGNISED)


def word_key(seg: str, word: str) -> Column:
    return F.concat_ws(":", F.col(seg).cast("string"), F.col(word).cast("string"))


def silence_key(start: str, end: str) -> Column:
    return F.format_string("silence:%.3f-%.3f", F.col(start) / 1e6, F.col(end) / 1e6)


def clean_stem(name: Column, project: Column) -> Column:
    """A file stem without path marks; an empty one is named after the project."""
    clean = F.btrim(F.regexp_replace(name, r'[\\/:*?"<>|]+', "_"), F.lit(" ._"))
    return F.when(clean == "", F.concat(F.lit("project_"), project.cast("string"))).otherwise(clean)


def suffix_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*VIDEO_SUFFIXES), "video").when(suffix.isin(*AUDIO_SUFFIXES), "audio")


def tokens(c: Column) -> Column:
    """ASCII runs of letters and digits, single other characters, single marks; white space goes."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), F.lit(0))
