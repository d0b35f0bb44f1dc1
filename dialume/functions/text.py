"""Text functions, as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scripts
from .udf import batched

#: Bracketed asides and punctuation that scoring removes.
BRACKETS = r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>"
PUNCTUATION = r"[!-/:-@\[-`{-~।॥‐-‧‰-⁞¡-¿]"
#: The language that a script stands for, by the script's name.
LANGUAGES = {
    "Devanagari": "Devanagari (hi/mr)",
    "Bengali": "Bengali",
    "Gujarati": "Gujarati",
    "Gurmukhi": "Punjabi",
    "Kannada": "Kannada",
    "Malayalam": "Malayalam",
    "Oriya": "Odia",
    "Tamil": "Tamil",
    "Telugu": "Telugu",
}
#: Scripts that letters are counted for; any that stands for no language of its
#: own is called by its name. The second list is only searched in what the first leaves.
SCRIPTS = [*LANGUAGES, "Latin", "Cyrillic", "Greek", "Arabic", "Cjk"]
MORE_SCRIPTS = (
    "Armenian Balinese Bopomofo Cherokee Coptic Deseret Ethiopic Georgian Glagolitic Gothic Hangul Hebrew Hiragana Javanese Katakana Khmer Lao Lepcha Limbu Lisu "
    "Mongolian Myanmar Nko Ogham Rejang Runic Samaritan Saurashtra Sinhala Sundanese Syriac Tagalog Thaana Thai Tibetan Tifinagh Vai Yi"
).split()
JAVA_NAMES = {"Cjk": "Han"}


def normalise(text: Column) -> Column:
    """Words as they are scored: without bracketed asides and punctuation, in
    lower case. Exact for text in NFC; see ``normalise_unicode`` for any other."""
    plain = F.regexp_replace(F.regexp_replace(text, BRACKETS, " "), PUNCTUATION, " ")
    return F.filter(F.split(F.lower(plain), r"[\s ]+"), lambda w: w != "")


@batched("array<string>")
def normalise_unicode(text: pd.Series) -> pd.Series:
    """The same for any Unicode text: composed first, case-folded, split at any
    white space."""

    def one(t: str | None) -> list[str] | None:
        if t is None:
            return None
        t = re.sub(BRACKETS, " ", unicodedata.normalize("NFC", t))
        return re.sub(PUNCTUATION, " ", t).casefold().split()

    return text.map(one)


def count_reference_words(text: Column) -> Column:
    """Words outside parentheses."""
    return F.size(F.filter(F.split(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+"), lambda w: w != "")).cast("long")


def _letters(script: str) -> str:
    return rf"[\p{{Is{JAVA_NAMES.get(script, script)}}}&&\p{{L}}]"


def script_counts(text: Column) -> dict[str, Column]:
    """Letters of each script outside brackets. Counts add up over texts."""
    plain = F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)", "")
    known = "".join(rf"\p{{Is{JAVA_NAMES.get(s, s)}}}" for s in SCRIPTS)
    rest = F.regexp_replace(plain, rf"[{known}\P{{L}}]+", "")
    counts = {s: F.regexp_count(plain, F.lit(_letters(s))) for s in SCRIPTS}
    return counts | {s: F.when(rest == "", 0).otherwise(F.regexp_count(rest, F.lit(_letters(s)))) for s in MORE_SCRIPTS}


def language_of(counts: dict[str, Column]) -> Column:
    """The language of the script with most letters (of equals the first by
    name); ``unknown`` without any."""
    best = F.array_min(F.array(*[F.struct((-n).alias("n"), F.lit(s).alias("script"), F.lit(LANGUAGES.get(s, s)).alias("name")) for s, n in counts.items()]))
    return F.when(best["n"] < 0, best["name"]).otherwise("unknown")


@batched("string")
def detect_language(text: pd.Series) -> pd.Series:
    """``language_of`` the ``script_counts`` of one text, counted in one pass."""

    def one(t: str | None) -> str:
        script = scripts.main_script(t)
        return "unknown" if script is None else LANGUAGES.get(script, script)

    return text.map(one)


def clip_id(video: Column, start_sec: Column, end_sec: Column) -> Column:
    """Video and window in whole milliseconds, nine digits each; ties to even."""
    ms = lambda c: F.bround(c * 1000, 0).cast("long")
    return F.format_string("%s__%09d_%09d", video, ms(start_sec), ms(end_sec))


def normalise_speaker(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+", "_")


#: Classes of download failures and the patterns that name them, in order.
ERROR_CLASSES = [
    ("bot_gated", r"sign in to confirm|not a bot|confirm you.re not a bot"),
    ("geo_blocked", r"not available in your country|geo restrict|blocked it in your country"),
    ("private", r"private video|this video is private"),
    ("removed", r"removed by the uploader|account associated with this video has been terminated|video has been removed"),
    ("unavailable", r"video unavailable|is unavailable|does not exist|has been deleted|members-only|join this channel"),
    ("age_gated", r"age-restricted|inappropriate for some users"),
    ("no_audio", r"requested format is not available|no audio|only images are available"),
    ("network", r"timed out|timeout|connection reset|temporary failure in name resolution|unable to download|http error 5\d\d|429|too many requests"),
]


def classify_error(message: Column, rules: list[tuple[str, str]] = ERROR_CLASSES) -> Column:
    """The first class whose pattern is found in the lower-cased message, else ``unknown``."""
    out = F.lit("unknown")
    for name, pattern in reversed(rules):
        out = F.when(F.lower(F.coalesce(message, F.lit(""))).rlike(pattern), name).otherwise(out)
    return out


def split_condition(name: Column) -> tuple[Column, Column, Column]:
    """``asr__diar+method`` into its three parts; no method is the baseline."""
    rest = F.element_at(F.split(name, "__", 2), -1)
    parts = F.split(rest, r"\+", 2)
    return F.split(name, "__", 2)[0], parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("baseline"))


def half_up(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits)


def extract_json(reply: str | None) -> dict | None:
    """The first JSON object in a model's reply: fenced or bare, found by matching
    braces; a list that was cut off is closed after its last whole item."""
    if not reply:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", reply, re.DOTALL)
    body = fenced.group(1) if fenced else reply
    at = body.find("{")
    if at < 0:
        return None
    depth, quoted, escaped, whole = 0, False, False, []
    for i in range(at, len(body)):
        c = body[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 2:
                whole.append(i)
            if depth == 0:
                return _object(body[at : i + 1])
    for end in reversed(whole):
        found = _object(body[at : end + 1] + "]}")
        if found is not None:
            return found
    return None


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


@batched("double")
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching words of two word lists, as difflib counts them."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() for x, y in zip(a, b)])


def level_db(samples: Column) -> Column:
    """Level of an array of samples in -1..1, in dB of full scale."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return 20 * F.log10(F.sqrt(square / F.greatest(F.size(samples), F.lit(1))) + 1e-12)
