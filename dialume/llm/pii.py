"""Personal data in texts, in DataFrame operations only; one pass, no shuffle.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for bank account numbers), and words near a span adjust its score. The
four base kinds are reported whenever their own check passes; the further kinds
(``iban``, ``ssn``) only from a score of 0.5 on.

The patterns are written so that the regex engine never retries inside a run of
characters: possessive quantifiers, and a look-behind that lets a match start
only where a run starts (or where the last match ended). They find the same
leftmost non-overlapping matches as the plain patterns, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_view

LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a span that passed its check, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST = 0.3, 40, 0.5
CONTEXT = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|master|credit|pay",
    "phone": r"(?i)phone|call|tel|mobile|fax",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    compact = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: F.when(F.length(short(p)) > 3, False).when(F.length(short(p)) == 3, short(p) <= "255").otherwise(True)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


#: Elements that a scan holds in one growing array; arrays of arrays hold the rest.
STRETCH = 128


def stretches(items: Column) -> Column:
    """An array cut into arrays of ``STRETCH`` elements."""
    n = F.size(items)
    each = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int")), lambda i: F.slice(items, i * STRETCH + 1, F.lit(STRETCH)))
    return F.when(n > 0, each)


def scan(cut: Column, step, kind: str) -> Column:
    """All that ``step`` puts out over the elements of ``cut`` (see ``stretches``),
    in order. ``step(at, x)`` gives the next place ``at`` and what to put out
    (null: nothing), of type ``kind``. An array grows by copies, so each stretch
    has its own: the work is in proportion to the number of elements."""
    none = F.from_json(F.lit("[]"), f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        at, found = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        before = F.coalesce(F.get(acc, F.size(acc) - 1)["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(part, F.struct(before.alias("at"), none.alias("out")), one)))

    parts = F.aggregate(cut, F.from_json(F.lit("[]"), f"array<struct<at:int,out:array<{kind}>>>"), stretch)
    return F.coalesce(F.filter(F.flatten(F.transform(parts, lambda p: p["out"])), lambda x: x.isNotNull()), none)


SPAN = "struct<start:int,end:int,score:double>"


def _pairs(kind: str, text: Column, matches: Column) -> Column:
    """Every match with the text since the one before."""
    pieces = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(matches))
    return F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))


def _spans(kind: str, cut: Column) -> Column:
    """array<struct<start, end, score>> of the matches that count."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        piece, m = x["piece"], x["m"]
        start = at + F.length(piece)
        end = start + F.length(m)
        near = F.right(piece, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        counts = _valid(kind, m) if kind in BASE else _valid(kind, m) & (score >= LEAST)
        return end, F.when(counts, F.struct(start.alias("start"), end.alias("end"), score.alias("score")))

    return scan(cut, step, SPAN)


def _with_spans(docs: DataFrame, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """``docs`` with a column of spans for each kind. What is used twice is a
    column of its own, so that no expression is worked out for every match."""
    whole = F.col(text)
    for kind in kinds:
        matches = F.regexp_extract_all(whole, F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDS:
            matches = F.when(F.instr(whole, NEEDS[kind]) > 0, matches).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn(f"_m_{kind}", matches)
    for kind in kinds:
        found = F.col(f"_m_{kind}")
        docs = docs.withColumn(f"_p_{kind}", F.when(F.size(found) > 0, _pairs(kind, whole, found)))
    for kind in kinds:
        docs = docs.withColumn(f"_c_{kind}", stretches(F.col(f"_p_{kind}")))
    none = F.array().cast(f"array<{SPAN}>")
    for kind in kinds:
        cut = F.col(f"_c_{kind}")
        docs = docs.withColumn(kind, F.when(cut.isNotNull(), _spans(kind, cut)).otherwise(none))
    return docs.drop(*[f"_{x}_{k}" for x in "mpc" for k in kinds])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """``_id``, ``_text`` and, per kind, the spans (start, end in code points, end exclusive; score).

    One row for each row of ``docs``, repeated identifiers included; a null text
    is empty and has no spans; an empty table gives no rows; other columns are
    ignored. The work grows in proportion to the text and its matches.
    """
    return _with_spans(documents_view(docs, id_col, text_col), "_text", kinds)


def spans_text(*kinds: str) -> Column:
    """kind:start:end of every span, comma-joined, by kind as given and then start."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


#: Characters of a block that a masked text is cut from.
BLOCK = 1024


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", token: str = "<{}>") -> DataFrame:
    """``docs``, all its columns, with a token in the place of every confirmed span
    of the text; of overlapping spans the first, then the shortest, is replaced.
    Null texts become empty ones; columns of any names are kept."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = _with_spans(held, "_text", tuple(PATTERNS))

    def tokens(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(token.format(kind)).alias("kind")))

    found = found.select("_row", "_text", F.array_sort(F.concat(*map(tokens, PATTERNS))).alias("_all"))
    found = found.withColumn("_cut", stretches(F.col("_all")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fits = s["start"] >= at
        return F.when(fits, s["end"]).otherwise(at), F.when(fits, F.struct(at.alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    found = found.withColumn("_used", scan(F.col("_cut"), step, "struct<from:int,start:int,end:int,kind:string>"))
    found = found.withColumn("_blocks", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        near = F.array_join(F.slice("_blocks", first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
        return F.substring(near, a - first * BLOCK + 1, b - a)

    last = F.element_at("_used", -1)["end"]
    pieces = F.transform("_used", lambda s: F.concat(between(s["from"], s["start"]), s["kind"]))
    masked = F.when(F.size("_used") > 0, F.concat(F.array_join(pieces, ""), between(last, F.length("_text")))).otherwise(F.col("_text"))
    out = found.select("_row", masked.alias("_masked"))
    return out.select(*[F.col("_masked").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
