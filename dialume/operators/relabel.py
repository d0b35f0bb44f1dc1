"""Relabelling of units: a rule, a model behind an interface, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import extract_json
from ..functions.udf import batched
from .intervals import pause_units, units

SHORT_MS = 1_000
#: A prompt's units, how many of them repeat the window before as
#: context, characters of a unit's text, least confidence of an edit.
PROMPT_UNITS, CONTEXT, TEXT_CAP, LEAST_CONFIDENCE = 25, 4, 220, 0.7
#: Edits of a clip beyond this number and share are discarded.
ROGUE_EDITS, ROGUE_SHARE = 3, 0.3
#: Why edits are rejected; ``oom`` counts windows that did not fit.
REASONS = ("parse_fail", "bad_unit", "bad_speaker", "dup", "low_conf", "no_conf", "oom")


def rule_edits(unit_rows: DataFrame, short_ms: int = SHORT_MS) -> DataFrame:
    """``clip_id, unit, old, speaker, confidence``: a unit shorter than
    ``short_ms`` takes the speaker of the closer neighbour, of equals the smaller
    one; neighbours with its own speaker do not count. All decisions are made on
    the labels as they were."""
    w = W.partitionBy("clip_id").orderBy("unit")
    prev = F.struct((F.col("start_ms") - F.lag("end_ms").over(w)).alias("gap"), F.lag("spk").over(w).alias("spk"))
    next_ = F.struct((F.lead("start_ms").over(w) - F.col("end_ms")).alias("gap"), F.lead("spk").over(w).alias("spk"))
    near = unit_rows.withColumn("_near", F.array(prev, next_))
    best = F.array_min(F.filter("_near", lambda c: c["spk"].isNotNull() & (c["spk"] != F.col("spk"))))
    near = near.withColumn("_best", best)
    return near.filter((F.col("end_ms") - F.col("start_ms") < short_ms) & F.col("_best").isNotNull()).select("clip_id", "unit", F.col("spk").alias("old"), F.col("_best")["spk"].alias("speaker"), F.lit(1.0).alias("confidence"))


def apply_edits(words: DataFrame, edits: DataFrame) -> DataFrame:
    """``words`` (with ``unit``) under the edits' speakers; ``relabelled`` and ``conf`` say where."""
    e = edits.select("clip_id", "unit", F.col("speaker").alias("_to"), F.col("confidence").alias("conf"))
    out = words.join(e, ["clip_id", "unit"], "left")
    return out.withColumn("relabelled", F.col("_to").isNotNull()).withColumn("spk", F.coalesce("_to", "spk")).drop("_to")


def guard_rogue(edits: DataFrame, unit_rows: DataFrame, most: int = ROGUE_EDITS, share: float = ROGUE_SHARE) -> DataFrame:
    """``edits`` without those of clips that would change more than ``most`` units
    and more than ``share`` of all."""
    n = unit_rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_units"))
    k = edits.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_edits"))
    rogue = k.join(n, "clip_id").filter((F.col("_edits") > most) & (F.col("_edits") > share * F.col("_units")))
    return edits.join(rogue.select("clip_id"), "clip_id", "left_anti")


def text_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words (number, text, times) that only one side has; relabelling must leave none."""
    cols = ["clip_id", "wid", "w", "start_ms", "end_ms"]
    return before.select(cols).exceptAll(after.select(cols)).unionAll(after.select(cols).exceptAll(before.select(cols)))


def audit(words: DataFrame, truth: DataFrame, gap_ms: int | None) -> DataFrame:
    """Words that relabelling units cannot put right: those of units whose words
    have more than one true speaker. ``truth``: ``clip_id, wid, true_spk`` (null
    where unknown, and then ignored)."""
    u = pause_units(words, gap_ms).join(truth, ["clip_id", "wid"], "left")
    per = u.groupBy("clip_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("true_spk").alias("k"))
    return per.groupBy("clip_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_units"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("n_mixed_words"))


def prompt_windows(unit_rows: DataFrame, size: int = PROMPT_UNITS, context: int = CONTEXT) -> DataFrame:
    """Overlapping runs of units for prompts: ``clip_id, window, units`` with the
    editable range ``first_edit`` to ``last_edit``. A window begins with the last
    ``context`` units of the one before, which it may not edit; the rest it may, so
    the windows of a clip share its units out."""
    step = size - context
    n = unit_rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("clip_id")))
    last_window = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("unit") - size + 1) / step)).cast("int")
    hi = F.least(last_window, F.floor(F.col("unit") / step).cast("int"))
    each = n.filter(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi)))
    line = F.struct("unit", "spk", "start_ms", "end_ms", F.substring("text", 1, TEXT_CAP).alias("text"))
    packed = each.groupBy("clip_id", "window").agg(F.array_sort(F.collect_list(line)).alias("units"), F.max("_n").alias("_n"))
    first = F.when(F.col("window") > 0, F.col("window") * step + context).otherwise(0)
    last = F.least(F.col("window") * step + size, F.col("_n")) - 1
    return packed.select("clip_id", "window", "units", first.cast("long").alias("first_edit"), last.cast("long").alias("last_edit"))


#: Fixed value: what marks a unit as context.
CONTEXT_MARK = "  [context, do not edit]"
#: What the model is asked. The replies' form is fixed by ``parse_edits``.
INSTRUCTION = """A speech recogniser made this transcript of a conversation in {language}; many of its words are wrong, so \
judge who speaks by the course of the conversation.

Speakers: {speakers}

One unit a line, as [number] speaker (start-end): text

{units}

Some units may have the wrong speaker: one person's speech split over two labels, two persons under one label, or two \
labels exchanged. Answer with JSON alone, in this form:
{{"edits": [{{"unit": <number>, "speaker": "<one of the speakers>", "confidence": <0.0 to 1.0>, "why": "<few words>"}}]}}

Change a label only where it is clearly wrong. Edits with a confidence below {least} are not applied. If all labels look \
right, answer {{"edits": []}}.
"""


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one digit, rounded as the nearest double is: a
    tie in decimals is none in binary unless it is a quarter, and a quarter goes to
    the even digit. ``x - k / 20`` is worked out without rounding, by halves of x."""
    size = F.abs(ms.cast("long"))
    x, k = size / 1000, F.floor(size / 50)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    above = (20 * high - k) + 20 * (x - high)
    tenth, rest = F.floor(size / 100), size % 100
    up = (rest > 50) | ((rest == 50) & ((above > 0) | ((above == 0) & (tenth % 2 == 1))))
    tenth = tenth + up.cast("long")
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.floor(tenth / 10).cast("string"), F.lit("."), (tenth % 10).cast("string"))


def unit_line(number: Column, spk: Column, start_ms: Column, end_ms: Column, text: Column, context: Column) -> Column:
    head = F.concat(F.format_string("[%d] %s (", number, spk), seconds(start_ms), F.lit("-"), seconds(end_ms), F.lit("s)"))
    return F.concat(head, F.when(context, CONTEXT_MARK).otherwise(""), F.lit(": "), text)


def render_prompt(windows: DataFrame) -> DataFrame:
    """A line for each unit: number, speaker, times in seconds, a mark on context, text."""
    line = F.transform("units", lambda u: unit_line(u["unit"], u["spk"], u["start_ms"], u["end_ms"], u["text"], u["unit"] < F.col("first_edit")))
    return windows.select("clip_id", "window", F.array_join(line, "\n").alias("prompt"), "first_edit", "last_edit")


def instruct(prompts: DataFrame, speakers: DataFrame, language: str = "an unknown language", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``render_prompt``'s lines inside the instruction. ``speakers``: clip_id, spk."""
    names = speakers.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_set("spk")), ", ").alias("_names"))
    head, tail = INSTRUCTION.format(language=language, speakers="\0", units="\1", least=f"{least:.2f}").split("\1")
    before, between = head.split("\0")
    return prompts.join(names, "clip_id", "left").withColumn("prompt", F.concat(F.lit(before), F.coalesce("_names", F.lit("")), F.lit(between), "prompt", F.lit(tail))).drop("_names")


def _out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def ask_model(prompts: DataFrame, client: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """Replies of a model: ``client`` turns prompts into replies, a batch at a
    time, on the executors. A batch that runs out of memory is halved; see
    ``model_edits`` for windows that shrink."""

    def ask(texts: list[str]) -> list[str]:
        try:
            return client(texts)
        except Exception as error:
            if not _out_of_memory(error):
                raise
            if len(texts) == 1:
                return [""]
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            texts = df["prompt"].tolist()
            replies = [r for i in range(0, len(texts), batch) for r in ask(texts[i : i + batch])]
            yield df.drop(columns="prompt").assign(reply=replies)

    return prompts.mapInPandas(run, "clip_id long, window int, first_edit long, last_edit long, reply string")


def window_pass(n: int, ask: Callable[[int, int, int], str | None], size: int = PROMPT_UNITS, context: int = CONTEXT) -> tuple[list[tuple[int, int, str]], int]:
    """Goes over a clip's ``n`` units window by window. ``ask(first, end, context)``
    gives a reply, or None where the window does not fit: then it is halved, down
    to two units beside the context, and left out if even these do not fit. Returns
    (first editable unit, end, reply) of each, and how often one did not fit."""
    out, misses, at, ahead = [], 0, 0, 0
    while at < n:
        span = min(size, n - at)
        reply = ask(at, at + span, ahead)
        while reply is None:
            misses += 1
            if span <= ahead + 2:
                break
            span = max(ahead + 2, span // 2)
            reply = ask(at, at + span, ahead)
        if reply is not None:
            out.append((at + ahead, at + span, reply))
        end = at + span
        if end >= n:
            break
        ahead = min(context, end)  # units gone over already
        at = end - ahead
    return out, misses


def model_edits(unit_rows: DataFrame, client: Callable[[list[str]], list[str]], language: str = "an unknown language", least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """A model's edits that hold (``clip_id, unit, speaker, confidence``) and, by
    clip, counts of ``REASONS``. A clip's windows follow one another, because one
    that does not fit shrinks and moves the next; clips are independent."""
    lines = unit_rows.select("clip_id", "unit", "spk", "start_ms", "end_ms", F.substring("text", 1, TEXT_CAP).alias("text"))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("unit").reset_index(drop=True)
        names = ", ".join(sorted(df["spk"].dropna().unique()))

        def ask(first: int, end: int, context: int) -> str | None:
            rows = []
            for i in range(first, end):
                u = df.iloc[i]
                mark = CONTEXT_MARK if i < first + context else ""
                rows.append(f"[{i}] {u.spk} ({u.start_ms / 1000:.1f}-{u.end_ms / 1000:.1f}s){mark}: {u.text}")
            prompt = INSTRUCTION.format(language=language, speakers=names, units="\n".join(rows), least=f"{least:.2f}")
            try:
                return client([prompt])[0]
            except Exception as error:
                if not _out_of_memory(error):
                    raise
                return None

        found, misses = window_pass(len(df), ask)
        rows = [(df["clip_id"][0], k, first, end - 1, reply, 0) for k, (first, end, reply) in enumerate(found)]
        if misses:
            rows.append((df["clip_id"][0], -1, 0, -1, None, misses))
        return pd.DataFrame(rows, columns=["clip_id", "window", "first_edit", "last_edit", "reply", "oom"])

    clip = unit_rows.schema["clip_id"].dataType.simpleString()
    replies = lines.groupBy("clip_id").applyInPandas(one, f"clip_id {clip}, window int, first_edit long, last_edit long, reply string, oom long")
    return parse_edits(replies, unit_rows.select("clip_id", "spk"), least)


@batched("struct<parsed:boolean,edits:array<struct<ok:boolean,unit:long,speaker:string,confidence:double,has_confidence:boolean>>>")
def _edits(reply: pd.Series) -> pd.DataFrame:
    rows = []
    for text in reply:
        found = extract_json(text)
        items = found.get("edits") if found else None
        out = []
        for e in items if isinstance(items, list) else []:
            unit = e.get("unit") if isinstance(e, dict) else None
            is_int = isinstance(unit, int)
            try:
                confidence, has = float(e.get("confidence")), True
            except (TypeError, ValueError, AttributeError):
                confidence, has = None, False
            speaker = e.get("speaker") if isinstance(e, dict) else None
            out.append({"ok": isinstance(e, dict), "unit": int(unit) if is_int else None, "speaker": speaker if isinstance(speaker, str) else None, "confidence": confidence, "has_confidence": has})
        rows.append({"parsed": isinstance(items, list), "edits": out})
    return pd.DataFrame(rows, columns=["parsed", "edits"])


def parse_edits(replies: DataFrame, speakers: DataFrame, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Edits that hold, and counts by clip of why others do not (``REASONS``).
    Checked in this order: is it an edit of a unit that the window may change, its
    speaker (``speakers``: clip_id, spk), is there a confidence, is it enough, has
    the unit an edit already. Rows with ``oom`` (see ``model_edits``) are counted."""
    r = replies if "oom" in replies.columns else replies.withColumn("oom", F.lit(0).cast("long"))
    missed = r.filter("oom > 0").select("clip_id", F.explode(F.sequence(F.lit(1), F.col("oom"))), F.lit("oom").alias("reason")).select("clip_id", "reason")
    r = r.filter("oom = 0").withColumn("_e", _edits("reply"))
    known = speakers.groupBy("clip_id").agg(F.collect_set("spk").alias("_known"))
    each = r.filter("_e.parsed").join(known, "clip_id", "left").select("clip_id", "window", "first_edit", "last_edit", "_known", F.posexplode("_e.edits").alias("pos", "e"))
    outside = F.col("e.unit").isNull() | (F.col("e.unit") < F.col("first_edit")) | (F.col("e.unit") > F.col("last_edit"))
    reason = (
        F.when(~F.col("e.ok") | outside, "bad_unit")
        .when(~F.coalesce(F.array_contains("_known", F.col("e.speaker")), F.lit(False)), "bad_speaker")
        .when(~F.col("e.has_confidence"), "no_conf")
        .when(F.col("e.confidence") < least, "low_conf")
    )
    each = each.withColumn("reason", reason)
    w = W.partitionBy("clip_id", "e.unit", F.col("reason").isNull()).orderBy("window", "pos")
    each = each.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "dup").otherwise(F.col("reason")))
    good = each.filter("reason is null").select("clip_id", F.col("e.unit").alias("unit"), F.col("e.speaker").alias("speaker"), F.col("e.confidence").alias("confidence"))
    bad = each.filter("reason is not null").select("clip_id", "reason").unionByName(r.filter("not _e.parsed").select("clip_id", F.lit("parse_fail").alias("reason"))).unionByName(missed)
    counts = bad.groupBy("clip_id").pivot("reason", list(REASONS)).count().na.fill(0)
    return good, counts


def edit_log(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Per clip: units, applied edits and relabelled words."""
    u = words.join(edits.select("clip_id", "unit", F.lit(1).alias("_e")), ["clip_id", "unit"], "left")
    return u.groupBy("clip_id").agg(F.count_distinct("unit").alias("n_units"), F.count_distinct(F.when(F.col("_e") == 1, F.col("unit"))).alias("n_applied"), F.count("_e").alias("n_words_relabelled"), F.count(F.lit(1)).alias("n_words"))


def method_rule(words: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Words under the rule's labels."""
    u = pause_units(words, gap_ms)
    return apply_edits(u, rule_edits(units(u)))


def method_llm(words: DataFrame, client: Callable[[list[str]], list[str]], gap_ms: int = 500, language: str = "an unknown language", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Words under a model's labels; clips whose edits are too many keep theirs."""
    u = pause_units(words, gap_ms)
    rows = units(u)
    edits, _ = model_edits(rows, client, language, least)
    return apply_edits(u, guard_rogue(edits, rows))


METHODS: dict[str, Callable[..., DataFrame]] = {"rule": method_rule, "llm": method_llm}
