"""Parsing, checking and clipping of turns, and what is known about a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .intervals import speaker_overlap, union_speech

DIAR = r"^\s*(.+?)\s*\[\s*([0-9.]+)\s*-\s*([0-9.]+)\s*\]\s*$"
ASR = r"(?s)^\s*\[\s*([0-9.]+)\s*-\s*([0-9.]+)\s*\](.*)$"
TINY_MS = 10
#: Status of a clip whose audio can be used.
USABLE = ("ok", "short_source")


def _ms(seconds: Column) -> Column:
    return F.bround(seconds.cast("decimal(18,6)") * 1000, 0).cast("long")


def parse_diarization(df: DataFrame, column: str = "diarization_segments") -> DataFrame:
    """``name [a-b]|name [a-b]`` into one row a turn (``pos, speaker, start_ms,
    end_ms``); blank parts are skipped, any other part that does not parse raises."""
    each = df.select("*", F.posexplode(F.filter(F.split(column, r"\|"), lambda p: F.trim(p) != "")).alias("pos", "_p"))
    ok = F.assert_true(F.col("_p").rlike(DIAR), F.concat(F.lit("not a turn: "), F.col("_p")))
    part = lambda i: F.regexp_extract("_p", DIAR, i)
    return each.filter(ok.isNull()).select(*df.drop(column).columns, "pos", T.normalise_speaker(part(1)).alias("speaker"), _ms(part(2)).alias("start_ms"), _ms(part(3)).alias("end_ms"))


def parse_asr(df: DataFrame, column: str = "asr_segments") -> DataFrame:
    """``[a-b] text|[a-b] text`` into ``pos, start_ms, end_ms, text``."""
    each = df.select("*", F.posexplode(F.filter(F.split(column, r"\|"), lambda p: F.trim(p) != "")).alias("pos", "_p"))
    ok = F.assert_true(F.col("_p").rlike(ASR), F.concat(F.lit("not a segment: "), F.col("_p")))
    part = lambda i: F.regexp_extract("_p", ASR, i)
    return each.filter(ok.isNull()).select(*df.drop(column).columns, "pos", _ms(part(1)).alias("start_ms"), _ms(part(2)).alias("end_ms"), F.trim(part(3)).alias("text"))


def zip_segments(diar: DataFrame, asr: DataFrame, keys: list[str]) -> DataFrame:
    """Turns and texts by position; raises unless both sides have the same
    positions and times."""
    a, b = diar.alias("a"), asr.select(*keys, "pos", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "text").alias("b")
    both = a.join(b, [*keys, "pos"], "full")
    ok = F.assert_true(F.coalesce((F.col("start_ms") == F.col("_s")) & (F.col("end_ms") == F.col("_e")), F.lit(False)), F.lit("turns and texts differ"))
    return both.filter(ok.isNull()).drop("_s", "_e")


def clip_turns(turns: DataFrame, duration: Column, tiny_ms: int = TINY_MS) -> DataFrame:
    """Turns cut to their clip, with what happened to each: ``status`` is kept,
    inverted, outside or tiny (all but kept are to be dropped), ``clipped`` says
    that an end was cut and ``lost_ms`` by how much."""
    inverted, outside = F.col("end_ms") < F.col("start_ms"), F.col("start_ms") >= duration
    a, b = F.greatest(F.lit(0), "start_ms"), F.least(F.col("end_ms"), duration)
    status = F.when(inverted, "inverted").when(outside, "outside").when(b - a < tiny_ms, "tiny").otherwise("kept")
    live = ~inverted & ~outside
    clipped = live & ((a != F.col("start_ms")) | (b != F.col("end_ms")))
    lost = F.when(clipped, (F.col("end_ms") - F.col("start_ms")) - (b - a)).when(~inverted & outside, F.col("end_ms") - F.col("start_ms")).otherwise(0)
    return turns.select("*", status.alias("status"), clipped.alias("clipped"), lost.cast("long").alias("lost_ms"), F.when(live, a).alias("from_ms"), F.when(live, b).alias("to_ms"))


def anomalies(checked: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    """Counts of what ``clip_turns`` found. A turn can be clipped and tiny at once."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_turns"), n("kept").alias("n_kept"), n("inverted").alias("n_inverted"), n("outside").alias("n_outside"), n("tiny").alias("n_tiny"), F.count_if("clipped").alias("n_clipped"), F.sum("lost_ms").alias("lost_ms"))


def clip_meta(turns: DataFrame) -> DataFrame:
    """What is known about each clip: duration, speakers, segments, speech,
    overlap, language and reference words. Letters are counted a turn at a time,
    so no clip's text is gathered."""
    base = turns.groupBy("clip_id").agg(F.max("end_ms").alias("duration_ms"), F.count_distinct("speaker").alias("n_speakers"), F.count(F.lit(1)).alias("n_segments"), F.sum(T.count_reference_words(F.col("text"))).alias("n_ref_words"), *[F.sum(n).alias(f"_{s}") for s, n in T.script_counts(F.col("text")).items()])
    out = base.join(union_speech(turns), "clip_id").join(speaker_overlap(turns), "clip_id")
    share = lambda a, b: F.round(F.col(a) / F.col(b), 4)
    return out.select("clip_id", "duration_ms", "n_speakers", "n_segments", "n_ref_words", "speech_ms", "overlap_ms", share("speech_ms", "duration_ms").alias("speech_frac"), share("overlap_ms", "speech_ms").alias("overlap_frac_of_speech"), share("overlap_ms", "duration_ms").alias("overlap_frac_of_clip"), T.language_of({s: F.col(f"_{s}") for s in [*T.SCRIPTS, *T.MORE_SCRIPTS]}).alias("language"))


def meta_summary(meta: DataFrame) -> DataFrame:
    """Clips, time and words by number of speakers and language."""
    return meta.groupBy("n_speakers", "language").agg(F.count(F.lit(1)).alias("n_clips"), F.sum("duration_ms").alias("duration_ms"), F.sum("speech_ms").alias("speech_ms"), F.sum("overlap_ms").alias("overlap_ms"), F.sum("n_ref_words").alias("n_ref_words"))


def load_segments(df: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table of segments made ready: times as numbers, rows without or with a
    reversed window dropped, ``clip_id`` added, the first row of each clip kept
    (``row`` says the order), filtered and limited on request."""
    need = {"video_id", "start_sec", "end_sec", "row"} - set(df.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    t = df.withColumns({"start_sec": F.expr("try_cast(start_sec as double)"), "end_sec": F.expr("try_cast(end_sec as double)")}).filter("end_sec > start_sec")
    t = t.withColumn("clip_id", T.clip_id(F.col("video_id"), F.col("start_sec"), F.col("end_sec")))
    t = t.withColumn("_n", F.row_number().over(W.partitionBy("clip_id").orderBy("row"))).filter("_n = 1").drop("_n")
    if only is not None:
        t = t.filter(F.col("clip_id").isin(only))
    return t.orderBy("row").limit(limit) if limit else t


def trim_check(df: DataFrame, rate: int = 16_000, tolerance: int = 16) -> DataFrame:
    """Whether a cut has the samples that its window asks for."""
    expected = F.bround(F.col("duration_sec") * rate, 0).cast("long")
    delta = F.col("n_samples") - expected
    return df.select("*", expected.alias("expected_samples"), delta.alias("sample_delta"), F.when(F.abs(delta) <= tolerance, "ok").otherwise("short_source").alias("status"))


def usable(meta: DataFrame, status: str = "status") -> DataFrame:
    return meta.filter(F.col(status).isin(*USABLE))
