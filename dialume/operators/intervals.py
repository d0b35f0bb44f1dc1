"""Sweep-line operators over turns (``clip_id, start_ms, end_ms`` and more).

Every operator partitions by clip and sorts within it once; nothing pairs up the
intervals of a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def islands(turns: DataFrame, keys: list[str], gap_ms: int = 0) -> DataFrame:
    """Maximal stretches of speech: intervals that touch, overlap or lie at most
    ``gap_ms`` apart are one. ``keys, start_ms, end_ms``."""
    w = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    t = turns.select(*keys, "start_ms", "end_ms").withColumn("_new", F.when(F.col("start_ms") <= reach + gap_ms, 0).otherwise(1))
    t = t.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def union_speech(turns: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    """Length of the union of intervals: ``keys, speech_ms``."""
    return islands(turns, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))


def coverage(turns: DataFrame, keys: list[str], label: str = "speaker") -> DataFrame:
    """Elementary intervals with how many labels are active and how many turns:
    ``keys, start_ms, end_ms, n_labels, n_turns``. A label's own turns are merged
    first, so it counts once. Intervals without activity are left out."""
    once = islands(turns, [*keys, label])
    points = _events(once, keys, "_l").unionByName(_events(turns, keys, "_t"), allowMissingColumns=True)
    points = points.groupBy(*keys, "at").agg(F.sum(F.coalesce("_l", F.lit(0))).alias("_l"), F.sum(F.coalesce("_t", F.lit(0))).alias("_t"))
    w = W.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    swept = points.select(*keys, F.col("at").alias("start_ms"), F.lead("at").over(w).alias("end_ms"), F.sum("_l").over(upto).alias("n_labels"), F.sum("_t").over(upto).alias("n_turns"))
    return swept.filter("n_labels > 0")


def _events(turns: DataFrame, keys: list[str], name: str) -> DataFrame:
    """+1 where an interval starts, -1 where it ends."""
    t = turns.filter("end_ms > start_ms")
    ends = F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias(name)), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias(name)))
    return t.select(*keys, F.inline(ends))


def speaker_overlap(turns: DataFrame, keys: list[str] = ["clip_id"], label: str = "speaker") -> DataFrame:  # noqa: B006
    """Time in which at least two different speakers are active: ``keys, overlap_ms``
    (clips without overlap have zero)."""
    size = F.when(F.col("n_labels") >= 2, F.col("end_ms") - F.col("start_ms")).otherwise(0)
    return coverage(turns, keys, label).groupBy(*keys).agg(F.sum(size).alias("overlap_ms"))


def overlap_regions(turns: DataFrame, keys: list[str] = ["clip_id"], label: str = "speaker") -> DataFrame:  # noqa: B006
    """Merged intervals in which at least two speakers are active."""
    return islands(coverage(turns, keys, label).filter("n_labels >= 2"), keys)


def combine(a: DataFrame, b: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Merged intervals where ``keep`` holds over ``in_a`` and ``in_b``, whether
    any interval of each side is active."""
    marked = _events(a, keys, "_a").unionByName(_events(b, keys, "_b"), allowMissingColumns=True)
    points = marked.groupBy(*keys, "at").agg(F.sum(F.coalesce("_a", F.lit(0))).alias("_a"), F.sum(F.coalesce("_b", F.lit(0))).alias("_b"))
    w = W.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    swept = points.select(*keys, F.col("at").alias("start_ms"), F.lead("at").over(w).alias("end_ms"), (F.sum("_a").over(upto) > 0).alias("in_a"), (F.sum("_b").over(upto) > 0).alias("in_b"))
    return islands(swept.filter(keep & F.col("end_ms").isNotNull()), keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    """The parts of ``a`` that no interval of ``b`` covers."""
    return combine(a, b, keys, F.col("in_a") & ~F.col("in_b"))


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    return combine(a, b, keys, F.col("in_a") & F.col("in_b"))


def crop(turns: DataFrame, first: Column, last: Column) -> DataFrame:
    """Intervals cut to [first, last]; what lies outside goes."""
    return turns.withColumns({"start_ms": F.greatest("start_ms", first), "end_ms": F.least("end_ms", last)}).filter("end_ms > start_ms")


def pause_units(words: DataFrame, gap_ms: int | None = 500, keys: list[str] = ["clip_id"], speaker: str = "spk", order: str = "wid") -> DataFrame:  # noqa: B006
    """Runs of one speaker's consecutive words: a unit ends where the speaker
    changes or a word starts more than ``gap_ms`` after the previous one's end
    (None: never). ``words`` with ``unit``, numbered from 0."""
    w = W.partitionBy(*keys).orderBy(order)
    cut = ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | F.lag(order).over(w).isNull()
    if gap_ms is not None:
        cut = cut | F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms, F.lit(False))
    marked = words.withColumn("_cut", cut.cast("int"))
    return marked.withColumn("unit", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_cut")


def units(words: DataFrame, keys: list[str] = ["clip_id"], speaker: str = "spk", order: str = "wid") -> DataFrame:  # noqa: B006
    """One row a unit: speaker, start of its first and end of its last word, its
    words' numbers and text in order."""
    packed = words.groupBy(*keys, "unit").agg(F.first(speaker).alias(speaker), F.array_sort(F.collect_list(F.struct(order, "start_ms", "end_ms", "w"))).alias("_w"))
    return packed.select(*keys, "unit", speaker, F.element_at("_w", 1)["start_ms"].alias("start_ms"), F.element_at("_w", -1)["end_ms"].alias("end_ms"), F.transform("_w", lambda x: x[order]).alias("idx"), F.array_join(F.transform("_w", lambda x: x["w"]), " ").alias("text"))


def chunk_plan(clips: DataFrame, duration: str = "duration_ms", chunk_ms: int = 30_000, overlap_ms: int = 2_000, least_ms: int = 100) -> DataFrame:
    """Windows that cover a clip: one every ``chunk - overlap``, until one reaches
    the end; tails under ``least_ms`` are skipped. Adds ``chunk, from_ms, to_ms,
    core_from_ms, core_to_ms``: cores meet in the middle of overlaps and are open
    at the clip's ends (null)."""
    step = chunk_ms - overlap_ms
    n = F.greatest(F.lit(1), F.ceil((F.col(duration) - overlap_ms) / step)).cast("int")
    each = clips.filter(F.col(duration) > 0).withColumn("_n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    each = each.withColumn("from_ms", F.col("chunk").cast("long") * step).withColumn("to_ms", F.least(F.col(duration), F.col("from_ms") + chunk_ms))
    each = each.filter(F.col("to_ms") - F.col("from_ms") >= least_ms)
    first = F.when(F.col("chunk") > 0, F.col("from_ms") + overlap_ms // 2)
    last = F.when(F.col("chunk") < F.col("_n") - 1, F.col("to_ms") - overlap_ms // 2)
    return each.withColumns({"core_from_ms": first, "core_to_ms": last}).drop("_n")


def stitch(words: DataFrame, plan: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    """Words of overlapping chunks (``chunk`` says which): a word stays in the
    chunk whose core has its midpoint."""
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    cores = plan.select(*keys, "chunk", "core_from_ms", "core_to_ms")
    inside = (F.col("core_from_ms").isNull() | (middle >= F.col("core_from_ms"))) & (F.col("core_to_ms").isNull() | (middle < F.col("core_to_ms")))
    return words.join(cores, [*keys, "chunk"]).filter(inside).drop("core_from_ms", "core_to_ms")
