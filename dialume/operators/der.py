"""Error rates of turns: DER, JER, and both under other scoring regions.

Turns: ``clip_id, speaker, start_ms, end_ms``. A speaker's own turns are merged
first. All sums are of whole milliseconds; only the one-to-one matching of
speakers, over a clip's few (speaker, speaker) cells, runs in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .attribute import BUCKET_MS, _bucketed
from .intervals import islands, overlap_regions, subtract
from .wer import Order, best_matching


def window_of(ref: DataFrame) -> DataFrame:
    """The whole clip as its scoring region, up to the last reference turn's end."""
    return ref.groupBy("clip_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def within(turns: DataFrame, regions: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The parts of turns inside regions (which do not overlap each other)."""
    a = _bucketed(turns.filter("end_ms > start_ms").select("clip_id", "speaker", "start_ms", "end_ms"), bucket_ms)
    b = _bucketed(regions.filter("end_ms > start_ms").select("clip_id", "start_ms", "end_ms"), bucket_ms).select("clip_id", "_b", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    start, end = F.greatest("start_ms", "_s"), F.least("end_ms", "_e")
    met = a.join(b, ["clip_id", "_b"]).filter((start < end) & (F.col("_b") == F.greatest(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("_s") / bucket_ms))))
    return met.select("clip_id", "speaker", start.alias("start_ms"), end.alias("end_ms"))


def _merged(turns: DataFrame, regions: DataFrame | None) -> DataFrame:
    whole = islands(turns.filter("end_ms > start_ms"), ["clip_id", "speaker"])
    return whole if regions is None else within(whole, regions)


def shared_time(ref: DataFrame, hyp: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Time that a reference and a hypothesis speaker are both active: ``clip_id, r, h, ms``."""
    a = _bucketed(ref, bucket_ms).withColumnRenamed("speaker", "r")
    b = _bucketed(hyp, bucket_ms).select("clip_id", "_b", F.col("speaker").alias("h"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    ms = F.least("end_ms", "_e") - F.greatest("start_ms", "_s")
    met = a.join(b, ["clip_id", "_b"]).filter((ms > 0) & (F.col("_b") == F.greatest(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("_s") / bucket_ms))))
    return met.groupBy("clip_id", "r", "h").agg(F.sum(ms).alias("ms"))


def _times(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per clip: reference time, and time by how many more speakers one side has."""

    def marks(t: DataFrame, name: str) -> DataFrame:
        return t.select("clip_id", F.inline(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias(name)), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias(name)))))

    points = marks(ref, "r").unionByName(marks(hyp, "h"), allowMissingColumns=True).groupBy("clip_id", "at").agg(F.sum(F.coalesce("r", F.lit(0))).alias("r"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    w = W.partitionBy("clip_id").orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    swept = points.select("clip_id", (F.lead("at").over(w) - F.col("at")).alias("d"), F.sum("r").over(upto).alias("nr"), F.sum("h").over(upto).alias("nh"))
    s = lambda e: F.sum(F.coalesce(e * F.col("d"), F.lit(0))).cast("long")
    zero = F.lit(0)
    return swept.groupBy("clip_id").agg(s(F.col("nr")).alias("total_ms"), s(F.greatest(zero, F.col("nr") - F.col("nh"))).alias("miss_ms"), s(F.greatest(zero, F.col("nh") - F.col("nr"))).alias("fa_ms"), s(F.least("nr", "nh")).alias("both_ms"))


def matching(cells: DataFrame, order: Order | None = None) -> DataFrame:
    """``clip_id, r, h, ms`` of the matched pairs; ``order`` settles ties."""
    packed = cells.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("r", "h", "ms"))).alias("_c"))
    pairs = packed.select("clip_id", F.explode(best_matching("_c", order)).alias("m")).select("clip_id", F.col("m.ref").alias("r"), F.col("m.hyp").alias("h"))
    return cells.join(pairs, ["clip_id", "r", "h"])


def der(ref: DataFrame, hyp: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Per clip of ``ref``: ``total_ms, miss_ms, fa_ms, conf_ms, der,
    n_ref_speakers, n_hyp_speakers, hyp_missing``. ``regions`` is where scoring
    takes place (None: from 0 to the end of the reference). A clip without a
    hypothesis is missed as a whole."""
    regions = window_of(ref) if regions is None else regions
    a, b = _merged(ref, regions), _merged(hyp.join(ref.select("clip_id").distinct(), "clip_id", "left_semi"), regions)
    correct = matching(shared_time(a, b)).groupBy("clip_id").agg(F.sum("ms").alias("_correct"))
    n = lambda t, name: t.groupBy("clip_id").agg(F.count_distinct("speaker").alias(name))
    clips = ref.select("clip_id").distinct()
    out = clips.join(_times(a, b), "clip_id", "left").join(correct, "clip_id", "left").join(n(ref, "n_ref_speakers"), "clip_id").join(n(hyp, "n_hyp_speakers"), "clip_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    conf = z("both_ms") - z("_correct")
    wrong = z("miss_ms") + z("fa_ms") + conf
    return out.select("clip_id", z("total_ms").alias("total_ms"), z("miss_ms").alias("miss_ms"), z("fa_ms").alias("fa_ms"), conf.alias("conf_ms"), F.round(wrong / F.nullif(z("total_ms"), F.lit(0)), 6).alias("der"), "n_ref_speakers", z("n_hyp_speakers").alias("n_hyp_speakers"), F.col("n_hyp_speakers").isNull().alias("hyp_missing"))


def jer(ref: DataFrame, hyp: DataFrame, regions: DataFrame | None = None, order: Order | None = None) -> DataFrame:
    """Per clip ``n_speakers, error_sum, jer``: each reference speaker's share of
    the union with its match that is not shared (1 without a match), averaged. The
    corpus value is the sum of ``error_sum`` over the sum of ``n_speakers``. Of
    matchings that share equal time, which differ in this rate, ``order`` names the
    first (see ``best_matching``)."""
    regions = window_of(ref) if regions is None else regions
    a, b = _merged(ref, regions), _merged(hyp, regions)
    size = lambda t, k: t.groupBy("clip_id", F.col("speaker").alias(k)).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(f"{k}_ms"))
    pairs = matching(shared_time(a, b), order).join(size(b, "h"), ["clip_id", "h"])
    each = size(a, "r").join(pairs, ["clip_id", "r"], "left")
    error = F.coalesce(1 - F.col("ms") / (F.col("r_ms") + F.col("h_ms") - F.col("ms")), F.lit(1.0))
    return each.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_speakers"), F.round(F.sum(error), 6).alias("error_sum"), F.round(F.avg(error), 6).alias("jer"))


def regions_by_overlap(ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where several reference speakers talk, and the rest of each clip."""
    many = overlap_regions(ref)
    return many, subtract(window_of(ref), many)


def collar_regions(ref: DataFrame, collar_ms: int = 250, skip_overlap: bool = False) -> DataFrame:
    """The clip without a collar around each reference turn's ends (half on each
    side) and, if asked, without overlapped speech."""
    half = collar_ms // 2
    out = window_of(ref)
    if half:
        zones = ref.select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("at")).select("clip_id", (F.col("at") - half).alias("start_ms"), (F.col("at") + half).alias("end_ms"))
        out = within(subtract(out, zones).withColumn("speaker", F.lit("")), window_of(ref)).select("clip_id", "start_ms", "end_ms")
    return subtract(out, overlap_regions(ref)) if skip_overlap else out


def policies(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Corpus DER under collars of 0 and 250 ms, with and without overlap."""
    found = []
    for collar in (0, 250):
        for skip in (False, True):
            d = der(ref, hyp, collar_regions(ref, collar, skip))
            found.append(d.agg(*[F.sum(c).alias(c) for c in ("total_ms", "miss_ms", "fa_ms", "conf_ms")]).select(F.lit(collar).cast("long").alias("collar_ms"), F.lit(skip).alias("skip_overlap"), "*"))
    return reduce(DataFrame.unionByName, found)


def speaker_counts(scores: DataFrame) -> DataFrame:
    """How often the number of speakers is right, and the mean and absolute error."""
    d = F.col("n_hyp_speakers") - F.col("n_ref_speakers")
    return scores.agg(F.round(F.avg((d == 0).cast("int")), 4).alias("accuracy"), F.round(F.avg(F.abs(d)), 4).alias("mae"), F.round(F.avg(d), 4).alias("bias"))
