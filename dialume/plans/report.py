"""Tables of results over per-clip scores.

A score row is ``asr, diar, method, clip_id`` with error and length counts. Rates
are sums of errors over sums of lengths, so a clip counts by its words or its time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.sets import common_subset

KEY = ["asr", "diar", "method", "clip_id"]
BASELINE = "baseline"


def rate(errors: str, length: str, digits: int = 2) -> Column:
    return F.round(100 * F.sum(errors) / F.greatest(F.sum(length), F.lit(1)), digits)


def rate_or_null(errors: Column, length: str, digits: int = 2) -> Column:
    return F.round(100 * F.sum(errors) / F.nullif(F.sum(length), F.lit(0)), digits)


def mean_of_clips(errors: str, length: str, digits: int = 2) -> Column:
    return F.round(100 * F.avg(F.col(errors) / F.greatest(F.col(length), F.lit(1))), digits)


def pick(scores: DataFrame, asr: str, method: str, diar: str | None = None) -> DataFrame:
    """The rows of one recogniser and method, and of one diarizer if named."""
    chosen = scores.filter((F.col("asr") == asr) & (F.col("method") == method))
    return chosen if diar is None else chosen.filter(F.col("diar") == diar)


def without_reference(scores: DataFrame, name: str = "ref") -> DataFrame:
    """Scores of real systems: rows on the reference's own turns are left out."""
    return scores.filter(F.col("diar") != name)


def with_subset(scores: DataFrame) -> DataFrame:
    """Every row as ``all``, and those of clips that every condition has as ``common``."""
    named = scores.withColumn("condition", F.concat_ws("__", "asr", F.concat_ws("+", "diar", "method")))
    common = common_subset(named).withColumn("_c", F.lit(True))
    both = scores.join(common, "clip_id", "left")
    return both.withColumn("subset", F.explode(F.when(F.col("_c"), F.array(F.lit("all"), F.lit("common"))).otherwise(F.array(F.lit("all"))))).drop("_c")


def corpus_rates(scores: DataFrame) -> DataFrame:
    """Rates by subset and condition; ``attribution_cost`` is the difference of
    the rounded rates."""
    g = with_subset(scores).groupBy("subset", "asr", "diar", "method").agg(F.count(F.lit(1)).alias("n_clips"), rate("wer_errors", "length").alias("wer"), rate("cp_errors", "length").alias("cpwer"), rate("di_errors", "length").alias("di_cpwer"), rate("wder_errors", "wder_length").alias("wder"), mean_of_clips("cp_errors", "length").alias("cpwer_clip_mean"))
    return g.withColumn("attribution_cost", F.round(F.col("cpwer") - F.col("di_cpwer"), 2))


def der_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rates weighted by time, the mean of clips, and speaker counts."""
    d = F.col("n_hyp_speakers") - F.col("n_ref_speakers")
    wrong = F.col("miss_ms") + F.col("fa_ms") + F.col("conf_ms")
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clips"), rate_or_null(wrong, "total_ms").alias("der"), rate_or_null(F.col("miss_ms"), "total_ms").alias("miss"), rate_or_null(F.col("fa_ms"), "total_ms").alias("fa"), rate_or_null(F.col("conf_ms"), "total_ms").alias("confusion"), F.round(100 * F.avg(wrong / F.nullif("total_ms", F.lit(0))), 2).alias("der_clip_mean"), F.round(100 * F.avg((d == 0).cast("int")), 2).alias("count_accuracy"), F.round(F.avg(F.abs(d)), 4).alias("count_mae"), F.round(F.avg(d), 4).alias("count_bias"))


#: Rank error of the sketch that narrows a quantile down, as one in this many rows.
SKETCH = 10_000


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles for ascending ``shares``, linear between neighbours. A sketch
    gives for each an interval that surely holds it; one aggregate counts what lies
    between the intervals and each distinct value in them, some six in ``SKETCH`` of
    all rows, and only these are put in order."""
    rows = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = [min(1.0, max(0.0, s + d * 3 / SKETCH)) for s in shares for d in (-1, 1)]
    n, least, most, near = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.percentile_approx("v", ends, SKETCH)).first()
    if not n:
        return [None] * len(shares)
    if n <= 2 * SKETCH:  # few rows: one interval, all of them
        near = [least, most] * len(shares)
    zone = F.lit(2 * len(shares))
    for i in reversed(range(len(shares))):
        low, high = near[2 * i], near[2 * i + 1]
        zone = F.when(F.col("v") < low, 2 * i).when(F.col("v") <= high, 2 * i + 1).otherwise(zone)
    counted = rows.select(zone.alias("z"), "v").groupBy("z", F.when(F.col("z") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(W.orderBy("z", "v")))  # one task, few rows
    places = [(n - 1) * s for s in shares]
    ranks = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    hit = F.filter(F.lit(ranks), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("k")))
    found = {r: row["v"] for row in upto.withColumn("hit", hit).filter(F.size("hit") > 0).collect() for r in row["hit"]}
    out = []
    for p in places:
        lower, upper = math.floor(p), math.ceil(p)
        out.append(found[lower] if lower == upper else (upper - p) * found[lower] + (p - lower) * found[upper])
    return out


def terciles(rows: DataFrame, value: str, name: str = "tercile", accuracy: int | None = None) -> DataFrame:
    """``rows`` with low, mid or high by the thirds of ``value`` over the rows
    given (each class holds its upper edge): exact, or, where one more pass is too
    many, from a sketch of the given accuracy."""
    thirds = [1 / 3, 2 / 3]
    if accuracy is None:
        cuts = [F.lit(x).cast("double") for x in quantiles(rows, value, thirds)]
    else:
        found = rows.agg(F.percentile_approx(value, thirds, accuracy)).first()[0] or [None, None]
        cuts = [F.lit(x).cast("double") for x in found]
    return rows.withColumn(name, F.when(F.col(value) <= cuts[0], "low").when(F.col(value) <= cuts[1], "mid").otherwise("high"))


def speaker_bucket(n: Column) -> Column:
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def build_long(scores: DataFrame, meta: DataFrame, ders: DataFrame, edits: DataFrame, models: list[tuple[str, str, str]]) -> DataFrame:
    """One row for every model and clip: scores, DER of the system and of its
    control (the same turns without relabelling), edits, and rates. ``models`` lists (asr,
    diar, method); models and clips without scores have nulls."""
    sys_ = F.when(F.col("method") == BASELINE, F.col("diar")).otherwise(F.concat_ws("+", F.concat_ws("__", "asr", "diar"), "method"))
    each = F.array(*[F.struct(F.lit(a).alias("asr"), F.lit(d).alias("diar"), F.lit(m).alias("method")) for a, d, m in models])
    grid = meta.select("clip_id", "language", "n_speakers", "duration_ms", F.inline(each))
    out = grid.join(scores, KEY, "left").withColumns({"sys": sys_, "sys_ctrl": F.col("diar")})
    d = ders.select(F.col("system").alias("sys"), "clip_id", "total_ms", "miss_ms", "fa_ms", "conf_ms")
    c = ders.select(F.col("system").alias("sys_ctrl"), "clip_id", *[F.col(x).alias(f"{x}_ctrl") for x in ("total_ms", "miss_ms", "fa_ms", "conf_ms")])
    out = out.join(d, ["sys", "clip_id"], "left").join(c, ["sys_ctrl", "clip_id"], "left").join(edits, KEY, "left")
    pct = lambda e, n: F.round(100 * F.col(e) / F.nullif(n, F.lit(0)), 4)
    return out.withColumns({"wer": pct("wer_errors", "length"), "cpwer": pct("cp_errors", "length"), "wder": pct("wder_errors", "wder_length"), "n_applied": F.coalesce("n_applied", F.lit(0))})


def deltas(table: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``table`` with each value's difference from the baseline method of its keys."""
    base = F.max(F.when(F.col("method") == BASELINE, F.col(value))).over(W.partitionBy(*keys))
    return table.withColumn(f"{value}_delta", F.round(F.col(value) - base, 2))


def consistency(scores: DataFrame, errors: str, length: str, method: str) -> DataFrame:
    """In how many clips a method is better, the same or worse than the baseline."""
    r = F.col(errors) / F.greatest(F.col(length), F.lit(1))
    two = scores.filter(F.col("method").isin(BASELINE, method)).groupBy("asr", "diar", "clip_id").agg(F.max(F.when(F.col("method") == BASELINE, r)).alias("b"), F.max(F.when(F.col("method") == method, r)).alias("m")).filter("b is not null and m is not null")
    d = F.col("m") - F.col("b")
    return two.groupBy("asr", "diar").agg(F.count_if(d < -1e-9).alias("better"), F.count_if(F.abs(d) <= 1e-9).alias("same"), F.count_if(d > 1e-9).alias("worse"))


def swap(scores: DataFrame, a: str, b: str) -> DataFrame:
    """What another recogniser changes under the same turns and method."""
    g = scores.filter(F.col("asr").isin(a, b)).groupBy("diar", "method").pivot("asr", [a, b]).agg(rate("cp_errors", "length"))
    return g.select("diar", "method", F.col(a).alias("cpwer_a"), F.col(b).alias("cpwer_b"), F.round(F.col(b) - F.col(a), 2).alias("gain"))


def breakdown(scores: DataFrame, meta: DataFrame, by: str, ders: DataFrame | None = None, jers: DataFrame | None = None) -> DataFrame:
    """Clips and hours by a column of the clips, cpWER and WDER with a column for
    each method, and, from ``ders`` (``system`` is the diarizer) and ``jers``
    (``system, clip_id, jer``), the turns' DER by time and mean JER of the clips."""
    j = scores.join(meta.select("clip_id", by, "duration_ms"), "clip_id")
    keys = ["asr", "diar", by]

    def of(method: str, errors: str, length: str) -> Column:
        chosen = F.col("method") == method
        return F.round(100 * F.sum(F.when(chosen, F.col(errors))) / F.nullif(F.sum(F.when(chosen, F.col(length))), F.lit(0)), 2)

    rates = [of(m, e, n).alias(f"{name}_{m}") for name, e, n in (("cpwer", "cp_errors", "length"), ("wder", "wder_errors", "wder_length")) for m in (BASELINE, "rule")]
    hours = F.round(F.sum(F.when(F.col("method") == BASELINE, F.col("duration_ms"))) / 3_600_000, 4)
    out = j.groupBy(*keys).agg(F.count_distinct("clip_id").alias("n_clips"), hours.alias("hours"), *rates)
    if ders is None:
        return out
    base = j.filter(F.col("method") == BASELINE).select(*keys, "clip_id")
    d = ders.select(F.col("system").alias("diar"), "clip_id", "total_ms", (F.col("miss_ms") + F.col("fa_ms") + F.col("conf_ms")).alias("wrong_ms"))
    d = d.join(jers.select(F.col("system").alias("diar"), "clip_id", "jer"), ["diar", "clip_id"], "left")
    turns = base.join(d, ["diar", "clip_id"]).groupBy(*keys).agg(rate_or_null(F.col("wrong_ms"), "total_ms").alias("der"), F.round(100 * F.avg("jer"), 2).alias("jer_clip_mean"))
    return out.join(turns, keys, "left")


def language_crosstab(docs: DataFrame, scripts: list[str]) -> DataFrame:
    """By recogniser and language that it detected: clips of each script, and the
    words found for every word of the reference. ``docs``: ``asr, clip_id,
    detected, script, hyp_words, ref_words``."""
    ratio = F.round(F.sum("hyp_words") / F.greatest(F.sum("ref_words"), F.lit(1)), 2)
    known = F.coalesce(F.col("script").isin(*scripts), F.lit(False))
    found = [F.count_if(F.col("script") == s).alias(s) for s in scripts]
    return docs.groupBy("asr", "detected").agg(*found, F.count_if(~known).alias("other"), ratio.alias("word_ratio"))


def language_table(scores: DataFrame, meta: DataFrame, recognisers: list[str]) -> DataFrame:
    """WER by language, a column for each recogniser."""
    j = scores.filter(F.col("method") == BASELINE).dropDuplicates(["asr", "clip_id"]).join(meta.select("clip_id", "language"), "clip_id")
    return j.groupBy("language").pivot("asr", recognisers).agg(rate("wer_errors", "length"))


def track(corpus: DataFrame, systems: list[tuple[str, str, str]]) -> DataFrame:
    """Chosen systems in order, with the change from the first."""
    spark = corpus.sparkSession
    chosen = spark.createDataFrame([(i, *s) for i, s in enumerate(systems)], "place int, asr string, diar string, method string")
    t = corpus.join(F.broadcast(chosen), ["asr", "diar", "method"])
    first = F.max(F.when(F.col("place") == 0, F.col("cpwer"))).over(W.partitionBy("subset"))
    return t.select("subset", "place", "asr", "diar", "method", "cpwer", F.round(F.col("cpwer") - first, 2).alias("change"))


# checks: each returns the rows that break it ---------------------------------


def wer_changes(scores: DataFrame) -> DataFrame:
    """Relabelling must not change words: more than one WER per recogniser, turns and clip."""
    return scores.groupBy("asr", "diar", "clip_id").agg(F.count_distinct("wer_errors", "length").alias("n")).filter("n > 1")


def detection_drift(ders: DataFrame, tolerance_ms: int = 10) -> DataFrame:
    """Projections must not change how much speech is found."""
    return ders.groupBy("control", "clip_id").agg((F.max("miss_ms") - F.min("miss_ms")).alias("miss"), (F.max("fa_ms") - F.min("fa_ms")).alias("fa")).filter((F.col("miss") > tolerance_ms) | (F.col("fa") > tolerance_ms))


def twins_differ(rows: DataFrame, source: DataFrame, columns: list[str], keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows that a fallback took over must equal their source's, nulls included."""
    b = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)) for c in columns]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s
    return rows.join(b, keys).filter(~ok)


def differs(mine: DataFrame, theirs: DataFrame, keys: list[str], column: str, tolerance: float = 0.011) -> DataFrame:
    """Totals that two stages derive must agree, row for row."""
    j = mine.select(*keys, F.col(column).alias("_a")).join(theirs.select(*keys, F.col(column).alias("_b")), keys, "full")
    return j.filter(F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A short table as Markdown; null is an en dash. Only for reports: more than
    ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a report")
    cell = lambda v: "–" if v is None or v != v else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
