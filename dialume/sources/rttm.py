"""RTTM lines to turns and back; packed texts, manifests and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``clip_id, start_ms, end_ms, speaker`` of SPEAKER lines; blank lines,
    ``;`` comments, lines of fewer than eight fields, other tags and turns without
    length are skipped."""
    f = F.split(F.trim(value), r"\s+")
    ms = lambda i: F.bround(F.expr(f"try_cast(_f[{i}] as decimal(18,6))") * 1000, 0).cast("long")
    t = lines.withColumn("_f", f).filter((F.size("_f") >= 8) & (F.col("_f")[0] == "SPEAKER") & ~F.startswith(F.trim(value), F.lit(";")))
    t = t.select(F.col("_f")[1].alias("clip_id"), ms(3).alias("start_ms"), ms(4).alias("_d"), F.col("_f")[7].alias("speaker"))
    return t.filter("_d > 0 and start_ms is not null").select("clip_id", "start_ms", (F.col("start_ms") + F.col("_d")).alias("end_ms"), "speaker")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def format_lines(turns: DataFrame) -> DataFrame:
    """One line a turn that has a length; spaces in names become underscores."""
    sec = lambda c: F.format_string("%d.%03d", F.expr(f"{c} div 1000"), F.expr(f"{c} % 1000"))
    t = turns.filter("end_ms > start_ms").withColumn("_d", F.col("end_ms") - F.col("start_ms"))
    return t.select(F.concat_ws(" ", F.lit("SPEAKER"), F.col("clip_id").cast("string"), F.lit("1"), sec("start_ms"), sec("_d"), F.lit("<NA> <NA>"), F.regexp_replace("speaker", " ", "_"), F.lit("<NA> <NA>")).alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    """A folder of text files, sorted within each, put in place by Spark's commit."""
    turns.transform(lambda t: t.sortWithinPartitions("clip_id", "start_ms", "end_ms")).transform(format_lines).write.mode("overwrite").text(path)


def packed_turns(speaker: Column, start_ms: Column, end_ms: Column) -> Column:
    """``name [a-b]``, the form that packed columns hold."""
    sec = lambda c: F.format_string("%.2f", c / 1000)
    return F.concat(speaker, F.lit(" ["), sec(start_ms), F.lit("-"), sec(end_ms), F.lit("]"))
