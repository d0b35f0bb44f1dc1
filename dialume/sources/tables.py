"""Tables, logs and documents in files."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.udf import batched

#: Schema of a document of words.
WORDS = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("lang", T.StringType()),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
    ]
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: tsv, parquet, json, jsonl, else csv; all columns as
    text but in Parquet. Spreadsheets are to be converted first."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("xlsx", "xlsm", "xls"):
        raise ValueError("convert spreadsheets to csv first")
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("json", "jsonl"):
        return spark.read.json(path)
    return spark.read.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", multiLine=True, escape='"')


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return df


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines, torn lines left out, with ``seq``, which
    orders records as they were appended: by the time of the append and the place
    in it (see ``append_log``), or, in a single file without these, by the lines."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    parsed = lines.select("_line", F.from_json("value", schema + ", _append long, _place long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    seq = F.struct(F.coalesce("r._append", F.lit(0)).alias("append"), F.coalesce("r._place", "_line").alias("place"))
    return parsed.filter("r is not null and r._bad is null").select("r.*", seq.alias("seq")).drop("_bad", "_append", "_place")


def append_log(records: DataFrame, path: str) -> None:
    """Adds records; each says when it was appended and where in the append it stood,
    because files of a folder have no order of their own."""
    now = F.lit(time.time_ns() // 1000)
    records.withColumns({"_append": now, "_place": F.monotonically_increasing_id()}).write.mode("append").json(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Documents of words as one row a word, in milliseconds, in the documents' order."""
    docs = spark.read.schema(WORDS).json(path)
    each = docs.select("clip_id", "system", "lang", F.posexplode("words").alias("wid", "x"))
    ms = lambda c: F.bround(c * 1000, 0).cast("long")
    return each.select("clip_id", "system", "lang", F.col("wid").cast("long").alias("wid"), F.col("x.w").alias("w"), ms(F.col("x.start")).alias("start_ms"), ms(F.col("x.end")).alias("end_ms"))


def words_documents(words: DataFrame) -> DataFrame:
    """One document a clip from rows of words."""
    item = F.struct("wid", F.struct("w", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end")).alias("x"))
    return words.groupBy("clip_id").agg(F.array_sort(F.collect_list(item)).alias("_w")).select("clip_id", F.transform("_w", lambda v: v["x"]).alias("words"))


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header; real numbers with a fixed number of digits if asked."""
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").csv(path, header=True)


def write_sheets(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """A workbook's tables as one folder each; names are cut to 31 characters and
    kept apart by a number. Returns each table's folder."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for name, df in tables.items():
        short, n = name[:31], 1
        while short in used:
            n += 1
            short = f"{name[: 30 - len(str(n))]}_{n}"
        used.add(short)
        out[name] = f"{path}/{short}"
        write_csv(df, out[name])
    return out


@batched("array<float>")
def samples(content: pd.Series) -> pd.Series:
    """16-bit PCM of WAV files as numbers from -1 to 1 (null if it is no such file)."""

    def one(raw: bytes | None):
        at = raw.find(b"data") if raw is not None and raw[:4] == b"RIFF" else -1
        if at < 0:
            return None
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        data = raw[at + 8 : at + 8 + size - size % 2]
        return (np.frombuffer(data[: len(data) - len(data) % 2], "<i2") / 32768).astype(np.float32)

    return content.map(one)


def scan_audio(spark: SparkSession, path: str) -> DataFrame:
    """WAV files with what their headers say: ``path, rate, channels, bits,
    n_samples, ok`` (16 kHz, mono, 16 bits). Only headers are parsed, in the JVM."""
    raw = spark.read.format("binaryFile").load(path)

    def number(at: int, size: int) -> Column:
        part = F.reverse(F.substring(F.hex(F.substring("content", at + 1, size)), 1, 2 * size))
        # little-endian: reverse the hex digits, then put each byte's two back in order
        return F.conv(F.regexp_replace(part, "(.)(.)", "$2$1"), 16, 10).cast("long")

    rate, channels, bits, size = number(24, 4), number(22, 2), number(34, 2), number(40, 4)
    return raw.select("path", rate.alias("rate"), channels.alias("channels"), bits.alias("bits"), (size / (channels * bits / 8)).cast("long").alias("n_samples")).withColumn("ok", (F.col("rate") == 16000) & (F.col("channels") == 1) & (F.col("bits") == 16))
