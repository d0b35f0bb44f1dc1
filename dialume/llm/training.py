"""Labelled documents for the classifiers: a bounded sample, drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_view

#: Labelled documents that a classifier is fitted on, and the bytes of all their texts, at most.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; null for none."""
    return F.crc32(id_.cast("string").cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> list[tuple[str, int]]:
    """(text, label) of the first rows of ``labels`` for which ``keep`` (over
    ``_id``) holds, in the order of the identifiers' hashes: at most ``sample``
    rows, and no more than fit into ``sample_bytes`` (one at least). Whole texts
    of any length take part. Labels that are null or neither 0 nor 1 are no
    labels. The result is bounded, so the driver may hold it."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1)).filter(keep)
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_order", F.xxhash64(F.lit(label), "_id"))
    chosen = chosen.orderBy("_order", "_id").limit(sample)
    rows = documents_view(docs, id_col, text_col).join(F.broadcast(chosen), "_id")
    sizes = rows.groupBy("_id").agg(F.min("_order").alias("_order"), F.sum(F.octet_length("_text").cast("long")).alias("_size")).collect()
    left, used = sample_bytes, []
    for r in sorted(sizes, key=lambda r: (r["_order"], r["_id"])):
        left -= r["_size"]
        if left < 0 and used:
            break
        used.append(r["_id"])
    if not used:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in used], rows.select("_id").schema))
    found = sorted((r["_id"], r["_text"], r["_label"]) for r in rows.join(few, "_id", "left_semi").select("_id", "_text", "_label").collect())
    return [(t, y) for _, t, y in found]
