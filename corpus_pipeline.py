"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and returns the documents that it
keeps, with all their columns; the last returns packed pieces. Null and empty
texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialume.llm import decontam, lsm, packing, simhash, toxicity
from dialume.llm.common import FEW_IDS, mark, materialize, read, row_key, without
from dialume.llm.queries import TOXIC, tokenizer_path
from dialume.llm.training import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"), fold(F.col("_id"), 3) != 1)
    return docs.filter(toxicity.scorer(model)(F.coalesce("text", F.lit(""))) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier; of rows repeated
    with one identifier and text, one. A null text equals an empty one. Rows
    without an identifier stay only where no equal text has one."""
    found = lsm.exact_dedup(docs)
    named = F.struct(F.col("_id").alias("id"), F.substring("_digest", 1, 8).alias("mark")).alias("_key")
    found = materialize(found.select(named, "_kept"), "copies")
    left = without(docs, found.filter(~F.col("_kept")))
    if found.filter("_kept").groupBy("_key").count().filter("count > 1").isEmpty():
        return left
    return left.withColumn("_mark", mark(left["text"])).dropDuplicates(["doc_id", "_mark"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity (0.8 or more over runs of
    five words, see ``simhash.similar_documents``) the one with the smallest
    identifier. Rows of one identifier share their fate, whatever their texts;
    rows without an identifier stay. Texts without words are near copies."""
    found = simhash.similar_documents(docs).filter("_id is not null and _id <> _root")
    gone = materialize(found.select(F.col("_id").alias("_gone_id")).distinct(), "near")
    gone = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
    return docs.join(gone, docs["doc_id"] == F.col("_gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item: one item's window is
    leaked evaluation data already. (``op5``'s column ``contaminated`` asks for two
    items.) Null and empty texts stay; rows are judged one by one, also those
    without an identifier or with a repeated one."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("text"))
    found = decontam.contamination(keyed, read(spark, sf_dir, "benchmark"), id_col="_key")
    return without(docs, found.filter(F.size("items") > 0).select(F.col("_id").alias("_key")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The trained and the hashing stages cannot be said in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
