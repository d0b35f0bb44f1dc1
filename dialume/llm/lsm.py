"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Rows fill *memtables*, stretches of at most ``2 ** MEMTABLE_BITS`` rows of one
partition. Each is flushed as a run: its distinct digests in order, with the
smallest and largest identifier and the number of rows, as Parquet with min/max
statistics and a Bloom filter on the digest. *Compaction* merges the runs into one
row per digest. A *probe* first asks a bounded bit map of the digests that have
copies; only texts that pass it are exchanged, joined with the compacted level,
and compared byte by byte with the text that stays.

A digest held by a large part of all rows is never gathered in one task: every
memtable has one entry for it, these are what compaction sums, and the totals
travel back to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_view, materialize, partitions, salt_of
from .decontam import bit_map, bit_places

#: Rows of a memtable, as a power of two; flushes that an index can tell apart.
MEMTABLE_BITS, FLUSH_SHIFT = 16, 50
#: Rows that are verified against one copy of the kept text.
VERIFY_ROWS = 64
BLOOM = {"parquet.bloom.filter.enabled#_digest": "true"}


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class LsmIndex:
    """Digest runs in the shared folder; ``flush`` adds those of some rows, ``compact`` merges all."""

    def __init__(self, spark: SparkSession, memtable_bits: int = MEMTABLE_BITS):
        self.spark, self.memtable_bits = spark, memtable_bits
        self.rows: list[DataFrame] = []
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows (``_id, _digest, _mem``), written once so that the memtables stay as they are."""
        first = F.lit(len(self.runs) << FLUSH_SHIFT).cast("long")
        mem = first + F.shiftrightunsigned(F.monotonically_increasing_id(), self.memtable_bits)
        rows = documents_view(docs, id_col, text_col).select("_id", digest(F.col("_text")).alias("_digest"), mem.alias("_mem"))
        self.rows.append(materialize(rows, "rows"))
        run = self.rows[-1].groupBy("_mem", "_digest").agg(F.min("_id").alias("_min"), F.max("_id").alias("_max"), F.count(F.lit(1)).alias("_n"))
        self.runs.append(materialize(run.sortWithinPartitions("_mem", "_digest"), "run", **BLOOM))
        return self.rows[-1]

    def all_runs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs)

    def compact(self) -> DataFrame:
        """One row per digest: smallest and largest identifier, rows."""
        merged = self.all_runs().groupBy("_digest").agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("_n").alias("_size"))
        self.level = materialize(merged.sortWithinPartitions("_digest"), "level", **BLOOM)
        return self.level

    def totals(self) -> DataFrame:
        """The compacted totals, dealt back to each memtable that holds the digest."""
        return self.all_runs().select("_mem", "_digest").join(self.level if self.level is not None else self.compact(), "_digest")

    def copied(self, count: int):
        """Whether a digest may have copies: surely if it has, and rarely if it has none."""
        prints = self.level.filter("_size > 1").select(F.xxhash64("_digest").alias("h"), F.lit(0).alias("n"))
        bits, size = bit_map(prints, count)

        def held(d: Column) -> Column:
            tests = [F.getbit(F.get(bits, F.shiftright(i, 6)), i % 64) == 1 for i in bit_places(F.xxhash64(d), F.lit(0), size)]
            return tests[0] & tests[1]

        return held


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", salts: int | None = None) -> DataFrame:
    """``_id, _digest`` (SHA-256 of the text's UTF-8 bytes), ``_keep, _size, _kept`` for every row.

    Of rows with equal texts the one with the largest (``keep="smallest"``: the
    smallest) identifier stays. A null text equals an empty one. Rows repeated
    with one identifier count in ``_size`` and share their fate; rows without
    identifier stay only if no row of their group has one. An empty table gives
    no rows; other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = "_max" if keep == "largest" else "_min"
    index = LsmIndex(docs.sparkSession)
    rows = index.flush(docs, id_col, text_col)
    index.compact()
    totals = index.totals().select("_mem", "_digest", F.col(best).alias("_keep"), "_size")
    found = materialize(rows.join(totals, ["_mem", "_digest"]).drop("_mem"), "found")
    count = index.level.filter("_size > 1").count()
    if count:
        salt = salt_of(F.struct("_id"), salts or max(16, partitions(docs.sparkSession))).alias("_salt")
        asked = found.filter("_size > 1").select("_digest", salt, "_keep", "_size").distinct()
        texts = documents_view(docs, id_col, text_col).select("_id", digest(F.col("_text")).alias("_digest"), salt, "_text")
        hits = texts.filter(index.copied(count)(F.col("_digest"))).join(asked, ["_digest", "_salt"]).drop("_salt")
        hits = materialize(hits, "hits")
        if not _mismatches(hits).isEmpty():
            found = _by_bytes(found, hits, best)
    return found.withColumn("_kept", F.col("_id").eqNullSafe(F.col("_keep")))


def _mismatches(hits: DataFrame) -> DataFrame:
    """Rows whose bytes differ from those of the row that their digest keeps."""
    kept = hits.filter(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_digest").agg(F.min("_text").alias("_kept_text"), F.max("_size").alias("_size"))
    copies = F.ceil(F.col("_size") / VERIFY_ROWS).cast("int")
    kept = kept.select("_digest", "_kept_text", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_part"))
    rows = hits.withColumn("_part", F.pmod(F.monotonically_increasing_id(), copies).cast("int"))
    return rows.join(kept, ["_digest", "_part"]).filter(F.col("_text") != F.col("_kept_text")).select("_digest")


def _by_bytes(found: DataFrame, hits: DataFrame, best: str) -> DataFrame:
    """Groups of digests that different texts share, taken apart by their bytes."""
    shared = _mismatches(hits).distinct()
    apart = hits.join(shared, "_digest", "left_semi").select("_id", "_digest", "_text")
    agg = F.max if best == "_max" else F.min
    groups = apart.groupBy("_digest", "_text").agg(agg("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    again = apart.join(groups, ["_digest", "_text"]).select("_digest", "_id", "_keep", "_size")
    return found.join(shared, "_digest", "left_anti").select("_digest", "_id", "_keep", "_size").unionByName(again)
