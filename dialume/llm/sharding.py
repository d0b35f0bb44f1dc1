"""Sharding by extendible hashing.

A document's hash bits name its place; a shard is a prefix of them. A shard that
exceeds the byte limit is split on the next bit, others stay whole, so the leaf
of a place is its shortest prefix whose bytes fit. All prefixes down to a depth
are summed at once from pre-aggregated cells; only places that still exceed the
limit at that depth are looked at again, deeper. A document larger than the limit
gets a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_view, materialize

#: Hash bits (15 hex digits of an MD5) and the bytes that a shard may hold.
BITS, SHARD_BYTES = 60, 1 << 20
#: Levels that a round adds, below the depth at which even splits would fit.
STEP = 4
#: Up to this depth the directory is small enough to go to every executor.
BROADCAST_DEPTH = 12


def place(id_: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(place, {BITS} - {depth})") if isinstance(depth, int) else F.expr(f"cast(place div pow(2, {BITS} - depth) as bigint)")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``_id, n_bytes, depth, prefix, shard_bytes`` for every row; the shard is
    (depth, prefix) and holds at most ``limit`` bytes of UTF-8, unless all its
    rows have one identifier. Null texts are empty; rows without an identifier
    share the place of the empty string; rows repeated with one identifier stay
    together; an empty table gives no rows; further columns are ignored."""
    view = documents_view(docs, id_col, text_col).select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), place(F.col("_id")).alias("place"))
    rows = materialize(view, "places")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + STEP))
    low, out, left = 0, None, rows
    while True:
        leaves = materialize(_leaves(left, low, depth, limit), "leaves")
        settled = leaves.filter("depth is not null").select("cell", "depth", "shard_bytes")
        cells = F.broadcast(settled) if depth <= BROADCAST_DEPTH else settled
        done = left.withColumn("cell", F.expr(f"shiftright(place, {BITS - depth})")).join(cells, "cell").select("_id", "n_bytes", "place", "depth", "shard_bytes")
        out = done if out is None else out.unionByName(done)
        more = leaves.filter("depth is null").select("cell")
        if depth == BITS or more.isEmpty():
            return out.select("_id", "n_bytes", "depth", F.expr(f"shiftright(place, {BITS} - depth)").alias("prefix"), "shard_bytes")
        left = materialize(left.withColumn("cell", F.expr(f"shiftright(place, {BITS - depth})")).join(more, "cell", "left_semi").drop("cell"), "left")
        low, depth = depth, min(BITS, depth + 2 * STEP)


def _leaves(rows: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """For each cell (prefix of ``depth`` bits): the depth of its leaf and that
    leaf's bytes, null where even the cell is too large."""
    cells = rows.groupBy(F.expr(f"shiftright(place, {BITS - depth})").alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    nodes = cells.select("cell", "b", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = nodes.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == BITS)).select("depth", "prefix", "shard_bytes")
    best = nodes.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "leaf.depth", "leaf.shard_bytes")
