"""Connected components over links in a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, salt_of


def with_least(edges: DataFrame) -> DataFrame:
    """``u, v`` with ``m``, the smallest ``v`` of each ``u``. A ``u`` with very
    many links is dealt over salts: each salt gives one partial minimum, and the
    overall one travels back to at most ``salts`` rows."""
    salted = edges.withColumn("_s", salt_of(F.struct("v"), partitions(edges.sparkSession)))
    part = salted.groupBy("u", "_s").agg(F.min("v").alias("m"))
    whole = part.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(part.select("u", "_s").join(whole, "u"), ["u", "_s"]).drop("_s")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``: numbers) but the
    roots themselves; the root is the smallest node that can be reached.

    Large stars and small stars alternate until every link leads to a root; the
    rounds grow with the logarithm of the longest chain. Each round is written to
    the shared folder, so nothing depends on executors that held an earlier one.
    """
    links = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = links.union(links.select("v", "u"))
        large = with_least(both).select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("_centre")).filter("u > _centre").filter("u <> v").select("u", "v").distinct()
        # small stars: each node's smaller neighbours, and the node, join the smallest
        least = with_least(large)
        small = least.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "links")
        if new.count() == links.count() and new.join(links, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = new
