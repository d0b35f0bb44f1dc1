"""Logs, resumption, fallback and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last record of each key of an append-only log, as one aggregate."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(key, "_r.*")


def pending(items: DataFrame, log: DataFrame, key: str = "key", done: tuple[str, ...] = ("ok",)) -> DataFrame:
    """``items`` whose last record does not say that they are done."""
    finished = latest(log, key).filter(F.col("status").isin(*done)).select(key)
    return items.join(finished, key, "left_anti")


def resume_verified(items: DataFrame, last: DataFrame, files: DataFrame, permanent: tuple[str, ...], key: str = "key") -> DataFrame:
    """``items`` with ``skip``: a finished item only if its file exists with the
    recorded length, a failed one only if its class is permanent."""
    j = items.join(last.select(key, "status", "error_class", "n_samples"), key, "left").join(files.select(key, F.col("n_samples").alias("_have")), key, "left")
    done = F.col("status").isin("ok", "short_source") & F.col("_have").eqNullSafe(F.col("n_samples")) & F.col("_have").isNotNull()
    failed = (F.col("status") == "failed") & F.col("error_class").isin(*permanent)
    return j.withColumn("skip", F.coalesce(done | failed, F.lit(False))).drop("_have")


#: Keys that split a ranking into parts.
SPLITTERS = 256


def shard(items: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Every n-th item in the order of the keys. Ranks are counted between a
    bounded sample of keys, so no task sees all items."""
    drawn = sorted(r[0] for r in items.select(key).distinct().orderBy(F.xxhash64(key)).limit(SPLITTERS).collect() if r[0] is not None)
    if not drawn:
        return items.limit(0)
    part = F.size(F.filter(F.lit(drawn), lambda s: s <= F.col(key)))
    parted = items.withColumn("_p", part)
    counts = {r["_p"]: r["count"] for r in parted.groupBy("_p").count().collect()}  # at most SPLITTERS + 1
    before, done = [], 0
    for p in range(len(drawn) + 1):
        before.append(done)
        done += counts.get(p, 0)
    local = F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1
    return parted.withColumn("_rank", F.get(F.lit(before), F.col("_p")) + local).filter(F.col("_rank") % n == i).drop("_p", "_rank")


def language_fallback(primary: DataFrame, fallback: DataFrame, served: list[str], key: str = "clip_id") -> DataFrame:
    """The primary document unless its language is not served (or unknown) and a
    fallback exists; ``source`` says which, ``missing`` where one was wanted."""
    wanted = ~F.coalesce(F.col("lang").isin(served), F.lit(False))
    j = primary.join(fallback.select(key, F.col("text").alias("_text")), key, "left")
    use = wanted & F.col("_text").isNotNull()
    return j.select(key, "lang", F.when(use, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(use, "fallback").otherwise("primary").alias("source"), (wanted & F.col("_text").isNull()).alias("missing"))


def common_subset(rows: DataFrame, key: str = "clip_id", condition: str = "condition") -> DataFrame:
    """Keys that every condition has."""
    n = rows.select(condition).distinct().agg(F.count(F.lit(1)).alias("_n"))
    have = rows.groupBy(key).agg(F.count_distinct(condition).alias("_k"))
    return have.join(F.broadcast(n), F.col("_k") == F.col("_n")).select(key)  # one row


def missing_keys(need: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return need.select(keys).distinct().join(have.select(keys).distinct(), keys, "left_anti")


def with_reason(hyp: DataFrame, ref: DataFrame, key: str = "clip_id") -> DataFrame:
    """``hyp`` with ``reason``: no reference, empty reference, or null."""
    r = ref.select(key, F.col("n_words").alias("_n"))
    reason = F.when(F.col("_n").isNull(), "no reference").when(F.col("_n") == 0, "empty reference")
    return hyp.join(r, key, "left").withColumn("reason", reason).drop("_n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bag_intersection(a: DataFrame, b: DataFrame, keys: list[str], item: str = "w") -> DataFrame:
    """Size of the multiset intersection: ``keys, n_common`` (pairs without any are left out)."""
    x = a.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_x"))
    y = b.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_y"))
    return x.join(y, [*keys, item]).groupBy(*keys).agg(F.sum(F.least("_x", "_y")).alias("n_common"))


def domain_order(df: DataFrame, ranks: dict[str, list[str]], *ties: str) -> DataFrame:
    """Sorted by the places of values in given lists (others last), then by ``ties``."""

    def rank(c: str, values: list[str]) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)), F.lit(99))

    return df.orderBy(*[rank(c, v) for c, v in ranks.items()], *ties)


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value; of equals the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))["v"].alias(value))


def content_digest(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """SHA-256 over the files' digests in the order of their paths, line ends as LF."""
    each = files.select(F.col(path).alias("p"), F.sha2(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), 256).alias("h"))
    packed = each.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("f"))
    return packed.select(F.sha2(F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["p"], x["h"])), "\n"), 256).alias("digest"))
