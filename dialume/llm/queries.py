"""The thin queries over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lsm, packing, pii, quality, rlz, sharding, simhash, suffix, toxicity
from .common import read
from .training import fold


def _id() -> Column:
    return F.col("_id").alias("doc_id")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select(_id(), *counts[:4], F.sha2(pii.spans_text(*pii.BASE), 256).alias("base_sha256"), pii.spans_text(*pii.PATTERNS).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.duplicate_words(read(spark, sf_dir, "documents"))
    return found.select(_id(), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.duplicate_bytes(read(spark, sf_dir, "documents"))
    return found.select(_id(), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _scored(found: DataFrame, held: int, folds: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(fold(F.col("_id"), folds) == held, F.lit(False))
    return found.select(_id(), held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


#: Thresholds of the two classifiers.
TOXIC, GOOD = 0.7, 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"), fold(F.col("_id"), 3) != 1)
    return _scored(toxicity.score(docs, model, passages=False), 1, 3, TOXIC)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n = F.size("items")
    return found.select(_id(), "n_words", "n_hit", n.cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(_id(), simhash.hex64(F.col("_fp")).alias("fingerprint"), F.col("_root").alias("component_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(read(spark, sf_dir, "documents"))
    return found.select(_id(), "n_bytes", F.col("depth").cast("long").alias("depth"), F.col("prefix").alias("shard"), "shard_bytes")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = quality.fit_on(docs, read(spark, sf_dir, "labels"), fold(F.col("_id"), 5) != 0)
    return _scored(quality.score(docs, net), 0, 5, GOOD)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsm.exact_dedup(read(spark, sf_dir, "documents"))
    return found.select(_id(), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        source AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN source USING (k) WHERE m < doc_id),
        each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        done AS (SELECT each.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
                        string_agg(word, ' ' ORDER BY each.p) FILTER (gone.p IS NULL) AS kept
                 FROM each LEFT JOIN gone USING (doc_id, p) GROUP BY each.doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN done USING (doc_id)
    """,
    "op3_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k
                FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b WHERE length(h) >= 100)),
        source AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        dup AS (SELECT doc_id, i AS s, i + 50 AS e FROM win JOIN source USING (k) WHERE m < doc_id),
        runs AS (SELECT doc_id, min(s) AS s, max(e) AS e
                 FROM (SELECT *, sum(CASE WHEN s <= prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
                       FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM dup)) GROUP BY doc_id, g),
        gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM runs),
        done AS (SELECT b.doc_id, any_value(h) AS h, coalesce(sum(gaps.e - gaps.s), 0) AS n_removed, count(gaps.s) AS n_spans,
                        coalesce(string_agg(substr(h, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY s), '') || substr(any_value(h), 2 * coalesce(max(gaps.e), 0) + 1) AS kept
                 FROM b LEFT JOIN gaps ON b.doc_id = gaps.doc_id GROUP BY b.doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM done
    """,
    "op5_decontamination": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        windows AS (SELECT DISTINCT item, least(8, len(ws)) AS n, array_to_string(ws[i:i + 7], ' ') AS k
                    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        grams AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
                  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                        FROM w, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
        hits AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_sharding": """
        WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place FROM documents),
        nodes AS (SELECT depth, place >> (60 - depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes
                  FROM r, (SELECT unnest(range(0, 61))::BIGINT AS depth) GROUP BY ALL
                  HAVING sum(n_bytes) <= 1048576 OR min(place) = max(place) OR depth = 60),
        leaf AS (SELECT doc_id, min(depth) AS depth FROM r JOIN nodes ON r.place >> (60 - depth) = shard GROUP BY doc_id)
        SELECT doc_id, n_bytes, depth, shard, shard_bytes
        FROM r JOIN leaf USING (doc_id) JOIN nodes USING (depth) WHERE place >> (60 - depth) = shard
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
