"""Turns, words and intervals derived from the test tables.

Time is whole milliseconds, so sums do not depend on the order of rows. A turn is
``clip_id, idx, speaker, start_ms, end_ms, text, n_tok``; a word is ``clip_id, wid,
w, start_ms, end_ms``, where ``wid`` orders the words of a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOKEN_MS, WORD_MS = 400, 350
#: Words of a turn that ``wid`` has room for.
TURN_ROOM = 1_000_000
ROLES = ("user", "assistant", "system")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def turns_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a clip: a turn lasts as long as its tokens, and odd
    turns start up to 600 ms early, so that neighbours overlap."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.size(tokens(F.col("text"))).cast("long").alias("n_tok"))
    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("cum", TOKEN_MS * F.coalesce(F.sum("n_tok").over(earlier), F.lit(0)))
    start = F.col("cum") - F.when(F.col("turn") % 2 == 1, F.least(F.lit(600), F.col("cum"))).otherwise(0)
    c = c.withColumn("start_ms", start).filter("n_tok > 0")
    return c.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "start_ms", (F.col("start_ms") + TOKEN_MS * F.col("n_tok")).alias("end_ms"), "text", "n_tok")


def words_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns_ref(spark, sf_dir).select("clip_id", "idx", "speaker", "start_ms", F.posexplode(tokens(F.col("text"))).alias("pos", "w"))
    return t.select("clip_id", (F.col("idx") * TURN_ROOM + F.col("pos")).alias("wid"), "idx", "pos", "speaker", "w", (F.col("start_ms") + TOKEN_MS * F.col("pos")).alias("start_ms"))


def words_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as a recogniser might give them: some missing, some wrong, some late."""
    k = F.col("clip_id") * 31 + F.col("idx") * 7 + F.col("pos")
    start = F.col("start_ms") + F.when(k % 17 == 0, 700).otherwise(0)
    r = words_ref(spark, sf_dir).filter(k % 11 != 0)
    r = r.select("clip_id", "wid", F.when(k % 13 == 0, "xx").otherwise(F.col("w")).alias("w"), start.cast("long").alias("start_ms"))
    return r.withColumn("end_ms", F.col("start_ms") + WORD_MS)


def turns_hyp(spark: SparkSession, sf_dir: str, system: str = "a") -> DataFrame:
    """The turns as a diarizer might give them; system ``b`` has no clips divisible by four."""
    k = F.col("clip_id") + F.col("idx")
    role = F.when((k % 6 == 0) & (F.col("speaker") == "user"), "assistant").when((k % 6 == 0) & (F.col("speaker") == "assistant"), "user").otherwise(F.col("speaker"))
    label = F.concat(F.lit("spk"), F.when(role == "user", "0").when(role == "assistant", "1").otherwise("2"))
    shift = (k % 5 - 2) * 100
    t = turns_ref(spark, sf_dir).select("clip_id", "idx", label.alias("speaker"), F.greatest(F.lit(0), F.col("start_ms") + shift).alias("start_ms"), F.greatest(F.lit(0), F.col("end_ms") + shift).alias("end_ms"))
    t = t.filter("end_ms > start_ms")
    return t.filter("clip_id % 4 <> 0") if system == "b" else t


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as activity of users, a clip a day."""
    e = table(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(F.to_date("ts").cast("string").alias("clip_id"), F.col("event_id").alias("idx"), F.col("user_id").alias("speaker"), start.alias("start_ms"), (start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms")).filter("end_ms > start_ms")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only log: ``key, seq, status``."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


#: Reference and hypothesis speakers in the order in which the SQL tries matchings.
SPEAKERS = (["user", "assistant", "system"], ["spk0", "spk1", "spk2"])

#: The same views in DuckDB's SQL, for the oracles.
SQL = {
    "ref": """
        tok AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations),
        cum AS (SELECT *, 400 * coalesce(sum(len(ws)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM tok),
        ref AS (SELECT conv_id AS clip_id, turn AS idx, role AS speaker, text, ws, len(ws) AS n_tok,
                       (c - CASE WHEN turn % 2 = 1 THEN least(600, c) ELSE 0 END)::BIGINT AS start_ms,
                       (c - CASE WHEN turn % 2 = 1 THEN least(600, c) ELSE 0 END + 400 * len(ws))::BIGINT AS end_ms
                FROM cum WHERE len(ws) > 0)""",
    "words": """
        rw AS (SELECT clip_id, idx, speaker, start_ms AS s, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM ref),
        rk AS (SELECT *, clip_id * 31 + idx * 7 + pos AS k FROM rw),
        words AS (SELECT clip_id, idx * 1000000 + pos AS wid, CASE WHEN k % 13 = 0 THEN 'xx' ELSE w END AS w,
                         (s + 400 * pos + CASE WHEN k % 17 = 0 THEN 700 ELSE 0 END)::BIGINT AS start_ms,
                         (s + 400 * pos + CASE WHEN k % 17 = 0 THEN 700 ELSE 0 END + 350)::BIGINT AS end_ms
                  FROM rk WHERE k % 11 <> 0)""",
    "hyp": """
        h0 AS (SELECT *, clip_id + idx AS k, ((clip_id + idx) % 5 - 2) * 100 AS sh FROM ref),
        h1 AS (SELECT clip_id, idx, 'spk' || CASE CASE WHEN k % 6 = 0 AND speaker = 'user' THEN 'assistant' WHEN k % 6 = 0 AND speaker = 'assistant' THEN 'user' ELSE speaker END
                      WHEN 'user' THEN '0' WHEN 'assistant' THEN '1' ELSE '2' END AS speaker,
                      greatest(0, start_ms + sh) AS start_ms, greatest(0, end_ms + sh) AS end_ms FROM h0),
        hyp_a AS (SELECT * FROM h1 WHERE end_ms > start_ms),
        hyp_b AS (SELECT * FROM hyp_a WHERE clip_id % 4 <> 0)""",
    "att": """
        ov AS (SELECT w.clip_id, w.wid, t.idx, t.speaker, t.start_ms AS s, t.end_ms AS e, least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) AS o
               FROM words w JOIN hyp_a t ON w.clip_id = t.clip_id AND t.start_ms < w.end_ms AND t.end_ms > w.start_ms),
        spans AS (SELECT clip_id, wid, count(*) AS n_spans FROM ov GROUP BY ALL),
        best AS (SELECT clip_id, wid, speaker FROM ov QUALIFY row_number() OVER (PARTITION BY clip_id, wid ORDER BY o DESC, s, e, idx) = 1),
        gaps AS (SELECT w.clip_id, w.wid, t.speaker FROM (SELECT * FROM words ANTI JOIN best USING (clip_id, wid)) w JOIN hyp_a t ON w.clip_id = t.clip_id
                 QUALIFY row_number() OVER (PARTITION BY w.clip_id, w.wid ORDER BY greatest(0, t.start_ms - w.end_ms, w.start_ms - t.end_ms), t.start_ms, t.end_ms, t.idx) = 1),
        att AS (SELECT words.*, coalesce(best.speaker, gaps.speaker) AS spk, best.speaker IS NULL AS orphan, coalesce(n_spans, 0) AS n_spans
                FROM words LEFT JOIN best USING (clip_id, wid) LEFT JOIN gaps USING (clip_id, wid) LEFT JOIN spans USING (clip_id, wid))""",
    "units": """
        u0 AS (SELECT *, CASE WHEN spk IS DISTINCT FROM lag(spk) OVER (PARTITION BY clip_id ORDER BY wid) OR start_ms - lag(end_ms) OVER (PARTITION BY clip_id ORDER BY wid) > 500
                              OR lag(wid) OVER (PARTITION BY clip_id ORDER BY wid) IS NULL THEN 1 ELSE 0 END AS cut FROM att),
        uw AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id ORDER BY wid) - 1 AS unit FROM u0),
        units AS (SELECT clip_id, unit, any_value(spk) AS spk, arg_min(start_ms, wid) AS start_ms, arg_max(end_ms, wid) AS end_ms, count(*) AS n_words, string_agg(w, ' ' ORDER BY wid) AS text FROM uw GROUP BY ALL)""",
    "der": """
        refi AS (SELECT clip_id, speaker, min(start_ms) AS s, max(end_ms) AS e FROM (
                   SELECT *, sum(n) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms) AS g FROM (
                     SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ref))
                 GROUP BY clip_id, speaker, g),
        lim AS (SELECT clip_id, max(end_ms) AS dur, count(DISTINCT speaker) AS n_ref_speakers FROM ref GROUP BY ALL),
        hypi AS (SELECT h.clip_id, speaker, s, least(e, dur) AS e FROM (
                   SELECT clip_id, speaker, min(start_ms) AS s, max(end_ms) AS e FROM (
                     SELECT *, sum(n) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms) AS g FROM (
                       SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM hyp_b))
                   GROUP BY clip_id, speaker, g) h JOIN lim USING (clip_id) WHERE s < dur),
        cells AS (SELECT r.clip_id, r.speaker AS r, h.speaker AS h, sum(least(r.e, h.e) - greatest(r.s, h.s)) AS ms
                  FROM refi r JOIN hypi h ON r.clip_id = h.clip_id AND r.s < h.e AND r.e > h.s GROUP BY ALL),
        perms AS (SELECT * FROM (VALUES (0, 'user', 'spk0'), (0, 'assistant', 'spk1'), (0, 'system', 'spk2'), (1, 'user', 'spk0'), (1, 'assistant', 'spk2'), (1, 'system', 'spk1'),
                                        (2, 'user', 'spk1'), (2, 'assistant', 'spk0'), (2, 'system', 'spk2'), (3, 'user', 'spk1'), (3, 'assistant', 'spk2'), (3, 'system', 'spk0'),
                                        (4, 'user', 'spk2'), (4, 'assistant', 'spk0'), (4, 'system', 'spk1'), (5, 'user', 'spk2'), (5, 'assistant', 'spk1'), (5, 'system', 'spk0')) v(p, r, h)),
        tries AS (SELECT clip_id, p, sum(ms) AS ms FROM cells JOIN perms USING (r, h) GROUP BY ALL),
        pick AS (SELECT clip_id, p, ms AS correct FROM tries QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ms DESC, p) = 1),
        marks AS (SELECT clip_id, s AS pt, 1 AS r, 0 AS h FROM refi UNION ALL SELECT clip_id, e, -1, 0 FROM refi
                  UNION ALL SELECT clip_id, s, 0, 1 FROM hypi UNION ALL SELECT clip_id, e, 0, -1 FROM hypi),
        pts AS (SELECT clip_id, pt, sum(r) AS r, sum(h) AS h FROM marks GROUP BY ALL),
        el AS (SELECT clip_id, lead(pt) OVER (PARTITION BY clip_id ORDER BY pt) - pt AS d, sum(r) OVER (PARTITION BY clip_id ORDER BY pt) AS nr, sum(h) OVER (PARTITION BY clip_id ORDER BY pt) AS nh FROM pts),
        tm AS (SELECT clip_id, sum(nr * d)::BIGINT AS total_ms, sum(greatest(0, nr - nh) * d)::BIGINT AS miss_ms, sum(greatest(0, nh - nr) * d)::BIGINT AS fa_ms, sum(least(nr, nh) * d)::BIGINT AS both_ms FROM el WHERE d IS NOT NULL GROUP BY ALL)""",
    "intervals": """
        iv0 AS (SELECT ts::DATE::VARCHAR AS clip_id, event_id AS idx, user_id AS speaker, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round(value * 1000)::BIGINT AS end_ms FROM events),
        intervals AS (SELECT * FROM iv0 WHERE end_ms > start_ms)""",
}


def sql(*names: str) -> str:
    return ",".join(SQL[n] for n in names)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up but fixed per-clip scores of two recognisers, two diarizers and two
    methods, for the report's tables: counts by remainders of clip and condition."""
    clips = turns_ref(spark, sf_dir).groupBy("clip_id").agg(F.sum("n_tok").alias("length"), F.count(F.lit(1)).alias("n_turns"))
    models = [(a, d, m, i) for i, (a, d, m) in enumerate((a, d, m) for a in ("x", "y") for d in ("a", "b") for m in ("baseline", "rule"))]
    grid = clips.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("asr"), F.lit(d).alias("diar"), F.lit(m).alias("method"), F.lit(k).alias("k")) for a, d, m, k in models])))
    grid = grid.filter("not (diar = 'b' and clip_id % 4 = 0)")
    wer = F.expr("(clip_id * 13 + (k div 4) * 7) % (length + 1)")
    cp = F.expr("least(length + 5, (clip_id * 13 + (k div 4) * 7) % (length + 1) + (clip_id + k) % 5)")
    return grid.select("clip_id", "asr", "diar", "method", "length", wer.alias("wer_errors"), cp.alias("cp_errors"), (cp - F.expr("(clip_id + k) % 2")).alias("di_errors"), F.expr("(clip_id * 3 + k) % (length div 2 + 1)").alias("wder_errors"), F.expr("length div 2 + 1").alias("wder_length"))


SQL["scores"] = """
        clips AS (SELECT clip_id, sum(n_tok)::BIGINT AS length FROM ref GROUP BY ALL),
        models AS (SELECT * FROM (VALUES ('x', 'a', 'baseline', 0), ('x', 'a', 'rule', 1), ('x', 'b', 'baseline', 2), ('x', 'b', 'rule', 3),
                                         ('y', 'a', 'baseline', 4), ('y', 'a', 'rule', 5), ('y', 'b', 'baseline', 6), ('y', 'b', 'rule', 7)) v(asr, diar, method, k)),
        sc0 AS (SELECT *, (clip_id * 13 + (k // 4) * 7) % (length + 1) AS wer_errors, least(length + 5, (clip_id * 13 + (k // 4) * 7) % (length + 1) + (clip_id + k) % 5) AS cp_errors
                FROM clips, models WHERE NOT (diar = 'b' AND clip_id % 4 = 0)),
        scores AS (SELECT *, cp_errors - (clip_id + k) % 2 AS di_errors, (clip_id * 3 + k) % (length // 2 + 1) AS wder_errors, length // 2 + 1 AS wder_length FROM sc0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score frames: fifty to a clip, three blocks of 21 tokens and a blank."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("clip_id"), (F.col("vec_id") % 50).alias("frame"), F.col("embedding").alias("scores"))


def token_table(spark: SparkSession, blocks: int = 3, size: int = 21) -> DataFrame:
    return spark.range(blocks * size).select("id", F.concat(F.lit("t"), F.col("id")).alias("piece"), (F.col("id") % 3 == 0).alias("starts"))
