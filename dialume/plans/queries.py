"""One query for each operator, over the views of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribute as A
from ..operators import decode as D
from ..operators import der as E
from ..operators import intervals as I
from ..operators import relabel as R
from ..operators import sets as S
from ..operators import turns as P
from ..operators import wer as M
from ..sources import rttm
from . import report
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _attributed(spark: SparkSession, sf: str) -> DataFrame:
    return A.attribute(V.words_hyp(spark, sf), V.turns_hyp(spark, sf))


ATT = f"WITH {V.sql('ref', 'words', 'hyp', 'att')}"
UNITS = f"WITH {V.sql('ref', 'words', 'hyp', 'att', 'units')}"
REF = f"WITH {V.sql('ref')}"


# attribution -------------------------------------------------------------------


@query(ATT + " SELECT clip_id, spk, count(*) AS n_words, count(*) FILTER (orphan) AS n_orphans, sum(n_spans)::BIGINT AS n_spans FROM att GROUP BY ALL")
def attribute_max_overlap(spark, sf):
    return _attributed(spark, sf).groupBy("clip_id", "spk").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("orphan").alias("n_orphans"), F.sum("n_spans").alias("n_spans"))


@query(ATT + " SELECT clip_id, wid, w, spk, orphan FROM att")
def attributed_words(spark, sf):
    return _attributed(spark, sf).select("clip_id", "wid", "w", "spk", "orphan")


@query(
    ATT
    + """, seq AS (SELECT *, lag(e) OVER (PARTITION BY clip_id, wid ORDER BY s, e) AS pe FROM ov),
    con AS (SELECT clip_id, wid, count(*) AS n, bool_or(coalesce(s < pe, false)) AS bo FROM seq GROUP BY ALL HAVING count(*) >= 2)
    SELECT clip_id, wid, CASE WHEN bo THEN n ELSE 0 END AS overlap, NOT bo AS boundary FROM con"""
)
def contested_words(spark, sf):
    c = A.contested(V.words_hyp(spark, sf), V.turns_hyp(spark, sf))
    return c.select("clip_id", "wid", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), "boundary")


@query(
    ATT
    + """, seq AS (SELECT *, lag(e) OVER (PARTITION BY clip_id, wid ORDER BY s, e) AS pe FROM ov),
    con AS (SELECT clip_id, wid, bool_or(coalesce(s < pe, false)) AS bo FROM seq GROUP BY ALL HAVING count(*) >= 2)
    SELECT count(*) AS n_words, round(100.0 * count(*) FILTER (orphan) / count(*), 4) AS orphan_pct, round(100.0 * count(*) FILTER (bo) / count(*), 4) AS overlap_pct,
           round(100.0 * count(*) FILTER (NOT bo) / count(*), 4) AS boundary_pct FROM att LEFT JOIN con USING (clip_id, wid)"""
)
def attribution_rates(spark, sf):
    c = A.contested(V.words_hyp(spark, sf), V.turns_hyp(spark, sf))
    j = _attributed(spark, sf).join(c, ["clip_id", "wid"], "left")
    pct = lambda x: F.round(100 * F.count_if(x) / F.count(F.lit(1)), 4)
    return j.agg(F.count(F.lit(1)).alias("n_words"), pct(F.col("orphan")).alias("orphan_pct"), pct(F.col("overlap").isNotNull()).alias("overlap_pct"), pct(F.coalesce("boundary", F.lit(False))).alias("boundary_pct"))


@query(ATT + " SELECT clip_id, spk, string_agg(w, ' ' ORDER BY wid) AS text, count(*) AS n_words FROM att WHERE spk IS NOT NULL GROUP BY ALL")
def by_speaker_text(spark, sf):
    return A.by_speaker_text(_attributed(spark, sf))


# parsing and checking ------------------------------------------------------------


def _packed(spark, sf):
    t = V.turns_ref(spark, sf).withColumn("speaker", F.concat(F.lit("Speaker "), "speaker"))
    part = F.struct("idx", rttm.packed_turns(F.col("speaker"), F.col("start_ms"), F.col("end_ms")).alias("d"), F.format_string("[%.2f-%.2f] %s", F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.regexp_replace("text", r"\|", " ")).alias("a"))
    g = t.groupBy("clip_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return g.select("clip_id", F.array_join(F.transform("p", lambda x: x["d"]), "|").alias("diarization_segments"), F.array_join(F.transform("p", lambda x: x["a"]), "| |").alias("asr_segments"))


@query(REF + " SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY idx) - 1 AS pos, 'Speaker_' || speaker AS speaker, start_ms, end_ms, trim(replace(text, '|', ' ')) AS text FROM ref")
def parse_packed_turns(spark, sf):
    p = _packed(spark, sf)
    both = P.zip_segments(P.parse_diarization(p.select("clip_id", "diarization_segments")), P.parse_asr(p.select("clip_id", "asr_segments")), ["clip_id"])
    return both.select("clip_id", F.col("pos").cast("long").alias("pos"), "speaker", "start_ms", "end_ms", "text")


def _checked(spark, sf):
    t = V.turns_ref(spark, sf)
    limit = t.groupBy("clip_id").agg(F.expr("max(end_ms) * 6 div 10").alias("limit"))
    swap = F.col("idx") % 7 == 3
    t = t.select("clip_id", "idx", F.when(swap, F.col("end_ms")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(swap, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))
    return P.clip_turns(t.join(limit, "clip_id"), F.col("limit"), tiny_ms=900)


@query(
    REF
    + """, lim AS (SELECT clip_id, (max(end_ms) * 6) // 10 AS d FROM ref GROUP BY ALL),
    t AS (SELECT clip_id, CASE WHEN idx % 7 = 3 THEN end_ms ELSE start_ms END AS a, CASE WHEN idx % 7 = 3 THEN start_ms ELSE end_ms END AS b, d FROM ref JOIN lim USING (clip_id)),
    s AS (SELECT *, b < a AS inv, b >= a AND a >= d AS outside, greatest(0, a) AS x, least(b, d) AS y FROM t)
    SELECT clip_id, count(*) AS n_turns, count(*) FILTER (NOT inv AND NOT outside AND y - x >= 900) AS n_kept, count(*) FILTER (inv) AS n_inverted, count(*) FILTER (outside) AS n_outside,
           count(*) FILTER (NOT inv AND NOT outside AND y - x < 900) AS n_tiny, count(*) FILTER (NOT inv AND NOT outside AND (x <> a OR y <> b)) AS n_clipped,
           sum(CASE WHEN inv THEN 0 WHEN outside THEN b - a ELSE (b - a) - (y - x) END)::BIGINT AS lost_ms FROM s GROUP BY ALL"""
)
def clip_turns_anomalies(spark, sf):
    return P.anomalies(_checked(spark, sf))


META = (
    REF
    + """, one AS (SELECT clip_id, speaker, min(start_ms) AS s, max(end_ms) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms) AS g FROM (
                     SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ref)) GROUP BY clip_id, speaker, g),
    pts AS (SELECT DISTINCT clip_id, unnest([s, e]) AS pt FROM one),
    el AS (SELECT clip_id, pt AS a, lead(pt) OVER (PARTITION BY clip_id ORDER BY pt) AS b FROM pts),
    act AS (SELECT el.clip_id, a, b, count(DISTINCT speaker) AS k FROM el JOIN one ON el.clip_id = one.clip_id AND one.s <= a AND one.e >= b WHERE b IS NOT NULL GROUP BY ALL),
    sp AS (SELECT clip_id, sum(b - a)::BIGINT AS speech_ms, sum(CASE WHEN k >= 2 THEN b - a ELSE 0 END)::BIGINT AS overlap_ms FROM act GROUP BY ALL)"""
)


@query(META + " SELECT clip_id, speech_ms FROM sp")
def union_speech(spark, sf):
    return I.union_speech(V.turns_ref(spark, sf))


@query(META + " SELECT clip_id, overlap_ms FROM sp")
def speaker_overlap(spark, sf):
    return I.speaker_overlap(V.turns_ref(spark, sf))


@query(
    META
    + """ SELECT clip_id, duration_ms, n_speakers, n_segments, n_ref_words, speech_ms, overlap_ms, round(speech_ms / duration_ms, 4) AS speech_frac, round(overlap_ms / speech_ms, 4) AS overlap_frac_of_speech,
    round(overlap_ms / duration_ms, 4) AS overlap_frac_of_clip, CASE WHEN letters > 0 THEN 'Latin' ELSE 'unknown' END AS language
    FROM (SELECT clip_id, max(end_ms) AS duration_ms, count(DISTINCT speaker) AS n_speakers, count(*) AS n_segments,
                 sum(len(list_filter(regexp_split_to_array(regexp_replace(text, '\\([^)]*\\)', ' ', 'g'), '\\s+'), lambda x: x <> '')))::BIGINT AS n_ref_words,
                 sum(len(regexp_extract_all(regexp_replace(text, '\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g'), '\\p{Latin}'))) AS letters FROM ref GROUP BY ALL) JOIN sp USING (clip_id)""".replace("\\\\", "\\")
)
def clip_meta(spark, sf):
    return P.clip_meta(V.turns_ref(spark, sf))


@query(META + " SELECT n_speakers, 'Latin' AS language, count(*) AS n_clips, sum(duration_ms)::BIGINT AS duration_ms, sum(speech_ms)::BIGINT AS speech_ms FROM (SELECT clip_id, max(end_ms) AS duration_ms, count(DISTINCT speaker) AS n_speakers FROM ref GROUP BY ALL) JOIN sp USING (clip_id) GROUP BY ALL")
def meta_summary(spark, sf):
    return P.meta_summary(P.clip_meta(V.turns_ref(spark, sf))).select("n_speakers", "language", "n_clips", "duration_ms", "speech_ms")


# intervals --------------------------------------------------------------------


@query(
    f"WITH {V.sql('intervals')}"
    + """, x AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER w THEN 0 ELSE 1 END AS n FROM intervals WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS i FROM x)
    SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY clip_id, i"""
)
def activity_islands(spark, sf):
    return I.islands(V.intervals(spark, sf), ["clip_id"])


@query(
    f"WITH {V.sql('intervals')}"
    + """, one AS (SELECT clip_id, speaker, min(start_ms) AS s, max(end_ms) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms) AS g FROM (
          SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY clip_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM intervals)) GROUP BY clip_id, speaker, g),
    m AS (SELECT clip_id, s AS pt, 1 AS d FROM one UNION ALL SELECT clip_id, e, -1 FROM one),
    p AS (SELECT clip_id, pt, sum(d) AS d FROM m GROUP BY ALL),
    q AS (SELECT clip_id, lead(pt) OVER w - pt AS ms, sum(d) OVER w AS k FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY pt))
    SELECT clip_id, sum(CASE WHEN k >= 2 THEN ms ELSE 0 END)::BIGINT AS overlap_ms FROM q WHERE k > 0 GROUP BY ALL"""
)
def activity_overlap(spark, sf):
    return I.speaker_overlap(V.intervals(spark, sf))


SUBTRACT = (
    f"WITH {V.sql('ref', 'hyp')}"
    + """, m AS (SELECT clip_id, start_ms AS pt, 1 AS a, 0 AS b FROM ref UNION ALL SELECT clip_id, end_ms, -1, 0 FROM ref UNION ALL SELECT clip_id, start_ms, 0, 1 FROM hyp_b UNION ALL SELECT clip_id, end_ms, 0, -1 FROM hyp_b),
    p AS (SELECT clip_id, pt, sum(a) AS a, sum(b) AS b FROM m GROUP BY ALL),
    q AS (SELECT clip_id, lead(pt) OVER w - pt AS ms, sum(a) OVER w > 0 AS ia, sum(b) OVER w > 0 AS ib FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY pt))"""
)


@query(SUBTRACT + " SELECT clip_id, sum(ms)::BIGINT AS ms FROM q WHERE ia AND NOT ib AND ms IS NOT NULL GROUP BY ALL")
def timeline_subtract(spark, sf):
    d = I.subtract(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"))
    return d.groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


@query(SUBTRACT + " SELECT clip_id, sum(ms)::BIGINT AS ms FROM q WHERE ia AND ib AND ms IS NOT NULL GROUP BY ALL")
def timeline_intersect(spark, sf):
    d = I.intersect(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"))
    return d.groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


@query(
    REF
    + """, d AS (SELECT clip_id, max(end_ms) AS duration_ms FROM ref GROUP BY ALL),
    c AS (SELECT clip_id, duration_ms, greatest(1, ceil((duration_ms - 2000) / 28000.0))::BIGINT AS n FROM d),
    e AS (SELECT clip_id, duration_ms, n, unnest(range(0, n)) AS chunk FROM c)
    SELECT clip_id, chunk, chunk * 28000 AS from_ms, least(duration_ms, chunk * 28000 + 30000) AS to_ms, CASE WHEN chunk > 0 THEN chunk * 28000 + 1000 ELSE -1 END AS core_from_ms,
           CASE WHEN chunk < n - 1 THEN least(duration_ms, chunk * 28000 + 30000) - 1000 ELSE -1 END AS core_to_ms FROM e WHERE least(duration_ms, chunk * 28000 + 30000) - chunk * 28000 >= 100"""
)
def chunk_plan(spark, sf):
    d = V.turns_ref(spark, sf).groupBy("clip_id").agg(F.max("end_ms").alias("duration_ms"))
    return I.chunk_plan(d).select("clip_id", F.col("chunk").cast("long").alias("chunk"), "from_ms", "to_ms", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("core_from_ms", "core_to_ms")])


@query(f"WITH {V.sql('ref', 'words')} SELECT clip_id, count(*) AS n_words, sum(wid)::BIGINT AS ids FROM words WHERE start_ms < (SELECT max(end_ms) FROM ref r WHERE r.clip_id = words.clip_id) GROUP BY ALL")
def chunk_stitch(spark, sf):
    """Words found in every chunk that they touch, back to one each."""
    w = V.words_hyp(spark, sf)
    plan = I.chunk_plan(V.turns_ref(spark, sf).groupBy("clip_id").agg(F.max("end_ms").alias("duration_ms")))
    seen = w.join(plan.select("clip_id", "chunk", "from_ms", "to_ms"), "clip_id").filter((F.col("start_ms") < F.col("to_ms")) & (F.col("end_ms") > F.col("from_ms"))).drop("from_ms", "to_ms")
    return I.stitch(seen, plan).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("wid").alias("ids"))


# units and relabelling -----------------------------------------------------------


def _units(spark, sf, gap=500):
    return I.pause_units(_attributed(spark, sf), gap)


@query(UNITS + " SELECT clip_id, unit::BIGINT AS unit, spk, start_ms, end_ms, n_words, text FROM units")
def pause_units(spark, sf):
    return I.units(_units(spark, sf)).select("clip_id", "unit", "spk", "start_ms", "end_ms", F.size("idx").cast("long").alias("n_words"), "text")


RULE = (
    UNITS
    + """, nb AS (SELECT *, lag(spk) OVER w AS ps, start_ms - lag(end_ms) OVER w AS pg, lead(spk) OVER w AS ns, lead(start_ms) OVER w - end_ms AS ng FROM units WINDOW w AS (PARTITION BY clip_id ORDER BY unit)),
    cand AS (SELECT clip_id, unit, spk, pg AS g, ps AS s FROM nb WHERE end_ms - start_ms < 1000 AND ps <> spk UNION ALL SELECT clip_id, unit, spk, ng, ns FROM nb WHERE end_ms - start_ms < 1000 AND ns <> spk),
    edits AS (SELECT clip_id, unit, spk AS old, s AS speaker FROM cand QUALIFY row_number() OVER (PARTITION BY clip_id, unit ORDER BY g, s) = 1)"""
)


@query(RULE + " SELECT clip_id, unit::BIGINT AS unit, old, speaker FROM edits")
def rule_edits(spark, sf):
    return R.rule_edits(I.units(_units(spark, sf))).drop("confidence")


@query(RULE + " SELECT uw.clip_id, coalesce(e.speaker, spk) AS spk, count(*) AS n_words, count(e.speaker) AS n_relabelled FROM uw LEFT JOIN edits e USING (clip_id, unit) GROUP BY ALL")
def rule_relabel(spark, sf):
    return R.method_rule(_attributed(spark, sf)).groupBy("clip_id", "spk").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("relabelled").alias("n_relabelled"))


@query(RULE + " SELECT 0::BIGINT AS n_changed")
def relabel_keeps_text(spark, sf):
    before = _attributed(spark, sf)
    return R.text_changed(before, R.method_rule(before)).agg(F.count(F.lit(1)).alias("n_changed"))


@query(RULE + " SELECT clip_id, count(DISTINCT unit) AS n_units, count(DISTINCT unit) FILTER (e.speaker IS NOT NULL) AS n_applied, count(e.speaker) AS n_words_relabelled, count(*) AS n_words FROM uw LEFT JOIN edits e USING (clip_id, unit) GROUP BY ALL")
def edit_rates(spark, sf):
    u = _units(spark, sf)
    return R.edit_log(u, R.rule_edits(I.units(u)))


@query(RULE + ", k AS (SELECT clip_id, count(*) AS e FROM edits GROUP BY ALL), n AS (SELECT clip_id, count(*) AS u FROM units GROUP BY ALL) SELECT clip_id, count(*) AS n_edits FROM edits JOIN k USING (clip_id) JOIN n USING (clip_id) WHERE NOT (e > 3 AND e > 0.05 * u) GROUP BY ALL")
def rogue_guard(spark, sf):
    u = I.units(_units(spark, sf))
    return R.guard_rogue(R.rule_edits(u), u, share=0.05).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_edits"))


AUDIT = """, tov AS (SELECT w.clip_id, w.wid, t.speaker FROM words w JOIN ref t ON w.clip_id = t.clip_id AND t.start_ms < w.end_ms AND t.end_ms > w.start_ms
      QUALIFY row_number() OVER (PARTITION BY w.clip_id, w.wid ORDER BY least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) DESC, t.start_ms, t.end_ms, t.idx) = 1),
    per AS (SELECT uw.clip_id, unit, count(*) AS n, count(DISTINCT tov.speaker) AS k FROM uw LEFT JOIN tov USING (clip_id, wid) GROUP BY ALL)
    SELECT clip_id, sum(n)::BIGINT AS n_words, count(*) AS n_units, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::BIGINT AS n_mixed_words FROM per GROUP BY ALL"""


def _truth(spark, sf):
    return A.attribute(V.words_hyp(spark, sf), V.turns_ref(spark, sf), nearest=False).select("clip_id", "wid", F.col("spk").alias("true_spk"))


@query(UNITS + AUDIT)
def relabel_audit(spark, sf):
    return R.audit(_attributed(spark, sf), _truth(spark, sf), 500)


@query(UNITS.replace("OR start_ms - lag(end_ms) OVER (PARTITION BY clip_id ORDER BY wid) > 500", "") + AUDIT)
def relabel_audit_no_gap(spark, sf):
    return R.audit(_attributed(spark, sf), _truth(spark, sf), None)


@query(
    ATT
    + """, sh AS (SELECT t.clip_id, t.idx, a.spk, sum(least(a.end_ms, t.end_ms) - greatest(a.start_ms, t.start_ms)) AS ms FROM hyp_a t JOIN att a ON a.clip_id = t.clip_id AND a.start_ms < t.end_ms AND a.end_ms > t.start_ms GROUP BY ALL),
    b AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY clip_id, idx ORDER BY ms DESC, spk) = 1)
    SELECT hyp_a.clip_id, hyp_a.idx, speaker, coalesce(b.spk, speaker) AS label FROM hyp_a LEFT JOIN b USING (clip_id, idx)"""
)
def project_labels(spark, sf):
    return A.project_labels(V.turns_hyp(spark, sf), _attributed(spark, sf)).select("clip_id", "idx", "speaker", "label")


#: Windows of 25 units, walked as a reader would: each next one starts four units
#: before the end of the last and may not edit those four.
WINDOWS = """, c AS (SELECT clip_id, count(*) AS n FROM units GROUP BY ALL),
    w AS (SELECT clip_id, n, 0 AS win, 0::BIGINT AS lo, least(25, n)::BIGINT AS hi FROM c UNION ALL SELECT clip_id, n, win + 1, hi - 4, least(hi - 4 + 25, n)::BIGINT FROM w WHERE hi < n),
    r AS (SELECT clip_id, win, lo, hi, CASE WHEN lo > 0 THEN lo + 4 ELSE 0 END AS a, hi - 1 AS b FROM w)"""
WALK = f"WITH RECURSIVE {V.sql('ref', 'words', 'hyp', 'att', 'units')}" + WINDOWS


@query(WALK + ' SELECT r.clip_id, win::BIGINT AS "window", count(*) AS n_units, any_value(a) AS first_edit, any_value(b) AS last_edit FROM r JOIN units u ON u.clip_id = r.clip_id AND unit >= lo AND unit < hi GROUP BY ALL')
def prompt_windows(spark, sf):
    return R.prompt_windows(I.units(_units(spark, sf))).select("clip_id", F.col("window").cast("long").alias("window"), F.size("units").cast("long").alias("n_units"), "first_edit", "last_edit")


EDITS_SQL = """,
    e AS (SELECT * FROM (VALUES (0, true, 5, 'spk0', 0.9), (1, true, 5, 'spk1', 0.9), (2, true, 6, 'spk9', 1.0), (3, true, 7, 'spk1', 0.65), (4, false, NULL, NULL, NULL), (5, true, NULL, NULL, NULL), (6, true, 8, 'spk1', NULL)) v(pos, is_edit, u, s, conf)),
    x AS (SELECT r.clip_id, win, pos, u, s, CASE WHEN NOT is_edit OR u IS NULL OR u < a OR u > b THEN 'bad_unit' WHEN NOT EXISTS (SELECT 1 FROM units k WHERE k.clip_id = r.clip_id AND k.spk = e.s) THEN 'bad_speaker'
                 WHEN conf IS NULL THEN 'no_conf' WHEN conf < 0.7 THEN 'low_conf' END AS reason FROM r, e),
    y AS (SELECT clip_id, u, s, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY clip_id, win, u, reason IS NULL ORDER BY pos) > 1 THEN 'dup' ELSE reason END AS reason FROM x)"""
COUNTS_SQL = ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in ("bad_unit", "bad_speaker", "dup", "low_conf", "no_conf"))
REPLY = 'Sure: ```json\n{"edits": [{"unit": 5, "speaker": "spk0", "confidence": 0.9}, {"unit": 5, "speaker": "spk1", "confidence": 0.9}, {"unit": 6, "speaker": "spk9", "confidence": 1}, {"unit": 7, "speaker": "spk1", "confidence": 0.65}, 4, {"unit": "x"}, {"unit": 8, "speaker": "spk1"}, {"unit": 9, "speaker": "spk1", "confid'


@query(WALK + EDITS_SQL + f" SELECT clip_id, count(*) FILTER (reason IS NULL) AS n_applied, 0::BIGINT AS parse_fail, {COUNTS_SQL}, 0::BIGINT AS oom FROM y GROUP BY ALL")
def parse_edits(spark, sf):
    """Replies of a stub that asks for every kind of edit, good and bad."""
    u = I.units(_units(spark, sf))
    prompts = R.render_prompt(R.prompt_windows(u))
    good, counts = R.parse_edits(R.ask_model(prompts, lambda texts: [REPLY for _ in texts]), u.select("clip_id", "spk"))
    n = R.guard_rogue(good, u).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_applied"))
    return counts.join(n, "clip_id", "left").select("clip_id", F.coalesce("n_applied", F.lit(0)).alias("n_applied"), *R.REASONS)


#: A model with room for ten units: windows of 25 shrink to 12, these to 6, and move on.
SHRUNK = WALK.replace(WINDOWS, """, c AS (SELECT clip_id, count(*) AS n FROM units GROUP BY ALL),
    w AS (SELECT clip_id, n, 0 AS win, 0::BIGINT AS lo, CASE WHEN n <= 10 THEN n WHEN least(25, n) // 2 <= 10 THEN greatest(2, least(25, n) // 2) ELSE greatest(2, greatest(2, least(25, n) // 2) // 2) END::BIGINT AS hi,
                 CASE WHEN n <= 10 THEN 0 WHEN least(25, n) // 2 <= 10 THEN 1 ELSE 2 END AS m FROM c
          UNION ALL SELECT clip_id, n, win + 1, hi - 4,
                 hi - 4 + CASE WHEN n - hi + 4 <= 10 THEN n - hi + 4 WHEN greatest(6, least(25, n - hi + 4) // 2) <= 10 THEN greatest(6, least(25, n - hi + 4) // 2) ELSE greatest(6, greatest(6, least(25, n - hi + 4) // 2) // 2) END::BIGINT,
                 CASE WHEN n - hi + 4 <= 10 THEN 0 WHEN greatest(6, least(25, n - hi + 4) // 2) <= 10 THEN 1 ELSE 2 END FROM w WHERE hi < n),
    r AS (SELECT clip_id, win, lo, hi, CASE WHEN lo > 0 THEN lo + 4 ELSE 0 END AS a, hi - 1 AS b, m FROM w)""")


def _small_model(prompts: list[str]) -> list[str]:
    if any(p.count("\n[") > 10 for p in prompts):
        raise RuntimeError("CUDA out of memory")
    return [REPLY for _ in prompts]


@query(SHRUNK + EDITS_SQL + f", o AS (SELECT clip_id, sum(m)::BIGINT AS oom FROM r GROUP BY ALL) SELECT y.clip_id, count(*) FILTER (reason IS NULL) AS n_applied, 0::BIGINT AS parse_fail, {COUNTS_SQL}, any_value(oom) AS oom FROM y JOIN o USING (clip_id) GROUP BY y.clip_id")
def model_windows(spark, sf):
    """Windows that shrink until they fit a small model."""
    u = I.units(_units(spark, sf))
    good, counts = R.model_edits(u, _small_model)
    n = good.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_applied"))
    return counts.join(n, "clip_id", "left").select("clip_id", F.coalesce("n_applied", F.lit(0)).alias("n_applied"), *R.REASONS)


@query(
    WALK
    + EDITS_SQL
    + """, ok AS (SELECT clip_id, u AS unit, s FROM y WHERE reason IS NULL), k AS (SELECT clip_id, count(*) AS e FROM ok GROUP BY ALL),
    good AS (SELECT ok.* FROM ok JOIN k USING (clip_id) JOIN c USING (clip_id) WHERE NOT (e > 3 AND e > 0.3 * n))
    SELECT uw.clip_id, coalesce(g.s, uw.spk) AS spk, count(*) AS n_words, count(g.s) AS n_relabelled FROM uw LEFT JOIN good g USING (clip_id, unit) GROUP BY ALL"""
)
def llm_relabel(spark, sf):
    out = R.METHODS["llm"](_attributed(spark, sf), lambda prompts: [REPLY for _ in prompts])
    return out.groupBy("clip_id", "spk").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("relabelled").alias("n_relabelled"))


# logs, fallback, sets ---------------------------------------------------------------

LOG = "WITH log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(LOG + " SELECT key, seq, status FROM last")
def manifest_latest(spark, sf):
    return S.latest(V.manifest(spark, sf)).select("key", "seq", "status")


@query(LOG + " SELECT custkey AS key FROM (SELECT c_custkey AS custkey FROM customer) WHERE custkey NOT IN (SELECT key FROM last WHERE status = 'ok')")
def pending_clips(spark, sf):
    items = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return S.pending(items, V.manifest(spark, sf))


@query(LOG + " SELECT status, count(*) AS n, max(seq) AS last_seq FROM last GROUP BY ALL")
def status_counters(spark, sf):
    return S.latest(V.manifest(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("SELECT clip_id FROM (SELECT conv_id AS clip_id, row_number() OVER (ORDER BY conv_id) - 1 AS r FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE r % 4 = 1")
def shard(spark, sf):
    return S.shard(V.table(spark, sf, "conversations").select(F.col("conv_id").alias("clip_id")).distinct(), "clip_id", 4, 1)


LID = "WITH p AS (SELECT doc_id AS clip_id, lang, text FROM documents), f AS (SELECT doc_id AS clip_id, reverse(text) AS t FROM documents WHERE doc_id % 3 <> 0)"


@query(LID + " SELECT clip_id, lang, CASE WHEN lang IN ('en', 'de') OR t IS NULL THEN 'primary' ELSE 'fallback' END AS source, (lang NOT IN ('en', 'de') AND t IS NULL) AS missing, sha256(CASE WHEN lang IN ('en', 'de') OR t IS NULL THEN text ELSE t END) AS text_sha256 FROM p LEFT JOIN f USING (clip_id)")
def lid_fallback(spark, sf):
    """Some documents have no fallback, so that these cases are met."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), "lang", "text")
    fb = d.filter("clip_id % 3 <> 0").select("clip_id", F.reverse("text").alias("text"))
    return S.language_fallback(d, fb, ["en", "de"]).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


#: Letters of some texts are turned into other scripts, so that there are several.
SCRIPT_TEXT = "CASE doc_id % 5 WHEN 0 THEN translate(text, 'aeiou', 'कखगघङ') WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผ') WHEN 2 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'தநபமயரலவஅஆஇஈஉஊஎஏஐஒஓகஙசஜஞடண') ELSE text END"
SCRIPT_SQL = (
    f"WITH t AS (SELECT doc_id, source, lang, regexp_replace({SCRIPT_TEXT}, '\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g') AS b, {SCRIPT_TEXT} AS text FROM documents),".replace("\\\\", "\\")
    + r""" n AS (SELECT *, len(regexp_extract_all(b, '\p{Devanagari}')) AS dv, len(regexp_extract_all(b, '\p{Latin}')) AS lt, len(regexp_extract_all(b, '\p{Tamil}')) AS tm, len(regexp_extract_all(b, '\p{Thai}')) AS th FROM t),""".replace("\\\\", "\\")
    + """ d AS (SELECT doc_id, source, lang, text, CASE WHEN greatest(dv, lt, tm, th) = 0 THEN 'unknown' WHEN dv = greatest(dv, lt, tm, th) THEN 'Devanagari (hi/mr)' WHEN lt = greatest(dv, lt, tm, th) THEN 'Latin' WHEN tm = greatest(dv, lt, tm, th) THEN 'Tamil' ELSE 'Thai' END AS script FROM n)"""
)


def _scripted(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.col("lang"), F.expr(SCRIPT_TEXT).alias("text"))
    return d.withColumn("script", T.detect_language(F.col("text")))


@query(SCRIPT_SQL + " SELECT doc_id, script FROM d")
def detect_language(spark, sf):
    return _scripted(spark, sf).select("doc_id", "script")


@query(SCRIPT_SQL + r""", w AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS rw, len(regexp_extract_all(text, '[a-z0-9]+')) AS hw FROM d), q AS (SELECT source AS asr, lang AS detected, round(sum(hw) / greatest(sum(rw), 1), 2) AS word_ratio FROM w GROUP BY ALL)
    SELECT source AS asr, lang AS detected, count(*) FILTER (script = 'Latin') AS "Latin", count(*) FILTER (script = 'Tamil') AS "Tamil", count(*) FILTER (script = 'Thai') AS "Thai", count(*) FILTER (script NOT IN ('Latin', 'Tamil', 'Thai')) AS other, any_value(word_ratio) AS word_ratio
    FROM w JOIN q ON asr = source AND detected = lang GROUP BY source, lang""".replace("\\\\", "\\"))
def lid_crosstab(spark, sf):
    """Sources stand for recognisers, the language column for what they detect."""
    d = _scripted(spark, sf)
    words = lambda p: F.regexp_count("text", F.lit(p))
    d = d.select(F.col("source").alias("asr"), F.col("doc_id").alias("clip_id"), F.col("lang").alias("detected"), "script", words("[a-z0-9]+").alias("hyp_words"), words(r"[^ \t\n\x0b\f\r]+").alias("ref_words"))
    return report.language_crosstab(d, ["Latin", "Tamil", "Thai"])


@query(f"WITH {V.sql('ref', 'hyp')} SELECT clip_id FROM (SELECT DISTINCT clip_id FROM hyp_a) JOIN (SELECT DISTINCT clip_id FROM hyp_b) USING (clip_id)")
def common_subset(spark, sf):
    both = S.union_all([V.turns_hyp(spark, sf, s).select("clip_id", F.lit(s).alias("condition")) for s in "ab"])
    return S.common_subset(both)


@query(f"WITH {V.sql('ref', 'hyp')} SELECT DISTINCT clip_id FROM ref WHERE clip_id NOT IN (SELECT clip_id FROM hyp_b)")
def missing_hypotheses(spark, sf):
    return S.missing_keys(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"), ["clip_id"])


@query(f"WITH {V.sql('ref', 'words')}, a AS (SELECT clip_id, w, count(*) AS n FROM rw GROUP BY ALL), b AS (SELECT clip_id, w, count(*) AS m FROM words GROUP BY ALL) SELECT clip_id, sum(least(n, m))::BIGINT AS n_common FROM a JOIN b USING (clip_id, w) GROUP BY ALL")
def bag_intersection(spark, sf):
    return S.bag_intersection(V.words_ref(spark, sf), V.words_hyp(spark, sf), ["clip_id"])


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority_value(spark, sf):
    return S.majority(V.table(spark, sf, "events"), ["user_id"], "event_type")


@query(f"WITH {V.sql('ref', 'hyp')} SELECT r.n AS n_ref, coalesce(h.n, 0) AS n_hyp, count(*) AS n_clips FROM (SELECT clip_id, count(DISTINCT speaker) AS n FROM ref GROUP BY ALL) r LEFT JOIN (SELECT clip_id, count(DISTINCT speaker) AS n FROM hyp_b GROUP BY ALL) h USING (clip_id) GROUP BY ALL")
def speaker_crosstab(spark, sf):
    n = lambda t, c: t.groupBy("clip_id").agg(F.count_distinct("speaker").alias(c))
    j = n(V.turns_ref(spark, sf), "n_ref").join(n(V.turns_hyp(spark, sf, "b"), "n_hyp"), "clip_id", "left").na.fill(0)
    return j.groupBy("n_ref", "n_hyp").agg(F.count(F.lit(1)).alias("n_clips"))


# text ---------------------------------------------------------------------------


@query(r"SELECT doc_id, len(ws) AS n_tokens, array_to_string(ws, ' ') AS norm FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>', ' ', 'g'), '[!-/:-@\[-`{-~।॥‐-‧‰-⁞¡-¿]', ' ', 'g'), '[\s ]+'), lambda x: x <> '') AS ws FROM documents)")
def normalised_text(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", T.normalise(F.col("text")).alias("ws"))
    return d.select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.array_join("ws", " ").alias("norm"))


@query("SELECT o_orderkey, printf('%d__%09d_%09d', o_custkey, o_orderkey * 1000, o_orderkey * 1000 + 500) AS clip_id FROM orders")
def clip_ids(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", T.clip_id(F.col("o_custkey").cast("string"), F.col("o_orderkey"), F.col("o_orderkey") + 0.5).alias("clip_id"))


MESSAGES = ["ERROR: Sign in to confirm you are human", "Video unavailable", "HTTP Error 503: busy", "This video is private", "Requested format is not available", "Read timed out", "something else", "removed by the uploader", "blocked it in your country", "age-restricted content"]
CLASSES = ["bot_gated", "unavailable", "network", "private", "no_audio", "network", "unknown", "removed", "geo_blocked", "age_gated"]


@query(f"SELECT event_id, list_value({', '.join(repr(c) for c in CLASSES)})[event_id % 10 + 1] AS error_class FROM events")
def error_classes(spark, sf):
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 10).cast("int"))
    return V.table(spark, sf, "events").select("event_id", T.classify_error(message).alias("error_class"))


@query(
    "SELECT event_id, 'asr' || event_id % 3 AS asr, 'd_' || event_type AS diar, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'rule+x' END AS method FROM events"
)
def condition_names(spark, sf):
    name = F.concat(F.lit("asr"), F.col("event_id") % 3, F.lit("__d_"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "").otherwise("+rule+x"))
    parts = T.split_condition(name)
    return V.table(spark, sf, "events").select("event_id", *[p.alias(n) for p, n in zip(parts, ("asr", "diar", "method"))])


@query(r"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\([^)]*\)', ' ', 'g'), '[^ \t\n\x0b\f\r]+')) AS n_words FROM documents")
def reference_words(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.count_reference_words(F.col("text")).alias("n_words"))


@query("SELECT event_id, round(value * 16000)::BIGINT AS expected_samples, event_id % 40 - 20 AS sample_delta, CASE WHEN abs(event_id % 40 - 20) <= 16 THEN 'ok' ELSE 'short_source' END AS status FROM events")
def trim_check(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("value").alias("duration_sec"), (F.bround(F.col("value") * 16000, 0).cast("long") + F.col("event_id") % 40 - 20).alias("n_samples"))
    return P.trim_check(e).select("event_id", "expected_samples", "sample_delta", "status")


@query("SELECT sha256(string_agg(p || ':' || sha256(replace(t, chr(13) || chr(10), chr(10))), chr(10) ORDER BY p)) AS digest FROM (SELECT lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 9, '0') AS p, text AS t FROM conversations)")
def content_digest(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 9, "0")).alias("path"), "text")
    return S.content_digest(c)


@query("SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) + 1e-12), 4) AS level FROM embeddings")
def audio_level(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", F.round(T.level_db(F.col("embedding").cast("array<double>")), 4).alias("level"))


@query(REF + " SELECT clip_id::VARCHAR AS clip_id, start_ms, end_ms, speaker FROM ref")
def rttm_round_trip(spark, sf):
    return rttm.parse_lines(rttm.format_lines(V.turns_ref(spark, sf)))


# decoding -------------------------------------------------------------------------

FRAMES = """WITH fr AS (SELECT vec_id // 50 AS clip_id, vec_id % 50 AS frame, embedding AS e FROM embeddings),
    bl AS (SELECT clip_id, frame, e[64] AS blank, b, list_max(e[b * 21 + 1:b * 21 + 21]) AS v, b * 21 + list_position(e[b * 21 + 1:b * 21 + 21], list_max(e[b * 21 + 1:b * 21 + 21])) - 1 AS id FROM fr, (SELECT unnest([0, 1, 2]) AS b)),
    win AS (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY v DESC, b) = 1),
    votes AS (SELECT clip_id, b, count(*) AS n FROM win WHERE v > blank GROUP BY ALL),
    lid AS (SELECT c.clip_id, coalesce(v.b, 0) AS block, coalesce(v.n, 0) AS n_votes FROM (SELECT DISTINCT clip_id FROM fr) c LEFT JOIN (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, b) = 1) v USING (clip_id))"""


@query(FRAMES + " SELECT clip_id, block::BIGINT AS block, n_votes FROM lid")
def lid_vote(spark, sf):
    return D.language_vote(D.block_winners(V.frames(spark, sf), 3, 21)).drop("votes")


@query(
    FRAMES
    + """, ids AS (SELECT bl.clip_id, frame, CASE WHEN blank >= v THEN 63 ELSE id END AS id FROM bl JOIN lid ON lid.clip_id = bl.clip_id AND lid.block = bl.b),
    r AS (SELECT *, CASE WHEN id = lag(id) OVER (PARTITION BY clip_id ORDER BY frame) THEN 0 ELSE 1 END AS n FROM ids),
    g AS (SELECT *, sum(n) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM r),
    p AS (SELECT clip_id, run, any_value(id) AS id, min(frame) AS f0, max(frame) AS f1 FROM g GROUP BY ALL HAVING any_value(id) <> 63),
    s AS (SELECT *, CASE WHEN id % 3 = 0 OR lag(run) OVER (PARTITION BY clip_id ORDER BY run) IS NULL THEN 1 ELSE 0 END AS st FROM p),
    k AS (SELECT *, sum(st) OVER (PARTITION BY clip_id ORDER BY run) - 1 AS wid FROM s)
    SELECT clip_id, wid::BIGINT AS wid, string_agg('t' || id, '' ORDER BY run) AS w, min(f0) * 80 AS start_ms, (max(f1) + 1) * 80 AS end_ms FROM k GROUP BY ALL"""
)
def ctc_decode(spark, sf):
    win = D.block_winners(V.frames(spark, sf), 3, 21)
    ids = D.greedy_ids(win, D.language_vote(win), 63)
    return D.pieces_to_words(D.collapse(ids, 63), V.token_table(spark), 80)


@query("SELECT user_id AS clip_id, count(*) AS n_segments, count(*) FILTER (value / 10 > 2.4 OR (event_id % 100) / 100.0 > 0.6) AS suspect_segments FROM events GROUP BY ALL")
def suspect_segments(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), (F.col("value") / 10).alias("compression_ratio"), (F.col("event_id") % 100 / 100).alias("no_speech_prob"))
    return D.suspect_segments(e)


# error rates ----------------------------------------------------------------------


def _ref_lists(spark, sf, keys):
    return M.word_list(V.words_ref(spark, sf), keys, ["start_ms", "wid"] if keys == ["clip_id"] else ["wid"])


DP = """, rt AS (SELECT pid, w, row_number() OVER (PARTITION BY pid ORDER BY o1, o2) AS i FROM rtok), ht AS (SELECT pid, w, row_number() OVER (PARTITION BY pid ORDER BY o1, o2) AS j FROM htok),
    sz AS (SELECT pid, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT pid, count(*) AS n FROM rt GROUP BY ALL) FULL JOIN (SELECT pid, count(*) AS m FROM ht GROUP BY ALL) USING (pid)),
    dp AS (SELECT pid, n, m, 0::BIGINT AS i, j, j AS v FROM (SELECT pid, n, m, unnest(range(0, m + 1)) AS j FROM sz)
           UNION ALL
           SELECT pid, n, m, i, j, (j + min(t - j) OVER (PARTITION BY pid ORDER BY j))::BIGINT FROM (
             SELECT d.pid, d.n, d.m, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.pid ORDER BY d.j) + CASE WHEN r.w = h.w THEN 0 ELSE 1 END) END AS t
             FROM dp d JOIN rt r ON r.pid = d.pid AND r.i = d.i + 1 LEFT JOIN ht h ON h.pid = d.pid AND h.j = d.j WHERE d.i < d.n)),
    dist AS (SELECT pid, n, m, v FROM dp WHERE i = n AND j = m)"""


@query(
    f"WITH RECURSIVE {V.sql('ref', 'words')}"
    + ", rtok AS (SELECT clip_id AS pid, w, s + 400 * pos AS o1, idx * 1000000 + pos AS o2 FROM rw), htok AS (SELECT clip_id AS pid, w, start_ms AS o1, wid AS o2 FROM words)"
    + DP
    + " SELECT pid AS clip_id, v AS wer_errors, n AS wer_length FROM dist"
)
def wer(spark, sf):
    return M.wer(_ref_lists(spark, sf, ["clip_id"]), M.word_list(V.words_hyp(spark, sf), ["clip_id"], ["start_ms", "wid"]))


def _speaker_lists(spark, sf):
    ref = _ref_lists(spark, sf, ["clip_id", "speaker"])
    hyp = M.word_list(_attributed(spark, sf).withColumnRenamed("spk", "speaker"), ["clip_id", "speaker"], ["wid"])
    return ref, hyp


CP = (
    f"WITH RECURSIVE {V.sql('ref', 'words', 'hyp', 'att')}"
    + """, rs AS (SELECT clip_id, speaker, row_number() OVER (PARTITION BY clip_id ORDER BY speaker) AS a FROM (SELECT DISTINCT clip_id, speaker FROM ref)),
    hs AS (SELECT clip_id, spk, row_number() OVER (PARTITION BY clip_id ORDER BY spk) AS b FROM (SELECT DISTINCT clip_id, spk FROM att)),
    prs AS (SELECT clip_id * 16 + a * 4 + b AS pid, * FROM rs JOIN hs USING (clip_id)),
    rtok AS (SELECT pid, w, idx AS o1, pos AS o2 FROM rw JOIN prs USING (clip_id, speaker)), htok AS (SELECT pid, w, wid AS o1, 0 AS o2 FROM att JOIN prs USING (clip_id, spk))"""
    + DP
    + """, cell AS (SELECT prs.clip_id, a, b, n, m, v FROM prs JOIN dist USING (pid)),
    rn AS (SELECT DISTINCT clip_id, a, n FROM cell), hn AS (SELECT DISTINCT clip_id, b, m FROM cell),
    pm AS (SELECT * FROM (VALUES (0,1,1),(0,2,2),(0,3,3),(1,1,1),(1,2,3),(1,3,2),(2,1,2),(2,2,1),(2,3,3),(3,1,2),(3,2,3),(3,3,1),(4,1,3),(4,2,1),(4,3,2),(5,1,3),(5,2,2),(5,3,1)) x(p, a, b)),
    cl AS (SELECT DISTINCT clip_id FROM cell),
    cost AS (SELECT cl.clip_id, p, sum(CASE WHEN v IS NOT NULL THEN v WHEN n IS NOT NULL THEN n ELSE coalesce(m, 0) END) AS c
             FROM cl CROSS JOIN pm LEFT JOIN rn ON rn.clip_id = cl.clip_id AND rn.a = pm.a LEFT JOIN hn ON hn.clip_id = cl.clip_id AND hn.b = pm.b
             LEFT JOIN (SELECT clip_id, a, b, v FROM cell) k ON k.clip_id = cl.clip_id AND k.a = pm.a AND k.b = pm.b GROUP BY ALL)
    SELECT clip_id, min(c)::BIGINT AS cp_errors, (SELECT sum(n) FROM rn WHERE rn.clip_id = cost.clip_id)::BIGINT AS cp_length FROM cost GROUP BY clip_id"""
)


@query(CP)
def cpwer(spark, sf):
    return M.cpwer(*_speaker_lists(spark, sf)).drop("mapping")


@query(CP)
def cpwer_enumerated(spark, sf):
    return M.cpwer_enumerated(*_speaker_lists(spark, sf))


@query()
def di_cpwer(spark, sf):
    ref = _ref_lists(spark, sf, ["clip_id", "speaker"])
    segments = M.word_list(_units(spark, sf), ["clip_id", "unit"], ["wid"])
    return M.di_cpwer(ref, segments)


@query()
def wder(spark, sf):
    mapping = M.cpwer(*_speaker_lists(spark, sf))
    hyp = _attributed(spark, sf).select("clip_id", "wid", F.col("spk").alias("speaker"), "w")
    return M.wder(V.words_ref(spark, sf).select("clip_id", "wid", "speaker", "w"), hyp, mapping)


@query(
    f"WITH RECURSIVE {V.sql('ref', 'words', 'hyp', 'att')}, {V.SQL['der'][V.SQL['der'].index('perms AS'):V.SQL['der'].index('tries AS')]}"
    + """ rc AS (SELECT clip_id, speaker AS r, w, count(*) AS n FROM rw GROUP BY ALL), hc AS (SELECT clip_id, spk AS h, w, count(*) AS n FROM att GROUP BY ALL),
    cells AS (SELECT clip_id, r, h, sum(least(rc.n, hc.n)) AS ms FROM rc JOIN hc USING (clip_id, w) GROUP BY ALL),
    pick AS (SELECT clip_id, p FROM (SELECT clip_id, p, sum(ms) AS ms FROM cells JOIN perms USING (r, h) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ms DESC, p) = 1),
    mapped AS (SELECT clip_id, r, h FROM cells JOIN pick USING (clip_id) JOIN perms USING (p, r, h)),
    rt AS (SELECT clip_id AS pid, w, speaker, row_number() OVER (PARTITION BY clip_id ORDER BY idx, pos) AS i FROM rw),
    ht AS (SELECT att.clip_id AS pid, w, r, row_number() OVER (PARTITION BY att.clip_id ORDER BY wid) AS j FROM att LEFT JOIN mapped ON mapped.clip_id = att.clip_id AND h = spk),
    sz AS (SELECT pid, n, m FROM (SELECT pid, count(*) AS n FROM rt GROUP BY ALL) JOIN (SELECT pid, count(*) AS m FROM ht GROUP BY ALL) USING (pid)),
    dp AS (SELECT pid, n, m, 0::BIGINT AS i, j, j AS v, 0::BIGINT AS pr, 0::BIGINT AS wr FROM (SELECT pid, n, m, unnest(range(0, m + 1)) AS j FROM sz)
           UNION ALL
           SELECT pid, n, m, i, j, v, last_value(pc IGNORE NULLS) OVER (PARTITION BY pid ORDER BY j), last_value(wc IGNORE NULLS) OVER (PARTITION BY pid ORDER BY j) FROM (
             SELECT *, CASE WHEN v = dg THEN dpr + 1 WHEN v = up THEN upr END AS pc, CASE WHEN v = dg THEN dwr + bad WHEN v = up THEN uwr END AS wc FROM (
               SELECT *, (j + min(least(up, coalesce(dg, up)) - j) OVER (PARTITION BY pid ORDER BY j))::BIGINT AS v FROM (
                 SELECT d.pid, d.n, d.m, d.i + 1 AS i, d.j, d.v + 1 AS up, d.pr AS upr, d.wr AS uwr, lag(d.v) OVER (PARTITION BY d.pid ORDER BY d.j) + CASE WHEN r.w = h.w THEN 0 ELSE 1 END AS dg,
                        lag(d.pr) OVER (PARTITION BY d.pid ORDER BY d.j) AS dpr, lag(d.wr) OVER (PARTITION BY d.pid ORDER BY d.j) AS dwr, CASE WHEN h.r = r.speaker THEN 0 ELSE 1 END AS bad
                 FROM dp d JOIN rt r ON r.pid = d.pid AND r.i = d.i + 1 LEFT JOIN ht h ON h.pid = d.pid AND h.j = d.j WHERE d.i < d.n))))
    SELECT pid AS clip_id, wr AS wder_errors, pr AS wder_length FROM dp WHERE i = n AND j = m"""
)
def wder_by_bags(spark, sf):
    ref = V.words_ref(spark, sf).select("clip_id", "wid", "speaker", "w")
    hyp = _attributed(spark, sf).select("clip_id", "wid", F.col("spk").alias("speaker"), "w")
    return M.wder(ref, hyp, M.bag_mapping(ref, hyp, V.SPEAKERS))


DER = f"WITH {V.sql('ref', 'hyp', 'der')}"


@query(
    DER
    + """ SELECT l.clip_id, total_ms, miss_ms, fa_ms, both_ms - coalesce(correct, 0)::BIGINT AS conf_ms, round((miss_ms + fa_ms + both_ms - coalesce(correct, 0)) / total_ms, 6) AS der, n_ref_speakers,
    coalesce(k, 0) AS n_hyp_speakers, k IS NULL AS hyp_missing FROM lim l JOIN tm USING (clip_id) LEFT JOIN pick USING (clip_id) LEFT JOIN (SELECT clip_id, count(DISTINCT speaker) AS k FROM hyp_b GROUP BY ALL) USING (clip_id)"""
)
def der(spark, sf):
    return E.der(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"))


@query(
    DER
    + """, rz AS (SELECT clip_id, speaker AS r, sum(e - s) AS rm FROM refi GROUP BY ALL), hz AS (SELECT clip_id, speaker AS h, sum(e - s) AS hm FROM hypi GROUP BY ALL),
    mt AS (SELECT cells.* FROM cells JOIN pick USING (clip_id) JOIN perms USING (p, r, h)),
    er AS (SELECT rz.clip_id, coalesce(1 - ms / (rm + hm - ms), 1) AS x FROM rz LEFT JOIN mt USING (clip_id, r) LEFT JOIN hz USING (clip_id, h))
    SELECT clip_id, count(*) AS n_speakers, round(sum(x), 6) AS error_sum, round(avg(x), 6) AS jer FROM er GROUP BY ALL"""
)
def jer(spark, sf):
    return E.jer(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"), order=V.SPEAKERS)


def _regions_sql(choices: str) -> str:
    """The DER tables over regions of each clip: ``choices`` are rows (p, condition
    over k, the speakers active, and z, whether in a collar); clips are numbered
    clip * 4 + p."""
    head, tail = V.SQL["der"].split("cells AS", 1)
    tail = ("cells AS" + tail).replace("refi", "refx").replace("hypi", "hypx")
    return (
        f"WITH {V.sql('ref', 'hyp')},{head}"
        + """edges AS (SELECT clip_id, s AS pt, 1 AS k, 0 AS z FROM refi UNION ALL SELECT clip_id, e, -1, 0 FROM refi UNION ALL SELECT clip_id, unnest([start_ms, end_ms]) - 125, 0, 1 FROM ref
                 UNION ALL SELECT clip_id, unnest([start_ms, end_ms]) + 125, 0, -1 FROM ref UNION ALL SELECT clip_id, unnest([0, dur]), 0, 0 FROM lim),
        spots AS (SELECT clip_id, pt, sum(k) AS k, sum(z) AS z FROM edges GROUP BY ALL),
        parts AS (SELECT clip_id, pt AS s, lead(pt) OVER w AS e, sum(k) OVER w AS k, sum(z) OVER w AS z FROM spots WINDOW w AS (PARTITION BY clip_id ORDER BY pt)),"""
        + f"reg AS (SELECT clip_id * 4 + p AS clip_id, clip_id AS c, s, e FROM (SELECT parts.*, dur, {choices} FROM parts JOIN lim USING (clip_id)) WHERE ok AND s >= 0 AND e <= dur),"
        + """refx AS (SELECT g.clip_id, speaker, greatest(r.s, g.s) AS s, least(r.e, g.e) AS e FROM refi r JOIN reg g ON r.clip_id = g.c AND r.s < g.e AND r.e > g.s),
        hypx AS (SELECT g.clip_id, speaker, greatest(r.s, g.s) AS s, least(r.e, g.e) AS e FROM hypi r JOIN reg g ON r.clip_id = g.c AND r.s < g.e AND r.e > g.s),"""
        + tail
    )


@query(
    _regions_sql("unnest([0, 1]) AS p, unnest([k >= 2, k < 2]) AS ok")
    + """, x AS (SELECT clip_id // 4 AS clip_id, clip_id % 4 AS p, total_ms, miss_ms, fa_ms, both_ms - coalesce(correct, 0)::BIGINT AS conf_ms FROM tm LEFT JOIN pick USING (clip_id))
    SELECT l.clip_id, region, coalesce(total_ms, 0) AS total_ms, coalesce(miss_ms, 0) AS miss_ms, coalesce(fa_ms, 0) AS fa_ms, coalesce(conf_ms, 0) AS conf_ms,
           coalesce(round((miss_ms + fa_ms + conf_ms) / nullif(total_ms, 0), 6), -1) AS der, n_ref_speakers
    FROM lim l CROSS JOIN (VALUES (0, 'overlap'), (1, 'single')) v(p, region) LEFT JOIN x USING (clip_id, p)"""
)
def der_regions(spark, sf):
    ref, hyp = V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b")
    many, single = E.regions_by_overlap(ref)
    both = S.union_all([E.der(ref, hyp, r).withColumn("region", F.lit(n)) for n, r in (("overlap", many), ("single", single))])
    return both.select("clip_id", "region", "total_ms", "miss_ms", "fa_ms", "conf_ms", F.coalesce("der", F.lit(-1.0)).alias("der"), "n_ref_speakers")


@query(
    _regions_sql("unnest([0, 1, 2, 3]) AS p, unnest([true, k < 2, z = 0, z = 0 AND k < 2]) AS ok")
    + """ SELECT CASE WHEN clip_id % 4 < 2 THEN 0 ELSE 250 END::BIGINT AS collar_ms, clip_id % 2 = 1 AS skip_overlap, sum(total_ms)::BIGINT AS total_ms, sum(miss_ms)::BIGINT AS miss_ms, sum(fa_ms)::BIGINT AS fa_ms,
    sum(both_ms - coalesce(correct, 0))::BIGINT AS conf_ms FROM tm LEFT JOIN pick USING (clip_id) GROUP BY ALL"""
)
def der_policies(spark, sf):
    return E.policies(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b"))


@query(
    DER
    + """, k AS (SELECT clip_id, n_ref_speakers AS r, coalesce(k, 0) AS h FROM lim LEFT JOIN (SELECT clip_id, count(DISTINCT speaker) AS k FROM hyp_b GROUP BY ALL) USING (clip_id))
    SELECT round(avg(CASE WHEN r = h THEN 1 ELSE 0 END), 4) AS accuracy, round(avg(abs(h - r)), 4) AS mae, round(avg(h - r), 4) AS bias FROM k"""
)
def speaker_count_accuracy(spark, sf):
    return E.speaker_counts(E.der(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b")))


# report ----------------------------------------------------------------------------

SCORES = f"WITH {V.sql('ref', 'scores')}"


@query(
    SCORES
    + """, common AS (SELECT clip_id FROM scores GROUP BY ALL HAVING count(*) = 8), sub AS (SELECT 'all' AS subset, * FROM scores UNION ALL SELECT 'common', scores.* FROM scores JOIN common USING (clip_id)),
    g AS (SELECT subset, asr, diar, method, count(*) AS n_clips, round(100 * sum(wer_errors) / greatest(sum(length), 1), 2) AS wer, round(100 * sum(cp_errors) / greatest(sum(length), 1), 2) AS cpwer,
                 round(100 * sum(di_errors) / greatest(sum(length), 1), 2) AS di_cpwer, round(100 * sum(wder_errors) / greatest(sum(wder_length), 1), 2) AS wder, round(100 * avg(cp_errors / greatest(length, 1)), 2) AS cpwer_clip_mean FROM sub GROUP BY ALL)
    SELECT *, round(cpwer - di_cpwer, 2) AS attribution_cost FROM g"""
)
def corpus_rates(spark, sf):
    return report.corpus_rates(V.scores(spark, sf))


@query(
    SCORES
    + """, g AS (SELECT asr, diar, method, round(100 * sum(cp_errors) / greatest(sum(length), 1), 2) AS cpwer FROM scores GROUP BY ALL)
    SELECT *, round(cpwer - max(CASE WHEN method = 'baseline' THEN cpwer END) OVER (PARTITION BY asr, diar), 2) AS cpwer_delta FROM g"""
)
def rate_deltas(spark, sf):
    g = V.scores(spark, sf).groupBy("asr", "diar", "method").agg(report.rate("cp_errors", "length").alias("cpwer"))
    return report.deltas(g, "cpwer", ["asr", "diar"])


@query(
    SCORES
    + """, two AS (SELECT asr, diar, clip_id, max(CASE WHEN method = 'baseline' THEN cp_errors / greatest(length, 1) END) AS b, max(CASE WHEN method = 'rule' THEN cp_errors / greatest(length, 1) END) AS m FROM scores GROUP BY ALL)
    SELECT asr, diar, count(*) FILTER (m - b < -1e-9) AS better, count(*) FILTER (abs(m - b) <= 1e-9) AS same, count(*) FILTER (m - b > 1e-9) AS worse FROM two GROUP BY ALL"""
)
def consistency(spark, sf):
    return report.consistency(V.scores(spark, sf), "cp_errors", "length", "rule")


@query(
    META
    + """, m AS (SELECT clip_id, (overlap_ms / speech_ms)::DOUBLE AS f FROM sp), q AS (SELECT quantile_cont(f, 1/3.0) AS a, quantile_cont(f, 2/3.0) AS b FROM m)
    SELECT CASE WHEN f <= a THEN 'low' WHEN f <= b THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n_clips, round(min(f), 6) AS least, round(max(f), 6) AS most FROM m, q GROUP BY ALL"""
)
def breakdown_terciles(spark, sf):
    t = V.turns_ref(spark, sf)
    m = I.union_speech(t).join(I.speaker_overlap(t), "clip_id").select("clip_id", (F.col("overlap_ms") / F.col("speech_ms")).alias("f"))
    return report.terciles(m, "f").groupBy("tercile").agg(F.count(F.lit(1)).alias("n_clips"), F.round(F.min("f"), 6).alias("least"), F.round(F.max("f"), 6).alias("most"))


def _meta(spark, sf):
    t = V.turns_ref(spark, sf)
    return t.groupBy("clip_id").agg(F.count_distinct("speaker").alias("n_speakers"), F.max("end_ms").alias("duration_ms"), F.when(F.col("clip_id") % 3 == 0, "Hindi").otherwise("Tamil").alias("language")).withColumn("speakers", report.speaker_bucket(F.col("n_speakers")))


BREAKDOWN_SQL = """, meta AS (SELECT clip_id, count(DISTINCT speaker)::VARCHAR AS speakers, max(end_ms) AS duration_ms FROM ref GROUP BY ALL), j AS (SELECT * FROM scores JOIN meta USING (clip_id)),
    t AS (SELECT asr, j.diar, speakers, round(100 * sum(miss_ms + fa_ms + conf_ms) / sum(total_ms), 2) AS der, round(100 * avg(jer), 2) AS jer_clip_mean FROM j JOIN ders d ON d.diar = j.diar AND d.clip_id = j.clip_id WHERE method = 'baseline' GROUP BY ALL)
    SELECT asr, diar, speakers, count(DISTINCT clip_id) AS n_clips, round(sum(CASE WHEN method = 'baseline' THEN duration_ms END) / 3600000, 4) AS hours,
           round(100 * sum(CASE WHEN method = 'baseline' THEN cp_errors END) / sum(CASE WHEN method = 'baseline' THEN length END), 2) AS cpwer_baseline, round(100 * sum(CASE WHEN method = 'rule' THEN cp_errors END) / sum(CASE WHEN method = 'rule' THEN length END), 2) AS cpwer_rule,
           round(100 * sum(CASE WHEN method = 'baseline' THEN wder_errors END) / sum(CASE WHEN method = 'baseline' THEN wder_length END), 2) AS wder_baseline, round(100 * sum(CASE WHEN method = 'rule' THEN wder_errors END) / sum(CASE WHEN method = 'rule' THEN wder_length END), 2) AS wder_rule,
           any_value(der) AS der, any_value(jer_clip_mean) AS jer_clip_mean FROM j JOIN t USING (asr, diar, speakers) GROUP BY asr, diar, speakers"""


def breakdown_speakers(spark, sf):
    ref = V.turns_ref(spark, sf)
    jers = S.union_all([E.jer(ref, V.turns_hyp(spark, sf, s), order=V.SPEAKERS).withColumn("system", F.lit(s)) for s in "ab"])
    return report.breakdown(V.scores(spark, sf), _meta(spark, sf), "speakers", _ders(spark, sf), jers)


@query(SCORES + ", one AS (SELECT DISTINCT asr, clip_id, wer_errors, length FROM scores) SELECT CASE WHEN clip_id % 3 = 0 THEN 'Hindi' ELSE 'Tamil' END AS language, round(100 * sum(CASE WHEN asr = 'x' THEN wer_errors END) / sum(CASE WHEN asr = 'x' THEN length END), 2) AS x, round(100 * sum(CASE WHEN asr = 'y' THEN wer_errors END) / sum(CASE WHEN asr = 'y' THEN length END), 2) AS y FROM one GROUP BY ALL")
def language_table(spark, sf):
    return report.language_table(V.scores(spark, sf), _meta(spark, sf), ["x", "y"])


@query(SCORES + ", g AS (SELECT diar, method, round(100 * sum(CASE WHEN asr = 'x' THEN cp_errors END) / sum(CASE WHEN asr = 'x' THEN length END), 2) AS cpwer_a, round(100 * sum(CASE WHEN asr = 'y' THEN cp_errors END) / sum(CASE WHEN asr = 'y' THEN length END), 2) AS cpwer_b FROM scores GROUP BY ALL) SELECT *, round(cpwer_b - cpwer_a, 2) AS gain FROM g")
def recogniser_swap(spark, sf):
    return report.swap(V.scores(spark, sf), "x", "y")


SYSTEMS = [("x", "a", "baseline"), ("x", "a", "rule"), ("y", "a", "baseline"), ("y", "b", "rule")]


@query(
    SCORES
    + """, g AS (SELECT asr, diar, method, round(100 * sum(cp_errors) / sum(length), 2) AS cpwer FROM scores GROUP BY ALL), c AS (SELECT * FROM (VALUES (0, 'x', 'a', 'baseline'), (1, 'x', 'a', 'rule'), (2, 'y', 'a', 'baseline'), (3, 'y', 'b', 'rule')) v(place, asr, diar, method))
    SELECT 'all' AS subset, place, asr, diar, method, cpwer, round(cpwer - max(CASE WHEN place = 0 THEN cpwer END) OVER (), 2) AS change FROM g JOIN c USING (asr, diar, method)"""
)
def track_table(spark, sf):
    return report.track(report.corpus_rates(V.scores(spark, sf)).filter("subset = 'all'"), SYSTEMS)


def _ders(spark, sf):
    ref = V.turns_ref(spark, sf)
    return S.union_all([E.der(ref, V.turns_hyp(spark, sf, s)).withColumn("system", F.lit(s)) for s in "ab"])


def _der_sql(system: str) -> str:
    """Turn errors of one system by clip, as a table d_a or d_b."""
    inner = f"WITH {V.sql('ref', 'hyp', 'der')}".replace("hyp_b h", f"hyp_{system} h") if system == "b" else f"WITH {V.sql('ref', 'hyp')},{V.SQL['der'].replace('hyp_b', 'hyp_a')}"
    return f"""d_{system} AS ({inner}, rz AS (SELECT clip_id, speaker AS r, sum(e - s) AS rm FROM refi GROUP BY ALL), hz AS (SELECT clip_id, speaker AS h, sum(e - s) AS hm FROM hypi GROUP BY ALL),
        mt AS (SELECT cells.* FROM cells JOIN pick USING (clip_id) JOIN perms USING (p, r, h)),
        er AS (SELECT rz.clip_id, avg(coalesce(1 - ms / (rm + hm - ms), 1)) AS jer FROM rz LEFT JOIN mt USING (clip_id, r) LEFT JOIN hz USING (clip_id, h) GROUP BY ALL)
        SELECT l.clip_id, '{system}' AS diar, total_ms, miss_ms, fa_ms, both_ms - coalesce(correct, 0)::BIGINT AS conf_ms, round(jer, 6) AS jer FROM lim l JOIN tm USING (clip_id) LEFT JOIN pick USING (clip_id) JOIN er USING (clip_id))"""


BOTH = f"WITH {_der_sql('a')}, {_der_sql('b')}, ders AS (SELECT * FROM d_a UNION ALL SELECT * FROM d_b), {V.sql('ref', 'scores')}"
TURN_MS = ("total_ms", "miss_ms", "fa_ms", "conf_ms")


@query(
    BOTH
    + """, md AS (SELECT DISTINCT asr, diar, method FROM scores), grid AS (SELECT * FROM md CROSS JOIN (SELECT DISTINCT clip_id FROM ref))
    SELECT g.asr, g.diar, g.method, g.clip_id, coalesce(round(100 * wer_errors / length, 4), -1) AS wer, coalesce(round(100 * cp_errors / length, 4), -1) AS cpwer, coalesce(round(100 * wder_errors / wder_length, 4), -1) AS wder,
       CASE WHEN g.method = 'rule' AND s.clip_id IS NOT NULL THEN 1 ELSE 0 END AS n_applied,"""
    + ", ".join(f"CASE WHEN g.method = 'baseline' THEN d.{c} ELSE -1 END AS {c}, d.{c} AS {c}_ctrl" for c in TURN_MS)
    + " FROM grid g LEFT JOIN scores s USING (asr, diar, method, clip_id) JOIN ders d ON d.diar = g.diar AND d.clip_id = g.clip_id"
)
def long_results(spark, sf):
    """Relabelled systems have no turns of their own here, so theirs are -1."""
    s = V.scores(spark, sf)
    models = [(a, d, m) for a in "xy" for d in "ab" for m in ("baseline", "rule")]
    edits = s.filter("method = 'rule'").select(*report.KEY, F.lit(1).alias("n_applied"))
    long = report.build_long(s, _meta(spark, sf), _ders(spark, sf), edits, models)
    filled = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("wer", "cpwer", "wder", *TURN_MS)]
    return long.select(*report.KEY, *filled, "n_applied", *[f"{c}_ctrl" for c in TURN_MS])


BROKEN = """, broken AS (SELECT asr, diar, method, clip_id, length, wer_errors + CASE WHEN method = 'rule' AND clip_id % 10 = 3 THEN 1 ELSE 0 END AS wer_errors, cp_errors FROM scores)"""


def _broken(spark, sf):
    """Scores in which the rule has changed words of some clips."""
    return V.scores(spark, sf).withColumn("wer_errors", F.col("wer_errors") + F.when((F.col("method") == "rule") & (F.col("clip_id") % 10 == 3), 1).otherwise(0))


@query(SCORES + BROKEN + " SELECT asr, diar, clip_id, count(DISTINCT wer_errors) AS n FROM broken GROUP BY ALL HAVING count(DISTINCT wer_errors) > 1")
def wer_changes(spark, sf):
    return report.wer_changes(_broken(spark, sf))


@query(SCORES + " SELECT asr AS control, clip_id, max(wer_errors) - min(wer_errors) AS miss, max(cp_errors) - min(cp_errors) AS fa FROM scores GROUP BY ALL HAVING max(wer_errors) - min(wer_errors) > 2 OR max(cp_errors) - min(cp_errors) > 2")
def detection_drift(spark, sf):
    rows = V.scores(spark, sf).select(F.col("asr").alias("control"), "clip_id", F.col("wer_errors").alias("miss_ms"), F.col("cp_errors").alias("fa_ms"))
    return report.detection_drift(rows, tolerance_ms=2)


@query(SCORES + BROKEN + " SELECT b.asr, b.diar, b.method, b.clip_id, b.wer_errors FROM broken b JOIN scores s USING (asr, diar, method, clip_id) WHERE b.wer_errors <> s.wer_errors OR b.cp_errors <> s.cp_errors")
def fallback_twins(spark, sf):
    return report.twins_differ(_broken(spark, sf), V.scores(spark, sf), ["wer_errors", "cp_errors"], report.KEY).select(*report.KEY, "wer_errors")


@query(
    SCORES
    + BROKEN
    + """, a AS (SELECT asr, diar, method, round(100 * sum(wer_errors) / greatest(sum(length), 1), 2) AS x FROM broken GROUP BY ALL), b AS (SELECT asr, diar, method, round(100 * sum(wer_errors) / greatest(sum(length), 1), 2) AS y FROM scores WHERE NOT (asr = 'y' AND diar = 'b') GROUP BY ALL)
    SELECT asr, diar, method, coalesce(x, -1) AS mine, coalesce(y, -1) AS theirs FROM a FULL JOIN b USING (asr, diar, method) WHERE x IS NULL OR y IS NULL OR abs(x - y) > 0.011"""
)
def totals_differ(spark, sf):
    """Totals that disagree, and one that the other stage does not have."""
    keys = ["asr", "diar", "method"]
    total = lambda d: d.groupBy(*keys).agg(report.rate("wer_errors", "length").alias("wer"))
    theirs = total(V.scores(spark, sf).filter("not (asr = 'y' and diar = 'b')"))
    found = report.differs(total(_broken(spark, sf)), theirs, keys, "wer")
    return found.select(*keys, F.coalesce("_a", F.lit(-1.0)).alias("mine"), F.coalesce("_b", F.lit(-1.0)).alias("theirs"))


@query(SCORES + " SELECT 0::BIGINT AS wer_changes, 0::BIGINT AS twins, 0::BIGINT AS totals")
def invariants(spark, sf):
    """The same checks on scores that break none: nothing is found."""
    s = V.scores(spark, sf)
    again = s.repartition(3, "clip_id")
    totals = lambda d: d.groupBy("asr", "diar", "method").agg(report.rate("wer_errors", "length").alias("wer"))
    rolled = s.groupBy("asr", "diar", "method", "length").agg(F.sum("wer_errors").alias("wer_errors"), F.count(F.lit(1)).alias("n")).withColumn("length", F.col("length") * F.col("n"))
    found = {"wer_changes": report.wer_changes(s), "twins": report.twins_differ(again, s, ["wer_errors", "cp_errors"], report.KEY), "totals": report.differs(totals(s), totals(rolled), ["asr", "diar", "method"], "wer")}
    rows = S.union_all([d.agg(F.count(F.lit(1)).alias(name)) for name, d in found.items()])
    return rows.agg(*[F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in found])


@query(SCORES + " SELECT asr, diar, method, row_number() OVER (ORDER BY CASE asr WHEN 'y' THEN 1 ELSE 99 END, CASE method WHEN 'rule' THEN 1 WHEN 'baseline' THEN 2 END, diar, asr) - 1 AS place FROM (SELECT DISTINCT asr, diar, method FROM scores)")
def domain_order(spark, sf):
    """The place of each row as the operator leaves them; recogniser x is in no list."""
    m = V.scores(spark, sf).select("asr", "diar", "method").distinct()
    ordered = S.domain_order(m, {"asr": ["y"], "method": ["rule", "baseline"]}, "diar", "asr")
    return ordered.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(SCORES + " SELECT diar, method, clip_id, cp_errors FROM scores WHERE asr = 'x' AND method = 'rule' AND diar <> 'b'")
def picked_scores(spark, sf):
    """One recogniser and method, without the system that stands for the reference."""
    chosen = report.without_reference(report.pick(V.scores(spark, sf), "x", "rule"), "b")
    return chosen.select("diar", "method", "clip_id", "cp_errors")


@query("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'F')")
def usable_clips(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "short_source").otherwise("failed")
    rows = V.table(spark, sf, "orders").withColumn("status", status)
    return P.usable(rows).select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 8")
def top_users(spark, sf):
    return V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(8)


@query("SELECT part.p_partkey AS a, sum(l_quantity)::DOUBLE AS qty FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def equi_join_rollup(spark, sf):
    j = V.table(spark, sf, "part").select(F.col("p_partkey").alias("a")).join(V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), "l_quantity"), "a")
    return j.groupBy("a").agg(F.sum("l_quantity").cast("double").alias("qty"))


# summaries of turn errors ------------------------------------------------------------

DER_ROWS = (
    DER
    + """, rows AS (SELECT l.clip_id, total_ms, miss_ms, fa_ms, both_ms - coalesce(correct, 0) AS conf_ms, n_ref_speakers, coalesce(k, 0) AS n_hyp_speakers
      FROM lim l JOIN tm USING (clip_id) LEFT JOIN pick USING (clip_id) LEFT JOIN (SELECT clip_id, count(DISTINCT speaker) AS k FROM hyp_b GROUP BY ALL) USING (clip_id))"""
)
DER_RATES = """count(*) AS n_clips, round(100 * sum(miss_ms + fa_ms + conf_ms) / sum(total_ms), 2) AS der, round(100 * sum(miss_ms) / sum(total_ms), 2) AS miss, round(100 * sum(fa_ms) / sum(total_ms), 2) AS fa,
    round(100 * sum(conf_ms) / sum(total_ms), 2) AS confusion, round(100 * avg((miss_ms + fa_ms + conf_ms) / total_ms), 2) AS der_clip_mean, round(100 * avg(CASE WHEN n_ref_speakers = n_hyp_speakers THEN 1 ELSE 0 END), 2) AS count_accuracy,
    round(avg(abs(n_hyp_speakers - n_ref_speakers)), 4) AS count_mae, round(avg(n_hyp_speakers - n_ref_speakers), 4) AS count_bias"""


def _der_b(spark, sf):
    return E.der(V.turns_ref(spark, sf), V.turns_hyp(spark, sf, "b")).withColumn("system", F.lit("b"))


@query(DER_ROWS + f" SELECT 'b' AS system, {DER_RATES} FROM rows")
def der_summary(spark, sf):
    return report.der_summary(_der_b(spark, sf), ["system"])


@query(DER_ROWS + f" SELECT n_ref_speakers, {DER_RATES} FROM rows GROUP BY n_ref_speakers")
def der_by_speakers(spark, sf):
    return report.der_summary(_der_b(spark, sf), ["n_ref_speakers"])


@query(
    DER_ROWS
    + f""", sh AS (SELECT *, 1.0::DOUBLE * fa_ms / total_ms AS f FROM rows), q AS (SELECT quantile_cont(f, 1/3.0) AS a, quantile_cont(f, 2/3.0) AS b FROM sh)
    SELECT CASE WHEN f <= a THEN 'low' WHEN f <= b THEN 'mid' ELSE 'high' END AS tercile, {DER_RATES} FROM sh, q GROUP BY tercile"""
)
def der_by_tercile(spark, sf):
    """Thirds by the share of false alarms, over the system's rows."""
    rows = _der_b(spark, sf).withColumn("f", F.col("fa_ms") / F.col("total_ms"))
    return report.der_summary(report.terciles(rows, "f"), ["tercile"])


# tables and reasons -------------------------------------------------------------------


@query("SELECT clip_id, o_orderkey AS row FROM (SELECT o_orderkey, printf('%d__%09d_%09d', o_custkey, (o_orderkey % 50) * 1000, (o_orderkey % 50 + 7) * 1000) AS clip_id FROM orders WHERE o_orderkey % 9 <> 4) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY o_orderkey) = 1")
def load_segments(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 50).cast("string").alias("start_sec"), F.when(F.col("o_orderkey") % 9 == 4, "none").otherwise((F.col("o_orderkey") % 50 + 7).cast("string")).alias("end_sec"))
    return P.load_segments(o).select("clip_id", "row")


@query(f"WITH {V.sql('ref', 'hyp')}, r AS (SELECT clip_id, sum(CASE WHEN clip_id % 5 = 0 THEN 0 ELSE n_tok END) AS n FROM ref WHERE clip_id % 7 <> 0 GROUP BY ALL) SELECT coalesce(CASE WHEN n IS NULL THEN 'no reference' WHEN n = 0 THEN 'empty reference' END, 'scored') AS reason, count(*) AS n_clips FROM (SELECT DISTINCT clip_id FROM hyp_a) LEFT JOIN r USING (clip_id) GROUP BY ALL")
def skip_reasons(spark, sf):
    ref = V.turns_ref(spark, sf).filter("clip_id % 7 <> 0").groupBy("clip_id").agg(F.sum(F.when(F.col("clip_id") % 5 == 0, 0).otherwise(F.col("n_tok"))).alias("n_words"))
    hyp = V.turns_hyp(spark, sf).select("clip_id").distinct()
    return S.with_reason(hyp, ref).groupBy(F.coalesce("reason", F.lit("scored")).alias("reason")).agg(F.count(F.lit(1)).alias("n_clips"))


@query(LOG + ", it AS (SELECT DISTINCT user_id AS key FROM events) SELECT key, coalesce((status = 'ok' AND key % 3 <> 0) OR (status = 'failed' AND key % 2 = 0), false) AS skip FROM it LEFT JOIN last USING (key)")
def resume_verified(spark, sf):
    log = S.latest(V.manifest(spark, sf)).withColumns({"error_class": F.when(F.col("key") % 2 == 0, "gone").otherwise("net"), "n_samples": F.col("key") * 10})
    files = log.filter("key % 3 <> 0").select("key", "n_samples")
    return S.resume_verified(log.select("key"), log, files, ("gone",)).select("key", "skip")


@query(
    WALK.replace("string_agg(w, ' ' ORDER BY wid) AS text", "substr(string_agg(w, ' ' ORDER BY wid), 1, 220) AS text")
    + """ SELECT r.clip_id, win::BIGINT AS "window", string_agg('[' || unit::BIGINT || '] ' || spk || ' (' || printf('%.1f', start_ms / 1000) || '-' || printf('%.1f', end_ms / 1000) || 's)' || CASE WHEN unit < a THEN '  [context, do not edit]' ELSE '' END || ': ' || text, chr(10) ORDER BY unit) AS prompt
    FROM r JOIN units u ON u.clip_id = r.clip_id AND unit >= lo AND unit < hi GROUP BY r.clip_id, win"""
)
def prompts(spark, sf):
    p = R.render_prompt(R.prompt_windows(I.units(_units(spark, sf))))
    return p.select("clip_id", F.col("window").cast("long").alias("window"), "prompt")


@query()
def similarity_of_transcripts(spark, sf):
    r = M.word_list(V.words_ref(spark, sf), ["clip_id"], ["wid"])
    h = M.word_list(V.words_hyp(spark, sf), ["clip_id"], ["wid"], name="h")
    return r.join(h, "clip_id").select("clip_id", F.round(T.sequence_similarity("ws", "h"), 6).alias("ratio"))


@query("SELECT clip_id, o_orderkey AS row FROM (SELECT o_orderkey, printf('%d__%09d_%09d', o_custkey, (o_orderkey % 50) * 1000, (o_orderkey % 50 + 7) * 1000) AS clip_id FROM orders) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY o_orderkey) = 1 ORDER BY o_orderkey LIMIT 20")
def first_segments(spark, sf):
    """The first twenty segments: the operator's limit."""
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 50).alias("start_sec"), (F.col("o_orderkey") % 50 + 7).alias("end_sec"))
    return P.load_segments(o, limit=20).select("clip_id", "row")


# the table of turn errors by both systems is defined late, so its query is added here
query(BOTH + BREAKDOWN_SQL)(breakdown_speakers)
