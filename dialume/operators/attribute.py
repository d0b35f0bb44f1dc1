"""Words to speakers, by overlap with turns.

``words``: ``clip_id, wid, w, start_ms, end_ms``; ``turns``: ``clip_id, idx,
speaker, start_ms, end_ms``. Words and turns meet on (clip, time bucket), so a clip
of any length is spread over tasks and a word only sees turns nearby. The best
turn is an aggregate, not a sorted window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKET_MS = 30_000


def _bucketed(df: DataFrame, bucket_ms: int) -> DataFrame:
    first = F.floor(F.col("start_ms") / bucket_ms)
    last = F.greatest(first, F.floor((F.col("end_ms") - 1) / bucket_ms))
    return df.withColumn("_b", F.explode(F.sequence(first, last)))


def overlaps(words: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every word with every turn that it overlaps: ``clip_id, wid`` and a struct
    ``turn`` (overlap, start, end, idx, speaker). A word of no length overlaps nothing."""
    a = _bucketed(words.select("clip_id", "wid", F.col("start_ms"), F.col("end_ms")), bucket_ms).select("clip_id", "_b", "wid", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    b = _bucketed(turns.filter("end_ms > start_ms").select("clip_id", "idx", "speaker", "start_ms", "end_ms"), bucket_ms)
    first = F.greatest(F.floor(F.col("ws") / bucket_ms), F.floor(F.col("start_ms") / bucket_ms))
    met = a.join(b, ["clip_id", "_b"]).filter((F.col("start_ms") < F.col("we")) & (F.col("end_ms") > F.col("ws")) & (F.col("_b") == first))
    over = F.least("we", "end_ms") - F.greatest("ws", "start_ms")
    return met.filter(over > 0).select("clip_id", "wid", F.struct(over.alias("overlap"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "idx", "speaker").alias("turn"))


def attribute(words: DataFrame, turns: DataFrame, nearest: bool = True, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``words`` with ``spk``, the speaker of the turn that overlaps a word most
    (of equals the earlier turn); a word that none overlaps is an ``orphan`` and
    gets the nearest turn's speaker, or null without ``nearest``. Words of clips
    without turns have no speaker. ``n_spans`` counts the turns that a word
    overlaps. One join and one aggregate: the word's columns travel along."""
    rest = [c for c in words.columns if c not in ("clip_id", "wid")]
    a = _bucketed(words, bucket_ms).select("clip_id", "wid", "_b", F.struct(*rest).alias("_w"))
    b = _bucketed(turns.filter("end_ms > start_ms").select("clip_id", "idx", "speaker", "start_ms", "end_ms"), bucket_ms)
    b = b.select(F.col("clip_id").alias("_clip"), F.col("_b").alias("_tb"), F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te"), F.col("idx").alias("_idx"), F.col("speaker").alias("_speaker"))
    # flat columns: a field of a struct on the outer side would be taken for never null
    ws, we, ts, te = F.col("_w.start_ms"), F.col("_w.end_ms"), F.col("_ts"), F.col("_te")
    over = F.least(we, te) - F.greatest(ws, ts)
    first = F.greatest(F.floor(ws / bucket_ms), F.floor(ts / bucket_ms))  # a pair counts in the first bucket that both touch
    met = a.join(b, (F.col("clip_id") == F.col("_clip")) & (F.col("_b") == F.col("_tb")) & (ts < we) & (te > ws) & (over > 0) & (F.col("_b") == first), "left")
    rank = F.when(ts.isNotNull(), F.struct(over, -ts, -te, -F.col("_idx")))
    out = met.groupBy("clip_id", "wid").agg(F.first("_w").alias("_w"), F.max_by("_speaker", rank).alias("spk"), F.count("_ts").alias("n_spans"))
    out = out.select("clip_id", "wid", "_w.*", "spk", "n_spans", (F.col("n_spans") == 0).alias("orphan"))
    if not nearest:
        return out
    near = nearest_turn(out.filter("orphan").select("clip_id", "wid", "start_ms", "end_ms"), turns, bucket_ms)
    out = out.join(near.withColumnRenamed("speaker", "_near"), ["clip_id", "wid"], "left")
    return out.withColumn("spk", F.coalesce("spk", "_near")).drop("_near")


def nearest_turn(words: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``clip_id, wid, speaker`` of the turn with the smallest gap (of equals the
    earlier) for words that no turn overlaps. Such a word's nearest turn is the
    last to end before it, the first to start after it or, if the word has no
    length, one around it. The first two come from running aggregates over each
    clip's marks in time, dealt out once; nothing pairs up a clip."""
    t = turns.filter("end_ms > start_ms")
    info = F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "idx", "speaker")
    word = F.struct("wid", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    none = F.lit(None).cast(words.select(word.alias("w")).schema["w"].dataType)
    # at one time ends come first, then words, then starts
    ends = F.array(F.struct(F.col("end_ms").alias("at"), F.lit(0).alias("o")), F.struct(F.col("start_ms").alias("at"), F.lit(2).alias("o")))
    marks = t.select("clip_id", F.inline(ends), info.alias("t"), none.alias("w"))
    marks = marks.unionByName(words.select("clip_id", F.col("start_ms").alias("at"), F.lit(1).alias("o"), F.lit(None).cast(marks.schema["t"].dataType).alias("t"), word.alias("w")))
    tt, seen = F.col("t"), W.partitionBy("clip_id")
    ended = F.max(F.when(F.col("o") == 0, F.struct(tt["end"], -tt["start"], -tt["idx"], tt.alias("t")))).over(seen.orderBy("at", "o").rowsBetween(W.unboundedPreceding, -1))
    begun = F.min(F.when(F.col("o") == 2, F.struct(tt["start"], tt["end"], tt["idx"], tt.alias("t")))).over(seen.orderBy(F.desc("at"), F.desc("o")).rowsBetween(W.unboundedPreceding, -1))
    sides = marks.select("clip_id", "o", "w", ended.alias("a"), begun.alias("b")).filter("o = 1").select("clip_id", "w", F.explode(F.array("a.t", "b.t")).alias("t"))
    points = _bucketed(words.filter("end_ms = start_ms"), bucket_ms).select("clip_id", "_b", word.alias("w"))
    around = points.join(_bucketed(t, bucket_ms).select("clip_id", "_b", info.alias("t")), ["clip_id", "_b"]).filter("t.start < w.ws and t.end > w.ws").select("clip_id", "w", "t")
    gap = F.greatest(F.lit(0), F.col("t.start") - F.col("w.we"), F.col("w.ws") - F.col("t.end"))
    each = sides.unionByName(around).filter("t is not null")
    return each.groupBy("clip_id", F.col("w.wid").alias("wid")).agg(F.min(F.struct(gap.alias("gap"), "t.start", "t.end", "t.idx", "t.speaker"))["speaker"].alias("speaker"))


def contested(words: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Words that at least two turns overlap: ``overlap`` (how many) if two of
    the turns, consecutive by start, overlap each other, else ``boundary``."""
    spans = overlaps(words, turns, bucket_ms).groupBy("clip_id", "wid").agg(F.array_sort(F.collect_list(F.struct("turn.start", "turn.end"))).alias("s")).filter(F.size("s") >= 2)
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: b["start"] < a["end"])
    both = F.exists(pairs, lambda x: x)
    return spans.select("clip_id", "wid", F.when(both, F.size("s")).alias("overlap"), (~both).alias("boundary"))


def by_speaker_text(words: DataFrame) -> DataFrame:
    """Each speaker's words in order, joined by spaces."""
    each = words.filter("spk is not null").groupBy("clip_id", "spk").agg(F.array_sort(F.collect_list(F.struct("wid", "w"))).alias("_w"))
    return each.select("clip_id", "spk", F.array_join(F.transform("_w", lambda x: x["w"]), " ").alias("text"), F.size("_w").cast("long").alias("n_words"))


def project_labels(turns: DataFrame, words: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``turns`` with the speaker (``label``) whose words overlap each the longest
    (of equals the smallest label); a turn without words keeps its own."""
    as_turns = words.filter("spk is not null").select("clip_id", F.col("wid").alias("idx"), F.col("spk").alias("speaker"), "start_ms", "end_ms")
    as_words = turns.select("clip_id", F.col("idx").alias("wid"), "start_ms", "end_ms")
    shares = overlaps(as_words, as_turns, bucket_ms).groupBy("clip_id", "wid", F.col("turn.speaker").alias("label")).agg(F.sum("turn.overlap").alias("ms"))
    best = shares.groupBy("clip_id", "wid").agg(F.min(F.struct(-F.col("ms"), "label"))["label"].alias("label")).withColumnRenamed("wid", "idx")
    return turns.join(best, ["clip_id", "idx"], "left").withColumn("label", F.coalesce("label", "speaker"))
