"""What follows a CTC acoustic model: restricted argmax, language vote, collapse.

Frames: ``clip_id, frame, scores`` (array, the blank last; before it blocks of
``size`` tokens, one a language).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def vocabulary(blocks: DataFrame, most: int = 256) -> DataFrame:
    """One numbered list of tokens from each language's list (``block, lang,
    tokens``): blocks in order, each cut to ``most``; the blank comes last."""
    each = blocks.select("block", "lang", F.posexplode(F.slice("tokens", F.lit(1), F.lit(most))).alias("pos", "token"))
    size = blocks.select("block", F.least(F.size("tokens"), F.lit(most)).alias("n"))
    before = size.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # one row a language
    return each.join(before, "block").select((F.col("first") + F.col("pos")).alias("token_id"), "token", "lang", "block")


def _block_best(block: Column | int, size: int) -> Column:
    """(score, id) of a block's best token, of equals the first."""
    part = F.slice("scores", F.lit(block) * size + 1, F.lit(size))
    best = F.array_max(part)
    return F.struct(best.alias("score"), (F.lit(block) * size + F.array_position(part, best) - 1).cast("long").alias("id"))


def block_winners(frames: DataFrame, blocks: int, size: int) -> DataFrame:
    """Per frame the best token of each block, the best block (of equals the
    first) and whether the blank beats all tokens (it does when equal)."""
    bests = frames.select("clip_id", "frame", F.array(*[_block_best(b, size) for b in range(blocks)]).alias("best"), F.element_at("scores", blocks * size + 1).alias("blank"))
    top = F.array_max(F.transform("best", lambda x: x["score"]))
    return bests.withColumn("_top", top).select("clip_id", "frame", "best", "blank", (F.array_position(F.transform("best", lambda x: x["score"]), F.col("_top")) - 1).cast("long").alias("block"), (F.col("blank") >= F.col("_top")).alias("is_blank"))


def language_vote(winners: DataFrame) -> DataFrame:
    """Each clip's block by the votes of its frames that are not blank; of equals
    the lowest, without votes block 0. ``votes`` maps blocks to frames."""
    votes = winners.filter("not is_blank").groupBy("clip_id", "block").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("clip_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "block")).alias("_b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", "n")))).alias("votes"))
    return winners.select("clip_id").distinct().join(best, "clip_id", "left").select("clip_id", F.coalesce("_b.block", F.lit(0).cast("long")).alias("block"), (-F.coalesce("_b.k", F.lit(0))).cast("long").alias("n_votes"), "votes")


def greedy_ids(winners: DataFrame, chosen: DataFrame, blank_id: int) -> DataFrame:
    """Per frame the chosen block's best token, or the blank if it scores no less."""
    j = winners.select("clip_id", "frame", "best", "blank").join(chosen.select("clip_id", "block"), "clip_id")
    best = F.get("best", F.col("block").cast("int"))
    return j.select("clip_id", "frame", F.when(F.col("blank") >= best["score"], F.lit(blank_id).cast("long")).otherwise(best["id"]).alias("id"))


def collapse(ids: DataFrame, blank_id: int) -> DataFrame:
    """Runs of one token become one piece (``from_frame, to_frame``); blanks go."""
    w = W.partitionBy("clip_id").orderBy("frame")
    new = ids.withColumn("_new", F.when(F.lag("id").over(w).eqNullSafe(F.col("id")), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pieces = runs.groupBy("clip_id", "run").agg(F.first("id").alias("id"), F.min("frame").alias("from_frame"), F.max("frame").alias("to_frame"))
    return pieces.filter(F.col("id") != blank_id)


def pieces_to_words(pieces: DataFrame, tokens: DataFrame, frame_ms: int) -> DataFrame:
    """Pieces joined to words: a token that starts a word (``starts``) begins one.
    Tokens: ``id, piece, starts``; they are a vocabulary, so they go to every task
    when Spark finds them small."""
    w = W.partitionBy("clip_id").orderBy("run")
    p = pieces.join(tokens, "id")
    first = F.lag("run").over(w).isNull()
    p = p.withColumn("_s", F.when(F.col("starts") | first, 1).otherwise(0)).withColumn("word", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    g = p.groupBy("clip_id", "word").agg(F.min("from_frame").alias("f0"), F.max("to_frame").alias("f1"), F.array_sort(F.collect_list(F.struct("run", "piece"))).alias("_p"))
    return g.select("clip_id", F.col("word").cast("long").alias("wid"), F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("w"), (F.col("f0") * frame_ms).cast("long").alias("start_ms"), ((F.col("f1") + 1) * frame_ms).cast("long").alias("end_ms"))


def suspect_segments(segments: DataFrame, compression: float = 2.4, no_speech: float = 0.6) -> DataFrame:
    """Per clip how many segments look wrong by compression ratio or silence."""
    bad = (F.col("compression_ratio") > compression) | (F.col("no_speech_prob") > no_speech)
    return segments.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(bad).alias("suspect_segments"))


def parse_diarizer_output(df: DataFrame, column: str = "output") -> DataFrame:
    """Turns from a diarizer's JSON, whichever of its shapes: a list of objects,
    an object whose ``segments`` is one, or a list of ``start end speaker`` lines
    (seconds). Adds ``idx, start_ms, end_ms, speaker``, in order of time; what has
    no length is dropped, and text of no such shape gives no turns."""
    item = "struct<start:double,end:double,speaker:string>"
    objects = F.from_json(column, f"array<{item}>")
    inner = F.from_json(column, f"struct<segments:array<{item}>>")["segments"]
    lines = F.filter(F.from_json(column, "array<string>"), lambda x: x.rlike(r"^\s*[0-9.]+\s+[0-9.]+\s+\S+\s*$"))
    parts = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    read = F.transform(parts, lambda p: F.struct(p[0].cast("double").alias("start"), p[1].cast("double").alias("end"), p[2].alias("speaker")))
    whole = lambda a: F.filter(a, lambda x: x["start"].isNotNull() & x["end"].isNotNull() & (x["end"] > x["start"]))
    some = lambda a: F.when(F.size(whole(a)) > 0, whole(a))
    found = F.array_sort(F.coalesce(some(objects), some(inner), some(read)))
    ms = lambda c: F.bround(c * 1000, 0).cast("long")
    each = df.select(*[c for c in df.columns if c != column], F.posexplode(found).alias("idx", "_t"))
    return each.select("*", ms(F.col("_t.start")).alias("start_ms"), ms(F.col("_t.end")).alias("end_ms"), F.col("_t.speaker").alias("speaker")).drop("_t")
