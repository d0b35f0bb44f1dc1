"""Error rates of words: WER, cpWER, its greedy form, and WDER.

Edit distances run in the JVM: the words of a pair are numbered by the clip's
vocabulary, each number becomes one character, and ``levenshtein`` counts edits of
characters. Only the alignment for WDER, which needs the path, and assignments of
more speakers than an enumeration can take run in Python, a clip at a time.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.udf import batched

#: Different words that characters can stand for (all but the surrogates and the
#: first 255); pairs of lists with more go through a row-by-row kernel.
MOST_WORDS = 0x110000 - 0x800 - 256


def word_list(words: DataFrame, keys: list[str], order: list[str], word: str = "w", name: str = "ws") -> DataFrame:
    """Each group's words in order, as an array."""
    packed = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, word))).alias("_w"))
    return packed.select(*keys, F.transform("_w", lambda x: x[word]).alias(name))


def encode(ws: Column, vocabulary: Column) -> Column:
    """One character a word: its place in the vocabulary, past the surrogates."""

    def char(w: Column) -> Column:
        n = F.array_position(vocabulary, w).cast("int") + 255
        n = n + F.when(n >= 0xD800, 0x800).otherwise(0)
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    return F.array_join(F.transform(ws, char), "")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all partitions: alignments are few bytes and much work, so
    partitions must not be merged by their size (by a hash of the keys, so that an
    exchange on the keys themselves is not taken for this one)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def with_edits(df: DataFrame, ref: str, hyp: str, name: str, most: int | None = MOST_WORDS) -> DataFrame:
    """``df`` with the word edits between two arrays of words (null: none). The
    generator keeps the vocabulary, which every word is looked up in, from being
    computed again for each of them."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(ref, none), F.coalesce(hyp, none)
    once = df.select("*", F.inline(F.array(F.struct(a.alias("_a"), b.alias("_b"), F.array_distinct(F.concat(a, b)).alias("_v")))))
    a, b, v = F.col("_a"), F.col("_b"), F.col("_v")
    some = F.levenshtein(encode(a, v), encode(b, v)).cast("long")
    plain = F.when(F.size(a) == 0, F.size(b).cast("long")).when(F.size(b) == 0, F.size(a).cast("long")).otherwise(some)
    if most is None:
        return once.withColumn(name, plain).drop("_a", "_b", "_v")
    many = F.size(v) >= most
    long_ = _distance(F.when(many, a), F.when(many, b))
    return once.withColumn(name, F.when(many, long_).otherwise(plain)).drop("_a", "_b", "_v")


@batched("long")
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        numbers: dict[str, int] = {}
        code = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], int)
        ref, hyp = code(x), code(y)
        out.append(int(_advance(np.arange(len(ref) + 1), ref, hyp)[-1]))
    return pd.Series(out, dtype="Int64")


def wer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """``clip_id, wer_errors, wer_length`` for clips with a hypothesis. ``ref`` and
    ``hyp``: ``clip_id, ws`` (words in order of time)."""
    j = ref.join(hyp.select("clip_id", F.col("ws").alias("_h")), "clip_id")
    return with_edits(spread(j, "clip_id"), "ws", "_h", "wer_errors").select("clip_id", "wer_errors", F.size("ws").cast("long").alias("wer_length"))


def speaker_pairs(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Edits between every reference and hypothesis speaker of a clip (``clip_id,
    speaker, ws`` each): arrays ``refs`` and ``hyps`` (speaker, words) by name, and
    ``costs``, row by row."""
    # one pair a row, so that a clip's pairs are spread and each is priced once
    place = F.row_number().over(W.partitionBy("clip_id").orderBy("speaker")) - 1
    r = ref.select("clip_id", place.alias("i"), F.struct("speaker", "ws").alias("r"))
    h = hyp.select("clip_id", place.alias("j"), F.struct("speaker", "ws").alias("h"))
    pairs = r.join(h, "clip_id")
    priced = with_edits(spread(pairs, "clip_id", "i", "j"), "r.ws", "h.ws", "cost").select("clip_id", "i", "j", F.struct(F.col("r.speaker").alias("speaker"), F.size("r.ws").cast("long").alias("n")).alias("_r"), F.struct(F.col("h.speaker").alias("speaker"), F.size("h.ws").cast("long").alias("n")).alias("_h"), "cost")
    g = priced.groupBy("clip_id").agg(F.array_sort(F.collect_set(F.struct("i", "_r"))).alias("_r"), F.array_sort(F.collect_set(F.struct("j", "_h"))).alias("_h"), F.array_sort(F.collect_list(F.struct("i", "j", "cost"))).alias("_c"))
    return g.select("clip_id", F.transform("_r", lambda x: x["_r"]).alias("refs"), F.transform("_h", lambda x: x["_h"]).alias("hyps"), F.transform("_c", lambda x: x["cost"]).alias("costs"))


def assign(cost: np.ndarray) -> np.ndarray:
    """The columns that rows take at the least total cost (Hungarian method, with
    potentials); rows must not outnumber columns. Of equals the lowest columns are
    met first, which need not be the first assignment of all (``first_of_equals``)."""
    return _assign(cost)[0]


def _assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``assign``, and each cell's cost above the potentials: nothing where some
    best assignment may lie."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j
            free = np.flatnonzero(~used[1:]) + 1
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out, cost - u[1:, None] - v[1:]


def first_of_equals(cost: np.ndarray) -> np.ndarray:
    """Of all assignments of the least total cost (a square matrix of whole
    numbers) the first, compared by the column of row 0, then of row 1, ..."""
    to, above = _assign(cost)
    may = above == 0  # a full assignment within these cells is a best one
    for i in range(len(to)):
        for j in np.flatnonzero(may[i, : to[i]]).tolist():
            # later rows change columns along a path from j's owner to the column that row i leaves
            owner = {int(c): r for r, c in enumerate(to) if r > i}
            if j not in owner:
                continue
            seen, todo, came = {j}, [j], {}
            while todo and to[i] not in came:
                at = todo.pop()
                for c in np.flatnonzero(may[owner[at]]).tolist():
                    if c not in seen and (c == to[i] or c in owner):
                        seen.add(c)
                        came[c] = at
                        if c != to[i]:
                            todo.append(c)
            c = int(to[i])
            if c not in came:
                continue
            while c != j:
                to[owner[came[c]]], c = c, came[c]
            to[i] = j
            break
    return to


def padded(costs: list, refs: list, hyps: list) -> np.ndarray:
    """A square matrix: an unmatched reference speaker costs all its words, an
    unmatched hypothesis speaker likewise."""
    size = len(refs) + len(hyps)
    out = np.zeros((size, size))
    out[: len(refs), : len(hyps)] = np.array(costs, float).reshape(len(refs), len(hyps))
    out[: len(refs), len(hyps) :] = np.array([r["n"] for r in refs])[:, None]
    out[len(refs) :, : len(hyps)] = np.array([h["n"] for h in hyps])[None, :]
    return out


@batched("struct<errors:long,mapping:array<struct<hyp:string,ref:string>>>")
def _optimal(refs: pd.Series, hyps: pd.Series, costs: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h, c in zip(refs, hyps, costs):
        r, h = list(r), list(h)
        m = padded(c, r, h)
        to = assign(m)
        rows.append({"errors": int(m[np.arange(len(m)), to].sum()), "mapping": [{"hyp": h[to[i]]["speaker"], "ref": r[i]["speaker"]} for i in range(len(r)) if to[i] < len(h)]})
    return pd.DataFrame(rows, columns=["errors", "mapping"])


def cpwer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """``clip_id, cp_errors, cp_length, mapping``: the least edits over all ways to
    match speakers; speakers without a partner count all their words."""
    p = speaker_pairs(ref, hyp)
    best = p.withColumn("_b", _optimal("refs", "hyps", "costs"))
    return best.select("clip_id", F.col("_b.errors").alias("cp_errors"), F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("cp_length"), F.col("_b.mapping").alias("mapping"))


def cpwer_enumerated(ref: DataFrame, hyp: DataFrame, most: int = 3) -> DataFrame:
    """The same errors for clips of at most ``most`` speakers a side, by trying
    every matching in one expression."""
    p = speaker_pairs(ref, hyp).filter((F.size("refs") <= most) & (F.size("hyps") <= most))
    tries = []
    for order in permutations(range(most)):
        total = F.lit(0).cast("long")
        for i, j in enumerate(order):
            r, h = F.get("refs", F.lit(i)), F.get("hyps", F.lit(j))
            cell = F.get("costs", F.lit(i) * F.size("hyps") + F.lit(j))
            total = total + F.when(r.isNull(), F.coalesce(h["n"], F.lit(0))).when(h.isNull(), r["n"]).otherwise(F.least(cell, r["n"] + h["n"]))
        tries.append(total)
    length = F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    return p.select("clip_id", F.least(*tries).alias("cp_errors"), length.alias("cp_length"))


# diarization-invariant cpWER ------------------------------------------------


def greedy_di(refs: list[list[str]], segments: list[list[str]]) -> int:
    """Errors when every hypothesis segment goes, in order, to the reference
    speaker at whom it adds the fewest edits (of equals the first). Each speaker's
    edit row is carried along, so a segment costs its words times a row."""
    numbers: dict[str, int] = {}
    code = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], int)
    coded = [code(r) for r in refs] or [code([])]
    rows = [np.arange(len(r) + 1) for r in coded]
    for segment in segments:
        after = [_advance(row, r, code(segment)) for row, r in zip(rows, coded)]
        gain = [int(a[-1] - row[-1]) for a, row in zip(after, rows)]
        k = int(np.argmin(gain))
        rows[k] = after[k]
    return int(sum(row[-1] for row in rows))


def _advance(row: np.ndarray, ref: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The edit row after more hypothesis words; insertions along the row by a running minimum."""
    place = np.arange(len(ref) + 1)
    for w in words:
        new = np.r_[row[0] + 1, np.minimum(row[1:] + 1, row[:-1] + (ref != w))]
        row = np.minimum.accumulate(new - place) + place
    return row


@batched("long")
def _greedy(refs: pd.Series, segments: pd.Series) -> pd.Series:
    return pd.Series([greedy_di([list(r["ws"]) for r in a], [list(s["ws"]) for s in b]) for a, b in zip(refs, segments)])


def di_cpwer(ref: DataFrame, segments: DataFrame) -> DataFrame:
    """``clip_id, di_errors``. ``ref``: ``clip_id, speaker, ws``; ``segments``:
    ``clip_id, unit, ws``, runs of one speaker's words in the order of time. An
    upper bound of the best assignment of segments."""
    r = ref.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "ws"))).alias("r"))
    s = segments.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("unit", "ws"))).alias("s"))
    return spread(r.join(s, "clip_id"), "clip_id").select("clip_id", _greedy("r", "s").alias("di_errors"))


# WDER -------------------------------------------------------------------------


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions paired by a least-cost alignment (equal or replaced). From the
    end backwards a diagonal step goes before a deletion, that before an insertion."""
    numbers: dict[str, int] = {}
    code = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], int)
    x, y = code(a), code(b)
    place = np.arange(len(y) + 1)

    def advance(row: np.ndarray, w: int) -> np.ndarray:
        new = np.r_[row[0] + 1, np.minimum(row[1:] + 1, row[:-1] + (y != w))]
        return (np.minimum.accumulate(new - place) + place).astype(np.int32)

    # rows of the table are kept every ``stride``; those between are worked out
    # again on the way back, so memory grows with the root of the words of ``a``
    stride = max(16, int(len(x) ** 0.5))
    row, kept = place.astype(np.int32), []
    for i, w in enumerate(x):
        if i % stride == 0:
            kept.append(row)
        row = advance(row, w)
    pairs, i, j = [], len(x), len(y)
    table, base = [row], len(x)
    while i and j:
        if i - 1 < base:
            base = (i - 1) // stride * stride
            table = [kept[base // stride]]
            for w in x[base:i]:
                table.append(advance(table[-1], w))
        here, above = table[i - base], table[i - base - 1]
        if here[j] == above[j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif here[j] == above[j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


@batched("struct<wrong:long,pairs:long>")
def _wder(ref: pd.Series, hyp: pd.Series, mapping: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h, m in zip(ref, hyp, mapping):
        r, h = list(r), list(h)
        to = {x["hyp"]: x["ref"] for x in m}
        pairs = align([x["w"] for x in r], [x["w"] for x in h])
        rows.append((sum(to.get(h[j]["speaker"]) != r[i]["speaker"] for i, j in pairs), len(pairs)))
    return pd.DataFrame(rows, columns=["wrong", "pairs"])


def wder(ref: DataFrame, hyp: DataFrame, mapping: DataFrame) -> DataFrame:
    """``clip_id, wder_errors, wder_length``: of the words that an alignment pairs,
    those whose hypothesis speaker is not mapped to the reference speaker. ``ref``,
    ``hyp``: ``clip_id, wid, speaker, w``."""
    packed = lambda d, name: d.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("wid", "speaker", "w"))), lambda x: F.struct(x["speaker"].alias("speaker"), x["w"].alias("w"))).alias(name))
    j = packed(ref, "r").join(packed(hyp, "h"), "clip_id").join(mapping.select("clip_id", "mapping"), "clip_id")
    return spread(j, "clip_id").withColumn("_x", _wder("r", "h", "mapping")).select("clip_id", F.col("_x.wrong").alias("wder_errors"), F.col("_x.pairs").alias("wder_length"))


#: Names of reference and of hypothesis speakers, in the order that settles ties.
Order = tuple[list[str], list[str]]


def bag_mapping(ref: DataFrame, hyp: DataFrame, order: Order | None = None) -> DataFrame:
    """Hypothesis to reference speakers by shared words, where no cpWER matching
    is at hand: ``clip_id, mapping``. Ties as in ``best_matching``."""
    x = ref.groupBy("clip_id", F.col("speaker").alias("r"), "w").agg(F.count(F.lit(1)).alias("x"))
    y = hyp.groupBy("clip_id", F.col("speaker").alias("h"), "w").agg(F.count(F.lit(1)).alias("y"))
    common = x.join(y, ["clip_id", "w"]).groupBy("clip_id", "r", "h").agg(F.sum(F.least("x", "y")).alias("ms"))
    return common.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("r", "h", "ms"))).alias("c")).select("clip_id", best_matching("c", order).alias("mapping"))


def best_matching(cells: Column | str, order: Order | None = None) -> Column:
    """The one-to-one matching of the largest total ``ms`` over cells (r, h, ms).

    Of equal totals, the first reference speaker takes the first hypothesis speaker
    that it can, then the second, and so on. Speakers stand in the order given,
    whether or not a clip has them (one may take an absent speaker, and stay
    without a match); then come others, by name."""
    refs, hyps = order or ([], [])

    def ranked(names: set, first: list[str]) -> list:
        return [*first, *sorted(names - set(first))]

    @batched("array<struct<hyp:string,ref:string>>")
    def matched(column: pd.Series) -> pd.Series:
        out = []
        for c in column:
            c = list(c)
            rows, cols = ranked({x["r"] for x in c}, refs), ranked({x["h"] for x in c}, hyps)
            size = max(len(rows), len(cols))
            gain = np.zeros((size, size))
            for x in c:
                gain[rows.index(x["r"]), cols.index(x["h"])] = x["ms"]
            to = first_of_equals(-gain)
            out.append([{"hyp": cols[j], "ref": rows[i]} for i, j in enumerate(to.tolist()) if gain[i, j] > 0])
        return pd.Series(out)

    return matched(cells)
