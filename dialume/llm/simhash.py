"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

Fingerprints that differ in at most two bits agree in at least two of four
16-bit parts, so each distinct fingerprint goes to six buckets of 32 shared
bits. In a bucket the fingerprints are sorted by Gray rank (neighbours differ in
few bits), and a tree is laid over them: a node holds the bits that all
fingerprints below it share. A search adds up the differences from the root
down and drops a whole group once they exceed two.

A bucket of more than ``LARGE`` fingerprints is dealt again by two of four
8-bit parts of its other bits; then 16 bits are left, so no bucket can hold more
than 65,536 fingerprints, and none of them has more than 136 partners.
Copies share a fingerprint and are searched once.

``similar_documents`` links by similarity: wider fingerprints, a radius that
stands for a Jaccard similarity, and buckets by sampled shingles, searched by the
same index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix
from .common import documents_view, materialize, partitions, salt_of, tidy
from .components import components
from .rlz import SPACES

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE, SEED, BITS = 3, 42, 2
#: The similarity mode: words in a shingle, Jaccard similarity of a link.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Its fingerprints' 64-bit words, sampled shingles that buckets are named by, and
#: rows of a bucket from which on it is cut into tiles of ``TILE`` times as many.
WORDS, SAMPLED, CROWDED, TILE = 8, 8, 4096, 4
_random = np.random.default_rng(42)
LANES = _random.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
SAMPLERS = _random.integers(0, 2**64, SAMPLED, dtype=np.uint64)
LARGE, FAN = 2048, 16
#: Bit masks of two of four 16-bit parts.
PAIRS = [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in combinations(range(4), 2)]
#: For each of them, masks of two of four 8-bit parts of the other bits.
INNER = [[(0xFF << a) | (0xFF << b) for a, b in combinations([s for s in range(0, 64, 8) if not (p >> s) & 0xFF], 2)] for p in PAIRS]


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of words of a text whose A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    raw = LOWER[np.frombuffer(text + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[True, SPACES[raw]]))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    if n > 1 and ((start[1:] - end[:-1] != 1).any() or (raw[end[:-1]] != 0x20).any()):
        raw[end] = 0x20
        change = np.zeros(len(raw) + 1, np.int8)
        change[start] += 1
        change[np.minimum(end + 1, len(raw))] -= 1
        raw = raw[np.cumsum(change[:-1], dtype=np.int8) > 0]
        size = end - start
        end = np.cumsum(size + 1) - 1
        start = end - size
    data = raw.tobytes()
    k = min(shingle, n)
    return np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(start[: n - k + 1].tolist(), end[k - 1 :].tolist())], np.uint64)


#: The eight bits of every byte, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 300:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        cells = np.bincount((lanes + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256)
        counts = (cells @ BYTE_BITS).ravel()
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(shingle_hashes(x.as_py())) for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["_id", "_fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in Gray code order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def gray_index(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order by Gray rank (of a fingerprint's first word) and, from the leaves
    up, each level's shared bits (mask, pattern). One row a fingerprint."""
    order = np.argsort(gray_rank(fps[:, 0]), kind="stable")
    ones = zeros = fps[order]
    levels = [(np.full(ones.shape, ~U(0)), ones)]
    while len(ones) > FAN:
        cut = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_or.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
        levels.append((~(ones ^ zeros), zeros))
    return order, levels


#: Words of fingerprints that a search lays out at once.
LAID_OUT = 1 << 22


def close_pairs(fps: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of fingerprints (rows of 64-bit words, or single words) that
    differ in at most ``bits`` bits."""
    fps = fps.reshape(len(fps), -1)
    order, levels = gray_index(fps)
    sorted_fps, n_words = fps[order], fps.shape[1]
    block = max(1, min(4096, LAID_OUT // (len(fps) * n_words + 1)))
    for at in range(0, len(fps), block):
        query = sorted_fps[at : at + block]
        top = len(levels) - 1
        width = len(levels[top][0])
        q, node = np.repeat(np.arange(len(query)), width), np.tile(np.arange(width), len(query))
        above, sum_ = np.zeros((len(q), n_words), np.uint64), np.zeros(len(q), np.int64)
        for depth in range(top, -1, -1):
            mask, pattern = levels[depth]
            sum_ = sum_ + np.bitwise_count((query[q] ^ pattern[node]) & mask[node] & ~above).sum(1, dtype=np.int64)
            keep = sum_ <= bits
            q, node, sum_ = q[keep], node[keep], sum_[keep]
            if depth:
                first = node * FAN
                n = np.minimum(FAN, len(levels[depth - 1][0]) - first)
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                above = np.repeat(mask[node], n, axis=0)
                q, node, sum_ = np.repeat(q, n), np.repeat(first, n) + shift, np.repeat(sum_, n)
                ahead = node * FAN ** (depth - 1) + FAN ** (depth - 1) > q + at  # pairs are met from their first member
                q, node, sum_, above = q[ahead], node[ahead], sum_[ahead], above[ahead]
        some = node > q + at
        yield order[q[some] + at], order[node[some]]


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that links reach, for each of ``n`` places."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINK_SCHEMA = "kind int, a long, b long, key long"


def _links(last: bool):
    """From rows sorted by key: links within a key's fingerprints (kind 0), or,
    from large keys, rows dealt again (kind 1: a fingerprint, b its document, key)."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.zeros(len(a), np.int64) if key is None else key.view(np.int64))], names=["kind", "a", "b", "key"])

    def again(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        masks = np.array(INNER, np.uint64)[(key >> 32) & 7]
        return batch(1, np.repeat(fp, 6), np.repeat(rep, 6), _key(key, fp, masks))

    def solve(fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = np.arange(len(fp))
        order = np.argsort(rep, kind="stable")
        fp, rep = fp[order], rep[order]
        for a, b in close_pairs(fp):
            label = forest(len(fp), a, b, label)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        if len(linked):
            yield batch(0, rep[linked], rep[label[linked]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        large = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                fp, rep = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                held.clear()
                if len(fp) > 1:
                    yield from solve(fp, rep)

        for b in batches:
            key, fp, rep = (b.column(j).to_numpy() for j in range(3))
            fp = fp.view(np.uint64)
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and held[0][0][0] != key[s]:
                    yield from close()
                if key[s] == large:
                    yield again(key[s:e], fp[s:e], rep[s:e])
                    continue
                held.append((key[s:e], fp[s:e], rep[s:e]))
                if not last and sum(len(h[0]) for h in held) > LARGE:
                    large = key[s]
                    for h in held:
                        yield again(*h)
                    held.clear()
        yield from close()

    return run


def _key(key: np.ndarray, fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A number for the shared bits of a first and a second choice of parts."""
    chosen = np.broadcast_to(np.arange(6, dtype=np.uint64), masks.shape)
    return (mix(mix(key.view(np.uint64)[:, None] ^ (chosen << U(40))) ^ (fp[:, None] & masks))).ravel()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _fp`` (a long with the fingerprint's bits) and ``_root``, the
    smallest identifier reachable over links, for every row of ``docs``.

    Texts link if their fingerprints differ in at most two bits. A text without
    words (null, empty, blank) has fingerprint zero and links like any other; one
    of fewer than three words has one shingle, all of it. Rows repeated with one
    identifier are rows of one document. Rows without an identifier share the
    component of documents with their fingerprint, or have a null one. An empty
    table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    salts = max(16, partitions(spark))
    view = documents_view(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    rows = materialize(view.mapInArrow(tidy(_fingerprints), "_id long, _fp long"), "fingerprints").withColumn("_salt", salt_of(F.struct("_id"), salts))
    part = rows.groupBy("_fp", "_salt").agg(F.min("_id").alias("_rep"))
    classes = materialize(part.groupBy("_fp").agg(F.min("_rep").alias("_rep")), "classes")
    links = linked(classes.filter("_rep is not null"))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(roots, F.col("_rep") == F.col("node"), "left").select("_fp", F.coalesce("root", "_rep").alias("_root"))
    back = part.select("_fp", "_salt").join(named, "_fp")
    return rows.join(back, ["_fp", "_salt"]).select("_id", "_fp", "_root")


def linked(classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between representatives that join all fingerprints within
    two bits of each other (a spanning forest of each bucket, not every pair)."""
    keys = F.array(*[(F.col("_fp").bitwiseAND(F.lit(_signed(m)))) for m in PAIRS])
    packed = F.transform(keys, lambda k, i: _pack32(k, i))
    first = classes.select(F.explode(packed).alias("key"), "_fp", "_rep").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_links(False)), LINK_SCHEMA)
    first = materialize(first, "links")
    second = first.filter("kind = 1").select("key", "a", "b").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_links(True)), LINK_SCHEMA)
    return first.filter("kind = 0").select("a", "b").union(second.select("a", "b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack32(k, i):
    """The 32 bits that a pair of parts leaves, below the pair's number."""
    part = lambda a: F.shiftrightunsigned(k, 16 * a).bitwiseAND(F.lit(0xFFFF))
    two = [F.shiftleft(part(a), 16).bitwiseOR(part(b)) for a, b in combinations(range(4), 2)]
    out = two[5]
    for j in range(4, -1, -1):
        out = F.when(i == j, two[j]).otherwise(out)
    return out.bitwiseOR(F.shiftleft(i.cast("long"), 32))


# links by similarity ---------------------------------------------------------


def radius(least: float, n_words: int = WORDS) -> int:
    """Bits in which the fingerprints of two sets of that Jaccard similarity are
    expected to differ (sets of one size, whose cosine is 2 J / (1 + J))."""
    return int(round(64 * n_words * math.acos(2 * least / (1 + least)) / math.pi))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of SimHash over a set of shingles: each word by hashes of its own."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        lanes = mix(hashes[at : at + (1 << 12), None] * LANES)
        counts += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def sampled(hashes: np.ndarray) -> np.ndarray:
    """For each sampler the shingle that it ranks first: two sets agree on it with
    a probability of their Jaccard similarity."""
    if not len(hashes):
        return np.zeros(len(SAMPLERS), np.uint64)
    return np.array([mix(hashes ^ s).min() for s in SAMPLERS], np.uint64)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1).cast(pa.binary())]
            fps = [wide_fingerprint(s).tobytes() for s in sets]
            keys = [sampled(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.binary())], names=["_id", "_fp", "_sampled"])

    return run


MEMBER_SCHEMA = "key long, rep long, fp binary"
#: A link (kind 0) or a tile (kind 1: its bucket, its number as ``a``, and its rows'
#: identifiers, components in the tile and fingerprints).
NEAR_SCHEMA = "kind int, a long, b long, key long, reps binary, labels binary, fps binary"


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Names of a row's buckets: the sampler's number and its shingle."""
    chosen = np.arange(SAMPLED, dtype=np.uint64) + U(1)
    return mix(mix(chosen * U(0x9E3779B97F4A7C15)) ^ keys).view(np.int64)


#: Rows that are dealt to their buckets at a time, each becoming many.
DEALT = 512


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, DEALT) for at in range(0, batch.num_rows, DEALT))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (rep, fingerprint, samples) in their buckets."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        key = _buckets(_matrix(batch.column(2), SAMPLED))
        rows = pa.array(np.repeat(np.arange(len(key)), SAMPLED))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[batch.column(j).take(rows) for j in range(2)]], names=["key", "rep", "fp"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def pairs_within(x: np.ndarray, y: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all fingerprints of ``x`` and ``y`` that differ in at most
    ``bits`` bits: words are compared one by one until few pairs are left."""
    block = max(1, (1 << 20) // max(1, len(y)))
    y_words = np.ascontiguousarray(y.T)
    for at in range(0, len(x), block):
        part = x[at : at + block]
        differ = np.zeros((len(part), len(y)), np.uint16)
        for w in range(x.shape[1]):
            differ += np.bitwise_count(part[:, w, None] ^ y_words[w])
            near = differ <= bits
            if w + 1 == x.shape[1] or np.count_nonzero(near) * 16 < near.size:
                break
        a, b = np.nonzero(near)
        if w + 1 < x.shape[1]:
            keep = differ[a, b] + np.bitwise_count(part[a, w + 1 :] ^ y[b, w + 1 :]).sum(1, dtype=np.int64) <= bits
            a, b = a[keep], b[keep]
        yield a + at, b


def similar_forest(fps: np.ndarray, bits: int, pivots: int = 8, indexed: bool = True) -> np.ndarray:
    """The smallest place that links of at most ``bits`` bits reach, for each
    fingerprint. What one of the first few fingerprints is linked to needs no
    comparison among itself; all other pairs go through the index, or, where there
    are very many, through ``pairs_within``."""
    label = np.arange(len(fps))
    for p in range(min(pivots, len(fps))):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[p]).sum(1) <= bits)
        label = forest(len(fps), np.full(len(near), p), near, label)
    sizes = np.bincount(label, minlength=len(fps))
    star = label == sizes.argmax()
    rest = np.flatnonzero(~star)
    if len(rest) * 4 > len(fps):
        for a, b in close_pairs(fps, bits) if indexed else pairs_within(fps, fps, bits):
            label = forest(len(fps), a, b, label)
        return label
    whole = np.flatnonzero(star)
    for i in rest.tolist():  # few: each against the large group, then among themselves
        if np.bitwise_count(fps[whole] ^ fps[i]).sum(1).min() <= bits:
            label = forest(len(fps), np.array([i]), whole[:1], label)
    if len(rest) > 1:
        for a, b in close_pairs(fps[rest], bits):
            label = forest(len(fps), rest[a], rest[b], label)
    return label


def joined_forest(fps: np.ndarray, label: np.ndarray, n: int, bits: int, pivots: int = 8) -> np.ndarray:
    """The components of two tiles (the first ``n`` rows and the others) whose own
    ones ``label`` holds. Every pair across is compared but those that a link
    between large components has joined already."""
    sides = (np.arange(n), np.arange(n, len(fps)))
    sizes = np.bincount(label, minlength=len(fps))
    for here, there in (sides, sides[::-1]):
        for p in here[np.argsort(-sizes[here], kind="stable")[:pivots]]:  # roots of large components
            near = there[np.bitwise_count(fps[there] ^ fps[p]).sum(1) <= bits]
            label = forest(len(fps), np.full(len(near), p), near, label)
    star = label == np.bincount(label).argmax()
    if (~star).sum() * 4 > len(fps):
        star[:] = False
    first, second = sides
    some = first[~star[first]]
    for x, y in ((some, second), (first[star[first]], second[~star[second]])):
        for a, b in pairs_within(fps[x], fps[y], bits) if len(x) and len(y) else ():
            label = forest(len(fps), x[a], y[b], label)
    return label


def _found(kind: int, a: np.ndarray, b: np.ndarray, key: int = 0, *bodies: bytes) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.full(n, key, np.int64))]
    columns += [pa.array([x], pa.binary()) for x in bodies] or [pa.nulls(n, pa.binary())] * 3
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "key", "reps", "labels", "fps"])


def _near(bits: int):
    """From rows sorted by bucket: links within a bucket. A crowded one is cut into
    tiles; each gives its own links, and itself to be compared with the others."""

    def solve(parts: list[pa.RecordBatch], tile: int | None = None) -> Iterator[pa.RecordBatch]:
        rep = np.concatenate([p.column(1).to_numpy() for p in parts])
        if len(rep) < 2 and tile is None:
            return
        fps = np.concatenate([_matrix(p.column(2), WORDS) for p in parts])
        order = np.argsort(rep, kind="stable")
        rep, fps = rep[order], fps[order]
        label = similar_forest(fps, bits, indexed=tile is None)
        linked = np.flatnonzero(label != np.arange(len(rep)))
        if len(linked):
            yield _found(0, rep[linked], rep[label[linked]])
        if tile is not None:
            yield _found(1, np.array([tile]), np.array([0]), parts[0].column(0)[0].as_py(), rep.astype("<i8").tobytes(), label.astype("<i4").tobytes(), fps.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, n, tiles, most = None, 0, 0, TILE * CROWDED
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if now != key[s]:
                    if held:
                        yield from solve(held, tiles if tiles or n > CROWDED else None)
                    held, now, n, tiles = [], key[s], 0, 0
                while s < e:
                    part = batch.slice(s, min(e - s, most - n))
                    held.append(part)
                    n, s = n + part.num_rows, s + part.num_rows
                    if n == most:
                        yield from solve(held, tiles)
                        held, n, tiles = [], 0, tiles + 1
        if held:
            yield from solve(held, tiles if tiles or n > CROWDED else None)

    return run


def _cells(bits: int):
    """From pairs of tiles of one bucket, each pair's two in a row: links across
    that join their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for i in range(batch.num_rows):
                rep, label, fps = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in ((3, "<i8"), (4, "<i4"), (5, "<u8")))
                tile = rep, label.astype(np.int64), fps.reshape(-1, WORDS)
                if first is None:
                    first = tile
                    continue
                n = len(first[0])
                reps, own = np.r_[first[0], rep], np.r_[first[1], tile[1] + n]
                label = joined_forest(np.concatenate([first[2], tile[2]]), own, n, bits)
                first = None
                linked = np.flatnonzero((own == np.arange(len(own))) & (label != own))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(reps[label[linked]])], names=["a", "b"])

    return run


def across(tiles: DataFrame) -> DataFrame:
    """Every pair of tiles of a bucket: two rows, sorted next to each other."""
    counts = tiles.groupBy("key").agg(F.max("a").alias("_last")).filter("_last > 0")
    every = tiles.join(counts, "key").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).filter("_other <> a")
    cells = every.select("key", F.least("a", "_other").alias("lo"), F.greatest("a", "_other").alias("hi"), "reps", "labels", "fps")
    return cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def bucket_links(members: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` that join all rows (``key, rep, fp``) of a bucket that differ
    in at most ``bits`` bits, whatever the bucket's size (not every pair)."""
    found = materialize(members.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_near(bits)), NEAR_SCHEMA), "links")
    tiles = found.filter("kind = 1").select("key", "a", "reps", "labels", "fps")
    joined = materialize(across(tiles).mapInArrow(tidy(_cells(bits)), "a long, b long"), "links")
    return found.filter("kind = 0").select("a", "b").union(joined)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``_id`` and ``_root``, the smallest identifier reachable over links, for
    every row of ``docs``.

    Texts link if their SimHash fingerprints of ``64 * WORDS`` bits, over the sets
    of their runs of ``shingle`` words, differ in no more bits than those of two
    sets of Jaccard similarity ``least`` are expected to (``radius``). Two bits of
    64 stand for far more than 0.8, and a radius that reaches 0.8 leaves no bits
    that the two surely share; so documents meet in buckets named by a sampled
    shingle (two texts of similarity 0.8 miss each other in all of them once in
    100,000 times), and a bucket is searched by the Gray-order index. A crowded
    bucket is cut into tiles and every pair of tiles compared, so no link between
    texts that share a sampled shingle is lost, however many share it.

    A-Z count as lower case. A text of fewer words has one shingle, all of it;
    texts without words link. Rows repeated with one identifier are rows of one
    document. Rows without an identifier share the component of documents with
    their fingerprint, or have a null one. An empty table gives no rows; further
    columns are ignored.
    """
    salts, bits = max(16, partitions(docs.sparkSession)), radius(least)
    view = documents_view(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    rows = materialize(view.mapInArrow(tidy(_sketches(shingle)), "_id long, _fp binary, _sampled binary"), "sketches").withColumn("_salt", salt_of(F.struct("_id"), salts))
    part = rows.groupBy("_fp", "_salt").agg(F.min("_id").alias("_rep"), F.min("_sampled").alias("_sampled"))
    classes = materialize(part.groupBy("_fp").agg(F.min("_rep").alias("_rep"), F.min("_sampled").alias("_sampled")), "classes")
    members = classes.filter("_rep is not null").select("_rep", "_fp", "_sampled").mapInArrow(tidy(_members), MEMBER_SCHEMA)
    links = bucket_links(members, bits)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(roots, F.col("_rep") == F.col("node"), "left").select("_fp", F.coalesce("root", "_rep").alias("_root"))
    back = part.select("_fp", "_salt").join(named, "_fp")
    return rows.select("_id", "_fp", "_salt").join(back, ["_fp", "_salt"]).select("_id", "_root")


def hex64(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")
