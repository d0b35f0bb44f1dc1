"""Substring dedup of bytes by sorted suffixes.

Suffixes are sampled (see ``blocks``: one anchor for each window), and only
those whose first ``GRAM`` bytes occur in two documents are looked at. The bytes
of all the windows of one document that share an anchor are a *segment*; a block
answers for each distinct segment once. An exchange of digests first tells the
groups (segments whose suffixes share ``GRAM`` bytes) in which all segments are
equal: there the smallest identifier answers for all windows.

The suffixes of mixed groups are sorted. Splitters, from the suffixes of a sample
of blocks, range-partition them by their leading bytes; whatever shares ``GRAM``
leading bytes lands in one bucket, so no group lies across a boundary. A bucket is
sorted by multikey quicksort, eight bytes a key; each group's windows are cut out
and sorted in turn, and equal neighbours share the smallest identifier. Anchors
found in more than ``HOT_BLOCKS`` blocks are compared as single windows, each a
group of its own, so that a common line with many surroundings is spread over
buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import NO_ID, U
from .common import materialize, release
from .rlz import _power

GRAM = 24
HOT_BLOCKS = 256
#: Blocks whose suffixes give the splitters, and suffixes taken from each.
SAMPLE_BLOCKS, SAMPLE_EACH = 64, 256
#: Windows that a sort holds at once (a single group may have more).
WINDOWS_AT_ONCE = 1 << 19
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def multikey_quicksort(keys: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """The order that sorts rows by keys[0], keys[1], ...: three-way partition
    on one key; equals go on to the next key. Short pieces are sorted whole."""
    n = len(keys[0])
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if depth == len(keys) or b - a < 2:
            continue
        part = order[a:b]
        if b - a <= small:
            order[a:b] = part[np.lexsort([k[part] for k in keys[:depth - 1 if depth else None : -1]])]
            continue
        k = keys[depth][part]
        some = np.sort(k[:: max(1, len(k) // 64)])
        pivot = some[len(some) // 2]
        less, same, more = part[k < pivot], part[k == pivot], part[k > pivot]
        order[a:b] = np.concatenate([less, same, more])
        m, e = a + len(less), a + len(less) + len(same)
        stack += [(a, m, depth), (m, e, depth + 1), (e, b, depth)]
    return order


def _matrix(data: np.ndarray, start: np.ndarray, width: int) -> list[np.ndarray]:
    """``width`` bytes from each start as big-endian 8-byte keys."""
    padded = np.r_[data, np.zeros(64, np.uint8)]
    out = []
    for at in range(0, width, 8):
        key = np.zeros(len(start), np.uint64)
        for j in range(at, at + 8):
            key = key << U(8)
            if j < width:
                key |= padded[start + j]
        out.append(key)
    return out


def _digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, from one running sum."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.multiply(B.BYTE_CODES[data], _power(BASE, len(data))[: len(data)], out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    found = prefix[start + size]
    found -= prefix[start]
    found *= _power(BASE_INVERSE, len(data) + 1)[start]
    return B.mix(found + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


class Segments:
    """A block's segments: the windows of one document that share an anchor."""

    def __init__(self, block: B.Block, window: int):
        gram = min(GRAM, window)
        run, place, hash_ = B.anchor_runs(B.BYTE_CODES[block.data], gram, window - gram + 1, BASE)
        lens = block.lens
        first = np.cumsum(lens) - lens
        end = first + np.maximum(lens - window + 1, 0)  # windows of a document start before this
        cut = np.sort(np.concatenate([run, first, end]), kind="stable")
        cut = cut[np.r_[True, cut[1:] != cut[:-1]]] if len(cut) else cut
        doc = np.searchsorted(first, cut, "right") - 1
        count = np.diff(np.r_[cut, len(block.data)])
        keep = np.flatnonzero((cut < end[doc]) & (count > 0)) if len(doc) else cut
        of = np.searchsorted(run, cut[keep], "right") - 1
        self.start, self.count, self.doc = cut[keep], count[keep], doc[keep]
        self.anchor, self.hash = place[of], hash_[of]
        self.block, self.window, self.gram = block, window, gram

    def select(self, width: int) -> None:
        """Keeps what may repeat and numbers the distinct segments, in an order
        that only the block and the answers decide."""
        some, hot = B.flagged(self.block, self.hash, self.doc, width)
        keep = np.flatnonzero(B.isin(B.brief(self.hash), some))
        start, count, anchor, doc, gram = (x[keep] for x in (self.start, self.count, self.anchor, self.doc, self.hash))
        is_hot = hot[keep]
        if is_hot.any():  # single windows
            n = np.where(is_hot, count, 1)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, anchor, doc, count, gram, is_hot = np.repeat(start, n), np.repeat(anchor, n), np.repeat(doc, n), np.repeat(np.where(is_hot, 1, count), n), np.repeat(gram, n), np.repeat(is_hot, n)
            start = start + np.where(is_hot, shift, 0)
            anchor = np.where(is_hot, start, anchor)
        size = count + self.window - 1
        text = _digests(self.block.data, start, size) if len(start) else np.zeros(0, np.uint64)
        text ^= B.mix((anchor - start).astype(np.uint64) * U(2) + is_hot)
        text, first, self.back = np.unique(text, return_index=True, return_inverse=True)
        self.occ_start, self.occ_doc = start, doc
        self.u_start, self.u_count, self.u_anchor, self.u_hot = start[first], count[first], anchor[first], is_hot[first]
        self.u_size, self.u_text = size[first], text
        self.u_gram = np.where(self.u_hot, B.mix(text), gram[first])  # a hot window is its own group
        self.u_id = self.block.ids[doc[first]] if len(first) else np.zeros(0, np.int64)

    def mixed(self) -> np.ndarray:
        """Numbers of the segments whose group holds different segments."""
        told = self.block.bodies.get(4, [])
        return np.unique(np.concatenate([widened(b) for b in told])) if told else np.zeros(0, np.int64)

    def leading(self, some: np.ndarray) -> np.ndarray:
        """The leading bytes of these segments' suffixes, which the range partition looks at."""
        out = np.zeros((len(some), self.gram), np.uint8)
        for j in range(self.gram):
            out[:, j] = self.block.data[self.u_anchor[some] + j]
        return out.view(f"S{self.gram}")[:, 0] if len(out) else np.zeros(0, f"S{self.gram}")


def narrowed(values: np.ndarray) -> bytes:
    """Whole numbers (one at least) in as many bytes each as their range needs."""
    least = values.min()
    above = values.astype("<i8").view("<u8") - np.array([least], "<i8").view("<u8")
    width = max(1, (int(above.max()).bit_length() + 7) // 8)
    return np.array([least, width, len(values)], "<i8").tobytes() + above.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(body: bytes, at: int = 0) -> np.ndarray:
    least, width, n = np.frombuffer(body, "<i8", 3, at).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 24).reshape(n, width)
    return (out.view("<u8")[:, 0] + np.array([least], "<i8").view("<u8")).view("<i8")


#: Bits of a gram's hash that the exchange of digests carries. The bucket adds its
#: own; a chance match makes a group look mixed, so that its bytes are compared.
GRAM_BITS = "<u4"
DIGEST_SCHEMA = "bucket int, block long, numbers binary, grams binary, texts binary, ids binary"
SEGMENT_SCHEMA = "bucket int, block long, numbers binary, sizes binary, places binary, ids binary, data binary"
ANSWER = np.dtype([("segment", "<u4"), ("first", "<u2"), ("last", "<u2"), ("id", "<i8")])
#: As ``last``: to the segment's last window.
ALL = 0xFFFF


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    if not len(start):
        return np.zeros(0, np.uint8)
    at = np.cumsum(size) - size
    return data[np.arange(size.sum()) + np.repeat(start - at, size)]


def _columns(batches: Iterator[pa.RecordBatch], kinds: tuple) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """All rows' blocks, their binary columns joined (of a type, or ``narrowed``), and
    whose each value is."""
    keys: list[int] = []
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        keys += batch.column(1).to_pylist()
        for j, t in enumerate(kinds):
            parts[j] += [np.frombuffer(x.as_py(), t) if t else widened(x.as_py()) for x in batch.column(j + 2)]
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(p) for p in parts[0]])
    return keys, [np.concatenate(p) if p else np.zeros(0, t or np.int64) for p, t in zip(parts, kinds)], owner


def _told(owner: np.ndarray, keys: list[int], kind: int, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``blocks.by_owner`` for columns of numbers, ``narrowed`` one after another."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(owner)] if len(owner) else cuts
    rows = [(keys[owner[s]], kind, b"".join(narrowed(v[order[s:e]]) for v in values)) for s, e in zip(cuts, ends)]
    for i in range(0, len(rows), 1000):
        yield B._batch(B.RESPONSE_SCHEMA, rows[i : i + 1000])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups segments by gram: where all are equal, tells the smallest
    identifier (kind 5); else, that the group is mixed (kind 4)."""
    keys, (number, gram, text, ids), owner = _columns(batches, (None, GRAM_BITS, "<u8", None))
    if not keys:
        return
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    counts = np.diff(np.r_[first, len(g)])
    t, i = text[order], ids[order]
    mixed = np.repeat(np.maximum.reduceat(t, first) != np.minimum.reduceat(t, first), counts)
    least = np.repeat(np.minimum.reduceat(i, first), counts)
    tell = ~mixed & (least < i)
    at = order[tell]
    yield from _told(owner[at], keys, 5, number[at], least[tell])
    at = order[mixed]
    yield from _told(owner[at], keys, 4, number[at])


def _sort(window: int, gram: int):
    """Sorts the suffixes of mixed groups, cuts out the windows of each group and
    sorts those: equal neighbours share the smallest identifier (kind 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, (number, size, place, ids, data), owner = _columns(batches, (None, None, None, None, np.uint8))
        if not keys:
            return
        start = np.cumsum(size) - size
        lead = _matrix(data, start + place, gram)
        order = multikey_quicksort(lead)
        change = np.zeros(len(order), bool)
        for k in lead:
            change[1:] |= k[order][1:] != k[order][:-1]
        # whole groups at a time, as many as make up to WINDOWS_AT_ONCE windows
        n = size - window + 1
        total = np.cumsum(n[order])
        cut, done = [0], 0
        for at in np.r_[np.flatnonzero(change), len(order)]:
            if at > cut[-1] and total[at - 1] - done > WINDOWS_AT_ONCE:
                cut.append(at)
                done = total[at - 1]
        for a, b in zip(cut, [*cut[1:], len(order)]):
            if a < b:
                yield from by_window(order[a:b], n, start, data, ids, number, owner, keys)

    def by_window(at, n, start, data, ids, number, owner, keys) -> Iterator[pa.RecordBatch]:
        n = n[at]
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seg = np.repeat(at, n)
        win = _matrix(data, start[seg] + shift, window)
        order = multikey_quicksort(win)
        change = np.zeros(len(order), bool)
        change[:1] = True
        for k in win:
            s = k[order]
            change[1:] |= s[1:] != s[:-1]
        first = np.flatnonzero(change)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[seg[order]], first), np.diff(np.r_[first, len(order)]))
        tell = np.flatnonzero(least < ids[seg])
        if not len(tell):
            return
        s, f, i = seg[tell], shift[tell], least[tell]
        run = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (f[1:] != f[:-1] + 1) | (i[1:] != i[:-1])])
        last = np.r_[run[1:], len(s)] - 1
        out = np.empty(len(run), ANSWER)
        out["segment"], out["first"], out["last"], out["id"] = number[s[run]], f[run], f[last], i[run]
        yield from B.by_owner(owner[s[run]], keys, 3, out)

    return run


def _dealt(b: np.ndarray, rows) -> list[tuple]:
    """Rows (bucket, ...) from bucket numbers and a function of places."""
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    return [(int(b[s]), *rows(order[s:e])) for s, e in zip(cuts, np.r_[cuts[1:], len(b)] if len(b) else [])]


def duplicate_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``n_bytes``, ``n_removed``, ``spans``
    (array of start, end in bytes of UTF-8, end exclusive) and ``kept`` (binary:
    the bytes that stay).

    A byte goes if a run of ``window`` bytes that covers it also starts in a
    document with a smaller identifier; matches never cross documents. Rows
    repeated with one identifier are one document to this rule; rows without an
    identifier come after all others. A null text is empty, an empty table gives
    no rows, further columns are ignored.
    """
    packed = B.pack(docs, id_col, text_col)
    width = B.exchange_width(packed)
    gram = min(GRAM, window)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            yield B.anchors_out(block.key, Segments(block, window).hash, width)

    shared = B.in_buckets(packed.mapInArrow(ask_anchors, B.ANCHOR_SCHEMA), width, B.shared_among(hot_blocks), B.RESPONSE_SCHEMA)
    shared = B.settled(shared, "shared")
    release(docs.sparkSession)

    def ask_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            g = Segments(block, window)
            g.select(width)
            yield B._batch(DIGEST_SCHEMA, _dealt(B.place(g.u_gram, width), lambda i: (block.key, narrowed(i), g.u_gram[i].astype(GRAM_BITS).tobytes(), g.u_text[i].tobytes(), narrowed(g.u_id[i]))))

    told = B.in_buckets(B.answered(packed, shared).mapInArrow(ask_digests, DIGEST_SCHEMA), width, _compare, B.RESPONSE_SCHEMA)
    told = B.settled(told, "compared")
    release(docs.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            g = Segments(block, window)
            g.select(width)
            found = g.leading(g.mixed())
            some = np.random.default_rng(7).choice(len(found), min(SAMPLE_EACH, len(found)), replace=False) if len(found) else []
            yield B._batch("key binary", [(bytes(found[i]),) for i in some])

    every = max(1, packed.count() // SAMPLE_BLOCKS)
    few = packed.filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0)
    drawn = sorted(r[0] for r in B.answered(few, shared, told).mapInArrow(sample, "key binary").collect())
    splitters = np.array(sorted({bytes(drawn[len(drawn) * i // width]) for i in range(1, width)}) if drawn else [], f"S{gram}")

    def ask_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            g = Segments(block, window)
            g.select(width)
            mixed = g.mixed()

            def row(at: np.ndarray) -> tuple:
                i = mixed[at]
                return block.key, narrowed(i), narrowed(g.u_size[i]), narrowed(g.u_anchor[i] - g.u_start[i]), narrowed(g.u_id[i]), _gather(block.data, g.u_start[i], g.u_size[i]).tobytes()

            yield B._batch(SEGMENT_SCHEMA, _dealt(np.searchsorted(splitters, g.leading(mixed), "right"), row))

    last = B.in_buckets(B.answered(packed, shared, told).mapInArrow(ask_segments, SEGMENT_SCHEMA), width, _sort(window, gram), B.RESPONSE_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            yield _cut(block, window, width)

    last = materialize(last, "sorted")
    release(docs.sparkSession)
    last = B.gathered(last)
    return B.answered(packed, shared, told, last).mapInArrow(cut, "_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def _whole(body: bytes) -> np.ndarray:
    """Answers for all of a segment's windows."""
    number = widened(body)
    out = np.zeros(len(number), ANSWER)
    out["segment"], out["last"], out["id"] = number, ALL, widened(body, 24 + int(np.frombuffer(body, "<i8", 2)[1]) * len(number))
    return out


def _cut(block: B.Block, window: int, width: int) -> pa.RecordBatch:
    g = Segments(block, window)
    g.select(width)
    n_docs, data = len(block.ids), block.data
    offset = np.cumsum(g.u_count) - g.u_count
    least = np.repeat(g.u_id, g.u_count)
    for told in [*(np.frombuffer(b, ANSWER) for b in block.bodies.get(3, [])), *map(_whole, block.bodies.get(5, []))]:
        stop = np.where(told["last"] == ALL, g.u_count[told["segment"]] - 1, told["last"])
        n = stop - told["first"].astype(np.int64) + 1
        at = np.repeat(offset[told["segment"]] + told["first"], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.minimum.at(least, at, np.repeat(told["id"], n))
    n = g.u_count[g.back]
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(g.occ_start, n) + shift
    own = np.repeat(block.ids[g.occ_doc], n) if len(n) else least
    start = start[least[np.repeat(offset[g.back], n) + shift] < own]
    change = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + window, minlength=len(data) + 1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    first = np.r_[0, np.cumsum(block.lens)]
    total = np.r_[0, np.cumsum(gone, dtype=np.int32)]
    removed = total[first[1:]] - total[first[:-1]]
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    inner = np.unique(first[(first > 0) & (first < len(gone))])
    inner = inner[gone[inner - 1] & gone[inner]] if len(inner) else inner
    edge = np.sort(np.concatenate([edge, inner, inner]))  # a span ends with its document
    s, e = edge[::2], edge[1::2]
    doc = np.searchsorted(first, s, "right") - 1
    offsets = np.searchsorted(doc, np.arange(n_docs + 1))
    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array((s - first[doc]).astype(np.int32)), pa.array((e - first[doc]).astype(np.int32))], ["start", "end"]))
    text = data[~gone].tobytes()
    left = first - total[first]
    kept = [text[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
    ids = pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(block.lens, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "spans", "kept"])
