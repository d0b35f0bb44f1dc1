"""Substring dedup of words by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller identifier. They
are held in blocks (see ``blocks``), each indexed by sampled word k-grams; an
exchange of the samples and one of the 13-word windows around shared samples
give every block, for each of its windows, the smallest document that holds it
and the place there. Each document is then parsed greedily: a factor (source,
place, length) starts at the first window that the reference holds, grows word by
word while the next window follows in the source too, and ends where it does not.
Factors reach at least ``window`` words; every window from a factor's first
boundary to its last was matched by 96 bits of hash, and factors that touch or
overlap become one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .blocks import NO_ID, U
from .common import materialize

#: Words in an indexed k-gram; of window - GRAM + 1 of them one is an anchor.
GRAM = 6
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``n``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out, size = np.ones(1, np.uint64), 1
        while size < n:
            out = np.concatenate([out, out * U(pow(base, size, 1 << 64))])
            size *= 2
        have = _powers[base] = out
    return have


class Words:
    """The words of a block: where they start and end in ``data`` (texts, each
    followed by a line end), their hashes and documents."""

    def __init__(self, block: B.Block):
        n = len(block.ids)
        ends = np.cumsum(block.lens)
        self.data = np.insert(block.data, ends, 0x0A) if n else block.data
        gap = SPACES[self.data]
        edge = np.flatnonzero(np.diff(np.r_[True, gap]))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.r_[0, ends + np.arange(1, n + 1)])  # first word of each document
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(B.BYTE_CODES[self.data] * _power(BASE, len(self.data))[: len(self.data)], out=prefix[1:])
        inverse = _power(BASE_INVERSE, len(self.data))
        self.hash = B.mix((prefix[self.end] - prefix[self.start]) * inverse[self.start])


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside one document, each one's anchor hash, all
    anchors' hashes and documents."""
    gram = min(GRAM, window)
    grams = B.rolling(words.hash, gram, 0xD6E8FEB86659FD93)
    own = B.owners(grams, window - gram + 1)
    at = np.flatnonzero(words.doc[: len(own)] == words.doc[window - 1 : window - 1 + len(own)]) if len(own) else np.zeros(0, np.int64)
    own = own[at]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    anchors = B.mix(grams[own[new]])
    return at, np.repeat(anchors, np.diff(np.r_[new, len(own)])), anchors, words.doc[own[new]]


def _repeated(block: B.Block, words: Words, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows that may repeat, and their keys and checks."""
    at, anchor, anchors, doc = _windows(words, window)
    some, _ = B.flagged(block, anchors, doc, width)
    at = at[B.isin(B.brief(anchor), some)]
    key, check = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(window):
        h = words.hash[at + j]
        key, check = key * U(0xC2B2AE3D27D4EB4F) + h, check * U(0x165667B19E3779F9) + (h ^ (h >> U(29)))
    return at, B.mix(key), B.mix(check).astype(np.uint32)


WINDOW_SCHEMA = "bucket int, block long, keys binary, checks binary, ids binary, places binary"


def duplicate_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``n_words``, ``n_removed``, ``spans``
    (array of start, end in words, end exclusive) and ``kept`` (the words that
    stay, joined by one space) and ``factors`` (array of start, end, source, at: the
    words from start to end stand in document ``source`` from word ``at`` on).

    A word goes if a run of ``window`` words that covers it also starts in a
    document with a smaller identifier. Words are runs of other characters than
    space and U+0009 to U+000D. Rows repeated with one identifier are one
    document to this rule (neither is smaller); rows without an identifier come
    after all others. Null and empty texts have no words, an empty table gives
    no rows, further columns are ignored.
    """
    packed = B.pack(docs, id_col, text_col)
    width = B.exchange_width(packed)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            yield B.anchors_out(block.key, _windows(Words(block), window)[2], width)

    hot = 1 << 62  # windows are dealt by their own content, so no anchor needs splitting
    shared = B.in_buckets(packed.mapInArrow(ask_anchors, B.ANCHOR_SCHEMA), width, B.shared_among(hot), B.RESPONSE_SCHEMA)
    shared = B.settled(shared, "shared")

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            words = Words(block)
            at, key, check = _repeated(block, words, window, width)
            first, _ = _distinct(key, check)  # the first has the smallest identifier
            at, key, check = at[first], key[first], check[first]
            doc = words.doc[at]
            ids, places = block.ids[doc], (at - words.first[doc]).astype("<u4")
            b = B.place(key, width)
            order = np.argsort(b, kind="stable")
            b = b[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
            ends = np.r_[cuts[1:], len(b)] if len(b) else []
            rows = [(int(b[s]), block.key, *[x[order[s:e]].tobytes() for x in (key, check, ids, places)]) for s, e in zip(cuts, ends)]
            yield B._batch(WINDOW_SCHEMA, rows)

    sources = B.in_buckets(B.answered(packed, shared).mapInArrow(ask_windows, WINDOW_SCHEMA), width, _sources, B.RESPONSE_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.unpack(batches):
            yield _parse(block, window, width)

    found = B.gathered(materialize(sources, "sources"))
    return B.answered(packed, shared, found).mapInArrow(parse, RESULT_SCHEMA)


RESULT_SCHEMA = "_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string, factors array<struct<start:int,end:int,source:long,at:int>>"
SOURCE = np.dtype([("key", "<u8"), ("check", "<u4"), ("at", "<u4"), ("id", "<i8")])


def _distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct window (key and check) stands first, in order of both,
    and the number of every window among them."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _find(key: np.ndarray, check: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The place of each (key, check) in the sorted ``keys, checks``, which hold them all."""
    at = np.searchsorted(keys, key)
    while (wrong := np.flatnonzero(checks[at] != check)).size:
        at[wrong] += 1
    return at


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells each block the smallest identifier that holds a window and where in
    that document it stands, if that is smaller than its own (kind 2)."""
    keys, parts = [], []
    for batch in batches:
        for block, *columns in zip(*(batch.column(j) for j in range(1, 6))):
            parts.append([np.frombuffer(x.as_py(), t) for x, t in zip(columns, ("<u8", "<u4", "<i8", "<u4"))])
            keys.append(block.as_py())
    if not parts:
        return
    key, check, ids, places = (np.concatenate([p[j] for p in parts]) for j in range(4))
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(p[0]) for p in parts])
    del parts
    order = np.lexsort((places, ids, check, key))
    k, c = key[order], check[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    source = np.repeat(order[first], np.diff(np.r_[first, len(k)]))  # the smallest identifier's
    tell = ids[source] < ids[order]
    at, source = order[tell], source[tell]
    out = np.empty(len(at), SOURCE)
    out["key"], out["check"], out["at"], out["id"] = key[at], check[at], places[source], ids[source]
    yield from B.by_owner(owner[at], keys, 2, out)


def _factors(held: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse. ``held`` are the window starts that the reference holds,
    each in document ``source`` at word ``place``: a factor begins at the first of
    them, grows word by word while the next window follows in its source too, and
    ends where it does not; there the next one begins. (first word, end, number of
    the first window) of each."""
    if not len(held):
        return held, held, held
    follows = (np.diff(held) == 1) & (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    cut = np.flatnonzero(~follows)
    first, last = np.r_[0, cut + 1], np.r_[cut, len(held) - 1]
    return held[first], held[last] + window, first


def _parse(block: B.Block, window: int, width: int) -> pa.RecordBatch:
    words = Words(block)
    at, key, check = _repeated(block, words, window, width)
    n_docs, doc = len(block.ids), words.doc[at]
    inside = words.first[:-1]
    # the block's own index: where each distinct window stands first
    first, back = _distinct(key, check)
    source, place = block.ids[doc[first]], at[first] - inside[doc[first]]
    told = np.concatenate([np.frombuffer(b, SOURCE) for b in block.bodies.get(2, [])] or [np.zeros(0, SOURCE)])
    if len(told):
        where = _find(told["key"], told["check"], key[first], check[first])
        better = told["id"] < source[where]
        source[where[better]], place[where[better]] = told["id"][better], told["at"][better]
    source, place = source[back], place[back]
    smaller = source < block.ids[doc]
    held, source, place = at[smaller], source[smaller], place[smaller]
    start, end, opens = _factors(held, source, place, doc[smaller], window)
    change = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    covered = np.cumsum(change[:-1]) > 0
    total = np.diff(words.first)
    gone = np.r_[0, np.cumsum(covered)]
    removed = gone[words.first[1:]] - gone[words.first[:-1]]
    # spans
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    if len(edge):  # a span ends with its document
        bounds = inside[(inside > 0) & (inside < len(covered))]
        bounds = np.unique(bounds[covered[bounds - 1] & covered[bounds]]) if len(bounds) else bounds
        edge = np.sort(np.concatenate([edge, bounds, bounds]))
    s, e = edge[::2], edge[1::2]
    spans = _listed(words, s, [s, e], [], ["start", "end"])
    factors = _listed(words, start, [start, end], [pa.array(source[opens]), pa.array(place[opens].astype(np.int32))], ["start", "end", "source", "at"])
    # kept words, each with one space after it
    data = words.data.copy()
    data[words.end] = 0x20
    keep = ~covered
    change = np.zeros(len(data) + 2, np.int8)
    change[words.start[keep]] += 1
    change[words.end[keep] + 1] -= 1
    text = data[np.cumsum(change[: len(data)], dtype=np.int8) > 0].tobytes()
    size = np.r_[0, np.cumsum(np.where(keep, words.end - words.start + 1, 0))]
    left, right = size[words.first[:-1]], size[words.first[1:]]
    kept = [text[a : max(a, b - 1)] for a, b in zip(left.tolist(), right.tolist())]
    ids = pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary()).cast(pa.string()), factors], names=["_id", "n_words", "n_removed", "spans", "kept", "factors"])


def _listed(words: Words, start: np.ndarray, places: list[np.ndarray], more: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Ranges of a block's words as one list a document, counted from its first word."""
    doc = words.doc[start] if len(start) else np.zeros(0, np.int64)
    offsets = np.searchsorted(doc, np.arange(len(words.first)))
    inner = [pa.array((p - words.first[doc]).astype(np.int32)) for p in places]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*inner, *more], names))
