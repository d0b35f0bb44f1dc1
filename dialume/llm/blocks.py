"""Reference blocks: documents packed into rows of a few MB, and the index over them.

Substring dedup needs to know which windows of a document start in a document
with a smaller identifier. Both operators that do this work on *blocks*: each
row holds the documents of one stretch of the input, compressed, sorted by
identifier. A block answers for itself; what it tells other blocks it tells once
per distinct content, so a passage that a third of all documents share costs one
entry a block, not one a document.

The index samples positions by *minimisers*: of every ``w`` consecutive k-grams
the one with the smallest hash is an anchor. Every window of ``k + w - 1``
symbols has exactly one anchor of its own, and equal windows have equal anchors.
A window can only repeat if its anchor's k-gram occurs in two documents.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, new_path, partitions, small_batches

#: Bytes of text in a block, unless a single document has more: this many times
#: the root of the whole input's bytes, within these bounds. So there are never
#: very many blocks to hold one passage, and rows stay small in small inputs.
BLOCK_ROOTS, LEAST_BLOCK, MOST_BLOCK = 8, 1 << 20, 1 << 24
#: Bytes of text for which the exchanges get a bucket, and the most partitions that
#: hold the buckets: beyond that a partition has several, one after another.
BYTES_PER_BUCKET, MOST_PARTITIONS = 16 << 20, 1 << 16
#: Stands for a missing identifier: later than all others.
NO_ID = np.iinfo(np.int64).max
CODEC = "zstd"
U = np.uint64

BLOCK_SCHEMA = "block long, n_bytes long, ids binary, lens binary, data binary"
RESPONSE_SCHEMA = "block long, kind int, body binary"


@dataclass
class Block:
    key: int
    ids: np.ndarray
    lens: np.ndarray
    data: np.ndarray
    bodies: dict[int, list[bytes]]


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal seq, ids, texts, size
        order = sorted(range(len(ids)), key=ids.__getitem__)
        raw = b"".join(texts[i] for i in order)
        row = ((part << 32) + seq, len(raw), np.array([ids[i] for i in order], "<i8").tobytes(), np.array([len(texts[i]) for i in order], "<i8").tobytes(), pa.compress(raw, CODEC, asbytes=True))
        seq, ids, texts, size = seq + 1, [], [], 0
        return _batch(BLOCK_SCHEMA, [row])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for key, text in zip(keys, batch.column(1).cast(pa.binary())):
            text = text.as_py()
            if texts and size + len(text) > most:
                yield block()
            ids.append(NO_ID if key is None else key)
            texts.append(text)
            size += len(text) + 8
    if texts:
        yield block()


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The blocks, written to the shared folder, so that their numbers hold for
    good. The table is bucketed by block as the exchanges are partitioned: joined
    with answers, the texts stay where they are."""
    spark = docs.sparkSession
    view = documents_view(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    total = view.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    most = int(min(MOST_BLOCK, max(LEAST_BLOCK, BLOCK_ROOTS * total**0.5)))
    return by_block(view.mapInArrow(lambda batches: _pack(batches, most), BLOCK_SCHEMA), "blocks")


def by_block(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of blocks: tables written so
    are joined where they lie. The catalog's entry goes when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, what)
    name = f"dialume_{what}_" + path.rpartition("-")[2]
    with small_batches(spark):
        df.write.option("path", path).option("compression", "uncompressed").bucketBy(partitions(spark), "block").sortBy("block").saveAsTable(name)

    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(forget)
    return spark.table(name)


def exchange_width(blocks: DataFrame) -> int:
    """The number of buckets; each is held in memory by itself."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(partitions(blocks.sparkSession), int(total // BYTES_PER_BUCKET) + 1)


Batches = Iterator[pa.RecordBatch]


def in_buckets(rows: DataFrame, width: int, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``run`` over the rows of each of the ``width`` buckets (column ``bucket``, the
    first). With more buckets than ``MOST_PARTITIONS``, partitions are sorted by
    bucket and worked off bucket by bucket."""
    parts = min(width, MOST_PARTITIONS)
    if parts == width:
        dealt = rows.repartitionById(width, "bucket")
    else:
        dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")

    def over(batches: Batches) -> Batches:
        for _, group in groupby(_by_bucket(batches), key=lambda x: x[0]):
            yield from run(part for _, part in group)

    return dealt.mapInArrow(over, schema)


def _by_bucket(batches: Batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        b = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for s, e in zip(cuts, [*cuts[1:], len(b)]):
            yield int(b[s]), batch.slice(s, e - s)


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(names)}
            bodies: dict[int, list[bytes]] = {}
            if "answers" in row and row["answers"].is_valid:
                for x in row["answers"].as_py():
                    bodies.setdefault(x["kind"], []).append(x["body"])
            raw = pa.decompress(row["data"].as_py(), row["n_bytes"].as_py(), CODEC, asbytes=True)
            yield Block(row["block"].as_py(), np.frombuffer(row["ids"].as_py(), "<i8"), np.frombuffer(row["lens"].as_py(), "<i8"), np.frombuffer(raw, np.uint8), bodies)


def gathered(answers: DataFrame) -> DataFrame:
    """What the exchanges found out for each block, as one row; each gets at most
    as many entries as it asked."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("kind", "body")).alias("answers"))


def settled(answers: DataFrame, what: str) -> DataFrame:
    """``gathered`` answers, exchanged once and kept in buckets of blocks."""
    return by_block(gathered(answers), what)


def answered(blocks: DataFrame, *found: DataFrame) -> DataFrame:
    """Blocks with all their answers."""
    none = F.array().cast("array<struct<kind:int,body:binary>>")
    for i, rows in enumerate(found):
        blocks = blocks.join(rows.withColumnRenamed("answers", f"answers{i}"), "block", "left")
    names = [f"answers{i}" for i in range(len(found))]
    return blocks.withColumn("answers", F.concat(*[F.coalesce(n, none) for n in names])).drop(*names)


# hashing and sampling ------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: One random odd number per byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def rolling(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` codes, by doubling: the hashes of
    runs of 1, 2, 4 .. codes, of which those that make up ``n`` are joined. The
    upper bits are as random as the codes'; ``mix`` spreads them to all."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    level, width, out, done = codes, 1, None, 0
    while True:
        if n & width:
            part = level[done : done + size]
            out = part if out is None else out * U(pow(base, width, 1 << 64)) + part
            done += width
        if done == n:
            return out
        level = level[:-width] * U(pow(base, width, 1 << 64)) + level[width:]
        width *= 2


LOW = U((1 << 24) - 1)


def owners(grams: np.ndarray, w: int, chunk: int = 1 << 15) -> np.ndarray:
    """For every run of ``w`` hashes the place of the smallest (of its upper 40
    bits; the first of equals)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, chunk):
        part = grams[at : min(at + chunk + w - 1, len(grams))] & ~LOW
        part |= np.arange(len(part), dtype=np.uint64)
        level, width = part, 1
        while width * 2 <= w:
            level, width = np.minimum(level[:-width], level[width:]), width * 2
        size = len(part) - w + 1
        out[at : at + size] = np.minimum(level[:size], level[w - width : w - width + size]) & LOW
        out[at : at + size] += at
    return out


def anchor_runs(codes: np.ndarray, gram: int, w: int, base: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor, in stretches that stay in the CPU's
    cache: the first window of each run, the anchor's place and its hash."""
    n = len(codes) - gram - w + 2
    starts, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    before = -1
    for at in range(0, max(n, 0), chunk):
        grams = rolling(codes[at : at + chunk + w + gram - 2], gram, base)
        own = owners(grams, w, len(grams))
        new = np.flatnonzero(own[1:] != own[:-1]) + 1
        if own[0] + at != before:
            new = np.r_[0, new]
        starts.append(new + at)
        places.append(own[new] + at)
        hashes.append(mix(grams[own[new]]))
        before = own[-1] + at
    return np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)


def place(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys ^ U(0x5851F42D4C957F2D)) >> U(33)) % U(buckets)).astype(np.int64)


def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def shared_here(anchors: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sorted hashes that occur in documents of two identifiers of this block."""
    order = np.argsort(anchors, kind="stable")
    h, d = anchors[order], ids[doc[order]]
    if not len(h):
        return h
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first][np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)]


# first exchange: anchors that more than one block holds --------------------

ANCHOR_SCHEMA = "bucket int, block long, body binary"
#: Bits of an anchor's hash that the exchange carries. The bucket, from all 64,
#: adds its own, more of them the larger the input; a rare chance match only
#: costs a closer look.
SENT = 40


def brief(h: np.ndarray) -> np.ndarray:
    return h & U((1 << SENT) - 1)


def _bytes(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT // 8]


def _from_bytes(body: bytes) -> np.ndarray:
    part = np.frombuffer(body, np.uint8).reshape(-1, SENT // 8)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : SENT // 8] = part
    return out.view("<u8")[:, 0]


def anchors_out(key: int, anchors: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The block's distinct anchor hashes, dealt to buckets."""
    h = np.unique(anchors)
    b = place(h, buckets)
    order = np.argsort(b, kind="stable")
    b, h = b[order], h[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(b)] if len(b) else cuts
    return _batch(ANCHOR_SCHEMA, [(int(b[s]), key, _bytes(h[s:e]).tobytes()) for s, e in zip(cuts, ends)])


def shared_among(hot_blocks: int):
    """Tells each block which of its hashes other blocks hold: kind 0, or, if more
    than ``hot_blocks`` do, kind -1 less the number of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, bodies, bucket = [], [], [], None
        for batch in batches:
            keys += batch.column(1).to_pylist()
            bucket = batch.column(0)[0].as_py() if batch.num_rows else bucket
            for x in batch.column(2):
                body = _from_bytes(x.as_py())
                bodies.append(body)
                sizes.append(len(body))
        if not bodies:
            return
        h, owner = np.concatenate(bodies), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        del bodies
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        counts = np.diff(np.r_[first, len(s)])
        n = np.repeat(counts, counts)
        # ``in_buckets`` hands over one bucket
        for kind, held in ((0, (n > 1) & (n <= hot_blocks)), (-1 - bucket, n > hot_blocks)):
            at = order[held]
            yield from by_owner(owner[at], keys, kind, _bytes(h[at]))

    return run


def by_owner(owner: np.ndarray, keys: list[int], kind: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Answers (block, kind, body), one row for each asker."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    rows = [(keys[owner[s]], kind, values[s:e].tobytes()) for s, e in zip(cuts, np.r_[cuts[1:], len(owner)] if len(owner) else [])]
    for i in range(0, len(rows), 1000):
        yield _batch(RESPONSE_SCHEMA, rows[i : i + 1000])


def flagged(block: Block, anchors: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted brief hashes that repeat across documents, and which of ``anchors``
    are hot. Hot ones are told apart by bucket and brief hash, as their blocks were
    counted; a chance match among the others only costs a closer look."""
    found = [brief(shared_here(anchors, doc, block.ids)), *[_from_bytes(b) for b in block.bodies.get(0, [])]]
    is_hot = np.zeros(len(anchors), bool)
    told = [(-1 - kind, _from_bytes(b)) for kind, bodies in block.bodies.items() if kind < 0 for b in bodies]
    if told:
        bucket = place(anchors, width)
        for b, hashes in told:
            mine = np.flatnonzero(bucket == b)
            is_hot[mine] |= isin(brief(anchors[mine]), np.unique(hashes))
            found.append(hashes)
    return np.unique(np.concatenate(found)), is_hot
