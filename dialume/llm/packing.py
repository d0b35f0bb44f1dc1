"""Packing documents into sequences: dominance reduction, then best fit.

Only the histogram of piece lengths matters to the plan, and it has no more
entries than a sequence has tokens. The driver plans on it: Martello and Toth's
dominance criterion fixes sets that no alternative can beat (a piece and its exact
complement; a piece with the largest partner where no two others fit beside it; a
piece beside which nothing fits), and the rest goes, longest first, where it
leaves the least room. The plan is a short table of (length, ranks) -> places;
pieces find theirs by their rank among pieces of the same length, which is
counted in parts, so that a length that a third of all pieces have is no one
task's.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents_view, materialize, partitions, tidy

LIMIT, END = 1024, 2
#: Parts in which the pieces of a length are ranked; the driver gets a count for each.
MOST_PARTS = 256
#: How a byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# tokens --------------------------------------------------------------------


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself if printable, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids by the tokenizer file, as the tokenizers library gives them. A
    byte-level BPE whose merges are in the order of their ids runs in tiktoken,
    which gives the same ids in a fifth of the time; what it cannot split, the
    library encodes."""
    if path in _encoders:
        return _encoders[path]
    held: list = []

    def library(text: str) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0].encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if plain and [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))):
        import tiktoken

        symbols, special = byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # its regex engine gives up on very long runs of white space
                return library(text)

        _encoders[path] = encode
    else:
        _encoders[path] = library
    return _encoders[path]


def _cut(path: str, limit: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = array("I", encode(text.as_py()))
                tokens.append(end)
                if sys.byteorder == "big":
                    tokens.byteswap()
                raw, at, n = memoryview(tokens).cast("B"), 0, 0
                size = len(tokens) % limit or limit
                while at < len(tokens):
                    ids.append(key)
                    piece.append(n)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at, n, size = at + size, n + 1, limit
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """Every document's tokens and the end token, cut only if longer than
    ``limit``; then the first piece is the short one."""
    view = documents_view(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    return view.mapInArrow(tidy(_cut(tokenizer, limit, end)), "_id long, piece int, start long, length long, ids_crc32 long")


# the plan ------------------------------------------------------------------

Bins = list[tuple[list[tuple[int, int]], int]]


def dominance(counts: np.ndarray, limit: int) -> Bins:
    """Takes from ``counts`` (pieces by length) the sets that provably dominate
    every alternative for their longest piece; [(lengths and how often), bins]."""
    out: Bins = []
    for j in range(limit, 0, -1):
        while counts[j]:
            counts[j] -= 1
            fit = np.flatnonzero(counts[1 : limit - j + 1]) + 1
            counts[j] += 1
            if not len(fit):
                out.append(([(j, 1)], int(counts[j])))
                counts[j] = 0
                break
            k, least = int(fit[-1]), int(fit[0])
            two = 2 * least if counts[least] - (least == j) > 1 else least + int(fit[1]) if len(fit) > 1 else limit + 1
            if j + k != limit and j + two <= limit:
                break  # three pieces fit: left to best fit
            n = int(counts[j] // 2 if j == k else min(counts[j], counts[k]))
            counts[j] -= n
            counts[k] -= n
            out.append(([(j, 2)] if j == k else [(j, 1), (k, 1)], n))
    return out


def best_fit(counts: np.ndarray, limit: int) -> Bins:
    """Best fit of what is left, longest first. Equal pieces go in bulk: after
    one has gone where it leaves the least room, the next goes there too as long
    as it fits."""
    room: dict[int, list[list]] = {}
    for size in range(limit, 0, -1):
        left = int(counts[size])
        counts[size] = 0
        at = size
        while left:
            while at < limit and not room.get(at):
                at += 1
            each = at // size
            if at >= limit:  # new sequences
                at, each, group = limit, limit // size, [[], left // (limit // size) + 1]
            else:
                group = room[at].pop()
            bins = min(group[1], left // each)
            if bins:
                room.setdefault(at - each * size, []).append([group[0] + [(size, each)], bins])
                left -= bins * each
            rest = group[1] - bins
            if rest and left and left < each:
                room.setdefault(at - left * size, []).append([group[0] + [(size, left)], 1])
                left, rest = 0, rest - 1
            if rest and at < limit:
                room[at].append([group[0], rest])
    return [(g, n) for groups in room.values() for g, n in groups if g]


SLOT = np.dtype([("key", "<i8"), ("rank", "<i8"), ("each", "<i8"), ("sequence", "<i8"), ("offset", "<i8")])


def slots(bins: Bins, limit: int) -> np.ndarray:
    """For each length, from which rank on pieces go to which sequences: sorted
    by ``key`` = length << 48 | rank."""
    used, rows, base = np.zeros(limit + 1, np.int64), [], 0
    for group, n in bins:
        offset = 0
        for size, each in group:
            rows.append(((size << 48) | int(used[size]), int(used[size]), each, base, offset))
            used[size] += n * each
            offset += size * each
        base += n
    return np.sort(np.array(rows, SLOT), order="key")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """``_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    Each sequence is filled from offset 0 without gaps. A null text is empty: its
    one piece is the end token. Rows repeated with one identifier, and rows
    without one, are documents of their own. An empty table gives no rows;
    further columns are ignored. Full pieces have sequences of their own, with
    negative numbers.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, limit, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    parts = min(MOST_PARTS, max(16, partitions(spark)))
    short = cut.filter(F.col("length") < limit).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counted = short.groupBy("length", "part").count().collect()  # at most limit x parts rows
    table = np.zeros((limit + 1, parts), np.int64)
    for r in counted:
        table[r["length"], r["part"]] = r["count"]
    counts = table.sum(1)
    before = np.cumsum(table, 1) - table
    places = slots(dominance(counts, limit) + best_fit(counts, limit), limit)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "part", "rank"))
            rank = before[length, part] + rank - 1
            slot = places[np.searchsorted(places["key"], (length << 48) | rank, "right") - 1]
            along = rank - slot["rank"]
            where = [pa.array(slot["sequence"] + along // slot["each"]), pa.array(slot["offset"] + along % slot["each"] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = short.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("row")))
    placed = ranked.select("_id", "piece", "start", "length", "ids_crc32", "part", "rank").mapInArrow(tidy(assign), schema)
    full = cut.filter(F.col("length") == limit).select(*placed.columns[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
