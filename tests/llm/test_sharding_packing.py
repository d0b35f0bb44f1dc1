"""Sharding and packing against brute force and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dialume.llm import packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("limit", [50, 700, 10**6])
def test_shards(spark, limit):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 120)) for i in range(300)] + [(400, "y" * 5000), (401, None), (402, "z" * 90), (402, "é" * 50), (None, "n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, depth int")
    got = sharding.shards(df, limit=limit).collect()
    assert len(got) == len(rows)
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    sizes = {}
    for i, t in rows:
        for d in range(61):
            k = (d, place(i) >> (60 - d))
            b, ids = sizes.setdefault(k, [0, set()])
            sizes[k][0] += len((t or "").encode())
            ids.add(place(i))
    for r in got:
        p = place(r["_id"])
        want = next(d for d in range(61) if sizes[d, p >> (60 - d)][0] <= limit or len(sizes[d, p >> (60 - d)][1]) == 1)
        assert (r["depth"], r["prefix"], r["shard_bytes"]) == (want, p >> (60 - want), sizes[want, p >> (60 - want)][0])
    assert sharding.shards(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_fast_encoder_gives_the_tokenizers_ids(text):
    assert packing.encoder(PATH)(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(PATH)


def test_special_strings():
    for t in ("<|endoftext|>", "a <|endoftext|>b", "  \n\t x y 1234 can't I'LL"):
        assert packing.encoder(PATH)(t) == TOKENIZER.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" * 1_000_000, "\n" * 300_000 + "x", "\t \n" * 100_000 + "y", "1" * 200_000, "中文" * 50_000], ids=len)
def test_very_long_runs(text):
    assert packing.encoder(PATH)(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_run_in_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(path)("Hello there") == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(4)
    limit = 64
    rows = [(i, " ".join(rng.choice(["hello", "world", "é", "xyzzy", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 5, 20, 31, 60, 300])))) for i in range(400)]
    rows += [(500, None), (501, ""), rows[7], (None, "none"), (502, "a" * 9000)] + [(600 + i, "same text here") for i in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(7)
    got = packing.pack(df, PATH, limit=limit).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2])
    seen, room = {}, {}
    for r in got:
        tokens = ids[r["_id"]][0]
        part = tokens[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["_id"], []).append((r["piece"], r["start"], r["length"]))
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, texts in ids.items():
        n = len(texts[0])
        first = n % limit or limit
        want = [(0, 0, first)] + [(k + 1, first + k * limit, limit) for k in range((n - first) // limit)]
        assert sorted(seen[i]) == sorted(want * len(texts))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(length for p in room.values() for _, length in p)
    assert len(room) <= 1.01 * -(-total // limit) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_uses_every_piece_and_never_more_bins_than_best_fit(sizes):
    limit = 20
    counts = np.bincount(sizes, minlength=limit + 1)
    bins = packing.dominance(left := counts.copy(), limit) + packing.best_fit(left, limit)
    used = np.zeros(limit + 1, np.int64)
    for group, n in bins:
        assert n > 0 and sum(s * k for s, k in group) <= limit
        for s, k in group:
            used[s] += k * n
    assert (used == counts).all()
    rooms = []  # plain best fit, longest first
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else limit) - s)
    assert sum(n for _, n in bins) <= len(rooms)
