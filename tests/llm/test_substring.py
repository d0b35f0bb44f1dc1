"""Substring dedup against brute force."""

import random
import re
import time

import numpy as np
import pytest

from dialume.llm import blocks, rlz, suffix

SCHEMA = "doc_id long, text string, ids string, block long, data binary"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 3, None) for i, t in rows], SCHEMA).repartition(parts)


def brute(rows, symbols, window):
    """(id, removed flags) per row."""
    where = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        s = symbols(t)
        for a in range(len(s) - window + 1):
            k = tuple(s[a : a + window])
            where[k] = min(where.get(k, float("inf")), order(i))
    for i, t in rows:
        s = symbols(t)
        gone = [False] * len(s)
        for a in range(len(s) - window + 1):
            if where[tuple(s[a : a + window])] < order(i):
                gone[a : a + window] = [True] * window
        yield i, s, gone


def runs(gone):
    edge = np.flatnonzero(np.diff(np.r_[False, np.array(gone, bool), False]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def corpus(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    words = ["é" * rng.randint(1, 3) + "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    prose = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "  "]) for _ in range(k))
    passages = [prose(rng.randint(5, 60)) for _ in range(6)]
    line = "the common line here "
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            rows.append((i, rng.choice(rows)[1]))
        elif kind < 0.5:
            rows.append((i, prose(rng.randint(0, 30)) + rng.choice(passages) + line + prose(rng.randint(0, 30)) + rng.choice(passages)))
        elif kind < 0.6 and rows:
            old = (rng.choice(rows)[1] or "").split(" ")
            old[rng.randrange(len(old))] = "changed"
            rows.append((i, " ".join(old)))
        else:
            rows.append((i, line * rng.randint(0, 3) + prose(rng.randint(0, 80))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "x"), (None, rows[3][1]), rows[5], (n + 4, "ab " * 4000), (n + 5, "z" * 20000), (n + 6, "z" * 120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 1 << 20), (2, 3000)])
def test_duplicate_words(spark, monkeypatch, seed, size):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", size)
    monkeypatch.setattr(blocks, "BLOCK_ROOTS", 1)
    rows = corpus(seed)
    got = sorted((r["_id"] if r["_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept"], [tuple(s) for s in r["spans"]]) for r in rlz.duplicate_words(table(spark, rows)).collect())
    want = []
    for i, s, gone in brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), 13):
        want.append((-1 if i is None else i, len(s), sum(gone), " ".join(w for w, g in zip(s, gone) if not g), runs(gone)))
    assert got == sorted(want)


@pytest.mark.parametrize("seed,size,hot", [(3, 1 << 20, 256), (4, 3000, 256), (5, 3000, 3)])
def test_duplicate_bytes(spark, monkeypatch, seed, size, hot):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", size)
    monkeypatch.setattr(blocks, "BLOCK_ROOTS", 1)
    rows = corpus(seed)
    got = sorted((r["_id"] if r["_id"] is not None else -1, r["n_bytes"], r["n_removed"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in suffix.duplicate_bytes(table(spark, rows), hot_blocks=hot).collect())
    want = []
    for i, s, gone in brute(rows, lambda t: (t or "").encode(), 50):
        want.append((-1 if i is None else i, len(s), sum(gone), bytes(c for c, g in zip(s, gone) if not g), runs(gone)))
    assert got == sorted(want)


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_factors_stand_in_their_sources(spark, monkeypatch, size):
    """Every factor's words are its source's, it cannot grow, and factors make up the spans."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", size)
    monkeypatch.setattr(blocks, "BLOCK_ROOTS", 1)
    rows = [r for r in corpus(6) if r[0] is not None]
    rows = list(dict(rows).items())
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    n = 0
    for r in rlz.duplicate_words(table(spark, rows)).collect():
        own, covered = words[r["_id"]], np.zeros(len(words[r["_id"]]) + 1, bool)
        for f in r["factors"]:
            size_, source = f["end"] - f["start"], words[f["source"]]
            assert size_ >= 13 and f["source"] < r["_id"]
            assert own[f["start"] : f["end"]] == source[f["at"] : f["at"] + size_]
            covered[f["start"] : f["end"]] = True
            n += 1
        assert runs(covered[:-1]) == [tuple(s) for s in r["spans"]]
        assert [f["start"] for f in r["factors"]] == sorted({f["start"] for f in r["factors"]})
    assert n > 50


def test_windows_of_equal_keys_are_told_apart_by_their_checks():
    key, check = np.array([5, 3, 5, 5, 3], np.uint64), np.array([2, 7, 1, 2, 7], np.uint32)
    first, number = rlz._distinct(key, check)
    assert first.tolist() == [1, 2, 0] and number.tolist() == [2, 0, 1, 2, 0]
    assert rlz._find(key, check, key[first], check[first]).tolist() == number.tolist()


def test_partitions_of_several_buckets(spark, monkeypatch):
    """More buckets than partitions: each bucket is still worked off by itself."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 2000)
    monkeypatch.setattr(blocks, "MOST_BLOCK", 2000)
    monkeypatch.setattr(blocks, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(blocks, "BYTES_PER_BUCKET", 1500)
    rows = corpus(11)
    assert blocks.exchange_width(blocks.pack(table(spark, rows), "doc_id", "text")) > 30
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = sorted((str(i), runs(gone)) for i, _, gone in brute(rows, words, 13))
    found = rlz.duplicate_words(table(spark, rows)).collect()
    assert sorted((str(r["_id"]), [tuple(s) for s in r["spans"]]) for r in found) == want
    want = sorted((str(i), runs(gone)) for i, _, gone in brute(rows, lambda t: (t or "").encode(), 50))
    found = suffix.duplicate_bytes(table(spark, rows), hot_blocks=4).collect()
    assert sorted((str(r["_id"]), [tuple(s) for s in r["spans"]]) for r in found) == want


def test_empty_tables(spark):
    assert rlz.duplicate_words(table(spark, [])).count() == 0
    assert suffix.duplicate_bytes(table(spark, [])).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 9000).astype(np.uint64) for _ in range(4)]
    order = suffix.multikey_quicksort(keys, small=16)
    rows = np.stack([k[order] for k in keys], 1).tolist()
    assert rows == sorted(np.stack(keys, 1).tolist())


def test_owner_is_the_first_smallest():
    rng = np.random.default_rng(1)
    grams = blocks.mix(rng.integers(0, 50, 5000).astype(np.uint64))
    for w in (1, 2, 8, 35):
        top = grams >> np.uint64(24)
        want = [i + int(np.argmin(top[i : i + w])) for i in range(len(grams) - w + 1)]
        assert blocks.owners(grams, w, chunk=700).tolist() == want


def test_anchor_runs():
    rng = np.random.default_rng(1)
    codes = blocks.mix(rng.integers(0, 3, 5000).astype(np.uint64))
    own = blocks.owners(blocks.rolling(codes, 4, 7), 9)
    start, place, _ = blocks.anchor_runs(codes, 4, 9, 7, chunk=300)
    assert np.array_equal(np.repeat(place, np.diff(np.r_[start, len(own)])), own)
    assert (place[1:] != place[:-1]).all()


@pytest.mark.parametrize("values", [[5], [0, 255], [7, 263, 7], [-3, 2**40], [blocks.NO_ID, -(2**63), 0], list(range(1000, 1250))])
def test_narrowed_numbers(values):
    body = suffix.narrowed(np.array(values, np.int64))
    assert suffix.widened(body).tolist() == values
    assert suffix.widened(b"x" * 24 + body, 24).tolist() == values
    assert max(values) - min(values) > 255 or len(body) == 24 + len(values)


def test_finished_exchanges_leave_the_disk(spark):
    """When the last pass is due, of the exchanges before at most the latest is left."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {files.apply(i).getName().split("_")[1] for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    rng = random.Random(3)
    passages = ["".join(rng.choices("abcdef ", k=120)) for _ in range(20)]
    rows = [(i, "".join(rng.choices("abcdef ", k=80)) + rng.choice(passages) + str(i)) for i in range(400)]
    before = shuffles()
    found = suffix.duplicate_bytes(table(spark, rows))
    until = time.time() + 20
    while len(left := shuffles() - before) > 1 and time.time() < until:
        time.sleep(0.5)
    assert len(left) <= 1
    assert found.count() == 400
