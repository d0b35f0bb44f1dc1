"""Decontamination against brute force."""

import random
import re

import pytest

from dialume.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for key, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(key)
    sizes = {len(w) for w in windows}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                if k in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        yield i, len(w), len(hit), sorted(str(x) for x in found if x is not None)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "É", "é", "GAMMA", "d3lta", "x", "İ", "ß", "😀y"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(rng.choice([9, 14, 30]))) for k in range(12)]
    items += [(k + 20, text(n)) for k, n in enumerate([1, 3, 5, 7, 8])]
    items += [(40, None), (41, "  "), (2, text(12)), (None, text(10)), (60, items[0][1])]
    docs = []
    for i in range(150):
        t = text(rng.choice([0, 2, 7, 8, 40]))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(w))
            t += " ".join(w[a : a + rng.randint(4, 20)]).upper() + " " + text(rng.randint(0, 5))
        docs.append((i, t))
    docs += [(200, None), (201, ""), docs[3], (202, items[0][1] * 300), (203, text(8000))]
    return docs, items


@pytest.mark.parametrize("seed,small", [(1, True), (2, False)])
def test_contamination(spark, monkeypatch, seed, small):
    if not small:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs, items = cases(seed)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, w string, h5 int").repartition(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    got = sorted((r["_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(d, b).collect())
    assert got == sorted(brute(docs, items))
    assert sum(bool(r[2]) for r in got) > 30


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c"), (None, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontam.contamination(d, b.limit(0)).orderBy("_id").collect()] == [(2, 0), (3, 0)]
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert [(r["n_words"], r["n_hit"]) for r in decontam.contamination(d, b).orderBy("_id").collect()] == [(2, 2), (3, 2)]


def test_rows_of_one_identifier_are_judged_apart(spark):
    nine = "a b c d e f g h i"
    rows = [(1, nine), (1, "zz"), (None, nine), (None, "zz"), (2, nine + " " + nine)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([("x", nine)], "item_id string, text string")
    got = sorted((str(r["_id"]), r["n_words"], r["n_hit"]) for r in decontam.contamination(d, b).collect())
    assert got == [("1", 1, 0), ("1", 9, 9), ("2", 18, 18), ("None", 1, 0), ("None", 9, 9)]
