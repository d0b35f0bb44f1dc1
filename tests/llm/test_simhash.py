"""SimHash, its index and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dialume.llm import components, simhash

U = np.uint64


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(pairs):
    """{id: fingerprint} -> {id: smallest linked id}."""
    ids = sorted(pairs)
    root = {}
    for i in ids:
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and (pairs[a] ^ pairs[b]).bit_count() <= 2:
                    root[b] = i
                    todo.append(b)
    return root


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = ["a", "B", "É", "é", "the", "The", "x" * 40, "o'f", "😀", "10"]
    texts = [None, "", " \n\t", "one", "Two words", "ÀB  c\x0bd"]
    for _ in range(60):
        texts.append(rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(1, 900))))
    for t in texts[10:40]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    texts += ["one"] * 50
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, _fp long, key string")
    got = {r["_id"]: r for r in simhash.near_duplicates(df).collect()}
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r["_fp"] % 2**64 for i, r in got.items()} == want
    assert {i: r["_root"] for i, r in got.items()} == brute_roots(want)
    assert len({r["_root"] for r in got.values()}) < len(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_identifier_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "p q"), (9, "zz")], "doc_id long, text string")
    got = sorted(((r["_id"] is None, r["_id"], r["_root"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, None, 4), (True, None, None)], key=str)


def clustered(seed, n):
    """Fingerprints of which many lie close together."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    out = rng.integers(0, 2**63, n, dtype=np.uint64)
    for i in range(n // 2):
        x = centres[i % 8]
        for b in rng.integers(0, 40, rng.integers(0, 9)):
            x ^= U(1) << U(b)
        out[i] = x
    return np.unique(out)


def test_close_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "LAID_OUT", 1 << 20)
    fps = clustered(1, 3000)
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if i < j}
    got = [tuple(sorted(p)) for a, b in simhash.close_pairs(fps) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_linked_with_large_buckets(spark, monkeypatch):
    """Buckets over the limit are dealt again, and no link is lost."""
    import dialume.llm.simhash as m

    fps = clustered(2, 1500)
    df = spark.createDataFrame([(int(f) - (1 << 64) if int(f) >> 63 else int(f), i) for i, f in enumerate(fps.tolist())], "_fp long, _rep long")
    want = brute_roots(dict(enumerate(fps.tolist())))
    for limit in (2048, 20):
        monkeypatch.setattr(m, "LARGE", limit)
        edges = m.linked(df).selectExpr("a u", "b v")
        got = {i: i for i in want} | {r["node"]: r["root"] for r in components.components(edges).collect()}
        assert got == want


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, 1000 + i) for i in range(1, 500)]
    nodes = list(range(5000, 5300))
    rng.shuffle(nodes)
    shuffled = list(zip(nodes, nodes[1:]))
    df = spark.createDataFrame(chain + hub + shuffled + hub[:5] + [(7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = {i: 1 for i in range(2, 201)} | {1000 + i: 1000 for i in range(1, 500)} | {i: 5000 for i in range(5001, 5300)}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


# similarity ------------------------------------------------------------------


def near_copies(seed):
    """Texts, their copies with some words replaced, and a passage that many share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared, texts = prose(60), [None, "", "  ", "one", "One", "one two"]
    for _ in range(40):
        t = prose(rng.choice([8, 40, 100, 400]))
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 4)):
            c = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [" ".join(shared + prose(40)) for _ in range(60)]
    return list(enumerate(texts))


def shingles(text, n=5):
    return np.unique(simhash.shingle_hashes((text or "").encode(), n))


def brute_wide(hashes):
    """Bit by bit, from the definition."""
    out = []
    for lane in simhash.LANES.tolist():
        word, hs = 0, [int(simhash.mix(np.array([h * lane % 2**64], np.uint64))[0]) for h in hashes.tolist()]
        for b in range(64):
            word |= (2 * sum(h >> b & 1 for h in hs) > len(hs)) << b
        out.append(word)
    return out


def brute_similar(rows, bits):
    fps = {i: simhash.wide_fingerprint(shingles(t)) for i, t in rows}
    root, ids = {}, sorted(fps)
    for i in ids:
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= bits:
                    root[b] = i
                    todo.append(b)
    return root


def test_similar_documents(spark, monkeypatch):
    rows = near_copies(4)
    bits = simhash.radius(0.8)
    assert 70 < bits < 85 and simhash.radius(1.0) == 0
    for i, t in rows[4:12]:
        assert simhash.wide_fingerprint(shingles(t)).tolist() == brute_wide(shingles(t))
    want = brute_similar(rows, bits)
    assert len(set(want.values())) < len(rows) - 30
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, _fp long, key string").repartition(4)
    for crowded in (4096, 8):  # the second: buckets are dealt again, twice
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        assert {r["_id"]: r["_root"] for r in simhash.similar_documents(df).collect()} == want
    assert simhash.similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, 500])
def test_crowded_bucket_loses_no_link(spark, monkeypatch, crowd):
    """Rows that share one sampled shingle and nothing else that is sampled: chains
    of five far from each other, and, the second time, a crowd of near copies."""
    rng = np.random.default_rng(crowd)
    flip = lambda f, n: f ^ np.packbits(np.isin(np.arange(512), rng.choice(512, n, False)), bitorder="little").view("<u8")
    fps = [rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64)]
    for i in range(299):
        fps.append(flip(fps[-1], 70) if i % 5 < 4 else rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64))
    centre = rng.integers(0, 2**64, simhash.WORDS, dtype=np.uint64)
    fps += [flip(centre, 30) for _ in range(crowd)]
    fps = np.array(fps)[rng.permutation(300 + crowd)]
    want = simhash.forest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= 77))
    assert len(set(want.tolist())) == 60 + (crowd > 0)
    monkeypatch.setattr(simhash, "CROWDED", 8)
    rows = spark.createDataFrame([(7, i, f.tobytes()) for i, f in enumerate(fps)] + [(8, 1, fps[1].tobytes())], "key long, rep long, fp binary").repartition(3)
    links = simhash.bucket_links(rows, 77)
    roots = {r["node"]: r["root"] for r in components.components(links.selectExpr("a u", "b v")).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == want.tolist()


def test_similar_documents_without_identifier_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(200))
    rows = [(None, t), (4, t), (4, t + " more"), (None, "p q"), (9, "zz"), (9, "yy"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["_id"]), str(r["_root"])) for r in simhash.similar_documents(df).collect())
    assert got == sorted([("None", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("9", "9"), ("9", "9"), ("3", "3")])


def test_recall_against_jaccard():
    """Of pairs of that Jaccard similarity the share whose fingerprints link."""
    rng = np.random.default_rng(5)
    bits, caught = simhash.radius(0.8), {}
    for j in (0.5, 0.7, 0.85, 0.9, 0.95):
        n = 300
        both = round(2 * n * j / (1 + j))
        hit = 0
        for _ in range(200):
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = simhash.wide_fingerprint(x[:n]), simhash.wide_fingerprint(x[n - both :])
            hit += int(np.bitwise_count(a ^ b).sum()) <= bits
        caught[j] = hit / 200
    assert caught[0.9] > 0.98 and caught[0.95] == 1 and caught[0.85] > 0.8 and caught[0.7] < 0.1 and caught[0.5] == 0, caught


@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(0, 90))
@settings(max_examples=30, deadline=None)
def test_forest_with_pivots_is_the_plain_one(seed, n, spread):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, simhash.WORDS, dtype=np.uint64)
    fps = np.tile(centre, (n, 1))
    for f in fps:
        if rng.random() < 0.3:
            f[:] = rng.integers(0, 2**63, simhash.WORDS, dtype=np.uint64)
        for b in rng.integers(0, 512, rng.integers(0, spread + 1)):
            f[b // 64] ^= U(1) << U(b % 64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= 40
    want = simhash.forest(n, *np.nonzero(near))
    assert (simhash.similar_forest(fps, 40) == want).all()
