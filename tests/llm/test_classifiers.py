"""The two classifiers: their parts against brute force, and held-out accuracy."""

import math
import random

import numpy as np

from dialume.llm import quality, toxicity, training


def all_maximal(scores):
    """Ruzzo and Tompa's definition, by recursion: the best segment (the shortest
    of equals, the first of those), then what is left on both sides."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 1e-12 and (best is None or s > best[0] + 1e-12 or abs(s - best[0]) <= 1e-12 and b - a < best[2] - best[1]):
                best = (s, a, b)
    if not best:
        return []
    s, a, b = best
    return all_maximal(scores[:a]) + [(a, b, s)] + [(b + x, b + y, z) for x, y, z in all_maximal(scores[b:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(200):
        hits = {i: rng.choice([0.3, 0.6, 1.1, 2.7]) + rng.random() / 100 for i in range(25) if rng.random() < 0.3}
        scores = [hits.get(i, -0.4) for i in range(25)]
        got = toxicity.segments(sorted(hits), [hits[i] for i in sorted(hits)], drift=0.4)
        want = all_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    docs = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["Zounds!", "gadzook" + rng.choice("abcde"), "fie"]))
        docs.append((i, " ".join(w), toxic, int(rng.random() < 0.8)))
    for k, (i, t, x, good) in enumerate(docs):
        if not good:
            w = t.split()
            kind = rng.randrange(4)
            t = ["!! ".join(w).upper(), "### ".join(w), " | ".join(w), " ".join(x for y in w[:9] for x in [y] * 20)][kind]
            docs[k] = (i, t, x, good)
    return docs


def test_held_out(spark):
    docs = corpus(1200, 5)
    d = spark.createDataFrame([(i, t, 1) for i, t, _, _ in docs] + [(None, None, 1), (9999, "", 1)], "doc_id long, text string, _score int")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in docs] + [(3, None, None), (7777, 1, 1)], "doc_id long, toxic int, quality int")
    keep = training.fold(toxicity.F.col("_id"), 3) != 1
    model = toxicity.fit_on(d, labels, keep)
    held = {r[0] for r in d.filter(training.fold(toxicity.F.col("doc_id"), 3) == 1).select("doc_id").collect()}
    got = {r["_id"]: r for r in toxicity.score(d, model).collect()}
    assert len(got) == 1202 and all(0 <= r["_score"] <= 1 for r in got.values()) and got[9999]["_score"] < 0.5
    test = [(got[i]["_score"] >= 0.5, x) for i, _, x, _ in docs if i in held]
    assert sum(a == bool(x) for a, x in test) / len(test) > 0.95
    assert all(r["_passages"] for r in got.values() if r["_score"] > 0.9)
    same = d.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()
    assert all(abs(r["s"] - got[r["doc_id"]]["_score"]) < 1e-9 for r in same)

    net = quality.fit_on(d, labels, keep)
    scored = {r["_id"]: r["_score"] for r in quality.score(d, net).collect()}
    assert len(scored) == 1202 and all(0 <= s <= 1 for s in scored.values())
    test = [(scored[i] >= 0.5, q) for i, _, _, q in docs if i in held]
    assert sum(a == bool(q) for a, q in test) / len(test) > 0.95
    assert toxicity.score(d.limit(0), model).count() == 0 and quality.score(d.limit(0), net).count() == 0


def test_passages_of_tokens_that_came_before():
    bad = ["aaaa", "bbbb", "cccc", "dddd"]
    model = toxicity.Model({w: 5.0 for w in bad}, 1.62, (-6.0, 2.0, 2.0))
    spans = lambda words: [(a, b) for a, b, s in model.passages(words) if s >= -math.log(toxicity.SIGNIFICANT)]
    clean = ["x"] * 1000
    twice = model.passages(clean + bad + clean + bad + clean)
    assert [(a, b) for a, b, _ in twice] == [(1000, 1004), (2004, 2008)] and twice[0][2] == twice[1][2]
    assert spans(clean + bad + clean + bad + clean) == [(1000, 1004), (2004, 2008)]
    # single mentions, far apart, before a dense passage take nothing from it
    mentions = [w for b in bad for w in clean + [b]]
    assert spans(mentions + clean + bad + clean) == [(5004, 5008)]
    alone = model.evidence(model.passages(clean * 6 + bad + ["x"] * 4))
    assert np.allclose(model.evidence(model.passages(mentions + clean + bad + clean)), alone)
    # a repeat close by scores nothing more and belongs to the passage
    [(a, b, s)] = model.passages(clean + bad + ["x"] * 3 + bad + clean)
    [(_, _, once)] = model.passages(clean + bad + ["x"] * 7 + clean)
    assert (a, b) == (1000, 1011) and s == once
    assert len(model.passages(bad[:1] * 15)) == 1


def test_without_labels_of_both_kinds():
    assert toxicity.fit([]).probability((0.0, 0.0)) < 0.01
    assert toxicity.fit([("a b", 1)]).probability((0.0, 0.0)) > 0.99
    assert quality.fit([("a", 1)] * 3).predict([b"", b"x" * 300_000]).min() > 0.99
    assert abs(quality.fit([]).predict([b""])[0] - 0.5) < 1e-6


def test_gradients():
    rng = np.random.default_rng(1)
    net = quality.start(3)
    net.bias += 0.05
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (3, 70, 300, 129)]
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = np.clip(net.predict(texts).astype(float), 1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = quality._gradients(net, texts, y)
    for w, g in ((net.layer, grads[2]), (net.bias, grads[1]), (net.filters, grads[0])):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            flat = w.reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-2 - g.ravel()[at]) < 0.02 + 0.1 * abs(g.ravel()[at])


def test_batches_do_not_change_scores():
    net = quality.start()
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 200, 1000)]
    assert np.allclose(net.predict(texts), [net.predict([t])[0] for t in texts], atol=1e-5)


def test_repeats_match_at_their_length():
    data, halves = quality.lay_out([b"word " * 100, b"the quick brown fox jumps over a lazy dog while nothing repeats", b""])
    f = quality.lag_features(data, halves)
    assert f[0, 0] > 0.9 and f[1, 0] < 0.5 and f[2, 0] == 0


def plain_score(net, text):
    """The forward pass, a place, a lag and a half chunk at a time."""
    n = -(-(len(text) + quality.WIDTH + quality.LAGS) // quality.HALF)
    size = n * quality.HALF
    data = (bytes(quality.WIDTH) + text).ljust(size + quality.WIDTH, b"\0")
    half, same, full = [], [], []
    for h in range(n):
        span = range(h * quality.HALF, (h + 1) * quality.HALF)
        responses = [[sum(net.filters[j, data[at + j], f] for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for at in span[:: quality.STRIDE]]
        half.append([max(max(r[f] for r in responses) + net.bias[f], 0.0) for f in range(quality.FILTERS)])
        same.append([sum(data[at] != 0 and at >= p and data[at] == data[at - p] for at in span) for p in range(1, quality.LAGS + 1)])
        full.append(sum(data[at] != 0 for at in span))
    chunk = [[max(x) for x in zip(*half[h : h + 2])] for h in range(n)]  # the last half stands alone
    bytes_ = [sum(full[h : h + 2]) for h in range(n)]
    share = [max(sum(x) for x in zip(*same[h : h + 2])) / max(bytes_[h], 32) for h in range(n)]
    mean = sum(s * b for s, b in zip(share, bytes_)) / max(sum(bytes_), 1)
    pooled = [max(x) for x in zip(*chunk)] + [sum(x) / n for x in zip(*chunk)] + [max(share), mean]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(pooled, net.layer)) - net.offset))


def test_forward_pass():
    rng = np.random.default_rng(5)
    net = quality.start(4)
    net.bias += rng.normal(size=quality.FILTERS).astype(np.float32)
    net.layer[-2:] = (1.5, -2.0)
    net.offset = 0.3
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 27, 28, 29, 64, 92, 93, 500)] + [b"spam " * 60]
    assert np.allclose(net.predict(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_scores_of_long_and_missing_texts(spark):
    net = quality.start(4)
    rows = [(1, "word " * 300_000, 1), (1, "word " * 300_000, 2), (2, None, 1), (None, "", 1), (3, "a é 漢", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _score int")
    got = sorted(((r["_id"] or 0, r["_score"]) for r in quality.score(d, net).collect()))
    want = sorted((i or 0, net.predict([(t or "").encode()])[0]) for i, t, _ in rows)
    assert [i for i, _ in got] == [0, 1, 1, 2, 3] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
