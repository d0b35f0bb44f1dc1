"""Personal data and exact dedup against brute force."""

import hashlib
import random
import re

import pytest

from dialume.llm import lsm, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string"


def table(spark, rows):
    """documents with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, "s", None, 7, "x") for i, t in rows], SCHEMA)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    out = {}
    for k, (p, ok) in BASE.items():
        out[k] = [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])]
    return out


def cases():
    rng = random.Random(5)
    texts = [None, "", "x@y.z_foo@bar.com a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1..2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-11112", "é😀 +1 (743) 555-3824 +1234567 +1 2 3 4 5 6 7 8 ", "+12345678901234567", "a" * 50_000 + "@b.co", "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, 123-45-6789", "00000000000000000 0.0.0.0"]
    texts += ["a@b" + ".c" * 60_000, "1." * 2000, "+1" + " 2" * 2000, "4 " * 2000, "a.b@" * 1000, "GB82" * 1000]
    for _ in range(300):
        texts.append("".join(rng.choice(["4", "1", "0", "9", "255", ".", ".", "-", " ", "@", "a", "Z", "_", "+", "(", ")", "é", "😀", "4111111111111111", "\n"]) for _ in range(rng.randint(1, 60))))
    return list(enumerate(texts))


def test_pii_matches_plain_patterns(spark):
    rows = cases()
    got = {r["_id"]: r for r in pii.find_pii(table(spark, rows)).drop("_text").collect()}
    for i, text in rows:
        for kind, want in brute(text).items():
            assert [(s["start"], s["end"]) for s in got[i][kind]] == want, (text, kind)
    for r in pii.find_pii(table(spark, rows)).select("_id", pii.spans_text(*pii.BASE).alias("s")).collect():
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, v in brute(rows[r["_id"]][1]).items() for a, b in v)
    iban = got[8]
    assert len(iban["iban"]) == 1 and len(iban["ssn"]) >= 1


def test_pii_mask_and_empty(spark):
    assert pii.find_pii(table(spark, [])).count() == 0
    assert pii.mask(table(spark, [(1, "to a@b.co now"), (2, None)])).collect()[0]["text"] == "to <email> now"


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + [None, "", "é", "é", "long " * 30_000, f"u{i}"])) for i in range(400)]
    rows += [rows[0], rows[0]]
    got = lsm.exact_dedup(table(spark, rows), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        g = groups[text[r["_id"]] or ""]
        best = max(g) if keep == "largest" else min(g)
        assert (r["_keep"], r["_size"], r["_kept"]) == (best, len(g), r["_id"] == best)
        assert bytes(r["_digest"]).hex() == hashlib.sha256((text[r["_id"]] or "").encode()).hexdigest()
    assert lsm.exact_dedup(table(spark, []), keep=keep).count() == 0


def test_exact_dedup_takes_equal_digests_apart(spark, monkeypatch):
    """With a digest that everything shares, the bytes decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lsm.F, "sha2", lambda c, n: F.lit("00"))
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    got = {r["_id"]: (r["_keep"], r["_size"]) for r in lsm.exact_dedup(table(spark, rows)).collect()}
    assert got == {0: (5, 3), 2: (5, 3), 5: (5, 3), 1: (4, 2), 4: (4, 2), 3: (3, 1)}


def test_index_runs_merge(spark):
    index = lsm.LsmIndex(spark)
    index.flush(table(spark, [(1, "a"), (2, "b")]))
    index.flush(table(spark, [(3, "a"), (4, None)]))
    got = sorted((r["_min"], r["_max"], r["_size"]) for r in index.compact().collect())
    assert got == [(1, 3, 2), (2, 2, 1), (4, 4, 1)]


def test_memtables_flush_several_runs(spark, monkeypatch):
    """Many small memtables give the same rows as one."""
    rows = [(i % 150, ["hot", None, f"u{i % 40}", "x" * (i % 7)][i % 4]) for i in range(400)]
    index = lsm.LsmIndex(spark, memtable_bits=4)
    index.flush(table(spark, rows).repartition(3))
    assert index.runs[0].select("_mem").distinct().count() >= 25
    assert index.compact().agg({"_size": "sum"}).first()[0] == 400
    monkeypatch.setattr(lsm.LsmIndex.__init__, "__defaults__", (4,))
    got = sorted((r["_id"], r["_keep"], r["_size"], r["_kept"]) for r in lsm.exact_dedup(table(spark, rows).repartition(3)).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert got == sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows)


def test_many_rows_of_one_identifier(spark):
    """Neither repeated identifiers nor missing ones are compared in pairs."""
    d = spark.range(100_000).selectExpr("cast(if(id % 2 = 0, 7, null) as long) doc_id", "if(id % 4 < 2, 'same', 'other') text")
    got = {(r["_id"], r["_keep"], r["_size"], r["_kept"]): r["count"] for r in lsm.exact_dedup(d).groupBy("_id", "_keep", "_size", "_kept").count().collect()}
    assert got == {(7, 7, 50_000, True): 50_000, (None, 7, 50_000, False): 50_000}


def test_pii_of_very_many_matches(spark):
    text = "to a@b.co or +49 (30) 1234-5678 " * 3000
    [r] = pii.find_pii(table(spark, [(1, text)])).collect()
    for kind, want in brute(text).items():
        assert [(s["start"], s["end"]) for s in r[kind]] == want
    [m] = pii.mask(table(spark, [(1, text)])).collect()
    assert m["text"] == "to <email> or <phone> " * 3000 and m["lang"] is None and m["_id"] == 7 and m["_text"] == "x"
