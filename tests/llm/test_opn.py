"""The registered queries on the smallest tables: SQL's rows, or a plain version's."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from test_native import brute

from dialume.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 11))
    assert set(q.ORACLES) <= set(q.QUERIES)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    want = con.execute(q.ORACLES[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    order = {c[0]: i for i, c in enumerate(want.description)}
    rows = sorted(tuple(r[order[n]] for n in names) for r in want.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == rows


def test_op1_base_spans(spark, docs):
    got = q.op1_pii(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        found = brute(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        assert [r[f"n_{k}"] for k in found] == [len(v) for v in found.values()]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_fingerprints_and_components(spark, docs):
    prints = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    values = np.array([prints[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 2):
            x, y = sorted((find(i), find(ids[a + 1 + b])))
            root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op6_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op8_pieces_and_sequences(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in q.op8_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for i, rows in pieces.items():
        ids = [*tok.encode(docs[i] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        rows.sort(key=lambda r: r["piece"])
        at = 0
        for n, r in enumerate(rows):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(part))
            assert r["length"] == 1024 or n == 0 and 0 < r["length"] <= 1024
            at += r["length"]
        assert at == len(ids)
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(seqs) <= 1.02 * total / 1024 + 2


CLASSIFIERS = [("op4_toxicity", "toxic", 3, 1, 0.7), ("op9_quality", "quality", 5, 0, 0.3)]


@pytest.mark.parametrize("name, label, folds, held, threshold", CLASSIFIERS)
def test_classifiers_score_every_document(spark, docs, name, label, folds, held, threshold):
    """Rows, folds and thresholds, also where the labels are too few to learn from."""
    got = {r["doc_id"]: r for r in q.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


@pytest.mark.parametrize("name, label, folds, held, threshold", CLASSIFIERS)
def test_classifiers_rank_held_out_rows(spark, name, label, folds, held, threshold):
    """From some 300 labelled rows: far better than chance on the others (area under the curve)."""
    sf = SF.replace("0.001", "0.01")
    known = spark.read.parquet(f"{sf}/labels.parquet").filter(f"{label} is not null").collect()
    got = {r["doc_id"]: r["score"] for r in q.QUERIES[name](spark, sf).filter("held_out").collect()}
    scores = {c: np.array([got[r["doc_id"]] for r in known if r[label] == c and r["doc_id"] in got]) for c in (0, 1)}
    assert len(scores[0]) > 5 and len(scores[1]) > 5
    assert np.mean([(a > scores[0]) + 0.5 * (a == scores[0]) for a in scores[1]]) > 0.8
