"""The pipeline, stage by stage, against brute force on what each stage gets."""

import random
import re
import zlib

import pytest
from test_decontam import brute as contaminated
from test_simhash import brute_similar

import corpus_pipeline
from dialume.llm import packing, simhash, toxicity
from dialume.llm.queries import TOXIC, tokenizer_path


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(20)) for k in range(10)]
    docs, labels, clean = [], [], ["x"]
    for i in range(700):
        t, kind = prose(rng.randint(30, 150)), rng.random()
        bad = int(kind < 0.15)
        if bad:
            t += " zounds gadzooks fie " + prose(5) + " zounds! gadzooks"
        elif kind < 0.3:
            t = rng.choice(clean)
        elif kind < 0.4:
            w = rng.choice(clean).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.5:
            a, b = rng.sample(items, 2)
            t += " " + a[1] + " " + prose(3) + (" " + b[1].upper() if kind < 0.45 else " just one item")
        docs.append((i, t))
        if not bad:
            clean.append(t)
        if rng.random() < 0.8:
            labels.append((i, 1, bad))
    docs += [(900, None), (901, ""), (902, "  "), docs[20], docs[20], (903, "long " * 20_000), (None, "no identifier")]
    return docs, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    rows = [(i, t, None, "s", len(t or ""), "clash") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(rows):
    return sorted(((r[0] is None, r[0] or 0, r[1] or "", r[1] is None) for r in rows))


def test_stages(spark, sf_dir):
    docs, labels, items = corpus()
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = frame.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]

    def stage(i):
        out = corpus_pipeline.STAGES[i][1](spark, frame, sf_dir)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        return out, [(r["doc_id"], r["text"]) for r in out.collect()]

    # 1: the model fitted on the same rows
    text = dict(docs)
    train = [(i, text[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.fit([(t or "", y) for _, t, y in sorted(train)])
    rate = lambda t: model.probability(model.evidence(model.passages(toxicity.tokens(t or ""))))
    frame, got = stage(0)
    assert key(got) == key([d for d in docs if rate(d[1]) < TOXIC])
    bad = {i for i, _, y in labels if y}
    assert not bad & {i for i, _ in got}
    # 2
    before = got
    frame, got = stage(1)
    groups = {}
    for i, t in before:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert key(got) == key({(i, t) for i, t in before if i == best[t or ""]})
    # 3
    before = got
    frame, got = stage(2)
    roots = brute_similar([(i, t) for i, t in before if i is not None], simhash.radius(0.8))
    assert key(got) == key([(i, t) for i, t in before if i is None or roots[i] == i])
    assert len(got) < len(before)
    # 4
    before = got
    frame, got = stage(3)
    hit = [bool(found) for *_, found in contaminated(before, items)]
    assert key(got) == key([d for d, h in zip(before, hit) if not h])
    assert not {i for i, t in got if t and "just one item" in t} and {i for i, t in before if t and "just one item" in t}
    assert len(got) < len(before)
    # 5
    out = corpus_pipeline.STAGES[4][1](spark, frame, sf_dir).collect()
    encode = packing.encoder(tokenizer_path())
    want = {i: len(encode(t or "")) + 1 for i, t in got}
    have = {}
    for r in out:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert have == want


def test_rows_that_share_an_identifier_or_have_none(spark, sf_dir):
    """Exact dedup and decontamination name rows by identifier and text."""
    item = corpus()[2][0][1]
    rows = [(5, "text one here"), (5, "text two here"), (9, "text two here"), (None, "text two here"), (None, item), (None, "alone"), (7, item), (7, "clean one"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    got = [(r[0], r[1] or "") for r in left.collect()]
    assert sorted(got, key=str) == sorted([(5, "text one here"), (9, "text two here"), (None, "alone"), (7, item), (7, "clean one"), (8, "")], key=str)
    left = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert key([(r[0], r[1]) for r in left.collect()]) == key([r for r in rows if r[1] != item])


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 100


def test_empty_documents(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        d = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        d.limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_native_stage_uses_python():
    """The natively asked operators' modules declare no Python functions."""
    for name in ("pii", "decontam", "lsm"):
        source = open(corpus_pipeline.__file__.replace("corpus_pipeline.py", f"dialume/llm/{name}.py"), encoding="utf-8").read()
        assert not re.search(r"mapIn|pandas|applyIn|\.rdd|udf", source)
