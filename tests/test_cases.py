"""Cases worked out by hand, and laws that hold for any turns and words."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialume.functions import scripts
from dialume.functions import text as T
from dialume.operators import attribute as A
from dialume.operators import decode as D
from dialume.operators import der as E
from dialume.operators import intervals as I
from dialume.operators import relabel as R
from dialume.operators import sets as S
from dialume.operators import turns as P
from dialume.operators import wer as M
from dialume.plans import report
from dialume.sources import rttm, tables

TURN = "clip_id long, idx long, speaker string, start_ms long, end_ms long"
WORD = "clip_id long, wid long, w string, start_ms long, end_ms long"


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, s, a, b) for i, (s, a, b) in enumerate(rows)], TURN)


def words(spark, *rows):
    return spark.createDataFrame([(1, i, "w", a, b) for i, (a, b) in enumerate(rows)], WORD)


def test_attribution_ties_silence_and_no_length(spark):
    t = turns(spark, ("a", 0, 1000), ("b", 1000, 2000), ("c", 5000, 6000))
    w = words(spark, (900, 1100), (2500, 2600), (1500, 1500), (4700, 4800), (3000, 4000))
    got = {r["wid"]: (r["spk"], r["orphan"]) for r in A.attribute(w, t).collect()}
    assert got == {0: ("a", False), 1: ("b", True), 2: ("b", True), 3: ("c", True), 4: ("b", True)}
    assert A.attribute(w, t, nearest=False).filter("orphan").select("spk").distinct().collect()[0]["spk"] is None


def test_attribution_over_buckets_like_a_plain_loop(spark):
    rng = random.Random(1)
    t = [(rng.choice("ab"), a, a + rng.choice([0, 50, 400, 5000])) for a in (rng.randrange(20_000) for _ in range(60))]
    w = [(a, a + rng.choice([0, 40, 900])) for a in (rng.randrange(22_000) for _ in range(150))]
    got = {r["wid"]: r["spk"] for r in A.attribute(words(spark, *w), turns(spark, *t), bucket_ms=700).collect()}
    for i, (a, b) in enumerate(w):
        over = [(-(min(b, e) - max(a, s)), s, e, k) for k, (_, s, e) in enumerate(t) if min(b, e) - max(a, s) > 0]
        gaps = [(max(0, s - b, a - e), s, e, k) for k, (_, s, e) in enumerate(t) if e > s]
        assert got[i] == t[min(over or gaps)[3]][0]


def test_same_speaker_turns_contest_but_do_not_overlap(spark):
    t = turns(spark, ("a", 0, 1000), ("a", 500, 1500))
    assert A.contested(words(spark, (400, 1200)), t).collect()[0]["overlap"] == 2
    assert I.speaker_overlap(t).collect()[0]["overlap_ms"] == 0
    apart = turns(spark, ("a", 0, 500), ("b", 600, 1500))
    assert A.contested(words(spark, (400, 1200)), apart).collect()[0]["boundary"]


def test_touching_intervals_merge(spark):
    t = turns(spark, ("a", 0, 100), ("b", 100, 200), ("c", 201, 300))
    assert sorted((r["start_ms"], r["end_ms"]) for r in I.islands(t, ["clip_id"]).collect()) == [(0, 200), (201, 300)]


spans = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60), st.integers(0, 30)), max_size=12)


@settings(max_examples=12, deadline=None)
@given(spans, spans)
def test_timelines_against_sets(x, y):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, b = ([(s, u, u + n) for s, u, n in z] for z in (x, y))
    cover = lambda z: {p for _, u, v in z for p in range(u, v)}
    size = lambda d: sum(r["end_ms"] - r["start_ms"] for r in d.collect())
    ta, tb = (spark.createDataFrame([(1, i, *r) for i, r in enumerate(z)], TURN) for z in (a, b))
    assert size(I.islands(ta.filter("end_ms > start_ms"), ["clip_id"])) == len(cover(a))
    assert size(I.subtract(ta, tb)) == len(cover(a) - cover(b))
    assert size(I.intersect(ta, tb)) == len(cover(a) & cover(b))
    two = [p for p in cover(a) if len({s for s, u, v in a if u <= p < v}) > 1]
    assert size(I.overlap_regions(ta)) == len(two)


def spoken(spark, *rows):
    return spark.createDataFrame([(1, i, "w", s, a, b) for i, (s, a, b) in enumerate(rows)], "clip_id long, wid long, w string, spk string, start_ms long, end_ms long")


def test_units_break_on_long_gaps_only(spark):
    w = spoken(spark, ("a", 0, 100), ("a", 600, 700), ("a", 1201, 1300), ("b", 1300, 1400))
    assert [r["unit"] for r in I.pause_units(w, 500).orderBy("wid").collect()] == [0, 0, 1, 2]
    assert [r["unit"] for r in I.pause_units(w, None).orderBy("wid").collect()] == [0, 0, 0, 1]


def test_rule(spark):
    w = spoken(spark, ("a", 0, 1000), ("b", 1100, 1300), ("a", 1900, 2900), ("a", 3500, 3600), ("c", 9000, 12000))
    u = I.units(I.pause_units(w, 500))
    got = {r["unit"]: r["speaker"] for r in R.rule_edits(u).collect()}
    # a unit of exactly a second stays; a short unit beside its own speaker goes to the other neighbour
    assert got == {1: "a", 3: "c"}


def test_projection_tie_takes_the_smaller_label(spark):
    t = turns(spark, ("x", 0, 1000), ("y", 2000, 2500))
    got = {r["idx"]: r["label"] for r in A.project_labels(t, spoken(spark, ("b", 0, 100), ("a", 200, 300))).collect()}
    assert got == {0: "a", 1: "y"}


def test_der_of_renamed_missing_and_split_turns(spark):
    ref = turns(spark, ("a", 0, 1000), ("b", 800, 2000), ("a", 2500, 3000))
    renamed = turns(spark, ("y", 0, 1000), ("x", 800, 2000), ("y", 2500, 2700), ("y", 2700, 3000))
    same = E.der(ref, renamed).collect()[0]
    assert (same["der"], same["miss_ms"], same["fa_ms"], same["conf_ms"], same["total_ms"]) == (0.0, 0, 0, 0, 2700)
    none = E.der(ref, renamed.limit(0)).collect()[0]
    assert none["der"] == 1.0 and none["hyp_missing"]
    assert E.jer(ref, renamed).collect()[0]["jer"] == 0.0
    worse = E.der(ref, turns(spark, ("y", 0, 2200))).collect()[0]
    # 200 ms of overlap and the last turn missed, 200 ms too much, the shorter share of one speaker confused
    assert (worse["miss_ms"], worse["fa_ms"], worse["conf_ms"]) == (700, 200, 800)


def test_collar_and_regions(spark):
    ref, hyp = turns(spark, ("a", 0, 1000), ("b", 800, 2000)), turns(spark, ("x", 0, 900), ("y", 900, 2000))
    assert E.der(ref, hyp, E.collar_regions(ref, 250)).collect()[0]["total_ms"] == (800 - 125 - 125) + (2000 - 1000 - 125 - 125)
    many, single = E.regions_by_overlap(ref)
    parts = [E.der(ref, hyp, r).collect()[0]["total_ms"] for r in (many, single)]
    assert parts == [400, 1800]


def lists(spark, by):
    return spark.createDataFrame([(1, s, w.split()) for s, w in by.items()], "clip_id long, speaker string, ws array<string>")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_cpwer(spark):
    ref = {"a": "one two three four", "b": "five six"}
    cases = [({"x": "five six", "y": "one two three four"}, 0), ({"x": "five six", "y": "one two three four", "z": "extra words"}, 2), ({"y": "one two nine four"}, 3)]
    for hyp, want in cases:
        r, h = lists(spark, ref), lists(spark, hyp)
        assert M.cpwer(r, h).collect()[0]["cp_errors"] == want
        assert M.cpwer_enumerated(r, h).collect()[0]["cp_errors"] == want
    assert M.cpwer(lists(spark, ref), lists(spark, cases[0][0])).collect()[0]["mapping"][0]["hyp"] == "y"


def test_edits_like_a_plain_table(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcdé") for _ in range(rng.randint(0, 12))], [rng.choice("abcdx") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>")
    for r in M.with_edits(d, "a", "b", "e").collect():
        assert r["e"] == edit_distance(*pairs[r["i"]])


def test_many_words_pass_the_surrogates(spark):
    ws = [f"w{i}" for i in range(56_000)]
    d = spark.createDataFrame([(ws[-3:] + ws[:1], ws)], "a array<string>, b array<string>")
    v = d.select(M.encode(F.col("a"), F.col("b")).alias("x")).collect()[0]["x"]
    assert len(v) == 4 and len(set(v)) == 4 and not any(0xD800 <= ord(c) < 0xE000 for c in v)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (4, 4), (3, 5)]:
        for _ in range(30):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            got = M.assign(cost)
            assert len(set(got)) == n and cost[np.arange(n), got].sum() == best


def test_of_equal_assignments_the_first_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        for _ in range(60):
            cost = -rng.integers(0, 3, (n, n)).astype(float)
            want = min(itertools.permutations(range(n)), key=lambda p: (sum(cost[i, p[i]] for i in range(n)), p))
            assert tuple(M.first_of_equals(cost)) == want


def test_jer_tie_is_settled_by_the_order_of_speakers(spark):
    """Matching either reference speaker with the only hypothesis shares 1000 ms."""
    ref = turns(spark, ("a", 0, 1000), ("b", 1000, 4000))
    hyp = turns(spark, ("y", 0, 2000))
    error = lambda order: E.jer(ref, hyp, order=order).collect()[0]["error_sum"]
    assert error(None) == error((["a", "b"], ["y"])) == 1.5
    assert error((["b", "a"], ["y"])) == 1.75
    # a speaker that the clip lacks comes first: the first speaker takes it
    assert error((["a", "b"], ["x", "y"])) == 1.75


def test_greedy_bound_and_alignment():
    refs = [["a", "b", "c"], ["d", "e"]]
    assert M.greedy_di(refs, [["a", "b"], ["d", "e"], ["c"]]) == 0
    assert M.greedy_di(refs, [["x"]]) == 5
    assert M.align("a b c d".split(), "a x c".split()) == [(0, 0), (1, 1), (2, 2)]
    rng = random.Random(3)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = M.align(a, b)
        subs = sum(a[i] != b[j] for i, j in pairs)
        assert subs + len(a) + len(b) - 2 * len(pairs) == edit_distance(a, b)


def test_normalise(spark):
    d = spark.createDataFrame([("a-b <noise> Hello, (aside) [x] wörld। it's",), ("<noise>",), ("Ünï",)], "t string")
    got = [r["x"] for r in d.select(T.normalise(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b", "hello", "wörld", "it", "s"], [], ["ünï"]]
    assert [list(r["x"]) for r in d.select(T.normalise_unicode("t").alias("x")).collect()] == got


def test_language_and_counts(spark):
    d = spark.createDataFrame([("नमस्ते hi",), ("[noise] (x)",), ("தமிழ் தமிழ் abc",)], "t string")
    got = d.select(T.detect_language(F.col("t")).alias("l"), T.count_reference_words(F.col("t")).alias("n")).collect()
    assert [(r["l"], r["n"]) for r in got] == [("Devanagari (hi/mr)", 2), ("unknown", 1), ("Tamil", 3)]


def test_letters_of_scripts_are_those_of_the_patterns(spark):
    """Every code point, in texts of 64; and texts of all scripts, with asides."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in "[]()"]
    rng = random.Random(2)
    some = [c for c in chars[:0x3000] if c.isalpha()]
    texts = ["".join(chars[i : i + 64]) for i in range(0, 0x3000, 64)] + ["".join(chars[i : i + 64]) for i in range(0x3000, len(chars), 4096)]
    texts += ["".join(rng.choices([*some, "[", "]", "(", ")", " ", "\n"], k=40)) for _ in range(300)] + ["", " ", "12", "ab(cd]", "a[b\nकख]", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    differ = d.filter(~T.detect_language(F.col("t")).eqNullSafe(T.language_of(T.script_counts(F.col("t")))))
    assert differ.count() == 0
    jvm = spark.sparkContext._jvm
    everything = jvm.java.lang.StringBuilder("".join(chars))
    for name, script in [(s, T.JAVA_NAMES.get(s, s)) for s in [*T.SCRIPTS, *T.MORE_SCRIPTS]]:
        letters = jvm.java.util.regex.Pattern.compile(rf"[^\p{{Is{script}}}]|\P{{L}}").matcher(everything).replaceAll("")
        assert letters == "".join(c for c, k in zip(chars, scripts._table()[[ord(c) for c in chars]] == scripts.NAMES.index(name) + 1) if k)


def test_language_is_counted_once(spark):
    """One pass over the text, however many scripts there are: no pattern in the plan."""
    plan = spark.range(1).select(T.detect_language(F.lit("x")))._jdf.queryExecution().toString()
    assert "regexp" not in plan


def test_crosstab_reads_its_input_once(spark):
    d = spark.range(6).selectExpr("'a' asr", "id clip_id", "'en' detected", "element_at(array('Latin', 'Thai', null), int(id % 3) + 1) script", "id hyp_words", "2L ref_words")
    table = report.language_crosstab(d, ["Latin", "Tamil"])
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert table.columns == ["asr", "detected", "Latin", "Tamil", "other", "word_ratio"]
    assert [tuple(r) for r in table.collect()] == [("a", "en", 2, 0, 4, 1.25)]


def test_clip_id_and_condition(spark):
    d = spark.createDataFrame([("v", 1.0, 2.5, "x__a__b+rule"), ("v", 0.0005, 0.0015, "x__a")], "v string, a double, b double, c string")
    r = d.select(T.clip_id(F.col("v"), F.col("a"), F.col("b")).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(T.split_condition(F.col("c")))]).collect()
    assert r[0]["id"] == "v__000001000_000002500" and tuple(r[0])[1:] == ("x", "a__b", "rule")
    assert r[1]["id"] == "v__000000000_000000002" and tuple(r[1])[1:] == ("x", "a", "baseline")


def test_extract_json():
    edits = {"edits": [{"unit": 3, "speaker": "a {", "confidence": 0.9}]}
    assert T.extract_json("Sure!\n```json\n" + json.dumps(edits) + "\n``` done") == edits
    assert T.extract_json("x " + json.dumps(edits) + " {") == edits
    assert T.extract_json('{"edits": [{"unit": 1}, {"unit": 2}, {"un') == {"edits": [{"unit": 1}, {"unit": 2}]}
    assert T.extract_json("no object") is None and T.extract_json(None) is None and T.extract_json("{bad}") is None


def test_rogue_edits(spark):
    e = spark.createDataFrame([(c, u, "s", 1.0) for c, n in ((1, 4), (2, 3), (3, 4)) for u in range(n)], "clip_id long, unit long, speaker string, confidence double")
    u = spark.createDataFrame([(c, i) for c, n in ((1, 10), (2, 3), (3, 20)) for i in range(n)], "clip_id long, unit long")
    assert {r["clip_id"] for r in R.guard_rogue(e, u).collect()} == {2, 3}


def test_model_out_of_memory_is_halved(spark):
    p = spark.createDataFrame([(1, i, 0, 9, f"p{i}") for i in range(7)], "clip_id long, window int, first_edit long, last_edit long, prompt string")

    def client(texts):
        if len(texts) > 2:
            raise MemoryError
        return [t.upper() for t in texts]

    assert sorted(r["reply"] for r in R.ask_model(p.coalesce(1), client).collect()) == [f"P{i}" for i in range(7)]


def test_parsing_is_strict(spark):
    d = spark.createDataFrame([("Speaker A [0.00-2.50]| |Speaker  B [2.10-5.00]", "[0.00-2.50] hello|[2.10-5.00] yes")], "diarization_segments string, asr_segments string").withColumn("k", F.lit(1))
    both = P.zip_segments(P.parse_diarization(d.drop("asr_segments")), P.parse_asr(d.drop("diarization_segments")), ["k"])
    assert [(r["speaker"], r["start_ms"], r["end_ms"], r["text"]) for r in both.orderBy("pos").collect()] == [("Speaker_A", 0, 2500, "hello"), ("Speaker_B", 2100, 5000, "yes")]
    bad = spark.createDataFrame([(1, "Speaker A 0-1")], "k int, diarization_segments string")
    with pytest.raises(Exception, match="not a turn"):
        P.parse_diarization(bad).collect()


def test_load_segments(spark):
    d = spark.createDataFrame([(0, "v", "1", "2"), (1, "v", "1.0", "2"), (2, "v", "3", "2"), (3, "v", "x", "2"), (4, "u", "0", "1")], "row long, video_id string, start_sec string, end_sec string")
    assert [r["row"] for r in P.load_segments(d).orderBy("row").collect()] == [0, 4]
    assert P.load_segments(d, only=["u__000000000_000001000"]).count() == 1 and P.load_segments(d, limit=1).count() == 1
    with pytest.raises(ValueError, match="missing"):
        P.load_segments(d.drop("row"))


def test_rttm_reader_skips_what_is_no_turn(spark, tmp_path):
    lines = ["", "; note", "SPEAKER c 1 0.000 2.500 <NA> <NA> A b <NA> <NA>", "SPEAKER c 1 1.0 0 <NA> <NA> A <NA> <NA>", "LEXEME c 1 1.0 1 <NA> <NA> A", "SPEAKER c 1 1.0"]
    (tmp_path / "x.rttm").write_text("\n".join(lines))
    assert [tuple(r) for r in rttm.read_rttm(spark, str(tmp_path / "x.rttm")).collect()] == [("c", 0, 2500, "A")]
    t = spark.createDataFrame([("c", "a b", 5, 1500), ("c", "z", 9, 9)], "clip_id string, speaker string, start_ms long, end_ms long")
    rttm.write_rttm(t, str(tmp_path / "out"))
    assert [tuple(r) for r in rttm.read_rttm(spark, str(tmp_path / "out")).collect()] == [("c", 5, 1500, "a_b")]


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"key": "a", "status": "failed"}\n{"key": "a", "status": "ok"}\n{"key": "b", "status": "ok"}\n{"key": "b", "sta')
    log = tables.read_log(spark, str(tmp_path / "log.jsonl"), "key string, status string")
    assert {(r["key"], r["status"]) for r in S.latest(log).collect()} == {("a", "ok"), ("b", "ok")}
    items = spark.createDataFrame([("a",), ("c",)], "key string")
    assert [r["key"] for r in S.pending(items, log).collect()] == ["c"]
    last = spark.createDataFrame([("a", "ok", None, 5), ("b", "failed", "gone", None), ("c", "failed", "net", None), ("d", "ok", None, 7)], "key string, status string, error_class string, n_samples long")
    files = spark.createDataFrame([("a", 5), ("d", 6)], "key string, n_samples long")
    got = {r["key"]: r["skip"] for r in S.resume_verified(last.select("key"), last, files, ("gone",)).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_shards_part_the_items(spark):
    d = spark.createDataFrame([(f"k{i:04d}",) for i in range(700)], "key string")
    got = [sorted(r["key"] for r in S.shard(d, "key", 3, i).collect()) for i in range(3)]
    assert got == [[f"k{i:04d}" for i in range(k, 700, 3)] for k in range(3)]


def test_documents_and_tables(spark, tmp_path):
    w = spark.createDataFrame([("c", 1, "b", 100, 200), ("c", 0, "a", 0, 100)], "clip_id string, wid long, w string, start_ms long, end_ms long")
    doc = tables.words_documents(w).withColumns({"system": F.lit("s"), "lang": F.lit("en")})
    doc.write.json(str(tmp_path / "docs"))
    assert [(r["wid"], r["w"], r["start_ms"], r["end_ms"]) for r in tables.read_words(spark, str(tmp_path / "docs")).collect()] == [(0, "a", 0, 100), (1, "b", 100, 200)]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert tables.read_table(spark, str(tmp_path / "t.tsv")).collect()[0]["b"] == "x"
    tables.write_csv(spark.createDataFrame([(1.23456, "x")], "a double, b string"), str(tmp_path / "csv"), digits=4)
    assert tables.read_table(spark, str(tmp_path / "csv")).collect()[0]["a"] == "1.2346"
    with pytest.raises(ValueError):
        tables.read_table(spark, "a.xlsx")


def test_audio_headers(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(b"\0\1" * 321)
    r = tables.scan_audio(spark, str(tmp_path / "a.wav")).collect()[0]
    assert (r["rate"], r["channels"], r["bits"], r["n_samples"], r["ok"]) == (16000, 1, 16, 321, True)


def test_similarity_and_level(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "c"], [0.5, -0.5])], "a array<string>, b array<string>, s array<double>")
    r = d.select(T.sequence_similarity("a", "b").alias("x"), T.level_db(F.col("s")).alias("db")).collect()[0]
    assert r["x"] == 0.5 and abs(r["db"] + 6.0206) < 1e-3


def test_vocabulary(spark):
    d = spark.createDataFrame([(0, "x", ["a", "b", "c"]), (1, "y", ["d"])], "block int, lang string, tokens array<string>")
    assert [(r["token_id"], r["token"]) for r in D.vocabulary(d, most=2).orderBy("token_id").collect()] == [(0, "a"), (1, "b"), (2, "d")]


def test_blank_wins_ties(spark):
    f = spark.createDataFrame([(1, 0, [0.5, 0.1, 0.2, 0.3, 0.5]), (1, 1, [0.1, 0.9, 0.9, 0.3, 0.5])], "clip_id long, frame long, scores array<double>")
    got = D.block_winners(f, 2, 2).orderBy("frame").collect()
    assert [(r["is_blank"], r["block"]) for r in got] == [(True, 0), (False, 0)]


def test_markdown(spark):
    d = spark.createDataFrame([("a|b", None, 1.5)], "x string, y int, z double")
    assert report.markdown(d).splitlines()[-1] == "| a\\|b | – | 1.50 |"
    with pytest.raises(ValueError):
        report.markdown(spark.range(5), most=3)


def test_report_checks_find_what_breaks(spark):
    s = spark.createDataFrame([("x", "a", "baseline", 1, 5, 10), ("x", "a", "rule", 1, 6, 10)], "asr string, diar string, method string, clip_id long, wer_errors long, length long")
    assert report.wer_changes(s).count() == 1
    other = s.withColumn("wer_errors", F.lit(5))
    assert report.twins_differ(s, other, ["wer_errors"], report.KEY).count() == 1
    assert report.differs(s, other, report.KEY, "wer_errors").count() == 1


def test_diarizer_outputs(spark):
    shapes = ['[{"start": 1.5, "end": 2.0, "speaker": "b"}, {"start": 0, "end": 1, "speaker": "a"}, {"start": 3, "end": 3, "speaker": "c"}]', '{"segments": [{"start": 0.25, "end": 1, "speaker": "a"}]}', '["0.0 1.25 s0", "bad", "2 3 s1"]', "nonsense", None]
    d = spark.createDataFrame(list(enumerate(shapes)), "clip_id int, output string")
    got = [tuple(r) for r in D.parse_diarizer_output(d).orderBy("clip_id", "idx").collect()]
    assert got == [(0, 0, 0, 1000, "a"), (0, 1, 1500, 2000, "b"), (1, 0, 250, 1000, "a"), (2, 0, 0, 1250, "s0"), (2, 1, 2000, 3000, "s1")]


def test_samples_and_sheets(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    raw = (tmp_path / "a.wav").read_bytes()
    d = spark.createDataFrame([(bytearray(raw),), (bytearray(b"x"),), (None,)], "content binary")
    assert [r["s"] for r in d.select(tables.samples("content").alias("s")).collect()] == [[0.0, 0.5, -1.0], None, None]
    out = tables.write_sheets({"x" * 40: spark.range(1), "x" * 35: spark.range(2)}, str(tmp_path / "book"))
    assert len({v.rsplit("/", 1)[1] for v in out.values()}) == 2 and all(len(v.rsplit("/", 1)[1]) <= 31 for v in out.values())
    assert tables.read_table(spark, out["x" * 35]).count() == 2


def test_pick(spark):
    s = spark.createDataFrame([("x", "a", "rule"), ("x", "ref", "rule"), ("y", "a", "rule")], "asr string, diar string, method string")
    assert report.pick(s, "x", "rule").count() == 2 and report.pick(s, "x", "rule", "a").count() == 1
    assert report.without_reference(s).count() == 2


def test_seconds_are_rounded_as_doubles_are(spark):
    ms = [*range(0, 3000, 7), *range(50, 200_000, 350), 250, 750, 123456750, 987654350, -350, -20]
    d = spark.createDataFrame([(m,) for m in ms], "ms long").select("ms", R.seconds(F.col("ms")).alias("s"))
    for r in d.collect():
        assert float(r["s"]) == float(f"{r['ms'] / 1000:.1f}"), r


def test_windows_that_do_not_fit_shrink():
    asked = []

    def ask(first, end, context):
        asked.append((first, end, context))
        return "ok" if end - first <= 7 else None

    found, misses = R.window_pass(20, ask)
    # 20 -> 10 -> 5; then 4 units of context, at least two more
    assert found[0] == (0, 5, "ok") and misses > 2
    covered = [u for first, end, _ in found for u in range(first, end)]
    assert covered == list(range(20))
    assert R.window_pass(0, ask) == ([], 0)
    found, misses = R.window_pass(30, lambda a, b, c: None)
    assert found == [] and misses > 0
    found, _ = R.window_pass(9, lambda a, b, c: "ok" if b - a <= 2 + c else None)  # smaller than the context
    assert [x[:2] for x in found] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9)]
    assert R.window_pass(60, lambda a, b, c: "x")[0] == [(0, 25, "x"), (25, 46, "x"), (46, 60, "x")]


def test_log_keeps_the_last_of_many_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for n, status in ((1, "failed"), (400, "ok"), (1, "failed"), (900, "ok")):
        rows = [("a", status, "x" * n)] + [(f"k{i}", status, "y") for i in range(n)]
        tables.append_log(spark.createDataFrame(rows, "key string, status string, pad string").repartition(3), path)
    log = tables.read_log(spark, path, "key string, status string, pad string")
    last = {r["key"]: r["status"] for r in S.latest(log).collect()}
    assert last["a"] == "ok" and last["k0"] == "ok" and len(last) == 901


def test_more_words_than_characters(spark):
    a, b = [f"w{i}" for i in range(70_000)], [f"w{i}" for i in range(3, 70_000)]
    d = spark.createDataFrame([(a[:300], b[:290]), (["x"], ["x"] + a[:40])], "r array<string>, h array<string>")
    for most in (M.MOST_WORDS, 20):
        assert [r["n"] for r in M.with_edits(d, "r", "h", "n", most).collect()] == [10, 40], most
    # characters past the surrogates and past 16 bits are one character each
    v = F.transform(F.sequence(F.lit(0), F.lit(69_999)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    row = spark.range(1).select(F.length(M.encode(F.array(F.lit("w69000"), F.lit("w56000"), F.lit("w3")), v)).alias("n"))
    assert row.first()["n"] == 3


def test_alignment_by_kept_rows_is_the_plain_one():
    rng = random.Random(9)
    for n, m in ((0, 3), (40, 35), (300, 280), (700, 5)):
        a, b = [rng.choice("abcde") for _ in range(n)], [rng.choice("abcde") for _ in range(m)]
        table = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        i, j, pairs = n, m, []
        while i and j:
            if table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif table[i][j] == table[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        assert M.align(a, b) == pairs[::-1]


@pytest.mark.parametrize("n,sketch", [(1, 10_000), (20, 10_000), (997, 10_000), (997, 100)])
def test_quantiles(spark, monkeypatch, n, sketch):
    monkeypatch.setattr(report, "SKETCH", sketch)
    rng = random.Random(n)
    values = [rng.choice([0.5, rng.random(), None if n > 9 else 0.1]) for _ in range(n)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 1 / 3, 2 / 3, 1.0]
    want = d.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
    assert report.quantiles(d, "v", shares) == pytest.approx(want, abs=1e-12)
    assert report.quantiles(d.limit(0), "v", shares) == [None] * 4
