"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window, all of it). Of the ``WINDOW - GRAM + 1`` k-gram hashes in a window
the smallest is its fingerprint. A document's fingerprints are the k-grams that
are the smallest of any such stretch of its own, so every window that it shares
with an item gives both the same fingerprint. For items of ``n`` < ``WINDOW``
words the k-gram is the item and every k-gram is kept.

A bit map of the benchmark's fingerprints, of bounded size, sits in the plan, so
that a document's other k-grams are dropped where they are made; the rest join
the benchmark's fingerprints, and each hit is extended to the window and compared
word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents_view, materialize, salt_of

WINDOW, GRAM = 8, 5
#: Bits a fingerprint of the map, and its largest size in bits.
BITS_EACH, MOST_BITS = 64, 1 << 23
#: Up to this size (rows, bytes of windows) the benchmark goes to every executor; beyond, joins are salted.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` does just that to a pure ASCII text)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAPS, -1), "")


def _gram(words: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from the 0-based place ``at``."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: _gram(words, i, k))).otherwise(F.array().cast("array<long>"))


def windows_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``n, win`` (the words, joined by spaces) and ``item`` for every window."""
    view = documents_view(items, id_col, text_col).select(F.col("_id").cast("string").alias("item"), words_of(F.col("_text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    each = view.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(WINDOW)))).alias("w"))
    return each.select("item", F.size("w").alias("n"), F.array_join("w", " ").alias("win")).distinct()


def fingerprints_of(windows: DataFrame) -> DataFrame:
    """``n, win`` with its fingerprint ``h`` and where in the window that is (``q``)."""
    w = F.split("win", " ")
    each = windows.select("n", "win").distinct().withColumn("w", w)
    parts = [F.when(F.col("n") == WINDOW, F.array_min(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - GRAM)), lambda i: F.struct(_gram(F.col("w"), i, GRAM).alias("h"), i.alias("q")))))]
    for n in range(1, WINDOW):
        parts.append(F.when(F.col("n") == n, F.struct(_gram(F.col("w"), F.lit(0), n).alias("h"), F.lit(0).alias("q"))))
    return each.select("n", "win", F.coalesce(*parts).alias("f")).select("n", "win", "f.h", "f.q")


def bit_places(h: Column, n: Column, bits: int) -> list[Column]:
    """A fingerprint's two places in the bit map."""
    return [F.pmod(F.xxhash64(h, n, F.lit(s)), F.lit(bits)).cast("int") for s in (1, 2)]


def bit_map(prints: DataFrame, count: int) -> tuple[Column, int]:
    """The fingerprints' bit map as a constant array of longs: at most
    ``MOST_BITS`` bits, however large the benchmark."""
    bits = 1 << 12
    while bits < min(MOST_BITS, BITS_EACH * count):
        bits *= 2
    set_ = prints.select(F.explode(F.array(*bit_places(F.col("h"), F.col("n"), bits))).alias("i"))
    rows = set_.groupBy(F.expr("i div 64").cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % 64)).alias("b")).collect()
    cells = [0] * (bits // 64)
    for r in rows:
        cells[r["w"]] = r["b"]
    return F.from_json(F.lit("[" + ",".join(map(str, cells)) + "]"), "array<long>"), bits


def _candidates(n: int, bits: Column, size: int) -> Column:
    """A document's places whose fingerprints the map holds, with the words around."""
    k = GRAM if n == WINDOW else n
    words, hashes = F.col("w"), F.col(f"h{k}")

    def held(p: Column) -> Column:
        h = F.get(hashes, p)
        tests = [F.getbit(F.get(bits, F.shiftright(i, 6)), i % 64) == 1 for i in bit_places(h, F.lit(n), size)]
        out = tests[0] & tests[1]
        if n == WINDOW:  # the smallest of a stretch that covers it
            stretch = WINDOW - GRAM + 1
            starts = F.sequence(F.greatest(F.lit(0), p - stretch + 1), F.least(p, F.size(hashes) - stretch))
            least = F.when(F.greatest(F.lit(0), p - stretch + 1) <= F.least(p, F.size(hashes) - stretch), F.exists(starts, lambda i: F.array_min(F.slice(hashes, i + 1, F.lit(stretch))) == h)).otherwise(False)
            out = F.when(out, least).otherwise(False)
        return out

    back = WINDOW - GRAM if n == WINDOW else 0
    places = F.filter(F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>")), held)

    def cut(p: Column) -> Column:
        first = F.greatest(F.lit(0), p - back)
        return F.struct(F.lit(n).alias("n"), p.alias("p"), F.get(hashes, p).alias("h"), first.alias("first"), F.slice(words, first + 1, F.lit(n + back)).alias("near"))

    return F.transform(places, cut)


def join_benchmark(rows: DataFrame, bench: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Rows of documents joined with rows of the benchmark: sent to every
    executor if its measured size allows, else salted, so that a passage in very
    many documents is dealt over ``SALTS`` tasks."""
    if small:
        return rows.join(F.broadcast(bench), on)
    salted = bench.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", salt_of(F.struct("_row", "p"), SALTS)).join(salted, [*on, "_s"]).drop("_s")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``_id, n_words, n_hit`` and ``items`` (sorted, as strings).

    Words are runs of lower-cased letters, digits and non-ASCII characters. A
    word is hit if it lies in any occurrence of a benchmark window. Null and
    empty texts have no words; an empty benchmark hits nothing; an empty table
    gives no rows. Items without an identifier hit words but are not listed;
    items that share one are one item. Rows are judged one by one, whatever
    their identifiers: repeated ones and rows without one have their own counts.
    Further columns are ignored.
    """
    windows = materialize(windows_of(items, item_col, item_text), "windows")
    prints = fingerprints_of(windows)
    measured = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("win")), F.collect_set("n")).first()
    small = measured[0] <= BROADCAST_ROWS and (measured[1] or 0) <= BROADCAST_BYTES
    lengths = sorted(measured[2])
    bits, size = bit_map(prints, measured[0])
    view = documents_view(docs, id_col, text_col).select("_id", words_of(F.col("_text")).alias("w"))
    for k in sorted({GRAM if n == WINDOW else n for n in lengths}):
        view = view.withColumn(f"h{k}", _grams(F.col("w"), k))
    found = [_candidates(n, bits, size) for n in lengths]
    none = F.array().cast("array<struct<n:int,p:int,h:long,first:int,near:array<string>>>")
    counted = view.select("_id", F.size("w").cast("long").alias("n_words"), F.concat(none, *found).alias("found"))
    seen = materialize(counted.withColumn("_row", F.monotonically_increasing_id()), "winnowed")
    near = seen.select("_row", F.inline("found"))
    joined = join_benchmark(near, prints, ["n", "h"], small)
    start = F.col("p") - F.col("q")
    same = F.array_join(F.slice("near", start - F.col("first") + 1, F.col("n")), " ") == F.col("win")
    held = joined.filter((start >= F.col("first")) & same)
    hits = materialize(held.select("_row", start.alias("p"), "n", "win").distinct(), "hits")
    before = W.partitionBy("_row").orderBy("p", "n").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("_row", "p", "n").distinct().withColumn("end", F.col("p") + F.col("n"))
    spans = spans.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("p", "done"))
    words = spans.groupBy("_row").agg(F.sum(fresh).alias("n_hit"))
    asked = hits.select("_row", "n", "win", F.lit(0).alias("p")).distinct()
    listed = join_benchmark(asked, windows.filter("item is not null"), ["n", "win"], small)
    items_ = listed.groupBy("_row", "item").agg(F.lit(1)).groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = words.join(items_, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")
    listed_items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return seen.select("_row", "_id", "n_words").join(hit, "_row", "left").select("_id", "n_words", n_hit, listed_items)
