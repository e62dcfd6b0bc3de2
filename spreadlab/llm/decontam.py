"""Benchmark decontamination by winnowing, in column functions only.

Of each run of ``WINDOW - GRAM + 1`` hashes of GRAM-word grams the least is a fingerprint. Any span
of WINDOW words that a document shares with a benchmark item holds such a run, the same in
both, so they share a fingerprint: the join of distinct fingerprints misses no document. In the
documents it finds, hits are extended: every WINDOW-word window is compared with the
items' windows by two independent 64-bit hashes of its words, and windows that occur mark their words.

Items of fewer words are one window each. A document that has the first two words of one goes through the same
pass, in which its windows of all widths that occur are compared. Items of one word are looked up among the words alone,
so that a frequent word sends no document through the windows.

Windows mark words by their hashes alone, and a document's distinct windows name the items afterwards, so
a window that many items share is not multiplied by the places where it occurs. The words marked are counted
over the hits in order of place, each adding what lies past the farthest end before it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, remove, written

WINDOW, GRAM = 10, 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case (A-Z only) runs of letters and digits; everything outside ASCII counts as a letter.

    The text is split at the runs between them, for collecting the matches of a pattern takes six times as long."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _runs(values: Column, width: int, make) -> Column:
    """make(place, columns) for each run of ``width`` values; none where there are fewer.

    The run comes as ``width`` columns, not as a slice, which would be a new array at each place."""
    starts = F.when(F.size(values) >= width, F.sequence(F.lit(0), F.size(values) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make(i, [F.get(values, i + j) for j in range(width)]))


def _bound(value: Column, make) -> Column:
    """make(value) with the value worked out once."""
    return F.transform(F.array(value), make)[0]


def fingerprints(ws: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Distinct least gram hashes of all sliding windows of grams."""
    least = lambda _, hashes: F.least(*hashes) if len(hashes) > 1 else hashes[0]
    grams = _bound(ws, lambda w: _runs(w, gram, lambda _, g: F.xxhash64(*g)))
    return F.array_distinct(_bound(grams, lambda gs: _runs(gs, window - gram + 1, least)))


def windows(ws: Column, widths: list[int]) -> Column:
    """array<struct<pos,width,one,two>>: place and two hashes of each window of each of the widths."""

    def of(width: int):
        return lambda i, run: F.struct(i.alias("pos"), F.lit(width).alias("width"), F.xxhash64(*run).alias("one"), F.xxhash64(F.lit(7), *run).alias("two"))

    return _bound(ws, lambda w: F.concat(*[_runs(w, width, of(width)) for width in widths]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit (words inside any occurrence of an item's
    window), n_items, items_sha256 (of the sorted comma-joined item ids as strings) and contaminated.

    Null and wordless texts have no words and no hits; wordless items have no windows. Rows that repeat an id
    are judged each by its own text. Items with a null id mark words but are not counted as items; repeated items count once.
    Empty tables are fine on either side; other columns don't matter."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id").alias("k2"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("ws"))
    items = written(items.withColumn("n", F.size("ws")).where("n > 0"), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # nine values at most
    wide = [n for n in short if n > 1] + [window]

    prints = lambda ws: fingerprints(ws, window, gram)
    pairs = lambda ws: F.array_distinct(_runs(ws, 2, lambda _, two: F.xxhash64(F.lit("pair"), *two)))
    each = lambda ws: F.array_distinct(F.transform(ws, lambda x: F.xxhash64(F.lit("word"), x)))
    marked = F.when(F.col("n") >= window, prints(F.col("ws"))).when(F.col("n") > 1, pairs(F.slice("ws", 1, 2))).otherwise(each(F.col("ws")))
    marks = items.select(F.explode(marked).alias("print"), (F.col("n") == 1).alias("single")).distinct()
    looks = [prints] + [pairs] * (len(wide) > 1) + [each] * (1 in short)
    told = lambda ws: _bound(ws, lambda w: F.concat(*[look(w) for look in looks]))
    pages = keyed.select("k1", "k2", F.explode(told(words(F.col("text")))).alias("print"))
    hot = pages.join(marks, "print").groupBy("k1", "k2").agg(F.bool_or("single").alias("single"), F.bool_or(~F.col("single")).alias("several"))

    of_items = [items.where(F.col("n") >= window).select("item", F.explode(windows(F.col("ws"), [window])).alias("w"))]
    of_items += [items.where(F.col("n") == n).select("item", F.explode(windows(F.col("ws"), [n])).alias("w")) for n in short]
    known = functools.reduce(DataFrame.union, of_items).select("item", "w.width", "w.one", "w.two").distinct()
    known = written(known, "windows")

    found = keyed.join(hot, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "single", "several", words(F.col("text")).alias("ws"))
    none = F.expr("cast(array() as array<struct<pos:int,width:int,one:bigint,two:bigint>>)")
    spots = F.when(F.col("several"), windows(F.col("ws"), wide)).otherwise(none)
    if 1 in short:
        spots = F.concat(spots, F.when(F.col("single"), windows(F.col("ws"), [1])).otherwise(none))
    places = found.select("k1", "k2", F.explode(spots).alias("w")).select("k1", "k2", "w.*")
    hits = written(places.join(known.select("width", "one", "two").distinct(), ["width", "one", "two"], "left_semi"), "hits")
    ends = hits.groupBy("k1", "k2", "pos").agg(F.max(F.col("pos") + F.col("width")).alias("end"))
    before = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("fresh", F.col("end") - F.greatest("pos", before))
    marks = ends.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), "fresh")).cast("long").alias("n_hit"))
    named = hits.select("k1", "k2", "width", "one", "two").distinct().join(known, ["width", "one", "two"]).groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    named = named.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    per = marks.join(named, ["k1", "k2"])
    counted = keyed.select("id", "k1", "k2", word_count(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    out = counted.join(per, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
    out = written(out, "decontaminated")
    remove(docs.sparkSession, items, known, hits)
    return out
