"""The next row in order: many ranges, repeated rows that stand for each other, ids that are null or repeat."""

import hashlib
import time
from collections import Counter

import xxhash

from spreadlab.llm import fingerprint

SCHEMA = "doc_id long, text string"


def expected(rows):
    def place(r):
        return r[0] is not None, r[0] or 0, (xxhash.xxh64(r[1].encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63

    order, out = sorted(((i, t or "") for i, t in rows), key=place, reverse=True), Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    return out


def got(spark, rows, **options):
    frame = fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return Counter(tuple(r) for r in frame.select("doc_id", "n_chars", "edited_sha256").collect())


def test_repeats_and_nulls(spark):
    rows = [(i % 40, f"text {i} " * (i % 7)) for i in range(200)] + [(None, f"none {i}") for i in range(60)] + [(None, None), (None, ""), (-(2**63), "least")]
    for same in ([], [(7, "same again and again")] * 150, [(None, "x y")] * 30 + [(99, "top")] * 5 + [(-(2**63), "least")] * 2):
        assert got(spark, rows + same, range_chars=60) == expected(rows + same)
    assert got(spark, [(1, "one only")]) == expected([(1, "one only")])
    assert got(spark, [(1, "two alike")] * 2) == expected([(1, "two alike")] * 2)


def test_more_repeats_than_a_lot(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "_REPEATS", 8)
    rows = [(3, "a b c d")] * 42 + [(2, "e f"), (1, "g h i")]
    assert got(spark, rows) == expected(rows)


def test_the_plan_does_not_grow_with_the_ranges(spark):
    rows = [(i * 37 % 6007, f"{i} word {i % 11}") for i in range(6007)]
    few, many = (fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA), range_chars=c) for c in (1 << 30, sum(len(t) for _, t in rows) // 5000))
    sizes, took = [], []
    for df in (few, many):
        start = time.monotonic()
        sizes.append(len(df._jdf.queryExecution().executedPlan().toString()))
        took.append(time.monotonic() - start)
    assert abs(sizes[0] - sizes[1]) < 200 and took[1] < took[0] + 2
    assert Counter(tuple(r) for r in many.select("doc_id", "n_chars", "edited_sha256").collect()) == expected(rows)
