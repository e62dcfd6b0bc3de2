"""Items of a few words against brute force, a document that is hit everywhere, and what stays in the shared folder."""

import os
import random
from collections import Counter

from spreadlab.llm import decontam

from test_llm import brute_hits, text


def judged(spark, docs, items):
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return Counter(tuple(r) for r in got.collect())


def test_short_items(spark):
    r = random.Random(9)
    words = "the of and to in is".split()
    docs = [(i, " ".join(r.choice(words + ["w%d" % r.randrange(30)]) for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, "the"), (61, "the"), (None, "of the")]
    for items in (
        [(1, "the")], [(1, "The"), (2, "the the"), (3, "of"), (4, "zebra")], [(1, "and to"), (2, "and to in"), (3, "is the of and")],
        [(1, "the"), (2, "to in"), (3, text(3, 12)), (4, docs[7][1]), (5, docs[8][1])],
    ):
        assert judged(spark, docs, items) == brute_hits(docs, items), items


def test_a_document_hit_everywhere(spark):
    span = text(5, 10)
    long = " ".join([span] * 6000)
    items = [(1, " ".join([span] * 3)), (2, span.split()[0]), (3, " ".join(span.split()[3:6]))]
    docs = [(1, long), (2, f"{long} clean {span}"), (3, "clean")]
    got = {r[0]: r[1:4] for r in judged(spark, docs, items)}
    assert got == {1: (60000, 60000, 3), 2: (60011, 60010, 3), 3: (1, 0, 0)}


def test_tables_go(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    judged(spark, [(1, text(1, 30))], [(1, text(1, 12)), (2, "a b")])
    assert {name.split("-")[0] for name in set(os.listdir(base)) - before} == {"decontaminated"}
