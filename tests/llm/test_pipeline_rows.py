"""Pipeline stages on null and repeated ids: each row counts by its own text."""

from collections import Counter

from test_llm import text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)


def ids_texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_keep_one_row_of_each_group(spark):
    import corpus_pipeline as p

    a, b, c, d, e, f = (text(700 + k, 60) for k in range(6))
    near = d + " more"
    rows = [
        (None, a), (None, b), (None, b),  # null ids: two groups, one of them a repeated row
        (7, c), (7, d), (7, near),  # one id: two groups, one of them of two texts
        (8, e), (8, e), (None, e), (9, e.upper()),  # a null id does not name a group that has others
        (3, f), (7, f), (5, None), (5, None), (None, None), (6, " "),
    ]
    got = ids_texts(p.near_duplicates(spark, frame(spark, rows), ""))
    alike = [r for r in got if r[1] in (d, near)]
    assert len(alike) == 1 and got.pop(alike[0]) == 1
    assert got == Counter([(None, a), (None, b), (7, c), (8, e), (3, f), (5, None), (None, None), (6, " ")])
    assert p.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_decontamination_judges_each_row(spark, tmp_path):
    import corpus_pipeline as p

    item = " ".join(f"secret{k}" for k in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, text(800, 40)), (1, text(801, 40)), (1, text(801, 40)), (2, None), (None, None)]
    dirty = [(None, "x " + item), (1, item), (4, item + " y")]
    assert ids_texts(p.decontamination(spark, frame(spark, clean + dirty), str(tmp_path))) == Counter(clean)


def test_rows_that_differ_in_other_columns_leave_the_least(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(30))
    others = [("fr", "b", 3), ("de", "z", 1), (None, "c", 2), ("en", "a", 9)]
    for order in (others, others[::-1], others[2:] + others[:2]):
        docs = spark.createDataFrame([(1, words, *o) for o in order] + [(2, words, "aa", "a", 0)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
        assert [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()] == [(1, words, None, "c", 2)]
