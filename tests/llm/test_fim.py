"""Fill-in-the-middle against string slicing with a regular expression."""

import hashlib
import random
import re

import pytest

from spreadlab.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text):
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows(seed=3):
    r = random.Random(seed)
    texts = ["".join(r.choice(" \t\n\x0b\x1cab<<P>SM>é漢😀 ") for _ in range(r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(300)]
    texts += [None, "", "  \n", "<P", "<P>", "word", "word ", " word", "a b\n" * 20000, "漢字 " * 9000, None]
    return [*enumerate(texts), (None, "a b c d"), (None, None), (7, "twice the id"), (7, "twice the id")]


@pytest.mark.parametrize("window", [7, 1000, fim.WINDOW])
def test_texts_of_all_kinds(spark, window, monkeypatch):
    monkeypatch.setattr(fim, "WINDOW", window)
    monkeypatch.setattr(fim, "GROUP_BYTES", 50 * window)
    given = rows(window) if window != 7 else [x for x in rows() if len(x[1] or "") < 1000]
    docs = [(i, t, h, "clash") for (i, t), h in zip(given, range(len(given)), strict=True)]
    import pyarrow as pa

    hashes = [[int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, *_ in docs] for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs]), *map(pa.array, hashes)], names=["doc_id", "text", "h1", "h2", "h3", "h4"])
    out = pa.Table.from_batches(fim._transforming([batch.slice(0, 5), batch.slice(5)]))
    assert [tuple(r.values()) for r in out.to_pylist()] == [(i, *plain(i, t or "")) for i, t, *_ in docs]
    back = pa.Table.from_batches(fim._restoring(out.select(["output", "form", "doc_id"]).combine_chunks().to_batches()))
    assert back.column("restored").to_pylist() == [t or "" for _, t, *_ in docs]


def test_spark_round_trip_with_clashing_names(spark):
    given = rows()
    docs = spark.createDataFrame([(i, t, "clash", 5, "x") for i, t in given], "doc_id long, text string, output string, n int, h1 string").repartition(3, "doc_id")
    out = fim.fill_in_middle(docs)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, *plain(i, t or "")) for i, t in given), key=key)
    back = fim.restore(out, keep=["doc_id", "n"])
    assert sorted((str(r.doc_id), r.restored) for r in back.collect()) == sorted((str(i), t or "") for i, t in given)
    assert fim.restore(fim.fill_in_middle(docs.limit(0)), keep=["doc_id"]).count() == 0


def test_an_output_without_markers_is_an_error(spark):
    with pytest.raises(Exception, match="three markers"):
        fim.restore(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string"), keep=[]).collect()
