"""Fingerprints of paragraphs in another order, with and without a final newline."""

from spreadlab.llm import fingerprint


def test_the_last_paragraph_hashes_like_the_others(spark):
    long = " ".join(f"w{k}" for k in range(19))
    cases = [("a\nb", "b\na"), ("a\nb", "b\na\n"), (f"a\n{long}\n\nc d", f"\nc d\na\n{long}")]
    for x, y in spark.createDataFrame(cases, "x string, y string").select(fingerprint.vector(fingerprint.F.col("x")), fingerprint.vector(fingerprint.F.col("y"))).collect():
        assert x == y
    df = spark.createDataFrame([("a\nb", "c", "a\nb\nc", "b", "a\n b", "")], "ab string, c string, abc string, b string, other string, none string")
    v = {c: fingerprint.vector(df[c]) for c in df.columns}
    r = df.select(*[x.alias(c) for c, x in v.items()], fingerprint.combined(v["ab"], v["c"]).alias("added"), fingerprint.combined(v["abc"], v["c"], -1).alias("left")).first()
    assert r.added == r.abc and r.left == r.ab
    assert r.ab != r.other and r.none[0] == 0 and r.b[0] == 1
