"""Tables of versions: broken-off writes, two writers, old versions, pruning and sizes of reports."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_core import T0

from spreadlab import stages
from spreadlab.config import Study
from spreadlab.plans import report
from spreadlab.sources import upsert, versions

SCHEMA = "symbol string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_version_is_readable_and_none_is_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) == 0 and rows(versions.read(spark, path, SCHEMA)) == []
    one, two = (spark.createDataFrame([(s, i)], SCHEMA) for i, s in enumerate("ab"))
    assert versions.replace(one, path) == 1 and versions.update(spark, path, SCHEMA, lambda _: two, append=True) == 2
    assert versions.replace(two.limit(0), path) == 3
    assert [rows(versions.read(spark, path, SCHEMA, v)) for v in (1, 2, 3)] == [[("a", 0)], [("a", 0), ("b", 1)], []]
    assert rows(versions.read(spark, path)) == [] and rows(versions.read(spark, path, version=2)) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="no version 4"):
        versions.read(spark, path, SCHEMA, 4)


@pytest.mark.parametrize("at", ["while writing", "before the manifest", "while publishing"])
def test_a_killed_rewrite_leaves_the_old_table(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    versions.replace(old, path)
    with monkeypatch.context() as m:
        new = old.withColumn("n", F.when(F.col("symbol") == "b", F.raise_error(F.lit("killed")).cast("int")).otherwise(F.lit(9))) if at == "while writing" else old.limit(1)

        def killed(*_):
            if at == "while publishing":
                Path(path, "versions", ".left").write_text('{"fold')
            raise RuntimeError("killed")

        if at != "while writing":
            m.setattr(versions, "_publish", killed)
        with pytest.raises(Exception, match="killed"):
            versions.replace(new, path)
    assert rows(versions.read(spark, path, SCHEMA)) == rows(old) and versions.current(spark, path) == 1
    assert versions.replace(old.limit(1), path) == 2 and versions.read(spark, path).count() == 1
    assert versions.vacuum(spark, path, keep=2, hours=24) == []  # a writer may be at work
    gone = versions.vacuum(spark, path, keep=1, hours=0)
    assert len(gone) == 2 and len(list(Path(path, "data").iterdir())) == 1
    assert versions.numbers(spark, path) == [2] and versions.read(spark, path).count() == 1


def test_of_two_writers_the_second_starts_again(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = (spark.createDataFrame([(s, i)], SCHEMA) for i, s in enumerate("ab"))
    versions.replace(a, path)
    base = versions.current(spark, path)
    versions.commit(b, path, base, append=True)
    with pytest.raises(versions.Conflict):
        versions.commit(a, path, base)
    assert rows(versions.read(spark, path, SCHEMA)) == [("a", 0), ("b", 1)]
    built = []

    def build(there):
        built.append(rows(there))
        if len(built) == 1:  # another is faster
            versions.commit(b.withColumn("symbol", F.lit("c")), path, versions.current(spark, path), append=True)
        return upsert.keep_first(there, spark.createDataFrame([("c", 7), ("d", 7)], SCHEMA), ["symbol"], ["n"])

    assert versions.update(spark, path, SCHEMA, build) == 4
    assert built == [[("a", 0), ("b", 1)], [("a", 0), ("b", 1), ("c", 1)]]
    assert rows(versions.read(spark, path, SCHEMA)) == [("a", 0), ("b", 1), ("c", 1), ("d", 7)]
    with pytest.raises(versions.Conflict, match="2 times"):
        versions.update(spark, path, SCHEMA, lambda there: (versions.replace(a, path), a)[1], attempts=2)


def test_a_span_opens_its_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.createDataFrame([(s, T0 + dt.timedelta(days=d), d) for d in range(0, 120, 3) for s in ("a", "b")], "symbol string, open_time timestamp_ntz, n int")
    versions.replace(days.where("n < 60"), path, "open_time")
    versions.update(spark, path, "symbol string, open_time timestamp_ntz, n int", lambda _: days.where("n >= 60"), append=True, month_of="open_time")
    start, end = (F.lit(T0 + dt.timedelta(days=d)).cast("timestamp_ntz") for d in (40, 70))
    read = versions.read(spark, path, "symbol string, open_time timestamp_ntz, n int", month_of="open_time", start=start, end=end)
    assert rows(read) == rows(days.where("n >= 40 and n < 70")) and read.columns == days.columns
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters" in plan
    months = lambda df: {f.split("month=")[1][:7] for f in spark.createDataFrame(df.select(F.input_file_name().alias("f")).distinct().collect()).toPandas()["f"]}
    assert months(read) == {"2024-02", "2024-03"}
    whole = versions.read(spark, path, "symbol string, open_time timestamp_ntz, n int", month_of="open_time")
    assert rows(whole) == rows(days) and months(whole) == {"2024-01", "2024-02", "2024-03", "2024-04"}
    scan = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles()
    assert scan(read) < scan(whole)


def test_long_reports_count_their_rows_and_keep_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "MAX_ROWS", 3)
    store = stages.Store(spark, str(tmp_path), Study(subdir="try"))
    df = spark.range(10).orderBy("id")
    told = store.table("pairs", df)
    assert told.count("\n| ") == 3 and f"The first 3 of 10 rows; all are in {tmp_path}/reports/try/pairs-rows." in told
    assert versions.read(spark, f"{tmp_path}/reports/try/pairs-rows").count() == 10
    assert "first" not in store.table("few", df.limit(3)) and versions.current(spark, f"{tmp_path}/reports/try/few-rows") == 0


def test_sixty_symbols_are_screened_and_reported(spark, tmp_path):
    symbols = tuple(f"S{i:02}" for i in range(60))
    study = Study(start="2024-01-01", train_end="2024-01-03", universe=symbols, min_overlap=40, half_life=(0.1, 500.0))
    store = stages.Store(spark, str(tmp_path), study)
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 48 as int))")
    price = (100 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).cast("decimal(38,18)")
    bars = spark.range(60 * 48).select(F.format_string("S%02d", F.floor(F.col("id") / 48)).alias("symbol"), at.alias("open_time"), *[price.alias(c) for c in ("open", "high", "low", "close", "volume")], F.lit(None).cast("decimal(38,18)").alias("quote_volume"), F.lit(1).cast("bigint").alias("n_trades"))
    store.replace("ohlcv", bars)
    told = Path(stages.pairs(store)).read_text()
    assert "of 1770 pairs pass" in told and "The first 1000 of 1770 rows" in told
    assert store.read("pair_screen", None, train_end="2024-01-03").count() == 1770
