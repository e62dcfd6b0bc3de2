"""The signal stream equals the batch, over restarts from its checkpoint, and forgets silent pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import hours, ou, walk

from spreadlab.operators import signals
from spreadlab.streaming.signals import stream_signals

RULE = (48, 1e-5, 24, 1.5, 0.0, 3.0)
SCHEMA = "leg_y string, leg_x string, open_time timestamp_ntz, close_y double, close_x double"


def bars(n=260):
    rng = np.random.default_rng(3)
    out = []
    for pair in (("a", "b"), ("c", "d")):
        x = walk(rng, n)
        out.append(pd.DataFrame({"leg_y": pair[0], "leg_x": pair[1], "open_time": hours(n), "close_y": np.exp(0.2 + x + ou(rng, 0.8, 0.01, n)), "close_x": np.exp(x)}))
    return pd.concat(out)


def put(spark, pdf, folder):
    spark.createDataFrame(pdf).withColumn("open_time", F.col("open_time").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(folder))


def go_on(spark, tmp_path, **more):
    live = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stream_signals(live, *RULE, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_restarts_give_the_batchs_rows(spark, tmp_path):
    pdf = bars()
    when = pd.Series(pdf["open_time"].to_numpy(), index=pdf.index)
    cuts = [0, 30, 49, 50, 120, 260]  # within the burn-in, at its end, and after
    for a, b in zip(cuts, cuts[1:], strict=False):
        times = hours(260)[a:b]
        put(spark, pdf[when.isin(times) & ~((pdf["leg_y"] == "c") & (b == 50))], tmp_path / "in")
        if b == 120:
            put(spark, pdf[when.isin(hours(260)[49:50]) & (pdf["leg_y"] == "c")], tmp_path / "late")
        go_on(spark, tmp_path)  # each time a new query on the same checkpoint
    missed = hours(260)[49]
    rows = spark.createDataFrame(pdf[~((pdf["leg_y"] == "c") & (when == missed))]).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    batch = signals.with_positions(signals.signal_frame(rows, 48, (1e-5,), 24), [RULE[3:]], ("delta",))
    want = {(r.leg_y, r.open_time): r for r in batch.collect()}
    got = {(r.leg_y, r.open_time): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and any(r.desired for r in want.values())
    for k, r in got.items():
        assert (r.desired, r.beta) == (want[k].desired, pytest.approx(want[k].beta, abs=1e-12))
        assert (r.z is None) == (want[k].z is None) and (r.z is None or r.z == pytest.approx(want[k].z, abs=1e-8))


def test_a_silent_pair_starts_anew(spark, tmp_path):
    pdf = bars(200)
    one, two = pdf[pdf["leg_y"] == "a"], pdf[pdf["leg_y"] == "c"]
    later = lambda df, days: df.assign(open_time=df["open_time"] + pd.Timedelta(days=days))
    for part in (one[:100], later(two[:60], 40), later(two[60:70], 40), later(one[100:], 60)):
        put(spark, part, tmp_path / "in")
        go_on(spark, tmp_path, silent="20 days")
    got = spark.read.parquet(str(tmp_path / "out")).where("leg_y = 'a'")
    fresh = later(one[100:], 60).reset_index(drop=True)
    rows = spark.createDataFrame(pd.concat([one[:100].assign(leg_x="first"), fresh.assign(leg_x="again")])).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    want = signals.signal_frame(rows, 48, (1e-5,), 24)
    assert sorted((r.open_time, round(r.beta, 9)) for r in got.collect()) == sorted((r.open_time, round(r.beta, 9)) for r in want.collect())


def test_the_state_store_is_checked(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            stream_signals(spark.readStream.schema(SCHEMA).parquet(str(tmp_path)), *RULE)
    finally:
        spark.conf.set(key, was)
