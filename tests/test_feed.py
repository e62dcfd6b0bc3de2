"""The paged feed as batch and stream: restarts, one rate for all tasks, and failing calls."""

import pytest

from spreadlab.sources import bars, feed

HOUR = 3_600_000
#: Fetch functions run in the workers: each call leaves a line in a file; files in the folder make calls fail.
MODULE = '''
import os, time

FOLDER, HOUR = {folder!r}, 3_600_000


def pages(symbol, start, end, limit):
    path = os.path.join(FOLDER, f"{{symbol}}-{{os.getpid()}}.calls")
    with open(path, "a") as f:
        f.write(f"{{time.time()}} {{symbol}} {{start}}\\n")
    if os.path.exists(os.path.join(FOLDER, f"fail-{{symbol}}")) and start >= 8 * HOUR:
        raise ValueError("the server is gone")
    seen = os.path.join(FOLDER, f"seen-{{symbol}}-{{start}}")
    if os.path.exists(os.path.join(FOLDER, "flaky")) and not os.path.exists(seen):
        open(seen, "w").close()
        raise ConnectionError("again, please")
    first = -(-start // HOUR) * HOUR
    return [[t, *["1.5"] * 4, "1", t + HOUR - 1, "", 1, "0", "0", "0"] for t in range(first, end, HOUR)][:limit]
'''


@pytest.fixture
def served(spark, tmp_path):
    """(folder, options) of a server of its own."""
    name = f"served_{abs(hash(str(tmp_path)))}"
    folder = tmp_path / "server"
    folder.mkdir()
    (tmp_path / f"{name}.py").write_text(MODULE.format(folder=str(folder)))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    spark.dataSource.register(feed.PagedFeed)
    return folder, {"fetch": f"{name}:pages", "symbols": "A,B,C,D", "start_ms": 0, "step_ms": HOUR, "limit": 4, "backoff": 0.01}


def calls(folder):
    out = []
    for path in folder.glob("*.calls"):
        out += [(float(t), s, int(at)) for t, s, at in map(str.split, path.read_text().splitlines())]
    return sorted(out)


def run(spark, options, tmp_path, **more):
    stream = bars.parse_klines(spark.readStream.format("paged_feed").options(**options, **more).load())
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_restarted_stream_yields_each_bar_once(spark, served, tmp_path):
    folder, options = served
    (folder / "fail-B").touch()
    with pytest.raises(Exception, match="the server is gone"):  # in the middle of a symbol's pages
        run(spark, options, tmp_path, end_ms=18 * HOUR + 5)
    assert {s for _, s, _ in calls(folder)} >= {"A", "B"}
    (folder / "fail-B").unlink()
    run(spark, options, tmp_path, end_ms=18 * HOUR + 5)
    got = lambda: sorted((r.symbol, r.open_time.day * 24 + r.open_time.hour - 24) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got() == [(s, h) for s in "ABCD" for h in range(18)]
    before = len(calls(folder))
    run(spark, options, tmp_path, end_ms=18 * HOUR + 5)  # nothing is new
    assert len(calls(folder)) == before
    run(spark, options | {"symbols": "A,B,C,D,E"}, tmp_path, end_ms=25 * HOUR)
    assert got() == sorted([(s, h) for s in "ABCD" for h in range(25)] + [("E", h) for h in range(25)])
    assert all(at >= 18 * HOUR for _, s, at in calls(folder)[before:] if s != "E")


def test_starts_and_now(spark, served):
    _, options = served
    stream = feed._Stream({k: str(v) for k, v in options.items()} | {"starts": '{"B": 7200000}'})
    assert stream.initialOffset() == {"A": 0, "B": 2 * HOUR, "C": 0, "D": 0}
    now = stream.latestOffset()
    assert all(v % HOUR == 0 for v in now.values()) and now["A"] == now["B"] > 400_000 * HOUR
    lanes = stream.partitions({"A": HOUR, "B": 2 * HOUR, "C": 5 * HOUR}, {"A": 5 * HOUR, "B": 2 * HOUR, "C": 5 * HOUR, "D": HOUR})
    assert [x.spans for x in lanes] == [[("A", HOUR, 5 * HOUR)], [("D", 0, HOUR)]]


def test_all_tasks_share_one_rate(spark, served):
    folder, options = served
    spark.read.format("paged_feed").options(**options, end_ms=HOUR).load().count()  # workers start
    before = len(calls(folder))
    got = spark.read.format("paged_feed").options(**options, end_ms=24 * HOUR, calls_per_second=10).load()
    assert got.rdd.getNumPartitions() == 4 and got.count() == 96
    times = [t for t, *_ in calls(folder)[before:]]
    assert len(times) == 4 * 6
    most = max(sum(t <= u < t + 1 for u in times) for t in times)
    assert most <= 10 + 4 and times[-1] - times[0] >= (24 - 8) / 10
    few = spark.read.format("paged_feed").options(**options, end_ms=4 * HOUR, calls_per_second=50, lanes=2).load()
    assert few.rdd.getNumPartitions() == 2 and few.count() == 16


def test_failing_calls_are_tried_again(spark, served):
    folder, options = served
    (folder / "flaky").touch()
    assert spark.read.format("paged_feed").options(**options, end_ms=10 * HOUR).load().count() == 40
    assert len(calls(folder)) == 2 * 4 * 3
    with pytest.raises(Exception, match="no answer"):
        spark.read.format("paged_feed").options(**options | {"retries": 1, "start_ms": 20 * HOUR}, end_ms=30 * HOUR).load().count()


def test_spacing_and_its_first_place():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    spaced = feed.Spaced(lambda: now[0], 2.0, clock=lambda: now[0], sleep=sleep, delay=0.5)
    assert [spaced(), spaced()] == [0.5, 2.5] and slept == [0.5, 2.0]
