"""Parquet tables that change as a whole: new files are written apart, and one small manifest, published last, makes them the table.

``<path>/versions/<number>.json`` names the data folders of a version, ``<path>/data/commit=<name>``. A job that is killed before it has published leaves
the last version as it was, and files that :func:`vacuum` removes. Of two writers that start from one version the second
gets a :class:`Conflict`, since a number is published once; :func:`update` then builds its rows anew. Every
version can be read until it is vacuumed. With ``month_of`` files lie in folders by month, so that reads of a span open only its months."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


class Conflict(RuntimeError):
    """Another writer has published the version."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when they last changed, in ms."""
    _, fs, at = _files(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending."""
    return sorted(int(n[:-5]) for n, _ in _names(spark, f"{path}/versions") if n.endswith(".json") and n[0] != ".")


def current(spark: SparkSession, path: str) -> int:
    """The newest version, 0 before the first."""
    return max(numbers(spark, path), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> list[str]:
    _, fs, at = _files(spark, f"{path}/versions/{version:012}.json")
    if not fs.exists(at):
        raise ValueError(f"{path} has no version {version}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))["folders"]
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    """A manifest is written under another name and renamed, which fails where the version exists."""
    jvm, fs, hidden = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(json.dumps({"folders": folders}).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri() if hidden.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version:012}.json")), none)
    except Exception as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} of {path} was published by another writer") from None
        raise


def commit(df: DataFrame, path: str, base: int, append: bool = False, month_of: str | None = None) -> int:
    """Publishes df (with ``append`` after what version ``base`` has) as version base + 1."""
    spark, name = df.sparkSession, f"commit={uuid.uuid4().hex}"
    before = _manifest(spark, path, base) if append and base else []
    if month_of:
        df = df.withColumn(MONTH, F.date_format(F.col(month_of).cast("timestamp"), "yyyy-MM")).hint("rebalance", MONTH)
        by = [c for c in ("symbol", month_of) if c in df.columns]
        df.sortWithinPartitions(MONTH, *by).write.partitionBy(MONTH).parquet(f"{path}/data/{name}")
    else:
        df.write.parquet(f"{path}/data/{name}")
    _publish(spark, path, base + 1, [*before, name])
    return base + 1


def read(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None, month_of: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The rows of a version, by default of the newest; none where there is no version yet (then ``schema`` is needed).
    ``start`` and ``end`` are half-open bounds of ``month_of``: constants, which prune folders."""
    version = current(spark, path) if version is None else version
    folders = _manifest(spark, path, version) if version else []
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{path}/data")
    if schema:
        reader = reader.schema(", ".join([schema, "commit string", *[f"{MONTH} string"] * bool(month_of)]))
    rows = reader.parquet(*[f"{path}/data/{f}" for f in folders]).drop("commit")
    if not month_of:
        return rows
    month = lambda at: F.date_format(at.cast("timestamp"), "yyyy-MM")
    if start is not None:
        rows = rows.where((F.col(MONTH) >= month(start)) & (F.col(month_of) >= start))
    if end is not None:
        rows = rows.where((F.col(MONTH) <= month(end)) & (F.col(month_of) < end))
    return rows.drop(MONTH)


def update(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], append: bool = False, month_of: str | None = None, attempts: int = 5) -> int:
    """Commits ``build(the newest rows)``; where another writer was first, builds anew from what it has published."""
    for _ in range(attempts):
        base = current(spark, path)
        try:
            return commit(build(read(spark, path, schema, base, month_of)), path, base, append, month_of)
        except Conflict:
            pass
    raise Conflict(f"{path} changed {attempts} times meanwhile")


def replace(df: DataFrame, path: str, month_of: str | None = None) -> int:
    """Publishes df in place of whatever is newest."""
    return update(df.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), lambda _: df, month_of=month_of)


def vacuum(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Removes all versions but the last ``keep``, and data folders that no kept version names, unless they are younger than ``hours``: their writer may not have published yet."""
    _, fs, _ = _files(spark, path)
    kept, old = (lambda n: (n[-keep:], n[:-keep]))(numbers(spark, path))
    named = {f for v in kept for f in _manifest(spark, path, v)}
    before = 1000 * (time.time() - 3600 * hours)
    gone = [f for f, changed in _names(spark, f"{path}/data") if f not in named and changed <= before]
    for v in old:
        fs.delete(_files(spark, f"{path}/versions/{v:012}.json")[2], False)
    for f in gone:
        fs.delete(_files(spark, f"{path}/data/{f}")[2], True)
    return gone
