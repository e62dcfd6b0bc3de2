"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset a temporary folder stands in on one machine, as in tests; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spreadlab-")
        base = _OWN[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, whichever executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables from :func:`written` that are no longer needed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Arrow batches of about ``n_bytes`` at most (a row may be larger) for what is written inside; then the session's setting is back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key with one in so many of all rows is hot: at most so many keys are.
HOT_KEYS = 1000


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has a row per key ``on`` and in ``weight`` how many of the ``total`` rows have that key.

    A hot key would make a task of a shuffle too large. At most HOT_KEYS keys are hot; their hashes come to the driver, their rows of
    ``unique`` are broadcast, and only the rows of all other keys are shuffled."""
    mark = F.xxhash64(*on)
    found = [r[0] for r in unique.where(F.col(weight) * HOT_KEYS >= total).select(mark).distinct().collect()]
    if not found:
        return rows.join(unique, on)
    hot = mark.isin(found)
    return rows.where(hot).join(F.broadcast(unique.where(hot)), on).unionByName(rows.where(~hot).join(unique.where(~hot), on))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(col):
    """A-Z to a-z and nothing else, so that it means the same in any locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
