"""Idempotent writes as joins: keep the first version of a fact, or the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Existing rows and the new rows of keys that are not there yet, the first by ``order`` of each.
    min_by over a struct is combined before the shuffle; a window would not be."""
    rest = [c for c in new.columns if c not in key]
    fresh = new.join(existing.select(*key).distinct(), key, "left_anti")
    fresh = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
    return existing.unionByName(fresh.select(*existing.columns))


def keep_last(batches: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version by ``order`` of each key; null volumes become 0."""
    rest = [c for c in batches.columns if c not in key]
    out = batches.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0).cast(out.schema["volume"].dataType))) if "volume" in rest else out


def resume_cursor(df: DataFrame, by: str, time: str, step_seconds: float, fallback: Column) -> DataFrame:
    """Where ingestion of each key goes on: a step after its last time."""
    return df.groupBy(by).agg(F.coalesce(F.max(time) + F.make_dt_interval(secs=F.lit(step_seconds)), fallback).alias("resume_at"))


def symbols_missing(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted symbols that the catalogue does not have."""
    return wanted.join(known, "symbol", "left_anti")


def upsert_catalogue(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Known symbols with the new status and onboarding where there are such, and the symbols that are new."""
    fresh = ["status", "onboard_date"]
    merged = existing.join(new.select("symbol", F.lit(True).alias("_told"), *[F.col(c).alias(f"_{c}") for c in fresh]), "symbol", "left")
    merged = merged.withColumns({c: F.when(F.col("_told"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fresh}).select(*existing.columns)
    return merged.unionByName(symbols_missing(new, existing).select(*existing.columns))


def scope_path(path: str, scope: dict[str, str]) -> str:
    return "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in scope.items()]])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_net_csv(spark, path: str) -> DataFrame:
    """An out-of-sample series (time, net) from CSV, with its schema stated."""
    return spark.read.option("header", "true").schema("open_time timestamp_ntz, net double").csv(path)
