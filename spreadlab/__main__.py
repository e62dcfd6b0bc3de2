"""``python -m spreadlab STAGE --root FOLDER [--config FILE]``: the stages of a study, one or all."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from . import stages
from .config import load
from .session import session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spreadlab", description=__doc__)
    p.add_argument("stage", choices=["ingest", "ingest-daily", *stages.STAGES, "all"])
    p.add_argument("--root", required=True, help="folder of tables, series and reports")
    p.add_argument("--config", help="YAML file of the study; otherwise the one in SPREADLAB_CONFIG")
    p.add_argument("--fetch", action="append", default=[], metavar="KIND=MODULE:FUNCTION", help="ingest: bars, premium, funding or catalogue")
    p.add_argument("--frames", help="ingest-daily: Parquet of symbol, open_time, open, high, low, close, volume")
    a = p.parse_args(argv)
    store = stages.Store(session(), a.root, load(a.config))
    if a.stage == "ingest":
        stages.ingest(store, dict(x.split("=", 1) for x in a.fetch), int(time.time() * 1000))
    elif a.stage == "ingest-daily":
        if not a.frames:
            p.error("ingest-daily needs --frames")
        stages.ingest_daily(store, store.spark.read.parquet(a.frames), store.spark.range(1).select(F.current_date().cast("string")).first()[0])
    for path in stages.run_all(store) if a.stage == "all" else [stages.STAGES[a.stage](store)] if a.stage in stages.STAGES else []:
        print(path)


if __name__ == "__main__":
    main()
