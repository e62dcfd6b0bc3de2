"""A paged feed as a Spark data source, for batches and streams: symbols in lanes, pages fetched on the executors.

``fetch`` names a function ``module:name`` of (symbol, start_ms, end_ms, limit) that returns a page of
rows, each a list whose first item is its time in ms or an object that has it under ``time_field``. Pages go on until one is short or the end is reached."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Spaced:
    """Calls of ``get`` at least ``seconds`` apart in this process, the first after ``delay``."""

    def __init__(self, get: Callable, seconds: float, clock: Callable = time.monotonic, sleep: Callable = time.sleep, delay: float = 0.0) -> None:
        self.get, self.seconds, self.clock, self.sleep = get, seconds, clock, sleep
        self.last = clock() + delay - seconds if delay else None

    def __call__(self, *args, **more):
        if self.last is not None and (wait := self.last + self.seconds - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        return self.get(*args, **more)


def retried(call: Callable, what: str, retries: int = 5, backoff: float = 2.0, sleep: Callable = time.sleep):
    """``call()``, again after exponential waits while the network or the server fails; Retry-After on 429 or 418 is honoured, other client errors are raised."""
    for attempt in range(retries):
        wait = backoff * 2**attempt
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code in (418, 429):
                wait = float(e.headers.get("Retry-After") or wait)
            elif e.code < 500:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            pass
        sleep(wait)
    raise RuntimeError(f"no answer from {what} after {retries} attempts")


def get_json(url: str, retries: int = 5, backoff: float = 2.0, timeout: float = 15.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    def get():
        with opener(url, timeout=timeout) as r:
            return json.load(r)

    return retried(get, url, retries, backoff, sleep)


class _Lane(InputPartition):
    """Spans (symbol, from, to in ms) that one task reads, one after another."""

    def __init__(self, number: int, lanes: int, spans: list[tuple[str, int, int]]) -> None:
        self.number, self.lanes, self.spans = number, lanes, spans


class _Pages:
    """What batch and stream have in common: spans in lanes, and pages of a span."""

    def __init__(self, options: dict) -> None:
        self.o = options
        self.symbols, self.step, self.limit = options["symbols"].split(","), int(options["step_ms"]), int(options["limit"])
        self.starts = {s: int(json.loads(options.get("starts", "{}")).get(s, options["start_ms"])) for s in self.symbols}

    def _lanes(self, spans: list[tuple[str, int, int]]) -> list[_Lane]:
        lanes = max(1, min(int(self.o.get("lanes", len(spans))), len(spans)))
        return [_Lane(k, lanes, spans[k::lanes]) for k in range(lanes)]

    def read(self, lane: _Lane) -> Iterator[tuple]:
        module, _, name = self.o["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        retries, backoff, rate = int(self.o.get("retries", 5)), float(self.o.get("backoff", 2.0)), float(self.o.get("calls_per_second", 0))
        if rate:  # a lane has its share of the host's rate, and its own place in the cycle
            fetch = Spaced(fetch, lane.lanes / rate, delay=lane.number / rate)
        when = self.o.get("time_field", "")
        moment = (lambda row: int(row[when])) if when else (lambda row: int(row[0]))
        for symbol, at, end in lane.spans:
            while at < end:
                page = retried(lambda: fetch(symbol, at, end, self.limit), f"{name} of {symbol}", retries, backoff)  # noqa: B023
                for row in page:
                    if moment(row) + self.step <= end:  # the forming bar is left out
                        yield symbol, json.dumps(row)
                if len(page) < self.limit:
                    break
                at = moment(page[-1]) + self.step


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._lanes([(s, at, int(self.o["end_ms"])) for s, at in self.starts.items()])


class _Stream(_Pages, DataSourceStreamReader):
    """Offsets are where each symbol goes on. A micro-batch reads from one offset to another, so one that failed midway is read again as it was."""

    def initialOffset(self) -> dict:
        return self.starts

    def latestOffset(self) -> dict:
        now = int(self.o["end_ms"]) if "end_ms" in self.o else int(time.time() * 1000)
        return {s: max(at, at + (now - at) // self.step * self.step) for s, at in self.starts.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Spans of what is new; a symbol that the offsets don't know yet starts at its own start."""
        spans = [(s, int(start.get(s, self.starts.get(s, 0))), int(to)) for s, to in end.items()]
        return self._lanes([x for x in spans if x[1] < x[2]])


class PagedFeed(DataSource):
    """Options: fetch, symbols (comma-separated), start_ms, end_ms, step_ms (1 for events, which have no bars), limit; starts, a JSON
    object of symbols that go on elsewhere than at start_ms; time_field for rows that are objects. Rows: symbol, raw (JSON).

    calls_per_second is the host's limit for all tasks together: each of the ``lanes`` (by default one a symbol) spaces its calls by its share of it,
    so the limit holds wherever tasks run, without a coordinator. Failed calls are tried ``retries`` times, with waits from ``backoff`` seconds on.
    As a stream, end_ms may be left out: then each micro-batch ends at the last step before now. A symbol's start and all ends lie on one grid of steps."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "symbol string, raw string"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._options())


def sample_pages(symbol: str, start: int, end: int, limit: int) -> list[list]:
    """Hourly candles by a rule, as a stand-in for a server where there is no network."""
    hour = 3_600_000
    first = -(-start // hour) * hour
    price = lambda t: f"{100 + len(symbol) + t // hour % 7}.50"
    return [[t, *[price(t)] * 4, "1.0", t + hour - 1, "", 3, "0", "0", "0"] for t in range(first, end, hour)][:limit]


def sample_funding(symbol: str, start: int, end: int, limit: int) -> list[dict]:
    """Events each five hours and some minutes, by a rule."""
    gap = 5 * 3_600_000 + 420_000
    return [{"symbol": symbol, "fundingTime": t, "fundingRate": f"0.000{t // gap % 9}", "markPrice": ""} for t in range(-(-start // gap) * gap, end, gap)][:limit]


def sample_catalogue() -> list[dict]:
    return [{"symbol": s, "baseAsset": s, "quoteAsset": "USD", "status": "TRADING", "onboardDate": 1_600_000_000_000} for s in ("AA", "BBB")]
