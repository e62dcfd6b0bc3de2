"""Study parameters: two presets and small ones for the test tables."""

from __future__ import annotations

import itertools
import os
from dataclasses import dataclass, field, replace

#: Bars in a year by interval.
BARS_PER_YEAR = {"15m": 35040, "1h": 8760, "4h": 2190, "1d": 252}
STEP_SECONDS = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
#: Names the YAML file of the study where no path is given.
ENV = "SPREADLAB_CONFIG"


@dataclass(frozen=True)
class Grid:
    deltas: tuple[float, ...] = (1e-5, 1e-7, 1e-8)
    windows: tuple[int, ...] = (720, 1440)
    entries: tuple[float, ...] = (1.5, 2.0, 2.5)
    exits: tuple[float, ...] = (0.0, 0.5)
    stops: tuple[float, ...] = (3.0, 4.0)

    def product(self) -> list[tuple[float, int, float, float, float]]:
        return list(itertools.product(self.deltas, self.windows, self.entries, self.exits, self.stops))


@dataclass(frozen=True)
class Study:
    exchange: str = "main"
    market: str = "perp"
    interval: str = "1h"
    start: str = "2021-01-01"
    end: str | None = None
    #: The last day of the training bars.
    train_end: str = "2024-12-31"
    #: Symbols that are screened, and more that only serve as factor or benchmark.
    universe: tuple[str, ...] = ()
    aux: tuple[str, ...] = ()
    book: tuple[tuple[str, str], ...] = ()
    factor: str | None = None
    benchmarks: tuple[str, ...] = ()
    #: Keeps the reports and series of a study apart from those of others.
    subdir: str = ""
    use_log_prices: bool = True
    fee_bps: float = 5.0
    slip_bps: float = 2.0
    borrow_bps_per_year: float = 0.0
    next_open: bool = False
    min_overlap: int = 8760
    adf_alpha: float = 0.05
    half_life: tuple[float, float] = (24.0, 720.0)
    delta: float = 1e-5
    burn_in: int = 720
    window: int = 1440
    entry: float = 2.0
    exit: float = 0.0
    stop: float = 3.0
    trades_per_year: float = 15.0
    train_bars: int = 17520
    test_bars: int = 2160
    max_pairs: int = 3
    regime_window: int = 720
    eg_window: int = 8760
    eg_step: int = 720
    #: Of all tasks together, to one host of the feed.
    calls_per_second: float = 20.0
    cost_multipliers: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0)
    grid: Grid = field(default_factory=Grid)

    @property
    def bars_per_year(self) -> int:
        return BARS_PER_YEAR[self.interval]

    @property
    def seconds(self) -> int:
        return STEP_SECONDS[self.interval]

    @property
    def borrow_per_bar(self) -> float:
        return self.borrow_bps_per_year / 1e4 / self.bars_per_year

    @property
    def symbols(self) -> tuple[str, ...]:
        """Universe and aux, each once."""
        return tuple(dict.fromkeys((*self.universe, *self.aux)))


HOURLY = Study()
DAILY = Study(
    market="equity", interval="1d", fee_bps=0.0, borrow_bps_per_year=30.0, next_open=True, min_overlap=252, half_life=(5.0, 60.0), burn_in=63, window=42,
    trades_per_year=10.0, train_bars=504, test_bars=63, regime_window=21, eg_window=252, eg_step=21, grid=Grid(windows=(21, 42)),
)
#: For the queries: windows that fit the month of hourly bars of the test tables.
SMALL = replace(
    HOURLY, borrow_bps_per_year=30.0, min_overlap=100, half_life=(0.0, 720.0), burn_in=48, window=24, train_bars=300, test_bars=120, regime_window=24, eg_window=200, eg_step=100,
    trades_per_year=15.0, grid=Grid(windows=(12, 24)),
)


def _fixed(v):
    return tuple(_fixed(x) for x in v) if isinstance(v, list) else v


def load(path: str | None = None, base: Study | None = None) -> Study:
    """A study from a YAML file that names fields of Study; ``grid`` is a mapping of its own, ``interval: 1d`` starts from the
    daily preset. Without a path the file that the environment names; without that, the preset itself. Dates count as text; unknown names are errors."""
    path = path or os.environ.get(ENV)
    given = {}
    if path:
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
    base = base or (DAILY if given.get("interval") == "1d" else HOURLY)
    grid = {k: _fixed(v) for k, v in (given.pop("grid", None) or {}).items()}
    given = {k: str(v) if k in ("start", "end", "train_end") and v is not None else _fixed(v) for k, v in given.items()}
    return replace(base, grid=replace(base.grid, **grid), **given)
