"""The grid of the registered queries: only its windows are scaled."""

from dataclasses import replace

from spreadlab.config import HOURLY, SMALL


def test_query_grid_is_whole():
    assert len(SMALL.grid.product()) == 72
    assert replace(SMALL.grid, windows=HOURLY.grid.windows) == HOURLY.grid
