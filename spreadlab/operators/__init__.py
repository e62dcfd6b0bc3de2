"""DataFrame operators: panels, gaps, statistics, signals, backtests, validation, metrics."""
