"""Sources and sinks: bars, raw feeds, upserts."""
