"""Extension, not parity: the same rates as the batch checks, over a stream and in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_windows(events: DataFrame, time_col: str, rules: dict[str, Column], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, n_rows and, for each rule, the rows that break it. Works on a stream, where rows later than ``late``
    are left out, and on a table; a rule that is null for a row isn't broken by it."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    counted = events.groupBy(F.window(time_col, width).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(~ok).alias(name) for name, ok in rules.items()))
    return counted.select(F.col("w.start").alias("window_start"), "n_rows", *rules)
