"""Records and ticks as streams: provisional rows replaced as they are fetched again, and bars with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import calendar as cal
from ..sources import store


def refresh(fetched: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Stream of fetched records into the raw store: each micro-batch replaces rows by time in the partitions that it touches."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_raw(batch, root)

    return fetched.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)


def bars(ticks: DataFrame, keys: list[str], interval: str, late: str = "10 minutes") -> DataFrame:
    """Stream of ticks (keys, ts, seq, price, spread) to bars of minutes or hours; a bar is final once its window is ``late`` behind.

    Windows are of UTC time, which New York's 17:00 agrees with for intervals that divide an hour.
    """
    unit, count = cal.INTERVALS[interval]
    if unit not in cal.SECONDS or cal.SECONDS[unit] * count > 3600:
        raise ValueError("streamed bars are of an hour at most")
    order = F.struct("ts", "seq")
    window = F.window("ts", f"{cal.SECONDS[unit] * count} seconds")
    out = ticks.withWatermark("ts", late).groupBy(*keys, window.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.max("spread").alias("max_spread"), F.count("*").alias("ticks")
    )
    return out.select(*keys, F.col("w.start").alias("time"), "open", "high", "low", "close", "max_spread", "ticks")
