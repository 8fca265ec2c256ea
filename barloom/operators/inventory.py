"""Inventory of raw partitions: counts, completeness, duplicates and month holes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitions(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition (keys) of ``records`` (keys, line_no, time, complete): row_count, incomplete_rows, first_time, last_time and last_complete.

    Of several rows with the last time the one with the lowest line number tells last_complete.
    """
    last = F.struct(F.col("time"), (-F.col("line_no")).alias("minus"))
    return records.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.count_if(~F.col("complete")).alias("incomplete_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max_by("complete", last).alias("last_complete")
    )


def duplicate_times(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition with any: the times that more than one row has, sorted."""
    twice = records.groupBy(*keys, "time").count().where(F.col("count") > 1)
    return twice.groupBy(*keys).agg(F.sort_array(F.collect_list("time")).alias("duplicate_times"))


def month_holes(months: DataFrame, keys: list[str]) -> DataFrame:
    """Months between the first and the last partition of each key that have none. ``months``: keys, year, month."""
    at = F.make_date("year", "month", F.lit(1))
    have = months.select(*keys, at.alias("_m")).distinct()
    span = have.groupBy(*keys).agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"))
    every = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    return every.join(have, [*keys, "_m"], "left_anti").select(*keys, F.year("_m").alias("year"), F.month("_m").alias("month"))


def upsert(existing: DataFrame, fetched: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """Union by ``keys``; a fetched row replaces the stored one, and of several fetched ones the last by ``sequence`` stays. A partial aggregate, no sort."""
    columns = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_prio", F.lit(0)).unionByName(fetched.withColumn("_prio", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_prio", sequence)).alias("r"))
    return best.select(*keys, "r.*")


def fetch_windows(latest: DataFrame, now) -> DataFrame:
    """From and to of the next fetch of each partition (month_start, month_end, last_time, last_complete): after a complete last row, from a provisional one, or from the month's start; up to now or the month's end."""
    start = F.when(F.col("last_time").isNull(), F.col("month_start")).otherwise(F.col("last_time"))
    exclusive = F.coalesce(F.col("last_time").isNotNull() & F.col("last_complete"), F.lit(False))
    return latest.withColumns({"fetch_from": start, "from_exclusive": exclusive, "fetch_to": F.least(now, F.col("month_end"))})
