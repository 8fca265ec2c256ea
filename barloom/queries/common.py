"""Shared by the query modules: table access and SQL snippets.

``events`` stand in for ticks: event_type is the symbol, value the price (whole 1e-4), props.k the spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def as_text(df: DataFrame, *times: str) -> DataFrame:
    """Times as 'yyyy-MM-dd HH:mm:ss', whatever the session's zone is."""
    return df.withColumns({c: text(c) for c in times})


def units(c: str, places: int) -> Column:
    """Raw units of a double that has ``places`` decimals."""
    return F.floor(F.col(c) * 10**places + 0.5).cast("bigint") * 10 ** (8 - places)


def wide_units(c: str, places: int) -> Column:
    """``units`` for sums and products that 64 bits may not hold."""
    return units(c, places).cast("decimal(38,0)")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), units("value", 4).alias("price"), (k * 1000).alias("spread"))


def bucket_ticks(spark: SparkSession, sf_dir: str, buckets: int) -> DataFrame:
    """Ticks of many six-letter symbols: the first three letters of the type, and the user's number modulo ``buckets``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    symbol = F.concat(F.upper(F.substring("event_type", 1, 3)), F.lpad((F.col("user_id") % buckets).cast("string"), 3, "0"))
    return table(spark, sf_dir, "events").select(symbol.alias("symbol"), "ts", F.col("event_id").alias("seq"), units("value", 4).alias("price"), (k * 1000).alias("spread"))


# the same in DuckDB SQL

TICKS = """SELECT event_type AS symbol, ts, event_id AS seq, CAST(floor(value * 10000 + 0.5) AS BIGINT) * 10000 AS price,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS spread FROM events"""


def bucket_ticks_sql(buckets: int) -> str:
    return TICKS.replace("event_type AS symbol", f"upper(substr(event_type, 1, 3)) || lpad(CAST(user_id % {buckets} AS VARCHAR), 3, '0') AS symbol")


def local(ts: str) -> str:
    return f"timezone('America/New_York', timezone('UTC', {ts}))"


def utc(at: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', {at}))"


def session_date(ts: str) -> str:
    return f"CAST({local(ts)} - INTERVAL 17 HOUR AS DATE)"


def day_at(date: str, hour: int = 17) -> str:
    return utc(f"(CAST({date} AS TIMESTAMP) + INTERVAL {hour} HOUR)")


def bar_start(ts: str, interval: str) -> str:
    d = session_date(ts)
    if interval == "d1":
        return day_at(d)
    if interval == "w1":
        return day_at(f"({d} - CAST(dayofweek({d}) AS INTEGER))")
    step = {"m1": 60, "h1": 3600, "h4": 14400}[interval]
    s = day_at(d)
    return f"({s} + to_seconds(CAST(floor((epoch_us({ts}) - epoch_us({s})) / {step * 1000000}.0) AS BIGINT) * {step}))"


def as_string(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def half_even(v: str, s: str) -> str:
    """v / s half to even, for integers with s > 0."""
    q, r = f"(({v}) // ({s}))", f"(abs({v}) % ({s}))"
    return f"CASE WHEN 2 * {r} > ({s}) OR (2 * {r} = ({s}) AND {q} % 2 <> 0) THEN {q} + (CASE WHEN ({v}) < 0 THEN -1 ELSE 1 END) ELSE {q} END"


def bars_sql(interval: str, source: str = "ticks") -> str:
    """A SELECT of bars from a relation of ticks, times as TIMESTAMP."""
    return f"""SELECT symbol, time, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
  CAST({half_even('CAST(sum(spread) AS HUGEINT)', 'count(*)')} AS BIGINT) AS avg_spread, max(spread) AS max_spread, count(*) AS ticks
  FROM (SELECT *, {bar_start('ts', interval)} AS time FROM {source}) GROUP BY symbol, time"""


def resample_sql(interval: str, source: str) -> str:
    return f"""SELECT symbol, bucket AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close,
  CAST({half_even('CAST(sum(CAST(avg_spread AS HUGEINT) * ticks) AS HUGEINT)', 'CAST(sum(ticks) AS BIGINT)')} AS BIGINT) AS avg_spread, max(max_spread) AS max_spread, CAST(sum(ticks) AS BIGINT) AS ticks
  FROM (SELECT *, {bar_start('time', interval)} AS bucket FROM {source}) GROUP BY symbol, bucket"""


BAR_COLUMNS = "open, high, low, close, avg_spread, max_spread, ticks"
