"""Bars, calendar and coverage queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import bars as ops
from ..operators import coverage as cov
from .common import BAR_COLUMNS, TICKS, bucket_ticks, bucket_ticks_sql, as_string, as_text, bars_sql, day_at, local, resample_sql, session_date, table, ticks

#: Buckets of users in the coverage queries.
BUCKETS = 10


def bars_query(interval: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_text(ops.from_ticks(ticks(spark, sf_dir), ["symbol"], interval), "time")

    return run


def resample_query(fine: str, coarse: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_text(ops.resample(ops.from_ticks(ticks(spark, sf_dir), ["symbol"], fine), ["symbol"], coarse), "time")

    return run


def mid_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h4")
    return as_text(bars.select("symbol", "time", ops.mid_close().alias("mid")), "time")


def derived_vs_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by way of hours against daily bars from ticks, the latter moved by a rule: every 5th day is missing, every 7th close is off."""
    t = ticks(spark, sf_dir)
    derived = ops.resample(ops.from_ticks(t, ["symbol"], "h1"), ["symbol"], "d1")
    native = ops.from_ticks(t, ["symbol"], "d1").where(F.dayofmonth("time") % 5 != 0)
    native = native.withColumn("close", F.when(F.dayofmonth("time") % 7 == 0, F.col("close") + 3000).otherwise(F.col("close")))
    return as_text(ops.compare(derived, native, ["symbol"], 2000), "time")


def legacy_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes against a legacy set at five decimals, moved where the hour divides by 6."""
    bars = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h1")
    legacy = bars.select("symbol", "time", (F.col("close") + F.when(F.hour("time") % 6 == 0, 2000).otherwise(500)).alias("close"))
    return as_text(ops.compare_closes(bars, legacy, ["symbol"], 1000), "time")


def holidays(spark: SparkSession) -> DataFrame:
    """The standard table, and two days within the events' month: a full one (January 15) and a partial one (January 19)."""
    more = spark.createDataFrame([("2024-01-15", "full", None), ("2024-01-19", "partial", 13), ("2024-01-21", "full", None)], "date string, kind string, from_hour int")
    return cal.standard_holidays(spark, 2023, 2024).unionByName(more.withColumn("date", F.col("date").cast("date")))


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cal.with_session(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", holidays(spark))
    return as_text(found.select("event_id", "status", "session_start", "session_end"), "session_start", "session_end")


def session_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cal.with_session(table(spark, sf_dir, "events").select("ts"), "ts", holidays(spark))
    return found.groupBy(F.to_date("ts").cast("string").alias("day"), "status").agg(F.count("*").alias("n"))


def holiday_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays of every year that orders span."""
    first, last = table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    return cal.standard_holidays(spark, first, last).select(F.col("date").cast("string").alias("date"), "kind", F.coalesce("from_hour", F.lit(-1)).alias("from_hour"))


def _sparse(spark: SparkSession, sf_dir: str, interval: str) -> tuple[DataFrame, DataFrame]:
    """(bars of all ticks by type and bucket of users, months to cover): few ticks an hour each, so there are gaps."""
    bars = ops.from_ticks(bucket_ticks(spark, sf_dir, BUCKETS), ["symbol"], interval)
    span = bars.groupBy("symbol").agg(F.min("time").alias("start_ts"), F.max("time").alias("end_ts"))
    return bars, cov.month_spans(span, ["symbol"])


def coverage_gaps(interval: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars, months = _sparse(spark, sf_dir, interval)
        states = cov.interval_states(months, bars.select("symbol", "time"), ["symbol"], interval, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"), holidays(spark))
        return as_text(cov.gaps(states, ["symbol", "year", "month"]), "gap_start", "gap_end")

    return run


def dataset_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, months = _sparse(spark, sf_dir, "d1")
    states = cov.interval_states(months, bars.select("symbol", "time"), ["symbol"], "d1", F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"), None)
    return cov.completeness(states, ["symbol"])


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with defects by rule, and the first rule that each breaks."""
    bars = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h1")
    h, d = F.hour("time"), F.dayofmonth("time")
    broken = bars.withColumns(
        {"high": F.when(d % 11 == 0, F.col("low") - 1).otherwise(F.col("high")), "open": F.when(h % 7 == 0, F.col("high") + 1).otherwise(F.col("open")), "avg_spread": F.when(h % 5 == 0, F.col("max_spread") + 1).otherwise(F.col("avg_spread")), "ticks": F.when(h == 3, -F.col("ticks")).otherwise(F.col("ticks"))}
    )
    return as_text(broken.select("symbol", "time", ops.violation().alias("reason")).where("reason IS NOT NULL"), "time")


QUERIES = {
    **{f"bars_{i}": bars_query(i) for i in ("m1", "h1", "h4", "d1", "w1")},
    "resample_h1_to_d1": resample_query("h1", "d1"),
    "resample_h1_to_h4": resample_query("h1", "h4"),
    "resample_d1_to_w1": resample_query("d1", "w1"),
    "mid_price": mid_price,
    "derived_vs_native": derived_vs_native,
    "legacy_closes": legacy_closes,
    "session_status": session_status,
    "session_status_counts": session_status_counts,
    "holiday_table": holiday_table,
    "coverage_gaps_h1": coverage_gaps("h1"),
    "coverage_gaps_d1": coverage_gaps("d1"),
    "dataset_complete": dataset_complete,
    "bar_violations": bar_violations,
}

HOLIDAYS = """SELECT make_date(y, m, d) AS date, kind, h AS from_hour FROM range(2023, 2025) t(y),
  (VALUES (1, 1, 'full', NULL), (12, 24, 'partial', 13), (12, 25, 'full', NULL), (12, 26, 'full', NULL), (12, 31, 'partial', 13)) v(m, d, kind, h)
  UNION ALL SELECT DATE '2024-01-15', 'full', NULL UNION ALL SELECT DATE '2024-01-19', 'partial', 13 UNION ALL SELECT DATE '2024-01-21', 'full', NULL"""


def status_sql(source: str, ts: str, columns: str, with_holidays: bool = True) -> str:
    """Rows of ``source`` with status, session_start and session_end of ``ts``; needs a relation ``holidays``."""
    if not with_holidays:
        return f"""SELECT {columns}, CASE WHEN closed THEN 'closed' ELSE 'open' END AS status, CASE WHEN NOT closed THEN s END AS session_start, CASE WHEN NOT closed THEN e END AS session_end
  FROM (SELECT *, dayofweek({local(ts)}) = 6 OR (dayofweek({local(ts)}) = 5 AND hour({local(ts)}) >= 17) OR (dayofweek({local(ts)}) = 0 AND hour({local(ts)}) < 17) AS closed,
    {day_at(session_date(ts))} AS s, {day_at(f'({session_date(ts)} + 1)')} AS e FROM {source})"""
    return f"""SELECT {columns}, status, CASE WHEN status = 'open' THEN CASE WHEN dayofweek(d0) = 0 AND on_start THEN {day_at('d1', 0)} ELSE {day_at('d0')} END END AS session_start,
    CASE WHEN status = 'open' THEN least(coalesce(cut, {day_at('d1')}), {day_at('d1')}) END AS session_end
  FROM (SELECT *, CASE WHEN dow = 6 OR (dow = 5 AND h >= 17) OR (dow = 0 AND h < 17) THEN 'closed'
      WHEN dow = 0 AND on_local THEN 'holiday' WHEN on_end THEN 'holiday' WHEN cut IS NOT NULL AND {ts} >= cut THEN 'holiday' ELSE 'open' END AS status
    FROM (SELECT *, {utc_hours('d1', 'partial_hour')} AS cut FROM (SELECT *, d1 IN (SELECT date FROM holidays WHERE kind = 'full') AS on_end, d0 IN (SELECT date FROM holidays WHERE kind = 'full') AS on_start,
      ld IN (SELECT date FROM holidays WHERE kind = 'full') AS on_local, (SELECT min(from_hour) FROM holidays p WHERE p.kind = 'partial' AND p.date = d1) AS partial_hour
      FROM (SELECT *, {session_date(ts)} AS d0, {session_date(ts)} + 1 AS d1, CAST({local(ts)} AS DATE) AS ld, dayofweek({local(ts)}) AS dow, hour({local(ts)}) AS h FROM {source}))))"""


def utc_hours(date: str, hour: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', CAST({date} AS TIMESTAMP) + to_hours({hour})))"


def _spine(interval: str) -> str:
    """Bars that start in each symbol's months, from a relation ``months`` (symbol, start_ts, end_ts)."""
    days = "SELECT symbol, year, month, start_ts, end_ts, CAST(unnest(generate_series(CAST(start_ts AS DATE) - 2, CAST(end_ts AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS d FROM months"
    if interval == "d1":
        inner = f"SELECT *, {day_at('d')} AS bar_start, {day_at('(d + 1)')} AS bar_end FROM ({days})"
    else:
        inner = f"""SELECT *, s + to_hours(i) AS bar_start, least(s + to_hours(i + 1), e) AS bar_end FROM
  (SELECT *, unnest(range(CAST((epoch(e) - epoch(s)) / 3600 AS BIGINT))) AS i FROM (SELECT *, {day_at('d')} AS s, {day_at('(d + 1)')} AS e FROM ({days})))"""
    return f"SELECT symbol, year, month, bar_start, bar_end FROM ({inner}) WHERE bar_start >= start_ts AND bar_start < end_ts"


def _states(interval: str, with_holidays: bool = True) -> str:
    at_start = status_sql("spine", "bar_start", "symbol, year, month, bar_start, bar_end", with_holidays)
    at_last = status_sql("(SELECT *, bar_end - INTERVAL 1 MICROSECOND AS bar_last FROM spine)", "bar_last", "symbol, bar_start", with_holidays)
    return f"""WITH holidays AS ({HOLIDAYS}), sparse AS ({bucket_ticks_sql(BUCKETS)}), bars AS ({bars_sql(interval, 'sparse')}),
months AS (SELECT symbol, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, greatest(m, lo) AS start_ts, least(m + INTERVAL 1 MONTH, hi) AS end_ts FROM
  (SELECT symbol, lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM (SELECT symbol, min(time) AS lo, max(time) AS hi FROM bars GROUP BY symbol))),
spine AS ({_spine(interval)}), at_start AS ({at_start}), at_last AS ({at_last}),
states AS (SELECT s.symbol, s.year, s.month, s.bar_start, s.bar_end, CASE WHEN s.status <> l.status OR (s.status = 'open' AND (s.session_start > s.bar_start OR s.session_end < s.bar_end)) THEN 'straddle'
  WHEN s.status <> 'open' THEN CASE WHEN b.time IS NOT NULL THEN 'unexpected' ELSE 'closed' END
  WHEN s.bar_end > TIMESTAMP '2024-01-29 00:00:00' THEN 'in_progress' WHEN b.time IS NULL THEN 'missing' ELSE 'present' END AS state
  FROM at_start s JOIN at_last l USING (symbol, bar_start) LEFT JOIN bars b ON b.symbol = s.symbol AND b.time = s.bar_start)"""


def _gaps(interval: str) -> str:
    return f"""{_states(interval)}
SELECT symbol, year, month, state, {as_string('min(bar_start)')} AS gap_start, {as_string('max(bar_end)')} AS gap_end, count(*) AS bars FROM
 (SELECT *, sum(fresh) OVER (PARTITION BY symbol, year, month ORDER BY bar_start) AS island FROM
  (SELECT *, CASE WHEN lag(state) OVER w = state AND lag(bar_end) OVER w = bar_start THEN 0 ELSE 1 END AS fresh FROM states WINDOW w AS (PARTITION BY symbol, year, month ORDER BY bar_start)))
WHERE state NOT IN ('present', 'closed') GROUP BY symbol, year, month, state, island"""


def _bars_out(sql: str) -> str:
    return f"SELECT symbol, {as_string('time')} AS time, {BAR_COLUMNS} FROM ({sql})"


ORACLES = {
    **{f"bars_{i}": f"WITH ticks AS ({TICKS}) {_bars_out(bars_sql(i))}" for i in ("m1", "h1", "h4", "d1", "w1")},
    **{f"resample_{a}_to_{b}": f"WITH ticks AS ({TICKS}), fine AS ({bars_sql(a)}) {_bars_out(resample_sql(b, 'fine'))}" for a, b in (("h1", "d1"), ("h1", "h4"), ("d1", "w1"))},
    "mid_price": f"WITH ticks AS ({TICKS}) SELECT symbol, {as_string('time')} AS time, CAST(close + CASE WHEN avg_spread % 2 = 0 THEN avg_spread // 2 WHEN (avg_spread // 2) % 2 = 0 THEN avg_spread // 2 ELSE avg_spread // 2 + 1 END AS BIGINT) AS mid FROM ({bars_sql('h4')})",
    "derived_vs_native": f"""WITH ticks AS ({TICKS}), fine AS ({bars_sql('h1')}), d AS ({resample_sql('d1', 'fine')}), n0 AS ({bars_sql('d1')}),
n AS (SELECT * REPLACE (CASE WHEN day(time) % 7 = 0 THEN close + 3000 ELSE close END AS close) FROM n0 WHERE day(time) % 5 <> 0),
b AS (SELECT symbol, time, d.open AS d1, n.open AS n1, d.high AS d2, n.high AS n2, d.low AS d3, n.low AS n3, d.close AS d4, n.close AS n4 FROM d FULL JOIN n USING (symbol, time)),
e AS (SELECT symbol, time, 'open' AS field, d1 AS derived, n1 AS native FROM b UNION ALL SELECT symbol, time, 'high', d2, n2 FROM b UNION ALL SELECT symbol, time, 'low', d3, n3 FROM b UNION ALL SELECT symbol, time, 'close', d4, n4 FROM b)
SELECT symbol, {as_string('time')} AS time, CASE WHEN derived IS NULL THEN 'native_only' WHEN native IS NULL THEN 'derived_only' ELSE field END AS field, derived, native FROM e
WHERE CASE WHEN derived IS NULL OR native IS NULL THEN field = 'open' ELSE abs(derived - native) > 2000 END""",
    "legacy_closes": f"WITH ticks AS ({TICKS}) SELECT symbol, {as_string('time')} AS time, close, close + 2000 AS legacy_close FROM ({bars_sql('h1')}) WHERE hour(time) % 6 = 0",
    "session_status": f"WITH holidays AS ({HOLIDAYS}) SELECT event_id, status, {as_string('session_start')} AS session_start, {as_string('session_end')} AS session_end FROM ({status_sql('events', 'ts', 'event_id')})",
    "session_status_counts": f"WITH holidays AS ({HOLIDAYS}) SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS n FROM ({status_sql('events', 'ts', 'ts')}) GROUP BY 1, 2",
    "holiday_table": """SELECT strftime(make_date(y, m, d), '%Y-%m-%d') AS date, kind, h AS from_hour FROM (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders),
  (VALUES (1, 1, 'full', -1), (12, 24, 'partial', 13), (12, 25, 'full', -1), (12, 26, 'full', -1), (12, 31, 'partial', 13)) v(m, d, kind, h)""",
    "coverage_gaps_h1": _gaps("h1"),
    "coverage_gaps_d1": _gaps("d1"),
    "dataset_complete": f"{_states('d1', False)} SELECT symbol, bool_and(state IN ('present', 'closed')) AS complete, count(*) AS intervals, count(*) FILTER (state = 'missing') AS missing FROM states GROUP BY symbol",
    "bar_violations": f"""WITH ticks AS ({TICKS}), b AS (SELECT * REPLACE (CASE WHEN day(time) % 11 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN hour(time) % 7 = 0 THEN high + 1 ELSE open END AS open,
  CASE WHEN hour(time) % 5 = 0 THEN max_spread + 1 ELSE avg_spread END AS avg_spread, CASE WHEN hour(time) = 3 THEN -ticks ELSE ticks END AS ticks) FROM ({bars_sql('h1')})),
v AS (SELECT symbol, time, CASE WHEN high < low THEN 'high_below_low' WHEN open < low OR open > high THEN 'open_outside' WHEN close < low OR close > high THEN 'close_outside' WHEN avg_spread > max_spread THEN 'spread' WHEN ticks < 0 THEN 'ticks' END AS reason FROM b)
SELECT symbol, {as_string('time')} AS time, reason FROM v WHERE reason IS NOT NULL""",
}
