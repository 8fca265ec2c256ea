"""Partition-level queries: holes, spans, manifests, staleness, readiness and planned actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import bars as ops
from ..operators import coverage as cov
from ..operators import inventory, manifests, ranges
from ..plans import planner
from ..sources.shared import settle
from .bars import HOLIDAYS, holidays, status_sql
from .common import TICKS, as_string, as_text, bars_sql, day_at, session_date, table, ticks, units


def month_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without an order between a customer's first and last."""
    months = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return inventory.month_holes(months, ["o_custkey"])


def _order_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    requests = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("from_ts"), F.expr("max(o_orderdate) + INTERVAL 40 DAYS").alias("to_ts"))
    spans = orders.select("o_custkey", F.col("o_orderdate").alias("start_ts"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 400 + 1).cast("int"))).alias("end_ts"))
    return requests, spans


def span_union_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stretch of each customer's time that no order's span covers."""
    return as_text(ranges.first_uncovered(*_order_spans(spark, sf_dir), ["o_custkey"]), "hole_start", "hole_end")


def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which two overlapping copies of orders (the second one changed by rule) disagree."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("time"), units("o_totalprice", 2).alias("price"))
    again = rows.where(F.col("o_orderkey") % 2 == 0).withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 14 == 0, 1).otherwise(0))
    return ranges.conflicts(rows.unionByName(again), ["o_orderkey"], ["time", "price"])


def bars_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range queries on hourly bars, one for each symbol and week that it has; stored spans leave out a day of two symbols, and those requests get no bars."""
    return as_text(ranges.bars_for(*_requests(spark, sf_dir))[0], "time")


def bars_request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(ranges.bars_for(*_requests(spark, sf_dir))[1], "conflict_at", "hole_start").select("request", "status", "conflict_at", "hole_start")


def bars_request_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly manifests that each answered request rests on."""
    requests, bars, spans, request, keys, values = _requests(spark, sf_dir)
    held = manifests.summary(bars.dropDuplicates(["symbol", "time"]), ["symbol", "year", "month"])
    status = ranges.bars_for(requests, bars, spans, request, keys, values)[1]
    return as_text(ranges.manifests_used(requests, held, status, request, keys), "first_bar", "last_bar")


def _requests(spark: SparkSession, sf_dir: str) -> tuple:
    """What ``ranges.bars_for`` takes."""
    bars = settle(ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h1").withColumns({"year": F.year("time"), "month": F.month("time")}))
    first = F.trunc(F.min("time"), "week")
    names = bars.groupBy("symbol").agg(first.cast("timestamp_ntz").alias("base"), F.max("time").alias("hi"))
    week = F.explode(F.sequence(F.to_date("base"), F.to_date("hi"), F.expr("INTERVAL 7 DAYS"))).alias("d")
    start = F.col("d").cast("timestamp_ntz")
    requests = names.select("symbol", week).select(F.concat_ws("-", "symbol", F.col("d").cast("string")).alias("request"), "symbol", start.alias("from_ts"), (start + F.expr("INTERVAL 7 DAYS")).alias("to_ts"))
    days = lambda n: F.col("base") + F.make_dt_interval(F.lit(n))
    cut = F.col("symbol").isin("click", "error")
    parts = F.array(F.struct(F.col("base").alias("a"), F.when(cut, days(9)).otherwise(days(19)).alias("b")), F.struct(F.when(cut, days(10)).otherwise(days(17)).alias("a"), (F.col("hi") + F.expr("INTERVAL 8 DAYS")).alias("b")))
    spans = names.select("symbol", F.explode(parts).alias("x")).select("symbol", F.col("x.a").alias("start_ts"), F.col("x.b").alias("end_ts"))
    # a copy of the view bars with one hour changed: its request conflicts
    odd = F.col("time") == F.col("base") + F.expr("INTERVAL '2 5' DAY TO HOUR")
    copy = bars.where(F.col("symbol") == "view").join(names.select("symbol", "base"), "symbol").withColumn("close", F.col("close") + F.when(odd, 1).otherwise(0)).drop("base")
    return requests, bars.unionByName(copy), spans, "request", ["symbol"], ["open", "high", "low", "close"]


def _manifests(bars: DataFrame) -> DataFrame:
    """Manifests of daily partitions (symbol, day) of hourly bars, defects by rule."""
    day = F.to_date("time").alias("day")
    found = manifests.summary(bars.withColumn("day", day), ["symbol", "day"])
    d = F.dayofmonth("day")
    start = F.col("day").cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    return found.withColumns(
        {
            "provider": F.when(d == 3, "").otherwise("oanda"), "instrument_id": F.concat(F.lit("idx:"), F.upper("symbol")), "interval": F.when(d == 4, "h2").otherwise("h1"), "span_start": start,
            "span_end": F.when(d == 5, start).otherwise(start + F.expr("INTERVAL 1 DAY")), "basis": F.when(d == 6, "last").otherwise("bid"), "schema_version": F.when(d == 7, 0).otherwise(1),
            "raw_fingerprint": F.when(d == 8, "SHA:xyz").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "symbol", F.col("day").cast("string")), 256))),
            "builder_version": F.when(d == 9, "").otherwise("1"), "validator_version": F.lit("1"), "resampler_version": F.when(d.isin(10, 11), "1").otherwise("none"), "calendar_version": F.lit("1"),
            "built_at": F.when(d != 12, F.lit("2024-02-01").cast("timestamp_ntz")), "bar_count": F.when(d == 13, -1).when(d == 14, F.col("bar_count") + 1).otherwise(F.col("bar_count")),
            "last_bar": F.when(d == 15, start).otherwise(F.col("last_bar")), "parent_instrument": F.when(d == 11, F.concat(F.lit("idx:"), F.upper("symbol"))).otherwise(none), "parent_interval": F.when(d == 11, "d1").otherwise(none),
            "parent_revision": F.when(d == 11, "sha256:00").otherwise(none),
        }
    )


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each manifest breaks, and where it doesn't describe its bars."""
    bars = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h1")
    checked = manifests.against_bars(_manifests(bars), bars.withColumn("day", F.to_date("time")), ["symbol", "day"])
    return checked.select("symbol", F.col("day").cast("string").alias("day"), manifests.manifest_error().alias("error"), "mismatch")


def manifest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "h1")
    return _manifests(bars).select("symbol", F.col("day").cast("string").alias("day"), manifests.revision().alias("revision"))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions (status, year, month) of orders: what was fetched and what was published from an earlier version, by rule."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderkey", "o_custkey")
    found = rows.groupBy("key", "year", "month").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("now"), F.sum(F.when(F.col("o_orderkey") % 997 != 0, F.col("o_custkey")).otherwise(0)).alias("then"))
    return found


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(months, manifests, raw, violations)."""
    found = _months(spark, sf_dir)
    n = F.col("year") * 12 + F.col("month")
    months = found.select("key", "year", "month")
    held = found.where(n % 11 != 0).select("key", "year", "month", F.col("then").cast("string").alias("raw_fingerprint"))
    raw = found.where(n % 13 != 0).select("key", "year", "month", F.when(n % 17 == 0, "malformed").otherwise("ok").alias("status"), F.col("now").cast("string").alias("fingerprint"), (F.col("n") % 3).alias("incomplete_rows"))
    bad = found.where(n % 19 == 0).select("key", "year", "month")
    return months, held, raw, bad


def stale_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each month of orders: missing, invalid, stale or current."""
    return cov.partition_status(*_inputs(spark, sf_dir), ["key"])


def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each month needs: download, repair, normalise, and extension of the last one of two keys; with the stage and the place in each key's order."""
    return planner.positions(_actions(spark, sf_dir), ["key"])


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    months, held, raw, bad = _inputs(spark, sf_dir)
    status = cov.partition_status(months, held, raw, bad, ["key"]).join(raw.select("key", "year", "month", F.col("status").alias("raw_status")), ["key", "year", "month"], "left")
    extend = months.where("key IN ('O', 'F')").select("key").distinct()
    return planner.raw_actions(status, ["key"], extend)


def skipped_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.skipped(_actions(spark, sf_dir), (planner.NORMALIZE,)).groupBy("kind", "reason", "why").agg(F.count("*").alias("n"))


def derived_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly months against the revisions of the daily ones that they came from (this month's, or with the next one's)."""
    found = _months(spark, sf_dir)
    n = F.col("year") * 12 + F.col("month")
    daily = found.where(n % 13 != 0).select("key", "year", "month", F.col("now").cast("string").alias("revision"))
    before = found.select("key", F.year(F.add_months(F.make_date("year", "month", F.lit(1)), -1)).alias("year"), F.month(F.add_months(F.make_date("year", "month", F.lit(1)), -1)).alias("month"), F.col("then").cast("string").alias("nxt"))
    weekly = found.join(before, ["key", "year", "month"], "left").withColumn("crosses", n % 2 == 0)
    parent = F.when(F.col("crosses"), cov.composite_revision(F.col("then").cast("string"), F.coalesce("nxt", F.lit("")))).otherwise(F.col("then").cast("string"))
    return cov.derived_staleness(weekly.select("key", "year", "month", "crosses", parent.alias("parent_revision")), daily, ["key"]).select("key", "year", "month", "crosses", "stale")


def extend_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by hour of day whose last record leaves an open hourly bar before the range's end, or is provisional."""
    t = ticks(spark, sf_dir).withColumn("slot", F.hour("ts"))
    last = t.groupBy("symbol", "slot").agg(F.count("*").alias("row_count"), F.max("ts").alias("last_time"), F.max_by("seq", F.struct("ts", "seq")).alias("last_seq"))
    latest = last.select("symbol", "slot", F.lit(2024).alias("year"), F.lit(1).alias("month"), "row_count", "last_time", (F.col("last_seq") % 5 != 0).alias("last_complete"), F.lit("2024-01-30 20:30:00").cast("timestamp_ntz").alias("range_end"))
    return planner.extend_needed(latest, ["symbol", "slot"], "h1", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), holidays(spark))


def _week_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weeks, daily partitions, daily gaps) by user's number mod 40: days without a tick are gaps."""
    on_weekday = F.dayofweek(cal.session_date(F.col("ts"))) < 6
    rows = table(spark, sf_dir, "events").where(on_weekday).select((F.col("user_id") % 40).alias("key"), cal.day_start(F.col("ts")).alias("time")).distinct()
    span = rows.groupBy("key").agg(F.min("time").alias("start_ts"), F.max("time").alias("end_ts"))
    months = cov.month_spans(span, ["key"])
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    gaps = cov.gaps(cov.interval_states(months, rows, ["key"], "d1", now), ["key", "year", "month"])
    weeks = cal.spine(months, ["key", "year", "month"], "week")
    status = F.when((F.col("month") == 12) & (F.col("key") % 2 == 0), cov.STALE).otherwise(cov.CURRENT)
    return weeks, months.select("key", "year", "month", status.alias("status")), gaps


def ready_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks whose daily partitions are all current and that no gap of days overlaps."""
    weeks, partitions, gaps = _week_inputs(spark, sf_dir)
    return as_text(cov.ready_weeks(weeks.drop("year", "month"), partitions, gaps, ["key"]), "bar_start", "bar_end")


def week_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that start in each month of orders, and how far they reach."""
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("m"), F.col("o_orderstatus").alias("key")).distinct()
    spans = months.select("key", F.year("m").alias("year"), F.month("m").alias("month"), F.col("m").cast("timestamp_ntz").alias("start_ts"), F.add_months("m", 1).cast("timestamp_ntz").alias("end_ts"))
    found = cal.week_spans(spans, ["key", "year", "month"])
    return as_text(found, "bar_start", "bar_end", "coverage_end")


def derive_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly partitions to derive: not current ones with all days there, and current ones whose lacking week has become ready."""
    weeks, daily, gaps = _week_inputs(spark, sf_dir)
    k = F.col("key") % 5
    months = daily.select("key", "year", "month")
    weekly = months.withColumn("status", F.when(k == 0, cov.MISSING).when(k == 1, cov.STALE).when(k == 2, cov.INVALID).otherwise(cov.CURRENT))
    lacking = weeks.where(F.dayofmonth("bar_start") <= 14).select("key", "year", "month", F.col("bar_start").alias("gap_start"), F.col("bar_end").alias("gap_end"))
    # of the daily gaps only those of one week count, so that some months are whole
    some = gaps.where(F.dayofmonth("gap_start") > 20).where(F.col("key") % 3 == 0)
    return planner.derive_actions(weekly, daily.withColumn("status", F.lit(cov.CURRENT)), some, lacking, ["key"])


def fetch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where to where each customer's orders of a month would be fetched again."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("time"), "o_orderkey", F.trunc("o_orderdate", "month").alias("m"))
    last = rows.groupBy("o_custkey", "m").agg(F.max("time").alias("last_time"), F.max_by("o_orderkey", F.struct("time", "o_orderkey")).alias("k"))
    latest = last.select("o_custkey", F.col("m").cast("timestamp_ntz").alias("month_start"), F.add_months("m", 1).cast("timestamp_ntz").alias("month_end"), "last_time", (F.col("k") % 4 != 0).alias("last_complete"))
    found = inventory.fetch_windows(latest, F.lit("2001-07-20 00:00:00").cast("timestamp_ntz"))
    return as_text(found.select("o_custkey", "month_start", "fetch_from", "from_exclusive", "fetch_to"), "month_start", "fetch_from", "fetch_to")


QUERIES = {
    "month_holes": month_holes, "span_union_gap": span_union_gap, "overlap_conflicts": overlap_conflicts, "bars_request": bars_request, "bars_request_status": bars_request_status, "bars_request_manifests": bars_request_manifests, "manifest_check": manifest_check,
    "manifest_revision": manifest_revision, "stale_partitions": stale_partitions, "plan_actions": plan_actions, "skipped_actions": skipped_actions, "derived_staleness": derived_staleness, "extend_needed": extend_needed,
    "ready_weeks": ready_weeks, "week_spans": week_spans, "derive_actions": derive_actions, "fetch_windows": fetch_windows,
}

_SPANS = """requests AS (SELECT o_custkey, min(o_orderdate) AS from_ts, max(o_orderdate) + INTERVAL 40 DAY AS to_ts FROM orders GROUP BY 1),
spans AS (SELECT o_custkey, o_orderdate AS start_ts, o_orderdate + to_days(CAST(o_orderkey % 400 + 1 AS INTEGER)) AS end_ts FROM orders)"""
_D = "day(day)"
_MANIFESTS = f"""ticks AS ({TICKS}), bars AS ({bars_sql('h1')}), s AS (SELECT symbol, CAST(time AS DATE) AS day, count(*) AS n, min(time) AS lo, max(time) AS hi FROM bars GROUP BY ALL),
manifests AS (SELECT symbol, day, n, lo, hi, CASE WHEN {_D} = 3 THEN '' ELSE 'oanda' END AS provider, 'idx:' || upper(symbol) AS instrument_id, CASE WHEN {_D} = 4 THEN 'h2' ELSE 'h1' END AS "interval", CAST(day AS TIMESTAMP) AS span_start,
  CASE WHEN {_D} = 5 THEN CAST(day AS TIMESTAMP) ELSE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY END AS span_end, CASE WHEN {_D} = 6 THEN 'last' ELSE 'bid' END AS basis, CASE WHEN {_D} = 7 THEN 0 ELSE 1 END AS schema_version,
  CASE WHEN {_D} = 8 THEN 'SHA:xyz' ELSE 'sha256:' || sha256(symbol || '|' || CAST(day AS VARCHAR)) END AS raw_fingerprint, CASE WHEN {_D} = 9 THEN '' ELSE '1' END AS builder_version, CASE WHEN {_D} IN (10, 11) THEN '1' ELSE 'none' END AS resampler_version,
  CASE WHEN {_D} = 13 THEN -1 WHEN {_D} = 14 THEN n + 1 ELSE n END AS bar_count, lo AS first_bar, CASE WHEN {_D} = 15 THEN CAST(day AS TIMESTAMP) ELSE hi END AS last_bar,
  CASE WHEN {_D} = 11 THEN 'idx:' || upper(symbol) END AS parent_instrument, CASE WHEN {_D} = 11 THEN 'd1' END AS parent_interval, CASE WHEN {_D} = 11 THEN 'sha256:00' END AS parent_revision FROM s)"""
_INPUTS = """found AS (SELECT o_orderstatus AS key, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS now, CAST(sum(CASE WHEN o_orderkey % 997 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS was FROM orders GROUP BY ALL),
m AS (SELECT *, year * 12 + month AS k FROM found),
status AS (SELECT key, year, month, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 19 = 0 THEN 'invalid' WHEN k % 13 <> 0 AND k % 17 <> 0 AND was <> now THEN 'stale' ELSE 'current' END AS status, CASE WHEN k % 13 <> 0 THEN n % 3 ELSE 0 END AS incomplete_rows,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'malformed' ELSE 'ok' END AS raw_status FROM m)"""
_ACTIONS = f"""{_INPUTS}, ranked AS (SELECT *, key IN ('O', 'F') AND row_number() OVER (PARTITION BY key ORDER BY year DESC, month DESC) = 1 AS grow FROM status),
actions AS (SELECT key, year, month, 'download_raw' AS kind, 'missing' AS reason FROM ranked WHERE raw_status IS NULL UNION ALL SELECT key, year, month, 'repair_raw', 'raw partition ' || raw_status FROM ranked WHERE raw_status <> 'ok'
UNION ALL SELECT key, year, month, 'download_raw', 'extend' FROM ranked WHERE raw_status = 'ok' AND grow
UNION ALL SELECT key, year, month, 'normalize_canonical', CASE status WHEN 'missing' THEN 'missing' WHEN 'invalid' THEN 'invalid: rebuild' WHEN 'stale' THEN 'stale: raw fingerprint changed' ELSE 'extend: rebuild once raw catches up' END FROM ranked WHERE raw_status = 'ok' AND (status <> 'current' OR grow))"""
_REQUESTS = f"""ticks AS ({TICKS}), bars AS ({bars_sql('h1')}), names AS (SELECT symbol, CAST(date_trunc('week', min(time)) AS TIMESTAMP) AS base, max(time) AS hi FROM bars GROUP BY symbol),
weeks AS (SELECT symbol, base, unnest(generate_series(base, CAST(CAST(hi AS DATE) AS TIMESTAMP), INTERVAL 7 DAY)) AS f FROM names), requests AS (SELECT symbol || '-' || strftime(f, '%Y-%m-%d') AS request, symbol, base, f, f + INTERVAL 7 DAY AS t FROM weeks),
status AS (SELECT request, symbol, f, t, CASE WHEN symbol = 'view' AND f <= base + INTERVAL 53 HOUR AND base + INTERVAL 53 HOUR < t AND EXISTS (SELECT 1 FROM bars b WHERE b.symbol = 'view' AND b.time = base + INTERVAL 53 HOUR) THEN base + INTERVAL 53 HOUR END AS conflict_at,
  CASE WHEN symbol IN ('click', 'error') AND f < base + INTERVAL 10 DAY AND t > base + INTERVAL 9 DAY THEN greatest(f, base + INTERVAL 9 DAY) END AS hole_start FROM requests),
final AS (SELECT *, CASE WHEN conflict_at IS NOT NULL THEN 'conflict' WHEN hole_start IS NOT NULL THEN 'hole' ELSE 'ok' END AS status FROM status)"""
_DAYS = "SELECT DISTINCT user_id % 40 AS key, " + day_at(session_date("ts")) + f" AS time FROM events WHERE dayofweek({session_date('ts')}) NOT IN (5, 6)"
_WEEKS = f"""rows AS ({_DAYS}), span AS (SELECT key, min(time) AS lo, max(time) AS hi FROM rows GROUP BY key),
months AS (SELECT key, year(mm) AS year, month(mm) AS month, greatest(mm, lo) AS start_ts, least(mm + INTERVAL 1 MONTH, hi) AS end_ts FROM (SELECT key, lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS mm FROM span) WHERE greatest(mm, lo) < least(mm + INTERVAL 1 MONTH, hi)),
dates AS (SELECT key, year, month, start_ts, end_ts, CAST(unnest(generate_series(CAST(start_ts AS DATE) - 8, CAST(end_ts AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS d FROM months),
spine AS (SELECT key, year, month, {day_at('d')} AS bar_start, {day_at('(d + 1)')} AS bar_end, {day_at('(d + 7)')} AS week_end, dayofweek(d) AS dow, start_ts, end_ts FROM dates),
expected AS (SELECT * FROM spine WHERE bar_start >= start_ts AND bar_start < end_ts AND dow NOT IN (5, 6)),
lacking AS (SELECT e.key, e.bar_start, e.bar_end FROM expected e LEFT JOIN rows r ON r.key = e.key AND r.time = e.bar_start WHERE r.time IS NULL OR e.bar_end > TIMESTAMP '2024-02-01 00:00:00'),
closed_hit AS (SELECT e.key, e.bar_start, e.bar_end FROM spine e JOIN rows r ON r.key = e.key AND r.time = e.bar_start WHERE e.bar_start >= e.start_ts AND e.bar_start < e.end_ts AND e.dow IN (5, 6)),
weeks AS (SELECT key, bar_start, week_end AS bar_end FROM spine WHERE dow = 0 AND bar_start >= start_ts AND bar_start < end_ts)"""

ORACLES = {
    "month_holes": """WITH h AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders), s AS (SELECT o_custkey, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM h GROUP BY o_custkey)
SELECT o_custkey, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month FROM s ANTI JOIN h USING (o_custkey, m)""",
    "span_union_gap": f"""WITH {_SPANS}, c AS (SELECT r.o_custkey, from_ts, to_ts, greatest(start_ts, from_ts) AS s, least(end_ts, to_ts) AS e FROM requests r JOIN spans p ON p.o_custkey = r.o_custkey AND greatest(start_ts, from_ts) < least(end_ts, to_ts)),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), from_ts) AS reached FROM c),
h AS (SELECT o_custkey, reached AS a, s AS b FROM g WHERE s > reached UNION ALL SELECT o_custkey, max(e), max(to_ts) FROM c GROUP BY o_custkey HAVING max(e) < max(to_ts)),
f AS (SELECT o_custkey, min((a, b)) AS x FROM h GROUP BY 1)
SELECT r.o_custkey, {as_string('x[1]')} AS hole_start, {as_string('x[2]')} AS hole_end FROM requests r LEFT JOIN f USING (o_custkey)""",
    "overlap_conflicts": "SELECT o_orderkey, CAST(2 AS BIGINT) AS versions FROM orders WHERE o_orderkey % 14 = 0",
    "bars_request": f"WITH {_REQUESTS} SELECT request, symbol, {as_string('time')} AS time, open, high, low, close, CAST(row_number() OVER (PARTITION BY request ORDER BY time) AS INTEGER) AS position FROM bars JOIN final USING (symbol) WHERE status = 'ok' AND time >= f AND time < t",
    "bars_request_status": f"WITH {_REQUESTS} SELECT request, status, {as_string('conflict_at')} AS conflict_at, {as_string('hole_start')} AS hole_start FROM final",
    "bars_request_manifests": f"""WITH {_REQUESTS}, held AS (SELECT symbol, date_trunc('month', time) AS m, count(*) AS bar_count, min(time) AS lo, max(time) AS hi FROM bars GROUP BY ALL)
SELECT request, symbol, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, bar_count, {as_string('lo')} AS first_bar, {as_string('hi')} AS last_bar FROM final JOIN held USING (symbol)
WHERE status = 'ok' AND m >= date_trunc('month', f) - INTERVAL 1 MONTH AND m <= date_trunc('month', t - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH""",
    "manifest_check": f"""WITH {_MANIFESTS} SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN provider = '' THEN 'provider' WHEN "interval" = 'h2' THEN 'interval' WHEN span_end <= span_start THEN 'span' WHEN basis = 'last' THEN 'basis' WHEN schema_version <= 0 THEN 'schema_version'
  WHEN {_D} = 8 THEN 'fingerprint' WHEN builder_version = '' THEN 'version' WHEN {_D} = 12 THEN 'built_at' WHEN bar_count < 0 THEN 'bar_count'
  WHEN CASE WHEN bar_count = 1 THEN first_bar <> last_bar ELSE last_bar <= first_bar END THEN 'bar_range' WHEN {_D} IN (10, 11) THEN 'parent' END AS error,
  CASE WHEN bar_count <> n THEN 'count' WHEN first_bar <> lo THEN 'first' WHEN last_bar <> hi THEN 'last' END AS mismatch FROM manifests""",
    "manifest_revision": f"""WITH {_MANIFESTS}, t AS (SELECT *, CASE WHEN {_D} = 4 THEN 2 ELSE 1 END AS hours, CASE basis WHEN 'bid' THEN 1 ELSE 0 END AS base FROM manifests)
SELECT symbol, CAST(day AS VARCHAR) AS day, sha256('{{"version":"manifest-revision-v1","provider":"' || provider || '","instrument":"' || instrument_id || '","interval_unit":1,"interval_count":' || hours || ',"span_start":' || epoch_ns(span_start)
  || ',"span_end":' || epoch_ns(span_end) || ',"basis":' || base || ',"schema_version":' || schema_version || ',"raw_fingerprint":"' || raw_fingerprint || '","builder_version":"' || builder_version || '","validator_version":"1","resampler_version":"' || resampler_version
  || '","calendar_version":"1","bar_count":' || bar_count || ',"first_bar":' || epoch_ns(first_bar) || ',"last_bar":' || epoch_ns(last_bar) || ',"parent":'
  || CASE WHEN parent_revision IS NULL THEN 'null' ELSE '{{"instrument":"' || parent_instrument || '","interval_unit":2,"interval_count":1,"revision":"' || parent_revision || '"}}' END || '}}') AS revision FROM t""",
    "stale_partitions": f"WITH {_INPUTS} SELECT key, year, month, status, incomplete_rows FROM status",
    "plan_actions": f"WITH {_ACTIONS}, s AS (SELECT *, CASE kind WHEN 'normalize_canonical' THEN 1 ELSE 0 END AS stage FROM actions) SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY stage, year, month, kind) AS INTEGER) AS position FROM s",
    "skipped_actions": f"WITH {_ACTIONS} SELECT kind, reason, CASE kind WHEN 'repair_raw' THEN 'needs an explicit repair' ELSE 'no download in this step' END AS why, count(*) AS n FROM actions WHERE kind <> 'normalize_canonical' GROUP BY kind, reason",
    "derived_staleness": f"""WITH {_INPUTS}, w AS (SELECT a.key, a.year, a.month, a.k, a.was, b.was AS next_was, CASE WHEN a.k % 13 <> 0 THEN a.now END AS own, CASE WHEN b.k % 13 <> 0 THEN b.now END AS nxt FROM m a LEFT JOIN m b ON b.key = a.key AND make_date(b.year, b.month, 1) = make_date(a.year, a.month, 1) + INTERVAL 1 MONTH)
SELECT key, year, month, k % 2 = 0 AS crosses, CASE WHEN own IS NULL OR (k % 2 = 0 AND nxt IS NULL) THEN false WHEN k % 2 = 0 THEN own || '|' || nxt <> was || '|' || coalesce(CAST(next_was AS VARCHAR), '') ELSE own <> was END AS stale FROM w""",
    "extend_needed": f"""WITH holidays AS ({HOLIDAYS}), ticks AS ({TICKS}), l AS (SELECT symbol, CAST(hour(ts) AS INTEGER) AS slot, max(ts) AS last_time, arg_max(seq, (ts, seq)) AS k FROM ticks GROUP BY ALL),
e AS (SELECT symbol, slot, k, date_trunc('hour', last_time) + INTERVAL 1 HOUR AS s FROM l), b AS (SELECT symbol, slot, unnest(generate_series(s, TIMESTAMP '2024-01-30 11:00:00', INTERVAL 1 HOUR)) AS bar FROM e WHERE k % 5 <> 0), o AS ({status_sql('b', 'bar', 'symbol, slot')})
SELECT DISTINCT symbol, slot FROM o WHERE status = 'open' UNION SELECT symbol, slot FROM e WHERE k % 5 = 0""",
    "ready_weeks": f"""WITH {_WEEKS}, blocked AS (SELECT key, bar_start, bar_end FROM lacking UNION ALL SELECT key, bar_start, bar_end FROM closed_hit)
SELECT key, {as_string('bar_start')} AS bar_start, {as_string('bar_end')} AS bar_end FROM weeks w WHERE NOT EXISTS (SELECT 1 FROM blocked g WHERE g.key = w.key AND g.bar_start < w.bar_end AND g.bar_end > w.bar_start)
AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(date_trunc('month', w.bar_start), w.bar_end - INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS mm) x LEFT JOIN months q ON q.key = w.key AND q.year = year(x.mm) AND q.month = month(x.mm) WHERE q.key IS NULL OR (q.month = 12 AND q.key % 2 = 0))""",
    "week_spans": f"""WITH m AS (SELECT DISTINCT o_orderstatus AS key, date_trunc('month', o_orderdate) AS m FROM orders), d AS (SELECT key, m, CAST(unnest(generate_series(CAST(m AS DATE) - 1, CAST(m AS DATE) + 32, INTERVAL 1 DAY)) AS DATE) AS d FROM m),
w AS (SELECT key, m, {day_at('d')} AS bar_start, {day_at('(d + 7)')} AS bar_end FROM d WHERE dayofweek(d) = 0), i AS (SELECT * FROM w WHERE bar_start >= m AND bar_start < m + INTERVAL 1 MONTH)
SELECT key, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, {as_string('bar_start')} AS bar_start, {as_string('bar_end')} AS bar_end, {as_string('greatest(CAST(m + INTERVAL 1 MONTH AS TIMESTAMP), max(bar_end) OVER (PARTITION BY key, m))')} AS coverage_end FROM i""",
    "derive_actions": f"""WITH {_WEEKS}, expected_months AS (SELECT DISTINCT key, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM months),
flagged AS (SELECT key, year, month, bar_start, bar_end, 'missing' AS state FROM (SELECT e.*, r.time FROM expected e LEFT JOIN rows r ON r.key = e.key AND r.time = e.bar_start) WHERE time IS NULL AND bar_end <= TIMESTAMP '2024-02-01 00:00:00'),
all_bars AS (SELECT s.key, s.year, s.month, s.bar_start, s.bar_end, f.bar_start IS NOT NULL AS bad, lag(f.bar_start IS NOT NULL) OVER (PARTITION BY s.key, s.year, s.month ORDER BY s.bar_start) AS before FROM (SELECT * FROM spine WHERE bar_start >= start_ts AND bar_start < end_ts) s LEFT JOIN flagged f ON f.key = s.key AND f.bar_start = s.bar_start),
islands AS (SELECT *, sum(CASE WHEN bad AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY key, year, month ORDER BY bar_start) AS island FROM all_bars),
gaps AS (SELECT key, year, month, min(bar_start) AS gap_start, max(bar_end) AS gap_end FROM islands WHERE bad GROUP BY key, year, month, island),
few AS (SELECT * FROM gaps WHERE day(gap_start) > 20 AND key % 3 = 0),
fresh AS (SELECT key, year, month, CASE key % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale: parent D1 revision changed' ELSE 'invalid: rebuild' END AS reason FROM expected_months m WHERE key % 5 < 3 AND NOT EXISTS (SELECT 1 FROM few g WHERE g.key = m.key AND g.year = m.year AND g.month = m.month)),
ready AS (SELECT w.key, w.bar_start FROM weeks w WHERE day(w.bar_start) <= 14 AND w.key % 5 >= 3 AND NOT EXISTS (SELECT 1 FROM few g WHERE g.key = w.key AND g.gap_start < w.bar_end AND g.gap_end > w.bar_start)
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(date_trunc('month', w.bar_start), w.bar_end - INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS mm) x LEFT JOIN expected_months q ON q.key = w.key AND q.year = year(x.mm) AND q.month = month(x.mm) WHERE q.key IS NULL))
SELECT key, year, month, 'derive_canonical' AS kind, reason FROM fresh UNION ALL SELECT DISTINCT key, CAST(year(bar_start) AS INTEGER), CAST(month(bar_start) AS INTEGER), 'derive_canonical', 'gap: D1 input now available for a previously incomplete week' FROM ready""",
    "fetch_windows": f"""WITH l AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, max(o_orderdate) AS last_time, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY ALL)
SELECT o_custkey, {as_string('m')} AS month_start, {as_string('last_time')} AS fetch_from, k % 4 <> 0 AS from_exclusive, {as_string("least(CAST(m + INTERVAL 1 MONTH AS TIMESTAMP), TIMESTAMP '2001-07-20 00:00:00')")} AS fetch_to FROM l""",
}
