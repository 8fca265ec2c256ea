"""The FX trading calendar as column expressions on UTC TIMESTAMP_NTZ columns.

The day rolls at 17:00 New York, the week opens on Sunday and closes on Friday at that time. Nothing here depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"
ROLL_HOUR = 17
SECONDS = {"minute": 60, "hour": 3600}
#: Interval tokens: unit and count.
INTERVALS = {"m1": ("minute", 1), "h1": ("hour", 1), "h4": ("hour", 4), "d1": ("day", 1), "w1": ("week", 1)}
NOMINAL_SECONDS = {"m1": 60, "h1": 3600, "h4": 14400, "d1": 86400, "w1": 604800}

OPEN, CLOSED, HOLIDAY = "open", "closed", "holiday"


def finer(a: str, b: str) -> bool:
    """Whether interval token ``a`` is strictly finer than ``b``."""
    return NOMINAL_SECONDS[a] < NOMINAL_SECONDS[b]


def to_local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def to_utc(local: Column) -> Column:
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def at_hour(date: Column, hour: int) -> Column:
    """UTC instant of a New York date at a full hour."""
    return to_utc(date.cast("timestamp_ntz") + hours(hour))


def session_date(ts: Column) -> Column:
    """New York date on which the trading day that holds ``ts`` began."""
    return (to_local(ts) - hours(ROLL_HOUR)).cast("date")


def day_start(ts: Column) -> Column:
    return at_hour(session_date(ts), ROLL_HOUR)


def day_end(ts: Column) -> Column:
    return at_hour(F.date_add(session_date(ts), 1), ROLL_HOUR)


def week_start(ts: Column) -> Column:
    d = session_date(ts)
    return at_hour(F.date_sub(d, F.dayofweek(d) - 1), ROLL_HOUR)


def week_end(ts: Column) -> Column:
    d = session_date(ts)
    return at_hour(F.date_add(d, 8 - F.dayofweek(d)), ROLL_HOUR)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (later - earlier).cast("interval second").cast("decimal(18,6)")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def check_interval(unit: str, count: int) -> None:
    """Only bars that divide a trading day, single days and single weeks are aligned."""
    fine = {"minute": 1440, "hour": 24}.get(unit)
    if count < 1 or (fine and fine % count) or (not fine and (unit not in ("day", "week") or count != 1)):
        raise ValueError(f"no aligned bars of {count} {unit}")


def bar_start(ts: Column, unit: str, count: int = 1) -> Column:
    """Start of the bar that holds ``ts``; bars of minutes and hours are counted from the trading day's start."""
    check_interval(unit, count)
    if unit == "day":
        return day_start(ts)
    if unit == "week":
        return week_start(ts)
    step, start = SECONDS[unit] * count, day_start(ts)
    return plus_seconds(start, F.floor(seconds_between(ts, start) / step) * step)


def bar_end(ts: Column, unit: str, count: int = 1) -> Column:
    """End of the bar that holds ``ts``: the last one of a trading day is cut at the day's end."""
    check_interval(unit, count)
    if unit == "day":
        return day_end(ts)
    if unit == "week":
        return week_end(ts)
    return F.least(plus_seconds(bar_start(ts, unit, count), F.lit(SECONDS[unit] * count)), day_end(ts))


def contains(ts: Column, start: Column, end: Column) -> Column:
    """Whether the half-open range [start, end) holds ``ts``."""
    return (ts >= start) & (ts < end)


def elapsed(end: Column, now: Column) -> Column:
    """Whether a range that ends at ``end`` has passed at ``now``."""
    return now >= end


def duration(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``."""
    return seconds_between(end, start)


def standard_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """date, kind ('full' or 'partial') and from_hour (New York, of partial closures) for each year: New Year's Day, Christmas and the day after; from 13:00 on the eves."""
    days = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(kind).alias("kind"), F.lit(h).cast("int").alias("from_hour")) for m, d, kind, h in ((1, 1, "full", None), (12, 24, "partial", 13), (12, 25, "full", None), (12, 26, "full", None), (12, 31, "partial", 13))]
        )
    ).alias("x")
    return spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), days).select(F.make_date("year", "x.m", "x.d").alias("date"), "x.kind", "x.from_hour")


def with_session(df: DataFrame, ts: str, holidays: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Add status, session_start and session_end (null unless open) of the instant in column ``ts``.

    ``holidays`` (date, kind, from_hour; a few rows a year) is broadcast. Order of the rules: weekend; a holiday Sunday from its
    rollover on; a session that ends on a holiday; one past its partial closure; else open. The open window ends at a partial closure, and begins at Monday
    midnight New York after a holiday Sunday.
    """
    t = F.col(ts)
    out, status, start, end = df, f"{prefix}status", f"{prefix}session_start", f"{prefix}session_end"
    local, date = to_local(t), session_date(t)
    day, past_roll = F.dayofweek(local), F.hour(local) >= ROLL_HOUR
    closed = (day == 7) | ((day == 6) & past_roll) | ((day == 1) & ~past_roll)
    opens, ends = day_start(t), day_end(t)
    if holidays is None:
        state = F.when(closed, CLOSED).otherwise(OPEN)
    else:
        full = F.broadcast(holidays.where("kind = 'full'").select(F.col("date").alias("_h")))
        part = F.broadcast(holidays.where("kind = 'partial'").groupBy(F.col("date").alias("_p")).agg(F.min("from_hour").alias("_from")))
        out = out.withColumns({"_start_date": date, "_end_date": F.date_add(date, 1)})
        out = out.join(full.select(F.col("_h").alias("_on_end")).distinct(), F.col("_end_date") == F.col("_on_end"), "left")
        out = out.join(full.select(F.col("_h").alias("_on_start")).distinct(), F.col("_start_date") == F.col("_on_start"), "left")
        out = out.join(part, F.col("_end_date") == F.col("_p"), "left")
        cut = F.when(F.col("_from").isNotNull(), to_utc(F.col("_end_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_from"))))
        sunday = F.dayofweek("_start_date") == 1
        # from its rollover to midnight, a holiday Sunday is the session's own start date
        head = sunday & F.col("_on_start").isNotNull() & (F.to_date(local) == F.col("_start_date"))
        state = F.when(closed, CLOSED).when(head | F.col("_on_end").isNotNull() | (cut.isNotNull() & (t >= cut)), HOLIDAY).otherwise(OPEN)
        reopen = at_hour(F.col("_end_date"), 0)
        opens = F.when(sunday & F.col("_on_start").isNotNull(), reopen).otherwise(opens)
        ends = F.least(F.coalesce(cut, ends), ends)
    out = out.withColumn(status, state)
    is_open = F.col(status) == OPEN
    return out.withColumns({start: F.when(is_open, opens), end: F.when(is_open, ends)}).drop("_start_date", "_end_date", "_on_end", "_on_start", "_p", "_from")


def spine(spans: DataFrame, keys: list[str], unit: str, count: int = 1) -> DataFrame:
    """Every bar that starts within each row's [start_ts, end_ts) of ``spans``: keys, bar_start, bar_end.

    Days are exploded first and then the bars of each day, so a row of many years is a few thousand rows, not one long array.
    """
    check_interval(unit, count)
    days = F.explode(F.sequence(F.date_sub(session_date(F.col("start_ts")), 7 if unit == "week" else 1), session_date(F.col("end_ts")))).alias("_d")
    by_day = spans.select(*keys, "start_ts", "end_ts", days)
    starts = at_hour(F.col("_d"), ROLL_HOUR)
    if unit == "day":
        bars = by_day.select(*keys, "start_ts", "end_ts", starts.alias("bar_start"), at_hour(F.date_add("_d", 1), ROLL_HOUR).alias("bar_end"))
    elif unit == "week":
        bars = by_day.where(F.dayofweek("_d") == 1).select(*keys, "start_ts", "end_ts", starts.alias("bar_start"), at_hour(F.date_add("_d", 7), ROLL_HOUR).alias("bar_end"))
    else:
        step = SECONDS[unit] * count
        with_day = by_day.select(*keys, "start_ts", "end_ts", starts.alias("_s"), at_hour(F.date_add("_d", 1), ROLL_HOUR).alias("_e"))
        n = F.ceil(seconds_between(F.col("_e"), F.col("_s")) / step)
        each = with_day.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("_i"))
        bars = each.select(*keys, "start_ts", "end_ts", plus_seconds(F.col("_s"), F.col("_i") * step).alias("bar_start"), F.least(plus_seconds(F.col("_s"), (F.col("_i") + 1) * step), F.col("_e")).alias("bar_end"))
    return bars.where((F.col("bar_start") >= F.col("start_ts")) & (F.col("bar_start") < F.col("end_ts"))).drop("start_ts", "end_ts")


def week_spans(months: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks that start in each month of ``months`` (keys, start_ts, end_ts), and coverage_end: where the last of them, or the month, ends."""
    weeks = spine(months, keys, "week")
    reach = weeks.groupBy(*keys).agg(F.max("bar_end").alias("_last"))
    joined = months.select(*keys, "end_ts").join(reach, keys, "left")
    return weeks.join(joined.select(*keys, F.greatest("end_ts", F.coalesce("_last", "end_ts")).alias("coverage_end")), keys)
