"""Coverage of bar partitions: expected intervals, their states, gaps, staleness and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal

PRESENT, CLOSED, UNEXPECTED, IN_PROGRESS, MISSING, INCOMPLETE, STRADDLE = "present", "closed", "unexpected", "in_progress", "missing", "incomplete", "straddle"
STALE, INVALID, CURRENT = "stale", "invalid", "current"


def month_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """[start_ts, end_ts) of each row to its calendar months: keys, year, month, and the span clipped to each month."""
    each = spans.select(*keys, "start_ts", "end_ts", F.explode(F.sequence(F.trunc("start_ts", "month"), F.trunc("end_ts", "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    first = F.col("_m").cast("timestamp_ntz")
    after = F.add_months("_m", 1).cast("timestamp_ntz")
    clipped = each.select(*keys, F.year("_m").alias("year"), F.month("_m").alias("month"), F.greatest(first, "start_ts").alias("start_ts"), F.least(after, "end_ts").alias("end_ts"))
    return clipped.where(F.col("start_ts") < F.col("end_ts"))


def expected_bars(months: DataFrame, keys: list[str], interval: str, holidays: DataFrame | None = None) -> DataFrame:
    """Every bar that starts in ``months`` (keys, year, month, start_ts, end_ts): keys, year, month, bar_start, bar_end, open (the market is at its start), split (that changes within the bar). Without keys it is the calendar itself, for many keys to share."""
    unit, count = cal.INTERVALS[interval]
    expected = cal.spine(months, [*keys, "year", "month"], unit, count).withColumn("_last", F.col("bar_end") - F.expr("INTERVAL '0.000001' SECOND"))
    expected = cal.with_session(cal.with_session(expected, "bar_start", holidays, "s_"), "_last", holidays, "e_")
    split = (F.col("s_status") != F.col("e_status")) | ((F.col("s_status") == cal.OPEN) & ((F.col("s_session_start") > F.col("bar_start")) | (F.col("s_session_end") < F.col("bar_end"))))
    return expected.select(*keys, "year", "month", "bar_start", "bar_end", (F.col("s_status") == cal.OPEN).alias("open"), split.alias("split"))


def clipped(months: DataFrame, keys: list[str], calendar: DataFrame) -> DataFrame:
    """``months`` (keys, year, month, start_ts, end_ts) with the bars of a shared ``calendar`` (year, month, bar_start, ...) that start within each."""
    own = months.select(*keys, "year", "month", "start_ts", "end_ts").join(calendar, ["year", "month"])
    return own.where((F.col("bar_start") >= F.col("start_ts")) & (F.col("bar_start") < F.col("end_ts"))).drop("start_ts", "end_ts")


def interval_states(months: DataFrame, bars: DataFrame, keys: list[str], interval: str, now: Column, holidays: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """State of every expected bar of ``months`` (keys, year, month, start_ts, end_ts) against stored ``bars`` (keys, time, and complete if there is such a column).

    In this order: straddle (the calendar changes within the bar), closed or unexpected, in progress at ``now``, missing, incomplete, present. ``calendar``: ``expected_bars`` of all these months, without keys, if they are there already.
    """
    expected = expected_bars(months, keys, interval, holidays) if calendar is None else clipped(months, keys, calendar)
    complete = F.col("complete") if "complete" in bars.columns else F.lit(True)
    stored = bars.select(*keys, F.col("time").alias("bar_start"), F.struct(complete.alias("complete")).alias("_bar"))
    here = F.col("_bar").isNotNull()
    state = (
        F.when(F.col("split"), STRADDLE).when(~F.col("open") & here, UNEXPECTED).when(~F.col("open"), CLOSED).when(F.col("bar_end") > now, IN_PROGRESS)
        .when(~here, MISSING).when(~F.col("_bar.complete"), INCOMPLETE).otherwise(PRESENT)
    )
    return expected.join(stored, [*keys, "bar_start"], "left").select(*keys, "year", "month", "bar_start", "bar_end", state.alias("state"))


def week_states(months: DataFrame, bars: DataFrame, keys: list[str], now: Column, calendar: DataFrame | None = None) -> DataFrame:
    """State of every week that starts in ``months`` (keys, year, month, start_ts, end_ts) against stored weekly ``bars`` (keys, time): in progress at ``now``, present or missing.

    A week always holds a weekend, so what the calendar says within it doesn't count. ``calendar``: weeks (year, month, bar_start, bar_end) of all these months, if they are there already.
    """
    expected = cal.spine(months, [*keys, "year", "month"], "week") if calendar is None else clipped(months, keys, calendar)
    stored = bars.select(*keys, F.col("time").alias("bar_start"), F.lit(True).alias("_here")).distinct()
    state = F.when(~cal.elapsed(F.col("bar_end"), now), IN_PROGRESS).when(F.col("_here"), PRESENT).otherwise(MISSING)
    return expected.join(stored, [*keys, "bar_start"], "left").select(*keys, "year", "month", "bar_start", "bar_end", state.alias("state"))


def gaps(states: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of contiguous bars in one state other than present and closed, within each key (with year and month: never across months)."""
    w = Window.partitionBy(*keys).orderBy("bar_start")
    fresh = F.when((F.lag("state").over(w) == F.col("state")) & (F.lag("bar_end").over(w) == F.col("bar_start")), 0).otherwise(1)
    islands = states.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    return islands.where(~F.col("state").isin(PRESENT, CLOSED)).groupBy(*keys, "state", "_island").agg(F.min("bar_start").alias("gap_start"), F.max("bar_end").alias("gap_end"), F.count("*").alias("bars")).drop("_island")


def completeness(states: DataFrame, keys: list[str]) -> DataFrame:
    """Complete where every bar is present or closed."""
    return states.groupBy(*keys).agg(F.bool_and(F.col("state").isin(PRESENT, CLOSED)).alias("complete"), F.count("*").alias("intervals"), F.count_if(F.col("state") == MISSING).alias("missing"))


def raw_staleness(manifests: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Add stale: the stored fingerprint is not that of the raw partition now. Without a readable raw partition nothing is called stale."""
    now = raw.select(*keys, F.col("fingerprint").alias("_now"), F.col("status").alias("_ok"))
    known = (F.col("_ok") == "ok") & F.col("_now").isNotNull()
    return manifests.join(now, keys, "left").withColumn("stale", F.coalesce(known & (F.col("raw_fingerprint") != F.col("_now")), F.lit(False))).drop("_now", "_ok")


def derived_staleness(weekly: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """Add stale to ``weekly`` manifests (keys, year, month, parent_revision, crosses): the parents' revision recomputed from ``daily`` (keys, year, month, revision) differs.

    The parents are the month's daily manifest and, where the last week crosses over, next month's. A missing parent never makes one stale.
    """
    month = F.make_date("year", "month", F.lit(1))
    one = daily.select(*keys, "year", "month", F.col("revision").alias("_own"))
    following = F.add_months(F.make_date("year", "month", F.lit(1)), -1)
    two = daily.select(*keys, F.year(following).alias("year"), F.month(following).alias("month"), F.col("revision").alias("_next"))
    joined = weekly.withColumn("_m", month).join(one, [*keys, "year", "month"], "left").join(two, [*keys, "year", "month"], "left")
    wanted = F.when(~F.col("crosses"), F.col("_own")).when(F.col("_own").isNotNull() & F.col("_next").isNotNull(), composite_revision("_own", "_next"))
    return joined.withColumn("stale", F.coalesce(wanted != F.col("parent_revision"), F.lit(False))).drop("_m", "_own", "_next")


def composite_revision(*revisions: str | Column) -> Column:
    """One revision of several parents, in order."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *revisions), 256))


def ready_weeks(weeks: DataFrame, partitions: DataFrame, day_gaps: DataFrame, keys: list[str]) -> DataFrame:
    """``weeks`` (keys, bar_start, bar_end) whose daily partitions are all current and that no daily gap overlaps.

    ``partitions`` (keys, year, month, status); ``day_gaps`` (keys, gap_start, gap_end). Joins run on keys and month, so they stay equi-joins.
    """
    last = F.col("bar_end") - F.expr("INTERVAL '0.000001' SECOND")
    months = F.explode(F.sequence(F.trunc("bar_start", "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m")
    touched = weeks.select(*keys, "bar_start", "bar_end", months).select(*keys, "bar_start", "bar_end", F.year("_m").alias("year"), F.month("_m").alias("month"))
    current = touched.join(partitions.select(*keys, "year", "month", "status"), [*keys, "year", "month"], "left")
    good = current.groupBy(*keys, "bar_start", "bar_end").agg(F.bool_and(F.coalesce(F.col("status") == CURRENT, F.lit(False))).alias("_good")).where("_good").drop("_good")
    gap_last = F.col("gap_end") - F.expr("INTERVAL '0.000001' SECOND")
    of_gap = F.explode(F.sequence(F.trunc("gap_start", "month"), F.trunc(gap_last, "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m")
    spread = day_gaps.select(*keys, "gap_start", "gap_end", of_gap).select(*keys, F.year("_m").alias("year"), F.month("_m").alias("month"), "gap_start", "gap_end")
    hit = touched.join(spread, [*keys, "year", "month"]).where((F.col("gap_start") < F.col("bar_end")) & (F.col("gap_end") > F.col("bar_start"))).select(*keys, "bar_start").distinct()
    return good.join(hit, [*keys, "bar_start"], "left_anti")


def partition_status(months: DataFrame, manifests: DataFrame, raw: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each month (keys, year, month): missing (no manifest), invalid (in ``violations``), stale, or current; with the raw partition's incomplete rows."""
    own = [*keys, "year", "month"]
    held = raw_staleness(manifests, raw, own).select(*own, "stale", F.lit(True).alias("_held"))
    bad = violations.select(*own).distinct().withColumn("_bad", F.lit(True))
    joined = months.select(*own).distinct().join(held, own, "left").join(bad, own, "left").join(raw.select(*own, "incomplete_rows"), own, "left")
    status = F.when(F.col("_held").isNull(), MISSING).when(F.col("_bad"), INVALID).when(F.col("stale"), STALE).otherwise(CURRENT)
    return joined.select(*own, status.alias("status"), F.coalesce("incomplete_rows", F.lit(0)).alias("incomplete_rows"))


def derived_status(months: DataFrame, weekly: DataFrame, daily: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Status of weekly ``months`` (keys, year, month): missing, invalid, stale (their parents' revisions are others now), or current.

    ``weekly`` manifests (keys, year, month, last_bar, span_end, parent_revision), ``daily`` those that can be trusted (keys, year, month, revision).
    """
    own = [*keys, "year", "month"]
    crosses = F.coalesce(cal.week_end(F.col("last_bar")) > F.col("span_end"), F.lit(False))
    held = derived_staleness(weekly.withColumn("crosses", crosses), daily, keys).select(*own, "stale", F.lit(True).alias("_held"))
    bad = violations.select(*own).distinct().withColumn("_bad", F.lit(True))
    joined = months.select(*own).distinct().join(held, own, "left").join(bad, own, "left")
    status = F.when(F.col("_held").isNull(), MISSING).when(F.col("_bad"), INVALID).when(F.col("stale"), STALE).otherwise(CURRENT)
    return joined.select(*own, status.alias("status"))
