"""Actions that bring partitions up to date, as one job over all requests and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import coverage as cov

DOWNLOAD, REPAIR, NORMALIZE, DERIVE = "download_raw", "repair_raw", "normalize_canonical", "derive_canonical"
STAGE = {DOWNLOAD: 0, REPAIR: 0, NORMALIZE: 1, DERIVE: 2}
REASONS = {cov.MISSING: "missing", cov.INVALID: "invalid: rebuild", cov.STALE: "stale: raw fingerprint changed"}
DERIVE_REASONS = {cov.MISSING: "missing", cov.INVALID: "invalid: rebuild", cov.STALE: "stale: parent D1 revision changed"}
SKIPPED = {REPAIR: "needs an explicit repair", DOWNLOAD: "no download in this step", NORMALIZE: "no build in this step", DERIVE: "no build in this step"}


def extend_needed(latest: DataFrame, keys: list[str], interval: str, now: Column, holidays: DataFrame | None = None) -> DataFrame:
    """Keys of raw partitions to extend. ``latest`` (keys, year, month, row_count, last_time, last_complete, range_end): the last touched month of each request.

    A provisional last row is reason enough; else some open bar must start after that of the last record (or of the month's start) and before the earlier of now and the range's end.
    """
    unit, count = cal.INTERVALS[interval]
    start = F.coalesce("last_time", F.make_date("year", "month", F.lit(1)).cast("timestamp_ntz"))
    provisional = (F.col("row_count") > 0) & ~F.coalesce(F.col("last_complete"), F.lit(False))
    spans = latest.select(*keys, provisional.alias("_p"), cal.bar_end(start, unit, count).alias("start_ts"), F.least("range_end", now).alias("end_ts"))
    sure = spans.where("_p").select(*keys)
    walked = cal.spine(spans.where(~F.col("_p") & (F.col("start_ts") < F.col("end_ts"))), keys, unit, count)
    open_bars = cal.with_session(walked, "bar_start", holidays).where(F.col("status") == cal.OPEN).select(*keys)
    return sure.unionByName(open_bars).distinct()


def raw_actions(months: DataFrame, keys: list[str], extend: DataFrame) -> DataFrame:
    """Actions of raw-built intervals. ``months`` (keys, year, month, status: of coverage, raw_status or null) for every touched month; ``extend`` from ``extend_needed``.

    Without raw nothing later runs in that month; a broken raw file is only reported; the last month may need both a download and a rebuild.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("year"), F.desc("month"))) == 1
    joined = months.withColumn("_last", last).join(extend.select(*keys).distinct().withColumn("_x", F.lit(True)), keys, "left")
    grow = F.col("_last") & F.coalesce(F.col("_x"), F.lit(False))
    action = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    ok = F.col("raw_status") == "ok"
    reason = F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in REASONS.items()], F.when(grow, F.lit("extend: rebuild once raw catches up")))
    found = F.array(
        F.when(F.col("raw_status").isNull(), action(DOWNLOAD, F.lit("missing"))), F.when(~ok, action(REPAIR, F.concat(F.lit("raw partition "), F.col("raw_status")))),
        F.when(ok & grow, action(DOWNLOAD, F.lit("extend"))), F.when(ok & reason.isNotNull(), action(NORMALIZE, reason)),
    )
    each = joined.select(*keys, "year", "month", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a"))
    return each.select(*keys, "year", "month", "a.kind", "a.reason")


def derive_actions(weekly: DataFrame, daily: DataFrame, day_gaps: DataFrame, week_gaps: DataFrame, keys: list[str], whole_day_gaps: DataFrame | None = None) -> DataFrame:
    """Actions of weekly partitions: one not current is derived once its month's days are all current and without gaps; a current one, once a week that it lacks has become ready.

    ``weekly`` and ``daily`` (keys, year, month, status); gaps (keys, year, month, gap_start, gap_end). ``whole_day_gaps``: gaps of all days that a week may need, where ``day_gaps`` are only those within the range asked for.
    """
    month = [*keys, "year", "month"]
    ready = daily.where(F.col("status") == cov.CURRENT).select(*month).join(day_gaps.select(*month).distinct(), month, "left_anti")
    reason = F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in DERIVE_REASONS.items()])
    fresh = weekly.where(F.col("status") != cov.CURRENT).join(ready, month, "left_semi").select(*month, F.lit(DERIVE).alias("kind"), reason.alias("reason"))
    lacking = week_gaps.join(weekly.where(F.col("status") == cov.CURRENT).select(*month), month, "left_semi")
    spans = lacking.select(*keys, F.col("gap_start").alias("bar_start"), F.col("gap_end").alias("bar_end")).distinct()
    able = cov.ready_weeks(spans, daily, day_gaps if whole_day_gaps is None else whole_day_gaps, keys).select(*keys, "bar_start")
    again = lacking.withColumn("bar_start", F.col("gap_start")).join(able, [*keys, "bar_start"], "left_semi").select(*month).distinct()
    return fresh.unionByName(again.select(*month, F.lit(DERIVE).alias("kind"), F.lit("gap: D1 input now available for a previously incomplete week").alias("reason")))


def staged(actions: DataFrame) -> DataFrame:
    """Add stage: raw actions first (0), then builds, then derivations."""
    return actions.withColumn("stage", F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in STAGE.items()]))


def ordered(actions: DataFrame, keys: list[str]) -> DataFrame:
    """By stage, then by month."""
    return staged(actions).orderBy("stage", *keys, "year", "month", "kind")


def positions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Add stage and position: the place of an action among those of its keys, from 1, in the order of ``ordered``."""
    return staged(actions).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("stage", "year", "month", "kind")))


def skipped(actions: DataFrame, executed: tuple[str, ...]) -> DataFrame:
    """Actions that a step doesn't execute, and why."""
    rest = actions.where(~F.col("kind").isin(*executed))
    return rest.withColumn("why", F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in SKIPPED.items()]))
