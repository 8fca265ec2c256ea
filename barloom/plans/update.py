"""Update by dependency: normalise what changed in raw archives, derive the weekly months that depend on it, until no action is left that can be run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import bars as ops
from ..operators import coverage as cov
from ..operators import manifests
from ..sources import raw, store
from ..sources.shared import settle
from . import planner

VERSIONS = {"builder_version": "1", "validator_version": "1", "calendar_version": "1"}
KEYS = ["provider", "symbol", "interval"]
PAIR = ["provider", "symbol"]
MONTH = ["year", "month"]
WEEKLY, DAILY = "w1", "d1"


@dataclass
class Update:
    """actions: what was found to do at first; executed: what was run, with round (from 1); blocked: partitions with bad rows; read: paths of the raw files that had to be read to plan.

    left: all that is still to do afterwards (empty when all went well), with runnable: whether this step could have run it; downloads and repairs it can't, nor rebuilds that wait for raw files to grow.
    """

    actions: DataFrame
    executed: DataFrame
    blocked: DataFrame
    left: DataFrame
    read: DataFrame


def with_manifest(bars: DataFrame, fingerprints: DataFrame, built_at: Column, resampler: str = manifests.NO_RESAMPLER) -> DataFrame:
    """Manifests of ``bars`` by month: summary, span (the whole month), fingerprint of the raw file or parents (keys, raw_fingerprint), and revision."""
    month = [*KEYS, "year", "month"]
    start = F.make_date("year", "month", F.lit(1))
    found = fingerprints.join(manifests.summary(bars, month), month, "left").withColumns(
        {
            "bar_count": F.coalesce("bar_count", F.lit(0)), "instrument_id": F.concat(F.lit("fx:"), F.substring("symbol", 1, 3), F.lit("/"), F.substring("symbol", 4, 3)), "span_start": start.cast("timestamp_ntz"),
            "span_end": F.add_months(start, 1).cast("timestamp_ntz"), "basis": F.lit("bid"), "schema_version": F.lit(1), "resampler_version": F.lit(resampler), "built_at": built_at,
        } | {k: F.lit(v) for k, v in VERSIONS.items()}
    )
    for c in ("parent_instrument", "parent_interval", "parent_revision"):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast("string"))
    return found.withColumn("revision", manifests.revision())


def normalise_archive(spark: SparkSession, archive: str, canonical: str, now: Column, only: DataFrame | None = None) -> DataFrame:
    """Normalise the raw files under ``archive`` (those of ``only``: keys, year, month, path, modified; no others are opened) and publish their bars and manifests; returns blocked partitions with offenders.

    One job for all files; a blocked file publishes nothing and does not hold up others.
    """
    month = [*KEYS, *MONTH]
    files = raw.scan(spark, archive) if only is None else raw.read_some(spark, archive, only)
    files = files.where("file_status = 'ok'")
    bars, gates, _ = ops.normalise(raw.records(files, checked=True), month)
    gates = settle(gates)
    bars = settle(bars)
    good = settle(files.join(gates.where("blocked"), month, "left_anti").select(*month, F.col("fingerprint").alias("raw_fingerprint")))
    store.publish(bars, with_manifest(bars, good, now), canonical)
    return gates.where("blocked")


def _next_month(df: DataFrame, by: int = 1) -> DataFrame:
    """``df`` with year and month moved on."""
    moved = F.add_months(F.make_date("year", "month", F.lit(1)), by)
    return df.withColumns({"year": F.year(moved), "month": F.month(moved)})


def _day_months(months: DataFrame) -> DataFrame:
    """The daily months that weeks which start in ``months`` (pair, year, month) may need: these, and the next ones."""
    own = months.select(*PAIR, *MONTH)
    return own.unionByName(_next_month(own)).distinct()


@dataclass
class Calendar:
    """What the calendar expects in the months that are looked at, worked out once and shared by all pairs: days (year, month, bar_start, bar_end, open, split) and weeks (year, month, bar_start, bar_end)."""

    days: DataFrame
    weeks: DataFrame

    @staticmethod
    def of(months: DataFrame) -> Calendar:
        """The calendar of ``months`` (year, month) and the ones after them, settled."""
        own = months.select(*MONTH).distinct()
        start = F.make_date("year", "month", F.lit(1))
        spans = own.unionByName(_next_month(own)).distinct().select(*MONTH, start.cast("timestamp_ntz").alias("start_ts"), F.add_months(start, 1).cast("timestamp_ntz").alias("end_ts"))
        spans = settle(spans)
        return Calendar(settle(cov.expected_bars(spans, [], DAILY)), settle(cal.spine(spans, MONTH, "week")))


def _weeks(months: DataFrame, calendar: Calendar) -> DataFrame:
    """Weeks that start in ``months`` (pair, year, month): pair, bar_start, bar_end."""
    return months.select(*PAIR, *MONTH).join(calendar.weeks, MONTH).select(*PAIR, "bar_start", "bar_end")


def _day_gaps(spans: DataFrame, daily: DataFrame, status: DataFrame, now: Column, calendar: Calendar) -> DataFrame:
    """Gaps of days within ``spans`` (pair, start_ts, end_ts), in months whose daily ``status`` is current: only these have a spine."""
    months = cov.month_spans(spans, PAIR).join(status.where(F.col("status") == cov.CURRENT).select(*PAIR, *MONTH), [*PAIR, *MONTH], "left_semi")
    return settle(cov.gaps(cov.interval_states(months, daily.select(*PAIR, "time"), PAIR, DAILY, now, calendar=calendar.days), [*PAIR, *MONTH]))


def _gaps_of_weeks(weeks: DataFrame, daily: DataFrame, status: DataFrame, now: Column, calendar: Calendar) -> DataFrame:
    return _day_gaps(weeks.groupBy(*PAIR).agg(F.min("bar_start").alias("start_ts"), F.max("bar_end").alias("end_ts")), daily, status, now, calendar)


@dataclass
class Snapshot:
    """What there is of some months, looked at once: held (manifests), errors (partition keys, error), known (of raw files; fingerprint, status, counts) and read (paths of raw files that had to be read), all settled."""

    held: DataFrame
    errors: DataFrame
    known: DataFrame
    read: DataFrame

    @staticmethod
    def of(spark: SparkSession, archive: str | None, canonical: str, months: DataFrame) -> Snapshot:
        """Of ``months`` (keys, year, month). Without an archive nothing is known of raw files."""
        months = settle(months.select(*KEYS, *MONTH).distinct())
        held, errors = store.verify(spark, canonical, months)
        if archive:
            files, read = raw.known_files(spark, archive, f"{canonical}/inventory", months)
            files = files.withColumn("status", F.col("file_status"))
        else:
            files = spark.createDataFrame([], "provider string, symbol string, interval string, year int, month int, path string, modified timestamp, fingerprint string, status string, row_count bigint, incomplete_rows bigint, last_time timestamp_ntz, last_complete boolean")
            read = files.select("path")
        return Snapshot(settle(held), settle(errors), settle(files), settle(read))

    def daily(self, months: DataFrame) -> DataFrame:
        """Status of the daily ``months`` (pair, year, month): missing, invalid, stale against the archive, or current."""
        only = months.withColumn("interval", F.lit(DAILY))
        return settle(cov.partition_status(only, self.held, self.known, self.errors, KEYS).select(*PAIR, *MONTH, "status"))

    def parents(self) -> DataFrame:
        """Daily manifests that can be trusted."""
        return self.held.where(F.col("interval") == DAILY).join(self.errors, store.PARTITION, "left_anti").select(*PAIR, *MONTH, "revision", "raw_fingerprint")


def _bars(spark: SparkSession, canonical: str, months: DataFrame, interval: str) -> DataFrame:
    return store.load(spark, canonical, months.select(*PAIR, *MONTH).withColumn("interval", F.lit(interval)))[0]


def _of_requests(requests: DataFrame) -> DataFrame:
    """``requests`` by month: keys, year, month, start_ts, end_ts."""
    return cov.month_spans(requests.select(*KEYS, F.col("from_ts").alias("start_ts"), F.col("to_ts").alias("end_ts")), KEYS)


def _looked_at(asked: DataFrame) -> DataFrame:
    """The months that plans for ``asked`` (keys, year, month) need: these, and the daily ones below weekly ones."""
    below = _day_months(asked.where(F.col("interval") == WEEKLY)).withColumn("interval", F.lit(DAILY))
    return asked.select(*KEYS, *MONTH).unionByName(below.select(*KEYS, *MONTH))


def derive_weeks(spark: SparkSession, canonical: str, now: Column, only: DataFrame | None = None, archive: str | None = None, calendar: Calendar | None = None, snapshot: Snapshot | None = None) -> None:
    """Derive weekly bars from daily ones wherever a week's days are all there, and publish them by the month in which the week starts: the months ``only`` (pair, year, month), or all that have daily bars.

    A week is derived where the daily months that it touches are current (against ``archive``, if it is given) and have no gap in it. Other weeks are left out; their month is published without them, if need be empty. Lineage names the
    month's daily revision and, where the last week reaches over, the next one's.
    """
    if only is None:
        only = store.load(spark, canonical)[1].where(F.col("interval") == DAILY)
    only = settle(only.select(*PAIR, *MONTH).distinct())
    calendar = calendar or Calendar.of(only)
    below = _day_months(only)
    snapshot = snapshot or Snapshot.of(spark, archive, canonical, below.withColumn("interval", F.lit(DAILY)))
    status, daily = snapshot.daily(below), _bars(spark, canonical, below, DAILY)
    weeks = _weeks(only, calendar)
    gaps = _gaps_of_weeks(weeks, daily, status, now, calendar)
    ready = cov.ready_weeks(weeks, status, gaps, PAIR).select(*PAIR, F.col("bar_start").alias("time"))
    weekly = ops.resample(daily, PAIR, WEEKLY).join(ready, [*PAIR, "time"], "left_semi")
    weekly = settle(weekly.withColumns({"interval": F.lit(WEEKLY), "year": F.year("time"), "month": F.month("time")}))
    parents = snapshot.parents()
    own = only.join(parents.select(*PAIR, *MONTH, F.struct("revision", "raw_fingerprint").alias("_own")), [*PAIR, *MONTH])
    after = _next_month(parents.select(*PAIR, *MONTH, F.struct("revision", "raw_fingerprint").alias("_next")), -1)
    last = weekly.groupBy(*PAIR, *MONTH).agg(F.max(cal.week_end(F.col("time"))).alias("_end"))
    joined = own.join(after, [*PAIR, *MONTH], "left").join(last, [*PAIR, *MONTH], "left")
    crosses = (F.col("_end") > F.add_months(F.make_date("year", "month", F.lit(1)), 1).cast("timestamp_ntz")) & F.col("_next").isNotNull()
    of = lambda f: F.when(crosses, cov.composite_revision(f"_own.{f}", f"_next.{f}")).otherwise(F.col(f"_own.{f}"))
    pair = F.concat(F.lit("fx:"), F.substring("symbol", 1, 3), F.lit("/"), F.substring("symbol", 4, 3))
    prints = joined.select(*PAIR, F.lit(WEEKLY).alias("interval"), *MONTH, of("raw_fingerprint").alias("raw_fingerprint"), of("revision").alias("parent_revision"), pair.alias("parent_instrument"), F.lit(DAILY).alias("parent_interval"))
    store.publish(weekly, with_manifest(weekly, settle(prints), now, resampler="1"), canonical)


def weekly_actions(spark: SparkSession, canonical: str, asked: DataFrame, now: Column, snapshot: Snapshot, calendar: Calendar) -> DataFrame:
    """Derivations that the weekly ones of ``asked`` (keys, year, month, start_ts, end_ts) need. Days count as they are in the snapshot: stale ones aren't ready."""
    asked = asked.where(F.col("interval") == WEEKLY).drop("interval")
    own = asked.select(*PAIR, *MONTH).distinct()
    days, daily = snapshot.daily(_day_months(own)), _bars(spark, canonical, _day_months(own), DAILY)
    weekly = F.col("interval") == WEEKLY
    status = settle(cov.derived_status(own, snapshot.held.where(weekly), snapshot.parents(), snapshot.errors.where(weekly), PAIR))
    current = asked.join(status.where(F.col("status") == cov.CURRENT).select(*PAIR, *MONTH), [*PAIR, *MONTH], "left_semi")
    week_gaps = settle(cov.gaps(cov.week_states(current, _bars(spark, canonical, own, WEEKLY), PAIR, now, calendar.weeks), [*PAIR, *MONTH]))
    day_gaps = _day_gaps(asked, daily, days, now, calendar)
    whole = _gaps_of_weeks(_weeks(own, calendar), daily, days, now, calendar)
    found = planner.derive_actions(status, days, day_gaps, week_gaps, PAIR, whole)
    return settle(found.select(*PAIR, F.lit(WEEKLY).alias("interval"), *MONTH, "kind", "reason"))


def raw_actions(asked: DataFrame, now: Column, snapshot: Snapshot) -> DataFrame:
    """Actions that the raw-built ones of ``asked`` (keys, year, month, start_ts, end_ts) need."""
    month = [*KEYS, *MONTH]
    months = asked.where(F.col("interval") != WEEKLY)
    status = settle(cov.partition_status(months, snapshot.held, snapshot.known, snapshot.errors, KEYS))
    everything = status.join(snapshot.known.select(*month, F.col("status").alias("raw_status")), month, "left")
    last = F.max_by(F.struct("year", "month"), F.struct("year", "month"))
    newest = months.groupBy(*KEYS).agg(last.alias("m"), F.max("end_ts").alias("range_end")).select(*KEYS, "m.*", "range_end").join(snapshot.known.where("status = 'ok'"), month)
    newest = settle(newest.select(*month, "range_end", "row_count", "last_time", "last_complete"))
    extend = newest.select(*KEYS).where(F.lit(False))
    for (interval,) in newest.select("interval").distinct().collect():  # of four
        extend = extend.unionByName(planner.extend_needed(newest.where(F.col("interval") == interval), KEYS, interval, now))
    return settle(planner.raw_actions(everything, KEYS, settle(extend)).select(*month, "kind", "reason"))


def coverage(spark: SparkSession, archive: str | None, canonical: str, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(partitions, gaps) of ``requests`` (provider, symbol, interval, from_ts, to_ts) in one job.

    partitions: each month touched (keys, year, month) with its status, which is settled first: missing, invalid, stale (against the archive, or against the revisions that it was derived from) or current, and incomplete_rows of its raw file.
    gaps (keys, year, month, state, gap_start, gap_end, bars): of current months only; no other gets a spine.
    """
    asked = settle(_of_requests(requests))
    seen = Snapshot.of(spark, archive, canonical, _looked_at(asked))
    weekly = F.col("interval") == WEEKLY
    built = cov.partition_status(asked.where(~weekly), seen.held, seen.known, seen.errors, KEYS)
    derived = cov.derived_status(asked.where(weekly).select(*PAIR, *MONTH), seen.held.where(weekly), seen.parents(), seen.errors.where(weekly), PAIR)
    derived = derived.select(*PAIR, F.lit(WEEKLY).alias("interval"), *MONTH, "status", F.lit(0).cast("bigint").alias("incomplete_rows"))
    partitions = settle(built.unionByName(derived))
    current = settle(asked.join(partitions.where(F.col("status") == cov.CURRENT).select(*KEYS, *MONTH), [*KEYS, *MONTH], "left_semi"))
    found = None
    for (interval,) in current.select("interval").distinct().collect():  # of five
        months = current.where(F.col("interval") == interval).drop("interval")
        bars = _bars(spark, canonical, months, interval)
        states = cov.week_states(months, bars, PAIR, now) if interval == WEEKLY else cov.interval_states(months, bars.select(*PAIR, "time"), PAIR, interval, now)
        one = cov.gaps(states, [*PAIR, *MONTH]).withColumn("interval", F.lit(interval))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "provider string, symbol string, year int, month int, state string, gap_start timestamp_ntz, gap_end timestamp_ntz, bars bigint, interval string")
    return partitions, found.select(*KEYS, *MONTH, "state", "gap_start", "gap_end", "bars")


def runnable() -> Column:
    """Whether this step can run an action: a rebuild that waits for a download would change nothing."""
    return F.col("kind").isin(planner.NORMALIZE, planner.DERIVE) & ~F.startswith(F.col("reason"), F.lit("extend"))


def run(spark: SparkSession, archive: str, canonical: str, requests: DataFrame, now: Column) -> Update:
    """Plan, build, and plan again until nothing is left that can be run: months whose raw files changed are normalised, then the weekly months that depend on their revisions are derived. Missing or broken raw files are reported, never fetched.

    What a run has tried once it doesn't try again, so months with bad rows end it as well. A run that finds nothing to do writes nothing to the store.
    """
    month, asked = [*KEYS, *MONTH], settle(_of_requests(requests))
    weekly = asked.where(F.col("interval") == WEEKLY)
    with_weeks = not weekly.isEmpty()
    calendar = Calendar.of(weekly) if with_weeks else None
    none = spark.createDataFrame([], "provider string, symbol string, interval string, year int, month int, kind string, reason string")
    look = lambda: Snapshot.of(spark, archive, canonical, _looked_at(asked))
    plan_weeks = lambda seen: weekly_actions(spark, canonical, asked, now, seen, calendar) if with_weeks else none
    seen = look()
    builds, weeks, read = raw_actions(asked, now, seen), plan_weeks(seen), seen.read
    first, rounds, blocked = builds.unionByName(weeks), [], None
    todo = builds.where(runnable())
    if not todo.isEmpty():
        blocked = normalise_archive(spark, archive, canonical, now, seen.known.where("status = 'ok'").join(todo.select(*month), month, "left_semi"))
        rounds.append(todo)
        seen = look()
        builds, weeks, read = raw_actions(asked, now, seen), plan_weeks(seen), read.unionByName(seen.read)
    while with_weeks:
        # what was derived once isn't tried again
        todo = weeks
        for done in rounds:
            todo = todo.join(done, [*month, "kind", "reason"], "left_anti")
        if (todo := settle(todo)).isEmpty():
            break
        derive_weeks(spark, canonical, now, todo, archive, calendar, seen)
        rounds.append(todo)
        seen = look()
        weeks = plan_weeks(seen)
    executed = none.withColumn("round", F.lit(0))
    for number, done in enumerate(rounds, 1):
        executed = executed.unionByName(done.withColumn("round", F.lit(number)))
    if blocked is None:
        blocked = ops.gate(spark.createDataFrame([], "provider string, symbol string, interval string, year int, month int, line_no int, reason string, outcome string"), month)
    return Update(planner.ordered(first, KEYS), executed, blocked, builds.unionByName(weeks).withColumn("runnable", runnable()), read.distinct())
