"""Manifests of bar partitions: summaries, revisions, and checks against themselves and their bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.canonical import canonical_json

NO_RESAMPLER = "none"
# The tag of revisions, and the numbers by which they write units, price bases and an unset time.
REVISION_TAG = "manifest-revision-v1"
UNITS = {"m": 0, "h": 1, "d": 2, "w": 3}
BASES = {"bid": 1, "mid": 2, "ask": 3}
UNSET_TIME = -6795364578871345152


def summary(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("bar_count"), F.min("time").alias("first_bar"), F.max("time").alias("last_bar"))


def _interval(c: str) -> tuple[Column, Column]:
    """Number of the unit, and count, of an interval token."""
    unit = F.substring(c, 1, 1)
    return F.coalesce(*[F.when(unit == k, n) for k, n in UNITS.items()]), F.expr(f"try_cast(substring({c}, 2) AS int)")


def _nanos(c: str) -> Column:
    return F.coalesce((cal.seconds_between(F.col(c), F.lit("1970-01-01").cast("timestamp_ntz")) * 1_000_000_000).cast("bigint"), F.lit(UNSET_TIME))


def revision() -> Column:
    """sha256 (hex) of what makes a manifest, as JSON in a fixed order of fields; when it was built isn't part of it.

    Being JSON, no text can be read as two fields, and a missing parent is no empty one. Texts that are null count as empty, an unknown basis as 0.
    """
    unit, count = _interval("interval")
    of_parent = _interval("parent_interval")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parent = F.struct(text("parent_instrument").alias("instrument"), of_parent[0].alias("interval_unit"), of_parent[1].alias("interval_count"), text("parent_revision").alias("revision"))
    fields = F.struct(
        F.lit(REVISION_TAG).alias("version"), text("provider").alias("provider"), text("instrument_id").alias("instrument"), unit.alias("interval_unit"), count.alias("interval_count"), _nanos("span_start").alias("span_start"),
        _nanos("span_end").alias("span_end"), F.coalesce(*[F.when(F.col("basis") == k, n) for k, n in BASES.items()], F.lit(0)).alias("basis"), F.col("schema_version"), text("raw_fingerprint").alias("raw_fingerprint"),
        text("builder_version").alias("builder_version"), text("validator_version").alias("validator_version"), text("resampler_version").alias("resampler_version"), text("calendar_version").alias("calendar_version"), F.col("bar_count"),
        _nanos("first_bar").alias("first_bar"), _nanos("last_bar").alias("last_bar"), F.when(F.col("parent_revision").isNotNull(), parent).alias("parent"),
    )
    return F.sha2(canonical_json(fields), 256)


def manifest_error() -> Column:
    """The first rule that a manifest breaks, or null."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    within = lambda c: (F.col(c) >= F.col("span_start")) & (F.col(c) < F.col("span_end"))
    n, first, last = F.col("bar_count"), F.col("first_bar"), F.col("last_bar")
    unset = first.isNull() | last.isNull()
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, s) for k, s in cal.NOMINAL_SECONDS.items()])
    parent, plain = F.col("parent_revision").isNotNull(), F.col("resampler_version") == NO_RESAMPLER
    bar_range = F.when(n == 0, first.isNotNull() | last.isNotNull()).when(n == 1, unset | (first != last) | ~within("first_bar")).otherwise(unset | (last <= first) | ~within("first_bar") | ~within("last_bar"))
    return (
        F.when(missing("provider"), "provider").when(missing("instrument_id"), "instrument").when(rank("interval").isNull(), "interval")
        .when(F.col("span_start").isNull() | F.col("span_end").isNull() | (F.col("span_end") <= F.col("span_start")), "span").when(~F.coalesce(F.col("basis").isin("bid", "ask", "mid"), F.lit(False)), "basis")
        .when(~F.coalesce(F.col("schema_version") > 0, F.lit(False)), "schema_version").when(~F.coalesce(F.col("raw_fingerprint").rlike("^[a-z0-9]+:[0-9a-f]+$"), F.lit(False)), "fingerprint")
        .when(missing("builder_version") | missing("validator_version") | missing("resampler_version") | missing("calendar_version"), "version").when(F.col("built_at").isNull(), "built_at")
        .when(n < 0, "bar_count").when(F.coalesce(bar_range, F.lit(True)), "bar_range").when(parent == plain, "parent")
        .when(parent & ((F.col("parent_instrument") != F.col("instrument_id")) | F.coalesce(rank("parent_interval") >= rank("interval"), F.lit(True))), "parent")
    )


def against_bars(manifests: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Manifests with mismatch: count, first or last where the stored summary isn't that of the bars, or null."""
    found = summary(bars, keys).select(*keys, F.col("bar_count").alias("_n"), F.col("first_bar").alias("_first"), F.col("last_bar").alias("_last"))
    joined = manifests.join(found, keys, "left")
    wrong = F.when(F.col("bar_count") != F.coalesce("_n", F.lit(0)), "count").when(~F.col("first_bar").eqNullSafe(F.col("_first")), "first").when(~F.col("last_bar").eqNullSafe(F.col("_last")), "last")
    return joined.withColumn("mismatch", wrong).drop("_n", "_first", "_last")


def key_mismatch(year: str = "year", month: str = "month") -> Column:
    """True where a manifest's span doesn't meet the month it is filed under."""
    start = F.make_date(year, month, F.lit(1)).cast("timestamp_ntz")
    end = F.add_months(F.make_date(year, month, F.lit(1)), 1).cast("timestamp_ntz")
    return ~((F.col("span_start") < end) & (F.col("span_end") > start))


def instrument_mismatch(symbol: str = "symbol") -> Column:
    """True where a manifest's instrument, less its kind, isn't spelled like the symbol it is filed under."""
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return plain(F.regexp_replace("instrument_id", "^[a-z]+:", "")) != plain(F.col(symbol))
