"""Bars: from ticks, from finer bars, and from bid/ask records with checks.

A bar has symbol keys, time (its start, UTC), open, high, low, close, avg_spread, max_spread (raw units) and ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import decimals as dec

SUSPICIOUS, REJECTED, INCOMPLETE, ACCEPTED = "suspicious", "rejected", "incomplete", "accepted"


def from_ticks(ticks: DataFrame, keys: list[str], interval: str) -> DataFrame:
    """``ticks`` (keys, ts, seq, price, spread) to bars of an interval token. Only partial aggregates are shuffled; nothing is sorted."""
    unit, count = cal.INTERVALS[interval]
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy(*keys, cal.bar_start(F.col("ts"), unit, count).alias("time"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum(dec.wide("spread")).alias("_sum"), F.max("spread").alias("max_spread"), F.count("*").alias("ticks"),
        )
        .select(*keys, "time", "open", "high", "low", "close", dec.in_range(dec.divide_half_even(F.col("_sum"), F.col("ticks"))).alias("avg_spread"), "max_spread", "ticks")
    )


def average_spread(weighted: Column, ticks: Column, compat: bool = False) -> Column:
    """Tick-weighted average of spreads. ``compat`` multiplies with the reciprocal of the ticks rounded to 8 places, as older files do: it is off for many ticks."""
    exact = dec.divide_half_even(weighted, ticks)
    if compat:
        inverse = dec.divide_half_even(F.lit(dec.SCALE).cast("decimal(20,0)"), ticks)
        exact = dec.divide_half_even(weighted.cast("decimal(26,0)") * inverse.cast("decimal(10,0)"), F.lit(dec.SCALE).cast("decimal(10,0)"))
    return F.when(ticks > 0, dec.in_range(exact)).otherwise(F.lit(0).cast("bigint"))


def resample(bars: DataFrame, keys: list[str], interval: str, compat: bool = False) -> DataFrame:
    """Finer ``bars`` to bars of a coarser interval token."""
    unit, count = cal.INTERVALS[interval]
    return (
        bars.withColumn("_t", F.col("time"))
        .groupBy(*keys, cal.bar_start(F.col("_t"), unit, count).alias("time"))
        .agg(
            F.min_by("open", "_t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_t").alias("close"),
            F.sum(F.when(F.col("ticks") > 0, dec.wide("avg_spread") * dec.wide("ticks")).otherwise(0)).alias("_w"), F.max("max_spread").alias("max_spread"), F.sum("ticks").alias("ticks"),
        )
        .select(*keys, "time", "open", "high", "low", "close", average_spread(F.col("_w"), F.col("ticks"), compat).alias("avg_spread"), "max_spread", "ticks")
    )


def mid_close(bid_close: Column | str = "close", avg_spread: Column | str = "avg_spread") -> Column:
    """Close between bid and ask: bid close plus half the average spread, half to even."""
    return dec.add(bid_close, dec.multiply(avg_spread, dec.SCALE // 2))


def violation() -> Column:
    """The first rule that a bar breaks, or null."""
    inside = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    return (
        F.when(F.col("time").isNull(), "time").when(F.col("high") < F.col("low"), "high_below_low").when(~inside("open"), "open_outside").when(~inside("close"), "close_outside")
        .when(F.col("avg_spread") > F.col("max_spread"), "spread").when(F.col("ticks") < 0, "ticks")
    )


def set_violations(bars: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Bars of each set (keys) with reason: what ``violation`` says, outside the set's [span_start, span_end), or a time that doesn't follow the one before (by ``position``)."""
    before = F.lag("time").over(Window.partitionBy(*keys).orderBy(position))
    return bars.withColumn("_before", before).select(
        *bars.columns,
        F.coalesce(
            violation(), F.when((F.col("time") < F.col("span_start")) | (F.col("time") >= F.col("span_end")), "outside_span"), F.when(F.col("time") <= F.col("_before"), "order")
        ).alias("reason"),
    )


def spreads(prefix_bid: str = "bid_", prefix_ask: str = "ask_") -> dict[str, Column]:
    """Of a bid/ask record: avg_spread (a quarter of the sum of the four corners' spreads, half to even), max_spread and crossed (some corner below zero)."""
    corners = [dec.subtract(f"{prefix_ask}{c}", f"{prefix_bid}{c}") for c in "ohlc"]
    # quarters and rests of the corners are summed apart, which 64 bits always hold
    rests = sum((c.bitwiseAND(F.lit(3)) for c in corners[1:]), corners[0].bitwiseAND(F.lit(3)))
    cut = sum((F.shiftright(c, 2) for c in corners[1:]), F.shiftright(corners[0], 2)) + F.shiftright(rests, 2)
    rest = rests.bitwiseAND(F.lit(3))
    quarter = cut + F.when((rest > 2) | ((rest == 2) & (cut.bitwiseAND(F.lit(1)) == 1)), 1).otherwise(0)
    return {"avg_spread": quarter, "max_spread": F.greatest(*corners), "crossed": F.least(*corners) < 0}


def classify_records(records: DataFrame, file_keys: list[str], interval: str | None = None) -> DataFrame:
    """Add outcome and reason to bid/ask ``records`` (file_keys, line_no, time, bid_o.., ask_o.., volume, complete), with their bid bar.

    Duplicates of any earlier row's time in the file and rows before the one just above come first, then crossed quotes, broken bars
    and misaligned times; what is left is incomplete or accepted. Without ``interval`` the column of that name tells each row's. A file is the unit of order, as is a month of one instrument: a bounded group.
    """
    aligned = [F.when(F.lit(interval) == i if interval else F.col("interval") == i, cal.bar_start(F.col("time"), *cal.INTERVALS[i])) for i in ([interval] if interval else cal.INTERVALS)]
    in_file = Window.partitionBy(*file_keys).orderBy("line_no")
    seen = F.row_number().over(Window.partitionBy(*file_keys, "time").orderBy("line_no")) > 1
    bar = records.withColumns({"_dup": seen, "_before": F.lag("time").over(in_file)} | spreads())
    bar = bar.withColumns({"open": F.col("bid_o"), "high": F.col("bid_h"), "low": F.col("bid_l"), "close": F.col("bid_c"), "ticks": F.col("volume")})
    bar = bar.withColumn("_rule", violation())
    reason = (
        F.when(F.col("_dup"), "duplicate").when(F.col("time") < F.col("_before"), "out_of_order").when(F.col("crossed"), "crossed").when(F.col("avg_spread").isNull() | F.col("max_spread").isNull(), "overflow")
        .when(F.col("_rule").isNotNull(), F.col("_rule")).when(F.coalesce(*aligned) != F.col("time"), "misaligned").when(~F.col("complete"), "incomplete")
    )
    outcome = F.when(F.col("reason").isNull(), ACCEPTED).when(F.col("reason") == "crossed", SUSPICIOUS).when(F.col("reason") == "incomplete", INCOMPLETE).otherwise(REJECTED)
    return bar.withColumn("reason", reason).withColumn("outcome", outcome).drop("_dup", "_before", "_rule", "crossed")


def gate(classified: DataFrame, file_keys: list[str]) -> DataFrame:
    """Per file: rows by outcome, blocked (some row suspicious or rejected) and offenders: their line numbers and reasons."""
    bad = F.col("outcome").isin(SUSPICIOUS, REJECTED)
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in (ACCEPTED, INCOMPLETE, SUSPICIOUS, REJECTED)]
    offenders = F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("line_no", "reason")))), lambda x: F.concat_ws(":", x["line_no"], x["reason"]))
    return classified.groupBy(*file_keys).agg(*counts, (F.count_if(bad) > 0).alias("blocked"), F.concat_ws(",", offenders).alias("offenders"))


def normalise(records: DataFrame, file_keys: list[str], interval: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, gates, quarantine) of many files in one job: a file with a suspicious or rejected row gives no bars; incomplete rows are left out."""
    classified = classify_records(records, file_keys, interval)
    gates = gate(classified, file_keys)
    # a file's rows are together already, so whether it is blocked is told there: they are neither classified again nor joined
    blocked = F.bool_or(F.col("outcome").isin(SUSPICIOUS, REJECTED)).over(Window.partitionBy(*file_keys))
    bars = classified.withColumn("_blocked", blocked).where((F.col("outcome") == ACCEPTED) & ~F.col("_blocked"))
    return bars.select(*file_keys, "time", "open", "high", "low", "close", "avg_spread", "max_spread", "ticks"), gates, classified.where(F.col("outcome").isin(SUSPICIOUS, REJECTED))


def compare(derived: DataFrame, native: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Field by field differences above ``tolerance`` between two sets of bars, and bars on one side only: keys, time, field, derived, native."""
    fields = ["open", "high", "low", "close"]
    one = derived.select(*keys, "time", F.struct(*fields).alias("d"))
    two = native.select(*keys, "time", F.struct(*fields).alias("n"))
    both = one.join(two, [*keys, "time"], "full_outer")
    each = both.select(*keys, "time", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").alias("derived"), F.col(f"n.{f}").alias("native")) for f in fields])).alias("x")).select(*keys, "time", "x.*")
    alone = F.col("derived").isNull() | F.col("native").isNull()
    once = F.when(alone, F.when(F.col("derived").isNull(), "native_only").otherwise("derived_only")).otherwise(F.col("field"))
    return each.where(F.when(alone, F.col("field") == "open").otherwise(F.abs(F.col("derived") - F.col("native")) > tolerance)).withColumn("field", once)


def compare_closes(bars: DataFrame, legacy: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Bars on both sides whose closes differ by more than ``tolerance``."""
    old = legacy.select(*keys, "time", F.col("close").alias("legacy_close"))
    return bars.join(old, [*keys, "time"]).where(F.abs(F.col("close") - F.col("legacy_close")) > tolerance).select(*keys, "time", "close", "legacy_close")
