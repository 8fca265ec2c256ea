"""Half-open range queries that refuse partial results: months touched, overlaps, and proof of coverage by spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def months_of(requests: DataFrame, keys: list[str], probe: bool = True) -> DataFrame:
    """Months that each request [from_ts, to_ts) touches, and with ``probe`` the one before and after (bars filed under a neighbour may reach in)."""
    last = F.col("to_ts") - F.expr("INTERVAL '0.000001' SECOND")
    lo, hi = F.trunc("from_ts", "month"), F.trunc(last, "month")
    lo, hi = (F.add_months(lo, -1), F.add_months(hi, 1)) if probe else (lo, hi)
    each = requests.select(*keys, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    return each.select(*keys, F.year("_m").alias("year"), F.month("_m").alias("month"))


def conflicts(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows don't all have the same values: keys, versions."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("versions")).where(F.col("versions") > 1)


def merged(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; keys in ``conflicts`` must have been refused before."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*")


def _each_month(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each month that a half-open span touches."""
    last = F.col(end) - F.expr("INTERVAL '0.000001' SECOND")
    return spans.where(F.col(start) < F.col(end)).withColumn("_m", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))))


def first_uncovered(requests: DataFrame, spans: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """The first part of each request [from_ts, to_ts) that no span [start_ts, end_ts) covers, or nulls: keys, hole_start, hole_end.

    Spans belong to all requests of the same ``keys``. With ``on`` they belong to all requests of those keys (some of ``keys``), of which there may be many: then both are
    cut by month, so that a request only meets spans of its months.
    """
    if on:
        asked, held = _each_month(requests.select(*keys, "from_ts", "to_ts"), "from_ts", "to_ts"), _each_month(spans.select(*on, "start_ts", "end_ts"), "start_ts", "end_ts")
        met, first, after = asked.join(held, [*on, "_m"]), [F.col("_m").cast("timestamp_ntz")], [F.add_months("_m", 1).cast("timestamp_ntz")]
    else:
        met, first, after = requests.join(spans, keys), [], []
    inside = met.select(*keys, "from_ts", "to_ts", F.greatest("start_ts", "from_ts", *first).alias("s"), F.least("end_ts", "to_ts", *after).alias("e")).where(F.col("s") < F.col("e"))
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("e").over(before), F.col("from_ts"))
    hole = F.when(F.col("s") > F.col("_r"), F.struct(F.col("_r").alias("a"), F.col("s").alias("b")))
    found = inside.withColumn("_r", reached).groupBy(*keys).agg(F.min(hole).alias("h"), F.max("e").alias("_end"))
    joined = requests.select(*keys, "from_ts", "to_ts").join(found, keys, "left")
    end = F.coalesce("_end", "from_ts")
    start = F.when(F.col("h").isNotNull(), F.col("h.a")).when(end < F.col("to_ts"), end)
    stop = F.when(F.col("h").isNotNull(), F.col("h.b")).when(end < F.col("to_ts"), F.col("to_ts"))
    return joined.select(*keys, start.alias("hole_start"), stop.alias("hole_end"))


def bars_for(requests: DataFrame, bars: DataFrame, spans: DataFrame, request: str, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bars, status) of many requests at once: ``requests`` (request, keys, from_ts, to_ts).

    ``bars`` (keys, year, month, time, values) are pruned to the months touched; ``spans`` (keys, start_ts, end_ts) are what stored partitions vouch for. A request with a conflict or a hole gets
    no bars; status says ok, conflict or hole and where. ``position`` numbers a request's bars in order of time, from 1, and they lie in this order.
    """
    touched = months_of(requests, [request, *keys, "from_ts", "to_ts"])
    read = bars.join(touched, [*keys, "year", "month"]).where((F.col("time") >= F.col("from_ts")) & (F.col("time") < F.col("to_ts")))
    own = [request, *keys, "time"]
    each = read.groupBy(*own).agg(F.min(F.struct(*values)).alias("v"), F.max(F.struct(*values)).alias("_v"))
    clash = each.where(F.col("v") != F.col("_v")).groupBy(request).agg(F.min("time").alias("conflict_at"))
    asked = requests.select(request, *keys, "from_ts", "to_ts")
    hole = first_uncovered(asked, spans, [request, *keys], keys)
    status = asked.select(request).join(clash, request, "left").join(hole.select(request, "hole_start", "hole_end"), request, "left")
    status = status.withColumn("status", F.when(F.col("conflict_at").isNotNull(), "conflict").when(F.col("hole_start").isNotNull(), "hole").otherwise("ok"))
    good = each.join(status.where("status = 'ok'").select(request), request, "left_semi")
    place = F.row_number().over(Window.partitionBy(request).orderBy("time"))
    return good.select(*own, "v.*", place.alias("position")), status


def manifests_used(requests: DataFrame, manifests: DataFrame, status: DataFrame, request: str, keys: list[str]) -> DataFrame:
    """What the answers of ``bars_for`` rest on: for each request that it calls ok the ``manifests`` (keys, year, month, ...) of the months that were read, neighbours included, with all their columns."""
    answered = requests.join(status.where("status = 'ok'").select(request), request, "left_semi")
    return months_of(answered, [request, *keys]).join(manifests, [*keys, "year", "month"])
