"""Canonical text files, a month of one instrument each: a comment, the manifest as JSON, a header, and a line per bar. They are read with proof, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decimals as dec
from ..functions.canonical import canonical_json
from ..operators import manifests
from . import raw, store

# The tag and header of a canonical file, and the fields of its manifest line in their order.
SCHEMA_TAG = "canonical-v1"
HEADER = "time,open,high,low,close,avg_spread,max_spread,ticks"
PRICES = ("open", "high", "low", "close", "avg_spread", "max_spread")
MANIFEST = (
    "provider string, instrument string, interval_unit int, interval_count int, span_start string, span_end string, basis int, schema_version int, raw_fingerprint string, builder_version string, validator_version string,"
    " resampler_version string, calendar_version string, built_at string, bar_count bigint, first_bar string, last_bar string, parent struct<instrument: string, interval_unit: int, interval_count: int, revision: string>, revision string"
)
TIMES = ("span_start", "span_end", "built_at", "first_bar", "last_bar")


def _token(unit: Column, count: Column) -> Column:
    return F.concat(F.coalesce(*[F.when(unit == n, k) for k, n in manifests.UNITS.items()]), count.cast("string"))


def _time_text(c: Column | str) -> Column:
    """RFC 3339 in UTC, without trailing zeros of the fraction."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def row_error(line: Column) -> Column:
    """What is wrong with a bar's line, or null: fields, time, price or ticks."""
    f = F.split(line, ",", -1)
    prices = F.lit(False)
    for i in range(1, 7):
        prices = prices | dec.parse_error(F.get(f, i), signed=False).isNotNull()
    ticks = ~F.get(f, 7).rlike(r"^[+-]?\d+$") | F.get(f, 7).try_cast("bigint").isNull()
    return F.when(F.size(f) != 8, "fields").when(raw.utc_time(F.get(f, 0)).isNull(), "time").when(prices, "price").when(ticks, "ticks")


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content; a path ends with provider/SYMBOL/YYYY/MM/name) to a row each: path, the partition of the path, the manifest's fields, lines (numbers and texts of bars) and error, the first that a reader meets.

    layout, comment (it says another partition), manifest (no such JSON, or a time in it), instrument, interval, a rule that the manifest breaks, revision (it isn't that of the fields), header, or of the first bad line fields, time, price, ticks.
    """
    parts = F.split("path", "/")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    interval = F.regexp_extract(part(-1), r"-([a-z0-9]+)\.csv$", 1)
    named = files.select("path", "content").withColumns({"provider": part(-5), "symbol": part(-4), "interval": interval, "year": part(-3).try_cast("int"), "month": part(-2).try_cast("int")})
    placed = (F.concat_ws("-", part(-4), part(-3), part(-2), interval) == F.regexp_replace(part(-1), r"\.csv$", "")) & part(-3).rlike(r"^\d{4}$") & part(-2).rlike("^(0[1-9]|1[0-2])$") & (part(-5) != "")
    named = named.withColumn("_placed", placed)
    numbered = F.transform(F.split(F.col("content").cast("string"), "\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    line = lambda i: F.coalesce(F.try_element_at("_lines", F.lit(i))["line"], F.lit(""))
    told = F.str_to_map(F.trim(F.regexp_replace(line(1), r"^\s*#\s*", "")), F.lit(" +"), F.lit("="))
    out = named.withColumn("_lines", numbered).withColumns({"_told": told, "_m": F.from_json(line(2), MANIFEST), "_header": line(3)}).drop("content")
    digits = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    same = lambda k, v: F.coalesce(F.col("_told")[k] == v, F.lit(False))
    agrees = same("schema", F.lit(SCHEMA_TAG)) & same("provider", F.col("provider")) & same("symbol", F.col("symbol")) & same("interval", F.col("interval")) & same("year", digits("year", 4)) & same("month", digits("month", 2))
    m = F.col("_m")
    fields = {
        "instrument_id": m["instrument"], **{c: raw.utc_time(m[c]) for c in TIMES}, "basis": F.coalesce(*[F.when(m["basis"] == n, k) for k, n in manifests.BASES.items()]),
        **{c: m[c] for c in ("schema_version", "raw_fingerprint", "builder_version", "validator_version", "resampler_version", "calendar_version", "bar_count", "revision")},
        "parent_instrument": m["parent"]["instrument"], "parent_interval": _token(m["parent"]["interval_unit"], m["parent"]["interval_count"]), "parent_revision": m["parent"]["revision"],
    }
    bad_time = F.lit(False)
    for c in TIMES:
        given = F.coalesce(m[c], F.lit("")) != ""
        bad_time = bad_time | (given & raw.utc_time(m[c]).isNull()) | (~given & F.lit(c not in ("first_bar", "last_bar")))
    out = out.withColumns(fields)
    rows = F.filter(F.slice("_lines", 4, 10**9), lambda x: F.trim(x["line"]) != "")
    bad_row = F.try_element_at(F.filter(F.transform(rows, lambda x: row_error(x["line"])), lambda e: e.isNotNull()), F.lit(1))
    out = out.withColumn("lines", rows)
    error = (
        F.when(~F.col("_placed"), "layout").when(~agrees, "comment").when(m.isNull() | m["provider"].isNull() | bad_time, "manifest")
        .when(manifests.instrument_mismatch() | F.coalesce(F.col("parent_instrument") != F.col("instrument_id"), F.lit(False)), "instrument").when(~F.coalesce(_token(m["interval_unit"], m["interval_count"]) == F.col("interval"), F.lit(False)), "interval")
    )
    checked = F.coalesce(error, manifests.manifest_error(), F.when(~F.col("revision").eqNullSafe(manifests.revision()), "revision"), F.when(F.col("_header") != HEADER, "header"), F.when(F.size("lines") > 0, bad_row))
    return out.withColumn("error", checked).drop("_lines", "_told", "_m", "_header", "_placed")


def bars_of(parsed: DataFrame) -> DataFrame:
    """Bars of ``parse_files``' readable files, in the store's columns."""
    each = parsed.where("error IS NULL").select(*store.PARTITION, F.explode("lines").alias("l"))
    f = F.split("l.line", ",", -1)
    columns = {"time": raw.utc_time(F.get(f, 0))} | {p: dec.parse(F.get(f, i + 1), signed=False) for i, p in enumerate(PRICES)} | {"ticks": F.get(f, 7).try_cast("bigint")}
    return each.withColumns(columns).select(*store._columns(store.BARS))


def load_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, manifests, errors) of canonical ``files`` (path, content): what can be trusted, ready to be published, and for each file that can't (its partition, path) why: what ``parse_files`` found, or what lies between its manifest and its bars."""
    parsed = store.settle(parse_files(files))
    held = parsed.where("error IS NULL").select(*[c for c in store._columns(store.MANIFESTS) if c != "generation"], "path")
    bars = bars_of(parsed)
    between = store.publish_errors(bars, held.drop("path"))
    first = store.settle(between.groupBy(*store.PARTITION).agg(F.min("error").alias("error")))
    errors = parsed.where("error IS NOT NULL").select(*store.PARTITION, "path", "error").unionByName(held.join(first, store.PARTITION).select(*store.PARTITION, "path", "error"))
    return bars.join(first, store.PARTITION, "left_anti"), held.join(first, store.PARTITION, "left_anti").drop("path"), errors


def load_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``load_files`` of all files below ``root``."""
    return load_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "content"))


def as_files(bars: DataFrame, held: DataFrame) -> DataFrame:
    """(name, text) of the canonical file of each month of manifests ``held``, with its ``bars`` in order; a month without bars has none. A month of bars is a bounded group."""
    line = F.concat_ws(",", _time_text("time"), *[dec.text_of(F.col(p)) for p in PRICES], F.col("ticks").cast("string"))
    rows = bars.groupBy(*store.PARTITION).agg(F.array_sort(F.collect_list(F.struct("time", line.alias("line")))).alias("_rows"))
    unit, count = manifests._interval("interval")
    of_parent = manifests._interval("parent_interval")
    parent = F.when(F.col("parent_revision").isNotNull(), F.struct(F.col("parent_instrument").alias("instrument"), of_parent[0].alias("interval_unit"), of_parent[1].alias("interval_count"), F.col("parent_revision").alias("revision")))
    basis = F.coalesce(*[F.when(F.col("basis") == k, n) for k, n in manifests.BASES.items()], F.lit(0))
    own = {"instrument": F.col("instrument_id"), "interval_unit": unit, "interval_count": count, "basis": basis, "parent": parent} | {c: _time_text(c) for c in TIMES}
    names = ("provider instrument interval_unit interval_count span_start span_end basis schema_version raw_fingerprint builder_version validator_version resampler_version calendar_version built_at bar_count first_bar last_bar parent revision").split()
    manifest = canonical_json(F.struct(*[own.get(c, F.col(c)).alias(c) for c in names]), nulls=False)
    year, month = F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0")
    comment = F.concat(F.lit(f"# schema={SCHEMA_TAG} provider="), "provider", F.lit(" symbol="), "symbol", F.lit(" interval="), "interval", F.lit(" year="), year, F.lit(" month="), month)
    name = F.concat_ws("/", "provider", "symbol", year, month, F.concat(F.concat_ws("-", "symbol", year, month, "interval"), F.lit(".csv")))
    body = F.transform(F.coalesce("_rows", F.array().cast("array<struct<time:timestamp_ntz,line:string>>")), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(comment, manifest, F.lit(HEADER)), body, F.array(F.lit(""))), "\n")
    return held.join(rows, store.PARTITION, "left").select(name.alias("name"), text.alias("text"))
