"""Record-level queries: decimals, bid/ask records with rule-made defects, JSON candles, ids and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import decimals as dec
from ..functions import identifiers as ids
from ..operators import bars as ops
from ..operators import inventory
from ..sources import raw, store
from .common import TICKS, as_string, as_text, bars_sql, half_even, table, text, ticks, units, wide_units


def decimal_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items as texts with defects by rule, parsed strictly: units, canonical text and error."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    whole = units("l_extendedprice", 2)
    plain = F.concat(F.floor(whole / dec.SCALE).cast("bigint").cast("string"), F.lit("."), F.lpad(((whole % dec.SCALE) / 1_000_000).cast("bigint").cast("string"), 2, "0"))
    raw_text = (
        F.when(k % 11 == 0, F.concat(plain, F.lit("000000001"))).when(k % 11 == 1, F.concat(plain, F.lit("00000000"))).when(k % 11 == 2, F.concat(plain, F.lit("e3"))).when(k % 11 == 3, F.concat(F.lit("-"), plain))
        .when(k % 11 == 4, F.concat(F.lit("+"), plain)).when(k % 11 == 5, F.concat(F.lit("92233720"), plain)).when(k % 11 == 6, F.lit("-0")).when(k % 11 == 7, F.lit("1.")).otherwise(plain)
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw_text.alias("raw"))
    read = rows.withColumn("read", dec.parsed("raw"))
    error, value = dec.unsigned(F.col("read"))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("units"), error.alias("error"), dec.text_of("read.units").alias("canonical"))


_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def mul_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted prices: price x rate in units, and the price in another currency."""
    rows = table(spark, sf_dir, "lineitem").select(*_ITEM, (units("l_extendedprice", 2) + F.col("l_partkey")).alias("p"), (units("l_discount", 2) + F.col("l_suppkey") * 333).alias("r"))
    rows = rows.withColumn("m", dec.money("p", F.lit("EUR")))
    return rows.select(*_ITEM, dec.multiply("p", "r").alias("product"), dec.money_convert(F.col("m"), "USD", F.col("r"))["amount"].alias("converted"))


def div_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*_ITEM, units("l_extendedprice", 2).alias("p"), (units("l_quantity", 0) + F.col("l_partkey") * 2).alias("q"))
    return rows.select(*_ITEM, dec.divide("p", "q").alias("quotient"), dec.divide(dec.negate("p"), "q").alias("negative"))


def checked_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences, absolutes and signs with checks, on order totals near the limits, and customers' numbers that go beyond them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (wide_units("o_totalprice", 2) * F.when(F.col("o_orderkey") % 3 == 0, 90_000).otherwise(1)).alias("a"), (F.col("o_custkey").cast("decimal(38,0)") * dec.SCALE * 50_000_000).alias("b"))
    return rows.select("o_orderkey", dec.add("a", "b").alias("total"), dec.subtract("a", "b").alias("difference"), dec.subtract("a", "b", signed=False).alias("unsigned"), dec.absolute(dec.subtract("a", "b")).alias("distance"), dec.sign(dec.subtract("a", "b")).alias("sign"))


def grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", units("p_retailprice", 2).alias("p"), (F.col("p_size") * 1_000_000).alias("tick"))
    return rows.select("p_partkey", dec.on_grid("p", "tick").alias("on_tick"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid/ask hourly records: a file per ship month and supplier, whose number of rows stays as it is in larger tables; line items as rows, with defects by rule."""
    b = units("l_extendedprice", 2)
    s = units("l_tax", 2) + 1000
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    base = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_suppkey").alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (n % 24).cast("int"), F.when(n % 29 == 0, 30).otherwise(0))).alias("time"),
        b.alias("bid_o"), (b + F.when(n % 31 == 0, -5).otherwise(7000)).alias("bid_h"), (b - 9000).alias("bid_l"), (b + n % 1000).alias("bid_c"),
        (b + s).alias("ask_o"), (b + s + 7001).alias("ask_h"), (b + s - 9000).alias("ask_l"), (b + n % 1000 + F.when(n % 37 == 0, -3).otherwise(s + 2)).alias("ask_c"),
        F.floor("l_quantity").cast("bigint").alias("volume"), (n % 41 != 0).alias("complete"),
    )
    order = Window.partitionBy("year", "month", "file").orderBy(F.col("row.l_orderkey") * 31 % 101, "row")
    return base.withColumn("line_no", F.row_number().over(order).cast("bigint")).drop("row")


_FILE = ["year", "month", "file"]
#: Customers whose orders share an archive.
_CUSTOMERS = 500
#: Symbols of orders that are open, finished, and neither.
_SYMBOLS = ("EURUSD", "XAUUSD", "GBPJPY")


def _archive() -> Column:
    return F.regexp_extract("path", "root-([0-9]+)/", 1).alias("archive")


def record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.classify_records(_records(spark, sf_dir), _FILE, "h1")
    return found.select(*_FILE, "line_no", "outcome", "reason", "avg_spread", "max_spread")


def partition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = ops.gate(ops.classify_records(_records(spark, sf_dir), _FILE, "h1"), _FILE)
    return gates.withColumn("offenders", F.md5(F.col("offenders")))


def normalised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the files that no suspicious or rejected record blocks; defects are thinned out so that some files pass."""
    rows = _records(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy(*_FILE, "time").orderBy("line_no"))
    once = rows.withColumn("_n", first).where("_n = 1").drop("_n").where((F.col("ask_c") > F.col("bid_c")) & (F.col("bid_h") > F.col("bid_o")) & (F.minute("time") == 0))
    in_order = once.withColumn("line_no", cal.seconds_between(F.col("time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("bigint") + F.when(F.col("file") == 3, -2 * (F.col("line_no") % 2) * 10**9).otherwise(0))
    bars, _, _ = ops.normalise(in_order, _FILE, "h1")
    return as_text(bars, "time")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files made of orders, read back: status, fingerprint, and what was parsed."""
    return _raw(spark, sf_dir).select(_archive(), "symbol", "year", "month", "file_status", "file_error", "fingerprint", F.col("line_count").alias("lines"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw.records(_raw(spark, sf_dir).where(F.col("file_status") != "skipped"))
    return as_text(found.select(_archive(), "symbol", "year", "month", "line_no", "time", "bid_o", "ask_c", "volume", "complete", "row_error"), "time")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders by status, month and some customers, so that files stay as small in larger tables: a line an order; bad prices, headers, comments and names by rule."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = dec.text_of(units("o_totalprice", 2))
    stamp = F.concat(F.replace(text("o_orderdate"), F.lit(" "), F.lit("T")), F.when(k % 3 == 0, "+00:00").otherwise("Z"))
    bad = F.when(k % 911 == 0, F.lit("x")).otherwise(price)
    line = F.concat_ws(",", stamp, price, price, price, price, bad, price, price, price, (k % 100).cast("string"), F.when(k % 5 == 0, "F").otherwise("true"))
    symbol = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    rows = o.select(F.floor(F.col("o_custkey") / _CUSTOMERS).alias("r"), symbol.alias("s"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.struct(k.alias("k"), line.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    # rows are sorted by these keys, so none is a text
    files = rows.groupBy("r", "y", "m", "s").agg(body.alias("body"))
    files = files.withColumns({"s": F.element_at(F.array(*map(F.lit, _SYMBOLS)), F.col("s")), "y": F.col("y").cast("string"), "m": F.lpad(F.col("m").cast("string"), 2, "0")})
    path = F.concat(F.lit("root-"), F.col("r").cast("string"), F.lit("/"), F.concat_ws("/", "s", F.when(F.col("m") == "11", "1999").otherwise(F.col("y")), "m"), F.lit("/"), F.concat_ws("-", "s", "y", "m", F.when(F.col("m") == "12", "w1").otherwise("d")), F.lit(".csv"))
    comment = F.concat(F.lit("# schema=raw-v1 source=x instrument="), F.col("s"), F.lit(" tf=d year="), F.when(F.col("m") == "10", "1900").otherwise(F.col("y")), F.lit(" month="), F.col("m"))
    header = F.when(F.col("m") == "09", "time,price").otherwise(raw.HEADER)
    return raw.parse_files(files.select(path.alias("path"), F.concat_ws("\n", comment, header, "body").cast("binary").alias("content")))


def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as JSON texts."""
    bars = as_text(ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "d1"), "time")
    return store.as_json(bars.select("time", "open", "high", "low", "close", "symbol"))


def partition_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(inventory.partitions(_records(spark, sf_dir), _FILE), "first_time", "last_time")


def duplicate_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory.duplicate_times(_records(spark, sf_dir), _FILE)
    return found.select(*_FILE, F.size("duplicate_times").alias("n"), F.concat_ws(",", F.transform("duplicate_times", text)).alias("duplicate_times"))


def candles_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider JSON made of each symbol's daily bars, one response a week, read back as records."""
    b = ops.from_ticks(ticks(spark, sf_dir), ["symbol"], "d1")
    side = lambda add: F.struct(*[dec.text_of(F.col(c) + add).alias(k) for k, c in zip("ohlc", ("open", "high", "low", "close"), strict=True)])
    stamp = F.concat(F.regexp_replace(text("time"), " ", "T"), F.lit("Z"))
    candle = F.struct((F.col("ticks") % 5 != 0).alias("complete"), stamp.alias("time"), F.col("ticks").alias("volume"), side(F.lit(0)).alias("bid"), F.when(F.col("ticks") % 13 != 0, side(F.col("avg_spread"))).alias("ask"))
    week = F.trunc(F.col("time"), "week")
    responses = b.groupBy("symbol", week.alias("week")).agg(F.array_sort(F.collect_list(F.struct("time", candle.alias("c")))).alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda v: v["c"]).alias("candles")))
    found = raw.candles(responses.select("symbol", body.alias("body")), ["symbol"])
    return as_text(found.drop("line_no"), "time")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows (all but every sixth order) and fetched ones (every third, at another price) merged by order and line; fetched ones win."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"), units("l_extendedprice", 2).alias("price"))
    stored = rows.where(F.col("l_orderkey") % 6 != 0)
    fetched = rows.where(F.col("l_orderkey") % 3 == 0).withColumn("price", F.col("price") + 1)
    keys = ["l_orderkey", "l_linenumber"]
    stored = stored.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max("price").alias("price"))
    fetched = fetched.groupBy(*keys, "seq").agg(F.max("price").alias("price"))
    return inventory.upsert(stored, fetched.select("l_orderkey", "l_linenumber", "seq", "price"), keys)


def id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ids made of order keys, some broken by rule: error and embedded milliseconds."""
    k = F.col("o_orderkey")
    head = F.lpad(F.translate(F.conv((k * 977 + 1_700_000_000_000).cast("string"), 10, 32), "IJKLMNOPQRSTUV", "JKMNPQRSTVWXYZ"), 10, "0")
    tail = F.substring(F.upper(F.translate(F.md5(k.cast("string")), "ilou", "0000")), 1, 16)
    prefix = F.when(k % 13 == 0, "xyz_").otherwise("ord_")
    value = (
        F.when(k % 17 == 0, F.concat(prefix, head, F.lit("U"), F.substring(tail, 2, 15))).when(k % 19 == 0, F.concat(prefix, F.lit("8"), F.substring(head, 2, 9), tail)).when(k % 23 == 0, F.concat(prefix, head))
        .when(k % 29 == 0, F.concat(prefix, F.repeat(F.lit("0"), 26))).otherwise(F.concat(prefix, head, tail))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("id"))
    return rows.select("o_orderkey", ids.id_error("id").alias("error"), ids.id_millis("id").alias("millis"))


def redact_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of events, with keys made sensitive by rule, redacted."""
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_id") % 3 == 0, "Token").when(F.col("event_id") % 3 == 1, "api_key").otherwise("k")
    rows = table(spark, sf_dir, "events").select("event_id", ids.redact(F.map_from_arrays(F.array(name, F.lit("user")), F.array(k, F.col("user_id").cast("string")))).alias("m"))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("attributes"))


QUERIES = {
    "decimal_ingest": decimal_ingest, "mul_half_even": mul_half_even, "div_half_even": div_half_even, "checked_arithmetic": checked_arithmetic, "grid_check": grid_check, "record_outcomes": record_outcomes,
    "partition_gate": partition_gate, "normalised_bars": normalised_bars, "raw_files": raw_files, "raw_rows": raw_rows, "exported_rows": exported_rows, "partition_inventory": partition_inventory, "duplicate_times": duplicate_times, "candles_json": candles_json, "upsert_latest": upsert_latest, "id_audit": id_audit, "redact_props": redact_props,
}

_U = lambda c, p: f"(CAST(floor({c} * {10**p} + 0.5) AS BIGINT) * {10 ** (8 - p)})"
_MAX = "9223372036854775807"
_K = "(l_orderkey * 7 + l_linenumber)"
_FIT = lambda x: f"CASE WHEN ({x}) BETWEEN -9223372036854775808 AND {_MAX} THEN CAST(({x}) AS BIGINT) END"
_N = "(l_orderkey * 8 + l_linenumber)"

RECORDS = f"""base AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, l_suppkey AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_shipdate + to_hours({_N} % 24) + to_minutes(CASE WHEN {_N} % 29 = 0 THEN 30 ELSE 0 END) AS time, {_U('l_extendedprice', 2)} AS b, {_U('l_tax', 2)} + 1000 AS s, {_N} AS n, CAST(floor(l_quantity) AS BIGINT) AS volume FROM lineitem),
records AS (SELECT year, month, file, row_number() OVER (PARTITION BY year, month, file ORDER BY l_orderkey * 31 % 101, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_no, time,
  b AS bid_o, b + CASE WHEN n % 31 = 0 THEN -5 ELSE 7000 END AS bid_h, b - 9000 AS bid_l, b + n % 1000 AS bid_c, b + s AS ask_o, b + s + 7001 AS ask_h, b + s - 9000 AS ask_l,
  b + n % 1000 + CASE WHEN n % 37 = 0 THEN -3 ELSE s + 2 END AS ask_c, volume, n % 41 <> 0 AS complete FROM base)"""
_SUM = "CAST((ask_o - bid_o) + (ask_h - bid_h) + (ask_l - bid_l) + (ask_c - bid_c) AS HUGEINT)"
OUTCOMES = f"""{RECORDS}, marked AS (SELECT *, row_number() OVER (PARTITION BY year, month, file, time ORDER BY line_no) > 1 AS dup, lag(time) OVER (PARTITION BY year, month, file ORDER BY line_no) AS before,
  CAST({half_even(_SUM, '4')} AS BIGINT) AS avg_spread, greatest(ask_o - bid_o, ask_h - bid_h, ask_l - bid_l, ask_c - bid_c) AS max_spread, least(ask_o - bid_o, ask_h - bid_h, ask_l - bid_l, ask_c - bid_c) < 0 AS crossed FROM records),
reasons AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN time < before THEN 'out_of_order' WHEN crossed THEN 'crossed' WHEN bid_h < bid_l THEN 'high_below_low' WHEN bid_o < bid_l OR bid_o > bid_h THEN 'open_outside'
  WHEN bid_c < bid_l OR bid_c > bid_h THEN 'close_outside' WHEN avg_spread > max_spread THEN 'spread' WHEN volume < 0 THEN 'ticks' WHEN minute(time) <> 0 THEN 'misaligned' WHEN NOT complete THEN 'incomplete' END AS reason FROM marked),
outcomes AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'crossed' THEN 'suspicious' WHEN reason = 'incomplete' THEN 'incomplete' ELSE 'rejected' END AS outcome FROM reasons)"""

_PLAIN = "(CAST(w // 100000000 AS VARCHAR) || '.' || lpad(CAST((w % 100000000) // 1000000 AS VARCHAR), 2, '0'))"
_RAW = f"""CASE {_K} % 11 WHEN 0 THEN {_PLAIN} || '000000001' WHEN 1 THEN {_PLAIN} || '00000000' WHEN 2 THEN {_PLAIN} || 'e3' WHEN 3 THEN '-' || {_PLAIN} WHEN 4 THEN '+' || {_PLAIN}
 WHEN 5 THEN '92233720' || {_PLAIN} WHEN 6 THEN '-0' WHEN 7 THEN '1.' ELSE {_PLAIN} END"""
_ITEMS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_TEXT = "regexp_replace(regexp_replace(CAST(CAST(exact AS DECIMAL(28, 8)) AS VARCHAR), '0+$', ''), '\\.$', '')"
_RAW_FILES = f"""o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'EURUSD' WHEN 'F' THEN 'XAUUSD' ELSE 'GBPJPY' END AS s, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(o_custkey // {_CUSTOMERS} AS VARCHAR) AS archive, o_orderkey AS k, {_U('o_totalprice', 2)} AS w FROM orders),
t AS (SELECT *, regexp_replace(regexp_replace(CAST(w // 100000000 AS VARCHAR) || '.' || lpad(CAST((w % 100000000) // 1000000 AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '') AS p FROM o),
l AS (SELECT *, row_number() OVER (PARTITION BY archive, s, y, m ORDER BY k) + 2 AS line_no, replace({as_string('o_orderdate')}, ' ', 'T') || CASE WHEN k % 3 = 0 THEN '+00:00' ELSE 'Z' END || ',' || p || ',' || p || ',' || p || ',' || p || ',' || CASE WHEN k % 911 = 0 THEN 'x' ELSE p END || ',' || p || ',' || p || ',' || p || ',' || (k % 100) || ',' || CASE WHEN k % 5 = 0 THEN 'F' ELSE 'true' END AS line FROM t),
files AS (SELECT archive, s AS symbol, y AS year, m AS month, count(*) AS n, bool_or(k % 911 = 0) AS bad, string_agg(line, chr(10) ORDER BY k) AS body FROM l GROUP BY ALL),
status AS (SELECT *, CASE WHEN symbol = 'XAUUSD' THEN 'out_of_scope' WHEN month = 12 THEN 'unsupported_interval' WHEN month = 11 AND year <> 1999 THEN 'layout' WHEN month = 9 THEN 'header' WHEN month = 10 THEN 'comment' WHEN bad THEN 'row' END AS file_error FROM files)"""

ORACLES = {
    "normalised_bars": f"""WITH {RECORDS}, f AS (SELECT *, row_number() OVER (PARTITION BY year, month, file, time ORDER BY line_no) AS rn FROM records), o AS (SELECT *, CAST({half_even(_SUM, '4')} AS BIGINT) AS avg_spread, greatest(ask_o - bid_o, ask_h - bid_h, ask_l - bid_l, ask_c - bid_c) AS max_spread FROM f WHERE rn = 1 AND ask_c > bid_c AND bid_h > bid_o AND minute(time) = 0),
x AS (SELECT *, lag(time) OVER (PARTITION BY year, month, file ORDER BY CAST(epoch(time) AS BIGINT) - CASE WHEN file = 3 THEN 2000000000 * (line_no % 2) ELSE 0 END) AS before FROM o),
g AS (SELECT year, month, file FROM x GROUP BY ALL HAVING bool_or(time < before OR least(ask_o - bid_o, ask_h - bid_h, ask_l - bid_l, ask_c - bid_c) < 0 OR bid_h < bid_l OR bid_o < bid_l OR bid_c < bid_l OR bid_c > bid_h OR avg_spread > max_spread))
SELECT year, month, file, {as_string('time')} AS time, bid_o AS open, bid_h AS high, bid_l AS low, bid_c AS close, avg_spread, max_spread, volume AS ticks FROM x ANTI JOIN g USING (year, month, file) WHERE complete""",
    "raw_files": f"""WITH {_RAW_FILES} SELECT archive, symbol, year, month, CASE WHEN file_error IS NULL THEN 'ok' WHEN file_error IN ('out_of_scope', 'unsupported_interval', 'layout') THEN 'skipped' ELSE 'malformed' END AS file_status, file_error,
  'sha256:' || sha256('# schema=raw-v1 source=x instrument=' || symbol || ' tf=d year=' || CASE WHEN month = 10 THEN '1900' ELSE CAST(year AS VARCHAR) END || ' month=' || lpad(CAST(month AS VARCHAR), 2, '0') || chr(10) || CASE WHEN month = 9 THEN 'time,price' ELSE '{raw.HEADER}' END || chr(10) || body) AS fingerprint,
  CAST(n AS INTEGER) AS lines FROM status""",
    "raw_rows": f"""WITH {_RAW_FILES} SELECT archive, s AS symbol, y AS year, m AS month, CAST(line_no AS INTEGER) AS line_no, {as_string('o_orderdate')} AS time, w AS bid_o, w AS ask_c, k % 100 AS volume, k % 5 <> 0 AS complete, CASE WHEN k % 911 = 0 THEN 'price' END AS row_error FROM l WHERE s <> 'XAUUSD' AND m <> 12 AND (m <> 11 OR y = 1999)""",
    "exported_rows": f"""WITH ticks AS ({TICKS}) SELECT '{{"time":"' || {as_string('time')} || '","open":' || open || ',"high":' || high || ',"low":' || low || ',"close":' || close || ',"symbol":"' || symbol || '"}}' AS value FROM ({bars_sql('d1')})""",
    "decimal_ingest": f"""WITH r AS (SELECT {_ITEMS}, {_RAW} AS raw FROM (SELECT *, {_U('l_extendedprice', 2)} AS w FROM lineitem)),
e AS (SELECT *, regexp_full_match(raw, '[+-]?[0-9]+(\\.[0-9]+)?') AS good, TRY_CAST(regexp_replace(raw, '(\\.[0-9]{{8}})[0-9]*$', '\\1') AS DECIMAL(38, 8)) AS exact FROM r),
f AS (SELECT *, CASE WHEN NOT good THEN 'syntax' WHEN regexp_matches(raw, '\\.[0-9]{{8}}[0-9]*[1-9]') THEN 'precision' WHEN exact IS NULL OR exact > 92233720368.54775807 OR exact < -92233720368.54775808 THEN 'range' WHEN exact < 0 THEN 'negative' END AS error FROM e)
SELECT {_ITEMS}, CASE WHEN error IS NULL THEN CAST(exact * 100000000 AS BIGINT) END AS units, error, CASE WHEN error IS NULL OR error = 'negative' THEN {_TEXT} END AS canonical FROM f""",
    "mul_half_even": f"SELECT {_ITEMS}, product, product AS converted FROM (SELECT {_ITEMS}, {_FIT(half_even('CAST(p AS HUGEINT) * r', '100000000'))} AS product FROM (SELECT *, {_U('l_extendedprice', 2)} + l_partkey AS p, {_U('l_discount', 2)} + l_suppkey * 333 AS r FROM lineitem))",
    "div_half_even": f"SELECT {_ITEMS}, {_FIT(half_even('CAST(p AS HUGEINT) * 100000000', 'q'))} AS quotient, {_FIT(half_even('CAST(-p AS HUGEINT) * 100000000', 'q'))} AS negative FROM (SELECT *, {_U('l_extendedprice', 2)} AS p, {_U('l_quantity', 0)} + l_partkey * 2 AS q FROM lineitem)",
    "checked_arithmetic": f"""SELECT o_orderkey, {_FIT('a + b')} AS total, {_FIT('a - b')} AS difference, CASE WHEN a - b >= 0 THEN {_FIT('a - b')} END AS unsigned, CASE WHEN a - b > -9223372036854775808 THEN {_FIT('abs(a - b)')} END AS distance, CASE WHEN {_FIT('a - b')} IS NOT NULL THEN CAST(sign(a - b) AS INTEGER) END AS sign
FROM (SELECT o_orderkey, CAST({_U('o_totalprice', 2)} AS HUGEINT) * CASE WHEN o_orderkey % 3 = 0 THEN 90000 ELSE 1 END AS a, CAST(o_custkey AS HUGEINT) * 100000000 * 50000000 AS b FROM orders)""",
    "grid_check": f"SELECT p_partkey, CASE WHEN p_size > 0 THEN {_U('p_retailprice', 2)} % (p_size * 1000000) = 0 ELSE false END AS on_tick FROM part",
    "record_outcomes": f"WITH {OUTCOMES} SELECT year, month, file, line_no, outcome, reason, avg_spread, max_spread FROM outcomes",
    "partition_gate": f"""WITH {OUTCOMES} SELECT year, month, file, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'incomplete') AS incomplete, count(*) FILTER (outcome = 'suspicious') AS suspicious, count(*) FILTER (outcome = 'rejected') AS rejected,
  count(*) FILTER (outcome IN ('suspicious', 'rejected')) > 0 AS blocked, md5(coalesce(string_agg(line_no || ':' || reason, ',' ORDER BY line_no) FILTER (outcome IN ('suspicious', 'rejected')), '')) AS offenders FROM outcomes GROUP BY year, month, file""",
    "partition_inventory": f"""WITH {RECORDS} SELECT year, month, file, count(*) AS row_count, count(*) FILTER (NOT complete) AS incomplete_rows, {as_string('min(time)')} AS first_time, {as_string('max(time)')} AS last_time, arg_max(complete, (time, -line_no)) AS last_complete FROM records GROUP BY year, month, file""",
    "duplicate_times": f"""WITH {RECORDS}, d AS (SELECT year, month, file, time FROM records GROUP BY ALL HAVING count(*) > 1) SELECT year, month, file, CAST(count(*) AS INTEGER) AS n, string_agg({as_string('time')}, ',' ORDER BY time) AS duplicate_times FROM d GROUP BY year, month, file""",
    "candles_json": f"""WITH ticks AS ({TICKS}), b AS ({bars_sql('d1')}), c AS (SELECT *, ticks % 13 <> 0 AS two FROM b)
SELECT symbol, {as_string('time')} AS time, open AS bid_o, high AS bid_h, low AS bid_l, close AS bid_c, CASE WHEN two THEN open + avg_spread END AS ask_o, CASE WHEN two THEN high + avg_spread END AS ask_h, CASE WHEN two THEN low + avg_spread END AS ask_l,
  CASE WHEN two THEN close + avg_spread END AS ask_c, ticks AS volume, ticks % 5 <> 0 AS complete, CASE WHEN NOT two THEN 'side' END AS row_error FROM c""",
    "upsert_latest": f"""WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey * 1000 + l_suppkey AS seq, {_U('l_extendedprice', 2)} AS price FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, max(seq) AS seq, max(price) AS price, 0 AS prio FROM r WHERE l_orderkey % 6 <> 0 GROUP BY ALL), f AS (SELECT l_orderkey, l_linenumber, seq, max(price + 1) AS price, 1 AS prio FROM r WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, l_linenumber, seq)
SELECT l_orderkey, l_linenumber, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY prio DESC, seq DESC) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM f)) WHERE n = 1""",
    "redact_props": """SELECT event_id, array_to_string(list_sort([CASE event_id % 3 WHEN 0 THEN 'Token=REDACTED' WHEN 1 THEN 'api_key=REDACTED' ELSE 'k=' || json_extract_string(props, '$.k') END, 'user=' || user_id]), ',') AS attributes FROM events""",
    "id_audit": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'prefix' WHEN o_orderkey % 17 = 0 THEN 'alphabet' WHEN o_orderkey % 19 = 0 THEN 'overflow' WHEN o_orderkey % 23 = 0 THEN 'length' WHEN o_orderkey % 29 = 0 THEN 'zero' END AS error,
  CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 THEN o_orderkey * 977 + 1700000000000 END AS millis FROM orders""",
}
