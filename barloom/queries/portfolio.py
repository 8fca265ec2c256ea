"""Instruments, symbol resolution, portfolios and account snapshots on the driver's tables.

Parts stand in for instruments, suppliers for providers, customers for accounts, nations for currencies and regions for portfolios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decimals as dec
from ..functions import identifiers as ids
from ..operators import instruments as ins
from ..operators import portfolio as pf
from .common import as_text, half_even, table, units


def instrument_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument texts of six kinds from parts, some of them broken by rule."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fx", "eq", "etf", "fut", "cont", "idx")]), (k % 6 + 1).cast("int"))
    first = F.when(k % 6 == 0, F.when(k % 4 == 0, " eur ").otherwise("usd")).otherwise(F.regexp_replace("p_brand", "#", F.when(k % 5 == 0, "#").otherwise("-")))
    second = F.when(k % 6 == 0, F.when(k % 10 == 0, "EUR").otherwise("jpy")).otherwise(F.concat(F.lit("x"), (F.col("p_size")).cast("string")))
    contract = F.date_add(F.lit("2024-01-15").cast("date"), F.col("p_size") * 10)
    return table(spark, sf_dir, "part").select("p_partkey", ids.instrument_id(kind, first, second, contract).alias("instrument_id"))


def fx_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default listings of symbols made of two nations' codes."""
    code = lambda c: F.concat(F.lit("C"), F.translate(F.lpad(F.col(c).cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ"))
    a, b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("x")), F.col("c_custkey") % 25
    quote = F.when(b % 5 == 0, "JPY").when(b % 7 == 0, "EU1").otherwise(F.concat(F.lit("C"), F.translate(F.lpad(b.cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ")))
    rows = a.select("c_custkey", ids.fx_listing(F.lower(F.concat(code("x"), quote)), "oanda").alias("l"))
    return rows.select("c_custkey", "l.instrument_id", "l.symbol", "l.tick_size", "l.settlement_currency")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing per part: symbols of the part's size and type, so that some are shared between parts; 10 providers."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.when(k % 9 == 0, "idx:P").otherwise("eq:P"), k.cast("string")).alias("instrument_id"), F.concat(F.lit("prov"), (k % 10).cast("string")).alias("provider"), F.concat(F.lit("V"), (k % 3).cast("string")).alias("venue"),
        F.concat(F.substring("p_type", 1, 2), F.lit("."), (k % 400).cast("string")).alias("symbol"), (k % 7 != 0).alias("tradable"), (F.col("p_size").cast("bigint") * 1000).alias("tick_size"),
        F.when(k % 50 == 1, 0).otherwise(dec.SCALE).cast("bigint").alias("quantity_increment"), F.lit(dec.SCALE).cast("bigint").alias("multiplier"), F.when(k % 60 == 2, "us").otherwise("USD").alias("settlement_currency"),
    )


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five registrations for each fortieth part: one that comes before the alias it refers to, an alias for the part's listing (every third names a venue that has none), a second claim to the same name, an alias of the alias, and one of that."""
    k = F.col("k")
    listings = _listings(spark, sf_dir).withColumn("k", F.substring_index("instrument_id", "P", -1).cast("bigint")).where("k % 40 = 0")
    name = lambda a: F.concat(F.lit(a), (k if a != "al" else k % 1000).cast("string"))
    one = lambda at, alias, venue, to: F.struct(F.lit(at).alias("at"), name(alias).alias("alias_symbol"), venue.alias("venue"), to.alias("symbol"))
    each = F.array(
        one(0, "dl", F.lit(""), name("al")), one(1, "al", F.when(k % 120 == 0, "nowhere").otherwise(F.col("venue")), F.col("symbol")), one(2, "al", F.lit(""), F.col("symbol")), one(3, "bl", F.lit(""), name("al")), one(4, "cl", F.col("venue"), name("bl")),
    )
    return listings.select("k", "provider", F.col("venue").alias("alias_venue"), F.explode(each).alias("a")).select((k * 10 + F.col("a.at")).alias("seq"), F.col("provider").alias("alias_provider"), "alias_venue", "provider", "a.alias_symbol", "a.venue", "a.symbol")


def listing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir).select("instrument_id", ins.listing_error().alias("error")).where("error IS NOT NULL")


def alias_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.alias_errors(_listings(spark, sf_dir), _aliases(spark, sf_dir))


def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols asked for by line items of returned goods, some by alias, some without a venue."""
    return _resolved(spark, sf_dir).where(F.col("status") == ins.RESOLVED).select("request_id", "instrument_id")


def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where(F.col("status") != ins.RESOLVED).select("request_id", "status")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for a part's symbol, one in five for none that there is; some by alias, some without a venue."""
    parts = F.broadcast(table(spark, sf_dir, "part").agg((F.count("*") + F.floor(F.count("*") / 4)).alias("n")))
    orders = table(spark, sf_dir, "orders").join(parts).select("o_orderkey", (F.col("o_orderkey") % F.col("n")).alias("k"))
    part = _listings(spark, sf_dir).select(F.substring_index("instrument_id", "P", -1).cast("bigint").alias("k"), "provider", "venue", "symbol")
    asked = orders.join(part, "k", "left")
    of = lambda name, k: F.concat(F.lit(name), k.cast("string"))
    symbol = F.when((F.col("k") % 40 == 0) & (F.col("o_orderkey") % 3 == 0), of(" AL", F.col("k") % 1000)).when((F.col("k") % 40 == 0) & (F.col("o_orderkey") % 3 == 1), of("Cl", F.col("k"))).otherwise(F.coalesce("symbol", F.lit("none")))
    requests = asked.select(F.col("o_orderkey").alias("request_id"), F.lower(F.coalesce("provider", F.lit("prov0"))).alias("provider"), F.when(F.col("o_orderkey") % 4 != 0, F.col("venue")).alias("venue"), symbol.alias("symbol"))
    return ins.resolve_symbols(requests, _listings(spark, sf_dir), _aliases(spark, sf_dir))


def resolve_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tradable listings of instruments: each part's is asked for, with a provider or without."""
    k = F.col("p_partkey")
    requests = table(spark, sf_dir, "part").select(k.alias("request_id"), F.concat(F.lit("eq:P"), k.cast("string")).alias("instrument_id"), F.when(k % 4 == 0, F.concat(F.lit(" PROV"), (k % 8).cast("string"))).alias("provider"), F.lit(None).cast("string").alias("venue"))
    return ins.resolve_instruments(requests, _listings(spark, sf_dir))


_PORTFOLIO = "concat('R', CAST(n_regionkey AS STRING), '-', CAST(c_custkey % 40 AS STRING))"


def _portfolio(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, portfolios, rates): forty portfolios a region; the region's first nation is the base; some nations have no rate."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    code = lambda c: F.concat(F.lit("N"), F.translate(F.lpad(F.col(c).cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("as_of"))
    with_time = joined.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    accounts = with_time.select(F.expr(_PORTFOLIO).alias("portfolio_id"), F.col("c_custkey").alias("account_id"), code("n_nationkey").alias("currency"), units("c_acctbal", 2).alias("equity"), "as_of")
    base = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("b"))
    portfolios = joined.select(F.expr(_PORTFOLIO).alias("portfolio_id"), "n_regionkey").distinct().join(base, "n_regionkey").select("portfolio_id", code("b").alias("base_currency"), F.lit("2001-06-01").cast("timestamp_ntz").alias("as_of"))
    n = F.col("n_nationkey")
    pair = portfolios.select("portfolio_id", "base_currency", F.substring(F.split("portfolio_id", "-")[0], 2, 3).cast("int").alias("r"), F.split("portfolio_id", "-")[1].cast("int").alias("i"))
    rates = pair.join(nations, F.col("r") == F.col("n_regionkey")).where((n + F.col("i")) % 17 != 0).select(
        "portfolio_id", code("n_nationkey").alias("from_currency"), "base_currency", ((n + 1) * 12_345_678 + F.col("i")).cast("bigint").alias("rate"), F.when((n + F.col("i")) % 23 == 0, "2001-07-01").otherwise("2001-05-01").cast("timestamp_ntz").alias("as_of"), "i", "n_nationkey"
    ).withColumn("to_currency", F.when((n + F.col("i")) % 29 == 0, "XXX").otherwise(F.col("base_currency"))).withColumn("rate", F.when((n + F.col("i")) % 31 == 0, 0).otherwise(F.col("rate")).cast("bigint"))
    return accounts, portfolios, rates.drop("base_currency", "i", "n_nationkey")


def _good_rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    accounts, portfolios, rates = _portfolio(spark, sf_dir)
    return accounts, portfolios, pf.rate_errors(rates, portfolios).where("error IS NULL")


def rate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, portfolios, rates = _portfolio(spark, sf_dir)
    return pf.rate_errors(rates, portfolios).where("error IS NOT NULL").select("portfolio_id", "from_currency", "error")


def portfolio_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.equity(*_good_rates(spark, sf_dir))


def missing_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.missing_currencies(*_good_rates(spark, sf_dir))


def rates_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.rates_used(*_good_rates(spark, sf_dir))


def asof_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(pf.as_of_range(_portfolio(spark, sf_dir)[0]), "oldest", "newest")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "short").otherwise("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account_id"), F.col("l_partkey").alias("instrument_id"), side.alias("side"))
    return rows.agg(F.sum(units("l_quantity", 0)).alias("quantity"))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position beside the number of those in its instrument."""
    return pf.exposure(_positions(spark, sf_dir))


def exposure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.exposure_totals(_positions(spark, sf_dir))


def position_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with defects by rule."""
    k = F.col("account_id") + F.col("instrument_id") * 3
    rows = _positions(spark, sf_dir).withColumns({"side": F.when(k % 13 == 0, "flat").when(k % 17 == 0, "both").otherwise(F.col("side")), "avg_price": F.when(k % 11 != 0, F.lit(1).cast("bigint")), "quantity": F.when(k % 19 == 0, 0).otherwise(F.col("quantity")).cast("bigint")})
    return rows.withColumn("error", pf.position_error()).where("error IS NOT NULL").select("account_id", "instrument_id", "side", "quantity", "error")


def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of customers with their orders as open orders and line items as positions, defects by rule."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    usd = F.lit("USD")
    money = lambda name, amount, currency: F.struct(F.lit(name).alias("name"), amount.alias("amount"), currency.alias("currency"))
    amount = units("c_acctbal", 2)
    special = {"equity": money("equity", F.when(k % 29 != 0, amount), usd), "fees": money("fees", amount, F.when(k % 31 == 0, F.lit("EUR")).otherwise(usd)), "financing": F.when(k % 53 != 0, money("financing", amount, usd))}
    moneys = F.array_compact(F.array(*[special.get(name, money(name, amount, usd)) for name in pf.MONEYS]))
    snapshots = c.select(k.alias("account_id"), F.when(k % 37 == 0, "").otherwise("BrokerA").alias("broker"), F.when(k % 41 == 0, "us").otherwise("USD").alias("currency"), F.when(k % 43 != 0, F.lit("2001-08-01").cast("timestamp_ntz")).alias("as_of"), moneys.alias("moneys"))
    balances = c.select(k.alias("account_id"), F.explode(F.array(F.lit("USD"), F.when(k % 47 == 0, "USD").otherwise("EUR"))).alias("currency"), F.lit(0).cast("bigint").alias("amount"))
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    orders = o.select(F.col("o_custkey").alias("account_id"), (F.col("o_custkey") + F.when(ok % 50 == 0, 1).otherwise(0)).alias("owner"), F.when(ok % 70 == 0, "other").otherwise("brokera").alias("provider"), F.lit("x").alias("listing"), (ok / 10).cast("bigint").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("working").alias("status"))
    positions = o.select(F.col("o_custkey").alias("account_id"), F.col("o_custkey").alias("owner"), F.lit("BROKERA").alias("provider"), (ok % 9).cast("string").alias("listing"))
    return pf.snapshot_errors(snapshots, balances, positions, orders)


QUERIES = {
    "instrument_ids": instrument_ids, "fx_listings": fx_listings, "listing_errors": listing_errors, "alias_errors": alias_errors, "resolve_symbol": resolve_symbol, "resolve_ambiguous": resolve_ambiguous, "resolve_instrument": resolve_instrument,
    "rate_errors": rate_errors, "portfolio_equity": portfolio_equity, "missing_currencies": missing_currencies, "rates_used": rates_used, "asof_range": asof_range, "exposure": exposure, "exposure_totals": exposure_totals,
    "position_errors": position_errors, "snapshot_violations": snapshot_violations,
}

_U = lambda c, p: f"(CAST(floor({c} * {10**p} + 0.5) AS BIGINT) * {10 ** (8 - p)})"
_CODE = lambda c: f"translate(lpad(CAST({c} AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ')"
_LISTINGS = """listings AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'idx:P' ELSE 'eq:P' END || p_partkey AS instrument_id, 'prov' || (p_partkey % 10) AS provider, 'V' || (p_partkey % 3) AS venue, substr(p_type, 1, 2) || '.' || (p_partkey % 400) AS symbol,
  p_partkey % 7 <> 0 AS tradable, p_size FROM part),
a0 AS (SELECT k, upper(provider) AS p, upper(venue) AS v, unnest([{'at': 0, 's': 'DL' || k, 'rv': '', 'rs': 'AL' || (k % 1000)}, {'at': 1, 's': 'AL' || (k % 1000), 'rv': CASE WHEN k % 120 = 0 THEN 'NOWHERE' ELSE upper(venue) END, 'rs': upper(symbol)},
  {'at': 2, 's': 'AL' || (k % 1000), 'rv': '', 'rs': upper(symbol)}, {'at': 3, 's': 'BL' || k, 'rv': '', 'rs': 'AL' || (k % 1000)}, {'at': 4, 's': 'CL' || k, 'rv': upper(venue), 'rs': 'BL' || k}]) AS a FROM listings WHERE k % 40 = 0),
aliases AS (SELECT k * 10 + a.at AS seq, row_number() OVER (ORDER BY k * 10 + a.at) AS n, p, v, a.s AS s, a.rv AS rv, a.rs AS rs FROM a0)"""
#: Registrations one after the other, each with the list of all names so far.
_REGISTERED = f"""RECURSIVE {_LISTINGS}, r(n, seq, error, names) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), (SELECT list({{'i': i, 'p': p, 'v': v, 's': s}}) FROM (SELECT DISTINCT instrument_id AS i, upper(provider) AS p, upper(venue) AS v, upper(symbol) AS s FROM listings))
UNION ALL SELECT n, seq, error, CASE WHEN error IS NULL THEN list_append(names, {{'i': hits[1].i, 'p': p, 'v': hits[1].v, 's': s}}) ELSE names END FROM (SELECT *, CASE WHEN len(hits) = 0 THEN 'unresolved' WHEN len(hits) > 1 THEN 'ambiguous' WHEN len(same) > 0 THEN 'duplicate' END AS error FROM (
  SELECT a.n, a.seq, a.p, a.s, r.names, list_filter(r.names, lambda x: x.p = a.p AND x.s = a.rs AND (a.rv = '' OR x.v = a.rv)) AS hits, list_filter(r.names, lambda x: x.p = a.p AND x.s = a.s AND x.v = a.v) AS same FROM r JOIN aliases a ON a.n = r.n + 1)))"""
_NAMES = f"""{_REGISTERED}, names AS (SELECT x.i AS instrument_id, x.p AS p, x.v AS v, x.s AS s FROM (SELECT unnest(names) AS x FROM r WHERE n = (SELECT max(n) FROM r))),
requests AS (SELECT o_orderkey AS request_id, upper(coalesce(provider, 'prov0')) AS p, CASE WHEN o_orderkey % 4 <> 0 THEN upper(venue) END AS v, CASE WHEN q % 40 = 0 AND o_orderkey % 3 = 0 THEN 'AL' || (q % 1000) WHEN q % 40 = 0 AND o_orderkey % 3 = 1 THEN 'CL' || q ELSE upper(coalesce(symbol, 'none')) END AS s
  FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) + count(*) // 4 FROM part) AS q FROM orders) LEFT JOIN listings ON k = q),
found AS (SELECT request_id, count(n.instrument_id) AS hits, min(n.instrument_id) AS one FROM requests r LEFT JOIN names n ON n.p = r.p AND n.s = r.s AND (r.v IS NULL OR r.v = n.v) GROUP BY request_id)"""
_PF = f"""accounts AS (SELECT 'R' || n_regionkey || '-' || (c_custkey % 40) AS portfolio_id, c_custkey AS account_id, 'N' || {_CODE('n_nationkey')} AS currency, {_U('c_acctbal', 2)} AS equity, as_of FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS as_of FROM orders GROUP BY 1) ON o_custkey = c_custkey),
portfolios AS (SELECT portfolio_id, r, i, 'N' || {_CODE('b')} AS base FROM (SELECT DISTINCT 'R' || n_regionkey || '-' || (c_custkey % 40) AS portfolio_id, n_regionkey AS r, CAST(c_custkey % 40 AS BIGINT) AS i FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS b FROM nation GROUP BY 1) USING (r)),
rates0 AS (SELECT portfolio_id, base, 'N' || {_CODE('n_nationkey')} AS cur, n_nationkey + i AS z, (n_nationkey + 1) * 12345678 + i AS rate FROM portfolios JOIN nation ON n_regionkey = r WHERE (n_nationkey + i) % 17 <> 0),
rates1 AS (SELECT portfolio_id, cur, CASE WHEN z % 29 = 0 THEN 'to' WHEN cur = base THEN 'from_is_base' WHEN z % 31 = 0 THEN 'rate' WHEN z % 23 = 0 THEN 'look_ahead' END AS error, rate FROM rates0),
each AS (SELECT a.*, p.base, a.currency <> p.base AS needs, x.rate, CASE WHEN a.currency = p.base THEN a.equity ELSE CAST({half_even('CAST(a.equity AS HUGEINT) * x.rate', '100000000')} AS BIGINT) END AS value FROM accounts a JOIN portfolios p USING (portfolio_id) LEFT JOIN (SELECT * FROM rates1 WHERE error IS NULL) x ON x.portfolio_id = a.portfolio_id AND x.cur = a.currency)"""
_POS = f"positions AS (SELECT l_suppkey AS account_id, l_partkey AS instrument_id, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side, CAST(sum({_U('l_quantity', 0)}) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL)"

ORACLES = {
    "instrument_ids": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 4 = 0 AND p_partkey % 10 = 0 THEN NULL ELSE 'fx:' || CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE 'USD' END || '/' || CASE WHEN p_partkey % 10 = 0 THEN 'EUR' ELSE 'JPY' END END
  ELSE CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 6 WHEN 1 THEN 'eq:' || b || ':X' || p_size WHEN 2 THEN 'etf:' || b || ':X' || p_size WHEN 3 THEN 'fut:' || b || ':' || strftime(DATE '2024-01-15' + p_size * 10, '%Y-%m') WHEN 4 THEN 'cont:' || b ELSE 'idx:' || b END END END AS instrument_id
FROM (SELECT *, upper(replace(p_brand, '#', '-')) AS b FROM part)""",
    "fx_listings": f"""SELECT c_custkey, CASE WHEN good THEN 'fx:' || a || '/' || q END AS instrument_id, CASE WHEN good THEN a || q END AS symbol, CASE WHEN good THEN CAST(CASE WHEN q = 'JPY' THEN 100000 ELSE 1000 END AS BIGINT) END AS tick_size, CASE WHEN good THEN q END AS settlement_currency
FROM (SELECT *, q <> 'EU1' AND a <> q AS good FROM (SELECT c_custkey, 'C' || {_CODE('c_nationkey')} AS a, CASE WHEN (c_custkey % 25) % 5 = 0 THEN 'JPY' WHEN (c_custkey % 25) % 7 = 0 THEN 'EU1' ELSE 'C' || {_CODE('(c_custkey % 25)')} END AS q FROM customer))""",
    "listing_errors": f"WITH {_LISTINGS} SELECT instrument_id, CASE WHEN p_size <= 0 THEN 'tick_size' WHEN k % 50 = 1 THEN 'quantity_increment' WHEN k % 60 = 2 THEN 'settlement_currency' END AS error FROM listings WHERE p_size <= 0 OR k % 50 = 1 OR k % 60 = 2",
    "alias_errors": f"WITH {_REGISTERED} SELECT seq, error FROM r WHERE error IS NOT NULL",
    "resolve_symbol": f"WITH {_NAMES} SELECT request_id, one AS instrument_id FROM found WHERE hits = 1",
    "resolve_ambiguous": f"WITH {_NAMES} SELECT request_id, CASE WHEN hits = 0 THEN 'unknown' ELSE 'ambiguous' END AS status FROM found WHERE hits <> 1",
    "resolve_instrument": f"""WITH {_LISTINGS}, r AS (SELECT k, k % 9 <> 0 AND tradable AND (k % 4 <> 0 OR k % 8 = k % 10) AS ok, provider, venue, symbol FROM listings)
SELECT k AS request_id, CASE WHEN ok THEN 'resolved' ELSE 'unknown' END AS status, CASE WHEN ok THEN upper(provider) END AS provider, CASE WHEN ok THEN upper(venue) END AS venue, CASE WHEN ok THEN symbol END AS symbol FROM r""",
    "rate_errors": f"WITH {_PF} SELECT portfolio_id, cur AS from_currency, error FROM rates1 WHERE error IS NOT NULL",
    "portfolio_equity": f"WITH {_PF} SELECT portfolio_id, CASE WHEN count(*) FILTER (needs AND rate IS NULL) = 0 THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN count(*) FILTER (needs AND rate IS NULL) = 0 THEN CAST(sum(value) AS BIGINT) END AS equity, count(*) AS accounts FROM each GROUP BY portfolio_id",
    "missing_currencies": f"WITH {_PF} SELECT portfolio_id, currency, min(account_id) AS first_account FROM each WHERE needs AND rate IS NULL GROUP BY ALL",
    "rates_used": f"WITH {_PF} SELECT DISTINCT portfolio_id, currency, rate FROM each WHERE needs AND rate IS NOT NULL AND portfolio_id NOT IN (SELECT portfolio_id FROM each WHERE needs AND rate IS NULL)",
    "asof_range": f"WITH {_PF} SELECT portfolio_id, strftime(min(as_of), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(as_of), '%Y-%m-%d %H:%M:%S') AS newest FROM accounts GROUP BY 1",
    "exposure": f"WITH {_POS} SELECT instrument_id, account_id, side, quantity, count(*) OVER (PARTITION BY instrument_id) AS contributors FROM positions",
    "exposure_totals": f"WITH {_POS} SELECT instrument_id, side, count(*) AS contributors, CAST(sum(quantity) AS BIGINT) AS quantity FROM positions GROUP BY 1, 2",
    "position_errors": f"""WITH {_POS}, d AS (SELECT account_id, instrument_id, CASE WHEN z % 13 = 0 THEN 'flat' WHEN z % 17 = 0 THEN 'both' ELSE side END AS side, z % 11 <> 0 AS priced, CASE WHEN z % 19 = 0 THEN 0 ELSE quantity END AS quantity FROM (SELECT *, account_id + instrument_id * 3 AS z FROM positions)),
e AS (SELECT account_id, instrument_id, side, CAST(quantity AS BIGINT) AS quantity, CASE WHEN side = 'both' THEN 'side' WHEN side = 'flat' AND quantity <> 0 THEN 'flat_quantity' WHEN side = 'flat' AND priced THEN 'flat_price' WHEN side <> 'flat' AND quantity <= 0 THEN 'quantity' WHEN side <> 'flat' AND NOT priced THEN 'price' END AS error FROM d)
SELECT * FROM e WHERE error IS NOT NULL""",
    "snapshot_violations": """WITH s AS (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'brokera' END AS broker FROM customer), o AS (SELECT o_custkey AS account_id, o_orderkey AS k, o_orderstatus AS st FROM orders),
v AS (SELECT account_id, 'broker' AS rule FROM s WHERE broker = '' UNION ALL SELECT c_custkey, 'currency' FROM customer WHERE c_custkey % 41 = 0 UNION ALL SELECT c_custkey, 'as_of' FROM customer WHERE c_custkey % 43 = 0
UNION ALL SELECT c_custkey, 'money_' || m FROM customer, (VALUES ('equity'), ('buying_power'), ('margin_used'), ('margin_available'), ('realized_pnl'), ('unrealized_pnl'), ('fees'), ('financing')) AS f(m)
  WHERE c_custkey % 41 = 0 OR (m = 'equity' AND c_custkey % 29 = 0) OR (m = 'fees' AND c_custkey % 31 = 0) OR (m = 'financing' AND c_custkey % 53 = 0)
UNION ALL SELECT c_custkey, 'cash_duplicate' FROM customer WHERE c_custkey % 47 = 0
UNION ALL SELECT account_id, 'order_account' FROM o WHERE k % 50 = 0 UNION ALL SELECT account_id, 'order_provider' FROM o JOIN s USING (account_id) WHERE CASE WHEN k % 70 = 0 THEN 'other' ELSE 'brokera' END <> broker
UNION ALL SELECT account_id, 'order_terminal' FROM o WHERE st = 'F' UNION ALL SELECT account_id, 'order_duplicate' FROM o GROUP BY account_id, k // 10 HAVING count(*) > 1
UNION ALL SELECT account_id, 'position_provider' FROM o JOIN s USING (account_id) WHERE broker <> 'brokera' UNION ALL SELECT account_id, 'position_duplicate' FROM o GROUP BY account_id, k % 9 HAVING count(*) > 1)
SELECT account_id, rule, count(*) AS n FROM v GROUP BY ALL""",
}
