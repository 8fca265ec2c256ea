"""Orders, fills, event chains: line items stand in for fills, conversations for workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decimals as dec
from ..operators import audit
from ..operators import orders as ops
from .common import table, units

UNIT = dec.SCALE


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills, numbered (n) within their order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), "l_orderkey", units("l_quantity", 0).alias("quantity"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("x"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("x", "quantity")).cast("bigint")).drop("x")


def _ids(seq: Column) -> dict[str, Column]:
    """fill_id and broker_fill_id of a fill by its place; a second delivery (the place after a fill's own, which is a multiple of 10) has another fill_id."""
    n = F.floor(seq / 10).cast("bigint")
    return {"fill_id": F.concat(F.concat_ws("-", F.lit("f"), "order_id", n), F.when(seq % 10 == 1, "r").otherwise("")), "broker_fill_id": F.concat_ws("-", F.lit("b"), "order_id", n)}


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills, numbered within their order; every fifth order's are delivered twice, the second time under another fill_id."""
    own = F.col("n") * 10
    seq = F.explode(F.when(F.col("l_orderkey") % 5 == 0, F.array(own, own + 1)).otherwise(F.array(own))).alias("seq")
    fills = _numbered(spark, sf_dir).select("order_id", "l_orderkey", "quantity", "n", seq).withColumns(_ids(F.col("seq")))
    return fills.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seq").cast("decimal(18,6)")))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with accepted quantity: what their fills sum up to, one more where the key leaves 1 by three, five less where it leaves 2."""
    total = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(units("l_quantity", 0)).alias("total"))
    k = F.col("l_orderkey") % 3
    return total.select(F.col("l_orderkey").cast("string").alias("order_id"), "l_orderkey", (F.col("total") + F.when(k == 1, UNIT).when(k == 2, -5 * UNIT).otherwise(0)).alias("accepted_quantity"))


def fill_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_fills(_fills(spark, sf_dir)).select("order_id", "fill_id", "quantity")


def fill_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.running_fills(ops.distinct_fills(_fills(spark, sf_dir)), _accepted(spark, sf_dir))
    return found.select("order_id", "fill_id", "filled_after", "status_after")


def order_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filled_orders(ops.distinct_fills(_fills(spark, sf_dir)), _accepted(spark, sf_dir)).drop("remaining_quantity")


def remaining_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filled_orders(ops.distinct_fills(_fills(spark, sf_dir)), _accepted(spark, sf_dir)).select("order_id", "remaining_quantity")


def fill_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills whose account, listing, side or broker order differ from their order's by rule, or whose order isn't there."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").alias("account_id"), (F.col("o_orderkey") % 50).alias("instrument_id"), F.lit("buy").alias("side"), F.when(F.col("o_orderkey") % 2 == 0, "B1").otherwise("").alias("broker_order_id"))
    k = F.col("l_orderkey") + F.col("l_linenumber")
    account = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    fills = table(spark, sf_dir, "lineitem").join(account, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "l_suppkey", (F.col("o_custkey") + F.when(k % 13 == 0, 1).otherwise(0)).alias("account_id"), ((F.col("l_orderkey") + F.when(k % 17 == 0, 1).otherwise(0)) % 50).alias("instrument_id"),
        F.when(k % 19 == 0, "sell").otherwise("buy").alias("side"), F.when(k % 23 == 0, "B2").otherwise("").alias("broker_order_id"),
    )
    return ops.mismatched_fills(fills, orders).where("mismatch IS NOT NULL").select("order_id", "line", "l_partkey", "l_suppkey", "mismatch")


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of status that orders' keys spell out, less the legal ones."""
    at = lambda c: F.element_at(F.array(*[F.lit(s) for s in ops.STATUSES]), (c % 10 + 1).cast("int"))
    changes = table(spark, sf_dir, "orders").select("o_orderkey", at(F.col("o_orderkey")).alias("from_status"), at(F.col("o_custkey")).alias("to_status"))
    return ops.illegal_transitions(changes)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_orderkey") * 7 + F.col("l_linenumber"), units("l_quantity", 0)
    price = units("l_extendedprice", 2)
    kind = F.element_at(F.array(*[F.lit(x) for x in (*ops.TYPES, "iceberg")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", k.alias("k"), kind.alias("order_type"), F.when(k % 31 == 0, "hold").otherwise("buy").alias("side"), F.when(k % 37 == 0, 0).otherwise(q + F.when(k % 41 == 0, 1).otherwise(0)).cast("bigint").alias("quantity"),
        F.when((k % 5).isin(1, 3) & (k % 6 != 0) | (k % 43 == 0), price).alias("limit_price"), F.when((k % 5).isin(2, 3) & (k % 7 != 0) | (k % 47 == 0), price + 500_000).alias("stop_price"), F.lit(1_000_000).cast("bigint").alias("tick_size"), F.lit(UNIT).cast("bigint").alias("quantity_increment"),
    )


def terms_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _terms(spark, sf_dir).withColumn("error", ops.terms_error()).where("error IS NOT NULL")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error")


def fill_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills with defects by rule, and the first rule that each breaks."""
    k = F.col("k")
    rows = _terms(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k % 53 != 0, "f").alias("fill_id"), F.when(k % 59 == 0, "").otherwise("o").alias("order_id"), F.when(k % 61 != 0, "a").alias("account_id"), F.when(k % 67 != 0, "i").alias("instrument_id"), "side", "quantity",
        (F.coalesce("limit_price", F.lit(1_000_000)) + F.when(k % 71 == 0, 1).otherwise(0)).cast("bigint").alias("price"), "tick_size", "quantity_increment",
    )
    return rows.withColumn("error", ops.fill_error()).where("error IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error")


def trade_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades with defects by rule."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 7 != 0, c).alias("account_id"), F.when(c % 11 != 0, "i").alias("instrument_id"), F.when(k % 5 == 0, "flat").otherwise("long").alias("side"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(k % 13 != 0, "f1"))).alias("entry_fill_ids"),
        F.array(F.when(k % 17 == 0, "").otherwise("f2")).alias("exit_fill_ids"), F.when(k % 19 != 0, F.col("o_orderdate")).alias("opened_at"), (F.col("o_orderdate") + F.make_dt_interval((k % 9 - 1).cast("int"))).alias("closed_at"),
    )
    return rows.withColumn("error", ops.trade_error()).where("error IS NOT NULL").select("o_orderkey", "error")


def command_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancel and replace requests spelt out by orders' keys, with defects by rule."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, "replace_request").otherwise("cancel_request").alias("kind"), F.when(k % 7 != 0, "o").alias("order_id"), F.when(k % 11 == 0, "").otherwise("e").alias("event_id"), F.when(k % 3 == 0, k % 5).cast("bigint").alias("new_quantity"),
        F.when(k % 13 == 0, 5).cast("bigint").alias("new_limit_price"), F.when(k % 17 == 0, 5).cast("bigint").alias("new_stop_price"),
    )
    return rows.withColumn("error", ops.command_error()).where("error IS NOT NULL").select("o_orderkey", "error")


def order_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states spelt out by keys, and the first invariant that each breaks."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ops.STATUSES]), (k % 10 + 1).cast("int"))
    pending = status.isin("pending_cancel", "pending_replace")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", status.alias("status"), F.when((c % 7 != 0) & ~status.isin("pending_submit", "rejected") | (c % 11 == 0), F.lit(100)).cast("bigint").alias("accepted_quantity"),
        F.when(c % 13 == 0, 101).when(c % 3 == 0, 50).otherwise(0).cast("bigint").alias("filled_quantity"), ((status == "rejected") != (c % 17 == 0)).alias("rejected"), F.when(pending != (c % 19 == 0), "evt").otherwise("").alias("pending_command"),
        F.array(F.lit("f1"), F.when(c % 23 == 0, "f1").otherwise("f2")).alias("fill_ids"), F.array(F.lit("b1"), F.when(c % 29 == 0, "b1").otherwise("b2")).alias("broker_fill_ids"),
    )
    return rows.withColumn("error", ops.order_error()).where("error IS NOT NULL").select("o_orderkey", "error")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs of orders with line items: submitted, accepted, filled; where the key leaves 2 by three, cancelled after the second fill. Line items are read and dealt once: the events that an order has beside its fills come with its first."""
    k, n, seq, kind = F.col("l_orderkey"), F.col("n"), F.col("e.seq"), F.col("e.kind")
    event = lambda at, name: F.struct((F.lit(at) if isinstance(at, int) else at).cast("bigint").alias("seq"), F.lit(name).alias("kind"))
    some = lambda wanted, *events: F.when(wanted, F.array(*events)).otherwise(F.array().cast("array<struct<seq:bigint,kind:string>>"))
    once = F.concat(
        F.array(event(0, "submit"), event(1, "accept")), some(k % 3 == 2, event(25, "cancel_request"), event(26, "cancel_result")), some(k % 7 == 0, event(5, "expire")), some(k % 8 == 1, event(8, "accept")),
    )
    each = F.explode(F.concat(F.when(n == 1, once).otherwise(F.array().cast("array<struct<seq:bigint,kind:string>>")), F.array(event(n * 10, "fill")), some(k % 5 == 0, event(n * 10 + 1, "fill")))).alias("e")
    rows = _numbered(spark, sf_dir).withColumn("total", F.sum("quantity").over(Window.partitionBy("l_orderkey"))).select("order_id", "l_orderkey", "quantity", "total", each)
    accepted, fill = F.col("total") + F.when(k % 3 == 1, UNIT).otherwise(0), kind == "fill"
    columns = {
        "seq": seq, "kind": kind, "event_id": F.when(kind == "cancel_request", "c1").otherwise(""), "causation_id": F.when(kind == "cancel_result", F.when(k % 9 == 2, "c0").otherwise("c1")).otherwise(""),
        "status": F.when(kind == "cancel_result", "canceled").when(kind == "expire", "expired"), "account_id": F.lit("a"), "instrument_id": F.lit("i"), "side": F.lit("buy"), "quantity": F.when(fill, F.col("quantity")).when(kind == "accept", accepted),
        "limit_price": F.lit(None).cast("bigint"), "stop_price": F.lit(None).cast("bigint"), **{c: F.when(fill, v) for c, v in _ids(seq).items()}, "broker_order_id": F.lit("B"), "rejected": F.lit(False),
    }
    return rows.select("order_id", *[v.alias(c) for c, v in columns.items()])


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.fold(_events(spark, sf_dir))
    return found.select("order_id", "status", "accepted_quantity", "filled_quantity", F.coalesce("pending_command", F.lit("")).alias("pending_command"), "applied", "refused")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as events, each caused by the turn before; some name a cause that isn't there."""
    turn = F.col("turn")
    ident = lambda t: F.concat_ws("-", F.lit("evt"), F.col("conv_id"), t)
    cause = F.when(turn > 0, ident(turn - F.when(F.col("conv_id") % 5 == 0, 2).otherwise(1)))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("correlation_id"), ident(turn).alias("event_id"), cause.alias("causation_id"), turn.alias("ts")).distinct()


def causation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.links(_chain(spark, sf_dir)).select("correlation_id", "event_id", "causation_id", "cause_ts")


def causation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(_chain(spark, sf_dir)).select("correlation_id", "event_id", "causation_id")


def causation_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths over all conversations, those with missing causes included."""
    return audit.depths(_chain(spark, sf_dir))


def audited_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 partitions (status, year) of orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return audit.sample_partitions(rows, ["o_orderstatus", "year", "month"])


QUERIES = {
    "fill_dedupe": fill_dedupe, "fill_running": fill_running, "order_fills": order_fills, "remaining_qty": remaining_qty, "fill_mismatches": fill_mismatches, "illegal_transitions": illegal_transitions, "terms_errors": terms_errors,
    "fill_errors": fill_errors, "trade_errors": trade_errors, "command_errors": command_errors, "order_invariants": order_invariants, "order_lifecycle": order_lifecycle, "causation_chain": causation_chain, "causation_orphans": causation_orphans, "causation_depths": causation_depths, "audited_partitions": audited_partitions,
}

_Q = "(CAST(floor(l_quantity + 0.5) AS BIGINT) * 100000000)"
_P = "(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 1000000)"
_FILLS = f"""fills AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_orderkey, {_Q} AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem),
accepted AS (SELECT l_orderkey, CAST(sum({_Q}) AS BIGINT) + CASE l_orderkey % 3 WHEN 1 THEN 100000000 WHEN 2 THEN -500000000 ELSE 0 END AS accepted_quantity FROM lineitem GROUP BY 1)"""
_STATUS = lambda f, a: f"CASE WHEN {f} > {a} THEN 'overfilled' WHEN {f} = {a} THEN 'filled' ELSE 'partially_filled' END"
_LIST = "['" + "', '".join(ops.STATUSES) + "']"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a in ops.STATUSES for b in ops.STATUSES if ops.can_follow(a, b))
_TERMS = f"""terms AS (SELECT *, l_orderkey * 7 + l_linenumber AS k, {_Q} AS q, {_P} AS p FROM lineitem),
t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, k % 5 AS kind, k % 31 = 0 AS hold, CASE WHEN k % 37 = 0 THEN 0 ELSE q + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END END AS quantity,
  CASE WHEN (k % 5 IN (1, 3) AND k % 6 <> 0) OR k % 43 = 0 THEN p END AS lim, CASE WHEN (k % 5 IN (2, 3) AND k % 7 <> 0) OR k % 47 = 0 THEN p + 500000 END AS stp FROM terms)"""
_CHAIN = "chain AS (SELECT DISTINCT conv_id AS correlation_id, 'evt-' || conv_id || '-' || turn AS event_id, CASE WHEN turn > 0 THEN 'evt-' || conv_id || '-' || (turn - CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END) END AS causation_id, turn AS ts FROM conversations)"

ORACLES = {
    "fill_errors": f"""WITH {_TERMS}, u AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM t), e AS (SELECT *, CASE WHEN k % 53 = 0 THEN 'fill_id' WHEN k % 59 = 0 THEN 'order_id' WHEN k % 61 = 0 THEN 'account_id' WHEN k % 67 = 0 THEN 'listing' WHEN hold THEN 'side' WHEN quantity <= 0 THEN 'quantity'
  WHEN quantity % 100000000 <> 0 THEN 'quantity_grid' WHEN (coalesce(lim, 1000000) + CASE WHEN k % 71 = 0 THEN 1 ELSE 0 END) % 1000000 <> 0 THEN 'price_grid' END AS error FROM u) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, error FROM e WHERE error IS NOT NULL""",
    "trade_errors": """WITH e AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'account_id' WHEN o_custkey % 11 = 0 THEN 'listing' WHEN o_orderkey % 5 = 0 THEN 'side' WHEN o_orderkey % 6 = 0 THEN 'entries' WHEN o_orderkey % 13 = 0 THEN 'entry_id' WHEN o_orderkey % 17 = 0 THEN 'exit_id'
  WHEN o_orderkey % 19 = 0 THEN 'opened_at' WHEN o_orderkey % 9 = 0 THEN 'closed_at' END AS error FROM orders) SELECT * FROM e WHERE error IS NOT NULL""",
    "command_errors": """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS q FROM orders), e AS (SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN 'order_id' WHEN k % 11 = 0 THEN 'event_id' WHEN k % 2 = 0 AND q IS NULL AND k % 13 <> 0 AND k % 17 <> 0 THEN 'nothing_to_replace'
  WHEN k % 2 = 0 AND q <= 0 THEN 'quantity' END AS error FROM c) SELECT * FROM e WHERE error IS NOT NULL""",
    "fill_dedupe": f"WITH {_FILLS} SELECT order_id, 'f-' || order_id || '-' || n AS fill_id, quantity FROM fills",
    "fill_running": f"""WITH {_FILLS}, r AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY l_orderkey ORDER BY n) AS BIGINT) AS filled_after FROM fills) SELECT order_id, 'f-' || order_id || '-' || n AS fill_id, filled_after, {_STATUS('filled_after', 'accepted_quantity')} AS status_after FROM r JOIN accepted USING (l_orderkey)""",
    "order_fills": f"WITH {_FILLS}, s AS (SELECT l_orderkey, CAST(sum(quantity) AS BIGINT) AS f FROM fills GROUP BY 1) SELECT CAST(l_orderkey AS VARCHAR) AS order_id, accepted_quantity, f AS filled_quantity, {_STATUS('f', 'accepted_quantity')} AS status FROM s JOIN accepted USING (l_orderkey)",
    "remaining_qty": f"WITH {_FILLS}, s AS (SELECT l_orderkey, CAST(sum(quantity) AS BIGINT) AS f FROM fills GROUP BY 1) SELECT CAST(l_orderkey AS VARCHAR) AS order_id, accepted_quantity - f AS remaining_quantity FROM s JOIN accepted USING (l_orderkey)",
    "fill_mismatches": """WITH x AS (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 11 = 0 THEN 'order' WHEN k % 13 = 0 THEN 'account' WHEN k % 17 = 0 THEN 'listing' WHEN k % 19 = 0 THEN 'side' WHEN k % 23 = 0 AND l_orderkey % 2 = 0 THEN 'broker_order' END AS mismatch FROM x) SELECT * FROM m WHERE mismatch IS NOT NULL""",
    "illegal_transitions": f"WITH c AS (SELECT o_orderkey, {_LIST}[o_orderkey % 10 + 1] AS from_status, {_LIST}[o_custkey % 10 + 1] AS to_status FROM orders) SELECT * FROM c WHERE (from_status, to_status) NOT IN ({_LEGAL})",
    "terms_errors": f"""WITH {_TERMS}, e AS (SELECT *, CASE WHEN hold THEN 'side' WHEN kind = 4 THEN 'type' WHEN kind IN (1, 3) AND lim IS NULL THEN 'limit_missing' WHEN kind NOT IN (1, 3) AND lim IS NOT NULL THEN 'limit_unexpected' WHEN kind IN (2, 3) AND stp IS NULL THEN 'stop_missing'
  WHEN kind NOT IN (2, 3) AND stp IS NOT NULL THEN 'stop_unexpected' WHEN quantity <= 0 THEN 'quantity' WHEN quantity % 100000000 <> 0 THEN 'quantity_grid' WHEN lim % 1000000 <> 0 THEN 'limit_grid' WHEN stp % 1000000 <> 0 THEN 'stop_grid' END AS error FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, error FROM e WHERE error IS NOT NULL""",
    "order_invariants": f"""WITH s AS (SELECT o_orderkey, o_custkey AS c, {_LIST}[o_orderkey % 10 + 1] AS st FROM orders), r AS (SELECT *, CASE WHEN (c % 7 <> 0 AND st NOT IN ('pending_submit', 'rejected')) OR c % 11 = 0 THEN 100 END AS acc, CASE WHEN c % 13 = 0 THEN 101 WHEN c % 3 = 0 THEN 50 ELSE 0 END AS fil FROM s),
e AS (SELECT o_orderkey, CASE WHEN acc < fil THEN 'overfilled' WHEN acc IS NULL AND fil <> 0 THEN 'filled_unaccepted' WHEN acc IS NULL AND st IN ('working', 'partially_filled', 'filled', 'pending_cancel', 'canceled', 'pending_replace', 'expired') THEN 'unaccepted'
  WHEN acc IS NOT NULL AND st IN ('pending_submit', 'rejected') THEN 'accepted' WHEN c % 17 = 0 THEN 'rejection' WHEN c % 19 = 0 THEN 'pending_command' WHEN c % 23 = 0 THEN 'fill_ids' WHEN c % 29 = 0 THEN 'broker_fill_ids' END AS error FROM r) SELECT * FROM e WHERE error IS NOT NULL""",
    "order_lifecycle": f"""WITH {_FILLS}, o AS (SELECT l_orderkey AS k, CAST(sum(quantity) AS BIGINT) AS total, count(*) AS fills, CAST(coalesce(sum(quantity) FILTER (n <= 2), 0) AS BIGINT) AS two FROM fills GROUP BY 1),
p AS (SELECT *, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS times, CASE WHEN k % 7 = 0 THEN 'expired' WHEN k % 3 = 2 AND fills > 2 THEN CASE WHEN k % 9 = 2 THEN 'stale' ELSE 'canceled' END WHEN k % 3 = 1 THEN 'partially_filled' ELSE 'filled' END AS path FROM o)
SELECT CAST(k AS VARCHAR) AS order_id, CASE WHEN path = 'stale' THEN 'filled' ELSE path END AS status, total + CASE WHEN k % 3 = 1 THEN 100000000 ELSE 0 END AS accepted_quantity, CASE path WHEN 'expired' THEN 0 WHEN 'canceled' THEN two ELSE total END AS filled_quantity, '' AS pending_command,
  CAST(CASE path WHEN 'expired' THEN 3 WHEN 'canceled' THEN 2 + 2 + 2 WHEN 'stale' THEN 2 + fills + 1 ELSE 2 + fills END AS BIGINT) AS applied,
  CAST(CASE path WHEN 'expired' THEN fills * times + CASE WHEN k % 3 = 2 THEN 2 ELSE 0 END WHEN 'canceled' THEN fills * times - 2 WHEN 'stale' THEN fills * (times - 1) + 1 ELSE fills * (times - 1) + CASE WHEN k % 3 = 2 THEN 2 ELSE 0 END END + CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS BIGINT) AS refused FROM p""",
    "causation_chain": f"WITH {_CHAIN} SELECT a.correlation_id, a.event_id, a.causation_id, b.ts AS cause_ts FROM chain a JOIN chain b ON b.correlation_id = a.correlation_id AND b.event_id = a.causation_id",
    "causation_orphans": f"WITH {_CHAIN} SELECT correlation_id, event_id, causation_id FROM chain a WHERE causation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chain b WHERE b.correlation_id = a.correlation_id AND b.event_id = a.causation_id)",
    "causation_depths": f"WITH RECURSIVE {_CHAIN}, d AS (SELECT correlation_id, event_id, 0 AS depth FROM chain WHERE causation_id IS NULL UNION ALL SELECT c.correlation_id, c.event_id, d.depth + 1 FROM chain c JOIN d ON c.correlation_id = d.correlation_id AND c.causation_id = d.event_id) SELECT * FROM d",
    "audited_partitions": "SELECT DISTINCT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders ORDER BY 1, 2, 3 LIMIT 25",
}
