"""Orders: rules, legal transitions, fills, and the life of an order folded from its events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decimals as dec

# Statuses, and which may follow which.
STATUSES = ("unknown", "pending_submit", "working", "partially_filled", "filled", "pending_cancel", "canceled", "pending_replace", "rejected", "expired")
FOLLOWS = {
    "pending_submit": ("working", "rejected"),
    "working": ("partially_filled", "filled", "pending_cancel", "pending_replace", "expired"),
    "partially_filled": ("filled", "pending_cancel", "pending_replace", "expired"),
    "pending_cancel": ("canceled", "working", "partially_filled", "filled"),
    "pending_replace": ("working", "partially_filled", "filled", "canceled"),
}
LIVE = ("working", "partially_filled", "pending_cancel", "pending_replace")
NEEDS_LIMIT, NEEDS_STOP = ("limit", "stop_limit"), ("stop", "stop_limit")
TYPES, SIDES = ("market", "limit", "stop", "stop_limit"), ("buy", "sell")
TIMES_IN_FORCE = ("day", "gtc", "ioc", "fok")


def can_follow(status: str, to: str) -> bool:
    return status in STATUSES and to in STATUSES and to != "unknown" and (status == to or to in FOLLOWS.get(status, ()))


def transitions(spark: SparkSession) -> DataFrame:
    """Legal pairs (from_status, to_status): a table of a few dozen rows, to be broadcast."""
    return spark.createDataFrame([(a, b) for a in STATUSES for b in STATUSES if can_follow(a, b)], "from_status string, to_status string")


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` (from_status, to_status, ...) that the graph of statuses doesn't allow."""
    return changes.join(F.broadcast(transitions(changes.sparkSession)), ["from_status", "to_status"], "left_anti")


def terms_error(prefix: str = "") -> Column:
    """The first rule about type, prices, quantity and grid that an order's terms break, or null. Columns: order_type, side, {prefix}quantity, {prefix}limit_price, {prefix}stop_price, tick_size, quantity_increment."""
    kind, limit, stop, quantity = F.col("order_type"), F.col(f"{prefix}limit_price"), F.col(f"{prefix}stop_price"), F.col(f"{prefix}quantity")
    no = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    return (
        F.when(no(F.col("side"), SIDES), "side").when(no(kind, TYPES), "type").when(kind.isin(*NEEDS_LIMIT) & limit.isNull(), "limit_missing").when(~kind.isin(*NEEDS_LIMIT) & limit.isNotNull(), "limit_unexpected")
        .when(kind.isin(*NEEDS_STOP) & stop.isNull(), "stop_missing").when(~kind.isin(*NEEDS_STOP) & stop.isNotNull(), "stop_unexpected").when(~F.coalesce(quantity > 0, F.lit(False)), "quantity")
        .when(~dec.on_grid(quantity, "quantity_increment"), "quantity_grid").when(limit.isNotNull() & ~dec.on_grid(limit, "tick_size"), "limit_grid").when(stop.isNotNull() & ~dec.on_grid(stop, "tick_size"), "stop_grid")
    )


def order_error() -> Column:
    """The first invariant that an order's state breaks, or null. Columns: status, accepted_quantity, filled_quantity, rejected (a rejection is there), pending_command, fill_ids, broker_fill_ids."""
    status, accepted, filled = F.col("status"), F.col("accepted_quantity"), F.col("filled_quantity")
    pending = status.isin("pending_cancel", "pending_replace")
    has_command = F.col("pending_command").isNotNull() & (F.col("pending_command") != "")
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    return (
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status").when(accepted <= 0, "accepted_quantity").when(accepted < filled, "overfilled").when(accepted.isNull() & (filled != 0), "filled_unaccepted")
        .when(accepted.isNull() & status.isin("working", "partially_filled", "filled", "pending_cancel", "canceled", "pending_replace", "expired"), "unaccepted").when(accepted.isNotNull() & status.isin("pending_submit", "rejected"), "accepted")
        .when((status == "rejected") != F.col("rejected"), "rejection").when(pending != has_command, "pending_command").when(repeated("fill_ids"), "fill_ids").when(repeated("broker_fill_ids"), "broker_fill_ids")
    )


def fill_error() -> Column:
    """The first rule that a fill breaks, or null."""
    unset = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return (
        F.when(unset("fill_id"), "fill_id").when(unset("order_id"), "order_id").when(unset("account_id"), "account_id").when(unset("instrument_id"), "listing").when(~F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), "side")
        .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity").when(~dec.on_grid("quantity", "quantity_increment"), "quantity_grid").when(~dec.on_grid("price", "tick_size"), "price_grid")
    )


def trade_error() -> Column:
    return (
        F.when(F.col("account_id").isNull(), "account_id").when(F.col("instrument_id").isNull(), "listing").when(~F.coalesce(F.col("side").isin("long", "short"), F.lit(False)), "side")
        .when(F.coalesce(F.size("entry_fill_ids"), F.lit(0)) <= 0, "entries").when(F.exists("entry_fill_ids", lambda x: x.isNull() | (x == "")), "entry_id").when(F.exists("exit_fill_ids", lambda x: x.isNull() | (x == "")), "exit_id")
        .when(F.col("opened_at").isNull(), "opened_at").when(F.col("closed_at") < F.col("opened_at"), "closed_at")
    )


def command_error() -> Column:
    """The first rule that a cancel or replace request (kind, order_id, event_id, new_quantity, new_limit_price, new_stop_price) breaks, or null."""
    empty = F.coalesce("new_quantity", "new_limit_price", "new_stop_price").isNull()
    unset = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return F.when(unset("order_id"), "order_id").when(unset("event_id"), "event_id").when((F.col("kind") == "replace_request") & empty, "nothing_to_replace").when((F.col("kind") == "replace_request") & (F.col("new_quantity") <= 0), "quantity")


def mismatched_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills with mismatch: the first identity (order, account, listing, side, broker_order) in which they differ from their order, or null."""
    columns = ("account_id", "instrument_id", "side", "broker_order_id")
    own = orders.select("order_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = fills.join(own, "order_id", "left")
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    mismatch = F.when(F.col("_found").isNull(), "order")
    for c, name in zip(columns[:3], ("account", "listing", "side"), strict=True):
        mismatch = mismatch.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), name)
    mismatch = mismatch.when(named("broker_order_id") & named("_broker_order_id") & (F.col("broker_order_id") != F.col("_broker_order_id")), "broker_order")
    return joined.select(*fills.columns, mismatch.alias("mismatch"))


def distinct_fills(fills: DataFrame) -> DataFrame:
    """Fills without repeats: of each order's fills with one broker_fill_id, then with one fill_id, the first by (ts, seq)."""
    by_broker = F.row_number().over(Window.partitionBy("order_id", "broker_fill_id").orderBy("ts", "seq"))
    once = fills.withColumn("_n", F.when(F.coalesce("broker_fill_id", F.lit("")) == "", 1).otherwise(by_broker)).where("_n = 1")
    by_own = F.row_number().over(Window.partitionBy("order_id", "fill_id").orderBy("ts", "seq"))
    return once.withColumn("_n", by_own).where("_n = 1").drop("_n")


def running_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Each fill with the order's filled quantity and status after it: partially_filled, filled, or overfilled."""
    w = Window.partitionBy("order_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = fills.join(orders.select("order_id", "accepted_quantity"), "order_id").withColumn("filled_after", F.sum("quantity").over(w))
    return joined.withColumn("status_after", _filled_status(F.col("filled_after"), F.col("accepted_quantity")))


def filled_orders(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Per accepted order: filled and remaining quantity and status from its distinct fills."""
    total = fills.groupBy("order_id").agg(F.sum("quantity").alias("_f"))
    joined = orders.join(total, "order_id", "left").withColumn("filled_quantity", F.coalesce("_f", F.lit(0)))
    status = F.when(F.col("filled_quantity") == 0, "working").otherwise(_filled_status(F.col("filled_quantity"), F.col("accepted_quantity")))
    return joined.select("order_id", "accepted_quantity", "filled_quantity", remaining(), status.alias("status"))


def remaining() -> Column:
    """Accepted less filled quantity; null where nothing was accepted."""
    return (F.col("accepted_quantity") - F.col("filled_quantity")).alias("remaining_quantity")


def _filled_status(filled: Column, accepted: Column) -> Column:
    return F.when(filled > accepted, "overfilled").when(filled == accepted, "filled").otherwise("partially_filled")


# The life of an order, folded from its events by a small piece of Python.

EVENT_COLUMNS = ("seq", "kind", "event_id", "causation_id", "status", "account_id", "instrument_id", "side", "quantity", "limit_price", "stop_price", "fill_id", "broker_fill_id", "broker_order_id", "rejected")
STATE_SCHEMA = "order_id string, status string, accepted_quantity long, filled_quantity long, limit_price long, stop_price long, pending_command string, broker_order_id string, applied long, refused long, last_refusal string"


@dataclass(slots=True)
class OrderState:
    """State of one order: ``apply`` takes an event and says why it was refused, or ''. A refused event changes nothing."""

    account_id: str = ""
    instrument_id: str = ""
    side: str = ""
    status: str = ""
    accepted: int | None = None
    filled: int = 0
    limit_price: int | None = None
    stop_price: int | None = None
    pending: str = ""
    broker_order_id: str = ""
    proposed: dict = field(default_factory=dict)
    fills: set = field(default_factory=set)
    broker_fills: set = field(default_factory=set)

    def apply(self, e: dict) -> str:
        if e["kind"] == "submit":
            if self.status:
                return "illegal"
            self.status, self.account_id, self.instrument_id, self.side = "pending_submit", e["account_id"], e["instrument_id"], e["side"]
            return ""
        if not self.status:
            return "no_order"
        handler = HANDLERS.get(e["kind"])
        return handler(self, e) if handler else "unknown_kind"

    def _accept(self, e: dict) -> str:
        if self.status != "pending_submit" or not e["quantity"] or e["quantity"] <= 0:
            return "illegal"
        self.status, self.accepted, self.limit_price, self.stop_price, self.broker_order_id = "working", e["quantity"], e["limit_price"], e["stop_price"], e["broker_order_id"] or ""
        return ""

    def _reject(self, e: dict) -> str:
        if self.status != "pending_submit":
            return "illegal"
        self.status = "rejected"
        return ""

    def _expire(self, e: dict) -> str:
        if self.status not in ("working", "partially_filled"):
            return "illegal"
        self.status = "expired"
        return ""

    def _request(self, e: dict, status: str) -> str:
        if not e["event_id"] or self.status not in ("working", "partially_filled"):
            return "illegal"
        self.status, self.pending = status, e["event_id"]
        return ""

    def _cancel_request(self, e: dict) -> str:
        return self._request(e, "pending_cancel")

    def _replace_request(self, e: dict) -> str:
        terms = {k: e[k] for k in ("quantity", "limit_price", "stop_price") if e[k] is not None}
        if not terms or terms.get("quantity", 1) <= 0:
            return "invalid"
        refusal = self._request(e, "pending_replace")
        if not refusal:
            self.proposed = terms
        return refusal

    def _result(self, e: dict, waiting: str) -> str:
        if self.pending and e["causation_id"] != self.pending:
            return "stale"
        if not can_follow(self.status, e["status"]):
            return "illegal"
        self.status = e["status"]
        if self.status != waiting:
            self.pending = ""
        return ""

    def _cancel_result(self, e: dict) -> str:
        return self._result(e, "pending_cancel")

    def _replace_result(self, e: dict) -> str:
        terms = self.proposed
        amended = not e["rejected"] and e["status"] in ("working", "partially_filled")
        if amended and terms.get("quantity", self.accepted or 0) < self.filled and (not self.pending or e["causation_id"] == self.pending):
            return "invalid"
        refusal = self._result(e, "pending_replace")
        if not refusal and amended:
            self.accepted, self.limit_price, self.stop_price = terms.get("quantity", self.accepted), terms.get("limit_price", self.limit_price), terms.get("stop_price", self.stop_price)
            self.proposed = {}
        return refusal

    def _fill(self, e: dict) -> str:
        if e["account_id"] != self.account_id or e["instrument_id"] != self.instrument_id or e["side"] != self.side:
            return "mismatch"
        if self.broker_order_id and (broker_order_id := e["broker_order_id"]) and broker_order_id != self.broker_order_id:
            return "mismatch"
        status, own, broker = self.status, e["fill_id"], e["broker_fill_id"]
        if status not in LIVE:
            return "illegal"
        if broker and broker in self.broker_fills or own in self.fills:
            return "duplicate"
        total = self.filled + e["quantity"]
        if self.accepted is None or total > self.accepted:
            return "overfill"
        self.filled = total
        if total == self.accepted:
            self.status, self.pending = "filled", ""
        elif status == "working" or status == "partially_filled":
            self.status, self.pending = "partially_filled", ""
        self.fills.add(own)
        if broker:
            self.broker_fills.add(broker)
        return ""


HANDLERS = {kind: getattr(OrderState, f"_{kind}") for kind in ("accept", "reject", "expire", "cancel_request", "replace_request", "cancel_result", "replace_result", "fill")}


def columns_of(pdf: pd.DataFrame) -> dict[str, list]:
    """Columns of ``sendable`` events with None for nulls and plain ints, in the order of the rows."""
    columns = {c: pdf[c].tolist() for c in EVENT_COLUMNS}
    for c in ("quantity", "limit_price", "stop_price"):
        columns[c] = [int(v) if isinstance(v, str) else None for v in columns[c]]
    return columns


def sendable(events: DataFrame, *more: str) -> DataFrame:
    """Events (and ``more`` columns) for Python: 64-bit columns with nulls travel as text, since pandas would make floats of them."""
    return events.select("order_id", *[F.col(c).cast("string").alias(c) if c in ("quantity", "limit_price", "stop_price") else F.col(c) for c in EVENT_COLUMNS], *more)


def result_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in STATE_SCHEMA.split(", ")])
    return out.astype({c: "Int64" for c in ("accepted_quantity", "limit_price", "stop_price")})


def result_row(order_id: str, state: OrderState, counts: list) -> tuple:
    return (order_id, state.status or None, state.accepted, state.filled, state.limit_price, state.stop_price, state.pending or None, state.broker_order_id or None, *counts)


def values_of(column: pa.Array) -> list:
    """A column's values, with None for nulls; 64-bit numbers beside nulls stay as they are."""
    if column.null_count == len(column):
        return [None] * len(column)
    if not column.null_count or not pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    there = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [v if here else None for v, here in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), there, strict=True)]


class Event:
    """The event at a place of a batch, by column: no dictionary is made of each."""

    __slots__ = ("at", "columns")

    def __init__(self, columns: dict[str, list]):
        self.columns = columns

    def __getitem__(self, name: str):
        return self.columns[name][self.at]


def fold(events: DataFrame) -> DataFrame:
    """The state of each order after all its ``events`` (order_id, ``EVENT_COLUMNS``) by seq, and how many were applied and refused (with the last refusal's reason).

    Events are dealt by order and sorted; a task goes through them once and holds one order's state, however many events it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_id, state, applied, refused, last, done = None, OrderState(), 0, 0, None, []
        for batch in batches:
            event = Event({c: values_of(batch.column(c)) for c in EVENT_COLUMNS})
            for at, own in enumerate(values_of(batch.column("order_id"))):
                event.at = at
                if own != order_id:
                    if order_id is not None:
                        done.append(result_row(order_id, state, [applied, refused, last]))
                    order_id, state, applied, refused, last = own, OrderState(), 0, 0, None
                if why := state.apply(event):
                    refused, last = refused + 1, why
                else:
                    applied += 1
            if done:
                yield _batch(done)
                done = []
        if order_id is not None:
            yield _batch([result_row(order_id, state, [applied, refused, last])])

    own = events.where(F.col("order_id").isNotNull()).select("order_id", *EVENT_COLUMNS)
    return own.repartition("order_id").sortWithinPartitions("order_id", "seq").mapInArrow(run, STATE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``STATE_SCHEMA``."""
    fields = [pa.field(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in STATE_SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
