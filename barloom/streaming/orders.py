"""Order events as a stream: the same fold as in batch, with its state kept by Spark: maps of pages of orders, and of the fills of those that have very many."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from operator import attrgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.orders import EVENT_COLUMNS, STATE_SCHEMA, Event, OrderState, columns_of, result_row, result_rows, sendable, values_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("filled", "canceled", "rejected", "expired")
#: Orders share this many keys of state, so that a call of Python handles what many orders got.
BUCKETS = 1024
#: A key's orders lie in pages of about so many (twice that at most, as hashes deal them), each a value of its key's map: each value that is read or written is a message to the JVM and back.
PAGE = 128
#: Events of a task that are packed together before the shuffle, by bucket.
PACK_ROWS = 200_000
#: An order's value holds so many ids of its fills; more lie in a map, each by itself.
PACKED = 256
#: As in ``OrderState``.
OWN = ("account_id", "instrument_id", "side", "status", "accepted", "filled", "limit_price", "stop_price", "pending", "broker_order_id", "proposed")


class _Seen:
    """The ids of an order's fills: packed with the order as long as they are few, then each looked up and put by itself, however many there are."""

    def __init__(self, held, order_id: str, kind: str, packed: list, spilled: bool):
        self.held, self.own, self.packed, self.spilled = held, (order_id, kind), set(packed), spilled

    def __contains__(self, text: str) -> bool:
        return (text or "") in self.packed or self.spilled and self.held.containsKey((*self.own, text or ""))

    def add(self, text: str) -> None:
        self.packed.add(text or "")

    def pack(self) -> tuple[list, bool]:
        if len(self.packed) > PACKED:
            for text in self.packed:
                self.held.updateValue((*self.own, text), (True,))
            self.packed, self.spilled = set(), True
        return sorted(self.packed), self.spilled


_own = attrgetter(*OWN)


def page_of(order_id: str, pages: int) -> int:
    """The page of ``pages``, a power of two; when pages double, a page's orders go to it and to one new page."""
    return crc32(order_id.encode()) & (pages - 1)


class OrderProcessor(StatefulProcessor):
    """Folds the events of a bucket's orders by seq within each micro-batch. An order that has ended is dropped once the watermark is ``keep_ms`` beyond the event that ended it (never, without event time); what comes after that finds no order."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "pages int, orders long")
        self.pages = handle.getMapState("pages", "page int", "orders binary")
        self.fills = handle.getMapState("fills", "order_id string, kind string, id string", "seen boolean")
        self.due = handle.getMapState("due", "at long", "order_ids string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        order_ids, columns, times = _sorted(list(rows))
        event, by_page, done, due = Event(columns), {}, [], {}
        starts = [0, *(i for i in range(1, len(order_ids)) if order_ids[i] != order_ids[i - 1])]
        pages, orders = self._room(len(starts))
        for start, end in zip(starts, [*starts[1:], len(order_ids)], strict=True):
            by_page.setdefault(page_of(order_ids[start], pages), []).append((order_ids[start], start, end))
        for page, own in by_page.items():
            held = self._page(page)
            orders -= len(held)
            for order_id, start, end in own:
                state, (applied, refused, last), timed = self._load(order_id, held.get(order_id))
                for event.at in range(start, end):
                    if why := state.apply(event):
                        refused, last = refused + 1, why
                    else:
                        applied += 1
                if self.keep_ms is not None and state.status in ENDED and not timed:
                    due.setdefault(int(max(times[start:end]).timestamp() * 1000) + self.keep_ms, []).append(order_id)
                    timed = True
                counts = [applied, refused, last]
                held[order_id] = (_own(state), counts, timed, state.fills.pack(), state.broker_fills.pack())
                done.append(result_row(order_id, state, counts))
            orders += len(held)
            self._keep(page, held)
        self.size.update((pages, orders))
        for at, ids in due.items():
            known = json.loads(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), (json.dumps(known + ids),))
            self.handle.registerTimer(at)
        yield result_rows(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        pages, orders = self.size.get() or (1, 0)
        by_page, spilled = {}, set()
        for order_id in set(json.loads(self.due.getValue((at,))[0])) if self.due.containsKey((at,)) else ():
            by_page.setdefault(page_of(order_id, pages), []).append(order_id)
        for page, ended in by_page.items():
            held = self._page(page)
            orders -= len(held)
            for order_id in ended:
                *_, fills, broker_fills = held.pop(order_id, (None, ([], False), ([], False)))
                if fills[1] or broker_fills[1]:
                    spilled.add(order_id)
            orders += len(held)
            self._keep(page, held)
        if spilled:
            for own in [k for k in self.fills.keys() if k[0] in spilled]:
                self.fills.removeKey(tuple(own))
        self.size.update((pages, orders))
        self.due.removeKey((at,))
        return iter([])

    def _page(self, page: int) -> dict:
        """The orders of a page: what ``OWN`` names, counts, whether its end has a timer, ids of fills."""
        held = self.pages.getValue((page,))
        return pickle.loads(held[0]) if held else {}

    def _keep(self, page: int, held: dict) -> None:
        if held:
            self.pages.updateValue((page,), (pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        else:
            self.pages.removeKey((page,))

    def _room(self, touched: int) -> tuple[int, int]:
        """How many pages and orders there are, after pages are doubled if so many orders, which may be new, would crowd them."""
        pages, orders = self.size.get() or (1, 0)
        wanted = pages
        if orders + touched > 2 * PAGE * pages:
            while wanted * PAGE < orders + touched:
                wanted *= 2
        for page in range(pages if wanted > pages and orders else 0):
            parts = {page: {}}
            for order_id, state in self._page(page).items():
                parts.setdefault(page_of(order_id, wanted), {})[order_id] = state
            for to, held in parts.items():
                self._keep(to, held)
        return wanted, orders

    def _load(self, order_id: str, held: tuple | None) -> tuple[OrderState, list, bool]:
        own, counts, timed, fills, broker_fills = held or ((), [0, 0, None], False, ([], False), ([], False))
        return OrderState(*own, fills=_Seen(self.fills, order_id, "fill", *fills), broker_fills=_Seen(self.fills, order_id, "broker", *broker_fills)), counts, timed


def _sorted(rows: list[pd.DataFrame]) -> tuple[list[str], dict[str, list], list | None]:
    """Order ids, columns and times (if there are any) of a bucket's events by order and seq; they come packed, or each as a row."""
    if "packed" in rows[0].columns:
        events = pa.concat_tables(pa.ipc.open_stream(packed).read_all() for pdf in rows for packed in pdf["packed"])
        events = events.sort_by([("order_id", "ascending"), ("seq", "ascending")]).combine_chunks()
        columns = {c: values_of(events.column(c).combine_chunks()) for c in ("order_id", *EVENT_COLUMNS)}
        return columns.pop("order_id"), columns, None
    batch = pd.concat(rows).sort_values(["order_id", "seq"], kind="stable")
    return batch["order_id"].tolist(), columns_of(batch), batch["ts"].tolist() if "ts" in batch.columns else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events with their ``_bucket``, as a row per bucket and ``PACK_ROWS`` that holds an Arrow stream of its events: a row by itself costs Python more than what is then done with it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _by_bucket(held)
            held, n = [], 0
    if n:
        yield _by_bucket(held)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    events = pa.Table.from_batches(batches).sort_by("_bucket").combine_chunks()
    buckets = events.column("_bucket").to_numpy()
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    events, packed = events.drop_columns("_bucket"), []
    for start, end in zip(starts, [*starts[1:], len(buckets)], strict=True):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, events.schema) as writer:
            writer.write_table(events.slice(start, end - start))
        packed.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int64()), pa.array(packed, pa.binary())], names=["_bucket", "packed"])


def order_states(events: DataFrame, late: str = "1 day", keep_days: float = 30) -> DataFrame:
    """Stream of ``events`` (order_id and the columns of the batch fold, numbered by seq, and ts if they have times) to an updated row per order and micro-batch.

    Within a batch events are applied by seq. Only pages of orders that the batch has events of are read and written, each order with its last ``PACKED`` fills at most; of more, a fill looks its own ids up. With ts, a watermark ``late`` behind it drops an
    ended order ``keep_days`` after it ended: until then fills and results may be delivered again. Then events travel one by one, since Spark drops those that are late; otherwise packed. State variables need the RocksDB provider, which is set on the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = "ts" in events.columns
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(BUCKETS)).alias("_bucket")
    own = events.where("order_id IS NOT NULL")
    if timed:
        sent = sendable(own.withWatermark("ts", late), "ts").select("*", bucket)
    else:
        sent = own.select(bucket, "order_id", *EVENT_COLUMNS).mapInArrow(_packed, "_bucket long, packed binary")
    processor = OrderProcessor(round(keep_days * 86_400_000) if timed else None)
    return sent.groupBy("_bucket").transformWithStateInPandas(processor, STATE_SCHEMA, "Update", "EventTime" if timed else "None")


def once(fills: DataFrame, late: str = "1 day") -> DataFrame:
    """Stream of fills without repeats of a broker_fill_id within ``late`` of event time ``ts``."""
    return fills.withWatermark("ts", late).dropDuplicatesWithinWatermark(["broker_fill_id"])
