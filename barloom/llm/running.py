"""Running totals within keys of any size: rows are dealt by range, totalled within tasks, and carried from task to task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _starts(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, the place at which the run of each begins."""
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def running(rows: DataFrame, key: str, order: list[str], at: str, keep: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``keep`` (long columns) of ``rows``, with ``at``, their place within their key by ``order`` (from 1, nulls first), and with ``sums`` and ``xors`` among them turned into running totals up to and with each row.

    Rows are dealt by ranges of key and order, so a key of any size is spread over tasks, equal rows too. Each task totals its own rows; what the last key of a task holds is carried to the tasks after it: one row a task goes
    through the driver and is broadcast. Totals within tasks are settled before they are carried. Rows without key must have been left out.
    """
    totals, by = [at, *sums, *xors], [key, *order, "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(key, *keep)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last, held = TaskContext.get().partitionId(), None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            starts, goes_on = _starts(keys), keys == last
            out = {at: np.arange(len(keys)) - starts + 1}
            for c in sums:
                upto = np.cumsum(pdf[c].to_numpy())
                out[c] = upto - np.where(starts > 0, upto[starts - 1], 0)
            for c in xors:
                upto = np.bitwise_xor.accumulate(pdf[c].to_numpy())
                out[c] = upto ^ np.where(starts > 0, upto[starts - 1], 0)
            for c, before in held.items():
                out[c] = np.where(goes_on, out[c] ^ before if c in xors else out[c] + before, out[c])
            last, held = keys[-1], {c: out[c][-1] for c in totals}
            yield pdf.assign(**out, _task=np.int64(task))

    columns = [key, *keep, at]
    within = settle(dealt.mapInPandas(total, ", ".join(f"{c} long" for c in [*columns, "_task"])))
    # one row a task: its first key, and what its last key holds at its last row
    ends = within.groupBy("_task").agg(F.min(key).alias("first"), F.max(F.struct(key, *totals)).alias("last")).orderBy("_task").collect()
    carried, last, held = [], None, []
    for e in ends:
        own = [e["last"][c] for c in totals]
        if last == e["first"] and held:
            carried.append((e["_task"], e["first"], *held))
            if e["last"][key] == e["first"]:
                own = [a ^ b if c in xors else a + b for c, a, b in zip(totals, own, held, strict=True)]
        last, held = e["last"][key], own
    if not carried:
        return within.select(*columns)
    more = rows.sparkSession.createDataFrame(carried, ", ".join([f"{c} long" for c in ["_task", key, *[f"_c{i}" for i in range(len(totals))]]]))
    zero = [F.coalesce(F.col(f"_c{i}"), F.lit(0)) for i in range(len(totals))]
    upto = {c: F.col(c).bitwiseXOR(z) if c in xors else F.col(c) + z for c, z in zip(totals, zero, strict=True)}
    return within.join(F.broadcast(more), ["_task", key], "left").select(*[upto[c].alias(c) if c in upto else F.col(c) for c in columns])
