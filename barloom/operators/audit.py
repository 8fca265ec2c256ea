"""Audits: chains of causation, and bounded samples of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

AUDITED_PARTITIONS = 25


def orphans(events: DataFrame) -> DataFrame:
    """Events (event_id, correlation_id, causation_id) that name a cause which isn't an event of their correlation."""
    causes = events.select("correlation_id", F.col("event_id").alias("causation_id"))
    return events.where(F.col("causation_id").isNotNull()).join(causes, ["correlation_id", "causation_id"], "left_anti")


def links(events: DataFrame) -> DataFrame:
    """Each event with the event that caused it, within one correlation."""
    cause = events.select("correlation_id", F.col("event_id").alias("causation_id"), F.col("ts").alias("cause_ts"))
    return events.join(cause, ["correlation_id", "causation_id"])


def depths(events: DataFrame, rounds: int = 64) -> DataFrame:
    """depth of each event below its chain's first (0). Chains double in length each round, so ``rounds`` is far beyond any; what a cycle holds has none,
    nor have orphans and what hangs below them: they are left out, as in a recursion from the first events down.

    Each round is one equi-join on (correlation, event), settled in the shared folder.
    """
    state = settle(events.select("correlation_id", "event_id", F.col("causation_id").alias("up"), F.when(F.col("causation_id").isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select("correlation_id", F.col("event_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.lit(True).alias("_is"))
        state = state.join(above, ["correlation_id", "up"], "left").where("up IS NULL OR _is").select("correlation_id", "event_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        state = settle(state)
    return state.where("up IS NULL").drop("up")


def sample_partitions(partitions: DataFrame, keys: list[str], n: int = AUDITED_PARTITIONS) -> DataFrame:
    """At most ``n`` partitions, the first by key."""
    return partitions.select(*keys).distinct().orderBy(*keys).limit(n)
