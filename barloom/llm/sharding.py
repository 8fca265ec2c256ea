"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing in levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_spread, number_within, settle, text_or_empty
from .differencing import combine, partition

GROUPS_PER_BLOCK = 20_000
FAN_IN = 1024


def assign_groups(groups: DataFrame, shards: int, per_block: int = GROUPS_PER_BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``groups`` (key, weight; keys unique) to (key, shard).

    Groups are dealt by key hash into blocks of about ``per_block``. Each block is differenced into a partial
    partition of ``shards`` subsets; then partial partitions are differenced with each other, ``fan_in`` at a time,
    until one is left. The driver only sees the last level: at most ``fan_in`` x ``shards`` sums.
    """
    blocks = max(1, -(-groups.count() // per_block))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        return pdf.assign(slot=partition(pdf["weight"].to_numpy(dtype=np.int64), shards).astype("int32"))

    placed = settle(
        groups.select("key", F.col("weight").cast("long").alias("weight"))
        .withColumn("node", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        .groupBy("node").applyInPandas(local, "key binary, weight long, node long, slot int")
    )

    def table_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.sort(pdf["node"].unique())
        sums = np.zeros((len(nodes), shards), dtype=np.int64)
        sums[np.searchsorted(nodes, pdf["node"]), pdf["slot"]] = pdf["weight"]
        return nodes, combine(sums)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, to = table_of(pdf)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "slot": np.tile(np.arange(shards, dtype="int32"), len(nodes)), "up": pdf["up"].iloc[0], "to": to.ravel().astype("int32")})

    while True:
        sums = placed.groupBy("node", "slot").agg(F.sum("weight").alias("weight"))
        if blocks <= fan_in:
            break
        blocks = -(-blocks // fan_in)
        up = sums.withColumn("up", F.pmod(F.col("node"), F.lit(blocks))).groupBy("up").applyInPandas(merge, "node long, slot int, up long, to int")
        placed = settle(placed.join(up, ["node", "slot"]).select("key", "weight", F.col("up").alias("node"), F.col("to").alias("slot")))
    top = sums.toPandas()
    nodes, to = table_of(top) if len(top) else (np.zeros(0, dtype=np.int64), np.zeros((0, shards), dtype=np.int64))
    rows = [(int(n), s, int(to[i, s])) for i, n in enumerate(nodes) for s in range(shards)]
    final = groups.sparkSession.createDataFrame(rows, "node long, slot int, shard int")
    return placed.join(F.broadcast(final), ["node", "slot"]).select("key", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = 16, per_block: int = GROUPS_PER_BLOCK, fan_in: int = FAN_IN, hot: int = HOT_ROWS) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard; equal texts stay together, bytes are near equal.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null). A null text has size 1 and
    goes with the empty ones. A null doc_id and repeated rows are rows like any other. Only doc_id, size, checksum and
    the text's SHA-256 are shuffled. A group of copies that is heavier than a shard's even share makes its shard
    that heavy, since it is indivisible; the others stay near equal. Very long texts count like any; other columns are left out. An empty table gives no rows.
    """
    text = text_or_empty()
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        )
    )
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    placed = join_spread(rows, assign_groups(groups.drop("n"), shards, per_block, fan_in), "key", groups.select("key", "n"), hot).drop("key")
    numbered = number_within(settle(placed), "shard", shards, ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
