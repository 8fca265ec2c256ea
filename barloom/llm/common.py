"""What several operators of this folder share: table access, settled tables, scalable numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import settle, shared_dir

__all__ = ["join_spread", "number_within", "sample_by_hash", "settle", "shared_dir", "table", "text_or_empty"]

#: A key with more rows than this is dealt over several tasks of a join.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sample_by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About ``n`` rows of ``df`` (all, if there are no more), whose ``keys`` are unique: those whose hash lies below n's share of all.

    Rows are counted and filtered where they are, so nothing gathers in one task as a limit over many partitions would.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * n / total))


def join_spread(rows: DataFrame, found: DataFrame, key: str, counts: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the one row of ``found`` that has their ``key``; ``counts`` (key, n) tells how many rows each key has.

    Keys of more than ``hot`` rows are dealt over n / ``hot`` tasks. They are broadcast: at most one for ``hot`` rows.
    """
    parts = F.broadcast(counts.where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).alias("_parts")))
    dealt = rows.join(parts, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    each = found.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(each, [key, "_part"]).drop("_part")


def number_within(df: DataFrame, key: str, key_count: int, order: list[str], out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each value of ``key`` (an int from 0 to ``key_count`` - 1).

    A key with many rows is not sorted in one task: rows are dealt by a hash of ``order`` into finer parts, each
    part is numbered by itself, and starts from the number of rows in the parts before it. Only ``key_count`` x
    parts counts are broadcast.
    """
    parts = max(1, -(-df.count() // (key_count * rows_per_task)))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = (
        dealt.groupBy(key, "_part").count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy(key).orderBy("_part")) - F.col("count"))
        .select(key, "_part", "_before")
    )
    within = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(before), [key, "_part"])
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_row", "_before")
    )
