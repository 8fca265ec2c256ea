"""The published store: Parquet bars and manifests by provider, interval, year, month and symbol.

Each publication of a month writes its bars as a generation of their own, beside those that are there; then its manifest row, which names the generation, replaces the one before. Readers meet bars only through manifests, so they never see bars of
one publication with the manifest of another, a month published without bars has none, and a publication that stopped before its manifests changed nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators import bars as ops
from ..operators import inventory, manifests
from .shared import settle

PARTITION = ["provider", "interval", "year", "month", "symbol"]
BARS = "time timestamp_ntz, open bigint, high bigint, low bigint, close bigint, avg_spread bigint, max_spread bigint, ticks bigint, provider string, interval string, year int, month int, symbol string"
MANIFESTS = (
    "instrument_id string, span_start timestamp_ntz, span_end timestamp_ntz, basis string, schema_version int, raw_fingerprint string, builder_version string, validator_version string, resampler_version string,"
    " calendar_version string, built_at timestamp_ntz, bar_count bigint, first_bar timestamp_ntz, last_bar timestamp_ntz, parent_instrument string, parent_interval string, parent_revision string, revision string,"
    " generation string, provider string, interval string, year int, month int, symbol string"
)
STORED_BARS = f"{BARS}, generation string"


def _write(df: DataFrame, path: str) -> None:
    """Replace the partitions (of a generation, where there is one in bars) that ``df`` has rows of."""
    by = [*PARTITION, "generation"] if "generation" in df.columns and "open" in df.columns else PARTITION
    df.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def new_generation() -> str:
    """Generations sort by the time at which their publication began."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table by explicit schema; empty where nothing was published yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def publish_errors(bars: DataFrame, held: DataFrame) -> DataFrame:
    """What keeps partitions from being published (partition keys, error), one row for each kind of error.

    In a manifest: that its span or instrument isn't that of the key it is filed under (key), or the first rule that it breaks. In the bars: a broken rule, a time outside the manifest's span
    (outside_span) or one that doesn't follow the one before (order). Between them: bars without manifest (manifest), or a count, first or last that isn't that of the bars.
    """
    of_manifest = held.select(*PARTITION, F.when(manifests.key_mismatch() | manifests.instrument_mismatch(), "key").otherwise(manifests.manifest_error()).alias("error"))
    spans = held.select(*PARTITION, "span_start", "span_end")
    of_bars = ops.set_violations(bars.join(spans, PARTITION), PARTITION, "time").select(*PARTITION, F.col("reason").alias("error"))
    between = manifests.against_bars(held, bars, PARTITION).select(*PARTITION, F.col("mismatch").alias("error"))
    alone = bars.select(*PARTITION).join(held.select(*PARTITION), PARTITION, "left_anti").withColumn("error", F.lit("manifest"))
    return of_manifest.unionByName(of_bars).unionByName(between).unionByName(alone).where("error IS NOT NULL").distinct()


def publish(bars: DataFrame, held: DataFrame, root: str) -> str:
    """Check, then replace the months that manifests ``held`` name by ``bars``, and return the generation. A month without bars becomes empty.

    Both are settled in the shared folder first, so that checking and writing don't compute them again.
    """
    generation = new_generation()
    bars, held = settle(bars.select(*_columns(BARS))), settle(held.select(*[c for c in _columns(MANIFESTS) if c != "generation"]))
    errors = publish_errors(bars, held).limit(20).collect()
    if errors:
        raise ValueError(f"not published: {errors}")
    write_generation(bars, generation, root)
    _write(held.withColumn("generation", F.lit(generation)), f"{root}/manifests")
    return generation


def write_generation(bars: DataFrame, generation: str, root: str) -> None:
    """The first step of a publication, which no reader sees."""
    _write(bars.withColumn("generation", F.lit(generation)), f"{root}/bars")


def load(spark: SparkSession, root: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, manifests) as published: of each month the generation that its manifest names. ``only``: the months to read (PARTITION); others are pruned."""
    held = read(spark, f"{root}/manifests", MANIFESTS)
    if only is not None:
        held = held.join(only.select(*PARTITION).distinct(), PARTITION, "left_semi")
    bars = read(spark, f"{root}/bars", STORED_BARS).join(held.select(*PARTITION, "generation"), [*PARTITION, "generation"], "left_semi").drop("generation")
    return bars, held


def verify(spark: SparkSession, root: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifests, errors): each stored month (of ``only``) that ``publish_errors`` finds fault with, or whose revision isn't that of its fields (revision)."""
    bars, held = load(spark, root, only)
    wrong = held.where(~F.col("revision").eqNullSafe(manifests.revision())).select(*PARTITION, F.lit("revision").alias("error"))
    return held, publish_errors(bars, held).unionByName(wrong)


def superseded(spark: SparkSession, root: str, before: str) -> DataFrame:
    """Files of bars (path) whose generation began before ``before`` and is named by no manifest: older publications and those that stopped. Files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/bars").select("path")
    parts = {c: F.regexp_extract("path", rf"/{c}=([^/]*)/", 1) for c in [*PARTITION, "generation"]}
    kinds = {c: v.cast("int") if c in ("year", "month") else v for c, v in parts.items()}
    named = read(spark, f"{root}/manifests", MANIFESTS).select(*PARTITION, "generation")
    return found.withColumns(kinds).where(F.col("generation") < before).join(named, [*PARTITION, "generation"], "left_anti").select("path")


def vacuum(spark: SparkSession, root: str, before: str) -> int:
    """Delete what is superseded, in the tasks; the number of files. Leave out publications that may still be at work: ``before`` is a generation, or a time as one begins with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                system, own = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1) if ":/" in path else f"file://{path}")
                if system.get_file_info(own).type == fs.FileType.File:
                    system.delete_file(own)
            yield pdf[["path"]]

    return settle(superseded(spark, root, before).mapInPandas(run, "path string")).count()


def write_raw(records: DataFrame, root: str, must_not_exist: bool = False) -> None:
    """Write records (provider, interval, year, month, symbol, time, ...) by partition, each in order of time."""
    if must_not_exist:
        try:
            there = records.sparkSession.read.parquet(root).select(*PARTITION).distinct()
        except AnalysisException:
            there = None
        if there is not None and not records.select(*PARTITION).distinct().join(there, PARTITION).isEmpty():
            raise FileExistsError(f"partitions exist under {root}")
    # Spark sorts by the partition columns again, and so drops the order of time, where it can't see that rows lie by them: where one is a constant or a text that may be null. A struct hides constants, and '' is the folder of null
    texts = [c for c, kind in records.dtypes if kind == "string" and c in PARTITION]
    keyed = records.select(F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in PARTITION]).alias("_p"), *[c for c in records.columns if c not in PARTITION])
    dealt = keyed.repartition("_p").select("_p.*", *keyed.columns[1:])
    dealt.sortWithinPartitions(*PARTITION, "time").write.partitionBy(*PARTITION).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def in_file(file: str, row: str) -> WindowSpec:
    """Rows of a written file, in the order in which they lie."""
    return Window.partitionBy(file).orderBy(row)


def upsert_raw(fetched: DataFrame, root: str) -> None:
    """Merge fetched records (with seq) into the stored partitions that they touch; fetched rows win, the last of several."""
    spark = fetched.sparkSession
    touched = fetched.select(*PARTITION).distinct()
    try:
        stored = spark.read.schema(fetched.schema).parquet(root).join(touched, PARTITION, "left_semi")
    except AnalysisException:
        stored = spark.createDataFrame([], fetched.schema)
    # the result is settled first, since a table can't be overwritten while it is read
    merged = settle(inventory.upsert(stored, fetched, [*PARTITION, "time"]), f"{root.rstrip('/')}-staged")
    write_raw(merged, root)


def write_texts(files: DataFrame, root: str) -> DataFrame:
    """Write each of ``files`` (name, text) under ``root`` by its name, from the tasks, and return the names. A task that runs again writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, own = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                system.create_dir(f"{own}/{name.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{own}/{name}") as sink:
                    sink.write(text.encode())
            yield pdf[["name"]]

    return files.select("name", "text").mapInPandas(run, "name string")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
