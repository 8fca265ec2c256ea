"""Queries on what is published, written or streamed: each writes below the shared folder, and returns what is read back or found wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import decimals as dec
from ..operators import bars as ops
from ..operators import coverage as cov
from ..operators.orders import STATE_SCHEMA
from ..plans import planner, update
from ..sources import canonical, raw, store
from ..sources.shared import fresh_dir, settle
from ..streaming import orders as stream_orders
from ..streaming import records as stream_records
from . import orders as order_queries
from .common import BAR_COLUMNS, TICKS, as_string, as_text, bars_sql, bucket_ticks, bucket_ticks_sql, day_at, resample_sql, session_date, table, ticks, units, wide_units

BUCKETS = 4
BUILT = "2024-03-01 00:00:00"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _months(bars: DataFrame, interval: str) -> DataFrame:
    return bars.select(F.lit("oanda").alias("provider"), F.lit(interval).alias("interval"), F.year("time").alias("year"), F.month("time").alias("month"), "*")


def _bucket() -> Column:
    return F.substring("symbol", 6, 1)


def _held(bars: DataFrame) -> DataFrame:
    """Manifests of ``bars`` by month."""
    prints = bars.select(*store.PARTITION).distinct().withColumn("raw_fingerprint", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "symbol", "year", "month"), 256)))
    return update.with_manifest(bars, prints, _at(BUILT))


def publish_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps months of hourly bars from being published. By bucket of users: a manifest of another month's span, a bar twice, the last bar moved out of the month."""
    bars = settle(_months(ops.from_ticks(bucket_ticks(spark, sf_dir, BUCKETS), ["symbol"], "h1"), "h1"))
    held = settle(_held(bars))
    ends = held.select(*store.PARTITION, "first_bar", "last_bar")
    changed = bars.join(ends, store.PARTITION)
    twice = changed.where((_bucket() == "2") & (F.col("time") == F.col("first_bar")))
    moved = (_bucket() == "3") & (F.col("time") == F.col("last_bar"))
    changed = changed.unionByName(twice).withColumn("time", F.when(moved, F.col("time") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("time"))).select(*bars.columns)
    later = lambda c: F.when(_bucket() == "1", F.add_months(c, 3).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
    shifted = held.select(*[later(c) if c in ("span_start", "span_end") else F.col(c) for c in held.columns])
    return store.publish_errors(changed, shifted).select("symbol", "year", "month", "error")


def stored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of hourly bars published, then changed in the store: revisions of bucket 1, a bar taken out of bucket 2, a low above the high in bucket 3. What verification finds."""
    bars = settle(_months(ops.from_ticks(bucket_ticks(spark, sf_dir, BUCKETS), ["symbol"], "h1"), "h1"))
    held = settle(_held(bars))
    root = fresh_dir(spark)
    generation = store.publish(bars, held, root)
    store._write(held.where(_bucket() == "1").withColumns({"revision": F.lit("00"), "generation": F.lit(generation)}).select(*store._columns(store.MANIFESTS)), f"{root}/manifests")
    ends = held.select(*store.PARTITION, "first_bar")
    broken = bars.join(ends, store.PARTITION).where(_bucket().isin("2", "3")).where((_bucket() != "2") | (F.col("time") != F.col("first_bar")))
    broken = broken.withColumn("low", F.when((_bucket() == "3") & (F.col("time") == F.col("first_bar")), F.col("high") + 1).otherwise(F.col("low"))).drop("first_bar")
    store.write_generation(broken.select(*store._columns(store.BARS)), generation, root)
    return store.verify(spark, root)[1].select("symbol", "year", "month", "error")


def bar_set_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as sets of a symbol, with positions that put every 7th hour two places back, and a span that ends on the 20th: what each bar breaks."""
    bars = ops.from_ticks(bucket_ticks(spark, sf_dir, BUCKETS), ["symbol"], "h1")
    month = F.trunc("time", "month").cast("timestamp_ntz")
    hour = cal.seconds_between(F.col("time"), _at("2000-01-01 00:00:00")).cast("bigint") / 3600
    sets = bars.withColumns({"span_start": month, "span_end": month + F.expr("INTERVAL 20 DAYS"), "pos": (hour + F.when(F.hour("time") % 7 == 0, 2.5).otherwise(0)).cast("double")})
    return as_text(ops.set_violations(sets, ["symbol"]).where("reason IS NOT NULL").select("symbol", "time", "reason"), "time")


def money_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences and comparisons of amounts in the same, in two, and in no currency. Customers' amounts go beyond 64 bits: such a size is null."""
    k = F.col("o_orderkey")
    a = dec.money((wide_units("o_totalprice", 2) * F.when(k % 3 == 0, 90_000).otherwise(1)), F.when(k % 11 == 0, "eur").otherwise("EUR"))
    b = dec.money(F.col("o_custkey").cast("decimal(38,0)") * dec.SCALE * 50_000_000, F.when(k % 4 == 0, "USD").otherwise("EUR"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "o_orderkey", dec.money_add(a, b)["amount"].alias("total"), dec.money_add(a, b, -1)["amount"].alias("difference"), dec.money_compare(a, b).alias("compared"),
        dec.money_negate(a)["amount"].alias("negated"), dec.money_absolute(dec.money_negate(b))["amount"].alias("size"), dec.money_error(a, b).alias("error"),
    )


def range_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's ship dates lie in the 60 days from its date, whether these have passed, and how long they are."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 61).cast("int"), F.lit(0), F.lit(0), F.lit(30.0))).alias("e"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("t"))
    s, e = F.col("s"), F.col("e")
    return orders.join(items, "o_orderkey").select("o_orderkey", cal.contains(F.col("t"), s, e).alias("held"), cal.elapsed(e, _at("1997-06-01 00:00:00")).alias("passed"), cal.duration(s, e).cast("bigint").alias("seconds"))


def week_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with or without a bar, by type and bucket of users; bars whose ticks divide by three aren't stored."""
    ticks = bucket_ticks(spark, sf_dir, 40)
    bars = ops.from_ticks(ticks, ["symbol"], "w1")
    span = bars.groupBy("symbol").agg(F.min("time").alias("start_ts"), F.date_add(F.max("time"), 15).cast("timestamp_ntz").alias("end_ts"))
    present = bars.where("ticks % 3 > 0")
    states = cov.week_states(cov.month_spans(span, ["symbol"]), present.select("symbol", "time"), ["symbol"], _at("2024-02-01 00:00:00"))
    return as_text(states, "bar_start", "bar_end")


def raw_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as raw partitions, whose second writing is refused; per partition what is read back, and whether its rows lie in order of time."""
    ticks = bucket_ticks(spark, sf_dir, BUCKETS).select("symbol", F.lit("oanda").alias("provider"), F.lit("m1").alias("interval"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.col("ts").alias("time"), "price", "seq")
    root = fresh_dir(spark)
    store.write_raw(ticks, root, must_not_exist=True)
    try:
        store.write_raw(ticks, root, must_not_exist=True)
        refused = False
    except FileExistsError:
        refused = True
    read = spark.read.schema(ticks.schema).parquet(root).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("time").over(store.in_file("file", "at"))
    found = read.withColumn("late", F.col("time") < before).groupBy("symbol", "year", "month").agg(F.count("*").alias("row_count"), F.count_if("late").alias("out_of_order"), F.count_distinct("file").alias("files"))
    return found.withColumn("refused", F.lit(refused))


def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as candles of the earlier format, some lines broken by rule, and read back."""
    bars = ops.from_ticks(bucket_ticks(spark, sf_dir, BUCKETS), ["symbol"], "d1")
    at = cal.seconds_between(F.col("time"), _at("1970-01-01 00:00:00")).cast("bigint").cast("string")
    prices = [F.floor(F.col(c) / 1000).cast("bigint").cast("string") for c in ("open", "high", "low", "close")]
    line = F.concat_ws(",", at, *prices, F.lit("1"), F.lit("2"), F.col("ticks").cast("string"), F.col("symbol"))
    text = F.when(F.col("ticks") % 7 == 0, F.concat(F.lit("# "), line)).when(F.col("ticks") % 7 == 1, F.lit("Timestamp,Open,High,Low,Close,avgspread,maxspread,ticks,flags")).when(F.col("ticks") % 7 == 2, F.lit("x,y")).otherwise(line)
    path = fresh_dir(spark)
    bars.select(text.alias("value")).write.text(path)
    return as_text(raw.legacy_candles(spark, path), "time")


def weekly_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars published, weeks derived from them where all days of a week are there, and read back."""
    ticks = bucket_ticks(spark, sf_dir, BUCKETS).where(F.dayofweek(cal.session_date(F.col("ts"))) < 6)
    bars = settle(_months(ops.from_ticks(ticks, ["symbol"], "d1"), "d1"))
    # every 9th day is taken out, another one for each symbol
    bars = bars.where((F.dayofyear("time") + F.ascii("symbol") + F.ascii(_bucket())) % 9 != 0)
    root = fresh_dir(spark)
    store.publish(bars, _held(bars), root)
    update.derive_weeks(spark, root, _at(BUILT))
    return as_text(store.load(spark, root)[0].where("interval = 'w1'").select("symbol", "time", *BAR_COLUMNS.split(", ")), "time")


#: Pairs that stand in for the types of events.
PAIRS = {"click": "EURUSD", "error": "GBPUSD", "purchase": "USDJPY", "signup": "AUDUSD", "view": "USDCAD"}


def _raw_files(bars: DataFrame, complete: Column | None = None) -> DataFrame:
    """(name, text) of the raw daily files that hold ``bars``, by pair and month: a file has a line a day, however many ticks there are."""
    side = lambda add: [dec.text_of(F.col(c) + add) for c in ("open", "high", "low", "close")]
    line = F.concat_ws(",", F.concat(F.regexp_replace(F.col("time").cast("string"), " ", "T"), F.lit("Z")), *side(F.lit(0)), *side(F.col("avg_spread")), F.col("ticks").cast("string"), F.lit("true") if complete is None else complete.cast("string"))
    rows = bars.select("symbol", F.date_format("time", "yyyy").alias("y"), F.date_format("time", "MM").alias("m"), F.struct("time", line.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    name = F.concat_ws("/", "symbol", "y", "m", F.concat(F.concat_ws("-", "symbol", "y", "m", F.lit("d1")), F.lit(".csv")))
    return rows.groupBy("symbol", "y", "m").agg(body.alias("body")).select(name.alias("name"), F.concat_ws("\n", F.lit(raw.HEADER), "body").alias("text"))


def _archived(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(folder of raw daily files by pair and month, their bars)."""
    pair = F.coalesce(*[F.when(F.col("symbol") == k, F.lit(v)) for k, v in PAIRS.items()])
    bars = settle(ops.from_ticks(ticks(spark, sf_dir).withColumn("symbol", pair), ["symbol"], "d1"))
    root = fresh_dir(spark)
    settle(store.write_texts(_raw_files(bars), root))
    return root, bars


def update_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily files, planned, built, derived and planned again: what there was to do, and what is left of it (nothing)."""
    archive, bars = _archived(spark, sf_dir)
    requests = bars.groupBy(F.lit("oanda").alias("provider"), "symbol", F.lit("d1").alias("interval")).agg(F.min("time").alias("from_ts"), F.max(cal.bar_end(F.col("time"), "day")).alias("to_ts"))
    done = update.run(spark, archive, fresh_dir(spark), settle(requests), _at(BUILT))
    columns = ["symbol", "interval", "year", "month", "kind", "reason"]
    left = done.left.where("runnable").select(F.lit("second").alias("plan"), *columns)
    return done.actions.select(F.lit("first").alias("plan"), *columns).unionByName(left)


def exported_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raw daily files need that were never built, as texts of JSON, written and read back."""
    archive, bars = _archived(spark, sf_dir)
    asked = bars.groupBy(F.lit("oanda").alias("provider"), "symbol", F.lit("d1").alias("interval")).agg(F.min("time").alias("from_ts"), F.max(cal.bar_end(F.col("time"), "day")).alias("to_ts"))
    out = fresh_dir(spark)
    months = settle(update._of_requests(asked))
    seen = update.Snapshot.of(spark, archive, f"{out}/store", months)
    store.export_json(planner.staged(update.raw_actions(months, _at(BUILT), seen)), f"{out}/plan")
    return spark.read.text(f"{out}/plan")


#: The days of events are put so many times as far apart, which makes a month of them several.
STRETCH = 4


def _stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of two pairs over several months, without sessions of the weekend."""
    base = _at("2024-01-01 00:00:00")
    seconds = cal.seconds_between(F.col("ts"), base) * STRETCH
    ticks_ = ticks(spark, sf_dir).withColumn("ts", cal.plus_seconds(base, seconds)).where(F.dayofweek(cal.session_date(F.col("ts"))) < 6)
    bars = ops.from_ticks(ticks_.drop("symbol"), [], "d1")
    # both pairs have the same bars
    return settle(bars.select(F.explode(F.array(F.lit("EURUSD"), F.lit("USDJPY"))).alias("symbol"), *bars.columns))


def update_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three updates of daily and weekly bars over raw files: at first, with nothing changed, and after the volume of one day changed: the first session of March, in one pair. Of each run what was executed, which months were written anew, and which
    raw files were read to plan it."""
    bars = _stretched(spark, sf_dir)
    archive, out = fresh_dir(spark), fresh_dir(spark)
    settle(store.write_texts(_raw_files(bars), archive))
    span = bars.groupBy("symbol").agg(F.min("time").alias("from_ts"), F.max(cal.bar_end(F.col("time"), "day")).alias("to_ts"))
    requests = settle(span.select(F.lit("oanda").alias("provider"), "symbol", F.explode(F.array(F.lit("d1"), F.lit("w1"))).alias("interval"), "from_ts", "to_ts"))
    march = (F.col("symbol") == "EURUSD") & (F.year("time") == 2024) & (F.month("time") == 3)
    first_day = bars.where(march).agg(F.min("time").alias("_first"))
    changed = bars.where(march).join(F.broadcast(first_day)).withColumn("ticks", F.col("ticks") + F.when(F.col("time") == F.col("_first"), 1).otherwise(0)).drop("_first")
    found, before, columns = None, None, ["symbol", "interval", "year", "month"]
    for number in (1, 2, 3):
        if number == 3:
            settle(store.write_texts(_raw_files(changed), archive))
        done = update.run(spark, archive, out, requests, _at("2024-06-01 00:00:00"))
        held = settle(store.load(spark, out)[1].select(*columns, "generation"))
        written = held if before is None else held.join(before, [*columns, "generation"], "left_anti")
        read = done.read.withColumns(raw.file_fields(F.col("path"))).select(*columns, F.lit("read").alias("what"), F.lit("").alias("reason"))
        ran = done.executed.select(*columns, F.col("kind").alias("what"), "reason")
        one = ran.unionByName(written.select(*columns, F.lit("written").alias("what"), F.lit("").alias("reason"))).unionByName(read).withColumn("run", F.lit(number))
        one = one.unionByName(done.left.where("runnable").select(*columns, F.lit("left").alias("what"), "reason").withColumn("run", F.lit(number)))
        found, before = one if found is None else found.unionByName(one), held
    return found.select("run", "what", *columns, "reason")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of daily and weekly bars built from raw files that lack the 15th, and in one pair end each month with a provisional row. Then one file changes (March), another does and is built again (April), and one manifest is spoiled (January
    of the other pair): status of each month asked for, and the gaps of those that are current."""
    bars = _stretched(spark, sf_dir).where(F.dayofmonth(cal.session_date(F.col("time"))) != 15)
    last = bars.groupBy("symbol", F.year("time").alias("year"), F.month("time").alias("month")).agg(F.max("time").alias("_last"))
    marked = settle(bars.withColumns({"year": F.year("time"), "month": F.month("time")}).join(last, ["symbol", "year", "month"]))
    complete = (F.col("symbol") != "USDJPY") | (F.col("time") < F.col("_last"))
    archive, out, now = fresh_dir(spark), fresh_dir(spark), _at("2024-06-01 00:00:00")
    settle(store.write_texts(_raw_files(marked, complete), archive))
    update.normalise_archive(spark, archive, out, now)
    update.derive_weeks(spark, out, now, archive=archive)
    changed = marked.where("symbol = 'EURUSD' AND year = 2024 AND month IN (3, 4)").withColumn("ticks", F.col("ticks") + 1)
    settle(store.write_texts(_raw_files(changed, complete), archive))
    april = raw.listing(spark, archive).where("symbol = 'EURUSD' AND year = 2024 AND month = 4")
    update.normalise_archive(spark, archive, out, now, april)
    spoiled = store.load(spark, out)[1].where("symbol = 'USDJPY' AND interval = 'd1' AND year = 2024 AND month = 1").withColumn("revision", F.lit("00"))
    store._write(settle(spoiled), f"{out}/manifests")
    span = bars.groupBy("symbol").agg(F.min("time").alias("from_ts"), (F.max(cal.bar_end(F.col("time"), "day")) + F.expr("INTERVAL 40 DAYS")).alias("to_ts"))
    requests = span.select(F.lit("oanda").alias("provider"), "symbol", F.explode(F.array(F.lit("d1"), F.lit("w1"))).alias("interval"), "from_ts", "to_ts")
    partitions, gaps = update.coverage(spark, archive, out, requests, now)
    zero = F.lit(0).cast("bigint")
    status = partitions.select("symbol", "interval", "year", "month", "status", "incomplete_rows", F.lit("").alias("gap_start"), F.lit("").alias("gap_end"), zero.alias("bars"))
    return status.unionByName(as_text(gaps.select("symbol", "interval", "year", "month", F.col("state").alias("status"), zero.alias("incomplete_rows"), "gap_start", "gap_end", "bars"), "gap_start", "gap_end"))


#: What is wrong with the canonical files of a month.
DEFECTS = {2: "comment", 3: "manifest", 4: "revision", 5: "header", 6: "price", 7: "count", 8: "instrument"}


def canonical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a year as canonical text files by pair and month, spoiled by month in one way each, read back with proof: of each file its error and the bars that were loaded."""
    pair = F.coalesce(*[F.when(F.col("symbol") == k, F.lit(v)) for k, v in PAIRS.items()])
    base = _at("2024-01-01 00:00:00")
    spread = ticks(spark, sf_dir).withColumns({"symbol": pair, "ts": cal.plus_seconds(base, cal.seconds_between(F.col("ts"), base) * 11)})
    bars = settle(_months(ops.from_ticks(spread, ["symbol"], "d1"), "d1"))
    files = canonical.as_files(bars, _held(bars))
    month, text = F.split("name", "/")[3].cast("int"), F.col("text")
    spoiled = {
        "comment": F.regexp_replace(text, " year=2024 ", " year=2023 "), "manifest": F.regexp_replace(text, '"built_at":"', '"built_at":"x'), "revision": F.regexp_replace(text, '"builder_version":"1"', '"builder_version":"2"'),
        "header": F.replace(text, F.lit("max_spread,ticks"), F.lit("max_spread,volume")), "price": F.regexp_replace(text, r"(?s)^((?:[^\n]*\n){3}[^,]*),[^,]*,", "$1,1e5,"), "count": F.regexp_replace(text, r"[^\n]*\n$", ""),
        "instrument": F.regexp_replace(text, '"instrument":"fx:...', '"instrument":"fx:XXX'),
    }
    changed = F.coalesce(*[F.when(month == m, spoiled[e]) for m, e in DEFECTS.items()], text)
    root = fresh_dir(spark)
    settle(store.write_texts(files.select("name", changed.alias("text")), root))
    good, held, errors = canonical.load_folder(spark, root)
    loaded = held.select(*store.PARTITION).join(good.groupBy(*store.PARTITION).agg(F.count("*").alias("bars"), F.sum("close").alias("closes")), store.PARTITION, "left").withColumn("error", F.lit(""))
    zero = F.lit(0).cast("bigint")
    found = loaded.unionByName(errors.select(*store.PARTITION, zero.alias("bars"), zero.alias("closes"), "error"))
    return found.select("symbol", "year", "month", "bars", "closes", "error")


def streamed_fills_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a finite stream of fills, of which each order's first to arrive counts."""
    path = f"{sf_dir}/lineitem.parque[t]"  # as a pattern: a stream takes a folder or a pattern, not a file
    fills = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select(F.col("l_orderkey").cast("string").alias("broker_fill_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    out = fresh_dir(spark)
    query = stream_orders.once(fills, "4000 days").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("broker_fill_id string, ts timestamp").parquet(f"{out}/rows").groupBy("broker_fill_id").agg(F.count("*").alias("times"))


def streamed_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' events as a stream of several micro-batches, in the order of their numbers; of each order its last state."""
    out = fresh_dir(spark)
    # events are written once, those of each micro-batch into a folder of its own; the first is there even if there are no events
    events = order_queries._events(spark, sf_dir)
    arrival = F.when(F.col("seq") < 2, 0).when(F.col("seq") < 4, 1).when(F.col("seq") < 9, 2).otherwise(3).alias("arrival")
    events.where(F.lit(False)).write.parquet(f"{out}/events/arrival=0")
    events.select("*", arrival).write.mode("append").partitionBy("arrival").parquet(f"{out}/events")
    keep = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), 2 * spark.sparkContext.defaultParallelism))  # each opens its state anew in every micro-batch
    try:
        for last in range(4):  # the stream is stopped after each and goes on from its checkpoint
            states = stream_orders.order_states(spark.readStream.schema(events.schema).parquet(f"{out}/events/arrival=[0-{last}]"))
            states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = spark.read.schema(f"{STATE_SCHEMA}, batch int").option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    columns = ["status", "accepted_quantity", "filled_quantity", F.coalesce("pending_command", F.lit("")).alias("pending_command"), "applied", "refused"]
    return rows.groupBy("order_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("order_id", "s.*")


def streamed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks stored as raw partitions, some provisional; the same times fetched again as a stream, at another price, replace these."""
    ticks = bucket_ticks(spark, sf_dir, BUCKETS).select(F.lit("oanda").alias("provider"), F.lit("m1").alias("interval"), F.year("ts").alias("year"), F.month("ts").alias("month"), "symbol", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("time"), "seq", "price")
    once = settle(ticks.groupBy("provider", "interval", "year", "month", "symbol", "time").agg(F.max("seq").alias("seq"), F.max("price").alias("price")))
    root, work = fresh_dir(spark), fresh_dir(spark)
    store.write_raw(once.where("seq % 5 <> 1"), root)
    once.where("seq % 5 < 2").withColumn("price", F.col("price") + 7).write.parquet(f"{work}/fetched")
    fetched = spark.readStream.schema(once.schema).parquet(f"{work}/fetched")
    stream_records.refresh(fetched, root, f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return as_text(spark.read.schema(once.schema).parquet(root).select("symbol", "time", "seq", "price"), "time")


QUERIES = {
    "publish_errors": publish_errors, "stored_errors": stored_errors, "bar_set_errors": bar_set_errors, "money_arithmetic": money_arithmetic, "range_algebra": range_algebra, "week_states": week_states,
    "raw_written": raw_written, "legacy_rows": legacy_rows, "weekly_derived": weekly_derived, "update_actions": update_actions, "update_runs": update_runs, "streamed_fills_once": streamed_fills_once, "streamed_refresh": streamed_refresh, "streamed_lifecycle": streamed_lifecycle, "canonical_files": canonical_files, "coverage_report": coverage_report, "exported_plan": exported_plan,
}

_TICKS = f"ticks AS ({bucket_ticks_sql(BUCKETS)})"
_MONTH = "CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month"
_STORED = f"WITH {_TICKS}, bars AS ({bars_sql('h1')}), held AS (SELECT symbol, substr(symbol, 6, 1) AS bucket, {_MONTH}, count(*) AS n FROM bars GROUP BY ALL)"
_U = lambda c, p: f"(CAST(floor({c} * {10**p} + 0.5) AS BIGINT) * {10 ** (8 - p)})"
_FIT = lambda x: f"CASE WHEN ({x}) BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(({x}) AS BIGINT) END"
_FIRST = lambda c: f"ascii(substr({c}, 1, 1))"

ORACLES = {
    "publish_errors": f"""{_STORED} SELECT symbol, year, month, unnest(CASE bucket WHEN '1' THEN ['key', 'outside_span'] WHEN '2' THEN ['order', 'count'] WHEN '3' THEN ['outside_span', CASE WHEN n = 1 THEN 'first' ELSE 'last' END] ELSE [] END) AS error FROM held""",
    "stored_errors": f"""{_STORED} SELECT symbol, year, month, CASE bucket WHEN '1' THEN 'revision' WHEN '2' THEN 'count' ELSE 'high_below_low' END AS error FROM held WHERE bucket <> '0'""",
    "bar_set_errors": f"""WITH {_TICKS}, b AS ({bars_sql('h1')}), p AS (SELECT *, epoch(time) / 3600 + CASE WHEN hour(time) % 7 = 0 THEN 2.5 ELSE 0 END AS pos FROM b), l AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM p)
SELECT symbol, {as_string('time')} AS time, reason FROM (SELECT symbol, time, CASE WHEN high < low THEN 'high_below_low' WHEN open < low OR open > high THEN 'open_outside' WHEN close < low OR close > high THEN 'close_outside' WHEN avg_spread > max_spread THEN 'spread'
  WHEN time >= date_trunc('month', time) + INTERVAL 20 DAY THEN 'outside_span' WHEN time <= before THEN 'order' END AS reason FROM l) WHERE reason IS NOT NULL""",
    "money_arithmetic": f"""WITH r AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AS a_ok, o_orderkey % 4 <> 0 AS same, CAST({_U('o_totalprice', 2)} AS HUGEINT) * CASE WHEN o_orderkey % 3 = 0 THEN 90000 ELSE 1 END AS a, CAST(o_custkey AS HUGEINT) * 100000000 * 50000000 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a_ok AND same THEN {_FIT('a + b')} END AS total, CASE WHEN a_ok AND same THEN {_FIT('a - b')} END AS difference, CASE WHEN a_ok AND same THEN CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END END AS compared,
  CASE WHEN a_ok THEN CAST(-a AS BIGINT) END AS negated, CAST(b AS BIGINT) AS size, CASE WHEN NOT a_ok THEN 'missing' WHEN NOT same THEN 'mismatch' WHEN {_FIT('a + b')} IS NULL THEN 'range' END AS error FROM r""",
    "range_algebra": """WITH i AS (SELECT l_orderkey, min(l_shipdate) AS t FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + to_days(CAST(o_custkey % 61 AS INTEGER)) + INTERVAL 30 SECOND AS e, t FROM orders JOIN i ON l_orderkey = o_orderkey)
SELECT o_orderkey, t >= s AND t < e AS held, TIMESTAMP '1997-06-01 00:00:00' >= e AS passed, CAST(epoch(e) - epoch(s) AS BIGINT) AS seconds FROM r""",
    "week_states": f"""WITH ticks AS ({bucket_ticks_sql(40)}), bars AS ({bars_sql('w1')}), span AS (SELECT symbol, min(time) AS lo, CAST(CAST(max(time) AS DATE) + 15 AS TIMESTAMP) AS hi FROM bars GROUP BY symbol),
days AS (SELECT symbol, lo, hi, CAST(unnest(generate_series(CAST(lo AS DATE) - 8, CAST(hi AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS d FROM span), weeks AS (SELECT symbol, lo, hi, {day_at('d')} AS s, {day_at('(d + 7)')} AS e FROM days WHERE dayofweek(d) = 0)
SELECT w.symbol, CAST(year(s) AS INTEGER) AS year, CAST(month(s) AS INTEGER) AS month, {as_string('s')} AS bar_start, {as_string('e')} AS bar_end, CASE WHEN e > TIMESTAMP '2024-02-01 00:00:00' THEN 'in_progress' WHEN b.time IS NOT NULL THEN 'present' ELSE 'missing' END AS state
FROM weeks w LEFT JOIN (SELECT * FROM bars WHERE ticks % 3 > 0) b ON b.symbol = w.symbol AND b.time = w.s WHERE s >= lo AND s < hi""",
    "raw_written": f"WITH {_TICKS} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS row_count, CAST(0 AS BIGINT) AS out_of_order, CAST(1 AS BIGINT) AS files, true AS refused FROM ticks GROUP BY ALL",
    "legacy_rows": f"""WITH {_TICKS}, b AS ({bars_sql('d1')}) SELECT {as_string('time')} AS time, open // 1000 * 1000 AS open, high // 1000 * 1000 AS high, low // 1000 * 1000 AS low, close // 1000 * 1000 AS close, ticks FROM b WHERE ticks % 7 > 2""",
    "weekly_derived": f"""WITH all_ticks AS ({bucket_ticks_sql(BUCKETS)}), ticks AS (SELECT * FROM all_ticks WHERE dayofweek({session_date('ts')}) NOT IN (5, 6)), d0 AS ({bars_sql('d1')}),
fine AS (SELECT * FROM d0 WHERE (dayofyear(time) + {_FIRST('symbol')} + {_FIRST('substr(symbol, 6, 1)')}) % 9 <> 0), weekly AS ({resample_sql('w1', 'fine')}),
days AS (SELECT symbol, time, {session_date('time')} AS d FROM fine), held AS (SELECT DISTINCT symbol, date_trunc('month', time) AS m FROM fine),
whole AS (SELECT symbol, d - CAST(dayofweek(d) AS INTEGER) AS sunday FROM days GROUP BY ALL HAVING count(*) = 5),
ready AS (SELECT symbol, {day_at('sunday')} AS time FROM whole w WHERE EXISTS (SELECT 1 FROM held h WHERE h.symbol = w.symbol AND h.m = date_trunc('month', {day_at('sunday')})) AND EXISTS (SELECT 1 FROM held h WHERE h.symbol = w.symbol AND h.m = date_trunc('month', {day_at('(sunday + 7)')} - INTERVAL 1 MICROSECOND)))
SELECT w.symbol, {as_string('w.time')} AS time, {BAR_COLUMNS} FROM weekly w JOIN ready r ON r.symbol = w.symbol AND r.time = w.time""",
    "update_actions": f"""WITH ticks AS ({TICKS}), b AS ({bars_sql('d1')}), p AS (SELECT CASE symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIRS.items())} END AS symbol, {_MONTH} FROM b)
SELECT DISTINCT 'first' AS plan, symbol, 'd1' AS "interval", year, month, 'normalize_canonical' AS kind, 'missing' AS reason FROM p""",
    "update_runs": f"""WITH s AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_microseconds({STRETCH} * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))) AS ts FROM events),
d AS (SELECT DISTINCT {session_date('ts')} AS d FROM s WHERE dayofweek({session_date('ts')}) NOT IN (5, 6)), bars AS (SELECT d, {day_at('d')} AS t FROM d),
b AS (SELECT min(t) AS lo, max(t) AS last, {day_at('(max(d) + 1)')} AS hi FROM bars), pairs(symbol) AS (VALUES ('EURUSD'), ('USDJPY')),
days AS (SELECT CAST(unnest(generate_series(CAST(b.lo AS DATE) - 8, CAST(b.hi AS DATE) + 40, INTERVAL 1 DAY)) AS DATE) AS d FROM b),
spine AS (SELECT {day_at('days.d')} AS t, {day_at('(days.d + 1)')} AS e, dayofweek(days.d) AS w, bars.d IS NOT NULL AS here FROM days LEFT JOIN bars USING (d)),
files AS (SELECT DISTINCT date_trunc('month', t) AS m FROM bars), asked AS (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi - INTERVAL 1 MICROSECOND), INTERVAL 1 MONTH)) AS m FROM b),
whole AS (SELECT m FROM asked a WHERE m IN (SELECT m FROM files) AND NOT EXISTS (SELECT 1 FROM spine, b WHERE date_trunc('month', t) = a.m AND t >= lo AND t < hi AND w NOT IN (5, 6) AND NOT here)),
weeks AS (SELECT {day_at('days.d')} AS t, {day_at('(days.d + 7)')} AS e FROM days WHERE dayofweek(days.d) = 0),
ready AS (SELECT * FROM weeks k WHERE date_trunc('month', t) IN (SELECT m FROM files) AND date_trunc('month', e - INTERVAL 1 MICROSECOND) IN (SELECT m FROM files) AND NOT EXISTS (SELECT 1 FROM spine WHERE spine.t >= k.t AND spine.t < k.e AND w NOT IN (5, 6) AND NOT here)),
held AS (SELECT a.m, max(r.e) AS e FROM whole a LEFT JOIN ready r ON date_trunc('month', r.t) = a.m GROUP BY a.m),
touched AS (SELECT m FROM held WHERE m = TIMESTAMP '2024-03-01' OR (m = TIMESTAMP '2024-02-01' AND e > TIMESTAMP '2024-03-01')),
third AS (SELECT TIMESTAMP '2024-03-01' AS m WHERE TIMESTAMP '2024-03-01' IN (SELECT m FROM files)),
found AS (SELECT 1 AS run, 'normalize_canonical' AS what, symbol, 'd1' AS "interval", m, 'missing' AS reason FROM pairs, files UNION ALL SELECT 1, 'read', symbol, 'd1', m, '' FROM pairs, files UNION ALL SELECT 1, 'written', symbol, 'd1', m, '' FROM pairs, files
  UNION ALL SELECT 1, 'derive_canonical', symbol, 'w1', m, 'missing' FROM pairs, whole UNION ALL SELECT 1, 'written', symbol, 'w1', m, '' FROM pairs, whole
  UNION ALL SELECT 3, unnest(['normalize_canonical', 'read', 'written']), 'EURUSD', 'd1', m, unnest(['stale: raw fingerprint changed', '', '']) FROM third
  UNION ALL SELECT 3, unnest(['derive_canonical', 'written']), 'EURUSD', 'w1', m, unnest(['stale: parent D1 revision changed', '']) FROM touched)
SELECT CAST(run AS INTEGER) AS run, what, symbol, "interval", CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, reason FROM found""",
    "streamed_fills_once": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS broker_fill_id, CAST(1 AS BIGINT) AS times FROM lineitem",
    "exported_plan": f"""WITH ticks AS ({TICKS}), b AS ({bars_sql('d1')}), p AS (SELECT DISTINCT CASE symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIRS.items())} END AS symbol, {_MONTH} FROM b)
SELECT '{{"provider":"oanda","symbol":"' || symbol || '","interval":"d1","year":' || year || ',"month":' || month || ',"kind":"normalize_canonical","reason":"missing","stage":1}}' AS value FROM p""",
    "coverage_report": f"""WITH s AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_microseconds({STRETCH} * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))) AS ts FROM events),
d AS (SELECT DISTINCT {session_date('ts')} AS d FROM s WHERE dayofweek({session_date('ts')}) NOT IN (5, 6) AND day({session_date('ts')}) <> 15), raws AS (SELECT d, {day_at('d')} AS t, date_trunc('month', {day_at('d')}) AS m FROM d),
pairs(symbol) AS (VALUES ('EURUSD'), ('USDJPY')), b AS (SELECT min(t) AS lo, {day_at('(max(d) + 1)')} + INTERVAL 40 DAY AS hi, TIMESTAMP '2024-06-01 00:00:00' AS now FROM raws), files AS (SELECT m, max(t) AS last FROM raws GROUP BY m),
bars AS (SELECT symbol, d, t FROM raws JOIN files USING (m), pairs WHERE symbol = 'EURUSD' OR t < last),
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS DATE) - 8, CAST(hi AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS d FROM b),
spine AS (SELECT symbol, days.d, {day_at('days.d')} AS t, {day_at('(days.d + 1)')} AS e, dayofweek(days.d) IN (5, 6) AS closed, bars.t IS NOT NULL AS here FROM days CROSS JOIN pairs LEFT JOIN bars USING (symbol, d)),
weeks AS (SELECT symbol, {day_at('d')} AS t, {day_at('(d + 7)')} AS e FROM days, pairs WHERE dayofweek(d) = 0),
ready AS (SELECT * FROM weeks k WHERE date_trunc('month', t) IN (SELECT m FROM files) AND date_trunc('month', e - INTERVAL 1 MICROSECOND) IN (SELECT m FROM files) AND NOT EXISTS (SELECT 1 FROM spine p WHERE p.symbol = k.symbol AND p.t >= k.t AND p.t < k.e AND NOT closed AND NOT here)),
asked AS (SELECT symbol, i AS "interval", unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi - INTERVAL 1 MICROSECOND), INTERVAL 1 MONTH)) AS m FROM b, pairs, (VALUES ('d1'), ('w1')) AS x(i)),
ends AS (SELECT symbol, date_trunc('month', t) AS m, max(e) AS e FROM ready GROUP BY ALL),
status AS (SELECT a.symbol, "interval", a.m, CASE WHEN a.m NOT IN (SELECT m FROM files) THEN 'missing' WHEN "interval" = 'd1' AND a.symbol = 'USDJPY' AND a.m = TIMESTAMP '2024-01-01' THEN 'invalid' WHEN "interval" = 'd1' AND a.symbol = 'EURUSD' AND a.m = TIMESTAMP '2024-03-01' THEN 'stale'
  WHEN "interval" = 'w1' AND a.symbol = 'EURUSD' AND TIMESTAMP '2024-04-01' IN (SELECT m FROM files) AND (a.m = TIMESTAMP '2024-04-01' OR (a.m = TIMESTAMP '2024-03-01' AND coalesce(ends.e > TIMESTAMP '2024-04-01', false))) THEN 'stale' ELSE 'current' END AS status
  FROM asked a LEFT JOIN ends ON ends.symbol = a.symbol AND ends.m = a.m),
states AS (SELECT symbol, 'd1' AS "interval", date_trunc('month', t) AS m, t, e, CASE WHEN closed THEN 'closed' WHEN e > now THEN 'in_progress' WHEN here THEN 'present' ELSE 'missing' END AS state FROM spine, b WHERE t >= lo AND t < hi
  UNION ALL SELECT w.symbol, 'w1', date_trunc('month', w.t), w.t, w.e, CASE WHEN w.e > now THEN 'in_progress' WHEN r.t IS NOT NULL THEN 'present' ELSE 'missing' END FROM b, weeks w LEFT JOIN ready r ON r.symbol = w.symbol AND r.t = w.t WHERE w.t >= lo AND w.t < hi),
lagged AS (SELECT *, CASE WHEN lag(state) OVER o = state AND lag(e) OVER o = t THEN 0 ELSE 1 END AS fresh FROM states JOIN status USING (symbol, "interval", m) WHERE status = 'current' WINDOW o AS (PARTITION BY symbol, "interval", m ORDER BY t)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, "interval", m ORDER BY t) AS island FROM lagged),
found AS (SELECT symbol, "interval", m, status, CASE WHEN "interval" = 'd1' AND symbol = 'USDJPY' AND m IN (SELECT m FROM files) THEN 1 ELSE 0 END AS incomplete_rows, '' AS gap_start, '' AS gap_end, 0 AS bars FROM status
  UNION ALL SELECT symbol, "interval", m, state, 0, {as_string('min(t)')}, {as_string('max(e)')}, count(*) FROM islands WHERE state NOT IN ('present', 'closed') GROUP BY symbol, "interval", m, state, island)
SELECT symbol, "interval", CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, status, CAST(incomplete_rows AS BIGINT) AS incomplete_rows, gap_start, gap_end, CAST(bars AS BIGINT) AS bars FROM found""",
    "canonical_files": f"""WITH ticks AS (SELECT CASE symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIRS.items())} END AS symbol, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(11 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))) AS ts, seq, price, spread FROM ({TICKS})),
b AS ({bars_sql('d1')}), f AS (SELECT symbol, {_MONTH}, count(*) AS n, CAST(sum(close) AS BIGINT) AS c FROM b GROUP BY ALL), e AS (SELECT *, CASE month {' '.join(f"WHEN {m} THEN '{e}'" for m, e in DEFECTS.items())} ELSE '' END AS error FROM f)
SELECT symbol, year, month, CASE WHEN error = '' THEN n ELSE 0 END AS bars, CASE WHEN error = '' THEN c ELSE 0 END AS closes, error FROM e""",
    "streamed_lifecycle": order_queries.ORACLES["order_lifecycle"],
    "streamed_refresh": f"""WITH {_TICKS}, o AS (SELECT symbol, date_trunc('second', ts) AS time, max(seq) AS seq, max(price) AS price FROM ticks GROUP BY ALL) SELECT symbol, {as_string('time')} AS time, seq, price + CASE WHEN seq % 5 < 2 THEN 7 ELSE 0 END AS price FROM o""",
}
