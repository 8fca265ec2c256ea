"""Hand-typed cases: calendar, decimals, bars, records, archives, store, planning, orders, streams."""

import datetime as dt
import hashlib
import json
import random
import tempfile
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from barloom.functions import calendar as cal
from barloom.functions import decimals as dec
from barloom.functions import identifiers as ids
from barloom.operators import audit, coverage, inventory, manifests, portfolio, ranges
from barloom.operators import bars as ops
from barloom.operators import orders as od
from barloom.plans import planner, update
from barloom.sources import raw, store

T = dt.datetime


def at(text):
    return T.fromisoformat(text)


def starts(spark, times, unit, count=1):
    df = spark.createDataFrame([(at(t),) for t in times], "t timestamp_ntz")
    return [(r.s, r.e) for r in df.select("t", cal.bar_start(F.col("t"), unit, count).alias("s"), cal.bar_end(F.col("t"), unit, count).alias("e")).collect()]


def test_days_over_both_clock_changes(spark):
    spring, autumn = starts(spark, ["2024-03-10 12:00:00", "2024-11-03 12:00:00"], "day")
    assert spring == (at("2024-03-09 22:00:00"), at("2024-03-10 21:00:00"))
    assert autumn == (at("2024-11-02 21:00:00"), at("2024-11-03 22:00:00"))


def test_four_hour_bars_over_clock_changes(spark):
    assert starts(spark, ["2024-03-10 19:30:00", "2024-11-03 21:30:00"], "hour", 4) == [(at("2024-03-10 18:00:00"), at("2024-03-10 21:00:00")), (at("2024-11-03 21:00:00"), at("2024-11-03 22:00:00"))]


def test_weeks_start_on_sunday_at_the_rollover(spark):
    assert starts(spark, ["2024-01-10 00:00:00", "2024-01-07 21:59:59", "2024-01-07 22:00:00"], "week") == [
        (at("2024-01-07 22:00:00"), at("2024-01-14 22:00:00")), (at("2023-12-31 22:00:00"), at("2024-01-07 22:00:00")), (at("2024-01-07 22:00:00"), at("2024-01-14 22:00:00")),
    ]


@pytest.mark.parametrize("unit,count", [("hour", 5), ("minute", 7), ("day", 2), ("month", 1), ("hour", 0)])
def test_bars_that_do_not_divide_a_day_are_refused(unit, count):
    with pytest.raises(ValueError):
        cal.check_interval(unit, count)


@pytest.mark.parametrize(
    "time,status",
    [
        ("2024-01-06 12:00:00", "closed"), ("2024-01-05 21:59:59", "open"), ("2024-01-05 22:00:00", "closed"), ("2024-01-07 21:59:00", "closed"), ("2024-01-07 22:00:00", "open"), ("2024-12-24 17:59:00", "open"),
        ("2024-12-24 18:00:00", "holiday"), ("2024-12-25 12:00:00", "holiday"), ("2024-12-26 23:00:00", "open"), ("2023-01-01 23:00:00", "holiday"), ("2023-01-02 05:00:00", "open"),
    ],
)
def test_session_status(spark, time, status):
    df = spark.createDataFrame([(at(time),)], "t timestamp_ntz")
    row = cal.with_session(df, "t", cal.standard_holidays(spark, 2022, 2025)).first()
    assert row["status"] == status
    assert (row.session_start is None) == (status != "open")


def test_a_holiday_sunday_reopens_at_monday_midnight(spark):
    row = cal.with_session(spark.createDataFrame([(at("2023-01-02 06:00:00"),)], "t timestamp_ntz"), "t", cal.standard_holidays(spark, 2023, 2023)).first()
    assert (row.session_start, row.session_end) == (at("2023-01-02 05:00:00"), at("2023-01-02 22:00:00"))


def oracle(fn):
    with localcontext() as c:
        c.prec = 80
        try:
            v = int(fn().to_integral_value(ROUND_HALF_EVEN))
        except ZeroDivisionError:
            return None
        except Exception:
            return None
    return v if -(2**63) <= v < 2**63 else None


def test_products_and_quotients_round_half_to_even(spark):
    rng = random.Random(3)
    pool = [0, 1, -1, 2, 5, 10**8, -(10**8), 5 * 10**7, 15 * 10**7, 2**63 - 1, -(2**63), 12345678901, 99999999]
    rows = [(a, b) for a in pool for b in pool] + [(rng.randint(-(2**63), 2**63 - 1), rng.randint(-(10**10), 10**10)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", dec.multiply("a", "b").alias("m"), dec.divide("a", "b").alias("d"), dec.negate("a").alias("n"), dec.add("a", "b").alias("s")).collect()
    for r in got:
        assert r.m == oracle(lambda: Decimal(r.a) * r.b / 10**8), (r.a, r.b)
        assert r.d == (None if r.b == 0 else oracle(lambda: Decimal(r.a) * 10**8 / r.b)), (r.a, r.b)
        assert r.n == (None if r.a == -(2**63) else -r.a)
        assert r.s == (r.a + r.b if -(2**63) <= r.a + r.b < 2**63 else None)


@pytest.mark.parametrize(
    "text,units,error",
    [
        ("1.000000005", None, "precision"), ("1.00000001000", 100000001, None), ("-0", 0, None), ("+1", 100000000, None), (".5", None, "syntax"), ("1.", None, "syntax"), ("1e3", None, "syntax"), ("", None, "syntax"), (None, None, "syntax"),
        ("92233720368.54775807", 2**63 - 1, None), ("92233720368.54775808", None, "range"), ("-1", None, "negative"), (" 1", None, "syntax"), ("9" * 40, None, "range"),
    ],
)
def test_strict_decimals(spark, text, units, error):
    row = spark.createDataFrame([(text,)], "t string").select(dec.parse("t", signed=False).alias("u"), dec.parse_error("t", signed=False).alias("e")).first()
    assert (row.u, row.e) == (units, error)


def test_canonical_text_and_money(spark):
    df = spark.createDataFrame([(150000000, "EUR", "EUR"), (0, "EUR", "USD"), (-5, "EUR", "E")], "u long, a string, b string")
    got = df.select(dec.text_of("u").alias("t"), dec.money_add(dec.money("u", "a"), dec.money("u", "b")).alias("m")).collect()
    assert [r.t for r in got] == ["1.5", "0", "-0.00000005"]
    assert got[0].m.amount == 300000000 and got[1].m is None and got[2].m is None


BAR = "symbol string, time timestamp_ntz, open long, high long, low long, close long, avg_spread long, max_spread long, ticks long"


def bar(symbol, time, o=2, h=3, low=1, c=2, a=0, m=0, n=1):
    return (symbol, at(time), o, h, low, c, a, m, n)


def test_average_spread_is_weighted_by_ticks(spark):
    rows = [bar("A", "2024-01-08 00:00:00", a=10000, m=10000, n=100), bar("A", "2024-01-08 01:00:00", a=50000, m=50000, n=300), bar("B", "2024-01-08 00:00:00", a=7, m=9, n=0)]
    got = {r.symbol: r for r in ops.resample(spark.createDataFrame(rows, BAR), ["symbol"], "d1").collect()}
    assert (got["A"].avg_spread, got["A"].ticks, got["A"].max_spread) == (40000, 400, 50000)
    assert got["B"].avg_spread == 0


def test_rounded_reciprocal_is_kept_only_for_compatibility(spark):
    df = spark.createDataFrame([bar("A", "2024-01-08 00:00:00", a=100, m=100, n=150_000_001)], BAR)
    assert ops.resample(df, ["symbol"], "d1").first().avg_spread == 100
    assert ops.resample(df, ["symbol"], "d1", compat=True).first().avg_spread == 150


def test_gaps_do_not_cross_months(spark):
    spans = spark.createDataFrame([("A", at("2024-01-30 22:00:00"), at("2024-02-02 22:00:00"))], "symbol string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    months = coverage.month_spans(spans, ["symbol"])
    states = coverage.interval_states(months, spark.createDataFrame([], BAR), ["symbol"], "d1", F.lit("2024-03-01").cast("timestamp_ntz"))
    got = coverage.gaps(states, ["symbol", "year", "month"]).orderBy("gap_start").collect()
    assert [(r.gap_start, r.gap_end, r.state) for r in got] == [(at("2024-01-30 22:00:00"), at("2024-02-01 22:00:00"), "missing"), (at("2024-02-01 22:00:00"), at("2024-02-02 22:00:00"), "missing")]


def test_a_partial_closure_within_a_day_is_a_straddle(spark):
    months = spark.createDataFrame([("A", 2024, 12, at("2024-12-23 22:00:00"), at("2024-12-24 22:00:00"))], "symbol string, year int, month int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    states = coverage.interval_states(months, spark.createDataFrame([], BAR), ["symbol"], "d1", F.lit("2025-01-01").cast("timestamp_ntz"), cal.standard_holidays(spark, 2024, 2024))
    assert [r.state for r in states.collect()] == ["straddle"]


def test_uncovered_range(spark):
    asked = spark.createDataFrame([("a", at("2024-01-01"), at("2024-01-10")), ("b", at("2024-01-01"), at("2024-01-10")), ("c", at("2024-01-01"), at("2024-01-10"))], "k string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    spans = spark.createDataFrame([("a", at("2023-12-01"), at("2024-01-04")), ("a", at("2024-01-03"), at("2024-02-01")), ("b", at("2023-12-01"), at("2024-01-04")), ("b", at("2024-01-05"), at("2024-02-01"))], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {r.k: (r.hole_start, r.hole_end) for r in ranges.first_uncovered(asked, spans, ["k"]).collect()}
    assert got == {"a": (None, None), "b": (at("2024-01-04"), at("2024-01-05")), "c": (at("2024-01-01"), at("2024-01-10"))}


def test_identifiers(spark):
    good = "ord_01ARZ3NDEKTSV4RRFFQ69G5FAV"
    rows = [good, "ord_81ARZ3NDEKTSV4RRFFQ69G5FAV", "zzz_01ARZ3NDEKTSV4RRFFQ69G5FAV", "ord_01ARZ3NDEKTSV4RRFFQ69G5FA", "ord_01ARZ3NDEKTSV4RRFFQ69G5FAI", "ord_" + "0" * 26, None]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(ids.id_error("v").alias("e"), ids.id_millis("v").alias("m")).collect()
    assert [r.e for r in got] == [None, "overflow", "prefix", "length", "alphabet", "zero", "prefix"]
    assert got[0].m == 1469922850259


def line(time, o=1.1, spread=0.0002, volume=10, complete="true", h=0.001):
    prices = [o, o + h, o - 0.001, o]
    return ",".join([time, *[f"{p:.5f}" for p in prices], *[f"{p + spread:.5f}" for p in prices], str(volume), complete])


def archive(tmp, files):
    import os

    for name, rows in files.items():
        symbol, year, month, _ = name.split("-")
        folder = os.path.join(tmp, symbol, year, month)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(rows) + "\n")


HEAD = [f"# schema=raw-v1 source=x instrument=EURUSD tf=h1 year=2024 month=01", raw.HEADER]


def hours(first, n):
    t = at(first)
    return [(t + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in range(n)]


def test_archive_scan_and_errors(spark):
    tmp = tempfile.mkdtemp(prefix="barloom-arch-")
    good = [line(t) for t in hours("2024-01-08 00:00:00", 3)]
    archive(
        tmp,
        {
            "EURUSD-2024-01-h1.csv": [*HEAD, "", *good], "EURUSD-2024-02-h1.csv": [raw.HEADER, "2024-02-01T00:00:00Z,x"], "EURUSD-2024-03-h1.csv": ["nope", *good], "EURUSD-2024-04-w1.csv": [raw.HEADER], "XAUUSD-2024-01-h1.csv": [raw.HEADER],
            "EURUSD-2024-05-h1.csv": [raw.HEADER, good[0].replace("true", "maybe")], "EURUSD-2024-06-h1.csv": [*HEAD, *good], "EURUSD-2024-07-h1.csv": [raw.HEADER, good[0].replace("2024-01-08T00", "2024-01-08 00")],
        },
    )
    files = raw.scan(spark, tmp)
    got = {(r.symbol, r.month, r.interval): (r.file_status, r.file_error) for r in files.collect()}
    assert got == {
        ("EURUSD", 1, "h1"): ("ok", None), ("EURUSD", 2, "h1"): ("malformed", "row"), ("EURUSD", 3, "h1"): ("malformed", "header"), ("EURUSD", 4, "w1"): ("skipped", "unsupported_interval"), ("XAUUSD", 1, "h1"): ("skipped", "out_of_scope"),
        ("EURUSD", 5, "h1"): ("malformed", "row"), ("EURUSD", 6, "h1"): ("malformed", "comment"), ("EURUSD", 7, "h1"): ("malformed", "row"),
    }
    rows = raw.records(files.where("file_status = 'ok'")).orderBy("line_no").collect()
    assert [(r.line_no, r.time, r.bid_o, r.complete) for r in rows] == [(4 + i, at("2024-01-08") + dt.timedelta(hours=i), 110000000, True) for i in range(3)]


def test_files_of_any_length(spark):
    """Files cut into many splits give the rows, numbers, errors and fingerprints that they give as a whole."""
    import os

    tmp = tempfile.mkdtemp(prefix="barloom-long-")
    good = [line(t) for t in hours("2024-01-08 00:00:00", 60)]
    bad = [*good[:30], good[30].replace("true", "maybe"), *good[31:]]
    archive(tmp, {"EURUSD-2024-01-h1.csv": [*HEAD, "", *good], "EURUSD-2024-02-h1.csv": [raw.HEADER, *bad], "EURUSD-2024-03-h1.csv": ["nope", *good], "EURUSD-2024-06-h1.csv": [*HEAD, *good], "XAUUSD-2024-01-h1.csv": [raw.HEADER, *good[:2]]})
    for month, body in (("04", "\r\n".join([raw.HEADER, *good])), ("05", "\n".join([raw.HEADER, *good, "", ""]) + "\n\n")):
        os.makedirs(f"{tmp}/EURUSD/2024/{month}")
        with open(f"{tmp}/EURUSD/2024/{month}/EURUSD-2024-{month}-h1.csv", "w", newline="") as f:
            f.write(body)
    whole = raw.scan(spark, tmp)
    columns = ["path", "symbol", "interval", "year", "month", "file_status", "file_error", "fingerprint"]
    want = sorted(map(str, whole.select(*columns).collect()))
    rows = sorted(map(str, raw.records(whole).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert spark.read.text(f"{tmp}/EURUSD/2024/01").rdd.getNumPartitions() > 3
        files, records = raw.scan_long(spark, tmp)
        assert sorted(map(str, files.select(*columns).collect())) == want
        assert sorted(map(str, records.select(*raw.records(whole).columns).collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_offsets_and_fractions_of_time(spark):
    df = spark.createDataFrame([("2024-01-08T01:30:00+01:30",), ("2024-01-08T00:00:00.123456789Z",), ("2024-01-08T00:00:00",)], "t string")
    assert [r[0] for r in df.select(raw.utc_time(F.col("t"))).collect()] == [at("2024-01-08"), at("2024-01-08 00:00:00.123456"), None]


def test_update_builds_derives_and_leaves_nothing(spark):
    tmp, out = tempfile.mkdtemp(prefix="barloom-arch-"), tempfile.mkdtemp(prefix="barloom-canon-")
    days = ["2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11"]
    daily = [line(f"{d}T22:00:00Z", o=1.1 + i / 1000) for i, d in enumerate(days)]
    bad = [line("2024-01-08T00:00:00Z"), line("2024-01-08T00:00:00Z")]
    archive(tmp, {"EURUSD-2024-01-d1.csv": [raw.HEADER, *daily], "EURUSD-2024-01-h1.csv": [*HEAD, *[line(t) for t in hours("2024-01-08 00:00:00", 5)]], "EURGBP-2024-01-h1.csv": [raw.HEADER, *bad]})
    rows = [("oanda", s, i, at("2024-01-07"), at("2024-01-12 22:00:00")) for s, i in (("EURUSD", "d1"), ("EURUSD", "w1"), ("EURUSD", "h1"), ("EURGBP", "h1"), ("GBPUSD", "h1"))]
    requests = spark.createDataFrame(rows, "provider string, symbol string, interval string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    done = update.run(spark, tmp, out, requests, now)
    found = {(r.symbol, r.interval, r.kind, r.reason) for r in done.actions.collect()}
    assert ("EURUSD", "d1", "normalize_canonical", "missing") in found and ("GBPUSD", "h1", "download_raw", "missing") in found
    assert [(r.symbol, r.offenders) for r in done.blocked.collect()] == [("EURGBP", "3:duplicate")]
    assert {(r.symbol, r.interval, r.kind, r.reason, r.runnable) for r in done.left.collect()} == {
        ("EURGBP", "h1", "normalize_canonical", "missing", True), ("EURGBP", "h1", "download_raw", "extend", False), ("EURUSD", "h1", "download_raw", "extend", False),
        ("EURUSD", "h1", "normalize_canonical", "extend: rebuild once raw catches up", False), ("GBPUSD", "h1", "download_raw", "missing", False),
    }
    assert {(r.symbol, r.interval, r.kind, r.round) for r in done.executed.collect()} == {
        ("EURUSD", "d1", "normalize_canonical", 1), ("EURUSD", "h1", "normalize_canonical", 1), ("EURGBP", "h1", "normalize_canonical", 1), ("EURUSD", "w1", "derive_canonical", 2),
    }
    assert done.read.count() == 3
    bars, held = store.load(spark, out)
    assert {(r.interval, r["count"]) for r in bars.groupBy("interval").count().collect()} == {("d1", 5), ("h1", 5), ("w1", 1)}
    week = bars.where("interval = 'w1'").first()
    assert (week.time, week.open, week.close, week.ticks) == (at("2024-01-07 22:00:00"), 110000000, 110400000, 50)
    assert store.verify(spark, out)[1].count() == 0
    assert held.where("interval = 'w1'").first().parent_interval == "d1"
    with pytest.raises(ValueError):
        store.publish(bars.withColumn("high", F.col("low") - 1), held, out)
    # a Wednesday goes: its month is built again and, since no week is whole, the weekly month is empty, under the new revision
    archive(tmp, {"EURUSD-2024-01-d1.csv": [raw.HEADER, *daily[:2], *daily[3:]]})
    changed = raw.listing(spark, tmp).where("interval = 'd1' AND file_error IS NULL")
    assert update.normalise_archive(spark, tmp, out, now, changed).count() == 0
    update.derive_weeks(spark, out, now, archive=tmp)
    bars, held = store.load(spark, out)
    assert bars.where("interval = 'w1'").count() == 0 and store.verify(spark, out)[1].count() == 0
    week, day = (held.where(f"interval = '{i}'").first() for i in ("w1", "d1"))
    assert (week.bar_count, week.parent_revision, week.raw_fingerprint) == (0, day.revision, day.raw_fingerprint)


def test_publications_are_generations(spark):
    out = tempfile.mkdtemp(prefix="barloom-canon-")
    start = at("2024-01-08")
    bars = spark.createDataFrame([("oanda", "EURUSD", "h1", 2024, 1, start + dt.timedelta(hours=i), 5, 7, 3, 6, 1, 1, 1) for i in range(3)], "provider string, symbol string, interval string, year int, month int, time timestamp_ntz, open long, high long, low long, close long, avg_spread long, max_spread long, ticks long")
    prints = spark.createDataFrame([("oanda", "EURUSD", "h1", 2024, 1, "sha256:01")], "provider string, symbol string, interval string, year int, month int, raw_fingerprint string")
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    first = store.publish(bars, update.with_manifest(bars, prints, now), out)
    # a publication that stopped before its manifest changes nothing
    stopped = store.new_generation()
    store.write_generation(bars.limit(1), stopped, out)
    loaded, held = store.load(spark, out)
    assert loaded.count() == 3 and held.first().generation == first and store.verify(spark, out)[1].count() == 0
    # a month republished without bars is empty
    none = bars.limit(0)
    last = store.publish(none, update.with_manifest(none, prints, now), out)
    loaded, held = store.load(spark, out)
    assert loaded.count() == 0 and held.count() == 1 and held.first().bar_count == 0 and store.verify(spark, out)[1].count() == 0
    assert first < stopped < last
    assert store.superseded(spark, out, stopped).count() == 1
    assert store.vacuum(spark, out, last) == 2 and store.superseded(spark, out, store.new_generation()).count() == 0
    again = store.publish(bars, update.with_manifest(bars, prints, now), out)
    assert store.vacuum(spark, out, store.new_generation()) == 0 and store.load(spark, out)[0].count() == 3 and again > last


def test_only_changed_files_are_read(spark):
    tmp, index = tempfile.mkdtemp(prefix="barloom-arch-"), tempfile.mkdtemp(prefix="barloom-index-") + "/i"
    good = [line(t) for t in hours("2024-01-08 00:00:00", 3)]
    archive(tmp, {f"EURUSD-2024-0{m}-h1.csv": [raw.HEADER, *[g.replace("2024-01", f"2024-0{m}") for g in good]] for m in (1, 2, 3)} | {"EURUSD-2024-04-h1.csv": [raw.HEADER, "x"], "XAUUSD-2024-01-h1.csv": [raw.HEADER]})
    archive(tmp + "/deep/er", {"EURUSD-2024-01-h1.csv": [raw.HEADER, *good]})
    assert {(r.path.removeprefix(f"file:{tmp}/"), r.file_error) for r in raw.scan(spark, tmp).where("file_status = 'skipped'").collect()} == {("deep/er/EURUSD/2024/01/EURUSD-2024-01-h1.csv", "layout"), ("XAUUSD/2024/01/XAUUSD-2024-01-h1.csv", "out_of_scope")}
    names = lambda read: sorted(r.path.rpartition("/")[2][7:14] for r in read.collect())
    months = spark.createDataFrame([("EURUSD", "h1", 2024, 1), ("EURUSD", "h1", 2024, 4)], "symbol string, interval string, year int, month int")
    files, read = raw.known_files(spark, tmp, index, months)
    assert names(read) == ["2024-01", "2024-04"]
    assert {(r.month, r.file_status, r.row_count, r.last_complete) for r in files.collect()} == {(1, "ok", 3, True), (4, "malformed", None, None)}
    files, read = raw.known_files(spark, tmp, index)
    assert names(read) == ["2024-02", "2024-03"] and files.count() == 4
    archive(tmp, {"EURUSD-2024-02-h1.csv": [raw.HEADER, *[g.replace("2024-01", "2024-02") for g in good[:2]]]})
    files, read = raw.known_files(spark, tmp, index)
    assert names(read) == ["2024-02"] and {(r.month, r.row_count) for r in files.collect()} == {(1, 3), (2, 2), (3, 3), (4, None)}
    assert names(raw.known_files(spark, tmp, index)[1]) == []
    # more files than are asked for by name give the same
    listed = raw.listing(spark, tmp).where("file_error IS NULL")
    some = raw.read_some(spark, tmp, listed.where("month = 2"), most=0)
    assert [(r.month, len(r.lines)) for r in some.collect()] == [(2, 2)]


def test_provider_json(spark):
    body = json.dumps({"candles": [{"complete": True, "time": "2024-01-08T00:00:00Z", "volume": 3, "bid": dict(o="1", h="2", l="1", c="1.5"), "ask": dict(o="1.1", h="2.1", l="1.1", c="1.6")}, {"complete": False, "time": "x", "volume": 1, "bid": dict(o="1", h="2", l="1", c="1.5")}]})
    got = raw.candles(spark.createDataFrame([("a", body)], "k string, body string"), ["k"]).orderBy("line_no").collect()
    assert (got[0].bid_c, got[0].ask_o, got[0].row_error) == (150000000, 110000000, None)
    assert got[1].row_error == "side"


def test_legacy_candles(spark):
    path = tempfile.mkdtemp(prefix="barloom-legacy-") + "/a.csv"
    with open(path, "w") as f:
        f.write("# c\nTimestamp,Open,High,Low,Close,avgspread,maxspread,ticks,flags\n1704672000,110000,110100,109900,110050,1,2,3,x\nbad,row\n")
    rows = raw.legacy_candles(spark, path).collect()
    assert [(r.time, r.close, r.ticks) for r in rows] == [(at("2024-01-08"), 110050000, 3)]


def test_upsert_keeps_the_last_fetched(spark):
    a = spark.createDataFrame([(1, 0, "old"), (2, 0, "kept")], "k int, seq int, v string")
    b = spark.createDataFrame([(1, 1, "first"), (1, 2, "last"), (3, 1, "new")], "k int, seq int, v string")
    assert {(r.k, r.v) for r in inventory.upsert(a, b, ["k"]).collect()} == {(1, "last"), (2, "kept"), (3, "new")}


def event(kind, seq, **more):
    return {"seq": seq, "kind": kind, "event_id": "", "causation_id": "", "status": None, "account_id": "a", "instrument_id": "i", "side": "buy", "quantity": None, "limit_price": None, "stop_price": None, "fill_id": None, "broker_fill_id": None, "broker_order_id": "B", "rejected": False} | more


def play(*events):
    state = od.OrderState()
    return state, [state.apply(e) for e in events]


def test_order_life():
    start = [event("submit", 0), event("accept", 1, quantity=100)]
    state, why = play(*start, event("fill", 2, quantity=40, fill_id="f1", broker_fill_id="b1"), event("fill", 3, quantity=40, fill_id="f2", broker_fill_id="b1"), event("fill", 4, quantity=70, fill_id="f3"), event("fill", 5, quantity=60, fill_id="f4"))
    assert why[2:] == ["", "duplicate", "overfill", ""] and (state.status, state.filled) == ("filled", 100)
    state, why = play(*start, event("cancel_request", 2, event_id="c1"), event("fill", 3, quantity=40, fill_id="f1"), event("cancel_result", 4, causation_id="c0", status="canceled"), event("cancel_result", 5, causation_id="c1", status="canceled"), event("cancel_result", 6, causation_id="c1", status="canceled"))
    assert why[2:] == ["", "", "stale", "", ""] and (state.status, state.filled, state.pending) == ("canceled", 40, "")
    state, why = play(*start, event("replace_request", 2, event_id="r1", quantity=200), event("replace_result", 3, causation_id="r1", status="working", rejected=True))
    assert why[2:] == ["", ""] and (state.accepted, state.status) == (100, "working")
    state, why = play(*start, event("replace_request", 2, event_id="r1", quantity=200), event("replace_result", 3, causation_id="r1", status="working"))
    assert state.accepted == 200
    state, why = play(*start, event("cancel_request", 2, event_id="c1"), event("fill", 3, quantity=100, fill_id="f1"))
    assert (state.status, state.pending) == ("filled", "")
    assert play(event("submit", 0), event("reject", 1), event("accept", 2, quantity=1))[1] == ["", "", "illegal"]
    assert play(event("submit", 0), event("expire", 1))[1] == ["", "illegal"]
    assert play(event("fill", 0, quantity=1, fill_id="f"))[1] == ["no_order"]
    assert play(*start, event("fill", 2, quantity=1, fill_id="f", side="sell"))[1][2] == "mismatch"


def test_stream_of_orders_agrees_with_batch(spark):
    rng = random.Random(5)
    rows = []
    for o in range(12):
        kinds = ["submit", "accept", *rng.choices(["fill", "cancel_request", "cancel_result", "expire", "replace_request", "replace_result"], k=12)]
        for i, k in enumerate(kinds):
            e = event(k, i, quantity=rng.choice([10, 30, 50]) if k in ("fill", "replace_request") else 100 if k == "accept" else None, event_id=f"e{i}", causation_id=f"e{rng.randint(max(0, i - 2), i)}", status=rng.choice(["working", "canceled", "partially_filled"]), fill_id=f"f{rng.randint(0, 6)}", broker_fill_id=rng.choice(["", f"b{i % 5}"]))
            rows.append({"order_id": f"o{o}"} | e)
    schema = "order_id string, seq long, kind string, event_id string, causation_id string, status string, account_id string, instrument_id string, side string, quantity long, limit_price long, stop_price long, fill_id string, broker_fill_id string, broker_order_id string, rejected boolean"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    folder = tempfile.mkdtemp(prefix="barloom-stream-")
    for part in range(3):
        df.where((F.col("seq") >= part * 5) & (F.col("seq") < part * 5 + 5)).coalesce(1).write.mode("append").parquet(folder)
    from barloom.streaming.orders import order_states

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = order_states(stream).writeStream.outputMode("update").format("memory").queryName("orders_out").option("checkpointLocation", tempfile.mkdtemp()).start()
    query.processAllAvailable()
    query.stop()
    batch = {r.order_id: tuple(r) for r in od.fold(df).collect()}
    last = {r.order_id: tuple(r) for r in sorted(spark.table("orders_out").collect(), key=lambda r: r.applied + r.refused)}
    assert last == batch and len(batch) == 12


def test_ended_orders_are_dropped(spark):
    """An order that has ended is kept for a while, then what comes for it finds no order."""
    from barloom.streaming.orders import order_states

    schema = ", ".join(["order_id string", "ts timestamp"] + [f"{c} {'long' if c in ('seq', 'quantity', 'limit_price', 'stop_price') else 'boolean' if c == 'rejected' else 'string'}" for c in od.EVENT_COLUMNS])
    known = {"account_id": "a", "instrument_id": "i", "side": "buy", "rejected": False}
    event = lambda order, day, seq, kind: (order, at(f"2024-01-{day:02d}"), *[{"seq": seq, "kind": kind, **known}.get(c) for c in od.EVENT_COLUMNS])
    folder = tempfile.mkdtemp(prefix="barloom-ended-")
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add(event("o", 1, 1, "submit"), event("o", 1, 2, "reject"))
    query = order_states(spark.readStream.schema(schema).parquet(folder), keep_days=3).writeStream.outputMode("update").format("memory").queryName("ended_out").option("checkpointLocation", tempfile.mkdtemp()).start()
    query.processAllAvailable()
    for rows in ([event("o", 3, 3, "reject"), event("p", 3, 1, "submit")], [event("p", 9, 2, "reject")], [event("o", 9, 4, "reject")]):
        add(*rows)
        query.processAllAvailable()
    query.stop()
    got = [(r.status, r.applied, r.refused, r.last_refusal) for r in spark.table("ended_out").where("order_id = 'o'").collect()]
    assert got == [("rejected", 2, 0, None), ("rejected", 2, 1, "illegal"), (None, 0, 1, "no_order")]


def test_streamed_refresh_and_bars(spark):
    from barloom.streaming import records

    schema = "provider string, interval string, year int, month int, symbol string, time timestamp_ntz, seq int, bid_c long, complete boolean"
    folder, root = tempfile.mkdtemp(prefix="barloom-in-"), tempfile.mkdtemp(prefix="barloom-out-") + "/raw"
    one = [("oanda", "h1", 2024, 1, "EURUSD", at("2024-01-08"), 1, 5, True), ("oanda", "h1", 2024, 1, "EURUSD", at("2024-01-08 01:00:00"), 1, 6, False)]
    two = [("oanda", "h1", 2024, 1, "EURUSD", at("2024-01-08 01:00:00"), 2, 7, True)]
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = records.refresh(spark.readStream.schema(schema).parquet(folder), root, root + "-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.time, r.bid_c, r.complete) for r in spark.read.parquet(root).collect()) == [(at("2024-01-08"), 5, True), (at("2024-01-08 01:00:00"), 7, True)]
    with pytest.raises(FileExistsError):
        store.write_raw(spark.createDataFrame(one, schema), root, must_not_exist=True)
    with pytest.raises(ValueError):
        records.bars(spark.createDataFrame([], "symbol string, ts timestamp, seq long, price long, spread long"), ["symbol"], "d1")


def test_planned_actions(spark):
    months = spark.createDataFrame([("A", 2024, 1, "current", None), ("A", 2024, 2, "missing", "malformed"), ("A", 2024, 3, "stale", "ok"), ("A", 2024, 4, "current", "ok")], "k string, year int, month int, status string, raw_status string")
    extend = spark.createDataFrame([("A",)], "k string")
    got = [(r.month, r.kind, r.reason) for r in planner.ordered(planner.raw_actions(months, ["k"], extend), ["k"]).collect()]
    assert got == [
        (1, "download_raw", "missing"), (2, "repair_raw", "raw partition malformed"), (4, "download_raw", "extend"), (3, "normalize_canonical", "stale: raw fingerprint changed"), (4, "normalize_canonical", "extend: rebuild once raw catches up"),
    ]


def test_portfolio_is_all_or_nothing(spark):
    accounts = spark.createDataFrame([("P", "a1", "USD", 100, at("2024-01-01")), ("P", "a2", "EUR", 200, at("2024-01-02")), ("Q", "a3", "JPY", 5, at("2024-01-01"))], "portfolio_id string, account_id string, currency string, equity long, as_of timestamp_ntz")
    portfolios = spark.createDataFrame([("P", "USD", at("2024-02-01")), ("Q", "USD", at("2024-02-01"))], "portfolio_id string, base_currency string, as_of timestamp_ntz")
    rates = spark.createDataFrame([("P", "EUR", "USD", 150000000, at("2024-01-01")), ("Q", "JPY", "USD", 1, at("2024-03-01"))], "portfolio_id string, from_currency string, to_currency string, rate long, as_of timestamp_ntz")
    errors = portfolio.rate_errors(rates, portfolios)
    assert {(r.portfolio_id, r.error) for r in errors.collect()} == {("P", None), ("Q", "look_ahead")}
    good = errors.where("error IS NULL")
    assert {(r.portfolio_id, r.status, r.equity) for r in portfolio.equity(accounts, portfolios, good).collect()} == {("P", "complete", 400), ("Q", "incomplete", None)}
    assert [r.portfolio_id for r in portfolio.rates_used(accounts, portfolios, good).collect()] == ["P"]


def test_cycles_have_no_depth(spark):
    df = spark.createDataFrame([("c", "a", None), ("c", "b", "a"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "gone")], "correlation_id string, event_id string, causation_id string")
    assert [r.event_id for r in audit.orphans(df).collect()] == ["z"]
    assert {(r.event_id, r.depth) for r in audit.depths(df.where("event_id IN ('a', 'b')"), rounds=4).collect()} == {("a", 0), ("b", 1)}


REVISED = (
    "provider string, instrument_id string, interval string, span_start timestamp_ntz, span_end timestamp_ntz, basis string, schema_version int, raw_fingerprint string, builder_version string, validator_version string, resampler_version string,"
    " calendar_version string, bar_count long, first_bar timestamp_ntz, last_bar timestamp_ntz, parent_instrument string, parent_interval string, parent_revision string, built_at string"
)


def test_revisions_are_of_canonical_json(spark):
    """Hashes of JSON written by hand, field by field; what was joined by bars before is told apart."""
    jan, feb = at("2024-01-01"), at("2024-02-01")
    plain = ("oanda", "fx:EUR/USD", "h1", jan, feb, "bid", 1, "sha256:ab", "1", "1", "none", "1", 2, at("2024-01-08"), at("2024-01-08 01:00:00"), None, None, None)
    odd = ('a<b>&"c"\\d\n\x1f\x0b\u2028é', "fx:EUR/USD", "w1", jan, feb, "ask", 1, "sha256:ab", "1|1", "", "2", "1", 0, None, None, "fx:EUR/USD", "d1", "cd")
    rows = [(*plain, "x"), (*plain, "y"), (*odd, "x"), (*odd[:8], "1", "1|", *odd[10:], "x")]
    got = [r[0] for r in spark.createDataFrame(rows, REVISED).select(manifests.revision()).collect()]
    by_hand = (
        '{"version":"manifest-revision-v1","provider":"oanda","instrument":"fx:EUR/USD","interval_unit":1,"interval_count":1,"span_start":1704067200000000000,"span_end":1706745600000000000,"basis":1,"schema_version":1,"raw_fingerprint":"sha256:ab",'
        '"builder_version":"1","validator_version":"1","resampler_version":"none","calendar_version":"1","bar_count":2,"first_bar":1704672000000000000,"last_bar":1704675600000000000,"parent":null}'
    )
    odd_by_hand = (
        r'{"version":"manifest-revision-v1","provider":"a\u003cb\u003e\u0026\"c\"\\d\n\u001f\u000b\u2028é","instrument":"fx:EUR/USD","interval_unit":3,"interval_count":1,"span_start":1704067200000000000,"span_end":1706745600000000000,"basis":3,'
        r'"schema_version":1,"raw_fingerprint":"sha256:ab","builder_version":"1|1","validator_version":"","resampler_version":"2","calendar_version":"1","bar_count":0,"first_bar":-6795364578871345152,"last_bar":-6795364578871345152,'
        r'"parent":{"instrument":"fx:EUR/USD","interval_unit":2,"interval_count":1,"revision":"cd"}}'
    )
    assert got[0] == got[1] == hashlib.sha256(by_hand.encode()).hexdigest()
    assert got[2] == hashlib.sha256(odd_by_hand.encode()).hexdigest() and got[3] != got[2]


def drained(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp()).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name).collect()


def test_streamed_fills_once_and_hourly_bars(spark):
    from barloom.streaming import orders, records

    folder = tempfile.mkdtemp(prefix="barloom-fills-")
    schema = "broker_fill_id string, ts timestamp, quantity long"
    for rows in ([("b1", at("2024-01-08 00:00:00"), 1), ("b2", at("2024-01-08 00:01:00"), 2)], [("b1", at("2024-01-08 00:02:00"), 1), ("b3", at("2024-01-08 00:03:00"), 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    got = drained(orders.once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "fills_once")
    assert sorted(r.broker_fill_id for r in got) == ["b1", "b2", "b3"]
    ticks = tempfile.mkdtemp(prefix="barloom-ticks-")
    schema = "symbol string, ts timestamp, seq long, price long, spread long"
    rows = [("A", at("2024-01-08 00:00:01"), 1, 5, 1), ("A", at("2024-01-08 00:59:00"), 2, 9, 3), ("A", at("2024-01-08 01:10:00"), 3, 4, 2), ("A", at("2024-01-08 03:00:00"), 4, 4, 2)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(ticks)
    got = drained(records.bars(spark.readStream.schema(schema).parquet(ticks), ["symbol"], "h1"), "hour_bars", "update")
    assert sorted((r.open, r.high, r.low, r.close, r.ticks) for r in got)[-1] == (5, 9, 5, 9, 2)


def test_orphans_and_what_hangs_below_have_no_depth(spark):
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "x", "gone"), (1, "y", "x"), (1, "z", "y")]
    df = spark.createDataFrame(rows, "correlation_id long, event_id string, causation_id string")
    assert {(r.event_id, r.depth) for r in audit.depths(df).collect()} == {("a", 0), ("b", 1), ("c", 2)}
