"""Queries on values and tables as they come in larger data."""

import datetime
import pickle
import types

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.operators import bars, instruments
from barloom.operators.orders import fold
from barloom.queries import all_oracles, all_queries
from barloom.queries import orders as order_queries
from barloom.queries import stored
from barloom.sources import raw, store
from barloom.streaming import orders as stream_orders


def against_sql(spark, name, sf_dir):
    """(rows of the query, rows of its SQL) on the tables in ``sf_dir``."""
    df = all_queries()[name](spark, str(sf_dir))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for path in sf_dir.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.execute(all_oracles()[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str), sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


def orders(spark, sf_dir, rows):
    """Orders (key, customer, total) as a table."""
    day = datetime.datetime(1996, 1, 2)
    spark.createDataFrame([(k, c, "O", p, day, "x") for k, c, p in rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{sf_dir}/orders.parquet")


#: Customers whose amounts are just within 64 bits, just beyond them, and far beyond; order totals that bring some back.
BEYOND = [(k, c, p) for k, c in enumerate([1, 1844, 1845, 1900, 15_000, 900_000] * 4) for p in [500_000.25]]


def test_operands_beyond_64_bits_are_no_error(spark, tmp_path):
    orders(spark, tmp_path, BEYOND)
    ours, theirs = against_sql(spark, "checked_arithmetic", tmp_path)
    assert ours == theirs
    assert any(r[0] is not None for r in ours) and any(r[0] is None for r in ours)


def test_amounts_beyond_64_bits_are_no_error(spark, tmp_path):
    orders(spark, tmp_path, BEYOND)
    fits = lambda x: x if -(2**63) <= x < 2**63 else None
    got = {r.o_orderkey: r for r in all_queries()["money_arithmetic"](spark, str(tmp_path)).collect()}
    assert len(got) == len(BEYOND)
    for k, c, p in BEYOND:  # the SQL casts each size and stops at the first that is too large
        a, b, r = int(p * 100) * 10**6 * (90_000 if k % 3 == 0 else 1), c * 10**8 * 50_000_000, got[k]
        there, both = k % 11 != 0, k % 11 != 0 and k % 4 != 0
        assert (r.total, r.difference, r.compared) == ((fits(a + b), fits(a - b), (a > b) - (a < b)) if both else (None, None, None))
        assert (r.negated, r["size"]) == (-a if there else None, fits(b))
        assert r.error == ("missing" if not there else "mismatch" if not both else "range" if fits(a + b) is None else None)


def test_raw_partitions_lie_in_order_of_time(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(("EURUSD", "GBPUSD", None)[i % 3], start + datetime.timedelta(seconds=(i * 7919) % 3000), i) for i in range(3000)]
    ticks = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, seq long").select("symbol", F.lit("oanda").alias("provider"), F.lit("m1").alias("interval"), F.year("time").alias("year"), F.month("time").alias("month"), "time", "seq")
    root = f"{tmp_path}/raw"
    store.write_raw(ticks, root)
    read = spark.read.schema(ticks.schema).parquet(root).select("symbol", "time", "seq", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).orderBy("file", "at").collect()
    assert sorted((r.symbol or "", r.time, r.seq) for r in read) == sorted((s or "", t, n) for s, t, n in rows)
    assert len({r.file for r in read}) == 3
    assert all(a.time <= b.time for a, b in zip(read, read[1:]) if a.file == b.file)


def test_a_request_meets_two_names_however_many_share_one(spark):
    listings = spark.range(2000).select(F.concat(F.lit("eq:"), "id").alias("instrument_id"), F.lit("p").alias("provider"), F.concat(F.lit("v"), F.col("id") % 2).alias("venue"), F.lit("X").alias("symbol"))
    listings = listings.unionByName(spark.createDataFrame([("eq:own", "p", "v9", "X"), ("eq:y", "p", "", "Y")], listings.schema))
    alias = "seq long, alias_provider string, alias_venue string, alias_symbol string, provider string, venue string, symbol string"
    aliases = spark.createDataFrame([(1, "p", "", "A", "p", "v9", "X"), (2, "p", "", "B", "p", "", "X"), (3, "p", "", "C", "p", "", "A"), (4, "p", "", "D", "p", "", "Y"), (5, "p", "v9", "A", "p", "", "Y")], alias)
    asked = spark.range(2000).select(F.col("id").alias("request_id"), F.lit("P").alias("provider"), F.element_at(F.array(F.lit(None).cast("string"), F.lit("v0"), F.lit("v9"), F.lit("")), (F.col("id") % 4 + 1).cast("int")).alias("venue"), F.element_at(F.array(*map(F.lit, "XACYB")), (F.col("id") % 5 + 1).cast("int")).alias("symbol"))
    got = {r.request_id: (r.status, r.instrument_id) for r in instruments.resolve_symbols(asked, listings, aliases).collect()}
    own, y, several, none = ("resolved", "eq:own"), ("resolved", "eq:y"), ("ambiguous", None), ("unknown", None)
    want = {"X": (several, several, own, none), "A": (own, none, own, none), "C": (own, none, own, none), "Y": (y, none, none, y), "B": (none,) * 4}
    assert got == {i: want["XACYB"[i % 5]][i % 4] for i in range(2000)}
    assert [tuple(r) for r in instruments.alias_errors(listings, aliases).orderBy("seq").collect()] == [(2, "ambiguous"), (5, "duplicate")]
    names = listings.select(*[F.col(c).alias(a) for c, a in (("instrument_id", "_i"), ("provider", "_p"), ("venue", "_v"), ("symbol", "_s"))], F.lit(0).alias("_seq"))
    assert names.count() == 2002 and instruments._findable(names).groupBy("_p", "_s", "_any", "_w").count().agg(F.max("count")).first()[0] == 2


def test_fills_of_an_order_are_packed_until_they_are_many():
    held = {}
    state = types.SimpleNamespace(containsKey=lambda k: k in held, updateValue=lambda k, v: held.update({k: v}))
    few = stream_orders._Seen(state, "o", "fill", ["a"], False)
    few.add("b")
    assert few.pack() == (["a", "b"], False) and not held and "a" in few and "c" not in few
    many = stream_orders._Seen(state, "o", "fill", *few.pack())
    for i in range(stream_orders.PACKED):
        many.add(str(i))
    assert many.pack() == ([], True) and len(held) == stream_orders.PACKED + 2
    again = stream_orders._Seen(state, "o", "fill", *many.pack())
    assert "a" in again and "7" in again and "c" not in again and "a" not in stream_orders._Seen(state, "p", "fill", [], True)


class Held(dict):
    """State as a processor sees it, in memory, with a count of messages."""

    calls = 0

    def get(self):
        return self.getValue("own")

    def update(self, value):
        self.updateValue("own", value)

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return dict.get(self, key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.pop(key, None)

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self


def test_orders_of_a_bucket_are_read_and_written_by_pages():
    held = {}
    handle = types.SimpleNamespace(getValueState=lambda name, *_: held.setdefault(name, Held()), getMapState=lambda name, *_: held.setdefault(name, Held()))
    processor = stream_orders.OrderProcessor(None)
    processor.init(handle)
    null = dict.fromkeys(stream_orders.EVENT_COLUMNS)
    named = {"account_id": "a", "instrument_id": "i", "side": "buy", "broker_order_id": "B", "event_id": ""}
    kinds = ("submit", "accept", "fill", "fill", "cancel_request", "reject")
    event = lambda o, n: {"_bucket": 0, "order_id": f"o{o}", **null, **named, "seq": n, "kind": kinds[n], "quantity": 2**60 + 1 if n == 1 else o + 1 if n in (2, 3) else None, "fill_id": f"f{n}", "rejected": False, "event_id": "c" if n == 4 else ""}
    kind = lambda c: pa.int64() if c in ("_bucket", "seq", "quantity", "limit_price", "stop_price") else pa.bool_() if c == "rejected" else pa.string()
    schema = pa.schema([(c, kind(c)) for c in ("_bucket", "order_id", *stream_orders.EVENT_COLUMNS)])
    orders, got, last = 3000, {}, None
    for upto in (600, orders):
        for which in ((1, 0), (3, 2), (5, 4)):
            events = pa.RecordBatch.from_pylist([event(o, n) for n in which for o in range(upto) if upto == 600 or o >= 600 or n == 5], schema=schema)
            packs = pa.Table.from_batches(stream_orders._packed(iter([events, events.slice(0, 0)]))).to_pandas()
            assert packs["_bucket"].tolist() == [0]
            before = sum(h.calls for h in held.values())
            rows = pd.concat(processor.handleInputRows((0,), iter([packs]), None))
            last = sum(h.calls for h in held.values()) - before
            got |= {r[0]: r for r in rows.itertuples(index=False)}
    assert len(got) == orders and last <= 2 * held["size"]["own"][0] + 2 < orders / 10
    assert held["size"]["own"][1] == orders and len(held["pages"]) == held["size"]["own"][0]
    for o in range(orders):
        refused = 2 if o < 600 else 1
        assert tuple(got[f"o{o}"]) == (f"o{o}", "pending_cancel", 2**60 + 1, 2 * (o + 1), got[f"o{o}"].limit_price, got[f"o{o}"].stop_price, "c", "B", 5, refused, "illegal")
    assert sum(len(pickle.loads(v[0])) for v in held["pages"].values()) == orders


def test_when_pages_double_orders_stay_or_go_to_one_new_page():
    for o in map(str, range(1000)):
        assert stream_orders.page_of(o, 1) == 0 and stream_orders.page_of(o, 16) in (stream_orders.page_of(o, 8), stream_orders.page_of(o, 8) + 8)


def test_events_travel_packed_by_bucket(spark):
    events = order_queries._events(spark, "/root/testdata/sf0.001").withColumn("_bucket", F.pmod(F.xxhash64("order_id"), F.lit(8)))
    packs = events.coalesce(1).mapInArrow(stream_orders._packed, "_bucket long, packed binary").toPandas()
    assert packs["_bucket"].tolist() == list(range(8))
    order_ids, columns, _ = stream_orders._sorted([packs])
    keys = list(zip(order_ids, columns["seq"], strict=True))
    assert keys == sorted(keys) and keys == sorted((r.order_id, r.seq) for r in events.select("order_id", "seq").collect())


def test_plain_rows_are_judged_at_one_look(spark, monkeypatch):
    line = lambda time="2024-01-31T23:59:59Z", price="1.5", volume="7", flag="true", n=8: ",".join([time, *["1"] * (n - 1), price, volume, flag])
    plain = [line(), line("2024-02-28T00:00:00+00:00"), line(price="0"), line(price="9999999999.99999999"), line(volume="9" * 18), line(flag="F"), line("1999-12-31T00:00:00-00:00", "007.10", "00", "False")]
    closer = [line("2024-02-29T00:00:00Z"), line("2023-02-29T00:00:00Z"), line("2024-04-31T00:00:00Z"), line("2024-01-01T24:00:00Z"), line("2024-01-01T00:00:00.25Z"), line("2024-01-01T00:00:00+01:30"), line("2024-01-01 00:00:00Z"), line(price="+1"), line(price="-1"), line(price="1."), line(price="1e3"), line(price="92233720368.54775808"), line(price="1.000000000"), line(price="1.000000001"), line(price=""), line(volume="-3"), line(volume="9" * 19), line(volume="x"), line(flag="TRue"), line(flag="true\r"), line(flag="true "), line(n=7), line(n=9), "", ","]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(plain + closer)], "i int, line string")
    each = rows.select(F.lit("p").alias("path"), F.struct(F.col("i").alias("line_no"), "line").alias("l"))
    found = [tuple(r) for r in raw._fields_of(each).orderBy("line_no").collect()]
    alone = [r.e for r in rows.select("i", raw.row_error(F.col("line")).alias("e")).orderBy("i").collect()]
    assert all(e is None for e in alone[: len(plain)]) and len(set(alone)) == 6 and alone == [r[-1] for r in found]
    with monkeypatch.context() as m:
        m.setattr(raw, "_error_in", lambda line: F.raise_error(F.lit("looked at field by field")).cast("string"))
        assert rows.where(F.col("i") < len(plain)).select(raw.row_error(F.col("line")).alias("e")).where("e IS NULL").count() == len(plain)
    monkeypatch.setattr(raw, "PLAIN", r"^\b\B$")  # nothing is plain
    assert found == [tuple(r) for r in raw._fields_of(each).orderBy("line_no").collect()]
    assert alone == [r.e for r in rows.select("i", raw.row_error(F.col("line")).alias("e")).orderBy("i").collect()]


def test_runs_of_plain_rows_are_judged_by_their_first(spark, monkeypatch):
    row = lambda i: f"2024-01-31T{i // 3600 % 24:02}:{i // 60 % 60:02}:{i % 60:02}Z,{i}.5,1,1,1,1,1,1,1,{i},true"
    some, bad, head, said = [row(i) for i in range(5)], row(1).replace("true", "maybe"), raw.HEADER, "# schema=raw-v1 source=x instrument=EURUSD tf=d year=2024 month=01"
    odd = {
        "many": [said, head, *map(row, range(20_000))], "blank": [head, "", *some, " ", "", *some, ""], "between": [said, head, *some[:3], "# x", *some, "#"], "wrong": [said.replace("2024", "2023"), head, *some], "late": [*some, head], "none": some,
        "bad_first": [head, bad, *some], "bad_middle": [head, *some, bad, *some], "bad_last": [head, *some, bad], "odd": [head, *some, row(7).replace(",1,", ",+1,", 1), *some], "lone": [head, *some, row(7) + "\r" + row(8), *some], "return": [head, *some, row(7) + "\r"], "once": [head, some[0]],
        "blank_before": [head, " " + some[0], *some], "far": [head, *some, "\u2028" + some[0]], "head": [head], "empty": [], "comments": [said, "#"],
    }
    texts = [(f"{n}{i}", end.join(lines) + tail) for n, lines in odd.items() for i, (end, tail) in enumerate((e, t) for e in ("\n", "\r\n") for t in ("", e, e + e))]
    texts.append(("bytes", "\n".join([head, *some, "\udcff", *some])))
    path = lambda n, symbol="EURUSD": f"{n}/{symbol}/2024/01/{symbol}-2024-01-d.csv"
    files = spark.createDataFrame([(path(n, s), bytearray(t.encode("utf-8", "surrogateescape"))) for s in ("EURUSD", "XAUUSD") for n, t in texts if s == "EURUSD" or n[:4] != "many"], "path string, content binary")
    found = {r.path: r for r in raw.parse_files(files).collect()}
    assert all(r.line_count == len(r.lines) for r in found.values())
    says = {n: found[path(f"{n}0")].file_error for n in odd}
    want = {"wrong": "comment"} | dict.fromkeys(("late", "none", "empty", "comments"), "header") | dict.fromkeys(("bad_first", "bad_middle", "bad_last", "lone", "return", "blank_before", "far"), "row")
    assert says == {n: want.get(n) for n in odd} and found[path("many0")].line_count == 20_000
    with monkeypatch.context() as m:  # of all plain rows only the first of a run is looked at
        m.setattr(raw, "row_error", lambda line: F.when(line == row(1), F.raise_error(F.lit("looked at every row")).cast("string")))
        assert raw.parse_files(files.where(F.col("path").isin(path("many0"), path("blank0"), path("between1")))).where("file_status = 'ok'").count() == 3
    monkeypatch.setattr(raw, "RUN", r"^\b\B$")  # there are no runs
    each = {r.path: r for r in raw.parse_files(files).collect()}
    assert each == found and len(found) == 2 * len(texts) - 6


def test_a_quarter_of_four_spreads_in_64_bits(spark):
    most = 2**63 - 1
    cases = [(most,) * 4, (-most - 1,) * 4, (most, most, most, most - 1), (-most - 1, -most - 1, -most - 1, -most), (most, -most, 1, 1), (1, 1, 1, 3), (1, 1, 1, 1), (0, 0, 1, 1), (0, 0, 3, 3), (0, 0, -1, -1), (0, 0, -3, -3), (-1, 0, 0, 0), (-3, 0, 0, 0), (7, -2, 5, 0), (None, 1, 1, 1)]
    rows = spark.createDataFrame([(i, *c, 0, 0, 0, 0) for i, c in enumerate(cases)], "i int, " + ", ".join(f"{s}_{c} long" for s in ("ask", "bid") for c in "ohlc"))
    got = [r.q for r in rows.select("i", bars.spreads()["avg_spread"].alias("q")).orderBy("i").collect()]
    half_even = lambda t: t // 4 + (t % 4 > 2 or (t % 4 == 2 and t // 4 % 2 == 1))
    assert got == [None if None in c else half_even(sum(c)) for c in cases]


def test_records_of_a_file_are_shuffled_once(spark, tmp_path):
    start = datetime.datetime(1996, 1, 2)
    items = [(i // 4, i % 7, i % 5, i % 3, float(i % 50 + 1), 900.0 + i, 0.01 * (i % 9), start + datetime.timedelta(days=i % 40)) for i in range(2000)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    ours, theirs = against_sql(spark, "normalised_bars", tmp_path)
    assert ours == theirs and ours
    plan = all_queries()["normalised_bars"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_line_items_are_read_once_for_the_events_of_orders(spark):
    plan = order_queries._events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_an_unknown_kind_of_event_is_refused(spark):
    schema = "order_id string, seq long, kind string, event_id string, causation_id string, status string, account_id string, instrument_id string, side string, quantity long, limit_price long, stop_price long, fill_id string, broker_fill_id string, broker_order_id string, rejected boolean"
    event = lambda seq, kind, quantity=None, fill_id=None, rejected=None: ("o", seq, kind, "", "", None, "a", "i", "buy", quantity, None, None, fill_id, None, "B", rejected)
    big = 2**60 + 1
    rows = [event(0, "submit"), event(1, "accept", big), event(2, "request"), event(3, None), event(4, "fill", big - 1, "f", False), event(5, "result")]
    (got,) = fold(spark.createDataFrame(rows, schema)).collect()
    assert (got.status, got.accepted_quantity, got.filled_quantity, got.applied, got.refused, got.last_refusal) == ("partially_filled", big, big - 1, 3, 3, "unknown_kind")


def test_ticks_are_put_into_bars_once_for_all_pairs(spark, monkeypatch):
    seen, real = [], stored.ops.from_ticks
    monkeypatch.setattr(stored.ops, "from_ticks", lambda ticks, *more: (seen.append(ticks), real(ticks, *more))[1])
    bars = stored._stretched(spark, "/root/testdata/sf0.001").collect()
    assert [t.count() for t in seen] == [sum(b.ticks for b in bars if b.symbol == "USDJPY")]
    assert {tuple(b)[1:] for b in bars if b.symbol == "EURUSD"} == {tuple(b)[1:] for b in bars if b.symbol == "USDJPY"}
