"""The trie of conversations against a brute-force version and DuckDB, with long, equal, empty and turnless conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from barloom.llm import prefix_trie
from barloom.llm.running import running

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        b = c - (c % 5 if c >= 0 else -(-c % 5))
        whole = own.get(b, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, out = [node], []
        while todo:
            out.append(x := todo.pop())
            todo += children[x]
        return out

    out = []
    for node, of in members.items():
        sub = below(node)
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in sub if v)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), sum(not children[v] for v in sub), saved, sha))
    return sorted(out, key=str)


def rows_of(seed=5, n=160):
    rng = random.Random(seed)
    says = ["", "a", "b", "été", "long " * 40]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(says)) for c in range(n) if rng.random() < 0.9 for t in range(rng.randint(1, 10))]
    copied = [(c, t, "user", f"t{t}") for c in range(300, 360) for t in range(6)]  # many equal conversations
    begun = [(c, t, "user", f"t{t}" if t < 3 else f"{c}") for c in range(400, 430) for t in range(rng.randint(1, 6))]
    odd = [
        (500, None, None, None), (500, 1, "a", None), (500, None, "", ""), (501, 3, "x", "y"), (501, 3, "x", "y"), (501, 3, "x", "a"), (None, 1, "u", "none"), (-7, 1, "u", "minus"), (-7, 2, "u", "minus"), (-5, 1, "v", "w"), (607, 0, "u", "baseless"),
        (10**12 + 3, 0, "u", "far"),
    ]
    long = [(700, t, "user", f"{t % 7}") for t in range(900)] + [(703, t, "user", f"{t % 7}") for t in range(1000)] + [(704, t, "user", f"{t % 7}") for t in range(450)]
    return rows + copied + begun + odd + long + [rows[0], rows[3]]


def taken(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("hot", [100_000, 20])
def test_trie_against_brute_force(spark, hot):
    rows = rows_of()
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, place long, depth long, h1 long").repartition(5)
    assert taken(prefix_trie.trie(frame, hot)) == brute(rows)


def test_trie_against_duckdb(spark):
    rows = [r for r in rows_of() if r[0] is None or r[0] < 700]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(prefix_trie.ORACLE)
    assert [d[0] for d in found.description] == COLUMNS
    assert sorted(found.fetchall(), key=str) == brute(rows)


def test_no_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_one_turn_and_end_lists_in_parts(spark):
    rows = [(5 * c, 0, "user", "same") for c in range(100)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert taken(prefix_trie.trie(frame)) == brute(rows)
    ends = spark.createDataFrame([(c, 1, 2, 3) for c in range(100)], "conv_id long, depth long, h1 long, h2 long").repartition(3)
    assert prefix_trie.end_lists(ends, chunk=7).collect()[0].ends_sha256 == hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()


def test_running_totals_are_carried_over_tasks(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(-9, 9), rng.getrandbits(62)) for k, n in ((1, 5), (2, 4000), (3, 1), (4, 700)) for i in range(n)] + [(4, None, 1, 1)] * 2
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = running(spark.createDataFrame(rows, "k long, o long, s long, x long").repartition(6), "k", ["o"], "at", ["s", "x"], sums=("s",), xors=("x",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for k in (1, 2, 3, 4):
        s = x = 0
        for at, (_, _, ds, dx) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0)), 1):
            s, x = s + ds, x ^ dx
            want.append((k, s, x, at))
    assert sorted(tuple(r) for r in got) == sorted(want)
