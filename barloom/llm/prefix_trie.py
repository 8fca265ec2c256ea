"""Prefix trie of conversations: identical ones are collapsed to weighted sequences, proper prefixes are dropped by an anti-join to find the leaves, and the prefixes of weighted sequences are aggregated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_spread, settle, text_or_empty
from .running import running

#: A conversation begins with up to ``HEADS`` - 1 turns of the first one of its group of ``GROUP``.
GROUP, HEADS = 5, 9
#: Ids of one row of an end list, before rows are hashed one after the other.
CHUNK = 10_000
NODE = ["depth", "h1", "h2"]


def rebuilt(conversations: DataFrame, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, turns: conv_id, place from 1, t1, t2, bytes) after each conversation c took the first crc32(c) % 9 turns of conversation c - c % 5 in the place of its own.

    A turn is known by 128 bits of hash of role and text from here on; its text goes no further.
    """
    role, text = text_or_empty("role"), text_or_empty()
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("t2"), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    own = running(turns, "conv_id", ["turn", "role", "text"], "place", ["t1", "t2", "bytes"])
    borrowed = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    counts = settle(own.groupBy("conv_id").agg(F.max("place").alias("n")))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = counts.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": borrowed}).join(base, "base", "left")
    convs = convs.select("conv_id", "base", F.least("h", F.coalesce("of_base", F.lit(0))).alias("taken"))
    first = own.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").join(first, "base").where("place <= taken").select("conv_id", "place", "t1", "t2", "bytes")
    rest = join_spread(own.where(F.col("place") > borrowed), convs.select("conv_id", "taken"), "conv_id", counts, hot)
    return convs.select("conv_id"), heads.unionByName(rest.select("conv_id", (F.col("place") - borrowed + F.col("taken")).alias("place"), "t1", "t2", "bytes"))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, node (h1, h2) and its parent (p1, p2), bytes of its last text, and upto: bytes of all its texts. The node is the xor of its turns' hashes with their places."""
    g = {f"g{i}": F.xxhash64(F.lit(f"g{i}"), "place", "t1", "t2") for i in (1, 2)}
    placed = turns.withColumns(g).withColumns({"h1": F.col("g1"), "h2": F.col("g2"), "upto": F.col("bytes")})
    totals = running(placed, "conv_id", ["place"], "depth", ["g1", "g2", "bytes", "h1", "h2", "upto"], sums=("upto",), xors=("h1", "h2"))
    up = [F.col(f"h{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "h1", "h2", "p1", "p2", "bytes", "upto")]
    return totals.select("conv_id", "depth", "h1", "h2", *up, "bytes", "upto").unionByName(convs.select("conv_id", *zero))


def end_lists(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ends`` (conv_id, depth, h1, h2) to depth, h1, h2, ends_sha256 of the ascending ids that end there.

    Ids are dealt by range and joined to texts of at most ``chunk`` ids in the tasks; only those texts meet by node, in order, and go through one running hash.
    """
    by = [*NODE, "conv_id"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, part = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for node, own in pdf.groupby(NODE, sort=False)["conv_id"]:
                ids = own.tolist()
                for i in range(0, len(ids), chunk):
                    out.append((*node, task, part, ",".join(map(str, ids[i : i + chunk]))))
                    part += 1
            if out:
                yield pd.DataFrame(out, columns=[*NODE, "task", "part", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running_hash = None, None
        for pdf in batches:
            out = []
            for *own, ids in zip(*(pdf[c] for c in NODE), pdf["ids"], strict=True):
                if own != node:
                    if node is not None:
                        out.append((*node, running_hash.hexdigest()))
                    node, running_hash = own, hashlib.sha256(ids.encode())
                else:
                    running_hash.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, running_hash.hexdigest())], columns=[*NODE, "ends_sha256"])

    texts = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(join, "depth long, h1 long, h2 long, task long, part long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "task", "part").select(*NODE, "ids").mapInPandas(digest, "depth long, h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The trie of all rebuilt ``conversations`` (conv_id, turn, role, text), a row per node.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns go by turn (null first), then role and text; a null role or text is empty, repeated rows are
    turns of their own, rows without conv_id take no part, other columns are left out, texts of any length count whole, and an empty table gives no rows (not even a root). A conversation may have no turns left: it is at the root.
    Below zero the group's first conversation is that towards zero.

    With B the bytes of a sequence's texts, and each node's text told to the smallest conversation that has it, what a subtree saves is the bytes of its members' texts from there on, less those of its distinct texts: both are sums over the
    weighted sequences that pass, so nothing goes from each node to all its ancestors. Sequences longer than ``hot`` and parents of more children are dealt over tasks when they are joined.
    """
    convs, turns = rebuilt(conversations, hot)
    every = settle(prefixes(settle(convs), turns))
    # whole sequences: conversations that are equal become one, known by its smallest member
    ends = settle(every.groupBy("conv_id").agg(F.max(F.struct(*NODE, "upto")).alias("e")).select("conv_id", "e.*"))
    sequences = settle(ends.groupBy(*NODE).agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.max("upto").alias("total")))
    sizes = sequences.select("seq", (F.col("depth") + 1).alias("n"))
    of_sequence = sequences.select("seq", "weight", "total", F.col("depth").alias("length"))
    paths = settle(join_spread(every.withColumnRenamed("conv_id", "seq"), of_sequence, "seq", sizes, hot))
    # leaves: sequences that are no other's proper prefix
    proper = paths.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("seq", F.lit(1).alias("leaf"))
    # each sequence's own nodes, those whose smallest member it is, are the last ones of its path: the bytes from there on
    smallest = paths.groupBy(*NODE).agg(F.min("seq").alias("seq"), F.max(F.col("upto") - F.col("bytes")).alias("before"))
    begins = smallest.groupBy("seq").agg(F.min(F.struct("depth", "before")).alias("b"))
    own = sequences.select("seq", "total").join(begins, "seq", "left").join(leaves, "seq", "left")
    own = settle(own.select("seq", F.coalesce(F.col("total") - F.col("b.before"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    nodes = (
        join_spread(paths, own, "seq", sizes, hot).groupBy(*NODE)
        .agg(
            F.min(F.struct("seq", "own", "total")).alias("m"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("total")).alias("all"), F.sum("own").alias("distinct"), F.max(F.col("upto") - F.col("bytes")).alias("before"),
        )
    )
    said = F.col("all") - F.col("n_convs") * F.col("before")
    distinct = F.col("distinct") - F.col("m.own") + F.col("m.total") - F.col("before")
    nodes = settle(nodes.select(*NODE, "p1", "p2", F.col("m.seq").alias("conv_id"), "n_convs", "n_leaves", (said - distinct).alias("saved_tokens")))
    at, up = F.struct(*NODE), F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    children = settle(nodes.where("depth > 0").groupBy(up.alias("node")).agg(F.count("*").alias("n")))
    parents = nodes.select(at.alias("node"), F.col("conv_id").alias("parent_conv_id"))
    below = join_spread(nodes.where("depth > 0").withColumn("node", up), parents, "node", children, hot).drop("node")
    whole = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).withColumn("node", at)
    whole = whole.join(children, "node", "left").join(end_lists(ends), NODE, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same in DuckDB SQL: a prefix is spelled out as the digests of its turns, and each node is told to all its ancestors.
ORACLE = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS pos, sha256(coalesce(role, '')) || sha256(coalesce("text", '')) AS said, strlen(coalesce("text", '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, max(pos) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h FROM t GROUP BY c),
k AS (SELECT l.c, l.c - l.c % 5 AS b, l.h, least(l.h, coalesce(f.n, 0)) AS k FROM l LEFT JOIN l f ON f.c = l.c - l.c % 5),
r AS (SELECT k.c, pos AS d, said, bytes FROM k JOIN t ON t.c = k.b AND pos <= k.k UNION ALL SELECT k.c, pos - h + k.k, said, bytes FROM k JOIN t ON t.c = k.c AND pos > h),
p AS (SELECT c, d, string_agg(said, '') OVER (PARTITION BY c ORDER BY d) AS s, bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
n AS (SELECT s, max(d) AS d, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY s),
e AS (SELECT s, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(s, d) AS s FROM p GROUP BY c) GROUP BY s),
kids AS (SELECT left(s, 128 * (d - 1)) AS s, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
sub AS (SELECT left(v.s, 128 * i) AS s, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE kids.s IS NULL) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM n) v LEFT JOIN kids ON kids.s = v.s GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN sub USING (s) LEFT JOIN kids USING (s) LEFT JOIN e USING (s) LEFT JOIN n up ON n.d > 0 AND up.s = left(n.s, 128 * (n.d - 1))"""
