"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, links of overlapping tokens, and how often each pair of ids is linked.

Most groups are one token of each with the same bytes. A map from each A id to the B id of the same bytes tells these, and they are counted in a vector of the length of the vocabulary; only the pairs of all other groups are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty
from .packing import byte_letters, encoder

#: A pair of ids is one number: the A id above so many bits of the B id.
BITS = 15
#: Characters of texts that are aligned at once (a longer text alone).
SLICE = 1 << 20
#: Pairs that a task counts before it hands them on, and the most that are broadcast: the most frequent; all others are joined.
TASK_PAIRS, HOT_PAIRS = 1 << 20, 1 << 18
#: Pairs in a row of what a task counted.
ROW_PAIRS = 1 << 16


class Tokenizers:
    """Both tokenizers of a task: ids of texts, the bytes of every id, and the B id of the same bytes for every A id (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        plain = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in letters for c in piece)}
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        found = plain | special
        self.bytes_a = [found.get(i, b"") for i in range(max(found) + 1)]
        self.encode_a = encoder(path_a, plain_text=True)
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_piece = lambda i: bytes([int(self.library_b.id_to_piece(i)[3:5], 16)]) if self.library_b.is_byte(i) else self.library_b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [of_piece(i) for i in range(self.library_b.get_piece_size())]
        if len(self.bytes_b) > 1 << BITS or len(self.bytes_a) >= 1 << (31 - BITS):
            raise ValueError("vocabularies are too large for pairs of 31 bits")
        self.length_a, self.length_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        # of several B ids with the same bytes the one that isn't a single byte's, which is what texts are encoded to
        ids = {x: i for i, x in reversed(list(enumerate(self.bytes_b))) if self.library_b.is_byte(i)} | {x: i for i, x in reversed(list(enumerate(self.bytes_b))) if not self.library_b.is_byte(i)}
        self.same = np.array([ids.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        spelled = lambda n, ends: [f"{i}{end}".encode() for end in ends for i in range(n)]
        self.spelled = spelled(len(self.bytes_a), ",|") + spelled(len(self.bytes_b), ",;")

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by both of each text; none where the text is empty or some tokenizer's bytes aren't those of the text after a space."""
        out = []
        for text, b in zip(texts, self.library_b.encode(texts, num_threads=1), strict=True):
            want = b" " + text.encode()
            a = self.encode_a(" " + text) if text else []
            whole = text and b"".join([self.bytes_b[i] for i in b]) == want and b"".join([self.bytes_a[i] for i in a]) == want
            out.append((a, b) if whole else ([], []))
        return out


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Aligned:
    """Tokens of texts one after the other, aligned: ``ids_a``/``ids_b``, ``group_a``/``group_b`` (the group of each token), ``link_a``/``link_b`` (the tokens that each link joins), and ``first_*``: the first one of each text, and the end."""

    def __init__(self, own: Tokenizers, pairs: list[tuple[list[int], list[int]]]):
        self.own, self.first_a, self.first_b = own, np.cumsum([0, *[len(a) for a, _ in pairs]]), np.cumsum([0, *[len(b) for _, b in pairs]])
        self.ids_a, self.ids_b = np.array([i for a, _ in pairs for i in a], dtype=np.int64), np.array([i for _, b in pairs for i in b], dtype=np.int64)
        length_a, length_b = own.length_a[self.ids_a], own.length_b[self.ids_b]
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        start_a, start_b = end_a - length_a, end_b - length_b
        common = end_a[np.isin(end_a, end_b, assume_unique=True)]
        self.group_a, self.group_b, self.groups = np.searchsorted(common, end_a), np.searchsorted(common, end_b), len(common)
        # a text ends both, so groups and links stay within it
        low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a)
        count = high - low
        self.link_a = np.repeat(np.arange(len(count)), count)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        self.first_link = np.r_[0, np.cumsum(count)][self.first_a]
        self.first_group = np.r_[self.group_a, self.groups][self.first_a]

    def pairs(self) -> np.ndarray:
        """The pair of ids of each link."""
        return (self.ids_a[self.link_a] << BITS) | self.ids_b[self.link_b]

    def identity(self) -> np.ndarray:
        """Whether each link is the only one of its group, between ids that the map of same bytes joins."""
        alone = (np.bincount(self.group_a, minlength=self.groups) == 1) & (np.bincount(self.group_b, minlength=self.groups) == 1)
        return alone[self.group_a[self.link_a]] & (self.own.same[self.ids_a[self.link_a]] == self.ids_b[self.link_b])

    def digests(self) -> list[str]:
        """For each text the SHA-256 of its groups, spelled ``a1,a2|b1;a3|b2``; empty without tokens."""
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True] if n_a else np.zeros(0, dtype=bool)
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True] if n_b else np.zeros(0, dtype=bool)
        tokens = np.empty(n_a + n_b, dtype=np.int64)
        sizes_a, sizes_b = len(self.own.bytes_a), len(self.own.bytes_b)
        tokens[np.arange(n_a) + np.searchsorted(self.group_b, self.group_a)] = self.ids_a + last_a * sizes_a
        tokens[np.arange(n_b) + np.searchsorted(self.group_a, self.group_b, side="right")] = self.ids_b + last_b * sizes_b + 2 * sizes_a
        parts, at = [self.own.spelled[i] for i in tokens.tolist()], (self.first_a + self.first_b).tolist()
        return [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's counts."""
    found, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), dtype=np.int64)
    np.add.at(out, place, counts)
    return found, out


def _slices(texts: list[str], most: int) -> Iterator[slice]:
    """Ranges of ``texts`` of at most ``most`` characters together, or one text."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t) + 1
    if held:
        yield slice(begin, len(texts))


#: What the first pass writes: documents (kind 0: the pairs of its links, and how many of each), and what a task counted, in columns of its own: identities (kind 1: A ids) and other pairs (kind 2).
FIRST = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>, counted array<int>, counts array<long>"
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(ddl: str, n: int, columns: dict) -> pa.RecordBatch:
    """``n`` rows of a schema; columns that aren't given are null."""
    kinds = dict(c.split() for c in ddl.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], ARROW[k]) if c in columns else pa.nulls(n, ARROW[k]) for c, k in kinds.items()], names=list(kinds))


def _lists(values: np.ndarray, lengths: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), values.astype(kind))


def _encode(docs: DataFrame, path_a: str, path_b: str, task_pairs: int) -> DataFrame:
    """``FIRST`` rows of ``docs``: texts are encoded and aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers(path_a, path_b)
        vector, keys, sums = np.zeros(len(own.bytes_a), dtype=np.int64), [], []
        row = TaskContext.get().partitionId() << 40

        def counted(kind: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            lengths = np.diff(np.r_[np.arange(0, len(pairs), ROW_PAIRS), len(pairs)])
            return _batch(FIRST, len(lengths), {"kind": np.full(len(lengths), kind), "counted": _lists(pairs, lengths, np.int32), "counts": _lists(counts, lengths, np.int64)})

        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for at in _slices(texts, SLICE):
                found = Aligned(own, own.ids(texts[at]))
                pair, same = found.pairs(), found.identity()
                vector += np.bincount(pair[same] >> BITS, minlength=len(vector))
                more, n = np.unique(pair[~same], return_counts=True)
                keys, sums = [*keys, more], [*sums, n]
                # each text's own pairs, in the order of the pairs
                n_docs, links = len(found.first_link) - 1, np.diff(found.first_link)
                text_pair, times = np.unique((np.repeat(np.arange(n_docs), links) << 31) | pair, return_counts=True)
                lengths = np.bincount(text_pair >> 31, minlength=n_docs)
                yield _batch(
                    FIRST, n_docs,
                    {
                        "kind": np.zeros(n_docs), "row": row + np.arange(n_docs), "doc_id": ids.slice(at.start, n_docs), "n_a": np.diff(found.first_a), "n_b": np.diff(found.first_b), "n_groups": np.diff(found.first_group), "n_links": links,
                        "groups_sha256": found.digests(), "pairs": _lists(text_pair & ((1 << 31) - 1), lengths, np.int32), "times": _lists(times, lengths, np.int64),
                    },
                )
                row += n_docs
                if sum(map(len, keys)) > task_pairs:
                    more, n = _summed(np.concatenate(keys), np.concatenate(sums))
                    keys, sums = [more], [n]
                    if len(more) > task_pairs // 2:
                        yield counted(2, more, n)
                        keys, sums = [], []
        if keys:
            yield counted(2, *_summed(np.concatenate(keys), np.concatenate(sums)))
        if len(some := np.flatnonzero(vector)):
            yield counted(1, some, vector[some])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FIRST)


def _counts(first: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): links of each pair of ids over all documents. Vectors of identities are summed by A id, and enter as one row for each."""
    own = _tokenizers(path_a, path_b)
    each = lambda kind: first.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("counted", "counts")).alias("x")).select(F.col("x.counted").alias("pair"), F.col("x.counts").alias("n"))
    # at most a number for each id of the vocabulary
    same = np.array(each(1).groupBy("pair").agg(F.sum("n")).collect(), dtype=np.int64).reshape(-1, 2)
    pairs = (same[:, 0] << BITS) | own.same[same[:, 0]]
    spark = first.sparkSession
    identities = spark.createDataFrame(pd.DataFrame({"pair": pairs.astype(np.int32), "n": same[:, 1]}), "pair int, n long")
    return settle(each(2).unionByName(identities).groupBy("pair").agg(F.sum("n").alias("n")))


def hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, ascending, with their numbers: all from some number on, and at most ``most``."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels, held, least = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True), 0, None
    for at, n in levels:
        if held + n > most:
            break
        held, least = held + n, at
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = counts.where(level >= least).toPandas().sort_values("pair")
    return found["pair"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)


def align(docs: DataFrame, path_a: str, path_b: str, most: int = HOT_PAIRS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Align every document of ``docs`` (doc_id, text) as encoded by the byte-level BPE file ``path_a`` (after a space) and the SentencePiece model ``path_b`` (which adds one).

    Returns doc_id, n_a, n_b, n_groups (between byte offsets where tokens of both end), n_links (pairs of overlapping tokens), n_best (links whose pair is as frequent over all documents as any of its B id), count_sum (links' frequencies),
    groups_sha256. Texts that are null, empty, or not what some tokenizer's bytes spell have zeros and an empty digest, and count for nothing. Strings of special tokens are plain text. Repeated rows and null doc_ids are documents like any
    other, texts of any length are encoded whole, other columns are left out, and an empty table gives no rows.

    Texts are encoded once; a document's distinct pairs are settled. Frequencies of the ``most`` most frequent pairs and of identities (a number per A id) are looked up in broadcast tables of that bound; the rest, each pair of which is rare, meets
    its frequency by a join.
    """
    spark = docs.sparkSession
    first = settle(_encode(docs, path_a, path_b, task_pairs))
    counts = _counts(first, path_a, path_b)
    a_of, b_of = F.shiftright("pair", BITS), F.col("pair").bitwiseAND((1 << BITS) - 1)
    # a number for each B id
    tops = np.array(counts.groupBy(b_of.alias("b")).agg(F.max("n")).collect(), dtype=np.int64).reshape(-1, 2)
    best = np.zeros(1 << BITS, dtype=np.int64)
    best[tops[:, 0]] = tops[:, 1]
    own = _tokenizers(path_a, path_b)
    same = spark.createDataFrame(pd.DataFrame({"a": np.arange(len(own.same)), "b": own.same}), "a int, b int").where("b >= 0")
    identities = counts.join(F.broadcast(same), (a_of == F.col("a")) & (b_of == F.col("b"))).select("a", "n").collect()  # at most a number for each A id
    vector = np.zeros(len(own.same), dtype=np.int64)
    for a, n in identities:
        vector[a] = n
    shared = spark.sparkContext.broadcast((own.same, vector, best, *hot_pairs(counts, most)))

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    seen_as = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<int>, rest_times array<long>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, vector, best, pairs, numbers = shared.value
        for batch in batches:
            n_docs, lengths = batch.num_rows, batch["pairs"].value_lengths().to_numpy()
            asked, times = batch["pairs"].flatten().to_numpy().astype(np.int64), batch["times"].flatten().to_numpy()
            doc = np.repeat(np.arange(n_docs), lengths)
            a, b = asked >> BITS, asked & ((1 << BITS) - 1)
            n = np.where(same[a] == b, vector[a], 0)
            if len(pairs):
                place = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
                n = np.where(pairs[place] == asked, numbers[place], n)
            rest, sums = n == 0, []
            for value in (np.where(n == best[b], times, 0), n * times):
                sums.append(np.zeros(n_docs, dtype=np.int64))
                np.add.at(sums[-1], doc[~rest], value[~rest])
            left = np.bincount(doc[rest], minlength=n_docs)
            yield _batch(seen_as, n_docs, {c: batch[c] for c in kept} | {"n_best": sums[0], "count_sum": sums[1], "rest": _lists(asked[rest], left, np.int32), "rest_times": _lists(times[rest], left, np.int64)})

    seen = settle(first.where("kind = 0").select(*kept, "pairs", "times").mapInArrow(look_up, seen_as))
    rest = seen.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    top = spark.createDataFrame(pd.DataFrame({"b": tops[:, 0], "top": tops[:, 1]}), "b int, top long")
    found = rest.join(counts, "pair").join(F.broadcast(top), b_of == F.col("b"))
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return seen.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")
