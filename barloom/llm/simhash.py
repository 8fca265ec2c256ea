"""SimHash near-duplicates through a Gray-order hierarchical index of fingerprints."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_spread, settle
from .components import components, join

BITS = 64
RADIUS = 3
#: Fingerprints that an upper node should hold: masks get as many bits as that takes.
NODE = 8192
#: More fingerprints than this in one upper node are compared by pairs of chunks, in tasks of their own.
NODE_CAP = 32_768
#: Children of a node of the Gray index, pairs of nodes compared at a time, and rows that a task takes.
FAN, BATCH, TASK_ROWS = 4, 1 << 16, 1 << 16
#: The pipeline's contract: word shingles of this length, linked from this Jaccard similarity on.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: Candidates that fingerprints can't reach: texts that agree on all minima of a band of shingle hashes. At Jaccard 0.8 some band agrees with a chance of 0.9996.
BANDS, BAND_ROWS = 20, 5
#: The share of all minima that a pair must have in common to be confirmed exactly: at Jaccard 0.8 a chance of 0.9999.
LEAST_SHARE = 0.65
#: Texts of a bucket, and bytes of their shingles, that meet in one task; larger buckets are compared by pairs of chunks. Pairs with one text are dealt over tasks by so many.
BUCKET_CAP, BUCKET_BYTES, PAIRS = 2048, 32 << 20, 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit int: lower-cased A-Z, words between ASCII spaces."""
    hashes = shingle_hashes(text, words)
    return fold(hashes) if len(hashes) else 0


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=">u8")
    whole = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], 42) for s, e in zip(starts, last)), dtype=">u8", count=len(last))  # noqa: B905


def fold(hashes: np.ndarray) -> int:
    """The majority of each bit."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: str = "text", words: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; a null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(F.col(text).cast("string"))


_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of ``BANDS`` x ``BAND_ROWS`` permutations of the shingle hashes; texts without words share theirs."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)].astype(np.uint64)
        least = np.minimum(least, ((part ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One signed key for each band of minima."""
    digest = xxhash.xxh64_intdigest
    return [(x ^ (1 << 63)) - (1 << 63) for x in (digest(row.tobytes(), 42) for row in least.reshape(BANDS, BAND_ROWS))]


def _sketch_column(text: str, words: int) -> Column:
    """Struct (fp, bands, share) of a text column; ``share`` has a byte of each minimum."""

    @F.pandas_udf("fp long, bands array<long>, share binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, words) for t in texts]
        prints = np.array([fold(h) if len(h) else 0 for h in hashes], dtype=np.uint64).view(np.int64)
        least = [minima(h) for h in hashes]
        return pd.DataFrame({"fp": prints, "bands": [band_keys(m) for m in least], "share": [(m >> np.uint64(40)).astype(np.uint8).tobytes() for m in least]})

    return of(F.col(text).cast("string"))


def _set_column(text: str, words: int) -> Column:
    """The distinct shingle hashes of a text column, in order."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words).astype(np.uint64).view(np.int64)) for t in texts], dtype=object)

    return of(F.col(text).cast("string"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray code sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits on which all below them agree.

    Level 0 has the fingerprints; each node of a higher level stands for ``FAN`` consecutive nodes of the level below, as
    (mask of shared bits, pattern). Neighbours in Gray order differ in few bits, so masks are wide, and those of a node's children hold its
    own: differences add up on the way down. A pair of nodes goes, with all pairs below it, once they exceed the radius.
    """

    def __init__(self, words: np.ndarray):
        self.words = words[np.argsort(gray_rank(words), kind="stable")]
        self.levels = [(np.full(len(words), ~np.uint64(0)), self.words)]
        #: Pairs of fingerprints, and of nodes, that searches have compared.
        self.compared = self.tested = 0
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            all_one = np.bitwise_and.reduceat(pattern & mask, at)
            all_zero = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((all_one | all_zero, all_one))

    def near(self, word: np.uint64, radius: int) -> np.ndarray:
        """Positions, in Gray order, of the fingerprints within ``radius``."""
        mask, pattern = self.levels[-1]
        found = np.flatnonzero(np.bitwise_count((pattern ^ word) & mask) <= radius)
        for mask, pattern in self.levels[-2::-1]:
            below = (found[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < len(mask)]
            found = below[np.bitwise_count((pattern[below] ^ word) & mask[below]) <= radius]
        return found

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join what is connected within ``radius`` (each fingerprint to one of its component), not all pairs.

        The index is searched with itself, from pairs of top nodes down, in batches; pairs of nodes whose fingerprints all are in one component already go too.
        """
        root = np.arange(len(self.words))
        one: list[np.ndarray] | None = None
        stack = [(len(self.levels) - 1, *np.triu_indices(len(self.levels[-1][0])))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > BATCH:
                stack.append((level, a[BATCH:], b[BATCH:]))
                a, b = a[:BATCH], b[:BATCH]
            mask, pattern = self.levels[level]
            if level == 0:
                a, b = a[a != b], b[a != b]
                self.compared += len(a)
                hit = np.bitwise_count(pattern[a] ^ pattern[b]) <= radius
                if join(root, a[hit], b[hit]):
                    one = None
                continue
            if one is None:
                one = [self._one(root, k) for k in range(len(self.levels))]
            self.tested += len(a)
            keep = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
            keep &= (one[level][a] < 0) | (one[level][a] != one[level][b])
            a, b = a[keep], b[keep]
            step = np.arange(FAN)
            below_a = np.repeat(a[:, None] * FAN + step, FAN, axis=1).ravel()
            below_b = np.tile(b[:, None] * FAN + step, FAN).ravel()
            keep = (below_a < len(self.levels[level - 1][0])) & (below_b < len(self.levels[level - 1][0])) & ((below_a <= below_b) | np.repeat(a != b, FAN * FAN))
            stack.append((level - 1, below_a[keep], below_b[keep]))
        child = np.flatnonzero(root != np.arange(len(root)))
        return self.words[child], self.words[root[child]]

    def _one(self, root: np.ndarray, level: int) -> np.ndarray:
        """The component that all fingerprints below each node of ``level`` are in, or -1."""
        at = np.arange(0, len(root), FAN**level)
        least = np.minimum.reduceat(root, at)
        return np.where(least == np.maximum.reduceat(root, at), least, -1)


def upper_masks(radius: int = RADIUS, blocks: int = RADIUS + 1, bits: int = BITS) -> list[int]:
    """Masks of the index's upper nodes: ``bits`` (at most all) of every choice of ``blocks`` - ``radius`` of equal blocks of bits.

    Fingerprints within ``radius`` differ in at most ``radius`` blocks, so they agree on at least one mask.
    """
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    each = -(-bits // (blocks - radius))
    parts = [((1 << min(edges[i + 1], edges[i] + each)) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return sorted({sum(c) for c in combinations(parts, blocks - radius)})


def layout(n: int, radius: int = RADIUS, node: int = NODE) -> tuple[int, int]:
    """Blocks, and bits of a mask, for upper nodes of about ``node`` of ``n`` fingerprints; up to ``node`` there is one upper node."""
    bits, blocks = max(0, math.ceil(math.log2(max(1, n) / node))), radius + 1
    while (blocks - radius) * (BITS // blocks) < bits and blocks < 2 * radius + 2:
        blocks += 1
    return blocks, bits


def _grouped(batches: Iterator[pd.DataFrame], columns: list[str], use: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``use`` of rows with whole groups of ``columns``, and where these start, from batches sorted by them; holds one batch and one group."""
    kept: pd.DataFrame | None = None  # rows of the group that the next batch may go on with
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        values = pdf[columns].to_numpy()
        starts = np.r_[0, np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1]
        kept = pdf.iloc[starts[-1] :]
        if len(starts) > 1:
            yield use(pdf.iloc[: starts[-1]], starts[:-1])
    if kept is not None:
        yield use(kept, np.zeros(1, dtype=np.int64))


def _dealt(rows: DataFrame, key: str, group: list[str], parts: Column) -> DataFrame:
    """``rows`` with i and j: groups are dealt by ``key`` into chunks, as many as the aggregate ``parts`` says (more than one), and meet as pairs of them. No pair of rows is left out."""
    large = rows.groupBy(*group).agg(F.ceil(parts).alias("chunks")).where("chunks > 1")
    dealt = rows.join(large, group, "left").withColumn("own", F.pmod(F.xxhash64(key), F.coalesce("chunks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)).alias("other")
    return dealt.select(*rows.columns, "own", other).select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def linked_fingerprints(words: DataFrame, radius: int = RADIUS, cap: int = NODE_CAP, node: int = NODE, task_rows: int = TASK_ROWS) -> DataFrame:
    """``words`` (fp; distinct) to links (a, b) that connect all fingerprints at most ``radius`` bits apart.

    The upper nodes of the index are (mask, shared pattern), of about ``node`` fingerprints whatever their number; each is searched by a Gray index of its own.
    One with more than ``cap`` is dealt into chunks and searched by pairs of chunks; no pair is left out.
    """
    total = words.count()
    masks = upper_masks(radius, *layout(total, radius, node))
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    keyed = words.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "pattern"))
    columns = ["mask", "pattern", "i", "j"]
    dealt = _dealt(keyed, "fp", columns[:2], F.count("*") / cap)

    def link(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found = [GrayIndex(part).forest(radius) for part in np.split(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), starts[1:])]
        return pd.DataFrame({"a": np.concatenate([a for a, _ in found]).view(np.int64), "b": np.concatenate([b for _, b in found]).view(np.int64)})

    # rows are few bytes and much work: a number of tasks that is asked for isn't coalesced
    tasks = max(1, -(-total * len(masks) // task_rows))
    return dealt.repartition(tasks, *columns).sortWithinPartitions(*columns).mapInPandas(lambda batches: _grouped(batches, columns, link), "a long, b long")


def roots(words: DataFrame, radius: int = RADIUS, cap: int = NODE_CAP) -> DataFrame:
    """``words`` (fp; distinct) to (fp, root) for those with a neighbour."""
    return components(linked_fingerprints(words, radius, cap)).toDF("fp", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3, cap: int = NODE_CAP, hot: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated. A null
    doc_id counts only where its whole component has no other id (then component_id is null). Very long texts are read whole; other columns are
    left out. An empty table gives no rows.
    """
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text", words).alias("fp")))
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rooted = distinct.join(roots(distinct.select("fp"), radius, cap), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = settle(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return join_spread(rows, of, "fp", distinct.select("fp", "n"), hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_keys(docs: DataFrame) -> list[Column]:
    # two hashes of the whole row stand for it: plain keys, so that the join's dealing serves the last step as well
    each = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    return [F.xxhash64(*each), F.xxhash64(F.lit("b"), *[F.coalesce(c, F.lit("")) for c in each])]


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first (smallest _id, nulls last) in each root of ``found`` (root, _id, _a, _b)."""
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_a", "_b"))
    return _rows_of(docs, found.groupBy("root").agg(first.alias("k")).select("k._a", "k._b").distinct())


def _rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``keys`` (pairs of row keys). Columns that are added for the join have names of their own."""
    own = [f"key {uuid.uuid4().hex}" for _ in range(2)]
    kept = docs.withColumns(dict(zip(own, _row_keys(docs), strict=True))).join(keys.toDF(*own), own, "left_semi").dropDuplicates(own)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    a, b = _row_keys(docs)
    return settle(docs.select(F.col("doc_id").alias("_id"), a.alias("_a"), b.alias("_b"), *more))


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = 3, cap: int = NODE_CAP) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest doc_id (nulls last), once, with its columns as they were, whatever their names."""
    rows = _rows(docs, fingerprint_column("text", words).alias("fp"))
    found = rows.join(roots(settle(rows.select("fp").distinct()), radius, cap), "fp", "left")
    return _first_of_each(docs, found.withColumn("root", F.coalesce("root", "fp")))


def _same() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _confirmed(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b: hashes of texts) whose ``sets`` (same, s) of shingles have a Jaccard similarity of ``least`` or more."""
    fans = settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("fans")))
    right = sets.select(F.col("same").alias("b"), F.col("s").alias("t")).join(fans, "b").withColumn("fan", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1))).drop("fans")
    left = pairs.join(fans, "b").withColumn("fan", F.pmod(F.xxhash64("a"), F.col("fans"))).drop("fans").join(sets.select(F.col("same").alias("a"), "s"), "a")
    both = left.join(right, ["b", "fan"]).withColumn("common", F.size(F.array_intersect("s", "t")))
    union = F.size("s") + F.size("t") - F.col("common")
    return settle(both.where(F.col("common") >= F.lit(least) * union - 1e-9).select("a", "b"))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted arrays) have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    if not len(a):
        return True
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def links_within(own: np.ndarray, share: np.ndarray, sets: list[np.ndarray], least: float, step: int = 64) -> list[tuple[int, int]]:
    """Pairs of similar texts that connect all that similar pairs connect, given that texts of the same ``own`` are connected already.

    Candidates have ``LEAST_SHARE`` of the minima in common. Of each component the one most alike another is confirmed, then the next, until no candidate is left between two
    components. So what is similar to one of its component isn't compared with all.
    """
    root = np.arange(int(own.max()) + 1)
    links: list[tuple[int, int]] = []
    for at in range(0, len(own), step):
        score = (share[at : at + step, None, :] == share[None, at:, :]).mean(axis=2)
        i, j = np.nonzero((score >= LEAST_SHARE) & (root[own[at : at + step, None]] != root[own[None, at:]]))
        i, j, score = i[j > i], j[j > i], score[i[j > i], j[j > i]]
        order = np.argsort(-score, kind="stable")
        i, j = i[order] + at, j[order] + at
        while len(i):
            a, b = root[own[i]], root[own[j]]
            i, j, high = i[a != b], j[a != b], np.maximum(a, b)[a != b]
            best = np.unique(high, return_index=True)[1]
            good = [k for k in best.tolist() if similar(sets[i[k]], sets[j[k]], least)]
            links += [(int(i[k]), int(j[k])) for k in good]
            join(root, own[i[good]], own[j[good]])
            i, j = np.delete(i, best), np.delete(j, best)
    return links


def met_first(own: np.ndarray, share: np.ndarray, bands: np.ndarray, band: int, step: int = 64) -> np.ndarray:
    """Places of a bucket of ``band`` that some pair needs there: both have ``LEAST_SHARE`` of the minima in common, are of different ``own``, and agree on no band before this one, whose bucket has them as well."""
    used = np.zeros(len(own), dtype=bool)
    if (own == own[:1]).all():
        return np.flatnonzero(used)
    for at in range(0, len(own), step):
        apart = own[at : at + step, None] != own[None, at:]
        i, j = np.nonzero(apart & ((share[at : at + step, None, :] == share[None, at:, :]).mean(axis=2) >= LEAST_SHARE))
        i, j = i[j > i] + at, j[j > i] + at
        for first in range(0, len(i), 1 << 16):
            a, b = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
            new = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
            used[a[new]] = used[b[new]] = True
    return np.flatnonzero(used)


def _needed(members: DataFrame, texts: DataFrame, cap: int) -> DataFrame:
    """Of ``members`` (band, value, same, root) those that ``met_first`` says. Only minima and bands travel for that, a few hundred bytes a row, so that the sets of shingles needn't travel once for each bucket."""
    columns = ["band", "value", "i", "j"]
    dealt = settle(_dealt(members, "same", columns[:2], F.count("*") / cap))

    def pick(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        root, band = pdf["root"].to_numpy(), pdf["band"].to_numpy()
        share = np.frombuffer(b"".join(pdf["share"]), dtype=np.uint8).reshape(len(pdf), -1)
        bands = np.stack(pdf["bands"].to_list())
        found = [first + met_first(root[first:end], share[first:end], bands[first:end], int(band[first])) for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True)]
        return pdf.iloc[np.concatenate(found)][["band", "value", "same", "root"]]

    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    whole = dealt.join(texts.select("same", "share", "bands"), "same").repartition(tasks, *columns).sortWithinPartitions(*columns)
    return settle(whole.mapInPandas(lambda batches: _grouped(batches, columns, pick), "band int, value long, same long, root long").distinct())


def _linked_in_buckets(held: DataFrame, texts: DataFrame, sets: DataFrame, linked: DataFrame, least: float, cap: int) -> DataFrame:
    """Similar pairs (a, b) within buckets ``held`` (band, value, same) that hold several components of ``linked`` (same, root)."""
    bucket = ["band", "value"]
    placed = settle(held.join(linked, "same", "left").withColumn("root", F.coalesce("root", "same")))
    mixed = placed.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*bucket)
    members = _needed(placed.join(mixed, bucket).select(*bucket, "same", "root"), texts, cap)
    light = members.join(sets.select("same", (F.size("s") * 8 + 200).alias("bytes")), "same")
    dealt = settle(_dealt(light, "same", bucket, F.greatest(F.count("*") / cap, F.sum("bytes") / BUCKET_BYTES)))
    columns = [*bucket, "i", "j"]

    def link(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        same, root = pdf["same"].to_numpy(), pdf["root"].to_numpy()
        share, s = np.frombuffer(b"".join(pdf["share"]), dtype=np.uint8).reshape(len(pdf), -1), pdf["s"].tolist()
        found = []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
            own = np.unique(root[first:end], return_inverse=True)[1]
            found += [(same[first + i], same[first + j]) for i, j in links_within(own, share[first:end], s[first:end], least)]
        return pd.DataFrame(found, columns=["a", "b"])

    tasks = max(1, -(-(light.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    whole = dealt.join(texts.select("same", "share"), "same").join(sets, "same")
    return whole.repartition(tasks, *columns).sortWithinPartitions(*columns).mapInPandas(lambda batches: _grouped(batches, columns, link), "a long, b long")


def keep_similar(docs: DataFrame, least: float = SIMILAR, words: int = SIMILAR_WORDS, radius: int = RADIUS, cap: int = NODE_CAP, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """The rows of ``docs`` that stay as in ``keep_one``, where texts are linked by a Jaccard similarity of ``least`` or more between their sets of word shingles.

    First come the fingerprints that the index links. 64 bits don't tell a similarity of 0.8 apart from much less, so what shares a band of minima is compared as well, wherever
    that could still connect two components. Every link is confirmed exactly. Only texts that have a candidate are shuffled for that. Texts without words are alike; null doc_ids, repeated
    rows and very long texts are rows like any other; an empty table gives no rows.
    """
    rows = _rows(docs, _same().alias("same"), _sketch_column("text", words).alias("s"))
    texts = settle(rows.select("same", "s.*").dropDuplicates(["same"]))
    prints = settle(texts.groupBy("fp").agg(F.min("same").alias("least")))
    links = linked_fingerprints(prints.select("fp"), radius, cap).distinct()
    near = links.join(prints.toDF("a", "sa"), "a").join(prints.toDF("b", "sb"), "b").select("sa", "sb")
    pairs = settle(_ordered(near.union(texts.join(prints, "fp").select("same", "least"))))
    bucket = ["band", "value"]
    keyed = texts.select("same", F.posexplode("bands").alias(*bucket))
    held = settle(keyed.join(keyed.groupBy(*bucket).count().where("count > 1").select(*bucket), bucket))
    used = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).union(held.select("same")).distinct()
    chosen = settle(rows.join(used, "same", "left_semi").groupBy("same").agg(F.min(F.struct("_a", "_b")).alias("k")).select("k.*"))
    sets = settle(_rows_of(docs, chosen).select(_same().alias("same"), _set_column("text", words).alias("s")))
    sure = _confirmed(sets, pairs, least)
    more = settle(_linked_in_buckets(held, texts, sets, components(sure).toDF("same", "root"), least, bucket_cap))
    linked = components(sure.union(more)).toDF("same", "root")
    return _first_of_each(docs, rows.join(linked, "same", "left").withColumn("root", F.coalesce("root", "same")))
