"""Nearest neighbours by largest inner product: adaptive dimension scan of rotated vectors within probed lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_by_hash, settle

#: The index is fitted on about so many distinct vectors (a sample by hash of their id); all vectors are indexed.
SAMPLE = 20_000
MOST_LISTS = 1024
ROWS_PER_LIST = 256
ROUNDS = 10
#: Rotated dimensions per column block, and shares of the blocks after which candidates are tested.
BLOCK, TESTS = 4, (0.3, 0.5, 0.7, 0.85, 1.0)
#: A test abandons a candidate that would see so low a partial product with this chance, were it at the bound: about 2 %.
QUANTILE = 2.05
#: The bound is the level above which this many times k of all vectors are expected. Tails of real products are lighter than the normal ones that this is told by, the more so the
#: farther out they are; queries that find fewer than k ask again for the second number, and then without a bound.
BOUND_TIMES = (4.0, 32.0)
#: Share of a query's neighbours that unprobed lists may be expected to hold.
MISS = 0.005
#: Rows, and queries, that meet in one task; smaller tables are cut into ``CHUNKS`` chunks, of 1,024 rows at least.
CHUNK_ROWS, CHUNK_QUERIES, CHUNKS = 8192, 8192, 32
#: Rows, and queries, of a task that are scanned at a time.
TILE_ROWS, TILE_QUERIES = 2048, 1024
#: Once so small a share of a tile's pairs is left, those are gone on with one by one.
FEW_LEFT = 0.06


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows in double precision; shorter ones end in zeros, which leaves inner products as they are."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution (a rational approximation, absolute error below 1e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, erfc / 2, 1 - erfc / 2)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, also where squares would fall below or go beyond doubles; 1 for zero rows."""
    most = np.abs(x).max(axis=1, initial=0)
    most = np.where(most > 0, most, 1.0)
    length = most * np.linalg.norm(x / most[:, None], axis=1)
    return np.where(length > 0, length, 1.0)


class Asking:
    """Queries made ready for scans: of length 1, rotated, with the order of their column blocks, and the variance of the product over the blocks up to each test.

    Neither depends on the list that is scanned, so this is worked out once for all lists of a task.
    """

    def __init__(self, index: Index, q: np.ndarray, bound: np.ndarray):
        self.length = _norms(q) * index.unit
        u = index.blocks(q @ index.rotation / _norms(q)[:, None])
        vary = (u**2 * index.vary).reshape(len(q), -1, BLOCK).sum(axis=2)
        self.order = np.argsort(-vary, axis=1, kind="stable")
        self.place = np.argsort(self.order, axis=1)
        self.upto_vary = np.cumsum(np.take_along_axis(vary, self.order, axis=1), axis=1)[:, index.upto - 1]
        self.columns = (self.order[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(len(q), -1)
        self.exact, self.u = u, u.astype(np.float32)
        self.ordered = np.take_along_axis(self.u, self.columns, axis=1)
        self.tighten(bound)

    def tighten(self, bound: np.ndarray) -> None:
        self.bound = bound / self.length

    def some(self, at: np.ndarray) -> Asking:
        own = object.__new__(Asking)
        own.__dict__ = {name: values[at] for name, values in self.__dict__.items()}
        return own


class Index:
    """What is fitted: norm bound, list centres with their sample counts and spreads, and the rotation to the main axes of what differs from the centres.

    With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0): then the nearest is the one with the largest inner product.
    Lists are the nearest centres of these lifted vectors.
    """

    def __init__(self, sample: np.ndarray, largest: float, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.largest = sample.shape[1], largest
        lifted = self.lift(sample)
        centres = lifted[rng.permutation(len(lifted))[:lists]]
        for _ in range(ROUNDS):
            own = self.nearest_centre(lifted, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, lifted)
            count = np.bincount(own, minlength=len(centres))
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        own = self.nearest_centre(lifted, centres)
        self.centres, self.count = centres, np.bincount(own, minlength=len(centres))
        apart = sample - centres[own, : self.dim]
        each = (apart**2).sum(axis=1)
        overall = each.mean() if len(each) else 1.0
        self.spread = np.sqrt((np.bincount(own, weights=each, minlength=len(centres)) + overall) / (self.count + 1) / self.dim) + 1e-12
        scale, axes = np.linalg.eigh(apart.T @ apart / max(1, len(apart)))
        self.rotation, self.scale = np.ascontiguousarray(axes[:, ::-1]), np.maximum(scale[::-1], 0) + 1e-12
        # scans take vectors divided by the largest norm (and queries by their own), in single precision: rounding errors of a whole product lie below the slack
        self.unit, self.slack = largest or 1.0, 6e-8 * (self.dim + 4)
        self.vary, self.turned = self.blocks(self.scale[None] / self.unit**2), self.blocks(centres[:, : self.dim] @ self.rotation / self.unit)
        n = self.vary.shape[1] // BLOCK
        #: Column blocks that each test has behind it.
        self.upto = np.array([n if share == 1 else max(1, round(share * n)) for share in TESTS])
        #: Pairs that scans have begun with, and that were left after each test.
        self.left = np.zeros(len(TESTS) + 1, dtype=np.int64)

    @staticmethod
    def nearest_centre(lifted: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = (centres**2).sum(axis=1) / 2
        return np.concatenate([np.argmax(lifted[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(lifted), 4096)] or [np.zeros(0, dtype=np.int64)])

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.largest**2 - (x**2).sum(axis=1), 0))[:, None]])

    @staticmethod
    def blocks(x: np.ndarray) -> np.ndarray:
        """``x`` with columns of zeros up to whole blocks."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % BLOCK)))

    def turn(self, x: np.ndarray) -> np.ndarray:
        return self.blocks(x @ self.rotation / self.unit).astype(np.float32)

    def hits(self, q: np.ndarray, level: np.ndarray, lists: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Per query and list the share of all vectors that lie in this list and above ``level``. Inner products with a list's members are taken as normal around that with its centre."""
        middle, scale = q @ self.centres[lists, : self.dim].T, np.linalg.norm(q, axis=1)[:, None] * self.spread[lists]
        return _tail((level[:, None] - middle) / scale) * (self.count[lists] / max(1, self.count.sum()))

    def level(self, q: np.ndarray, of: float) -> np.ndarray:
        """The level of inner products above which a share ``of`` of all vectors is expected, found by bisection."""
        middle = q @ self.centres[:, : self.dim].T
        scale = np.linalg.norm(q, axis=1)[:, None] * self.spread
        share = self.count / max(1, self.count.sum())
        low, high = (middle - 9 * scale).min(axis=1), (middle + 9 * scale).max(axis=1)
        for _ in range(40):
            at = (low + high) / 2
            more = (_tail((at[:, None] - middle) / scale) * share).sum(axis=1) > of
            low, high = np.where(more, at, low), np.where(more, high, at)
        return low

    def probes(self, q: np.ndarray, k: float, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists to probe for each query (a table of queries by lists), which are those whose hits above a level reach ``cut``; the level and the cut.

        ``k`` is a share of all vectors. Lists are probed by their expected number of the k nearest, until the rest holds less than ``miss`` of them.
        """
        level = self.level(q, min(0.5, k))
        hits = self.hits(q, level)
        down = -np.sort(-hits, axis=1)
        held = np.cumsum(down, axis=1)
        last = np.minimum((held < (1 - miss) * held[:, -1:]).sum(axis=1), down.shape[1] - 1)
        cut = np.take_along_axis(down, last[:, None], axis=1)[:, 0] * (1 - 1e-9)
        return hits >= cut[:, None], level, cut

    def scan(self, q: np.ndarray, x: np.ndarray, bound: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that no test abandons, for the members ``x`` of list ``own`` and bounds on the inner product."""
        return self.meet(Asking(self, q, bound), self.turn(x), own)

    def meet(self, asking: Asking, y: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """``scan``, of what is made ready.

        Each query goes through the column blocks from the one that its products vary with most. With P the whole product, of mean m and variance V over the list's members, the part
        P_d over the blocks so far (m_d, V_d) is normal given P: around m_d + (P - m) w, with variance V_d (1 - w), w = V_d / V. A test rejects that P is at the bound.
        While many pairs are left, a block is added for all candidates of those queries that it comes next for; then each pair that is left takes its query's next columns.
        """
        u, place, n = asking.u, asking.place, len(y)
        mean = (asking.exact * self.turned[own]).reshape(len(u), -1, BLOCK).sum(axis=2)
        mean = np.cumsum(np.take_along_axis(mean, asking.order, axis=1), axis=1)[:, self.upto - 1]
        across = np.ascontiguousarray(y.T)
        grid = np.zeros((len(u), n), dtype=np.float32)
        alive = rows = cols = partial = None
        begun = 0
        self.left[0] += grid.size
        for k, upto in enumerate(self.upto):
            part = asking.upto_vary[:, k]
            w = part / asking.upto_vary[:, -1]
            least = (asking.bound - self.slack if upto == self.upto[-1] else mean[:, k] + (asking.bound - mean[:, -1]) * w - QUANTILE * np.sqrt(part * np.maximum(1 - w, 0)) - self.slack).astype(np.float32)
            if rows is None:
                due = (place >= begun) & (place < upto)  # blocks that come now, by query
                for b in range(place.shape[1]):
                    if len(at := np.flatnonzero(due[:, b])):
                        block = slice(b * BLOCK, (b + 1) * BLOCK)
                        grid[at] += u[at, block] @ across[block]
                now = grid >= least[:, None]
                alive = now if alive is None else np.logical_and(alive, now, out=alive)
                left = np.count_nonzero(alive)
                if left <= FEW_LEFT * alive.size or upto == self.upto[-1]:
                    flat = np.flatnonzero(alive)
                    (rows, cols), partial = np.divmod(flat, max(1, n)), grid.ravel()[flat]
            else:
                some = slice(begun * BLOCK, upto * BLOCK)
                for i in range(0, len(rows), 65536):
                    r, c = rows[i : i + 65536], cols[i : i + 65536]
                    partial[i : i + 65536] += np.einsum("ij,ij->i", asking.ordered[r, some], y[c[:, None], asking.columns[r, some]])
                stay = partial >= least[rows]
                rows, cols, partial = rows[stay], cols[stay], partial[stay]
                left = len(rows)
            self.left[k + 1] += left
            begun = upto
        return rows, cols

    def search(self, q: np.ndarray, x: np.ndarray, lists: np.ndarray, bound: np.ndarray, level: np.ndarray, cut: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best found of each query (query, candidate, inner product in double precision) among candidates ``x`` of ``lists`` (in order), from the lists that it probes.

        What a query has found so far raises its bound.
        """
        asking, y, bound = Asking(self, q, bound), self.turn(x), bound.copy()
        rows, cols, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        probed = self.hits(q, level, lists[starts]) >= cut[:, None]
        for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(lists)], strict=True)):
            due = np.flatnonzero(probed[:, i])
            for a in range(0, len(due), TILE_QUERIES):
                tile = due[a : a + TILE_QUERIES]
                for b in range(start, end, TILE_ROWS):
                    r, c = self.meet(asking.some(tile), y[b : min(end, b + TILE_ROWS)], lists[start])
                    r, c = tile[r], c + b
                    each = [np.einsum("ij,ij->i", q[r[j : j + 65536]], x[c[j : j + 65536]]) for j in range(0, len(r), 65536)]
                    rows, cols, score = np.concatenate([rows, r]), np.concatenate([cols, c]), np.concatenate([score, *each])
                    if len(rows) > 4 * k * len(q):
                        best = _top(rows, score, ids[cols], k)
                        rows, cols, score = rows[best], cols[best], score[best]
                        full = np.bincount(rows, minlength=len(q)) == k
                        worst = np.full(len(q), np.inf)
                        np.minimum.at(worst, rows, score)
                        bound = np.where(full, np.maximum(bound, worst), bound)
                        asking.tighten(bound)
        best = _top(rows, score, ids[cols], k)
        return rows[best], cols[best], score[best]


def _top(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: score down, then id up."""
    order = np.lexsort((ids, -score, rows))
    ranked = rows[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0)) if len(ranked) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(ranked)) - start < k]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, miss: float = MISS, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) found nearest to each whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision on the original vectors,
    largest first, ties to the smaller vec_id; never the query's own vec_id. Equal vectors are searched once and keep their k + 1 smallest ids,
    which is all that ranks can reach. Rows without vec_id, or whose vector is null, zero or has null or non-finite
    components, take no part; repeated rows count once; vectors shorter than others count as ending in zeros; other columns are left out. Empty tables give no rows.
    Queries that bounds and probes leave with fewer than k start again over all lists, with a lower bound and then without.
    """
    spark = vectors.sparkSession
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(whole)
    # ids are made distinct first (copies of a row meet within tasks); then each vector keeps its k + 1 smallest ids
    least = Window.partitionBy("v").orderBy("vec_id")
    few = valid.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    reps = settle(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    queries = settle(valid.where(F.col("vec_id") % every == 0).distinct().join(reps.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"))

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    n, largest, dim = reps.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = sample_by_hash(reps.select("rep", "v"), sample, "rep").toPandas().sort_values("rep")
    index = Index(matrix(fitted["v"], dim), float(largest), max(1, min(MOST_LISTS, len(fitted) // 8, n // ROWS_PER_LIST)))
    shared = spark.sparkContext.broadcast(index)
    vector = reps.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=own.nearest_centre(own.lift(matrix(pdf["v"], dim)), own.centres))

    members = settle(reps.select("rep", "v").mapInPandas(assign, f"rep long, v {vector}, list long"))
    # one row a list, and there are at most MOST_LISTS; lists lie one after the other in chunks of ``chunk_rows``, a long one in several
    sizes = sorted(members.groupBy("list").count().collect())
    ends = np.cumsum([size for _, size in sizes])
    chunk_rows = min(chunk_rows, max(1024, -(-n // CHUNKS)))
    chunks = -(-n // chunk_rows)
    spans = [(own, int(end - size), size) for (own, size), end in zip(sizes, ends, strict=True)]
    starts = F.broadcast(spark.createDataFrame(spans, "list long, start long, size long"))
    chunk = F.floor((F.col("start") + F.pmod(F.xxhash64("rep"), "size")) / chunk_rows).cast("int").alias("chunk")
    # chunks that hold rows of a list
    held_in = {own: range(start // chunk_rows, (start + size - 1) // chunk_rows + 1) for own, start, size in spans}

    def probe(times: float | None, within: float | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Queries with a bound (``times``) or without, the chunks they go to, and what tells which lists they probe there (all, without ``within``)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    q = matrix(part["v"], dim)
                    # the query itself is among the vectors, so one more than k
                    bound = own.level(q, min(0.75, times * (k + 1) / n)) if times else np.full(len(q), -np.inf)
                    if within is None:
                        level, cut, to = np.zeros(len(q)), np.full(len(q), -1.0), [range(chunks)] * len(q)
                    else:
                        probed, level, cut = own.probes(q, (k + 1) / n, within)
                        to = [{c for i in np.flatnonzero(row) for c in held_in.get(i, ())} for row in probed]
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "v": part["v"].to_numpy(), "bound": bound, "level": level, "cut": cut, "chunks": [sorted(c) for c in to]})

        return run

    def search(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asking):
            return pd.DataFrame({"asked": [], "rep": [], "score": []})
        held = held.sort_values("list", kind="stable")
        ids = held["rep"].to_numpy()
        rows, cols, score = shared.value.search(matrix(asking["v"], dim), matrix(held["v"], dim), held["list"].to_numpy(), *[asking[c].to_numpy() for c in ("bound", "level", "cut")], ids, k + 1)
        return pd.DataFrame({"asked": asking["rep"].to_numpy()[rows], "rep": ids[cols], "score": score})

    def scan(asked: DataFrame, how: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
        """Meet queries ``asked`` (rep, v) with the chunks that hold lists which they probe: a task has at most about ``chunk_rows`` rows and ``chunk_queries`` queries, whose vectors travel once for all lists of a chunk."""
        blocks = max(1, -(-asked.count() // chunk_queries))
        ready = asked.mapInPandas(how, f"rep long, v {vector}, bound double, level double, cut double, chunks array<int>")
        left = ready.select(F.explode("chunks").alias("chunk"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), "rep", "v", "bound", "level", "cut")
        right = members.join(starts, "list").select(chunk, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "list", "rep", "v")
        keys = ["chunk", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "asked long, rep long, score double")

    searched = settle(reps.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v"))
    first, second = BOUND_TIMES
    found = settle(scan(searched, probe(first, miss)))
    # what bound and probes left with too few starts again over all lists, from a lower bound, and at last without one
    for times in (second, None):
        enough = found.groupBy("asked").count().where(F.col("count") >= min(k + 1, n)).select(F.col("asked").alias("rep"))
        short = settle(searched.join(enough, "rep", "left_anti"))
        if short.isEmpty():
            break
        found = settle(found.join(short.select(F.col("rep").alias("asked")), "asked", "left_anti").unionByName(scan(short, probe(times, None))))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    spelled = ranked.join(reps.select("rep", "ids"), "rep").select("asked", F.explode("ids").alias("vec_id"), "score")
    lists = spelled.groupBy("asked").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("best"))
    answers = queries.join(settle(lists), queries["rep"] == F.col("asked"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
