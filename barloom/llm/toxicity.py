"""Severity of toxic language: cumulative-link ordinal regression on sparse features of words."""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, settle

WORD = re.compile(r"\w+")
#: Bounds of the fit: labelled documents (about; each class sampled by hash of the id, up to half of them or what the other class leaves), features, steps.
FIT_DOCS, FIT_WORDS, STEPS = 6_000, 2_000, 300
#: Features that a task holds at a time, and those of one more document.
HELD = 50_000
LEAST_DOCS = 5
#: A word's features: itself, and its beginnings of these lengths (as "achlich-"), which tell words of one stem.
STEMS = range(3, 9)
RIDGE = 1e-5
#: A feature enters the model if toxic documents hold it more often, with a signed root of the likelihood-ratio statistic of at least this. Labels are noisy, and weaker ones would only fit the noise.
LEAST_MARK = 6.0
#: With few toxic documents, holding half of them and no other document is enough, from this mark on and with two documents at least.
FLOOR_MARK = 4.0
#: Toxic documents are graded 1 to this by what models fitted on the other folds of the sample make of them; others have grade 0.
GRADES, FOLDS = 3, 3


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if n <= len(word))]


@dataclass
class Ordinal:
    """P(grade >= j) = sigmoid(w . x - threshold_j): one weight for each feature, shared by all the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 10.0))
    #: Toxic from this chance of grade 1 or more on.
    cut: float = 0.5

    def __post_init__(self):
        self.begins = {f[:3].rstrip("-") for f in self.weights}

    def linear(self, text: str | None) -> float:
        known, begins = self.weights, self.begins
        counts = Counter(f for w in WORD.findall((text or "").lower()) if w[:3] in begins for f in features(w) if f in known)
        return sum(known[f] * value(c) for f, c in counts.items())

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades): the chance of each grade from 1 up, or more."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def value(count: int) -> float:
    """A feature's value: present, and a little more for repeats."""
    return 1 + 0.5 * math.log(count)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, size: int, levels: int = GRADES, steps: int = STEPS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that make the grades (each row counting its ``weight``) most likely, by Adam on the cumulative-link likelihood with a ridge.

    Thresholds are the first one and logarithms of the gaps between them, so they stay ordered.
    """
    n = len(grade)
    weight = np.ones(n) if weight is None else weight * (n / weight.sum())
    share = np.array([np.clip(np.average(grade >= j, weights=weight), 1e-3, 1 - 1e-3) for j in range(1, levels + 1)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels))
    p = np.r_[np.zeros(size), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[:size], np.exp(p[size + 1 :])
        theta = p[size] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        up = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta - score[:, None], -50, 50))), np.zeros((n, 1))])
        i = np.arange(n)
        high, low = up[i, grade], up[i, grade + 1]  # P(y >= own), P(y >= own + 1)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = weight * high * (1 - high) / chance, weight * low * (1 - low) / chance
        g_score = slope_low - slope_high
        g_theta = np.zeros((n, levels + 2))
        g_theta[i, grade] += slope_high
        g_theta[i, grade + 1] -= slope_low
        g_theta = g_theta[:, 1 : levels + 1].sum(axis=0)
        g = np.r_[np.bincount(cols, weights=values * g_score[rows], minlength=size) / n + RIDGE * w, g_theta.sum() / n, np.cumsum(g_theta[::-1])[::-1][1:] * gaps / n]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        p = p - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return p[:size], p[size] + np.r_[0, np.cumsum(np.exp(p[size + 1 :]))]


def cross_fitted(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, toxic: np.ndarray, size: int, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """How toxic each row is to a model (of one threshold) fitted on the rows of the other folds: a log-odds that its own label had no part in. Where the others lack a class, all rows are fitted."""
    out = np.zeros(len(toxic))
    for k in np.unique(fold):
        others = fold != k
        if not toxic[others].any() or toxic[others].all():
            others = np.ones(len(toxic), dtype=bool)
        place, held = np.cumsum(others) - 1, others[rows]
        w, theta = fit_ordinal(place[rows[held]], cols[held], values[held], toxic[others].astype(np.int64), size, levels=1, weight=weight[others])
        score = np.bincount(rows, weights=values * w[cols], minlength=len(toxic)) - theta[0]
        out[fold == k] = score[fold == k]
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> Ordinal:
    """Fit on about ``fit_docs`` labelled documents and ``fit_words`` features.

    Toxic and other documents are sampled each by their own bound, so rare toxic ones are all there; weights give each class its share of all labels back.

    ``labels`` (doc_id, toxic); a document with several labels is toxic if one says so; null labels don't count.
    Grades: 0 where not toxic; toxic documents get 1 to ``GRADES`` by thirds of their log-odds under models fitted on other documents (``cross_fitted``), so no grade is told from weights that its own label has shaped. Equal texts in the sample count once. Features are counted in Spark; only the chosen ones' counts come to the driver.
    Without toxic and other documents the model calls nothing toxic; so it does, with a warning, where no feature tells them apart.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    labelled = settle(docs.select(F.col("doc_id").alias("id")).join(marked, "id").distinct().withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    every = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bound = min(every.get(1, 0), max(fit_docs // 2, fit_docs - every.get(0, 0)))
    ids = settle(sample_by_hash(labelled.where("toxic = 1"), bound, "id").union(sample_by_hash(labelled.where("toxic = 0"), fit_docs - bound, "id")))
    share = {r["toxic"]: every[r["toxic"]] / r["count"] for r in ids.groupBy("toxic").count().collect()}
    # only so many ids are broadcast; texts of the others stay where they are
    chosen = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "id")
    chosen = chosen.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))  # copies of a text count once

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "toxic", "words", "counts"]
        for pdf in batches:
            rows, held = [], 0
            for key, toxic, text in zip(pdf["id"], pdf["toxic"], pdf["text"], strict=True):
                found = Counter(f for w in WORD.findall((text or "").lower()) for f in features(w))
                rows.append((key, toxic, list(found), list(found.values())))
                held += len(found)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    bags = settle(chosen.select(F.md5("text").alias("id"), "toxic", "text").mapInPandas(words, "id string, toxic int, words array<string>, counts array<int>"))
    size = dict(bags.groupBy("toxic").count().collect())
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Ordinal()
    least_docs = min(LEAST_DOCS, max(2, bad // 2))
    total = bad + good
    half = -(-bad // 2)
    mark = min(LEAST_MARK, max(FLOOR_MARK, root_ratio(half, 0, bad, good) - 1e-6))
    by_word = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("n") >= least_docs)
    a, n = F.col("bad").cast("double"), F.col("n").cast("double")
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * total / (row * col))).otherwise(0.0)
    ratio = part(a, n, F.lit(bad)) + part(n - a, n, F.lit(good)) + part(bad - a, total - n, F.lit(bad)) + part(good - (n - a), total - n, F.lit(good))
    marks = by_word.withColumn("z", F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))).where((F.col("z") >= mark) & (a / bad > (n - a) / good))
    best = marks.orderBy(F.desc("z"), "word").limit(fit_words).toPandas()
    if not len(best):
        logging.getLogger(__name__).warning("no feature tells %d toxic documents from %d others; nothing will be called toxic", bad, good)
        return Ordinal()
    place = {w: i for i, w in enumerate(best["word"])}
    places = docs.sparkSession.createDataFrame(list(place.items()), "word string, place int")
    spread = bags.select("id", "toxic", F.explode(F.arrays_zip("words", "counts")).alias("f")).select("id", "toxic", F.col("f.words").alias("word"), F.col("f.counts").alias("n"))
    held = spread.join(F.broadcast(places), "word").groupBy("id").agg(F.collect_list("place").alias("cols"), F.collect_list("n").alias("counts"))
    sample = bags.select("id", "toxic").join(held, "id", "left").toPandas().sort_values("id")
    for c in ("cols", "counts"):
        sample[c] = [x if x is not None else [] for x in sample[c]]
    rows = np.repeat(np.arange(len(sample)), sample["cols"].map(len))
    cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in sample["cols"]])
    counts = np.concatenate([np.asarray(x, dtype=np.int64) for x in sample["counts"]])
    toxic = sample["toxic"].to_numpy() > 0
    weight = np.where(toxic, share[1], share[0])
    values = 1 + 0.5 * np.log(counts)
    odds = cross_fitted(rows, cols, values, toxic, len(place), weight, np.array([int(i[:8], 16) % FOLDS for i in sample["id"]]))
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(odds[toxic], np.arange(1, GRADES) / GRADES), odds, side="left"), 0)
    w, theta = fit_ordinal(rows, cols, values, grade, len(place), weight=weight)
    up = 1 / (1 + np.exp(np.clip(theta[0] - np.bincount(rows, weights=values * w[cols], minlength=len(sample)), -50, 50)))
    return Ordinal({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-3}, theta, best_cut(up, toxic, weight))


def root_ratio(in_bad: int, in_good: int, bad: int, good: int) -> float:
    """Root of the likelihood-ratio statistic of a feature that so many toxic and other documents hold."""
    n, total = in_bad + in_good, bad + good
    cells = ((in_bad, n, bad), (in_good, n, good), (bad - in_bad, total - n, bad), (good - in_good, total - n, good))
    return math.sqrt(max(0.0, 2 * sum(seen * math.log(seen * total / (row * col)) for seen, row, col in cells if seen)))


def best_cut(chance: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut between neighbouring chances, 0.5 at most, that gives the largest F1 on the weighted sample."""
    order = np.argsort(-chance, kind="stable")
    ranked, hits = chance[order], np.cumsum((toxic * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (toxic * weight).sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = 0  # no cut within equal chances
    at = int(np.argmax(f1))
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return float(min(0.5, (ranked[at] + below) / 2))


def severity_column(model: Ordinal, spark, text: str = "text"):
    """Struct column (severity, grade, toxic) of a text column. Severity is the expected grade; grade the likeliest; toxic where the chance of grade 1 or more reaches the model's cut."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, toxic int")
    def of(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        up = own.at_least(np.array([own.linear(t) for t in texts], dtype=np.float64))
        each = np.hstack([np.ones((len(up), 1)), up]) - np.hstack([up, np.zeros((len(up), 1))])
        return pd.DataFrame({"severity": up.sum(axis=1), "grade": each.argmax(axis=1), "toxic": (up[:, 0] >= own.cut).astype(int)})

    return of(F.col(text).cast("string"))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity, grade, toxic of every row of ``docs`` (doc_id, text); other columns are left out.

    A null text counts as empty, very long ones are read whole; null doc_ids and repeated rows are rows like any other; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity_column(model, docs.sparkSession).alias("s")).select("doc_id", "s.*")


def keep_civil(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns as they were, whatever their names; null texts stay; an empty table gives no rows."""
    return docs.where(severity_column(model, docs.sparkSession)["toxic"] == 0)
