"""Personal data in text: fixed patterns, and a skip-chain conditional random field that carries their labels to alike tokens."""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # label 0 is none
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that starts no match at its first digit starts none later, and no match ends within a run: so runs are taken whole.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]+")

WORDS = re.compile(r"[A-Za-z0-9._%+-]+")
#: What may stand for "@" and "." in an email that is written out.
AT = re.compile(r"\s?[\[({<]?\s?(?:@|at)\s?[\])}>]?\s?", re.I)
DOT = re.compile(r"\s?[\[({<]?\s?(?:\.|dot)\s?[\])}>]?\s?", re.I)
#: Digits of one mention have at most so many other characters between them, none of them a letter.
GAP = 3
#: Failed matches of fewer digits are no mentions.
LEAST_DIGITS = 9
#: Gradient steps of the fit.
STEPS = 200
#: Messages are passed until they settle; fields where they circle stop after so many rounds.
SETTLED, MOST_ROUNDS = 1e-4, 1000
#: Where the fit starts, and what its ridge draws to: how much no label is worth, and agreement over a skip.
NONE_FIRST, SAME, ALIKE = 2.0, 3.0, 2.5
#: A mention is a span from this chance of its label on.
LEAST_CHANCE = 0.5
#: Log-potential of labels that a mention can't take: no number of messages makes up for it.
NEVER = -1e9

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def matched_spans(text: str) -> tuple[list[Span], list[Span]]:
    """What the fixed patterns match, leftmost and non-overlapping per kind, sorted by start and kind: (what passes its test, what fails it)."""
    found: list[Span] = []
    failed: list[Span] = []
    if not HINT.search(text):
        return found, failed
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            (found if passes(kind, DIGITS.findall(m[0])) else failed).append((m.start(), kind, m.end()))
    return sorted(found), sorted(failed)


def passes(kind: int, groups: list[str]) -> bool:
    """Whether runs of digits make an ip, card or phone."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in groups)
    digits = sum(map(len, groups))
    return 12 <= digits <= 19 and _luhn("".join(groups)) if kind == 2 else 9 <= digits <= 15


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans; what fails its test is dropped without another try."""
    return matched_spans(text)[0]


@dataclass
class Graph:
    """The mentions of a document (base spans, failed matches, and what is like a base span), and the field's edges among them."""

    start: list[int]
    end: list[int]
    shape: list[int]
    known: np.ndarray  # label of base spans, else 0
    allowed: np.ndarray  # (mentions, LABELS): labels that a mention may take
    chain: list[tuple[int, int]]  # neighbours with at most GAP characters between
    same: list[tuple[int, int]]  # an earlier mention with the same characters, separators and case aside
    alike: list[tuple[int, int]]  # an earlier one with the same local part, without a country code, or with other last digits
    failed: np.ndarray  # whether a pattern matched and its test failed


#: Classes of a shape: how many digits, what stands between them, whether "+" or "@" is there, and whether letters or digits adjoin.
SIZES, MARKS = (0, 8, 11, 15, 16, 19), " -./()"
SHAPES = (len(SIZES) + 1) * (len(MARKS) + 2) * 2 * 2 * 2


def shape_of(text: str, start: int, end: int) -> int:
    """A mention's form as one of ``SHAPES`` numbers."""
    mention = text[start:end]
    n = sum(map(len, DIGITS.findall(mention)))
    size = next((i for i, s in enumerate(SIZES) if n <= s), len(SIZES))
    kinds = {c for c in mention if not c.isalnum()} - {"+", "@"}
    mark = 0 if not kinds else 1 + MARKS.find(kinds.pop()) if len(kinds) == 1 and kinds <= set(MARKS) else len(MARKS) + 1
    beside = start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
    return (((size * (len(MARKS) + 2) + mark) * 2 + ("+" in mention)) * 2 + ("@" in mention)) * 2 + beside


def _keys(kind: int, groups: list[str], email: str) -> tuple[tuple, list[tuple]]:
    """What makes two mentions the same, and what makes them alike. Numbers are told by their digits, ips by their parts."""
    if kind == 0:
        return ("email", email), [("local", email.partition("@")[0])]
    if kind == 1:
        return ("ip", *groups), []
    digits = "".join(groups)
    return ("digits", digits), [("stem", len(digits), digits[:-2]), *([("end", digits[-9:])] if kind == 3 else [])]


def _written_out(text: str, base: list[Span]) -> list[Span]:
    """Emails of ``base`` that appear with other signs for "@" or ".", and their local parts (of five characters or more, with a digit) alone."""
    domains: dict[str, set[str]] = {}
    for s, k, e in base:
        if k == 0:
            local, _, domain = text[s:e].lower().partition("@")
            domains.setdefault(local, set()).add(domain)
    found: list[Span] = []
    for m in WORDS.finditer(text) if domains else ():
        local = m[0].lower().strip(".-")
        if local not in domains:
            continue
        at, end, parts = AT.match(text, m.end()), m.end(), []
        while at:
            word = re.compile(r"[A-Za-z0-9-]+").match(text, at.end())
            if not word:
                break
            parts.append(word[0].lower())
            if ".".join(parts) in domains[local]:
                end = word.end()
            at = DOT.match(text, word.end()) if len(parts) < 64 else None
        if end > m.end() or len(local) >= 5 and HINT.search(local):
            start = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
            found.append((start, 0, end if end > m.end() else start + len(local)))
    return found


def _numbers(text: str, base: list[Span]) -> list[tuple[Span, tuple[tuple, list[tuple]]]]:
    """Runs of digits that are the same as an ip, card or phone of ``base`` or alike, with their keys. Each start is tried with at most 19 runs."""
    same, near = {}, {}
    for s, k, e in base:
        if k:
            own, others = _keys(k, DIGITS.findall(text[s:e]), "")
            same.setdefault(own, k)
            for o in others:
                near[o] = max(near.get(o, (0, 0)), (sum(map(len, own[1:])), k))
    if not same:
        return []
    groups = [(m.start(), m.end(), m[0]) for m in DIGITS.finditer(text)]
    found, at = [], 0
    while at < len(groups):
        best, digits, parts = None, "", []
        for end in range(at, min(at + 19, len(groups))):
            if parts and (groups[end][0] - groups[end - 1][1] > GAP or any(c.isalnum() for c in text[groups[end - 1][1] : groups[end][0]])):
                break
            parts.append(groups[end][2])
            digits += parts[-1]
            if len(digits) > 19:
                break
            for key in (("ip", *parts), ("digits", digits)):
                if key in same:
                    best = (2, end, same[key], key)
            if not best or best[0] < 2:
                for key in (("stem", len(digits), digits[:-2]), ("end", digits[-9:])):
                    if len(digits) >= 9 and key in near and len(digits) <= near[key][0]:
                        best = (1, end, near[key][1], ("digits", digits))
        if best:
            _, end, kind, key = best
            start = groups[at][0] - (groups[at][0] > 0 and text[groups[at][0] - 1] in "+(")
            found.append(((start, kind, groups[end][1]), _keys(kind, list(key[1:]), "")))
            at = end
        at += 1
    return found


def graph_of(text: str, base: list[Span], failed: list[Span]) -> Graph:
    """Mentions in order. Skips link each to the one before that is the same, and to the first and last base span in the document that are the same or alike.

    So edges grow with mentions, a label reaches any repeat over one edge, and, base spans being held, hardly a loop is left among the others.
    """
    covered = sorted((s, e) for s, _, e in base)
    ends = list(accumulate((e for _, e in covered), max))
    free = lambda s, e: not (i := bisect_left(covered, (e,))) or ends[i - 1] <= s

    mentions: dict[tuple[int, int], tuple] = {}  # place -> label, failed, keys
    for s, k, e in base:
        mentions.setdefault((s, e), (k + 1, False, _keys(k, DIGITS.findall(text[s:e]), text[s:e].lower())))
    if base:
        for s, _, e in _written_out(text, base):
            if free(s, e):
                local = text[s:e].lower()
                mail = DOT.sub(".", AT.sub("@", local, count=1)) if AT.search(local) else local + "@"
                mentions.setdefault((s, e), (0, False, _keys(0, [], mail)))
        for (s, _, e), keys in _numbers(text, base):
            if free(s, e):
                mentions.setdefault((s, e), (0, False, keys))
    # a failed match counts unless it is, or lies in, a mention that is like a base span; short numbers say nothing
    for s, k, e in failed:
        if k == 1 or sum(map(len, DIGITS.findall(text[s:e]))) >= LEAST_DIGITS:
            mentions.setdefault((s, e), (0, True, _keys(k, DIGITS.findall(text[s:e]), "")))
    places, reach = [], -1
    for s, e in sorted(mentions, key=lambda p: (p[0], mentions[p][1], -p[1])):
        if mentions[s, e][0] or s >= reach and free(s, e):
            places.append((s, e))
            reach = max(reach, e)
    n = len(places)
    chain, same, alike = [], [], []
    group = list(range(n))  # mentions that skips connect

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    bases: dict[tuple, list[int]] = {}  # first and last base span of each key
    for i, place in enumerate(places):
        if mentions[place][0]:
            own, others = mentions[place][2]
            for key in (own, *others):
                bases[key] = [bases.get(key, [i])[0], i]
    last: dict[tuple, int] = {}
    for i, place in enumerate(places):
        if i and place[0] - places[i - 1][1] <= GAP:
            chain.append((i - 1, i))
        label, _, (own, others) = mentions[place]
        twins = {last[own]} if own in last else set()
        if not label:
            twins.update(bases.get(own, ()))
            alike += [(j, i) for j in {j for key in others for j in bases.get(key, ())} if mentions[places[j]][2][0] != own]
        same += [(j, i) for j in twins]
        last[own] = i
    for j, i in same + alike:
        group[top(i)] = top(j)
    held: dict[int, set[int]] = {}
    for i, place in enumerate(places):
        held.setdefault(top(i), set()).add(mentions[place][0])
    allowed = np.zeros((n, LABELS), dtype=bool)
    allowed[:, 0] = True
    for i, (s, e) in enumerate(places):
        groups = DIGITS.findall(text[s:e])
        for label in held[top(i)]:
            allowed[i, label] = label <= 1 or passes(label - 1, groups)
    known = np.array([mentions[p][0] for p in places], dtype=np.int64)
    shapes = [shape_of(text, s, e) for s, e in places]
    return Graph([s for s, _ in places], [e for _, e in places], shapes, known, allowed, chain, same, alike, np.array([mentions[p][1] for p in places], dtype=bool))


@dataclass
class Field:
    """Log-potentials: of a label given a token's shape, of two labels in a chain, and of two labels over each kind of skip."""

    shape: np.ndarray  # (SHAPES, LABELS)
    chain: np.ndarray  # (LABELS, LABELS), left by right
    same: np.ndarray
    alike: np.ndarray

    @staticmethod
    def empty() -> Field:
        none = np.zeros((SHAPES, LABELS))
        none[:, 0] = NONE_FIRST
        return Field(none, np.zeros((LABELS, LABELS)), SAME * np.eye(LABELS), ALIKE * np.eye(LABELS))

    def marginals(self, g: Graph) -> np.ndarray:
        """(mentions, LABELS) by loopy sum-product message passing, with the known labels held fast and others within those allowed."""
        n = len(g.known)
        unary = np.where(g.allowed, self.shape[g.shape], NEVER)
        held = np.flatnonzero(g.known)
        unary[held] = NEVER
        unary[held, g.known[held]] = 0.0
        pairs = [(e, m) for e, m in ((g.chain, self.chain), (g.same, self.same), (g.alike, self.alike)) if e]
        if not pairs:
            return _softmax(unary)
        a = np.concatenate([np.array(e)[:, 0] for e, _ in pairs])
        b = np.concatenate([np.array(e)[:, 1] for e, _ in pairs])
        potential = np.concatenate([np.broadcast_to(m, (len(e), LABELS, LABELS)) for e, m in pairs])
        source, target = np.r_[a, b], np.r_[b, a]
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        message = np.zeros((len(source), LABELS))
        for _ in range(MOST_ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            sent = belief[source] - message[back]
            top = sent.max(axis=1, keepdims=True)
            fresh = np.log(np.einsum("el,elm->em", np.exp(sent - top), np.exp(potential)) + 1e-300)
            fresh -= fresh.max(axis=1, keepdims=True)
            if np.abs(fresh - message).max() < SETTLED:
                message = fresh
                break
            message = 0.5 * message + 0.5 * fresh
        belief = unary.copy()
        np.add.at(belief, target, message)
        return _softmax(belief[:n])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans). Added are mentions that skips connect to a base span of their label; they touch no base span."""
    base, failed = matched_spans(text)
    if not base:
        return base, base
    g = graph_of(text, base, failed)
    if g.known.all() or not (g.allowed[:, 1:].any(axis=1) & (g.known == 0)).any():
        return base, base
    chance = field.marginals(g)
    label = np.where((chance.max(axis=1) >= LEAST_CHANCE) & (g.known == 0), chance.argmax(axis=1), 0)
    added: list[Span] = []
    for i in np.flatnonzero(label).tolist():
        if not added or added[-1][2] <= g.start[i]:
            added.append((g.start[i], int(label[i]) - 1, g.end[i]))
    return base, sorted({*base, *added})


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fit_field(seen: pd.DataFrame, steps: int = STEPS) -> Field:
    """Potentials by pseudo-likelihood: each mention's label given its shape and the labels of its neighbours, with a ridge, by gradient steps.

    ``seen``: shape, label, the labels of the chain's left and right neighbour and of a same and an alike mention (-1: none), and n, how often this was seen.
    """
    if not len(seen):
        return Field.empty()
    y = seen["label"].to_numpy()
    shape = seen["shape"].to_numpy()
    n = seen["n"].to_numpy(dtype=np.float64)
    total = n.sum()
    columns = {c: seen[c].to_numpy() for c in NEIGHBOURS}
    start = vars(Field.empty())
    w = {k: v.copy() for k, v in start.items()}
    square = {k: np.full_like(v, 1e-8) for k, v in w.items()}
    has = {c: np.flatnonzero(v >= 0) for c, v in columns.items()}
    sides = (("left", "chain", False), ("right", "chain", True), ("same", "same", False), ("alike", "alike", False))
    for _ in range(steps):
        x = w["shape"][shape]
        for c, key, turned in sides:
            i = has[c]
            x[i] += (w[key].T if turned else w[key])[columns[c][i]]
        miss = _softmax(x)
        miss[np.arange(len(y)), y] -= 1
        miss *= n[:, None]
        grad = {k: 1e-3 * total * (v - start[k]) for k, v in w.items()}
        np.add.at(grad["shape"], shape, miss)
        for c, key, turned in sides:
            i = has[c]
            g = np.zeros((LABELS, LABELS))
            np.add.at(g, columns[c][i], miss[i])
            grad[key] += g.T if turned else g
        for key in ("same", "alike"):
            grad[key] = (grad[key] + grad[key].T) / 2
        for k in w:
            square[k] += (grad[k] / total) ** 2
            w[k] = w[k] - 0.5 * (grad[k] / total) / np.sqrt(square[k])
    return Field(**w)


NEIGHBOURS = ("left", "right", "same", "alike")


def fit(docs: DataFrame) -> Field:
    """Fit the field to all documents: base spans are of their kind, failed matches of none, what is like a base span is not told.

    Mentions are counted by shape and labels where they are; the driver sees one row for each kind that occurs, at most ``SHAPES`` x 5 x 6^4 whatever the input.
    """
    text = text_or_empty()

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter = Counter()
            for t in pdf["text"]:
                base, failed = matched_spans(t)
                if not base and not failed:
                    continue
                g = graph_of(t, base, failed)
                told = np.where((g.known > 0) | g.failed, g.known, -1).tolist()
                near = {c: [-1] * len(told) for c in NEIGHBOURS}
                for i, j in g.chain:
                    near["right"][i], near["left"][j] = told[j], told[i]
                for c, edges in (("same", g.same), ("alike", g.alike)):
                    for i, j in edges:
                        near[c][i], near[c][j] = told[j], told[i]
                count.update(r for r in zip(g.shape, told, *near.values(), strict=True) if r[1] >= 0)
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["shape", "label", *NEIGHBOURS, "n"])

    keys = ["shape", "label", *NEIGHBOURS]
    hinted = docs.select(text.alias("text")).where(text.rlike("[0-9@]"))
    seen = hinted.mapInPandas(mentions, ", ".join(f"{k} int" for k in keys) + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))
    return fit_field(seen.toPandas().sort_values(keys))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added of every row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; base_sha256 is the hash of the base ones so
    written. Null texts count as empty, very long ones are read whole in time in proportion; null doc_ids and repeated rows are rows like any other; other columns are left out;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = all_spans(text, shared.value)
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(spell(base).encode()).hexdigest(), spell(every), len(every) - len(base)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(text_or_empty()).alias("r")).select("doc_id", "r.*")


def redact_text(text: str | None, field: Field) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in all_spans(text, field)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and n_chars (where there is such a column) counted anew for texts that changed.

    All rows and other columns stay as they were, whatever their names; null texts stay null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, shared.value) for t in texts], dtype=object)

    columns = docs.columns
    own = f"clean {uuid.uuid4().hex}"
    clean = docs.withColumn(own, run(F.col("text").cast("string")))
    new = {"text": F.col(own)}
    if "n_chars" in columns:
        changed = ~F.col(own).eqNullSafe(F.col("text"))
        new["n_chars"] = F.when(changed, F.length(own).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])
