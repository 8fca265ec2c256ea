"""Filters of web addresses: rules of hosts and paths, and a weighted vocabulary that one Aho-Corasick pass counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

# The rules that this project's addresses are judged by: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Words that reject an address alone, and words that do so together with others. Both count between characters that are neither letters nor numbers.
STRICT = (
    "adult", "camgirls", "casino", "escorts", "gambling", "hardcore", "hentai", "milf", "nsfw", "pharma-online", "pills", "porn", "porno", "sex", "spam", "viagra", "warez", "webcams", "xxx",
)
SOFT = (
    "ad", "ads", "bet", "bets", "bonus", "buy", "cheap", "clicks", "coupon", "crack", "deals", "discount", "farm", "free", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "popup", "poker", "promo", "serial", "slots",
    "torrent", "track", "tracker", "win",
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case (A-Z only). A strict one weighs ``limit``, a soft one 1; an address whose distinct terms weigh ``limit`` or more is rejected."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: int = 2

    def weights(self) -> dict[str, int]:
        return {t: 1 for t in self.soft} | {t: self.limit for t in self.strict}


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path; a list of fixed length) that fits, or nulls. A rule fits its host and all below it, where the path starts with the rule's."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in longest]
    null = F.lit(None).cast("string")
    return F.coalesce(null, *[F.when(f, h + p) for f, (_, h, p) in zip(fits, longest, strict=True)]), F.coalesce(null, *[F.when(f, v) for f, (v, _, _) in zip(fits, longest, strict=True)])


def automaton(vocabulary: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in vocabulary.weights():
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(text: str, terms) -> dict[str, int]:
    """Terms of the automaton in ``text`` and how often each stands there between characters that are neither letters nor numbers (or the ends)."""
    out: dict[str, int] = {}
    for last, term in terms.iter(text):
        first = last - len(term) + 1
        if (first == 0 or not text[first - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
            out[term] = out.get(term, 0) + 1
    return out


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): the longest rule that fits, else the vocabulary.

    Returns page_id, host, path, rule (host and path of the rule, or null), verdict (allow or block), n_strict and n_soft (distinct terms in the whole url), n_hits (all their occurrences), weight, and terms
    (distinct, in order, comma-joined). One pass where the rows are, nothing is shuffled. A null url is empty: no host, path or term, hence allowed; a url without ``://`` has no host, yet its terms count. Repeated rows and null page_ids are judged like
    any other, urls of any length whole, other columns are left out, and an empty table gives no rows. With no terms at all nothing is rejected.
    """
    own = vocabulary or Vocabulary()
    if not (set(own.strict) | set(own.soft)):
        own = Vocabulary(strict=("\0",), soft=(), limit=own.limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, strict, soft = automaton(own), set(own.strict), set(own.soft) - set(own.strict)
        for pdf in batches:
            found = [hits(x, terms) for x in pdf.pop("_text")]
            yield pdf.assign(
                n_strict=[len(strict & h.keys()) for h in found], n_soft=[len(soft & h.keys()) for h in found], n_hits=[sum(h.values()) for h in found], terms=[",".join(sorted(h)) for h in found],
            )

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), url.alias("_url"))  # ids as texts: pandas would make numbers with nulls floats
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), _lower(F.col("_url")).alias("_text"))
    counted = rows.mapInPandas(count, "page_id string, host string, path string, n_strict long, n_soft long, n_hits long, terms string")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    weight = F.col("n_strict") * own.limit + F.col("n_soft")
    verdict = F.coalesce(said, F.when(weight >= own.limit, BLOCK).otherwise(ALLOW))
    return counted.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft", "n_hits", weight.alias("weight"), "terms")


def judge_sql(pages: str = "pages", rules: tuple[tuple[str, str, str], ...] = RULES, vocabulary: Vocabulary | None = None) -> str:
    """The same in DuckDB SQL, apart from n_hits: its own, plain way to find terms, one by one."""
    own = vocabulary or Vocabulary()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(t)}, {t in own.strict})" for t in own.weights())
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = lambda pick: "CASE " + " ".join(f"WHEN (host = {quoted(r[1])} OR suffix(host, {quoted('.' + r[1])})) AND prefix(path, {quoted(r[2])}) THEN {quoted(pick(r))}" for r in longest) + " END"
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    return rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM {pages}), terms(term, strict) AS (VALUES {listed}),
p AS (SELECT page_id, translate(url, {upper}, {lower}) AS low, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {upper}, {lower}) AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
d AS (SELECT low, count(*) FILTER (WHERE strict) AS n_strict, count(*) FILTER (WHERE NOT strict) AS n_soft, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT DISTINCT low FROM p) AS l, terms
  WHERE regexp_matches(low, '(^|[^\pL\pN])' || regexp_escape(term) || '($|[^\pL\pN])') GROUP BY low)
SELECT page_id, host, path, {cases(lambda r: r[1] + r[2])} AS rule, coalesce({cases(lambda r: r[0])}, CASE WHEN coalesce(n_strict, 0) * {own.limit} + coalesce(n_soft, 0) >= {own.limit} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(n_strict, 0) * {own.limit} + coalesce(n_soft, 0) AS weight, coalesce(terms, '') AS terms FROM p LEFT JOIN d USING (low)"""
