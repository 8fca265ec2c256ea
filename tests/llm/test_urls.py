"""Rules and vocabulary of addresses against a brute-force version and DuckDB, with hostile rows."""

import random
import re

import duckdb
import pytest

from barloom.llm import url_filter as urls

COLUMNS = "page_id host path rule verdict n_strict n_soft weight terms".split()


def brute(url, rules=urls.RULES, own=None):
    own = own or urls.Vocabulary()
    host = path = ""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    if "://" in low:
        rest = (url or "").split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), re.split("[?#]", rest[cut:])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    terms = set()
    for t in (*own.strict, *own.soft):
        for m in range(len(low)):
            if low.startswith(t, m) and not low[m - 1 : m].isalnum() * (m > 0) and not low[m + len(t) : m + len(t) + 1].isalnum():
                terms.add(t)
    strict = len(terms & set(own.strict))
    soft = len(terms) - strict
    weight = strict * own.limit + soft
    rule, said = max(fits)[1:] if fits else (None, None)
    return host, path, rule, said or ("block" if weight >= own.limit else "allow"), strict, soft, weight, ",".join(sorted(terms))


def rows_of(seed=3):
    rng = random.Random(seed)
    words = [*urls.STRICT, *urls.SOFT, "the", "essex", "sexton", "adx", "ad1", "é", "ſ"]
    made = []
    for i in range(300):
        host = rng.choice(["", "www.", "m.", "WWW."]) + rng.choice(["-", ".", "_", ""]).join(rng.sample(words, rng.randint(1, 3))) + rng.choice([".com", ".net", ".org", ".example.com", ".COM", ":8080"])
        path = rng.choice(["", "/", "/en/", "/es/x", "/fr/" + rng.choice(words), "?a=/en/", "#/fr/", "//" + rng.choice(words)])
        made.append((i, rng.choice(["http://", "https://", "", "ftp://a://"]) + host + path))
    hand = [
        "http://com/", "http://com", "http://com?x", "http://example.com/en/a", "http://a.example.com/en/", "http://www.example.com/en/", "http://x.www.example.com/en/ä", "http://xexample.com/en/", "http://net/es/", "http://a.net/fr/",
        "http://a.net/fr", "http://A.NET/FR/", "://", "://x", "x://", "http:///en/", None, "", "no scheme adult", "http://a.org/essex", "http://a.org/sex", "http://a.org/xxx\nyy/sex", "http://free.org/free", "http://free.org/bets?free#x",
        "http://a.org/éadult", "http://a.org/adult²", "http://a.org/" + "adult " * 3 + "a" * 200_000, "http://ADULT.org/", "http://a.org/pharma-online", "http://a.org/pharma-onlines", "http://ÀDS.org/ADS/bets",
    ]
    made += [(1000 + i, u) for i, u in enumerate(hand)] + [(None, "http://a.org/sex"), (5, made[5][1]), (5, "http://other.org/")]
    return made


def test_every_address_is_judged(spark):
    rows = rows_of()
    frame = spark.createDataFrame([(i, u, "<p>", "h", 1, "x") for i, u in rows], "page_id long, url string, html string, host string, weight int, _text string")
    got = urls.judge(frame)
    assert got.columns == [*COLUMNS[:7], "n_hits", *COLUMNS[7:]]
    found = sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)
    assert found == sorted(((i, *brute(u)) for i, u in rows), key=str)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    result = con.execute(urls.judge_sql())
    names = [d[0] for d in result.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in result.fetchall()), key=str) == found


def test_occurrences_and_other_vocabularies(spark):
    frame = spark.createDataFrame([(1, "http://a.org/spam/spam/ads?ads#spams"), (2, "http://a.org/one-two/two")], "page_id long, url string")
    assert [(r.n_hits, r.n_strict, r.n_soft) for r in urls.judge(frame).orderBy("page_id").collect()] == [(4, 1, 1), (0, 0, 0)]
    own = urls.Vocabulary(strict=("three",), soft=("one", "two", "one-two"), limit=3)
    assert [(r.weight, r.verdict, r.terms) for r in urls.judge(frame, vocabulary=own).orderBy("page_id").collect()] == [(0, "allow", ""), (3, "block", "one,one-two,two")]
    assert {r.verdict for r in urls.judge(frame, rules=(), vocabulary=urls.Vocabulary(strict=(), soft=())).collect()} == {"allow"}


def test_empty_table_and_one_pass(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).collect() == []
    plan = urls.judge(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(("text", "want"), [("ads", {"ads": 1}), ("xads", {}), ("ads ads", {"ads": 2}), ("ads_ad", {"ads": 1, "ad": 1}), ("ad-ads", {"ad": 1, "ads": 1}), ("", {})])
def test_boundaries(text, want):
    assert urls.hits(text, urls.automaton(urls.Vocabulary())) == want
