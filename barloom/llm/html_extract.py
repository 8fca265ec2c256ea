"""Main text of web pages by site style trees: what a site's pages share is furniture, what differs is content."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, settle

# Element names and class words with a meaning of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Never text of the page: scripts and what stands in their place, styles, forms, other documents.
NO_TEXT = frozenset("head script style form noscript template iframe noembed noframes title".split())
#: What a page itself declares as furniture, and words of class and id that tell of it outside an article.
FURNITURE = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget"
    " widgets footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended toolbar pager pagination copyright legal skip search searchbox form".split()
)
#: Whole classes and ids that tell of an advert even within an article.
ADVERTS = frozenset("ad ads advert adverts advertisement adsbygoogle sponsored".split())
#: Readers' comments are as unlike each other as articles, so only their name tells: by its words outside an article, by the whole class or id within.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
COMMENTS = frozenset("comment comments commentlist comment-list replies respond disqus_thread".split())
MAIN = frozenset(["article", "main"])
#: An element of the first kind ends an open one of the second.
ENDS = {t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Open elements that an implied or stray end does not reach beyond.
FENCE = frozenset("article main section div nav aside footer header table ul ol body html form td th".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: Kinds of elements: plain, plain by a class or id of its own within an article, bare within an article, furniture by words, furniture as declared.
PLAIN, CLASSED, BARE, WORDED, DECLARED = range(5)
#: What is expected of each kind before a site speaks, as importance of so many pages, and the least share this keeps however many pages a site has.
PRIOR = {PLAIN: 0.75, CLASSED: 1.0, BARE: 1.0, WORDED: 0.0, DECLARED: 0.0}
PRIOR_PAGES = 10
PRIOR_SHARE = {PLAIN: 0.0, CLASSED: 0.0, BARE: 0.0, WORDED: 0.3, DECLARED: 0.5}
#: Weight of a node's content against its own presentation, to the power of the number of presentations.
GAMMA = 0.9
#: Elements below this importance go.
LEAST_IMPORTANCE = 0.6
#: Texts of so many words or fewer are taken apart where a word ends with, or is, punctuation: a notice with a date, or a footer with a page's number, then still shares its other parts.
SHORT = 30
#: Plain elements from this importance on are not told page by page: they stay.
SURE = 0.9
#: Site trees are broadcast up to this size. Beyond it, pages are dealt by host, and a host with more pages than this over several tasks, each of which gets its tree once.
BROADCAST_BYTES, TASK_PAGES = 32 << 20, 20_000


class Page:
    """A page's text pieces and elements. Each element has its path of styles (as a hash), its kind, and what text it has itself, inline elements included.

    One pass over the source and constant work for each tag, at any depth.
    """

    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.owners: list[int] = []
        self.paths: list[int] = []
        self.kinds: list[int] = []
        self.gone: list[bool] = []
        self.looks: list[list[str]] = []
        self._stack: list[tuple[str, int]] = []  # tag, element that owns text here
        self._open: dict[str, list[int]] = {}  # places in the stack of each tag
        self._fences: list[int] = []
        self._main = 0
        self._element("", {}, -1)
        at, last, quoted = 0, source.rfind(">"), True
        while at < len(source):
            m = TAG.search(source, at) if at <= last else None
            if not m:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            # quotes that never close are characters, from here to the end of the page
            rest = REST.match(source, at) if quoted else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:
                quoted = False
                end = source.find(">", at)
                if end < 0:
                    self._text(source[m.start() :])
                    break
                attributes, at = source[at:end], end + 1
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                    at = end.start() if end else len(source)

    def _owner(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append(entities.unescape(text) if "&" in text else text)
            self.owners.append(self._owner())

    def _break(self) -> None:
        self.pieces.append("\n")
        self.owners.append(self._owner())

    def _start(self, tag: str, attributes: str) -> None:
        for other in ENDS.get(tag, ()):
            at = self._open.get(other)
            if at and (not self._fences or at[-1] >= self._fences[-1]):
                self._pop_to(at[-1])
        owner = self._owner()
        self.looks[owner].append(tag)
        if tag in INLINE:
            if tag in VOID:
                return
        else:
            self._break()
            if tag in VOID:
                return
            found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
            owner = self._element(tag, found, owner)
        if tag in FENCE:
            self._fences.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, owner))
        self._main += tag in MAIN

    def _element(self, tag: str, found: dict[str, str], parent: int) -> int:
        """A new element below ``parent``; what is said of an element holds for all below it."""
        classes = sorted(found.get("class", "").split())
        style = ".".join([tag, *classes]) + ("#" + found["id"] if found.get("id") else "")
        above = self.paths[parent] if parent >= 0 else 0
        self.paths.append(xxhash.xxh64_intdigest(f"{above}>{style}") >> 1)
        self.looks.append([])
        self.kinds.append(self._kind(tag, found, self.kinds[parent] if parent >= 0 else PLAIN, bool(classes or found.get("id"))))
        self.gone.append(parent >= 0 and self.gone[parent] or self._no_text(tag, found))
        return len(self.paths) - 1

    def _kind(self, tag: str, found: dict[str, str], above: int, named: bool) -> int:
        if above == DECLARED or above == WORDED and tag not in MAIN:
            return above
        if tag in FURNITURE or tag == "header" and not self._main or found.get("role", "").lower() in FURNITURE_ROLES:
            return DECLARED
        whole, words = _names(found)
        if tag not in MAIN and tag not in ("html", "body") and (whole & ADVERTS or not self._main and words & FURNITURE_WORDS | words & {"header"}):
            return WORDED
        if not self._main and tag not in MAIN:
            return PLAIN
        return CLASSED if above == CLASSED or named and tag not in MAIN else BARE

    def _no_text(self, tag: str, found: dict[str, str]) -> bool:
        if tag in NO_TEXT:
            return True
        whole, words = _names(found)
        return tag not in ("html", "body") and bool(whole & COMMENTS if self._main else words & COMMENT_WORDS)

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            tag, _ = self._stack.pop()
            self._open[tag].pop()
            if tag in FENCE:
                self._fences.pop()
            self._main -= tag in MAIN
            if tag not in INLINE:
                self._break()

    def _end(self, tag: str) -> None:
        at = self._open.get(tag)
        if at and (tag in FENCE or not self._fences or at[-1] > self._fences[-1]):
            self._pop_to(at[-1])

    def nodes(self) -> list[tuple[int, int, int, int]]:
        """(path, content, presentation, size) for each part of text that an element has of its own: hashes of the part and of the tags of its children, and the part's length."""
        own: dict[int, list[str]] = {}
        for piece, owner in zip(self.pieces, self.owners, strict=True):
            if not self.gone[owner]:
                own.setdefault(owner, []).append(piece)
        digest = xxhash.xxh64_intdigest
        rows = []
        for i, parts in own.items():
            words = "".join(parts).split()
            if words:
                look = digest(" ".join(self.looks[i])) >> 1
                rows += [(self.paths[i], digest(f"{self.paths[i]} {t}") >> 1, look, len(t)) for t in (_parts(words) if len(words) <= SHORT else [" ".join(words)])]
        return rows

    def main_text(self, tree: dict[int, tuple[int, float]], least: float = LEAST_IMPORTANCE) -> str:
        """The page's text less what is no text and elements whose importance is below ``least``; ``tree`` has (pages, importance) by path.

        If nothing is left, what lies in an article or bears no name of furniture is.
        """
        stays = [not gone and importance(kind, *tree.get(path, (0, 1.0))) >= least for path, kind, gone in zip(self.paths, self.kinds, self.gone, strict=True)]
        text = self._joined(stays)
        return text or self._joined([not gone and kind in (PLAIN, CLASSED, BARE) for kind, gone in zip(self.kinds, self.gone, strict=True)])

    def _joined(self, stays: list[bool]) -> str:
        return " ".join("".join([p for p, o in zip(self.pieces, self.owners, strict=True) if stays[o] or p == "\n"]).split())


def _parts(words: list[str]) -> list[str]:
    out, part = [], []
    for word in words:
        part.append(word)
        if not word[-1].isalnum():
            out.append(" ".join(part))
            part = []
    return [*out, " ".join(part)] if part else out


def _names(found: dict[str, str]) -> tuple[set[str], set[str]]:
    """Whole classes and ids, and the words in them."""
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    return set(names.split()), set(re.split(r"[^a-z]+", names)) if found else set()


def importance(kind: int, pages: int, seen: float) -> float:
    """What a site's ``pages`` with such an element have shown (``seen``), drawn to what its kind lets expect."""
    share = max(PRIOR_PAGES / (PRIOR_PAGES + pages), PRIOR_SHARE[kind])
    return share * PRIOR[kind] + (1 - share) * seen


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), HOST, 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages and importance (0 to 1) of the elements with text on the pages (url, html) of each host.

    Pages merge by host and path; m of a host's distinct pages have the path. A part of text on k of them has entropy log k to the base m, or, if that is more, what it has
    among the pages of all hosts. Content importance is 1 less the mean entropy of an element's parts, by their length. Presentation importance is the entropy of its children's tags.
    Importance is content, raised by presentation where that is more, with weight 1 - ``GAMMA`` ** presentations.
    Only hashes are shuffled, counted before they are; copies of a page count once for their host.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, xxhash.xxh64_intdigest(source) >> 1, *map(list, zip(*Page(source).nodes(), strict=True))) for h, source in zip(pdf["host"], pdf["html"], strict=True)]
            yield pd.DataFrame([r if len(r) == 6 else (*r, [], [], [], []) for r in rows], columns=["host", "page", "path", "content", "look", "size"])

    source = pages.select(_host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parsed = source.mapInPandas(run, "host string, page long, path array<long>, content array<long>, look array<long>, size array<int>")
    each = settle(parsed.dropDuplicates(["host", "page"]).select("host", F.arrays_zip("path", "content", "look", "size").alias("e")))
    key = ["host", "path"]

    def counted(*values: str) -> DataFrame:
        """Pages of each host, path and values: within a page, like values count once."""
        pairs = F.array_distinct(F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in ("path", *values)])))
        return each.select("host", F.explode(pairs).alias("e")).select("host", "e.*").groupBy(*key, *values).agg(F.count("*").alias("k"))

    with_path = each.select("host", F.explode(F.array_distinct(F.transform("e", lambda e: e["path"]))).alias("path"))
    own = with_path.groupBy(*key).agg(F.count("*").alias("m"))
    own = settle(own)
    every = settle(own.groupBy("path").agg(F.sum("m").alias("every"), F.count("*").alias("n")))
    held = settle(join_spread(own, every.drop("n"), "path", every))
    texts = settle(counted("content", "size"))
    # parts on one page only have no entropy: they aren't joined
    repeated = settle(texts.groupBy("content").agg(F.sum("k").alias("all"), F.count("*").alias("n")).where(F.col("all") > 1))
    kinds = join_spread(texts, repeated.drop("n"), "content", repeated).groupBy(*key, "k", "all").agg(F.sum(F.col("k") * F.col("size")).alias("n"))
    entropy = F.greatest(*[F.when(of > 1, F.log(count) / F.log(of)).otherwise(0.0) for count, of in ((F.col("k"), F.col("m")), (F.col("all"), F.col("every")))])
    shared = kinds.join(held, key).groupBy(*key).agg(F.sum(F.col("n") * entropy).alias("shared"))
    total = texts.groupBy(*key).agg(F.sum(F.col("k") * F.col("size")).alias("n"))
    looks = counted("look").groupBy(*key).agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.log("k")).alias("ks"), F.count("*").alias("kinds"))
    look = F.when(F.col("s") > 1, 1 - F.col("ks") / (F.col("s") * F.log("s"))).otherwise(0.0)
    content = 1 - F.coalesce("shared", F.lit(0.0)) / F.col("n")
    weight = F.pow(F.lit(GAMMA), F.least(F.col("kinds"), F.lit(100)))
    found = held.join(total, key).join(looks, key).join(shared, key, "left").select(*key, F.col("m").alias("pages"), content.alias("content"), look.alias("look"), weight.alias("w"))
    return found.select(*key, "pages", ((1 - F.col("w")) * F.greatest("content", "look") + F.col("w") * F.col("content")).alias("importance"))


def extract_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html); other columns are left out.

    White space is what Unicode calls so. Null html gives an empty text, a null url the host "". Repeated rows stay repeated; page_id may be null. Text after the
    last tag and unclosed elements are kept; very long and deep pages take time in proportion. An empty table gives no rows.
    """
    # paths that aren't told count as never repeated: right for plain elements, and for named ones seen on few pages
    told = settle(style_tree(pages).where((F.col("importance") < SURE) | (F.col("pages") > PRIOR_PAGES / 2)))
    size = told.agg(F.sum(24 + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host().alias("host"))
    found = _by_broadcast(rows, told, least) if size <= BROADCAST_BYTES else _by_host(rows, told, least)
    return found.withColumn("page_id", F.col("page_id").cast("long"))


TEXTS = "page_id string, url string, text string, n_chars long"


def _by_broadcast(rows: DataFrame, told: DataFrame, least: float) -> DataFrame:
    """Texts of ``rows`` (page_id, url, html, host) where they are, with all site trees as one broadcast table, ordered by host."""
    table = told.select("host", "path", "pages", "importance").toPandas().sort_values("host", kind="stable")
    hosts, first = np.unique(table["host"].to_numpy(dtype=str), return_index=True)
    ends = [*first[1:].tolist(), len(table)][: len(first)]  # none, where nothing is told
    places = dict(zip(hosts.tolist(), zip(first.tolist(), ends, strict=True), strict=True))
    shared = rows.sparkSession.sparkContext.broadcast((places, *(table[c].to_numpy() for c in ("path", "pages", "importance"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, path, of, seen = shared.value
        trees: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                if host not in trees:
                    if len(trees) >= 256:
                        trees.clear()
                    i, j = places.get(host, (0, 0))
                    trees[host] = dict(zip(path[i:j].tolist(), zip(of[i:j].tolist(), seen[i:j].tolist(), strict=True), strict=True))
                texts.append(Page(source).main_text(trees[host], least))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, TEXTS)


def _by_host(rows: DataFrame, told: DataFrame, least: float, task_pages: int = TASK_PAGES) -> DataFrame:
    """The same with pages dealt by host, hot hosts over several tasks. In each task the rows of a host's tree come before its pages: a tree travels once for each task that has pages of the host."""
    parts = rows.groupBy("host").count().where(F.col("count") > task_pages).select("host", F.ceil(F.col("count") / task_pages).cast("int").alias("parts"))
    parts = F.broadcast(settle(parts))  # at most a host for each ``task_pages`` pages
    nothing = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    dealt = rows.join(parts, "host", "left").select("host", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("is_page"), "page_id", "url", "html", *nothing(path="long", pages="long", importance="double"))
    each = told.join(parts, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    each = each.select("host", "part", F.lit(0).alias("is_page"), *nothing(page_id="string", url="string", html="string"), "path", "pages", "importance")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tree = None, {}
        for pdf in batches:
            out = []
            for host, part, is_page, page_id, url, source, path, of, seen in zip(*(pdf[c] for c in ("host", "part", "is_page", "page_id", "url", "html", "path", "pages", "importance")), strict=True):
                if (host, part) != now:
                    now, tree = (host, part), {}
                if is_page:
                    text = Page(source).main_text(tree, least)
                    out.append((page_id, url, text, len(text)))
                else:
                    tree[int(path)] = (int(of), float(seen))
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])

    both = dealt.unionByName(each)
    # numbers with nulls among them would become floats in pandas, which hold no path
    return both.withColumn("path", F.col("path").cast("string")).repartition("host", "part").sortWithinPartitions("host", "part", "is_page").mapInPandas(run, TEXTS)
