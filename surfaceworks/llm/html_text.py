"""HTML extraction by consensus of a host's pages.

Every page scores its containers: an element's share of the page's prose, raised for elements that
are named as articles. The page votes for the generalised tag-class path of the best one; votes are
counted for each host in Spark, and paths with at least ``WINS`` of a host's votes win there, so a
host has 20 winners at most. Every page is then read again: the first winner of its host that it has
tells where its text is; a page that has none of them uses its own best container.

Only (host, path key) pairs are shuffled for the votes. The pages themselves stay where they are read
as long as the winners of all hosts are few enough to be broadcast; beyond that, they are dealt by
host and a salt, so a hot host is split.
"""

from __future__ import annotations

import collections
import hashlib
import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import Stash, bound_batches, give_back
from .lines import host_of

#: A path wins with this share of its host's votes.
WINS = 0.05
#: A container's score is the share of the page's prose in it, times a factor for its name, times
#: ``TITLED`` if it holds a first-level heading, divided by ``MOST`` for each level of depth: so an inner
#: container with so much of the outer one's prose is preferred.
MOST, TITLED = 0.85, 1.2
#: Hosts whose winners are broadcast, at most: 20 winners of 16 bytes each, 10 MB in all.
MOST_HOSTS, SALTS = 20_000, 64

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_CHANGING = re.compile(r"(?<![a-z])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![a-z])|\d+")

# Elements of HTML by what they do.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
_SKIPPED = frozenset("button select noscript template svg object canvas audio video".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends when it is open, up to the elements where the search stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ()),
}
_NEVER = frozenset("head nav footer aside form dialog menu search fieldset legend".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of a text, never its container.
_WITHIN = frozenset("p li td th tr dd dt ul ol dl pre blockquote figure figcaption html".split()) | _HEADINGS
#: Words of classes and ids: of reader comments, of other parts that aren't the article, of headers, of the article.
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
_PARTS = frozenset(
    "nav navbar navigation navi menu menus submenu sidebar sidebars aside footer foot colophon ad ads adv advert adverts advertisement advertising adsense adslot banner banners promo promos promotion sponsor sponsored "
    "sponsors cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay toast newsletter subscribe subscription signup login signin share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget widgets toolbar search form skip copyright paywall teaser".split()
)
_HEADERS = frozenset("header masthead topbar".split())
_ARTICLE = frozenset("article content main post entry story body text page".split())
#: With one of these a class tells about its surroundings.
_ABOUT = frozenset("has with without no not open closed is hide".split())


class Page:
    """A page's elements and blocks. Element 0 is the page itself; parents come before their children."""

    def __init__(self, html: str):
        self.parent, self.tag, self.label, self.words, self.mark = [-1], [""], [""], [frozenset()], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self._read(html)

    def _read(self, html: str) -> None:
        stack, parts, linked, in_link = [0], [], 0, False
        at, size, pattern, endless = 0, len(html), _TAG, set()
        open_now = collections.Counter()

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def say(raw: str):
            nonlocal linked
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

        def close_to(depth: int):
            flush()
            for e in stack[depth:]:
                open_now[self.tag[e]] -= 1
            del stack[depth:]

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                say(html[at:lt])
            if lt == size:
                break
            after = html[lt + 1 : lt + 2]
            if after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
                end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
                if end < 0:
                    break  # a comment without an end holds the rest
                at = end + (3 if html.startswith("<!--", lt) else 1)
                continue
            if not (after == "/" or (after.isascii() and after.isalpha())):
                say("<")
                at = lt + 1
                continue
            found = pattern.match(html, lt)
            if not found and pattern is _TAG:
                pattern = _LOOSE  # a quote that doesn't end; from here on tags end at the next sign
                found = pattern.match(html, lt)
            if not found:
                if after == "/" and html.find(">", lt) >= 0:
                    at = html.find(">", lt) + 1
                    continue
                break  # a tag without an end holds the rest
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                if tag == "a":
                    in_link = False
                elif tag in _BLOCKS and open_now[tag]:
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != tag:
                        depth -= 1
                    close_to(depth)
                elif tag in _BLOCKS:
                    flush()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                in_link = True
                continue
            if tag in _RAW or tag in _SKIPPED:
                end = re.compile(f"</{tag}(?![a-z0-9])", re.I).search(html, at) if tag not in endless else None
                if end:
                    at = html.find(">", end.end()) + 1 or size
                elif tag in _RAW:
                    break
                else:
                    endless.add(tag)
                continue
            if tag not in _BLOCKS:
                continue
            flush()
            if self.tag[stack[-1]] == "p" or (tag in _HEADINGS and self.tag[stack[-1]] in _HEADINGS):
                close_to(len(stack) - 1)
            ends, stops = _ENDS.get(tag, ((), ()))
            left = sum(open_now[x] for x in ends)
            if left:
                depth = low = len(stack)
                while left and depth > 1 and self.tag[stack[depth - 1]] not in stops:
                    depth -= 1
                    if self.tag[stack[depth]] in ends:
                        low, left = depth, left - 1
                close_to(low)
            if tag in _VOID:
                continue
            stack.append(self._open(stack[-1], tag, found[3]))
            open_now[tag] += 1
        flush()

    def _open(self, parent: int, tag: str, raw: str) -> int:
        label, words, mark = tag, frozenset(), "never" if tag in _NEVER else "header" if tag == "header" else ""
        if raw and not raw.isspace():
            attributes = {}
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                attributes.setdefault(name.lower(), a or b or c)
            classes = references.unescape(attributes.get("class", "")).split()
            general = sorted({_CHANGING.sub("#", c.lower()) for c in classes})
            label = ".".join([tag, *general])
            found: set[str] = set()
            for token in [*classes, *attributes.get("id", "").split()]:
                own = {w.lower() for w in _WORDS.findall(token)}
                if not own & _ABOUT:
                    found |= own
            words = frozenset(found)
            if attributes.get("itemprop", "").lower() == "articlebody" or attributes.get("role", "").lower() == "main":
                words |= {"article"}
            style = attributes.get("style", "").replace(" ", "").lower()
            if not mark and tag not in ("html", "body", "main"):
                if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or "display:none" in style or attributes.get("aria-hidden", "").lower() == "true":
                    mark = "never"
                elif words & _COMMENTS:
                    mark = "never"
                elif words & _HEADERS:
                    mark = "header"
                elif words & _PARTS:
                    mark = "part"
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(label)
        self.words.append(words)
        self.mark.append(mark)
        return len(self.tag) - 1

    def keys(self) -> list[bytes]:
        """A key of each element's path: of its label and its parent's key, so depth costs nothing."""
        out = [b""]
        for e in range(1, len(self.tag)):
            out.append(hashlib.blake2b(out[self.parent[e]] + self.label[e].encode("utf-8", "replace"), digest_size=16).digest())
        return out

    def outside(self) -> tuple[list[bool], list[bool]]:
        """Whether an element isn't part of an article; and whether it's a header of one, of which headings stay."""
        core = [False] * len(self.tag)
        articles = [e for e, t in enumerate(self.tag) if t == "article" and self.mark[e] != "never"]
        for e in [e for e, t in enumerate(self.tag) if t in ("main", "h1")] + (articles if len(articles) == 1 else []):
            e = self.parent[e]
            while e > 0 and not core[e]:
                core[e], e = True, self.parent[e]
        out, head, within = [False], [False], [False]
        for e in range(1, len(self.tag)):
            p, mark = self.parent[e], self.mark[e]
            out.append(out[p] or mark == "never" or (mark == "part" and not core[e]) or (mark == "header" and not within[p] and not (core[e] and self.tag[e] != "header")))
            head.append(head[p] or (mark == "header" and within[p]))
            within.append(within[p] or self.tag[e] in ("article", "main") or bool(self.words[e] & _ARTICLE and mark == "" and self.tag[e] != "body"))
        return out, head

    def best(self) -> int:
        """The container with the highest score; of equal ones the deepest, then the first. 0 if the page has no prose."""
        out, head = self.outside()
        weight = [0.0] * len(self.tag)
        for e, text, linked in self.blocks:
            if not out[e] and not head[e]:
                prose = len(text) >= 40 or text[-1] in ".!?…。"
                weight[e] += (len(text) - linked) * (1.0 if prose else 0.2)
        for e in range(len(self.tag) - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
        if not weight[0]:
            articles = [e for e in range(1, len(self.tag)) if not out[e] and self.tag[e] in ("article", "main")]
            return articles[0] if articles else 0
        titled = [False] * len(self.tag)
        for e in range(len(self.tag) - 1, 0, -1):
            titled[e] |= self.tag[e] == "h1" and not out[e]
            titled[self.parent[e]] |= titled[e]
        depth, best = [0], (0.0, 0, 0)
        for e in range(1, len(self.tag)):
            depth.append(depth[self.parent[e]] + 1)
            if weight[e] and not out[e] and self.tag[e] not in _WITHIN:
                prior = 2.0 if self.tag[e] == "article" else 1.4 if self.tag[e] == "main" else 1.3 if self.words[e] & _ARTICLE and self.tag[e] != "body" else 1.0
                score = math.log(weight[e] / weight[0] * prior * (TITLED if titled[e] else 1.0)) - depth[e] * math.log(MOST)
                best = max(best, (score, depth[e], -e))
        return -best[2]

    def text(self, wanted: list[bool]) -> str:
        """The blocks within wanted elements in page order, without what isn't part of an article."""
        out, head = self.outside()
        within = list(wanted)
        for e in range(1, len(self.tag)):
            within[e] = within[e] or within[self.parent[e]]
        return "\n\n".join(t for e, t, _ in self.blocks if within[e] and not out[e] and (not head[e] or self.tag[e] in _HEADINGS))

    def path(self, e: int) -> str:
        names = []
        while e > 0:
            names.append(self.label[e])
            e = self.parent[e]
        return "/".join(reversed(names))


def choose(page: Page, winners: list[bytes]) -> tuple[str, str]:
    """(text, path): by the first of the winning path keys that the page has, else by its own best container."""
    keys = page.keys() if winners else []
    have = set(keys)
    key = next((w for w in winners if w in have), None)
    if key is None:
        best = page.best()
        wanted, where = [e == best for e in range(len(page.tag))], page.path(best)
    else:
        wanted, where = [k == key for k in keys], page.path(keys.index(key))
    return page.text(wanted), where


def _votes(html: DataFrame) -> DataFrame:
    """(host, key) of each page that has a container."""

    def run(batches):
        for batch in batches:
            hosts, keys = [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(text.as_py() or "")
                best = page.best()
                if best:
                    hosts.append(host)
                    keys.append(page.keys()[best])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary())], ["host", "key"])
        give_back()

    return html.mapInArrow(run, "host string, key binary")


def winners(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(host, keys): the keys of a host's winning paths, most votes first, ties by key. Lazy."""
    counted = _votes(pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"))).groupBy("host", "key").agg(F.count("*").alias("n"))
    counted = Stash(pages.sparkSession, "votes").put(counted)
    totals = counted.groupBy(F.col("host").alias("of")).agg(F.sum("n").alias("total"))
    won = counted.join(totals, F.col("host") == F.col("of")).where(F.col("n") >= F.lit(WINS) * F.col("total"))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), lambda x: x["key"]).alias("keys"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", most_hosts: int = MOST_HOSTS) -> DataFrame:
    """All rows and columns of pages but the HTML; adds text, n_chars and path. Runs jobs.

    Blocks are what block-level tags separate; character references are decoded, white space (of any
    kind, line breaks included) becomes one space, blocks are joined by two newlines. Menus, headers,
    footers, sidebars, notices, adverts, forms and reader comments are told by element, role and words
    of class or id; of an article's own header the headings stay. Null and empty pages, and pages without
    prose, give an empty text; a null or odd address is the host ''; repeated rows stay and vote each.
    Unclosed tags, comments, scripts and quotes are read as browsers do, in linear time. Columns of pages
    named as the added ones are replaced; the rest may have any names.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    host = host_of(F.col(f"`{url_col}`"))
    won = Stash(spark, "winners").put(winners(pages, host, html_col))
    own = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "path")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias("no_column")).alias("page"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    keys = won.select(F.col("host").alias("of"), "keys")
    if won.count() <= most_hosts:
        rows = rows.join(F.broadcast(keys), F.col("host") == F.col("of"), "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
        keys = keys.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(keys, (F.col("host") == F.col("of")) & (F.coalesce("salt", F.lit(0)) == F.col("to")), "left")
    rows = rows.select("page", "html", "keys")

    def run(batches):
        for batch in batches:
            texts, paths = [], []
            for html, some in zip(batch.column(1), batch.column(2), strict=True):
                text, path = choose(Page(html.as_py() or ""), some.as_py() or [])
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(paths, pa.string())], ["page", "text", "path"])
        give_back()

    out = rows.mapInArrow(run, StructType([rows.schema["page"], StructField("text", StringType()), StructField("path", StringType())]))
    return out.select(*[F.col(f"page.`{c}`").alias(c) for c in own], "text", F.length("text").cast("long").alias("n_chars"), "path")
