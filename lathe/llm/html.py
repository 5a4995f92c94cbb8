"""Main text of web pages: markup rules and nearest-URL page differencing.

Pages are put in order of host and URL path; the nearest of the two neighbours
of a host (the one with the longer common path) is a page's partner. The lines
of both, those of menus and notices too, are aligned by longest common
subsequence, and lines that both share are template and are deleted.
Differencing alone can't give the main text where menus and notices differ from
page to page, and would delete an article that two pages share. So lines inside
an article or main element are never deleted, and of the lines that are left
those go whose element is no article by its tag, role, class or id (by the last
word of a name, and not if it holds an article).
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Parts of the page order that a page is dealt to; at most two keys of each go to the driver.
PARTS = 1 << 16
#: Rows per part aimed at.
PART_ROWS = 512

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "noframes", "xmp"}
SKIP = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "audio", "video", "map", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that a new block of the kind closes when their end tag is left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark what is no article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "header", "footer", "masthead", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "pagination", "pager", "toolbar",
    "widget", "search", "skip", "copyright", "legal", "disclaimer",
}
#: First words of classes that only say what else a page has.
LAYOUT = {"has", "no", "not", "with", "without", "is", "hide", "show"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no article in any case, and whether a class or id says so."""
    if tag in SKIP:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "role" and value.strip().lower() in ROLES:
            return True, False
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name in ("class", "id") and tag not in MAIN:
            named = named or any(map(_marks, value.split()))
    return False, named


def _marks(token: str) -> bool:
    """Whether the last word of a class or id, its head, marks what is no article."""
    words = [w for w in _NAME.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token).lower()) if not w.isdigit()]
    return bool(words) and LAYOUT.isdisjoint(words) and words[-1] in NAMES


@dataclass(frozen=True)
class Line:
    """A text block: whether it stands in an article or main element, and whether in one that is no article."""

    text: str
    main: bool = False
    aside: bool = False


def lines(page: str | None) -> list[tuple[str, bool]]:
    """Text blocks of a page outside boilerplate elements, and whether each stands in an article or main element."""
    return [(x.text, x.main) for x in all_lines(page) if not x.aside]


def all_lines(page: str | None) -> list[Line]:
    """All text blocks of a page.

    An element that a class or id marks as no article is one after all if it holds an article or main element.
    """
    if not page:
        return []
    out, holders = _read(page, frozenset())
    return _read(page, holders)[0] if holders else out


def _read(page: str, holders: frozenset[int]) -> tuple[list[Line], frozenset[int]]:
    """The blocks, and the places of the marked elements that hold an article; those of ``holders`` are read as articles."""
    out: list[Line] = []
    inside: list[str] = []
    beside: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    found: set[int] = set()
    skipping = mains = 0

    def flush() -> None:
        for held, aside in ((beside, True), (inside, False)):
            if held and (aside or not skipping):
                text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
                held.clear()
                if text:
                    out.append(Line(text, mains > 0 and not aside, aside))

    def pop() -> None:
        nonlocal skipping, mains
        tag, skip, main, _ = stack.pop()
        opened[tag] -= 1
        skipping -= skip
        mains -= main

    def put(text: str) -> None:
        (beside if skipping else inside).append(text)

    at = 0
    n = len(page)
    lower = None
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        # An attribute whose quote is never closed ends with its tag.
        closing_tag, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3])
            continue
        tag = tag.lower()
        block = tag in BLOCKS or tag in SKIP
        if block:
            flush()
        if closing_tag:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else page
            end = lower.find(f"</{tag}", at)
            if end < 0 and tag in ("script", "style", "textarea", "title", "xmp"):
                end = n
            if end >= 0:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            continue
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCKS:
            continue
        for closing in (CLOSES.get(tag) or ()):
            if stack and stack[-1][0] == closing:
                pop()
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            pop()
        (never, named), main = _boilerplate(tag, attributes), tag in MAIN
        if never and tag == "header" and mains and not skipping:
            never = False  # an article's own header holds its title
        if main and not never:
            found.update(place for *_, place in stack if place >= 0)
        skip = never or named and m.start() not in holders
        stack.append((tag, skip, main, m.start() if named else -1))
        opened[tag] += 1
        skipping += skip
        mains += main
    skipping = 0
    flush()
    return out, frozenset(found)


def common(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence of both line lists (equal lines matched by rank, ties to the first)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = {*range(start), *range(len(a) - stop, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(start, len(b) - stop):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chain: list[tuple] = []
    for i in range(start, len(a) - stop):
        for j in reversed(places.get(a[i], ())):
            k = bisect_right(tails, j - 1)
            node = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(node)
            else:
                tails[k] = j
                chain[k] = node
    node = chain[-1] if chain else None
    while node is not None:
        found.add(node[0])
        node = node[1]
    return found


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def difference(own: list[tuple[str, bool]], partner: list[tuple[str, bool]]) -> str:
    """The text of lines, each with whether it stands in an article, without those that the partner shares."""
    return main_text([Line(*x) for x in own], [Line(*x) for x in partner])[0]


def main_text(own: list[Line], partner: list[Line]) -> tuple[str, int]:
    """The page's text without the lines that its partner shares and those beside the article, and the number of shared lines deleted.

    Lines of articles stay. If all lines that the elements don't mark are
    shared, the pages are copies of each other, and only marked ones are deleted.
    """
    both = common([x.text for x in own], [x.text for x in partner]) if partner else set()
    free = [i for i, x in enumerate(own) if not x.main and not x.aside]
    copies = not any(x.main for x in own) and all(i in both for i in free)
    shared_lines = {i for i in both if own[i].aside or not own[i].main and not copies}
    return " ".join(x.text for i, x in enumerate(own) if i not in shared_lines and not x.aside), len(shared_lines)


@shared.tidy
def _walk(batches):
    """Differences each page of the ordered stream with its nearer neighbour."""
    done: list[tuple] = []
    before = current = None

    def finish(after):
        if current is None or current[5]:
            return
        best = None
        for other in (before, after):
            if other is not None and other[0] == current[0] and other[1] == current[1]:
                near = _shared_prefix(other[2], current[2])
                if best is None or near > best[0]:
                    best = (near, other)
        text, deleted = main_text(current[6], best[1][6] if best else [])
        done.append((current[3], current[4], text, len(text), deleted))

    for batch in batches:
        for part, host, path, page_id, url, page, halo in zip(batch["part"], batch["host"], batch["path"], batch["page_id"], batch["url"], batch["html"], batch["halo"]):
            nxt = (part, host, path, page_id, url, halo, all_lines(page))
            finish(nxt)
            before, current = current, nxt
        if len(done) >= 256:
            yield _frame(done)
            done.clear()
    finish(None)
    if done:
        yield _frame(done)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"page_id": pd.array([r[0] for r in rows], dtype="object"), "url": [r[1] for r in rows], "text": [r[2] for r in rows], "n_chars": [r[3] for r in rows], "n_template_lines": [r[4] for r in rows]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_template_lines (those that differencing deleted) of every page.

    Null and empty html give an empty text; null URLs form a host of their own.
    Repeated rows are pages of their own; an empty table gives no rows; extra
    columns are not read. The order is cut at PARTS places at most; the keys of
    the pages at the cuts go to the driver, and those pages are dealt to both
    sides, so a page's partner does not depend on the partitions.
    """
    spark = pages.sparkSession
    bare = F.split(F.regexp_replace(F.trim(F.coalesce(F.col(url_col), F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#]", 2)[0]
    host = F.lower(F.substring_index(bare, "/", 1))
    path = F.when(F.instr(bare, "/") > 0, F.substring(bare, F.instr(bare, "/") + 1, F.length(bare))).otherwise(F.lit(""))
    keyed = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path")
    )
    key = F.struct(F.col("host").alias("h"), F.col("path").alias("p"), F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("i"))
    keys = keyed.select(key.alias("k"))
    total = keys.count()
    parts = max(1, min(PARTS, -(-total // PART_ROWS)))
    ordered = shared.materialize(keys.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()))
    edges = ordered.groupBy("part").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    encoded = sorted((_order(*e["lo"]), _order(*e["hi"])) for e in edges)
    starts = [lo for lo, _ in encoded]

    @F.pandas_udf("array<int>")
    def deal(h: pd.Series, p: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(h, p, i):
            k = _order(a, b, c)
            mine = max(bisect_right(starts, k) - 1, 0)
            to = [mine]
            if mine > 0 and k == encoded[mine][0]:
                to.append(mine - 1)
            if mine + 1 < len(encoded) and k == encoded[mine][1]:
                to.append(mine + 1)
            out.append(np.array(to, dtype=np.int32))
        return pd.Series(out)

    number = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    dealt = keyed.select("*", F.posexplode(deal("host", "path", number)).alias("halo", "part"))
    dealt = dealt.withColumn("halo", F.col("halo") > 0)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = dealt.repartition(width, "part").sortWithinPartitions("part", "host", "path", number, F.xxhash64("html"))
    kind = keyed.schema["page_id"].dataType.simpleString()
    return stream.mapInPandas(_walk, f"page_id {kind}, url string, text string, n_chars long, n_template_lines long")


def _order(host: str, path: str, number: int) -> tuple[bytes, bytes, int]:
    """A key that sorts as Spark sorts strings: by their bytes."""
    return host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), int(number)
