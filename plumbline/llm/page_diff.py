"""HTML extraction by differencing a page with its nearest pages by URL.

Pages are sorted by host and URL path; a page is paired with the nearest pages of its host in that order. Text lines (one
block of text each) of a pair are aligned by longest common subsequence, and lines that both share are deleted: menus,
notices and other template text repeat, articles don't. Where a page has an explicit article element, only that is taken, and its
lines are differenced too. Three guards keep articles whole: a pair whose pages agree in nearly all of what is their own are copies,
say nothing about templates, and make room for the next nearest page; a line of an explicit article goes only if every one of
``PARTNERS`` pages shares it, so a passage that two articles share stays; and an article is never deleted to the last line. A
page's own lines are those that most pages of the host around it don't have, so a large menu does not make two pages copies.
Elements that name themselves as navigation, footer, advert, form, script and the like are dropped in any case.

Pairs are found on narrow rows, pages of a host with equal lines as one: the order comes from range partitions, and blocks of 64
consecutive pages with eight more on either side are compared, so a host that holds a third of all pages is as cheap as others.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from zlib import adler32, crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import global_positions, hidden, need, quoted
from plumbline.session import cut_lineage

# fixed values: elements by their role
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | DROPPED
ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|comments?|replies|reply|disqus|share|sharing|social|related|newsletter|subscribe|signup|popup|modal|pagination|toolbar)(?=$|[\s_-])"
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|topbar)(?=$|[\s_-])")
#: Pages in a block, neighbours on either side that a page may be paired with, and with how many it is compared.
BLOCK, REACH, PARTNERS = 64, 8, 2
#: Pages that agree in this share of their own lines, or whose text but for this share is common, are copies of each other.
COPY, LEFT = 0.8, 0.05
PLAIN, ARTICLE = 0, 1


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text blocks in page order as (text, state); dropped elements leave none. White space runs become one space."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, article
    dropped = article = False
    at, text = 0, page or ""

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            if line:
                out.append((line, ARTICLE if article else PLAIN))
            held.clear()

    while True:
        m = TAG.search(text, at)
        piece = text[at : m.start() if m else len(text)]
        if piece and not dropped:
            held.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "br" and not dropped:
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, dropped, article = stack[k]
                    del stack[k:]
                    break
            continue
        if m.group(3).rstrip().endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = close.end() if close else len(text)
            continue
        if tag not in BLOCKS and not m.group(3):
            continue  # plain inline markup
        marks = " ".join(x for g in MARK.findall(m.group(3)) for x in g).lower() if "=" in m.group(3) else ""
        away = tag in DROPPED or (tag == "header" and not article)
        if marks and tag not in ("html", "body", "article", "main"):
            away = away or bool(ROLE.search(marks)) or (not article and bool(OUTSIDE.search(marks)))
        stack.append((tag, dropped, article))
        if away and not dropped:
            flush()
        dropped = dropped or away
        article = article or tag in ("article", "main") or "articlebody" in marks
    flush()
    return out


def common_lines(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence (matching places, longest increasing run)."""
    where: dict[int, list[int]] = {}
    for j, line in enumerate(b.tolist()):
        where.setdefault(line, []).append(j)
    tops: list[int] = []
    ends: list[tuple[int, int, object]] = []
    for i, line in enumerate(a.tolist()):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tops, j)
            link = (i, j, ends[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                ends.append(link)
            else:
                tops[k], ends[k] = j, link
    left, right, node = [], [], ends[-1] if ends else None
    while node is not None:
        left.append(node[0])
        right.append(node[1])
        node = node[2]
    return left[::-1], right[::-1]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _frequent(pages: list[np.ndarray]) -> np.ndarray:
    """Lines that more than half of these pages have; of fewer than three pages none are known."""
    if len(pages) < 3:
        return np.zeros(0, np.int64)
    values, n = np.unique(np.concatenate([np.unique(p) for p in pages]), return_counts=True)
    return values[2 * n > len(pages)]


def _copies(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, mine: list[int]) -> bool:
    """Whether two pages, given their own lines and the places in ``a`` of their common ones, are copies of each other."""
    length = lambda lines: int((lines & 0xFFFF).sum())
    common = length(a[mine])
    return own_a[mine].sum() >= COPY * max(own_a.sum(), own_b.sum()) or max(length(a), length(b)) - common <= LEFT * max(length(a), length(b))


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Places of the home pages of one block that a partner shares, and those that all of ``PARTNERS`` partners share."""
    rows = rows.sort_values("position", kind="stable")
    hosts, paths, lines, keys = rows["host"].to_list(), rows["path"].to_list(), [np.asarray(x, np.int64) for x in rows["lines"]], rows["sig"].to_list()
    frequent = {h: _frequent([x for x, of in zip(lines, hosts) if of == h and len(x)]) for h in set(hosts)}
    own = [~np.isin(x, frequent[h]) for x, h in zip(lines, hosts)]
    out_keys, out_places, out_firm = [], [], []
    for k, home in enumerate(rows["home"].to_list()):
        if not home or not len(lines[k]) or not hosts[k]:
            continue
        near = [j for j in range(max(0, k - REACH), min(len(keys), k + REACH + 1)) if j != k and hosts[j] == hosts[k]]
        near.sort(key=lambda j: (-_prefix(paths[j], paths[k]), abs(j - k), j))
        places, partners = Counter(), 0
        for j in near:
            mine, _ = common_lines(lines[k], lines[j])
            if _copies(lines[k], lines[j], own[k], own[j], mine):
                continue
            places.update(mine)
            partners += 1
            if partners == PARTNERS:
                break
        if places:
            out_keys.append(keys[k])
            out_places.append(sorted(places))
            out_firm.append(sorted(p for p, n in places.items() if n == PARTNERS))
    return pd.DataFrame({name: pd.Series(x, dtype="object") for name, x in (("sig", out_keys), ("places", out_places), ("firm", out_firm))})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_as: str = "main_text") -> DataFrame:
    """All rows with the main text.

    A null html or one without text gives an empty text. Pages without a url or host have no neighbours; repeated rows count as one
    page and get equal texts. Columns of the input stay; ``text_as`` must not clash. Empty tables give empty results.
    """
    need(pages, id_col, url_col, html_col)
    if text_as.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"{text_as!r} clashes with a column of the table")
    key, parsed, other = hidden(pages, "page_key", "page_blocks", "diff_key")
    row_key = F.xxhash64(quoted(id_col), quoted(url_col), quoted(html_col))

    @F.pandas_udf("array<bigint>")
    def line_hashes(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda p: [_line_hash(t) for t, _ in blocks(p)])

    @F.pandas_udf("array<struct<t:string,s:int>>")
    def parse(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda p: [{"t": t, "s": s} for t, s in blocks(p)])

    host = F.lower(F.regexp_extract(quoted(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1))
    path = F.regexp_extract(quoted(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+([^?#]*)", 1)
    narrow = pages.select(
        row_key.alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), line_hashes(quoted(html_col)).alias("lines")
    ).dropDuplicates(["key"])
    same_lines = F.md5(F.concat_ws(" ", F.col("host"), F.concat_ws(",", F.col("lines").cast("array<string>"))))
    narrow = cut_lineage(narrow.withColumn("sig", same_lines))
    first = narrow.groupBy("sig").agg(F.min(F.struct("host", "path", "key", "lines")).alias("first")).select("sig", "first.*")
    placed = global_positions(first, ["host", "path", "key"])
    block = F.floor(F.col("position") / BLOCK)
    inside = F.col("position") % BLOCK
    homes = F.array(
        block, F.when(inside < REACH, block - 1), F.when(inside >= BLOCK - REACH, block + 1)
    )
    copies = placed.select("*", block.alias("own"), F.explode(F.array_compact(homes)).alias("block")).withColumn("home", F.col("own") == F.col("block"))
    deleted = cut_lineage(copies.groupBy("block").applyInPandas(_compare, "sig string, places array<int>, firm array<int>"))
    deleted = cut_lineage(narrow.select(F.col("key").alias(other), "sig").join(deleted, "sig").select(other, "places", "firm"))
    joined = pages.withColumn(key, row_key).withColumn(parsed, parse(quoted(html_col)))
    slim = joined.drop(html_col) if html_col not in (id_col, url_col) else joined
    kept = slim.join(deleted, F.col(key) == F.col(other), "left")
    gone, firm = (F.coalesce(F.col(c), F.array().cast("array<int>")) for c in ("places", "firm"))
    whole = F.filter(F.col(parsed), lambda b: b["s"] == ARTICLE)
    article = F.filter(F.col(parsed), lambda b, i: (b["s"] == ARTICLE) & ~F.array_contains(firm, i))
    rest = F.filter(F.col(parsed), lambda b, i: ~F.array_contains(gone, i))
    main = F.when(F.size(article) > 0, article).when(F.size(whole) > 0, whole).otherwise(rest)
    text = F.array_join(F.transform(main, lambda b: b["t"]), "\n\n")
    return kept.select(*[quoted(c) for c in slim.columns if c not in (key, parsed)], text.alias(text_as))


def _line_hash(line: str) -> int:
    """47 bits of the line's hash above 16 bits of its length."""
    data = line.encode("utf-8", "surrogatepass")
    return ((crc32(data) << 15) | (adler32(data) & 0x7FFF)) << 16 | min(len(line), 0xFFFF)
