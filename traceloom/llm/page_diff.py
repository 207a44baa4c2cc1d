"""Operator 3, main text of web pages by differencing with the page of the nearest URL.

A page is cut into lines at its block elements. What markup itself calls a menu, header, footer, sidebar, notice,
advert, form, script, style, hidden part or reader comment is left out. Then each page is compared with the page
next to it by URL path in the same host (the one after it, else the one before): their lines are aligned by
longest common subsequence, and the lines they share are deleted as the site's own. Lines of an <article> or
<main> are the page's own by its markup; there, articles that are copies of each other would be lost, so they
take part in the alignment but are not deleted.

Defined results: null or empty html gives an empty text; a page without neighbour in its host, or without
URL, is judged by its markup alone; pages of one URL are ordered by page_id, and repeated rows are pages of their own, whose
lines outside of articles are then shared. Unclosed elements end with their
page, and a left-out element also where an <article> or <main> starts. Of equally long common subsequences any may be
taken. A very long page is parsed whole, in one task, in a few times its own size. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import partitions, range_bounds
from traceloom.llm.url_reputation import url_host, url_path

# Elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("aside button canvas datalist dialog footer form head header iframe menu nav noscript object select svg template textarea".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply search share sharing sidebar site-footer site-header social sponsor sponsored subscribe toolbar widget widgets".split()
)
PARTS = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs cookie cookies consent gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
OUTER_PARTS = frozenset("footer header".split())  # inside an article they name its own heading and end
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
MARKS = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_aside(attributes: str, inside: bool) -> bool:
    """Whether its attributes call an element, inside an article or not, something that is left out."""
    for name, value in MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split("[-_]+", word)
                if word in NAMES or not PARTS.isdisjoint(parts) or any(p.startswith("comment") for p in parts) or not inside and not OUTER_PARTS.isdisjoint(parts):
                    return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


def lines(html: str) -> list[tuple[bool, str]]:
    """(whether the markup calls it the page's own, text) of each line that the markup does not leave out."""
    out: list[tuple[bool, str]] = []
    text: list[str] = []
    own = skip = 0
    skipped = ""
    at = 0

    def close() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((own > 0, line))

    for m in TOKEN.finditer(html):
        if not skip and m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS and not skip:
            close()
        if m[2]:
            if skip and name == skipped:
                skip -= 1
            elif not skip and name in ("article", "main"):
                own = max(0, own - 1)
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        marked = bool(m[4]) and _is_aside(m[4], own > 0)
        if skip:
            if name in ("article", "main") and not marked and not own:
                skip = 0
            else:
                skip += name == skipped
                continue
        if marked and name not in ("html", "body") or name in LEFT_OUT and not (name == "header" and own):
            close()
            skip, skipped = 1, name
        elif name in ("article", "main"):
            own += 1
    if not skip:
        text.append(html[at:])
        close()
    return out


def common_subsequence(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b: a longest increasing run over the matches."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            ends[k : k + 1], nodes[k : k + 1] = [j], [node]
    found, node = set(), nodes[-1] if nodes else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_text(page: list[tuple[bool, str]], neighbour: list[tuple[bool, str]] | None) -> str:
    if neighbour and not all(own for own, _ in page):
        shared = common_subsequence([t for _, t in page], [t for _, t in neighbour])
        page = [x for i, x in enumerate(page) if x[0] or i not in shared]
    return "\n".join(t for _, t in page)


def _pack(page: list[tuple[bool, str]]) -> bytes:
    return zlib.compress("\n".join("+-"[not own] + t for own, t in page).encode(), 1)


def _unpack(data: bytes) -> list[tuple[bool, str]]:
    text = zlib.decompress(data).decode()
    return [(x[0] == "+", x[1:]) for x in text.split("\n")] if text else []


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for pages(page_id, url, html). Pages are parsed where they lie and moved once, as packed lines."""
    n = parts or partitions(pages.sparkSession)
    number = F.coalesce(F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit(""))
    key = F.concat_ws("\x00", url_host(F.col("url")), url_path(F.col("url")), number)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), key.alias("key"))
    heads, tails = range_bounds(keyed, "key", 3 * n)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, url, html, k in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["key"], strict=True):
                page = lines(html)
                part = bisect_right(heads, k) - 1
                page_id = None if pd.isna(page_id) else int(page_id)
                rows.append((part, 0, k, page_id, url, _pack(page)))
                # The first and last of a range are also read beside the ranges next to it.
                if k == heads[part] and part:
                    rows.append((part - 1, 1, k, None, None, rows[-1][-1]))
                if k == tails[part] and part + 1 < len(heads):
                    rows.append((part + 1, -1, k, None, None, rows[-1][-1]))
            yield pd.DataFrame(rows, columns=["part", "ghost", "key", "page_id", "url", "packed"]).astype({"page_id": "Int64"})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # part, host, lines
        wait: list | None = None  # part, host, lines, ghost, page_id, url, lines of the one before
        for pdf in batches:
            out = []
            for part, ghost, k, page_id, url, packed in pdf.itertuples(index=False):
                host, page = k.split("\x00", 1)[0], _unpack(packed)
                here = (part, host if host else None)
                if wait is not None:
                    out.append(_row(wait, page if wait[0] == here and here[1] else wait[4]))
                wait = None
                if not ghost:
                    wait = [here, page_id, url, page, last[1] if last is not None and last[0] == here and here[1] else None]
                last = (here, page)
            if out:
                yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})
        if wait is not None:
            yield pd.DataFrame([_row(wait, wait[4])], columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})

    def _row(wait: list, neighbour: list | None) -> tuple:
        text = main_text(wait[3], neighbour)
        return (None if pd.isna(wait[1]) else int(wait[1]), wait[2], text, len(text))

    packed = keyed.mapInPandas(parse, "part int, ghost int, key string, page_id long, url string, packed binary")
    # By number: hashed, several ranges would meet in one task and other tasks stay empty.
    ordered = packed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ghost", "key", "page_id")
    return ordered.mapInPandas(compare, "page_id long, url string, text string, n_chars long")
