"""Main text of web pages through paths that the pages of a host agree on.

Every page scores its containers. A container is known by its generalised path (tags and classes from
the body down, digits replaced). Spark adds up the scores per host and path, and each page is read again
at the path its host elected.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_CLASSES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# HTML element names by kind, and words in classes that mark what is not the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "header"}
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "related",
    "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "widget",
}
#: Open elements that a start tag closes, as far as the nearest one of the second set.
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Block:
    """A piece of running text, the containers around it (innermost last), and its characters inside links."""

    text: str
    inside: tuple[int, ...]
    linked: int


def host_of(url: str | None) -> str:
    """Lower-case host of a URL; empty without one."""
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return found[1].lower() if found else ""


def _step(tag: str, attributes: str) -> tuple[str, set[str]]:
    """A path step (tag and sorted classes, digits as 0) and the words of classes, id and role."""
    found = [next(filter(None, groups), "") for groups in _CLASSES.findall(attributes)] if attributes else []
    names = sorted({re.sub(r"\d+", "0", c) for value in found for c in value.lower().split()})
    return ".".join([tag, *names]), {w for name in names for w in re.split(r"[^a-z]+", name)}


def parse(page: str) -> tuple[list[str], list[Block]]:
    """Paths of the page's containers by number, and its text blocks outside menus, adverts and the like."""
    stack: list[tuple[str, str, bool, int]] = []  # tag, path, dropped, container number or -1
    paths: list[str] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = depth_of_links = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append(Block(text, tuple(n for _, _, _, n in stack if n >= 0), linked))
        linked = 0

    def close(depth: int) -> None:
        nonlocal depth_of_links
        depth_of_links -= sum(entry[0] == "a" for entry in stack[depth:])
        del stack[depth:]

    for token in _TOKEN.finditer(page):
        if token.start() > at and not (stack and stack[-1][2]):
            piece = page[at : token.start()]
            pieces.append(piece)
            linked += len(piece) if depth_of_links else 0
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if token[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in VOID or token[4].endswith("/") and tag not in BLOCK:
            continue
        closes, until = _CLOSED_BY.get(tag, ((), ()))
        if tag in BLOCK and any(entry[0] == "p" for entry in stack):
            closes, until = {"p", *closes}, set(until)
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in until:
                break
            if stack[depth][0] in closes:
                close(depth)
                break
        step, marks = _step(tag, token[4])
        path = f"{stack[-1][1]}>{step}" if stack else step
        outer = bool(stack) and stack[-1][2]
        inside_article = any(entry[0] == "article" for entry in stack)
        dropped = tag in DROPPED and not (tag == "header" and inside_article) or bool(marks & MARKS and tag != "body")
        number = -1
        if tag in CONTAINERS and not outer and not dropped:
            number = len(paths)
            paths.append(path)
        stack.append((tag, path, outer or dropped or bool(_HIDDEN.search(token[4])), number))
        depth_of_links += tag == "a"
    if at < len(page) and not (stack and stack[-1][2]):
        pieces.append(page[at:])
    flush()
    return paths, blocks


def scores(paths: list[str], blocks: list[Block]) -> dict[str, float]:
    """Score of each path: text outside links of the blocks right in its containers, half for those one level
    up, and so on; an ``article`` or ``main`` gathers all the text below it at full weight."""
    out: dict[str, float] = {}
    for block in blocks:
        weight = float(max(0, len(block.text) - 2 * block.linked))
        for number in reversed(block.inside):
            path = paths[number]
            strong = path.rpartition(">")[2].partition(".")[0] in ("article", "main")
            out[path] = out.get(path, 0.0) + weight * (2.0 if strong else 1.0)
            if strong:
                break
            weight /= 2
    return out


def best(scored: dict[str, float]) -> str | None:
    """The path of the highest score, ties by path; None without one."""
    return min(scored, key=lambda p: (-scored[p], p), default=None)


def main_text(page: str, elected: str | None) -> str:
    """Blocks inside the elected path, or inside the page's own best one where the page does not have it."""
    paths, blocks = parse(page)
    if elected not in paths:
        elected = best(scores(paths, blocks))
    wanted = {i for i, p in enumerate(paths) if p == elected}
    chosen = [b.text for b in blocks if wanted.intersection(b.inside)] if wanted else [b.text for b in blocks]
    return "\n".join(chosen)


def elected_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path)``: for each host the path with the highest sum of page scores, ties by path.

    A page votes with shares of its own text, so that no long page outvotes the others.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for link, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scored = scores(*parse(page.as_py() or ""))
                total = sum(scored.values())
                for path, score in scored.items():
                    if total > 0:
                        key = (host_of(link), path)
                        # Whole numbers add up to the same sum in any order.
                        votes[key] = votes.get(key, 0) + round(1e6 * score / total)
            hosts, paths = [k[0] for k in votes], [k[1] for k in votes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())],
                names=["host", "path", "votes"],
            )

    votes = pages.select(url, html).mapInArrow(kernel, "host string, path string, votes bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = F.struct((-F.col("votes")).alias("v"), "path")
    return sums.groupBy("host").agg(F.min(first).getField("path").alias("path"))


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every row of ``pages``: its main text and the code points in it.

    Blocks follow page order, one per line, each with single spaces and decoded character references. A
    NULL or empty page gives an empty text; pages without a URL share the host "". Repeated rows vote
    again and are all returned; NULL ids pass; other columns are not read; an empty table gives an empty
    result. Unclosed and misnested tags are closed by their parent, a cut page at its end.
    """
    elected = written(elected_paths(pages, url, html), "pages-elected")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    joined = joined.join(elected, "host", "left").select("id", "url", "html", "path")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3).to_pylist(), strict=True)
            found = [main_text(page.as_py() or "", path) for page, path in pairs]
            lengths = pa.array([len(t) for t in found], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), lengths]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id].dataType.simpleString()
    out = joined.mapInArrow(kernel, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id, "url": url})
