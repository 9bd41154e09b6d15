"""Main text of web pages by consensus on host paths.

Every page names the container of its article: the lowest one that holds half of the running text
(links counting against it), widened to those around it that hold more of the article. A container
is named by its path of tags and classes with digits generalised. Spark adds up the votes of all
pages of a host; the paths that a twentieth of them name are then tried on every page of that host,
and where they hold little of a page's text its own container is read. What is plainly not running
text inside it (forms, notices, comments ...) is left out.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.shared import Cuts

# Elements of HTML by their role.
CONTAINERS = frozenset("html body main article section div td th table tbody thead tfoot tr ul ol dl blockquote center details figure fieldset".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr summary figcaption caption option".split()) | CONTAINERS
LEFT_OUT = frozenset("nav header footer aside form button select menu dialog iframe object noscript template svg canvas video audio map label input".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Class, id and role names, and their first or last parts, that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# First parts of names that speak of a layout, and those before a header that is the article's own.
LAYOUT = frozenset("has have is no non not show with without".split())
OWN_HEADER = frozenset("article content entry item news page post section single story title".split())
UNMARKED, COMPOUND, WHOLE = 0, 1, 2
MIN_VOTES = 0.05  # share of a host's pages that must name a path; so a host has 20 paths at most
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def blocks_of(html: str) -> list[tuple[str, str, int]]:
    """Blocks of a page in order: path of their container, text, characters of it in links.

    What lies in a marked element is left out unless the element turns out to hold the article.
    """
    out: list[tuple[str, str, int]] = []
    inside: list[tuple[int, ...]] = []  # the marked elements around each block
    marked: list[int] = []  # how each marked element is named
    mains: set[int] = set()  # marked elements around a main element
    around: list[tuple[int, ...]] = [()]
    names: list[str] = []  # open containers and left-out elements
    paths: list[str] = [""]
    skipped = 0  # open elements that are left out
    hides: list[bool] = []
    text: list[str] = []
    linked = link = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(unescape("".join(text)).split())
            if block:
                out.append((paths[-1], block, min(linked, len(block))))
                inside.append(around[-1])
            text.clear()
        linked = 0

    while at < len(html):
        m = TAG.search(html, at)
        if m is None:
            piece, at = html[at:], len(html)
        else:
            piece, at = html[at : m.start()], m.end()
        if piece and not skipped:
            text.append(piece)
            linked += len(piece) if link else 0
        if m is None or m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            # its content is not markup: go to its end tag
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            if not skipped:
                text.append(" ")
            continue
        if tag == "a":
            link = 0 if closing else 1
            continue
        left_out = tag in LEFT_OUT
        if tag in BREAKS or left_out:
            flush()
        if tag in BREAKS and not closing:
            link = 0
            # a new block ends an open paragraph that is marked
            if names and names[-1] == "p":
                _close("p", names, paths, hides, around)
        mark = UNMARKED
        if not closing and not skipped and not left_out and tag in BREAKS and tag not in VOID and tag not in ("html", "body", "article", "main"):
            mark = _marked(m[3])
        # a paragraph or heading is kept open only when it names itself a notice and the like
        if tag in VOID or (tag not in CONTAINERS and not left_out and not mark):
            if closing and tag in names:
                _close(tag, names, paths, hides, around)
                skipped = sum(hides)
            continue
        if closing:
            if tag in names:
                _close(tag, names, paths, hides, around)
                skipped = sum(hides)
            continue
        if tag == "main":
            mains.update(around[-1])
        if mark:
            marked.append(mark)
        names.append(tag)
        hides.append(left_out)
        around.append((*around[-1], len(marked) - 1) if mark else around[-1])
        paths.append(f"{paths[-1]}>{tag}{_classes(m[3])}" if tag in CONTAINERS else paths[-1])
        skipped += left_out
    flush()
    if not marked:
        return out
    hidden = _hidden(marked, mains, [(len(text) - 3 * linked, some) for (_, text, linked), some in zip(out, inside, strict=True)])
    return [block for block, some in zip(out, inside, strict=True) if hidden.isdisjoint(some)]


def _hidden(marked: list[int], mains: set[int], worths: list[tuple[int, tuple[int, ...]]]) -> set[int]:
    """The marked elements that hold less running text of their own than the page shows beside them;
    one whose whole name is a mark may hold up to ten times as much (long comments)."""
    own, beside, above = [0] * len(marked), 0, {}
    for worth, some in worths:
        if some:
            own[some[-1]] += max(worth, 0)
            above.update((x, some[: n + 1]) for n, x in enumerate(some))
        else:
            beside += max(worth, 0)
    shown: set[int] = set()
    for i in sorted(above, key=lambda i: (i not in mains, -own[i], i)):
        if i in mains or own[i] > beside * (10 if marked[i] == WHOLE else 1):
            # what lies around a shown element is shown with it
            fresh = set(above[i]) - shown
            shown |= fresh
            beside += sum(own[x] for x in fresh)
    return set(above) - shown


def _close(tag: str, names: list[str], paths: list[str], hides: list[bool], around: list[tuple[int, ...]]) -> None:
    while names:
        last = names.pop()
        paths.pop()
        hides.pop()
        around.pop()
        if last == tag:
            return


def _named(attributes: str) -> list[tuple[str, str]]:
    return [(k.lower(), (a or b or c).lower()) for k, a, b, c in NAME.findall(attributes)] if "=" in attributes else []


def _marked(attributes: str) -> int:
    """Whether a name is a mark as a whole or begins or ends with one. Names of layouts (has-sidebar,
    hidden-xs) and of the article's own header are none."""
    kind = UNMARKED
    for _, value in _named(attributes):
        for name in value.split():
            if name in MARKS:
                return WHOLE
            parts = [part for part in PARTS.split(name) if part]
            if not parts or parts[0] in LAYOUT:
                continue
            first = parts[0] in MARKS and parts[0] != "hidden"
            last = parts[-1] in MARKS and (parts[-1] != "hidden" or parts[0] == "visually") and not (parts[-1] == "header" and parts[0] in OWN_HEADER)
            if first or last:
                kind = COMPOUND
    return kind


def _classes(attributes: str) -> str:
    return "".join(f".{DIGITS.sub('#', c)}" for k, value in _named(attributes) if k == "class" for c in sorted(set(value.split())))


def _around(path: str) -> list[str]:
    """The path and those around it, from the inside out; the empty path is the page."""
    out = [path]
    while path:
        path = path.rpartition(">")[0]
        out.append(path)
    return out


def _tag(path: str) -> str:
    return path.rpartition(">")[2].partition(".")[0]


def _within(at: str, path: str) -> bool:
    return at == path or at.startswith(path + ">")


def _worth(text: str, linked: int) -> int:
    return len(text) - 3 * linked


def texts_of(blocks: list[tuple[str, str, int]]) -> dict[str, int]:
    """Running text of every container, all of it credited to all containers around it."""
    sums: dict[str, int] = {}
    plain = all(_worth(text, linked) <= 0 for _, text, linked in blocks)  # nothing but links: they are the text
    for path, text, linked in blocks:
        worth = len(text) if plain else max(_worth(text, linked), 0)
        for p in _around(path):
            sums[p] = sums.get(p, 0) + worth
    return sums


def best_of(blocks: list[tuple[str, str, int]], sums: dict[str, int]) -> str | None:
    """The container of the page's article: the lowest with at least half of the running text,
    widened to the widest around it that still adds to the article."""
    if not blocks:
        return None
    best = max((p for p in sums if 2 * sums[p] >= sums[""]), key=lambda p: (p.count(">"), sums[p], p))
    for up in _around(best)[1:]:
        if _adds(blocks, sums, best, up):
            best = up
    return best


def _adds(blocks: list[tuple[str, str, int]], sums: dict[str, int], inner: str, up: str) -> bool:
    """Whether what stands beside the inner container in the one around it is of the article: text
    next to the container, a head or lead before it, or running text of some length."""
    tag = _tag(up)
    if tag == "article":
        return True
    extra, direct, ahead, begun = 0, False, False, False
    for at, text, linked in blocks:
        if _within(at, inner):
            begun = True
        elif _within(at, up):
            worth = _worth(text, linked)
            extra += worth
            direct = direct or (at == up and worth > 0 and (not begun or tag not in ("", "html", "body")))
            ahead = ahead or (not begun and worth > 0)
    if extra <= 0:
        return False
    return tag == "main" or direct or 10 * extra >= sums[inner] or (ahead and tag not in ("", "html", "body"))


def read_page(html: str, paths: list[str] | None) -> str:
    """Blocks under the first of the paths that holds half of what the page's own container holds;
    without one, and where the page's own is around it and not the whole body, under its own."""
    blocks = blocks_of(html)
    sums = texts_of(blocks)
    path = own = best_of(blocks, sums)
    for p in paths or ():
        if own is not None and 2 * sums.get(p, 0) >= sums[own]:
            path = own if _within(p, own) and _tag(own) not in ("", "html", "body") else p
            break
    return "\n".join(text for at, text, _ in blocks if path is not None and _within(at, path))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; the text is empty where a page has none.

    A null html counts as empty, a null url as a host of its own; rows that repeat are read each
    and vote each; other columns are ignored. Votes are added up before any shuffle, so a host
    with most of the pages costs no more than one with few.
    """
    cuts = Cuts(pages.sparkSession, "hostpaths")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    narrow = narrow.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))

    def vote(batches):
        for batch in batches:
            hosts, paths = [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = blocks_of(html or "")
                best = best_of(blocks, texts_of(blocks))
                if best is not None:
                    hosts.append(host)
                    paths.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    votes = narrow.select("host", "html").mapInArrow(vote, "host string, path string")
    counted = cuts.save("counted", votes.groupBy("host", "path").agg(F.count("*").alias("votes")))
    often = counted.join(counted.groupBy("host").agg(F.sum("votes").alias("of")), "host").where(F.col("votes") >= F.col("of") * MIN_VOTES)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    winners = cuts.save("winners", often.groupBy("host").agg(ordered["path"].alias("paths")))
    cuts.drop("counted")

    def read(batches):
        for batch in batches:
            texts = [read_page(h or "", p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    led = narrow.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return led.mapInArrow(read, "page_id long, url string, text string, n_chars long")
