"""Main text of web pages by consensus of a host's pages.

Every page scores its containers by the text they hold, links counting against
it, and names the path of tags and classes (digits dropped) of the best one.
Spark counts these votes by host; the winning path then extracts every page of
the host, whatever its own vote was.  A page without that path falls back to
its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayloom.llm.memory import bounded
from wayloom.llm.scratch import Scratch

RAW = frozenset("script style noscript template textarea title iframe svg".split())
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
EDGE = re.compile(r"""[>"']""")
ATTR = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
#: Winning paths of all hosts are broadcast up to this size, beyond it they are joined by shuffle.
BROADCAST_BYTES = 8_000_000
#: Opening one of these ends an open element of the second set, if no container lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROP_TAGS = frozenset("aside button dialog footer form input label menu nav select".split())
DROP_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer discussion disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification "
    "pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar".split()
)
#: Parts of a class name that say nothing about what it holds.
PLACE_NAMES = frozenset(
    "area bar block body bottom box button buttons container fixed form global group inner item items left links list main outer page panel primary right row section secondary "
    "site slot sticky top unit widget wrap wrapper".split()
)
DROP_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    name: str  # tag and classes; inline elements have none
    key: int  # of the path; equal paths have equal keys within a process
    above: "Node | None"
    dropped: bool
    container: "Node | None"
    link: bool
    up: "Node | None" = None
    score: float = 0.0
    order: int = 0
    first: int = 0  # blocks of its subtree: first, and end
    end: int = 0
    loose: float = 0.0  # words outside links that stand in it and in no inner container
    titled: bool = False  # a heading h1 among them
    crowded: int = 0  # inner containers with a text of their own, but for those that hold the title

    @property
    def path(self) -> str:
        names, at = [], self
        while at is not None:
            names.append(at.name)
            at = at.above
        return SEP.join(x for x in reversed(names) if x)


SEP = ">"


def path_key(path: str) -> int:
    key = 0
    for name in path.split(SEP) if path else ():
        key = hash((key, name))
    return key


def boilerplate(name: str) -> bool:
    """Whether a class or id names furniture: a listed word, alone or with words of place only ("site-header", not "entry-header")."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    telling = [x for x in parts if x not in PLACE_NAMES]
    return bool(telling) and DROP_NAMES.issuperset(telling)


def _describe(tag: str, attrs: str) -> tuple[str, bool]:
    """The generalised name of an element, and whether it is boilerplate."""
    drop, name = tag in DROP_TAGS, tag
    if attrs.strip():
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class" and value:
                name += "".join("." + c for c in sorted({re.sub(r"\d+", "", c).strip("-_") for c in value.split()} - {""}))
            if key in ("class", "id"):
                drop = drop or any(map(boilerplate, value.split()))
            elif key == "role":
                drop = drop or value in DROP_ROLES
            elif key == "hidden" or "display:none" in value.replace(" ", ""):
                drop = True
    return name, drop


def scan(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before, tag, attributes, closing) of all tags in order; the last has no tag.  One pass: no part is read more than twice."""
    at, text_from, quotes_end = 0, 0, True
    last = page.rfind(">")
    while True:
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[text_from:lt], "", "", False
            at = text_from = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            yield page[text_from:lt], "", "", False
            at = text_from = page.find(">", lt) + 1
            continue
        m = NAME.match(page, lt)
        if not m:
            at = lt + 1
            continue
        i = m.end()
        while quotes_end:  # the first > outside quoted values
            edge = EDGE.search(page, i)
            if not edge:
                quotes_end = False  # no tag after this one has such an end either, unless its quotes are read another way
                break
            i = edge.start()
            if edge[0] == ">":
                break
            close = page.find(edge[0], i + 1) if page[m.end() : i].rstrip()[-1:] == "=" and i - m.end() < 1 << 16 else -1
            i = close + 1 if close >= 0 else i + 1
        if not quotes_end:
            i = page.find(">", m.end())
        tag, attrs = m[2].lower(), page[m.end() : i]
        yield page[text_from:lt], tag, attrs, bool(m[1])
        at = text_from = i + 1
        if tag in RAW and not m[1] and not attrs.rstrip().endswith("/"):
            end = RAW_END[tag].search(page, at)
            at = text_from = end.end() if end else len(page)
            yield "", tag, "", True
    yield page[text_from:], "", "", False


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def containers(page: str) -> tuple[list[Node], list[str]]:
    """The page's containers in order, and its text blocks; a container's blocks are those from ``first`` to ``end``."""
    root = Node("", "", 0, None, False, None, False)
    root.container = root
    stack, found, blocks = [root], [root], []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    words = links = 0
    articles = 0

    def flush() -> None:
        nonlocal words, links
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text and not stack[-1].dropped:
            holder = stack[-1].container
            blocks.append(text)
            gain, share, at = words - 2.0 * links, 1.0, holder
            holder.loose += words - links
            holder.titled |= opened["h1"] > 0
            while at is not None and share > 0.2:
                at.score += gain * share
                at, share = at.up, share / 2
        words = links = 0

    def text(piece: str) -> None:
        nonlocal words, links
        if piece and not stack[-1].dropped:
            parts.append(piece)
            n = len(piece.split())
            words += n
            links += n if stack[-1].link else 0

    def close_to(i: int) -> None:
        nonlocal articles
        if any(n.tag in BLOCK for n in stack[i:]):
            flush()
        for n in stack[i:]:
            opened[n.tag] -= 1
            articles -= n.tag in ("article", "main")
            if n.container is n:
                n.end = len(blocks)
                n.up.crowded += n.end > n.first and not n.titled
                n.up.titled |= n.titled
        del stack[i:]

    for piece, tag, attrs, closing in scan(page):
        text(piece)
        if not tag or tag in RAW:
            continue
        if closing:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close_to(i)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        ends = CLOSES.get(tag, frozenset())
        if any(opened[x] for x in ends) or (tag in BLOCK and opened["p"]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends or (stack[i].tag == "p" and tag in BLOCK):
                    close_to(i)
                    break
                if stack[i].tag in CONTAINER or stack[i].tag in ("ul", "ol", "table", "dl"):
                    break
        if tag in BLOCK:
            flush()
        above = stack[-1]
        name, drop = _describe(tag, attrs)
        drop = (drop and tag not in ("html", "body", "article", "main")) or (tag == "header" and not articles)  # an article's own header has its title
        name = name.replace(SEP, "") if tag in BLOCK else ""
        node = Node(tag, name, hash((above.key, name)) if name else above.key, above, above.dropped or drop, above.container, above.link or tag == "a")
        if tag in CONTAINER and not node.dropped:
            node.up, node.container, node.order, node.first = above.container, node, len(found), len(blocks)
            found.append(node)
        if not attrs.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
            articles += tag in ("article", "main")
        elif node.container is node:
            node.end = node.first
    flush()
    close_to(1)
    root.end = len(blocks)
    return found, blocks


def best(found: list[Node]) -> Node:
    """The container with the best score, or the one around it that is the same article: an ``article``, or one
    whose only container with text it is and that adds the title."""
    top = max(found, key=lambda n: (n.score, -n.order))
    at = around = top
    while at.up is not None:
        at = at.up
        if at.tag == "article" and at.score > 0:
            around = at
    if around is not top:
        return around
    while not top.titled and top.up is not None and top.up.titled and top.up.crowded == 1 and top.up.loose < top.loose:
        top = top.up
    return top


def extract(page: tuple[list[Node], list[str]], path: str | None) -> str:
    """Blocks of all containers with the path, in page order, each once; without one, of the best container."""
    found, blocks = page
    key = path_key(path) if path is not None else None
    chosen = [n for n in found if n.key == key and n.end > n.first] if path is not None else []
    out, at = [], 0
    for n in chosen or [best(found)]:  # in page order, one may lie in another
        out += blocks[max(at, n.first) : n.end]
        at = max(at, n.end)
    return "\n\n".join(out)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, out = batch.column(0), []
        for i, page in enumerate(batch.column(1)):
            top = best(containers(page.as_py() or "")[0])
            if top.score > 0:
                out.append((i, top.path, top.score))
        rows, paths, scores = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([hosts.take(pa.array(rows, pa.int32())), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(containers(page.as_py() or ""), path.as_py()) for page, path in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host(url):
    """Lower-case host of a URL; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning path; ties go to the larger score, then the smaller path."""
    votes = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(bounded(_votes), "host string, path string, score double")
    by_path = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    rank = F.struct(-F.col("votes"), -F.col("score"), F.col("path"))
    return by_path.groupBy("host").agg(F.min_by(F.struct("path", "votes"), rank).alias("won")).select("host", "won.path", "won.votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    Defined cases: null or empty html gives an empty text; pages with a null or
    unreadable url form a host of their own; ids may be null or repeat; a page
    without text gives ''; an empty table gives an empty result; other columns
    are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    won = scratch.save(host_paths(pages, url_col, html_col).select("host", "path"), "paths")
    size = won.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("n")).first().n
    won = F.broadcast(won) if size <= BROADCAST_BYTES else won.hint("merge")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    texts = rows.join(won, "host", "left").select("page_id", "url", "html", "path").mapInArrow(bounded(_texts), f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
