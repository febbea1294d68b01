"""Main text of web pages: each page scores its containers, the pages of a host vote on their paths, the winners are extracted."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled
from ledgerloom.operators.spread import lookup_join

VOTES = 5  # containers that a page votes for
PATHS = 8  # paths kept per host; a page that has none of them counts on its own votes
UNIT = 1000  # a page's vote for its best container
NEAR = 12  # containers above a block that share in it, each by half of the one below
LINKED = 0.5  # a block with a larger share of linked text is no prose

# fixed values: elements by their part in a page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())  # no markup inside
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
AWAY = frozenset(  # never text
    "script style noscript template iframe object svg math select button textarea head title noframes noembed canvas audio video map "
    "datalist xmp".split()
)
ASIDE = frozenset("nav footer aside form menu dialog header".split())  # no main text, unless most of the page lies in it
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption summary address th tr td".split())  # hold text, do not vote
PREFERRED = {"article": 2.2, "main": 1.6}
KEPT = frozenset("html body main".split())  # never judged by class or id
CLOSED_BY: dict[str, frozenset[str]] = {  # an open element of the key is ended by these
    "p": frozenset(
        "address article aside blockquote details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
        "hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset("td th tr tbody tfoot thead".split()), "th": frozenset("td th tr tbody tfoot thead".split()),
    "tr": frozenset("tr tbody tfoot thead".split()), "option": frozenset(["option", "optgroup"]),
    "thead": frozenset("tbody tfoot".split()), "tbody": frozenset("tbody tfoot".split()), "head": frozenset(["body"]),
}
FENCES = frozenset("table ul ol dl div section article main body html".split())  # an implied end does not reach beyond
CUES = frozenset(  # words in a class or id, or a role
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer "
    "header masthead sidebar aside widget widgets related recommended share sharing social comment comments disqus replies respond "
    "toolbar popup modal overlay search copyright contentinfo complementary".split()
)
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^<>\"']|(?<==)\"[^\"]*\"|(?<==)'[^']*'|(?<=\s)\"[^\"]*\"|(?<=\s)'[^']*'|[\"'])*+)>",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SURE = frozenset("ad ads advert advertisement comment comments disqus promo related replies reply sponsored".split())  # for articles, too
WORDS = re.compile("[a-z]+")


@dataclass(slots=True)
class Node:
    """An open or closed element that may hold blocks."""

    tag: str
    parent: Node | None
    path: int
    away: bool  # no text by its tag
    cue: int  # 1: no main text by its tag, class, id or role, unless it holds most of the page's; 2: not even then beside an article
    doubted: bool  # within an element with a cue
    inside: bool  # within an article and no such element
    weight: int = 0
    inner: int = 0  # prose there
    matched: bool = False


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    node: Node


class Paths:
    """Numbers of generalised paths: tags with their classes, digits left out."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = [(-1, "")]

    def child(self, path: int, label: str) -> int:
        number = self.known.setdefault((path, label), len(self.labels))
        if number == len(self.labels):
            self.labels.append((path, label))
        return number

    def named(self, path: int) -> str:
        parts = []
        while path:
            path, label = self.labels[path]
            parts.append(label)
        return ">".join(reversed(parts))

    def number(self, name: str) -> int:
        path = 0
        for label in name.split(">"):
            path = self.child(path, label)
        return path


@dataclass(slots=True)
class Page:
    """The blocks of a page in order, and its elements."""

    blocks: list[Block] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


def _label(tag: str, attrs: str, inside: bool) -> tuple[str, int]:
    """The element's part of a path, and how surely a class, id or role tells that it is not main text."""
    if not attrs.strip():
        return tag, 0
    classes, cue = [], int(HIDDEN.search(attrs) is not None)
    for kind, *values in NAMES.findall(attrs):
        value = "".join(values).lower()
        for word in WORDS.findall(value):
            if word in SURE:
                cue = 2
            elif word in CUES and tag != "article" and not (inside and word == "header"):
                cue = max(cue, 1)
        if kind.lower() == "class":
            classes += value.split()
    general = sorted({re.sub("[^a-z_-]+", "", name) for name in classes} - {""})
    return ".".join([tag, *general]), cue


def parse(html: str, paths: Paths) -> Page:
    """The blocks of a page. Text is read with any nesting and any missing or extra tag; nothing is recursive."""
    page = Page()
    root = Node("page", None, paths.child(0, "page"), False, 0, False, False)
    page.nodes.append(root)
    stack, text, linked, link = [root], [], 0, 0
    opened: dict[str, int] = defaultdict(int)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                page.blocks.append(Block(joined, linked, stack[-1]))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        value = unescape(raw) if "&" in raw else raw
        text.append(value)
        if link:
            linked += len(value.strip())

    def close() -> None:
        opened[stack.pop().tag] -= 1

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        found = TOKEN.match(html, lt)
        if found is None:  # a sign, not a tag
            text.append("<")
            at = lt + 1
            continue
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if found["end"] else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if found["end"]:
            flush()
            if opened[tag] and tag:
                while stack[-1].tag != tag:
                    close()
                close()
                link = 0
            continue
        flush()
        link = 0
        if tag in VOID:
            continue
        enders = [name for name, by in CLOSED_BY.items() if opened[name] and tag in by]
        if enders:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in enders:
                    while len(stack) > depth:
                        close()
                    enders = [name for name in enders if opened[name]]
                    if not enders:
                        break
                elif stack[depth].tag in FENCES and stack[depth].tag not in CLOSED_BY:
                    break
        attrs = found["attrs"]
        up = stack[-1]
        label, cue = _label(tag, attrs, up.inside)
        cue = 0 if tag in KEPT else max(cue, int(tag in ASIDE))
        doubted = up.doubted or cue > 0
        inside = not doubted and (up.inside or tag in PREFERRED)
        node = Node(tag, up, paths.child(up.path, label), up.away or tag in AWAY, cue, doubted, inside)
        page.nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = size if end is None else end.start()
            if end is not None:
                stop = html.find(">", at)
                at = size if stop < 0 else stop + 1
            continue
        stack.append(node)
        opened[tag] += 1
    flush()
    _judge(page)
    return page


def _prose(block: Block) -> int:
    size = len(block.text)
    return size - block.linked if block.node.tag not in HEADINGS and block.linked <= LINKED * size else 0


def _judge(page: Page) -> None:
    """Puts away what has a cue, unless more than half of the page's prose lies in it and little or none in articles beside it."""
    for block in page.blocks:
        if not block.node.away:
            block.node.weight += _prose(block)
            block.node.inner += _prose(block) if block.node.inside else 0
    total, articles = sum(node.weight for node in page.nodes), sum(node.inner for node in page.nodes)
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.weight += node.weight
            node.parent.inner += node.inner
    for node in page.nodes:  # parents come before their children
        beside = articles - node.inner
        if node.cue and 2 * node.weight > total and (not beside or node.cue == 1 and 10 * beside < node.weight):
            node.cue = 0
        node.away = node.away or node.cue > 0 or (node.parent is not None and node.parent.away)


def scores(page: Page) -> dict[int, float]:
    """Path -> score. A block of prose counts for the container around it, and by half for each one further up."""
    found: dict[int, float] = defaultdict(float)
    for block in page.blocks:
        weight = 0 if block.node.away else _prose(block)
        node: Node | None = block.node
        if node.tag in LEAVES:
            node = node.parent
        share = 1.0
        while weight and node is not None and share > 2.0**-NEAR:
            if node.tag != "html":
                found[node.path] += weight * share * PREFERRED.get(node.tag, 1.0)
                share /= 2
            node = node.parent
    return found


def ballot(page: Page, paths: Paths) -> list[tuple[str, int]]:
    """The page's best containers, of equals the first on the page, and its votes for them: UNIT for the best."""
    found = scores(page)
    best = max(found.values(), default=0.0)
    ranked = sorted(found, key=lambda path: -found[path])[:VOTES]
    return [(paths.named(path), round(UNIT * found[path] / best)) for path in ranked if best]


def _whole(block: Block) -> bool:
    """Whether a block is main text; of an article's own header the headings are."""
    node: Node | None = block.node
    if not node.away:
        return True
    if node.tag not in HEADINGS or node.cue:
        return False
    node = node.parent
    while node is not None and node.tag in ("hgroup", "div") and not node.cue:
        node = node.parent
    return node is not None and node.tag == "header" and node.parent.inside and not node.parent.away


def main_text(html: str, paths: Paths, ranked: Sequence[str]) -> tuple[str, str | None]:
    """(text, path): the blocks in the first of the host's ranked paths that has any here, else in the page's best container."""
    page = parse(html, paths)
    for name in [*ranked, *(name for name, _ in ballot(page, paths)[:1])]:
        winner = paths.number(name)
        for node in page.nodes:
            node.matched = node.path == winner or (node.parent is not None and node.parent.matched)
        lines, last = [], None
        for block in page.blocks:
            if block.node.matched and _whole(block):
                if last is not None and _cells(last, block.node):
                    lines[-1] += f" {block.text}"
                else:
                    lines.append(block.text)
                last = block.node
        if lines:
            return "\n".join(lines), name
    return "", None


def _cells(one: Node, other: Node) -> bool:
    """Whether two elements are different cells of a row of a table."""
    return {one.tag, other.tag} <= {"td", "th"} and one is not other and one.parent is other.parent


def host_of(url: Column) -> Column:
    """The host of a web address in lower case, without user, port and closing dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, pages) from rows (host, html): summed in each task before they are sent on."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = Paths(), defaultdict(lambda: [0, 0])
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for name, vote in ballot(parse(html, paths), paths):
                    sums = found[host, name]
                    sums[0] += vote
                    sums[1] += 1
            keys = list(found)
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([h for h, _ in keys], pa.string()), "path": pa.array([p for _, p in keys], pa.string()),
                "votes": pa.array([found[k][0] for k in keys], pa.int64()), "pages": pa.array([found[k][1] for k in keys], pa.int64()),
            })

    heard = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html")
    counted = heard.mapInArrow(cast, "host string, path string, votes long, pages long")
    return counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's PATHS paths with most votes, best first; equal ones in the order of their names."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    ranked = votes(pages).withColumn("rank", rank).filter(F.col("rank") <= PATHS)
    listed = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return ranked.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("paths"))


def extract(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, path.

    Each page scores its containers by the prose in them: text of blocks that are not mostly links, of
    no menu, header, footer, sidebar, form and the like by tag, class, id or role. The pages of a
    host vote for paths of tags and classes; the sums, some rows a host, decide. Then each page
    is read again, and gives the blocks in the first of its host's paths that has text there, or in
    its own best container if none has (``path`` says which). Inside it what is named as no main
    text is left out, unless it holds more than half of the page's prose; headings of an
    article's header stay. A line break is white space, the cells of a table's row are one block.

    A null page is empty, and its text is empty. Pages without a host count on their own votes.
    Repeated rows each vote and each give a row; an empty table gives no rows; other columns play no
    part. Pages are read whole, whatever their length, depth or faults of markup. A host's votes
    are summed in tasks first and its pages are dealt out by page, so no task holds a host.
    """
    rows = df.select(df[id].alias("page_id"), df[url].alias("url"), host_of(df[url]).alias("host"), F.coalesce(df[html], F.lit("")).alias("html"))
    agreed = settled(consensus(rows), "paths")
    known = lookup_join(rows, agreed, ["host"], "left", ["page_id", "url"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, names = Paths(), [], []
            for value, ranked in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                text, name = main_text(value, paths, ranked or [])
                texts.append(text)
                names.append(name)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()), "path": pa.array(names, pa.string()),
            })

    kinds: Mapping[str, str] = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return known.select("page_id", "url", "html", "paths").mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, path string"
    )
