"""HTML extraction by consensus host paths.

Every page scores its containers; Spark adds the scores up by host and generalised path of tags and classes; every page is
then extracted from the containers on its host's winning path. A page that has none of them falls back on its own best.
A path is known by a chained hash of its steps, so a page costs time and memory in proportion to its length, however deep
it nests; a path is only written out for the container that a page's text comes from.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, shared_dir, steps, written

CONTAINERS = frozenset("html body main article section div aside nav header footer form table tbody thead tfoot tr td th ul ol li dl dt dd blockquote pre figure figcaption fieldset details center p h1 h2 h3 h4 h5 h6".split())
#: Containers that may hold a page's text; what is in the others counts for the nearest of these around them.
CANDIDATES = frozenset("body main article section div td form blockquote pre center figure".split())
DROPPED = frozenset("script style noscript template svg math iframe object head select textarea".split())
#: Text in these speaks against the containers around it, and is not part of the extracted text.
ASIDE = frozenset("nav header footer aside".split())
#: An opening tag closes these, if they are open with no other container between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = CONTAINERS - {"html", "body"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACE = re.compile(r"[ \t\r\f\v ]+")
#: A host's path needs this share of the host's score; below it each page is left to its own best container.
LEAST_SHARE = 0.2
SCORED = "host string, path binary, depth int, score double"
RESULT = "page_id long, host string, path string, consensus boolean, text string"


def generalised(tag: str, attributes: str) -> str:
    """tag.class.class, classes sorted, in lower case, digits as #: what pages of one template have in common."""
    m = CLASS.search(attributes) if "class" in attributes or "CLASS" in attributes or "Class" in attributes else None
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in next(x for x in m.groups() if x is not None).split()}) if m else []
    return ".".join([tag, *names])


def host_of(column):
    """A URL's host in lower case, without port and user; '' for null or no host."""
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class Node:
    __slots__ = ("parts", "step", "key", "depth", "links", "size", "commas", "paragraphs", "parent", "aside")

    def __init__(self, step, parent, aside):
        self.step, self.parent, self.aside = step, parent, aside
        self.depth = parent.depth + 1 if parent else 0
        self.key = hashlib.blake2b(parent.key + step.encode("utf-8", "surrogatepass"), digest_size=16).digest() if parent else b""
        self.parts, self.links, self.size, self.commas, self.paragraphs = [], 0, 0, 0, 0

    @property
    def path(self) -> str:
        """The steps from the outermost container, joined by '>'."""
        steps, x = [], self
        while x.parent is not None:
            steps.append(x.step)
            x = x.parent
        return ">".join(reversed(steps))


def parsed(page: str) -> list[Node]:
    """The candidate containers of a page, outermost first, each with its direct text (nested candidates apart).

    `parts` holds strings and nested nodes in order. Tags that are never closed end with what is around them; end tags
    without a beginning are ignored; whatever follows an unclosed comment or dropped element is dropped with it.
    """
    root = Node("", None, False)
    found, node = [root], root
    stack: list[tuple[str, Node]] = []
    opened: Counter[str] = Counter()  # how often each tag is on the stack
    at, link, n = 0, 0, len(page)
    lower = None

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and node.parts:
                node.parts.append(" ")
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        size = len(raw)
        node.parts.append(raw)
        node.size += size
        node.commas += raw.count(",") + raw.count(". ")
        if link:
            node.links += size

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in DROPPED:
            if not m.group(1) and not m.group(3).rstrip().endswith("/"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                end = lower.find("</" + tag, at)
                end = n if end < 0 else page.find(">", end)
                at = n if end < 0 else end + 1 if end < n else n
            continue
        if tag == "a":
            link = 0 if m.group(1) else 1
            continue
        if tag == "br" or tag == "hr":
            node.parts.append("\n")
            continue
        if tag not in CONTAINERS:
            continue
        if m.group(1):
            if opened[tag]:
                last = None
                while last != tag:
                    last, node = stack.pop()
                    opened[last] -= 1
                link = 0
                node.parts.append("\n")
            continue
        if stack:
            if stack[-1][0] == "p" and tag in ENDS_P:
                node = stack.pop()[1]
                opened["p"] -= 1
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                last, node = stack.pop()
                opened[last] -= 1
        node.parts.append("\n")
        if tag == "p":
            node.paragraphs += 1
        if tag in ("html", "body") and opened[tag]:
            continue
        stack.append((tag, node))
        opened[tag] += 1
        if tag in CANDIDATES or tag in ASIDE:
            inner = Node(generalised(tag, m.group(3)), node, node.aside or tag in ASIDE)
            node.parts.append(inner)
            found.append(inner)
            node = inner
    return found


def scores(nodes: list[Node]) -> list[tuple[float, int]]:
    """(score, place) of the nodes that may be a page's text. Half of what its nested containers have counts for a node."""
    whole = [[x.size, x.links, x.commas, x.paragraphs] for x in nodes]
    place = {id(x): k for k, x in enumerate(nodes)}
    for k in range(len(nodes) - 1, 0, -1):
        if not nodes[k].aside:
            up = whole[place[id(nodes[k].parent)]]
            for j in range(4):
                up[j] += whole[k][j] * 0.5
    out = []
    for k, x in enumerate(nodes):
        size, links, commas, paragraphs = whole[k]
        if x.depth and not x.aside and size:
            out.append(((size**0.5 + commas + 3 * paragraphs) * (1 - min(1.0, links / size)), k))
    return out


def rendered(node: Node) -> str:
    """The text of a container and all in it but asides: lines by block, spaces made one, empty lines left out."""
    out, todo = [], [iter(node.parts)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
        elif isinstance(x, str):
            out.append(x)
        elif not x.aside:
            out.append("\n")
            todo.append(iter(x.parts))
    lines = (SPACE.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def votes(page: str | None) -> dict[tuple[bytes, int], float]:
    """Shares of a page's vote by (path's hash, depth): the square of each container's score, summing to 1."""
    by_path: dict[tuple[bytes, int], float] = {}
    if page:
        nodes = parsed(page)
        for s, k in scores(nodes):
            key = nodes[k].key, nodes[k].depth
            by_path[key] = by_path.get(key, 0.0) + s * s
    total = sum(by_path.values())
    return {p: s / total for p, s in by_path.items()} if total else {}


def extract(page: str | None, path: bytes | None) -> tuple[str | None, bool, str | None]:
    """(path, whether it is the host's, text) of a page; null text for a null page, '' if there is none.

    Containers of one path lie at one depth, so none of them is inside another.
    """
    if page is None:
        return None, False, None
    nodes = parsed(page)
    if path is not None:
        hit = [x for x in nodes if x.key == path and not x.aside]
        text = "\n".join(t for t in map(rendered, hit) if t)
        if text:
            return hit[0].path, True, text
    best = max(scores(nodes), key=lambda s: (s[0], -s[1]), default=None)
    if best is None:
        return None, False, rendered(nodes[0])
    return nodes[best[1]].path, False, rendered(nodes[best[1]])


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, share): the hash of each host's path of the highest score over all its pages, if it has LEAST_SHARE of it.

    Ties go to the deeper path, then to the first hash in order. Pages without a host vote together as host ''.
    """
    src = only(pages, url=url_col, html=html_col).select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches):
        sums: dict[tuple[str, tuple[bytes, int]], float] = {}
        for b in steps(batches):
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for path, s in votes(page).items():
                    sums[host, path] = sums.get((host, path), 0.0) + s
            if len(sums) > 100_000:
                yield flushed(sums)
                sums.clear()
        yield flushed(sums)

    def flushed(sums):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1][0] for k in sums], pa.binary()), pa.array([k[1][1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "depth", "score"])

    total = src.mapInArrow(run, SCORED).groupBy("host", "path", "depth").agg(F.round(F.sum("score"), 6).alias("score"))
    best = F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), -F.col("depth"), "path")).alias("best")
    ranked = total.groupBy("host").agg(best, F.sum("score").alias("total"))
    return ranked.select("host", F.col("best.path").alias("path"), (F.col("best.score") / F.col("total")).alias("share")).where(F.col("share") >= LEAST_SHARE)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for every row of pages: its host, the path it was extracted by, whether by consensus, and its text.

    Null pages have a null text and path; empty ones and ones without text have ''. Rows may repeat. Deep and very long
    pages are parsed whole, in time and memory that grow with their length. Ids are cast to long. Winning paths are written
    and read again, so that Spark sees their size and broadcasts them only while they are small.
    """
    best = written(consensus(pages, url_col, html_col).select(F.col("host").alias("best_host"), F.col("path").alias("best")), f"{shared_dir(pages.sparkSession)}/paths")
    src = only(pages, page_id=id_col, html=html_col, url=url_col).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    joined = src.join(best, F.col("host") == F.col("best_host"), "left").select("page_id", "html", "host", "best")

    def run(batches):
        for b in steps(batches):
            rows = [extract(p, w) for p, w in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())], ["page_id", "host", "path", "consensus", "text"])

    return joined.mapInArrow(run, RESULT)
