"""HTML extraction (6): a site style tree for each host.

Every page is parsed into a DOM, and the DOMs of a host are merged: nodes with the same path of tags and classes are one node of the
style tree. A tree node remembers how its pages present it (the tags of its children) and what they say in it (its text); the entropies
of the two, relative to the number of pages, make its importance; ``PRIOR`` more pages count as wholly important, so a host needs no least
size. Nodes that most pages of a host have, with the same look and the same words, are of low importance and are cut from each page with all
that is below them. What differs from page to page (a menu of other links, an advert of other words) has high entropy and no tree can
tell it from an article, so menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments are also known by their tags, roles and class names. Where a page marks its
article, the article's own text blocks are never cut for being alike: copies of one article stay whole. Class words make no noise of html, body, main and
article, nor of the elements around the only article; a class that tells a state ("no-sidebar") is no name; of several words the last telling one names
the element ("feedback-article" is an article); a page on which names leave nothing is read without them.

Counts of the tree are plain aggregates by host and node, so a host with a third of all pages is counted in parts; only the low
nodes of each host travel back to its pages.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (open elements end with their parents,
an unclosed script or comment ends with the page); nesting of any depth and texts of any length are read whole; a node exactly at the least importance stays; text outside any element counts as body text; a null url has the empty host; repeated
rows are extracted each and counted in the tree; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .url_filter import host_and_path

#: Pages without evidence that every node starts with (so that a node of few pages is important), the share of a host's pages that must
#: have a node, and the importance below which it goes.
PRIOR = 4
SHARE = 0.5
IMPORTANCE = 0.2
#: Weight of the content's entropy against the presentation's.
CONTENT = 0.9

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset(
    "head header nav footer aside form script style noscript template iframe noframes textarea title button select option menu dialog svg canvas object audio video map search".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback footer gdpr login"
    " masthead menu menubar modal nav navbar navigation newsletter notice notices overlay popup promo promoted promotion recommended related replies reply respond rail"
    " share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words of what an article is called, and of what may hold one where no other word says what it holds ("main-content", but not "footer-content").
TEXT_WORDS = frozenset("article post story".split())
WIDE_WORDS = frozenset("body content entry main".split())
#: From one of these words on a class tells a state ("no-sidebar", "has-comments"), not what the element is.
STATES = frozenset("no not has with without is are hide hides hidden show shows".split())
#: Elements that frame the article: no class word makes noise of them.
FRAMES = frozenset("html body main article".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Blocks that carry an article's own text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: tag -> the open tags that its start ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"p"} for t in BLOCK - set(ENDS) - {"html", "body", "td", "th", "option"}}
_LIMITS = frozenset("ul ol dl table select article section div body html main".split())

#: What stands between < and > of a tag; a quote opens a value after = only, and one that is never closed is a letter like others. Nothing is read twice.
_REST = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*+)" + _REST + r"|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _kind(token: str) -> str:
    """What a class or id says of its element: "noise", "text" or nothing. Its last telling word counts, before any word of state ("content-with-sidebar")."""
    words = [w.lower() for w in _WORD.findall(token)]
    words = words[: next((k for k, w in enumerate(words) if w in STATES), len(words))]
    telling = [w for w in words if w in NOISE_WORDS or w in TEXT_WORDS]
    if telling:
        return "noise" if telling[-1] in NOISE_WORDS else "text"
    return "text" if set(words) & WIDE_WORDS else ""


class Node:
    """noise: by its tag, role or state; named: by a word of its classes or id."""

    __slots__ = ("tag", "parts", "noise", "named", "name")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.parts = tag, []
        found = {}
        if attributes and attributes.strip("/ "):
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes = found.get("class", "").split()
        self.name = ".".join([tag, *sorted(classes)])
        self.noise = (
            tag in NOISE_TAGS
            or found.get("role", "").lower() in NOISE_ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
        )
        kinds = {_kind(token) for token in [*classes, found.get("id", "")]} if tag not in FRAMES else set()
        self.named = "noise" in kinds and "text" not in kinds


def parse(text: str) -> Node:
    """The DOM: nodes and strings in ``parts``. Raw elements keep no content."""
    root = Node("html", "")
    stack, at, end = [root], 0, len(text)
    opened: Counter[str] = Counter()  # tags on the stack, so that ends of others need no search

    def close_from(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while at < end:
        m = _TOKEN.match(text, at)
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            ends = ENDS.get(tag)
            if ends and any(opened[t] > 0 for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close_from(k)
                        break
                    if stack[k].tag in _LIMITS:
                        break
            if tag == "html":
                continue
            node = Node(tag, m[3])
            stack[-1].parts.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(text, at)
                at = close.end() if close else end
            elif tag not in VOID:
                stack.append(node)
                opened[tag] += 1
        elif m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close_from(k)
                    break
        elif (piece := m[0])[0] != "<" or piece == "<":
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)
    return root


def _path(above: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name, seed=above) >> 1


#: Base of the rolling hash of a node's words: a node's follows from those of its parts, so nesting costs nothing.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tree_nodes(root: Node) -> dict[int, tuple[int, int]]:
    """path -> (presentation, content) of one page, nodes with the same path put together. Nodes without words are left out."""
    looks: dict[int, set[str]] = {}
    says: dict[int, list[int]] = {}
    stack = [[root, 0, iter(root.parts), 0, 0]]  # node, path, parts to come, hash of its words so far, their number
    while stack:
        top = stack[-1]
        part = next(top[2], None)
        if isinstance(part, str):
            for word in part.split():
                top[3] = (top[3] * _BASE + xxhash.xxh3_64_intdigest(word)) & _MASK
                top[4] += 1
        elif part is not None:
            stack.append([part, _path(top[1], part.name), iter(part.parts), 0, 0])
        else:
            node, path, _, words, n = stack.pop()
            if n:
                looks.setdefault(path, set()).add(" ".join(dict.fromkeys(p.name for p in node.parts if not isinstance(p, str))))
                says.setdefault(path, []).append(words)
            if stack:
                stack[-1][3] = (stack[-1][3] * pow(_BASE, n, 1 << 64) + words) & _MASK
                stack[-1][4] += n
    digest = lambda parts: xxhash.xxh3_64_intdigest("\n".join(map(str, parts))) >> 1
    return {path: (digest(sorted(looks[path])), digest(says[path])) for path in says}


def main_text(root: Node, low: frozenset[int]) -> str:
    """The text blocks that stay, joined by a space."""
    kept = _blocks(root, low)
    if not kept and low:
        kept = _blocks(root, frozenset())
    return " ".join(kept or _blocks(root, frozenset(), by_name=False))  # names alone never empty a page


def _frame(root: Node) -> tuple[str | None, set[int]]:
    """The tag that marks the article, and the elements named like noise that have to be entered to reach it (none, if there is another way)."""
    found: dict[tuple[str, bool], set[int]] = {}
    stack: list[tuple[Node, tuple | None]] = [(root, None)]  # with the chain of named elements around it
    while stack:
        node, named = stack.pop()
        for part in node.parts:
            if isinstance(part, str) or part.noise:
                continue
            if part.tag in ("article", "main"):
                around, chain = found.setdefault((part.tag, named is not None), set()), named
                while chain and chain[0] not in around:
                    around.add(chain[0])
                    chain = chain[1]
            stack.append((part, (id(part), named) if part.named else named))
    for way in (("article", False), ("main", False), ("article", True), ("main", True)):
        if way in found:
            return way[0], found[way]
    return None, set()


def _blocks(root: Node, low: frozenset[int], by_name: bool = True) -> list[str]:
    inside, entered = _frame(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack = [(root, 0, iter(root.parts), inside is None)]
    while stack:
        node, path, parts, within = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node.tag in BLOCK:
                flush()
        elif isinstance(part, str):
            if within:
                run.append(part)
        elif part.tag in ("br", "wbr", "img", "input"):
            if within and part.tag == "br":
                run.append(" ")
        else:
            here, own = _path(path, part.name), within or part.tag == inside
            noise = part.noise or (by_name and part.named and id(part) not in entered)
            alike = here in low and not (own and inside and (part.tag in TEXT_BLOCKS or part.tag == inside or part.tag not in BLOCK))
            if part.tag in BLOCK or alike:
                flush()
            if not noise and not alike:
                stack.append((part, here, iter(part.parts), own))
    flush()
    return blocks


def low_nodes(pages: DataFrame) -> DataFrame:
    """host, low: the paths of low importance in each host's style tree, from pages (id, host, html)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                hosts, rows = batch.column(0).to_pylist(), []
                for host, text in zip(hosts, batch.column(1).to_pylist(), strict=True):
                    rows += [(host, path, look, says) for path, (look, says) in tree_nodes(parse(text or "")).items()]
                columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                arrays = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "look", "says"])

    nodes = cut(pages.select("host", "html").mapInArrow(run, "host string, path long, look long, says long").groupBy("host", "path", "look", "says").agg(F.count("*").alias("n")))
    many = pages.groupBy("host").agg(F.count("*").alias("pages"))

    def entropy(of: str, to: str) -> DataFrame:
        """Entropy of a feature relative to that of as many different values as there are pages."""
        counts = nodes.groupBy("host", "path", of).agg(F.sum("n").alias("n"))
        total = counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return total.select("host", "path", F.col("m").alias(f"m_{to}"), F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log("m")).otherwise(1.0).alias(to))

    both = entropy("look", "presentation").join(entropy("says", "content"), ["host", "path"]).join(many, "host")
    importance = CONTENT * F.col("content") + (1 - CONTENT) * F.col("presentation")
    # pages without evidence count as important ones, so a node of few pages is never weak
    weak = (importance * F.col("m_content") + PRIOR) / (F.col("m_content") + PRIOR) < IMPORTANCE
    return both.where(weak & (F.col("m_content") >= SHARE * F.col("pages"))).groupBy("host").agg(F.collect_list("path").alias("low"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    host, _ = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), host.alias("host"), pages[html_col].cast("string").alias("html"))
    low = cut(low_nodes(rows))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                texts = []
                for text, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    texts.append(main_text(parse(text or ""), frozenset(paths or ())))
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    done = rows.join(low, "host", "left").select("id", "url", "html", "low").mapInArrow(run, "id long, url string, text string, n_chars long")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
