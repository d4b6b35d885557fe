"""Operator 8: the main text of a web page by tree scoring.

The page is parsed into a tree. Blocks of running text pass points, for their length and
their commas, to their ancestors, half as many for each further step; link density takes
points off. The best container wins, and siblings of it that score well or hold running
text join it. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are taken out by element and by the words of class, id and role.

Cases: null, empty and text-free pages give an empty text; a page without any container
gives its body's text; broken, unclosed and cut-off markup is read as browsers read it;
very long pages are read whole; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
DROPPED = frozenset(
    "script style noscript template nav header footer aside form button select option textarea input fieldset iframe object svg canvas dialog menu head title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
CLOSES_P = BLOCKS - frozenset(("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"))
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios commentlist consent cookie cookies disqus
    footer gdpr masthead menu menus modal nav navbar navigation newsletter overlay pagination pager popup promo promoted
    sidebar sidebars sponsor sponsored sponsors subscribe subscription toolbar widget widgets toast outbrain taboola paywall""".split()
)
#: Noise alone or beside words of layout ("share-buttons"), but not beside others ("social-history").
WEAK_WORDS = frozenset(
    "header notice notices promotion related reply replies respond share sharing signup skip social tags alert alerts discussion recommended recommendations search".split()
)
LAYOUT_WORDS = frozenset(
    """area article articles bar block body bottom box button buttons container content cloud entry fixed form global group icons info inner item items left link links list
    main message more news outer page panel post posts primary right row secondary section site small stories story sub text title to top wrap wrapper""".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("ul ol dl table blockquote pre figure".split())  # of the article when they stand next to its best container
KEPT = frozenset(("html", "body", "main", "article"))
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
COMMAS = re.compile("[,،、，;]")


class Node:
    __slots__ = ("tag", "noise", "parent", "children", "score")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise, self.score = tag, parent, noise, 0.0
        self.children: list[Node | str] = []


def is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    if tag in KEPT:
        return False
    for name, value in attrs:
        if name in ("class", "id"):
            for name_ in (value or "").split():
                words = set(WORD.findall(CAMEL.sub(" ", name_).lower()))
                if not words.isdisjoint(NOISE_WORDS) or not words.isdisjoint(WEAK_WORDS) and words <= WEAK_WORDS | LAYOUT_WORDS:
                    return True
        elif name == "role":
            if (value or "").lower() in NOISE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in (value or "").replace(" ", "").lower():
            return True
    return False


class Tree(HTMLParser):
    """Builds the tree; end tags that are left out are put in as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        # Open elements below the root, and where in ``path`` those of a name and the blocks are.
        self.path: list[Node] = []
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` outside of foreign markup is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _last(self, tags: Iterable[str]) -> int:
        """Where in ``path`` the innermost open element of these names is, -1 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _leave(self, depth: int) -> None:
        """Close the open element at ``depth`` and all within it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.open[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        self.at = self.path[-1] if self.path else self.root

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        depth = self._last(tags)
        if depth > self._last(scope):
            self._leave(depth)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "head", "body") and tag != "head":
            if tag == "body":
                self._close(("head",), ())
            return
        if tag in CLOSES_P:
            self._close(("p",), ("table", "td", "th", "button", "article", "div", "section", "li", "blockquote"))
        if tag in SIBLING:
            self._close(SIBLING[tag], SCOPE[tag])
        node = Node(tag, self.at, is_noise(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.path))
            if tag in BLOCKS:
                self.blocks.append(len(self.path))
            self.path.append(node)
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in BLOCKS:
            self._leave(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        depth = self._last((tag,))
        inline = tag not in BLOCKS and tag != "head"  # does not close a block
        if depth >= 0 and not (inline and self.blocks and self.blocks[-1] > depth):
            self._leave(depth)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def measured(root: Node) -> dict[int, tuple[int, int, int]]:
    """Letters, letters in links and commas below each node, without noise."""
    sums: dict[int, list[int]] = {}
    stack = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        if not done:
            sums[id(node)] = [0, 0, 0]
            stack.append((node, linked, True))
            stack += [(x, linked or x.tag == "a", False) for x in node.children if not isinstance(x, str) and not x.noise]
            continue
        own = sums[id(node)]
        for x in node.children:
            if isinstance(x, str):
                n = len(x.strip())
                own[0] += n
                own[1] += n * (linked or node.tag == "a")
                own[2] += len(COMMAS.findall(x))
            elif not x.noise:
                for k, v in enumerate(sums[id(x)]):
                    own[k] += v
    return {k: tuple(v) for k, v in sums.items()}


def main_nodes(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    sums = measured(root)

    def density(node: Node) -> float:
        letters, linked, _ = sums[id(node)]
        return linked / letters if letters else 1.0

    containers, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in CONTAINERS:
            containers.append(node)
        if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.tag == "div" and any(isinstance(x, str) and x.strip() for x in node.children):
            letters, _, commas = sums[id(node)]
            if letters:
                points = (1 + commas + min(letters / 100, 3)) * (1 - density(node))
                above, share = node.parent, 1.0
                if node.tag in CONTAINERS:
                    node.score += points
                while above is not None and share > 1e-9:
                    above.score += points * share
                    above, share = above.parent, share / 2
        stack += [x for x in node.children if not isinstance(x, str) and not x.noise]
    scored = [(n.score * (1 - density(n)) * (1.5 if n.tag in ("article", "main") else 1.0), -k, n) for k, n in enumerate(containers)]
    if not scored or max(scored)[0] <= 0:
        return [root]
    top, _, best = max(scored)
    while best.parent is not None and best.parent.tag == "article":
        best = best.parent
    if best.parent is None:
        return [best]
    chosen = []
    for x in best.parent.children:
        if isinstance(x, str) or x.noise:
            continue
        letters, _, _ = sums[id(x)]
        if x is best or x.tag == best.tag and x.score >= max(10, 0.2 * top) and density(x) < 0.3:
            chosen.append(x)
        elif x.tag == "p" and letters and (letters > 80 and density(x) < 0.25 or density(x) == 0) or x.tag in HEADINGS and letters and density(x) < 0.5:
            chosen.append(x)
        elif x.tag in BESIDE and letters and density(x) < 0.25:
            chosen.append(x)
    return chosen


def block_texts(nodes: list[Node]) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            blocks.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.noise:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return blocks


def main_text(html: str | None) -> str:
    return "\n\n".join(block_texts(main_nodes(parse(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
