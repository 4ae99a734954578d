"""HTML extraction: a tree-structured graphical model with exact sum-product inference.

A page becomes a tree: block-level elements, and under them a leaf for each text block (a run of
inline content between block boundaries). Every node is in one of three hidden states: content,
boilerplate, or container (holds both). Parent-child potentials P(child | parent) connect nodes; node
potentials are products of P(feature | state) over tag, name tokens, text size, link density, punctuation and
what the subtree holds (text, its share of the page, paragraphs, fields of forms) and how it differs from what
stands beside it (place, likes, size of its blocks). Messages go once up and once down, which gives each node's exact marginals; a text block
is extracted where content is the likeliest. Both kinds of potentials are counted from labelled
pages (see html_pages) with additive smoothing, regions counting alike whatever they hold, so training is one
pass in closed form.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones dropped, and the rest joined in page order by two line feeds. Scripts, styles,
comments and other markup that shows no text never make a block. br is white space.

Defined results: null or empty html, and pages without content, give an empty text of 0 characters;
broken markup is read leniently (open elements end with their parents; an unclosed comment or script
runs to the end, an open quote ends with its tag); pages of any depth and length take linear time and
no recursion; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.llm.html_pages import labelled_pages

CONTENT, BOILER, CONTAINER = 0, 1, 2
STATES = 3
SMOOTH = 0.3
#: Exponents of the potentials by kind of feature: the kinds overlap, so that each counts in part (chosen by coordinate
#: search on made pages of other seeds, with and without telling names, and on articles with readers' comments inside).
WEIGHTS = {"tag": 1.0, "mass": 0.14, "share": 0.1, "holds": 0.02, "spot": 0.17, "alike": 0.48, "against": 0.3, "name": 4.0, "in": 0.3, "size": 0.48, "ends": 1.0, "legal": 2.5}
#: Least potential of a transition that the labelled pages never show.
RARE = 1e-6

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What may end a tag or hide its end: ">" and quoted attribute values.
STOP = re.compile(r">|=\s*[\"']")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LABEL = re.compile(r'data-label="([cb])"')
LEGAL = re.compile("\\u00a9|copyright", re.I)
PIECES = re.compile(r"[^a-z0-9]+")
#: Fixed values of HTML: elements that make blocks, that have no content, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head button select option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
SILENT = RAW | frozenset("template noscript svg object math canvas audio video".split())
SILENT_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in SILENT}
#: An element of the key's kind ends when one of its values begins, inside the nearest of the listed parents.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements of forms, and what a sentence ends in.
FIELDS = frozenset("select button".split())
PLAIN = frozenset("p li dt dd tr h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption #root html body head hr label button".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCE_ENDS = ".!?…。！？"
INLINE_BLOCKS = frozenset("button select option label ins".split())


class Tree:
    """Nodes in page order (parents first): parent, tag, names; leaves have a text and the length of its links."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.names: list[str] = [""]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self.label: list[str] = [""]
        self.inputs: Counter[int] = Counter()

    def add(self, parent: int, tag: str, names: str, text: str | None = None, linked: int = 0, label: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label or self.label[parent])
        return len(self.tag) - 1

    def add_up(self) -> None:
        """Sums of every subtree: its text, linked text, paragraphs and fields of forms."""
        n = len(self.tag)
        self.mass, self.link_mass = [0 if t is None else len(t) for t in self.text], list(self.linked)
        self.paragraphs, self.fields = [int(t == "p") for t in self.tag], [self.inputs[k] for k in range(n)]
        self.leaves, self.children = [int(t is not None) for t in self.text], [0] * n
        self.nth, self.own_paragraphs, self.headed = [0] * n, [0] * n, [False] * n
        self.alike: Counter[tuple[int, str]] = Counter()
        for k in range(1, n):
            p = self.parent[k]
            self.nth[k] = self.children[p]
            self.children[p] += 1
            self.own_paragraphs[p] += self.tag[k] == "p"
            self.alike[p, self.tag[k]] += 1
            if not self.nth[k]:
                self.headed[p] = self.tag[k] in HEADS
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            self.leaves[p] += self.leaves[k]
            self.mass[p] += self.mass[k]
            self.link_mass[p] += self.link_mass[k]
            self.paragraphs[p] += self.paragraphs[k]
            self.fields[p] += self.fields[k]


class Scanner:
    """Markup by one forward scan: no place of the page is searched twice, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.at, self.lacking = page, 0, set()

    def find(self, what: str, start: int) -> int:
        """str.find that remembers what the rest of the page lacks."""
        if what in self.lacking:
            return -1
        k = self.page.find(what, start)
        if k < 0:
            self.lacking.add(what)
        return k

    def silent_end(self, tag: str) -> int:
        """Past the end tag of an element that shows no text; -1 if it has none."""
        end = None if f"</{tag}" in self.lacking else SILENT_END[tag].search(self.page, self.at)
        if end is None:
            self.lacking.add(f"</{tag}")
            return len(self.page) if tag in RAW else -1
        return end.end()

    def tag_end(self, start: int) -> tuple[int, int]:
        """Where a tag's attributes end, and where the page goes on."""
        size, at = len(self.page), start
        while m := STOP.search(self.page, at):
            if m[0] == ">":
                return m.start(), m.end()
            at = self.find(m[0][-1], m.end()) + 1
            if not at:  # the quote stays open: the tag ends all the same
                k = self.find(">", m.end())
                return (size, size) if k < 0 else (k, k + 1)
        return size, size

    def tokens(self) -> Iterator[tuple[str, bool, str]]:
        """("", False, text) for text, else (tag, closing, attributes)."""
        page, size = self.page, len(self.page)
        while self.at < size:
            k = self.find("<", self.at)
            if k != self.at:
                k = size if k < 0 else k
                yield "", False, page[self.at : k]
                self.at = k
            elif m := TAG.match(page, k + 1):
                end, self.at = self.tag_end(m.end())
                yield m[2].lower(), m[1] == "/", page[m.end() : end]
            elif page.startswith("<!--", k):
                end = COMMENT_END.search(page, k + 2)  # <!--> is a whole comment
                self.at = end.end() if end else size
            elif page[k + 1 : k + 2] in ("!", "?", "/"):
                end = self.find(">", k + 1)
                self.at = size if end < 0 else end + 1
            else:
                self.at = k + 1
                yield "", False, "<"


class OpenElements:
    """The stack of open blocks, with the depths at which each tag is open."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.depths = [0], ["#root"], {}

    def push(self, node: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def deepest(self, tags: tuple[str, ...]) -> int:
        """The depth of the innermost open element with one of the tags; 0 for none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.nodes.pop()
            self.depths[self.tags.pop()].pop()


def parse(page: str, labels: bool = False) -> Tree:
    tree, still_open, scanner = Tree(), OpenElements(), Scanner(page)
    run: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked, in_link
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(still_open.nodes[-1], "#text", "", text, min(linked, len(text)))
            run.clear()
        linked = in_link = 0

    def close(depth: int) -> None:
        flush()
        still_open.close(depth)

    for tag, closing, rest in scanner.tokens():
        if not tag:
            text = html.unescape(rest) if "&" in rest else rest
            run.append(text)
            if in_link:
                linked += len(text)
        elif tag in SILENT:
            if not closing and not (rest.endswith("/") and tag in ("svg", "math")) and (end := scanner.silent_end(tag)) >= 0:
                scanner.at = end
            run.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag not in BLOCKS:
            if tag in ("br", "img"):
                run.append(" ")
            elif tag == "input":
                tree.inputs[still_open.nodes[-1]] += 1
        elif closing:
            if depth := still_open.deepest((tag,)):
                close(depth)
            else:
                flush()
        else:
            if tag not in INLINE_BLOCKS and (depth := still_open.deepest(("p",))):
                close(depth)
            if tag in ENDS and (depth := still_open.deepest(ENDS[tag])) > still_open.deepest(WITHIN[tag]):
                close(depth)
            flush()
            names = " ".join(x or y or z for x, y, z in NAMES.findall(rest)) if rest else ""
            mark = LABEL.search(rest) if labels else None
            node = tree.add(still_open.nodes[-1], tag, names.lower(), label=mark[1] if mark else "")
            tree.inputs[node] += tag in FIELDS
            if tag not in VOID:
                still_open.push(node, tag)
    flush()
    tree.add_up()
    return tree


def density(linked: int, size: int) -> int:
    share = linked / max(1, size)
    return 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3


def features(tree: Tree, k: int) -> list[str]:
    """What is seen of a node: each begins with its kind."""
    if (text := tree.text[k]) is None:
        mass = tree.mass[k]
        out = [f"tag {tree.tag[k]} {bool(tree.names[k])}", f"mass {min(12, mass.bit_length())} {density(tree.link_mass[k], mass)}", f"share {round(8 * mass / max(1, tree.mass[0]))}"]
        out.append(f"holds {min(4, tree.paragraphs[k])} {min(1, tree.fields[k])}")
        if tree.tag[k] not in PLAIN:
            out += beside(tree, k)
        if tree.names[k]:
            out += [f"name {x}" for x in dict.fromkeys(PIECES.split(tree.names[k])) if len(x) > 1 and not x.isdigit()]
        return out
    size = len(text)
    out = [f"in {tree.tag[tree.parent[k]]}", f"size {min(9, size.bit_length())} {density(tree.linked[k], size)}", f"ends {text[-1] in SENTENCE_ENDS} {'.' in text or ',' in text}"]
    return [*out, "legal"] if size < 200 and LEGAL.search(text) else out


def beside(tree: Tree, k: int) -> list[str]:
    """How a node differs from what stands beside it: its place, how many are like it, and the size of its blocks against theirs."""
    p = tree.parent[k]
    if p < 0:
        return []
    last = tree.nth[k] == tree.children[p] - 1
    out = [f"spot {0 if not tree.nth[k] else 2 if last else 1} {min(2, tree.own_paragraphs[p])}", f"alike {min(3, tree.alike[p, tree.tag[k]])} {tree.headed[k]}"]
    others = tree.leaves[p] - tree.leaves[k]
    if others and tree.leaves[k]:
        ratio = (tree.mass[k] / tree.leaves[k]) / max(1, (tree.mass[p] - tree.mass[k]) / others)
        out.append(f"against {max(-3, min(3, round(math.log2(max(ratio, 1e-3)))))}")
    return out


class TreeModel:
    def __init__(self, logs: dict[str, tuple[float, float, float]], turn: list[list[float]], root: list[float]):
        self.logs, self.turn, self.root = logs, turn, root

    def potential(self, feats: list[str]) -> list[float]:
        a = b = c = 0.0
        for f in feats:
            if x := self.logs.get(f):
                w = WEIGHTS[f.split(" ", 1)[0]]
                a, b, c = a + w * x[0], b + w * x[1], c + w * x[2]
        top = max(a, b, c)
        return [math.exp(a - top), math.exp(b - top), math.exp(c - top)]

    def marginals(self, tree: Tree) -> list[list[float]]:
        """P(state) of every node: messages up in reverse page order, then down in page order."""
        n, turn, parent = len(tree.tag), self.turn, tree.parent
        below = [self.potential(features(tree, k)) for k in range(n)]
        up: list[list[float]] = [[1.0] * STATES for _ in range(n)]
        for k in range(n - 1, 0, -1):
            b0, b1, b2 = below[k]
            total = b0 + b1 + b2
            b0, b1, b2 = b0 / total, b1 / total, b2 / total
            below[k] = [b0, b1, b2]
            up[k] = m = [t[0] * b0 + t[1] * b1 + t[2] * b2 for t in turn]
            into = below[parent[k]]
            x, y, z = into[0] * m[0], into[1] * m[1], into[2] * m[2]
            scale = x + y + z
            below[parent[k]] = [x / scale, y / scale, z / scale]
        belief = [[0.0] * STATES for _ in range(n)]
        for k in range(n):
            if k == 0:
                down = self.root
            else:
                p, m = belief[parent[k]], up[k]
                c0, c1, c2 = p[0] / m[0], p[1] / m[1], p[2] / m[2]
                down = [c0 * turn[0][s] + c1 * turn[1][s] + c2 * turn[2][s] for s in range(STATES)]
            x, y, z = below[k][0] * down[0], below[k][1] * down[1], below[k][2] * down[2]
            total = x + y + z
            belief[k] = [x / total, y / total, z / total]
        return belief

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        tree = parse(page)
        blocks = []
        for text, p in zip(tree.text, self.marginals(tree)):
            if text is not None and p[CONTENT] > p[BOILER] and p[CONTENT] > p[CONTAINER]:
                blocks.append(text)
        return "\n\n".join(blocks)


def train(pages: list[str]) -> TreeModel:
    """Counts potentials from labelled pages."""
    seen: list[Counter] = [Counter() for _ in range(STATES)]
    kinds: list[Counter] = [Counter() for _ in range(STATES)]
    turns = [[0.0] * STATES for _ in range(STATES)]
    for page in pages:
        tree = parse(page, labels=True)
        state = [{"c": CONTENT, "b": BOILER}.get(x, CONTAINER) for x in tree.label]
        # Regions count alike, whatever they hold: a menu of nine links is one example of boilerplate, as a comment is.
        region = [0] * len(state)
        for k, s in enumerate(state):
            p = tree.parent[k]
            region[k] = k if not k or s != state[p] else region[p]
        size = Counter(region)
        for k, s in enumerate(state):
            if k:
                turns[state[tree.parent[k]]][s] += 1
            w = 1 / math.sqrt(size[region[k]])
            for f in features(tree, k):
                seen[s][f] += w
                kinds[s][f.split(" ")[0]] += w
    vocabulary = {f for c in seen for f in c}
    width = Counter(f.split(" ")[0] for f in vocabulary)
    logs = {}
    for f in vocabulary:
        kind = f.split(" ")[0]
        logs[f] = tuple(math.log((seen[s][f] + SMOOTH) / (kinds[s][kind] + SMOOTH * (width[kind] + 1))) for s in range(STATES))
    turn = [[max(RARE, x / max(1.0, sum(row))) for x in row] for row in turns]
    return TreeModel(logs, turn, [RARE, RARE, 1.0])


_MODEL: list[TreeModel] = []


def default_model() -> TreeModel:
    if not _MODEL:
        _MODEL.append(train(labelled_pages()))
    return _MODEL[0]


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
