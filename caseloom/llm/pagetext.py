"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page's block elements and runs of text form a tree. Each node has one of three labels: chrome (menus, footers, notices), content,
or prose that stands apart (comments, sidebars). Parent-child potentials connect the nodes; an element's tag and names and the
signs of a run of text give each node a potential of its own. Sum-product messages go upward and downward, so marginals are exact;
runs of text that are more likely content than not are the main text, in page order.

The model is trained on labelled pages: a bounded sample of pages (``PageModel.most_pages``, in hash order) whose own markup names the main
part. Labels come from the elements that HTML itself defines for this (article, main; nav, aside, menu, header, footer), and these
tags are not learnt from, as that would be learning the labels by themselves. What is learnt: the potentials between parent and child, and how
much every other tag, every class, id or role name and every sign of a text says. Words that commonly name parts of pages bring a
prior, which data about a word replace. Each sign is bounded and none decides alone: a paragraph can outvote its
section's name, a section its text.

Defined results: null and empty pages have an empty text. Scripts, styles, forms, comments and markup are never text. Character references are decoded;
an unfinished tag at the page's end is dropped; br is white space. Pages of any length and depth are judged whole, at a cost linear in their nodes.
Without labelled pages the priors decide. Repeated rows give repeated rows and, equal ones of one page_id, count once in the sample.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from html.parser import HTMLParser
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, bounded_batches, text_of

# Fixed values of HTML: elements by what they do to the tree.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("applet audio button canvas datalist embed form head iframe input math noframes noscript object optgroup option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
SCOPES = frozenset(("ul", "ol", "dl", "table", "td", "th", "body", "html", "div", "section", "article", "aside", "nav", "header", "footer", "main"))
# What HTML's own elements say, as evidence for (chrome, content, apart); they give the labels of training pages.
CHROME, CONTENT, APART = range(3)
DEFINED = {"article": (-4.0, 0.0, -4.0), "main": (-4.0, 0.0, -4.0), "nav": (0.0, -5.0, -2.0), "menu": (0.0, -5.0, -2.0), "dialog": (0.0, -5.0, -2.0), "footer": (0.0, -5.0, -2.0), "aside": (-1.0, -5.0, 0.0), "header": (0.0, -2.5, -1.5)}
MAIN_TAGS = frozenset(("article", "main"))
# Words that name parts of a page; the first group of each label says more than the second.
NAMES = {
    CHROME: ("banner breadcrumb breadcrumbs cookie cookies consent masthead menu nav navbar navigation pagination pager toolbar login signup subscribe newsletter popup modal skip footer", "header notice search form"),
    CONTENT: ("", "article body content entry main post story text"),
    APART: ("ad ads adv advert advertisement advertising comment comments disqus promo promoted reply replies reviews sidebar sponsor sponsored user users posts widget discussion", "related recommended share sharing social tags"),
}
_STRONG, _WEAK = 6.0, 2.0
#: A name that begins with one of these says what a part has or is filed under, not what it is.
MODIFIERS = frozenset("has with without no is tag category cat".split())
_SAYS = {word: (label, said) for label, groups in NAMES.items() for words, said in zip(groups, (_STRONG, _WEAK), strict=True) for word in words.split()}

_SPACES = re.compile(f"[{SPACE_CLASS}\xa0]+")
_NAMES = re.compile(r"[^a-z]+")


@dataclass
class Node:
    """An element, or a run of text (text isn't empty); parents stand before their children in a page's list."""

    parent: int
    tag: str
    names: tuple[tuple[str, ...], ...] = ()
    text: str = ""
    linked: int = 0


@dataclass(frozen=True)
class PageModel:
    """Bounds of the sample; pseudo-counts of a share; bounds of what one sign says. Then what was learnt: potentials by kind of child and label of parent, signs."""

    most_pages: int = 400
    most_chars: int = 200_000
    smooth: float = 5.0
    most_named: float = 4.0
    most_said: float = 1.5
    turn: dict = field(default_factory=dict)
    signs: dict = field(default_factory=dict)


def names_of(attrs: list[tuple[str, str | None]]) -> tuple[tuple[str, ...], ...]:
    """The words of each class, id and role name."""
    found = (tuple(filter(None, _NAMES.split(x))) for k, v in attrs if k in ("class", "id", "role") and v for x in v.lower().split())
    return tuple(dict.fromkeys(x for x in found if x and x[0] not in MODIFIERS))


def kind_of(node: Node) -> str:
    """Kind of child: text; an element that HTML or a telling name sets off from what it stands in; any other element."""
    if node.text:
        return "text"
    off = node.tag in ("nav", "menu", "dialog", "footer", "aside") or node.tag not in ("html", "body") and any(_SAYS.get(w, (CONTENT, 0.0))[0] != CONTENT and _SAYS[w][1] == _STRONG for name in node.names for w in name)
    return "off" if off else "element"


class _Tree(HTMLParser):
    """Builds a page's nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "page")]
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # of each tag that is open, and of all scopes
        self.silent: list[str] = []
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            self.nodes.append(Node(self.open[-1], self.nodes[self.open[-1]].tag, (), text, self.linked))
        self.parts, self.linked = [], 0

    def _close_to(self, depth: int) -> None:
        self.flush()
        while len(self.open) > depth:
            tag = self.nodes[self.open.pop()].tag
            self.depths[tag].pop()
            if tag in SCOPES:
                self.depths["any scope"].pop()

    def _last(self, tag: str) -> int:
        """Depth of the innermost open element of a tag, 0 if there is none."""
        return (self.depths.get(tag) or (0,))[-1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if tag == self.silent[-1] and tag not in VOID:
                self.silent.append(tag)
            if not (tag == "body" and self.silent[-1] in ("head", "title")):
                return
            self.silent = []
        if tag in SILENT:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "a":
            self.links = 1
        if tag in ("br", "wbr", "img"):
            self.parts.append(" ")
        if tag not in BLOCKS:
            return
        self.flush()
        self.links = 0
        if tag in CLOSES_P and self._last("p") > self._last("any scope"):
            self._close_to(self._last("p"))
        if tag in SIBLINGS:
            ends = SIBLINGS[tag]
            depth = max(map(self._last, ends))
            inner = self._last("any scope")
            if depth and (depth >= inner or inner and self.nodes[self.open[inner]].tag in ends):
                self._close_to(depth)
        if tag == "hr":
            return
        self.nodes.append(Node(self.open[-1], tag, names_of(attrs)))
        self.open.append(len(self.nodes) - 1)
        self.depths.setdefault(tag, []).append(len(self.open) - 1)
        if tag in SCOPES:
            self.depths.setdefault("any scope", []).append(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.links = 0
            if self._last(tag):
                self._close_to(self._last(tag))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            self.linked += self.links * len(data.strip())


def tree_of(html: str) -> list[Node]:
    """The nodes of a page."""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[a-zA-Z/!]", html[cut : cut + 2]):
        html = html[:cut]
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    return tree.nodes


#: Headings of all ranks are alike.
_ALIKE = {f"h{k}": "heading" for k in range(1, 7)}


def signs_of(node: Node) -> tuple[str, ...]:
    """What is learnt about a node: of a run of text its length, links, ending and element; of an element its tag and names."""
    if not node.text:
        return ("tag " + _ALIKE.get(node.tag, node.tag), *("name " + w for name in node.names for w in name))
    words, share = node.text.count(" ") + 1, node.linked / max(1, len(node.text))
    size = next(name for name, most in (("1", 2), ("2", 7), ("3", 20), ("4", 1 << 60)) if words <= most)
    return ("words " + size, "links " + ("none" if share == 0 else "some" if share < 0.5 else "all"), "ends " + str(node.text[-1] in ".!?:;…\"'”»"), "in " + _ALIKE.get(node.tag, node.tag))


def labels_of(nodes: list[Node]) -> list[int] | None:
    """Labels by the elements that HTML defines; None for a page that has no main part among them.

    What stands in an aside, or in an article inside an article (a comment, by HTML's definition), is apart.
    """
    if not any(n.tag in MAIN_TAGS for n in nodes):
        return None
    labels: list[int] = []
    for node in nodes:
        above = labels[node.parent] if node.parent >= 0 else CHROME
        label = above
        if not node.text:
            if node.tag in ("nav", "menu", "dialog", "footer"):
                label = CHROME if above != APART else APART
            elif node.tag == "aside" or node.tag == "article" and above != CHROME and node.parent > 0 and any(nodes[node.parent].tag == t for t in ("article", "li", "section", "div")) and _inside_article(nodes, node.parent):
                label = APART
            elif node.tag in MAIN_TAGS and above == CHROME:
                label = CONTENT
        labels.append(label)
    return labels


def _inside_article(nodes: list[Node], i: int) -> bool:
    for _ in range(8):  # comments stand a few elements below their article
        if i < 0:
            return False
        if nodes[i].tag == "article" and not nodes[i].text:
            return True
        i = nodes[i].parent
    return False


# Priors: counts of (chrome, content, apart) children by kind of child and label of parent; what a text's signs say before training.
_TURN = {("element", CHROME): (16.0, 3.0, 1.0), ("element", CONTENT): (0.7, 18.6, 0.7), ("element", APART): (1.0, 0.1, 18.9), ("off", CHROME): (12.0, 2.0, 6.0), ("off", CONTENT): (5.0, 6.0, 9.0), ("off", APART): (7.0, 0.2, 12.8), ("text", CHROME): (18.0, 1.5, 0.5), ("text", CONTENT): (0.5, 19.0, 0.5), ("text", APART): (0.5, 0.1, 19.4)}
_SAID = {"words 1": -0.5, "words 3": 0.3, "words 4": 1.0, "links none": 0.2, "links all": -1.5, "ends True": 0.4, "ends False": -0.3, "in p": 0.5, "in heading": 0.5}


def _prior(sign: str) -> tuple[float, float, float]:
    kind, _, word = sign.partition(" ")
    if kind == "name":
        label, said = _SAYS.get(word, (CONTENT, 0.0))
        return tuple(0.0 if k == label else -said if k == CONTENT or label == CONTENT else -said / 2 for k in range(3))
    return (-_SAID.get(sign, 0.0), 0.0, 0.0)  # text of any prose is alike, be it content or apart


def learn(pages: list[str], base: PageModel = PageModel()) -> PageModel:
    """Count the potentials on the labelled pages of a sample."""
    turn = {k: list(v) for k, v in _TURN.items()}
    seen: dict[str, list[float]] = {}
    total = {"element": [0.0] * 3, "text": [0.0] * 3}
    for html in pages:
        nodes = tree_of(html)
        if (labels := labels_of(nodes)) is None:
            continue
        for node, label in zip(nodes[1:], labels[1:], strict=True):
            kind = kind_of(node)
            # A part's own element turns from its parent's label by definition; what it is like is learnt, not that it turns.
            if node.tag not in DEFINED or node.text:
                turn[kind, labels[node.parent]][label] += 1
            total["text" if node.text else "element"][label] += 1
            for sign in signs_of(node):
                if sign[4:] not in DEFINED or not sign.startswith("tag "):
                    seen.setdefault(sign, [0.0] * 3)[label] += 1
    chance = {}
    for key, counts in turn.items():
        share = [x / sum(counts) for x in counts]
        share = [x / sum(_TURN[key]) for x in _TURN[key]] if key[1] == APART or key == ("off", CONTENT) else [max(x, 0.02 if key[0] == "text" else 0.05) for x in share]
        chance[key] = tuple(x / sum(share) for x in share)
    signs = {}
    for sign, counts in seen.items():
        kind = "element" if sign.startswith(("tag ", "name ")) else "text"
        every = sum(total[kind])
        rate = sum(counts) / every
        said = [log((n + base.smooth * rate) / (t + base.smooth)) for n, t in zip(counts, total[kind], strict=True)]
        if kind == "text":
            said[APART] = said[CONTENT]
        weight, most = sum(counts) / (sum(counts) + base.smooth), base.most_named if sign.startswith("name ") else base.most_said
        said = [max(-most, x - max(said)) for x in said]
        signs[sign] = tuple(weight * x + (1 - weight) * y for x, y in zip(said, _prior(sign), strict=True))
    return PageModel(base.most_pages, base.most_chars, base.smooth, base.most_named, base.most_said, chance, signs)


def own_potential(node: Node, model: PageModel) -> tuple[float, ...]:
    """A node's potential: what its signs say together; of a name's words, for each label, the one that says most."""
    said = [0.0] * 3
    add = lambda values: [x + y for x, y in zip(said, values, strict=True)]
    get = lambda sign: model.signs[sign] if sign in model.signs else _prior(sign)
    if node.text:
        for sign in signs_of(node):
            said = add(get(sign))
    else:
        said = list(DEFINED.get(node.tag) or get("tag " + _ALIKE.get(node.tag, node.tag)))
        if node.tag not in ("html", "body"):  # their names are about the page
            for name in node.names:
                said = add(map(min, zip(*(get("name " + word) for word in name), strict=True)))
    top = max(said)
    return tuple(exp(x - top) for x in said)


def marginals(nodes: list[Node], model: PageModel, known: dict | None = None) -> list[tuple[float, ...]]:
    """Each node's probabilities of the labels: messages upward from the leaves, then downward from the root, which is chrome.

    Each step is a product of three numbers, scaled, so the cost is linear in the nodes. known: potentials kept from page to page.
    """
    known = {} if known is None else known
    n = len(nodes)
    kinds = [""] * n
    belief: list[tuple[float, ...]] = [(1.0, 0.0, 0.0)] * n  # own potential and messages from below
    for i in range(1, n):
        node = nodes[i]
        key = signs_of(node) if node.text else (node.tag, node.names)
        got = known.get(key)
        if got is None:
            if len(known) > 50_000:
                known.clear()
            got = known[key] = own_potential(node, model), kind_of(node)
        belief[i], kinds[i] = got
    turns = {kind: tuple(model.turn[kind, above] for above in range(3)) for kind in ("element", "off", "text")}
    up: list[tuple[float, ...]] = [(1.0, 1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):  # children stand after their parents
        node, (a, b, c) = nodes[i], belief[i]
        t0, t1, t2 = turns[kinds[i]]
        x, y, z = t0[0] * a + t0[1] * b + t0[2] * c, t1[0] * a + t1[1] * b + t1[2] * c, t2[0] * a + t2[1] * b + t2[2] * c
        up[i] = (x, y, z)
        p, q, r = belief[node.parent]
        p, q, r = p * x, q * y, r * z
        s = p + q + r
        belief[node.parent] = (p / s, q / s, r / s)
    out = belief
    for i in range(1, n):
        node = nodes[i]
        p, q, r = out[node.parent]
        x, y, z = up[i]
        p, q, r = p / x, q / y, r / z
        t0, t1, t2 = turns[kinds[i]]
        a, b, c = belief[i]
        a, b, c = a * (p * t0[0] + q * t1[0] + r * t2[0]), b * (p * t0[1] + q * t1[1] + r * t2[1]), c * (p * t0[2] + q * t1[2] + r * t2[2])
        s = a + b + c
        out[i] = (a / s, b / s, c / s)
    return out


def main_text(html: str, model: PageModel, known: dict | None = None) -> str:
    nodes = tree_of(html)
    return "\n\n".join(n.text for n, p in zip(nodes, marginals(nodes, model, known), strict=True) if n.text and p[CONTENT] >= 0.5)


def text_batches(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = [main_text(x or "", model.value, known) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, base: PageModel = PageModel()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    labelled = F.lower("html").rlike("<(article|main)[\\s>]")
    usable = pages.filter(F.length("html").between(1, base.most_chars) & labelled).select("page_id", "html", F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("same"))
    ids = usable.select("h", "page_id", "same").distinct().orderBy("h", "page_id", "same").limit(base.most_pages)
    chosen = usable.join(F.broadcast(ids.select("page_id", "same")), ["page_id", "same"], "left_semi").dropDuplicates(["page_id", "same"]).select("html")
    model = spark.sparkContext.broadcast(learn(sorted(r[0] for r in chosen.collect()), base))
    return pages.select("page_id", "url", text_of("html").alias("html")).mapInArrow(partial(text_batches, model=model), f"page_id {kind}, url string, text string, n_chars long")
