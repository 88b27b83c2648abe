"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements, with a leaf for every run of text. Each node has a hidden label, content or
not. A node's potential is log-linear in its features (tag, class and id words, length, share of linked text); a potential on each
parent-child edge, by the kind of child, lets labels agree or break. Sum-product messages go up the tree and down again and give every
node's marginal exactly; text leaves of at least one half are the main text. The weights maximise the likelihood of the labelled
pages, with the gradient from the same marginals.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import table
from dealerlens.llm.labelled_pages import MARK, labelled_pages

#: Attributes: names, each with or without ``=`` and a value, which may hold a slash, if it is quoted also white space and ``>``.
_ATTRS = r"(?:[\s/]+|=?[^\s/>=<]+(?>\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s<>]*)?)?|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRS})>|<[!?][^>]*>|[^<]+|<", re.S)
#: A last value without quotes, which the slash before the ``>`` belongs to.
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template title iframe svg object textarea select option button canvas audio video annotation annotation-xml".split())
#: Elements of other vocabularies: there a slash before the ``>`` closes, in HTML it says nothing.
_FOREIGN = frozenset("svg annotation annotation-xml".split())
_RAW = frozenset("script style title textarea iframe noscript".split())
#: Tags that make no node: the document's frame, and what may stand in its head besides skipped elements.
_FRAME = frozenset("html head body meta link base".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
_INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
                     "sub sup time tt u var wbr img br picture "
                     "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
                     "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics").split())
_CLOSES_P = frozenset(("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                       "hgroup hr li main menu nav ol p pre search section summary table ul").split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPES = frozenset("ul ol dl table body html article section div main aside nav form".split())
_KINDS = ("text", "nav", "header", "footer", "aside", "form", "article", "main", "section", "p", "ul", "ol", "li", "table", "tr", "td", "div", "h1", "h2",
          "h3", "other")
_KIND = {k: n for n, k in enumerate(_KINDS)}


@dataclass
class Tree:
    """Nodes in page order, so parents come before children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words: tuple[str, ...] = (), text: str = "", linked: int = 0) -> int:
        for col, v in zip((self.parent, self.tag, self.words, self.text, self.linked), (parent, tag, words, text, linked), strict=True):
            col.append(v)
        return len(self.parent) - 1


@functools.lru_cache(maxsize=50_000)
def _attr_words(attrs: str) -> tuple[str, ...]:
    found = (w.lower() for m in _ATTR.finditer(attrs) for w in _WORD.findall(m[2] or m[3] or m[4] or ""))
    return tuple(dict.fromkeys(w[:-1] if w.endswith("s") and len(w) > 3 else w for w in found))


def _closes_itself(name: str, attrs: str) -> bool:
    return name in _FOREIGN and attrs.endswith("/") and not _OPEN_VALUE.search(attrs)


def parse(page: str) -> Tree:
    """The block tree of a page. End tags that HTML lets out are implied; unmatched end tags are ignored; a text run is what stands
    between two block boundaries, its white space collapsed."""
    tree = Tree()
    stack = [tree.add(-1, "html")]
    run: list[str] = []
    state = {"links": 0, "linked": 0}
    skip = None  # the element whose text is skipped, and how deep it nests
    depth = 0

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(stack[-1], "text", (), text, min(state["linked"], len(text)))
            run.clear()
        state["linked"] = 0

    def close(tags: tuple[str, ...], stops: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[k]] in tags:
                flush()
                del stack[k:]
                return
            if tree.tag[stack[k]] in stops:
                return

    pos = 0
    while m := _TOKEN.match(page, pos):
        pos = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if skip is None and not piece.startswith(("<!", "<?")):
                piece = html.unescape(piece)
                run.append(piece)
                if state["links"]:
                    state["linked"] += len(piece.strip())
            continue
        name = name.lower()
        if name in _RAW:  # nothing counts in it but its own end tag
            if not m[1]:
                end = _RAW_END[name].search(page, pos)
                pos = end.end() if end else len(page)
            continue
        if skip == "option" and m[1] and any(tree.tag[k] == name for k in stack[1:]):
            skip = None  # its end tag is let out, and the parent ends
        if skip is not None:
            if name == skip:
                depth += -1 if m[1] else 0 if name == "option" or _closes_itself(name, m[3]) else 1
                if depth == 0:
                    skip = None
            continue
        if name in _SKIPPED:
            if not m[1] and not _closes_itself(name, m[3]):
                skip, depth = name, 1
            continue
        if name in _INLINE:
            if name == "a":
                state["links"] = 0 if m[1] else 1
            elif name == "br":
                run.append(" ")
            continue
        flush()
        state["links"] = 0
        if m[1]:
            close((name,), frozenset())
            continue
        if name in _CLOSES_P:
            close(("p",), _SCOPES)
        if name in _SIBLINGS:
            own = _SIBLINGS[name]
            close(own[:1] if name == "tr" else own, _SCOPES)
        if name in _FRAME:
            continue
        node = tree.add(stack[-1], name, _attr_words(m[3]) if m[3] else ())
        if name not in _VOID:
            stack.append(node)
    flush()
    return tree


def _share(linked: int, size: int) -> str:
    part = linked / size if size else 0
    return "0" if part == 0 else "1" if part < .3 else "2" if part < .8 else "3"


def node_features(tree: Tree) -> list[list[str]]:
    """The feature names of every node."""
    n = len(tree.parent)
    size, linked = [len(t) for t in tree.text], list(tree.linked)
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        linked[tree.parent[k]] += linked[k]
    out = []
    for k in range(n):
        share = _share(linked[k], size[k])
        if tree.tag[k] == "text":
            text, up = tree.text[k], tree.tag[tree.parent[k]]
            f = ["t", f"t:{up}", f"t:size{min(10, size[k].bit_length())}", f"t:link{share}"]
            f += ["t:end"] if text[-1] in ".!?…:;\"')" else []
            f += ["t:©"] if "©" in text else []
        else:
            f = [f"e:{tree.tag[k]}", f"e:size{min(13, size[k].bit_length())}", f"e:link{share}", *(f"w:{w}" for w in tree.words[k])]
        out.append(f)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    pairs: np.ndarray  # kind of child, label of parent, label of child


def _messages(tree: Tree, odds: list[float], psi: list) -> tuple[list, list]:
    """Sum-product on the tree: each node's belief from below, and its marginal P(content).

    odds: each node's own log-odds; psi: potentials by kind, as ((p00, p01), (p10, p11))."""
    n, parent, tag = len(odds), tree.parent, tree.tag
    kinds = [_KIND.get(t, _KIND["other"]) for t in tag]
    b0, b1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, x))) for x in odds]
    up = [(1.0, 1.0)] * n
    for k in range(n - 1, 0, -1):
        s = b0[k] + b1[k]
        x0, x1 = b0[k] / s, b1[k] / s
        b0[k], b1[k] = x0, x1
        (p00, p01), (p10, p11) = psi[kinds[k]]
        m0, m1 = p00 * x0 + p01 * x1, p10 * x0 + p11 * x1
        up[k] = (m0, m1)
        q = parent[k]
        b0[q] *= m0
        b1[q] *= m1
        s = b0[q] + b1[q]
        b0[q] /= s
        b1[q] /= s
    marginal = [0.0] * n
    out = [(1.0, 1.0)] * n  # what the parent tells the node
    for k in range(n):
        if k:
            q = parent[k]
            m0, m1 = up[k]
            r0, r1 = b0[q] * out[q][0] / m0, b1[q] * out[q][1] / m1
            (p00, p01), (p10, p11) = psi[kinds[k]]
            d0, d1 = r0 * p00 + r1 * p10, r0 * p01 + r1 * p11
            s = d0 + d1
            out[k] = (d0 / s, d1 / s)
        x0, x1 = b0[k] * out[k][0], b1[k] * out[k][1]
        marginal[k] = x1 / (x0 + x1)
    return [up, out, b0, b1, kinds], marginal


def _potentials(pairs: np.ndarray) -> list:
    return [((math.exp(a), math.exp(b)), (math.exp(c), math.exp(d))) for (a, b), (c, d) in pairs.tolist()]


def marginals(tree: Tree, model: Model) -> list[float]:
    get = model.weights.get
    odds = [sum(get(f, 0.0) for f in fs) for fs in node_features(tree)]
    return _messages(tree, odds, _potentials(model.pairs))[1]


def _labels(tree: Tree) -> list[int]:
    """Of a labelled page: a text is content if a pilcrow opens it (which is taken off), an element if most of its text is."""
    n = len(tree.parent)
    own = [t.startswith(MARK) for t in tree.text]
    tree.text[:] = [t.lstrip(MARK) for t in tree.text]
    size, good = [len(t) for t in tree.text], [len(t) * o for t, o in zip(tree.text, own, strict=True)]
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        good[tree.parent[k]] += good[k]
    return [int(own[k] if tree.tag[k] == "text" else 2 * good[k] > size[k]) for k in range(n)]


@functools.lru_cache(maxsize=4)
def fit(pages: tuple[str, ...] | None = None, steps: int = 70, ridge: float = 0.004) -> Model:
    """Weights and potentials from labelled pages (the built-in ones by default), by Adam on the penalised likelihood."""
    trees = [parse(p) for p in (pages or labelled_pages())]
    labels = [_labels(t) for t in trees]
    feats = [node_features(t) for t in trees]
    names = sorted({f for fs in feats for f in (x for own in fs for x in own)})
    index = {f: k for k, f in enumerate(names)}
    rows = [[[index[f] for f in own] for own in fs] for fs in feats]
    n = len(names)
    theta = np.zeros(n + 4 * len(_KINDS))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = -ridge * theta
        w, pairs = theta[:n].tolist(), theta[n:].reshape(-1, 2, 2)
        psi = _potentials(pairs)
        for tree, y, fs in zip(trees, labels, rows, strict=True):
            (up, out, b0, b1, kinds), p = _messages(tree, [sum(w[f] for f in own) for own in fs], psi)
            for k, own in enumerate(fs):
                d = y[k] - p[k]
                for f in own:
                    grad[f] += d
                if k:
                    q = tree.parent[k]
                    r = (b0[q] * out[q][0] / up[k][0], b1[q] * out[q][1] / up[k][1])
                    joint = [[r[a] * psi[kinds[k]][a][b] * (b0[k], b1[k])[b] for b in (0, 1)] for a in (0, 1)]
                    total = sum(map(sum, joint))
                    at = n + 4 * kinds[k]
                    for a in (0, 1):
                        for b in (0, 1):
                            grad[at + 2 * a + b] += (y[q] == a and y[k] == b) - joint[a][b] / total
        m, v = .9 * m + .1 * grad, .99 * v + .01 * grad ** 2
        theta = theta + .15 * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .99 ** step)) + 1e-8)
    return Model(dict(zip(names, theta[:n].tolist(), strict=True)), theta[n:].reshape(-1, 2, 2))


def main_text(page: str | None, model: Model) -> str:
    """The content blocks of a page, joined by two line feeds; empty for a null or empty page."""
    if not page:
        return ""
    tree = parse(page)
    p = marginals(tree, model)
    return "\n\n".join(t for t, tag, x in zip(tree.text, tree.tag, p, strict=True) if tag == "text" and x >= 0.5)


def _extract(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            text = [main_text(x, model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())],
                                             names=["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url and text of every row; one row in, one row out, whatever is null, repeated or broken. Other columns are ignored."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(spark.sparkContext.broadcast(model or fit())), "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
