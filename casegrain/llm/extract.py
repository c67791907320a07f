"""Main text of web pages by a tree-structured graphical model over the page's blocks.

Every block element and every run of text between block borders is a node that is content or not. Potentials tie a node's
label to its features and to its parent's label; they are relative frequencies on labelled pages. Sum-product messages, first
from the leaves to the root and then back, give each run's exact probability of being content.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.llm.common import query, table, text_batches, with_columns
from casegrain.llm.labelled_pages import LABELLED

#: Pages of the table that the model is trained on besides the fixed ones, at most, chosen by a hash of the page.
FIT_PAGES = 300

# HTML elements by what they are, and the words that name parts of pages.
GROUPS = {name: group for group, names in {
    "page": "html body", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form fieldset button select option optgroup datalist label legend input dialog", "article": "article", "main": "main",
    "section": "section", "div": "div center details summary", "list": "ul ol dl dir", "item": "li dt dd", "p": "p",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "quote": "blockquote pre figure figcaption address hr",
    "table": "table thead tbody tfoot tr td th caption"}.items() for name in names.split()}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio", "xmp", "noframes"}
VOID = {"input", "hr", "br", "img", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param"}
PARTS = {word: part for part, words in {
    "menu": "nav navigation navbar menu breadcrumb crumb toc pagination pager tab skip", "top": "header masthead banner topbar",
    "bottom": "footer copyright colophon legal", "side": "sidebar aside widget rail related recommended recommendation trending popular more",
    "notice": "cookie consent gdpr notice alert modal popup overlay toast paywall warning",
    "advert": "ad advert advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola affiliate",
    "comment": "comment disqus discussion reply respond reader feedback", "form": "form search login signin signup subscribe subscription newsletter",
    "share": "share sharing social follow", "content": "content article main post entry story body text prose"}.items() for word in words.split()}
PART_OF_GROUP = {"nav": "menu", "footer": "bottom", "aside": "side", "form": "form", "article": "content", "main": "content"}
FIRST_PARTS = ("comment", "advert", "notice", "form", "share", "menu", "bottom", "side", "top", "content")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LABEL = re.compile(r'data-label="([01])"')
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "main", "aside", "nav", "blockquote"}


@dataclass
class Page:
    """Nodes in page order, parents first: parent, group ("text" for runs), features; of runs the text."""

    parent: list[int] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)


def part_of(group: str, attributes: str) -> str:
    """Which part of a page an element is by its class, id and role, else by its name, or "none"."""
    if _HIDDEN.search(attributes):
        return "notice"
    found = set()
    for m in _NAMES.finditer(attributes):
        for word in _WORD.findall(m[1] or m[2] or m[3] or ""):
            word = word.lower()
            part = PARTS.get(word) or PARTS.get(word[:-1] if word.endswith("s") else word)
            if part:
                found.add(part)
    return next((p for p in FIRST_PARTS if p in found), PART_OF_GROUP.get(group, "none"))


def parse(source: str) -> Page:
    """Blocks and runs of text of a page; what scripts, styles, heads and comments hold is left out. Never fails: unclosed
    and stray tags are closed where the next block makes it necessary."""
    page = Page()

    def node(parent: int, group: str, features: tuple[str, ...], text: str | None, label: int | None) -> int:
        page.parent.append(parent)
        page.group.append(group)
        page.features.append(features)
        page.text.append(text)
        page.label.append(label)
        return len(page.parent) - 1

    node(-1, "page", (), None, None)
    names, nodes = ["html"], [0]
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                up = nodes[-1]
                share = linked / max(1, sum(map(len, pieces)))
                size = len(text)
                node(up, "text", ("size:" + ("0" if size < 25 else "1" if size < 80 else "2" if size < 250 else "3"),
                                  "links:" + ("0" if share < 0.2 else "1" if share < 0.7 else "2")), text, page.label[up])
            pieces, linked = [], 0

    def close(depth: int) -> None:
        flush()
        del names[depth:], nodes[depth:]

    at, end, skip = 0, len(source), ""
    while at < end:
        if skip:
            m = re.compile(rf"</{re.escape(skip)}(?=[\s>/])[^>]*>", re.I).search(source, at)
            at, skip = (m.end() if m else end), ""
            continue
        m = _TOKEN.search(source, at)
        if m is None or m.start() > at:
            stop = m.start() if m else end
            pieces.append(source[at:stop])
            if in_link:
                linked += stop - at
            if m is None:
                break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in ("html", "body", "head"):
            flush()
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                skip = name
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            pieces.append(" ")
        group = GROUPS.get(name)
        if group is None:
            continue
        if closing:
            if name in names[1:]:
                close(len(names) - 1 - names[::-1].index(name))
            else:
                flush()
            in_link = False
            continue
        flush()
        if "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        for depth in range(len(names) - 1, 0, -1):
            if names[depth] in _CLOSES.get(name, ()):
                close(depth)
                break
            if names[depth] in _SCOPE and not (name == "tr" and names[depth] not in ("table",)):
                break
        if name in VOID:
            continue
        given = _LABEL.search(attributes)
        made = node(nodes[-1], group, (f"part:{part_of(group, attributes)}",), None,
                    int(given[1]) if given else page.label[nodes[-1]])
        names.append(name)
        nodes.append(made)
    flush()
    return page


def settled(page: Page) -> Page:
    """The page with labels for all nodes: runs without one are not content, elements have that of most of their text."""
    n = len(page.parent)
    weight = [[0, 0] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            page.label[i] = page.label[i] or 0
            weight[i][page.label[i]] += len(page.text[i])
        else:
            page.label[i] = int(weight[i][1] > weight[i][0])
        if i:
            for k in (0, 1):
                weight[page.parent[i]][k] += weight[i][k]
    return page


def self_labelled(page: Page) -> Page | None:
    """A page that says by its own elements what is content: runs in an article or main element, but not in any other part
    that the page names. None if it has no such element."""
    if not {"article", "main"} & set(page.group):
        return None
    state: list[int] = []
    for i, up in enumerate(page.parent):
        here = state[up] if i else 0
        if page.text[i] is None and i:
            part = page.features[i][0][5:]
            if page.group[i] in ("nav", "aside", "footer", "form") or part not in ("none", "content"):
                here = -1
            elif page.group[i] in ("article", "main") and here == 0:
                here = 1
        state.append(here)
        page.label[i] = int(here == 1)
    return settled(page)


@dataclass
class Model:
    """Potentials: ``emit``, a feature's probability by label, and ``step``, by the groups of parent and child, the child's
    probability of label 1 by the parent's label; ``usual`` where such a pair was never seen. The root has ``prior``."""

    emit: dict[str, tuple[float, float]]
    step: dict[tuple[str, str], tuple[float, float]]
    usual: tuple[float, float]
    prior: float

    def marginals(self, page: Page) -> list[float]:
        """Every node's probability of being content, by one pass of messages up and one down."""
        n = len(page.parent)
        own = []
        for features in page.features:
            a = b = 1.0
            for f in features:
                x, y = self.emit.get(f, (1.0, 1.0))
                a *= x
                b *= y
            own.append((a / (a + b), b / (a + b)))
        low, high = [o[0] for o in own], [o[1] for o in own]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        steps = [self.step.get((page.group[p], g), self.usual) for p, g in zip(page.parent, page.group)]
        for i in range(n - 1, 0, -1):
            a, b = low[i], high[i]
            from0, from1 = steps[i]
            x, y = a * (1 - from0) + b * from0, a * (1 - from1) + b * from1
            sent[i] = x, y
            p = page.parent[i]
            u, v = low[p] * x, high[p] * y
            low[p], high[p] = u / (u + v), v / (u + v)
        u, v = low[0] * (1 - self.prior), high[0] * self.prior
        belief = [(u / (u + v), v / (u + v))] * n
        for i in range(1, n):
            p, q = belief[page.parent[i]]
            x, y = sent[i]
            p, q = p / x, q / y
            from0, from1 = steps[i]
            u, v = low[i] * (p * (1 - from0) + q * (1 - from1)), high[i] * (p * from0 + q * from1)
            belief[i] = u / (u + v), v / (u + v)
        return [b[1] for b in belief]


def fit(fixed: Sequence[Page], more: Sequence[Page], smoothing: float = 0.5, share: float = 0.3) -> Model:
    """Relative frequencies on labelled pages; ``more`` pages together count ``share`` as much as the ``fixed`` ones."""
    def counted(pages: Sequence[Page]) -> tuple[Counter, Counter, int]:
        emit, step, n = Counter(), Counter(), 0
        for page in pages:
            n += len(page.parent)
            for i, up in enumerate(page.parent):
                for f in page.features[i]:
                    emit[f, page.label[i]] += 1
                if up >= 0:
                    step[page.group[up], page.group[i], page.label[up], page.label[i]] += 1
        return emit, step, n

    emit, step, n = counted(fixed)
    emit2, step2, n2 = counted(more)
    for own, other in ((emit, emit2), (step, step2)):
        for k, v in other.items():
            own[k] += v * share * n / n2
    kinds: dict[str, set[str]] = {}
    for f, _ in emit:
        kinds.setdefault(f.split(":")[0], set()).add(f)
    out = {}
    for values in kinds.values():
        totals = [sum(emit[f, k] for f in values) + smoothing * len(values) for k in (0, 1)]
        for f in values:
            out[f] = tuple((emit[f, k] + smoothing) / totals[k] for k in (0, 1))
    every = Counter()
    for (_, _, k, label), v in step.items():
        every[k, label] += v
    usual = tuple((every[k, 1] + smoothing) / (every[k, 0] + every[k, 1] + 2 * smoothing) for k in (0, 1))
    steps = {(a, b): tuple((step[a, b, k, 1] + smoothing * usual[k]) / (step[a, b, k, 0] + step[a, b, k, 1] + smoothing) for k in (0, 1))
             for a, b, _, _ in step}
    return Model(out, steps, usual, 0.5)


def train(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """A model of the fixed labelled pages and of pages of the table that label themselves, at most ``fit_pages`` of them,
    those with the smallest hash; they reach the driver."""
    name = F.xxhash64("html")
    total = pages.select(F.count("html")).first()[0]
    share = (fit_pages + 6 * fit_pages ** 0.5 + 40) / max(1, total)
    picked = (pages.where(F.col("html").isNotNull() & (F.pmod(name, F.lit(1 << 30)) / float(1 << 30) <= share))
              .select("html", name.alias("name")).orderBy("name", "html").limit(fit_pages).collect())
    own = [p for p in (self_labelled(parse(r["html"])) for r in picked) if p]
    return fit([settled(parse(source)) for source in LABELLED], own)


def main_text(source: str, model: Model) -> str:
    """The runs that are likelier content than not, one per line."""
    page = parse(source)
    return "\n".join(t for t, p in zip(page.text, model.marginals(page)) if t is not None and p > 0.5)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """All columns of ``pages`` with ``main_text``, the content of the whole html. A null html has empty text; a column of
    that name is replaced."""
    pages = pages.drop("main_text")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_batches(batches, "html"):
            yield with_columns(batch, batch.schema.names, {"main_text": pa.array([main_text(s, model) for s in sources], type=pa.string())})

    return pages.mapInArrow(read, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))


@query("op6_main_text")
def op6_main_text(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", F.col("main_text").alias("text"),
                                               F.length("main_text").cast("bigint").alias("n_chars"))
