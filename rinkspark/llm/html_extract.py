"""Main text of HTML pages by tag-path ratios.

For each page, text and punctuation are added up per root-to-leaf tag path and
divided by the number of text blocks on it. The two ratios are smoothed over
the page's blocks in order, fused, and averaged per path; paths above a share
of the page's mean are content paths. The article is the smallest container
around almost all content blocks: everything in it that no markup declares to
be something else (menu, header, footer, sidebar, notice, advert, form, script,
style, reader comments) is kept, short blocks too, and so are blocks on content
paths outside it. Words of a class or id, and form elements, are believed only
while the paths agree: one that declares most of the page's content away (all
of an article in "widget" elements, a page in one form) is ignored on that
page, and inside an article or main element labels that also name parts of
articles ("section-header", "share-price", "form-row", but not "share") drop only
blocks whose paths are below the threshold, and no headings. A header inside an article is
its title.

Pages are worked on one by one inside tasks (no shuffle); memory is bounded by
a few MB of pages or one longer page.

Defined results: null or empty html gives the empty text; a page without text
outside boilerplate too. Unclosed and stray tags follow the usual rules (a
block tag closes an open paragraph, an end tag closes what is open inside); a
tag cut off at the end of the page is dropped; below 512 open elements, tags
nest no deeper. Repeated rows are extracted
each. Other columns pass through, clashing added names get an underscore.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Tags that end an open paragraph when they begin.
_ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
#: begin tag -> (open tags it ends, tags beyond which it does not look)
_ENDS_OPEN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_SCOPE = frozenset("table td th caption object button body html".split())
_SPACED = frozenset("br td th img input select button".split())

#: Elements that are never part of the article.
NOT_CONTENT_TAGS = frozenset("nav header footer aside head menu button select option object svg canvas audio video dialog input".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that declare an element to be something else.
NOT_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments commentlist disqus reply replies share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay widget "
    "toolbar pagination pager form".split()
)
#: Of these, names of text of its own kind, whatever its share of the page.
OWN_TEXT_WORDS = frozenset("comment comments commentlist disqus reply replies cookie cookies consent gdpr sidebar aside footer".split())
#: Of the words, those that name parts of articles, too.
PART_WORDS = frozenset("header banner notice notices share sharing social related widget form pager toolbar overlay reply replies".split())
_ARTICLES = frozenset(["article", "main"])
_FORM = "<form>"
#: Beside the words of a label that holds no others ("share", "form-widget").
_PURE = "<pure>"
_HARD = frozenset(["!"])
_LAYOUT = frozenset("has with no without".split())
_WHOLE = frozenset("html body main article".split())
_CONTAINERS = frozenset("article main section div td body html blockquote center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：¿¡]")

#: Share of the page's mean fused ratio from which a path is content.
THRESHOLD = 0.5
#: Share of the page's text from which a word that declares it to be something
#: else is not believed, and share left by all words below which none is.
MOST = 0.5
LEFT = 0.1
#: Share of the content's text that the article's container must hold.
COVER = 0.9
#: Text a wider container may add, as a share of what it holds already.
WIDEN = 0.3
#: Open elements beyond which a begin tag opens nothing, as in browsers.
MAX_DEPTH = 512
#: Weights of a block's neighbours at distance 0, 1, 2.
_KERNEL = [exp(-d * d / 2) for d in range(3)]


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in _ATTR.finditer(raw):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declared(name: str, raw: str, ignored: frozenset[str] = frozenset()) -> frozenset[str]:
    """What in the markup says that this element is not part of an article:
    ``_HARD``, or words of its class or id (and ``_FORM``) that are not
    ignored, or nothing."""
    if name in NOT_CONTENT_TAGS:
        return _HARD
    found, pure = {_FORM} if name == "form" else set(), False
    if raw and not raw.isspace():
        attrs = _attributes(raw)
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
            return _HARD
        role = attrs.get("role", "").lower()
        if role in NOT_CONTENT_ROLES:
            return _HARD
        if role == "form":
            found.add(_FORM)
        if name not in _WHOLE or name == "article":
            for label in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
                words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", label).lower()))
                if not _LAYOUT & words:
                    found |= NOT_CONTENT_WORDS & words
                    pure |= bool((NOT_CONTENT_WORDS & words) - ignored) and words <= NOT_CONTENT_WORDS
    return frozenset(found - ignored | ({_PURE} if pure else set()))


class _Node:
    __slots__ = ("name", "parent", "path", "out", "soft", "size", "headings", "inside")

    def __init__(self, name: str, parent: _Node | None, out: bool, soft: frozenset[str] = frozenset()):
        self.name, self.parent, self.out = name, parent, out
        self.soft = soft  # words of the outermost element that a word declares
        self.path = name if parent is None else f"{parent.path}/{name}"
        self.inside = parent is not None and (parent.inside or parent.name in _ARTICLES)  # of an article
        self.size = 0  # characters of kept blocks inside
        self.headings = 0  # of these, in headings

    def up(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


def _blocks(html: str, ignored: frozenset[str] = frozenset()) -> list[tuple[_Node, str, frozenset[str]]]:
    """Text blocks in page order without those that are never part of an
    article, each with the block element that holds it and the words that
    declare it to be something else (none of ``ignored``)."""
    stack = [_Node("#", None, False)]
    blocks: list[tuple[_Node, str, frozenset[str]]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                node = next(n for n in reversed(stack) if n.name in BLOCK or n.name in ("#", "td", "th"))
                blocks.append((node, block, stack[-1].soft))

    def close_to(k: int) -> None:
        if any(n.name in BLOCK or n.soft and not n.parent.soft for n in stack[k:]):
            flush()
        del stack[k:]

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            if not stack[-1].out:
                text.append(html[at:])
            break
        if m.start() > at and not stack[-1].out:
            text.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0][1] in "!?" or m[0][-1] != ">":
                continue
            name, closing, attrs = _NAME.match(m[0])[1].lower(), m[0][1] == "/", ""
        else:
            name, closing, attrs = name.lower(), bool(m["close"]), m["attrs"]
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close_to(k)
                    break
            if name in _SPACED and not stack[-1].out:
                text.append(" ")
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close_to(k)
                    break
                if stack[k].name in _P_SCOPE:
                    break
        if name in _ENDS_OPEN:
            ends, limit = _ENDS_OPEN[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    close_to(k)
                    break
                if stack[k].name in limit:
                    break
        out = stack[-1].out
        title = name == "header" and (stack[-1].inside or stack[-1].name in _ARTICLES)
        declared = frozenset() if out or title else _declared(name, attrs, ignored)
        if name in BLOCK or declared:
            flush()
        elif name in _SPACED and not out:
            text.append(" ")
        if name in VOID or len(stack) >= MAX_DEPTH:
            continue
        stack.append(_Node(name, stack[-1], out or declared == _HARD, stack[-1].soft or declared))
    flush()
    return [x for x in blocks if not x[0].out]


def path_scores(paths: Sequence[str], texts: Sequence[str]) -> dict[str, float]:
    """Fused, smoothed ratio of each tag path of a page."""
    length: dict[str, float] = defaultdict(float)
    marks: dict[str, float] = defaultdict(float)
    count: dict[str, int] = defaultdict(int)
    for path, text in zip(paths, texts, strict=True):
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
    ratio = [(length[p] / count[p], marks[p] / count[p]) for p in paths]
    n = len(paths)
    score: dict[str, float] = defaultdict(float)
    for i, path in enumerate(paths):
        near = [(j, _KERNEL[abs(i - j)]) for j in range(max(0, i - 2), min(n, i + 3))]
        weight = sum(w for _, w in near)
        smooth_length = sum(w * ratio[j][0] for j, w in near) / weight
        smooth_marks = sum(w * ratio[j][1] for j, w in near) / weight
        score[path] += smooth_length * (1 + smooth_marks) / count[path]
    return score


def _on_content_paths(blocks: Sequence[tuple[_Node, str]]) -> list[bool]:
    paths, texts = [n.path for n, _ in blocks], [t for _, t in blocks]
    score = path_scores(paths, texts)
    mean = sum(score[p] * len(t) for p, t in zip(paths, texts, strict=True)) / sum(map(len, texts))
    return [score[p] >= THRESHOLD * mean for p in paths]


def _misnomers(blocks: Sequence[tuple[_Node, str, frozenset[str]]]) -> frozenset[str]:
    """A word that declares most of the page's text, on content paths, to be
    something else says nothing about this page; nor does any word if nearly
    no text is left."""
    if not any(words for _, _, words in blocks):
        return frozenset()
    total, left, share = 0, 0, defaultdict(int)
    for (_, text, words), content in zip(blocks, _on_content_paths([(n, t) for n, t, _ in blocks]), strict=True):
        total += len(text)
        left += len(text) * (not words)
        for w in words - {_PURE}:
            share[w] += len(text) * content
    word = max(share, key=lambda w: (w not in OWN_TEXT_WORDS and share[w] >= MOST * total, share[w], w), default=None)
    if word is not None and (left < LEFT * total or word not in OWN_TEXT_WORDS and share[word] >= MOST * total):
        return frozenset([word])
    return frozenset()


def _judged_paths(blocks: Sequence[tuple[_Node, str, frozenset[str]]]) -> list[bool]:
    """Whether a block is on a content path of all blocks, declared or not;
    worked out only where a declared block asks for it."""
    if not any(words and n.inside for n, _, words in blocks):
        return [False] * len(blocks)
    return _on_content_paths([(n, t) for n, t, _ in blocks])


def _part_of_article(node: _Node, words: frozenset[str], content: bool) -> bool:
    """Whether a declared block inside an article is a part of it all the same."""
    return bool(words) and node.inside and words <= PART_WORDS and (content or any(n.name in _HEADINGS for n in node.up()))


def main_blocks(html: str) -> list[str]:
    """The article's blocks in page order."""
    ignored: frozenset[str] = frozenset()
    judged = _blocks(html)
    while more := _misnomers(judged):
        ignored |= more
        judged = _blocks(html, ignored)
    judged = [(n, t, frozenset() if _part_of_article(n, words, c) else words) for (n, t, words), c in zip(judged, _judged_paths(judged), strict=True)]
    blocks = [(n, t) for n, t, words in judged if not words]
    if not blocks:
        return []
    on_path = _on_content_paths(blocks)
    content = [(n, len(t)) for (n, t), c in zip(blocks, on_path, strict=True) if c]
    for node, text in blocks:
        heading = any(n.name in _HEADINGS for n in node.up())
        for n in node.up():
            n.size += len(text)
            n.headings += len(text) * heading
    held: dict[int, int] = defaultdict(int)
    nodes: dict[int, _Node] = {}
    for node, size in content:
        for n in node.up():
            held[id(n)] += size
            nodes[id(n)] = n
    need = COVER * sum(size for _, size in content)
    best = max((n for k, n in nodes.items() if held[k] >= need), key=lambda n: n.path.count("/"))
    whole = next((n for n in best.up() if n.name == "article"), None) or next((n for n in best.up() if n.name == "main"), None)
    if whole is None:
        whole = next(n for n in best.up() if n.name in _CONTAINERS or n.parent is None)
        while (up := whole.parent) is not None:
            added, titles = up.size - whole.size, up.headings - whole.headings
            if up.name not in ("body", "html", "#") and added <= WIDEN * whole.size or added == titles:
                whole = up
            else:
                break
    return [t for (n, t), c in zip(blocks, on_path, strict=True) if c or any(x is whole for x in n.up())]


def with_main_text(pages: DataFrame, html_col: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """The pages with ``text`` (blocks joined by an empty line), of the other
    columns only those of ``keep`` if it is given."""

    def make() -> Callable[[pa.Array], Sequence[pa.Array]]:
        return lambda html: [pa.array(["\n\n".join(main_blocks(h)) for h in html.to_pylist()], pa.string())]

    kept = pages if keep is None else pages.select(*[pages[c] for c in keep])
    return map_texts(pages, html_col, make, T.StructType([T.StructField(free_name(kept, "text"), T.StringType())]), keep)


def extracted(pages: DataFrame) -> DataFrame:
    out = with_main_text(pages, "html", ["page_id", "url"])
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
