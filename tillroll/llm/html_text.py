"""Main text of web pages (operator 12): tag-path ratios.

A page is read once into *blocks*: runs of text between the starts and ends of
block elements.  Each block has a root-to-leaf path (tags with their classes).
Lengths, punctuation and link text are summed up for each path; a path's ratios
are its characters and its punctuation marks a block.  The ratios are

1. laid out in page order and smoothed with the neighbours' (a heading between
   paragraphs is lifted by them),
2. averaged for each path again, and fused: length and punctuation, less the
   share of link text,
3. compared with the best path of the page: paths of at least a given share of
   its value are content, with all their blocks.

What can't be content has no weight in this: elements for menus, headers,
footers, sidebars, forms, scripts and styles; elements whose class, identifier
or role says so (``ROLES`` below); hidden ones; and, where the page marks its
article, what lies outside of it.  Inside a marked article the share is low
(only link lists fall below it), elsewhere high.

Defined cases: a null page counts as empty; an empty one, and one without
content, has an empty text; markup may be cut off, unclosed or wrongly nested;
character references are decoded as browsers do, with or without semicolon;
white space (as Unicode has it, line breaks of ``<br>`` included) is one space;
pages of any length are read whole; repeated rows give repeated results; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, size_chunks

#: Elements that break a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that hold no article text.
OTHER = frozenset("applet aside audio button canvas datalist footer form head math menu nav noscript object select svg template video".split())
#: What a start tag ends, and the elements that such an end doesn't reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Words of classes, identifiers and roles that name something other than the article.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus "
    "dialog footer form hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words of classes, identifiers and roles that name the article.
ARTICLE = frozenset("article articlebody content entry main post story".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
MARKS = re.compile(r"[^\w\s]")
#: Least share of the best path's value: in a marked article, and elsewhere.
MARKED_SHARE, PLAIN_SHARE = 0.08, 0.4
#: Weights of a block's neighbours, near to far, in smoothing; and of length and punctuation in fusion.
KERNEL, FUSION = (0.4, 0.24, 0.06), (0.7, 0.3)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


def _described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's step in a path; whether it can't hold article text; whether it marks the article."""
    if not attributes.strip(" /"):
        return tag, tag in OTHER, tag in ("article", "main")
    a = _attributes(attributes)
    named = " ".join(a.get(k, "") for k in ("class", "id", "role"))
    words = {w.lower() for w in NAME.findall(named)}
    if tag in ("html", "body"):  # their classes describe the page
        return tag, False, False
    unseen = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    other = tag in OTHER or unseen or bool(words & ROLES)
    marks = not other and (tag in ("article", "main") or bool(words & ARTICLE) or a.get("itemprop") == "articleBody")
    return ".".join([tag, *a.get("class", "").split()]), other, marks


class Page:
    """The blocks of a page, in its order."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.paths: list[int] = []
        self.links: list[int] = []
        self.marked: list[bool] = []
        self._steps: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, no article text, in a marked article, in a link
        self._open: dict[str, int] = {}
        self._held: list[str] = []
        self._linked = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in RAW:
                    over = re.compile(f"</{tag}(?=[\\s/>])|\\Z", re.IGNORECASE).search(source, at)
                    at = over.start()
        self._text(source[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if text and not (self._stack and self._stack[-1][2]):
            text = html.unescape(text) if "&" in text else text
            self._held.append(text)
            if self._stack and self._stack[-1][4]:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                top = self._stack[-1] if self._stack else ("", -1, False, False, False)
                self.texts.append(text)
                self.paths.append(top[1])
                self.links.append(min(self._linked, len(text)))
                self.marked.append(top[3])
            self._held.clear()
        self._linked = 0

    def _pop(self, to: int) -> None:
        self._flush()
        for entry in self._stack[to:]:
            self._open[entry[0]] -= 1
        del self._stack[to:]

    def _find(self, tags, beyond) -> int:
        """The place of the uppermost of ``tags`` on the stack, unless one of ``beyond`` is above it; else -1."""
        if any(self._open.get(t) for t in tags):
            for i in range(len(self._stack) - 1, -1, -1):
                tag = self._stack[i][0]
                if tag in tags:
                    return i
                if tag in beyond:
                    break
        return -1

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if (p := self._find({"p"}, BLOCKS - {"p"})) >= 0:
                self._pop(p)
            if tag in ENDS and (i := self._find(*ENDS[tag])) >= 0:
                self._pop(i)
        if tag == "body" and (i := self._find({"head"}, ())) >= 0:
            self._pop(i)
        if tag == "br":
            self._held.append(" ")
        if tag in VOID:
            return
        step, other, marks = _described(tag, attributes)
        _, path, was_other, marked, link = self._stack[-1] if self._stack else ("", -1, False, False, False)
        if not marked and re.search(r"\bheader\b", step):  # an article's own has its headings
            other = True
        if block:
            path = self._steps.setdefault((path, step), len(self._steps))
        self._stack.append((tag, path, was_other or other, marked or marks, link or tag == "a"))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if (i := self._find({tag}, () if tag in BLOCKS or tag in RAW or tag in OTHER else BLOCKS)) >= 0:
            if tag in BLOCKS:
                self._pop(i)
            else:  # text of the same block goes on
                for entry in self._stack[i:]:
                    self._open[entry[0]] -= 1
                del self._stack[i:]


def smoothed(values: np.ndarray) -> np.ndarray:
    """Each value with its neighbours', weighted by ``KERNEL``; beyond an end there is nothing."""
    total, weight = KERNEL[0] * values, np.full(len(values), KERNEL[0])
    for d, k in enumerate(KERNEL[1:], 1):
        total[d:] += k * values[:-d]
        total[:-d] += k * values[d:]
        weight[d:] += k
        weight[:-d] += k
    return total / weight


def path_values(paths: np.ndarray, chars: np.ndarray, marks: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each path, and the path's number of each block."""
    which, own = np.unique(paths, return_inverse=True)
    blocks = np.bincount(own, minlength=len(which))
    mean = lambda x: np.bincount(own, x, minlength=len(which)) / blocks
    fused = np.zeros(len(which))
    for share, ratio in zip(FUSION, (mean(chars), mean(marks)), strict=True):
        value = mean(smoothed(np.log1p(ratio)[own]))
        fused += share * value / max(value.max(), 1e-9)
    return fused * (1 - mean(links) / np.maximum(mean(chars), 1)), own


def main_blocks(page: Page) -> list[str]:
    """The texts of the blocks whose paths are content."""
    if not page.texts:
        return []
    is_marked = any(page.marked)
    inside = np.array(page.marked, dtype=bool) | (not is_marked)
    texts = [t for t, i in zip(page.texts, inside, strict=True) if i]
    chars, links = np.array([len(t) for t in texts], dtype=float), np.array(page.links, dtype=float)[inside]
    marks = np.array([len(MARKS.findall(t)) for t in texts], dtype=float)
    paths = np.array(page.paths)[inside]
    if not is_marked:  # a block that is all link ends in a leaf of its own
        paths = 2 * paths + (links >= 0.9 * chars)
    value, own = path_values(paths, chars, marks, links)
    share = MARKED_SHARE if is_marked else PLAIN_SHARE
    content = (value >= share * value.max())[own]
    return [t for t, c in zip(texts, content, strict=True) if c]


def main_text(source: str) -> str:
    return "\n".join(main_blocks(Page(source)))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id long, the columns to ``keep``, text string: the main text of every page."""
    if {c.lower() for c in keep} & {"page_id", "html", "text"}:
        raise ValueError("page_id, html and text can't be kept: they are the operator's own names")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), *(F.col(f"`{c}`") for c in keep))
    schema = rows.drop("html").schema
    others = [i for i, c in enumerate(rows.columns) if c != "html"]

    def run(batches):
        for part in size_chunks(batches, "html"):
            texts = pa.array([main_text(x) for x in part.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), texts], [*(part.schema.names[i] for i in others), "text"])

    return map_arrow(rows, run, schema.add("text", "string"))
