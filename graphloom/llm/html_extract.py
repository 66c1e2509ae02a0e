"""Main-text extraction from HTML by a maximum-scoring subsequence.

A page is read once into a sequence of texts and gaps, the runs of tags between them. Words score positive, unless an element
around them is boilerplate by its tag, its attributes' words, its links and its share of the page; tags score negative. A linear
scan finds the contiguous region with the largest sum, and its texts, less those inside boilerplate, are the main text.

All weights come from labelled pages, the layouts of ``labelled_pages.txt`` filled with texts of many lengths: a logistic
regression over the features of elements tells boilerplate, and a structured perceptron learns what each tag costs, by
comparing the region that the scan finds with the labelled one.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of HTML: elements without content, whose content is no text of the page, whose content is raw text, and that stand within a line.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style title noscript template iframe noembed noframes object audio video head".split())
_RAW_TEXT = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo mrow msup msub mfrac svg text".split()
)
_PLAIN = frozenset(f"tag={name}" for name in _INLINE) | frozenset(f"tag={name}" for name in "html body div section p ul ol li dl dt dd table tbody tr td th center h1 h2 h3 h4 h5 h6 article main pre blockquote".split())
#: Start tags that end an open element of these names.
_ENDS = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",), "body": ("head",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that an end tag of something outside them does not close.
_SCOPES = frozenset("table td th article section main body".split())

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_BEFORE_VALUE = re.compile(r"=\s*\Z")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW_TEXT}


def _tag_end(html: str, at: int) -> int:
    """Where the tag that goes on at ``at`` ends: behind the first ``>`` outside a quoted value, or -1."""
    while True:
        stop = _STOP.search(html, at)
        if not stop:
            return -1
        if stop[0] == ">":
            return stop.end()
        quoted = _BEFORE_VALUE.search(html, max(at, stop.start() - 8), stop.start())
        close = html.find(stop[0], stop.end()) if quoted else -1
        at = close + 1 if close >= 0 else stop.end()


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""); linear in the page.

    Comments and declarations are left out, as is the content of raw elements other than ``textarea``. A tag that the page's end cuts off is left out too.
    """
    at, text, size = 0, 0, len(html)
    while (found := html.find("<", at)) >= 0:
        if html.startswith("<!--", found):
            end = html.find("-->", found + 4)
            end, event = end + 3 if end >= 0 else size, None
        elif html.startswith(("<!", "<?"), found):
            end = html.find(">", found)
            end, event = end + 1 if end >= 0 else size, None
        else:
            name = _NAME.match(html, found + 1)
            if not name:  # a sign, not a tag
                if found + 1 == size or html[found + 1] == "/" and ">" not in html[found : found + 3] and found + 2 == size:
                    size = found
                    break
                at = found + 1
                continue
            end = _tag_end(html, name.end())
            if end < 0:
                size = found
                break
            event = ("end", name[2].lower(), "") if name[1] else ("start", name[2].lower(), html[name.end() : end - 1])
        if found > text:
            yield "text", html[text:found], ""
        if event:
            yield event
            if event[0] == "start" and event[1] in _RAW_TEXT and not event[2].endswith("/"):
                close = _RAW_END[event[1]].search(html, end)
                if event[1] in ("textarea", "xmp"):
                    yield "text", html[end : close.start() if close else len(html)], ""
                yield "end", event[1], ""
                end = close.end() if close else len(html)
        at = text = end
    if text < size:
        yield "text", html[text:size], ""


@dataclass
class Element:
    """An element: its parent's number (-1: none), and how many words and words in links it holds."""

    name: str
    attrs: str
    parent: int
    words: int = 0
    links: int = 0


@dataclass
class Piece:
    """A text, the tags of the gap before it, each with the number of its element, and the number of the element that holds the text (-1: none)."""

    text: str
    words: int
    gap: list[tuple[str, int]]
    block: bool  # whether a new block begins with it
    element: int
    link: bool = False


def read_page(html: str) -> tuple[list[Piece], list[Element]]:
    """The shown texts and the elements of a page, in one pass whose steps do not depend on the depth."""
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # names and numbers of the open elements
    places: dict[str, list[int]] = {}  # where in the stack each name is open
    scopes: list[int] = []  # where elements of _SCOPES are, and those that do not stand within a line
    blocks: list[int] = []
    hidden = 0
    out: list[Piece] = []
    gap: list[tuple[str, int]] = []
    block, space = True, ""

    def pop_to(n: int) -> None:
        nonlocal hidden
        while len(stack) > n:
            name, number = stack.pop()
            places[name].pop()
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            hidden -= name in _HIDDEN
            e = elements[number]
            if name == "a":
                e.links = e.words
            if e.parent >= 0:
                elements[e.parent].words += e.words
                elements[e.parent].links += e.links

    for kind, value, attrs in events(html):
        if kind == "text":
            if hidden:
                continue
            text = unescape(value)
            words = len(text.split())
            if not words:
                space += text
                continue
            number = stack[-1][1] if stack else -1
            if stack:
                elements[number].words += words
            out.append(Piece(space + text, words, gap, block, number, bool(places.get("a"))))
            gap, block, space = [], False, ""
            continue
        inside = hidden
        tag, number = value, stack[-1][1] if stack else -1
        if kind == "start":
            ends = _ENDS.get(value)
            if ends:
                n = max((places[e][-1] for e in ends if places.get(e)), default=-1)
                if n >= 0 and n >= (scopes[-1] if scopes else -1):
                    pop_to(n)
            if value not in _VOID:
                elements.append(Element(value, attrs, stack[-1][1] if stack else -1))
                places.setdefault(value, []).append(len(stack))
                if value in _SCOPES:
                    scopes.append(len(stack))
                if value not in _INLINE:
                    blocks.append(len(stack))
                number = len(elements) - 1
                stack.append((value, number))
                hidden += value in _HIDDEN
        else:
            tag = "/" + value
            open_at = places.get(value)
            if open_at and not (value in _INLINE and blocks and blocks[-1] > open_at[-1]):
                number = stack[open_at[-1]][1]
                pop_to(open_at[-1])
        if not inside and not hidden:
            gap.append((tag, number))
        if value not in _INLINE and value not in _HIDDEN and not hidden:
            block, space = True, ""
    pop_to(0)
    return out, elements


@lru_cache(maxsize=50_000)
def _attribute_features(name: str, attrs: str) -> tuple[str, ...]:
    out = [f"tag={name}"]
    for key, a, b, c in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role", "itemprop"):
            out += [f"token={token}" for token in value.split()]
            for word in re.findall(r"[a-z]+", value):
                out.append(f"word={word.rstrip('s')}")
                if len(word) > 5:
                    out.append(f"start={word[:5]}")
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "aria-hidden" and value == "true":
            out.append("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


def element_features(e: Element, within: bool, page_words: int) -> tuple[str, ...]:
    """Its tag, the tokens and words of class, id, role and itemprop, whether it is hidden, its links, its share of the page, and whether an article or main is around it."""
    out = _attribute_features(e.name, e.attrs)
    more = [f"links={0 if not e.links else 1 if 2 * e.links < e.words else 2}"]
    if 2 * e.words > page_words:
        more.append(f"most tag={e.name}")
    if within:
        more.append(f"within tag={e.name}")
    return (*out, *more)


def _marked(features: tuple[str, ...]) -> bool:
    """Whether an element says by an attribute or by its name what it holds; what plain containers hold is for the scan to tell."""
    return any(not f.startswith(("tag=", "within ", "links=", "most ")) for f in features) or features[0] not in _PLAIN


@dataclass
class Weights:
    """Scores of element features (boilerplate if the sum with ``element_bias`` is above 0) and of a gap's tags (all below 0)."""

    element: dict[str, float] = field(default_factory=dict)
    element_bias: float = 0.0
    tag: dict[str, float] = field(default_factory=dict)
    unknown_tag: float = -0.5
    #: What a word adds outside boilerplate, in a link there, and inside boilerplate.
    word: float = 1.0
    link_word: float = 0.5
    boilerplate_word: float = -0.5

    def boilerplate(self, features: tuple[str, ...]) -> bool:
        return _marked(features) and self.element_bias + sum(self.element.get(f, 0.0) for f in features) > 0


def _within(elements: list[Element]) -> list[bool]:
    """For each element whether an article or main is around it."""
    out: list[bool] = []
    for e in elements:
        out.append(e.parent >= 0 and (out[e.parent] or elements[e.parent].name in ("article", "main")))
    return out


def boilerplate(found: list[Piece], elements: list[Element], weights: Weights) -> tuple[list[bool], list[list[str]]]:
    """For each piece whether an element around it is boilerplate, and the gap's tags, each such element in it counted as one tag "skip"."""
    total = sum(p.words for p in found)
    out, top = [], []
    for e, w in zip(elements, _within(elements), strict=True):
        above = e.parent >= 0 and out[e.parent]
        top.append(not above and e.words > 0 and weights.boilerplate(element_features(e, w, total)))
        out.append(above or top[-1])
    gaps = [[("skip" if out[n] and n >= 0 else t) for t, n in p.gap if n < 0 or not out[n] or top[n] and t[0] != "/"] for p in found]
    return [p.element >= 0 and out[p.element] for p in found], gaps


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """The slice of (gap before, text) scores with the largest sum; the gap before its first text does not count.

    One pass; of equal sums the first and longest is taken. Without a positive sum the slice is empty.
    """
    best, top, start, total = (0, 0), 0.0, 0, 0.0
    for i, (gap, text) in enumerate(scores):
        if total + gap <= 0 or i == 0:
            start, total = i, 0.0
        else:
            total += gap
        total += text
        if total > top or total == top and start == best[0]:
            best, top = (start, i + 1), total
    return best if top > 0 else (0, 0)


def _scores(found: list[Piece], out: list[bool], gaps: list[list[str]], weights: Weights) -> list[tuple[float, float]]:
    tag, other = weights.tag.get, weights.unknown_tag
    return [(sum(tag(t, other) for t in g), p.words * (weights.boilerplate_word if o else weights.link_word if p.link else weights.word)) for p, o, g in zip(found, out, gaps, strict=True)]


def extract(html: str | None, weights: Weights) -> str:
    """The main text: blocks in page order joined by a space, white space within a block turned into one space."""
    found, elements = read_page(html or "")
    out, gaps = boilerplate(found, elements, weights)
    start, end = best_region(_scores(found, out, gaps, weights))
    parts: list[str] = []
    block = False
    for p, o in zip(found[start:end], out[start:end], strict=True):
        block |= p.block
        if o:
            continue
        if block:
            parts.append(" ")
        parts.append(p.text)
        block = False
    return " ".join("".join(parts).split())


# -- labelled pages and training -------------------------------------------------------------------------------------

LAYOUTS = Path(__file__).with_name("labelled_pages.txt")
#: Pages made of each layout, and rounds of the perceptron over them, its margin in words, its step, how many times that
#: where main text is lost, and what a tag costs at least.
PAGES_EACH, ROUNDS, MARGIN, STEP, LOST, LEAST_COST = 24, 20, 1.0, 0.1, 10, -0.01


def layouts() -> list[str]:
    """The labelled layouts."""
    return [part.strip() for part in LAYOUTS.read_text().split("------")[1:] if part.strip()]


def labelled_page(layout: str, r: random.Random) -> str:
    """A page of a layout with texts of other lengths. Words of the main text begin with "c", others with "b"."""
    out, inside, above = [], 0, 0
    for part in re.split(r"(\[\[|\]\]|\{\{|\}\}|#\d+)", layout):
        if part in ("[[", "]]"):
            inside = part == "[["
        elif part in ("{{", "}}"):
            above = part == "{{"
        elif re.fullmatch(r"#\d+", part):
            n = max(1, round(int(part[1:]) * r.uniform(0.6, 1.6)))
            mark = "c" if inside and not above else "b"
            out.append(" ".join(mark + "".join(r.choice("aeilnorst") for _ in range(r.randrange(1, 8))) for _ in range(n)))
        else:
            out.append(part)
    return "".join(out)


def labelled_pages(each: int = PAGES_EACH, seed: int = 11, chosen: list[str] | None = None) -> list[str]:
    """``each`` pages of every layout (or of the chosen ones)."""
    r = random.Random(seed)
    return [labelled_page(layout, r) for _ in range(each) for layout in chosen or layouts()]


def labelled_text(page: str) -> str:
    """The main text of a labelled page."""
    return " ".join(w for k, t, _ in events(page) if k == "text" for w in t.split() if w[0] == "c")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights, the last one of a constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.append(np.full(len(w) - 1, ridge), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pull + 1e-9), x.T @ (p - y) / len(y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled_elements(found: list[Piece], elements: list[Element]) -> Iterator[tuple[tuple[str, ...], bool]]:
    """Features of elements and whether they are boilerplate: an element with main text is not, one without is if it lies right in one with, or in none."""
    held = [False] * len(elements)
    for p in found:
        e = p.element if p.text.split()[0][0] == "c" else -1
        while e >= 0 and not held[e]:
            held[e] = True
            e = elements[e].parent
    total = sum(p.words for p in found)
    for e, within, main in zip(elements, _within(elements), held, strict=True):
        features = element_features(e, within, total)
        if e.words and _marked(features) and (main or e.parent < 0 or held[e.parent]):
            yield features, not main


def train(chosen: tuple[str, ...] | None = None) -> Weights:
    """Weights from the labelled layouts (or the chosen ones); the same every time."""
    return _train(tuple(layouts()) if chosen is None else chosen)


@lru_cache(maxsize=4)
def _train(chosen: tuple[str, ...]) -> Weights:
    pages = [read_page(page) for page in labelled_pages(chosen=list(chosen))]
    counts: Counter = Counter(row for found, elements in pages for row in _labelled_elements(found, elements))
    names = sorted({f for features, _ in counts for f in features})
    at = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((sum(counts.values()), len(names))), np.empty(sum(counts.values()))
    n = 0
    for (features, label), times in sorted(counts.items()):
        x[n : n + times, [at[f] for f in features]] = 1
        y[n : n + times] = label
        n += times
    w = _logistic(x, y, 1e-4)
    weights = Weights(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))

    # What tags cost: a region that is wrong by the margin makes the tags that only it crosses dearer and those that only the labelled one crosses cheaper.
    total: Counter = Counter()
    marked = [(found, *boilerplate(found, elements, weights)) for found, elements in pages]
    weights.tag = dict.fromkeys(sorted({t for _, _, gaps in marked for g in gaps for t in g}), LEAST_COST)
    for _ in range(ROUNDS):
        for found, out, gaps in marked:
            main = [i for i, p in enumerate(found) if p.text.split()[0][0] == "c"]
            first, last = main[0], main[-1] + 1
            scores = [(g, s + (0.0 if out[i] else -MARGIN if first <= i < last else MARGIN)) for i, (g, s) in enumerate(_scores(found, out, gaps, weights))]
            start, end = best_region(scores)
            kept = [i for i in range(start, end) if not out[i]]
            if kept != [i for i in range(first, last) if not out[i]]:  # boilerplate at the edges changes nothing
                moved: Counter = Counter()
                words = links = 0
                for sign, a, b in ((1, first, last), (-1, start, end)):
                    words += sign * sum(p.words for p, o in zip(found[a:b], out[a:b], strict=True) if o)
                    links += sign * sum(p.words for p, o in zip(found[a:b], out[a:b], strict=True) if p.link and not o)
                    for g in gaps[a + 1 : b]:
                        for t in g:
                            moved[t] += sign
                step = STEP * (LOST if not kept or kept[0] > first or kept[-1] < last - 1 else 1)
                for t, change in moved.items():
                    weights.tag[t] = min(LEAST_COST, weights.tag[t] + step * max(-3, min(3, change)))
                weights.boilerplate_word = min(LEAST_COST, weights.boilerplate_word + step / 10 * max(-3, min(3, words)))
                weights.link_word = min(weights.word, weights.link_word + step / 3 * max(-3, min(3, links)))
        total.update(weights.tag)
        total[0] += weights.boilerplate_word
        total[1] += weights.link_word
    weights.boilerplate_word, weights.link_word = total.pop(0) / ROUNDS, total.pop(1) / ROUNDS
    weights.tag = {t: v / ROUNDS for t, v in total.items()}
    return weights


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of (page_id, url, html).

    Null and empty html give empty text. Cut-off and unclosed markup is read as far as it goes. Repeated rows keep a row each, an
    empty table gives an empty one, and other columns are not looked at, whatever their names. A page of any length is read in
    time linear in it, however deep its elements lie.
    """
    weights = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


#: The rows of ``extract_pages`` over pages of the given form, whose content is their only article and which use no other
#: character references there than those below, for DuckDB.
GIVEN_PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(replace(regexp_replace(inner_html, '</?(p|h1|br)>', ' ', 'g'), '<b>', ''), '&quot;?', '"', 'g') AS t FROM a
), c AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
