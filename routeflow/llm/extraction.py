"""HTML extraction: the main text of a page is its best-scoring contiguous stretch.

A page becomes a sequence of words and tags. Words score positive, tags negative, by weights from labelled pages; one linear
scan finds the stretch with the greatest sum. Pages label themselves where they mark up their content (``article``,
``main``, or the role of one): what stands inside is content.

``fit`` counts on a bounded sample of labelled pages (``SAMPLE`` in expectation; at most ``KEYS`` names are kept)

- how often each tag stands inside and outside: a tag costs its log-odds of being outside, ``LOW`` at least;
- how many words kinds of elements (names, and parts of classes, ids and roles) hold inside and outside. A kind that holds
  hardly any content is an aside, besides those that HTML or the usual names mark as one. Only the outermost element apart
  from the content answers for words outside, so a list in a menu says nothing against lists.

Words of asides are left out of the text. An aside costs ``ASIDE`` at most, and nothing in labelled content, so that an advert
between two paragraphs doesn't part them. No element around the page's longest labelled content is an aside. Pages without labels are scored alike.

The text: character references decoded, white space of a block as one space, blocks joined by one space in page order;
inline tags separate nothing.

Defined cases: null or empty html, and pages without content, give an empty text; broken markup is read as browsers do (end
tags without start are ignored, a paragraph ends where the next block begins, an open comment or script goes on to the end);
very long pages are read whole, in time linear in their length; null or repeated ids and urls mean nothing here; an empty table
gives an empty result, and without any labelled page the usual names alone mark asides; other columns pass through, but
for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, slices

#: Labelled pages that the fit reads in expectation, and names that a model keeps at most.
SAMPLE, KEYS = 4000, 10_000
#: A word's score; a tag's cost at least, at most, and where no labelled page has it; an aside's cost at most.
WORD, LOW, HIGH, UNSEEN, ASIDE = 1.0, 0.01, 3.0, 0.5, 6.0
#: Words that a kind of element must hold, and the most of them that may be content, to be an aside.
EVIDENCE, CONTENT = 30, 0.1

#: Fixed values of HTML: elements without content, those whose content isn't markup, those that begin a new block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes"
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Fixed values of HTML: elements that end when one of these begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are asides by what HTML says of them; names that classes, ids and roles of asides have; names that content has.
ASIDES = set("aside audio button canvas datalist dialog footer form head menu nav object select svg template video".split())
NAMES = set("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form login menu modal nav navbar navigation newsletter notice popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe widget".split())
OWN = set("article articlebody body content entry main post story text".split())
#: Asides only where they stand outside of content.
HEADS = {"header", "masthead", "topbar"}

_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
#: Every alternative that has begun matches, at the page's end if need be, so that no text is gone through twice.
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?=[\s=/]|$)", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


class Element(NamedTuple):
    name: str
    around: int  # the element around it, -1 where there is none
    labels: tuple[str, ...]  # names in its class, id and role, as written


class Page(NamedTuple):
    """Pieces are texts and tags in page order; of a text the tag is empty, and the other way round."""

    texts: list[str]
    tags: list[str]
    inner: list[int]  # the element a piece stands in; a tag stands in its own
    elements: list[Element]


def parse(html: str) -> Page:
    texts, tags, inner, elements, path = [], [], [], [], []
    names: Counter[str] = Counter()  # of open elements

    def put(text: str, tag: str) -> None:
        texts.append(text)
        tags.append(tag)
        inner.append(path[-1] if path else -1)

    def close(name: str) -> None:
        while True:
            k = path.pop()
            names[elements[k].name] -= 1
            if elements[k].name == name:
                return

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            put(html[at : m.start()], "")
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            put("", name)
            if names[name]:
                close(name)
            continue
        if names["p"] and name in BLOCK and name != "br":
            close("p")
        for other in ENDS.get(name, ()):
            if names[other] and path and elements[path[-1]].name == other:
                close(other)
        if name in VOID:
            put("", name)
            continue
        labels = tuple(x for a in _NAMED.findall(m[4]) for v in a if v for x in v.split()) if m[4] else ()
        elements.append(Element(name, path[-1] if path else -1, labels))
        if not m[4].endswith("/") or name not in ("path", "g", "use", "svg"):
            path.append(len(elements) - 1)
            names[name] += 1
        put("", name)
    if at < len(html):
        put(html[at:], "")
    return Page(texts, tags, inner, elements)


def _parts(label: str) -> list[str]:
    return [x.lower() for x in _PARTS.findall(label)]


def keys(e: Element) -> list[str]:
    """What an element is known by: the parts of its labels, or its name where it has none."""
    return [f".{x}" for label in e.labels for x in _parts(label)] or [e.name]


def marks_content(e: Element) -> bool:
    return e.name in ("article", "main") or any(x.lower() in ("main", "article", "articlebody") for x in e.labels)


def content_of(page: Page) -> int | None:
    """The labelled element that holds the most words."""
    marked = [k for k, e in enumerate(page.elements) if marks_content(e)]
    if not marked:
        return None
    held = Counter()
    for text, k in zip(page.texts, page.inner, strict=True):
        if text and k >= 0:
            held[k] += len(text.split())
    for k in range(len(page.elements) - 1, -1, -1):  # an element opens after the one around it
        if page.elements[k].around >= 0:
            held[page.elements[k].around] += held[k]
    return max(marked, key=lambda k: (held[k], -k))


def _usual(e: Element, within: bool) -> bool:
    """Whether HTML or its names mark an element as an aside; ``within``: it stands in labelled content."""
    if e.name in ("html", "body", "article", "main") or any(_parts(x) and OWN.issuperset(_parts(x)) for x in e.labels):
        return False
    named = {x for label in e.labels for x in _parts(label)}
    return e.name in ASIDES or "hidden" in e.labels or bool(named & NAMES) or (not within and (e.name in HEADS or bool(named & HEADS)))


class Model(NamedTuple):
    costs: dict[str, float]  # of tags
    asides: frozenset[str]  # kinds of elements


def asides(page: Page, model: Model) -> tuple[list[int], list[bool]]:
    """For each element the outermost aside that it belongs to, or -1; and whether it stands in labelled content."""
    content, around = content_of(page), set()
    k = content if content is not None else -1
    while k >= 0:
        around.add(k)
        k = page.elements[k].around
    out, within = [], []
    for k, e in enumerate(page.elements):
        up = e.around
        within.append(marks_content(e) or (up >= 0 and within[up]))
        if up >= 0 and out[up] >= 0:
            out.append(out[up])
        elif k not in around and (_usual(e, within[k]) or (e.name in BLOCK and not model.asides.isdisjoint(keys(e)))):
            out.append(k)
        else:
            out.append(-1)
    return out, within


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(first, after the last) of the contiguous stretch with the greatest positive sum, the first of equals; (0, 0) without one."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scores(page: Page, model: Model, aside: list[int], within: list[bool]) -> list[float]:
    """A score for each piece: its words', or its tag's."""
    out, left = [], {}
    for text, tag, k in zip(page.texts, page.tags, page.inner, strict=True):
        worth = -model.costs.get(tag, UNSEEN) if tag else WORD * len(text.split())
        if k >= 0 and aside[k] >= 0:
            rest = left.get(aside[k], 0.0 if within[aside[k]] else ASIDE)
            cost = min(rest, abs(worth))
            left[aside[k]] = rest - cost
            worth = -cost
        out.append(worth)
    return out


def main_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    aside, within = asides(page, model)
    first, end = best_stretch(scores(page, model, aside, within))
    kept = []
    for i in range(first, end):
        if page.tags[i]:
            if page.tags[i] in BLOCK:
                kept.append("\n")
        elif page.inner[i] < 0 or aside[page.inner[i]] < 0:
            kept.append(page.texts[i])
    return " ".join(unescape("".join(kept)).split())


_PLAIN = Model({}, frozenset())


def _counts(page: Page) -> Counter[tuple[str, bool]]:
    """Tags and words (under the kinds of their elements) of a labelled page, inside and outside of its content."""
    out, content = Counter(), content_of(page)
    if content is None:
        return out
    elements, usual = page.elements, asides(page, _PLAIN)[0]
    inside, wraps = [], set()
    k = content
    while k >= 0:
        wraps.add(k)
        k = elements[k].around
    apart = []  # the outermost element that holds no content
    for k, e in enumerate(elements):
        inside.append(k == content or (e.around >= 0 and inside[e.around]))
        apart.append(-1 if k in wraps or inside[k] else apart[e.around] if e.around >= 0 and apart[e.around] >= 0 else k)
    for text, tag, k in zip(page.texts, page.tags, page.inner, strict=True):
        if k < 0:
            continue
        if tag:
            if inside[k] and usual[k] < 0 and k != content:
                out[tag, True] += 1
            elif apart[k] in (-1, k) and k != content:
                out[tag, False] += 1
        elif n := len(text.split()):
            if inside[k]:
                if usual[k] < 0:
                    while k != content:
                        for x in set(keys(elements[k])):
                            out["words " + x, True] += n
                        k = elements[k].around
            elif apart[k] >= 0:
                for x in set(keys(elements[apart[k]])):
                    out["words " + x, False] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total = Counter()
        for html in batch.column(0).to_pylist():
            total.update(_counts(parse(html)))
        names = sorted({k for k, _ in total})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([total[k, side] for k in names], pa.int64()) for side in (True, False))], names=["key", "inside", "outside"])


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Weights from about ``sample`` of the pages that label their content, drawn by a hash of the whole row."""
    labelled = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b|\b(role|itemprop)\s*=\s*[\"']?(main|article)"))
    whole = [c for c, kind in pages.dtypes if not kind.startswith("map")]
    share = min(1.0, sample / max(1, pages.count()))
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), *whole), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(html_col).alias("html"))
    found = drawn.transform(in_arrow, _counted, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = found.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(KEYS).collect()
    costs = {r["key"]: min(HIGH, max(LOW, log((r["outside"] + 1) / (r["inside"] + 1)))) for r in rows if " " not in r["key"]}
    kinds = {r["key"][6:] for r in rows if r["key"].startswith("words ") and r["outside"] >= EVIDENCE and r["inside"] <= CONTENT * (r["inside"] + r["outside"])}
    return Model(costs, frozenset(kinds))


def _extract(html_at: int, model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(h, model) for h in batch.column(html_at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([c if i != html_at else texts for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, plus ``text`` and ``n_chars``, its code points."""
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != html_col])
    names = pages.columns
    rows = pages.toDF(*[f"c{i}" for i in range(len(names))])  # names of our own can't clash
    html = rows.columns[names.index(html_col)]
    out = rows.transform(in_arrow, _extract(names.index(html_col), model), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))
    rest = [F.col(c).alias(n) for c, n in zip(rows.columns, names, strict=True) if c != html]
    return out.select(*rest, F.col(html).alias("text"), F.length(html).cast("long").alias("n_chars"))
