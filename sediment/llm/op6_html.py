"""Main text of web pages as a maximum-scoring subsequence of their words and tags.

A page becomes a sequence of words (positive) and tags (negative); a linear scan finds the contiguous region of the greatest
sum, whose words are the text. Weights are learned on labelled pages: pages that mark their article, in which what stands in
containers named after menus, adverts, comments and the like counts as outside. Two kinds of weights are log-odds of such
counts: that of the evidence a container bears (its element and the words of its class, id and role), and that of a tag given
the container it stands in. Evidence adds up from the page's root down: words in a container of negative sum score nothing
and are no text of the region, and its tags are dear, so that the region ends there rather than run on.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table, text_column

#: Labelled pages that weights are counted on at most (drawn by hash), and keys that are kept.
MAX_PAGES, MAX_KEYS = 4000, 4000
#: Bounds of a tag's weight; of the weight of a container's evidence (of one name, and of all down from the root).
LOWEST, HIGHEST = -3.0, -0.01
EVIDENCE, SUM = 2.5, 3.0
#: Words that the fixed names count for before any page is read.
PRIOR = 50

# Elements by kind, and words in classes, ids and roles that name what is the article and what isn't.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = set("head button select svg canvas object audio video map script style noscript template textarea title iframe xmp dialog form".split())
OUTSIDE = set("nav footer aside menu".split())
MARKS = {"article", "main"}
#: Elements that an open paragraph outside of them is not ended from.
APART = ("table", "td", "th", "caption", "button", "object", "template")
HEADINGS, CODE = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"pre", "code", "samp", "kbd"}
HINTS = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo".split())
CONTENT = set("article body content entry main post story text".split())
NEGATORS = {"no", "not", "has", "with", "without", "hide", "hidden", "hides", "off"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"(?<![\w.:\-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def evidence(name: str, attributes: str) -> list[tuple[str, float]]:
    """What an element says of itself, as (key, share): its own name if it is a section's, whole classes and roles, and by
    half the words of ids and of compound classes (none where a compound denies, as in no-sidebar or has-comments)."""
    out = {name: 1.0} if name in OUTSIDE or name in MARKS or name in ("header", "section", "div", "table") else {}
    if attributes:
        for m in _NAMED.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").split():
                words = [w.lower() for w in _SPLIT.split(token) if w]
                if len(words) == 1 and m[1].lower() != "id":
                    out[f".{words[0]}"] = 1.0
                elif words and NEGATORS.isdisjoint(words):
                    for w in words:
                        out.setdefault(f".{w}", 0.5)
    return list(out.items())


def _prior(key: str) -> tuple[float, float]:
    """Words inside and outside that a key counts for by its fixed meaning."""
    if key in MARKS or key[1:] in CONTENT:
        return PRIOR, 0.0
    if key in OUTSIDE or key[1:] in HINTS:
        return 0.0, PRIOR
    return (PRIOR / 10, PRIOR / 2) if key == "header" else (0.0, 0.0)


def evidence_weight(key: str, counts: dict[str, list[float]]) -> float:
    """Log-odds of the key's words; an element that says nothing by itself (div, section, table) has none."""
    if key in ("div", "section", "table"):
        return 0.0
    inside, outside = counts.get(key, (0.0, 0.0))
    a, b = _prior(key)
    if a or b or inside + outside >= PRIOR:
        most = EVIDENCE if key not in MARKS and key[1:] not in CONTENT else EVIDENCE - 0.5
        return max(-EVIDENCE, min(most, math.log((inside + a + 1) / (outside + b + 1))))
    return 0.0


class Weights:
    """Learned weights: of evidence by key, and of tags by "name|state". A pair that wasn't seen weighs as its state does or,
    where nothing speaks for or against content, half as much as its name."""

    def __init__(self, evidence_counts: dict[str, list[float]], tag_counts: dict[str, list[float]]) -> None:
        self.counts, self.known = evidence_counts, {}
        sums: dict[str, list[float]] = {}
        for key, (inside, outside) in tag_counts.items():
            name, state = key.split("|")
            for of in (name, f"|{state}"):
                total = sums.setdefault(of, [0.0, 0.0])
                total[0] += inside
                total[1] += outside
        self.tags = {k: max(LOWEST, min(HIGHEST, math.log((a + 0.5) / (b + 0.5)))) for k, (a, b) in {**sums, **tag_counts}.items()}

    def evidence(self, key: str) -> float:
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = evidence_weight(key, self.counts)
        return got

    def tag(self, name: str, state: str) -> float:
        got = self.tags.get(f"{name}|{state}")
        if got is None:
            got = self.tags.get(f"|{state}", HIGHEST) if state else min(HIGHEST, self.tags.get(name, 0.0) / 2)
        return got


#: What is known without any page: the fixed names only.
UNTAUGHT = Weights({}, {})


class _Open:
    """An open element: the evidence down to it, whether anything above speaks for content, whether it is code, and the keys
    nearest to it."""

    __slots__ = ("code", "keys", "marked", "name", "never", "spoken", "sum")

    def __init__(self, name: str, total: float, spoken: bool, marked: bool, never: bool, code: bool, keys: list[tuple[str, float]]) -> None:
        self.name, self.sum, self.spoken, self.marked, self.never, self.code, self.keys = name, total, spoken, marked, never, code, keys


class _Stack:
    """Open elements, and where those of each name stand: closing a name that isn't open, or one far up, costs no search."""

    def __init__(self, root: _Open) -> None:
        self.items, self.places = [root], {}

    def push(self, e: _Open) -> None:
        self.places.setdefault(e.name, []).append(len(self.items))
        self.items.append(e)

    def last(self, name: str) -> int:
        """The depth of the nearest element of that name; 0 if there is none."""
        at = self.places.get(name)
        return at[-1] if at else 0

    def cut(self, depth: int) -> None:
        while len(self.items) > depth:
            self.places[self.items.pop().name].pop()


def events(page: str, weights: Weights) -> Iterator[tuple[str, str, _Open]]:
    """(kind, value, element) in page order; kind is text, open or close, value the text or the tag's name, element the one
    that it stands in (a tag: the element itself).

    Unclosed elements end with their parent; a text that no tag ends, as of a page cut short, counts as it stands.
    """
    stack = _Stack(_Open("", 0.0, False, False, False, False, []))
    items = stack.items
    at = 0
    while at <= len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            if text:
                yield "text", text, items[-1]
        if m is None:
            return
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = stack.last(name)
            yield "close", name, items[depth or -1]
            if depth:
                stack.cut(depth)
            continue
        while items[-1].name in _CLOSES.get(name, ()):
            stack.cut(len(items) - 1)
        if name == "p" or (name in BLOCKS and name not in VOID):  # a block ends an open paragraph and what is open in it
            near = stack.last("p")
            if near and all(stack.last(x) < near for x in APART):
                stack.cut(near)
        top = items[-1]
        if name in MARKS and top.sum < 0 and not top.never and (name == "main" or stack.last("nav")):
            for e in items:  # an article doesn't lie in a menu: that is one that was never closed
                e.sum = max(e.sum, 0.0)
        total, keys = top.sum, []
        if name in ("html", "body") or name in HEADINGS or name in CODE or top.code:
            keys = []
        elif m[3] or name in OUTSIDE or name in MARKS or name == "header":
            keys = evidence(name, m[3])
            own = sum(share * weights.evidence(k) for k, share in keys)
            total = max(-SUM, min(SUM, total + max(-EVIDENCE, min(EVIDENCE, own))))
        never = top.never or name in NEVER
        made = _Open(name, -SUM if never else total, top.spoken or (total > 0 and not never), top.marked or name in MARKS, never, top.code or name in CODE, keys or top.keys)
        yield "open", name, made
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, made
            continue
        if name == "svg" and m[3].rstrip().endswith("/"):
            continue
        stack.push(made)


def _state(e: _Open) -> str:
    return "in" if e.spoken else "out" if e.sum < 0 else ""


def counted(page: str) -> tuple[Counter, Counter]:
    """(evidence key, inside) -> words and (tag key, inside) -> tags of a page that marks its article; others teach nothing.

    Words are inside if the article holds them and no fixed name speaks against it; an article's tags all are.
    """
    words, tags, any_inside = Counter(), Counter(), False
    for kind, value, e in events(page, UNTAUGHT):
        if kind == "text":
            n = len(value.split())
            inside = e.marked and e.sum >= 0
            any_inside |= inside and n > 0
            for key, _ in e.keys if n and not e.never else ():
                words[key, inside] += n
        elif value not in MARKS:
            tags[f"{value}|{_state(e)}", e.marked] += 1
    return (words, tags) if any_inside else (Counter(), Counter())


def learn_weights(pages: DataFrame, html: str = "html", max_pages: int = MAX_PAGES) -> Weights:
    """Weights from at most about `max_pages` labelled pages. The driver gets at most MAX_KEYS counts of either kind."""
    small_batches(pages.sparkSession)
    n = pages.count()
    share = min(1.0, max_pages / max(1, n))
    drawn = pages.select(F.coalesce(F.col(html), F.lit("")).alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for b in batches:
            for t in text_column(b, "html").to_pylist():
                for total, own in zip(totals, counted(t), strict=True):
                    total.update(own)
        for kind, total in enumerate(totals):
            keys = list(total)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(keys), pa.int32()), "key": pa.array([k for k, _ in keys], pa.string()), "inside": pa.array([total[k] if k[1] else 0 for k in keys], pa.int64()), "outside": pa.array([0 if k[1] else total[k] for k in keys], pa.int64())})

    sums = drawn.mapInArrow(run, "kind int, key string, inside long, outside long").groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    counts: tuple[dict, dict] = ({}, {})
    for kind in (0, 1):
        for r in sums.filter(F.col("kind") == kind).orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(MAX_KEYS).collect():
            counts[kind][r["key"]] = [r["inside"], r["outside"]]
    return Weights(*counts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run of the greatest positive sum (the leftmost at a tie; empty if there is none)."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region: blocks in page order, one per line."""
    seq = list(events(page, weights))
    scores = [(float(len(value.split())) if e.sum >= 0 else 0.0) if kind == "text" else weights.tag(value, _state(e)) for kind, value, e in seq]
    first, end = best_region(scores)
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, e in seq[first:end]:
        if kind == "text":
            if e.sum >= 0:
                now.append(value)
        elif value in BLOCKS:
            close()
    close()
    return "\n".join(blocks)


def extract_text(pages: DataFrame, weights: Weights, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page. Null and empty pages, and pages without words outside menus and the like, give
    an empty text; a page of any length is read whole, and one that is malformed as far as it can be read. Repeated rows each
    give a row, equal pages equal texts. Other columns don't matter, whatever their names. An empty table gives no rows."""
    small_batches(pages.sparkSession)
    lean = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t, weights) for t in text_column(b, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return lean.mapInArrow(run, f"page_id {lean.schema['page_id'].dataType.simpleString()}, url string, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    out = extract_text(pages, learn_weights(pages))
    return out.withColumn("n_chars", F.length("text").cast("long"))
