"""Secret scans: three base patterns, and an assignment-aware lexer on top of them.

The lexer reads names and literals from source and configuration text: assignments of any common form (`name = "literal"`,
`name: literal`, `name := name2`, `"name": "literal"`, `name: type = "literal"`), with prefixed, triple-quoted and joined
strings; arguments (`set("name", "literal")`), flags (`--name literal`), XML elements and attributes, YAML blocks, and bearer
headers. Constants are carried over later assignments of their names, over concatenations and over interpolations (`{name}`,
`${name}`). A literal is scored by how sensitive the names are that it reaches and by how random it looks; the literals of a
concatenation are scored as one, too. A bare value may itself be a name (`INFO: name = "literal"`). What stands in a comment
counts like the rest: a secret that is commented out is still known.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table, text_column

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal either way, so shorter ones need no look

_QUOTED = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
_STRING = rf"(?:[rRbBuUfF$@]{{1,2}}(?=[\"'`]))?+(?:{_QUOTED})"
_TYPE = r"(?:&[ \t]*+(?:'\w++[ \t]++)?+(?:mut[ \t]++)?+)?+[A-Za-z_]\w*+(?:(?:\.|::)\w++)*+(?:[<\[][^=\"'\n;]{0,80}[>\]])?[?*]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+"
_HEAD = re.compile(rf"(?<![\w.\-])([A-Za-z_][\w.\-]*+)[\"'\]]{{0,2}}+[ \t]*+(?::[ \t]*+(?={_TYPE}[ \t]*+=(?![=>]))(?P<type>{_TYPE})[ \t]*+=|:=|=>|=|:)[ \t]*+(?:\([ \t\r\n]*+(?=[rRbBuUfF$@]{{0,2}}[\"'`]))?+", re.ASCII)
_LITERAL = re.compile(_STRING, re.ASCII | re.DOTALL)
_BARE = re.compile(r"[^\s,;\"'(){}\[\]+]++", re.ASCII)
_MORE = re.compile(rf"(?:\s*+(?:\+|\.\.|\.|&|\|\|)\s*+(?:{_STRING}|[A-Za-z_][\w.\-]*+)|[ \t]*+\\?(?:\r?\n)?[ \t]*+{_STRING})*+", re.ASCII | re.DOTALL)
_PART = re.compile(rf"({_STRING})|([^\s\"'`+()]++)", re.DOTALL)
_BRACED = re.compile(r"[$#]?\{([A-Za-z_][\w.]*+)\}", re.ASCII)
_ARGUMENT = re.compile(rf"\(\s*+([\"'])([A-Za-z_][\w.\-]*+)\1\s*+,\s*+({_STRING})", re.ASCII | re.DOTALL)
_FLAG = re.compile(rf"(?<!\S)--?([A-Za-z][\w\-]*+)(?:=|[ \t]++)({_STRING}|[^\s\"'`\-][^\s\"'`]*+)", re.ASCII | re.DOTALL)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>", re.ASCII)
_TAG = re.compile(r"<[A-Za-z_][^<>]*+", re.ASCII)
_TAG_KEY = re.compile(r"\b(?:key|name|id)\s*+=\s*+[\"']([^\"'<>]++)[\"']", re.ASCII)
_TAG_VALUE = re.compile(r"\bvalue\s*+=\s*+[\"']([^\"'<>]++)[\"']", re.ASCII)
_TAG_TEXT = re.compile(r">([^<>]++)</", re.ASCII)
_BLOCK = re.compile(r"^([ \t]*+)(?:-[ ]++)?[\"']?([A-Za-z_][\w.\-]*+)[\"']?[ ]*+:[ ]*+[|>][+\-]?\d?[ ]*+\r?\n((?:\1[ \t]++\S[^\n]*+(?:\n|\Z))++)", re.ASCII | re.MULTILINE)
_BEARER = re.compile(r"\b([Bb]earer)[ \t]++([A-Za-z0-9._~+/=\-]{12,}+)", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# Words that make a name sensitive, and their weight; words that make `key` sensitive; placeholders.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "pass": 0.8}
KEY_KINDS = {"api", "access", "private", "secret", "signing", "encryption", "auth", "client", "master", "session"}
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|redacted|dummy|your[_-]|^x+$|^\*+$|^<.*>$|^\$\{|^\{\{|^%\(|^\.+$", re.IGNORECASE)

#: Type names, which carry no constant.
TYPES = {"str", "string", "String", "bytes", "char", "int", "any", "Any", "object", "text", "bool", "auto"}
#: Names within one bare value from which on their values end at the next name (so that a long run costs no square).
NESTED = 64

#: A pair's score (0 to 1) from which it counts as a secret, and the shortest literal.
THRESHOLD, SHORTEST = 0.6, 12


def name_score(name: str) -> float:
    """How sensitive a name is, by its words (camelCase, snake_case, dotted)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    pairs = zip(words, words[1:], strict=False)
    return max(best, 0.95 if any(b in ("key", "keys") and a in KEY_KINDS for a, b in pairs) else 0.0)


def literal_score(value: str) -> float:
    """How random a literal looks: length, bits per character, and the kinds of its characters."""
    if len(value) < SHORTEST or PLACEHOLDER.search(value) or not value.isascii() or any(c.isspace() for c in value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    return min(1.0, bits / 3.5) * (0.4, 0.6, 0.9, 1.0)[kinds]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the base patterns, leftmost and non-overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def lexed_pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Names with the spans that they are given in order, each once, constants carried over; true for quoted literals."""
    known: dict[str, dict[tuple[int, int, bool], None]] = {}
    at = end = stop = nested = 0  # the last bare value's end, with its concatenated parts, and the names in it
    while (m := _HEAD.search(text, at)) is not None:
        v = m.end()
        if (first := _LITERAL.match(text, v)) is not None:
            close = _MORE.match(text, first.end()).end()
            at = close
        elif v < end:  # within a bare value: no need to look for its end again
            nested += 1
            inner = _HEAD.search(text, v, end) if nested > NESTED else None
            close, at = inner.start() if inner else stop, v
        elif (first := _BARE.match(text, v)) is not None:
            end, nested = first.end(), 0
            close = stop = _MORE.match(text, end).end()
            at = v
        else:
            at = v
            continue
        if m["type"] is not None:
            at = m.start("type")  # what stands as a type may be a name, as after a prefix
        spans: dict[tuple[int, int, bool], None] = {}
        for p in _PART.finditer(text, v, close):
            if p[1] is not None:
                a, z = _content(text, p.start(), p.end())
                inner = [name[1] for name in _BRACED.finditer(text, a, z) if name[1] in known] if "{" in p[1] else []
                spans[a, z, not inner] = None  # a template isn't a literal of its own
                for name in inner:
                    spans.update(known[name])
            elif p[2] in known:
                spans.update(known[p[2]])
            else:
                spans[*p.span(), False] = None
        if m[1] not in TYPES:
            known[m[1]] = spans
        yield m[1], list(spans)


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """What a quoted string holds, without prefix and quotes."""
    while text[start] not in "\"'`":
        start += 1
    n = 3 if text[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
    return start + n, end - n


def _trimmed(text: str, start: int, end: int) -> tuple[int, int, bool]:
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    return start, end, True


def other_pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Names with literals that aren't assigned: arguments, flags, XML, YAML blocks, bearer headers."""
    if "(" in text:
        for m in _ARGUMENT.finditer(text):
            yield m[2], [(*_content(text, *m.span(3)), True)]
    if "-" in text:
        for m in _FLAG.finditer(text):
            yield m[1], [(*(_content(text, *m.span(2)) if m[2][-1] in "\"'`" else m.span(2)), True)]
    if "<" in text:
        if "</" in text:
            for m in _ELEMENT.finditer(text):
                yield m[1], [_trimmed(text, *m.span(2))]
        for tag in _TAG.finditer(text):  # one look at each tag: its first key, the first value behind that, else its text
            if (key := _TAG_KEY.search(text, tag.start() + 2, tag.end())) is None:
                continue
            if (value := _TAG_VALUE.search(text, key.end(), tag.end()) or _TAG_TEXT.match(text, tag.end())) is not None:
                yield key[1], [_trimmed(text, *value.span(1))]
    if "|" in text or ">" in text:
        for m in _BLOCK.finditer(text):
            at, lines = m.start(3), []
            for line in m[3].split("\n"):
                if line.strip():
                    lines.append(_trimmed(text, at, at + len(line)))
                at += len(line) + 1
            yield m[2], lines
    if "earer" in text:
        for m in _BEARER.finditer(text):
            yield m[1], [(*m.span(2), True)]


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Spans of literals whose score, or whose concatenation's score, reaches the threshold."""
    found = set()
    assigned = lexed_pairs(text) if "=" in text or ":" in text else ()
    for name, spans in chain(assigned, other_pairs(text)):
        weight = name_score(name)
        if weight >= THRESHOLD:
            found.update((a, z) for a, z, _ in spans if weight * literal_score(text[a:z]) >= THRESHOLD)
            quoted = [(a, z) for a, z, literal in spans if literal and z > a]
            if len(quoted) > 1 and weight * literal_score("".join(text[a:z] for a, z in quoted)) >= THRESHOLD:
                found.update(quoted)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_literal, base, spans (kind:start:end, in order).

    Offsets are code points, ends exclusive; ties of start go by kind in the order of KINDS, then by end. The lexer's
    spans (kind literal) cover the literal without quotes and add to the base spans, never replace them. Null and empty texts
    have no spans. Repeated rows each give a row, equal texts equal spans. Texts and lines of any length are read whole, in
    linear time. Other columns don't matter, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = [], [], []
            for t in text_column(batch, "text").to_pylist():
                found = base_spans(t)
                more = {(a, 3, b) for a, b in literal_spans(t)}
                counts.append(Counter(k for _, k, _ in [*found, *more]))
                base.append(_joined(found))
                every.append(_joined(sorted([*found, *more])))
            cols = [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base", "spans"])

    kind = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned."""
    got = scan_secrets(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_literal")
