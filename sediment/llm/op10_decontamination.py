"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

Texts are normalised byte by byte (A-Z lowered, separators to one space), the automaton scans the normalised
text once, and a hit's end is mapped back to words by counting the spaces before it; word offsets are then
mapped to code points of the original. Both texts are held as Latin-1 views of their UTF-8 bytes, so one
byte is one position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_by_worker, small_batches, table, text_column, written

WINDOW = 10
#: Windows in one automaton, and bytes of the texts they come from (a state of the automaton is a byte of a window: about ten
#: states a byte of text, and some ten bytes a state). More items are split into blocks, each scanned against all rows.
BLOCK_WINDOWS, BLOCK_BYTES = 50_000, 1 << 20
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_WINDOWS, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The (item, text) rows in blocks of bounded size, streamed to the driver; null ids are the item ''. An item longer than
    a block's bytes goes in pieces that overlap by a window less one word."""
    block, windows, size, some = [], 0, 0, False
    for r in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        for piece in _pieces(r[1], most_bytes):
            block.append((r[0], piece))
            windows += max(0, len(words_of(piece)) - WINDOW) + 1
            size += len(piece)
            if windows >= most or size >= most_bytes:
                yield block
                block, windows, size, some = [], 0, 0, True
    if block or not some:
        yield block


def _pieces(text: str, most_bytes: int) -> Iterator[str]:
    if len(text) <= most_bytes:
        yield text
        return
    words = words_of(text)
    held, size, first = [], 0, 0
    for k, w in enumerate(words):
        held.append(w)
        size += len(w) + 1
        if size >= most_bytes and k - first >= WINDOW or k == len(words) - 1:
            yield b" ".join(held).decode("utf-8", "surrogatepass")
            held = held[-WINDOW + 1 :]
            size, first = sum(map(len, held)), k
    if not words:
        yield ""


def _automaton(block: list[tuple[str, str]]):
    import ahocorasick

    found: dict[bytes, set[int]] = {}
    for i, (_, text) in enumerate(block):
        for w in windows_of(words_of(text)):
            found.setdefault(w, set()).add(i)
    auto = ahocorasick.Automaton()
    for w, owners in found.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(owners)))
    auto.make_automaton()
    return auto


def _digest(block: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\0".join(f"{i}\1{t}" for i, t in block).encode("utf-8", "surrogatepass")).hexdigest()


def scan_text(auto, text: str) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, a flag for each word that lies in a hit, and the items that were hit."""
    words = words_of(text)
    hit = np.zeros(len(words), bool)
    owners: set[int] = set()
    if words and len(auto):
        line = f" {b' '.join(words).decode('latin-1')} "
        ends = list(auto.iter(line))
        if ends:
            spaces = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
            for end, (n, who) in ends:
                last = spaces[end] - 1  # words up to and with the one that ends before this space
                hit[last - n : last] = True
                owners.update(who)
    return len(words), hit, owners


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans (end exclusive) of runs of hit words in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
    inside = folded != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(chars[edges[2 * a]]), int(chars[edges[2 * b - 1]])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def _scan(df: DataFrame, block: list[tuple[str, str]], doc_id: str, text: str, spans: bool) -> DataFrame:
    kind = "n_words long, n_hit long, items array<string>" + (", spans array<struct<start:long,end:long>>" if spans else "")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != text)}, {kind}"
    keep = [c for c in df.columns if c != text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = held_by_worker(_digest(block), lambda: _automaton(block))
        for batch in batches:
            n_words, n_hit, items, where = [], [], [], []
            for t in text_column(batch, text).to_pylist():
                n, hit, owners = scan_text(auto, t)
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                items.append(sorted({block[i][0] for i in owners}))
                if spans:
                    where.append([{"start": a, "end": b} for a, b in original_spans(t, hit)] if owners else [])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            if spans:
                more.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols + more, names=[*keep, "n_words", "n_hit", "items", *(["spans"] if spans else [])])

    return df.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids of the items with occurring windows), spans.

    A window is ten consecutive words of an item; an item of fewer words (but not none) is one window. A document
    word inside any occurrence of a window is hit; spans are code-point runs of hit words in the original text.
    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Repeated document rows each
    give a row; items that share an id count once. Columns but these two don't matter, whatever their
    names; texts of any length are read whole. Benchmarks of more than BLOCK_WINDOWS windows or BLOCK_BYTES are scanned in
    blocks: hits of blocks are united as spans before words are counted, so blocks don't change the result.
    """
    small_batches(docs.sparkSession)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = item_blocks(items)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(lean, first, "doc_id", "text", True)
    keyed = written(lean.withColumn("row_key", F.monotonically_increasing_id()), "decontaminate-rows")
    found = None
    for block in chain([first, second], blocks):  # written one by one: the driver holds two blocks at most
        one = written(_scan(keyed, block, "doc_id", "text", True), "decontaminate-block")
        found = one if found is None else found.unionByName(one)
    runs = found.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return _recounted(keyed.select("row_key", "text").join(runs, "row_key"))


def _recounted(df: DataFrame) -> DataFrame:
    """Merge overlapping spans and count the words inside them again (only where there are several blocks)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column("doc_id").to_pylist(), "n_words": batch.column("n_words").to_pylist(), "n_hit": [], "items": batch.column("items").to_pylist(), "spans": []}
            for text, spans in zip(text_column(batch, "text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in spans:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                out["n_hit"].append(sum(len(words_of(text[a:b])) for a, b in merged))
                out["spans"].append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(count, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, every column kept, in which no window of any item occurs; null and empty texts stay."""
    small_batches(docs.sparkSession)
    for k, block in enumerate(item_blocks(items)):
        if k:
            docs = written(docs, "clean-block")

        def clean(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            auto = held_by_worker(_digest(block), lambda: _automaton(block))
            for batch in batches:
                keep = [not len(auto) or next(auto.iter(f" {b' '.join(words_of(t)).decode('latin-1')} "), None) is None for t in text_column(batch, text).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM pat),
pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n
), cand AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM pos),
hits AS (SELECT c.doc_id, c.n, c.i, pat.item_id FROM cand c JOIN pat ON c.n = pat.n AND c.p = pat.p),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1
)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
