"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of about SHARD_BYTES within a partition, over the borders of batches. Its words are coded
over its own vocabulary and indexed once, whole: a wavelet matrix of what precedes each suffix, and sampled suffix
positions. Test phrases are coded by the shard's vocabulary (a phrase with a word that the shard lacks is in no document
of it), searched backward by ranks, all at once, located from the samples and merged into removal spans.

The benchmark is cut into blocks of at most BLOCK_BYTES of text, each broadcast by itself. An index meets one block after
the other, and a worker drops each before it takes the next: what it holds is one shard and one block, however large the
benchmark grows. The whole is one map over the documents; no stage shuffles them.

Defined results: null and empty texts, of documents or items, have no words; an item with a null id marks words
but is not counted among the items; rows with the same item id are one item; repeated document rows are treated
each by itself; an empty benchmark hits nothing; a document longer than a shard is one; columns beyond those named are
left alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .util import utf8

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and blanks the ASCII characters that are in no word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def coder() -> defaultdict:
    """Numbers words from 1 as they come."""
    return defaultdict(count(1).__next__)


class Phrases:
    """The windows of a block of benchmark items: distinct runs of words, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        code = coder()
        texts = [np.fromiter(map(code.__getitem__, words_of(text or b"")), np.int32) for _, text in items]
        self.words = list(code)
        self.names = [None if item is None else str(item) for item, _ in items]
        #: The runs, the bounds of their lists of items, and these lists end to end.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(window, len(t)) for t in texts if len(t)}):
            mine = [k for k, t in enumerate(texts) if min(window, len(t)) == length]
            runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[k], length) for k in mine])
            owner = np.repeat(mine, [len(texts[k]) - length + 1 for k in mine])
            distinct, which = np.unique(runs, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), owner]), axis=1)  # by run, then item
            self.by_length.append((distinct, np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]))


class Shard:
    """The words of some texts under an FM-index."""

    def __init__(self, texts: list[bytes]):
        code = coder()
        end = np.zeros(1, np.int32)
        parts: list[np.ndarray] = []
        for text in texts:
            parts += [np.fromiter(map(code.__getitem__, words_of(text)), np.int32), end]
        self.code = dict(code)
        sizes = np.array([len(p) for p in parts[::2]], np.int64)
        self.counts = sizes.tolist()
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.index = FMIndex(np.concatenate(parts), len(self.code) + 1) if self.code else None

    def hits(self, phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For texts with hits, by index: merged spans of words [start, end) and item ids."""
        spans: dict[int, list] = defaultdict(list)
        ids: dict[int, set[str]] = defaultdict(set)
        if self.index is None or not phrases.words:
            return {}
        codes = np.fromiter(map(self.code.get, phrases.words, repeat(0)), np.int32, len(phrases.words))
        codes = np.append(np.zeros(1, np.int32), codes)  # phrases number words from 1
        for runs, bounds, owners in phrases.by_length:
            length = runs.shape[1]
            there = np.flatnonzero((codes[runs] > 0).all(axis=1))
            low, high = self.index.search(codes[runs[there]])
            n = np.maximum(high - low, 0)
            which = np.repeat(there, n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            at = self.index.locate(rows)
            docs = np.searchsorted(self.begins, at, "right") - 1
            for d, s in zip(docs.tolist(), (at - self.begins[docs]).tolist()):
                spans[d].append((s, s + length))
            for d, w in np.unique(np.stack([docs, which]), axis=1).T.tolist():
                ids[d].update(name for k in owners[bounds[w] : bounds[w + 1]].tolist() if (name := phrases.names[k]) is not None)
        return {d: (merge(x), ids[d]) for d, x in spans.items()}


def all_hits(texts: list[bytes], blocks: list[Broadcast]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Words of each text, and the hits of all blocks: the index is built once and meets them one after the other."""
    shard = Shard(texts)
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for block in blocks:
        for d, (spans, ids) in shard.hits(block.value).items():
            before = found.get(d, ([], set()))
            found[d] = (merge([*before[0], *spans]), before[1] | ids)
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # the worker's copy; it stays on the executor's disk
    return shard.counts, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def benchmark_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The distinct items in blocks of about block_bytes of text at most (or one item), each broadcast. Which items a
    block holds is decided by hash, so that the driver never holds more than one."""
    items = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text")).where("length(text) > 0").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))
    context, out = benchmark.sparkSession.sparkContext, []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(context.broadcast(Phrases([(r["id"], bytes(r["text"])) for r in rows.collect()])))
        if n > 1:
            vars(out[-1]).pop("_value", None)  # the driver's copy
    return out


def _shards(stream: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Runs of rows of about SHARD_BYTES of text, as pieces of the batches they come in."""
    parts: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in stream:
        start = 0
        for i, text in enumerate(utf8(batch.column(column))):
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield [*parts, batch.slice(start, i + 1 - start)], texts
                parts, texts, size, start = [], [], 0, i + 1
        if start < batch.num_rows:
            parts.append(batch.slice(start))
    if texts:
        yield parts, texts


def find_phrases(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words in spans), spans (start, end, start, end ... in words, merged) and items (sorted ids) for each document."""
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, texts in _shards(stream, 1):
            counts, found = all_hits(texts, blocks)
            spans = [list(sum(found[i][0], ())) if i in found else [] for i in range(len(texts))]
            items = [sorted(found[i][1]) if i in found else [] for i in range(len(texts))]
            n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            begin = 0
            for part in parts:
                mine = slice(begin, begin + part.num_rows)
                begin = mine.stop
                arrays = [pa.array(counts[mine], pa.int64()), pa.array(n_hit[mine], pa.int64()), pa.array(spans[mine], pa.list_(pa.int64())), pa.array(items[mine], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_words", "n_hit", "spans", "items"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind}, n_words bigint, n_hit bigint, spans array<bigint>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_phrases for each document."""
    found = find_phrases(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them; a line break stands in their place."""
    bounds = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return b"\n".join([*out, text[at:]])


def _replaced(part: pa.RecordBatch, changed: dict[int, bytes], at_text: int, at_chars: int | None) -> pa.RecordBatch:
    """The rows with the changed texts, by index, and n_chars of these."""
    if not changed:
        return part
    old = part.column(at_text)
    new = [changed[i].decode() if i in changed else v for i, v in enumerate(old.to_pylist())]
    arrays = list(part.columns)
    arrays[at_text] = pa.array(new, old.type)
    if at_chars is not None:
        lengths = part.column(at_chars).to_pylist()
        arrays[at_chars] = pa.array([len(new[i]) if i in changed else v for i, v in enumerate(lengths)], part.column(at_chars).type)
    return pa.RecordBatch.from_arrays(arrays, schema=part.schema)


def remove_phrases(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every benchmark phrase cut from text and n_chars set anew; all columns and rows stay.

    The spans of all blocks are merged before a cut. Words that come together around a cut are searched again, in the
    shard of those documents that the cut changed, until none holds a phrase of any block.
    """
    names = docs.columns
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)

    def clean(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, texts in _shards(stream, at_text):
            todo = dict(enumerate(texts))
            changed: dict[int, bytes] = {}
            while todo:
                keys = list(todo)
                _, found = all_hits([todo[i] for i in keys], blocks)
                todo = {keys[j]: cut_spans(todo[keys[j]], spans) for j, (spans, _) in found.items()}
                changed |= todo
            begin = 0
            for part in parts:
                mine = {i - begin: changed[i] for i in range(begin, begin + part.num_rows) if i in changed}
                begin += part.num_rows
                yield _replaced(part, mine, at_text, at_chars)

    return docs.mapInArrow(clean, docs.schema)
