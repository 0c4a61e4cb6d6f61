"""Minimal absent substrings: what of a read the reference doesn't hold, and nothing shorter within it.

The index is a set of suffix-array shards, built by executors and written below a path that all of them share; a search
ships the path and the shards' names, never a shard. For every position the longest match is a maximum over shards; the
rest is one rule: [b, e(b)] is told if the next position that has an absent substring ends it later.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels.matching import Shard, encode
from ..session import shared_root
from ..sources.files import listed, open_binary

#: About what a shard holds at most, and with that what a worker holds of the index at once.
SHARD_CHARS = 4 << 20
#: Overlap of the pieces that long sequences are cut into: the longest read that an index serves.
LONGEST = 1 << 17
#: Characters of reads that meet the shards together: the index is read once for each such block.
BLOCK_CHARS = 8 << 20
_SLICE_CHARS = 1 << 19
SHARDS = "shard long, alphabet binary, letters binary, suffixes binary"


def minimal_absent(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the minimal absent substrings of one text, from its longest matches."""
    n = len(lengths)
    ends = np.arange(n) + lengths  # the last character of the shortest absent substring
    starts = np.flatnonzero(ends < n)
    ends = ends[starts]
    kept = np.append(ends[:-1] < ends[1:], True) if len(ends) else np.zeros(0, bool)
    return starts[kept], ends[kept] - starts[kept] + 1


def disjoint_absent(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the minimal absent substrings those that a scan from the right takes if each must end before the last begins."""
    starts, sizes = minimal_absent(lengths)
    kept, begin = [], len(lengths)
    for i in range(len(starts) - 1, -1, -1):
        if starts[i] + sizes[i] <= begin:
            kept.append(i)
            begin = starts[i]
    kept.reverse()
    return starts[kept], sizes[kept]


def build_index(references: DataFrame, column: str, path: str, longest: int = LONGEST, shard_chars: int = SHARD_CHARS) -> str:
    """Writes the shards of the sequences of a column below path, each a file, built by a task of its own. Sequences are cut
    into pieces that overlap by the longest read, so that whatever a read may hold of a sequence lies within one piece;
    equal pieces are one. Returns the path."""
    size = max(shard_chars // 4, 2 * longest, 16)
    starts = F.sequence(F.lit(0), F.greatest(F.length("s") - longest - 1, F.lit(0)), F.lit(size - longest))
    rows = references.where(F.length(column) > 0).select(F.col(column).alias("s")).distinct()
    rows = rows.select(F.explode(F.transform(starts, lambda i: F.substring(F.col("s"), i + 1, F.lit(size)))).alias("s")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // shard_chars))

    def build(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        for batch in stream:
            for shard, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(shard, []).append(s)
        for shard in sorted(held):
            values = [[x] for x in Shard(sorted(held.pop(shard))).saved()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array(v, pa.binary()) for v in values)], ["shard", "alphabet", "letters", "suffixes"])

    dealt = rows.select(F.pmod(F.xxhash64("s"), F.lit(n)).alias("shard"), "s").repartition(int(n), "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(build, SHARDS).write.partitionBy("shard").parquet(path)
    return path


def shard_files(spark: SparkSession, path: str) -> list[str]:
    """The files of an index: their names are all that the driver learns of it."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path").collect()
    return sorted(r["path"].removeprefix("file:") if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"] for r in names)


@lru_cache(maxsize=1)
def load_shard(name: str) -> Shard:
    """One in a worker at a time."""
    with open_binary(name) as f:
        row = pq.read_table(pa.BufferReader(f.read())).select(["alphabet", "letters", "suffixes"])
    return Shard.loaded(*(row.column(i)[0].as_py() for i in range(3)))


def _lengths(texts: list[np.ndarray], names: list[str]) -> list[np.ndarray]:
    """The longest matches of each text over all shards: each shard is loaded once and meets the texts in slices."""
    best = [np.zeros(len(t), np.int32) for t in texts]
    for name in names:
        shard = load_shard(name)
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _SLICE_CHARS):
                size += len(texts[stop])
                stop += 1
            sizes = np.array([len(t) for t in texts[start:stop]])
            ends = np.cumsum(sizes)
            found = shard.longest_matches(np.concatenate(texts[start:stop]).astype(np.int64), np.repeat(ends, sizes))
            for i, lengths in enumerate(np.split(found, ends[:-1]), start):
                np.maximum(best[i], lengths, out=best[i], casting="same_kind" if lengths.dtype == np.int32 else "unsafe")
            start = stop
    return best


def search_index(reads: DataFrame, index: str, keys: Sequence[str], seq: str, relaxed: bool = False) -> DataFrame:
    """keys, qs and l of each minimal absent substring of each read (0-based, in characters), or, relaxed, of those that
    a scan from the right takes without overlap. One map over the reads; null reads have none."""
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    n_keys = len(keys)
    names = shard_files(reads.sparkSession, index)
    pick = disjoint_absent if relaxed else minimal_absent

    def found(parts: list[pa.RecordBatch], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(texts, names)
        begin = 0
        for part in parts:
            for at in range(0, part.num_rows, 1024):  # small batches out: a read may have very many strings
                some = part.slice(at, 1024)
                strings = [pick(x) for x in lengths[begin : begin + some.num_rows]]
                begin += some.num_rows
                rows = pa.array(np.repeat(np.arange(len(strings)), [len(s) for s, _ in strings]))
                numbers = [pa.array(np.concatenate([s[i] for s in strings]).astype(np.int64), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(some.column(i).take(rows) for i in range(n_keys)), *numbers], [*keys, "qs", "l"])

    def search(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        size = 0
        for batch in stream:
            start = 0
            for i, text in enumerate(batch.column(n_keys).to_pylist()):
                texts.append(encode(text or "").astype(np.int32))
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield from found([*parts, batch.slice(start, i + 1 - start)], texts)
                    parts, texts, size, start = [], [], 0, i + 1
            if start < batch.num_rows:
                parts.append(batch.slice(start))
        if texts:
            yield from found(parts, texts)

    return reads.select(*keys, F.col(seq).cast("string").alias("seq")).mapInArrow(search, f"{head}, qs long, l long")


def specific_strings(reads: DataFrame, references: DataFrame, keys: Sequence[str], seq: str, ref_seq: str, shard_chars: int = SHARD_CHARS, relaxed: bool = False) -> DataFrame:
    """search_index() over an index of the references that is built for the longest of these reads, in the shared folder."""
    longest = reads.agg(F.coalesce(F.max(F.length(seq)), F.lit(0))).first()[0]
    path = f"{shared_root(reads.sparkSession)}/index-{uuid.uuid4().hex}"
    return search_index(reads, build_index(references, ref_seq, path, longest, shard_chars), keys, seq, relaxed)


def assemble(strings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges overlapping strings of a read: the first one's start and htag, up to the last one's end. Strings that only
    touch stay apart."""
    w = Window.partitionBy(*keys).orderBy("qs", "l")
    reach = F.max(F.col("qs") + F.col("l")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = strings.withColumn("begins", F.when(reach <= F.col("qs"), 1).otherwise(0)).withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tagged = "htag" in strings.columns and "htag" not in keys
    tag = [F.min_by("htag", F.struct("qs", "l")).alias("htag")] if tagged else []
    merged = islands.groupBy(*keys, "island").agg(F.min("qs").alias("qs"), F.max(F.col("qs") + F.col("l")).alias("end"), *tag)
    return merged.select(*keys, "qs", (F.col("end") - F.col("qs")).alias("l"), *(["htag"] if tag else []))
