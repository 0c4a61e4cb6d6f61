"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut

LINKS = "a long, b long"
#: Nodes that a task holds at once.
MAX_NODES = 1 << 18


def _forest(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition that connect what all its links connect: each node but the least of its tree to that.
    Beyond MAX_NODES nodes the forest so far is told and a new one begun."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def told() -> Iterator[pa.RecordBatch]:
        pairs = np.array([(x, r) for x in list(parent) if (r := root(x)) != x], np.int64).reshape(-1, 2)
        for start in range(0, len(pairs), 1 << 16):
            block = pairs[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(block[:, 0]), pa.array(block[:, 1])], ["a", "b"])
        parent.clear()

    for batch in stream:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
            if len(parent) > MAX_NODES:
                yield from told()
    yield from told()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) for each node that has a link; links: a and b, longs.

    Every round cuts lineage with a checkpoint. Minima are aggregated before the shuffle and only joined back to the
    links, so that a node with very many links costs no task more than its share (skewed joins are split).
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").mapInArrow(_forest, LINKS).distinct())
    # edges run from the larger node to the smaller
    before = None
    while True:  # each round but the last brings some node nearer to the least of its component
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        # a node without smaller neighbours is itself the least: its links stay as they are
        edges = edges.join(low.select(F.col("a").alias("b"), "low"), "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        both = edges.join(low, "a")
        edges = both.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
        edges = cut(edges.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
