"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards, each shard with a weight; a rack or region weighs what is below it. A key
descends level by level: every child of the node it has reached draws an exponential of its weight from a hash of the
key and the child's own path, and the key goes on below the least draw. Siblings of nodes on its path draw nothing, so a
placement costs the children of three nodes, however many shards there are.

A draw depends on nothing but its own node. So a change of weights moves keys only into or out of the nodes whose
weights change: between shards of one rack if that rack's sum stays, between racks of a region if that region's does.
A cluster starts out with an even tree of `base` shards; every later shard comes as a region of its own, so that it takes
keys from all others in proportion and none moves between these (law `key`).

Everything is DataFrame functions: one narrow pass over the documents, then shuffles of narrow rows for slots.
Defined results: a null id is a key like any other; null texts have size 1; rows with the same id share a shard and
get slots of their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered within this many hash buckets of a shard at a time.
SLOT_BUCKETS = 512
#: Copies of a row that one task numbers.
COPIES = 4096
BASE = 8


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """Shards of weight 1, dealt to the racks in turn."""
    return [Shard(i, f"region{i % regions}", f"rack{i // regions % racks}") for i in range(shards)]


def grown_tree(shards: int, base: int = BASE) -> list[Shard]:
    """An even tree of base shards (or of all, if they are fewer), and a region for each shard that came later."""
    return even_tree(min(shards, base)) + [Shard(i, f"grown{i}", "rack0") for i in range(base, shards)]


def draw(key: Column, path: str, weight: float) -> Column:
    """An exponential of the node's weight, from the upper 53 bits of the hash: the smaller, the stronger."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(weight)


def _children(tree: list[Shard], level: int, parent: str) -> dict[str, float]:
    """Paths of the children of a node with their weights; nodes without weight take nothing."""
    out: dict[str, float] = {}
    for s in tree:
        path = [s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
        if s.weight > 0 and (level == 0 or path[level - 1] == parent):
            out[path[level]] = out.get(path[level], 0.0) + s.weight
    return dict(sorted(out.items()))


def _least(key: Column, nodes: dict[str, float]) -> Column:
    """The path with the least draw; ties, all but impossible, go to the first by path. An only child draws nothing."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    return F.array_min(F.array(*(F.struct(draw(key, p, w).alias("d"), F.lit(p).alias("p")) for p, w in nodes.items())))["p"]


def descend(rows: DataFrame, key: str, tree: list[Shard], out: str) -> DataFrame:
    """Adds the column out, the path region/rack/shard of each key. Each level is a column that the next level looks at,
    so that only the children of the chosen node are drawn for."""
    names = [f"{out}_level{k}" for k in range(2)]
    here: list[str] = [""]
    for level, name in enumerate([*names, out]):
        branches = {parent: _children(tree, level, parent) for parent in here}
        if level == 0:
            column = _least(F.col(key), branches[""])
        else:
            first, *rest = branches.items()
            column = F.when(F.col(names[level - 1]) == first[0], _least(F.col(key), first[1]))
            for parent, nodes in rest:
                column = column.when(F.col(names[level - 1]) == parent, _least(F.col(key), nodes))
        rows = rows.withColumn(name, column)
        here = sorted(p for nodes in branches.values() for p in nodes)
    return rows.drop(*names)


def place(docs: DataFrame, shards: int = BASE, tree: list[Shard] | None = None, base: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard and grown_shard (with one more shard) for each document."""
    tree = grown_tree(shards, base) if tree is None else tree
    number = max(s.number for s in tree) + 1
    later = Shard(number, f"grown{number}", "rack0")
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = descend(rows, "doc_id", tree, "path")
    parts = F.split("path", "/")
    # the grown tree differs by one region: below any other, its descent is the same
    regions = _children([*tree, later], 0, "")
    moved = _least(F.col("doc_id"), regions) == later.region
    rows = rows.select("doc_id", "size", "text_crc32", parts[0].alias("region"), parts[1].alias("rack"), parts[2].cast("int").alias("shard"), moved.alias("moved"))
    return rows.select(*(c for c in rows.columns if c != "moved"), F.when(F.col("moved"), F.lit(number)).otherwise(F.col("shard")).alias("grown_shard"))


def with_slots(rows: DataFrame, buckets: int = SLOT_BUCKETS, copies: int = COPIES) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: an offset for each hash bucket of a shard and a number within it.

    No task holds a shard: a bucket holds a shard's part of 1 / buckets. Buckets go by all columns, so that many rows
    with one id spread. Rows that are equal in all columns are counted before they are shuffled and numbered as one; where
    there are more than `copies` of a row, runs of them are dealt out again before they are written out one by one.
    """
    order = [c for c in rows.columns if c != "shard"]
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    counted = rows.withColumn("slot_bucket", bucket).groupBy("shard", "slot_bucket", *order).agg(F.count("*").alias("slot_rows"))
    counts = rows.select("shard", bucket.alias("slot_bucket")).groupBy("shard", "slot_bucket").agg(F.count("*").alias("slot_rows"))
    before = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slot_bucket", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_offset"))
    within = Window.partitionBy("shard", "slot_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x buckets rows of 16 bytes: a bound of its own, whatever the input
    begun = counted.withColumn("slot_before", F.coalesce(F.sum("slot_rows").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "slot_bucket"])
    begun = begun.select(*rows.columns, "slot_rows", (F.col("slot_offset") + F.col("slot_before")).alias("slot_first"))

    def numbered(runs: DataFrame) -> DataFrame:
        every = F.sequence(F.col("slot_first"), F.col("slot_first") + F.col("slot_rows") - 1)
        return runs.select(*rows.columns, F.explode(every).alias("slot"))

    starts = F.sequence(F.lit(0).cast("long"), F.col("slot_rows") - 1, F.lit(copies).cast("long"))
    runs = begun.where(F.col("slot_rows") > copies).withColumn("slot_run", F.explode(starts))
    runs = runs.select(
        *rows.columns, F.least(F.col("slot_rows") - F.col("slot_run"), F.lit(copies)).alias("slot_rows"), (F.col("slot_first") + F.col("slot_run")).alias("slot_first")
    )
    return numbered(begun.where(F.col("slot_rows") <= copies)).unionByName(numbered(runs.repartition("shard", "slot_first")))


def shard_documents(docs: DataFrame, shards: int = BASE) -> DataFrame:
    """The placement of each document with its slot."""
    return with_slots(place(docs, shards)).withColumn("law", F.lit("key"))
