"""Order-dependent greedy scans, each a fold over the rows of a group in a total order.

Rows are dealt by group and sorted by Spark; a task streams over its groups, so that many small ones cost little and
memory is that of one group. Groups are reads, clusters or parts of contigs, into which cut_at_gaps() deals a contig so
that no fold could connect them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.placement import first_groups
from ..kernels.splitting import by_length

#: A fold takes the values of its columns and gives the rows it keeps, by index (None: all), and the new columns.
Fold = Callable[..., tuple[list[int] | None, list[list]]]


def cut_at_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: int | Column, out: str = "part", width: int = 1 << 20) -> DataFrame:
    """Names parts of each key between which more than slack positions are free, by the first position of each part.

    Rows are dealt by key and bin of their start, so that no task holds a key; what reaches into a bin from those before it
    is carried over by a table of one row for each bin, whose own window is that small.
    """
    rows = df.withColumn("gap_bin", F.floor(F.col(start) / width))
    dealt = [*keys, "gap_bin"]

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        bins = rows.groupBy(*dealt).agg(F.max(value).alias("gap_value"))
        bins = bins.select(*(F.col(k).alias(f"gap_{i}") for i, k in enumerate(dealt)), F.max("gap_value").over(Window.partitionBy(*keys).orderBy("gap_bin").rowsBetween(Window.unboundedPreceding, -1)).alias(name))
        on = [F.col(k).eqNullSafe(F.col(f"gap_{i}")) for i, k in enumerate(dealt)]
        return rows.join(bins, on).drop(*(f"gap_{i}" for i in range(len(dealt))))

    within = Window.partitionBy(*dealt).orderBy(start, end)
    rows = carried(rows, F.col(end), "gap_carried")
    reach = F.greatest(F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("gap_carried"))
    rows = rows.withColumn("gap_begin", F.when(reach.isNull() | (F.col(start) - reach > slack), F.col(start)))
    rows = carried(rows, F.col("gap_begin"), "gap_before")
    # by range, for rows of one start are in one part, whichever of them comes first
    upto = Window.partitionBy(*dealt).orderBy(start).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.greatest(F.max("gap_begin").over(upto), F.col("gap_before"))
    return rows.select(*df.columns, part.alias(out))


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], fold: Fold, added: Sequence[tuple[str, str]] = (), replaced: Sequence[str] = ()) -> DataFrame:
    """Applies fold to the columns of each group. What it returns goes first into the replaced columns, then into the
    added ones (name, type)."""
    names = df.columns
    at_keys, at_columns = [names.index(k) for k in keys], [names.index(c) for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in added)])
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def finish(held: list[pa.RecordBatch]) -> pa.Table:
        """All whole groups in the held batches, folded."""
        table = pa.Table.from_batches(held)
        group_keys = list(zip(*(table.column(i).to_pylist() for i in at_keys)))
        values = [table.column(i).to_pylist() for i in at_columns]
        rows: list[int] = []
        out: list[list] = [[] for _ in range(len(replaced) + len(added))]
        start = 0
        for end in range(1, len(group_keys) + 1):
            if end < len(group_keys) and group_keys[end] == group_keys[start]:
                continue
            kept, new = fold(*(v[start:end] for v in values))
            rows.extend(range(start, end) if kept is None else (start + k for k in kept))
            for o, n in zip(out, new):
                o.extend(n)
            start = end
        result = table.take(pa.array(rows, pa.int64()))
        for name, values_ in zip(replaced, out):
            i = names.index(name)
            result = result.set_column(i, result.schema.field(i), pa.chunked_array([pa.array(values_, result.schema.field(i).type)]))
        for (name, kind), values_ in zip(added, out[len(replaced) :]):
            result = result.append_column(name, pa.chunked_array([pa.array(values_, kinds[kind])]))
        return result

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group of what has come may go on in the next batch
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in at_keys)
            cut = batch.num_rows
            while cut and tuple(batch.column(i)[cut - 1].as_py() for i in at_keys) == last:
                cut -= 1
            if cut or (held and tuple(held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in at_keys) != last):
                whole = [*held, *([batch.slice(0, cut)] if cut else [])]
                if whole:
                    yield from finish(whole).to_batches()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from finish(held).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def window_numbers(starts: Sequence[int], ends: Sequence[int], distances: Sequence[int]) -> list[int]:
    out, anchor, number = [], None, -1
    for at, end, reach in zip(starts, ends, distances):
        if anchor is None or at - anchor > reach:
            anchor, number = end, number + 1
        out.append(number)
    return out


def anchored_windows(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], distance: str, out: str = "window") -> DataFrame:
    """A new window begins where start lies further than distance (a column, the same in all rows) from the end of the
    window's first row: long chains of overlapping rows are cut."""
    return fold_groups(df, keys, order, [start, end, distance], lambda s, e, d: (None, [window_numbers(s, e, d)]), [(out, "long")])


def merge_into_first(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Each interval is merged into the first one so far that it overlaps (closed), in one pass; merged ones may overlap.
    The other columns are those of the first; n_merged counts."""

    def fold(starts: list[int], ends: list[int]) -> tuple[list[int], list[list]]:
        kept = first_groups(zip(starts, ends))
        return [m[0] for _, _, m in kept], [[s for s, _, _ in kept], [e for _, e, _ in kept], [len(m) for _, _, m in kept]]

    return fold_groups(df, keys, order, [start, end], fold, [("n_merged", "long")], [start, end])


def centres(at: Sequence[int], w: Sequence[int], n: Sequence[int], reach: int) -> list[list[int]]:
    """Index, summed weight and largest length of each centre, by ascending positions. A row within reach of a centre is
    none itself, so centres lie further apart than reach, and only the last can still take a row in."""
    out: list[list[int]] = []
    for i in range(len(at)):
        if out and at[i] - at[out[-1][0]] <= reach:
            out[-1][1], out[-1][2] = out[-1][1] + w[i], max(out[-1][2], n[i])
        else:
            out.append([i, w[i], n[i]])
    return out


def proximity_clusters(df: DataFrame, keys: Sequence[str], position: str, weight: str, length: str, order: Sequence[str], reach: int = 1000) -> DataFrame:
    """By position, a centre takes in what lies within reach of it (summed weight, largest length); what none takes in
    becomes a centre. order breaks ties of position. Parts of a key that lie further apart are folded apart."""

    def fold(at: list[int], w: list[int], n: list[int]) -> tuple[list[int], list[list]]:
        found = centres(at, w, n, reach)
        return [c[0] for c in found], [[c[1] for c in found], [c[2] for c in found]]

    parted = cut_at_gaps(df, keys, position, position, reach, "proximity_part")
    return fold_groups(parted, [*keys, "proximity_part"], [position, *order], [position, weight, length], fold, (), [weight, length]).drop("proximity_part")


def length_groups(lengths: Sequence[int], ratio: float) -> list[int]:
    """The group of each length, in order: the first whose integer mean is within ratio, else a new one."""
    out = [0] * len(lengths)
    for k, group in enumerate(by_length(list(range(len(lengths))), list(lengths), ratio)):
        for i in group.reads:
            out[i] = k
    return out


def greedy_length_split(df: DataFrame, keys: Sequence[str], length: str, order: Sequence[str], ratio: float = 0.97, out: str = "sub_id") -> DataFrame:
    """Adds the number of the sub-cluster that each row joins."""
    return fold_groups(df, keys, order, [length], lambda n: (None, [length_groups(n, ratio)]), [(out, "long")])
