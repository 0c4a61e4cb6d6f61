"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import keep as cut
from ..session import shared_root

__all__ = ["cut", "fresh", "map_texts", "shared_folder", "shared_root", "utf8"]

def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The strings of a column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def map_texts(
    df: DataFrame, columns: list[str], rows: Callable[..., tuple], schema: str, context: Callable[[], object] | None = None
) -> DataFrame:
    """One output row for each input row: rows(*values, [context]) gives the values of schema.

    context is built once in each Python worker's task.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (context(),) if context else ()
        for batch in stream:
            # small slices keep the Python objects of a batch of long texts few
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                values = [
                    utf8(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist()
                    for c in part.columns
                ]
                out = [rows(*v, *extra) for v in zip(*values)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names
                )

    kinds = {
        "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(),
        "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    return df.select(*columns).mapInArrow(batches, schema)
