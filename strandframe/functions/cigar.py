"""CIGAR functions over array<struct<len int, op string>> columns: built-in functions where one operation is looked at
alone, Arrow functions over whole batches where positions add up along them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from ..kernels import cigars

OPS = cigars.OPS
READ_OPS, REF_OPS = tuple(cigars.READ_OPS), tuple(cigars.REF_OPS)
MATCH_OPS = ("M", "=", "X")

ARRAY = "array<struct<len:int,op:string>>"


def _structs(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields.items()]))


def parse_cigar(text: Column) -> Column:
    """'10M2I' to ops; null and '*' to no ops."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def cigar_string(ops: Column) -> Column:
    """Ops to text; no ops to '*'."""
    return F.when(F.size(ops) > 0, F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")).otherwise(F.lit("*"))


def decode_cigar(packed: Column) -> Column:
    """BAM integers (length << 4 | code) to ops."""
    letters = F.array(*(F.lit(c) for c in OPS))
    return F.transform(packed, lambda p: F.struct(F.shiftrightunsigned(p, 4).cast("int").alias("len"), F.element_at(letters, (p.bitwiseAND(15) + 1).cast("int")).alias("op")))


def encode_cigar(ops: Column) -> Column:
    """Ops to BAM integers."""
    codes = F.create_map(*(x for i, c in enumerate(OPS) for x in (F.lit(c), F.lit(i).cast("long"))))
    return F.transform(ops, lambda o: F.shiftleft(o["len"].cast("long"), 4).bitwiseOR(F.element_at(codes, o["op"])))


def gap_count(ops: Column) -> Column:
    return F.size(F.filter(ops, lambda o: o["op"].isin("I", "D")))


def span(ops: Column, kinds: tuple[str, ...]) -> Column:
    """Summed length of the ops of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda total, o: total + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def read_length(ops: Column) -> Column:
    return span(ops, READ_OPS)


def reference_length(ops: Column) -> Column:
    return span(ops, REF_OPS)


def _flat(ops: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, codes and row of all operations of a column."""
    ops = ops.combine_chunks() if isinstance(ops, pa.ChunkedArray) else ops
    flat = ops.flatten()
    codes = pa.compute.index_in(flat.field("op"), pa.array(list(OPS))).to_numpy(zero_copy_only=False)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(ops), 0).to_numpy(zero_copy_only=False)
    return flat.field("len").to_numpy(zero_copy_only=False).astype(np.int64), codes.astype(np.int64), np.repeat(np.arange(len(ops)), sizes)


def _lists(like: pa.Array, row: np.ndarray, **fields: pa.Array) -> pa.Array:
    """Lists of structs by row; null where the column is."""
    ends = np.searchsorted(row, np.arange(len(like)), "right").astype(np.int32)
    values = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), values, mask=like.is_null() if like.null_count else None)


_LETTERS = pa.array(list(OPS))


@F.arrow_udf(_structs(len=IntegerType(), op=StringType()))
def merge_runs(ops: pa.Array) -> pa.Array:
    """Neighbours of one kind become one op; empty ops go. Linear in the operations."""
    lens, codes, row = _flat(ops)
    lens, codes, row = lens[lens > 0], codes[lens > 0], row[lens > 0]
    fresh = np.append(True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])) if len(lens) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    total = np.add.reduceat(lens, at) if len(at) else lens
    return _lists(ops, row[at], len=pa.array(total.astype(np.int32)), op=_LETTERS.take(pa.array(codes[at])))


def fix_clips(ops: Column) -> Column:
    """A leading or trailing insertion becomes a soft clip, a deletion there goes; both ends are seen to."""

    def fixed(o: Column) -> Column:
        return F.when(o["op"] == "I", F.array(F.struct(o["len"].alias("len"), F.lit("S").alias("op")))).when(o["op"] == "D", F.array().cast(ARRAY)).otherwise(F.array(o))

    n = F.size(ops)
    first, last = F.element_at(ops, 1), F.element_at(ops, -1)
    return F.when(n == 0, ops).when(n == 1, fixed(first)).otherwise(F.concat(fixed(first), F.slice(ops, 2, n - 2), fixed(last)))


@F.arrow_udf(_structs(len=IntegerType(), op=StringType(), q=IntegerType(), r=IntegerType()))
def with_offsets(ops: pa.Array, start: pa.Array) -> pa.Array:
    """Each op with the read and reference positions at which it begins. Linear in the operations."""
    lens, codes, row = _flat(ops)
    q, r = cigars.offsets(lens, codes, row, start.to_numpy(zero_copy_only=False).astype(np.int64))
    return _lists(ops, row, len=pa.array(lens.astype(np.int32)), op=_LETTERS.take(pa.array(codes)), q=pa.array(q.astype(np.int32)), r=pa.array(r.astype(np.int32)))


@F.arrow_udf(_structs(q=IntegerType(), r=IntegerType()))
def aligned_pairs(ops: pa.Array, start: pa.Array) -> pa.Array:
    """array<struct<q,r>>: both set on M, = and X; r null on I and S; q null on D and N; H and P give none."""
    lens, codes, row = _flat(ops)
    row, q, r = cigars.aligned(lens, codes, row, start.to_numpy(zero_copy_only=False).astype(np.int64))
    return _lists(ops, row, q=pa.array(q.astype(np.int32), mask=q < 0), r=pa.array(r.astype(np.int32), mask=r < 0))


def add_op(ops: Column, length: Column, op: Column) -> Column:
    """Appends an operation; one of the last one's kind joins it."""
    return merge_runs(F.concat(ops, F.array(F.struct(length.cast("int").alias("len"), op.alias("op")))))


def add_front(ops: Column) -> Column:
    """Puts a match of one base in front."""
    return merge_runs(F.concat(F.array(F.struct(F.lit(1).alias("len"), F.lit("M").alias("op"))), ops))
