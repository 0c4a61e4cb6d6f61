"""SimHash near-duplicates by deletion-variant signatures.

To link fingerprints at MAX_BITS = 2 differing bits, they are cut into two segments of 32 bits: of two such
fingerprints, one segment differs by one bit at most. Each segment is indexed whole and under every variant with one
wildcard bit, so that such segments meet at an equal key; what meets is verified by the bits of the whole fingerprint.
At a wildcard only fingerprints that differ in that bit are compared, the others having met at the whole segment.

Exact copies share a fingerprint and are one row of the index. At a key with more than BUCKET fingerprints not all
pairs are made: the fingerprints found at such keys are keyed by themselves and by each of their 64 one-bit
neighbours. Those that share such a key differ by two bits at most from one another, and any two that differ by two
bits at most share one; so links to the least of each key connect the same fingerprints, with 65 rows for each.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; rows with a null id take
part, and the smallest id ignores nulls; repeated rows are alike; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .util import cut, fresh, utf8

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints at a key of which all pairs are compared.
BUCKET = 32
_BLOCK = 1 << 15  # hashes whose bits are counted at once


def fingerprint(text: bytes | None) -> int:
    """As a signed 64-bit integer: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and ASCII blanks only
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hash64(b" ".join(words), SEED) - (1 << 64 if hash64(b" ".join(words), SEED) >> 63 else 0)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + SHINGLE - 1]
        hashes = np.array([hash64(b"%b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fingerprint (long) and the columns named."""
    names = ["doc_id", *more]
    kept = docs.select(*names, F.col("text").cast("string").alias("simhash_text"))

    def rows(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = pa.array([fingerprint(t) for t in utf8(part.column(len(names)))], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], [*names, "fingerprint"])

    kinds = ", ".join(f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in names)
    return kept.mapInArrow(rows, f"{kinds}, fingerprint long")


def variants(distinct: DataFrame) -> DataFrame:
    """key and fingerprint: for each of the two segments the whole and one row for each wildcard bit."""
    per = SEGMENT_BITS + 1
    out = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * per - 1))).alias("v"))
    segment = F.when(F.col("v") < per, F.expr("fingerprint & 4294967295L")).otherwise(F.expr("shiftrightunsigned(fingerprint, 32)"))
    bit = F.col("v") % per
    masked = F.when(bit < SEGMENT_BITS, segment.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, v % {per})")))).otherwise(segment)
    return out.select(F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(masked).alias("key"), "fingerprint")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs a, b of fingerprints that differ by at most MAX_BITS bits, enough to connect all that are so linked."""
    per = SEGMENT_BITS + 1
    # counted before they are shuffled, then joined back, so that Spark can split a key that very many share
    counts = cut(variants(distinct).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(variants(distinct).join(counts, "key"))
    small = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fingerprint").alias("f"))
    # the wildcard's bit in the whole fingerprint; none for a whole segment
    bit = F.expr(f"""case when shiftright(key, 32) % {per} = {SEGMENT_BITS} then 0L
        when shiftright(key, 32) < {per} then shiftleft(1L, cast(shiftright(key, 32) as int))
        else shiftleft(1L, cast(shiftright(key, 32) - {per} + {SEGMENT_BITS} as int)) end""")
    pairs = (
        small.withColumn("w", bit)
        .select(F.explode(F.expr(f"""flatten(transform(f, x -> transform(
            filter(f, y -> x < y and bit_count(x ^ y) <= {MAX_BITS} and (w = 0 or (x ^ y) & w != 0)),
            y -> struct(x as a, y as b))))""")).alias("p"))
        .select("p.a", "p.b")
    )
    crowded = met.where(F.col("n") > bucket).select("fingerprint").distinct()
    balls = crowded.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        "fingerprint", F.expr("case when i < 64 then fingerprint ^ shiftleft(1L, i) else fingerprint end").alias("ball")
    )
    stars = (
        balls.withColumn("a", F.min("fingerprint").over(Window.partitionBy("ball")))
        .where(F.expr(f"a != fingerprint and bit_count(a ^ fingerprint) <= {MAX_BITS}"))
        .select("a", F.col("fingerprint").alias("b"))
    )
    return pairs.unionByName(stars)


def near_duplicates(prints: DataFrame) -> DataFrame:
    """The rows of fingerprints() with component_id: the smallest doc_id that is reachable over links."""
    prints = cut(prints)
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fingerprint")))
    # the least id of each component that has links, given to its fingerprints
    member = roots.join(distinct.withColumnRenamed("fingerprint", "node"), "node")
    component = member.groupBy("root").agg(F.min("least").alias("component_least"))
    linked = member.join(component, "root").select(F.col("node").alias("fingerprint"), "component_least")
    labels = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_least", "least").alias("component_id"))
    # written first, so that both sides are dealt by this join alone and Spark can split the copies of one fingerprint
    return prints.join(cut(labels), "fingerprint", "left")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id for each document."""
    found = near_duplicates(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id (null only if no other is there), with all its columns.

    The one is chosen among narrow rows by id and a hash of the whole row; rows that are equal in all columns become one
    where they are read, before anything is shuffled.
    """
    row, more = (fresh(docs, x) for x in ("simhash_row", "simhash_more"))
    hashed = [docs[c] for c, kind in docs.dtypes if "map<" not in kind]
    whole = docs.withColumns({row: F.xxhash64(*hashed), more: F.hash(*hashed)})
    found = near_duplicates(fingerprints(whole.select("doc_id", "text", F.col(row).alias("row"), F.col(more).alias("more")), "row", "more"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "more")
    # by component, or by fingerprint where no member has an id
    kept = (
        found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone"))
        .agg(F.min(order).alias("first"))
        .select(F.col("first")["row"].alias(row), F.col("first")["more"].alias(more))
        .distinct()
    )
    # the texts are shuffled once, by the two hashes; a partial aggregate leaves one of equal rows in each task
    return whole.dropDuplicates([row, more]).join(kept, [row, more], "left_semi").select(*docs.columns)
