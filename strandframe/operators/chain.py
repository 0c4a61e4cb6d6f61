"""Dedup and chain filter of called variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.text import ratio
from .folds import cut_at_gaps, fold_groups
from .relational import consecutive_dedup, full_dedup

#: Bounds within which a variant is taken for the one before it.
MAX_START_GAP, MIN_WEIGHT_RATIO, LENGTH_RATIO, MIN_SIMILARITY = 100, 0.9, 0.97, 70.0


def dedup_variants(variants: DataFrame, compat: bool = False) -> DataFrame:
    """One of the variants of equal place and alleles, the heaviest; compat drops only those next to each other."""
    if compat:
        return consecutive_dedup(variants, ["chrom"], ["s", "ref", "alt", "w", "cluster_id", "sub_id"], ["s", "ref", "alt"])
    return full_dedup(variants, ["chrom", "s", "ref", "alt"], [F.desc("w"), "cluster_id", "sub_id"])


def alike(a: tuple, b: tuple, length_ratio: float = LENGTH_RATIO) -> bool:
    """a, b: kind, s, e, l, w, ref, alt; b comes after a."""
    if a[0] != b[0] or not (b[1] - a[2] < 2 * b[3] and b[1] - a[1] < MAX_START_GAP):
        return False
    if min(a[4], b[4]) < MIN_WEIGHT_RATIO * max(a[4], b[4]) or min(a[3], b[3]) < length_ratio * max(a[3], b[3]):
        return False
    k = 5 if a[0] == "DEL" else 6
    return ratio(a[k], b[k]) > MIN_SIMILARITY


def chain(rows: list[tuple], compat: bool = False, length_ratio: float = LENGTH_RATIO) -> list[int]:
    """Indices that stay. A row alike the one before it is merged with it, the heavier (else the earlier) stays, and the
    scan starts anew after them. compat tells the earlier of a last merged pair again."""
    out: list[int] = []
    before: int | None = None
    for i, row in enumerate(rows):
        if before is None:
            before = i
        elif alike(rows[before], row, length_ratio):
            out.append(before if rows[before][4] >= row[4] else i)
            if compat and i == len(rows) - 1:
                out.append(before)
            before = None
        else:
            out.append(before)
            before = i
    if before is not None:
        out.append(before)
    return out


def chain_filter(variants: DataFrame, compat: bool = False, length_ratio: float = LENGTH_RATIO) -> DataFrame:
    """Merges neighbours that tell the same variant, by contig. Parts of a contig between which no two rows could be taken
    for one are folded apart, but for compat, which looks at the last row of a contig."""

    def fold(*columns: list) -> tuple[list[int], list[list]]:
        return chain(list(zip(*columns)), compat, length_ratio), []

    order = ["s", "e", "kind", "ref", "alt", "w", "cluster_id", "sub_id"]
    parted = variants.withColumn("chain_part", F.lit(0)) if compat else cut_at_gaps(variants, ["chrom"], "s", "s", MAX_START_GAP - 1, "chain_part")
    return fold_groups(parted, ["chrom", "chain_part"], order, ["kind", "s", "e", "l", "w", "ref", "alt"], fold).drop("chain_part")
