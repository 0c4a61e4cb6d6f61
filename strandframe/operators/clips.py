"""Imprecise variants from clipped alignments; all steps by contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import proximity_clusters
from .relational import asof_forward, full_dedup, interval_anti_join

REACH, MIN_WEIGHT = 1000, 2
MAX_INSERTION_GAP, MIN_DELETION, MAX_DELETION, MIN_DELETION_WEIGHT = 1000, 2000, 50_000, 5


def combine_clips(clips: DataFrame, contigs: DataFrame) -> DataFrame:
    """One clip a read and side, then one row a place: largest length and number of reads; light ones go."""
    once = full_dedup(clips, ["name", "starting"], ["chrom", "p", "l"])
    known = once.join(contigs.select("chrom"), "chrom", "left_semi")
    return known.groupBy("chrom", "p", "starting").agg(F.max("l").alias("l"), F.count("*").alias("w")).where(F.col("w") >= MIN_WEIGHT)


def far_from(clips: DataFrame, variants: DataFrame) -> DataFrame:
    """Clips that lie within reach of no precise variant."""
    spans = variants.select("chrom", (F.col("s") - REACH).alias("span_s"), (F.col("e") + REACH).alias("span_e"))
    return interval_anti_join(clips, spans, ["chrom"], "p", ("span_s", "span_e"), width=4 * REACH)


def imprecise_variants(clips: DataFrame, contigs: DataFrame, variants: DataFrame) -> DataFrame:
    """chrom, s, e, kind, l, w: insertions between a left clip and the next right one, deletions the other way round."""
    kept = far_from(combine_clips(clips, contigs), variants).withColumn("side", F.when(F.col("starting"), "left").otherwise("right"))
    centres = proximity_clusters(kept.select("chrom", "side", "p", "l", "w"), ["chrom", "side"], "p", "w", "l", ["p", "l", "w"], REACH)
    left, right = (centres.where(F.col("side") == s).select("chrom", "p", "l", "w") for s in ("left", "right"))
    insertions = asof_forward(left, right, ["chrom"], "p", ["l", "w"]).where(F.col("next_p") - F.col("p") < MAX_INSERTION_GAP)
    heavier = F.when(F.col("w") > F.col("next_w"), F.col("p")).otherwise(F.col("next_p"))
    ins = insertions.select("chrom", heavier.alias("s"), heavier.alias("e"), F.lit("INS").alias("kind"), F.greatest("l", "next_l").alias("l"), F.greatest("w", "next_w").alias("w"))
    gap = F.col("next_p") - F.col("p")
    deletions = asof_forward(right, left, ["chrom"], "p", ["l", "w"]).where((gap >= MIN_DELETION) & (gap <= MAX_DELETION) & (F.greatest("w", "next_w") >= MIN_DELETION_WEIGHT))
    dels = deletions.select("chrom", F.col("p").alias("s"), F.col("next_p").alias("e"), F.lit("DEL").alias("kind"), (gap + 1).alias("l"), F.greatest("w", "next_w").alias("w"))
    return ins.unionByName(dels)
