"""Smoothing, searching and event queries as Structured Streaming.

After its threshold is known, smoothing is row-local but for the join with the reference, and searching is row-local:
both run on batches of a stream through foreachBatch with the batch functions, which keeps one definition of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans import stages


def stream_smooth(alignments: DataFrame, contigs: DataFrame, threshold: DataFrame, path: str, checkpoint: str, config: Config | None = None, **trigger) -> StreamingQuery:
    """Smooths a stream of alignments into Parquet below path; each batch has a folder of its own, so that a batch that
    is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        stages.smooth(rows, contigs, config, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alignments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_search(reads: DataFrame, contigs: DataFrame, path: str, checkpoint: str, config: Config | None = None, **trigger) -> StreamingQuery:
    """Searches a stream of reads for specific strings into Parquet below path."""

    def batch(rows: DataFrame, number: int) -> None:
        stages.search(rows, contigs, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def coverage_windows(alignments: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Running coverage by contig, bin and haplotype of a stream or table of alignments: a partial aggregate by batch."""
    hp = F.coalesce(F.col("hp"), F.lit(0))
    return alignments.where(stages.primary()).groupBy("chrom", F.floor(F.col("pos") / bin_size).alias("bin")).agg(*(F.count_if(hp == h).alias(f"cov{h}") for h in (0, 1, 2)), F.count("*").alias("cov"))
