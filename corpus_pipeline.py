"""A corpus from raw documents to token ids, in stages; each stage's result is written and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import bpe, decontam, pii, quality, simhash
from strandframe.llm.queries import BYTE_RANKS, table
from strandframe.llm.util import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with all their columns.

    Null and empty texts have no words and go; a null or unknown lang is one language of its own; very long texts are
    judged whole; repeated rows are judged each by itself, and so stay or go together; ties don't arise; an empty table
    stays empty; columns of any name pass unchanged.
    """
    return quality.keep_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: that of the smallest id.

    Null and empty texts are one group; a null id is taken only where the group has no other, and of rows that share
    the id one is taken by a hash of the row; repeated rows become one; very long texts count whole; an empty table stays
    empty; columns of any name pass unchanged.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark: text and n_chars change, all rows and other columns stay.

    Null and empty texts have no words and stay as they are, a null n_chars becomes a number only where its text is cut;
    null or empty items hit nothing, items without an id do; very long texts are searched whole; repeated rows change
    alike; overlapping passages are cut as one; an empty table stays empty; columns of any name pass unchanged.
    """
    return decontam.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by kind: text and n_chars change, all rows and other columns stay.

    Null and empty texts stay as they are; of spans that overlap the first, or else the longest, names the mask; very
    long texts are read whole; repeated rows change alike; an empty table stays empty; columns of any name pass unchanged.
    """
    return pii.mask_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip and ids of each document; the last stage, so the other
    columns go.

    Null and empty texts have no ids; a null doc_id stays null; very long texts are encoded whole; repeated rows give a
    row each; ties don't arise; an empty table gives no rows; columns of clashing names are among those that go.
    """
    return bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL has no merges of byte-level BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Results between stages stay in the shared folder of checkpoints."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
