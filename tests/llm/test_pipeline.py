"""run() of the pipeline against its stages done by plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from strandframe.llm import bpe, pii, quality
from strandframe.llm.queries import BYTE_RANKS

from .test_llm import DOCS, brute_components, brute_contamination, brute_print, clean_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, copies, repeated rows and ties, and columns whose
    names clash with those that stages add."""
    rnd = random.Random(3)
    texts = clean_texts(rnd, 150)
    phrase = " ".join(f"leak{i}" for i in range(14))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(200, texts[0], "en", "t", 1), (201, texts[0], None, None, None), (202, texts[1] + " and so on", "en", "s", None), rows[5], rows[5], rows[6]]
    rows += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, " \n ", None, "s", 3), (None, texts[20] + " twice told", "en", "s", 9), (None, None, None, None, None)]
    rows += [(400, texts[30] + " " + phrase + " " + texts[31], "en", "s", 9), (401, f"{texts[32]} {' '.join(phrase.split()[:7])} {phrase} {' '.join(phrase.split()[7:])} {texts[33]}", "en", "s", 9)]
    rows += [(402, texts[40] + " mail a.b@c.de and 10.0.0.1 please " + texts[41], "en", "s", 9), (403, " ".join(clean_texts(rnd, 300)), "en", "s", 9), (404, "junk### " * 5 + " | ".join(f"w{i}" for i in range(300)), "en", "s", 9)]
    folder = str(tmp_path_factory.mktemp("edges"))
    more = "'x' as cut, 1 as simhash_row, 2 as kept, 'y' as spans, 3 as fingerprint"
    spark.createDataFrame(rows, DOCS).selectExpr("*", *more.split(", ")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, phrase), (2, None), (None, ""), (1, phrase)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def check_pipeline(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    references = quality.language_references(table)
    verdicts = quality.judge([d[2] for d in docs], [None if d[1] is None else d[1].encode() for d in docs], references)
    docs = [d for d, v in zip(docs, verdicts) if v[6]]
    found = brute_components([(d[0], brute_print(d[1])) for d in docs])
    groups = {}
    for d, c in zip(docs, found):
        groups.setdefault(("none", d[1]) if c is None else c, []).append(d)
    kept = {}
    for group in groups.values():
        least = min((d[0] for d in group if d[0] is not None), default=None)
        kept[least] = {d[1] for d in group if d[0] == least}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(kept)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_RANKS), special_tokens={})
    for doc_id, texts in kept.items():
        decoded = own.decode([int(i) for i in got[doc_id]["ids"]])
        assert got[doc_id]["round_trip"] and got[doc_id]["n_tokens"] == len(got[doc_id]["ids"])
        assert not brute_contamination(decoded, items)[4] and not pii.base_spans(decoded)
        (text, *_) = texts
        if len(texts) == 1 and not brute_contamination(text, items)[4] and not pii.find_spans(text):
            ids = own.encode_ordinary(text)
            assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return got


def test_pipeline(spark):
    check_pipeline(spark, SF)


def test_pipeline_edges(spark, edges):
    got = check_pipeline(spark, edges)
    assert {*range(150), 400, 401, 402, 403} <= set(got) and not {200, 201, 300, 301, 302, 404} & set(got)


def test_stages_keep_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, edges).dtypes == docs.dtypes, name


def test_stages_of_an_empty_table(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, edges).count() == 0, name


def test_stages_are_the_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert all(f.__doc__ and "null" in f.__doc__.lower() for _, f in corpus_pipeline.STAGES)
