"""The command line over files, and streams of reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.config import Config
from strandframe.plans import stages
from strandframe.sources import bam, strings_text
from strandframe.streaming import reads as streaming

from .test_engine import READ, bases, reads_of


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    rnd = random.Random(2)
    genome = {"k": bases(rnd, 3000)}
    rows = reads_of(rnd, genome, {"k": [(1500, "I", bases(rnd, 50))]}, depth=5)
    (folder / "g.fa").write_text("".join(f">{c}\n{s}\n" for c, s in genome.items()))
    frame = spark.createDataFrame(rows, READ)
    text = "@HD\tVN:1.6\n@SQ\tSN:k\tLN:3000\n@RG\tID:one\n"
    bam.write_bam(frame.withColumn("aux", F.lit(b"RGZone\0")), [(c, len(s)) for c, s in genome.items()], str(folder / "x.bam"), text)
    frame.repartition(3).write.parquet(str(folder / "x.parquet"))
    return folder


def body(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect() if not r["value"].startswith("#")]


def test_stages_by_command(spark, files):
    at = lambda name: str(files / name)
    assert cli.main(["index", "--reference", at("g.fa"), "--out", at("g.index")]) == 0
    assert cli.main(["smooth", "--reference", at("g.fa"), "--bam", at("x.bam"), "--out", at("s.bam")]) == 0
    assert cli.main(["search", "--index", at("g.index"), "--bam", at("s.bam"), "--out", at("sfs")]) == 0
    assert bam.header_text(at("s.bam")) == bam.header_text(at("x.bam")) and "@RG\tID:one" in bam.header_text(at("s.bam"))
    assert {bytes(r["aux"])[:7] for r in bam.read_bam(spark, at("s.bam")).collect()} == {b"RGZone\0"}
    assert cli.main(["call", "--reference", at("g.fa"), "--bam", at("s.bam"), "--sfs", at("sfs"), "--out", at("vcf"), "--threads", "4", "-l", "0.9", "--clusters", at("cl"), "--poa", at("poa")]) == 0
    assert cli.main(["run", "--reference", at("g.index"), "--bam", at("x.parquet"), "--out", at("vcf2")]) == 0
    (line,) = body(spark, files / "vcf")
    assert "SVTYPE=INS;SVLEN=50" in line and body(spark, files / "vcf2") == [line]
    assert cli.main(["search", "--index", at("g.index"), "--out", at("none")]) == 1
    assert cli.main(["search", "--index", at("g.index"), "--bam", at("s.bam"), "--out", at("apart"), "--overlap", "0", "--noassemble", "--omax", "5"]) == 0
    apart = strings_text.read_strings(spark, at("apart")).groupBy("qname").agg(F.array_sort(F.collect_list(F.struct("qs", "l"))).alias("s")).collect()
    assert apart and all(a["qs"] + a["l"] <= b["qs"] for r in apart for a, b in zip(r["s"], r["s"][1:]))


def test_script(spark, files):
    out = files / "out"
    out.mkdir()
    for _ in range(2):  # the second time the index is there
        assert cli.main(["script", str(files / "g.fa"), str(files / "x.bam"), "-w", str(out), "-l", "40", "-@", "4", "-q", "10"]) == 0
    (line,) = [x for x in (out / "variations-final.vcf").read_text().splitlines() if x[0] != "#"]
    assert "SVTYPE=INS;SVLEN=50" in line and line.split("\t")[-2:] == ["GT:GQ:VAF", "0/1:2:0.6"]
    assert (out / "variations-final.vcf").read_text().startswith("##fileformat=VCFv4.2\n") and (out / "specifics.txt").read_text().startswith("rk_")
    assert bam.read_bam(spark, str(out / "smoothed.bam")).count() > 0


def test_streams(spark, files):
    contigs = cli.genome(spark, str(files / "g.fa"))
    batch = spark.read.parquet(str(files / "x.parquet"))
    threshold = stages.mismatch_threshold(batch, contigs, Config())
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(files / "x.parquet"))
    streaming.stream_smooth(stream, contigs, threshold, str(files / "smooth"), str(files / "cp1")).awaitTermination()
    smoothed = spark.read.parquet(str(files / "smooth"))
    want = stages.smooth(batch, contigs)
    assert sorted(map(str, smoothed.select("ord", "seq", "xf").collect())) == sorted(map(str, want.select("ord", "seq", "xf").collect()))
    reads = smoothed.drop("batch")
    stream = spark.readStream.schema(reads.schema).parquet(str(files / "smooth") + "/batch=*")
    streaming.stream_search(stream, contigs, str(files / "found"), str(files / "cp2")).awaitTermination()
    found = spark.read.parquet(str(files / "found")).drop("batch")
    assert sorted(map(str, found.collect())) == sorted(map(str, stages.search(want, contigs).collect())) and found.count() > 0
    cover = streaming.coverage_windows(batch).agg(F.sum("cov")).first()[0]
    assert cover == batch.count()
