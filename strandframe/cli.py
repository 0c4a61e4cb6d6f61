"""Command line: index, smooth, search, call, run and script."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import absent
from .plans import stages
from .session import session
from .sources import bam, reports, sequences, strings_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandframe", description="Structural variants from long reads on Spark.")
    modes = top.add_subparsers(dest="mode", required=True)

    def mode(name: str, text: str, *needs: str) -> argparse.ArgumentParser:
        p = modes.add_parser(name, help=text, description=text)
        for need in needs:
            p.add_argument(f"--{need}", required=True)
        p.add_argument("--compat", action="store_true", help="mimic known quirks of greedy steps")
        return p

    def ignored(p: argparse.ArgumentParser, *flags: str) -> None:
        p.add_argument(*flags, help="accepted; Spark decides")

    p = mode("index", "genome and suffix-array shards of both strands", "reference", "out")
    p.add_argument("--longest", type=int, default=absent.LONGEST, help="longest read that searches may have")
    ignored(p, "--threads", "-t")
    p = mode("smooth", "undo small differences of reads", "reference", "bam", "out")
    p.add_argument("--min-mapq", type=int, default=20)
    p.add_argument("--accp", type=float, default=0.98)
    for flag in ("--threads", "--bsize"):
        ignored(p, flag)
    p = mode("search", "strings of reads that the genome does not hold", "index", "out")
    p.add_argument("--bam")
    p.add_argument("--fastx")
    p.add_argument("--noputative", action="store_true")
    p.add_argument("--noassemble", action="store_true")
    p.add_argument("--overlap", type=int, choices=(-1, 0), default=-1, help="0: strings from the right that don't overlap")
    for flag in ("--threads", "--bsize", "--omax"):
        ignored(p, flag)
    for name, needs in (("call", ("reference", "bam", "sfs", "out")), ("run", ("reference", "bam", "out"))):
        p = mode(name, "variants" if name == "call" else "all stages", *needs)
        p.add_argument("--poa", help="write consensus alignments here")
        p.add_argument("--clusters", help="write clusters here")
        p.add_argument("--min-cluster-weight", type=int, default=2)
        p.add_argument("--min-sv-length", type=int, default=25)
        p.add_argument("--min-mapq", type=int, default=20)
        p.add_argument("-l", type=float, default=0.97, dest="length_ratio")
        p.add_argument("--noht", action="store_true")
        p.add_argument("--clipped", action="store_true")
        p.add_argument("--genotype", action="store_true", help="genotypes and allele frequencies by the reads at each call")
        p.add_argument("--accp", type=float, default=0.98)
        for flag in ("--threads", "--bsize"):
            ignored(p, flag)
    p = mode("script", "all stages, with files of each in a folder: smoothed.bam, specifics.txt, variations-final.vcf")
    p.add_argument("reference")
    p.add_argument("bam")
    p.add_argument("-w", default=".", dest="out", help="folder of the results")
    p.add_argument("-i", dest="index", help="use this index, or store it here (default: the reference's path and .index)")
    p.add_argument("-q", type=int, default=20, dest="min_mapq")
    p.add_argument("-p", type=float, default=0.98, dest="accp")
    p.add_argument("-s", type=int, default=2, dest="min_cluster_weight")
    p.add_argument("-l", type=int, default=50, dest="min_sv_length")
    p.add_argument("-t", action="store_true", dest="noht", help="do not consider haplotype tags")
    p.add_argument("-v", action="version", version="strandframe")
    for flag in ("-@", "-x", "-k", "-r"):
        p.add_argument(flag, dest="ignored", help="accepted; not needed")
    return top


def config_of(args: argparse.Namespace) -> Config:
    given = vars(args)
    names = {"min_mapq": "min_mapq", "accp": "accuracy_quantile", "min_cluster_weight": "min_cluster_weight", "min_sv_length": "min_sv_length", "length_ratio": "length_ratio", "clipped": "clipped", "genotype": "genotype", "compat": "compat"}
    options = {field: given[name] for name, field in names.items() if name in given}
    return Config(**options, relaxed=given.get("overlap", -1) == 0, assemble=not given.get("noassemble", False), putative=not given.get("noputative", False), use_haplotypes=not given.get("noht", False))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    return bam.read_bam(spark, path) if path.endswith(".bam") else spark.read.parquet(path)


def genome(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a FASTA file, of Parquet, or of an index."""
    if path.endswith(".index"):
        return spark.read.parquet(f"{path}/contigs")
    return spark.read.parquet(path) if path.endswith(".parquet") else sequences.read_fasta(spark, path)


def build_index(spark: SparkSession, reference: str, path: str, longest: int) -> None:
    sequences.read_fasta(spark, reference).write.parquet(f"{path}/contigs")
    stages.index(spark.read.parquet(f"{path}/contigs"), f"{path}/shards", longest)


def save_alignments(frame: DataFrame, contigs: DataFrame, path: str, source: str) -> None:
    """As BAM with the header of the source, if that is BAM too, or as Parquet."""
    if path.endswith(".bam"):
        names = [(r["chrom"], r["length"]) for r in contigs.select("chrom", "length", "contig_idx").orderBy("contig_idx").collect()]
        bam.write_bam(frame, names, path, bam.header_text(source) if source.endswith(".bam") else "")
    else:
        frame.repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(path)


def report(found: dict[str, DataFrame], contigs: DataFrame, args: argparse.Namespace) -> None:
    reports.write_vcf(found["svs"], contigs, args.out)
    if args.poa:
        reports.write_sam(found["consensus"], contigs, args.poa)
    if args.clusters:
        reports.write_clusters(found["clusters"], args.clusters)


def script(spark: SparkSession, args: argparse.Namespace, config: Config) -> int:
    """All stages from files to files; an index that is there already is used."""
    index = args.index or f"{args.reference}.index"
    try:
        contigs = spark.read.parquet(f"{index}/contigs")
    except AnalysisException:
        build_index(spark, args.reference, index, absent.LONGEST)
        contigs = spark.read.parquet(f"{index}/contigs")
    found = stages.run(alignments(spark, args.bam), contigs, replace(config, genotype=True), f"{index}/shards")
    save_alignments(found["smoothed"], contigs, f"{args.out}/smoothed.bam", args.bam)
    strings_text.write_strings(found["strings"], f"{args.out}/specifics.txt")
    reports.write_vcf(found["svs"], contigs, f"{args.out}/variations-final.vcf")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark, config = session(), config_of(args)
    if args.mode == "index":
        build_index(spark, args.reference, args.out, args.longest)
        return 0
    if args.mode == "script":
        return script(spark, args, config)
    contigs = genome(spark, args.reference) if args.mode != "search" else None
    if args.mode == "smooth":
        save_alignments(stages.smooth(alignments(spark, args.bam), contigs, config), contigs, args.out, args.bam)
    elif args.mode == "search":
        if not args.bam and not args.fastx:
            print("search needs --bam or --fastx", file=sys.stderr)
            return 1
        reads = alignments(spark, args.bam) if args.bam else sequences.read_fastx(spark, args.fastx)
        strings_text.write_strings(stages.search(reads, f"{args.index}/shards", config), args.out)
    elif args.mode == "call":
        report(stages.call(alignments(spark, args.bam), strings_text.read_strings(spark, args.sfs), contigs, config), contigs, args)
    else:
        report(stages.run(alignments(spark, args.bam), contigs, config), contigs, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
