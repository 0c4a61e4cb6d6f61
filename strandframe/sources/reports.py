"""VCF, SAM and cluster text of calls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import resolve

# The header's declarations.
VCF_HEAD = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
{contigs}##INFO=<ID=VARTYPE,Number=A,Type=String,Description="Variant class">
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Variant type">
##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="Difference in length between REF and ALT alleles">
##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant">
##INFO=<ID=WEIGHT,Number=1,Type=Integer,Description="Number of alignments supporting this record">
##INFO=<ID=COV,Number=1,Type=Integer,Description="Total number of alignments covering this locus">
##INFO=<ID=COV0,Number=1,Type=Integer,Description="Alignments without haplotype covering this locus">
##INFO=<ID=COV1,Number=1,Type=Integer,Description="Alignments of haplotype 1 covering this locus">
##INFO=<ID=COV2,Number=1,Type=Integer,Description="Alignments of haplotype 2 covering this locus">
##INFO=<ID=AS,Number=1,Type=Integer,Description="Alignment score">
##INFO=<ID=NV,Number=1,Type=Integer,Description="Number of variants on same consensus">
##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="Imprecise variant">
##INFO=<ID=CIGAR,Number=A,Type=String,Description="CIGAR of consensus">
##INFO=<ID=READS,Number=.,Type=String,Description="Reads supporting this call">
##INFO=<ID=RVEC,Number=1,Type=String,Description="Support and haplotype of the reads at this locus">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">
##FORMAT=<ID=VAF,Number=A,Type=Float,Description="Share of the reads that support the allele">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tDEFAULT"""


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("."))


def vcf_lines(svs: DataFrame) -> DataFrame:
    """chrom, s and value for each variant."""
    name = F.concat("kind", F.lit("_"), "chrom", F.lit(":"), text("s"), F.lit("-"), text("e"), F.lit("_"), text("l"))
    length = F.when(F.col("kind") == "DEL", -F.col("l")).otherwise(F.col("l"))
    fields = [("VARTYPE", F.lit("SV")), ("SVTYPE", text("kind")), ("SVLEN", length.cast("string")), ("END", text("e")), ("WEIGHT", text("w")), ("COV", text("cov")), ("COV0", text("cov0")), ("COV1", text("cov1")), ("COV2", text("cov2")), ("AS", text("score")), ("NV", text("nv")), ("CIGAR", text("cigar")), ("READS", text("reads")), ("RVEC", text("rvec"))]
    info = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in fields), F.when(F.col("imprecise"), F.lit("IMPRECISE")))
    genotyped = {"gt", "gq", "vaf"} <= set(svs.columns)
    sample = [F.lit("GT:GQ:VAF"), F.concat_ws(":", text("gt"), text("gq"), text("vaf"))] if genotyped else [F.lit("GT:GQ"), F.lit("0/1:100")]
    return svs.select("chrom", "s", F.concat_ws("\t", text("chrom"), text("s"), name, text("ref"), text("alt"), F.lit("."), F.lit("PASS"), info, *sample).alias("value"))


def vcf_header(contigs: DataFrame) -> str:
    """Gathers names and lengths of the contigs, which are few."""
    rows = contigs.select("chrom", "length").orderBy("contig_idx" if "contig_idx" in contigs.columns else "chrom").collect()
    return VCF_HEAD.format(contigs="".join(f"##contig=<ID={r['chrom']},length={r['length']}>\n" for r in rows))


def write_lines(rows: DataFrame, order: list[str], path: str, head: str = "") -> None:
    """The values of rows in order, after head. A path that ends in a suffix names one file, which the driver writes line by
    line as sorted parts come in, a part at a time; any other a folder of part files, the first of which begins with head."""
    if re.search(r"\.\w+$", path):
        system, inner = resolve(path)
        with system.open_output_stream(inner) as f:
            f.write((head + "\n").encode() if head else b"")
            for row in rows.orderBy(*order).select("value").toLocalIterator():
                f.write((row["value"] + "\n").encode())
        return
    body = rows.select(F.lit(1).alias("head_first"), *order, *([] if "value" in order else ["value"]))
    if head:
        first = rows.sparkSession.createDataFrame([(0, head)], "head_first int, value string")
        body = first.unionByName(body, allowMissingColumns=True)
    body.orderBy("head_first", *order).select("value").write.text(path)


def write_vcf(svs: DataFrame, contigs: DataFrame, path: str) -> None:
    write_lines(vcf_lines(svs), ["chrom", "s", "value"], path, vcf_header(contigs))


def sam_lines(consensus: DataFrame) -> DataFrame:
    name = F.concat("chrom", F.lit(":"), (F.col("s") + 1).cast("string"), F.lit("-"), (F.col("e") + 1).cast("string"))
    return consensus.select("chrom", "s", F.concat_ws("\t", name, F.lit("0"), "chrom", (F.col("s") + 1).cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")).alias("value"))


def write_sam(consensus: DataFrame, contigs: DataFrame, path: str) -> None:
    rows = contigs.select("chrom", "length").orderBy("contig_idx" if "contig_idx" in contigs.columns else "chrom").collect()
    head = "@HD\tVN:1.4\n" + "\n".join(f"@SQ\tSN:{r['chrom']}\tLN:{r['length']}" for r in rows)
    write_lines(sam_lines(consensus), ["chrom", "s", "value"], path, head)


def cluster_lines(filled: DataFrame) -> DataFrame:
    name = F.concat("chrom", F.lit(":"), (F.col("s") + 1).cast("string"), F.lit("-"), (F.col("e") + 1).cast("string"))
    members = F.array_join(F.transform("subreads", lambda x: F.concat(x["name"], F.lit(":"), x["seq"])), "\t")
    return filled.select("chrom", "s", F.concat_ws("\t", name, F.size("subreads").cast("string"), members).alias("value"))


def write_clusters(filled: DataFrame, path: str) -> None:
    write_lines(cluster_lines(filled), ["chrom", "s", "value"], path)
