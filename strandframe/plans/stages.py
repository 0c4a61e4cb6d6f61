"""The stages: smooth, search, place, cluster, fill and call, each from DataFrames to a DataFrame.

Alignments: ord, qname, flag, chrom, pos, mapq, cigar (text), seq, qual (binary), hp, xf, and what of EXTRA a file has.
Contigs: chrom, seq, length. What several later steps read is computed once and kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..config import Config
from ..functions import cigar
from ..functions.sequence import normalise_bases
from ..kernels import align, placement, poa, smoothing, splitting, variants
from ..operators import absent, chain, clips, folds, genotype, relational
from ..session import keep

SECONDARY = 4 | 256 | 2048
CHUNK = 16_384
#: Columns of alignments that smoothing passes on as they are.
EXTRA = {"aux": "binary", "mate_chrom": "string", "mate_pos": "int", "tlen": "int"}


def primary(flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(SECONDARY) == 0


def parse_ops(text: str | None) -> list[tuple[int, str]]:
    out, n = [], 0
    for c in text or "":
        if c.isdigit():
            n = 10 * n + int(c)
        elif c != "*":
            out.append((n, c))
            n = 0
    return out


def ops_text(ops: list[tuple[int, str]]) -> str:
    return "".join(f"{n}{op}" for n, op in ops) or "*"


def map_rows(df: DataFrame, columns: list[str], rows: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """rows(*values) gives any number of output rows for each input row."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [r for v in zip(*(c.to_pylist() for c in part.columns)) for r in rows(*v)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(stream, schema)


def with_reference(alignments: DataFrame, contigs: DataFrame, out: str = "ref", key: str = "ord") -> DataFrame:
    """Adds the slice of the reference that each alignment covers. The reference is joined in chunks by contig and place,
    so that no task and no broadcast needs a whole genome; alignments of unknown contigs go."""
    chunks = contigs.select(
        F.col("chrom").alias("chunk_chrom"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("seq"), i * CHUNK + 1, F.lit(CHUNK)))).alias("chunk", "bases"),
    )
    span = cigar.reference_length(cigar.parse_cigar(F.col("cigar")))
    places = alignments.select(key, "chrom", "pos", span.alias("span")).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("pos") / CHUNK).cast("int"), F.floor((F.col("pos") + F.greatest("span", F.lit(1)) - 1) / CHUNK).cast("int"))))
    joined = places.join(chunks, (F.col("chrom") == F.col("chunk_chrom")) & (places["chunk"] == chunks["chunk"])).select(key, "pos", "span", places["chunk"], "bases")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda c: c["bases"]), "")
    slices = joined.groupBy(key, "pos", "span").agg(whole.alias("all"), F.min("chunk").alias("first"))
    slices = slices.select(key, F.expr(f"substring(all, pos - first * {CHUNK} + 1, span)").alias(out))
    return alignments.join(slices, key)


def mismatch_threshold(alignments: DataFrame, contigs: DataFrame, config: Config) -> DataFrame:
    """One row: the quantile of mismatch ratios over the first reads in file order."""
    first = alignments.where(primary() & (F.col("mapq") >= config.min_mapq) & (F.length("seq") >= 2)).join(contigs.select("chrom"), "chrom", "left_semi")
    return ratio_threshold(with_reference(first.orderBy("ord").limit(config.accuracy_reads), contigs), config)


def ratio_threshold(rows: DataFrame, config: Config) -> DataFrame:
    """One row: the quantile of mismatch ratios of alignments that have their slice of the reference in ref."""

    def counted(text: str, seq: str, ref: str) -> Iterator[tuple]:
        same, other = smoothing.mismatch_counts(parse_ops(text), seq, ref)
        if same or other:
            yield (other / same if same else float("inf"),)

    return map_rows(rows, ["cigar", "seq", "ref"], counted, "ratio double").agg(F.percentile("ratio", config.accuracy_quantile).alias("threshold"))


def smooth(alignments: DataFrame, contigs: DataFrame, config: Config | None = None, threshold: DataFrame | None = None) -> DataFrame:
    """Alignments with small differences undone and xf set: 0 smoothed, 1 dirty, 2 nothing long, 3 inconsistent."""
    config = config or Config()
    threshold = mismatch_threshold(alignments, contigs, config) if threshold is None else threshold
    kept = alignments.where(primary() & (F.col("mapq") >= config.min_mapq) & (F.length("seq") >= 2))
    return smooth_rows(with_reference(kept, contigs).crossJoin(F.broadcast(threshold)), config)  # one row


def smooth_rows(rows: DataFrame, config: Config) -> DataFrame:
    """Alignments that have their slice of the reference in ref, and threshold."""
    extra = [c for c in EXTRA if c in rows.columns]

    def smoothed(ord_: int, qname: str, flag: int, chrom: str, pos: int, mapq: int, text: str, seq: str, qual: bytes, hp: int, ref: str, most: float, *more: object) -> Iterator[tuple]:
        xf, seq, qual, ops = smoothing.smooth(parse_ops(text), seq, qual or b"", ref, most, config.min_indel_length, config.compat)
        yield ord_, qname, flag, chrom, pos, mapq, ops_text(ops), seq, qual, hp, xf, *more

    columns = ["ord", "qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "hp", "ref", "threshold", *extra]
    schema = "ord long, qname string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual binary, hp int, xf int"
    return map_rows(rows, columns, smoothed, ", ".join([schema, *(f"{c} {EXTRA[c]}" for c in extra)]))


def both_strands(contigs: DataFrame) -> DataFrame:
    forward = contigs.select(normalise_bases(F.col("seq")).alias("seq"))
    return forward.unionByName(forward.select(F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("seq")))


def index(contigs: DataFrame, path: str, longest: int = absent.LONGEST) -> str:
    """An index of both strands of the genome below path, for searches of reads of at most `longest` bases."""
    return absent.build_index(both_strands(contigs), "seq", path, longest)


def search(reads: DataFrame, genome: DataFrame | str, config: Config | None = None) -> DataFrame:
    """qname, qs, l, htag: the shortest strings of each read that neither strand of the genome holds, merged where they
    overlap. reads: ord, qname, seq and, for alignments, flag, xf and hp. genome: contigs, or the path of an index."""
    config = config or Config()
    if "flag" in reads.columns:
        reads = reads.where(primary() & (F.length("seq") >= 100))
        if config.putative:
            reads = reads.where(F.coalesce("xf", F.lit(0)) == 0)
    tag = F.coalesce(F.col("hp"), F.lit(0)).cast("int") if "hp" in reads.columns else F.lit(0)
    bases = reads.select("ord", "qname", tag.alias("htag"), normalise_bases(F.col("seq")).alias("seq"))
    keys = ["ord", "qname", "htag"]
    if isinstance(genome, str):
        found = absent.search_index(bases, genome, keys, "seq", config.relaxed)
    else:
        found = absent.specific_strings(bases, both_strands(genome), keys, "seq", "seq", relaxed=config.relaxed)
    if config.assemble:
        found = absent.assemble(found, keys)
    return found.select("qname", F.col("qs").cast("int").alias("qs"), F.col("l").cast("int").alias("l"), "htag")


def specific_alignments(alignments: DataFrame, strings: DataFrame, config: Config) -> DataFrame:
    """Primary alignments of the least quality whose reads have strings, with these in order."""
    mine = strings.groupBy("qname").agg(F.array_sort(F.collect_list(F.struct("qs", "l"))).alias("strings"))
    return alignments.where(primary() & (F.col("mapq") >= config.min_mapq)).join(mine, "qname")


def place(alignments: DataFrame, strings: DataFrame, contigs: DataFrame, config: Config | None = None) -> DataFrame:
    """Extended strings (chrom, qname, rs, re, qs, qe, htag) and, with clip true, clips (p in rs, l in re)."""
    config = config or Config()
    rows = with_reference(specific_alignments(alignments, strings, config), contigs)

    def placed(qname: str, chrom: str, pos: int, text: str, hp: int, found: list, ref: str) -> Iterator[tuple]:
        spans, left, right = placement.place(parse_ops(text), pos, [(x["qs"], x["l"]) for x in found], ref, config.flank, config.ksize, config.compat)
        for rs, re, qs, qe in placement.merge_first(spans):
            yield chrom, qname, rs, re, qs, qe, hp or 0, False, None
        for clip, starting in ((left, True), (right, False)):
            if clip:
                yield chrom, qname, clip[0], clip[1], None, None, hp or 0, True, starting

    return map_rows(rows, ["qname", "chrom", "pos", "cigar", "hp", "strings", "ref"], placed, "chrom string, qname string, rs int, re int, qs int, qe int, htag int, clip boolean, starting boolean")


def cluster(extended: DataFrame, config: Config | None = None) -> DataFrame:
    """Clusters of extended strings: cluster_id, chrom, s, e and the names of at least min_cluster_weight reads."""
    config = config or Config()
    spans = extended.where("not clip").select("chrom", "qname", "rs", "re")
    distance = spans.agg(F.floor(F.coalesce(F.max(F.col("re") - F.col("rs")), F.lit(0)) * F.lit(1.1)).cast("long").alias("distance"))
    near = spans.crossJoin(F.broadcast(distance))  # one row
    # where more than the distance is free a new window begins in any case: parts of a contig are folded apart
    parted = folds.cut_at_gaps(near, ["chrom"], "rs", "re", F.col("distance"))
    windows = folds.anchored_windows(parted, ["chrom", "part"], "rs", "re", ["rs", "re", "qname"], "distance")
    islands = relational.overlap_islands(windows, ["chrom", "part", "window"], "rs", "re", ["qname"])
    grouped = islands.groupBy("chrom", "part", "window", "island").agg(F.min("rs").alias("s"), F.max("re").alias("e"), F.collect_set("qname").alias("names"))
    heavy = grouped.where(F.size("names") >= config.min_cluster_weight)
    return heavy.select(F.concat_ws(":", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), F.col("part").cast("string"), F.col("window").cast("string")).alias("cluster_id"), "chrom", "s", "e", "names")


def fill(clusters: DataFrame, alignments: DataFrame, config: Config | None = None, width: int = 1 << 16) -> DataFrame:
    """A row for each cluster: coverages by haplotype, the vector of reads at the locus, and the parts of reads that span
    it. The overlap join meets in bins of contig and place."""
    config = config or Config()
    end = F.col("pos") + F.greatest(cigar.reference_length(cigar.parse_cigar(F.col("cigar"))), F.lit(1)) - 1
    # regions are told by numbers from 0 but read as from 1: a read must reach beyond s - 1 and begin before e
    reads = alignments.where(primary() & (F.col("mapq") >= config.min_mapq)).select("chrom", "ord", "qname", "pos", "cigar", "seq", F.coalesce("hp", F.lit(0)).alias("hp"), F.col("pos").alias("a"), end.alias("b"))
    spans = clusters.select("cluster_id", "chrom", "s", "e", "names", (F.col("s") - 1).alias("cs"), (F.col("e") - 1).alias("ce"))
    hits = relational.interval_join(spans, reads, ["chrom"], ("cs", "ce"), ("a", "b"), width)

    def part(cluster_id: str, chrom: str, s: int, e: int, ord_: int, qname: str, pos: int, text: str, seq: str, hp: int, mine: bool) -> Iterator[tuple]:
        sub = placement.subread(parse_ops(text), pos, seq, s, e) if mine else None
        yield cluster_id, chrom, s, e, ord_, pos, qname, hp, int(mine), sub

    columns = hits.withColumn("mine", F.array_contains("names", F.col("qname"))).select("cluster_id", "chrom", "s", "e", "ord", "qname", "pos", "cigar", "seq", "hp", "mine")
    parts = map_rows(columns, columns.columns, part, "cluster_id string, chrom string, s int, e int, ord long, pos int, qname string, hp int, has_sfs int, sub string")
    place_ = F.struct("pos", "ord")
    rvec = F.transform(F.array_sort(F.collect_list(F.struct(place_.alias("at"), F.struct("has_sfs", F.when(F.col("hp") == 0, 3).otherwise(F.col("hp")).alias("hp")).alias("v")))), lambda x: x["v"])
    subs = F.transform(F.array_sort(F.collect_list(F.when(F.col("sub").isNotNull(), F.struct(place_.alias("at"), F.struct(F.col("qname").alias("name"), F.col("sub").alias("seq"), "hp").alias("v"))))), lambda x: x["v"])
    filled = parts.groupBy("cluster_id", "chrom", "s", "e").agg(*(F.count_if(F.col("hp") == h).cast("int").alias(f"cov{h}") for h in (0, 1, 2)), rvec.alias("rvec"), subs.alias("subreads"))
    return filled.where(F.size("subreads") >= config.min_cluster_weight).withColumn("cov", F.col("cov0") + F.col("cov1") + F.col("cov2"))


VARIANT = "kind string, chrom string, s int, e int, ref string, alt string, l int, w int, cov int, cov0 int, cov1 int, cov2 int, score int, nv int, cigar string, reads string, rvec string, cluster_id string, sub_id int"


def call_clusters(filled: DataFrame, contigs: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants, and the consensus sequences with their alignments. A cluster's reads are one row: it is called alone."""
    config = config or Config()
    # the cluster's stretch of the reference with the base before it, fetched like that of an alignment
    spans = filled.select("*", F.greatest(F.col("s") - 1, F.lit(0)).alias("pos"), F.concat((F.col("e") - F.greatest(F.col("s") - 1, F.lit(0)) + 1).cast("string"), F.lit("M")).alias("cigar"))
    rows = with_reference(spans, contigs, key="cluster_id")
    # consensus is dear for the bytes it reads: by a number that is given, partitions are not joined by their size
    rows = rows.repartition(int(filled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster_id")

    def called(cluster_id: str, chrom: str, s: int, e: int, pos: int, cov: int, cov0: int, cov1: int, cov2: int, rvec: list, subreads: list, ref: str) -> Iterator[tuple]:
        lengths, tags = [len(x["seq"]) for x in subreads], [x["hp"] for x in subreads]
        vector = "-".join(f"{x['has_sfs']}:{x['hp']}" for x in rvec)
        for sub_id, (members, change) in enumerate(splitting.split(lengths, tags, config.length_ratio, config.use_haplotypes)):
            consensus = poa.consensus([subreads[i]["seq"] for i in members])
            score, ops = align.global_align(ref[s - pos :], consensus)
            text = ops_text(ops)
            names = ",".join(subreads[i]["name"] for i in members)
            tagged = config.use_haplotypes and any(t in (1, 2) for t in tags)
            covs = (cov0 + change.get("cov0", 0), cov1 + change.get("cov1", 0), cov2 + change.get("cov2", 0)) if tagged else (-1, -1, -1)
            found = variants.variants_of(ops, s, ref, pos, consensus, config.min_sv_length)
            for kind, at, a, b, n in found:
                yield kind, chrom, at, at + len(a) - 1, a, b, n, len(members), cov, *covs, score, len(found), text, names, vector, cluster_id, sub_id
            yield "consensus", chrom, s, e, consensus, "", len(consensus), len(members), cov, *covs, score, len(found), text, names, vector, cluster_id, sub_id

    columns = ["cluster_id", "chrom", "s", "e", "pos", "cov", "cov0", "cov1", "cov2", "rvec", "subreads", "ref"]
    out = keep(map_rows(rows, columns, called, VARIANT))
    return out.where("kind != 'consensus'"), out.where("kind = 'consensus'").select("cluster_id", "sub_id", "chrom", "s", "e", F.col("ref").alias("seq"), "cigar", "score")


def call(alignments: DataFrame, strings: DataFrame, contigs: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """svs, consensus, clusters (and imprecise svs among svs with config.clipped)."""
    config = config or Config()
    extended = keep(place(alignments, strings, contigs, config))
    filled = keep(fill(cluster(extended, config), alignments, config))
    found, consensus = call_clusters(filled, contigs, config)
    svs = chain.chain_filter(chain.dedup_variants(found, config.compat), config.compat, config.length_ratio).withColumn("imprecise", F.lit(False))
    if config.clipped:
        marks = extended.where("clip").select(F.col("qname").alias("name"), "chrom", F.col("rs").alias("p"), F.col("re").alias("l"), "starting")
        vague = keep(clips.imprecise_variants(marks, contigs, svs))
        # the one base of each place, fetched like that of an alignment
        at = vague.select("chrom", F.col("s").cast("int").alias("pos"), F.lit("1M").alias("cigar")).distinct().withColumn("place", F.concat_ws(":", "chrom", "pos"))
        at = with_reference(at, contigs, "base", "place").select("chrom", F.col("pos").alias("s"), "base")
        vague = vague.withColumn("s", F.col("s").cast("int")).join(at, ["chrom", "s"]).select(
            "kind", "chrom", "s", F.col("e").cast("int").alias("e"), F.col("base").alias("ref"),
            F.concat(F.lit("<"), "kind", F.lit(">")).alias("alt"), F.col("l").cast("int").alias("l"), F.col("w").cast("int").alias("w"), F.lit(True).alias("imprecise"),
        )
        svs = svs.unionByName(vague, allowMissingColumns=True)
    if config.genotype:
        svs = genotype.genotype_calls(svs)
    return {"svs": keep(svs), "consensus": consensus, "clusters": filled}


def run(alignments: DataFrame, contigs: DataFrame, config: Config | None = None, index: str | None = None) -> dict[str, DataFrame]:
    """Smooth, search and call; calls are always made on smoothed alignments, to which the strings' offsets refer."""
    config = config or Config()
    smoothed = keep(smooth(alignments, contigs, config))
    strings = keep(search(smoothed, contigs if index is None else index, config))
    return {"smoothed": smoothed, "strings": strings, **call(smoothed, strings, contigs, config)}
