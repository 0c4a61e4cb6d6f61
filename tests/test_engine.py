"""The engine on a synthetic genome with planted variants, its kernels and operators against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.config import Config
from strandframe.functions import cigar, sequence
from strandframe.kernels import align, matching, placement, poa, smoothing, splitting, text
from strandframe.operators import absent, chain, clips, folds, genotype, relational
from strandframe.plans import catalogue, stages
from strandframe.sources import bam, reports, sequences, strings_text

READ = "ord long, qname string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual binary, hp int, xf int"


def bases(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def reads_of(rnd, genome, plants, depth=10, size=1000, snp=0.0):
    """Reads with their true alignments. plants: chrom -> [(place, 'I'|'D', sequence or length)]; all of a read's haplotype."""
    rows = []
    for chrom, seq in genome.items():
        for start in range(0, len(seq) - size, size // depth):
            out, ops, at = [], [], start
            for place, op, what in sorted(plants.get(chrom, [])):
                if not start + 150 < place < start + size - 150:
                    continue
                out.append(seq[at:place])
                ops.append((place - at, "M"))
                if op == "I":
                    out.append(what)
                    ops.append((len(what), "I"))
                    at = place
                else:
                    ops.append((what, "D"))
                    at = place + what
            end = start + size
            out.append(seq[at:end])
            ops.append((end - at, "M"))
            read = "".join("ACGT"[("ACGT".index(c) + 1) % 4] if rnd.random() < snp else c for c in "".join(out))
            rows.append((len(rows), f"r{chrom}_{start}", 0, chrom, start, 60, "".join(f"{n}{o}" for n, o in ops), read, b"I" * len(read), 0, None))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(7)
    genome = {"c1": bases(rnd, 6000), "c2": bases(rnd, 4000)}
    plants = {"c1": [(2000, "I", bases(rnd, 60)), (4000, "D", 80)], "c2": [(1500, "D", 30)]}
    rows = reads_of(rnd, genome, plants, snp=0.002)
    contigs = spark.createDataFrame([(k, c, s, len(s)) for k, (c, s) in enumerate(genome.items())], "contig_idx long, chrom string, seq string, length int")
    return genome, plants, rows, contigs, spark.createDataFrame(rows, READ)


def expected(genome, plants):
    out = set()
    for chrom, items in plants.items():
        for place, op, what in items:
            seq = genome[chrom]
            if op == "I":
                while seq[place - 1] == what[-1]:  # gaps lie furthest to the left
                    place, what = place - 1, what[-1] + what[:-1]
                out.add((chrom, "INS", place, seq[place - 1], seq[place - 1] + what))
            else:
                while seq[place - 1] == seq[place + what - 1]:
                    place -= 1
                out.add((chrom, "DEL", place, seq[place - 1 : place + what], seq[place - 1]))
    return out


def calls(frame):
    return {(r["chrom"], r["kind"], r["s"], r["ref"], r["alt"]) for r in frame.collect()}


def test_planted_variants(world, spark, tmp_path):
    genome, plants, rows, contigs, alignments = world
    out = stages.run(alignments, contigs, Config())
    smoothed = {r["qname"]: r for r in out["smoothed"].collect()}
    assert all(r["xf"] in (0, 1, 2) for r in smoothed.values())
    svs = out["svs"].cache()
    assert calls(svs) == expected(genome, plants)
    assert all(r["w"] >= 2 and r["cov"] >= r["w"] for r in svs.collect())
    # other partitions and another order of rows change nothing
    again = stages.run(alignments.orderBy(F.rand(3)).repartition(13), contigs.repartition(3), Config())
    assert calls(again["svs"]) == calls(svs)
    reports.write_vcf(svs, contigs, str(tmp_path / "vcf"))
    reports.write_sam(out["consensus"], contigs, str(tmp_path / "sam"))
    reports.write_clusters(out["clusters"], str(tmp_path / "clusters"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "vcf")).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and sum(not x.startswith("#") for x in lines) == 3
    assert any("SVTYPE=DEL;SVLEN=-80" in x for x in lines)
    strings_text.write_strings(out["strings"], str(tmp_path / "sfs"))
    back = strings_text.read_strings(spark, str(tmp_path / "sfs"))
    assert Counter(map(tuple, back.collect())) == Counter((r["qname"], r["qs"], r["l"], r["htag"]) for r in out["strings"].collect())


def test_haplotypes(world, spark):
    genome, _, _, contigs, _ = world
    rnd = random.Random(3)
    one = [(2000, "I", bases(rnd, 60))]
    rows = [(*r[:9], 1, None) for r in reads_of(rnd, {"c1": genome["c1"]}, {"c1": one})]
    rows += [(r[0] + 10_000, r[1] + "b", *r[2:9], 2, None) for r in reads_of(rnd, {"c1": genome["c1"]}, {"c1": [(2000, "I", one[0][2] + bases(rnd, 40))]})]
    svs = stages.run(spark.createDataFrame(rows, READ), contigs, Config())["svs"].collect()
    assert sorted(r["l"] for r in svs) == [60, 100] and all(r["cov1"] > 0 and r["cov2"] > 0 for r in svs)


def test_clean_reads(world, spark):
    genome, _, _, contigs, _ = world
    rows = reads_of(random.Random(1), genome, {})
    out = stages.run(spark.createDataFrame(rows, READ), contigs, Config())
    assert {r["xf"] for r in out["smoothed"].collect()} == {2} and out["strings"].count() == 0 and out["svs"].count() == 0


def test_clipped(spark):
    contigs = spark.createDataFrame([("c", "ACGT" * 5000, 20_000)], "chrom string, seq string, length int")
    rows = [(f"a{i}", "c", 3000, 400 + i, False) for i in range(6)] + [(f"b{i}", "c", 8000, 300, True) for i in range(5)] + [("x", "c", 12_000, 10, True), ("y", "nowhere", 5, 5, True)]
    rows += [(f"i{i}", "c", 15_000, 500, True) for i in range(3)] + [(f"j{i}", "c", 15_010, 700, False) for i in range(2)]
    marks = spark.createDataFrame(rows, "name string, chrom string, p int, l int, starting boolean")
    svs = spark.createDataFrame([], "chrom string, s int, e int")
    got = {(r["kind"], r["s"], r["l"], r["w"]) for r in clips.imprecise_variants(marks, contigs, svs).collect()}
    assert got == {("DEL", 3000, 5001, 6), ("INS", 15_000, 700, 3)}
    near = spark.createDataFrame([("c", 14_500, 14_600)], "chrom string, s int, e int")
    assert {r["kind"] for r in clips.imprecise_variants(marks, contigs, near).collect()} == {"DEL"}


def test_bam_round_trip(world, spark, tmp_path):
    genome, _, rows, contigs, alignments = world
    path = str(tmp_path / "x.bam")
    bam.write_bam(alignments, [(c, len(s)) for c, s in genome.items()], path)
    back = bam.read_bam(spark, path).orderBy("ord").collect()
    assert [tuple(r)[1:10] for r in back] == [(*r[1:9], r[9]) for r in rows]
    assert back[0]["xf"] is None and [r["ord"] for r in back] == sorted(r["ord"] for r in back)


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nacgt\nNN\n>c2\n\nTT\n")
    assert [tuple(r)[1:] for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("contig_idx").collect()] == [("c1", "ACGTNN", 6), ("c2", "TT", 2)]
    import gzip

    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACG\n+\n@II\n>r2\nAC\n")
    assert [tuple(r)[1:] for r in sequences.read_fastx(spark, str(tmp_path / "b.fq.gz")).orderBy("ord").collect()] == [("r1", "ACG", "@II"), ("r2", "AC", "r2")]


@pytest.mark.parametrize("split", [61, 1 << 20])
def test_sequences_in_parts(spark, tmp_path, split):
    """Entries are the same however a file is cut; qualities may begin with any sign."""
    rnd = random.Random(16)
    reads = [(f"r{i}", bases(rnd, n := rnd.randint(1, 30)), "".join(rnd.choice("@+>I!") for _ in range(n))) for i in range(40)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+{n if i % 2 else ''}\n{q}\n" for i, (n, s, q) in enumerate(reads)))
    got = sequences.read_fastx(spark, str(tmp_path / "a.fq"), split)
    assert [tuple(r)[1:] for r in got.orderBy("ord").collect()] == reads
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s[:10]}\n{s[10:]}\n" for n, s, _ in reads))
    contigs = sequences.read_fasta(spark, str(tmp_path / "a.fa"), split)
    assert [tuple(r)[1:] for r in contigs.orderBy("contig_idx").collect()] == [(n, s, len(s)) for n, s, _ in reads]
    assert split > 1000 or contigs.rdd.getNumPartitions() > 1 and got.rdd.getNumPartitions() > 1
    (tmp_path / "b.fq").write_text("@a\nAC\nGT\n+\n@@\nII\n@b\nA\n+\nI\n")  # over more lines: one part
    assert [tuple(r)[1:] for r in sequences.read_fastx(spark, str(tmp_path / "b.fq"), split).orderBy("ord").collect()] == [("a", "ACGT", "@@II"), ("b", "A", "I")]


@pytest.mark.parametrize("kind", "@>")
def test_sequences_in_few_parts(tmp_path, kind):
    """However small the parts asked for, tasks are bounded, and each entry is in one of them."""
    rnd = random.Random(17)
    reads = [(f"r{i}", bases(rnd, n := rnd.randint(1, 90)), "".join(rnd.choice("@+>I!") for _ in range(n))) for i in range(9000)]
    (tmp_path / "reads").mkdir()
    for k in range(3):
        text = "".join(f"@{n} x\n{s}\n+\n{q}\n" if kind == "@" else f">{n}\n{s}\n" for n, s, q in reads[k * 3000 : k * 3000 + 3000])
        (tmp_path / "reads" / f"{k}.txt").write_text(text)
    reader = sequences._Reader(str(tmp_path / "reads"), False, 128)
    parts = reader.partitions()
    assert sequences.PARTS // 2 < len(parts) <= sequences.PARTS + 2 * 3
    got = [row for part in parts for row in reader.read(part)]
    assert [row[1:] for row in got] == [(n, s, q if kind == "@" else n) for n, s, q in reads]
    assert [row[0] for row in got] == sorted({row[0] for row in got})
    # parts of a size that doesn't make too many stay as they are
    assert [p.begin for p in sequences._Reader(str(tmp_path / "reads" / "0.txt"), False, 50_000).partitions()][:2] == [0, 50_000]


def test_strings_text(spark):
    lines = ["r1\t120\t35\t1\t", "*\t900\t52\t1\t", "r2\t44\t61\t0\t", "r1\t5\t6\t2\t", "*  7 8"]
    got = strings_text.parse_strings(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"))
    assert {tuple(r) for r in got.collect()} == {("r2", 44, 61, 0), ("r1", 5, 6, 2), ("r1", 7, 8, 0)}
    # the same lines over partitions, some of which begin within a read
    split = [((k // 2 << 33) + k % 2, v) for k, v in enumerate(lines)]
    again = strings_text.parse_strings(spark.createDataFrame(split, "ord long, value string"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.collect()}


def test_alignment_kernel():
    rnd = random.Random(1)
    costs = align.gap_costs(60)
    for _ in range(60):
        t, q = bases(rnd, rnd.randint(0, 20)), bases(rnd, rnd.randint(0, 20))
        q = t[: rnd.randint(0, len(t))] + q[: rnd.randint(0, 6)] + t[rnd.randint(0, len(t)) :]
        h = np.full((len(t) + 1, len(q) + 1), -(10**9))
        h[0, 0] = 0
        for i in range(len(t) + 1):
            for j in range(len(q) + 1):
                best = [h[i, j]]
                if i and j:
                    best.append(h[i - 1, j - 1] + (1 if t[i - 1] == q[j - 1] else -9))
                best += [h[i - k, j] - costs[k] for k in range(1, i + 1)] + [h[i, j - k] - costs[k] for k in range(1, j + 1)]
                h[i, j] = max(best)
        score, ops = align.global_align(t, q)
        assert score == h[-1, -1]
        assert sum(n for n, o in ops if o in "MD") == len(t) and sum(n for n, o in ops if o in "MI") == len(q)


def test_consensus_kernel():
    rnd = random.Random(2)
    for _ in range(6):
        base = bases(rnd, 300)
        noisy = ["".join((rnd.choice("ACGT") if rnd.random() < 0.03 else c) for c in base if rnd.random() > 0.01) for _ in range(12)]
        assert poa.consensus(noisy) == base
    # reads that part and join again: insertions, deletions and both alleles of a place
    for _ in range(4):
        base = bases(rnd, 200)
        most = base[:80] + bases(rnd, 40) + base[80:150] + base[170:]
        assert poa.consensus([base, most, most, most[:60] + "A" + most[60:], most]) == most
    assert poa.consensus([]) == "" and poa.consensus(["ACGT"]) == "ACGT"


def test_consensus_of_repeats():
    """Copies of one length with changed letters: the letters of most, also where a shifted copy scores better."""
    rnd = random.Random(5)
    for text in ("a", "ab" * 30, "a" * 60, "Was the the the shonly", "thshshsh. On of", "#a" * 10, "\u6f22\u5b57" * 9, bases(rnd, 20) + "CAG" * 20 + bases(rnd, 20)):
        copies = ["".join("#" if i % 5 == j else c for i, c in enumerate(text)) for j in range(5)]
        assert poa.consensus(copies) == text
    # without a letter of most at each place, or with other lengths, the graph decides alone
    assert poa.agreed(["ACGT", "ACCT", "ACTT", "ACAT"]) is None and poa.agreed(["AC", "AC", "ACG"]) is None and poa.agreed(["AC", "AC", "AG"]) == "AC"
    base = bases(rnd, 60) + "CAG" * 10 + bases(rnd, 60)
    assert poa.consensus([base[:70] + base[73:], base, base, base[:20] + "T" + base[21:], base]) == base


def test_consensus_by_the_graph_alone():
    """Without repeats the graph itself gives the letters of most."""
    rnd = random.Random(6)
    for _ in range(4):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150))
        copies = ["".join("#" if i % 5 == j else c for i, c in enumerate(text)) for j in range(5)]
        graph = poa.Graph()
        for k, copy in enumerate(copies):
            graph.fuse(copy, graph.align(copy) if k else [(None, i) for i in range(len(copy))])
        assert graph.consensus() == text


def test_lcs_and_matching():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("AB") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert text.lcs_length(a, b) == table[-1][-1]
        shard = matching.Shard([a, b])
        shard = matching.Shard.loaded(*shard.saved()) if a > b else shard
        q = "".join(rnd.choice("ABC") for _ in range(10))
        got = shard.longest_matches(matching.encode(q), np.full(10, 10))
        assert got.tolist() == [max(n for n in range(11 - i) if q[i : i + n] in a or q[i : i + n] in b) for i in range(10)]


def test_matching_beyond_words():
    """Matches longer than a word of letters, over repeats, with letters that the shard lacks and several texts."""
    rnd = random.Random(14)
    for letters in ("AC", "ACGT", "abcdefghijklmnopqrstuvwxyzé日"):
        refs = ["".join(rnd.choice(letters) for _ in range(300)) for _ in range(3)] + [letters[0] * 150, letters[:2] * 90]
        shard = matching.Shard(refs)
        for _ in range(12):
            parts = []
            for _ in range(4):
                r = rnd.choice(refs)
                i = rnd.randrange(len(r))
                parts += [r[i : i + rnd.randint(0, 200)], rnd.choice(["", letters[0], "!", "\0"])]
            texts = ["".join(parts), "", "".join(parts[::-1])]
            codes = [matching.encode(t) for t in texts]
            ends = np.cumsum([len(c) for c in codes])
            got = shard.longest_matches(np.concatenate(codes), np.repeat(ends, [len(c) for c in codes]))
            want = [max(n for n in range(len(t) - i + 1) if any(t[i : i + n] in r for r in refs)) for t in texts for i in range(len(t))]
            assert got.tolist() == want


def brute_absent(read, refs):
    n = len(read)
    gone = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if not any(read[i:j] in r for r in refs)}
    return sorted((i, j - i) for i, j in gone if (i + 1, j) not in gone and (i, j - 1) not in gone)


@pytest.mark.parametrize("shard_chars", [absent.SHARD_CHARS, 40])
def test_specific_strings(spark, shard_chars, monkeypatch):
    monkeypatch.setattr(absent, "BLOCK_CHARS", 50)
    rnd = random.Random(5)
    refs = ["".join(rnd.choice("ABC") for _ in range(rnd.randint(0, 30))) for _ in range(5)] + ["".join(rnd.choice("AB") for _ in range(200))]
    reads = [(i, "".join(rnd.choice("ABCé") for _ in range(rnd.randint(0, 14)))) for i in range(40)] + [(99, None)]
    found = absent.specific_strings(spark.createDataFrame(reads, "k long, seq string").repartition(3), spark.createDataFrame([(r,) for r in refs], "s string"), ["k"], "seq", "s", shard_chars)
    got = defaultdict(list)
    for r in found.collect():
        got[r["k"]].append((r["qs"], r["l"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: b for k, s in reads if (b := brute_absent(s or "", refs))}


def test_smoothing_kernel():
    ref = "ACGTACGTAC" * 10
    read = ref[:10] + "T" * 25 + ref[10:20] + "GG" + ref[20:30] + ref[33:60]
    ops = [(10, "M"), (25, "I"), (10, "M"), (2, "I"), (10, "M"), (3, "D"), (27, "M")]
    xf, seq, qual, new = smoothing.smooth(ops, read, b"I" * len(read), ref, 0.5)
    assert (xf, seq, new) == (0, ref[:10] + "T" * 25 + ref[10:60], [(10, "M"), (25, "I"), (50, "M")]) and len(qual) == len(seq)
    assert smoothing.smooth([(10, "H"), (5, "M")], "ACGTA", b"IIIII", ref, 0.1)[0] == 2
    assert smoothing.smooth([(4, "M")], "TTTT", b"IIII", "AAAA", 0.1)[0] == 1


def test_placement_and_splitting():
    ops = [(50, "M"), (30, "I"), (50, "M")]
    rnd = random.Random(6)
    ref = bases(rnd, 100)
    (span,), left, right = placement.place(ops, 1000, [(45, 40)], ref)
    assert left is right is None and span[0] <= 1044 and span[1] >= 1050 and span[3] > 80
    assert placement.subread(ops, 1000, "x" * 130, 1040, 1060) == "x" * 51
    assert splitting.split([100, 101, 50, 100, 51], [0] * 5) == [([0, 1, 3], {}), ([2, 4], {})]
    groups = splitting.split([100, 200, 100, 150], [1, 2, 0, 0])
    assert [g for g, _ in groups] == [[0, 2], [1]]


def test_chain():
    row = lambda s, w, l=30, alt="A" * 30: ("INS", s, s, l, w, "A", alt)  # noqa: E731, E741
    assert chain.chain([row(100, 5), row(110, 5), row(400, 3), row(420, 9, 80)]) == [0, 2, 3]
    assert chain.chain([row(100, 9), row(110, 10)]) == [1] and chain.chain([row(100, 9), row(110, 10)], compat=True) == [1, 0]


def test_cigar_functions(spark):
    df = spark.createDataFrame([("10M2I3D5S",), ("*",), (None,), ("3I4M2D",), ("1M1M2I",)], "c string").select("c", cigar.parse_cigar(F.col("c")).alias("o"))
    rows = df.select("c", cigar.cigar_string(F.col("o")), cigar.gap_count(F.col("o")), cigar.read_length(F.col("o")), cigar.reference_length(F.col("o")), cigar.cigar_string(cigar.fix_clips(F.col("o"))), cigar.cigar_string(cigar.merge_runs(F.col("o"))), F.size(cigar.aligned_pairs(F.col("o"), F.lit(0))), cigar.cigar_string(cigar.decode_cigar(cigar.encode_cigar(F.col("o"))))).collect()
    assert [tuple(r)[1:] for r in rows] == [("10M2I3D5S", 2, 17, 13, "10M2I3D5S", "10M2I3D5S", 20, "10M2I3D5S"), ("*", 0, 0, 0, "*", "*", 0, "*"), ("*", 0, 0, 0, "*", "*", 0, "*"), ("3I4M2D", 2, 7, 6, "3S4M", "3I4M2D", 9, "3I4M2D"), ("1M1M2I", 1, 4, 2, "1M1M2S", "2M2I", 4, "1M1M2I")]


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ACgtNx",)], "s string").select(sequence.reverse_complement(F.col("s")), sequence.normalise_bases(F.col("s")), sequence.base_codes(F.col("s")), sequence.kmers(F.col("s"), 5), sequence.string_ratio(F.col("s"), F.lit("ACgt"))).first()
    assert tuple(row) == ("NNACGT", "ACGTNN", [1, 2, 3, 4, 5, 5], ["ACgtN", "CgtNx"], 80.0)


def test_folds_by_batches(spark):
    """Groups that span Arrow batches fold as one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(8)
        rows = [(rnd.choice("abc"), rnd.randint(0, 60), i) for i in range(120)] + [(None, 5, 1000)]
        got = folds.greedy_length_split(spark.createDataFrame(rows, "k string, n int, i int"), ["k"], "n", ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = defaultdict(list)
    for k, n, i in rows:
        mine[k].append((i, n))
    want = {i: g for v in mine.values() for (i, _), g in zip(sorted(v), folds.length_groups([n for _, n in sorted(v)], 0.97))}
    assert {r["i"]: r["sub_id"] for r in got} == want


@pytest.mark.parametrize("width", [4, 50, 1 << 20])
def test_cut_at_gaps(spark, width):
    """Parts by brute force: ties, keys that are null, spans that reach over many bins."""
    rnd = random.Random(15)
    rows = [(rnd.choice(["x", "y", None]), s := rnd.randint(-100, 400), s + rnd.choice([0, 0, 3, 60]), i) for i in range(300)]
    rows += [("z", 5, 5, 1000 + i) for i in range(50)] + [("z", 20, 20, 2000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, s int, e int, i int").repartition(7)
    got = {r["i"]: r["part"] for r in folds.cut_at_gaps(df, ["k"], "s", "e", 6, width=width).collect()}
    want, reach, part = {}, {}, {}
    for k, s, e, i in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if k not in reach or s - reach[k] > 6:
            part[k] = s
        reach[k] = max(reach.get(k, e), e)
        want[i] = part[k]
    assert got == want


def test_genotypes(spark):
    reads = spark.createDataFrame([("v", 1, 1)] * 8 + [("v", 0, 2)] * 8, "k string, support int, hap int")
    p = genotype.posteriors(reads, ["k"]).first()
    assert p["p10"] > 0.99 and abs(sum(p[f"p{g}"] for g in genotype.GENOTYPES) - 1) < 1e-9


def test_interval_join(spark):
    rnd = random.Random(9)
    a = [(i, rnd.choice("xy"), s := rnd.randint(-50, 50), s + rnd.randint(0, 40)) for i in range(60)]
    b = [(i, rnd.choice("xy"), s := rnd.randint(-50, 50), s + rnd.randint(0, 40)) for i in range(60)]
    got = relational.interval_join(spark.createDataFrame(a, "i int, k string, s int, e int"), spark.createDataFrame(b, "j int, k string, t int, f int"), ["k"], ("s", "e"), ("t", "f"), 16)
    assert Counter((r["i"], r["j"]) for r in got.collect()) == Counter((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_overlap_of_all_lines(spark, tmp_path):
    rnd = random.Random(11)
    lines = [(i, 1, rnd.randint(1, 3), rnd.randint(1, 150), float(rnd.randint(1, 50)), rnd.choice("RAN")) for i in range(150)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Counter(tuple(r) for r in catalogue.QUERIES["interval_overlap"](spark, str(tmp_path)).collect())
    ends = [(*x, x[3] + int(x[4])) for x in lines]
    want = Counter((a[2], a[0], a[1], b[0], min(a[6], b[6]) - max(a[3], b[3])) for a in ends for b in ends if (a[5], b[5]) == ("R", "A") and a[2] == b[2] and a[3] <= b[6] and b[3] <= a[6])
    assert got == want and want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values)

    frame = catalogue.QUERIES[name](spark, SF)
    sql = con.execute(catalogue.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(d[0] for d in sql.description)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows([d[0] for d in sql.description], sql.fetchall())


def test_genotype_calls(spark):
    svs = spark.createDataFrame([("a", "1:1-1:1-1:2-1:2"), ("b", "0:1-0:2-0:3"), ("c", "1:1-1:1-1:1-0:2-0:2-0:2"), ("d", None)], "id string, rvec string")
    got = {r["id"]: r["gt"] for r in genotype.genotype_calls(svs).collect()}
    assert got == {"a": "1/1", "b": "0/0", "c": "0/1", "d": "./."}


def test_disjoint_and_added_ops(spark):
    starts, sizes = absent.disjoint_absent(np.array([2, 2, 1, 4, 1, 1, 0]))
    assert all(a + n <= b for a, n, b in zip(starts, sizes, starts[1:])) and len(starts)
    ops = cigar.parse_cigar(F.lit("3M2I"))
    row = spark.range(1).select(cigar.cigar_string(cigar.add_op(ops, F.lit(4), F.lit("I"))), cigar.cigar_string(cigar.add_front(ops))).first()
    assert tuple(row) == ("3M6I", "4M2I")
