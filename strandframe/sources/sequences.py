"""FASTA and FASTQ as Spark data sources.

A plain file that begins with FASTA, or with FASTQ of four lines an entry, is read in parts of about SPLIT_BYTES: a part
holds the entries that begin in it. Packed files, and FASTQ over more lines, are one part and read as a stream. Where a
smaller size is asked for, parts are larger than that if there would be more than about PARTS of them, up to SPLIT_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import is_packed, lines, listed, size_of

SPLIT_BYTES = 64 << 20
PARTS = 256


def entries(source: Iterable[tuple[int, str]], end: int | None = None) -> Iterator[tuple[int, str, str, str | None]]:
    """Place, name (first word), sequence and qualities of each entry of FASTA or FASTQ that begins before end, mixed or
    not, on one line or many. source: lines with their places."""
    source = iter(source)
    nothing = (0, None)
    at, line = next(source, nothing)
    while line is not None:
        if not line or line[0] not in ">@":
            at, line = next(source, nothing)
            continue
        if end is not None and at >= end:
            return
        begin, name = at, (line[1:].split() or [""])[0]
        parts: list[str] = []
        at, line = next(source, nothing)
        while line is not None and line[:1] not in (">", "@", "+"):
            parts.append(line.strip())
            at, line = next(source, nothing)
        seq, qual = "".join(parts), None
        if line is not None and line[:1] == "+":
            marks: list[str] = []
            size = 0
            at, line = next(source, nothing)
            while line is not None and size < len(seq):
                marks.append(line)
                size += len(line)
                at, line = next(source, nothing)
            qual = "".join(marks)
        yield begin, name, seq, qual


def first_entry(source: Iterator[tuple[int, str]], fastq: bool) -> Iterator[tuple[int, str]]:
    """The lines from the first entry on. A line of qualities may begin with @ too, but its next but one is no +."""
    held: list[tuple[int, str]] = []
    for line in source:
        held.append(line)
        if not fastq:
            if line[1][:1] == ">":
                break
            held.clear()
        elif len(held) == 3:
            if held[0][1][:1] == "@" and held[2][1][:1] == "+":
                break
            held.pop(0)
    else:
        return
    yield from held
    yield from source


def kind_of(path: str) -> str:
    """">" or "@" for files that can be read in parts, else nothing."""
    if is_packed(path):
        return ""
    first = [line for _, line in islice(lines(path), 400)]
    kind = first[0][:1] if first else ""
    if kind == "@" and not all(a[:1] == "@" and c[:1] == "+" and len(b) == len(d) for a, b, c, d in zip(*(first[k::4] for k in range(4)))):
        return ""
    return kind if kind == "@" or kind == ">" and not any(x[:1] in ("@", "+") for x in first) else ""


class _Part(InputPartition):
    def __init__(self, path: str, number: int, kind: str, begin: int, end: int | None):
        self.path, self.number, self.kind, self.begin, self.end = path, number, kind, begin, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, contigs: bool, split: int):
        self.path, self.contigs, self.split = path, contigs, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        files = [(path, kind_of(path) if self.split else "", size_of(path)) for path in listed(self.path)]
        # a part is a task, which costs far more than to read a few kB
        split = max(self.split, min(SPLIT_BYTES, sum(size for _, kind, size in files if kind) // PARTS))
        for number, (path, kind, size) in enumerate(files):
            bounds = range(0, size, split) if kind else range(1)
            out += [_Part(path, number, kind, a, b) for a, b in zip(bounds, [*bounds[1:], None])]
        return out or [_Part("", 0, "", 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return
        source = lines(partition.path, partition.begin)
        if partition.begin:
            source = first_entry(source, partition.kind == "@")
        for k, name, seq, qual in entries(source, partition.end):
            # a file's places stay below 2^40
            at = (partition.number << 40) + k
            yield (at, name, seq.upper(), len(seq)) if self.contigs else (at, name, seq, name if qual is None else qual)


class FastaSource(DataSource):
    """contig_idx (file order), chrom, seq (upper case), length."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "contig_idx long, chrom string, seq string, length int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], True, int(self.options.get("splitBytes", SPLIT_BYTES)))


class FastxSource(DataSource):
    """ord, qname, seq and qual; reads without qualities get their name in its place."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "ord long, qname string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], False, int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("splitBytes", split_bytes).load(path)


def read_fastx(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("splitBytes", split_bytes).load(path)
