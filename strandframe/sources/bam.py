"""BAM as a Spark data source and its writer, by the public format: BGZF blocks, a header, then records.

With an index (.bai) beside it a file is read in parts that begin at record bounds the index names; without one it is
one partition. ord is a record's virtual offset (of the file with that number), which restores the file's order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, open_binary, resolve

# Fixed values of the format.
OPS = "MIDNSHP=X"
SEQ = "=ACMGRSVTWYHKDBN"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "ord long, qname string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual binary, hp int, xf int, aux binary, mate_chrom string, mate_pos int, tlen int"
_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_KINDS = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}
SPLIT_BYTES = 64 << 20


class Blocks:
    """The inflated stream of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, virtual: int = 0):
        self.file = open_binary(path)
        self.file.seek(virtual >> 16)
        self.at, self.next = virtual >> 16, virtual >> 16
        self.data, self.place = b"", 0
        if self._load():
            self.place = virtual & 0xFFFF

    def _load(self) -> bool:
        self.at = self.next
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.place = b"", 0
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size, k = 0, 0
        while k < len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        body = self.file.read(size - 12 - len(extra))
        self.next = self.at + size
        self.data, self.place = zlib.decompress(body[:-8], -15), 0
        return True

    def offset(self) -> int:
        while self.place >= len(self.data) and self._load():
            pass
        return self.at << 16 | self.place

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.place >= len(self.data) and not self._load():
                break
            piece = self.data[self.place : self.place + n]
            self.place += len(piece)
            n -= len(piece)
            parts.append(piece)
        return b"".join(parts)


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return text, contigs


def aux_fields(data: bytes) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Tag, kind and the whole field's bytes."""
    k = 0
    while k + 3 <= len(data):
        tag, kind = data[k : k + 2], data[k + 2 : k + 3]
        if kind in (b"Z", b"H"):
            end = data.index(b"\0", k + 3) + 1
        elif kind == b"B":
            end = k + 8 + _SIZES[data[k + 3 : k + 4]] * struct.unpack_from("<I", data, k + 4)[0]
        else:
            end = k + 3 + _SIZES[kind]
        yield tag, kind, data[k:end]
        k = end


def decode_record(data: bytes, contigs: list[tuple[str, int]]) -> tuple:
    tid, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    k = 32
    name = data[k : k + l_name - 1].decode()
    k += l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, k)
    k += 4 * n_ops
    packed = data[k : k + (l_seq + 1) // 2]
    seq = "".join(SEQ[b >> 4] + SEQ[b & 15] for b in packed)[:l_seq]
    k += len(packed)
    qual, aux = data[k : k + l_seq], data[k + l_seq :]
    tags = {tag: struct.unpack_from(_KINDS[kind], field, 3)[0] for tag, kind, field in aux_fields(aux) if tag in (b"HP", b"XF") and kind in _KINDS}
    cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*"
    return name, flag, contigs[tid][0] if tid >= 0 else None, pos, mapq, cigar, seq, qual, tags.get(b"HP"), tags.get(b"XF"), aux, contigs[mate][0] if mate >= 0 else None, mate_pos, tlen


def index_offsets(path: str) -> list[int]:
    """Virtual offsets, in order, at which an index says that records begin."""
    with open_binary(path) as f:
        data = f.read()
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    found, k = set(), 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n = struct.unpack_from("<i", data, k)[0]
        k += 4
        for _ in range(n):
            number, chunks = struct.unpack_from("<Ii", data, k)
            k += 8
            for begin, _ in struct.iter_unpack("<QQ", data[k : k + 16 * chunks]) if number != 37450 else ():
                found.add(begin)
            k += 16 * chunks
        n = struct.unpack_from("<i", data, k)[0]
        found.update(x for (x,) in struct.iter_unpack("<Q", data[k + 4 : k + 4 + 8 * n]) if x)
        k += 4 + 8 * n
    return sorted(found)


class _Part(InputPartition):
    def __init__(self, path: str, number: int, begin: int, end: int | None):
        self.path, self.number, self.begin, self.end = path, number, begin, end


class _BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        names = listed(self.path)
        for number, path in enumerate(p for p in names if not p.endswith(".bai")):
            blocks = Blocks(path)
            read_header(blocks)
            begins = [blocks.offset()]
            try:
                offsets = index_offsets(path + ".bai")
            except FileNotFoundError:
                offsets = []
            for x in offsets:
                if (x >> 16) - (begins[-1] >> 16) >= self.split:
                    begins.append(x)
            out += [_Part(path, number, a, b) for a, b in zip(begins, [*begins[1:], None])]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        contigs = read_header(Blocks(partition.path))[1]
        blocks = Blocks(partition.path, partition.begin)
        while True:
            at = blocks.offset()
            if partition.end is not None and at >= partition.end:
                return
            size = blocks.read(4)
            if len(size) < 4:
                return
            # a file number above 56 bits of offset would not fit: offsets of one file are below 2^56 in practice
            yield ((partition.number << 56) + at, *decode_record(blocks.read(struct.unpack("<i", size)[0]), contigs))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def header_text(path: str) -> str:
    """The header of a BAM file, as SAM writes it."""
    return read_header(Blocks(next(p for p in listed(path) if not p.endswith(".bai"))))[0]


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).load(path)


def _bin(begin: int, end: int) -> int:
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return base + (begin >> shift)
    return 0


def encode_record(name: str, flag: int, tid: int, pos: int, mapq: int, cigar: str, seq: str, qual: bytes | None, hp: int | None, xf: int | None, aux: bytes | None = None, mate: int = -1, mate_pos: int | None = None, tlen: int | None = None) -> bytes:
    ops, n, span = [], 0, 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            span += n if c in "MDN=X" else 0
            n = 0
    codes = [SEQ.find(c) if SEQ.find(c) >= 0 else 15 for c in seq.upper()]
    codes += [0] * (len(codes) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    tail = b"".join(f for tag, _, f in aux_fields(aux or b"") if tag not in (b"HP", b"XF"))
    for tag, value in ((b"HP", hp), (b"XF", xf)):
        tail += tag + b"i" + struct.pack("<i", value) if value is not None else b""
    qual = qual if qual is not None and len(qual) == len(seq) else b"\xff" * len(seq)
    where = _bin(max(pos, 0), max(pos, 0) + max(span, 1))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, where, len(ops), flag, len(seq), mate, -1 if mate_pos is None else mate_pos, tlen or 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tail
    return struct.pack("<i", len(body)) + body


def bgzf(data: bytes) -> bytes:
    out = []
    for k in range(0, len(data), 0xFF00):
        piece = data[k : k + 0xFF00]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(piece) + squeeze.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


def write_bam(alignments: DataFrame, contigs: list[tuple[str, int]], path: str, text: str = "") -> None:
    """Records in the order of ord below path's one file. Executors encode and compress; the driver only appends their
    blocks, a partition at a time. contigs: names and lengths of the header."""
    number = {name: k for k, (name, _) in enumerate(contigs)}
    names = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "hp", "xf"]
    extra = [c if c in alignments.columns else None for c in ("aux", "mate_chrom", "mate_pos", "tlen")]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                name, flag, chrom, pos, mapq, cigar, seq, qual, hp, xf, aux, mate, mate_pos, tlen = row
                out.append(encode_record(name, flag, number.get(chrom, -1), pos, mapq, cigar, seq, qual, hp, xf, aux, number.get(mate, -1), mate_pos, tlen))
            yield pa.RecordBatch.from_arrays([pa.array([bgzf(b"".join(out))], pa.binary())], ["block"])

    blocks = alignments.orderBy("ord").select(*names, *(F.lit(None).alias(f"no_{k}") if c is None else c for k, c in enumerate(extra))).mapInArrow(packed, "block binary")
    head = text or "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs)
    start = b"BAM\x01" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", len(contigs))
    start += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs)
    system, inner = resolve(path)
    with system.open_output_stream(inner) as f:
        f.write(bgzf(start))
        for row in blocks.toLocalIterator():
            f.write(bytes(row["block"]))
        f.write(END_OF_FILE)
