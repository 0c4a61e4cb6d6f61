"""WARC archives: writing with segmentation and revisits, and reassembly on reading.

A page's HTTP response, its payload in chunked transfer framing, is a record; a block beyond SEGMENT_BYTES goes on in
continuation records. Reading groups records by origin identifier, orders them by segment number, verifies the total
length and decodes the chunked framing in a stream.

Archives are written by Spark to its shared storage, gzipped, in files of about FILE_BYTES before that: rows of text,
each a run of whole records, with CRLF as the line separator, so that what stands in a file is WARC and nothing else.
Cuts between segments and between chunks fall between characters, which keeps every run valid UTF-8. A record's name is
made of its page's id, url and digest: a task that is run again writes the same bytes, and a revisit can name its response.

Segments that follow one another in an archive are joined where they are read, up to RUN_BYTES at a time; what makes a
whole block there is decoded at once. Only the runs of blocks that lie apart are shuffled, by origin. A writing task
holds one page with its framing, a reading task one archive as it is stored (which Spark reads whole: below 2 GB) and
one run.

Defined results: null pages are empty payloads; a null page_id is written as "null" and read as null, and only is the
response where no equal payload has an id; rows that repeat the largest page_id are all responses; rows that are equal
in all columns are records of one name, of whose segments each is taken once; a null url is written as "urn:none"; an
empty table gives no archive rows; other columns are left alone. A page whose segments are missing, surplus or of another
total length or digest is returned with verified false, and so is a revisit whose response is missing or not verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import cut, utf8

SEGMENT_BYTES = 1 << 10
CHUNK_BYTES = 1 << 10
RUN_BYTES = 1 << 20
FILE_BYTES = 16 << 20
#: Digests, of about 120 bytes with what is told of each, that are broadcast at most.
BROADCAST_ROWS = 50_000
CRLF = b"\r\n"
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(hex_digest: str) -> bytes:
    return base64.b32encode(bytes.fromhex(hex_digest))


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cuts of at most size bytes between characters."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[start:end]
        start = end


def chunked(payload: bytes) -> bytes:
    out = []
    for piece in pieces(payload, CHUNK_BYTES):
        out += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def record(kind: bytes, record_id: bytes, page: bytes, block: bytes, *headers: tuple[bytes, bytes]) -> bytes:
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<" + record_id + b">"), (b"WARC-Date", b"2024-01-01T00:00:00Z"), (b"X-Page-ID", page), *headers, (b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1" + CRLF + b"".join(k + b": " + v + CRLF for k, v in lines) + CRLF + block + CRLF + CRLF


def page_records(page_id: object, name: bytes, url: bytes | None, payload: bytes, sha1_hex: str, response: bytes | None, is_response: bool) -> Iterator[bytes]:
    page = b"null" if page_id is None else b"%d" % page_id
    url = _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url) if url else b"urn:none"
    digest = (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(sha1_hex))
    target = (b"WARC-Target-URI", url)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not is_response:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record(b"revisit", name, page, block, target, digest, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<%b>" % response))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record(b"response", name, page, block, target, digest)
        return
    total = b"%d" % len(block)
    before, number = b"", 0
    for part in pieces(block, SEGMENT_BYTES):
        if number:
            yield _segment(name, page, number, before, target, digest)
        before, number = part, number + 1
    yield _segment(name, page, number, before, target, digest, (b"WARC-Segment-Total-Length", total))


def _segment(name: bytes, page: bytes, number: int, block: bytes, target: tuple, digest: tuple, *more: tuple) -> bytes:
    if number == 1:
        return record(b"response", name, page, block, target, digest, (b"WARC-Segment-Number", b"1"), *more)
    origin = (b"WARC-Segment-Origin-ID", b"<%b>" % name)
    return record(b"continuation", b"%b:%d" % (name, number), page, block, target, origin, (b"WARC-Segment-Number", b"%d" % number), *more)


def archive_rows(pages: DataFrame) -> DataFrame:
    """Runs of whole records as text: of equal payloads the largest page_id is the response, the others revisit it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    of_row = F.sha1(F.concat_ws(" ", F.col("sha1"), F.col("url")).cast("binary"))
    rows = rows.withColumn("name", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.substring(of_row, 1, 16)))
    # aggregated before it is shuffled; only digests that repeat go on to the join. A table of few of them is broadcast, so
    # that no payload is shuffled; with more, payloads are dealt by digest, and Spark can split one that very many share.
    repeated = rows.groupBy("sha1").agg(F.max(F.struct("page_id", "name")).alias("top"), F.count("*").alias("n")).where("n > 1")
    repeated = cut(repeated.select("sha1", F.col("top")["page_id"].alias("top_id"), F.col("top")["name"].alias("response")))
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    is_response = F.col("top_id").isNull() | F.coalesce(F.col("page_id") == F.col("top_id"), F.lit(False))
    judged = rows.join(repeated, "sha1", "left").select("page_id", "name", "url", "html", "sha1", "response", is_response.alias("is_response"))

    def runs(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def run() -> pa.RecordBatch:
            # the writer puts the last CRLF
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary()).cast(pa.string())], ["value"])

        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                ids, names, urls, htmls, sha1s, responses, flags = batch.slice(start, 256).columns
                for row in zip(ids.to_pylist(), utf8(names), utf8(urls), utf8(htmls), sha1s.to_pylist(), utf8(responses), flags.to_pylist()):
                    for one in page_records(*row):
                        held.append(one)
                        size += len(one)
                        if size >= RUN_BYTES:
                            yield run()
                            held, size = [], 0
        if held:
            yield run()

    return judged.mapInArrow(runs, "value string")


def write_archives(pages: DataFrame, path: str) -> None:
    """The pages as gzipped WARC files below path, a folder that all executors share."""
    rows = archive_rows(pages).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_BYTES // RUN_BYTES)
    rows.option("compression", "gzip").text(path)


def inflated(data: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of an archive a piece at a time; gzip, of any number of members, is seen by its first bytes."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield bytes(data[at : at + step])
        return
    at, squeezed = 0, zlib.decompressobj(31)
    while at < len(data) or squeezed.unconsumed_tail:
        given = squeezed.unconsumed_tail or bytes(data[at : at + step])
        at += 0 if squeezed.unconsumed_tail else len(given)
        yield squeezed.decompress(given, 4 * step)
        while squeezed.eof and (squeezed.unused_data or at < len(data)):
            rest, squeezed = squeezed.unused_data, zlib.decompressobj(31)
            if not rest:
                break
            yield squeezed.decompress(rest, 4 * step)
    yield squeezed.flush()


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers, by lower-case name, and block of each record of an archive that comes in parts."""
    source, held, at = iter(parts), b"", 0

    def more(wanted: int) -> bool:
        """Reads on until so many bytes are held from here; False where the archive ends before."""
        nonlocal held, at
        if len(held) - at >= wanted:
            return True
        got = [held[at:]]
        size = len(got[0])
        while size < wanted and (part := next(source, None)) is not None:
            got.append(part)
            size += len(part)
        held, at = b"".join(got), 0
        return size >= wanted

    while more(1):
        wanted = 1 << 10
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more(wanted) and held.find(b"\r\n\r\n", at) < 0:
                raise ValueError("an archive ends within a record's header")
            wanted *= 2
        lines = held[at:end].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        at, size = end + 4, int(headers[b"content-length"])
        if not more(size + 4) or held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, held[at : at + size]
        at += size + 4


class HttpPayload:
    """Decodes an HTTP response in a stream: counts and hashes its payload, whatever parts it comes in."""

    def __init__(self) -> None:
        self.held = b""
        self.state = "head"
        self.left = 0
        self.size = 0
        self.hash = hashlib.sha1()

    def _line(self, data: bytes, at: int, end: bytes) -> tuple[bytes | None, int]:
        found = data.find(end, at)
        if found < 0:
            self.held = data[at:]
            return None, len(data)
        return data[at:found], found + len(end)

    def feed(self, part: bytes | memoryview) -> None:
        data, at, self.held = self.held + bytes(part), 0, b""
        while at < len(data):
            if self.state == "head":
                head, at = self._line(data, at, b"\r\n\r\n")
                if head is None:
                    return
                fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                self.state = "size" if fields.get(b"transfer-encoding") == b"chunked" else "plain"
            elif self.state == "size":
                line, at = self._line(data, at, CRLF)
                if line is None:
                    return
                self.left = int(line.partition(b";")[0], 16)
                self.state = "data" if self.left else "trailer"
            elif self.state in ("data", "plain"):
                piece = data[at : at + self.left] if self.state == "data" else data[at:]
                self.hash.update(piece)
                self.size += len(piece)
                at += len(piece)
                self.left -= len(piece)
                if self.state == "data" and not self.left:
                    self.state = "end"
            elif self.state == "end":
                line, at = self._line(data, at, CRLF)
                if line is None:
                    return
                if line:
                    raise ValueError("a chunk does not end where its size says")
                self.state = "size"
            elif self.state == "trailer":
                line, at = self._line(data, at, CRLF)
                if line is None:
                    return
                if not line:
                    self.state = "done"
            else:
                raise ValueError("bytes after the last chunk")

    @property
    def complete(self) -> bool:
        return self.state in ("done", "plain")

    def digest(self) -> str:
        return base64.b32encode(self.hash.digest()).decode()


#: A run of segments has its block, all else what the block holds. refers_to: the name of a revisit's response.
RECORDS = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("segment", pa.int64()), ("last", pa.int64()), ("total", pa.int64()), ("refers_to", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("verified", pa.bool_()), ("block", pa.binary())])
RECORDS_DDL = "page_id long, kind string, name string, segment long, last long, total long, refers_to string, size long, digest string, verified boolean, block binary"


def _number(value: bytes | None) -> int | None:
    return int(value) if value is not None and value != b"null" else None


class Chain:
    """Runs of segments of one origin, fed in order, and what comes of them."""

    def __init__(self) -> None:
        self.payload, self.next, self.length, self.total, self.ok = HttpPayload(), 1, 0, None, True

    def feed(self, first: int, last: int, total: int | None, block: bytes) -> None:
        self.ok = self.ok and first == self.next and self.total is None
        self.next = last + 1
        self.length += len(block)
        self.total = total if total is not None else self.total
        if self.ok:
            try:
                self.payload.feed(block)
            except ValueError:
                self.ok = False

    def verified(self, digest: str) -> bool:
        return self.ok and self.total == self.length and self.payload.complete and self.payload.digest() == digest


def _whole(page: int | None, name: str, digest: str, chain: Chain) -> tuple:
    return page, "response", name, 1, chain.next - 1, chain.total, None, chain.payload.size, chain.payload.digest(), chain.verified(digest), None


def read_rows(records: Iterable[tuple[dict[bytes, bytes], bytes]], run_bytes: int) -> Iterator[tuple]:
    """Rows of RECORDS: segments that follow one another as one run; runs that are a whole block, decoded."""
    run: tuple | None = None  # page, name, digest, first, last, total, blocks, bytes

    def told(page: int | None, name: str, digest: str, first: int, last: int, total: int | None, blocks: list[bytes], _: int) -> tuple:
        block = b"".join(blocks)
        if first == 1 and total == len(block) and run_bytes:
            chain = Chain()
            chain.feed(1, last, total, block)
            return _whole(page, name, digest, chain)
        return page, "continuation" if first > 1 else "response", name, first, last, total, None, None, digest, None, block

    for headers, block in records:
        kind = headers[b"warc-type"]
        page = _number(headers.get(b"x-page-id"))
        name = headers[b"warc-record-id"].strip(b"<>").decode()
        digest = headers.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
        if b"warc-segment-number" in headers:
            name = headers.get(b"warc-segment-origin-id", b"").strip(b"<>").decode() or name
            number, total = int(headers[b"warc-segment-number"]), _number(headers.get(b"warc-segment-total-length"))
            if run is not None and run[1] == name and run[4] + 1 == number and run[5] is None and run[7] + len(block) <= run_bytes:
                run[6].append(block)
                run = (*run[:4], number, total, run[6], run[7] + len(block))
                continue
            if run is not None:
                yield told(*run)
            run = (page, name, digest, number, number, total, [block], len(block))
            continue
        if run is not None:
            yield told(*run)
            run = None
        if kind == b"revisit":
            fields = dict(x.split(b": ", 1) for x in block.split(CRLF) if b": " in x)
            refers = headers[b"warc-refers-to"].strip(b"<>").decode()
            yield page, "revisit", name, None, None, None, refers, _number(fields.get(b"Content-Length")), digest, None, None
        elif kind == b"response":
            chain = Chain()
            chain.feed(1, 1, len(block), block)
            yield _whole(page, name, digest, chain)
    if run is not None:
        yield told(*run)


def read_records(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Records of the archives below path: whole responses with size and digest of their payload, revisits, and runs of
    segments of at most run_bytes (of one segment each where it is 0)."""

    def parsed(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in read_rows(parse_records(inflated(memoryview(content.as_buffer()))), run_bytes):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 1024 or held >= 4 * RUN_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, RECORDS_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(RECORDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS)], schema=RECORDS)


def _joined(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that come by name and segment, as whole responses. Records of one name may come more than once: a run goes to
    a chain that waits for it; where none does, one that has missed something before it takes it and is not verified."""
    rows: list[tuple] = []
    name, page, digest, chains = None, None, "", []

    def finish() -> None:
        rows.extend(_whole(page, name, digest, c) for c in chains)

    for batch in stream:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            first, last = row[3], row[4]
            if row[2] != name:
                finish()
                name, page, digest, chains = row[2], row[0], row[8], []
            chain = next((c for c in chains if c.next == first), None)
            if chain is None and first > 1:
                chain = next((c for c in chains if c.next < first), None)
            if chain is None:
                chains.append(chain := Chain())
            chain.feed(first, last, row[5], row[10])
        if rows:
            yield _batch(rows)
            rows = []
    finish()
    yield _batch(rows)


def reassemble(records: DataFrame) -> DataFrame:
    """A row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id),
    segments and verified. Of runs only those that lie apart are dealt by origin and ordered by segment; a revisit is
    held against its response, whose size and digest it gets. The records, narrow but for such runs, are kept in the
    shared folder: archives are read once."""
    records = cut(records)
    apart = records.where(F.col("block").isNotNull()).repartition("name").sortWithinPartitions("name", "segment").mapInArrow(_joined, RECORDS_DDL)
    narrow = ["page_id", "kind", "name", "last", "refers_to", "size", "digest", "verified"]
    whole = records.where(F.col("block").isNull()).select(narrow)
    responses = whole.where("kind = 'response'").unionByName(apart.select(narrow))
    # dealt by all columns here, so that the join deals both sides anew and Spark can split a response with many revisits
    known = responses.where("verified").select(F.col("name").alias("of"), F.col("page_id").alias("of_page"), F.col("size").alias("of_size"), F.col("digest").alias("of_digest")).distinct()
    revisits = whole.where("kind = 'revisit'").join(known, F.col("refers_to") == F.col("of"), "left")
    found = F.coalesce(F.col("of_digest") == F.col("digest"), F.lit(False))
    return responses.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.col("last").alias("segments"), "verified",
    ).unionByName(revisits.select(
        "page_id", F.coalesce("of_size", "size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"),
        F.coalesce("of_page", F.split_part("refers_to", F.lit(":"), F.lit(3)).try_cast("long")).alias("refers_to"), F.lit(1).cast("long").alias("segments"), found.alias("verified"),
    ))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages to archives below path, reads these back and reassembles the pages."""
    write_archives(pages, path)
    return reassemble(read_records(pages.sparkSession, path))
