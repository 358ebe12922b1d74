"""WARC archives: written one gzip member per record, read back sequentially.

Writing: records with the same payload of at least MIN_REVISIT bytes are found by a join on the payload's SHA-256; the
one with the smallest id is a response, the others are revisits that name it and leave the payload out. Smaller payloads
are always responses. A task writes one archive, under a temporary name that is then renamed.

Reading: an archive is read block by block; zlib inflates it incrementally and shows where each member ends; a record is
framed by its Content-Length; block and payload digests are verified where the record has them. A record that breaks
one of these rules fails the job and is named. Archives of others are read too: of their records, responses, revisits and
resources are rows; other types, such as warcinfo and request, are passed over. Digests may be hexadecimal or base 32; one
of an unknown kind is not verified. Chunked bodies are put together; a body marked as truncated may be short.

Rows: one per input row. Null html: empty payload, a response. Null url: an empty target. Null page_id: written with an
empty id; it takes part neither as the named response nor as a revisit. Rows that repeat a page_id: copies of the payload
with the smallest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feistel_output import _filesystem
from .scratch import new_dir, save

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16

READ = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(value: str | None) -> int | None:
    """The page of a record id; null for ids that aren't ours."""
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdecimal() else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The gzip member of a record; payloads of revisits are left out, their length stays in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url or "")  # no break can end the header early
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {IDENTICAL}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other; holds one member and one block."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(BLOCK)
            if not data:
                break
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> Record:
    """The record of a member, framed by Content-Length and verified against its block digest."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: its length is not {size}")
    block = rest[:size]
    if not _agrees(headers.get("warc-block-digest", ""), block):
        raise ValueError(f"{headers.get('warc-record-id')}: block digest differs")
    return Record(headers, block)


def _agrees(label: str, data: bytes) -> bool:
    """Whether data has the digest of a label such as sha1:...; true for no digest and for unknown kinds."""
    kind, _, expected = label.partition(":")
    if not expected or kind.lower() not in hashlib.algorithms_guaranteed or kind.lower().startswith("shake"):
        return True
    digest = hashlib.new(kind.lower(), data).digest()
    return expected.lower() == digest.hex() or expected.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _joined(body: bytes) -> bytes:
    """A chunked body put together; what follows a broken or missing chunk is left out."""
    parts, at = [], 0
    while True:
        line, gap, _ = body[at : at + 100].partition(b"\r\n")
        try:
            size = int(line.split(b";")[0], 16) if gap else 0
        except ValueError:
            size = 0
        if size <= 0:
            return b"".join(parts)
        at += len(line) + 2
        parts.append(body[at : at + size])
        at += size + 2


def page_of(record: Record) -> tuple | None:
    """A row of READ, null for types without a payload; verifies length and payload digest of a record that has its payload.

    payload_digest is the SHA-256 of the payload; of a revisit, which has none, what its header says. payload_bytes is
    null for a revisit whose HTTP header gives no length.
    """
    headers = record.headers
    kind = headers.get("warc-type", "").lower()
    if kind not in ("response", "revisit", "resource"):
        return None
    name, label = headers.get("warc-record-id"), headers.get("warc-payload-digest", "")
    fields, payload = {}, record.block
    if kind != "resource" and headers.get("content-type", "application/http").lower().startswith("application/http"):
        http, _, payload = record.block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    given = int(fields["content-length"]) if fields.get("content-length", "").isdecimal() else None
    sha = label.partition(":")[2]
    if kind != "revisit":
        whole = payload
        if fields.get("transfer-encoding", "").lower() == "chunked":
            payload, given = _joined(whole), None
        exact = given is None or len(payload) == given
        if "warc-truncated" not in headers and not (exact and (_agrees(label, payload) or _agrees(label, whole))):
            raise ValueError(f"{name}: payload differs from its digest or length")
        given, sha = len(payload), hashlib.sha256(payload).hexdigest()
    return _page_id(name), headers.get("warc-target-uri"), given, sha or None, kind, _page_id(headers.get("warc-refers-to")), name, payload if kind != "revisit" else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        context = TaskContext.get()
        temp, name = f"{root}/.part.{context.taskAttemptId()}", f"part-{context.partitionId():06d}.warc.gz"
        n, out = 0, None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                out = out or system.open_output_stream(temp, compression=None)
                html = html.as_py()
                out.write(make_record(page_id.as_py(), url.as_py(), html.encode() if html else b"", digest.as_py(), refers_to.as_py()))
                n += 1
        if out:
            out.close()
            system.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

    return run


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in READ.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    for member in members(stream):
                        row = page_of(parse(member))
                        if row is None:
                            continue
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(member) if payloads else 200
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write the archives; returns the folder and the manifest (archive, records)."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    marked = rows.join(firsts, "digest", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    manifest = marked.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_writer(folder), "archive string, records long")
    return folder, save(manifest, "manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """archive: the names of the files in a folder that end in .warc.gz, for read_archives; like any file listing, on the driver."""
    system, root = _filesystem(folder)
    found = system.get_file_info(FileSelector(root))
    return spark.createDataFrame([(x.base_name,) for x in found if x.is_file and x.base_name.endswith(".warc.gz") and not x.base_name.startswith(".")], "archive string")


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in the manifest, as rows of READ; payload null for revisits or if not asked for.

    A task for each archive, as one is read from its start to its end.
    """
    count = max(1, manifest.count())
    return manifest.select("archive").repartition(count).mapInArrow(_reader(folder, payloads), READ)
