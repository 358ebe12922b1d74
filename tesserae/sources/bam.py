"""BAM files: read by ranges of bytes in many tasks, written as one file a task, filtered by a list of holes.

A file is a row of gzip members (blocks) that say how long they are; records run over their edges. A task gets a range:
it finds the first block in it by two headers in a row, and the first record by a chain of records that make sense. That
start is found by looking, so it is proved: the task before, which walks record by record from its own start, must
arrive at the same place, or the read fails. The first range starts behind the file's header, so all starts are proved
one after the other. Records belong to the range in which the block of their first byte starts.

Names of tags and codes of regions are those of the public formats (SAM/BAM, and the one for single molecules): zm is
the hole, qs and qe the place in its read, rq the accuracy, cx the context of a subread, sc the kind of a scrap.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import BLOCK, file_ranges, open_file

#: Fixed values of the format: letters of bases by code, operations of alignments, sizes of number types, the last block.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Kinds of scraps by the letter of their tag.
SCRAPS = {"A": "Adapter", "B": "Barcode", "L": "LQRegion", "F": "Filtered"}

MAGIC = b"BAM\1"
HEAD = struct.Struct("<iiiBBHHHiiii")
CHAIN, LARGEST, PAYLOAD = 4, 1 << 28, 0xFF00
LETTERS, CODES = frozenset(BASES), str.maketrans(BASES, "0123456789abcdef")
HEX = bytes.maketrans(b"0123456789abcdef", BASES.encode())
ROW = "file string, place long, name string, flag int, ref_id int, pos int, mapq int, cigar string, bases string, qualities binary, tags map<string,string>, record binary"


def block_size(data: bytes, at: int) -> int:
    """The size of the block whose header lies at a place of data; 0 if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 12:
        return 0
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(data)):
        n = int.from_bytes(data[i + 2 : i + 4], "little")
        if data[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(data):
            return int.from_bytes(data[i + 4 : i + 6], "little") + 1
        i += 4 + n
    return 0


class Blocks:
    """The text of a file's blocks from one of them on, a window of it at a time."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size, self.next = source, size, start
        self.data, self.base = b"", 0  # text in hand, and how much came before it
        self.edges: list[tuple[int, int]] = []  # (text before a block, its place in the file)

    def _more(self) -> bool:
        if self.next >= self.size:
            return False
        self.source.seek(self.next)
        head = self.source.read(18)
        n = block_size(head, 0)
        if not n and len(head) == 18 and head[:4] == END[:4]:  # another field comes first
            head += self.source.read(int.from_bytes(head[10:12], "little"))
            n = block_size(head, 0)
        if not n:
            raise ValueError(f"no block at {self.next}")
        self.source.seek(self.next)
        raw = self.source.read(n)
        text = zlib.decompress(raw, 31)
        self.edges.append((self.base + len(self.data), self.next))
        self.data += text
        self.next += n
        return True

    def need(self, at: int, n: int) -> bool:
        """Have n bytes of text from a place on; False at the end of the file."""
        while self.base + len(self.data) < at + n:
            if not self._more():
                return False
        return True

    def get(self, at: int, n: int) -> bytes:
        return self.data[at - self.base : at - self.base + n]

    def drop(self, at: int) -> None:
        """Forget the text before a place."""
        if at - self.base > 1 << 20:
            self.data, self.base = self.data[at - self.base :], at
            while len(self.edges) > 1 and self.edges[1][0] <= at:
                self.edges.pop(0)

    def place(self, at: int) -> int | None:
        """The virtual offset of text: the block's place, 16 bits up, and the place in it; None at the end of the file."""
        if not self.need(at, 1):
            return None
        before, block = next(e for e in reversed(self.edges) if e[0] <= at)
        return block << 16 | at - before


def find_block(source, size: int, start: int) -> int:
    """The first block that starts at a place of the file or after it."""
    at = start
    while at < size:
        source.seek(at)
        data = source.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            n = block_size(data, i)
            if n:
                source.seek(at + i + n)
                following = source.read(64)
                if at + i + n == size or block_size(following, 0):
                    return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        if len(data) < 1 << 17:
            break
        at += len(data) - 64
    return size


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]], int]:
    """(text, names and lengths of references, where the records start)."""
    if not blocks.need(0, 8) or blocks.get(0, 4) != MAGIC:
        raise ValueError("not a BAM file")
    n = int.from_bytes(blocks.get(4, 4), "little")
    blocks.need(8, n + 4)
    text, count = blocks.get(8, n).split(b"\0")[0].decode(), int.from_bytes(blocks.get(8 + n, 4), "little")
    at, refs = 12 + n, []
    for _ in range(count):
        blocks.need(at, 4)
        size = int.from_bytes(blocks.get(at, 4), "little")
        blocks.need(at + 4, size + 4)
        refs.append((blocks.get(at + 4, size - 1).decode(), int.from_bytes(blocks.get(at + 4 + size, 4), "little")))
        at += 8 + size
    return text, refs, at


def _sensible(blocks: Blocks, at: int, refs: int) -> int:
    """The size of what may be a record at a place of the text; 0 if it is none, -1 at the end of the file."""
    if not blocks.need(at, 1):
        return -1
    if not blocks.need(at, 36):
        return 0
    size, ref, pos, name, _, _, ops, _, bases, ref2, pos2, _ = HEAD.unpack(blocks.get(at, 36))
    if not (-1 <= ref < refs and -1 <= ref2 < refs and pos >= -1 and pos2 >= -1 and name >= 2 and bases >= 0):
        return 0
    if not 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size <= LARGEST or not blocks.need(at + 36, name):
        return 0
    text = blocks.get(at + 36, name)
    return size + 4 if text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def first_record(source, size: int, start: int, refs: int) -> int | None:
    """The virtual offset of the first record in or after the blocks that start at a place of the file or later."""
    block = find_block(source, size, start)
    blocks, at = Blocks(source, size, block), 0
    while blocks.need(at, 1):
        here, good = at, 0
        while good < CHAIN:
            n = _sensible(blocks, here, refs)
            if n <= 0:
                break
            here, good = here + n, good + 1
        if good == CHAIN or (good and n < 0):
            return blocks.place(at)
        at += 1
        blocks.drop(at)
    return None


def parse_tags(data: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i + 3 <= len(data):
        name, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind == "A":
            out[name], i = chr(data[i]), i + 1
        elif kind in "ZH":
            end = data.index(0, i)
            out[name], i = data[i:end].decode(), end + 1
        elif kind == "B":
            form, n = NUMBERS[chr(data[i])], int.from_bytes(data[i + 1 : i + 5], "little")
            values = struct.unpack_from(f"<{n}{form[1]}", data, i + 5)
            out[name], i = ",".join(map(str, values)), i + 5 + n * struct.calcsize(form)
        else:
            form = NUMBERS[kind]
            out[name], i = str(struct.unpack_from(form, data, i)[0]), i + struct.calcsize(form)
    return out


def decode(record: bytes) -> tuple:
    """name, flag, ref_id, pos, mapq, cigar, bases, qualities, tags of a record with its size in front."""
    _, ref, pos, name, mapq, _, ops, flag, bases, _, _, _ = HEAD.unpack_from(record)
    at = 36 + name
    cigar = "".join(f"{c >> 4}{CIGAR[c & 15]}" for c in struct.unpack_from(f"<{ops}I", record, at))
    at += 4 * ops
    packed = record[at : at + (bases + 1) // 2]
    at += len(packed)
    text = packed.hex().encode().translate(HEX)[:bases].decode()
    qualities = record[at : at + bases]
    return record[36 : 35 + name].decode(), flag, ref, pos, mapq, cigar, text, None if qualities[:1] == b"\xff" else qualities, parse_tags(record[at + bases :])


def encode(name: str, bases: str, tags: list[tuple[str, str, object]], qualities: bytes | None = None, flag: int = 4, ref: int = -1, pos: int = -1, mapq: int = 255, cigar: list[tuple[int, str]] | None = None) -> bytes:
    """A record with its size in front; tags are (name, type, value), a B type has its number's letter after it."""
    ops = b"".join(struct.pack("<I", n << 4 | CIGAR.index(c)) for n, c in cigar or [])
    if not LETTERS.issuperset(bases):
        raise ValueError("a base has no code")
    packed = bytes.fromhex(bases.translate(CODES) + "0" * (len(bases) % 2))
    out = []
    for key, kind, value in tags:
        if kind == "A":
            body = value.encode()
        elif kind in ("Z", "H"):
            body = value.encode() + b"\0"
        elif kind[0] == "B":
            body = kind[1].encode() + struct.pack(f"<i{len(value)}{NUMBERS[kind[1]][1]}", len(value), *value)
        else:
            body = struct.pack(NUMBERS[kind], value)
        out.append(key.encode() + kind[:1].encode() + body)
    body = name.encode() + b"\0" + ops + packed + (qualities if qualities is not None else b"\xff" * len(bases)) + b"".join(out)
    return HEAD.pack(32 + len(body), ref, pos, len(name) + 1, mapq, 4680, len(cigar or []), flag, len(bases), -1, -1, 0) + body


def records_of(source, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) of a range of a file, whose start and end are proved; see the module's text."""
    head = Blocks(source, size, 0)
    _, refs, at = read_header(head)
    first = head.place(at) if start == 0 else first_record(source, size, start, len(refs))
    if first is not None and first >> 16 < stop:
        blocks, at = Blocks(source, size, first >> 16), first & 0xFFFF
        while (place := blocks.place(at)) is not None and place >> 16 < stop:
            if not blocks.need(at, 4):
                raise ValueError("a record is cut off")
            n = 4 + int.from_bytes(blocks.get(at, 4), "little")
            if n < 36 or not blocks.need(at, n):
                raise ValueError("a record is cut off")
            yield place, blocks.get(at, n)
            at += n
            blocks.drop(at)
        first = place
    if stop < size and first_record(source, size, stop, len(refs)) != first:
        raise ValueError(f"the first record after byte {stop} is not where it was looked for")


KINDS = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROW.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            system, path = open_file(row["file"])
            with system.open_input_file(path) as source:
                rows, held = [], 0

                def made(file=row["file"]) -> pa.RecordBatch:
                    columns = zip(*[(file, place, *(parts := decode(r))[:8], list(parts[8].items()), r) for place, r in rows], strict=True)
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=names)

                for place, record in records_of(source, row["size"], row["start"], row["stop"]):
                    rows.append((place, record))
                    held += len(record)
                    if held > 1 << 22:
                        yield made()
                        rows, held = [], 0
                if rows:
                    yield made()


def read_bam(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """A row for each record: where it lies (file and virtual offset), its parts as text, and the record itself."""
    return file_ranges(spark, path, block).mapInArrow(_read, ROW)


def header_text(spark: SparkSession, path: str) -> str:
    """The text of the first file's header."""
    name = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").first()
    system, place = open_file(name["path"])
    with system.open_input_file(place) as source:
        return read_header(Blocks(source, name["length"], 0))[0]


def deflate(data: bytes) -> bytes:
    """One block."""
    own = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = own.compress(data) + own.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _writer(folder: str, text: str, refs: list[tuple[str, int]]):
    head = MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = open_file(folder)
        name = f"part-{context.partitionId():05d}.bam"
        temp = f"{root}/.{name}.{context.taskAttemptId()}"
        n, held = 0, bytearray(head)
        with system.open_output_stream(temp, compression=None) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    held += record
                    n += 1
                    while len(held) >= PAYLOAD:
                        out.write(deflate(bytes(held[:PAYLOAD])))
                        del held[:PAYLOAD]
            if held:
                out.write(deflate(bytes(held)))
            out.write(END)
        system.move(temp, f"{root}/{name}")  # a task run again writes the same file
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "records"])

    return run


def write_bam(records: DataFrame, folder: str, text: str = "@HD\tVN:1.6\n", refs: list[tuple[str, int]] | None = None) -> DataFrame:
    """Write the column `record` as a BAM file for each partition, in its order; returns file and number of records."""
    system, root = open_file(folder)
    system.create_dir(root, recursive=True)
    made = records.select("record").mapInArrow(_writer(folder, text, refs or []), "file string, records long").collect()
    return records.sparkSession.createDataFrame(made, "file string, records long")


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = {v: k for k, v in SCRAPS.items()}
    for batch in batches:
        made = []
        for hole, start, stop, kind, bases, accuracy, zmw_type, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tags = [("zm", "i", hole), ("qs", "i", start), ("qe", "i", stop)]
            tags += [("rq", "f", accuracy / 1000)] if accuracy is not None else []
            tags += [("cx", "C", 0)] if kind == "Insert" else [("sc", "A", code[kind])] if kind else []
            tags += [("sz", "A", zmw_type)] if zmw_type else []
            made.append(encode(f"{cell}/{hole}/{start}_{stop}", bases or "", tags))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], names=["hole", "start", "record"])


def make_records(rows: DataFrame, cell: str = "cell") -> DataFrame:
    """hole, start, record of unaligned parts of molecules: rows as `molecules` gives them, none null but kind, bases, accuracy, zmw_type."""
    own = rows.select(*[F.col(c).cast("int") for c in ("hole", "start", "stop")], "kind", "bases", F.col("accuracy").cast("int").alias("accuracy"), "zmw_type", F.lit(cell).alias("cell"))
    return own.mapInArrow(_make, "hole int, start int, record binary")


def white_list(lines: DataFrame, cell: str, column: str = "value") -> DataFrame:
    """hole, start (null for the whole hole) of lines `cell/hole` or `cell/hole/start_end`; those of other cells go."""
    parts = F.split(F.col(column), "/")
    own = lines.where(parts[0] == cell).select(F.expr(f"try_cast(regexp_extract({column}, '^[^/]*/([0-9]+)', 1) AS int)").alias("hole"), F.expr(f"try_cast(nullif(regexp_extract({column}, '^[^/]*/[0-9]+/([0-9]+)_', 1), '') AS int)").alias("start"))
    return own.where("hole is not null").distinct()


def molecules(records: DataFrame) -> DataFrame:
    """Records with hole, start, stop, kind (Insert for subreads), accuracy in thousandths and zmw_type, from their tags."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    kind = F.create_map(*[F.lit(x) for pair in SCRAPS.items() for x in pair])
    return records.select(
        "*",
        tag("zm").cast("int").alias("hole"),
        tag("qs").cast("int").alias("start"),
        tag("qe").cast("int").alias("stop"),
        F.coalesce(F.try_element_at(kind, tag("sc")), F.when(tag("cx").isNotNull(), "Insert")).alias("kind"),
        F.floor(1000 * tag("rq").cast("float")).cast("int").alias("accuracy"),
        tag("sz").alias("zmw_type"),
    )


def filter_molecules(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `molecules` whose hole, and start where one is given, is on a white list."""
    own = chosen.select(F.col("hole").alias("_hole"), F.col("start").alias("_start"))
    return rows.join(own, (F.col("hole") == F.col("_hole")) & (F.col("_start").isNull() | (F.col("start") == F.col("_start"))), "left_semi")


def read_pair(spark: SparkSession, subreads: str, block: int = BLOCK) -> DataFrame:
    """The molecules of a file of subreads and of the file of scraps that its name leads to, if there is one."""
    if "subreads" not in subreads:
        raise ValueError("the name does not say subreads")
    system, place = open_file(subreads.replace("subreads", "scraps")) if "://" in subreads else open_file(f"file://{subreads.replace('subreads', 'scraps')}")
    from pyarrow import fs

    found = system.get_file_info(place).type != fs.FileType.NotFound
    return molecules(read_bam(spark, [subreads, subreads.replace("subreads", "scraps")] if found else subreads, block))
