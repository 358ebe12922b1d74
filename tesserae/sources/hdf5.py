"""HDF5 files of base calls: datasets read by ranges of rows, chunks of a file by many tasks, without another library.

Of the public format, what such files use: a superblock of version 0, groups as trees of symbol tables, object headers of
version 1, and datasets that are contiguous or in chunks (deflated and shuffled or not), of whole numbers or floats. A
task reads the few blocks on the way to a dataset and then the chunks that its rows lie in. How many bases the holes of a
file have is summed up where the file is listed, a number a hole; a range of holes then is one range of rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import open_file

#: The file's first bytes, an address that leads nowhere, kinds of messages and filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
SPACE, TYPE, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, GROUP = 1, 3, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3

BASE_CALLS, CONSENSUS, REGIONS = "PulseData/BaseCalls", "PulseData/ConsensusBaseCalls", "PulseData/Regions"
REGION_TYPES = ("Adapter", "Insert", "HQRegion")
SPAN = 1 << 20  # bases that a task reads at once


class File:
    """The names of a file and where their objects lie."""

    def __init__(self, source):
        self.source = source
        if self.read(0, 8) != SIGNATURE:
            raise ValueError("not an HDF5 file")
        head = self.read(8, 16)
        if head[0] != 0 or head[5] != 8 or head[6] != 8:
            raise ValueError("only superblocks of version 0 with addresses of 8 bytes")
        (self.root,) = struct.unpack("<Q", self.read(64, 8))

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        out = self.source.read(n)
        if len(out) != n:
            raise ValueError("the file is cut off")
        return out

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """(kind, data) of the messages of an object."""
        version, _, count, _, size = struct.unpack("<BBHII", self.read(at, 12))
        if version != 1:
            raise ValueError("only object headers of version 1")
        out, blocks = [], [(at + 16, size)]
        while blocks:
            at, size = blocks.pop(0)
            data, i = self.read(at, size), 0
            while i + 8 <= size and len(out) < count:
                kind, n = struct.unpack_from("<HH", data, i)
                body = data[i + 8 : i + 8 + n]
                out.append((kind, body))
                if kind == CONTINUED:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                i += 8 + n
        return out

    def members(self, at: int) -> dict[str, int]:
        """Names in a group and their objects."""
        table = dict(self.messages(at)).get(GROUP)
        if table is None:
            raise KeyError("not a group")
        tree, heap = struct.unpack("<QQ", table[:16])
        size, _, place = struct.unpack("<QQQ", self.read(heap + 8, 24))
        names, out, nodes = self.read(place, size), {}, [tree]
        while nodes:
            node = nodes.pop()
            head = self.read(node, 8)
            if head[:4] == b"TREE":
                n = struct.unpack_from("<H", head, 6)[0]
                body = self.read(node + 24, 16 * n + 8)
                nodes += [struct.unpack_from("<Q", body, 16 * k + 8)[0] for k in range(n)]
            elif head[:4] == b"SNOD":
                n = struct.unpack_from("<H", head, 6)[0]
                body = self.read(node + 8, 40 * n)
                for k in range(n):
                    name, child = struct.unpack_from("<QQ", body, 40 * k)
                    out[names[name : names.index(b"\0", name)].decode()] = child
            else:
                raise ValueError("a group's tree is broken")
        return out

    def find(self, path: str) -> int | None:
        """Where an object lies, or None."""
        at = self.root
        for name in path.strip("/").split("/"):
            try:
                at = self.members(at).get(name)
            except KeyError:
                return None
            if at is None:
                return None
        return at

    def dataset(self, path: str) -> Dataset | None:
        at = self.find(path)
        return None if at is None else Dataset(self, dict(self.messages(at)))

    def attribute(self, path: str, name: str) -> np.ndarray | None:
        """The numbers of an attribute of an object."""
        at = self.find(path)
        for kind, data in self.messages(at) if at is not None else []:
            if kind != ATTRIBUTE or data[0] != 1:
                continue
            sizes = struct.unpack_from("<HHH", data, 2)
            start = [8]
            for n in sizes:
                start.append(start[-1] + (n + 7) // 8 * 8)
            if data[start[0] : start[0] + sizes[0]].split(b"\0")[0].decode() == name:
                shape, number = _shape(data[start[2] :]), _number(data[start[1] :])
                return np.frombuffer(data, number, int(np.prod(shape, dtype=np.int64)), start[3]).reshape(shape)
        return None


def _shape(space: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)


def _number(kind: bytes) -> np.dtype:
    if kind[0] & 15 not in (0, 1):
        raise ValueError("only numbers")
    letter = "f" if kind[0] & 15 == 1 else "i" if kind[1] & 8 else "u"
    return np.dtype(f"{'>' if kind[1] & 1 else '<'}{letter}{struct.unpack_from('<I', kind, 4)[0]}")


class Dataset:
    """Rows of a dataset: its first dimension is read by ranges, the others whole."""

    def __init__(self, file: File, messages: dict[int, bytes]):
        self.file = file
        layout, self.shape, self.kind = messages[LAYOUT], _shape(messages[SPACE]), _number(messages[TYPE])
        if layout[0] != 3:
            raise ValueError("only layouts of version 3")
        self.compact = self.chunk = None
        if layout[1] == 0:
            self.compact = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
        elif layout[1] == 1:
            (self.at,) = struct.unpack_from("<Q", layout, 2)
        else:
            rank = layout[2]
            (self.at,) = struct.unpack_from("<Q", layout, 3)
            self.chunk = struct.unpack_from(f"<{rank - 1}I", layout, 11)
        self.filters = self._filters(messages.get(FILTERS))

    @staticmethod
    def _filters(data: bytes | None) -> list[int]:
        out, at = [], 8
        for _ in range(data[1] if data else 0):
            kind, name, _, values = struct.unpack_from("<HHHH", data, at)
            out.append(kind)
            at += 8 + (name + 7) // 8 * 8 + 4 * (values + values % 2)
        if set(out) - {DEFLATE, SHUFFLE, CHECKSUM}:
            raise ValueError("a filter is not known")
        return out

    def rows(self, start: int, stop: int) -> np.ndarray:
        """Rows start to stop - 1."""
        start, stop = max(0, start), min(stop, self.shape[0])
        width = int(np.prod(self.shape[1:], dtype=np.int64))
        if stop <= start or not width:
            return np.zeros((max(0, stop - start), *self.shape[1:]), self.kind)
        row = width * self.kind.itemsize
        if self.compact is not None:
            return np.frombuffer(self.compact, self.kind).reshape(self.shape)[start:stop]
        if self.chunk is None:
            data = self.file.read(self.at + start * row, (stop - start) * row) if self.at != NOWHERE else bytes((stop - start) * row)
            return np.frombuffer(data, self.kind).reshape(stop - start, *self.shape[1:])
        out = np.zeros((stop - start, *self.shape[1:]), self.kind)
        for at, size, mask, place in self._chunks(start, stop):
            block = self._unfiltered(self.file.read(at, size), mask)
            low, high = max(start, place[0]), min(stop, place[0] + self.chunk[0], self.shape[0])
            others = tuple(slice(p, min(p + c, s)) for p, c, s in zip(place[1:], self.chunk[1:], self.shape[1:], strict=True))
            inside = tuple(slice(0, o.stop - o.start) for o in others)
            out[(slice(low - start, high - start), *others)] = block[(slice(low - place[0], high - place[0]), *inside)]
        return out

    def _chunks(self, start: int, stop: int) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        """(place, size, filters left out, first indexes) of the chunks that hold rows of a range."""
        if self.at == NOWHERE:
            return
        rank, nodes = len(self.shape), [self.at]
        key = 8 + 8 * (rank + 1)
        while nodes:
            node = nodes.pop()
            head = self.file.read(node, 24)
            if head[:5] != b"TREE\1":
                raise ValueError("a dataset's tree is broken")
            level, n = head[5], struct.unpack_from("<H", head, 6)[0]
            body = self.file.read(node + 24, n * (key + 8) + key)
            first = [struct.unpack_from(f"<{rank}Q", body, k * (key + 8) + 8) for k in range(n + 1)]
            for k in range(n):
                # keys rise, so what lies behind an entry starts no later than the next key says
                if first[k][0] >= stop or (level and first[k + 1][0] < start) or (not level and first[k][0] + self.chunk[0] <= start):
                    continue
                child = struct.unpack_from("<Q", body, k * (key + 8) + key)[0]
                if level:
                    nodes.append(child)
                else:
                    size, mask = struct.unpack_from("<II", body, k * (key + 8))
                    yield child, size, mask, first[k]

    def _unfiltered(self, data: bytes, mask: int) -> np.ndarray:
        for i, kind in reversed(list(enumerate(self.filters))):
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                data = zlib.decompress(data)
            elif kind == SHUFFLE:
                data = np.frombuffer(data, np.uint8).reshape(self.kind.itemsize, -1).T.tobytes()
            else:
                data = data[:-4]
        return np.frombuffer(data, self.kind).reshape(self.chunk)


def opened(name: str) -> File:
    system, place = open_file(name)
    return File(system.open_input_file(place))


def _names(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, each in a partition of its own if there are not too many."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # no content is read
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "file")


HOLES = "file string, hole int, status int, x int, y int, first long, count long"


def hole_index(spark: SparkSession, path: str, group: str = BASE_CALLS) -> DataFrame:
    """file, hole, status, x, y, first base, number of bases of each hole; files without the group have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                file, first = opened(name), 0
                sets = {n: file.dataset(f"{group}/ZMW/{n}") for n in ("HoleNumber", "HoleStatus", "HoleXY", "NumEvent")}
                if sets["HoleNumber"] is None or sets["NumEvent"] is None:
                    continue
                for at in range(0, sets["HoleNumber"].shape[0], 1 << 16):
                    hole, count = (sets[n].rows(at, at + (1 << 16)).astype(np.int64).ravel() for n in ("HoleNumber", "NumEvent"))
                    status = sets["HoleStatus"].rows(at, at + (1 << 16)).astype(np.int64).ravel() if sets["HoleStatus"] else np.zeros(len(hole), np.int64)
                    xy = sets["HoleXY"].rows(at, at + (1 << 16)).astype(np.int64) if sets["HoleXY"] else np.stack([hole >> 16, hole & 0xFFFF], axis=1)
                    before = first + np.cumsum(count) - count
                    first += int(count.sum())
                    columns = [pa.array([name] * len(hole)), *[pa.array(c, pa.int32()) for c in (hole, status, xy[:, 0], xy[:, 1])], pa.array(before), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HOLES.split(", ")])

    return _names(spark, path).mapInArrow(run, HOLES)


def region_index(spark: SparkSession, path: str, types: tuple[str, ...] = REGION_TYPES) -> DataFrame:
    """hole, type, start, stop, quality: the table of regions; a number without a type is Useless."""

    names = pa.array([*types, "Useless"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                table = opened(name).dataset(REGIONS)
                for at in range(0, table.shape[0] if table else 0, 1 << 16):
                    rows = table.rows(at, at + (1 << 16)).astype(np.int64)
                    kinds = names.take(pa.array(np.where((rows[:, 1] >= 0) & (rows[:, 1] < len(types)), rows[:, 1], len(types))))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int32()), kinds, *[pa.array(rows[:, c], pa.int32()) for c in (2, 3, 4)]], names=["hole", "type", "start", "stop", "quality"])

    return _names(spark, path).mapInArrow(run, "hole int, type string, start int, stop int, quality int")


CALLS = "hole int, x int, y int, status int, bases string, qualities binary, pre_frames array<int>, width_frames array<int>"


def read_calls(index: DataFrame, group: str = BASE_CALLS) -> DataFrame:
    """hole, x, y, status, bases, qualities and frames (null where the file has none) of rows of a hole index.

    Holes of a file that follow each other are read together, SPAN bases at most and one hole at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sets = None, {}
        for batch in batches:
            rows, at = batch.to_pylist(), 0
            while at < len(rows):
                if rows[at]["file"] != name:
                    name = rows[at]["file"]
                    file = opened(name)
                    sets = {n: file.dataset(f"{group}/{n}") for n in ("Basecall", "QualityValue", "PreBaseFrames", "WidthInFrames")}
                end, low = at + 1, rows[at]["first"]
                while end < len(rows) and rows[end]["file"] == name and rows[end]["first"] == rows[end - 1]["first"] + rows[end - 1]["count"] and rows[end]["first"] + rows[end]["count"] - low <= SPAN:
                    end += 1
                own = rows[at:end]
                high = own[-1]["first"] + own[-1]["count"]
                data = {n: s.rows(low, high).ravel() if s else None for n, s in sets.items()}
                part = lambda n, r, data=data, low=low: None if data[n] is None else data[n][r["first"] - low : r["first"] - low + r["count"]]
                byte = lambda n, r, part=part: None if (v := part(n, r)) is None else v.astype(np.uint8).tobytes()
                number = lambda n, r, part=part: None if (v := part(n, r)) is None else v.astype(np.int32)
                columns = [pa.array([r[c] for r in own], pa.int32()) for c in ("hole", "x", "y", "status")]
                columns += [pa.array([(byte("Basecall", r) or b"").decode("latin-1") for r in own], pa.string()), pa.array([byte("QualityValue", r) for r in own], pa.binary())]
                columns += [pa.array([number(n, r) for r in own], pa.list_(pa.int32())) for n in ("PreBaseFrames", "WidthInFrames")]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CALLS.split(", ")])
                at = end

    spread = index.select("file", "hole", "x", "y", "status", "first", "count").repartitionByRange("file", "first").sortWithinPartitions("file", "first")
    return spread.mapInArrow(run, CALLS)


def read_traces(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """hole, channel, trace: the frames of each channel of each hole, decoded by the file's table less its bias if it has one.

    A task reads some holes of a file at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = opened(name)
                holes, traces = file.dataset("TraceData/HoleNumber").rows(start, start + rows).ravel(), file.dataset("TraceData/Traces").rows(start, start + rows)
                table, bias = file.dataset("TraceData/Codec/Decode"), file.attribute("TraceData/Codec/Decode", "Bias")
                values = traces.astype(np.float64)
                if table is not None:
                    values = table.rows(0, table.shape[0]).astype(np.float64)[traces] - (0 if bias is None else float(bias.ravel()[0]))
                n, channels = traces.shape[:2]
                columns = [np.repeat(holes, channels).astype(np.int32), np.tile(np.arange(channels, dtype=np.int32), n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(values.reshape(n * channels, -1).astype(np.float32)), pa.list_(pa.float32()))], names=["hole", "channel", "trace"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = opened(name).dataset("TraceData/HoleNumber")
                starts = list(range(0, found.shape[0] if found else 0, rows))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int64())], names=["file", "start"])

    listed = _names(spark, path).mapInArrow(parts, "file string, start long").repartition(4 * spark.sparkContext.defaultParallelism, "file", "start")
    return listed.mapInArrow(run, "hole int, channel int, trace array<float>")


def read_zmw(spark: SparkSession, path: str, types: tuple[str, ...] = REGION_TYPES) -> DataFrame:
    """The table zmw of files of base calls: their holes with bases, qualities, frames and regions in the file's order of start.

    Spark takes the size of the list of files for that of what they hold, so without a hint it would broadcast all regions.
    """
    regions = region_index(spark, path, types).groupBy(F.col("hole").alias("_hole"))
    regions = regions.agg(F.sort_array(F.collect_list(F.struct("start", "stop", "type", "quality"))).alias("r"))
    calls = read_calls(hole_index(spark, path))
    own = F.transform(F.coalesce("r", F.array().cast(regions.schema["r"].dataType)), lambda r: F.struct(r["type"].alias("type"), r["start"].alias("start"), r["stop"].alias("stop"), r["quality"].alias("quality")))
    return calls.join(regions.hint("merge"), F.col("hole") == F.col("_hole"), "left").withColumn("regions", own).drop("_hole", "r")


def make_file(tree: dict, chunk: int = 0, attributes: dict[str, dict[str, int]] | None = None) -> bytes:
    """A file of nested dicts of arrays; chunk: rows of a chunk, shuffled and deflated, else contiguous; attributes: whole numbers by
    the name of a dataset."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        at = len(out)
        out.extend(data)
        return at

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHBxxx", kind, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for kind, d in messages)
        return put(struct.pack("<BBHIIxxxx", 1, 0, len(messages), 1, len(body)) + body)

    def noted(name: str) -> list[tuple[int, bytes]]:
        out = []
        for key, value in (attributes or {}).get(name, {}).items():
            kind, text = struct.pack("<BBBBIHH4x", 0x10, 8, 0, 0, 8, 0, 64), key.encode() + b"\0"
            out.append((ATTRIBUTE, struct.pack("<BxHHH", 1, len(text), 12, 8) + text + bytes(-len(text) % 8) + kind + struct.pack("<BBB5x", 1, 0, 0) + struct.pack("<q", value)))
        return out

    def dataset(a: np.ndarray, name: str) -> int:
        space = struct.pack("<BBB5x", 1, a.ndim, 0) + struct.pack(f"<{a.ndim}Q", *a.shape)
        size = a.dtype.itemsize
        if a.dtype.kind == "f":
            widths = {4: (23, 8, 23, 127), 8: (52, 11, 52, 1023)}[size]
            kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, size * 8 - 1, 0, size, 0, size * 8, widths[0], widths[1], 0, widths[2], widths[3])
        else:
            kind = struct.pack("<BBBBIHH", 0x10, 8 if a.dtype.kind == "i" else 0, 0, 0, size, 0, size * 8)
        messages = [(SPACE, space), (TYPE, kind), *noted(name)]
        if not chunk or not a.size:
            at = put(a.tobytes()) if a.size else NOWHERE
            return header([*messages, (LAYOUT, struct.pack("<BBQQ", 3, 1, at, a.nbytes))])
        blocks = []
        for first in range(0, a.shape[0], chunk):
            block = np.zeros((chunk, *a.shape[1:]), a.dtype)
            block[: len(a[first : first + chunk])] = a[first : first + chunk]
            data = zlib.compress(block.view(np.uint8).reshape(-1, size).T.tobytes())
            blocks.append((first, len(data), put(data)))
        key = lambda first, n: struct.pack("<II", n, 0) + struct.pack(f"<{a.ndim + 1}Q", first, *[0] * a.ndim)
        node = lambda level, items, end: put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(items), NOWHERE, NOWHERE) + b"".join(key(f, n) + struct.pack("<Q", at) for f, n, at in items) + key(end, 0))
        leaves = [(blocks[k][0], 0, node(0, blocks[k : k + 32], blocks[k + 32][0] if k + 32 < len(blocks) else len(blocks) * chunk)) for k in range(0, len(blocks), 32)]
        tree = leaves[0][2] if len(leaves) == 1 else node(1, leaves, len(blocks) * chunk)
        layout = struct.pack("<BBBQ", 3, 2, a.ndim + 1, tree) + struct.pack(f"<{a.ndim + 1}I", chunk, *a.shape[1:], size)
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", SHUFFLE, 0, 0, 1, size, 0) + struct.pack("<HHHHII", DEFLATE, 0, 0, 1, 6, 0)
        return header([*messages, (FILTERS, filters), (LAYOUT, layout)])

    def group(members: dict) -> int:
        places = {name: group(v) if isinstance(v, dict) else dataset(np.ascontiguousarray(v), name) for name, v in members.items()}
        names, text = {}, bytearray(8)
        for name in sorted(places):
            names[name] = len(text)
            text += name.encode() + b"\0" + bytes(-(len(name) + 1) % 8)
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), NOWHERE, put(bytes(text))))
        ordered = sorted(places)
        nodes = []
        for k in range(0, len(ordered), 8):
            own = ordered[k : k + 8]
            nodes.append((names[own[-1]], put(b"SNOD" + struct.pack("<BBH", 1, 0, len(own)) + b"".join(struct.pack("<QQIIQQ", names[n], places[n], 0, 0, 0, 0) for n in own))))
        tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NOWHERE, NOWHERE) + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", at, last) for last, at in nodes))
        return header([(GROUP, struct.pack("<QQ", tree, heap))])

    root = group(tree)
    out[:96] = SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(out), NOWHERE) + struct.pack("<QQIIQQ", 0, root, 0, 0, 0, 0)
    return bytes(out)


def _whole(column: pa.Array, kind) -> np.ndarray:
    if column.null_count:
        raise ValueError("a hole or region has a null")
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _calls_tree(batches: list[pa.RecordBatch], types: tuple[str, ...]) -> dict:
    """The groups and datasets of a file of holes."""
    table = pa.Table.from_batches(batches).combine_chunks()
    get = lambda c: table.column(c).chunk(0)
    hole, bases, regions = _whole(get("hole"), np.int64), pc.fill_null(get("bases"), ""), get("regions")
    size = pc.utf8_length(bases).to_numpy(zero_copy_only=False).astype(np.int32)
    letters = np.frombuffer("".join(bases.to_pylist()).encode("latin-1"), np.uint8)
    count = pc.fill_null(pc.list_value_length(regions), 0).to_numpy(zero_copy_only=False)
    flat = regions.flatten()
    kind = pc.index_in(flat.field("type"), pa.array(types))
    if kind.null_count:
        raise ValueError(f"a type of region is none of {types}")
    rows = [np.repeat(hole, count), _whole(kind, np.int32), *[_whole(flat.field(c), np.int32) for c in ("start", "stop", "quality")]]
    holes = {"HoleNumber": hole.astype(np.uint32), "HoleStatus": _whole(get("status"), np.uint8), "HoleXY": np.stack([_whole(get("x"), np.int32), _whole(get("y"), np.int32)], axis=1), "NumEvent": size}
    return {"PulseData": {"BaseCalls": {"Basecall": letters, "ZMW": holes}, "Regions": np.stack(rows, axis=1).astype(np.int32)}}


def write_calls(zmw: DataFrame, folder: str, chunk: int = 1 << 14, types: tuple[str, ...] = REGION_TYPES, holes: int = 1 << 16, bases: int = 1 << 24) -> DataFrame:
    """Write holes (hole, x, y, status, bases, regions) as files of base calls, each partition's in its order.

    A file has at most so many holes, and no more bases than given unless one hole has more; a task holds one file at a
    time, whatever its partition. Returns file and number of holes; an empty partition makes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = open_file(folder)
        made: list[tuple[str, str, int]] = []

        def write(parts: list[pa.RecordBatch]) -> None:
            name = f"part-{context.partitionId():05d}-{len(made):05d}.h5"
            temp = f"{root}/.{name}.{context.taskAttemptId()}"
            with system.open_output_stream(temp, compression=None) as out:
                out.write(make_file(_calls_tree(parts, types), chunk))
            made.append((temp, name, sum(map(len, parts))))

        own, n, held = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("bases")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                stop = min(at + holes - n, int(np.searchsorted(ends, before + bases - held, "right")))
                if stop <= at and own:
                    write(own)
                    own, n, held = [], 0, 0
                    continue
                stop = max(stop, at + 1)
                own.append(batch.slice(at, stop - at))
                n, held, at = n + stop - at, held + int(ends[stop - 1]) - before, stop
        if own:
            write(own)
        for temp, name, _ in made:
            system.move(temp, f"{root}/{name}")
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for _, name, _ in made]), pa.array([n for *_, n in made], pa.int64())], names=["file", "holes"])

    system, root = open_file(folder)
    system.create_dir(root, recursive=True)
    made = zmw.select("hole", "x", "y", "status", "bases", "regions").mapInArrow(run, "file string, holes long").collect()
    return zmw.sparkSession.createDataFrame(made, "file string, holes long")
