"""Training-order materialisation: fixed-stride token shards in a keyed random order.

Every sequence number 0..n-1 gets a slot 0..n-1 by a keyed Feistel network over the next even number of bits; results
of n or more walk the cycle until they fall below n. The permutation is computed where a row is, without a shuffle of
its own. Slots are dealt to shards by range, one task per shard sorts its slots and writes them one after the other,
each `stride` bytes, so slot s lies at (s mod shard_slots) * stride of shard s div shard_slots and a reader may start
anywhere.

Shards are written under a temporary name and then renamed, and a task run again writes the same bytes. The manifest
table has a row for each slot: the documents in it and the checksum of its ids, against which reading back verifies.

Documents become sequences by joining their ids end to end in each partition of the scan and cutting every `length`
ids; only the last sequence of a partition is padded, with pad_id. Two passes count and then place (ids kept between
them would cost more disk than counting costs time); they must see the same partitions, which is checked. Null text is empty (the end id alone). Null doc_id is kept. An empty table gives no
shard. More columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_dir, save
from .textvec import mix
from .tokens import END_ID, WORD_BPE, encoder

LENGTH, SHARD_SLOTS, KEY, ROUNDS, PAD_ID = 2048, 4096, 20240601, 6, 0
STARTS = "partitions.starts"


class Feistel:
    """A keyed permutation of range(n), both ways."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (mix(right + k) & self.mask)
        return right << self.half | left  # halves swapped, so reversed keys undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers."""
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        """Sequence numbers of slots."""
        return self._walk(slot, self.keys[::-1])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _shard(n: int) -> str:
    return f"shard-{n:08d}"


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(encoder(path).count(batch.column(1)) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64())], names=["part", "tokens"])

    return run


class Starts:
    """The first sequence and the ids of each scan partition, 16 bytes each in a file of the shared folder.

    A task reads the two numbers of its own partition only.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, counted: dict[int, int], length: int) -> int:
        """The number of sequences."""
        tokens = np.zeros(max(counted, default=-1) + 1, "<i8")
        tokens[list(counted)] = list(counted.values())
        sequences = -(-tokens // length)
        system, root = _filesystem(self.folder)
        with system.open_output_stream(f"{root}/{STARTS}", compression=None) as f:
            f.write(np.stack([np.cumsum(sequences) - sequences, tokens], axis=1).astype("<i8").tobytes())
        return int(sequences.sum())

    def of(self, part: int) -> tuple[int, int]:
        system, root = _filesystem(self.folder)
        with system.open_input_file(f"{root}/{STARTS}") as f:
            f.seek(16 * part)
            found = np.frombuffer(f.read(16), "<i8")
        return (int(found[0]), int(found[1])) if len(found) else (0, 0)


def _placer(path: str, end_id: int, length: int, starts: Starts, order: Feistel, shard_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(path), TaskContext.get().partitionId(), 0
        base, expected = starts.of(part)
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            for first, ids, off in own.columns(batch.column(1), end_id):
                end = off[-1]
                edge = np.unique(np.concatenate([off, np.arange(-at % length, end, length)]))  # a piece ends with its document or its sequence
                doc = np.searchsorted(off, edge[:-1], "right") - 1
                slot = order.slot((base + (at + edge[:-1]) // length).astype(np.uint64))
                data = pa.py_buffer(ids.tobytes())
                pieces = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((edge * own.kind.itemsize).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot), pa.array(((at + edge[:-1]) % length).astype(np.int32)), pa.array(names[first + doc], pa.int64()), pieces],
                    names=["shard", "slot", "offset", "doc_id", "ids"],
                )
                at += int(end)
        if at != expected:
            raise RuntimeError(f"partition {part} has {at} ids, {expected} when they were counted")

    return run


MANIFEST = "shard int, slot long, doc_ids array<long>, ids_crc32 long"


def _writer(path: str, length: int, pad_id: int, folder: str, shard_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        stride = length * kind.itemsize
        pad = np.array([pad_id], kind).tobytes()
        system, root = _filesystem(folder)
        name, out, slot, held, docs, temp = None, None, -1, bytearray(), [], ""
        made: list[tuple] = []

        def flush() -> None:
            nonlocal held, docs
            if slot >= 0:
                block = bytes(held) + pad * ((stride - len(held)) // kind.itemsize)
                out.write(block)
                made.append((name, slot, docs, _crc(block, kind)))
                held, docs = bytearray(), []

        def close() -> None:
            nonlocal slot
            flush()
            out.close()
            system.move(temp, f"{root}/{_shard(name)}.bin")
            slot = -1

        def manifest() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [(), (), (), ()]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["shard", "slot", "doc_ids", "ids_crc32"])

        for batch in batches:
            for shard, at, offset, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != name:
                    if name is not None:
                        close()
                    name = shard
                    temp = f"{root}/.{_shard(shard)}.{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(temp, compression=None)
                if at != slot:
                    flush()
                    if at != (slot + 1 if slot >= 0 else shard * shard_slots):
                        raise RuntimeError(f"slot {at} follows {slot}")
                    slot = at
                if offset * kind.itemsize != len(held):
                    raise RuntimeError(f"slot {at} has a gap")
                held += ids
                docs.append(doc)
            if len(made) > 4096:
                yield manifest()
        if name is not None:
            close()
        yield manifest()

    return run


def _crc(block: bytes, kind: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(block, kind).astype("<u4").tobytes())


def _reader(folder: str, path: str, length: int, shard_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rows = []
                for i, ids in enumerate(read_shard(folder, shard, length, kind)):
                    rows.append((shard * shard_slots + i, _crc(ids.tobytes(), kind), ids.tobytes()))
                    if len(rows) == 256:
                        yield _sequences(shard, rows)
                        rows = []
                if rows:
                    yield _sequences(shard, rows)

    return run


def _sequences(shard: int, rows: list[tuple]) -> pa.RecordBatch:
    slot, crc, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(slot), pa.int32()), pa.array(slot, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "slot", "ids_crc32", "ids"])


VERIFIED = "slot long, sequence_id long, shard int, ids_crc32 long, doc_ids array<long>"


def _verifier(folder: str, path: str, length: int, shard_slots: int, order: Feistel):
    """Reads the sequences that manifest rows name, run by run of neighbouring slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        for batch in batches:
            shard, slot, written = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "slot", "ids_crc32"))
            if not len(slot):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (slot[1:] != slot[:-1] + 1), [True]]))
            read = np.zeros(len(slot), np.int64)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                blocks = read_shard(folder, int(shard[a]), length, kind, int(slot[a]) - int(shard[a]) * shard_slots)
                for i in range(a, b):
                    ids = next(blocks, None)
                    read[i] = -1 if ids is None or len(ids) != length else _crc(ids.tobytes(), kind)
            wrong = np.flatnonzero(read != written)
            if len(wrong):
                raise RuntimeError(f"slot differs from what was written: {slot[wrong[0]]}")
            columns = [batch.column("slot"), pa.array(order.sequence(slot.astype(np.uint64)), pa.int64()), batch.column("shard"), pa.array(read), batch.column("doc_ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "sequence_id", "shard", "ids_crc32", "doc_ids"])

    return run


def read_shard(folder: str, shard: int, length: int = LENGTH, kind: np.dtype = np.dtype("<u2"), start: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a shard in slot order, from its slot `start` on; reads one block after the other."""
    system, root = _filesystem(folder)
    stride = length * kind.itemsize
    with system.open_input_file(f"{root}/{_shard(shard)}.bin") as f:
        f.seek(start * stride)
        while block := f.read(stride):
            yield np.frombuffer(block, kind)


class Materialised:
    """What was written: the folder, the number of sequences, their order and the manifest table."""

    def __init__(self, folder: str, n: int, manifest: DataFrame, order: Feistel, path: str, length: int, shard_slots: int):
        self.folder, self.n, self.manifest, self.order = folder, n, manifest, order
        self.path, self.length, self.shard_slots = path, length, shard_slots

    def read(self) -> DataFrame:
        """shard, slot, ids_crc32, ids of every sequence, read back from the files, one task a shard."""
        count = -(-self.n // self.shard_slots)
        shards = self.manifest.sparkSession.range(0, count, 1, max(count, 1)).select(F.col("id").cast("int").alias("shard"))
        return shards.mapInArrow(_reader(self.folder, self.path, self.length, self.shard_slots), "shard int, slot long, ids_crc32 long, ids binary")

    def verified(self) -> DataFrame:
        """slot, sequence_id, shard, ids_crc32 as read back, doc_ids; fails where the files differ from the manifest.

        Each task reads the blocks of its own manifest rows, so nothing is joined or shuffled.
        """
        rows = self.manifest.select("shard", "slot", "ids_crc32", "doc_ids")
        return rows.mapInArrow(_verifier(self.folder, self.path, self.length, self.shard_slots, self.order), VERIFIED)


def materialise(docs: DataFrame, folder: str | None = None, path: str = WORD_BPE, end_id: int = END_ID, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, pad_id: int = PAD_ID, id_col: str = "doc_id", text_col: str = "text") -> Materialised:
    """Write docs as shards of sequences in the keyed order; see the module's text."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "shards")
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # one row per partition of the scan; both passes read the same columns, so that they are dealt alike
    counted = {r["part"]: r["tokens"] for r in texts.mapInArrow(_counter(path), "part int, tokens long").collect()}
    starts = Starts(folder)
    n = starts.write(counted, length)
    order = Feistel(n, key)
    n_shards = -(-n // shard_slots)
    if not n:
        return Materialised(folder, 0, spark.createDataFrame([], MANIFEST), order, path, length, shard_slots)
    pieces = texts.mapInArrow(_placer(path, end_id, length, starts, order, shard_slots), "shard int, slot long, offset int, doc_id long, ids binary")
    ranged = pieces.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot", "offset")
    written = save(ranged.mapInArrow(_writer(path, length, pad_id, folder, shard_slots), MANIFEST), "manifest")
    return Materialised(folder, n, written, order, path, length, shard_slots)
