"""Token ids in bit-plane or byte-plane shuffled files.

File: ``MAGIC``, then the chunks, then an index and its length. A chunk is a
block of ``block`` ids (the last one may be shorter), transposed so that plane
``p`` holds byte (or bit) ``p`` of every id, each plane compressed by itself
with zstandard. Planes that carry no information shrink to a few bytes. The
index (zstandard, JSON head and binary columns) has the place, the number of ids
and the plane sizes of every chunk, and the documents with their lengths, so a
reader can fetch any range of ids by opening only the chunks it touches.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, new_path, open_fs, partitions, written
from .token_ids import by_size, cached_tokenizer

MAGIC = b"IDPLANE1"
END_ID = 1


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes or 32 bit planes, lowest first."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(as_bytes[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(raw: list[bytes], n: int, planes: str) -> np.ndarray:
    """The block of which ``to_planes`` made ``raw``."""
    if planes == "byte":
        out = np.empty((n, 4), np.uint8)
        for i, plane in enumerate(raw):
            out[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, 32), np.uint8)
        for i, plane in enumerate(raw):
            bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; under another name until it is whole."""

    def __init__(self, uri: str, block: int, planes: str, level: int):
        import zstandard

        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.under = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.under)
        self.block, self.planes = block, planes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending, self.n_pending, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.chunks: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        self.docs.append(doc)
        self.lengths.append(len(values))
        self.n_ids += len(values)
        self.pending.append(values)
        self.n_pending += len(values)
        while self.n_pending >= self.block:
            joined = np.concatenate(self.pending)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(joined[at : at + self.block])
            self.pending, self.n_pending = [joined[whole:]], len(joined) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.planes)]
        for p in packed:
            self.out.write(p)
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        self.at += sum(map(len, packed))

    def close(self) -> int:
        """Ends the file; its size."""
        if self.n_pending:
            self._chunk(np.concatenate(self.pending))
        known = np.array([d is not None for d in self.docs], np.uint8)
        columns = [np.array(self.chunks, "<i8").tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(), known.tobytes(), np.array(self.lengths, "<i8").tobytes()]
        head = json.dumps({"planes": self.planes, "block": self.block, "chunks": len(self.chunks), "docs": len(self.docs), "sizes": list(map(len, columns))}).encode()
        index = self.zstd.compress(struct.pack("<I", len(head)) + head + b"".join(columns))
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()
        self.fs.move(self.under, self.path)
        return self.at + len(index) + 16


class PlaneReader:
    """Reads a file of ``PlaneWriter``, chunk by chunk."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no id-plane file or is cut short")
        self.zstd = zstandard.ZstdDecompressor()
        n = struct.unpack("<Q", tail[:8])[0]
        raw = self.zstd.decompress(self.file.read_at(n, size - 16 - n))
        (m,) = struct.unpack_from("<I", raw)
        self.head = json.loads(raw[4 : 4 + m])
        parts, at = [], 4 + m
        for k in self.head["sizes"]:
            parts.append(raw[at : at + k])
            at += k
        n_planes = 4 if self.head["planes"] == "byte" else 32
        self.chunks = np.frombuffer(parts[0], "<i8").reshape(-1, 2 + n_planes)
        self.known = np.frombuffer(parts[2], np.uint8).astype(bool)
        self.docs = np.frombuffer(parts[1], "<i8")
        self.lengths = np.frombuffer(parts[3], "<i8")

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.chunks[k])
        raw, packed = self.file.read_at(sum(sizes), at), []
        for s in sizes:
            packed.append(self.zstd.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(packed, n, self.head["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; opens only the chunks that hold them."""
        ends = np.cumsum(self.chunks[:, 1])
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        found = [self.chunk(k) for k in range(first, min(last + 1, len(ends)))] if stop > start else []
        if not found:
            return np.empty(0, "<u4")
        before = int(ends[first - 1]) if first else 0
        return np.concatenate(found)[start - before : stop - before]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document, its ids) in order; holds a chunk and a document at a time."""
        rest, k = np.empty(0, "<u4"), 0
        for doc, known, n in zip(self.docs.tolist(), self.known.tolist(), self.lengths.tolist()):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield (doc if known else None), rest[:n]
            rest = rest[n:]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = 65_536, planes: str = "byte", level: int = 3, ids_a_file: int = 8_000_000
) -> DataFrame:
    """Tokenises ``docs`` and writes their ids in ascending ``id_col`` order; returns the files.

    One shuffle deals the texts out by ranges of ``id_col``; every task writes its
    range as files of about ``ids_a_file`` ids, so memory holds one block and one
    document. Result: file (URI), part, file_no, part_start (ids of the part before
    it), n_docs, n_ids, n_bytes. A file has its name only when whole, and only files
    of tasks that succeeded are returned, so a lost executor leaves nothing to read.

    Null texts and empty texts have the end id alone. A null id sorts first and is
    kept as null. Rows that repeat an id are all kept, side by side in any order. An
    empty table gives no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = path or new_path(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the place in the input splits the range of an id that many rows repeat
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part, name = task.partitionId(), f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encode = cached_tokenizer(tokenizer_path).encode
        end = END_ID.to_bytes(4, "little")
        writer, number, before, made = None, 0, 0, []

        def ended():
            made.append((writer_uri, part, number, before, len(writer.docs), writer.n_ids, writer.close()))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in by_size(texts):
                for doc, found in zip(ids[cut], encode(texts[cut])):
                    if writer is None:
                        writer_uri = f"{name}-{number:04d}.idp"
                        writer = PlaneWriter(writer_uri, block, planes, level)
                    writer.add(doc, found + end)
                    if writer.n_ids >= ids_a_file:
                        ended()
                        number, before, writer = number + 1, before + writer.n_ids, None
        if writer is not None:
            ended()
        if made:
            names = ["file", "part", "file_no", "part_start", "n_docs", "n_ids", "n_bytes"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made])
        give_back()

    schema = "file string, part long, file_no long, part_start long, n_docs long, n_ids long, n_bytes long"
    return written(rows.mapInArrow(write, schema), "id-files")


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents in the files that ``write_token_files`` returned.

    Result: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, ids. Files are opened in parallel; only the number of ids of each
    part is summed up in one task, a row for each writing task.
    """
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    placed = files.join(starts, "part").select("file", (F.col("before") + F.col("part_start")).alias("start"))
    placed = placed.repartition(max(1, min(files.count(), 16 * spark.sparkContext.defaultParallelism)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, starts, n, crc, ids, size = [], [], [], [], [], 0
                for doc, found in PlaneReader(uri).documents():
                    docs.append(doc)
                    starts.append(start)
                    n.append(len(found))
                    crc.append(zlib.crc32(found.tobytes()))
                    if with_ids:
                        ids.append(found)
                        size += len(found)
                    start += len(found)
                    if len(docs) >= 20_000 or size > 2_000_000:
                        yield made(docs, starts, n, crc, ids)
                        docs, starts, n, crc, ids, size = [], [], [], [], [], 0
                if docs:
                    yield made(docs, starts, n, crc, ids)

    def made(docs, starts, n, crc, ids):
        import pyarrow as pa

        columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([i.astype("i8") for i in ids], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def bitplane_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes ``docs`` as id-plane files and reads every document back from them."""
    return read_token_files(write_token_files(docs, tokenizer_path, **options))
