"""Token ids in binary files of compressed bit or byte planes.

A file holds whole documents, in order. Their ids, as little-endian unsigned 32-bit
integers, are cut into blocks of BLOCK ids. A block is transposed: plane k has byte k of
every id (or bit k), so the high planes are nearly constant and compress to almost nothing.
Each plane is a zstandard frame of its own.

    bytes 0-7    magic
    bytes 8-15   length of the header (unsigned 64-bit)
    header       JSON: plane kind, block size, number of ids, document table and chunk
                 index as [offset, length, size] of zstandard frames after the header
    documents    doc_id, first id, number of ids, 1 if doc_id is null (signed 64-bit each)
    chunk index  for each block and plane: offset, length, CRC-32 of the plane (64-bit each)
    planes

The chunk index lets a reader take the blocks of one document without the others.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratacast.llm.common import scratch_root
from stratacast.llm.tokens import encoder

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
FILE_IDS = 1 << 22
#: A larger memo than usual: nothing else is held beside a file's ids.
MEMO_BITS = 21


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """(planes, bytes per plane) of one block; its number of ids is a multiple of 8 for bits."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bytes":
        return np.ascontiguousarray(parts.T)
    bits = np.unpackbits(parts, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, kind: str, count: int) -> np.ndarray:
    if kind == "bytes":
        return np.ascontiguousarray(planes.T).view("<u4").ravel()
    bits = np.unpackbits(planes, axis=1, bitorder="little", count=count)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def file_bytes(documents: np.ndarray, ids: np.ndarray, kind: str = "bytes", level: int = 3) -> bytes:
    """One file; `documents` has a row (doc_id, first id, number of ids, null) for each document."""
    press = zstandard.ZstdCompressor(level=level)
    index, frames, at = [], [], 0
    for start in range(0, len(ids), BLOCK):
        for plane in to_planes(ids[start:start + BLOCK], kind):
            raw = plane.tobytes()
            frame = press.compress(raw)
            index.append((at, len(frame), zlib.crc32(raw)))
            frames.append(frame)
            at += len(frame)
    tables = [press.compress(np.asarray(t, "<i8").tobytes()) for t in (documents, np.array(index, "<i8"))]
    first = len(tables[0]) + len(tables[1])
    header = json.dumps({
        "planes": kind, "block": BLOCK, "ids": len(ids), "documents": [0, len(tables[0])],
        "index": [len(tables[0]), len(tables[1])], "data": first,
    }).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(header)), header, *tables, *frames])


class TokenFile:
    """Reads a file from `read(offset, length)`; only what is asked for."""

    def __init__(self, read):
        self.read = read
        magic, length = struct.unpack("<8sQ", read(0, 16))
        if magic != MAGIC:
            raise ValueError("no token file")
        self.header = json.loads(read(16, length))
        self.base = 16 + length
        tables = []
        for name, width in (("documents", 4), ("index", 3)):
            at, size = self.header[name]
            raw = zstandard.ZstdDecompressor().decompress(read(self.base + at, size))
            tables.append(np.frombuffer(raw, "<i8").reshape(-1, width))
        self.documents, self.index = tables

    def block(self, number: int) -> np.ndarray:
        count = min(BLOCK, self.header["ids"] - number * self.header["block"])
        planes = 4 if self.header["planes"] == "bytes" else 32
        entries = self.index[number * planes:(number + 1) * planes]
        first, last = int(entries[0, 0]), int(entries[-1, 0] + entries[-1, 1])
        raw = self.read(self.base + self.header["data"] + first, last - first)
        out = []
        for at, size, crc in entries.tolist():
            plane = zstandard.ZstdDecompressor().decompress(raw[at - first:at - first + size])
            if zlib.crc32(plane) != crc:
                raise ValueError("damaged plane")
            out.append(np.frombuffer(plane, np.uint8))
        return from_planes(np.stack(out), self.header["planes"], count)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids `start` .. `start + count - 1` of the file."""
        if not count:
            return np.zeros(0, np.uint32)
        size = self.header["block"]
        first, last = start // size, (start + count - 1) // size
        joined = np.concatenate([self.block(number) for number in range(first, last + 1)])
        return joined[start - first * size:start - first * size + count]

    def sequences(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of every document, holding a block or a document at a time."""
        held, at, number = np.zeros(0, np.uint32), 0, 0
        for doc_id, start, count, null in self.documents.tolist():
            parts = [held[start - at:]]
            have = len(parts[0])
            while have < count:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            held, at = np.concatenate(parts), start
            yield None if null else doc_id, start, held[:count]


def _open(root: str):
    return pyarrow.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(), root
    )


def _write(root: str, path: str, end_id: int, kind: str):
    def run(batches):
        encode = encoder(path, spaced=True, memo_bits=MEMO_BITS).encode
        files, folder = _open(root)
        part, sequence = TaskContext.get().partitionId(), 0
        rows, ids, held = [], [], 0

        def flush():
            nonlocal rows, ids, held, sequence
            # the name is new for each attempt; only files a finished task lists are read
            name = f"{part:06d}-{sequence:05d}-{uuid.uuid4().hex}.ids"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(file_bytes(np.array(rows, np.int64).reshape(-1, 4), np.concatenate(ids), kind))
            done = pa.record_batch([
                pa.array([part], pa.int64()), pa.array([sequence], pa.int64()), pa.array([name]),
                pa.array([len(rows)], pa.int64()), pa.array([held], pa.int64()),
            ], names=["part", "sequence", "name", "n_documents", "n_ids"])
            rows, ids, held, sequence = [], [], 0, sequence + 1
            return done

        end = np.array([end_id], np.uint32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, stop, found, places in encode(batch.column("text")):
                for row in range(first, stop):
                    mine = found[places[row - first]:places[row - first + 1]]
                    name = names[row]
                    rows.append((name or 0, held, len(mine) + 1, int(name is None)))
                    ids += [mine, end]
                    held += len(mine) + 1
                    if held >= FILE_IDS:
                        yield flush()
        if rows:
            yield flush()

    return run


def write_token_files(docs: DataFrame, root: str, path: str, end_id: int = 2, kind: str = "bytes") -> None:
    """Encode every text, append `end_id`, and write files under `root` in ascending doc_id order.

    Null texts count as empty. Rows without doc_id come first; rows that repeat a doc_id
    follow one another in the order of their texts. `root`/manifest, a Parquet table, lists
    the files in order; without documents it is empty.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        partitions, "doc_id"
    ).sortWithinPartitions("doc_id", "text")
    files, folder = _open(root)
    files.create_dir(folder, recursive=True)
    ordered.mapInArrow(
        _write(root, path, end_id, kind), "part long, sequence long, name string, n_documents long, n_ids long"
    ).write.parquet(f"{root}/manifest")


def _read(root: str):
    def run(batches):
        files, folder = _open(root)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{name}") as handle:
                    file = TokenFile(lambda at, size, h=handle: h.read_at(size, at))
                    rows = [(doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                            for doc, at, ids in file.sequences()]
                yield pa.record_batch(
                    [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{root}/manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part goes through one task, not one for each file
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before")
    )
    placed = manifest.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "name", (F.col("before") + F.col("within")).alias("base")
    )
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return placed.repartition(spread, "name").mapInArrow(
        _read(root), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def new_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
