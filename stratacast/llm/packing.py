"""Best-fit packing of documents into token sequences by sums of squares.

A document's ids are cut into pieces only where they exceed a sequence. Pieces are then
placed one by one, longest first, each where the sum over all gaps of the squared number of
open sequences with that gap becomes smallest: open sequences stay spread over many gaps, so
that later pieces find a gap they fill. The shortest pieces come last and close sequences:
they open a new one only if none has room. Pieces of equal length are alike, so placing
needs the counts by gap and a stack of sequences for each.

Pieces are dealt into groups of bounded size, which are packed independently; a group loses
about one sequence against the least possible number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch
from stratacast.llm.tokens import MEMO_BITS, encoder

GROUP_PIECES = 50_000
#: Shares of the pieces, the shortest, that only close sequences; the better result stands.
CLOSING = (0.3, 1.0)


def sum_of_squares(lengths: np.ndarray, capacity: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; the last `share` of them only closes sequences."""
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    counts = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, closing = 0, len(lengths) - int(share * len(lengths))
    for turn, at in enumerate(np.argsort(-lengths, kind="stable").tolist()):
        size = int(lengths[at])
        # squares after minus squares before; a full sequence is no longer counted
        cost = 2 * (counts[:capacity + 1 - size] - counts[size:]) + 2
        cost[0] = 1 - 2 * counts[size]
        gaps = np.flatnonzero(counts[size:])
        if len(gaps):
            costs = cost[gaps]
            best = int(np.argmin(costs))
            gap, price = int(gaps[best]) + size, int(costs[best])
        if not len(gaps) or (turn < closing and size < capacity and 2 * counts[capacity - size] + 1 < price):
            gap, number = capacity, used
            used += 1
        else:
            number = open_by_gap[gap].pop()
            counts[gap] -= 1
        sequence[at], offset[at] = number, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_by_gap[gap - size].append(number)
    return sequence, offset


def _pieces(path: str, capacity: int, end_id: int, memo_bits: int):
    end = np.array([end_id], "<u4")

    def run(batches):
        encode = encoder(path, spaced=False, memo_bits=memo_bits).encode
        for batch in batches:
            for first, stop, ids, places in encode(batch.column("text")):
                owner, rows = [], []
                for row in range(stop - first):
                    mine = np.concatenate((ids[places[row]:places[row + 1]].astype("<u4"), end))
                    for number, start in enumerate(range(0, len(mine), capacity)):
                        part = mine[start:start + capacity]
                        owner.append(first + row)
                        rows.append((number, start, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array(columns[0], pa.int32()),
                     *(pa.array(column, pa.int64()) for column in columns[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        tries = (sum_of_squares(lengths, capacity, share) for share in CLOSING)
        sequence, offset = min(tries, key=lambda found: found[0].max())
        group = table.column("bucket")[0].as_py()
        return table.drop_columns(["bucket"]).append_column(
            "sequence_id", pa.array((group << 32) + sequence)
        ).append_column("offset", pa.array(offset))

    return run


def packed(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, memo_bits: int = MEMO_BITS
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): where pieces go.

    A document is its ids by the word vocabulary at `path`, then `end_id`; null texts count
    as empty. Only documents above `capacity` are cut, into pieces of `capacity` ids, the
    last one shorter. `offset` is the place of the piece's first id in its sequence, without
    gaps from 0. `memo_bits` sets the memory for chunks already encoded. Rows without doc_id and rows that repeat are packed like any other. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(path, capacity, end_id, memo_bits), schema
    ), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    short = pieces.filter(F.col("length") < capacity)
    groups = -(-short.count() // GROUP_PIECES)
    # dealt by row, so that rows that repeat spread too; kept, as row numbers hang on the read
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(groups, 1)).cast("long"))
    dealt = scratch.save(short.withColumn("bucket", bucket), "dealt")
    placed = dealt.groupBy("bucket").applyInArrow(_place(capacity), schema + ", sequence_id long, offset long")
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(alone.columns).union(alone)


def sequence_ids(pieces: DataFrame, docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence; doc_id must be unique in `docs`."""
    places = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    end = np.array([end_id], np.uint32)

    def cut(batches):
        encode = encoder(path, spaced=False).encode
        for batch in batches:
            listed = batch.column("places")
            for first, stop, ids, at in encode(batch.column("text")):
                rows = []
                for row in range(stop - first):
                    mine = np.concatenate((ids[at[row]:at[row + 1]], end)).astype(np.int32)
                    rows += [(p["sequence_id"], p["offset"], mine[p["start"]:p["start"] + p["length"]])
                             for p in listed[first + row].as_py()]
                yield pa.record_batch(
                    [pa.array(column) for column in zip(*rows, strict=True)], names=["sequence_id", "offset", "ids"]
                )

    cuts = docs.select("doc_id", "text").join(places, "doc_id").mapInArrow(
        cut, "sequence_id long, offset long, ids array<int>"
    )
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cuts.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids")
    )
