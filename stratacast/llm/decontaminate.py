"""Benchmark decontamination: test items that a document contains.

Containment of an item in a document is the share of the item's distinct shingles that the
document also has. Items are partitioned by size (powers of two of their shingle count).
For each partition the smallest containment hits an item must have follow from its
threshold, and with it the length of the item's sketch: an item of n shingles of which at
least t must be found keeps its n - t + 1 smallest hashes, its bottom MinHash sketch. A
document that contains the item has one of these at least, however long it is, so no match
is lost; banded signatures would lose nearly all, as a short item is a tiny part of a long
document's set. A document looks up the sketches of those partitions only whose items it
is long enough to contain. Candidates are then verified on the shingles' own words.

Items are taken in blocks of bounded size, each block against all documents; only a block
is ever sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch
from stratacast.llm.words import LOWER, hash_words, shingles, text_slices

#: Shingles of the items in one block: some 20 MB sent to each executor.
BLOCK_SHINGLES = 400_000
LEADING_BITS = 22


def _needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER.tobytes()).split()


def _item_shingles(words: list[bytes], size: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[at:at + size]) for at in range(max(len(words) - size + 1, 1))}


class Block:
    """Items whose sketches and shingles one pass over the documents looks for."""

    def __init__(self, rows: list, size: int, percent: int):
        self.size, self.percent = size, percent
        self.ids = [row.item_id for row in rows]
        texts = pa.array([row.text or "" for row in rows], pa.large_string())
        self.shingles: list[set[bytes]] = [_item_shingles(item_words(row.text), size) for row in rows]
        keys: dict[int, tuple[list, list]] = {}
        for first, stop, data, offsets in text_slices(texts):
            hashes, _, _, owner = hash_words(LOWER[data], offsets)
            values, owner = shingles(hashes, owner, stop - first, size, whole_if_short=True)
            edges = np.searchsorted(owner, np.arange(stop - first + 1))
            for at in range(stop - first):
                sketch = np.unique(values[edges[at]:edges[at + 1]])
                if not len(sketch):
                    continue
                least = _needed(len(sketch), percent)
                # an item shorter than a shingle is found as a sequence of that many words
                words = len(item_words(rows[first + at].text))
                group = keys.setdefault((min(words, size), int(len(sketch)).bit_length()), ([], []))
                group[0].append(sketch[:len(sketch) - least + 1])
                group[1].append(np.full(len(sketch) - least + 1, first + at))
        #: by (shingle length, size partition): sketch hashes in order, with their items
        self.partitions = {}
        #: by shingle length: which leading bits any sketch hash has
        self.leading: dict[int, np.ndarray] = {}
        for partition, (hashes, items) in keys.items():
            hashes, items = np.concatenate(hashes), np.concatenate(items)
            order = np.argsort(hashes, kind="stable")
            self.partitions[partition] = (hashes[order], items[order])
            leading = self.leading.setdefault(partition[0], np.zeros(1 << LEADING_BITS, bool))
            leading[(hashes >> np.uint64(64 - LEADING_BITS)).astype(np.int64)] = True

    def candidates(self, length: int, values: np.ndarray, owner: np.ndarray, per_doc: np.ndarray) -> set:
        """(document, item) pairs that share a sketch hash."""
        found = set()
        likely = np.flatnonzero(self.leading[length][(values >> np.uint64(64 - LEADING_BITS)).astype(np.int64)])
        values, owner = values[likely], owner[likely]
        for (shingle, bits), (hashes, items) in self.partitions.items():
            if shingle != length:
                continue
            least = _needed(1 << (bits - 1), self.percent)
            place = np.searchsorted(hashes, values)
            place[place == len(hashes)] = 0
            for at in np.flatnonzero(hashes[place] == values):
                doc, key = int(owner[at]), values[at]
                if per_doc[doc] < least:
                    continue
                first = int(place[at])
                while first < len(hashes) and hashes[first] == key:
                    found.add((doc, int(items[first])))
                    first += 1
        return found


def _scan(block):
    def run(batches):
        it = block.value
        lengths = sorted({length for length, _ in it.partitions})
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column("text")):
                lower = LOWER[data]
                hashes, _, _, rows = hash_words(lower, offsets)
                rows_out = []
                for length in lengths:
                    values, owner = shingles(hashes, rows, stop - first, length, whole_if_short=False)
                    per_doc = np.bincount(owner, minlength=stop - first)
                    found = sorted(it.candidates(length, values, owner, per_doc))
                    words, of = [], -1
                    for doc, item in found:
                        if doc != of:
                            words, of = lower[offsets[doc]:offsets[doc + 1]].tobytes().split(), doc
                            have = {b" ".join(words[at:at + length]) for at in range(len(words) - length + 1)}
                        wanted = it.shingles[item]
                        hits = len(wanted & have)
                        if 100 * hits >= it.percent * len(wanted):
                            rows_out.append((first + doc, it.ids[item], hits, len(wanted)))
                if rows_out:
                    at, items, hits, sizes = zip(*rows_out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at)), pa.array(items, pa.int64()),
                         pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())],
                        names=["doc_id", "item_id", "n_found", "n_shingles"],
                    )

    return run


def item_blocks(items: DataFrame, limit: int = BLOCK_SHINGLES):
    """Lists of item rows with about `limit` words each, one after the other."""
    rows, held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        words = len((row.text or "").split())
        if rows and held + words > limit:
            yield rows
            rows, held = [], 0
        rows.append(row)
        held += words
    yield rows


def contained_items(
    docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80
) -> DataFrame:
    """Pairs (doc_id, item_id, n_found, n_shingles, containment) of items in documents.

    `n_shingles` counts the item's distinct shingles of `size` words (A-Z lower-cased;
    words end at ASCII white space), `n_found` those that the document has too; a pair is
    returned from `percent` percent on. An item of fewer words is one shingle of them all.
    Items without words and null or wordless documents match nothing. A row without doc_id
    is searched too and gives a null doc_id. Repeated item rows count once; a repeated
    document row gives its pairs again. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, n_found long, n_shingles long"
    result, blocks = None, item_blocks(items)
    scratch = Scratch(spark, "decontaminate")
    pending = next(blocks)
    for number in range(1 << 62):
        following = next(blocks, None)
        block = spark.sparkContext.broadcast(Block(pending, size, percent))
        found = texts.mapInArrow(_scan(block), schema)
        if following is None and result is None:
            result = found
            break
        found = scratch.save(found, f"block-{number}")  # the block leaves memory before the next one
        block.destroy()
        result = found if result is None else result.union(found)
        if following is None:
            break
        pending = following
    return result.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item, all columns kept. A row without doc_id stays."""
    bad = contained_items(docs, items, size, percent).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
