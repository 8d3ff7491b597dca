"""Near-duplicate documents by MinHash with tensored banding.

Two collections of `halves` small hashes, each the minima of `rows` hash functions, stand
for halves**2 hash tables: a table's key is a pair of one small hash from each collection.
So 2 * halves * rows minima do what halves**2 * 2 * rows would in plain banding, and two
documents meet in a table exactly if they share a small hash in both collections. At
similarity 0.8 the defaults miss such a meeting with a chance of 2e-5.

1. Texts with the same shingle set become one class, of which one row goes on.
2. Small hashes that one class alone has cannot make a shared key; classes left without a
   shared one in either collection have no partner and leave.
3. Table keys are formed; each class is checked against the first classes of its tables.
4. Components of the confirmed links. Tables that still hold several components are
   searched in blocks: classes of different components are compared by sketches, and
   pairs not clearly below the threshold are confirmed on their full sets. First the best
   pairs of grown components, to join these, then every pair that is left.

Every link between different components is either confirmed or refuted on full sets, so
components are whole though copies are never expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratacast.llm.common import Scratch, components
from stratacast.llm.words import LOWER, distinct_sets, hash_words, mix, shingles, text_slices

BLOCK = 1024
SKETCH = 1024
HUBS = 3
BEST = 4
#: Standard deviations below the threshold at which a sketch still counts as close.
MARGIN = 5.0


def _multipliers(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def _minima(values: np.ndarray, offsets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(texts, functions): the smallest hash of each non-empty set under each function."""
    starts = offsets[:-1]
    out = np.empty((len(starts), len(multipliers)), np.uint64)
    for at, factor in enumerate(multipliers):
        out[:, at] = np.minimum.reduceat(values * factor, starts)
    return out


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, offsets) with each text's distinct shingles, sorted."""
    for first, stop, data, offsets in text_slices(column):
        hashes, _, _, rows = hash_words(LOWER[data], offsets)
        values, owner = shingles(hashes, rows, stop - first, size, whole_if_short=True)
        yield first, stop, *distinct_sets(values, owner, stop - first)


def _pieces(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _profiles(size: int, rows: int, halves: int, seed: int):
    multipliers = _multipliers(2 * halves * rows, seed)

    def run(batches):
        for batch in batches:
            for first, stop, values, offsets in text_sets(batch.column("text"), size):
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                small = np.zeros((stop - first, 2 * halves), np.uint64)
                if len(some):
                    minima = _minima(values, np.append(offsets[some], len(values)), multipliers)
                    for half in range(2 * halves):
                        key = np.full(len(some), half + 1, np.uint64)
                        for row in range(rows):
                            key = mix(key * np.uint64(31) + minima[:, half * rows + row])
                        small[some, half] = key
                prints = [hashlib.blake2b(piece, digest_size=16).digest() for piece in _pieces(values, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, stop - first), pa.array(sizes.astype(np.int64)),
                     pa.array(prints, pa.binary()), pa.array(list(small.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "print", "small"],
                )

    return run


def _sets(size: int, seed: int):
    """The set and a sketch of it for each text whose set has the print that is asked for."""
    multipliers = _multipliers(SKETCH, seed + 1)

    def run(batches):
        for batch in batches:
            for first, stop, values, offsets in text_sets(batch.column("text"), size):
                part = batch.slice(first, stop - first)
                pieces = _pieces(values, offsets)
                asked = part.column("print").to_pylist()
                rows = [at for at, piece in enumerate(pieces)
                        if piece and hashlib.blake2b(piece, digest_size=16).digest() == asked[at]]
                if not rows:
                    continue
                some = np.flatnonzero(np.diff(offsets))
                sketch = np.zeros((stop - first, SKETCH), np.uint8)
                minima = _minima(values, np.append(offsets[some], len(values)), multipliers)
                sketch[some] = (mix(minima) >> np.uint64(56)).astype(np.uint8)
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class_id"), part.column("n_shingles"), part.column("small"),
                     pa.array([pieces[at] for at in rows], pa.binary()),
                     pa.array([sketch[at].tobytes() for at in rows], pa.binary())],
                    names=["class_id", "n_shingles", "small", "set", "sketch"],
                )

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            lefts, rights = batch.column("set_x"), batch.column("set_y")
            for at in range(batch.num_rows):
                left = np.frombuffer(lefts[at].as_buffer(), np.uint64)
                right = np.frombuffer(rights[at].as_buffer(), np.uint64)
                short, long = (left, right) if len(left) <= len(right) else (right, left)
                places = np.searchsorted(long, short)
                places[places == len(long)] = 0
                common = int(np.count_nonzero(long[places] == short))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    left = store.select(F.col("class_id").alias("x"), F.col("set").alias("set_x"))
    right = store.select(F.col("class_id").alias("y"), F.col("set").alias("set_y"))
    small = F.least(F.length("set_x"), F.length("set_y"))
    large = F.greatest(F.length("set_x"), F.length("set_y"))
    return (
        pairs.select("x", "y").join(left, "x").join(right, "y")
        .filter(100 * small >= percent * large)
        .mapInArrow(_confirm(percent), "x long, y long")
    )


def _groups(batches, column: str):
    """Runs of equal `column` as Arrow tables; the input is sorted by it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(column).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
        for start, stop in zip(edges[:-2], edges[1:-1], strict=True):
            yield table.slice(start, stop - start)
        held = table.slice(edges[-2]).combine_chunks() if len(edges) > 1 else None
    if held is not None:
        yield held


def _search(percent: int, halves: int, best: int | None):
    """Close pairs of different components in one block; the `best` per component pair, or all."""
    share = percent / 100
    agreement = share + (1 - share) / 256
    least = SKETCH * agreement - MARGIN * np.sqrt(SKETCH * agreement * (1 - agreement))

    def pairs(table):
        member = table.column("member").to_numpy()
        if member.all():
            return None
        ids, comps, sizes = (table.column(c).to_numpy() for c in ("class_id", "label", "n_shingles"))
        key, outer = table.column("key")[0].as_py(), table.column("outer").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        small = table.column("small").combine_chunks().flatten().to_numpy().reshape(-1, 2 * halves)
        members = np.flatnonzero(member)
        found = []
        for at in np.flatnonzero(~member):
            other = members[comps[members] != comps[at]]
            # of two classes that both ask, the smaller id does
            other = other[~(outer[other] & (ids[other] < ids[at]))]
            low, high = np.minimum(sizes[other], sizes[at]), np.maximum(sizes[other], sizes[at])
            other = other[100 * low >= percent * high]
            if not len(other):
                continue
            same = small[other] == small[at]
            # one block per pair: the first small hash they share; and one of the other collection
            first = small[at, np.argmax(same[:, :halves], 1)]
            other = other[(first == key) & same[:, halves:].any(1)]
            if not len(other):
                continue
            equal = np.count_nonzero(sketch[other] == sketch[at], axis=1)
            close = np.flatnonzero(equal >= least)
            found += [(comps[at], comps[o], e, ids[at], ids[o]) for o, e in zip(other[close], equal[close], strict=True)]
        if best is not None and found:
            ranked: dict = {}
            for c, d, e, x, y in sorted(found, key=lambda f: (-f[2], f[3], f[4])):
                ranked.setdefault((min(c, d), max(c, d)), []).append((c, d, e, x, y))
            found = [row for rows in ranked.values() for row in rows[:best]]
        return found

    def run(batches):
        for table in _groups(batches, "cell"):
            found = pairs(table)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(f[k]) for f in found], pa.int64()) for k in (3, 4)], names=["x", "y"]
                )

    return run


def _cells(store: DataFrame, labels: DataFrame, halves: int, grown_only: bool) -> DataFrame:
    """Rows of the blocks in which classes of several components share a small hash.

    A block holds about BLOCK members and BLOCK classes that ask; a class asks if it is
    outside its table's largest component.
    """
    placed = store.select("class_id", F.slice("small", 1, halves).alias("a")).join(
        labels.withColumnRenamed("node", "class_id"), "class_id", "inner" if grown_only else "left"
    )
    tables = placed.select("class_id", F.coalesce("label", "class_id").alias("label"), F.explode("a").alias("key"))
    counts = tables.groupBy("key", "label").agg(F.count("*").alias("n"))
    # `rows` is evaluated twice below; of components that count the same, both must see the same one as top
    mixed = counts.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("n").alias("most"),
        F.max_by("label", F.struct("n", "label")).alias("top"),
    ).filter("labels > 1").selectExpr(
        "key", "top", f"ceil(n / {BLOCK}) AS blocks", f"ceil((n - most) / {BLOCK}) AS ask_blocks"
    )
    rows = tables.join(mixed, "key").withColumn("outer", F.expr("label <> top")).withColumn(
        "spot", F.xxhash64("class_id")
    )
    members = rows.selectExpr(
        "class_id", "label", "key", "outer", "true AS member", "pmod(spot, blocks) AS block",
        "explode(sequence(0L, ask_blocks - 1)) AS ask_block",
    )
    asking = rows.filter("outer").selectExpr(
        "class_id", "label", "key", "outer", "false AS member",
        "explode(sequence(0L, blocks - 1)) AS block", "pmod(spot, ask_blocks) AS ask_block",
    )
    payload = store.select("class_id", "n_shingles", "small", "sketch")
    cell = ("key", "block", "ask_block")
    return (
        members.union(asking).join(payload, "class_id").withColumn("cell", F.xxhash64(*cell))
        .repartition("cell").sortWithinPartitions("cell")
    )


def _searched(cells: DataFrame, percent: int, halves: int, best: int | None) -> DataFrame:
    found = cells.mapInArrow(_search(percent, halves, best), "x long, y long")
    return found.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 3, halves: int = 16, seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `size` words (A-Z lower-cased; with
    fewer words, the whole sequence as one). Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    Null or wordless texts have an empty set and are linked with nothing. A row without
    doc_id is linked with nothing, has no component_id and is kept. Rows that repeat a
    doc_id each go by their own text. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = scratch.save(texts.mapInArrow(
        _profiles(size, rows, halves, seed), "doc_id long, n_shingles long, print binary, small array<long>"
    ), "profiles")
    comparable = profiles.filter("n_shingles > 0 and doc_id is not null")
    classes = comparable.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    chosen = comparable.join(
        classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "print"]
    ).groupBy(F.col("doc_id").alias("class_id")).agg(F.min(F.struct("print", "n_shingles", "small")).alias("row"))
    chosen = scratch.save(chosen.select("class_id", "row.*"), "classes")

    small = chosen.select("class_id", F.posexplode("small").alias("place", "value"))
    shared = small.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value")
    seen = small.join(shared, "value", "left_semi").groupBy("class_id").agg(
        F.collect_list(F.when(F.col("place") < halves, F.col("value"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= halves, F.col("value"))).alias("b"),
    ).filter("size(a) > 0 and size(b) > 0")
    seen = scratch.save(seen, "seen")
    asked = chosen.join(seen.select("class_id"), "class_id", "left_semi")
    store = texts.withColumnRenamed("doc_id", "class_id").join(asked, "class_id").mapInArrow(
        _sets(size, seed), "class_id long, n_shingles long, small array<long>, set binary, sketch binary"
    ).dropDuplicates(["class_id"])
    store = scratch.save(store, "store")

    keys = seen.select("class_id", F.explode("a").alias("left"), "b").select(
        "class_id", "left", F.explode("b").alias("right")
    ).select("class_id", F.xxhash64("left", "right").alias("key"))
    first = keys.groupBy("key").agg(F.min("class_id").alias("hub"), F.max("class_id").alias("last")).filter("hub < last")
    met = keys.join(first.select("key", "hub"), "key").filter("class_id <> hub").groupBy("class_id", "hub").agg(
        F.count("*").alias("tables")
    )
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("tables"), "hub"))
    stars = met.withColumn("rank", rank).filter(F.col("rank") <= HUBS)
    links = scratch.save(
        _confirmed(stars.selectExpr("class_id AS x", "hub AS y"), store, percent), "links-hubs"
    )
    labels = components(links, scratch)
    for name, grown_only, best in (("links-grown", True, BEST), ("links-rest", False, None)):
        pairs = _searched(_cells(store, labels, halves, grown_only), percent, halves, best)
        links = scratch.save(_confirmed(pairs, store, percent), name)
        # the components so far stand for their links
        labels = components(labels.selectExpr("node AS x", "label AS y").union(links), scratch)
    scratch.drop("classes", "seen", "store", "links-hubs", "links-grown", "links-rest")

    placed = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "print", F.coalesce("label", "class_id").alias("component")
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return profiles.select("doc_id", "n_shingles", "print").join(placed, "print", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, that of the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together; those without
    doc_id, or without words, stay.
    """
    gone = near_duplicates(docs, size, percent).filter("doc_id is not null").groupBy("doc_id").agg(
        F.max("kept").alias("stays")
    ).filter("not stays").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
