"""Passages that documents share, by a sparse suffix array.

A suffix array of all words would hold every suffix of every text. Here only those suffixes
stay that begin at a minimiser: of each `min_words - seed_words + 1` neighbouring runs of
`seed_words` words (seeds), the one with the smallest hash. Any passage of `min_words` words
contains such a place, and it is the same place in every copy, as the words alone choose it.

1. Each text gives the seeds of its sampled suffixes. Texts that are equal as a whole count
   as one. Suffixes whose seed only one text has are dropped.
2. The rest get the words around them (32 bits each), are sorted as suffixes, compared with
   the neighbours from other texts, and extended to the right and to the left.
3. A suffix that stays short of `min_words` may have its partner further off in the order,
   as many share its seed. It looks up its windows of `min_words` words over the seed among
   those of the seed's other suffixes. For these a row for each distinct window of a block
   suffices, so the look-up is exact and no frequent seed can overload it.
4. Places of one text that overlap or touch are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratacast.llm.common import Scratch
from stratacast.llm.words import hash_words, mix, shingles, text_slices


#: Suffixes of one seed up to which they are sorted together. More are dealt out by what
#: follows the seed and by document, so that equal surroundings mostly stay together.
GROUP_ROWS = 20_000
BLOCK_ROWS = 8192
NAMES = ["doc_id", "start", "n_words", "other", "window", "low", "high"]


def minimisers(values: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Places that are the leftmost smallest of some `window` neighbours in their text.

    A text with fewer values than `window` has no place. In a stretch of one repeated
    value only the first place, the last `window` ones and each `window`-th stay: windows
    that reach beyond the stretch choose among the former, and inside it any place will do.
    """
    count = len(values) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    low, span = values.copy(), 1
    place = np.arange(len(values))
    while span < window:
        step = min(span, window - span)
        right, left = low[step:], low[:len(low) - step]
        take = right < left
        low = np.where(take, right, left)
        place = np.where(take, place[step:], place[:len(place) - step])
        span += step
    whole = owner[:count] == owner[window - 1:]
    chosen = np.unique(place[:count][whole])
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
    stretch_ends = np.flatnonzero(~same[1:])
    ahead = stretch_ends[np.searchsorted(stretch_ends, chosen)] - chosen
    return chosen[~same[chosen] | (ahead < window) | (ahead % window == 0)]


def _sampled(column: pa.Array, seed_words: int, min_words: int):
    """Per slice of texts: (first row, end row, word hashes, first word of each text, places, seeds, texts)."""
    for first, stop, data, offsets in text_slices(column):
        hashes, _, _, rows = hash_words(data, offsets)
        values, owner = shingles(hashes, rows, stop - first, seed_words, whole_if_short=False)
        at = minimisers(values, owner, min_words - seed_words + 1)
        begin = np.searchsorted(rows, np.arange(stop - first + 1))
        skipped = begin[owner[at]] - np.searchsorted(owner, owner[at]) if len(at) else at
        yield first, stop, hashes, begin, at + skipped, values[at], owner[at]


def _seeds(seed_words: int, min_words: int):
    """A row of seed null for each text, with its number of words, and one for each sampled seed."""
    def run(batches):
        for batch in batches:
            for first, stop, _, begin, _, seeds, owner in _sampled(batch.column("text"), seed_words, min_words):
                part = batch.slice(first, stop - first)
                head = pa.record_batch([
                    part.column("doc_id"), part.column("class"), part.column("digest"),
                    pa.array(np.diff(begin)), pa.nulls(stop - first, pa.int64()),
                ], names=["doc_id", "class", "digest", "n_words", "seed"])
                yield head
                if len(seeds):
                    yield pa.record_batch([
                        pa.nulls(len(seeds), pa.int64()), part.column("class").take(pa.array(owner)),
                        pa.nulls(len(seeds), part.column("digest").type), pa.nulls(len(seeds), pa.int64()),
                        pa.array(seeds.view(np.int64)),
                    ], names=["doc_id", "class", "digest", "n_words", "seed"])

    return run


def _contexts(seed_words: int, min_words: int):
    """The words before and after each sampled suffix whose seed is listed in `seeds`.

    Words are 4 bytes each, 0 beyond the text's ends; those before are in reverse order.
    """
    reach = min_words - seed_words
    around = np.concatenate((np.arange(-1, -reach - 1, -1), np.arange(min_words)))

    def run(batches):
        for batch in batches:
            listed = batch.column("seeds")
            for first, stop, hashes, begin, places, seeds, owner in _sampled(
                batch.column("text"), seed_words, min_words
            ):
                if not len(seeds):
                    continue
                short = np.concatenate(((hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(1, np.uint32)))
                for row in np.unique(owner):
                    wanted = listed[first + int(row)].values
                    mine = np.arange(np.searchsorted(owner, row), np.searchsorted(owner, row, "right"))
                    known = wanted.field("seed").to_numpy()
                    order = np.argsort(known)
                    spot = np.searchsorted(known, seeds[mine].view(np.int64), sorter=order)
                    spot[spot == len(known)] = 0
                    hit = known[order[spot]] == seeds[mine].view(np.int64)
                    mine, spot = mine[hit], order[spot[hit]]
                    if not len(mine):
                        continue
                    index = places[mine, None] + around
                    index[(index < begin[row]) | (index >= begin[row + 1])] = len(hashes)
                    words = short[index]
                    yield pa.record_batch([
                        pa.array(np.full(len(mine), batch.column("doc_id")[first + int(row)].as_py(), np.int64)),
                        pa.array(places[mine] - begin[row]), pa.array(seeds[mine].view(np.int64)),
                        pa.array(wanted.field("parts").to_numpy()[spot]),
                        pa.array([w.tobytes() for w in words[:, :reach]], pa.binary()),
                        pa.array([w.tobytes() for w in words[:, reach:]], pa.binary()),
                    ], names=["doc_id", "place", "seed", "parts", "before", "after"])

    return run


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows; 0 stands for no word."""
    differ = np.concatenate(((left != right) | (left == 0), np.ones((len(left), 1), bool)), axis=1)
    return np.argmax(differ, axis=1)


def _window_keys(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which are whole) of the windows 0, 1, .. words before each suffix."""
    reach, size = before.shape[1], after.shape[1]
    line = np.concatenate((before[:, ::-1], after), axis=1)
    keys = np.zeros((len(line), reach + 1), np.uint64)
    whole = np.ones((len(line), reach + 1), bool)
    for lead in range(reach + 1):
        window = line[:, reach - lead:reach - lead + size]
        key = np.zeros(len(line), np.uint64)
        for at in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + window[:, at].astype(np.uint64) + np.uint64(1)
        keys[:, lead] = mix(key)
        whole[:, lead] = window.all(axis=1)
    return keys, whole


def _compare(seed_words: int, min_words: int):
    """Neighbours in suffix order compared; see the module's points 2 and 3.

    Three kinds of rows: found places (doc_id, start, n_words, other); windows of suffixes
    that look for a partner (doc_id, start, window); and windows of the others in their
    group, as (window, smallest and largest doc_id) of a block.
    """
    reach = min_words - seed_words

    def rows(**columns):
        size = len(next(iter(columns.values())))
        return pa.record_batch(
            [pa.array(columns[n]) if n in columns else pa.nulls(size, pa.int64()) for n in NAMES], names=NAMES
        )

    def block(table):
        table = table.combine_chunks()
        docs, places, cells = (table.column(c).to_numpy() for c in ("doc_id", "place", "cell"))
        hot = table.column("parts").to_numpy() > 1
        before = np.frombuffer(b"".join(table.column("before").to_pylist()), np.uint32).reshape(-1, reach)
        after = np.frombuffer(b"".join(table.column("after").to_pylist()), np.uint32).reshape(-1, min_words)
        count = len(docs)
        turn = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (cells[1:] != cells[:-1]))))
        ends = np.append(turn, count)
        run_of = np.repeat(np.arange(len(turn)), np.diff(ends))
        best_left, best_right, longest = (np.zeros(count, np.int64) for _ in range(3))
        partner = np.full(count, -1, np.int64)
        for other in (turn[run_of] - 1, ends[run_of + 1]):
            at = np.flatnonzero((other >= 0) & (other < count))
            at = at[cells[other[at]] == cells[at]]
            right = _common(after[at], after[other[at]])
            left = _common(before[at], before[other[at]])
            longest[at] = np.maximum(longest[at], right)
            better = left + right > best_left[at] + best_right[at]
            at, left, right, mate = at[better], left[better], right[better], other[at][better]
            best_left[at], best_right[at], partner[at] = left, right, docs[mate]
        done = best_left + best_right >= min_words
        yes = np.flatnonzero(done)
        if len(yes):
            yield rows(
                doc_id=docs[yes], start=places[yes] - best_left[yes], n_words=best_left[yes] + best_right[yes],
                other=partner[yes],
            )
        group = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.append(group, count))
        several = np.minimum.reduceat(docs, group) != np.maximum.reduceat(docs, group)
        unfinished = ~np.logical_and.reduceat(done, group)
        need = np.flatnonzero(np.repeat(several & unfinished, sizes) | hot)
        if not len(need):
            return
        # suffixes of the same surroundings have the same windows
        around = np.ascontiguousarray(np.concatenate((before[need], after[need]), axis=1))
        _, first, alike = np.unique(
            around.view(f"V{around.shape[1] * 4}").ravel(), return_index=True, return_inverse=True
        )
        keys, whole = _window_keys(before[need[first]], after[need[first]])
        longest[hot] = min_words  # partners of a frequent seed may be in another block
        asks = np.flatnonzero(~done[need])
        possible = np.arange(reach + 1) >= (min_words - longest[need[asks]])[:, None]
        row, lead = np.nonzero(whole[alike[asks]] & possible)
        if len(row):
            at = need[asks[row]]
            yield rows(doc_id=docs[at], start=places[at] - lead, window=keys[alike[asks[row]], lead].view(np.int64))
        gives = np.flatnonzero(done[need])
        if len(gives):
            low = np.full(len(first), np.iinfo(np.int64).max)
            high = np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(low, alike[gives], docs[need[gives]])
            np.maximum.at(high, alike[gives], docs[need[gives]])
            row, lead = np.nonzero(whole & (low <= high)[:, None])
            yield rows(window=keys[row, lead].view(np.int64), low=low[row], high=high[row])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < BLOCK_ROWS:
                continue
            cells = held.column("cell").to_numpy()
            edges = np.flatnonzero(cells[1:] != cells[:-1])
            if len(edges):
                yield from _joined(block(held.slice(0, int(edges[-1]) + 1)))
                held = held.slice(int(edges[-1]) + 1)
        if held is not None and held.num_rows:
            yield from _joined(block(held))

    return run


def _joined(batches):
    """Many small batches as one."""
    batches = list(batches)
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def repeated_passages(docs: DataFrame, min_words: int = 50, seed_words: int = 16) -> DataFrame:
    """Rows (doc_id, start, n_words, other_doc_id): passages that another document has too.

    A passage is a run of words (bytes other than ASCII white space, compared as they are)
    of at least `min_words` words; `start` counts the document's words from 0. Every text
    that shares such a run with another document is found, with one row per stretch that
    found runs cover without a gap; `other_doc_id` is the smallest document met there.
    A text that is equal to others as a whole, with enough words, gives one row for all of
    it. Repeats inside one document do not count. Null or short texts and rows without
    doc_id give no rows; rows that repeat a doc_id with its text count once. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sampled = scratch.save(
        texts.withColumn("class", F.xxhash64("text")).withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        .mapInArrow(_seeds(seed_words, min_words), "doc_id long, class long, digest binary, n_words long, seed long"),
        "sampled",
    )
    heads = sampled.filter("doc_id is not null").select("doc_id", "class", "digest", "n_words").distinct()
    classes = heads.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.first("class").alias("class"),
        F.first("n_words").alias("n_words"),
    )
    seeds = sampled.filter("seed is not null").select("class", "seed")
    shared = seeds.groupBy("seed").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")
    ).filter("low < high").selectExpr("seed", f"cast(ceil(n / {GROUP_ROWS}) AS int) AS parts")
    listed = seeds.join(shared, "seed").groupBy("class").agg(F.collect_set(F.struct("seed", "parts")).alias("seeds"))
    wanted = classes.join(listed, "class").select(F.col("first_id").alias("doc_id"), "digest", "seeds")
    wanted = wanted.groupBy("doc_id").agg(F.flatten(F.collect_list("seeds")).alias("seeds"))
    contexts = texts.join(wanted, "doc_id").mapInArrow(
        _contexts(seed_words, min_words),
        "doc_id long, place long, seed long, parts int, before binary, after binary",
    )
    dealt = [F.pmod(F.xxhash64(c), F.col("parts").cast("long")) for c in ("after", "doc_id")]
    ordered = contexts.withColumn("cell", F.xxhash64("seed", *dealt)).repartition("cell").sortWithinPartitions("cell", "after")
    compared = scratch.save(
        ordered.mapInArrow(_compare(seed_words, min_words), ", ".join(f"{name} long" for name in NAMES)), "compared"
    )
    windows = compared.filter("window is not null")
    met = windows.groupBy("window").agg(
        F.min(F.coalesce("low", "doc_id")).alias("least"), F.max(F.coalesce("high", "doc_id")).alias("most")
    ).filter("least < most")
    places = compared.filter("window is null").select("doc_id", "start", "n_words", "other").union(
        windows.filter("doc_id is not null").join(met, "window").select(
            "doc_id", "start", F.lit(min_words).cast("long"),
            F.when(F.col("least") == F.col("doc_id"), F.col("most")).otherwise(F.col("least")),
        )
    ).distinct()
    by_start = Window.partitionBy("doc_id").orderBy("start", "n_words", "other")
    reached = F.max(F.col("start") + F.col("n_words")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("start") <= F.col("reached"), F.lit(False)), 0).otherwise(1)
    islands = places.withColumn("reached", reached).withColumn("island", F.sum(opens).over(by_start))
    merged = islands.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n_words")).alias("stop"), F.min("other").alias("other")
    )
    copied = F.col("first_id") < F.col("last_id")
    whole = heads.join(classes.filter(copied).drop("class", "n_words"), "digest").filter(F.col("n_words") >= min_words).select(
        "doc_id", F.lit(0).cast("long").alias("start"), "n_words",
        F.when(F.col("first_id") < F.col("doc_id"), F.col("first_id")).otherwise(F.col("last_id")).alias("other_doc_id"),
    )
    single = classes.filter(~copied).select(F.col("first_id").alias("doc_id"))
    parts = merged.join(single, "doc_id", "left_semi").select(
        "doc_id", "start", (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id")
    )
    return whole.union(parts)
