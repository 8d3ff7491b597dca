"""Substring dedup: remove the words of every 35-word window that occurs twice or more.

Method: a compressed FM-index per shard. First a pruning: runs of `size` words are
fingerprinted (64-bit, in numpy) and winnowed, one chosen per window; the consecutive windows
that choose one run make a region, so every window is in one region only. Regions whose run's
fingerprint occurs twice or more are kept (a repeated window always holds such a run, see
`minimisers`). Equal windows choose the same run, so regions are dealt into shards of about
`shard_words` words by fingerprint: all that a region must be compared with is in its own
shard, and no region goes to two. Regions of equal bytes make a class (128-bit digest), of
which one text goes on, marked if it stands for several. Per shard, the classes' words are
indexed by the Burrows-Wheeler transform of their word ids, held in a wavelet matrix of packed
bit planes with rank samples; backward search over it finds the windows that occur twice (once,
in a class that stands for several regions): a search that fails rules out all windows that
hold the failed words, and windows between two hits that touch are not asked. Fingerprints
only route and prune; the decision is the exact search on word strings.

A fingerprint whose classes alone would fill much of a shard (a short phrase in many different
contexts) is split further: its windows become regions of their own, dealt by all their words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch
from stratacast.llm.words import hash_words, mix, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
#: A fingerprint with more than this part of a shard's words is split by whole windows.
HOT = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def minimisers(hashes: np.ndarray, owner: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first windows, last windows, fingerprints) of the `size`-word runs chosen by winnowing.

    `hashes` are those of the words of many texts, in order, `owner` their texts; a window
    goes by the place of its first word in `hashes`. In every stretch of window - size + 1
    consecutive runs (the runs of one `window`-word window) the smallest fingerprint, leftmost
    on ties, is chosen; windows in a row that choose one run are listed together. A window
    that occurs twice has the same runs in both places, so both choose the same run: every
    repeated window's chosen run has a fingerprint that is chosen twice or more.
    """
    count, span = len(hashes) - size + 1, window - size + 1
    none = np.zeros(0, np.int64)
    if count < span:
        return none, none, np.zeros(0, np.uint64)
    runs = np.zeros(count, np.uint64)
    for at in range(size):
        runs = runs * np.uint64(_BASE) + hashes[at:count + at]
    runs = mix(runs)
    # leftmost minimum of `width` runs by doubling; the last step overlaps
    low, place, width = runs, np.arange(count), 1
    while width < span:
        step = min(width, span - width)
        left, right = low[:-step], low[step:]
        place = np.where(right < left, place[step:], place[:-step])
        low, width = np.minimum(left, right), width + step
    starts = np.flatnonzero(owner[:count - span + 1] == owner[window - 1:])
    if not len(starts):
        return none, none, np.zeros(0, np.uint64)
    chosen = place[starts]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1], runs[chosen[new]]


# -- the index -------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of an integer text by prefix doubling (shorter suffix first on ties).

    With `depth`, suffixes need only be in order of their first `depth` symbols, which is
    all that a backward search for patterns below that length depends on.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(rank.max(initial=1)).bit_length()
    step = max(62 // bits, 1)  # so many symbols make the first key
    key = np.zeros(n, np.int64)
    for at in range(step):
        key <<= bits
        key[: max(n - at, 0)] |= rank[at:]
    while True:
        order = np.argsort(key, kind="stable")
        listed = key[order]
        change = np.zeros(n, np.int64)
        change[1:] = listed[1:] != listed[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change) + 1
        if rank.max(initial=0) == n or step >= n or (depth is not None and step >= depth):
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:]
        step *= 2


class WaveletMatrix:
    """Rank queries over a sequence of small integers in packed bit planes."""

    def __init__(self, values: np.ndarray):
        top = max(int(values.max(initial=0)), 1)
        self.levels = top.bit_length()
        self.planes, self.samples, self.zeros = [], [], []
        current = values.astype(np.int64)
        for level in range(self.levels):
            bits = ((current >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little")
            words = packed.view(np.uint64)
            self.planes.append(words)
            counts = np.bitwise_count(words).astype(np.int64)
            self.samples.append(np.concatenate(([0], np.cumsum(counts))))
            self.zeros.append(int(len(bits) - bits.sum()))
            current = np.concatenate((current[~bits], current[bits]))
        # where [0, 0) ends when followed down along each symbol's bits
        symbols = np.arange(top + 1)
        self.base = np.zeros(top + 1, np.int64)
        for level in range(self.levels):
            ones = self._ones(level, self.base)
            bit = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            self.base = np.where(bit, self.zeros[level] + ones, self.base - ones)

    def _ones(self, level: int, upto: np.ndarray) -> np.ndarray:
        block, offset = upto >> 6, (upto & 63).astype(np.uint64)
        mask = (np.uint64(1) << offset) - np.uint64(1)
        return self.samples[level][block] + np.bitwise_count(self.planes[level][block] & mask).astype(np.int64)

    def rank(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before `start` and before `stop` (vectors)."""
        # the occurrences of c before i: the width of [0, i) followed down the planes
        # along the bits of c
        at = np.concatenate((start, stop))
        both = np.concatenate((symbols, symbols))
        for level in range(self.levels):
            bit = ((both >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        at -= self.base[both]
        return at[: len(start)], at[len(start):]


class ShardIndex:
    """FM-index of the regions of one shard: word ids, BWT in a wavelet matrix, C table.

    With `window`, suffixes are in order of so many words, enough for patterns up to it.
    """

    def __init__(self, regions: list[list[str]] | pa.ListArray, window: int | None = None):
        if not isinstance(regions, pa.Array):
            regions = pa.array(regions, pa.list_(pa.string()))
        coded = regions.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        lengths = pc.list_value_length(regions).to_numpy(zero_copy_only=False).astype(np.int64)
        # 1 after each region, which no pattern holds; 0 at the end
        text = np.ones(int(lengths.sum()) + len(lengths) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        inside[-1] = False
        text[inside] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
        text[-1] = 0
        order = suffix_array(text, None if window is None else window + 1)
        self.size = len(text)
        self.text = text
        self.wavelet = WaveletMatrix(text[order - 1])
        counts = np.bincount(text, minlength=len(self.vocabulary) + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def ids(self, words: list[str] | pa.Array) -> np.ndarray:
        """Ids of words, -1 for those that the shard does not hold."""
        if not isinstance(words, pa.Array):
            words = pa.array(words, pa.string())
        found = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -3)
        return found.to_numpy(zero_copy_only=False).astype(np.int64) + 2

    def covering(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, need: np.ndarray, window: int) -> np.ndarray:
        """Start places in `ids` of windows with `need` occurrences that cover what all such windows cover.

        Row i asks for the windows that start at first[i] .. last[i]. All rows go on
        together, one backward step each at a time. A search that fails at place j, short of
        the window's start, rules out every window from its start to j. After a hit at h
        the window at h + `window` is next: if that is a hit too, those between add nothing.
        If not, the last hit between them is looked for by halving what is left.
        """
        hits = []
        a, b, need = first.copy(), last.copy(), need.copy()
        after = np.zeros(len(a), bool)  # the window at a - 1 is a hit
        halve = np.zeros(len(a), bool)  # the window at b + 1 is none
        live = a <= b
        a, b, need, after, halve = a[live], b[live], need[live], after[live], halve[live]

        def begin(a, b, after, halve):
            t = np.where(after, np.where(halve & (b - a < window), (a + b) >> 1, np.minimum(a - 1 + window, b)), a)
            return t, t + window, np.zeros(len(a), np.int64), np.full(len(a), self.size, np.int64)

        t, k, sp, ep = begin(a, b, after, halve)
        while len(a):
            k = k - 1
            symbols = ids[k]
            known = symbols >= 0
            safe = np.where(known, symbols, 0)
            low, high = self.before[safe], self.before[safe + 1]
            inner = np.flatnonzero(known & (k < t + window - 1))  # the last word needs no rank
            if len(inner):
                r, q = self.wavelet.rank(safe[inner], sp[inner], ep[inner])
                high[inner] = low[inner] + q
                low[inner] = low[inner] + r
            sp, ep = low, high
            failed = ~known | (ep - sp < need)
            hit = ~failed & (k == t)
            done = failed | hit
            if not done.any():
                continue
            hits.append(t[hit])
            # a failed jump leaves two ranges: before t (halved), and after k
            split = np.flatnonzero(failed & (t > a))
            extra = (a[split], t[split] - 1, need[split], after[split], np.ones(len(split), bool))
            a = np.where(hit, t + 1, np.where(failed, k + 1, a))
            after = np.where(hit, True, np.where(failed, False, after))
            going = np.flatnonzero(~done)
            fresh = np.flatnonzero(done & (a <= b))
            fa, fb, fn, fs, fh = (np.concatenate((x[fresh], y)) for x, y in zip((a, b, need, after, halve), extra))
            ft, fk, fsp, fep = begin(fa, fb, fs, fh)
            a, b, need, after, halve, t, k, sp, ep = (
                np.concatenate((x[going], y)) for x, y in
                zip((a, b, need, after, halve, t, k, sp, ep), (fa, fb, fn, fs, fh, ft, fk, fsp, fep)))
        return np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)

    def occurrences(self, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Per start place of `ids`: matching statistic (at most `window`) and occurrences."""
        starts = np.arange(max(len(ids) - window + 1, 0))
        sp = np.zeros(len(starts), np.int64)
        ep = np.full(len(starts), self.size, np.int64)
        matched = np.zeros(len(starts), np.int64)
        alive = np.ones(len(starts), bool)
        for k in range(window - 1, -1, -1):
            live = np.flatnonzero(alive)
            if not len(live):
                break
            symbols = ids[starts[live] + k]
            known = symbols >= 0
            alive[live[~known]] = False
            live, symbols = live[known], symbols[known]
            low, high = self.wavelet.rank(symbols, sp[live], ep[live])
            sp[live], ep[live] = self.before[symbols] + low, self.before[symbols] + high
            empty = ep[live] <= sp[live]
            alive[live[empty]] = False
            matched[live[~empty]] += 1
        count = np.where(matched == window, ep - sp, 0)
        return matched, count


# -- Spark steps -----------------------------------------------------------------------


REGIONS = "key long, digest binary, uid long, first int, span int"


def _regions(window: int, size: int):
    """Regions: windows `first` .. `first` + `span` of a text, which choose one run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, data, offsets in text_slices(batch.column(1)):
                hashes, starts, ends, owner = hash_words(data, offsets)
                first, last, found = minimisers(hashes, owner, window, size)
                held = memoryview(data)
                digests = [hashlib.blake2b(held[a:b], digest_size=16).digest()
                           for a, b in zip(starts[first].tolist(), ends[last + window - 1].tolist())]
                texts = owner[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(digests, pa.binary()), pa.array(uids[row + texts]),
                     pa.array((first - np.searchsorted(owner, texts)).astype(np.int32)), pa.array((last - first).astype(np.int32))],
                    ["key", "digest", "uid", "first", "span"])
    return run


def _single_windows(window: int):
    """The windows of the regions listed in `at` as regions of their own, by a hash of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text, at in zip(*(batch[c].to_pylist() for c in ("uid", "text", "at"))):
                listed = words_of(text)
                places = [place for r in at for place in range(r["first"], r["first"] + r["span"] + 1)]
                digests = [hashlib.blake2b(" ".join(listed[p:p + window]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                           for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(digests), np.int64)[::2]), pa.array(digests, pa.binary()),
                     pa.array([uid] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array([0] * len(places), pa.int32())],
                    ["key", "digest", "uid", "first", "span"])
    return run


#: `words` joined by a space, which no word holds: an array takes some 30 bytes a word in a shuffle.
WORK = "key long, digest binary, twice boolean, words string"
#: Words after which a batch of regions is sent on.
SENT_WORDS = 500_000


def _region_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"]
            ends = np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False)).tolist()
            regions = at.flatten()
            firsts, spans = (regions.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("first", "span"))
            joined, begin, held = [], 0, 0
            for text, end in zip(batch["text"], ends):
                listed = words_of(text.as_py())
                for r in range(begin + len(joined), end):
                    joined.append(" ".join(listed[firsts[r]:firsts[r] + spans[r] + window]))
                    held += spans[r] + window
                if held >= SENT_WORDS or end == ends[-1]:
                    part = regions.slice(begin, len(joined))
                    yield pa.RecordBatch.from_arrays(
                        [part.field("key"), part.field("digest"), part.field("twice"), pa.array(joined, pa.string())],
                        ["key", "digest", "twice", "words"])
                    joined, begin, held = [], end, 0
    return run


def _search(window: int, batch_words: int):
    """Per class with a repeated window: the words that such windows cover, from the region's first.

    They are one stretch: a region's windows all hold the run that they chose.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        words = pc.split_pattern(group["words"].combine_chunks(), " ")
        index = ShardIndex(words, window)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        last = first + lengths - window
        # a region that stands for several is itself a second occurrence
        need = np.where(group["twice"].to_numpy(), 1, 2).astype(np.int64)
        batch = first // max(batch_words, window)
        edges = np.append(np.flatnonzero(np.diff(batch, prepend=-1)), len(first))
        hits = np.concatenate([np.zeros(0, np.int64)] + [
            index.covering(index.text, first[a:b], last[a:b], need[a:b], window) for a, b in zip(edges[:-1], edges[1:])])
        low, high = np.searchsorted(hits, first), np.searchsorted(hits, last, side="right")
        found = np.flatnonzero(low < high)
        listed = group.select(["key", "digest"]).take(pa.array(found))
        return listed.append_column("start", pa.array((hits[low[found]] - first[found]).astype(np.int32))).append_column(
            "stop", pa.array((hits[high[found] - 1] - first[found] + window).astype(np.int32)))
    return run


def _kept():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_sha256 = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"]):
                listed = words_of(text)
                kept = listed
                if gone.is_valid:
                    cover = np.zeros(len(listed) + 1, np.int64)
                    np.add.at(cover, gone.values.field("start").to_numpy(), 1)
                    np.add.at(cover, gone.values.field("stop").to_numpy(), -1)
                    kept = [w for w, depth in zip(listed, np.cumsum(cover).tolist()) if not depth]
                n_words.append(len(listed))
                n_removed.append(len(listed) - len(kept))
                kept_sha256.append(hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_sha256, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def _shared(regions: DataFrame) -> DataFrame:
    twice = regions.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2").select("key")
    return regions.join(twice, "key", "left_semi")


def _classes(regions: DataFrame) -> DataFrame:
    """One row per class of equal regions: a place of it, and whether there are several."""
    return regions.groupBy("key", "digest").agg(
        F.min("uid").alias("uid"), F.min_by("first", "uid").alias("first"), F.max("span").alias("span"),
        (F.count("*") >= 2).alias("twice"))


def _listed(regions: DataFrame, *columns: str) -> DataFrame:
    return regions.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("at"))


def candidate_regions(rows: DataFrame, scratch: Scratch, window: int, size: int, most_words: int) -> tuple[DataFrame, DataFrame, int]:
    """(regions that may hold a repeated window, their classes, words in the classes) of `rows` (uid, text).

    All regions of equal windows have the same key. The classes of a key hold `most_words`
    words at most: windows of larger ones are regions of their own, with a key by all their words.
    """
    rows = rows.select("uid", "text")
    regions = scratch.save(rows.mapInArrow(_regions(window, size), REGIONS), "regions")
    regions = scratch.save(_shared(regions), "candidates")
    scratch.drop("regions")
    classes = scratch.save(_classes(regions), "classes")
    keys = classes.groupBy("key").agg(F.sum(F.col("span") + window).alias("words"))
    if (keys.agg(F.max("words")).first()[0] or 0) > most_words:
        hot = scratch.save(keys.filter(F.col("words") > most_words).select("key"), "hot")
        asked = _listed(regions.join(hot, "key", "left_semi"), "first", "span")
        single = scratch.save(rows.join(asked, "uid").mapInArrow(_single_windows(window), REGIONS), "single")
        single = scratch.save(_shared(single), "single-shared")
        scratch.drop("single")
        regions = regions.join(hot, "key", "left_anti").unionByName(single)
        classes = scratch.save(classes.join(hot, "key", "left_anti").unionByName(_classes(single)), "classes-split")
    words = classes.agg(F.sum(F.col("span") + window)).first()[0]
    return regions, classes, words or 0


def substring_dedup(docs: DataFrame, scratch: Scratch, window: int = 35, size: int = 10, shard_words: int = 2_000_000,
                    batch_words: int = 2_000_000) -> DataFrame:
    """Words of `docs` (doc_id, text) covered by a repeated `window`-word window.

    `docs` must read the same rows in the same order each time (a table): row ids are
    taken from places in it, so that the text is not copied. Words are maximal runs of
    characters other than space, tab, line feed, vertical tab,
    form feed and carriage return, taken unchanged. A window counts when its word
    sequence also starts at any other place, in the same document or another; every word
    it covers is removed. Rows that repeat are separate documents (so their windows
    repeat). Null or empty text: no words. Other columns are ignored. An index holds about
    `shard_words` words; `batch_words` of them are searched side by side. Returns per row:
    doc_id, n_words, n_removed, kept_sha256 (sha256 of the kept words joined by one space).
    """
    # ids by place in the input, the same each time the table is read; the text is not copied
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).withColumn("uid", F.monotonically_increasing_id())
    regions, classes, words = candidate_regions(rows, scratch, window, size, max(shard_words // HOT, window))
    shards = max(1, math.ceil(words / shard_words))
    work = rows.join(_listed(classes, "key", "digest", "twice", "first", "span"), "uid").select("text", "at").mapInArrow(
        _region_words(window), WORK)
    found = work.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(
        _search(window, batch_words), "key long, digest binary, start int, stop int")
    found = scratch.save(found, "found")
    gone = scratch.save(regions.join(found, ["key", "digest"]).select(
        "uid", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")), "gone")
    scratch.drop(*(name for name in scratch.paths if name != "gone"))
    listed = gone.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    return rows.join(listed, "uid", "left").select("doc_id", "text", "gone").mapInArrow(
        _kept(), "doc_id long, n_words long, n_removed long, kept_sha256 string")
