"""Substring dedup against a plain count of all windows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from stratacast.llm.common import Scratch
from stratacast.llm.substring_dedup import ShardIndex, candidate_regions, minimisers, substring_dedup, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    listed = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in listed for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, listed):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] >= 2:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array_and_counts_match_plain_sorting():
    rng = random.Random(2)
    for _ in range(30):
        text = np.array([rng.randrange(1, 4) for _ in range(rng.randint(1, 60))] + [0], np.int64)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    regions = [[rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(6)]
    index = ShardIndex(regions)
    joined = ["|".join(r) for r in regions]
    for size in (1, 2, 3, 5):
        probe = [rng.choice("abcde") for _ in range(40)]
        matched, count = index.occurrences(index.ids(probe), size)
        for i in range(len(probe) - size + 1):
            pattern = probe[i:i + size]
            n = sum(1 for r in regions for j in range(len(r) - size + 1) if r[j:j + size] == pattern)
            assert count[i] == n and (matched[i] == size) == (n > 0)


def test_covering_hits_cover_what_all_hits_cover():
    rng = random.Random(1)
    for window in (2, 3, 5, 8):
        base = [rng.choice("abcdef") for _ in range(40)]
        regions = [base[i:i + 15] + [rng.choice("xyz")] + base[j:j + 20] for i, j in ((0, 5), (3, 9), (20, 1))]
        index = ShardIndex(regions, window)
        for probe, need in ((regions[0], 2), (["q", *base, "x"], 1)):
            ids = index.ids(probe)
            count = index.occurrences(ids, window)[1]
            last = len(probe) - window
            got = index.covering(ids, np.array([0]), np.array([last]), np.array([need]), window).tolist()
            wanted = np.flatnonzero(count >= need).tolist()
            assert set(got) <= set(wanted)
            assert {x + k for x in got for k in range(window)} == {x + k for x in wanted for k in range(window)}


def test_a_long_copy_takes_one_search_a_window_length():
    words = [f"w{i}" for i in range(3500)]
    index, window = ShardIndex([words, words], 35), 35
    hits = index.covering(index.ids(words), np.array([0]), np.array([3500 - window]), np.array([2]), window)
    assert len(hits) <= 3500 // window + 1


@pytest.mark.parametrize("window,size,shard_words,batch_words", [(4, 2, 40, 30), (4, 4, 40, 30), (35, 10, 100_000, 100_000), (35, 10, 300, 200), (35, 1, 300, 200)])
def test_query_equals_plain_count(spark, frame, odd_rows, window, size, shard_words, batch_words):
    rows = odd_rows + [(200, "x " * 34 + "y"), (201, "x " * 36), (202, "é ü " * 40)]
    got = substring_dedup(frame(rows), Scratch(spark, "test"), window=window, size=size, shard_words=shard_words,
                          batch_words=batch_words).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)


def test_empty_table(spark, frame):
    assert substring_dedup(frame([]), Scratch(spark, "test")).count() == 0


def test_copies_are_searched_once(spark, frame):
    """Regions of equal text make one class, however many documents and shards hold them."""
    words = " ".join(f"w{i}" for i in range(400))
    made = []
    for copies in (2, 40):
        rows = frame([(i, words) for i in range(copies)]).selectExpr("monotonically_increasing_id() AS uid", "text")
        regions, classes, n = candidate_regions(rows, Scratch(spark, "test"), 35, 10, 1_000_000)
        assert regions.count() == copies * classes.count()
        assert classes.filter("not twice").count() == 0
        made.append((classes.count(), n))
    assert made[0] == made[1]


def test_every_window_is_in_one_region():
    rng = random.Random(4)
    owner = np.repeat(np.arange(4), (50, 3, 36, 80))
    hashes = np.array([rng.getrandbits(64) for _ in range(5)], np.uint64)[[rng.randrange(5) for _ in owner]]
    first, last, _ = minimisers(hashes, owner, 35, 10)
    windows = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    assert windows == [w for w in range(len(owner) - 34) if owner[w] == owner[w + 34]]


def test_phrase_in_many_contexts_is_split(spark, frame):
    """The regions of a common phrase do not fill one shard; what repeats among them is still found."""
    rng = random.Random(6)
    phrase = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(30)), *phrase, *(f"b{rng.randrange(10**6)}" for _ in range(30))]))
            for i in range(60)]
    rows += [(100, rows[7][1].replace(" ", "\n")), (101, "start " + rows[9][1])]
    table = frame(rows).selectExpr("monotonically_increasing_id() AS uid", "text")
    _, classes, _ = candidate_regions(table, Scratch(spark, "test"), 35, 10, 500)
    assert classes.groupBy("key").agg({"span": "sum", "*": "count"}).selectExpr("max(`sum(span)` + 35 * `count(1)`)").first()[0] <= 500
    got = substring_dedup(frame(rows), Scratch(spark, "test"), shard_words=2000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 35)
