"""The Merkle manifest against a plain Python tree."""

import hashlib
import zlib

import pytest

from stratacast.llm.common import Scratch
from stratacast.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def leaf(row, bump=0):
    n = None if row[3] is None else row[3] + bump
    return h("".join(field(v) for v in (row[0], row[1], row[2], n, row[4])))


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [list(nodes)]
    while len(out[-1]) > 1:
        level = out[-1]
        out.append([h("".join(level[i:i + 2])) for i in range(0, len(level), 2)])
    return out


def path(all_levels, at):
    steps = []
    for level in all_levels[:-1]:
        other = at ^ 1
        steps.append((at % 2 == 1, level[other] if other < len(level) else None))
        at //= 2
    return steps


def fold(start, steps):
    for right, sibling in steps:
        start = h(start) if sibling is None else h(sibling + start) if right else h(start + sibling)
    return start


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(r, 1)))
        trees[g] = (members, levels([leaf(r) for r in members]))
    top = levels([trees[g][1][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        members, lower = trees[g]
        upper = path(top, place)
        for at, row in enumerate(members):
            steps = path(lower, at) + upper
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            start = leaf(row, 1) if tampered else leaf(row)
            folded = fold(start, steps)
            out.append((row[0], leaf(row), lower[-1][0], top[-1][0],
                        h("".join(s for _, s in steps if s is not None)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(count, langs):
    rows = []
    for i in range(count):
        lang = langs[i % len(langs)]
        rows.append((i * 3, "web" if i % 4 else None, lang, None if i % 9 == 4 else 10 + i,
                     None if i % 11 == 5 else f"text é {i} " * (i % 5)))
    return rows


@pytest.mark.parametrize("count,langs", [(1, ["en"]), (2, ["en"]), (3, [None]), (17, ["en", "de", None]),
                                         (70, ["en", "fr", "de", "ß", "e"]), (300, ["en"] * 9 + ["de"])])
def test_manifest_matches_a_plain_tree(spark, count, langs):
    rows = rows_of(count, langs)
    rows += [rows[0]] if count > 2 else []  # a repeated row
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = manifest(frame, Scratch(spark, "test")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    tampered = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0]
    assert count < 17 or any(not r.verified for r in tampered)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest(empty, Scratch(spark, "test")).count() == 0
    rows = [(None, None, None, None, None), (None, "s", "en", 3, ""), (5, None, "en", None, None)]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = manifest(frame, Scratch(spark, "test")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
