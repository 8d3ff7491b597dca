"""Conversation repair against exhaustive search and a plain Python recount."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from stratacast.llm.conversations import repair, repaired, tables

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def exhaustive(symbols, roles, texts):
    """Every edit sequence (at most two insertions in a row), the cheapest, then ASCII-least."""
    found = []

    def walk(i, state, cost, audit, rows, inserted):
        if i == len(symbols) and state in (0, 3):
            found.append((cost, audit, rows))
        if inserted < 2:
            made = "a" if state == 2 else "u"
            walk(i, NEXT[(state, made)], cost + 3, audit + "I", rows + [(NAMES[made], "")], inserted + 1)
        if i == len(symbols):
            return
        symbol = symbols[i]
        walk(i + 1, state, cost + 4, audit + "D", rows, 0)
        if symbol:
            initial, extra = "suao"[(symbol - 1) // 2], 3 * ((symbol - 1) % 2)
            if (state, initial) in NEXT:
                walk(i + 1, NEXT[(state, initial)], cost + extra, audit + "K", rows + [(roles[i], texts[i])], 0)
            made = "a" if state == 2 else "u"
            walk(i + 1, NEXT[(state, made)], cost + 3 + extra, audit + "R", rows + [(NAMES[made], texts[i])], 0)

    walk(0, 0, 0, "", [], 0)
    best = min(c for c, _, _ in found)
    return min((a, r) for c, a, r in found if c == best) and (best, *min((a, r) for c, a, r in found if c == best))


def test_tables_are_small_and_complete():
    vectors, table = tables()
    assert len(vectors) < 64 and all(len(row) == len(table[0]) for row in table)


@pytest.mark.parametrize("seed", range(60))
def test_block_search_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 6)
    symbols = [rng.randrange(9) for _ in range(n)]
    roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(n)]
    texts = [f"t{i}" for i in range(n)]
    cost, audit, rows = repair(symbols, roles, texts)
    assert (cost, audit, rows) == exhaustive(symbols, roles, texts)


def test_long_conversation_is_linear_and_well_formed():
    rng = random.Random(1)
    n = 20_000
    symbols = [rng.randrange(9) for _ in range(n)]
    roles = [{"s": "system", "u": "user", "a": "assistant", "o": "tool"}["suao"[max(s - 1, 0) // 2]] for s in symbols]
    cost, audit, rows = repair(symbols, roles, ["x"] * n)
    initials = "".join(r[0][0] for r in rows)
    assert re.fullmatch(r"(s?(ua)+)?", initials) and len(audit) >= n


# plain Python recount of the whole query
END = re.compile(r"[.!?][\x20\x09-\x0D]*$")


def recount(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        if damage == 0:
            continue
        if damage == 1:
            text = ""
        elif damage == 2:
            text = re.sub(r"[.!?]", "", text)
        if damage == 4:
            role = "user"
        convs[conv_id] += [(turn, role, text)] * (2 if damage == 3 else 1)
    out = {}
    for conv_id, items in convs.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, symbols = set(), [], []
        for turn, role, text in items:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                fault = "b"
            elif (role, text) in seen:
                fault = "d"
            elif not END.search(text):
                fault = "t"
            else:
                fault = "n"
            seen.add((role, text))
            faults.append(fault)
            cls = "suao".index(role[:1]) if role[:1] in "sua" and role[:1] else 3
            symbols.append(0 if fault in "bd" else 1 + 2 * cls + (fault == "t"))
        turns = {t for t, _, _ in items if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in items]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        if items:
            cost, audit, fixed = exhaustive(symbols, [r[1] for r in items], [r[2] for r in items]) \
                if len(items) <= 6 else repair(symbols, [r[1] for r in items], [r[2] for r in items])
        else:
            cost, audit, fixed = 0, "", []
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        out[conv_id] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def test_query_rows_equal_a_plain_recount(spark):
    rng = random.Random(3)
    rows = []
    for conv_id in list(range(40)) + [None]:
        for turn in range(rng.randint(0, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, ""])
            text = rng.choice(["Hello there.", "Sure!", "no end", "  ", None, "Why? ", "ok.\n", "é"])
            rows.append((conv_id, rng.choice([turn, turn, None, turn + 2]), role, text))
    rows.append((99, 3, "user", "Same."))
    rows.append((99, 3, "user", "Same."))
    frame = spark.createDataFrame([(*r, 1.5, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, cost double, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in repaired(frame).collect()}
    assert got == recount(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(empty).count() == 0
