"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A repaired conversation has role initials `(s?(ua)+)?`: nothing, or an optional system
turn, then user and assistant turns in pairs. Rows are read in turn order; each row is a
symbol (its role initial among s, u, a or other, and its first fault). Edits: Keep 0,
Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert
an empty user or assistant turn anywhere 3; a truncated row that stays costs 3 more.

Method (Four Russians): the cost-to-go of the four automaton states, less its minimum,
takes few values. For every block of BLOCK symbols and every such normalised vector the
table holds the vector before the block and the amount taken off; it is built once per
Python worker from the rules alone. A conversation is processed block by block from its
end, by lookup. The trace then runs forward: each block is expanded backward from its
stored end vector, which gives the cost-to-go at every row, and at every place the
ASCII-least edit (D < I < K < R) that keeps the optimum is taken, so ties are settled
for the audit string as a whole.

Spark does the damage, the order, the faults and the counts (windows and aggregates);
the search itself runs per conversation in `applyInPandas`.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of one block looked up at once.
BLOCK = 3
#: Fixed values of the task: edit costs, allowed role initial pairs, sentence ends.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
ENDS = "[.!?]"
BLANK = r"[^\x20\x09-\x0D]"

_ROLES = "suao"  # role initial classes; o: any other initial
_PAD = 1 + 2 * len(_ROLES)  # fills the last block; changes nothing
_SYMBOLS = _PAD + 1
_INF = 1 << 30
# automaton states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept
_ACCEPT = (True, False, False, True)


def _next(state: int, initial: str) -> int | None:
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state in (0, 1, 3) else None
    if initial == "a":
        return 3 if state == 2 else None
    return None


def _made(state: int) -> str:
    """The role an insertion or rerole must give in `state`: u, except a after u."""
    return "a" if state == 2 else "u"


def _closed(values: list[int]) -> list[int]:
    """Cost-to-go with insertions at this place: min(v[q], 3 + w[after inserting])."""
    out = list(values)
    for _ in range(4):
        out = [min(out[q], INSERT + out[_next(q, _made(q))]) for q in range(4)]
    return out


def _step(symbol: int, after: list[int]) -> list[int]:
    """Cost-to-go before a row of `symbol`, from the cost-to-go after it."""
    if symbol == _PAD:
        return list(after)
    out = []
    for q in range(4):
        best = DELETE + after[q]
        if symbol:
            initial, extra = _ROLES[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
            kept = _next(q, initial)
            if kept is not None:
                best = min(best, KEEP + extra + after[kept])
            best = min(best, REROLE + extra + after[_next(q, _made(q))])
        out.append(best)
    return _closed(out)


def _end() -> list[int]:
    return _closed([0 if ok else _INF for ok in _ACCEPT])


@lru_cache(maxsize=1)
def tables():
    """(vectors, table): table[v][block] = (vector before the block, amount taken off)."""
    start = tuple(_end())
    vectors, ids, table = [start], {start: 0}, []
    at = 0
    while at < len(vectors):
        row = []
        for code in range(_SYMBOLS ** BLOCK):
            values = list(vectors[at])
            for place in range(BLOCK):
                values = _step((code // _SYMBOLS ** place) % _SYMBOLS, values)
            low = min(values)
            key = tuple(v - low for v in values)
            if key not in ids:
                ids[key] = len(vectors)
                vectors.append(key)
            row.append((ids[key], low))
        table.append(row)
        at += 1
    return vectors, table


def repair(symbols: list[int], roles: list[str], texts: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired rows) of one conversation, rows in order.

    Symbols: 0 a row that must go, else 1 + 2 * role class + truncated.
    """
    vectors, table = tables()
    n = len(symbols)
    padded = list(symbols) + [_PAD] * (-n % BLOCK)
    blocks = len(padded) // BLOCK
    codes = [sum(padded[b * BLOCK + p] * _SYMBOLS ** (BLOCK - 1 - p) for p in range(BLOCK)) for b in range(blocks)]
    bounds = [0] * (blocks + 1)  # vector id at the start of each block, the end last
    total = 0
    for b in range(blocks - 1, -1, -1):
        bounds[b], low = table[bounds[b + 1]][codes[b]]
        total += low
    cost = total + vectors[bounds[0]][0]
    audit, rows, state = [], [], 0
    for b in range(blocks):
        inside = [list(vectors[bounds[b + 1]])]
        for p in range(BLOCK - 1, -1, -1):
            inside.append(_step(padded[b * BLOCK + p], inside[-1]))
        inside.reverse()  # inside[p]: cost-to-go before row b * BLOCK + p
        for p in range(BLOCK + 1):
            at = b * BLOCK + p
            here = inside[p]
            last = p == BLOCK
            if last and b < blocks - 1:
                break  # the next block starts here
            if last or padded[at] == _PAD:
                if not last:
                    continue
                while not _ACCEPT[state]:
                    audit.append("I")
                    rows.append(("assistant" if _made(state) == "a" else "user", ""))
                    state = _next(state, _made(state))
                break
            symbol, after = padded[at], inside[p + 1]
            while True:
                goal = here[state]
                if DELETE + after[state] == goal:
                    audit.append("D")
                    break
                made = _next(state, _made(state))
                if INSERT + here[made] == goal:
                    audit.append("I")
                    rows.append(("assistant" if _made(state) == "a" else "user", ""))
                    state = made
                    continue
                initial, extra = _ROLES[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
                kept = _next(state, initial)
                if kept is not None and KEEP + extra + after[kept] == goal:
                    audit.append("K")
                    rows.append((roles[at], texts[at]))
                    state = kept
                else:
                    audit.append("R")
                    rows.append(("assistant" if _made(state) == "a" else "user", texts[at]))
                    state = made
                break
    return cost, "".join(audit), rows


def _repair_groups(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    cost, audit, rows = repair(frame["sym"].tolist(), frame["role"].tolist(), frame["text"].tolist())
    text = "\n".join(f"{role}:{body}" for role, body in rows)
    return pd.DataFrame({
        "conv_key": [frame["conv_key"].iloc[0]], "conv_null": [bool(frame["conv_null"].iloc[0])],
        "cost": np.array([cost], np.int64), "audit": [audit],
        "repaired_sha256": [hashlib.sha256(text.encode("utf-8")).hexdigest()],
    })


def damaged(convs: DataFrame) -> DataFrame:
    """Rows after damage by crc32(`conv_id:turn`) % 20 (nulls as one space).

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it (same turn),
    4 sets its role to user. Null role and text become one space first.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    ).filter(F.col("damage") != 0)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", ENDS, ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repaired(convs: DataFrame) -> DataFrame:
    """Faults, illegal pairs and the cheapest repair of every conversation of `convs`.

    Reads conv_id, turn, role, text; other columns are ignored. Rows are damaged as in
    `damaged`, then ordered per conversation by turn (nulls first), role, text (rows
    equal in all three are alike, so their order does not matter). A row's first fault
    counts: blank (no character other than white space), duplicate (role and text as an
    earlier row), truncated (its last such character is not one of .!?). illegal counts
    adjacent rows whose role initials are not su, ua or au; gaps is max - min + 1 -
    distinct turns (nulls ignored, 0 without turns). Returns one row per conv_id of the
    input, null included: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit (D, I, K, R per edit), repaired_sha256 (sha256 of the repaired `role:text`
    lines joined by newlines). A conversation without rows after damage has zeros, an
    empty audit and the sha256 of the empty string. An empty input gives no rows.
    """
    rows = damaged(convs).withColumn("conv_null", F.col("conv_id").isNull()).withColumn(
        "conv_key", F.coalesce(F.col("conv_id"), F.lit(0)))
    keys = ["conv_key", "conv_null"]
    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order))
    seen = Window.partitionBy(*keys, "role", "text").orderBy("pos")
    blank = ~F.col("text").rlike(BLANK)
    duplicate = F.row_number().over(seen) > 1
    truncated = ~F.col("text").rlike(ENDS + r"[\x20\x09-\x0D]*$")
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "*",
        F.when(blank, "b").when(duplicate, "d").when(truncated, "t").otherwise("n").alias("fault"),
        initial.alias("initial"),
        F.lag(initial).over(order).alias("before"),
    )
    cls = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    rows = rows.withColumn(
        "sym", F.when(F.col("fault").isin("b", "d"), F.lit(0))
        .otherwise(1 + 2 * cls + F.when(F.col("fault") == "t", 1).otherwise(0)).cast("int"))
    counts = rows.groupBy(*keys).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.count(F.when(F.col("fault") == "b", 1)).alias("blank"),
        F.count(F.when(F.col("fault") == "d", 1)).alias("duplicate"),
        F.count(F.when(F.col("fault") == "t", 1)).alias("truncated"),
        F.count(F.when(F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL_PAIRS), 1)).alias("illegal"),
    )
    search = rows.select(*keys, "pos", "sym", "role", "text").groupBy(*keys).applyInPandas(
        _repair_groups, "conv_key long, conv_null boolean, cost long, audit string, repaired_sha256 string")
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.col("conv_id").isNull().alias("conv_null"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv_key"))
    out = every.join(counts, keys, "left").join(search, keys, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.col("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
