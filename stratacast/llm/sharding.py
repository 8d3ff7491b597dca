"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 by doc_id; a row's number is sent to a pseudo-random place by a
Feistel network over pairs (left, right) with left < a, right < b and a * b >= n, which is a
permutation of 0 .. a*b-1 whatever its round function. A place of n or more is sent through
again (cycle walking) until it falls below n, which gives a permutation of 0 .. n-1. Shard
and slot are the remainder and quotient of the place by the number of shards, so the counts
of shards differ by one row at most. All of it can be computed for any row number, and
backwards for any slot, from n, the number of shards and the seed alone.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratacast.llm.common import Scratch

ROUNDS = 6
PRIME = (1 << 31) - 1
#: Passes of cycle walking. A pass ends outside with a chance below 1 / sqrt(n).
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + 7_919 * (at + 1) * (at + 5)) % 1_000_000_007 for at in range(ROUNDS)]


def _stir(half: Column, key: Column) -> Column:
    """A round function below 2**31: integer arithmetic that any SQL engine has."""
    moved = (half + key) % F.lit(PRIME)
    return ((moved * moved) % F.lit(PRIME) * F.lit(48_271) + half * F.lit(69_621)) % F.lit(PRIME)


def _one_pass(number: Column, a: int, b: int, keys: list[int], backwards: bool) -> Column:
    """All rounds: even ones move the left half by the right one, odd ones the right by the left."""
    sign = -1 if backwards else 1
    steps = [(at % 2 == 0, key) for at, key in enumerate(keys)]
    rounds = F.array(*(
        F.struct(F.lit(left).alias("left"), F.lit(key).cast("long").alias("key"))
        for left, key in (reversed(steps) if backwards else steps)
    ))
    pair = F.struct((number % a).cast("long").alias("l"), ((number - number % a) / a).cast("long").alias("r"))

    def step(p, turn):
        moved_l = F.pmod(p["l"] + sign * _stir(p["r"], turn["key"]), F.lit(a))
        moved_r = F.pmod(p["r"] + sign * _stir(p["l"], turn["key"]), F.lit(b))
        return F.struct(
            F.when(turn["left"], moved_l).otherwise(p["l"]).cast("long").alias("l"),
            F.when(turn["left"], p["r"]).otherwise(moved_r).cast("long").alias("r"),
        )

    return F.aggregate(rounds, pair, step, lambda p: p["r"] * a + p["l"])


def permuted(number: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """Where row `number` of `n` goes; with `backwards`, which row went there."""
    a, b = sides(n)
    keys = round_keys(seed)
    passes = max(min(WALKS, a * b - n), 0)

    def walk(place, _):
        return F.when(place < n, place).otherwise(_one_pass(place, a, b, keys, backwards))

    first = _one_pass(number, a, b, keys, backwards)
    if not passes:
        return first
    lost = F.raise_error(F.lit("cycle walking did not end; take another seed")).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(passes)), first, walk, lambda p: F.when(p < n, p).otherwise(lost)
    )


def shard_and_slot(place: Column, shards: int) -> tuple[Column, Column]:
    return (place % shards).cast("int"), ((place - place % shards) / shards).cast("long")


def number_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number in a slot of a shard."""
    return permuted(slot * shards + shard, n, seed, backwards=True)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """`rows` with their global number in `order`, and how many there are.

    Sorted runs are written once with each row's place in its run; what a run adds is the
    sum of the runs before it, one number for each run.
    """
    runs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    stored = scratch.save(
        rows.repartitionByRange(runs, *order).sortWithinPartitions(*order).select(
            "*", F.shiftright(place, 33).alias("run"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")
        ), "numbered",
    )
    counts = stored.groupBy("run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = F.broadcast(counts.select("run", before.alias("before")))  # one row for each run
    number = (F.col("before") + F.col("within")).alias("number")
    return stored.join(starts, "run").select(*rows.columns, number), n


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of `docs`.

    size is the text's UTF-8 bytes plus one, text_crc32 that of the text; null texts count
    as empty. Rows are numbered by doc_id, then checksum, size and a hash of the text; equal
    rows take neighbouring numbers. Rows without doc_id come first. The law is `rows`: the
    shards' counts differ by one at most. grown_shard is null, as another number of shards
    moves any row. Other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
    )
    scratch = Scratch(docs.sparkSession, "sharding")
    placed, n = numbered(rows, ["doc_id", "text_crc32", "size", "text_hash"], scratch)
    placed = placed.withColumn("place", permuted(F.col("number"), n, seed))
    shard, slot = shard_and_slot(F.col("place"), shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
