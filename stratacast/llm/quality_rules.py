"""Quality rules learned as a decision list from labelled text statistics.

Sequential covering: a rule is a conjunction of thresholds on statistics, grown one by one
where the information gain for bad texts is largest, then cut back to the prefix that does
best on rows set aside; texts it covers leave, and the next rule is grown on the others. The
list ends when a new rule is no longer precise enough. Every step is one aggregate over the
labelled rows, of a few counts by statistic and bin. The result is an ordered conditional
expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BINS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.8
LEAST_COVER = 2
#: Statistics that rules may use, as SQL over the columns of `statistics`.
RATES = {
    "n_words": "n_words",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "longest_word": "longest_word",
}


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _neighbour_equal(items: Column, key) -> Column:
    """The items, of a sorted array, whose key one of their neighbours has."""
    def same(item, at):
        before, after = F.get(items, at - 1), F.get(items, at + 1)
        return F.coalesce(key(before) == key(item), F.lit(False)) | F.coalesce(key(after) == key(item), F.lit(False))

    return F.filter(items, same)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first time included.

    Windows are hashed to 64 bits. Sorting the leading hash bits with the place in one number
    finds the few windows that may repeat; those are then compared on the whole hash.
    """
    def count(bits: int):
        mask = F.lit((1 << bits) - 1).cast("long")

        def of(hashes):
            packed = F.array_sort(F.transform(
                hashes, lambda h, at: F.shiftleft(h, bits).bitwiseOR(at.cast("long"))
            ))
            likely = _let(packed, lambda line: _neighbour_equal(line, lambda x: F.shiftright(x, bits)))
            exact = F.array_sort(F.transform(likely, lambda x: F.struct(
                F.get(hashes, x.bitwiseAND(mask).cast("int")).alias("h"), x.bitwiseAND(mask).alias("at")
            )))
            places = _let(exact, lambda line: _neighbour_equal(line, lambda x: x["h"]))
            start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                F.array_sort(F.transform(places, lambda x: x["at"])), start,
                lambda held, at: F.struct(at.alias("last"), (held["n"] + F.least(F.lit(3).cast("long"), at - held["last"])).alias("n")),
                lambda held: held["n"],
            )

        return of

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda at: F.xxhash64(
        F.element_at(words, at), F.element_at(words, at + 1), F.element_at(words, at + 2)
    ))
    counted = F.when(F.size(words) < (1 << 22), _let(windows, count(22))).otherwise(_let(windows, count(31)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(counted)


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the base statistics of each text, with those the rules use besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest_word"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ))
    return docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _without(text, "0123456789").alias("n_digits"),
        _without(text, ".,;:!?").alias("n_marks"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def __str__(self) -> str:
        return f"({RATES[self.name]}) {'>' if self.above else '<='} {self.limit!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (F.expr(str(c)) for c in rule))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, limits: dict[str, list[float]]) -> Rule:
    """The conjunction with the largest gain at each step; `rows` has `bins` and `bad`."""
    names = list(limits)
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        part = rows.filter(covers(rule)) if rule else rows
        counted = part.select("bad", F.posexplode("bins").alias("at", "bin")).groupBy("at", "bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        ).collect()  # statistics x bins counts
        by: dict[int, dict[int, tuple[int, int]]] = {}
        for row in counted:
            by.setdefault(row.at, {})[row.bin] = (row.p, row.n)
        if not by:
            return rule
        p0, n0 = (sum(v[k] for v in by[0].values()) for k in (0, 1))
        if not p0 or not n0:
            return rule
        best, best_gain = None, 1e-9
        for at, found in sorted(by.items()):
            p = n = 0
            for number, limit in enumerate(limits[names[at]]):
                p, n = p + found.get(number, (0, 0))[0], n + found.get(number, (0, 0))[1]
                for above, mine in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = _gain(*mine, p0, n0)
                    if mine[0] >= LEAST_COVER and gain > best_gain:
                        best, best_gain = Condition(names[at], above, limit), gain
        if best is None:
            return rule
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The prefix with the largest (p - n) / (p + n) on rows set aside, and its precision."""
    counts = rows.agg(*(
        F.sum(F.when(covers(rule[:size]), flag)).alias(f"{kind}{size}")
        for size in range(1, len(rule) + 1) for kind, flag in (("p", F.col("bad")), ("n", 1 - F.col("bad")))
    )).first()
    best: tuple[float, int, float] = (-2.0, 0, 0.0)
    for size in range(1, len(rule) + 1):
        p, n = counts[f"p{size}"] or 0, counts[f"n{size}"] or 0
        if p + n:
            best = max(best, ((p - n) / (p + n), -size, p / (p + n)))
    return rule[:-best[1]], best[2]


def learn_rules(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> list[Rule]:
    """Ordered rules for bad texts, from `labels` (doc_id, quality: 1 good, 0 bad)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    labelled = stats.join(known, "doc_id").withColumn("bad", F.when(F.col("quality") == 0, 1).otherwise(0))
    shares = [i / BINS for i in range(1, BINS)]
    cuts = labelled.agg(*(
        F.percentile_approx(F.expr(f"CAST({sql} AS DOUBLE)"), shares, 1000).alias(name) for name, sql in RATES.items()
    )).first()
    limits = {name: sorted(set(cuts[name] or [])) for name in RATES}
    bins = F.array(*(
        reduce(lambda a, b: a + b, (F.expr(f"CAST(({sql}) > {x!r}D AS INT)") for x in limits[name]), F.lit(0))
        for name, sql in RATES.items()
    ))
    rows = scratch.save(labelled.withColumn("bins", bins).withColumn(
        "aside", F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    ), "labelled")
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule = _grow(left.filter("not aside"), limits)
        if not rule:
            break
        rule, precision = _prune(left.filter("aside"), rule)
        if not rule or precision < LEAST_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~covers(rule))
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a text, from 0; null if none does."""
    chain = None
    for number, rule in enumerate(rules):
        chain = F.when(covers(rule), number) if chain is None else chain.when(covers(rule), number)
    return F.lit(None).cast("int") if chain is None else chain


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    kept is false for these; else it is what the learned list says, whose rule that decided
    is in `rule` (null: none, the text is kept). Rules are learned from labelled texts that
    pass the base; without labels there are none. Null texts count as empty. Rows without
    doc_id and rows that repeat are judged like any other. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = scratch.save(statistics(docs).withColumn("base_failed", failed), "statistics")
    rules = learn_rules(stats.filter(~F.col("base_failed")), labels, scratch)
    number = F.when(~F.col("base_failed"), rule_number(rules))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & number.isNull()).alias("kept"), number.alias("rule"),
    )
