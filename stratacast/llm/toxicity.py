"""Toxicity scores: gradient-boosted trees over dense text features, isotonic calibration.

The features are densities: hits of a weighted lexicon, hits near words of address (second
person), capitals, punctuation, characters that stand for others inside words, and such.
The lexicon is learned: words and word beginnings that labelled toxic texts have far more
often than the others. Trees are trained on features whose lexicon has not seen the row (two
halves of the labelled sample serve each other), so that they learn how far hits are to be
trusted; documents are then scored with the lexicon of both halves. A third part of the
sample calibrates.

All this is fitted on at most SAMPLE_ROWS labelled rows, those of the smallest hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.llm.characters import code_points, letters, lowered, spaces, uppers
from stratacast.llm.common import Scratch, held_out
from stratacast.llm.words import _BASE, _INVERSE, _power_table, mix

SAMPLE_ROWS = 20_000
#: Terms that may enter the lexicon, and those that do.
CANDIDATES = 200_000
LEXICON = 4000
PREFIXES = (4, 5, 6)
#: Least log odds of a term, and least evidence: log odds times toxic texts with the term.
LEAST_ODDS, LEAST_EVIDENCE = 2.0, 16.0
NEAR_WORDS = 5
FEATURES = (
    "hits", "hit_density", "distinct_hits", "weight_density", "hidden_hits", "addressed_hits", "address_density",
    "capitals", "shouted_words", "exclamations", "questions", "symbols", "altered_words", "stretched", "words",
    "word_length", "digits",
)
#: Characters written for a letter, and words of address in four languages.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
ADDRESS = (
    "you your yours yourself ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes vosotros tú ti tuyo"
).split()


@dataclass
class Chunks:
    """Runs of non-space characters, reduced to the letters they show or stand for."""

    owner: np.ndarray
    full: np.ndarray
    starts: dict[int, np.ndarray]
    altered: np.ndarray
    shouted: np.ndarray


def _polynomials(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(values)), out=sums[1:])
    return (sums[end] - sums[begin]) * _power_table(_INVERSE, len(values) + 1)[begin]


def _stand_ins() -> np.ndarray:
    table = np.zeros(0x10000, np.uint32)
    for mark, letter in STAND_INS.items():
        table[ord(mark)] = ord(letter)
    return table


_STAND_INS = _stand_ins()


def chunks(points: np.ndarray, offsets: np.ndarray) -> Chunks:
    letter, space = letters()[points], spaces()[points]
    stands = _STAND_INS[points]
    after_letter = np.concatenate(([False], letter[:-1]))
    before_letter = np.concatenate((letter[1:], [False]))
    first = np.concatenate(([True], space[:-1]))
    replaced = (stands > 0) & before_letter & (after_letter | first)
    keep = letter | replaced
    at = np.flatnonzero(keep)
    number = np.cumsum(~space & first)[at]
    shown = np.where(letter[at], lowered()[points[at]], stands[at])
    begin = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(at) else at
    end = np.append(begin[1:], len(at)).astype(np.int64)
    size = end - begin
    full = mix(_polynomials(shown, begin, end) + size.astype(np.uint64))
    starts = {}
    for length in PREFIXES:
        long = np.flatnonzero(size > length)
        key = mix(_polynomials(shown, begin[long], begin[long] + length) + np.uint64(1000 + length))
        held = np.zeros(len(begin), np.uint64)
        held[long] = key
        starts[length] = held
    owner = np.searchsorted(offsets, at[begin], "right") - 1
    spread = at[end - 1] - at[begin] + 1 if len(begin) else begin
    upper = np.add.reduceat(uppers()[points[at]].astype(np.int64), begin) if len(begin) else begin
    changed = np.add.reduceat(replaced[at].astype(np.int64), begin) if len(begin) else begin
    return Chunks(owner, full, starts, (spread > size) | (changed > 0), (size > 1) & (upper == size))


@dataclass
class Lexicon:
    terms: np.ndarray
    weights: np.ndarray

    def weigh(self, found: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """(weight, term) of each chunk: its strongest term, 0 if it has none."""
        best, term = np.zeros(len(found.full)), np.zeros(len(found.full), np.uint64)
        if not len(self.terms):
            return best, term
        for keys in (found.full, *found.starts.values()):
            place = np.searchsorted(self.terms, keys)
            place[place == len(self.terms)] = 0
            better = np.flatnonzero((self.terms[place] == keys) & (self.weights[place] > best))
            best[better], term[better] = self.weights[place[better]], keys[better]
        return best, term


def _address() -> np.ndarray:
    line = "\n".join(ADDRESS) + "\n"
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    return np.sort(chunks(points, np.array([0, len(points)])).full)


def _rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(points: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES) of a slice of texts."""
    n, found = len(offsets) - 1, chunks(points, offsets)
    weight, term = lexicon.weigh(found)
    hit = weight > 0

    def per_text(values):
        return np.bincount(found.owner, values, n)

    known = _address()
    place = np.searchsorted(known, found.full)
    place[place == len(known)] = 0
    address = known[place] == found.full
    spots = np.flatnonzero(address)
    near = np.zeros(len(hit), bool)
    if len(spots):
        at = np.flatnonzero(hit)
        right = np.searchsorted(spots, at)
        for side in (np.maximum(right - 1, 0), np.minimum(right, len(spots) - 1)):
            other = spots[side]
            near[at] |= (np.abs(other - at) <= NEAR_WORDS) & (found.owner[other] == found.owner[at])
    at = np.flatnonzero(hit)
    pairs = np.unique(np.stack((found.owner[at].astype(np.uint64), term[at])), axis=1) if len(at) else np.zeros((2, 0))
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)

    def per_char(mask):
        return np.add.reduceat(mask.astype(np.int64), offsets[:-1])

    letter = letters()[points]
    n_letters, n_chars = per_char(letter), np.diff(offsets)
    triple = np.zeros(len(points), bool)
    triple[2:] = letter[2:] & (points[2:] == points[1:-1]) & (points[2:] == points[:-2])
    words = per_text(np.ones(len(hit)))
    return np.stack([
        per_text(hit), 1000 * _rate(per_text(hit), words), distinct, 1000 * _rate(per_text(weight), words),
        per_text(hit & found.altered), per_text(near), 1000 * _rate(per_text(address), words),
        _rate(per_char(uppers()[points]), n_letters), _rate(per_text(found.shouted), words),
        1000 * _rate(per_char(points == 33), n_chars), 1000 * _rate(per_char(points == 63), n_chars),
        _rate(per_char(~letter & ~spaces()[points] & (points > 32)), n_chars), _rate(per_text(found.altered), words),
        1000 * _rate(per_char(triple), n_letters), np.log1p(words), _rate(n_letters, words),
        _rate(per_char((points >= 48) & (points <= 57)), n_chars),
    ], axis=1)


def _terms(batches):
    """Counts of texts with a term by half, from toxic texts."""
    for batch in batches:
        half = batch.column("half").to_numpy()
        for first, _, points, offsets in code_points(batch.column("text")):
            found = chunks(points, offsets)
            for keys in (found.full, *found.starts.values()):
                real = keys > 0
                pairs = np.unique(np.stack((found.owner[real].astype(np.uint64), keys[real])), axis=1)
                sides = half[first + pairs[0].astype(np.int64)]
                for side in (0, 1):
                    terms, counts = np.unique(pairs[1][sides == side], return_counts=True)
                    if len(terms):
                        yield pa.record_batch([
                            pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), side, np.int32)),
                            pa.array(counts),
                        ], names=["term", "half", "n"])


def _among(candidates):
    """As _terms, for listed terms only."""
    def run(batches):
        listed = candidates.value
        for batch in _terms(batches):
            keys = batch.column("term").to_numpy().view(np.uint64)
            place = np.searchsorted(listed, keys)
            place[place == len(listed)] = 0
            yield batch.filter(pa.array(listed[place] == keys))

    return run


def _lexicon(counts: dict, totals: dict, halves: tuple[int, ...]) -> Lexicon:
    """Terms by log odds; `counts` has (toxic, other) texts by (term, half)."""
    toxic = sum(totals.get((h, 1), 0) for h in halves)
    other = sum(totals.get((h, 0), 0) for h in halves)
    terms = sorted({term for term, _ in counts})
    with_term = np.array([[sum(counts.get((t, h), (0, 0))[k] for h in halves) for k in (0, 1)] for t in terms]).reshape(-1, 2)
    odds = np.log((with_term[:, 0] + 0.5) / (toxic + 1)) - np.log((with_term[:, 1] + 0.5) / (other + 1))
    evidence = odds * with_term[:, 0]
    good = np.flatnonzero((odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE))
    good = good[np.argsort(-evidence[good], kind="stable")][:LEXICON]
    keys = np.array([terms[at] for at in good], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], odds[good][order])


def _featured(lexicons):
    """Features of each text with the lexicon its column `half` names: 0 and 1 the other's, 2 all."""
    def run(batches):
        known = lexicons.value
        for batch in batches:
            index = batch.schema.names.index("text")
            half = batch.column("half").to_numpy()
            for first, stop, points, offsets in code_points(batch.column("text")):
                out = np.zeros((stop - first, len(FEATURES)))
                for side in np.unique(half[first:stop]):
                    mine = half[first:stop] == side
                    out[mine] = features(points, offsets, known[int(side)])[mine]
                part = batch.slice(first, stop - first)
                yield pa.record_batch(
                    [*(c for at, c in enumerate(part.columns) if at != index), pa.array(list(out), pa.list_(pa.float64()))],
                    names=[*(n for n in part.schema.names if n != "text"), "numbers"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of `docs`.

    `labels` has (doc_id, toxic); null labels, labels without a document and those of held
    out documents teach nothing. score is the calibrated probability (0 to 1), 0 for all if
    there is no label to learn from or only one kind of them. Null texts are scored as empty
    ones. Rows without doc_id, and rows that repeat, are scored like any other. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "toxicity")
    turn = F.xxhash64("doc_id", F.lit("toxicity"))
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic is not null"
    ).filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", turn)
    chosen = learn.orderBy("turn", "doc_id").limit(sample_rows)  # two numbers each: a bounded broadcast
    sample = scratch.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "toxic", F.pmod("turn", F.lit(2)).cast("int").alias("half"),
        (F.pmod(F.shiftright("turn", 1), F.lit(5)) == 0).alias("calibrates"),
    ), "sample")
    totals = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    scored = docs.select("doc_id", "text")
    if len({toxic for _, toxic in totals}) < 2:
        return scored.select(
            "doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")
        )

    kind = "term long, half int, n long"
    toxic_texts, other_texts = (sample.filter(F.col("toxic") == k).select("text", "half") for k in (1, 0))
    counted = toxic_texts.mapInArrow(_terms, kind).groupBy("term", "half").agg(F.sum("n").alias("n"))
    frequent = scratch.save(counted, "terms").groupBy("term").agg(F.sum("n").alias("n")).filter("n > 2")
    frequent = frequent.orderBy(F.desc("n"), "term").limit(CANDIDATES).select("term")
    listed = np.sort(frequent.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))
    counts: dict = {}
    if len(listed):
        known = context.broadcast(listed)
        others = other_texts.mapInArrow(_among(known), kind).groupBy("term", "half").agg(F.sum("n").alias("others"))
        both = spark.read.parquet(scratch.paths["terms"]).join(frequent, "term").join(others, ["term", "half"], "full")
        both = both.fillna(0, ["n", "others"]).toArrow()
        for term, half, n, m in zip(*(both.column(c).to_pylist() for c in ("term", "half", "n", "others")), strict=True):
            counts[term, half] = (n, m)
    lexicons = context.broadcast({
        0: _lexicon(counts, totals, (1,)), 1: _lexicon(counts, totals, (0,)), 2: _lexicon(counts, totals, (0, 1)),
    })
    rows = scratch.save(sample.mapInArrow(
        _featured(lexicons), "toxic int, half int, calibrates boolean, numbers array<double>"
    ), "features")
    vectors = rows.select(F.col("toxic").cast("double").alias("label"), "calibrates", array_to_vector("numbers").alias("features"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=2, seed=11, maxBins=64).fit(
        vectors.filter(~F.col("calibrates")).coalesce(4)
    )
    raw = vector_to_array(F.col("probability")).getItem(1)
    held = trees.transform(vectors.filter("calibrates")).select("label", raw.alias("raw"))
    isotonic = None
    if held.agg(F.countDistinct("label")).first()[0] == 2:
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="fitted").fit(held)
    numbers = scored.select("doc_id", "text", F.lit(2).alias("half")).mapInArrow(
        _featured(lexicons), f"doc_id {dict(scored.dtypes)['doc_id']}, half int, numbers array<double>"
    )
    result = trees.transform(numbers.select("doc_id", array_to_vector("numbers").alias("features"))).select(
        "doc_id", raw.alias("raw")
    )
    result = isotonic.transform(result) if isotonic is not None else result.withColumn("fitted", F.col("raw"))
    # a thousandth of the uncalibrated score keeps the order within a step
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("fitted") + 0.001 * F.col("raw")))
    return result.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
