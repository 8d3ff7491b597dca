"""Language identification by a sparse multinomial logistic regression.

Features are character n-grams of one to three letters (words set apart by one space, case
folded), hashed into a fixed number of columns and weighted by TF-IDF. Document frequencies
count all rows that may be learned from. The weights are fitted by follow-the-regularised-
leader with an elastic-net penalty, which leaves most of them exactly zero, on a bounded
sample of rows; a further part of the sample sets the temperature that divides the scores,
so that the probability of the winner is an honest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.llm.characters import code_points, letters, lowered
from stratacast.llm.common import held_out
from stratacast.llm.words import mix

COLUMN_BITS = 15
ORDERS = (1, 2, 3)
#: Rows the regression is fitted on, those of the smallest hash; a fifth of them calibrate.
SAMPLE_ROWS = 4000
UNKNOWN = "und"


@dataclass
class Penalty:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3


def _stream(points: np.ndarray, offsets: np.ndarray):
    """Letters in lower case and single spaces; (code points, text number of each)."""
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.where(letter, lowered()[points], np.uint32(32))[keep].astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    return line, owner


def text_counts(column: pa.Array):
    """Per text with a letter: (row, columns present, their counts)."""
    for first, stop, points, offsets in code_points(column):
        line, owner = _stream(points, offsets)
        edges = np.searchsorted(owner, np.arange(stop - first + 1))
        hashed = []
        for order in ORDERS:
            key = np.full(max(len(line) - order + 1, 0), order, np.uint64)
            for at in range(order):
                key = key * np.uint64(0x9E3779B97F4A7C15) + line[at:len(line) - order + 1 + at] if len(key) else key
            hashed.append((mix(key) >> np.uint64(64 - COLUMN_BITS)).astype(np.int32))
        for row in range(stop - first):
            low, high = edges[row], edges[row + 1]
            if low == high:
                continue
            mine = [h[low:max(high - order + 1, low)] for order, h in zip(ORDERS, hashed, strict=True)]
            counts = np.bincount(np.concatenate(mine), minlength=1 << COLUMN_BITS)
            present = np.flatnonzero(counts)
            yield first + row, present, counts[present]


def _frequencies(batches):
    found, texts = np.zeros(1 << COLUMN_BITS, np.int64), 0
    for batch in batches:
        for _, present, _ in text_counts(batch.column("text")):
            found[present] += 1
            texts += 1
    present = np.flatnonzero(found)
    yield pa.record_batch([
        pa.array(np.append(present, -1)), pa.array(np.append(found[present], texts)),
    ], names=["place", "n"])


def _weigh(present: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[present]
    return values / max(np.sqrt(values @ values), 1e-12)


def _rows(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            kept, places, values = [], [], []
            for row, present, counts in text_counts(batch.column("text")):
                kept.append(row)
                places.append(present.astype(np.int16))
                values.append(_weigh(present, counts, idf).astype(np.float32))
            if kept:
                taken = pa.array(kept)
                yield pa.record_batch([
                    batch.column("lang").take(taken), batch.column("turn").take(taken),
                    pa.array(places, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32())),
                ], names=["lang", "turn", "places", "values"])

    return run


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max())
    return raised / raised.sum()


def fit_ftrl(rows: list, n_classes: int, penalty: Penalty) -> np.ndarray:
    """(classes, columns) weights; `rows` are (class, columns, values) in the order to learn in."""
    z = np.zeros((n_classes, 1 << COLUMN_BITS))
    squares = np.zeros_like(z)
    p = penalty

    def weights(z, squares):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(squares)) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for label, places, values in rows:
            values = values.astype(float)
            held, seen = z[:, places], squares[:, places]
            now = weights(held, seen)
            wrong = softmax(now @ values)
            wrong[label] -= 1
            step = wrong[:, None] * values
            more = seen + step * step
            z[:, places] = held + step - (np.sqrt(more) - np.sqrt(seen)) / p.alpha * now
            squares[:, places] = more
    return weights(z, squares)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss, between 0.05 and 20."""
    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        top = s.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(s - top).sum(1))
        return float((total - s[np.arange(len(labels)), labels]).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _lists(column: pa.ChunkedArray):
    """The elements of a column of lists, as arrays that share its memory."""
    for chunk in column.chunks:
        flat, edges = chunk.values, chunk.offsets.to_pylist()
        yield from (flat.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True))


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: Penalty | None = None) -> Model | None:
    """A model from rows (doc_id, text, lang) that may be learned from; None if there are none."""
    usable = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counted = usable.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")
    ).toArrow()  # one row for each column of the model, as arrays: Row objects take many times the memory
    place, n = (counted.column(c).to_numpy() for c in ("place", "n"))
    texts = int(n[place == -1].sum())
    if not (place >= 0).any():
        return None
    frequency = np.zeros(1 << COLUMN_BITS)
    frequency[place[place >= 0]] = n[place >= 0]
    idf = np.log((1 + texts) / (1 + frequency)) + 1

    turn = F.xxhash64("doc_id", F.lit("language"))
    last = usable.select(turn.alias("turn")).orderBy("turn").limit(sample_rows).agg(F.max("turn")).first()[0]
    sample = usable.withColumn("turn", turn).filter(F.col("turn") <= last).limit(2 * sample_rows)
    rows = sample.mapInArrow(
        _rows(idf.astype(np.float32)), "lang string, turn long, places array<smallint>, values array<float>"
    ).toArrow()
    order = pc.sort_indices(rows.select(["turn", "lang"]), [("turn", "ascending"), ("lang", "ascending")]).to_pylist()
    langs = rows.column("lang").to_pylist()
    classes = sorted(set(langs))
    label = {name: at for at, name in enumerate(classes)}
    # the rows stay where they came in: views, in the order to learn in
    places, values = ([part.to_numpy() for part in _lists(rows.column(c))] for c in ("places", "values"))
    known = [(label[langs[at]], places[at], values[at]) for at in order]
    for_fit = [row for at, row in enumerate(known) if at % 5]
    for_calibration = known[::5]
    weights = fit_ftrl(for_fit or known, len(classes), penalty or Penalty())
    scores = np.array([weights[:, places] @ values.astype(float) for _, places, values in for_calibration])
    temperature = fit_temperature(scores, np.array([row[0] for row in for_calibration]))
    return Model(classes, weights.astype(np.float32), idf.astype(np.float32), temperature)


def _predict(model):
    def run(batches):
        found = model.value
        for batch in batches:
            predicted, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for row, present, counts in text_counts(batch.column("text")):
                raw = found.weights[:, present] @ _weigh(present, counts, found.idf)
                chance = softmax(raw.astype(float) / found.temperature)
                predicted[row], scores[row] = found.classes[int(chance.argmax())], chance.max()
            index = batch.schema.names.index("text")
            columns = [c for at, c in enumerate(batch.columns) if at != index]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*columns, pa.array(predicted), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per row of `docs`.

    Null texts and texts without a letter give `und` with score 0, and so do all texts if
    there was nothing to learn from.
    """
    texts = docs.select("doc_id", "text")
    if model is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # classes x columns numbers
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def _confident(model, least: float):
    def run(batches):
        found = model.value
        for batch in batches:
            keep = [False] * batch.num_rows
            for row, present, counts in text_counts(batch.column("text")):
                raw = found.weights[:, present] @ _weigh(present, counts, found.idf)
                keep[row] = float(softmax(raw.astype(float) / found.temperature).max()) >= least
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def confident(docs: DataFrame, least: float) -> DataFrame:
    """The rows of `docs` whose text has a language with a probability of `least`, all columns kept.

    Rejected are null texts, texts without a letter, and texts below `least`. With nothing
    to learn from, every row with a letter stays.
    """
    model = fit(docs.filter(~held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_confident(shared, least), docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score); learned from rows that are not held out.

    Rows of null language teach nothing. A row without doc_id counts as not held out. Rows
    that repeat are predicted each. Other columns are ignored.
    """
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
