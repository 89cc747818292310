"""Quality classifier (operator 3): ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good). All grades share one vector of weights over hashed text; ordered
thresholds cut the score: P(grade > k) = logistic(score - threshold k). The expected grade ranks documents and the
tail probability P(grade = best) selects them.

Features are hashed words (present or not), hashed word shapes (letters and digits as classes, punctuation as it
is) by their share of the words, and the share of words that repeat the word before. The model is fitted on a bounded
sample of rated documents, `sample` rows with the smallest hash of doc_id; everything else reads whole texts of all rows.

Defined results: null and empty texts have no features and get the score of the thresholds alone; ratings with a null
part, or for no document, are not used; with no ratings at all every document gets grade and probability of the start
values and stays; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Rows, minimized, sigmoid
from .shipping import arrow_map
from .textcodes import ALNUM, LOWER, NOT_SPACE, blocks, mix, words

SAMPLE = 20_000
SLOTS = 1 << 24
#: a hashed feature counts if so many documents of the sample have it
LEAST = 5
GRADES = 3
KEEP = 0.5
#: share features are stretched to the size of presence features
_SHARE = 8.0
_REPEATS = SLOTS  # the feature of repeated words

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("A"), ord("0")]] = True


class Model(NamedTuple):
    slots: np.ndarray       # sorted
    weights: np.ndarray
    thresholds: np.ndarray


def _shares(slot: np.ndarray, row: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, counts = np.unique(row * (SLOTS + 1) + slot, return_counts=True)
    r = pairs // (SLOTS + 1)
    return r, pairs % (SLOTS + 1), _SHARE * counts / totals[r]


def features(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None):
    """(row, slot, value) of a block of texts; only of known slots where they are given."""
    wanted = None
    if known is not None:
        wanted = np.zeros(SLOTS + 1, bool)
        wanted[known] = True
    n = len(offs) - 1
    codes, _, _, rows = words(LOWER[data], offs, ALNUM)
    row = np.repeat(np.arange(n), np.diff(rows))
    slot = (codes >> np.uint64(40)).astype(np.int64)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    part = wanted[slot] if wanted is not None else np.ones(len(slot), bool)
    pairs = np.unique(row[part] * (SLOTS + 1) + slot[part])
    parts = [(pairs // (SLOTS + 1), pairs % (SLOTS + 1), np.ones(len(pairs)))]
    totals = np.maximum(np.diff(rows), 1)
    parts.append(_shares(np.full(int(again.sum()), _REPEATS), row[again], totals))
    # shapes: runs of one class shrink to one byte
    shape = _SHAPE[data]
    stays = np.ones(len(data), bool)
    stays[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    stays[offs[:-1][offs[:-1] < len(data)]] = True
    moved = np.concatenate([[0], np.cumsum(stays)])
    codes, _, _, rows = words(shape[stays], moved[offs], NOT_SPACE)
    row = np.repeat(np.arange(n), np.diff(rows))
    slot = (mix(codes + np.uint64(1)) >> np.uint64(40)).astype(np.int64)
    part = wanted[slot] if wanted is not None else np.ones(len(slot), bool)
    parts.append(_shares(slot[part], row[part], np.maximum(np.diff(rows), 1)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch["text"]):
            row, slot, value = features(data, offs)
            order = np.argsort(row, kind="stable")
            bounds = pa.array(np.searchsorted(row[order], np.arange(hi - lo + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["grade"].slice(lo, hi - lo), pa.ListArray.from_arrays(bounds, pa.array(slot[order].astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(value[order].astype(np.float32)))],
                ["grade", "slots", "values"])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels (quality 0/1, toxic 0/1)."""
    return labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def fit_rows(rows: Rows, grade: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of highest penalised likelihood."""
    n, k = max(len(grade), 1), GRADES - 1

    def thresholds(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))

    def gradient(x: np.ndarray) -> np.ndarray:
        w, t = x[:rows.width], x[rows.width:]
        cut = np.concatenate([[-np.inf], thresholds(t), [np.inf]])
        score = rows.times(w)
        above, below = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        p = np.maximum(above - below, 1e-9)
        by_cut = np.bincount(grade + 1, -above * (1 - above) / p, k + 2) + np.bincount(grade, below * (1 - below) / p, k + 2)
        by_cut = by_cut[1:-1]
        by_t = np.cumsum(by_cut[::-1])[::-1].copy()  # a later threshold holds every earlier step
        by_t[1:] *= np.exp(t[1:])
        return np.concatenate([rows.back(1 - above - below) / n + decay * w, by_t / n])

    x = minimized(gradient, np.concatenate([np.zeros(rows.width), [-2.0], np.zeros(k - 1)]), steps if len(grade) else 0, rate)
    return x[:rows.width], thresholds(x[rows.width:])


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rated documents; ratings are doc_id and grade."""
    chosen = ratings.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # at most `sample` rows of two numbers are broadcast, and as many feature rows collected
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    table = arrow_map(rated, _sparse, "grade int, slots array<int>, values array<float>").limit(sample).toArrow()
    grade = table["grade"].to_numpy().astype(np.int64)
    # small types, and one column after the other: the driver holds the features of the sample about twice
    counts = np.concatenate([np.zeros(0, np.int32), *(np.diff(c.offsets.to_numpy()) for c in table["slots"].chunks)])
    flat = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in table["slots"].chunks)])
    value = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in table["values"].chunks)])
    del table
    every = np.sort(flat)
    known = np.unique(every[:len(every) - LEAST + 1][every[:len(every) - LEAST + 1] == every[LEAST - 1:]]) if len(every) >= LEAST else every[:0]
    del every
    column = np.searchsorted(known, flat).astype(np.int32)
    on = known[np.minimum(column, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
    del flat
    row = np.repeat(np.arange(len(grade), dtype=np.int32), counts)[on]
    rows = Rows(np.searchsorted(row, np.arange(len(grade) + 1)), column[on], value[on], len(known))
    del column, value, row, on
    weights, thresholds = fit_rows(rows, grade)
    return Model(known.astype(np.int64), weights, thresholds)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [np.zeros(0)]
        for lo, hi, data, offs in blocks(batch["text"]):
            row, slot, value = features(data, offs, model.slots)
            at = np.minimum(np.searchsorted(model.slots, slot), max(len(model.slots) - 1, 0))
            on = model.slots[at] == slot if len(model.slots) else np.zeros(len(slot), bool)
            scores.append(np.bincount(row[on], (value * model.weights[at] if len(model.slots) else value)[on], hi - lo))
        score = np.concatenate(scores)
        tails = np.stack([sigmoid(score - t) for t in model.thresholds])
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in batch.schema.names if c != "text"), pa.array(tails.sum(0)), pa.array(tails[-1])],
            [*(c for c in batch.schema.names if c != "text"), "expected_grade", "p_best"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_best (probability of the best grade)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a slot for each feature of the sample
    return arrow_map(docs.select("doc_id", "text"), lambda it: _score(it, shared.value),
                     f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, p_best double")


def _select(batches: Iterator[pa.RecordBatch], model: Model, keep: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch["text"]], ["text"])
        p = next(_score(iter([texts]), model))["p_best"].to_numpy()
        yield batch.filter(pa.array(p >= keep))


def select_good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The documents, with all their columns, whose best-grade probability reaches `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, lambda it: _select(it, shared.value, keep), docs.schema)
