"""Language identification (operator 6): hierarchical discrimination by linear support vector machines.

A first level predicts the language family; within it, one-versus-one linear support vector machines separate the
languages. Both levels vote over pairs. Features are hashed trigrams of the text's bytes (letters lower-cased, all
else a blank), by their share of the text. The machines are fitted on a bounded sample: the `sample` training rows
with the smallest hash of their doc_id; predictions read whole texts.

Held-out rows (crc32 of doc_id as text, modulo 3, is 1) and rows without a language are never learned from; language,
source and doc_id are never inputs of a prediction.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text if there is nothing
to learn from; a null doc_id is neither held out nor learned from; of equal votes the first name in alphabetical
order wins; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Rows, minimized, sigmoid
from .shipping import arrow_map
from .textcodes import LOWER, blocks

SAMPLE = 8_000
SLOT_BITS = 16
#: families of closely related languages; a language not listed is a family of its own
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance"}
_SCALE = 100.0

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = LOWER[0x41:0x5B]
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


class Machine(NamedTuple):
    first: str
    second: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def trigrams(data: np.ndarray) -> np.ndarray:
    """Slot of the three bytes from each position but the last two."""
    b = _LETTERS[data].astype(np.uint32)
    g = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    g *= np.uint32(0x9E3779B1)
    return g >> np.uint32(32 - SLOT_BITS)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, shares = [], []
        for _, _, data, offs in blocks(batch["text"]):
            g = trigrams(data) if len(data) > 2 else np.zeros(0, np.uint32)
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                s, n = np.unique(g[a:max(a, b - 2)], return_counts=True)
                slots.append(s.astype(np.int32))
                shares.append((_SCALE * n / max(n.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch["lang"], pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["lang", "slots", "shares"])


def fit_machine(rows: Rows, second: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine; positive scores mean `second`. Both sides weigh the same."""
    y = np.where(second, 1.0, -1.0)
    cost = np.where(second, 0.5 / max(second.sum(), 1), 0.5 / max((~second).sum(), 1))

    def gradient(x: np.ndarray) -> np.ndarray:
        g = -2 * cost * y * np.maximum(0, 1 - y * (rows.times(x[:-1]) + x[-1]))
        return np.append(rows.back(g) + decay * x[:-1], g.sum())

    x = minimized(gradient, np.zeros(rows.width + 1), steps, rate)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, families: dict[str, str] = FAMILIES, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` rows that have a language and aren't held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")
                         & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample)
    # at most `sample` ids are broadcast, and as many feature rows collected
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    table = arrow_map(rows.select("lang", "text"), _sparse, "lang string, slots array<int>, shares array<float>").limit(sample).toArrow()
    if not table.num_rows:
        return Model({}, [], {})
    lang = np.array(table["lang"].to_pylist(), dtype=object)
    slots, shares = table["slots"].combine_chunks(), table["shares"].combine_chunks()
    every = Rows(slots.offsets.to_numpy().astype(np.int64), slots.flatten().to_numpy().astype(np.int64),
                 shares.flatten().to_numpy().astype(float), 1 << SLOT_BITS)
    family = np.array([families.get(x, x) for x in lang], dtype=object)
    tree = {f: sorted(set(lang[family == f].tolist())) for f in sorted(set(family.tolist()))}

    def machines(label: np.ndarray, names: list[str]) -> list[Machine]:
        out = []
        for a, b in combinations(names, 2):
            part = (label == a) | (label == b)
            w, bias = fit_machine(every.some(part), label[part] == b)
            out.append(Machine(a, b, w.astype(np.float32), bias))
        return out

    return Model(tree, machines(family, list(tree)), {f: machines(lang, names) for f, names in tree.items()})


def _votes(names: list[str], machines: list[Machine], margins: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner in names and its confidence, for every row."""
    votes, least = np.zeros((len(names), n)), np.ones((len(names), n))
    for m, margin in zip(machines, margins):
        a, b = names.index(m.first), names.index(m.second)
        p = sigmoid(4 * margin)
        votes[b] += margin > 0
        votes[a] += margin <= 0
        least[a], least[b] = np.minimum(least[a], 1 - p), np.minimum(least[b], p)
    best = votes.argmax(0)
    return best, least[best, np.arange(n)]


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    every = [*model.between, *(m for own in model.within.values() for m in own)]
    for batch in batches:
        names, scores = [], [np.zeros(0)]
        for lo, hi, data, offs in blocks(batch["text"]):
            g = trigrams(data) if len(data) > 2 else np.zeros(0, np.uint32)
            counts = np.maximum(np.diff(offs) - 2, 0)
            ends, starts = offs[:-1] + counts, offs[:-1]
            margins = {}
            for k, m in enumerate(every):
                sums = np.zeros(len(g) + 1)
                np.cumsum(m.weights[g], out=sums[1:], dtype=float)
                starts, ends = np.minimum(starts, len(g)), np.minimum(ends, len(g))
                margins[k] = _SCALE * (sums[ends] - sums[starts]) / np.maximum(counts, 1) + m.bias
            families = list(model.families)
            n = hi - lo
            best, sure = _votes(families, model.between, [margins[k] for k in range(len(model.between))], n)
            named, at = np.full(n, "und", object), len(model.between)
            for f, family in enumerate(families):
                own = model.within[family]
                lang, p = _votes(model.families[family], own, [margins[at + j] for j in range(len(own))], n)
                at += len(own)
                here = best == f
                named[here] = np.array(model.families[family], object)[lang[here]]
                sure = np.where(here, sure * p, sure)
            letters = batch["letters"].slice(lo, n).fill_null(False).to_numpy(zero_copy_only=False)
            named[~letters] = "und"
            names += named.tolist()
            scores.append(np.where(letters, np.clip(sure, 0, 1), 0.0))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
            ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text",
                       F.col("text").rlike(r"\p{L}").alias("letters"))
    if not model.families:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of languages
    return arrow_map(rows, lambda it: _predict(it, shared.value),
                     f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
