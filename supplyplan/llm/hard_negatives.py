"""Hard-negative mining (operator 11): integer scores of anchors against all rows, by Strassen's recursion on tiles.

Vectors become int64 components floor(scale * x). Rows and anchors are dealt over a grid of cells: a cell gets one group
of anchors, bounded in bytes, and one part of the rows, which streams past them tile by tile. A tile product is
recursive with zero padding and exact. Every cell keeps the best rows of each anchor (positives), and in a second run
the best rows of each anchor's windows under its positives (negatives). Such heaps merge: the cells emit at most so
many rows for each anchor, and a ranked window over the anchor takes the best of all cells.

Defined results: a row with a null vec_id, label or vector, or with a null or non-finite component, takes no part.
Exactly equal rows count once; other rows that share a vec_id each take part under it, ordered by a hash after the
vec_id. Shorter vectors are padded with zeros, so an empty one scores 0. Ties go to the smaller vec_id. An anchor
without positives, or a window without rows, gives no rows; nor does an empty table. Extra columns are ignored. A score
of 2**56 or more can't be returned exactly in the contract's products and is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, stored
from .shipping import arrow_map

SCALE = 256
POSITIVES = NEGATIVES = 5
#: a negative scores at least LOW / HIGH of the positive, and at most as much as the positive
LOW, HIGH = 80, 100
#: sides of tiles up to which numpy multiplies, and the sides of a tile
LEAF, ANCHOR_TILE, ROW_TILE = 32, 512, 1024
#: bytes of the anchors of one cell, and rows of a part
GROUP_BYTES, PART_ROWS = 16 << 20, 1 << 18
EXACT = 1 << 56


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 by Strassen's seven products; odd sides get a row or column of zeros.

    Only sums, differences and products are taken, so a result that fits 64 bits is exact whatever wraps on the way.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of two sets of vectors, one a row."""
    wide = max(a.shape[1], rows.shape[1])
    a, rows = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, rows))
    bound = float(wide) * np.abs(a, dtype=np.float64).max(initial=0) * np.abs(rows, dtype=np.float64).max(initial=0)
    if bound >= EXACT and (np.abs(a.astype(np.float64) @ rows.T.astype(np.float64)) >= EXACT / 2).any():
        raise ArithmeticError("a score has 56 bits or more")
    return product(a, np.ascontiguousarray(rows.T))


class Heaps:
    """The best `size` entries (score, vec_id, digest) of each of `count` keys; higher scores first, then smaller ids."""

    def __init__(self, count: int, size: int):
        self.held = np.zeros(count, np.int64)
        self.entries = np.zeros((count, size, 3), np.int64)
        self.worst = np.full(count, np.iinfo(np.int64).min)  # below it, a score can't enter

    def push(self, keys: np.ndarray, entries: np.ndarray) -> None:
        if not len(keys):
            return
        size = self.entries.shape[1]
        touched = np.unique(keys)
        old = np.arange(size) < self.held[touched, None]
        keys = np.concatenate([np.repeat(touched, self.held[touched]), keys])
        entries = np.concatenate([self.entries[touched][old], entries])
        order = np.lexsort((entries[:, 2], entries[:, 1], -entries[:, 0], keys))
        keys, entries = keys[order], entries[order]
        first = np.searchsorted(keys, touched)
        counts = np.diff(np.append(first, len(keys)))
        at = np.arange(len(keys)) - np.repeat(first, counts)
        best = at < size
        self.entries[keys[best], at[best]] = entries[best]
        self.held[touched] = np.minimum(counts, size)
        full = touched[counts >= size]
        self.worst[full] = self.entries[full, size - 1, 0]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and entry of everything held."""
        there = np.arange(self.entries.shape[1]) < self.held[:, None]
        return np.repeat(np.arange(len(self.held)), self.held), self.entries[there]


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of one side of a cell, at most `rows` long."""
    for batch in batches:
        side = batch["side"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, rows):
                yield batch.slice(at, min(rows, hi - at))


def _cell(batches: Iterator[pa.RecordBatch], size: int, low: int, high: int, windows: bool) -> Iterator[pa.RecordBatch]:
    """One cell: its anchors come first, then the rows stream by.

    Without windows the heaps hold rows of the anchor's label, else, for each of an anchor's positives, rows of
    other labels with scores in the positive's window.
    """
    anchors: list[pa.RecordBatch] = []
    heaps = slabs = None
    for tile in _tiles(batches, ROW_TILE):
        if tile["side"][0].as_py() == 0:
            anchors.append(tile)
            continue
        if heaps is None:
            if not anchors:
                return
            slabs, count = [], 0
            for t in _slabs(anchors):
                targets = _matrix(t["targets"]) if windows else None
                slabs.append((count, t["vec_id"].to_numpy(), t["digest"].to_numpy(), t["label"].to_numpy(), _matrix(t["q"]),
                              targets, np.diff(t["targets"].offsets.to_numpy()) if windows else None))
                count += len(t) * (targets.shape[1] if windows else 1)
            heaps = Heaps(count, size)
        ids, digests, labels, q = (tile["vec_id"].to_numpy(), tile["digest"].to_numpy(), tile["label"].to_numpy(), _matrix(tile["q"]))
        for first, a_ids, a_digests, a_labels, a_q, targets, held in slabs:
            s = scores(a_q, q)
            alike = a_labels[:, None] == labels
            for j in range(targets.shape[1] if windows else 1):
                keys = first + (np.arange(len(a_ids)) * targets.shape[1] + j if windows else np.arange(len(a_ids)))
                if windows:
                    target = targets[:, j, None]
                    may = ~alike & (low * target <= high * s) & (s <= target) & (j < held)[:, None]
                else:
                    may = alike & ((a_ids[:, None] != ids) | (a_digests[:, None] != digests))
                may &= s >= heaps.worst[keys][:, None]
                at, to = np.nonzero(may)
                heaps.push(keys[at], np.stack([s[at, to], ids[to], digests[to]], 1))
    if heaps is None:
        return
    keys, entries = heaps.rows()
    for first, a_ids, a_digests, _, _, targets, _ in slabs:
        each = targets.shape[1] if windows else 1
        lo, hi = np.searchsorted(keys, [first, first + each * len(a_ids)])
        own, e = keys[lo:hi] - first, entries[lo:hi]
        out = [a_ids[own // max(each, 1)], a_digests[own // max(each, 1)], (own % max(each, 1)).astype(np.int32), *e.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out], _FOUND)


def _slabs(anchors: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(anchors).combine_chunks()
    yield from (b.slice(0) for b in table.to_batches(max_chunksize=ANCHOR_TILE))


_FOUND = ["anchor", "anchor_digest", "at", "score", "vec_id", "digest"]
_FOUND_SCHEMA = "anchor bigint, anchor_digest bigint, at int, score bigint, vec_id bigint, digest bigint"


def quantized(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (int64 components) and a digest of the rows that take part, equal ones once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), q.alias("q")).dropDuplicates().withColumn(
        "digest", F.xxhash64("label", "q"))


def _run(rows: DataFrame, anchors: DataFrame, groups: int, parts: int, size: int, low: int, high: int, windows: bool) -> DataFrame:
    """Every anchor (vec_id, digest, label, q, targets) against every row, in a grid of groups and parts."""
    dealt = lambda salt, n: F.pmod(F.xxhash64("vec_id", "digest", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ("vec_id", "digest", "label", "q", "targets")
    left = anchors.select(*columns, F.lit(0).alias("side"), dealt(0, groups).alias("g"), all_of(parts).alias("p"))
    right = rows.select(*columns[:-1], F.array().cast("array<bigint>").alias("targets"), F.lit(1).alias("side"),
                        dealt(1, parts).alias("p"), all_of(groups).alias("g"))
    cells = left.unionByName(right).repartitionById(groups * parts, F.col("g") * parts + F.col("p"))
    found = arrow_map(cells.drop("g", "p").sortWithinPartitions("side"),
                      lambda it: _cell(it, size, low, high, windows), _FOUND_SCHEMA)
    best = Window.partitionBy("anchor", "anchor_digest", "at").orderBy(F.desc("score"), "vec_id", "digest")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, group_bytes: int = GROUP_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. For each anchor and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels with low * positive_score <= high * negative_score and no higher score.
    """
    spark = rows.sparkSession
    table = stored(quantized(rows, scale).withColumn("is_anchor", is_anchor), "vectors")
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("q")).alias("width")).first()
    width = max(size.width or 1, 2 * positives * (negatives + 1))
    groups = max(1, -(-size.anchors * 8 * width // group_bytes))
    parts = max(partitions(spark), -(-size.rows // part_rows))
    anchors = table.filter("is_anchor").withColumn("targets", F.array().cast("array<bigint>"))
    near = stored(_run(table, anchors, groups, parts, positives, low, high, windows=False).select(
        "anchor", "anchor_digest", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = near.groupBy(F.col("anchor").alias("vec_id"), F.col("anchor_digest").alias("digest")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("targets"))
    found = _run(table, table.filter("is_anchor").join(wanted, ["vec_id", "digest"]), groups, parts, negatives, low, high, windows=True)
    hard = found.select("anchor", "anchor_digest", (F.col("at") + 1).alias("positive"), F.col("rank"),
                        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near.withColumnRenamed("rank", "positive"), ["anchor", "anchor_digest", "positive"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
