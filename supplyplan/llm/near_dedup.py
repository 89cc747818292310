"""Near-duplicate documents (operator 10): Order MinHash, verified by banded alignment.

A document is the sequence of its shingles of five words, labelled by their occurrence; the first occurrences stand for
it, so that a phrase said two hundred times doesn't outweigh all the rest. For each of many hash functions, the sketch
takes the few smallest of them and keeps them in text order, so that equal sketches speak for a small edit distance
and not only for common shingles. Documents that share a sketch are candidates, and so are documents that share the
chosen shingles of one in another order, for their passages may have moved.

A candidate pair is a link if its similarity is 0.8 or more: by banded alignment, aligned shingles over shingles in
either, found bit-parallel within the band outside which 0.8 can't be reached; where passages have moved, by the exact
Jaccard similarity of the sets, which no alignment exceeds.

Documents with equal word sequences count once, and nothing emits all pairs of a group: see `grouping`.

Words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Defined results: a document of fewer than five words is one
shingle; null, empty and wordless texts are a class of their own each, by doc_id; of a class the smallest doc_id stays;
rows that repeat a doc_id stay or go together; a null doc_id ranks first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .grouping import links_in_buckets
from .repeats import NO_ID, keyed
from .scratch import stored
from .shipping import arrow_map
from .textcodes import ALNUM, LOWER, blocks, gather, mix, prefix, run_hash, signed, words

SHINGLE = 5
SIMILARITY = 0.8
#: at Jaccard 0.8, about 0.8 ** 4 of the samples agree, in whatever order; all 24 differ for 3 of a million pairs
SKETCHES, TAKEN = 24, 4
#: of few shingles fewer samples agree (a fifth, for 4 of 5), so that texts of at most FEW shingles have more
FEW, FEW_SKETCHES = 32, 64
#: a column that no table of documents has
_ID = "__near_dedup_id"


def shingles(codes: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a block of texts, and the index of each row's first."""
    n = np.diff(rows)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    starts = rows[row] + np.arange(at[-1]) - at[row]
    return run_hash(prefix(codes), starts, np.minimum(starts + size, rows[row + 1])), at


def first_occurrences(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles whose occurrence label is one, in text order, and the index of each row's first."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))  # stable: of equal shingles the first in the text comes first
    h, r = hashes[order], row[order]
    opens = np.ones(len(h), bool)
    opens[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    keep = np.sort(order[opens])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(at) - 1))])


def order_sketches(hashes: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN,
                   first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash of every row that has shingles, and the hash of the same shingles without their order: two times
    (rows, sketches), by the hash functions from `first` on."""
    full = np.flatnonzero(np.diff(at) > 0)
    orders, sets = (np.zeros((len(full), sketches), np.uint64) for _ in range(2))
    if not len(full):
        return orders, sets
    begins, counts = at[:-1][full], np.diff(at)[full]
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    index = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << int(len(hashes)).bit_length()) - 1)
    padded = np.append(hashes, np.uint64(0))
    for j in range(first, first + sketches):
        ranked = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        ranked ^= ranked >> np.uint64(32)
        ranked *= np.uint64(0xD6E8FEB86659FD93)
        ranked = (ranked & ~low) | index  # the position rides along
        places = np.full((len(full), taken), len(hashes), np.int64)
        for k in range(taken):
            least = np.minimum.reduceat(ranked, begins)
            on = counts > k
            places[on, k] = (least[on] & low).astype(np.int64)
            ranked[places[on, k]] = last
        places.sort(1)  # text order
        chosen = padded[places]
        for out, own, salt in ((orders, chosen, 1), (sets, np.sort(chosen, 1), 1 << 32)):
            acc = np.full(len(full), j + salt, np.uint64)
            for k in range(taken):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
            out[:, j - first] = acc
    return orders, sets


def all_sketches(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches with and without order of all rows, row by row, and the index of each row's first."""
    n = np.diff(at)
    few = np.flatnonzero((n > 0) & (n <= FEW))
    counts = np.where(n > 0, SKETCHES, 0)
    counts[few] = FEW_SKETCHES
    bounds = np.concatenate([[0], np.cumsum(counts)])
    full = bounds[:-1][n > 0]
    more = order_sketches(hashes[gather(at[few], n[few])], np.concatenate([[0], np.cumsum(n[few])]),
                          FEW_SKETCHES - SKETCHES, first=SKETCHES)
    out = []
    for common, extra in zip(order_sketches(hashes, at), more):
        flat = np.empty(bounds[-1], np.uint64)
        flat[full[:, None] + np.arange(SKETCHES)] = common
        flat[bounds[few][:, None] + np.arange(SKETCHES, FEW_SKETCHES)] = extra
        out.append(flat)
    return out[0], out[1], bounds


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch["text"]):
            codes, _, _, rows = words(LOWER[data], offs, ALNUM)
            one, two = prefix(codes), prefix(mix(codes ^ np.uint64(0x5851F42D4C957F2D)))
            a, b = run_hash(one, rows[:-1], rows[1:]), run_hash(two, rows[:-1], rows[1:])
            hashes, at = first_occurrences(*shingles(codes, rows))
            *keys, bounds = all_sketches(hashes, at)
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), signed(k)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].slice(lo, hi - lo), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array(np.diff(at).astype(np.int32)), *lists], ["doc", "h1", "h2", "n", "orders", "sets"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch["text"]):
            codes, _, _, rows = words(LOWER[data], offs, ALNUM)
            hashes, at = first_occurrences(*shingles(codes, rows))
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].slice(lo, hi - lo), pa.Array.from_buffers(
                    pa.binary(), hi - lo, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(short.tobytes())])],
                ["doc", "shingles"])


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over shingles in either, by longest common subsequence within the band that `least` allows.

    Common ends are cut off; the rest is a bit-parallel scan, a bit for every place of b, over the rows of a."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    k = min(n, m)
    same = a[:k] == b[:k]
    head = k if same.all() else int(np.argmin(same))
    tail_same = a[n - k + head:][::-1] == b[m - k + head:][::-1]
    tail = len(tail_same) if tail_same.all() else int(np.argmin(tail_same))
    x, y = a[head:n - tail].tolist(), b[head:m - tail].tolist()
    # with s shingles aligned, s / (n + m - s) >= least asks for s >= least (n + m) / (1 + least): no row leaves its
    # diagonal by more than the shingles that may stay unaligned
    band = int(n + m - 2 * least * (n + m) / (1 + least)) + 1
    places: dict[int, int] = {}
    for p, h in enumerate(y):
        places[h] = places.get(h, 0) | 1 << p
    every = (1 << len(y)) - 1
    v = every
    for i, h in enumerate(x):
        match = places.get(h, 0)
        if match:
            lo, hi = max(0, i - band), i + band + 1
            match = match >> lo << lo & (1 << hi) - 1
            u = v & match
            v = ((v + u) | (v - u)) & every
    common = head + tail + len(y) - v.bit_count()
    return common / (n + m - common)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The aligned similarity if it reaches `least`, else the Jaccard similarity."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b))
    jaccard = common / (len(a) + len(b) - common)
    if jaccard < least:  # no alignment has more
        return jaccard
    found = aligned(a, b, least)
    return found if found >= least else jaccard


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, found = batch["a_shingles"].to_pylist(), batch["b_shingles"].to_pylist(), []
        for x, y in zip(a, b):
            found.append(similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least))
        keep = np.array(found) >= least if found else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep)),
                                          pa.array(np.array(found, float)[keep])], ["a", "b", "similarity"])


def _verify_block(payloads: list[bytes], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs are links."""
    own = [np.frombuffer(x, np.uint32) for x in payloads]
    return np.array([similarity(own[a], own[b], least) >= least for a, b in zip(left.tolist(), right.tolist())], bool)


def verified(pairs: DataFrame, store: DataFrame, least: float) -> DataFrame:
    """The links among pairs (a, b)."""
    first = store.select(F.col("doc").alias("a"), F.col("shingles").alias("a_shingles"))
    second = store.select(F.col("doc").alias("b"), F.col("shingles").alias("b_shingles"))
    both = pairs.join(second, "b").join(first, "a")
    return arrow_map(both.select("a", "b", "a_shingles", "b_shingles"), lambda it: _verify(it, least),
                     "a bigint, b bigint, similarity double")


def _close(x, y, least: float):
    """Whether numbers of shingles (columns or arrays) allow the similarity."""
    return (x >= least * y) & (y >= least * x)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc, class_id and rep (the smallest doc of equal word sequences) of every row, and the
    verified links (a, b) between representatives, which span the classes but aren't all links within them."""
    texts = keyed(docs)
    sketched = stored(arrow_map(texts, _sketch_rows, "doc bigint, h1 bigint, h2 bigint, n int, orders array<bigint>, sets array<bigint>"), "sketches")
    worded = sketched.filter("n > 0")
    reps = stored(worded.groupBy("h1", "h2").agg(F.min(F.struct("doc", "n", "orders", "sets")).alias("r"))
                  .select("h1", "h2", F.col("r.doc").alias("rep"), "r.n", "r.orders", "r.sets"), "representatives")
    samples = reps.select("rep", "n", F.explode(F.arrays_zip("orders", "sets")).alias("s")).select(
        "rep", "n", F.col("s.orders").alias("order"), F.col("s.sets").alias("set"))
    shared = samples.groupBy("set").agg(
        F.min("rep").alias("lo"), F.max("rep").alias("hi"), (F.min("order") != F.max("order")).alias("moved")).filter(
        "lo <> hi").select("set", "moved")
    # the order's bucket lies within that of the same shingles without order, and is the same unless passages moved
    members = stored(samples.join(shared, "set").select("rep", "n", F.explode(
        F.when(F.col("moved"), F.array("order", "set")).otherwise(F.array("order"))).alias("bucket")), "members")
    wanted = members.select(F.col("rep").alias("doc")).distinct()
    store = stored(arrow_map(texts.join(wanted, "doc").select("doc", "text"), _shingle_rows, "doc bigint, shingles binary"), "shingles")
    links = links_in_buckets(
        members, store.select(F.col("doc").alias("rep"), F.col("shingles").alias("payload")),
        lambda pairs: verified(pairs, store, least).select("a", "b"),
        lambda payloads, left, right: _verify_block(payloads, left, right, least), lambda x, y: _close(x, y, least))
    labels = components(links).withColumnRenamed("node", "rep")
    classes = sketched.join(reps.select("h1", "h2", "rep"), ["h1", "h2"], "left").withColumn(
        "rep", F.coalesce("rep", "doc")).join(labels, "rep", "left").select(
        "doc", F.coalesce("label", "rep").alias("class_id"), "rep")
    return classes, links


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), rep_id (smallest doc_id with the same words), kept."""
    classes, _ = near_duplicates(docs, least)
    out = classes.select(*(F.nullif(c, F.lit(NO_ID)).alias(name) for c, name in (
        ("doc", "doc_id"), ("class_id", "class_id"), ("rep", "rep_id"))))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, of which one of each class stays."""
    classes, _ = near_duplicates(docs, least)
    gone = classes.filter(F.col("doc") != F.col("class_id")).select(F.col("doc").alias(_ID)).distinct()
    return docs.withColumn(_ID, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).join(
        gone, _ID, "left_anti").select(*docs.columns)
