"""Suffix-array deduplication (operator 8): sampled suffixes in sampled ranges, sorted bucket by bucket.

Suffixes are sampled by content (the anchors of `repeats`), so every window of `width` bytes has one in it.
Spark's sampled splitters deal the segments out by the leading bytes of the anchor's suffix, which keeps all
windows that may be equal within one range: equal leading bytes are never split, so that what lies on either side
of a boundary differs, and comparing neighbours across it finds nothing more. Only where one such range is more than a
bucket may hold do splitters cut it by window hash, so that equal windows still meet. A bucket then sorts the suffixes of
its segments by multikey quicksort, eight bytes at a time, within the ties of the bytes before; ties that last
`width` bytes are equal windows, and all but the earliest of them are marked.

Defined results: texts are UTF-8 bytes, null and empty ones have none; overlapping windows of one document count;
of rows that repeat a doc_id with one text, all are treated alike; extra columns are ignored; an empty table gives
no rows. The bytes that stay need not be valid UTF-8, so they are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, Unit, byte_tokens, candidate_segments, covered_tokens, disjoint, runs_of, shards
from .scratch import partitions
from .shipping import arrow_map
from .textcodes import gather

WIDTH = 100
GRAM = 32
#: bytes of segments that a bucket sorts at once; cut between anchors, and an anchor of more between windows
BUCKET_BYTES = 1 << 21


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j:j + len(data)]
    return out


def equal_suffixes(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at `starts`, as deep as `width` bytes: the indices of those that tie with
    another, in suffix order, and the number of the tie of each."""
    at_eight = eights(data)
    order = np.arange(len(starts))
    tie = np.zeros(len(starts), np.int64)
    for depth in range(0, width, 8):
        key = at_eight[starts[order] + depth]
        if width - depth < 8:
            key = key >> np.uint64(8 * (8 - width + depth))
        by = np.lexsort((key, tie)) if depth else np.argsort(key, kind="quicksort")
        order, tie, key = order[by], tie[by], key[by]
        opens = np.ones(len(order), bool)
        opens[1:] = (tie[1:] != tie[:-1]) | (key[1:] != key[:-1])
        alone = opens.copy()
        alone[:-1] &= opens[1:]
        tie = np.cumsum(opens)
        order, tie = order[~alone], tie[~alone]
        if not len(order):
            break
    return order, tie


def _later(data: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """For every window of every segment, whether an equal one stands earlier."""
    begins = np.cumsum(n + width - 1) - (n + width - 1)
    windows = gather(begins, n)
    order, tie = equal_suffixes(data, windows, width)
    out = np.zeros(len(windows), bool)
    if len(order):
        seg = np.repeat(np.arange(len(n)), n)[order]
        d, place = doc[seg], start[seg] + windows[order] - begins[seg]
        by = np.lexsort((place, d, tie))
        order, tie, d, place = order[by], tie[by], d[by], place[by]
        opens = np.ones(len(order), bool)
        opens[1:] = tie[1:] != tie[:-1]
        first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        out[order] = (d != d[first]) | (place != place[first])
    return out


def _sort_buckets(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    for bucket in shards(batches, most, 1):
        n, doc, start = (bucket[k].to_numpy().astype(np.int64) for k in ("n", "doc", "start"))
        data = np.frombuffer(b"".join(bucket["tokens"].to_pylist()), np.uint8)
        seg, offset, count = runs_of(_later(data, n, doc, start, width), n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[seg]), pa.array((start[seg] + offset).astype(np.int32)), pa.array(count.astype(np.int32))],
            ["doc", "start", "n"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, spans, kept, digests = [], [], [], [], []
        for body, removed in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["removed"].to_pylist()):
            body = body or b""
            cut = disjoint(removed, len(body))
            n_bytes.append(len(body))
            n_removed.append(sum(b - a for a, b in cut))
            spans.append([{"start": a, "end": b} for a, b in cut])
            if cut:
                body = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(body)]))
            kept.append(body)
            digests.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
             pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
            ["doc", "n_bytes", "n_removed", "removed", "kept_sha256", "kept"])


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Stretches (doc, start, n) of windows of `width` bytes that also start earlier."""
    distinct, again = candidate_segments(docs, Unit(width, gram, byte_tokens), 1, bucket_bytes)
    leading = distinct.select("anchor", "n", "doc", "start", "tokens",
                              F.expr(f"substring(tokens, place + 1, {gram})").alias("lead"))
    ranges = leading.repartitionByRange(partitions(docs.sparkSession), "lead", "anchor").sortWithinPartitions("lead", "anchor")
    found = arrow_map(ranges, lambda it: _sort_buckets(it, width, bucket_bytes), "doc bigint, start int, n int")
    return again.unionByName(found)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal byte spans), kept_sha256, kept (the bytes that stay)."""
    marked = covered_tokens(docs, repeated_windows(docs, width, gram, bucket_bytes), width)
    out = arrow_map(marked.select("doc", "text", "removed"), _apply,
                    "doc bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:int,end:int>>, "
                    "kept_sha256 string, kept binary")
    return out.withColumn("doc", F.nullif("doc", F.lit(NO_ID))).withColumnRenamed("doc", "doc_id")
