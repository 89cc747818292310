"""Substring deduplication (operator 1): a compressed FM-index per shard of the corpus.

Shards are dealt out by content (the anchor of `repeats`), not by document, so that a repeated window meets its
other occurrences in one shard and each text is matched against the shards of its own windows only. Within a shard
the distinct segments are indexed: suffix array by prefix doubling, Burrows-Wheeler transform, and a wavelet matrix
of packed bits with a rank directory. The segments then stream through backward search, all windows of a block
together, one word a step; the step at which a window's interval has a single suffix left is its matching
statistic. Intervals that reach the threshold of `width` words are reported, and with them the earliest position.

Words are carried as 32-bit halves of their 64-bit hashes in the index; anchors and segments are compared by
independent 64-bit hashes.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null and empty texts have none and lose none; equal
windows of one document count, the earliest stays; of rows that repeat a doc_id with one text, all are treated
alike; with other texts, spans of either text that fit are removed; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, Unit, candidate_segments, covered_tokens, disjoint, runs_of, shards, word_tokens
from .scratch import partitions
from .shipping import arrow_map
from .textcodes import gather

WIDTH = 20
GRAM = 6
#: words of an index; a shard of more words is cut between anchors, and an anchor of more between windows
INDEX_WORDS = 1 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector with counts every 64 bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n, self.levels, self.zeros = len(symbols), [], []
        for k in reversed(range(self.bits)):
            b = (symbols >> k) & 1
            packed = np.packbits(b.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((packed, counts))
            self.zeros.append(len(b) - int(b.sum()))
            symbols = np.concatenate([symbols[b == 0], symbols[b == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, counts = self.levels[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def ranks(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi, counted from where the symbol's block begins."""
        base = np.zeros(len(symbols), np.int64)
        for level in range(self.bits):
            one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b, c = (self._ones(level, x) for x in (lo, hi, base))
            z = self.zeros[level]
            lo, hi, base = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b), np.where(one, z + c, base - c)
        return lo - base, hi - base


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the symbols must make all suffixes differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:max(0, n - k)] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Over segments of words, each ended by a separator of its own."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        pieces = len(lengths)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.vocabulary, dense = np.unique(words, return_inverse=True)
        text = np.empty(len(words) + pieces, np.int64)
        text[gather(self.starts, lengths)] = dense + pieces
        text[self.starts + lengths] = np.arange(pieces)
        self.order = suffix_array(text)
        sigma = len(self.vocabulary) + 1  # all separators are 0 in the transform: they are never searched for
        plain = np.maximum(text - pieces + 1, 0)
        self.text = plain
        self.before = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=sigma))])
        self.transform = WaveletMatrix(plain[self.order - 1], sigma)

    def matches(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the windows at `starts`: the matching statistic of each, as far as `width`, and the
        interval of suffixes of those that reach it with more than one occurrence."""
        n = len(starts)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.text), np.int64)
        matched = np.zeros(n, np.int32)
        live = np.arange(n)
        for step in range(1, width + 1):
            symbols = self.text[starts[live] + width - step]
            a, b = self.transform.ranks(symbols, lo[live], hi[live])
            base = self.before[symbols]
            lo[live], hi[live] = base + a, base + b
            live = live[b - a > 1]  # a single suffix is the window itself
            matched[live] = step
        return matched, lo, hi


def _report(codes: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int, block: int = 1 << 17):
    """Stretches (segment, first window, windows) of one shard that also stand earlier."""
    length = n + width - 1
    index = FMIndex(codes, length)
    owner = np.repeat(np.arange(len(n)), length + 1)  # segment of every text position
    rank_of = np.empty(len(n), np.int64)  # of the segments by position in the corpus
    rank_of[np.lexsort((start, doc))] = np.arange(len(n))
    # earliest first: by document, then by place in it
    d = doc[owner]
    place = start[owner].astype(np.int64) + np.arange(len(owner)) - index.starts[owner]
    position = np.empty(len(owner), np.int64)
    position[np.lexsort((place, d))] = np.arange(len(owner))
    by_suffix = position[index.order]
    windows = gather(index.starts, n)
    later = np.zeros(len(windows), bool)
    for k in range(0, len(windows), block):
        part = windows[k:k + block]
        matched, lo, hi = index.matches(part, width)
        full = np.flatnonzero(matched >= width)
        if not len(full):
            continue
        unique, which = np.unique(lo[full], return_inverse=True)
        ends = np.zeros(len(unique), np.int64)
        ends[which] = hi[full]
        edges = np.stack([unique, ends], 1).ravel()
        least = np.minimum.reduceat(np.append(by_suffix, np.iinfo(np.int64).max), edges)[::2]
        later[k + full] = least[which] < position[part[full]]
        same = later[k + full]  # windows at one position of repeated rows are not earlier than each other
        first = np.empty(len(position), np.int64)
        first[position] = np.arange(len(position))
        e, p = first[least[which]], part[full]
        later[k + full] = same & ((d[e] != d[p]) | (place[e] != place[p]))
    return runs_of(later, n)


def _index_shards(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, most, 4):
        n, doc, start = (shard[k].to_numpy().astype(np.int64) for k in ("n", "doc", "start"))
        tokens = shard["tokens"].combine_chunks()
        codes = np.frombuffer(b"".join(tokens.to_pylist()), np.uint32)
        seg, offset, count = _report(codes, n, doc, start, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[seg]), pa.array((start[seg] + offset).astype(np.int32)), pa.array(count.astype(np.int32))],
            ["doc", "start", "n"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, spans, kept, digests = [], [], [], [], []
        for text, removed in zip(batch["text"].to_pylist(), batch["removed"].to_pylist()):
            own = (text or "").encode().split()  # bytes.split() splits at the same six bytes
            cut = disjoint(removed, len(own))
            n_words.append(len(own))
            n_removed.append(sum(b - a for a, b in cut))
            for a, b in reversed(cut):
                del own[a:b]
            body = b" ".join(own)
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(body)
            digests.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
             pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc", "n_words", "n_removed", "removed", "kept_sha256", "kept"])


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, index_words: int = INDEX_WORDS) -> DataFrame:
    """Stretches (doc, start, n) of windows of `width` words that also start earlier."""
    spark = docs.sparkSession
    distinct, again = candidate_segments(docs, Unit(width, gram, word_tokens), 4, index_words)
    dealt = distinct.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    found = arrow_map(dealt.select("anchor", "n", "doc", "start", "tokens"),
                      lambda it: _index_shards(it, width, index_words), "doc bigint, start int, n int")
    return again.unionByName(found)


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans), kept_sha256, kept (the words that stay, joined by a space)."""
    marked = covered_tokens(docs, repeated_windows(docs, width, gram, index_words), width)
    out = arrow_map(marked.select("doc", "text", "removed"), _apply,
                    "doc bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, "
                    "kept_sha256 string, kept string")
    return out.withColumn("doc", F.nullif("doc", F.lit(NO_ID))).withColumnRenamed("doc", "doc_id")
