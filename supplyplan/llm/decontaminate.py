"""Benchmark decontamination (operator 2): a generalised suffix automaton of the test items.

The items' words build one automaton per shard of items; the tokens of every document stream through it while
the longest matching length is tracked. A match of at least `window` words covers item windows only, so the
words of the match are hit; an item of fewer words is one window of its own. Shards hold a bounded number of
item words each, so that an automaton of known size is sent to the executors whatever the table's size; with
more items there are more passes inside one narrow stage, never a join or a shuffle.

Before the automaton, a bitmap of the items' word pairs drops the words that cannot be part of a match; it has
no false negatives.

Defined results: null and empty texts have no words and no hits; items without words match nothing; an empty
table of items hits nothing; repeated items count once by item_id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored
from .shipping import arrow_map
from .textcodes import ALNUM, LOWER, blocks, mix, words

WINDOW = 13
SHARD_WORDS = 100_000
PIECE_WORDS = 20_000
_PAIR_BITS = 22
_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "lo", "hi")]))
_MATCHED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType()))])


class Automaton:
    """Generalised suffix automaton over word codes; `find` follows a document's words through it."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window, self.next, self.link, self.len = window, [{}], [-1], [0]
        for _, codes in items:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, codes in items:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i + 1 >= window:
                    v = self._of_length(v, window)
                    self.full.setdefault(v, set()).add(item)
            if 0 < len(codes) < window:
                self.short.setdefault(self._of_length(v, len(codes)), []).append((len(codes), item))
        self.least = min([window, *(m for found in self.short.values() for m, _ in found)])
        # nearest state, itself included, on the way up that ends a short item
        self.above = [-1] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.above[v] = v if v in self.short else self.above[self.link[v]]
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.singles = np.zeros(1 << 16, bool)
        for _, codes in items:
            a = np.array(codes, np.uint64)
            self.pairs[pair_slots(a)] = True
            self.singles[(a & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _of_length(self, v: int, n: int) -> int:
        """The state of the suffix of n words of what state v stands for."""
        while self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def find(self, codes: list[int], base: int, out: list[tuple[int, int]], items: set[str]) -> None:
        v = matched = 0
        nxt, link, length, window = self.next, self.link, self.len, self.window
        for i, c in enumerate(codes, base + 1):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c not in nxt[v]:
                matched = 0
                continue
            v = nxt[v][c]
            matched += 1
            if matched >= window:
                out.append((i - matched, i))
                items |= self.full[self._of_length(v, window)]
            u = self.above[v]
            while u != -1:
                for m, item in self.short[u]:
                    if m <= matched:
                        out.append((i - m, i))
                        items.add(item)
                u = self.above[link[u]] if link[u] > 0 else -1


def pair_slots(codes: np.ndarray) -> np.ndarray:
    pairs = mix(codes[:-1] * np.uint64(3) + codes[1:])
    return (pairs >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block_hits(automaton: Automaton, codes: np.ndarray, rows: np.ndarray) -> dict[int, tuple[list, set]]:
    """Spans (word indices in the block) and items of every row with a hit."""
    if not len(codes) or not automaton.full and not automaton.short:
        return {}
    linked = np.zeros(len(codes) + 1, bool)  # word i and its predecessor may stand together in an item
    linked[1:-1] = automaton.pairs[pair_slots(codes)]
    linked[rows] = False
    edges = np.flatnonzero(~linked)
    starts, ends = edges[:-1], edges[1:]
    keep = ends - starts >= automaton.least
    if automaton.least == 1:
        keep &= (ends - starts > 1) | automaton.singles[(codes[starts] & np.uint64(0xFFFF)).astype(np.int64)]
    found: dict[int, tuple[list, set]] = {}
    starts, ends = starts[keep], ends[keep]
    for a, b, row in zip(starts.tolist(), ends.tolist(), (np.searchsorted(rows, starts, "right") - 1).tolist()):
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        automaton.find(codes[a:b].tolist(), a, spans, items)
        if spans:
            had = found.setdefault(row, ([], set()))
            had[0].extend(spans)
            had[1].update(items)
    return found


def _match(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        schema = schema or pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
                                      ("spans", batch.schema.field("spans").type),
                                      ("items", pa.list_(pa.string()))])
        counts, spans, items = [], batch["spans"].to_pylist(), batch["items"].to_pylist()
        for lo, _, data, offs in blocks(batch["text"]):
            codes, starts, ends, rows = words(LOWER[data], offs, ALNUM)
            counts.append(np.diff(rows))
            for row, (own, ids) in _block_hits(automaton, codes, rows).items():
                first, at = int(rows[row]), int(offs[row])
                own = merged([(s["start"], s["end"]) for s in spans[lo + row]] + [(a - first, b - first) for a, b in own])
                spans[lo + row] = [{"start": a, "end": b, "lo": int(starts[first + a]) - at,
                                    "hi": int(ends[first + b - 1]) - at} for a, b in own]
                items[lo + row] = sorted({*items[lo + row], *ids})
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text"], pa.array(np.concatenate([np.zeros(0, np.int64), *counts])),
             pa.array(spans, schema.field("spans").type), pa.array(items, pa.list_(pa.string()))], schema=schema)


def _item_codes(batches: Iterator[pa.RecordBatch], window: int, piece: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch["item"].to_pylist(), []
        for lo, _, data, offs in blocks(batch["text"]):
            codes, _, _, rows = words(LOWER[data], offs, ALNUM)
            for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                # a long item is cut into pieces that overlap by a window less one word
                for at in range(a, max(b - window + 1, a + 1), piece) if b > a else ():
                    out.append((ids[lo + k], codes[at:min(b, at + piece + window - 1)].view(np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()),
                                          pa.array([c for _, c in out], pa.list_(pa.int64()))], ["item", "codes"])


def _automata(items: DataFrame, window: int, shard_words: int) -> Iterator[Automaton]:
    """One automaton for each shard of about `shard_words` item words, made on the driver one after the other."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    coded = stored(arrow_map(named, lambda it: _item_codes(it, window, PIECE_WORDS),
                             "item string, codes array<bigint>"), "item-codes")
    total = coded.agg(F.sum(F.size("codes"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    for k in range(shards):
        part = coded.filter(F.pmod(F.xxhash64("item", "codes"), F.lit(shards)) == k).distinct()
        yield Automaton(sorted((r.item, [c & (1 << 64) - 1 for c in r.codes]) for r in part.collect()), window)


def item_windows_hit(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                     shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans (disjoint; in words and in bytes), items (ids with occurring windows)."""
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("bigint"), "text", F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for automaton in _automata(items, window, shard_words):
        shared = spark.sparkContext.broadcast(automaton)
        out = arrow_map(out, lambda it, shared=shared: _match(it, shared.value), _MATCHED)
    return out


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage_parts: int = 20,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """`item_windows_hit` with n_hit and contaminated: at least 1/coverage_parts of the words are hit."""
    return item_windows_hit(docs, items, window, shard_words).withColumn("n_hit", n_hit()).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage_parts >= F.col("n_words")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for s in spans:
                    kept.append(raw[at:s["lo"]])
                    at = s["hi"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])


def remove_spans(matched: DataFrame, longest: int = 0, coverage_parts: int = 20) -> DataFrame:
    """doc_id and text without the spans of more than `longest` words, or all spans where coverage is over its limit."""
    over = n_hit() * coverage_parts >= F.col("n_words")
    doomed = F.when(over, F.col("spans")).otherwise(F.filter("spans", lambda s: s["end"] - s["start"] > longest))
    return arrow_map(matched.select("doc_id", "text", doomed.alias("spans")), _cut, "doc_id bigint, text string")


def _clean(batches: Iterator[pa.RecordBatch], automata: list, coverage_parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stays = []
        for _, _, data, offs in blocks(batch["text"]):
            codes, _, _, rows = words(LOWER[data], offs, ALNUM)
            hit = np.zeros(len(codes), bool)
            for shared in automata:
                for row, (spans, _) in _block_hits(shared.value, codes, rows).items():
                    for a, b in spans:
                        hit[a:b] = True
            sums = np.concatenate([[0], np.cumsum(hit)])[rows]
            n = np.diff(sums)
            stays.append((n == 0) | (coverage_parts * n < np.diff(rows)))
        yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *stays])))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage_parts: int = 20,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, with all their columns and unchanged, that aren't contaminated."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(a) for a in _automata(items, window, shard_words)]
    return arrow_map(docs, lambda it: _clean(it, shared, coverage_parts), docs.schema)
