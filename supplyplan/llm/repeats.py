"""Finding candidate repeats of fixed-length windows: the part that substring and suffix-array dedup share.

A window of `width` tokens is known by the smallest hash among its runs of `gram` tokens, its anchor. Equal
windows have equal anchors in equal places, so windows can be dealt out by anchor, and no two windows that share the
very place of an anchor are equal. Consecutive windows with one anchor place make a segment. Where an anchor occurs once, none of its windows repeats and no token of it is moved any further.

Hot passages: equal segments of a block of texts collapse to the earliest before any shuffle by content, so a passage
that a third of all documents hold is one row per block of text there; rows of an anchor stream by in sorted order,
with one held back, so that none of them has to fit into memory. Tokens are fetched only for segments that differ
under one anchor, once for each content. Where those are more than a task may index or sort at once, their windows are
dealt out once more by a hash of the whole window. Positions are (doc_id, start); rows that repeat a doc_id are one document to this order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, stored
from .shipping import arrow_map
from .textcodes import (
    NOT_SPACE, blocks, fixed_hash, gather, mix, prefix, run_hash, signed, sliding_min, words,
)

#: stands for a null doc_id inside the operators
NO_ID = -(1 << 63)


class Tokens(NamedTuple):
    codes: np.ndarray      # one per token
    rows: np.ndarray       # index of each row's first token
    sums: np.ndarray       # prefix hashes


class Unit(NamedTuple):
    """How texts are cut into tokens, and the windows looked for."""

    width: int
    gram: int
    read: Callable[[np.ndarray, np.ndarray], Tokens]


def word_tokens(data: np.ndarray, offs: np.ndarray) -> Tokens:
    codes, _, _, rows = words(data, offs, NOT_SPACE)
    return Tokens(codes, rows, prefix(codes))


def byte_tokens(data: np.ndarray, offs: np.ndarray) -> Tokens:
    return Tokens(data, offs, prefix(data))


def segments(tokens: Tokens, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, row, start in the block, number of windows of each segment."""
    grams = fixed_hash(tokens.sums, unit.gram)
    low = np.uint64((1 << len(grams).bit_length()) - 1)
    ranked = grams & ~low
    ranked |= np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first counts
    anchors = sliding_min(ranked, unit.width - unit.gram + 1)
    n = len(anchors)
    whole = np.zeros(n + 1, np.int32)  # windows that lie in one row
    lo, hi = tokens.rows[:-1], tokens.rows[1:] - unit.width + 1
    some = hi > lo
    np.add.at(whole, lo[some], 1)
    np.add.at(whole, np.minimum(hi[some], n), -1)
    inside = np.cumsum(whole)[:n] > 0
    opens = inside.copy()
    opens[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    firsts = tokens.rows[:-1][some]
    opens[firsts] = True
    starts = np.flatnonzero(opens)
    closed = np.flatnonzero(opens | ~inside)
    ends = np.append(closed, n)[np.searchsorted(closed, starts, "right")]
    row = np.searchsorted(tokens.rows, starts, "right") - 1
    return grams[(anchors[starts] & low).astype(np.int64)], row, starts, ends - starts


def _earliest(anchor: np.ndarray, seg: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the earliest of the segments with equal content, and for repeats of its row."""
    order = np.lexsort((start, doc, seg, anchor))
    a, s, d, p = anchor[order], seg[order], doc[order], start[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    first |= (d == d[head]) & (p == p[head])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """(anchor, seg, doc, at): segments, `at` holding start and number of windows. A segment that repeats an earlier
    one of its block has the complement of that, and goes wherever its document's hash sends it."""
    for batch in batches:
        ids = batch["doc"].to_numpy()
        for lo, _, data, offs in blocks(batch["text"]):
            t = unit.read(data, offs)
            anchor, row, start, n = segments(t, unit)
            if not len(anchor):
                continue
            doc, own = ids[lo + row], start - t.rows[row]
            seg = run_hash(t.sums, start, start + n + unit.width - 1)
            first = _earliest(anchor, seg, doc, own)
            away = mix(doc.astype(np.uint64) + np.uint64(1))
            at = own << 16 | n
            yield pa.RecordBatch.from_arrays(
                [signed(np.where(first, anchor, away)), signed(np.where(first, seg, np.uint64(0))), pa.array(doc),
                 pa.array(np.where(first, at, ~at))], ["anchor", "seg", "doc", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, content and position: the later ones of equal segments, as surely repeated, and the
    first ones of those whose anchor has other segments too, as wanted. One row is held back between batches."""
    last: tuple[int, ...] | None = None  # the last segment
    held: tuple[int, int, int] | None = None  # the last first one, unless it was passed on
    anchor_before: int | None = None
    for batch in batches:
        anchor, seg, doc, at = (batch[k].to_numpy() for k in ("anchor", "seg", "doc", "at"))
        marked = at < 0
        own = np.flatnonzero(~marked)
        repeated, wanted = marked.copy(), np.zeros(len(at), bool)
        extra: list[tuple[int, int, int]] = []
        if len(own):
            a, s, d, p = (x[own] for x in (anchor, seg, doc, at))
            new, other = np.ones(len(own), bool), np.ones(len(own), bool)
            new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            other[1:] = new[1:] | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            if last is not None:
                new[0] = (int(a[0]), int(s[0])) != last[:2]
                other[0] = (int(a[0]), int(s[0]), int(d[0]), int(p[0])) != last
            repeated[own[~new & other]] = True
            last = int(a[-1]), int(s[-1]), int(d[-1]), int(p[-1])
            f = own[new]
            if len(f):
                like = np.zeros(len(f), bool)
                like[1:] = anchor[f[1:]] == anchor[f[:-1]]
                like[0] = anchor_before is not None and int(anchor[f[0]]) == anchor_before
                if like[0] and held is not None:
                    extra.append(held)
                keep = like.copy()
                keep[:-1] |= like[1:]
                wanted[f[keep]] = True
                anchor_before = int(anchor[f[-1]])
                held = None if keep[-1] else (anchor_before, int(doc[f[-1]]), int(at[f[-1]]))
        out = np.flatnonzero(repeated | wanted)
        at = np.where(at < 0, ~at, at)[out]
        anchor, doc, want = anchor[out], doc[out], wanted[out]
        if extra:
            anchor, doc, at = (np.append(x, e) for x, e in zip((anchor, doc, at), extra[0]))
            want = np.append(want, True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(doc), pa.array((at >> 16).astype(np.int32)),
             pa.array((at & 0xFFFF).astype(np.int32)), pa.array(want)], ["anchor", "doc", "start", "n", "want"])


def _wanted_in(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple]:
    """Of each block of texts its tokens, and of the wanted segments document, start in the document, anchor, key and
    number of windows, and the start in the block."""
    ids = batch["doc"].to_numpy()
    lists = batch["wanted"]
    counts = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "start", "n", "key")]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi, data, offs in blocks(batch["text"]):
        t = unit.read(data, offs)
        row = np.repeat(np.arange(hi - lo), counts[lo:hi])
        anchor, own, n, key = (x[bounds[lo]:bounds[hi]] for x in fields)
        own, n = own.astype(np.int64), n.astype(np.int64)
        fits = own + n + unit.width - 1 <= np.diff(t.rows)[row]  # a doc_id may come with other texts
        row, own, anchor, key, n = (x[fits] for x in (row, own, anchor, key, n))
        yield t, ids[lo + row], own, anchor.view(np.uint64), key, n, own + t.rows[row]


def _payload(batches: Iterator[pa.RecordBatch], unit: Unit, width_bytes: int) -> Iterator[pa.RecordBatch]:
    """The tokens of the wanted segments of each text, under their keys."""
    for batch in batches:
        for t, doc, own, anchor, key, n, start in _wanted_in(batch, unit):
            length = n + unit.width - 1
            taken = t.codes[gather(start, length)]
            taken = taken if width_bytes == 1 else (taken >> np.uint64(32)).astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum(length * width_bytes)]).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(taken.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(doc), pa.array(own.astype(np.int32)), pa.array(n.astype(np.int32)),
                 pa.array(_places(t.sums, unit, anchor, start, n)), tokens],
                ["anchor", "doc", "start", "n", "place", "tokens"])


def _window_rows(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted segments of each text; the key is the hash of anchor and window."""
    for batch in batches:
        for t, doc, own, anchor, _, n, start in _wanted_in(batch, unit):
            at = gather(start, n)
            anchor = np.repeat(anchor, n)
            key = mix(run_hash(t.sums, at, at + unit.width) ^ mix(anchor))
            yield pa.RecordBatch.from_arrays(
                [signed(anchor), signed(key), pa.array(np.repeat(doc, n)), pa.array((at - np.repeat(start - own, n)).astype(np.int32))],
                ["anchor", "key", "doc", "start"])


def _places(sums: np.ndarray, unit: Unit, anchor: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where in its segment the anchor stands: the first run of that hash that its last window holds."""
    reach = unit.width - unit.gram + 2 - n
    at = gather(start + n - 1, reach)
    found = np.where(fixed_hash(sums, unit.gram)[at] == np.repeat(anchor, reach), at, np.iinfo(np.int64).max)
    if not len(found):
        return np.zeros(0, np.int32)
    return (np.minimum.reduceat(found, np.cumsum(reach) - reach) - start).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), "text")


def _dealt_windows(texts: DataFrame, wanted: DataFrame, unit: Unit, most: int) -> DataFrame:
    """The windows of wanted segments as segments of their own (doc, anchor, start, n, key), without those that stand
    once. Equal windows have one key; where they are more than half of `most` tokens, several, each with the earliest of all."""
    rows = arrow_map(texts.join(_by_document(wanted), "doc").select("doc", "text", "wanted"), lambda it: _window_rows(it, unit),
                     "anchor bigint, key bigint, doc bigint, start int")
    windows = stored(rows.distinct(), "windows")
    keys = windows.groupBy("key").agg(
        F.min(F.struct("doc", "start")).alias("first"),
        F.ceil(F.count(F.lit(1)) / F.lit(max(1, most // unit.width // 2))).cast("int").alias("parts"),
        F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    part = F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int")
    return windows.join(keys, "key").withColumn(
        "part", F.explode(F.when(F.struct("doc", "start") == F.col("first"), every).otherwise(F.array(part)))).select(
        "doc", "anchor", "start", F.lit(1).alias("n"),
        F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"))


def _by_document(wanted: DataFrame) -> DataFrame:
    return wanted.groupBy("doc").agg(F.collect_set(F.struct("anchor", "start", "n", "key")).alias("wanted"))


def candidate_segments(docs: DataFrame, unit: Unit, width_bytes: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Segments that may hold windows of others (anchor, doc, start, n, place of the anchor, tokens), the earliest of
    equal ones for all, and the stretches (doc, start, n) of windows that surely repeat an earlier segment.

    Where the segments of an anchor have more than `most` tokens, as over the edge of a passage that many documents
    hold, its windows come instead, and the anchor is a hash of the window."""
    texts = keyed(docs)
    rows = arrow_map(texts, lambda it: _anchor_rows(it, unit), "anchor bigint, seg bigint, doc bigint, at bigint")
    dealt = rows.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "seg", "doc", "at")
    repeated = stored(arrow_map(dealt, _repeated, "anchor bigint, doc bigint, start int, n int, want boolean"), "repeated")
    wanted = repeated.filter("want").select("doc", "anchor", "start", "n", F.col("anchor").alias("key"))
    heavy = stored(wanted.groupBy("anchor").agg(F.sum(F.col("n") + F.lit(unit.width - 1)).alias("size")).filter(
        F.col("size") > most).select("anchor"), "heavy-anchors")
    if not heavy.isEmpty():
        wanted = wanted.join(heavy, "anchor", "left_anti").select("doc", "anchor", "start", "n", "key").unionByName(
            _dealt_windows(texts, wanted.join(heavy, "anchor", "left_semi"), unit, most))
    fetched = arrow_map(texts.join(_by_document(wanted), "doc").select("doc", "text", "wanted"),
                        lambda it: _payload(it, unit, width_bytes),
                        "anchor bigint, doc bigint, start int, n int, place int, tokens binary")
    return stored(fetched, "segments"), repeated.filter("not want").select("doc", "start", "n")


def covered_tokens(docs: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """doc, text and `removed`: the token spans (array of start, end) that the windows of the stretches cover."""
    spans = stretches.groupBy("doc").agg(
        F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end"))).alias("removed"))
    return keyed(docs).join(spans, "doc", "left")


def shards(batches: Iterator[pa.RecordBatch], most: int, width_bytes: int) -> Iterator[pa.Table]:
    """Segments that come with all of an anchor together, in tables cut between anchors at about `most` tokens;
    anchors with one distinct segment are left out, for nothing repeats there."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch["tokens"].nbytes // width_bytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table["anchor"].to_numpy()
        others = np.flatnonzero(anchors != anchors[-1])  # the last anchor may go on
        if len(others):
            yield from _several(table.slice(0, others[-1] + 1))
            table = table.slice(others[-1] + 1).combine_chunks()
        held = table.to_batches()
        size = sum(b["tokens"].nbytes for b in held) // width_bytes
        limit = max(most, 2 * size)
    if held:
        yield from _several(pa.Table.from_batches(held))


def _several(table: pa.Table) -> Iterator[pa.Table]:
    anchors = table["anchor"].to_numpy()
    several = np.zeros(len(anchors), bool)
    several[1:] = anchors[1:] == anchors[:-1]
    several[:-1] |= several[1:]
    if several.any():
        yield table.filter(pa.array(several)).combine_chunks()


def runs_of(later: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first window and number of windows of the runs of True among the windows of segments of n windows."""
    seg = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    opens, closes = later.copy(), later.copy()
    opens[1:] &= ~later[:-1] | (seg[1:] != seg[:-1])
    closes[:-1] &= ~later[1:] | (seg[1:] != seg[:-1])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    return seg[a], offset[a], b - a + 1


def disjoint(removed: list[dict] | None, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], n)) for s in removed or ()):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
