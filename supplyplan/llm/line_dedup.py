"""Line deduplication (operator 5): a segment-partition edit join.

Lines within `threshold` edits (of bytes) share one of threshold + 1 equal segments at nearly its place. Each distinct
line enters an index by its length, the segment's number and the segment's hash, and probes the entries of its own and
of slightly smaller lengths with the substrings that the multi-match-aware selection allows. Lines that meet in an
entry are candidates; pairs are verified by bit-parallel edit distance within the band of the threshold. Lines that
are linked, over other lines too, are one class, of which the first (smallest doc_id, then line) stays.

Equal lines count once before the join. Lines shorter than `shortest` bytes are compared for equality alone, for a few
edits make any of them any other. Blank lines are never removed.

Defined results: lines end at line feeds; null and empty texts have no lines; a text that repeats its own lines keeps
the first; rows that repeat a doc_id with one text keep or lose the same lines, and other texts under one doc_id are
told apart by nothing but their lines' numbers; a null doc_id ranks first; an empty table gives no rows; extra columns
are ignored. Lines are known by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .grouping import counted_links, links_in_buckets
from .repeats import NO_ID, keyed
from .scratch import partitions, stored
from .shipping import arrow_map
from .textcodes import blocks, mix, prefix, run_hash, spans

THRESHOLD = 2
SHORTEST = 32
#: columns that no table of documents has
_ID, _GONE = "__line_dedup_id", "__line_dedup_gone"
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True
_INK = ~_BLANK & _LINE
#: codes of bytes for the second hash
_OTHER = mix(np.arange(256, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _lines(data: np.ndarray, offs: np.ndarray):
    """Starts and ends of the lines that aren't blank, their row and their number among all lines of the row."""
    starts, ends, rows = spans(data, offs, _LINE)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    feeds = np.flatnonzero(data == 0x0A)
    number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offs)[row]
    # up to the next line there are line feeds only
    full = np.logical_or.reduceat(_INK[data], starts) if len(starts) else np.zeros(0, bool)
    return starts[full], ends[full], row[full], number[full]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc"].to_numpy()
        for lo, _, data, offs in blocks(batch["text"]):
            starts, ends, row, number = _lines(data, offs)
            one, two = run_hash(prefix(data), starts, ends), run_hash(prefix(_OTHER[data]), starts, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo + row]), pa.array(number.astype(np.int32)), pa.array(one.view(np.int64)),
                 pa.array(two.view(np.int64)), pa.array((ends - starts).astype(np.int32))], ["doc", "line", "h1", "h2", "n"])


def entries(n: np.ndarray, threshold: int, shortest: int):
    """Index entries and probes of lines of n bytes, a part for every shift: (lines, length probed, segment, start, size).

    The threshold + 1 segments of a line are equal, the last ones a byte longer where they must be. A line probes for
    lines of its own length, which are its own index entries too where the substring doesn't move, and for lines up
    to `threshold` bytes shorter, at the places that the multi-match-aware selection leaves.
    """
    parts = threshold + 1
    for shorter in range(parts):
        m = n - shorter
        base, rest = m // parts, m % parts
        for i in range(parts):
            at = i * base + np.maximum(0, i - (parts - rest))
            size = base + (i >= parts - rest)
            for move in range(max(-i, shorter - threshold + i), min(i, shorter + threshold - i) + 1):
                p = at + move
                ok = np.flatnonzero((m >= shortest) & (p >= 0) & (p + size <= n))
                yield ok, m[ok], i, p[ok], size[ok]


def _bucket_rows(batches: Iterator[pa.RecordBatch], threshold: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """(bucket, rep) of the index entries and probes of the lines; those of a line's first occurrence in a block only."""
    for batch in batches:
        for _, _, data, offs in blocks(batch["text"]):
            starts, ends, _, _ = _lines(data, offs)
            size = ends - starts
            starts, size = starts[size >= shortest], size[size >= shortest]
            sums = prefix(data)
            rep, first = np.unique(run_hash(sums, starts, starts + size), return_index=True)
            starts, size = starts[first], size[first]
            buckets, reps = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for line, length, i, p, s in entries(size, threshold, shortest):
                kind = (length * 16 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                buckets.append(mix(run_hash(sums, starts[line] + p, starts[line] + p + s) + kind))
                reps.append(rep[line])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(reps).view(np.int64))], ["bucket", "rep"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and rep, without repeats, those of buckets with more than one rep."""
    held: tuple[int, int] | None = None  # the last row so far
    passed = False
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, rep = batch["bucket"].to_numpy(), batch["rep"].to_numpy()
        if held is not None:
            bucket, rep = np.append(held[0], bucket), np.append(held[1], rep)
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (rep[1:] != rep[:-1])
        was_first = held is not None
        bucket, rep = bucket[new], rep[new]
        like = np.zeros(len(bucket), bool)
        like[1:] = bucket[1:] == bucket[:-1]
        keep = like.copy()
        keep[:-1] |= like[1:]
        last_kept = bool(keep[-1]) or (len(keep) == 1 and was_first and passed)
        if was_first and passed:
            keep[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(rep[keep])], ["bucket", "rep"])
        held, passed = (int(bucket[-1]), int(rep[-1])), last_kept


def _line_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reps, out = [], []
        for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist()):
            own = (text or "").encode().split(b"\n")
            for w in wanted:
                if w["line"] < len(own):
                    reps.append(w["rep"])
                    out.append(own[w["line"]])
        reps, out = pa.array(reps, pa.int64()), pa.array(out, pa.binary())
        # another text under the doc_id has another line there
        same = [run_hash(prefix(data), offs[:-1], offs[1:]).view(np.int64) for _, _, data, offs in blocks(out)]
        keep = pa.array(np.concatenate([np.zeros(0, np.int64), *same]) == reps.to_numpy())
        yield pa.RecordBatch.from_arrays([reps.filter(keep), out.filter(keep)], ["rep", "bytes"])


def edit_distance(a: bytes, b: bytes, threshold: int) -> int:
    """Edit distance as far as `threshold`, more than it otherwise: bit-parallel over a, within the band."""
    if abs(len(a) - len(b)) > threshold:
        return threshold + 1
    k = min(len(a), len(b))
    head = 0
    while head < k and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < k - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = every, 0, len(a)
    for j, c in enumerate(b):
        # no path within the threshold leaves its diagonal by more
        band = ((1 << 2 * threshold + 1) - 1) << j >> threshold if j < threshold else ((1 << 2 * threshold + 1) - 1) << j - threshold
        match = places.get(c, 0) & band & every
        x = match | minus
        zero = (((match & plus) + plus) ^ plus) | x
        up, down = minus | ~(zero | plus) & every, plus & zero
        distance += 1 if up & last else -1 if down & last else 0
        up, down = (up << 1 | 1) & every, down << 1 & every
        plus, minus = down | ~(zero | up) & every, up & zero
        if distance - (len(b) - 1 - j) > threshold:
            return threshold + 1
    return distance


def _near(x: list[bytes], y: list[bytes], threshold: int) -> list[int]:
    return [edit_distance(a, b, threshold) for a, b in zip(x, y)]


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _near(batch["x"].to_pylist(), batch["y"].to_pylist(), threshold)
        keep = pa.array([d <= threshold for d in found], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])


def _verify_block(lines: list[bytes], left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Which of the pairs of lines are within the threshold. An edit moves the counts of the bytes by two at most."""
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    counts = np.bincount(owner * 256 + np.frombuffer(b"".join(lines), np.uint8), minlength=256 * len(lines)).astype(np.int32).reshape(-1, 256)
    out = np.zeros(len(left), bool)
    for k in range(0, len(left), 4096):
        a, b = left[k:k + 4096], right[k:k + 4096]
        may = np.flatnonzero(np.abs(counts[a] - counts[b]).sum(1) <= 2 * threshold)
        for m in may.tolist():
            out[k + m] = edit_distance(lines[a[m]], lines[b[m]], threshold) <= threshold
    return out


def _first_places(lines: DataFrame) -> DataFrame:
    """The distinct lines (h1, h2, n), each with its first place, and whether it has `several`."""
    place = F.struct("doc", "line")
    return lines.groupBy("h1", "h2", "n").agg(F.min(place).alias("at"), F.max(place).alias("last")).select(
        "h1", "h2", "n", "at", (F.col("at") != F.col("last")).alias("several"))


def _classes(docs: DataFrame, threshold: int, shortest: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): doc, line, h1, h2 and n of every line that isn't blank, and of those distinct lines that have
    several places or are linked the class's first place `at`, and n_links."""
    spark = docs.sparkSession
    texts = keyed(docs)
    lines = stored(arrow_map(texts, _line_rows, "doc bigint, line int, h1 bigint, h2 bigint, n int"), "lines")
    distinct = stored(_first_places(lines), "distinct-lines")
    rows = arrow_map(texts.select("text"), lambda it: _bucket_rows(it, threshold, shortest), "bucket bigint, rep bigint")
    dealt = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "rep")
    met = stored(arrow_map(dealt, _met, "bucket bigint, rep bigint"), "met")
    known = stored(distinct.withColumnRenamed("h1", "rep").join(met.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(
        F.min("n").alias("n"), F.min("at").alias("at")), "known")
    members = stored(met.join(known.select("rep", "n"), "rep").select("bucket", "rep", "n"), "members")
    wanted = known.groupBy(F.col("at.doc").alias("doc")).agg(
        F.collect_list(F.struct("rep", F.col("at.line").alias("line"))).alias("wanted"))
    # merged whatever the size: a broadcast table of wanted lines would grow with the input
    store = stored(arrow_map(texts.join(wanted.hint("merge"), "doc").select("text", "wanted"), _line_bytes,
                             "rep bigint, bytes binary"), "line-bytes")
    first = store.select(F.col("rep").alias("a"), F.col("bytes").alias("x"))
    second = store.select(F.col("rep").alias("b"), F.col("bytes").alias("y"))

    def verify(pairs: DataFrame) -> DataFrame:
        return arrow_map(pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y"),
                         lambda it: _verify(it, threshold), "a bigint, b bigint")

    payloads = store.withColumnRenamed("bytes", "payload")
    block = lambda lines, left, right: _verify_block(lines, left, right, threshold)
    fits = lambda x, y: (x - y <= threshold) & (y - x <= threshold)
    if counted:  # all pairs meet for the counts, which gives the links too
        counts, links = counted_links(members, payloads.dropDuplicates(["rep"]), block, fits)
        labels = components(links).join(counts.withColumnRenamed("rep", "node"), "node")
    else:
        labels = components(links_in_buckets(members, payloads, verify, block, fits)).withColumn("n_links", F.lit(None).cast("bigint"))
    labels = labels.withColumnRenamed("node", "h1")
    linked = stored(distinct.join(labels, "h1").select("h1", "h2", "n", "at", "label", "n_links"), "linked-lines")
    firsts = linked.groupBy("label").agg(F.min("at").alias("class_at"))
    # an unlinked line is a class by both hashes
    copies = distinct.filter("several").join(linked.select("h1").distinct(), "h1", "left_anti").select(
        "h1", "h2", "n", "at", F.lit(0 if counted else None).cast("bigint").alias("n_links"))
    return lines, linked.join(firsts, "label").select("h1", "h2", "n", F.col("class_at").alias("at"), "n_links").unionByName(copies)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, counted: bool = False) -> DataFrame:
    """Every line that isn't blank: doc, line (its number), first_doc and first_line of its class, and n_links: if
    `counted`, how many other distinct lines are within the threshold, else null."""
    lines, classes = _classes(docs, threshold, shortest, counted)
    return lines.join(classes, ["h1", "h2", "n"], "left").select(
        "doc", "line", F.coalesce("at.doc", "doc").alias("first_doc"), F.coalesce("at.line", "line").alias("first_line"),
        F.coalesce("n_links", F.lit(0)).alias("n_links") if counted else "n_links")


def linked_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """doc, n_lines, `removed` as below, and `linked`: of the lines within the threshold of others, the first of the
    class and the number of other distinct lines that each is linked to."""
    return _by_document(*_classes(docs, threshold, shortest, counted=True))


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """doc, n_lines, and `removed`: the lines that aren't the first of their class, with the first."""
    return _by_document(*_classes(docs, threshold, shortest, counted=False)).drop("linked")


def _by_document(lines: DataFrame, classes: DataFrame) -> DataFrame:
    places = lines.join(classes, ["h1", "h2", "n"]).select(
        "doc", "line", F.col("at.doc").alias("first_doc"), F.col("at.line").alias("first_line"), "n_links")
    again = (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))
    found = places.filter(again | (F.col("n_links") > 0)).groupBy("doc").agg(
        F.array_sort(F.collect_set(F.when(again, F.struct("line", "first_doc", "first_line")))).alias("removed"),
        F.array_sort(F.collect_set(F.when(F.col("n_links") > 0, F.struct("line", "first_doc", "first_line", "n_links")))).alias("linked"))
    return lines.groupBy("doc").agg(F.countDistinct("line").alias("n_lines")).join(found, "doc", "left").select(
        "doc", "n_lines", *(F.coalesce(c, F.expr("array()")).alias(c) for c in ("removed", "linked")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, stays = [], []
        for text, gone in zip(batch["text"].to_pylist(), batch[_GONE].to_pylist()):
            kept = text
            if gone:
                away = {g["line"] for g in gone}
                kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in away)
            out.append(kept)
            stays.append(not gone or bool(kept.strip()))
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field("text"), pa.array(out, pa.string()))
        yield batch.select([c for c in batch.schema.names if c not in (_ID, _GONE)]).filter(pa.array(stays, pa.bool_()))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """The documents, with all their columns, without the removed lines; documents of which no line is left go."""
    gone = removed_lines(docs, threshold, shortest).filter(F.size("removed") > 0).select(
        F.col("doc").alias(_ID), F.col("removed").alias(_GONE))
    marked = docs.withColumn(_ID, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).join(gone, _ID, "left")
    return arrow_map(marked, _cut, docs.schema)
