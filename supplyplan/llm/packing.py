"""Best-fit packing (operator 7): hierarchical residual packing of token pieces into sequences.

Texts become token ids, then pieces of at most `capacity` ids; only longer documents are cut. Every partition packs
its pieces best-fit decreasing and emits the bins that are nearly full. Underfull bins are items of the next round,
in which partitions are merged (no shuffle), until one partition has seen them all or a round joins too few. A task
holds a bounded number of items at a time, and nothing is collected.

Defined results: a null text counts as empty and is the single closing id; documents are never dropped, repeated
rows are packed each; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .shipping import arrow_map, give_back
from .tokens import encoder

CAPACITY = 2048
#: id that closes every document
END = 0
#: bins with at most so many free places are not tried again
SLACK = 16
#: items that one task packs at a time
ITEMS = 100_000
#: characters that are encoded at once
BLOCK = 1 << 18
#: a round that joins less than this share of the bins is the last
GAIN = 0.01

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])
_BIN = "sequence_id bigint, fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item and the number of bins, best-fit decreasing: the fullest bin that has room."""
    out = np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a bin with r free places
    bins = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        above = rooms >> need
        if need and above:
            room = need + (above & -above).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            b, room = bins, capacity
            bins += 1
        out[k] = b
        room -= need
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return out, bins


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    for batch in batches:
        ids_of, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < BLOCK):
                size += len(texts[hi] or "")
                hi += 1
            rows = []
            for doc, ids in zip(ids_of[lo:hi], encode([t or "" for t in texts[lo:hi]])):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    own = ids[start:end]
                    rows.append((doc, piece, start, end - start, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:k], kinds)], names[:k])
            lo = hi
    give_back()


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids where they are asked for."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"),
                     lambda it: _pieces(it, path, capacity, with_ids), schema)


def _taken(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, most: int, level: int) -> Iterator[pa.RecordBatch]:
    """Items (fill, members) to bins; sequence ids are made of the round, the partition and the bin."""
    made = (level << 56) + (TaskContext.get().partitionId() << 32)
    for table in _taken(batches, most):
        fill = table["fill"].to_numpy().astype(np.int64)
        members = table["members"].combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        bins, n = best_fit(fill, capacity)
        order = np.argsort(bins, kind="stable")
        counts = np.bincount(bins, np.diff(members.offsets.to_numpy()), n).astype(np.int64)
        sums = np.bincount(bins, fill, n).astype(np.int32)
        flat = members.take(pa.array(order)).flatten()
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(made + np.arange(n)), pa.array(sums), out],
                                         ["sequence_id", "fill", "members"])
        made += n


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """Sequences: sequence_id, fill, members (pieces in their order)."""
    spark = pieces.sparkSession
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    todo = pieces.select(F.col("length").cast("int").alias("fill"), F.array(member).alias("members"))
    full, level, before, parts = [], 0, None, None
    while True:
        todo = todo if parts is None else todo.coalesce(parts)
        bins = stored(arrow_map(todo, lambda it, level=level: _pack(it, capacity, items, level), _BIN), f"bins-{level}")
        full.append(bins.filter(F.col("fill") >= capacity - slack))
        under = bins.filter(F.col("fill") < capacity - slack)
        left = under.count()
        if left <= 1 or parts == 1 or before is not None and left > (1 - GAIN) * before:
            full.append(under)
            break
        before, level, parts = left, level + 1, max(1, math.ceil(left / items))
        todo = under.select("fill", "members")
    out = full[0]
    for more in full[1:]:
        out = out.unionByName(more)
    return out


def placed(sequences: DataFrame) -> DataFrame:
    """One row per piece, with its sequence and its offset in it."""
    ends = F.transform("members", lambda m: m["length"])
    return sequences.select("sequence_id", "members", ends.alias("lengths")).select(
        "sequence_id", "lengths", F.posexplode("members").alias("at", "m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id",
        F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("offset"))


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK,
                     items: int = ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document."""
    pieces = stored(token_pieces(docs, path, capacity), "pieces")
    return placed(pack(pieces, capacity, slack, items))
