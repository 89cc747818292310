"""Links within candidate buckets, without all pairs of a bucket.

Every member first meets one pivot, the most central of its buckets, and the links found make components. Of each
bucket four pivots then meet the members of other components. Three pivots are taken among the most central members,
those that share most with others, for near copies of one text often resemble it more than each other. Members of one bucket that are still in different components are then compared in blocks: a task gets two
blocks of a bucket and emits the links only. So no link between components is lost, a bucket of thousands of alike
members costs a few pairs for each, and one of thousands of unlike members is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import partitions, stored
from .shipping import arrow_map
from .textcodes import gather

CENTRAL = 3
#: members of a block
BLOCK = 128
#: pairs that are worked on at once
PAIRS = 1 << 18
#: (size, size) -> whether members of these sizes can be linked; of columns and of arrays
Fits = Callable


def _pair(left: str, right: str, fits: Fits) -> tuple[Column, Column, Column]:
    return (F.least(left, right).alias("a"), F.greatest(left, right).alias("b"),
            fits(F.col(f"{left}_n"), F.col(f"{right}_n")) & (F.col(left) != F.col(right)))


def _pivots(members: DataFrame) -> DataFrame:
    """The pivots (rep, n, weight) of each bucket, the most central first."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    weights = members.join(sizes, "bucket").groupBy("rep").agg(F.floor(4 * F.log(F.sum("size"))).alias("weight"))
    ranked = members.join(weights, "rep")
    central = [F.max(F.struct("weight", F.xxhash64("rep", F.lit(k)).alias("r"), "rep", "n")) for k in range(CENTRAL)]
    any_one = F.min(F.struct(F.lit(0).cast("bigint").alias("weight"), F.xxhash64("rep").alias("r"), "rep", "n"))
    named = lambda p: F.struct(p["rep"].alias("rep"), p["n"].alias("n"), F.coalesce(p["weight"], F.lit(0)).alias("weight"))
    return ranked.groupBy("bucket").agg(F.transform(F.array(*central, any_one), named).alias("pivots"))


def _first_pairs(members: DataFrame, pivots: DataFrame, fits: Fits) -> DataFrame:
    """Every member with one pivot: of those of its buckets the most central that it can be linked to."""
    met = members.join(pivots.select("bucket", F.col("pivots")[0].alias("p")), "bucket").select(
        "rep", F.col("n").alias("rep_n"), F.col("p.rep").alias("to"), F.col("p.n").alias("to_n"), F.col("p.weight").alias("weight"))
    _, _, may = _pair("rep", "to", fits)
    best = met.filter(may).groupBy("rep").agg(F.max(F.struct("weight", "to")).alias("best"))
    return best.select(F.least("rep", "best.to").alias("a"), F.greatest("rep", "best.to").alias("b")).distinct()


def _star_pairs(members: DataFrame, pivots: DataFrame, labels: DataFrame, fits: Fits) -> DataFrame:
    """Every member with those pivots of its buckets that are in another component."""
    own = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    centres = pivots.select("bucket", F.explode("pivots").alias("p")).select(
        "bucket", F.col("p.rep").alias("to"), F.col("p.n").alias("to_n")).distinct().join(
        labels.select(F.col("rep").alias("to"), F.col("label").alias("to_label")), "to", "left").withColumn(
        "to_label", F.coalesce("to_label", "to"))
    met = own.withColumnRenamed("n", "rep_n").join(centres, "bucket")
    a, b, may = _pair("rep", "to", fits)
    return met.filter(may & (F.col("label") != F.col("to_label"))).select(a, b).distinct()


def _blocks(apart: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt into blocks, once for each block that a block is to meet.

    Members of the bucket's largest component needn't meet each other: their blocks, numbered after those of the
    others, only meet those.
    """
    by_label = apart.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_label.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("total")).filter(
        "main.c < total").select(
        "bucket", F.col("main.label").alias("main"),
        F.ceil(F.col("main.c") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("total") - F.col("main.c")) / BLOCK).cast("int").alias("blocks"))
    spread = F.xxhash64("rep", F.lit(7))
    dealt = apart.join(sizes, "bucket").withColumn("in_main", F.col("label") == F.col("main")).withColumn(
        "block", F.when(F.col("in_main"), F.col("blocks") + F.pmod(spread, F.col("main_blocks")))
        .otherwise(F.pmod(spread, F.col("blocks"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    everyone = F.sequence(F.lit(0), F.col("blocks") + F.col("main_blocks") - 1)
    return dealt.withColumn("other", F.explode(F.when(F.col("in_main"), others).otherwise(everyone))).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "label", "n")


def _block_links(batches: Iterator[pa.RecordBatch], verify, fits: Fits) -> Iterator[pa.RecordBatch]:
    """Links within the groups (bucket, lo, hi) of sorted rows; a group holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table[k].to_numpy() for k in ("bucket", "lo", "hi")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts):
                yield from _group_links(table.slice(a, b - a), verify, fits)
            held = table.slice(cuts[-1] if len(cuts) else 0).combine_chunks().to_batches()
    if held:
        yield from _group_links(pa.Table.from_batches(held), verify, fits)


def _group_links(group: pa.Table, verify, fits: Fits) -> Iterator[pa.RecordBatch]:
    rep, label, n, block = (group[k].to_numpy() for k in ("rep", "label", "n", "block"))
    lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    x, y = (a.ravel() for a in np.meshgrid(left, right, indexing="ij"))
    may = (label[x] != label[y]) & fits(n[x], n[y]) & ((x < y) | (lo != hi))
    x, y = x[may], y[may]
    if len(x):
        found = verify(group["payload"].to_pylist(), x, y)
        a, b = rep[x[found]], rep[y[found]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def links_in_buckets(members: DataFrame, payloads: DataFrame, verify: Callable[[DataFrame], DataFrame],
                     verify_block: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray], fits: Fits) -> DataFrame:
    """Links (a, b) among members (bucket, rep, n) that share a bucket.

    `verify` finds the links among pairs (a, b), `verify_block` those among pairs of a list of payloads (rep, payload);
    `fits` tells from the sizes n whether a pair can be linked at all.
    """
    pivots = stored(_pivots(members), "pivots")
    first = stored(verify(stored(_first_pairs(members, pivots, fits), "pairs")), "links")
    labels = components(first, rounds=1).withColumnRenamed("node", "rep")
    more = verify(stored(_star_pairs(members, pivots, labels, fits), "pairs"))
    links = stored(first.unionByName(more), "links")
    labels = components(links).withColumnRenamed("node", "rep")
    apart = stored(members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled-members")
    dealt = _blocks(apart).join(payloads, "rep").repartition(partitions(members.sparkSession), "bucket", "lo", "hi").sortWithinPartitions(
        "bucket", "lo", "hi", "rep")
    rest = arrow_map(dealt, lambda it: _block_links(it, verify_block, fits), "a bigint, b bigint")
    return stored(links.select("a", "b").unionByName(rest).distinct(), "all-links")


def _group_runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive groups of together a bounded number of pairs and rows; a larger group is alone."""
    lo, held = 0, 0
    for k, cost in enumerate((sizes * (sizes + 32)).tolist()):
        if k > lo and held + cost > PAIRS:
            yield lo, k
            lo, held = k, 0
        held += cost
    if len(sizes):
        yield lo, len(sizes)


def _share_earlier(lists: pa.ListArray, bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows x and y of each pair, of one bucket, share a bucket before it too."""
    offs = lists.offsets.to_numpy()
    sizes = np.diff(offs)
    flat, width = lists.flatten().to_numpy(), int(sizes.max())
    own = np.repeat(bucket[:, None], width, 1)
    own[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], sizes)] = flat
    out = np.zeros(len(x), bool)
    step = max(1, 8 * PAIRS // width)
    for k in range(0, len(x), step):
        a, b, here = own[x[k:k + step]], own[y[k:k + step]], bucket[x[k:k + step]]
        for c in range(width):
            out[k:k + step] |= (a[:, c] < here) & (a[:, c][:, None] == b).any(1)
    return out


def _least_linked(x: np.ndarray, y: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each row the least rep that it is linked to by the pairs (x, y), over others too."""
    least = rep.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, x, before[y])
        np.minimum.at(least, y, before[x])
        if (least == before).all():
            return least


def _group_counts(table: pa.Table, verify, fits: Fits) -> Iterator[pa.RecordBatch]:
    """Of sorted rows of whole groups (bucket, lo, hi): the links of each member within its group, of the pairs whose
    first shared bucket is the group's, and the least member that these links lead to."""
    bucket, lo, hi, rep, n, block = (table[k].to_numpy() for k in ("bucket", "lo", "hi", "rep", "n", "block"))
    opens = np.ones(len(rep), bool)
    opens[1:] = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    ends = np.append(np.flatnonzero(opens)[1:], len(rep))[np.cumsum(opens) - 1]  # of each row's group
    rest = ends - np.arange(len(rep)) - 1
    x, y = np.repeat(np.arange(len(rep)), rest), gather(np.arange(len(rep)) + 1, rest)
    may = ((lo == hi)[x] | (block[x] != block[y])) & fits(n[x], n[y])
    x, y = x[may], y[may]
    if len(x):
        apart = ~_share_earlier(table["buckets"].combine_chunks(), bucket, x, y)
        x, y = x[apart], y[apart]
    if len(x):
        found = verify(table["payload"].to_pylist(), x, y)
        x, y = x[found], y[found]
        counts = np.bincount(np.concatenate([x, y]), minlength=len(rep))
        some = counts > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[some]), pa.array(counts[some]), pa.array(_least_linked(x, y, rep)[some])], ["rep", "n_links", "to"])


def _whole_groups(batches: Iterator[pa.RecordBatch], verify, fits: Fits) -> Iterator[pa.RecordBatch]:
    """What `_group_counts` makes of sorted rows, many small groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = _cuts(table)
            yield from _counted_runs(table, cuts, verify, fits)
            held = table.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield from _group_counts(pa.Table.from_batches(held).combine_chunks(), verify, fits)


def _counted_runs(table: pa.Table, cuts: np.ndarray, verify, fits: Fits) -> Iterator[pa.RecordBatch]:
    for a, b in _group_runs(np.diff(cuts)):
        yield from _group_counts(table.slice(cuts[a], cuts[b] - cuts[a]), verify, fits)


def _cuts(table: pa.Table) -> np.ndarray:
    """Starts of the groups (bucket, lo, hi) of sorted rows."""
    keys = np.stack([table[k].to_numpy() for k in ("bucket", "lo", "hi")])
    return np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])


def counted_links(members: DataFrame, payloads: DataFrame, verify_block: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray],
                  fits: Fits) -> tuple[DataFrame, DataFrame]:
    """(counts, links): (rep, n_links), how many others each member (bucket, rep, n) is linked to, without loss, and
    links or paths of them (a, b), which span the components.

    All members of a bucket meet in blocks, two blocks a group, each pair in the least bucket that both are in; a group
    emits one row for each member that has a link there."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = members.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))
    dealt = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n")
    met = dealt.join(payloads, "rep").join(own, "rep").repartition(partitions(members.sparkSession), "bucket", "lo", "hi").sortWithinPartitions(
        "bucket", "lo", "hi", "rep")
    found = stored(arrow_map(met, lambda it: _whole_groups(it, verify_block, fits), "rep bigint, n_links bigint, to bigint"), "group-links")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    return counts, found.filter("rep <> to").select(F.col("to").alias("a"), F.col("rep").alias("b")).distinct()
