"""Spelling variant grouping (operator 12): words one edit apart, by blocked Gram matrices of letter counts.

One edit changes a letter count by one, or two by one each, so near words have count vectors at a squared distance of at
most two and lengths that differ by at most one. Words are dealt into tiles of one length and one profile of letter
classes; an edit moves a profile to itself or to a few neighbours, so only tiles of equal or adjacent profiles meet.
For a pair of tiles one matrix product gives all squared distances, and the pairs that are left are compared code point
by code point. A task emits one row for each word with near ones, not the pairs.

Defined results: a null text has no words, a null doc_id counts as an empty text before the colon; repeated rows count
each; words of any length are compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, stored
from .shipping import arrow_map

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, DOMINANCE = 6, 5, 5
#: classes of code points in a profile, and words of a tile
CLASSES, TILE = 4, 2048
#: bytes of distances at once
PRODUCT_BYTES = 16 << 20


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, mistype: int | None = None) -> DataFrame:
    """word and n: lower-cased maximal runs of letters, of at least `shortest` code points and `least` occurrences.

    With `mistype`, a run loses the code point at h % length where that divides h, the crc32 of "doc_id:run".
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        "text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    upper = "".join(map(chr, range(0x41, 0x5B)))
    words = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    if mistype:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select("run", h.alias("h")).select(F.when(F.col("h") % mistype == 0, cut).otherwise(F.col("run")).alias("run"))
    return words.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(
        (F.length("word") >= shortest) & (F.col("n") >= least))


def _moves(classes: int) -> list[tuple[int, ...]]:
    """Profile steps of one edit, each direction once: none, one code point more, one for another."""
    unit = 1 - np.eye(classes, dtype=int)
    steps = [np.zeros(classes, int), *unit, *(unit[i] - unit[j] for i in range(classes) for j in range(i))]
    return list(dict.fromkeys(tuple(map(int, s)) for s in steps))


def _profile(classes: int):
    """How many code points of the word are outside each class, a class being their numbers modulo the number of classes."""
    points = F.transform(F.split("word", ""), lambda c: F.pmod(F.ascii(c), F.lit(classes)))
    return F.array(*[F.size(F.array_remove(points, k)) for k in range(classes)])


def tile_pairs(words: DataFrame, classes: int = CLASSES, tile: int = TILE) -> DataFrame:
    """Every word once for each pair of tiles that it takes part in: pair, side (0, 1 or, in a tile with itself, 2), word, n."""
    dealt = words.withColumn("profile", _profile(classes))
    sizes = dealt.groupBy("profile").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _moves(classes)]))
    away = F.zip_with("profile", "step", lambda p, s: p + s)
    # from each profile to the adjacent ones that exist
    met = sizes.select("profile", "tiles", steps.alias("step")).withColumn("to", away).join(
        sizes.select(F.col("profile").alias("to"), F.col("tiles").alias("to_tiles")), "to")
    alone = F.col("profile") == F.col("to")
    both = met.select("profile", F.struct("profile", "to", F.lit(0).alias("side"), F.col("to_tiles").alias("others")).alias("m")).unionByName(
        met.filter(~alone).select(F.col("to").alias("profile"), F.struct("profile", "to", F.lit(1).alias("side"), F.col("tiles").alias("others")).alias("m")))
    plans = sizes.join(both.groupBy("profile").agg(F.collect_list("m").alias("met")), "profile")  # a few per profile
    own = dealt.join(plans, "profile").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    each = own.select("word", "n", "profile", "tile", F.explode("met").alias("m")).select(
        "word", "n", "tile", "m.*", F.explode(F.sequence(F.lit(0), F.col("m.others") - 1)).alias("other"))
    same = F.col("profile") == F.col("to")
    first = F.when(same, F.least("tile", "other")).when(F.col("side") == 0, F.col("tile")).otherwise(F.col("other"))
    second = F.when(same, F.greatest("tile", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("tile"))
    side = F.when(same & (F.col("tile") == F.col("other")), 2).when(same, (F.col("tile") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return each.select(F.xxhash64("profile", "to", first, second).alias("pair"), side.alias("side"), "word", "n")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words in rows, padded on the right, and the lengths."""
    lens = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(lens.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out, lens


def letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row; exact in float32 up to words of some thousand letters, else in float64."""
    out = np.zeros((len(codes), len(letters)), np.float32 if codes.shape[1] <= 2000 else np.float64)
    rows, cols = np.nonzero(codes)
    np.add.at(out, (rows, np.searchsorted(letters, codes[rows, cols])), 1)
    return out


def one_edit(a: np.ndarray, a_lens: np.ndarray, b: np.ndarray, b_lens: np.ndarray) -> np.ndarray:
    """Whether rows of equal index differ by exactly one inserted, deleted or replaced code point."""
    wide = max(a.shape[1], b.shape[1]) + 1  # a common column of padding ends every comparison
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    swap = (a_lens > b_lens)[:, None]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    short, long = np.minimum(a_lens, b_lens), np.maximum(a_lens, b_lens)
    head = (a != b).argmax(1)  # the first place where they differ
    at = np.arange(wide)
    skip = at + (long > short)[:, None]  # what follows that place, in the longer one
    rest = np.take_along_axis(b, np.minimum(skip, wide - 1), 1)
    after = at >= (head + (long == short))[:, None]
    return (long - short <= 1) & (a != b).any(1) & ((a == rest) | ~after).all(1)


def near_pairs(left: list[str], right: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words of two tiles that are one edit apart; of one tile with itself, each pair once."""
    a, a_lens = _codes(left)
    b, b_lens = (a, a_lens) if alone else _codes(right)
    letters = np.unique(np.concatenate([a[a > 0], b[b > 0]]))
    x, y = letter_counts(a, letters), letter_counts(b, letters)
    x_sq, y_sq = (x * x).sum(1), (y * y).sum(1)
    found = []
    step = max(1, PRODUCT_BYTES // max(1, y.itemsize * len(y)))
    for lo in range(0, len(x), step):
        gram = x[lo:lo + step] @ y.T
        gram *= -2
        gram += x_sq[lo:lo + step, None]
        gram += y_sq
        i, j = np.nonzero(gram <= 2)
        i += lo
        ok = i < j if alone else slice(None)
        found.append((i[ok], j[ok]))
    i, j = (np.concatenate(k) for k in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    keep = [one_edit(a[i[k:k + TILE]], a_lens[i[k:k + TILE]], b[j[k:k + TILE]], b_lens[j[k:k + TILE]]) for k in range(0, len(i), TILE)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _summary(words: list[str], counts: np.ndarray, own: np.ndarray, other: np.ndarray, names: list[str], ns: np.ndarray) -> list[tuple]:
    """For each of a tile's words with near ones: how many, and the most frequent, of equals the first in code-point order."""
    best: dict[int, tuple] = {}
    for k, o in zip(own.tolist(), other.tolist()):
        c, top = best.get(k, (0, None))
        new = (-int(ns[o]), names[o])
        best[k] = (c + 1, new if top is None or new < top else top)
    return [(words[k], int(counts[k]), c, -top[0], top[1]) for k, (c, top) in best.items()]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles, one after the other; rows come sorted by pair."""
    held: list[pa.RecordBatch] = []

    def judged() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        side, words, ns = table["side"].to_numpy(), table["word"].to_numpy(), table["n"].to_numpy()
        alone = bool((side == 2).any())
        left, right = (side == 2, side == 2) if alone else (side == 0, side == 1)
        a, b, na, nb = words[left].tolist(), words[right].tolist(), ns[left], ns[right]
        i, j = near_pairs(a, b, alone)
        rows = _summary(a, na, i, j, b, nb) + _summary(b, nb, j, i, a, na)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "n", "n_near", "form_n", "form"])

    for batch in batches:
        pair = batch["pair"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1]["pair"][0].as_py() != pair[lo]:
                yield from judged()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from judged()


def near_words(words: DataFrame, classes: int = CLASSES, tile: int = TILE) -> DataFrame:
    """word, n_near and the most frequent near word with its n, of words that have near ones."""
    dealt = tile_pairs(words, classes, tile).repartition(partitions(words.sparkSession), "pair").sortWithinPartitions("pair")
    found = arrow_map(dealt, _near, "word string, n bigint, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: forms followed to the last. Every round doubles the steps, and counts grow at each step, so few rounds do."""
    links = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")), "forms")
        links = nxt.select("word", "root")
        if not nxt.filter("moved").take(1):
            return links


def spelling_groups(words: DataFrame, dominance: int = DOMINANCE, classes: int = CLASSES, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n); the form is the most frequent near word if it is `dominance` times as frequent."""
    words = stored(words, "words")
    takes = F.col("near_n") >= dominance * F.col("n")
    forms = stored(words.join(near_words(words, classes, tile), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "words")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
