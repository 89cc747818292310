"""Operator 11 against brute force, over ties, odd rows and tiny cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplyplan.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, q string, digest int, side string"


def brute(rows, anchors, positives=5, negatives=5):
    kept = {}
    for k, v, label, *_ in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[k, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = set()
    for a in (r for r in kept if r[0] % anchors == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept if r != a)
        near = [s for s in scored if s[2] == a[1]][:positives]
        for p in near:
            hard = [s for s in scored if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            out |= {(a[0], p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(hard, 1)}
    return out


def mined(spark, rows, anchors, **limits):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in hn.mine(df, F.col("vec_id") % anchors == 0, **limits).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 65), (100, 37, 140), (129, 130, 131)])
@pytest.mark.parametrize("leaf", [5, 8, 32])
def test_product(shape, leaf):
    r = np.random.default_rng(1)
    m, k, n = shape
    a, b = r.integers(-2 ** 22, 2 ** 22, (m, k)), r.integers(-2 ** 22, 2 ** 22, (k, n))
    assert (hn.product(a, b, leaf) == a @ b).all()


def test_heaps_merge():
    r = np.random.default_rng(2)
    heaps, seen = hn.Heaps(7, 3), {k: [] for k in range(7)}
    for _ in range(40):
        keys = r.integers(0, 7, 11)
        entries = np.stack([r.integers(-5, 5, 11), r.integers(0, 1 << 40, 11), r.integers(0, 9, 11)], 1)
        heaps.push(keys, entries)
        for k, e in zip(keys.tolist(), entries.tolist()):
            seen[k].append(e)
    keys, entries = heaps.rows()
    for k, all_of in seen.items():
        assert entries[keys == k].tolist() == sorted(all_of, key=lambda e: (-e[0], *e[1:]))[:3]


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 2000, "part_rows": 50}])
def test_mining(spark, limits):
    r = np.random.default_rng(3)
    rows = [(k, (np.abs(r.normal(size=6)) * (0.2, 3)[k % 2]).tolist(), int(r.integers(0, 3))) for k in range(160)]
    rows += [(k, [0.5, 0.5, 0.5], k % 2) for k in range(160, 220)]  # one vector in more than a quarter of the rows: ties
    rows += [(1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan")] * 6, 1), (1030, [float("inf"), 1.0], 0), (None, [1.0], 1),
             (1040, [1.0] * 6, None), (1050, [], 1), (1060, [2.0], 2), (30, rows[30][1], rows[30][2]), (1070, [-1.0] * 6, 0),
             (1080, [0.3] * 40, 1)]
    expected = brute(rows, 10)
    assert len(expected) > 100 and len({a for a, *_ in expected}) > 10
    assert mined(spark, rows, 10, **limits) == expected


def test_one_label_and_few_rows(spark):
    rows = [(k, [1.0, float(k)], 4) for k in range(3)]
    assert mined(spark, rows, 1) == set()
    assert mined(spark, rows[:1], 1) == set()
    assert mined(spark, [], 1) == set()
    assert mined(spark, [*rows, (9, [1.0, 0.9], 5)], 1) == brute([*rows, (9, [1.0, 0.9], 5)], 1)


def test_one_id_with_two_vectors(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [0.9, 0.1], 1), (12, [0.85, 0.1], 2), (13, [0.1, 0.75], 2)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_scores_beyond_the_bound_are_an_error():
    big = np.full((1, 4), 1 << 27)
    assert hn.scores(big // 8, big // 8).item() == 4 << 48
    with pytest.raises(ArithmeticError):
        hn.scores(big * 2, big * 2)
