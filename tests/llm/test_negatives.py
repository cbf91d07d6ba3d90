import numpy as np
import pytest
from pyspark.sql import functions as F

from leafaudit.llm import negatives

SCHEMA = "vec_id long, label int, components array<long>, score string, anchor string"


def brute(rows, positives=5, negatives_=5, percent=80):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a in {(r[0], r[1], tuple(r[2])) for r in rows if r[0] is not None and r[0] % 10 == 0}:
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r[0] != a[0]]
        for p, pid, _ in sorted([s for s in scored if s[2] == a[1]], key=place)[:positives]:
            near = sorted([s for s in scored if s[2] != a[1] and percent * p <= 100 * s[0] <= 100 * p], key=place)[:negatives_]
            out += [(a[0], pid, k + 1, n[1], p, n[0]) for k, n in enumerate(near)]
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("spread", [300, 40])
def test_hard_negatives_match_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.normal(0, 200, (4, 12))
    rows = []
    for i in range(240):
        label = int(rng.integers(4)) if rng.random() > 0.33 else 0  # one label holds most rows
        rows.append((i, label, [int(x) for x in centres[label] + rng.normal(0, spread, 12)]))
    rows += [(None, 0, rows[5][2]), (7, None, rows[5][2]), (8, 1, None), (9, 1, [None, *[1] * 11]), rows[20], rows[21], rows[21], (500, 2, [0] * 12), (501, 9, [5, 6]), (30, 2, rows[30][2])]
    rows += [(600 + i, 1, rows[40][2]) for i in range(9)] + [(700 + i, 3, rows[40][2]) for i in range(9)]  # ties
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block_rows=40, anchor_rows=5, positives=2, negatives=3, percent=50) == brute(rows, 2, 3, 50)


def test_empty_table_and_huge_components(spark):
    assert run(spark, []) == []
    assert run(spark, [(i, None, [1, 2]) for i in range(20)]) == []
    big = 2**31
    rows = [(0, 1, [big, 1]), (1, 1, [1, big]), (2, 1, [3, 5]), (3, 2, [1, big - 9]), (4, 2, [2, 2])]
    assert run(spark, rows) == brute(rows)


def test_bounds_hold_and_exclude(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-400, 400, (200, 16))
    base = rng.normal(size=(5, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v[:5] = np.round(base * 1000)  # angles near zero
    norms, angles = negatives.angles_to(v, base)
    side = negatives.Side.__new__(negatives.Side)
    side.norms, side.cos, side.sin = norms, np.cos(angles), np.sin(angles)
    low, high = negatives.score_bounds(side, slice(0, 200), side, slice(0, 200))
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high[:5, 5:] - low[:5, 5:] < 2 * np.outer(norms[:5], norms[5:]) * 0.2).all()
