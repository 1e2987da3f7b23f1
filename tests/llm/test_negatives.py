import math
import random

import numpy as np
import pytest

import gridspark.llm.negatives as N
from gridspark.llm.negatives import hard_negatives, reaching

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives, negatives, low=30, high=90):
    good = sorted({(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows
                   if i is not None and lab is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, x, lab in good:
        if a % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(x, y)), c, m) for c, y, m in good if c != a and len(x) == len(y))
        for s, c, _ in [o for o in others if o[2] == lab][:positives]:
            window = [o for o in others if o[2] != lab and low * -s <= 100 * -o[0] <= high * -s][:negatives]
            out += [(a, c, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, every, positives, negatives, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, every, positives, negatives, **kw).collect())


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "ANCHOR_BLOCK", 6)
    monkeypatch.setattr(N, "ROW_BLOCK", 50)
    rnd, rows = random.Random(seed), []
    for i in range(180):
        v = [rnd.choice([0.0, 0.5, -0.25, 1.0]) if seed else rnd.gauss(0, 1) for _ in range(20)]
        rows.append((i - 20, rows[-1][1] if rows and rnd.random() < .3 else v, rnd.randrange(3)))
    rows += [(300, None, 1), (301, [None] * 20, 1), (310, [float("nan")] * 20, 1), (320, [1.0] * 20, None),
             (None, [1.0] * 20, 1), (330, [], 1), (340, [], 2), (350, [1.0, 2.0], 1), (351, [2.0, 1.0], 1),
             (352, [1.0, 1.0], 2), (360, [0.0] * 20, 0), rows[30], rows[30], (10, [0.5] * 20, 2)]
    got = run(spark, rows, 10, 3, 4)
    # an id with two vectors has the windows of both
    assert got == brute(rows, 10, 3, 4) and len(got) > 100
    assert run(spark, rows, 10, 2, 500) == brute(rows, 10, 2, 500)     # windows that never fill


def test_index_finds_all_pairs_over_the_threshold():
    rnd = np.random.default_rng(1)
    for d in (0, 1, 7, 40, 100):
        x = rnd.integers(-300, 300, (9, d)) * rnd.integers(0, 2, (9, 1))
        y = (rnd.integers(-300, 300, (60, d)) * np.exp(-np.arange(d) / 5)).astype(np.int64)
        score = x @ y.T
        for q in (0.0, 0.5, 0.9, 1.0):
            t = np.quantile(score, q, axis=1) if d else np.zeros(9)
            i, j, s = reaching(x, y, t)
            assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(score >= t[:, None])))
            assert (s == score[i, j]).all()
        assert len(reaching(x, y, np.full(9, -np.inf))[0]) == 9 * 60


def test_large_components_stay_exact_or_raise(spark):
    big = [(i, [2.0 ** 20 + i, -(2.0 ** 20) + 3 * i, 1.0], i % 2) for i in range(40)]
    assert run(spark, big, 10, 3, 5) == brute(big, 10, 3, 5)
    with pytest.raises(Exception, match="2\\^62"):
        run(spark, [*big, (100, [1e12, 0.0, 0.0], 1)], 10, 3, 5)


def test_hot_vector_clashing_columns_and_empty_table(spark):
    rows = [(i, [0.25, 0.5, 0.0], i % 4) for i in range(400)] + [(i, [0.1 * (i % 7), 0.2, 0.3], i % 4) for i in range(400, 450)]
    assert run(spark, rows, 50, 5, 10) == brute(rows, 50, 5, 10)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id long, v long, t long")
    assert hard_negatives(df, 50).count() == len(brute(rows, 50, 5, 10))
    assert hard_negatives(df.limit(0)).count() == 0
