import math
import random

import pytest

import gridspark.llm.topk as K
from gridspark.llm.topk import top_k


def brute(rows, k, every):
    good = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
                   if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted(tuple(r) for r in top_k(df, **kw).collect())


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    monkeypatch.setattr(K, "ROW_BLOCK", 40)
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        v = [rnd.choice([0.0, 0.5, -0.25, 1.0]) if seed else rnd.gauss(0, 1) for _ in range(6)]
        rows.append((i - 20, rows[-1][1] if rows and rnd.random() < 0.3 else v))
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (350, [float("inf")] * 6),
             (None, [1.0] * 6), (400, []), (450, []), (500, [1.0, 2.0]), (501, [2.0, 1.0])]
    assert run(spark, rows, "double", k=5, query_every=10) == brute(rows, 5, 10)


def test_one_common_vector_and_fewer_than_k(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)]
    assert run(spark, rows, k=5, query_every=20) == brute(rows, 5, 20)
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert run(spark, rows, k=5, query_every=2) == brute(rows, 5, 2)


def test_empty_and_extra_columns(spark):
    assert run(spark, [], k=5) == []
    df = spark.createDataFrame([(0, [1.0], 7, "s"), (1, [1.0], 7, "s")], "vec_id long, embedding array<float>, v int, rank string")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 65536)]
    assert len(top_k(df.unionAll(df)).collect()) == 1
