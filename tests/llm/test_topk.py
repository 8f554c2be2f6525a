from __future__ import annotations

import math
import random

import numpy as np
import pytest

from weftline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows: list[tuple], k: int = 5, every: int = 50) -> list[tuple]:
    kept = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for other, (j, v) in enumerate(kept) if other != at and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed: int, n: int, spread: float) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = math.exp(rng.gauss(0, spread))
        v = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, [length * x for x in v], 0))
    return rows


@pytest.mark.parametrize(("spread", "steep"), [(0.0, 0.0), (0.0, 0.5), (1.5, 0.5), (1.5, 2.0)])
def test_against_all_pairs(spark, spread, steep):
    """Equal and very different lengths, with coordinates pruning always, sometimes and never."""
    rows = vectors(1, 700, spread)
    rows += [(1000 + i, rows[3][1], 0) for i in range(12)]  # ties
    settings = topk.Settings(bucket=64, buckets_in_task=2, queries=7, steep=steep)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), settings=settings).collect()
    assert sorted(tuple(r) for r in got) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (50, [0.0, 0.0], 1), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 1),
        (None, [1.0, 1.0], 1), (1, [-1.0, -2.0], None), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (300, [1.0, 2.0, 3.0], 1), (3, [1.0, 1.0, 1.0], 1), (350, [], 1),
        (400, [5000.0, 1.0], 1),
    ]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == slow(rows)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("sent", [1 << 26, 64 * 3])
def test_repeated_rows_are_candidates_and_queries_of_their_own(spark, sent):
    rows = vectors(5, 120, 0.3)
    rows += [rows[50], rows[50], rows[0], rows[7]] + [(100, rows[3][1], 0), (50, [-x for x in rows[50][1]], 0)] + [(0, [0.0] * 8, 0)] * 7
    settings = topk.Settings(bucket=16, buckets_in_task=1, sent_bytes=sent)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), settings=settings).collect()
    assert sorted(tuple(r) for r in got) == slow(rows)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (500, 6)).astype(np.int64)
    v = v[np.argsort(-np.sqrt((v * v).sum(1)), kind="stable")]
    bucket = topk.Bucket(6, np.arange(500, dtype="<i8").tobytes(), v.astype("<i8").tobytes())
    for q in rng.integers(-300, 300, (60, 6)):
        scores = v @ q
        for least in np.sort(scores)[[-1, -5, -50, 10]]:
            near = bucket.near(q, float(np.sqrt((q * q).sum())), float(least), topk.Settings(steep=0.0))
            assert set(np.flatnonzero(scores >= least)) <= set(near.tolist())


def test_other_columns_are_ignored(spark):
    from pyspark.sql import functions as F

    rows = vectors(2, 60, 0.5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("dim", "norm", "v", "copy", "score")})
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == slow(rows)
