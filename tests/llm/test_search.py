import math

import numpy as np
from pyspark.sql import functions as F

from ordermart.llm import topk_search
from ordermart.llm.queries import QUERIES

from .conftest import SF


def brute(given, every=50, k=5):
    rows = []
    for i, v in given:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, [math.floor(256 * float(x)) for x in v]))
    for q, v in rows:
        if q % every == 0:
            scores = [
                (-sum(a * b for a, b in zip(v, w)), i)
                for i, w in rows if i != q and len(v) == len(w)
            ]
            for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
                yield q, rank, i, -s


def check(spark, given, **options):
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    frame = frame.selectExpr("*", "'x' AS v", "'x' AS shard", "'x' AS is_query", "'x' AS uid")
    found = topk_search.search(frame, F.col("vec_id") % 50 == 0, **options).collect()
    assert sorted(map(tuple, found)) == sorted(brute(given))


def test_awkward_rows(spark):
    nan = float("nan")
    given = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (100, [0.5]), (150, None), (200, [nan, 1.0]),
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, -0.001]), (None, [9.0, 9.0]),
        (4, [None, 1.0]), (5, []), (250, [float("inf"), 0.0]), (300, [1e6, -1e6]), (6, [3e7, 1.0]),
    ]
    check(spark, given)
    check(spark, [])


def test_ties_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    given = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(700)]
    check(spark, given, shard_rows=20, query_rows=3)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    given = [(i, (rng.standard_normal(6) * 1e5).tolist()) for i in range(120)]
    given = [(i, np.float32(v).tolist()) for i, v in given]
    check(spark, given)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = QUERIES["op7_topk_search"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(brute([tuple(r) for r in rows]))
