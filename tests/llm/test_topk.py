from __future__ import annotations

import math
import random
from dataclasses import replace

from pyspark.sql import functions as F

from appwatch.llm import topk
from appwatch.llm.topk import Params, search


def brute(rows, k, every):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in kept:
        if i % every == 0:
            found = out.setdefault(i, set())
            found.update((-sum(a * b for a, b in zip(q, v)), j, n) for n, (j, v) in enumerate(kept) if j != i and len(v) == len(q))
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    return sorted((i, n + 1, j, clip(-s)) for i, found in out.items() for n, (s, j, _) in enumerate(sorted(found)[:k]))


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def make(seed, n, dim, spread):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        scale = math.exp(rng.gauss(0, spread))
        rows.append((i, [float(scale * (x + rng.gauss(0, 0.2))) for x in c]))
    return rows


def test_equals_brute_force(spark):
    for seed, spread in ((1, 0.05), (2, 1.0)):
        rows = make(seed, 400, 8, spread)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = result(search(df, F.col("vec_id") % 10 == 0, replace(Params(), bucket=32, queries_at_once=7)))
        assert got == brute(rows, 10, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5]), (10, None), (20, [None, 1.0]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (1, [0.0, 0.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 2.0]), (50, [1.0]), (4, [2.0]), (60, []), (5, []),
        (0, [1.0, 0.5]), (70, [-0.3, -0.7]), (6, [1e6, 1e6]), (80, [1e9, -3e9]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as dim")
    for k in (3, 10):
        assert result(search(df, F.col("vec_id") % 10 == 0, replace(Params(), k=k, bucket=3, queries_at_once=2))) == brute(rows, k, 10)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(search(df, F.col("vec_id") == 0, replace(Params(), bucket=8)))
    assert [r[2] for r in got] == list(range(1, 11))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(df, F.col("vec_id") % 100 == 0).count() == 0


def test_vectors_are_sent_for_each_group_of_queries(spark, monkeypatch):
    """Not for each pack: pairs of packs and buckets grow with the square of the table."""
    steps, plain = [], topk.common.map_arrow
    monkeypatch.setattr(topk.common, "map_arrow", lambda df, *rest: steps.append(df) or plain(df, *rest))
    rows = make(3, 400, 8, 0.05)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search(df, F.col("vec_id") % 2 == 0, replace(Params(), bucket=32, queries_at_once=4))
    sent = [F.sum(F.length(name)) for name, kind in steps[-1].dtypes if kind == "binary"]
    assert sum(steps[-1].agg(*sent).first()) < 10 * 400 * 8 * 8  # bytes; 50 packs met 16 buckets of 2 kB


def test_groups_of_queries(spark):
    rows = make(4, 300, 8, 0.5) + [(i, [0.5 * i, -1.0, 2.0]) for i in range(300, 340)] + [(0, [1.0] * 8), (10, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(search(df, F.col("vec_id") % 10 == 0, replace(Params(), bucket=16, queries_at_once=3, held=40, pairs=500)))
    assert got == brute(rows, 10, 10)


def test_single_precision_only_sifts_large_products(spark):
    for size in (3e2, 1e5):  # scores above 2**24, and above 2**52
        rows = [(i, [size * x for x in v]) for i, v in make(5, 200, 6, 0.02)]
        rows += [(i + 200, [x + (0.001 if n == 0 else 0) for n, x in enumerate(v)]) for i, v in rows]
        rows += [(i, [x / size for x in v]) for i, v in make(6, 40, 6, 0.02)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert result(search(df, F.col("vec_id") % 10 == 0, replace(Params(), bucket=64))) == brute(rows, 10, 10)


def test_coordinates_leave_out_nothing(spark):
    rows = [(i, [x + 1e-3 * (i % 7) * (n == i % 8) for n, x in enumerate(v)]) for i, v in make(7, 500, 8, 0.01)]
    rows += [(i + 500, v) for i, v in rows[:100]] + [(999, [0.0] * 8), (1000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for share in (0.0, 1.0):
        params = replace(Params(), bucket=40, k=3, coordinate_from=0.1, coordinate_share=share)
        assert result(search(df, F.col("vec_id") % 10 == 0, params)) == brute(rows, 3, 10)
