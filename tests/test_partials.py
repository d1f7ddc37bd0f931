"""Merged states: evaluators of one scan, means and covariances, distances and diversity, each against another computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import catalogue
from framewright.operators import partials as M
from framewright.operators import relate as R
from framewright.queries import results

SF = "/root/testdata/sf0.001"


def apart(a, b):
    """The distance with the root of the product of covariances taken by its own eigenvalues."""
    ca, cb = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    roots = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    return ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * roots


def test_frechet_through_the_query_and_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    of = lambda kind, odd: np.array([r.embedding for r in rows if r.label % 3 == kind and r.vec_id % 2 == odd], float)
    got = {r.kind: r.distance for r in catalogue.QUERIES["e41_frechet"](spark, SF).collect()}
    assert got == pytest.approx({k: apart(of(k, 0), of(k, 1)) for k in range(3)}, abs=1e-5)
    # covariances diag(1, 4) and diag(9, 16) and means 3 apart: 9 + (1 - 3)^2 + (2 - 4)^2
    square = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]]) * np.sqrt(3 / 4)
    assert M.frechet(M.spread(square * [1, 2]), M.spread(square * [3, 4] + [3, 0])) == pytest.approx(17)
    assert M.frechet(M.spread(square[:1]), M.spread(square)) is None


def test_heavy_metrics_leave_out_what_does_not_exist(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    side = lambda odd, n: np.array([r.embedding[:n] for r in rows if r.vec_id % 2 == odd], float)
    got = {r.metric: r.value for r in catalogue.QUERIES["e42_heavy_metrics"](spark, SF).collect()}
    assert got == pytest.approx({"fid": apart(side(0, 64), side(1, 64)), "fvd": apart(side(0, 8), side(1, 8))}, abs=1e-5)


def test_distances_without_keys_over_many_tasks(spark):
    x = np.random.default_rng(2).normal(size=(400, 3)) * [1, 2, 3]
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "side int, v array<double>").repartition(20)
    got = M.heavy_metrics({"fid": (df.where("side = 0"), df.where("side = 1"), "v")}).collect()
    assert [(r.metric, r.value) for r in got] == [("fid", pytest.approx(apart(x[::2], x[1::2])))]


def test_wide_vectors_in_many_tasks(spark):
    x = np.random.default_rng(1).normal(size=(300, 150)) * np.arange(1, 151) + 1000
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)] + [(0, None)], "k int, v array<double>").repartition(30)
    cells = {(r.k, r.i, r.j): (r.n, r.mean_i, r.mean_j, r.cov) for r in M.moments(df, ["k"], "v").collect()}
    assert len(cells) == 2 * 150 * 151 // 2
    for k in (0, 1):
        cov, mean = np.cov(x[k::2], rowvar=False), x[k::2].mean(0)
        for i, j in ((0, 0), (0, 149), (7, 100), (149, 149)):
            assert cells[k, i, j] == pytest.approx((150, mean[i], mean[j], cov[i, j]), rel=1e-9)
    assert M.moments(df.limit(0), ["k"], "v").count() == 0
    assert [r.cov for r in M.moments(df.where("k = 5").union(spark.createDataFrame([(5, [1.0])], df.schema)), ["k"], "v").collect()] == [None]


def test_four_evaluators_read_the_table_once(spark, monkeypatch):
    df = results.evaluated_rows(spark, SF).repartition(20)
    plans, real = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or real(x))
    got = {(r.evaluator, r.metric): r.value for r in M.evaluate_all(df, results.EVALUATORS).collect()}
    assert plans[0].count("FileScan") == 1 and not any("FileScan" in p for p in plans[1:])
    assert set(got) == {("size", "quantity"), ("classes", "line_accuracy"), ("classes", "line_iou"), ("ranking", "auc"), ("shape", "pair_norm"), ("shape", "pair_trace")}
    alone = {}
    for name, e in results.EVALUATORS.items():
        state = e.start()
        for batch in df.select(*e.columns).toArrow().to_batches(max_chunksize=777):
            state = e.merge(e.update(e.start(), batch), state)
        alone |= {(name, k): v for k, v in e.evaluate(state).items()}
    assert got == pytest.approx(alone)
    one = {r.metric: r.value for r in M.evaluate_all(df, {"ranking": results.EVALUATORS["ranking"]}).collect()}
    assert one["auc"] == pytest.approx(got["ranking", "auc"])
    assert M.evaluate_all(df.limit(0), results.EVALUATORS).count() == 0
    with pytest.raises(ValueError, match="quantity"):
        M.evaluate_all(df, {"a": M.Mean("quantity", "q"), "b": M.Mean("quantity", "s")})


def test_pair_distance_has_no_pairs_in_its_plan_and_short_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("a", rng.integers(0, 4, 5).astype(float).tolist()) for _ in range(40)] + [("b", [1.0, 2.0, 3.0, 4.0, 5.0])] + [("c", [1.0] * 5)] * 3 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    found = R.pair_distance(df, ["g"], "v")
    got = {r.g: (r.n, r.distance) for r in found.collect()}
    a = np.array([v for g, v in rows if g == "a"], float)
    want = np.mean([np.abs(a[i] - a[j]).sum() for i in range(40) for j in range(i)])
    assert got == {"a": (40, pytest.approx(want)), "b": (1, None), "c": (3, 0.0)}
    assert R.diversity(df, df.select("g", F.lit(0).alias("layer"), "v"), ["g"], "layer", "v").where("g = 'b'").first().score is None
