import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import modeldata, ranking, robust
from tickloom.operators.quantile import quantiles


@pytest.mark.parametrize("n", [1, 2, 10, 777])
@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_equal_numpy(spark, n, ties):
    r = np.random.default_rng(n)
    x = np.round(r.normal(size=n), 0 if ties else 6)
    d = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "k string, x double")
    qs = {"q05": 0.05, "q30": 0.3, "q75": 0.75, "q99": 0.99}
    got = quantiles(d, ["k"], {k: ("x", q) for k, q in qs.items()}, accuracy=100).filter("k = 'a'").first()
    for k, q in qs.items():
        assert got[k] == pytest.approx(np.percentile(x, q * 100), abs=1e-12), (k, n)


def test_quantile_weighs_both_neighbours(spark):
    """0.7 * 670 is 468.99999999999994: the value lies below the upper neighbour, as in Spark's percentile."""
    rows = [i / 1000 for i in range(468)] + [1.13, 1.131] + [2.0 + i for i in range(201)]
    d = spark.createDataFrame([("a", v) for v in rows] + [("b", 0.1)] * 671, "k string, x double")
    got = {r.k: r.q for r in quantiles(d, ["k"], {"q": ("x", 0.7)}, accuracy=100).collect()}
    want = {r.k: r.q for r in d.groupBy("k").agg(F.percentile("x", 0.7).alias("q")).collect()}
    assert got == want and got["a"] < 1.131 and got["b"] == 0.1


def test_percent_rank_and_auc(spark):
    r = np.random.default_rng(3)
    s, y = np.round(r.random(300), 2), r.integers(0, 2, 300)
    d = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(s, y, strict=True)], "k string, s double, y int")
    got = ranking.percent_rank(d, ["k"], "s", "r").toPandas()
    want = np.array([((s < v).sum() + ((s == v).sum() + 1) / 2) / 300 for v in got.s])
    np.testing.assert_allclose(got.r, want)
    auc = ranking.auc(d, ["k"], "s", "y").first().auc
    p, q = s[y == 1], s[y == 0]
    assert auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in p for b in q]))


def test_p_value(spark):
    d = spark.range(1).select(robust.t_p_value(F.lit(2.0), F.lit(10)).alias("p"), robust.t_p_value(F.lit(1.96), F.lit(1)).alias("q"))
    row = d.first()
    assert row.p == pytest.approx(0.073388, abs=1e-6)
    assert row.q == pytest.approx(2 * (0.5 - np.arctan(1.96) / np.pi), abs=1e-6)


def test_balancing_is_exact_and_repeatable(spark):
    d = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    small = d.filter("y = 1").count()
    for parts in (1, 9):
        u = modeldata.undersample(d.repartition(parts), "y", ["id"])
        assert {r.y: r["count"] for r in u.groupBy("y").count().collect()} == {0: small, 1: small}
    a = sorted(r.id for r in modeldata.undersample(d, "y", ["id"]).collect())
    b = sorted(r.id for r in modeldata.undersample(d.repartition(5), "y", ["id"]).collect())
    assert a == b
    o = modeldata.alternate(d, "y", ["id"]).toPandas()
    assert sorted(o.draw) == list(range(2 * (500 - small)))
    assert (o.draw % 2 == o.y).all()


def test_interpolated_rows_lie_between(spark):
    d = spark.range(60).select(F.col("id").alias("k"), F.lit(1).alias("y"), (F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"))
    p = modeldata.interpolate_minority(d, "y", 1, ["a", "b"], ["k"]).toPandas()
    assert len(p) == 59
    np.testing.assert_allclose(p.b, 2 * p.a)
