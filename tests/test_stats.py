"""Published cell counts and hand-made cases."""

import pytest
from pyspark.sql import functions as F

from partloom.operators import evalstats as es

GOLD = [(47, 23, 7.5571, 0.0059773), (44, 27, 3.6056, 0.0575841), (25, 105, 48.0077, 4.2455e-12), (85, 12, 53.4433, 2.66165e-13), (11, 0, 9.0909, 0.0025688), (0, 59, 57.0169, 4.3207e-14), (0, 0, 0.0, 1.0)]


def test_mcnemar_goldens(spark):
    df = spark.createDataFrame([(b, c) for b, c, _, _ in GOLD], "b long, c long").coalesce(1)
    df = df.withColumn("chi2", es.mcnemar_chi2(F.col("b"), F.col("c")))
    for row, (_, _, chi2, p) in zip(df.withColumn("p", es.chi2_p(F.col("chi2"))).collect(), GOLD, strict=True):
        assert row.chi2 == pytest.approx(chi2, abs=5e-5) and row.p == pytest.approx(p, rel=1e-4)


def test_bounds(spark):
    x = es.mcnemar_bounds(F.col("a"), F.col("b"), F.col("n"))
    df = spark.createDataFrame([(363, 526, 558), (363, 502, 558)], "a long, b long, n long").select(x["min_chi2"].alias("m"))
    assert [r.m for r in df.collect()] == [pytest.approx(115.612, abs=1e-2), pytest.approx(75.8725, abs=1e-2)]


def test_binary_and_empty(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "y int, pred int")
    r = es.binary_summary(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 2) and r.accuracy == pytest.approx(0.6)
    none = es.binary_summary(df.where("y > 5")).first()
    assert none.accuracy == 0 and none.mcc == 0


def test_auroc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert es.auroc(df, "s", F.col("y") == 1).first().auroc == pytest.approx(0.875)
    assert es.auroc(df.where("y = 1"), "s", F.col("y") == 1).first().auroc is None


def test_ece_leaves_out_zero_and_uses_half_open_bins(spark):
    df = spark.createDataFrame([(0.0, 1), (0.30000000000000004, 1), (1.0, 0)], "c double, ok int")
    assert sorted((r.bin, r.n) for r in es.reliability(df, "c", F.col("ok") == 1).collect()) == [(2, 1), (9, 1)]


def test_bootstrap_covers_the_difference(spark):
    df = spark.createDataFrame([(i % 10 < 8, i % 10 < 6) for i in range(1000)], "a boolean, b boolean")
    r = es.bootstrap_ci(df, F.col("a"), F.col("b"), replicates=400).first()
    assert r.replicates == 400 and r.low < 0.2 < r.high and r.low > 0.15
    again = es.bootstrap_ci(df, F.col("a"), F.col("b"), replicates=400).first()
    assert (r.low, r.high) == (again.low, again.high)


def test_top3_and_topk(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.2, 0.1], 2), ([0.1, 0.1, 0.1, 0.7], 2)], "p array<double>, y int")
    got = df.select(es.top3(F.col("p")).alias("t")).first().t
    assert [x.cls for x in got] == [1, 0, 2]
    assert es.top_k_accuracy(df, "p", "y", 3).first().accuracy == 0.5


def test_multiclass_perfect_and_dense(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 2)], "y int, pred int")
    r = es.multiclass_agreement(es.confusion(df)).first()
    assert r.mcc == pytest.approx(1) and r.kappa == pytest.approx(1)
    classes = spark.createDataFrame([(i,) for i in range(4)], "cls int")
    cells = es.dense_confusion(df, classes, fallback=3)
    assert cells.count() == 16 and cells.agg(F.sum("n")).first()[0] == 4
