"""The objective and the classification on seeded features, against numbers computed by hand-written formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jumpmark.operators import blocks, search


@pytest.fixture(scope="module")
def seeded(spark):
    rng = np.random.RandomState(42)
    rows = []
    for i in range(500):
        n, m = int(rng.randint(10, 200)), int(rng.randint(4, 64))
        h_s, rho, h, trans = rng.rand(), rng.rand(), rng.rand() * 6, int(rng.randint(5, 100))
        rows.append((i, n, 256, m, float(h_s), float(rho), float(h), trans, 0))
    assert rows[0][1:4] == (112, 256, 55) and abs(rows[0][6] - 3.591951) < 1e-6 and rows[0][7] == 87
    return spark.createDataFrame(rows, "block_id long, N int, r int, m int, H_s double, rho double, H double, n_trans int, m_eff int")


def test_objective_of_every_configuration(spark, seeded):
    g = search.objective(seeded, search.configs(spark))
    assert g.count() == 32_000
    best = g.orderBy("total", "config_id").first()
    assert best["config_id"] == 0 and best["n_blocks"] == 500
    assert abs(best["total"] - 217539.7376907) < 1e-3 and abs(best["encoding"] - 199614.0609075) < 1e-3 and abs(best["penalty"] - 35851.3535665) < 1e-3
    assert (best["exact"], best["acc_a"], best["acc_b"], best["acc_c"]) == (0.26, 1.0, 1.0, 0.26)
    assert abs(best["mean_penalty"] - 71.7027071) < 1e-6 and abs(best["max_penalty"] - 131.1307878) < 1e-6


def test_optimal_choices(seeded):
    p = search.predicted(seeded)
    count = lambda c: {r[c]: r["count"] for r in p.groupBy(c).count().collect()}
    assert count("ob") == {0: 344, 1: 106, 2: 50} and count("oc") == {1: 477, 4: 23} and count("pa") == {1: 500}
    assert p.where("block_id >= 400").where("pa = oa and pb = ob and pc = oc").count() == 23


def test_representation_switch(spark):
    """From which count of jumps on combinations beat counts, by frames."""
    d = spark.range(1, 257).select(F.col("id").cast("int").alias("N"), F.lit(16).alias("m"), F.lit(2.0).alias("H"), F.lit(5).alias("n_trans"), F.lit(0).alias("m_eff"))
    for r, switch in ((256, 194), (64, 50), (32, 25)):
        p = search.predicted(d.where(F.col("N") <= r - 1).withColumn("r", F.lit(r))).select("N", "oc").collect()
        assert min(x["N"] for x in p if x["oc"] == 4) == switch and all(x["oc"] == 1 for x in p if x["N"] < switch)


def test_kinds(spark):
    rows = [(0, 60, 0, 4, 0.0, [], 0, 0.9, 0.9), (10, 60, 4, 4, 2.0, [3, 3, 2, 2], 9, 0.5, 0.1), (40, 60, 2, 30, 1.0, [20, 20], 20, 0.5, 0.5)]
    f = spark.createDataFrame(rows, "N int, r int, m_eff int, m int, H double, counts array<int>, n_trans int, H_s double, rho double")
    g = f.withColumn("gain", blocks.mono_gain())
    got = g.select("N", blocks.process_kind(F.col("gain")).alias("k"), blocks.five_kinds(F.col("gain"), F.lit(True)).alias("k5"), "gain").orderBy("N").collect()
    assert [r["k"] for r in got] == ["MARKED", "MONO", "MONO"] and [r["k5"] for r in got] == ["JOINT", "MARGINAL", "MARKOV"]
    assert got[0]["gain"] == 0


def test_markov_test_two_states(spark):
    """Yates' correction for two states: the p value of a known table."""
    t = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 0, 9)], "block_id long, h int, j int, n long")
    r = blocks.markov_test(t, 2).first()
    assert r["df"] == 1 and abs(r["chi2"] - (4 * 4.0**2 / 5.5)) < 1e-9 and r["markov"] and 0 < r["p_value"] < 0.001


def test_quadtree_takes_any_cost(spark):
    """A cost that counts squares: leaves cost 10 each, so that nothing is split; one that grows with the area splits everything."""
    cells = spark.range(64).select(F.lit(1).alias("block"), F.lit(0).alias("t"), F.floor(F.col("id") / 8).alias("y"), (F.col("id") % 8).alias("x"), F.lit(0).alias("c"))
    flat = blocks.quadtree(cells, cost=lambda c, k: c.groupBy(*k).agg(F.lit(10.0).alias("bits"))).first()
    steep = blocks.quadtree(cells, cost=lambda c, k: c.groupBy(*k).agg(F.pow(F.count("*"), F.lit(3)).cast("double").alias("bits"))).first()
    assert (flat["bits"], flat["leaves"]) == (10, 1) and steep["leaves"] == 16
