"""Queries and functions without an oracle: invariants, brute force, known values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from jumpmark import adapters as A
from jumpmark.functions import coding, probability
from jumpmark.operators import frames, prediction, selection
from jumpmark.plans import catalog, choices, fixed


def test_tail_probabilities():
    assert probability.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert probability.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert probability.t_two_sided(1.0, 1) == pytest.approx(0.5)  # Cauchy
    assert probability.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert probability.chi2_tail(10.0, 2) == pytest.approx(math.exp(-5))
    assert probability.f_tail(4.0, 2, 2) == pytest.approx(0.2)
    assert probability.f_tail(4.9646027437, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert probability.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert math.isnan(probability.chi2_tail(1.0, 0))


def test_probability_of_null_is_null(spark):
    got = spark.sql("SELECT CAST(NULL AS double) AS t, 3.0D AS d").select(probability.p_t(F.col("t"), F.col("d")).alias("p")).first()
    assert got["p"] is None


def test_lexicographic_ranks(spark):
    sets = list(combinations(range(8), 3))
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "i int, p array<int>")
    assert all(r["i"] == int(r["k"]) for r in df.select("i", coding.lex_rank(F.col("p"), 8).alias("k")).collect())
    assert [tuple(coding.lex_unrank(i, 3, 8)) for i in range(len(sets))] == sets


def brute_windows(grid, least, most, bits):
    out, at = [], 0
    while at < len(grid):
        best = None
        for end in range(min(at + least, len(grid)), min(at + most, len(grid)) + 1):
            w = grid[at:end]
            m = len(set(w.ravel().tolist()))
            jumps = int((w[1:] != w[:-1]).sum())
            mean = jumps / w.shape[1] + 1
            size = m * bits + m * len(w) + w.shape[1] * mean * max(1, math.ceil(math.log2(max(m, 2))))
            if best is None or size < best[0]:
                best = (size, end)
            if m > 128 and end > at + least:
                break
        out.append((at, best[1], best[0]))
        at = best[1]
    return out


@pytest.mark.parametrize("colors", [2, 16, 300])
def test_adaptive_windows(colors):
    rng = np.random.default_rng(5)
    calm = np.repeat(rng.integers(0, 2, (4, 40)), 10, axis=0)
    grid = np.concatenate([calm, rng.integers(0, colors, (30, 40)), calm[:3]])
    jumps = np.concatenate([[0], (grid[1:] != grid[:-1]).sum(axis=1)])
    got = [(i, j, b) for i, j, _, _, b in prediction._windows(grid, jumps, 4, 32, 8)]
    want = brute_windows(grid, 4, 32, 8)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_windows_cover_time(spark, sf):
    n = {r["block"]: r["n"] for r in A.grid_emb(spark, sf).groupBy("block").agg(F.count_distinct("t").alias("n")).collect()}
    got = catalog.QUERIES["adaptive_windows"](spark, sf).groupBy("block").agg(F.min("i").alias("a"), F.max("j").alias("b"), F.sum(F.col("j") - F.col("i")).alias("s")).collect()
    assert {r["block"]: (r["a"], r["b"], r["s"]) for r in got} == {k: (0, v, v) for k, v in n.items()}
    assert catalog.QUERIES["window_boundaries"](spark, sf).where("bits < windows").count() == 0


def test_median_cut(spark, sf):
    rows = catalog.QUERIES["median_cut_palette"](spark, sf).collect()
    assert sum(r["n"] for r in rows) == A.table(spark, sf, "part").count()
    assert 1 < len(rows) <= 16
    one = spark.createDataFrame([(5, 5, 5)] * 7, "r int, g int, b int")
    assert frames.median_cut(one, ("r", "g", "b")).select("box").distinct().count() == 1


def test_reports(spark, sf):
    for r in catalog.QUERIES["pair_report"](spark, sf).collect():
        assert 0 <= r["p"] <= 1 and r["effect"] in ("negligible", "small", "medium", "large")
    tests = {r["test"]: r for r in catalog.QUERIES["group_tests"](spark, sf).collect()}
    assert set(tests) == {"anova", "kruskal"} and all(0 <= r["p"] <= 1 for r in tests.values())
    for r in catalog.QUERIES["rate_verdict"](spark, sf).collect():
        assert (r["bd_rate"] < 0) == (r["verdict"] in ("better", "much better"))


def test_simulation(spark, sf):
    assert catalog.QUERIES["simulation_grid"](spark, sf).count() == 384
    rows = catalog.QUERIES["simulation_summary"](spark, sf).collect()
    assert len(rows) == len(choices.generate.FAMILIES) and all(0 <= r["l4_best"] <= 1 for r in rows)


def test_zone(spark):
    got = spark.range(2, 40).select(F.col("id").cast("int").alias("r")).select("r", selection.zone_exists(F.col("r")).alias("z")).collect()
    for r in got:
        h = r["r"] // 2
        assert r["z"] == (r["r"] >= 30 or math.log2(h + 1) + math.log2(math.comb(r["r"], h)) > r["r"])


def test_markov_marks(spark, sf):
    rows = {(r["h"], r["j"]): r["n"] for r in catalog.QUERIES["markov_marks"](spark, sf).collect()}
    total = sum(rows.values())
    stays = sum(n for (h, j), n in rows.items() if h == j)
    assert total > 300 and 0.7 < stays / total < 0.9


def test_rule_loop(spark, sf):
    rows = catalog.QUERIES["rule_loop"](spark, sf).orderBy("step").collect()
    assert [r["rule"] for r in rows] == [name for _, name in sorted((axis, name) for name, axis, _, _ in fixed.RULES)]
    assert all(r["kept"] == (r["gain"] > 0.001 and r["regressions"] == 0) for r in rows)
    # the first rule is measured against nothing; of the others only whole block sides change anything
    assert all(r["gain"] == 0 for r in rows[1:] if r["rule"] not in ("block_4x4", "block_16x16"))


def test_rule_loop_stops(spark):
    from jumpmark.operators import search

    worse = spark.createDataFrame([("v", 9.0, 0.5)], "video string, bpp double, ratio double")
    log = search.rule_loop(spark, [(1, f"r{i}") for i in range(9)], lambda name, kept: worse).collect()
    assert len(log) == 5 and not any(r["kept"] for r in log)


def test_containers(spark, tmp_path):
    from jumpmark.sources import stores

    head = (64, 48, 32, 25.0, 16, 8, 2)
    data = stores.build_container(head, [(0, 0, 0), (255, 128, 1)], [b"ab", b"", b"xyz"])
    assert stores.parse_container(data) == (1, head, [(0, 0, 0), (255, 128, 1)], [b"ab", b"", b"xyz"])
    (tmp_path / "a.lmd").write_bytes(data)
    (tmp_path / "b.lmd").write_bytes(data[:-2])
    (tmp_path / "c.lmd").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(data)
    rows = stores.containers(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None]
    assert sorted((r["block"], bytes(r["payload"]), r["columns"], r["rows"], r["frames"], r["fps"]) for r in good) == [(0, b"ab", 64, 48, 32, 25.0), (1, b"", 64, 48, 32, 25.0), (2, b"xyz", 64, 48, 32, 25.0)]
    assert sorted(r["error"] for r in rows if r["error"]) == ["container ends early", "no block container"]


def test_tables(spark):
    from jumpmark.sources import reports

    df = spark.createDataFrame([("a_b", 1.23456, None), ("<c>", 2.0, 7)], "name string, v double, n long")
    assert reports.text_table(df, 2).split("\n")[2] == "a_b   1.23"
    assert "<td>&lt;c&gt;</td><td>2.000</td><td>7</td>" in reports.html_table(df)
    assert r"a\_b & 1.235 &  \\" in reports.latex_table(df)
    page = reports.html_report("T & U", {"one": df, "two": "x < y"})
    assert "<title>T &amp; U</title>" in page and "<p>x &lt; y</p>" in page
    with pytest.raises(ValueError, match="rows"):
        reports.text_table(spark.range(reports.MOST_ROWS + 1))


def test_windowed_ssim_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 16, (9, 10)), rng.integers(0, 16, (9, 10))
    rows = [(1, 0, y, x, int(a[y, x]), int(b[y, x])) for y in range(9) for x in range(10)]
    got = frames.windowed_ssim(spark.createDataFrame(rows, "block int, t int, y int, x int, c int, p int")).first()
    c1, c2, want = 0.15**2, 0.45**2, []
    for y in range(3):
        for x in range(4):
            u, v = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            cov = np.cov(u, v)
            want.append((2 * u.mean() * v.mean() + c1) * (2 * cov[0, 1] + c2) / ((u.mean() ** 2 + v.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    assert got["windows"] == 12 and got["ssim"] == pytest.approx(np.mean(want))
