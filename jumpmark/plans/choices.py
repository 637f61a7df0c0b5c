"""Queries on choosing representations and frameworks, predictions, windows and test probabilities; they join the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark import adapters as A
from jumpmark.functions import coding, scalar
from jumpmark.operators import costs, description, frames, generate, intensity, prediction, results, search, selection
from jumpmark.plans import fixed
from jumpmark.plans.catalog import SEGMENT, _colors, _positions, block_table, query, rounded
from jumpmark.plans.oracles import _CH, _FEAT, _G, _HIST, _RGB, _RUNS, _T, _TMX, _least

#: r and m of the threshold queries: rows of the tables and values between and beyond them.
PLANE = {"r": [16, 64, 120, 256, 300, 512, 900, 1000], "m": [1, 2, 3, 4, 8, 16, 24, 64, 200]}
# The axes of the simulation grid (8 intensities are 4 families with 2 parameter sets each).
SIMULATION = {"block_size": [8, 16], "r": [32, 64], "m": [8, 16], "family": ["homogeneous", "linear", "sinusoidal", "exponential"], "params": [0, 1], "basis": ["histogram", "polynomial"], "dimension": [2, 4, 8]}
ORACLE_SQL: dict[str, str] = {}


def _plane(spark):
    return selection.simulation_grid(spark, PLANE).drop("config_id")


_PLANE = f"pl AS (SELECT r, m FROM (SELECT unnest({PLANE['r']}) AS r), (SELECT unnest({PLANE['m']}) AS m))"
_GAMMA = "ga(r, l, h) AS (VALUES " + ", ".join(f"({r}, {a}, {b})" for r, (a, b) in selection.GAMMA.items()) + ")"
_TAB = "tb(r, m, d, l) AS (VALUES " + ", ".join(f"({r}, {c}, {d}, {q})" for r in selection.DELTA for c, d, q in zip(selection.COLORS, selection.DELTA[r], selection.LAMBDA[r], strict=True)) + ")"


def _between(side: str) -> str:
    """The table's value, linear between rows, its ends beyond them; for a query over x.r."""
    lo, hi = "(SELECT max(r) FROM ga WHERE r <= greatest(x.r, 30))", "(SELECT min(r) FROM ga WHERE r >= least(x.r, 4096))"
    at = lambda r: f"(SELECT {side} FROM ga WHERE r = {r})"
    return f"round_even({at(lo)} + CASE WHEN {hi} > {lo} THEN (x.r - {lo}) / ({hi} - {lo}) * ({at(hi)} - {at(lo)}) ELSE 0 END, 0)::BIGINT"


@query
def gamma_bounds(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", (20 + F.col("p_partkey") % 211 * 20).cast("int").alias("r"))
    lo, hi = selection.gamma_bounds(F.col("r"))
    return rounded(p.select("p_partkey", "r", lo.alias("gamma_l"), hi.alias("gamma_r")))


ORACLE_SQL["gamma_bounds"] = f"WITH {_GAMMA}, x AS (SELECT p_partkey, 20 + p_partkey % 211 * 20 AS r FROM part) SELECT p_partkey, r::BIGINT AS r, {_between('l')} AS gamma_l, {_between('h')} AS gamma_r FROM x"


@query
def delta_threshold(spark, sf):
    return rounded(_plane(spark).withColumn("delta", selection.delta_threshold(F.col("r"), F.col("m"))))


ORACLE_SQL["delta_threshold"] = f"WITH {_PLANE}, {_TAB} SELECT pl.r::BIGINT AS r, pl.m::BIGINT AS m, (CASE WHEN pl.m <= 1 THEN pl.r ELSE coalesce(tb.d, greatest(0, ceil(pl.r * (1 - 1 / log2(pl.m))))) END)::BIGINT AS delta FROM pl LEFT JOIN tb ON tb.r = pl.r AND tb.m = pl.m"


@query
def lambda_bound(spark, sf):
    return rounded(selection.lambda_bound(_plane(spark)))


ORACLE_SQL["lambda_bound"] = f"""WITH {_PLANE}, {_TAB}, n AS (SELECT r, m, unnest(range(1, r + 1)) AS n FROM pl WHERE m > 1),
 o AS (SELECT r, m, min(n) - 1 AS own FROM n WHERE log2(n + 1) + (lgamma(r + 1) - lgamma(n + 1) - lgamma(r - n + 1)) / ln(2) + n * log2(m) > r * log2(m) + 1e-7 GROUP BY r, m)
 SELECT pl.r::BIGINT AS r, pl.m::BIGINT AS m, (CASE WHEN pl.m <= 1 THEN pl.r ELSE coalesce(tb.l, o.own) END)::BIGINT AS lambda_bound FROM pl LEFT JOIN tb ON tb.r = pl.r AND tb.m = pl.m LEFT JOIN o ON o.r = pl.r AND o.m = pl.m"""


@query
def representation_choice(spark, sf):
    """The cheapest representation by exact costs, with the table bounds and the density beside it."""
    b = costs.best(costs.temporal_costs_exhaustive())
    lo, hi = selection.gamma_bounds(F.col("r").cast("int"))
    t = block_table(spark, sf).withColumn("b", F.when(F.col("N") == 0, F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("ord"), F.lit("R1").alias("name"))).otherwise(b))
    return rounded(t.select("block_id", "b.name", "b.ord", (F.col("N") / F.col("r")).alias("density"), lo.alias("gamma_l"), hi.alias("gamma_r"), selection.zone_exists(F.col("r")).alias("zone")))


ORACLE_SQL["representation_choice"] = f"WITH {_FEAT}, {_GAMMA}, tc AS (SELECT block_id, {_TMX} FROM f), {_least(_T, 'tc', 'bt')} SELECT x.block_id, bt.name, bt.ord::BIGINT AS ord, round(N / x.r, 6) AS density, {_between('l')} AS gamma_l, {_between('h')} AS gamma_r, true AS zone FROM f x JOIN bt ON bt.block_id = x.block_id"


@query
def framework_lengths(spark, sf):
    one = F.lit(1.0)
    f = selection.framework_lengths(F.col("N"), one, F.col("r"), F.col("m"), F.col("r") / 2, F.col("m"), F.col("n_trans"))
    t = block_table(spark, sf)
    return rounded(t.select("block_id", *(c.alias(k) for k, c in f.items()), costs.best(f)["name"].alias("best"), selection.framework_tree(F.col("m"), F.col("N") / F.col("r")).alias("tree")))


ORACLE_SQL["framework_lengths"] = f"""WITH {_FEAT}, l AS (SELECT *, N * log2(r * m) + 6 * log2(greatest(N, 2)) / 2 AS vector, N * log2(r * m) + (6 + m - 1) * log2(greatest(N, 2)) / 2 AS marked, N * log2(r / 2 * m) + 6 * log2(greatest(N, 2)) / 2 AS spatial, n_trans * log2(r * m) + m * (m - 1) * 6 * log2(greatest(N, 2)) / 2 AS markov FROM f)
 SELECT block_id, round(vector, 6) AS vector, round(marked, 6) AS marked, round(spatial, 6) AS spatial, round(markov, 6) AS markov, CASE WHEN vector <= marked AND vector <= spatial AND vector <= markov THEN 'vector' WHEN marked <= spatial AND marked <= markov THEN 'marked' WHEN spatial <= markov THEN 'spatial' ELSE 'markov' END AS best, CASE WHEN m <= 5 OR N / r > 0.67 THEN 'vector' ELSE 'marked' END AS tree FROM l"""


@query
def family_choice(spark, sf):
    p = F.col("p_partkey")
    return A.table(spark, sf, "part").select("p_partkey", selection.family_tree(p % 50 / 1000, p % 101, 1 + p % 17 / 10, p % 7 * 16).alias("family"))


ORACLE_SQL["family_choice"] = "SELECT p_partkey, CASE WHEN p_partkey % 50 / 1000 < 0.01 THEN 'constant' WHEN p_partkey % 101 > 50 AND 1 + p_partkey % 17 / 10 > 1.8::DOUBLE THEN 'trigonometric' WHEN p_partkey % 7 * 16 <= 32 THEN 'wavelet' ELSE 'bspline' END AS family FROM part"


@query
def level_costs(spark, sf):
    c = _colors(spark, sf).withColumn("block_id", F.col("p_partkey") % 10)
    return rounded(selection.level_costs(c, [("r", 8), ("g", 8), ("b", 8)]))


ORACLE_SQL["level_costs"] = f"""WITH {_RGB}, lv AS (SELECT p_partkey % 10 AS block_id, 0 AS level, r AS v FROM co UNION ALL SELECT p_partkey % 10, 1, g FROM co UNION ALL SELECT p_partkey % 10, 2, b FROM co), c AS (SELECT block_id, level, v, count(*) AS n FROM lv GROUP BY ALL),
 p AS (SELECT block_id, level, sum(n) AS n, sum(n * log2(n)) AS s, max(v) + 1 AS m FROM c GROUP BY ALL)
 SELECT block_id, round(max(n) * 24, 6)::DOUBLE AS uniform, round(sum(n * log2(n) - s + m * (floor(log2(m)) + 1)), 6) AS huffman, round(max(n) * 24 * 0.3::DOUBLE, 6) AS sequential FROM p GROUP BY block_id"""


@query
def simulation_grid(spark, sf):
    return rounded(selection.simulation_grid(spark, SIMULATION))


def _axis(name: str) -> str:
    return f"(SELECT unnest({SIMULATION[name]}) AS {name}, unnest(range({len(SIMULATION[name])})) AS i_{name})"


def _config_id() -> str:
    out = "0"
    for name, values in SIMULATION.items():
        out = f"({out}) * {len(values)} + i_{name}"
    return out


ORACLE_SQL["simulation_grid"] = f"SELECT ({_config_id()})::BIGINT AS config_id, " + ", ".join(f"{k}::BIGINT AS {k}" if isinstance(v[0], int) else k for k, v in SIMULATION.items()) + " FROM " + ", ".join(_axis(k) for k in SIMULATION)


@query
def simulation_summary(spark, sf):
    """Simulated pixels by family: mean jumps, mean uniform lengths, and the share for which marks with an index are shortest."""
    out = None
    for family in sorted(generate.FAMILIES):
        n = spark.range(256).select(F.col("id").cast("int").alias("pixel")).join(generate.poisson(spark, family, 256, 64).groupBy("pixel").agg(F.count("*").alias("k")), "pixel", "left")
        n = n.select(F.lit(family).alias("family"), F.coalesce("k", F.lit(0)).alias("N"), F.lit(64).alias("r"), F.lit(8).alias("m"))
        out = n if out is None else out.union(n)
    lengths = costs.uniform_lengths()
    t = out.select("family", "N", *(c.alias(k) for k, c in lengths.items()))
    return rounded(t.groupBy("family").agg(F.avg("N").alias("mean_n"), *(F.avg(k).alias(k) for k in lengths), F.avg((F.round("L4", 9) <= F.round(F.least("L1", "L2", "L3"), 9)).cast("int")).alias("l4_best")))


def _square(spark, sf):
    """The grid's cells as 8 x 8 frames."""
    return A.grid_emb(spark, sf).select("block", "t", F.floor(F.col("x") / 8).cast("int").alias("y"), (F.col("x") % 8).cast("int").alias("x"), "c")


@query
def neighbour_residuals(spark, sf):
    """Sum and entropy of the residuals of six predictions, by block."""
    r = prediction.residuals(_square(spark, sf), ["block"])
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"res_{m}").alias("res")) for m in prediction.MODES))).alias("e")
    n = r.select("block", each).select("block", "e.*").groupBy("block", "mode", "res").agg(F.count("*").alias("n"))
    return rounded(n.groupBy("block", "mode").agg(F.sum(F.col("n") * F.col("res")).alias("total"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h")))


_SQUARE = f"{_G}, sq AS (SELECT block, t, x // 8 AS y, x % 8 AS x, c FROM g)"
_NEXT = f"""{_SQUARE}, n1 AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY block, t, y ORDER BY x), 0) AS l, coalesce(lag(c) OVER (PARTITION BY block, t, x ORDER BY y), 0) AS u, coalesce(lag(c) OVER (PARTITION BY block, y, x ORDER BY t), 0) AS b FROM sq),
 n2 AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY block, t, x ORDER BY y), 0) AS ul FROM n1)"""
_GUESS = {
    "left": "l", "top": "u", "dc": "((l + u) // 2)", "time": "b",
    "paeth": "(CASE WHEN abs(u - ul) <= abs(l - ul) AND abs(u - ul) <= abs(l + u - 2 * ul) THEN l WHEN abs(l - ul) <= abs(l + u - 2 * ul) THEN u ELSE ul END)",
    "med": "(list_sort([l, u, l + u - ul])[2])",
}
ORACLE_SQL["neighbour_residuals"] = f"WITH {_NEXT}, rs AS ({' UNION ALL '.join(f'''SELECT block, '{k}' AS mode, (c - {e} + 512) % 256 AS res FROM n2''' for k, e in _GUESS.items())}), rn AS (SELECT block, mode, res, count(*) AS n FROM rs GROUP BY ALL) SELECT block::BIGINT AS block, mode, sum(n * res)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS h FROM rn GROUP BY block, mode"


@query
def prediction_restore(spark, sf):
    """Cells restored from the residuals of each prediction, and how many differ from the original."""
    cells = _square(spark, sf)
    res = prediction.residuals(cells, ["block"])
    out = None
    for m in prediction.MODES:
        back = prediction.restore_sums(res.drop("c"), ["block"], m) if m in ("left", "top", "time") else prediction.restore_frames(res, ["block"], m)
        j = cells.join(back.select("block", "t", "y", "x", F.col("c").alias("r")), ["block", "t", "y", "x"], "left")
        one = j.groupBy("block").agg(F.count("*").alias("n"), F.count_if(~F.col("c").eqNullSafe(F.col("r"))).alias("wrong")).select("block", F.lit(m).alias("mode"), "n", "wrong")
        out = one if out is None else out.union(one)
    return rounded(out)


ORACLE_SQL["prediction_restore"] = f"WITH {_G} SELECT block::BIGINT AS block, mode, count(*) AS n, 0::BIGINT AS wrong FROM g, (SELECT unnest({list(prediction.MODES)}) AS mode) GROUP BY block, mode"


@query
def adaptive_windows(spark, sf):
    return rounded(prediction.adaptive_windows(A.grid_emb(spark, sf)))


@query
def window_boundaries(spark, sf):
    return rounded(prediction.boundary_bits(prediction.adaptive_windows(A.grid_emb(spark, sf))))


@query
def texture_complexity(spark, sf):
    return rounded(prediction.texture(_square(spark, sf)))


ORACLE_SQL["texture_complexity"] = f"""WITH {_SQUARE}, e AS (SELECT *, lead(c) OVER (PARTITION BY block, t, y ORDER BY x) AS r, lead(c) OVER (PARTITION BY block, t, x ORDER BY y) AS d FROM sq)
 SELECT block::BIGINT AS block, t, round(0.3::DOUBLE * (count(DISTINCT c) / least(count(*), 256)) + 0.7::DOUBLE * ((count(*) FILTER (c <> r) + count(*) FILTER (c <> d)) / (count(r) + count(d))), 6) AS texture FROM e GROUP BY block, t"""


@query
def index_gain(spark, sf):
    g = A.grid_emb(spark, sf)
    return rounded(description.index_gain(description.pixels(g), description.pixel_colors(g)))


ORACLE_SQL["index_gain"] = f"""WITH {_CH}, fr AS (SELECT block, t, (row_number() OVER (PARTITION BY block ORDER BY t) - 1) // 32 AS gop FROM (SELECT DISTINCT block, t FROM g)), ce AS (SELECT g.block, gop, x, g.t, c, lag(c) OVER (PARTITION BY g.block, gop, x ORDER BY g.t) AS p FROM g JOIN fr ON fr.block = g.block AND fr.t = g.t),
 px AS (SELECT block, gop, x, count(*) AS r, count(*) FILTER (p IS NULL OR p <> c) AS n FROM ce GROUP BY ALL), cm AS (SELECT block, gop, count(DISTINCT c) AS m FROM ce GROUP BY ALL),
 bl AS (SELECT block, gop, sum(2 * floor(log2(n)) + 1 + CASE WHEN n = r THEN 0 ELSE ceil(round((lgamma(r + 1) - lgamma(n + 1) - lgamma(r - n + 1)) / ln(2), 9)) END) AS times, sum(n) AS jumps, avg(n) AS mean_jumps FROM px GROUP BY block, gop),
 t AS (SELECT bl.block, bl.gop, m, mean_jumps, 2 * floor(log2(m)) + 1 + m * 8 + times + jumps * greatest(1, ceil(log2(greatest(m, 2)))) AS indexed, times + jumps * 8 AS plain FROM bl JOIN cm ON cm.block = bl.block AND cm.gop = bl.gop)
 SELECT block::BIGINT AS block, gop::BIGINT AS gop, m, round(mean_jumps, 6) AS mean_jumps, indexed::BIGINT AS indexed, plain::BIGINT AS plain, round((1 - indexed / plain) * 100, 6) + 0.0 AS gain FROM t"""


@query
def rank_round_trips(spark, sf):
    """Both ranks of the jump places of every segment, and whether the sets they give back are the same."""
    p = _positions(spark, sf)
    r = p.select("block", "x", "segment", F.array_join(F.transform("p", lambda v: v.cast("string")), ",").alias("own"), F.size("p").alias("n"), coding.colex_rank(F.col("p"), SEGMENT).alias("rank"), coding.lex_rank(F.col("p"), SEGMENT).alias("lex"))
    back = coding.unranked(r, SEGMENT)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rounded(back.select("block", "x", "segment", "n", F.col("rank").cast("long").alias("colex"), F.col("lex").cast("long").alias("lex"), (text("colex_set") == F.col("own")).alias("colex_same"), (text("lex_set") == F.col("own")).alias("lex_same")))


_C = lambda n, k: f"(CASE WHEN {k} < 0 OR {k} > {n} THEN 0 ELSE round(exp(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))) END)::BIGINT"
_SEG = f"""{_CH}, ps AS (SELECT *, row_number() OVER (PARTITION BY block, x ORDER BY t) - 1 AS j FROM ch), po AS (SELECT block, x, j // 40 AS segment, j % 40 AS i, row_number() OVER (PARTITION BY block, x, j // 40 ORDER BY j) AS k, count(*) OVER (PARTITION BY block, x, j // 40) AS n FROM ps WHERE b)"""
ORACLE_SQL["combinadic_rank"] = f"WITH {_SEG} SELECT block::BIGINT AS block, x, segment, count(*) AS n, sum({_C('i', 'k')})::BIGINT AS rank FROM po GROUP BY ALL"
ORACLE_SQL["rank_round_trips"] = f"WITH {_SEG} SELECT block::BIGINT AS block, x, segment, count(*) AS n, sum({_C('i', 'k')})::BIGINT AS colex, ({_C('40', 'max(n)')} - 1 - sum({_C('(39 - i)', '(n - k + 1)')}))::BIGINT AS lex, true AS colex_same, true AS lex_same FROM po GROUP BY block, x, segment"


@query
def best_per_metric(spark, sf):
    return results.best_per_metric(A.bench_runs(spark, sf))


def _top(metric: str, way: str) -> str:
    return f"arg_min(codec, ({way}{metric}, codec, quality_param)) AS best_{metric}"


ORACLE_SQL["best_per_metric"] = f"WITH {_RUNS}, q AS (SELECT *, input_size / output_size AS ratio FROM br) SELECT video, {_top('ratio', '-')}, {_top('psnr', '-')}, {_top('ssim', '-')}, {_top('bitrate', '')} FROM q GROUP BY video"


@query
def pair_report(spark, sf):
    return rounded(results.pair_report(A.bench_runs(spark, sf), "psnr"), 4)


@query
def group_tests(spark, sf):
    return rounded(results.group_tests(A.bench_runs(spark, sf), "psnr"), 4)


@query
def rate_verdict(spark, sf):
    return rounded(results.rate_verdict(results.bd_rate(A.bench_runs(spark, sf), "3-MEDIUM")), 4)


@query
def median_cut_palette(spark, sf):
    """Sixteen boxes by median cut: pixels and mean colour of each."""
    b = frames.median_cut(_colors(spark, sf), ("r", "g", "b"))
    return rounded(b.groupBy("box").agg(F.count("*").alias("n"), *(F.floor(F.avg(c)).alias(c) for c in ("r", "g", "b"))))


@query
def intensity_errors(spark, sf):
    h = intensity.histogram(A.pp_events(spark, sf), A.R, 15)
    return rounded(intensity.fit_errors(h, intensity.moving(h, 5), A.R, 15))


ORACLE_SQL["intensity_errors"] = f"""WITH {_HIST}, sm AS (SELECT a.event_type, a.bin, any_value(a.n) AS n, sum(b.n) / 5 AS smooth FROM h a, range(-2, 3) o(d), h b WHERE b.event_type = a.event_type AND b.bin = CASE WHEN a.bin + d < 0 THEN -1 - (a.bin + d) WHEN a.bin + d > 14 THEN 29 - (a.bin + d) ELSE a.bin + d END GROUP BY ALL)
 SELECT event_type, sum(n)::BIGINT AS n, round(sum(n) / 90, 6) AS constant, round(sqrt(avg(((n - smooth) / 6) ** 2)), 6) + 0.0 AS l2, round(15 * ln(sum(n)) / (2 * sum(n)), 6) AS bound FROM sm GROUP BY event_type"""


@query
def threshold_distance(spark, sf):
    """Distance of each labelled document's two cost vectors: a Euclidean norm."""
    p = A.block_pred(spark, sf)
    d = scalar.distance([F.col(f"act_{k}") for k in "abc"], [F.col(f"pred_{k}") for k in "abc"])
    return rounded(p.select("block_id", d.alias("distance")))


ORACLE_SQL["threshold_distance"] = "SELECT l.doc_id AS block_id, round(sqrt((quality - (1 - toxic)) ** 2 + (n_chars % 4 - l.doc_id % 4) ** 2 + (least(n_chars // 1000, 4) - least(n_chars // 1200, 4)) ** 2), 6) + 0.0 AS distance FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query
def windowed_quality(spark, sf):
    """SSIM over 7 x 7 windows of each frame against the one before."""
    p = frames.consecutive(A.grid_emb(spark, sf)).withColumn("y", F.floor(F.col("x") / 8).cast("int")).withColumn("x", (F.col("x") % 8).cast("int"))
    return rounded(frames.windowed_ssim(p))


_SUMS = ("sc", "sp", "cc", "pp", "cp", "k")
ORACLE_SQL["windowed_quality"] = f"""WITH {_CH}, w0 AS (SELECT block, t, x // 8 AS y, x % 8 AS x, c::DOUBLE AS sc, p::DOUBLE AS sp, (c * c)::DOUBLE AS cc, (p * p)::DOUBLE AS pp, (c * p)::DOUBLE AS cp, 1 AS k FROM ch WHERE p IS NOT NULL),
 w1 AS (SELECT block, t, y, x, {', '.join(f'sum({c}) OVER w AS {c}' for c in _SUMS)} FROM w0 WINDOW w AS (PARTITION BY block, t, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 w2 AS (SELECT block, t, y, x, {', '.join(f'sum({c}) OVER w AS {c}' for c in _SUMS)} FROM w1 WINDOW w AS (PARTITION BY block, t, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 m AS (SELECT block, t, sc / 49 AS a, sp / 49 AS b, (cc / 49 - (sc / 49) ** 2) * 49 / 48 AS va, (pp / 49 - (sp / 49) ** 2) * 49 / 48 AS vb, (cp / 49 - sc / 49 * (sp / 49)) * 49 / 48 AS co FROM w2 WHERE k = 49)
 SELECT block::BIGINT AS block, t, round(avg(((2 * a * b + 0.0225::DOUBLE) * (2 * co + 0.2025::DOUBLE)) / ((a * a + b * b + 0.0225::DOUBLE) * (va + vb + 0.2025::DOUBLE))), 6) + 0.0 AS ssim, count(*) AS windows FROM m GROUP BY block, t"""


@query
def dimension_choice(spark, sf):
    return rounded(intensity.best_dimension(intensity.dimension_scores(A.pp_events(spark, sf), A.R, (1, 2, 3, 5, 6, 9, 10, 15), 5)), 4)


ORACLE_SQL["dimension_choice"] = f"""WITH {_HIST}, kb AS (SELECT event_type, k, (t * k) // 90 AS bin, count(*) AS c FROM ev, (SELECT unnest([1, 2, 3, 5, 6, 9, 10, 15]) AS k) GROUP BY ALL),
 sc AS (SELECT event_type, k, -(sum(c * ln(c * k / 90)) - sum(c)) + k / 2 * ln(sum(c)) + k * 8 + sum(c) * ln(5) AS score FROM kb GROUP BY event_type, k)
 SELECT event_type, k::BIGINT AS k, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9), k) = 1"""


@query
def markov_marks(spark, sf):
    """Simulated jumps with marks from a chain that mostly stays: how often each state follows each."""
    j = generate.markov_marks(generate.poisson(spark, "linear", 64, 64), [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    steps = j.withColumn("h", F.coalesce(F.lag("mark").over(W.partitionBy("pixel").orderBy("t")), F.lit(0)))
    return rounded(steps.groupBy("h", F.col("mark").alias("j")).agg(F.count("*").alias("n")))


@query
def rule_loop(spark, sf):
    """The bank's rules by axis, each measured as bits of the grid's blocks against eight bits a cell; only whole block sides change them."""
    sides = {name: int(value) for name, _, parameter, value in fixed.RULES if parameter == "block_size" and value.isdigit()}
    g = A.grid_emb(spark, sf)
    bits = frames.split_bits(g, (*sorted({8, *sides.values()}, reverse=True),)).groupBy("block", "size").agg(F.sum("bits").alias("bits"))
    cells = g.groupBy("block").agg(F.count("*").alias("n"))
    both = bits.join(cells, "block").select(F.col("block").cast("string").alias("video"), "size", (F.col("bits") / F.col("n")).alias("bpp"), (8 * F.col("n") / F.col("bits")).alias("ratio")).cache()
    try:
        rules = [(axis, name) for name, axis, _, _ in fixed.RULES]

        def measure(name, kept):
            side = next((sides[r] for r in (name, *reversed(kept)) if r in sides), 8)  # the last one set
            return both.where(F.col("size") == side).drop("size")

        return rounded(search.rule_loop(spark, rules, measure, stalls=len(rules)))
    finally:
        both.unpersist()


_PATTERNS = ("static_background", "gradient", "animation", "noise", "periodic", "moving_square")


@query
def pattern_benchmark(spark, sf):
    """Six test patterns of 32 frames of 16 x 16, coded in blocks of 8 x 8 by their shortest process: bits, bits a cell, ratio."""
    cube = generate.grid(spark, 32, 16, 16)
    made = {
        "static_background": generate.static_background(cube, 32, 16, 16), "gradient": generate.gradient(cube, 16), "animation": generate.animation(cube, 32, 16, 16),
        "noise": generate.noise(cube), "periodic": generate.periodic(cube), "moving_square": generate.moving_square(cube),
    }
    cells = None
    for i, name in enumerate(_PATTERNS):
        block = (F.lit(i * 100) + F.floor(F.col("y") / 8) * 10 + F.floor(F.col("x") / 8)).cast("long").alias("block")
        own = made[name].select(block, "t", (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int").alias("x"), "c")
        cells = own if cells is None else cells.unionByName(own)
    lengths = description.block_lengths(description.pixels(cells))
    best = F.array_min(F.filter(F.array("mono", "pp", "spatial", "markov"), lambda v: v >= 0))
    names = F.array(*(F.lit(n) for n in _PATTERNS))
    g = lengths.groupBy(F.get(names, F.floor(F.col("block") / 100).cast("int")).alias("pattern")).agg(F.sum(best).alias("bits"), F.count("*").alias("blocks"))
    return rounded(g.select("pattern", "blocks", "bits", (F.col("bits") / (32 * 256)).alias("bpp"), (8.0 * 32 * 256 / F.col("bits")).alias("ratio")))
