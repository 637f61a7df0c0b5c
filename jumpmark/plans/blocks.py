"""Queries over blocks of cells and over features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark import adapters as A
from jumpmark.functions import scalar
from jumpmark.functions.scalar import dictionary_bits, log2_comb, log2_safe
from jumpmark.operators import blocks, changes, costs, features, search
from jumpmark.plans.catalog import QUERIES, block_table, rounded
from jumpmark.plans.oracles import _CONF, _EV, _FEAT, _LC, _RGB, _SEQ

ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lc(n: str, k: str) -> str:
    return f"(CASE WHEN {k} > 0 AND {k} < {n} THEN (lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)) / ln(2) ELSE 0 END)"


CELLS = """c0 AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings),
 cells AS (SELECT (vec_id // 256 * 10 + label)::BIGINT AS block, vec_id AS t, p // 8 AS y, p % 8 AS x, least(greatest(floor((v + 0.5) * 16), 0), 15)::BIGINT AS c FROM c0)"""
STEP = f"{CELLS}, st AS (SELECT *, lag(c) OVER (PARTITION BY block, y, x ORDER BY t) AS p FROM cells)"
BEST = "least(CASE WHEN m > 1 THEN log2(m) ELSE 0 END * (1 + n_trans), N * CASE WHEN m > 1 THEN log2(m) ELSE 0 END, N * H + CASE WHEN m > 1 THEN m * length(bin(m::BIGINT)) ELSE 0 END)"


def feat(keys: str, source: str, name: str) -> str:
    """CTEs of blocks.features over `source` (cells with columns `keys`), under a name."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    on2 = " AND ".join(f"a.{k} = d.{k}" for k in keys.split(", "))
    return f"""{name}s AS (SELECT *, lag(c) OVER (PARTITION BY {', '.join(dict.fromkeys((keys + ', block, y, x').split(', ')))} ORDER BY t) AS q FROM {source}),
 {name}w AS (SELECT {keys}, count(q) AS r, count(DISTINCT c) AS m, max(c) + 1 AS m_max FROM {name}s GROUP BY ALL),
 {name}j AS (SELECT *, lag(c) OVER (PARTITION BY {keys} ORDER BY t, y, x) AS bf FROM {name}s WHERE q <> c),
 {name}t AS (SELECT {keys}, count(*) FILTER (bf <> c) AS n_trans FROM {name}j GROUP BY ALL), {name}m AS (SELECT {keys}, c, count(*) AS n FROM {name}j GROUP BY ALL),
 {name}e AS (SELECT {keys}, sum(n) AS N, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS H, list(n) AS counts FROM {name}m GROUP BY ALL),
 {name} AS (SELECT a.*, coalesce(N, 0)::BIGINT AS N, coalesce(H, 0) AS H, coalesce(n_trans, 0) AS n_trans, coalesce(counts, []) AS counts, len(list_filter(coalesce(counts, []), lambda z: z >= greatest(2.0, 0.01 * N)))::BIGINT AS m_eff
  FROM {name}w a LEFT JOIN {name}e b ON {on} LEFT JOIN {name}t d ON {on2})"""


FEATS = f"{CELLS}, {feat('block', 'cells', 'f')}"
HELD = "list_transform(counts, lambda z: floor(z::DOUBLE / N * N))"
GAIN = f"(CASE WHEN N = 0 THEN 0 ELSE log2(N + 1) + {_lc('r', 'N')} + {BEST} - list_sum(list_transform({HELD}, lambda k: CASE WHEN k > 0 THEN log2(k + 1) + {_lc('r', 'k')} ELSE 0 END)) END)"
SPATIAL = """lf AS (SELECT cells.* FROM cells JOIN (SELECT block, max(t) AS t FROM cells GROUP BY block) z ON z.block = cells.block AND z.t = cells.t),
 nb AS (SELECT *, lead(c) OVER (PARTITION BY block, y ORDER BY x) AS rg, lead(c) OVER (PARTITION BY block, x ORDER BY y) AS bl, avg(c) OVER (PARTITION BY block) AS mu, var_pop(c) OVER (PARTITION BY block) AS va FROM lf),
 sp AS (SELECT block, (count(*) FILTER (c = rg) + count(*) FILTER (c = bl)) / (count(rg) + count(bl)) AS H_s, CASE WHEN max(va) < 1e-10 THEN 1.0 ELSE least(greatest(((avg((c - mu) * (rg - mu)) + avg((c - mu) * (bl - mu))) / (2 * max(va)) + 1) / 2, 0), 1) END AS rho FROM nb GROUP BY block)"""


@query(f"WITH {FEATS} SELECT block, N, r, m, m_max, round(H, 6) AS H, m_eff, n_trans FROM f")
def block_alphabets(spark, sf):
    """Features of blocks of cells, the alphabet counted both ways: colours that occur, and the largest one and one."""
    return rounded(blocks.features(A.cells(spark, sf)).drop("counts"))


@query(f"""WITH {STEP}, s AS (SELECT *, (p <> c)::INT AS ch FROM st), px AS (SELECT block, y, x, 1 + sum(coalesce(ch, 0)) AS n, avg(c) AS mean, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (ch = 1), '') AS pattern FROM s GROUP BY ALL),
 a AS (SELECT block, avg(n) AS f1, stddev_pop(n) AS f2, stddev_pop(mean) AS f4 FROM px GROUP BY block), b AS (SELECT block, max(k) / sum(k) AS f6 FROM (SELECT block, pattern, count(*) AS k FROM px GROUP BY ALL) GROUP BY block),
 d AS (SELECT block, count(*)::DOUBLE AS f3, max(k) / sum(k) AS f9 FROM (SELECT block, c, count(*) AS k FROM cells GROUP BY ALL) GROUP BY block), e AS (SELECT block, stddev_pop(c) AS f5, coalesce(avg(ch), 0) AS f8, var_pop(c) AS f10, count(DISTINCT CASE WHEN ch = 1 THEN p * 100 + c END)::DOUBLE AS f7 FROM s GROUP BY block)
 SELECT a.block, {', '.join(f'round(f{i}, 6) + 0.0 AS f{i}' for i in range(1, 11))} FROM a JOIN b ON a.block = b.block JOIN d ON a.block = d.block JOIN e ON a.block = e.block""")
def block_features_10(spark, sf):
    return rounded(blocks.ten_features(A.cells(spark, sf)))


@query(f"WITH {CELLS}, {SPATIAL} SELECT block, round(H_s, 6) AS H_s, round(rho, 6) AS rho FROM sp")
def spatial_statistics(spark, sf):
    """Equal neighbours and autocorrelation of last frames, across and down."""
    return rounded(blocks.spatial(A.cells(spark, sf)))


@query(f"WITH {FEATS} SELECT block, CASE WHEN N = 0 THEN 'MARKED' WHEN (m <= 4 AND m_eff >= m - 1) OR {GAIN} > 0 THEN 'MONO' ELSE 'MARKED' END AS kind, round({GAIN}, 4) + 0.0 AS gain FROM f")
def block_process_kind(spark, sf):
    """Classification with the gain of a process for each colour against marks."""
    f = blocks.features(A.cells(spark, sf)).withColumn("gain", blocks.mono_gain())
    return rounded(f.select("block", blocks.process_kind(F.col("gain")).alias("kind"), "gain"), 4)


_CHI = f"""{_EV}, {_SEQ}, tr AS (SELECT block_id, pm AS h, mark AS j, count(*) AS n FROM sq WHERE pm <> mark GROUP BY ALL), fl AS (SELECT b.block_id, h.h, j.j, 1 + coalesce(tr.n, 0) AS n FROM (SELECT DISTINCT block_id FROM tr) b, range(5) h(h), range(5) j(j) LEFT JOIN tr ON tr.block_id = b.block_id AND tr.h = h.h AND tr.j = j.j),
 ex AS (SELECT block_id, n, sum(n) OVER (PARTITION BY block_id, h) * sum(n) OVER (PARTITION BY block_id, j) / sum(n) OVER (PARTITION BY block_id) AS e FROM fl), ch AS (SELECT block_id, sum((n - e) ** 2 / e) AS chi2 FROM ex GROUP BY block_id),
 mk AS (SELECT block_id, chi2, exp(-chi2 / 2) * list_sum(list_transform(range(8), lambda k: (chi2 / 2) ** k / exp(lgamma(k + 1.0)))) AS p_value FROM ch)"""


@query(f"WITH {_CHI} SELECT block_id, round(chi2, 6) AS chi2, 16::BIGINT AS df, round(p_value, 6) AS p_value, p_value < 0.05 AS markov FROM mk")
def markov_p_value(spark, sf):
    return rounded(blocks.markov_test(changes.transitions(A.pp_events(spark, sf)), 5))


_C16 = f"""{STEP}, tr AS (SELECT block, bf AS h, c AS j, count(*) AS n FROM (SELECT *, lag(c) OVER (PARTITION BY block ORDER BY t, y, x) AS bf FROM st WHERE p <> c) WHERE bf <> c AND bf // 4 <> c // 4 GROUP BY ALL)"""


@query(f"""WITH {STEP}, {feat('block', 'cells', 'f')}, {SPATIAL}, jj AS (SELECT *, lag(c) OVER (PARTITION BY block ORDER BY t, y, x) AS bf FROM st WHERE p <> c),
 tr AS (SELECT block, bf % 3 AS h, c % 3 AS j, count(*) AS n FROM jj WHERE bf <> c GROUP BY ALL), fl AS (SELECT b.block, h.h, j.j, 1 + coalesce(tr.n, 0) AS n FROM (SELECT DISTINCT block FROM tr) b, range(3) h(h), range(3) j(j) LEFT JOIN tr ON tr.block = b.block AND tr.h = h.h AND tr.j = j.j),
 ex AS (SELECT block, n, sum(n) OVER (PARTITION BY block, h) * sum(n) OVER (PARTITION BY block, j) / sum(n) OVER (PARTITION BY block) AS e FROM fl), mk AS (SELECT block, exp(-sum((n - e) ** 2 / e) / 2) * (1 + sum((n - e) ** 2 / e) / 2) < 0.05 AS markov FROM ex GROUP BY block)
 SELECT f.block, CASE WHEN H_s > 0.7 AND rho > 0.8 THEN 'JOINT' WHEN rho < 0.15 THEN 'MARGINAL' WHEN coalesce(markov, false) THEN 'MARKOV' WHEN {GAIN} > 0 THEN 'MONO' ELSE 'MARKED' END AS kind FROM f JOIN sp ON sp.block = f.block LEFT JOIN mk ON mk.block = f.block""")
def block_kinds_5(spark, sf):
    """Joint, marginal, Markov (by the test on classes of colours), a process each, marked."""
    g = A.cells(spark, sf)
    j = blocks.jumps(g).withColumn("before", F.lag("mark").over(W.partitionBy("block").orderBy("t", "y", "x"))).where("before <> mark")
    t = j.groupBy("block", (F.col("before") % 3).alias("h"), (F.col("mark") % 3).alias("j")).agg(F.count("*").alias("n"))
    test = blocks.markov_test(t, 3, "block").select("block", "markov")
    f = blocks.features(g).join(blocks.spatial(g), "block").join(test, "block", "left")
    return f.select("block", blocks.five_kinds(blocks.mono_gain(), F.coalesce("markov", F.lit(False))).alias("kind"))


_QT = f"""WITH {CELLS}, c2 AS (SELECT *, y // 2 AS qy, x // 2 AS qx FROM cells), {feat('block, qy, qx', 'c2', 'qa')}, c4 AS (SELECT *, y // 4 AS qy, x // 4 AS qx FROM cells), {feat('block, qy, qx', 'c4', 'qb')}, c8 AS (SELECT *, y // 8 AS qy, x // 8 AS qx FROM cells), {feat('block, qy, qx', 'c8', 'qc')},
 {', '.join(f"o{i} AS (SELECT block, qy, qx, CASE WHEN N = 0 THEN 0 ELSE log2(N + 1) + {_lc('r', 'N')} + {BEST} END AS own FROM q{n})" for i, n in ((2, 'a'), (4, 'b'), (8, 'c')))},
 b2 AS (SELECT block, qy, qx, floor(own)::BIGINT AS bits, 1 AS leaves FROM o2),
 {', '.join(f"u{s} AS (SELECT block, qy // 2 AS qy, qx // 2 AS qx, sum(bits) + 2 AS split, sum(leaves) AS parts FROM b{s // 2} GROUP BY ALL), b{s} AS (SELECT o.block, o.qy, o.qx, floor(least(own, split))::BIGINT AS bits, CASE WHEN split < own THEN parts ELSE 1 END AS leaves FROM o{s} o JOIN u{s} u ON u.block = o.block AND u.qy = o.qy AND u.qx = o.qx)" for s in (4, 8))}
 SELECT block, bits, leaves::BIGINT AS leaves FROM b8"""


@query(_QT)
def quadtree_split(spark, sf):
    """The cheapest quadtree over each block's 8 x 8 pixels."""
    return rounded(blocks.quadtree(A.cells(spark, sf)))


@query(f"WITH {STEP} SELECT block, t, y, x, c AS mark FROM st WHERE p <> c")
def raw_jumps(spark, sf):
    """Jumps with their raw colours."""
    return rounded(blocks.jumps(A.cells(spark, sf)))


@query(f"WITH {STEP} SELECT block, t, count(*) FILTER (p <> c) AS n_changed, coalesce(string_agg((y * 8 + x)::VARCHAR, ',' ORDER BY y, x) FILTER (p <> c), '') AS positions FROM st WHERE p IS NOT NULL GROUP BY ALL")
def xor_positions(spark, sf):
    """The mask of what differs from the frame before, as places."""
    s = blocks.stepped(A.cells(spark, sf)).where("p is not null")
    at = F.array_sort(F.collect_list(F.when(F.col("p") != F.col("c"), F.col("y") * 8 + F.col("x"))))
    return rounded(s.groupBy("block", "t").agg(F.count_if(F.col("p") != F.col("c")).alias("n_changed"), F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("positions")))


@query(f"""WITH {STEP}, ro AS (SELECT block, t, y, sum(CASE WHEN p <> c THEN 1 << x ELSE 0 END)::BIGINT AS b FROM st WHERE p IS NOT NULL GROUP BY ALL), pr AS (SELECT *, lag(b) OVER (PARTITION BY block, y ORDER BY t) AS q FROM ro)
 SELECT block, t, sum(bit_count(b & q))::BIGINT AS n_and, sum(bit_count(b | q))::BIGINT AS n_or, sum(bit_count(xor(b, q)))::BIGINT AS n_xor FROM pr WHERE q IS NOT NULL GROUP BY ALL""")
def mask_algebra(spark, sf):
    return rounded(blocks.mask_algebra(blocks.xor_masks(A.cells(spark, sf))))


@query(f"""WITH {STEP}, px AS (SELECT block, y, x, count(*) FILTER (p IS NULL OR p <> c) AS n, bit_or(1::BIGINT << c) AS visited, count(*) AS r FROM st GROUP BY ALL), g AS (SELECT block, avg(n) AS mean_n, max(r) AS r, bit_or(visited) AS palette_mask, count(*) FILTER (bit_count(visited) = 1) AS still_pixels FROM px GROUP BY block)
 SELECT block, bit_count(palette_mask)::BIGINT AS m, palette_mask, still_pixels, round(mean_n, 6) AS mean_n, round(abs(2 * mean_n / r - 1), 6) AS symmetry FROM g""")
def block_structure(spark, sf):
    return rounded(blocks.structure(A.cells(spark, sf)))


@query(f"""WITH {STEP}, j AS (SELECT block, y, x, t, c, p, row_number() OVER (PARTITION BY block, y, x ORDER BY t) - 1 AS k FROM st) SELECT block, y, x, count(*) AS r, count(*) FILTER (p IS NULL OR p <> c) AS n,
 string_agg(c::VARCHAR, ',' ORDER BY t) AS sequence, string_agg((p IS NULL OR p <> c)::INT::VARCHAR, '' ORDER BY t) AS vector, sum(CASE WHEN (p IS NULL OR p <> c) AND k < 60 THEN 1::BIGINT << (59 - least(k, 59))::INT ELSE 0 END)::BIGINT AS head,
 string_agg(k::VARCHAR, ',' ORDER BY t) FILTER (p IS NULL OR p <> c) AS dates, string_agg(c::VARCHAR, ',' ORDER BY t) FILTER (p IS NULL OR p <> c) AS colors FROM j GROUP BY ALL""")
def pixel_matrices(spark, sf):
    """The six matrices of a pixel: sequence, jump vector, its number (of its first 60 places), count, dates, colours."""
    k = F.row_number().over(W.partitionBy(*blocks.PIXEL).orderBy("t")) - 1
    s = blocks.stepped(A.cells(spark, sf)).withColumns({"k": k, "b": F.coalesce(F.col("p") != F.col("c"), F.lit(True))})
    g = s.groupBy(*blocks.PIXEL).agg(F.array_sort(F.collect_list(F.struct("k", "c", F.col("b").cast("int").alias("b")))).alias("e"))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    on = F.filter("e", lambda e: e["b"] == 1)
    number = F.aggregate(F.filter(on, lambda e: e["k"] < 60), F.lit(0).cast("long"), lambda a, e: a + F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(59) - e["k"]))
    return rounded(g.select(*blocks.PIXEL, F.size("e").alias("r"), F.size(on).alias("n"), text(F.col("e.c")).alias("sequence"), F.array_join(F.transform("e", lambda e: e["b"].cast("string")), "").alias("vector"), number.alias("head"), text(F.transform(on, lambda e: e["k"])).alias("dates"), text(F.transform(on, lambda e: e["c"])).alias("colors")))


@query(f"""WITH {STEP}, px AS (SELECT block, y, x, count(*) FILTER (p IS NULL OR p <> c) AS n FROM st GROUP BY ALL), g AS (SELECT block, count(DISTINCT c) AS m FROM cells GROUP BY block), a AS (SELECT block, t, count(*) FILTER (p <> c) AS k FROM st WHERE p IS NOT NULL GROUP BY ALL)
 SELECT g.block, m, round(avg(n), 6) AS mean_jumps, count(*) FILTER (n = 1) AS still, (SELECT max(k) FROM a WHERE a.block = g.block) AS busiest, (SELECT count(*) FILTER (k > 0) FROM a WHERE a.block = g.block) AS active_frames FROM px JOIN g ON g.block = px.block GROUP BY g.block, m""")
def block_inspector(spark, sf):
    """What a player shows of a block: colours, jumps a pixel, pixels that never change, busiest frame and frames with changes."""
    s = blocks.stepped(A.cells(spark, sf))
    px = s.groupBy(*blocks.PIXEL).agg(F.count_if(F.col("p").isNull() | (F.col("p") != F.col("c"))).alias("n")).groupBy("block").agg(F.avg("n").alias("mean_jumps"), F.count_if(F.col("n") == 1).alias("still"))
    act = s.where("p is not null").groupBy("block", "t").agg(F.count_if(F.col("p") != F.col("c")).alias("k")).groupBy("block").agg(F.max("k").alias("busiest"), F.count_if(F.col("k") > 0).alias("active_frames"))
    # a block of one frame has no changes to count: it stays, with no busiest frame
    return rounded(px.join(s.groupBy("block").agg(F.count_distinct("c").alias("m")), "block").join(act, "block", "left").select("block", "m", "mean_jumps", "still", "busiest", F.coalesce("active_frames", F.lit(0)).alias("active_frames")))


# features: suggestions, lengths, families


@query(f"""WITH {_FEAT}, x AS (SELECT *, log2(m) * (1 + n_trans) AS ba, N * log2(m) AS bb, N * H + CASE WHEN m > 1 THEN m * (floor(log2(m)) + 1) ELSE 0 END AS bc FROM f)
 SELECT block_id, CASE WHEN m_eff = 1 THEN 'MONO' ELSE 'MARKED' END AS kind, CASE WHEN m_eff = 1 THEN 'Bb' WHEN ba <= bb AND ba <= bc THEN 'Ba' WHEN bb <= bc THEN 'Bb' ELSE 'Bc' END AS color_mode, CASE WHEN N = 0 THEN 'R1' WHEN N < 50 THEN 'R2' ELSE 'R4b' END AS representation FROM x""")
def suggestions(spark, sf):
    """Suggested kind, colour mode and representation of a block from its features (without spatial ones)."""
    f = block_table(spark, sf)
    mono = F.col("m_eff") == 1
    c = {k: v for k, v in costs.color_costs().items() if k != "Bd"}
    return f.select("block_id", F.when(mono, "MONO").otherwise("MARKED").alias("kind"), F.when(mono, "Bb").otherwise(costs.best(c)["name"]).alias("color_mode"), costs.suggested_representation().alias("representation"))


_L = f"""{_FEAT}, lt AS (SELECT *, log2(m) * (1 + n_trans) AS a, N * log2(m) AS b, N * H + CASE WHEN m > 1 THEN m * (floor(log2(m)) + 1) ELSE 0 END AS c, log2(greatest(N, 1)) + N * log2(r) AS t2, log2(N + 1) + {_LC} AS t4 FROM f),
 ll AS (SELECT *, r + least(a, b, c) AS L1, t2 + least(a, b, c) AS L2, r + least(a, b, c) AS L3, t4 + least(a, b, c) AS L4, t4 AS L4_mono, t4 + b - (t4 + c) AS gain FROM lt)"""


@query(f"WITH {_L} SELECT block_id, {', '.join(f'round({k}, 6) AS {k}' for k in ('L1', 'L2', 'L3', 'L4', 'L4_mono'))}, round(least(L1, L2, L3, L4, L4_mono), 6) AS best, round(gain, 6) + 0.0 AS gain, round(100 * gain / (t4 + b), 6) + 0.0 AS gain_percent, round(5 * log2(N) / N, 6) AS bound FROM ll")
def mode_lengths(spark, sf):
    """Lengths L1 to L4 with the best colour mode, the one without colours, the gain of Huffman over uniform, the bound."""
    return rounded(_lengths(spark, sf))


def _lengths(spark, sf):
    n, r = F.col("N").cast("double"), F.col("r").cast("double")
    c = costs.color_costs()
    color = F.least(c["Ba"], c["Bb"], c["Bc"])
    t4 = F.log2(n + 1) + log2_comb(F.col("r"), F.col("N"))
    t2 = F.log2(F.greatest(n, F.lit(1.0))) + n * F.log2(r)
    f = block_table(spark, sf).select("block_id", (r + color).alias("L1"), (t2 + color).alias("L2"), (r + color).alias("L3"), (t4 + color).alias("L4"), t4.alias("L4_mono"), (c["Bb"] - c["Bc"]).alias("gain"), (t4 + c["Bb"]).alias("uniform"), (5 * F.log2(n) / n).alias("bound"))
    return f.select("block_id", "L1", "L2", "L3", "L4", "L4_mono", F.least("L1", "L2", "L3", "L4", "L4_mono").alias("best"), "gain", (100 * F.col("gain") / F.col("uniform")).alias("gain_percent"), "bound")


@query(f"WITH {_L}, z AS (SELECT *, least(L1, L2, L3, L4, L4_mono) AS uniform, 0.9 * L4 AS mdl FROM ll) SELECT block_id, mdl < uniform AS use_mdl, round(uniform, 6) AS uniform, round(r * 8 / L4, 6) AS ratio, round(L4 - N * H, 6) + 0.0 AS redundancy FROM z")
def mdl_decision(spark, sf):
    """Whether a description of nine tenths of L4 beats every uniform length; compression ratio and redundancy of L4."""
    f = _lengths(spark, sf).join(block_table(spark, sf).select("block_id", "N", "r", "H"), "block_id")
    return rounded(f.select("block_id", (0.9 * F.col("L4") < F.col("best")).alias("use_mdl"), F.col("best").alias("uniform"), (F.col("r") * 8 / F.col("L4")).alias("ratio"), (F.col("L4") - F.col("N") * F.col("H")).alias("redundancy")))


@query(f"""WITH {_FEAT}, fm AS (SELECT block_id, N, r, ord, family, N * log2(r) + (k + 4) * log2(N + 1) / 2 AS score FROM f, (SELECT * FROM (VALUES (0, 'histogram', least(16, 90 // 16)), (1, 'splines', least(10, 90 // 25)), (2, 'wavelets', least(8, 6)), (3, 'trigonometric', least(5, 90 // 50))) v(ord, family, k)))
 SELECT block_id, family, round(score, 6) AS score FROM fm QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY score, ord) = 1""")
def family_by_mdl(spark, sf):
    """The intensity family of the smallest score; the parameters of each follow from the number of frames."""
    r, n = F.col("r"), F.col("N").cast("double")
    k = {"histogram": F.least(F.lit(16), F.floor(r / 16)), "splines": F.least(F.lit(10), F.floor(r / 25)), "wavelets": F.least(F.lit(8), F.floor(F.log2(r))), "trigonometric": F.least(F.lit(5), F.floor(r / 50))}
    best = costs.best({name: n * F.log2(r) + (v + 4) * F.log2(n + 1) / 2 for name, v in k.items()})
    return rounded(block_table(spark, sf).withColumn("b", best).select("block_id", F.col("b.name").alias("family"), F.col("b.cost").alias("score")))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice * 8 AS bits, 1000 + o_custkey % 7 * 400 AS kbps FROM orders), l AS (SELECT o_orderkey, CASE WHEN bits * 30 <= kbps * 1000 * 10 THEN 0 WHEN bits * 30 <= kbps * 1000 * 20 THEN 1 WHEN bits * 30 <= kbps * 1000 * 40 THEN 2 ELSE 3 END AS level FROM o)
 SELECT level::BIGINT AS level, (CASE WHEN level >= 1 THEN greatest(1, 3 - level) ELSE 3 END)::BIGINT AS F, (CASE WHEN level >= 2 THEN least(3, 1 + 1) ELSE 1 END)::BIGINT AS G, (CASE WHEN level >= 3 THEN 0 ELSE 1 END)::BIGINT AS B, count(*) AS n FROM l GROUP BY ALL""")
def bandwidth_levels(spark, sf):
    """The level of detail for a bandwidth, and the method code adapted to it (F 3, G 1, B 1 before)."""
    bits, kbps = F.col("o_totalprice") * 8, (1000 + F.col("o_custkey") % 7 * 400) * 10
    f = A.table(spark, sf, "orders").select(costs.bandwidth_level(bits, kbps).alias("level"))
    fields = costs.adapted({"B": F.lit(1), "F": F.lit(3), "G": F.lit(1)}, F.col("level"))
    return rounded(f.groupBy("level", *(v.alias(k) for k, v in fields.items())).agg(F.count("*").alias("n")))


# the objective of threshold configurations


_OBJ = f"""{_FEAT}, ob AS (SELECT *, N * log2(m) AS Aa, 0.0 AS Ab, log2(m) * (1 + n_trans) AS Ba, N * log2(m) AS Bb, N * H + CASE WHEN m > 1 THEN m * (floor(log2(m)) + 1) ELSE 0 END AS Bc, N * (log2(m) + 2 * log2(greatest(1.0, log2(m)))) AS Bd,
  N * log2(r) AS C1, r * log2(N / r + 1) AS C2, CASE WHEN N > 0 THEN N * log2(r / N + 1) ELSE 1e300 END AS C3, r AS C4, log2(N + 1) + {_LC} AS C5 FROM f),
 mg AS (SELECT block_id, sum(log2(n2 + 1) + CASE WHEN n2 > 0 AND n2 < 90 THEN (lgamma(91.0) - lgamma(n2 + 1.0) - lgamma(91.0 - n2)) / ln(2) ELSE 0 END) AS mono FROM (SELECT mc.block_id, floor(mc.n::DOUBLE / en.N * en.N) AS n2 FROM mc JOIN en ON en.block_id = mc.block_id) WHERE n2 > 0 GROUP BY block_id),
 pr AS (SELECT ob.*, CASE WHEN (m <= 4 AND m_eff >= m - 1) OR C5 + least(Ba, Bb, Bc) > mono THEN 1 ELSE 0 END AS pa, CASE WHEN m_eff = 1 THEN 1 WHEN Ba <= Bb AND Ba <= Bc THEN 0 WHEN Bb <= Bc THEN 1 ELSE 2 END AS pb, CASE WHEN N < 50 THEN 1 ELSE 4 END AS pc,
  CASE WHEN Aa <= 0 THEN 0 ELSE 1 END AS oa, CASE WHEN Ba <= least(Bb, Bc, Bd) THEN 0 WHEN Bb <= least(Bc, Bd) THEN 1 WHEN Bc <= Bd THEN 2 ELSE 3 END AS xb, CASE WHEN C1 <= least(C2, C3, C4, C5) THEN 0 WHEN C2 <= least(C3, C4, C5) THEN 1 WHEN C3 <= least(C4, C5) THEN 2 WHEN C4 <= C5 THEN 3 ELSE 4 END AS xc FROM ob JOIN mg ON mg.block_id = ob.block_id),
 jc AS (SELECT *, CASE pa WHEN 0 THEN Aa ELSE 0 END + CASE pb WHEN 0 THEN Ba WHEN 1 THEN Bb ELSE Bc END + CASE pc WHEN 1 THEN C2 ELSE C5 END AS cost, least(Aa, 0) + least(Ba, Bb, Bc, Bd) + least(C1, C2, C3, C4, C5) AS opt FROM pr),
 jj AS (SELECT sum(cost) AS encoding, sum(greatest(cost - opt, 0)) AS penalty, avg((pa = oa AND pb = xb AND pc = xc)::INT) AS exact, avg((pa = oa)::INT) AS acc_a, avg((pb = xb)::INT) AS acc_b, avg((pc = xc)::INT) AS acc_c, max(greatest(cost - opt, 0)) AS max_penalty FROM jc)"""


@query(f"WITH {_OBJ}, {_CONF} SELECT config_id, round(encoding + 0.5 * penalty, 3) AS total, round(encoding, 3) AS encoding, round(penalty, 3) + 0.0 AS penalty, round(exact, 3) AS exact, round(acc_a, 3) AS acc_a, round(acc_b, 3) AS acc_b, round(acc_c, 3) AS acc_c, round(max_penalty, 3) + 0.0 AS max_penalty FROM cf, jj")
def objective_grid(spark, sf):
    """Every threshold configuration's objective over the blocks of users."""
    f = block_table(spark, sf).join(features.mark_counts(A.pp_events(spark, sf)).groupBy("block_id").agg(F.collect_list("n").alias("counts")), "block_id")
    return rounded(search.objective(f, search.configs(spark)).drop("mean_penalty", "n_blocks"), 3)


@query(f"WITH {_OBJ}, {_CONF} SELECT config_id, round(encoding + 0.5 * penalty, 3) AS total, row_number() OVER (ORDER BY config_id) AS rank FROM cf, jj ORDER BY config_id LIMIT 10")
def objective_topk(spark, sf):
    """The ten best configurations: smallest total, of equal ones the first."""
    top = objective_grid(spark, sf).orderBy("total", "config_id").limit(10)
    return rounded(top.select("config_id", "total", F.row_number().over(W.orderBy("total", "config_id")).alias("rank")), 3)
