"""SQL of the same meaning as the queries of catalog, in DuckDB's dialect, over the driver's views."""

from __future__ import annotations

_ALPHABET = "al AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS mark FROM (SELECT DISTINCT event_type FROM events))"
_EV = f"{_ALPHABET}, ev AS (SELECT user_id AS block_id, event_id AS seq, date_diff('hour', TIMESTAMP '2024-01-01', ts) // 8 AS t, mark, ts, value, e.event_type FROM events e JOIN al USING (event_type))"
_SEQ = "sq AS (SELECT block_id, seq, t, mark, lag(mark) OVER w AS pm, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY block_id ORDER BY t, seq))"
_CNT = "mc AS (SELECT block_id, mark, count(*) AS n FROM ev GROUP BY ALL)"
_ENT = "en AS (SELECT block_id, sum(n) AS N, count(*) AS m_seen, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS H FROM mc GROUP BY block_id)"
_EFF = "ef AS (SELECT mc.block_id, count(*) FILTER (mc.n >= greatest(2.0, 0.01 * en.N)) AS m_eff FROM mc JOIN en ON mc.block_id = en.block_id GROUP BY mc.block_id)"
_SF = "sf AS (SELECT block_id, coalesce(sum((mark <> pm)::INT), 0) AS n_trans, CASE WHEN var_pop(gap) > 0 THEN avg(gap) ** 2 / var_pop(gap) ELSE 1.0 END AS R_temp FROM sq GROUP BY block_id)"
_FEAT = f"{_EV}, {_SEQ}, {_CNT}, {_ENT}, {_EFF}, {_SF}, f AS (SELECT en.block_id, en.N::DOUBLE AS N, 90::DOUBLE AS r, m_seen::DOUBLE AS m, H, m_eff, n_trans::DOUBLE AS n_trans, R_temp FROM en JOIN ef ON ef.block_id = en.block_id JOIN sf ON sf.block_id = en.block_id)"
_LC = "CASE WHEN N > 0 AND N < r THEN (lgamma(r + 1) - lgamma(N + 1) - lgamma(r - N + 1)) / ln(2) ELSE 0 END"
_COL = "(n_trans + 1) * log2(m) AS Ba, N * log2(m) AS Bb, CASE WHEN m > 1 THEN N * H + m * (floor(log2(m)) + 1) ELSE 0 END AS Bc, N * (log2(m) + 2 * log2(greatest(1.0, log2(m)))) AS Bd"
_TMP = f"log2(N + 1) + N * log2(r) AS R1, r * log2(N / r + 1) AS R2, N * log2(r) AS R3, r AS R4a, log2(N + 1) + {_LC} AS R4b"
_TMX = f"N * log2(r) AS R1, r * log2(N / r + 1) AS R2, N * log2(r / N + 1) AS R3, r AS R4a, log2(N + 1) + {_LC} AS R4b"
_TYP = "N * log2(m) AS Aa, 0::DOUBLE AS Ab, N * H AS Ac, 0.8 * N * H AS Ad, n_trans * log2(m) AS Ae"
_G = "g AS (SELECT vec_id // 256 * 10 + label AS block, vec_id AS t, x - 1 AS x, least(greatest(floor((v + 0.5) * 16), 0), 15)::BIGINT AS c FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings))"
_CH = f"{_G}, ch AS (SELECT *, coalesce(c <> lag(c) OVER (PARTITION BY block, x ORDER BY t), true) AS b, lag(c) OVER (PARTITION BY block, x ORDER BY t) AS p FROM g)"
_RUNS = """br AS (SELECT n_name AS video, o_orderpriority AS codec, o_orderstatus AS quality_param, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100 AS input_size, sum(round((l_extendedprice * l_discount) * 100)::BIGINT)::BIGINT / 100 + 1 AS output_size,
 sum(round(l_extendedprice * 100)::BIGINT)::BIGINT * 100 // count(*) / 10000 AS bitrate, sum(round(l_quantity * 100)::BIGINT)::BIGINT * 100 // count(*) / 10000 AS psnr, 1 - sum(round(l_tax * 100)::BIGINT)::BIGINT * 100 // count(*) / 10000 AS ssim, count(*) AS n_frames
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 rr AS (SELECT *, CASE WHEN output_size > 0 THEN input_size / output_size ELSE 0 END AS ratio FROM br)"""
_SUM = "su AS (SELECT codec, count(*) AS n, avg(ratio) AS ratio, coalesce(avg(psnr) FILTER (psnr > 0), 0) AS psnr, coalesce(avg(ssim) FILTER (ssim > 0), 0) AS ssim, avg(bitrate) AS bitrate, sum(input_size) / sum(output_size) AS overall_ratio FROM rr GROUP BY codec)"
_PRED = """bp AS (SELECT l.doc_id AS block_id, quality AS act_a, 1 - toxic AS pred_a, n_chars % 4 AS act_b, l.doc_id % 4 AS pred_b, least(n_chars // 1000, 4) AS act_c, least(n_chars // 1200, 4) AS pred_c,
 n_chars::DOUBLE AS optimal_cost, (n_chars + l.doc_id % 97)::DOUBLE AS predicted_cost FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_CM = f"{_PRED}, cm AS (SELECT dim, act::BIGINT AS act, pred::BIGINT AS pred, count(*) AS n FROM (SELECT 'a' AS dim, act_a AS act, pred_a AS pred FROM bp UNION ALL SELECT 'b', act_b, pred_b FROM bp UNION ALL SELECT 'c', act_c, pred_c FROM bp) GROUP BY ALL)"
_HIST = f"""{_EV}, hc AS (SELECT event_type, least(t // 6, 14)::BIGINT AS bin, count(*) AS n FROM ev GROUP BY ALL),
 h AS (SELECT k.event_type, k.bin, coalesce(hc.n, 0) AS n, coalesce(hc.n, 0) / 6.0 AS alpha FROM (SELECT event_type, b AS bin FROM al, range(15) r(b)) k LEFT JOIN hc ON hc.event_type = k.event_type AND hc.bin = k.bin)"""
_ST = f"{_EV}, vs AS (SELECT ts AS time, block_id % 4 AS \"by\", (block_id // 4) % 4 AS bx, event_type AS tag, value AS magnitude, seq AS id FROM ev)"
_PART = "fs AS (SELECT p_partkey, " + ", ".join(f"p_partkey * {k} % {n} + {lo} AS {name}" for name, k, n, lo in (("A", 1, 5, 0), ("B", 3, 4, 0), ("C", 7, 5, 0), ("D", 11, 3, 0), ("E", 13, 4, 0), ("F", 17, 3, 1), ("G", 19, 4, 0), ("H", 23, 2, 0))) + " FROM part)"
_RGB = "co AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part)"


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())


def _least(names: list[str], source: str, alias: str) -> str:
    """The first smallest of columns as (alias_name, alias_ord, alias_cost) expressions."""
    low = f"least({', '.join(names)})"
    case = " ".join(f"WHEN {n} = {low} THEN '{n}'" for n in names)
    order = " ".join(f"WHEN {n} = {low} THEN {i}" for i, n in enumerate(names))
    return f"{alias} AS (SELECT block_id, CASE {case} END AS name, CASE {order} END AS ord, {low} AS cost FROM {source})"


_B, _T, _A = ["Ba", "Bb", "Bc", "Bd"], ["R1", "R2", "R3", "R4a", "R4b"], ["Aa", "Ab", "Ac", "Ad", "Ae"]
_JOINT = " UNION ALL ".join(f"SELECT block_id, {4 * i + j} AS ord, '{t}+{b}' AS pair, {t} + {b} AS cost FROM cc" for i, t in enumerate(_T) for j, b in enumerate(_B))
_CC = f"{_FEAT}, cc AS (SELECT block_id, {_COL}, {_TMP} FROM f), jo AS ({_JOINT})"
_MODES = " UNION ALL ".join(f"SELECT block, {i} AS ord, '{k}' AS mode, (c - {e} + 256) % 256 AS res FROM lu" for i, (k, e) in enumerate((("bypass", "0"), ("left", "l"), ("time", "u"), ("dc", "((l + u) // 2)"))))
_NODES = " UNION ALL ".join(f"SELECT block, {s} AS size, x // {s} AS node, c FROM g" for s in (64, 32, 16, 8))
_QUAL = f"""{_CH}, q0 AS (SELECT block, t, avg((c - p) ** 2) AS mse, avg(abs(c - p)) AS mad, avg(c) AS mc, avg(p) AS mp, var_pop(c) AS vc, var_pop(p) AS vp, covar_pop(c, p) AS cov FROM ch WHERE p IS NOT NULL GROUP BY block, t),
 q AS (SELECT block, t, mad, CASE WHEN mse > 0 THEN 10 * log10(225 / mse) END AS psnr, ((2 * mc * mp + 0.0225) * (2 * cov + 0.2025)) / ((mc * mc + mp * mp + 0.0225) * (vc + vp + 0.2025)) AS ssim FROM q0)"""
_CAND = [(17 * i % 256, 71 * i % 256, 113 * i % 256) for i in range(16)]
_NEAR = " UNION ALL ".join(f"SELECT p_partkey, r, g, b, {i}::BIGINT AS idx, (r - {x}) * (r - {x}) + (g - {y}) * (g - {y}) + (b - {z}) * (b - {z}) AS dist FROM co" for i, (x, y, z) in enumerate(_CAND))
_CLIP = lambda e: f"least(greatest({e}, 0), 255)::BIGINT"
_GRID = {"H_s": (0.5, 0.9, 5), "rho_high": (0.6, 0.95, 5), "rho_low": (0.05, 0.3, 5), "chi2": (0.01, 0.1, 4), "R1_max": (0.05, 0.2, 4), "R4b_R2": (0.7, 0.9, 4), "R4a_min": (0.4, 0.65, 4)}
_AXES = ", ".join(f"(SELECT i AS i{k}, round({lo}::DOUBLE + i * {(hi - lo) / (n - 1)!r}::DOUBLE, 10) AS {k} FROM range({n}) t(i))" for k, (lo, hi, n) in _GRID.items())
_ID = "0"
for _k, (_, _, _n) in _GRID.items():
    _ID = f"({_ID}) * {_n} + i{_k}"
_CONF = f"cf AS (SELECT {_ID} AS config_id, {', '.join(_GRID)} FROM {_AXES})"
_PAIR = """pv AS (SELECT video, codec, avg(psnr) AS v FROM br GROUP BY ALL), pj AS (SELECT a.codec AS codec_a, b.codec AS codec_b, count(*) AS n, avg(a.v - b.v) AS mean_diff, stddev_samp(a.v - b.v) AS sd, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) AS va, var_samp(b.v) AS vb
 FROM pv a JOIN pv b ON a.video = b.video AND a.codec < b.codec GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "jump_extract": f"WITH {_CH}, rk AS (SELECT block, c, dense_rank() OVER (PARTITION BY block ORDER BY c) - 1 AS mark FROM (SELECT DISTINCT block, c FROM g)) SELECT ch.block::BIGINT AS block, t, x, mark FROM ch JOIN rk ON rk.block = ch.block AND rk.c = ch.c WHERE p IS NOT NULL AND b",
    "jump_vector": f"WITH {_CH} SELECT block::BIGINT AS block, x, count(*) FILTER (b) AS n, count(*) AS r FROM ch GROUP BY ALL",
    "mask_change_by_color": f"WITH {_CH} SELECT block::BIGINT AS block, t, count(*) AS n_pixels FROM ch WHERE p IS NOT NULL AND (c = 8) <> (p = 8) GROUP BY ALL",
    "pixel_struct": f"WITH {_CH} SELECT block::BIGINT AS block, x, count(*) AS n, string_agg(t::VARCHAR, ',' ORDER BY t) AS dates, string_agg(c::VARCHAR, ',' ORDER BY t) AS colors FROM ch WHERE b GROUP BY block, x",
    "state_entry_intensity": f"WITH {_CH} SELECT block::BIGINT AS block, c AS state, t, count(*) AS n_entries FROM ch WHERE b GROUP BY ALL",
    "sequence_rebuild": f"WITH {_G} SELECT block::BIGINT AS block, x, t, c FROM g",
    "mono_decomposition": f"WITH {_EV} SELECT block_id, mark, count(*) AS n, string_agg(t::VARCHAR, ',' ORDER BY t) AS times FROM ev GROUP BY block_id, mark",
    "markov_transitions": f"WITH {_EV}, {_SEQ} SELECT block_id, pm AS h, mark AS j, count(*) AS n FROM sq WHERE pm <> mark GROUP BY ALL",
    "markov_matrix_pivot": f"WITH {_EV}, {_SEQ} SELECT pm AS h, {', '.join(f'count(*) FILTER (mark = {i}) AS to_{i}' for i in range(5))} FROM sq WHERE pm <> mark GROUP BY pm",
    "mark_runs": f"WITH {_EV}, {_SEQ}, rn AS (SELECT *, sum(coalesce((mark <> pm)::INT, 0)) OVER (PARTITION BY block_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM sq) SELECT block_id, run::BIGINT AS run, mark, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM rn GROUP BY ALL",
    "state_at_time": f"WITH {_EV}, pr AS (SELECT block_id, t FROM (SELECT DISTINCT block_id FROM ev), range(0, 90, 10) r(t)) SELECT pr.block_id, pr.t, coalesce((SELECT max_by(mark, (ev.t, ev.seq)) FROM ev WHERE ev.block_id = pr.block_id AND ev.t <= pr.t), -1) AS mark FROM pr",
    "color_distribution": f"WITH {_EV}, {_CNT} SELECT block_id, mark, n, round(n / sum(n) OVER (PARTITION BY block_id), 6) AS p FROM mc",
    "color_entropy": f"WITH {_FEAT} SELECT en.block_id, en.N::BIGINT AS N, m_seen, round(en.H, 6) + 0.0 AS H, m_eff FROM en JOIN ef ON en.block_id = ef.block_id",
    "sequence_features": f"WITH {_FEAT} SELECT block_id, n_trans::BIGINT AS n_trans, round(R_temp, 6) + 0.0 AS R_temp FROM f",
    "block_features": f"WITH {_FEAT} SELECT block_id, N::BIGINT AS N, r::BIGINT AS r, m::BIGINT AS m, round(H, 6) + 0.0 AS H, m_eff, n_trans::BIGINT AS n_trans, round(R_temp, 6) + 0.0 AS R_temp FROM f",
    "spatial_features": f"""WITH {_G}, la AS (SELECT * FROM g QUALIFY t = max(t) OVER (PARTITION BY block)), nb AS (SELECT *, lead(c) OVER (PARTITION BY block ORDER BY x) AS nx, avg(c) OVER (PARTITION BY block) AS mu, var_pop(c) OVER (PARTITION BY block) AS va FROM la),
 a AS (SELECT block, avg((c = nx)::INT) AS eq, avg((c - mu) * (nx - mu)) AS cov, max(va) AS va, count(DISTINCT c) AS m, count(*) AS n, avg((abs(c - nx) > 1)::INT) AS edges FROM nb GROUP BY block)
 SELECT block::BIGINT AS block, round(coalesce(eq, 1.0), 6) AS H_s, round(CASE WHEN va < 1e-10 THEN 1.0 ELSE least(greatest((cov / va + 1) / 2, 0), 1) END, 6) AS rho, round(0.3 * m / least(n, 256) + 0.7 * coalesce(edges, 0), 6) AS texture FROM a""",
    "gop_jump_histogram": f"WITH {_CH} SELECT block::BIGINT AS block, t // 32 AS gop, c, count(*) AS n FROM ch WHERE b GROUP BY ALL",
    "color_costs": f"WITH {_FEAT}, cc AS (SELECT block_id, {_COL} FROM f) SELECT block_id, {_r(' '.join(_B))} FROM cc",
    "best_color_mode": f"WITH {_FEAT}, cc AS (SELECT block_id, {_COL} FROM f), {_least(_B, 'cc', 'be')} SELECT block_id, name, round(cost, 6) AS cost FROM be",
    "elias_exact_cost": f"WITH {_EV} SELECT block_id, sum(1 + floor(log2(mark + 1)) + 2 * floor(log2(1 + floor(log2(mark + 1)))))::BIGINT AS bd_exact FROM ev GROUP BY block_id",
    "huffman_threshold": f"WITH {_FEAT}, x AS (SELECT block_id, N, CASE WHEN log2(m) - H > 0 THEN m * (floor(log2(m)) + 1) / (log2(m) - H) END AS n_star FROM f) SELECT block_id, round(n_star, 6) AS n_star, N >= n_star AS pays FROM x",
    "temporal_costs": f"WITH {_FEAT}, cc AS (SELECT block_id, {_TMP} FROM f) SELECT block_id, {_r(' '.join(_T))} FROM cc",
    "temporal_costs_exhaustive": f"WITH {_FEAT}, cc AS (SELECT block_id, {_TMX} FROM f) SELECT block_id, {_r(' '.join(_T))} FROM cc",
    "cxb_cost_matrix": f"WITH {_CC} SELECT block_id, pair, round(cost, 6) AS cost FROM jo",
    "best_cxb": f"WITH {_CC} SELECT block_id, pair AS name, round(cost, 6) AS cost FROM jo QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY round(cost, 9), ord) = 1",
    "type_costs": f"WITH {_FEAT}, cc AS (SELECT block_id, {_TYP} FROM f) SELECT block_id, {_r(' '.join(_A))} FROM cc",
    "optimal_cartouche": f"""WITH {_FEAT}, ca AS (SELECT block_id, {_TYP} FROM f), cb AS (SELECT block_id, {_COL} FROM f), ct AS (SELECT block_id, {_TMX} FROM f), {_least(_A, 'ca', 'a')}, {_least(_B, 'cb', 'b')}, {_least(_T, 'ct', 'c')}
 SELECT a.block_id, a.name AS a, b.name AS b, c.name AS c, (a.ord * 16384 + b.ord * 4096 + c.ord * 512 + 8)::BIGINT AS code, round(a.cost + b.cost + c.cost, 6) AS cost FROM a JOIN b ON a.block_id = b.block_id JOIN c ON a.block_id = c.block_id""",
    "uniform_codelengths": f"WITH {_FEAT}, x AS (SELECT block_id, r * log2(m) AS L1, CASE WHEN N = 0 THEN log2(r) ELSE log2(N) + N * (log2(r) + log2(m)) END AS L2, r + N * log2(m) AS L3, CASE WHEN N = 0 OR N = r THEN log2(r) + N * log2(m) ELSE log2(N) + {_LC} + N * log2(m) END AS L4 FROM f) SELECT block_id, {_r('L1 L2 L3 L4')} FROM x",
    "process_type": f"WITH {_FEAT} SELECT block_id, CASE WHEN N = 0 THEN 'MARKED' WHEN m <= 4 AND m_eff >= m - 1 THEN 'MONO' ELSE 'MARKED' END AS kind, CASE WHEN N = 0 THEN 'R1' WHEN N < 50 THEN 'R2' ELSE 'R4b' END AS representation FROM f",
    "hellinger_bounds": f"WITH {_FEAT} SELECT block_id, round(5 * log2(N) / N, 6) AS bound, round(2.5 * log2(N), 6) AS mdl_penalty, round(2.5 * ln(N), 6) AS bic_penalty FROM f",
    "cartouche_pack": f"WITH {_PART} SELECT p_partkey, A * 16384 + B * 4096 + C * 512 + D * 128 + E * 32 + F * 8 + G * 2 + H AS code, true AS valid FROM fs",
    "cartouche_unpack": f"WITH {_PART} SELECT * FROM fs",
    "frame_quality": f"WITH {_QUAL} SELECT block::BIGINT AS block, t, {_r('mad psnr ssim')} FROM q",
    "video_quality": f"WITH {_QUAL} SELECT block::BIGINT AS block, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim, round(min(ssim), 6) AS min_ssim, round(max(ssim), 6) AS max_ssim, round(var_pop(ssim), 6) AS var_ssim FROM q GROUP BY block",
    "prediction_mode": f"WITH {_G}, lu AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY block, t ORDER BY x), 0) AS l, coalesce(lag(c) OVER (PARTITION BY block, x ORDER BY t), 0) AS u FROM g), rs AS ({_MODES}), rc AS (SELECT block, ord, mode, res, count(*) AS n FROM rs GROUP BY ALL), hh AS (SELECT block, ord, mode, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h FROM rc GROUP BY ALL) SELECT block::BIGINT AS block, mode, round(h, 6) AS h FROM hh QUALIFY row_number() OVER (PARTITION BY block ORDER BY h, ord) = 1",
    "palette_gate": f"WITH {_G}, p AS (SELECT block, count(DISTINCT c) AS m, count(*) AS n FROM g GROUP BY block), q AS (SELECT *, greatest(1, ceil(log2(m)))::BIGINT AS index_bits FROM p) SELECT block::BIGINT AS block, m, n, index_bits, index_bits < 8 AND m <= 64 AS use, n * (8 - index_bits) - m * 8 AS saving FROM q",
    "palette_index": f"WITH {_G} SELECT block::BIGINT AS block, c, dense_rank() OVER (PARTITION BY block ORDER BY c) - 1 AS idx FROM (SELECT DISTINCT block, c FROM g)",
    "nearest_palette": f"WITH {_RGB}, ne AS ({_NEAR}) SELECT p_partkey, r, g, b, idx, dist FROM ne QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY dist, idx) = 1",
    "ycbcr": f"WITH {_RGB} SELECT p_partkey, {_CLIP('((66 * r + 129 * g + 25 * b + 128) >> 8) + 16')} AS y, {_CLIP('floor((-38 * r - 74 * g + 112 * b + 128) / 256.0) + 128')} AS cb, {_CLIP('floor((112 * r - 94 * g - 18 * b + 128) / 256.0) + 128')} AS cr FROM co",
    "split_tree": f"""WITH {_G}, nd AS ({_NODES}), nc AS (SELECT block, size, node, c, count(*) AS n FROM nd GROUP BY ALL), bi AS (SELECT block, size, node, floor(round(sum(n) * log2(sum(n)) - sum(n * log2(n)) + 8 * count(*), 6))::BIGINT AS bits FROM nc GROUP BY ALL),
 b8 AS (SELECT block, node, bits AS best, 1 AS leaves FROM bi WHERE size = 8),
 {', '.join(f"k{s} AS (SELECT block, node // 2 AS node, sum(best) + 2 AS split, sum(leaves) AS leaves FROM b{s // 2} GROUP BY ALL), b{s} AS (SELECT bi.block, bi.node, least(bits, split) AS best, CASE WHEN split < bits THEN leaves ELSE 1 END AS leaves FROM bi JOIN k{s} k ON k.block = bi.block AND k.node = bi.node WHERE size = {s})" for s in (16, 32, 64))}
 SELECT block::BIGINT AS block, node, best::BIGINT AS best, leaves::BIGINT AS leaves FROM b64""",
    "integer_code_lengths": "WITH x AS (SELECT p_partkey, length(bin(p_partkey)) - 1 AS k FROM part WHERE p_partkey > 0) SELECT p_partkey, 2 * k + 1 AS gamma, 1 + k + 2 * (length(bin(1 + k)) - 1) AS delta, repeat('0', k::BIGINT) || bin(p_partkey) AS code, bit_count(p_partkey)::BIGINT AS ones, (bit_count((p_partkey & -p_partkey) - 1))::BIGINT AS zeros FROM x",
    "log_binomial": "WITH x AS (SELECT p_partkey, (p_partkey % 64)::DOUBLE AS k FROM part) SELECT p_partkey, round(CASE WHEN k > 0 AND k < 60 THEN (lgamma(61.0) - lgamma(k + 1) - lgamma(61.0 - k)) / ln(2) ELSE 0 END, 6) + 0.0 AS bits FROM x",
    "intensity_histogram": f"WITH {_HIST} SELECT event_type, bin, n, round(alpha, 6) AS alpha FROM h",
    "intensity_cdf": f"WITH {_HIST} SELECT event_type, bin, round(CASE WHEN sum(n) OVER (PARTITION BY event_type) > 0 THEN sum(n) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY event_type) ELSE (bin + 1) / 15.0 END, 6) AS cdf FROM h",
    "moving_intensity": f"WITH {_HIST} SELECT a.event_type, a.bin, round(sum(b.n) / 5, 6) AS smooth FROM h a, range(-2, 3) o(d), h b WHERE b.event_type = a.event_type AND b.bin = CASE WHEN a.bin + d < 0 THEN -1 - (a.bin + d) WHEN a.bin + d > 14 THEN 29 - (a.bin + d) ELSE a.bin + d END GROUP BY ALL",
    "histogram_mle": f"WITH {_HIST}, us AS (SELECT event_type, count(DISTINCT block_id) AS u FROM ev GROUP BY event_type) SELECT h.event_type, bin, round(alpha / u, 6) AS alpha FROM h JOIN us ON us.event_type = h.event_type",
    "hellinger_distance": f"WITH {_HIST}, p AS (SELECT event_type, bin, n / sum(n) OVER (PARTITION BY event_type) AS p FROM h) SELECT round(sum((sqrt(a.p) - sqrt(b.p)) ** 2) / 2, 6) AS h2 FROM p a JOIN p b ON a.bin = b.bin AND a.event_type = 'click' AND b.event_type = 'purchase'",
    "codec_summary": f"WITH {_RUNS}, {_SUM} SELECT codec, n, {_r('ratio psnr ssim bitrate overall_ratio', 4)} FROM su",
    "codec_compare_stats": f"WITH {_RUNS} SELECT codec, round(avg(bitrate), 3) AS mean, round(stddev_pop(bitrate), 3) AS std, round(min(bitrate), 3) AS min, round(max(bitrate), 3) AS max, round(median(bitrate), 3) AS median FROM br GROUP BY codec",
    "best_codec_per_video": f"WITH {_RUNS} SELECT video, codec, quality_param, round(psnr, 4) AS psnr FROM br QUALIFY row_number() OVER (PARTITION BY video ORDER BY psnr DESC, codec, quality_param) = 1",
    "smallest_ratio_per_video": f"WITH {_RUNS} SELECT video, codec, quality_param, round(ratio, 4) AS ratio FROM rr QUALIFY row_number() OVER (PARTITION BY video ORDER BY ratio, codec, quality_param) = 1",
    "codec_rankings": f"WITH {_RUNS}, {_SUM} SELECT codec, {', '.join(f'row_number() OVER (ORDER BY {m} DESC, codec) AS rank_{m}' for m in ('ratio', 'psnr', 'ssim', 'bitrate'))} FROM su",
    "rd_points": f"WITH {_RUNS} SELECT video, codec, count(*) OVER (PARTITION BY video, codec) AS n, row_number() OVER (PARTITION BY video, codec ORDER BY bitrate, psnr) - 1 AS i, round(bitrate, 4) AS bitrate, round(psnr, 4) AS psnr FROM br",
    "last_write_wins": f"WITH {_RUNS} SELECT video, codec, quality_param, n_frames FROM br QUALIFY row_number() OVER (PARTITION BY video, codec ORDER BY quality_param DESC) = 1",
    "pairwise_codecs": f"WITH {_RUNS}, {_PAIR} SELECT codec_a, codec_b, n, round(mean_diff, 4) + 0.0 AS mean_diff, round(CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n)) ELSE 0 END, 4) + 0.0 AS t, round(CASE WHEN va + vb > 0 THEN (ma - mb) / sqrt((va + vb) / 2) ELSE 0 END, 4) + 0.0 AS d FROM pj",
    "anova_f": f"WITH {_RUNS}, g AS (SELECT codec, count(*) AS n, sum(psnr) AS s, sum(psnr * psnr) AS q FROM br GROUP BY codec), a AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g) SELECT k, n::BIGINT AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM a",
    "kruskal_h": f"""WITH {_RUNS}, v AS (SELECT psnr, count(*) AS t FROM br GROUP BY psnr), rk AS (SELECT psnr, t, sum(t) OVER (ORDER BY psnr ROWS UNBOUNDED PRECEDING) - (t - 1) / 2.0 AS rk FROM v), g AS (SELECT codec, count(*) AS n, sum(rk) AS s FROM br JOIN rk ON rk.psnr = br.psnr GROUP BY codec),
 a AS (SELECT count(*) AS k, sum(n)::DOUBLE AS N, sum(s * s / n) AS b FROM g) SELECT k, N::BIGINT AS N, round((12.0 / (N * (N + 1)) * b - 3 * (N + 1)) / (1 - (SELECT sum(t * t * t - t) FROM v) / (N * N * N - N)), 4) AS h FROM a""",
    "confidence_interval_z": f"WITH {_RUNS}, c AS (SELECT codec, count(*) AS n, avg(psnr) AS mean, stddev_samp(psnr) / sqrt(count(*)) AS se FROM br GROUP BY codec) SELECT codec, n, round(mean, 4) AS mean, round(mean - 1.96 * se, 4) AS lo, round(mean + 1.96 * se, 4) AS hi FROM c",
    "accuracy_metrics": f"""WITH {_PRED}, x AS (SELECT *, greatest(predicted_cost - optimal_cost, 0) AS pe FROM bp) SELECT count(*) AS n, round(avg((act_a = pred_a AND act_b = pred_b AND act_c = pred_c)::INT), 6) AS exact, {', '.join(f'round(avg((act_{d} = pred_{d})::INT), 6) AS acc_{d}' for d in 'abc')},
 round(avg(pe), 6) AS mean_penalty, max(pe) AS max_penalty, round(stddev_pop(pe), 6) AS std_penalty, {', '.join(f'round(quantile_cont(pe, {q / 100}), 6) AS p{q}' for q in (50, 75, 90, 95, 99))} FROM x""",
    "confusion_matrix": f"WITH {_CM} SELECT * FROM cm",
    "class_prf": f"""WITH {_CM}, cl AS (SELECT dim, act AS cls FROM cm UNION SELECT dim, pred FROM cm), x AS (SELECT dim, cls, coalesce((SELECT sum(n) FROM cm WHERE cm.dim = cl.dim AND act = cls AND pred = cls), 0) AS tp, coalesce((SELECT sum(n) FROM cm WHERE cm.dim = cl.dim AND act = cls), 0) AS na, coalesce((SELECT sum(n) FROM cm WHERE cm.dim = cl.dim AND pred = cls), 0) AS np FROM cl),
 y AS (SELECT dim, cls, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN na > 0 THEN tp / na ELSE 0 END AS recall FROM x) SELECT dim, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM y""",
    "worst_confusions": f"WITH {_CM} SELECT dim, act, pred, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, act, pred) AS rank FROM cm WHERE act <> pred QUALIFY rank <= 5",
    "error_combinations": f"WITH {_PRED} SELECT act_a <> pred_a AS err_a, act_b <> pred_b AS err_b, act_c <> pred_c AS err_c, count(*) AS n FROM bp GROUP BY ALL",
    "grid_configs": f"WITH {_CONF} SELECT count(*) AS n, {', '.join(f'round(sum({k}), 4) AS {k}' for k in _GRID)} FROM cf",
    "grid_objective_topk": f"""WITH {_FEAT}, {_CONF}, co AS (SELECT block_id, N / r AS density, {_TMP} FROM f), pr AS (SELECT DISTINCT R1_max, R4b_R2 FROM cf), su AS (SELECT R1_max, R4b_R2, sum(CASE WHEN density <= R1_max THEN R1 WHEN density <= R4b_R2 THEN R4b ELSE R2 END) AS cost FROM co, pr GROUP BY ALL)
 SELECT config_id, cf.R1_max::DOUBLE AS R1_max, cf.R4b_R2::DOUBLE AS R4b_R2, round(cost, 4) AS cost FROM cf JOIN su ON su.R1_max = cf.R1_max AND su.R4b_R2 = cf.R4b_R2 ORDER BY round(cost, 6), config_id LIMIT 10""",
    "ql_block": f"WITH {_ST} SELECT id, tag, round(magnitude, 6) AS magnitude FROM vs WHERE bx = 1 AND \"by\" = 2 AND magnitude > 50",
    "ql_spatial": f"WITH {_ST} SELECT \"by\", bx, count(*) AS n FROM vs WHERE (bx - 1) ** 2 + (\"by\" - 1) ** 2 <= 1 GROUP BY ALL",
    "ql_semantic": f"WITH {_ST} SELECT id, \"by\", bx, tag FROM vs WHERE tag = 'click' AND magnitude > 20 AND ((\"by\" = 0 AND bx = 1) OR (\"by\" = 2 AND bx = 3))",
    "ql_detect": f"WITH {_ST}, w AS (SELECT \"by\", bx, epoch(time)::BIGINT // 21600 * 21600 AS t0, count(*) AS n FROM vs GROUP BY ALL), d AS (SELECT *, n - lag(n) OVER (PARTITION BY \"by\", bx ORDER BY t0) AS intensity_change FROM w) SELECT * FROM d WHERE abs(intensity_change) > 3",
    "sliding_intensity": "SELECT epoch(ts)::BIGINT // 21600 * 21600 - o * 21600 AS t0, event_type, count(*) AS n FROM events, range(2) r(o) GROUP BY ALL",
}

_PX = f"""{_G}, fr AS (SELECT block, t, row_number() OVER (PARTITION BY block ORDER BY t) - 1 AS f FROM (SELECT DISTINCT block, t FROM g)), gp AS (SELECT g.block, g.x, g.c, f, f // 32 AS gop FROM g JOIN fr ON fr.block = g.block AND fr.t = g.t),
 gl AS (SELECT *, lag(c) OVER (PARTITION BY block, gop, x ORDER BY f) AS p FROM gp), gb AS (SELECT *, p IS NULL OR p <> c AS b FROM gl),
 px AS (SELECT block, gop, x, count(*) AS r, count(*) FILTER (b) AS n, min_by(c, f) AS first, string_agg(b::INT::VARCHAR, '' ORDER BY f) AS pattern FROM gb GROUP BY ALL),
 pb AS (SELECT *, CASE WHEN n > 0 AND n < r THEN length(bin(round(exp(lgamma(r + 1.0) - lgamma(n + 1.0) - lgamma(r - n + 1.0)))::BIGINT - 1)) ELSE 0 END AS sb, length(bin(r)) AS d FROM px),
 pl AS (SELECT *, r * 8 AS L1, d + n * (d + 8) AS L2, r + n * 8 AS L3, d + sb + n * 8 AS L4 FROM pb)"""
_VER = """v1 AS (SELECT video, sum(output_size) * 8 / sum(input_size) AS bpp, avg(ratio) AS ratio FROM rr WHERE quality_param = 'F' GROUP BY video), v0 AS (SELECT video, sum(output_size) * 8 / sum(input_size) AS bpp, avg(ratio) AS ratio FROM rr WHERE quality_param = 'P' GROUP BY video),
 de AS (SELECT v1.video, coalesce(v0.bpp, 8) - v1.bpp AS bpp_delta, v1.ratio / greatest(coalesce(v0.ratio, 1), 0.01) - 1 AS ratio_delta FROM v1 LEFT JOIN v0 ON v0.video = v1.video)"""
_GRIDCOST = f"{_FEAT}, {_CONF}, co AS (SELECT block_id, N / r AS density, {_TMP} FROM f), pr AS (SELECT DISTINCT R1_max, R4b_R2 FROM cf), su AS (SELECT R1_max, R4b_R2, sum(CASE WHEN density <= R1_max THEN R1 WHEN density <= R4b_R2 THEN R4b ELSE R2 END) AS cost FROM co, pr GROUP BY ALL), gc AS (SELECT config_id, cost FROM cf JOIN su ON su.R1_max = cf.R1_max AND su.R4b_R2 = cf.R4b_R2)"
_STEPS = [_n for _, _, _n in _GRID.values()]
_MOVES = []
_step = 32000
for _n in _STEPS:
    _step //= _n
    _MOVES += [f"SELECT id, id - {_step} AS nb FROM ids WHERE id // {_step} % {_n} > 0", f"SELECT id, id + {_step} FROM ids WHERE id // {_step} % {_n} < {_n - 1}"]
_LCM = "CASE WHEN n > 0 AND n < 90 THEN (lgamma(91.0) - lgamma(n + 1.0) - lgamma(91.0 - n)) / ln(2) ELSE 0 END"

ORACLE_SQL |= {
    "pixel_rep_lengths": f"WITH {_PX} SELECT block::BIGINT AS block, gop, x, L1, L2, L3, L4 FROM pl",
    "block_process_lengths": f"""WITH {_PX}, wh AS (SELECT block, gop, max(r) AS r, count(*) AS px, sum(n) AS jumps, max(n) = 1 AS still, count(DISTINCT first) AS firsts, least(sum(L1), sum(L2), sum(L3), sum(L4)) AS pp, sum(L4) AS all4 FROM pl GROUP BY ALL),
 tr AS (SELECT block, gop, count(DISTINCT (p, c)) AS nb FROM gb WHERE p IS NOT NULL AND b GROUP BY ALL), pa AS (SELECT block, gop, pattern, count(*) AS k, max(n) AS nd, sum(L4) AS r4 FROM pl GROUP BY ALL), tp AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY block, gop ORDER BY k DESC, pattern DESC) = 1),
 x AS (SELECT wh.block, wh.gop, CASE WHEN still AND firsts = 1 THEN 15 ELSE -1 END AS mono, 8 + pp AS pp, CASE WHEN 10 * k >= 4 * px THEN 8 + r + 2 * (length(bin(nd)) - 1) + 1 + k * (1 + nd * 8) + (px - k) + all4 - r4 ELSE -1 END AS spatial,
  CASE WHEN coalesce(nb, 0) > 0 THEN 7 + 2 * (length(bin(nb)) - 1) + 1 + nb * 16 + 1 + px * 8 + px * (r - 1) + (jumps - px) * greatest(1, ceil(log2(greatest(nb, 2)))) ELSE -1 END AS markov FROM wh JOIN tp ON tp.block = wh.block AND tp.gop = wh.gop LEFT JOIN tr ON tr.block = wh.block AND tr.gop = wh.gop),
 y AS (SELECT *, least(CASE WHEN mono >= 0 THEN mono END, pp, CASE WHEN spatial >= 0 THEN spatial END, CASE WHEN markov >= 0 THEN markov END) AS lo FROM x)
 SELECT block::BIGINT AS block, gop, mono::BIGINT AS mono, pp::BIGINT AS pp, spatial::BIGINT AS spatial, markov::BIGINT AS markov, CASE lo WHEN mono THEN 'mono' WHEN pp THEN 'pp' WHEN spatial THEN 'spatial' ELSE 'markov' END AS process FROM y""",
    "mono_vs_marked": f"WITH {_FEAT}, cc AS (SELECT block_id, {_COL}, {_TMP} FROM f), mo AS (SELECT block_id, sum(log2(n + 1) + {_LCM}) AS mono FROM mc GROUP BY block_id) SELECT mo.block_id, round(mono, 6) AS mono, round(R4b + least(Ba, Bb, Bc), 6) AS marked, round(R4b + least(Ba, Bb, Bc) - mono, 6) + 0.0 AS gain FROM mo JOIN cc ON cc.block_id = mo.block_id",
    "markov_chi2": f"WITH {_EV}, {_SEQ}, tr AS (SELECT block_id, pm AS h, mark AS j, count(*) AS n FROM sq WHERE pm <> mark GROUP BY ALL), fl AS (SELECT b.block_id, h.h, j.j, 1 + coalesce(tr.n, 0) AS n FROM (SELECT DISTINCT block_id FROM tr) b, range(5) h(h), range(5) j(j) LEFT JOIN tr ON tr.block_id = b.block_id AND tr.h = h.h AND tr.j = j.j), e AS (SELECT block_id, n, sum(n) OVER (PARTITION BY block_id, h) * sum(n) OVER (PARTITION BY block_id, j) / sum(n) OVER (PARTITION BY block_id) AS e FROM fl) SELECT block_id, round(sum((n - e) ** 2 / e), 6) AS chi2 FROM e GROUP BY block_id",
    "symmetric_counter_bound": f"WITH {_FEAT} SELECT block_id, round(least(log2(greatest(least(N, r), 1)), log2(greatest(r - least(N, r), 1))) + {_LC} + N * log2(m), 6) AS bound FROM f",
    "zoom_level": "SELECT (CASE WHEN o_totalprice >= 200000 THEN 0 WHEN o_totalprice >= 100000 THEN 1 WHEN o_totalprice >= 50000 THEN 2 ELSE 3 END)::BIGINT AS level, count(*) AS n FROM orders GROUP BY ALL",
    "pyramid_lod": "WITH RECURSIVE d AS (SELECT 0::BIGINT AS level, 0::BIGINT AS node UNION ALL SELECT level + 1, node * 4 + k FROM d, range(4) r(k) WHERE level < 4 AND NOT (level > 0 AND node % 5 = 0)) SELECT level, count(*) AS n, sum(node)::BIGINT AS s, count(*) FILTER (level > 0 AND node % 5 = 0) AS n_static FROM d GROUP BY level",
    "tag_intervals": f"WITH {_EV}, {_SEQ}, rn AS (SELECT *, sum(coalesce((mark <> pm)::INT, 0)) OVER (PARTITION BY block_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM sq), tg AS (SELECT block_id, run, min(t) AS t0, max(t) AS t1 FROM rn GROUP BY block_id, run, mark HAVING count(*) >= 3) SELECT ev.block_id, run::BIGINT AS run, count(*) AS n, min(t) AS lo, max(t) AS hi FROM ev JOIN tg ON tg.block_id = ev.block_id AND t BETWEEN t0 AND t1 GROUP BY ALL",
    "covering_block": f"WITH {_G} SELECT block::BIGINT AS block, t // 50 * 4 + (x // 8) // 4 * 2 + (x % 8) // 4 AS block_no, count(*) AS n FROM g GROUP BY ALL",
    "lut_quantize": f"WITH {_RGB} SELECT p_partkey, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS cell FROM co",
    "transition_index": f"WITH {_EV}, {_SEQ}, tr AS (SELECT block_id, pm AS h, mark AS j, count(*) AS n FROM sq WHERE pm <> mark GROUP BY ALL) SELECT *, dense_rank() OVER (PARTITION BY block_id ORDER BY h, j) - 1 AS idx FROM tr",
    "corpus_delta": f"WITH {_RUNS}, {_VER} SELECT video, {_r('bpp_delta ratio_delta')} FROM de",
    "corpus_delta_eval": f"WITH {_RUNS}, {_VER}, j AS (SELECT count(*) AS n, avg(bpp_delta) AS bpp, avg(ratio_delta) AS ratio, stddev_pop(ratio_delta) AS std, count(*) FILTER (ratio_delta < -0.01) AS regressions FROM de) SELECT n, {_r('bpp ratio std')}, regressions, round(greatest(0, 1 - std / greatest(abs(ratio), 0.001)), 6) AS confidence, CASE WHEN ratio > 0.001 AND regressions = 0 THEN 'accept' ELSE 'reject' END AS recommendation FROM j",
    "untested_rules": "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "next_rule": "SELECT p_partkey, p_size::BIGINT AS priority, p_name AS name FROM part ORDER BY p_size, p_name, p_partkey LIMIT 1",
    "gen_gradient": "SELECT t, y, x, y * 255 // 15 AS c FROM range(4) a(t), range(16) b(y), range(16) c(x)",
    "gen_moving_square": "SELECT t, y, x, CASE WHEN x - t BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 THEN 200 ELSE 50 END::BIGINT AS c FROM range(16) a(t), range(16) b(y), range(16) c(x)",
    "aggregate_performance": f"WITH {_RUNS} SELECT count(*) AS n, round(sum(input_size), 4) AS total_in, round(sum(output_size), 4) AS total_out, round(sum(input_size) / sum(output_size), 4) AS overall, round(avg(ratio), 4) AS mean_ratio, round(min(ratio), 4) AS min_ratio, round(max(ratio), 4) AS max_ratio, round(stddev_pop(ratio), 4) AS std_ratio FROM rr",
    "results_filter": f"WITH {_RUNS} SELECT video, codec, quality_param, {_r('input_size output_size bitrate psnr ssim', 4)}, n_frames FROM br WHERE codec = '1-URGENT' AND quality_param = 'F'",
    "wilcoxon_stat": f"""WITH {_RUNS}, p AS (SELECT video, avg(bitrate) FILTER (codec = '1-URGENT') AS a, avg(bitrate) FILTER (codec = '5-LOW') AS b FROM br GROUP BY video), d AS (SELECT round(a - b, 9) AS d FROM p WHERE round(a - b, 9) <> 0), rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d),
 s AS (SELECT count(*)::DOUBLE AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0))::DOUBLE AS w FROM rk) SELECT n::BIGINT AS n, round(w, 6) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
    "best_config_per_base": f"WITH {_RUNS}, x AS (SELECT regexp_replace(video, '_[^_]*$', '') AS base, codec, video || '/' || quality_param AS quality_param, ratio FROM rr) SELECT base, codec, quality_param, round(ratio, 4) AS ratio FROM x QUALIFY row_number() OVER (PARTITION BY base ORDER BY ratio DESC, codec, quality_param) = 1",
    "running_best": f"WITH {_GRIDCOST} SELECT config_id, min(round(cost, 4)) OVER (ORDER BY config_id ROWS UNBOUNDED PRECEDING) AS best FROM gc",
    "grid_neighbors": f"WITH ids AS (SELECT range AS id FROM range(32000)), nb AS ({' UNION ALL '.join(_MOVES)}) SELECT id AS config_id, count(*) AS n, min(nb) AS lo, max(nb) AS hi FROM nb GROUP BY id",
    "grid_objective_full": f"WITH {_GRIDCOST} SELECT count(*) AS n, round(min(cost), 4) AS best, round(max(cost), 4) AS worst, count(DISTINCT round(cost, 6)) AS levels FROM gc",
    "integer_codes": "WITH x AS (SELECT p_partkey, p_partkey % 100 AS n FROM part) SELECT p_partkey, repeat('1', n) || '0' AS unary, repeat('1', n // 4) || '0' || lpad(bin(n % 4), 2, '0') AS golomb4, repeat('1', n // 16) || '0' || lpad(bin(n % 16), 4, '0') AS rice4 FROM x",
    "temporal_arrays": f"""WITH {_EV}, us AS (SELECT block_id, list_sort(list(t)) AS r1 FROM ev GROUP BY block_id), c AS (SELECT block_id, r1, list_transform(range(90), lambda i: len(list_filter(r1, lambda x: x = i))) AS r2 FROM us)
 SELECT block_id, array_to_string(r1, ',') AS r1, array_to_string(r2, ',') AS r2, array_to_string(list_transform(range(1, len(r1) + 1), lambda i: CASE WHEN i = 1 THEN r1[1] ELSE r1[i] - r1[i - 1] END), ',') AS r3, array_to_string(list_transform(r2, lambda x: (x > 0)::INT), ',') AS r4a, len(list_distinct(r1))::BIGINT AS n_distinct FROM c""",
    "convergence_rate": f"""WITH {_EV}, e AS (SELECT block_id, t // 6 AS bin FROM ev), wh AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY bin), sz AS (SELECT 2 ** unnest(range(1, floor(log2((SELECT max(block_id) FROM ev) + 1))::BIGINT + 1)) AS s), pt AS (SELECT s, bin, count(*) / sum(count(*)) OVER (PARTITION BY s) AS q FROM e, sz WHERE block_id < s GROUP BY s, bin),
 h AS (SELECT sz.s, sum((sqrt(p) - sqrt(coalesce(q, 0))) ** 2) / 2 AS h2 FROM wh, sz LEFT JOIN pt ON pt.s = sz.s AND pt.bin = wh.bin GROUP BY sz.s) SELECT round(-regr_slope(ln(h2), ln(s)), 6) AS gamma, count(*) AS n FROM h WHERE h2 > 1e-12""",
    "log_likelihood": f"WITH {_HIST} SELECT event_type, round(sum(n * ln(greatest(alpha, 1e-10))) - sum(alpha * 6) - sum(n) * ln(5), 6) AS loglik, round(7.5 * ln(sum(n)) / ln(2), 6) AS penalty FROM h GROUP BY event_type",
    "error_cube": f"WITH {_PRED}, e AS (SELECT (act_a <> pred_a)::INT AS a, (act_c <> pred_c)::INT AS c FROM bp) SELECT coalesce(a, -1)::BIGINT AS a, coalesce(c, -1)::BIGINT AS c, count(*) AS n, grouping(a, c) AS g FROM e GROUP BY CUBE (a, c)",
    "subsample_420": f"WITH {_G} SELECT block::BIGINT AS block, t, (x // 8) // 2 AS y, (x % 8) // 2 AS x, ((sum(c) + 2) // 4)::BIGINT AS c FROM g GROUP BY ALL",
    "session_counts": "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}

_LCB = lambda k: f"CASE WHEN {k} > 0 AND {k} < r THEN (lgamma(r + 1.0) - lgamma({k} + 1.0) - lgamma(r - {k} + 1.0)) / ln(2) ELSE 0 END"
_SPATIAL = ORACLE_SQL["spatial_features"].removeprefix("WITH ").rpartition("\n SELECT block::BIGINT AS block")[0]
ORACLE_SQL |= {
    "method_code": "WITH x AS (SELECT p_partkey, p_partkey % 4 AS proc, p_partkey * 3 % 4 AS rep, p_partkey * 5 % 3 AS comp, p_partkey % 2 AS col FROM part) SELECT p_partkey, proc * 32 + rep * 8 + comp * 2 + col AS code, proc, rep, comp, col FROM x",
    "uri_fragment": "SELECT p_partkey, p_partkey::VARCHAR AS t, '1,2' AS b, (p_partkey % 3)::VARCHAR AS lod, NULL::VARCHAR AS tag FROM part",
    "feature_rollup": f"WITH {_FEAT} SELECT count(*) AS blocks, round(avg(N), 6) AS mean_n, round(avg(N / r), 6) AS density, round(avg(H), 6) AS mean_h, sum(N)::BIGINT AS total FROM f",
    "process_type_5": f"""WITH {_SPATIAL}, sp AS (SELECT block, coalesce(eq, 1.0) AS H_s, CASE WHEN va < 1e-10 THEN 1.0 ELSE least(greatest((cov / va + 1) / 2, 0), 1) END AS rho FROM a), j AS (SELECT block, c, p FROM (SELECT block, c, lag(c) OVER (PARTITION BY block, x ORDER BY t) AS p FROM g) WHERE p <> c), jc AS (SELECT block, c, count(*) AS n FROM j GROUP BY ALL),
 al AS (SELECT block, count(DISTINCT c) AS m, count(DISTINCT t) * count(DISTINCT x) AS r FROM g GROUP BY block), mo AS (SELECT jc.block, m, r, sum(log2(n + 1) + {_LCB('n')}) AS mono, sum(n) AS N FROM jc JOIN al ON al.block = jc.block GROUP BY ALL), mk AS (SELECT *, log2(N + 1) + {_LCB('N')} + N * log2(m) AS marked FROM mo)
 SELECT sp.block::BIGINT AS block, CASE WHEN H_s > 0.7 AND rho > 0.8 THEN 'JOINT' WHEN rho < 0.15 THEN 'MARGINAL' WHEN marked > mono THEN 'MONO' ELSE 'MARKED' END AS kind, round(marked - mono, 3) + 0.0 AS gain FROM sp JOIN mk ON mk.block = sp.block""",
    "stall_lengths": "WITH o AS (SELECT o_custkey, o_orderstatus, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM orders), r AS (SELECT o_custkey, k, count(*) FILTER (o_orderstatus <> 'F') AS n FROM o GROUP BY ALL) SELECT o_custkey, max(n) AS longest, max((n >= 5)::INT)::BIGINT AS stops FROM r GROUP BY o_custkey",
    "version_progression": f"WITH {_RUNS}, v AS (SELECT video, quality_param AS version, avg(ratio) AS ratio FROM rr GROUP BY ALL) SELECT video, version, round(ratio, 4) AS ratio, round(ratio - lag(ratio) OVER (PARTITION BY video ORDER BY version), 4) + 0.0 AS delta FROM v",
    "ql_table_function": f"WITH {_ST} SELECT tag, count(*) AS n FROM vs WHERE (bx - 1) ** 2 + (\"by\" - 1) ** 2 <= 1 GROUP BY tag",
}
