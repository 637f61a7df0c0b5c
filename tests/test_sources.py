"""Readers, writers, grids, codecs, registry and resumable steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jumpmark import registry
from jumpmark.functions import bits, scalar
from jumpmark.operators import codec, generate, search
from jumpmark.plans import choices, fixed, reports  # noqa: F401  register their queries
from jumpmark.sources import blockvideo, grids, stores

GRID = """
# axes
block_sizes: [8, 16]     # side
r_frames: [32, 64]
m_colors: [8, 16]
prec_bits: 8
intensity_types:
  - homogeneous
  - linear
intensity_params:
  homogeneous:
    - {lambda0: 0.01}
    - {lambda0: 0.1}
  linear:
    - {a: -0.001, b: 0.1}
basis_families: [histogram, polynomial]
dimensions: [2, 4, 8]
"""


def test_grid(spark):
    g = grids.parse(GRID)
    assert g["prec_bits"] == 8 and g["intensity_types"] == ["homogeneous", "linear"] and g["intensity_params"]["linear"] == [{"a": -0.001, "b": 0.1}]
    runs = grids.runs(spark, g)
    assert runs.count() == 2 * 2 * 2 * 3 * 2 * 3 and runs.where("intensity = 'linear'").first()["params"] == {"a": -0.001, "b": 0.1}
    assert grids.runs(spark, fixed.SIMULATION).count() == 384 and grids.parse("") == {}


def test_bits():
    w = bits.BitWriter().number(0b101, 3).number(0xFF, 8).raw("1").raw("0").number(12345, 16).gamma(42).delta(1000)
    r = bits.BitReader(w.bytes())
    assert (r.number(3), r.number(8), r.raw(1), r.raw(1), r.number(16), r.gamma(), r.delta()) == (5, 255, "1", "0", 12345, 42, 1000)
    with pytest.raises(EOFError):
        bits.BitReader(b"\x00").gamma()
    assert not bits.huffman_pays([]) and not bits.huffman_pays([1, 2, 3]) and bits.huffman_pays([7] * 300 + [9])


@pytest.mark.parametrize("form", codec.TIMES)
@pytest.mark.parametrize("mode", codec.MARKS)
def test_marked_round_trip(form, mode):
    rng = random.Random(1)
    for n in (0, 1, 5, 30):
        for times in (sorted(rng.sample(range(64), n)), sorted(rng.choices(range(64), k=n))):
            marks = [rng.randrange(5) for _ in times]
            data, size = codec.encode_marked(times, marks, 64, 5, form, mode, 6450)
            assert codec.decode_marked(data) == (times, marks) and len(data) == -(-size["total"] // 8)


def test_blocks_round_trip():
    rng = random.Random(2)
    for share in (0.0, 0.1, 1.0):
        pixels = [[rng.randrange(4)] for _ in range(9)]
        for seq in pixels:
            for _ in range(15):
                seq.append(rng.randrange(4) if rng.random() < share else seq[-1])
        for process in codec.PROCESSES[1:]:
            if process == "markov" and not share:
                continue
            data, size = codec.encode_block(pixels, process)
            assert codec.decode_block(data, process, 9, 16) == pixels and len(data) == -(-size // 8)
    still = [[7] * 16] * 9
    assert codec.decode_block(*codec.encode_block(still, "mono")[:1], "mono", 9, 16) == still


def test_block_video(spark, tmp_path):
    cells = generate.bernoulli(generate.grid(spark, 20, 4, 4), 3, 0.2).select(F.floor(F.col("y") / 2).cast("long").alias("block"), "t", (F.col("y") % 2 * 4 + F.col("x")).cast("int").alias("x"), "c")
    own = registry.codec("Blocks")
    payloads = own.encode(cells).withColumns({"video": F.lit("clip"), "rows": F.lit(4), "columns": F.lit(4)})
    blockvideo.register(spark)
    path = str(tmp_path / "videos")
    blockvideo.files(payloads, "video").write.format("blockvideo").option("path", path).mode("append").save()
    read = spark.read.format("blockvideo").option("path", path).load()
    back = blockvideo.cells(read)
    got = {(r["block"], r["x"], r["k"]): r["c"] for r in back.collect()}
    assert got == {(r["block"], r["x"], r["t"]): r["c"] for r in cells.collect()} and {r["name"] for r in read.collect()} == {"clip"}
    assert stores.headers(spark, path).first()["magic"] == "PPV1"
    with pytest.raises(ValueError):
        list(blockvideo.unpack(b"PPV0"))


def test_registry(tmp_path):
    assert "blocks" in registry.available()
    registry.register("own", registry.BlockCodec)
    assert registry.codec("OWN").name == "blocks"
    with pytest.raises(KeyError):
        registry.codec("nothing")
    s = registry.Settings().with_thresholds(h_s=0.5)
    s.save(str(tmp_path / "s.json"))
    assert registry.Settings.load(str(tmp_path / "s.json")) == s and s.thresholds() == (0.5, 0.8, 0.15, 0.05)


def test_resumable(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert search.resumable(str(tmp_path / "step"), spark, build).count() == 5
    assert made == [1]
    search.save_configs(search.configs(spark).limit(7), str(tmp_path / "configs"))
    assert search.load_configs(spark, str(tmp_path / "configs")).count() == 7


def test_generators(spark):
    j = generate.poisson_jumps(spark, "homogeneous", 1000, 100, lambda0=0.1)
    per = j.count() / 1000
    assert abs(per - 100 * (1 - np.exp(-0.1))) < 0.3 and j.groupBy("pixel", "t").count().where("count > 1").count() == 0
    sin = generate.poisson_jumps(spark, "sinusoidal", 1000, 64).groupBy("t").count().collect()
    early = sum(r["count"] for r in sin if r["t"] < 16) - sum(r["count"] for r in sin if 16 <= r["t"] < 32)
    assert early > 0  # the wave is up first, then down
    b = generate.spatiotemporal_block(spark, "linear", 4, 32, 4, a=0.001, b=0.1)
    assert set(r["mark"] for r in b.collect()) <= {0, 1, 2, 3} and b.columns == ["pixel", "t", "mark", "family", "frames", "marks"]
    anim = generate.animation(generate.grid(spark, 16, 8, 8), 16, 8, 8)
    assert anim.groupBy("y", "x").agg(F.count_distinct("c").alias("n")).agg(F.max("n")).first()[0] <= 4


def test_scalars(spark):
    k = F.col("id")
    got = spark.range(-1, 7).select(scalar.comb(F.lit(5), k).alias("c"), scalar.log_comb(F.lit(5), k).alias("l"), scalar.log_star_bits(k).alias("s")).collect()
    assert [r["c"] for r in got] == [0, 1, 5, 10, 10, 5, 1, 0] and got[0]["l"] == float("-inf") and abs(got[3]["l"] - np.log(10)) < 1e-9
    assert [r["s"] for r in got] == [0, 0, 1, 2, 4, 4, 7, 7]
    big = spark.range(1).select(scalar.comb(F.lit(60), F.lit(30)).alias("c")).first()["c"]
    assert big == 118264581564861424


def test_fixed_tables(spark):
    assert fixed.rules(spark).count() == 20 and fixed.clips(spark).count() == 39 and fixed.codes(spark).where("field = 'F'").agg(F.min("code")).first()[0] == 1


def test_command_line(spark, tmp_path, capsys):
    from jumpmark.__main__ import main

    rng = np.random.RandomState(3)
    videos = {"a": rng.randint(0, 4, (40, 11, 9)), "b": np.repeat(rng.randint(0, 9, (1, 8, 8)), 5, axis=0)}
    (tmp_path / "in").mkdir()
    for name, v in videos.items():
        np.save(tmp_path / "in" / f"{name}.npy", v)
    main(["encode", str(tmp_path / "in"), str(tmp_path / "files")])
    main(["decode", str(tmp_path / "files"), str(tmp_path / "cells")])
    got = {(r["name"], r["t"], r["y"], r["x"]): r["c"] for r in spark.read.parquet(str(tmp_path / "cells")).collect()}
    assert got == {(f"{n}.npy", t, y, x): int(c) for n, v in videos.items() for (t, y, x), c in np.ndenumerate(v)}
    main(["info", str(tmp_path / "files")])
    main(["query"])
    shown = capsys.readouterr().out
    assert "a.npy" in shown and "quadtree_split" in shown
    with pytest.raises(SystemExit):
        main(["encode", "only-one"])


def test_volumes(spark, tmp_path):
    color = np.zeros((3, 4, 4, 3), np.uint8)
    color[..., 0] = 100
    np.save(tmp_path / "c.npy", color)
    rows = stores.volumes(spark, str(tmp_path), max_frames=2, size=(2, 2), fps=25.0).collect()
    assert len(rows) == 2 * 2 * 2 and {(r["c"], r["fps"]) for r in rows} == {(29, 25.0)}
    p = stores.palette_table(spark, [(1, 2, 3), (4, 5, 6)], str(tmp_path / "palette"))
    assert [tuple(r) for r in p.collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]


def test_pattern_benchmark(spark, sf):
    from jumpmark.plans.catalog import QUERIES

    r = {x["pattern"]: x for x in QUERIES["pattern_benchmark"](spark, sf).collect()}
    assert len(r) == 6 and r["gradient"]["bpp"] < r["animation"]["bpp"] < r["noise"]["bpp"] and all(x["blocks"] == 4 for x in r.values())


def test_arithmetic_coder():
    """Sequences come back, in about as many bits as their entropy, in time in proportion to their length."""
    from collections import Counter

    from jumpmark.functions import coding

    rng = random.Random(4)
    for n, weights in ((1, [1]), (5, [1, 1]), (500, [90, 5, 4, 1]), (60_000, [1, 2, 3, 4, 5])):
        seq = rng.choices(range(len(weights)), weights, k=n)
        freqs = dict(Counter(seq))
        bits = coding.arithmetic_encode(seq, freqs)
        assert coding.arithmetic_decode(bits, n, freqs) == seq
        entropy = -sum(c * np.log2(c / n) for c in freqs.values())
        assert entropy - 1 <= len(bits) <= entropy + 3 + n / 10_000


def test_result_store(spark, sf, tmp_path):
    from jumpmark import adapters
    from jumpmark.operators import results

    runs = adapters.bench_runs(spark, sf)
    half = runs.where("quality_param = 'F'")
    results.append(half, str(tmp_path / "store"))
    store = results.append(runs.where("quality_param <> 'F'"), str(tmp_path / "store"))
    assert store.count() == runs.count()
    one = runs.first()
    assert results.lookup(store, one["video"], one["codec"]).count() == runs.where((F.col("video") == one["video"]) & (F.col("codec") == one["codec"])).count()
    text = results.summary_table(store, ["psnr", "ssim"]).splitlines()
    assert text[0].split() == ["codec", "psnr", "ssim"] and len(text) == 1 + runs.select("codec").distinct().count()


def test_newton(spark):
    """The growth of times drawn from a known intensity."""
    from jumpmark.operators import intensity

    rng = np.random.RandomState(5)
    t = np.log(1 + rng.rand(20_000) * (np.exp(0.03 * 90) - 1)) / 0.03
    e = spark.createDataFrame([("a", float(v) - 0.5) for v in t], "event_type string, t double")
    r = intensity.newton_exponential(e, 90.0).first()
    assert abs(r["growth"] - 0.03) < 0.002 and abs(r["rate"] * (np.exp(r["growth"] * 90) - 1) / r["growth"] - 20_000) < 1


def test_trees(spark):
    from jumpmark.plans.catalog import QUERIES

    rows = QUERIES["heuristic_trees"](spark, "/root/testdata/sf0.01").collect()
    assert {(r["target"], r["train"]) for r in rows} == {("process", True), ("process", False), ("best_mode", True), ("best_mode", False)}
    assert all(0 <= r["accuracy"] <= 1 and r["n"] > 0 for r in rows)


def test_reports(spark, sf):
    import json

    from jumpmark import adapters
    from jumpmark.sources import reports

    sections = reports.benchmark_report(adapters.bench_runs(spark, sf))
    page, data = reports.html_report("Benchmark", sections), json.loads(reports.json_report("Benchmark", sections))
    assert all(f"<h2>{name}</h2>" in page for name in sections) and data["sections"]["Summary"][0]["runs"] > 0
    assert len(data["sections"]["Best by video"]) <= 20 and isinstance(data["sections"]["Method"], str)


def test_pixel_process(spark):
    """Against a plain version, for blocks whose colours are few, many, and one."""
    from collections import Counter
    from math import comb

    from jumpmark.functions import coding
    from jumpmark.operators import description

    rng = random.Random(9)
    blocks = {0: [[7] * 20] * 9, 1: [[rng.choice([1, 1, 1, 1, 9]) for _ in range(20)] for _ in range(30)], 2: [[rng.randrange(256) for _ in range(20)] for _ in range(4)]}
    rows = [(b, t, x, c) for b, pixels in blocks.items() for x, seq in enumerate(pixels) for t, c in enumerate(seq)]
    cells = spark.createDataFrame(rows, "block long, t int, x int, c int")
    got = {r["block"]: (r["huffman"], r["bits"]) for r in description.pixel_process_bits(description.pixels(cells), description.step_colors(cells)).collect()}
    for b, pixels in blocks.items():
        at = [codec.steps(s) for s in pixels]
        freqs = Counter(s[k] for s, ks in zip(pixels, at, strict=True) for k in ks)
        n_all, m = sum(freqs.values()), len(freqs)
        lengths = coding.code_lengths(dict(freqs))
        average = sum(freqs[s] * lengths[s] for s in freqs) / n_all
        overhead = m * 13 + max(2 * m.bit_length() - 1, 1)
        pays = m > 1 and overhead + int(average * n_all) < 8 * n_all
        a = average if pays else 8.0
        sums = [0, 0, 0, 0]
        for ks in at:
            n, marks = len(ks), int(len(ks) * a)
            for i, v in enumerate((int(20 * a), 5 + n * 5 + marks, 20 + marks, 5 + (comb(20, n) - 1).bit_length() + marks)):
                sums[i] += v
        assert got[b] == (pays, 8 + (overhead if pays else 0) + min(sums)), b


def test_json_stores(spark, tmp_path):
    """Stores of runs, grid results and confusions as JSON, read with their schemas; fields that are missing are null."""
    import json

    run = {"seq": 1, "video_name": "akiyo", "codec_name": "h264", "quality_param": "28", "input_size": 1000, "output_size": 10, "compression_ratio": 100.0, "psnr": 0.0, "success": True}
    (tmp_path / "runs.json").write_text(json.dumps([run, {**run, "seq": 2, "success": False, "error": "codec missing"}], indent=1))
    got = stores.json_store(spark, str(tmp_path / "runs.json"), stores.RUNS)
    assert [(r["seq"], r["compression_ratio"], r["success"], r["error"], r["ssim"]) for r in got.orderBy("seq").collect()] == [(1, 100.0, True, None, None), (2, 100.0, False, "codec missing", None)]
    (tmp_path / "grid.json").write_text(json.dumps({"best_cost": 217539.7, "top_k": [{"total": 1.0, "config": {"threshold_H_s": 0.5}}]}))
    grid = stores.json_store(spark, str(tmp_path / "grid.json"), stores.GRID_RESULT).first()
    assert grid["best_cost"] == 217539.7 and grid["top_k"][0]["config"]["threshold_H_s"] == 0.5
    (tmp_path / "confusion.json").write_text(json.dumps({"A": {"matrix": [[1, 2], [0, 4]], "labels": ["x", "y"]}}))
    c = stores.json_store(spark, str(tmp_path / "confusion.json"), stores.CONFUSION)
    rows = {(r["dim"], r["act"], r["pred"]): r["n"] for r in stores.confusion_rows(c).collect()}
    assert rows == {("A", 0, 0): 1, ("A", 0, 1): 2, ("A", 1, 0): 0, ("A", 1, 1): 4}
