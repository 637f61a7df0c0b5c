import random

import duckdb
import pytest

pytest.importorskip("jumpmark.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from jumpmark.llm import decontaminate, graph, packing
from jumpmark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.common_rows import ALNUM, SPACE, frame, low, rows
from tests.llm.test_operators import brute_components, brute_line_dedup


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want.select(*cols).fetchall())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), sf)
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert after == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
        if name == "ngram_join":
            assert after == {c for _, _, c in brute_components(list(before.items()), 5, 80)}
        if name == "decontaminate":
            hit = decontaminate.find(spark.read.parquet(str(tmp_path / name)), spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0")
            assert after == set(before) - {r["doc_id"] for r in hit.collect()}


def test_awkward_rows(spark, sf):
    docs = frame(spark, rows()[0])
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        assert out.count() > 0


def test_stages_brute(spark, sf):
    """Language ID, line dedup and decontamination against plain versions on the driver's documents."""
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines = {i: t for i, t in brute_line_dedup(data)}
    before = dict(data)
    want = {(i, t) for i, t in lines.items() if t == before[i] or (t is not None and SPACE.search(t))}
    assert {(r["doc_id"], r["text"]) for r in stages["line_dedup"](spark, docs, sf).collect()} == want
    items = [(r["item_id"], ALNUM.findall(low(r["text"]))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for _, w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    hit = {i for i, t in data for w in [ALNUM.findall(low(t))] for m in sizes for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows}
    assert hit and {r["doc_id"] for r in stages["decontaminate"](spark, docs, sf).collect()} == set(before) - hit
    kept = {r["doc_id"]: r["lang"] for r in stages["language_id"](spark, docs, sf).collect()}
    assert set(kept) == {i for i, t in data if t and any(c.isalpha() for c in t)}
    pieces = stages["packing"](spark, docs, sf).where("n_tokens > 0").orderBy("n_tokens", ascending=False).collect()
    lengths = sorted((n for _, t in data for n in [len(SPACE.findall(t or ""))] for n in [*[4096] * (n // 4096), n % 4096] if n), reverse=True)
    assert [r["n_tokens"] for r in pieces] == lengths
    sizes = {(r["shard"], r["bin"]): r["capacity"] for r in pieces}
    assert sorted(sizes.values()) == sorted(packing.pack_best(lengths)[2])


def test_components(spark):
    rng = random.Random(12)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 5)]
    above = {}

    def top(k):
        while above.setdefault(k, k) != k:
            k = above[k]
        return k

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        above[q] = p
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(7))
    want = {(k, top(k)) for a, b in links if a != b for k in (a, b)}
    assert {(r["node"], r["root"]) for r in got.collect()} == want
