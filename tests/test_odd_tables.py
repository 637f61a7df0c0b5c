"""Queries against their SQL on small tables made for one odd case each."""

import duckdb
from pyspark.sql import functions as F

from jumpmark.functions import scalar
from jumpmark.plans import catalog
from jumpmark.streaming import windows
from test_queries import ORACLES, plain


def same(spark, folder, table, rows, *names):
    """Both results of each query over a table that the DuckDB query `rows` makes; the rows of the last one, sorted."""
    c = duckdb.connect()
    c.sql(f"copy ({rows}) to '{folder}/{table}.parquet' (format parquet)")
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    for name in names:
        got, want = catalog.QUERIES[name](spark, str(folder)), c.sql(ORACLES[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        out = want.select(*(f'"{x}"' for x in cols)).fetchall()
        assert plain(got.select(*cols).collect()) == plain(out)
    return sorted(out, key=repr)


def test_block_inspector_keeps_blocks_of_one_frame(spark, tmp_path):
    rows = "SELECT v AS vec_id, [((v * 7 + i) % 16 / 16.0 - 0.5)::FLOAT for i in range(64)] AS embedding, 3::INTEGER AS label FROM (VALUES (0), (1), (2), (256)) r(v)"
    out = same(spark, tmp_path, "embeddings", rows, "block_inspector")
    assert [r[1] for r in out] == [13, 3] and out[0][0] == 0 and out[0][2] is None


def test_universal_lengths_of_large_keys(spark, tmp_path):
    rows = "SELECT (1::BIGINT << k) + d AS p_partkey FROM (VALUES (16), (17), (20), (29), (31), (32), (39)) a(k), (VALUES (-1), (0), (1)) b(d)"
    same(spark, tmp_path, "part", rows, "universal_lengths")
    # the operator goes on until a logarithm is 1 or less
    n = spark.sql("SELECT explode(array(65536L, 65537L, 536870912L, 536870913L)) AS n")
    assert [r["s"] for r in n.select(scalar.log_star_bits(F.col("n")).alias("s")).collect()] == [24, 29, 41, 42]


#: Times at and around the half second before midnight and before six (B), and ordinary ones, on five days: 60 events a day.
EVENTS = """SELECT row_number() OVER () - 1 AS event_id, TIMESTAMP '2024-01-01' + to_days(d::INTEGER) + to_microseconds(m) AS ts, (d * 7 + m % 5)::BIGINT AS user_id, ['click', 'view'][k % 2 + 1] AS event_type, k + 0.25::DOUBLE AS value
 FROM range(5) a(d), range(60) b(k), LATERAL (SELECT CASE WHEN k < 20 THEN 86400000000 WHEN k < 30 THEN 21600000000 ELSE k * 1000000000 END - [500001, 500000, 499999, 300000, 1][k % 5 + 1] AS m) c"""


def test_tumbling_counts_by_nearest_second(spark, tmp_path):
    assert len(same(spark, tmp_path, "events", EVENTS, "tumbling_counts")) == 12  # the last half second of the fifth day is a sixth


def test_windows_of_exact_times(spark, tmp_path):
    """Without a lead a window holds the times from its start to before its end."""
    e = spark.sql("SELECT TIMESTAMP '2024-01-01 23:59:59.9' AS ts, 'click' AS event_type, 1D AS value, 0L AS user_id")
    assert windows.tumbling(e, "1 day").select(F.unix_seconds("window.start")).first()[0] == 1704067200
    assert windows.tumbling(e, "1 day", lead=windows.NEAREST).select(F.unix_seconds("window.start")).first()[0] == 1704153600


def test_watermark_counts_by_nearest_second(spark, tmp_path):
    # the latest time closes the third day at six of the fourth, not by a rounded second before it
    for at, days in (("05:59:59.7", 2), ("06:00:00", 3), ("06:00:00.2", 3)):
        (folder := tmp_path / at.replace(":", "")).mkdir()
        rows = f"SELECT * FROM ({EVENTS}) WHERE ts < TIMESTAMP '2024-01-04' UNION ALL SELECT 999, TIMESTAMP '2024-01-04 {at}', 1, 'click', 2.0"
        assert len(same(spark, folder, "events", rows, "watermark_counts")) == 2 * days


def test_stream_heat_map_by_nearest_second(spark, tmp_path):
    same(spark, tmp_path, "events", EVENTS, "stream_heat_map")


def test_stream_detect_by_nearest_second(spark, tmp_path):
    assert same(spark, tmp_path, "events", EVENTS, "stream_detect")


def test_ql_detect_by_nearest_second(spark, tmp_path):
    assert same(spark, tmp_path, "events", EVENTS, "ql_detect")


def test_sliding_intensity_by_nearest_second(spark, tmp_path):
    same(spark, tmp_path, "events", EVENTS, "sliding_intensity")


def test_streams_read_folders_of_parts(spark, tmp_path):
    c = duckdb.connect()
    (tmp_path / "events.parquet").mkdir()
    for k in range(3):
        c.sql(f"copy (SELECT * FROM ({EVENTS}) WHERE event_id % 3 = {k}) to '{tmp_path}/events.parquet/part-{k}.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("tumbling_counts", "watermark_counts", "stream_heat_map", "stream_detect", "stream_jump_detect", "chunked_counts"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
        cols = sorted(got.columns)
        out = plain(want.select(*(f'"{x}"' for x in cols)).fetchall())
        assert out and plain(got.select(*cols).collect()) == out
