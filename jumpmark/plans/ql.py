"""A small metadata query language, rewritten to Spark SQL over temp views.

SELECT ... FROM video_block(x, y) [WHERE ...]             blocks at a position
SELECT ... FROM spatial_region(circle(cx, cy, r)) [...]   blocks within a circle
SELECT ... FROM video_stream WHERE location IN (B(i, j), ...) ...
DETECT events WHERE intensity_change > v WITHIN time_window(n seconds|minutes|hours|days)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DETECT = re.compile(r"^\s*DETECT\s+events\s+WHERE\s+intensity_change\s*>\s*([0-9.]+)\s+WITHIN\s+time_window\(\s*(\d+)\s+(second|minute|hour|day)s?\s*\)\s*$", re.I)
_CIRCLE = re.compile(r"spatial_region\(\s*circle\(\s*([-0-9.]+)\s*,\s*([-0-9.]+)\s*,\s*([0-9.]+)\s*\)\s*\)", re.I)
_BLOCK = re.compile(r"video_block\(\s*(\d+)\s*,\s*(\d+)\s*\)", re.I)
_PLACE = re.compile(r"location\s+IN\s*\(((?:\s*B\(\s*\d+\s*,\s*\d+\s*\)\s*,?)+)\)", re.I)


def rewrite(query: str) -> str:
    """The query as Spark SQL. Only numbers are taken from matched parts."""
    if m := _DETECT.match(query):
        change, n, unit = float(m[1]), int(m[2]), m[3].lower()
        return f"""
            WITH w AS (SELECT by, bx, window(time, '{n} {unit}').start AS t0, count(*) AS n FROM video_stream GROUP BY by, bx, window(time, '{n} {unit}')),
                 d AS (SELECT *, n - lag(n) OVER (PARTITION BY by, bx ORDER BY t0) AS intensity_change FROM w)
            SELECT by, bx, t0, n, intensity_change FROM d WHERE abs(intensity_change) > {change}"""
    query = _CIRCLE.sub(lambda m: f"(SELECT * FROM video_stream WHERE (bx - {float(m[1])}) * (bx - {float(m[1])}) + (by - {float(m[2])}) * (by - {float(m[2])}) <= {float(m[3]) ** 2}) AS region", query)
    query = _BLOCK.sub(lambda m: f"(SELECT * FROM video_stream WHERE bx = {int(m[1])} AND by = {int(m[2])}) AS block", query)
    return _PLACE.sub(lambda m: "(by, bx) IN (" + ", ".join(f"({i}, {j})" for i, j in re.findall(r"B\(\s*(\d+)\s*,\s*(\d+)\s*\)", m[1])) + ")", query)


def run(spark: SparkSession, query: str, video_stream: DataFrame) -> DataFrame:
    video_stream.createOrReplaceTempView("video_stream")
    return spark.sql(rewrite(query))


def register(spark: SparkSession) -> None:
    """video_block(x, y) and spatial_region(cx, cy, r) as temporary SQL table functions over the view video_stream."""
    columns = "id BIGINT, time TIMESTAMP_NTZ, by INT, bx INT, tag STRING, magnitude DOUBLE"
    names = "id, time, by, bx, tag, magnitude"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION video_block(x INT, y INT) RETURNS TABLE({columns}) RETURN SELECT {names} FROM video_stream WHERE bx = x AND by = y")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spatial_region(cx DOUBLE, cy DOUBLE, r DOUBLE) RETURNS TABLE({columns}) RETURN SELECT {names} FROM video_stream WHERE (bx - cx) * (bx - cx) + (by - cy) * (by - cy) <= r * r")
