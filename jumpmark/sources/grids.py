"""Experiment grids: a small subset of YAML, and the runs that a grid spans."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.startswith("{") and text.endswith("}"):
        return {k.strip(): _scalar(v) for k, v in (x.split(":", 1) for x in text[1:-1].split(",") if x.strip())}
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("\"'")


def parse(text: str):
    """Maps, lists, inline lists and maps, numbers and plain texts, by indentation; comments are left out."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", line) for line in text.splitlines()) if x.strip()]

    def block(at: int, depth: int):
        if lines[at][1].startswith("- "):
            out = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                out.append(_scalar(lines[at][1][2:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == depth:
            key, _, value = lines[at][1].partition(":")
            at += 1
            if value.strip():
                out[key.strip()] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][1].startswith("- ")):
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def runs(spark: SparkSession, grid: dict) -> DataFrame:
    """(config_id, block_size, r_frames, m_colors, intensity, params, basis, dimension): a row for each configuration of a grid."""
    kinds = [(name, p) for name in grid.get("intensity_types", grid["intensity_params"]) for p in grid["intensity_params"].get(name, [])]
    axes = itertools.product(grid["block_sizes"], grid["r_frames"], grid["m_colors"], kinds, grid["basis_families"], grid["dimensions"])
    rows = [(i, b, r, m, name, {k: float(v) for k, v in p.items()}, basis, d) for i, (b, r, m, (name, p), basis, d) in enumerate(axes)]
    return spark.createDataFrame(rows, "config_id int, block_size int, r_frames int, m_colors int, intensity string, params map<string,double>, basis string, dimension int")
