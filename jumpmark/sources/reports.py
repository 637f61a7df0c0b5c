"""Small result tables as text, HTML or LaTeX. Rendering is the driver's; a table has one row per codec, class or the like."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Rows that a table may have: a report is for reading, larger results belong in files.
MOST_ROWS = 2000


def _cell(v: object, digits: int) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def rows_of(df: DataFrame, digits: int = 3) -> tuple[list[str], list[list[str]]]:
    """Column names and formatted cells; ValueError for a table of more than MOST_ROWS rows."""
    found = df.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write the result to files instead")
    return df.columns, [[_cell(v, digits) for v in r] for r in found]


def text_table(df: DataFrame, digits: int = 3) -> str:
    names, rows = rows_of(df, digits)
    width = [max(len(r[i]) for r in [names, *rows]) for i in range(len(names))]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, rows)])


def html_table(df: DataFrame, digits: int = 3) -> str:
    names, rows = rows_of(df, digits)
    tr = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in r) + "</tr>"
    return "<table>\n" + "\n".join([tr("th", names), *(tr("td", r) for r in rows)]) + "\n</table>"


#: Characters that stand for something else in LaTeX.
_LATEX = {c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def latex_table(df: DataFrame, digits: int = 3) -> str:
    names, rows = rows_of(df, digits)
    line = lambda r: " & ".join("".join(_LATEX.get(c, c) for c in v) for v in r) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(names) + "}", line(names), r"\hline", *map(line, rows), r"\end{tabular}"])


def html_report(title: str, sections: dict[str, DataFrame | str], digits: int = 3) -> str:
    """A page of sections: tables, or paragraphs of plain text."""
    render: Callable = lambda s: f"<p>{html.escape(s)}</p>" if isinstance(s, str) else html_table(s, digits)
    body = "\n".join(f"<h2>{html.escape(name)}</h2>\n{render(s)}" for name, s in sections.items())
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body>\n<h1>{html.escape(title)}</h1>\n{body}\n</body></html>\n'


def json_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """The same sections as JSON: tables as lists of objects."""
    import json

    def rows(df: DataFrame) -> list[dict]:
        rows_of(df)  # refuses what is not for reading
        return [r.asDict(recursive=True) for r in df.collect()]

    return json.dumps({"title": title, "sections": {name: s if isinstance(s, str) else rows(s) for name, s in sections.items()}}, default=str)


def benchmark_report(runs: DataFrame, title: str = "Benchmark") -> dict[str, DataFrame | str]:
    """Sections of a report on runs: summary, means by codec, best codec of each of the first twenty videos, what the numbers are."""
    from pyspark.sql import functions as F

    from jumpmark.operators import results

    r = results.with_ratio(runs)
    first = r.select("video").distinct().orderBy("video").limit(20)
    return {
        "Summary": r.agg(F.count("*").alias("runs"), F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("max_ratio")),
        "Codecs": results.summary(runs), "Best by video": results.best_per(r.join(first, "video", "left_semi"), "video", "ratio", True).orderBy("video"),
        "Method": f"{title}: ratios are input over output bytes; means are taken over runs.",
    }
