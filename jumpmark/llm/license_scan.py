"""License scan: ordered signature rules gated by keywords.

A document's words are looked at only where an anchor word stands. Around each anchor as many words are cut out as the rule
that reaches farthest can match, with a mark before the anchor; so no rule loses anything by seeing these only. Of the rules
of that anchor those whose keyword occurs there are tried as regular expressions. A detection is an interval of words.
Sorted by start, a detection that lies inside an earlier one of the same or a higher priority is suppressed (for equal
intervals the higher priority, then the earlier rule, wins).

Everything is a column expression; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumpmark.llm import license_rules
from jumpmark.llm.common import ALNUM_WORD, ascii_lower, words

MARK = "@"
RULES = license_rules.rules()
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _detections(rules: list[dict]) -> Column:
    """What the rules find around the anchors (_ctx: at, word, ctx): start, minus_end, minus_prio, ord, label, conf; as SQL, which is parsed at once."""
    by_anchor: dict[tuple[str, ...], list[str]] = {}
    for i, r in enumerate(rules):
        found = f"named_struct('m', ltrim(regexp_extract(c.ctx, r'{r['regex']}', 0)), 'prio', {r['priority']}, 'ord', {i}, 'label', '{r['label']}', 'version', {str(r['version']).lower()}, 'conf', {r['confidence']}D)"
        by_anchor.setdefault(tuple(r["anchors"]), []).append(f"if(contains(c.ctx, '{r['keyword']}'), {found}, null)")
    tried = ", ".join(f"if(c.word in ({', '.join(repr(w) for w in words)}), array_compact(array({', '.join(found)})), array())" for words, found in by_anchor.items())
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    start = f"(c.at - {spaces(f"substring_index(d.m, '{MARK}', 1)")})"
    label = "if(d.version, concat(d.label, '-', replace(regexp_extract(d.m, r'[1-9](?: [0-9])?$', 0), ' ', '.')), d.label)"
    interval = f"named_struct('start', {start}, 'minus_end', -({start} + {spaces('d.m')}), 'minus_prio', -d.prio, 'ord', d.ord, 'label', {label}, 'conf', d.conf)"
    return F.expr(f"flatten(transform(_ctx, c -> transform(filter(concat({tried}), d -> d.m <> ''), d -> {interval})))")


def _places(w: Column, at: Column, phrase: str) -> Column:
    """Starts of a phrase, given the positions of its last word's candidates."""
    parts = phrase.split(" ")
    n = len(parts)

    def stands(i: Column) -> Column:
        test = i >= n - 1
        for back, part in enumerate(reversed(parts)):
            test = test & (F.get(w, i - back) == part)
        return F.coalesce(test, F.lit(False))

    return F.transform(F.filter(at, stands), lambda i: i - (n - 1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[dict] = RULES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per input row: key, n_words, base places and labels, the detections kept and their labels, a score.

    Null text counts as empty: no words, no places, empty labels, score 0. Repeated rows give repeated results. Columns of
    docs beside key and text are not looked at. Rows with a null key are scanned as any other.
    """
    anchors = sorted({a for r in rules for a in r["anchors"]})
    left, right = max(r["left"] for r in rules) + 1, max(r["right"] for r in rules) + 1
    lasts = sorted({p.split(" ")[-1] for p in base} | set(anchors))
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    df = docs.select(F.col(key).alias("_key"), words(low, ALNUM_WORD).alias("_w"))
    gate = F.arrays_overlap("_w", F.array(*map(F.lit, lasts)))
    spots = F.filter(F.transform(F.col("_w"), lambda x, i: F.when(x.isin(lasts), i)), lambda i: i.isNotNull())
    df = df.select("_key", F.size("_w").cast("long").alias("n_words"), F.when(gate, F.col("_w")).alias("_w"))
    df = df.withColumn("_at", F.when(F.col("_w").isNotNull(), spots))
    empty = F.array().cast("array<int>")
    df = df.withColumn("_at", F.coalesce("_at", empty))
    some = F.size("_at") > 0
    per = {phrase: F.when(some, _places(F.col("_w"), F.col("_at"), phrase)).otherwise(empty) for phrase in base}
    df = df.select("*", *(p.alias(f"_b{k}") for k, p in enumerate(per.values())))
    df = df.withColumn("_base", F.concat(*(F.col(f"_b{k}") for k in range(len(per)))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, label in enumerate(base.values()))))

    def context(i: Column) -> Column:
        first = F.greatest(i - left, F.lit(0))
        before = F.slice(F.col("_w"), first + 1, i - first)
        after = F.slice(F.col("_w"), i + 1, F.lit(right))
        return F.struct(i.alias("at"), F.get(F.col("_w"), i).alias("word"), F.concat(F.array_join(before, " "), F.when(i > 0, F.lit(" ")).otherwise(F.lit("")), F.lit(MARK), F.array_join(after, " ")).alias("ctx"))

    df = df.withColumn("_ctx", F.when(some, F.transform(F.filter("_at", lambda i: F.get(F.col("_w"), i).isin(anchors)), context)))
    df = df.withColumn("_found", F.array_sort(_detections(rules)))
    levels = sorted({-r["priority"] for r in rules})
    nothing = F.struct(*(F.lit(-1).alias(f"e{-p}") for p in levels), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def fold(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        covered = F.lit(False)
        for p in levels:  # an earlier detection of priority at least this one's that reaches as far
            covered = covered | ((F.lit(p) <= d["minus_prio"]) & (acc[f"e{-p}"] >= end))
        return F.struct(
            *(F.when(d["minus_prio"] == p, F.greatest(acc[f"e{-p}"], end)).otherwise(acc[f"e{-p}"]).alias(f"e{-p}") for p in levels),
            F.when(covered | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.array_append(acc["labels"], d["label"])).alias("labels"),
            (acc["n"] + F.when(covered, 0).otherwise(1)).alias("n"),
            F.when(covered, acc["best"]).otherwise(F.greatest(acc["best"], d["conf"])).alias("best"),
        )

    df = df.withColumn("_kept", F.when(F.size(F.coalesce("_found", F.array().cast(df.schema["_found"].dataType))) > 0, F.aggregate("_found", nothing, fold)))
    base_col = F.array_sort(F.array_distinct(base_labels))
    method = F.coalesce(F.col("_kept.labels"), F.array().cast("array<string>"))
    return df.select(
        F.col("_key").alias(key), "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min("_base").cast("long").alias("first_word"), F.array_max("_base").cast("long").alias("last_word"),
        F.array_join(base_col, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base_col, method))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("_kept.best"), F.lit(0.0)), F.when(F.size("_base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("_kept.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
