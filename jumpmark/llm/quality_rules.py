"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one failure bit per rule; a policy is a
mask of rules, so that a verdict is one bitwise AND and the effect of adding or dropping a rule (an ablation) is an
aggregation over distinct ledgers, without looking at text again. Column expressions only; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import SPACE_WORD

#: rule name -> failure test over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
}
#: version -> rules that reject a document
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_words"],
    "v1": ["too_few_words", "repeated_words", "symbols", "short_words", "long_words"],
    "v2": list(RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the array w.

    Windows are compared by 64-bit hash. The distinct count tells most texts without a repeat apart at once; for the
    others the hashes are sorted with their places, neighbours compared, and the covered words summed over sorted places.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, hashes)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, measurements, failure bits.

    Null text has no words, characters, symbols or lines and fails too_few_words. A rule that divides by nothing (no words)
    does not fail. Repeated rows give repeated results; columns beside key and text are not looked at.
    """
    t = F.coalesce(F.col("_t"), F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    df = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACE_WORD))
    df = df.select(
        "_key",
        F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0)).alias("_w"),
        F.length(F.translate(t, spaces, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.select("_key", "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("_w")).alias("_h"))
    # only texts with a repeated window go on
    df = df.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")))
    df = df.withColumn("_s", F.when(F.col("_h").isNotNull(), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
    found = F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_p", F.when(s.isNotNull(), F.sort_array(found)))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    bits = F.lit(0).cast("long")
    for k, test in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0))
    return df.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", bits.cast("long").alias("failed_bits"))


def verdict(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    failed = lambda p: F.col("failed_bits").bitwiseAND(F.lit(mask(p))) != 0
    return led.withColumns({"base_failed": failed("base"), "kept": ~failed("base") & ~failed(policy)})


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it fails, documents kept without it.

    Documents are first counted by distinct failure bits (at most 2^rules groups), so text is never read again.
    """
    m = mask(policy)
    counts = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("b")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("b"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(m) - F.col("b")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
