"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumpmark.llm import decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, token_counts, toxicity
from jumpmark.llm.common import table

#: A public byte-level vocabulary; only its path is known here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts.count_edits(table(spark, sf_dir, "documents"), Path(vocabulary).read_bytes())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.verdict(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed_bits")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), shingle=4, threshold=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_quality_rules, op4_suffix_dedup, op5_decontaminate, op6_ngram_join, op7_language_id, op8_line_dedup, op9_toxicity, op10_packing)}

_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS win FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) n FROM r, (SELECT unnest([0, 1, 2]) k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words, len(ls)::BIGINT n_lines
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits::BIGINT AS failed_bits FROM f
"""
_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 10) m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') win FROM bi),
ms AS (SELECT DISTINCT m FROM bw),
di AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) i FROM d, ms WHERE len(ws) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') win FROM di),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
hw AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest(range(i, i + m)) j FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ws), 0)::BIGINT n_words, coalesce(n, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') g FROM p),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) n_links FROM l GROUP BY a)
SELECT r.a AS doc_id, coalesce(min(n.n), 0)::BIGINT n_shingles, min(r.b) component_id, coalesce(min(n_links), 0)::BIGINT n_links
FROM r LEFT JOIN n ON n.doc_id = r.a LEFT JOIN k ON k.a = r.a GROUP BY r.a
"""
ORACLE_SQL = {"op3_quality_rules": _OP3, "op5_decontaminate": _OP5, "op6_ngram_join": _OP6}
