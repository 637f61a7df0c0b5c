"""Benchmark decontamination: word windows of benchmark items, looked up in documents.

Every benchmark window of m words holds, wherever it stands in a document, a whole block of b = (m + 1) // 2 words that
starts at a multiple of b.
So a document sends only its n / b aligned blocks, as 64-bit hashes, to a hash join with all b-word blocks of the
benchmark. In the documents a block of which meets, the windows around the meeting blocks are compared as whole strings
(the verification) with the benchmark's windows. Nothing but meeting blocks and hits is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import ALNUM_WORD, ascii_lower, fresh, maybe_broadcast, stored, words

WINDOW = 10
#: As ALNUM_WORD, before A-Z is lower-cased; and what stands between such words.
RAW_WORD, RAW_GAP = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _windows(w: Column, m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows (win, m words long) with the items that hold them."""
    w = words(ascii_lower(F.coalesce(F.col(text), F.lit(""))), ALNUM_WORD)
    items = benchmark.select(F.col(item).alias("_item"), w.alias("_w")).filter((F.size("_w") > 0) & F.col("_item").isNotNull())
    m = F.least(F.size("_w"), F.lit(window))
    return items.select("_item", m.alias("m"), F.explode(_windows(F.col("_w"), m)).alias("win")).groupBy("win", "m").agg(F.collect_set("_item").alias("items"))


def _key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _folded(c: Column) -> Column:
    """Unicode lower case without the one rule that looks at a letter's surroundings (final sigma)."""
    return F.replace(F.lower(c), F.lit("\u03c2"), F.lit("\u03c3"))


def _block(w: Column, i: Column, b: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(b)))


def _hits(docs: DataFrame, wins: DataFrame, lengths: dict[int, int], key: str, text: str) -> DataFrame:
    """(_id, _k, s, m, items): windows of documents that items hold; lengths: words of a window -> bytes of all such windows.

    Documents are read twice, however many lengths there are: for their aligned blocks, and, those with a block that meets,
    for the windows around it.
    """
    n_bytes = sum(lengths.values())
    part = {m: (m + 1) // 2 for m in lengths}
    # blocks are hashed in Unicode lower case, which agrees wherever ASCII lower case does and is fast; the windows decide
    low = F.split(_folded(F.col("win")), " ")
    blocks = None
    for m, b in part.items():
        own = wins.filter(F.col("m") == m).select(F.lit(m).alias("m"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - b)), lambda i: _block(low, i, b))).alias("h"))
        blocks = own if blocks is None else blocks.unionByName(own)
    d = docs.select(F.col(key).alias("_id"), _key(text).alias("_k"), words(_folded(F.col(text)), ALNUM_WORD).alias("_w")).filter(F.size("_w") >= min(lengths))
    w, none = F.col("_w"), F.array().cast("array<struct<m:int,at:int,h:bigint>>")
    each = [F.when(F.size(w) >= m, F.transform(F.sequence(F.lit(0), F.size(w) - b, F.lit(b)), lambda i: F.struct(F.lit(m).alias("m"), i.alias("at"), _block(w, i, b).alias("h")))).otherwise(none) for m, b in part.items()]
    d = d.select("_id", "_k", F.explode(F.concat(*each)).alias("x")).select("_id", "_k", "x.*")
    met = d.join(maybe_broadcast(blocks.distinct(), n_bytes), ["m", "h"], "left_semi").groupBy("_id", "_k").agg(F.collect_set(F.struct("m", "at")).alias("met"))
    met = stored(met.withColumnsRenamed({"_id": "_i4", "_k": "_k4"}))
    size = met.agg(F.sum(F.size("met") * 16 + 64).alias("b")).first()["b"] or 0
    again = docs.select(F.col(key).alias("_id"), _key(text).alias("_k"), F.col(text).alias("_t"))
    again = again.join(maybe_broadcast(met, size), F.col("_id").eqNullSafe(F.col("_i4")) & F.col("_k").eqNullSafe(F.col("_k4")))
    again = again.select("_id", "_k", "met", words(ascii_lower(F.col("_t")), ALNUM_WORD).alias("_w"))

    def around(x: Column) -> Column:
        """Starts of the windows of m words that hold the block at x.at."""
        first = F.greatest(x["at"] - (x["m"] - F.floor((x["m"] + 1) / 2).cast("int")), F.lit(0))
        return F.transform(F.sequence(first, F.least(x["at"], F.size("_w") - x["m"])), lambda s: F.struct(x["m"].alias("m"), s.alias("s")))

    starts = F.array_distinct(F.flatten(F.transform("met", around)))
    places = F.transform(starts, lambda p: F.struct(p["m"].alias("m"), p["s"].alias("s"), F.array_join(F.slice(F.col("_w"), p["s"] + 1, p["m"]), " ").alias("win")))
    seen = again.select("_id", "_k", F.explode(places).alias("p")).select("_id", "_k", "p.*")
    return seen.join(maybe_broadcast(wins.select("m", "win", "items"), n_bytes), ["m", "win"]).select("_id", "_k", "s", "m", "items")


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", keep_hash: bool = False) -> DataFrame:
    """One row per input row: key, n_words, n_hit, spans (word intervals, merged), items.

    Null text has no words and no hits, as has an item with null text; an item with a null id is left out. Repeated rows
    give repeated results. Columns beside those named are not looked at. An empty benchmark hits nothing. With keep_hash
    a column _k, the hash of the row's text.
    """
    wins = item_windows(benchmark, item, item_text, window)
    # at most `window` rows: the lengths that occur, and the size of what would be broadcast
    sizes = {r["m"]: r["b"] for r in wins.groupBy("m").agg(F.sum(F.length("win") + 16 * F.size("items") + 64).alias("b")).collect()}
    base = docs.select(F.col(key).alias("_id"), _key(text).alias("_k"), F.coalesce(F.regexp_count(F.col(text), F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    item_type = benchmark.schema[item].dataType.simpleString()
    also = ["_k"] if keep_hash else []
    if not sizes:
        return base.select(F.col("_id").alias(key), *also, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast(f"array<{item_type}>").alias("items"))
    hits = _hits(docs, wins, dict(sorted(sizes.items())), key, text)
    per = hits.groupBy("_id", "_k").agg(F.array_sort(F.collect_set(F.struct("s", "m"))).alias("p"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    none = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def merge(a: Column, x: Column) -> Column:
        end = x["s"] + x["m"]
        joins = (a["e"] >= x["s"]) & (a["e"] >= 0)
        closed = F.when(joins | (a["e"] < 0), a["out"]).otherwise(F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e"))))
        return F.struct(closed.alias("out"), F.when(joins, a["s"]).otherwise(x["s"]).alias("s"), F.when(joins, F.greatest(a["e"], end)).otherwise(end).alias("e"))

    spans = F.aggregate("p", none, merge, lambda a: F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e"))))
    per = per.select(F.col("_id").alias("_i2"), F.col("_k").alias("_k2"), spans.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    joined = base.join(per, F.col("_id").eqNullSafe(F.col("_i2")) & F.col("_k").eqNullSafe(F.col("_k2")), "left")
    return joined.select(
        F.col("_id").alias(key), *also, "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"), F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", key: str = "doc_id", text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without its contaminated documents (mode document) or without the hit words (mode span), same columns.

    Rows are matched by key, in span mode by key and text, so that a key's other texts keep theirs; repeated rows change
    alike. In span mode a removed word takes the gap before it along. Names of docs' columns may be any.
    """
    k3, t3, spans3 = fresh(docs, "_k3", "_t3", "_spans3")
    own = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    on = F.col(f"`{key}`").eqNullSafe(F.col(k3))
    if mode == "document":
        found = find(own, benchmark, "_key", "_text", window, item, item_text).filter("n_hit > 0")
        return docs.join(found.select(F.col("_key").alias(k3)).distinct(), on, "left_anti")
    placed = find(own, benchmark, "_key", "_text", window, item, item_text, keep_hash=True).filter("n_hit > 0")
    placed = placed.select(F.col("_key").alias(k3), F.col("_k").alias(t3), F.col("spans").alias(spans3)).distinct()
    parts = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"(?:{RAW_GAP})?{RAW_WORD}|{RAW_GAP}$"), F.lit(0))
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.exists(spans3, lambda s: (s["s"] <= i) & (i < s["e"])), x)), lambda x: x.isNotNull())
    cut = F.when(F.col(spans3).isNotNull(), F.array_join(kept, "")).otherwise(F.col(f"`{text}`"))
    out = docs.join(placed, on & F.xxhash64(f"`{text}`").eqNullSafe(F.col(t3)), "left")
    return out.select(*(cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
