"""Line dedup by a log-template tree.

A line's tokens with a digit are fields. The tree has a fixed depth: a line goes to the leaf of its token count and its
first DEPTH tokens (fields as <*>). In a leaf that lines of enough documents reach, positions whose commonest token is
held by less than half of the documents are generalised to <*>; lines that agree with enough of the leaf's tokens share
the leaf's template, the others keep a template of their own (their masked tokens). Templates found in enough documents
recur: their lines are dropped from every document but the first that holds one. Equal lines (the same tokens, fields
included) need no such evidence and recur from two documents on; lines that are nearly all fields are compared that way only.

Only hashes are shuffled; long runs of equal lines are counted before they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jumpmark.llm.common import SPACE_WORD, fresh, maybe_broadcast, stored
from jumpmark.llm.text_bytes import raw, slices

#: Leading tokens that lead to a leaf; documents a template recurs in; share of tokens a line must agree on.
DEPTH, MIN_DOCS, AGREE = 3, 5, 0.8
#: Documents that equal lines recur in; documents that short lines recur in, equal or not.
EQUAL_DOCS, SHORT_DOCS = 2, 10
#: Template hashes (8 bytes each) that may be sent to tasks at once; beyond it they are joined.
WANTED = 1 << 20
#: Tokens that are no fields a template needs, besides half of all.
CONSTANT = 3
#: Bytes of a table of templates that is broadcast.
FEW = 16 << 20
#: Lines of fewer tokens are short.
MIN_TOKENS = 5
_DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"


def masked(line: bytes) -> list[bytes]:
    if not _DIGIT.search(line):
        return line.split()
    return [FIELD if _DIGIT.search(t) else t for t in line.split()]


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def leaf_of(tokens: list[bytes], depth: int) -> int:
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:depth]))


def whole(line: bytes) -> int | None:
    """The hash of a line's tokens with its fields as they are; none where that is the hash of its template."""
    if _DIGIT.search(line) or FIELD in line:
        return _hash(b"=" + b" ".join(line.split()))
    return None


def has_template(tokens: list[bytes]) -> bool:
    """Whether a line has enough tokens beside its fields to be compared by its template."""
    n = tokens.count(FIELD)
    return not n or len(tokens) - n >= max(CONSTANT, n)


def _lines(docs: DataFrame, key: str, text: str, depth: int, min_tokens: int, with_tokens: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """(k, leaf, tpl, equal, short[, toks]) for each distinct line template of each document; wanted: only these templates (sorted).

    equal: lines of this tpl are equal; short: they have fewer than min_tokens tokens. Blank lines have no row. A line with fields has a second row with the hash of its whole text as leaf and tpl;
    with_tokens leaves those out.
    """
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 1 << 20):
            at, leaves, templates, equal, short, lines = [], [], [], [], [], []
            for i, t in enumerate(raw(b, "t")):
                seen = set()
                for line in (t or b"").split(b"\n"):
                    ts = masked(line)
                    if not ts:
                        continue
                    own = whole(line)
                    if own is not None and not with_tokens and own not in seen:
                        seen.add(own)
                        at.append(i)
                        leaves.append(own)
                        templates.append(own)
                        equal.append(True)
                        short.append(len(ts) < min_tokens)
                    if not has_template(ts):
                        continue
                    tpl = _hash(b" ".join(ts))
                    if tpl in seen:
                        continue
                    seen.add(tpl)
                    at.append(i)
                    leaves.append(leaf_of(ts, depth))
                    templates.append(tpl)
                    equal.append(FIELD not in ts)
                    short.append(len(ts) < min_tokens)
                    if with_tokens:
                        lines.append(ts)
            take = np.arange(len(at))
            if sent is not None and len(at):
                tpls = np.array(templates, np.int64)
                take = np.flatnonzero(sent.value[np.minimum(np.searchsorted(sent.value, tpls), len(sent.value) - 1)] == tpls) if len(sent.value) else take[:0]
            cols = [b.column("k").take(pa.array(np.array(at, np.int32)[take])), pa.array(np.array(leaves, np.int64)[take]), pa.array(np.array(templates, np.int64)[take]), pa.array(np.array(equal, bool)[take]), pa.array(np.array(short, bool)[take])]
            names = ["k", "leaf", "tpl", "equal", "short"]
            if with_tokens:
                cols.append(pa.array([[xxhash.xxh32_intdigest(x) - (1 << 31) for x in lines[i]] for i in take.tolist()], pa.list_(pa.int32())))
                names.append("toks")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    return rows.mapInArrow(run, f"k {key_type}, leaf long, tpl long, equal boolean, short boolean" + (", toks array<int>" if with_tokens else ""))


def distinct_lines(docs: DataFrame, key: str, text: str, depth: int, min_tokens: int) -> DataFrame:
    return stored(_lines(docs, key, text, depth, min_tokens, False).distinct())


def _few(df: DataFrame, row_bytes: int) -> DataFrame:
    """df stored, to be broadcast where it is small."""
    kept = stored(df)
    return maybe_broadcast(kept, row_bytes * kept.count(), FEW)


def templates(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, agree: float = AGREE, min_tokens: int = MIN_TOKENS, lines: DataFrame | None = None, equal_docs: int = EQUAL_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """(tpl, cluster, n_docs, first): line templates that recur, the cluster each generalises to, documents, first document."""
    lines = distinct_lines(docs, key, text, depth, min_tokens) if lines is None else lines
    per = lines.groupBy("leaf", "tpl", "equal", "short").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    leaves = per.groupBy("leaf").agg(F.sum("n").alias("n_leaf"), F.count("*").alias("n_tpl")).where(F.col("n_leaf") >= equal_docs)
    least = F.when(F.col("short"), short_docs).otherwise(min_docs)
    recurs = F.col("n") >= F.when(F.col("equal") & ~F.col("short"), equal_docs).otherwise(least)
    per = stored(per.join(leaves, "leaf").where(recurs | (F.col("n_leaf") >= least)))
    # leaves of more than one template are generalised: one row of tokens per template there
    mixed = per.where((F.col("n_tpl") > 1) & (F.col("n_leaf") >= least)).select("tpl", "leaf", "n")
    n_mixed = mixed.count()
    # their hashes go along to the tasks only where that is little; else the join alone picks them
    wanted = np.sort(np.array(mixed.select("tpl").distinct().toArrow().column("tpl"), dtype=np.int64)) if n_mixed <= WANTED else None
    tokens = _lines(docs, key, text, depth, min_tokens, True, wanted).join(maybe_broadcast(mixed, 64 * n_mixed), ["leaf", "tpl"])
    tokens = stored(tokens.groupBy("leaf", "tpl", "n").agg(F.min("toks").alias("toks")))
    by_place = tokens.select("leaf", "n", F.posexplode("toks").alias("p", "tok")).groupBy("leaf", "p", "tok").agg(F.sum("n").alias("n"))
    common = by_place.groupBy("leaf", "p").agg(F.max(F.struct("n", "tok")).alias("top"), F.sum("n").alias("all")).where("2 * top.n >= all")
    constant = _few(common.select("leaf", "p", F.col("top.tok").alias("tok")), 40)
    agreed = tokens.select("leaf", "tpl", F.size("toks").alias("len"), F.posexplode("toks").alias("p", "tok")).join(constant, ["leaf", "p", "tok"]).groupBy("leaf", "tpl", "len").agg(F.count("*").alias("same"))
    joined = stored(agreed.where(F.col("same") >= agree * F.col("len")).select("leaf", "tpl", F.lit(True).alias("in_leaf")))
    n_joined = joined.count()
    # documents of a group: each once, however many of its templates it holds
    held = lines.select("k", "leaf", "tpl", "short").join(maybe_broadcast(joined.select("leaf", "tpl"), 40 * n_joined), ["leaf", "tpl"]).groupBy("leaf", "k").agg(F.max("short").alias("short"))
    groups = held.groupBy("leaf", "short").agg(F.count("*").alias("n_docs"), F.min("k").alias("group_first")).where(F.col("n_docs") >= least)
    groups = _few(groups.select("leaf", "n_docs", "group_first"), 40)
    out = per.join(maybe_broadcast(joined, 40 * n_joined), ["leaf", "tpl"], "left")
    out = out.join(groups, "leaf", "left").withColumn("grouped", F.col("in_leaf").isNotNull() & F.col("n_docs").isNotNull()).where(recurs | F.col("grouped"))
    pick = lambda a, b: F.when(F.col("grouped"), F.col(a)).otherwise(F.col(b))
    return out.select("tpl", pick("leaf", "tpl").alias("cluster"), pick("n_docs", "n").alias("n_docs"), pick("group_first", "first").alias("first"))


def _dropped_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(k, drop): hashes of the line templates to drop from a document."""
    hits = lines.select("k", "tpl").join(_few(found.select("tpl", "first"), 40), "tpl").where(F.col("k") > F.col("first"))
    return hits.groupBy("k").agg(F.collect_set("tpl").alias("drop"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, agree: float = AGREE, min_tokens: int = MIN_TOKENS, equal_docs: int = EQUAL_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """docs with recurring lines taken out of text, and two more columns (long) at the end: lines and lines dropped.

    These are named _n_lines and _n_dropped, with more underscores before them where docs has such a column already.
    A document counts once for a template and for a group of them, however often it repeats the line. Null text stays null
    with one line; rows with a null key are neither counted nor changed. Repeated rows of a key are one document. Empty tables
    give empty tables. Lines are what \\n separates; tokens are separated by ASCII white space.
    """
    d_key, d_drop, n_all, n_gone = fresh(docs, "_dk", "_drop", "_n_lines", "_n_dropped")
    lines = distinct_lines(docs, key, text, depth, min_tokens)
    found = templates(docs, key, text, depth, min_docs, agree, min_tokens, lines, equal_docs, short_docs)
    drop = stored(_dropped_lines(lines, found))
    size = drop.agg(F.sum(F.size("drop") * 8 + 32).alias("b")).first()["b"] or 0
    named = drop.select(F.col("k").alias(d_key), F.col("drop").alias(d_drop))
    own = docs.join(maybe_broadcast(named, size), F.col(f"`{key}`") == F.col(d_key), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            kept, n_lines, n_dropped = [], [], []
            for t, d in zip(raw(b, text), b.column(d_drop).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                if d:
                    gone = set(d)
                    stay = [x for x in lines if not (ts := masked(x)) or (_hash(b" ".join(ts)) not in gone and whole(x) not in gone)]
                    t = b"\n".join(stay)
                else:
                    stay = lines
                kept.append(None if t is None else t.decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            cols = {n: b.column(n) for n in b.schema.names if n not in (d_key, d_drop)}
            cols[text] = pa.array(kept, pa.string())
            cols[n_all], cols[n_gone] = pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(n_all, T.LongType()), T.StructField(n_gone, T.LongType())])
    return own.mapInArrow(cut, schema)


def has_words(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(SPACE_WORD), F.lit(False))
