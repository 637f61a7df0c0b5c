"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 2- and 3-grams by language over all learnable documents: each task counts with numpy and sends at
most languages x buckets sums. The log-probability matrix (languages x BUCKETS doubles, bounded by the number of
languages) is a broadcast variable; scoring is a gather and a segmented sum in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jumpmark.llm.common import fresh
from jumpmark.llm.text_bytes import slices

BUCKETS = 1 << 14
#: Additive smoothing of the counts.
ALPHA = 0.5
#: Longer texts are hashed in pieces of so many characters, each with its neighbours' nearest one, so that no n-gram is lost or added.
PIECE = 1 << 20
#: Bytes of text hashed at a time.
SLICE = 1 << 18
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams around the letters of each part but its first and last character, and where each part's begin (one more entry than parts)."""
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    letter = _letters()[c]
    inner = letter.copy()
    inner[ends - lengths] = False
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    c = np.where(letter, c, 32).astype(np.uint32)
    x, y, z = c[at - 1], c[at], c[at + 1]
    pair = y * np.uint32(0x9E3779B1) ^ z * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    two = ((pair ^ pair >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> shift
    trio = pair ^ x * np.uint32(0xC2B2AE35)
    three = ((trio ^ trio >> np.uint32(13)) * np.uint32(0x297A2D39)) >> shift
    out = np.empty(2 * len(at), dtype=np.int32)
    out[::2], out[1::2] = two, three
    return out, 2 * np.searchsorted(at, np.concatenate([[0], ends]))


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-cased texts in pieces, each between its neighbours' characters or spaces, and the text each belongs to."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        low = f" {t.lower()} "
        for k in range(0, max(len(low) - 2, 1), PIECE):
            parts.append(low[k : k + PIECE + 2])
            owner.append(i)
    return parts, np.array(owner)


def train(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log priors, log probabilities (languages x BUCKETS). Rows with null text or lang teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "t", SLICE):
            langs = np.array(b.column("l").to_pylist(), dtype=object)
            texts = np.array(b.column("t").to_pylist(), dtype=object)
            for name in set(langs.tolist()):
                mine = texts[langs == name].tolist()
                grams, _ = _grams(_pieces(mine)[0])
                into = sums.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                into[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                into[BUCKETS] += len(mine)  # the last entry counts documents
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    taught = docs.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = taught.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    if not names:
        return [], np.zeros(0), np.zeros((0, BUCKETS))
    counts = np.zeros((len(names), BUCKETS + 1))
    where = {n: i for i, n in enumerate(names)}
    counts[[where[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    grams = counts[:, :BUCKETS] + ALPHA
    return names, np.log(counts[:, BUCKETS] / counts[:, BUCKETS].sum()), np.log(grams / grams.sum(axis=1, keepdims=True))


def score_texts(texts: list[str | None], names: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability; und and 0 without letters or without a model."""
    out, best = [UND] * len(texts), np.zeros(len(texts))
    if not names:
        return out, best
    parts, owner = _pieces([t or "" for t in texts])
    grams, starts = _grams(parts)
    total = np.zeros((len(texts), len(names)))
    n = np.zeros(len(texts), dtype=np.int64)
    np.add.at(n, owner, np.diff(starts))
    for k in range(len(names)):
        sums = np.concatenate([[0.0], np.cumsum(logp[k].astype(np.float32)[grams], dtype=np.float64)])
        np.add.at(total[:, k], owner, sums[starts[1:]] - sums[starts[:-1]])
    total += prior
    top = total.argmax(axis=1)
    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    for i in np.flatnonzero(n):
        out[i], best[i] = names[top[i]], post[i]
    return out, best


def _sent(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> Broadcast:
    """The model as a broadcast variable: languages x BUCKETS floats, bounded by the number of languages."""
    names, prior, logp = model
    return docs.sparkSession.sparkContext.broadcast((names, prior, logp.astype(np.float32)))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row. Text that is null or has no letter: und with score 0; equal scores: the language first in order."""
    sent = _sent(docs, model)
    key_type = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, logp = sent.value
        for b in slices(batches, "t", SLICE):
            out, best = score_texts(b.column("t").to_pylist(), names, prior, logp)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string()), pa.array(best)], ["k", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(score, f"k {key_type}, lang_pred string, score double")
    return rows.withColumnRenamed("k", key)


def label(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with two more columns at the end, row by row (no join): the language predicted for each row's text and its score.

    They are named _pred and _score, with more underscores before them where docs has such a column already.
    """
    sent = _sent(docs, model)
    added = fresh(docs, "_pred", "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, logp = sent.value
        for b in slices(batches, text, SLICE):
            out, best = score_texts(b.column(text).to_pylist(), names, prior, logp)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(best)], [*b.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows that are not held out (rows with a null key teach nothing) and predict every row."""
    model = train(docs, ~held_out(key) & F.col(key).isNotNull(), text, lang)
    return predict(docs, model, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
