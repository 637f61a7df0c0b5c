"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other, the verdict last; each later model also sees the earlier categories'
probabilities, and is trained on out-of-fold predictions of them so that it meets the same kind of value in training as in
use. Features are the presence of selected words. What a fold is predicted with, words included, is chosen and fitted
without that fold. The models are fitted on a bounded sample of labelled documents (MAX_TRAIN, the smallest hashes of the
key); every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import stored
from jumpmark.llm.text_bytes import alnum_words, raw, slices

#: Labelled documents the models are fitted on at most; words each model uses as features; folds.
MAX_TRAIN, FEATURES, FOLDS = 20_000, 512, 5
#: Words a task counts before it sends them on.
HELD = 1 << 18
#: category -> test over the labels, in the order of the chain; the last is the verdict
CATEGORIES = {"low_quality": "quality = 0", "severe": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]  # per category: a weight per word, per earlier category, and the constant
    thresholds: list[float]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 2.0, steps: int = 25) -> np.ndarray:
    """Logistic regression with an L2 penalty (not on the constant), by Newton's method; a constant model for one class.

    Curvature is taken in single precision, which changes the path but not where the gradient vanishes.
    """
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        half = x * np.sqrt(p * (1 - p) + 1e-9).astype(np.float32)[:, None]
        step = np.linalg.solve((half.T @ half).astype(np.float64) + np.diag(ridge), g)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row counts as positive, with the best F1 on out-of-fold predictions."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str], vocabulary: dict[bytes, int], chosen: list[list[np.ndarray]]) -> Chain:
    """x: rows x words; chosen: for each category the words (columns of x) for each fold's predictions, and last those of its model."""
    weights, thresholds, earlier = [], [], np.zeros((len(x), 0))
    for k in range(len(categories)):
        out = np.zeros(len(x))
        for f in range(FOLDS):
            held = fold == f
            if held.any():
                rest = ~held if (~held).any() else held
                w = fit_linear(np.column_stack([x[rest][:, chosen[k][f]], earlier[rest]]), y[rest, k])
                out[held] = _apply(np.column_stack([x[held][:, chosen[k][f]], earlier[held]]), w)
        own = fit_linear(np.column_stack([x[:, chosen[k][-1]], earlier]), y[:, k])
        wide = np.zeros(len(vocabulary) + k + 1)
        wide[chosen[k][-1]] = own[: len(chosen[k][-1])]
        wide[len(vocabulary) :] = own[len(chosen[k][-1]) :]
        weights.append(wide)
        thresholds.append(_threshold(out, y[:, k]))
        earlier = np.column_stack([earlier, out])
    used = np.unique(np.concatenate([c[-1] for c in chosen]))
    words = {i: w for w, i in vocabulary.items()}
    keep = [np.concatenate([w[used], w[len(vocabulary) :]]) for w in weights]
    return Chain(categories, {words[i]: n for n, i in enumerate(used.tolist())}, keep, thresholds)


def predict_rows(texts: list[bytes | None], chain: Chain) -> np.ndarray:
    """Probabilities, texts x categories."""
    n = len(chain.vocabulary)
    known = chain.vocabulary.keys()
    base = np.array([w[:n] for w in chain.weights])
    out = np.zeros((len(texts), len(chain.categories)))
    for i, t in enumerate(texts):
        at = sorted(chain.vocabulary[w] for w in known & set(alnum_words(t or b"")))
        sums = base[:, at].sum(axis=1)
        for k, w in enumerate(chain.weights):
            z = sums[k] + out[i, :k] @ w[n:-1] + w[-1]
            out[i, k] = 1 / (1 + np.exp(-min(30, max(-30, z))))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN, features: int = FEATURES) -> Chain | None:
    """Fit a chain; None without labelled documents.

    Labels with a null key or a null label are left out. Of repeated labels of a key the largest tuple counts, of repeated
    rows of a document the smallest text (null: no words).
    """
    names, n_cat = list(categories), len(categories)
    tests = [F.expr(t).cast("int") for t in categories.values()]
    marked = labels.select(F.col(key).alias("k"), F.struct(*(t.alias(f"y{i}") for i, t in enumerate(tests))).alias("y")).where(F.col("k").isNotNull())
    marked = marked.where(" and ".join(f"y.y{i} is not null" for i in range(n_cat))).groupBy("k").agg(F.max("y").alias("y"))
    sample = marked.orderBy(F.xxhash64("k"), "k").limit(max_train).select("k", "y.*")
    ys = [f"y{i}" for i in range(n_cat)]
    # max_train rows of a few numbers
    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").groupBy("k", *ys).agg(F.min("t").alias("t"))
    chosen = stored(chosen.withColumn("f", F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(FOLDS)).cast("int")))

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Counter]] = {}  # by fold: documents with a word, and those of each category

        def flush() -> pa.RecordBatch:
            rows = [(w, f, n, *(c[w] for c in of[1:])) for f, of in held.items() for w, n in of[0].items()]
            held.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["w", "f", "n", *(f"m{i}" for i in range(n_cat))])

        for b in slices(batches, "t"):
            for t, f, *marks in zip(raw(b, "t"), b.column("f").to_pylist(), *(b.column(y).to_pylist() for y in ys), strict=True):
                seen = set(alnum_words(t or b""))
                of = held.setdefault(f, [Counter() for _ in range(n_cat + 1)])
                of[0].update(seen)
                for c, y in zip(of[1:], marks, strict=True):
                    if y:
                        c.update(seen)
            if sum(len(of[0]) for of in held.values()) > HELD:
                yield flush()
        if any(of[0] for of in held.values()):
            yield flush()

    totals = chosen.groupBy("f").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).collect()  # FOLDS rows
    if not totals:
        return None
    kinds = "w binary, f int, n long" + "".join(f", m{i} long" for i in range(n_cat))
    columns = ["n", *(f"m{i}" for i in range(n_cat))]
    in_fold = [F.sum(F.when(F.col("f") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in columns for f in range(FOLDS)]
    counts = chosen.mapInArrow(word_counts, kinds).groupBy("w").agg(*(F.sum(c).alias(c) for c in columns), *in_fold).where("n >= 2")
    counts = stored(counts)

    def best(use: int, i: int, left_out: int) -> DataFrame:
        """The words that tell most about category i outside a fold: chi-square, the sign of the association ignored."""
        of = lambda c: F.col(c) if left_out < 0 else F.col(c) - F.col(f"{c}_{left_out}")
        n, m = (float(sum(r[c] for r in totals if r["f"] != left_out)) for c in ("n", f"y{i}"))
        chi = F.pow(of(f"m{i}") * n - of("n") * m, 2) / (of("n") * (n - of("n") + 1.0) * max(1.0, m * (n - m)))
        return counts.where(of("n") >= 2).select("w", chi.alias("score")).orderBy(F.col("score").desc(), "w").limit(features).select(F.lit(use).alias("s"), "w")

    uses = [(i, f) for i in range(n_cat) for f in (*range(FOLDS), -1)]  # what words are chosen for: a category, all but a fold
    picked = reduce(DataFrame.unionAll, (best(s, *use) for s, use in enumerate(uses))).collect()  # `features` words a use
    words = sorted({bytes(r["w"]) for r in picked})
    vocabulary = {w: i for i, w in enumerate(words)}
    chosen_words = [[np.array(sorted(vocabulary[bytes(r["w"])] for r in picked if r["s"] == i * (FOLDS + 1) + f), dtype=np.int64) for f in range(FOLDS + 1)] for i in range(n_cat)]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in slices(batches, "t"):
            found = [sorted(vocabulary[w] for w in known & set(alnum_words(t or b""))) for t in raw(b, "t")]
            yield pa.RecordBatch.from_arrays([b.column("f"), *(b.column(y) for y in ys), pa.array(found, pa.list_(pa.int32()))], ["f", *ys, "at"])

    rows = chosen.mapInArrow(present, f"f int, {', '.join(f'{y} int' for y in ys)}, at array<int>").collect()  # max_train rows: a document has one
    rows.sort()  # the same model whatever order they come in
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    y = np.array([[r[c] for c in ys] for r in rows], dtype=np.float64)
    return fit_chain(x, y, np.array([r["f"] for r in rows]), names, vocabulary, chosen_words)


def classify(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, p_<category> for each category in order, toxic_pred (the probability of the chain's last category reaches its threshold).

    Null text has no words and gets the models' constants; without a chain all probabilities are 0 and nothing is toxic.
    """
    names = chain.categories if chain else list(CATEGORIES)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            p = predict_rows(raw(b, "t"), chain) if chain else np.zeros((b.num_rows, len(names)))
            toxic = p[:, -1] >= chain.thresholds[-1] if chain else np.zeros(b.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(toxic)], ["k", *(f"p_{c}" for c in names), "toxic_pred"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {key_type}, " + ", ".join(f"p_{c} double" for c in names) + ", toxic_pred boolean")
    return out.withColumnRenamed("k", key)
