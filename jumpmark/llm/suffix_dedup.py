"""Repeated byte strings across documents, by interval expansion on Burrows-Wheeler transforms of blocks.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document with a smaller id. Equal texts
are one text, owned by its smallest id. To cut the corpus into blocks that hold all occurrences of a string together,
every window of LENGTH bytes is keyed by the smallest hash among its GRAM-byte substrings: equal windows have equal keys,
and neighbouring windows mostly share one. Runs of windows of one key travel as packed arrays; keys that a single text
holds are dropped; for the others the runs' bytes are gathered by key, and per block of keys the transform of the distinct
runs is expanded (bwt.classes) to the classes of equal windows. A window repeats where its class has a smaller owner.

Keys that very many runs hold (a passage that a large share of all documents has) are split: their windows are keyed by all
their bytes instead, and of equal windows that a task holds only the one of the smallest document travels; the others are
marked at once. Which keys are split is estimated from texts of at most about SAMPLE bytes; it decides how rows are spread,
not what is found, and the list is bounded by the share of all runs a key must hold.

Blocks are sized by bytes of text, so a task's memory does not depend on the corpus. No text, run or mark is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from jumpmark.llm import bwt
from jumpmark.llm.common import fresh, maybe_broadcast, stored
from jumpmark.llm.text_bytes import raw, slices

#: Bytes of a string; bytes of the substrings that key it; windows in a run at most (a run's marks fit 32 bits).
LENGTH, GRAM, RUN = 50, 24, 27
#: Bytes of text for each block of keys; bytes of runs that one transform is built of.
BLOCK, TRANSFORM = 8 << 20, 2 << 20
#: Runs a task gathers before it sends them on.
FLUSH = 1 << 19
#: Runs from which on a key is split, the share of the corpus' bytes that raises it, and bytes of texts it is estimated from.
HOT, HOT_SHARE, SAMPLE = 1 << 15, 1 << 24, 1 << 30


def window_keys(data: np.ndarray) -> np.ndarray:
    """The key of each window of LENGTH bytes (GRAM: 24)."""
    w = data.astype(np.uint64)
    for width in (1, 2, 4):
        w = w[:-width] | (w[width:] << np.uint64(8 * width))
    h = w[:-16] * np.uint64(0x9E3779B97F4A7C15) + w[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[16:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, have = LENGTH - GRAM + 1, 1  # smallest of `span` neighbours
    while 2 * have <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = span - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, text, first window and number of windows of each run of windows with one key."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(np.uint64), none, none, none
    key = window_keys(data)
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)[: len(key)]
    inside = np.arange(len(key)) - starts[text] + LENGTH <= lengths[text]
    at = np.flatnonzero(inside)
    if not len(at):
        return none.view(np.uint64), none, none, none
    key, text = key[at], text[at]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(head, len(at)))
    cuts = -(-size // RUN)
    which = np.repeat(np.arange(len(head)), cuts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    head, size = head[which] + part * RUN, np.minimum(RUN, size[which] - part * RUN)
    return key[head], text[head], at[head] - starts[text[head]], size


def _by_block(block: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    b = block[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    ends = np.append(first[1:], len(b))
    columns = [c[order] for c in columns]
    for i, j in zip(first, ends, strict=True):
        yield int(b[i]), [c[i:j] for c in columns]


def _join(blobs: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _owners(docs: DataFrame) -> DataFrame:
    return docs.where("k is not null").groupBy("h").agg(F.min("k").alias("k"), F.max(F.octet_length("t")).alias("b"), F.min("d").alias("lo"), F.max("d").alias("hi"))


def _texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """docs as (k, h: 64-bit hash of the text, t), and a row (h, k, b) for each text.

    Texts that share their 64-bit hash by chance (told by a digest of 128 bits) get another one: there are hardly any such
    hashes even among ten billion texts, so they are few enough to be named in the plan.
    """
    t = F.col(text)
    d = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("h"), F.md5(t.cast("binary")).alias("d"), t.alias("t"))
    owners = stored(_owners(d))
    clash = [r["h"] for r in owners.where("lo <> hi").select("h").collect()]
    if clash:
        d = d.withColumn("h", F.when(F.col("h").isin(clash), F.xxhash64("d")).otherwise(F.col("h")))
        owners = stored(_owners(d))
    return d.drop("d"), owners.select("h", "k", "b")


def ranked(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """docs with a column that numbers its keys in their order, for keys that are no integers; and the column's name."""
    name, other = fresh(docs, "_rank", "_rank_key")
    keys = docs.select(F.col(f"`{key}`").alias(other)).where(F.col(other).isNotNull()).distinct().orderBy(other)
    keys = stored(keys.withColumn(name, F.monotonically_increasing_id()))  # grows from partition to partition, and these are sorted
    return docs.join(keys, F.col(f"`{key}`") == F.col(other), "left").drop(other), name


def hot_keys(texts: DataFrame, n_bytes: int) -> np.ndarray:
    """Keys that about HOT runs or more hold (more in a large corpus: see HOT_SHARE), sorted.

    Every n-th text is counted, n growing with the corpus; keys that are rare in each batch are left out of the shuffle as
    far as that cannot hide a hot one. At most a key for each HOT_SHARE-th part of the runs comes to the driver.
    """
    step = max(1, n_bytes // SAMPLE)
    least = max(HOT, n_bytes // HOT_SHARE) // step
    flushes = max(1, n_bytes // step // 14 // FLUSH)
    local = max(1, least // (4 * flushes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            some = count >= local
            return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(count[some].astype(np.int64))], ["key", "n"])

        for b in slices(batches, "t", 1 << 20):
            take = []
            for t, h in zip(raw(b, "t"), b.column("h").to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    take.append(t)
            if take:
                held.append(runs(take)[0])
                n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                n = 0
        if held:
            yield flush()

    some = texts.where(F.pmod(F.xxhash64("h"), F.lit(step)) == 0).select("h", "t")
    counts = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least // 2))
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], dtype=np.int64).view(np.uint64))


def split_hot(hot: np.ndarray, data: bytes, begin: np.ndarray, key: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of hot keys as single windows keyed by all their bytes, and these bytes; begin: where each run's text starts in data."""
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    is_hot = hot[at] == key
    n = size[is_hot]
    place = bwt.ranges((begin + first)[is_hot], n) if is_hot.any() else np.zeros(0, np.int64)
    flat = np.frombuffer(data, np.uint8)
    window = flat[place[:, None] + np.arange(LENGTH)]
    h = np.zeros(len(place), np.uint64)
    for j in range(LENGTH):
        h = (h ^ window[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if not len(place):
        return key, text, first, size, np.zeros(len(key), bool), window
    cold = ~is_hot
    cat = lambda a, b: np.concatenate([a[cold], b])
    one = np.ones(len(place), size.dtype)
    return cat(key, h), cat(text, np.repeat(text[is_hot], n)), cat(first, bwt.ranges(first[is_hot], n)), cat(size, one), np.repeat([False, True], [int(cold.sum()), len(place)]), window


def first_holders(key: np.ndarray, owner: np.ndarray, window: np.ndarray) -> np.ndarray:
    """All but the windows that a smaller owner holds as well, byte for byte, as far as equal keys tell."""
    order = np.lexsort((owner, key))
    k = key[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(order[head], np.diff(np.append(head, len(k))))
    return (owner == owner[least]) | (window != window[least]).any(axis=1)


def _keyed_runs(texts: DataFrame, blocks: int, hot: np.ndarray) -> DataFrame:
    """Packed runs by block of keys: (p, key high, key low, text ids and how often each, first window, windows).

    Windows of hot keys that a smaller document of the same task holds come as marks instead, by block of documents:
    (p, documents, first window) in ts and fs, with ss empty.
    """
    shared_hot = texts.sparkSession.sparkContext.broadcast(hot) if len(hot) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, text, first, size, single, row, window = (np.concatenate(c) for c in zip(*held, strict=True))
            rows = []
            if single.any():
                at = np.flatnonzero(single)
                gone = at[~first_holders(key[at], row[at], window)]
                for q, (o, f) in _by_block(row[gone] % blocks, [row[gone], first[gone]]) if len(gone) else ():
                    rows.append((q, b"", b"", o.tobytes(), b"", f.astype(np.uint32).tobytes(), b""))
                stay = np.ones(len(key), bool)
                stay[gone] = False
                key, text, first, size = key[stay], text[stay], first[stay], size[stay]
                order = np.argsort(text, kind="stable")
                key, text, first, size = key[order], text[order], first[order], size[order]
            for p, (ks, ts, fs, ss) in _by_block((key % np.uint64(blocks)).astype(np.int64), [key // np.uint64(blocks), text, first, size]):
                new = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]]))
                often = np.diff(np.append(new, len(ts)))
                rows.append((p, (ks >> np.uint64(16)).astype(np.uint32).tobytes(), ks.astype(np.uint16).tobytes(), ts[new].tobytes(), often.astype(np.uint32).tobytes(), fs.astype(np.uint32).tobytes(), ss.astype(np.uint8).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7))], ["p", "hi", "lo", "ts", "often", "fs", "ss"])

        for b in slices(batches, "t", 1 << 20):
            take, ids, own = [], [], []
            for t, h, k in zip(raw(b, "t"), b.column("h").to_pylist(), b.column("k").to_pylist(), strict=True):
                if t and len(t) >= LENGTH and (h not in seen or k < seen[h]):
                    seen[h] = k
                    take.append(t)
                    ids.append(h)
                    own.append(k)
            if not take:
                continue
            key, text, first, size = runs(take)
            single, window = np.zeros(len(key), bool), np.zeros((0, LENGTH), np.uint8)
            if shared_hot is not None and len(key):
                lengths = np.array([len(t) for t in take], dtype=np.int64)
                key, text, first, size, single, window = split_hot(shared_hot.value, b"".join(take), (np.cumsum(lengths) - lengths)[text], key, text, first, size)
            held.append((key, np.array(ids, np.int64)[text], first, size, single, np.array(own, np.int64)[text], window))
            n += len(key)
            if n >= FLUSH:
                yield flush()
                n = 0
        if held:
            yield flush()

    return texts.select("k", "h", "t").mapInArrow(run, "p long, hi binary, lo binary, ts binary, often binary, fs binary, ss binary")


def _shared_runs(keyed: DataFrame, blocks: int) -> DataFrame:
    """Of packed runs those whose key two texts hold, packed by block of texts: (q, text ids, key block, key, first, windows).

    Marks pass through with -1 for the key block.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = pdf["ss"].map(len) == 0
        done = [(int(q), -1, ts, b"", fs, b"") for q, ts, fs in zip(pdf["p"][marks], pdf["ts"][marks], pdf["fs"][marks], strict=True)]
        pdf = pdf[~marks]
        if pdf.empty:
            return pd.DataFrame(done, columns=["q", "p", "ts", "ks", "fs", "ss"])
        key = (_join(pdf["hi"], "u4").astype(np.uint64) << np.uint64(16)) | _join(pdf["lo"], "u2")
        text = np.repeat(_join(pdf["ts"], "i8"), _join(pdf["often"], "u4"))
        first, size = _join(pdf["fs"], "u4"), _join(pdf["ss"], "u1")
        order = np.argsort(key)
        k, t = key[order], text[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        shared = np.minimum.reduceat(t, head) != np.maximum.reduceat(t, head)
        keep = order[np.repeat(shared, np.diff(np.append(head, len(k))))]
        keep = keep[np.argsort(text[keep], kind="stable")]
        p, rows = int(pdf["p"].iloc[0]), done
        for q, (ts, ks, fs, ss) in _by_block(text[keep] % blocks, [text[keep], key[keep].astype(np.uint32), first[keep], size[keep]]):
            rows.append((q, p, ts.tobytes(), ks.tobytes(), fs.tobytes(), ss.tobytes()))
        return pd.DataFrame(rows, columns=["q", "p", "ts", "ks", "fs", "ss"])

    return keyed.groupBy("p").applyInPandas(one, "q long, p long, ts binary, ks binary, fs binary, ss binary")


def _segments(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """The runs' bytes, packed by block of keys: (p, owners, keys, first, windows, bytes)."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        where = {h: i for i, h in enumerate(right["h"])}
        owner = right["k"].to_numpy()
        data = [t.encode() if isinstance(t, str) else bytes(t) for t in right["t"]]
        for p, ts, ks, fs, ss in left[["p", "ts", "ks", "fs", "ss"]].itertuples(index=False, name=None):
            ts, first, size = np.frombuffer(ts, "i8"), np.frombuffer(fs, "u4"), np.frombuffer(ss, "u1")
            at = [where[h] for h in ts.tolist()]
            parts = [data[i][f : f + s + LENGTH - 1] for i, f, s in zip(at, first.tolist(), size.tolist(), strict=True)]
            rows.append((p, owner[at].astype(np.int64).tobytes(), ks, fs, ss, b"".join(parts)))
        return pd.DataFrame(rows, columns=["p", "ow", "ks", "fs", "ss", "data"])

    return shared.groupBy("q").cogroup(texts.groupBy("q")).applyInPandas(one, "p long, ow binary, ks binary, fs binary, ss binary, data binary")


def repeated(parts: list[bytes], owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run a mark per window (bit j: window j) that a run with a smaller owner holds the window too."""
    ids: dict[bytes, int] = {}
    which = np.array([ids.setdefault(s, len(ids)) for s in parts], dtype=np.int64)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    distinct = list(ids)
    text = np.frombuffer(bytes([bwt.SEP]) + bytes([bwt.SEP]).join(distinct) + bytes([bwt.SEP]), np.uint8)
    lengths = np.array([len(s) for s in distinct], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    windows = lengths - LENGTH + 1
    places = bwt.ranges(starts, windows)
    rank, cls = bwt.classes(text, LENGTH)
    found = cls[rank[places]]
    smallest = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, found, np.repeat(least, windows))
    smallest = smallest[found]  # by place
    begin = np.cumsum(windows) - windows
    marks = np.zeros(len(parts), np.uint32)
    for j in range(RUN):
        some = np.flatnonzero(size > j)
        marks[some] |= (smallest[begin[which[some]] + j] < owner[some]).astype(np.uint32) << np.uint32(j)
    return marks


def _marks(segments: DataFrame, blocks: int) -> DataFrame:
    """Windows that repeat, packed by block of owners: (q, owners, first window, marks)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, key, first, size = _join(pdf["ow"], "i8"), _join(pdf["ks"], "u4"), _join(pdf["fs"], "u4"), _join(pdf["ss"], "u1").astype(np.int64)
        data = b"".join(pdf["data"])
        length = size + LENGTH - 1
        ends = np.cumsum(length)
        batches = max(1, -(-len(data) // TRANSFORM))
        rows = []
        for _, (at,) in _by_block((key * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) % batches, [np.arange(len(key))]):
            parts = [data[e - n : e] for e, n in zip(ends[at].tolist(), length[at].tolist(), strict=True)]
            marks = repeated(parts, owner[at], size[at])
            some = np.flatnonzero(marks)
            if len(some):
                for q, (o, f, m) in _by_block(owner[at][some] % blocks, [owner[at][some], first[at][some], marks[some]]):
                    rows.append((q, o.tobytes(), f.tobytes(), m.tobytes()))
        return pd.DataFrame(rows, columns=["q", "ow", "fs", "ms"])

    return segments.groupBy("p").applyInPandas(one, "q long, ow binary, fs binary, ms binary")


def _spans(marks: DataFrame) -> DataFrame:
    """(k, spans): the byte intervals to remove from a text, as packed starts and ends, by owner."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, first, mark = _join(pdf["ow"], "i8"), _join(pdf["fs"], "u4").astype(np.int64), _join(pdf["ms"], "u4")
        bits = (mark[:, None] >> np.arange(RUN, dtype=np.uint32)) & np.uint32(1)
        row, j = np.nonzero(bits)
        o, s = owner[row], first[row] + j
        order = np.lexsort((s, o))
        o, s = o[order], s[order]
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] > s[:-1] + LENGTH)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(o)) - 1
        rows = []
        for k, (a, e) in _by_block(o[head], [s[head], s[tail] + LENGTH]):
            rows.append((k, np.column_stack([a, e]).astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["k", "spans"])

    return marks.groupBy("q").applyInPandas(one, "k long, spans binary")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows as (k, h: text hash, t, copy: another row with a smaller key has the whole text, spans: packed intervals)."""
    d, owners = _texts(docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text)), key, text)
    total = owners.agg(F.sum("b").alias("b"), F.count("*").alias("n")).first()
    blocks = max(8, -(-(total["b"] or 0) // BLOCK))
    long = d.where("k is not null and octet_length(t) >= %d" % LENGTH)
    keyed = _keyed_runs(long, blocks, hot_keys(long, total["b"] or 0))
    found = stored(_shared_runs(keyed, blocks))
    shared = found.where("p >= 0")
    # only texts with shared runs go on, once each
    ids = shared.select("ts").mapInArrow(_ids, "h long").distinct()
    wanted = stored(ids.join(owners, "h").select("h", "k"))
    one = d.join(maybe_broadcast(wanted, 24 * total["n"]), ["h", "k"])
    one = one.withColumn("q", F.pmod("h", F.lit(blocks)))
    marks = _marks(_segments(shared, one), blocks)
    at_once = found.where("p < 0").mapInArrow(_single_marks, marks.schema)
    spans = stored(_spans(stored(marks.unionByName(at_once))))
    size = spans.agg(F.sum(F.length("spans") + 32).alias("b")).first()["b"] or 0
    who = owners.select(F.col("h").alias("oh"), F.col("k").alias("ok"))
    small = d.select("k", "h").join(who, F.col("h") == F.col("oh")).where("k > ok").select("k").distinct()
    copies = stored(small)
    n = copies.count()
    out = d.join(maybe_broadcast(spans, size), "k", "left")
    out = out.join(maybe_broadcast(copies.withColumn("copy", F.lit(True)), 16 * n), "k", "left")
    return out.select("k", "h", "t", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")


def _single_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of single windows: the first bit of each."""
    for b in batches:
        ones = [np.ones(len(x) // 4, np.uint32).tobytes() for x in b.column("fs").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("ts"), b.column("fs"), pa.array(ones, pa.binary())], ["q", "ow", "fs", "ms"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(np.frombuffer(x, "i8")) for x in b.column("ts").to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["h"])


def cut(data: bytes, copy: bool, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes and runs of bytes go."""
    if copy and len(data) >= LENGTH:
        return b"", len(data), 1
    if not spans:
        return data, 0, 0
    kept, at, gone = [], 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()
    for a, e in pairs:
        kept.append(data[at:a])
        gone += e - a
        at = e
    kept.append(data[at:])
    return b"".join(kept), gone, len(pairs)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty. Rows with a null key are kept whole and are no one's smaller document. Keys that are no
    integers are taken in their own order. Rows that repeat a key with the same text are one document and all get its result;
    one key should not have two texts. Texts of fewer than LENGTH bytes lose nothing. Columns beside key and text are not
    looked at.
    """
    key_type = docs.schema[key].dataType
    docs = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    if not isinstance(key_type, IntegralType):
        docs, number = ranked(docs, key)
        names = docs.select(number, key).where(F.col(number).isNotNull()).distinct()
        out = digest(docs.select(number, text), number, text).join(stored(names), number, "left")
        return out.select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            rows = []
            for t, copy, spans in zip(raw(b, "t"), b.column("copy").to_pylist(), b.column("spans").to_pylist(), strict=True):
                left, gone, n = cut(t or b"", copy, spans)
                rows.append((len(t or b""), gone, n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return find(docs, key, text).mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
