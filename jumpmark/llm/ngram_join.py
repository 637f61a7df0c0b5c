"""Similarity join of documents on sets of word n-grams, by rare-first prefix filtering.

Documents with equal sets form a class; classes are joined. Tokens are hashes of n-grams, ordered by the exact number of
documents that hold them, rare first, then by value. Two sets with Jaccard similarity of at least t share a token in their
prefixes of n - ceil(t n) + 1 tokens. Tokens of one document only come first in every order and never match, so a document
with that many of them links with nothing and goes at once; the others keep the tokens they share with some document.
Pairs that meet in a prefix token pass the length filter, the positional filter (what can still overlap before and behind
the shared token) and the suffix filter (own tokens and a 256-bit parity signature of the shared ones bound the symmetric
difference from below); the pairs that remain are verified once each on the whole sets.

Frequencies: tokens travel packed, seven bytes each, to blocks of token values; those of two documents or more come back
to the flush of documents they came from. Tokens of very many documents (found by counting in the first pass, at most a
fixed number of them) would meet in one block; their frequency goes with the tasks instead.

So that groups of near copies are not expanded into all their pairs, a first round pairs each token's documents with one
pivot only and a second, for the longer lists, with a few. Lists that still hold more than one component are then paired
across components: short ones by a join; long ones, gathered into groups that have documents in common, in blocks of bounded
size, which compare whole sets and make a row only for a link that joins two components. No link that could join two
components is left out, so the components are those of all links. Links are counted component by component, in such blocks
too, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import maybe_broadcast, stored
from jumpmark.llm.graph import components as connected
from jumpmark.llm.text_bytes import raw, slices, space_words

#: Tokens a task gathers before it sends them on; tokens for each block of values; blocks at least (a power of two).
FLUSH, BLOCK, LEAST_BLOCKS = 1 << 20, 1 << 20, 1 << 8
#: A token is counted apart from this many documents on (more in a corpus of over HOT * HOT_SHARE tokens), and how often a flush must hold it to say so.
HOT, HOT_SHARE, HOT_LOCAL = 1 << 12, 1 << 20, 4
#: Pivots per token in the second round; documents of a list that are paired by a join; documents of one side of a block.
PIVOTS, LIGHT, CELL = 8, 64, 1 << 11
#: Tokens that one side of a block holds, about.
CELL_TOKENS = 1 << 20
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MOVED = "p long, f long, hi binary, lo binary, at binary, df binary, rs binary, ns binary"
_NAMES = ["p", "f", "hi", "lo", "at", "df", "rs", "ns"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; fewer words make one shingle, none an empty set."""
    out = []
    for t in texts:
        w = space_words(t or b"")
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
        m = min(n, len(w))
        s = np.full(len(w) - m + 1, m, dtype=np.uint64)
        for k in range(m):
            s = (s ^ h[k : len(h) - m + 1 + k]) * _K[k % 4] + np.uint64(k + 1)
            s ^= s >> np.uint64(32)
        out.append(np.unique(_mix(s)))
    return out


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF) - (1 << 63)


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (k, r: set fingerprint, n), and rows (tok, c) of tokens that a flush of a task holds often."""
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema["k"].dataType
    key_arrow = to_arrow_type(key_type)
    names = ["k", "r", "n", "tok", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def often() -> pa.RecordBatch:
            tok, c = np.unique(np.concatenate(held), return_counts=True)
            some = c >= HOT_LOCAL
            m = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, key_arrow), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(tok[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names)

        for b in slices(batches, "t"):
            sets = shingle_sets(raw(b, "t"), n)
            prints = [fingerprint(s) for s in sets]
            for s, r in zip(sets, prints, strict=True):
                if r not in seen:
                    seen.add(r)
                    held.append(s)
                    size += len(s)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            if size >= FLUSH:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return docs.mapInArrow(run, f"k {key_type.simpleString()}, r long, n int, tok long, c long")


def _hot_tokens(survey: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of very many documents, sorted, and their counts: at most HOT_SHARE of them, however large the corpus."""
    least = max(HOT, total // HOT_SHARE)
    rows = survey.where("tok is not null").groupBy("tok").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow()
    tok, c = rows.column("tok").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(tok)
    return tok[order], c[order]


def _send(docs: DataFrame, n: int, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Packed tokens by block p and flush f: (token without its block in hi and lo, at: which document of the flush).

    Each flush has a row with its documents (rs, ns) and their hot tokens with frequencies (hi and lo hold all of their bits).
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    mask, wide = np.uint64((1 << bits) - 1), np.uint64((1 << (40 + bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot_tok, hot_n = sent.value
        seen, held, rs, number = set(), [], [], 0
        size = 0

        def flush() -> pa.RecordBatch:
            f = (TaskContext.get().partitionId() << 24) + number
            ns = np.array([len(s) for s in held], np.int64)
            tok, at = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), ns)
            where = np.minimum(np.searchsorted(hot_tok, tok), max(0, len(hot_tok) - 1))
            is_hot = hot_tok[where] == tok if len(hot_tok) else np.zeros(len(tok), bool)
            own = tok[is_hot] & wide
            rows = [(f & ((1 << bits) - 1), f, own.tobytes(), b"", at[is_hot].tobytes(), hot_n[where[is_hot]].astype(np.uint32).tobytes() if len(hot_tok) else b"", np.array(rs, np.int64).tobytes(), ns.astype(np.uint32).tobytes())]
            tok, at = tok[~is_hot] & wide, at[~is_hot]
            p = (tok & mask).astype(np.int64)
            order = np.argsort(p, kind="stable")
            p, tok, at = p[order], tok[order] >> np.uint64(bits), at[order]
            hi, lo = (tok >> np.uint64(8)).astype(np.uint32), tok.astype(np.uint8)
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
            for i, j in zip(first, np.append(first[1:], len(p)), strict=True):
                rows.append((int(p[i]), f, hi[i:j].tobytes(), lo[i:j].tobytes(), at[i:j].tobytes(), None, None, None))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], _NAMES)

        for b in slices(batches, "t"):
            for s in shingle_sets(raw(b, "t"), n):
                r = fingerprint(s)
                if len(s) and r not in seen:
                    seen.add(r)
                    held.append(s)
                    rs.append(r)
                    size += len(s)
                    if size >= FLUSH or len(held) == 1 << 16:
                        yield flush()
                        held, rs, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, _MOVED)


def _returned(moved: DataFrame) -> DataFrame:
    """Of packed tokens those that two documents hold, by flush, with their frequency in df."""

    def one(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in _NAMES]
        rows, parts = [], []
        for p, f, hi, lo, at, df, rs, ns in zip(*cols, strict=True):
            if rs is not None:
                rows.append((p, f, hi, lo, at, df, rs, ns))
            else:
                parts.append((p, f, np.frombuffer(hi, np.uint32), np.frombuffer(lo, np.uint8), np.frombuffer(at, np.uint16)))
        if parts:
            sizes = [len(x[2]) for x in parts]
            tok = (np.concatenate([x[2] for x in parts]).astype(np.uint64) << np.uint64(8)) | np.concatenate([x[3] for x in parts])
            order = np.argsort(tok)
            ordered = tok[order]
            head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            count = np.diff(np.append(head, len(tok)))
            df = np.empty(len(tok), np.uint32)
            df[order] = np.repeat(count, count)
            end = np.cumsum(sizes)
            for (p, f, hi, lo, at), e, m in zip(parts, end.tolist(), sizes, strict=True):
                own = df[e - m : e]
                some = np.flatnonzero(own > 1)
                if len(some):
                    rows.append((p, f, hi[some].tobytes(), lo[some].tobytes(), at[some].tobytes(), own[some].tobytes(), None, None))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], _NAMES)

    return moved.groupBy("p").applyInArrow(one, _MOVED)


def _candidates(returned: DataFrame, bits: int, percent: int) -> DataFrame:
    """Classes that can link: (r, f, n, alone: tokens of no other document, toks: the others, rare first, b0 to b3: their parity).

    A class has a row for each flush that holds it, all alike but for f.
    """
    schema = "r long, f long, n int, alone int, toks array<long>, b0 long, b1 long, b2 long, b3 long"
    names = ["r", "f", "n", "alone", "toks", "b0", "b1", "b2", "b3"]

    def one(table: pa.Table) -> pa.Table:
        tok, at, df, rs, ns, f = [], [], [], None, None, 0
        for p, f, hi, lo, a, d, r, n in zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True):
            if r is not None:
                rs, ns = np.frombuffer(r, np.int64), np.frombuffer(n, np.uint32).astype(np.int64)
                tok.append(np.frombuffer(hi, np.uint64))
            else:
                key = (np.frombuffer(hi, np.uint32).astype(np.uint64) << np.uint64(8)) | np.frombuffer(lo, np.uint8)
                tok.append((key << np.uint64(bits)) | np.uint64(p))
            at.append(np.frombuffer(a, np.uint16))
            df.append(np.frombuffer(d, np.uint32))
        tok, at, df = np.concatenate(tok).view(np.int64), np.concatenate(at).astype(np.int64), np.concatenate(df)
        shared = np.bincount(at, minlength=len(rs))
        alone = ns - shared
        keep = (alone < ns - _needed(ns, percent) + 1) & (shared > 0)
        some = keep[at]
        tok, at, df = tok[some], at[some], df[some]
        order = np.lexsort((tok, df, at))
        tok, at = tok[order], at[order]
        rows = np.flatnonzero(keep)
        sizes = shared[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        number = np.cumsum(keep) - 1
        cell = number[at] * 256 + ((tok >> 3) & 255)
        bit = (np.bincount(cell, minlength=256 * len(rows)) & 1).astype(np.uint8)
        signs = np.packbits(bit).view(np.int64).reshape(-1, 4)
        return pa.Table.from_arrays([pa.array(rs[rows]), pa.array(np.full(len(rows), f, np.int64)), pa.array(ns[rows].astype(np.int32)), pa.array(alone[rows].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok)), *(pa.array(np.ascontiguousarray(signs[:, i])) for i in range(4))], names)

    return returned.groupBy("f").applyInArrow(one, schema)


def _posted(docs: DataFrame, survey: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that can link, once each, and their postings (tok, r, n, m, i, alone, signature): prefix tokens of two classes or more."""
    total = survey.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BLOCKS, total // BLOCK).bit_length() - 1
    moved = _send(docs, n, bits, _hot_tokens(survey, total))
    classes = stored(_candidates(_returned(moved), bits, percent))
    once = stored(classes.groupBy("r").agg(F.min("f").alias("f")))
    classes = classes.join(maybe_broadcast(once, 24 * once.count()), ["r", "f"])
    length = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - alone").cast("int")
    rows = classes.select("r", "n", "alone", F.size("toks").alias("m"), *(f"b{i}" for i in range(4)), F.posexplode(F.slice("toks", F.lit(1), length)).alias("i", "tok"))
    met = rows.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    return classes, stored(rows.join(met, "tok"))


def _passes(percent: int) -> Column:
    """Length, positional and suffix filter of two postings x and y of one token."""
    need = F.expr(f"({percent} * (cast(x.n as long) + y.n) + {99 + percent}) div {100 + percent}")
    overlap = F.least("x.i", "y.i") + 1 + F.least(F.col("x.m") - F.col("x.i") - 1, F.col("y.m") - F.col("y.i") - 1)
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(4)), F.col("x.alone") + F.col("y.alone"))
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (overlap >= need) & (differ <= F.col("x.n").cast("long") + F.col("y.n") - 2 * need)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of distinct candidate pairs of classes (a, b) those that are similar; whole sets are compared (only shared tokens can meet)."""
    side = lambda c: classes.select(F.col("r").alias(c), F.col("n").alias(f"n{c}"), F.col("toks").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _unjoined(post: DataFrame, found: DataFrame, more_than: int) -> DataFrame:
    """Postings with their component's root and their list's size, of the tokens that more than one component (and so many classes) share."""
    roots = connected(found)
    placed = post.join(roots, post["r"] == roots["node"], "left").withColumn("root", F.coalesce("root", "r")).drop("node")
    still = placed.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where((F.col("lo") != F.col("hi")) & (F.col("c") > more_than)).select("tok", "c")
    return stored(placed.join(still, "tok"))


def linked(x: list[np.ndarray], y: list[np.ndarray], nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of x (rows) are similar to which of y (columns); nx, ny: their whole sizes, tokens that meet nothing included."""
    both = np.zeros((len(x), len(y)), np.int64)
    tx, ty = np.concatenate(x), np.concatenate(y)
    at_x, at_y = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    known = np.intersect1d(tx, ty)
    ix, iy = np.searchsorted(known, tx), np.searchsorted(known, ty)
    some = known[np.minimum(ix, len(known) - 1)] == tx if len(known) else np.zeros(len(tx), bool)
    ix, at_x = ix[some], at_x[some]
    some = known[np.minimum(iy, len(known) - 1)] == ty if len(known) else np.zeros(len(ty), bool)
    iy, at_y = iy[some], at_y[some]
    cx, cy = np.bincount(ix, minlength=len(known)), np.bincount(iy, minlength=len(known))
    # tokens that much of both sides hold go through a matrix product, the others token by token
    many = cx * cy >= max(256, len(x) * len(y) // 64)
    wide = np.flatnonzero(many)
    for lo in range(0, len(wide), 1024):
        number = np.full(len(known) + 1, -1)
        number[wide[lo : lo + 1024]] = np.arange(len(wide[lo : lo + 1024]))
        mx, my = np.zeros((len(x), 1024), np.float32), np.zeros((len(y), 1024), np.float32)
        for m, at, i in ((mx, at_x, ix), (my, at_y, iy)):
            has = number[i] >= 0
            m[at[has], number[i[has]]] = 1
        both += np.rint(mx @ my.T).astype(np.int64)
    order_x, order_y = np.argsort(ix, kind="stable"), np.argsort(iy, kind="stable")
    few = np.flatnonzero(~many)
    start_x, start_y = np.cumsum(cx) - cx, np.cumsum(cy) - cy
    flat = both.reshape(-1)
    made = np.cumsum(cx[few] * cy[few]) // (1 << 22)
    for part in np.split(few, np.flatnonzero(np.diff(made)) + 1) if len(few) else ():
        n_x, n_y = cx[part], cy[part]
        row = np.repeat(np.repeat(np.arange(len(part)), n_x), np.repeat(n_y, n_x))
        # every holder on one side with every holder on the other, token by token
        total = n_x * n_y
        begin = np.repeat(np.cumsum(total) - total, total)
        inside = np.arange(int(total.sum())) - begin
        i = at_x[order_x[start_x[part][row] + inside // n_y[row]]]
        j = at_y[order_y[start_y[part][row] + inside % n_y[row]]]
        flat += np.bincount(i * len(y) + j, minlength=len(flat))
    return 100 * both >= percent * (nx[:, None] + ny[None, :] - both)


def _in_cells(members: DataFrame, of: str) -> DataFrame:
    """Members (of: group, r, n, toks, ...) dealt to pairs of parts of their group: rows with g, large, u and v to group by.

    A group is cut into parts of about CELL classes and CELL_TOKENS tokens at most, and a row goes to each pair of parts
    that its own part (own) is in. Small groups share a task's call.
    """
    per = members.groupBy(of).agg(F.count("*").alias("c"), F.sum(F.size("toks")).alias("m"))
    parts = stored(per.select(of, "m", F.greatest(F.ceil(F.col("c") / CELL), F.ceil(F.col("m") / CELL_TOKENS), F.lit(1)).cast("int").alias("cells")))
    calls = max(1, (parts.agg(F.sum("m")).first()[0] or 0) // (CELL_TOKENS // 4))
    dealt = members.join(parts.drop("m"), of).withColumn("own", F.pmod(F.xxhash64("r"), F.col("cells")).cast("int"))
    call = F.when(F.col("cells") > 1, F.col(of)).otherwise(F.pmod(F.xxhash64(of), F.lit(calls)))
    each = dealt.withColumn("g", call).withColumn("large", F.col("cells") > 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return each.withColumns({"u": F.least("own", "other"), "v": F.greatest("own", "other")}).drop("cells", "other")


def _compared(table: pa.Table, of: str, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For each group of a call: the rows of its two parts (own = u and own = v), which of them are similar, and whether the parts are one."""
    group, own, n, u, v = (table.column(c).to_numpy() for c in (of, "own", "n", "u", "v"))
    toks = table.column("toks").combine_chunks()
    ends, flat = toks.offsets.to_numpy(), toks.values.to_numpy()
    order = np.argsort(group, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    sets = lambda at: [flat[ends[k] : ends[k + 1]] for k in at.tolist()]
    for rows in np.split(order, heads[1:]):
        x, y = rows[own[rows] == u[0]], rows[own[rows] == v[0]]
        if len(x) and len(y):
            found = linked(sets(x), sets(y), n[x].astype(np.int64), n[y].astype(np.int64), percent)
            if u[0] == v[0]:
                np.fill_diagonal(found, False)
            yield x, y, found, bool(u[0] == v[0])


def _table(rows: list[np.ndarray], names: list[str]) -> pa.Table:
    whole = np.concatenate(rows) if rows else np.zeros((0, len(names)), np.int64)
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(whole[:, k])) for k in range(len(names))], names)


def _across(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components between classes that share a long list, as few as join what they join.

    Lists that have classes in common are one group, so that a pair is compared once however many tokens it shares.
    """
    first = rows.groupBy("tok").agg(F.min("r").alias("b"))
    groups = connected(rows.select("tok", F.col("r").alias("a")).join(first, "tok").select("a", "b"))
    members = rows.select("r", "root").distinct().join(groups.select(F.col("node").alias("r"), F.col("root").alias("grp")), "r").join(classes.select("r", "n", "toks"), "r")

    def one(table: pa.Table) -> pa.Table:
        r, root = table.column("r").to_numpy(), table.column("root").to_numpy()
        out, above = [], {}

        def top(k: int) -> int:
            while above.get(k, k) != k:
                k = above[k]
            return k

        for x, y, found, _ in _compared(table, "grp", percent):
            found &= root[x][:, None] != root[y][None, :]
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                at = y[np.flatnonzero(found[i])]
                for k in at[np.unique(root[at], return_index=True)[1]].tolist():
                    p, q = top(int(root[x[i]])), top(int(root[k]))
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        out.append(np.array([sorted((int(r[x[i]]), int(r[k])))]))
        return _table(out, ["a", "b"])

    return _in_cells(members, "grp").groupBy("g", "large", "u", "v").applyInArrow(one, "a long, b long")


def links(classes: DataFrame, post: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes whose components are those of all similar pairs."""
    fields = ("i", "r", "n", "m", "alone", "b0", "b1", "b2", "b3")
    same, filters = F.col("x.tok") == F.col("y.tok"), _passes(percent)
    pair = (F.least("x.r", "y.r").alias("a"), F.greatest("x.r", "y.r").alias("b"))
    tried, found = None, None
    # what stands early in a document's order has few rarer tokens before it: such documents are central in their group
    for pivots in (1, PIVOTS):
        rows = post if found is None else _unjoined(post, found, 4 * PIVOTS)
        if found is not None and rows.isEmpty():
            break
        top = rows.groupBy("tok", F.pmod("r", F.lit(pivots)).alias("part")).agg(F.min(F.struct(*fields)).alias("p")).select("tok", "p.*")
        differ = F.col("x.r") != F.col("y.r")
        if found is not None:
            top = top.join(rows.select("tok", "r", "root"), ["tok", "r"])
            differ = F.col("x.root") != F.col("y.root")
        new = rows.alias("x").join(top.alias("y"), same & differ & filters).select(*pair).distinct()
        new = stored(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        good = _verified(new, classes, percent)
        tried = new if tried is None else tried.union(new)
        found = stored(good if found is None else found.union(good))
    rows = _unjoined(post, found, 0)
    light, long = rows.where(F.col("c") <= LIGHT), rows.where(F.col("c") > LIGHT)
    second = light.alias("x").join(light.alias("y"), same & (F.col("x.r") < F.col("y.r")) & (F.col("x.root") != F.col("y.root")) & filters).select(*pair).distinct()
    second = stored(second.join(tried, ["a", "b"], "left_anti"))
    found = found.union(_verified(second, classes, percent))
    return stored(found.union(_across(long, classes, percent)) if long.take(1) else found)


def count_links(classes: DataFrame, roots: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(r, l): documents of other classes that a class links with, for the classes of components (node, root); sizes: (r, size).

    A call makes a row for each class of the parts it compares, not for each link.
    """
    members = classes.select("r", "n", "toks").join(roots.withColumnRenamed("node", "r"), "r").join(sizes, "r")

    def one(table: pa.Table) -> pa.Table:
        r, size = table.column("r").to_numpy(), table.column("size").to_numpy().astype(np.float64)
        out = []
        for x, y, found, same in _compared(table, "root", percent):
            out.append(np.column_stack([r[x], np.rint(found @ size[y]).astype(np.int64)]))
            if not same:
                out.append(np.column_stack([r[y], np.rint(found.T @ size[x]).astype(np.int64)]))
        return _table(out, ["r", "l"])

    return _in_cells(members, "root").groupBy("g", "large", "u", "v").applyInArrow(one, "r long, l long").groupBy("r").agg(F.sum("l").alias("l"))


def components(docs: DataFrame, shingle: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text", count: bool = True) -> DataFrame:
    """One row per input row: key, n_shingles (size of its set), component_id (smallest key reachable by links) and, with count, n_links.

    threshold is the similarity in percent. n_links: the other documents that the row's text links with, exact copies
    included. Null text and text without words have an empty set, link with nothing and stand alone. Rows with a null key
    are no documents: they make no link, but get the component of equal sets; alone, their component_id is null. Repeated
    rows are one document. Columns beside key and text are not looked at. docs should be read from a table, so that a task
    that runs again finds its rows in the same order.
    """
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    survey = stored(_survey(d, shingle))
    rows = survey.where("n is not null").select("k", "r", "n")
    classes, post = _posted(d.where("k is not null"), rows.where("k is not null").select("r", "n").unionByName(survey.where("tok is not null").select("tok", "c"), allowMissingColumns=True), shingle, threshold)
    roots = stored(connected(links(classes, post, threshold)))
    owners = rows.where("n > 0 and k is not null").groupBy("r").agg(F.min("k").alias("owner"), *([F.count_distinct("k").alias("size")] if count else []))
    placed = owners.join(roots, owners["r"] == roots["node"], "left").withColumn("root", F.coalesce("root", "r")).drop("node")
    smallest = placed.groupBy("root").agg(F.min("owner").alias("smallest"))
    of_class = placed.join(smallest, "root").drop("root", "owner")
    if count:
        of_class = of_class.join(count_links(classes, roots, owners.select("r", "size"), threshold), "r", "left")
    out = rows.join(of_class, "r", "left")
    alone = F.col("n") == 0
    cols = [F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("k")).otherwise(F.col("smallest")).alias("component_id")]
    if count:
        copies = F.coalesce("size", F.lit(0)) - F.when(F.col("k").isNotNull(), 1).otherwise(0)
        cols.append(F.when(alone, 0).otherwise(F.coalesce("l", F.lit(0)) + copies).cast("long").alias("n_links"))
    return out.select(*cols)


def keep_one(docs: DataFrame, shingle: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of linked ones: the smallest key. Rows with a null key and empty ones stay."""
    placed = components(docs, shingle, threshold, key, text, count=False)
    extra = placed.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(extra, key, "left_anti")
