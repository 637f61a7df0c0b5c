"""Edit-aware token counts.

A document's leaves are its pre-tokens, each with its characters and its tokens; a segment tree holds the sums of both, so
that a place in the text is found, and the count corrected, on one path between a leaf and the root. An edit cuts the text
into pre-tokens again from the last one that could not have seen the edit, up to where a new boundary falls on an old one:
from there on the pre-tokens are the old ones. Only these are encoded again. They take the place of the first leaf that went;
the others stay empty until half of all are, or one leaf holds many: then the tree is built anew from the counts it has.

The tokenizer is a byte-level BPE given as ranks and a pattern. The pattern's matches must not depend on what stands before
them, and see at most two characters behind them, as those of the public byte-level vocabularies.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.text_bytes import slices

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind a pre-token that its match may look at.
AHEAD = 2
#: Pre-tokens of one leaf from which on a tree is built anew, and pre-tokens whose counts a worker remembers at most.
WIDE, REMEMBERED = 64, 1 << 20


@lru_cache(2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def counter(ranks: bytes, pattern: str = PATTERN) -> Callable[[str], int]:
    """Tokens of a whole text."""
    encoder = _encoder(ranks, pattern)
    return lambda t: len(encoder.encode_ordinary(t))


class Tokenizer:
    """Cuts text into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.match = regex.compile(pattern).match
        self.all = regex.compile(pattern).findall
        self.whole = counter(ranks, pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = known[p] = self.whole(p)
            out.append(n)
        return out


class SegmentTree:
    """Pairs of sums (characters, tokens) over leaves; a leaf's change updates its path to the root only."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, values: list[int]) -> list[int]:
        row = np.zeros(self.n, np.int64)
        row[: len(values)] = values
        rows = [row]
        while len(row) > 1:
            row = row[::2] + row[1::2]
            rows.append(row)
        return [0, *np.concatenate(rows[::-1]).tolist()]

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.n + leaf
        more, dearer = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += dearer
            i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place of the text, and where the leaf starts."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if place >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.n, start


class CountedText:
    """A text with its token count, kept right under edits. A leaf is a pre-token or, where an edit was, a list of them."""

    def __init__(self, text: str, tokenizer: Tokenizer, chars: list[int] | None = None, tokens: list[int] | None = None):
        """chars and tokens: of the leaves, where they are known from before."""
        self.tokenizer = tokenizer
        if chars is None:
            self._build(tokenizer.all(text))
        else:
            ends = np.cumsum(chars).tolist()
            self._build([text[e - n : e] for e, n in zip(ends, chars, strict=True)], tokens)
        self.encoded = 0  # characters that edits made it cut and count again

    def _build(self, parts: list[str], tokens: list[int] | None = None) -> None:
        self.leaves: list[str | list[str]] = parts
        self.worn = 0  # leaves emptied since
        self.tree = SegmentTree([len(p) for p in parts], self.tokenizer.counts(parts) if tokens is None else tokens)

    @property
    def total(self) -> int:
        return self.tree.tokens[1]

    @property
    def length(self) -> int:
        return self.tree.chars[1]

    def parts(self) -> list[str]:
        return [p for leaf in self.leaves for p in ([leaf] if isinstance(leaf, str) else leaf) if p]

    @property
    def text(self) -> str:
        return "".join(self.parts())

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end (clipped to the text) with new."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        if not self.length:
            self._build(self.tokenizer.all(new))
            self.encoded += len(new)
            return
        # leaves that end AHEAD characters before the edit cannot have seen it
        first, begin = self.tree.find(min(max(0, start - AHEAD), self.length - 1))
        last, region = first - 1, ""
        while begin + len(region) < end or last < first:
            last += 1
            region += self._leaf(last)
        region = region[: start - begin] + new + region[end - begin :]
        parts, at, step, old_ends = [], 0, 1, {len(region): last}  # ends of old leaves behind the edit, as places in the region
        while True:
            more = last + 1 < len(self.leaves)
            while at < len(region):
                m = self.tokenizer.match(region, at)
                if more and m.end() + AHEAD > len(region):
                    break  # it might go on
                parts.append(m.group())
                at = m.end()
                if at in old_ends:
                    return self._replace(first, old_ends[at], parts)
            if not more:
                return self._replace(first, last, parts)
            for last in range(last + 1, min(last + step, len(self.leaves) - 1) + 1):
                region += self._leaf(last)
                old_ends[len(region)] = last
            step *= 2

    def _leaf(self, i: int) -> str:
        leaf = self.leaves[i]
        return leaf if isinstance(leaf, str) else "".join(leaf)

    def _replace(self, first: int, last: int, parts: list[str]) -> None:
        size = sum(map(len, parts))
        self.encoded += size
        self.leaves[first] = parts
        self.tree.set(first, size, sum(self.tokenizer.counts(parts)))
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self.leaves[i] = ""
                self.tree.set(i, 0, 0)
        self.worn += last - first
        if len(parts) > WIDE or 2 * self.worn > len(self.leaves):
            self._build(self.parts())


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits the query makes on a text, last place first: a closing line break, a masked middle word, no first line."""
    out = [(len(text), len(text), "\n")]
    a = text.find(" ", len(text) // 2)
    b = text.find(" ", a + 1)
    first = text.find("\n")
    if a >= 0 and b >= 0 and a + 1 > first + 1:
        out.append((a + 1, b, "[MASKED]"))
    if first >= 0:
        out.append((0, first + 1, ""))
    return out


def count_edits(docs: DataFrame, ranks: bytes, edits: Callable[[str], list[tuple[int, int, str]]] = standard_edits, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, n_tokens, n_leaves, n_edits, n_tokens_edited, n_chars_reencoded for each row.

    Null text counts as empty: no tokens and no leaves, though edits may add some. Repeated rows give repeated results.
    ranks is the vocabulary's content, which goes with the tasks (its size is that of the file). Columns beside key and text
    are not looked at.
    """
    key_type = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(sent.value, pattern)
        for b in slices(batches, "t"):
            rows = []
            for t in b.column("t").to_pylist():
                t = t or ""
                doc = CountedText(t, tokenizer)
                made, before, n = edits(t), doc.total, len(doc.leaves)
                for e in made:
                    doc.edit(*e)
                rows.append((len(t), before, n, len(made), doc.total, doc.encoded))
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["k", "n_chars", "n_tokens", "n_leaves", "n_edits", "n_tokens_edited", "n_chars_reencoded"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {key_type}, n_chars long, n_tokens long, n_leaves long, n_edits long, n_tokens_edited long, n_chars_reencoded long")
    return out.withColumnRenamed("k", key)


def trees(docs: DataFrame, ranks: bytes, edits: Callable[[str], list[tuple[int, int, str]]] | None = None, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, leaf_chars, leaf_tokens, n_tokens, n_chars_reencoded: each document's leaves, to be kept beside it.

    Where docs has leaf_chars and leaf_tokens already (of its texts), they are taken from there and only what the edits touch is
    encoded. The text is the edited one. Null text is empty.
    """
    known = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    key_type = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["k", "t", "leaf_chars", "leaf_tokens", "n_tokens", "n_chars_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(sent.value, pattern)
        for b in slices(batches, "t"):
            rows = []
            kept = [b.column(c).to_pylist() if known else [None] * b.num_rows for c in ("leaf_chars", "leaf_tokens")]
            for t, chars, tokens in zip(b.column("t").to_pylist(), *kept, strict=True):
                doc = CountedText(t or "", tokenizer, chars, tokens)
                for e in edits(t or "") if edits else ():
                    doc.edit(*e)
                parts = doc.parts()
                rows.append(("".join(parts), [len(p) for p in parts], tokenizer.counts(parts), doc.total, doc.encoded))
            t, chars, tokens, total, encoded = zip(*rows, strict=True)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(t, pa.string()), pa.array(chars, ints), pa.array(tokens, ints), pa.array(total, pa.int64()), pa.array(encoded, pa.int64())], names)

    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(["leaf_chars", "leaf_tokens"] if known else []))
    out = some.mapInArrow(run, f"k {key_type}, t string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_chars_reencoded long")
    return out.withColumnsRenamed({"k": key, "t": text})
