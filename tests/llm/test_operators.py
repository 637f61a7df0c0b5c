import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("jumpmark.llm")
from pyspark.sql import functions as F

from jumpmark.llm import bwt, decontaminate, language_id, license_rules, license_scan, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, token_counts, toxicity
from jumpmark.llm.common import table
from tests.llm.common_rows import ALNUM, SPACE, frame, low, rows, sha

DATA, PASSAGE = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DATA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def found(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_license_base(docs, none):
    out = license_scan.scan(docs)
    want = Counter()
    for i, t in DATA:
        w = ALNUM.findall(low(t))
        at, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            hit = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert found(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    got = {r["doc_id"]: r for r in out.where("n_detections > 0").collect()}
    assert set(got) == {15, 16} and "apache" in got[16]["labels"] and "public-domain" in got[16]["labels"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert license_scan.scan(none).count() == 0


NOTICES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": {"gpl", "gpl-or-later"},
    "Copyright (c) 1990 The Regents of the University of California. All rights reserved.": {"proprietary"},
    "Copyright 2019 " + "some holder of rights and its many heirs in all the lands, " * 4 + "all rights reserved": {"proprietary"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": {"apache", "apache-2.0"},
    "under the terms of the GNU Lesser General Public License version 3 or later": {"gpl", "lgpl", "lgpl-3"},
    "the Creative Commons Attribution NonCommercial License": {"cc-by-nc"},
    "https://creativecommons.org/licenses/by-sa/4.0/": {"cc-by-sa-4.0"},
    "SPDX-License-Identifier: ISC": {"isc"},
    "The Software shall be used for Good, not Evil.": {"json"},
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
    "Mozilla Public License 2.0": {"mpl-2.0"},
    "a plain sentence about the wild man in the domain of kings": set(),
}


def test_license_notices(spark):
    d = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    for i, want in enumerate(NOTICES.values()):
        assert want <= set(got[i]["labels"].split(",")) - {""} or not want and got[i]["labels"] == "", (got[i]["labels"], want)
        assert 0 <= got[i]["score"] <= 1
    assert got[6]["n_detections"] == 2  # a grant and a version; the plain forms inside them are suppressed


def brute_license(text, rules):
    """(labels, n_detections, best confidence): every rule at every anchor on the whole text."""
    w = ALNUM.findall(low(text))
    found = []
    for at, word in enumerate(w):
        marked = " ".join([*w[:at], "@" + word, *w[at + 1 :]])
        for i, r in enumerate(rules):
            m = re.search(r["regex"], marked) if word in r["anchors"] else None
            if m:
                m = m[0].lstrip(" ")
                start = at - m.split("@")[0].count(" ")
                number = re.search(r"[1-9](?: [0-9])?$", m) if r["version"] else None
                found.append((start, -(start + m.count(" ")), -r["priority"], i, r["label"] + ("-" + number[0].replace(" ", ".") if number else ""), r["confidence"]))
    found.sort()
    kept = [d for k, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:k])]
    return {d[4] for d in kept}, len(kept), max((d[5] for d in kept), default=0.0)


def test_license_brute(spark):
    """Labels and counts of random texts made of pieces of notices, rules looking at the whole text."""
    rng = random.Random(9)
    pieces = [w for t in NOTICES for w in (t, " ".join(t.split()[: rng.randint(2, 9)]))] + [r["pattern"].replace("@", "") for r in license_rules.rules()[:250] if not set("()[]?~") & set(r["pattern"])]
    texts = ["License", *(" ".join(rng.choice(pieces) if rng.random() < 0.6 else f"w{rng.randint(0, 99)} " * rng.randint(1, 60) for _ in range(rng.randint(1, 8))) for _ in range(60)), *(t for _, t in DATA)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in license_scan.scan(d).collect():
        labels, n, best = brute_license(texts[r["doc_id"]] or "", license_scan.RULES)
        base = set(r["base_labels"].split(",")) - {""}
        assert (set(r["labels"].split(",")) - {""}, r["n_detections"]) == (labels | base, n)
        assert abs(r["score"] - max(best, 0.6 if r["n_base"] else 0.0)) < 1e-9


def test_license_rules():
    rules = license_rules.rules()
    assert len(license_rules.HAND_WRITTEN.strip().splitlines()) >= 240
    for r in rules:
        assert r["pattern"].count("@") == 1 and r["keyword"] and r["anchors"], r
    assert license_rules.reach("a (?:b )?@c ~5 d") == (2, 7)
    assert sorted(license_rules.anchors("x @licen[cs]e y")) == ["licence", "license"] and license_rules.keyword("a (?:b )?@cd e? ~5 d") == "@cd "


def brute_quality(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    out = quality_rules.verdict(quality_rules.ledger(docs))
    want = Counter((i, *brute_quality(t)) for i, t in DATA)
    assert found(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])
    ab = {r["rule"]: r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    bits = [r["failed_bits"] for r in quality_rules.ledger(docs).collect()]
    for rule in quality_rules.RULES:
        b = quality_rules.bit(rule)
        assert ab[rule]["n_failed"] == sum(bool(x & b) for x in bits) and ab[rule]["n_failed_alone"] == sum(x == b for x in bits)
        assert ab[rule]["n_kept_without"] == sum(not x & ~b for x in bits)
    assert quality_rules.ledger(none).count() == 0


def test_interval_expansion():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab c") for _ in range(400))
    parts = [base[a : a + rng.randint(50, 76)] for a in (rng.randrange(320) for _ in range(150))]
    text = np.frombuffer(b"\xff" + b"\xff".join(parts) + b"\xff", np.uint8)
    for threshold in (20, 50):
        rank, cls = bwt.classes(text, threshold)
        t = text.tobytes()
        wins = {}
        for i in range(len(t) - threshold + 1):
            w = t[i : i + threshold]
            if b"\xff" not in w:
                wins.setdefault(w, set()).add(int(cls[rank[i]]))
        assert all(len(v) == 1 for v in wins.values()) and len({next(iter(v)) for v in wins.values()}) == len(wins)


def brute_repeats(data, length=50):
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))


def test_suffix_dedup(docs, none, monkeypatch):
    want = Counter(brute_repeats(DATA))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found(suffix_dedup.digest(docs), *cols) == want
    monkeypatch.setattr(suffix_dedup, "BLOCK", 10_000)  # many blocks
    assert found(suffix_dedup.digest(docs), *cols) == want
    for hot in (2, 6):  # nearly all shared keys are split, or some
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert found(suffix_dedup.digest(docs), *cols) == want
    assert suffix_dedup.digest(none).count() == 0


def test_suffix_dedup_string_keys(spark):
    data = [(None if i is None else f"id{i:05}", t) for i, t in DATA if i is not None or t is None]
    d = spark.createDataFrame(data, "doc_id string, text string").repartition(3)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found(suffix_dedup.digest(d), *cols) == Counter(brute_repeats(data))


def test_suffix_dedup_nothing_shared(spark):
    d = spark.createDataFrame([(i, f"{'abcdefgh'[i]}" * 200) for i in range(8)], "doc_id long, text string")
    assert found(suffix_dedup.digest(d), "n_removed") == Counter({(0,): 8})


def test_first_holders_compares_bytes():
    window = np.array([[1] * 50, [1] * 50, [2] * 50, [2] * 50], np.uint8)
    key = np.zeros(4, np.uint64)  # the first two differ from the last though their keys are equal
    assert suffix_dedup.first_holders(key, np.array([5, 7, 9, 4]), window).tolist() == [True, True, False, True]
    assert suffix_dedup.first_holders(np.array([1, 1, 2, 2], np.uint64), np.array([5, 7, 9, 4]), window).tolist() == [True, False, False, True]


def test_decontaminate(spark, docs, none):
    short = "gnu general public"
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[20:40])), (30, short), (4, None), (5, ""), (2, PASSAGE.upper()), (None, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = []
    for i, t in items:
        w = ALNUM.findall(low(t))
        if w and i is not None:
            m = min(10, len(w))
            wins += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1)]
    want = Counter()
    for i, t in DATA:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        grams = {m: {} for m in {len(x) for _, x in wins}}
        for m in grams:
            for k in range(len(w) - m + 1):
                grams[m].setdefault(tuple(w[k : k + m]), []).append(k)
        for item, win in wins:
            for k in grams[len(win)].get(win, []):
                hit |= set(range(k, k + len(win)))
                ids.add(str(item))
        want[(i, len(w), len(hit), ",".join(sorted(ids)))] += 1
    out = decontaminate.find(docs, bench).withColumn("ids", F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","))
    assert found(out, "doc_id", "n_words", "n_hit", "ids") == want
    assert found(decontaminate.find(docs, bench.limit(0)), "n_hit") == Counter({(0,): len(DATA)})
    assert decontaminate.find(none, bench).count() == 0
    bad = {k[0] for k, v in want.items() if k[2]}
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & bad
    cut = decontaminate.remove(docs.where("doc_id = 8"), bench, mode="span").first()["text"]
    assert not set(" ".join(PASSAGE.split()).split()) <= set(cut.split()) and len(cut) > 50


def brute_links(data, n, percent):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := SPACE.findall(low(t))) else frozenset() for i, t in data if i is not None}
    return {(i, sum(j != i and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets.items())) for i, a in sets.items()}


def brute_components(data, n, percent):
    def shingles(t):
        w = SPACE.findall(low(t))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in data if i is not None]
    root = {i: i for i, _ in sets}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((up(i), up(j)))
            root[y] = x
    return {(i, len(s), up(i)) for i, s in sets}


def test_ngram_links(spark, docs, monkeypatch):
    """Every link inside a group of near copies counts, not only those its component needs."""
    words = [f"w{i}" for i in range(200)]
    near = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)] + [(100, " ".join(words)), (101, " ".join(words))]
    for cell in (ngram_join.CELL, 16):  # in one block and in several
        monkeypatch.setattr(ngram_join, "CELL", cell)
        out = ngram_join.components(spark.createDataFrame(near, "doc_id long, text string"), 4, 85).collect()
        assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in out} == {(i, 0, 41) for i, _ in near}


def test_ngram_common_token(spark, monkeypatch):
    """A passage that very many otherwise different documents hold makes no candidates; long lists are paired in blocks."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(12))
    data = [(i, passage + " " + " ".join(f"v{rng.randrange(10**7)}" for _ in range(40))) for i in range(3000)]
    data += [(5000 + i, " ".join(rng.sample([f"s{j}" for j in range(9)], 4))) for i in range(600)]
    monkeypatch.setattr(ngram_join, "HOT", 500)
    monkeypatch.setattr(ngram_join, "HOT_LOCAL", 2)
    monkeypatch.setattr(ngram_join, "LIGHT", 2)
    monkeypatch.setattr(ngram_join, "CELL", 4)
    for n in (4, 1):
        few = data if n == 4 else data[3000:]
        out = ngram_join.components(spark.createDataFrame(few, "doc_id long, text string").repartition(5), n, 85)
        brute = brute_components(few if n == 1 else few[:50] + few[3000:], n, 85)
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()} >= brute


def test_linked():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(120)]
    extra = rng.integers(0, 4, 120)
    n = np.array([len(s) for s in sets]) + extra
    want = [[100 * len(np.intersect1d(a, b)) >= 60 * (n[i] + n[j] - len(np.intersect1d(a, b))) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (ngram_join.linked(sets, sets, n, n, 60) == np.array(want)).all()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, none, n, percent):
    out = ngram_join.components(docs, n, percent)
    assert out.count() == len(DATA)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.where("doc_id is not null").collect()}
    assert got == brute_components(DATA, n, percent)
    assert {(r["doc_id"], r["n_links"]) for r in out.where("doc_id is not null").collect()} == brute_links(DATA, n, percent)
    assert ngram_join.components(none, n, percent).count() == 0


def test_ngram_join_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        data.append((1000 - i, " ".join(w)))
    out = ngram_join.components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_components(data, 4, 85)
    kept = ngram_join.keep_one(spark.createDataFrame(data, "doc_id long, text string"), 4, 85)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(data, 4, 85)}


def brute_grams(text):
    """Buckets of a text's 2- and 3-grams, character by character."""
    low = f" {text.lower()} "
    code = [ord(c) if c.isalpha() else 32 for c in low]
    m, shift = 0xFFFFFFFF, 32 - language_id.BUCKETS.bit_length() + 1
    out = []
    for i in range(1, len(low) - 1):
        if low[i].isalpha():
            pair = (code[i] * 0x9E3779B1 & m) ^ (code[i + 1] * 0x85EBCA6B & m)
            trio = pair ^ (code[i - 1] * 0xC2B2AE35 & m)
            out += [((pair ^ pair >> 15) * 0x2C1B3C6D & m) >> shift, ((trio ^ trio >> 13) * 0x297A2D39 & m) >> shift]
    return out


def test_language_id_brute(spark, docs, monkeypatch):
    """Counts, probabilities and verdicts of a plain version, texts cut into pieces or not."""
    taught = [(i, t or "", None if n % 5 == 0 else "ab"[n % 2]) for n, (i, t) in enumerate(DATA)]
    grams = {"a": Counter(), "b": Counter()}
    n_docs = Counter()
    for (i, t, lang), (_, raw) in zip(taught, DATA, strict=True):
        if i is not None and lang and raw is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            grams[lang].update(brute_grams(t))
            n_docs[lang] += 1
    total = {x: sum(g.values()) + language_id.ALPHA * language_id.BUCKETS for x, g in grams.items()}
    want = {}
    for i, t, _ in taught:
        found = brute_grams(t)
        scores = {x: math.log(n_docs[x] / sum(n_docs.values())) + sum(math.log((g[k] + language_id.ALPHA) / total[x]) for k in found) for x, g in grams.items()}
        top = max(scores, key=lambda x: (scores[x], -ord(x)))
        want[i, t] = (top, 1 / sum(math.exp(s - scores[top]) for s in scores.values())) if found else ("und", 0.0)
    for piece in (language_id.PIECE, 97):
        monkeypatch.setattr(language_id, "PIECE", piece)
        model = language_id.train(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
        out = language_id.label(docs, model)
        assert out.columns == [*docs.columns, "_pred", "_score"]
        for r in out.collect():
            pred, score = want[r["doc_id"], r["text"] or ""]
            assert r["_pred"] == pred and abs(r["_score"] - score) < 1e-3


def test_language_id_long_text(spark):
    """Three million characters, with the cuts between pieces inside words."""
    text = "abcdefg hij " * 262_145
    assert len(text) > 3 << 20
    whole, cut = language_id._grams([f" {text} "])[0], language_id._grams(language_id._pieces([text])[0])[0]
    assert len(language_id._pieces([text])[0]) == 4 and (whole == cut).all()


def test_language_id(spark, docs, none):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.where("lang = lang_pred").count() / out.count()
    assert right > 0.95
    odd = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (11, "und"), (None, "und")} <= odd
    assert all(p in ("a", "b") for i, p in odd if i in (3, 5, 14, 17))
    assert language_id.identify(none).count() == 0
    no_lang = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert found(no_lang, "lang_pred", "score") == Counter({("und", 0.0): len(DATA)})


def brute_line_dedup(data):
    """The texts left, by plain sets and dictionaries."""
    L = line_dedup
    held = {}  # (leaf, tpl) -> documents; tokens and kind of each
    kind = {}
    for i, t in data:
        for line in (t or "").encode().split(b"\n") if i is not None and t is not None else ():
            ts = L.masked(line)
            if not ts:
                continue
            if (own := L.whole(line)) is not None:
                held.setdefault((own, own), set()).add(i)
                kind[own, own] = (True, len(ts) < L.MIN_TOKENS, None)
            if L.has_template(ts):
                at = (L.leaf_of(ts, L.DEPTH), L._hash(b" ".join(ts)))
                held.setdefault(at, set()).add(i)
                kind[at] = (L.FIELD not in ts, len(ts) < L.MIN_TOKENS, ts)
    leaves = {}
    for leaf, tpl in held:
        leaves.setdefault(leaf, []).append(tpl)
    first = {}
    for leaf, tpls in leaves.items():
        short = kind[leaf, tpls[0]][1]
        least = L.SHORT_DOCS if short else L.MIN_DOCS
        group = []
        if len(tpls) > 1 and sum(len(held[leaf, x]) for x in tpls) >= least:
            toks = {x: [xxhash.xxh32_intdigest(w) - (1 << 31) for w in kind[leaf, x][2]] for x in tpls}
            constant = {}
            for p in range(len(toks[tpls[0]])):
                votes = Counter()
                for x in tpls:
                    votes[toks[x][p]] += len(held[leaf, x])
                n, tok = max((n, tok) for tok, n in votes.items())
                if 2 * n >= sum(votes.values()):
                    constant[p] = tok
            group = [x for x in tpls if sum(constant.get(p) == w for p, w in enumerate(toks[x])) >= L.AGREE * len(toks[x])]
            docs = set().union(*(held[leaf, x] for x in group)) if group else set()
            if len(docs) < least:
                group = []
        for x in tpls:
            equal = kind[leaf, x][0]
            if x in group:
                first[x] = min(docs)
            elif len(held[leaf, x]) >= (L.EQUAL_DOCS if equal and not short else least):
                first[x] = min(held[leaf, x])
    for i, t in data:
        if i is None or t is None:
            yield i, t
            continue
        stay = []
        for line in t.encode().split(b"\n"):
            ts = L.masked(line)
            gone = ts and any(i > first.get(h, i) for h in (L.whole(line), L._hash(b" ".join(ts)) if L.has_template(ts) else None))
            if not gone:
                stay.append(line)
        yield i, b"\n".join(stay).decode()


def test_line_dedup_brute(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    data = list(DATA)
    for i in range(300, 420):
        lines = []
        for _ in range(rng.randint(0, 9)):
            n = rng.choice([1, 2, 4, 5, 6, 7])
            line = [words[min(4, int(rng.expovariate(1.2)))] for _ in range(n)]
            if rng.random() < 0.4:
                line[rng.randrange(n)] = str(rng.randint(0, 30))
            lines.append(" ".join(line))
        data.append((i, "\n".join(lines)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup(d).collect())
    want = Counter(brute_line_dedup(data))
    assert got == want and sum(t != u for (_, t), (_, u) in zip(data, brute_line_dedup(data), strict=True)) > 60


def test_line_dedup_counts_documents(spark):
    """A document with several variants of a line counts once; long leading groups are found all the same."""
    variants = [f"this line has the same words but {w} near its end" for w in ("one", "two", "three", "four")]
    d = spark.createDataFrame([(1, "\n".join(variants)), (2, "this line has the same words but five near its end")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"].count("\n") for r in line_dedup.dedup(d).collect()} == {1: 3, 2: 0}
    kept = line_dedup.dedup(spark.createDataFrame([(i, f"this line has the same words but {'abcdefghij'[i]} near its end") for i in range(10)], "doc_id long, text string"))
    assert sorted(r["text"] != "" for r in kept.collect()) == [False] * 9 + [True]


CLASH = "_drop _dk _n_lines _n_dropped _pred _score _i3 _spans3 _id _k _i2 _i4 _k4 at spans items p s e m win h tok r root shard bin q copy tpl first leaf equal short u v w x y a b own other".split()


def test_clashing_names(spark):
    """Columns named as the operators' own pass through."""
    data = [(i, f"the same long line stands here in all of them\nown words of document {'abcdefgh'[i]} only", "xy"[i % 2]) for i in range(8)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").select("*", *(F.lit(7).alias(c) for c in CLASH))
    bench = spark.createDataFrame([(1, "own words of document a only")], "item_id long, text string")
    sevens = lambda df: all(r[c] == 7 for r in df.collect() for c in CLASH)
    out = line_dedup.dedup(d)
    assert out.columns[:-2] == d.columns and sevens(out)
    out = language_id.label(d, language_id.train(d, F.lit(True)))
    assert out.columns[:-2] == d.columns and sevens(out)
    for mode in ("span", "document"):
        out = decontaminate.remove(d, bench, mode=mode)
        assert out.columns == d.columns and sevens(out) and out.count() == (8 if mode == "span" else 7)
    assert decontaminate.find(d, bench).count() == 8
    out = ngram_join.keep_one(d)
    assert out.columns == d.columns and sevens(out)
    assert packing.pack_documents(d).count() == 8 and suffix_dedup.digest(d).count() == 8 and quality_rules.ledger(d).count() == 8
    assert license_scan.scan(d).count() == 8


@pytest.mark.parametrize("wanted", [line_dedup.WANTED, -1])
def test_line_dedup(spark, docs, none, monkeypatch, wanted):
    monkeypatch.setattr(line_dedup, "WANTED", wanted)
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"] and out.count() == len(DATA)
    got = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    logs = [got[i]["_n_dropped"] for i in range(21, 29)]
    assert logs == [0] + [1] * 7  # one template with fields; its first document keeps the line
    assert got[14]["_n_dropped"] == 0 and got[0]["text"] is None and got[1]["text"] == ""
    assert got[13]["_n_dropped"] == 0  # repeated in one document only
    assert line_dedup.dedup(none).count() == 0
    lines = [(i, f"unique words {chr(97 + i % 26) * 3} {i} here\nthe same boiler plate line in every page\nend {i}") for i in range(10)]
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert "boiler" in cut[0] and all("boiler" not in cut[i] for i in range(1, 10))


def test_line_dedup_few_documents(spark):
    """Equal lines recur from two documents on, long and with fields too; one different word or field needs more of them."""
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = {1: [long, "the cat sat on a mat", "sold 7 of the last 9 chairs"], 2: [long, "the cat sat on a hat", "sold 8 of the last 9 chairs"], 3: ["own words stand in this line", "sold  8 of the last 9 chairs", long]}
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup(d).collect()}
    assert got == {1: texts[1], 2: texts[2][1:], 3: texts[3][:1]}


def test_line_dedup_short_lines(spark):
    """Short lines recur too, from ten documents on."""
    d = spark.createDataFrame([(i, "All rights reserved.\n\n" + ("Rarely seen\n" if i < 9 else "") + "own" * (i + 1)) for i in range(10)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(d).collect()}
    assert got[0] == "All rights reserved.\n\nRarely seen\nown"
    assert all(got[i] == "\n" + ("Rarely seen\n" if i < 9 else "") + "own" * (i + 1) for i in range(1, 10))


def test_line_dedup_keeps_lines_of_fields(spark):
    """Rows of numbers, dates and ids differ unless they are equal, however many documents hold such rows."""
    rows_of = {i: [" ".join(str(i * 100 + j * 10 + c) for c in range(6)) for j in range(3)] + [f"2020-01-{i:02} id{i} x 5 6 7"] for i in range(12)}
    d = spark.createDataFrame([(i, "\n".join([*r, "1 2 3 4 5 6"])) for i, r in rows_of.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup(d).collect()}
    assert got == {i: [*r, "1 2 3 4 5 6"] if i == 0 else r for i, r in rows_of.items()}


def brute_chain(texts, fold, y):
    """The chain in plain loops: (probabilities, verdicts) of the training texts."""
    T = toxicity
    sets = [set(ALNUM.findall(low(t))) for t in texts]

    def choose(rows, k):
        n, best = len(rows), []
        count = Counter(w for i in rows for w in sets[i])
        for w, c in count.items():
            if c >= 2:
                m, hit = y[rows, k].sum(), sum(y[i, k] for i in rows if w in sets[i])
                score = (hit * n - c * m) ** 2 / (c * (n - c + 1.0) * max(1.0, m * (n - m)))
                best.append((-score, w.encode()))
        return [w.decode() for _, w in sorted(best)[: T.FEATURES]]

    x = lambda rows, words: np.array([[w in sets[i] for w in words] for i in rows], dtype=float).reshape(len(rows), len(words))
    rows = list(range(len(texts)))
    earlier, ps = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    for k in range(y.shape[1]):
        out = np.zeros(len(texts))
        for f in range(T.FOLDS):
            rest, held = [i for i in rows if fold[i] != f], [i for i in rows if fold[i] == f]
            if held:
                words = choose(rest, k)
                w = T.fit_linear(np.column_stack([x(rest, words), earlier[rest]]), y[rest, k])
                out[held] = T._apply(np.column_stack([x(held, words), earlier[held]]), w)
        words = choose(rows, k)
        w = T.fit_linear(np.column_stack([x(rows, words), earlier]), y[:, k])
        ps = np.column_stack([ps, T._apply(np.column_stack([x(rows, words), ps]), w)])
        threshold = T._threshold(out, y[:, k])
        earlier = np.column_stack([earlier, out])
    return ps, ps[:, -1] >= threshold


def test_toxicity_brute(spark, monkeypatch):
    """Words chosen and models fitted outside each fold, the verdict by the chain's last link."""
    monkeypatch.setattr(toxicity, "FEATURES", 12)
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        w = [f"w{rng.randrange(40)}" for _ in range(20)] + (["vile", "awful"][: rng.randint(1, 2)] if toxic else []) + ["long" * 300]
        texts.append(" ".join(w))
        labels.append((i, int(rng.random() < (0.3 if toxic else 0.8)), int(toxic)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(d.union(d), lab, features=12)  # a repeated row teaches once
    got = toxicity.classify(d, chain).orderBy("doc_id").collect()
    fold = {r[0]: r[1] for r in d.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))).collect()}
    y = np.array([[q == 0, q == 0 and t == 1, t == 1] for _, q, t in labels], dtype=float)
    ps, verdict = brute_chain(texts, [fold[i] for i in range(160)], y)
    assert np.abs(np.array([[r["p_low_quality"], r["p_severe"], r["p_toxic"]] for r in got]) - ps).max() < 1e-4
    assert [r["toxic_pred"] for r in got] == verdict.tolist()


def test_toxicity(spark, docs, none):
    d, lab = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = F.col("doc_id") % 3 == 0
    chain = toxicity.train(d, lab.where(~held))
    out = toxicity.classify(d, chain).join(lab.where(held), "doc_id").select((F.col("toxic") == 1).alias("y"), "toxic_pred").collect()
    hit = sum(r["y"] and r["toxic_pred"] for r in out)
    assert hit / sum(r["y"] for r in out) > 0.9 and hit / max(1, sum(r["toxic_pred"] for r in out)) > 0.9
    none_lab = lab.limit(0)
    assert toxicity.train(docs, none_lab) is None
    assert found(toxicity.classify(docs, None), "toxic_pred") == Counter({(False,): len(DATA)})
    odd = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, None, 0), (None, 1, 1), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, toxicity.train(docs, odd)).count() == len(DATA)
    assert toxicity.classify(none, chain).count() == 0


def test_linear_model():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 5)).astype(float)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    p = toxicity._apply(x, toxicity.fit_linear(x, y))
    assert ((p > 0.5) == y).mean() > 0.99
    assert np.isfinite(toxicity.fit_linear(x, np.zeros(2000))).all()


def test_packing(docs, none):
    out = [r.asDict() for r in packing.pack_documents(docs, shard_rows=10).collect()]
    lengths = Counter()
    for i, t in DATA:
        lengths[(i, len(SPACE.findall(t or "")))] += 1
    assert sum(r["n_tokens"] for r in out) == sum(n * k for (_, n), k in lengths.items())
    bins = {}
    for r in out:
        assert (r["bin"] is None) == (r["n_tokens"] == 0)
        if r["n_tokens"]:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["n_tokens"]
        cap = parts[0]["capacity"]
        assert at == parts[0]["bin_used"] and cap == min(c for c in packing.CAPACITIES if c >= at)
    assert packing.pack_documents(none).count() == 0


def cost_of(packed):
    return sum(map(packing.bin_cost, packed[2]))


def test_pack_is_best_fit():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 4096) for _ in range(500)), reverse=True)
    bins, offsets, sizes = packing.pack(lengths)
    room, remaining = {}, packing.Remaining(lengths)
    for n, b in zip(lengths, bins, strict=True):
        remaining.take(n)
        fits = [r for r in room.values() if r >= n]
        if fits:
            assert room[b] == min(fits)
        else:
            assert b not in room
            room[b] = packing.open_size(n, remaining, packing.CAPACITIES, packing.OVERHEAD)
        room[b] -= n
    assert sum(sizes) < 1.2 * sum(lengths)


def test_pack_mixes_sizes():
    """Several sizes are opened, for less than the largest one alone costs, and small inputs come near the optimum."""
    rng = random.Random(3)
    lengths = sorted((int(min(4096, rng.lognormvariate(6, 1))) or 1 for _ in range(3000)), reverse=True)
    joint, single = packing.pack(lengths), packing.pack(lengths, joint=False)
    assert len(set(joint[2])) >= 3 and min(joint[2].count(c) for c in set(joint[2])) > 20
    assert cost_of(packing.pack_best(lengths)) <= min(cost_of(joint), cost_of(single))
    assert cost_of(joint) < cost_of(single)

    def optimum(items):
        best = [float("inf")]

        def place(k, loads):
            low = sum(packing.bin_cost(packing.smallest(packing.CAPACITIES, u)) for u in loads)
            if low >= best[0]:
                return
            if k == len(items):
                best[0] = low
                return
            for b in range(len(loads)):
                if loads[b] + items[k] <= packing.CAPACITIES[-1]:
                    place(k + 1, [*loads[:b], loads[b] + items[k], *loads[b + 1 :]])
            place(k + 1, [*loads, items[k]])

        place(0, [])
        return best[0]

    for _ in range(30):
        items = sorted((rng.randint(1, 3000) for _ in range(7)), reverse=True)
        assert cost_of(packing.pack_best(items)) <= 1.35 * optimum(items)


def test_packing_spreads_equal_rows(spark):
    d = spark.createDataFrame([(1, "a b c")] * 4000, "doc_id long, text string")
    per = [r["n"] for r in packing.pack_documents(d, shard_rows=500).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 8 and max(per) < 700 and sum(per) == 4000


def test_token_counts(docs, none):
    ranks = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
    count, tokenizer = token_counts.counter(ranks), token_counts.Tokenizer(ranks)
    rng = random.Random(11)
    for text in [t or "" for _, t in DATA if len(t or "") < 5000] + ["don't stop  now\n\n ok a b c d" * 80]:
        doc = token_counts.CountedText(text, tokenizer)
        assert doc.total == count(text)
        for _ in range(40):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 3, 40])
            new = rng.choice(["", " ", "x", " new words here", "'s", "\n", "  \n ", "many words " * 40])
            a2, b2 = min(a, len(text)), min(b, len(text))
            text = text[:a2] + new + text[b2:]
            doc.edit(a, b, new)
            assert doc.text == text and doc.total == count(text)
    out = token_counts.count_edits(docs, ranks)
    want = Counter()
    for i, t in DATA:
        t = t or ""
        e = t
        for a, b, new in token_counts.standard_edits(t):
            e = e[:a] + new + e[b:]
        want[(i, count(t), count(e))] += 1
    assert found(out, "doc_id", "n_tokens", "n_tokens_edited") == want
    assert token_counts.count_edits(none, ranks).count() == 0


def test_token_counts_edit_is_local():
    """An edit of a long text encodes a few characters; a word of a million characters is one pre-token."""
    ranks = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
    tokenizer = token_counts.Tokenizer(ranks)
    text = "some plain words stand here, 12 of them. " * 20_000
    doc = token_counts.CountedText(text, tokenizer)
    for k in range(50):
        doc.edit(k * 16_000 + 7, k * 16_000 + 9, "xy z")
        text = text[: k * 16_000 + 7] + "xy z" + text[k * 16_000 + 9 :]
    assert doc.encoded < 50 * 60 and doc.text == text and doc.total == tokenizer.whole(text)
    doc = token_counts.CountedText("ab " + "c" * 30_000 + " de", tokenizer)
    doc.edit(100, 101, " ")
    assert doc.total == tokenizer.whole(doc.text)


def test_token_trees_are_kept(spark, docs):
    ranks = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
    kept = token_counts.trees(docs, ranks)
    count = token_counts.counter(ranks)
    assert found(kept, "doc_id", "n_tokens") == Counter((i, count(t or "")) for i, t in DATA)
    again = token_counts.trees(kept, ranks, token_counts.standard_edits)
    assert found(again, "doc_id", "n_tokens") == found(token_counts.count_edits(docs, ranks).withColumnRenamed("n_tokens", "old").withColumnRenamed("n_tokens_edited", "n_tokens"), "doc_id", "n_tokens")
    assert all(sum(r["leaf_chars"]) == len(r["text"]) and sum(r["leaf_tokens"]) == r["n_tokens"] for r in again.collect())


def test_decontaminate_final_sigma(spark):
    text = " ".join(f"ΑΣ{i}ΣΑΣ" if i % 2 else "ΛΟΓΟΣ" for i in range(10))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text.replace(" ", "'") + "'Β y"), (2, text.replace("ΛΟΓΟΣ", "ΛΟΓΟς"))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.find(docs, bench).collect()} == {1: 10, 2: 0}
