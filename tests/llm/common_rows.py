"""Awkward documents, and plain Python versions of what the operators must give."""

import hashlib
import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, h long, n int, r long, words string, spans string, _w string"


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    a, b, passage = say(120), say(90), say(60)
    near = a.split(" ")
    near[50] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "One two three.", a, a, " ".join(near), b + "\n" + passage, passage + " " + say(80), say(100) + "\n" + passage + "\n" + say(30),
        "1234 !!! ###", "x " * 300, "same line here for all\n" * 5 + say(60), say(20_000), "MIT License. Apache License, the GNU General Public License v3 mit license",
        "Released under the terms of the Apache License 2 0 and put into the public domain", "É" * 70, "a" * 200, say(55) + "\x00 nul   sep", b.upper(),
    ]
    texts += [f"Log entry number {i} from host {i * 7} was written today\n" + say(40) for i in range(8)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(5, a), (100, a), (None, a), (None, None), (None, say(70))]
    return out, passage


def frame(spark, data):
    full = [(i, t, None if n % 5 == 0 else "ab"[n % 2], None, None, n, "t", n, 1, 2, "w", None, "x") for n, (i, t) in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()
