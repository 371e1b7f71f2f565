from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, score string, spans string, at int, fp string"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables with extra columns whose names clash with the operators' own."""

    def make(pairs, lang=None):
        return spark.createDataFrame([(i, t, lang(i, t) if callable(lang) else lang, "s", len(t or ""), "r", "s", "p", 1, "f") for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, other = words(70), words(55)
    out = []
    for i in range(60):
        body = words(rng.randint(0, 160))
        if i % 4 == 0:
            body = words(rng.randint(0, 30)) + passage[rng.randint(0, 5) :] + words(rng.randint(0, 30))
        if i % 7 == 0:
            body += other
        out.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(body)))
    out += [(100 + k, out[4][1]) for k in range(5)]
    out += [(110, None), (111, ""), (112, "  \n "), (113, "one"), (114, " ".join(words(3000) + passage)), (None, out[8][1]), (None, None)]
    out += [out[3], out[3], (60, out[4][1] + " x")]
    rng.shuffle(out)
    return out
