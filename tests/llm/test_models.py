"""Language identification and toxicity: definitions, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tarn.llm import langid, toxicity
from tarn.llm.common import held_out, text_parts


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out(documents):
    docs = documents([(k, "x") for k in range(50)] + [(None, "x")])
    assert {r.doc_id: r.h for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()} == {**{k: held(k) for k in range(50)}, None: False}


def _chunk(text):
    import pyarrow as pa

    return next(text_parts(pa.array([text] if isinstance(text, str) else text, pa.string())))[2:]


def test_grams_cover_letters_and_gaps():
    keys, first, n = langid.row_grams(*_chunk(["Ab, c", "", "😀", "é"]))
    chars = lambda k: tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0))
    c = ord
    assert [chars(k) for k in keys[first[0] : first[1]]] == [(0, 0, 0, c("a")), (0, 0, c("a"), c("b")), (0, c("a"), c("b"), 0), (c("a"), c("b"), 0, c("c")), (c("b"), 0, c("c"), 0)]
    assert n.tolist() == [3, 0, 0, 1]


def test_kneser_ney_sums_to_one_and_matches_the_definition():
    keys, _, _ = langid.row_grams(*_chunk(["banana bandana cabana an band", "abba cab"]))
    keys, counts = np.unique(keys, return_counts=True)
    model = langid.Smoothed(keys, counts.astype(float))
    alphabet = sorted({int(k) & 0xFFFF for k in keys})
    for context in {int(k) >> 16 for k in keys}:
        seen = sum(float(model.probability(np.array([context << 16 | a], np.uint64), 4)[0]) for a in alphabet)
        assert seen == pytest.approx(1 - _unseen(model, context), abs=1e-9)
    # the definition, with dictionaries
    count = dict(zip(keys.tolist(), counts.tolist(), strict=True))

    def p(gram, order, c):
        if not order:
            return model.uniform
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        context = gram >> 16
        total = sum(v for g, v in c.items() if g >> 16 == context)
        kinds = sum(g >> 16 == context for g in c)
        lower = Counter(g & ((1 << 16 * (order - 1)) - 1) for g in c)
        rest = p(gram & ((1 << 16 * (order - 1)) - 1), order - 1, lower)
        return max(c.get(gram, 0) - d, 0) / total + d * kinds / total * rest if total else rest

    for g in [*keys.tolist()[:10], keys.tolist()[0] ^ 1, 12345]:
        assert float(model.probability(np.array([g], np.uint64), 4)[0]) == pytest.approx(p(g, 4, count))


def _unseen(model, context):
    """What the uniform part leaves for the one unknown character."""
    out = 1.0
    for order in range(4, 0, -1):
        out *= float(model.gamma(np.array([context], np.uint64), order)[0])
        context &= (1 << 16 * max(order - 2, 0)) - 1
    return out * model.uniform


def _languages(n=240):
    rng = random.Random(3)
    parts = {"xx": ["tha", "ing", "er", "wo", "st"], "yy": ["cho", "ñar", "que", "ado", "él"], "zz": ["sch", "ung", "ich", "über", "keit"]}
    out = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        out.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_language_id(documents):
    rows = _languages()
    lang = {i: x for i, _, x in rows}
    docs = documents([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "123 !? 😀"), (None, rows[0][1])], lambda i, t: lang.get(i))
    models = langid.train(docs)
    assert models.langs == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in langid.identify(docs, models).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows if held(i)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[k].lang_pred, got[k].score, got[k].accepted) for k in (900, 901, 902)] == [("und", 0.0, False)] * 3
    odd = documents([(1, "zzyzx qqq wvw xkcd " * 20)])
    assert not langid.identify(odd, models).first().accepted


def test_language_models_hold_every_gram(documents):
    """More grams than were once kept: those seen once and twice, which the discount rests on, are all there."""
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x4E00, 0x9F00)]
    rows = [(i, "".join(rng.choices(letters, k=10_000))) for i in range(48)]
    learned = [t for i, t in rows if not held(i)]
    keys = np.concatenate([langid.row_grams(*_chunk(t))[0] for t in [*learned, learned[0]]])
    keys, counts = np.unique(keys, return_counts=True)
    assert len(keys) > 1 << 18
    models = langid.train(documents([*rows, next((100 + k, learned[0]) for k in range(9) if not held(100 + k))], lambda i, t: "zh"))
    assert sorted(models.grams[4].keys.tolist()) == keys.tolist()
    want = langid.Smoothed(keys, counts.astype(float)).probability(models.grams[4].keys, 4)
    assert np.allclose(models.probabilities[4][:, 0], want)


def test_language_id_learns_from_the_right_rows(documents):
    """Held-out labels and inputs other than text make no difference."""
    rows = _languages(90)
    lang = {i: x for i, _, x in rows}
    a = documents([(i, t) for i, t, _ in rows], lambda i, t: lang[i])
    b = documents([(i, t) for i, t, _ in rows], lambda i, t: "ww" if held(i) else lang[i])
    pick = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d, langid.train(d)).collect())
    assert pick(a) == pick(b)


def test_language_limits_come_from_every_document(documents):
    """Limits against all documents that may teach, of more than were once sampled."""
    rows = _languages(5400)
    rows = [(i, " ".join(t.split()[: 1 + i % 9]), x) for i, t, x in rows]
    lang = {i: x for i, _, x in rows}
    models = langid.train(documents([(i, t) for i, t, _ in rows], lambda i, t: lang[i]))
    for k, x in enumerate(models.langs):
        own = np.array([-models.score(*_chunk(t))[0][0, k] for i, t, y in rows if y == x and not held(i)])
        assert len(own) > 1000
        assert abs(models.limits[k] - np.quantile(own, 0.995, method="inverted_cdf") - own.std()) < 2 / langid.ENTROPY_PARTS


def test_language_id_of_nothing(documents):
    empty = documents([]).limit(0)
    models = langid.train(empty)
    assert langid.identify(empty, models).collect() == []
    assert langid.identify(documents([(1, "abc")]), models).first()[:3] == (1, "und", 0.0)


def _toxic(n=1200):
    rng = random.Random(9)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}x" for k in range(100)]
    out = []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(5, 60))
        # an insult beside a group is toxic, either alone is not
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        body += ["Dumbword"] * insult + ["Somegroup"] * group
        rng.shuffle(body)
        out.append((i, " ".join(body), int(insult and group)))
    return out


def test_toxicity_learns_interactions(spark, documents):
    rows = _toxic()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, 1), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents([(i, t) for i, t, _ in rows] + [(6000, None), (6001, ""), (None, "Dumbword Somegroup")])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    test = [(got[i].score, y) for i, _, y in rows if held(i)]
    assert all(got[i].held_out == held(i) for i, _, _ in rows)
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.95
    assert got[6000].score == got[6001].score < 0.5 and got[None].score > 0.5
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_learns_pairs_of_terms_that_tell_nothing_alone(spark, documents):
    """Toxic if both of two words stand in a text or neither does: each word alone goes with either label as often."""
    rng = random.Random(11)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}x" for k in range(100)]
    rows = []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        body = rng.choices(words, k=8) + ["Alphaword"] * a + ["Bravoword"] * b
        rng.shuffle(body)
        rows.append((i, " ".join(body), int(a == b)))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(documents([(i, t) for i, t, _ in rows]), labels).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if held(i)]) > 0.9


def test_toxicity_ignores_held_out_labels(spark, documents):
    rows = _toxic(200)
    docs = documents([(i, t) for i, t, _ in rows])
    a, b = (spark.createDataFrame([(i, 1, (1 - y if flip and held(i) else y)) for i, _, y in rows], "doc_id long, quality int, toxic int") for flip in (False, True))
    pick = lambda x: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect())
    assert pick(a) == pick(b)


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(documents([]).limit(0), none).collect() == []
    r = toxicity.toxicity(documents([(1, "x")]), none).first()
    assert 0 < r.score < 0.01 and r.predicted == 0


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    data, offsets = _chunk(["alpha beta gamma", "alpha", ""])
    rows, hashed = toxicity.terms(data, offsets)
    table = toxicity.SortedHashes(np.unique(hashed)[::2])
    m = toxicity.Model(table, rng.normal(size=len(table)), rng.normal(size=(len(table), 4)), 0.3)
    for r, s in enumerate(m.score(data, offsets)):
        at = sorted({int(k) for k in table.find(hashed[rows == r]) if k >= 0})
        logit = 0.3 + sum(m.weights[k] for k in at) + sum(m.factors[a] @ m.factors[b] for a, b in combinations(at, 2))
        assert s == pytest.approx(1 / (1 + math.exp(-logit)))
