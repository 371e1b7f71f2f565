"""Super-k-mers, sparse suffix arrays and decontamination against their definitions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tarn.llm import decontam, minimisers, suffixes, superkmer
from tarn.llm.common import LOWER, PLAIN, SPACED, SortedHashes, Words, merged, text_parts


def key(x):
    return sorted(x, key=repr)


@pytest.mark.parametrize("most", [1 << 9, 2])
@pytest.mark.parametrize("kind", ["kmers", "suffixes"])
def test_repeats_are_exact(documents, corpus, kind, most):
    """Also with most keys crowded, so that their buckets are in many parts."""
    docs = documents(corpus)
    for window, seed in ((50, 8), (12, 4)):
        want = superkmer.brute_force(corpus, window)
        if kind == "kmers":
            got = superkmer.substring_dedup(docs, window, seed, 16, most).select("doc_id", "n_words", "n_removed", "kept").collect()
        else:
            got = suffixes.repeated_passages(docs, window, seed, 16, most).select("doc_id", "n_words", "n_repeated", "kept").collect()
        assert key((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in got) == key(want)
        assert any(r[2] for r in want)


def test_no_documents(documents):
    empty = documents([]).limit(0)
    assert superkmer.substring_dedup(empty).collect() == suffixes.repeated_passages(empty, bits=16).collect() == []


def test_a_full_map_changes_nothing(documents, corpus):
    a, b = (superkmer.substring_dedup(documents(corpus), bits=n).select("doc_id", "n_removed", "kept").collect() for n in (16, 3))
    assert key(map(tuple, a)) == key(map(tuple, b))


def test_minima_are_leftmost():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 43):
        v = rng.integers(0, 9, 200).astype(np.uint64)
        assert minimisers.leftmost_minima(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(200 - width + 1)]


def test_words_match_the_patterns():
    texts = ["", " a  b\n", "ÄÖ über-x9 _z", "a", None, "x y \x0b\x1cz", "日本 語"]
    import pyarrow as pa

    for table, fold, pattern in ((SPACED, None, r"[^\x20\x09-\x0D]+"), (PLAIN, LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        (part,) = text_parts(pa.array(texts, pa.string()))
        words = Words(part[2], part[3], table, fold)
        raw = part[2].tobytes()
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold is not None else t
        for r, t in enumerate(texts):
            own = [low(raw[words.starts[k] : words.ends[k]].decode()) for k in range(words.first[r], words.first[r + 1])]
            assert own == re.findall(pattern, low(t or ""))
    one = Words(*next(iter(text_parts(pa.array(["the The cat the"], pa.string()))))[2:], PLAIN, LOWER).hashes
    assert one[0] == one[1] == one[3] != one[2]


def test_sorted_hashes():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    table = SortedHashes(keys)
    at = table.find(keys)
    assert (table.keys[at] == keys).all()
    assert (table.find(rng.integers(1 << 62, 1 << 63, 5000).astype(np.uint64)) == -1).all()
    assert len(SortedHashes(np.zeros(0, np.uint64)).find(keys)) == 5000


def test_merged():
    s, e = merged(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 10]))
    assert (s.tolist(), e.tolist()) == ([0, 9], [7, 10])


# ---------------------------------------------------------------- decontamination


def contamination(docs, items, window=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    windows = {}
    for i, t in items:
        w = word(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, ids = word(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in windows:
                    hit.update(range(s, s + k))
                    ids |= windows[g]
        out.append((d, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return key(out)


@pytest.mark.parametrize("block", [1 << 20, 12])
def test_decontamination(spark, documents, corpus, block):
    """Also with the benchmark in many blocks."""
    whole = [t for _, t in corpus if t and len(t.split()) > 60]
    items = [(1, " ".join(whole[0].split()[5:40]).upper().replace("É", "é")), (2, " ".join(whole[1].split()[:13])), (3, "solo phrase"), (4, None), (5, ""), (10, " ".join(whole[0].split()[20:60])), (None, " ".join(whole[2].split()[3:20])), (3, "solo phrase")]
    docs = [*corpus, (200, "a Solo, Phrase here"), (201, "phrase solo"), (202, " ".join(whole[0].split()[5:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(documents(docs), bench, block_windows=block)
    assert key((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == contamination(docs, items)
    spans = {r.doc_id: r.matches for r in got.filter("doc_id in (200, 202)").collect()}
    assert [(m.item_id, m.start, m.end) for m in spans[200]][:1] == [("3", 1, 3)] and spans[202] == []


def test_decontamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontam.contamination(documents([(1, "a b")]), none).collect()] == [(2, 0)]
    assert decontam.contamination(documents([]).limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = documents([(1, "x a b c"), (1, "clean too"), (2, "clean"), (None, None), (None, "a b c"), (None, "clean"), (3, None)])
    kept = decontam.decontaminated(docs, bench)
    assert kept.schema == docs.schema
    assert key((r.doc_id, r.text) for r in kept.collect()) == key([(1, "clean too"), (2, "clean"), (None, None), (None, "clean"), (3, None)])


def test_long_matches_join_up(spark, documents):
    text = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    r = decontam.contamination(documents([(1, "pre " + text + " post")]), bench).first()
    assert [(m.start, m.end, m.item_start) for m in r.matches] == [(1, 41, 0)] and r.longest == 40


@pytest.mark.parametrize("vocabulary", ["ab", "abcde"])
def test_longest_matches_by_comparing_all_places(spark, documents, vocabulary):
    """From each word on, the longest stretch that some item holds, unless it only cuts off the one before."""
    rng = random.Random(len(vocabulary))
    text = lambda n: [rng.choice(vocabulary) for _ in range(rng.randint(0, n))]
    items, docs = [text(9) for _ in range(12)], [text(16) for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontam.contamination(documents([(i, " ".join(x)) for i, x in enumerate(docs)]), bench, window=3, opening=2)
    for r in got.collect():
        words, long = docs[r.doc_id], [x for x in items if len(x) >= 3]
        reach = [max((k for x in long for q in range(len(x)) for k in range(3, len(x) - q + 1) if x[q : q + k] == words[p : p + k]), default=0) for p in range(len(words))]
        want = [(p, p + n) for p, n in enumerate(reach) if n and not (p and reach[p - 1] == n + 1)]
        assert sorted({(m.start, m.end) for m in r.matches if len(items[int(m.item_id)]) >= 3}) == want
        assert all(items[int(m.item_id)][m.item_start : m.item_start + m.end - m.start] == words[m.start : m.end] for m in r.matches)


def test_a_word_repeated_a_million_times(spark):
    """A megabyte of one word against an item of a thousand of it: memory in proportion to the text, results by definition."""
    import resource

    text, item = "0 " * 500_000 + "x", "0 " * 1000
    tests = decontam.TestSuffixes(["1"], [item], 13, 4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _, _, data, offsets in decontam.text_parts(decontam.pa.array([text], decontam.pa.large_string())):
        words = decontam.Words(data, offsets, decontam.PLAIN, decontam.LOWER)
        at, which = decontam.search_shard(words, tests)
        found = decontam.longest_matches(at, which, at * 0, tests, at[:1] * 0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024
    assert (len(at), len(found[0])) == (499_988, 499_001) and set((found[3] - found[2]).tolist()) == {1000}
    docs = spark.createDataFrame([(1, text), (2, "1 0"), (3, "0 " * 12)], "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "n_words", "n_hit", "items", "longest")
    assert sorted(map(tuple, got.collect())) == [(1, 500_001, 500_000, ["1"], 1000), (2, 2, 0, [], 0), (3, 12, 0, [], 0)]
