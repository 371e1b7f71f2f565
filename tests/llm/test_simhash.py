from __future__ import annotations

import random

import pytest
import xxhash

from tarn.llm import simhash


def slow_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    fps = [(i, slow_fingerprint(t)) for i, t in pairs]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f, least.get(find(f))) for i, f in fps), key=repr)


def test_against_brute_force(documents, corpus):
    got = simhash.near_duplicates(documents(corpus)).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == components(corpus)


@pytest.mark.parametrize("most", [256, 2])
@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_connect_what_is_close(spark, radius, most):
    """Chains of close fingerprints among far ones, also with every block crowded."""
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:6]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, radius)):
                f ^= 1 << b
            fps.add(f)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, most=most)
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    group = {x: got.get(x, x) for x in signed}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert group == {x: find(x) for x in signed}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, 1001: 1000}


def test_edges(documents):
    assert simhash.near_duplicates(documents([]).limit(0)).collect() == []
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents([(5, None), (3, ""), (7, " "), (9, "a b c d")])).collect()}
    assert got == {5: 3, 3: 3, 7: 3, 9: 9}


def test_one_of_each(documents):
    rows = [(5, "a b"), (3, "A  b"), (3, "A  b"), (9, "x"), (None, "a b"), (None, None), (3, "something else"), (11, ""), (None, "lone one"), (None, "lone one")]
    docs = documents(rows)
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    # the copy of id 3 stays once, its other text stays too; null and empty are one component, of which id 11 has the row
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, "A  b"), (3, "something else"), (9, "x"), (11, ""), (None, "lone one")], key=repr)
    assert simhash.one_of_each(documents([]).limit(0)).collect() == []


def test_one_of_each_keeps_one_row_of_every_component(documents, corpus):
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(documents(corpus)).collect()]
    wanted = {(i, f) for i, f, _ in components(corpus)}
    root = {f: c for _, f, c in components(corpus)}
    assert all((i, slow_fingerprint(t)) in wanted for i, t in kept)
    assert sorted(repr(root[slow_fingerprint(t)]) for _, t in kept) == sorted({repr(c) for c in root.values()})
    assert all(i == root[slow_fingerprint(t)] for i, t in kept)


def test_fine_groups_are_bounded(spark):
    """All fingerprints of 2^11 that differ in low bits crowd every coarse block; the links are still those of the definition."""
    rng = random.Random(1)
    fps = sorted(rng.sample(range(1 << 14), 1200))
    got = {(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), most=64).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
