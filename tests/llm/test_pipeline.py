"""The pipeline's stages and their chain: repeated and null ids, empty tables, clashing columns, against what each must keep."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tarn.llm import pieces  # noqa: E402
from tests.llm import test_pii, test_simhash  # noqa: E402

needs = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no vocabularies")
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def folder(spark, documents, corpus, tmp_path_factory):
    """Tables of a small corpus with passages of the benchmark, personal data, null and repeated ids."""
    root = tmp_path_factory.mktemp("tables")
    rows = [*corpus, (400, f"before {ITEM} after"), (400, "a clean text of the same id"), (None, f"{ITEM} again"), (None, "clean without an id"), (401, "write to zed@mail.example or 10.0.0.1"), (402, None)]
    documents(rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def near_groups(rows):
    """The rows of each component of fingerprints that two bits or fewer part."""
    groups = []
    for row in rows:
        f = test_simhash.slow_fingerprint(row[1])
        near = [g for g in groups if any((f ^ test_simhash.slow_fingerprint(t)).bit_count() <= 2 for _, t in g)]
        groups = [g for g in groups if not any(g is x for x in near)] + [[row, *(r for g in near for r in g)]]
    return groups


def stages():
    return dict(corpus_pipeline.STAGES)


def test_filters_keep_what_they_must(spark, folder):
    root, rows = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name in ("toxicity", "simhash near-dedup", "benchmark decontamination", "pii"):
        out = stages()[name](spark, docs, root)
        assert out.columns == docs.columns
        got = pairs(out)
        if name == "toxicity":
            assert got == Counter(rows)
        elif name == "simhash near-dedup":
            groups = near_groups(rows)
            kept = [min(k for k, g in enumerate(groups) if (i, t) in g) for i, t in got.elements()]
            assert sorted(kept) == list(range(len(groups)))
            least = [min((i for i, _ in g if i is not None), default=None) for g in groups]
            assert all(i == least[k] for (i, _), k in zip(got.elements(), kept, strict=True))
        elif name == "benchmark decontamination":
            assert got == Counter((i, t) for i, t in rows if ITEM not in (t or ""))
        else:
            want = test_pii.brute_force(rows, test_pii.pii.Policy())
            assert got == Counter((i, t if t is None else test_pii.put_in(t, s)) for i, t, s in want)


@needs
def test_the_chain(spark, folder):
    """Each stage over all that the one before it kept; every row that is left has its samples, which decode to its text."""
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, stage(spark, docs, root)
        assert docs.columns == was.columns and docs.count() <= was.count(), name
    found = corpus_pipeline.run(spark, root).select("doc_id", "rank", "n_pieces", "text_sha256").collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect()}
    assert sum(r["rank"] in (None, 1) for r in found) == docs.count()


@needs
def test_the_chain_in_content(spark, documents, tmp_path):
    """With labels: toxic rows, copies, contaminated rows and personal data go, in this order, and each text that is left decodes to itself.

    No empty texts here: a model of so few documents may find words missing as telling as words that are there."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in ("alo", "eri", "unu", "ipa") for c in ("st", "nd", "rm")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, line(30) + (" dumbword" if i % 6 == 0 else "")) for i in range(240)]
    rows += [(1000, rows[1][1]), (1001, rows[1][1]), (1002, f"{ITEM} {line(20)}"), (1003, f"{ITEM} {line(20)} dumbword"), (1004, f"{line(20)} write to zed@mail.example or not")]
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t in rows if "dumbword" not in (t or "")]  # toxic rows go
    prints = {r: test_simhash.slow_fingerprint(r[1]) for r in kept}
    groups = []
    for r in kept:
        near = [g for g in groups if any((prints[r] ^ prints[x]).bit_count() <= 2 for x in g)]
        groups = [g for g in groups if not any(g is x for x in near)] + [[r, *(x for g in near for x in g)]]
    kept = [min(g) if all(i is not None for i, _ in g) and len({i for i, _ in g}) == len(g) else g[0] for g in groups]
    kept = [(i, t) for i, t in kept if ITEM not in (t or "")]
    found = test_pii.brute_force(kept, test_pii.pii.Policy())
    want = {i: t if t is None else test_pii.put_in(t, s) for i, t, s in found}
    assert 1000 not in want and 1002 not in want and 6 not in want and "[EMAIL]" in want[1004]
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text_sha256").collect():
        got.setdefault(r.doc_id, set()).add(r.text_sha256)
    assert set(got) == set(want)
    assert {i for i, t in want.items() if t and got[i] != {hashlib.sha256(t.encode()).hexdigest()}} == set()


@needs
def test_nothing(spark, folder, tmp_path):
    root, _ = folder
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
