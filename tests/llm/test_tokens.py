"""Token files, sampled segmentations and top-k search."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from tarn.llm import pieces, tokens, topk
from tarn.llm.common import mix

needs = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no vocabularies")


@needs
@pytest.mark.parametrize("block", [1, 7, 1 << 15])
def test_token_counts(documents, corpus, block):
    bpe = tokens.encoder(tokens.read_ranks())
    got = tokens.token_counts(documents(corpus).repartition(3), tokens.read_ranks(), block_tokens=block, span=4).collect()
    want = [(i, len(bpe.encode_ordinary(t or ""))) for i, t in corpus]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@needs
def test_token_counts_of_nothing(documents):
    assert tokens.token_counts(documents([]).limit(0), tokens.read_ranks()).collect() == []


def test_flat_files(spark, tmp_path):
    """Raw files, with documents over many blocks, a rest without a separator, and an empty file."""
    for name, ids in (("a", [1, 2, 9, 9, 3] + [4] * 50 + [9, 7]), ("b", [5, 5]), ("c", [])):
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    blocks = tokens.flat_files(spark, str(tmp_path), block_tokens=3)
    got = sorted((Path(r.file).stem, r.document, r.n_tokens) for r in tokens.scan(blocks, separator=9, span=2).collect())
    assert got == [("a", 0, 2), ("a", 1, 0), ("a", 2, 51)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.read_model())


def segmentations(text, p):
    """All of a short text with their log-probabilities, by brute force."""
    points = "▁" + text.replace(" ", "▁")
    out = []

    def go(at, ids, log):
        if at == len(points):
            out.append((tuple(ids), log))
        whole = False
        for end in range(at + 1, min(len(points), at + p.longest) + 1):
            h = pieces.span_hash(np.array([ord(c) + 1 for c in points[at:end]], np.uint64), np.array([0]), np.array([end - at]))
            k = p.beginnings.find(h)[0]
            if k >= 0 and p.piece[k] >= 0:
                whole |= end == at + 1
                go(end, [*ids, int(p.piece[k])], log + p.log[k])
        if at < len(points) and not whole:
            raw = points[at].encode()
            go(at + 1, [*ids, *(int(p.bytes[b]) for b in raw)], log + len(raw) * p.byte_log)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([x for _, x in out])
    return {ids: log - total for ids, log in out}


@needs
@pytest.mark.parametrize("text", ["cat a", "h\n😀x"])
def test_samples_follow_the_distribution(vocabulary, text):
    want = segmentations(text, vocabulary)
    n = 6000
    got = pieces.sample_block([text] * n, mix(np.arange(n).astype(np.uint64)), pieces.Units(vocabulary), 2)
    for row in got[:200]:
        for ids, log, _, _ in row:
            assert log == pytest.approx(want[tuple(ids.tolist())], abs=1e-6)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    pairs = Counter(tuple(tuple(x[0].tolist()) for x in r) for r in got)
    for ids, log in want.items():
        assert first[ids] / n == pytest.approx(math.exp(log), abs=0.025)
    for a, b in permutations(want, 2):
        p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a])) if math.exp(want[a]) < 1 - 1e-9 else 0
        assert pairs[a, b] / n == pytest.approx(p, abs=0.025)


@needs
def test_samples_are_distinct_ordered_and_round_trip(documents, corpus):
    model = pieces.read_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = dict(corpus)
    for r in pieces.encoded(documents(corpus), model, 4).collect():
        if r.doc_id is None:
            continue
        text = texts[r.doc_id]
        if text is None:
            assert r.samples == []
            continue
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
        values = [s.perturbed for s in r.samples]
        assert values == sorted(values, reverse=True) and all(0 <= s.inclusion <= 1 for s in r.samples)
        assert [s.rank for s in r.samples] == list(range(1, len(values) + 1))
        assert all((sp.decode(s.ids) if s.ids else "") == text and s.n_pieces == len(s.ids) for s in r.samples)
        if not text:
            assert [(s.ids, s.log_prob) for s in r.samples] == [([], 0.0)]


@needs
def test_samples_depend_on_the_key_and_seed_only(documents, corpus):
    model = pieces.read_model()
    pick = lambda df, **k: sorted(((r.doc_id, [s.ids_sha256 for s in r.samples]) for r in pieces.encoded(df, model, 2, **k).collect()), key=repr)
    a = pick(documents(corpus))
    assert a == pick(documents(corpus[::-1]).repartition(5)) == pick(documents(corpus), with_ids=False)
    assert a != pick(documents(corpus), seed=2)
    assert pieces.encoded(documents([]).limit(0), model).collect() == []


@needs
def test_few_segmentations(vocabulary):
    got = pieces.sample_block(["cat"], np.array([3], np.uint64), pieces.Units(vocabulary), 200)[0]
    want = segmentations("cat", vocabulary)
    assert {tuple(g[0].tolist()) for g in got} == set(want) and all(g[3] == 1.0 for g in got)


@needs
@pytest.mark.parametrize("most", [1, 60, 1 << 20])
def test_kept_units_change_nothing(vocabulary, most):
    """Units kept from earlier blocks, or forgotten between them, give the samples of a block of its own."""
    texts = [f"the {w} hat of {w}s, \u00e9\U0001f600 {i}" for i, w in enumerate("cat dog cat bird dog hen".split())] + ["", "x" * 300]
    seeds = mix(np.arange(len(texts)).astype(np.uint64))
    kept = pieces.Units(vocabulary, most)
    for i in range(len(texts)):
        alone = pieces.sample_block(texts[i : i + 1], seeds[i : i + 1], pieces.Units(vocabulary), 3)[0]
        got = pieces.sample_block(texts[i : i + 1], seeds[i : i + 1], kept, 3)[0]
        assert [(g[0].tolist(), *g[1:]) for g in got] == [(g[0].tolist(), *g[1:]) for g in alone]


@needs
def test_decoder_says_what_the_library_says(corpus):
    model = pieces.read_model()
    decoder = pieces.Decoder(model)
    for text in [t for _, t in corpus if t] + ["", " a", "  b", " ", "\u2581x", "\u2581\u2581", "a  b", "\n", "\u00e9\U0001f600", " \n"]:
        ids = decoder.sp.encode(text)
        for some in (ids, ids[1:], [0, *ids], [1, *ids], [258, 68], [203]):
            assert decoder(some) == (decoder.sp.decode(some).encode() if some else b"")


@needs
def test_decoding(spark):
    model = pieces.read_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    df = spark.createDataFrame([(1, sp.encode("a b\n😀")), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decoded(df, model).collect())) == [(1, "a b\n😀"), (2, ""), (3, None)]


@needs
def test_every_sample_is_decoded(documents, corpus, spark, tmp_path):
    """op7 and the pipeline's last stage digest the text that each sample's ids decode to."""
    import corpus_pipeline
    from tarn.llm import queries

    docs = documents([(i, t) for i, t in corpus if i is not None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for found in (queries.op7_sentencepiece(spark, str(tmp_path)), corpus_pipeline.segment(spark, docs, str(tmp_path))):
        got = found.collect()
        assert {r.doc_id for r in got} == {i for i, _ in corpus if i is not None}
        assert max(r["rank"] or 0 for r in got) == pieces.SAMPLES
        for r in got:
            text = dict(corpus)[r.doc_id]
            assert r.text_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_topk(spark, shard, monkeypatch):
    """Ids repeat over partitions with equal and other codes, many ids share a code, vectors are of one to three words."""
    monkeypatch.setattr(topk, "LEAST_CODES", 50)
    for width in (64, 128, 150):
        rng = np.random.default_rng(width)
        v = rng.normal(size=(400, width)).round(2)
        v[100:160] = v[7]
        v[200:230] = v[50] * np.where(rng.random((30, width)) < 0.1, -1, 1)
        data = [(i, x) for i, x in enumerate(v)] + [(3, v[3]), (0, v[150]), (210, v[0]), (211, v[50]), (211, v[50]), (51, v[50]), (51, -v[50]), (350, v[7])]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in data] + [(900, None), (None, v[0].tolist())], "vec_id long, embedding array<float>").repartition(5)
        got = topk.nearest(df, df["vec_id"] % 50 == 0, 5, block=3, shard=shard).collect()
        ids, bits = np.array([i for i, _ in data]), np.array([x for _, x in data]) > 0
        want = []
        for q in range(0, 400, 50):
            least = {}
            for code in bits[ids == q]:
                for i, d in zip(ids.tolist(), (bits != code).sum(axis=1).tolist(), strict=True):
                    if i != q:
                        least[i] = min(d, least.get(i, width))
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(sorted((d, i) for i, d in least.items())[:5])]
        assert sorted(map(tuple, got)) == want


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(df, df["vec_id"] % 50 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, None, -1.0]), (1, []), (2, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.nearest(one, one["vec_id"] == 0).collect())) == [(0, 1, 2, 0), (0, 2, 1, 1)]
