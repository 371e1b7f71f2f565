"""Toxicity by a factorization machine over hashed terms: single weights and pairwise interactions, fitted on labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import LOWER, SortedHashes, Words, arrow, byte_set, held_out, release, segment_sums, span_hash, text_parts

#: Labelled documents of each class that the model is fitted on, those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = 3000
#: Places of the table that terms are hashed into, as bits, and factors of each.
BITS, FACTORS = 18, 8
#: A term that the sample's labels speak for by itself (likelihood ratio, documents) is drawn to zero this much less.
EVIDENCE, LEAST_DOCS, SPOKEN_FOR = 15, 6, 0.01
THRESHOLD = 0.3
#: Bytes of a word's beginning that are terms beside the word itself.
PREFIXES = (4, 5, 6)
_WORD = byte_set("".join(chr(c) for c in range(128) if not chr(c).isalpha()))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the table) of each word and each beginning of it; letters are folded in ASCII and Latin-1."""
    folded = LOWER[data]
    after = np.zeros(len(folded), bool)
    after[1:] = folded[:-1] == 0xC3
    folded = np.where(after & (folded >= 0x80) & (folded <= 0x9E) & (folded != 0x97), folded + 0x20, folded)
    words = Words(folded, offsets, _WORD)
    rows, size = words.rows(), words.ends - words.starts
    out_rows, out = [rows], [words.hashes]
    values = folded.astype(np.uint64) + np.uint64(1)
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        out_rows.append(rows[at])
        out.append(span_hash(values, words.starts[at], words.starts[at] + k) ^ np.uint64(k * 0x1F3D5B79))
    return np.concatenate(out_rows), np.concatenate(out) >> np.uint64(64 - BITS)


@dataclass
class Model:
    """logit = bias + sum of weights + sum over pairs of <v_i, v_j>, over the distinct terms of a text. The table holds the
    places whose weight or factors training has not drawn to zero."""

    table: SortedHashes
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.table):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        rows, hashed = terms(data, offsets)
        at = self.table.find(hashed)
        pairs = np.unique(rows[at >= 0] * len(self.table) + at[at >= 0])
        rows, at = pairs // len(self.table), pairs % len(self.table)
        first = np.searchsorted(rows, np.arange(n + 1))
        v = self.factors[at]
        both = segment_sums(v, first)
        logit = self.bias + segment_sums(self.weights[at], first) + 0.5 * ((both**2).sum(axis=1) - segment_sums((v**2).sum(axis=1), first))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _evidence(index: np.ndarray, toxic: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """How strongly each term alone goes with either label (G squared); zero for a term of few documents."""
    n, ones = len(toxic), toxic.sum()
    df, df1 = np.bincount(index, minlength=size), np.bincount(index, weights=toxic[of], minlength=size)
    g2 = np.zeros(size)
    for seen, total in ((df1, ones), (df - df1, n - ones)):
        for x, y in ((seen, df * total / n), (total - seen, total - df * total / n)):
            g2 += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(y, 1e-9)), 0)
    g2[df < LEAST_DOCS] = 0
    return g2


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, epochs: int = 20, rate: float = 0.1, decay: float = 1e-4, sparse: float = 0.05, sparse_pairs: float = 0.01, seed: int = 7) -> Model:
    """rows: the distinct hashed terms of each text. The bias is set for the share `prior` of toxic rows among all labels.

    Every term of the sample has a weight and factors; none is chosen beforehand, as a term that tells nothing alone may
    tell all beside another. Proximal steps draw weights (`sparse`) and whole factor rows (`sparse_pairs`) to zero, those
    of terms with evidence of their own SPOKEN_FOR as much.
    """
    keep = np.unique(np.array([xxhash.xxh64_intdigest(r.tobytes(), int(y)) for r, y in zip(rows, toxic, strict=True)], np.uint64), return_index=True)[1] if rows else np.zeros(0, int)
    rows, toxic = [rows[i] for i in keep], toxic[keep].astype(np.float64)
    n, ones = len(rows), toxic.sum()
    base = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    if not n or ones in (0, n) or not sum(map(len, rows)):
        return Model(SortedHashes(np.zeros(0, np.uint64)), np.zeros(0), np.zeros((0, FACTORS)), base)
    sizes = np.array([len(r) for r in rows])
    names, index = np.unique(np.concatenate(rows), return_inverse=True)
    index, first, m = index.astype(np.int32), np.r_[0, np.cumsum(sizes)], len(names)
    del rows
    soft = np.where(_evidence(index, toxic, np.repeat(np.arange(n), sizes), m) >= EVIDENCE, SPOKEN_FOR, 1.0)
    rng = np.random.default_rng(seed)
    batches = []
    for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
        used, at = np.unique(np.concatenate([index[first[i] : first[i + 1]] for i in batch]), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes[batch])]
        order = np.argsort(at, kind="stable")
        texts = np.repeat(np.arange(len(batch), dtype=np.int32), sizes[batch])[order]
        if len(used):
            batches.append((used, at.astype(np.int32), starts, texts, np.searchsorted(at[order], np.arange(len(used))), toxic[batch]))
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)), 0.0
    gw, gv, gb = np.full(m, 1e-5), np.full((m, FACTORS), 1e-3), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            used, at, starts, texts, heads, want = batches[k]
            vu, wu = v[used], w[used]
            both = segment_sums(vu[at], starts)
            logit = b + segment_sums(wu[at], starts) + 0.5 * ((both**2).sum(axis=1) - segment_sums((vu**2).sum(axis=1)[at], starts))
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - want) / len(want)
            each = np.add.reduceat(err[texts], heads)
            dw = each + decay * wu
            dv = np.add.reduceat((err[:, None] * both)[texts], heads, axis=0) - each[:, None] * vu + decay * vu
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            step = rate / np.sqrt(gw[used])
            moved = wu - step * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse * soft[used], 0)
            moved = vu - rate * 0.5 * dv / np.sqrt(gv[used])
            pull = rate * 0.5 / np.sqrt(gv[used].mean(axis=1)) * sparse_pairs * soft[used]
            v[used] = moved * np.maximum(1 - pull / np.maximum(np.sqrt((moved**2).sum(axis=1)), 1e-12), 0)[:, None]
            b -= rate * err.sum() / np.sqrt(gb)
    alive = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    table = SortedHashes(names[alive])
    alive = alive[table.order]
    return Model(table, w[alive], v[alive], b + base - np.log(ones / (n - ones)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fitted on at most `per_class` labelled documents of either class that are not held out; the prior is of all such labels."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    picked = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in sample.collect()], "doc_id long, toxic int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_parts(batch.column(1)):
                rows, hashed = terms(data, offsets)
                # distinct terms of each row, by sorting row and term together
                order = np.lexsort((hashed, rows))
                rows, hashed = rows[order], hashed[order]
                new = np.r_[True, (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])][: len(rows)]
                rows, hashed = rows[new], hashed[new]
                first = np.searchsorted(rows, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([hashed[a:b].astype(np.uint32).tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["toxic", "terms"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").select("toxic", "text")
    got = texts.transform(arrow, run, "toxic int, terms binary").toArrow()
    rows, toxic = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in got.column("terms")], got.column("toxic").to_numpy()
    del got
    model = fit(rows, toxic, (ones + 1) / (n + 2) if n else 0.0)
    release()
    return model


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score (0 to 1) for each row; null and empty texts get the score of no terms."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.score(data, offsets) for _, _, data, offsets in text_parts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(got) if got else np.zeros(0))], [*batch.schema.names[1:], "_score"])

    taken = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[1:]) + ", _score double"
    return taken.transform(arrow, run, schema).withColumnRenamed("_score", "score")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Rows with a null id are scored and count as not held out, but teach nothing. Of repeated labels the toxic one
    counts. With labels of one class only every text gets the prior, and without any label a score near 0: nothing is rejected unlearned. lang, source and labels are no inputs.
    """
    found = scores(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that score at least `threshold`."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    column = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.score(data, offsets) for _, _, data, offsets in text_parts(batch.column(column).cast(pa.string()))]
            if got:
                yield batch.filter(pa.array(np.concatenate(got) < threshold))

    return docs.transform(arrow, run, docs.schema)
