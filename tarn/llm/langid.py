"""Language identification by interpolated Kneser-Ney models of characters, one for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SortedHashes, arrow, held_out, segment_sums, text_parts

#: Characters in a gram: four of 16 bits make a 64-bit key, so keys are exact. Letters beyond the BMP count as one letter.
ORDER = 4
#: Scales of the score that calibration chooses from, and in how many parts it counts a nat of entropy and of loss.
SCALES = 2.0 ** np.arange(-6, 5, 0.5)
ENTROPY_PARTS, LOSS_PARTS = 1 << 10, 10_000
UNKNOWN = "und"
_ALL = (1 << 64) - 1


def _fold_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_FOLD: list[np.ndarray] = []


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, first character of each row): lower-case letters, each run of anything else as one 0.

    Every row begins with ORDER - 1 zeros and ends with one, so no gram spans two rows.
    """
    if not _FOLD:
        _FOLD.append(_fold_table())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    small = np.minimum(points, 0xFFFF).astype(np.uint16)
    out = _FOLD[0][small]
    if len(points) and points.max() > 0xFFFF:
        high = np.flatnonzero(points > 0xFFFF)
        out[high] = [0xFFFE if chr(c).isalpha() else 0 for c in points[high].tolist()]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[begins[:-1][begins[:-1] < len(out)]] = True
    at = np.r_[0, np.cumsum(keep)][begins]
    out = out[keep]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    padded = np.zeros(len(out) + ORDER * (len(offsets) - 1) + ORDER, np.uint16)
    padded[np.arange(len(out)) + ORDER * row + ORDER - 1] = out
    return padded, at + ORDER * np.arange(len(offsets))


def grams(chars: np.ndarray) -> np.ndarray:
    """The key of the gram that ends at each character from the ORDER-th on."""
    x = chars.astype(np.uint64)
    return (x[:-3] << np.uint64(48)) | (x[1:-2] << np.uint64(32)) | (x[2:-1] << np.uint64(16)) | x[3:]


def row_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, first gram of each row, letters of each row). The last gram of a row ends at its closing zero."""
    chars, first = letters(data, offsets)
    keys = grams(chars)[: first[-1]] if len(chars) > 3 else np.zeros(0, np.uint64)
    inner = np.ones(len(keys), bool)
    for k in range(1, ORDER):  # grams that begin in one row's closing zero
        x = first[1:] - k
        inner[x[(x >= first[:-1]) & (x >= 0)]] = False
    sums = np.r_[0, np.cumsum(inner)]
    count = np.r_[0, np.cumsum(chars[: first[-1] + ORDER] != 0)]
    return keys[inner], sums[first], count[first[1:]] - count[first[:-1]]


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1)


class Smoothed:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours below it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: dict[int, tuple] = {}
        for order in range(ORDER, 0, -1):
            d = self._discount(counts)
            context, where = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(where, weights=counts), np.bincount(where)
            p = np.maximum(counts - d, 0) / total[where]
            self.levels[order] = (keys, p, context, d * kinds / total)
            if order > 1:
                keys, counts = np.unique(_suffix(keys, order - 1), return_counts=True)
        self.uniform = 1 / (len(keys) + 1)

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        one, two = (counts == 1).sum(), (counts == 2).sum()
        return float(one / (one + 2 * two)) if one and two else 0.5

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def gamma(self, contexts: np.ndarray, order: int) -> np.ndarray:
        _, _, known, gamma = self.levels[order]
        return self._at(known, gamma, contexts, 1.0)

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full(len(keys), self.uniform)
        known, p, _, _ = self.levels[order]
        return self._at(known, p, keys, 0.0) + self.gamma(keys >> np.uint64(16), order) * self.probability(_suffix(keys, order - 1), order - 1)


@dataclass
class Models:
    """All languages' models in sorted hash arrays: for each order the grams known to any with their probabilities in each."""

    langs: list[str]
    grams: dict[int, SortedHashes]
    probabilities: dict[int, np.ndarray]
    contexts: dict[int, SortedHashes]
    gammas: dict[int, np.ndarray]
    uniform: np.ndarray
    scale: float = 1.0
    limits: np.ndarray | None = None

    @classmethod
    def build(cls, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
        langs = sorted(tables)
        made = [Smoothed(*tables[x]) for x in langs]
        out = cls(langs, {}, {}, {}, {}, np.array([m.uniform for m in made]))
        for order in range(1, ORDER + 1):
            out.grams[order] = SortedHashes(np.concatenate([m.levels[order][0] for m in made] or [np.zeros(0, np.uint64)]))
            out.probabilities[order] = np.stack([m.probability(out.grams[order].keys, order) for m in made], axis=1) if made else np.zeros((0, 0))
            out.contexts[order] = SortedHashes(np.concatenate([m.levels[order][2] for m in made] or [np.zeros(0, np.uint64)]))
            out.gammas[order] = np.stack([m.gamma(out.contexts[order].keys, order) for m in made], axis=1) if made else np.zeros((0, 0))
        out.logs = np.log(out.probabilities[ORDER]).astype(np.float32)
        return out

    def _probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Of each key in each language; unknown grams back off."""
        if not order:
            return np.broadcast_to(self.uniform, (len(keys), len(self.langs)))
        at = self.grams[order].find(keys)
        out = self.probabilities[order][at] if len(self.grams[order]) else np.zeros((len(keys), len(self.langs)))
        left = np.flatnonzero(at < 0)
        if len(left):
            context = self.contexts[order].find(keys[left] >> np.uint64(16))
            gamma = np.where((context >= 0)[:, None], self.gammas[order][context], 1.0) if len(self.contexts[order]) else 1.0
            out[left] = gamma * self._probability(_suffix(keys[left], order - 1), order - 1)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean log probability of each row in each language, letters of each row)."""
        keys, first, n = row_grams(data, offsets)
        at = self.grams[ORDER].find(keys)
        logs = self.logs[at]
        left = np.flatnonzero(at < 0)
        if len(left):
            rare, back = np.unique(keys[left], return_inverse=True)
            logs[left] = np.log(self._probability(rare, ORDER))[back]
        return segment_sums(logs, first) / np.maximum(np.diff(first), 1)[:, None], n

    def decide(self, mean: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, accepted): the lowest cross-entropy per character, its calibrated share, and whether it is in bounds."""
        best = mean.argmax(axis=1)
        z = self.scale * np.sqrt(np.maximum(n, 1))[:, None] * (mean - mean.max(axis=1, keepdims=True))
        share = 1 / np.exp(z).sum(axis=1)
        good = n > 0
        return np.where(good, best, -1), np.where(good, share, 0.0), good & (-mean[np.arange(len(best)), best] <= self.limits[best])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of rows that are not held out and whose lang is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, held = langs.indices.to_numpy(), {}
            for i, j, data, offsets in text_parts(batch.column(1)):
                keys, first, n = row_grams(data, offsets)
                used = np.repeat(n > 0, np.diff(first))
                of = np.repeat(code[i:j], np.diff(first))
                for c in np.unique(code[i:j]).tolist():
                    held.setdefault(c, []).append(np.unique(keys[used & (of == c)], return_counts=True))
            for c, parts in held.items():
                keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([x for _, x in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[c].as_py()] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    rows = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).transform(arrow, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Models:
    """Counts cover every document that may teach; each model holds all of its grams, so its statistics are those of the corpus.

    The scale of the score and each language's rejection limit come from all of those documents, too.
    """
    got = count_grams(docs).select("lang", "gram", "n").toArrow()
    langs = got.column("lang").to_pandas().to_numpy()
    keys, counts = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64)
    tables = {}
    for x in sorted(set(langs.tolist())):
        order = np.argsort(keys[langs == x])
        tables[x] = keys[langs == x][order], counts[langs == x][order]
    models = Models.build(tables)
    models.limits = np.full(len(models.langs), np.inf)
    return calibrated(docs, models) if models.langs else models


def calibrated(docs: DataFrame, models: Models) -> Models:
    """models with the scale of least loss, and limits from the quantile and the deviation of each language's own entropies.

    Every document that may teach is scored. Entropies are counted in steps of 1/1024 nat (rounded up) and losses summed
    in whole parts, so that sums are exact in any order and the driver gets counts by language and step, not documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)
    index = {x: k for k, x in enumerate(models.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            true = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for i, j, data, offsets in text_parts(batch.column(1)):
                mean, n = sent.value.score(data, offsets)
                ok = (n > 0) & (true[i:j] >= 0)
                own, mean, n = true[i:j][ok], mean[ok].astype(np.float64), n[ok]
                rows = np.arange(len(own))
                z = np.sqrt(n)[:, None] * (mean - mean.max(axis=1, keepdims=True))
                loss = [int(np.rint(LOSS_PARTS * (np.log(np.exp(x * z).sum(axis=1)) - x * z[rows, own])).sum()) for x in SCALES]
                steps, times = np.unique(np.stack([own, np.ceil(-mean[rows, own] * ENTROPY_PARTS).astype(np.int64)]), axis=1, return_counts=True)
                columns = np.r_[np.full(len(loss), -1), steps[0]], np.r_[np.arange(len(loss)), steps[1]], np.r_[np.array(loss, np.int64), times]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["lang", "step", "n"])

    known = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.select(F.col("lang").cast("string"), F.col("text").cast("string")).transform(arrow, run, "lang long, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n")).toArrow()
    lang, step, n = (counted.column(c).to_numpy() for c in ("lang", "step", "n"))
    if not (lang >= 0).any():
        return models
    loss = dict(zip(step[lang < 0].tolist(), n[lang < 0].tolist(), strict=True))
    models.scale = float(SCALES[min(sorted(loss), key=loss.get)])
    for k in range(len(models.langs)):
        order = np.argsort(step[lang == k])
        own, times = step[lang == k][order] / ENTROPY_PARTS, n[lang == k][order]
        if times.sum() >= 20:
            deviation = np.sqrt(max(np.average(own**2, weights=times) - np.average(own, weights=times) ** 2, 0.0))
            models.limits[k] = own[np.searchsorted(np.cumsum(times), 0.995 * times.sum())] + deviation
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, accepted, cross_entropy.

    lang_pred is the language of the lowest cross-entropy per character; `und` with score 0 if the text is null, empty
    or without a letter, or nothing was learned. accepted is false where the text is less likely than nearly all texts
    of that language: callers that reject then take `und`. Equal entropies go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, j, data, offsets in text_parts(batch.column(1)):
                if not m.langs:
                    got = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i, bool), np.zeros(j - i)
                else:
                    mean, n = m.score(data, offsets)
                    best, share, fine = m.decide(mean, n)
                    got = best, share, fine, np.where(n > 0, -mean.max(axis=1), 0.0)
                for x, y in zip(out, got, strict=True):
                    x.append(y)
            if out[0]:
                best, share, fine, cross = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share), pa.array(fine), pa.array(cross)], ["doc_id", "lang_pred", "score", "accepted", "cross_entropy"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow, run, "doc_id long, lang_pred string, score double, accepted boolean, cross_entropy double")
