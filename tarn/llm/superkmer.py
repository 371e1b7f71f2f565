"""Substring dedup by super-k-mers: runs of windows that share a minimiser travel as one string to its bucket."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.minimisers import BUCKET_MOST, SEED_WORDS, WINDOW, Packed, Pieces, map_bits, repeated_windows, sorted_minima, without_repeats


def bucket_minima(words: Packed, leads: np.ndarray, docs: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the super-k-mers of whole buckets, sorted and counted; equal windows always share a bucket."""
    return sorted_minima(words, docs, window)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, bits: int | None = None, most: int = BUCKET_MOST) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (text), spans (removed words, [start, end)).

    A word is removed if a window of `window` consecutive words that covers it also starts in a document with a smaller
    doc_id, judged on the input. Windows are equal if two 64-bit hashes of their words are. Null and empty texts and
    texts of fewer words lose nothing. A row without an id counts after all ids: it loses to them, they never to it.
    Rows that repeat an id do not remove from each other. Kept words are joined by one space. Extra columns are ignored.
    """
    bits = map_bits(docs) if bits is None else bits
    return without_repeats(docs, repeated_windows(Pieces(docs, window, seed, bits), bucket_minima, most), window, "n_removed")


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """What substring_dedup finds, straight from the definition: (doc_id, words, removed, SHA-256 of what is kept)."""
    least: dict[tuple, float] = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            least[g] = min(least.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in split:
        own = float("inf") if i is None else i
        gone = {k for s in range(len(w) - window + 1) if least[tuple(w[s : s + window])] < own for k in range(s, s + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
