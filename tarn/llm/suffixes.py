"""Suffix-array dedup: suffixes at minimiser positions only, sorted, compared with their neighbours, extended both ways."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.common import span_hash
from tarn.llm.minimisers import BUCKET_MOST, SEED_WORDS, WINDOW, Packed, Pieces, map_bits, repeated_windows, run_minima, without_repeats


def neighbour_minima(words: Packed, leads: np.ndarray, docs: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, smallest document) of each window around a retained suffix.

    Suffixes are sorted by the words from their minimiser on; `reach` is how many words each shares with its neighbour
    above. A window that begins j words before the minimiser needs window - j shared words to the right: these hold over
    runs of neighbours. Inside a run the j words to the left must agree as well.
    """
    n = len(leads)
    origin = words.first[:-1] + leads
    right = np.zeros((n, window), np.uint64)
    for k in range(window):
        ok = origin + k < words.first[1:]
        right[ok, k] = words.hashes[origin[ok] + k]
    order = np.lexsort((*right.T[::-1], keys))
    differ = right[order][1:] != right[order][:-1]
    reach = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    reach[keys[order][1:] != keys[order][:-1]] = 0
    reach = np.r_[0, reach]
    out_row, out_least, out_at = [], [], []
    for j in range(int(leads.max(initial=0)) + 1):
        fits = (leads >= j) & (origin - j + window <= words.first[1:])
        run = np.cumsum(reach < window - j)
        left = span_hash(words.hashes, origin - np.minimum(j, leads), origin)
        here = order[fits[order]]
        if not len(here):
            continue
        run_here = run[fits[order]]
        sub = np.lexsort((docs[here], left[here], run_here))
        new = np.r_[True, (run_here[sub][1:] != run_here[sub][:-1]) | (left[here][sub][1:] != left[here][sub][:-1])]
        out_row.append(here)
        out_least.append(run_minima(sub, new, docs[here]))
        out_at.append(leads[here] - j)
    row, least, at = np.concatenate(out_row), np.concatenate(out_least), np.concatenate(out_at)
    order = np.lexsort((at, row))
    return row[order], least[order]


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, bits: int | None = None, most: int = BUCKET_MOST) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_repeated, kept (text), spans ([start, end) of words).

    A passage of `window` or more words is repeated if it also stands in a document with a smaller doc_id; its first
    copy stays. Null, empty and short texts have none. A row without an id counts after all ids; rows that repeat an
    id do not make each other's passages repeated. Extra columns are ignored.

    The suffix array holds the suffixes at minimisers, in shards by their first `seed` words; each suffix travels with
    the words to both sides that windows around its minimiser reach. A match of neighbours is extended right and left as
    far as windows that hold the minimiser go; beyond these the next minimiser's suffix goes on, and spans join them up.
    """
    bits = map_bits(docs) if bits is None else bits
    return without_repeats(docs, repeated_windows(Pieces(docs, window, seed, bits), neighbour_minima, most), window, "n_repeated")
