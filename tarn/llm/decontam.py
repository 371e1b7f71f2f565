"""Benchmark decontamination: suffix arrays over shards of the training texts, searched by every test suffix.

A shard is a run of whole documents of about CHUNK_BYTES. Its suffix array holds word suffixes in order of their word
hashes. Only suffixes whose first words open some test suffix are sorted: no other can match a window, so nothing is
lost. Every test suffix is then binary-searched in every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import LOWER, PLAIN, SortedHashes, Words, arrow, merged, span_hash, text_parts

WINDOW = 13
#: Words that a suffix must share with a test suffix to be sorted.
OPENING = 4
#: Windows in one broadcast block (some 110 bytes each); a larger benchmark takes more passes over the documents.
BLOCK_WINDOWS = 1 << 18

FOUND = "array<struct<item_id:string,start:int,end:int,item_start:int>>"
_FIELDS = ("item_id", "start", "end", "item_start")
_FOUND = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("item_start", pa.int32())]))


class TestSuffixes:
    """All test suffixes that hold a whole window, as rows of word hashes; equal windows are one row with several places."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int, opening: int):
        column = pa.array(texts, pa.large_string())
        items, places, rows, widths = [], [], [], []
        base = 0
        for i, j, data, offsets in text_parts(column):
            words = Words(data, offsets, PLAIN, LOWER)
            counts = np.diff(words.first)
            for k, n in enumerate(counts):
                width = min(window, n)
                if not n:
                    continue
                at = np.arange(n - width + 1)
                taken = np.zeros((len(at), window), np.uint64)
                taken[:, :width] = words.hashes[words.first[k] + at[:, None] + np.arange(width)]
                rows.append(taken)
                widths.append(np.full(len(at), width))
                items.append(np.full(len(at), base + k))
                places.append(at)
            base += j - i
        self.ids, self.window = ids, window
        rows_all = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        width_all = np.concatenate(widths) if widths else np.zeros(0, np.int64)
        item_all = np.concatenate(items) if items else np.zeros(0, np.int64)
        place_all = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.lexsort((*rows_all.T[::-1], width_all))
        rows_all, width_all = rows_all[order], width_all[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows_all[1:] != rows_all[:-1]).any(axis=1) | (width_all[1:] != width_all[:-1])
        self.rows, self.widths = rows_all[new], width_all[new]
        self.first = np.r_[np.flatnonzero(new), len(order)].astype(np.int64)
        self.items, self.places = item_all[order], place_all[order]
        window_of = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        # each window's items, once each, however often the window stands in an item
        pairs = np.unique(window_of * max(len(ids), 1) + self.items) if len(ids) else np.zeros(0, np.int64)
        self.item_first = np.searchsorted(pairs, np.arange(len(self.rows) + 1) * max(len(ids), 1))
        self.item_of = pairs % max(len(ids), 1)
        # each item as the sequence of its windows; an item shorter than a window is one window of its own width
        along = np.lexsort((self.places, self.items))
        self.sequence, self.sequence_first = window_of[along], np.searchsorted(self.items[along], np.arange(len(ids) + 1))
        self.opening = int(min([opening, *self.widths.tolist()])) if len(self.widths) else opening
        flat = self.rows[:, : self.opening].ravel()
        at = np.arange(len(self.rows)) * self.opening
        self.openings = SortedHashes(span_hash(flat, at, at + self.opening) if len(at) else np.zeros(0, np.uint64))


def _bound(shard: np.ndarray, wanted: np.ndarray, widths: np.ndarray, right: bool) -> np.ndarray:
    """For each wanted row the first row of the sorted shard that is not less (right: greater) in its first `width` words."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(shard), np.int64)
    inside = np.arange(shard.shape[1])[None, :] < widths[:, None]
    rows = np.arange(len(wanted))
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, len(shard) - 1)
        differ = (shard[mid] != wanted) & inside
        at = differ.argmax(axis=1)
        some = differ[rows, at]
        less = np.where(some, shard[mid, at] < wanted[rows, at], right)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def search_shard(words: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, test window) of each occurrence of a test window: at most one for each word and width of window."""
    none = np.zeros(0, np.int64)
    n, opening = len(words), tests.opening
    if n < opening or not len(tests.rows):
        return none, none
    starts = np.arange(n - opening + 1)
    row_end = words.first[1:][words.rows()] if n else none
    starts = starts[starts + opening <= row_end[: len(starts)]]
    if not len(starts):
        return none, none
    starts = starts[tests.openings.find(span_hash(words.hashes, starts, starts + opening)) >= 0]
    if not len(starts):
        return none, none
    shard = np.zeros((len(starts), tests.window), np.uint64)
    for k in range(tests.window):
        at = starts + k
        ok = at < row_end[starts]
        shard[ok, k] = words.hashes[at[ok]]
    order = np.lexsort(shard.T[::-1])
    shard, suffixes = shard[order], starts[order]
    lo = _bound(shard, tests.rows, tests.widths, False)
    hi = _bound(shard, tests.rows, tests.widths, True)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return none, none
    counts = hi[hit] - lo[hit]
    which = np.repeat(hit, counts)
    found = suffixes[np.repeat(lo[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    # a window's end must lie in the same document
    ok = found + tests.widths[which] <= row_end[found]
    order = np.argsort(found[ok], kind="stable")
    return found[ok][order], which[ok][order]


def _expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into which, place) of all places first[w] to first[w + 1] of each w."""
    counts = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), counts)
    return owner, np.repeat(first[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a sequence in order of their first `depth` symbols, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.r_[0, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])].cumsum()
        rank[order] = new
        step *= 2
        if step >= depth or new[-1] == n - 1:
            return order


def longest_matches(at: np.ndarray, which: np.ndarray, row: np.ndarray, tests: TestSuffixes, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest verbatim matches of a shard: (row, item, start, end, item start), in time and memory of its hits.

    For each word at which a window of full width stands, the longest stretch of windows from there on that some item of
    `wanted` holds in the same order; those that only cut off the beginning of the one before are left out. Stretches and items are
    sorted together as suffixes, so each one's longest partner is its nearest item suffix above or below. An item shorter
    than a window matches as a whole wherever it stands.
    """
    full = tests.widths[which] == tests.window
    short = np.flatnonzero(~full)
    owner, place = _expand(tests.item_first, which[short])
    out = [(row[short][owner], tests.item_of[place], at[short][owner], at[short][owner] + tests.widths[which[short]][owner], np.zeros(len(owner), np.int64))]
    at, which, row = at[full], which[full], row[full]
    if len(at):
        breaks = np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]
        heads = np.flatnonzero(breaks)
        lengths = tests.sequence_first[wanted + 1] - tests.sequence_first[wanted]
        _, inside = _expand(tests.sequence_first, wanted)
        item_symbols, item_of, item_place = tests.sequence[inside], np.repeat(wanted, lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # one sequence: items and stretches, each closed by a symbol of its own
        ends = np.cumsum(lengths)
        sizes = np.diff(np.r_[heads, len(at)])
        symbols = np.concatenate([np.insert(item_symbols, ends, -1 - np.arange(len(ends))), np.insert(which, heads + sizes, -1 - len(ends) - np.arange(len(heads)))])
        is_item = np.zeros(len(symbols), bool)
        is_item[np.insert(np.ones(len(item_symbols), bool), ends, False).nonzero()[0]] = True
        base = len(item_symbols) + len(ends)
        text_at = base + np.arange(len(at)) + np.repeat(np.arange(len(heads)), sizes)
        depth = int(lengths.max()) + 1
        order = _suffix_order(symbols, depth)
        # shared symbols of neighbours in the order, by binary search on hashes of spans
        values, n = symbols.astype(np.uint64) + np.uint64(1 << 32), len(symbols)
        a, b = order[:-1], order[1:]
        low, high = np.zeros(n - 1, np.int64), np.minimum(depth, n - np.maximum(a, b))
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = span_hash(values, a, a + mid) == span_hash(values, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        best, partner = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for lcp, seq in ((low, order), (low[::-1], order[::-1])):
            # the nearest item before each suffix, and the least of what neighbours share from there on
            group = np.cumsum(is_item[seq])
            last = np.maximum.accumulate(np.where(is_item[seq], np.arange(n), -1))
            shared = _running_least(np.r_[0, lcp], group)
            found = np.where(last >= 0, seq[np.maximum(last, 0)], -1)
            better = (last >= 0) & (shared > best[seq])
            best[seq[better]], partner[seq[better]] = shared[better], found[better]
        length, mate = best[text_at], partner[text_at]
        item_at = np.full(base, -1, np.int64)
        item_at[np.flatnonzero(is_item[:base])] = np.arange(len(item_symbols))
        new = np.ones(len(at), bool)
        new[1:] = breaks[1:] | (length[:-1] != length[1:] + 1)
        keep = np.flatnonzero(new & (mate >= 0))
        m = item_at[mate[keep]]
        out.append((row[keep], item_of[m], at[keep], at[keep] + length[keep] + tests.window - 1, item_place[m]))
    whole = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.lexsort((whole[1], whole[2], whole[0]))
    return tuple(c[order] for c in whole)


def _running_least(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least value from the second element of each group up to each element; groups are runs, their first value is no bound."""
    big = np.int64(1 << 40)
    x = values.astype(np.int64).copy()
    x[np.r_[True, group[1:] != group[:-1]]] = big - 1
    # later groups lie lower, so a running minimum never looks back past its group
    down = (group.max() - group) * big
    return np.minimum.accumulate(x + down) - down


def _blocks(benchmark: DataFrame, window: int, opening: int, most: int) -> Iterator[TestSuffixes]:
    """The suffixes of the benchmark in blocks of about `most` windows, one at a time on the driver; an item is never split."""
    ids, texts, size, some = [], [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        # every word but one is followed by a character that is none
        size += (len(row[1]) + 1) // 2 if len(row[1]) > most else sum(len(Words(d, o, PLAIN, LOWER, hashed=False)) for *_, d, o in text_parts(pa.array([row[1]], pa.large_string())))
        if size >= most:
            yield TestSuffixes(ids, texts, window, opening)
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield TestSuffixes(ids, texts, window, opening)


def _unlisted(column: pa.Array, names: tuple[str, ...] | None) -> tuple[np.ndarray, list[pa.Array]]:
    """(row of each element, its columns) of a column of lists."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    return row, [flat.field(n) for n in names] if names else [flat]


def _listed(n: int, found: list[tuple[np.ndarray, list[pa.Array]]], kind: pa.DataType) -> pa.Array:
    """A column of n lists from elements that know their rows; the elements of a row stay in order."""
    if not found:
        return pa.array([[]] * n, kind)
    row = np.concatenate([f[0] for f in found])
    order = np.argsort(row, kind="stable")
    columns = [pa.concat_arrays([f[1][k] for f in found]).take(pa.array(order)) for k in range(len(found[0][1]))]
    flat = pa.StructArray.from_arrays(columns, fields=list(kind.value_type)) if pa.types.is_struct(kind.value_type) else columns[0]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)), flat, type=kind)


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, opening: int, most: int) -> DataFrame:
    """rows (row: a struct that goes through as it is, text) with n_words, n_hit, matches and items in place of text."""
    spark = rows.sparkSession
    kind = rows.schema["row"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    blocks = _blocks(benchmark, window, opening, most)
    tests, following, first = next(blocks), None, True
    out = rows
    while tests is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first, last=following is None) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            for batch in batches:
                n, counts = batch.num_rows, []
                # (row, columns) of intervals hit, of matches, and of items; those of earlier blocks come first
                hits, matches, items = ([_unlisted(batch.column(k), names)] if not first else [] for k, names in ((2, ("start", "end")), (3, _FIELDS), (4, None)))
                names = pa.array(tests.ids, pa.string())
                for i, _, data, offsets in text_parts(batch.column(1)):
                    words = Words(data, offsets, PLAIN, LOWER)
                    counts.append(np.diff(words.first))
                    at, which = search_shard(words, tests)
                    if not len(at):
                        continue
                    row = np.searchsorted(words.first, at, side="right") - 1
                    # one word between documents keeps their intervals apart
                    s, e = merged(at + row, at + row + tests.widths[which])
                    own = np.searchsorted(words.first + np.arange(len(words.first)), s, side="right") - 1
                    first_word = words.first[own] + own
                    hits.append((i + own, [pa.array((s - first_word).astype(np.int32)), pa.array((e - first_word).astype(np.int32))]))
                    pairs = np.unique(row * len(tests.rows) + which)
                    owner, place = _expand(tests.item_first, pairs % len(tests.rows))
                    held = np.unique((pairs // len(tests.rows))[owner] * len(tests.ids) + tests.item_of[place])
                    items.append((i + held // len(tests.ids), [names.take(pa.array(held % len(tests.ids)))]))
                    r, m, s, e, p = longest_matches(at, which, row, tests, np.unique(held % len(tests.ids)))
                    b = words.first[r]
                    matches.append((i + r, [names.take(pa.array(m)), *[pa.array(x.astype(np.int32)) for x in (s - b, e - b, p)]]))
                found = [_listed(n, matches, _FOUND), _listed(n, items, pa.list_(pa.string()))]
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(n, hits, span), *found], ["row", "text", "hits", "matches", "items"])
                    continue
                covered = np.zeros(n, np.int64)
                if hits:
                    row = np.concatenate([h[0] for h in hits])
                    # the intervals of a row, wherever they come from, beyond those of all rows before it
                    far = np.int64(1 << 32) * row
                    s, e = merged(*(far + np.concatenate([h[1][k].to_numpy() for h in hits]).astype(np.int64) for k in (0, 1)))
                    np.add.at(covered, s >> 32, e - s)
                sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(covered), *found], ["row", "n_words", "n_hit", "matches", "items"])

        out = out.transform(arrow, run, f"row {kind}, n_words long, n_hit long, matches {FOUND}, items array<string>" if following is None else f"row {kind}, text string, hits array<struct<start:int,end:int>>, matches {FOUND}, items array<string>")
        tests, first = following, False
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, opening: int = OPENING, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (sorted item ids), matches, longest.

    A window is `window` consecutive words of an item, or the whole of a shorter one; words inside any occurrence of a
    window are hit. `matches` lists longest verbatim matches with word positions [start, end): one for each word from
    which some item's windows go on further than from the word before, whatever item it is; a word repeated a million
    times is matched in memory of its own length. A null or empty text
    has no words; items without words match nothing; an item whose id is null hits but is not listed among the items.
    Repeated documents each get a row; an id that several items share is listed once. Nothing is shuffled.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    found = _searched(rows, benchmark, window, opening, block_windows)
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    longest = F.aggregate("matches", F.lit(0), lambda a, m: F.greatest(a, m["end"] - m["start"]))
    return found.select("row.doc_id", "n_words", "n_hit", items.alias("items"), "matches", longest.alias("longest"))


def is_contaminated() -> Column:
    """Some word is hit, and at least a twentieth of them."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, opening: int = OPENING, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs, all columns, without the contaminated rows. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    places = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*places).alias("row"), F.col("text").cast("string").alias("text"))
    found = _searched(rows, benchmark, window, opening, block_windows).filter(~is_contaminated())
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
