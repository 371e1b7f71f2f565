"""Minimisers of word windows: which runs of windows share one, and a bounded map of those seen in several documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SPACED, Words, arrow, checkpointed, identity, may_hold, mix, span_hash, text_parts

WINDOW = 50
#: Words in a minimiser.
SEED_WORDS = 8
#: Bounds of log2 of the slots of the map of shared minimisers: 2 to 64 MB. Full maps let more through, never less.
MAP_BITS = (24, 29)
_PAGE = 16


def map_bits(docs: DataFrame) -> int:
    """Slots for the map by the size of the input as Spark estimates it: about one for eight bytes, within MAP_BITS."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(MAP_BITS[0], min(MAP_BITS[1], (size // 8).bit_length()))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost minimum of values[i:i+width] for each i; values get their index in the low bits of a pair."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    size = 1
    while 2 * size <= width:  # doubling: best[i] covers values[i:i+size]
        left, right = best[:-size], best[size:]
        best = np.where(values[right] < values[left], right, left)
        size *= 2
    left, right = best[:n], best[width - size : width - size + n]
    return np.where(values[right] < values[left], right, left)


def super_runs(words: Words, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, minimiser's first word, first window, windows) of each run of consecutive windows of a row that share a minimiser."""
    none = np.zeros(0, np.int64)
    counts = np.diff(words.first)
    if len(words) < window or counts.max(initial=0) < window:
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(words) - seed + 1)
    keys = span_hash(words.hashes, at, at + seed)
    best = leftmost_minima(keys, window - seed + 1)
    fits = np.maximum(counts - window + 1, 0)
    starts = np.repeat(words.first[:-1], fits) + (np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits))
    chosen = best[starts]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]
    heads = np.flatnonzero(new)
    return keys[chosen[heads]], chosen[heads], starts[heads], np.diff(np.r_[heads, len(starts)])


def shared_pieces(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(key, minimiser's first word, first word, end word) of each piece: all windows of a run, which begin and end around the minimiser."""
    key, at, first, windows = super_runs(words, window, seed)
    return key, at, first, first + windows + window - 1


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def shared_map(docs: DataFrame, window: int, seed: int, bits: int) -> np.ndarray:
    """Packed bits: 1 for each slot whose minimisers stand in more than one document (or row without an id).

    The counts are of the whole corpus. Each task sends one row for each of its slots; pages of the map come back, at
    most 2^(bits - 16) of them with 8 KB each, so the driver holds no more than the map.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, offsets in text_parts(batch.column(1)):
                words = Words(data, offsets, SPACED)
                keys, _, starts, _ = super_runs(words, window, seed)
                if not len(keys):
                    continue
                slot = slots(keys, bits)
                doc = ids[i:j][np.searchsorted(words.first, starts, side="right") - 1]
                order = np.lexsort((doc, slot))
                slot, doc = slot[order], doc[order]
                heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(slot[heads]), pa.array(doc[heads]), pa.array(doc[np.r_[heads[1:] - 1, len(slot) - 1]])], ["slot", "low", "high"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy()
            for page in np.unique(slot >> _PAGE).tolist():
                at = slot[(slot >> _PAGE) == page] & ((1 << _PAGE) - 1)
                held.setdefault(page, np.zeros(1 << _PAGE, bool))[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["page", "bits"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id() - (1 << 62)), F.col("text").cast("string"))
    seen = rows.transform(arrow, scan, "slot long, low long, high long").groupBy("slot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = seen.filter("low <> high").select("slot")
    parts = min(1 << max(0, bits - _PAGE), 64)
    by_page = shared.repartition(parts, F.shiftright("slot", _PAGE)).transform(arrow, pages, "page long, bits binary")
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    step = 1 << (_PAGE - 3)
    for page, packed in by_page.toLocalIterator():
        out[page * step : page * step + step] |= np.frombuffer(packed, np.uint8)[: len(out)]
    return out


def in_map(packed: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


# ---------------------------------------------------------------- repeated windows
#
# Both repeat finders look at pieces of text (words joined by one space) that hold windows around a shared minimiser.
# Occurrences name each piece of each row by its hashes; carriers hold the text, now and again in each task:
#   key (the piece's minimiser), part (of a crowded bucket), h1 h2 (its hashes), lead (words before the minimiser), doc,
#   a b (name the row), start (first word)
# A bucket is all pieces of a key, or a part of them where they are many. Verdicts of a task are of three kinds:
#   WHOLE: the smallest document of each window of a piece (mins), final as its key has no parts;
#   PIECE: the places (at) of a piece's windows among those of its step; STEP: the distinct windows of a step's parted
#   pieces (wa, wb) with their smallest document there (mins), to be merged with those of the key's other parts.

OCCURRENCES = "key long, h1 long, h2 long, doc long, a long, b long, start int, carries int"
CARRIERS = "key long, part int, h1 long, h2 long, lead int, doc long, packed binary"
VERDICTS = "kind int, h1 long, h2 long, mins array<long>, step long, at array<int>, wa array<long>, wb array<long>"
WHOLE, PIECE, STEP = range(3)
#: Distinct pieces of a bucket (about 0.5 KB each); a key with more is dealt to several buckets by the pieces' hashes.
BUCKET_MOST = 1 << 10
#: Bounds of log2 of the slots that say into how many parts keys are dealt: a byte each, whatever the input.
PART_BITS = (16, 26)
#: Pieces that are worked on together, whole buckets at a time.
STEP_PIECES = 1 << 13
_NO_ID = (1 << 63) - 1


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (the id; the largest number where it is null), row (names a row by id and text)."""
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(ids.alias("doc_id"), text.alias("text"), F.coalesce(ids, F.lit(_NO_ID)).alias("doc"), identity(ids, text).alias("row"))


class Pieces:
    """The pieces of docs whose minimiser the map of shared ones lets through."""

    def __init__(self, docs: DataFrame, window: int, seed: int, bits: int):
        self.docs, self.window, self.seed, self.bits = docs, window, seed, bits
        self.map = docs.sparkSession.sparkContext.broadcast(shared_map(docs, window, seed, bits))

    def _run(self, parts=None):
        """Occurrences, or with the numbers of parts (log2, by slot) carriers."""
        sent, window, seed, bits = self.map, self.window, self.seed, self.bits

        def find(data: np.ndarray, offsets: np.ndarray) -> tuple | None:
            words = Words(data, offsets, SPACED)
            keys, at, first, end = shared_pieces(words, window, seed)
            if not len(keys):
                return None
            go = in_map(sent.value, slots(keys, bits))
            keys, at, first, end = keys[go], at[go], first[go], end[go]
            h1, h2 = span_hash(words.hashes, first, end), span_hash(mix(~words.hashes), first, end)
            return words, keys, at, first, end, h1, h2, np.searchsorted(words.first, first, side="right") - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, int], int] = {}
            for batch in batches:
                docs = batch.column(0).to_numpy()
                a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for i, _, data, offsets in text_parts(batch.column(3)):
                    if (got := find(data, offsets)) is None:
                        continue
                    words, keys, at, first, end, h1, h2, row = got
                    doc = docs[i + row]
                    carries = np.zeros(len(keys), bool)
                    pairs, ids = list(zip(h1.tolist(), h2.tolist(), strict=True)), doc.tolist()
                    for k in np.argsort(doc, kind="stable").tolist():
                        if ids[k] < seen.get(pairs[k], ids[k] + 1):  # a piece comes again only with a smaller document
                            seen[pairs[k]] = ids[k]
                            carries[k] = True
                    if len(seen) > 1 << 17:
                        seen.clear()
                    if parts is None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(a[i + row]), pa.array(b[i + row]), pa.array((first - words.first[row]).astype(np.int32)), pa.array(carries.astype(np.int32))],
                            ["key", "h1", "h2", "doc", "a", "b", "start", "carries"],
                        )
                        continue
                    pick, raw = np.flatnonzero(carries), data.tobytes()
                    logs = parts.value[part_slots(keys[pick], len(parts.value))].astype(np.uint64)
                    part = mix(h1[pick]) & ((np.uint64(1) << logs) - np.uint64(1))
                    left, right = words.starts[first[pick]].tolist(), words.ends[end[pick] - 1].tolist()
                    texts = [b" ".join(raw[x:y].split()) for x, y in zip(left, right, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[pick].view(np.int64)), pa.array(part.astype(np.int32)), pa.array(h1[pick].view(np.int64)), pa.array(h2[pick].view(np.int64)), pa.array((at - first)[pick].astype(np.int32)), pa.array(doc[pick]), pa.array(texts, pa.binary())],
                        ["key", "part", "h1", "h2", "lead", "doc", "packed"],
                    )

        return run

    def _rows(self) -> DataFrame:
        return identified(self.docs).select("doc", "row.a", "row.b", "text")

    def occurrences(self) -> DataFrame:
        return self._rows().transform(arrow, self._run(), OCCURRENCES)

    def carriers(self, parts) -> DataFrame:
        return self._rows().transform(arrow, self._run(parts), CARRIERS)


def part_slots(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


def part_logs(found: DataFrame, most: int) -> np.ndarray:
    """For each slot of keys log2 of the parts that its keys are dealt to; its size is bounded, and so is what is collected for it."""
    n = found.count()
    bits = max(PART_BITS[0], min(PART_BITS[1], (n >> 6).bit_length()))
    full = found.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.sum("carries").alias("n")).filter(F.col("n") > most).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[full.column("slot").to_numpy()] = np.minimum(np.ceil(np.log2(full.column("n").to_numpy() / most)), 30)
    return out


def _window_hashes(words: Packed, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of each window."""
    counts = np.diff(words.first)
    fits = np.maximum(counts - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), fits)
    starts = words.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits))
    return row, span_hash(words.hashes, starts, starts + window), span_hash(mix(~words.hashes), starts, starts + window)


class Packed:
    """The words of packed pieces as hashes, gathered in steps of bounded size; first has rows + 1 numbers."""

    __slots__ = ("first", "hashes")

    def __init__(self, column: pa.Array):
        hashes, first, n = [], [np.zeros(1, np.int64)], 0
        for _, _, data, offsets in text_parts(column):
            words = Words(data, offsets, SPACED)
            hashes.append(words.hashes)
            first.append(words.first[1:] + n)
            n += len(words)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)


def run_minima(order: np.ndarray, new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values' minimum over each run of `order` (a run begins where new), in the original order; values ascend in a run."""
    out = np.empty(len(order), values.dtype)
    heads = np.flatnonzero(new)
    out[order] = np.repeat(values[order][heads], np.diff(np.r_[heads, len(order)]))
    return out


def sorted_minima(words: Packed, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest document) of each window, by sorting the windows and comparing neighbours."""
    row, a, b = _window_hashes(words, window)
    doc = docs[row]
    order = np.lexsort((doc, b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    return row, run_minima(order, new, doc)


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(values, kind))


def repeated_windows(pieces: Pieces, minima, most: int = BUCKET_MOST) -> DataFrame:
    """(row, at array<int>): the first words of windows that also start in a document with a smaller id.

    Pieces travel to the bucket of their minimiser, or to one of its parts where more than `most` share one. There
    minima(words, leads, docs, keys, window) gives (piece, smallest document) of each window, in order of pieces. What
    the parts of a key found is merged window by window, one row for each window of a part, however many pieces hold it.
    """
    window = pieces.window
    found = checkpointed(pieces.occurrences())
    spark = found.sparkSession
    logs = spark.sparkContext.broadcast(part_logs(found, most))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def settle(rows: pa.Table, name: int) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        col = {n: rows.column(n).to_numpy() for n in ("key", "h1", "h2", "lead", "doc")}
        words = Packed(rows.column("packed").combine_chunks())
        row, least = minima(words, col["lead"], col["doc"], col["key"], window)
        first = np.searchsorted(row, np.arange(len(rows) + 1))
        pick = np.unique(np.stack([col["h1"], col["h2"]]), axis=1, return_index=True)[1]
        parted = logs.value[part_slots(col["key"].view(np.uint64), len(logs.value))] > 0

        def batch(kind: int, h1, h2, mins=None, at=None, wa=None, wb=None) -> pa.RecordBatch:
            n = len(h1)
            none = lambda k: pa.nulls(n, pa.list_(k))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), none(pa.int64()) if mins is None else mins, pa.array(np.full(n, name)), none(pa.int32()) if at is None else at, none(pa.int64()) if wa is None else wa, none(pa.int64()) if wb is None else wb],
                ["kind", "h1", "h2", "mins", "step", "at", "wa", "wb"],
            )

        done = pick[~parted[pick]]
        if len(done):
            spans = [least[first[k] : first[k + 1]] for k in done]
            yield batch(WHOLE, col["h1"][done], col["h2"][done], _lists(np.concatenate(spans), [*map(len, spans)], pa.int64()))
        open_ = pick[parted[pick]]
        if len(open_):
            _, a, b = _window_hashes(words, window)
            mine = np.concatenate([np.arange(first[k], first[k + 1]) for k in open_])
            order = np.lexsort((b[mine], a[mine]))
            new = np.r_[True, (a[mine][order][1:] != a[mine][order][:-1]) | (b[mine][order][1:] != b[mine][order][:-1])]
            place = np.empty(len(mine), np.int32)
            place[order] = np.cumsum(new) - 1
            heads = mine[order[new]]
            yield batch(PIECE, col["h1"][open_], col["h2"][open_], at=_lists(place, [int(first[k + 1] - first[k]) for k in open_], pa.int32()))
            each = [len(heads)]
            yield batch(STEP, [None], [None], _lists(least[heads], each, pa.int64()), wa=_lists(a[heads].view(np.int64), each, pa.int64()), wb=_lists(b[heads].view(np.int64), each, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        name = TaskContext.get().partitionId() << 32
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy() * 31 + batch.column(1).to_numpy()
            heads = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            at = 0
            for h in heads.tolist():  # a step ends where a bucket does
                if sum(map(len, held)) + h - at >= STEP_PIECES and (h or keys[0] != last):
                    held.append(pa.Table.from_batches([batch.slice(at, h - at)]))
                    yield from settle(pa.concat_tables(held), name)
                    held, at, name = [], h, name + 1
            held.append(pa.Table.from_batches([batch.slice(at)]))
            last = keys[-1]
        if held:
            yield from settle(pa.concat_tables(held), name)

    buckets = pieces.carriers(logs).repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    told = buckets.transform(arrow, run, VERDICTS)
    verdicts_of = lambda t: t.filter(F.col("kind") == WHOLE).select("h1", "h2", "mins")
    verdicts = verdicts_of(told)
    if logs.value.any():
        told = checkpointed(told)
        windows = told.filter(F.col("kind") == STEP).select("step", F.posexplode(F.arrays_zip("wa", "wb", "mins")).alias("i", "w")).select("step", "i", "w.*")
        # one row for each step that holds a window; only windows of several steps have anything to merge
        shared = windows.groupBy("wa", "wb").agg(F.min("mins").alias("least"), F.collect_list(F.struct("step", "i", "mins")).alias("held")).filter(F.size("held") > 1)
        lower = shared.select("least", F.explode("held").alias("h")).filter("least < h.mins").groupBy("h.step").agg(F.collect_list(F.struct("h.i", "least")).alias("lower"))
        steps = told.filter(F.col("kind") == STEP).select("step", "mins").join(lower, "step", "left").select("step", "mins", F.coalesce(F.col("lower.i"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("lower.least"), F.array().cast("array<long>")).alias("least"))

        def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    mins = batch.column(1)[k].values.to_numpy(zero_copy_only=False).copy()
                    mins[batch.column(2)[k].values.to_numpy(zero_copy_only=False)] = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), _lists(mins, [len(mins)], pa.int64())], ["step", "least"])

        merged = steps.transform(arrow, lowered, "step long, least array<long>")
        parted = told.filter(F.col("kind") == PIECE).select("h1", "h2", "step", "at").join(merged, "step")
        verdicts = verdicts_of(told).unionByName(parted.select("h1", "h2", F.expr("transform(at, i -> least[i])").alias("mins")))
    at = F.expr("filter(transform(mins, (m, i) -> if(m < doc, start + i, null)), x -> x is not null)")
    hit = found.select("h1", "h2", "doc", "a", "b", "start").join(verdicts, ["h1", "h2"]).select(F.struct("a", "b").alias("row"), at.alias("at")).filter(F.size("at") > 0)
    return hit.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def without_repeats(docs: DataFrame, hits: DataFrame, window: int, name: str) -> DataFrame:
    """doc_id, n_words, `name` (words in repeated windows), kept (the other words), spans; rows without any are not shuffled."""
    hits = checkpointed(hits)
    rows = may_hold(identified(docs).select("doc_id", "row", "text"), F.col("row.a"), hits.select("row.a"), "_met")
    met = rows.filter("_met").join(hits, "row", "left").select("doc_id", "text", "at")
    rows = rows.filter("not _met").select("doc_id", "text", F.lit(None).cast("array<int>").alias("at")).unionByName(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, spans = [], [], [], []
            for text, at in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                cut = covered_spans(at.as_py(), window) if at.is_valid else []
                n.append(len(words))
                gone.append(sum(e - s for s, e in cut))
                for s, e in reversed(cut):
                    del words[s:e]
                kept.append(b" ".join(words).decode())
                spans.append([{"start": s, "end": e} for s, e in cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", name, "kept", "spans"],
            )

    return rows.transform(arrow, run, f"doc_id long, n_words long, {name} long, kept string, spans array<struct<start:int,end:int>>")


def covered_spans(at: list[int], window: int) -> list[tuple[int, int]]:
    """The union of windows that start at the given words."""
    out: list[tuple[int, int]] = []
    for s in sorted(at):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out
