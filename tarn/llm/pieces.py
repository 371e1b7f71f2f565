"""SentencePiece sampling and decoding: distinct segmentations by Gumbel top-k over the lattice, without replacement.

A segmentation is a path through the lattice of pieces. Merge models hold ranks and no probabilities, so a piece's
probability follows Zipf's law on its rank; a character that no piece holds is one edge of byte pieces. Every path has
a perturbed log-probability, and the k largest are a sample without replacement. The search is A* on the tree of
partial paths, whose bound - the largest perturbed value below a node - is exact, so every descent ends in the next
sample: children take their parent's value conditioned on the maximum. Siblings that are not descended into stay one
open node with their joint mass until the search comes back to split it. No bound is above the log-probability of its
path so far plus the largest noise, so bounds that are certain to lose are never drawn.

Pieces never cross certain places (before a space; around characters that stand in no longer piece), so the lattice
is a chain of short units; equal units are built once, and kept for the blocks of text to come.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SortedHashes, arrow, mix, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
SEED = 1
#: Characters of whole texts that one step works on.
STEP_CHARS = 1 << 17
#: Edges of kept units beyond which a task forgets them before its next step.
EDGES = 5 << 19
SPACE = "▁"
SAMPLE = "struct<rank:int,n_pieces:long,log_prob:double,perturbed:double,inclusion:double,ids_sha256:string,ids:array<int>>"
_SAMPLE = pa.struct([("rank", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


class Pieces:
    """The vocabulary as a table of hashed piece beginnings, and its log-probabilities."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        names, ids = [], []
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names.append(sp.id_to_piece(i))
                ids.append(i)
        self.unknown = sp.unk_id()
        weight = 1 / (1 + np.minimum([-sp.get_score(i) for i in ids], n).astype(np.float64))
        total = weight.sum() + 256 / (1 + n)
        self.byte_log = float(np.log(1 / (1 + n) / total))
        sizes = np.array([len(x) for x in names])
        self.longest = int(sizes.max())
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(sizes) - sizes
        start = np.repeat(starts, sizes)
        end = np.arange(len(points)) + 1
        hashes = span_hash(points, start, end)
        self.beginnings = SortedHashes(hashes)
        self.piece = np.full(len(self.beginnings), -1, np.int64)
        self.log = np.full(len(self.beginnings), -np.inf)
        at = self.beginnings.find(span_hash(points, starts, starts + sizes))
        self.piece[at] = ids
        self.log[at] = np.log(weight / total)
        longer = {c for x in names if len(x) > 1 for c in x}
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for c in longer]] = True
        self.cut_spaces = not any(a != SPACE and b == SPACE for x in names for a, b in zip(x, x[1:], strict=False))


class Lattices:
    """Forward edges of many units, the log-probability of each at its start, given that the path goes on to the end, that of
    its siblings together, and the first edge that can follow it (-1 at the end of the unit)."""

    def __init__(self, points: np.ndarray, first: np.ndarray, pieces: Pieces):
        n, units = len(points), len(first) - 1
        unit = np.repeat(np.arange(units), np.diff(first))
        limit = first[1:][unit]
        values = points.astype(np.uint64) + np.uint64(1)
        starts = np.arange(n)
        found = []
        covered = np.zeros(n, bool)
        for size in range(1, pieces.longest + 1):
            starts = starts[starts + size <= limit[starts]]
            if not len(starts):
                break
            at = pieces.beginnings.find(span_hash(values, starts, starts + size))
            go = at >= 0
            starts, at = starts[go], at[go]
            whole = pieces.piece[at] >= 0
            found.append((starts[whole], np.full(whole.sum(), size), pieces.piece[at[whole]], pieces.log[at[whole]]))
            if size == 1:
                covered[starts[whole]] = True
        bare = np.flatnonzero(~covered)
        cp = points[bare]
        width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        ids = np.where((width == 1) & (pieces.bytes[np.minimum(cp, 255)] >= 0), pieces.bytes[np.minimum(cp, 255)], -1 - cp.astype(np.int64))
        found.append((bare, np.ones(len(bare), np.int64), ids, width * pieces.byte_log))
        start, size, self.ids, log = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        left = limit[start] - start
        order = np.argsort((left * n + start) * (pieces.longest + 1) + pieces.longest - size)
        start, size, left, self.ids, log = start[order], size[order], left[order], self.ids[order], log[order]
        src = start + unit[start]
        dst = src + size
        head = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if n else np.zeros(0, np.int64)
        heads = np.full(n + units, -1, np.int64)  # none at the end of a unit
        heads[src[head]] = head
        self.next, self.starts = heads[dst], heads[first[:-1] + np.arange(units)]
        after = np.zeros(n + units)
        bounds = np.searchsorted(left, np.arange(1, left.max(initial=0) + 2))
        at_head = np.searchsorted(head, bounds)
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                continue
            own = head[at_head[k] : at_head[k + 1]]
            x = log[a:b] + after[dst[a:b]]
            top = np.maximum.reduceat(x, own - a)
            after[src[own]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.r_[own, b]))), own - a))
        self.log = np.minimum(log + after[dst] - after[src], 0)
        with np.errstate(divide="ignore"):
            self.open = np.log(-np.expm1(self.log)).astype(np.float32)
        # summed up within each node, so that what a unit holds depends on the unit only
        self.cum = np.exp(self.log)
        stop = np.r_[head[1:], len(self.log)]
        at = head + 1
        while len(at):
            live = at < stop
            at, stop = at[live], stop[live]
            self.cum[at] += self.cum[at - 1]
            at = at + 1
        if n:
            self.cum[np.r_[head[1:] - 1, len(self.log) - 1]] = np.inf


class Units:
    """The lattices of the units that a task has met. The same words come again and again; beyond `most` edges it begins anew."""

    def __init__(self, pieces: Pieces, most: int = EDGES):
        self.pieces, self.most = pieces, most
        room = most + most // 4  # pages that are not touched take no memory
        self.ids, self.next, self.open = np.zeros(room, np.int32), np.zeros(room, np.int32), np.zeros(room, np.float32)
        self.log, self.cum = np.zeros(room), np.zeros(room)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.edges = 0

    def starts(self, points: np.ndarray, keys: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first edge of each unit: its key (ascending, distinct), and where it stands in points."""
        if self.edges > self.most:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            offset = np.r_[0, np.cumsum(sizes[new])]
            made = Lattices(points[np.repeat(first[new] - offset[:-1], sizes[new]) + np.arange(offset[-1])], offset, self.pieces)
            self.keys, self.first = np.insert(self.keys, at[new], keys[new]), np.insert(self.first, at[new], made.starts + self.edges)
            self._add(made)
        return self.first[np.searchsorted(self.keys, keys)]

    def _add(self, made: Lattices) -> None:
        edges = self.edges + len(made.ids)
        if edges > 1 << 30:
            raise ValueError("a text of this length has too many pieces for one lattice")

        def put(held: np.ndarray, more: np.ndarray) -> np.ndarray:
            if edges > len(held):
                held = np.concatenate([held[: self.edges], np.zeros(max(self.edges // 2, len(more)), held.dtype)])
            held[self.edges : edges] = more
            return held

        self.ids, self.log, self.open, self.cum = put(self.ids, made.ids), put(self.log, made.log), put(self.open, made.open), put(self.cum, made.cum)
        self.next = put(self.next, np.where(made.next >= 0, made.next + self.edges, -1))
        self.edges = edges

    def walk(self, firsts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, edges of each walk): a random path from each first edge to the end of its unit, by the seeds
        alone; from -1, which is the end, none."""
        live = np.flatnonzero(firsts >= 0)
        edge, state, steps, count = firsts[live], seeds[live], [], np.zeros(len(firsts), np.int64)
        while len(live):
            u = uniform(state)
            more = np.flatnonzero(u >= self.cum[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.cum[edge[more]]]
            steps.append((live, edge))
            count[live] += 1
            after = self.next[edge]
            go = np.flatnonzero(after >= 0)
            live, edge, state = live[go], after[go].astype(np.int64), state[go] + np.uint64(0xA24BAED4963EE407)
        offset = np.cumsum(count) - count
        out = np.zeros(count.sum(), np.int64)
        for k, (at, edge) in enumerate(steps):
            out[offset[at] + k] = edge
        return out, count

    def siblings(self, edge: int) -> range:
        head = stop = edge
        while head and self.cum[head - 1] != np.inf:
            head -= 1
        while self.cum[stop] != np.inf:
            stop += 1
        return range(head, stop + 1)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit states."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


def below(value: float, free: float) -> float:
    """The largest perturbed value of a set of paths, given that it is below `value`; `free` is what it would be without that.

    It grows with `free`, so of many sets under one value the one with the largest `free` leads.
    """
    low, gap = min(value, free), abs(value - free)
    return low - math.log1p(math.exp(-gap)) if low > -math.inf else low


#: More than the largest noise that `gumbel` gives, and the rounding of a sum of logarithms.
MOST_NOISE = 40.0
#: Steps whose bounds are drawn at a time.
AHEAD = 512
_STEP = 0xC2B2AE3D27D4EB4F


class Path:
    """A segmentation that was found, with what is open beside each of its steps.

    The steps that `before` is given for are open in another path already. `before` and `free` (the log-probability before
    each step, and the perturbed value of what is open beside it, were it not below the path's own) are known for as many
    steps as they are long; no later step's value is above the path's log-probability there plus MOST_NOISE. `again` holds
    the values of open nodes that were split.
    """

    __slots__ = ("again", "before", "best", "edges", "free", "gone", "lattices", "log_prob", "mass", "noise", "units", "value")

    def __init__(self, lattices: Units, edges: np.ndarray, units: np.ndarray, before: np.ndarray, mass: float, noise: np.uint64, log_prob: float, value: float):
        self.lattices, self.edges, self.units, self.before, self.mass, self.noise = lattices, edges, units, before, mass, noise
        self.log_prob, self.value = log_prob, value
        self.free = np.full(len(before), -np.inf)
        self.gone: dict[int, list[int]] = {}
        self.again: dict[int, float] = {}
        self.look()

    def look(self) -> None:
        """The largest open node beside the path: (value, step)."""
        while True:
            m = int(self.free.argmax()) if len(self.free) else -1
            top = float(self.free[m]) if m >= 0 else -np.inf
            self.best = max([(below(self.value, top), m), *((v, k) for k, v in self.again.items())]) if top > -np.inf or self.again else (-np.inf, -1)
            if len(self.free) == len(self.edges) or self.best[0] >= self.mass + MOST_NOISE:
                return
            self._ahead()

    def _ahead(self) -> None:
        """The values of the next steps."""
        a = len(self.free)
        b = min(max(a + AHEAD, 2 * a), len(self.edges))
        edges, sums = self.edges[a:b], np.empty(b - a + 1)
        sums[0] = self.mass
        np.cumsum(self.lattices.log[edges], out=sums[1:])
        sums[1:] += self.mass
        free = sums[:-1] + self.lattices.open[edges] + gumbel(self.noise + np.arange(a, b, dtype=np.uint64) * np.uint64(_STEP))
        self.before, self.free, self.mass = np.concatenate([self.before, sums[:-1]]), np.concatenate([self.free, free]), float(sums[-1])


def _stream(seeds: np.ndarray, stream: int) -> np.ndarray:
    return mix(seeds ^ np.uint64(stream * 0x9FB21C651E98DF25 & ((1 << 64) - 1)))


def path_logs(lattices: Units, edges: np.ndarray, bounds: np.ndarray) -> list[float]:
    """The log-probability of each path, summed within it; an empty one has 0."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(lattices.log[edges], bounds[some])
    return out.tolist()


def split(path: Path, value: float, m: int, state: int) -> int:
    """The sibling that holds the open node's maximum; the rest of them stay open under it."""
    lattices = path.lattices
    gone = path.gone.setdefault(m, [int(path.edges[m])])
    others = [e for e in lattices.siblings(gone[0]) if e not in gone]
    shares = [math.exp(lattices.log[e]) for e in others]
    u, noise = uniform(np.array([state, state ^ 0x5555], np.uint64) + np.uint64(m * _STEP & ((1 << 64) - 1))).tolist()
    u, k = u * sum(shares), 0
    while k < len(others) - 1 and u >= shares[k]:
        u -= shares[k]
        k += 1
    gone.append(others[k])
    rest = sum(shares) - shares[k]
    path.free[m] = -np.inf
    path.again[m] = below(value, float(path.before[m]) + math.log(rest) - math.log(-math.log(noise))) if len(others) > 1 and rest > 0 else -np.inf
    path.look()
    return others[k]


def sample_block(texts: list[str], seeds: np.ndarray, lattices: Units, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to `samples` distinct segmentations: (ids, log-probability, perturbed value, inclusion probability)."""
    pieces = lattices.pieces
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row_first = np.r_[0, np.cumsum([len(x) for x in marked])]
    n = len(points)
    cut = np.zeros(n, bool)
    if n:
        joins, space = pieces.joins[points], points == ord(SPACE)
        cut[1:] = ~joins[1:] | ~joins[:-1] | (pieces.cut_spaces & space[1:] & ~space[:-1])
        cut[row_first[:-1][row_first[:-1] < n]] = True
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], n]
    hashes = span_hash(points.astype(np.uint64) + np.uint64(1), first, last)
    order = np.argsort(hashes)
    new = np.r_[True, np.diff(hashes[order]) > 0][: len(order)]
    keys, pick, unit = hashes[order[new]], order[new], np.empty(len(order), np.int64)
    unit[order] = np.cumsum(new) - 1
    starts = lattices.starts(points, keys, first[pick], (last - first)[pick])
    row_units = np.searchsorted(first, row_first)
    row_of = np.repeat(np.arange(len(texts)), np.diff(row_units))
    ordinal = np.arange(len(first)) - row_units[row_of]
    begin = starts[unit]

    def streams(which: np.ndarray, stream: int) -> np.ndarray:
        return mix(seeds[row_of[which]] ^ np.uint64(stream * 0xD1B54A32D192ED03 & ((1 << 64) - 1)) ^ mix(ordinal[which].astype(np.uint64) + np.uint64(1)))

    every = np.arange(len(first))
    edges, count = lattices.walk(begin, streams(every, 0))
    bounds = np.r_[0, np.cumsum(count)][row_units]
    units = np.repeat(every, count)
    none, cuts = np.zeros(0), bounds.tolist()
    noise = _stream(seeds, 1)
    found = [[Path(lattices, edges[a:b], units[a:b], none, 0.0, s, p, v)] for a, b, s, p, v in zip(cuts, cuts[1:], noise, path_logs(lattices, edges, bounds), gumbel(seeds).tolist(), strict=False)]

    def best(paths: list[Path]) -> Path:
        return max(paths, key=lambda p: p.best[0])

    for k in range(1, samples):
        todo, states = [], _stream(seeds, 2 * k).tolist()
        for r, paths in enumerate(found):
            p = best(paths)
            value, m = p.best
            if value > -np.inf:
                todo.append((r, value, p, m, split(p, value, m, states[r])))
        if not todo:
            break
        at = [int(t[2].units[t[3]]) for t in todo]
        spans = [np.arange(u, row_units[t[0] + 1]) for u, t in zip(at, todo, strict=True)]
        which = np.concatenate(spans)
        begins = np.cumsum([0, *map(len, spans)])
        firsts = begin[which]
        firsts[begins[:-1]] = lattices.next[[t[4] for t in todo]]
        tail, tail_count = lattices.walk(firsts, streams(which, k))
        tail_bounds = np.r_[0, np.cumsum(tail_count)][begins]
        tail_units = np.repeat(which, tail_count)
        cuts, noise = tail_bounds.tolist(), _stream(seeds, 2 * k + 1)
        for (r, value, p, m, edge), a, b, log in zip(todo, cuts, cuts[1:], path_logs(lattices, tail, tail_bounds), strict=False):
            mass = float(p.before[m] + lattices.log[edge])
            found[r].append(Path(lattices, np.r_[p.edges[:m], edge, tail[a:b]], np.r_[p.units[: m + 1], tail_units[a:b]], p.before[: m + 1], mass, noise[r], mass + log, value))
    out = []
    for paths in found:
        limit = best(paths).best[0]
        got = []
        for p in paths:
            ids = lattices.ids[p.edges]
            if len(ids) and ids.min() < 0:
                ids = np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [int(pieces.bytes[c]) if pieces.bytes[c] >= 0 else pieces.unknown for c in chr(-1 - i).encode()])], np.int64)
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(p.log_prob - limit, 50.0))))
            got.append((ids.astype(np.int32), p.log_prob, p.value, inclusion))
        out.append(got)
    return out


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Decoder:
    """The text of id lists: the bytes of their pieces, joined; whatever needs the library's rules is left to it.

    Those are control and unknown pieces, bytes that are no UTF-8, and beginnings other than the one space that encoding put there.
    """

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = lambda i: None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.pieces = np.array([bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else plain(i) for i in range(sp.get_piece_size())], object)

    def __call__(self, ids: np.ndarray | list[int]) -> bytes:
        """UTF-8 of the text."""
        if not len(ids):
            return b""
        try:
            raw = b"".join(self.pieces[ids].tolist())
            if raw[:1] == b" " and raw[1:2] != b" ":
                raw.decode()
                return raw[1:]
        except (TypeError, UnicodeDecodeError):
            pass
        return self.sp.decode(ids if isinstance(ids, list) else ids.tolist()).encode()


def encoded(docs: DataFrame, model: bytes, samples: int = SAMPLES, seed: int = SEED, key: str = "doc_id", with_ids: bool = True, decode: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, samples (array of rank, n_pieces, log_prob, perturbed, inclusion, ids_sha256, ids).

    Samples of a text are distinct, in order of their perturbed log-probabilities; `inclusion` is the probability that
    a segmentation is among them, given the next largest value (for weighted estimates). They depend on the text, the
    row key and the seed only; repeated rows get the same ones, and a null key counts as a key of its own. A null text
    has no samples, an empty text the empty one, and a text with fewer segmentations has those. ids is null unless asked for.
    With decode each sample also has text_sha256, that of the text its ids decode to, found where the ids are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([*_SAMPLE, pa.field("text_sha256", pa.string())]) if decode else _SAMPLE
    sample = SAMPLE[:-1] + ", text_sha256:string>" if decode else SAMPLE
    state = F.xxhash64(F.col(key).cast("string"), F.lit(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Pieces(sent.value))
        text_of = Decoder(sent.value) if decode else None
        for batch in batches:
            texts, seeds = batch.column(1).to_pylist(), batch.column(2).to_numpy().view(np.uint64)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= STEP_CHARS):
                    size += len(texts[j] or "")
                    j += 1
                rows = []
                for text, got in zip(texts[i:j], sample_block([t or "" for t in texts[i:j]], mix(seeds[i:j]), units, samples), strict=True):
                    rows.append(None if text is None else [{"rank": k + 1, "n_pieces": len(ids), "log_prob": p, "perturbed": v, "inclusion": w, "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), "ids": ids if with_ids else None} | ({"text_sha256": hashlib.sha256(text_of(ids)).hexdigest()} if text_of else {}) for k, (ids, p, v, w) in enumerate(got)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x or [] for x in rows], pa.list_(kind))], ["doc_id", "samples"])
                i = j

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string"), state.alias("state"))
    return rows.transform(arrow, run, f"doc_id long, samples array<{sample}>")


def decoded(rows: DataFrame, model: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and text: the text of each id list; null for null. Byte pieces that are no UTF-8 become U+FFFD."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            texts = [None if x is None else sp.decode(x) if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    taken = rows.select(F.col(ids).alias("_ids"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[1:]) + ", text string"
    return taken.transform(arrow, run, schema)


def round_trip(docs: DataFrame, model: bytes, samples: int = SAMPLES) -> DataFrame:
    """One row for each sample of each row of docs: the fields of encoded but ids, and text_sha256 of what its ids decode to.

    A row without samples (a null text) is one row of nulls.
    """
    found = encoded(docs, model, samples, with_ids=False, decode=True)
    return found.select("doc_id", F.explode_outer("samples").alias("s")).select("doc_id", "s.rank", "s.n_pieces", "s.log_prob", "s.perturbed", "s.inclusion", "s.ids_sha256", "s.text_sha256")
