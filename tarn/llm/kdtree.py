"""Sharding by a k-d tree: documents are split again and again at weighted medians until every leaf has its share of bytes.

A node that is to become several shards takes the dimension along which its documents spread widest (as a share of the
whole table's spread; the first named wins a tie), sorts by it, then by doc_id, text_crc32 and row, and is cut where the
bytes before the cut come nearest to the left shards' share. As rows break every tie, a source or a group of copies that
holds a third of all documents is cut like anything else, and sizes differ by at most a document a level.

No row is sorted to find a cut. A cut is found in passes: sums of bytes over BINS bins of the key for all nodes of a level
at once, then over BINS bins within the one that holds the median, until it is a single row. What a pass brings to the
driver is bounded by BINS and the number of shards. Rows travel once, as four numbers, to be numbered within their shards.

Defined results: a null text has no bytes (size 1, text_crc32 0); a null in a dimension or an id counts as -1; rows that
share id and text are told apart by their place in the checkpoint, and so are interchangeable. With fewer rows than
shards some shards stay empty; an empty table gives no rows. A text dimension is ordered by its first seven bytes. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.llm.common import checkpointed

#: Bins of one pass over one node.
BINS = 4096
DIMENSIONS = ("source", "lang")


@dataclass
class _Node:
    """A part of the tree: `shards` leaves from number `first`; cut (dimension, key of the last row of the left side) once known."""

    first: int
    shards: int
    weight: int = 0
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    axis: str | None = None
    cut: tuple[int, ...] | None = None
    before: int = 0
    box: list[tuple[int, int]] | None = None
    left: _Node | None = None
    right: _Node | None = None


#: What breaks ties along a dimension, in order.
_TIES = ("k_id", "text_crc32", "row")


def _keys(axis: str) -> list[Column]:
    return [F.col(c) for c in (axis, *_TIES)]


def _named(keys: list[Column]) -> Column:
    return F.struct(*[k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)])


def _place(node: _Node, leaf) -> Column:
    """An expression over the tree as it stands; leaf(node) where it ends."""
    if node.left is None:
        return leaf(node)
    if node.cut is None:
        return _place(node.right, leaf)
    at = _named(_keys(node.axis)) <= _named([F.lit(v) for v in node.cut])
    return F.when(at, _place(node.left, leaf)).otherwise(_place(node.right, leaf))


def _leaves(node: _Node) -> list[_Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _ranked(name: str, docs: DataFrame) -> Column:
    """A dimension as a number: integers as they are, text by its first seven bytes, null as -1."""
    col = F.col(name)
    if isinstance(docs.schema[name].dataType, StringType):
        col = F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0"), 16, 10)
    return F.coalesce(col.cast("long"), F.lit(-1).cast("long"))


def _bin(node: _Node) -> tuple[Column, Column]:
    """(whether a row lies in the node's box, its bin there): bins of a power of two along the first key that is still open."""
    inside = F.lit(True)
    for key, (lo, hi) in zip(_keys(node.axis), node.box, strict=True):
        if lo < hi:
            shift = max(0, (hi - lo).bit_length() - BINS.bit_length() + 1)
            return inside & key.between(F.lit(lo), F.lit(hi)), F.shiftright(key, shift) - F.lit(lo >> shift)
        inside = inside & (key == F.lit(lo))
    return inside, F.lit(0).cast("long")


def _cut(light: DataFrame, root: _Node, open_nodes: list[_Node]) -> None:
    """One pass: each open node's box shrinks to the bin that holds its cut, or the cut is found."""
    names = {id(n): i for i, n in enumerate(open_nodes)}
    nowhere = F.lit(None).cast("struct<node:int,bin:bigint,key:struct<k0:bigint,k1:bigint,k2:bigint,k3:bigint>>")

    def leaf(node: _Node) -> Column:
        if id(node) not in names:
            return nowhere
        inside, at = _bin(node)
        return F.when(inside, F.struct(F.lit(names[id(node)]).alias("node"), at.alias("bin"), _named(_keys(node.axis)).alias("key")))

    sums = (
        light.select("size", _place(root, leaf).alias("at"))
        .filter("at is not null")
        .groupBy("at.node", "at.bin")
        .agg(F.sum("size").alias("size"), F.count("*").alias("rows"), *[f(f"at.key.k{i}").alias(f"{n}{i}") for i in range(4) for f, n in ((F.min, "lo"), (F.max, "hi"))])
        .collect()
    )
    bins: dict[int, list] = {}
    for r in sums:
        bins.setdefault(r["node"], []).append(r)
    for i, node in enumerate(open_nodes):
        k, left = node.shards, node.shards // 2
        done = node.before
        for r in sorted(bins[i], key=lambda r: r["bin"]):
            if (done + r["size"]) * k >= node.weight * left:
                break
            done += r["size"]
        if r["rows"] > 1:
            node.before, node.box = done, [(r[f"lo{j}"], r[f"hi{j}"]) for j in range(4)]
        else:
            # the row that the cut falls on goes to the nearer side; the last key is the row's own number
            over, under = (done + r["size"]) * k - node.weight * left, node.weight * left - done * k
            node.cut, node.box = (r["lo0"], r["lo1"], r["lo2"], r["lo3"] - (over > under)), None


def tree(light: DataFrame, axes: list[str], shards: int) -> _Node:
    """The k-d tree of the table (size, text_crc32, k_id, row and the axes)."""
    measures = [F.sum("size").alias("weight"), *[f(a).alias(f"{n}_{a}") for a in dict.fromkeys([*axes, *_TIES]) for f, n in ((F.min, "lo"), (F.max, "hi"))]]
    root = _Node(0, shards)
    level = [root]
    spread: dict[str, int] = {}
    while level := [n for n in level if n.shards > 1]:
        names = {id(n): i for i, n in enumerate(level)}
        node = _place(root, lambda n: F.lit(names.get(id(n))).cast("int"))
        found = {r["node"]: r for r in light.withColumn("node", node).filter("node is not null").groupBy("node").agg(*measures).collect()}
        for i, n in enumerate(level):
            n.left, n.right = None, None
            if i not in found:
                continue
            r = found[i]
            n.weight, n.ranges = r["weight"], {a: (r[f"lo_{a}"], r[f"hi_{a}"]) for a in (*axes, *_TIES)}
            if n is root:
                spread = {a: hi - lo for a, (lo, hi) in n.ranges.items()}
            n.axis = max(axes, key=lambda a: ((n.ranges[a][1] - n.ranges[a][0]) / spread[a] if spread[a] else 0.0, -axes.index(a)))
            n.box = [n.ranges[a] for a in (n.axis, *_TIES)]
        while open_nodes := [n for n in level if n.box is not None]:
            _cut(light, root, open_nodes)
        for n in level:
            half = n.shards // 2
            n.left, n.right = _Node(n.first, half), _Node(n.first + half, n.shards - half)
        level = [side for n in level for side in (n.left, n.right)]
    return root


def shards(docs: DataFrame, count: int = 16, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row's shard and its gapless place there, in order of doc_id.

    Sizes are UTF-8 bytes plus 1. With target_bytes, as many shards as keep their mean at or below it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    axes = [f"d{i}" for i in range(len(dimensions))] + ["size", "k_id"]
    light = checkpointed(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _ranked("doc_id", docs).alias("k_id"),
            *[_ranked(d, docs).alias(f"d{i}") for i, d in enumerate(dimensions)],
            F.monotonically_increasing_id().alias("row"),
        )
    )
    if target_bytes:
        count = max(1, -(-(light.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    root = tree(light, axes, count)
    placed = light.select("doc_id", "size", "text_crc32", "row", "k_id", _place(root, lambda n: F.lit(n.first)).alias("shard"))
    return numbered(placed, ["shard"], ["k_id", "text_crc32", "row"]).select("doc_id", "size", "text_crc32", "shard", F.col("place").alias("slot"))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, their gapless number from 0 within a group in the given order, with no group in one task.

    The rows are dealt by ranges of (group, order) and numbered within each range; ranges and groups, which are few, give
    the offsets. `order` must tell the rows of a group apart, so that no range is larger than another by ties.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = checkpointed(rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).select("*", F.spark_partition_id().alias("_part"), index.alias("_index")))
    counts = ranged.groupBy("_part", *groups).agg(F.min("_index").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.expr(f"sum(_n) over (partition by {', '.join(groups)} order by _part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = counts.select("_part", *groups, (before - F.col("_from")).alias("_offset"))
    # one row for a range, and one more for each group that begins within a range
    return ranged.join(F.broadcast(offsets), ["_part", *groups]).withColumn("place", F.col("_index") + F.col("_offset")).drop("_part", "_index", "_offset")
