"""Sharding: a k-d tree over the metadata of groups of equal texts, split at distributed weighted medians.

A group (all rows of one text) is one point: its dimensions are the smallest source, language and doc_id in it and
its length; its weight is the bytes of all its rows. A node that is to hold k shards is split along the dimension in
which it is widest, at the weight of floor(k / 2) shards out of k, until every node is one shard. Rows of a group stay
together, so a shard is over the mean only by what its heaviest group forces.

Dimensions are scaled to GRID steps. Within a step, groups are in the order of a hash of their text, so that any
weight can be met however many groups share a source. The median is found by three histograms in turn (step, 12 bits
of the hash, 12 more), each summed on the executors; the driver sees at most shards x dimensions x 4096 sums.

Defined results: a null text counts as empty (bytes 0, crc32 0) and is equal to the empty text; null metadata is the
lowest step; repeated rows are rows of their own, in one group; an empty table gives no rows; other columns are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.storage import forget, written

GRID = 256
FINE = 4096
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Within a shard, rows are numbered in this many parts; a part's rows are ordered in one task.
PARTS = 256
AXES = ["source", "lang", "length", "place"]


@dataclass
class Node:
    """A leaf has a shard; others send groups with (dimension, hash) below (step, fine) to the left."""

    shards: int
    first: int
    number: int
    axis: str = ""
    step: int = 0
    fine: int = 0
    left: Node | None = None
    right: Node | None = None


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def _nodes(root: Node) -> list[Node]:
    """All nodes by number."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest += [x for x in (node.left, node.right) if x]
    return sorted(out, key=lambda n: n.number)


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), place + 1)


def _place(root: Node, axes: list[str]) -> Column:
    """The number of the leaf that a group is in: a walk from the root, a level at a time."""
    nodes = _nodes(root)
    key = F.array(*[F.shiftleft(F.col(a).cast("long"), 24) + F.col("fine") for a in axes])

    def step(n: Column, _: Column) -> Column:
        axis = _at([axes.index(x.axis) if x.left else 0 for x in nodes], n)
        bound = F.element_at(F.array(*[F.lit((x.step << 24) + x.fine).cast("long") for x in nodes]), n + 1)
        sides = [_at([getattr(x, side).number if x.left else x.number for x in nodes], n) for side in ("left", "right")]
        return F.when(F.element_at(key, axis + 1) < bound, sides[0]).otherwise(sides[1])

    depth = max(1, int(np.ceil(np.log2(max(2, root.shards)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _cut(weights: np.ndarray, want: float) -> tuple[int, float]:
    """The bin in which the running sum passes `want`, and the sum before it."""
    upto = np.cumsum(weights)
    at = min(int(np.searchsorted(upto, want, side="right")), len(weights) - 1)
    return at, float(upto[at] - weights[at])


def kd_tree(groups: DataFrame, axes: list[str], shards: int) -> Node:
    """groups: bytes, fine (24 bits of hash) and each axis as a step from 0 to GRID - 1."""
    root = Node(shards, 0, 0)
    level, numbers = [root], 1
    while level := [n for n in level if n.shards > 1]:
        at = groups.withColumn("node", _place(root, axes)).where(F.col("node").isin([n.number for n in level]))
        sums: dict[tuple[int, str], np.ndarray] = {}
        pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("bin")) for a in axes]))
        for r in at.select("node", "bytes", pairs.alias("x")).groupBy("node", "x.axis", "x.bin").agg(F.sum("bytes").alias("b")).collect():
            sums.setdefault((r["node"], r["axis"]), np.zeros(GRID))[r["bin"]] = r["b"]
        want: dict[int, float] = {}
        for n in level:
            width = {a: np.ptp(x) if len(x := np.flatnonzero(sums.get((n.number, a), np.zeros(GRID)))) else 0 for a in axes}
            n.axis = max(axes, key=lambda a: (width[a], -axes.index(a)))
            weights = sums.get((n.number, n.axis), np.zeros(GRID))
            n.step, before = _cut(weights, target := weights.sum() * (n.shards // 2) / n.shards)
            want[n.number] = target - before
        nodes = _nodes(root)
        axis, step = (_at([value(n) if n.number in want else 0 for n in nodes], F.col("node")) for value in (lambda n: axes.index(n.axis) if n.axis else 0, lambda n: n.step))
        inside = at.where(F.element_at(F.array(*axes), axis + 1) == step).withColumnRenamed("node", "cut")
        high = dict.fromkeys(want, 0)
        for fine, shift in ((F.shiftright("fine", 12), 12), (F.col("fine").bitwiseAND(FINE - 1), 0)):
            if not shift:
                inside = inside.where(F.shiftright("fine", 12) == _at([high.get(n.number, -1) for n in nodes], F.col("cut")))
            rows = inside.groupBy("cut", fine.alias("bin")).agg(F.sum("bytes").alias("b")).collect()
            for n in level:
                weights = np.zeros(FINE)
                for r in (r for r in rows if r["cut"] == n.number):
                    weights[r["bin"]] = r["b"]
                bin_, before = _cut(weights, want[n.number])
                want[n.number] -= before
                if shift:
                    high[n.number] = bin_
                else:  # to the nearer side of the group at the border
                    n.fine = (high[n.number] << 12) + bin_ + int(want[n.number] > weights[bin_] / 2)
        for n in level:
            k = n.shards // 2
            n.left, n.right = Node(k, n.first, numbers), Node(n.shards - k, n.first + k, numbers + 1)
            numbers += 2
        level = [x for n in level for x in (n.left, n.right)]
    return root


def points_of(rows: DataFrame) -> DataFrame:
    """group, bytes, fine and each of AXES as a step, for each group of rows (group, size, doc_id, source, lang)."""
    group = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.max("size").alias("length"), F.min("doc_id").alias("place"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    low = group.agg(*[f(c).alias(f"{n}_{c}") for c in ("length", "place") for n, f in (("low", F.min), ("high", F.max))])
    scaled = lambda c, value, lo, hi: F.coalesce(F.least(F.lit(GRID - 1), F.floor((value - lo) / F.nullif(hi - lo, F.lit(0)) * GRID)), F.lit(0)).cast("int").alias(c)
    ln = lambda c: F.log(F.col(c).cast("double"))
    hashed = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(GRID))).cast("int").alias(c)
    return group.crossJoin(F.broadcast(low)).select(
        "group", "bytes", F.shiftrightunsigned("group", 40).cast("int").alias("fine"),
        hashed("source"), hashed("lang"), scaled("length", ln("length"), ln("low_length"), ln("high_length")),
        scaled("place", F.col("place").cast("double"), F.col("low_place").cast("double"), F.col("high_place").cast("double")),
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row: shards near equal in bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    points = written(points_of(rows), "shard-points")
    tree = kd_tree(points, AXES, shards)
    leaf = points.select("group", _place(tree, AXES).alias("leaf"))
    placed = rows.join(leaf.select("group", _at([n.first for n in _nodes(tree)], F.col("leaf")).alias("shard")), "group")
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")), "shard-placed")
    forget(rows, points)
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    out = placed.withColumn("number", number).join(F.broadcast(parts), ["shard", "part"])  # at most shards x PARTS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
