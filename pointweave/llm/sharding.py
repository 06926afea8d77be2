"""Shards by a hierarchical weighted hash tree, with DataFrame functions alone.

Shards are the leaves of a tree of regions and racks; a node weighs what its leaves weigh. A row
descends from the root: each region makes a draw, an exponential variable of a rate that equals
its weight, from a hash of the row's key and the region's path, and the least one wins; then the
racks of that region draw, then the shards of that rack. So each node gets rows in proportion to
its weight. Draws of nodes whose weight is what it was don't change: with a new weight of a leaf,
rows move into or out of its region, inside that region into or out of its rack, inside that rack
into or out of the leaf; all other subtrees keep what they have, and rows inside them stay.

grown() adds a shard under a region and a rack of its own. No other node's weight changes, so the
new shard takes rows into itself and nothing else moves, whatever the number of shards.

Slots number the rows of a shard without a gap: rows are dealt into blocks by a hash of their key,
about `block_rows` rows a block however the ids are spread, the counts of blocks are summed up in
two steps, and rows are numbered inside their block, so no task gathers a whole shard.

Defined results: rows without an id are left out; null text counts as no byte; repeated rows get
a slot each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


Tree = tuple[Leaf, ...]


def even_tree(shards: int, racks: int = 4, regions: int = 8) -> Tree:
    """Shards 0, 1, ... of one weight: `racks` shards a rack, `regions` shards a region."""
    return tuple(Leaf(i // regions, i // racks, i) for i in range(shards))


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """tree with one more shard, in a rack and a region of its own."""
    return (*tree, Leaf(*(1 + max(getattr(x, level) for x in tree) for level in ("region", "rack", "shard")), weight))


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight for a uniform u in (0, 1) of 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def least(key: Column, path: str, weights: dict[int, float]) -> Column:
    """The child of a node that wins a key; of equal draws the one of the least number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct(draw(key, f"{path}/{k}", w).alias("draw"), F.lit(k).alias("to")) for k, w in weights.items()]))["to"]


def descend(rows: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """rows with the columns region, rack and shard (under a prefix) that a key descends to; nodes without weight get nothing."""
    live = [x for x in tree if x.weight > 0]
    if len({x.shard for x in live}) < len(live):
        raise ValueError("a shard is in one place of the tree")

    def weights(*at: int) -> dict[int, float]:
        """Weight of each child of the node at a path."""
        out: dict[int, float] = {}
        for x in live:
            own = (x.region, x.rack, x.shard)
            if own[: len(at)] == at:
                out[own[len(at)]] = out.get(own[len(at)], 0.0) + x.weight
        return dict(sorted(out.items()))

    def pick(cases: list[tuple[Column, Column]]) -> Column:
        return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])) if len(cases) > 1 else cases[0][1]

    region, rack, shard = (F.col(prefix + n) for n in ("region", "rack", "shard"))
    out = rows.withColumn(prefix + "region", least(key, "", weights()))
    out = out.withColumn(prefix + "rack", pick([(region == r, least(key, f"/{r}", weights(r))) for r in weights()]))
    nodes = [(r, k) for r in weights() for k in weights(r)]
    return out.withColumn(prefix + "shard", pick([((region == r) & (rack == k), least(key, f"/{r}/{k}", weights(r, k))) for r, k in nodes]))


def assign(docs: DataFrame, tree: Tree, other: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot, other_shard (by the tree `other`, null without one)."""
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).filter("doc_id is not null")
    blocks = max(1, -(-docs.select(id_col).count() // block_rows))
    rows = descend(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))), key, tree)
    rows = descend(rows, key, other, "other_") if other else rows.withColumn("other_shard", F.lit(None).cast("int"))

    groups = max(1, int(blocks**0.5))  # of blocks: their counts are summed up first, so that no window is longer than a group or the groups
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.col("block") % groups)
    before = F.sum("n").over(Window.partitionBy("shard", "group").orderBy("block")) - F.col("n")
    sums = counts.groupBy("shard", "group").agg(F.sum("n").alias("n"))
    sums = sums.select("shard", "group", (F.sum("n").over(Window.partitionBy("shard").orderBy("group")) - F.col("n")).alias("ahead"))
    begin = counts.select("shard", "block", "group", before.alias("before")).join(sums, ["shard", "group"]).select("shard", "block", (F.col("before") + F.col("ahead")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.join(begin, ["shard", "block"]).select("doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("begin") + inside).cast("long").alias("slot"), "other_shard")
