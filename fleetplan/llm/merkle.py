"""A Merkle manifest of a table: one hash tree for each group of rows, one root over the groups, a proof for each row.

Leaves of a group are numbered by their key. The octal digits of the number are then grouped away one by one: rows
that share all but the last digit become one row with an array of their structs and the hash of these, and so on,
each array nesting the ones below it. That goes on inside a block of ``8 ** DIGITS`` leaves, which is one row in the end
and never more; all groupings of a block share one exchange. The tops of blocks are the leaves of the next tree
above, narrow and 4,096 times fewer, until each group has one node. Proofs come back down the same structs with
``transform`` and ``explode``: siblings lie in the array a node is taken from, so no join looks for them. Only the path
of a block's top, one row a block, is joined to its block.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A field of a leaf is ``-`` if it
is null, else its UTF-8 byte count, ``:`` and its value.

Null or odd input: a null group is a group of its own and comes first; null keys come first in their group; rows
with equal keys follow each other by their leaf hash, and equal rows are leaves each; empty and very long texts are
hashed whole where they are read, only digests travel; a group of one row has its leaf as root and an empty list of siblings;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.ranks import ranked
from fleetplan.session import stage

FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels of a block: 4,096 leaves, about 600 KB of nested structs.
DIGITS = 4

STEPS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """H of the fields of one row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["h"]), "")


def _nodes_at(level: int) -> Column:
    """Nodes of a tree of ``n`` leaves, ``level`` levels above them."""
    return F.expr(f"(n + {(1 << FAN_BITS * level) - 1}L) >> {FAN_BITS * level}")


def _rolled_up(nodes: DataFrame, digits: int) -> DataFrame:
    """Blocks (tree, n, block, h, kids) of nodes (tree, n, pos, h, item): digits grouped away from the last one on."""
    digit = lambda i: F.expr(f"CAST((pos >> {FAN_BITS * i}) & {FAN - 1} AS INT)").alias(f"d{i}")
    rows = nodes.select("tree", "n", F.expr(f"pos >> {FAN_BITS * digits}").alias("block"), *map(digit, range(digits)), "h", F.col("item").alias("below"))
    rows = rows.repartition("tree", "block")
    for i in range(digits):
        upper = [f"d{j}" for j in range(digits - 1, i, -1)]
        kid = F.struct(F.col(f"d{i}").alias("d"), "h", "below")
        rows = rows.groupBy("tree", "n", "block", *upper).agg(F.sort_array(F.collect_list(kid)).alias("below"))
        # a run of one is hashed too, unless it is all that the tree has left
        top = F.when(_nodes_at(i) > 1, F.sha2(_joined(F.col("below")), 256)).otherwise(F.col("below")[0]["h"])
        rows = rows.withColumn("h", top)
    return rows.withColumnRenamed("below", "kids")


def _opened(blocks: DataFrame, digits: int) -> DataFrame:
    """The nodes of blocks with ``steps``, the path of the block's top, in front of which their own steps come."""
    rows = blocks.withColumnRenamed("kids", "below")
    carried = [c for c in rows.columns if c not in ("below", "h", "steps")]
    for i in range(digits - 1, -1, -1):
        beside = lambda x, j: F.struct(
            x.alias("kid"),
            _joined(F.slice("below", F.lit(1), j)).alias("left"),
            _joined(F.slice("below", j + 2, F.lit(FAN))).alias("right"),
        )
        rows = rows.select(*carried, "steps", F.explode(F.transform("below", beside)).alias("x"))
        own = F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right")))
        steps = F.when(_nodes_at(i) > 1, F.concat(own, F.col("steps"))).otherwise(F.col("steps"))
        rows = rows.select(*carried, steps.alias("steps"), F.col("x.kid.h").alias("h"), F.col("x.kid.below").alias("below"))
    return rows.withColumnRenamed("below", "item")


def _trees(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Stored blocks, level above level, until each tree has a single one."""
    levels = []
    while True:
        blocks = stage(_rolled_up(nodes, digits), "merkle-blocks")
        levels.append(blocks)
        if not (blocks.agg(F.max("block")).first()[0] or 0):
            return levels
        item = F.struct(F.col("block").alias("pos")).alias("item")
        nodes = blocks.select("tree", _nodes_at(digits).alias("n"), F.col("block").alias("pos"), "h", item)


def _paths(levels: list[DataFrame], above: DataFrame, digits: int) -> DataFrame:
    """Nodes of the lowest level with their paths. ``above``: (tree, steps, ...) for each tree's top."""
    extra = [c for c in above.columns if c not in ("tree", "steps")]
    opened = _opened(levels[-1].join(above, "tree"), digits)
    for blocks in reversed(levels[:-1]):
        path = opened.select("tree", F.col("item.pos").alias("block"), "steps", *extra)
        opened = _opened(blocks.join(path, ["tree", "block"]), digits)
    return opened


@dataclass
class Manifest:
    """The stored trees of a table: blocks of the groups' trees, and of the tree over the groups."""

    groups: list[DataFrame]
    roots: list[DataFrame]
    digits: int

    def subroots(self) -> DataFrame:
        """(tree, subroot): ``tree`` is empty for the null group, else ``=`` and the group."""
        return self.groups[-1].select("tree", F.col("h").alias("subroot"))

    def root(self) -> DataFrame:
        """One row with the root of all, none for an empty table."""
        return self.roots[-1].select(F.col("h").alias("root"))

    def proofs(self) -> DataFrame:
        """One row for each leaf: ``leaf``, ``siblings`` (what stands left and right of it, level by level up to the
        root), ``subroot``, ``root`` and the columns carried along."""
        top = self.roots[-1].select("tree", F.col("h").alias("root"), F.array().cast(STEPS).alias("steps"))
        groups = _paths(self.roots, top, self.digits)
        groups = groups.select(F.col("item.tree").alias("tree"), "steps", F.col("h").alias("subroot"), "root")
        leaves = _paths(self.groups, groups, self.digits)
        return leaves.select("item.*", F.col("h").alias("leaf"), F.col("steps").alias("siblings"), "subroot", "root")


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    carried: Mapping[str, Column] | None = None,
    digits: int = DIGITS,
) -> Manifest:
    """The manifest of ``rows``. ``carried``: further (small) columns of a row, kept beside its leaf under their names."""
    extra = carried or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    item = F.struct(F.col(key).alias(key), *[c.alias(name) for name, c in extra.items()])
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("__key"), leaf_hash([F.col(c) for c in fields]).alias("h"), item.alias("item"))
    groups = _trees(ranked(leaves, "tree", ["__key", "h"]).drop("__key"), digits)
    tops = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "h")
    tops = ranked(tops, "tree", ["group"]).withColumn("item", F.struct(F.col("group").alias("tree")))
    return Manifest(groups, _trees(tops.drop("group"), digits), digits)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    """H of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)
