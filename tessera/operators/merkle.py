"""A tree of order-free digests over ranges of hashed keys: what changed between two versions, without joining all rows.

A leaf is a range of the keys' hashes; its digest combines the digests of its
rows in a way that no order changes: their number, the XOR of one hash and the
sum of another.  A node combines its children alike.  Two versions are equal if
their roots are; else only children of unequal nodes are compared, level by
level, and only rows of unequal leaves are joined.

The tree has ``FANOUT ** depth`` leaves; it is one row a leaf that has rows, a
written table of its own that can be kept beside a frozen version.

Cases.  Rows that repeat a key are told apart by their digests and counted.
Null keys and values are values.  An empty table has an empty tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import kept, lookup

FANOUT = 16
_PARTS = ("n", "x", "s")


def _leaf(key: str, depth: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(FANOUT**depth))


def _digests(rows: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row; nulls are told from values, and columns from each other."""
    cells = [x for c in sorted(rows.columns) for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def _combined(table: DataFrame, *by: Column) -> DataFrame:
    return table.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


@dataclass(frozen=True)
class Tree:
    leaves: DataFrame
    depth: int

    def level(self, up: int) -> DataFrame:
        """(node, n, x, s) so many levels above the leaves."""
        return _combined(self.leaves, F.floor(F.col("node") / FANOUT**up).alias("node")) if up else self.leaves


def tree(rows: DataFrame, key: str, depth: int = 3) -> Tree:
    x, s = _digests(rows)
    each = rows.select(_leaf(key, depth).alias("node"), F.lit(1).cast("bigint").alias("n"), x.alias("x"), s.cast("decimal(38, 0)").alias("s"))
    return Tree(kept(_combined(each, F.col("node"))), depth)


def unequal_leaves(a: Tree, b: Tree) -> DataFrame:
    """(node) of the leaves that differ, found from the root down."""
    suspects = None
    for up in range(a.depth, -1, -1):
        sides = [t.level(up).withColumnsRenamed({c: f"{c}_{name}" for c in _PARTS}) for t, name in ((a, "a"), (b, "b"))]
        if suspects is not None:
            sides = [side.join(lookup(suspects), F.floor(F.col("node") / FANOUT) == F.col("parent")).drop("parent") for side in sides]
        same = F.lit(True)
        for c in _PARTS:
            same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        found = kept(sides[0].join(sides[1], "node", "full_outer").filter(~same).select("node"))
        if up == 0 or found.isEmpty():
            return found
        suspects = found.withColumnRenamed("node", "parent")
    return found


def changed(old: DataFrame, new: DataFrame, key: str, before: Tree | None = None, after: Tree | None = None, depth: int = 3) -> DataFrame:
    """(key, change): ``added``, ``removed`` or ``changed``, once for each key whose rows differ; trees that are at hand aren't made again."""
    before, after = before or tree(old, key, depth), after or tree(new, key, depth)
    leaves = unequal_leaves(before, after)
    sides = []
    for rows, name in ((old, "old"), (new, "new")):
        x, s = _digests(rows)
        some = rows.select(F.col(key).alias("__key"), F.col(key).isNull().alias("__null"), _leaf(key, before.depth).alias("node"), F.lit(1).cast("bigint").alias("n"), x.alias("x"), s.cast("decimal(38, 0)").alias("s")).join(lookup(leaves), "node", "left_semi")
        sides.append(_combined(some, F.col("__key"), F.col("__null")).withColumnsRenamed({"__key": f"k_{name}", "__null": f"null_{name}"} | {c: f"{c}_{name}" for c in _PARTS}))
    both = sides[0].join(sides[1], F.col("k_old").eqNullSafe(F.col("k_new")), "full_outer")
    differ = F.lit(False)
    for c in _PARTS:
        differ = differ | ~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    kind = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").otherwise("changed")
    return both.filter(differ).select(F.coalesce("k_new", "k_old").alias(key), kind.alias("change"))
