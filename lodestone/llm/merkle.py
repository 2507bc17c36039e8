"""Merkle manifest of a dataset: levels of digests built bottom-up, proofs pushed top-down.

Each row is a leaf. In every group (a source) the leaves stand in the order of
their ids, and runs of ARITY nodes become the digest of their digests, level by
level, until one node is left: the group's subroot. Subroots in the order of
their groups give the root in the same way. Every level is a stored table
(group, index, n, digest, kids), made by one aggregate over the level below. A
proof is made from the top: a level's nodes meet their parents on (group, index
div ARITY), take the parent's proof suffix and put their own siblings before
it. Only the root and the size of the largest group come to the driver; a hot group is spread by its indexes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common

#: Children of a node.
ARITY = 3
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenated text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, node, lambda at, step: digest(step["before"], at, step["after"]))


def proof_digest(steps: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class Tree:
    """``levels[0]`` has the nodes the tree was made of, each next one the parents of the one before."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(grp, digest) of each group."""
        out = None
        for level in self.levels:
            here = level.where("n = 1").select("grp", "digest")
            out = here if out is None else out.unionByName(here)
        return out


def _above(column: str, plus: int = 0) -> Column:
    return F.expr(f"({column} + {plus}) div {ARITY}")


def _indexed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows (grp, ...) with their ``index`` in the group's order and the group's size ``n``; and the largest size.

    Rows are sorted in ranges of (group, order) and stored; a row's place in its
    file, and the counts of (group, file), give its index. Groups and nulls sort
    bytewise, nulls first; rows with equal order have equal digests.
    """
    by = [F.col(c).asc_nulls_first() for c in ["grp", *order]]
    made = common.stage(rows, "leaves")
    stored = common.stage(made.repartitionByRange(*by).sortWithinPartitions(*by), "sorted")
    common.drop(made)
    placed = stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = placed.groupBy("grp", "file").agg(F.min("row").alias("lo"), F.count("*").alias("here"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    group = Window.partitionBy("grp")
    before = group.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("grp").alias("g"), F.col("file").alias("f"), (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("lo")).alias("shift"), F.sum("here").over(group).alias("n"))
    starts = common.stage(starts, "starts")
    joined = placed.join(common.small(starts), F.col("grp").eqNullSafe(F.col("g")) & (F.col("file") == F.col("f")))
    return joined.select(*rows.columns, (F.col("row") + F.col("shift")).alias("index"), "n"), starts.agg(F.max("n")).first()[0] or 0


def build(nodes: DataFrame, order: list[str]) -> Tree:
    """The tree of ``nodes`` (grp, digest, and other columns that stay on level 0), each group in the given order."""
    level, largest = _indexed(nodes, order)
    levels = [level]
    while largest > 1:
        place = F.pmod("index", F.lit(ARITY))
        kids = [F.max(F.when(place == i, F.col("digest"))) for i in range(ARITY)]
        parents = level.where("n > 1").groupBy("grp", _above("index").alias("index"), _above("n", ARITY - 1).alias("n")).agg(F.array_compact(F.array(*kids)).alias("kids"))
        level = common.stage(parents.withColumn("digest", digest(F.array_join("kids", ""))), "level")
        levels.append(level)
        largest = -(-largest // ARITY)
    return Tree(levels)


def push(tree: Tree, inherited: DataFrame | None = None) -> DataFrame:
    """Level 0 with ``steps``, each node's proof: its siblings and its ancestors', the lowest first.

    ``inherited`` (grp, steps) has the proofs of the groups' roots in a tree above; without it they are empty.
    """
    above = None
    for number, level in reversed(list(enumerate(tree.levels))):
        # level 0 has more columns, and no children
        shown = [c for c in level.columns if c not in ("index", "n")]
        alone = level.where("n = 1")
        if inherited is None:
            alone = alone.withColumn("steps", F.array().cast(STEPS))
        else:
            alone = alone.join(inherited.select(F.col("grp").alias("g"), "steps"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
        out = alone.select(*shown, "index", "steps")
        if above is not None:
            parents = above.select(F.col("grp").alias("g"), F.col("index").alias("parent"), F.col("kids").alias("run"), F.col("steps").alias("suffix"))
            met = level.where("n > 1").join(parents, F.col("grp").eqNullSafe(F.col("g")) & (_above("index") == F.col("parent")))
            place = F.pmod("index", F.lit(ARITY)).cast("int")
            own = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(ARITY)), "").alias("after"))
            out = out.unionByName(met.select(*shown, "index", F.concat(F.array(own), "suffix").alias("steps")))
        above = common.stage(out, "proofs") if number else out
    return above


def manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, changed_leaf, subroot, root, steps) of each row.

    ``columns`` enter a leaf in their order; where ``changed`` has expressions
    for some of them, changed_leaf is the leaf of the row so changed, to be
    folded with the proof of the row as it was. A null value counts as ``-``;
    null ids come first, null groups are a group of their own and the first.
    Repeated rows are leaves of their own; rows that share an id stand in the
    order of their leaves. Very long texts are digested inside their row. An
    empty table gives no rows, other columns are not read.
    """
    values = [F.col(f"`{c}`") for c in columns]
    after = [(changed or {}).get(c, v) for c, v in zip(columns, values, strict=True)]
    leaves = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf(*values).alias("digest"), (leaf(*after) if changed else F.lit(None).cast("string")).alias("changed_leaf")
    )
    tree = build(leaves, ["id", "digest"])
    roots = common.stage(tree.roots(), "roots")
    top = build(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "digest"), ["key"])
    root = top.roots().first()
    shown = push(top).select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "steps")
    groups = common.stage(shown, "groups")
    proved = push(tree, groups.select("grp", "steps"))
    named = common.small(groups).select(F.col("grp").alias("g"), "subroot")
    shown = proved.join(named, F.col("grp").eqNullSafe(F.col("g")))
    return shown.select("id", "grp", F.col("digest").alias("leaf"), "changed_leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps")
