"""A Merkle manifest of a table: one root for all rows, and for each row the witness that it is under it.

Rows are leaves. Within a group (here a language) they are in order and every `fan` consecutive nodes
become their parent, level by level, until one node, the group's root, is left; the groups' roots, in
order, are the leaves of one more such tree.

The witnesses are built incrementally, by appending. `Appender` takes the nodes of a tree from left to
right and holds only its open subtrees, fewer than `fan` nodes a level, with the members below each of
them. When the last sibling of a run arrives, the run closes: its parent moves up a level, and the
partial witness of every member is extended with the siblings on its side of the tree.

No task appends a whole group. Leaves, ranked within their group, are dealt into aligned blocks of
fan^BLOCK_LEVELS; a block is appended by one task and closes into one root, and the roots of all blocks
are appended further, as nodes some levels up, in blocks again, until a single root is left. Then the
witnesses come down: a block's own witness reaches its task beside the block's leaves and is appended
to each of theirs. Only digests move between tasks, about 150 bytes a row, twice; and one witness a block.

Ranks come from rows sorted by range and written once, so that a block holds the same rows whoever
computes it: counts by group and range give each range its first rank. Equal rows have equal digests,
and a running number splits them over ranges.

Defined cases: a null id comes first; rows with equal ids are in order of their digest; a null group is
a group, the first one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import settled

FAN = 8
BLOCK_LEVELS = 4
PROOF = T.ArrayType(T.StructType().add("left", T.StringType()).add("right", T.StringType()))
#: A node: the tree it belongs to, its place among the tree's nodes of this level, how many those are.
NODE = "tree string, place long, size long, digest string"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """sha256, as hex, of the columns' values as text, each after its length in bytes; null is `-`."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


class Appender:
    """An append-only tree: `append` nodes from left to right, then `close` once.

    Levels above `levels` are not built, if given; else the tree goes up to a single root. A member
    is any list that collects its witness, (left siblings, right siblings) from its node upwards.
    """

    def __init__(self, fan: int = FAN, levels: int | None = None) -> None:
        self.fan, self.levels = fan, levels
        #: By level the open run: nodes, and the members below each.
        self.open: list[list[tuple[str, list[list]]]] = [[]]

    def append(self, digest: str, member: list) -> None:
        self._add(0, digest, [member])

    def _add(self, level: int, digest: str, members: list[list]) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if len(run) == self.fan:  # closed only when a further node shows that the tree goes on
            self._finish(level)
        self.open[level].append((digest, members))
        if len(self.open[level]) == self.fan and self.levels is not None and level < self.levels:
            self._finish(level)

    def _finish(self, level: int) -> None:
        """The open run of a level becomes its parent; the members' witnesses are extended."""
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for k, (_, members) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for member in members:
                member.append(step)
        self._add(level + 1, hashed(*digests), [m for _, members in run for m in members])

    def close(self) -> str:
        """Ends the last runs and returns the root."""
        level = 0
        while True:
            run = self.open[level]
            on_top = level + 1 == len(self.open)
            if run and (level == self.levels or (on_top and self.levels is None and len(run) == 1)):
                return run[0][0]
            if run:
                self._finish(level)
            level += 1


def _grow(digests: list[str], size: int, fan: int, block_levels: int) -> tuple[str, list[list]]:
    """Root of a block of nodes and the witness of each up to it; `size`: nodes of the whole tree."""
    tree = Appender(fan, None if size <= fan**block_levels else block_levels)
    witnesses: list[list] = [[] for _ in digests]
    for digest, witness in zip(digests, witnesses):
        tree.append(digest, witness)
    return tree.close(), witnesses


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with place (from 0, in order within the tree) and size (rows of the tree); written once.

    Sorted ranges are written, so a row's range and number in it are fixed; counts by range and tree, not
    rows, are summed in order.
    """
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    sorted_rows = settled(rows.repartitionByRange(tree, *order, "_n").sortWithinPartitions(tree, *order, "_n").drop("_n"))
    sorted_rows = sorted_rows.withColumn("_range", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    counts = sorted_rows.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_count"), F.min("_n").alias("_first"))
    own = Window.partitionBy(tree)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        tree, "_range", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(own).alias("size")
    )
    placed = sorted_rows.join(counts, [tree, "_range"]).withColumn("place", F.col("_before") + F.col("_n") - F.col("_first"))
    return placed.drop("_range", "_n", "_first", "_before")


def parents(nodes: DataFrame, fan: int, block_levels: int) -> DataFrame:
    """The roots of the blocks of nodes, as nodes."""
    span = fan**block_levels

    def roots(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree, size = block["tree"][0].as_py(), block["size"][0].as_py()
        root, _ = _grow(block["digest"].to_pylist(), size, fan, block_levels)
        row = {"tree": tree, "place": block["place"][0].as_py() // span, "size": -(-size // span), "digest": root}
        return pa.Table.from_pylist([row])

    keyed = nodes.select("tree", "place", "size", "digest").withColumn("block", F.expr(f"place div {span}"))
    return keyed.groupBy("tree", "block").applyInArrow(roots, NODE)


def extended(nodes: DataFrame, above: DataFrame, fan: int, block_levels: int) -> DataFrame:
    """nodes, with all their columns, and `proof`: their witness in their block, then that of the block's root.

    above: tree, place, proof of the blocks' roots, and more columns that each node of the block gets.
    """
    span = fan**block_levels
    more = [f for f in above.schema.fields if f.name not in ("tree", "place", "proof")]
    shape = T.StructType([*nodes.schema.fields, T.StructField("proof", PROOF), *more])

    def witness(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.drop_columns(["block"]).sort_by("place")
        rest = [(s["left"], s["right"]) for s in top["proof"][0].as_py()]
        _, witnesses = _grow(block["digest"].to_pylist(), block["size"][0].as_py(), fan, block_levels)
        steps = [{"left": left, "right": right} for own in witnesses for left, right in (*own, *rest)]
        ends = [0]
        for own in witnesses:
            ends.append(ends[-1] + len(own) + len(rest))
        pairs = pa.array(steps, pa.struct([("left", pa.string()), ("right", pa.string())]))
        block = block.append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
        for f in more:
            block = block.append_column(f.name, top[f.name].take(pa.array([0] * block.num_rows, pa.int32())))
        return block

    low = nodes.withColumn("block", F.expr(f"place div {span}")).groupBy("tree", "block")
    return low.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(witness, shape)


def climb(nodes: DataFrame, fan: int, block_levels: int) -> list[DataFrame]:
    """nodes, the roots of their blocks, and so on, up to one node a tree; each written once."""
    floors = [nodes]
    while floors[-1].where("size > 1").limit(1).count():
        floors.append(settled(parents(floors[-1], fan, block_levels)))
    return floors


def descend(floors: list[DataFrame], top: DataFrame, fan: int, block_levels: int) -> DataFrame:
    """The lowest floor with its witnesses; top: tree, proof of the tree's root, more columns for all below it."""
    if len(floors) == 1:
        return floors[0].join(top, "tree")
    more = [c for c in top.columns if c not in ("tree", "proof")]
    above = top.withColumn("place", F.lit(0).cast("long"))
    for floor in reversed(floors[1:-1]):
        above = settled(extended(floor, above, fan, block_levels).select("tree", "place", "proof", *more))
    return extended(floors[0], above, fan, block_levels)


def manifest(leaves: DataFrame, order: list[str], fan: int = FAN, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """leaves (tree: a string that orders the groups, digest, columns of one's own) with subroot, root and proof.

    proof: by level, from the leaf's to the root's, the digests left and right of the node on the way,
    joined; it spans the group's tree and the tree of groups. See `folded`.
    """
    own = [c for c in leaves.columns if c not in ("tree", "digest")]
    floors = climb(ranked(settled(leaves), "tree", [*order, "digest"]), fan, block_levels)
    # The groups' roots are the leaves of one more tree.
    groups = floors[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    upper = climb(ranked(groups, "tree", ["group"]), fan, block_levels)
    top = upper[-1].select("tree", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    groups = descend(upper, top, fan, block_levels)
    groups = settled(groups.select(F.col("group").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"))
    return descend(floors, groups, fan, block_levels).select("tree", "digest", *own, "subroot", "root", "proof")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its witness lead to."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a witness, level by level, from left to right, joined."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
