"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof per row.

Trees are built five levels at a time from groups of neighbouring nodes. Proofs come from pointer
jumping: each node knows the siblings on the way to an ancestor; joined with what that ancestor
knows, it reaches twice as far. After a logarithmic number of self-joins every leaf reaches the root.
Only nodes that some pointer can still meet stay in the table, a small part after the first join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import release, settle

_RUN = 3  # nodes a parent
_LEVELS = 5  # built in one pass
_GROUP = _RUN**_LEVELS
_ID, _UP = ["tree", "level", "i"], ["up_tree", "up_level", "up_i"]
_TOP = "t"  # the tree over the sources; their own trees are called n (null) or s and the source


def digest(*columns: Column) -> Column:
    """Hex SHA-256 over the columns: a dash for null, else the UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to by the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), d, F.lower(F.hex(s["right"]))), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one text, from the leaf to the root, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.lower(F.concat(F.hex(s["left"]), F.hex(s["right"])))), "")


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = math.ceil(n / _RUN), levels + 1
    return levels


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``i`` in their ``tree`` and the number ``n`` of rows there. A tree may span many
    partitions: places are counted within a partition and shifted by the counts of the tree's earlier ones."""
    dealt = settle(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "dealt")
    in_part = Window.partitionBy("tree", "part").orderBy(*order)
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("tree", "part").count()  # a row per tree and partition that it reaches into
    shifts = counts.select(
        "tree", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("tree")).alias("n"))
    local = dealt.withColumn("within", F.row_number().over(in_part) - 1)
    return local.join(shifts, ["tree", "part"]).select(*rows.columns, (F.col("before") + F.col("within")).alias("i"), "n")


def _climb(nodes: DataFrame, base: int, label: str) -> DataFrame:
    """Five levels on top of ``nodes`` (tree, n, i, digest, row), fewer where the tree ends. One row per node met:
    those with siblings or a parent, and the highest one, whose ``size``, the number of nodes of its level, says if it is the tree's top."""
    height = F.when(F.col("n") <= 1, 0)
    for k in range(1, _LEVELS):
        height = height.when(F.col("n") <= _RUN**k, k)
    groups = nodes.groupBy("tree", "n", F.expr(f"i div {_GROUP}").alias("g")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "row"))).alias("low"))
    parents = f"""transform(sequence(0, (size(element_at(levels, -1)) - 1) div {_RUN}), p ->
        sha2(array_join(slice(element_at(levels, -1), {_RUN} * p + 1, {_RUN}), ''), 256))"""
    levels = f"aggregate(slice(array({', '.join(map(str, range(_LEVELS)))}), 1, up), array(low.digest), (levels, _) -> concat(levels, array({parents})))"
    grown = groups.withColumn("up", height.otherwise(_LEVELS)).withColumn("levels", F.expr(levels))
    # Every level keeps what its nodes need; the first also the rows that its nodes stand for.
    each = grown.select("tree", "n", "g", "up", F.col("low.row").alias("rows"), F.posexplode("levels").alias("j", "digests"))
    whole = f"""transform(digests, (d, p) -> struct(
        g * cast(power({_RUN}, {_LEVELS} - j) as bigint) + p as i, d as digest, if(j = 0, get(rows, p), null) as row,
        unhex(array_join(slice(digests, p - p % {_RUN} + 1, p % {_RUN}), '')) as left,
        unhex(array_join(slice(digests, p + 2, {_RUN - 1} - p % {_RUN}), '')) as right))"""
    made = each.select("tree", "n", "j", (F.col("j") == F.col("up")).alias("highest"), F.explode(F.expr(whole)).alias("x"))
    size = F.ceil(F.col("n") / F.pow(F.lit(_RUN), F.col("j"))).cast("long")
    return settle(made.select("tree", (F.col("j") + base).alias("level"), "x.*", "highest", size.alias("size")), label)


def _grow(nodes: DataFrame, largest: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Passes of ``_climb`` up to each tree's top: all nodes below the tops, by pass, and the tops."""
    below, tops, base = [], None, 0
    while True:
        made = _climb(nodes, base, label)
        below.append(made.where("not highest"))
        high = made.where("highest")
        ended = high.where("size = 1")
        tops = ended if tops is None else tops.unionByName(ended)
        largest, base = math.ceil(largest / _GROUP), base + _LEVELS
        if largest <= 1:
            return below, tops
        nodes = high.where("size > 1").select("tree", F.col("size").alias("n"), "i", "digest", "row")


def manifest(docs: DataFrame, leaf_cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), source_col: str = "source", order_col: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``docs``: one row per row, with order_col, source_col, leaf, subroot, root and proof.

    A leaf is the digest of ``leaf_cols``. The leaves of a source ascend by ``order_col``; while a level
    holds several nodes, each run of three (the last may be shorter) becomes the digest of its digests
    joined as hex text. What remains is the source's subroot. Subroots ordered by source, null first and
    then by UTF-8 bytes, give the root in the same way. ``proof`` is an array of (left, right): the digests,
    as bytes, of the siblings before and behind at each level from the leaf to the root; see :func:`fold`.
    ``carry`` names further columns to work out from a row of ``docs`` and to return with it.

    A null order value comes first and a null source is a source of its own. Rows of equal order value go
    by their leaf; rows that repeat each other are leaves like any others, and which of them comes first
    changes nothing. Texts may be empty or of any length. A single row is leaf, subroot and root at once,
    with an empty proof. An empty table gives an empty one. Other columns of ``docs``, whatever their names, are not read.
    """
    carry = carry or {}
    own = F.col(source_col).cast("string")
    row = F.struct(F.col(order_col).alias("order"), F.col(source_col).alias("source"), *[c.alias(f"c{k}") for k, c in enumerate(carry.values())])
    leaves = settle(docs.select(
        F.when(own.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), own)).alias("tree"), digest(*[F.col(c) for c in leaf_cols]).alias("digest"),
        row.alias("row"), F.col(order_col).alias("order"), F.monotonically_increasing_id().alias("salt")), "leaves")
    placed = settle(_numbered(leaves, ["order", "digest", "salt"]).select("tree", "n", "i", "digest", "row"), "placed")
    largest, trees = placed.agg(F.max("n"), F.count_distinct("tree")).first()
    below, tops = _grow(placed, largest or 0, "nodes")

    # A source's top is a leaf of the tree over the sources, and keeps its own name there.
    named = tops.select(F.lit(_TOP).alias("tree"), "digest", F.col("tree").alias("order"), F.struct(*[F.col(c).alias(c) for c in _ID], "row").alias("row"))
    over, root = _grow(_numbered(named, ["order"]).select("tree", "n", "i", "digest", "row"), trees, "over")

    step = F.array(F.struct("left", "right"))
    parent = lambda tree: [tree.alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.expr(f"i div {_RUN}").alias("up_i")]
    none = F.lit(None).cast("string")
    frames = [b.select(*_ID, *parent(F.col("tree")), step.alias("steps"), none.alias("subroot"), none.alias("root"), "digest", "row", F.lit(False).alias("over")) for b in below]

    def upper(nodes: DataFrame, at_root: bool) -> DataFrame:
        """Nodes of the tree over the sources. Its leaves stand for the sources' tops: they go by those names and know the subroot."""
        leaf = F.col("level") == 0
        ups = [F.lit(None).cast(t).alias(c) for c, t in zip(_UP, ("string", "int", "long"))] if at_root else parent(F.col("tree"))
        steps = F.slice(step, 1, 0) if at_root else step
        return nodes.select(
            F.when(leaf, F.col("row.tree")).otherwise(F.col("tree")).alias("tree"), F.when(leaf, F.col("row.level")).otherwise(F.col("level")).alias("level"),
            F.when(leaf, F.col("row.i")).otherwise(F.col("i")).alias("i"), *ups, steps.alias("steps"), F.when(leaf, F.col("digest")).alias("subroot"),
            (F.col("digest") if at_root else none).alias("root"), "digest", F.col("row.row").alias("row"), F.lit(True).alias("over"))

    for nodes in [*over, root]:
        frames.append(upper(nodes, nodes is root))
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)

    reach, path = 1, _height(largest or 0) + _height(trees)
    while reach <= path:  # a pointer is null once it has been past the root
        far = table.where(F.col("over") | (F.col("level") > 0) & (F.col("level") % reach == 0))
        met = far.select(
            *[F.col(c).alias(u) for c, u in zip(_ID, _UP)], *[F.col(u).alias(f"next_{u}") for u in _UP],
            F.col("steps").alias("more"), F.col("subroot").alias("_subroot"), F.col("root").alias("_root"))
        reach *= 2
        wanted = table.where(F.col("over") | F.col("row").isNotNull() | (F.col("level") % reach == 0))
        jumped = wanted.where("up_tree is not null").join(met, _UP).select(
            *_ID, *[F.col(f"next_{u}").alias(u) for u in _UP], F.concat("steps", "more").alias("steps"),
            F.coalesce("subroot", "_subroot").alias("subroot"), F.coalesce("root", "_root").alias("root"), "digest", "row", "over")
        before, table = table, settle(jumped.unionByName(wanted.where("up_tree is null")), "jumped")
        if hasattr(before, "settled_path"):
            release(before)
    return table.where("row is not null").select(
        F.col("row.order").alias(order_col), F.col("row.source").alias(source_col), F.col("digest").alias("leaf"), "subroot", "root",
        F.col("steps").alias("proof"), *[F.col(f"row.c{k}").alias(name) for k, name in enumerate(carry)])
