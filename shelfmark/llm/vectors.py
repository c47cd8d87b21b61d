"""Embedding near-dedup by sorted projection passes.

Equal vectors form a class. In each pass a vector gets a row of random hashes (signs of random
projections); classes are ordered by them and the order is cut into blocks. A vector is compared
with its own and the neighbouring blocks, and with all vectors that share its first hashes (its
cell), however many, so a dense group is compared whole. Passes are as many as a pair at the
threshold needs to meet with the wished probability.

A pair that several passes bring together is counted in the first of them: each vector carries its
block and cell of every pass. Tasks return sums of links and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.llm.components import components
from shelfmark.session import settle

HASHES = 48
BLOCK, BLOCKS = 128, 32  # rows in a block, blocks that one task holds


def passes_for(n: int, threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """Number of passes, and of the first hashes that make a cell of about a block."""
    bits = max(1, min(HASHES, math.ceil(math.log2(max(2, n / BLOCK)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree))), bits


def _planes(size: int, passes: int) -> np.ndarray:
    return np.random.default_rng(20_240 + size).standard_normal((size, passes * HASHES))


def _unit(column: pa.Array) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _signatures(passes: int, bits: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(HASHES - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            vectors = batch["vector"].to_pylist()
            sizes = np.array([len(v) for v in vectors])
            found = np.zeros((len(vectors), passes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                planes = _planes(size, passes)
                for low in range(0, len(at), 1024):
                    some = at[low : low + 1024]
                    x = np.array([vectors[i] for i in some.tolist()], np.float64)
                    x /= np.abs(x).max(axis=1)[:, None]
                    found[some] = ((x @ planes > 0).reshape(len(some), passes, HASHES) * weights).sum(axis=2)
            raw = [np.array(v, np.float64) for v in vectors]
            raw = [v / np.abs(v).max() for v in raw]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["copies"], pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(sizes, pa.int32()), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["node", "copies", "raw", "size", "signs"])

    return sign


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each pass and vector size in a sorted partition."""
    last, n = None, 0
    for batch in batches:
        group = list(zip(batch["pass"].to_pylist(), batch["size"].to_pylist()))
        at = []
        for g in group:
            n = n + 1 if g == last else 0
            last = g
            at.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


class _Group:
    """Rows of one task in their order, and what is found among them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("rank")
        self.node = table["node"].to_pylist()
        self.copies = table["copies"].to_numpy()
        self.rank = table["rank"].to_numpy()
        self.unit = _unit(table["raw"].combine_chunks())
        self.blocks = np.stack([np.frombuffer(x, np.int64) for x in table["blocks"].to_pylist()])
        self.cells = np.stack([np.frombuffer(x, np.int64) for x in table["cells"].to_pylist()])
        self.links = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))
        self.edges: list[tuple[int, int]] = []

    def compare(self, rows: np.ndarray, others: np.ndarray, turn: int, threshold: float, allowed) -> None:
        """Links between ``rows`` and later ``others`` that ``allowed`` and that no earlier pass has seen."""
        close = self.unit[rows] @ self.unit[others].T >= threshold
        i, j = np.nonzero(close & (others[None, :] > rows[:, None]))
        i, j = rows[i], others[j]
        keep = allowed(i, j)
        for q in range(turn):
            keep &= ~((np.abs(self.blocks[i, q] - self.blocks[j, q]) <= 1) | (self.cells[i, q] == self.cells[j, q]))
        i, j = i[keep], j[keep]
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(i)]):
            a, near = int(i[low]), j[low:high]
            while len(far := near[self.label[near] != self.label[a]]):
                b = int(far[0])
                self.edges.append((a, b))
                self.label[self.label == self.label[b]] = self.label[a]
                near = far

    def found(self) -> pa.Table:
        some = np.flatnonzero(self.links)
        return pa.table({
            "node": pa.array([self.node[k] for k in some] + [self.node[a] for a, _ in self.edges], pa.string()),
            "other": pa.array([None] * len(some) + [self.node[b] for _, b in self.edges], pa.string()),
            "links": pa.array([*self.links[some].tolist(), *[0] * len(self.edges)], pa.int64()),
        })


def near_vectors(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-4) -> DataFrame:
    """One row per row of ``rows``: the id, n_links, component_id and kept.

    Two vectors link at a cosine of ``threshold`` or more in double precision. Vectors that are null,
    empty, zero, or hold null or non-finite parts link with nothing, nor do vectors of different
    length. Equal vectors link with each other. component_id is the smallest id that links lead to,
    itself included; kept says that it is the row's own. Rows with a null id take part, but a null
    is no id to be smallest and the row is not kept. Rows that repeat id and vector are copies of
    each other.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.size(vector) > 0
    sound &= ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.when(sound, F.transform(vector, lambda x: x + F.lit(0.0))).alias("vector"))
    base = base.withColumn("node", F.when(F.col("vector").isNotNull(), F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.hash("vector")))))
    classes = base.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = settle(classes, "classes")
    n = classes.count()
    passes, bits = passes_for(n, threshold, miss)
    signed = settle(classes.select("node", "copies", "vector").mapInArrow(_signatures(passes, bits), "node string, copies long, raw binary, size int, signs array<long>"), "signed")

    turns = signed.select("node", "size", F.posexplode("signs").alias("pass", "sign"))
    ordered = turns.repartitionByRange("pass", "size", "sign", "node").sortWithinPartitions("pass", "size", "sign", "node")
    numbered = settle(ordered.mapInArrow(_number, "node string, size int, pass int, sign long, at long").withColumn("part", F.spark_partition_id()), "numbered")
    parts = numbered.groupBy("pass", "size", "part").agg(F.count("*").alias("n"))  # a few rows for each partition
    before = Window.partitionBy("pass", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pass", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = numbered.join(parts, ["pass", "size", "part"]).select("node", "pass", (F.col("before") + F.col("at")).alias("rank"), F.shiftright("sign", HASHES - bits).alias("cell"))
    placed = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "rank", "cell"))).alias("places"))  # one row for each pass
    placed = settle(signed.select("node", "copies", "raw", "size").join(placed, "node"), "placed")

    dealt = placed.select("*", F.posexplode("places").alias("pass", "place")).select("node", "copies", "raw", "size", "places", "pass", "place.rank", "place.cell", F.expr(f"place.rank div {BLOCK * BLOCKS}").alias("task"))
    halo = dealt.where((F.col("rank") % (BLOCK * BLOCKS) < BLOCK) & (F.col("task") > 0)).withColumn("task", F.col("task") - 1)
    near = dealt.unionByName(halo).groupBy("pass", "size", "task").applyInArrow(_within(threshold), "node string, other string, links long")
    # cells that reach over several tasks: their parts meet two by two
    spans = dealt.groupBy("pass", "size", "cell").agg(F.min("task").alias("first"), F.max("task").alias("last")).where("last > first")
    wide = dealt.join(spans, ["pass", "size", "cell"])
    pairs = F.explode(F.sequence("first", "last")).alias("with")
    met = wide.select("*", pairs).where("with != task").withColumn("low", F.least("task", "with")).withColumn("high", F.greatest("task", "with"))
    across = met.drop("first", "last", "with").groupBy("pass", "size", "cell", "low", "high").applyInArrow(_across(threshold), "node string, other string, links long")
    found = settle(near.unionByName(across), "found")

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "node", "other").withColumnRenamed("component", "root")
    known = classes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "root").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "smallest")
    out = base.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _open(table: pa.Table) -> pa.Table:
    places = table["places"].to_pylist()
    blocks = [np.array([p["rank"] // BLOCK for p in own], np.int64).tobytes() for own in places]
    cells = [np.array([p["cell"] for p in own], np.int64).tobytes() for own in places]
    return table.drop_columns(["places"]).append_column("blocks", pa.array(blocks, pa.binary())).append_column("cells", pa.array(cells, pa.binary()))


def _within(threshold: float):
    def within(key: tuple, table: pa.Table) -> pa.Table:
        turn, task = key[0].as_py(), key[2].as_py()
        group = _Group(_open(table))
        block, cell = group.blocks[:, turn], group.cells[:, turn]
        own = np.flatnonzero(group.rank // (BLOCK * BLOCKS) == task)
        ends = np.searchsorted(cell, cell, "right")  # cells ascend with the rank
        for b in np.unique(block[own]).tolist():
            rows = own[block[own] == b]
            last = max(int(np.searchsorted(block, b + 2)), int(ends[rows[-1]]))
            group.compare(rows, np.arange(rows[0], last), turn, threshold, lambda i, j: (block[j] - block[i] <= 1) | ((cell[i] == cell[j]) & (group.rank[j] // (BLOCK * BLOCKS) == task)))
        return group.found()

    return within


def _across(threshold: float):
    def across(key: tuple, table: pa.Table) -> pa.Table:
        turn, low, high = key[0].as_py(), key[3].as_py(), key[4].as_py()
        group = _Group(_open(table))
        block, task = group.blocks[:, turn], group.rank // (BLOCK * BLOCKS)
        left, right = np.flatnonzero(task == low), np.flatnonzero(task == high)
        for k in range(0, len(left), BLOCK):
            group.compare(left[k : k + BLOCK], right, turn, threshold, lambda i, j: block[j] - block[i] > 1)
        return group.found()

    return across
