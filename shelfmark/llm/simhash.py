"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. Correlated bits are grouped
into partitions; partition i gets a threshold t_i >= -1 with sum(t_i) = distance - partitions + 1,
so any linked pair differs in at most t_i bits within some partition i (-1: that partition is not
probed). Thresholds come from dynamic programming over estimated candidate counts, for several
numbers of partitions. Fingerprints that share a partition's value (or one of its one-bit variants)
meet and are compared in full.

A value that many fingerprints share is split exactly: within it, the other bits fall into
distance + 1 parts, one of which must be equal, and so on until a group is small. A group returns a
spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm import words as W
from shelfmark.llm.components import components
from shelfmark.session import settle

BITS = 64
GROUP = 4096  # fingerprints that one group compares at most
SMALL = 16  # groups up to here are compared side by side


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit b is 1 if set in over half the XXH64 values of the shingles, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts, n = np.zeros(BITS, np.int64), len(found) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, 1 << 16):
        a, b = starts[low : min(n, low + (1 << 16))], ends[low + shingle - 1 : min(n, low + (1 << 16)) + shingle - 1]
        hashed = np.fromiter((digest(line[x:y], 42) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fp): the fingerprint of each row as a signed long; ``key`` tells texts of equal ids apart."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            made = np.array([fingerprint(t, shingle) for t in W.as_bytes(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], pa.array(made, pa.int64())], names=["id", "key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(W.tidied(mark), f"id {kind}, key long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch["fp"].to_numpy().view(np.uint64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(values)
        i, j = np.triu_indices(BITS)
        yield pa.record_batch({"i": pa.array(np.append(i, -1), pa.int64()), "j": pa.array(np.append(j, -1), pa.int64()), "n": pa.array(np.append(both[i, j], n).astype(np.int64), pa.int64())})

    total, both = 0, np.zeros((BITS, BITS))
    for i, j, n in fps.select("fp").mapInArrow(moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            total = n
        else:
            both[i, j] = both[j, i] = n
    return total, both


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal width: each grows by the bit most correlated with it."""
    size = len(both)
    mean = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs(both / max(total, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, out = set(range(size)), []
    for k in range(parts):
        width = size // parts + (k < size % parts)
        left = sorted(free)
        own = [left[int(np.argmax(related[np.ix_(left, left)].sum(axis=1)))]]
        free.discard(own[0])
        while len(own) < width:
            left = sorted(free)
            best = left[int(np.argmax(related[np.ix_(left, own)].sum(axis=1)))]
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least total cost; ``costs[i][t]`` is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in own.items():
                now = (cost + more, [*chosen, t])
                if used + t not in step or now < step[used + t]:
                    step[used + t] = now
        best = step
    return best[budget]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def plan_partitions(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds, the cheapest of several layouts."""
    total, both = bit_statistics(fps)
    mean = np.diag(both) / max(total, 1)
    differ = 2 * mean * (1 - mean)
    layouts = {m: group_bits(total, both, m) for m in choices}
    masks = sorted({_mask(g) for groups in layouts.values() for g in groups})
    held = fps.select("fp", F.explode(F.array([F.lit(m) for m in masks])).alias("mask"))
    sizes = held.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).agg(F.count("*").cast("double").alias("n"))
    pairs = {r[0]: r[1] for r in sizes.groupBy("mask").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).collect()}
    plans = []
    for groups in layouts.values():
        costs = []
        for g in groups:
            equal = pairs.get(_mask(g), 0.0)
            # pairs that differ in one bit of the group: estimated from each bit's own odds
            near = equal * (1 + float(np.sum(differ[g] / np.maximum(1 - differ[g], 0.5)))) + total
            costs.append({-1: 0.0, 0: equal + 200.0 * total, 1: near + 200.0 * total * (len(g) + 1)})
        cost, chosen = allocate(costs, distance - len(groups) + 1)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _forest(values: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over the values of one group."""
    unseen, a, b = np.arange(len(values)), [], []
    while len(unseen):
        front, unseen = unseen[:1], unseen[1:]
        while len(front) and len(unseen):
            part, front = front[:256], front[256:]
            near = np.bitwise_count(values[part][:, None] ^ values[unseen][None, :]) <= distance
            hit = near.any(axis=0)
            a += part[near[:, hit].argmax(axis=0)].tolist()
            b += unseen[hit].tolist()
            front = np.concatenate((front, unseen[hit]))
            unseen = unseen[~hit]
    return a, b


def _compare(distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in _ended(batches):
            if batch is not None:
                held = [np.concatenate((h, batch[c].to_numpy())) for h, c in zip(held, ("mask", "value", "fp"))]
            mask, value, fp = held
            if not len(fp):
                continue
            new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
            upto = len(fp) if batch is None else int(new[-1])
            held = [h[upto:] for h in held]
            new = np.append(new[new < upto], upto)
            sizes = np.diff(new)
            values = fp.view(np.uint64)
            left, right = [], []
            little = np.repeat(sizes <= SMALL, sizes)
            ends = np.repeat(new[1:], sizes)
            for d in range(1, SMALL):
                i = np.flatnonzero(little & (np.arange(upto) + d < ends))
                if not len(i):
                    break
                i = i[np.bitwise_count(values[i] ^ values[i + d]) <= distance]
                left.append(fp[i])
                right.append(fp[i + d])
            for g in np.flatnonzero(sizes > SMALL).tolist():
                low, high = int(new[g]), int(new[g + 1])
                one = np.unique(values[low:high])
                a, b = _forest(one, distance)
                left.append(one[a].view(np.int64))
                right.append(one[b].view(np.int64))
            if left:
                yield pa.record_batch({"u": pa.array(np.concatenate(left), pa.int64()), "v": pa.array(np.concatenate(right), pa.int64())})

    return compare


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def link_fingerprints(fps: DataFrame, distance: int = 2, group: int = GROUP) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all that lie ``distance`` or fewer bits apart."""
    whole = (1 << BITS) - 1
    keys = []
    for bits, threshold in plan_partitions(fps, distance):
        keys.append((_mask(bits), 0))
        if threshold == 1:
            keys += [(_mask(bits), _mask([b])) for b in bits]
    held = F.explode(F.array([F.struct(F.lit(m).alias("mask"), F.lit(x).alias("flip")) for m, x in keys])).alias("k")
    rows = fps.select("fp", held).select("fp", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"))
    masks, links = sorted({m for m, _ in keys}), None
    while True:
        large = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > group).drop("n")
        wide = [m for m in masks if BITS - (m & whole).bit_count() > distance]
        large = settle(large.where(F.col("mask").isin(wide)) if wide else large.limit(0), "large")
        split = bool(large.head(1))
        fit = rows.join(large, ["mask", "value"], "left_anti") if split else rows
        found = fit.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "fp").mapInArrow(_compare(distance), "u long, v long")
        links = found if links is None else links.unionByName(found)
        if not split:
            return links
        # in a large group one of distance + 1 parts of the other bits is equal
        deeper = []
        for m in wide:
            rest = [b for b in range(BITS) if not (m >> b) & 1]
            deeper.append((m, [_mask([b for b in range(BITS) if (m >> b) & 1] + rest[k :: distance + 1]) for k in range(distance + 1)]))
        finer = F.create_map(*[x for m, more in deeper for x in (F.lit(m), F.array([F.lit(y) for y in more]))])
        rows = settle(rows.join(large, ["mask", "value"]).select("fp", "value", F.col("mask").alias("was"), F.explode(finer[F.col("mask")]).alias("mask"))
                      .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("value").bitwiseXOR(F.col("fp").bitwiseAND(F.col("was")))).alias("value")).distinct(), "deeper")
        masks = sorted({y for _, more in deeper for y in more})


def near_documents(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fp, root): ``root`` is the smallest fingerprint of the row's component."""
    marked = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = components(link_fingerprints(settle(marked.select("fp").distinct(), "distinct"), distance))
    return marked.join(found, marked["fp"] == found["node"], "left").select("id", "key", "fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id that links lead to, itself included (null if all ids are null).
    Null and empty texts have fingerprint zero and link like any others; a text of fewer words than a
    shingle is one shingle. Other columns are not read.
    """
    marked = settle(near_documents(docs, distance, id_col, text_col, shingle), "rooted")
    least = settle(marked.groupBy("root").agg(F.min("id").alias("component_id")), "least")  # so that a large component's join can be split
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(least, "root").select(F.col("id").alias(id_col), shown, "component_id")


def drop_near_documents(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id, then of the smallest text hash.

    Null ids come last. Of rows that repeat id and text one is kept. All columns stay.
    """
    return keep_first(docs, settle(near_documents(docs, distance, id_col, text_col, shingle), "rooted"), id_col, text_col)


def keep_first(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` that share a root in ``marked`` (id, key, root) the first: by id, nulls last, then by text hash."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = marked.groupBy("root").agg(F.min(order).alias("f")).select("f.id", "f.key", "root")
    copies = marked.groupBy("id", "key").count()
    chosen = first.join(copies, first["id"].eqNullSafe(copies["id"]) & (first["key"] == copies["key"])).select(first["id"].alias("__id"), first["key"].alias("__key"), F.col("count").alias("__copies"))
    rows = docs.withColumn("__text_key", F.xxhash64(text_col))
    kept = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    single = kept.where("__copies = 1")
    repeated = kept.where("__copies > 1").dropDuplicates(["__id", "__key"])
    return single.unionByName(repeated).select(*docs.columns)
