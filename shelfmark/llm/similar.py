"""Near copies of a stated similarity by SimHash fingerprints of 256 bits and a generalised pigeonhole.

A fingerprint is made of the distinct word shingles of a text. Two shingle sets of Jaccard similarity
s differ in about 256 * acos(2s / (1 + s)) / pi bits. Pairs up to one standard deviation below that
link; pairs up to one above it link if their shingle sets, compared exactly, are similar enough.
Correlated bits are grouped into partitions; partition i gets a threshold t_i of -1 (not probed), 0, 2
or 4 with sum(t_i) >= limit - partitions + 1, so a pair within the limit differs in at most t_i bits of
some partition i. Both sides send their value of a probed partition with up to t_i / 2 bits flipped, so
such a pair meets; all 256 bits are compared there.

The number of partitions and the thresholds come from dynamic programming over estimated candidate
counts. A value that many fingerprints share is cut into blocks which meet two by two, and a task
returns a spanning forest of its links, not its pairs: first over the sure links, then over the others.

Whatever that leaves apart is settled exactly. With the shingles of all texts in one order, rare ones first,
two sets of similarity s share one of their first n - ceil(s * n) + 1. The texts in each shingle's list are
paired by their distance in it, near ones first, as long as they are in different groups; each pair's sets
are compared. The order comes from a sketch of the shingles' counts: it decides the cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm import words as W
from shelfmark.llm.components import components
from shelfmark.llm.simhash import allocate, group_bits, keep_first
from shelfmark.session import release, settle

WORDS = 4
BITS = 64 * WORDS
PARTS = [f"f{k}" for k in range(WORDS)]
BLOCK = 4096  # fingerprints in a block of a value that many share
SMALL = 32  # groups up to here are compared side by side
ROW_COST = 200.0  # a probe row against one comparison
SKETCH = 20  # bits of a shingle's hash that name its counter
STEP = 4  # each round of the exact pass reaches so many times as far
_STEP = 0x9E3779B97F4A7C15


def limits_for(similarity: float) -> tuple[int, int]:
    """Bits up to which two texts are surely and may be this similar: a standard deviation about the mean."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    spread = math.sqrt(BITS * p * (1 - p))
    return math.floor(BITS * p - spread), math.floor(BITS * p + spread)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; fewer words are one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[x:y], 42) for x, y in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def fingerprint(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Bit b of word k is 1 if set in over half of the distinct shingles' k-th hashes; no words: zero."""
    return _folded(shingles(text, shingle))


def _folded(hashed: np.ndarray) -> np.ndarray:
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashed), 1 << 14):
        part = hashed[low : low + (1 << 14), None]
        wide = np.concatenate([part, *(W.mix(part + np.uint64(_STEP * k % (1 << 64))) for k in range(1, WORDS))], axis=1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashed), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, node, f0..f3): ``key`` tells texts of equal ids apart, ``node`` is a digest of the shingle set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            hashed = [shingles(t, shingle) for t in W.as_bytes(batch["text"])]
            made = np.stack([_folded(h) for h in hashed] or [np.zeros(WORDS, np.uint64)])[: batch.num_rows].view(np.int64)
            node = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashed], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], node, *(pa.array(made[:, k]) for k in range(WORDS))], names=["id", "key", "node", *PARTS])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(W.tidied(mark), f"id {kind}, key long, node binary, " + ", ".join(f"{c} long" for c in PARTS))


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[c].to_numpy() for c in PARTS], axis=1).view(np.uint64)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set: sums of 256 x 256 numbers."""
    i, j = np.triu_indices(BITS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(_words(batch)).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.record_batch({"i": pa.array(np.append(i, -1), pa.int64()), "j": pa.array(np.append(j, -1), pa.int64()), "n": pa.array(np.append(both[i, j], n).astype(np.int64), pa.int64())})

    total, both = 0, np.zeros((BITS, BITS))
    for a, b, n in fps.mapInArrow(moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if a < 0:
            total = n
        else:
            both[a, b] = both[b, a] = n
    return total, both


def plan_partitions(total: int, both: np.ndarray, limit: int, choices: tuple[int, ...] = (12, 16, 20)) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds, the cheapest of several layouts."""
    mean = np.diag(both) / max(total, 1)
    differ = 2 * mean * (1 - mean)
    plans = []
    for parts in choices:
        groups, costs = group_bits(total, both, parts), []
        for group in groups:
            odds = np.ones(1)  # of the number of bits in which two fingerprints differ
            for p in differ[group]:
                odds = np.convolve(odds, (1 - p, p))
            costs.append({-1: 0.0} | {t: total * total / 2 * float(odds[: t + 1].sum()) + ROW_COST * total * sum(math.comb(len(group), r) for r in range(t // 2 + 1)) for t in (0, 2, 4)})
        least = max(limit - parts + 1, -parts)
        for budget in range(least, least + 3):  # thresholds go by two
            try:
                cost, chosen = allocate(costs, budget)
            except KeyError:
                continue
            plans.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _probes(plan: list[tuple[list[int], int]]):
    """Each fingerprint once for every value of a probed partition that it answers to."""
    probes = []
    for k, (bits, threshold) in enumerate(plan):
        flips = [sum(1 << b for b in some) for r in range(threshold // 2 + 1) for some in combinations(range(len(bits)), r)]
        probes.append((k << 32, np.array(bits), 1 << np.arange(len(bits), dtype=np.int64), np.array(flips, np.int64)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches, 256):
            words = _words(batch)
            bits = _bits(words).astype(np.int64)
            keys = np.concatenate([base + ((bits[:, own] @ powers)[:, None] ^ flips[None, :]) for base, own, powers, flips in probes], axis=1)
            sent = np.repeat(words.view(np.int64), keys.shape[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(sent[:, k]) for k in range(WORDS))], names=["probe", *PARTS])

    return emit


def _forest(words: np.ndarray, sure: int, limit: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over the links of one group; sure links come first."""
    n = len(words)
    apart = np.zeros((n, n), np.uint16)
    for low in range(0, n, 256):
        for k in range(WORDS):
            apart[low : low + 256] += np.bitwise_count(words[low : low + 256, k, None] ^ words[None, :, k])
    a, b, label = [], [], np.arange(n)
    for most in (sure, limit):
        unseen = (apart <= most).sum(axis=1) > 1
        for seed in np.flatnonzero(unseen).tolist():
            if not unseen[seed]:
                continue
            unseen[seed], front, reached = False, [seed], [seed]
            while front:
                node = front.pop()
                hit = np.flatnonzero((apart[node] <= most) & unseen)
                unseen[hit] = False
                across = hit[label[hit] != label[node]].tolist()
                a += [node] * len(across)
                b += across
                front += hit.tolist()
                reached += hit.tolist()
            if most == sure:
                label[reached] = seed
    return a, b


def _compare(sure: int, limit: int):
    names = [f"{side}{k}" for side in "uv" for k in range(WORDS)]

    def found(words: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        sizes, left, right = np.diff(new), [], []
        little, ends = np.repeat(sizes <= SMALL, sizes), np.repeat(new[1:], sizes)
        at = np.flatnonzero(little)
        for d in range(1, SMALL):
            at = at[at + d < ends[at]]
            if not len(at):
                break
            hit = at[np.bitwise_count(words[at] ^ words[at + d]).sum(axis=1) <= limit]
            left.append(hit)
            right.append(hit + d)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            a, b = _forest(words[new[g] : new[g + 1]], sure, limit)
            left.append(np.array(a, np.int64) + new[g])
            right.append(np.array(b, np.int64) + new[g])
        u, v = (words[np.concatenate(x).astype(np.int64)] if x else words[:0] for x in (left, right))
        both = np.unique(np.concatenate((u, v), axis=1), axis=0)
        apart = np.bitwise_count(both[:, :WORDS] ^ both[:, WORDS:]).sum(axis=1)
        both = both.view(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(both[:, k]) for k in range(2 * WORDS)), pa.array(apart <= sure)], names=[*names, "sure"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = np.empty((0, 3), np.int64), np.empty((0, WORDS), np.uint64)
        for batch in _ended(batches):
            if batch is not None:
                keys = np.concatenate((keys, np.stack([batch[c].to_numpy() for c in ("probe", "low", "high")], axis=1)))
                words = np.concatenate((words, _words(batch)))
            if not len(keys):
                continue
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            upto = len(keys) if batch is None else int(new[-1])
            if upto:
                yield found(words[:upto], np.append(new[new < upto], upto))
            keys, words = keys[upto:], words[upto:]

    return compare


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _node(side: str) -> Column:
    own = [F.col(f"{side}{k}") for k in range(WORDS)]
    return F.concat(F.hex(F.xxhash64(*own)), F.lit("-"), F.hex(F.hash(*own)))


def link_similar(fps: DataFrame, sure: int, limit: int, block: int = BLOCK) -> DataFrame:
    """(u, v, sure): links between distinct fingerprints that connect all that lie ``limit`` or fewer bits
    apart, by themselves all that lie ``sure`` or fewer apart."""
    plan = plan_partitions(*bit_statistics(fps), limit)
    rows = fps.mapInArrow(_probes(plan), "probe long, " + ", ".join(f"{c} long" for c in PARTS))
    large = settle(rows.groupBy("probe").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    zero = F.lit(0).cast("long")
    grouped = rows.select("*", zero.alias("low"), zero.alias("high"))
    if large.head(1):
        blocks = F.ceil(F.col("n") / block)
        dealt = rows.join(large, "probe").withColumn("own", F.pmod(F.xxhash64(*PARTS), blocks)).withColumn("with", F.explode(F.sequence(zero, blocks - 1)))
        met = dealt.select("probe", *PARTS, F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
        grouped = grouped.join(large, "probe", "left_anti").unionByName(met)
    sides = ", ".join(f"{s}{k} long" for s in "uv" for k in range(WORDS))
    found = grouped.repartition("probe", "low", "high").sortWithinPartitions("probe", "low", "high").mapInArrow(W.tidied(_compare(sure, limit)), f"{sides}, sure boolean")
    u, v = _node("u"), _node("v")
    return found.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "sure").distinct()


def _alike(similarity: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches, 64):
            sets = [[np.frombuffer(t, np.uint64) for t in W.as_bytes(batch[c])] for c in ("a", "b")]
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
            yield batch.select(["u", "v"]).filter(pa.array([n >= similarity * (len(x) + len(y) - n) - 1e-9 for n, x, y in zip(shared, *sets)], pa.bool_()))

    return alike


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    held = pairs.select("u", "v").join(sets.withColumnsRenamed({"node": "u", "hashes": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "hashes": "b"}), "v")
    return held.select("u", "v", "a", "b").mapInArrow(W.tidied(_alike(similarity)), "u binary, v binary")


def _sets(docs: DataFrame, marked: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, hashes): the shingle sets of ``nodes``, each from one text that has it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            made = pa.array([shingles(t, shingle).tobytes() for t in W.as_bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["node"], made], names=["node", "hashes"])

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("c")
    chosen = marked.join(nodes, "node", "left_semi").groupBy("node").agg(first).select("node", F.col("c.id").alias("cid"), F.col("c.key").alias("ckey"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    held = rows.join(chosen, F.col("id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey")))
    return held.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(W.tidied(hashed), "node binary, hashes binary")


def _levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """About four times the binary logarithm of how many shingles share each counter of the sketch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH, np.int64)
        for batch in W.small(batches):
            hashed = [shingles(t, shingle) >> np.uint64(64 - SKETCH) for t in W.as_bytes(batch["text"])]
            seen += np.bincount(np.concatenate([np.empty(0, np.uint64), *hashed]).astype(np.int64), minlength=1 << SKETCH)
        at = np.flatnonzero(seen)
        yield pa.record_batch({"counter": pa.array(at.astype(np.int32)), "n": pa.array(seen[at])})

    made = texts.mapInArrow(W.tidied(count), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << SKETCH, np.uint8)
    levels[made["counter"].to_numpy()] = np.rint(4 * np.log2(made["n"].to_numpy()))
    return levels


def _prefixes(levels: np.ndarray, similarity: float, shingle: int):
    """(token, node, size, at): of each shingle set the first ones in the common order, with their places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches, 256):
            tokens, nodes, sizes, places = [np.empty(0, np.uint64)], [], [], [np.empty(0, np.int32)]
            for hashed in (shingles(t, shingle) for t in W.as_bytes(batch["text"])):
                n = len(hashed) - math.ceil(similarity * len(hashed) - 1e-9) + 1 if len(hashed) else 0
                tokens.append(hashed[np.lexsort((hashed, levels[hashed >> np.uint64(64 - SKETCH)]))[:n]])
                nodes.append(xxhash.xxh3_128_digest(hashed.tobytes()))
                sizes.append(len(hashed))
                places.append(np.arange(n, dtype=np.int32))
            own = np.repeat(np.arange(len(nodes)), [len(x) for x in places[1:]])
            held = (pa.array(nodes, pa.binary()).take(pa.array(own)), pa.array(sizes, pa.int32()).take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *held, pa.array(np.concatenate(places))], names=["token", "node", "size", "at"])

    return emit


def _placed(lists: DataFrame) -> DataFrame:
    """``lists`` with each row's ``rank`` in its token's list by size and node; a long list spans many partitions."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            tokens = batch["token"].to_numpy()
            if not len(tokens):
                continue
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            within = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
            if tokens[0] == last:
                within[: starts[1] if len(starts) > 1 else len(tokens)] += done
            last, done = tokens[-1], int(within[-1]) + 1
            added = [pa.array(np.full(len(tokens), part, np.int32)), pa.array(within)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "within"])

    ordered = lists.repartitionByRange("token", "size", "node").sortWithinPartitions("token", "size", "node")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.schema.fields)
    numbered = settle(ordered.mapInArrow(number, f"{fields}, part int, within long"), "numbered")
    before = Window.partitionBy("token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = numbered.groupBy("token", "part").agg(F.count("*").alias("held"))
    past = held.withColumn("past", F.sum("held").over(before)).where("past > 0").select("token", "part", "past")
    placed = numbered.join(past, ["token", "part"], "left").withColumn("rank", F.col("within") + F.coalesce("past", F.lit(0))).drop("part", "within", "past")
    placed = settle(placed, "placed")
    release(numbered)
    return placed


def candidate_lists(docs: DataFrame, similarity: float, text_col: str, shingle: int) -> DataFrame:
    """(token, node, size, at, n, rank): lists of the shingle sets that may be this similar; two that are share one."""
    texts = docs.select(F.col(text_col).alias("text"))
    rows = texts.mapInArrow(W.tidied(_prefixes(_levels(texts, shingle), similarity, shingle)), "token long, node binary, size int, at int")
    rows = settle(rows.distinct(), "prefixes")
    shared = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    lists = settle(rows.join(shared, "token"), "lists")
    release(rows)
    placed = _placed(lists)
    release(lists)
    return placed


def _renamed(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """``rows`` with the group in ``column`` replaced where ``groups`` (node, component) has another name for it."""
    to = groups.select(F.col("node").alias(column), F.col("component").alias("__to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def join_exactly(placed: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> list[DataFrame]:
    """Components (node, component) over the groups of ``roots``, one table a round, to be applied in turn.

    Round by round rows of a list meet that are further apart in it; a list is done when all its rows
    are in one group or no distance is left, so in the end no pair in different groups is unchecked.
    Each table is removed, ``placed`` too, once the one made of it is written.
    """
    live, low, made, held = _renamed(placed.withColumn("own", F.col("node")), roots, "own"), 1, [], placed
    while True:
        apart = live.groupBy("token").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
        live = settle(live.where(F.col("n") > low).join(apart, "token", "left_semi"), "live")
        release(held)
        held = live
        if not live.head(1):
            release(held)
            return made
        far = F.least(F.lit(STEP * low - 1), F.col("n") - 1 - F.col("rank"))
        left = live.where(F.col("rank") + low < F.col("n")).select("token", F.struct("node", "own").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), F.explode(F.sequence(F.col("rank") + low, F.col("rank") + far)).alias("rank"))
        met = left.join(live.select("token", "rank", F.struct("node", "own").alias("y"), "size", "at"), ["token", "rank"]).where("x.own <> y.own")
        # as many shingles as this one and those after it can be shared if it is the first shared one, as in one list of a pair
        need = F.lit(similarity / (1 + similarity)) * (F.col("x_size") + F.col("size")) - 1e-6
        met = met.where(F.least(F.col("x_size") - F.col("x_at"), F.col("size") - F.col("at")) >= need)
        pairs = settle(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().select(F.col("x.node").alias("u"), F.col("x.own").alias("u_own"), F.col("y.node").alias("v"), F.col("y.own").alias("v_own")), "pairs")
        links = settle(_checked(pairs, sets, similarity).join(pairs, ["u", "v"]).select("u_own", "v_own"), "checked")
        release(pairs)
        if links.head(1):
            made.append(settle(components(links, "u_own", "v_own"), "joined"))
            live = _renamed(live, made[-1], "own")
        release(links)
        low *= STEP


def drop_similar(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies: that of the smallest id,
    then of the smallest text hash. All columns stay, in their order.

    A group is what links lead to; two texts link if their shingle sets are of ``similarity`` or more,
    compared exactly, and no other do. A-Z is
    lower-cased; a text of fewer words than a shingle is one shingle; null and empty texts form one
    group. Null ids come last; of rows that repeat id and text one is kept.
    """
    sure, limit = limits_for(similarity)
    marked = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = marked.select("node", _node("f").alias("print")).distinct()
    named = settle(named.join(named.groupBy("print").agg(F.min("node").alias("rep")), "print"), "named")
    prints = settle(marked.select(*PARTS).distinct(), "distinct")
    links = settle(link_similar(prints, sure, limit), "links")
    release(prints)
    reps = named.select("print", "rep").distinct()
    ends = links.join(reps.withColumnsRenamed({"print": "u", "rep": "a"}), "u").join(reps.withColumnsRenamed({"print": "v", "rep": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "sure")
    ends = settle(ends.unionByName(named.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"), F.lit(True).alias("sure"))), "ends")
    release(links)
    release(named)
    placed = candidate_lists(docs, similarity, text_col, shingle)
    nodes = placed.select("node").unionByName(ends.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = settle(_sets(docs, marked, nodes, id_col, text_col, shingle), "sets")
    roots = settle(components(_checked(ends, sets, similarity)), "roots")
    release(ends)
    rooted = _renamed(marked.select("id", "key", F.col("node").alias("root")), roots, "root")
    for joined in join_exactly(placed, sets, roots, similarity):
        rooted = _renamed(rooted, joined, "root")
    rooted = settle(rooted, "rooted")
    for done in (sets, roots, marked):
        release(done)
    return keep_first(docs, rooted, id_col, text_col)
