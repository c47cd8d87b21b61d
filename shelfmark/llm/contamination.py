"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is ``size`` consecutive item words (a shorter item is one window). It is a set of shingles;
as the whole window must occur, its necessary prefix is one shingle, and the rarest over all
documents is taken. Documents are probed for prefix shingles only; a hit gives the start of the one
place where the window could be, the length and positional bounds drop places outside the document,
and what is left is compared word by word.

The window index is probed on the map side, so documents are not shuffled. It is broadcast in shards
of bounded size; with more than one shard, documents pass the shards one after another through
written tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm import words as W
from shelfmark.session import settle

SHINGLE = 5
#: An index row takes about 40 bytes and the bytes of its words.
SHARD_ROWS = 200_000


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window, words): every distinct window of every item; ``words`` joined by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            out: list[tuple] = []
            for item, text in zip(batch["item"].to_pylist(), W.as_bytes(batch["text"])):
                text = text or b""
                starts, ends = W.places(text, W.LETTERS)
                found = [text[s:e].lower() for s, e in zip(starts.tolist(), ends.tolist())]
                spans = [found[i : i + size] for i in range(max(1, len(found) - size + 1))] if found else []
                out += {(item, b" ".join(x)) for x in spans}
            yield pa.record_batch({"item": pa.array([x[0] for x in out], pa.string()), "words": pa.array([x[1].decode() for x in out], pa.string())})

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, words string").distinct()


def _shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    size = min(SHINGLE, len(words))
    return size, W.windows(words, size)


class Index:
    """Windows of one shard: their shingles, and after ``order`` the rarest shingle of each."""

    def __init__(self, rows: list[tuple[str, str]]):
        texts = sorted({words for _, words in rows})
        place = {t: i for i, t in enumerate(texts)}
        self.items: list[list[str]] = [[] for _ in texts]
        for item, words in sorted(rows):
            self.items[place[words]].append(item)
        self.texts = [t.encode() for t in texts]
        self.lengths = np.array([t.count(b" ") + 1 for t in self.texts], np.int64)
        self.shingles: list[tuple[int, np.ndarray]] = []
        for t in self.texts:
            starts, ends = W.places(t, W.LETTERS)
            self.shingles.append(_shingles(W.hashes(t, starts, ends, W.LETTERS)))
        self.sizes = sorted({s for s, _ in self.shingles})

    def all_keys(self) -> dict[int, np.ndarray]:
        return {size: np.unique(np.concatenate([h for s, h in self.shingles if s == size])) for size in self.sizes}

    def order(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: sorted prefix shingles, the window of each, and the shingle's place in it."""
        out: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.sizes}
        for window, (size, found) in enumerate(self.shingles):
            rarity = [counts.get((size, int(h)), 0) for h in found]
            at = min(range(len(found)), key=lambda i: (rarity[i], int(found[i]), i))
            if rarity[at]:  # a shingle that no document holds rules the window out
                out[size].append((int(found[at]), window, at))
        made = {}
        for size, rows in out.items():
            rows.sort()
            made[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        return made


def _sieve(keys: np.ndarray) -> np.ndarray:
    """Marks the low 20 bits of each key; most other hashes fall through."""
    marks = np.zeros(1 << 20, bool)
    marks[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return marks


def _found(hashed: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``hashed`` a key stands, and which key (the first of equal ones)."""
    at = np.flatnonzero(marks[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
    key = np.searchsorted(keys, hashed[at])
    hit = (key < len(keys)) & (keys[np.minimum(key, len(keys) - 1)] == hashed[at]) if len(keys) else np.zeros(len(at), bool)
    return at[hit], key[hit]


def _counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each shingle of the shard occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({s: (k, _sieve(k)) for s, k in keys.items()})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(k), np.int64) for s, (k, _) in shared.value.items()}
        for batch in W.small(batches):
            for _, _, _, _, _, words, cut in W.worded(W.as_bytes(batch["text"]), W.LETTERS):
                for size, (k, marks) in shared.value.items():
                    # runs over the end of a text only make a shingle look more common
                    _, key = _found(W.windows(words, size), k, marks)
                    total[size] += np.bincount(key, minlength=len(k))
        for size, n in total.items():
            some = np.flatnonzero(n)
            yield pa.record_batch({"size": pa.array(np.full(len(some), size), pa.int64()), "key": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    rows = docs.mapInArrow(W.tidied(tally), "size long, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], int(keys[r["size"]][r["key"]])): r["n"] for r in rows}


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, items (ids as strings, sorted) and contaminated.

    A document word is hit if it lies in any occurrence of a window; a document is contaminated if
    at least one word in ``one_in`` is hit, and one at least. Null and empty texts have no words
    and are clean. Items without words or without an id are ignored; equal items all count, an id
    counts once. Columns of ``docs`` that already have one of the four names are replaced. Rows that
    repeat each other get the same result.
    """
    spark = docs.sparkSession
    known = item_windows(items, size, item_id, item_text)
    n = known.count()
    shards = max(1, math.ceil(n / shard_rows))
    if shards > 1:
        known = settle(known.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards))), "windows")
    new = {"n_words", "n_hit", "items", "contaminated"}
    columns = [c for c in docs.columns if c not in new]
    slim = docs.select(F.col(text_col).alias("text"))
    state, marked = "__hits", docs.select(*columns)
    for shard in range(shards):
        rows = [(r["item"], r["words"]) for r in (known.where(F.col("shard") == shard) if shards > 1 else known).collect()]
        index = Index(rows)
        prefixes = index.order(_counts(slim, index.all_keys()) if rows else {})
        shared = spark.sparkContext.broadcast((index, {s: (*p, _sieve(p[0])) for s, p in prefixes.items()}))
        first, last = shard == 0, shard == shards - 1
        marked = marked.mapInArrow(W.tidied(_probe(shared, text_col, columns, state, first, last, one_in)), _schema(marked, columns, state, last))
        if not last:
            marked = settle(marked, "probed")
    return marked


def _schema(marked: DataFrame, columns: list[str], state: str, last: bool):
    from pyspark.sql import types as T

    kept = [T.StructField(f.name, f.dataType, True) for f in marked.schema if f.name in columns]
    if last:
        more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]
    else:
        more = [T.StructField(state, T.StructType([T.StructField("hit", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]))]
    return T.StructType(kept + more)


def _probe(shared, text_col: str, columns: list[str], state: str, first: bool, last: bool, one_in: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, prefixes = shared.value
        for batch in W.small(batches):
            texts = W.as_bytes(batch[text_col])
            before = [None] * len(texts) if first else batch[state].to_pylist()
            n_words, hits, items = [], [], []
            for begin, end, data, starts, ends, words, cut in W.worded(texts, W.LETTERS):
                covered = np.zeros(len(words) + 1, np.int64)
                seen: dict[int, set[str]] = {}
                for size, (keys, window, offset, marks) in prefixes.items():
                    at, key = _found(W.windows(words, size), keys, marks)
                    if not len(at):
                        continue
                    upto = np.searchsorted(keys, keys[key], "right")
                    for place, low, high in zip(at.tolist(), key.tolist(), upto.tolist()):
                        doc = int(np.searchsorted(cut, place, "right")) - 1
                        for k in range(low, high):
                            w = int(window[k])
                            start = place - int(offset[k])
                            stop = start + int(index.lengths[w])
                            if start < cut[doc] or stop > cut[doc + 1]:
                                continue
                            if b" ".join(data[a:b].lower() for a, b in zip(starts[start:stop].tolist(), ends[start:stop].tolist())) == index.texts[w]:
                                covered[start] += 1
                                covered[stop] -= 1
                                seen.setdefault(doc, set()).update(index.items[w])
                hit = np.cumsum(covered)[:-1] > 0
                for doc in range(end - begin):
                    low, high = int(cut[doc]), int(cut[doc + 1])
                    n_words.append(high - low)
                    own = set(np.flatnonzero(hit[low:high]).tolist()) if doc in seen else set()
                    names = seen.get(doc, set())
                    if (old := before[begin + doc]) is not None:
                        own, names = own | set(old["hit"]), names | set(old["items"])
                    hits.append(sorted(own))
                    items.append(sorted(names))
            out = [batch[c] for c in columns]
            if last:
                n_hit = [len(x) for x in hits]
                out += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_words", "n_hit", "items", "contaminated"])
            else:
                kind = pa.struct([("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                out.append(pa.array([{"hit": h, "items": i} for h, i in zip(hits, items)], kind))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, state])

    return probe

