"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Texts are dealt into chunks of a few megabytes. Each chunk sends every window hash it holds once
per bucket of hashes, with a mark if the chunk itself holds it twice, so a window that occurs in a
third of all texts reaches its bucket once per chunk at most. A bucket finds the hashes that more
than one chunk holds or one chunk marks, and answers each chunk with one bit per hash. The chunk
then merges repeated windows into maximal intervals. Texts move once; the two uses of the dealt
texts share one shuffle.

A hash has 64 bits beside the bucket, which comes from a second hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm import words as W

SCHEMA = "n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>"


def _spread(texts: list[bytes | None], size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct windows in bucket order: hashes, buckets, counts; which of them each window is; each text's number of words."""
    hashed, checked, lengths = [], [], []
    for first, end, _, _, _, words, cut in W.worded(texts, W.PLAIN):
        one, two = W.windows(words, size), W.windows(words, size, check=True)
        counts = np.diff(cut)
        lengths.append(counts)
        for low, n in zip(cut[:-1], counts):
            if n >= size:
                hashed.append(one[low : low + n - size + 1])
                checked.append(two[low : low + n - size + 1])
    if not hashed:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, np.concatenate(lengths) if lengths else none
    found, at, which, count = np.unique(np.concatenate(hashed), return_index=True, return_inverse=True, return_counts=True)
    bucket = (np.concatenate(checked)[at] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], bucket[order], count[order], place[which], np.concatenate(lengths)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def dedup_substrings(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, bucket_windows: int = 2 << 20) -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts anywhere else.

    Returns one row per row of ``docs``: the id, n_words, n_removed, kept_text (kept words joined by
    one space) and removed, the maximal intervals of removed words (end exclusive). Windows are
    judged on the input. A null text has no words and keeps the empty text; a text of fewer than
    ``size`` words keeps all. Rows that repeat each other, ids and all, are texts like any others
    and lose their common windows. Other columns are not read. ``chunk_bytes`` and
    ``bucket_windows`` bound what a task holds; raise them on large executors, where chunks times
    buckets should stay well below the number of windows.
    """
    if size < 1:
        raise ValueError("size must be positive")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(math.ceil(total / chunk_bytes), min(partitions, 1 + total // 65536))
    buckets = max(math.ceil(total / 6 / bucket_windows), min(partitions, 1 + total // 65536))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        found, bucket, count, _, _ = _spread(W.as_bytes(table["text"]), size, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(bucket))
        return pa.table({
            "bucket": pa.array(bucket[cuts], pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "hashes": pa.array([found[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "twice": pa.array([_bits(count[a:b] > 1) for a, b in zip(cuts, ends)], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        every = np.concatenate(parts)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["twice"].to_pylist(), parts)]).astype(bool)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.cumsum(new) - 1
        often = (np.bincount(group) > 1) | (np.bincount(group, weights=twice[order]) > 0)
        flags = np.empty(len(every), bool)
        flags[order] = often[group]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({
            "chunk": table["chunk"].cast(pa.int64()),
            "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "often": pa.array([_bits(flags[e - len(p) : e]) for e, p in zip(ends, parts)], pa.binary()),
        })

    def keep(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = W.as_bytes(table["text"])
        found, bucket, _, which, lengths = _spread(texts, size, buckets)
        often = np.zeros(len(found), bool)
        for b, bits in sorted(zip(answers["bucket"].to_pylist(), answers["often"].to_pylist())):
            low, high = np.searchsorted(bucket, [b, b + 1])
            often[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        flagged, at = often[which] if len(which) else np.empty(0, bool), 0
        out: dict[str, list] = {"n_removed": [], "kept_text": [], "removed": []}
        for text, n in zip(texts, lengths.tolist()):
            n_windows = max(0, n - size + 1)
            hit = np.flatnonzero(flagged[at : at + n_windows])
            at += n_windows
            split = (text or b"").split()  # at ASCII white space, which is the word class
            if not len(hit):
                out["n_removed"].append(0)
                out["kept_text"].append(b" ".join(split).decode())
                out["removed"].append([])
                continue
            breaks = np.flatnonzero(np.diff(hit) > size)
            lows, highs = hit[np.append(0, breaks + 1)], hit[np.append(breaks, len(hit) - 1)] + size
            kept, last = [], 0
            for low, high in zip(lows.tolist(), highs.tolist()):
                kept += split[last:low]
                last = high
            out["n_removed"].append(int((highs - lows).sum()))
            out["kept_text"].append(b" ".join(kept + split[last:]).decode())
            out["removed"].append([{"start": a, "end": b} for a, b in zip(lows.tolist(), highs.tolist())])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "id": table["id"], "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept_text": pa.array(out["kept_text"], pa.string()), "removed": pa.array(out["removed"], span),
        })

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, hashes binary, twice binary")
    answered = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, often binary")
    id_type = rows.schema["id"].dataType.simpleString()
    kept = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(keep, f"id {id_type}, {SCHEMA}")
    return kept.withColumnRenamed("id", id_col)
