"""Periodic runs of words: stretches in which a block of words is repeated three times or more.

A word that occurs fewer than three times within a segment cannot belong to a run there, so it
splits the segment; this goes on until no segment changes. What survives is scanned by lag. The lag
scan needs no trial of every lag: in a run of smallest period q, a window of q words or more recurs
next exactly q words later, so windows of 1, 2, 4, ... words give the lags of their own order of size.
Work grows with n log n. Many texts are handled in one pass over arrays; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm import words as W

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def split_rare(words: np.ndarray, segment: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive, and the number of the segment that each lies in. A run of ``repeats``
    periods or more holds each of its words ``repeats`` times at least."""
    at = np.arange(len(words))
    kinds = _ranks(words)
    while len(at):
        _, which, count = np.unique(segment * (kinds.max() + 1) + kinds, return_inverse=True, return_counts=True)
        often = count[which] >= repeats
        kept, owner = at[often], segment[often]
        new = np.concatenate(([True], (np.diff(kept) > 1) | (np.diff(owner) != 0))) if len(kept) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= least if len(kept) else np.empty(0, bool)
        if often.all() and long.all():
            return at, number
        at, segment = kept[long], number[long]
        kinds = _ranks(words[at])
    return at, segment


def lag_scan(words: np.ndarray, segment: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs within the segments, numbered within ``words``."""
    out, n = [], len(words)
    if not n:
        return out
    last = np.flatnonzero(np.append(np.diff(segment) != 0, True))
    end = (last + 1)[np.searchsorted(last, np.arange(n))]  # one past each place's segment
    longest = int(np.bincount(segment).max())
    # A window's number is that of its words and of its segment; -1 stands for no window, or one that occurs once.
    window, size = _ranks(segment * (int(_ranks(words).max()) + 1) + _ranks(words)), 1
    while True:
        places = np.flatnonzero(window >= 0)
        order = places[np.argsort(window[places], kind="stable")]
        same = window[order[1:]] == window[order[:-1]]
        here, lag = order[:-1][same], np.diff(order)[same]
        fits = (lag * 2 > size) & (lag <= size)
        here, lag = here[fits], lag[fits]
        if len(here):
            by_place = np.argsort(here)
            here, lag = here[by_place], lag[by_place]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(here) != 1) | (np.diff(lag) != 0))))
            until = np.append(first[1:], len(here)) - 1
            period = lag[first]
            length = here[until] - here[first] + size + period
            good = length >= np.maximum(least, repeats * period)
            out += zip(here[first][good].tolist(), length[good].tolist(), period[good].tolist())
        # The next size is of use if some lag above this one still fits a segment.
        if not same.any() or repeats * (size + 1) > longest:
            return out
        recurs = np.zeros(n, bool)
        recurs[order[:-1][same]] = recurs[order[1:][same]] = True
        can = np.flatnonzero(recurs[: n - size] & recurs[size:] & (np.arange(n - size) + 2 * size <= end[: n - size]))
        wider = np.full(n, -1, np.int64)
        if len(can):
            wider[can] = _ranks(window[can] * (int(window.max()) + 1) + window[can + size])
        window, size = wider, 2 * size


def find_runs(docs: DataFrame, least: int = 24, repeats: int = 3, text_col: str = "text") -> DataFrame:
    """Runs of each text, and the text with each run cut down to its first period.

    A run is a stretch of consecutive words with smallest period q and at least max(``least``,
    ``repeats`` * q) words that no neighbouring word extends. Words are stretches without ASCII white
    space, taken as they stand from the whole text; two words are the same if their 64-bit hashes are.
    ``repeats`` is 3 or more: the lag scan rests on it. Returns the columns of ``docs`` without the text (n_words, runs and
    collapsed replace columns of these names), then n_words, runs (start, length, period; words
    numbered from 0; by start, then period) and collapsed, the words left, joined by one space: a word
    goes if any run holds it behind the run's first period. A null or blank text has no words, no
    runs and an empty collapsed text. Rows that repeat each other each get their result; an empty table gives an empty one.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    made = ["n_words", "runs", "collapsed"]
    others = [c for c in docs.columns if c not in (text_col, *made)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            texts = W.as_bytes(batch.column(0))
            counts, found, left = [], [], []
            for first, last, _, _, _, hashed, bounds in W.worded(texts, W.PLAIN):
                sizes = np.diff(bounds)
                at, segment = split_rare(hashed, np.repeat(np.arange(len(sizes)), sizes), least, repeats)
                runs: list[list] = [[] for _ in sizes]
                for start, length, period in sorted(lag_scan(hashed[at], segment, least, repeats), key=lambda r: (r[0], r[2])):
                    doc = int(np.searchsorted(bounds, at[start], "right")) - 1
                    runs[doc].append({"start": int(at[start] - bounds[doc]), "length": length, "period": period})
                counts += sizes.tolist()
                found += runs
                left += [_collapsed(text, of) for text, of in zip(texts[first:last], runs)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())], names=[*batch.schema.names[1:], *made])

    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    rows = docs.select(F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    found = rows.mapInArrow(W.tidied(work), f"{fields}, {SCHEMA}" if others else SCHEMA)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *made)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(text: bytes | None, runs: list[dict]) -> str:
    split = (text or b"").split()  # at ASCII white space, which is the word class
    if runs:
        gone = np.zeros(len(split), bool)
        for r in runs:
            gone[r["start"] + r["period"] : r["start"] + r["length"]] = True
        split = [w for w, g in zip(split, gone.tolist()) if not g]
    return b" ".join(split).decode()


def longest_run(runs: Column) -> Column:
    """The run of the greatest length by period, compared exactly; of equal ones the smallest start, then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """One text in ten, by the crc32 of its id, made periodic from some word on; others, and those of a null id, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        # Bound as a lambda's argument, so that the places are worked out once a text, not once a word.
        known = F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p")))
        place = lambda k, i: F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"])
        moved = F.transform(known, lambda k: F.transform(k["w"], lambda _, i: F.get(k["w"], place(k, i).cast("int"))))
        return F.array_join(moved[0], " ")

    altered = F.transform(F.array(split), repeat)[0]
    return F.when(h % 10 == 0, altered).otherwise(text)
