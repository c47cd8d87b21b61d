"""Token counts: a map-side two-tier lookup of the lengths of frequent pre-tokens.

A byte-level BPE splits a text into pre-tokens that never cross a single space (or line end) between two
other characters, so a text is cut there into pieces whose token counts add up. The most frequent pieces of
all documents, found by bounded summaries that each task makes and that are merged in a tree, are
counted once and broadcast as a table (at most ``frequent`` entries of at most 64 characters).
Pieces outside the table go through a worker's own cache; misses are encoded in batches. No piece
is shuffled; texts stay where they are read.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

FREQUENT, LONGEST, SUMMARY, CACHE = 131_072, 64, 131_072, 100_000
_CLOSE = ("  ", " \n", "\n ", "\n\n")
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: A space and a line end as byte-level pre-tokenizers write them.
_SPACE, _LINE_END = "\u0120", "\u010a"
RUN = 256


def pieces(text: str) -> list[str]:
    """The text cut before single spaces and line ends that stand between two other characters.

    A piece that starts with a line end stands for itself, any other for a space and the piece; the
    first one gets a line end.
    """
    if not any(x in text for x in _CLOSE) and text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in _RARE):
        return ("\n" + text).replace("\n", " \n")[1:].split(" ")
    return _CUT.split("\n" + text) if text[0] not in " \n" else ["\n" + text]


def slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[list[str | None]]:
    """Runs of texts of about ``limit`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _trim(counter: Counter, size: int) -> Counter:
    """The ``size`` most frequent, each lessened by the largest count left out (a bounded summary)."""
    if len(counter) <= size:
        return counter
    ranked = counter.most_common(size + 1)
    floor = ranked[-1][1]
    return Counter({k: n - floor for k, n in ranked[:-1] if n > floor})


def frequent_pieces(docs: DataFrame, text_col: str = "text", size: int = FREQUENT) -> list[str]:
    """The pieces that occur most often in all documents; at most ``size`` come to the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for run in slices(batch["text"].to_pylist()):
                counter.update(chain.from_iterable(pieces(t) for t in run if t))
                if len(counter) > 4 * SUMMARY:
                    counter = _trim(counter, SUMMARY)
        counter = _trim(Counter({k: n for k, n in counter.items() if len(k) <= LONGEST}), SUMMARY)
        yield pa.record_batch({"summary": pa.array([pickle.dumps(dict(counter))], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        counter: Counter = Counter()
        for blob in table["summary"]:
            counter.update(pickle.loads(blob.as_py()))
            if len(counter) > 4 * SUMMARY:
                counter = _trim(counter, SUMMARY)
        return pa.table({"summary": pa.array([pickle.dumps(dict(_trim(counter, SUMMARY)))], pa.binary()), "slot": pa.array([key[0].as_py()], pa.int64())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(summarise, "summary binary").withColumn("slot", F.spark_partition_id().cast("long"))
    for width in (1024, 32, 1):
        rows = rows.withColumn("slot", F.col("slot") % width).groupBy("slot").applyInArrow(merge, "summary binary, slot long")
    found: Counter = Counter()
    for row in rows.collect():  # one row
        found.update(pickle.loads(row["summary"]))
    return [k for k, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size]]


def load_tokenizer(data: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(data)
    made.no_truncation()
    made.no_padding()
    return made


def _special(data: str) -> list[str]:
    import json

    return [t["content"] for t in json.loads(data)["added_tokens"]]


def _splits(data: str) -> bool:
    """Whether texts may be cut at single spaces: a plain byte-level pre-tokenizer and no normaliser."""
    import json

    made = json.loads(data)
    pre = made.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
    return made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


class Counts:
    """Token counts of texts in one worker: the broadcast table, then the worker's cache, then the library."""

    def __init__(self, data: str, table: dict[str, int]):
        self.tokenizer = load_tokenizer(data)
        self.table, self.known = table, dict(table)
        self.older: dict[str, int] = {}
        self.special, self.splits = _special(data), _splits(data)
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token.startswith(_SPACE) or token == _LINE_END
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _encode(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for low in range(0, len(texts), 1024):
            out += [len(x) for x in self.tokenizer.encode_batch_fast(texts[low : low + 1024], add_special_tokens=False)]
        return out

    def lengths(self, found: list[str]) -> dict[str, int]:
        """Tokens of each piece; pieces without inner white space are encoded many to a text."""
        clean = [p for p in found if p and (x := p[p[0] == "\n" :]) and x.split() == [x]]
        out: dict[str, int] = {}
        runs = [clean[low : low + RUN] for low in range(0, len(clean), RUN)]
        for low in range(0, len(runs), 64):
            part = runs[low : low + 64]
            made = self.tokenizer.encode_batch_fast(["".join([p if p[0] == "\n" else " " + p for p in run]) for run in part], add_special_tokens=False)
            for run, got in zip(part, made):
                ids = np.array(got.ids, np.int64)
                starts = np.flatnonzero(self.starts[ids])
                if len(starts) == len(run) and starts[0] == 0:
                    out.update(zip(run, np.diff(starts, append=len(ids)).tolist()))
        rest = [p for p in found if p not in out]
        out.update(zip(rest, self._encode([p if p[:1] == "\n" else " " + p for p in rest])))
        return out

    def of(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [self._encode([t])[0] if t else 0 for t in texts]
        at, out, cuts = [], [], []
        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.cut and self.cut.search(parts[0]):
                parts = self.cut.split(parts[0])
            out.append(len(parts) - 1)  # each special string is one token
            for part in parts:
                if part:
                    at.append(i)
                    cuts.append(pieces(part))
        if len(self.known) > len(self.table) + CACHE:  # what was used since the last time stays at hand
            self.older, self.known = self.known, dict(self.table)
        known, older = self.known, self.older
        new = [p for p in set(chain.from_iterable(cuts)) if p not in known]
        known.update((p, older[p]) for p in new if p in older)
        known.update(self.lengths([p for p in new if p not in known]))
        for i, cut in zip(at, cuts):
            out[i] += sum(map(known.__getitem__, cut)) - self.line_end(cut[0])
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def line_end(self, first: str) -> int:
        """Tokens that the line end before a text's first piece adds."""
        if len(first) > 1 and first[1] not in " \n" and first[1] not in _RARE:
            return 1
        return self.known[first] - self._encode([first[1:]])[0]


_MADE: dict[str, Counts] = {}


def _worker(name: str, shared) -> Counts:
    """One per worker process, which keeps its cache from task to task."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Counts(*shared.value)
    return _MADE[name]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """All columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Tokens are those the tokenizers library gives for the .json at ``tokenizer_path``, without begin,
    end or added tokens and without truncation or padding; special strings inside a text count as the
    library takes them by default. Null texts count as empty. Columns of ``docs`` with one of the
    three names are replaced. The path is read by the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        data = file.read()
    spark = docs.sparkSession
    table: dict[str, int] = {}
    if _splits(data) and frequent:
        found = frequent_pieces(docs, text_col, frequent)
        table = Counts(data, {}).lengths(found)
    shared, name = spark.sparkContext.broadcast((data, table)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _worker(name, shared)
        for batch in batches:
            n: list[int] = []
            for run in slices(batch[text_col].to_pylist()):
                n += made.of(run)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    columns = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = docs.select(*columns)
    counted = kept.mapInArrow(count, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
