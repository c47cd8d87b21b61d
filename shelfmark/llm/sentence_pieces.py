"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field; its normaliser, metaspace marker, piece scores (unigram)
or merges (BPE) and byte fallback are rebuilt as a tokenizers model. No piece of such a model has a
marker after another character, so a marked text falls into segments (a marker and what follows)
that are encoded apart; a task keeps the segments it has seen, at most twice CACHE of at most 256
characters between two runs of texts, and encodes new ones in multithreaded batches. Every new segment is also encoded by the sentencepiece library; where the two
differ the latter's ids are taken, and ``parity`` of the text is false.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.token_counts import slices
from shelfmark.llm.words import tidied

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE, RUN = 80_000, 256
_CUT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; messages and strings as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """What a .model file says: pieces with scores and kinds, the trainer's model type, the normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unk, self.byte_fallback = 1, 0, False
        self.charsmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                self.kind, self.byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
            elif number == 3:
                normaliser = dict(fields(value))
                self.charsmap = normaliser.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        text = [p[0] for p in self.pieces if p[2] in (NORMAL, USER)]
        self.splits = self.escape and not any(MARK in p.lstrip(MARK) for p in text) and not any("\n" in p for p in text) and not any(p[2] == USER for p in self.pieces)


def merges(model: Model) -> list[tuple[str, str]]:
    """Each way to make a piece of two others, best piece first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    ways = [(-score[p], rank[p], rank[p[:i]], rank[p[i:]], p[:i], p[i:]) for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
    return [(x[4], x[5]) for x in sorted(ways)]


def build_tokenizer(model: Model, split: bool = False):
    """A tokenizers.Tokenizer over marked text, with the model's character map and a metaspace decoder; ``split``: markers also cut the text."""
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk][0]
    if model.kind == 2:
        made = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback))
    elif model.kind == 1:
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback))
    else:
        raise ValueError("word and character models are not supported")
    if model.charsmap:
        made.normalizer = normalizers.Precompiled(model.charsmap)
    if split:
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "merged_with_next"), pre_tokenizers.Metaspace(MARK, "never", True)])
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    made.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * model.prefix)
    return made


def _surface(piece: str, kind: int) -> bytes:
    """What a piece stands for in a text."""
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    return b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()


class Learnt:
    """Segments by number, and the ids of all of them in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts) - 1
        self.number.update(zip(segments, range(first, first + len(segments))))
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered segments one after another, and how many each has."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        behind = np.cumsum(sizes)
        places = np.arange(behind[-1] if len(behind) else 0) + np.repeat(self.starts[numbers] - behind + sizes, sizes)
        return self.ids[places], sizes


class Coder:
    """Encodes and decodes in one task."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = Model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.splitter = build_tokenizer(self.model, split=True)
        self.line_end = next((i for i, p in enumerate(self.model.pieces) if p[2] == BYTE and p[0] == "<0x0A>"), None)
        self.starts = np.array([p.startswith(MARK) or i == self.line_end for i, (p, _, _) in enumerate(self.model.pieces)])
        self.bytes = [_surface(p, kind) for p, _, kind in self.model.pieces]
        self.forget()

    def forget(self) -> None:
        """Drop the segments learnt so far."""
        self.known, self.older = Learnt(), Learnt()
        self.differ: set[str] = set()

    def normal(self, text: str) -> str:
        """The text as the model sees it, with spaces."""
        if self.model.charsmap:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def segments(self, text: str) -> list[str]:
        """The marked text cut before markers and line ends; a run of markers stays with what follows."""
        text = self.normal(text)
        if not text:
            return []
        if not self.model.escape:
            return [MARK * self.model.prefix + text]
        marked = MARK * self.model.prefix + text.replace(" ", MARK)
        if not self.model.splits:
            return [marked]
        if MARK + MARK in marked or "\0" in marked:
            return _CUT.findall(marked)
        return marked.replace(MARK, "\0" + MARK).replace("\n", "\0\n").split("\0")

    def learn(self, new: list[str]) -> None:
        """Ids of segments not seen yet; those of one marker, or a line end, at their start go many to a text."""
        prefix = self.model.prefix
        clean = [p for p in new if len(p) > 1 and (p[0] == MARK or self.line_end is not None and p[0] == "\n") and MARK not in p[1:] and "\n" not in p[1:]] if prefix and self.model.splits else []
        runs = [run for low in range(0, len(clean), RUN) if (run := [MARK + "x", *clean[low : low + RUN]])]
        found: list[str] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for low in range(0, len(runs), 32):
            part = runs[low : low + 32]
            made = self.splitter.encode_batch_fast(["".join(run) for run in part], add_special_tokens=False)
            want = self.reference.encode(["".join(run)[1:].replace(MARK, " ") for run in part], num_threads=2)
            for run, got, other in zip(part, made, want):
                if got.ids != other:
                    continue
                ids = np.array(other, np.int32)
                starts = np.flatnonzero(self.starts[ids])
                if len(starts) == len(run):
                    found += run
                    parts.append(ids)
                    sizes.append(np.diff(np.append(starts, len(ids))))
        done = set(found)
        rest = [p for p in new if p not in done]
        for low in range(0, len(rest), 1024):
            part = rest[low : low + 1024]
            for p, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = tuple(got.ids)
                want = self._reference(p)
                if want is not None and ids != want:
                    ids = want
                    self.differ.add(p)
                found.append(p)
                parts.append(np.array(ids, np.int32))
                sizes.append(np.array([len(ids)]))
        if found:
            self.known.add(found, np.concatenate(parts), np.concatenate(sizes))

    def _reference(self, segment: str) -> tuple[int, ...] | None:
        """The sentencepiece library's ids of a segment; None where it has no text that gives just that segment."""
        plain = segment.replace(MARK, " ")
        if not self.model.prefix:
            return tuple(self.reference.encode(plain))
        if segment[:1] == MARK:
            return tuple(self.reference.encode(plain[1:])) if len(plain) > 1 else None
        lead = self.reference.encode("x")
        ids = self.reference.encode("x" + plain)
        return tuple(ids[len(lead) :]) if segment[:1] == "\n" and ids[: len(lead)] == lead else None

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[bool]]:
        """The ids of each text, and whether both libraries agree on it."""
        ids, sizes, same = self.encode_flat(texts)
        flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
        return [flat[end - size : end] for end, size in zip(ends, sizes.tolist())], same

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All ids one after another, the number of each text's, and whether both libraries agree on it."""
        cut = [self.segments(t) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        if len(self.known.number) > CACHE:  # what was used since the last time stays at hand
            self.older, self.known = self.known, Learnt()
        number = self.known.number
        found = np.fromiter(map(number.get, every, repeat(-1)), np.int64, len(every))
        unknown = np.flatnonzero(found < 0)
        new = list(dict.fromkeys(map(every.__getitem__, unknown.tolist())))
        back = [p for p in new if p in self.older.number]
        if back:
            self.known.add(back, *self.older.take(np.fromiter(map(self.older.number.__getitem__, back), np.int64, len(back))))
        self.learn([p for p in new if p not in self.older.number])
        found[unknown] = np.fromiter((number[every[k]] for k in unknown.tolist()), np.int64, len(unknown))
        ids, sizes = self.known.take(found)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))]
        same = [not self.differ or self.differ.isdisjoint(parts) for parts in cut]
        for p in new:
            if len(p) > 256:
                del number[p]
        return ids, np.diff(ends), same

    def decode(self, ids: list[list[int]]) -> list[str]:
        out = []
        for own in ids:
            text = b"".join(map(self.bytes.__getitem__, own))
            if self.model.prefix and text[:1] == b" ":
                text = text[1:]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:  # bytes that are no text
                out.append(self.reference.decode(list(own)))
        return out


_CODERS: dict[str, Coder] = {}


def coder_of(data: bytes) -> Coder:
    """The worker's coder of a model. One serves all its tasks: what the threads of a tokenizer have cached is not given
    back with the tokenizer, so one for each task would let the worker grow by some 40 MB a task."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(data)
    return _CODERS[key]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """All columns of ``docs`` with token_ids, n_tokens, parity and, if asked for, decoded.

    Null texts count as empty: no ids, and the empty string decoded. Columns of ``docs`` with one of
    the names are replaced. The model file is read by the driver.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    new = [("token_ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("parity", T.BooleanType())] + [("decoded", T.StringType())] * decode
    columns = [c for c in docs.columns if c not in dict(new)]
    kept = docs.select(*columns)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        try:
            for batch in batches:
                low = 0
                for run in slices(batch[text_col].to_pylist(), 1 << 20):
                    ids, sizes, same = coder.encode_flat(run)
                    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]
                    if decode:
                        flat = ids.tolist()
                        made.append(pa.array(coder.decode([flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]), pa.string()))
                    part = batch.slice(low, len(run))
                    low += len(run)
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *made], names=[*columns, *(n for n, _ in new)])
        finally:
            coder.forget()

    return kept.mapInArrow(tidied(encode), T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), *(T.StructField(n, t) for n, t in new)]))


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of ``rows`` with decoded: the text of the ids; null ids give the empty text, a decoded column is replaced."""
    with open(model_path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())
    columns = [c for c in rows.columns if c != "decoded"]
    kept = rows.select(*columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = coder.decode([x or [] for x in part[ids_col].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return kept.mapInArrow(tidied(decode), T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), T.StructField("decoded", T.StringType())]))
