"""Words of a text as numpy arrays: places, 64-bit hashes, and rolling hashes of word windows.

Small helpers that run inside tasks on one Arrow batch or one chunk at a time. Separators are ASCII
in either word class, so texts are cut as UTF-8 bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SIDE = 1 << 18  # bytes or words handled at a time
_BYTE_BASE, _WORD_BASE, _CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _class(separators: list[int], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    inside, folded = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
    inside[separators] = False
    return inside[folded], folded


#: Words [^\x20\x09-\x0D]+ as they stand.
PLAIN = _class([0x20, *range(0x09, 0x0E)], fold=False)
#: The same after lower-casing A-Z.
FOLDED = _class([0x20, *range(0x09, 0x0E)], fold=True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
LETTERS = _class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], fold=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16, 2 * len(have[0]) if have else 0)
        table = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            table.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[base] = (table[0], table[1])
    return have


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def tidied(work):
    """``work`` over Arrow batches; at its end the memory it freed goes back to the system, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def places(data: bytes, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = kind[0][np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edges[::2], edges[1::2]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums over runs of at most _SIDE bytes."""
    out = np.empty(len(starts), np.uint64)
    raw, i = np.frombuffer(data, np.uint8), 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SIDE, "right")))
        high = int(ends[j - 1])
        if high - low > _SIDE:  # one very long word
            out[i] = xxhash.xxh64_intdigest(kind[1][raw[low:high]].tobytes(), 7)
            i = j
            continue
        power, inverse = _power_table(_BYTE_BASE, _SIDE)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[kind[1][raw[low:high]]] * power[: high - low], out=sums[1:], dtype=np.uint64)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def windows(words: np.ndarray, size: int, check: bool = False) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` word hashes; one value per start. ``check``: by a second base."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    base = _CHECK_BASE if check else _WORD_BASE
    power, inverse = _power_table(base, min(n, _SIDE) + size)
    for low in range(0, n, _SIDE):
        high = min(n, low + _SIDE)
        part = words[low : high + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:], dtype=np.uint64)
        out[low:high] = mix((sums[size:] - sums[:-size]) * inverse[: high - low])
    return out


def joined(texts: list[bytes | None], limit: int = _SIDE) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Texts in runs of at most ``limit`` bytes (a longer text alone): first, end, the bytes joined by blanks, each text's offset and one past the last."""
    first = 0
    while first < len(texts):
        size, end = 0, first
        while end < len(texts) and (end == first or size + len(texts[end] or b"") < limit):
            size += len(texts[end] or b"") + 1
            end += 1
        run = [x or b"" for x in texts[first:end]]
        yield first, end, b" ".join(run), np.cumsum([0, *(len(x) + 1 for x in run)])
        first = end


def worded(texts: list[bytes | None], kind: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts with their words: first, end, bytes, word starts, word ends, word hashes, and each text's first word and one past the last."""
    for first, end, data, offsets in joined(texts):
        starts, ends = places(data, kind)
        yield first, end, data, starts, ends, hashes(data, starts, ends, kind), np.searchsorted(starts, offsets)
