"""Vectorised helpers on the UTF-8 bytes of Arrow string columns, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the hashes; any change alters every stored fingerprint.
POLY = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POLY**i and its inverse modulo 2**64, for i < n; kept per worker."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", POLY), ("down", pow(POLY, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives the memory it held back to the system when it ends, so workers that wait hold little."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX_1
    h ^= h >> np.uint64(27)
    h *= MIX_2
    h ^= h >> np.uint64(31)
    return h


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `most` bytes; a longer text is a run of its own; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes b with is_word[b], cut at text ends), and the first word of each text (one more)."""
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = is_word[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    a = np.flatnonzero(starts)
    return a, np.flatnonzero(ends) + 1, np.searchsorted(a, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * MIX_2)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n successive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out *= MIX_1
        out += h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def byte_class(*keep: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    for a, b in keep:
        out[a : b + 1] = True
    return out


#: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Upper-case ASCII letters to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal keys (longs); runs may cross batches. Rows must come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = k[:, a].tolist()
            if held and key != last:
                yield joined()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield joined()
