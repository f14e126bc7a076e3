"""Vectorised word and window hashing over Arrow string buffers.

All kernels work on the concatenated UTF-8 bytes of a slice of rows. A word is a
maximal run of bytes outside ``\\x20 \\x09-\\x0D``; these bytes never occur inside
a multi-byte character, so byte words are character words.

Runs of bytes are hashed eight at a time through an avalanche step, runs of words by
joining the hashes of two overlapping blocks of a power of two of words, blocks by
joining their halves. Every step is mixed, so no linear relation between texts (such
as Thue-Morse words have modulo 2**64) makes hashes equal.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 19
LONG_RUN = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step (the splitmix64 finalizer constants are fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Gives freed memory back to the system: Spark keeps idle Python workers alive."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that the column's text takes at most ``limit`` bytes.

    A single longer text comes alone and whole. Memory is given back at the end.
    """
    yield from _slices(batches, column, limit)
    release()


def _slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end); runs of over ``LONG_RUN`` bytes by xxh3."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) * _ODD)
    live, done = np.flatnonzero((size > 0) & (size <= LONG_RUN)), 0
    while len(live):
        left = size[live] - done
        chunk = eight[starts[live] + done]
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        chunk &= np.uint64(2**64 - 1) >> (np.uint64(64) - keep)
        out[live] = mix((out[live] ^ chunk) * _ODD2 + _ODD)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 1)
    return out


def join_hashes(a: np.ndarray, b: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    return mix(a * _ODD + b + (np.asarray(salt).astype(np.uint64) * _ODD2))


class Runs:
    """Hashes of runs of words, from blocks of 1, 2, 4, ... words, made on demand."""

    def __init__(self, hashes: np.ndarray):
        self.blocks = [hashes]

    def __len__(self) -> int:
        return len(self.blocks[0])

    def block(self, power: int) -> np.ndarray:
        """Hashes of the runs of 2**power words from each place."""
        while len(self.blocks) <= power:
            last, step = self.blocks[-1], 1 << (len(self.blocks) - 1)
            self.blocks.append(join_hashes(last[: max(len(last) - step, 0)], last[step:]))
        return self.blocks[power]

    def windows(self, width: int) -> np.ndarray:
        """Hash of every run of ``width`` words, over row ends as well (callers drop those)."""
        power = width.bit_length() - 1
        block, ahead = self.block(power), width - (1 << power)
        return join_hashes(block[: max(len(block) - ahead, 0)], block[ahead:], width)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, stop), equal to those of ``windows``; 0 of empty runs."""
        size = stop - start
        out = np.zeros(len(size), np.uint64)
        power = np.frexp(np.maximum(size, 1))[1] - 1
        for p in np.unique(power[size > 0]).tolist():
            at = np.flatnonzero((power == p) & (size > 0))
            block = self.block(p)
            out[at] = join_hashes(block[start[at]], block[stop[at] - (1 << p)], size[at])
        return out


class Words:
    """Words of a slice: byte bounds, rows' word offsets, and 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(column)
        data, offs = self.data, self.offsets
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offs[:-1] < offs[1:]
        at = offs[:-1][full]
        first[at] = inside[at]
        at = offs[1:][full] - 1
        last[at] = inside[at]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offs)
        self.hashes = run_hashes(LOWER[data] if lower else data, self.starts, self.ends)

    def runs(self) -> Runs:
        return Runs(self.hashes)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def parts_of(text: bytes, limit: int, overlap: int) -> list[tuple[int, bytes]]:
    """(first word, bytes) of parts of a long text that follow each other, each with the next ``overlap`` words.

    A part ends before a word, so that every run of ``overlap + 1`` words is whole in exactly one part.
    """
    if len(text) <= limit:
        return [(0, text)]
    cuts, at, out, words = [0], 0, [], 0
    while at + limit < len(text):
        gap = _GAP.search(text, at + limit)
        if not gap or gap.end() == len(text):
            break
        at = gap.end()
        cuts.append(at)
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        end = b
        if b < len(text):
            more = _AHEAD(overlap).match(text, b)
            end = more.end() if more else len(text)
        out.append((words, text[a:end]))
        words += len(text[a:b].split())
    return out


_GAP = re.compile(rb"[\x20\x09-\x0D]+")


@lru_cache(maxsize=8)
def _AHEAD(words: int) -> re.Pattern[bytes]:
    return re.compile(rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % words)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
