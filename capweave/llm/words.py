"""Words of Arrow text columns as 64-bit hashes, computed by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once, so that temporary arrays stay in the processor's cache.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


def spaces() -> np.ndarray:
    """Of every byte, whether it belongs to a word of [^\\x20\\x09-\\x0D]+."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def plain() -> np.ndarray:
    """The same for the words of PLAIN_WORD in lower-cased text."""
    word = np.zeros(256, bool)
    word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return word


def lowered() -> np.ndarray:
    low = np.arange(256)
    low[0x41:0x5B] += 32
    return low


#: Seeds of two hashes that have nothing in common.
SEEDS = ((1, 2), (11, 12))
_AT = [randoms(1 << 12, a) for a, _ in SEEDS]
_BYTE = [randoms(256, b) for _, b in SEEDS]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


class Words:
    """hash, start and end (byte positions) of every word; first: of every row, its first word's index (n + 1). twice: other, too, a second hash."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool, word: np.ndarray | None = None, twice: bool = False):
        word, value = spaces() if word is None else word, [x[lowered()] if lower else x for x in _BYTE[: 1 + twice]]
        parts, begins = [], offs[:-1]
        at = 0
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            while end < len(raw):  # on to the next separator
                gap = np.flatnonzero(~word[raw[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(raw))
            parts.append(self._block(raw, at, end, begins, word, value))
            at = end
        hashes, starts, ends = zip(*parts) if parts else ((), (), ())
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.start, self.end = whole(starts, np.int64), whole(ends, np.int64)
        self.hash, *other = (whole(x, U) for x in zip(*hashes)) if hashes else [np.zeros(0, U)] * (1 + twice)
        self.other = other[0] if other else None
        self.first = np.searchsorted(self.start, offs)

    @staticmethod
    def _block(raw, at, end, begins, word, value):
        x = raw[at:end]
        w = word[x]
        cut = np.zeros(len(x) + 1, bool)  # rows begin here
        cut[0] = cut[-1] = True
        cut[begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at] = True
        start = np.flatnonzero(w & (cut[:-1] | ~np.concatenate(([False], w[:-1]))))
        stop = np.flatnonzero(w & (cut[1:] | ~np.concatenate((w[1:], [False])))) + 1
        if not len(start):
            return [np.zeros(0, U)] * len(value), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = stop - start
        inside = np.flatnonzero(w)
        before = np.concatenate(([0], np.cumsum(size)[:-1]))
        pos = np.arange(len(inside)) - np.repeat(before, size)
        most = int(size.max())
        of, out = x[inside], []
        for own, places, (seed, _) in zip(value, _AT, SEEDS):
            places = places if most <= len(places) else randoms(most, seed)
            out.append(mix(np.add.reduceat(places[pos] * own[of], before) + size.astype(U)))
        return out, start + at, stop + at


def row_groups(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes, one row at least."""
    raw, offs = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def windows(h: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """A hash of every n consecutive words, whatever row they are in."""
    if len(h) < n:
        return np.zeros(0, U)
    c, out = randoms(n, seed) | U(1), np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out += mix(h[k : len(h) - n + 1 + k] * c[k]) if n < 8 else h[k : len(h) - n + 1 + k] * c[k]
    return mix(out + U(n))
