"""Canonical Huffman codes of limited length: construction, encoding, table-driven decoding.

Numpy functions on arrays; nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np

#: Longest code: four codes fit a word, and a decoding table has two to this power entries.
LIMIT = 16
#: Symbols between two bit-offset checkpoints of a block.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each symbol among codes of at most ``limit`` bits; 0 where the count is 0.

    Package-merge: ``limit`` times, pairs of the cheapest packages join the single symbols; a
    symbol's length is the number of chosen packages that hold it.
    """
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols do not fit codes of {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    single = counts[symbols].astype(np.float64)
    # levels[i]: for each package in ascending order of weight, whether it is a single symbol.
    levels, weight = [], single
    is_single = np.ones(len(single), bool)
    for _ in range(limit - 1):
        levels.append(is_single)
        paired = weight[0 : len(weight) // 2 * 2 : 2] + weight[1::2]
        merged = np.concatenate([single, paired])
        order = np.argsort(merged, kind="stable")
        weight, is_single = merged[order], order < len(single)
    levels.append(is_single)
    # Of the last level the 2n - 2 cheapest; a chosen pair chooses its two packages one level down.
    wanted = 2 * len(single) - 2
    bits = np.zeros(len(single), np.int64)
    for level in reversed(levels):
        chosen = int(level[:wanted].sum())  # single symbols are in ascending order, so these are the first
        bits[:chosen] += 1
        wanted = 2 * (wanted - chosen)
    lengths[symbols] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: codes ascend by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 0
    # In units of the longest code, each code starts where the one before ends.
    begins = np.r_[0, np.cumsum(1 << (top - size))][: len(size)]
    codes[order] = begins >> (top - size)
    return codes


def encode(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The bit stream, its number of bits, and the bit offset of every ``STRIDE``-th symbol."""
    size = lengths[symbols]
    if len(symbols) and not size.all():
        raise ValueError("a symbol without a code")
    checkpoints = np.r_[0, np.cumsum(np.add.reduceat(size, np.arange(0, len(size), STRIDE), dtype=np.int64))[:-1]] if len(size) else np.empty(0, np.int64)
    # Four neighbours become one code of at most 64 bits; what is missing at the end has no bits.
    spare = -len(symbols) % 4
    code = np.pad(codes[symbols].astype(np.uint64), (0, spare))
    size = np.pad(size.astype(np.uint64), (0, spare))
    for _ in range(2):
        code = code[0::2] << size[1::2] | code[1::2]
        size = size[0::2] + size[1::2]
    ends = np.cumsum(size.astype(np.int64))
    begins = ends - size.astype(np.int64)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    at, shift = begins >> 6, (begins & 63).astype(np.uint64)
    # Left-aligned, then split at the word's end; a shift by 64 would keep the code, so it is two shifts.
    left = code << (np.uint64(63) - np.maximum(size, np.uint64(1)) + np.uint64(1))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    if len(at):
        words[at[first]] = np.bitwise_or.reduceat(left >> shift, first)
        over = left << (np.uint64(63) - shift) << np.uint64(1)
        words[at[np.r_[first[1:] - 1, len(at) - 1]] + 1] |= over[np.r_[first[1:] - 1, len(at) - 1]]
    return words.astype(">u8").tobytes()[: (total + 7) // 8], total, checkpoints


class Decoder:
    """Decodes by one table look-up for each symbol, in all runs between checkpoints at once."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.bits = int(lengths.max()) if len(used) else 1
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        size = int(spans.sum())
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.zeros(1 << self.bits, np.uint8)
        self.symbol[:size], self.length[:size] = np.repeat(order, spans), np.repeat(lengths[order], spans)

    def decode(self, stream: bytes, count: int, checkpoints: np.ndarray) -> np.ndarray:
        """``count`` symbols of one block."""
        found = np.empty(len(checkpoints) * STRIDE, np.uint32)
        if not count:
            return found[:0]
        data = np.frombuffer(stream + bytes(12), np.uint8)
        # Byte b starts a window of eight bytes; any code within its first 32 bits can be cut out of it.
        windows = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        at = np.asarray(checkpoints, np.int64).copy()
        last = len(windows) - 1
        down = np.uint64(64 - self.bits)
        for k in range(STRIDE):
            view = windows[np.minimum(at >> 3, last)].astype(np.uint64) << (at & 7).astype(np.uint64)
            entry = (view >> down).astype(np.int64)
            found[k::STRIDE] = self.symbol[entry]
            at += self.length[entry]
        return found[:count]
