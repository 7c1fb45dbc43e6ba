"""Decompression of raster blocks, by whole arrays instead of code by code."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

# Fixed values of the format: compression numbers, LZW's first free code, its two signs, and the widest code.
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD, ZSTD = 1, 5, 8, 32773, 32946, 50000
CLEAR, END, FREE, WIDEST = 256, 257, 258, 12
#: Codes read ahead after a clearing code: the table is full well before.
AHEAD = 4096


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clearing one: the width grows one code before the table needs it."""
    return np.clip(np.ceil(np.log2(FREE + np.arange(n) + 1)).astype(np.int64), 9, WIDEST)


_STARTS = np.concatenate([[0], np.cumsum(_widths(AHEAD))])


def _codes(data: np.ndarray, bit: int) -> np.ndarray:
    """Codes from a bit on, with the widths that they have after a clearing code; data ends in spare bytes."""
    width = np.diff(_STARTS)
    at = bit + _STARTS[:-1]
    at = at[at + width <= 8 * (len(data) - 4)]
    byte = at >> 3
    word = (data[byte].astype(np.int64) << 24) | (data[byte + 1].astype(np.int64) << 16) | (data[byte + 2].astype(np.int64) << 8) | data[byte + 3]
    return (word >> (32 - (at & 7) - width[: len(at)])) & ((1 << width[: len(at)]) - 1)


def _expand(codes: np.ndarray) -> np.ndarray:
    """Bytes of the codes between two clearing ones.

    The entry that code k makes is the bytes of code k and the one after them, so every code is a literal or a stretch of the output that begins where an earlier code's does. Lengths, and then every byte's
    place of origin, follow by doubling: each round halves the steps that are left.
    """
    parent = codes - FREE  # the code whose entry this is; below 0 a literal
    length, up = np.ones(len(codes), np.int64), parent.copy()
    while (open_ := np.flatnonzero(up >= 0)).size:
        to = up[open_]
        length[open_] += length[to]
        up[open_] = up[to]
    stops = np.cumsum(length)
    starts = stops - length
    origin = np.arange(stops[-1] if len(stops) else 0)
    copied = parent >= 0
    shift = np.repeat(np.where(copied, starts - starts[np.where(copied, parent, 0)], 0), length)
    origin -= shift
    open_ = np.flatnonzero(shift)
    while open_.size:
        further = origin[origin[open_]]
        moved = further != origin[open_]
        origin[open_] = further
        open_ = open_[moved]
    literals = np.zeros(len(origin), np.uint8)
    literals[starts[~copied]] = codes[~copied]
    return literals[origin]


def unlzw(data: bytes) -> bytes:
    """Decompress a block of the format's LZW: codes of 9 to 12 bits, highest bit first, that grow one code early; 256 clears the table, 257 ends."""
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    bit, out = 0, []
    while True:
        codes = _codes(padded, bit)
        signs = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(signs[0]) if len(signs) else len(codes)
        own = codes[:n]
        if n:
            if (own >= FREE + np.arange(n)).any():
                raise ValueError("Damaged LZW block.")
            out.append(_expand(own))
        if not len(signs) or codes[n] == END:
            return b"".join(o.tobytes() for o in out)
        bit += int(_STARTS[n + 1])


def unpackbits(data: bytes) -> bytes:
    """Decompress runs: a byte under 128 is followed by so many literals and one, one over 128 by a byte that stands 257 less so many times; 128 is nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def decompress(data: bytes, compression: int, size: int) -> bytes:
    """A block of a known size in bytes."""
    if compression == LZW:
        return unlzw(data)
    if compression == PACKBITS:
        return unpackbits(data)
    if compression == ZSTD:
        return pa.decompress(data, size, codec="zstd", asbytes=True)
    return data if compression == NONE else zlib.decompress(data)


KNOWN = (NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD, ZSTD)
