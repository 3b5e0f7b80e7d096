"""Golomb-Rice coding of sorted 64-bit numbers, in numpy.

A blob is three streams, one after the other from a whole byte on: the unary quotients of all gaps, each ended by a
zero bit; the remainders, `bits` bits each, of all gaps but the far ones; the far gaps whole, in 64 bits. So decoding
needs no step per number.
"""

from __future__ import annotations

import numpy as np

#: A quotient this large is written as an escape with the whole gap; a unary run never gets longer.
ESCAPE = 40


def rice_bits(count: int, span: int) -> int:
    """The remainder bits that suit `count` numbers spread evenly over `span`."""
    gap = max(1, span // max(1, count))
    return max(0, min(56, gap.bit_length() - 1))


def encode(values: np.ndarray, bits: int) -> bytes:
    """Codes ascending uint64 values: per gap a unary quotient, a stop bit and `bits` remainder bits."""
    if len(values) == 0:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = gaps >> np.uint64(bits)
    far = quotient >= ESCAPE
    stops = np.cumsum(np.where(far, ESCAPE, quotient).astype(np.int64) + 1) - 1
    unary = np.ones(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 0
    near = gaps[~far]
    rest = np.empty((len(near), bits), dtype=np.uint8)
    for k in range(bits):
        rest[:, k] = ((near >> np.uint64(bits - 1 - k)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes() + gaps[far].astype("<u8").tobytes()


def decode(blob: bytes, count: int, bits: int) -> np.ndarray:
    """The `count` values that encode() coded with `bits`."""
    if count == 0:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(blob, dtype=np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[: (count * (ESCAPE + 1) + 7) // 8]) == 0)[:count]
    unary = np.diff(stops, prepend=-1) - 1
    far = unary == ESCAPE
    near = count - int(far.sum())
    begin = (int(stops[-1]) + 8) // 8
    end = begin + (near * bits + 7) // 8
    rest = np.unpackbits(raw[begin:end], count=near * bits).reshape(near, bits)
    low = np.zeros(near, dtype=np.uint64)
    for k in range(bits):
        low = (low << np.uint64(1)) | rest[:, k]
    gaps = np.empty(count, dtype=np.uint64)
    gaps[~far] = (unary[~far].astype(np.uint64) << np.uint64(bits)) | low
    gaps[far] = np.frombuffer(blob[end:], dtype="<u8", count=count - near)
    return np.cumsum(gaps, dtype=np.uint64)
