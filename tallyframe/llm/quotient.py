"""Counting quotient filters: compact, lossless counters of integers of up to 128 bits, built and merged in sorted order.

A key is a pair of halves of equal width. A Feistel network permutes it, so that keys spread evenly whatever they are, and
can be restored. Its leading bits name the block, the next ones (the quotient) the slot, and all others (the remainder)
are stored in full: two keys never share a counter. In a block, one bit per quotient says whether it occurs, one bit per
entry whether it ends the run of its quotient; remainders take whole bytes; a counter takes one byte, and eight more
from 255 on.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

ROUNDS = 4
_HEADER = struct.Struct("<BBBQQ")
_WIDE = 255


class Counted(NamedTuple):
    """Permuted keys in ascending order, each once, and their counts."""

    high: np.ndarray
    low: np.ndarray
    count: np.ndarray


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scramble(half: np.ndarray, round_number: int, bits: int) -> np.ndarray:
    """A value of ``bits`` bits that depends on all bits of ``half``; multiplications wrap at 64 bits."""
    mixed = (half + np.uint64(round_number + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) & _mask(bits)


def permute(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of the pairs of ``bits``-bit halves."""
    for number in range(ROUNDS):
        high, low = low, high ^ _scramble(low, number, bits)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``permute`` was given."""
    for number in reversed(range(ROUNDS)):
        high, low = low ^ _scramble(high, number, bits), high
    return high, low


def count(high: np.ndarray, low: np.ndarray, bits: int, weights: np.ndarray | None = None) -> Counted:
    """Sort permuted keys and add up the weights (1 each without) of equal ones."""
    if 2 * bits <= 64:
        joined = (high << np.uint64(bits)) | low
        order = None if weights is None else np.argsort(joined, kind="stable")
        joined = np.sort(joined) if order is None else joined[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(joined), 1), bool), joined[1:] != joined[:-1]]))
        high, low = joined[first] >> np.uint64(bits), joined[first] & _mask(bits)
        total = len(joined)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        changed = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(np.concatenate([np.ones(min(len(high), 1), bool), changed]))
        total = len(high)
        high, low = high[first], low[first]
    if weights is None:
        counts = np.diff(np.append(first, total)).astype(np.uint64)
    else:
        counts = np.add.reduceat(weights[order], first) if total else weights[:0]
    return Counted(high, low, counts)


def merge(parts: list[Counted], bits: int) -> Counted:
    """One sorted sequence of all keys, with their counts added up."""
    if len(parts) == 1:
        return parts[0]
    return count(*[np.concatenate(columns) for columns in list(zip(*parts))[:2]], bits, np.concatenate([p.count for p in parts]))


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()


def _values_of(data: bytes, at: int, entries: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    wide = np.zeros((entries, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, entries * width, at).reshape(entries, width)
    return wide.view("<u8").reshape(entries).astype(np.uint64), at + entries * width


def encode(keys: Counted, bits: int, block_bits: int, block: int) -> bytes:
    """The filter of ``keys``, whose leading ``block_bits`` bits all are ``block``."""
    entries = len(keys.high)
    quotient_bits = min(bits - block_bits, max(entries - 1, 0).bit_length())
    rest = bits - block_bits - quotient_bits
    quotient = (keys.high >> np.uint64(rest)) & _mask(quotient_bits)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if entries else np.zeros(0, bool)
    wide = keys.count >= _WIDE
    return b"".join(
        [
            _HEADER.pack(bits, block_bits, quotient_bits, block, entries),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            _bytes_of(keys.high & _mask(rest), rest),
            _bytes_of(keys.low, bits),
            np.where(wide, _WIDE, keys.count).astype(np.uint8).tobytes(),
            keys.count[wide].astype("<u8").tobytes(),
        ]
    )


def decode(data: bytes) -> tuple[Counted, int]:
    """The keys of a filter with their counts, and the width of a half."""
    bits, block_bits, quotient_bits, block, entries = _HEADER.unpack_from(data)
    at = _HEADER.size
    rest = bits - block_bits - quotient_bits
    slots = 1 << quotient_bits
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, (slots + 7) // 8, at), count=slots)
    at += (slots + 7) // 8
    ends = np.unpackbits(np.frombuffer(data, np.uint8, (entries + 7) // 8, at), count=entries)
    at += (entries + 7) // 8
    run = np.cumsum(ends, dtype=np.int64) - ends
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    remainder, at = _values_of(data, at, entries, rest)
    low, at = _values_of(data, at, entries, bits)
    counts = np.frombuffer(data, np.uint8, entries, at).astype(np.uint64)
    wide = counts == _WIDE
    counts[wide] = np.frombuffer(data, "<u8", int(wide.sum()), at + entries)
    lead = np.uint64(block << (bits - block_bits))
    return Counted(lead | (quotient << np.uint64(rest)) | remainder, low, counts), bits


def split(keys: Counted, bits: int, block_bits: int) -> list[tuple[int, bytes]]:
    """The filters of the blocks that hold ``keys``."""
    blocks = (keys.high >> np.uint64(bits - block_bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
    ends = [*starts[1:], len(blocks)]
    return [
        (int(blocks[start]), encode(Counted(*[column[start:end] for column in keys]), bits, block_bits, int(blocks[start])))
        for start, end in zip(starts, ends)
    ]
