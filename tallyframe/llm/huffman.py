"""Canonical length-limited Huffman codes for arrays of ids: lengths, packing into bits, and table-driven decoding."""

from __future__ import annotations

import numpy as np

MAX_LENGTH = 20
# A bit offset is kept every so many ids; decoding runs over all these runs at once.
CHECKPOINT_IDS = 128


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits; 0 for ids that do not occur.

    Package-merge: each round pairs the cheapest packages with the symbols of the next shorter length. How many symbols
    lie among the items that are taken follows backwards from the last round.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    rounds = []
    packages = np.empty(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([weights, packages])
        place = np.argsort(items, kind="stable")
        rounds.append(np.cumsum(place < len(weights)))
        items = items[place]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * len(order) - 2
    for symbols in reversed(rounds):
        if taken <= 0:
            break
        first = int(symbols[taken - 1])
        lengths[order[:first]] += 1
        taken = 2 * (taken - first)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    if len(order):
        size = lengths[order].astype(np.int64)
        longest = int(size[-1])
        # Each code, filled up to the longest length, starts where the one before it ends.
        ends = np.cumsum(np.left_shift(np.uint64(1), (longest - size).astype(np.uint64)))
        starts = np.concatenate([np.zeros(1, np.uint64), ends[:-1]])
        out[order] = np.right_shift(starts, (longest - size).astype(np.uint64))
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, coded: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, most significant first, and the bit offset of every ``CHECKPOINT_IDS``-th id."""
    if not len(ids):
        return b"", np.empty(0, np.uint64)
    size = lengths[ids].astype(np.uint64)
    if not size.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    starts = ends - size
    word = (starts >> np.uint64(5)).astype(np.int64)
    value = coded[ids] << (np.uint64(64) - (starts & np.uint64(31)) - size)
    # Codes are shorter than a word, so every word but perhaps the last has a first code.
    firsts = np.searchsorted(word, np.arange(word[-1] + 1))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[:-1] = np.bitwise_or.reduceat(value >> np.uint64(32), firsts)
    words[1:] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), firsts)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::CHECKPOINT_IDS]


class Decoder:
    """Looks up ``longest`` bits at a time in a table of ids and lengths."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.longest = int(lengths.max()) if len(used) else 1
        coded = codes(lengths)
        order = used[np.argsort(coded[used] << (self.longest - lengths[used]).astype(np.uint64), kind="stable")]
        spans = 1 << (self.longest - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.longest, np.uint32)
        self.lengths = np.ones(1 << self.longest, np.uint8)
        filled = int(spans.sum())
        self.ids[:filled] = np.repeat(order, spans)
        self.lengths[:filled] = np.repeat(lengths[order], spans)

    def unpack(self, bits: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` ids of a block, all runs between checkpoints side by side."""
        if not count:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(bits + bytes(CHECKPOINT_IDS * MAX_LENGTH // 8 + 8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((CHECKPOINT_IDS, len(at)), np.uint32)
        shift, mask = 32 - self.longest, (1 << self.longest) - 1
        for step in range(CHECKPOINT_IDS):
            seen = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[step] = self.ids[seen]
            at += self.lengths[seen]
        return out.T.reshape(-1)[:count]
