"""Hamming comparison of many fingerprints at once, by bit planes.

Bit ``b`` of 64 fingerprints is one word of plane ``b``. A query's bit turns the word into 64
difference bits, which carry-save counters (one word per counter bit) add up for 64 targets at a
time. A block of 64 targets is abandoned as soon as all of them exceed the radius.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words) uint64: plane b, word w holds bit b of prints 64w..64w+63."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (n, 64)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view(np.uint64)


def _over(counter: list[np.ndarray], spill: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the targets whose count is greater than ``radius``."""
    more, equal = np.zeros_like(spill), np.full_like(spill, ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            more |= equal & counter[k]
            equal = equal & ~counter[k]
    return more | spill


def close_pairs(queries: np.ndarray, targets: np.ndarray, radius: int, same: bool, block: int = 1 << 18):
    """Yield (query numbers, target numbers) at most ``radius`` bits apart, in bounded pieces.

    ``same``: both are one array; each pair then comes once, the smaller number first.
    """
    planes = planes_of(targets)
    words = planes.shape[1]
    spread = np.flatnonzero([np.ptp(x) > 0 for x in ((np.concatenate((queries, targets)) >> np.uint64(b)) & np.uint64(1) for b in range(64))])
    valid = np.full(words, ALL)
    if len(targets) % 64:
        valid[-1] = (np.uint64(1) << np.uint64(len(targets) % 64)) - np.uint64(1)
    size = max(1, radius.bit_length())
    step = max(1, block // words)
    for start in range(0, len(queries), step):
        own = queries[start : start + step]
        q, w = np.divmod(np.arange(len(own) * words), words)
        if same:
            keep = w >= (q + start) // 64
            q, w = q[keep], w[keep]
        counter = [np.zeros(len(q), np.uint64) for _ in range(size)]
        spill = ~valid[w]
        for number, b in enumerate(spread, 1):
            turned = np.where(own >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
            carry = planes[b, w] ^ turned[q]
            for k in range(size):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            spill = spill | carry
            if number % 6 == 0:
                alive = _over(counter, spill, radius) != ALL
                if not alive.all():
                    q, w, spill = q[alive], w[alive], spill[alive]
                    counter = [c[alive] for c in counter]
                    if not len(q):
                        break
        if not len(q):
            continue
        found = ~_over(counter, spill, radius)
        hit = found != 0
        q, w, found = q[hit], w[hit], found[hit]
        for at in range(0, len(q), block // 16):  # 64 bits per word: at most 4 x block pairs at a time
            part = slice(at, at + block // 16)
            row, bit = np.nonzero(np.unpackbits(found[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[part][row] + start, w[part][row] * 64 + bit
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j


def spanning(n: int, pieces) -> np.ndarray:
    """The smallest number reachable from each of ``n`` nodes over the pairs in ``pieces``."""
    label = np.arange(n)
    for i, j in pieces:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label
