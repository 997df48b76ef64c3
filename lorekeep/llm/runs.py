"""Periodic runs of words: dyadic blocks, range successors in a wavelet tree over the suffix array, verified by extension.

A run is a stretch of words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring
word extends. If it is long enough, one of the blocks of 2^k words that begin at a multiple of 2^k lies in it
together with its copy q words further on, where 2^(k+1) - 1 <= q <= 2^(k+2) - 2. So every block asks for its
own occurrences in that window behind it: the occurrences of a block are an interval of the suffix array, and
the next one from a position on is a range successor, answered by a wavelet tree over the array. Occurrences
that overlap by half a block or more form an arithmetic progression whose step is the block's period; a
progression is found from its first two members and one extension, and its distances are candidate periods as
a whole. Every candidate is extended to both sides by the ranks of the doubling steps that built the suffix
array, which also proves it. Of candidates with the same ends the smallest period is the run's.

Texts are handled in Arrow batches, several short ones side by side with a separator of their own each, so that
all steps are array operations. Nothing is shuffled. Memory is bounded by the longest text, or ``gather`` words
if that is more: about 100 bytes a word, and 8 bytes more for every doubling that still finds repeats.

Defined cases: null and empty texts have no words and no runs; repeated rows are judged alike, ties do not
occur, since a run is named by its start and end. Empty tables give empty results, columns of the input that
are named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LEAST = 12
_TEXT = "__text"
FIELDS = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Suffixes:
    """Suffix array of a sequence of numbers, with the rank of every stretch of 2^k of them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        starts = np.cumsum(counts) - counts
        # the rank is the place of the first suffix of its class, so a class is an interval of the array
        rank, size = starts[inverse], counts[inverse]
        order = np.argsort(rank, kind="stable")
        self.ranks, self.sizes = [rank.astype(np.int32)], [size.astype(np.int32)]
        step = 1
        while True:
            open_ = order[self.sizes[-1][order] > 1]
            if not len(open_):
                break
            rank = self.ranks[-1]
            own = rank[open_]
            after = open_ + step
            behind = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            by = np.lexsort((behind, own))
            open_, own, behind = open_[by], own[by], behind[by]
            new = np.ones(len(open_), bool)
            new[1:] = (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])
            group = np.cumsum(new) - 1
            # places in the array: each class fills its own interval from its first place on
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            within = np.arange(len(open_)) - np.repeat(heads, np.diff(np.append(heads, len(open_))))
            place = own + within
            order[place] = open_
            rank, size = rank.copy(), self.sizes[-1].copy()
            rank[open_] = place[new][group]
            size[open_] = np.bincount(group)[group]
            self.ranks.append(rank)
            self.sizes.append(size)
            step *= 2
        self.array = order

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many equal values follow at i and j, or with ``back`` stand directly before them."""
        n, i, j = len(self.array), i.copy(), j.copy()
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            step, rank = 1 << k, self.ranks[k]
            if back:
                may = (i >= step) & (j >= step)
                a, b = np.where(may, i - step, 0), np.where(may, j - step, 0)
            else:
                may = (i < n) & (j < n)
                a, b = np.where(may, i, 0), np.where(may, j, 0)
            move = np.where(may & (rank[a] == rank[b]), step, 0)
            total += move
            i, j = (i - move, j - move) if back else (i + move, j + move)
        return total


class WaveletTree:
    """Positions as a wavelet tree, level by level in one matrix: counts and order statistics of any interval."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.before = [], []
        now = values
        for bit in range(self.depth - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            # zeros before every place
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(~ones, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            now = np.concatenate((now[~ones], now[ones]))

    def smaller(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Values below x among the places [low, high)."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, (zeros, before) in enumerate(zip(self.zeros, self.before, strict=True)):
            one = (x >> (self.depth - 1 - level) & 1).astype(bool)
            a, b = before[low].astype(np.int64), before[high].astype(np.int64)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank, from 0, among the places [low, high)."""
        low, high, rank, value = low.copy(), high.copy(), rank.copy(), np.zeros(len(low), np.int64)
        for level, (zeros, before) in enumerate(zip(self.zeros, self.before, strict=True)):
            a, b = before[low].astype(np.int64), before[high].astype(np.int64)
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value += np.where(one, 1 << (self.depth - 1 - level), 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x among the places [low, high); -1 if there is none."""
        top = 1 << self.depth
        rank = np.where(x < top, self.smaller(low, high, np.minimum(x, top - 1)), high - low)
        found = rank < high - low
        out = np.full(len(low), -1, np.int64)
        out[found] = self.nth(low[found], high[found], rank[found])
        return out


def _window(k: int) -> tuple[int, int]:
    """Distances that blocks of 2^k answer for. Runs of ``LEAST`` words let blocks of four find short periods too,
    all but 6, which blocks of two find."""
    return {1: (6, 6), 2: (1, 14)}.get(k, ((2 << k) - 1, (4 << k) - 2))


def _candidates(s: Suffixes, tree: WaveletTree, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, distance) arrays that hold every distance a block of 2^k recurs at in its window; of a progression
    that goes on from the block itself only the step."""
    size, (least, most) = 1 << k, _window(k)
    rank, many = s.ranks[k], s.sizes[k]
    block = np.arange(0, len(rank), size)
    block = block[many[block] > 1]
    x = block + least
    low = rank[block].astype(np.int64)
    high = low + many[block]
    y = tree.successor(low, high, x)
    while True:
        live = (y >= 0) & (y <= block + most)
        block, low, high, y = block[live], low[live], high[live], y[live]
        if not len(block):
            return
        then = tree.successor(low, high, y + 1)
        step = then - y
        dense = (then >= 0) & (2 * step <= size)
        yield block[~dense], (y - block)[~dense]
        if dense.any():
            b, a, d = block[dense], y[dense], step[dense]
            last = a + (d + s.extend(a, a + d) - size) // d * d
            # does the block's own stretch of period d reach the occurrence?
            same = b + d + s.extend(b, b + d) >= a + size
            yield b[same], d[same]
            b2, a2, d2 = b[~same], a[~same], d[~same]
            upto = np.minimum(last[~same], b2 + most)
            n = (upto - a2) // d2 + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(b2, n), np.repeat(a2 - b2, n) + at * np.repeat(d2, n)
            then[dense] = tree.successor(low[dense], high[dense], last + 1)
        y = then


def runs_of(values: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``values``, ordered; ``values`` ends with a value that occurs nowhere else."""
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not searched")
    s = Suffixes(values)
    tree, found = None, []
    for k in range(1, len(s.ranks)):
        if not (s.sizes[k][:: 1 << k] > 1).any():
            continue
        tree = tree or WaveletTree(s.array)
        for block, period in _candidates(s, tree, k):
            if not len(block):
                continue
            start = block - s.extend(block, block + period, back=True)
            end = block + period + s.extend(block, block + period)
            good = end - start >= np.maximum(least, 2 * period)
            found.append(np.unique(np.stack((start, end, period), axis=1)[good], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (tab to carriage return, space), as UTF-8."""
    return text.encode().split() if text else []


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words left when every run keeps its first period only, joined by a space."""
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words).decode()


def periodic_runs(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, gather: int = 1 << 16,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` without the text, with n_words, runs (ordered by start, then period) and collapsed: the text without
    the words that any run repeats, joined by one space.

    ``change(key, words)`` may change the words of a text first. ``gather`` is the number of words handled at once.
    """
    made = T.StructType.fromDDL(FIELDS)
    kept = [c for c in docs.columns if c != text and c.lower() not in made.names]
    base = docs.select(*kept, F.make_valid_utf8(F.col(text).cast("string")).alias(_TEXT))
    schema = T.StructType([*base.schema.fields[:-1], *made.fields])
    arrow, numbered = to_arrow_schema(made), kept.index(key) if change else None

    def settle(pending: list[list[bytes]]) -> Iterator[tuple]:
        ids: dict[bytes, int] = {}
        parts = []
        for n, own in enumerate(pending):
            parts += [np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int64, len(own)), np.array([-1 - n])]
        found = runs_of(np.concatenate(parts), least)
        starts = np.cumsum([0, *[len(own) + 1 for own in pending]])
        cuts = np.searchsorted(found[:, 0], starts)
        for n, own in enumerate(pending):
            runs = found[cuts[n] : cuts[n + 1]] - [starts[n], starts[n], 0]
            told = [{"start": a, "length": b - a, "period": q} for a, b, q in runs.tolist()]
            yield len(own), told, collapse(own, runs)

    def part(batch: pa.RecordBatch, upto: int, pending: list[list[bytes]]) -> pa.RecordBatch:
        columns = [pa.array(list(v), f.type) for v, f in zip(zip(*settle(pending), strict=True), arrow, strict=True)]
        own = batch.slice(upto - len(pending), len(pending))
        return pa.RecordBatch.from_arrays([*own.columns[:-1], *columns], schema.names)

    def run(batches):
        for batch in batches:
            pending, held = [], 0
            keys = batch.column(numbered).to_pylist() if change else None
            for at, value in enumerate(batch.column(len(kept))):
                own = words_of(value.as_py())
                own = change(keys[at], own) if change else own
                if pending and held + len(own) > gather:
                    yield part(batch, at, pending)
                    pending, held = [], 0
                pending.append(own)
                held += len(own) + 1
            if pending:
                yield part(batch, len(batch), pending)

    return base.mapInArrow(run, schema)
