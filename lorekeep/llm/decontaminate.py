"""Benchmark decontamination by SimHash of item-sized windows.

For every item length the windows of that many words slide over each text. A window's
SimHash over word shingles is looked up in a multi-index: ``radius + 1`` blocks of the 64 bits, so every
item fingerprint within the radius agrees in some block. Fingerprints alone would miss some windows of the wanted
similarity s, so a window also meets every item that has one of its rarest shingles: of n shingles at least 2 s n / (1 + s)
must be shared, so one of any n minus that plus 1 is. Candidates are verified by the exact
weighted similarity of their shingles: the sum of the smaller over the sum of the larger counts.

A window with fewer than 2 s n / (1 + s) shingles of items of its length is not similar to any of them; such windows are
skipped before fingerprints are made, which loses nothing. Texts are read where they are: items come in blocks of
bounded size, each block is one pass over the texts.

Words are ASCII-lower-cased runs between white space. Items of fewer words than a shingle are one shingle; items
without words and null texts match nothing. A text of fewer words than an item is one window for it. Repeated items and
texts match each; items with a null id share the item_id null.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import WordRows, append_columns, written

FOUND = "array<struct<item_id:bigint,similarity:double,first_word:int,last_word:int>>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 1 << 20


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, from the words' hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ hashes[k : k + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(sums: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Items:
    """The index of one block of items: by length, shingle set, blocks of fingerprints, counts."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int, similarity: float):
        self.shingle, self.radius, self.similarity = shingle, radius, similarity
        edges = np.linspace(0, 64, radius + 2).round().astype(int)
        self.blocks = [(int(a), (1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.lengths: dict[int, dict] = {}
        by_length = defaultdict(list)
        for number, text in items:
            words = _words(text)
            if words:
                by_length[len(words)].append((number, shingles(word_hashes(words), min(shingle, len(words)))))
        every = defaultdict(list)
        for length, own in by_length.items():
            size = min(shingle, length)
            prints = np.concatenate([_prints(_bits(h).sum(axis=0, dtype=np.int64)[None], len(h)) for _, h in own])
            blocks = []
            for first, mask in self.blocks:
                value = (prints >> np.uint64(first)) & np.uint64(mask)
                order = np.argsort(value, kind="stable")
                blocks.append((value[order], order))
            # the items of each shingle: number k of `known` has holders[begins[k] : begins[k + 1]]
            held = np.unique(np.concatenate([np.stack((np.unique(h), np.full(len(np.unique(h)), k, np.uint64))) for k, (_, h) in enumerate(own)], axis=1), axis=1)
            known, begins = np.unique(held[0], return_index=True)
            self.lengths[length] = {
                "holders": held[1].astype(np.int64), "begins": np.append(begins, held.shape[1]),
                "ids": [i for i, _ in own], "counts": [Counter(h.tolist()) for _, h in own], "prints": prints,
                "blocks": blocks, "known": known, "size": size,
            }
            every[size].append(self.lengths[length]["known"])
        self.sizes = {}
        for size, known in every.items():
            known = np.unique(np.concatenate(known))
            table = np.zeros(_TABLE, bool)
            table[(known >> np.uint64(20)) % np.uint64(_TABLE)] = True
            lengths = sorted(n for n, x in self.lengths.items() if x["size"] == size)
            self.sizes[size] = (known, table, lengths)

    def search(self, hashes: np.ndarray) -> list[dict]:
        """The best window of every item that the text, given as word hashes, contains."""
        best: dict[int, tuple] = {}
        for size, (known, table, lengths) in self.sizes.items():
            own = shingles(hashes, size)
            at = np.flatnonzero(table[(own >> np.uint64(20)) % np.uint64(_TABLE)])
            if len(at):
                place = np.minimum(np.searchsorted(known, own[at]), len(known) - 1)
                at = at[known[place] == own[at]]
            if not len(at):
                continue
            for length in lengths:
                if length > len(hashes):
                    self._whole(length, own, len(hashes), best)
                else:
                    self._windows(length, own, at, best)
        found = sorted(best.items(), key=lambda x: (x[0] is not None, x[0] or 0))
        return [{"item_id": i, "similarity": s, "first_word": a, "last_word": b} for i, (s, a, b) in found]

    def _whole(self, length: int, own: np.ndarray, words: int, best: dict) -> None:
        """A text shorter than the items of this length is one window."""
        group = self.lengths[length]
        n = length - group["size"] + 1
        shared = ceil(self.similarity * n - 1e-9)  # even if the item holds all of the text
        if len(own) < shared:
            return
        known, begins = group["known"], group["begins"]
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        width = np.where(known[place] == own, begins[place + 1] - begins[place], 0)
        rare = np.argsort(width, kind="stable")[: len(own) - shared + 1]
        window = Counter(own.tolist())
        for item in sorted({int(i) for k in rare if width[k] for i in group["holders"][begins[place[k]] : begins[place[k] + 1]]}):
            both = sum((window & group["counts"][item]).values())
            similarity, number = both / (len(own) + n - both), group["ids"][item]
            if similarity >= self.similarity and (number not in best or similarity > best[number][0]):
                best[number] = (similarity, 0, words - 1)

    def _windows(self, length: int, own: np.ndarray, at: np.ndarray, best: dict) -> None:
        group = self.lengths[length]
        n = length - group["size"] + 1  # shingles in a window
        place = np.minimum(np.searchsorted(group["known"], own[at]), len(group["known"]) - 1)
        at = at[group["known"][place] == own[at]]
        last = len(own) - n  # last window
        if not len(at) or last < 0:
            return
        # the windows with enough hits: runs of starts
        hits = np.zeros(len(own) + 1, np.int64)
        hits[at + 1] = 1
        hits = np.cumsum(hits)
        starts = np.flatnonzero(hits[n:] - hits[:-n] >= self._shared(n))
        turn = np.flatnonzero(np.diff(starts) > 1) + 1
        for run in np.split(starts, turn) if len(starts) else []:
            for s in range(int(run[0]), int(run[-1]) + 1, 4096):
                self._judge(group, length, n, own, s, min(int(run[-1]) + 1, s + 4096), best)

    def _shared(self, n: int) -> int:
        """The least number of shingles that windows of ``n`` share at the wanted similarity."""
        return max(1, ceil(2 * n * self.similarity / (1 + self.similarity) - 1e-9))

    def _holders(self, group: dict, window: np.ndarray) -> set[int]:
        """The items that have one of so many of the window's rarest shingles that none similar enough is left out."""
        known, begins = group["known"], group["begins"]
        place = np.minimum(np.searchsorted(known, window), len(known) - 1)
        width = np.where(known[place] == window, begins[place + 1] - begins[place], 0)
        rare = np.argsort(width, kind="stable")[: len(window) - self._shared(len(window)) + 1]
        return {int(i) for k in rare if width[k] for i in group["holders"][begins[place[k]] : begins[place[k] + 1]]}

    def _judge(self, group, length, n, own, first, end, best) -> None:
        if end <= first:
            return
        part = own[first : end + n - 1]
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(_bits(part), axis=0, out=sums[1:])
        prints = _prints(sums[n:] - sums[:-n], n)
        seen = set()
        for (shift, mask), (values, order) in zip(self.blocks, group["blocks"], strict=True):
            value = (prints >> np.uint64(shift)) & np.uint64(mask)
            a, b = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            width = b - a
            w = np.repeat(np.arange(len(prints)), width)
            if not len(w):
                continue
            k = np.arange(len(w)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(a, width)
            item = order[k]
            near = np.bitwise_count(prints[w] ^ group["prints"][item]) <= self.radius
            seen.update(zip(w[near].tolist(), item[near].tolist(), strict=True))
        for w in range(len(prints)):
            seen.update((w, item) for item in self._holders(group, part[w : w + n]))
        for w, item in sorted(seen):
            start = first + w
            window, wanted = Counter(own[start : start + n].tolist()), group["counts"][item]
            both = sum((window & wanted).values())
            similarity = both / (2 * n - both)
            number = group["ids"][item]
            if similarity >= self.similarity and (number not in best or similarity > best[number][0]):
                best[number] = (similarity, start, start + length - 1)


def matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 15,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """``docs`` with matches: item_id, similarity, first_word, last_word of each item's best window.

    Ties go to the first window. ``radius`` is the guarantee of the multi-index; it changes the cost, never the matches. Items are taken in blocks of about
    ``block_chars`` characters; every text meets every block, and what one block found is written before the next,
    so that a task holds one block.
    """
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.make_valid_utf8(F.col(item_text)).alias("t"))
    chosen = chosen.where(F.col("t").isNotNull())
    total = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = docs.withColumn("matches", F.array().cast(FOUND))
    for number in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number) if blocks > 1 else chosen
        rows = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))  # one block
        shared = docs.sparkSession.sparkContext.broadcast((rows, shingle, radius, similarity))

        def make(shared=shared):
            index = Items(*shared.value)
            words = WordRows(word_hashes)

            def find(value):
                own = _words(value)
                if not own or not index.lengths:
                    return []
                words.settle()
                ids = words.ids(own)
                return index.search(words.table()[ids])

            return lambda values: [[find(v) for v in values]]

        out = append_columns(out, text, make, f"__more {FOUND}")
        out = out.withColumn("matches", F.concat("matches", "__more")).drop("__more")
        if number < blocks - 1:
            out = written(out)
    return out
