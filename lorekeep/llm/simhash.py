"""SimHash near-duplicates: vertical bit planes, carry-save counters, abandoned blocks.

Fingerprints that differ in at most 2 of 64 bits agree in two of four 16-bit blocks. Distinct
fingerprints meet in the buckets of their six block pairs; a bucket that is too large is cut again by two of four
8-bit blocks of its other bits, so no bucket exceeds 2^16 distinct fingerprints whatever the corpus. A bucket is compared by
``bitslice`` and yields one edge per fingerprint to the smallest it reaches there, never all pairs. Exact
copies share a fingerprint and never meet as pairs.

Two bits of 64 are far closer than a word-shingle similarity of 0.8. ``near`` adds such links by an exact prefix
filter: with all shingles in one order, rare ones first, two sets of n and m shingles that are ``near`` similar share one
of their first n - ceil(near n) + 1 and m - ceil(near m) + 1. The order counts every text, so buckets do not grow with the corpus. Texts that share such a shingle form a bucket. They are first
compared with its head, which joins large groups at a cost of one pair per text; then with its likeliest partner; then all
pairs of the bucket that are still in different components are compared. Likely partners and last pairs are
found where the bucket lies, from counts of shingles by part of the hash range that bound what two texts share: pairs
that the counts rule out never become rows. The exact similarity of the shingle sets decides, no pair is missed. A bucket
of many texts that are all unlike each other costs comparisons by the square of its size, but no such rows.

Null and empty texts have fingerprint zero and link like any other. Repeated rows are copies. Rows with a null id
join the group of their fingerprint; a group without any id has a null component_id.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bitslice import close_pairs, spanning
from lorekeep.llm.common import WordRows, append_columns, checkpoint, parts_of, written
from lorekeep.operators.graph import connected_components

BLOCKS = list(combinations(range(4), 2))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between white space (tab to carriage return, space), as UTF-8."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by a space; of the whole if there are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends[min(size, len(words)) - 1 :], strict=False)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """64 bits as a signed integer: a bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with fp: the SimHash of the whole text as a long."""

    def make():
        return lambda values: [[simhash(shingle_hashes(words_of(v), shingle, seed)) for v in values]]

    return append_columns(docs, text, make, "fp long")


def common_shingles(docs: DataFrame, text: str, shingle: int, chars: int = 20_000_000, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in about ``chars`` characters of the texts, ascending, and how often.

    They give the prefix filter its order: any order finds the same links, this one keeps buckets small.
    """
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    every = max(1, -(-total // chars))
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(F.make_valid_utf8(text))

    def count(batches):
        runs = _runs(shingle)
        for b in batches:
            own = [runs(v.as_py()) for v in b.column(0)]
            values, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["p", "n"])

    found = chosen.mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).where("n > 1")
    rows = found.orderBy(F.col("n").desc(), "p").limit(most).toPandas()
    values = rows["p"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], rows["n"].to_numpy(np.int64)[order]


def often_shared(docs: DataFrame, text: str, shingle: int, chars: int = 20_000_000, bits: int = 27) -> list[np.ndarray]:
    """Two bit tables of the shingles (by slot) that occur a few and some more times in all texts.

    A sample finds only shingles that recur within it, so the larger the corpus, the commoner must they be. These tables
    count every text: what they tell apart grows only by the shingles that share a slot. A corpus of up to ``chars``
    characters is counted whole by ``common_shingles`` and has no tables.
    """
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    if total <= chars:
        return []
    chance = int(2 * (total / 6) / (1 << bits))  # twice what shares a slot, at six characters a word

    def runs_of():
        runs = _runs(shingle)

        def values(column):
            held, size = [], 0
            for v in column:
                held.append(runs(v.as_py()).view(np.int64))
                size += len(held[-1])
                if size > 500_000:
                    yield np.concatenate(held)
                    held, size = [], 0
            if size:
                yield np.concatenate(held)

        return values

    made = bitmap(docs.select(F.make_valid_utf8(text).alias("x")), "x", least=(4 + chance, 16 + chance), bits=bits, values_of=runs_of)
    return [Slots(pieces, bits).full for pieces in made]


def _runs(shingle: int):
    """A function from a text to its distinct shingle hashes."""
    from lorekeep.llm.decontaminate import shingles, word_hashes

    words = WordRows(word_hashes)

    def runs(value):
        own = words_of(value)
        if not own:
            return np.zeros(0, np.uint64)
        words.settle()
        ids = words.ids(own)
        return np.unique(shingles(words.table()[ids], min(shingle, len(own))))

    return runs


def prefix_of(own: np.ndarray, common: np.ndarray, often: np.ndarray, near: float, tables: list[np.ndarray] = ()) -> np.ndarray:
    """The first of the distinct shingles ``own``, rare ones first: sets of similarity ``near`` share one of them.

    Shingles that are not ``common`` go by the number of ``tables`` (see ``often_shared``) that have them.
    """
    if not len(own):
        return own
    n = np.zeros(len(own), np.int64)
    for full in tables:
        n += has_slot(full, own)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        n = np.where(common[at] == own, often[at] + len(tables), n)
    size = len(own) - ceil(near * len(own) - 1e-9) + 1
    return own[np.lexsort((own, n))[:size]]


def _buckets(rows: DataFrame) -> DataFrame:
    """p, h, n, i and the head's a, a_n, a_i: every text of a bucket but its head, which comes first by s."""

    def meet(batches):
        last, head = None, None
        for b in batches:
            p, _, h, n, i = (b.column(c).to_numpy() for c in range(5))
            if not len(p):
                continue
            start, again = np.ones(len(p), bool), np.zeros(len(p), bool)
            start[1:] = p[1:] != p[:-1]
            again[1:] = ~start[1:] & (h[1:] == h[:-1])
            if last is not None:
                start[0] = p[0] != last[0]
                again[0] = not start[0] and h[0] == last[1]
            # the head of the bucket that the last batch left open is row 0
            heads = [np.concatenate(([0 if head is None else head[k]], x)) for k, x in enumerate((h, n, i))]
            at = np.maximum.accumulate(np.where(start, np.arange(1, len(p) + 1), 0))
            keep = ~start & ~again
            columns = [p[keep], h[keep], n[keep], i[keep], *[x[at[keep]] for x in heads]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            names = ["p", "h", "n", "i", "a", "a_n", "a_i"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            last, head = (p[-1], h[-1]), tuple(x[at[-1]] for x in heads)

    dealt = rows.select("p", "s", "h", "n", "i").repartition(parts_of(rows), "p").sortWithinPartitions("p", "s", "h")
    return dealt.mapInArrow(meet, "p long, h long, n int, i int, a long, a_n int, a_i int")


def _may(near: float, n: str, i: str, m: str, j: str) -> Column:
    """Can sets of n and m shingles be ``near`` similar if places i and j hold the first one they share?"""
    n, i, m, j = (F.col(c) for c in (n, i, m, j))
    return F.least(n - i, m - j) >= (n + m) * F.lit(near / (1 + near)) - F.lit(1e-9)


def bitmap(values: DataFrame, column: str, *, least: tuple[int, ...] = (1,), bits: int = 27, values_of=None) -> list[dict[int, bytes]]:
    """For each of ``least`` the slots, 2^``bits`` of them, that at least so many of the values in the arrays of ``column`` hash to.

    Two values may share a slot; a value that occurs ``least`` times always has its slot set. Tasks send
    two bytes a value, the driver gets 2^``bits`` bits at most for each of ``least``, as 8 KB pieces by number. ``values_of()``
    returns a function from a column of another kind to arrays of its values.
    """
    flat = values_of or (lambda: lambda lists: [lists.flatten().to_numpy(zero_copy_only=False)])

    def deal(batches):
        arrays = flat()
        for b in batches:
            for own in arrays(b.column(0)):
                slot = slots_of(own, bits)
                slot.sort()
                piece, first = np.unique(slot >> 16, return_index=True)
                ends = np.append(first[1:], len(slot))
                packed = [(slot[x:y] & 0xFFFF).astype(np.uint16).tobytes() for x, y in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(packed, pa.binary())], ["piece", "places"])

    def gather(batches):
        at, seen = None, np.zeros(1 << 16, np.int64)
        for b in batches:
            for piece, places in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                if piece != at:
                    if at is not None:
                        yield at, seen
                    at, seen = piece, np.zeros(1 << 16, np.int64)
                seen += np.bincount(np.frombuffer(places.as_py(), np.uint16), minlength=1 << 16)
        if at is not None:
            yield at, seen

    def settle(batches):
        for piece, seen in gather(batches):
            full = [np.packbits(seen >= n, bitorder="little").tobytes() for n in least]
            columns = [pa.array([piece] * len(least), pa.int32()), pa.array(range(len(least)), pa.int32()), pa.array(full, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "of", "full"])

    dealt = values.select(column).mapInArrow(deal, "piece int, places binary").repartition(parts_of(values), "piece").sortWithinPartitions("piece")
    out = [{} for _ in least]
    for r in dealt.mapInArrow(settle, "piece int, of int, full binary").collect():
        out[r.of][r.piece] = bytes(r.full)
    return out


def slots_of(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def has_slot(full: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Is the slot of a value set in the bit table ``full``?"""
    slot = slots_of(values, (8 * len(full)).bit_length() - 1)
    return (full[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


class Slots:
    """Look-up in the pieces of ``bitmap``."""

    def __init__(self, pieces: dict[int, bytes], bits: int = 27):
        self.full = np.zeros(1 << (bits - 3), np.uint8)
        for piece, full in pieces.items():
            self.full[piece << 13 : (piece + 1) << 13] = np.frombuffer(full, np.uint8)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return has_slot(self.full, values)


def _shared_rows(texts: DataFrame, twice) -> DataFrame:
    """p, h, n, i: the prefix shingles p, at place i, that another of the distinct ``texts`` (h, n, prefix) has too.

    A shingle of one text only that shares a slot with another comes along; it makes no pair.
    """

    def spread(batches):
        full = Slots(twice.value)
        for b in batches:
            lists = b.column(2)
            p = lists.flatten().to_numpy(zero_copy_only=False)
            begins = lists.offsets.to_numpy()
            size = np.diff(begins)
            i = np.arange(len(p)) - np.repeat(begins[:-1] - begins[0], size)
            keep = full(p) if len(p) else np.zeros(0, bool)
            h, n = (np.repeat(b.column(c).to_numpy(), size)[keep] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(p[keep]), pa.array(h), pa.array(n), pa.array(i[keep], pa.int32())], ["p", "h", "n", "i"])

    return texts.select("h", "n", "prefix").mapInArrow(spread, "p long, h long, n int, i int")


def sketch_of(own: np.ndarray) -> bytes:
    """How many of the distinct shingles ``own`` fall into each of about half as many parts of the hash range."""
    bits = max(6, int(len(own) // 2).bit_length())
    mixed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return np.bincount(mixed.astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes()


def shared_at_most(x: bytes, y: bytes) -> int:
    """No two sets with these sketches share more: part by part the smaller count."""
    a, b = (np.frombuffer(v, np.uint16).astype(np.int64) for v in (x, y))
    if len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a.reshape(len(b), -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


PARTS = 256


def parts_counts(own: np.ndarray) -> bytes:
    """How many of the distinct shingles ``own`` fall into each of ``PARTS`` parts of the hash range."""
    mixed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (PARTS.bit_length() - 1))
    return np.bincount(mixed.astype(np.int64), minlength=PARTS).astype(np.uint16).tobytes()


def _stored(docs: DataFrame, wanted: DataFrame, *, key: str, text: str, shingle: int) -> DataFrame:
    """h, x, n, s, z: one copy of every text in ``wanted`` (h, least), its shingles' number, sketch and counts by part.

    Other texts, but for a few that share a slot with one, never leave their task.
    """
    bits = 24
    mark = lambda h, k: F.xxhash64(h, F.col(k).cast("string"))
    some = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.array(mark("h", "least")).alias("m")), "m", bits=bits)[0])

    def pick(batches):
        full, runs = Slots(some.value, bits), _runs(shingle)
        for b in batches:
            b = b.filter(pa.array(full(b.column(0).to_numpy()) if len(b) else [], pa.bool_()))
            own = [runs(v.as_py()) for v in b.column(2)]
            added = pa.array(list(map(len, own)), pa.int32()), pa.array(list(map(sketch_of, own)), pa.binary()), pa.array(list(map(parts_counts, own)), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *added], ["h", "x", "n", "s", "z"])

    every = docs.select(F.xxhash64(text).alias("h"), F.col(key).alias("k"), F.make_valid_utf8(text).alias("x")).where("x is not null")
    picked = every.select(mark("h", "k"), "h", "x").mapInArrow(pick, "h long, x string, n int, s binary, z binary")
    one = written(picked.groupBy("h").agg(F.max("x").alias("x"), *[F.max(c).alias(c) for c in ("n", "s", "z")]))
    some.destroy()
    return one


def _alike(one: DataFrame, pairs: DataFrame, *, shingle: int, near: float) -> DataFrame:
    """The ``pairs`` (h, h2) of text hashes whose texts, ``one`` (see ``_stored``), are ``near`` similar.

    Pairs whose sketches rule the similarity out are dropped, only for the others do texts meet.
    """

    def met(*columns):
        left = one.select("h", *columns)
        right = one.select(F.col("h").alias("h2"), *[F.col(c).alias(f"{c}2") for c in columns])
        return lambda of: of.join(left, "h").join(right, "h2")

    def possible(batches):
        for b in batches:
            n, m = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            most = np.array([shared_at_most(x.as_py(), y.as_py()) for x, y in zip(b.column(3), b.column(5), strict=True)], np.int64)
            keep = most >= near * (n + m) / (1 + near) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["h", "h2"]).filter(pa.array(keep))

    may = met("n", "s")(pairs).select("h", "h2", "n", "s", "n2", "s2").mapInArrow(possible, "h long, h2 long")
    both = met("x")(written(may))

    def decide(batches):
        runs = _runs(shingle)
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = runs(x.as_py()), runs(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= near * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["h", "h2"]).filter(pa.array(keep, pa.bool_()))

    return both.select("h", "h2", "x", "x2").mapInArrow(decide, "h long, h2 long")


def _unjoined(rows: DataFrame, near: float, *, best: bool, block: int = 2048) -> DataFrame:
    """h, h2: texts of one bucket in different components that places and counts by part do not rule out.

    ``rows`` has p, h, n, i, component and z. Pairs are compared where their bucket lies and never become rows, unless they
    stay; with ``best`` each text keeps only its likeliest partner in a bucket. A bucket of more than ``block`` texts is dealt
    out by pairs of blocks, so a task holds two blocks.
    """
    sizes = rows.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("k"))
    cut = rows.join(sizes, "p").withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("p", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "h", "n", "i", "component", "z")
    dealt = dealt.repartition(parts_of(rows), "p", "lo", "hi").sortWithinPartitions("p", "lo", "hi", "h")

    def settle(lo, hi, held):
        own, h, n, i, part = (np.concatenate(x) for x in zip(*[x[:5] for x in held], strict=True))
        z = np.frombuffer(b"".join(y for x in held for y in x[5]), np.uint16).reshape(len(h), -1)
        found = []
        for x in range(len(h)):
            if lo != hi and own[x] != lo and not best:
                continue
            ok = part != part[x]
            ok &= own != own[x] if lo != hi else True
            if lo == hi and not best:
                ok[: x + 1] = False
            need = (n + n[x]) * (near / (1 + near)) - 1e-9
            ok &= np.minimum(n - i, n[x] - i[x]) >= need
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            over = np.minimum(z[at], z[x]).sum(axis=1, dtype=np.int64) - need[at]
            some = over >= 0
            at, over = at[some], over[some]
            if best and len(at):
                at = at[[np.argmax(over)]]
            found.append((np.minimum(h[at], h[x]), np.maximum(h[at], h[x])))
        if found:
            columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "h2"])

    def compare(batches):
        key, held = None, []
        for b in batches:
            p, lo, hi, own, h, n, i, part = (b.column(c).to_numpy() for c in range(8))
            z = b.column(8).to_pylist()
            turns = np.flatnonzero((np.diff(p) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for x, y in zip(np.concatenate(([0], turns)), np.concatenate((turns, [len(p)])), strict=True):
                if x == y:
                    continue
                if (p[x], lo[x], hi[x]) != key:
                    if held:
                        yield from settle(*key[1:], held)
                    key, held = (p[x], lo[x], hi[x]), []
                held.append((own[x:y], h[x:y], n[x:y].astype(np.int64), i[x:y].astype(np.int64), part[x:y], z[x:y]))
        if held:
            yield from settle(*key[1:], held)

    return dealt.mapInArrow(compare, "h long, h2 long").distinct()


def near_links(docs: DataFrame, marked: DataFrame, edges: DataFrame, *, key: str, text: str, shingle: int, near: float) -> DataFrame:
    """source, target: links that join the fingerprints joined by ``edges`` and those of all texts that are ``near`` similar.

    ``marked`` has the key, fp, h (the text's hash), n (its shingles) and prefix of every row.
    """
    # copies of a text count once
    texts = marked.groupBy("h").agg(F.min("fp").alias("fp"), F.min(key).alias("least"), F.min("n").alias("n"), F.first("prefix").alias("prefix"))
    texts = written(texts)
    names = texts.select("h", "fp", "least")
    twice = docs.sparkSession.sparkContext.broadcast(bitmap(texts, "prefix", least=(2,))[0])
    rows = _shared_rows(texts, twice)
    # four heads per group of texts: those that one head does not reach are mostly joined by another
    met = written(_buckets(rows.withColumn("s", F.xxhash64("h", F.pmod("p", F.lit(4))))))
    twice.destroy()

    def named(found: DataFrame) -> DataFrame:
        ends = found.join(names.select("h", F.col("fp").alias("source")), "h")
        return ends.join(names.select(F.col("h").alias("h2"), F.col("fp").alias("target")), "h2").select("source", "target")

    of, how = {"key": key, "text": text, "shingle": shingle}, {"shingle": shingle, "near": near}
    star = met.where(_may(near, "n", "i", "a_n", "a_i")).select(F.least("h", "a").alias("h"), F.greatest("h", "a").alias("h2"))
    star = written(star.distinct())
    ends = star.select("h").unionByName(star.select(F.col("h2").alias("h"))).distinct()
    found = written(_alike(_stored(docs, ends.join(names, "h"), **of), star, **how))
    edges = written(edges.unionByName(named(found)))

    def components() -> DataFrame:
        return written(connected_components(names.select(F.col("fp").alias("node")).distinct(), edges))

    def open_(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The buckets whose texts are not all joined yet."""
        placed = rows.join(names.join(roots, F.col("fp") == F.col("node")).select("h", "component"), "h")
        mixed = placed.groupBy("p").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("p")
        return written(placed.join(mixed, "p"))

    roots = components()
    rows = open_(met.drop("a", "a_n", "a_i"), roots)
    one = _stored(docs, rows.select("h").distinct().join(names, "h"), **of)
    # each text meets its likeliest partner first: what that joins need not be compared in full
    likely = written(_unjoined(rows.join(one.select("h", "z"), "h"), near, best=True).join(star, ["h", "h2"], "left_anti"))
    edges = written(edges.unionByName(named(written(_alike(one, likely, **how)))))
    roots = components()
    rows = open_(rows.drop("component"), roots)
    rest = _unjoined(rows.join(one.select("h", "z"), "h"), near, best=False)
    rest = rest.join(star.unionByName(likely), ["h", "h2"], "left_anti")
    more = named(_alike(one, written(rest), **how))
    joined = roots.where("node <> component").select(F.col("node").alias("source"), F.col("component").alias("target"))
    return joined.unionByName(more).distinct()


def as_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(fp: str, places: list[tuple[int, int]]) -> Column:
    """The (first bit, number of bits) places of ``fp``, side by side."""
    out = F.lit(0).cast("long")
    for first, size in places:
        part = F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out = F.shiftleft(out, size).bitwiseOR(part)
    return out


def _first_keys() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), _bits("fp", [(16 * a, 16), (16 * b, 16)]).alias("v")) for k, (a, b) in enumerate(BLOCKS)])


def _second_keys() -> Column:
    """For a bucket of block pair k: the six pairs of 8-bit blocks of the other 32 bits."""
    out = F.array().cast("array<struct<k:int,v:bigint>>")
    for k, pair in enumerate(BLOCKS):
        rest = [b for b in range(4) if b not in pair]
        eighths = [(16 * b + h, 8) for b in rest for h in (0, 8)]
        keys = [
            F.struct((F.lit(6 + 6 * k + m)).alias("k"), F.shiftleft(F.col("v"), 16).bitwiseOR(_bits("fp", [eighths[a], eighths[b]])).alias("v"))
            for m, (a, b) in enumerate(combinations(range(4), 2))
        ]
        out = F.when(F.col("k") == k, F.array(*keys)).otherwise(out)
    return out


def links(prints: DataFrame, *, radius: int = 2, bucket: int = 4096) -> DataFrame:
    """source, target: a spanning forest of the links between distinct fingerprints (column fp).

    ``bucket`` is the size above which a bucket is cut again; it changes the cost, never the links.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four equal blocks are guaranteed for a radius of 2 at most")
    keyed = prints.select("fp", F.explode(_first_keys()).alias("b")).select("fp", "b.k", "b.v")
    sizes = keyed.groupBy("k", "v").count().where("count > 1")
    met = keyed.join(sizes, ["k", "v"])
    cut = met.where(F.col("count") > bucket).select("fp", F.explode(_second_keys()).alias("b")).select("fp", "b.k", "b.v")
    rows = met.where(F.col("count") <= bucket).select("fp", "k", "v").unionByName(cut)

    def compare(batches):
        key, held = None, []

        def settle():
            own = np.unique(np.array(held, np.int64)).view(np.uint64)
            if len(own) < 2:
                return
            root = spanning(len(own), close_pairs(own, own, radius, True))
            child = np.flatnonzero(root != np.arange(len(own)))
            if len(child):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[child].view(np.int64)), pa.array(own[root[child]].view(np.int64))], ["source", "target"]
                )

        for batch in batches:
            k, v, fp = (batch.column(c).to_numpy() for c in range(3))
            turns = np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0)) + 1
            for a, b in zip(np.concatenate(([0], turns)), np.concatenate((turns, [len(k)])), strict=True):
                if a == b:
                    continue
                if (k[a], v[a]) != key:
                    yield from settle()
                    key, held = (k[a], v[a]), []
                held.extend(fp[a:b].tolist())
        yield from settle()

    dealt = rows.select("k", "v", "fp").repartition(parts_of(prints), "k", "v").sortWithinPartitions("k", "v")
    return dealt.mapInArrow(compare, "source long, target long").distinct()


def groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2,
    near: float | None = None, near_shingle: int = 5,
) -> DataFrame:
    """key, fp, h (the text's hash), root (a fingerprint of the group), component_id: the smallest key of the group.

    With ``near``, texts of that similarity over ``near_shingle`` words are linked too.
    """
    base = docs.select(F.col(key), F.col(text).alias("__text"), F.xxhash64(text).alias("h"))

    if near is None:
        marked = checkpoint(fingerprints(base, text="__text", shingle=shingle, seed=seed).select(key, "fp", "h"))
        nodes = checkpoint(marked.groupBy("fp").agg(F.min(key).alias("least")))
        edges = links(nodes, radius=radius)
    else:
        order = common_shingles(docs, text, near_shingle), often_shared(docs, text, near_shingle)
        shared = docs.sparkSession.sparkContext.broadcast(order)

        def make():
            ((common, often), tables), runs = shared.value, _runs(near_shingle)

            def both(value):  # one text at a time: the words of a batch would not fit
                own = runs(value)
                return simhash(shingle_hashes(words_of(value), shingle, seed)), len(own), prefix_of(own, common, often, near, tables).view(np.int64)

            return lambda values: [list(x) for x in zip(*map(both, values), strict=True)] if values else [[], [], []]

        marked = append_columns(base, "__text", make, "fp long, n int, prefix array<bigint>")
        marked = written(marked.select(key, "fp", "h", "n", "prefix"))
        nodes = checkpoint(marked.groupBy("fp").agg(F.min(key).alias("least")))
        close = checkpoint(links(nodes, radius=radius))
        edges = near_links(docs, marked, close, key=key, text=text, shingle=near_shingle, near=near)
    roots = connected_components(nodes.select(F.col("fp").alias("node")), edges)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("fp", F.col("component").alias("root"), "component_id")
    return marked.join(named, "fp").select(key, "fp", "h", "root", "component_id")


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: one whose key names the group, of its texts with that key the one of smallest hash.

    Rows that repeat that key and text are copies, the first in column order stays. Groups without any key keep one row.
    """
    found = groups(docs, key=key, text=text, **how).where(F.col(key).eqNullSafe(F.col("component_id")))
    every = found.groupBy("root", key, "h").agg(F.count(F.lit(1)).alias("n"))
    chosen = checkpoint(every.groupBy("root").agg(F.min_by(F.struct(F.col(key).alias("k"), "h", "n"), "h").alias("c")).select("c.*"))

    def rows(of: DataFrame) -> DataFrame:
        of = of.select(F.col("k").alias("__k"), F.col("h").alias("__h"))
        return docs.join(of, F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(text) == F.col("__h")), "left_semi")

    again = rows(chosen.where("n > 1"))
    first = again.groupBy(key, F.xxhash64(text).alias("__h")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return rows(chosen.where("n = 1")).unionByName(first.select("__row.*"))
