"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter per language, stored across: slot ``i`` holds one bit per language, so the AND of an
n-gram's slots is the mask of all languages whose filter contains it. A text is judged by one
popcount per language, corrected for the false positives that the filter's fill predicts.

Null texts and texts without a letter give ``und`` and score 0. Ties go to the smaller language
value. A table without labelled rows gives a model without languages, which answers ``und``.
Repeated rows are judged each; other columns stay; columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import WordRows, append_columns

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
GRAMS = (1, 2, 3, 4)


def letters(word: str) -> list[str]:
    """The stretches of letters (``str.isalpha``) in a word; fractions, numerals and the like are none."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def grams_of(word: str) -> list[str]:
    """n-grams of a word with its borders; a border alone is none."""
    padded = f" {word} "
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1) if n > 1 or 0 < i < len(padded) - 1]


@dataclass
class Filters:
    """languages, slots (size, 64-bit words of language bits), hashes per n-gram."""

    languages: list[str]
    slots: np.ndarray
    hashes: int

    def masks(self, grams: list[str]) -> np.ndarray:
        """The languages that contain each n-gram, one bit each."""
        key = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint64, len(grams))
        key = key * np.uint64(0x9E3779B97F4A7C15)
        size, step = np.uint64(len(self.slots)), (key >> np.uint64(40)) | np.uint64(1)
        found = self.slots[((key >> np.uint64(8)) % size).astype(np.int64)]
        for k in range(1, self.hashes):
            found = found & self.slots[(((key >> np.uint64(8)) + np.uint64(k) * step) % size).astype(np.int64)]
        return found

    def add(self, language: int, grams: list[str]) -> None:
        key = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint64, len(grams))
        key = key * np.uint64(0x9E3779B97F4A7C15)
        size, step = np.uint64(len(self.slots)), (key >> np.uint64(40)) | np.uint64(1)
        bit = np.uint64(1) << np.uint64(language % 64)
        for k in range(self.hashes):
            at = (((key >> np.uint64(8)) + np.uint64(k) * step) % size).astype(np.int64)
            self.slots[at, language // 64] |= bit

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """One column of 0/1 per language."""
        shifts = np.arange(len(self.languages))
        bits = masks[:, shifts // 64] >> (shifts % 64).astype(np.uint64)
        return (bits & np.uint64(1)).astype(np.int32)

    def false_positives(self) -> np.ndarray:
        """Chance that an n-gram outside the filter is found, per language."""
        fill = self.counts(self.slots).mean(axis=0) if self.languages else np.zeros(0)
        return fill**self.hashes


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = 3000,
    min_docs: int = 5,
    max_languages: int = 256,
    profile: int = 20_000,
    ratio: float = 0.5,
    slots: int = 1 << 18,
    hashes: int = 3,
) -> Filters:
    """Filters learned from labelled texts.

    Bounds: about ``docs_per_language`` texts per language (drawn by a hash of the text, whole
    texts; a language with fewer than ``min_docs`` is left out, more
    than ``max_languages`` are an error) and ``profile`` n-grams per language, the most
    frequent. An n-gram enters the filter of each language where it is at least ``ratio`` times
    as frequent as where it is most frequent.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.make_valid_utf8(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    counts = labelled.groupBy("lang").count().where(F.col("count") >= min_docs).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    draw = F.xxhash64("text", F.lit(4)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    rates = [F.when(F.col("lang") == r["lang"], docs_per_language / r["count"]) for r in counts]
    drawn = labelled.where(draw < F.coalesce(*rates, F.lit(0.0)))

    def count(batches):
        total: dict[str, Counter] = {}
        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(name, Counter()).update(WORDS.findall(value.lower()))
            if sum(map(len, total.values())) > 300_000:
                yield from emit(total)
                total = {}
        yield from emit(total)

    def emit(total):
        for name, words in total.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for part in letters(word):
                    for g in grams_of(part):
                        grams[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())],
                ["lang", "gram", "n"],
            )

    seen = drawn.select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    sums = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_gram = Window.partitionBy("gram")  # one row per language at most
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = sums.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    apt = rates.where("n >= 2").withColumn("top", F.max("rate").over(per_gram)).where(F.col("rate") >= ratio * F.col("top"))
    # the profile is a top-k per language: a rate that about `profile` n-grams reach, by a sketch
    cut = apt.groupBy("lang").agg(
        F.count(F.lit(1)).alias("m"), F.max("rate").alias("most")
    )
    ranked = apt.join(cut, "lang").withColumn(
        "level", F.floor(F.log2(F.col("most") / F.col("rate")) * 64).cast("int")
    )
    levels = ranked.groupBy("lang", "level").count()
    upto = Window.partitionBy("lang").orderBy("level")  # levels are at most 64 per binary order
    fits = levels.withColumn("sum", F.sum("count").over(upto)).where(F.col("sum") <= profile)
    chosen = ranked.join(fits.select("lang", "level"), ["lang", "level"]).select("lang", "gram")

    by_lang: dict[str, list[str]] = {}
    for row in chosen.collect():  # at most `profile` rows per language
        by_lang.setdefault(row["lang"], []).append(row["gram"])
    languages = sorted(by_lang)
    model = Filters(languages, np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64), hashes)
    for number, name in enumerate(languages):
        model.add(number, by_lang[name])
    return model


def predict(docs: DataFrame, model: Filters, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the winner's share of the corrected popcounts."""
    # plain values of fixed size (slots): workers need no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.hashes))

    def make():
        filters = Filters(*shared.value)
        width = len(filters.languages)
        miss = filters.false_positives()

        def rows(words: list[str]) -> np.ndarray:
            lists = [[g for part in letters(w) for g in grams_of(part)] for w in words]
            sizes = np.array([len(x) for x in lists])
            flat = filters.counts(filters.masks([g for x in lists for g in x]))
            out = np.zeros((len(words), width + 1), np.int32)
            some = np.flatnonzero(sizes)
            if len(some):
                out[some, :width] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[some], axis=0)
            out[:, width] = sizes
            return out

        words = WordRows(rows)

        def judge(value):
            found = WORDS.findall(value.lower()) if value else []
            if not found or not width:
                return UNKNOWN, 0.0
            words.settle()
            ids = words.ids(found)
            total = words.table()[ids].sum(axis=0, dtype=np.int64)
            n, hits = total[width], total[:width]
            if not n:
                return UNKNOWN, 0.0
            net = np.maximum((hits - n * miss) / (1 - miss + 1e-12), 0)
            if net.sum() <= 0:
                return filters.languages[0], 0.0
            best = int(net.argmax())
            return filters.languages[best], float(net[best] / net.sum())

        def work(values):
            judged = [judge(v) for v in values]
            return [[x[0] for x in judged], [x[1] for x in judged]]

        return work

    return append_columns(docs, text, make, "lang_pred string, score double")
