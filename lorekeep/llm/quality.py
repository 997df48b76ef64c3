"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text's log importance weight is the sum over its words and word pairs of log p_target - log p_raw over
hashed buckets. The raw model counts every text; the target model counts texts marked as good and is smoothed towards
the raw one, so that an n-gram too rare to be expected in the target says nothing.
Adding Gumbel noise and taking the k largest keys samples without replacement in proportion to the weights.

The k-th key is found by histograms of the keys: bins go to the driver, their number fixed, and the bin that holds the
k-th key is binned again until its rows are few; exact order inside it is by key, then id, then text hash.

Null and empty texts have no n-grams: weight 0. Repeated rows share their noise and are taken together up to k rows. An empty table gives an empty
table. Without target rows the models are equal and all weights are 0. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import WORD, WordRows, append_columns, checkpoint

MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * MIX


def grams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, given as word hashes."""
    pairs = (hashes[:-1] ^ (hashes[1:] >> np.uint64(7))) * MIX
    return ((np.concatenate((hashes, pairs)) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _reader():
    words = WordRows(_hashes)

    def read(value, buckets):
        own = WORD.findall(value.lower()) if value else []
        if not own:
            return None
        words.settle()
        ids = words.ids(own)
        return grams(words.table()[ids], buckets)

    return read


def counts(texts: DataFrame, *, text: str = "text", buckets: int = 1 << 16) -> np.ndarray:
    """n-gram counts of all texts by bucket: summed per task, then over tasks; ``buckets`` numbers reach the driver."""

    def count(batches):
        total, read = np.zeros(buckets, np.int64), _reader()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                own = read(value, buckets)
                if own is not None:
                    total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.make_valid_utf8(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def weigh(docs: DataFrame, target: np.ndarray, raw: np.ndarray, *, text: str = "text", prior: float = 5.0) -> DataFrame:
    """``docs`` with log_weight and n_grams; ``prior`` is the smoothing in counts."""
    expected = target.sum() * raw / max(1, raw.sum())
    ratio = np.log((target + prior) / (expected + prior))
    if not target.sum():
        ratio = np.zeros(len(raw))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def make():
        ratio, read = shared.value, _reader()

        def judge(value):
            own = read(value, len(ratio))
            return (0.0, 0) if own is None else (float(ratio[own].sum()), len(own))

        return lambda values: [list(x) for x in zip(*map(judge, values), strict=True)] if values else [[], []]

    return append_columns(docs, text, make, "log_weight double, n_grams long")


def top(keyed: DataFrame, key: str, order: list[str], k: int, *, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """``keyed`` with selected: the ``k`` rows of largest ``key``, ties by ``order``."""
    low, high, above = None, None, 0
    inside = keyed
    while True:
        about = inside.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
        low, high = about["a"], about["b"]
        if about["n"] <= few or low == high or k <= above:
            break
        step = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(step)).cast("int"))
        tally = dict(inside.groupBy(place.alias("p")).count().collect())  # at most `bins` rows
        p, taken = bins - 1, above
        while p > 0 and taken + tally.get(p, 0) < k:
            taken += tally.get(p, 0)
            p -= 1
        above = taken
        inside = inside.where(place == p)
        if tally.get(p, 0) == about["n"]:
            break
    if low is None:
        return keyed.withColumn("selected", F.lit(False))
    rest = max(0, k - above)
    inner = F.col(key).between(low, high)
    last = keyed.where(inner).select(key, *order).orderBy(F.col(key).desc(), *order).limit(rest)
    # the rows of the last bin are few, or equal in key: their last one is the bound
    bound = last.orderBy(F.col(key).asc(), *[F.col(c).desc() for c in order]).first()
    if bound is None:
        return keyed.withColumn("selected", F.col(key) > high)
    after = F.lit(True)
    for c in reversed(order):
        value = F.lit(bound[c])
        after = F.coalesce(F.col(c) < value, F.lit(bound[c] is not None) & F.col(c).isNull()) | (F.col(c).eqNullSafe(value) & after)
    return keyed.withColumn("selected", (F.col(key) > bound[key]) | ((F.col(key) == bound[key]) & F.coalesce(after, F.lit(False))))


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", share: float = 0.85, buckets: int = 1 << 16, seed: int = 3
) -> DataFrame:
    """key, log_weight, n_grams, gumbel_key, selected for every row; ``share`` of the rows are selected."""
    raw = counts(docs, text=text, buckets=buckets)
    good = counts(target, buckets=buckets)
    base = docs.select(F.col(key), F.col(text).alias("__text"))
    weighed = weigh(base, good, raw, text="__text").withColumn("text_hash", F.xxhash64("__text")).drop("__text")
    draw = F.xxhash64(F.col(key).cast("string"), "text_hash", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    noise = -F.log(-F.log((draw + F.lit(0.5)) / F.lit(float(1 << 52))))
    keyed = checkpoint(weighed.withColumn("gumbel_key", F.col("log_weight") + noise))
    return top(keyed, "gumbel_key", [key, "text_hash"], math.ceil(share * keyed.count())).drop("text_hash")
