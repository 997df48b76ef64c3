"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents carry labels. A sentence's score is a logistic function of hashed word and character
n-gram weights; a document's is one minus the product of the sentences' complements, so the
gradient of a document's label goes to the sentences that explain it. The trained sentence
scores then locate the offending sentences.

Null and empty texts have no sentence: score 0, no span. Repeated rows are scored each. Without
labelled rows of both classes every sentence gets the prior. Other columns stay; columns named
like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import WORD, WordRows, append_columns

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
BUCKETS = 1 << 18


def features(word: str) -> list[int]:
    """The word, its beginnings, and its inner 4- and 5-grams, hashed."""
    own = {f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n)}
    own.update(word[i : i + n] for n in (4, 5) for i in range(1, len(word) - n + 1))
    return [zlib.crc32(x.encode()) % BUCKETS for x in own]


@dataclass
class Model:
    """weights by feature bucket, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        lists = [features(w) for w in words]
        sizes = np.array([len(x) for x in lists])
        flat = self.weights[np.fromiter((f for x in lists for f in x), np.int64, sizes.sum())]
        return np.add.reduceat(flat, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def _fit(rows: Iterable[tuple[str, int]], rounds: int, rate: float, decay: float, rare: int, piece: int = 1 << 19) -> Model:
    """Adagrad with an L1 penalty and weights of zero or more on the noisy-or likelihood, all sentences at once; words share feature weights.

    ``rows`` are read once and not kept: 4 bytes stay for a word of a sentence, 8 for a feature of a distinct word.
    Sums go over ``piece`` of them at a time, added in the order of the whole, so the model does not depend on it.
    """
    vocabulary: dict[str, int] = {}
    seen, labelled, token, sizes, documents, feature, counts = (array("i") for _ in range(7))
    for d, (value, y) in enumerate(rows):
        labelled.append(y)
        own: set[int] = set()
        for sentence in SENTENCE.findall(value.lower()):
            ids = set()
            for w in WORD.findall(sentence):
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary)
                    new = features(w)
                    feature.extend(new)
                    counts.append(len(new))
                    seen.append(0)
                ids.add(vocabulary[w])
            if ids:
                token.extend(ids)
                sizes.append(len(ids))
                documents.append(d)
                own |= ids
        for i in own:
            seen[i] += 1
    del vocabulary
    labels = np.array(labelled, np.int64)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS), 5.0 if len(labels) and labels[0] == 1 else -5.0)
    token, sizes, document, feature = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (token, sizes, documents, feature))
    n, m, size = len(sizes), len(labels), len(counts)
    owner = np.repeat(np.arange(size, dtype=np.int32), counts)
    # a feature must occur in several documents, else it only remembers one of them
    spread, used = np.array(seen, np.int64), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(feature), piece):
        np.add.at(used, feature[at : at + piece], spread[owner[at : at + piece]])
    keep = (used >= rare)[feature]
    feature, owner = feature[keep], owner[keep]
    # pieces end between sentences
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(token), piece)).tolist() + [n]).tolist()
    weights, moment = np.zeros(BUCKETS), np.full(BUCKETS, 0.1)
    bias = float(np.log(max(labels.mean(), 1e-4) * m / n)) - 2 if n else -5.0
    bias_moment = 1e-6
    balance = np.where(labels == 1, (labels == 0).sum() / max(1, (labels == 1).sum()), 1.0) ** 0.8
    for _ in range(rounds):
        word, z, grad_word, grad = np.zeros(size), np.empty(n), np.zeros(size), np.zeros(BUCKETS)
        for at in range(0, len(feature), piece):
            np.add.at(word, owner[at : at + piece], weights[feature[at : at + piece]])
        for a, b in pairwise(cuts):
            z[a:b] = bias + np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), word[token[ends[a] : ends[b]]], b - a)
        soft = np.logaddexp(0, z)
        total = np.bincount(document, soft, m)
        slope = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-6, 700)), 1.0) * balance
        grad_z = slope[document] / (1 + np.exp(-z))
        for a, b in pairwise(cuts):
            np.add.at(grad_word, token[ends[a] : ends[b]], np.repeat(grad_z[a:b], sizes[a:b]))
        for at in range(0, len(feature), piece):
            np.add.at(grad, feature[at : at + piece], grad_word[owner[at : at + piece]])
        moment += grad**2
        step = rate / np.sqrt(moment)
        weights -= step * grad
        weights = np.maximum(weights - step * decay, 0)  # evidence only adds up; most features say nothing
        g = grad_z.sum()
        bias_moment += g * g
        bias -= 4 * rate * g / np.sqrt(bias_moment)
    return Model(weights, bias)


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    label: str = "label",
    sample: int = 12_000,
    max_chars: int = 60_000_000,
    rounds: int = 400,
    rate: float = 0.6,
    decay: float = 0.01,
    rare: int = 3,
) -> Model:
    """The model of ``docs`` with a 0/1 label per document.

    Bounds of the training set: about ``sample`` documents, drawn by a hash of the text, and no
    further document once ``max_chars`` characters are taken. The fit runs in one task on that sample and sends home the non-zero
    weights, ``BUCKETS`` at most.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.make_valid_utf8(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(text, F.lit(1)).alias("draw")
    )
    size = labelled.count()
    if size > sample:
        share = int(sample / size * (1 << 40))
        labelled = labelled.where(F.col("draw").bitwiseAND(F.lit((1 << 40) - 1)) < share)

    def fit(batches):
        def rows():
            chars = 0
            for batch in batches:
                for value, y in zip(batch.column(0), batch.column(1), strict=True):
                    if chars < max_chars:
                        value = value.as_py()
                        chars += len(value)
                        yield value, y.as_py()

        model = _fit(rows(), rounds, rate, decay, rare)
        at = np.flatnonzero(np.abs(model.weights) > 1e-6)
        bucket = np.concatenate(([-1], at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(np.concatenate(([model.bias], model.weights[at])))], ["bucket", "weight"]
        )

    one = labelled.select("text", "label", "draw").repartition(1).sortWithinPartitions("draw", "text")
    found = one.select("text", "label").mapInArrow(fit, "bucket long, weight double").toPandas()
    weights, bias = np.zeros(BUCKETS), -5.0
    for bucket, weight in zip(found["bucket"], found["weight"], strict=True):
        if bucket < 0:
            bias = float(weight)
        else:
            weights[bucket] = weight
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", offending: float = 0.5) -> DataFrame:
    """``docs`` with score and offending: (begin, end, score) of sentences that score at least ``offending``.

    Positions count characters of the text. A third column, n_sentences, counts the sentences with a word.
    """
    # plain values of fixed size (BUCKETS weights): workers need no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        model = Model(*shared.value)
        words = WordRows(model.words)

        def judge(value):
            if not value:
                return 0.0, [], 0
            words.settle()
            lowered = value.lower()
            same = len(lowered) == len(value)
            found, sizes, spans = [], [], []
            for m in SENTENCE.finditer(lowered if same else value):
                own = set(WORD.findall(m[0].lower()))
                if own:
                    found.extend(own)
                    sizes.append(len(own))
                    spans.append(m.span())
            if not found:
                return 0.0, [], 0
            ids = words.ids(found)
            z = model.bias + np.add.reduceat(words.table()[ids], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            p = 1 / (1 + np.exp(-z))
            bad = [{"begin": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= offending)]
            return float(-np.expm1(-np.logaddexp(0, z).sum())), bad, len(spans)

        def work(values):
            judged = [judge(v) for v in values]
            return [[x[k] for x in judged] for k in range(3)]

        return work

    fields = "score double, offending array<struct<begin:int,end:int,score:double>>, n_sentences int"
    return append_columns(docs, text, make, fields)
