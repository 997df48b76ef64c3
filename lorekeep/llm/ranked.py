"""Ranked search on a length-stratified index: integer impacts, bounds of strata order the visits.

Documents whose lengths give the same normaliser m form a stratum. Within it a term's contribution depends on
its frequency alone, so postings lie by term, then by falling frequency, and an impact is worked out once per
frequency and stratum, not per document. A stratum is written in blocks of a bounded number of words, a block
holds its own dictionary, postings and document ids and is one row of the index table.

A search takes the queries in blocks of bounded size. One pass over the dictionaries gives document
frequencies and the largest frequency of every query term in every stratum, from which each query's bound for
each stratum follows. A query first visits its strata of the largest bounds until they hold k documents; the
score of its k-th result is then a threshold. The second visit goes to the other strata whose bound reaches it,
and within them to the blocks whose own bound still does; the threshold rises as a task goes on. Bounds equal to
the threshold are visited, so ties are whole.

What moves: every text once to its block while the index is built, counts per (stratum, query term), and at
most k results a query and task. The driver holds one block of queries (``chars`` characters), their thresholds
and the list of strata, whose number depends on the spread of lengths and not on the number of documents.

Defined cases: null and empty texts have no terms, are not counted and never found. Invalid UTF-8 is read with
replacement characters. Documents with a null id are ranked after all others of equal score; repeated documents
are ranked each. Queries that repeat with id and text are asked once; those that share an id but not the text
are ranked each on its own. Terms that no document has count nothing. Empty tables give empty results; only the
key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import parts_of, written

BLOCK = "m long, shard int, docs array<bigint>, terms array<binary>, runs array<int>, run_tf array<int>, run_n array<int>, places array<int>"
#: ASCII letters and digits lower-cased, other ASCII to a space, everything else as it is.
FOLD = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches without ASCII characters other than letters and digits; A-Z lower-cased; as UTF-8."""
    return text.encode().translate(FOLD).split() if text else []


@dataclass(frozen=True)
class Index:
    """blocks: rows ``BLOCK``; strata: m, docs; the number of documents with a term, and of their terms."""

    blocks: DataFrame
    strata: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = 250_000) -> Index:
    """The index of all documents. ``block`` bounds the words of a block, one document more at most."""
    base = docs.select(F.col(key).cast("long").alias("id"), F.make_valid_utf8(F.col(text).cast("string")).alias("x"))
    parts = parts_of(docs)

    def lengths(batches):
        for batch in batches:
            n = np.fromiter((len(terms_of(v.as_py())) for v in batch.column(0)), np.int64, len(batch))
            values, docs = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(docs)], ["n", "docs"])

    counted = written(base.select("x").mapInArrow(lengths, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs")))
    total = counted.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    documents, terms = total[0] or 0, total[1] or 0
    m = F.expr(f"75L + (25L * n * {documents}L) div {max(terms, 1)}L")
    # two blocks a task at least, so that none holds much more than its share
    bound = max(1, min(block, terms // (4 * parts)))
    strata = counted.withColumn("m", m).groupBy("m").agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("words"))
    strata = written(strata.select("m", "docs", F.ceil(F.col("words") / bound).cast("int").alias("shards")))

    def marked(batches):
        for batch in batches:
            n = [len(terms_of(v.as_py())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["id", "x", "n"])

    placed = base.mapInArrow(marked, "id long, x string, n long").where("n > 0").withColumn("m", m).join(strata, "m")
    placed = placed.select("m", F.pmod(F.xxhash64("id", "x"), F.col("shards")).cast("int").alias("shard"), "id", "x")
    dealt = placed.repartition(parts, "m", "shard").sortWithinPartitions("m", "shard")
    return Index(written(dealt.mapInArrow(_blocks, BLOCK)), strata.select("m", "docs"), documents, terms)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (m, shard) of texts ordered by them."""
    at, ids, table, own, often = None, [], {}, [], []

    def settle():
        terms = sorted(table)
        rank = np.empty(len(terms), np.int64)
        rank[[table[t] for t in terms]] = np.arange(len(terms))
        term, tf = rank[np.concatenate(own)], np.concatenate(often)
        place = np.repeat(np.arange(len(ids)), [len(x) for x in own])
        order = np.lexsort((place, -tf, term))
        term, tf, place = term[order], tf[order], place[order]
        starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        numbers = (np.bincount(term[starts], minlength=len(terms)), tf[starts], np.diff(np.append(starts, len(tf))), place)
        rows = [
            pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
            pa.array([terms], pa.list_(pa.binary())), *[pa.ListArray.from_arrays([0, len(v)], pa.array(v, pa.int32())) for v in numbers],
        ]
        return pa.RecordBatch.from_arrays(rows, ["m", "shard", "docs", "terms", "runs", "run_tf", "run_n", "places"])

    for batch in batches:
        keys = batch.column(2).to_pylist()
        for place, value in enumerate(zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), strict=True)):
            if value != at:
                if at is not None:
                    yield settle()
                at, ids, table, own, often = value, [], {}, [], []
            counts = Counter(terms_of(batch.column(3)[place].as_py()))
            ids.append(keys[place])
            own.append(np.fromiter((table.setdefault(t, len(table)) for t in counts), np.int64, len(counts)))
            often.append(np.fromiter(counts.values(), np.int64, len(counts)))
    if at is not None:
        yield settle()


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """The contribution of a frequency in a stratum, before the term's weight."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(df: int, documents: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _lists(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    """The rows of a batch of blocks, list columns as arrays."""
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
    for row in range(len(batch)):
        yield {c: v[row].values if pa.types.is_list(v.type) else v[row].as_py() for c, v in columns.items()}


def _bounds(start: np.ndarray, term: np.ndarray, times: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Per query the sum over its terms of times * gain; every query has a term."""
    return np.add.reduceat(times * gain[term], start[:-1])


def search(index: Index, queries: DataFrame, *, key: str = "item_id", text: str = "text", k: int = 20, chars: int = 1_000_000) -> DataFrame:
    """key, rank, doc_id, score: the ``k`` best documents of every query with a score above 0.

    Queries come in blocks of about ``chars`` characters; a block is what the driver and every task hold at once.
    """
    asked = queries.select(F.col(key), F.make_valid_utf8(F.col(text).cast("string")).alias("x")).where("x is not null").distinct()
    size = asked.agg(F.sum(F.length("x"))).first()[0] or 0
    blocks = max(1, -(-size // chars))
    found = None
    for number in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(key, "x"), F.lit(blocks)) == number)
        part = _search_block(index, own, key, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select(key, F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found


def _search_block(index: Index, asked: DataFrame, key: str, k: int) -> DataFrame | None:
    spark = index.blocks.sparkSession
    rows = [(r[0], Counter(terms_of(r[1]))) for r in asked.collect()]
    rows = [(name, counts) for name, counts in rows if counts]
    if not rows or not index.documents:
        return None
    vocabulary = sorted({t for _, counts in rows for t in counts})
    number = {t: n for n, t in enumerate(vocabulary)}
    start = np.cumsum([0, *[len(c) for _, c in rows]])
    term = np.array([number[t] for _, c in rows for t in c], np.int64)
    times = np.array([n for _, c in rows for n in c.values()], np.int64)
    words = spark.sparkContext.broadcast(vocabulary)
    parts = parts_of(index.blocks)

    def meet(batches):
        asked_for = pa.array(words.value, pa.binary())
        for batch in batches:
            for b in _lists(batch, ["m", "terms", "runs", "run_tf", "run_n"]):
                at = pc.index_in(b["terms"], value_set=asked_for)
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                first = np.concatenate(([0], np.cumsum(b["runs"].to_numpy())))
                upto = np.concatenate(([0], np.cumsum(b["run_n"].to_numpy())))
                n = upto[first[here + 1]] - upto[first[here]]
                v = at.to_numpy(zero_copy_only=False)[here].astype(np.int64)
                most = b["run_tf"].to_numpy()[first[here]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(v), b["m"], np.int64), v, n.astype(np.int64), most)], ["m", "v", "n", "most"])

    met = index.blocks.select("m", "terms", "runs", "run_tf", "run_n").mapInArrow(meet, "m long, v long, n long, most long")
    met = written(met.groupBy("m", "v").agg(F.sum("n").alias("n"), F.max("most").alias("most")))
    gain = np.zeros(len(vocabulary), np.int64)
    for r in met.groupBy("v").agg(F.sum("n").alias("df")).collect():
        gain[r.v] = weight(r.df, index.documents)
    shared = spark.sparkContext.broadcast((start, term, times, gain))

    def bound(batches):
        start, term, times, gain = shared.value
        at, own = None, None

        def settle():
            bounds = _bounds(start, term, times, own)
            some = np.flatnonzero(bounds)
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), at, np.int64)), pa.array(bounds[some])], ["q", "m", "bound"])

        for batch in batches:
            for m, v, most in zip(*[batch.column(c).to_numpy() for c in range(3)], strict=True):
                if m != at:
                    if at is not None:
                        yield settle()
                    at, own = m, np.zeros(len(gain), np.int64)
                own[v] = gain[v] * impact(most, m)
        if at is not None:
            yield settle()

    bounds = met.select("m", "v", "most").repartition(parts, "m").sortWithinPartitions("m").mapInArrow(bound, "q long, m long, bound long")
    bounds = written(bounds)
    # the strata of the largest bounds until they hold k documents
    before = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.join(index.strata, "m").withColumn("held", F.coalesce(F.sum("docs").over(before), F.lit(0))).where(F.col("held") < k)
    plan: dict[int, list[int]] = {}
    for r in first.select("m", "q").collect():
        plan.setdefault(r.m, []).append(r.q)
    plan = {m: np.array(sorted(q), np.int64) for m, q in plan.items()}

    everything = [*index.blocks.columns[:1], *index.blocks.columns[2:]]
    near = index.blocks.where(F.col("m").isin(sorted(plan))).select(*everything)
    early = written(_visit(near, spark.sparkContext.broadcast((vocabulary, plan, True, np.zeros(len(rows), np.int64))), shared, k))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    least = np.zeros(len(rows), np.int64)
    for r in early.withColumn("rank", place).where(F.col("rank") == k).collect():
        least[r.q] = r.score
    # queries by threshold are data of this block only; the strata still to visit follow from it
    wanted = [r.m for r in bounds.join(_numbered(spark, least), "q").where("bound >= least").select("m").distinct().collect()]
    far = index.blocks.where(F.col("m").isin(sorted(wanted))).select(*everything)
    late = _visit(far, spark.sparkContext.broadcast((vocabulary, plan, False, least)), shared, k)
    ranked = early.unionByName(late).withColumn("rank", place).where(F.col("rank") <= k)
    names = _numbered(spark, np.arange(len(rows))).drop("least").collect()
    named = spark.createDataFrame([(int(r.q), rows[r.q][0]) for r in names], f"q long, `{key}` {dict(asked.dtypes)[key]}")
    return written(ranked.join(named, "q").select(key, "rank", "doc_id", "score"))


def _numbered(spark, least: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(q, int(v)) for q, v in enumerate(least.tolist())], "q long, least long")


def _visit(blocks: DataFrame, plan, shared, k: int) -> DataFrame:
    """q, doc_id, score: per task the k best of every query among the blocks it visits.

    ``plan`` has the terms, the queries of the first visit by stratum, whether this is it, and the thresholds.
    """

    def run(batches):
        start, term, times, gain = shared.value
        vocabulary, early, is_first, least = plan.value
        asked_for, least = pa.array(vocabulary, pa.binary()), np.maximum(least, 1)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def opened(b):
            """The block's terms among those asked for: their places, gains by run, and every query's bound."""
            at = pc.index_in(b["terms"], value_set=asked_for)
            here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            v = at.to_numpy(zero_copy_only=False)[here].astype(np.int64)
            first = np.concatenate(([0], np.cumsum(b["runs"].to_numpy())))
            tf = b["run_tf"].to_numpy()
            values, which = np.unique(tf, return_inverse=True)
            by_run = impact(values, b["m"])[which]  # once per frequency
            own = np.zeros(len(gain), np.int64)
            own[v] = gain[v] * by_run[first[here]]
            queries = np.arange(len(start) - 1)
            planned = early.get(b["m"], np.zeros(0, np.int64))
            queries = planned if is_first else np.setdiff1d(queries, planned, assume_unique=True)
            return v, here, first, by_run, _bounds(start, term, times, own), queries

        for batch in batches:
            held = [(b, opened(b)) for b in _lists(batch, ["m", "docs", "terms", "runs", "run_tf", "run_n", "places"])]
            held.sort(key=lambda x: -int(x[1][4].max(initial=0)))
            for b, (v, here, first, by_run, bounds, queries) in held:
                queries = queries[bounds[queries] >= least[queries]]
                if not len(queries):
                    continue
                places, run_n = b["places"].to_numpy(), b["run_n"].to_numpy()
                upto = np.concatenate(([0], np.cumsum(run_n)))
                slots = np.full(len(gain), -1, np.int64)
                slots[v] = np.arange(len(v))
                lo, hi = upto[first[here]], upto[first[here + 1]]
                unknown = b["docs"].is_null().to_numpy(zero_copy_only=False)
                docs = b["docs"].fill_null(LAST).to_numpy()
                scored: dict[int, np.ndarray] = {}
                for q in queries.tolist():
                    score = np.zeros(len(docs), np.int64)
                    for t, n in zip(term[start[q] : start[q + 1]].tolist(), times[start[q] : start[q + 1]].tolist(), strict=True):
                        s = slots[t]
                        if s < 0 or not gain[t]:
                            continue
                        if t not in scored:
                            runs = slice(first[here[s]], first[here[s] + 1])
                            scored[t] = np.repeat(gain[t] * by_run[runs], run_n[runs])
                        score[places[lo[s] : hi[s]]] += scored[t] if n == 1 else n * scored[t]
                    good = np.flatnonzero(score >= least[q])
                    if not len(good):
                        continue
                    old = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
                    new = [np.concatenate(x) for x in zip(old, (score[good], docs[good], unknown[good]), strict=True)]
                    order = np.lexsort((new[1], new[2], -new[0]))[:k]
                    best[q] = tuple(x[order] for x in new)
                    if len(order) == k:
                        least[q] = max(least[q], best[q][0][-1])
        for q, (score, doc, unknown) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), q)), pa.array(doc, mask=unknown), pa.array(score)], ["q", "doc_id", "score"])

    return blocks.mapInArrow(run, "q long, doc_id long, score long")
