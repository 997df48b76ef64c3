"""Retrieval: many queries over many notes in one job.

The product search reads a block-max index (``operators.blocks``), built on the spot or read from a folder: blocks
that cannot reach a query's best results are skipped, and only results are shuffled. The baselines
partition the documents by note once, as term lists; counting, weighing and adding up per (query,
note) then happen inside the note's partition, because the query side is a written table that Spark
broadcasts when it is small. Titles and texts are joined after the cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.operators import skew
from lorekeep.operators.blocks import build_blocks, search_blocks
from lorekeep.session import fan_out, written

K1 = 1.5
B = 0.75
TRI_TITLE_WEIGHT = 0.7
TRI_SUMMARY_WEIGHT = 0.3
MONOLINGUAL_SCALE = 0.3
LENGTH_PENALTY = 0.5
EXACT_BOOST = 0.5
NEIGHBOUR_COLLECTION_BOOST = 1.25
CONTEXT_BUDGET = 6000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by a unique key with the session's partition count.

    The count is given so that the runtime does not merge partitions by their small input size:
    the work behind them is far bigger than their bytes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key)


def best(score: str) -> Column:
    """Descending by score; differences below 1e-9 are noise of the summing order, so they tie.

    ``rint`` instead of ``round``: the latter goes through decimal text for every row.
    """
    return F.desc(F.rint(F.col(score) * 1e9))


# ---- windows ---------------------------------------------------------------------------------


def topk(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The best k rows per key. Spark cuts to k inside every task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def channel_normalize(scores: DataFrame, keys: list[str], drop_empty: bool = True, stored: bool = False) -> DataFrame:
    """score / max per group; a group whose best is not positive is dropped or kept at 0.

    The maximum is a pre-combined aggregate joined back, never a window over a whole group. Of ``stored`` scores it
    is written first, so that Spark sees how small it is.
    """
    top = scores.groupBy(*keys).agg(F.max("score").alias("__top"))
    top = written(top) if stored else top
    joined = scores.join(top, keys)
    if drop_empty:
        joined = joined.where("__top > 0")
    value = F.when(F.col("__top") > 0, F.col("score") / F.col("__top")).otherwise(0.0)
    return joined.withColumn("score", value).drop("__top")


def length_penalty(scores: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Damp long notes relative to the mean length of the group's candidates."""
    mean = scores.groupBy(*keys).agg(F.avg(length).alias("__mean"))
    mean_col, len_col = F.col("__mean"), F.col(length)
    damped = F.col("score") * mean_col / (mean_col + LENGTH_PENALTY * len_col)
    return (
        scores.join(mean, keys, "left")
        .withColumn(
            "score",
            F.when((mean_col > 0) & len_col.isNotNull(), damped).otherwise(F.col("score")),
        )
        .drop("__mean")
    )


# ---- term matching ---------------------------------------------------------------------------


def query_field_terms(queries: DataFrame) -> DataFrame:
    """query_id, field, term: distinct stems for the lexical field, at most 64 trigrams else."""
    grams = T.query_trigrams("text")
    fields = F.array(
        F.struct(F.lit("haystack").alias("field"), F.array_distinct(T.tokens("text")).alias("t")),
        F.struct(F.lit("tri_title").alias("field"), grams.alias("t")),
        F.struct(F.lit("tri_summary").alias("field"), grams.alias("t")),
    )
    return queries.select("query_id", F.explode(fields).alias("f")).select(
        "query_id", "f.field", F.explode("f.t").alias("term")
    )


def match_postings(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Every posting a query term meets."""
    keys = [c for c in ("field", "term") if c in query_terms.columns]
    return postings.join(query_terms, keys)


def bm25_term(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _scalar_row(df: DataFrame) -> Column:
    return df.select(F.struct(*df.columns)).scalar()


def search_index(
    queries: DataFrame, notes: DataFrame | None = None, limit: int = 5,
    blocks: DataFrame | None = None, corpus: DataFrame | None = None,
) -> DataFrame:
    """query_id, note_id, rank, score: three channels blended, hubs damped, best first.

    Works from notes, or from a written index: its blocks and its one-row corpus table.
    """
    if blocks is None:
        notes = spread(notes, "note_id")
        blocks, corpus = written(build_blocks(notes)), written(I.corpus_row(notes))
    scale = MONOLINGUAL_SCALE if (corpus.select("monolingual").first() or [False])[0] else 1.0
    scales = {"haystack": 1.0, "tri_title": scale * TRI_TITLE_WEIGHT, "tri_summary": scale * TRI_SUMMARY_WEIGHT}
    ranked = search_blocks(queries, blocks, corpus, limit, scales=scales, damping=LENGTH_PENALTY)
    return ranked.select("query_id", "note_id", "rank", F.round("raw_score", 4).alias("score"))


def counted_query_terms(queries: DataFrame, token_column=T.tokens) -> DataFrame:
    """query_id, term, qtf: repeats counted."""
    return (
        queries.select("query_id", F.explode(token_column("text")).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _matched_counts(docs: DataFrame, vocabulary: DataFrame, token_column=T.tokens) -> DataFrame:
    """doc_id, dl, term, tf for the terms of the vocabulary, written and spread by document.

    A word is stemmed once for all documents, not wherever it occurs, and only counts are shuffled, no texts. The outer
    explode keeps the word lists from being computed twice below it; the joins drop the rows it adds.
    """
    split, stem = (T.raw_tokens, T.stem) if token_column is T.tokens else (token_column, lambda word: word)
    placed = fan_out(docs.select("doc_id", "text")).select("doc_id", split("text").alias("words"))
    rows = placed.select("doc_id", F.size("words").alias("dl"), F.explode_outer("words").alias("word"))
    # written before they are stemmed, else a filter on the stem would go below the distinct
    words = written(rows.select("word").distinct())
    stems = written(words.select("word", stem(F.col("word")).alias("term")).join(vocabulary, "term", "left_semi"))
    counts = rows.join(stems, "word").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return spread(written(counts), "doc_id")


def bm25_scores(
    queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, token_column=T.tokens
) -> DataFrame:
    """query_id, doc_id, score over one text field; repeated query terms count again."""
    terms = counted_query_terms(queries, token_column)
    counts = _matched_counts(docs, written(terms.select("term").distinct()), token_column)
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(_length(token_column)).alias("avgdl"))
    stats = _scalar_row(written(sizes))  # read by two jobs
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").select(
        "query_id", "term", (F.col("qtf") * I.idf(F.col("df"), stats["n"])).alias("w")
    )
    gain = F.col("w") * bm25_term(F.col("tf"), F.col("dl"), stats["avgdl"], k1, b)
    weighed = counts.join(written(weights), "term")
    return weighed.groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))


def _length(token_column) -> Column:
    # the length needs no stemming
    return T.count_tokens("text") if token_column is T.tokens else F.size(token_column("text"))


def bm25_search(
    queries: DataFrame, docs: DataFrame, limit: int = 5, k1: float = K1, b: float = B
) -> DataFrame:
    """query_id, doc_id, rank, score: single-channel BM25, ties by document id."""
    hits = bm25_scores(queries, docs, k1, b).where("score > 0")
    return topk(hits, ["query_id"], [best("score"), F.asc("doc_id")], limit).select(
        "query_id", "doc_id", "rank", F.round("score", 4).alias("score")
    )


def plain_words(text: str | Column) -> Column:
    value = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), 0)


def bm25_okapi(queries: DataFrame, docs: DataFrame, limit: int = 5, epsilon: float = 0.25) -> DataFrame:
    """The Okapi baseline: idf = ln(n - df + .5) - ln(df + .5), and a floor for common terms.

    A negative idf is replaced by epsilon times the mean idf of the whole vocabulary.
    """
    terms = counted_query_terms(queries, plain_words)
    docs = spread(docs, "doc_id")
    placed = docs.select("doc_id", plain_words("text").alias("terms"))
    rows = placed.select("doc_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
    rows = rows.where("term is not null")
    counts = rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = _scalar_row(
        docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(plain_words("text"))).alias("avgdl"))
    )
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(stats["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = _scalar_row(df.select(raw.alias("idf")).agg(F.avg("idf").alias("mean")))["mean"]
    floor = F.when(raw < 0, mean_idf * epsilon).otherwise(raw)
    weights = terms.join(df, "term").select("query_id", "term", (F.col("qtf") * floor).alias("w"))
    gain = F.col("w") * bm25_term(F.col("tf"), F.col("dl"), stats["avgdl"])
    weighed = counts.join(written(weights), "term")
    hits = weighed.groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))
    return topk(
        hits.where("score > 0"), ["query_id"], [best("score"), F.asc("doc_id")], limit
    ).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def term_overlap_search(queries: DataFrame, docs: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, doc_id, rank, score: document count times query count, no idf."""
    terms = counted_query_terms(queries)
    counts = _matched_counts(docs, written(terms.select("term").distinct()), T.tokens)
    hits = (
        counts.join(written(terms), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("tf") * F.col("qtf")).alias("score"))
    )
    return topk(hits, ["query_id"], [best("score"), F.asc("doc_id")], limit)


def substring_count_search(queries: DataFrame, docs: DataFrame, limit: int = 5, chars: int = 200_000) -> DataFrame:
    """query_id, doc_id, rank, score: occurrences of every query word inside the lower text.

    Documents are read where they are, by queries in blocks of about ``chars`` characters that every task holds;
    a task sends home its best of each query. Rows that share a doc_id are one document: their words are
    joined with the queries' as a table. Overlapping occurrences count once, as in a left-to-right scan.
    """
    words = (
        queries.select("query_id", F.explode(T.words(F.lower("text"))).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    again = written(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    several = not again.isEmpty()
    once = docs.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left_anti") if several else docs
    once = fan_out(once.select("doc_id", F.make_valid_utf8(F.lower("text")).alias("text")))
    parts = max(1, -(-(queries.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    scored = None
    for number in range(parts):
        own = words.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == number)
        one = _best_by_count(own, once, limit)
        scored = one if scored is None else scored.unionByName(one)
    if several:
        same = docs.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left_semi")
        hits = words_in_text(words.select("word").distinct(), same).join(words, "word")
        scored = scored.unionByName(hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("qtf")).alias("score")))
    return topk(scored, ["query_id"], [best("score"), F.asc("doc_id")], limit)


def _best_by_count(words: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """query_id, doc_id, score: of each task's documents the ``limit`` best of every query of ``words`` (query_id, word, qtf)."""
    rows = words.collect()
    ids = list(dict.fromkeys(r.query_id for r in rows))
    number, place = {}, {q: n for n, q in enumerate(ids)}
    by_word = sorted((number.setdefault(r.word, len(number)), place[r.query_id], r.qtf) for r in rows)
    word, query, qtf = (np.array(x, np.int64) for x in zip(*by_word, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
    held = words.sparkSession.sparkContext.broadcast((ids, number, np.searchsorted(word, np.arange(len(number) + 1)), query, qtf))
    made = StructType.fromDDL(f"query_id {dict(words.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score bigint")
    types = [f.type for f in to_arrow_schema(made)]

    def run(batches):
        ids, number, starts, query, qtf = held.value
        sizes, size = sorted({len(w) for w in number}), len(ids)
        step = max(1, 1_000_000 // max(1, len(query), len(number)))
        top, least = [[] for _ in ids], np.ones(size)
        # pieces are numbered as they are met; piece p holds the words met[ends[p] : ends[p + 1]], so often
        inside, ends, met, often = {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def words_in(pieces):
            """How many words the pieces hold, which, and how often."""
            n, flat = [], []
            for piece in pieces:
                found = {piece[i : i + n] for n in sizes if n <= len(piece) for i in range(len(piece) - n + 1)} & number.keys()
                n.append(len(found))
                flat += [x for w in found for x in (number[w], piece.count(w))]
            return n, np.array(flat, np.int64).reshape(-1, 2)

        def spans(starts, n):
            """The places of spans of n entries, one after the other."""
            return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)

        for batch in batches:
            for at in range(0, len(batch), step):
                docs = batch.column(0).slice(at, step).to_pylist()
                split = [(text or "").split() for text in batch.column(1).slice(at, step).to_pylist()]
                if len(inside) >= 300_000:
                    inside, ends, met, often = {}, ends[:1], met[:0], often[:0]
                fresh = list(dict.fromkeys(p for own in split for p in own if p not in inside))
                if fresh:
                    inside.update(zip(fresh, range(len(inside), len(inside) + len(fresh)), strict=True))
                    n, flat = words_in(fresh)
                    ends = np.concatenate((ends, ends[-1] + np.cumsum(n)))
                    met, often = np.concatenate((met, flat[:, 0])), np.concatenate((often, flat[:, 1]))
                piece = np.fromiter((inside[p] for own in split for p in own), np.int64)
                n = ends[piece + 1] - ends[piece]
                place = spans(ends[piece], n)
                doc = np.repeat(np.repeat(np.arange(len(docs)), list(map(len, split))), n)
                times = np.bincount(doc * len(starts) + met[place], often[place], len(docs) * len(starts))
                pair = np.flatnonzero(times)
                doc, word, times = pair // len(starts), pair % len(starts), times[pair]
                asked = starts[word + 1] - starts[word]
                entry = spans(starts[word], asked)
                score = np.bincount(np.repeat(doc, asked) * size + query[entry], np.repeat(times, asked) * qtf[entry], len(docs) * size)
                score = score.reshape(len(docs), size)
                new = {}
                for d, q in np.argwhere(score >= least).tolist():
                    new.setdefault(q, []).append((-int(score[d, q]), docs[d] is not None, docs[d]))
                for q, more in new.items():
                    top[q] = sorted(top[q] + more)[:limit]
                    if len(top[q]) == limit:
                        least[q] = -top[q][-1][0]
        out = [(ids[q], d, -s) for q, own in enumerate(top) for s, _, d in own]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [(), (), ()], types, strict=True)], made.names)

    return docs.mapInArrow(run, made)


def words_in_text(words: DataFrame, docs: DataFrame) -> DataFrame:
    """word, doc_id, n: non-overlapping occurrences of each word as a substring of the text.

    Words hold no blanks, so an occurrence lies inside one blank-separated piece of the text.
    The join therefore runs over the distinct pieces of the collection, not over the documents:
    each piece offers its substrings of the wanted lengths to an equi-join.
    """
    pieces = (
        docs.select("doc_id", F.explode(T.words(F.lower("text"))).alias("piece"))
        .groupBy("doc_id", "piece")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    lengths = words.select(F.collect_set(F.length("word")).alias("sizes")).scalar()
    usable = F.filter("sizes", lambda size: size <= F.length("piece"))
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                usable,
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.length("piece") - size + 1),
                    lambda i: F.substring(F.col("piece"), i, size),
                ),
            )
        )
    )
    distinct = pieces.select("piece").distinct().withColumn("sizes", lengths)
    found = (
        distinct.select("piece", F.explode(grams).alias("word"))
        .join(words, "word", "left_semi")
        .withColumn("inside", F.size(_literal_split("piece", "word")) - 1)
    )
    return (
        pieces.join(found, "piece")
        .groupBy("word", "doc_id")
        .agg(F.sum(F.col("times") * F.col("inside")).alias("n"))
    )


def _literal_split(text: str, needle: str) -> Column:
    return F.split(F.col(text), F.concat(F.lit(r"\Q"), F.col(needle), F.lit(r"\E")), F.lit(-1))


# ---- reranking -------------------------------------------------------------------------------


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def exact_name(query: Column, title: Column, aliases: Column) -> Column:
    """True when the query holds the title or an alias as a whole word or phrase."""
    names = F.filter(
        F.transform(F.concat(F.array(title), aliases), lambda n: T.key(n)), lambda n: n != ""
    )
    low = F.lower(query)
    return F.exists(
        names, lambda n: F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), _quote(n), F.lit(r"\b")))
    )


def rerank(
    queries: DataFrame, graph_hits: DataFrame | None, bm25_hits: DataFrame | None,
    names: DataFrame, limit: int = 5, graph_weight: float = 1.0, bm25_weight: float = 1.0,
) -> DataFrame:
    """query_id, title, rank, score. Hits are (query_id, title, score), one row per title.

    ``names`` carries (query_id, title, aliases) of the candidates. Ties go to the larger title.
    """
    sides = []
    for hits, weight in ((graph_hits, graph_weight), (bm25_hits, bm25_weight)):
        if hits is not None:
            normal = channel_normalize(hits.select("query_id", "title", "score"), ["query_id"], False)
            sides.append(normal.withColumn("score", F.col("score") * weight))
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side)
    both = both.groupBy("query_id", "title").agg(F.sum("score").alias("score"))
    named = both.join(names, ["query_id", "title"], "left").join(
        queries.select("query_id", F.col("text").alias("__query")), "query_id"
    )
    aliases = F.coalesce("aliases", F.expr("cast(array() as array<string>)"))
    boost = F.when(exact_name(F.col("__query"), F.col("title"), aliases), EXACT_BOOST).otherwise(0.0)
    ranked = topk(
        named.withColumn("score", F.col("score") + boost), ["query_id"],
        [best("score"), F.desc("title")], limit,
    )
    return ranked.select("query_id", "title", "rank", F.round("score", 4).alias("score"))


def search_notes(
    queries: DataFrame, notes: DataFrame, limit: int = 5,
    blocks: DataFrame | None = None, corpus: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, title, summary: the product search, index pool then rerank.

    Notes that share a title answer as one; the lowest-ranked of them lends score and summary.
    """
    pool = search_index(queries, notes, 2 * limit, blocks, corpus)
    # At most 2 * limit rows per query from here on, so windows over a query are small and the
    # search runs once instead of once per self-join.
    known = pool.join(notes.select("note_id", "title", "summary", "aliases"), "note_id")
    known = known.join(queries.select("query_id", F.col("text").alias("__query")), "query_id")
    lowest = Window.partitionBy("query_id", "title").orderBy(F.desc("rank"))
    titles = known.withColumn("__n", F.row_number().over(lowest)).where("__n = 1")
    top = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    boost = F.when(exact_name(F.col("__query"), F.col("title"), F.col("aliases")), EXACT_BOOST)
    scored = titles.withColumn("__share", share).withColumn(
        "score", F.col("__share") + F.coalesce(boost, F.lit(0.0))
    )
    return topk(scored.drop("rank"), ["query_id"], [best("score"), F.desc("title")], limit).select(
        "query_id", "rank", "title", "summary"
    )


def batch_search(queries: DataFrame, notes: DataFrame, limit: int = 5) -> DataFrame:
    """Build and search in one job."""
    return search_notes(queries, notes, limit)


def dedup_queries(questions: DataFrame) -> DataFrame:
    """Questions that are equal after collapsing blanks and lowering share one cached answer."""
    return questions.withColumn("cache_key", F.lower(T.collapse("text")))


def smart_search(
    queries: DataFrame, expansions: DataFrame, notes: DataFrame, limit: int = 5, passes: int = 1
) -> DataFrame:
    """Search with the question plus its expansion; a question without one is searched as is."""
    return search_notes(expand_queries(queries, expansions, passes), notes, limit)


def expand_queries(queries: DataFrame, expansions: DataFrame, passes: int = 1) -> DataFrame:
    """query_id, text. ``expansions`` holds (cache_key, pass, expansion) rows.

    One pass appends the expansion. More passes append each new term once, in pass order; terms
    compare lower-cased.
    """
    keyed = dedup_queries(queries)
    if passes <= 1:
        one = skew.first(expansions, ["cache_key"], ["pass"]).select("cache_key", "expansion")
        joined = keyed.join(one, "cache_key", "left")
        has = F.coalesce(F.col("expansion") != "", F.lit(False))
        text = F.when(has, T.strip(F.concat_ws(" ", "text", "expansion"))).otherwise(F.col("text"))
        return joined.select("query_id", text.alias("text"))
    own = keyed.select("cache_key", F.posexplode(T.words("text")).alias("pos", "word")).distinct()
    own = own.withColumn("pass", F.lit(-1))
    extra = expansions.where(F.col("pass") < passes).select(
        "cache_key", "pass", F.posexplode(T.words("expansion")).alias("pos", "word")
    )
    # every word of the question stays; of the added terms only the first sight of each
    added = skew.first(
        extra.withColumn("low", F.lower("word")), ["cache_key", "low"], ["pass", "pos"]
    ).join(own.select("cache_key", F.lower("word").alias("low")).distinct(), ["cache_key", "low"], "left_anti")
    words = own.select("cache_key", "pass", "pos", "word").unionByName(
        added.select("cache_key", "pass", "pos", "word")
    )
    merged = words.groupBy("cache_key").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pass", "pos", "word"))), lambda s: s["word"]), " "
        ).alias("merged")
    )
    return keyed.join(merged, "cache_key", "left").select(
        "query_id", F.coalesce("merged", "text").alias("text")
    )


# ---- context ---------------------------------------------------------------------------------


def expand_one_hop(
    seeds: DataFrame, edges: DataFrame, limit: int, order: tuple[str, ...] = ("source", "type", "target"),
    typed_only: bool = False, typed_first: bool = True,
) -> DataFrame:
    """query_id, title, position, route: seeds in order, then their unseen neighbours.

    Neighbours come per seed, typed edges before ``related``. A hub's edges are reduced to one
    row per (query, neighbour) before the cut.
    """
    links = edges.where("type <> 'related'") if typed_only else edges
    flag = F.when(F.col("type") == "related", 1).otherwise(0) if typed_first else F.lit(0)
    links = links.select(
        T.key("source").alias("a"), T.key("target").alias("b"), "source", "target",
        flag.alias("loose"), F.struct(*order).alias("seq"),
    )
    out = links.select("a", F.col("target").alias("near"), "loose", "seq")
    back = links.where("a <> b").select(
        F.col("b").alias("a"), F.col("source").alias("near"), "loose", "seq"
    )
    # Each joined row offers the seed and its neighbour; the minimum per title keeps a seed a seed
    # and a neighbour once, so the search behind the seeds runs a single time.
    joined = seeds.select("query_id", "rank", "title", T.key("title").alias("a")).join(
        out.unionByName(back), "a", "left"
    )
    rank = F.col("rank").cast("int")
    own = F.struct(
        F.col("title"), F.lit(0).alias("hop"), rank.alias("rank"), F.lit(0).alias("loose"),
        F.lit(None).cast(links.schema["seq"].dataType).alias("seq"),
    )
    other = F.struct(
        F.col("near").alias("title"), F.lit(1).alias("hop"), rank.alias("rank"), F.col("loose"), F.col("seq")
    )
    best_way = (
        joined.select("query_id", F.explode(F.array(own, other)).alias("x"))
        .where("x.title is not null")
        .groupBy("query_id", F.col("x.title").alias("title"))
        .agg(F.min(F.struct("x.hop", "x.rank", "x.loose", "x.seq")).alias("via"))
    )
    ranked = topk(best_way, ["query_id"], [F.asc("via"), F.asc("title")], limit, "position")
    route = F.when(F.col("via.hop") == 0, "index").otherwise("graph")
    return ranked.select("query_id", "title", "position", route.alias("route"))


def fit_to_budget(
    items: DataFrame, budget: int = CONTEXT_BUDGET, key: str = "query_id", rank: str = "rank",
    content: str = "content",
) -> DataFrame:
    """The longest best-first prefix whose token cost stays within the budget.

    Ranks are dense numbers from 1. If the first item alone is too big, its head is kept.
    """
    if budget <= 0:
        return items.limit(0).withColumn("cost", F.lit(0).cast("bigint"))
    costed = items.withColumn("cost", T.estimate_tokens(content).cast("bigint"))
    # ranks are dense, so a range of them has as many rows
    summed = skew.running(
        costed, [key], F.floor(F.col(rank) / 65536), [F.col(rank)], sums={"__used": F.col("cost")}
    )
    head = (F.col(rank) == 1) & (F.col("cost") > budget)
    return (
        summed.where((F.col("__used") <= budget) | head)
        .withColumn(
            content,
            F.when(head, F.substring(content, 1, budget * 4)).otherwise(F.col(content)),
        )
        .drop("__used")
    )


def context_bundle(
    queries: DataFrame, notes: DataFrame, edges: DataFrame, contents: DataFrame, limit: int = 5,
    budget: int = CONTEXT_BUDGET,
) -> DataFrame:
    """query_id, rank, title, route, content, cost: seeds, one hop, texts, budget.

    ``contents`` is (title, content). Titles without a text leave before the budget is applied.
    """
    seeds = search_index(queries, notes, limit).join(notes.select("note_id", "title"), "note_id")
    titles = skew.first(seeds.select("query_id", "title", "rank"), ["query_id", "title"], ["rank"])
    picked = expand_one_hop(titles, edges, limit).join(contents, "title")
    dense = Window.partitionBy("query_id").orderBy("position")  # at most `limit` rows per query
    items = picked.withColumn("rank", F.row_number().over(dense)).drop("position")
    return fit_to_budget(items, budget)


def _liftable(hits: DataFrame, both: DataFrame, decay: float, k: int) -> DataFrame:
    """query_id, title of all that can be among a query's best ``k`` once hits lend to their neighbours.

    Lending only adds, so the k-th best own score is a bar. A hit clears it with what the best hit could lend at most,
    any other title only through a hit that lends as much alone.
    """
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"))
    best_k = hits.select("query_id", "score").withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= k)
    bar = F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0) - 1e-6
    bars = written(best_k.groupBy("query_id").agg(bar.alias("bar"), F.max("score").alias("most")))
    barred = hits.join(bars, "query_id")
    near = barred.where(F.col("score") + decay * F.col("most") >= F.col("bar")).select("query_id", "title")
    alone = barred.where(decay * F.col("score") >= F.col("bar")).select("query_id", F.col("title").alias("source"))
    lifted = alone.join(both.hint("merge"), "source").select("query_id", F.col("target").alias("title"))
    return near.unionByName(lifted).distinct()


def propagate_scores(hits: DataFrame, edges: DataFrame, decay: float, k: int | None = None) -> DataFrame:
    """query_id, title, score: each hit lends decay * score to its neighbours, best source wins.

    With ``k`` only titles that can be among the best k of a query come back, with their whole scores; scores are then
    zero or more, and ``hits`` is read several times. Tables that grow with the hits are merged, never broadcast: a
    small file of numbers is many times as large on the driver.
    """
    both = edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    )
    own = hits.select("query_id", "title", "score")
    if k is not None:
        both = written(both.distinct())
        few = written(_liftable(own, both, decay, k))
        asked = few.join(both.select(F.col("source").alias("title"), F.col("target").alias("holder")).hint("merge"), "title")
        kept = few.select("query_id", "title", F.col("title").alias("holder"), F.lit(False).alias("lends"))
        wanted = kept.unionByName(asked.withColumn("lends", F.lit(True)))
        met = own.withColumnRenamed("title", "holder").join(wanted.hint("merge"), ["query_id", "holder"])
        summed = met.groupBy("query_id", "title").agg(
            F.sum(F.when(~F.col("lends"), F.col("score"))).alias("own"), (F.max(F.when(F.col("lends"), F.col("score"))) * decay).alias("lent")
        )
        score = F.when(F.col("own").isNull(), F.col("lent")).otherwise(F.col("own") + F.coalesce("lent", F.lit(0.0)))
        return summed.select("query_id", "title", score.alias("score"))
    lent = own.join(both, own.title == both.source).select("query_id", F.col("target").alias("title"), "score")
    spread = lent.groupBy("query_id", "title").agg((F.max("score") * decay).alias("score"))
    return own.unionByName(spread).groupBy("query_id", "title").agg(F.sum("score").alias("score"))


def triangulate(
    scores: DataFrame, edges: DataFrame, base_k: int = 10, boost: float = 0.4, min_converge: int = 2,
    typed_only: bool = False,
) -> DataFrame:
    """query_id, title, score: neighbours that several of the top hits agree on are lifted."""
    links = edges.where("type <> 'related'") if typed_only else edges
    both = links.select("source", "target").unionByName(
        links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    ).distinct()
    hits = topk(scores, ["query_id"], [best("score"), F.asc("title")], base_k).drop("rank")
    votes = (
        hits.join(both, hits.title == both.source)
        .groupBy("query_id", F.col("target").alias("title"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
        .where(F.col("n") >= min_converge)
        .select("query_id", "title", (F.col("total") * boost).alias("score"))
    )
    return (
        hits.select("query_id", "title", "score")
        .unionByName(votes)
        .groupBy("query_id", "title")
        .agg(F.sum("score").alias("score"))
    )


def dice_titles(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """query_id, note_id, score: Dice coefficient of query and title trigram sets."""
    asked = queries.select("query_id", T.trigrams("text").alias("g")).select(
        "query_id", F.size("g").alias("qn"), F.explode("g").alias("gram")
    )
    held = spread(notes.select("note_id", "title", "aliases"), "note_id").select(
        "note_id", T.trigrams(F.concat_ws(" ", "title", F.array_join("aliases", " "))).alias("g")
    ).select("note_id", F.size("g").alias("dn"), F.explode_outer("g").alias("gram"))
    return (
        held.join(asked, "gram")
        .groupBy("query_id", "note_id", "qn", "dn")
        .agg(F.count(F.lit(1)).alias("both"))
        .select("query_id", "note_id", (2 * F.col("both") / (F.col("qn") + F.col("dn"))).alias("score"))
    )


# ---- vectors ---------------------------------------------------------------------------------

QUERY_BLOCK = 2048


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK, tile: int = 512) -> DataFrame:
    """query_id, vec_id, rank, score: exact cosine of every vector with every query.

    ``queries`` is (query_id, vector), ``vectors`` is (vec_id, embedding); nulls are left out, a zero vector
    scores 0. Queries lie in rows of about ``block`` vectors and the vectors in rows of up to ``tile``; every
    tile meets every block of queries in a join, as a matrix product. A task keeps the best k per query, which
    merge in any order, so nothing but those leaves it. Blocks of queries are broadcast if Spark finds them small.
    """
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("x"))
    parts = max(1, -(-asked.count() // block))
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    asked = written(asked.agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list("x")).alias("q")))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]
    held = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), tile):
                part = batch.slice(at, tile)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(0), part.column(1).flatten())]
                yield pa.RecordBatch.from_arrays(lists, ["keys", "x"])

    tiles = held.mapInArrow(pack, f"keys array<{kinds[1]}>, x array<double>")
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(asked, "part")

    def unit(values, n):
        matrix = values.to_numpy(zero_copy_only=False).reshape(n, -1)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norm == 0, 1, norm)

    def score(batches):
        best: dict[int, tuple] = {}
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                keys, x, ids, q = (batch.column(c)[i].values for c in (1, 2, 3, 4))
                if part not in blocks:
                    blocks[part] = unit(q, len(ids))
                found = blocks[part] @ unit(x, len(keys)).T
                order = np.broadcast_to(np.array(keys.to_pylist()), found.shape)
                if part in best:
                    found, order = np.hstack((best[part][1], found)), np.hstack((best[part][2], order))
                first = np.lexsort((order, -np.rint(found * 1e9)))[:, :k]
                best[part] = ids, np.take_along_axis(found, first, 1), np.take_along_axis(order, first, 1)
        for ids, found, order in best.values():
            n = found.shape[1]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array(order.ravel(), types[1]), pa.array(found.ravel())], made.names
            )

    made = StructType.fromDDL(f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    types = [f.type for f in to_arrow_schema(made)]
    hits = tiles.select("part", "keys", "x", "ids", "q").mapInArrow(score, made)
    ranked = topk(hits, ["query_id"], [best("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))
