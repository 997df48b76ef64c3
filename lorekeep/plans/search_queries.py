"""Queries over the index, the searches and the retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import evaluate as EV
from lorekeep.operators import federation as FE
from lorekeep.operators import graph as G
from lorekeep.operators import index as I
from lorekeep.operators import search as S
from lorekeep.operators import skew
from lorekeep.operators import temporal as TM
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans.registry import query
from lorekeep.session import checkpoint, written


def _plain_docs(spark, folder):
    return A.notes(spark, folder).select(F.col("note_id").alias("doc_id"), T.plain_text().alias("text"))


def _text_docs(spark, folder):
    return A.table(spark, folder, "documents").select("doc_id", "text")


def doc_chain(spark, folder):
    """Each document points to the next one of its source; a change of language is untyped."""
    notes = A.notes(spark, folder).select("doc_id", "source", "title", F.col("tags")[0].alias("lang"))
    linked = skew.running(
        notes.withColumn("v", F.struct("title", "lang")), ["source"], skew.order_bucket(notes, ["doc_id"]),
        [F.asc("doc_id")], lead={"__next": "v"},
    ).select("title", "lang", F.col("__next")["title"].alias("target"), F.col("__next")["lang"].alias("next_lang"))
    return linked.where("target is not null and target <> title").select(
        F.col("title").alias("source"),
        F.when(F.col("lang") == F.col("next_lang"), "part-of").otherwise("related").alias("type"), "target",
    ).distinct()


@query("A1", "A2", sql=f"""WITH {O.field_rows()}, c AS (SELECT count(*) AS n FROM notes)
    SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS total_tf, sum(dl)::BIGINT AS total_dl,
           round(ln(1 + (any_value(c.n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
    FROM post JOIN dls USING (field, note_id), c GROUP BY field, term""")
def postings(spark, folder):
    notes = A.notes(spark, folder)
    rows = I.build_postings(S.spread(notes, "note_id"))
    n = notes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"), F.sum("dl").cast("bigint").alias("total_dl")
    ).withColumn("idf", F.round(I.idf(F.col("df"), n), 6))


@query("A1", sql=f"WITH {O.field_rows()} SELECT * FROM dls")
def doc_lengths(spark, folder):
    return I.doc_stats(A.notes(spark, folder)).withColumn("dl", F.col("dl").cast("bigint"))


@query("A1", sql=f"WITH {O.field_rows()} SELECT field, n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, folder):
    return I.corpus_stats(A.notes(spark, folder)).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query("J1", sql=f"""WITH {O.QUESTIONS}, {O.field_rows()},
    q AS (SELECT DISTINCT query_id, unnest({O.tokens('text')}) AS term FROM questions)
    SELECT query_id, note_id, count(*) AS terms, sum(tf)::BIGINT AS tf FROM q JOIN post USING (term)
    WHERE field = 'haystack' GROUP BY ALL""")
def match_postings(spark, folder):
    wanted = S.query_field_terms(A.questions(spark, folder)).where("field = 'haystack'")
    rows = I.build_postings(S.spread(A.notes(spark, folder), "note_id"))
    return S.match_postings(wanted, rows).groupBy("query_id", "note_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf")
    )


@query("R1", "W1", "W2", "W3", "U1", sql=f"WITH {O.index_search(5)} SELECT query_id, note_id, rank, score FROM hits")
def search_index(spark, folder):
    return S.search_index(A.questions(spark, folder), A.notes(spark, folder), 5)


@query("R2", sql=f"""WITH {O.QUESTIONS}, {O.NOTES}, {O.bm25('notes', 'note_id', O.PLAIN)},
    r AS (SELECT query_id, note_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_id) AS rank FROM b_scores)
    SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 5""")
def bm25_search(spark, folder):
    return S.bm25_search(A.questions(spark, folder), _plain_docs(spark, folder), 5)


_OVERLAP = f"""o_tf AS (SELECT note_id, term, count(*) AS tf FROM (SELECT note_id, unnest({O.tokens(O.PLAIN)}) AS term FROM notes) GROUP BY ALL),
    o_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({O.tokens('text')}) AS term FROM questions) GROUP BY ALL),
    o_r AS (SELECT query_id, note_id, sum(tf * qtf)::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf * qtf) DESC, note_id) AS rank
        FROM o_q JOIN o_tf USING (term) GROUP BY query_id, note_id)"""


@query("R3", sql=f"WITH {O.QUESTIONS}, {O.NOTES}, {_OVERLAP} SELECT query_id, note_id AS doc_id, rank, score FROM o_r WHERE rank <= 5")
def term_overlap_search(spark, folder):
    return S.term_overlap_search(A.questions(spark, folder), _plain_docs(spark, folder), 5)


@query("R4", "J7", "U1", sql=f"""WITH {O.QUESTIONS}, {O.NOTES}, {_OVERLAP}, {O.bm25('notes', 'note_id', O.PLAIN)},
    r AS (SELECT query_id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_id) AS rank FROM b_scores),
    sides AS (
        SELECT query_id, title, max(score::DOUBLE) AS score, 'g' AS side FROM o_r JOIN notes USING (note_id) WHERE rank <= 10 GROUP BY ALL
        UNION ALL SELECT query_id, title, max(score), 'b' FROM r JOIN notes USING (note_id) WHERE rank <= 10 GROUP BY ALL),
    mixed AS (SELECT query_id, title, sum(score / top) AS score FROM
        (SELECT *, max(score) OVER (PARTITION BY query_id, side) AS top FROM sides) GROUP BY ALL),
    boosted AS (SELECT query_id, title, score + CASE WHEN {O.exact_name('q.text', 'title')} THEN 0.5 ELSE 0 END AS sc FROM mixed JOIN questions q USING (query_id))
    SELECT query_id, title, rank, round(sc, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, title DESC) AS rank FROM boosted) WHERE rank <= 5""")
def rerank(spark, folder):
    questions, notes = A.questions(spark, folder), A.notes(spark, folder)
    docs = _plain_docs(spark, folder)
    names = notes.select(F.col("note_id").alias("doc_id"), "title")
    titled = lambda scores, n: (
        S.topk(scores, ["query_id"], [S.best("score"), F.asc("doc_id")], n)
        .join(names, "doc_id").groupBy("query_id", "title").agg(F.max("score").cast("double").alias("score"))
    )
    graph_hits = titled(S.term_overlap_search(questions, docs, 10).drop("rank"), 10)
    bm25_hits = titled(S.bm25_scores(questions, docs), 10)
    candidates = graph_hits.select("query_id", "title").unionByName(bm25_hits.select("query_id", "title")).distinct()
    candidates = candidates.withColumn("aliases", F.expr("cast(array() as array<string>)"))
    return S.rerank(questions, graph_hits, bm25_hits, candidates, 5)


_FOUND = f"WITH {O.product_search(5)} SELECT query_id, rank, title, summary FROM found"


@query("R5", "J7", sql=_FOUND)
def search_notes(spark, folder):
    return S.search_notes(A.questions(spark, folder), A.notes(spark, folder), 5)


@query("R6", sql=_FOUND)
def batch_search(spark, folder):
    return S.batch_search(A.questions(spark, folder), A.notes(spark, folder), 5)


_WIDER = """questions AS (SELECT b.item_id AS query_id,
    trim(b.text || ' ' || coalesce(n.text, '')) AS text FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1)"""


@query("R11", sql=f"WITH {O.product_search(5, _WIDER)} SELECT query_id, rank, title, summary FROM found")
def smart_search(spark, folder):
    """Every passage expanded with the next passage; the last one has no expansion."""
    items = A.questions(spark, folder)
    keys = S.dedup_queries(items).select((F.col("query_id") + 1).alias("query_id"), "cache_key")
    expansions = items.join(keys, "query_id").select("cache_key", F.lit(0).alias("pass"), F.col("text").alias("expansion"))
    return S.smart_search(items, expansions, A.notes(spark, folder), 5)


def _hop_sql(limit, seed_limit, typed_only=False, typed_first=True, name="hop"):
    where = "WHERE type <> 'related'" if typed_only else ""
    flag = "(type = 'related')::INT" if typed_first else "0"
    return f"""
    {name}_seeds AS (SELECT query_id, title, min(rank) AS rank FROM hits JOIN notes USING (note_id) WHERE rank <= {seed_limit} GROUP BY ALL),
    {name}_links AS (SELECT lower(trim(source)) AS a, target AS title, {flag} AS loose, source AS s, type AS ty, target AS t FROM chain {where}
        UNION ALL SELECT lower(trim(target)), source, {flag}, source, type, target FROM chain {where}),
    {name}_new AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY rank, loose, s, ty, t, title) AS ord FROM (
        SELECT e.query_id, l.title, e.rank, l.loose, l.s, l.ty, l.t, row_number() OVER (PARTITION BY e.query_id, l.title ORDER BY e.rank, l.loose, l.s, l.ty, l.t) AS first
        FROM {name}_seeds e JOIN {name}_links l ON lower(trim(e.title)) = l.a
        WHERE NOT EXISTS (SELECT 1 FROM {name}_seeds x WHERE x.query_id = e.query_id AND x.title = l.title)) WHERE first = 1),
    {name} AS (SELECT * FROM (SELECT query_id, title, route, row_number() OVER (PARTITION BY query_id ORDER BY h, ord) AS position FROM (
        SELECT query_id, title, 0 AS h, rank AS ord, 'index' AS route FROM {name}_seeds
        UNION ALL SELECT query_id, title, 1, ord, 'graph' FROM {name}_new)) WHERE position <= {limit})"""


def _seeds(spark, folder, limit):
    notes = A.notes(spark, folder)
    hits = S.search_index(A.questions(spark, folder), notes, limit).join(notes.select("note_id", "title"), "note_id")
    return skew.first(hits.select("query_id", "title", "rank"), ["query_id", "title"], ["rank"])


@query("R7", sql=f"WITH {O.index_search(3)}, {O.CHAIN}, {_hop_sql(8, 3)} SELECT query_id, title, position, route FROM hop")
def expand_one_hop(spark, folder):
    return S.expand_one_hop(_seeds(spark, folder, 3), doc_chain(spark, folder), 8)


@query("R8", "W6", sql=f"""WITH {O.index_search(5)}, {O.CHAIN}, {_hop_sql(5, 5)},
    texts AS (SELECT title, arg_min(text, note_id) AS content FROM notes GROUP BY title),
    it AS (SELECT query_id, title, route, content, {O.estimate('content')} AS cost, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank
           FROM hop JOIN texts USING (title)),
    run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM it)
    SELECT query_id, rank, title, route, cost::BIGINT AS cost,
           sha256(CASE WHEN rank = 1 AND cost > 1500 THEN left(content, 6000) ELSE content END) AS content_hash
    FROM run WHERE used <= 1500 OR (rank = 1 AND cost > 1500)""")
def context_bundle(spark, folder):
    notes = A.notes(spark, folder)
    texts = notes.groupBy("title").agg(F.min_by("retrieval_text", "note_id").alias("content"))
    bundle = S.context_bundle(A.questions(spark, folder), notes, doc_chain(spark, folder), texts, 5, 1500)
    return bundle.select("query_id", "rank", "title", "route", "cost", T.content_hash("content").alias("content_hash"))


@query("W6", sql=f"""WITH c AS (SELECT source, doc_id, {O.estimate('text')} AS cost, text,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
    r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY rank) AS used FROM c)
    SELECT source, doc_id, cost::BIGINT AS cost, length(CASE WHEN rank = 1 AND cost > 6000 THEN left(text, 24000) ELSE text END)::BIGINT AS kept
    FROM r WHERE used <= 6000 OR (rank = 1 AND cost > 6000)""")
def fit_to_budget(spark, folder):
    """Every source as one context in document order; a source may hold a third of the rows."""
    docs = A.table(spark, folder, "documents").select("source", "doc_id", "text")
    docs = skew.running(docs, ["source"], skew.order_bucket(docs, ["doc_id"]), [F.asc("doc_id")], number="rank")
    return S.fit_to_budget(docs, 6000, "source", "rank", "text").select(
        "source", "doc_id", "cost", F.length("text").cast("bigint").alias("kept")
    )


@query("R12", sql="""WITH q AS (SELECT label AS query_id, i, avg(x) AS x FROM (
        SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    qn AS (SELECT query_id, sqrt(sum(x * x)) AS qn FROM q GROUP BY ALL),
    v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i FROM embeddings),
    vn AS (SELECT vec_id, sqrt(sum(y * y)) AS vn FROM v GROUP BY ALL),
    s AS (SELECT query_id, vec_id, sum(x * y) / any_value(qn) / any_value(vn) AS s FROM q JOIN v USING (i) JOIN qn USING (query_id) JOIN vn USING (vec_id) GROUP BY query_id, vec_id)
    SELECT query_id, vec_id, rank, round(s, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_search(spark, folder):
    return S.dense_search(A.label_prototypes(spark, folder), A.vectors(spark, folder), 10)


_OKAPI_TOKENS = lambda e: f"regexp_extract_all(lower({e}), '[a-z0-9]+')"


@query("R13", sql=f"""WITH {O.QUESTIONS},
    l AS (SELECT doc_id, len({_OKAPI_TOKENS('text')}) AS dl FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_OKAPI_TOKENS('text')}) AS term FROM documents) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
    w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_OKAPI_TOKENS('text')}) AS term FROM questions) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN l USING (doc_id), st GROUP BY ALL)
    SELECT query_id, doc_id, rank, round(score, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def okapi_search(spark, folder):
    return S.bm25_okapi(A.questions(spark, folder), _text_docs(spark, folder), 5)


@query("R14", sql=f"""WITH {O.QUESTIONS}, q AS (SELECT query_id, w, count(*) AS qtf FROM (SELECT query_id, unnest({O.words('lower(text)')}) AS w FROM questions) GROUP BY ALL),
    u AS (SELECT DISTINCT w FROM q),
    c AS (SELECT w, doc_id, ((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)) AS n FROM u, documents),
    s AS (SELECT query_id, doc_id, sum(n * qtf)::BIGINT AS score FROM q JOIN c USING (w) GROUP BY ALL)
    SELECT query_id, doc_id, rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def substring_search(spark, folder):
    return S.substring_count_search(A.questions(spark, folder), _text_docs(spark, folder), 5)


def _numbered_titles(spark, folder):
    """The titles with numbers in their order, and with these numbers for titles: query_id, title, score
    (normalised BM25 per title), and the chain of documents. Texts are not moved with the scores."""
    notes = A.notes(spark, folder).select(F.col("note_id").alias("doc_id"), "title")
    names = written(notes.select("title").distinct().orderBy("title").select(F.monotonically_increasing_id().alias("n"), "title"))
    scores = S.bm25_scores(A.questions(spark, folder), _plain_docs(spark, folder))
    named = scores.join(notes.join(names.hint("merge"), "title").select("doc_id", F.col("n").alias("title")), "doc_id")
    best = written(named.groupBy("query_id", "title").agg(F.max("score").alias("score")))
    ends = [names.select(F.col("title").alias(c), F.col("n").alias(f"n_{c}")).hint("merge") for c in ("source", "target")]
    chain = doc_chain(spark, folder).join(ends[0], "source").join(ends[1], "target")
    chain = written(chain.select(F.col("n_source").alias("source"), "type", F.col("n_target").alias("target")))
    return names, S.channel_normalize(best, ["query_id"], stored=True), chain


_TITLE_SCORES = f"""{O.QUESTIONS}, {O.NOTES}, {O.bm25('notes', 'note_id', O.PLAIN)},
    tb AS (SELECT query_id, title, max(score) AS score FROM b_scores JOIN notes USING (note_id) GROUP BY ALL),
    ts0 AS (SELECT query_id, title, score / max(score) OVER (PARTITION BY query_id) AS score FROM tb), {O.CHAIN},
    both_ways AS (SELECT source, target, type FROM chain UNION ALL SELECT target, source, type FROM chain)"""


def _top_titles(scores, names, k=5):
    top = S.topk(scores, ["query_id"], [S.best("score"), F.asc("title")], k).withColumnRenamed("title", "n")
    return names.join(written(top), "n").select("query_id", "title", "rank", F.round("score", 4).alias("score"))


_TOP = """SELECT query_id, title, rank, round(score, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank FROM fin) WHERE rank <= 5"""


@query("R15", sql=f"""WITH {_TITLE_SCORES},
    fin AS (SELECT query_id, title, sum(score) AS score FROM (
        SELECT * FROM ts0 UNION ALL
        SELECT query_id, target, 0.4 * max(score) FROM ts0 JOIN both_ways ON title = source GROUP BY ALL) GROUP BY ALL) {_TOP}""")
def propagate_scores(spark, folder):
    names, scores, chain = _numbered_titles(spark, folder)
    return _top_titles(S.propagate_scores(scores, chain, 0.4, 5), names)


@query("R16", sql=f"""WITH {_TITLE_SCORES},
    hit AS (SELECT query_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS r FROM ts0) WHERE r <= 10),
    fin AS (SELECT query_id, title, sum(score) AS score FROM (
        SELECT * FROM hit UNION ALL
        SELECT query_id, target, 0.5 * sum(score) FROM hit JOIN (SELECT DISTINCT source, target FROM both_ways) ON title = source
        GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL) {_TOP}""")
def triangulate(spark, folder):
    names, scores, chain = _numbered_titles(spark, folder)
    return _top_titles(S.triangulate(scores, chain, 10, 0.5, 2), names)


@query("R17", sql=f"""WITH {O.QUESTIONS}, {O.NOTES}, {O.grams('questions', 'query_id', 'text', 'qg')}, {O.grams('notes', 'note_id', 'title', 'ng')},
    qn AS (SELECT query_id, count(*) AS qn FROM qg GROUP BY ALL), nn AS (SELECT note_id, count(*) AS dn FROM ng GROUP BY ALL),
    s AS (SELECT query_id, note_id, 2 * count(*) / (any_value(qn) + any_value(dn)) AS score FROM qg JOIN ng USING (gram)
          JOIN qn USING (query_id) JOIN nn USING (note_id) GROUP BY query_id, note_id)
    SELECT query_id, note_id, rank, round(score, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_id) AS rank FROM s) WHERE rank <= 5""")
def dice_titles(spark, folder):
    scores = S.dice_titles(A.questions(spark, folder), A.notes(spark, folder))
    return S.topk(scores, ["query_id"], [S.best("score"), F.asc("note_id")], 5).select(
        "query_id", "note_id", "rank", F.round("score", 4).alias("score")
    )


# ---- judgments -------------------------------------------------------------------------------


def _qrels(spark, folder):
    # few rows, read several times by every evaluation: kept in the checkpoint folder
    found = EV.verbatim_matches(_text_docs(spark, folder), A.questions(spark, folder))
    return checkpoint(found.withColumn("grade", F.lit(1)))


@query("J17", sql=f"WITH {O.QRELS} SELECT * FROM qrels")
def verbatim_matches(spark, folder):
    return _qrels(spark, folder).select("query_id", "doc_id")


@query("J17", sql=f"WITH {O.QRELS} SELECT item_id AS query_id FROM benchmark SEMI JOIN qrels ON item_id = query_id")
def judged_queries(spark, folder):
    return EV.judged_queries(A.questions(spark, folder), _qrels(spark, folder)).select("query_id")


_RUN = f"""{O.QUESTIONS}, {O.QRELS}, {O.bm25('documents', 'doc_id', 'text')},
    run AS (SELECT query_id, doc_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b_scores) WHERE rank <= 5),
    cat AS (SELECT query_id, arg_min(lang, doc_id) AS category FROM qrels JOIN documents USING (doc_id) GROUP BY query_id),
    m AS (SELECT q.query_id, coalesce(c.category, '') AS category, coalesce(g.n, 0) AS relevant, coalesce(r.n, 0) AS retrieved, coalesce(x.n, 0) AS matched, x.first
        FROM questions q LEFT JOIN cat c USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY ALL) g USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM run GROUP BY ALL) r USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n, min(rank) AS first FROM run JOIN qrels USING (query_id, doc_id) GROUP BY ALL) x USING (query_id)),
    per AS (SELECT query_id, category, relevant = 0 AS negative, relevant = 0 AND retrieved = 0 AS negative_pass,
        CASE WHEN relevant > 0 AND matched > 0 THEN 1 ELSE 0 END AS hit,
        CASE WHEN relevant > 0 THEN matched / relevant ELSE 0 END AS recall,
        CASE WHEN relevant > 0 AND retrieved > 0 THEN matched / retrieved ELSE 0 END AS precision,
        CASE WHEN relevant > 0 THEN coalesce(1 / first, 0) ELSE 0 END AS reciprocal_rank FROM m)"""
_MEANS = """count(*) AS n, round(avg(recall), 4) AS recall_at_k, round(avg(precision), 4) AS precision_at_k,
    round(avg(reciprocal_rank), 4) AS mrr, round(avg(hit), 4) AS hit_rate"""


def _cases(spark, folder, qrels):
    langs = A.table(spark, folder, "documents").select("doc_id", "lang")
    category = qrels.join(langs, "doc_id").groupBy("query_id").agg(F.min_by("lang", "doc_id").alias("category"))
    return A.questions(spark, folder).select("query_id").join(category, "query_id", "left").na.fill({"category": ""})


def _results(spark, folder):
    qrels = _qrels(spark, folder)
    run = S.bm25_search(A.questions(spark, folder), _text_docs(spark, folder), 5)
    return EV.per_query(_cases(spark, folder, qrels), run, qrels, 5)


@query("A9", "W11", sql=f"""WITH {_RUN} SELECT query_id, category, negative, negative_pass, hit, round(recall, 4) AS recall,
    round(precision, 4) AS precision, round(reciprocal_rank, 4) AS reciprocal_rank FROM per""")
def case_metrics(spark, folder):
    rows = _results(spark, folder)
    return rows.select(
        "query_id", "category", "negative", "negative_pass", "hit",
        *[F.round(c, 4).alias(c) for c in ("recall", "precision", "reciprocal_rank")],
    )


def _null_of_none(rows, n, *means):
    """The means of no case at all are null, as in SQL."""
    return rows.withColumns({c: F.when(F.col(n) > 0, F.col(c)) for c in means})


_MEAN_NAMES = ("recall_at_k", "precision_at_k", "mrr", "hit_rate")


@query("A9", sql=f"WITH {_RUN} SELECT {_MEANS} FROM per WHERE NOT negative")
def retrieval_metrics(spark, folder):
    return _null_of_none(EV.retrieval_metrics(_results(spark, folder)), "n", *_MEAN_NAMES)


@query("A10", sql=f"""WITH {_RUN} SELECT category, {_MEANS}, 0 AS overall FROM per WHERE NOT negative AND category <> '' GROUP BY category
    UNION ALL SELECT NULL, {_MEANS}, 1 FROM per WHERE NOT negative""")
def category_metrics(spark, folder):
    rows = EV.metrics_by_category(_results(spark, folder)).withColumn("overall", F.col("overall").cast("int"))
    return _null_of_none(rows, "n", *_MEAN_NAMES)


@query("A11", sql=f"""WITH {_RUN} SELECT count(*) AS n_negative, round(avg(negative_pass::INT), 4) AS negative_rejection FROM per WHERE negative""")
def negative_rejection(spark, folder):
    return _null_of_none(EV.negative_rejection(_results(spark, folder)), "n_negative", "negative_rejection")


@query("A12", sql=f"""WITH {_RUN}, gains AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM run JOIN qrels USING (query_id, doc_id) GROUP BY ALL),
    ideal AS (SELECT query_id, sum(1 / log2(b + 1)) AS idcg FROM (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS b FROM qrels) WHERE b <= 5 GROUP BY ALL)
    SELECT query_id, round(coalesce(dcg / idcg, 0), 4) AS ndcg FROM questions LEFT JOIN gains USING (query_id) LEFT JOIN ideal USING (query_id)""")
def ndcg(spark, folder):
    questions = A.questions(spark, folder)
    run = S.bm25_search(questions, _text_docs(spark, folder), 5)
    return EV.ndcg(questions, run, _qrels(spark, folder), 5).select("query_id", F.round("ndcg", 4).alias("ndcg"))


@query("A13", sql="""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(avg(value) FILTER (i IN ((n - 1) // 2, n // 2)), 2) AS p50,
      round(max(value) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)), 2) AS p95,
      round(max(value) FILTER (i = n // 2), 2) AS upper_p50, any_value(n) AS n_samples FROM s GROUP BY event_type""")
def latency_percentiles(spark, folder):
    return EV.latency_percentiles(A.table(spark, folder, "events"), ["event_type"], "value")


@query("W13", sql="""WITH c AS (SELECT printf('%s-%07d', lang, doc_id) AS case_id, lang AS category FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY case_id) AS rn FROM c)
    SELECT case_id, category, rn FROM r ORDER BY rn, category LIMIT 50""")
def query_sample(spark, folder):
    cases = A.table(spark, folder, "documents").select(F.format_string("%s-%07d", "lang", "doc_id").alias("case_id"))
    return EV.query_sample(cases, 50)


@query("A35", sql=f"""WITH {_RUN}, w AS (SELECT query_id, min(doc_id) AS wanted FROM qrels GROUP BY ALL)
    SELECT count(*) AS n, round(avg((EXISTS (SELECT 1 FROM run r WHERE r.query_id = w.query_id AND r.doc_id = w.wanted))::INT), 4) AS hit_rate FROM w""")
def agent_memory_hits(spark, folder):
    qrels = _qrels(spark, folder)
    cases = qrels.groupBy(F.col("query_id").alias("case_id")).agg(F.min("doc_id").alias("wanted"))
    run = S.bm25_search(A.questions(spark, folder), _text_docs(spark, folder), 5)
    hits = run.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("item"), "rank")
    return EV.agent_memory_hits(cases, hits, 5)


# ---- Fixed values: function words after stemming, excluded from content terms -----------------
FUNCTION_WORDS = tuple(
    (
        "come cosa cos qual quale quali quando dove perche chi che con per tra fra una uno della "
        "dello delle degli nella nelle sono stato fare faccio puo posso voglio devo meglio piu "
        "meno molto poco tutto ogni questo quello senza dopo prima anche ancora gia mai sempre "
        "what when where which who why how does did doe can could should would want need make "
        "get use using used keep keeps there their them they this that these those with without "
        "from into onto about have has had will shall other another same different"
    ).split()
)
# ----------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_COVER = f"""{O.QUESTIONS}, {O.QRELS}, n AS (SELECT count(*) AS n FROM documents),
    qt AS (SELECT DISTINCT query_id, unnest({O.tokens('text')}) AS term FROM questions),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({O.tokens('text')}) AS term FROM documents) GROUP BY term),
    c AS (SELECT query_id, count(*) AS content, count(*) FILTER (coalesce(df, 0) > 0) AS known FROM qt LEFT JOIN df USING (term), n
          WHERE term NOT IN ({_STOP}) AND coalesce(df, 0) < 0.3::DOUBLE * n GROUP BY query_id),
    cov AS (SELECT q.query_id, round(coalesce(known / content, 1.0), 3) AS coverage,
            NOT EXISTS (SELECT 1 FROM qrels r WHERE r.query_id = q.query_id) AS negative FROM questions q LEFT JOIN c USING (query_id))"""


def _coverage(spark, folder):
    judged = _qrels(spark, folder).select("query_id").distinct().withColumn("ok", F.lit(1))
    cases = A.questions(spark, folder).join(judged, "query_id", "left").withColumn("negative", F.col("ok").isNull())
    docs = _text_docs(spark, folder)
    return EV.rejection_coverage(cases.drop("ok"), docs, FUNCTION_WORDS)


@query("R19", "U5", sql=f"WITH {_COVER} SELECT query_id, coverage, negative FROM cov")
def rejection_coverage(spark, folder):
    return _coverage(spark, folder).select("query_id", "coverage", "negative")


@query("R19", sql=f"""WITH {_COVER} SELECT tau, count(*) FILTER (negative) AS negatives, count(*) FILTER (negative AND coverage < tau) AS neg_rejected,
    count(*) FILTER (NOT negative AND coverage < tau) AS false_rejects
    FROM cov, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS tau) GROUP BY tau""")
def rejection_sweep(spark, folder):
    return EV.rejection_sweep(_coverage(spark, folder))


_SYSTEMS = f"""{_RUN}, {_OVERLAP.replace('notes', 'documents').replace(O.PLAIN, 'text').replace('note_id', 'doc_id')},
    runs AS (SELECT 'bm25' AS system, * FROM run UNION ALL
        SELECT 'overlap', query_id, doc_id, rank FROM o_r WHERE rank <= 5),
    judged AS (SELECT DISTINCT query_id FROM qrels),
    ideal AS (SELECT query_id, count(*) AS relevant, sum(1 / log2(b + 1)) FILTER (b <= 5) AS idcg FROM (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS b FROM qrels) GROUP BY ALL),
    got AS (SELECT system, query_id, count(*) AS matched, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg
        FROM runs JOIN qrels USING (query_id, doc_id) GROUP BY ALL)"""


@query("R20", "X1", sql=f"""WITH {_SYSTEMS} SELECT s.system, round(avg(coalesce(matched / relevant, 0)), 4) AS recall_at_k,
    round(avg(coalesce(1 / first, 0)), 4) AS mrr, round(avg((coalesce(matched, 0) > 0)::INT), 4) AS hit_rate,
    round(avg(coalesce(dcg / idcg, 0)), 4) AS ndcg, count(*) AS n_queries
    FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN judged j JOIN ideal i USING (query_id)
    LEFT JOIN got g ON g.system = s.system AND g.query_id = j.query_id GROUP BY s.system""")
def shootout(spark, folder):
    questions, docs = A.questions(spark, folder), _text_docs(spark, folder)
    runs = EV.run_systems({"bm25": S.bm25_search, "overlap": S.term_overlap_search}, questions, docs, 5)
    return EV.shootout(runs, questions, _qrels(spark, folder), 5)


_VARIANTS = {"hits-only": (5, 99, {}), "three-and-hop": (5, 3, {}), "three-and-typed": (5, 3, {"typed_only": True}),
             "three-and-flat": (5, 3, {"typed_first": False}), "four-and-hop": (5, 4, {})}


def _variant_sql():
    parts, unions = [], []
    for i, (name, (limit, seeds, knobs)) in enumerate(_VARIANTS.items()):
        parts.append(_hop_sql(limit, min(seeds, limit), name=f"v{i}", **knobs))
        rows = f"SELECT '{name}' AS variant, query_id, title, position AS rank FROM v{i}"
        unions.append(rows if seeds < 99 else rows + " WHERE route = 'index'")
    return f"""WITH {O.index_search(5)}, {O.CHAIN}, {O.QRELS}, {', '.join(parts)},
    runs AS ({' UNION ALL '.join(unions)}),
    gold AS (SELECT DISTINCT query_id, {O.key('title')} AS k FROM qrels JOIN notes USING (doc_id)),
    ng AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY ALL),
    got AS (SELECT variant, r.query_id, count(*) AS retrieved, count(DISTINCT g.k) AS matched, min(rank) FILTER (g.k IS NOT NULL) AS first
        FROM runs r LEFT JOIN gold g ON g.query_id = r.query_id AND g.k = {O.key('r.title')} GROUP BY ALL),
    per AS (SELECT s.variant, n.query_id, coalesce(matched, 0) / relevant AS recall, coalesce(matched / nullif(retrieved, 0), 0) AS precision,
        coalesce(1 / first, 0) AS reciprocal_rank, (coalesce(matched, 0) > 0)::INT AS hit
        FROM (SELECT DISTINCT variant FROM runs) s CROSS JOIN ng n LEFT JOIN got g ON g.variant = s.variant AND g.query_id = n.query_id)
    SELECT variant, {_MEANS} FROM per GROUP BY variant"""


@query("R18", sql=_variant_sql())
def variant_grid(spark, folder):
    """Five ways to fill a context of five: hits only, or fewer hits plus their neighbours."""
    chain, notes = doc_chain(spark, folder), A.notes(spark, folder)
    five = checkpoint(_seeds(spark, folder, 5))
    runs = None
    for name, (limit, seeds, knobs) in _VARIANTS.items():
        few = five.where(F.col("rank") <= min(seeds, limit))
        if seeds >= 99:
            run = few.withColumn("rank", F.row_number().over(_by_rank()))
        else:
            run = S.expand_one_hop(few, chain, limit, **knobs).withColumnRenamed("position", "rank")
        run = run.select(F.lit(name).alias("variant"), "query_id", "title", "rank")
        runs = run if runs is None else runs.unionByName(run)
    gold = _qrels(spark, folder).join(notes.select("doc_id", "title"), "doc_id").select("query_id", "title")
    return EV.variant_report(runs, A.questions(spark, folder).select("query_id"), gold, 5)


def _by_rank():
    from pyspark.sql import Window

    # at most five seeds per query
    return Window.partitionBy("query_id").orderBy("rank")


# ---- collections -----------------------------------------------------------------------------


def collection_notes(spark, folder):
    return A.notes(spark, folder).withColumn("collection_id", F.col("source"))


_FED = f"""{O.NOTES}, {O.COLLECTIONS}, rows AS (SELECT n.*, source || '::' || note_id AS row_id, c.sensitive
    FROM notes n JOIN collections c ON c.collection_id = n.source WHERE federated)"""


@query("J21", sql=f"WITH {_FED} SELECT row_id, source AS collection_id, sensitive FROM rows")
def federated_rows(spark, folder):
    rows = FE.federate(collection_notes(spark, folder), A.collections(spark, folder))["rows"]
    return rows.select("row_id", "collection_id", "sensitive")


@query("J21", "F4", sql=f"""WITH {_FED} SELECT collection_id, CASE WHEN federated THEN (SELECT count(*) FROM notes WHERE source = collection_id) ELSE 0 END AS notes,
    CASE WHEN federated THEN '' ELSE 'not federated' END AS skipped FROM collections""")
def federation_report(spark, folder):
    report = FE.federate(collection_notes(spark, folder), A.collections(spark, folder))["report"]
    return report.select("collection_id", "notes", "skipped")


@query("A21", sql=f"WITH {_FED} SELECT source AS collection, count(*) AS rows FROM rows GROUP BY source UNION ALL SELECT NULL, count(*) FROM rows")
def federation_status(spark, folder):
    return FE.federation_status(FE.federate(collection_notes(spark, folder), A.collections(spark, folder))["rows"])


_FED_SEARCH = f"""{O.QUESTIONS}, {_FED}, {O.bm25('rows', 'row_id', O.PLAIN.replace('lang||', "lang||' '||"))},
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS r FROM b_scores) WHERE r <= 24),
    kept AS (SELECT query_id, row_id, r, score * CASE WHEN source = 'src1' THEN 1.25 ELSE 1 END AS score FROM pool JOIN rows USING (row_id) WHERE NOT sensitive),
    fed AS (SELECT query_id, row_id, rank, round(score, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank FROM kept) WHERE rank <= 8)"""


@query("R9", "F4", sql=f"WITH {_FED_SEARCH} SELECT * FROM fed")
def federated_search(spark, folder):
    rows = FE.federate(collection_notes(spark, folder), A.collections(spark, folder))["rows"]
    return FE.federated_search(A.questions(spark, folder), rows, 8, boosted=["src1"])


@query("R10", "J18")
def scoped_search(spark, folder):
    """Scope ``all`` from the project src1 with src0 as central collection."""
    return FE.scoped_search(
        A.questions(spark, folder), collection_notes(spark, folder), A.collections(spark, folder), "src1", "src0", "all", 5
    )


@query("J6", "R5", sql=f"""WITH {O.product_search(5)},
    ids AS (SELECT {O.key('title')} AS k, min(note_id) AS note_id FROM notes GROUP BY ALL),
    h AS (SELECT query_id, rank, title, i.note_id FROM found JOIN ids i ON i.k = {O.key('title')}),
    v AS (SELECT note_id, updated_at + to_hours(s * 24) AS updated_at, s::INT AS seq, s || '|' || summary AS summary FROM notes, range(3) t(s)),
    seen AS (SELECT note_id, max(updated_at) AS updated_at, arg_max(summary, updated_at) AS summary FROM v WHERE updated_at <= TIMESTAMP '2024-01-02 08:00:00' GROUP BY note_id)
    SELECT query_id, rank, title, note_id, updated_at, summary AS summary_then FROM h JOIN seen USING (note_id)""")
def search_as_of(spark, folder):
    """Three daily versions of every note, seen at one instant."""
    notes = A.notes(spark, folder)
    days = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq")
    versions = notes.select("note_id", "updated_at", "summary", days).select(
        "note_id", F.timestamp_micros(F.unix_micros("updated_at") + F.col("seq") * 86400000000).alias("updated_at"), "seq",
        F.concat(F.col("seq").cast("string"), F.lit("|"), F.col("summary")).alias("summary"),
    )
    instant = F.lit("2024-01-02 08:00:00").cast("timestamp")
    return TM.search_as_of(A.questions(spark, folder), notes, versions, instant, 5)


@query("G6", "J2", sql=f"""WITH {O.NOTES}, links AS (SELECT title, unnest([lower(title), '  ' || upper(split_part(title, ' ', 1)), title || '!']) AS target FROM notes),
    reg AS (SELECT {O.key('title')} AS k, arg_max(title, note_id) AS t FROM notes GROUP BY ALL)
    SELECT CASE WHEN t IS NULL THEN 'unresolved' WHEN t = title THEN 'self' ELSE 'resolved' END AS status, count(*) AS n
    FROM links LEFT JOIN reg ON k = {O.key('target')} GROUP BY 1""")
def link_resolution(spark, folder):
    notes = A.notes(spark, folder)
    target = F.explode(F.array(F.lower("title"), F.concat(F.lit("  "), T.upper(F.substring_index("title", " ", 1))), F.concat("title", F.lit("!"))))
    return G.link_resolution_report(notes.select("note_id", "title", target.alias("target")), G.name_registry(notes))


@query("J16", sql=f"""WITH {O.NOTES.replace('notes AS', 'notes0 AS')},
    notes AS (SELECT * FROM notes0),
    {O.index_search(4, "questions AS (SELECT 100000000 + item_id AS query_id, split_part(text, chr(10), 1) || ' ' || text AS text FROM benchmark)").replace(O.NOTES + ',', '')},
    asked AS (SELECT 100000000 + item_id AS query_id, split_part(text, chr(10), 1) AS new_title FROM benchmark),
    fit AS (SELECT h.query_id, rank, note_id, title, new_title FROM hits h JOIN asked USING (query_id) JOIN notes USING (note_id)
        WHERE list_has_any({O.tokens('new_title')}, {O.tokens('title')}))
    SELECT query_id::VARCHAR AS new_id, arg_min(new_title, rank) AS new_title, arg_min(note_id, rank) AS old_id, arg_min(title, rank) AS old_title FROM fit GROUP BY query_id""")
def supersedes_candidates(spark, folder):
    """Benchmark passages as incoming notes next to the documents."""
    from lorekeep.operators.prompts import supersedes_candidates as candidates

    new = A.questions(spark, folder).select(
        (F.col("query_id") + 100000000).cast("string").alias("note_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
    )
    return candidates(new, A.notes(spark, folder))
