"""Judgments and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import search as S
from lorekeep.operators import skew
from lorekeep.session import fan_out, written

_ANCHOR_WORDS = 3


def _shingles(words: str):
    """The hashes of the runs of three neighbouring words of a word-list column."""
    last = F.size(words) - _ANCHOR_WORDS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(_ANCHOR_WORDS)]))


def verbatim_matches(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id for every document whose text holds the passage verbatim.

    Whole words inside a passage are whole words of any text that holds it. Texts are keyed by the hashes of
    their runs of three words, a passage by the smallest of its inner runs; passages of fewer than five words are
    keyed by their first character. Keys only name candidates, which are compared in full where the texts lie;
    no pair is missed.
    """
    docs = fan_out(docs)
    worded = passages.select("query_id", F.col("text").alias("passage"), T.words("text").alias("w"))
    long = F.size("w") >= _ANCHOR_WORDS + 2
    inner = worded.where(long).withColumn("w", F.slice("w", 2, F.size("w") - 2))
    first = F.xxhash64(F.substring("passage", 1, 1))
    # outer explodes: no filter on the computed lists is derived below the fan-out
    runs = docs.select("doc_id", T.words("text").alias("w")).select("doc_id", F.explode_outer(F.array_distinct(_shingles("w"))).alias("key"))
    letters = docs.select("doc_id", F.explode_outer(F.array_distinct(F.split("text", ""))).alias("c")).select("doc_id", F.xxhash64("c").alias("key"))
    pairs = None
    for own, key, have in ((inner, F.array_min(_shingles("w")), runs), (worded.where(~long), first, letters)):
        keyed = written(own.select("query_id", "passage", key.alias("key")))
        if keyed.isEmpty():
            continue
        met = have.join(keyed, "key").select("query_id", "doc_id", "passage").distinct()
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        none = F.lit(None).cast(passages.schema["query_id"].dataType).alias("query_id")
        return docs.limit(0).select(none, "doc_id")
    # a written table has a known size: few candidates go to the texts, not the texts to them
    held = docs.select("doc_id", "text").join(written(pairs), "doc_id")
    return held.where(F.contains("text", F.col("passage"))).select("query_id", "doc_id")


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Only the queries that have a judgment."""
    return queries.join(qrels.where("grade > 0").select("query_id"), "query_id", "left_semi")


def per_query(cases: DataFrame, run: DataFrame, qrels: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """One row per case: hit, recall, precision, reciprocal rank, refused.

    ``run`` is (query_id, item, rank). String items compare trimmed and lower-cased. A case
    without judgments is negative; it passes when nothing was retrieved.
    """
    text_items = dict(run.dtypes)[item] == "string"
    norm = T.key(item) if text_items else F.col(item)
    top = run.where(F.col("rank") <= k).select("query_id", norm.alias("item"), "rank")
    gold = qrels.select("query_id", norm.alias("item")).distinct()
    found = top.join(gold.withColumn("ok", F.lit(1)), ["query_id", "item"], "left")
    counts = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_distinct(F.when(F.col("ok") == 1, F.col("item"))).alias("matched"),
        F.min(F.when(F.col("ok") == 1, F.col("rank"))).alias("first"),
    )
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    rows = cases.join(counts, "query_id", "left").join(wanted, "query_id", "left")
    zero = F.lit(0.0)
    negative = F.coalesce("relevant", F.lit(0)) == 0
    none = F.coalesce("retrieved", F.lit(0)) == 0
    return rows.select(
        *cases.columns,
        negative.alias("negative"),
        (negative & none).alias("negative_pass"),
        F.when(negative, F.lit(0)).otherwise((F.coalesce("matched", F.lit(0)) > 0).cast("int")).alias("hit"),
        F.coalesce(F.when(~negative, F.col("matched") / F.col("relevant")), zero).alias("recall"),
        F.coalesce(F.when(~negative & ~none, F.col("matched") / F.col("retrieved")), zero).alias("precision"),
        F.coalesce(F.when(~negative, 1 / F.col("first")), zero).alias("reciprocal_rank"),
    )


def _means():
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(~F.col("negative"), F.col(c).cast("double"))), F.lit(0.0)), 4)  # noqa: E731,E501
    return [
        F.count(F.when(~F.col("negative"), 1)).alias("n"),
        mean("recall").alias("recall_at_k"),
        mean("precision").alias("precision_at_k"),
        mean("reciprocal_rank").alias("mrr"),
        mean("hit").alias("hit_rate"),
    ]


def retrieval_metrics(results: DataFrame) -> DataFrame:
    """One row over the answerable cases."""
    return results.agg(*_means())


def metrics_by_category(results: DataFrame) -> DataFrame:
    """A row per non-empty category and one over all (category NULL), from one grouping-sets pass."""
    rows = results.where("not negative")
    return (
        rows.groupingSets([["category"], []], "category")
        .agg(*_means(), F.grouping("category").alias("overall"))
        .where("overall = 1 or category <> ''")
    )


def negative_rejection(results: DataFrame) -> DataFrame:
    """n_negative and the share of them with nothing retrieved."""
    return results.agg(
        F.count(F.when(F.col("negative"), 1)).alias("n_negative"),
        F.round(
            F.coalesce(F.avg(F.when(F.col("negative"), F.col("negative_pass").cast("double"))), F.lit(0.0)), 4
        ).alias("negative_rejection"),
    )


def ndcg(cases: DataFrame, run: DataFrame, qrels: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """query_id, ndcg with graded gains; 0 without judgments."""
    gain = lambda rank: F.col("grade").cast("double") / F.log2(F.col(rank).cast("double") + 1)
    got = (
        run.where(F.col("rank") <= k)
        .join(qrels, ["query_id", item])
        .groupBy("query_id")
        .agg(F.sum(gain("rank")).alias("dcg"))
    )
    ideal = (
        S.topk(qrels, ["query_id"], [F.desc("grade"), F.asc(item)], k, "best")
        .groupBy("query_id")
        .agg(F.sum(gain("best")).alias("idcg"))
    )
    joined = cases.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    value = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)
    return joined.select("query_id", value.alias("ndcg"))


def latency_percentiles(samples: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """p50 (median), p95 (element at round(0.95 (n-1)), half to even) and the upper median.

    percentile_disc would not pick these elements; exact ranks come from value counts per key,
    so equal samples are combined before any sort.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    # a running sum over distinct values, in two levels
    summed = skew.running(
        counts, keys, skew.order_bucket(counts, [value, *keys]), [F.col(value)], sums={"upto": F.col("c")}
    )
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    rows = summed.join(totals, keys)
    holds = lambda pos: (F.col("upto") - F.col("c") <= pos) & (pos < F.col("upto"))
    pick = lambda pos: F.max(F.when(holds(pos), F.col(value)))
    n = F.col("n")
    p95 = F.bround(F.lit(0.95) * (n - 1), 0)
    return rows.groupBy(*keys).agg(
        F.round((pick(F.floor((n - 1) / 2)) + pick(F.floor(n / 2))) / 2, 2).alias("p50"),
        F.round(pick(p95), 2).alias("p95"),
        F.round(pick(F.floor(n / 2)), 2).alias("upper_p50"),
        F.max("n").alias("n_samples"),
    )


def run_systems(systems: dict, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """system, query_id, doc_id, rank of plug-in retrievers.

    A retriever is a callable (queries, docs, k) -> DataFrame with query_id, doc_id and rank.
    """
    runs = [
        retriever(queries, docs, k).select(F.lit(name).alias("system"), "query_id", "doc_id", "rank")
        for name, retriever in systems.items()
    ]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def shootout(runs: DataFrame, cases: DataFrame, qrels: DataFrame, k: int, latencies: DataFrame | None = None) -> DataFrame:
    """One row per system: recall, MRR, hit, nDCG and, if given, p50 latency.

    ``runs`` is (system, query_id, doc_id, rank). Means run over the judged queries.
    """
    runs = written(runs)  # read twice below
    systems = runs.select("system").distinct()
    judged = judged_queries(cases, qrels).select("query_id")
    gold = qrels.where("grade > 0")
    wanted = gold.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"),
    )
    ideal = (
        S.topk(qrels, ["query_id"], [F.desc("grade"), F.asc("doc_id")], k, "best")
        .groupBy("query_id")
        .agg(F.sum(F.col("grade") / F.log2(F.col("best").cast("double") + 1)).alias("idcg"))
    )
    found = (
        runs.where(F.col("rank") <= k)
        .join(gold.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"])
        .groupBy("system", "query_id")
        .agg(
            F.count(F.lit(1)).alias("matched"),
            F.min("rank").alias("first"),
            F.sum(F.col("grade") / F.log2(F.col("rank").cast("double") + 1)).alias("dcg"),
        )
    )
    # each system answers every judged query; the number of systems is small and known per row
    names = systems.select(F.collect_set("system").alias("s")).scalar()
    grid = judged.select("query_id", F.explode(names).alias("system"))
    rows = (
        grid.join(found, ["system", "query_id"], "left")
        .join(wanted, "query_id", "left")
        .join(ideal, "query_id", "left")
    )
    zero = F.lit(0.0)
    out = rows.groupBy("system").agg(
        F.round(F.avg(F.coalesce(F.col("matched") / F.col("relevant"), zero)), 4).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), zero)), 4).alias("mrr"),
        F.round(F.avg((F.coalesce("matched", F.lit(0)) > 0).cast("double")), 4).alias("hit_rate"),
        F.round(F.avg(F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), zero)), 4).alias("ndcg"),
        F.count(F.lit(1)).alias("n_queries"),
    )
    if latencies is None:
        return out
    p50 = latency_percentiles(latencies, ["system"]).select("system", F.col("upper_p50").alias("p50_ms"))
    return out.join(p50, "system", "left")


def query_sample(cases: DataFrame, n: int, stratified: bool = True) -> DataFrame:
    """The first n by id, or round-robin over the categories (the id without its number)."""
    if not stratified:
        return cases.orderBy("case_id").limit(n)
    category = F.regexp_replace("case_id", r"-[^-]*$", "")
    window = Window.partitionBy("category").orderBy("case_id")
    # at most n per category can be taken, so the cut is pushed below the shuffle
    ranked = (
        cases.withColumn("category", category)
        .withColumn("rn", F.row_number().over(window))
        .where(F.col("rn") <= n)
    )
    return ranked.orderBy("rn", "category").limit(n)


def answer_quality(answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of context hit, faithfulness and correctness (1 / 0.5 / 0) and refusal on negatives."""
    grade = F.when(F.col("correctness") == "correct", 1.0).when(F.col("correctness") == "partial", 0.5).otherwise(0.0)
    asked = ~F.col("negative")
    mean = lambda c: F.round(F.avg(F.when(asked, c)), 3)
    return answers.groupBy(*(keys or [])).agg(
        mean(F.col("context_hit").cast("double")).alias("context_hit"),
        mean(F.col("grounded").cast("double")).alias("faithfulness"),
        mean(grade).alias("correctness"),
        F.round(F.avg(F.when(~asked, T.is_refusal("answer").cast("double"))), 3).alias("refusal_accuracy"),
    )


def judge_agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Share of equal verdicts over the pairs both judges saw."""
    both = left.select(*keys, F.col("verdict").alias("a")).join(
        right.select(*keys, F.col("verdict").alias("b")), keys
    )
    share = F.avg((F.col("a") == F.col("b")).cast("double"))
    return both.agg(F.round(F.coalesce(share, F.lit(0.0)), 3).alias("agreement"), F.count(F.lit(1)).alias("n"))


def accuracy_by_type(answers: DataFrame) -> DataFrame:
    """Accuracy over the judged cases per question type and overall (type NULL)."""
    judged = F.col("verdict").isNotNull()
    return answers.rollup("question_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(judged, 1)).alias("judged"),
        F.round(F.avg(F.when(judged, (F.col("verdict") == "correct").cast("double"))), 4).alias("accuracy"),
        F.round(F.avg(F.contains(F.lower("answer"), F.lower("reference")).cast("double")), 4).alias("exact_contains"),
    )


def hallucination_rate(verdicts: DataFrame) -> DataFrame:
    """1 - grounded / judged over (grounded boolean or NULL)."""
    return verdicts.agg(
        F.count("grounded").alias("judged"),
        F.round(1 - F.avg(F.col("grounded").cast("double")), 3).alias("hallucination_rate"),
    )


def agent_memory_hits(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Share of cases whose wanted key is among the first k hits."""
    got = hits.where(F.col("rank") <= k).select("case_id", F.col("item").alias("wanted"))
    ok = cases.join(got.distinct().withColumn("ok", F.lit(1)), ["case_id", "wanted"], "left")
    return ok.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce("ok", F.lit(0)).cast("double")), 4).alias("hit_rate"),
    )


def rejection_coverage(
    cases: DataFrame, docs: DataFrame, function_words: tuple[str, ...], ubiquity: float = 0.3,
    token_column=T.tokens,
) -> DataFrame:
    """query_id, coverage: share of the content terms of a query known to the collection."""
    from lorekeep.operators.search import _scalar_row

    terms = cases.select("query_id", F.explode(F.array_distinct(token_column("text"))).alias("term"))
    terms = terms.where(~F.col("term").isin(*function_words))
    vocabulary = terms.select("term").distinct()
    df = (
        docs.select(F.explode(F.array_distinct(token_column("text"))).alias("term"))
        .join(vocabulary, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    n = _scalar_row(docs.agg(F.count(F.lit(1)).alias("n")))["n"]
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    content = known.where(F.col("df") < F.lit(ubiquity) * F.greatest(n, F.lit(1)))
    per = content.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("content"), F.count(F.when(F.col("df") > 0, 1)).alias("known")
    )
    return cases.join(per, "query_id", "left").select(
        *cases.columns,
        F.round(F.coalesce(F.col("known") / F.col("content"), F.lit(1.0)), 3).alias("coverage"),
    )


def rejection_sweep(coverage: DataFrame, taus: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """tau, negatives, negatives rejected, answerable queries rejected."""
    # six fixed thresholds, held in the row instead of joined
    rows = coverage.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    low = F.col("coverage") < F.col("tau")
    return rows.groupBy("tau").agg(
        F.count(F.when(F.col("negative"), 1)).alias("negatives"),
        F.count(F.when(F.col("negative") & low, 1)).alias("neg_rejected"),
        F.count(F.when(~F.col("negative") & low, 1)).alias("false_rejects"),
    )


def score_freshness(answers: DataFrame, change_words: tuple[str, ...]) -> DataFrame:
    """Flags per answer: the new fact is there, only the old one is, the change is named."""
    low = F.lower("answer")
    new, old = F.contains(low, F.col("v2_marker")), F.contains(low, F.col("v1_marker"))
    says = F.lit(False)
    for word in change_words:
        says = says | low.contains(word)
    return answers.withColumns(
        {
            "current_hit": new,
            "stale": old & ~new,
            "change_noted": new & (old | says),
        }
    )


def freshness_report(scored: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3).alias(c)
    return scored.groupBy("linked").agg(
        F.count(F.lit(1)).alias("n"), mean("current_hit"), mean("stale"), mean("change_noted")
    )


def ontology_lift(cases: DataFrame, qrels: DataFrame, baseline: DataFrame, emergent: DataFrame, k: int, item: str = "title") -> DataFrame:
    """Metrics of two expansion runs side by side, and their difference."""
    one = lambda run, name: retrieval_metrics(per_query(cases, run, qrels, k, item)).select(
        F.lit(name).alias("run"), "recall_at_k", "mrr", "hit_rate"
    )
    both = one(baseline, "baseline").unionByName(one(emergent, "emergent"))
    sign = F.when(F.col("run") == "emergent", 1).otherwise(-1)
    lift = both.agg(
        F.lit("lift").alias("run"),
        *[F.round(F.sum(F.col(c) * sign), 4).alias(c) for c in ("recall_at_k", "mrr", "hit_rate")],
    )
    return both.unionByName(lift)


def variant_report(runs: DataFrame, cases: DataFrame, qrels: DataFrame, k: int, item: str = "title") -> DataFrame:
    """variant, metrics: every variant answers the same cases, in one pass over all runs."""
    names = runs.select(F.collect_set("variant").alias("v")).scalar()
    grid = cases.select(*cases.columns, F.explode(names).alias("variant"))
    keyed = lambda df: df.withColumn("query_id", F.struct("variant", "query_id"))
    gold = qrels.select("query_id", item).withColumn("variant", F.explode(names))
    rows = per_query(
        keyed(grid), keyed(runs.select("variant", "query_id", item, "rank")),
        keyed(gold).select("query_id", item), k, item,
    )
    return rows.groupBy(F.col("query_id")["variant"].alias("variant")).agg(*_means())
