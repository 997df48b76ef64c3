"""The registered queries of the operators and their check SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import (
    chat, checks, decontaminate, langid, mainhtml, mixing, pq, quality, ranked, runs, simhash, tokens, toxicity, urls,
)
from lorekeep.llm.common import remainder, sample_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_sample(
    spark: SparkSession, folder: str, label: str, fold=None, size: int = 12_000, docs: DataFrame | None = None
) -> DataFrame:
    """Whole texts of at most ``size`` labelled documents, those whose ids hash lowest; text, label.

    Documents stay where they are: the ids of the sample, bounded by ``size``, are broadcast. A
    document with contradicting labels is left out.
    """
    labels = table(spark, folder, "labels").select("doc_id", F.col(label).alias("label"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    labels = labels.where("label = most").drop("most")
    if fold is not None:
        labels = labels.where(fold)
    ids = sample_of(labels, "doc_id", size)
    docs = table(spark, folder, "documents") if docs is None else docs
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").drop("doc_id")


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 5)
    model = langid.train(docs.where(fold != 0))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(labelled_sample(spark, folder, "toxic", remainder("doc_id", 3) != 1))
    fold = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id",
        fold.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
        F.get("offending", F.lit(0))["begin"].alias("first_begin"),
        F.get("offending", F.lit(0))["end"].alias("first_end"),
    )


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of whole texts whose SimHash differs in at most 2 bits."""
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links of cosine 0.98 and more between vectors of one label."""
    return pq.near_vectors(table(spark, folder, "embeddings"))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every (document, benchmark item) of a similar window, with the best window."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query
def op5_main_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = mainhtml.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn so that half of all tokens meets tempered source, language and topic marginals."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "drawn")


ORACLE["op2_mixing"] = checks.mixing_sql()


@query
def op8_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every dialogue from every participant's side."""
    shown = chat.perspectives(table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ",")
    return shown.withColumn("mask", spans).select("conv_id", "speaker", "part", "offset", "rendered", "mask", "n_turns", "n_own")


ORACLE["op8_perspectives"] = checks.PERSPECTIVES


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight of every whole text, and the resampled 85 percent."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sample = labelled_sample(spark, folder, "quality")
    return quality.resample(docs, sample.where("label = 1").select("text"))


#: The rules of the query: host and path, the longest that fits wins.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged by the rules, else by trust and distrust of its host."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return urls.judge(pages, urls.rule_rows(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op11_url_filter"] = checks.url_sql(RULES)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, repeated with a period from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every whole text, the longest one, and digests of all runs and of the text without repeats."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = runs.periodic_runs(docs, change=planted)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.select("doc_id", "runs", "collapsed", best.alias("b"), F.array_join(F.transform(told, lambda t: F.concat(t, F.lit("\n"))), "").alias("told"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.n").alias("length"),
        (-F.col("b.q")).alias("period"),
        F.expr("b.n * 1000 div -b.q").alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    index = ranked.build(table(spark, folder, "documents").select("doc_id", "text"))
    return ranked.search(index, table(spark, folder, "benchmark").select("item_id", "text"))


ORACLE["op13_ranked_search"] = checks.RANKED
