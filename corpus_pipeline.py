"""The corpus pipeline: stages over ``documents``, each by one of the operators of ``lorekeep.llm``.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``;
the last adds topic, n_tokens and probability to the documents it draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, langid, mixing, simhash, toxicity
from lorekeep.llm.common import written
from lorekeep.llm.queries import labelled_sample
from lorekeep.session import tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others carry the recognised one as lang."""
    judged = langid.predict(docs, langid.train(docs))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: score 0.7 and more."""
    model = toxicity.train(labelled_sample(spark, sf_dir, "toxic", docs=docs))
    return toxicity.score(docs, model).where(F.col("score") < 0.7).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash within 2 bits, or 5-word shingles 0.8 similar."""
    return simhash.representatives(docs, near=0.8).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.matches(docs, items).where(F.size("matches") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix, with their topic, tokens and probability."""
    return mixing.mix(docs).where("drawn").drop("drawn")


def tuned(stage):
    """A stage under the session settings of the queries; those bound the batches that Python holds."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", tuned(language)),
    ("toxicity", tuned(clean)),
    ("simhash_near_dedup", tuned(distinct)),
    ("decontamination", tuned(uncontaminated)),
    ("mixing", tuned(mixed)),
]

#: Trained models and fingerprints are beyond SQL; the stages are tested against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
