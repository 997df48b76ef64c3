"""Queries that write the given tables in the stored forms and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.operators import index as I
from lorekeep.operators import search as S
from lorekeep.operators import skew
from lorekeep.operators import temporal as TM
from lorekeep.operators.blocks import postings_of
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans.registry import ORACLE, query
from lorekeep.session import shared_folder
from lorekeep.sources import readers, writers


def _place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/store/{uuid.uuid4().hex}"


def _as_notes(df: DataFrame) -> DataFrame:
    """``df`` with every note column, missing ones null."""
    empty = df.sparkSession.createDataFrame([], SC.NOTES).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])


@query("SC1", "A22", sql=f"WITH {O.NOTES} SELECT note_id, title, summary, confidence, updated_at FROM notes")
def stored_notes(spark, folder):
    """Notes written as a table and read with the defaults of missing fields."""
    place = _place(spark)
    _as_notes(A.notes(spark, folder, labelled=True)).write.parquet(place)
    return readers.read_notes(spark, place, "parquet").select("note_id", "title", "summary", "confidence", "updated_at")


@query("SC2", "W8", sql=f"""WITH {O.VERSIONS} SELECT note_id, updated_at, row_number() OVER w AS version, lead(updated_at) OVER w AS replaced_at
    FROM versions WINDOW w AS (PARTITION BY note_id ORDER BY updated_at, seq)""")
def stored_history(spark, folder):
    """Old versions in an append-only log, the last one in the library; numbered from both."""
    place = _place(spark)
    every = A.versions(spark, folder)
    last = skew.latest(every, ["note_id"], ["updated_at", "seq"])
    old = every.join(last.select("note_id", "seq"), ["note_id", "seq"], "left_anti")
    log = old.repartition("note_id").sortWithinPartitions("updated_at", "seq").drop("seq")
    _as_notes(log).drop("body_sections").write.json(place)
    read = readers.read_history(spark, place, _as_notes(last.drop("seq")))
    return TM.version_numbers(read).select(F.col("note_id").cast("bigint").alias("note_id"), "updated_at", "version", "replaced_at")


@query("SC3", "W4", sql=f"WITH {O.CLAIMS} SELECT claim_id, note_id, text, valid_from, valid_to FROM claims")
def stored_claims(spark, folder):
    """The claim log as JSON lines; the last record of a claim holds."""
    place = _place(spark)
    log = A.claim_log(spark, folder)
    log.repartition("claim_id").sortWithinPartitions("seq").drop("seq").write.json(place)
    state = TM.latest_state(readers.read_claim_log(spark, place), ["claim_id"], ["seq"])
    number = lambda c: F.col(c).cast("bigint").alias(c)
    return state.select(number("claim_id"), number("note_id"), "text", "valid_from", "valid_to")


@query("SK1", "A2", sql=ORACLE["postings"])
def stored_postings(spark, folder):
    """The index written as a snapshot; document frequencies from the postings read back."""
    place = _place(spark)
    writers.write_index(S.spread(A.notes(spark, folder), "note_id"), place)
    blocks, corpus = writers.read_index(spark, place)
    rows, n = postings_of(blocks), corpus.select("n").scalar()
    return rows.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"), F.sum("dl").cast("bigint").alias("total_dl")
    ).withColumn("idf", F.round(I.idf(F.col("df"), n), 6))


@query("R1", "R5", "SK1", sql=ORACLE["search_index"])
def stored_search(spark, folder):
    """The search on the written index."""
    place = _place(spark)
    writers.write_index(S.spread(A.notes(spark, folder), "note_id"), place)
    blocks, corpus = writers.read_index(spark, place)
    return S.search_index(A.questions(spark, folder), limit=5, blocks=blocks, corpus=corpus)


@query("R6", "SK1", sql=ORACLE["batch_search"])
def stored_batch_search(spark, folder):
    """The product search on the written index."""
    place = _place(spark)
    notes = A.notes(spark, folder)
    writers.write_index(S.spread(notes, "note_id"), place)
    return S.search_notes(A.questions(spark, folder), notes, 5, *writers.read_index(spark, place))
