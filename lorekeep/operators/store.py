"""A knowledge store in numbered versions: several tables change together or not at all.

A version writes the tables that change under its own number and then one manifest, which names for every
table the version that holds it. Readers start from the newest manifest, so a version without one does not exist, and
a commit that failed half-way is replayed by committing the same number again. Files of earlier versions are never
touched: a plan may read them while the next version is written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import ledger as LE
from lorekeep.operators import temporal as TM
from lorekeep.session import written


def read_store(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """The newest version and its tables; -1 and none before the first commit."""
    try:
        rows = spark.read.parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, {}
    number = rows.agg(F.max("version")).first()[0]
    held = rows.where(F.col("version") == F.lit(number)).collect()  # a row per table
    return number, {r.name: spark.read.parquet(f"{folder}/tables/{r.name}/v{r.held}") for r in held}


def commit(spark: SparkSession, folder: str, number: int, tables: dict[str, DataFrame]) -> None:
    """Write ``tables`` as version ``number``; the others stay as the version before has them."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/tables/{name}/v{number}")
    held = {}
    if number > 0:
        before = spark.read.parquet(f"{folder}/manifest").where(F.col("version") == F.lit(number - 1))
        held = {r.name: r.held for r in before.collect()}
    held |= dict.fromkeys(tables, number)
    spark.createDataFrame(sorted(held.items()), "name string, held long").write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")


def _replaced(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changed`` in the place of the rows with their key."""
    return rows.join(changed.select(key), key, "left_anti").select(*rows.columns).unionByName(changed.select(*rows.columns))


def apply_decisions(spark: SparkSession, folder: str, decisions: DataFrame, now: Column) -> int:
    """Decide pending reviews (item_id, decision, reason) and carry out what was applied; the version that holds afterwards.

    Corrections become new note versions with their claims, handovers close the claims of the old note and
    relate the new one to it. Notes, history, claims and reviews change in one version. A decision on an item
    that is not pending, as in a replay, changes nothing.
    """
    number, tables = read_store(spark, folder)
    notes, claims = tables["notes"], tables["claims"]
    events, _ = LE.resolve_reviews(LE.review_state(tables["reviews"]), decisions, now)
    events = written(events)
    if events.isEmpty():
        return number
    fixed = TM.apply_corrections(notes, LE.corrections_of(events), claims, now)
    claims = _replaced(claims.unionByName(fixed["opened"].select(*claims.columns)), fixed["closed"], "claim_id")
    claims = written(claims.unionByName(fixed["fresh"].select(*claims.columns)))
    notes, history = written(fixed["notes"]), fixed["history"]
    handed = TM.record_supersedes(LE.handovers_of(events), G.name_registry(notes), notes, claims, now)
    claims = _replaced(claims, handed["closed"], "claim_id").unionByName(handed["markers"].select(*claims.columns))
    added = handed["relations"].groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("source", "relation", "target", "confidence"))).alias("__more")
    )
    related = notes.join(added, F.col("title") == F.col("source")).withColumn("relations", F.concat("relations", "__more"))
    told = TM.overwrite_notes(notes, related.select(*notes.columns), now)
    every = tables["history"].unionByName(history.select(*tables["history"].columns)).unionByName(told["history"].select(*tables["history"].columns))
    commit(spark, folder, number + 1, {
        "notes": told["notes"].select(*notes.columns), "history": every, "claims": claims,
        "reviews": tables["reviews"].unionByName(events.select(*tables["reviews"].columns)),
    })
    return number + 1
