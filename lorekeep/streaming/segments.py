"""The incremental index: immutable segments of blocks, tombstones, tiers that are merged, merged statistics.

Every batch of notes becomes one segment: its blocks (``operators.blocks``) and a row per note with its lengths. A
note that was in an earlier segment leaves a tombstone there. Segments of about the same size form a tier; once a
tier has ``fan`` of them they are merged into one, without the notes that are dead. A manifest per batch names the live
segments and is written last, so a batch that failed half-way is simply replayed under the same names.

A search reads the blocks of the live segments without their dead notes, and statistics that are the sums of the
segments' less those of the tombstones: no note is read again, and no posting is joined with a note list.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.operators import skew
from lorekeep.operators.blocks import build_blocks, merge_blocks
from lorekeep.session import written

GROUP = 8  # blocks in a row group, of about 2 MB each
_LENGTHS = ("haystack", "tri_title", "tri_summary", "accented")


def _members(notes: DataFrame) -> DataFrame:
    """note_id, its length in every field, and 1 if it has an accented letter."""
    accented = F.concat_ws(" ", "title", "summary", "retrieval_text").rlike(T.ACCENTED).cast("long")
    return notes.select("note_id", *[n.cast("long").alias(f) for f, n in I.lengths().items()], accented.alias("accented"))


def _load(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """What batches wrote to a folder, or None before the first one did."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def _manifest(spark: SparkSession, folder: str, before: int | None = None) -> list[tuple[str, int]]:
    """The live segments and their notes: a few per tier, so a few for every factor ``fan`` of notes."""
    rows = _load(spark, f"{folder}/manifest", before)
    if rows is None:
        return []
    last = rows.agg(F.max("batch")).first()[0]
    return [(r.seg, r.notes) for r in rows.where(F.col("batch") == F.lit(last)).collect()]


def _union(spark: SparkSession, folder: str, kind: str, segs: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{kind}/{s}").withColumn("seg", F.lit(s)) for s in segs])


def _live(spark: SparkSession, folder: str, kind: str, segs: list[str], dead: DataFrame | None) -> DataFrame:
    """Members, or blocks with the places of their dead notes in ``gone``."""
    rows = _union(spark, folder, kind, segs)
    if kind == "members":
        return rows if dead is None else rows.join(dead.select("seg", "note_id"), ["seg", "note_id"], "left_anti")
    if dead is None:
        return rows.withColumn("gone", F.expr("cast(array() as array<int>)"))
    listed = rows.select("seg", "block", F.posexplode("notes").alias("place", "note_id"))
    gone = listed.join(dead.select("seg", "note_id"), ["seg", "note_id"]).groupBy("seg", "block").agg(F.collect_list("place").alias("gone"))
    return rows.join(gone, ["seg", "block"], "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)")))


def _store(blocks: DataFrame, members: DataFrame, folder: str, seg: str) -> int:
    numbered = blocks.withColumn("block", F.monotonically_increasing_id())
    # a reader unpacks a whole row group at once
    numbered.write.mode("overwrite").option("parquet.block.row.count.limit", str(GROUP)).parquet(f"{folder}/blocks/{seg}")
    members.write.mode("overwrite").parquet(f"{folder}/members/{seg}")
    return members.sparkSession.read.parquet(f"{folder}/members/{seg}").count()


def add_batch(batch: DataFrame, folder: str, number: int, fan: int = 4) -> None:
    """Add the notes of batch ``number``; of several rows of one note the last updated holds."""
    spark = batch.sparkSession
    notes = written(skew.latest(batch, ["note_id"], ["updated_at"]))
    segs = _manifest(spark, folder, number)
    dead = _load(spark, f"{folder}/dead", number)
    own = f"b{number}"
    size = _store(build_blocks(notes), _members(notes), folder, own)
    if segs:
        before = _live(spark, folder, "members", [s for s, _ in segs], dead)
        replaced = before.join(notes.select("note_id"), "note_id", "left_semi")
        replaced.select("seg", "note_id", *_LENGTHS).write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        dead = _load(spark, f"{folder}/dead", number + 1)
    segs.append((own, size))
    merged = 0
    while True:
        tiers: dict[int, list[tuple[str, int]]] = {}
        for seg, n in segs:
            tiers.setdefault(floor(log(max(n, 1), fan)), []).append((seg, n))
        full = next((own for _, own in sorted(tiers.items()) if len(own) >= fan), None)
        if full is None:
            break
        names = [s for s, _ in full]
        seg = f"m{number}_{merged}"
        rows = merge_blocks(_live(spark, folder, "blocks", names, dead).drop("seg", "block"))
        n = _store(rows, _live(spark, folder, "members", names, dead).drop("seg"), folder, seg)
        segs = [s for s in segs if s[0] not in names] + [(seg, n)]
        merged += 1
    spark.createDataFrame(segs, "seg string, notes long").write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")


def live_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of the live segments as they are stored, with the places ``gone`` of dead notes, and the one-row corpus table."""
    segs = [s for s, _ in _manifest(spark, folder)]
    dead = _load(spark, f"{folder}/dead")
    dead = None if dead is None else dead.where(F.col("seg").isin(segs))
    sums = [F.sum(c).alias(c) for c in _LENGTHS]
    total = _union(spark, folder, "members", segs).agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("sign", F.lit(1))
    if dead is not None:
        total = total.unionByName(dead.agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("sign", F.lit(-1)))
    n = F.sum(F.col("sign") * F.col("n"))
    mean = lambda c: F.coalesce(F.sum(F.col("sign") * F.coalesce(c, F.lit(0))), F.lit(0)) / n
    corpus = total.agg(
        n.alias("n"), *[mean(f).alias(f) for f in I.FIELDS], (F.round(mean("accented"), 4) < T.MONOLINGUAL_BELOW).alias("monolingual")
    )
    return _live(spark, folder, "blocks", segs, dead).drop("seg", "block"), corpus


def read_segments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """blocks and the one-row corpus table of the live notes, as ``search_index`` takes them."""
    blocks, corpus = live_blocks(spark, folder)
    return merge_blocks(blocks), corpus


def index_stream(notes: DataFrame, folder: str, checkpoint: str, once: bool = True, fan: int = 4):
    """Keep the index of ``folder`` up to date with a stream of notes."""
    writer = notes.writeStream.foreachBatch(lambda batch, number: add_batch(batch, folder, number, fan)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
