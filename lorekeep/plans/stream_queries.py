"""Streams over the given tables. A table arrives in parts; the stream is stopped after every part and started again
from its checkpoint for the next one, so each query also shows that nothing is lost or told twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import index as I
from lorekeep.operators import skew
from lorekeep.operators.blocks import term_sums
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans import time_queries
from lorekeep.plans.registry import ORACLE, query
from lorekeep.session import shared_folder, written
from lorekeep.streaming import segments
from lorekeep.streaming import streams as ST


def _arriving(rows: DataFrame, part, parts: int, start: Callable[[DataFrame, str], object]) -> str:
    """Let ``rows`` arrive part by part; ``start(stream, folder)`` runs until all that is there is done."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    for n in range(parts):
        rows.where(part == n).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


# events arrive by time in four parts; every fiftieth comes two parts late
_PART = "least(3, cast(floor((event_id * 4) / (select max(event_id) + 1 from events)) as int) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END)"


def _part_of(events: DataFrame):
    last = events.agg((F.max("event_id") + 1).alias("n")).scalar()
    return F.least(F.lit(3), F.floor(F.col("event_id") * 4 / last).cast("int") + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0))


@query("ST5", sql=f"""WITH e AS (SELECT *, {_PART} AS part, date_trunc('day', ts) AS day FROM events),
    m AS (SELECT part, max(ts) AS newest FROM e GROUP BY part),
    w AS (SELECT e.part, max(m.newest) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT part FROM e) e LEFT JOIN m ON m.part < e.part GROUP BY e.part),
    l AS (SELECT e.*, coalesce(day + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN w USING (part))
    SELECT day, count(*) FILTER (NOT late AND event_type = 'purchase') AS captured, count(*) FILTER (NOT late AND event_type = 'click') AS skipped,
      count(*) FILTER (NOT late AND event_type = 'error') AS failed, count(*) FILTER (late) AS late FROM l GROUP BY day""")
def late_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters per day over arriving events, with those that came after their day was closed."""
    events = A.table(spark, folder, "events")
    decision = F.expr("case event_type when 'purchase' then 'captured' when 'click' then 'skipped' when 'error' then 'failed' else 'other' end")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), decision.alias("decision"))
    place = _arriving(rows, _part_of(rows), 4, lambda s, at: ST.count_stream(s, f"{at}/out", f"{at}/cp"))
    return ST.counted(spark, f"{place}/out")


@query("ST4", sql=time_queries.MOVES)
def streamed_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Job events as they arrive, against the state kept from the parts before."""
    events = A.job_events(spark, folder)
    last = events.agg((F.max("seq") + 1).alias("n")).scalar()
    place = _arriving(events, F.floor(F.col("seq") * 3 / last), 3, lambda s, at: ST.kept_stream(ST.job_stream(s), f"{at}/out", f"{at}/cp"))
    return spark.read.parquet(f"{place}/out").select("job_id", "seq", "state", "previous", "legal")


@query("ST3", sql=f"WITH {O.CLAIMS} SELECT claim_id, (valid_to IS NOT NULL)::INTEGER AS seq, valid_to, text FROM claims")
def streamed_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every claim as its log arrives: what was told last."""
    log = written(A.claim_log(spark, folder).select(F.col("claim_id").cast("string").alias("claim_id"), F.col("seq").cast("long").alias("seq"), "valid_to", "text"))
    part = F.pmod(F.col("claim_id").cast("long"), F.lit(2)) + F.col("seq")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ST.STATE_STORE)
    try:
        place = _arriving(log, part, 3, lambda s, at: ST.kept_stream(ST.claim_stream(s), f"{at}/out", f"{at}/cp", "update"))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    told = skew.latest(spark.read.parquet(f"{place}/out"), ["claim_id"], ["batch"])
    return told.select(F.col("claim_id").cast("bigint").alias("claim_id"), F.col("seq").cast("int").alias("seq"), "valid_to", "text")


_SAID = f"""t AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds((conv_id * 3600 + turn * 60)::BIGINT) AS ts,
      conv_id % 10 = 0 AND turn % 3 = 2 AND conv_id * 2 < (SELECT max(conv_id) FROM conversations) AS is_late FROM conversations WHERE {O.strip('text')} <> ''),
    s AS (SELECT conv_id, string_agg(role || ': ' || {O.strip('text')}, chr(10) ORDER BY turn) AS transcript, max(ts) AS last FROM t WHERE NOT is_late GROUP BY conv_id)"""


@query("ST2", sql=f"""WITH {_SAID} SELECT DISTINCT left(sha256(transcript || chr(10)), 8) AS digest, length(transcript)::INTEGER AS chars FROM s
    WHERE length({O.strip('transcript')}) >= 400 AND last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM t)""")
def streamed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as they arrive, in four parts by time; some turns of early ones come with the last part, too late."""
    turns = A.turns(spark, folder)
    most = turns.agg(F.max("conv_id").alias("n")).scalar()
    late = (F.col("conv_id") % 10 == 0) & (F.col("turn") % 3 == 2) & (F.col("conv_id") * 2 < most)
    part = F.when(late, 3).otherwise(F.least(F.lit(3), F.floor(F.col("conv_id") * 4 / (most + 1)).cast("int")))
    place = _arriving(turns, part, 4, lambda s, at: ST.kept_stream(ST.session_stream(s), f"{at}/out", f"{at}/cp"))
    return spark.read.parquet(f"{place}/out").select("digest", F.length("transcript").alias("chars")).distinct()


@query("ST6", "A2", sql=ORACLE["postings"])
def segmented_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index after five batches of notes, some of which were told before with another text."""
    notes = A.notes(spark, folder)
    cut = notes.withColumn("part", F.pmod("doc_id", F.lit(4)).cast("int"))
    # every seventh note comes first under another text, and as it is one batch later
    first = cut.where("doc_id % 7 = 0").withColumns({"retrieval_text": F.concat(F.lit("draft "), F.col("title")), "summary": F.lit("draft")})
    rows = first.unionByName(cut.withColumn("part", F.when(F.col("doc_id") % 7 == 0, F.col("part") + 1).otherwise(F.col("part"))))
    columns = ["note_id", "title", "aliases", "tags", "summary", "retrieval_text", "body_sections", "updated_at", "part"]
    place = _arriving(rows.select(*columns), F.col("part"), 5, lambda s, at: segments.index_stream(s, f"{at}/index", f"{at}/cp", fan=3))
    blocks, corpus = segments.live_blocks(spark, f"{place}/index")
    return term_sums(blocks).withColumn("idf", F.round(I.idf(F.col("df"), corpus.select("n").scalar()), 6))
