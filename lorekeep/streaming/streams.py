"""Structured Streaming: folder watch, session capture, claim and job state, counters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import shapes as S
from lorekeep.functions import text as T
from lorekeep.operators import curation, ledger
from lorekeep.sources import readers

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAILY_CAP = 50


# ---- folder watch ----------------------------------------------------------------------------


def watch_source(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """path, name, text, hash of every new file below a folder."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    inside = F.regexp_replace("path", "^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    fit = raw.where(readers.watchable(inside)).withColumn("body", F.make_valid_utf8(F.col("content").cast("string")))
    page = readers.suffix_in(F.col("path"), (".html", ".htm"))
    text = F.when(page, S.html_to_text("body")).otherwise(F.col("body"))
    return fit.select("path", F.substring_index("path", "/", -1).alias("name"), text.alias("text")).withColumn(
        "hash", T.content_hash("text")
    )


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def watch_pass(
    batch: DataFrame, seen: DataFrame, used_today: int = 0, cap: int = DAILY_CAP, limit: int = S.CHUNK_CHARS
) -> DataFrame:
    """name, text, hash, outcome of one pass: large, ingested or capped; unchanged files are absent."""
    fresh = curation.unseen(batch, seen).dropDuplicates(["name", "hash"])
    large = fresh.where(F.length("text") > limit).withColumn("outcome", F.lit("large"))
    small = fresh.where(F.length("text") <= limit).withColumn("day", F.lit("today"))
    left = max(cap - used_today, 0)
    capped = curation.daily_cap(small, left) if left else small.withColumn("accepted", F.lit(False))
    ranked = capped.withColumn("outcome", F.when(F.col("accepted"), "ingested").otherwise("capped"))
    cols = ["name", "text", "hash", "outcome"]
    return large.select(*cols).unionByName(ranked.select(*cols))


def watch_stream(
    source: DataFrame, registry: str, results: str, checkpoint: str, cap: int = DAILY_CAP,
    handler: Callable[[DataFrame], DataFrame] | None = None, once: bool = True,
):
    """Run the watch: each batch is diffed with the registry, capped by day and handed on.

    ``handler`` takes the files to ingest and returns the names that failed. Capped and failed
    files wait in the results of their batch and join the next one. All rows carry their batch id,
    so a replayed batch replaces its own rows.
    """
    columns = "name string, text string, hash string, outcome string, batch long"

    def load(spark: SparkSession, folder: str, schema: str, batch_id: int) -> DataFrame:
        try:
            rows = spark.read.schema(schema).parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            # nothing was written before the first batch
            rows = spark.createDataFrame([], schema)
        return rows.where(F.col("batch") < batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = load(spark, registry, "name string, hash string, day date, batch long", batch_id)
        earlier = load(spark, results, columns, batch_id)
        last = earlier.agg(F.max("batch").alias("b")).scalar()
        waiting = earlier.where((F.col("batch") == last) & F.col("outcome").isin("capped", "failed"))
        used = log.where(F.col("day") == F.current_date()).count()
        files = batch.select("name", "text", "hash").unionByName(waiting.select("name", "text", "hash"))
        done = watch_pass(files, log, used, cap)
        if handler is not None:
            failed = handler(done.where("outcome = 'ingested'")).select("name", F.lit(True).alias("__bad"))
            done = done.join(failed.distinct(), "name", "left").withColumn(
                "outcome", F.when((F.col("outcome") == "ingested") & F.col("__bad"), "failed").otherwise(F.col("outcome"))
            )
        waits = F.col("outcome").isin("capped", "failed")
        target = f"{results}/batch={batch_id}"
        done.select("name", F.when(waits, F.col("text")).alias("text"), "hash", "outcome").write.mode("overwrite").parquet(target)
        taken = spark.read.parquet(target).where("outcome = 'ingested'")
        taken.select("name", "hash", F.current_date().alias("day")).write.mode("overwrite").parquet(
            f"{registry}/batch={batch_id}"
        )

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")
    return writer.start()


# ---- sessions --------------------------------------------------------------------------------


def session_stream(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", min_chars: int = 400) -> DataFrame:
    """One row per finished session that passes the gate; a repeated digest is dropped.

    ``turns`` is (conv_id, turn, role, text, ts). A session ends after ``gap`` without a turn.
    """
    line = F.concat("role", F.lit(": "), T.strip("text"))
    said = turns.where(T.strip("text") != "").withWatermark("ts", late)
    grouped = said.groupBy(F.session_window("ts", gap).alias("w"), "conv_id").agg(
        F.collect_list(F.struct("turn", line.alias("line"))).alias("lines")
    )
    text = F.array_join(F.transform(F.array_sort("lines"), lambda t: t["line"]), "\n")
    rows = grouped.select(F.col("w.end").alias("ended"), "conv_id", text.alias("transcript"))
    kept = rows.where(F.length(T.strip("transcript")) >= min_chars)
    return kept.withColumn("digest", T.digest8(F.concat("transcript", F.lit("\n"))))


def distinct_sessions(sessions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sessions seen once per digest within the watermark; state stays bounded."""
    return sessions.withWatermark("ended", late).dropDuplicatesWithinWatermark(["digest"])


# ---- keyed state -----------------------------------------------------------------------------


def claim_stream(log: DataFrame) -> DataFrame:
    """claim_id, seq, valid_to, text: the latest state of each claim as its log grows, one row per claim and batch.

    The state is one row per claim; STATE_STORE keeps it outside the heap.
    """
    last = F.max_by(F.struct("seq", "valid_to", "text"), "seq").alias("last")
    return log.groupBy("claim_id").agg(last).select("claim_id", "last.seq", "last.valid_to", "last.text")


def job_stream(events: DataFrame) -> DataFrame:
    """job_id, seq, state, previous, legal for each event; an illegal one leaves the state as it is."""
    moves = ledger.LEGAL

    def step(key, batches, state):
        now = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for row in rows.itertuples():
            ok = row.state == "queued" if now is None else row.state in moves[now]
            out.append((key[0], row.seq, row.state, now, ok))
            now = row.state if ok else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=["job_id", "seq", "state", "previous", "legal"])

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, seq long, state string, previous string, legal boolean", "state string", "append", "NoTimeout"
    )


# ---- counters --------------------------------------------------------------------------------


def ingest_counters(decisions: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """day, captured, skipped, failed per tumbling day; rows behind the watermark are dropped."""
    rows = decisions if watermark is None else decisions.withWatermark("ts", watermark)
    count = lambda name: F.count(F.when(F.col("decision") == name, 1)).alias(name)
    return rows.groupBy(F.window("ts", "1 day")).agg(count("captured"), count("skipped"), count("failed")).select(
        F.col("window.start").alias("day"), "captured", "skipped", "failed"
    )


def count_stream(decisions: DataFrame, folder: str, checkpoint: str, delay: str = "1 day", once: bool = True):
    """Counters per day with the rows that came too late, kept in ``folder``.

    A row is late if its day ended before the newest time of all earlier batches less ``delay``; it is counted
    as late and in nothing else. A batch reads one time from the batches before it and writes one row per
    day, under its own number, so it can be replayed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            newest = spark.read.parquet(f"{folder}/clock").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None  # the first batch
        day = F.date_trunc("day", "ts")
        mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        late = F.coalesce(day + F.expr("interval 1 day") <= mark, F.lit(False))
        count = lambda name: F.count(F.when(~late & (F.col("decision") == name), 1)).alias(name)
        rows = batch.groupBy(day.alias("day")).agg(count("captured"), count("skipped"), count("failed"), F.count(F.when(late, 1)).alias("late"))
        rows.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{folder}/clock/batch={number}")

    writer = decisions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """day, captured, skipped, failed, late over all batches of ``count_stream``."""
    names = ("captured", "skipped", "failed", "late")
    return spark.read.parquet(f"{folder}/counts").groupBy("day").agg(*[F.sum(c).alias(c) for c in names])


def kept_stream(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Write what a stream yields to ``folder``, each batch under its number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
