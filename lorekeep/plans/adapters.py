"""The given tables as the engine's inputs: notes, queries, relations, versions, claims ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T

EMPTY = "cast(array() as array<string>)"


# Fixed schemas: no job is spent on reading them from the files.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def notes(spark: SparkSession, folder: str, labelled: bool = False) -> DataFrame:
    """One note per document; with ``labelled`` the confidence follows the quality label."""
    docs = table(spark, folder, "documents")
    if labelled:
        docs = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    else:
        docs = docs.withColumn("quality", F.lit(None).cast("int"))
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.encode("text", "UTF-8"), 256))
    created = F.expr("timestamp_seconds(unix_seconds(timestamp'2024-01-01 00:00:00') + doc_id * 60)")
    return docs.select(
        F.format_string("d%07d", "doc_id").alias("note_id"),
        F.split("text", "\n")[0].alias("title"),
        F.expr(EMPTY).alias("aliases"),
        F.lit("").alias("folder"),
        F.array("lang").alias("tags"),
        F.coalesce(F.nullif(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit("")), F.split("text", "\n")[0]).alias("summary"),
        F.col("text").alias("retrieval_text"),
        F.array(F.struct(F.lit("content").alias("key"), F.col("text").alias("value"))).alias(
            "body_sections"
        ),
        F.array(
            F.struct(
                F.col("source").alias("raw_path"),
                F.col("source").alias("normalized_path"),
                F.lit("document").alias("locator"),
                hashed.alias("source_hash"),
                F.expr(EMPTY).alias("supported_claims"),
            )
        ).alias("sources"),
        F.when(F.col("quality") == 1, 0.9)
        .when(F.col("quality") == 0, 0.4)
        .otherwise(0.8)
        .alias("confidence"),
        created.alias("created_at"),
        created.alias("updated_at"),
        "doc_id",
        "source",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, text: every benchmark passage is a query."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """source, relation, target between the titles of the star schema."""
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    title = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, s, r, t: df.select(
        s.alias("source"), F.lit(r).alias("relation"), t.alias("target")
    )
    placed = nation.join(region, nation.n_regionkey == region.r_regionkey)
    housed = supplier.join(placed, supplier.s_nationkey == placed.n_nationkey)
    sup, part = title("supplier", "l_suppkey"), title("part", "l_partkey")
    # neighbours: the next nation key of the same region; 25 fixed rows, so the window is tiny
    ring = nation.selectExpr(
        "n_name", "lead(n_name) over (partition by n_regionkey order by n_nationkey) as next_name"
    ).where("next_name is not null")
    out = edge(placed, title("region", "r_name"), "contains", title("nation", "n_name"))
    for more in (
        edge(housed, title("nation", "n_name"), "contains", title("supplier", "s_suppkey")),
        edge(
            housed.where("s_suppkey % 2 = 0"), title("region", "r_name"), "contains",
            title("supplier", "s_suppkey"),
        ),
        edge(pairs, sup, "supplies", part),
        edge(pairs.where("l_partkey % 2 = 0"), part, "comes from", sup),
        edge(ring, title("nation", "n_name"), "borders", title("nation", "next_name")),
        edge(ring, title("nation", "next_name"), "borders", title("nation", "n_name")),
    ):
        out = out.unionByName(more)
    return out


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """title, kind, seq: every region, nation, supplier and part of the star schema."""
    parts = [
        ("region", "r_name", "r_regionkey", 0),
        ("nation", "n_name", "n_nationkey", 1),
        ("supplier", "s_suppkey", "s_suppkey", 2),
        ("part", "p_partkey", "p_partkey", 3),
    ]
    out = None
    for kind, label, key, rank in parts:
        one = table(spark, folder, kind).select(
            F.concat(F.lit(f"{kind}:"), F.col(label).cast("string")).alias("title"),
            F.lit(kind).alias("kind"),
            (F.lit(rank * 10**12) + F.col(key)).cast("bigint").alias("seq"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as note versions: the customer is the note, the order date the version time."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("note_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("summary"),
    )


def claim_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as claims; a customer's next order closes the one before. Two log rows per claim."""
    from lorekeep.operators import skew

    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("note_id"),
        F.col("o_orderstatus").alias("text"),
        F.col("o_orderdate").alias("valid_from"),
    )
    closed = skew.running(
        orders, ["note_id"], skew.order_bucket(orders, ["valid_from", "claim_id"]),
        [F.col("valid_from"), F.col("claim_id")], lead={"__next": "valid_from"},
    ).select(*orders.columns, F.col("__next").alias("valid_to"))
    opening = closed.withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("seq", F.lit(0))
    return opening.unionByName(closed.where("valid_to is not null").withColumn("seq", F.lit(1)))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """The present state of every claim of the log."""
    from lorekeep.operators.temporal import latest_state

    return latest_state(claim_log(spark, folder), ["claim_id"], ["seq"])


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    state = F.expr(
        "case event_type when 'signup' then 'queued' when 'view' then 'running' "
        "when 'click' then 'paused' when 'purchase' then 'completed' else 'failed' end"
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), state.alias("state")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def label_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, vector: the mean vector of every label, a query set drawn from the whole table."""
    return (
        vectors(spark, folder)
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select(F.col("label").alias("query_id"), F.transform("v", lambda e: e["x"]).alias("vector"))
    )


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """One collection per document source."""
    n = F.substring("source", 4, 10).cast("int")
    return (
        table(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("collection_id"),
            F.col("source").alias("name"),
            F.when(n == 0, "central").when(n % 2 == 0, "archive").otherwise("project").alias("type"),
            (n % 5 != 0).alias("federated"),
            (n % 7 == 0).alias("sensitive"),
        )
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.expr(
        "timestamp_seconds(unix_seconds(timestamp'2024-01-01 00:00:00') + conv_id * 3600 + turn * 60)"
    )
    return table(spark, folder, "conversations").withColumn("ts", ts)


def link_titles(relations_df: DataFrame) -> DataFrame:
    """Relations with the lookup keys of both ends."""
    return relations_df.withColumn("target_key", T.key("target"))
