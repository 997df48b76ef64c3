"""Sinks: index, graph, federated rows, Markdown and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.operators.blocks import build_blocks

# fixed values: the lines of a source in the frontmatter
SOURCE_LINES = (
    ("  - raw_path: ", "raw_path"), ("    normalized_path: ", "normalized_path"),
    ("    locator: ", "locator"), ("    source_hash: ", "source_hash"),
)


def write_index(notes: DataFrame, folder: str) -> None:
    """The blocks of the index and the corpus statistics as a replaceable snapshot.

    It can be rebuilt from the notes at any time.
    """
    build_blocks(notes).write.mode("overwrite").parquet(f"{folder}/blocks")
    I.corpus_row(notes).write.mode("overwrite").parquet(f"{folder}/corpus")
    I.doc_stats(notes).write.mode("overwrite").partitionBy("field").parquet(f"{folder}/doc_stats")
    I.corpus_stats(notes).write.mode("overwrite").parquet(f"{folder}/corpus_stats")


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """blocks and the one-row corpus table for search_index."""
    return spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/corpus")


def write_federated(rows: DataFrame, report: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("collection_id").parquet(f"{folder}/rows")
    report.write.mode("overwrite").parquet(f"{folder}/report")


def check_graph(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Good and rejected rows: a node needs id, kind and label, an edge both ends and a type."""
    full = lambda *names: " and ".join(f"coalesce({n}, '') <> ''" for n in names)
    node_ok, edge_ok = full("id", "kind", "label"), full("source", "target", "type")
    return {
        "nodes": nodes.where(node_ok), "edges": edges.where(edge_ok),
        "bad_nodes": nodes.where(f"not ({node_ok})"), "bad_edges": edges.where(f"not ({edge_ok})"),
    }


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    parts = check_graph(nodes, edges)
    parts["nodes"].write.mode("overwrite").parquet(f"{folder}/nodes")
    parts["edges"].write.mode("overwrite").parquet(f"{folder}/edges")
    counts = parts["nodes"].agg(F.lit("nodes").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        parts["edges"].agg(F.lit("edges").alias("part"), F.count(F.lit(1)).alias("n"))
    )
    counts.write.mode("overwrite").parquet(f"{folder}/counts")


def append_log(events: DataFrame, folder: str) -> None:
    events.write.mode("append").parquet(folder)


def _items(values: Column, indent: int) -> Column:
    """A list as dash lines, an empty one as brackets."""
    pad = " " * indent
    shown = F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{pad}- "), v)), "\n")
    return F.when(F.size(values) > 0, shown).otherwise(F.lit(f"{pad}[]"))


def _linked(sections: Column, links: Column) -> Column:
    """Sections with every link put in once: at the first whole-word occurrence of its anchor, long anchors first."""
    ordered = F.array_sort(links, lambda a, b: F.char_length(b["anchor"]) - F.char_length(a["anchor"]))

    def put(state: Column, link: Column) -> Column:
        quoted = F.concat(F.lit(r"\b\Q"), F.replace(link["anchor"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
        has = F.transform(state, lambda s: F.rlike(s["value"], quoted))
        place = F.array_position(has, F.lit(True)) - 1
        first = F.concat(F.lit(r"(?s)\A(.*?)"), quoted)
        value = F.concat(F.lit("$1"), F.regexp_replace(link["link"], r"([\\$])", r"\\$1"))
        return F.transform(
            state,
            lambda s, k: F.struct(s["key"].alias("key"), F.when(k == place, F.regexp_replace(s["value"], first, value)).otherwise(s["value"]).alias("value")),
        )

    return F.aggregate(ordered, sections, put)


def render_markdown(notes: DataFrame, links: DataFrame) -> DataFrame:
    """note_id, title, markdown; ``links`` is (note_id, anchor, link) as resolved."""
    linked = links.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("anchor", "link"))).alias("links"))
    none = F.array().cast("array<struct<anchor:string,link:string>>")
    joined = notes.join(linked, "note_id", "left").withColumn("links", F.coalesce("links", none))
    pairs = F.transform("body_sections", lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value")))

    line = lambda mark, value: F.concat(F.lit(mark), F.col(value).cast("string"))
    source = lambda s: F.concat_ws(
        "\n",
        *[F.concat(F.lit(mark), F.coalesce(s[name], F.lit("None"))) for mark, name in SOURCE_LINES],
        F.lit("    supported_claims:"), _items(s["supported_claims"], 6),
    )
    words = lambda key: F.array_join(
        F.transform(T.words(F.regexp_replace(key, "[_-]+", " ")), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " "
    )
    section = lambda s: F.concat(F.lit("\n## "), words(s["key"]), F.lit("\n\n"), s["value"], F.lit("\n"))
    names = F.array_sort(F.array_distinct(F.transform("links", lambda v: v["link"])))
    related = F.when(F.size("links") > 0, F.concat(F.lit("\n## Related\n\n"), F.array_join(F.transform(names, lambda v: F.concat(F.lit("- "), v)), "\n"), F.lit("\n")))
    head = F.concat_ws(
        "\n", F.lit("---"), line("id: ", "note_id"), line("title: ", "title"), F.lit("aliases:"), _items(F.col("aliases"), 2), F.lit("tags:"),
        _items(F.col("tags"), 2), line("confidence: ", "confidence"), F.lit("sources:"),
        F.when(F.size("sources") > 0, F.array_join(F.transform("sources", source), "\n")), F.lit("---"), F.lit(""),
    )
    page = F.concat(
        head, line("\n# ", "title"), F.lit("\n\n## Summary\n\n"), F.col("summary"), F.lit("\n"),
        F.array_join(F.transform(_linked(pairs, F.col("links")), section), ""), F.coalesce(related, F.lit("")),
    )
    return joined.select("note_id", "title", F.concat(F.regexp_replace(page, r"\s+\z", ""), F.lit("\n")).alias("markdown"))


def write_markdown(pages: DataFrame, folder: str) -> None:
    """One text row per page, spread by note; the file name is a partition-free column."""
    pages.select("note_id", "markdown").write.mode("overwrite").parquet(folder)
