"""The field-weighted inverted index and its corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T

FIELDS = ("haystack", "tri_title", "tri_summary")


def note_terms(notes: DataFrame) -> DataFrame:
    """One row per note with the term list of each search field."""
    haystack = T.tokens(T.haystack_text())
    return notes.select(
        "note_id",
        haystack.alias("haystack"),
        T.trigrams(F.concat_ws(" ", "title", F.array_join("aliases", " "))).alias("tri_title"),
        T.trigrams("summary").alias("tri_summary"),
    )


def term_rows(terms: DataFrame) -> DataFrame:
    """field, term, note_id, dl, hay_len: one row per term occurrence.

    The outer explode keeps Spark from deriving a "has terms" filter and computing the terms a
    second time below the shuffle; the rows it adds for empty lists are dropped right after.
    """
    fields = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), F.size(name).alias("dl"), F.col(name).alias("terms")
            )
            for name in FIELDS
        ]
    )
    return terms.select(
        "note_id", F.size("haystack").alias("hay_len"), F.explode(fields).alias("f")
    ).select("note_id", "hay_len", "f.field", "f.dl", F.explode_outer("f.terms").alias("term")).where(
        "term is not null"
    )


def count_terms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("note_id", "field", "term", "dl", "hay_len").agg(
        F.count(F.lit(1)).alias("tf")
    )


def build_postings(notes: DataFrame) -> DataFrame:
    """field, term, note_id, tf, dl, hay_len for every note.

    The document lengths travel with the posting, so scoring needs no join with a length table.
    """
    return count_terms(term_rows(note_terms(notes)))


def doc_stats(notes: DataFrame) -> DataFrame:
    """field, note_id, dl: also the notes without any term in a field."""
    terms = note_terms(notes)
    fields = F.array(
        *[F.struct(F.lit(n).alias("field"), F.size(n).alias("dl")) for n in FIELDS]
    )
    return terms.select("note_id", F.explode(fields).alias("f")).select("f.field", "note_id", "f.dl")


def lengths() -> dict[str, Column]:
    """The number of terms of a note in every field; counting needs no stemming."""
    return {
        "haystack": T.count_tokens(T.haystack_text()),
        "tri_title": F.size(T.trigrams(F.concat_ws(" ", "title", F.array_join("aliases", " ")))),
        "tri_summary": F.size(T.trigrams("summary")),
    }


def corpus_row(notes: DataFrame) -> DataFrame:
    """One row: note count, mean length per field, monolingual flag. Empty notes count."""
    means = [F.avg(value.cast("double")).alias(name) for name, value in lengths().items()]
    share = T.non_ascii_share("title", "summary", "retrieval_text")
    return notes.agg(
        F.count(F.lit(1)).alias("n"), *means, (share < T.MONOLINGUAL_BELOW).alias("monolingual")
    )


def corpus_stats(notes: DataFrame) -> DataFrame:
    """field, n, avgdl."""
    return corpus_row(notes).select(
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("avgdl")) for f in FIELDS])
        ).alias("s"),
    ).select("s.field", "n", F.coalesce("s.avgdl", F.lit(0.0)).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(postings: DataFrame, n: Column) -> DataFrame:
    """field, term, df, idf."""
    return (
        postings.groupBy("field", "term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", idf(F.col("df"), n))
    )


def append_notes(postings: DataFrame, new_notes: DataFrame) -> DataFrame:
    """The postings after a batch: rows of replaced notes leave, rows of the new ones enter."""
    kept = postings.join(new_notes.select("note_id").distinct(), "note_id", "left_anti")
    return kept.unionByName(build_postings(new_notes).select(*kept.columns))
