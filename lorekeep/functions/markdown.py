"""Markdown as column expressions: sections under ``##`` headings and the fields of rendered notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T

# ---- Fixed values ----------------------------------------------------------------------------
SECTION_MIN_CHARS = 120
TITLE_MAX_CHARS = 80
TITLE_JUNK = r"[*`#✅🟡⏳⭐🎯]|\[|\]|\(http[^)]*\)"
TITLE_EDGE = " -—·."
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
SUMMARY_CHARS = 240
# ----------------------------------------------------------------------------------------------
_MARK = "\x01"
_NONE = "cast(array() as array<string>)"
_GAP = r"[^\S\n]"  # white space inside a line


def _plain_lines(text: Column | str) -> Column:
    """The text with every kind of line end as a line feed, and one before the first line."""
    return F.concat(F.lit("\n"), F.array_join(T.lines(text), "\n"))


def _head(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _rest(piece: Column) -> Column:
    """What follows the first line."""
    return F.regexp_replace(piece, r"\A[^\n]*\n?", "")


def tidy_title(heading: Column) -> Column:
    """A heading without marks, badges and links, at most 80 characters long, cut between words."""
    whole = T.collapse(F.btrim(F.regexp_replace(heading, TITLE_JUNK, ""), F.lit(TITLE_EDGE)))

    def short(title):
        cut = F.btrim(F.regexp_replace(F.substring(title, 1, TITLE_MAX_CHARS), r" [^ ]*\z", ""), F.lit(TITLE_EDGE))
        return F.when(F.length(title) > TITLE_MAX_CHARS, cut).otherwise(title)

    # an array of one: an expression used three times would be computed three times
    return F.get(F.transform(F.array(whole), short), 0)


def _open_headings(text: Column | str) -> Column:
    """The text with a mark before each heading that lies in a code fence.

    Cut before every fence line, the pieces lie in and out of fences by turns.
    """
    pieces = F.split(_plain_lines(text), rf"(?m)(?=^{_GAP}*```)")
    masked = F.transform(pieces, lambda v, i: F.when(i % 2 == 1, F.regexp_replace(v, r"(?m)^(?=##? )", _MARK)).otherwise(v))
    return F.array_join(masked, "")


def _unmasked(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, rf"(?m)^{_MARK}(?=##? )", ""))


def h2_sections(files: DataFrame) -> DataFrame:
    """path, doc_title, stem, pos, heading, body: the parts of a file, position 0 is the text above the first ``##``.

    The title is the first ``#`` heading that is not empty once tidied, else the file's name. That line, and
    empty ones above it, belong to no body; headings in code fences are text.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^./]*\z", "")
    # every piece but the first begins with a line "# ..."
    pieces = F.split(_open_headings("text"), r"(?m)(?=^# )")
    titles = F.transform(F.expr("slice(pieces, 2, greatest(size(pieces), 1))"), lambda p: tidy_title(F.substring(_head(p), 3, 1 << 30)))
    base = files.select("path", stem.alias("stem"), pieces.alias("pieces")).withColumn("titles", titles)
    told = F.transform("titles", lambda t: t != "")
    base = base.withColumn("n", F.coalesce(F.nullif(F.array_position(told, True), F.lit(0)), F.size("titles")))
    whole = F.array_join(F.transform("pieces", lambda p, i: F.when((i > 0) & (i <= F.col("n")), _rest(p)).otherwise(p)), "")
    title = F.coalesce(F.try_element_at(F.filter("titles", lambda t: t != ""), F.lit(1)), tidy_title(F.replace("stem", F.lit("-"), F.lit(" "))))
    parts = F.transform(
        F.split(whole, r"(?m)^## "),
        lambda p, i: F.struct(
            F.when(i > 0, tidy_title(_head(p))).otherwise("").alias("heading"), _unmasked(F.when(i > 0, _rest(p)).otherwise(p)).alias("body")
        ),
    )
    return base.select("path", title.alias("doc_title"), "stem", F.posexplode(parts).alias("pos", "p")).select(
        "path", "doc_title", "stem", "pos", "p.heading", "p.body"
    )


def _entries(head: Column, name: str) -> Column:
    """The entries ``name:`` at the margin of a frontmatter: each with what stands below it up to the next entry."""
    every = F.split(F.concat(F.lit("\n"), head), r"(?m)(?=^[A-Za-z_][\w-]*:)")
    return F.transform(F.filter(every, lambda v: v.startswith(f"{name}:")), lambda v: F.substring(v, len(name) + 2, 1 << 30))


def _told(head: Column, name: str) -> Column:
    """The last value of an entry that is not empty; null without one."""
    values = F.transform(_entries(head, name), lambda v: T.strip(_head(v)))
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(-1))


def _listed(head: Column, name: str) -> Column:
    """The value of the last entry and the dash lines below it."""
    last = F.try_element_at(_entries(head, name), F.lit(-1))
    items = F.regexp_extract_all(_rest(last), F.lit(rf"(?m)^{_GAP}+-{_GAP}+(\S.*)$"), 1)
    values = F.concat(F.array(T.strip(_head(last))), F.transform(items, T.strip))
    return F.coalesce(F.filter(values, lambda v: ~v.isin("", "[]")), F.expr(_NONE))


def parse_note_markdown(files: DataFrame) -> DataFrame:
    """path, id, title, aliases, tags, summary, body_sections: the fields a person may edit in a rendered note.

    The title falls back to the last ``#`` heading. Of sections with one name the last holds, in the place of the first.
    """
    text = F.substring(_plain_lines("text"), 2, 1 << 30)
    front = rf"(?s)\A{_GAP}*---{_GAP}*\n(.*?)(?<=\n){_GAP}*---{_GAP}*(?:\n|\z)(.*)\z"
    base = files.select("path", text.alias("t")).select(
        "path", F.regexp_extract("t", front, 1).alias("head"),
        F.when(F.col("t").rlike(front), F.regexp_extract("t", front, 2)).otherwise(F.col("t")).alias("body"),
    )
    h1 = rf"(?m)^#{_GAP}+(.+)$"
    heads = F.regexp_extract_all("body", F.lit(h1), 1)
    below = F.split(F.concat(F.lit("\n"), F.regexp_replace("body", h1 + r"\n?", "")), rf"(?m)^##{_GAP}+(?=.)")
    named = F.transform(
        F.slice(below, 2, F.greatest(F.size(below), F.lit(1))),
        lambda p: F.struct(F.lower(T.strip(_head(p))).alias("name"), T.strip(_rest(p)).alias("value")),
    )
    parsed = base.select("path", "head", heads.alias("heads"), named.alias("named"))
    parsed = parsed.withColumn("own", F.transform(
        F.filter("named", lambda s: ~s["name"].isin("summary", "related")),
        lambda s: F.struct(F.replace(s["name"], F.lit(" "), F.lit("_")).alias("key"), s["value"].alias("value")),
    ))
    keys = F.array_distinct(F.transform("own", lambda s: s["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter("own", lambda s: s["key"] == k), -1))
    summary = F.filter("named", lambda s: s["name"] == "summary")
    return parsed.select(
        "path", F.coalesce(_told(F.col("head"), "id"), F.lit("")).alias("id"),
        F.coalesce(_told(F.col("head"), "title"), T.strip(F.try_element_at("heads", F.lit(-1))), F.lit("")).alias("title"),
        _listed(F.col("head"), "aliases").alias("aliases"), _listed(F.col("head"), "tags").alias("tags"),
        F.coalesce(F.try_element_at(summary, F.lit(-1))["value"], F.lit("")).alias("summary"),
        F.when(F.size(keys) == F.size("own"), F.col("own")).otherwise(last).alias("body_sections"),
    )
