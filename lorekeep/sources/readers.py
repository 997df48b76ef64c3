"""Readers: JSON notes and logs, text trees, vaults, judged corpora, transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.functions import markdown as M
from lorekeep.functions import shapes as S
from lorekeep.functions import text as T
from lorekeep.operators import skew
from lorekeep.session import checkpoint, written

# ---- Fixed values ----------------------------------------------------------------------------
SKIPPED_DIRS = (".obsidian", ".trash", ".git")
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt", ".docx", ".pdf", ".html", ".htm")
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".h", ".cpp", ".hpp",
    ".cs", ".rb", ".php", ".swift", ".scala", ".sh", ".ps1", ".sql", ".toml", ".yaml", ".yml",
    ".ini", ".cfg",
)
PRUNED_DIRS = (
    ".git", ".claude", ".worktrees", "node_modules", ".venv", "venv", "env", "dist",
    "build", "target", "site", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    ".idea", ".vscode", ".egg-info",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "cargo.lock",
    "gemfile.lock", "composer.lock",
)
MAX_FILE_BYTES = 1_000_000
BINARY_PROBE_BYTES = 1024
# ----------------------------------------------------------------------------------------------


def _times(df: DataFrame, columns) -> DataFrame:
    """Blank and missing times are NULL."""
    return df.withColumns({c: F.try_to_timestamp(F.nullif(c, F.lit(""))) for c in columns})


def read_notes(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """All notes with defaults for missing fields; unknown fields are dropped.

    ``body_sections`` may be an object, whose key order is kept.
    """
    if fmt == "parquet":
        df = spark.read.schema(SC.NOTES).parquet(path)
        return df.withColumns({c: F.coalesce(c, F.expr(d)) for c, d in SC.NOTE_DEFAULTS.items()})
    raw = SC.NOTES.replace(f"body_sections {SC.SECTIONS}", "body_sections map<string,string>")
    raw = raw.replace("created_at timestamp", "created_at string").replace("updated_at timestamp", "updated_at string")
    df = spark.read.schema(raw).option("multiLine", True).json(path)
    df = df.withColumn("body_sections", F.map_entries("body_sections"))
    df = _times(df.where("note_id is not null"), ("created_at", "updated_at"))
    return df.withColumns({c: F.coalesce(c, F.expr(d)) for c, d in SC.NOTE_DEFAULTS.items()})


def _log_order() -> Column:
    """Place of a record in its log: file name, block of the file, and line within the block.

    The running id of a task grows line by line inside a block, so places compare right whatever order splits are read in.
    """
    return F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_history(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """Every version of every note; order by updated_at, seq. The current one comes last."""
    raw = SC.NOTES.replace(f"body_sections {SC.SECTIONS}", "body_sections map<string,string>")
    raw = raw.replace("created_at timestamp", "created_at string").replace("updated_at timestamp", "updated_at string")
    old = spark.read.schema(raw).json(path).withColumn("seq", _log_order()).where("note_id is not null")
    old = _times(old.withColumn("body_sections", F.map_entries("body_sections")), ("created_at", "updated_at"))
    old = old.withColumns({c: F.coalesce(c, F.expr(d)) for c, d in SC.NOTE_DEFAULTS.items()})
    last = F.struct(F.lit("\U0010ffff").alias("file"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("line"))
    return old.unionByName(current.withColumn("seq", last).select(*old.columns))


def read_claim_log(spark: SparkSession, path: str) -> DataFrame:
    """The claim log with a position that grows along each file."""
    raw = SC.CLAIMS.replace("timestamp", "string").replace("detail string", "detail map<string,string>")
    df = spark.read.schema(raw).json(path).withColumn("seq", _log_order()).where("claim_id is not null")
    df = _times(df, SC.CLAIM_TIMES).withColumn("detail", F.to_json("detail"))
    for c, default in (("evidence", ""), ("invalidated_by", "")):
        df = df.withColumn(c, F.coalesce(c, F.lit(default)))
    return df.withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))


def suffix_in(path: Column, suffixes: tuple[str, ...]) -> Column:
    escaped = "|".join(s.replace(".", r"\.") for s in suffixes)
    return F.lower(path).rlike(rf"[^/](?:{escaped})$")


def read_text_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(path, name, text, hash) of the supported files below a folder, and the failed ones.

    Bad bytes are replaced, HTML becomes text. A file that cannot be read goes to ``failed``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    raw = raw.where(suffix_in(F.col("path"), SC.TEXT_SUFFIXES)).select("path", "content", "length")
    failed = raw.where("content is null and length > 0").select("path", F.lit("unreadable").alias("error"))
    body = F.make_valid_utf8(F.col("content").cast("string"))
    plain = raw.where(~suffix_in(F.col("path"), (".html", ".htm"))).select("path", body.alias("text"))
    pages = raw.where(suffix_in(F.col("path"), (".html", ".htm"))).select(
        "path", S.html_to_text(body).alias("text")
    )
    texts = plain.unionByName(pages).where("text is not null")
    return texts.select(
        "path", F.substring_index("path", "/", -1).alias("name"), "text", T.content_hash("text").alias("hash")
    ), failed


def import_vault(files: DataFrame, seen: DataFrame | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Notes of a Markdown vault given as (path, text), path relative to the vault.

    Hidden folders and empty files are left out, unchanged files (seen: path, hash) skipped. Of
    notes with one id the first path wins; the others, and ids that exist, are reported.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    fit = files.where(
        F.col("path").endswith(".md") & ~F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED_DIRS))
    ).withColumn("hash", T.content_hash("text"))
    live = fit.where(T.strip("text") != "")
    if seen is not None:
        live = live.join(seen.select("path", "hash"), ["path", "hash"], "left_anti")
    meta = S.vault_meta(live)
    summary = T.first_paragraph("body", M.SUMMARY_CHARS)
    summary = F.when(summary == "", F.concat("title", F.lit("."))).otherwise(summary)
    targets = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(M.WIKILINK), 1), T.strip))
    targets = F.filter(targets, lambda t: (t != "") & (t != F.col("title")))
    notes = meta.join(live.select("path", "hash"), "path").select(
        F.lower(F.replace("title", F.lit(" "), F.lit("-"))).alias("note_id"), "title", "aliases",
        F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), "tags", summary.alias("summary"),
        F.array_join(F.concat(F.array("title"), "aliases", "tags", F.array(summary)), " ").alias("retrieval_text"),
        F.array(F.struct(F.lit("content").alias("key"), F.col("body").alias("value"))).alias("body_sections"),
        F.expr(f"cast(array() as {SC.LINKS})").alias("proposed_links"),
        F.transform(targets, lambda t: F.struct(
            F.col("title").alias("source"), F.lit("links-to").alias("relation"), t.alias("target"),
            F.lit(1.0).alias("confidence"))).alias("relations"),
        F.array(F.struct(
            F.col("path").alias("raw_path"), F.col("path").alias("normalized_path"),
            F.concat(F.lit("imported from vault: "), "path").alias("locator"),
            F.concat(F.lit("sha256:"), "hash").alias("source_hash"),
            F.expr("cast(array() as array<string>)").alias("supported_claims"))).alias("sources"),
        F.lit(1.0).alias("confidence"), "path",
    )
    first = skew.first(notes, ["note_id"], ["path"])
    if existing is not None:
        first = first.join(existing.select("note_id"), "note_id", "left_anti")
    return {
        "notes": first.drop("path"),
        "hashes": live.join(first.select("path"), "path", "left_semi").select("path", "hash"),
        "duplicates": notes.select("path").join(first.select("path"), "path", "left_anti"),
        "skipped": fit.select("path").join(live.select("path"), "path", "left_anti"),
    }


def split_sections_h1(texts: DataFrame) -> DataFrame:
    """path, source_hash, section_id, title, text: one section per ``# title`` line.

    Text before the first heading is dropped; without headings the file is one section.
    """
    heading = r"(?m)^#[\s\x1c-\x1f\x85\xa0]+(.+)$"
    titles = F.regexp_extract_all("text", F.lit(heading), 1)
    bodies = F.split("text", heading)  # the piece before the first heading is dropped
    pieces = F.zip_with(titles, F.slice(bodies, 2, F.size(bodies)), lambda t, b: F.struct(t.alias("title"), b.alias("body")))
    whole = F.array(F.struct(F.substring_index("path", "/", -1).alias("title"), F.col("text").alias("body")))
    parts = F.when(F.size(titles) > 0, pieces).otherwise(whole)
    return texts.select("path", T.source_hash("text").alias("source_hash"), F.posexplode(parts).alias("i", "p")).select(
        "path", "source_hash", F.format_string("%03d", F.col("i") + 1).alias("section_id"),
        T.strip(F.col("p.title")).alias("title"), T.strip(F.coalesce("p.body", F.lit(""))).alias("text"),
    )


def split_sections_h2(files: DataFrame) -> DataFrame:
    """path, pos, title, body, locator, part_of: one note per ``##`` section plus one per document, see ``section_titles``."""
    bodies = M.h2_sections(files).select("path", "pos", "body")
    return section_titles(files).join(bodies, ["path", "pos"]).select("path", "pos", "title", "body", "locator", "part_of")


def section_titles(files: DataFrame) -> DataFrame:
    """path, pos, title, locator, part_of of the notes. No body moves with the names, only its length.

    Titles are unique over all files: the earlier entry keeps a title, a later section gets
    " — document" appended or is dropped, a later document gets its file name. Each round lets
    every entry claim its next name and gives each name to the earliest, until nothing moves.
    """
    cut = M.h2_sections(files)
    raw = written(cut.select("path", "stem", "doc_title", "pos", "heading", F.length("body").alias("size")))
    docs = raw.where("pos = 0").select(
        "path", "pos", "doc_title", F.col("doc_title").alias("name1"),
        F.concat("doc_title", F.lit(" ("), "stem", F.lit(")")).alias("name2"), "size",
    )
    names = lambda d: d.withColumn("name", F.when(F.col("tried") == 1, F.col("name1")).otherwise(F.col("name2")))
    # The document title decides the sections' second name, so documents settle with them.
    sections = raw.where(
        f"pos > 0 and heading <> '' and size >= {M.SECTION_MIN_CHARS}"
    ).select("path", "pos", "doc_title", F.col("heading").alias("name1"), F.lit("").alias("name2"), "size", "heading")
    entries = docs.withColumn("heading", F.lit("")).unionByName(sections).withColumn("tried", F.lit(1))
    state = checkpoint(entries)
    while True:  # every round moves an entry on, and an entry moves twice at most
        shown = names(state)
        doc_names = shown.where("pos = 0").select("path", F.col("name").alias("doc_name"))
        shown = shown.join(doc_names, "path").withColumn(
            "name",
            F.when((F.col("pos") > 0) & (F.col("tried") == 2), F.concat("name1", F.lit(" — "), "doc_name")).otherwise(F.col("name")),
        )
        claims = shown.where("tried <= 2").withColumn("k", F.lower("name"))
        winner = claims.groupBy("k").agg(F.min(F.struct("path", "pos")).alias("w"))
        judged = claims.join(winner, "k").withColumn("lost", F.col("w") != F.struct("path", "pos"))
        # a document keeps its second name even on a clash
        judged = judged.withColumn("lost", F.col("lost") & ~((F.col("pos") == 0) & (F.col("tried") == 2)))
        moved = judged.withColumn("tried", F.col("tried") + F.col("lost").cast("int"))
        gone = shown.where("tried > 2")
        state = checkpoint(moved.select(*entries.columns, "name", "doc_name", "lost").unionByName(
            gone.select(*entries.columns, "name", "doc_name", F.lit(False).alias("lost"))))
        settled = state.where("lost").isEmpty()
        last = state
        state = state.select(*entries.columns)
        if settled:
            break
    kept = last.where(f"tried <= 2 and (pos > 0 or size >= {M.SECTION_MIN_CHARS})")
    return kept.select(
        "path", "pos", F.col("name").alias("title"),
        F.when(F.col("pos") == 0, "intro").otherwise(F.concat(F.lit("section "), "heading")).alias("locator"),
        F.when(F.col("pos") > 0, F.col("doc_name")).alias("part_of"),
    )


def section_notes(sections: DataFrame) -> DataFrame:
    """The sections as notes with provenance and a part-of relation to their document."""
    summary = T.first_line("body")
    return sections.select(
        F.lower(F.replace("title", F.lit(" "), F.lit("-"))).alias("note_id"), "title",
        F.expr("cast(array() as array<string>)").alias("aliases"), F.lit("").alias("folder"),
        F.array(F.lit("doc")).alias("tags"), summary.alias("summary"), F.col("body").alias("retrieval_text"),
        F.array(F.struct(F.lit("content").alias("key"), F.col("body").alias("value"))).alias("body_sections"),
        F.expr(f"cast(array() as {SC.LINKS})").alias("proposed_links"),
        F.when(F.col("part_of").isNotNull(), F.array(F.struct(
            F.col("title").alias("source"), F.lit("part-of").alias("relation"), F.col("part_of").alias("target"),
            F.lit(0.9).alias("confidence")))).otherwise(F.expr(f"cast(array() as {SC.RELATIONS})")).alias("relations"),
        F.array(F.struct(
            F.col("path").alias("raw_path"), F.concat("path", F.lit("#"), "locator").alias("normalized_path"),
            F.col("locator"), F.concat(F.lit("sha256:"), F.substring(T.content_hash("body"), 1, 16)).alias("source_hash"),
            F.array(summary).alias("supported_claims"))).alias("sources"),
        F.lit(0.9).alias("confidence"),
    )


def read_eval_cases(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """case_id, question, relevant, category from a list or {"cases": [...]}."""
    case = "struct<id:string,question:string,relevant:array<string>,category:string>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{case}>")
    wrapped = F.from_json("value", f"cases array<{case}>")["cases"]
    starts = T.strip("value").startswith("[")
    rows = raw.select(F.explode(F.when(starts, listed).otherwise(wrapped)).alias("c")).select(
        F.coalesce("c.id", F.lit("")).alias("case_id"), T.strip(F.coalesce("c.question", F.lit(""))).alias("question"),
        F.coalesce("c.relevant", F.expr("cast(array() as array<string>)")).alias("relevant"),
        T.strip(F.coalesce("c.category", F.lit(""))).alias("category"),
    )
    rows = rows.where((F.col("question") != "") & ((F.size("relevant") > 0) | (F.col("category") == "negative")))
    return rows if category is None else rows.where(F.col("category") == category)


def read_judged_corpus(spark: SparkSession, folder: str, split: str = "test") -> dict[str, DataFrame]:
    """docs, queries and qrels of a judged corpus folder; unjudged queries are dropped."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = (
        spark.read.schema("query_id string, doc_id string, grade int")
        .csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, enforceSchema=True)
        .where("grade > 0")
    )
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    queries = asked.select(F.col("_id").alias("query_id"), blank("text"))
    return {
        "docs": docs.select(F.col("_id").alias("doc_id"), blank("title"), blank("text")),
        "queries": queries.join(qrels.select("query_id"), "query_id", "left_semi"),
        "qrels": qrels,
    }


_LONGMEM_TEXT = ("question_id", "question_type", "question", "question_date")


def read_longmem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, turns and violations of a long-memory question file (a JSON list).

    An item with a violation keeps out of items and turns.
    """
    raw = spark.read.text(path, wholetext=True)
    item = F.from_json("value", "array<variant>")
    rows = raw.select(F.posexplode(item).alias("index", "v"))
    kind = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    shape = lambda p: F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant"))
    checks = []
    for name in (*_LONGMEM_TEXT, "answer", "haystack_sessions", "haystack_dates", "answer_session_ids"):
        seen = shape(name)
        if name in _LONGMEM_TEXT:
            bad = ~seen.startswith("STRING")
        elif name == "answer":
            bad = ~seen.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)")
        else:
            bad = ~seen.startswith("ARRAY")
        checks.append(F.when(seen.isNull(), F.lit(f"missing required field '{name}'")).when(bad, F.lit(f"field '{name}' has the wrong type")))
    dates = kind("haystack_dates", "array<variant>")
    sessions = kind("haystack_sessions", "array<variant>")
    turn = "array<variant>"
    checks += [
        F.when(F.size(dates) != F.size(sessions), F.lit("haystack_dates must have one entry per haystack session")),
        F.when(F.exists(dates, lambda d: ~F.schema_of_variant(d).startswith("STRING")), F.lit("every haystack date must be a string")),
        F.when(F.exists(sessions, lambda s: ~F.schema_of_variant(s).startswith("ARRAY")), F.lit("every haystack session must be a list")),
        F.when(
            F.exists(
                F.flatten(F.transform(sessions, lambda s: F.coalesce(F.try_variant_get(s, "$", turn), F.expr("cast(array() as array<variant>)")))),
                lambda t: ~F.coalesce(F.schema_of_variant(F.try_variant_get(t, "$.role", "variant")).startswith("STRING"), F.lit(False))
                | ~F.coalesce(F.schema_of_variant(F.try_variant_get(t, "$.content", "variant")).startswith("STRING"), F.lit(False)),
            ),
            F.lit("every turn requires string role and content fields"),
        ),
    ]
    judged = rows.withColumn("violations", F.array_compact(F.array(*checks)))
    good = judged.where(F.size("violations") == 0)
    items = good.select(
        *[kind(n).alias(n) for n in _LONGMEM_TEXT], kind("answer").alias("answer"),
        kind("answer_session_ids", "array<string>").alias("answer_session_ids"),
    )
    turns = good.select(
        kind("question_id").alias("question_id"), kind("haystack_dates", "array<string>").alias("dates"),
        F.posexplode(kind("haystack_sessions", "array<array<struct<role:string,content:string>>>")).alias("session", "s"),
    ).select("question_id", "session", F.get("dates", F.col("session")).alias("date"), F.posexplode("s").alias("turn", "t"))
    turns = turns.select("question_id", "session", "date", "turn", "t.role", "t.content")
    return items, turns, judged.where(F.size("violations") > 0).select("index", "violations")


def read_transcripts(files: DataFrame) -> DataFrame:
    """Add ``transcript``: JSONL becomes ``role: text`` lines, other text passes through."""
    return files.withColumn("transcript", S.compress_transcript("text"))


# ---- file trees ------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression; ``*`` also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        sign = pattern[i]
        close = pattern.find("]", i + 2) if sign == "[" else -1
        if sign == "*":
            out.append(".*")
        elif sign == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = close
        else:
            out.append(f"\\{sign}" if not (sign.isalnum() or sign in "_/ ") else sign)
        i += 1
    return "(?s)^(?:" + "".join(out) + r")\z"


def _any(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def _any_part(path: Column, regex: str) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.rlike(regex))


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path meets an ignore rule: its name, itself, ``*/rule`` or any part of it.

    The rules are one small file, so they become one expression and need no join.
    """
    patterns = [r.strip().strip("/") for r in rules if r.strip() and not r.strip().startswith(("#", "!"))]
    checks = []
    for p in filter(None, patterns):
        checks += [path.rlike(glob_regex(p)), path.rlike(glob_regex(f"*/{p}"))]
        checks.append(_any_part(path, glob_regex(p)))
    return _any(checks)


def _top_ignored(path: Column, rules: list[str]) -> Column:
    """The first parent folder that an ignore rule meets, with a slash, else NULL."""
    parts = F.split(path, "/")
    parents = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    hit = F.filter(parents, lambda p: ignored(p, rules))
    return F.concat(F.try_element_at(hit, F.lit(1)), F.lit("/"))


def scan_tree(
    files: DataFrame, ignore_rules: list[str], profile: str = "all", include: list[str] | None = None,
    exclude: list[str] | None = None, max_files: int | None = None,
) -> DataFrame:
    """path, category, bytes, reason: the plan of a scan; an empty reason means included.

    ``files`` is (path, bytes, head) with the first kilobyte of each file. Vendor folders and what
    the include filter leaves out do not appear. An ignored folder appears once.
    """
    if profile not in ("docs", "code", "all"):
        raise ValueError(f"unknown profile {profile!r}")
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    low = F.lower(name)
    folders = F.transform(F.split("path", "/"), F.lower)
    pruned = F.exists(
        F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))),
        lambda p: p.isin(*PRUNED_DIRS) | p.endswith(".egg-info"),
    )
    rows = files.where(~pruned)
    is_doc, is_code = suffix_in(name, DOC_SUFFIXES), suffix_in(name, CODE_SUFFIXES) | low.isin("makefile", "dockerfile")
    category = F.lit(None).cast("string")
    if profile == "docs":
        category = F.when(is_doc, "docs")
    elif profile == "all":
        category = F.when(is_doc, "docs").when(is_code, "code")
    elif profile == "code":
        category = F.when(is_code, "code").when(is_doc & low.startswith("readme"), "docs")
    rows = rows.withColumn("__dir", _top_ignored(path, ignore_rules))
    folded = rows.where("__dir is not null").select(F.col("__dir").alias("path")).distinct()
    live = rows.where("__dir is null").drop("__dir")
    if include:
        live = live.where(_any([path.rlike(glob_regex(p)) for p in include]))
    out_by_user = _any([path.rlike(glob_regex(p)) | name.rlike(glob_regex(p)) for p in exclude or []])
    reason = (
        F.when(out_by_user, "--exclude")
        .when(ignored(path, ignore_rules), ".gitignore")
        .when(T.is_secret_file(name), "secret-like file")
        .when(low.isin(*LOCK_FILES), "lockfile")
        .when(category.isNull(), "unsupported type")
        .when(F.col("bytes") > MAX_FILE_BYTES, "over size threshold")
        .when(F.instr(F.hex(F.substring("head", 1, BINARY_PROBE_BYTES)), "00") > 0, _nul_reason())
        .otherwise("")
    )
    plan = live.select("path", category.alias("category"), "bytes", reason.alias("reason"))
    if max_files is not None:
        # the path of the last file that fits; a top-n on the included paths, never a global window
        fits = plan.where("reason = ''").select("path").orderBy("path").limit(max_files)
        last = fits.agg(F.coalesce(F.max("path"), F.lit(""))).scalar()
        plan = plan.withColumn(
            "reason", F.when((F.col("reason") == "") & (F.col("path") > last), "--max-files").otherwise(F.col("reason"))
        )
    dirs = folded.select(
        "path", F.lit(None).cast("string").alias("category"), F.lit(None).cast(dict(plan.dtypes)["bytes"]).alias("bytes"),
        F.lit(".gitignore").alias("reason"),
    )
    return plan.withColumn("category", F.when(F.col("reason") == "", F.col("category"))).unionByName(dirs)


def _nul_reason() -> Column:
    # "00" may straddle two bytes of the hex text; only an even position is a NUL byte
    bytes_ = F.regexp_extract_all(F.hex(F.substring("head", 1, BINARY_PROBE_BYTES)), F.lit(".."), 0)
    return F.when(F.array_contains(bytes_, "00"), "binary").otherwise("")


def scan_totals(plan: DataFrame) -> DataFrame:
    """category, files, bytes, est_tokens, est_llm_calls over the included files, and a total."""
    inc = plan.where("reason = ''")
    return inc.rollup("category").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.floor(F.coalesce(F.sum("bytes"), F.lit(0)) / 4).alias("est_tokens"), F.count(F.lit(1)).alias("est_llm_calls"),
    )


def secret_flags(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """path, kind, line of every likely secret in the included files; ``texts`` is (path, text)."""
    taken = plan.where("reason = ''").select("path")
    found = T.find_secrets(texts.join(taken, "path", "left_semi").withColumnRenamed("path", "doc_id"))
    return found.withColumnRenamed("doc_id", "path")


def watchable(path: Column) -> Column:
    """A supported file outside hidden folders and outside ``notes/``; path relative to the root."""
    return suffix_in(path, SC.TEXT_SUFFIXES) & ~path.rlike(r"(^|/)\.") & ~path.rlike(r"^notes(/|$)")


def session_text(turns: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """conv_id, transcript, diff, source_hash, digest: one row per conversation.

    A conversation is one output value, so its turns must fit one row; turns without text vanish.
    """
    line = F.concat("role", F.lit(": "), T.strip("text"))
    said = turns.where(T.strip("text") != "").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n").alias("transcript")
    )
    if diff is not None:
        said = said.join(diff.select("conv_id", "diff"), "conv_id", "left")
    else:
        said = said.withColumn("diff", F.lit(""))
    change = F.coalesce("diff", F.lit(""))
    payload = F.when(T.strip(change) != "", F.concat("transcript", F.lit("\n\n"), change)).otherwise(F.col("transcript"))
    return said.select(
        "conv_id", "transcript", change.alias("diff"), T.source_hash(payload).alias("source_hash"),
        T.digest8(F.concat("transcript", F.lit("\n"), change)).alias("digest"),
    )


def worth_remembering(sessions: DataFrame, min_chars: int = 400) -> DataFrame:
    return sessions.where((T.strip("diff") != "") | (F.length(T.strip("transcript")) >= min_chars))
