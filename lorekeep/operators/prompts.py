"""Prompt tables for a language model and the tables parsed from its answers.

No model is called here: prompts leave as rows, answers come back as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.functions import jsontext as J
from lorekeep.functions import text as T
from lorekeep.operators import search as S
from lorekeep.operators import skew
from lorekeep.session import written

AUTO_APPLY = 0.8
ESCAPE_SEEDS = 2
_NOTE = (
    "struct<title:string,aliases:array<string>,folder:string,tags:array<string>,summary:string,"
    "retrieval_text:string,body_sections:map<string,string>,"
    "relations:array<struct<source:string,relation:string,target:string,confidence:string>>,"
    "proposed_links:array<struct<anchor:string,target:string,reason:string>>,"
    "supported_claims:array<string>,confidence:string>"
)


def extraction_prompts(chunks: DataFrame, instructions: str, language: str = "English") -> DataFrame:
    """chunk_id, prompt_id, prompt; the instructions hold {text} and {language}."""
    head, tail = instructions.replace("{language}", language).split("{text}", 1)
    prompt = F.concat(F.lit(head), "text", F.lit(tail))
    return chunks.select("chunk_id", F.sha2(prompt, 256).alias("prompt_id"), prompt.alias("prompt"))


def parse_extractions(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes of the answered chunks, and the answers that hold no JSON array.

    ``answers`` is (chunk_id, raw_path, normalized_path, locator, source_hash, answer). A note
    needs a title; a relation a target; a link anchor and target. The rest has defaults.
    """
    parsed = answers.withColumn("items", J.json_array("answer", _NOTE))
    # a broken array parses to NULL or to one empty element
    bad = F.col("items").isNull()
    rows = parsed.where(~bad).select("*", F.posexplode("items").alias("pos", "c"))
    title = T.strip(F.coalesce("c.title", F.lit("")))
    rows = rows.withColumn("title", title).where("title <> ''")
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    words = lambda c: F.coalesce(c, empty("array<string>"))
    number = lambda c, d: F.coalesce(c.try_cast("double"), F.lit(d))
    summary = F.coalesce("c.summary", F.concat("title", F.lit(".")))
    sections = F.map_entries("c.body_sections")
    told = F.filter(F.coalesce("c.relations", empty("array<struct<source:string,relation:string,target:string,confidence:string>>")),
                    lambda r: T.strip(F.coalesce(r["target"], F.lit(""))) != "")
    links = F.filter(
        F.coalesce("c.proposed_links", empty(SC.LINKS)),
        lambda p: (T.strip(F.coalesce(p["anchor"], F.lit(""))) != "") & (T.strip(F.coalesce(p["target"], F.lit(""))) != ""),
    )
    notes = rows.select(
        F.lower(F.replace("title", F.lit(" "), F.lit("-"))).alias("note_id"), "title",
        words("c.aliases").alias("aliases"), F.coalesce("c.folder", F.lit("")).alias("folder"),
        words("c.tags").alias("tags"), summary.alias("summary"),
        F.coalesce("c.retrieval_text", "title").alias("retrieval_text"),
        F.when(F.size(sections) > 0, sections).otherwise(
            F.array(F.struct(F.lit("summary").alias("key"), summary.alias("value")))).alias("body_sections"),
        F.transform(links, lambda p: F.struct(
            p["anchor"].alias("anchor"), p["target"].alias("target"), F.coalesce(p["reason"], F.lit("")).alias("reason"))).alias("proposed_links"),
        F.transform(told, lambda r: F.struct(
            F.coalesce(r["source"], F.col("title")).alias("source"), F.coalesce(r["relation"], F.lit("related")).alias("relation"),
            r["target"].alias("target"), number(r["confidence"], 0.5).alias("confidence"))).alias("relations"),
        F.array(F.struct("raw_path", "normalized_path", "locator", "source_hash",
                         words("c.supported_claims").alias("supported_claims"))).alias("sources"),
        number(F.col("c.confidence"), 0.8).alias("confidence"),
        F.col("chunk_id"), F.col("pos").alias("seq"),
    )
    return notes, parsed.where(bad).select("chunk_id", "answer")


#: Lines of a range of ``batched_prompts``: a line may hold the first two lines of a text, so a task sorts fewer of them.
LINES = 20_000


def batched_prompts(rows: DataFrame, order: str, line: Column, size: int) -> DataFrame:
    """batch, n, listing: lines packed ``size`` at a time in order.

    The running number is exact over all rows but computed per range of the order, so no task sees them all.
    """
    # the lines alone are moved, not the rows they are made of
    lines = rows.select(order, line.alias("line"), F.lit(0).alias("__all"))
    numbered = skew.running(lines, ["__all"], skew.order_bucket(rows.select(order), [order], LINES), [F.asc(order)], number="__n")
    packed = numbered.select(F.floor((F.col("__n") - 1) / size).alias("batch"), "__n", "line")
    return packed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "line"))), lambda e: e["line"]), "\n").alias("listing"),
    )


def parse_groups(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """group_seq, canonical, pos, member of duplicate groups with two or more known members.

    ``group_seq`` is (answer_id, position in the answer), which orders the groups of any number of answers.
    The canonical title must be a member, else the first member is taken. ``answers`` is
    (answer_id, answer).
    """
    group = "canonical string, members array<string>"
    raw = answers.select("answer_id", F.posexplode(J.balanced_objects("answer")).alias("g", "o")).select(
        F.struct("answer_id", "g").alias("group_seq"), F.from_json("o", group).alias("x")
    )
    members = raw.select("group_seq", F.col("x.canonical").alias("given"), F.posexplode(F.array_distinct("x.members")).alias("pos", "member"))
    known = members.join(notes.select(F.col("title").alias("member")).distinct(), "member", "left_semi")
    facts = known.groupBy("group_seq").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("member", "pos").alias("first"),
        F.max(F.when(F.col("member") == F.col("given"), F.col("given"))).alias("kept"),
    ).where("n >= 2")
    return known.join(facts, "group_seq").select("group_seq", F.coalesce("kept", "first").alias("canonical"), "pos", "member")


def supersedes_candidates(new: DataFrame, notes: DataFrame) -> DataFrame:
    """new_id, new_title, old_id, old_title: the best of four hits that shares a title stem.

    The hits come from the whole index; notes of the batch itself are passed over, not replaced.
    """
    asked = new.select(F.col("note_id").alias("query_id"), F.concat_ws(" ", "title", "summary").alias("text"))
    hits = S.search_index(asked, notes, 4)
    stems = lambda c: F.array_distinct(T.tokens(c))
    left = new.select(F.col("note_id").alias("query_id"), F.col("title").alias("new_title"), stems("title").alias("a"))
    right = notes.select("note_id", F.col("title").alias("old_title"), stems("title").alias("b"))
    fit = (
        hits.join(new.select("note_id"), "note_id", "left_anti").join(left, "query_id").join(right, "note_id")
        .where(F.arrays_overlap("a", "b"))
    )
    best = skew.first(fit.select("query_id", "rank", "new_title", "note_id", "old_title"), ["query_id"], ["rank"])
    return best.select(F.col("query_id").alias("new_id"), "new_title", F.col("note_id").alias("old_id"), "old_title")


def parse_supersede_verdicts(answers: DataFrame) -> dict[str, DataFrame]:
    """applied handovers (old, new, evidence) and review rows for the unsure ones.

    ``answers`` is (old_title, new_title, answer).
    """
    verdict = J.json_object("answer", "supersedes boolean, confidence string, reason string")
    rows = answers.withColumn("v", verdict).where("v.supersedes").select(
        F.col("old_title").alias("old"), F.col("new_title").alias("new"),
        F.coalesce(F.col("v.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce("v.reason", F.lit("")).alias("evidence"),
    )
    unsure = rows.where(F.col("confidence") < AUTO_APPLY).select(
        F.lit("supersedes").alias("kind"),
        F.concat(F.lit("'"), "new", F.lit("' may supersede '"), "old", F.lit("'")).alias("title"),
        F.to_json(F.struct("old", "new", F.round("confidence", 2).alias("confidence"), F.col("evidence").alias("reason"))).alias("detail"),
    )
    return {"applied": rows.where(F.col("confidence") >= AUTO_APPLY), "reviews": unsure}


def faithfulness(answer: Column | str) -> Column:
    up = F.upper(answer)
    return up.contains("GROUNDED") & ~up.contains("HALLUCINATED")


def correctness(answer: Column | str) -> Column:
    """correct, partial or wrong by containment in that order: INCORRECT counts as correct."""
    up = F.upper(answer)
    return F.when(up.contains("CORRECT"), "correct").when(up.contains("PARTIAL"), "partial").otherwise("wrong")


def judge_prompts(rows: DataFrame, prompt: Column) -> DataFrame:
    """Each distinct prompt once, keyed by its hash, so equal verdicts are asked for once."""
    return rows.select(F.sha2(prompt, 256).alias("prompt_id"), prompt.alias("prompt")).dropDuplicates(["prompt_id"])


def with_verdicts(rows: DataFrame, prompt: Column, verdicts: DataFrame) -> DataFrame:
    """Rows joined with the cached answers (prompt_id, answer)."""
    return rows.withColumn("prompt_id", F.sha2(prompt, 256)).join(verdicts, "prompt_id", "left").drop("prompt_id")


def answer_prompts(items: DataFrame, queries: DataFrame, template: str, budget: int = S.CONTEXT_BUDGET) -> tuple[DataFrame, DataFrame]:
    """query_id, prompt_id, prompt, and the sources legend query_id, n, name.

    ``items`` is (query_id, rank, path, updated, content); the template holds {question} and
    {context}.
    """
    fit = S.fit_to_budget(items, budget)
    stamp = F.when(F.coalesce("updated", F.lit("")) != "", F.concat(F.lit(" (updated "), "updated", F.lit(")"))).otherwise("")
    block = F.concat(F.lit("["), "rank", F.lit("] "), "path", stamp, F.lit("\n"), "content")
    joined = fit.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda e: e["b"]), "\n\n").alias("context")
    )
    prompt = F.replace(
        F.replace(F.lit(template), F.lit("{question}"), F.col("text")), F.lit("{context}"), F.col("context")
    )
    prompts = joined.join(queries.select("query_id", "text"), "query_id").select(
        "query_id", F.sha2(prompt, 256).alias("prompt_id"), prompt.alias("prompt")
    )
    legend = fit.select("query_id", F.col("rank").alias("n"), F.substring_index("path", "/", -1).alias("name"))
    return prompts, legend


def check_citations(answers: DataFrame, legend: DataFrame) -> DataFrame:
    """query_id, cited, known: the bracketed numbers of an answer and whether a source bears them."""
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1), lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))
    cited = answers.select("query_id", F.explode(F.array_distinct(numbers)).alias("n"))
    named = legend.select("query_id", F.col("n").cast("string").alias("n"), F.lit(True).alias("known"))
    return cited.join(named, ["query_id", "n"], "left").select(
        "query_id", F.col("n").cast("decimal(38,0)").alias("cited"), F.coalesce("known", F.lit(False)).alias("known")
    )


def named_in(texts: DataFrame, names: DataFrame, size: int = 8) -> DataFrame:
    """query_id and the columns of ``names`` for every name that occurs in a text (query_id, low).

    A name is keyed by its first ``size`` characters, a text by all its stretches of the lengths such keys
    have, ``size`` at most. Keys are joined, and only then is the whole name looked for; empty names occur nowhere.
    """
    keyed = names.where("name <> ''").withColumn("__key", F.substring("name", 1, size))
    lengths = sorted(r.n for r in keyed.select(F.length("__key").alias("n")).distinct().collect())
    none = F.expr("cast(array() as array<string>)")
    stretches = [_stretches(n) for n in lengths]
    have = texts.select("query_id", F.explode(F.array_distinct(F.concat(*stretches)) if stretches else none).alias("__key"))
    met = have.join(keyed, "__key").drop("__key")
    return met.join(texts, "query_id").where(F.contains("low", F.col("name"))).drop("low")


def _stretches(size: int) -> Column:
    """Every stretch of ``size`` characters of the column low."""
    last = F.length("low") - (size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.substring("low", i, F.lit(size)))


def route_members(
    answers: DataFrame, domains: DataFrame, members: DataFrame, areas: DataFrame | None = None,
    area_answers: DataFrame | None = None,
) -> DataFrame:
    """query_id, domain_seq, pos, title: members of the domains an answer names by id.

    Ids are checked against the map. With areas, the area answer narrows the map first, if it
    names any. Without a valid id a domain is taken when its name occurs in the answer.
    """
    ids = lambda df: df.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("answer"), F.lit("[a-z0-9-]+"), 0))).alias("id"))  # noqa: E731,E501
    every = domains.select("domain_id", "domain_seq", "name")
    asked = answers.select("query_id", "answer")
    allowed = None
    if areas is not None and area_answers is not None:
        allowed = ids(area_answers).join(areas.select(F.col("area_id").alias("id"), "domain_id"), "id").select("query_id", "domain_id").distinct()
        allowed = allowed.join(every.select("domain_id"), "domain_id", "left_semi")
    chosen = ids(asked).join(every.select(F.col("domain_id").alias("id"), "domain_id", "domain_seq"), "id").drop("id")
    if allowed is not None:
        narrowed = allowed.select("query_id").distinct()
        inside = chosen.join(allowed, ["query_id", "domain_id"], "left_semi")
        chosen = inside.unionByName(chosen.join(narrowed, "query_id", "left_anti").select(*inside.columns))
    open_ = asked.join(chosen.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lower("answer").alias("low"))
    by_name = named_in(open_, every.select("domain_id", "domain_seq", F.lower("name").alias("name"))).drop("name")
    if allowed is not None:
        inside = by_name.join(allowed, ["query_id", "domain_id"], "left_semi")
        by_name = inside.unionByName(by_name.join(narrowed, "query_id", "left_anti").select(*inside.columns))
    cols = ["query_id", "domain_id", "domain_seq"]
    routed = chosen.select(*cols).unionByName(by_name.select(*cols)).distinct()
    return routed.join(members.select("domain_id", "pos", "title"), "domain_id").select("query_id", "domain_seq", "pos", "title")


def select_members(routed: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """query_id, position, title, route: routed members by hit rank, then by listing order,
    with room kept for two hits from outside.

    ``hits`` is (query_id, title, rank) of a search of depth max(24, 3 * limit).
    """
    once = skew.first(routed, ["query_id", "title"], ["domain_seq", "pos"])
    ranks = hits.groupBy("query_id", "title").agg(F.max("rank").alias("rank"))
    outside = hits.join(routed.select("query_id", "title"), ["query_id", "title"], "left_anti").join(
        routed.select("query_id").distinct(), "query_id", "left_semi"
    )
    extras = S.topk(outside.select("query_id", "title", "rank"), ["query_id"], [F.asc("rank")], ESCAPE_SEEDS, "x")
    room = extras.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    members = S.topk(
        once.join(ranks, ["query_id", "title"], "left"), ["query_id"],
        [F.asc_nulls_last("rank"), F.asc("domain_seq"), F.asc("pos")], limit, "position",
    ).join(room, "query_id", "left")
    keep = F.greatest(F.lit(limit) - F.coalesce("n", F.lit(0)), F.lit(1))
    kept = members.where(F.col("position") <= keep).select("query_id", "position", "title", F.lit("overview").alias("route"))
    last = kept.groupBy("query_id").agg(F.max("position").alias("last"))
    tail = extras.join(last, "query_id").select(
        "query_id", (F.col("last") + F.col("x")).alias("position"), "title", F.lit("index").alias("route")
    )
    return kept.unionByName(tail)


def select_listed(routes: DataFrame, listing: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """``select_members`` of the members that ``routes`` (query_id, domain_seq, domain) reach in ``listing`` (domain, pos, title).

    A query takes at most ``limit`` members that no search found, and of those listed first only its hits stand before
    them. So it meets its hits and the first of each domain, ``limit`` more than it has hits, never whole domains.
    """
    hits = written(hits)
    most = hits.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    titles = listing.groupBy("domain", "title").agg(F.min("pos").alias("pos"))
    found = hits.select("query_id", "title").distinct().join(routes, "query_id").join(titles, ["domain", "title"])
    # titles of one place are listed in the order of their names
    first = written(S.topk(titles, ["domain"], [F.asc("pos"), F.asc("title")], limit + most, "x").drop("x"))
    met = found.unionByName(routes.join(first, "domain").select(*found.columns))
    return select_members(met.drop("domain"), hits, limit)


def routing_token_curve(sizes: DataFrame, notes_per_domain: int = 10, domains_per_area: int = 10) -> DataFrame:
    """n_notes, flat_tokens, tree_tokens: estimated size of one-level and two-level routing prompts.

    Only the counter inside a line grows, so its length comes from digit counts in closed form
    and no prompt is built. All lines hold a four-digit counter up to 9,999 and one more digit
    per further power of ten.
    """
    flat_line = "- Example domain : one-line description of the domain's content"
    area_line = "- area- | Example area: one-line description"
    dom_line = "- dom- | Example domain: one-line description"
    overhead = (
        "Given the MAP of domains (name: description) and a QUESTION, return ONLY the "
        "names of the relevant domains, comma-separated. No other words."
    )
    shell = lambda q: f"{overhead}\n\nMAP:\n\n\nQUESTION: {q}"
    zero = F.lit(0).cast("bigint")

    def digits(n: Column) -> Column:
        total = n * 4
        for power in range(4, 13):
            total = total + F.greatest(n - F.lit(10**power).cast("bigint"), zero)
        return total

    def tokens(line: str, n: Column, question: str) -> Column:
        chars = F.lit(len(shell(question))) + n * len(line) + digits(n) + (n - 1)
        words = F.lit(len(shell(question).split())) + n * len(line.split())
        return F.greatest(F.floor(chars / 4), words)

    n_domains = F.greatest(F.lit(1), F.floor(F.col("n_notes") / notes_per_domain))
    n_areas = F.greatest(F.lit(1), F.floor(n_domains / domains_per_area))
    inner = F.least(F.lit(domains_per_area).cast("bigint"), n_domains)
    return sizes.select(
        "n_notes", tokens(flat_line, n_domains, "example question").alias("flat_tokens"),
        (tokens(area_line, n_areas, "example") + tokens(dom_line, inner, "example")).alias("tree_tokens"),
    )
