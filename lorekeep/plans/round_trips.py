"""The given tables written in the forms the readers take, and read back through them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import evaluate as EV
from lorekeep.operators import federation as FE
from lorekeep.operators import graph as G
from lorekeep.operators import prompts as PR
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans.graph_queries import _noted
from lorekeep.plans.registry import ORACLE, query
from lorekeep.plans.search_queries import _FED, collection_notes
from lorekeep.session import shared_folder, written
from lorekeep.sources import readers, writers


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/store/{uuid.uuid4().hex}"


def _files(rows: DataFrame, key: str, size: int = 500):
    """The file a row goes to, of about ``size`` rows; always of both parities."""
    return F.pmod(F.xxhash64(key), F.lit(2 + rows.count() // size))


def _one_file_each(rows: DataFrame, key: str, value: str, place: str) -> None:
    """A text file per value of ``key`` and task."""
    rows.select(key, value).write.partitionBy(key).option("lineSep", "\x1e").text(place)


_MATCHES = "m AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _matches(spark, folder) -> DataFrame:
    return EV.verbatim_matches(A.table(spark, folder, "documents").select("doc_id", "text"), A.questions(spark, folder))


@query("SC8", sql=f"""WITH {_MATCHES} SELECT 'case ' || b.item_id AS case_id, sha256({O.strip('b.text')}) AS question_hash, count(m.doc_id) AS relevant,
    CASE WHEN count(m.doc_id) > 0 THEN 'found' ELSE 'negative' END AS category FROM benchmark b LEFT JOIN m USING (item_id) GROUP BY b.item_id, b.text""")
def stored_cases(spark, folder):
    """The passages as JSON files of cases, half of them lists and half wrapped; a question of blanks is dropped."""
    found = _matches(spark, folder).groupBy("query_id").agg(F.collect_set(F.concat(F.lit("d"), "doc_id")).alias("relevant"))
    asked = A.questions(spark, folder)
    cases = asked.join(found, "query_id", "left").withColumn("g", _files(asked, "query_id"))
    none = F.expr("cast(array() as array<string>)")
    case = F.struct(
        F.concat(F.lit("case "), "query_id").alias("id"), F.col("text").alias("question"), F.coalesce("relevant", none).alias("relevant"),
        F.when(F.col("relevant").isNull(), "negative").otherwise("found").alias("category"),
    )
    blank = F.struct(F.lit("x").alias("id"), F.lit(" \n").alias("question"), none.alias("relevant"), F.lit("negative").alias("category"))
    listed = cases.groupBy("g").agg(F.collect_list(case).alias("cases"))
    listed = listed.withColumn("cases", F.concat("cases", F.array(blank)))
    value = F.when(F.col("g") % 2 == 0, F.to_json("cases")).otherwise(F.to_json(F.struct("cases")))
    place = _place(spark)
    _one_file_each(listed.select("g", value.alias("value")), "g", "value", place)
    read = readers.read_eval_cases(spark, place)
    return read.select("case_id", T.content_hash("question").alias("question_hash"), F.size("relevant").cast("bigint").alias("relevant"), "category")


@query("SC9", sql=f"""WITH {_MATCHES} SELECT 'q' || item_id AS query_id, 'd' || doc_id AS doc_id, (1 + doc_id % 2)::INTEGER AS grade, sha256(d.text) AS doc_hash, sha256(b.text) AS query_hash
    FROM m JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)""")
def stored_judgments(spark, folder):
    """Documents, passages and graded judgments in the files of a judged corpus."""
    place = _place(spark)
    name = lambda kind, c: F.concat(F.lit(kind), c)
    docs = A.table(spark, folder, "documents")
    docs.select(name("d", "doc_id").alias("_id"), F.col("source").alias("title"), "text").write.json(f"{place}/corpus.jsonl")
    A.questions(spark, folder).select(name("q", "query_id").alias("_id"), "text").write.json(f"{place}/queries.jsonl")
    good = written(_matches(spark, folder))
    judged = good.select(name("q", "query_id").alias("query-id"), name("d", "doc_id").alias("corpus-id"), (1 + F.col("doc_id") % 2).alias("score"))
    off = good.select(name("q", "query_id"), F.lit("d0x"), F.lit(0))
    judged.unionByName(off.toDF(*judged.columns)).write.csv(f"{place}/qrels/test.tsv", sep="\t", header=True)
    read = readers.read_judged_corpus(spark, place)
    rows = read["qrels"].join(read["docs"], "doc_id").join(read["queries"].withColumnRenamed("text", "question"), "query_id")
    return rows.select("query_id", "doc_id", "grade", T.content_hash("text").alias("doc_hash"), T.content_hash("question").alias("query_hash"))


@query("SC10", sql="""SELECT 'q' || conv_id AS question_id, 0 AS session, '2024-01-01' AS date, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS turn, role, sha256(text) AS hash
    FROM conversations WHERE conv_id % 9 <> 0""")
def stored_memories(spark, folder):
    """Conversations as long-memory items; every ninth lacks the dates of its sessions and is left out."""
    turns = A.table(spark, folder, "conversations")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    said = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    name = F.concat(F.lit("q"), "conv_id")
    item = F.struct(
        name.alias("question_id"), F.lit("single").alias("question_type"), F.lit("what?").alias("question"), F.col("conv_id").alias("answer"),
        F.lit("2024-02-01").alias("question_date"), F.array(said).alias("haystack_sessions"),
        F.when(F.col("conv_id") % 9 != 0, F.array(F.lit("2024-01-01"))).alias("haystack_dates"), F.array(name).alias("answer_session_ids"),
    )
    # a file is a JSON list
    files = listed.select(F.to_json(item).alias("value"), _files(listed, "conv_id").alias("g"))
    merged = files.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    place = _place(spark)
    _one_file_each(merged, "g", "value", place)
    _, read, _ = readers.read_longmem(spark, place)
    return read.select("question_id", "session", "date", "turn", "role", T.content_hash("content").alias("hash"))


@query("SC4", sql="SELECT sha256(text) AS hash, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def stored_texts(spark, folder):
    """Documents as text files in folders by language; files of other kinds are not read."""
    place = _place(spark)
    docs = A.table(spark, folder, "documents").where("text <> ''")
    _one_file_each(docs, "lang", "text", f"{place}/texts")
    docs.select("doc_id").write.json(f"{place}/other")
    texts, failed = readers.read_text_files(spark, place)
    every = texts.select(F.explode(F.split("text", "\x1e")).alias("text")).where("text <> ''")
    return every.unionByName(failed.select(F.col("error").alias("text"))).groupBy(T.content_hash("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"))


_PATH = "CASE WHEN doc_id % 5 = 0 THEN '.git/' WHEN doc_id % 5 = 1 THEN 'notes/' ELSE lang || '/' END || 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.MD' WHEN doc_id % 3 = 1 THEN '.html' ELSE '.bin' END"


@query("F8", sql=f"SELECT path, doc_id % 3 <> 2 AND doc_id % 5 > 1 AS watched FROM (SELECT doc_id, {_PATH} AS path FROM documents)")
def watched_files(spark, folder):
    named = A.table(spark, folder, "documents").select(F.expr(_PATH).alias("path"))
    return named.select("path", readers.watchable(F.col("path")).alias("watched"))


@query("SC6", sql="""WITH f AS (SELECT lang || '/' || format('d{:07d}.md', doc_id) AS path, 'Doc ' || (doc_id // 2) AS title, lang, source FROM documents WHERE NOT (lang = 'es' AND doc_id % 2 = 1)),
    k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY title ORDER BY path) = 1)
    SELECT lower(replace(title, ' ', '-')) AS note_id, title, lang AS folder, lang || ' ' || source AS tags, 'A part of ' || source || '.' AS summary, 'Doc 1 of ' || source AS targets FROM k""")
def imported_vault(spark, folder):
    """Documents as pages of a vault; two share a title, so the first path wins; some are empty."""
    docs = A.table(spark, folder, "documents")
    page = F.concat(
        F.lit('---\ntitle: "Doc '), F.floor(F.col("doc_id") / 2), F.lit('"\ntags: ['), "lang", F.lit(", #"), "source", F.lit("]\n---\n# Head\n\nA  part\nof "), "source",
        F.lit(".\n\n## More\n[[Doc 1 of "), "source", F.lit("#x|y]] and [[Doc 1 of "), "source", F.lit("]]\n"),
    )
    text = F.when((F.col("lang") == "es") & (F.col("doc_id") % 2 == 1), F.lit(" \n")).otherwise(page)
    files = docs.select(F.concat("lang", F.lit("/"), F.format_string("d%07d.md", "doc_id")).alias("path"), text.alias("text"))
    notes = readers.import_vault(files)["notes"]
    return notes.select(
        "note_id", "title", "folder", F.array_join("tags", " ").alias("tags"), "summary",
        F.array_join(F.transform("relations", lambda r: r["target"]), ";").alias("targets"),
    )


@query("SK3", sql=f"WITH {_FED} SELECT source AS collection_id, count(*) AS n, (SELECT count(*) FROM collections WHERE NOT federated) AS skipped FROM rows GROUP BY source")
def stored_federation(spark, folder):
    """Federated rows written by collection, and the report beside them."""
    place = _place(spark)
    done = FE.federate(collection_notes(spark, folder), A.collections(spark, folder))
    writers.write_federated(done["rows"], done["report"], place)
    skipped = spark.read.parquet(f"{place}/report").where("skipped <> ''").agg(F.count(F.lit(1))).scalar()
    return spark.read.parquet(f"{place}/rows").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n")).withColumn("skipped", skipped)


@query("SK4", "G1", sql=f"""SELECT 'node' AS part, kind, count(*) AS n FROM ({ORACLE['graph_nodes']}) GROUP BY kind
    UNION ALL SELECT 'edge', type, count(*) FROM ({ORACLE['graph_edges']}) GROUP BY type""")
def stored_graph(spark, folder):
    """The graph written, and counted from what was written."""
    place = _place(spark)
    writers.write_graph(*G.build_graph(_noted(spark, folder)), place)
    return G.graph_counts(spark.read.parquet(f"{place}/nodes"), spark.read.parquet(f"{place}/edges"))


@query("SK5", sql="SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def appended_log(spark, folder):
    """Events appended in two writes."""
    place = _place(spark)
    events = A.table(spark, folder, "events").select("user_id", "event_id")
    for part in range(2):
        writers.append_log(events.where(F.col("event_id") % 2 == part), place)
    return spark.read.parquet(place).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


_SCANNED = "lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.bin' ELSE '.txt' END"


def _scanned(spark, folder):
    docs = A.table(spark, folder, "documents").withColumn("path", F.expr(_SCANNED))
    files = docs.select("path", F.octet_length("text").alias("bytes"), F.substring(F.encode("text", "UTF-8"), 1, 1024).alias("head"))
    return readers.scan_tree(files, []), docs.select("path", "text")


_PLAN = f"""f AS (SELECT doc_id, {_SCANNED} AS path, strlen(text) AS bytes, CASE lang WHEN 'fr' THEN 'code' ELSE 'docs' END AS category FROM documents WHERE lang <> 'de' AND strlen(text) <= 1000000)"""


@query("A23", sql=f"""WITH {_PLAN} SELECT category, count(*) AS files, sum(bytes)::BIGINT AS bytes, (sum(bytes) // 4)::BIGINT AS est_tokens, count(*) AS est_llm_calls FROM f GROUP BY ROLLUP (category)""")
def scan_sums(spark, folder):
    plan, _ = _scanned(spark, folder)
    return readers.scan_totals(plan)


@query("A23", "P13", sql=f"WITH {_PLAN} SELECT path, kind, line, n FROM f JOIN ({ORACLE['secret_findings']}) USING (doc_id)")
def scan_flags(spark, folder):
    """The secrets in the files that a scan would take."""
    found = readers.secret_flags(*_scanned(spark, folder))
    return found.groupBy("path", "kind", "line").agg(F.count(F.lit(1)).alias("n"))


@query("X2", sql=f"""WITH c AS (SELECT conv_id, turn, 'Is this grounded? ' || text AS prompt FROM conversations WHERE role = 'assistant'),
    v AS (SELECT prompt, count(*) AS asked, CASE WHEN length(prompt) % 3 = 0 THEN 'correct' WHEN length(prompt) % 3 = 1 THEN 'partial' ELSE 'wrong' END AS verdict FROM c GROUP BY prompt)
    SELECT conv_id, turn, verdict, (SELECT count(*) FROM v) AS prompts FROM c JOIN v USING (prompt)""")
def judged_answers(spark, folder):
    """Answers judged once per distinct prompt; the verdicts come back by the prompt's hash."""
    answers = A.table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    prompt = F.concat(F.lit("Is this grounded? "), "text")
    asked = written(PR.judge_prompts(answers, prompt))
    word = F.element_at(F.array(F.lit("It is CORRECT."), F.lit("partial, I think"), F.lit("no")), F.length("prompt") % 3 + 1)
    told = PR.with_verdicts(answers, prompt, asked.select("prompt_id", word.alias("answer")))
    return told.select("conv_id", "turn", PR.correctness("answer").alias("verdict"), asked.agg(F.count(F.lit(1))).scalar().alias("prompts"))



@query("T8", "T5", "T6", sql=f"""WITH {O.NOTES}, n AS (SELECT note_id, doc_id, lang, summary, lang = 'de' AND doc_id % 2 = 0 AS fixed,
      EXISTS (SELECT 1 FROM notes p WHERE p.doc_id = n.doc_id - 1 AND p.lang = 'fr') AS follows FROM notes n)
    SELECT note_id, CASE WHEN fixed THEN 'fixed ' || note_id ELSE summary END AS summary, fixed::INTEGER + follows::INTEGER AS old_versions,
      CASE WHEN follows THEN format('d{{:07d}}', doc_id - 1) ELSE '' END AS supersedes,
      CASE WHEN fixed THEN 2 ELSE 0 END + CASE WHEN lang = 'fr' AND doc_id + 1 IN (SELECT doc_id FROM notes) THEN 1 ELSE 0 END AS claims, 1 AS version FROM n""")
def applied_reviews(spark, folder):
    """German notes with a correction each, of which the even ones are applied; French ones hand over to the next note.
    The decisions come twice, and once more with other words."""
    from lorekeep.operators import ledger as LE
    from lorekeep.operators import store
    from lorekeep.plans.time_queries import _claim_table

    now, place = F.lit("2030-01-01").cast("timestamp"), _place(spark)
    relations = F.expr("cast(array() as array<struct<source:string,relation:string,target:string,confidence:double>>)")
    base = A.notes(spark, folder).withColumn("title", F.col("note_id")).withColumn("relations", relations)
    notes = base.drop("doc_id", "source")
    lang, number = F.col("tags")[0], F.col("doc_id")
    fixes = base.where(lang == "de").select(
        F.lit("correction").alias("kind"), "title",
        F.to_json(F.struct("title", F.concat(F.lit("fixed "), "note_id").alias("summary"), F.lit("text").alias("body"))).alias("detail"),
        (number % 2 == 0).alias("yes"),
    )
    following = F.format_string("d%07d", number + 1)
    pairs = base.where(lang == "fr").select(
        F.lit("supersedes").alias("kind"), "title", F.to_json(F.struct(F.col("note_id").alias("old"), following.alias("new"))).alias("detail"), F.lit(True).alias("yes")
    )
    wanted = fixes.unionByName(pairs)
    reviews, _ = LE.add_reviews(wanted.select("kind", "title", "detail"), F.lit("2029-01-01").cast("timestamp"))
    empty = notes.limit(0)
    store.commit(spark, place, 0, {"notes": notes, "history": empty, "claims": _claim_table(spark, folder).limit(0), "reviews": reviews})
    said = store.read_store(spark, place)[1]["reviews"].join(wanted.select("title", "kind", "yes"), ["title", "kind"])
    decisions = said.select("item_id", F.when(F.col("yes"), "applied").otherwise("rejected").alias("decision"), F.lit("").alias("reason"))
    for told in (decisions, decisions, decisions.withColumn("decision", F.lit("applied"))):
        version = store.apply_decisions(spark, place, told, now)
    held = store.read_store(spark, place)[1]
    old = held["history"].groupBy("note_id").agg(F.count(F.lit(1)).cast("int").alias("old_versions"))
    claimed = held["claims"].groupBy("note_id").agg(F.count(F.lit(1)).cast("int").alias("claims"))
    targets = F.array_join(F.transform("relations", lambda r: r["target"]), " ").alias("supersedes")
    rows = held["notes"].select("note_id", "summary", targets).join(old, "note_id", "left").join(claimed, "note_id", "left")
    return rows.fillna(0, ["old_versions", "claims"]).withColumn("version", F.lit(version))
