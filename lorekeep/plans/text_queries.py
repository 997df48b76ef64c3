"""Queries over the scalar text functions and the text preparation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import markdown
from lorekeep.functions import shapes as S
from lorekeep.functions import text as T
from lorekeep.operators import curation
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans.registry import query
from lorekeep.session import fan_out
from lorekeep.sources import readers


def _docs(spark, folder):
    return fan_out(A.table(spark, folder, "documents"))


@query("P1", sql=f"SELECT doc_id, array_to_string({O.tokens('text')}, ' ') AS tokens, len({O.tokens('text')}) AS n FROM documents")
def tokens(spark, folder):
    stems = _docs(spark, folder).select("doc_id", T.tokens("text").alias("t"))
    return stems.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query("P2", sql=f"""WITH {O.grams('documents', 'doc_id', 'text', 'g')}
    SELECT d.doc_id, coalesce(x.grams, '') AS grams FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(gram, ' ' ORDER BY pos) AS grams FROM g GROUP BY doc_id) x USING (doc_id)""")
def trigrams(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(T.trigrams("text"), " ").alias("grams"))


@query("P3", sql=f"""WITH {O.grams('benchmark', 'item_id', 'text', 'g')},
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM g)
    SELECT item_id, string_agg(gram, ' ' ORDER BY rn) AS grams FROM r WHERE rn <= 64 GROUP BY item_id""")
def query_trigrams(spark, folder):
    items = A.table(spark, folder, "benchmark")
    return items.select("item_id", F.array_join(T.query_trigrams("text"), " ").alias("grams"))


@query("P4", sql=f"WITH {O.NOTES} SELECT note_id, array_to_string({O.tokens(O.HAYSTACK)}, ' ') AS haystack FROM notes")
def haystack(spark, folder):
    return A.notes(spark, folder).select("note_id", F.array_join(T.tokens(T.haystack_text()), " ").alias("haystack"))


@query("P5", sql=f"""WITH {O.NOTES} SELECT note_id, {O.slug('title')} AS slug,
    'note:' || {O.dash('title', 'a-z0-9._/-')} AS node_id,
    'dom-' || coalesce(nullif({O.dash('title', 'a-z0-9')}, ''), 'x') AS domain_id,
    'rel:' || {O.dash('title', 'a-z0-9-')} AS type_id FROM notes""")
def slugs(spark, folder):
    return A.notes(spark, folder).select(
        "note_id", T.note_slug("title").alias("slug"), T.node_id("note", "title").alias("node_id"),
        T.domain_slug("title").alias("domain_id"), T.type_id("title").alias("type_id"),
    )


@query("P6", sql="SELECT doc_id, 'sha256:' || sha256(text) AS source_hash, left(sha256(text), 8) AS digest FROM documents")
def content_hash(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", T.source_hash("text").alias("source_hash"), T.digest8("text").alias("digest")
    )


@query("P9", sql=f"""WITH l AS (
      SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '{O.LINE_END}'),
        lambda v: {O.strip("regexp_replace(" + O.strip('v') + ", '^[>*| -]+', '')")}),
        lambda v: v <> '' AND NOT regexp_matches(v, '^(```|\\||!\\[)')) AS lines,
        list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda b: array_to_string({O.words('b')}, ' ')),
        lambda b: b <> '' AND NOT starts_with(b, '#')) AS paras FROM documents)
    SELECT doc_id, left(coalesce(lines[1], {O.strip('text')}), 200) AS first_line,
           left(coalesce(paras[1], ''), 240) AS first_paragraph FROM l""")
def first_lines(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", T.first_line("text").alias("first_line"), T.first_paragraph("text").alias("first_paragraph")
    )


@query("P11", sql=f"SELECT doc_id, {O.estimate('text')}::BIGINT AS est_tokens FROM documents")
def estimate_tokens(spark, folder):
    return _docs(spark, folder).select("doc_id", T.estimate_tokens("text").cast("bigint").alias("est_tokens"))


_KEYWORDS = r"(api[_-]?key|secret|token|passwd|password|client[_-]?secret)"
_SEP = f"[{O.WS}]*[:=][{O.WS}]*"
_LEAD = r"(^|[^\pL\pN_])"
# kind -> check pattern whose first group is the character before the match
_SECRET_SQL = {
    "aws-access-key": _LEAD + r"(AKIA|ASIA)[0-9A-Z]{16}\b",
    "private-key-block": r"()-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer-token": r"(?i)" + _LEAD + rf"Bearer[{O.WS}]+[A-Za-z0-9._~+/-]{{20,}}=*",
    "github-token": _LEAD + r"gh[pousr]_[A-Za-z0-9]{20,}\b",
    "slack-token": _LEAD + r"xox[baprs]-[A-Za-z0-9-]{10,}\b",
    "generic-assignment": r"(?i)" + _LEAD + _KEYWORDS + _SEP + r"[\x22\x27]?[A-Za-z0-9_\-./+]{12,}[\x22\x27]?",
}


def _redaction_sql():
    ctes, value = [], "text"
    for i, (kind, pattern) in enumerate(_SECRET_SQL.items()):
        source = "documents" if i == 0 else f"s{i - 1}"
        before = "0" if i == 0 else "n"
        ctes.append(
            f"s{i} AS (SELECT doc_id, {before} + len(regexp_extract_all({value}, '{pattern}')) AS n, "
            f"regexp_replace({value}, '{pattern}', '\\1[REDACTED:{kind}]', 'g') AS text FROM {source})"
        )
    last = f"s{len(_SECRET_SQL) - 1}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, sha256(text) AS redacted_hash, n::BIGINT AS n_redacted FROM {last}"


@query("P12", sql=_redaction_sql())
def redact(spark, folder):
    done = _docs(spark, folder).select("doc_id", T.redact("text").alias("r"))
    return done.select(
        "doc_id", T.content_hash("r.text").alias("redacted_hash"), F.col("r.count").cast("bigint").alias("n_redacted")
    )


def _finding_sql():
    """A mark before every match; the lines with marks."""
    parts = []
    for kind, pattern in _SECRET_SQL.items():
        lead = "()" if pattern.startswith("()") else _LEAD
        flags, rest = pattern.split(lead, 1)
        parts.append(
            f"SELECT '{kind}' AS kind, doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS v FROM (SELECT doc_id, "
            f"string_split(regexp_replace(text, '{flags}{lead}({rest})', '\\1' || chr(1) || '\\2', 'g'), chr(10)) AS l FROM documents)"
        )
    return f"SELECT kind, doc_id, line::INTEGER AS line, (length(v) - length(replace(v, chr(1), '')))::BIGINT AS n FROM ({' UNION ALL '.join(parts)}) WHERE contains(v, chr(1))"


@query("P13", sql=_finding_sql())
def secret_findings(spark, folder):
    return T.find_secrets(_docs(spark, folder)).groupBy("kind", "doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


_FILE_NAME = "case lang when 'en' then '.env.' || source when 'fr' then source || '.PEM' when 'de' then source || '.md' else 'id_rsa_' || source end"


@query("P14", sql=f"""SELECT doc_id, {_FILE_NAME} AS name,
    lower({_FILE_NAME}) IN ({', '.join(repr(n) for n in T.SECRET_FILE_NAMES)})
    OR regexp_matches(lower({_FILE_NAME}), '^(id_rsa|id_ed25519|id_dsa|\\.env\\.)')
    OR regexp_matches(lower({_FILE_NAME}), '.(\\.pem|\\.key|\\.pfx|\\.p12|\\.keystore|\\.jks)$') AS secret FROM documents""")
def secret_files(spark, folder):
    named = _docs(spark, folder).select("doc_id", F.expr(_FILE_NAME).alias("name"))
    return named.select("doc_id", "name", T.is_secret_file("name").alias("secret"))


@query("P15", sql="""WITH raw AS (
      SELECT o_orderkey, o_orderdate AS d, unnest(['year', 'month', 'day', 'naive', 'zoned', 'bad']) AS form FROM orders)
    SELECT o_orderkey, form,
      CASE form WHEN 'year' THEN make_timestamp(year(d), 12, 31, 23, 59, 59)
        WHEN 'month' THEN last_day(d)::TIMESTAMP + INTERVAL '23:59:59' HOUR TO SECOND
        WHEN 'day' THEN date_trunc('day', d) + INTERVAL '23:59:59' HOUR TO SECOND
        WHEN 'naive' THEN date_trunc('second', d)
        WHEN 'zoned' THEN date_trunc('second', d) - INTERVAL 2 HOUR END AS instant,
      form = 'naive' AS warned, form = 'bad' AS failed FROM raw""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))
def parse_when(spark, folder):
    d = F.col("o_orderdate")
    forms = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "naive": "yyyy-MM-dd'T'HH:mm:ss",
             "zoned": "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "bad": "dd/MM/yyyy"}
    rows = F.array(*[F.struct(F.lit(k).alias("form"), F.date_format(d, f).alias("raw")) for k, f in forms.items()])
    raw = A.table(spark, folder, "orders").select("o_orderkey", F.explode(rows).alias("x"))
    out = raw.select("o_orderkey", "x.form", T.parse_when("x.raw").alias("w"))
    return out.select(
        "o_orderkey", "form", "w.instant", F.col("w.warning").isNotNull().alias("warned"),
        F.col("w.error").isNotNull().alias("failed"),
    )


def relation_sql(x: str) -> str:
    low = O.key(x)
    chain = f"CASE WHEN {low} = '' THEN 'related'"
    for name, keywords in T.RELATION_KEYWORDS:
        hits = " OR ".join(f"contains({low}, '{k}')" for k in keywords)
        chain += f" WHEN {hits} THEN '{name}'"
    return chain + " END"


@query("P16", sql=f"SELECT doc_id, coalesce({relation_sql('text')}, 'related') AS type FROM documents")
def normalize_relation(spark, folder):
    return _docs(spark, folder).select("doc_id", F.coalesce(T.fixed_relation("text"), F.lit("related")).alias("type"))


@query("P17", sql=f"WITH {O.NOTES} SELECT note_id, array_to_string({O.tokens('title')}, ' ') AS surface_key FROM notes")
def surface_keys(spark, folder):
    return A.notes(spark, folder).select("note_id", T.surface_key("title").alias("surface_key"))


@query("P18", sql=f"""WITH {O.NOTES}, s AS (SELECT lang, round(avg(CASE WHEN
      regexp_matches(title||' '||summary||' '||retrieval_text, '[à-ÿ]') THEN 1.0 ELSE 0.0 END), 4) AS share FROM notes GROUP BY lang)
    SELECT lang, share, share < 0.05 AS monolingual FROM s""")
def accented_share(spark, folder):
    notes = A.notes(spark, folder).withColumn("lang", F.col("tags")[0])
    shares = notes.groupBy("lang").agg(T.non_ascii_share("title", "summary", "retrieval_text").alias("share"))
    return shares.withColumn("monolingual", F.col("share") < T.MONOLINGUAL_BELOW)


@query("P19", sql=f"""WITH {O.NOTES} SELECT note_id, concat_ws('; ', CASE WHEN {O.strip('title')} = '' THEN 'title is required' END,
    CASE WHEN {O.strip('retrieval_text')} = '' THEN 'retrieval_text is required' END) AS errors FROM notes""")
def note_errors(spark, folder):
    return A.notes(spark, folder).select("note_id", F.array_join(T.validation_errors(), "; ").alias("errors"))


@query("SC5")
def page_texts(spark, folder):
    return fan_out(A.table(spark, folder, "pages")).select("page_id", S.html_to_text("html").alias("text"))


@query("P10")
def chunks(spark, folder):
    return S.split_chunks(_docs(spark, folder)).select(
        "doc_id", "chunk_no", F.length("chunk").alias("chars"), T.content_hash("chunk").alias("hash")
    )


@query("P7", sql=f"""WITH m AS (SELECT doc_id, source, text, regexp_extract_all(text, '(?m)^#[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+(.+)$', 1) AS heads FROM documents)
    SELECT doc_id, greatest(len(heads), 1)::BIGINT AS sections, CASE WHEN len(heads) = 0 THEN source ELSE {O.strip('heads[1]')} END AS first_title FROM m""")
def sections_by_h1(spark, folder):
    texts = _docs(spark, folder).select(F.concat_ws("/", F.col("doc_id").cast("string"), "source").alias("path"), "text")
    return readers.split_sections_h1(texts).groupBy(
        F.substring_index("path", "/", 1).cast("bigint").alias("doc_id")
    ).agg(F.count(F.lit(1)).alias("sections"), F.min_by("title", "section_id").alias("first_title"))


_TIDY = r"""trim(regexp_replace({}, '[*`#✅🟡⏳⭐🎯]|\[|\]|\(http[^)]*\)', '', 'g'), ' -—·.')"""


def _title_sql(x: str) -> str:
    whole = f"array_to_string({O.words(_TIDY.format(x))}, ' ')"
    return f"CASE WHEN length({whole}) > 80 THEN trim(regexp_replace(left({whole}, 80), ' [^ ]*$', ''), ' -—·.') ELSE {whole} END"


def _as_markdown(docs):
    """Documents as Markdown: the first line is the title, every line a section under itself; every third one in a fence."""
    heads = F.transform(
        F.split("text", "\n"), lambda v, i: F.concat(F.lit("## "), v, F.lit("\n"), F.when(i % 3 == 2, F.concat(F.lit("```\n## "), v, F.lit("\n```"))).otherwise(v))
    )
    return docs.select(
        F.format_string("d%07d.md", "doc_id").alias("path"),
        F.concat(F.lit("# "), F.split("text", "\n")[0], F.lit("\n"), F.array_join(heads, "\n")).alias("text"),
    )


@query("P8", sql=f"""WITH l AS (SELECT format('d{{:07d}}.md', doc_id) AS path, string_split(text, chr(10)) AS l FROM documents),
    p AS (SELECT path, l[1] AS first, unnest(range(0, len(l) + 1)) AS pos, unnest(list_prepend('', l)) AS v FROM l),
    f AS (SELECT *, {_title_sql('first')} AS named FROM p)
    SELECT path, CASE WHEN named = '' THEN replace(path, '.md', '') ELSE named END AS doc_title, pos::INTEGER AS pos, CASE WHEN pos = 0 THEN '' ELSE {_title_sql('v')} END AS heading,
      sha256(CASE WHEN pos = 0 THEN '' WHEN pos % 3 = 0 THEN '```' || chr(10) || '## ' || v || chr(10) || '```' ELSE {O.strip('v')} END) AS body_hash FROM f""")
def markdown_parts(spark, folder):
    """Title, heading and body of every ``##`` part; headings in fences are text."""
    parts = markdown.h2_sections(_as_markdown(_docs(spark, folder)))
    return parts.select("path", "doc_title", "pos", "heading", T.content_hash("body").alias("body_hash"))


@query("P8")
def sections_by_h2(spark, folder):
    """The parts as sections with unique titles."""
    return readers.section_titles(_as_markdown(_docs(spark, folder)))


@query("P21")
def code_digests(spark, folder):
    """Pages as files without a Python parser: head lines and signature lines."""
    pages = A.table(spark, folder, "pages").select(F.col("url").alias("path"), S.html_to_text("html").alias("text"))
    return pages.select("path", S.code_digest("path", "text").alias("digest"))


_SESSIONS = f"""s AS (SELECT conv_id, string_agg(role || ': ' || {O.strip('text')}, chr(10) ORDER BY turn) AS transcript
    FROM conversations WHERE {O.strip('text')} <> '' GROUP BY conv_id)"""


@query("P22", "F5", sql=f"""WITH {_SESSIONS} SELECT conv_id, 'sha256:' || sha256(transcript) AS source_hash,
    left(sha256(transcript || chr(10)), 8) AS digest FROM s WHERE length({O.strip('transcript')}) >= 400""")
def remembered_sessions(spark, folder):
    sessions = readers.session_text(A.table(spark, folder, "conversations"))
    return readers.worth_remembering(sessions).select("conv_id", "source_hash", "digest")


@query("SC11", sql=f"""WITH {_SESSIONS} SELECT conv_id, sha256(transcript) AS hash FROM s""")
def transcripts(spark, folder):
    """Conversations written as JSONL transcripts and read back."""
    turns = A.table(spark, folder, "conversations")
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    files = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("j")))), lambda t: t["j"]), "\n").alias("text")
    )
    return readers.read_transcripts(files).select("conv_id", T.content_hash("transcript").alias("hash"))


_REFUSED = " OR ".join(f"""contains(lower(text), '{m.replace("'", "''")}')""" for m in T.REFUSAL_MARKERS)


@query("P23", sql=f"SELECT conv_id, turn, ({_REFUSED}) AS refusal FROM conversations WHERE role = 'assistant'")
def refusals(spark, folder):
    answers = A.table(spark, folder, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", T.is_refusal("text").alias("refusal"))


@query("P25", sql=f"""WITH c AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN {O.estimate('text')} ELSE 0 END) AS ctx,
      sum(CASE WHEN role = 'assistant' THEN {O.estimate('text')} ELSE 0 END) AS ans, sum({O.estimate('text')}) AS ing FROM conversations GROUP BY conv_id)
    SELECT conv_id, round_even(ctx + ans + ing / 1000::DOUBLE, 0)::BIGINT AS tokens_per_answer,
      round((ctx + ans + ing / 1000::DOUBLE) / 1000, 6) AS eur_per_answer FROM c""")
def answer_costs(spark, folder):
    cost = T.estimate_tokens("text")
    said = F.col("role") == "assistant"
    rows = A.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(~said, cost).otherwise(0)).alias("context_tokens"),
        F.sum(F.when(said, cost).otherwise(0)).alias("answer_tokens"),
        F.sum(cost).alias("ingest_tokens"),
    )
    # at a price of 1 the cost has six digits; half a cent more would tie in the seventh, where
    # the two engines round binary fractions differently
    return curation.cost_per_answer(rows, 1000, 1.0).select("conv_id", "tokens_per_answer", "eur_per_answer")


@query("P26", sql=f"""WITH {O.NOTES} SELECT note_id, '- ' || note_id || ' | ' || title || ' — ' || summary || ' — '
    || left({O.strip('text')}, 360) AS brief FROM notes""")
def note_briefs(spark, folder):
    return A.notes(spark, folder).select("note_id", T.note_brief().alias("brief"))


@query("P27", sql=f"""WITH {O.COLLECTIONS} SELECT collection_id, CASE type WHEN 'central' THEN '[central]'
    WHEN 'archive' THEN '[archive:' || name || ']' ELSE '[project:' || name || ']' END AS marker FROM collections""")
def collection_markers(spark, folder):
    return A.collections(spark, folder).select("collection_id", T.collection_marker("type", "name").alias("marker"))


@query("A29", sql="""SELECT doc_id, length(text)::BIGINT AS chars, (length(text) // 4)::BIGINT AS est_input_tokens FROM documents""")
def ingest_estimates(spark, folder):
    return curation.ingest_estimates(_docs(spark, folder)).select(
        "doc_id", F.col("chars").cast("bigint").alias("chars"), "est_input_tokens"
    )
