"""SQL fragments for the independent check of the queries (DuckDB dialect)."""

from __future__ import annotations

from lorekeep.functions import text as T

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD_CHAR = r"[\pL\pN_]"


def _suffix(names, keep):
    return f"^(.{{{keep},}}?)({'|'.join(names)})$"


IT, EN = _suffix(T.STEM_SUFFIXES, 3), _suffix(T.STEM_SUFFIXES_EN, 4)


def stem(x: str) -> str:
    for pattern in (IT, EN, IT):
        x = f"regexp_replace({x}, '{pattern}', '\\1')"
    return x


def tokens(expr: str) -> str:
    return (
        f"list_transform(regexp_extract_all(lower({expr}), '[a-z0-9][a-z0-9-]{{2,}}'), "
        f"lambda x: {stem('x')})"
    )


def grams(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in ``name(key, gram, pos)``: distinct trigrams with their first position."""
    found = f"regexp_extract_all(lower({text}), '[a-zà-ÿ0-9]+')"
    return f"""
    {name}_w AS (SELECT {key}, unnest({found}) AS w, generate_subscripts({found}, 1) AS wi FROM {source}),
    {name}_i AS (SELECT {key}, w, wi, unnest(range(1, length(w) - 1)) AS i FROM {name}_w WHERE length(w) >= 3),
    {name} AS (SELECT {key}, substr(w, i, 3) AS gram, min(wi * 1000000 + i) AS pos
               FROM {name}_i GROUP BY ALL)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def estimate(x: str) -> str:
    return f"greatest(length({x}) // 4, len({words(x)}))"


def slug(x: str) -> str:
    s = f"regexp_replace({strip(x)}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g')"
    s = f"regexp_replace({s}, '[{WS}]+', '-', 'g')"
    s = f"regexp_replace({s}, '^[. ]+|[. ]+\\z', '', 'g')"
    return f"coalesce(nullif({s}, ''), 'untitled')"


def dash(x: str, keep: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^{keep}]+', '-', 'g'), '^-+|-+\\z', '', 'g')"


NOTES = """notes AS (
    SELECT printf('d%07d', d.doc_id) AS note_id, d.doc_id, d.source, d.lang,
           split_part(d.text, chr(10), 1) AS title, coalesce(nullif(split_part(d.text, chr(10), 2), ''), split_part(d.text, chr(10), 1)) AS summary,
           d.text AS retrieval_text, d.text,
           CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence,
           TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS updated_at
    FROM documents d LEFT JOIN labels l USING (doc_id))"""

HAYSTACK = "title||' '||title||' '||title||'     '||lang||' '||retrieval_text||' '||summary"
PLAIN = "title||'  '||lang||' '||retrieval_text||' '||summary"

QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"

QRELS = """qrels AS (
    SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""


def bm25(docs: str, doc_key: str, text: str, toks=tokens, prefix: str = "b") -> str:
    """CTEs ending in ``{prefix}_scores(query_id, doc_key, score)``; repeats in a query count."""
    return f"""
    {prefix}_len AS (SELECT {doc_key}, len({toks(text)}) AS dl FROM {docs}),
    {prefix}_tf AS (SELECT {doc_key}, term, count(*) AS tf FROM
        (SELECT {doc_key}, unnest({toks(text)}) AS term FROM {docs}) GROUP BY ALL),
    {prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term),
    {prefix}_q AS (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT query_id, unnest({toks('text')}) AS term FROM questions) GROUP BY ALL),
    {prefix}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {prefix}_len),
    {prefix}_scores AS (
        SELECT query_id, {doc_key}, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
               / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM {prefix}_q JOIN {prefix}_tf USING (term) JOIN {prefix}_df USING (term)
        JOIN {prefix}_len USING ({doc_key}), {prefix}_n GROUP BY ALL)"""


def field_rows() -> str:
    """CTEs ending in ``post(field, term, note_id, tf)`` and ``dls(field, note_id, dl)``."""
    return f"""
    {NOTES},
    {grams('notes', 'note_id', 'title', 'tt')},
    {grams('notes', 'note_id', 'summary', 'ts')},
    post AS (
        SELECT 'haystack' AS field, term, note_id, count(*) AS tf FROM
            (SELECT note_id, unnest({tokens(HAYSTACK)}) AS term FROM notes) GROUP BY ALL
        UNION ALL SELECT 'tri_title', gram, note_id, 1 FROM tt
        UNION ALL SELECT 'tri_summary', gram, note_id, 1 FROM ts),
    dls AS (
        SELECT f.field, n.note_id, coalesce(s.dl, 0)::BIGINT AS dl
        FROM notes n CROSS JOIN (VALUES ('haystack'), ('tri_title'), ('tri_summary')) f(field)
        LEFT JOIN (SELECT field, note_id, sum(tf) AS dl FROM post GROUP BY ALL) s
        ON s.field = f.field AND s.note_id = n.note_id),
    stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM dls GROUP BY field)"""


def index_search(limit: int, questions: str = QUESTIONS) -> str:
    """CTEs ending in ``hits(query_id, note_id, rank, score)`` of the three-channel search."""
    return f"""
    {questions},
    {field_rows()},
    {grams('questions', 'query_id', 'text', 'qg')},
    qt AS (
        SELECT DISTINCT query_id, 'haystack' AS field, unnest({tokens('text')}) AS term FROM questions
        UNION ALL
        SELECT query_id, f.field, gram FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM qg),
            (VALUES ('tri_title'), ('tri_summary')) f(field) WHERE rn <= 64),
    dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
    chan AS (
        SELECT query_id, note_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
               / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))) AS s
        FROM qt JOIN post USING (field, term) JOIN dfs USING (field, term)
        JOIN dls USING (field, note_id) JOIN stats USING (field) GROUP BY ALL),
    mono AS (SELECT CASE WHEN round(avg(CASE WHEN regexp_matches(title||' '||summary||' '||retrieval_text, '[à-ÿ]')
                    THEN 1.0 ELSE 0.0 END), 4) < 0.05 THEN 0.3 ELSE 1.0 END AS scale FROM notes),
    blend AS (
        SELECT query_id, note_id, sum(s / top * CASE field WHEN 'haystack' THEN 1.0
               WHEN 'tri_title' THEN 0.7 * scale ELSE 0.3 * scale END) AS raw
        FROM (SELECT *, max(s) OVER (PARTITION BY query_id, field) AS top FROM chan), mono GROUP BY ALL),
    damped AS (
        SELECT query_id, note_id, CASE WHEN m > 0 THEN raw * m / (m + 0.5 * dl) ELSE raw END AS sc FROM (
            SELECT b.*, d.dl, avg(d.dl) OVER (PARTITION BY query_id) AS m
            FROM blend b JOIN dls d ON d.note_id = b.note_id AND d.field = 'haystack')),
    hits AS (
        SELECT query_id, note_id, rank, round(sc, 4) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, note_id) AS rank FROM damped)
        WHERE rank <= {limit})"""


def exact_name(query: str, name: str) -> str:
    """Whole-word containment with the Unicode word boundary spelt out."""
    n = f"lower({strip(name)})"
    left = f"CASE WHEN regexp_matches(left({n}, 1), '{WORD_CHAR}') THEN '(^|[^\\pL\\pN_])' ELSE '{WORD_CHAR}' END"
    right = f"CASE WHEN regexp_matches(right({n}, 1), '{WORD_CHAR}') THEN '([^\\pL\\pN_]|$)' ELSE '{WORD_CHAR}' END"
    return f"({n} <> '' AND regexp_matches(lower({query}), {left} || regexp_escape({n}) || {right}))"


def product_search(limit: int, questions: str = QUESTIONS) -> str:
    """CTEs ending in ``found(query_id, rank, title, summary)`` of the reranked search."""
    return f"""
    {index_search(2 * limit, questions)},
    byt AS (
        SELECT query_id, title, arg_max(score, rank) AS score, arg_max(summary, rank) AS summary
        FROM hits JOIN notes USING (note_id) GROUP BY ALL),
    rr AS (
        SELECT b.query_id, b.title, b.summary, CASE WHEN top > 0 THEN b.score / top ELSE 0 END
               + CASE WHEN {exact_name('q.text', 'b.title')} THEN 0.5 ELSE 0 END AS sc
        FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM byt) b JOIN questions q USING (query_id)),
    found AS (
        SELECT query_id, rank, title, summary FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, title DESC) AS rank FROM rr)
        WHERE rank <= {limit})"""


def relations() -> str:
    return """
    rel AS (
        SELECT 'region:'||r_name AS source, 'contains' AS relation, 'nation:'||n_name AS target
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'nation:'||n_name, 'contains', 'supplier:'||s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'region:'||r_name, 'contains', 'supplier:'||s_suppkey FROM supplier
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'supplier:'||s, 'supplies', 'part:'||p FROM (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem)
        UNION ALL SELECT 'part:'||p, 'comes from', 'supplier:'||s FROM (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem) WHERE p % 2 = 0
        UNION ALL SELECT 'nation:'||a, 'borders', 'nation:'||b FROM ring WHERE b IS NOT NULL
        UNION ALL SELECT 'nation:'||b, 'borders', 'nation:'||a FROM ring WHERE b IS NOT NULL)"""


RING = """ring AS (SELECT n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)"""

CLAIMS = """claims AS (
    SELECT o_orderkey AS claim_id, o_custkey AS note_id, o_orderstatus AS text, o_orderdate AS valid_from,
           lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""

VERSIONS = """versions AS (
    SELECT o_custkey AS note_id, o_orderdate AS updated_at, o_orderkey AS seq, o_orderpriority AS summary FROM orders)"""

JOBS = """jobs AS (
    SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
           WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events)"""

COLLECTIONS = """collections AS (
    SELECT DISTINCT source AS collection_id, source AS name, substr(source, 4)::INT AS k,
           CASE WHEN k = 0 THEN 'central' WHEN k % 2 = 0 THEN 'archive' ELSE 'project' END AS type,
           k % 5 <> 0 AS federated, k % 7 = 0 AS sensitive FROM documents)"""

CHAIN = """chain AS (
    SELECT title AS source, CASE WHEN lang = next_lang THEN 'part-of' ELSE 'related' END AS type, next_title AS target
    FROM (SELECT title, lang, lead(title) OVER w AS next_title, lead(lang) OVER w AS next_lang FROM notes
          WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    WHERE next_title IS NOT NULL AND next_title <> title GROUP BY ALL)"""
