"""Check SQL of the operators that SQL can express."""

from __future__ import annotations

PERSPECTIVES = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT t.conv_id, s.speaker, t.n, t.role, length(t.text) AS size,
         '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.speaker THEN 'assistant'
              ELSE 'user name=' || t.role END || chr(10) || t.text || '<|im_end|>' || chr(10) AS piece
  FROM t JOIN s USING (conv_id)
), e AS (
  SELECT *, CAST((n - 1) // 256 AS INTEGER) AS part,
         sum(length(piece)) OVER (PARTITION BY conv_id, speaker, (n - 1) // 256 ORDER BY n) AS upto,
         sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY n) AS whole
  FROM p
)
SELECT conv_id, speaker, part, CAST(max(whole) - max(upto) AS BIGINT) AS "offset",
       string_agg(piece, '' ORDER BY n) AS rendered,
       coalesce(string_agg(CAST(CAST(upto - size - 11 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(upto - 1 AS INTEGER) AS VARCHAR), ',' ORDER BY n)
         FILTER (WHERE role = speaker), '') AS mask,
       CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE role = speaker) AS INTEGER) AS n_own
FROM e GROUP BY conv_id, speaker, part
"""

RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), p AS (
  SELECT r, doc_id, term, count(*) AS tf, 75 + 25 * n * n_docs // n_terms AS m
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d), s GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term
), q AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY ALL HAVING sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= 20
"""


def mixing_sql(share: float = 0.5, tempers=(0.5, 0.7, 0.5), rounds: int = 12, seed: int = 11) -> str:
    """Raking written out as nested windows over the cells."""
    # fixed values: the same patterns as the operator's default topics
    marked = f"""
SELECT doc_id, text, coalesce(source, '\\N') AS s, coalesce(lang, '\\N') AS l,
  CASE WHEN regexp_matches(text, '(?i)licen[cs]ed? under|copyright|all rights reserved') THEN 'legal'
       WHEN regexp_matches(text, '(?i)(password|token|api_?key)\\s*=') THEN 'secrets'
       WHEN regexp_matches(text, 'https?://|www\\.|\\b[\\w.]+@[\\w.]+\\.\\w+') THEN 'web'
       WHEN regexp_matches(text, '\\|[^|]+\\|[^|]+\\|') THEN 'tables'
       WHEN regexp_matches(text, '!!') THEN 'loud' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens,
  CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)
    / 4503599627370496.0 AS u
FROM documents"""
    margins = ("s", "l", "topic")
    cells = "SELECT s, l, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS fitted FROM m GROUP BY ALL"
    for name, temper in zip(margins, tempers, strict=True):
        cells = f"""
SELECT * EXCLUDE (p, k), p / sum(p / k) OVER () AS t_{name} FROM (
  SELECT *, CASE WHEN sum(tokens) OVER (PARTITION BY {name}) > 0 THEN pow(sum(tokens) OVER (PARTITION BY {name}), {temper}) ELSE 0 END AS p,
         count(*) OVER (PARTITION BY {name}) AS k FROM ({cells}))"""
    cells = f"SELECT *, sum(tokens) OVER () AS total FROM ({cells})"
    for _ in range(rounds):
        for name in margins:
            cells = f"""
SELECT * EXCLUDE (own, fitted), CASE WHEN own > 0 THEN fitted * t_{name} * total / own ELSE 0 END AS fitted FROM (
  SELECT *, sum(fitted) OVER (PARTITION BY {name}) AS own FROM ({cells}))"""
    plan = f"SELECT *, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 0 END AS f, 0.0::DOUBLE AS probability FROM ({cells})"
    for _ in range(8):
        plan = f"""
SELECT * EXCLUDE (probability, filled, free), CASE WHEN probability >= 1 THEN 1.0 WHEN free > 0
  THEN least(1.0, greatest(0.0, f * (total * {share} - filled) / free)) ELSE 0.0 END AS probability FROM (
  SELECT *, sum(CASE WHEN probability >= 1 THEN tokens ELSE 0 END) OVER () AS filled,
         sum(CASE WHEN probability < 1 THEN fitted ELSE 0 END) OVER () AS free FROM ({plan}))"""
    return f"""
WITH m AS ({marked}), plan AS ({plan})
SELECT doc_id, topic, n_tokens, round(probability, 9) AS probability, u < probability AS drawn
FROM m JOIN plan USING (s, l, topic)"""


def url_sql(rules: list[tuple[str, str]], damping: float = 0.85, threshold: float = 0.5, rounds: int = 150) -> str:
    """Rules by suffix and prefix; the masses of both directions carried on by a recursive table."""
    # fixed value: the operator's pattern of a link with a host of its own
    link = """(?i)<a[ \\t\\n\\r\\f][^<>]*?href[ \\t\\n\\r\\f]*=[ \\t\\n\\r\\f]*["'']?[ \\t\\n\\r\\f]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<> \\t\\n\\r\\f]+)"""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    told = ", ".join(f"('{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for v, r in rules)

    def carried(mass: str, source: str, target: str) -> str:
        return f"""
  SELECT 0 AS k, host, CAST({mass} AS DOUBLE) AS m FROM seeds
  UNION ALL
  SELECT k + 1, l.{target}, {damping} * sum(m * l.n / l.own) FROM {mass}_flow
  JOIN (SELECT *, sum(n) OVER (PARTITION BY {source}) AS own FROM links) l ON {mass}_flow.host = l.{source}
  WHERE k < {rounds} GROUP BY ALL"""

    return f"""
WITH RECURSIVE rules(rule, h, q, verdict) AS (VALUES {told}),
p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {lower}) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), best AS (
  SELECT host, path, rule, verdict FROM (SELECT DISTINCT host, path FROM p)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, length(h) DESC, verdict DESC) = 1
), judged AS (SELECT p.*, rule, verdict FROM p LEFT JOIN best USING (host, path)
), seeds AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END) AS good, avg(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) AS bad
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT a, b, count(*) AS n FROM (
    SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS b FROM p WHERE host <> '')
  WHERE a <> b GROUP BY ALL
), good_flow AS ({carried("good", "a", "b")}
), bad_flow AS ({carried("bad", "b", "a")}
), hosts AS (
  SELECT host, sum(g) - sum(d) AS over FROM (
    SELECT host, 0.0 AS g, m AS d FROM good_flow UNION ALL SELECT host, m, 0.0 FROM bad_flow) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN over > {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hosts USING (host)"""
