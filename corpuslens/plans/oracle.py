"""DuckDB SQL building blocks for the independent oracle of each catalogue query.

These strings run in DuckDB over the same parquet tables; they re-derive the
expected rows with plain SQL (unnest, window, group by) rather than with the
array-function formulation the Spark jobs use.
"""

from __future__ import annotations

from corpuslens import rules

LINE_RE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def q(s: str) -> str:
    """SQL string literal that reads the same in Spark SQL and DuckDB (backslashes spelled as chr(92))."""
    if "\\" in s:
        return "(" + " || chr(92) || ".join(q(p) for p in s.split("\\")) + ")"
    return "'" + s.replace("'", "''") + "'"


def docs_files_sql() -> str:
    return ("SELECT source AS repo, lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS path, "
            "text AS content FROM documents")


def kw_score_expr(col: str, keywords) -> str:
    terms = [f"((length(lower({col})) - length(replace(lower({col}), {q(k.lower())}, ''))) // length({q(k)}))"
             for k in keywords]
    return "CAST(" + " + ".join(terms) + " AS BIGINT)"


def n_lines_expr(col: str) -> str:
    return (f"(CASE WHEN {col} = '' THEN 0 WHEN regexp_matches({col}, {q('(?:' + LINE_RE + ')$')}) "
            f"THEN len(string_split_regex({col}, {q(LINE_RE)})) - 1 "
            f"ELSE len(string_split_regex({col}, {q(LINE_RE)})) END)")


def entropy_expr(col: str) -> str:
    return (f"(SELECT -sum(c / len({col}) * log2(c / len({col}))) FROM "
            f"(SELECT count(*) AS c FROM unnest(string_split({col}, '')) AS u(ch) GROUP BY ch))")


def secrets_ctes(files_cte: str, threshold: float, prefix: str = "sec") -> str:
    """CTEs {prefix}_all(repo,path,ord,literal,entropy,line) for kept secrets of files_cte."""
    ph = " OR ".join(f"contains(lower(literal), {q(p)})" for p in rules.SECRET_PLACEHOLDERS)
    return f"""
{prefix}_x AS (
  SELECT repo, path, content, lits, unnest(generate_series(1, len(lits))) AS ord
  FROM (SELECT repo, path, content, regexp_extract_all(content, {q(rules.SECRET_LITERAL_PATTERN)}, 1) AS lits
        FROM {files_cte})
),
{prefix}_e AS (
  SELECT repo, path, content, ord, lits[ord] AS literal FROM {prefix}_x
),
{prefix}_all AS (
  SELECT repo, path, ord, literal, {entropy_expr('literal')} AS entropy,
         list_filter(range(1, len(string_split_regex(content, {q(LINE_RE)})) + 1),
                     lambda i: contains(string_split_regex(content, {q(LINE_RE)})[i], literal))[1] AS line
  FROM {prefix}_e
  WHERE {entropy_expr('literal')} > {threshold} AND NOT ({ph})
)"""


def matched_lines_ctes(files_cte: str, keywords, threshold: float, prefix: str = "ml") -> str:
    """CTE {prefix}(repo, path, line): distinct keyword lines plus secret lines."""
    kw = " OR ".join(f"contains(lower(ls[i]), {q(k.lower())})" for k in keywords)
    return secrets_ctes(files_cte, threshold, prefix + "_s") + f""",
{prefix}_l AS (
  SELECT repo, path, ls, unnest(generate_series(1, len(ls))) AS i
  FROM (SELECT repo, path, string_split_regex(content, {q(LINE_RE)}) AS ls FROM {files_cte})
),
{prefix} AS (
  SELECT DISTINCT repo, path, line FROM (
    SELECT repo, path, i AS line FROM {prefix}_l WHERE {kw}
    UNION ALL
    SELECT repo, path, line FROM {prefix}_s_all)
)"""


def islands_ctes(files_cte: str, matched_cte: str, window: int, prefix: str = "isl") -> str:
    """CTE {prefix}(repo, path, island, start_line, end_line) by gaps-and-islands."""
    return f"""
{prefix}_n AS (SELECT repo, path, {n_lines_expr('content')} AS n FROM {files_cte}),
{prefix}_r AS (
  SELECT m.repo, m.path, greatest(0, m.line - 1 - {window}) AS s, least(n.n - 1, m.line - 1 + {window}) AS e
  FROM {matched_cte} m JOIN {prefix}_n n ON m.repo = n.repo AND m.path = n.path
),
{prefix}_g AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY repo, path ORDER BY s, e
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                 THEN 0 ELSE 1 END AS brk
  FROM {prefix}_r
),
{prefix}_i AS (
  SELECT *, sum(brk) OVER (PARTITION BY repo, path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM {prefix}_g
),
{prefix} AS (
  SELECT repo, path, CAST(island AS INTEGER) AS island, CAST(min(s) + 1 AS INTEGER) AS start_line,
         CAST(max(e) + 1 AS INTEGER) AS end_line
  FROM {prefix}_i GROUP BY repo, path, island
)"""


def snippet_body_ctes(files_cte: str, islands_cte: str, prefix: str = "snip") -> str:
    """CTE {prefix}(repo, path, body)."""
    return f"""
{prefix} AS (
  SELECT i.repo, i.path,
         string_agg('--- LINES ' || CAST(i.start_line AS VARCHAR) || '-' || CAST(i.end_line AS VARCHAR) || ' ---' || chr(10)
                    || array_to_string(list_slice(string_split_regex(f.content, {q(LINE_RE)}), i.start_line, i.end_line), chr(10)),
                    chr(10) || chr(10) ORDER BY i.island) AS body
  FROM {islands_cte} i JOIN {files_cte} f ON i.repo = f.repo AND i.path = f.path
  GROUP BY i.repo, i.path
)"""
