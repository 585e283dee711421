"""Query catalogue: the library's jobs bound to the driver's test tables.

Each entry is a function (spark, sf_dir) -> DataFrame plus, where SQL can say
the same thing, an independent DuckDB oracle over the same parquet tables.
Every query reads whole tables; no id subsets or row caps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.operators import context as ctx
from corpuslens.operators import scoring
from corpuslens.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Test tables hold no literal above the reference 4.2 bits (hex keys cap at 4.0),
# so testdata queries pass a lower threshold; the default stays 4.2.
TESTDATA_ENTROPY = 3.0


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table_sql(spark: SparkSession, sf_dir: str, sql: str, **kwargs) -> DataFrame:
    """Run SQL written against the plain table names on the tables of `sf_dir`.

    Each table is registered under a name private to this package and this data
    folder, and only FROM/JOIN references are rewritten, so the caller's own
    temp views of the same names are never replaced.
    """
    import hashlib
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]

    def sub(m):
        name = f"cl_{m.group(2)}_{tag}"
        if not spark.catalog.tableExists(name):
            table(spark, sf_dir, m.group(2)).createOrReplaceTempView(name)
        return f"{m.group(1)} {name}"
    text = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", sub, sql)
    return spark.sql(text, **kwargs)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rebalance only when the scan yields fewer tasks than the cluster has cores.

    Text jobs are CPU-bound per row; a one-row-group file would otherwise run
    in a single task.  On a large input the scan is already wide and this is a
    no-op, so no 100 TB shuffle is added.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < cores
    except Exception:  # noqa: BLE001  (no RDD view of the plan, e.g. Spark Connect): leave the plan as is
        return df
    return df.repartition(cores) if narrow else df


def documents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: repo = source, path = <lang>/doc_<id>.py, content = text."""
    d = table(spark, sf_dir, "documents")
    return spread(d).select(F.col("source").alias("repo"),
                    F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                    F.col("text").alias("content"))


DOCS = f"docs AS ({O.docs_files_sql()})"


# ------------------------------------------------------------ scoring ----

@query("keyword_score", f"""
WITH {DOCS}
SELECT repo, path, {O.kw_score_expr('content', rules.RISK_KEYWORDS)} AS keyword_score FROM docs
""")
def q_keyword_score(spark, sf_dir):
    return scoring.keyword_score(documents_files(spark, sf_dir))


@query("secret_scan", f"""
WITH {DOCS}, {O.secrets_ctes('docs', TESTDATA_ENTROPY)}
SELECT repo, path, CAST(ord AS INTEGER) AS ord, CAST(line AS INTEGER) AS line, literal,
       round(entropy, 6) AS entropy
FROM sec_all
""")
def q_secret_scan(spark, sf_dir):
    s = scoring.extract_secrets(documents_files(spark, sf_dir), threshold=TESTDATA_ENTROPY)
    return s.withColumn("entropy", F.round("entropy", 6))


def _scored_sql(threshold: float, keywords=rules.RISK_KEYWORDS) -> str:
    return f"""{DOCS}, {O.secrets_ctes('docs', threshold)},
sec_n AS (SELECT repo, path, count(*) AS n FROM sec_all GROUP BY repo, path),
scored AS (
  SELECT d.repo, d.path, d.content, {O.kw_score_expr('d.content', keywords)} AS keyword_score,
         CAST(coalesce(s.n, 0) AS BIGINT) AS secret_count,
         {O.kw_score_expr('d.content', keywords)} + 5 * CAST(coalesce(s.n, 0) AS BIGINT) AS score
  FROM docs d LEFT JOIN sec_n s ON d.repo = s.repo AND d.path = s.path
)"""


@query("risk_rank_top", f"""
WITH {_scored_sql(TESTDATA_ENTROPY)}
SELECT * FROM (
  SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS INTEGER) AS rank,
         path, CAST(score AS BIGINT) AS score, keyword_score, secret_count
  FROM scored) WHERE rank <= 5
""")
def q_risk_rank_top(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), threshold=TESTDATA_ENTROPY, with_lines=False)
    return (scoring.rank_files(scored, top=5)
            .select("repo", F.col("rank").cast("int").alias("rank"), "path", "score", "keyword_score", "secret_count"))


@query("matched_lines", f"""
WITH {DOCS}, {O.matched_lines_ctes('docs', rules.RISK_KEYWORDS, TESTDATA_ENTROPY)}
SELECT repo, path, CAST(line AS INTEGER) AS line FROM ml
""")
def q_matched_lines(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), threshold=TESTDATA_ENTROPY)
    return scored.select("repo", "path", F.explode("matched_lines").alias("line")).withColumn("line", F.col("line").cast("int"))


SNIP_KW = ("In ",)
SNIP_W = 1


@query("snippet_ranges", f"""
WITH {DOCS}, {O.matched_lines_ctes('docs', SNIP_KW, TESTDATA_ENTROPY)}, {O.islands_ctes('docs', 'ml', SNIP_W)}
SELECT * FROM isl
""")
def q_snippet_ranges(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), keywords=SNIP_KW, threshold=TESTDATA_ENTROPY)
    return ctx.snippet_ranges(scored, window=SNIP_W)


@query("snippet_text", f"""
WITH {DOCS}, {O.matched_lines_ctes('docs', SNIP_KW, TESTDATA_ENTROPY)}, {O.islands_ctes('docs', 'ml', SNIP_W)},
{O.snippet_body_ctes('docs', 'isl')}
SELECT repo, path, CAST(length(body) AS INTEGER) AS body_chars, md5(body) AS body_md5 FROM snip
""")
def q_snippet_text(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), keywords=SNIP_KW, threshold=TESTDATA_ENTROPY)
    body = ctx.render_snippets_col(F.col("content"), F.col("matched_lines"), SNIP_W)
    return (scored.where(F.size("matched_lines") > 0)
            .select("repo", "path", body.alias("body"))
            .select("repo", "path", F.length("body").cast("int").alias("body_chars"), F.md5("body").alias("body_md5")))


def _payload_sql(threshold: float) -> str:
    return f"""{_scored_sql(threshold)}, {O.matched_lines_ctes('docs', rules.RISK_KEYWORDS, threshold)},
{O.islands_ctes('docs', 'ml', rules.SNIPPET_WINDOW)}, {O.snippet_body_ctes('docs', 'isl')},
payload AS (
  SELECT s.repo, s.path, s.score,
         CASE WHEN length(s.content) > {rules.SNIPPET_SWITCH_CHARS} AND sn.body IS NOT NULL THEN 'SNIPPETS' ELSE 'FULL' END AS label,
         CASE WHEN length(s.content) > {rules.SNIPPET_SWITCH_CHARS} AND sn.body IS NOT NULL THEN sn.body ELSE s.content END AS payload
  FROM scored s LEFT JOIN snip sn ON s.repo = sn.repo AND s.path = sn.path
)"""


def _payloads(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), threshold=TESTDATA_ENTROPY)
    return ctx.with_payload(scored)


@query("payload_choice", f"""
WITH {_payload_sql(TESTDATA_ENTROPY)}
SELECT repo, path, label, CAST(length(payload) AS INTEGER) AS payload_chars, md5(payload) AS payload_md5 FROM payload
""")
def q_payload_choice(spark, sf_dir):
    return _payloads(spark, sf_dir).select("repo", "path", "label", F.length("payload").cast("int").alias("payload_chars"),
                                           F.md5("payload").alias("payload_md5"))


PACK = dict(max_chars=30000, max_files=20, min_tail=1000, reserve=100)


def _pack_sql() -> str:
    m, k, t, r = PACK["max_chars"], PACK["max_files"], PACK["min_tail"], PACK["reserve"]

    def entry(label, body):
        return (f"chr(10) || 'FILE: ' || path || ' (' || {label} || ', Risk Score: ' || CAST(score AS VARCHAR) || ')' "
                f"|| chr(10) || '```' || chr(10) || {body} || chr(10) || '```'")
    return f"""{_payload_sql(TESTDATA_ENTROPY)},
rk AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank
  FROM payload WHERE length(payload) > 0
),
en AS (SELECT *, {entry('label', 'payload')} AS entry FROM rk WHERE rank <= {k}),
cu AS (SELECT *, sum(length(entry)) OVER (PARTITION BY repo ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM en),
packed AS (
  SELECT repo, CAST(rank AS INTEGER) AS rank, path,
         CASE WHEN cum <= {m} THEN label ELSE 'TRUNCATED' END AS label,
         CASE WHEN cum <= {m} THEN entry
              ELSE {entry("'TRUNCATED'", f"left(payload, CAST({m} - (cum - length(entry)) - {r} AS BIGINT))")} END AS entry
  FROM cu
  WHERE cum <= {m} OR (cum - length(entry) <= {m} AND {m} - (cum - length(entry)) > {t})
)"""


def _packed(spark, sf_dir):
    scored = scoring.score_files(documents_files(spark, sf_dir), threshold=TESTDATA_ENTROPY, with_lines=False)
    return ctx.pack_context(scored, threshold=TESTDATA_ENTROPY, **PACK)


@query("pack_context", f"""
WITH {_pack_sql()}
SELECT repo, rank, path, label, CAST(length(entry) AS INTEGER) AS n_chars FROM packed
""")
def q_pack_context(spark, sf_dir):
    return _packed(spark, sf_dir).select("repo", "rank", "path", "label", "n_chars")


@query("context_text", f"""
WITH {_pack_sql()},
txt AS (SELECT repo, chr(10) || '--- FILE CONTENTS ---' || chr(10) || string_agg(entry, chr(10) ORDER BY rank) AS text
        FROM packed GROUP BY repo)
SELECT repo, CAST(length(text) AS INTEGER) AS text_chars, md5(text) AS text_md5 FROM txt
""")
def q_context_text(spark, sf_dir):
    t = ctx.context_text(_packed(spark, sf_dir))
    return t.select("repo", F.length("text").cast("int").alias("text_chars"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------- vulnerabilities ----
# Python sources are synthesised from order columns by one SQL expression that
# Spark and DuckDB both evaluate; the oracle derives the expected findings from
# the same columns without any parser.

ORDER_SRC_SQL = """
'import os' || chr(10) ||
'def handle_' || CAST(o_orderkey AS STRING) || '(x, cursor):' || chr(10) ||
'    ' || CASE o_orderpriority
   WHEN '1-URGENT' THEN 'eval(x)'
   WHEN '2-HIGH' THEN 'os.system("echo " + x)'
   WHEN '3-MEDIUM' THEN 'subprocess.run(x, shell=True)'
   WHEN '4-NOT SPECIFIED' THEN 'cursor.execute(f"SELECT * FROM t WHERE id = {x}")'
   ELSE 'yaml.load(x, Loader=yaml.SafeLoader)' END || chr(10) ||
'    ' || CASE o_orderstatus
   WHEN 'F' THEN 'data = pickle.loads(x)'
   WHEN 'O' THEN 'subprocess.run(x, shell=1)'
   ELSE 'SECRET_KEY = "sk-' || CAST(o_orderkey AS STRING) || '-' || CAST(o_custkey AS STRING) || '"' END || chr(10) ||
'    return x' || chr(10)
"""
ORDER_FILES_SQL = ("SELECT 'cust_' || CAST(o_custkey AS STRING) AS repo, "
                   "'svc/order_' || CAST(o_orderkey AS STRING) || '.py' AS path, "
                   f"{ORDER_SRC_SQL} AS content, o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders")


def order_files(spark, sf_dir):
    return spread(table_sql(spark, sf_dir, ORDER_FILES_SQL))


def _expected_findings_sql() -> str:
    r = {row[0]: row for row in rules.CWE_RULES}

    def branch(where, line, rule, code, callee):
        _, _, cwe, vuln, sev, tmpl = r[rule]
        desc = O.q(tmpl.replace("%s", callee))
        return (f"SELECT repo, path, {line} AS line, {O.q(cwe)} AS cwe, {O.q(vuln)} AS vulnerability, "
                f"{O.q(sev)} AS severity, {code} AS code, {desc} AS description FROM ofiles WHERE {where}")
    cwe, vuln, sev, tmpl = rules.CRED_RULE
    lit = "('sk-' || CAST(o_orderkey AS STRING) || '-' || CAST(o_custkey AS STRING))"
    cred = (f"SELECT repo, path, 4 AS line, {O.q(cwe)}, {O.q(vuln)}, {O.q(sev)}, "
            f"'SECRET_KEY = \"' || {lit} || '\"', "
            f"'Variable ''SECRET_KEY'' assigned a hardcoded secret literal of length ' || CAST(length({lit}) AS STRING) || '.' "
            f"FROM ofiles WHERE o_orderstatus NOT IN ('F', 'O') AND length({lit}) > 8")
    parts = [
        branch("o_orderpriority = '1-URGENT'", 3, 1, "'eval(x)'", "eval"),
        branch("o_orderpriority = '2-HIGH'", 3, 2, "'os.system(\"echo \" + x)'", "os.system"),
        branch("o_orderpriority = '3-MEDIUM'", 3, 3, "'subprocess.run(x, shell=True)'", "subprocess.run"),
        branch("o_orderpriority = '4-NOT SPECIFIED'", 3, 6,
               "'cursor.execute(f\"SELECT * FROM t WHERE id = {x}\")'", "cursor.execute"),
        branch("o_orderstatus = 'F'", 4, 4, "'data = pickle.loads(x)'", "pickle.loads"),
        cred,
    ]
    return f"ofiles AS ({ORDER_FILES_SQL}),\nexp AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"


def _order_findings(spark, sf_dir):
    from corpuslens.operators import vuln
    return vuln.scan_findings(order_files(spark, sf_dir))


@query("ast_findings", f"""
WITH {_expected_findings_sql()}
SELECT repo, path, CAST(line AS INTEGER) AS line, cwe, vulnerability, severity, code, description FROM exp
""")
def q_ast_findings(spark, sf_dir):
    return _order_findings(spark, sf_dir).select("repo", "path", "line", "cwe", "vulnerability", "severity",
                                                 "code", "description")


@query("ast_findings_sql", f"""
WITH {_expected_findings_sql()}
SELECT repo, path, CAST(line AS INTEGER) AS line, cwe, vulnerability, severity, code, description FROM exp
""")
def q_ast_findings_sql(spark, sf_dir):
    """The same findings in SQL alone, by the table function for facts."""
    from corpuslens.functions import sql
    sql.register_fact_function(spark)
    order_files(spark, sf_dir).createOrReplaceTempView("cl_order_files")
    return spark.sql(f"SELECT repo, path, line, cwe, vulnerability, severity, code, description FROM ({sql.findings_sql('cl_order_files')})")


@query("findings_rollup", f"""
WITH {_expected_findings_sql()}
SELECT repo, severity, cwe, CAST(count(*) AS BIGINT) AS n_findings FROM exp GROUP BY ROLLUP (repo, severity, cwe)
""")
def q_findings_rollup(spark, sf_dir):
    from corpuslens.operators import vuln
    return vuln.findings_rollup(_order_findings(spark, sf_dir))


def _report_sql() -> str:
    item = ("CAST(idx AS STRING) || '. **[' || severity || '] ' || vulnerability || ' (' || cwe || ')**' || chr(10) || "
            "'   - **Location**: `' || path || '` (Line ' || CAST(line AS STRING) || ')' || chr(10) || "
            "'   - **Snippet**: `' || code || '`' || chr(10) || '   - **Description**: ' || description || chr(10) || chr(10)")
    return f"""{_expected_findings_sql()},
num AS (SELECT *, {item} AS item FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line) AS idx FROM exp)),
per AS (SELECT repo, count(*) AS n, string_agg(item, '' ORDER BY idx) AS items FROM num GROUP BY repo),
rep AS (
  SELECT r.repo, CAST(coalesce(p.n, 0) AS BIGINT) AS n_findings,
         CASE WHEN p.n IS NULL THEN {O.q(rules.CLEAN_REPORT_TEXT)}
              ELSE {O.q(rules.REPORT_HEADER)} || 'Detected **' || CAST(p.n AS STRING) || '** security vulnerabilities:'
                   || chr(10) || chr(10) || p.items END AS report
  FROM (SELECT DISTINCT repo FROM ofiles) r LEFT JOIN per p ON r.repo = p.repo
)"""


@query("findings_report", f"""
WITH {_report_sql()}
SELECT repo, n_findings, CAST(length(report) AS INTEGER) AS report_chars, md5(report) AS report_md5 FROM rep
""")
def q_findings_report(spark, sf_dir):
    from corpuslens.operators import vuln
    files = order_files(spark, sf_dir)
    rep = vuln.findings_report(_order_findings(spark, sf_dir), files)
    return rep.select("repo", "n_findings", F.length("report").cast("int").alias("report_chars"),
                      F.md5("report").alias("report_md5"))


@query("findings_report_lines", f"""
WITH {_report_sql()}
SELECT repo, CAST(0 AS BIGINT) AS idx, md5(CASE WHEN n_findings = 0 THEN report
       ELSE {O.q(rules.REPORT_HEADER)} || 'Detected **' || CAST(n_findings AS STRING) || '** security vulnerabilities:'
            || chr(10) || chr(10) END) AS text_md5 FROM rep
UNION ALL
SELECT repo, CAST(idx AS BIGINT), md5(item) FROM num
""")
def q_findings_report_lines(spark, sf_dir):
    from corpuslens.operators import vuln
    lines = vuln.findings_report_lines(_order_findings(spark, sf_dir), order_files(spark, sf_dir))
    return lines.select("repo", "idx", F.md5("text").alias("text_md5"))


@query("clean_repos", f"""
WITH {_expected_findings_sql()}
SELECT DISTINCT repo FROM ofiles WHERE repo NOT IN (SELECT repo FROM exp)
""")
def q_clean_repos(spark, sf_dir):
    from corpuslens.operators import vuln
    return vuln.clean_repos(_order_findings(spark, sf_dir), order_files(spark, sf_dir))


CUST_SRC_SQL = """
CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN 'API_KEY = "your_key_here_' || c_name || '"'
  WHEN 'BUILDING' THEN 'DB_PASSWORD = "' || c_name || '"'
  WHEN 'FURNITURE' THEN 'SECRET = "' || left(c_name, 8) || '"'
  WHEN 'HOUSEHOLD' THEN 'auth_token: str = "' || c_name || '"'
  ELSE 'alias = AUTH_TOKEN = "' || c_name || '"' END || chr(10) ||
'passwd_hint = os.environ.get("P", "' || c_name || '")' || chr(10)
"""


@query("cred_findings", f"""
WITH c AS (SELECT 'seg_' || c_mktsegment AS repo, 'cfg/cust_' || CAST(c_custkey AS STRING) || '.py' AS path, * FROM customer)
SELECT repo, path, 1 AS line, 'CWE-798' AS cwe,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'DB_PASSWORD' ELSE 'AUTH_TOKEN' END AS target,
       CAST(length(c_name) AS INTEGER) AS value_len
FROM c WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD') AND length(c_name) > 8
""")
def q_cred_findings(spark, sf_dir):
    from corpuslens.operators import vuln
    files = spread(table_sql(
        spark, sf_dir,
        "SELECT 'seg_' || c_mktsegment AS repo, 'cfg/cust_' || CAST(c_custkey AS STRING) || '.py' AS path, "
        f"{CUST_SRC_SQL} AS content FROM customer"))
    facts = vuln.python_facts(files)
    found = vuln.findings(facts).where(F.col("cwe") == "CWE-798")
    target = F.regexp_extract(F.col("description"), r"^Variable '([^']*)'", 1)
    vlen = F.regexp_extract(F.col("description"), r"length (\d+)\.$", 1).cast("int")
    return found.select("repo", "path", "line", "cwe", target.alias("target"), vlen.alias("value_len"))


# --------------------------------------------------------------- patches ----
# One patch per order file; the chunk kind depends on the priority, the target
# on the status (traversal for 'P', a missing file for low-priority open orders).

PATCH_SEARCH = {
    "1-URGENT": [("eval(x)", "ast.literal_eval(x)")],
    "2-HIGH": [('os.system("echo "   +   x)', 'subprocess.run(["echo", x])')],
    "3-MEDIUM": [("subprocess.run(x, shell=True)", "subprocess.run(x, shell=False)"),
                 ("shell=False)", "shell=False, check=True)")],
    "4-NOT SPECIFIED": [("cursor.execute(query)", "cursor.execute(query, params)")],
    "5-LOW": [("yaml.load(x, Loader=yaml.SafeLoader)", "yaml.safe_load(x)  # costs $1 \\1")],
}


def _chunk_sql(search: str, replace: str) -> str:
    nl = " || chr(10) || "
    return nl.join(["'<<<<<<< SEARCH'", O.q(search), "'======='", O.q(replace), "'>>>>>>> REPLACE'"])


PATCH_TARGET_SQL = ("CASE WHEN o_orderstatus = 'P' THEN '../' || path "
                    "WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' "
                    "THEN 'svc/missing_' || CAST(o_orderkey AS STRING) || '.py' ELSE path END")
PATCH_TEXT_SQL = ("'Proposed fix for order ' || CAST(o_orderkey AS STRING) || chr(10) || 'FILE: ' || "
                  + PATCH_TARGET_SQL + " || chr(10) || CASE o_orderpriority "
                  + " ".join(f"WHEN {O.q(k)} THEN " + " || chr(10) || ".join(_chunk_sql(s, r) for s, r in v)
                             for k, v in PATCH_SEARCH.items())
                  + " END || chr(10)")
PATCH_TEXTS_SQL = (f"SELECT repo, o_orderkey AS patch_id, {PATCH_TEXT_SQL} AS text FROM ({ORDER_FILES_SQL}) f")


def _patch_rows(spark, sf_dir):
    from corpuslens.operators import patching
    texts = spread(table_sql(spark, sf_dir, PATCH_TEXTS_SQL))
    return patching.parse_patch(texts)


@query("patch_parse", f"""
WITH ofiles AS ({ORDER_FILES_SQL}),
chunks AS (
""" + "\nUNION ALL\n".join(
    f"SELECT repo, o_orderkey AS patch_id, 0 AS file_ord, {PATCH_TARGET_SQL} AS path, {i} AS chunk_ord, "
    f"{O.q(s)} AS search, {O.q(r)} AS replace FROM ofiles WHERE o_orderpriority = {O.q(k)}"
    for k, v in PATCH_SEARCH.items() for i, (s, r) in enumerate(v)) + """
)
SELECT repo, patch_id, CAST(file_ord AS INTEGER) AS file_ord, path, CAST(chunk_ord AS INTEGER) AS chunk_ord,
       search, replace FROM chunks
""")
def q_patch_parse(spark, sf_dir):
    return _patch_rows(spark, sf_dir).drop("parse_warning")


def _applied(spark, sf_dir):
    from corpuslens.operators import patching
    files = order_files(spark, sf_dir).select("repo", "path", "content")
    return patching.apply_patches(files, _patch_rows(spark, sf_dir))


def _expected_patch_sql() -> str:
    nl = "chr(10)"
    fuzzy_old = f"':' || {nl} || '    os.system(\"echo \" + x)' || {nl} || '    '"
    new = (
        "CASE o_orderpriority "
        "WHEN '1-URGENT' THEN replace(content, 'eval(x)', 'ast.literal_eval(x)') "
        f"WHEN '2-HIGH' THEN replace(content, {fuzzy_old}, ':subprocess.run([\"echo\", x])') "
        "WHEN '3-MEDIUM' THEN replace(content, 'subprocess.run(x, shell=True)', 'subprocess.run(x, shell=False, check=True)') "
        f"WHEN '5-LOW' THEN replace(content, 'yaml.load(x, Loader=yaml.SafeLoader)', {O.q('yaml.safe_load(x)  # costs $1 ' + chr(92) + '1')}) "
        "ELSE content END")
    status = ("CASE WHEN o_orderstatus = 'P' THEN 'PATH_TRAVERSAL' "
              "WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'FILE_NOT_FOUND' "
              "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'SEARCH_NOT_FOUND' ELSE 'APPLIED' END")
    applied = ("CASE WHEN o_orderstatus = 'P' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'O') "
               "OR o_orderpriority = '4-NOT SPECIFIED' THEN 0 "
               "WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 1 END")
    return f"""ofiles AS ({ORDER_FILES_SQL}),
pexp AS (
  SELECT repo, o_orderkey AS patch_id, {PATCH_TARGET_SQL} AS path, {status} AS status,
         CAST({applied} AS INTEGER) AS chunks_applied,
         CASE WHEN {status} = 'APPLIED' THEN {new} ELSE content END AS new_content, content
  FROM ofiles
)"""


@query("patch_no_chunks", f"""
WITH {_expected_patch_sql()}
SELECT repo, patch_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE path END AS path, CASE WHEN o_orderstatus = 'F' THEN 'NO_CHUNKS' ELSE status END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE chunks_applied END AS chunks_applied
FROM pexp JOIN (SELECT o_orderkey, o_orderstatus FROM orders) ON patch_id = o_orderkey
""")
def q_patch_no_chunks(spark, sf_dir):
    """Patches of which those on F orders hold no chunk: every patch has a status."""
    from corpuslens.operators import patching
    text = f"CASE WHEN o_orderstatus = 'F' THEN 'FILE: ' || path || chr(10) || 'nothing to do' ELSE {PATCH_TEXT_SQL} END"
    texts = spread(table_sql(spark, sf_dir, f"SELECT repo, o_orderkey AS patch_id, {text} AS text FROM ({ORDER_FILES_SQL}) f"))
    out = patching.apply_patches(order_files(spark, sf_dir).select("repo", "path", "content"), patching.parse_patch(texts, keep_empty=True))
    return out.select("repo", "patch_id", "path", "status", "chunks_applied")


@query("patch_hot_file", """
WITH o AS (SELECT o_custkey % 10 AS repo, o_orderkey AS patch_id, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS n,
                  o_orderstatus FROM orders),
a AS (SELECT *, max(CASE WHEN o_orderstatus <> 'P' THEN n END) OVER (PARTITION BY repo ORDER BY n) AS last FROM o)
SELECT 'r' || CAST(repo AS VARCHAR) AS repo, patch_id, CASE WHEN o_orderstatus = 'P' THEN 'SEARCH_NOT_FOUND' ELSE 'APPLIED' END AS status,
       'log = [' || chr(10) || '  "at ' || CAST(coalesce(last, 0) AS VARCHAR) || '",' || chr(10) || ']' || chr(10) AS new_content
FROM a
""")
def q_patch_hot_file(spark, sf_dir):
    """A tenth of all patches on each of ten files, each working on what the one before it left; those on P orders look for what isn't there."""
    from corpuslens.operators import patching
    o = table_sql(spark, sf_dir, """
        SELECT 'r' || CAST(o_custkey % 10 AS STRING) AS repo, o_orderkey AS patch_id, o_orderstatus,
               row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS n FROM orders""")
    last = F.expr("coalesce(max(CASE WHEN o_orderstatus <> 'P' THEN n END) OVER (PARTITION BY repo ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    patches = o.select("repo", "patch_id", F.lit(0).alias("file_ord"), F.lit("log.py").alias("path"), F.lit(0).alias("chunk_ord"),
                       F.when(F.col("o_orderstatus") == "P", "nowhere").otherwise(F.concat(F.lit('"at '), last.cast("string"), F.lit('"'))).alias("search"),
                       F.concat(F.lit('"at '), F.col("n").cast("string"), F.lit('"')).alias("replace"))
    files = patches.select("repo", "path").distinct().withColumn("content", F.lit('log = [\n  "at 0",\n]\n'))
    return patching.apply_patches(files, patches, hot_files=True).select("repo", "patch_id", "status", "new_content")


@query("patch_status", f"""
WITH {_expected_patch_sql()}
SELECT repo, patch_id, path, status, chunks_applied FROM pexp
""")
def q_patch_status(spark, sf_dir):
    return _applied(spark, sf_dir).select("repo", "patch_id", "path", "status", "chunks_applied")


@query("patch_fold", f"""
WITH {_expected_patch_sql()}
SELECT repo, patch_id, path, CAST(length(new_content) AS INTEGER) AS new_chars, md5(new_content) AS new_md5
FROM pexp WHERE status = 'APPLIED'
""")
def q_patch_fold(spark, sf_dir):
    a = _applied(spark, sf_dir).where(F.col("status") == "APPLIED")
    return a.select("repo", "patch_id", "path", F.length("new_content").cast("int").alias("new_chars"),
                    F.md5("new_content").alias("new_md5"))


@query("patch_apply_exact", f"""
WITH {_expected_patch_sql()}
SELECT repo, patch_id, path, new_content FROM pexp
WHERE status = 'APPLIED' AND patch_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW'))
""")
def q_patch_apply_exact(spark, sf_dir):
    return _applied(spark, sf_dir).where("match_kind = 'EXACT'").select("repo", "patch_id", "path", "new_content")


@query("patch_apply_fuzzy", f"""
WITH {_expected_patch_sql()}
SELECT repo, patch_id, path, new_content FROM pexp
WHERE status = 'APPLIED' AND patch_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')
""")
def q_patch_apply_fuzzy(spark, sf_dir):
    return _applied(spark, sf_dir).where("match_kind = 'FUZZY'").select("repo", "patch_id", "path", "new_content")


AGENT_NOTES_SQL = ("SELECT repo, '.agents/review_' || CAST(o_orderkey AS STRING) || '.md' AS path, "
                   "'reviewed ' || o_orderstatus AS content FROM ofiles WHERE o_orderstatus = 'F'")


@query("restore_snapshot", f"""
WITH {_expected_patch_sql()}
SELECT repo, path, md5(content) AS content_md5 FROM ofiles
UNION ALL
SELECT repo, path, md5(content) FROM ({AGENT_NOTES_SQL})
""")
def q_restore_snapshot(spark, sf_dir):
    from corpuslens.operators import patching
    files = order_files(spark, sf_dir)
    snap = files.select("repo", "path", "content")
    notes = table_sql(spark, sf_dir, AGENT_NOTES_SQL.replace("FROM ofiles", f"FROM ({ORDER_FILES_SQL}) ofiles"))
    current = patching.patched_files(snap, _applied(spark, sf_dir)).unionByName(notes)
    restored = patching.restore_snapshot(current, snap)
    return restored.select("repo", "path", F.md5("content").alias("content_md5"))


@query("snapshot_diff", f"""
WITH {_expected_patch_sql()}
SELECT f.repo, f.path, CASE WHEN p.status = 'APPLIED' AND p.new_content <> f.content THEN 'modified'
                            ELSE 'unchanged' END AS change
FROM ofiles f LEFT JOIN pexp p ON f.repo = p.repo AND f.path = p.path
""")
def q_snapshot_diff(spark, sf_dir):
    from corpuslens.operators import patching
    snap = order_files(spark, sf_dir).select("repo", "path", "content")
    return patching.snapshot_diff(snap, patching.patched_files(snap, _applied(spark, sf_dir)))


@query("modified_union", f"""
WITH {_expected_patch_sql()}
SELECT DISTINCT repo, path FROM pexp WHERE status = 'APPLIED'
""")
def q_modified_union(spark, sf_dir):
    from corpuslens.operators import patching
    return patching.modified_union(_applied(spark, sf_dir))


@query("explode_lines", f"""
WITH {DOCS},
l AS (SELECT repo, path, string_split_regex(content, {O.q(O.LINE_RE)}) AS ls, {O.n_lines_expr('content')} AS n FROM docs),
u AS (SELECT repo, path, ls, unnest(generate_series(1, n)) AS line FROM l)
SELECT repo, path, CAST(line AS INTEGER) AS line, md5(ls[line]) AS text_md5 FROM u
""")
def q_explode_lines(spark, sf_dir):
    from corpuslens.operators import paths
    lines = paths.explode_lines(documents_files(spark, sf_dir))
    return lines.select("repo", "path", "line", F.md5("text").alias("text_md5"))


@query("sql_secret_entropy", f"""
WITH {DOCS}, {O.secrets_ctes('docs', TESTDATA_ENTROPY)}
SELECT repo, path, CAST(ord AS INTEGER) AS ord, literal, round(entropy, 6) AS entropy FROM sec_all
""")
def q_sql_secret_entropy(spark, sf_dir):
    """The SQL text interface: registered SQL functions, a bound regex parameter, LATERAL VIEW posexplode."""
    from corpuslens.functions.sql import register_sql_functions
    register_sql_functions(spark)
    return spark.sql(
        "SELECT repo, path, CAST(pos + 1 AS INT) AS ord, lit AS literal, round(shannon_entropy(lit), 6) AS entropy "
        "FROM {corpus_files} LATERAL VIEW posexplode(regexp_extract_all(content, :pat, 1)) t AS pos, lit "
        "WHERE shannon_entropy(lit) > :thr AND NOT exists(array(" + ", ".join(O.q(p) for p in rules.SECRET_PLACEHOLDERS)
        + "), p -> contains(lower(lit), p))",
        args={"pat": rules.SECRET_LITERAL_PATTERN, "thr": TESTDATA_ENTROPY}, corpus_files=documents_files(spark, sf_dir))


ERR_SRC_SQL = """
CASE c_mktsegment
  WHEN 'MACHINERY' THEN 'def handler_' || CAST(c_custkey AS STRING) || '(:' || chr(10) || '    pass' || chr(10)
  WHEN 'AUTOMOBILE' THEN 'x = (1,' || chr(10)
  ELSE 'def handler_' || CAST(c_custkey AS STRING) || '(x):' || chr(10) || '    return x' || chr(10) END"""


@query("parse_errors", """
SELECT 'seg_' || c_mktsegment AS repo, 'err/cust_' || CAST(c_custkey AS VARCHAR) || '.py' AS path,
       'SyntaxError' AS error_kind
FROM customer WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')
""")
def q_parse_errors(spark, sf_dir):
    """C11: files that do not parse are kept as a status table, not dropped."""
    from corpuslens.operators import vuln
    files = spread(table_sql(
        spark, sf_dir,
        "SELECT 'seg_' || c_mktsegment AS repo, 'err/cust_' || CAST(c_custkey AS STRING) || '.py' AS path, "
        f"{ERR_SRC_SQL} AS content FROM customer"))
    errs = vuln.parse_errors(vuln.python_facts(files))
    return errs.select("repo", "path", F.regexp_extract("error", r"^(\w+):", 1).alias("error_kind"))
