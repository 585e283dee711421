"""SQL-level functions, for users who write spark.sql(...) against corpus tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "shannon_entropy": """(s STRING) RETURNS DOUBLE RETURN
        CASE WHEN s IS NULL THEN NULL WHEN length(s) = 0 THEN 0D ELSE
          aggregate(array_distinct(split(s, '')), 0D,
                    (acc, c) -> acc - ((length(s) - length(replace(s, c, ''))) / length(s))
                                    * log2((length(s) - length(replace(s, c, ''))) / length(s))) END""",
    "count_ci": """(text STRING, kw STRING) RETURNS BIGINT RETURN
        CAST((length(lower(text)) - length(replace(lower(text), lower(kw), ''))) / length(kw) AS BIGINT)""",
    "normalize_eol": """(text STRING) RETURNS STRING RETURN replace(replace(text, '\\r\\n', '\\n'), '\\r', '\\n')""",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions (no Python at run time): shannon_entropy, count_ci, normalize_eol."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def register_fact_function(spark: SparkSession, name: str = "python_facts") -> None:
    """Two table functions for SQL users, over one file's text and over a table of files.

    `FROM files f, LATERAL python_facts(f.content) x` gives the columns of `vuln.FACT_SCHEMA` behind repo and path, and
    `FROM python_facts_of(TABLE(SELECT repo, path, content FROM files))` gives them all.  The first is called for every
    file and parses in the worker itself; the second parses whole Arrow batches, as `vuln.python_facts` does.
    """
    from pyspark.sql.functions import arrow_udtf, udtf

    from corpuslens.operators import vuln

    facts, batch_facts, shape = vuln.file_facts, vuln.facts_batch, vuln.FACT_SCHEMA.removeprefix("repo STRING, path STRING, ")

    class PythonFacts:
        def eval(self, content):
            yield from facts(content)

    class PythonFactsOf:
        def eval(self, files):
            found = batch_facts(files)
            if found is not None:
                yield found

    spark.udtf.register(name, udtf(PythonFacts, returnType=shape))
    spark.udtf.register(f"{name}_of", arrow_udtf(PythonFactsOf, returnType=vuln.FACT_SCHEMA))


def findings_sql(files: str, facts: str = "python_facts") -> str:
    """SQL text that finds what `vuln.scan_findings` finds, over a table or view (repo, path, content) called `files`.

    facts: the name given to `register_fact_function`.
    """
    from corpuslens import rules

    def quoted(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def listed(values) -> str:
        return ", ".join(map(quoted, values))

    def any_of(expr: str, words) -> str:
        return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"

    callees = {r: names for r, names, *_ in rules.CWE_RULES}
    case = f"""CASE WHEN kind = 'call' THEN
         CASE WHEN name IN ({listed(callees[1])}) THEN 1
              WHEN name IN ({listed(callees[2])}) THEN 2
              WHEN name IN ({listed(callees[3])}) THEN IF(exists(kw, k -> coalesce(k.name = 'shell' AND k.is_true, false)), 3, NULL)
              WHEN name IN ({listed(callees[4])}) THEN 4
              WHEN name IN ({listed(callees[5])}) THEN IF(name = 'yaml.unsafe_load' OR
                   NOT exists(kw, k -> coalesce(k.name = 'Loader' AND k.attr IN ({listed(rules.SAFE_YAML_LOADERS)}), false)), 5, NULL)
              WHEN name IN ({listed(callees[6])}) THEN IF(arg0_kind IN ('fstring', 'mod', 'format') AND {any_of('lower(code)', rules.SQL_WORDS)}, 6, NULL) END
       WHEN kind = 'assign' AND {any_of('upper(name)', rules.CRED_NAME_WORDS)} AND value_is_str
            AND value_len > {rules.CRED_MIN_LENGTH_EXCLUSIVE} AND NOT {any_of('lower(code)', rules.CRED_LINE_PLACEHOLDERS)} THEN 7 END"""
    dim = [(r, *rest) for r, _, *rest in rules.CWE_RULES] + [(7, *rules.CRED_RULE)]
    values = ", ".join(f"({r}, {listed(rest)})" for r, *rest in dim)
    return f"""
WITH facts AS (SELECT * FROM {facts}_of(TABLE(SELECT repo, path, content FROM {files}
               WHERE path LIKE '%.py' AND NOT {any_of("regexp_extract(path, '^(.*)/[^/]*$', 1)", rules.AST_SKIP_SUBSTRINGS)}))),
hits AS (SELECT *, {case} AS rule FROM facts),
rules AS (SELECT * FROM VALUES {values} AS r(rule, cwe, vulnerability, severity, template))
SELECT repo, path, ord, line, cwe, vulnerability, severity, code,
       replace(replace(template, '%s', name), '%d', coalesce(CAST(value_len AS STRING), '')) AS description
FROM hits JOIN rules USING (rule)"""
