"""Catalogue part 3: path filters, ignore rules, tree roll-up, imports, tags, manifests, sources, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import PY_SPACE_CLASS, is_remote_target, repo_name, strip_tagged, tagged_block
from corpuslens.operators import context, manifests, paths, scoring
from corpuslens.operators.patching import escapes_base
from corpuslens.plans.catalog import DOCS, documents_files, query, spread, table, table_sql
from corpuslens.plans.oracle import LINE_RE, islands_ctes, kw_score_expr, q, secrets_ctes, snippet_body_ctes

# pages as a corpus: repo = host, path = <lang>/<dir by url shape>/<name by tld>, content = html
PAGE_FILES_SQL = """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo,
  coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1), ''), 'root') || '/' ||
  CASE WHEN url LIKE '%utm_source%' THEN '.github/workflows/'
       WHEN url LIKE '%?%' THEN 'tests/'
       WHEN url LIKE '%#%' THEN '.cache/'
       WHEN url LIKE '%://m.%' THEN 'node_modules/'
       WHEN url LIKE '%://blog.%' THEN 'src/gen/'
       ELSE 'src/' END ||
  CASE WHEN url LIKE '%.com/%' THEN 'page_' || CAST(page_id AS STRING) || '.py'
       WHEN url LIKE '%.net/%' THEN 'spec_' || CAST(page_id AS STRING) || '.js'
       ELSE 'Readme' || CAST(page_id AS STRING) || '.txt' END AS path,
  html AS content, page_id, url
FROM pages"""


def page_files(spark, sf_dir):
    return spread(table_sql(spark, sf_dir, PAGE_FILES_SQL)).withColumn("size_bytes", F.octet_length("content"))


PF = f"pf AS ({PAGE_FILES_SQL})"


def _in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


@query("dir_prune_filter", f"""
WITH {PF}
SELECT repo, path FROM pf
WHERE len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
                      lambda s: lower(s) IN {_in_list(rules.IGNORED_DIRS)} OR starts_with(s, '.'))) = 0
""")
def q_dir_prune_filter(spark, sf_dir):
    return paths.prune_dirs(page_files(spark, sf_dir)).select("repo", "path")


@query("ext_filter", f"""
WITH {PF}
SELECT repo, path FROM pf WHERE {' OR '.join(f"ends_with(path, {q(e)})" for e in rules.SOURCE_EXTENSIONS)}
""")
def q_ext_filter(spark, sf_dir):
    return paths.filter_ext(page_files(spark, sf_dir)).select("repo", "path")


@query("skip_boilerplate", f"""
WITH {PF}
SELECT repo, path FROM pf
WHERE NOT ({' OR '.join(f"contains(lower(string_split(path, '/')[-1]), {q(t)})" for t in rules.BOILERPLATE_TERMS)})
""")
def q_skip_boilerplate(spark, sf_dir):
    return paths.skip_boilerplate(page_files(spark, sf_dir)).select("repo", "path")


@query("size_cap_filter", f"""
WITH {DOCS} SELECT repo, path FROM docs WHERE strlen(content) <= 8000
""")
def q_size_cap_filter(spark, sf_dir):
    return paths.size_cap(documents_files(spark, sf_dir), 8000).select("repo", "path")


IGNORE = paths.gitignore_patterns(["# build output", "tests/", "*.txt", "", "fr/src", "node_modules"])
# What each rule of IGNORE and the built-in ones says of a path prefix p or a path segment s.
_IGNORED_PREFIX = ("p LIKE '%.txt' OR p IN ('fr/src', 'node_modules', '.git', '__pycache__', '.agents', '.githooks', 'hooks') "
                   "OR p LIKE '%.pyc' OR p LIKE '%.pyo' OR p LIKE '%.pyd'")
_IGNORED_SEGMENT = _IGNORED_PREFIX.replace("p ", "s ") + " OR s = 'tests'"


def _ignore_sql(files: str, extra_prefix: str = "false", extra_segment: str = "false") -> str:
    """The files of a CTE (repo, path, ...) that no rule matches; the extra conditions may name repo."""
    return f"""
ig AS (SELECT *, string_split(path, '/') AS segs FROM {files}),
kept AS (SELECT * FROM ig WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(segs) AS s, unnest(list_transform(range(1, len(segs) + 1), lambda i: array_to_string(segs[1:i], '/'))) AS p)
  WHERE {_IGNORED_PREFIX} OR {_IGNORED_SEGMENT} OR {extra_prefix} OR {extra_segment}))"""


@query("ignore_rules", f"""
WITH {PF}, {_ignore_sql('pf')}
SELECT repo, path FROM kept
""")
def q_ignore_rules(spark, sf_dir):
    return paths.apply_ignore_rules(page_files(spark, sf_dir), IGNORE).select("repo", "path")


# Rules of single repositories, among them classes, a bracket that isn't closed and a range that runs backwards.
REPO_RULES_SQL = """
SELECT repo, CASE length(repo) % 5 WHEN 0 THEN '*[02468].py' WHEN 1 THEN '[!a-eg-z]*' WHEN 2 THEN 'src[gen/'
                                   WHEN 3 THEN 'page_[9-1]*' ELSE '[[.]cache/' END AS pattern
FROM (SELECT DISTINCT repo FROM files) r
UNION ALL
SELECT DISTINCT repo, 'gen/' FROM files WHERE repo LIKE '%.net'"""


@query("repo_ignore_rules", f"""
WITH {PF}, {_ignore_sql('pf',
    "(length(repo) % 5 = 0 AND (regexp_matches(p, '[02468][.]py$') OR regexp_matches(s, '[02468][.]py$'))) "
    "OR (length(repo) % 5 = 1 AND (left(p, 1) NOT BETWEEN 'a' AND 'z' OR left(p, 1) = 'f' OR left(s, 1) NOT BETWEEN 'a' AND 'z' OR left(s, 1) = 'f'))",
    "(length(repo) % 5 = 4 AND s = '.cache') OR (repo LIKE '%.net' AND s = 'gen')")}
SELECT repo, path FROM kept
""")
def q_repo_ignore_rules(spark, sf_dir):
    files = page_files(spark, sf_dir)
    own = spark.sql(REPO_RULES_SQL.replace("FROM files", "FROM {files}"), files=files)
    return paths.apply_ignore_rules(files, IGNORE, own).select("repo", "path")


@query("dir_rollup", f"""
WITH {PF}, {_ignore_sql('pf')},
k AS (SELECT repo, segs, strlen(content) AS b FROM kept
      WHERE {' OR '.join(f"(ends_with(path, {q(e)}) AND segs[-1] <> {q(e)})" for e in rules.TREE_EXTENSIONS)}),
d AS (SELECT repo, b, unnest(list_transform(range(0, len(segs)),
        lambda i: CASE WHEN i = 0 THEN '' ELSE array_to_string(segs[1:i], '/') END)) AS dir FROM k)
SELECT repo, dir, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(b) AS BIGINT) AS n_bytes FROM d GROUP BY repo, dir
""")
def q_dir_rollup(spark, sf_dir):
    """What the ignore rules leave, rolled up by directory."""
    return paths.dir_rollup(paths.apply_ignore_rules(page_files(spark, sf_dir), IGNORE))


@query("tree_listing", f"""
WITH {PF}, {_ignore_sql('pf')},
k AS (SELECT repo, segs, path, strlen(content) AS b FROM kept
      WHERE {' OR '.join(f"(ends_with(path, {q(e)}) AND segs[-1] <> {q(e)})" for e in rules.TREE_EXTENSIONS)}),
e AS (SELECT repo, unnest(list_transform(range(1, len(segs) + 1), lambda i: {{'p': segs[1:i], 'd': i < len(segs)}})) AS x, b FROM k),
g AS (SELECT repo, x.p AS p, x.d AS is_dir, count(*) AS n_files, sum(b) AS n_bytes FROM e GROUP BY ALL)
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY list_transform(p, lambda s, i:
         {{'f': CASE WHEN NOT is_dir AND i = len(p) THEN 1 ELSE 0 END, 'l': lower(s), 's': s}})) AS pos,
       array_to_string(p, '/') AS path, CAST(len(p) AS INTEGER) AS depth, is_dir,
       CAST(n_files AS BIGINT) AS n_files, CAST(n_bytes AS BIGINT) AS n_bytes
FROM g
""")
def q_tree_listing(spark, sf_dir):
    """What the ignore rules leave, as the numbered entries of every repo's tree."""
    return paths.tree_listing(paths.apply_ignore_rules(page_files(spark, sf_dir), IGNORE))


SLICE_BY_LANG = {"en": (None, None), "fr": (0, 5), "de": (3, 999), "es": (5, 3)}


def _slice_case(i: int) -> str:
    return "CASE lang " + " ".join(f"WHEN {q(k)} THEN {('NULL' if v[i] is None else v[i])}"
                                   for k, v in SLICE_BY_LANG.items()) + " ELSE 2 END"


@query("slice_lines", f"""
WITH r AS (SELECT doc_id AS request_id, source AS repo, lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS path,
                  text, {_slice_case(0)} AS s0, {_slice_case(1)} AS e0,
                  regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+\\z') AS lines FROM documents),
c AS (SELECT *, len(lines) AS n, greatest(coalesce(s0, 1), 1) AS s, least(coalesce(e0, len(lines)), len(lines)) AS e FROM r)
SELECT request_id, repo, path, CASE WHEN s > e THEN 'RANGE_ERROR' ELSE 'OK' END AS status,
       CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, CAST(n AS INTEGER) AS total_lines,
       md5(CASE WHEN s > e THEN 'Error: start_line (' || s || ') cannot exceed end_line (' || e || '). Total lines: ' || n || '.'
           ELSE '=== File: doc_' || CAST(request_id AS VARCHAR) || '.py (Lines ' || s || ' to ' || e || ' of ' || n || ') ===' || chr(10)
                || array_to_string(list_slice(lines, s, e), '') END) AS text_md5
FROM c
""")
def q_slice_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = documents_files(spark, sf_dir)
    req = d.select(F.col("doc_id").alias("request_id"), F.col("source").alias("repo"),
                   F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                   F.expr(_slice_case(0)).cast("int").alias("start_line"),
                   F.expr(_slice_case(1)).cast("int").alias("end_line"))
    out = paths.slice_lines(files, req)
    return out.select("request_id", "repo", "path", "status", "start_line", "end_line", "total_lines",
                      F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ imports --
HREF = r'href="([^"]+)"'


def _page_project(spark, sf_dir):
    return paths.prune_dirs(paths.filter_ext(page_files(spark, sf_dir)))


def _page_imports(spark, sf_dir):
    return scoring.extract_imports(page_files(spark, sf_dir), patterns=(HREF,), java_pattern=None)


_STD = "^(?:" + "|".join(rules.STDLIB_IMPORT_PREFIXES) + ")"
IMPORTS_SQL = f"""{PF},
proj AS (SELECT repo, path FROM pf WHERE ({' OR '.join(f"ends_with(path, {q(e)})" for e in rules.SOURCE_EXTENSIONS)})
         AND len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
                      lambda s: lower(s) IN {_in_list(rules.IGNORED_DIRS)} OR starts_with(s, '.'))) = 0),
imp AS (SELECT DISTINCT repo, path AS src, regexp_replace(lower(h), '^/+|/+$', '', 'g') AS m
        FROM (SELECT repo, path, unnest(regexp_extract_all(content, {q(HREF)}, 1)) AS h FROM pf)),
impk AS (SELECT * FROM imp WHERE NOT regexp_matches(m, {q(_STD)})),
cand AS (SELECT i.repo, i.src, i.m, p.path AS dst,
                row_number() OVER (PARTITION BY i.repo, i.src, i.m ORDER BY p.path) AS rk
         FROM impk i JOIN proj p ON i.repo = p.repo AND contains(lower(p.path), i.m)),
edges AS (SELECT DISTINCT repo, src, dst FROM cand WHERE rk = 1)"""


@query("import_edges", f"WITH {IMPORTS_SQL} SELECT repo, src, dst FROM edges")
def q_import_edges(spark, sf_dir):
    return scoring.resolve_imports(_page_imports(spark, sf_dir), _page_project(spark, sf_dir))


@query("imports_distinct", f"WITH {IMPORTS_SQL} SELECT repo, src, m AS match_clean FROM impk")
def q_imports_distinct(spark, sf_dir):
    i = _page_imports(spark, sf_dir)
    return i.select("repo", F.col("path").alias("src"), "match_clean").distinct()


PAGE_KW = ('<div class="ad"', "spam")


@query("import_boost", f"""
WITH {IMPORTS_SQL},
sc AS (SELECT p.repo, p.path, {kw_score_expr('f.content', PAGE_KW)} AS score
       FROM proj p JOIN pf f ON p.repo = f.repo AND p.path = f.path),
b AS (SELECT e.repo, e.dst AS path, 2 * count(*) AS boost FROM edges e JOIN sc s ON e.repo = s.repo AND e.src = s.path
      WHERE s.score > 0 GROUP BY e.repo, e.dst)
SELECT sc.repo, sc.path, CAST(sc.score AS BIGINT) AS score_pre, CAST(coalesce(b.boost, 0) AS BIGINT) AS boost,
       CAST(sc.score + coalesce(b.boost, 0) AS BIGINT) AS score
FROM sc LEFT JOIN b ON sc.repo = b.repo AND sc.path = b.path
""")
def q_import_boost(spark, sf_dir):
    proj = _page_project(spark, sf_dir)
    scored = scoring.score_files(proj, keywords=PAGE_KW, with_lines=False)
    edges = scoring.resolve_imports(_page_imports(spark, sf_dir), proj)
    b = scoring.import_boost(scored, edges)
    return b.select("repo", "path", (F.col("score") - F.col("boost")).alias("score_pre"), "boost", "score")


JAVA_FILES_SQL = """
SELECT 'acme' AS repo, 'src/com/acme/' || replace(lower(r_name), ' ', '_') || '/Util.java' AS path,
       'package com.acme.' || replace(lower(r_name), ' ', '_') || ';' AS content FROM region
UNION ALL
SELECT 'acme', 'src/com/acme/nations/' || replace(n_name, ' ', '_') || '.java',
       'package com.acme.nations;' || chr(10) || 'import com.acme.' || replace(lower(r_name), ' ', '_') || '.Util;'
       || chr(10) || 'import java.util.List;' || chr(10)
FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query("java_import_edges", f"""
SELECT 'acme' AS repo, 'src/com/acme/nations/' || replace(n_name, ' ', '_') || '.java' AS src,
       'src/com/acme/' || replace(lower(r_name), ' ', '_') || '/Util.java' AS dst
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def q_java_import_edges(spark, sf_dir):
    files = table_sql(spark, sf_dir, JAVA_FILES_SQL)
    imps = scoring.extract_imports(files)
    return scoring.resolve_imports(imps, files)


# -------------------------------------------------------------------- tags --
_STRIP = "regexp_replace({x}, " + q('^' + PY_SPACE_CLASS + '+|' + PY_SPACE_CLASS + '+$').replace("{", "{{").replace("}", "}}") + ", '', 'g')"


@query("thought_extract", f"""
SELECT page_id, regexp_matches(html, '(?s)<title>(.*?)</title>') AS has_tag,
       CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>')
            THEN {_STRIP.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} ELSE '' END AS body
FROM pages
""")
def q_thought_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("html").rlike("(?s)<title>(.*?)</title>").alias("has_tag"),
                    tagged_block(F.col("html"), "title", "").alias("body"))


@query("strip_thought", f"""
SELECT page_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS text_md5 FROM (
  SELECT page_id, {_STRIP.format(x="regexp_replace(html, '(?s)<script>.*?</script>', '', 'g')")} AS s FROM pages)
""")
def q_strip_thought(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    s = strip_tagged(F.col("html"), "script")
    return p.select("page_id", F.length(s).cast("int").alias("n_chars"), F.md5(s).alias("text_md5"))


@query("target_kind", """
SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'git@') AS is_remote,
       coalesce(nullif(replace(string_split(url, '/')[-1], '.git', ''), ''), 'cloned_repo') AS repo_name
FROM pages
""")
def q_target_kind(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", is_remote_target(F.col("url")).alias("is_remote"), repo_name(F.col("url")).alias("repo_name"))


@query("path_parts", """
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '^/+|/+$', '', 'g') AS p FROM pages),
n AS (SELECT page_id, p, string_split(p, '/')[-1] AS name, strpos(reverse(string_split(p, '/')[-1]), '.') AS k FROM u)
SELECT page_id, name,
       CASE WHEN k > 0 AND length(name) - k + 1 > 1 AND length(name) - k + 1 < length(name)
            THEN substr(name, length(name) - k + 1) ELSE '' END AS suffix,
       CAST(len(string_split(p, '/')) AS INTEGER) AS n_segments
FROM n
""")
def q_path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rel = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1), "^/+|/+$", "")
    return p.select("page_id", paths.path_name(rel).alias("name"), paths.path_suffix(rel).alias("suffix"),
                    F.size(paths.path_segments(rel)).cast("int").alias("n_segments"))


@query("ast_path_skip", f"""
WITH {PF}
SELECT repo, path FROM pf WHERE ends_with(path, '.py')
  AND NOT ({' OR '.join(f"contains(regexp_extract(path, '^(.*)/[^/]*$', 1), {q(s)})" for s in rules.AST_SKIP_SUBSTRINGS)})
""")
def q_ast_path_skip(spark, sf_dir):
    from corpuslens.operators import vuln
    return vuln.ast_path_skip(page_files(spark, sf_dir)).select("repo", "path")


GUARD_FORMS = (("plain", "", False), ("parent", "../", True), ("deep_parent", "a/../../", True),
               ("inner_dot", "a/./b/../", False), ("absolute", "/abs/", True))


@query("path_guard", f"""
WITH {PF}
SELECT page_id, form, escapes FROM pf, (VALUES {', '.join(f"({q(f)}, {q(p)}, {str(e).lower()})" for f, p, e in GUARD_FORMS)}) g(form, prefix, escapes)
""")
def q_path_guard(spark, sf_dir):
    pf = page_files(spark, sf_dir)
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(p).alias("prefix")) for f, p, _ in GUARD_FORMS])
    x = pf.select("page_id", "path", F.explode(forms).alias("g"))
    return x.select("page_id", F.col("g.form").alias("form"),
                    escapes_base(F.concat(F.col("g.prefix"), F.col("path"))).alias("escapes"))


# --------------------------------------------------------------- manifests --
PART_LINE_SQL = """
CASE WHEN p_size <= 10 THEN lower(replace(p_brand, '#', '-')) || '==' || CAST(p_size AS STRING)
     WHEN p_size <= 20 THEN 'pkg_' || CAST(p_partkey AS STRING) || '>=' || CAST(p_size AS STRING) || '.0,<' || CAST(p_size + 1 AS STRING)
     WHEN p_size <= 30 THEN replace(p_name, ' ', '_') || '[extra] ~= ' || CAST(p_size AS STRING) || '.1'
     WHEN p_size <= 40 THEN 'lib' || CAST(p_partkey AS STRING) || '!=' || CAST(p_size AS STRING)
     WHEN p_size <= 45 THEN '# pinned for ' || p_name
     ELSE '-r requirements-' || CAST(p_size AS STRING) || '.txt' END"""
PART_LINES_SQL = (f"SELECT 'type_' || lower(p_type) AS repo, 'requirements.txt' AS manifest, "
                  f"CAST(p_partkey AS INTEGER) AS line_no, {PART_LINE_SQL} AS raw FROM part")


def part_lines(spark, sf_dir):
    return table_sql(spark, sf_dir, PART_LINES_SQL)


_MP = rules.MANIFEST_LINE_PATTERN


@query("manifest_parse", f"""
WITH l AS ({PART_LINES_SQL})
SELECT repo, manifest, line_no,
       CASE WHEN regexp_matches(raw, {q(_MP)}) THEN regexp_extract(raw, {q(_MP)}, 1) END AS package,
       CASE WHEN regexp_matches(raw, {q(_MP)}) THEN regexp_extract(raw, {q(_MP)}, 2) END AS op,
       CASE WHEN regexp_matches(raw, {q(_MP)}) THEN regexp_extract(raw, {q(_MP)}, 3) END AS version,
       regexp_matches(raw, {q(_MP)}) AS parsed, raw
FROM l WHERE raw <> '' AND NOT starts_with(raw, '#') AND NOT starts_with(raw, '-')
""")
def q_manifest_parse(spark, sf_dir):
    return manifests.parse_manifest(part_lines(spark, sf_dir))


@query("constraint_drift", f"""
WITH l AS ({PART_LINES_SQL}),
d AS (SELECT repo, regexp_extract(raw, {q(_MP)}, 1) AS package,
             regexp_extract(raw, {q(_MP)}, 2) || regexp_extract(raw, {q(_MP)}, 3) AS c
      FROM l WHERE regexp_matches(raw, {q(_MP)}) AND NOT starts_with(raw, '#') AND NOT starts_with(raw, '-'))
SELECT package, CAST(count(DISTINCT repo) AS BIGINT) AS n_repos, CAST(count(DISTINCT c) AS BIGINT) AS n_constraints,
       list_sort(list(DISTINCT c)) AS constraints, count(DISTINCT c) > 1 AS drift
FROM d GROUP BY package
""")
def q_constraint_drift(spark, sf_dir):
    return manifests.constraint_drift(manifests.parse_manifest(part_lines(spark, sf_dir)))


FW_MANIFEST_SQL = """
SELECT 'nation_' || lower(replace(n_name, ' ', '_')) AS repo, 'requirements.txt' AS manifest,
       CASE r_name WHEN 'AFRICA' THEN 'Flask==2.0' || chr(10) || 'requests'
                   WHEN 'AMERICA' THEN 'django>=4'
                   WHEN 'MIDDLE EAST' THEN 'flask' || chr(10) || 'Django' ELSE 'numpy' END AS text
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'nation_' || lower(replace(n_name, ' ', '_')), 'package.json',
       CASE r_name WHEN 'ASIA' THEN '{"dependencies": {"express": "4", "pg": "8"}}'
                   WHEN 'EUROPE' THEN '{"dependencies": {"mysql": "2", "sequelize": "6"}}'
                   ELSE '{"dependencies": {"express": "4"}}' END
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'"""


def _fw_expected() -> str:
    parts = []
    for i, (man, words, kws) in enumerate(rules.FRAMEWORK_KEYWORDS):
        cond = " OR ".join(f"contains(lower(text), {q(w)})" for w in words)
        parts.append(f"SELECT repo, {i} AS ord, {q(chr(31).join(kws))} AS kws FROM m WHERE manifest = {q(man)} AND ({cond})")
    return "\nUNION ALL\n".join(parts)


@query("framework_keywords", f"""
WITH m AS ({FW_MANIFEST_SQL}),
x AS ({_fw_expected()}),
r AS (SELECT DISTINCT repo FROM m)
SELECT r.repo, CAST({len(rules.RISK_KEYWORDS)} + coalesce(sum(len(string_split(x.kws, chr(31)))), 0) AS INTEGER) AS n_keywords,
       {q(chr(31).join(rules.RISK_KEYWORDS))} || coalesce(chr(31) || string_agg(x.kws, chr(31) ORDER BY x.ord), '') AS keywords
FROM r LEFT JOIN x ON r.repo = x.repo GROUP BY r.repo
""")
def q_framework_keywords(spark, sf_dir):
    kw = scoring.framework_keywords(table_sql(spark, sf_dir, FW_MANIFEST_SQL))
    return kw.select("repo", F.size("keywords").cast("int").alias("n_keywords"),
                     F.array_join("keywords", chr(31)).alias("keywords"))


@query("import_boost_cascade", f"""
WITH RECURSIVE {IMPORTS_SQL},
sc AS (SELECT p.repo, p.path, {kw_score_expr('f.content', PAGE_KW)} AS score
       FROM proj p JOIN pf f ON p.repo = f.repo AND p.path = f.path),
fwd AS (SELECT e.repo, e.src, e.dst FROM edges e JOIN sc ON e.repo = sc.repo AND e.dst = sc.path WHERE e.src < e.dst),
live(repo, src) AS (
  SELECT repo, path FROM sc WHERE score > 0
  UNION
  SELECT f.repo, f.dst FROM fwd f JOIN live l ON f.repo = l.repo AND f.src = l.src
),
b AS (SELECT e.repo, e.dst AS path, 2 * count(*) AS boost FROM edges e JOIN live l ON e.repo = l.repo AND e.src = l.src
      GROUP BY e.repo, e.dst)
SELECT sc.repo, sc.path, CAST(sc.score AS BIGINT) AS score_pre, CAST(coalesce(b.boost, 0) AS BIGINT) AS boost,
       CAST(sc.score + coalesce(b.boost, 0) AS BIGINT) AS score
FROM sc LEFT JOIN b ON sc.repo = b.repo AND sc.path = b.path
""")
def q_import_boost_cascade(spark, sf_dir):
    proj = _page_project(spark, sf_dir)
    scored = scoring.score_files(proj, keywords=PAGE_KW, with_lines=False)
    edges = scoring.resolve_imports(_page_imports(spark, sf_dir), proj)
    b = scoring.import_boost(scored, edges, cascade=True)
    return b.select("repo", "path", (F.col("score") - F.col("boost")).alias("score_pre"), "boost", "score")


@query("hierarchy", f"""
WITH {PF}
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY path) AS idx, path FROM pf
WHERE len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
                      lambda s: lower(s) IN {_in_list(rules.IGNORED_DIRS)} OR starts_with(s, '.'))) = 0
""")
def q_hierarchy(spark, sf_dir):
    """G14 listing part: every file under non-pruned directories, numbered and kept as rows (it grows with the repo)."""
    return context.hierarchy(page_files(spark, sf_dir))


# ---------------------------------------------------------- review context --
# The page corpus with a line that calls framework functions and links that resolve inside the repo; the manifests of
# a host are those of the nation that its name's length and page count pick.

CTX_FILES_SQL = f"""
SELECT repo, path, content || chr(10) ||
  CASE page_id % 6 WHEN 0 THEN 'v = request.args + request.form; db.query(v)'
                   WHEN 1 THEN 'res.send(req.query); execute(v)'
                   WHEN 2 THEN 'Request.GET; objects.raw(password)'
                   WHEN 3 THEN 'sequelize.query(v, token)' ELSE 'pass' END || chr(10) ||
  CASE page_id % 4 WHEN 0 THEN '<a href="/src/">' WHEN 1 THEN '<a href="page_' || CAST(page_id % 10 AS STRING) || '">' ELSE '' END
  AS content
FROM ({PAGE_FILES_SQL}) pages_as_files"""
CTX_MANIFEST_SQL = f"""
SELECT h.repo, m.manifest, m.text
FROM (SELECT repo, 'nation_' || lower(replace(n_name, ' ', '_')) AS nation
      FROM (SELECT repo, (length(repo) + count(*)) % 25 AS k FROM ({PAGE_FILES_SQL}) pages_as_files GROUP BY repo) g
      JOIN nation ON n_nationkey = k) h
JOIN ({FW_MANIFEST_SQL}) m ON m.repo = h.nation"""
CTX = dict(threshold=4.0, max_chars=12000, max_files=4, min_tail=1000, reserve=100, switch_chars=3000, window=1)


def _ctx_sql() -> str:
    def entry(label, body):
        return (f"chr(10) || 'FILE: ' || path || ' (' || {label} || ', Risk Score: ' || CAST(score AS VARCHAR) || ')' "
                f"|| chr(10) || '```' || chr(10) || {body} || chr(10) || '```'")
    exts = " OR ".join(f"ends_with(path, {q(e)})" for e in rules.SOURCE_EXTENSIONS)
    boiler = " OR ".join(f"contains(lower(string_split(path, '/')[-1]), {q(t)})" for t in rules.BOILERPLATE_TERMS)
    fw_score = " + ".join(f"coalesce(w.f{i}, 0) * {kw_score_expr('c.content', kws)}"
                          for i, (_, _, kws) in enumerate(rules.FRAMEWORK_KEYWORDS))
    fw_flags = ", ".join(
        f"max(CASE WHEN manifest = {q(man)} AND ({' OR '.join(f'contains(lower(text), {q(x)})' for x in words)}) THEN 1 ELSE 0 END) AS f{i}"
        for i, (man, words, _) in enumerate(rules.FRAMEWORK_KEYWORDS))

    def any_kw(kws):
        return "(" + " OR ".join(f"contains(lower(ls[i]), {q(k.lower())})" for k in kws) + ")"
    kw_line = " OR ".join([any_kw(rules.RISK_KEYWORDS)] + [
        f"(coalesce(f{i}, 0) = 1 AND {any_kw(kws)})" for i, (_, _, kws) in enumerate(rules.FRAMEWORK_KEYWORDS)])
    m, t, r = CTX["max_chars"], CTX["min_tail"], CTX["reserve"]
    return f"""WITH RECURSIVE cf AS ({CTX_FILES_SQL}), mf AS ({CTX_MANIFEST_SQL}),
fwf AS (SELECT repo, {fw_flags} FROM mf GROUP BY repo),
listed AS (SELECT * FROM cf
           WHERE len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
                     lambda s: lower(s) IN {_in_list(rules.IGNORED_DIRS)} OR starts_with(s, '.'))) = 0),
proj AS (SELECT * FROM listed WHERE {exts}),
cand AS (SELECT * FROM proj WHERE NOT ({boiler}) AND strlen(content) <= {rules.MAX_FILE_BYTES}),
{secrets_ctes('cand', CTX['threshold'])},
sec_n AS (SELECT repo, path, count(*) AS n FROM sec_all GROUP BY repo, path),
sc AS (SELECT c.repo, c.path, c.content,
              {kw_score_expr('c.content', rules.RISK_KEYWORDS)} + {fw_score} + 5 * coalesce(s.n, 0) AS score0
       FROM cand c LEFT JOIN fwf w ON c.repo = w.repo LEFT JOIN sec_n s ON c.repo = s.repo AND c.path = s.path),
imp AS (SELECT DISTINCT repo, path AS src, regexp_replace(lower(h), '^/+|/+$', '', 'g') AS m
        FROM (SELECT repo, path, unnest(regexp_extract_all(content, {q(HREF)}, 1)) AS h FROM cand)),
edges AS (SELECT DISTINCT i.repo, i.src, (SELECT min(p.path) FROM proj p WHERE p.repo = i.repo AND contains(lower(p.path), i.m)) AS dst
          FROM imp i WHERE NOT regexp_matches(m, {q(_STD)})),
fwd AS (SELECT e.repo, e.src, e.dst FROM edges e JOIN sc ON e.repo = sc.repo AND e.dst = sc.path WHERE e.src < e.dst),
live(repo, src) AS (
  SELECT repo, path FROM sc WHERE score0 > 0
  UNION
  SELECT f.repo, f.dst FROM fwd f JOIN live l ON f.repo = l.repo AND f.src = l.src
),
b AS (SELECT e.repo, e.dst AS path, 2 * count(*) AS boost FROM edges e JOIN live l ON e.repo = l.repo AND e.src = l.src
      GROUP BY e.repo, e.dst),
boosted AS (SELECT sc.repo, sc.path, sc.content, CAST(score0 + coalesce(boost, 0) AS BIGINT) AS score
            FROM sc LEFT JOIN b ON sc.repo = b.repo AND sc.path = b.path),
lines AS (SELECT c.repo, c.path, c.ls, unnest(generate_series(1, len(c.ls))) AS i, w.*EXCLUDE (repo)
          FROM (SELECT repo, path, string_split_regex(content, {q(LINE_RE)}) AS ls FROM cand) c LEFT JOIN fwf w ON c.repo = w.repo),
ml AS (SELECT DISTINCT repo, path, line FROM (
         SELECT repo, path, i AS line FROM lines WHERE {kw_line}
         UNION ALL SELECT repo, path, line FROM sec_all)),
{islands_ctes('cand', 'ml', CTX['window'])}, {snippet_body_ctes('cand', 'isl')},
payload AS (
  SELECT s.repo, s.path, s.score, CASE WHEN length(s.content) > {CTX['switch_chars']} AND sn.body IS NOT NULL THEN 'SNIPPETS' ELSE 'FULL' END AS label,
         CASE WHEN length(s.content) > {CTX['switch_chars']} AND sn.body IS NOT NULL THEN sn.body ELSE s.content END AS payload
  FROM boosted s LEFT JOIN snip sn ON s.repo = sn.repo AND s.path = sn.path),
rk AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM payload WHERE length(payload) > 0),
en AS (SELECT *, {entry('label', 'payload')} AS entry FROM rk WHERE rank <= {CTX['max_files']}),
cu AS (SELECT *, sum(length(entry)) OVER (PARTITION BY repo ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM en),
packed AS (
  SELECT repo, rank, CASE WHEN cum <= {m} THEN entry
         ELSE {entry("'TRUNCATED'", f"left(payload, CAST({m} - (cum - length(entry)) - {r} AS BIGINT))")} END AS entry
  FROM cu WHERE cum <= {m} OR (cum - length(entry) <= {m} AND {m} - (cum - length(entry)) > {t})),
ctx AS (
  SELECT DISTINCT repo, 0 AS section, 0 AS idx, {q(rules.HIERARCHY_HEADER)} AS text FROM cf
  UNION ALL SELECT DISTINCT repo, 1, 0, chr(10) || {q(rules.CONTENTS_HEADER.strip())} FROM cf
  UNION ALL SELECT repo, 0, row_number() OVER (PARTITION BY repo ORDER BY path), path FROM listed
  UNION ALL SELECT repo, 1, rank, entry FROM packed)
SELECT repo, CAST(section AS INTEGER) AS section, CAST(idx AS BIGINT) AS idx, CAST(length(text) AS INTEGER) AS text_chars,
       md5(text) AS text_md5 FROM ctx"""


@query("review_context", _ctx_sql())
def q_review_context(spark, sf_dir):
    """Filters, per-repo keywords, scores, import boost, rank, packing and the listing as one job."""
    files = spread(table_sql(spark, sf_dir, CTX_FILES_SQL))
    manifest_rows = table_sql(spark, sf_dir, CTX_MANIFEST_SQL)
    rows = context.review_context(files, manifest_rows, import_patterns=(HREF,), **CTX)
    return rows.select("repo", "section", "idx", F.length("text").cast("int").alias("text_chars"), F.md5("text").alias("text_md5"))
