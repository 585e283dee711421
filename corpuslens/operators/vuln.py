"""Vulnerability findings: syntax facts from Python sources, rules as Spark predicates.

The only Python on executors is `python_facts`: it parses each file (never
executes it) and emits flat call/assignment facts through Arrow batches
(`mapInArrow`).  Rule matching, descriptions, roll-ups and reports are Spark
expressions, joins and aggregations.
"""

from __future__ import annotations

import ast
import gc
import os
import pickle
import sys
import traceback
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import rules

# The fact extractor goes to executors by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT_SCHEMA = (
    "repo STRING, path STRING, kind STRING, ord INT, line INT, name STRING, has_args BOOLEAN, "
    "arg0_kind STRING, kw ARRAY<STRUCT<name: STRING, is_true: BOOLEAN, attr: STRING>>, "
    "value_is_str BOOLEAN, value_len INT, code STRING, error STRING"
)



def _callee(func: ast.AST) -> str:
    if isinstance(func, ast.Name):
        return func.id
    if isinstance(func, ast.Attribute):
        if isinstance(func.value, ast.Name):
            return f"{func.value.id}.{func.attr}"
        return func.attr
    return ""


def _arg0_kind(node: ast.Call):
    if not node.args:
        return None
    a = node.args[0]
    if isinstance(a, ast.JoinedStr):
        return "fstring"
    if isinstance(a, ast.BinOp) and isinstance(a.op, ast.Mod):
        return "mod"
    if isinstance(a, ast.Call) and isinstance(a.func, ast.Attribute) and a.func.attr == "format":
        return "format"
    return "other"


def _kw(k: ast.keyword) -> dict:
    v = k.value
    is_true = isinstance(v, ast.Constant) and v.value is True
    return {"name": k.arg, "is_true": is_true, "attr": v.attr if isinstance(v, ast.Attribute) else None}


def _preorder(tree: ast.AST) -> Iterator[ast.AST]:
    """A tree's nodes, parents first and from left to right, but for the leaves: names, constants, operators and contexts."""
    leaves = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        below = []
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                below += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, leaves)]
            elif isinstance(value, ast.AST) and not isinstance(value, leaves):
                below.append(value)
        stack += reversed(below)


def file_facts(content: str | None, callees: frozenset | None = None, targets: tuple | None = None) -> Iterator[tuple]:
    """Facts of one source file in FACT_SCHEMA's order behind the path; a parse failure is one 'error' fact.

    `callees` and `targets` leave out calls of other names and assignments of
    anything but text to names without one of these words; `ord` counts all.
    """
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield ("error", *[None] * 9, f"{type(e).__name__}: {e}")
        return
    lines: list[str] = []

    def code(n: int) -> str:
        if not lines:
            lines.extend(content.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        return lines[n - 1].strip() if 0 < n <= len(lines) else ""

    at = -1
    for node in _preorder(tree):
        if isinstance(node, ast.Call):
            at += 1
            name = _callee(node.func)
            if callees is None or name in callees:
                yield ("call", at, node.lineno, name, bool(node.args), _arg0_kind(node), [_kw(k) for k in node.keywords],
                       None, None, code(node.lineno), None)
        elif isinstance(node, ast.Assign):
            is_str = isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
            for t in node.targets:
                if isinstance(t, ast.Name):
                    at += 1
                    if targets is None or is_str and any(w in t.id.upper() for w in targets):
                        yield ("assign", at, node.lineno, t.id, None, None, None, is_str,
                               len(node.value.value) if is_str else None, code(node.lineno), None)


_FACT_COLS = ["repo", "path", "kind", "ord", "line", "name", "has_args", "arg0_kind",
              "kw", "value_is_str", "value_len", "code", "error"]


def _arrow_schema():
    import pyarrow as pa
    kw = pa.list_(pa.struct([("name", pa.string()), ("is_true", pa.bool_()), ("attr", pa.string())]))
    types = dict(repo=pa.string(), path=pa.string(), kind=pa.string(), ord=pa.int32(), line=pa.int32(),
                 name=pa.string(), has_args=pa.bool_(), arg0_kind=pa.string(), kw=kw, value_is_str=pa.bool_(),
                 value_len=pa.int32(), code=pa.string(), error=pa.string())
    return pa.schema([(c, types[c]) for c in _FACT_COLS])


def _in_child(rows, *args) -> list:
    """The list of `rows(*args)`, made by a forked process that ends with it.

    The parser keeps every name that it has seen until its process ends (CPython 3.12 and later never free them), and
    Spark's Python workers live on from task to task: parsing in them, memory would grow with the files.
    """
    out, into = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            os.close(out)
            gc.disable()  # syntax trees hold no cycles
            try:
                told = (True, list(rows(*args)))
            except BaseException:  # noqa: BLE001  (raised anew by the parent)
                told = (False, traceback.format_exc())
            with os.fdopen(into, "wb") as f:
                pickle.dump(told, f, pickle.HIGHEST_PROTOCOL)
            os._exit(0)
        finally:
            os._exit(1)
    try:
        os.close(into)
        with os.fdopen(out, "rb") as f:
            data = f.read()
    finally:
        status = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
    if status:
        raise RuntimeError(f"parsing process ended with {status}")
    done, found = pickle.loads(data)
    if not done:
        raise RuntimeError(found)
    return found


def facts_batch(files, callees: frozenset | None = None, targets: tuple | None = None):
    """One Arrow batch of (repo, path, content) -> one of their facts, or None where there are none."""
    import pyarrow as pa

    def facts():
        for repo, path, content in zip(*[files.column(c).to_pylist() for c in ("repo", "path", "content")], strict=True):
            for f in file_facts(content, callees, targets):
                yield (repo, path, *f)

    rows = _in_child(facts) if files.num_rows else []
    if not rows:
        return None
    schema = _arrow_schema()
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _facts_arrow(callees: frozenset | None, targets: tuple | None):
    """Arrow batches of (repo, path, content) -> Arrow batches of facts."""
    def run(batches):
        for rb in batches:
            found = facts_batch(rb, callees, targets)
            if found is not None:
                yield found
    return run


def python_facts(files: DataFrame, ruled_only: bool = False) -> DataFrame:
    """(repo, path, content) -> call / assign / error facts, parsed on executors in Arrow batches.

    With `ruled_only`, only calls and assignments whose name some rule asks for cross over to the JVM.
    """
    callees = frozenset(name for _, names, *_ in rules.CWE_RULES for name in names) if ruled_only else None
    targets = rules.CRED_NAME_WORDS if ruled_only else None
    return files.select("repo", "path", "content").mapInArrow(_facts_arrow(callees, targets), FACT_SCHEMA)


def ast_path_skip(files: DataFrame, strict: bool = False) -> DataFrame:
    """Keep .py files whose directory part holds none of the skip substrings (segment match when strict)."""
    d = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    if strict:
        segs = F.split(d, "/")
        bad = F.exists(segs, lambda s: s.isin(*rules.AST_SKIP_SUBSTRINGS))
    else:
        bad = F.lit(False)
        for sub in rules.AST_SKIP_SUBSTRINGS:
            bad = bad | d.contains(sub)
    return files.where(F.col("path").endswith(".py") & ~bad)


def _rule_dim(spark) -> DataFrame:
    rows = [(r, cwe, vuln, sev, desc) for r, _, cwe, vuln, sev, desc in rules.CWE_RULES]
    rows.append((7,) + rules.CRED_RULE)
    return spark.createDataFrame(rows, "rule INT, cwe STRING, vulnerability STRING, severity STRING, template STRING")


def _in(col, values) -> F.Column:
    return col.isin(*values)


def findings(facts: DataFrame) -> DataFrame:
    """Rule predicates over facts (first matching rule wins per call, as an if/elif chain).

    Output: repo, path, ord, line, cwe, vulnerability, severity, code, description.
    """
    name, kw = F.col("name"), F.col("kw")
    callees = {r: c for r, c, *_ in rules.CWE_RULES}
    shell_true = F.exists(kw, lambda k: F.coalesce((k["name"] == "shell") & k["is_true"], F.lit(False)))
    safe_loader = F.exists(kw, lambda k: F.coalesce((k["name"] == "Loader") & k["attr"].isin(*rules.SAFE_YAML_LOADERS),
                                                    F.lit(False)))
    low_code = F.lower(F.col("code"))
    sql_word = F.lit(False)
    for w in rules.SQL_WORDS:
        sql_word = sql_word | low_code.contains(w)
    cred_name = F.lit(False)
    for w in rules.CRED_NAME_WORDS:
        cred_name = cred_name | F.upper(name).contains(w)
    placeholder = F.lit(False)
    for p in rules.CRED_LINE_PLACEHOLDERS:
        placeholder = placeholder | low_code.contains(p)

    call_rule = (F.when(_in(name, callees[1]), 1)
                 .when(_in(name, callees[2]), 2)
                 .when(_in(name, callees[3]), F.when(shell_true, 3))
                 .when(_in(name, callees[4]), 4)
                 .when(_in(name, callees[5]), F.when((name == "yaml.unsafe_load") | ~safe_loader, 5))
                 .when(_in(name, callees[6]),
                       F.when(F.col("arg0_kind").isin("fstring", "mod", "format") & sql_word, 6)))
    assign_rule = F.when(cred_name & F.col("value_is_str") &
                         (F.col("value_len") > rules.CRED_MIN_LENGTH_EXCLUSIVE) & ~placeholder, 7)
    rule = F.when(F.col("kind") == "call", call_rule).when(F.col("kind") == "assign", assign_rule)
    hits = facts.withColumn("rule", rule).where(F.col("rule").isNotNull())
    dim = F.broadcast(_rule_dim(facts.sparkSession))  # fixed 7-row dimension
    desc = F.replace(F.replace(F.col("template"), F.lit("%s"), name),
                     F.lit("%d"), F.coalesce(F.col("value_len").cast("string"), F.lit("")))
    return (hits.join(dim, "rule")
            .select("repo", "path", "ord", "line", "cwe", "vulnerability", "severity", "code",
                    desc.alias("description")))


def may_have_findings(content) -> F.Column:
    """Exact pre-filter before parsing: a finding needs a rule word in the text.

    Every rule callee contains one of eval/exec/system/popen/subprocess/pickle/
    yaml, and every credential target one of the credential words, so an ASCII
    file without any of them (case-insensitive) has no finding.  Python
    NFKC-normalises identifiers, so files with any non-ASCII character always
    pass.  Skipped files are not parsed, hence report no parse errors.
    """
    low = F.lower(content)
    words = ("eval", "exec", "system", "popen", "subprocess", "pickle", "yaml") + tuple(
        w.lower() for w in rules.CRED_NAME_WORDS)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit | content.rlike(r"[^\x00-\x7F]")


def scan_findings(files: DataFrame, prefilter: bool = True) -> DataFrame:
    """Corpus -> findings: .py path filter, optional exact pre-filter, fact extraction, rules."""
    py = ast_path_skip(files)
    if prefilter:
        py = py.where(may_have_findings(F.col("content")))
    return findings(python_facts(py, ruled_only=True))


def parse_errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "error").select("repo", "path", "error")


def findings_rollup(found: DataFrame) -> DataFrame:
    """Counts per repo and (severity, cwe), with rollup subtotals."""
    return (found.rollup("repo", "severity", "cwe").agg(F.count(F.lit(1)).alias("n_findings")))


def _item(idx: F.Column) -> F.Column:
    return F.concat(
        idx.cast("string"), F.lit(". **["), F.col("severity"), F.lit("] "), F.col("vulnerability"),
        F.lit(" ("), F.col("cwe"), F.lit(")**\n   - **Location**: `"), F.col("path"), F.lit("` (Line "),
        F.col("line").cast("string"), F.lit(")\n   - **Snippet**: `"), F.col("code"),
        F.lit("`\n   - **Description**: "), F.col("description"), F.lit("\n\n"))


def findings_report_lines(found: DataFrame, repos: DataFrame) -> DataFrame:
    """G8 as a table: (repo, idx, text); idx 0 is the header, idx k the k-th finding in (path, ord) order.

    The report of a repo is the concatenation of its lines in idx order.  Items
    are numbered with a skew-safe running count, and the header needs only a
    per-repo count, so no repo's findings are ever gathered into one row.
    """
    from pyspark import StorageLevel

    from corpuslens.operators import sequence
    # Findings are read by the numbering and the header counts: keep one copy
    # (findings are a small fraction of the corpus) instead of parsing the sources three times.
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    numbered = sequence.running_count(found.withColumn("_one", F.lit(True)), "repo", ["path", "ord"], "_one", "idx")
    items = numbered.select("repo", F.col("idx").cast("long").alias("idx"), _item(F.col("idx")).alias("text"))
    counts = numbered.groupBy("repo").agg(F.max("idx").alias("n"))  # reads the checkpoint, no second parse
    header = (repos.select("repo").distinct().join(counts, "repo", "left")
              .select("repo", F.lit(0).cast("long").alias("idx"),
                      F.when(F.col("n").isNull(), F.lit(rules.CLEAN_REPORT_TEXT))
                       .otherwise(F.concat(F.lit(rules.REPORT_HEADER), F.lit("Detected **"), F.col("n").cast("string"),
                                           F.lit("** security vulnerabilities:\n\n"))).alias("text")))
    return header.unionByName(items)


def report_text(lines: DataFrame) -> DataFrame:
    """(repo, n_findings, report) by concatenating report lines; for repos whose report is known to be small."""
    return (lines.groupBy("repo")
            .agg((F.count(F.lit(1)) - 1).cast("long").alias("n_findings"),
                 F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_l"))
            .select("repo", "n_findings", F.array_join(F.transform("_l", lambda s: s["text"]), "").alias("report")))


def findings_report(found: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, n_findings, report) markdown text per repo (see `findings_report_lines` for large repos)."""
    return report_text(findings_report_lines(found, repos))


def clean_repos(found: DataFrame, repos: DataFrame) -> DataFrame:
    """Repos whose report would say no vulnerabilities were detected (anti join)."""
    return repos.select("repo").distinct().join(found.select("repo"), "repo", "left_anti")
