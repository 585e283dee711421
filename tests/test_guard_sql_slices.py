"""Strict payload audit, the SQL table function, and line slices over an index of blocks."""

import json
import random

from corpuslens.functions import sql
from corpuslens.operators import guardrails, paths, vuln


def test_strict_audit_sees_values_as_they_are(spark):
    payloads = [{"cmd": "rm\t-rf /"}, {"a": {"b": [1, None, {"c": "rm -rf /"}]}}, {"a": ["ok", "ls"]}, {"x": "rm\n-rf /", "y": [["rm\t-rf /"]]}, {}, [], "rm -rf /"]
    texts = [json.dumps(p) for p in payloads] + ["no json rm -rf /", None, ""]
    calls = spark.createDataFrame(list(enumerate(texts)), "n int, payload string")
    plain = {r.n: r.blocked for r in guardrails.audit_payloads(calls).collect()}
    got = {r.n: (r.blocked, r.blocked_at) for r in guardrails.audit_payloads(calls, strict=True).collect()}
    assert [plain[n] for n in range(10)] == [False, True, False, False, False, False, True, True, False, False]
    assert got == {0: (True, "$.cmd"), 1: (True, "$.a.b[2].c"), 2: (False, None), 3: (True, "$.x"), 4: (False, None), 5: (False, None), 6: (True, "$"),
                   7: (True, None), 8: (False, None), 9: (False, None)}


def test_payload_json_keeps_unknown_keys(spark):
    text = '{"known":1,"more":{"deep":[1,"two",null]}}'
    df = spark.createDataFrame([(text,), ("no json",), (None,)], "t string").select(guardrails.from_payload_json("t").alias("v"))
    assert [r.j for r in df.select(guardrails.to_payload_json("v").alias("j")).collect()] == [text, None, None]


def test_table_function_in_sql_equals_the_operator(spark):
    files = [("r", f"p/{i}.py", t) for i, t in enumerate(["eval(x)\n", "import yaml\nyaml.load(x)\n", "API_KEY = 'abcdef-0123456'\n", "def broken(:\n", "", None,
                                                          "cursor.execute(f\"select {x}\")\nsubprocess.run(x, shell=True)\n"])]
    files += [("r", "tests/x.py", "eval(x)\n"), ("r", "a.txt", "eval(x)\n")]
    df = spark.createDataFrame(files, "repo string, path string, content string")
    df.createOrReplaceTempView("files_of_test")
    sql.register_fact_function(spark, "facts_of_test")
    got = spark.sql(sql.findings_sql("files_of_test", "facts_of_test"))
    want = vuln.scan_findings(df, prefilter=False)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) and got.count() > 4


def test_slices_of_many_requests_equal_readlines(spark):
    import io
    rnd = random.Random(3)
    files = {"big.py": "".join(f"line {i}" + rnd.choice(["\n", "\r\n", "\r", "\n\n"]) for i in range(3000)) + "end", "one.py": "x\n", "empty.py": "", "none.py": None}
    lines = {k: list(io.StringIO(v, newline=None)) for k, v in files.items() if v is not None}
    asked = [(i, rnd.choice([*files, "gone.py", "big.py", "big.py"]), rnd.choice([None, -3, 1, rnd.randint(1, 4000)]), rnd.choice([None, 0, rnd.randint(1, 4000)]))
             for i in range(1500)]
    df = spark.createDataFrame([("r", *f) for f in files.items()], "repo string, path string, content string")
    req = spark.createDataFrame([(i, "r", p, s, e) for i, p, s, e in asked + asked[:5]], "request_id int, repo string, path string, start_line int, end_line int")
    rows = paths.slice_lines(df, req).collect()
    assert len(rows) == 1505
    got = {r.request_id: r for r in rows}
    for i, path, start, stop in asked:
        r = got[i]
        if path not in lines:
            assert (r.status, r.text) == ("NOT_FOUND", None)
            continue
        n = len(lines[path])
        s, e = max(start or 1, 1), n if stop is None else min(stop, n)
        assert (r.start_line, r.end_line, r.total_lines, r.status) == (s, e, n, "RANGE_ERROR" if s > e else "OK")
        if s <= e:
            assert r.text == f"=== File: {path} (Lines {s} to {e} of {n}) ===\n" + "".join(lines[path][s - 1:e])


def test_table_function_over_a_table_of_files(spark):
    df = spark.createDataFrame([("r", "a.py", "eval(x)\ny = 1\n"), (None, "b.py", "def (:\n"), ("r", None, None)], "repo string, path string, content string")
    df.createOrReplaceTempView("files_of_table_test")
    sql.register_fact_function(spark, "facts_of_table")
    got = spark.sql("SELECT * FROM facts_of_table_of(TABLE(SELECT repo, path, content FROM files_of_table_test))")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, vuln.python_facts(df).collect())) and got.count() == 3
