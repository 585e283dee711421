"""Rule semantics on the fixture shapes listed in FIXTURES.md."""

from corpuslens.operators import vuln

SRC = '''import os, subprocess, pickle, yaml
def view(uid, cursor, conn, self_):
    cursor.execute(f"SELECT * FROM users WHERE id = {uid}")
    q = f"SELECT * FROM users WHERE id = {uid}"
    cursor.execute(q)
    conn.execute("DELETE FROM t WHERE id = %s" % uid)
    self_.cursor.execute("select {}".format(uid))
    subprocess.run(uid, shell=True)
    subprocess.run(uid, shell=1)
    os.system("ls " + uid)
    eval(uid)
    data = pickle.loads(uid)
    yaml.load(uid, Loader=yaml.SafeLoader)
    yaml.load(uid, Loader=SafeLoader)
    yaml.unsafe_load(uid)
    df.eval(uid)
API_KEY = "12345678"
SECRET_KEY = "123456789"
A = DB_PASSWORD = "hunter2hunter2"
AUTH_TOKEN = "your_token_here_please"
token: str = "annotated-not-checked"
'''


def test_rules_on_fixture(spark):
    files = spark.createDataFrame([("r", "app.py", SRC), ("r", "bad.py", "def (:\n")],
                                  "repo string, path string, content string")
    facts = vuln.python_facts(files)
    got = sorted((r.line, r.cwe, r.severity) for r in vuln.findings(facts).collect())
    assert got == [(3, "CWE-89", "HIGH"), (7, "CWE-89", "HIGH"), (8, "CWE-78", "HIGH"), (10, "CWE-78", "CRITICAL"),
                   (11, "CWE-94", "CRITICAL"), (12, "CWE-502", "CRITICAL"), (14, "CWE-502", "HIGH"),
                   (15, "CWE-502", "HIGH"), (18, "CWE-798", "HIGH"), (19, "CWE-798", "HIGH")]
    errs = vuln.parse_errors(facts).collect()
    assert [e.path for e in errs] == ["bad.py"] and errs[0].error.startswith("SyntaxError")


def test_report_and_clean_repo(spark):
    files = spark.createDataFrame([("dirty", "a.py", "eval(x)\n"), ("clean", "b.py", "print(1)\n")],
                                  "repo string, path string, content string")
    found = vuln.findings(vuln.python_facts(files))
    rep = {r.repo: r for r in vuln.findings_report(found, files).collect()}
    assert rep["clean"].report == "Lead Auditor AST Scan: No vulnerabilities detected in code files."
    assert rep["dirty"].n_findings == 1 and "1. **[CRITICAL] Insecure Code Execution (eval/exec) (CWE-94)**" in rep["dirty"].report
    assert [r.repo for r in vuln.clean_repos(found, files).collect()] == ["clean"]


def test_ast_path_skip_substring_quirk(spark):
    files = spark.createDataFrame([("r", ".github/x.py", ""), ("r", "myvenv2/y.py", ""), ("r", "src/z.py", ""),
                                   ("r", "src/z.txt", "")], "repo string, path string, content string")
    assert [r.path for r in vuln.ast_path_skip(files).collect()] == ["src/z.py"]
    assert sorted(r.path for r in vuln.ast_path_skip(files, strict=True).collect()) == [".github/x.py", "myvenv2/y.py", "src/z.py"]


def test_prefilter_is_exact(spark):
    files = spark.createDataFrame([("r", "a.py", "print(1)\n"), ("r", "b.py", "ｅval(x)\n"),
                                   ("r", "c.py", "Eval = 1\nEVAL(x)\n"), ("r", "d.py", "os.system(x)\n")],
                                  "repo string, path string, content string")
    with_pf = sorted((r.path, r.cwe) for r in vuln.scan_findings(files, prefilter=True).collect())
    without = sorted((r.path, r.cwe) for r in vuln.scan_findings(files, prefilter=False).collect())
    assert with_pf == without == [("b.py", "CWE-94"), ("d.py", "CWE-78")]


def test_sql_functions(spark):
    from corpuslens.functions.sql import register_sql_functions
    register_sql_functions(spark)
    r = spark.sql("SELECT shannon_entropy('aabbc') AS e, count_ci('Query( query(', 'QUERY(') AS c, "
                  "normalize_eol('a' || chr(13) || chr(10) || 'b' || chr(13)) AS n").first()
    assert abs(r.e - 1.5219280948873621) < 1e-12 and r.c == 2 and r.n == "a\nb\n"


def test_ruled_facts_give_the_same_findings(spark):
    src = ("import os, yaml\nAPI_KEY = Other = 'abcdefghijkl'\nx = 'abcdefghijkl'\ndef f(y):\n    g(y); eval(y); os.system('%s' % y)\n"
           "    cursor.execute('select {}'.format(y)); cursor.execute('select %s' % y)\n    yaml.load(y); yaml.load(y, Loader=SafeLoader)\n"
           "    my_Password = 'longer than eight'\r\n    subprocess.run(y, shell=True)\n")
    files = spark.createDataFrame([("r", "a.py", src), ("r", "b.py", ""), ("r", "c.py", None), ("r", "d.py", "(")],
                                  "repo string, path string, content string")
    every, ruled = vuln.python_facts(files), vuln.python_facts(files, ruled_only=True)
    found = sorted(vuln.findings(every).collect())
    assert sorted(vuln.findings(ruled).collect()) == found
    assert {"CWE-94", "CWE-78", "CWE-89", "CWE-502", "CWE-798"} == {r.cwe for r in found}
    assert ruled.count() < every.count()
    assert vuln.parse_errors(ruled).count() == vuln.parse_errors(every).count() == 1


def test_parsing_keeps_no_names_of_the_files(spark):
    import sys

    import pyarrow as pa

    def grown(at):
        batch = pa.record_batch([["r"] * 5000, [f"{i}.py" for i in range(5000)], [f"def only_{at}_{i}(x):\n    eval(x)\n" for i in range(5000)]],
                                ["repo", "path", "content"])
        before = sys.getallocatedblocks()
        assert sum(b.num_rows for b in vuln._facts_arrow(None, None)(iter([batch]))) == 5000
        return sys.getallocatedblocks() - before
    assert [grown(0), grown(1)][1] < 2000  # the parser never frees a name: one block at least for each


def test_a_parse_that_ends_its_process_fails_the_task():
    import os

    import pytest
    assert vuln._in_child(lambda: iter([(1, "é"), (2, None)])) == [(1, "é"), (2, None)]
    with pytest.raises(RuntimeError, match="ended with 3"):
        vuln._in_child(lambda: os._exit(3))
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        vuln._in_child(lambda: [1 / 0])
