"""Column functions against plain-Python definitions."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.paths import path_name, path_suffix


def _one(spark, col, *vals, schema="s string"):
    df = spark.createDataFrame([tuple(v) if isinstance(v, tuple) else (v,) for v in vals], schema)
    return [r[0] for r in df.select(col).collect()]


def _entropy(s):
    if not s:
        return 0.0
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def test_split_lines_matches_splitlines(spark):
    cases = ["", "a", "a\n", "a\nb", "a\r\nb\r", "x\x0by\x0cz w\x85", "\n\n", "a\n\nb\n"]
    got = _one(spark, T.split_lines(F.col("s")), *cases)
    assert got == [c.splitlines() for c in cases]


def test_source_lines_universal_newlines(spark):
    cases = ["a\rb\r\nc\n", "a\x0bb", ""]
    got = _one(spark, T.source_lines(F.col("s")), *cases)
    assert got == [c.replace("\r\n", "\n").replace("\r", "\n").split("\n")[:-1] if c.endswith(("\n", "\r")) else
                   (c.replace("\r\n", "\n").replace("\r", "\n").split("\n") if c else []) for c in cases]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh0123456789+/=-_", min_size=0, max_size=40), min_size=1, max_size=8))
def test_entropy_random(spark, words):
    got = _one(spark, T.shannon_entropy(F.col("s")), *words)
    assert all(abs(g - _entropy(w)) < 1e-9 for g, w in zip(got, words))


def test_count_ci_non_overlapping(spark):
    got = _one(spark, T.count_ci(F.col("s"), "aa"), "aaaa", "AaA", "xaAx aa", "")
    assert got == ["aaaa".count("aa"), "aaa".count("aa"), "xaax aa".count("aa"), 0]


def test_line_of_first(spark):
    text = "one\ntwo KEY\r\nthree KEY\x0bKEY"
    df = spark.createDataFrame([(text, "KEY"), (text, "missing"), ("KEY", "KEY")], "t string, m string")
    got = [r[0] for r in df.select(T.line_of_first(F.col("t"), F.col("m"))).collect()]
    assert got == [2, None, 1]


def test_py_strip_unicode_whitespace(spark):
    cases = ["  a b \n", "　x ", "\x1cq\x1f", ""]
    assert _one(spark, T.py_strip(F.col("s")), *cases) == [c.strip() for c in cases]


def test_tagged_block_and_strip(spark):
    s = "pre <thought> think\n more </thought> mid <thought>2</thought> end"
    assert _one(spark, T.tagged_block(F.col("s"), "thought", "dflt"), s, "none") == ["think\n more", "dflt"]
    assert _one(spark, T.strip_tagged(F.col("s"), "thought"), s) == ["pre  mid  end"]


def test_literal_replace_first_keeps_specials(spark):
    df = spark.createDataFrame([("a$b a$b", "a$b", "\\1$0")], "t string, s string, r string")
    got = df.select(T.literal_replace_first(F.col("t"), F.col("s"), F.col("r"))).first()[0]
    assert got == "a$b a$b".replace("a$b", "\\1$0", 1)


def test_repo_name_and_remote(spark):
    urls = ["https://github.com/org/app.git", "git@host:org/x.git.git", "https://h/org/", "local/dir"]
    got = _one(spark, T.repo_name(F.col("s")), *urls)
    assert got == ["app", "x", "cloned_repo", "dir"]
    assert _one(spark, T.is_remote_target(F.col("s")), *urls) == [True, True, True, False]


def test_path_name_suffix(spark):
    import pathlib
    names = ["a/b.py", "a/.bashrc", "x.tar.gz", "noext", "a/b."]
    got = _one(spark, path_suffix(F.col("s")), *names)
    assert got == [pathlib.PurePosixPath(n).suffix if not n.endswith(".") else "" for n in names]
    assert _one(spark, path_name(F.col("s")), "a/b/c.txt") == ["c.txt"]
