"""Patch parsing and the ordered fold on hand cases."""

from corpuslens.operators import patching

FILE = "import os\r\ndef run(cmd):\r\n    os.system(cmd)\r\n    return 1\r\n"


def _apply(spark, text, files=(("r", "app.py", FILE),), default=None, strict=False):
    t = spark.createDataFrame([("r", 1, text)], "repo string, patch_id int, text string")
    f = spark.createDataFrame(list(files), "repo string, path string, content string")
    return {r.path: r for r in patching.apply_patches(f, patching.parse_patch(t), default, strict).collect()}


def chunk(s, r):
    return f"<<<<<<< SEARCH\n{s}\n=======\n{r}\n>>>>>>> REPLACE\n"


def test_exact_with_crlf_and_dollar(spark):
    out = _apply(spark, "FILE: app.py\n" + chunk("os.system(cmd)", "subprocess.run([cmd])  # $1 \\d"))["app.py"]
    assert out.status == "APPLIED" and out.chunks_applied == 1
    assert out.new_content == FILE.replace("\r\n", "\n").replace("os.system(cmd)", "subprocess.run([cmd])  # $1 \\d")


def test_fuzzy_eats_surrounding_whitespace(spark):
    # Indentation differs, so the exact match fails; the regex also swallows the
    # newline and indentation around the block (whitespace in the search means \s+).
    out = _apply(spark, "FILE: app.py\n" + chunk("os.system(cmd)\n        return 1", "X"))["app.py"]
    assert out.status == "APPLIED"
    assert out.new_content == "import os\ndef run(cmd):X"
    miss = _apply(spark, "FILE: app.py\n" + chunk("os.system( cmd )", "X"))["app.py"]
    assert miss.status == "SEARCH_NOT_FOUND"


def test_second_chunk_sees_first(spark):
    text = "FILE: app.py\n" + chunk("os.system(cmd)", "os.popen(cmd)") + chunk("os.popen(cmd)", "safe(cmd)")
    out = _apply(spark, text)["app.py"]
    assert out.chunks_applied == 2 and "safe(cmd)" in out.new_content


def test_not_found_and_missing_and_traversal(spark):
    out = _apply(spark, "FILE: app.py\n" + chunk("nothing here", "x") + "FILE: gone.py\n" + chunk("a", "b")
                 + "FILE: ../etc/passwd\n" + chunk("a", "b"))
    assert out["app.py"].status == "SEARCH_NOT_FOUND" and out["app.py"].new_content == FILE
    assert out["app.py"].error.startswith("Search block not found: nothing here")
    assert out["gone.py"].status == "FILE_NOT_FOUND"
    assert out["../etc/passwd"].status == "PATH_TRAVERSAL"


def test_no_header_uses_default_or_reports(spark):
    assert _apply(spark, chunk("return 1", "return 2"), default="app.py")["app.py"].status == "APPLIED"
    assert _apply(spark, chunk("return 1", "return 2"))[None].status == "NO_TARGET"


def test_parse_sections_and_empty_replacement_quirk(spark):
    t = spark.createDataFrame(
        [(1, "intro\nFILE: a.py\n" + chunk("x", "y") + "FILE: b.py\nno chunks\n"),
         (2, "FILE: c.py\n<<<<<<< SEARCH\nold\n=======\n>>>>>>> REPLACE\n" + chunk("p", "q"))],
        "patch_id int, text string")
    rows = patching.parse_patch(t).orderBy("patch_id", "file_ord", "chunk_ord").collect()
    assert [(r.patch_id, r.path, r.search) for r in rows] == [(1, "a.py", "x"), (2, "c.py", "old")]
    assert rows[1].parse_warning  # the empty replacement swallowed the next block


def test_strict_aborts_whole_patch(spark):
    out = _apply(spark, "FILE: app.py\n" + chunk("return 1", "return 2") + "FILE: b.py\n" + chunk("zz", "y"),
                 files=(("r", "app.py", FILE), ("r", "b.py", "a")), strict=True)
    assert out["app.py"].status == "ABORTED" and out["b.py"].status == "SEARCH_NOT_FOUND"
    assert out["app.py"].new_content == FILE and out["app.py"].chunks_applied == 0


def test_fuzzy_match_behind_supplementary_characters(spark):
    out = _apply(spark, "FILE: a.py\n" + chunk("foo(x)", "bar(x)"), files=(("r", "a.py", "# 😀😀😀 hi\nfoo( x )\nend\n"),))
    assert out["a.py"].status == "APPLIED" and out["a.py"].new_content.startswith("# 😀😀😀 hi")
    assert "bar(x)" in out["a.py"].new_content and out["a.py"].new_content.endswith("end\n")


def test_sections_of_one_file_build_on_one_another(spark):
    files = spark.createDataFrame([("r", "a.py", "x\ny\n")], "repo string, path string, content string")
    text = "FILE: a.py\n" + chunk("x", "X") + "FILE: gone.py\n" + chunk("a", "b") + "FILE: ./sub/../a.py\t\n" + chunk("y", "Y") + \
        "FILE: a.py\n" + chunk("zzz", "q")
    t = spark.createDataFrame([("r", 1, text), ("r", 2, "FILE: a.py\nno chunk"), ("r", 3, None)], "repo string, patch_id int, text string")
    out = patching.apply_patches(files, patching.parse_patch(t))
    got = {r.file_ord: r for r in out.collect()}
    assert [got[i].status for i in range(4)] == ["APPLIED", "FILE_NOT_FOUND", "APPLIED", "SEARCH_NOT_FOUND"]
    assert got[0].new_content == "X\ny\n" and got[2].new_content == got[3].new_content == "X\nY\n" and got[2].path == "a.py"
    assert [r.content for r in patching.patched_files(files, out).collect()] == ["X\nY\n"]
    assert sorted((r.patch_id, r.status) for r in patching.patches_without_chunks(t).collect()) == [(2, "NO_CHUNKS"), (3, "NO_CHUNKS")]


def test_restore_and_diff(spark):
    cur = spark.createDataFrame([("r", ".git/HEAD", "new"), ("r", "a.py", "changed"), ("r", "AGENTS.md", "keep")],
                                "repo string, path string, content string")
    snap = spark.createDataFrame([("r", "a.py", "orig"), ("r", "b.py", "b"), ("r", "AGENTS.md", "old")],
                                 "repo string, path string, content string")
    restored = {r.path: r.content for r in patching.restore_snapshot(cur, snap).collect()}
    assert restored == {".git/HEAD": "new", "AGENTS.md": "keep", "a.py": "orig", "b.py": "b"}
    diff = {r.path: r.change for r in patching.snapshot_diff(snap, cur).collect()}
    assert diff == {"a.py": "modified", "b.py": "removed", "AGENTS.md": "modified", ".git/HEAD": "added"}


def test_patches_of_one_file_build_on_one_another(spark):
    files = spark.createDataFrame([("r", "a.py", "x\ny\nfoo( z )\n")], "repo string, path string, content string")
    rows = [("r", 2, 0, "a.py", 0, "X", "XX"), ("r", 1, 0, "./a.py", 0, "x", "X"), ("r", 3, 0, "a.py", 0, "nope", "-"),
            ("r", 4, 0, "a.py", 0, "foo(z)", "bar")]
    df = spark.createDataFrame(rows, "repo string, patch_id int, file_ord int, path string, chunk_ord int, search string, replace string")
    out = {r.patch_id: r for r in patching.apply_patches(files, df).collect()}
    assert [out[i].status for i in (1, 2, 3)] == ["APPLIED", "APPLIED", "SEARCH_NOT_FOUND"]
    assert [out[i].match_kind for i in (1, 2, 3)] == ["EXACT", "EXACT", None]
    assert out[2].new_content == out[3].new_content == "XX\ny\nfoo( z )\n"
    new = patching.patched_files(files, patching.apply_patches(files, df)).first().content
    assert new == (out[4].new_content if out[4].status == "APPLIED" else "XX\ny\nfoo( z )\n")
    strict = {r.patch_id: r for r in patching.apply_patches(files, df, strict=True).collect()}
    assert strict[2].status == "SEARCH_NOT_FOUND" and strict[1].new_content.startswith("X\n")  # each patch alone
