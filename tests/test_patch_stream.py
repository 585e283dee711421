"""Sections streamed past a file against those folded in its row, and patches without chunks."""

import random

import pytest

from corpuslens.operators import patching

SHAPE = "repo string, patch_id long, file_ord int, path string, chunk_ord int, search string, replace string"
PIECES = ["a", "b(x)", "  ", "\n", "\r\n", "\u00a0", "\u3000", ".", "[1]", "_z9", "\t", "é", "$1", "\\"]


def wild(seed, n):
    rnd = random.Random(seed)
    said = lambda k: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, k)))
    files = [(f"r{i % 2}", f"f{i}.py", said(60)) for i in range(6)] + [("r0", "none.py", None)]
    patches = [(f"r{rnd.randrange(2)}", p, o, rnd.choice(["f0.py", "./f1.py", "f2.py", "x/../f3.py", "f4.py", "gone.py", "../f1.py", "", "none.py"]), c, said(3), said(4))
               for p in range(n) for o in range(rnd.randint(1, 2)) for c in range(rnd.randint(1, 3))]
    return files, patches


@pytest.mark.parametrize("strict", [False, True])
def test_streamed_sections_equal_the_fold(spark, strict):
    for seed in range(2):
        files, patches = wild(seed, 60)
        f, p = spark.createDataFrame(files, "repo string, path string, content string"), spark.createDataFrame(patches, SHAPE)
        rows = [sorted(map(repr, patching.apply_patches(f, p, strict=strict, hot_files=hot).collect())) for hot in (False, True)]
        assert rows[0] == rows[1]
        assert {"APPLIED", "SEARCH_NOT_FOUND", "FILE_NOT_FOUND", "PATH_TRAVERSAL", "NO_TARGET"} & {r.status for r in patching.apply_patches(f, p, strict=strict).collect()}


def test_twenty_thousand_sections_on_one_file(spark):
    n = 20_000
    patches = spark.range(n).selectExpr("'r' AS repo", "id AS patch_id", "0 AS file_ord", "'f.py' AS path", "0 AS chunk_ord",
                                        "concat('at ', id, ';') AS search", "concat('at ', id + 1, ';') AS replace")
    files = spark.createDataFrame([("r", "f.py", "x\nat 0;\ny\n" + "filler\n" * 200)], "repo string, path string, content string")
    out = patching.apply_patches(files, patches, hot_files=True)
    assert out.where("status = 'APPLIED' AND new_content LIKE concat('%at ', patch_id + 1, ';%')").count() == n


def test_patches_without_chunks_have_a_status(spark):
    texts = spark.createDataFrame([("r", 1, "FILE: f.py\nno chunk"), ("r", 2, ""), ("r", 3, None),
                                   ("r", 4, "FILE: f.py\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\n")], "repo string, patch_id long, text string")
    files = spark.createDataFrame([("r", "f.py", "a")], "repo string, path string, content string")
    for hot in (False, True):
        out = patching.apply_patches(files, patching.parse_patch(texts, keep_empty=True), hot_files=hot).collect()
        assert {(r.patch_id, r.status, r.file_ord, r.new_content) for r in out} == {
            (1, "NO_CHUNKS", -1, None), (2, "NO_CHUNKS", -1, None), (3, "NO_CHUNKS", -1, None), (4, "APPLIED", 0, "b")}
