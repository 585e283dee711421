"""Scoring, snippet merge and packing against small Python loops."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import context as ctx
from corpuslens.operators import scoring


def _merge_loop(matched, total, window):
    if not matched:
        return []
    rs = sorted((max(0, l - 1 - window), min(total - 1, l - 1 + window)) for l in matched)
    out = [list(rs[0])]
    for s, e in rs[1:]:
        if s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s + 1, e + 1) for s, e in out]


def test_merge_ranges_random(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        n = rnd.randint(1, 80)
        lines = sorted(rnd.sample(range(1, n + 1), rnd.randint(0, min(n, 6))))
        rows.append((i, n, lines, rnd.randint(0, 4)))
    df = spark.createDataFrame(rows, "id int, n int, ml array<int>, w int")
    for w in (0, 1, 3):
        got = df.select("id", ctx.merge_ranges_col(F.col("ml"), F.col("n"), w).alias("r")).collect()
        for (i, n, ml, _), row in zip(rows, sorted(got)):
            assert [(r.s + 1, r.e + 1) for r in row.r] == _merge_loop(ml, n, w)


def test_keyword_and_secret_score(spark):
    key = "".join(chr(65 + (i * 7) % 26) + chr(97 + (i * 11) % 26) + str(i % 10) for i in range(10))
    content = f"x = db.query(q)\nTOKEN = '{key}'\npassword: test\n"
    files = spark.createDataFrame([("r", "a.py", content)], "repo string, path string, content string")
    s = scoring.score_files(files, threshold=3.0).first()
    kws = [k.lower() for k in scoring.rules.RISK_KEYWORDS]
    assert s.keyword_score == sum(content.lower().count(k) for k in kws)
    assert s.secret_count == 1 and s.score == s.keyword_score + 5
    assert s.matched_lines == [1, 2, 3]


def _pack_loop(items, max_chars, max_files, min_tail, reserve):
    out, cur, count = [], 0, 0
    for rank, (path, score, label, payload) in enumerate(items, 1):
        entry = f"\nFILE: {path} ({label}, Risk Score: {score})\n```\n{payload}\n```"
        if cur + len(entry) > max_chars:
            rem = max_chars - cur
            if rem > min_tail:
                t = f"\nFILE: {path} (TRUNCATED, Risk Score: {score})\n```\n{payload[:rem - reserve]}\n```"
                out.append((rank, path, "TRUNCATED", len(t)))
            break
        out.append((rank, path, label, len(entry)))
        cur += len(entry)
        count += 1
        if count >= max_files:
            break
    return out


def test_pack_context_random(spark):
    rnd = random.Random(3)
    rows = []
    for repo in range(12):
        for f in range(rnd.randint(1, 30)):
            rows.append((f"r{repo}", f"f{f:03d}.py", rnd.randint(0, 9), "FULL", "x" * rnd.randint(1, 3000)))
    df = spark.createDataFrame(rows, "repo string, path string, score long, label string, payload string")
    got = ctx.pack_context(df, max_chars=9000, max_files=7, min_tail=500, reserve=100).collect()
    for repo in {r[0] for r in rows}:
        items = sorted([(p, s, l, pl) for rp, p, s, l, pl in rows if rp == repo], key=lambda x: (-x[1], x[0]))
        exp = _pack_loop(items, 9000, 7, 500, 100)
        mine = sorted((r.rank, r.path, r.label, r.n_chars) for r in got if r.repo == repo)
        assert mine == exp


def test_resolve_imports_first_match(spark):
    files = spark.createDataFrame(
        [("r", "src/utils/helpers.js", "import x from './a'\nconst h = require 'utils/helpers'"),
         ("r", "lib/Utils/Helpers.ts", ""), ("r", "app.js", "import 'helpers'\nimport 'os/path'\nimport org.demo.Thing;"),
         ("r", "org/demo/Thing.java", "")],
        "repo string, path string, content string")
    imps = scoring.extract_imports(files)
    edges = {(r.src, r.dst) for r in scoring.resolve_imports(imps, files).collect()}
    assert ("app.js", "lib/Utils/Helpers.ts") in edges          # first in path order wins
    assert ("app.js", "org/demo/Thing.java") in edges            # dotted Java import
    assert not any(d.startswith("os") for _, d in edges)         # standard library prefix dropped


def _cascade_loop(scores, edges):
    """Visit candidates in path order, mutating scores as the reviewed application does."""
    score = dict(scores)
    for path in sorted(score):
        if score[path] > 0:
            for dst in sorted({d for s, d in edges if s == path}):
                if dst in score:
                    score[dst] += 2
    return score


def test_import_boost_cascade_random(spark):
    rnd = random.Random(5)
    names = [f"m{i:02d}.py" for i in range(25)]
    scores = {n: (rnd.randint(1, 5) if rnd.random() < 0.2 else 0) for n in names}
    edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(60)}
    sdf = spark.createDataFrame([("r", n, s) for n, s in scores.items()], "repo string, path string, score long")
    edf = spark.createDataFrame([("r", s, d) for s, d in edges], "repo string, src string, dst string")
    got = {r.path: r.score for r in scoring.import_boost(sdf, edf, cascade=True).collect()}
    assert got == _cascade_loop(scores, edges)
    one_hop = {r.path: r.score for r in scoring.import_boost(sdf, edf).collect()}
    exp_one = {n: s + 2 * len({a for a, b in edges if b == n and scores[a] > 0}) for n, s in scores.items()}
    assert one_hop == exp_one


def test_resolve_imports_brute_force(spark):
    rnd = random.Random(11)
    parts = ["src", "main", "util", "a", "ab", "Über", "x.js", "core.py", "s"]
    files = sorted({(f"r{rnd.randint(0, 2)}", "/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))) for _ in range(120)})
    imports = [(repo, path, "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))).lower()[rnd.randint(0, 2):])
               for repo, path in files for _ in range(3)]
    imports += [("r0", "x", "src/main" * 20), ("nowhere", "x", "src"), ("r1", "x", None)]
    got = {tuple(r) for r in scoring.resolve_imports(
        spark.createDataFrame(imports, "repo string, path string, match_clean string"),
        spark.createDataFrame(files, "repo string, path string")).collect()}
    exp = set()
    for repo, src, text in imports:
        hits = [p for r, p in files if r == repo and text is not None and text in p.lower()]
        if hits:
            exp.add((repo, src, min(hits)))
    assert got == exp
