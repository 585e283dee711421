"""Tree listings, the live keyed table, files that runs modified, and long import cascades."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import paths, runs, scoring
from corpuslens.sources import sinks
from corpuslens.streaming import jobs


def tree_of(names, sizes):
    """Entries of a tree in order, found by walking it: directories first, each by lower name."""
    out = []

    def walk(at):
        below = {}
        for n in names:
            if n[:len(at)] == at and len(n) > len(at):
                below.setdefault((len(n) == len(at) + 1, n[len(at)].lower(), n[len(at)]), []).append(n)
        for (is_file, _, name), held in sorted(below.items()):
            here = (*at, name)
            out.append(("/".join(here), len(here), not is_file, len(held), sum(sizes[h] for h in held)))
            if not is_file:
                walk(here)

    walk(())
    return out


def test_tree_listing_is_in_tree_order(spark):
    rng = random.Random(5)
    names = {tuple(rng.choice(["a", "B", "b", "_x", "Zed", "é"]) for _ in range(rng.randrange(4))) + (rng.choice(["A.py", "a.py", "b.py", "Z.js", "_.py"]),)
             for _ in range(120)}
    sizes = {n: rng.randrange(9) for n in names}
    rows = [(r, "/".join(n), "x" * sizes[n]) for r in ("one", "two", None) for n in names if r != "two" or n[0] != "a"]
    rows += [("one", "notes.bin", "xx"), ("three", ".py", "xx")]
    files = spark.createDataFrame(rows, "repo string, path string, content string").repartition(7)
    got = paths.tree_listing(files, [".py", ".js"]).collect()
    for repo in ("one", "two", None):
        mine = sorted((r for r in got if r.repo == repo), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        want = tree_of({n for n in names if repo != "two" or n[0] != "a"}, sizes)
        assert [(r.path, r.depth, r.is_dir, r.n_files, r.n_bytes) for r in mine] == want
    assert not [r for r in got if r.repo == "three"]
    assert paths.tree_listing(files.limit(0)).count() == 0
    twice = paths.tree_listing(files.unionByName(files), [".py", ".js"])
    assert twice.count() == len(got) and twice.agg(F.sum("n_files")).first()[0] == 2 * sum(r.n_files for r in got)


def test_live_table_equals_the_batch_summary_after_every_trigger(spark, tmp_path):
    rng = random.Random(3)
    calls = "ts timestamp, model string, input_tokens long, output_tokens long, latency_s double"
    keys = ["window_start", "window_end", "model"]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(calls).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def rounded(df):
        return sorted(((r.window_start, r.window_end, r.model or "", r.total_calls, r.total_input_tokens, r.total_output_tokens,
                        round(r.total_estimated_cost_usd, 9)) for r in df.collect()))

    for step in range(5):
        rows = [(step * 600 + rng.randrange(600), rng.choice(["qwen-max", "other", None]), rng.randrange(9), None if rng.random() < .1 else 2, 1.0) for _ in range(40)]
        some = spark.createDataFrame(rows, "s long, model string, input_tokens long, output_tokens long, latency_s double")
        some.select(F.timestamp_seconds("s").alias("ts"), *some.columns[1:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = jobs.run_to_keyed(jobs.stream_cost_window(source, "15 minutes", "30 minutes"), "live", keys, str(tmp_path / "live"), merge_every=2)
        assert rounded(live) == rounded(jobs.stream_cost_window(spark.read.schema(calls).parquet(str(tmp_path / "in")), "15 minutes"))


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k string, v int"
    schema = spark.createDataFrame([], shape).schema
    assert sinks.read_keyed(spark, path, schema, ["k"]).count() == 0
    want = {}
    for epoch, rows in enumerate([[("a", 1), (None, 2)], [("a", 3)], [], [("b", 4), (None, None)], [("a", 5)]]):
        changed = spark.createDataFrame(rows, shape)
        want.update(rows)
        for _ in range(2):
            sinks.write_keyed(changed, path, ["k"], epoch, merge_every=2)
            assert dict(map(tuple, sinks.read_keyed(spark, path, schema, ["k"]).collect())) == want


def test_modified_files_of_runs(spark):
    outcome = spark.createDataFrame([(1, "SUCCESS"), (2, "ERROR"), (None, "SUCCESS"), (4, "SUCCESS"), (5, "RUNNING")], "run_id long, outcome string")
    applied = spark.createDataFrame([(1, "a", "APPLIED"), (1, "a", "APPLIED"), (1, "b", "FILE_NOT_FOUND"), (2, "a", "APPLIED"), (None, "x", "APPLIED"),
                                     (None, "y", "APPLIED"), (4, None, "APPLIED"), (5, "a", "APPLIED"), (9, "z", "APPLIED")], "run_id long, path string, status string")
    told, rows = runs.run_modified(outcome, applied)
    assert {r.run_id: r.n_modified for r in told.collect()} == {1: 1, 2: 0, None: 2, 4: 0, 5: 0}
    assert {tuple(r) for r in rows.collect()} == {(1, "a"), (None, "x"), (None, "y")}


def test_long_cascades_with_merged_frontiers(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MERGE_ROUNDS", 2)
    n = 9
    scored = spark.createDataFrame([("r", f"f{i:03}", 1 if i in (0, 40) else 0) for i in range(50)], "repo string, path string, score long")
    links = [(i, i + 1) for i in range(n)] + [(3, 1), (5, 2), (40, 44), (44, 41), (20, 21), (44, 60)]
    edges = spark.createDataFrame([("r", f"f{a:03}", f"f{b:03}") for a, b in links], "repo string, src string, dst string")
    want, score = set(), {0, 40}
    for i in range(50):  # visited in path order
        if i in score:
            want.add(f"f{i:03}")
            score |= {b for a, b in links if a == i}
    got = [r.src for r in scoring.live_importers(scored, edges).collect()]
    assert set(got) == want and len(got) == len(want)
    assert scoring.live_importers(scored.limit(0), edges).count() == 0
