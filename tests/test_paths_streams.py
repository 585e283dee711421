"""Path filters, ignore rules, tree roll-up, line slicing; batch-vs-stream equality; catalogue smoke."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import guardrails, paths

SMOKE = "/root/testdata/sf0.001"


def _files(spark, paths_, content="x"):
    return spark.createDataFrame([("r", p, content) for p in paths_], "repo string, path string, content string")


def test_prune_ext_boilerplate(spark):
    f = _files(spark, ["src/app.py", "node_modules/a.js", "src/.hidden/b.py", "Tests/c.py", "src/test_x.py",
                       "src/latest.py", "docs.py", "src/App.PY"])
    kept = {r.path for r in paths.skip_boilerplate(paths.filter_ext(paths.prune_dirs(f))).collect()}
    assert kept == {"src/app.py", "docs.py"}


def test_ignore_rules_ancestors(spark):
    f = _files(spark, ["src/gen/a.py", "src/gen", "build/x/y.js", "a/build.txt", "keep/me.py", "x.pyc",
                       "deep/hooks/z.py", "notes.log"])
    pats = paths.gitignore_patterns(["build/", "*.log", "src/gen", "# comment", "!keep"])
    kept = {r.path for r in paths.apply_ignore_rules(f, pats).collect()}
    assert kept == {"a/build.txt", "keep/me.py"}
    per_repo = spark.createDataFrame([("r", "keep/")], "repo string, pattern string")
    kept2 = {r.path for r in paths.apply_ignore_rules(f, pats, per_repo).collect()}
    assert kept2 == {"a/build.txt"}


def test_dir_rollup_drops_empty_dirs(spark):
    f = spark.createDataFrame([("r", "a/b/c.py", "123"), ("r", "a/d.txt", "1"), ("r", "e/f.md", "zz")],
                              "repo string, path string, content string")
    got = {(r.dir, r.n_files, r.n_bytes) for r in paths.dir_rollup(f).collect()}
    assert got == {("", 2, 4), ("a", 2, 4), ("a/b", 1, 3)}


def test_slice_lines_requests(spark):
    f = spark.createDataFrame([("r", "d/f.txt", "l1\nl2\nl3\nl4\nl5\nl6"), ("r", "empty.txt", "")],
                              "repo string, path string, content string")
    req = spark.createDataFrame([(1, "r", "d/f.txt", None, None), (2, "r", "d/f.txt", 0, 5), (3, "r", "d/f.txt", 3, 999),
                                 (4, "r", "d/f.txt", 5, 3), (5, "r", "empty.txt", None, None), (6, "r", "nope", 1, 2)],
                                "request_id int, repo string, path string, start_line int, end_line int")
    got = {r.request_id: r for r in paths.slice_lines(f, req).collect()}
    assert got[1].text == "=== File: f.txt (Lines 1 to 6 of 6) ===\nl1\nl2\nl3\nl4\nl5\nl6"
    assert (got[2].start_line, got[2].end_line) == (1, 5)
    assert got[3].text.endswith("l3\nl4\nl5\nl6") and got[3].end_line == 6
    assert got[4].status == "RANGE_ERROR" and got[4].text.startswith("Error: start_line (5) cannot exceed end_line (3)")
    assert got[5].status == "RANGE_ERROR" and got[6].status == "NOT_FOUND"


def test_guardrail_stream_equals_batch(spark):
    from corpuslens.streaming import jobs
    e = jobs.table_stream(spark, SMOKE, "events")
    cmds = e.select("event_id", F.concat(F.lit("rm -rf /x"), F.col("event_type")).alias("cmd"))
    streamed = jobs.run_to_table(jobs.stream_guardrail(cmds), "test_guardrail")
    batch = guardrails.audit_commands(spark.read.parquet(f"{SMOKE}/events.parquet")
                                      .select("event_id", F.concat(F.lit("rm -rf /x"), F.col("event_type")).alias("cmd"))
                                      ).where("blocked")
    assert sorted(streamed.select("event_id", "rule_id").collect()) == sorted(batch.select("event_id", "rule_id").collect())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["repo", "rank", "path", "score", "keyword_score", "secret_count"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["risk_rank_top", "pack_context", "ast_findings", "patch_status", "run_transitions",
                                  "ignore_rules", "cost_by_model", "stream_run_state"])
def test_catalogue_matches_oracle_small(spark, name):
    from corpuslens.plans.verify import compare
    res = compare(spark, SMOKE, [name], verbose=False)
    assert res[name][0] == "MATCH", res[name]


def test_prune_dirs_matches_segment_definition(spark):
    import random

    from corpuslens import rules
    rnd = random.Random(2)
    vocab = ["src", "Tests", "BUILD", ".git", "a.b", "..", "docs2", "mocks", "lib", "x-y", "node_modules", "Bin"]
    paths_ = ["/".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 5))) + "/f.py" for _ in range(300)]
    paths_ += ["tests", "build.py", ".hidden.py"]
    got = {r.path for r in paths.prune_dirs(_files(spark, sorted(set(paths_)))).collect()}
    exp = {p for p in set(paths_) if not any(d.lower() in rules.IGNORED_DIRS or d.startswith(".")
                                             for d in p.split("/")[:-1])}
    assert got == exp


def test_run_state_across_triggers(spark, tmp_path):
    """Events arrive in several files, one per trigger; the carried state equals the batch outcome."""
    from corpuslens.operators import runs
    from corpuslens.streaming import jobs
    ev = (spark.read.parquet(f"{SMOKE}/events.parquet")
          .select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                  F.expr("CASE event_type WHEN 'view' THEN 'AUDIT' WHEN 'click' THEN 'PATCH' WHEN 'signup' THEN 'TEST' "
                         "WHEN 'purchase' THEN 'COMMIT' ELSE 'ERROR' END").alias("state")))
    src = str(tmp_path / "events")
    # Time-ordered files: each trigger brings later events of the same runs.
    ev.withColumn("part", F.ntile(4).over(Window.orderBy("ts", "event_id"))) \
      .write.partitionBy("part").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src + "/part=*")
    got = {r.run_id: (r.final_state, r.attempts, r.n_events)
           for r in jobs.latest_run_state(jobs.run_to_table(jobs.stream_run_state(stream), "test_runs")).collect()}
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    batch = runs.run_outcome(ev.withColumn("seq", F.row_number().over(w)))
    exp = {r.run_id: (r.final_state, r.attempts, r.n_events) for r in batch.collect()}
    assert got == exp


def test_state_table_tracker_across_triggers(spark, tmp_path):
    from corpuslens.operators import runs
    from corpuslens.streaming import jobs
    ev = (spark.read.parquet(f"{SMOKE}/events.parquet")
          .select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                  F.expr("CASE event_type WHEN 'view' THEN 'AUDIT' WHEN 'click' THEN 'PATCH' WHEN 'signup' THEN 'TEST' "
                         "WHEN 'purchase' THEN 'COMMIT' ELSE 'ERROR' END").alias("state")))
    src = str(tmp_path / "events")
    parts = ev.withColumn("part", F.ntile(5).over(Window.orderBy("ts", "event_id"))).cache()
    root = str(tmp_path / "state")
    for some in ("part < 5", "part = 5"):  # the second start goes on behind the first
        parts.where(some).write.mode("append").partitionBy("part").parquet(src)
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src + "/part=*")
        jobs.stream_run_state_tables(stream, root).awaitTermination()
    got = {r.run_id: (r.final_state, r.attempts, r.illegal_transitions, r.n_events)
           for r in jobs.latest_state_table(spark, root).collect()}
    seq = ev.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")))
    tr = runs.run_transitions(seq, runs.transitions_df(spark), skew_safe=False)
    illegal = {r.run_id: r.n for r in tr.groupBy("run_id").agg(F.count_if(~F.col("legal")).alias("n")).collect()}
    exp = {r.run_id: (r.final_state, r.attempts, illegal[r.run_id], r.n_events) for r in runs.run_outcome(seq).collect()}
    assert got == exp
    assert len(spark.read.parquet(root).select("epoch").distinct().collect()) > 1  # several triggers happened


def test_glob_classes(spark):
    import fnmatch
    names = ["a1.log", "b1.log", "ab.log", "x/y.log", "a-.txt", "[a].txt", ".x", "*x", "foo[bar", "a&&b", "^a", "5.py", "-",
             "a\\b", "é.log", "z", "a\nb"]
    globs = ["[ab]1.log", "[!a]1.log", "*.log", "a?.log", "a-.txt", "[[]a].txt", "[*]x", "foo[bar", "a[&]&b", "[&&a]*", "[^a]a",
             "[9-1].py", "[!9-1].py", "[0-9].py", "[a-]", "[]a]", "[!]a]", "a[\\]b", "[\\w]", "?.log", "a?b", "", "(z", "z|-"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for glob in globs:
        rx = F.concat(F.lit("(?s)^(?:"), paths.glob_regex_col(F.lit(glob)), F.lit(r")\z"))
        got = [r.name for r in df.where(F.regexp_like("name", rx)).collect()]
        assert sorted(got) == sorted(n for n in names if fnmatch.fnmatchcase(n, glob)), glob


def test_repo_rules_of_any_shape(spark):
    files = spark.createDataFrame([("r", ".x", "1"), ("r", "foo[bar", "1"), ("r", "*x", "1"), ("s", "*x", "1"), (None, "*x", "1")],
                                  "repo string, path string, content string")
    own = spark.createDataFrame([("r", "foo[bar"), ("r", "[*]x"), ("r", None), ("t", "*")], "repo string, pattern string")
    kept = {(r.repo, r.path) for r in paths.apply_ignore_rules(files, [], own).collect()}
    assert kept == {("r", ".x"), ("s", "*x"), (None, "*x")}


def test_run_trackers_allow_repeated_completion(spark, tmp_path):
    from corpuslens.streaming import jobs
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:01", "AUDIT"), (1, 2, "2024-01-01 00:00:02", "COMPLETED"),
                                (1, 3, "2024-01-01 00:00:03", "COMPLETED"), (2, 4, "2024-01-01 00:00:04", "COMPLETED"),
                                (2, 5, "2024-01-01 00:00:05", "AUDIT")], "run_id long, event_id long, ts string, state string")
    ev.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("run_id long, event_id long, ts timestamp, state string").parquet(str(tmp_path / "ev"))
    pandas_state = jobs.latest_run_state(jobs.run_to_table(jobs.stream_run_state(stream), "repeat"))
    assert {r.run_id: r.illegal_transitions for r in pandas_state.collect()} == {1: 0, 2: 1}
    jobs.stream_run_state_tables(stream, str(tmp_path / "state")).awaitTermination()
    tables = jobs.latest_state_table(spark, str(tmp_path / "state"))
    assert {r.run_id: r.illegal_transitions for r in tables.collect()} == {1: 0, 2: 1}


def test_a_table_that_is_a_folder_streams_whole(spark, tmp_path):
    from corpuslens.plans import catalog_stream as S
    from corpuslens.streaming import jobs
    rows = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(5) for t in range(3)], "conv_id long, turn int, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    got = S.q_stream_message_delta(spark, str(tmp_path / "folder")).collect()
    assert sorted((r.run_id, r.idx) for r in got) == [(c, t) for c in range(5) for t in range(3)]
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))  # and one that is a file, with others beside it
    part, = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "one" / "conversations.parquet")
    spark.range(3).write.parquet(str(tmp_path / "one" / "other.parquet"))
    assert jobs.run_to_table(jobs.table_stream(spark, str(tmp_path / "one"), "conversations"), "one_file").count() == 15
