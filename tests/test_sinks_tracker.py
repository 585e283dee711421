"""Complete listing, sinks, exact neighbours and the stateful run tracker."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import sequence
from corpuslens.sources import corpus, sinks, tree
from corpuslens.streaming import jobs, tracker

NAMES = ["pkg/__init__.py", "pkg/_internal/a.py", "src/_util.py", "src/b.py", "s p/c d.py", ".env.py", ".hid/a.py", "_x/a.py", "é%20/ü.py",
         "a=1/b.py", "deep/1/2/3/4/x.py", "empty.py", "big.py", "notes.md", "_SUCCESS", "node_modules/m.py"]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "tree"
    for n in NAMES:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("" if n == "empty.py" else "x" * 5000 if n == "big.py" else f"# {n}\r\n")
    (root / "nothing").mkdir()
    (root / "loop").symlink_to(root)
    return root


def walked(root, skip=()):
    out = {}
    for at, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip]
        out |= {os.path.relpath(os.path.join(at, f), root): os.path.getsize(os.path.join(at, f)) for f in files}
    return out


def test_a_scan_sees_what_a_walk_sees(spark, folder):
    got = corpus.scan_corpus(spark, str(folder), with_content=False).collect()
    assert {r.path: r.size_bytes for r in got} == walked(folder) and len(got) == len(NAMES)
    got = corpus.scan_corpus(spark, f"file:{folder}/", exts=[".py"], max_bytes=1000, skip_dirs=["node_modules", ".hid"]).collect()
    want = {p for p, n in walked(folder, ("node_modules", ".hid")).items() if p.endswith(".py") and n <= 1000}
    assert {r.path for r in got} == want
    assert all(r.content == ("" if r.path == "empty.py" else f"# {r.path}\n") for r in got)


def test_only_passing_files_are_opened(spark, folder):
    os.chmod(folder / "big.py", 0)
    (folder / "gone.txt").symlink_to(folder / "nowhere")
    got = corpus.scan_corpus(spark, str(folder), exts=[".py"], max_bytes=1000)
    assert got.where("path = 'src/b.py'").first().content == "# src/b.py\n"
    os.chmod(folder / "big.py", 0o644)


def test_a_file_a_glob_and_nothing(spark, folder):
    one = corpus.scan_corpus(spark, str(folder / "pkg" / "__init__.py")).first()
    assert (one.path, one.content) == ("__init__.py", "# pkg/__init__.py\n")
    several = corpus.scan_corpus(spark, str(folder / "{pkg,src}"), with_content=False).collect()
    assert {r.path for r in several} == {str(folder / n) for n in NAMES if n.startswith(("pkg/", "src/"))}
    assert corpus.scan_corpus(spark, str(folder / "nothing")).count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.scan_corpus(spark, str(folder / "not there"))


def test_written_files_stay_below_their_root(spark, tmp_path):
    rows = spark.createDataFrame([("a/_b.py", "x"), (None, "y"), ("c.py", None)], "path string, content string")
    assert tree.write_files(rows, str(tmp_path / "out")) == 1
    assert (tmp_path / "out" / "a" / "_b.py").read_text() == "x"
    with pytest.raises(ValueError, match="leaves"):
        tree.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "out"))


def finding(repo, path, line=1):
    return (repo, path, 0, line, "CWE-94", "v", "HIGH", f"code {line}", "d")


def test_findings_follow_the_last_scan(spark, tmp_path):
    path = str(tmp_path / "table")

    def scan(version, files, found):
        return sinks.upsert_findings(spark.createDataFrame(found, sinks.FINDINGS_SCHEMA), spark.createDataFrame(files, "repo string, path string"), path, version, 4)

    def held():
        return sorted((r.repo or "", r.path, r.line) for r in sinks.read_findings(spark, path).collect())

    assert held() == []
    files = [(f"r{i % 5}", f"f{i}.py") for i in range(20)] + [(None, "n.py")]
    assert scan(0, files, [finding(*f) for f in files])
    assert len(held()) == 21
    changed = [("r0", "f0.py"), ("r1", "f1.py"), ("r9", "new.py"), (None, "n.py")]
    assert scan(3, changed, [finding("r1", "f1.py", 7), finding("r9", "new.py", 2)])
    want = sorted([(r, p, 1) for r, p in files if (r, p) not in changed] + [("r1", "f1.py", 7), ("r9", "new.py", 2)])
    assert held() == want
    before = sorted(os.walk(path))
    assert not scan(3, changed, []) and sorted(os.walk(path)) == before  # a repeated version changes nothing
    with pytest.raises(ValueError, match="comes after"):
        scan(2, changed, [])
    # A version that broke off before its commit is invisible, and written anew.
    (spark.createDataFrame([(*finding("r2", "f2.py", 99), 0)], sinks.FINDINGS_SCHEMA + ", bucket INT")
     .write.partitionBy("bucket").parquet(f"{path}/data/version=4"))
    assert held() == want
    assert scan(4, [("r2", "f2.py")], [])
    assert held() == [w for w in want if w[:2] != ("r2", "f2.py")]


def test_export_cuts_a_large_run_and_says_what_it_did(spark, tmp_path):
    rows = [("hot", f"p{i}.py", "APPLIED", "x" * 400) for i in range(200)] + [("cold", "a.py", "APPLIED", "é"), ("miss", "b.py", "SEARCH_NOT_FOUND", "z")]
    applied = spark.createDataFrame(rows, "run_id string, path string, status string, new_content string")
    asked = spark.createDataFrame([("hot",), ("cold",), ("miss",), ("never",), ("hot",)], "run_id string")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # parts of a few kilobytes would share one task
    got = sinks.write_remediated(applied, str(tmp_path / "out"), asked=asked, task_bytes=8000)
    spark.conf.set(setting, "true")
    assert {tuple(r) for r in got.collect()} == {("hot", "EXPORTED", 200, 80_000), ("cold", "EXPORTED", 1, 2), ("miss", "NOTHING_MODIFIED", 0, 0),
                                                 ("never", "UNKNOWN_RUN", 0, 0)}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 201 and len(list((tmp_path / "out" / "run_id=hot").glob("part-*"))) > 1


def test_report_parts_are_the_reports(spark, tmp_path):
    import hashlib
    lines = [(f"r{i}", k, f"line {k} of {i}\n") for i in range(7) for k in range(1 + 40 * (i == 3) + i)]
    random.Random(1).shuffle(lines)
    sinks.write_report(spark.createDataFrame(lines, "repo string, idx long, text string"), str(tmp_path / "r"), parts=5)
    got = sorted(sinks.read_report(spark, str(tmp_path / "r")).collect(), key=lambda r: (r.repo, r.idx))
    assert [(r.repo, r.idx, r.text) for r in got] == sorted(lines) and [r.part for r in got] == sorted(r.part for r in got)
    assert len({r.part for r in got if r.repo == "r3"}) > 1
    for r in sinks.report_digests(sinks.read_report(spark, str(tmp_path / "r"))).collect():
        text = "".join(t for n, _, t in sorted(lines) if n == r.repo)
        assert (r.n_findings, r.report_chars, r.report_md5) == (sum(n == r.repo for n, *_ in lines) - 1, len(text), hashlib.md5(text.encode()).hexdigest())


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_neighbours_on_ties_equal_a_window(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice([None, 1, 2, 3]), rnd.choice("ABC"), i) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id int, seq int, state string, n int")
    cols = ["run_id", "seq", "state", "n", "prev_n", "next_n", "prev_state", "next_state"]
    got = sequence.neighbors(df, "run_id", ["seq"], ["n", "state"], partitions).select(cols).collect()
    plain = sequence.neighbors(df, "run_id", ["seq"], ["n", "state"], skew_safe=False).select(cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, plain)) and len(got) == 400
    df = df.withColumn("flag", F.col("n") % 3 == 0)
    counts = [sequence.running_count(df, "run_id", ["seq"], "flag", "c", partitions, safe).select("n", "c").collect() for safe in (True, False)]
    assert sorted(counts[0]) == sorted(counts[1])


def test_null_runs_merge_over_epochs(spark):
    from corpuslens.operators import runs
    rows = "run_id long, event_id long, ts timestamp, state string"
    def batch(*e):
        return spark.createDataFrame(e, rows.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    edges = runs.transitions_df(spark)
    first = jobs._merge_run_batch(batch((None, 1, 1, "AUDIT"), (5, 2, 1, "PATCH")), None, edges)
    both = {r.run_id: r for r in jobs._merge_run_batch(batch((None, 3, 2, "COMMIT"), (6, 4, 2, "AUDIT")), first, edges).collect()}
    assert set(both) == {None, 5, 6}
    assert (both[None].n_events, both[None].final_state, both[None].illegal_transitions) == (2, "COMMIT", 1) and both[5].n_events == 1


def plain_state(events):
    legal, out = tracker.legal_pairs(), {}
    for run in {e[0] for e in events}:
        mine = sorted((e[2], e[1], e[3]) for e in events if e[0] == run)
        states = [s for *_, s in mine]
        out[run] = (len(mine), states[-1], states.count("PATCH"), sum(p not in legal for p in zip(states, states[1:], strict=False)))
    return out


def test_tracker_waits_for_late_events_and_restarts(spark, tmp_path):
    rnd = random.Random(4)
    states = ["AUDIT", "PATCH", "TEST", "COMMIT", "COMPLETED", "ERROR"]
    events = [(rnd.choice([None, 1, 1, 1, 1, 2, 3]), i, 1000 + i + rnd.randint(-40, 40), rnd.choice(states)) for i in range(300)]
    shape = "run_id long, event_id long, ts timestamp, state string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def feed(rows):
        df = spark.createDataFrame(rows, shape.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        tracker.start_tracker(tracker.stream_run_tracker(source, delay="100 seconds"), str(tmp_path / "t")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "t" / "rows"))

    for part in (events[:90], events[90:180]):
        feed(part)
        run()
    feed(events[180:])
    rows = run()
    got = {r.run_id: (r.n_events, r.final_state, r.attempts, r.illegal_transitions) for r in jobs.latest_run_state(rows).collect()}
    assert got == plain_state(events)
    assert rows.count() > len(got)  # rows of several triggers


def test_tracker_gives_up_ended_runs(spark, tmp_path):
    shape = "run_id long, event_id long, ts timestamp, state string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate([[(1, 1, 10, "COMMIT"), (1, 2, 11, "COMPLETED"), (2, 3, 11, "AUDIT")], [(3, 4, 500, "AUDIT")], [(3, 5, 900, "PATCH")],
                              [(1, 6, 901, "AUDIT"), (2, 7, 901, "PATCH")]]):
        df = spark.createDataFrame(rows, shape.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tracker.stream_run_tracker(source, delay="5 seconds", linger="60 seconds")
        tracker.start_tracker(stream, str(tmp_path / "t")).awaitTermination()
    last = {(r.run_id, r.last_event_id): r.n_events for r in spark.read.parquet(str(tmp_path / "t" / "rows")).collect()}
    assert last[1, 6] == 1 and last[2, 7] == 2  # run 1 had ended and begins anew, run 2 had not


def test_tracker_query_takes_deliveries_of_several_files(spark, tmp_path):
    from corpuslens.plans import catalog_stream as S
    folder = tmp_path / "data" / "events.parquet"
    rnd = random.Random(8)
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(i, rnd.randint(1, 20), i * 300 + rnd.randint(0, 200), rnd.choice(kinds)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").withColumn("ts", F.timestamp_seconds("ts"))
    df.repartition(5).write.parquet(str(folder))
    got = S.q_stream_run_tracker(spark, str(tmp_path / "data")).collect()
    wanted = {u: sum(r[1] == u for r in rows) for u in {r[1] for r in rows}}
    assert {r.run_id: r.n_events for r in got} == wanted  # no event came too late


def test_listing_sees_what_is_in_a_folder_one_entry_at_a_time(spark, tmp_path):
    from corpuslens.sources import tree
    root = tmp_path / "tree"
    (root / "a" / ".b").mkdir(parents=True)
    for name, size in (("one.py", 3), ("a/two.py", 0), ("a/.b/_three", 5)):
        (root / name).write_bytes(b"x" * size)
    (root / "to_folder").symlink_to(root / "a")
    (root / "to_file").symlink_to(root / "one.py")
    (root / "to_nothing").symlink_to(root / "gone")
    got = {(r.path, r.size_bytes) for r in tree.list_tree(spark, str(root)).collect()}
    assert got == {("one.py", 3), ("to_file", 3), ("a/two.py", 0), ("a/.b/_three", 5)}
