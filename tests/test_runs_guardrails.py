"""Telemetry golden values, guardrail self-check, run analytics, manifests."""

import json

from pyspark.sql import functions as F

from corpuslens.operators import guardrails, manifests, runs, telemetry


def test_metrics_golden(spark):
    calls = spark.createDataFrame([("qwen-max", 1200, 450, 1.45), ("qwen-max", 3500, 1200, 3.12)],
                                  "model string, input_tokens long, output_tokens long, latency_s double")
    s = telemetry.metrics_summary(telemetry.call_cost(calls)).first()
    assert (s.total_calls, s.total_input_tokens, s.total_output_tokens) == (2, 4700, 1650)
    assert abs(s.average_latency_seconds - 2.285) < 1e-9 and abs(s.total_estimated_cost_usd - 0.127) < 1e-12


def test_unknown_model_and_case(spark):
    calls = spark.createDataFrame([("QWEN-Turbo", 1_000_000, 1_000_000, 1.0), ("other", 5, 5, 1.0)],
                                  "model string, input_tokens long, output_tokens long, latency_s double")
    costs = [r.cost_usd for r in telemetry.call_cost(calls).orderBy("model").collect()]
    assert costs == [4.0, 0.0]
    empty = telemetry.metrics_summary(telemetry.call_cost(calls.where("false"))).first()
    assert empty.total_calls == 0 and empty.average_latency_seconds == 0.0


def test_guardrail_self_check(spark):
    cmds = spark.createDataFrame([("git status",), ("rm -rf / --no-preserve-root",), ("RM -RF /tmp",)], "cmd string")
    got = [(r.cmd, r.rule_id, r.blocked) for r in guardrails.audit_commands(cmds).collect()]
    assert got == [("git status", None, False), ("rm -rf / --no-preserve-root", 1, True), ("RM -RF /tmp", 1, True)]
    p = spark.createDataFrame([("shell", "rm\t-rf /")], "tool string, cmd string").select(F.struct("tool", "cmd").alias("payload"))
    assert guardrails.audit_payloads(p).first().blocked is False  # the tab is escaped in JSON text


def test_transitions_and_outcome(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"transitions": {"AUDIT": {"on_success": "PATCH"}}}))
    edges, settings = runs.load_transitions(spark, str(path))
    st = settings.first()
    assert (st.max_retries, st.sandbox_timeout, st.atomic_rollbacks) == (3, 30, True)
    assert {(r.state, r.next_state) for r in edges.collect()} >= {("AUDIT", "PATCH"), ("PATCH", "PATCH")}
    ev = spark.createDataFrame([(1, 1, "AUDIT"), (1, 2, "PATCH"), (1, 3, "COMMIT"), (1, 4, "PATCH"),
                                (2, 1, "AUDIT"), (2, 2, "COMPLETED")], "run_id int, seq long, state string")
    legal = {(r.run_id, r.seq): r.legal for r in runs.run_transitions(ev, runs.transitions_df(spark)).collect()}
    assert legal[(1, 3)] is False and legal[(1, 2)] is True and legal[(2, 2)] is True
    out = {r.run_id: r for r in runs.run_outcome(ev).collect()}
    assert out[1].attempts == 2 and out[1].outcome == "RUNNING" and out[2].outcome == "SUCCESS"


def test_verdicts(spark):
    res = spark.createDataFrame([(0, "3 passed", "", "COMPLETED"), (1, "1 failed", "Traceback ...", "COMPLETED"),
                                 (5, "", "assert", "COMPLETED"), (-1, "", "TimeoutExpired", "TIMEOUT")],
                                "exit_code int, stdout string, stderr string, status string")
    got = [(r.verdict, r.failure_class) for r in runs.test_verdicts(res).collect()]
    assert got == [("PASS", None), ("FAIL", "Compilation/Syntax Error"), ("FAIL", "Test Logic Failure"),
                   ("TIMEOUT", "Test Logic Failure")]


def test_manifest_parse(spark):
    text = "a>=1,<2\nx[y]==1.0\nz!=3\np===1\nzope.interface==5\n-r f\n# c\nbare\n\n"
    files = spark.createDataFrame([("r", "requirements.txt", text), ("r", "sub/requirements.txt", "q==1")],
                                  "repo string, path string, content string")
    rows = manifests.parse_manifest(manifests.manifest_lines(files)).orderBy("line_no").collect()
    # '!=', '===' and dotted names stay unparsed; '-', '#' and blank lines are skipped; sub-folder manifests ignored.
    assert [(r.package, r.op, r.version, r.parsed) for r in rows] == [
        ("a", ">=", "1", True), ("x[y]", "==", "1.0", True)] + [(None, None, None, False)] * 4
    assert [r.raw for r in rows][2:] == ["z!=3", "p===1", "zope.interface==5", "bare"]


def test_sequence_ops_hot_key_equal_windows(spark):
    """One run holding most rows spans many range partitions; results equal plain per-key windows."""
    import random

    from pyspark.sql import Window

    from corpuslens.operators import sequence
    rnd = random.Random(11)
    rows = [(0, i, rnd.random() < 0.3) for i in rnd.sample(range(5000), 3000)]
    rows += [(k, i, rnd.random() < 0.5) for k in range(1, 40) for i in range(rnd.randint(1, 12))]
    rows += [(None, i, rnd.random() < 0.5) for i in range(900)]  # null keys are a key of their own, over many partitions
    df = spark.createDataFrame(rows, "k int, o int, f boolean")
    w = Window.partitionBy("k").orderBy("o")
    exp = {(r.k, r.o): (r.p, r.n, r.c) for r in df.select(
        "k", "o", F.lag("o").over(w).alias("p"), F.lead("o").over(w).alias("n"),
        F.sum(F.when(F.col("f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c")).collect()}
    nb = {(r.k, r.o): (r.prev_o, r.next_o)
          for r in sequence.neighbors(df, "k", ["o"], ["o"], partitions=16, skew_safe=True).collect()}
    rc = {(r.k, r.o): r.c for r in sequence.running_count(df, "k", ["o"], "f", "c", partitions=16, skew_safe=True).collect()}
    assert nb == {key: v[:2] for key, v in exp.items()}
    assert rc == {key: v[2] for key, v in exp.items()}


def test_guardrail_unicode_whitespace(spark):
    cmds = spark.createDataFrame([("rm -rf /",), ("shred　x",)], "cmd string")
    assert [r.rule_id for r in guardrails.audit_commands(cmds).collect()] == [1, 8]


def test_null_token_counts_cost_nothing(spark):
    from corpuslens.operators import telemetry
    calls = spark.createDataFrame([("qwen-max", None, 1_000_000), ("QWEN-MAX", 1_000_000, None), ("no such model", 5, 5)],
                                  "model string, input_tokens long, output_tokens long")
    costs = [r.cost_usd for r in telemetry.call_cost(calls).collect()]
    prices = {m: (i, o) for m, i, o in ((r.model, r.in_usd, r.out_usd) for r in telemetry.rules.pricing_df(spark).collect())}
    assert sorted(costs) == sorted([prices["qwen-max"][1], prices["qwen-max"][0], 0.0])
