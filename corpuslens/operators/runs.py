"""Review-run analytics: transitions, outcomes, attempts, dwell, test verdicts, messages.

Per-run sequences (predecessor, successor, running counts) use the
range-partitioned operators of `sequence` by default, so one very long run is
spread over many tasks; per-run summaries are partial aggregates
(max_by/count_if).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.operators import sequence


def transitions_df(spark: SparkSession) -> DataFrame:
    """(state, outcome, next_state, source): the rule file's edges and those coded in the run loop."""
    return (rules.transition_rows(spark, rules.RULE_TRANSITIONS, "rules")
            .unionByName(rules.transition_rows(spark, rules.CODED_TRANSITIONS, "code")))


def load_transitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A3: read a rules JSON file -> (edges, settings) with defaults for missing thresholds."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    schema = ("struct<states: array<string>, transitions: map<string, map<string, string>>, "
              "retry_thresholds: struct<max_patch_test_retries: int, sandbox_timeout_seconds: int>, "
              "enable_atomic_rollbacks: boolean>")
    p = raw.select(F.from_json("value", schema).alias("c"))
    edges = (p.select(F.explode("c.transitions").alias("state", "outs"))
             .select("state", F.explode("outs").alias("outcome", "next_state"))
             .withColumn("source", F.lit("rules"))
             .unionByName(rules.transition_rows(spark, rules.CODED_TRANSITIONS, "code")))
    settings = p.select(
        F.coalesce("c.retry_thresholds.max_patch_test_retries", F.lit(rules.DEFAULT_MAX_RETRIES)).alias("max_retries"),
        F.coalesce("c.retry_thresholds.sandbox_timeout_seconds", F.lit(rules.DEFAULT_SANDBOX_TIMEOUT)).alias("sandbox_timeout"),
        F.coalesce("c.enable_atomic_rollbacks", F.lit(True)).alias("atomic_rollbacks"))
    return edges, settings


def run_transitions(events: DataFrame, edges: DataFrame, skew_safe: bool = True) -> DataFrame:
    """(run_id, seq, prev_state, state, legal).  The first event of a run has no predecessor.

    The predecessor comes from `sequence.neighbors`, which spreads one huge run over many tasks.  A run may say
    COMPLETED more than once: a repeat is legal.
    """
    legal = edges.select(F.col("state").alias("prev_state"), F.col("next_state").alias("state")).distinct()
    seqd = sequence.neighbors(events, "run_id", ["seq"], ["state"], skew_safe=skew_safe).drop("next_state")
    j = seqd.join(legal.withColumn("_ok", F.lit(True)), ["prev_state", "state"], "left")
    return j.select("run_id", "seq", "prev_state", "state",
                    F.when(F.col("prev_state").isNull(), F.lit(True))
                     .when((F.col("state") == "COMPLETED") & (F.col("prev_state") == "COMPLETED"), F.lit(True))
                     .otherwise(F.coalesce(F.col("_ok"), F.lit(False))).alias("legal"))


def run_outcome(events: DataFrame, terminal_ok=("COMPLETED",), terminal_err=("ERROR",)) -> DataFrame:
    """Per run last state, outcome, attempts (PATCH entries), events (partial aggregation, skew-safe)."""
    last = F.max_by("state", "seq")
    return (events.groupBy("run_id")
            .agg(last.alias("final_state"),
                 F.count_if(F.col("state") == "PATCH").cast("long").alias("attempts"),
                 F.count(F.lit(1)).alias("n_events"))
            .withColumn("outcome", F.when(F.col("final_state").isin(*terminal_ok), F.lit("SUCCESS"))
                        .when(F.col("final_state").isin(*terminal_err), F.lit("ERROR"))
                        .otherwise(F.lit("RUNNING"))))


def run_modified(outcome: DataFrame, applied: DataFrame, run_col: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """What runs modified: `outcome` with n_modified, and the rows (run_id, path).

    applied: patch results (run, path, status).  A run that ended in SUCCESS
    modified each path of an applied section once; any other was rolled back
    and modified nothing.  The paths stay rows, so that a run with a third of
    all files is never one row.  Null runs are one run; a null path is no file.
    """
    paths = (applied.where((F.col("status") == "APPLIED") & F.col("path").isNotNull())
             .select(F.col(run_col).alias("_run"), "path").distinct())
    done = outcome.where("outcome = 'SUCCESS'").select("run_id")
    rows = done.join(paths, F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", "path")
    counts = rows.groupBy(F.col("run_id").alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    told = (outcome.join(counts, F.col("run_id").eqNullSafe(F.col("_run")), "left")
            .withColumn("n_modified", F.coalesce("_n", F.lit(0)).cast("long")).drop("_run", "_n"))
    return told, rows


def run_attempts(events: DataFrame, skew_safe: bool = True) -> DataFrame:
    """Attempt number at every event = PATCH entries so far in the run."""
    flagged = events.select("run_id", "seq", "state", (F.col("state") == "PATCH").alias("_is_patch"))
    return sequence.running_count(flagged, "run_id", ["seq"], "_is_patch", "attempt",
                                  skew_safe=skew_safe).drop("_is_patch")


def dwell_time(events: DataFrame, skew_safe: bool = True) -> DataFrame:
    """Seconds until the run's next event (null for the last one)."""
    events = sequence.neighbors(events.select("run_id", "seq", "state", "ts"), "run_id", ["seq"], ["ts"],
                                skew_safe=skew_safe)
    nxt = F.col("next_ts")
    secs = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("run_id", "seq", "state", (secs / 1e6).alias("dwell_s"))


def classify_failure(stdout, stderr):
    """any compilation word in lower(stdout + newline + stderr) -> compilation class."""
    low = F.lower(F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit(""))))
    hit = F.lit(False)
    for w in rules.COMPILATION_WORDS:
        hit = hit | low.contains(w)
    return F.when(hit, F.lit(rules.FAILURE_COMPILATION)).otherwise(F.lit(rules.FAILURE_LOGIC))


def test_verdicts(results: DataFrame) -> DataFrame:
    """G13 rows: verdict by exit code only (a failing run still has status COMPLETED)."""
    verdict = (F.when(F.col("status") == "TIMEOUT", F.lit("TIMEOUT"))
               .when(F.col("exit_code") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))
    return results.withColumn("verdict", verdict).withColumn(
        "failure_class", F.when(F.col("exit_code") != 0, classify_failure(F.col("stdout"), F.col("stderr"))))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))


def message_matrix(messages: DataFrame) -> DataFrame:
    """(sender, recipient, n) edge counts."""
    return messages.groupBy("sender", "recipient").agg(F.count(F.lit(1)).alias("n"))


def message_delta(snapshots: DataFrame) -> DataFrame:
    """Items of cumulative message lists, each emitted once at the first event that carried it.

    snapshots: (run_id, event_seq, idx, sender, recipient, message), one row per
    list item per event.  Grouping by (run_id, idx) is a partial aggregate.
    """
    return (snapshots.groupBy("run_id", "idx")
            .agg(F.min_by(F.struct("event_seq", "sender", "recipient", "message"), "event_seq").alias("m"))
            .select("run_id", "idx", "m.event_seq", "m.sender", "m.recipient", "m.message"))
