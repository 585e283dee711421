"""Structured Streaming jobs: the batch operators applied to unbounded inputs.

Stateless jobs (guardrail, log parse, corpus scan) reuse the batch column
functions unchanged.  Stateful jobs use event-time watermarks (cost windows,
message de-duplication) or `applyInPandasWithState` (per-run state machine).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslens.operators import guardrails, telemetry, vuln
from corpuslens.session import shared_dir
from corpuslens.sources import sinks
from corpuslens.sources.logs import parse_log_lines
from corpuslens.streaming.tracker import legal_pairs


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of them, as a file stream (new files are picked up as they land)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    r = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/{name}.parquet") if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(df: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream to completion (availableNow) into parquet under spark.checkpoint.dir; read it back.

    The checkpoint sits next to the output.  Without `folder`, both get a new
    one; a call with the `folder` of an earlier one goes on where that ended,
    and the file sink stays exactly-once.
    """
    spark = df.sparkSession
    base = folder or shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    q = (df.writeStream.outputMode(mode).format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------------------------------ S1 --
def stream_cost_window(calls: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Per (window, model) call counts, tokens and cost; a window is final once the watermark passes its end."""
    costed = telemetry.call_cost(calls)  # stream-static join with the fixed price dimension
    return (costed.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("total_calls"),
                 F.sum("input_tokens").alias("total_input_tokens"),
                 F.sum("output_tokens").alias("total_output_tokens"),
                 F.sum("cost_usd").alias("total_estimated_cost_usd"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model",
                    "total_calls", "total_input_tokens", "total_output_tokens", "total_estimated_cost_usd"))


def stream_cost_summary(calls: DataFrame) -> DataFrame:
    """Live totals per model, the windows still open included: for output mode "complete" or "update"."""
    return telemetry.metrics_summary(telemetry.call_cost(calls), by=["model"])


def run_to_snapshot(df: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode stream over what there is; the last trigger's table, kept in the shared folder."""
    spark = df.sparkSession
    base = shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = (df.writeStream.outputMode("complete").foreachBatch(on_batch)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_to_keyed(df: DataFrame, name: str, keys: Sequence[str], folder: str | None = None, merge_every: int = sinks.MERGE_EVERY) -> DataFrame:
    """Run an update-mode stream over what there is; the latest row of every key.

    Each trigger writes the groups it changed and no others.  With the `folder`
    of an earlier call the stream goes on where that ended.  Groups that a
    watermark closed keep their last row; events later than it are left out.
    """
    spark = df.sparkSession
    base = folder or shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    q = (df.writeStream.outputMode("update")
         .foreachBatch(lambda batch, epoch: sinks.write_keyed(batch, f"{base}/table", keys, epoch, merge_every))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return sinks.read_keyed(spark, f"{base}/table", df.schema, keys)


# ------------------------------------------------------------------ S2 --
RUN_STATE_SCHEMA = ("run_id LONG, n_events LONG, last_seq_ts TIMESTAMP, last_event_id LONG, final_state STRING, "
                    "attempts LONG, illegal_transitions LONG, terminal BOOLEAN")
_STATE_SCHEMA = ("n_events LONG, last_ts TIMESTAMP, last_event_id LONG, last_state STRING, attempts LONG, "
                 "illegal LONG")


def _run_state_fn(legal: set, terminal: tuple):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            n, last_ts, last_id, last_state, attempts, illegal = state.get
        else:
            n, last_ts, last_id, last_state, attempts, illegal = 0, None, None, None, 0, 0
        batch = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        for ts, eid, st in zip(batch["ts"], batch["event_id"], batch["state"]):
            if last_state is not None and (last_state, st) not in legal:
                illegal += 1
            attempts += int(st == "PATCH")
            n += 1
            last_ts, last_id, last_state = ts, int(eid), st
        state.update((n, last_ts, last_id, last_state, attempts, illegal))
        yield pd.DataFrame({"run_id": [key[0]], "n_events": [n], "last_seq_ts": [last_ts],
                            "last_event_id": [last_id], "final_state": [last_state], "attempts": [attempts],
                            "illegal_transitions": [illegal], "terminal": [last_state in terminal]})
    return fn


def stream_run_state(events: DataFrame, terminal=("COMPLETED", "ERROR")) -> DataFrame:
    """Per-run state machine over (run_id, event_id, ts, state) events; one summary row per run per trigger.

    Events of a run that arrive in one trigger are ordered by (ts, event_id)
    inside the state function (Structured Streaming allows no sort before a
    stateful operator), so a run's events of one trigger meet in one task; for
    runs too long for that, `stream_run_state_tables` spreads one run over many
    tasks.  The state kept between triggers is six values per run.  The summary
    emitted last for a run (largest n_events) is its current state.
    """
    fn = _run_state_fn(legal_pairs(), terminal)
    return (events.groupBy("run_id")
            .applyInPandasWithState(fn, RUN_STATE_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))


def latest_run_state(summaries: DataFrame) -> DataFrame:
    return (summaries.groupBy("run_id")
            .agg(F.max_by(F.struct("final_state", "attempts", "illegal_transitions", "terminal", "n_events"),
                          "n_events").alias("s"))
            .select("run_id", "s.*"))


# ------------------------------------------------------------------ S3 --
def stream_message_delta(snapshots: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Items of re-sent cumulative message lists, each kept once (state bounded by the watermark)."""
    return (snapshots.withWatermark("event_ts", watermark)
            .dropDuplicatesWithinWatermark(["run_id", "idx"]))


# ------------------------------------------------------------------ S4 --
def stream_guardrail(cmds: DataFrame, col: str = "cmd") -> DataFrame:
    """Blocked commands only (stateless; the denylist is an in-row CASE)."""
    return guardrails.audit_commands(cmds, col).where("blocked")


# ------------------------------------------------------------------ S5 --
def stream_log_parse(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.readStream.format("text").load(path))


# ------------------------------------------------------------------ S6 --
def stream_scan(files: DataFrame) -> DataFrame:
    """Findings for files as they arrive (stateless, append)."""
    return vuln.findings(vuln.python_facts(vuln.ast_path_skip(files), ruled_only=True))


def stream_findings(files: DataFrame, path: str, checkpoint: str, version_col: str = "scan"):
    """Start a stream of (repo, path, content, scan) that keeps a findings table at its files' last scans.

    Of a file that comes several times in one trigger the last scan counts.  Each
    trigger is one version of the table; a trigger repeated after a failure
    changes nothing.  Returns the StreamingQuery.
    """
    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        last = batch.groupBy("repo", "path").agg(F.max_by("content", version_col).alias("content"))
        last = last.persist()  # scanned and listed
        sinks.upsert_findings(vuln.scan_findings(last), last, path, epoch_id)
        last.unpersist()

    return files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------- S2, Spark-only --
STATE_TABLE_COLS = ("run_id", "n_events", "last_ts", "last_event_id", "final_state", "attempts", "illegal_transitions")


def _merge_run_batch(batch: DataFrame, prev: DataFrame | None, edges: DataFrame) -> DataFrame:
    """One micro-batch of (run_id, event_id, ts, state) merged into the per-run state table."""
    from corpuslens.operators import sequence
    ev = batch.select("run_id", "event_id", "ts", "state")
    nb = sequence.neighbors(ev, "run_id", ["ts", "event_id"], ["state"]).drop("next_state")
    if prev is not None:
        carried = prev.select(F.col("run_id").alias("_run"), F.col("final_state").alias("_carried"))
        nb = (nb.join(carried, F.col("run_id").eqNullSafe(F.col("_run")), "left")
              .withColumn("prev_state", F.coalesce("prev_state", "_carried")).drop("_run", "_carried"))
    legal = (edges.select(F.col("state").alias("prev_state"), F.col("next_state").alias("state"))
                        .distinct().withColumn("_ok", F.lit(True)))  # fixed 13-edge dimension
    j = nb.join(legal, ["prev_state", "state"], "left")
    last = F.max_by(F.struct("ts", "event_id", "state"), F.struct("ts", "event_id"))
    repeated = F.coalesce((F.col("state") == "COMPLETED") & (F.col("prev_state") == "COMPLETED"), F.lit(False))
    agg = (j.groupBy("run_id")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "PATCH").alias("a"),
                F.count_if(F.col("prev_state").isNotNull() & F.col("_ok").isNull() & ~repeated).alias("i"),
                last.alias("l")))
    if prev is None:
        return agg.select("run_id", F.col("n").alias("n_events"), F.col("l.ts").alias("last_ts"),
                          F.col("l.event_id").alias("last_event_id"), F.col("l.state").alias("final_state"),
                          F.col("a").alias("attempts"), F.col("i").alias("illegal_transitions"))
    fresh = agg.withColumnRenamed("run_id", "_run").withColumn("_new", F.lit(True))
    m = prev.join(fresh, F.col("run_id").eqNullSafe(F.col("_run")), "full")
    m = m.withColumn("run_id", F.when(F.col("_new"), F.col("_run")).otherwise(F.col("run_id")))
    z = F.lit(0).cast("long")
    return m.select(
        "run_id",
        (F.coalesce("n_events", z) + F.coalesce("n", z)).alias("n_events"),
        F.coalesce("l.ts", "last_ts").alias("last_ts"),
        F.coalesce("l.event_id", "last_event_id").alias("last_event_id"),
        F.coalesce("l.state", "final_state").alias("final_state"),
        (F.coalesce("attempts", z) + F.coalesce("a", z)).alias("attempts"),
        (F.coalesce("illegal_transitions", z) + F.coalesce("i", z)).alias("illegal_transitions"))


def stream_run_state_tables(events: DataFrame, state_root: str, edges: DataFrame | None = None,
                            checkpoint: str | None = None):
    """Start the Spark-only run tracker; returns the StreamingQuery.

    Each epoch writes the merged state to `state_root/epoch=<id>` (a rerun of an
    epoch overwrites the same folder, so retries are idempotent) and the next
    epoch reads the newest earlier epoch.  The stream's checkpoint stands in `checkpoint`, or beside the epochs: a
    second start on the same `state_root` goes on where the first ended.  No Python runs per row, and a hot
    run is handled by the range-partitioned path of `sequence.neighbors`.
    """
    from corpuslens.operators import runs
    spark = events.sparkSession
    edges = edges if edges is not None else runs.transitions_df(spark)

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        s, prev = batch.sparkSession, None
        found = s._jvm.org.apache.hadoop.fs.Path(f"{state_root}/epoch=*")
        if found.getFileSystem(s._jsc.hadoopConfiguration()).globStatus(found):  # any other failure fails the batch
            hist = s.read.parquet(state_root)
            prior = hist.where(F.col("epoch") < epoch_id).agg(F.max("epoch")).first()[0]
            if prior is not None:
                prev = hist.where(F.col("epoch") == prior).select(*STATE_TABLE_COLS)
        merged = _merge_run_batch(batch, prev, edges)
        merged.write.mode("overwrite").parquet(f"{state_root}/epoch={epoch_id}")

    return (events.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint or f"{state_root}/_checkpoint").trigger(availableNow=True).start())


def latest_state_table(spark: SparkSession, state_root: str) -> DataFrame:
    hist = spark.read.parquet(state_root)
    top = hist.agg(F.max("epoch")).first()[0]
    return hist.where(F.col("epoch") == top).select(*STATE_TABLE_COLS)
