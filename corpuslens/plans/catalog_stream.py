"""Catalogue part 4: streaming jobs (run to completion with availableNow), log/event sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslens.operators import vuln
from corpuslens.plans import catalog_runs as R
from corpuslens.plans.catalog import (ORDER_FILES_SQL, ORDER_SRC_SQL, _applied, _expected_findings_sql, _expected_patch_sql,
                                      _order_findings, _report_sql, order_files, query, table, table_sql)
from corpuslens.session import shared_dir
from corpuslens.sources import corpus, logs, sinks, tree
from corpuslens.streaming import jobs, tracker


# ------------------------------------------------------------------- S1 --
def _call_stream(spark, sf_dir):
    e = jobs.table_stream(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.expr(R._case("event_type", R.MODEL_BY_EVENT)).alias("model"),
                    (k * 100).alias("input_tokens"), (k * 10 + 5).alias("output_tokens"), F.col("value").alias("latency_s"))


@query("stream_cost_window", f"""
WITH c AS ({R.COSTED_SQL}),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, model, count(*) AS total_calls,
             sum(input_tokens) AS total_input_tokens, sum(output_tokens) AS total_output_tokens,
             sum(cost_usd) AS cost FROM c GROUP BY ALL)
SELECT window_start, model, CAST(total_calls AS BIGINT) AS total_calls, CAST(total_input_tokens AS BIGINT) AS total_input_tokens,
       CAST(total_output_tokens AS BIGINT) AS total_output_tokens, round(cost, 6) AS total_estimated_cost_usd
FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES
""")
def q_stream_cost_window(spark, sf_dir):
    out = jobs.run_to_table(jobs.stream_cost_window(_call_stream(spark, sf_dir)), "cost_window")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "total_calls",
                      "total_input_tokens", "total_output_tokens",
                      F.round("total_estimated_cost_usd", 6).alias("total_estimated_cost_usd"))


@query("stream_cost_live", f"""
WITH c AS ({R.COSTED_SQL}),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, model, count(*) AS total_calls, sum(input_tokens) AS total_input_tokens,
             sum(output_tokens) AS total_output_tokens, sum(cost_usd) AS cost FROM c GROUP BY ALL)
SELECT window_start, model, CAST(total_calls AS BIGINT) AS total_calls, CAST(total_input_tokens AS BIGINT) AS total_input_tokens,
       CAST(total_output_tokens AS BIGINT) AS total_output_tokens, round(cost, 6) AS total_estimated_cost_usd FROM w
""")
def q_stream_cost_live(spark, sf_dir):
    """Every window and model as of now, the open ones too: update mode into a keyed table."""
    out = jobs.run_to_keyed(jobs.stream_cost_window(_call_stream(spark, sf_dir)), "cost_live", ["window_start", "window_end", "model"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "total_calls", "total_input_tokens",
                      "total_output_tokens", F.round("total_estimated_cost_usd", 6).alias("total_estimated_cost_usd"))


@query("stream_cost_summary", f"""
SELECT model, CAST(count(*) AS BIGINT) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       round(coalesce(avg(latency_s), 0), 6) AS average_latency_seconds,
       round(coalesce(sum(cost_usd), 0), 6) AS total_estimated_cost_usd
FROM ({R.COSTED_SQL}) GROUP BY model
""")
def q_stream_cost_summary(spark, sf_dir):
    """The live totals: every call counts, those of windows still open too."""
    out = jobs.run_to_snapshot(jobs.stream_cost_summary(_call_stream(spark, sf_dir)), "cost_summary")
    return out.select("model", "total_calls", "total_input_tokens", "total_output_tokens",
                      F.round("average_latency_seconds", 6).alias("average_latency_seconds"),
                      F.round("total_estimated_cost_usd", 6).alias("total_estimated_cost_usd"))


# ------------------------------------------------------------------- S2 --
@query("stream_run_state", f"""
WITH r AS ({R.RUN_SQL}),
l AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS prev_state FROM r),
j AS (SELECT l.*, e.state IS NULL AND l.prev_state IS NOT NULL AS illegal
      FROM l LEFT JOIN {R.EDGES_SQL} ON l.prev_state = e.prev_state AND l.state = e.state)
SELECT run_id, arg_max(state, seq) AS final_state, CAST(count(*) FILTER (WHERE state = 'PATCH') AS BIGINT) AS attempts,
       CAST(count(*) FILTER (WHERE illegal) AS BIGINT) AS illegal_transitions,
       arg_max(state, seq) IN ('COMPLETED', 'ERROR') AS terminal, CAST(count(*) AS BIGINT) AS n_events
FROM j GROUP BY run_id
""")
def q_stream_run_state(spark, sf_dir):
    e = jobs.table_stream(spark, sf_dir, "events")
    ev = e.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                  F.expr(R._case("event_type", R.STATE_BY_EVENT)).alias("state"))
    out = jobs.run_to_table(jobs.stream_run_state(ev), "run_state")
    return jobs.latest_run_state(out)


# ------------------------------------------------------------------- S3 --
@query("stream_message_delta", """
SELECT conv_id AS run_id, turn AS idx, role AS sender, md5(text) AS message_md5 FROM conversations
""")
def q_stream_message_delta(spark, sf_dir):
    c = jobs.table_stream(spark, sf_dir, "conversations")
    # Every list item is delivered twice (the whole list is re-sent with the next event).
    snaps = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), F.col("role").alias("sender"),
                     F.col("text").alias("message"),
                     F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100000 + F.col("turn")).alias("event_ts"),
                     F.explode(F.array(F.col("turn"), F.col("turn") + 1)).alias("event_seq"))
    out = jobs.run_to_table(jobs.stream_message_delta(snaps), "message_delta")
    return out.select("run_id", "idx", "sender", F.md5("message").alias("message_md5"))


# ------------------------------------------------------------------- S4 --
@query("stream_guardrail", f"""
SELECT event_id, cmd, {R._rule_sql('cmd')} AS rule_id FROM ({R.CMD_SQL}) WHERE {R._rule_sql('cmd')} IS NOT NULL
""")
def q_stream_guardrail(spark, sf_dir):
    e = jobs.table_stream(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    cmds = e.select("event_id", F.concat(F.expr(R._case("event_type", R.CMD_BY_EVENT)), k).alias("cmd"))
    out = jobs.run_to_table(jobs.stream_guardrail(cmds), "guardrail")
    return out.select("event_id", "cmd", "rule_id")


# ----------------------------------------------------------- A4 / S5 logs --
def log_lines(spark, sf_dir):
    """events rendered as one-line JSON log records, plus one malformed line per error event."""
    e = table(spark, sf_dir, "events")
    rec = F.struct(
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.lit("corpuslens.events").alias("logger"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.lit("events").alias("module"), F.col("event_id").cast("int").alias("line"),
        F.when(F.col("event_type") == "purchase", F.lit("PatchDeveloper")).alias("agent_name"))
    good = e.select(F.to_json(rec).alias("value"))
    bad = e.where(F.col("event_type") == "error").select(F.concat(F.lit("garbage "), F.col("event_id").cast("string")).alias("value"))
    return good.unionByName(bad)


LOG_ORACLE = """
SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'corpuslens.events' AS logger,
       event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, CAST(event_id AS INTEGER) AS line,
       CASE WHEN event_type = 'purchase' THEN 'PatchDeveloper' END AS agent_name, CAST(NULL AS VARCHAR) AS corrupt
FROM events
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'garbage ' || CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'
"""


def _log_out(df):
    return df.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "logger", "message", "line",
                     "agent_name", "corrupt")


@query("log_parse", LOG_ORACLE)
def q_log_parse(spark, sf_dir):
    return _log_out(logs.parse_log_lines(log_lines(spark, sf_dir)))


@query("stream_log_parse", LOG_ORACLE)
def q_stream_log_parse(spark, sf_dir):
    path = shared_dir(spark, f"logs-{uuid.uuid4().hex[:8]}")
    log_lines(spark, sf_dir).write.mode("overwrite").text(path)
    out = jobs.run_to_table(jobs.stream_log_parse(spark, path), "log_parse")
    return _log_out(out)


# ---------------------------------------------------------------- A5 events --
@query("run_event_parse", f"""
SELECT CAST(user_id AS VARCHAR) AS run_id, {R._case('event_type', R.STATE_BY_EVENT)} AS state,
       'Transitioning to state: ' || {R._case('event_type', R.STATE_BY_EVENT)} AS message,
       CAST(1 AS INTEGER) AS n_messages, event_type AS first_message
FROM events
""")
def q_run_event_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.expr(R._case("event_type", R.STATE_BY_EVENT))
    env = F.to_json(F.struct(state.alias("state"), F.concat(F.lit("Transitioning to state: "), state).alias("message"),
                             F.struct(F.col("user_id").cast("string").alias("run_id"),
                                      F.array(F.struct(F.lit("Orchestrator").alias("sender"), state.alias("recipient"),
                                                       F.col("event_type").alias("message"))).alias("agent_messages"))
                             .alias("data")))
    lines = e.select(F.concat(F.lit("data: "), env).alias("value")).unionByName(
        e.where(F.col("event_type") == "error").select(F.lit(": keep-alive").alias("value")))
    p = logs.parse_event_lines(lines)
    return p.select(F.col("data.run_id").alias("run_id"), "state", "message",
                    F.size("data.agent_messages").cast("int").alias("n_messages"),
                    F.col("data.agent_messages")[0]["message"].alias("first_message"))


# ------------------------------------------------------------------- S6 --
@query("stream_scan", f"""
WITH {_expected_findings_sql()}
SELECT repo, path, CAST(line AS INTEGER) AS line, cwe, severity FROM exp
""")
def q_stream_scan(spark, sf_dir):
    o = jobs.table_stream(spark, sf_dir, "orders")
    files = o.selectExpr("'cust_' || CAST(o_custkey AS STRING) AS repo",
                         "'svc/order_' || CAST(o_orderkey AS STRING) || '.py' AS path",
                         f"{ORDER_SRC_SQL} AS content")
    out = jobs.run_to_table(jobs.stream_scan(files), "scan")
    return out.select("repo", "path", "line", "cwe", "severity")


# ---------------------------------------------------------- A1 / A7 / A8 --
SCAN_PATH_SQL = """CASE doc_id % 6 WHEN 0 THEN '_internal/doc_' || {id} || '.py' WHEN 1 THEN 'pkg_' || {id} || '/__init__.py'
    WHEN 2 THEN '.hidden/doc_' || {id} || '.py' WHEN 3 THEN 'src/.env_' || {id} || '.py' WHEN 4 THEN 'src/s p/doc ' || {id} || '%20.py'
    ELSE 'src/notes/doc_' || {id} || '.md' END""".format(id="CAST(doc_id AS STRING)")


@query("corpus_scan", f"""
SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
       md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_md5
FROM (SELECT {SCAN_PATH_SQL} AS path, text FROM documents) WHERE path LIKE '%.py' AND octet_length(encode(text)) <= 50000
""")
def q_corpus_scan(spark, sf_dir):
    """Every document written as a file of its own, names with _ and . among them, and the folder scanned with contents."""
    root = shared_dir(spark, f"corpus-{uuid.uuid4().hex[:8]}")
    tree.write_files(table(spark, sf_dir, "documents").selectExpr(f"{SCAN_PATH_SQL} AS path", "text AS content"), root)
    files = corpus.scan_corpus(spark, root, exts=[".py"], max_bytes=50_000)
    return files.select("path", "size_bytes", F.md5("content").alias("content_md5"))


@query("remediated_export", f"""
WITH {_expected_patch_sql()}
SELECT 'run_' || substr(repo, 6, 1) AS run_id, path, md5(new_content) AS content_md5 FROM pexp WHERE status = 'APPLIED'
""")
def q_remediated_export(spark, sf_dir):
    path = shared_dir(spark, f"remediated-{uuid.uuid4().hex[:8]}")
    run = F.concat(F.lit("run_"), F.substring("repo", 6, 1))  # a review run covers several repos
    sinks.write_remediated(_applied(spark, sf_dir).withColumn("run_id", run), path)
    back = spark.read.parquet(path)
    return back.select(F.col("run_id").cast("string").alias("run_id"), "path", F.md5("content").alias("content_md5"))


@query("findings_sink", f"""
WITH {_expected_findings_sql()}
SELECT repo, path, CAST(line AS INTEGER) AS line, cwe, vulnerability, severity, code, description FROM exp
""")
def q_findings_sink(spark, sf_dir):
    path = shared_dir(spark, f"findings-{uuid.uuid4().hex[:8]}")
    sinks.write_findings(_order_findings(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select(F.col("repo").cast("string").alias("repo"), "path", "line", "cwe", "vulnerability",
                       "severity", "code", "description")


@query("remediated_status", f"""
WITH {_expected_patch_sql()},
r AS (SELECT 'run_' || substr(repo, 6, 1) AS run_id, path, status, new_content FROM pexp),
asked AS (SELECT DISTINCT run_id FROM r UNION ALL SELECT 'run_x')
SELECT asked.run_id, CASE WHEN count(r.path) FILTER (status = 'APPLIED') > 0 THEN 'EXPORTED'
                          WHEN count(r.path) > 0 THEN 'NOTHING_MODIFIED' ELSE 'UNKNOWN_RUN' END AS status,
       CAST(count(r.path) FILTER (status = 'APPLIED') AS BIGINT) AS files,
       CAST(coalesce(sum(octet_length(encode(new_content))) FILTER (status = 'APPLIED'), 0) AS BIGINT) AS bytes
FROM asked LEFT JOIN r ON asked.run_id = r.run_id GROUP BY asked.run_id
""")
def q_remediated_status(spark, sf_dir):
    """What an export says of every asked run, one of them unknown; runs are cut into parts of 64 KB here."""
    applied = _applied(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_"), F.substring("repo", 6, 1)))
    asked = applied.select("run_id").unionByName(spark.createDataFrame([("run_x",)], "run_id string"))
    return sinks.write_remediated(applied, shared_dir(spark, f"remediated-{uuid.uuid4().hex[:8]}"), asked=asked, task_bytes=1 << 16)


#: What the second scan of the findings stream holds: F orders' files are emptied, P orders' get another fault, O orders' aren't scanned.
RESCAN_SQL = "CASE o_orderstatus WHEN 'F' THEN '' ELSE 'def f(x):' || chr(10) || '    exec(x)' || chr(10) END"


@query("findings_upsert_stream", f"""
WITH {_expected_findings_sql()}
SELECT exp.repo, exp.path, CAST(line AS INTEGER) AS line, cwe, code FROM exp JOIN ofiles ON exp.repo = ofiles.repo AND exp.path = ofiles.path
WHERE o_orderstatus = 'O'
UNION ALL
SELECT repo, path, 2, 'CWE-94', 'exec(x)' FROM ofiles WHERE o_orderstatus NOT IN ('F', 'O')
""")
def q_findings_upsert_stream(spark, sf_dir):
    """All files stream into a findings table, then changed ones; the second trigger runs twice, as after a failure."""
    base = shared_dir(spark, f"findings-{uuid.uuid4().hex[:8]}")
    files = table_sql(spark, sf_dir, ORDER_FILES_SQL)
    first = files.select("repo", "path", "content", F.lit(1).alias("scan"))
    again = files.where("o_orderstatus <> 'O'").selectExpr("repo", "path", f"{RESCAN_SQL} AS content", "2 AS scan")
    for scan in (first, again):
        scan.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(first.schema).parquet(f"{base}/in")
        jobs.stream_findings(source, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    assert not sinks.upsert_findings(spark.createDataFrame([], sinks.FINDINGS_SCHEMA), again, f"{base}/table", 1)
    return sinks.read_findings(spark, f"{base}/table").select("repo", "path", "line", "cwe", "code")


@query("report_sink", f"""
WITH {_report_sql()}
SELECT repo, n_findings, CAST(length(report) AS BIGINT) AS report_chars, md5(report) AS report_md5 FROM rep
""")
def q_report_sink(spark, sf_dir):
    """Reports written as numbered parts in order, read back and digested line by line."""
    path = shared_dir(spark, f"report-{uuid.uuid4().hex[:8]}")
    sinks.write_report(vuln.findings_report_lines(_order_findings(spark, sf_dir), order_files(spark, sf_dir)), path)
    return sinks.report_digests(sinks.read_report(spark, path))


@query("stream_run_tracker", f"""
WITH r AS ({R.RUN_SQL}),
l AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS prev_state FROM r),
j AS (SELECT l.*, e.state IS NULL AND l.prev_state IS NOT NULL AS illegal
      FROM l LEFT JOIN {R.EDGES_SQL} ON l.prev_state = e.prev_state AND l.state = e.state)
SELECT run_id, arg_max(state, seq) AS final_state, CAST(count(*) FILTER (WHERE state = 'PATCH') AS BIGINT) AS attempts,
       CAST(count(*) FILTER (WHERE illegal) AS BIGINT) AS illegal_transitions,
       arg_max(state, seq) IN ('COMPLETED', 'ERROR') AS terminal, CAST(count(*) AS BIGINT) AS n_events
FROM j GROUP BY run_id
""")
def q_stream_run_tracker(spark, sf_dir):
    """Events in three deliveries that overlap by up to an hour, so that some come late, over two starts of one tracker.

    A delivery is one trigger: none has more files than the first, and a trigger takes as many as that.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                                              F.expr(R._case("event_type", R.STATE_BY_EVENT)).alias("state"))
    base = shared_dir(spark, f"tracker-{uuid.uuid4().hex[:8]}")
    low, high = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    arrives = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3600))
    slot = F.least(F.floor((arrives - (low or 0)) / third), F.lit(2))
    for i, stop in ((0, False), (1, True), (2, True)):
        rows = e.where(slot == i)
        (rows.coalesce(n) if i else rows).write.mode("append").parquet(f"{base}/in")
        if i == 0:
            n = max(len(spark.read.schema(e.schema).parquet(f"{base}/in").inputFiles()), 1)
        if stop:
            source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", n).parquet(f"{base}/in")
            tracker.start_tracker(tracker.stream_run_tracker(source, delay="1 hour"), base).awaitTermination()
    return jobs.latest_run_state(spark.read.parquet(f"{base}/rows"))


@query("stream_run_state_tables", f"""
WITH r AS ({R.RUN_SQL}),
l AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS prev_state FROM r),
j AS (SELECT l.*, e.state IS NULL AND l.prev_state IS NOT NULL AS illegal
      FROM l LEFT JOIN {R.EDGES_SQL} ON l.prev_state = e.prev_state AND l.state = e.state)
SELECT run_id, arg_max(state, seq) AS final_state, CAST(count(*) FILTER (WHERE state = 'PATCH') AS BIGINT) AS attempts,
       CAST(count(*) FILTER (WHERE illegal) AS BIGINT) AS illegal_transitions, CAST(count(*) AS BIGINT) AS n_events
FROM j GROUP BY run_id
""")
def q_stream_run_state_tables(spark, sf_dir):
    """S2 without Python: foreachBatch merges each micro-batch into a versioned per-run state table."""
    e = jobs.table_stream(spark, sf_dir, "events")
    ev = e.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                  F.expr(R._case("event_type", R.STATE_BY_EVENT)).alias("state"))
    root = shared_dir(spark, f"run-state-{uuid.uuid4().hex[:8]}")
    jobs.stream_run_state_tables(ev, root).awaitTermination()
    return jobs.latest_state_table(spark, root).select("run_id", "final_state", "attempts", "illegal_transitions",
                                                       "n_events")
