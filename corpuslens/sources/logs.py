"""Structured log lines and progress-event envelopes, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import parse_iso_ts

LOG_SCHEMA = ("timestamp STRING, level STRING, logger STRING, message STRING, module STRING, line INT, "
              "agent_name STRING, task_id STRING, reasoning_step STRING, exception STRING")

EVENT_SCHEMA = (
    "state STRING, message STRING, data STRUCT<run_id: STRING, "
    "metrics: STRUCT<total_calls: BIGINT, total_input_tokens: BIGINT, total_output_tokens: BIGINT, "
    "average_latency_seconds: DOUBLE, total_estimated_cost_usd: DOUBLE>, "
    "agent_messages: ARRAY<STRUCT<sender: STRING, recipient: STRING, message: STRING>>, "
    "thought: STRING, report: STRING, patch: STRING, modified_files: ARRAY<STRING>, "
    "result: STRUCT<exit_code: INT, stdout: STRING, stderr: STRING, status: STRING>>"
)


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """A4: one JSON object per line -> typed columns; lines that do not parse keep their text in `corrupt`."""
    p = F.from_json(F.col(col), LOG_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.col(col).rlike(r"^\s*\{") & p.isNotNull() & p["level"].isNotNull()
    keep = [c for c in lines.columns if c != col]
    return lines.select(*keep, p.alias("j"), F.when(~ok, F.col(col)).alias("corrupt")).select(
        *keep, parse_iso_ts(F.col("j.timestamp")).alias("ts"), "j.level", "j.logger", "j.message", "j.module",
        "j.line", "j.agent_name", "j.task_id", "j.reasoning_step", "j.exception", "corrupt")


def read_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    src = spark.readStream.format("text").load(path) if streaming else spark.read.text(path)
    return parse_log_lines(src)


def parse_event_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """A5: 'data: {...}' envelopes -> (state, message, data struct, raw JSON)."""
    body = F.regexp_replace(F.col(col), r"^data: ", "")
    keep = [c for c in lines.columns if c != col]
    return (lines.where(F.col(col).startswith("data: "))
            .select(*keep, body.alias("raw"), F.from_json(body, EVENT_SCHEMA).alias("e"))
            .select(*keep, "e.state", "e.message", "e.data", "raw"))


def read_run_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    src = spark.readStream.format("text").load(path) if streaming else spark.read.text(path)
    return parse_event_lines(src)
