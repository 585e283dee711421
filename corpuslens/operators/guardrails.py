"""Command denylist audit over command logs and tool-call payloads.

The denylist is a fixed list, so each rule becomes one branch of a CASE
expression evaluated in-row: no join, no pairs of commands x rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens import rules
from corpuslens.session import shared_dir


def first_rule(text: Column, patterns: Sequence[str] = rules.COMMAND_DENYLIST) -> Column:
    """1-based id of the first denylist pattern found (case-insensitive) in text, null when allowed.

    (?U) makes \\s match Unicode whitespace, as the patterns do on Python strings.
    """
    expr = None
    for i, p in enumerate(patterns, 1):
        cond = text.rlike("(?iU)" + p)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def audit_commands(cmds: DataFrame, col: str = "cmd", patterns: Sequence[str] = rules.COMMAND_DENYLIST) -> DataFrame:
    """Adds rule_id (first matching pattern) and blocked."""
    rid = first_rule(F.col(col), patterns)
    return cmds.withColumn("rule_id", rid).withColumn("blocked", F.col("rule_id").isNotNull())


def to_payload_json(payload: Column) -> Column:
    """a payload (struct, map, array, variant or JSON text) as JSON text; text that is no JSON becomes a JSON string."""
    return F.to_json(payload)


def from_payload_json(text: Column) -> Column:
    """JSON text as a VARIANT that keeps every key; null where it doesn't parse."""
    return F.try_parse_json(text)


def payload_strings(calls: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, value): every string value at any depth of a VARIANT column, with its JSON path.

    One round opens one level of all payloads; there are as many as the deepest
    payload has levels, and each round is written below spark.checkpoint.dir.
    """
    spark = calls.sparkSession
    level = calls.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.col(payload).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        out = shared_dir(spark, f"payload-{uuid.uuid4().hex}")
        level.write.parquet(out)
        level = spark.read.schema(level.schema).parquet(out).withColumn("kind", F.schema_of_variant("v"))
        here = level.where("kind = 'STRING'").select("key", "path", F.expr("CAST(v AS STRING)").alias("value"))
        found = here if found is None else found.unionByName(here)
        nested = level.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'")
        if nested.isEmpty():
            return found
        inner = nested.alias("o").lateralJoin(spark.tvf.variant_explode(F.col("o.v").outer()).alias("e"))
        step = F.when(F.col("e.key").isNull(), F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("e.key")))
        level = inner.select(F.col("o.key").alias("key"), F.concat("o.path", step).alias("path"), F.col("e.value").alias("v"))


def audit_payloads(calls: DataFrame, payload_col: str = "payload", patterns: Sequence[str] = rules.COMMAND_DENYLIST,
                   strict: bool = False) -> DataFrame:
    """The same rules over the JSON text of a payload (tabs/newlines appear escaped there).

    With `strict`, every string value inside the payload is tested as it is,
    too, so that white space other than blanks can't hide a command: rule_id is
    the first rule that either finds, blocked_at the path of the value that
    shows it (the first path, if several do; null where just the JSON text
    does).  A null payload is allowed.
    """
    text = isinstance(calls.schema[payload_col].dataType, StringType)
    j = F.col(payload_col) if text else to_payload_json(F.col(payload_col))
    calls = calls.withColumn("payload_json", j).withColumn("rule_id", first_rule(F.col("payload_json"), patterns))
    if not strict:
        return calls.withColumn("blocked", F.col("rule_id").isNotNull())
    spark = calls.sparkSession
    out = shared_dir(spark, f"calls-{uuid.uuid4().hex}")
    calls.withColumn("_rid", F.monotonically_increasing_id()).write.parquet(out)
    kept = spark.read.parquet(out)
    strings = payload_strings(kept.select("_rid", from_payload_json(F.col("payload_json")).alias("_v")), "_rid", "_v")
    raw = strings.withColumn("rule", first_rule(F.col("value"), patterns)).where("rule IS NOT NULL")
    raw = raw.groupBy(F.col("key").alias("_rid")).agg(F.min(F.struct("rule", "path")).alias("_raw"))
    first = F.least("rule_id", "_raw.rule")
    at = F.when(F.col("_raw.rule") == first, F.col("_raw.path"))
    return (kept.join(raw, "_rid", "left").withColumn("blocked_at", at).withColumn("rule_id", first)
            .withColumn("blocked", F.col("rule_id").isNotNull()).drop("_rid", "_raw"))
