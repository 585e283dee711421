"""Token / latency / cost telemetry over model-call records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import rules


def call_cost(calls: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """cost_usd = in/1e6*price_in + out/1e6*price_out on lower(model); unknown models cost 0, a null count counts as 0.

    Of several price rows of one model (in any case) the largest prices count, so that no call is counted twice.
    """
    pricing = pricing if pricing is not None else rules.pricing_df(calls.sparkSession)
    p = pricing.groupBy(F.lower("model").alias("_m")).agg(F.max("in_usd").alias("in_usd"), F.max("out_usd").alias("out_usd"))
    j = calls.join(p, F.lower(calls["model"]) == p["_m"], "left")
    none = F.lit(0)
    cost = (F.coalesce("input_tokens", none) / 1e6 * F.coalesce("in_usd", F.lit(0.0)) +
            F.coalesce("output_tokens", none) / 1e6 * F.coalesce("out_usd", F.lit(0.0)))
    return j.withColumn("cost_usd", cost).drop("_m", "in_usd", "out_usd")


def metrics_summary(costed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, token sums, mean latency (0 when no calls), total cost; optionally per group."""
    aggs = [F.count(F.lit(1)).alias("total_calls"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
            F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("average_latency_seconds"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_estimated_cost_usd")]
    return costed.groupBy(*by).agg(*aggs)
