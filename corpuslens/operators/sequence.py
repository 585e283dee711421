"""Ordered neighbours and running counts per key that stay balanced when one key is huge.

A window partitioned by key sends a whole key to one task; if one run holds a
third of all events that task holds a third of the data.  Here rows are
range-partitioned by (key, order) instead, so a hot key spans many
partitions.  Neighbours are taken within each partition; the rows that sit at
a partition boundary get theirs from a per-partition first/last table whose
size is the number of partitions (a proven bound, hence broadcast).  Exact:
the result equals lag/lead/running sum over Window.partitionBy(key), ties
ordered by the other columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import shared_dir


def _ties(df: DataFrame, key: str, order: Sequence[str]) -> list[str]:
    """Columns that order rows equal in `order`: the others, as they come, but for maps and variants, which have no order."""
    return [f.name for f in df.schema.fields if f.name not in (key, *order) and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def _ranged(df: DataFrame, key: str, order: Sequence[str], partitions: int | None) -> DataFrame:
    """Range-partition by (key, order), number the rows (`_pos`, in order) with their partition (`_pid`), and write them.

    Range bounds come from sampling, so two evaluations of the same plan may
    place a row differently; the rows, the boundary table and any retry after
    an executor loss must all see one assignment.  A table written below
    spark.checkpoint.dir fixes it (and cuts the lineage).  Rows equal in key
    and order lie in one partition; the other columns order them.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled by a job over the input before the shuffle reads it again: persisted, it runs once.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    path = shared_dir(spark, f"ranged-{uuid.uuid4().hex}")
    ranged = (src.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order, *_ties(df, key, order))
              .withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    ranged.write.parquet(path)
    src.unpersist()
    return spark.read.schema(ranged.schema).parquet(path)


def neighbors(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
              partitions: int | None = None, skew_safe: bool = True) -> DataFrame:
    """Adds prev_<c> and next_<c> for each c in cols (null at the first / last row of a key).

    Null keys are a key of their own, null order values come first, and rows
    equal in `order` are ordered by their other columns.  skew_safe=False is a
    plain window per key, with the same result: for callers that know their
    keys to be small.
    """
    if not skew_safe:
        w = Window.partitionBy(key).orderBy(*order, *_ties(df, key, order))
        return df.select("*", *[f(c).over(w).alias(f"{n}_{c}") for c in cols for n, f in (("prev", F.lag), ("next", F.lead))])
    r = _ranged(df, key, order, partitions)
    w = Window.partitionBy("_pid", key).orderBy("_pos")
    out = r.select("*", F.lag("_pos").over(w).isNull().alias("_first"), F.lead("_pos").over(w).isNull().alias("_last"),
                   *[f(c).over(w).alias(f"{n}_{c}") for c in cols for n, f in (("_p", F.lag), ("_n", F.lead))])
    vals = F.struct(F.col(key).alias("k"), *[F.col(c).alias(c) for c in cols])
    edge = (r.groupBy("_pid").agg(F.min_by(vals, "_pos").alias("first"), F.max_by(vals, "_pos").alias("last")))
    wp = Window.orderBy("_pid")
    # Previous / next non-empty partition's boundary row (empty partitions have no row here).
    edge = edge.select("_pid", F.lag("last").over(wp).alias("before"), F.lead("first").over(wp).alias("after"))
    out = out.join(F.broadcast(edge), "_pid", "left")  # at most `partitions` rows
    for c in cols:
        prev = F.when(F.col("_first") & F.col("before").isNotNull() & F.col("before.k").eqNullSafe(F.col(key)), F.col(f"before.{c}"))
        nxt = F.when(F.col("_last") & F.col("after").isNotNull() & F.col("after.k").eqNullSafe(F.col(key)), F.col(f"after.{c}"))
        out = (out.withColumn(f"prev_{c}", F.when(F.col("_first"), prev).otherwise(F.col(f"_p_{c}")))
               .withColumn(f"next_{c}", F.when(F.col("_last"), nxt).otherwise(F.col(f"_n_{c}"))))
    drop = ["_pid", "_pos", "_first", "_last", "before", "after"] + [f"_{x}_{c}" for c in cols for x in ("p", "n")]
    return out.drop(*drop)


def running_count(df: DataFrame, key: str, order: Sequence[str], flag: str, out_col: str,
                  partitions: int | None = None, skew_safe: bool = True) -> DataFrame:
    """out_col = number of rows with `flag` true from the key's first row up to this one (inclusive)."""
    one = F.when(F.col(flag), 1).otherwise(0)
    if not skew_safe:
        w = Window.partitionBy(key).orderBy(*order, *_ties(df, key, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out_col, F.sum(one).over(w).cast("long"))
    r = _ranged(df, key, order, partitions)
    w = Window.partitionBy("_pid", key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = r.withColumn("_local", F.sum(one).over(w))
    # Carry from earlier partitions of the same key: one row per (partition, key), a hot key has at most
    # `partitions` of them, so this window is bounded per key.
    totals = r.groupBy("_pid", key).agg(F.sum(one).alias("_t"))
    wc = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("_pid").alias("_pid2"), F.col(key).alias("_key2"),
                          F.coalesce(F.sum("_t").over(wc), F.lit(0)).alias("_carry"))
    return (local.join(carry, (F.col("_pid") == F.col("_pid2")) & F.col(key).eqNullSafe(F.col("_key2")))
            .withColumn(out_col, (F.col("_local") + F.col("_carry")).cast("long"))
            .drop("_pid", "_pos", "_local", "_carry", "_pid2", "_key2"))
