"""Exact deduplication by a content sort.

Normalised texts are range-partitioned by sampled splitters, sorted
externally inside each partition, and equal neighbours (compared in full by
the window's group boundaries) share the smallest identifier.

The splitter key is a bounded piece of the content: its first characters, its
digest (separates texts with a common beginning) and a slot.  So only short
keys reach the driver while splitters are sampled.  The slot is 0 except for
the contents with the most copies, whose rows are dealt over many slots; size
and smallest identifier of those come from a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import collapse_ws, own_name

#: The HOT_CONTENTS most frequent contents are dealt over slots of about SLOT_ROWS rows when they have HOT_ROWS rows.
#: Any other content has at most 1/HOT_CONTENTS of all rows.  The results don't depend on these numbers.
HOT_CONTENTS, HOT_ROWS, SLOT_ROWS = 10_000, 500, 250
PREFIX_CHARS = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of `docs`.

    Rows are equal when their texts are after each white-space run became one
    space; a null text counts as empty.  Of equal rows the one with the
    smallest identifier stays: null identifiers come last, of rows with the
    same identifier one stays.  keep_id is null only if every identifier of
    the group is.  Empty input gives empty output.  Input columns called like
    an added one are replaced.  carry=False returns the identifier and the
    added columns alone, so that only one form of the text is shuffled.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (id_col, text_col)])
    cols = docs.columns
    norm, pre, sha, slot, n, low, rn = (own_name(cols, c) for c in ("_norm", "_pre", "_sha", "_slot", "_n", "_low", "_rn"))
    normal = collapse_ws(F.col(text_col))

    # At most HOT_CONTENTS rows: that bounds the broadcast.
    hot = (docs.select(F.unhex(F.sha2(normal, 256)).alias(sha), F.col(id_col).alias(low))
           .groupBy(sha).agg(F.count("*").alias(n), F.min(low).alias(low))
           .where(F.col(n) >= HOT_ROWS).orderBy(F.col(n).desc(), sha).limit(HOT_CONTENTS))

    keep = cols if carry else [id_col]
    keyed = (docs.select(*keep, normal.alias(norm)).withColumn(sha, F.unhex(F.sha2(F.col(norm), 256)))
             .join(F.broadcast(hot), sha, "left")
             .withColumn(slot, F.when(F.col(n).isNotNull(), F.pmod(F.xxhash64(F.col(id_col), F.lit(7)),
                                                                   F.ceil(F.col(n) / SLOT_ROWS)).cast("long"))
                         .otherwise(F.lit(0).cast("long")))
             .withColumn(pre, F.left(norm, F.lit(PREFIX_CHARS))))
    # Where the text itself travels, its normal form is made again behind the exchange.
    moved = (keyed.drop(norm) if carry else keyed).repartitionByRange(pre, sha, slot)
    if carry:
        moved = moved.withColumn(norm, normal)
    run = Window.partitionBy(pre, sha, slot, norm)
    ordered = run.orderBy(F.col(id_col).asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (moved.withColumn(rn, F.row_number().over(ordered))
           .withColumn("keep_id", F.first(id_col).over(whole)).withColumn("group_size", F.count("*").over(whole)))
    is_hot = F.col(n).isNotNull()
    out = (out.withColumn("keep_id", F.when(is_hot, F.col(low)).otherwise(F.col("keep_id")))
           .withColumn("group_size", F.when(is_hot, F.col(n)).otherwise(F.col("group_size")))
           .withColumn("kept", (F.col(rn) == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
           .withColumn("text_sha256", F.lower(F.hex(sha))))
    return out.select(*keep, *added)
