"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1.  A source's weight changes over it piecewise
linearly; the integral of the schedule, scaled to the source's target, is its
cumulative token demand.  A document standing at cumulative tokens c of its
source (over the epochs) gets the position at which the demand reaches c, the
inverse of that integral.  The mix is the range sort by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import WS, count_words, own_name

#: Weights by rank of the source, repeating; share of all words that the mix has; epochs at most.
WEIGHTS, SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2
#: Schedules by rank of the source, repeating: (start, end) factors of the weight over training time.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: A source's documents are numbered within hash slices (three hex digits), so that no source is sorted in one task.
SLICES = 4096


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from (source, size).

    Sources rank by code point, null last.  Targets share `share` of all
    sizes by weight; none exceeds max_epochs times its source, the excess is
    shared again by weight: with sources in order of their cap per weight,
    the capped ones are a prefix, found with running sums.  One row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    by = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # Level per weight if exactly the sources before this one are capped.
    per = (per.withColumn("goal", F.sum("source_size").over(every) * F.lit(share))
           .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("w_left"))
           .withColumn("free", F.col("level") * F.col("w") <= F.col("cap")))
    # The first free source's level holds for all behind it.
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("o"), "rank", "level"))).over(every)
    per = per.withColumn("at", level["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("w")))
    return per.select("source", "rank", "source_size", target.alias("target"))


def demand_inverse(part: Column, start: Column, end: Column) -> Column:
    """Time at which a linear schedule start → end has met `part` of its whole demand.

    The integral over [0, t] is start·t + (end − start)·t²/2, its whole (start + end)/2.
    """
    a, goal = (end - start) / 2, part * (start + end) / 2
    root = F.sqrt(F.greatest(start * start + a * 4 * goal, F.lit(0.0)))
    return F.when(start + root > 0, goal * 2 / (start + root)).otherwise(F.lit(0.0))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
           schedules: Sequence[tuple[float, float]] = SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, key, uses, *carry), one per document.

    uses: an array of (epoch, words, position), one element per epoch that
    takes words of the document.  A source's documents follow one another in
    hash order of their identifier; its target (rounded to whole words) ends
    inside at most one document, which is taken in part.  Null texts have size
    0, null sources are a source of their own, null identifiers sort as empty;
    repeated rows count one by one.  A source without words has target 0, an
    empty table gives an empty result.  Reruns agree: order and ties depend on
    the rows alone.
    """
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                      count_words(F.col(text_col)).alias("size"), *carry)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    one = one.withColumn("key", key).withColumn("slice", F.conv(F.left("key", F.lit(3)), 16, 10).cast("int"))
    by_slice = one.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    starts = by_slice.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    targets = source_targets(by_slice.withColumnRenamed("slice_size", "size"), weights, share, max_epochs)
    slices = (starts.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
              .select(F.col("source").alias("s3"), F.col("slice").alias("i3"), "slice_start", "rank", "source_size", "target"))
    within = (Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *carry)
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = (one.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(slices, F.col("source").eqNullSafe(F.col("s3")) & (F.col("slice") == F.col("i3"))))
    pick = (F.col("rank") % len(schedules) + 1).cast("int")
    lo, hi = (F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), pick) for i in (0, 1))
    goal = F.round("target").cast("long")

    def use(epoch):
        at = F.col("slice_start") + F.col("inner") + epoch * F.col("source_size")
        words = F.least(F.greatest(goal - at, F.lit(0)), F.col("size"))
        return F.struct(epoch.alias("epoch"), words.alias("words"),
                        F.when(words > 0, demand_inverse(at / F.col("target"), lo, hi)).alias("position"))

    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), use), lambda u: u["words"] > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", "key", uses.alias("uses"), *carry)


def mix(docs: DataFrame, carry: Sequence[str] = (), **settings) -> DataFrame:
    """The training sequence: `placed` with a row per use, range-partitioned and sorted by training position."""
    rows = placed(docs, carry=carry, **settings)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "key", F.inline("uses"), *carry)
    order = ["position", "key", "epoch"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of `docs`, in training order, once per epoch that takes the document.

    Where a source's target ends inside a document, that use has the taken
    words only; n_chars follows the text.
    """
    row = own_name(docs.columns, "_row")
    rows = mix(docs.withColumn(row, F.struct(*docs.columns)), carry=(row,))
    text, whole = F.col(f"{row}.text"), F.col("words") == F.col("size")
    # So many words, and what stands before and between them; possessive, so that Java matches it in a loop.
    head = F.concat(F.lit(f"^(?:[{WS}]*+[^{WS}]++){{"), F.col("words").cast("string"), F.lit("}+"))
    rows = rows.withColumn("_text", F.when(whole, text).otherwise(F.regexp_substr(text, head)))
    kinds = dict(docs.dtypes)

    def field(c):
        if c == "text":
            return F.col("_text").alias(c)
        if c == "n_chars":
            return F.when(whole, F.col(f"{row}.{c}")).otherwise(F.length("_text")).cast(kinds[c]).alias(c)
        return F.col(f"{row}.{c}").alias(c)

    return rows.select(*[field(c) for c in docs.columns])
