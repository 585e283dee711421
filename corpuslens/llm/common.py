"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ensure_checkpoint_dir

#: ASCII white space as the contracts define it, inside a character class.
WS = r"\x20\x09-\x0D"
#: Matches exactly those white-space runs that are not already one space.
ODD_WS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module_name: str) -> None:
    """Send a module's functions to executors by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def collapse_ws(c: Column) -> Column:
    """Null counts as empty; each white-space run becomes one space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), ODD_WS, " ")


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[^{WS}]+")).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below spark.checkpoint.dir and read it back.

    Cuts the lineage with one evaluation of the plan; the files are visible to
    every executor and survive the loss of any.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """[0, v0, v0+v1, …] of an array of longs (one element more than the input), block-wise.

    An append copies its array, so a plain fold is quadratic; blocks keep a
    row with a million elements affordable.
    """
    def running(xs, start):
        return F.aggregate(xs, F.array(start),
                           lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def offsets(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v))
        starts = running(sums, F.lit(0).cast("long"))
        inner = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)),
                           lambda b, s: F.slice(running(b, s), F.lit(1), F.size(b)))
        return F.concat(F.flatten(inner), F.array(F.element_at(starts, -1)))

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                         lambda b: F.slice(values, b * block + 1, F.lit(block)))
    whole = F.transform(F.array(blocks), offsets)[0]
    return F.when(n > 0, whole).otherwise(F.array(F.lit(0).cast("long")))


def match_spans(text: Column, pattern: str, around: bool = False) -> Column:
    """Array of (start, end, token) for the non-overlapping matches of a regex; with `around` also (left, right).

    Positions are code points.  left is the text before the match from two
    matches back, right the text after it over the next match, both uncut.
    One pass splits off the gaps, one takes the matches; texts without a match
    cost one search.
    """
    def build(pair):
        gaps, toks = pair["g"], pair["t"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(toks)), toks,
                           lambda g, t: (F.length(g) + F.length(t)).cast("long"))
        cols = [F.slice(prefix_sums(steps), F.lit(2), F.size(toks)).alias("e"), toks.alias("t")]
        if around:
            both, pad = F.zip_with(F.slice(gaps, F.lit(1), F.size(toks)), toks, lambda g, t: F.concat(g, t)), F.array(F.lit(""))
            cols += [F.slice(c, F.lit(k), F.size(toks)).alias(n) for n, c, k in (
                ("g", gaps, 1), ("h", gaps, 2), ("i", F.concat(gaps, pad), 3), ("s", F.concat(toks, pad), 2),
                ("p", F.concat(pad, both), 1), ("o", F.concat(pad, pad, both), 1))]
        sides = (lambda r: [F.concat(r["o"], r["p"], r["g"]).alias("left"), F.concat(r["h"], r["s"], r["i"]).alias("right")]) if around else lambda r: []
        return F.transform(F.arrays_zip(*cols), lambda r: F.struct(
            (r["e"] - F.length(r["t"])).alias("start"), r["e"].alias("end"), r["t"].alias("token"), *sides(r)))

    pair = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("t"))
    found = F.transform(F.array(pair), build)[0]
    none = F.array().cast(f"array<struct<start:bigint,end:bigint,token:string{',left:string,right:string' if around else ''}>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _edge_print(edges: DataFrame):
    """Count and order-free hash of an edge set; one row reaches the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge to another.

    edges: (a long, b long), any direction, repeats allowed.  Alternating
    large-star / small-star steps: every edge moves towards the smallest
    neighbour, a node's neighbours are never gathered (min is combined
    map-side, hot nodes are split by the adaptive skew join), and the edge
    set never grows.  Every round is written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "edges")
    before = _edge_print(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(
            met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = stored(small, "edges")
        now = _edge_print(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def own_name(columns: Sequence[str], name: str) -> str:
    """`name`, with underscores in front until no column of the input is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
