"""URL filter: listed rules, and for the rest a logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled table of URLs; training and scoring
stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, own_name

#: n-gram lengths, hash space, labelled rows at most, and the regression's settings.
NGRAMS, DIMENSIONS, MAX_LABELLED = (3, 4), 1 << 12, 4000
ITERATIONS, PENALTY = 30, 0.01


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives an empty text."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """Behind the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    rules: (host, path start, verdict).  A rule fits its host and all its
    subdomains; of equally long ones the one listed first counts.
    """
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):  # sorted() keeps the order of equals
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def ngrams(text: Column, mark: str) -> Column:
    """Character n-grams of a text, each behind `mark`; texts shorter than an n give none of that length."""
    def of(n):
        last = F.length(text) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit(mark), text.substr(i + 1, F.lit(n))))) \
                .otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in NGRAMS])


def _features(df: DataFrame, host: str, path: str, out: str) -> DataFrame:
    grams = own_name(df.columns, "_grams")
    text = F.concat(ngrams(F.concat(F.lit("^"), F.col(host), F.lit("$")), "h"), ngrams(F.concat(F.col(path), F.lit("$")), "p"))
    tf = HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol=grams, outputCol=out)
    return tf.transform(df.withColumn(grams, text)).drop(grams)


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED):
    """A model from (host, path, verdict), verdict allow or block; None without both verdicts.

    At most `max_rows` distinct rows are used, those with the smallest hash.
    """
    rows = (labelled.where(F.col("verdict").isin("allow", "block")).select("host", "path", "verdict").distinct()
            .orderBy(F.xxhash64("host", "path", "verdict"), "host", "path", "verdict").limit(max_rows))
    rows = _features(rows.withColumn("label", (F.col("verdict") == "block").cast("double")), "host", "path", "features")
    rows = rows.select("label", "features").persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None,
          url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    The longest fitting rule decides (`rule` is its text); otherwise rule is
    null and the model does.  Without `labelled` (host, path, verdict) it
    learns from the URLs that the rules decide; where those don't show both
    verdicts, everything else is allowed.  Null URLs and URLs without :// have
    empty host and path, which no rule fits unless it says so.  Input columns
    called like an added one are replaced.  Empty input, empty result.
    """
    added = ("host", "path", "rule", "verdict")
    cols = [c for c in pages.columns if c.lower() not in added]
    ruled, feats, said = (own_name([*cols, *added], c) for c in ("_ruled", "_features", "_said"))
    url = F.col(url_col)
    rows = pages.select(*cols, url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn(ruled, rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where(F.col(ruled).isNotNull()).select("host", "path", F.col(f"{ruled}.verdict").alias("verdict"))
    model = train(labelled)
    rows = rows.withColumn("rule", F.col(f"{ruled}.rule"))
    if model is None:
        guess = F.lit("allow")
    else:
        model = model.setFeaturesCol(feats).setPredictionCol(said).setProbabilityCol("").setRawPredictionCol("")
        rows = model.transform(_features(rows, "host", "path", feats))
        guess = F.when(F.col(said) == 1.0, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce(F.col(f"{ruled}.verdict"), guess)).select(*cols, *added)
