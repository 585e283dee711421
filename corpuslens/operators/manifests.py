"""Dependency manifests: line inventory and constraint spread across repos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import py_strip, split_lines


def manifest_lines(files: DataFrame, names=("requirements.txt",)) -> DataFrame:
    """A6 + line split: manifests at the repo root only -> (repo, manifest, line_no, raw)."""
    m = files.where(F.col("path").isin(*names))
    return (m.select("repo", F.col("path").alias("manifest"), F.posexplode(split_lines(F.col("content"))).alias("i", "raw"))
            .select("repo", "manifest", (F.col("i") + 1).cast("int").alias("line_no"), "raw"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Skip blank, '#' and '-' lines; first specifier parsed, anything else kept raw as unparsed."""
    s = py_strip(F.col("raw"))
    pat = "(?U)" + rules.MANIFEST_LINE_PATTERN  # Unicode \\s, as on Python strings
    kept = lines.withColumn("raw", s).where((F.col("raw") != "") & ~F.col("raw").startswith("#") &
                                           ~F.col("raw").startswith("-"))
    parsed = F.col("raw").rlike(pat)
    return kept.select(
        "repo", "manifest", "line_no",
        F.when(parsed, F.regexp_extract("raw", pat, 1)).alias("package"),
        F.when(parsed, F.regexp_extract("raw", pat, 2)).alias("op"),
        F.when(parsed, F.regexp_extract("raw", pat, 3)).alias("version"),
        parsed.alias("parsed"), "raw")


def constraint_drift(deps: DataFrame) -> DataFrame:
    """Per package the distinct constraints across repos; drift when more than one."""
    c = F.concat(F.col("op"), F.col("version"))
    return (deps.where("parsed")
            .groupBy("package")
            .agg(F.count_distinct("repo").alias("n_repos"),
                 F.count_distinct(c).alias("n_constraints"),
                 F.array_sort(F.collect_set(c)).alias("constraints"))
            .withColumn("drift", F.col("n_constraints") > 1))
