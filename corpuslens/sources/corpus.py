"""Corpus sources: a directory tree of source files, or a table already holding text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_eol
from corpuslens.sources import tree


def scan_corpus(spark: SparkSession, root: str, exts: Sequence[str] | None = None, repo: str | None = None,
                max_bytes: int | None = None, with_content: bool = True, repo_per_subdir: bool = False,
                skip_dirs: Sequence[str] = ()) -> DataFrame:
    """A1: recursive scan -> files(repo, path, content, size_bytes).

    Every file counts, whatever its name or its folders' names; directories
    named in `skip_dirs` aren't entered.  Extensions and the size limit are
    tested on the listing, so no other file's bytes are read; without content
    none are.  Text is read like a text file: UTF-8, invalid bytes dropped (in a file that has some, U+FFFD goes
    with them), CRLF and CR become LF.  size_bytes is the raw size.  Paths are
    relative to `root`, whatever the scheme either is written with; a root that
    is a file gives its name; below a glob paths stay whole.
    """
    files = tree.list_tree(spark, root, skip_dirs)
    if exts:
        files = files.where(reduce(lambda a, b: a | b, [F.col("path").endswith(e) for e in exts]))
    if max_bytes is not None:
        files = files.where(F.col("size_bytes") <= max_bytes)
    if with_content:
        files = tree.read_files(files, root)
    rel = F.concat("base", F.lit("/"), "path") if any(c in root for c in "*?[{") and not _exists(spark, root) else F.col("path")
    if repo_per_subdir:
        repo_col = F.element_at(F.split(rel, "/"), 1)
        rel = F.regexp_replace(rel, r"^[^/]*/", "")
    else:
        repo_col = F.lit(repo or root.rstrip("/").split("/")[-1])
    cols = [repo_col.alias("repo"), rel.alias("path"), "size_bytes"]
    if with_content:
        raw = F.col("content").cast("string")
        valid = F.replace(F.make_valid_utf8(raw), F.lit(chr(0xFFFD)), F.lit(""))
        cols.append(normalize_eol(F.when(F.is_valid_utf8(raw), raw).otherwise(valid)).alias("content"))
    return files.select(*cols)


def _exists(spark: SparkSession, root: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
