"""Table sinks: remediated files, findings and reports, written to shared storage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.session import kept

#: Bytes of contents that one writer task of an export takes, and parts that a run may be cut into.
EXPORT_BYTES, EXPORT_PARTS = 1 << 28, 4096
#: Buckets of a findings table that is updated in place; a scan rewrites those of the repos it touches.
BUCKETS = 64
#: Epochs of a keyed table after which its latest rows are written as a whole.
MERGE_EVERY = 16
#: Statuses of an export, one row per asked run.
EXPORTED, NOTHING_MODIFIED, UNKNOWN_RUN = "EXPORTED", "NOTHING_MODIFIED", "UNKNOWN_RUN"
FINDINGS_SCHEMA = ("repo STRING, path STRING, ord INT, line INT, cwe STRING, vulnerability STRING, severity STRING, "
                   "code STRING, description STRING")


# ------------------------------------------------------------------ A7 --
def write_remediated(applied: DataFrame, path: str, run_col: str = "run_id", asked: DataFrame | None = None,
                     task_bytes: int = EXPORT_BYTES) -> DataFrame:
    """The files that patches modified, partitioned by run; returns one status row per run.

    A run is cut into parts of about `task_bytes`, so that one with a third of
    all files has many writers; the bytes of each (run, path slot) are summed
    first and their prefix sums are the cuts.  Of several rows with one run and
    path the last section's stands.

    asked: the runs to export (default: those of `applied`).  Status rows:
    (run, status, files, bytes) with EXPORTED, NOTHING_MODIFIED (the run has no
    applied section) or UNKNOWN_RUN (`applied` has no row of it).
    """
    known = applied.select(run_col).distinct()
    wanted = known if asked is None else asked.select(run_col).distinct()
    rows = applied.where(F.col("status") == "APPLIED")
    if asked is not None:
        rows = _semi(rows, wanted, run_col)
    order = F.struct(*[F.col(c) for c in ("repo", "patch_id", "file_ord") if c in applied.columns], F.lit(0))
    out = rows.groupBy(run_col, "path").agg(F.max_by("new_content", order).alias("content"))
    out = kept(out.withColumn("_slot", F.pmod(F.xxhash64("path"), F.lit(EXPORT_PARTS)).cast("int"))
                .withColumn("_bytes", F.octet_length("content").cast("long")), "export")
    # At most EXPORT_PARTS slots a run, whatever it holds.
    slots = out.groupBy(run_col, "_slot").agg(F.sum("_bytes").alias("_b"))
    before = F.expr(f"sum(_b) OVER (PARTITION BY `{run_col}` ORDER BY _slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    cuts = slots.select(F.col(run_col).alias("_run"), F.col("_slot").alias("_s"), F.floor(F.coalesce(before, F.lit(0)) / task_bytes).alias("_part"))
    placed = out.join(cuts, F.col(run_col).eqNullSafe(F.col("_run")) & (F.col("_slot") == F.col("_s")))
    (placed.repartition(run_col, "_part").select(run_col, "path", "content")
     .write.mode("overwrite").partitionBy(run_col).parquet(path))
    done = out.groupBy(run_col).agg(F.count("*").alias("files"), F.sum("_bytes").alias("bytes"))
    done, known = done.withColumnRenamed(run_col, "_run"), known.select(F.col(run_col).alias("_known"), F.lit(True).alias("_seen"))
    zero = F.lit(0).cast("long")
    status = (F.when(F.col("files") > 0, EXPORTED).when(F.col("_seen"), NOTHING_MODIFIED).otherwise(UNKNOWN_RUN))
    return (wanted.join(done, F.col(run_col).eqNullSafe(F.col("_run")), "left").join(known, F.col(run_col).eqNullSafe(F.col("_known")), "left")
            .select(run_col, status.alias("status"), F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes")))


def _semi(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    return rows.join(wanted.select(F.col(col).alias("_wanted")), F.col(col).eqNullSafe(F.col("_wanted")), "left_semi")


# ------------------------------------------------------------------ A8 --
def write_findings(findings: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """Findings as parquet range-partitioned and sorted by (repo, path).

    Repos are too many for a directory each; range partitioning gives every
    file a narrow repo interval, so parquet min/max statistics let a
    `repo = ...` read skip all other files.  The range bounds are sampled from
    the written findings, so the sources are parsed once.
    """
    n = files or findings.sparkSession.sparkContext.defaultParallelism
    (kept(findings, "findings").repartitionByRange(n, "repo", "path").sortWithinPartitions("repo", "path")
     .write.mode(mode).parquet(path))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, folder: str = "heads/version") -> list[int]:
    """Committed versions: those whose folder was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def _heads(spark: SparkSession, path: str) -> dict[int, int]:
    """Bucket -> version that holds it, of the last commit; at most as many as there are buckets."""
    versions = _versions(spark, path)
    if not versions:
        return {}
    rows = spark.read.schema("bucket INT, held INT").parquet(f"{path}/heads/version={versions[-1]}").collect()
    return {r.bucket: r.held for r in rows}


def read_findings(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The findings table as the last committed scan left it; `only` some buckets."""
    heads = {b: v for b, v in _heads(spark, path).items() if only is None or b in only}
    if not heads:
        return spark.createDataFrame([], FINDINGS_SCHEMA)
    kept = F.lit(False)
    for v in sorted(set(heads.values())):
        kept = kept | ((F.col("version") == v) & F.col("bucket").isin([b for b, w in heads.items() if w == v]))
    rows = spark.read.schema(f"{FINDINGS_SCHEMA}, version INT, bucket INT").parquet(f"{path}/data")
    return rows.where(kept).drop("version", "bucket")  # both are folders: other versions' files aren't read


def upsert_findings(findings: DataFrame, scanned: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> bool:
    """Replace the findings of the scanned files (repo, path), keep those of all others; False if `version` is in already.

    Only buckets of scanned repos are rewritten, into folders of this version;
    then one small file lists which version holds each bucket, which commits
    the scan.  A version repeated after its commit changes nothing; one that
    broke off before is written anew.  A scanned file without findings loses
    its old ones.  Null repos and paths are values like others.
    """
    spark = findings.sparkSession
    done = _versions(spark, path)
    if version in done:
        return False
    if done and version < done[-1]:
        raise ValueError(f"version {version} comes after {done[-1]}")
    heads = _heads(spark, path)
    scanned = kept(scanned.select("repo", "path").distinct(), "scanned")
    touched = {r.bucket for r in scanned.select(_bucket(buckets).alias("bucket")).distinct().collect()}
    gone = scanned.select(F.col("repo").alias("_repo"), F.col("path").alias("_path"))
    old = read_findings(spark, path, touched).join(
        gone, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("path").eqNullSafe(F.col("_path")), "left_anti")
    names = [c.split(" ")[0] for c in FINDINGS_SCHEMA.split(", ")]
    rows = old.unionByName(findings.select(*names)).withColumn("bucket", _bucket(buckets))
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "repo", "path", "ord")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}"))
    listed = {**heads, **dict.fromkeys(touched, version)}
    spark.createDataFrame(sorted(listed.items()), "bucket INT, held INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/version={version}")
    return True


# ------------------------------------------------------------------ G8 --
def write_report(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Report lines (repo, idx, text) as numbered parts in the order of (repo, idx); no report is ever one string.

    Parts are ranges, so a long report spreads over many; their numbers follow
    the order, and read one after another they are the reports.
    """
    n = parts or lines.sparkSession.sparkContext.defaultParallelism
    (kept(lines.select("repo", "idx", "text"), "report").repartitionByRange(n, "repo", "idx").sortWithinPartitions("repo", "idx")
     .withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path))


def read_report(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """(repo, idx, text, part) of all reports, or of one: only the parts that hold it are read."""
    rows = spark.read.schema("repo STRING, idx BIGINT, text STRING, part INT").parquet(path)
    return rows if repo is None else rows.where(F.col("repo") == repo)


def report_digests(lines: DataFrame) -> DataFrame:
    """(repo, n_findings, report_chars, report_md5) of report lines, streamed in order: a report of any length takes one line's memory."""
    def run(frames):
        import hashlib

        import pandas as pd

        repo, open_, n, chars, md5 = None, False, 0, 0, None
        out = []
        for f in frames:
            for r, text in zip(f["repo"], f["text"], strict=True):
                if not open_ or r != repo:
                    if open_:
                        out.append((repo, n, chars, md5.hexdigest()))
                    repo, open_, n, chars, md5 = r, True, -1, 0, hashlib.md5()
                n, chars = n + 1, chars + len(text)
                md5.update(text.encode())
            if out:
                yield pd.DataFrame(out, columns=["repo", "n_findings", "report_chars", "report_md5"])
                out = []
        if open_:
            yield pd.DataFrame([(repo, n, chars, md5.hexdigest())], columns=["repo", "n_findings", "report_chars", "report_md5"])

    told = lines.select("repo", "idx", "text").repartition("repo").sortWithinPartitions("repo", "idx").select("repo", "text")
    return told.mapInPandas(run, "repo string, n_findings long, report_chars long, report_md5 string")


# ------------------------------------------------------------------ S1 --
def _epochs(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[int], list[int]]:
    """The last whole table (none or one) older than `before`, and the changes after it that were written to their end."""
    whole = [e for e in _versions(spark, path, "whole/epoch") if before is None or e < before][-1:]
    return whole, [e for e in _versions(spark, path, "changes/epoch") if not whole or e > whole[0]]


def _latest(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], whole: list[int], changes: list[int]) -> DataFrame:
    cols = [f.name for f in schema.fields]
    parts = [spark.read.schema(schema).parquet(f"{path}/{kind}/epoch={e}").select(*cols, F.lit(e).alias("_epoch"))
             for kind, epochs in (("whole", whole), ("changes", changes)) for e in epochs]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, parts)
    values = [c for c in cols if c not in keys]
    last = F.max_by(F.struct(*values), "_epoch").alias("_v")
    return rows.groupBy(*keys).agg(last).select(*[c if c in keys else F.col(f"_v.{c}").alias(c) for c in cols])


def write_keyed(changed: DataFrame, path: str, keys: Sequence[str], epoch: int, merge_every: int = MERGE_EVERY) -> None:
    """The changed rows of one trigger (at most one a key), to be read back as the latest row of every key.

    A trigger writes nothing but its changes, into a folder of its epoch: one
    that runs again after a failure writes the same folder.  Every
    `merge_every` epochs the latest rows are written as a whole, so a read
    never opens more than that many folders.  Null keys are keys like others.
    """
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
    if (epoch + 1) % merge_every == 0:
        whole, changes = _epochs(spark, path, epoch)
        rows = _latest(spark, path, changed.schema, keys, whole, [e for e in changes if e <= epoch])
        rows.write.mode("overwrite").parquet(f"{path}/whole/epoch={epoch}")


def read_keyed(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The latest row of every key, as the last finished trigger left it; empty before the first."""
    return _latest(spark, path, schema, keys, *_epochs(spark, path))
