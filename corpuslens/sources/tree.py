"""Directory trees listed and read with every name in them.

Spark's own file index leaves out names that begin with `_` or `.`, so a scan
of source files can't use it.  Here directories are rows: each round lists the
directories found by the round before, spread over the cluster, and writes what
it finds; there are as many rounds as the tree is deep.  The files that pass a
filter on that listing are then read by tasks of about equal size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import shared_dir

#: Bytes of files that one task reads, and bytes of contents that it hands on at once.
TASK_BYTES, BATCH_BYTES = 1 << 27, 1 << 24

_LISTED = "base string, path string, size_bytes long, is_dir boolean"


def store_of(spark: SparkSession, root: str) -> tuple[str, str, list[str]]:
    """(scheme, authority, places) that a root stands for: itself, or what its glob matches; mount points are resolved."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(conf)
    if fs.exists(place):
        found = [place]
    else:
        found = [s.getPath() for s in fs.globStatus(place) or []]
    if not found:
        raise FileNotFoundError(root)
    uris = [fs.resolvePath(p).toUri() for p in found]
    stores = {(u.getScheme() or "file", u.getAuthority() or "") for u in uris}
    if len(stores) > 1:
        raise ValueError(f"{root} reaches over several stores: {sorted(stores)}")
    return *stores.pop(), [u.getPath() for u in uris]


def _opener(scheme: str, authority: str):
    """A function that opens the store inside a task: (file system, function that makes a path its own)."""
    def open_store():
        from pyarrow import fs
        if scheme == "file":
            return fs.LocalFileSystem(), lambda path: path
        store, top = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
        return store, lambda path: top.rstrip("/") + path
    return open_store


def list_tree(spark: SparkSession, root: str, skip_dirs: Sequence[str] = ()) -> DataFrame:
    """(base, path, size_bytes) of every file below `root`, whatever its name; path is relative to base.

    A root that is a file lists that file under its own name; a glob lists
    below each of its matches.  Directories named in `skip_dirs` aren't
    entered, nor are links to directories.  Only names and sizes are read.  A
    directory that can't be read fails the job.
    """
    scheme, authority, places = store_of(spark, root)
    open_store, skipped = _opener(scheme, authority), frozenset(skip_dirs)

    def listing(batches):
        import os
        from itertools import islice

        import pyarrow as pa
        from pyarrow import fs

        store, own = open_store()
        local = isinstance(store, fs.LocalFileSystem)

        def entries(at):
            """(name, type, size, whether a link) of a directory's entries; local ones one by one, as there may be millions."""
            if not local:
                for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                    yield info.base_name, info.type, info.size, False
                return
            try:
                found = os.scandir(at)
            except FileNotFoundError:
                return
            with found:
                for e in found:
                    try:
                        if e.is_dir():
                            yield e.name, fs.FileType.Directory, None, e.is_symlink()
                        elif e.is_file():
                            yield e.name, fs.FileType.File, e.stat().st_size, False
                    except FileNotFoundError:  # gone since
                        pass

        def below(base, path):
            at = own(base if not path else f"{base.rstrip('/')}/{path}")
            if not path:  # a root may be a file
                info = store.get_file_info(at)
                if info.type == fs.FileType.File:
                    parent, _, name = base.rstrip("/").rpartition("/")
                    yield parent or "/", name, info.size, False
                    return
            for base_name, kind, size, link in entries(at):
                name = f"{path}/{base_name}" if path else base_name
                if kind == fs.FileType.File:
                    yield base, name, size, False
                elif kind == fs.FileType.Directory and base_name not in skipped and not link:
                    yield base, name, 0, True

        names = ["base", "path", "size_bytes", "is_dir"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for b in batches:
            for base, path in zip(b.column("base").to_pylist(), b.column("path").to_pylist(), strict=True):
                found = below(base, path)
                while some := list(islice(found, 10_000)):
                    columns = zip(*some, strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    out = shared_dir(spark, f"listing-{uuid.uuid4().hex}")
    level = spark.createDataFrame([(p, "") for p in places], "base string, path string")
    rounds = []
    while True:
        rounds.append(f"{out}/depth={len(rounds)}")
        level.select("base", "path").repartition("base", "path").mapInArrow(listing, _LISTED).write.parquet(rounds[-1])
        level = spark.read.schema(_LISTED).parquet(rounds[-1]).where("is_dir")
        if level.isEmpty():
            break
    return spark.read.schema(_LISTED).parquet(*rounds).where("NOT is_dir").select("base", "path", "size_bytes")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """The listed files with their bytes in `content`; only these are opened, by tasks of about TASK_BYTES."""
    spark = files.sparkSession
    scheme, authority, _ = store_of(spark, root)
    open_store, batch_bytes = _opener(scheme, authority), BATCH_BYTES
    total, n = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    parts = max(total // TASK_BYTES + 1, min(n, spark.sparkContext.defaultParallelism), 1)

    def reading(batches):
        import pyarrow as pa

        store, own = open_store()

        def packed(rows):
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)],
                                   ["base", "path", "size_bytes", "content"])

        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_stream(own(f"{r['base'].rstrip('/')}/{r['path']}"), compression=None) as f:
                    data = f.read()
                rows.append((r["base"], r["path"], r["size_bytes"], data))
                held += len(data)
                if held >= batch_bytes or len(rows) >= 10_000:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return files.select("base", "path", "size_bytes").repartition(parts, "base", "path").mapInArrow(
        reading, "base string, path string, size_bytes long, content binary")


def write_files(files: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> int:
    """Write each row's text as the file `root`/path, replacing what stands there; returns how many were written.

    Paths must stay below root (see `patching.escapes_base`); an absolute or
    climbing one fails the job before any file is written.  Rows with a null
    path or text are left out.  A repeated task writes the same files again.
    """
    from corpuslens.operators.patching import escapes_base

    spark = files.sparkSession
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).where("path IS NOT NULL AND content IS NOT NULL")
    if not rows.where(escapes_base(F.col("path")) | (F.col("path") == "")).isEmpty():
        raise ValueError("a path leaves the folder to write to")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    scheme, authority, (base,) = store_of(spark, root)
    open_store = _opener(scheme, authority)

    def writing(batches):
        import pyarrow as pa

        store, own = open_store()
        made = set()
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = own(f"{base.rstrip('/')}/{path}")
                folder = at.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(at, compression=None) as f:
                    f.write(data)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(writing, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
