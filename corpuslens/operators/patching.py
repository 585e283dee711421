"""Bulk search/replace patch application as one Spark job.

Patch texts are parsed into chunk rows with regex generators; all chunks on a
file are folded over its text in order with `aggregate`, each step working on
the result of the previous one.  No Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import ellipsize, fuzzy_pattern, let, normalize_eol, py_strip, splice

FILE_HEADER_RE = r"(?mU)^FILE:\s*([^\n\r]+)"
FILE_SPLIT_RE = r"(?mU)^FILE:\s*[^\n\r]+"
CHUNK_RE = r"(?s)<<<<<<< SEARCH[\r\n]+(.*?)[\r\n]+=======[\r\n]+(.*?)[\r\n]+>>>>>>> REPLACE"

OK, NO_CHUNKS, NO_TARGET, TRAVERSAL, NOT_FOUND, SEARCH_MISS, ABORTED = (
    "APPLIED", "NO_CHUNKS", "NO_TARGET", "PATH_TRAVERSAL", "FILE_NOT_FOUND", "SEARCH_NOT_FOUND", "ABORTED")


def _sections(t: Column) -> Column:
    """Array of (name, body): the text behind each file header, or the whole text under no name."""
    names = F.regexp_extract_all(t, F.lit(FILE_HEADER_RE), 1)
    bodies = F.split(t, FILE_SPLIT_RE, -1)
    return F.when(F.size(names) == 0, F.array(F.struct(F.lit("").alias("name"), t.alias("body")))) \
            .otherwise(F.arrays_zip(F.transform(names, py_strip).alias("name"),
                                    F.slice(bodies, 2, F.size(bodies)).alias("body")))


def patches_without_chunks(patch_texts: DataFrame) -> DataFrame:
    """The patches (all columns but text) that hold no chunk at all, with status NO_CHUNKS."""
    keys = [c for c in patch_texts.columns if c != "text"]
    some = F.exists(_sections(F.coalesce("text", F.lit(""))), lambda s: s["body"].rlike(CHUNK_RE))
    return patch_texts.where(~some).select(*keys, F.lit(NO_CHUNKS).alias("status"))


def parse_patch(patch_texts: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(…, patch_id, text) -> (…, patch_id, file_ord, path, chunk_ord, search, replace, parse_warning).

    Sections start at line-initial 'FILE:'; text before the first header is
    ignored.  Without any header the whole text is one nameless section
    (path '').  Sections without chunks vanish.  With `keep_empty`, a patch
    without any chunk leaves one row with a null chunk_ord, which
    `apply_patches` answers with NO_CHUNKS.
    """
    keys = [c for c in patch_texts.columns if c != "text"]
    if keep_empty:
        null = F.lit(None)
        none = patches_without_chunks(patch_texts).select(
            *keys, F.lit(-1).alias("file_ord"), null.cast("string").alias("path"), null.cast("int").alias("chunk_ord"), null.cast("string").alias("search"),
            null.cast("string").alias("replace"), F.lit(False).alias("parse_warning"))
        return parse_patch(patch_texts).unionByName(none)
    sec = patch_texts.select(*keys, F.posexplode(_sections(F.col("text"))).alias("file_ord", "s"))
    chunks = F.arrays_zip(F.regexp_extract_all(F.col("s.body"), F.lit(CHUNK_RE), 1).alias("search"),
                          F.regexp_extract_all(F.col("s.body"), F.lit(CHUNK_RE), 2).alias("replace"))
    out = sec.select(*keys, F.col("file_ord").cast("int").alias("file_ord"), F.col("s.name").alias("path"),
                     F.posexplode(chunks).alias("chunk_ord", "c"))
    return out.select(*keys, "file_ord", "path", F.col("chunk_ord").cast("int").alias("chunk_ord"),
                      F.col("c.search").alias("search"), F.col("c.replace").alias("replace"),
                      F.col("c.replace").contains(">>>>>>> REPLACE").alias("parse_warning"))


def escapes_base(path: Column) -> Column:
    """True when a relative path is absolute or climbs above its base after '.'/'..' normalisation."""
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(segs, F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
                        lambda acc, s: F.struct(
                            (acc["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"),
                            (acc["out"] | ((s == "..") & (acc["d"] <= 0))).alias("out")))
    return path.startswith("/") | depth["out"]


def normalised_path(path: Column) -> Column:
    """Path without empty and '.' segments, '..' taken together with the segment before it."""
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.array_join(F.aggregate(segs, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))), "/")


def _state(text: Column, status: Column, applied: Column, fuzzy: Column, failed: Column) -> Column:
    return F.struct(text.alias("text"), status.alias("status"), applied.cast("int").alias("applied"),
                    fuzzy.cast("boolean").alias("fuzzy"), failed.cast("string").alias("failed_search"))


def _fold(text: Column, chunks: Column) -> Column:
    """Apply chunks in order: exact literal match first, else whitespace-tolerant regex.

    Values used more than once are bound with `let`, and the fuzzy pattern is
    only built inside the branch where the exact match missed.
    """
    init = _state(normalize_eol(text), F.lit(OK), F.lit(0), F.lit(False), F.lit(None))

    def step(acc, ch):
        cur = acc["text"]

        def on_search(s, r):
            def fuzzy(pat):
                # The leftmost match is also the first place where its text occurs; `position` counts characters.
                return let(F.regexp_substr(cur, pat), lambda m: F.when(
                    m.isNotNull(), _state(splice(cur, F.position(m, cur), F.length(m), r), F.lit(OK),
                                          acc["applied"] + 1, F.lit(True), acc["failed_search"]))
                    .otherwise(_state(cur, F.lit(SEARCH_MISS), acc["applied"], acc["fuzzy"], ch["search"])))

            return let(F.position(s, cur), lambda pos: F.when(
                pos > 0, _state(splice(cur, pos, F.length(s), r), F.lit(OK), acc["applied"] + 1,
                                acc["fuzzy"], acc["failed_search"]))
                .otherwise(let(fuzzy_pattern(s), fuzzy)))

        live = let(normalize_eol(ch["search"]), lambda s: let(normalize_eol(ch["replace"]), lambda r: on_search(s, r)))
        return F.when(acc["status"] != OK, acc).otherwise(live)

    return F.aggregate(chunks, init, step)


def _streamed(files: DataFrame, sections: DataFrame, strict: bool) -> DataFrame:
    """Outcomes of sections (repo, patch_id, target, file_ord, chunks) with each file held once; see `patch_stream`."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from corpuslens.operators import patch_stream

    one_file = ["repo", "target", "patch_id"] if strict else ["repo", "target"]
    status = F.when(F.col("target").isNull(), F.lit(NO_TARGET)).when(escapes_base(F.col("target")), F.lit(TRAVERSAL))
    rows = sections.select(*one_file, *[c for c in ("patch_id",) if c not in one_file], "file_ord", "chunks", status.alias("status"), F.lit(True).alias("is_section"),
                           F.lit(None).cast("string").alias("content"))
    named = files.select("repo", F.col("path").alias("target"), "content")
    held = sections.where(F.col("target").isNotNull() & ~escapes_base(F.col("target"))).select(*one_file).distinct().join(named, ["repo", "target"])
    rows = rows.unionByName(held.withColumn("is_section", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition(*one_file).sortWithinPartitions(*one_file, "is_section", "patch_id", "file_ord")
    id_type = sections.schema["patch_id"].dataType
    shape = pa.schema([("repo", pa.string()), ("path", pa.string()), ("_was", pa.string()), ("patch_id", to_arrow_type(id_type)), ("file_ord", pa.int32()),
                       ("status", pa.string()), ("chunks_applied", pa.int32()), ("match_kind", pa.string()), ("new_content", pa.string()), ("error", pa.string())])
    return rows.mapInArrow(patch_stream.sections_applied(shape, strict, OK, NOT_FOUND, SEARCH_MISS),
                           f"repo string, path string, _was string, patch_id {id_type.simpleString()}, file_ord int, status string, chunks_applied int, "
                           "match_kind string, new_content string, error string")


def apply_patches(files: DataFrame, patches: DataFrame, default_file: str | None = None,
                  strict: bool = False, hot_files: bool = False) -> DataFrame:
    """Apply parsed chunks to files.

    files: (repo, path, content); patches: (repo, patch_id, file_ord, path, chunk_ord, search, replace).
    Output: one row per section: repo, patch_id, file_ord, path, status, chunks_applied, match_kind, new_content, error.
    All sections on one file work on one another's results, in (patch_id, file_ord) order; a section that fails
    changes nothing.  new_content is the file behind the section (for a failed one, as the sections before left it);
    match_kind says of an applied section whether every search text was found as it stands (EXACT) or some only
    with other whitespace (FUZZY).  Paths are normalised before they are looked up.  A failure is a status, never an
    exception; with `strict`, any failure in a patch marks its other sections ABORTED (no chunk applied, the original
    content), and since a patch may be taken back as a whole, each patch works on the original files.

    A file's sections normally meet in its row, which suits files with a few.  With `hot_files` they stream past
    the file's text instead, with the same result: for inputs where a file may get thousands.  A patch without
    chunks (see `parse_patch`) gives one row with file_ord -1 and NO_CHUNKS.
    """
    empty = patches.where(F.col("chunk_ord").isNull())
    patches = patches.where(F.col("chunk_ord").isNotNull())
    one_file = ["repo", "patch_id", "target"] if strict else ["repo", "target"]
    raw = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit(default_file))
    target = F.when(escapes_base(raw), raw).otherwise(normalised_path(raw))
    sections = (patches.withColumn("target", target)
                .groupBy("repo", "patch_id", "target", "file_ord")
                .agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "search", "replace"))).alias("chunks")))
    out = _streamed(files, sections, strict) if hot_files else _gathered(files, sections, one_file)
    if strict:
        w = Window.partitionBy("repo", "patch_id")
        out = out.withColumn("_bad", F.max((F.col("status") != OK).cast("int")).over(w) > 0)
        out = (out.withColumn("new_content", F.when(F.col("_bad"), F.col("_was")).otherwise(F.col("new_content")))
               .withColumn("chunks_applied", F.when(F.col("_bad"), F.lit(0)).otherwise(F.col("chunks_applied")))
               .withColumn("match_kind", F.when(~F.col("_bad"), F.col("match_kind")))
               .withColumn("status", F.when(F.col("_bad") & (F.col("status") == OK), F.lit(ABORTED)).otherwise(F.col("status"))))
    columns = ["repo", "patch_id", "file_ord", "path", "status", "chunks_applied", "match_kind", "new_content", "error"]
    null = F.lit(None).cast("string")
    none = empty.select("repo", "patch_id", "file_ord", null.alias("path"), F.lit(NO_CHUNKS).alias("status"), F.lit(0).alias("chunks_applied"),
                        *[null.alias(c) for c in columns[6:]])
    return out.select(*columns).unionByName(none)


def _gathered(files: DataFrame, sections: DataFrame, one_file: list[str]) -> DataFrame:
    """Outcomes of sections, those on one file folded in its row."""
    id_type = sections.schema["patch_id"].dataType.simpleString()
    sections = sections.groupBy(*one_file).agg(F.array_sort(F.collect_list(F.struct("patch_id", "file_ord", "chunks"))).alias("sections"))
    joined = sections.join(files.select("repo", F.col("path").alias("target"), "content"), ["repo", "target"], "left")

    def outcome(sec, st, text, applied, fuzzy, failed):
        err = F.concat(F.lit("Search block not found: "), ellipsize(failed, 100))
        kind = F.when((st == OK) & fuzzy, F.lit("FUZZY")).when(st == OK, F.lit("EXACT"))
        return F.struct(sec["patch_id"].alias("patch_id"), sec["file_ord"].alias("file_ord"), st.alias("status"),
                        applied.cast("int").alias("chunks_applied"), kind.alias("match_kind"), text.alias("new_content"), F.when(st == SEARCH_MISS, err).cast("string").alias("error"))

    def step(acc, sec):
        def after(f):
            text = F.when(f["status"] == OK, f["text"]).otherwise(acc["text"])
            return F.struct(text.alias("text"), F.concat(acc["rows"], F.array(
                outcome(sec, f["status"], text, f["applied"], f["fuzzy"], f["failed_search"]))).alias("rows"))
        return let(_fold(acc["text"], sec["chunks"]), after)

    content = F.col("content")
    rows = (f"array<struct<patch_id:{id_type},file_ord:int,status:string,chunks_applied:int,match_kind:string,"
            "new_content:string,error:string>>")
    folded = F.aggregate("sections", F.struct(content.alias("text"), F.array().cast(rows).alias("rows")), step)["rows"]
    status = (F.when(F.col("target").isNull(), F.lit(NO_TARGET)).when(escapes_base(F.col("target")), F.lit(TRAVERSAL))
              .otherwise(F.lit(NOT_FOUND)))
    none = F.transform("sections", lambda s: outcome(s, status, content, F.lit(0), F.lit(False), F.lit(None).cast("string")))
    usable = content.isNotNull() & F.col("target").isNotNull() & ~escapes_base(F.col("target"))
    return joined.select("repo", F.col("target").alias("path"), content.alias("_was"),
                         F.inline(F.when(usable, folded).otherwise(none)))


def patched_files(files: DataFrame, applied: DataFrame) -> DataFrame:
    """New corpus version: applied files replaced, every other file kept."""
    # The last applied section holds the edits of all applied sections before it.
    w = Window.partitionBy("repo", "path").orderBy(F.col("patch_id").desc(), F.col("file_ord").desc())
    upd = (applied.where(F.col("status") == OK)
           .withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
           .select("repo", "path", F.col("new_content").alias("_new")))
    return (files.join(upd, ["repo", "path"], "left")
            .withColumn("content", F.coalesce(F.col("_new"), F.col("content"))).drop("_new"))


def restore_snapshot(current: DataFrame, snapshot: DataFrame,
                     protected=rules.PROTECTED_ENTRIES) -> DataFrame:
    """Protected top-level entries come from `current`, everything else from `snapshot`."""
    top = F.element_at(F.split(F.col("path"), "/"), 1)
    prot = top.isin(*protected)
    return current.where(prot).unionByName(snapshot.where(~prot & (top != ".git")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, change) with change in added / removed / modified / unchanged; equal SHA-256 digests are equal texts."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    b = before.select("repo", "path", digest.alias("h0"))
    a = after.select("repo", "path", digest.alias("h1"))
    j = b.join(a, ["repo", "path"], "full")
    change = (F.when(F.col("h0").isNull(), F.lit("added"))
              .when(F.col("h1").isNull(), F.lit("removed"))
              .when(F.col("h0") != F.col("h1"), F.lit("modified"))
              .otherwise(F.lit("unchanged")))
    return j.select("repo", "path", change.alias("change"))


def modified_union(applied: DataFrame, run_col: str = "repo") -> DataFrame:
    """O3: (run, path) for every file any attempt of the run modified; attempts rolled back later still count.

    Kept as distinct rows rather than one array per run, so a run that touches
    a huge number of files never becomes a single row.
    """
    return applied.where(F.col("status") == OK).select(run_col, "path").distinct()
