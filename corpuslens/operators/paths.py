"""Corpus filters over relative paths, ignore rules, directory roll-up and line slicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import normalize_eol, split_lines
from corpuslens.operators import sequence


def path_segments(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.split(p, "/")


def path_name(path) -> Column:
    return F.element_at(path_segments(path), -1)


def path_dir(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def path_suffix(path) -> Column:
    """Suffix of the file name from its last dot; '' for dot-files, names ending in a dot, or no dot."""
    name = path_name(path)
    k = F.instr(F.reverse(name), ".")
    pos = F.length(name) - k + 1
    return F.when((k > 0) & (pos > 1) & (pos < F.length(name)), F.substr(name, pos, F.length(name))).otherwise(F.lit(""))


def prune_dirs(files: DataFrame, names: Sequence[str] = rules.IGNORED_DIRS) -> DataFrame:
    """B1: drop files under any directory whose lower-case name is listed or starts with '.'.

    One anchored regex over the path: a directory segment is text between
    slashes that is followed by '/'.  Stays in generated code (no lambda).
    """
    import re as _re
    alts = "|".join(_re.escape(n) for n in sorted(set(names), key=len, reverse=True))
    bad = F.col("path").rlike(r"(?:^|/)(?:\.[^/]*|(?iu:" + alts + r"))/")
    return files.where(~bad)


def filter_ext(files: DataFrame, exts: Sequence[str] = rules.SOURCE_EXTENSIONS) -> DataFrame:
    """B2: case-sensitive suffix test on the path."""
    cond = F.lit(False)
    for e in exts:
        cond = cond | F.col("path").endswith(e)
    return files.where(cond)


def skip_boilerplate(files: DataFrame, terms: Sequence[str] = rules.BOILERPLATE_TERMS) -> DataFrame:
    """Drop files whose lower-case file name contains any term (substring)."""
    name = F.lower(path_name("path"))
    bad = F.lit(False)
    for t in terms:
        bad = bad | name.contains(t)
    return files.where(~bad)


def size_cap(files: DataFrame, max_bytes: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """Keep files of at most max_bytes UTF-8 bytes (uses size_bytes when present)."""
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    return files.where(size <= max_bytes)


#: A class ([..], [!..]; a ']' that stands first belongs to it) or any one character.
_GLOB_TOKEN = r"(?s)(\[!?\]?[^\]]*\]|.)"
#: A range or any one character of a class.
_CLASS_ITEM = r"(?s)(.-.|.)"


def glob_regex_col(glob: Column) -> Column:
    """fnmatch-style glob -> Java regex body: '*' crosses '/', '?' one character, [..] and [!..] classes.

    A bracket that isn't closed is a plain character; a range that runs backwards is empty, so every glob yields a
    valid regex.
    """
    def quoted(text):
        return F.regexp_replace(text, r"([^\p{Alnum}])", r"\\$1")

    def item(it):
        return F.when(F.length(it) == 3, F.concat(quoted(F.left(it, F.lit(1))), F.lit("-"), quoted(F.right(it, F.lit(1))))) \
            .otherwise(quoted(it))

    def char_class(token):
        negated = token.startswith("[!")
        body = F.substr(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
        kept = F.filter(F.regexp_extract_all(body, F.lit(_CLASS_ITEM), 1),
                        lambda it: (F.length(it) < 3) | (F.left(it, F.lit(1)) <= F.right(it, F.lit(1))))
        inner = F.array_join(F.transform(kept, item), "")
        return F.when((inner == "") & negated, F.lit(".")).when(inner == "", F.lit("(?!)")) \
            .otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), inner, F.lit("]")))

    def piece(token):
        return (F.when(token == "*", F.lit(".*")).when(token == "?", F.lit("."))
                .when(F.length(token) > 1, char_class(token)).otherwise(quoted(token)))

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_GLOB_TOKEN), 1), piece), "")


def gitignore_patterns(lines: Sequence[str], builtins: Sequence[str] = rules.GITIGNORE_BUILTINS) -> list[str]:
    """.gitignore lines (stripped, blank and '#' dropped) plus the built-in rules."""
    kept = [ln.strip() for ln in lines if ln.strip() and not ln.strip().startswith("#")]
    return kept + list(builtins)


def _ignored(segs: Column, rx_path: Column, rx_seg: Column) -> Column:
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, 1, i), "/"))

    def any_match(arr: Column, rx: Column) -> Column:
        return F.coalesce(F.exists(arr, lambda s: F.regexp_like(s, rx)), F.lit(False))

    return any_match(prefixes, rx_path) | any_match(segs, rx_seg)


def _any_of(regexes: Column) -> Column:
    """One regex that matches a whole text when any of the array does; null for none."""
    return F.when(F.size(regexes) > 0, F.concat(F.lit("(?s)^(?:"), F.array_join(regexes, "|"), F.lit(")$")))


def apply_ignore_rules(files: DataFrame, patterns: Sequence[str] = rules.GITIGNORE_BUILTINS,
                       repo_rules: DataFrame | None = None) -> DataFrame:
    """Drop files matched by an ignore rule at the file or at any ancestor directory.

    A rule ending in '/' tests every path segment; other rules test each path
    prefix (ancestor directories and the file itself), hence also its last
    segment, and every segment.  `patterns` apply to every repo and fold into
    two constant regexes; the rules of `repo_rules` (repo, pattern) fold the
    same way per repo and are attached with a left join on repo.  The test is
    per row: no rule x file pairs.
    """
    segs = path_segments("path")
    fixed_path = _any_of(F.array(*[glob_regex_col(F.lit(p)) for p in patterns if not p.endswith("/")]))
    fixed_seg = _any_of(F.array(*[glob_regex_col(F.lit(p.rstrip("/"))) for p in patterns]))
    bad = _ignored(segs, fixed_path, fixed_seg)
    if repo_rules is None:
        return files.where(~bad)
    glob = glob_regex_col(F.regexp_replace("pattern", "/+$", ""))
    per_repo = (repo_rules.where(F.col("pattern").isNotNull()).select("repo", F.col("pattern").endswith("/").alias("dirs"), glob.alias("rx"))
                .groupBy("repo").agg(_any_of(F.collect_set(F.when(~F.col("dirs"), F.col("rx")))).alias("_rx_path"),
                                     _any_of(F.collect_set("rx")).alias("_rx_seg")))
    out = files.join(per_repo, "repo", "left")
    return out.where(~(bad | _ignored(segs, F.col("_rx_path"), F.col("_rx_seg")))).drop("_rx_path", "_rx_seg")


def dir_rollup(files: DataFrame, exts: Sequence[str] = rules.TREE_EXTENSIONS) -> DataFrame:
    """(repo, dir, n_files, n_bytes) for every directory holding a kept file at any depth.

    Directories without a matching descendant never appear (they have no row to explode).
    """
    kept = files.where(path_suffix("path").isin(*exts))
    segs = path_segments("path")
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    dirs = F.transform(F.sequence(F.lit(0), F.size(segs) - 1),
                       lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(segs, 1, i), "/")))
    return (kept.select("repo", F.explode(dirs).alias("dir"), size.alias("b"))
            .groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").cast("long").alias("n_bytes")))


def tree_listing(files: DataFrame, exts: Sequence[str] = rules.TREE_EXTENSIONS) -> DataFrame:
    """(repo, pos, path, depth, is_dir, n_files, n_bytes): kept files and the directories above them, in tree order.

    Below each directory come its directories, then its files, each by lower
    name (equal ones by name); `pos` counts a repo's entries from 1.  An
    entry's sort key says per path segment whether it's a file, and its names,
    so a directory sorts right before what it holds; ranges of (repo, key) are
    numbered by `sequence.running_count`, and one huge repo spans many tasks.
    Repeated rows of a path are one entry with their count.
    """
    kept = files.where(path_suffix("path").isin(*exts))
    segs = path_segments("path")
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    up_to = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.struct(
        F.array_join(F.slice(segs, 1, i), "/").alias("path"), i.alias("depth"), (i < F.size(segs)).alias("is_dir")))
    entries = (kept.select("repo", F.explode(up_to).alias("e"), size.alias("b")).groupBy("repo", "e")
               .agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").cast("long").alias("n_bytes"))
               .select("repo", "e.path", "e.depth", "e.is_dir", "n_files", "n_bytes"))
    key = F.transform(segs, lambda s, i: F.struct((~F.col("is_dir") & (i == F.col("depth") - 1)).alias("is_file"),
                                                  F.lower(s).alias("low"), s.alias("name")))
    keyed = entries.withColumn("_key", key).withColumn("_one", F.lit(True))
    return (sequence.running_count(keyed, "repo", ["_key"], "_one", "pos")
            .select("repo", "pos", "path", "depth", "is_dir", "n_files", "n_bytes"))


#: Lines of one block of a file's line index.
SLICE_BLOCK = 256


def line_blocks(files: DataFrame, block: int = SLICE_BLOCK) -> DataFrame:
    """(repo, path, block, lines): every file split once, into blocks of lines with their breaks; LF, CRLF and CR end a line."""
    lines = F.regexp_extract_all(normalize_eol(F.col("content")), F.lit(r"[^\n]*\n|[^\n]+\z"), 0)
    split = files.where("content <> ''").select("repo", "path", lines.alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(lines) - 1) div {block} AS int)")),
                      lambda b: F.slice("lines", b * block + 1, F.lit(block)))
    return split.select("repo", "path", F.posexplode(cut).alias("block", "lines"))


def slice_lines(files: DataFrame, requests: DataFrame, block: int = SLICE_BLOCK) -> DataFrame:
    """C20: (request_id, repo, path, start_line, end_line) -> header + 1-based inclusive slice, clamped.

    Lines keep their line breaks (a readlines view, breaks as LF).  start > end
    after clamping is an error text.  A file's text is split once, however many
    requests it gets: a request meets just the blocks of lines that it asks
    for, and many requests for one block are spread by the skew join.  Paths
    are unique in a repo; repeated requests are answered one by one.
    """
    text = normalize_eol(F.col("content"))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = (breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("int")
    heads = files.select("repo", "path", n_lines.alias("_n"), F.col("content").isNotNull().alias("_found"))
    j = requests.select("request_id", "repo", "path", "start_line", "end_line").withColumn("_rid", F.monotonically_increasing_id())
    j = j.join(heads, ["repo", "path"], "left")
    n = F.col("_n")
    j = (j.withColumn("_s", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).cast("int"))
         .withColumn("_e", F.least(F.coalesce(F.col("end_line"), n), n).cast("int")))
    s, e = F.col("_s"), F.col("_e")
    status = F.when(F.coalesce("_found", F.lit(False)), F.when(s > e, F.lit("RANGE_ERROR")).otherwise(F.lit("OK"))).otherwise(F.lit("NOT_FOUND"))
    j = j.withColumn("status", status)
    keys = ["_rid", "request_id", "repo", "path", "status", "_s", "_e", "_n"]
    asked = j.where("status = 'OK'").select(*keys, F.explode(F.expr(f"cast(sequence((_s - 1) div {block}, (_e - 1) div {block}) AS array<int>)")).alias("block"))
    first = F.greatest(s - F.col("block") * block, F.lit(1))
    last = F.least(e - F.col("block") * block, F.lit(block))
    parts = asked.join(line_blocks(files, block), ["repo", "path", "block"]).select(
        *keys, F.struct("block", F.array_join(F.slice("lines", first, last - first + 1), "").alias("text")).alias("part"))
    body = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # of one request's lines
    told = [c.cast("string") for c in (s, e, n)]
    ok = F.concat(F.lit("=== File: "), path_name("path"), F.lit(" (Lines "), told[0], F.lit(" to "), told[1], F.lit(" of "), told[2], F.lit(") ===\n"),
                  F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    err = F.concat(F.lit("Error: start_line ("), told[0], F.lit(") cannot exceed end_line ("), told[1], F.lit("). Total lines: "), told[2], F.lit("."))
    columns = ["request_id", "repo", "path", "status", s.alias("start_line"), e.alias("end_line"), n.alias("total_lines")]
    return body.select(*columns, ok.alias("text")).unionByName(
        j.where("status <> 'OK'").select(*columns, F.when(F.col("status") == "RANGE_ERROR", err).alias("text")))


def explode_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line, text) with splitlines() numbering."""
    return (files.select("repo", "path", F.posexplode(split_lines(F.col("content"))).alias("i", "text"))
            .select("repo", "path", (F.col("i") + 1).cast("int").alias("line"), "text"))
