"""Risk scoring of files: keywords, high-entropy literals, imports, rank.

Per-file work stays inside the file's row (array higher-order functions over
its own lines and literals), so scoring a corpus is a narrow, shuffle-free
stage; only ranking and the import graph shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import let, line_of_first, shannon_entropy, split_lines
from corpuslens.session import kept


def _kw_array(keywords) -> Column:
    if isinstance(keywords, Column):
        return keywords
    return F.array(*[F.lit(k) for k in keywords])


def keyword_score_col(content: Column, keywords) -> Column:
    """Sum over the keyword list (duplicates included) of non-overlapping case-insensitive counts.

    Each keyword costs one replace pass: (len - len(replace(text, kw, ''))) / len(kw).  For a fixed
    list the sum is a plain expression (whole-stage codegen, lower(text) shared by subexpression
    elimination); a per-row keyword array column falls back to `aggregate`, with the text lowered once.
    """
    if not isinstance(keywords, Column):
        low = F.lower(content)
        n = F.length(low)
        terms = [((n - F.length(F.replace(low, F.lit(k.lower()), F.lit("")))) / len(k)).cast("long")
                 for k in keywords]
        total = F.lit(0).cast("long")
        for t in terms:
            total = total + t
        return total
    kws = F.transform(keywords, lambda k: F.lower(k))

    def total_of(low):
        n = F.length(low)
        return F.aggregate(kws, F.lit(0).cast("long"),
                           lambda acc, kw: acc + ((n - F.length(F.replace(low, kw, F.lit("")))) / F.length(kw)).cast("long"))
    return let(F.lower(content), total_of)


def secret_literals_col(content: Column, threshold: float = rules.SECRET_ENTROPY_THRESHOLD,
                        placeholders: Sequence[str] = rules.SECRET_PLACEHOLDERS) -> Column:
    """Quoted literals above the entropy threshold that hold no placeholder word (duplicates kept)."""
    found = F.regexp_extract_all(content, F.lit(rules.SECRET_LITERAL_PATTERN), 1)
    ph = F.array(*[F.lit(p) for p in placeholders])

    def keep(lit):
        low = F.lower(lit)
        return (shannon_entropy(lit) > F.lit(threshold)) & ~F.exists(ph, lambda p: low.contains(p))

    return F.filter(found, keep)


def keyword_score(files: DataFrame, keywords=rules.RISK_KEYWORDS) -> DataFrame:
    """(repo, path, keyword_score). `keywords` is a fixed list or an array column already on `files`."""
    return files.select("repo", "path", keyword_score_col(F.col("content"), keywords).alias("keyword_score"))


def extract_secrets(files: DataFrame, threshold: float = rules.SECRET_ENTROPY_THRESHOLD) -> DataFrame:
    """One row per quoted high-entropy literal: (repo, path, ord, line, literal, entropy)."""
    found = F.regexp_extract_all(F.col("content"), F.lit(rules.SECRET_LITERAL_PATTERN), 1)
    ph = F.array(*[F.lit(p) for p in rules.SECRET_PLACEHOLDERS])
    exploded = files.select("repo", "path", "content", F.posexplode(found).alias("ord0", "literal"))
    return (exploded
            .withColumn("entropy", shannon_entropy(F.col("literal")))
            .where((F.col("entropy") > threshold) &
                   ~F.exists(ph, lambda p: F.lower(F.col("literal")).contains(p)))
            .select("repo", "path", (F.col("ord0") + 1).cast("int").alias("ord"),
                    line_of_first(F.col("content"), F.col("literal")).cast("int").alias("line"),
                    "literal", "entropy"))


def matched_lines_col(content: Column, keywords, secret_lits: Column) -> Column:
    """Sorted distinct 1-based lines holding any keyword (case-insensitive) or the first copy of a secret."""
    kws = F.transform(_kw_array(keywords), lambda k: F.lower(k))

    def kw_lines(low_lines):
        hits = F.transform(low_lines, lambda line, i: F.when(F.exists(kws, lambda k: line.contains(k)), i + 1))
        return F.filter(hits, lambda x: x.isNotNull())

    sec_lines = F.transform(secret_lits, lambda lit: line_of_first(content, lit))
    return F.array_sort(F.array_distinct(F.concat(let(split_lines(F.lower(content)), kw_lines), sec_lines)))


def score_files(files: DataFrame, keywords=rules.RISK_KEYWORDS,
                threshold: float = rules.SECRET_ENTROPY_THRESHOLD,
                with_lines: bool = True) -> DataFrame:
    """Pre-boost score per file, computed in-row.

    Output: repo, path, content, keyword_score, secret_count, score, matched_lines (optional).
    """
    content = F.col("content")
    df = files.withColumn("_secrets", secret_literals_col(content, threshold))
    cols = [F.col(c) for c in files.columns]
    cols += [keyword_score_col(content, keywords).alias("keyword_score"),
             F.size("_secrets").cast("long").alias("secret_count")]
    if with_lines:
        # No keyword occurrence in the text and no secret means no matched line (keywords hold no line
        # breaks), so the per-line scan runs only for files that scored.
        hit = (keyword_score_col(content, keywords) > 0) | (F.size("_secrets") > 0)
        cols.append(F.when(hit, matched_lines_col(content, keywords, F.col("_secrets")))
                    .otherwise(F.array().cast("array<int>")).alias("matched_lines"))
        cols.append(F.size(split_lines(content)).cast("int").alias("n_lines"))
    out = df.select(*cols)
    return out.withColumn("score", F.col("keyword_score") + F.col("secret_count") * rules.SECRET_WEIGHT)


# ---------------------------------------------------------------- imports --

def extract_imports(files: DataFrame, patterns: Sequence[str] = (rules.IMPORT_QUOTED_PATTERN,),
                    java_pattern: str | None = rules.IMPORT_JAVA_PATTERN,
                    skip_prefixes: Sequence[str] = rules.STDLIB_IMPORT_PREFIXES) -> DataFrame:
    """(repo, path, import_text, match_clean): quoted imports plus dotted Java imports ('.' -> '/'),
    lower-cased, '/' stripped at both ends, standard-library prefixes dropped."""
    parts = [F.regexp_extract_all(F.col("content"), F.lit("(?U)" + p), 1) for p in patterns]
    if java_pattern:
        parts.append(F.transform(F.regexp_extract_all(F.col("content"), F.lit("(?U)" + java_pattern), 1),
                                 lambda s: F.replace(s, F.lit("."), F.lit("/"))))
    allm = F.concat(*parts) if len(parts) > 1 else parts[0]
    out = files.select("repo", "path", F.explode(allm).alias("import_text"))
    clean = F.regexp_replace(F.lower(F.col("import_text")), r"^/+|/+$", "")
    out = out.withColumn("match_clean", clean)
    if skip_prefixes:
        out = out.where(~F.col("match_clean").rlike("^(?:" + "|".join(skip_prefixes) + ")"))
    return out


#: Key lengths of the path index: an import is looked up by keys at least half as long as itself (up to 64).
_KEY_LENGTHS = (1, 2, 4, 8, 16, 32, 64)


def _grams(s: Column, n) -> Column:
    """Distinct substrings of length n; empty when s is shorter."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.length(s) >= n, F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))) \
        .otherwise(F.array().cast("array<string>"))


def _lower_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def resolve_imports(imports: DataFrame, project_files: DataFrame) -> DataFrame:
    """Edges (repo, src, dst): first project path (in path order) whose lower-case form contains the import.

    Each distinct import text of a repo is resolved once and then joined back to
    its importers.  Substring containment is an equi-join: paths are indexed by
    their substrings of a few key lengths, an import picks the rarest of its own
    substrings of the longest key length that fits, and `contains` runs on the
    paths that share it.  Keys that no import asks for leave the index before it
    is counted, and an import with a key that no path holds is dropped, so a
    part common to all paths costs one pass per distinct import at most, never
    importer x path pairs.
    """
    paths = project_files.select("repo", F.col("path").alias("dst"))
    targets = imports.select("repo", "match_clean").where(F.length("match_clean") >= 1).distinct()
    fitting = F.greatest(*[F.when(F.length("match_clean") >= n, n) for n in _KEY_LENGTHS])
    asked = targets.select("repo", "match_clean", F.explode(_grams(F.col("match_clean"), fitting)).alias("g"))
    lpath = _lower_path(F.col("dst"))
    index = (paths.select("repo", "dst", F.explode(F.flatten(F.array(*[_grams(lpath, n) for n in _KEY_LENGTHS]))).alias("g"))
             .join(asked.select("repo", "g").distinct(), ["repo", "g"], "left_semi"))
    freq = index.groupBy("repo", "g").agg(F.count(F.lit(1)).alias("gf"))
    rarest = (asked.join(freq, ["repo", "g"], "left")
              .groupBy("repo", "match_clean")
              .agg(F.min(F.struct(F.coalesce("gf", F.lit(0)).alias("gf"), "g")).alias("k"))
              .where(F.col("k.gf") > 0)
              .select("repo", "match_clean", F.col("k.g").alias("g")))
    first = (rarest.join(index, ["repo", "g"])
             .where(lpath.contains(F.col("match_clean")))
             .groupBy("repo", "match_clean").agg(F.min("dst").alias("dst")))
    # An empty import text is contained in every path: it resolves to the repo's first path.
    empty = paths.groupBy("repo").agg(F.min("dst").alias("dst")).select("repo", F.lit("").alias("match_clean"), "dst")
    return (imports.select("repo", F.col("path").alias("src"), "match_clean")
            .join(first.unionByName(empty), ["repo", "match_clean"])
            .select("repo", "src", "dst").distinct())


#: Frontiers of an import cascade that are written as one.
MERGE_ROUNDS = 16


def live_importers(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, src) of files that boost their imports when candidates are visited in path order.

    A file boosts its imports if its score is positive when visited: either its
    own score is, or an importer visited before it (smaller path) was itself
    live and lifted it.  The closure is computed by bounded iteration: each
    round is a distributed join that writes its frontier and nothing else.
    Frontiers are merged MERGE_ROUNDS at a time, merged ones likewise, so a
    file found is rewritten a logarithmic number of times, however long the
    chains.  Runs to the fixed point: each round adds at least one file, so it
    ends after at most (longest forward import chain) rounds.
    """
    cand = scored.select("repo", F.col("path").alias("dst"))
    fwd = kept(edges.where(F.col("src") < F.col("dst")).join(cand, ["repo", "dst"], "left_semi"), "forward")
    frontier = kept(scored.where(F.col("score") > 0).select("repo", F.col("path").alias("src")), "live")
    first, found = frontier, []  # found: (how often merged, files), newest last
    while True:
        live = reduce(DataFrame.unionByName, [first, *[f for _, f in found]])
        frontier = kept(fwd.join(frontier, ["repo", "src"], "left_semi").select("repo", F.col("dst").alias("src")).distinct()
                        .join(live, ["repo", "src"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return live
        found.append((0, frontier))
        while len({level for level, _ in found[-MERGE_ROUNDS:]}) == 1 and len(found) >= MERGE_ROUNDS:
            level, some = found[-1][0], [f for _, f in found[-MERGE_ROUNDS:]]
            found[-MERGE_ROUNDS:] = [(level + 1, kept(reduce(DataFrame.unionByName, some), "live"))]


def import_boost(scored: DataFrame, edges: DataFrame, cascade: bool = False) -> DataFrame:
    """+IMPORT_BOOST on a candidate for each distinct importer that is live.

    Default: live = pre-boost score > 0 (one hop).  cascade=True: scores change
    while candidates are visited in path order, so a file lifted above 0 by an
    earlier importer boosts its own imports too (see `live_importers`).
    """
    live = (live_importers(scored, edges) if cascade
            else scored.where(F.col("score") > 0).select("repo", F.col("path").alias("src")))
    boosts = (edges.join(live, ["repo", "src"], "left_semi")
              .groupBy("repo", F.col("dst").alias("path"))
              .agg((F.count(F.lit(1)) * rules.IMPORT_BOOST).alias("boost")))
    return (scored.join(boosts, ["repo", "path"], "left")
            .withColumn("boost", F.coalesce(F.col("boost"), F.lit(0)).cast("long"))
            .withColumn("score", F.col("score") + F.col("boost")))


# ------------------------------------------------------------------- rank --

def rank_files(scored: DataFrame, top: int | None = None) -> DataFrame:
    """rank per repo by score desc, ties by path; `top` keeps rank <= top (planned as a group limit)."""
    w = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("path"))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top else out


def framework_hits(manifests: DataFrame) -> DataFrame:
    """(repo, fw_ord, keywords): the framework rules that a repo's root manifests trigger.

    `manifests` holds (repo, manifest, text) for requirements.txt / package.json at the repo root.
    """
    fw = rules.framework_rules_df(manifests.sparkSession)
    return (manifests.join(F.broadcast(fw), "manifest")  # the fixed rule list
            .where(F.exists("words", lambda w: F.lower(F.col("text")).contains(w)))
            .select("repo", "fw_ord", "keywords").distinct())


def framework_keywords(manifests: DataFrame, base: Sequence[str] = rules.RISK_KEYWORDS) -> DataFrame:
    """Per repo keyword array: base list + additions triggered by words in root manifests (duplicates kept)."""
    # Order additions as the rule list does: package.json rules first, then requirements.txt.
    extra = (framework_hits(manifests).groupBy("repo")
             .agg(F.array_sort(F.collect_list(F.struct("fw_ord", "keywords"))).alias("_x"))
             .select("repo", F.flatten(F.transform("_x", lambda s: s["keywords"])).alias("extra")))
    repos = manifests.select("repo").distinct()
    return (repos.join(extra, "repo", "left")
            .select("repo", F.concat(_kw_array(base), F.coalesce(F.col("extra"), F.array().cast("array<string>")))
                    .alias("keywords")))


def score_by_manifest(files: DataFrame, manifests: DataFrame, threshold: float = rules.SECRET_ENTROPY_THRESHOLD,
                      base: Sequence[str] = rules.RISK_KEYWORDS) -> DataFrame:
    """(repo, path, n_chars, keyword_score, secret_count, score) with the keywords of each repo's frameworks.

    Counts add up over keywords, so every file is counted once for the base list
    and once per framework rule, and the rules that the repo triggers are summed
    after a join of those few numbers: no text is shuffled.
    """
    n_rules = len(rules.FRAMEWORK_KEYWORDS)
    content = F.col("content")
    counts = files.select(
        "repo", "path", F.length(content).alias("n_chars"), keyword_score_col(content, base).alias("_base"),
        F.array(*[keyword_score_col(content, kws) for _, _, kws in rules.FRAMEWORK_KEYWORDS]).alias("_extra"),
        F.size(secret_literals_col(content, threshold)).cast("long").alias("secret_count"))
    flags = framework_hits(manifests).groupBy("repo").agg(
        *[F.max((F.col("fw_ord") == i).cast("long")).alias(f"_f{i}") for i in range(n_rules)])
    added = sum((F.coalesce(F.col(f"_f{i}"), F.lit(0)) * F.col("_extra")[i] for i in range(n_rules)), F.lit(0))
    return (counts.join(flags, "repo", "left")
            .select("repo", "path", "n_chars", (F.col("_base") + added).cast("long").alias("keyword_score"), "secret_count")
            .withColumn("score", F.col("keyword_score") + F.col("secret_count") * rules.SECRET_WEIGHT))
