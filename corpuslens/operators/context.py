"""Snippet windows, payload choice and size-limited context packing per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.text import let, split_lines
from corpuslens.operators import scoring
from corpuslens.operators.paths import filter_ext, prune_dirs, size_cap, skip_boilerplate
from corpuslens.operators.sequence import running_count
from corpuslens.session import cut_lineage

_RANGE = "struct<s:int,e:int>"


def merge_ranges_col(matched_lines: Column, n_lines: Column, window: int = rules.SNIPPET_WINDOW) -> Column:
    """Merged 0-based inclusive ranges [l-1-w, l-1+w] clamped to the file; ranges that overlap or touch merge.

    Returns array<struct<s:int,e:int>> sorted by start.  In-row: no shuffle.
    """
    raw = let(n_lines, lambda n: F.transform(F.array_sort(matched_lines), lambda l: F.struct(
        F.greatest(F.lit(0), l - 1 - window).cast("int").alias("s"),
        F.least(n - 1, l - 1 + window).cast("int").alias("e"))))
    empty = F.array().cast(f"array<{_RANGE}>")

    def step(acc, r):
        last = F.element_at(acc, -1)
        merged = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
        can_merge = (F.size(acc) > 0) & (r["s"] <= last["e"] + 1)
        return F.when(can_merge, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))) \
                .otherwise(F.concat(acc, F.array(r.cast(_RANGE))))

    return F.aggregate(raw, empty, step)


def snippet_ranges(scored: DataFrame, window: int = rules.SNIPPET_WINDOW) -> DataFrame:
    """(repo, path, island, start_line, end_line), 1-based inclusive."""
    rng = merge_ranges_col(F.col("matched_lines"), F.col("n_lines"), window)
    return (scored.select("repo", "path", F.posexplode(rng).alias("i", "r"))
            .select("repo", "path", (F.col("i") + 1).cast("int").alias("island"),
                    (F.col("r.s") + 1).alias("start_line"), (F.col("r.e") + 1).alias("end_line")))


def render_snippets_col(content: Column, matched_lines: Column, window: int = rules.SNIPPET_WINDOW) -> Column:
    """'--- LINES a-b ---' + lines, blocks joined by a blank line; '' when nothing matched."""
    def render(lines):
        rng = merge_ranges_col(matched_lines, F.size(lines), window)
        blocks = F.transform(rng, lambda r: F.concat(
            F.lit("--- LINES "), (r["s"] + 1).cast("string"), F.lit("-"), (r["e"] + 1).cast("string"),
            F.lit(" ---\n"), F.array_join(F.slice(lines, r["s"] + 1, r["e"] - r["s"] + 1), "\n")))
        return F.array_join(blocks, "\n\n")
    return let(split_lines(content), render)


def with_payload(scored: DataFrame, switch_chars: int = rules.SNIPPET_SWITCH_CHARS,
                 window: int = rules.SNIPPET_WINDOW) -> DataFrame:
    """Adds label (FULL|SNIPPETS) and payload: snippets for long files with matched lines, else the content."""
    use_snip = (F.length("content") > switch_chars) & (F.size("matched_lines") > 0)
    return (scored
            .withColumn("label", F.when(use_snip, F.lit("SNIPPETS")).otherwise(F.lit("FULL")))
            .withColumn("payload", F.when(use_snip, render_snippets_col(F.col("content"), F.col("matched_lines"), window))
                        .otherwise(F.col("content"))))


def _entry(path: Column, label: Column, score: Column, payload: Column) -> Column:
    return F.concat(F.lit("\nFILE: "), path, F.lit(" ("), label, F.lit(", Risk Score: "), score.cast("string"),
                    F.lit(")\n```\n"), payload, F.lit("\n```"))


def pack_context(payloads: DataFrame, max_chars: int = rules.PACK_MAX_CHARS,
                 max_files: int = rules.PACK_MAX_FILES, min_tail: int = rules.PACK_MIN_TAIL,
                 reserve: int = rules.PACK_TAIL_RESERVE, keywords=rules.RISK_KEYWORDS,
                 threshold: float = rules.SECRET_ENTROPY_THRESHOLD, switch_chars: int = rules.SNIPPET_SWITCH_CHARS,
                 window: int = rules.SNIPPET_WINDOW) -> DataFrame:
    """Greedy prefix packing per repo by rank: (repo, rank, path, label, n_chars, entry).

    `payloads` holds (repo, path, score) and either `payload` with `label` or the
    file's `content`, one row per (repo, path).  Files are taken in (score desc,
    path) order, skipping empty payloads; the first file that overflows
    `max_chars` is truncated to remaining-reserve characters if more than
    `min_tail` characters remain, and packing stops there or after `max_files`
    files.
    """
    # A payload is empty exactly when the file is: rendered snippets always hold their header.
    text = "payload" if "payload" in payloads.columns else "content"
    ranked = rank_nonempty(payloads.withColumn("n_chars", F.length(text)), max_files)
    return pack_ranked(ranked, payloads, max_chars, min_tail, reserve, keywords, threshold, switch_chars, window)


def rank_nonempty(scores: DataFrame, max_files: int) -> DataFrame:
    """(repo, path, score, rank) of the first `max_files` files per repo with n_chars > 0.

    Only these narrow columns are shuffled; nothing past rank `max_files` can be
    packed, so Spark plans a partial (map-side) group limit before the exchange.
    """
    w = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("path"))
    return (scores.where(F.col("n_chars") > 0).select("repo", "path", "score")
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= max_files))


def pack_ranked(ranked: DataFrame, texts: DataFrame, max_chars: int, min_tail: int, reserve: int, keywords,
                threshold: float, switch_chars: int = rules.SNIPPET_SWITCH_CHARS,
                window: int = rules.SNIPPET_WINDOW) -> DataFrame:
    """Packs (repo, path, score, rank), at most a few files per repo, with their texts; see `pack_context`.

    The texts are joined after ranking, so only the ranked files' texts meet the
    windows, and matched lines and snippets are built for them alone.
    """
    body = [c for c in ("payload", "label") if c in texts.columns] if "payload" in texts.columns else \
        [c for c in ("content", "matched_lines") if c in texts.columns]
    ranked = ranked.join(texts.select("repo", "path", *body), ["repo", "path"])
    if "payload" not in texts.columns:
        if "matched_lines" not in body:
            ranked = ranked.withColumn("matched_lines", scoring.matched_lines_col(
                F.col("content"), keywords, scoring.secret_literals_col(F.col("content"), threshold)))
        ranked = with_payload(ranked, switch_chars, window)
    entry = _entry(F.col("path"), F.col("label"), F.col("score"), F.col("payload"))
    ranked = ranked.withColumn("entry", entry).withColumn("n_chars", F.length("entry"))
    wc = Window.partitionBy("repo").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("cum", F.sum("n_chars").over(wc))
    before = F.col("cum") - F.col("n_chars")
    remaining = F.lit(max_chars) - before
    fits = F.col("cum") <= max_chars
    tail = (~fits) & (before <= max_chars) & (remaining > min_tail)
    trunc_entry = _entry(F.col("path"), F.lit("TRUNCATED"), F.col("score"),
                         F.left(F.col("payload"), remaining - reserve))
    return (ranked.where(fits | tail)
            .select("repo", F.col("rank").cast("int").alias("rank"), "path",
                    F.when(fits, F.col("label")).otherwise(F.lit("TRUNCATED")).alias("label"),
                    F.when(fits, F.col("entry")).otherwise(trunc_entry).alias("entry"))
            .withColumn("n_chars", F.length("entry").cast("int")))


def context_text(packed: DataFrame) -> DataFrame:
    """(repo, text): the packed entries joined with newlines in rank order.

    Bounded per repo by construction (<= max_files entries, <= max_chars plus
    headers).  The directory listing grows with the repo: `review_context` keeps
    it as rows.
    """
    return (packed.groupBy("repo")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("_e"))
            .select("repo", F.concat(F.lit(rules.CONTENTS_HEADER + "\n"),
                                     F.array_join(F.transform("_e", lambda s: s["entry"]), "\n")).alias("text")))


def hierarchy(files: DataFrame) -> DataFrame:
    """(repo, idx, path): the files under non-pruned directories, numbered from 1 in path order per repo."""
    listed = prune_dirs(files).select("repo", "path").withColumn("_one", F.lit(True))
    return running_count(listed, "repo", ["path"], "_one", "idx").select("repo", "idx", "path")


def review_context(files: DataFrame, manifests: DataFrame | None = None, import_patterns=(rules.IMPORT_QUOTED_PATTERN,),
                   threshold: float = rules.SECRET_ENTROPY_THRESHOLD, max_chars: int = rules.PACK_MAX_CHARS,
                   max_files: int = rules.PACK_MAX_FILES, min_tail: int = rules.PACK_MIN_TAIL,
                   reserve: int = rules.PACK_TAIL_RESERVE, switch_chars: int = rules.SNIPPET_SWITCH_CHARS,
                   window: int = rules.SNIPPET_WINDOW, cascade: bool = True) -> DataFrame:
    """The review context of every repo as ordered rows (repo, section, idx, text).

    Section 0 is the directory listing, section 1 the packed files; row 0 of
    each is its header, and a repo's context is its texts in (section, idx)
    order joined by newlines.  Source files that pass the directory, extension,
    name and size filters are scored with the keywords of their repo's
    frameworks, boosted by their importers, ranked and packed.  `manifests`
    (repo, manifest, text) default to the manifest files at the root in `files`;
    `files` holds (repo, path, content), one row per file.
    """
    if manifests is None:
        manifests = (files.where(F.col("path").isin(*rules.MANIFEST_FILES))
                     .select("repo", F.col("path").alias("manifest"), F.col("content").alias("text")))
    project = filter_ext(prune_dirs(files))
    cands = size_cap(skip_boilerplate(project))
    # Both are read by every round of the boost: a few numbers per file and the import graph, no texts.
    scored = cut_lineage(scoring.score_by_manifest(cands, manifests, threshold))
    edges = cut_lineage(scoring.resolve_imports(scoring.extract_imports(cands, patterns=import_patterns), project))
    ranked = rank_nonempty(scoring.import_boost(scored, edges, cascade=cascade), max_files)
    ranked = (ranked.join(scoring.framework_keywords(manifests), "repo", "left")
              .withColumn("keywords", F.coalesce("keywords", F.array(*[F.lit(k) for k in rules.RISK_KEYWORDS]))))
    packed = pack_ranked(ranked, cands, max_chars, min_tail, reserve, F.col("keywords"), threshold, switch_chars, window)

    def rows(section, idx, text):
        return [F.lit(section).alias("section"), idx.cast("long").alias("idx"), text.alias("text")]
    headers = files.select("repo").distinct().select("repo", F.inline(F.array(
        F.struct(*rows(0, F.lit(0), F.lit(rules.HIERARCHY_HEADER))),
        F.struct(*rows(1, F.lit(0), F.lit(rules.CONTENTS_HEADER))))))
    return (headers.unionByName(hierarchy(files).select("repo", *rows(0, F.col("idx"), F.col("path"))))
            .unionByName(packed.select("repo", *rows(1, F.col("rank"), F.col("entry")))))
