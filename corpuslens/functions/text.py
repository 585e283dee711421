"""Column functions (all JVM-side expressions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line boundaries of str.splitlines(): \r\n and the single-character separators.
LINE_BREAK_RE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Universal newlines (text-mode read): \r\n, \r, \n.
UNIVERSAL_NEWLINE_RE = r"\r\n|[\r\n]"
# Characters str.strip() removes (str.isspace()).
PY_SPACE_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and pass it to `body` as a lambda variable.

    The optimizer inlines a projected column into every lambda that mentions
    it; binding through a higher-order function argument keeps an expensive
    value (a split of the whole file) computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _split_keep_semantics(text: Column, sep_re: str) -> Column:
    """Split like str.splitlines(): '' -> [], a trailing separator adds no empty element."""
    parts = F.split(text, sep_re, -1)
    ends_with_sep = text.rlike("(?:" + sep_re + r")\z")
    return (F.when(text.isNull(), F.lit(None))
            .when(F.length(text) == 0, F.array().cast("array<string>"))
            .when(ends_with_sep, F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def split_lines(text) -> Column:
    """str.splitlines() as an array column (line i is element i, 1-based)."""
    return _split_keep_semantics(_c(text), LINE_BREAK_RE)


def source_lines(text) -> Column:
    """Lines as seen by a text-mode reader (universal newlines), as used for AST line numbers."""
    return _split_keep_semantics(_c(text), UNIVERSAL_NEWLINE_RE)


def py_strip(text) -> Column:
    """str.strip(): remove leading/trailing Python whitespace."""
    return F.regexp_replace(_c(text), "^" + PY_SPACE_CLASS + "+|" + PY_SPACE_CLASS + "+$", "")


def count_ci(text, keyword: str | Column) -> Column:
    """Non-overlapping, case-insensitive count of a literal keyword (str.lower().count)."""
    low = F.lower(_c(text))
    kw = F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword))
    return ((F.length(low) - F.length(F.replace(low, kw, F.lit("")))) / F.length(kw)).cast("long")


def shannon_entropy(s) -> Column:
    """Bits per character over distinct characters; '' -> 0.0."""
    s = _c(s)
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))

    def step(acc, ch):
        p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(s.isNull(), F.lit(None)).when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(chars, F.lit(0.0).cast("double"), step))


def line_of_first(text, match) -> Column:
    """1-based splitlines() line of the first occurrence of a literal without line breaks; null if absent."""
    text, match = _c(text), _c(match)
    pos = F.position(match, text)
    prefix = F.left(text, pos - 1)
    breaks = F.size(F.regexp_extract_all(prefix, F.lit("(" + LINE_BREAK_RE + ")"), 1))
    return F.when(pos > 0, breaks + 1)


def normalize_eol(text) -> Column:
    return F.regexp_replace(_c(text), r"\r\n?", "\n")


def ellipsize(text, n: int) -> Column:
    """First n characters plus '...' when longer than n."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def tagged_block(text, tag: str, default: Column | str | None = None) -> Column:
    """Stripped body of the first <tag>...</tag> (dot-all, lazy); default when absent."""
    t = _c(text)
    pat = f"(?s)<{tag}>(.*?)</{tag}>"
    body = py_strip(F.regexp_extract(t, pat, 1))
    dflt = default if isinstance(default, Column) else F.lit(default)
    return F.when(t.rlike(pat), body).otherwise(dflt)


def strip_tagged(text, tag: str) -> Column:
    """Remove every <tag>...</tag> block, then strip."""
    return py_strip(F.regexp_replace(_c(text), f"(?s)<{tag}>.*?</{tag}>", ""))


def splice(text: Column, pos: Column, length: Column, replacement: Column) -> Column:
    """text[:pos-1] + replacement + text[pos-1+length:] with a 1-based pos."""
    return F.concat(F.left(text, pos - 1), replacement, F.substr(text, pos + length, F.length(text) + 1))


def literal_replace_first(text, search, replacement) -> Column:
    """Replace the first literal occurrence of search; unchanged text when absent."""
    text, search, replacement = _c(text), _c(search), _c(replacement)
    pos = F.position(search, text)
    return F.when(pos > 0, splice(text, pos, F.length(search), replacement)).otherwise(text)


def regex_quote(token: Column) -> Column:
    """Backslash-escape the regex metacharacters of a literal token."""
    return F.regexp_replace(token, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def fuzzy_pattern(search) -> Column:
    """Whitespace-tolerant regex for a search block.

    Tokens are whitespace runs, [A-Za-z0-9_] runs and runs of anything else; a
    whitespace run becomes \\s+, adjacent non-space tokens get \\s* between them,
    and the whole pattern is wrapped in \\s*.  (?U) makes \\s Unicode-aware.
    """
    tokens = F.regexp_extract_all(_c(search), F.lit(r"(?U)(\s+|[a-zA-Z0-9_]+|[^\sa-zA-Z0-9_]+)"), 1)
    init = F.struct(F.lit("").alias("pat"), F.lit(False).alias("last_space"), F.lit(False).alias("started"))

    def step(acc, tok):
        is_space = tok.rlike(r"(?U)^\s+$")
        is_word = tok.rlike(r"^[a-zA-Z0-9_]+$")
        lit = F.when(is_word, tok).otherwise(regex_quote(tok))
        glue = F.when(acc["started"] & ~acc["last_space"], F.lit(r"\s*")).otherwise(F.lit(""))
        return F.struct(
            F.when(is_space, F.concat(acc["pat"], F.lit(r"\s+")))
             .otherwise(F.concat(acc["pat"], glue, lit)).alias("pat"),
            is_space.alias("last_space"),
            F.lit(True).alias("started"))

    body = F.aggregate(tokens, init, step)["pat"]
    return F.concat(F.lit(r"(?sU)\s*"), body, F.lit(r"\s*"))


def is_clean_report(report) -> Column:
    return F.lower(_c(report)).contains("no vulnerabilities detected")


def is_remote_target(target) -> Column:
    t = _c(target)
    return t.startswith("http://") | t.startswith("https://") | t.startswith("git@")


def repo_name(target, default: str = "cloned_repo") -> Column:
    """Last '/' part with every '.git' removed; default when that is empty."""
    name = F.replace(F.element_at(F.split(_c(target), "/", -1), -1), F.lit(".git"), F.lit(""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def parse_iso_ts(s) -> Column:
    """ISO-8601 text with optional trailing Z -> TIMESTAMP (session TZ is UTC)."""
    return F.to_timestamp(F.regexp_replace(_c(s), "Z$", ""))
