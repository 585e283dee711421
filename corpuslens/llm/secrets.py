"""Secret scan with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match
must contain.  The corpus is indexed in segments (the rows that a task reads
together), as search engines keep theirs: postings list, for each trigram that
some query asks for, the rows of the segment that contain it.  A rule's
postings are intersected and joined, and only the rows that are left are
matched with the regex.  Rules without mandatory trigrams match every row.
A segment stays where its texts are, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import own_name, ship

ship(__name__)

#: Bytes of text in a segment, unless a single text has more; alternatives of a query at most.
SEGMENT_BYTES, MOST_TEXTS = 1 << 22, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has at least `least` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds of the contract, in its order, then further kinds of tokens with a public format.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("temporary", r"ASIA[A-Z0-9]{16}(?![A-Z0-9])"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# A query is ("gram", code), ("and", parts), ("or", parts) or ("all",); codes are of lower-cased bytes.
ALL = ("all",)


def _both(parts):
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(text: str):
    b = text.lower().encode()
    return _both([("gram", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2)])


def _texts(parsed) -> tuple[set[str] | None, tuple]:
    """All texts that a parsed regex can match, if they are few, and a query that any match satisfies."""
    runs: list[set[str] | None] = [{""}]
    asked = []

    def close():
        if runs[0] is not None and runs[0] != {""}:
            asked.append(_any([_grams(t) for t in runs[0]]))

    whole = True
    for op, arg in parsed:
        texts, need = None, ALL
        if op is sre.LITERAL:
            texts = {chr(arg)} if arg < 128 else None
        elif op is sre.IN and not any(o is sre.NEGATE for o, _ in arg) and all(o is sre.LITERAL and a < 128 for o, a in arg):
            texts = {chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            texts, need = _texts(arg[3])
        elif op is sre.BRANCH:
            sides = [_texts(x) for x in arg[1]]
            texts = set().union(*[t for t, _ in sides]) if all(t is not None for t, _ in sides) else None
            need = _any([_any([_grams(x) for x in t]) if t is not None else q for t, q in sides])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            got, inside = _texts(inner)
            if got is not None and (low, high) == (0, 1):
                texts = got | {""}
            elif got is not None and low == high == 1:
                texts = got
            elif low:
                need = _any([_grams(x) for x in got]) if got is not None else inside
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            texts = {""}
        if texts is not None and len(joined := {a + b for a in runs[0] for b in texts}) <= MOST_TEXTS:
            runs[0] = joined
        else:
            whole = False
            close()
            runs[0] = {""}
            if texts is not None and len(texts) <= MOST_TEXTS:
                runs[0] = texts
            elif need != ALL:
                asked.append(need)
    if whole:
        return runs[0], _any([_grams(t) for t in runs[0]])
    close()
    return None, _both(asked)


def trigram_query(pattern: str):
    """A Boolean query over lower-cased trigrams that every text with a match of `pattern` satisfies."""
    return _texts(sre_parser.parse(pattern))[1]


def query_grams(query) -> set[int]:
    return {query[1]} if query[0] == "gram" else set().union(*map(query_grams, query[1])) if len(query) > 1 else set()


class Segment:
    """Postings of a run of texts: for each asked trigram the sorted numbers of the texts that contain it."""

    def __init__(self, texts: Sequence[bytes], slot: np.ndarray, n_slots: int):
        self.n = len(texts)
        data = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(t) + 2 for t in texts])
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:] if len(data) > 2 else data[:0]
        hit = slot[code]
        at = np.flatnonzero(hit)
        seen = np.unique(hit[at].astype(np.int64) * self.n + np.searchsorted(ends, at, side="right"))
        self.bounds = np.searchsorted(seen, np.arange(n_slots + 2) * self.n)
        self.rows = seen % max(self.n, 1)
        self.slot = slot

    def find(self, query) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        kind, arg = query
        if kind == "gram":
            k = int(self.slot[arg])
            return self.rows[self.bounds[k]:self.bounds[k + 1]]
        found = sorted((self.find(q) for q in arg), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if kind == "and" else np.union1d(out, f)
        return out


def _scanner(rules: Sequence[Rule]) -> Callable[[list[str | None]], list[list[tuple[int, int, str]]]]:
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(query_grams, queries)))
    slot = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
    slot[grams] = np.arange(1, len(grams) + 1)
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]

    def scan(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        texts = [t or "" for t in texts]
        segment = Segment([t.encode() for t in texts], slot, len(grams))
        out = [[] for _ in texts]
        for rule, query, regex in zip(rules, queries, compiled, strict=True):
            for i in segment.find(query).tolist():
                for m in regex.finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), m.end(), rule.kind))
        return out

    return scan


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text",
         keep: Sequence[str] | None = None) -> DataFrame:
    """Adds secrets, an array of (kind, start, end), to every row of `docs`.

    Per rule its leftmost, non-overlapping matches; those that fail its length
    are dropped and not tried again.  Positions are code points.  Elements are
    in the order of the rules, then of start.  A null text counts as empty;
    whole texts are read.  `keep` names the columns that stay (all, unless
    given); an input column called secrets is replaced.
    """
    stay = [c for c in (keep if keep is not None else docs.columns) if c != "secrets"]
    raw = own_name(docs.columns, "_raw")
    src = docs.select(*stay, F.col(text_col).alias(raw))
    shape = src.select(*stay, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("secrets")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        find = _scanner(rules)
        for b in batches:
            texts, size, first = b.column(raw), 0, 0
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            for i, n in enumerate([*lengths, None]):
                if n is None or (size and size + n > SEGMENT_BYTES):
                    if i > first:
                        part = b.slice(first, i - first)
                        found = find(part.column(raw).to_pylist())
                        rows = [[{"kind": k, "start": x, "end": y} for x, y, k in r] for r in found]
                        yield pa.record_batch([*[part.column(c) for c in stay], pa.array(rows, kind)], [*stay, "secrets"])
                    first, size = i, 0
                size += n or 0

    return src.mapInArrow(run, shape)
