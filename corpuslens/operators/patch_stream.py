"""Sections of patches applied one after another to a file that is held once.

For files that get thousands of sections: rows come sorted by file, the file
first and its sections behind it in order, and one pass carries the file's
text.  Memory is one text, one section and one output batch, however many
sections there are.  Finds and replaces exactly what `patching` does.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: White space as Unicode defines it, inside a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = re.compile(rf"[{SPACE}]+|[a-zA-Z0-9_]+|[^{SPACE}a-zA-Z0-9_]+")
OUT_BYTES = 1 << 24


def eol(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def tolerant(search: str) -> re.Pattern:
    """A search block as a pattern: white space for white space, and optional between other tokens and around them."""
    parts, was_space, gap = [], True, f"[{SPACE}]*"
    for token in TOKEN.findall(search):
        if re.match(f"[{SPACE}]", token):
            parts.append(f"[{SPACE}]+")
            was_space = True
        else:
            parts.append(("" if was_space else gap) + re.escape(token))
            was_space = False
    return re.compile(gap + "".join(parts) + gap, re.DOTALL)


def apply_section(text: str, chunks: list[dict]) -> tuple[str, int, bool, str | None]:
    """(text, chunks applied, whether some needed other white space, search that failed) behind a section."""
    text, fuzzy = eol(text), False
    for i, chunk in enumerate(chunks):
        search, replace = eol(chunk["search"]), eol(chunk["replace"])
        at = text.find(search)
        if at >= 0:
            text = text[:at] + replace + text[at + len(search):]
            continue
        found = tolerant(search).search(text)
        if not found:
            return text, i, fuzzy, chunk["search"]
        text, fuzzy = text[:found.start()] + replace + text[found.end():], True
    return text, len(chunks), fuzzy, None


def sections_applied(shape, by_patch: bool, ok: str, missing: str, failed: str):
    """A function for mapInArrow: sorted file and section rows -> one row of `shape` per section."""
    def run(batches):
        import pyarrow as pa

        names = [f.name for f in shape]
        key, was, text = (), None, None
        out, held = [], 0

        def packed():
            return pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], names)

        for b in batches:
            for r in b.to_pylist():
                own = (r["repo"], r["target"], r["patch_id"] if by_patch else None)
                if own != key:
                    key, was, text = own, None, None
                if not r["is_section"]:
                    was = text = r["content"]
                    continue
                applied, kind, error, status = 0, None, None, r["status"]
                if status is None and text is None:
                    status = missing
                elif status is None:
                    new, applied, fuzzy, lost = apply_section(text, r["chunks"])
                    if lost is None:
                        status, kind, text = ok, "FUZZY" if fuzzy else "EXACT", new
                    else:
                        status, error = failed, "Search block not found: " + (lost if len(lost) <= 100 else lost[:100] + "...")
                out.append((r["repo"], r["target"], was, r["patch_id"], r["file_ord"], status, applied, kind, text, error))
                held += len(text or "") + len(was or "")
                if held >= OUT_BYTES or len(out) >= 10_000:
                    yield packed()
                    out.clear()
                    held = 0
        if out:
            yield packed()
    return run
