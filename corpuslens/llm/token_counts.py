"""Token counts by byte-pair merging on a heap and a linked list.

A text's count is the number of its initial symbols less the number of merges;
no identifier is made.  Texts are split into words (white space where the
vocabulary drops it), each different word of a batch is merged once, and
counts of words already seen are remembered up to a bound.  A scan and one
Arrow pass, no shuffle: a lost task is simply counted again.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ship

ship(__name__)

#: Words whose counts a task remembers, longest word that it remembers, and bytes of texts that it splits together.
WORDS_KEPT, LONGEST_KEPT, TEXT_BYTES = 400_000, 64, 1 << 23


def merge_count(symbols: list[int], ranks: dict[int, tuple[int, int]], base: int) -> int:
    """Merges that byte-pair encoding makes in a word.

    `ranks` gives (rank, merged symbol) of a pair, keyed left * base + right.
    The heap holds (rank, position); a rank names one pair, so an entry is
    stale exactly if the pair now at its position has another rank.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i) for i, (a, b) in enumerate(pairwise(symbols)) if (found := ranks.get(a * base + b))]
    heapq.heapify(heap)
    symbols, merges = symbols.copy(), 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = ranks.get(symbols[i] * base + symbols[j])
        if not found or found[0] != rank:
            continue
        merges += 1
        symbols[i], symbols[j] = found[1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if new := ranks.get(symbols[i] * base + symbols[k]):
                heapq.heappush(heap, (new[0], i))
        h = before[i]
        if h >= 0 and (new := ranks.get(symbols[h] * base + symbols[i])):
            heapq.heappush(heap, (new[0], h))
    return merges


class TokenCounter:
    """Counts tokens as the tokenizer of a .json file of kind BPE does."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            config = json.load(f)
        model, added = config["model"], config.get("added_tokens") or []
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"{tokenizer_file}: only plain byte-pair vocabularies can be counted ({odd or model.get('type')})")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{tokenizer_file}: added tokens must match as they are written")
        library = Tokenizer.from_file(tokenizer_file)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.base = max(self.vocab.values()) + 1
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {self.vocab[a] * self.base + self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        marks = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, marks))) if marks else None
        # With word ends and white space dropped, no token reaches over white space.
        self.by_word = bool(self.suffix) and [w for w, _ in self._pieces("a \t\n b")] == ["a", "b"]
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def _pieces(self, text: str) -> list:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return self.pre_tokenizer.pre_tokenize_str(text) if self.pre_tokenizer else [(text, None)] if text else []

    def _part(self, part: str) -> int:
        """Tokens of one piece of the pre-tokenizer; symbols that the vocabulary lacks are dropped, as in the library."""
        named = [*part[:-1], part[-1] + self.suffix] if part else []
        symbols = [s for s in map(self.vocab.get, named) if s is not None]
        return len(symbols) - (merge_count(symbols, self.ranks, self.base) if len(symbols) > 1 else 0)

    def _word(self, word: str) -> int:
        total = 0
        for part, _ in self._pieces(word):
            n = self.parts.get(part)
            if n is None:
                n = self._part(part)
                if len(part) <= LONGEST_KEPT:
                    self.parts[part] = n
            total += n
        return total

    def _count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts without special strings."""
        if not self.by_word:
            return np.fromiter(map(self._word, texts.to_pylist()), np.int64, len(texts))
        split = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(split.flatten())
        counts = []
        for w in words.dictionary.to_pylist():
            n = self.words.get(w)
            if n is None:
                n = self._word(w)
                if len(w) <= LONGEST_KEPT:
                    self.words[w] = n
            counts.append(n)
        each = np.array(counts, np.int64)[words.indices.to_numpy()] if counts else np.zeros(0, np.int64)
        stops = split.offsets.to_numpy() - split.offsets[0].as_py()
        return np.diff(np.append(0, np.cumsum(each))[stops])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token, null counts as empty."""
        if len(self.words) > WORDS_KEPT or len(self.parts) > WORDS_KEPT:
            self.words, self.parts = {}, {}
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        if self.special:
            marked = pc.match_substring_regex(texts, self.special.pattern.replace("\\ ", " ")).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        out[~marked] = self._count(texts.filter(pa.array(~marked)))
        for i in np.flatnonzero(marked).tolist():
            text = texts[i].as_py()
            rest = self.special.split(text)
            out[i] = len(rest) - 1 + int(self._count(pa.array([r for r in rest if r], texts.type)).sum())
        return out


def _slices(texts: pa.Array):
    """(first, stop) of runs of texts of bounded size; a longer text goes alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > TEXT_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if sizes:
        yield first, len(sizes)


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per document.

    n_tokens is what the library gives for the whole text without added
    begin or end tokens, padding or truncation; n_bytes is the text's length in
    UTF-8, over_limit whether n_tokens exceeds `limit`.  A null text counts as
    empty: 0 bytes, 0 tokens.  Repeated rows and null identifiers are rows like
    others; other columns take no part, whatever their names; empty input,
    empty result.  A word of any length is merged whole, in n log n steps.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = src.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        counter = TokenCounter(tokenizer_file)
        for b in batches:
            texts = b.column("text")
            found = [counter.counts(texts[x:y]) for x, y in _slices(texts)]
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([b.column("doc_id"), sizes, pa.array(np.concatenate(found) if found else [], pa.int64())],
                                  ["doc_id", "n_bytes", "n_tokens"])

    return src.mapInArrow(run, shape).withColumn("over_limit", F.col("n_tokens") > limit)
