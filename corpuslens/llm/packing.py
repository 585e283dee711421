"""Cost-balanced packing of tokenised documents into sequences.

Each task tokenises the documents of its partition and packs them window by
window, so tokens are never shuffled.  Whole sequences are cut off long
documents first.  What remains is assigned in descending order of estimated
cost (linear plus quadratic attention) to the cheapest sequence with enough
capacity left, and cut where none has.  A window's sequences hold exactly its
tokens: as many full ones as they fill, then a few whose lengths are powers of
two, which need no padding either.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ship

ship(__name__)

#: Tokens of a sequence, tokens packed together, cost per token and per token pair.
CAPACITY, WINDOW_TOKENS, LINEAR, QUADRATIC = 4096, 1 << 20, 1.0, 1 / 2048
END_ID = 2
#: Words whose ids a task remembers, and bytes of texts that it tokenises together, unless one has more.
WORDS_KEPT, TEXT_BYTES = 600_000, 1 << 23


#: ASCII punctuation between a letter or digit and white space is a token of its own, unless an apostrophe is in it;
#: apart, it leaves fewer different words.
STOP = r"([a-z0-9À-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(\s|$)"


#: How a tokenizer must normalise and split texts to be one that works word by word.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def works_by_words(tokenizer) -> bool:
    """Whether the tokenizer's own settings are those that WordIds takes for granted: lower case, no token over white space."""
    def settings(part):
        return json.loads(part.__getstate__()) if part else {}

    normal = [n["type"] for n in settings(tokenizer.normalizer).get("normalizers", [])]
    pre = settings(tokenizer.pre_tokenizer).get("pretokenizers", [])
    return (getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>" and normal == WORD_NORMALIZERS
            and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": WORD_SPLIT}
            and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"])


def ids_by(tokenizer_file: str, end_id: int = END_ID) -> WordIds | TextIds:
    """The ids of texts by a tokenizer file: by words where its settings allow it, else by whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    return (WordIds if works_by_words(tokenizer) else TextIds)(tokenizer, end_id)


class TextIds:
    """Ids of whole texts, for any tokenizer; one that truncates or pads doesn't do so here."""

    def __init__(self, tokenizer, end_id: int = END_ID):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer, self.end_id = tokenizer, end_id

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """All ids of each text, the end id behind them."""
        told = self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
        return [np.array([*t.ids, self.end_id], np.uint32) for t in told]


class WordIds:
    """Number of a word, whose ids stand in `flat`; the vocabulary works word by word, white space never joins two."""

    def __init__(self, tokenizer, end_id: int = END_ID):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a token of the pre-tokenizer
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.flat, self.place, self.used = np.empty(1 << 18, np.uint32), np.zeros((1 << 16, 2), np.int64), 0

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, self.used = self.used, self.used + len(ids)
        here = slice(len(self.known), len(self.known) + len(words))
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while here.stop > len(self.place):
            self.place = np.concatenate([self.place, np.zeros_like(self.place)])
        self.flat[first:self.used] = ids
        self.place[here, 0], self.place[here, 1] = first + np.cumsum(lengths) - lengths, lengths
        self.known.update(zip(words, range(here.start, here.stop), strict=True))

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, words: list[str]) -> None:
        """Words of letters are encoded many at a time, if each then has one end; others one by one."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() else other).append(w)
        for i in range(0, len(plain), 512):
            some = plain[i:i + 512]
            ids = self._encode(" ".join(some))
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                self._add(some, ids, np.diff(last, prepend=-1))
            else:
                other += some
        for w in other:
            ids = self._encode(w)
            self._add([w], ids, np.array([len(ids)]))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """All ids of each text, the end id behind them."""
        if len(self.known) > WORDS_KEPT or self.used > 1 << 24:
            self.reset()
        texts = pc.fill_null(texts, "")
        # A control string is one only as it is written; other texts may be put in lower case and taken apart.
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), STOP, r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, apart))
        words = pc.dictionary_encode(split.flatten())
        different = words.dictionary.to_pylist()
        self.learn([w for w in different if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        place = self.place[number][words.indices.to_numpy()]
        first, n = place[:, 0], place[:, 1]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first - ends + n, n)
        at += np.arange(total)
        stop = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [np.append(x, np.uint32(self.end_id)) for x in np.split(self.flat[at], stop[1:-1])]


def tokenised(words: WordIds | TextIds, names: list, texts: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """(name, ids) of every text, a bounded number of bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate([*sizes, TEXT_BYTES]):
        if i > first and size + n > TEXT_BYTES or i == len(sizes) and i > first:
            yield from zip(names[first:i], words.ids(texts[first:i]), strict=True)
            first, size = i, 0
        size += n


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two, that together hold exactly `total` tokens."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Every sequence of `capacities` ends up full; ties go to the earlier document and sequence.
    """
    room = capacities(sum(lengths), capacity)
    fill, pieces = [0] * len(room), []

    def cost(n):
        return LINEAR * n + QUADRATIC * n * n

    rest, spent, next_full = [], [0.0] * len(room), 0
    for d, n in enumerate(lengths):  # whole sequences first
        cut = 0
        while n - cut >= capacity:
            pieces.append((d, cut, capacity, next_full, 0))
            fill[next_full] = capacity
            next_full += 1
            cut += capacity
        if n - cut:
            rest.append((n - cut, d, cut))
    open_ = [(0.0, s) for s in range(next_full, len(room))]
    heapq.heapify(open_)
    for n, d, cut in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            passed = []
            while open_ and room[open_[0][1]] - fill[open_[0][1]] < n:
                passed.append(heapq.heappop(open_))
            if open_:
                take = n
            else:  # no sequence has room for it whole: the emptiest takes a piece
                best = max(range(len(passed)), key=lambda i: (room[passed[i][1]] - fill[passed[i][1]], -passed[i][1]))
                heapq.heappush(open_, passed.pop(best))
                take = room[open_[0][1]] - fill[open_[0][1]]
            _, s = heapq.heappop(open_)
            pieces.append((d, cut, take, s, fill[s]))
            fill[s] += take
            spent[s] += cost(take)
            n, cut = n - take, cut + take
            if fill[s] < room[s]:
                passed.append((spent[s], s))
            for x in passed:
                heapq.heappush(open_, x)
    return pieces


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids), one per piece.

    A document's ids are those of its whole text by the tokenizer file, without
    special tokens, then `end_id`; a null text counts as empty, so that every
    row has a piece.  `ids` are the piece's ids
    as little-endian unsigned 32-bit numbers; start counts the document's ids
    before the piece.  Each id lies in exactly one piece; repeated rows are
    packed one by one; null identifiers stay null.  Sequences are numbered by
    partition and never reach over two.  Empty input, empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    shape = src.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names[1:6]], F.lit(b"").alias("ids")).schema

    def run(batches):
        words = ids_by(tokenizer_file, end_id)
        sequence = TaskContext.get().partitionId() << 33
        held, tokens, id_type = [], 0, None

        def flush():
            nonlocal sequence, held, tokens
            rows = [(held[d][0], held[d][2] + start, n, held[d][3], sequence + s, at, held[d][1][start:start + n].tobytes())
                    for d, start, n, s, at in pack([len(x[1]) for x in held], capacity)]
            sequence = max(r[4] for r in rows) + 1
            held, tokens = [], 0
            kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
            for i in range(0, len(rows), 4096):
                columns = zip(*rows[i:i + 4096], strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            id_type = b.column("doc_id").type
            for doc, ids in tokenised(words, b.column("doc_id").to_pylist(), b.column("text")):
                ids = ids.astype("<u4")
                for at in range(0, len(ids), window_tokens):  # a very long document goes through several windows
                    part = ids[at:at + window_tokens]
                    held.append((doc, part, at, len(ids)))
                    tokens += len(part)
                    if tokens >= window_tokens:
                        yield from flush()
        if held:
            yield from flush()

    return src.mapInArrow(run, shape)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (of the ids' bytes) in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
