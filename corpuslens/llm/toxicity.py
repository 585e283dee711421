"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Texts become sets of hashed unigrams, bigrams and skip-grams (one word left
out) inside tasks; a bounded sample of labelled rows trains the model, and
its non-zero weights, few because of the L1 term, are broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import own_name, ship, stored

ship(__name__)

#: Features: hash space, and words kept in a task's word table before it is emptied.
BITS, WORDS_KEPT = 20, 300_000
#: Training rows at most (those with the smallest hash of their identifier), passes over them, and FTRL's rates,
#: chosen on a fifth of the training rows of two tables (3,155 and 9,681 rows).
MAX_TRAIN, EPOCHS = 24_000, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
#: Words in a training row whose features are taken one text block at a time; blocks bound memory for any text length.
BLOCK_WORDS = 1 << 16


class WordHashes(dict):
    """Hash of a lower-cased word without surrounding punctuation; emptied when full, long words aren't kept."""

    def __missing__(self, word: bytes) -> int:
        x = crc32(word.strip(b".,;:!?\"'()[]{}<>*_-"))
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = x
        return x


class Features:
    """Sorted unique feature numbers of a text; the last number is the intercept."""

    def __init__(self, bits: int = BITS):
        self.mask, self.size, self.hashes = np.uint32((1 << bits) - 1), 1 << bits, WordHashes()

    def ids(self, text: bytes | None) -> np.ndarray:
        words, parts = (text or b"").lower().split(), [np.empty(0, np.uint32)]
        for i in range(0, len(words), BLOCK_WORDS):
            block = words[i:i + BLOCK_WORDS + 2]  # two more: n-grams over the border
            h = np.fromiter(map(self.hashes.__getitem__, block), np.uint32, len(block))
            two = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77))
            skip = (h[:-2] * np.uint32(0xC2B2AE3D)) ^ (h[2:] * np.uint32(0x27D4EB2F))
            x = np.concatenate([h[:BLOCK_WORDS], two[:BLOCK_WORDS], skip[:BLOCK_WORDS]])
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            parts.append(x & self.mask)
        found = np.sort(np.concatenate(parts))
        found = found[np.flatnonzero(np.diff(found, prepend=-1))].astype(np.int32)
        return np.append(found, np.int32(self.size))


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the identifier as text leaves 0 modulo 5; a null identifier never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Features()
    for b in batches:
        ids = [make.ids(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("ord"), b.column("label"), pa.array(ids, pa.binary())], ["ord", "label", "ids"])


def _train(size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches):
        rows = [(np.frombuffer(i, np.int32), y) for b in batches
                for i, y in zip(b.column("ids").to_pylist(), b.column("label").to_pylist(), strict=True)]
        z, n = np.zeros(size + 1), np.zeros(size + 1)

        def weights(zi, ni):
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
            w[np.abs(zi) <= l1] = 0.0
            return w

        for _ in range(epochs):
            for ids, y in rows:
                zi, ni = z[ids], n[ids]
                w = weights(zi, ni)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                more = ni + g * g
                z[ids] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
                n[ids] = more
        w = weights(z, n)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], ["feature", "weight"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_TRAIN) -> DataFrame:
    """(feature, weight): the non-zero weights.

    Learns from at most `max_rows` labelled rows that are not held out, those
    with the smallest hash of their identifier.  Null labels or identifiers
    are no training rows; of several labels of one identifier the largest
    counts; repeated documents train once each, up to 2 * `max_rows` rows in
    all, those with the smallest hash of identifier and text.  Without labelled
    rows there are no weights and every score is 0.5.
    """
    pick = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
            .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("id"), "id").limit(max_rows))  # bounds the broadcast
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
            .join(F.broadcast(pick), "id")
            .select(F.xxhash64("id", "text").alias("ord"), F.col("label"), "text")
            .mapInArrow(_featurize, "ord long, label double, ids binary")
            .orderBy("ord").limit(2 * max_rows))  # only repeated identifiers can exceed max_rows
    return rows.repartition(1).sortWithinPartitions("ord", "ids").mapInArrow(
        _train(1 << BITS, EPOCHS, ALPHA, BETA, L1, L2), "feature int, weight double")


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5, else 0) to every row of `docs`.

    Whole texts are scored; null and empty ones by the intercept alone.
    `model` has at most 2**BITS + 1 rows, so it may come to the driver and be
    broadcast.  `keep` names the columns that stay (all, unless given); input
    columns called like an added one are replaced.
    """
    spark = docs.sparkSession
    got = model.toPandas()
    sent = spark.sparkContext.broadcast((got["feature"].to_numpy(), got["weight"].to_numpy()))
    stay = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("score", "predicted")]
    raw = own_name(docs.columns, "_raw")
    src = docs.select(*stay, F.col(text_col).cast("binary").alias(raw))
    schema = src.select(*stay, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        at, weight = sent.value
        w = np.zeros((1 << BITS) + 1)
        w[at] = weight
        make = Features()
        for b in batches:
            s = np.array([w[make.ids(t)].sum() for t in b.column(raw).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.record_batch([*[b.column(c) for c in stay], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                  [*stay, "score", "predicted"])

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] | None = None) -> DataFrame:
    """Trains on the labelled rows of `docs` and scores all of them."""
    return score(docs, stored(train(docs, labels, id_col, text_col), "toxicity"), id_col, text_col, keep)
