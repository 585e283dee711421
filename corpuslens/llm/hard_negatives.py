"""Hard negatives by angular triangle filtering.

Every vector is quantised and stored with its norm and its angles to a few
reference directions.  By the triangle inequality an anchor's and a row's
angles to one reference bound the angle between them; cosines of those bounds,
times the norms, with a margin for rounding, bound the integer score.  Rows are
sorted by nearest reference and angle and worked through in runs; only where a
run's window of scores overlaps an anchor's is anything scored, in integers.

Anchors meet rows block by block: a pair of blocks is one unit of work of
bounded size, keyed by its numbers, so no key is hot.  Each unit returns the
few best rows of every window; a window function with a partial limit merges
them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import ship, stored

ship(__name__)

#: Reference directions and their seed; bytes of quantised components in a block; rows of a run that shares its bounds.
REFERENCES, SEED, BLOCK_BYTES, RUN_ROWS = 16, 20240611, 1 << 22, 256
#: Candidates that a unit gathers before it keeps the best only, and those of a chunk of anchors scored at once.
PENDING, CHUNK = 1 << 18, 512
#: Squared norms from here on could overflow a long score, so such rows take no part.
NORM_LIMIT = float(1 << 62)
TARGET, ROW = 0, 1


def directions(dims: int, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors, the same for a dimension on every machine; the axes' own signs decide nothing."""
    drawn = np.random.default_rng([SEED, dims]).standard_normal((count, dims))
    return drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300)


def slack(dims: int) -> float:
    """More than rounding can move an angle: a cosine's error e moves it by at most sqrt(2e) and a little."""
    return 2 * float(np.sqrt(2 * (dims + 8) * 2.0**-50))


def _measure(count: int):
    def run(batches):
        drawn = {}
        for b in batches:
            rows = b.column("q")
            sizes = rows.value_lengths().to_numpy()
            flat = rows.flatten().to_numpy()
            ends = np.cumsum(sizes)
            angles, cells = np.zeros((b.num_rows, count)), np.zeros(b.num_rows, np.int32)
            for d in np.unique(sizes).tolist():
                if d not in drawn:
                    drawn[d] = directions(d, count)
                at = np.flatnonzero(sizes == d)
                v = flat[(ends[at] - d)[:, None] + np.arange(d)].astype(np.float64)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                angles[at] = np.arccos(np.clip((v / np.maximum(norm, 1.0)) @ drawn[d].T, -1, 1))
                cells[at] = angles[at].argmin(axis=1)
            nearest = angles[np.arange(len(cells)), cells]
            yield pa.record_batch([b.column("rid"), pa.array(cells), pa.array(nearest), pa.array(list(angles), pa.list_(pa.float64()))],
                                  ["rid", "cell", "angle", "angles"])
    return run


class Runs:
    """Rows of a block, in order of cell and angle, in runs with their ranges of angles and norms."""

    def __init__(self, angles: np.ndarray, norms: np.ndarray):
        self.starts = np.arange(0, len(norms), RUN_ROWS)
        self.low, self.high = np.minimum.reduceat(angles, self.starts), np.maximum.reduceat(angles, self.starts)
        self.least, self.most = np.minimum.reduceat(norms, self.starts), np.maximum.reduceat(norms, self.starts)

    def bounds(self, angles: np.ndarray, norms: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of every anchor (angles, norms) with any row of every run; safe against rounding."""
        margin = slack(dims)
        near, far = np.zeros((len(norms), len(self.starts))), np.full((len(norms), len(self.starts)), np.pi)
        for r in range(angles.shape[1]):
            a, low, high = angles[:, r, None], self.low[None, :, r], self.high[None, :, r]
            np.maximum(near, np.maximum(a - high, low - a), out=near)
            np.minimum(far, np.where(a + low > np.pi, 2 * np.pi - a - low, np.where(a + high > np.pi, np.pi, a + high)), out=far)
        top, bottom = np.cos(np.maximum(near - margin, 0)), np.cos(np.minimum(far + margin, np.pi))
        most = norms[:, None] * np.where(top >= 0, self.most, self.least) * top
        least = norms[:, None] * np.where(bottom >= 0, self.least, self.most) * bottom
        room = 1 + 1e-9 * norms[:, None] * self.most
        return least - room, most + room


def _scores(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Integer inner products; floating point where all partial sums are exact."""
    if limit < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The first `count` rows of each window by score (descending), identifier (null last) and row."""

    def __init__(self, windows: int, count: int):
        self.count, self.held = count, []
        self.pending = 0
        self.floor = np.full(windows, np.iinfo(np.int64).min)  # a score below this can't enter any more

    def add(self, window, score, null, ident, rid) -> None:
        self.held.append((window, score, null, ident, rid))
        self.pending += len(window)
        if self.pending > PENDING:
            self.keep()

    def keep(self) -> tuple:
        """Columns of what is left; floors rise to the last place of every full window."""
        if not self.held:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool), none, none
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        window, score, null, ident, rid = columns
        order = np.lexsort((rid, ident, null, ~score, window))
        first = np.append(True, np.diff(window[order]) != 0)
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        last = order[rank == self.count - 1]
        self.floor[window[last]] = score[last]
        kept = tuple(c[order[rank < self.count]] for c in columns)
        self.held, self.pending = [kept], len(kept[0])
        return kept


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _search(count: int, same: bool):
    """Best rows of the windows of each unit's anchors.

    An anchor brings windows of scores (from, to); `same` tells whether rows of
    its own label or those of other labels count.  The row itself never does.
    """
    def unit_best(t: pa.Table):
        side = t.column("side").to_numpy()
        split = int(np.searchsorted(side, ROW))
        if split in (0, len(side)):
            return
        q, angles, norms = _vectors(t.column("q")), _vectors(t.column("angles")), t.column("norm").to_numpy()
        labels = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        rid, ident = t.column("rid").to_numpy(), t.column("ident").fill_null(0).to_numpy()
        null = t.column("ident").is_null().to_numpy()
        dims = q.shape[1]
        windows = t.column("windows").combine_chunks().slice(0, split)
        owner = np.repeat(np.arange(split), windows.value_lengths().to_numpy())
        flat = windows.flatten()
        from_, to, name = (flat.field(k).to_numpy() for k in ("from", "to", "name"))
        # Anchors without a window have nothing to look for.
        rows = slice(split, None)
        row_q, row_label, row_rid, row_null, row_ident = q[rows], labels[rows], rid[rows], null[rows], ident[rows]
        runs = Runs(angles[rows], norms[rows])
        best = Best(len(owner), count)
        first_of = np.searchsorted(owner, np.arange(split + 1))
        limit = float(norms[:split].max() * norms[rows].max())
        for x in range(0, split, CHUNK):
            y = min(split, x + CHUNK)
            low, high = runs.bounds(angles[x:y], norms[x:y], dims)
            mine = np.arange(first_of[x], first_of[y])
            whose = owner[mine] - x
            if not len(mine):
                continue
            # Promising runs first, so that floors rise early.
            for k in np.argsort(-high.max(axis=0), kind="stable").tolist():
                need = np.maximum(from_[mine], best.floor[mine])
                open_ = (high[whose, k] >= need) & (low[whose, k] <= to[mine])
                if not open_.any():
                    continue
                asked = np.unique(whose[open_])
                at = slice(int(runs.starts[k]), int(runs.starts[k]) + RUN_ROWS)
                score = _scores(q[x + asked], row_q[at], limit)
                fits = (labels[x + asked][:, None] == row_label[at][None]) == same
                fits &= rid[x + asked][:, None] != row_rid[at][None]
                place = np.searchsorted(asked, whose[open_])
                s, w = score[place], mine[open_]
                hit = fits[place] & (s >= need[open_][:, None]) & (s <= to[w][:, None])
                i, j = np.nonzero(hit)
                if len(i):
                    j_ = j + at.start
                    best.add(w[i], s[i, j], row_null[j_], row_ident[j_], row_rid[j_])
            best.keep()
        w, s, n, d, r = best.keep()
        if len(w):
            yield pa.record_batch([pa.array(rid[:split][owner[w]]), pa.array(name[w]), pa.array(s), pa.array(d, mask=n), pa.array(r)],
                                  ["anchor", "name", "score", "ident", "rid"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            unit = t.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.append(0, np.flatnonzero(unit[1:] != unit[:-1]) + 1)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from unit_best(t.slice(x, y - x).combine_chunks())
            held = t.slice(int(cuts[-1]))
        if held is not None:
            yield from unit_best(held.combine_chunks())
    return run


def _blocked(rows: DataFrame, keys: list[str], block_bytes: int, other: str) -> DataFrame:
    """Rows with their block's number `own` and the number of blocks of their key, named for the other side."""
    size = rows.groupBy(*keys).agg(F.sum(F.lit(64) + 8 * F.col("dims")).alias("bytes"))
    size = size.select(*keys, F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    return size.select(*keys, F.col("blocks").alias(other))


def _best(targets: DataFrame, rows: DataFrame, keys: list[str], count: int, same: bool, block_bytes: int) -> DataFrame:
    """(anchor, name, score, ident, rid, rank): the first `count` rows of every window of `targets`."""
    n_targets, n_rows = _blocked(targets, keys, block_bytes, "i_blocks"), _blocked(rows, keys, block_bytes, "j_blocks")
    blocks = stored(n_targets.join(n_rows, keys), "blocks")
    no_windows = F.array().cast(targets.schema["windows"].dataType).alias("windows")
    own = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["rid", "ident", "label", "q", "norm", "cell", "angle", "angles"]
    left = targets.join(blocks, keys).withColumn("i", own("i_blocks")).withColumn("j", every("j_blocks"))
    right = rows.join(blocks, keys).withColumn("j", own("j_blocks")).withColumn("i", every("i_blocks"))
    met = left.select(*keys, "i", "j", F.lit(TARGET).alias("side"), *[c for c in columns if c not in keys], "windows").unionByName(
        right.select(*keys, "i", "j", F.lit(ROW).alias("side"), *[c for c in columns if c not in keys], no_windows))
    unit = [*keys, "i", "j"]
    met = met.repartition(*unit).sortWithinPartitions(*unit, "side", "cell", "angle", "rid")
    met = met.select(F.to_json(F.struct(*unit)).alias("unit"), "side", *columns, "windows")
    found = met.mapInArrow(_search(count, same), "anchor long, name long, score long, ident long, rid long")
    order = W.partitionBy("anchor", "name").orderBy(F.desc("score"), F.asc_nulls_last("ident"), "rid")
    return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count), "best")


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
                   references: int = REFERENCES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x).  Scores are integer inner products,
    higher first, ties by smaller identifier (nulls last).  An anchor (a row
    where `anchor` is true) has as positives its first rows of the same label,
    itself left out; each of these has as negatives the first rows of other
    labels with low * positive <= high * negative <= high * positive for
    share = (low, high).  A positive without such a row gives no row.

    Rows with a null label, a null vector or a null or non-finite component
    take no part, nor do those whose squared norm after scaling reaches 2^62,
    as scores wouldn't fit a long.  Vectors of different length never meet.
    Repeated rows count one by one, also as anchors.  Other columns take no
    part, whatever their names; empty input, empty result.  Nothing is
    approximate: blocks cover all rows, and bounds only skip what can't win.
    """
    low, high = share
    value = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("ident"), F.col(label_col).alias("label"), value.alias("value"),
                          F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    fine = F.col("label").isNotNull() & F.col("value").isNotNull() & F.forall("value", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate("value", F.lit(0.0), lambda a, x: a + (scale * F.abs(x) + 1) * (scale * F.abs(x) + 1))
    rows = rows.where(fine).where(squares < NORM_LIMIT)
    q = F.transform("value", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    rows = rows.select("ident", "label", "is_anchor", q.alias("q"), F.size("value").alias("dims"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    rows = stored(rows, "quantised")
    measured = rows.select("rid", "q").mapInArrow(_measure(references), "rid long, cell int, angle double, angles array<double>")
    rows = stored(rows.join(stored(measured, "angles"), "rid"), "angled")
    anchors = rows.where("is_anchor")
    longs = "array<struct<name:bigint,from:bigint,to:bigint>>"
    all_ = F.array(F.struct(F.lit(0).alias("name"), F.lit(-(1 << 62)).alias("from"), F.lit(1 << 62).alias("to"))).cast(longs)
    kin = _best(anchors.withColumn("windows", all_), rows, ["dims", "label"], positives, True, block_bytes)
    # high * n >= low * p, without overflow: n >= ceil(low * p / high)
    p = F.col("score").cast("decimal(38,0)")
    floor_ = F.ceil(p * low / high).cast("long")
    asked = kin.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("name"), floor_.alias("from"), F.col("score").alias("to"))).alias("windows"))
    asked = anchors.join(asked.withColumnRenamed("anchor", "rid"), "rid").withColumn("windows", F.col("windows").cast(longs))
    far = _best(asked, rows, ["dims"], negatives, False, block_bytes)
    out = far.select("anchor", F.col("name").cast("int").alias("nth"), "rank", F.col("ident").alias("negative_id"), F.col("score").alias("negative_score"))
    kin = kin.select("anchor", F.col("rank").alias("nth"), F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"))
    out = out.join(kin, ["anchor", "nth"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("ident").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
