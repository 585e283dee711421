"""Near duplicates by SimHash with a Gray-order hierarchical index.

Distinct fingerprints are put under four rotations.  Two fingerprints that
differ in at most three of four 16-bit quarters' bits agree in one quarter,
so in one rotation they lie under the same top node (the leading 16 bits).
Inside a top node the fingerprints are sorted by Gray rank, which keeps every
common prefix together, and each prefix is a node of a hierarchy that factors
out the bits all its members share (mask and pattern).  Pairs of nodes are
walked downwards: the differences in bits that both sides share accumulate;
beyond the limit the whole group pair is dropped, and where even the
unshared bits cannot exceed it the whole group pair is linked at once.

A top node with very many members is cut at longer prefixes into blocks; the
same mask-and-pattern test drops pairs of blocks before any member moves.
Tasks return a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WS, components, own_name, ship, stored

ship(__name__)

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Members of a block (a top node or a part of one) at most, and pairs of nodes compared at a time.
BLOCK_ROWS, PAIRS_AT_ONCE = 4096, 1 << 19
LEVELS = (16, 20, 24, 28, 32, 40, 48, 64)
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, words_per: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of the shingle hashes have it."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - words_per + 1)
    first, last = np.concatenate([[0], ends])[:n].tolist(), (ends[-n:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, HASHES_AT_ONCE):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(first[i:i + HASHES_AT_ONCE], last[i:i + HASHES_AT_ONCE], strict=True)], np.uint64)
        # Eight bits of every hash at once: byte lanes of a 64-bit word hold up to 255 ones each.
        for bit in range(8):
            lanes = (h >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
            counts[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > n).tolist())


def with_fingerprints(docs: DataFrame, text_col: str, out: str, keep: list[str], words_per: int = SHINGLE_WORDS) -> DataFrame:
    """keep + `out` (the fingerprint as a signed long); null texts count as empty."""
    raw = own_name(docs.columns, "_raw")
    src = docs.select(*keep, F.col(text_col).cast("binary").alias(raw))
    schema = src.select(*keep, F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, words_per) for t in b.column(raw).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(f)], [*keep, out])

    return src.mapInArrow(run, schema)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order (uint64)."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        for r in range(4):
            code = (fp << np.uint64(16 * r)) | (fp >> np.uint64((64 - 16 * r) % 64)) if r else fp
            node = (r << 16) + (code >> np.uint64(48)).astype(np.int64)
            yield pa.record_batch([pa.array(node), pa.array(gray_rank(code).view(np.int64)),
                                   pa.array(code.view(np.int64)), b.column("fp")], ["node", "gray", "code", "fp"])


class Forest:
    """Union by smallest member over arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.parent[a], self.parent[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges [first, first + count), and for each element the number of its range."""
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + at, owner


def search(unit: np.ndarray, side: np.ndarray, code: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Parent of each row in a spanning forest of the links inside units.

    Rows come sorted by (unit, side, Gray rank of code).  A unit with one side
    is compared with itself, one with two sides across them.
    """
    n = len(code)
    forest = Forest(n)
    if n < 2:
        return forest.parent
    new_unit = np.append(True, unit[1:] != unit[:-1])
    new_root = new_unit | np.append(True, side[1:] != side[:-1])
    starts, both, either = [], [], []
    for bits in LEVELS:
        cut = new_root.copy()
        cut[1:] |= (code[1:] ^ code[:-1]) >> np.uint64(64 - bits) != 0
        s = np.flatnonzero(cut)
        starts.append(s)
        both.append(np.bitwise_and.reduceat(code, s))
        either.append(np.bitwise_or.reduceat(code, s))

    def end(level, k):
        s = starts[level]
        return np.append(s, n)[k + 1]

    def kids(level, k):
        """First child and number of children, on the next level, of nodes k."""
        a = np.searchsorted(starts[level + 1], starts[level][k])
        return a, np.searchsorted(starts[level + 1], end(level, k)) - a

    def walk(level, a, b):
        for i in range(0, len(a), PAIRS_AT_ONCE):
            yield from step(level, a[i:i + PAIRS_AT_ONCE], b[i:i + PAIRS_AT_ONCE])

    def step(level, a, b):
        free = (both[level][a] ^ either[level][a]) | (both[level][b] ^ either[level][b])
        least = np.bitwise_count((both[level][a] ^ both[level][b]) & ~free)
        near = least <= max_bits
        a, b, most = a[near], b[near], (least + np.bitwise_count(free))[near]
        whole = most <= max_bits
        if whole.any():
            x, y = a[whole], b[whole]
            head = starts[level][x]
            for k in (x, y):
                leaf, owner = _ranges(starts[level][k], end(level, k) - starts[level][k])
                yield leaf, head[owner]
        a, b = a[~whole], b[~whole]
        if level + 1 == len(LEVELS) or not len(a):
            return
        (fa, na), (fb, nb) = kids(level, a), kids(level, b)
        pair, owner = _ranges(np.zeros(len(a), np.int64), na * nb)
        ka, kb = fa[owner] + pair // nb[owner], fb[owner] + pair % nb[owner]
        ordered = (a[owner] != b[owner]) | (ka <= kb)
        yield from walk(level + 1, ka[ordered], kb[ordered])

    # Roots of the hierarchy: the runs of (unit, side); a cross unit starts with its two sides.
    roots = np.flatnonzero(new_root)
    top = np.searchsorted(starts[0], roots)
    top_end = np.searchsorted(starts[0], np.append(roots[1:], n))
    owner_unit = np.cumsum(new_unit)[roots]
    two = np.append(owner_unit[1:] == owner_unit[:-1], False)
    alone = ~two & ~np.append(False, two[:-1])

    def begin(x0, x1, y0, y1, same):
        nx, ny = x1 - x0, y1 - y0
        pair, owner = _ranges(np.zeros(len(nx), np.int64), nx * ny)
        a, b = x0[owner] + pair // ny[owner], y0[owner] + pair % ny[owner]
        return (a[a <= b], b[a <= b]) if same else (a, b)

    i = np.flatnonzero(alone)
    j = np.flatnonzero(two)
    for a, b in (begin(top[i], top_end[i], top[i], top_end[i], True),
                 begin(top[j], top_end[j], top[j + 1], top_end[j + 1], False)):
        for x, y in walk(0, a, b):
            forest.link(x, y)
    return forest.parent


def _links(max_bits: int):
    def run(batches):
        held = []  # rows of a unit may go on in the next batch

        def found(t: pa.Table):
            fp = t.column("fp").to_numpy()
            parent = search(t.column("unit").to_numpy(), t.column("side").to_numpy(),
                            t.column("code").to_numpy().view(np.uint64), max_bits)
            at = np.flatnonzero(parent != np.arange(len(parent)))
            return pa.record_batch([pa.array(fp[at]), pa.array(fp[parent[at]])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            unit = t.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1])) if (np.diff(unit) >= 0).all() else \
                int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            if cut:
                yield found(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held))
    return run


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("code", 64 - bits) if bits < 64 else F.col("code")


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints reachable by steps of at most `max_bits` (<= 3) bits.

    fps: (fp long), distinct.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("four quarters find pairs of at most three differing bits")
    rows = stored(fps.mapInArrow(_rotated, "node long, gray long, code long, fp long"), "rotations")
    columns = ["unit", "side", "gray", "code", "fp"]
    # Blocks: the shortest prefix under which a top node has few enough members.
    size = rows.groupBy("node").count().where(F.col("count") > block_rows).select("node")
    hot_nodes = stored(size, "hot-nodes")
    calm = rows.join(hot_nodes, "node", "left_anti").select(F.col("node").alias("unit"), F.lit(0).alias("side"), *columns[2:])
    parts = [calm]
    pending = rows.join(hot_nodes, "node", "left_semi")
    blocks = None
    for bits in (24, 32, 40, 48, 56, 64):
        if pending.isEmpty():
            break
        here = pending.withColumn("bits", F.lit(bits)).withColumn("prefix", _prefix(bits))
        big = stored(here.groupBy("node", "prefix").count().where(F.col("count") > block_rows).select("node", "prefix"), "hot")
        done = here.join(big, ["node", "prefix"], "left_anti")
        blocks = done if blocks is None else blocks.unionByName(done)
        pending = here.join(big, ["node", "prefix"], "left_semi").drop("bits", "prefix")
    if blocks is not None:
        blocks = stored(blocks, "blocks")
        nodes = blocks.groupBy("node", "bits", "prefix").agg(F.bit_and("code").alias("all"), F.bit_or("code").alias("any"))
        left, right = (nodes.select("node", *[F.col(c).alias(f"{c}_{s}") for c in ("bits", "prefix", "all", "any")]) for s in "lr")
        free = F.col("all_l").bitwiseXOR(F.col("any_l")).bitwiseOR(F.col("all_r").bitwiseXOR(F.col("any_r")))
        least = F.bit_count(F.col("all_l").bitwiseXOR(F.col("all_r")).bitwiseAND(F.bitwise_not(free)))
        key_l, key_r = F.struct("bits_l", "prefix_l"), F.struct("bits_r", "prefix_r")
        pairs = left.join(right, "node").where((key_l <= key_r) & (least <= max_bits))
        pairs = pairs.withColumn("unit", F.xxhash64("node", "bits_l", "prefix_l", "bits_r", "prefix_r").bitwiseOR(F.lit(1 << 62)))
        ends = pairs.select("node", "unit", F.inline(F.array_distinct(F.array(
            F.struct(F.lit(0).alias("side"), F.col("bits_l").alias("bits"), F.col("prefix_l").alias("prefix")),
            F.struct(F.when(key_l == key_r, F.lit(0)).otherwise(F.lit(1)).alias("side"),
                     F.col("bits_r").alias("bits"), F.col("prefix_r").alias("prefix"))))))
        parts.append(blocks.join(ends, ["node", "bits", "prefix"]).select(*columns))
    todo = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (todo.repartition("unit").sortWithinPartitions("unit", "side", "gray")
            .mapInArrow(_links(max_bits), "a long, b long"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = SHINGLE_WORDS,
           max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, key, fp, component_id, kept), one per document.

    Fingerprints link at `max_bits` or fewer differing bits; component_id is
    the smallest identifier reachable over links, the document's own included
    (null only if none of them has one).  Of each component one document is
    kept: the one with the smallest identifier, then key (the text's SHA-256);
    rows that agree in both are all marked, see `near_dedup`.  Null texts count as empty; texts without words have
    fingerprint zero, linked like any other.  Empty input, empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = stored(with_fingerprints(keyed, "text", "fp", ["doc_id", "key"], words_per), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per = stored(rows.groupBy("fp").agg(F.min(first).alias("low")), "distinct")
    roots = components(near_links(per.select("fp"), max_bits))
    member = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = member.groupBy("root").agg(F.min("low").alias("best"))
    known = member.select("fp", "root").join(low, "root").select("fp", "best")
    out = rows.join(known, "fp")
    return out.select("doc_id", "key", "fp", F.col("best.doc_id").alias("component_id"),
                      (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("kept"))


def _text_key(text_col: str) -> Column:
    """The text's SHA-256; a null text has that of no bytes and a mark of its own."""
    return F.concat(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), F.when(F.col(text_col).isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))


def near_dedup(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with one document of each group of near duplicates.

    Rows that agree in identifier and text are one document, of which any row
    stays.  Null identifiers are identifiers like others; nulls, empty texts
    and empty tables are as in `groups`.
    """
    id_col = settings.get("id_col", "doc_id")
    key, rn, doc = (own_name(docs.columns, n) for n in ("_key", "_rn", "_doc"))
    keep = groups(docs, **settings).where("kept").select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    mine = own_name(docs.columns, "_mine")
    out = docs.withColumn(mine, _text_key(settings.get("text_col", "text")))
    out = out.join(keep, (F.col(mine) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(doc)))
    from pyspark.sql import Window
    w = Window.partitionBy(id_col, mine).orderBy(F.lit(0))
    return out.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).select(*docs.columns)
