"""Hard negatives, token counts and turn repair against brute force, and on odd tables."""

import hashlib
import math
import random
from functools import cache

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries, turn_repair
from corpuslens.llm.hard_negatives import Runs, hard_negatives
from corpuslens.llm.token_counts import TokenCounter, count_tokens, merge_count
from corpuslens.llm.turn_repair import repair, repair_digests

SMOKE = "/root/testdata/sf0.001"
CLASHES = ("Score", "rid", "q", "dims", "norm", "windows", "unit", "side", "i", "j", "blocks", "anchor", "name", "rank", "is_anchor", "cell", "angle",
           "key", "step", "edit", "cost", "fault", "digest", "new_role", "illegal", "audit", "other_id", "n_tokens", "n_bytes", "over_limit", "value", "ident")


def wide(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def rows_of(df):
    return sorted(map(repr, df.collect()))


# Token counts

def texts(n=1500):
    rnd = random.Random(5)
    parts = [*"abcdefgh THE's  'll \t\n\x0b\x1céßİΣςÄ́각가ｆ１２3٣ǆ😀👍🏽‍…—.!?,<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the ", "ing"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 30_000, "ab " * 50_000, "́ ́a"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer
    file = str(public_tokenizers.path(name))
    want = [len(e) for e in Tokenizer.from_file(file).encode_batch(texts(), add_special_tokens=False)]
    assert TokenCounter(file).counts(pa.array(texts())).tolist() == want


def test_merges_equal_a_plain_loop():
    rnd = random.Random(2)
    for _ in range(300):
        ranks = {}
        for rank in range(rnd.randint(0, 12)):
            ranks.setdefault(rnd.randrange(6) * 100 + rnd.randrange(6), (rank, rnd.randrange(6)))
        word = [rnd.randrange(4) for _ in range(rnd.randint(1, 25))]
        left = word.copy()
        while True:
            at = min(((ranks[a * 100 + b][0], i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a * 100 + b in ranks), default=None)
            if at is None:
                break
            left[at[1]:at[1] + 2] = [ranks[left[at[1]] * 100 + left[at[1] + 1]][1]]
        assert merge_count(word, ranks, 100) == len(word) - len(left)


def test_a_file_of_another_kind_is_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"type": "Unigram", "vocab": []}, "added_tokens": []}')
    with pytest.raises(ValueError, match="byte-pair"):
        TokenCounter(str(tmp_path / "t.json"))


def test_token_query_equals_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    got = queries.QUERIES["op12_token_counts"](spark, SMOKE).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(lib.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_token_counts_of_odd_tables(spark):
    file, shape = queries.tokenizer_path(), "doc_id long, text string"
    odd = spark.createDataFrame([(1, None), (None, "a b"), (1, None), (2, ""), (2, "x " * 3000)], shape)
    assert rows_of(count_tokens(odd, file).select("n_bytes", "n_tokens", "over_limit")) == rows_of(spark.createDataFrame(
        [(0, 0, False)] * 3 + [(3, 2, False), (6000, 3000, True)], "n_bytes long, n_tokens long, over_limit boolean"))
    assert rows_of(count_tokens(wide(odd), file)) == rows_of(count_tokens(odd, file))
    assert count_tokens(odd.limit(0), file).count() == 0


# Turn repair

def plain_repair(rows):
    """Faults, illegal pairs, cost, audit and lines of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @cache
    def best(i, state, inserts=0):
        ways = []
        if inserts < 3:
            c, a, t = best(i, made[state][0], inserts + 1)
            ways.append((c + 3, "I" + a, (made[state] + ":",) + t))
        if i == len(rows):
            if state in "a":
                ways.append((0, "", ()))
            return min(ways, default=(10**9, "", ()))
        _, role, text = rows[i]
        c, a, t = best(i + 1, state)
        ways.append((c + 4, "D" + a, t))
        if faults[i] not in ("blank", "duplicate"):
            cut = 3 * (faults[i] == "truncated")
            if (state, role[:1]) in legal:
                c, a, t = best(i + 1, legal[state, role[:1]])
                ways.append((c + cut, "K" + a, (f"{role}:{text}",) + t))
            c, a, t = best(i + 1, made[state][0])
            ways.append((c + 3 + cut, "R" + a, (f"{made[state]}:{text}",) + t))
        return min(ways)

    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return faults, sum(p not in ("su", "ua", "au") for p in pairs), best(0, "")


def wild_turns(n, seed):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "solo"]
    said = ["Yes.", "No!", "cut off", "", " \n", None, "Why?  \t", "Done.\n", "Yes."]
    return [(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rnd.choice([None, *range(-3, 12)]), rnd.choice(roles), rnd.choice(said)) for _ in range(n)]


def told_order(turn, role, text):
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_brute_force(spark, seed):
    rows = wild_turns(70, seed)
    got = {r.conv_id: r for r in repair_digests(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort(key=lambda r: told_order(*r))
        faults, illegal, (cost, audit, lines) = plain_repair(turns)
        known = [t for t, _, _ in turns if t is not None]
        r = got[conv]
        assert (r.audit, r.cost, r.illegal) == (audit, cost, illegal)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]


def test_long_conversations_spill(monkeypatch):
    monkeypatch.setattr(turn_repair, "ROWS_HELD", 7)
    monkeypatch.setattr(turn_repair, "ROWS_OUT", 5)
    rnd = random.Random(9)
    kinds = [[(rnd.randrange(4), rnd.randrange(3)) for _ in range(n)] for n in (1, 60, 7, 8, 200)]
    rows = [(str(c), len(conv) - 1 - i, k * 3 + f) for c, conv in enumerate(kinds) for i, (k, f) in enumerate(reversed(conv))]
    frames = [pd.DataFrame(rows[i:i + 13], columns=["key", "rid", "kind"]) for i in range(0, len(rows), 13)]
    got = pd.concat(list(turn_repair._stream(iter(frames))))
    for c, conv in enumerate(kinds):
        mine = got[got.key == str(c)]
        turns = [(i, "suax"[k], "" if f == 1 else f"text {i}" + ("" if f == 2 else ".")) for i, (k, f) in enumerate(conv)]
        _, illegal, (cost, audit, _) = plain_repair(turns)
        assert ("".join(mine.edit), mine.cost.sum(), mine.illegal.sum()) == (audit, cost, illegal)
        assert mine.step.tolist() == list(range(len(mine))) and mine.rid[mine.rid >= 0].tolist() == list(range(len(conv)))


def test_repaired_turns_and_odd_tables(spark):
    shape = "conv_id string, turn int, role string, text string"
    rows = spark.createDataFrame([("x", 0, "system", "Be kind."), ("x", 1, "assistant", "Hello."), ("x", 2, "user", " "), (None, None, None, None)], shape)
    turns, edits = repair(rows)
    assert {(r.conv_id, r.turn, r.fault) for r in turns.collect()} == {("x", 0, None), ("x", 1, None), ("x", 2, "blank"), (None, None, "blank")}
    got = sorted(edits.where("conv_id = 'x'").collect(), key=lambda r: r.step)
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("D", "user", " ")]
    assert rows_of(repair_digests(wide(rows))) == rows_of(repair_digests(rows))
    assert repair_digests(rows.limit(0)).count() == 0
    long = spark.createDataFrame([("x", i, "user" if i % 2 else "assistant", "long " * 40_000 + ".") for i in range(3)], shape)
    got = repair_digests(long).first()
    assert (got.audit, got.duplicate, got.cost) == ("IKKDI", 1, 10)


# Hard negatives

def plain_negatives(rows, positives=5, negatives=5):
    """Rows (vec_id, vector, label, is anchor), all fit to take part."""
    quant = [[math.floor(256 * x) for x in v] for _, v, _, _ in rows]
    order = lambda s, i: (-s, rows[i][0] is None, rows[i][0] or 0, i)
    out = []
    for a, (ident, vec, label, is_anchor) in enumerate(rows):
        if not is_anchor:
            continue
        score = {i: sum(x * y for x, y in zip(quant[a], quant[i], strict=True)) for i, r in enumerate(rows) if i != a and len(r[1]) == len(vec)}
        kin = sorted((i for i in score if rows[i][2] == label), key=lambda i: order(score[i], i))[:positives]
        for p in kin:
            far = [i for i in score if rows[i][2] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for rank, n in enumerate(sorted(far, key=lambda i: order(score[i], i))[:negatives], 1):
                out.append((ident, rows[p][0], rank, rows[n][0], score[p], score[n]))
    return sorted(map(repr, out))


def clustered(n, dims, seed, scale=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, scale) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, [x + rnd.gauss(0, scale * 0.2) for x in c], rnd.randrange(3), i % 7 == 0))
    rows += [(rows[0][0], rows[0][1], rows[0][2], True), (None, rows[3][1], rows[3][2], False), (None, rows[4][1], 2, False),
             (n, [0.0] * dims, 0, True), (n + 1, [0.0] * dims, 1, False), (n + 2, [1.0] * (dims + 1), 1, True), (n + 3, [1.0] * (dims + 1), 1, False),
             (n + 4, [0.99] * (dims + 1), 2, False), (n + 5, [], 0, True), (n + 6, [], 0, False), (n + 7, [], 1, False)]
    return rows


SHAPE = "vec_id long, embedding array<double>, label int, is_a boolean"


@pytest.mark.parametrize("dims,scale", [(2, 1.0), (8, 0.3), (16, 1e6)])
def test_negatives_equal_brute_force(spark, dims, scale):
    rows = clustered(300, dims, dims, scale)
    got = hard_negatives(spark.createDataFrame(rows, SHAPE).repartition(3), F.col("is_a"), block_bytes=6000)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_odd_tables(spark):
    rows = clustered(60, 4, 1)
    bad = [(900, None, 1, True), (901, [1.0, None, 0.0, 0.0], 1, True), (902, [float("nan"), 1.0, 1.0, 1.0], 1, True), (903, [float("inf"), 0.0, 0.0, 0.0], 1, False),
           (904, [1.0, 1.0, 1.0, 1.0], None, True), (905, [1e300, 0.0, 0.0, 0.0], 1, True), (None, None, None, None)]
    d = spark.createDataFrame(rows + bad, SHAPE)
    got = hard_negatives(d, F.col("is_a"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(rows)
    assert rows_of(hard_negatives(wide(d), F.col("is_a"))) == rows_of(got)
    assert hard_negatives(d.limit(0), F.col("is_a")).count() == 0


def test_bounds_hold_every_score():
    import numpy as np

    from corpuslens.llm.hard_negatives import directions
    rng = np.random.default_rng(3)
    for dims in (1, 3, 40):
        v = np.floor(256 * rng.standard_normal((700, dims)) * rng.choice([0.001, 1.0, 50.0], (700, 1)))
        v[5], v[6:40] = 0, v[41]
        norms = np.sqrt((v * v).sum(1))
        angles = np.arccos(np.clip((v / np.maximum(norms, 1)[:, None]) @ directions(dims).T, -1, 1))
        order = np.argsort(angles[:, 0])
        v, norms, angles = v[order], norms[order], angles[order]
        runs = Runs(angles, norms)
        low, high = runs.bounds(angles, norms, dims)
        score = v @ v.T
        for k, at in enumerate(runs.starts.tolist()):
            part = score[:, at:at + 256]
            assert (part >= low[:, k, None]).all() and (part <= high[:, k, None]).all()
