"""The scored pattern-token graph of the PII operator against a plain loop, and the query's columns."""

import random

import pytest

from corpuslens.llm import pii, queries


def plain_bootstrap(seeds, unknown, share, needed, token_score):
    """Marks (token, pattern, kind) of the same rules on dictionaries."""
    kinds = pii.KINDS
    counts = {}
    for _, pattern, kind in set(seeds):
        counts.setdefault(pattern, dict.fromkeys(kinds, 0))[kind] += 1
    counts = {p: c for p, c in counts.items() if max(c.values()) >= needed}
    unknown = {(t, p) for t, p in unknown if p in counts}
    size = {p: sum(c.values()) + sum(q == p for _, q in unknown) for p, c in counts.items()}
    score = {p: {k: c[k] / size[p] for k in kinds} for p, c in counts.items()}
    over_p, over_t = dict.fromkeys(counts, ()), {t: () for t, _ in unknown}
    for _ in range(pii.ROUNDS):
        of = {t: [p for u, p in unknown if u == t] for t in over_t}
        token = {t: {k: sum(score[p][k] for p in ps) / len(ps) for k in kinds} for t, ps in of.items()}
        score = {p: {k: (counts[p][k] + sum(token[t][k] for t, q in unknown if q == p)) / size[p] for k in kinds} for p in counts}
        now_p = {p: tuple(k for k in kinds if score[p][k] >= share and counts[p][k] >= needed) for p in counts}
        now_t = {t: tuple(k for k in kinds if token[t][k] >= token_score) for t in over_t}
        done = now_p == over_p and now_t == over_t
        over_p, over_t = now_p, now_t
        if done:
            break
    return {(t, p, over_p[p][0]) for t, p in unknown if over_p[p] and over_p[p][0] in over_t[t]}


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    kind = {f"p{i}": rnd.choice(pii.KINDS) for i in range(25)}
    seeds = [(f"seed{rnd.randrange(60)}", p, kind[p] if rnd.random() < 0.95 else "ip") for p in kind for _ in range(rnd.randint(1, 25))]
    seeds = list({(t, p): (t, p, k) for t, p, k in seeds}.values())
    unknown = [(f"new{rnd.randrange(300)}", f"p{rnd.randrange(25)}") for _ in range(400)]
    unknown += [(f"odd{i}", "p0") for i in range(3)]
    settings = {"pattern_score": 0.6, "pattern_seeds": 4, "token_score": 0.55}
    s = spark.createDataFrame(seeds, "token string, pattern string, kind string")
    known = pii.seeded_patterns(s, 4)
    u = spark.createDataFrame(unknown, "token string, pattern string").join(known.select("pattern"), "pattern", "left_semi")
    got = {tuple(r) for r in pii.bootstrap(known, u, **settings).select("token", "pattern", "kind").collect()}
    want = plain_bootstrap(seeds, unknown, 0.6, 4, 0.55)
    assert got == want and want


@pytest.mark.parametrize("seed", range(3))
def test_patterns_of_mixed_seeds_mark_nothing(spark, seed):
    """No score is above the largest share of a kind in the seeds of a pattern: such graphs are left out, others stay whole."""
    rnd = random.Random(seed)
    seeds = [(f"seed{p}.{i}", f"p{p}", pii.KINDS[i % 2 if i < 2 else p % 4]) for p in range(20) for i in range(rnd.randint(6, 15))]
    known = pii.seeded_patterns(spark.createDataFrame(seeds, "token string, pattern string, kind string"), 4)
    most = max(max(r[f"n_{k}"] for k in pii.KINDS) / r.seeds for r in known.collect())
    unknown = [(f"new{rnd.randrange(60)}", f"p{rnd.randrange(20)}") for _ in range(300)]
    assert most < 1 and not plain_bootstrap(seeds, unknown, most + 0.01, 4, most + 0.01)
    assert pii.able_patterns(known, pattern_score=most + 0.01, token_score=0.5).isEmpty()
    assert pii.able_patterns(known, pattern_score=0.5, token_score=most + 0.01).isEmpty()
    assert pii.able_patterns(known, pattern_score=most, token_score=most, rounds=3).count() == known.count() > 0


def test_slots_of_mixed_seeds_give_no_rows(spark, monkeypatch):
    token = {"email": "u{0}@example.org", "ip": "10.0.0.{0}", "phone": "+1 366 555-10{0}"}
    mixed = [(100 * n + i, f"so of the {t.format(10 + i)} said") for n, t in enumerate(token.values()) for i in range(6)]
    plain = [(1000 + i, f"so of the word{i} said") for i in range(50)]
    clear = [(2000 + i, f"write mail to u{i}@example.com, please") for i in range(30)] + [(2100, "write mail to nobody(at)example.com, please")]
    made, write = {}, pii.stored

    def stored(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(pii, "stored", stored)
    find = lambda rows: {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = find(mixed + plain)
    assert made["patterns"].isEmpty() and made["maybe"].isEmpty() and made["said"].isEmpty()
    assert all(r.found == r.base for r in got.values()) and sum(len(r.base[k]) for r in got.values() for k in pii.KINDS) == 18
    got = find(mixed + plain + clear)  # a pattern of one kind: the mixed ones are in the graph again
    assert made["said"].where("token LIKE 'word%'").count() == 100
    assert [len(got[2100].found[k]) for k in pii.KINDS] == [1, 0, 0, 0] and all(got[i].found == got[i].base for i, _ in mixed + plain)


def test_query_columns(spark):
    got = queries.QUERIES["op7_pii"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in got.collect():
        spans = [s for s in r.spans.split(",") if s]
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone
        assert [s.split(":")[0] for s in spans] == sorted((s.split(":")[0] for s in spans), key=pii.KINDS.index)
