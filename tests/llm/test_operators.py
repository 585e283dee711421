"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import chat_trees, exact_dedup, mixing, packing, pii, secrets, simhash, toxicity, url_filter, vector_lsh
from corpuslens.llm.common import components
from corpuslens.llm.queries import TOKENIZER, URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _slot int, kept string"


def docs(spark, rows):
    """(doc_id, text[, source]) rows with the other columns of documents and two whose names clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 3, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


TEXTS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (3, "a b c"), (None, "a b c"), (7, None), (8, ""), (1, " "),
         (11, "word " * 20_000), (12, "é 😀 x")]


def test_exact_dedup(spark):
    many = [(100 + i, "same  text") for i in range(700)]  # beyond HOT_ROWS: dealt over slots
    rows = TEXTS + many
    for carry in (False, True):
        got = exact_dedup.exact_dedup(docs(spark, rows), carry=carry).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
        assert len(got) == len(rows)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            ids = by_hash[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_mixing_targets_and_taken(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(0, 60)), rnd.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(1000, None, "e"), (None, "x y z", "a"), (4, rows[4][1], rows[4][2])]
    got = mixing.placed(docs(spark, rows)).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    free = set(order)
    while True:  # excess is shared again until no target is above its cap
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        words = sum(u.words for u in r.uses)
        assert words <= 2 * r.size and all(0 <= u.position <= 1 for u in r.uses)
        taken[r.source] = taken.get(r.source, 0) + words
    assert len(got) == len(rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.5
    at = [r.position for r in mixing.mix(docs(spark, rows)).collect()]
    assert at == sorted(at)
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.placed(docs(spark, [])).count() == 0


def test_toxicity_learns_and_defines_odd_rows(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["Moron,", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None)]
    d = docs(spark, rows + [(None, None), (5000, ""), (5001, "scum " * 100_000)])
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab, keep=("doc_id",)).withColumn(
        "held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) + 3
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i, _ in rows if got[i].held]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert got[5001].predicted == 1 and got[5000].predicted == 0 and got[None].score == got[5000].score
    nothing = toxicity.toxicity(d, lab.limit(0), keep=("doc_id",)).select("score").distinct().collect()
    assert [r.score for r in nothing] == [0.5]


def test_url_filter(spark):
    urls = ["https://x.example.org/es/1", "http://example.org/en/12?q", "https://a.org/", "https://a.ORG", "http://b.com/fr/3#x",
            "http://b.com/de/3", "http://b.com/en/3", "no url", None, "", "http://net/a/b://c", "https://notorg/x"] * 3
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]

    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == rule[1] if rule[0] else got[i].verdict in ("allow", "block")
    one = url_filter.judge(pages.where("url like '%org/'"), URL_RULES)
    assert {r.verdict for r in one.collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_url_model_generalises(spark):
    rows = [(f"s{i}.example", f"/casino/{i}" if i % 2 else f"/article/{i}", "block" if i % 2 else "allow") for i in range(200)]
    labelled = spark.createDataFrame(rows, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://t{i}.test/{'casino' if i % 2 else 'article'}/x{i}") for i in range(60)], "page_id long, url string")
    got = url_filter.judge(pages, (), labelled).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 55 and all(r.rule is None for r in got)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_simhash_fingerprints_and_components(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("red blue sky tree Sun moon".split()) + str(rnd.randrange(40)) for _ in range(150)) for _ in range(6)]
    rows = list(TEXTS) + [(50 + k, t) for k, t in enumerate(base)]
    for k in range(60):
        w = base[k % 6].split()
        w[rnd.randrange(len(w))] = "new"
        rows.append((200 + k, " ".join(w)))
    got = simhash.groups(docs(spark, rows)).collect()
    print_of = {t: brute_fingerprint(t) for _, t in rows}
    prints = sorted(set(print_of.values()))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        if i is not None:
            low[find(print_of[t])] = min(i, low.get(find(print_of[t]), i))
    want = sorted((i is None, i or 0, print_of[t], low[find(print_of[t])]) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in got) == want
    left = simhash.near_dedup(docs(spark, rows))
    assert left.columns == docs(spark, []).columns and left.count() == len(set(map(find, prints)))
    assert simhash.near_dedup(docs(spark, [])).count() == 0


def test_hot_nodes_are_cut_into_blocks_without_losing_links(spark):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    codes = {centre}
    while len(codes) < 500:
        c = centre
        for _ in range(rnd.randint(1, 5)):
            c ^= 1 << rnd.randrange(64)
        codes.add(c)
    codes = sorted(codes | {rnd.getrandbits(64) for _ in range(200)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"), block_rows=16)
    got = {r.node: r.root for r in components(links).collect()}
    x = np.array(codes, np.uint64)
    f = simhash.Forest(len(x))
    f.link(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3))
    mine = [got.get(c, c) for c in signed]
    pairs = {(int(a), b) for a, b in zip(f.parent, mine, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 2000: 2000, 2001: 2000}


def test_reply_trees(spark):
    says = "</s>[INST] ok [/INST] \\ <<ROLE:x>> <\\s> [\\INST] <</ROLE>>"
    rows = [(1, 0, None, "user", says, 1.0), (1, 1, 0, "assistant", says, 0.5), (1, 2, 0, "assistant", "b", 0.9), (1, 3, 1, "user", None, 0.1),
            (1, 4, 2, None, "odd", None), (2, 7, 99, "tool >>", "t", 0.0), (None, 0, None, "user", "n", 0.0),
            (3, 0, 1, "user", "cycle", 0.0), (3, 1, 0, "user", "cycle", 0.0), (4, None, None, "user", "no id", 0.0)]
    rows += [(5, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(70)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = chat_trees.conversations(m).collect()
    path = lambda t: [r for r in sorted(got, key=lambda r: r.depth) if r.tree == t]
    assert [chat_trees.parse_turns(r.formatted)[0] for r in path(1)] == [("user", says), ("assistant", "b"), ("", "odd")]
    assert chat_trees.parse_turns("".join(r.formatted for r in path(1))) == [("user", says), ("assistant", "b"), ("", "odd")]
    assert chat_trees.parse_turns(path(2)[0].formatted) == [("tool >>", "t")]
    assert len(path(5)) == 70 and len(path(None)) == 1 and not path(3) and not path(4)
    assert chat_trees.paths(m, per_tree=5).where("tree = 1").select("leaf").distinct().count() == 2
    d = {r.tree: r for r in chat_trees.digests(chat_trees.conversation_texts(chat_trees.conversations(m))).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"b").hexdigest() and d[1].loss_chars == 1 and d[5].n_turns == 70
    assert d[5].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 70, 2)).encode()).hexdigest()


def test_conversation_texts_read_back_however_cut(spark):
    rnd = random.Random(4)
    bits = ["</s>", "[INST]", " [/INST]", "<s> ", "\\", "<", "[", "<<ROLE:x>> ", "<</ROLE>>", "a", "é😀", " ", "\n"]
    rows = [(c, i, rnd.choice(["user", "assistant", "tool >>", "", None]), "".join(rnd.choices(bits, k=rnd.randrange(8))) or None)
            for c in (1, 2, None) for i in range(25)] + [(3, 0, "assistant", "</s>\\" * 4000), (4, 0, "user", None)]
    made = chat_trees.conversations(chat_trees.linear_replies(spark.createDataFrame(rows, "c long, t long, role string, text string"), "c", "t", "role", "text"))
    for chars in (1, 7, 500, 1 << 16):
        parts = chat_trees.conversation_texts(made, chars)
        got = {r.tree: r for r in chat_trees.digests(parts).collect()}
        assert len(got) == 5
        for c, r in got.items():
            said = [(role or "", text or "") for key, _, role, text in rows if key == c]
            under = "".join(text for role, text in said if role == "assistant")
            assert r.n_turns == len(said) and r.loss_chars == len(under)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
            mine = sorted((x for x in parts.where(F.col("tree").eqNullSafe(F.lit(c))).collect()), key=lambda x: x.part)
            assert [x.part for x in mine] == list(range(len(mine))) and all(len(x.text) == chars for x in mine[:-1])
            whole = "".join(x.text for x in mine)
            assert chat_trees.parse_turns(whole) == said and len(whole) == r.formatted_chars
    with pytest.raises(ValueError):
        chat_trees.TurnReader().feed("[INST] a [/INST]?[INST] b [/INST]")


def test_linear_replies_order(spark):
    rows = [(1, t, "user", f"x{t}") for t in (5000, 3, 1, 2048, 70)] + [(1, None, "user", "first"), (1, 3, "assistant", "tie")]
    r = chat_trees.linear_replies(spark.createDataFrame(rows, "c long, turn long, role string, text string"), "c", "turn", "role", "text")
    got = [x.text for x in sorted(r.collect(), key=lambda x: x.id)]
    assert got == ["first", "x1", "tie", "x3", "x70", "x2048", "x5000"]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(kind, text):
    out = []
    for m in re.finditer(BASE[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
              "card": 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0,
              "phone": 9 <= len(digits) <= 15}[kind]
        if ok:
            out.append((m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    rnd = random.Random(9)
    parts = ["a@b.c", "_d@e.f-g.h", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255.9", "4111 1111-1111 1111", "4111111111111112", "+1 (366) 555-9807",
             "+12", "😀", "é", " ", "-", "7", "9 ", "+", "(", "\n", "word"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))) for i in range(800)]
    rows += [(900, None), (901, "1 " * 30_000), (902, "a" * 100_000 + "@b.c"), (903, "8.8.8.8 " * 3000), (None, "a@b.c"), (None, "a@b.c")]
    got = pii.find_pii(docs(spark, rows)).collect()
    want = sorted((i or -1, [[list(s) for s in brute_pii(k, t or "")] for k in pii.KINDS]) for i, t in rows)
    assert sorted((r.doc_id or -1, [[[s.start, s.end] for s in r.base[k]] for k in pii.KINDS]) for r in got) == want
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_bootstrap_adds_unseen_identifiers(spark):
    rows = [(i, f"filler {i} text. Reach me: phone number +1 366 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "filler text. Reach me: phone number 366/555/9999 today"), (51, "the part 366/777/9999 is clean")]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    s = rows[-2][1].index("366/555")
    assert [(x.start, x.end) for x in got[50].found.phone] == [(s, s + 12)] and not got[50].base.phone
    assert not any(got[51].found[k] for k in pii.KINDS)
    assert all(got[i].found == got[i].base for i in range(12))


def test_pii_seeds_are_base_spans_and_candidates_need_no_digit(spark):
    name = ["anna", "bert", "cleo", "dora", "emil", "fritz", "gerd", "hans", "ilse", "jana"]
    card = ["371449635398431", "378282246310005", "371449635398431", "340000000000009", "341111111111111", "343434343434343", "346827630435344", "370000000000002"]
    rows = [(i, f"{n} says: write mail to {n}.smith@example.org, please") for i, n in enumerate(name)]
    rows += [(20 + i, f"{n} paid by amex card {c[:4]} {c[4:10]} {c[10:]} yesterday") for i, (n, c) in enumerate(zip(name, card))]
    rows += [(40 + i, f"see host at http://10.0.0.{i}/path now") for i in range(6)]
    rows += [(60 + i, f"{n} long: reach mailbox {n * 20}@example.org soon") for i, n in enumerate(name)]
    extra = [("write mail to anna(at)example.org, please", "anna(at)example.org", "email"), ("paid by amex card pending-x yesterday", "pending-x", "card"),
             ("see host at http://localhost/path now", None, "ip"), ("reach mailbox nobody(at)example.org soon", "nobody(at)example.org", "email")]
    rows += [(100 + i, t) for i, (t, _, _) in enumerate(extra)]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows), pattern_score=0.8).collect()}
    for i, (text, token, kind) in enumerate(extra):
        want = [(text.index(token), text.index(token) + len(token))] if token else []
        assert [(x.start, x.end) for x in got[100 + i].found[kind]] == want, text
    assert all(got[i].found == got[i].base for i, _ in rows if i < 100)


def test_pii_instances_and_units_see_the_same_slots(spark):
    texts = ["tel +1 366 555-1000 or +1 366 555-1001 or +1 366 555-1002 now", "say mailto:a.b@example.org; and (c.d@example.org) or 'x'",
             "ip http://10.0.0.1/path and 4000 000000 00002x " + "w" * 200 + " e@f.gh \n i@j.kl", "no one", "", "\u00e9 1.2.3.4\n", "=" * 20_000 + " a@b.cd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    rows = rows.withColumn("base", F.struct(*[pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS]))
    seeds = {(r.row, s.token): s for r in rows.select("row", pii._instances(F.col("text"), "base").alias("i")).collect() for s in r.i}
    assert {k[1]: s.patterns for k, s in seeds.items() if k[0] == 0} == {
        "+1 366 555-1000": ["B tel _ or"], "+1 366 555-1001": ["L 555-1000 or", "B or _ or"], "+1 366 555-1002": ["L 555-1001 or", "B or _ now"]}
    assert seeds[2, "e@f.gh"].patterns[0] == "L 00002x " + "w" * 200 and seeds[2, "10.0.0.1"].kind == "ip"
    assert seeds[1, "a.b@example.org"].patterns == ["L say mailto:", "B mailto: _ ;"] and seeds[1, "c.d@example.org"].patterns == ["L and (", "B ( _ )"]
    units = {}
    starts = rows.select("row", F.posexplode(pii._word_starts(F.col("text"))).alias("word", "at"))
    for r in pii._units(rows).join(starts, ["row", "word"]).collect():
        assert texts[r.row][r["at"] + r.start:r["at"] + r.end] == r.token
        units.setdefault((r.row, r["at"] + r.start, r.token), []).append(r.pattern)
    for (row, token), s in seeds.items():
        assert texts[row][s.start:s.end] == token
        assert sorted(units.get((row, s.start, token), s.patterns)) == sorted(s.patterns), (row, token)
    assert any((row, s.start, token) in units for (row, token), s in seeds.items())


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(25):
        c = rng.standard_normal(16)
        for _ in range(8):
            rows.append((k, [float(x) for x in (c + rng.standard_normal(16) * rng.choice([0.02, 0.08])) * rng.uniform(0.1, 9)], k % 2))
            k += 1
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0),
             (1005, [None] * 16, 0), (1006, [], 0), (1007, [1.0, 2.0], 0), (None, rows[0][1], 0), (1008, [1e300] * 3, 0), (1009, [2e-300] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {id(r): 0 for r in rows}
    n = 0
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    n += 2
    for block in (1024, 3):
        got = vector_lsh.near_vectors(df, block_rows=block).collect()
        have = {r.vec_id: r.n_links for r in got}
        assert len(got) == len(rows) and all(have[r[0]] <= links[id(r)] for r in rows)
        assert sum(have.values()) >= 0.95 * n > 0
        assert all(have[i] == 0 for i in (1001, 1002, 1003, 1004, 1005, 1006, 1007)) and have[1008] == have[1009] == 1
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = str(public_tokenizers.path(TOKENIZER))
    t = Tokenizer.from_file(path)
    odd = ["<|endoftext|> A <|ENDOFTEXT|>", "don't stop.", "x,y, z!!", "İstanbul é. ñ, …. Å", "\x1c\x85 a\u00a0b", "٣4 ½", "a" * 5000]
    rows = TEXTS + [(60 + k, x) for k, x in enumerate(odd)] + [(90, None), (90, None)]
    got = packing.pack_documents(docs(spark, rows), path, window_tokens=5000).collect()
    want = sorted((i is None, i or 0, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    have = []
    for (i, n), pieces in by_doc.items():
        starts = {}
        for s, ids in pieces:
            starts.setdefault(s, []).append(ids)
        copies = len(starts[0])
        if copies == 1:
            have.append((i is None, i or 0, sum((starts[s][0] for s in sorted(starts)), [])))
        else:
            have += [(i is None, i or 0, ids) for ids in starts[0]]
            assert sum(len(x) for x in starts[0]) == n * copies
    assert sorted(have) == want
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all
    assert packing.pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("name,by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_packing_follows_the_tokenizer_file(spark, tmp_path, name, by_words):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer
    path = str(public_tokenizers.path(name))
    t = Tokenizer.from_file(path)
    assert packing.works_by_words(t) == by_words
    rows = [*dict(TEXTS).items(), (60, "Hello World, THE End"), (61, "  two  spaces\r\n"), (62, "<|endoftext|> x"), (63, None), (64, "é😀 " * 3000)]
    got = packing.pack_documents(docs(spark, rows), path, window_tokens=5000, end_id=7).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    said = dict(rows)
    assert {i: by_doc[i] for i in said if i is not None} == {i: [*t.encode(x or "", add_special_tokens=False).ids, 7] for i, x in said.items() if i is not None}
    # The same words, but by a file that keeps upper case: its own settings count.
    kept = json.loads(t.to_str())
    kept["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(kept))
    other = Tokenizer.from_file(str(tmp_path / "t.json"))
    ids = packing.ids_by(str(tmp_path / "t.json"))
    assert isinstance(ids, packing.TextIds)
    assert ids.ids(pa.array(["A Big day", None]))[0].tolist() == [*other.encode("A Big day", add_special_tokens=False).ids, packing.END_ID]


def test_pack_fills_every_sequence():
    rnd = random.Random(1)
    for _ in range(200):
        lengths = [rnd.randint(1, 90) for _ in range(rnd.randint(1, 40))]
        pieces = packing.pack(lengths, capacity=32)
        fill = {}
        for _, _, n, s, at in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert at == fill.get(s, 0)
            fill[s] = at + n
        assert sorted(fill.values()) == sorted(packing.capacities(sum(lengths), 32))
        assert sorted((d, x) for d, start, n, _, _ in pieces for x in range(start, start + n)) == [(d, x) for d, n in enumerate(lengths) for x in range(n)]


def test_secrets(spark):
    rnd = random.Random(6)
    parts = ["password", "API_KEY", "apikey", "toKen", "secret", '"', "'", " ", "=", ":", "abcdef0123456789", "Z" * 12, "AKIA", "QWERTYUIOPASDF", "ghp_" + "a1" * 18,
             "-----BEGIN RSA PRIVATE KEY-----", "é😀", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "ſecret=", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))) for i in range(500)] + [(900, None), (901, "f" * 200_000), (None, "AKIA")]
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    got = secrets.scan(docs(spark, rows)).select("doc_id", "text", "secrets").collect()
    assert len(got) == len(rows)
    for r in got:
        want = [(x.kind, m.start(), m.end()) for x in rules for m in re.finditer(x.pattern, r.text or "", re.ASCII) if len(m[x.group]) >= x.least]
        assert [tuple(s) for s in r.secrets] == want
    assert secrets.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("pattern, texts", [
    (r"ab(cd|ef)+g", ["abcdg", "xabefcdg"]), (r"a?bcd", ["bcd", "abcd"]), (r"(?:foo|ba[rz])qux", ["fooqux", "bazqux"]),
    (r"[0-9]+", ["7"]), (r"abc{0,2}d", ["abd", "abccd"]), (r"(?i:AbC)x*yz{2}", ["ABCyzz"]), (r"x(ab|c|)y", ["xy", "xaby"]), (r"a(?=b)bcde", ["abcde"]),
    (r"(abcd)?efgh|ijk", ["efgh", "ijk"]), (r"\babc\b|[^a]bcd", ["abc", "xbcd"])])
def test_trigram_queries_never_lose_a_match(pattern, texts):
    query = secrets.trigram_query(pattern)

    def holds(q, t):
        if q == secrets.ALL:
            return True
        if q[0] == "gram":
            return bytes([q[1] >> 16, q[1] >> 8 & 255, q[1] & 255]) in t.lower().encode()
        return (all if q[0] == "and" else any)(holds(x, t) for x in q[1])

    assert all(re.search(pattern, t) and holds(query, t) for t in texts)
