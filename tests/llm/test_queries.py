"""The registered queries without SQL against brute force over the smallest tables (or tables made for them)."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from corpuslens.llm import queries

SMOKE = "/root/testdata/sf0.001"
WS = "\x20\x09-\x0D"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}


def closure(ids, linked):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *[low[j] for j in ids if linked(i, j)]]) for i in ids}
        if new == low:
            return low
        low = new


def test_op3_learns_from_its_own_rows(spark):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    found = sum(p for p, y in held if y) / sum(y for _, y in held)
    false = sum(p for p, y in held if not y) / sum(not y for _, y in held)
    assert found >= 0.7 and false <= 0.01, (found, false)


def test_op4_follows_the_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    got = {r.page_id: r for r in queries.QUERIES["op4_url_filter"](spark, SMOKE).collect()}
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for p in pages:
        host = path = ""
        if p.url and "://" in p.url:
            rest = p.url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
            host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")


def test_op5_fingerprints_and_components(spark, texts):
    def fingerprint(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        words = re.findall(f"[^{WS}]+", low)
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    low = closure(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = queries.QUERIES["op5_simhash"](spark, SMOKE).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", low[i]) for i in prints} and len(got) == len(prints)


def spans_of(text, pattern, ok=lambda m: True):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op7_base_spans(spark, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)}
    got = {r.doc_id: r for r in queries.QUERIES["op7_pii"](spark, SMOKE).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = {k: spans_of(t, *v) for k, v in kinds.items()}
        listed = [f"{k}:{s}:{e}" for k in kinds for s, e in base[k]]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_op8_links_and_components(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 64))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.standard_normal(64) * (0.05 if i % 3 else 0.5)) * rng.uniform(0.5, 3)], i % 24 // 12) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in queries.QUERIES["op8_vector_dedup"](spark, str(tmp_path)).collect()}
    good = [r for r in rows if r[1] and any(r[1]) and r[2] is not None]
    v = np.array([r[1] for r in good])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = v @ v.T
    link = {(a[0], b[0]) for i, a in enumerate(good) for j, b in enumerate(good) if i != j and a[2] == b[2] and cos[i, j] >= 0.98}
    low = closure([r[0] for r in rows], lambda i, j: (i, j) in link)
    assert len(link) > 500 and len(got) == len(rows)
    for i in low:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in link), low[i], low[i] == i)


def test_op9_pieces_hold_the_ids(spark, texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    rows = queries.QUERIES["op9_packing"](spark, SMOKE).collect()
    at, filled = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[i] == len(x) for i, x in ids.items())
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 4096 or end < 4096 and end & (end - 1) == 0


def test_op10_base_spans(spark, texts):
    key = r"(?i:password|passwd|secret|token|api_?key)"
    kinds = {"assign": (key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None), "access": (r"AKIA[A-Z0-9]+", lambda s: len(s) >= 18),
             "hex": (r"[0-9a-f]+", lambda s: len(s) >= 16)}
    got = {r.doc_id: r for r in queries.QUERIES["op10_secrets"](spark, SMOKE).collect()}
    for i, t in texts.items():
        base = {k: spans_of(t, p, ok) for k, (p, ok) in kinds.items() if ok}
        base["assign"] = [m.span() for m in re.finditer(kinds["assign"][0], t) if len(m.group(1)) >= 12]
        listed = sorted((s, list(kinds).index(k), f"{k}:{s}:{e}") for k in kinds for s, e in base[k])
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [len(base[k]) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(x for *_, x in listed).encode()).hexdigest()
