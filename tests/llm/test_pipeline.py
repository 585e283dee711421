"""The pipeline's stages one after another on the smallest tables, each held against plain Python over its input."""

import re

import pytest

import corpus_pipeline
from corpuslens.llm import queries
from corpuslens.llm.simhash import fingerprint

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMOKE)
        assert name == "packing" or got.columns == docs.columns
        got.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_stages_take_effect(spark, steps):
    docs, clean, exact, near, mixed, _ = steps
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMOKE}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean}
    assert kept <= {r.doc_id for r in docs}
    assert sum(toxic.get(r.doc_id) == 0 for r in docs) == sum(toxic.get(i) == 0 for i in kept)  # clean labelled rows stay
    normal = {}
    for r in clean:
        normal.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), []).append(r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(min(v) for v in normal.values())
    prints = [(r.doc_id, fingerprint(r.text.encode())) for r in exact]
    low = {i: i for i, _ in prints}
    for _ in prints:
        new = {i: min(low[j] for j, y in prints if (x ^ y).bit_count() <= 3) for i, x in prints}
        if new == low:
            break
        low = new
    assert sorted(r.doc_id for r in near) == sorted(set(low.values()))
    size = {r.doc_id: len(r.text.split()) for r in near}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len({r.source for r in near})


def test_pieces_hold_every_document_of_the_mix(steps):
    mixed, pieces = steps[-2], steps[-1]
    whole = {}
    for p in pieces:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    firsts = [p for p in pieces if p.start == 0]
    assert len(firsts) == len(mixed) and sum(p.doc_tokens for p in firsts) == sum(whole.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb
    got = queries.QUERIES[name](spark, SMOKE).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    got, want = (x.sort_values(list(got.columns)).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all((got[c] == want[c]).all() for c in got.columns)
