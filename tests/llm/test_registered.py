"""Registered queries against their SQL or a plain version, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import brute
import pytest
import tokenizers

import corpus_pipeline
from check_oracles import compare, connect
from moundlens.llm.bpe import default_path
from moundlens.llm.common import durable
from moundlens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    result = QUERIES[name](spark, SMALL)
    assert compare(result, connect(SMALL), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op5_chat", "op7_quality", "op9_sharding"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoop"))


def test_simhash_query(spark, documents):
    fps = {d.doc_id: brute.fingerprint(d.text, 3) for d in documents}
    root = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_token_queries(spark, documents):
    library = tokenizers.Tokenizer.from_file(default_path())
    ids = {d.doc_id: library.encode(d.text or "", add_special_tokens=False).ids for d in documents}
    size = {d.doc_id: len((d.text or "").encode()) for d in documents}
    for r in QUERIES["op8_token_counts"](spark, SMALL).collect():
        n = len(ids[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (size[r.doc_id], n, n > 512)
    for r in QUERIES["op3_bpe"](spark, SMALL).collect():
        mine = ids[r.doc_id]
        packed = b"".join(i.to_bytes(4, "little") for i in mine)
        text = library.decode(mine, skip_special_tokens=False)
        assert r.n_tokens == len(mine) and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_sharding_query(spark, documents):
    import zlib

    rows = QUERIES["op9_sharding"](spark, SMALL).collect()
    data = {d.doc_id: (d.text or "").encode() for d in documents}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(x) + 16, zlib.crc32(x)) for i, x in data.items()}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_pipeline_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    kept = brute.quality([(r.text, r.lang, r.source) for r in rows])
    rows = [tuple(r) for r, k in zip(rows, kept, strict=True) if k]
    steps = [rows]
    gone = brute.repeated_lines([(r[0], r[1]) for r in rows])
    cut = []
    for k, r in enumerate(rows):
        left = [x for n, x in enumerate(r[1].split("\n")) if n not in gone.get(k, ())]
        if left:
            text = "\n".join(left)
            cut.append((r[0], text, r[2], r[3], len(text)))
    steps.append(cut)
    root = brute.components({r[0]: brute.fingerprint(r[1], 3) for r in cut})
    steps.append([r for r in cut if root[r[0]] == r[0]])
    steps.append([r for r, h in zip(steps[2], brute.hits([r[1] for r in steps[2]], bench), strict=True) if not h[1]])
    for (name, stage), want in zip(list(stages.items())[:4], steps, strict=True):
        docs = durable(stage(spark, docs, SMALL), name.replace(" ", "-"))
        assert docs.columns == columns, name
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want), name
    library = tokenizers.Tokenizer.from_file(default_path())
    last = stages["tokens"](spark, docs, SMALL).collect()
    assert sorted(tuple(r)[:5] for r in last) == sorted(steps[-1])
    for r in last:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.round_trip and r.n_tokens == len(ids) and r.ids == b"".join(i.to_bytes(4, "little") for i in ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, last))


def test_stages_take_odd_and_empty_tables(spark):
    import test_documents

    rows = test_documents.odd_documents()
    docs = spark.createDataFrame(rows, test_documents.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        assert found.columns[: len(docs.columns)] == docs.columns and found.count() <= len(rows)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
