"""The pipeline and the registered queries on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
import corpus_pipeline
from convoca.llm import bpe, toxicity
from test_text_operators import contaminated, deduped, fingerprint

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_pipeline_is_its_stages_one_by_one(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    docs, labels = read("documents"), read("labels").filter(~toxicity.held_out())
    rows = docs.collect()
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    kept = [(r["doc_id"], r["text"]) for r in scored if r["predicted"] == 0]
    kept = [(i, t) for i, t, _, _ in deduped(kept)]
    classes = brute.components([(i, fingerprint(t)) for i, t in kept])
    kept = [(i, t) for i, t in kept if classes[i] == i]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    bad = {i for i, *_, c in contaminated(kept, items) if c}
    library = Tokenizer.from_str(bpe.spec_of())
    want = []
    for i, t in kept:
        if i not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), np.array(ids, dtype="<u4").tobytes(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, FOLDER)
    assert 0 < len(want) < len(rows)
    assert sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in got.collect()) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        made = stage(spark, docs, FOLDER)
        assert made.dtypes == docs.dtypes


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    rows = entry.queries()[name](spark, FOLDER).select(*columns).collect()
    assert sorted(tuple(r) for r in rows) == sorted(cursor.fetchall())
