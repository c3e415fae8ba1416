"""Registered queries against their SQL, and the pipeline against plain code."""

import hashlib

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from catalore.llm import duck_sql
from catalore.llm import queries as own
from catalore.llm import chat, exact_dedup, mixing, pii, quality, secret_scan, simhash, token_files, toxicity
from catalore.llm import byte_bpe, collocations, minhash, runs

from .test_dedup import brute_components, brute_fingerprint, exact


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_all_are_registered():
    names = set(own.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert names | {"pipeline"} <= set(queries())
    assert set(duck_sql.oracle_sql()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(duck_sql.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    frame = queries()[name](spark, sf)
    relation = duck.sql(duck_sql.oracle_sql()[name])
    assert set(frame.columns) == set(relation.columns)
    assert rows_of(frame.columns, map(tuple, frame.collect())) == rows_of(relation.columns, relation.fetchall())


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_against_plain_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    left = {r.doc_id: r for r in docs.collect() if r.doc_id not in rejected}
    kept = {keep for _, keep, _, _ in exact([(i, r.text) for i, r in left.items()])}
    prints = {i: brute_fingerprint(left[i].text) for i in kept}
    of = brute_components(prints.values())
    least = {}
    for i in sorted(kept):
        least.setdefault(of[prints[i]], i)
    near = docs.filter(docs.doc_id.isin(sorted(least.values())))
    chosen = {r.doc_id for r in mixing.mixture(near).collect() if r.kept}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == chosen
    for i, row in got.items():
        assert row.decoded_sha256 == hashlib.sha256(left[i].text.encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_whole_rows(spark, sf, clashing, name):
    out = stage(name)(spark, clashing, sf)
    assert out.schema.names == clashing.schema.names
    assert out.count() <= clashing.count()
    assert out.filter("row <> 'row'").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, sf, table, name):
    assert stage(name)(spark, table([]), sf).count() == 0


def test_operators_of_an_empty_table(spark, sf, table):
    empty, ranks = table([]), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for frame in (
        pii.personal_data(empty), secret_scan.secrets(empty), quality.verdicts(empty),
        mixing.mixture(empty), toxicity.toxicity(empty, labels), simhash.near_copies(empty),
        exact_dedup.exact_copies(empty), minhash.near_copies(empty), runs.collapsed_runs(empty),
        collocations.collocations(empty), token_files.token_digests(empty, public_tokenizers.path("byte_bpe_50k.json"), 2),
        byte_bpe.round_trip(empty, ranks, public_tokenizers.PATTERN),
        chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert frame.collect() == []


def test_no_python_in_native_plans(spark, sf):
    for name in ("op4_mixing", "op7_chat"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
