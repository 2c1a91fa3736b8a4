"""The registered queries on small tables, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute, hostile
from tools.check_queries import rows_of
from tracewarden.llm import mixing, queries, toxicity

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return hostile.sample(spark, tmp_path_factory.mktemp("llm") / "tables")


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_chat_format", "op5_mixing", "op7_line_dedup"])
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = db.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


def test_pipeline_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.with_score(documents, model).collect()
    docs = sorted((r.doc_id, r.text, r.source) for r in scored if r.score < 0.5)
    kept = [(i, text, s) for (i, _, s), (text, _) in zip(docs, brute.drop_lines([(i, t) for i, t, _ in docs]))]
    prints = [brute.simhash(t) for _, t, _ in kept]
    first = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    kept = [d for n, d in enumerate(kept) if first[n] == n]
    sizes = Counter()
    for _, text, source in kept:
        sizes[source] += len(brute.BLANK.sub(" ", text).split(" ")) - text[:1].isspace() - text[-1:].isspace()
    plan = mixing.plan(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()
    assert Counter({r.source_size for r in plan}) == Counter(set(sizes.values()))
    times = {r.doc_id: r.copies for r in plan}
    library = Tokenizer.from_file(queries.vocabulary_file())
    want = Counter()
    for i, text, _ in kept:
        ids = library.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += times[i]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == +want


def test_stages_on_hostile_rows(spark, tmp_path):
    for number, docs in enumerate((hostile.docs(spark), hostile.no_docs(spark))):
        tables = hostile.write_tables(spark, tmp_path / str(number), docs)
        docs = spark.read.parquet(f"{tables}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, tables)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{number}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{number}-{k}")
