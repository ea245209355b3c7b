"""Registered queries against their SQL, and the pipeline against plain versions."""

import numpy as np
import pytest
from compare import duck, rows_of
from plain import classes, decontaminated, ordered, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from fleetplan.llm.oracles import ORACLES
from fleetplan.llm.queries import QUERIES, tokenizer
from fleetplan.session import stage


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-test")
        assert docs.columns == columns
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language ID":
            expected = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
        elif name == "n-gram Jaccard join":
            expected = [x for x, c in zip(rows, classes(rows)) if x[0] == c[0]]
        elif name == "substring dedup":
            expected = [(k, kept if n else t) for (k, t), (_, _, n, kept) in zip(rows, without_repeats(rows)) if not n or kept]
        else:
            expected = [x for x, y in zip(rows, decontaminated(rows, items)) if not y[4]]
        assert ordered(got) == ordered(expected), name
        rows = got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tool = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {k: len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in rows}
    assert len(pieces) == corpus_pipeline.run(spark, sf_dir).count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    table, key = {"op8": ("pages", "page_id"), "op13": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    expected = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()
    assert df.select(key).distinct().count() == expected + (name == "op13_chat")
    assert np.isfinite([float(v) for v in df.first() if isinstance(v, (int, float))]).all()
