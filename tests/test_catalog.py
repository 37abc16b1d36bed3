"""Registry, streams and plans. ``tools/compare.py`` compares every query with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from phrasegraph.operators import graph as G
from phrasegraph.operators import phrases as P
from phrasegraph.operators import sampling as H
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CHECKED = [
    "b09_clean_text", "c02_candidate_phrases", "c08_collocations", "d07_nearest", "e02_deduplicate",
    "e03_cooccurrence_parts", "f12_kept_pairs", "g14_average_rank", "h06_sample_distance_mid",
    "j08_rare_token_score", "k06_multinomial_constants", "l01_ingest_labels", "l02_used_pairs", "l03_flags",
]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "text_clean", "n_merged"]


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@needs_data
def test_core_plans(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    inc = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey as kid", "l_orderkey as doc_id")
    spans = plan(P.candidate_phrases(docs), capsys)
    assert "Window" not in spans
    for text in (
        spans,
        plan(G.cooccurrence(inc), capsys),
        plan(P.phrase_doc_counts(P.candidate_phrases(docs)), capsys),
        plan(H.canonical_pairs(inc, "kid", "doc_id"), capsys),
    ):
        assert "CartesianProduct" not in text
        assert "Exchange SinglePartition" not in text
    scan = plan(inc, capsys)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in scan
