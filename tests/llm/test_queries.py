"""The registered queries: SQL where there is any, the stated columns, and whole tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from check_oracle import TABLES, digest
from ontocat.llm.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_quality": "doc_id held_out score predicted",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_mixing": "doc_id size source_size target taken",
    "op5_nearest": "query_id rank vec_id score",
    "op6_url_filter": "page_id host path rule verdict",
    "op9_ngram_join": "doc_id n_shingles component_id",
    "op11_phrases": "lang rank phrase a l r n score",
    "op12_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_exact_search": "query_id rank vec_id score",
    "op10_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    if df.columns[0] == "doc_id":
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_tasks_need_nothing_from_the_repository_root(tmp_path):
    """Queries run where executors have only the package that the queries send."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from ontocat.session import local_session
spark = local_session(2, 2)
import __spark_entry__
print("ROWS", __spark_entry__.queries()["op10_chat_format"](spark, {SF!r}).count(), __spark_entry__.queries()["op1_decontaminate"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
