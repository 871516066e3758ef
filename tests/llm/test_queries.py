"""The registered queries on the smallest tables, and the pipeline against its parts."""

import duckdb
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from tidemark.llm.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_chat_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{DATA}/conversations.parquet')")
    want = con.execute(SQL["op3_chat_format"])
    names = [c[0] for c in want.description]
    got = QUERIES["op3_chat_format"](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    ids = {r.doc_id for r in rows}
    assert ids <= kept and len(ids) > 0.8 * len(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]
