"""A name is computed once where it is judged, and the shorter guard of lines takes the same lines as SQL."""

from __future__ import annotations

import duckdb

from quillspark.plans import both, suite  # noqa: F401

LINES = [
    "Roe, Jane", "Roe, Jane dr.", "Roe, Jane pt", "Roe, Jane pt dr.", "Roe, Jane pt dr. fx", "Roe, Jane pt fx", "Roe, Jane fx", "Jane van Roe", "name: Roe, Jane pt dr.", "name: Roe, Jane dr. fx",
    "pt name: Roe, Jane dr.", "pt name:\nRoe, Jane pt provder", "pt name: O'Neil-roe, JANE", "Xyz, Bcd", "Md, Jane", "Roe, Suite", "Chronic, Jane",
]


def test_names_once_and_as_in_sql(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = {}, both.stored
    monkeypatch.setattr(both, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    query, sql = both.REGISTRY["detect_name"]
    got = sorted(map(repr, (tuple(r) for r in query(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(repr, con.execute(sql).fetchall()))
    filters = [line for line in plans["names"].splitlines() if "Filter" in line and "split(" in line]
    assert filters and all(line.count("split(") <= 2 for line in filters)
