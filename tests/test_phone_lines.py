"""Lines around a phone number are cut at line ends, as SQL's patterns do, and not by a pattern that is tried at each letter."""

from __future__ import annotations

import duckdb

from quillspark.plans import both, suite  # noqa: F401

N = "(702) 234-5678"
TEXTS = [
    None, N, f"\n{N}\n", f"patient\n\nx\nhome phone {N} y\nz\nradiology\nfax", f"facesheet\na\nb\nphone: {N}", f"a\nfacesheet\nb\nphone: {N}", f"fax\r\nphone: {N}\r\nimaging\r\n\r\nlab",
    "word " * 3000 + f"cell {N} " + "word " * 3000, f"office {N}\n" * 3 + f"mobile {N}", f"h: {N} and 702-345-6789\nplace of surgery",
]


def test_lines_around_numbers_as_in_sql(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = {}, both.stored
    monkeypatch.setattr(both, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("detect_phone_raw", "detect_phone"):
        query, sql = both.REGISTRY[name]
        assert sorted(map(repr, (tuple(r) for r in query(spark, str(tmp_path)).collect()))) == sorted(map(repr, con.execute(sql).fetchall()))
    assert r"[^\n]*\z" not in plans["phones"]
