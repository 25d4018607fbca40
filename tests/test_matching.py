"""What is looked through before patterns are matched: lines, texts, and what a statement reads of the facts."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

from quillspark.functions import matching
from quillspark.functions.sqltext import DUCK, SPARK
from quillspark.plans import both, q_decide, q_detect, suite  # noqa: F401
from quillspark.plans import q_result as R

TEXTS = [
    None, "", "\u00a0\t\r\n", "icd\nx\nG47.33", "icd\r\nx\r\n\r\nG47.33 ", "a  b\t\tc  d\r\n\r\nPatient: Roe, Jane\nRoe, Jane", "name:\nMary Smith\n", "DOB\n01/02/1970",
    "Member ID: ABC1234567", "ID A123456789 insurance", "A12345 6", "blue   cross\nMember: 1234567A", "Clark\n county self-funded", "sılver summit", "child\nstudy", "minor study",
    "95810 order", "order 95810", "titratıon", "home oxygen, chf", "call tel: (702) 234-45 11 99", "AGE: 7 minor",
]


def documents(spark, folder) -> str:
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    return documents(spark, tmp_path_factory.mktemp("texts"))


def test_lines_are_those_of_the_lines_view(spark, folder):
    want = [tuple(r) for r in both.lines(both.Names(spark, folder)._pages()).select("doc_id", "line", "text").collect()]
    every = lambda text, line: (line >= 0, line >= 0)
    got = [tuple(r) for r in matching.picked(both.Names(spark, folder)._pages(), every, ()).select("doc_id", "line", "text").collect()]
    assert sorted(got) == sorted(want)


def test_neighbours_stay_within_a_text():
    own = pa.array([0, 0, 1, 1, 1]).to_numpy()
    hit = pa.array([False, True, False, False, True]).to_numpy(zero_copy_only=False)
    assert matching.moved(hit, own, 1).tolist() == [False] * 5
    assert matching.moved(hit, own, -1).tolist() == [True, False, False, True, False]


@pytest.mark.parametrize("name", ["flag_chart_insurance", "flag_special", "flag_qc", "auth_notes", "cross_validate", "kb_payer", "kb_status", "rule_engine_score", "dx_from_problems", "detect_name", "detect_carrier", "icd_priority"])
def test_odd_texts_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    query, sql = both.REGISTRY[name]
    assert sorted(map(repr, (tuple(r) for r in query(spark, folder).collect()))) == sorted(map(repr, con.execute(sql).fetchall()))


def test_facts_join_only_what_a_statement_reads(spark, folder):
    names = both.Names(spark, folder)
    chart = names.resolved(f"SELECT chart FROM {q_decide.facts(SPARK, names)}")
    assert "JOIN" not in chart and "falls" not in chart and "text" not in chart
    assert names.resolved(f"SELECT dob FROM {q_decide.facts(SPARK, names)}").count("LEFT JOIN") == 1
    assert "JOIN" in q_decide.facts(DUCK, both.Names())


def test_marks_miss_nothing():
    x = pa.array(["CLARK\n\x0bcounty  self-funded", "sılver summit heaſth", "12345678", "1234567", "ABCDEFGH", "KBCDEF1G"])
    assert matching.mask(x, matching.spelled("CLARK COUNTY SELF-FUNDED")).tolist()[0] and matching.mask(x, matching.spelled("SILVER SUMMIT")).tolist()[1]
    assert matching.mask(x, q_detect.MEMBER_MARK).tolist() == [False, False, True, False, False, True]
    assert all(matching.mask(pa.array([n.lower()]), *R.CARRIER_MARKS)[0] for n in R._DNA + R._ACCEPTED + R._SELF)
