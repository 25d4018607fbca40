"""Folds against plain Python, and what must hold for any input."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillspark.catalogs import carriers, conditions, cpt, dme, icd, member_ids, payers, symptoms
from quillspark.functions import text
from quillspark.functions.sqltext import SPARK
from quillspark.operators import folds
from quillspark.plans import suite
from quillspark.sources import files


def test_near_dup_lines(spark):
    text = "History of falling; I a history of six falls in the\n) History of falling\nHistory of six falls\nSnoring loudly every night\n  ; ) Snoring  loudly every night\nPage 1 of 3"
    got = folds.near_dup_lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).collect()
    by = {r.doc_id: r["lines"] for r in got}
    assert by[1] == ["History of falling; I a history of six falls in the", "History of falling", "History of six falls", "Snoring loudly every night"]
    assert by[2] == [] and by[3] is None


def test_near_dup_lines_of_a_long_text(spark):
    r = random.Random(7)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(260)]
    text = "\n".join([*lines, lines[250].upper(), lines[3] + "x"])
    got = folds.near_dup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["lines"]
    assert got == [*lines[:3], lines[3] + "x", *lines[4:]]


def test_member_ids_merge(spark):
    rows = [(1, "W123456789", 9.0, 2), (1, "W12345678O", 4.5, 1), (1, "ZZ99998888", 3.0, 1), (2, "ABC1234567", 1.0, 1)]
    got = {(r.doc_id, r.value): (r.score, r.n, r.members) for r in folds.merge_member_ids(spark.createDataFrame(rows, "doc_id long, value string, score double, n long")).collect()}
    assert got == {(1, "W123456789"): (13.5, 3, 2), (1, "ZZ99998888"): (3.0, 1, 1), (2, "ABC1234567"): (1.0, 1, 1)}


def test_boxes(spark):
    r = random.Random(3)
    rows = [(d, 1, b, r.random() * 50, r.random() * 20, 20.0, 5.0, r.random(), "x") for d in range(4) for b in range(30)]
    df = spark.createDataFrame(rows, folds.BOXES)
    kept = folds.suppress_boxes(df).collect()
    for a in kept:
        for b in kept:
            if a.doc_id == b.doc_id and a.box < b.box:
                assert folds.iou((a.x, a.y, a.w, a.h), (b.x, b.y, b.w, b.h)) <= 0.6
    assert len(folds.suppress_boxes(spark.createDataFrame(kept, folds.BOXES)).collect()) == len(kept)


def test_consensus_is_the_best_of_all_strings():
    r = random.Random(9)
    for _ in range(60):
        size = r.randrange(3, 7)
        base = [r.choice("AB01") for _ in range(size)]
        members = [("".join(c if r.random() < 0.7 else r.choice("AB01X") for c in base), float(r.randrange(5))) for _ in range(r.randrange(1, 6))]
        options = [sorted({v[i] for v, _ in members}) for i in range(size)]
        far = lambda c: [sum(x != y for x, y in zip(c, v, strict=True)) for v, _ in members]  # noqa: B023, E731
        want = min(("".join(p) for p in product(*options)), key=lambda c: (max(far(c)), sum(d * (s + 1) for d, (_, s) in zip(far(c), members, strict=True)), c))  # noqa: B023
        assert folds.consensus(members) == want


def test_consensus_of_very_many_places():
    r = random.Random(1)
    base = "".join(r.choice("ABCDEFGH01234567") for _ in range(20))
    near = [("".join("9" if i in (2 * k, 2 * k + 1) else c for i, c in enumerate(base)), 3.0) for k in range(10)]
    assert folds.consensus([(base, 9.0), *near]) == base


def test_columns_of_a_page(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    write("lineitem", [(1, i, 0.0 if i % 2 else 75.0) for i in range(12)], "l_orderkey long, l_linenumber int, l_quantity double")
    write("orders", [], "o_custkey long, o_orderkey long, o_totalprice double")
    got = {r.box: r.col for r in suite.queries()["win_gap_split"](spark, str(tmp_path)).collect()}
    assert all(got[i] == (0 if i % 2 else 1) for i in range(12))


def test_sources(spark, tmp_path):
    (tmp_path / "f.ndjson").write_text('{"id":"1","ts":"t","accepted":true}\nnot json\n{"id":"2","accepted":null}\n')
    assert {r.id for r in files.read_ndjson(spark, str(tmp_path / "f.ndjson")).collect()} == {"1", "2"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pdf/b.pdf").write_bytes(b"GIF89a")
    assert [r.path.rsplit("/", 1)[1] for r in files.read_pdf(spark, str(tmp_path / "pdf")).collect()] == ["a.pdf"]
    (tmp_path / "log").write_text('{"msg":"text_llm","id":"d1","elapsed":2.5}\n{"msg":"other"}\nbroken\n')
    assert [r.id for r in files.read_log_jsonl(spark, str(tmp_path / "log")).collect()] == ["d1"]
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/r.json").write_text('{"category":"sleep","codes":[{"code":"95810","patterns":[{"pattern":"psg","name":"n","score":3}]}]}')
    rule = files.read_rule_dir(spark, str(tmp_path / "rules")).first()
    assert (rule.category, rule.code, rule.pattern, rule.score) == ("sleep", "95810", "psg", 3.0)
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, ts int")
    new = spark.createDataFrame([("a", 2)], "id string, ts int")
    assert {(r.id, r.ts) for r in files.upserted(old, new, "id", "ts").collect()} == {("a", 2), ("b", 1)}
    assert [r.id for r in files.purged(old, new).collect()] == ["b"]
    files.write_results(old.withColumn("intake_date", F.lit("2024-01-01")), str(tmp_path / "out"))
    assert (tmp_path / "out/intake_date=2024-01-01").is_dir()
    pages = '{"doc_id":"d","page":1,"text":"x","boxes":[{"bbox":[0,0,1,1],"text":"a","conf":1.7},{"bbox":[0,0,1,1],"text":" ","conf":0.5}]}\n'
    (tmp_path / "ocr.json").write_text(pages)
    boxes = files.read_ocr_json(spark, str(tmp_path / "ocr.json")).first().boxes
    assert [(b.text, b.conf) for b in boxes] == [("a", 1.0)]


def test_catalogs_are_whole():
    assert [len(x) for x in (carriers.CARRIERS, carriers.PREAUTH, icd.ICD, symptoms.SYMPTOMS, dme.VENDORS, payers.ROUTES, payers.RATES, member_ids.RULES, member_ids.PATTERNS, conditions.CONDITIONS, cpt.CPT)] == [91, 8, 172, 17, 14, 88, 34, 93, 122, 75, 8]
    assert sum(len(r) for _, _, r in payers.RATES) == 112


TEXTS = {
    1: "Insurance: Aetna Member ID: W123456789 Group: GRP1\nOther Insurance: Medicare Member ID: Z99999123 Group: MGRP",
    2: "Plan: Prominence HMO\nOrder 95811 cpap titration, failed CPAP. Diagnosis: G47.37 and G47.33, I10",
    3: "Self pay, uninsured. APRIA E0601 A7034 supplies, mask leak.\nDenies snoring. Patient reports gasping for air.",
    4: "Order pediatric sleep study 95782\nDOB: 03/04/2020\n95810 mentioned",
    5: "Nothing to see here",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(k, v, "en", "s", len(v)) for k, v in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, folder, name):
    return [r for r in suite.queries()[name](spark, folder).collect() if r.doc_id > 0]


def test_detectors_on_texts_that_say_what_to_find(spark, folder):
    """Expected rows worked out by hand from the rules, not from another engine."""
    got = {r.doc_id: (r.carrier, r.status, r.why) for r in rows(spark, folder, "detect_carrier")}
    assert got[1] == ("Aetna", "accepted", "carrier_detect") and got[2][:2] == ("Prominence", "not_accepted") and 5 not in got
    policy = {r.doc_id: r for r in rows(spark, folder, "carrier_policy")}
    assert policy[2].days == 21 and policy[2].actions == "insurance_contract_expiring,insurance_auto_flag:prominence"
    codes = {r.doc_id: r for r in rows(spark, folder, "detect_cpt")}
    assert codes[2].cpt == "95811" and codes[2].titration and codes[4].cpt == "95782" and 5 not in codes
    order = sorted((r.place, r.icd) for r in rows(spark, folder, "icd_priority") if r.doc_id == 2)
    assert order == [(1, "G47.33"), (2, "G47.37"), (3, "I10")]
    second = {r.doc_id: (r.primary_carrier, r.secondary_carrier, r.member_id) for r in rows(spark, folder, "detect_secondary_insurance")}
    assert second == {1: ("Aetna", "Medicare", "Z99999123")}
    equipment = {r.doc_id: r for r in rows(spark, folder, "detect_dme")}
    assert set(equipment) == {3} and equipment[3].vendor == "APRIA" and equipment[3].codes == "E0601,A7034" and equipment[3].mask_leak
    told = {(r.label, r.status) for r in rows(spark, folder, "detect_symptoms") if r.doc_id == 3}
    assert {("snoring", "denied"), ("witnessed_apnea", "confirmed")} <= told
    best = {r.doc_id: r.value for r in rows(spark, folder, "member_id_rank") if r.place == 1}
    # The first is found by the window below an insurance word before its label is, which is worth less than a label.
    total = {r.value: r.total for r in rows(spark, folder, "member_id_rank") if r.doc_id == 1}
    assert best[1] == "Z99999123" and total == {"W123456789": 35 + 25 + 8 + 5, "Z99999123": 45 + 22 + 8 + 5}
    special = {r.doc_id: (r.pediatric, r.dme) for r in rows(spark, folder, "flag_special")}
    assert special[4][0] == "age" and special[3] == (None, True) and special[5] == (None, False)
    assert {r.doc_id for r in rows(spark, folder, "flag_policy_actions") if r.action == "pediatric_protocol_review"} == {4}
    notes = [r.tag for r in sorted(rows(spark, folder, "auth_notes"), key=lambda r: r.ord) if r.doc_id == 1]
    assert notes == ["missing_chart_notes", "carrier_aetna"]


def test_title_case(spark):
    want = {"MARY-JANE o'neil": "Mary-Jane O'Neil", " de la  CRUZ": "De La  Cruz", "élodie d'arc": "Élodie D'Arc"}
    for raw, name in want.items():
        assert spark.createDataFrame([(raw,)], "x string").selectExpr(text.title_case(SPARK, "x")).first()[0] == name


def test_needles_lose_no_match(spark):
    names = [(f"{n}{i}", "(?i)" + p) for n, _, ps in carriers.CARRIERS for i, p in enumerate(ps)] + [(n, rf"(?i)\b({n})\b") for n, _ in conditions.CONDITIONS]
    texts = ["", None, "straße", *[r for _, p in names for r in (re.sub(r"\(\?i\)|\\[bs]|[\\()?:+*]", " ", p).lower(),)], "Blue  Cross and\tUHC; Well care", "denies sleep apnea, OBESITY"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string")
    want = df.selectExpr("i", *[f"coalesce(regexp_like(x, {SPARK.pattern(p)}), false) AS c{k}" for k, (_, p) in enumerate(names)]).collect()
    got = {r.i: r.h for r in df.selectExpr("i", f"{SPARK.hits('x', names)} AS h").collect()}
    assert {r.i: [n for k, (n, _) in enumerate(names) if r[f"c{k}"]] for r in want} == {i: h or [] for i, h in got.items()}
    each = df.selectExpr("i", *[f"{SPARK.like('x', p)} AS c{k}" for k, (_, p) in enumerate(names)]).collect()
    assert sorted(each) == sorted(want)


def test_names_are_looked_up_in_a_text_that_is_made_once():
    found = SPARK.first_of("costly(x)", ["A", "B"], 7)
    assert found.count("costly(x)") == 1 and "contains(costly(x)" not in found
    assert "contains" in SPARK.like("x", r"(?i)prior\s+study")


def test_case_is_mapped_letter_by_letter(spark):
    rows = [("ßzu d'ſx", "ẞzu D'Sx"), ("ΑΣ ﬁx", "Ασ ﬁx"), ("İa", "Ia")]
    got = [r.v for r in spark.createDataFrame(rows, "x string, w string").orderBy("w").selectExpr(f"{text.title_case(SPARK, 'x')} AS v").collect()]
    assert got == sorted(w for _, w in rows)


def test_value_in_text_in_other_case(spark, tmp_path):
    spark.createDataFrame([(999999937, "xStraße ab cd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suite.queries()["value_in_text"](spark, str(tmp_path)).where("doc_id = 999999937").first()
    assert (got["value"], got["match_type"]) == ("STRAẞE AB", "case_insensitive")
