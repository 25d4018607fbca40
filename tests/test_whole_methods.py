"""Methods whose first query leaves steps out, against rows worked out by hand from the reference's rules."""

import random
from itertools import product

import pytest

from quillspark.operators import candidates
from quillspark.plans import suite

SIXTY = "\n".join("Denies snoring." for _ in range(61))
TEXTS = {
    1: "Patient: Mary Smith\nDOB: 3/4/1980\nPhone: (702) 555-0147\nHome phone: 702-555-0199\nDiagnosis: G47.33, I10\nA18.9 in the past. Patient reports snoring and fatigue.\nNPI: 1234567890",
    2: f"{SIXTY}\nPatient reports fatigue and no energy.",
    3: "Patient: Mary Smith\nPatient Name: Smith, Mary\nDOB: 03/04/1980\nDiagnosis: I10",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, folder, name):
    return [r for r in suite.queries()[name](spark, folder).collect() if r.doc_id > 0]


def test_cross_validate_merged(spark, folder):
    got = rows(spark, folder, "cross_validate_merged")
    listed = lambda d, path: [(r.value, r.vlm is not None, r.regex is not None) for r in sorted(got, key=lambda r: r.ord) if (r.doc_id, r.path) == (d, path)]
    assert listed(1, "patient.phones") == [("7025550147", True, False), ("7025550199", False, True)]
    assert listed(1, "diagnoses") == [("G47.33", True, True), ("A18.9", True, False), ("I10", False, True)] and listed(3, "diagnoses") == [("I10", False, True)]
    assert listed(1, "clinical.primaryDiagnosis") == [("G47.33", True, True)] and listed(3, "clinical.primaryDiagnosis") == [("I10", False, True)]
    # A detector's symptom counts however many mentions stand before it.
    assert listed(2, "symptoms") == [("snoring", True, False), ("fatigue", True, True)]
    # Birth dates are compared by their digits alone.
    dobs = {r.doc_id: (r.value, r.conflict, r.resolution) for r in got if r.path == "patient.dob"}
    assert dobs == {1: ("3/4/1980", True, "flag_review"), 3: ("03/04/1980", False, None)}
    assert {(r.doc_id, r.conflicts, r.fallbacks, r.verify_manually) for r in got} == {(1, 1, 0, True), (2, 0, 2, False), (3, 0, 0, False)}


IDS = {
    1: "Insurance: Aetna\nW123456789\nMember ID: W123456780",
    2: "Insurance: Medicare\n123-45-6789A",
    3: "Member ID: W12345678\nMember ID: W123456789\nMember ID: ZZ99998888",
    4: "Nothing to see here",
}


def test_member_id_rank_merged(spark, tmp_path):
    spark.createDataFrame([*IDS.items(), (5, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.value): (r.total, r.place) for r in rows(spark, str(tmp_path), "member_id_rank_merged")}
    # Aetna's pattern finds the first id, which takes in the label's; a rule's 25 points, six hits.
    assert got.pop((1, "W123456789")) == (40 + 25 + 8 + 5 - 3 * 3, 1)
    assert got.pop((2, "123456789A"))[1] == 1
    # Without a carrier no rule; one digit less is the same id.
    assert got == {(3, "ZZ99998888"): (45 + 8 + 5, 1), (3, "W123456789"): (45 + 8 + 5 - 3, 2)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_consensus_by_edit_distance_is_the_best_of_all_strings():
    r = random.Random(5)
    for _ in range(150):
        base = [r.choice("A01") for _ in range(r.randrange(4, 8))]
        words = dict.fromkeys("".join(c if r.random() < 0.8 else r.choice("A01X") for c in (base if r.random() < 0.7 else base[1:])) for _ in range(r.randrange(2, 6)))
        group = [[w, float(r.randrange(5)), 1, "x"] for w in words]
        longest = max(map(len, words))
        anchor = max((e for e in group if len(e[0]) == longest), key=lambda e: e[1])[0]
        aligned = [candidates.gapped(anchor, w)[1] if len(w) == longest - 1 else w for w in words]
        options = [sorted({a[i] for a in [anchor, *aligned] if i < len(a)} - {"-"}) for i in range(longest)]
        far = lambda c: [edits(c, e[0]) for e in group]  # noqa: B023, E731
        want = min(("".join(p) for p in product(*options)), key=lambda c: (max(far(c)), sum(d * (e[1] + 1) for d, e in zip(far(c), group, strict=True)), c))  # noqa: B023
        assert candidates.consensus(group) == want


def test_carriers_patterns_are_of_whole_lines():
    near = candidates.re.compile("(?=aetna)")
    first = lambda text: {e[0]: e[3] for e in candidates.found(text, candidates.carrier_patterns("Aetna"), near)}
    assert first("Insurance: Aetna\nwith W123456789 in it") == {"W123456789": "primary_window"}
    assert first("Insurance: Aetna\nw123456789\nmore") == {"W123456789": "carrier_pattern"} and candidates.carrier_patterns("Cash Pay") == []


def test_many_like_ids_are_merged_in_time():
    entries = [[f"A{i:08d}", 1.0, 1, "x"] for i in range(400)]
    assert sum(e[2] for e in candidates.merged(entries)) == 400
