"""The pipeline's stages on hostile rows, against the operators' own verdicts and plain Python."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import cases

import corpus_pipeline
from quillspark.llm import decontam, mixing, neardup, pii, quality, simhash
from quillspark.llm.common import DOCUMENT_COLUMNS, read


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return cases.write(tmp_path_factory.mktemp("sf"))


def test_stages(spark, folder):
    docs = read(spark, folder, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select(*DOCUMENT_COLUMNS).collect()
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == list(DOCUMENT_COLUMNS)
        after = docs.select(*DOCUMENT_COLUMNS).collect()
        if k == 0:
            verdicts = {r.doc_id: r.kept for r in quality.op1_quality(spark, folder).collect()}
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if verdicts[r.doc_id])
        if k == 1:
            fps = [cases.fingerprint(r.text) for r in after]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
        if k == 2:
            index = next(iter(decontam.blocks(read(spark, folder, "benchmark"))))
            hit = [bool(h) for h in index.hits([r.text for r in before])]
            assert sorted(map(str, after)) == sorted(str(r) for r, h in zip(before, hit, strict=True) if not h)
        if k == 3:
            assert len(after) == len(before) and not any(cases.pii(r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        if k == 4:
            taken = sum(r.taken for r in docs.collect())
            assert abs(taken - sum(len(cases.WORD.findall(r.text or "")) for r in before)) <= 5
            assert mixing.CAP == 3


def test_masking(spark):
    rows = [(1, "é mail a@b.org, ip 1.2.3.4 end", "en", "s", 29), (2, None, None, None, None), (3, "plain", "en", "s", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == {1: ("é mail <email>, ip <ip> end", 27), 2: (None, None), 3: ("plain", 5)}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "size", "source_size", "target", "taken"} <= set(out.columns) and out.count() > 0


def test_repeats_keep_one(spark):
    rows = [(None, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (4, "x y z q", "en", "s", 7), (4, "x y z q", "en", "s", 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", "x y z q"), ("None", "a b c d")]


def test_near_dedup_finds_all_pairs_of_similar_shingles(spark):
    r = random.Random(8)
    rows, n = [], 0
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 400))]
        for _ in range(4):
            w = list(base)
            for at in r.sample(range(len(w)), r.randrange(1 + len(w) // 20)):
                w[at] = f"v{r.randrange(10**6)}"
            rows.append((n, " ".join(w), "en", "s", 7))
            n += 1
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    fps = [cases.fingerprint(t) for _, t, *_ in rows]
    assert any((fps[i] ^ fps[j]).bit_count() > 2 for i, j in pairs)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(k.doc_id for k in kept) == [i for i in range(n) if find(i) == i]


@pytest.mark.parametrize("block, names", [(1024, 10**6), (3, 0), (7, 10**6)])
def test_near_dedup_in_blocks(spark, monkeypatch, block, names):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LISTED", names)
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = []
    for n in range(80):
        w = list(base)
        for at in r.sample(range(100), n % 4):
            w[at] = f"v{r.randrange(10**6)}"
        rows.append((n, " ".join(w), None if n % 9 else "en", "s", 7))
    rows += [rows[5], rows[7], (None, None, None, None, None), (None, "", "s", None, None), (None, "", None, "s", None), (90, "x y", "en", "s", 3)]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for _, t, *_ in rows]
    group = {0}
    while True:
        more = {j for j in range(80) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in group)}
        if more <= group:
            break
        group |= more
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    want = sorted([0, 90, *(n for n in range(80) if n not in group)])
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == want
    assert sum(k.doc_id is None for k in kept) == 1


@pytest.mark.parametrize("k", range(5))
def test_empty_stage(spark, tmp_path, k):
    name = cases.write(tmp_path, 0)
    out = corpus_pipeline.STAGES[k][1](spark, read(spark, name, "documents"), name)
    assert out.collect() == [] and set(DOCUMENT_COLUMNS) <= set(out.columns)


def test_near_dedup_links_by_fingerprints(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(24)]
    rows = []
    # The same 3-word shingles as often, since the ends are alike, in another order of 5-word shingles: equal fingerprints.
    a, b, c = base[:8], base[8:16], base[16:]
    turn = ["x1", "x2"]
    for n, parts in enumerate(([a, b, c], [b, a, c], [c, b, a])):
        rows.append((n, " ".join(w for p in parts for w in (*turn, *p, *turn)), "en", "s", 7))
    rows.append((3, " ".join(f"v{r.randrange(10**6)}" for _ in range(30)), "en", "s", 7))
    fps = [cases.fingerprint(t) for _, t, *_ in rows]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    linked = [(i, j) for i in range(4) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert any(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i, j in linked)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    gone = {max(p) for p in linked}
    assert sorted(k.doc_id for k in kept) == [n for n in range(4) if n not in gone]
