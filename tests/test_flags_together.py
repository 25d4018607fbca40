"""Patterns of a text are looked for together, and each by itself only in the texts that have any of them."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from quillspark.catalogs import cpt as P
from quillspark.functions import matching
from quillspark.plans import both, q_decide
from quillspark.plans import q_result as R
from quillspark.functions.sqltext import SPARK

CODES = [c for c, _, _ in P.CPT]
TEXTS = pa.array(
    ["", "plain words", "failed hsat, denies snoring, cpap titration", "reports pain but denies pain", "recurrent falls oxycodone o2 use", "Group # A1", "pcp referral, COPD", "95810 order 95811 schedule 95806 g0399", "sleep study"]
    + [w + c for c in CODES for w in ("Order a ", "request x", "schedule ", "ruling  out ", "", "order" + 60 * "-")]
)


def test_a_text_without_flags_is_looked_through_once(monkeypatch):
    seen = []
    has = matching.has
    monkeypatch.setattr(matching, "has", lambda x, p: seen.append(len(x)) or has(x, p))
    ps = list(q_decide.TEXT_FLAGS.values())
    assert not any(m.any() for m in matching.several(pa.array(["plain words", ""]), ps, ps)) and seen == [2]


def test_flags_together_are_those_of_each_pattern(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(TEXTS.to_pylist())), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    monkeypatch.setattr(matching, "flagged", lambda pages, *a, f=matching.flagged: asked.append(a) or f(pages, *a))
    R.cpt(SPARK, both.Names(spark, str(tmp_path)))
    flags, signs = asked[0][0], asked[0][4]
    for fs, by in ((flags, signs), (q_decide.TEXT_FLAGS, {})):
        got = matching.several(TEXTS, list(fs.values()), [by.get(k, p) for k, p in fs.items()])
        assert [m.tolist() for m in got] == [pc.match_substring_regex(TEXTS, p).to_pylist() for p in fs.values()]
    assert all(any(pc.match_substring_regex(TEXTS, p).to_pylist()) for k, p in flags.items() if k.startswith("v"))
