"""The queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from . import decontam, langid, mixing, pii, pseudolm, quality, secrets, simhash, suffixes, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontam": decontam.op3_decontam,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_secrets": secrets.op6_secrets,
    "op7_pseudolm": pseudolm.op7_pseudolm,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_langid": langid.op9_langid,
    "op10_pii": pii.op10_pii,
}
ORACLE_SQL = {"op2_mixing": mixing.ORACLE_SQL}
