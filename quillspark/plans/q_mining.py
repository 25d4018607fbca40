"""Diagnosis mining on lines, text repair, and scalars of names, codes, dates and ages."""

from __future__ import annotations

from ..catalogs.conditions import CONDITIONS
from ..catalogs.cpt import CPT
from ..catalogs.icd import ICD
from ..functions import matching
from .both import both
from .q_detect import PHONE

# Phrases, conditions and labels.
CODE = r"\b[A-TV-Z]\d{2}\.\d{1,4}\b"
NEGATION = r"(?i)\b(no|denies|denied|without|negative|ruled?\s+out)\b"
PROCEDURE = r"(?i)(\bcpt\b|procedure|polysomnogra|titration)"
SKIPPED = r"(?i)(reference\s+range|specimen|lab\s+results?|medications?|review\s+of\s+systems|date\s+collected)"
REPAIRS = [("0xygen", "oxygen"), ("hypertensi0n", "hypertension"), ("pateint", "patient"), ("snornig", "snoring"), ("obstructve", "obstructive")]
ACTION_LABELS = [("Prior study evidence", "document_prior_study_evidence"), ("Obtain PCP referral", "obtain_pcp_referral"), ("Verify insurance", "verify_insurance")]
# End of fixed values.


def mined(q, t) -> str:
    """Each code of each line with the 50 characters before it: doc_id, line, code, before."""
    context = "[ -~]{0,50}?" + CODE
    raw = f"SELECT doc_id, line, {q.explode(q.extract_all('text', context))} AS ctx FROM {t.lines} WHERE {q.like('text', CODE)} AND NOT {q.like('text', SKIPPED)}"
    return f"(SELECT doc_id, line, ctx, {q.extract('ctx', CODE + '$')} AS code FROM ({raw}) AS r) AS mined"


def kept(q, t) -> str:
    """The first line of each code that is neither negated nor a procedure's."""
    return f"(SELECT doc_id, code, min(line) AS line FROM {mined(q, t)} WHERE NOT {q.like('ctx', NEGATION)} AND NOT {q.like('ctx', PROCEDURE)} GROUP BY 1, 2) AS kept"


@both("detect_dx_pages")
def detect_dx_pages(q, t):
    return f"SELECT doc_id, code, line FROM {kept(q, t)}"


@both("dx_generic_suppress")
def dx_generic_suppress(q, t):
    """Drops an unspecified code (second decimal 0) after another of its family."""
    generic = q.like("code", r"\.\d0$")
    numbered = f"SELECT doc_id, code, line, count(*) OVER (PARTITION BY doc_id, substring(code, 1, 5) ORDER BY line, code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {kept(q, t)}"
    return f"SELECT doc_id, code, line FROM ({numbered}) AS x WHERE NOT ({generic} AND n > 1)"


@both("dx_past_encounters")
def dx_past_encounters(q, t):
    """Lines of a description, a record number and a code."""
    p = r"([A-Za-z][A-Za-z ,-]{2,60}) (\d{6,10}) ([A-TV-Z]\d{2}(\.\d{1,4})?)"
    return f"SELECT doc_id, line, {q.extract('text', p, 1)} AS description, {q.extract('text', p, 2)} AS record, {q.extract('text', p, 3)} AS code FROM {t.lines} WHERE {q.like('text', p)}"


@both("dx_from_problems")
def dx_from_problems(q, t):
    """Conditions that a line names, any blanks between their words, without a negation in the 40 characters before."""
    names = {n: (n.replace(" ", r"\s+").replace("-", r"[-\s]"), c) for n, c in CONDITIONS}
    named = r"(?i)\b(?:" + "|".join(p for p, _ in names.values()) + r")\b"
    # What stands right before a condition counts against it, so hits that a negation leads are taken away.
    hits = q.hits("text", [(n + "|" + c, rf"(?i)\b({p})\b") for n, (p, c) in names.items()])
    denied = q.hits("text", [(n + "|" + c, rf"(?i)\b(no|denies|without)\s[ -~]{{0,40}}({p})\b") for n, (p, c) in names.items()])
    less = f"array_except(found, coalesce(denied, array()))" if q.name == "spark" else "list_filter(found, lambda v: NOT list_contains(coalesce(denied, []), v))"
    found = f"SELECT doc_id, line, {q.explode(less)} AS hit FROM (SELECT doc_id, line, {hits} AS found, {denied} AS denied FROM {t.picked('conditions', matching.having(named))}) AS h"
    return f"SELECT doc_id, {q.replace('hit', '[|].*$', '')} AS condition, {q.replace('hit', '^.*[|]', '')} AS code, min(line) AS line FROM ({found}) AS x GROUP BY 1, 2, 3"


@both("ocr_artifact")
def ocr_artifact(q, t):
    """Words of a line, and those that look misread: symbols, or letters and digits mixed."""
    ws = q.keep(q.split("text", "[ \t]+"), "w", "w <> ''")
    odd = q.keep(q.split("text", "[ \t]+"), "w", f"w <> '' AND ({q.like('w', '[|~^{}<>]')} OR {q.like('w', '[A-Za-z][0-9][A-Za-z]|[a-z][0-9]+$|^[0-9][a-z]')})")
    return f"SELECT doc_id, line, n_words, n_odd, n_odd * 2 > n_words AS artifact FROM (SELECT doc_id, line, {q.size(ws)} AS n_words, {q.size(odd)} AS n_odd FROM {t.lines} WHERE text IS NOT NULL) AS x WHERE n_odd > 0"


def repaired(q, x: str) -> str:
    for wrong, right in REPAIRS:
        x = q.replace(x, "(?i)" + wrong, right)
    return x


@both("ocr_text_repair")
def ocr_text_repair(q, t):
    wrong = "(?i)(" + "|".join(w for w, _ in REPAIRS) + ")"
    return f"SELECT doc_id, line, {repaired(q, 'text')} AS text FROM {t.lines} WHERE {q.like('text', wrong)}"


@both("cer_wer")
def cer_wer(q, t):
    """Edits from the repaired line to the read one, over its length; the word rate ignores runs of blanks."""
    wrong = "(?i)(" + "|".join(w for w, _ in REPAIRS) + ")"
    norm = lambda x: f"lower(trim({x}))"
    joined = lambda x: q.replace(x, "[ \t]+", "")
    few = f"SELECT doc_id, line, {norm(repaired(q, 'text'))} AS truth, {norm('text')} AS got FROM {t.lines} WHERE {q.like('text', wrong)}"
    return f"SELECT doc_id, line, CAST(levenshtein(truth, got) AS DOUBLE) / length(truth) AS cer, CAST(levenshtein({joined('truth')}, {joined('got')}) AS DOUBLE) / length({joined('truth')}) AS wer FROM ({few}) AS x WHERE length(truth) > 0"


@both("sim_percent")
def sim_percent(q, t):
    """Rounded half up, of trimmed lower-case values, over the longer one before trimming."""
    longest = "greatest(length(s_name), length(n_name))"
    return f"SELECT s_suppkey, CAST(floor((1 - CAST(levenshtein(lower(trim(s_name)), lower(trim(n_name))) AS DOUBLE) / {longest}) * 100 + 0.5) AS BIGINT) AS percent FROM {t.supplier} JOIN {t.nation} ON s_nationkey = n_nationkey"


@both("json_repair")
def json_repair(q, t):
    """Lines that look like objects, with quotes, bare keys and trailing commas mended."""
    x = q.replace("text", "'", '"')
    x = q.replace(x, r"([{,])\s*([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    x = q.replace(x, r",\s*([}\]])", "$1")
    return f"SELECT doc_id, line, {x} AS json FROM {t.lines} WHERE {q.like('text', r'^[{].*[}]$')}"


@both("action_labels")
def action_labels(q, t):
    """Names of actions in snake case, and their labels."""
    snake = q.replace(q.replace("lower(label)", "[^a-z0-9]+", "_"), "^_|_$", "")
    table = q.values("action", "label, name", ACTION_LABELS)
    return f"SELECT label, name, {snake} AS snake FROM {table}"


@both("age_functions")
def age_functions(q, t):
    """Full years, difference of years, and years of 365.25 days, from order date to 2024-06-30."""
    full = "2024 - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) > 630 THEN 1 ELSE 0 END"
    days = "CAST(datediff(DATE '2024-06-30', CAST(o_orderdate AS DATE)) AS DOUBLE)" if q.name == "spark" else "CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2024-06-30') AS DOUBLE)"
    return f"SELECT o_orderkey, CAST({full} AS BIGINT) AS full_years, CAST(2024 - year(o_orderdate) AS BIGINT) AS year_difference, {days} / 365.25 AS fraction FROM {t.orders}"


@both("date_pivots")
def date_pivots(q, t):
    """Two-digit years under both pivots: from 70 on, and above 50, they are of the last century."""
    p = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2})\b"
    yy = f"CAST({q.extract('text', p, 3)} AS INT)"
    return f"SELECT doc_id, line, yy + CASE WHEN yy >= 70 THEN 1900 ELSE 2000 END AS year_dates, yy + CASE WHEN yy > 50 THEN 1900 ELSE 2000 END AS year_hints FROM (SELECT doc_id, line, {yy} AS yy FROM {t.lines} WHERE {q.like('text', p)}) AS x"


@both("filename_build")
def filename_build(q, t):
    """Last_First_code_date.pdf of labelled names."""
    p = r"Name:\s*([A-Za-z'-]+),\s*([A-Za-z'-]+)"
    clean = lambda x: f"substring({q.replace(q.replace(x, '[^a-zA-Z0-9 -]', ''), ' +', '_')}, 1, 50)"
    last, first = q.extract("text", p, 1), q.extract("text", p, 2)
    return f"SELECT doc_id, concat({clean(last)}, '_', {clean(first)}, '_95810_20240630.pdf') AS filename FROM {t.lines} WHERE {q.like('text', p)}"


@both("name_address_parse")
def name_address_parse(q, t):
    """Street, city, state and ZIP of one-line addresses."""
    p = r"(\d{1,6} [A-Za-z0-9 .]{3,40}), ([A-Za-z .]{2,30}), ([A-Z]{2}) (\d{5})"
    return f"SELECT doc_id, line, {q.extract('text', p, 1)} AS street, {q.extract('text', p, 2)} AS city, {q.extract('text', p, 3)} AS state, {q.extract('text', p, 4)} AS zip FROM {t.lines} WHERE {q.like('text', p)}"


@both("code_cleaning")
def code_cleaning(q, t):
    """The first phone of each line as (ddd) ddd-dddd."""
    digits = q.replace(q.extract("text", PHONE), "[^0-9]", "")
    return f"SELECT doc_id, line, concat('(', substring(digits, 1, 3), ') ', substring(digits, 4, 3), '-', substring(digits, 7, 4)) AS phone FROM (SELECT doc_id, line, {digits} AS digits FROM {t.lines} WHERE {q.like('text', PHONE)}) AS x"


@both("rule_engine_codes")
def rule_engine_codes(q, t):
    """The intended score of codes in a line: catalog phrase 10, a label 20, a header line -30; best code of a document."""
    hits = q.some(*[f"CASE WHEN {q.like('text', '(?i)(' + '|'.join(ps) + ')')} THEN '{c}' END" for c, _, ps in CPT])
    found = f"SELECT doc_id, line, text, {q.explode(hits)} AS code FROM {t.lines}"
    order = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _, _) in enumerate(CPT)) + " END"
    score = f"10 + CASE WHEN {q.like('text', r'(?i)(cpt|order|procedure)')} THEN 20 ELSE 0 END - CASE WHEN {q.like('text', r'(?i)(fax|cover|confidential)')} THEN 30 ELSE 0 END"
    ranked = f"SELECT doc_id, code, {score} AS score, row_number() OVER (PARTITION BY doc_id ORDER BY {score} DESC, {order}, line) AS place FROM ({found}) AS f"
    return f"SELECT doc_id, code, score FROM ({ranked}) AS x WHERE place = 1"


@both("rule_engine_icd")
def rule_engine_icd(q, t):
    """The intended score of diagnosis codes: allowed 10, labelled 20, so far as a line holds them."""
    allowed = ", ".join(f"'{c}'" for c, _ in ICD)
    return f"SELECT doc_id, line, code, CASE WHEN code IN ({allowed}) THEN 10 ELSE 0 END + CASE WHEN {q.like('ctx', r'(?i)(icd|diagnosis)')} THEN 20 ELSE 0 END AS score FROM {mined(q, t)}"


@both("section_by_y")
def section_by_y(q, t):
    """Header above 10 % and footer below 90 % of a page's lines; the section's keywords between."""
    return f"SELECT doc_id, line, CASE WHEN line * 10 < n THEN 'header' WHEN line * 10 >= n * 9 THEN 'footer' ELSE coalesce(section, 'body') END AS zone FROM (SELECT doc_id, line, section, count(*) OVER (PARTITION BY doc_id) AS n FROM {t.lines} WHERE text IS NOT NULL) AS x"


@both("stream_bounded_state")
def stream_bounded_state(q, t):
    """The last 500 events of each type, by time and id: what a bounded buffer would hold at the end."""
    return f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM {t.events}) AS x WHERE place <= 500"
