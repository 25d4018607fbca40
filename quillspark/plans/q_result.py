"""What a document says, one row a document: carrier, procedure codes, diagnoses, patient and identifiers.

Catalogs go into expressions, so a text is matched in one projection and is never joined with its patterns. Only what is
derived from lines is grouped by document, as a few short columns.
"""

from __future__ import annotations

import datetime

from ..catalogs import carriers as C
from ..catalogs import cpt as P
from ..catalogs import dme as D
from ..catalogs import icd as I
from ..functions import matching
from ..functions import text as T

#: The day that rules on ages and contracts take as today.
AS_OF = datetime.date(2025, 10, 10)

# Phrases and code sets.
TITRATION = ["titration", "pressure too high", "pressure too low", "increase pressure", "decrease pressure", "not tolerating", "failed cpap", "failed pap", "failed apap", "bipap", "bi pap", "asv", "intolerance"]
SLEEP_DX = ["G47.33", "G47.30", "G47.31", "G47.37", "R06.83", "R06.09", "R53.83", "G25.81", "F51.9"]
SLEEP_STUDIES = ["95811", "95810", "95806", "G0399", "95782", "95783", "95805"]
ICD_WEIGHT = {"G47.30": 0, "G47.33": 1, "G47.31": 2, "G47.37": 3, "G47.10": 4, "G47.00": 4, "R06.83": 4, "R06.09": 4, "R53.83": 4, "G25.81": 4, "F51.9": 4}
NON_PATIENT_LABEL = r"(?i)(from|to|subject|company|facility|provider|attention|attn|fax|cc|re:|regarding)"
DISCLAIMER = r"(?i)(fax|sensitive|confidential|destroy|unauthorized|disclosure|records|recipient|notify|error|intended)"
TIMESTAMP = r"(?i)\d{1,2}[:\-]\d{2}\s*(am|pm|et|pt|ct|mt|utc|gmt)|^\d{2}-\d{2}-\d{4}\s+\d{1,2}:\d{2}"
ADDRESS = r"(?i)\b(rd|road|st|street|ave|avenue|blvd|boulevard|dr|drive|ln|lane|ct|court|way|pkwy|parkway|pl|place|ste|suite|apt|unit|floor|#\d+)\b|,\s*[A-Z]{2}\s+\d{5}|,\s*(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY)\b"
APPOINTMENT = r"(?i)\b(dis\s*ease|disease|chronic|mgnt|management|appointment|visit|consultation|referral|follow.?up|wellness|physical|exam|screening|procedure)\b"
NAME = r"[A-Za-z\p{L}'’\-]+"
DATE = r"\b(0?[1-9]|1[0-2])[/\-.,_\s‐-―−]*(0?[1-9]|[12]\d|3[01])[/\-.,_\s‐-―−]*((?:19|20)\d{2})\b"
DOB_LABEL = r"(?i)(dob(?:\s*/\s*age)?|d\.\s*o\.\s*b\.|date\s*of\s*birth)\s*[:\-]?\s*(.*)$"
AGE = r"(?i)\bage\s*[:\-]?\s*(\d{1,3})\b"
NOT_DOB = r"(?i)(referral\s*date|order\s*date|date\s*of\s*service|dos\b|service\s*date|signed|signature|fax|scanned|printed|report\s*date|visit\s*date|appt|appointment|today|now)"
SECTION_BOOST = {"demographics": 10, "provider": -2, "cover": -6}
ICD_CODE = r"\b[A-TV-Z][0-9]{2}(?:[.\-\s]?[0-9A-Z]{1,4})?\b"
ICD_LABEL = r"(?i)(icd-?10|\bicd\b|\bdx\b|diagnos(?:is|es)|assessment|impression)\b"
ICD_SKIP = r"(?i)(\bCPT\b|procedure|9580(?:6|10|11))"
# End of fixed values.


def squeezed(q, x: str) -> str:
    # Capitals are taken letter by letter, so they may come before the blanks are joined.
    return f"trim({q.replace(q.upper(x), r'\s+', ' ')})" if q.name == "spark" else f"upper(trim({q.replace(x, r'\s+', ' ')}))"


# Carriers

_DNA, _ACCEPTED, _SELF = ([" ".join(n.upper().split()) for n in names] for names in (C.NOT_ACCEPTED, C.ACCEPTED, C.SELF_PAY))


def _status(name: str, status: str) -> str:
    name = " ".join(name.upper().split())
    return "not_accepted" if name in _DNA else "accepted" if name in _ACCEPTED and status == "unknown" else status


def contract_days(name: str) -> int | None:
    end = dict(C.CONTRACT_END).get(name)
    return (datetime.date.fromisoformat(end) - AS_OF).days if end else None


#: name, status, reason by place: the catalog's carriers, then the names of the policies.
CARRIER_ROWS = (
    [(n, "not_accepted" if (contract_days(n) or 0) < 0 else _status(n, s), "carrier_detect") for n, s, _ in C.CARRIERS]
    + [(n, "not_accepted", "carrier_policies_dna") for n in _DNA]
    + [(n, "accepted", "carrier_policies_accepted") for n in _ACCEPTED]
    + [("Self Pay", "self_pay", "carrier_policies_selfpay") for _ in _SELF]
)


#: Texts without one of these name no carrier.
CARRIER_MARKS = tuple(dict.fromkeys([f"(?i:{p})" for _, _, ps in C.CARRIERS for p in ps] + [matching.spelled(n) for n in _DNA + _ACCEPTED + _SELF]))


def carriers(q, source: str, x: str = "text", keep: str = "doc_id") -> str:
    """Of each row of source the carrier that x names first; of equal places the catalog's first; else a name of the policies."""
    rows = q.values("carrier_rows", "ord, carrier, status, why", [(i, *r) for i, r in enumerate(CARRIER_ROWS)])
    spotted = f"SELECT {keep}, {squeezed(q, 'body')} AS u, {q.first_spot('body', [ps for _, _, ps in C.CARRIERS])} AS k FROM (SELECT {keep}, coalesce({x}, '') AS body FROM {source}) AS s0"
    placed = f"SELECT {keep}, u, CAST(coalesce(k % 1000, {q.first_of('u', _DNA + _ACCEPTED + _SELF, len(C.CARRIERS))}) AS INT) AS place FROM ({spotted}) AS s1"
    return f"(SELECT {keep}, u, carrier, status, why FROM ({placed}) AS s2 LEFT JOIN {rows} ON ord = place) AS carriers"


def main_carriers(q, t) -> str:
    """carriers of all documents; in Spark without u, and written once."""
    rows = carriers(q, t.blanked(*CARRIER_MARKS))
    return t.stored("carriers", f"(SELECT doc_id, carrier, status, why FROM {rows})") if q.name == "spark" else rows


# Procedure codes


def cpt(q, t) -> str:
    """Of each text with a code: cpt, candidates, ambiguity (both joined by commas), n_ambiguity, intent, titration."""
    codes = [c for c, _, _ in P.CPT]
    hit = ", ".join(f"{q.like('text', '(?i)(' + '|'.join(ps) + ')')} AS h_{c}" for c, _, ps in P.CPT)

    def intent(c: str) -> str:
        verb = lambda p: q.like("text", f"(?i)({p}){c}")
        return f"CASE WHEN {verb(r'order.{0,55}')} THEN 5 WHEN {verb(r'request.{0,53}')} THEN 4 WHEN {verb(r'schedule.{0,52}')} THEN 3 WHEN {verb(r'consider.{0,52}|evaluate.{0,52}|ruling\s*out.{0,50}')} THEN 2 ELSE 1 END"

    intents = ", ".join(f"{intent(c)} AS i_{c}" for c in codes)
    titration = " OR ".join(q.contains("upper(text)", q.text(p.upper())) for p in TITRATION)
    any_code = "(?i)(" + "|".join(p for _, _, ps in P.CPT for p in ps) + ")"
    if q.name == "spark":
        verbs = {5: r"order.{0,55}", 4: r"request.{0,53}", 3: r"schedule.{0,52}", 2: r"consider.{0,52}|evaluate.{0,52}|ruling\s*out.{0,50}"}
        flags = {f"h_{c}": "(?i)(" + "|".join(ps) + ")" for c, _, ps in P.CPT} | {f"v{k}_{c}": f"(?i)({p}){c}" for c in codes for k, p in verbs.items()}
        intents = ", ".join("CASE " + " ".join(f"WHEN v{k}_{c} THEN {k}" for k in verbs) + f" ELSE 1 END AS i_{c}" for c in codes)
        signs = {f"v{k}_{c}": f"(?i){c}" for c in codes for k in verbs}  # few texts have a code's number, and the gaps of verbs don't join well
        found = f"SELECT *, {intents} FROM {t.flagged(flags, {'titration': [p.upper() for p in TITRATION]}, (any_code,), signs=signs)}"
    else:
        found = f"SELECT doc_id, {hit}, {intents}, ({titration}) AS titration FROM (SELECT doc_id, coalesce(text, '') AS text FROM {t.intake}) AS a WHERE {q.like('text', any_code)}"
    listed = q.some(*[f"CASE WHEN h_{c} THEN '{c}' END" for c in codes])
    child = "CASE WHEN h_95783 AND (NOT h_95782 OR i_95783 >= i_95782) THEN '95783' WHEN h_95782 THEN '95782' END"
    child_rank = "greatest(CASE WHEN h_95783 THEN i_95783 ELSE 0 END, CASE WHEN h_95782 THEN i_95782 ELSE 0 END)"
    first = f"SELECT *, {listed} AS codes, CASE WHEN {child} IS NOT NULL AND {child_rank} >= CASE WHEN h_95810 THEN i_95810 ELSE 0 END THEN {child} ELSE {q.get(listed, 1)} END AS first FROM ({found}) AS b"
    grown = "first NOT IN ('95782', '95783')"
    primary = f"SELECT *, CASE WHEN h_95811 AND {grown} THEN CASE WHEN titration OR NOT h_95810 THEN '95811' ELSE '95810' END WHEN h_95810 AND {grown} THEN '95810' ELSE first END AS cpt, h_95811 AND {grown} AND NOT titration AS lacks, (h_G0399 OR h_95806) AND (h_95810 OR h_95811) AS homes FROM ({first}) AS c"
    weak = "cpt = '95810' AND ((h_95806 AND i_95806 = 1) OR (h_G0399 AND i_G0399 = 1))"
    pruned = q.keep("codes", "v", "NOT ((v = '95806' AND i_95806 = 1) OR (v = 'G0399' AND i_G0399 = 1))")
    reordered = f"CASE WHEN {weak} THEN {q.join(pruned, ',')} ELSE {q.join(q.array('cpt', q.join(q.keep('codes', 'v', 'v <> cpt'), ',')), ',')} END"
    left_home = "(h_95806 AND i_95806 > 1) OR (h_G0399 AND i_G0399 > 1)"
    amb = [
        "CASE WHEN lacks AND h_95810 THEN 'cpt_95811_without_evidence' END",
        "CASE WHEN lacks AND NOT h_95810 THEN 'cpt_95811_lacks_support' END",
        f"CASE WHEN homes AND NOT ({weak} AND NOT ({left_home})) THEN 'cpt_home_and_inlab_conflict' END",
        f"CASE WHEN {q.size('codes')} > 1 AND ({q.size('codes')} > 2 OR NOT (lacks OR homes)) AND NOT ({weak} AND {q.size(pruned)} = 1) THEN 'cpt_multiple_detected' END",
    ]
    chosen = " ".join(f"WHEN '{c}' THEN i_{c}" for c in codes)
    out = f"SELECT doc_id, cpt, titration, {q.replace(reordered, ',$', '')} AS candidates, {q.some(*amb)} AS amb, CASE cpt {chosen} END AS intent FROM ({primary}) AS d"
    return t.stored("procedures", f"(SELECT doc_id, cpt, titration, candidates, {q.join('amb', ',')} AS ambiguity, {q.size('amb')} AS n_ambiguity, intent FROM ({out}) AS e)")


# Diagnosis codes


def icd_codes(q, t) -> str:
    """Codes by pass: 1 on labelled lines and the two after them, 2 anywhere but on procedure lines; the first pass with any wins."""
    label = q.like("text", ICD_LABEL)
    near = " OR ".join([label, *[f"coalesce(lag({label}, {k}) OVER (PARTITION BY doc_id ORDER BY line), false)" for k in (1, 2)]])
    rows = f"SELECT doc_id, line, pass, {q.explode(q.extract_all('text', ICD_CODE))} AS raw FROM (SELECT doc_id, line, text, CASE WHEN {near} THEN 1 WHEN {q.like('text', ICD_SKIP)} THEN 9 ELSE 2 END AS pass FROM {t.picked('icd', matching.having(ICD_CODE), -1, -2)}) AS a WHERE {q.like('text', ICD_CODE)}"
    listed = ", ".join(f"'{c.replace('.', '')}'" for c, _ in I.ICD)
    kept = f"SELECT doc_id, icd, min(pass) AS pass, min(line) AS line FROM (SELECT doc_id, line, pass, {T.icd_normalized(q, 'raw')} AS icd FROM ({rows}) AS b) AS c WHERE pass < 9 AND {q.replace('icd', '[.]', '')} IN ({listed}) GROUP BY 1, 2"
    return t.stored("icds", f"(SELECT doc_id, icd, pass, line FROM (SELECT doc_id, icd, pass, line, min(pass) OVER (PARTITION BY doc_id) AS best FROM ({kept}) AS d) AS e WHERE pass = best)")


def ranked_icds(q, t) -> str:
    """Codes of each document in order: for sleep studies by weight, else as found; an obstructive code goes before a leading G47.37."""
    weight = "CASE icd " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ICD_WEIGHT.items()) + " ELSE 10 END"
    studies = ", ".join(f"'{c}'" for c in SLEEP_STUDIES)
    weighed = f"SELECT icds.doc_id, icd, line, coalesce(cpt IN ({studies}), false) AS study, CASE WHEN coalesce(cpt IN ({studies}), false) THEN {weight} ELSE 0 END AS w FROM {icd_codes(q, t)} LEFT JOIN {cpt(q, t)} ON procedures.doc_id = icds.doc_id"
    placed = f"SELECT doc_id, icd, study, row_number() OVER (PARTITION BY doc_id ORDER BY w, line, icd) AS place FROM ({weighed}) AS a"
    spots = f"SELECT *, max(CASE WHEN icd = 'G47.37' THEN place END) OVER (PARTITION BY doc_id) AS p37, max(CASE WHEN icd = 'G47.33' THEN place END) OVER (PARTITION BY doc_id) AS p33 FROM ({placed}) AS b"
    swap = "study AND p37 = 1 AND p33 IS NOT NULL"
    return f"(SELECT doc_id, icd, CASE WHEN {swap} AND icd = 'G47.37' THEN p33 WHEN {swap} AND icd = 'G47.33' THEN p37 ELSE place END AS place FROM ({spots}) AS c) AS ranked"


# The patient


def fused(score: str) -> str:
    """A candidate's score with the priors of its section and page."""
    boost = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SECTION_BOOST.items()) + " ELSE 0 END"
    return f"({score} + {boost} + least(CAST(3 AS DOUBLE), 0.25 * (page - 1)))"


def names(q, t) -> str:
    """The best name of each document: after a patient label, after a name label, or in the first 200 lines."""
    label, generic = r"(?i)^\s*(patient\s*(?:name|information)?|pt\s*name)\s*[:\-]?\s*(.*)$", r"(?i)(name)\s*[:\-]\s*(.*)$"
    # Of a line that is no header and no non-person's, the score is below 2 unless it is a provider's and not a patient's.
    low_score = lambda x: f"(NOT {T.is_provider(q, x)} OR ({T.is_patient(q, x)} AND NOT {T.is_fax(q, x)}))" if q.name == "spark" else f"{T.context_score(q, x)} < 2"
    guard = lambda x: f"{x} IS NOT NULL AND {x} <> '' AND NOT {T.is_header(q, x)} AND NOT {T.is_non_patient(q, x)} AND NOT {q.like(x, DISCLAIMER)} AND NOT {q.like(x, TIMESTAMP)} AND NOT {q.like(x, ADDRESS)} AND NOT {q.like(x, APPOINTMENT)} AND {low_score(x)}"
    lf, fl = rf"\b({NAME})\s*,\s*({NAME})(?:\s+({NAME}))?\b", rf"\b({NAME})\s+({NAME})(?:\s+({NAME}))?\b"

    def choice(text, line):
        # Labelled lines, and those that the scan of the first lines takes; lower case as SQL has it.
        low = matching.pc.utf8_lower(text)
        barred = matching.mask(low, T.STRICT, T.NON_PERSONS) | matching.mask(text, NON_PATIENT_LABEL, DISCLAIMER, TIMESTAMP, ADDRESS, APPOINTMENT)
        return matching.mask(text, label, generic), (line < 200) & ~barred & matching.mask(text, lf, fl)

    lines = t.picked("names", choice, 1)
    lines = t.stored("name_lines", f"(SELECT * FROM {lines})") if q.name == "spark" else lines
    rows = f"SELECT doc_id, page, line, section, text, lead(text) OVER (PARTITION BY doc_id, page ORDER BY line) AS follows FROM {lines}"
    labelled = f"SELECT doc_id, page, line, section, trim({q.extract('text', label, 2)}) AS a, trim(follows) AS b FROM ({rows}) AS r WHERE {q.like('text', label)}"
    open_ = f"SELECT doc_id, page, line, section, trim({q.extract('text', generic, 2)}) AS a, trim(follows) AS b FROM ({rows}) AS r WHERE {q.like('text', generic)} AND NOT {T.is_header(q, 'text')} AND NOT {T.is_non_patient(q, 'text')} AND NOT {T.is_provider(q, 'text')} AND NOT {q.like('text', NON_PATIENT_LABEL)}"
    both = f"SELECT * FROM ({labelled}) AS l1 UNION ALL SELECT * FROM ({open_}) AS l2"
    scan = f"SELECT doc_id, page, line, section, text AS x, greatest(0, 20 - line) AS score FROM {lines} WHERE line < 200 AND NOT {q.like('text', NON_PATIENT_LABEL)}"
    texts = f"SELECT doc_id, page, line, section, a AS x, 10 AS score FROM ({both}) AS l3 UNION ALL SELECT doc_id, page, line, section, b, 10 FROM ({both}) AS l4 UNION ALL {scan}"
    some = f"(SELECT * FROM ({texts}) AS t0 WHERE {guard('x')})"
    guarded = t.stored("guarded", some) if q.name == "spark" else "guarded"
    split = " UNION ALL ".join(
        f"SELECT doc_id, page, line, section, score, {o} AS ord, {T.title_case(q, q.extract('x', p, a))} AS last_name, {T.title_case(q, q.extract('x', p, b))} AS first_name FROM {guarded} WHERE {q.like('x', p)}" for o, p, a, b in ((0, lf, 1, 2), (1, fl, 2, 1))
    )
    plausible = lambda a, b: f"{T.plausible_name(q, a)} AND {T.plausible_name(q, b)} AND NOT {q.like(full(a, b), ADDRESS)} AND NOT {q.like(full(a, b), APPOINTMENT)}"
    full = lambda a, b: f"concat({a}, ', ', {b})"
    # Bound once: a filter that is pushed down would compute a name wherever it stands.
    fit = f"get(transform(array(named_struct('l', last_name, 'f', first_name)), w -> {plausible('w.l', 'w.f')}), 0)" if q.name == "spark" else plausible("last_name", "first_name")
    ranked = f"SELECT doc_id, last_name, first_name, {fused('score')} AS fused, row_number() OVER (PARTITION BY doc_id ORDER BY {fused('score')} DESC, score DESC, page DESC, line, ord, last_name, first_name) AS place FROM ({split}) AS s WHERE {fit}"
    return t.stored("names", f"({'' if q.name == 'spark' else f'WITH guarded AS {some} '}SELECT doc_id, first_name, last_name, fused AS score FROM ({ranked}) AS n WHERE place = 1 AND fused >= 0)")


def births(q, t) -> str:
    """The best birth date of each document: after a label, on the two lines below one, elsewhere, or the first plausible date."""
    year = f"CAST({q.extract('{x}', DATE, 3)} AS INT)"
    value = lambda x: f"concat(lpad({q.extract(x, DATE, 1)}, 2, '0'), '/', lpad({q.extract(x, DATE, 2)}, 2, '0'), '/', {q.extract(x, DATE, 3)})"
    label = f"(line < 240 AND {q.like('text', DOB_LABEL)})"
    rows = f"SELECT doc_id, page, line, section, text, {q.extract('text', DOB_LABEL, 2)} AS tail, {label} AS label, coalesce(lag({label}, 1) OVER (PARTITION BY doc_id ORDER BY line), false) OR coalesce(lag({label}, 2) OVER (PARTITION BY doc_id ORDER BY line), false) AS below FROM {t.picked('births', matching.having(DATE), -1, -2)}"
    age = f"SELECT doc_id AS aged, {q.to_int(q.extract('text', AGE, 1))} AS age FROM {t.blanked(AGE)}"
    quiet = f"line < 300 AND NOT {q.like('text', NOT_DOB)} AND NOT {T.is_header(q, 'text')} AND NOT {T.is_non_patient(q, 'text')} AND NOT {T.is_provider(q, 'text')}"
    whole = f"SELECT doc_id, page, line, section, {value('text')} AS value, {year.replace('{x}', 'text')} AS y, CASE WHEN below THEN 6 WHEN {quiet} THEN 0 END AS bonus FROM ({rows}) AS r WHERE {q.like('text', DATE)}"
    same = f"SELECT doc_id, page, line, section, {value('tail')} AS value, {year.replace('{x}', 'tail')} AS y, 10 AS bonus FROM ({rows}) AS r WHERE label AND {q.like('tail', DATE)}"
    agree = f"CASE WHEN age IS NULL THEN 0 WHEN abs({AS_OF.year} - y - age) <= 2 THEN 5 WHEN abs({AS_OF.year} - y - age) <= 5 THEN 2 ELSE -4 END"
    score = f"(greatest(0, 20 - line) + {agree} + bonus)"
    scored = f"SELECT doc_id, page, line, value, CASE WHEN bonus IS NULL OR {fused(score)} < 0 THEN NULL ELSE {fused(score)} END AS fused FROM ({same} UNION ALL {whole}) AS c LEFT JOIN ({age}) AS ages ON aged = doc_id WHERE y BETWEEN 1900 AND {AS_OF.year - 1}"
    return t.stored("births", f"(SELECT doc_id, value AS dob, coalesce(fused, -1) AS score FROM (SELECT doc_id, value, fused, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN fused IS NULL THEN 1 ELSE 0 END, fused DESC, page DESC, line, value) AS place FROM ({scored}) AS d) AS e WHERE place = 1)")


def equipment(q) -> dict[str, str]:
    """Patterns of equipment vendors and codes."""
    return {"vendor": r"(?i)\b(" + "|".join(D.VENDORS) + r")\b", "code": r"(?i)\b(" + "|".join(D.CODES) + r")\b"}
