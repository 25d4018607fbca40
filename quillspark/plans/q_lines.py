"""Queries on pages, lines and values."""

from __future__ import annotations

from ..functions import text as T
from .both import both


@both("normalize_pages")
def normalize_pages(q, t):
    full = T.normalized(q, "text")
    return f"SELECT doc_id, page, {full} AS full_text, CAST({q.size(q.split(full, r'\r?\n'))} AS INT) AS n_lines, {q.sha256(full)} AS digest FROM {t.intake}"


@both("tag_section")
def tag_section(q, t):
    return f"SELECT doc_id, page, coalesce(section, 'none') AS section, count(*) AS n_lines, min(line) AS first_line FROM {t.lines} GROUP BY 1, 2, 3"


@both("guard_line_report")
def guard_line_report(q, t):
    flag = lambda c: f"CAST(sum(CAST({c} AS INT)) AS BIGINT)"
    return f"""SELECT coalesce(lang, 'fixture') AS lang, count(*) AS n_lines, {flag("section = 'cover'")} AS n_cover,
      {flag("section = 'demographics'")} AS n_demographics, {flag("section = 'provider'")} AS n_provider,
      {flag(T.is_header(q, 'lines.text'))} AS n_header, {flag(T.is_non_patient(q, 'lines.text'))} AS n_non_patient,
      {flag(T.is_provider(q, 'lines.text'))} AS n_provider_line, {flag(T.is_fax(q, 'lines.text'))} AS n_fax,
      {flag(T.is_from(q, 'lines.text'))} AS n_from
      FROM {t.lines} LEFT JOIN {t.documents} ON lines.doc_id = documents.doc_id GROUP BY 1"""


for _name, _f in {"guard_header": T.is_header, "guard_nonpatient": T.is_non_patient, "guard_provider": T.is_provider, "guard_fax": T.is_fax, "guard_from": T.is_from}.items():

    @both(_name)
    def guard(q, t, f=_f):
        return f"SELECT doc_id, page, line, text FROM {t.lines} WHERE {f(q, 'text')}"


@both("context_score")
def context_score(q, t):
    return f"SELECT doc_id, page, line, {T.context_score(q, 'text')} AS score FROM {t.lines}"


@both("strip_address_tail")
def strip_address_tail(q, t):
    return f"SELECT doc_id, page, line, {T.strip_address_tail(q, 'text')} AS head FROM {t.lines} WHERE text <> ''"


@both("plausible_name")
def plausible_name(q, t):
    return f"SELECT doc_id, page, line, {T.plausible_name(q, 'text')} AS plausible FROM {t.lines}"


@both("not_member_id")
def not_member_id(q, t):
    word = f"{q.extract('text', r'[0-9][0-9A-Za-z()/-]+', 0)}"
    return f"SELECT doc_id, page, line, v AS value, {T.likely_not_member_id(q, 'v')} AS rejected FROM (SELECT doc_id, page, line, {word} AS v FROM {t.lines}) AS x"


@both("valid_nanp")
def valid_nanp(q, t):
    digits = q.replace("text", "[^0-9]", "")
    return f"SELECT doc_id, page, line, d AS digits, {T.valid_nanp(q, 'd', False)} AS dialable, {T.valid_nanp(q, 'd')} AS accepted FROM (SELECT doc_id, page, line, {digits} AS d FROM {t.lines}) AS x WHERE length(d) = 10"


@both("is_placeholder")
def is_placeholder(q, t):
    return f"SELECT c_custkey, {T.is_placeholder(q, 'v')} AS placeholder FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN ' TBD ' WHEN 3 THEN NULL ELSE c_name END AS v FROM {t.customer}) AS x"


@both("allowlist_blacklist")
def allowlist_blacklist(q, t):
    return f"""SELECT o_orderkey, o_custkey FROM {t.orders} WHERE o_custkey IN (SELECT c_custkey FROM {t.customer} WHERE c_nationkey < 10)
      AND NOT EXISTS (SELECT 1 FROM {t.customer} WHERE c_custkey = o_custkey AND c_acctbal < 0)"""


# Signals of each kind of page and their weights, in the order in which ties are decided.
PAGE_SIGNALS = {
    "order": [(r"\border\s+(name|information|detail)", 3), (r"\bprocedure\s+code", 3), (r"\bplace\s+of\s+service", 2), (r"\bordering\s+provider", 2), (r"\bpre-op\s+orders?\b", 3), (r"\bauthorization.*not\s*required", 2), (r"\bicd[\s-]*10", 1), (r"\belectronically\s+signed\s+by", 1)],
    "facesheet": [(r"\bfacesheet\b", 5), (r"\bdemographics\b", 2), (r"\bprimary\s+insurance", 2), (r"\bsecondary\s+insurance", 2), (r"\bpreferred\s+(?:pharmacy|lab|imaging)", 2), (r"\bproblems?\b[\s\S]{0,30}\breviewed", 2), (r"\bportal\s+registration", 1), (r"\bhome\s+phone\b.*\bmobile\s+phone\b", 2)],
    "encounter": [(r"\bchief\s+complaint", 3), (r"\bassessment\s*/?\s*plan", 3), (r"\bhistory\s+of\s+present", 3), (r"\breview\s+of\s+systems", 2), (r"\bphysical\s+exam", 2), (r"\bencounter\s+date", 2)],
    "referral_note": [(r"\breferral\s+note\b", 5), (r"\breason\s+for\s+referral", 3), (r"\btable\s+of\s+contents", 2), (r"\bpast\s+encounters?\b", 2)],
    "lab": [(r"\blabcorp\b", 4), (r"\bquest\s+diagnostics", 4), (r"\breference\s+(range|interval)", 3), (r"\bspecimen\s+(id|source|coll)", 3), (r"\bpreliminary\s+report", 2), (r"\b(mg/dl|mmol/l|x10e3|iu/l|ng/ml|pg/ml)\b", 3), (r"\bdate\s+collected", 2)],
    "medication": [(r"\bmedication\s+list\b", 5), (r"\b\d+\s*mg\s+(tablet|capsule|injection)\b", 2), (r"\btake\s+\d+\s+(tablet|capsule)", 2)],
}
PAGE_PAIRS = {"encounter": [((r"\bvitals?\b", r"\b(ht|wt|bp|bmi|pulse)\b"), 2)], "lab": [((r"\b(abnormal|normal|high|low|critical)\b", r"\b(result|value)\b"), 2)]}
# End of fixed values.


@both("classify_page")
def classify_page(q, t):
    low = "lower(coalesce(text, ''))"
    scores = {}
    for kind, signals in PAGE_SIGNALS.items():
        parts = [f"CAST({q.like('low', p)} AS INT) * {w}" for p, w in signals]
        parts += [f"CAST({q.like('low', a)} AND {q.like('low', b)} AS INT) * {w}" for (a, b), w in PAGE_PAIRS.get(kind, [])]
        if kind == "medication":
            parts.append(f"CASE WHEN {q.size(q.extract_all('low', r'\b(filled|prescribed|requested|active|completed)\b'))} >= 3 THEN 3 ELSE 0 END")
        if kind == "encounter":
            parts.append(f"CAST({q.like('text', r'\bROS\b')} AS INT)")
        scores[kind] = " + ".join(parts)
    columns = ", ".join(f"{e} AS s_{k}" for k, e in scores.items())
    best = "greatest(" + ", ".join(f"s_{k}" for k in scores) + ")"
    choose = " ".join(f"WHEN s_{k} = best THEN '{k}'" for k in scores)
    bare = f"length({q.replace('low', r'\s', '')})"
    return f"""SELECT doc_id, page, CASE WHEN bare < 50 THEN 'blank' WHEN best < 3 THEN 'other' {choose} END AS page_type,
      CASE WHEN bare < 50 THEN CAST(1 AS DOUBLE) ELSE least(best / CAST(10 AS DOUBLE), CAST(1 AS DOUBLE)) END AS confidence
      FROM (SELECT *, {best} AS best FROM (SELECT doc_id, page, {bare} AS bare, {columns} FROM (SELECT doc_id, page, text, {low} AS low FROM {t.intake}) AS a) AS b) AS c"""


# What marks an information-rich page, with weights, and a page to skip.
PAGE_INFO = {
    "patient": (10, [r"\bpatient\b", r"\bdob\b", r"\bdate\s+of\s+birth\b", r"\bmrn\b", r"\baddress\b", r"\bphone\b", r"\bssn\b", r"\bsocial\s+security\b"]),
    "insurance": (10, [r"\binsurance\b", r"\bpolicy\s+number\b", r"\bsubscriber\b", r"\bgroup\s+number\b", r"\bmedicare\b", r"\bmedicaid\b", r"\bcarrier\b", r"\bauthorization\b", r"\bpayer\b"]),
    "clinical": (15, [r"\bdiagnos(is|es)\b", r"\bicd\s*-?\s*10?\b", r"\bcpt\b", r"\bprocedure\b", r"\bsymptoms?\b", r"\btreatment\b", r"\bmedications?\b", r"\ballergies\b", r"\bhistory\b", r"\bexam\b", r"\bassessment\b", r"\bplan\b", r"\bsleep\s+study\b", r"\bpolysomnogram\b", r"\bhsat\b", r"\bcpap\b", r"\bahi\b", r"\bapnea\b"]),
    "provider": (8, [r"\bphysician\b", r"\bprovider\b", r"\border(ing|ed)?\s+(physician|provider|doctor)\b", r"\bnpi\b", r"\bm\.?d\.?\b", r"\bd\.?o\.?\b", r"\bpractice\b", r"\bfacility\b"]),
}
PAGE_SKIP = r"^((cover\s+)?sheet$|fax\s+cover|confidential|hipaa\s+notice|this\s+fax|page\s+\d+\s+of\s+\d+$|transmission\s+report|sent\s+by)"
# End of fixed values.


def scored_pages(q, t):
    counts = ", ".join("(" + " + ".join(f"CAST({q.like('low', p)} AS INT)" for p in ps) + f") AS n_{k}" for k, (_, ps) in PAGE_INFO.items())
    kinds = "(" + " + ".join(f"CAST(n_{k} > 0 AS INT)" for k in PAGE_INFO) + ")"
    score = " + ".join(f"n_{k} * {w}" for k, (w, _) in PAGE_INFO.items())
    skip = f"(length(trim(text)) < 50 OR {q.like('low', PAGE_SKIP)})"
    return f"""(SELECT doc_id, page, skipped, CASE WHEN skipped THEN 0 ELSE {score} + CASE WHEN {kinds} >= 2 THEN {kinds} * 5 ELSE 0 END END AS score
      FROM (SELECT doc_id, page, {skip} AS skipped, {counts} FROM (SELECT doc_id, page, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {t.intake}) AS a) AS b) AS scored"""


@both("page_score")
def page_score(q, t):
    return f"SELECT doc_id, page, skipped, score FROM {scored_pages(q, t)}"


@both("page_topk")
def page_topk(q, t):
    """Of each conversation the three richest turns of 20 characters or more, in turn order."""
    return f"""SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
      SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank_of
      FROM (SELECT conv_id, turn, length(text) AS score FROM {t.conversations}) AS a WHERE score >= 20) AS b WHERE rank_of <= 3"""


@both("value_in_text")
def value_in_text(q, t):
    bare = lambda x: q.replace(q.lower(x), "[^a-z0-9]", "")
    digits = lambda x: q.replace(x, "[^0-9]", "")
    words = q.keep(q.split(q.lower("v"), r"\s+"), "w", "length(w) > 1")
    missing = q.size(q.keep(words, "w", f"NOT {q.contains(q.lower('text'), 'w')}"))
    return f"""SELECT doc_id, v AS value, CASE WHEN v IS NULL OR text IS NULL THEN 'not_found' WHEN length(v) < 2 THEN 'too_short' WHEN {q.contains('text', 'v')} THEN 'exact'
      WHEN {q.contains(q.lower('text'), q.lower('v'))} THEN 'case_insensitive' WHEN length({bare('v')}) > 2 AND {q.contains(bare('text'), bare('v'))} THEN 'normalized'
      WHEN {q.size(words)} > 1 AND {missing} = 0 THEN 'words_split' WHEN length({digits('v')}) >= 7 AND {q.contains(digits('text'), digits('v'))} THEN 'digits' ELSE 'not_found' END AS match_type
      FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN substring(text, 3, 12) WHEN 1 THEN {q.upper('substring(text, 2, 9)')} WHEN 2 THEN concat(substring(text, 4, 5), '  ', substring(text, 12, 5)) ELSE '(743) 555-3824' END AS v FROM {t.intake}) AS x"""


@both("log_redact")
def log_redact(q, t):
    return f"SELECT doc_id, {q.sha256(T.redacted(q, 'text'))} AS digest, {T.redacted(q, 'text')} <> text AS changed FROM {t.intake}"


@both("valid_filename")
def valid_filename(q, t):
    return f"""SELECT page_id, name, (length(name) BETWEEN 1 AND 255 AND NOT {q.contains('name', "'..'")} AND NOT {q.like('name', r'[/:*?"<>|]')} AND upper(name) NOT IN ('CON', 'PRN', 'AUX', 'NUL', 'COM1', 'LPT1')) AS valid
      FROM (SELECT page_id, {q.replace('url', r'^.*/', '')} AS name FROM {t.pages}) AS x"""


@both("name_title_case")
def name_title_case(q, t):
    """Capitals after the start, a blank, a quote or a hyphen: names of customers, and some that need it."""
    odd = q.values("odd", "id, raw", [(-1, "MARY-JANE o'neil"), (-2, " de la  CRUZ"), (-3, "o'brien-smith jr"), (-4, "élodie d'arc")])
    return f"SELECT id, {T.title_case(q, 'raw')} AS name FROM (SELECT c_custkey AS id, c_name AS raw FROM {t.customer} UNION ALL SELECT id, raw FROM {odd}) AS n"


@both("name_from_filename")
def name_from_filename(q, t):
    p = r"([A-Za-z'-]+), ([A-Za-z'-]+)[_ ]"
    return f"SELECT doc_id, {q.extract('text', p, 1)} AS last_name, {q.extract('text', p, 2)} AS first_name FROM {t.intake} WHERE {q.like('text', p)}"


@both("icd_normalize")
def icd_normalize(q, t):
    code = q.extract("text", r"\b[A-TV-Z]\d{2}[.-]?\d{0,4}\b")
    return f"SELECT doc_id, page, line, code, {T.icd_normalized(q, 'code')} AS icd FROM (SELECT doc_id, page, line, {code} AS code FROM {t.lines}) AS x WHERE code IS NOT NULL"


@both("key_normalise")
def key_normalise(q, t):
    return f"SELECT p_partkey, {T.key_normalized(q, 'p_name')} AS key, {T.snake_case(q, 'p_name')} AS snake FROM {t.part}"


@both("date_iso")
def date_iso(q, t):
    raw = q.extract("text", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    return f"SELECT doc_id, page, line, raw, {T.iso_date(q, 'raw')} AS iso FROM (SELECT doc_id, page, line, {raw} AS raw FROM {t.lines}) AS x WHERE raw IS NOT NULL"
