"""Decisions: flags, confidence, risk, routes, merging and knowledge-base rules.

All are read off one row a document, facts(): what its text says, with the detectors' results joined by document as a few short
columns. A decision with several outcomes explodes an array of them, so no rule reads the texts again.
"""

from __future__ import annotations

from ..catalogs import bcbs as B
from ..catalogs import contraindications as X
from ..catalogs import cpt as P
from ..catalogs import payers as Y
from ..catalogs import symptoms as S
from ..catalogs.conditions import CONDITIONS
from ..functions import matching
from ..functions import text as T
from . import q_result as R
from .both import both
from .q_detect import METRICS, addresses, best_phones, detect_provider, member_ranks, phone, provider_npi, provider_phone_fax, symptom_hits
from .q_joins import READ_NAMES, affiliate, allowables, id_payer, payer_of
from .q_reports import ranked

# Phrases that rules look for, weights and code sets.
TEXT_FLAGS = {
    "prior_phrase": r"(?i)95810|diagnostic\s+psg|prior\s+psg|baseline\s+study|hsat|home\s+sleep",
    "prior_evidence": r"(?i)prior\s+(diagnostic\s+)?psg|baseline\s+study|failed\s+hsat|inconclusive\s+hsat",
    "prior_study": r"(?i)prior\s+(sleep\s+)?study|previous\s+(sleep\s+)?study|past\s+(sleep\s+)?study|earlier\s+(sleep\s+)?study|baseline\s+study|diagnostic\s+study\s+(completed|done|performed|shows|revealed)|hsat.*completed|home\s+sleep\s+test.*completed|psg.*failure|hsat.*failure|failed\s+(psg|hsat)",
    "study_words": r"(?i)home\s+sleep\s+(?:apnea\s+)?test|\bhsat\b|prior\s+(?:sleep\s+)?study|previous\s+(?:sleep\s+)?study|baseline\s+(?:sleep\s+)?study|diagnostic\s+(?:sleep\s+)?study",
    "pap_context": r"(?i)\bcpap\b|\btitration\b|intoleran(?:t|ce)|non[- ]complian(?:t|ce)|failure\s+(?:of|to)|unable\s+to\s+tolerate",
    "mild": r"(?i)uncomplicated|mild\s+osa|initial\s+evaluation", "home_failed": r"(?i)failed\s+hsat|negative\s+hsat|hsat\s+inconclusive",
    "pcp": r"(?i)pcp\s+referral|primary\s+care\s+referral|hmo\b", "comorbid": r"(?i)copd|congestive\s+heart|heart\s+failure|neuromuscular|opioid",
    "chart": r"(?i)chart\s*notes?|progress\s*note|consult|H&P|history\s*&\s*physical|history\s+and\s+physical", "coverage_issue": r"(?i)inactive|expired|termination|coverage\s+ended",
    "falls": r"(?i)history\s+of\s+fall(?:s|ing)|\b(?:multiple|several|frequent|six|6|many)\s+falls?\b|fall(?:s|ing)\s+(?:history|risk)|(?:recurrent|repeated)\s+fall(?:s|ing)",
    "opioid": r"(?i)oxycodone|hydrocodone|morphine|fentanyl|tramadol|codeine|oxycontin|vicodin|percocet|norco|dilaudid|hydromorphone|methadone|buprenorphine",
    "assisted": r"(?i)\b(?:oxygen|o2)\s*(?:use|dependent|therapy|required)|\b(?:caretaker|caregiver|guardian|home\s+health\s+aide)",
    "child_word": r"(?i)pediatric|child|under\s*6", "cpap": r"(?i)\bcpap\b|cpap\s*(?:user|uses|on)|apap|bipap", "titration_note": r"(?i)titration",
    "mixed_apnea_p": r"(?i)sleep\s*apnea|apneas|apneic\s*episodes|witnessed\s*apnea|gasping|choking", "mixed_apnea_n": r"(?i)(denies|no\s+history\s+of|not\s+consistent\s+with).{0,40}(apnea|apneic|snor(?:e|ing))",
    "mixed_snoring_p": r"(?i)snor(?:e|ing)", "mixed_snoring_n": r"(?i)denies|no\s+snor(?:e|ing)",
    "mixed_eds_p": r"(?i)excessive\s+daytime\s+sleepiness|hypersomnia|very\s+sleepy\s+during\s+the\s+day", "mixed_eds_n": r"(?i)denies|no\s+daytime\s+sleepiness|no\s+sleepiness",
    "mixed_insomnia_p": r"(?i)insomnia|difficulty\s+(staying|falling)\s+asleep", "mixed_insomnia_n": r"(?i)(denies|no\s+)insomnia",
    "contradiction": r"(?i)(reports|positive|noted).{0,80}(?:but|however).{0,80}(denies|negative)", "group_no": r"(?i)\bgroup\s*(?:id|#|number)?\s*[:#-]?\s*[A-Z0-9]*[0-9]",
    "needs_auth": r"(?i)sleep study|cpap|polysomnography|hsat|dme|durable medical equipment|home sleep test", "urgent": r"(?i)urgent|stat|emergency|acute|severe|critical|immediate|asap",
    "reason": r"(?i)reason\s+for\s+referral|referral\s+reason|chief\s+complaint|complaint:",
}
GROUPS = ("apnea", "snoring", "eds", "insomnia")
APPROVED = ["95810", "95811", "G0399", "95806", "95782", "95783"]
SEVERE = r"^(I50\.9|I27\.20|J96|Z95|Z99\.?81|G40|G35|G20)"
RISK = {"wrong_test": 3, "ocr_low_volume": 2, "missing_chart_notes": 2, "complex_history": 2, "pediatric": 1, "dme": 1, "mobility": 1, "insurance_not_accepted": 2, "review_indication": 2, "missing_prior_study_doc": 2, "hsat_prereq": 1, "chronic_condition": 1, "severity_moderate": 1, "mixed_signals_apnea": 1, "mixed_signals_snoring": 1, "mixed_signals_eds": 1, "mixed_signals_insomnia": 1}
BCBS = r"(?i)\b(bcbs|blue\s*cross|blue\s*shield|anthem|regence|carefirst|premera|highmark|independence|horizon|wellmark|excellus)\b"
# End of fixed values.


def listed(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def facts(q, t) -> str:
    """One row a document: the patterns that its text has, and what the detectors found in it; in Spark what the statement reads of it."""
    return t.later("facts", lambda used: told(q, t, used) if used else all_facts(q, t))


def told(q, t, used: set[str]) -> str:
    """The columns of all_facts that are used, in Spark; patterns are matched before, and only detectors of used columns are joined."""
    e = R.equipment(q)
    flags = TEXT_FLAGS | {"symptomatic": SYMPTOMATIC, "metrics": "|".join(f"(?:{p})" for p, _ in METRICS.values()), "dme": f"(?:{e['vendor']})|(?:{e['code']})"}
    flags = {k: p for k, p in flags.items() if k in used} | ({"dials": DIALED} if "dialed" in used else {})
    texts = bool(used & {"text", "n_chars", "dialed"})
    own = [f"x.{k}" for k in flags if k != "dials"]
    own += ["x.text"] * ("text" in used) + ["length(trim(x.text)) AS n_chars"] * ("n_chars" in used)
    own += [f"CASE WHEN x.dials THEN {q.replace(q.extract('x.text', DIALED, 1), '[^0-9]', '')} END AS dialed"] * ("dialed" in used)
    joined = ""
    for sql, a, key, columns in parts(q, t):
        if wanted := {k: c for k, c in columns.items() if k in used}:
            own += [f"{c} AS {k}" for k, c in wanted.items()]
            joined += f" LEFT JOIN {sql()} AS {a} ON {key} = x.doc_id"
    return f"(SELECT {', '.join(['x.doc_id', *own])} FROM {t.flagged(flags, {}, None, ('doc_id', 'text') if texts else ('doc_id',)).removesuffix(' AS intake')} AS x{joined})"


def parts(q, t) -> list:
    """The detectors' results by document: how each is stated, its name, its key, and the facts it gives."""
    year = "CAST(substring(b.dob, 7, 4) AS INT)"
    or_not = lambda a, *ks: {k: f"coalesce({a}.{k}, false)" for k in ks}
    return [
        (lambda: R.names(q, t).removesuffix(" AS names"), "n", "n.doc_id", {"first_name": "n.first_name", "last_name": "n.last_name"}),
        (lambda: R.births(q, t).removesuffix(" AS births"), "b", "b.doc_id", {"dob": "b.dob", "age": f"{R.AS_OF.year} - {year}"}),
        (lambda: R.cpt(q, t).removesuffix(" AS procedures"), "c", "c.doc_id", {"cpt": "c.cpt", "candidates": "c.candidates", "ambiguity": "c.ambiguity", "n_ambiguity": "coalesce(c.n_ambiguity, 0)", **or_not("c", "titration")}),
        (lambda: f"({diagnoses(q, t)})", "i", "icd_doc", {"n_dx": "coalesce(i.n_dx, 0)", **or_not("i", "sleep_dx", "severe_dx", "cardio_dx", "heart_dx", "immobile_dx"), "primary_dx": "i.primary_dx"}),
        (lambda: R.main_carriers(q, t).removesuffix(" AS carriers"), "k", "k.doc_id", {"carrier": "k.carrier", "status": "k.status"}),
        (lambda: f"({first_member(q, t)})", "m", "member_doc", {"member_id": "m.member_id"}),
        (lambda: f"({child_lines(q, t)})", "h", "child_doc", or_not("h", "child_line")),
    ]


def child_lines(q, t) -> str:
    around = "lower(concat_ws(' ', lag(text) OVER (PARTITION BY doc_id ORDER BY line), text, lead(text) OVER (PARTITION BY doc_id ORDER BY line)))"
    return f"SELECT doc_id AS child_doc, true AS child_line FROM (SELECT doc_id, text, {around} AS near FROM {t.picked('child', matching.having('(?i)(pediatric|child|minor)'), -1, 1)}) AS w WHERE {q.like('text', r'(?i)(pediatric|child|minor)')} AND NOT {T.is_header(q, 'text')} AND NOT {q.like('text', '(?i)adult')} AND {q.like('near', '(patient|study|procedure|cpt|referral|order)')} GROUP BY 1"


def diagnoses(q, t) -> str:
    any_icd = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END) = 1"
    return f"""SELECT doc_id AS icd_doc, count(*) AS n_dx, {any_icd(f'icd IN ({listed(R.SLEEP_DX)})')} AS sleep_dx, {any_icd(q.like('icd', SEVERE))} AS severe_dx, {any_icd(q.like('icd', r'^I[0-9]'))} AS cardio_dx,
      {any_icd(q.like('icd', r'^I[1-5][0-9]'))} AS heart_dx, {any_icd("icd IN ('Z74.01', 'Z74.09')")} AS immobile_dx, {q.first_by('icd', 'place')} AS primary_dx FROM {R.ranked_icds(q, t)} GROUP BY 1"""


def first_member(q, t) -> str:
    return f"SELECT doc_id AS member_doc, value AS member_id FROM {member_ranks(q, t)} WHERE place = 1"


SYMPTOMATIC = "(?i)(" + "|".join(p for _, ps, _ in S.SYMPTOMS for p in ps) + ")"
DIALED = r"(?i)(?:phone|tel|contact)[:\s]*([()\-.\s]*\d[\d()\-.\s]{8,}\d)"


def all_facts(q, t) -> str:
    e = R.equipment(q)
    columns = ", ".join(f"{q.like('text', p)} AS {k}" for k, p in TEXT_FLAGS.items())
    symptomatic = q.like("text", SYMPTOMATIC)
    metrics = " OR ".join(q.like("text", p) for p, _ in METRICS.values())
    dialed = q.replace(q.extract("text", DIALED, 1), "[^0-9]", "")
    low = f"SELECT doc_id, text, length(trim(text)) AS n_chars, {columns}, {symptomatic} AS symptomatic, {metrics} AS metrics, {q.like('text', e['vendor'])} OR {q.like('text', e['code'])} AS dme, {dialed} AS dialed FROM (SELECT doc_id, coalesce(text, '') AS text FROM {t.intake}) AS a"
    joins = [
        (R.names(q, t).removesuffix(" AS names"), "n", "n.doc_id"), (R.births(q, t).removesuffix(" AS births"), "b", "b.doc_id"), (R.cpt(q, t).removesuffix(" AS procedures"), "c", "c.doc_id"), (f"({diagnoses(q, t)})", "i", "icd_doc"),
        (R.main_carriers(q, t).removesuffix(" AS carriers"), "k", "k.doc_id"), (f"({first_member(q, t)})", "m", "member_doc"), (f"({child_lines(q, t)})", "h", "child_doc"),
    ]
    joined = " ".join(f"LEFT JOIN {sql} AS {a} ON {key} = x.doc_id" for sql, a, key in joins)
    year = f"CAST(substring(b.dob, 7, 4) AS INT)"
    picked = f"""SELECT x.*, n.first_name, n.last_name, b.dob, {R.AS_OF.year} - {year} AS age, c.cpt, c.candidates, c.ambiguity, coalesce(c.n_ambiguity, 0) AS n_ambiguity, coalesce(c.titration, false) AS titration,
      coalesce(i.n_dx, 0) AS n_dx, coalesce(i.sleep_dx, false) AS sleep_dx, coalesce(i.severe_dx, false) AS severe_dx, coalesce(i.cardio_dx, false) AS cardio_dx, coalesce(i.heart_dx, false) AS heart_dx, coalesce(i.immobile_dx, false) AS immobile_dx, i.primary_dx,
      k.carrier, k.status, m.member_id, coalesce(h.child_line, false) AS child_line FROM ({low}) AS x {joined}"""
    return f"(SELECT * FROM ({picked}) AS f0)"


def child_code() -> str:
    return "coalesce(cpt IN ('95782', '95783'), false)"


#: Actions that the policy rules infer, in their order.
POLICY = {
    "document_prior_study_evidence": "cpt = '95811' AND (NOT prior_phrase OR NOT prior_study)",
    "prior_study_evidence_present": "prior_evidence",
    "evaluate_hsat_prerequisite": "cpt = '95810' AND mild AND NOT home_failed",
    "obtain_pcp_referral": "pcp",
    "pediatric_protocol_review": "cpt IN ('95782', '95783')",
    "consider_inlab_over_hsat": "cpt IN ('95806', 'G0399') AND comorbid",
    "review_indication": "(cpt = '95811' AND NOT prior_study) OR (cpt IN ('95810', '95811', '95806', 'G0399') AND NOT sleep_dx)",
}
PED = f"(coalesce(age < 18, false) OR {child_code()} OR child_line)"
WRONG = "(coalesce(cpt IN ('95810', '95811', '95806', 'G0399'), false) AND NOT sleep_dx AND NOT (titration_note AND cardio_dx))"
REVIEW = "(coalesce(cpt = '95811', false) AND study_words AND NOT pap_context)"
#: Reasons for a look by hand, in their order.
REASONS = {
    "cpt_ambiguity": "n_ambiguity > 0",
    "titration_requires_clinical_review": REVIEW,
    "do_not_accept_or_pending_contract": "coalesce(status <> 'accepted', false)",
    "policy_action_inference": " OR ".join(f"coalesce({c}, false)" for c in POLICY.values()),
    "missing_patient_info": "first_name IS NULL OR last_name IS NULL OR dob IS NULL",
    "phone_format_invalid": "coalesce(length(dialed) <> 10, false)",
    "cpt_missing_or_unapproved": f"coalesce(cpt NOT IN ({listed(APPROVED)}), true)",
    "wrong_test_ordered_possible": WRONG,
    "high_acuity_safety_review_required": "falls AND opioid AND assisted",
    "missing_chart_notes": "NOT chart",
    "insurance_issue_possible": "coverage_issue",
    "special_considerations_pediatric": PED,
    "age_cpt_pediatric_mismatch": f"coalesce(age >= 18, false) AND {child_code()}",
    "special_considerations_dme": "dme",
    "special_considerations_mobility": "immobile_dx",
    **{f"mixed_signals_{g}": f"mixed_{g}_p AND mixed_{g}_n" for g in GROUPS},
    "contradictory_information": "contradiction",
    "complex_medical_history": "severe_dx AND n_dx >= 2",
    "ocr_low_text_volume": "n_chars < 80",
}
SCORE = "CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN dob IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN cpt IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN n_dx > 0 THEN 1 ELSE 0 END + CASE WHEN carrier IS NOT NULL THEN CAST(0.75 AS DOUBLE) ELSE 0 END + CASE WHEN carrier IS NOT NULL AND (member_id IS NOT NULL OR group_no) THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN metrics THEN CAST(0.5 AS DOUBLE) ELSE 0 END"


def decided(q, t) -> str:
    """facts with reasons (joined), the number of triggers of a manual review, the anchors' score, and the confidence."""
    triggers = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for k, c in REASONS.items() if k.startswith("mixed_signals_") or k == "ocr_low_text_volume")
    reasons = q.some(*[f"CASE WHEN {c} THEN '{k}' END" for k, c in REASONS.items()])
    scored = f"SELECT *, {SCORE} AS score, {triggers} AS triggers, {reasons} AS reasons FROM {facts(q, t)}"
    base = "CASE WHEN score >= 4 THEN 'High' WHEN score >= 2.5 THEN 'Medium' ELSE 'Low' END"
    tier = f"CASE WHEN triggers >= 2 OR contradiction THEN 'Manual Review' WHEN score >= 4 AND {q.size('reasons')} > 0 THEN 'Medium' ELSE {base} END"
    return f"(SELECT *, {tier} AS confidence FROM ({scored}) AS d0) AS decided"


@both("flag_policy_actions")
def flag_policy_actions(q, t):
    """Inferred actions, one row each, and the reason that any of them adds."""
    actions = q.some(*[f"CASE WHEN {c} THEN '{k}' END" for k, c in POLICY.items()])
    return f"SELECT doc_id, cpt, {q.explode('actions')} AS action, 'policy_action_inference' AS reason FROM (SELECT doc_id, cpt, {actions} AS actions FROM {facts(q, t)}) AS a"


@both("flag_prior_study")
def flag_prior_study(q, t):
    """Titrations without the text of a prior study; diagnoses aren't known yet when this rule runs, so they don't count."""
    return f"SELECT doc_id, NOT prior_study AS missing_prior_study FROM {facts(q, t)} WHERE cpt = '95811'"


@both("flag_titration_review")
def flag_titration_review(q, t):
    return f"SELECT doc_id, {REVIEW} AS needs_review FROM {facts(q, t)} WHERE cpt = '95811'"


@both("flag_qc")
def flag_qc(q, t):
    pair = lambda a, b: f"concat('{q.fold}', {a}, '[^', chr(10), ']{{0,80}}', {b})"
    both_ways = f"{q.like_column('text', pair('last_name', 'first_name'))} OR {q.like_column('text', pair('first_name', 'last_name'))}"
    return f"""SELECT doc_id, {REASONS['missing_patient_info']} AS missing_patient, CASE WHEN dob IS NULL THEN 'unknown' WHEN {q.like('dob', r'^[0-9]{2}/[0-9]{2}/[0-9]{4}$')} THEN 'pass' ELSE 'fail' END AS date_validity,
      CASE WHEN dialed IS NULL THEN 'unknown' WHEN length(dialed) = 10 THEN 'pass' ELSE 'fail' END AS phone_validity, CASE WHEN cpt IS NULL THEN 'unknown' WHEN cpt IN ({listed(APPROVED)}) THEN 'pass' ELSE 'fail' END AS cpt_valid,
      CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL AND ({both_ways}) THEN 'pass' ELSE 'unknown' END AS name_consistency FROM {facts(q, t)}"""


@both("flag_wrong_test")
def flag_wrong_test(q, t):
    """Sleep studies without a sleep diagnosis, unless a titration note and a heart diagnosis support them."""
    return f"SELECT doc_id, cpt, titration_note AND cardio_dx AS pruned FROM {facts(q, t)} WHERE cpt IN ('95810', '95811', '95806', 'G0399') AND NOT sleep_dx"


@both("flag_high_acuity")
def flag_high_acuity(q, t):
    return f"SELECT doc_id, falls, opioid, assisted, falls AND opioid AND assisted AS high_acuity FROM {facts(q, t)}"


@both("flag_special")
def flag_special(q, t):
    return f"SELECT doc_id, CASE WHEN coalesce(age < 18, false) THEN 'age' WHEN {child_code()} THEN 'cpt' WHEN child_line THEN 'context' END AS pediatric, {REASONS['age_cpt_pediatric_mismatch']} AS mismatch, dme, immobile_dx AS mobility FROM {facts(q, t)}"


@both("flag_chart_insurance")
def flag_chart_insurance(q, t):
    return f"SELECT doc_id, NOT chart AS missing_chart_notes, coverage_issue AS insurance_issue FROM {facts(q, t)}"


@both("flag_mixed")
def flag_mixed(q, t):
    groups = ", ".join(f"{REASONS['mixed_signals_' + g]} AS {g}" for g in GROUPS)
    return f"SELECT doc_id, {groups}, contradiction AS contradictory, severe_dx AND n_dx >= 2 AS complex_history, n_chars < 80 AS low_volume FROM {facts(q, t)}"


@both("confidence_tier")
def confidence_tier(q, t):
    return f"SELECT doc_id, score, triggers, {q.join('reasons', ',')} AS reasons, confidence AS tier FROM {decided(q, t)}"


@both("confidence_level_bug")
def confidence_level_bug(q, t):
    """Thresholds of a share put on a score of up to 5.75, as they stand."""
    return f"SELECT doc_id, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.55 THEN 'Medium' WHEN score >= 0.35 THEN 'Low' ELSE 'Manual Review Required' END AS level FROM (SELECT doc_id, {SCORE} AS score FROM {facts(q, t)}) AS a"


def risk_factors() -> dict[str, str]:
    return {
        "wrong_test": WRONG, "ocr_low_volume": "n_chars < 80", "missing_chart_notes": "NOT chart", "complex_history": "severe_dx AND n_dx >= 2", "pediatric": PED, "dme": "dme", "mobility": "immobile_dx",
        "insurance_not_accepted": "status = 'not_accepted'", "review_indication": POLICY["review_indication"], "missing_prior_study_doc": POLICY["document_prior_study_evidence"], "hsat_prereq": POLICY["evaluate_hsat_prerequisite"],
        "chronic_condition": "primary_dx IN ('G47.33', 'I10', 'E11.9', 'J45.909')", "severity_moderate": "primary_dx = 'G47.33'", **{f"mixed_signals_{g}": REASONS[f"mixed_signals_{g}"] for g in GROUPS},
    }


@both("risk_score")
def risk_score(q, t):
    factors = risk_factors()
    score = " + ".join(f"CASE WHEN {c} THEN {RISK[k]} ELSE 0 END" for k, c in factors.items())
    names = q.join(q.some(*[f"CASE WHEN {factors[k]} THEN '{k}' END" for k in sorted(factors)]), ",")
    return f"SELECT doc_id, score, factors, CASE WHEN score >= 8 OR (score >= 4 AND confidence = 'Manual Review') THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT doc_id, confidence, {score} AS score, {names} AS factors FROM {decided(q, t).replace('SELECT *, ' + SCORE + ' AS score,', 'SELECT *, ' + SCORE + ' AS anchors,').replace('score >=', 'anchors >=')}) AS a"


#: Notes for an authorization, in their order: tag, category, when.
AUTH = [
    ("wrong_test_ordered", "policy", WRONG), ("missing_chart_notes", "documentation", "NOT chart"), ("insurance_issue", "carrier", "coverage_issue"), ("plan_not_accepted", "carrier", "status = 'not_accepted'"),
    ("contract_sunset", "carrier", "carrier = 'Prominence' AND status <> 'not_accepted'"), ("carrier_medicare", "carrier_policy", "lower(carrier) LIKE '%medicare%'"), ("carrier_aetna", "carrier_policy", "lower(carrier) LIKE '%aetna%'"),
    ("carrier_anthem_bcbs", "carrier_policy", "lower(carrier) LIKE '%anthem%' OR lower(carrier) LIKE '%blue%'"), ("carrier_uhc", "carrier_policy", "lower(carrier) LIKE '%uhc%' OR lower(carrier) LIKE '%united%'"),
    ("carrier_cigna", "carrier_policy", "lower(carrier) LIKE '%cigna%'"), ("carrier_tricare", "carrier_policy", "lower(carrier) LIKE '%tricare%'"), ("cpt_95811_without_prior_hsat", "policy", "cpt = '95811'"),
    ("positive_cardio_support", "clinical_support", "cpt = '95811' AND heart_dx AND titration_note"),
]


@both("auth_notes")
def auth_notes(q, t):
    """Notes of each document in their order, with their category."""
    notes = q.some(*[f"CASE WHEN {c} THEN '{i:02d}:{tag}:{category}' END" for i, (tag, category, c) in enumerate(AUTH, 1)])
    return f"SELECT doc_id, CAST(substring(note, 1, 2) AS INT) AS ord, {q.extract('note', '^[0-9]+:([^:]*):', 1)} AS tag, {q.extract('note', ':([^:]*)$', 1)} AS category FROM (SELECT doc_id, {q.explode(notes)} AS note FROM {facts(q, t)}) AS a"


@both("age_guard")
def age_guard(q, t):
    """Children's codes of patients over 18 whose text names no child give way to 95810, 95811, or the next candidate."""
    others = q.get(q.keep(q.split("candidates", ","), "v", "v NOT IN ('95782', '95783')"), 1)
    other = f"CASE WHEN {q.contains('candidates', q.text('95810'))} THEN '95810' WHEN {q.contains('candidates', q.text('95811'))} THEN '95811' ELSE {others} END"
    return f"SELECT doc_id, age, cpt AS was, CASE WHEN age > 18 AND NOT child_word THEN coalesce({other}, cpt) ELSE cpt END AS cpt FROM {facts(q, t)} WHERE {child_code()}"


@both("learned_corrections")
def learned_corrections(q, t):
    """A correction applies from a confidence of 0.5 or a count of 3."""
    best = f"SELECT l_suppkey, l_returnflag, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS confidence, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) AS place FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM {t.lineitem} GROUP BY 1, 2) AS a"
    return f"SELECT s_suppkey, l_returnflag AS corrected, confidence FROM {t.supplier} LEFT JOIN (SELECT * FROM ({best}) AS b WHERE place = 1 AND (confidence >= 0.5 OR n >= 3)) AS c ON l_suppkey = s_suppkey"


def ages(q, t) -> str:
    """Full years on AS_OF of each document's patient."""
    part = lambda i, n: f"CAST(substring(dob, {i}, {n}) AS INT)"
    return f"(SELECT doc_id, {R.AS_OF.year} - {part(7, 4)} - CASE WHEN {part(1, 2)} * 100 + {part(4, 2)} > {R.AS_OF.month * 100 + R.AS_OF.day} THEN 1 ELSE 0 END AS age FROM {R.births(q, t)}) AS ages"


TIER = "CASE WHEN age IS NULL THEN 'unknown' WHEN age < 2 THEN 'cannot_test' WHEN age <= 5 THEN 'pediatric' WHEN age <= 17 THEN 'pediatric_adult_codes' ELSE 'adult' END"


@both("kb_age")
def kb_age(q, t):
    codes = "CASE WHEN age IS NULL OR age < 2 THEN '' WHEN age <= 5 THEN '95782,95783' WHEN age <= 17 THEN '95810,95811' ELSE '95810,95811,95806,G0399' END"
    flag = "CASE WHEN age < 2 THEN 'STOP_AGE' WHEN age <= 5 THEN 'FLAG_PEDIATRIC' WHEN age <= 17 THEN 'ALERT_PEDIATRIC_ADULT' END"
    return f"SELECT i.doc_id, age, {TIER} AS tier, {codes} AS codes, coalesce(age > 17, true) AS hst_allowed, {flag} AS flag FROM {t.intake.replace(' AS intake', ' AS i')} LEFT JOIN {ages(q, t)} ON ages.doc_id = i.doc_id"


def routed(q, t) -> str:
    """Plans with an alpha prefix: administrator, no prefix, supplement, letter in the id, affiliate by name, or the general way."""
    bare = q.replace("upper(coalesce(member_id, ''))", r"[\s-]", "")
    fmt = f"CASE WHEN {q.like('bare', r'^R[0-9]{8,}$')} THEN 'FORMAT_FEP' WHEN NOT {q.like('bare', '^[A-Z][A-Z0-9]{2}')} OR body = '' THEN 'FORMAT_UNKNOWN' WHEN {q.like('body', '[A-Z]')} THEN 'FORMAT_B' WHEN {q.like('body', r'^[0-9]{10,}$')} THEN 'FORMAT_C' WHEN {q.like('body', r'^[0-9]{6,}$')} THEN 'FORMAT_A' ELSE 'FORMAT_UNKNOWN' END"
    tpa = "CASE " + " ".join("WHEN " + " OR ".join(q.contains("lower(carrier)", q.text(w.lower())) for w in words) + f" THEN '{k}'" for k, words in B.TPA) + " END"
    member = f"SELECT doc_id AS mdoc, value AS member_id FROM {member_ranks(q, t)} WHERE place = 1"
    rows = f"SELECT k.doc_id, k.carrier, member_id, {bare} AS bare FROM {R.main_carriers(q, t).removesuffix(' AS carriers')} AS k LEFT JOIN ({member}) AS m ON mdoc = k.doc_id WHERE {q.like('k.carrier', BCBS)}"
    cut = f"SELECT *, {q.extract('bare', '^[A-Z][A-Z0-9]{2}')} AS prefix, {q.replace('bare', '^[A-Z][A-Z0-9]{2}', '')} AS body FROM ({rows}) AS r"
    known = f"SELECT *, {fmt} AS id_format, {tpa} AS tpa, {affiliate(q, 'carrier')} AS affiliate, {q.like('carrier', r'(?i)supplement|medigap|plan [a-n]' + chr(92) + 'b')} AS extra FROM ({cut}) AS s"
    tier = f"CASE WHEN tpa IS NOT NULL THEN 'TPA' WHEN prefix IS NULL THEN 'TIER_3' WHEN extra OR {q.like('body', '[A-Z]')} THEN 'UNIVERSAL_RULE' WHEN affiliate IS NOT NULL THEN 'TIER_2' ELSE 'TIER_3' END"
    rule = f"CASE WHEN tpa IS NOT NULL OR prefix IS NULL THEN NULL WHEN extra THEN 'medicare_supplement' WHEN {q.like('body', '[A-Z]')} THEN 'letter_in_id_carelon' END"
    return f"(SELECT doc_id, carrier, prefix, id_format, tpa, affiliate, {tier} AS tier, {rule} AS rule FROM ({known}) AS u) AS routed"


@both("kb_bcbs")
def kb_bcbs(q, t):
    confidence = "CASE tier WHEN 'TPA' THEN 'VERIFIED' WHEN 'UNIVERSAL_RULE' THEN 'LIKELY' WHEN 'TIER_2' THEN 'PRESUMED_AFFILIATE' ELSE 'PRESUMED_GENERAL' END"
    flag = "CASE WHEN tier = 'TPA' THEN 'FLAG_BCBS_TPA_DETECTED' WHEN prefix IS NULL THEN 'FLAG_BCBS_NO_PREFIX' WHEN rule = 'medicare_supplement' THEN 'INFO_BCBS_MEDICARE_SUPPLEMENT' WHEN rule = 'letter_in_id_carelon' THEN 'FLAG_BCBS_LETTER_IN_ID' ELSE 'FLAG_BCBS_UNKNOWN_PREFIX' END"
    return f"SELECT doc_id, carrier, prefix, id_format, tpa, CASE WHEN tier = 'TIER_2' THEN affiliate END AS affiliate, tier, rule, {confidence} AS confidence, {flag} AS flag FROM {routed(q, t)}"


def triggered(q, x: str, codes, words) -> str:
    """Whether lower-case text has a rule's codes or words; words with capitals are matched as they stand, so never."""
    return "(" + (" OR ".join([q.contains(x, q.text(c.lower())) for c in codes] + [q.contains(x, q.text(w)) for w in words]) or "false") + ")"


def contraindicated(q, t) -> str:
    hits = {name: triggered(q, "low", codes, words) for kind, name, _, codes, words in X.RULES if kind in ("hard", "hst", "soft")}
    marks = tuple(dict.fromkeys(matching.spelled(w) for _, _, _, codes, words in X.RULES for w in [*codes, *words]))
    soft = [n for kind, n, _, codes, words in X.RULES if kind == "soft" and (codes or words)]
    flags = [f"CASE WHEN c_{n} THEN '{f}:{n}' END" for kind, n, f, codes, words in X.RULES if codes or words]
    columns = ", ".join(f"{c} AS c_{n}" for n, c in hits.items())
    count = " + ".join(f"CASE WHEN c_{n} THEN 1 ELSE 0 END" for n in soft)
    return f"(SELECT doc_id, c_homebound_with_o2 AS stopped, c_home_oxygen AS hst_blocked, {count} AS soft, {q.join(q.some(*flags), ',')} AS flags FROM (SELECT doc_id, {columns} FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM {t.blanked(*marks)}) AS a) AS b) AS contraindicated"


@both("kb_contraindications")
def kb_contraindications(q, t):
    return f"SELECT doc_id, stopped, hst_blocked, soft, soft >= 2 AS multi, flags FROM {contraindicated(q, t)}"


def selected(q, t) -> str:
    """The test to recommend, as the rules run (no tier of age ever matches) and as they are meant."""
    ordered = f"SELECT c.doc_id, p.cpt, stopped, hst_blocked, soft, age FROM {contraindicated(q, t).removesuffix(' AS contraindicated')} AS c LEFT JOIN {R.cpt(q, t).removesuffix(' AS procedures')} AS p ON p.doc_id = c.doc_id LEFT JOIN {ages(q, t)} ON ages.doc_id = c.doc_id"
    ran = "CASE WHEN cpt IN ('95811', '95783') THEN '95811' WHEN cpt IN ('95806', 'G0399') AND NOT hst_blocked THEN 'G0399' ELSE '95810' END"
    meant = f"CASE WHEN age < 2 THEN NULL WHEN age <= 5 THEN CASE WHEN cpt IN ('95783', '95811') THEN '95783' ELSE '95782' END WHEN age <= 17 AND cpt IN ('95806', 'G0399') THEN '95810' ELSE {ran} END"
    return f"(SELECT doc_id, cpt, age, stopped, hst_blocked, soft, {ran} AS selected, {meant} AS intended FROM ({ordered}) AS o) AS selected_tests"


@both("kb_test_select")
def kb_test_select(q, t):
    return f"SELECT doc_id, cpt AS ordered, selected, intended, cpt IS NOT NULL AND cpt <> selected AND NOT hst_blocked AS mismatch FROM {selected(q, t)}"


@both("kb_icd")
def kb_icd(q, t):
    """Conditions named in a text as codes, the longest name of a code, unless its sentence denies them or tells of relatives or the past."""
    names = dict(CONDITIONS)
    negated = r"(denies|no |without|father|mother|family|history of)[^.\n]{0,80}"
    entry = lambda n, c: f"{len(n):03d}|{c}|{n}"
    hits, denied = (q.hits("low", [(entry(n, c), before + n) for n, c in names.items()]) for before in ("", negated))
    less = "array_except(found, coalesce(denied, array()))" if q.name == "spark" else "list_filter(found, lambda v: NOT list_contains(coalesce(denied, []), v))"
    found = f"SELECT doc_id, {q.explode(less)} AS hit FROM (SELECT doc_id, {hits} AS found, {denied} AS denied FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM {t.intake}) AS a) AS h"
    parted = f"SELECT doc_id, {q.extract('hit', '^[0-9]+[|]([^|]*)[|]', 1)} AS code, {q.extract('hit', '[|]([^|]*)$', 1)} AS keyword FROM ({found}) AS b"
    return f"SELECT doc_id, code, keyword FROM (SELECT doc_id, code, keyword, row_number() OVER (PARTITION BY doc_id, code ORDER BY length(keyword) DESC, keyword) AS place FROM ({parted}) AS c) AS d WHERE place = 1"


def payers(q, t) -> str:
    """Each document's payer by its carrier's name, else by its member id."""
    table = payer_of(q, q.values("listed", "carrier", [(n,) for n in dict.fromkeys([r[0] for r in R.CARRIER_ROWS] + READ_NAMES)]))
    member = f"SELECT doc_id AS mdoc, value AS member_id FROM {member_ranks(q, t)} WHERE place = 1"
    return f"(SELECT k.doc_id, k.carrier, coalesce(payer, {id_payer(q, 'member_id')}) AS payer, CASE WHEN payer IS NOT NULL THEN CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'substring' ELSE 'fuzzy' END WHEN {id_payer(q, 'member_id')} IS NOT NULL THEN 'member_id' END AS found_by FROM {R.main_carriers(q, t).removesuffix(' AS carriers')} AS k LEFT JOIN {table} ON payer_of.carrier = k.carrier LEFT JOIN ({member}) AS m ON mdoc = k.doc_id) AS payers"


@both("kb_payer")
def kb_payer(q, t):
    return f"SELECT doc_id, carrier, coalesce(payer, 'unknown') AS payer, found_by FROM {payers(q, t)}"


@both("kb_cost")
def kb_cost(q, t):
    """The allowable rate of each document's payer for the recommended code."""
    names = sorted({p for _, p in Y.ROUTES} | {p for _, _, p, _ in Y.ID_ROUTES})
    table = allowables(q, q.values("wanted", "payer, cpt", [(p, c) for p in names for c in [c for c, _, _ in P.CPT]])).removesuffix(" AS allowables")
    return f"SELECT p.doc_id, p.payer, s.selected AS cpt, a.entry, a.rate FROM {payers(q, t).removesuffix(' AS payers')} AS p JOIN {selected(q, t).removesuffix(' AS selected_tests')} AS s ON s.doc_id = p.doc_id LEFT JOIN {table} AS a ON a.payer = p.payer AND a.cpt = s.selected WHERE s.cpt IS NOT NULL"


@both("kb_status")
def kb_status(q, t):
    """The gravest flag of a document: age, contraindications, a titration without need shown, plans with an alpha prefix."""
    severity = "least(CASE WHEN age < 2 OR stopped THEN 1 END, CASE WHEN cpt IN ('95811', '95783') THEN 2 END, CASE WHEN age BETWEEN 2 AND 5 OR hst_blocked OR soft >= 2 THEN 3 END, CASE WHEN age BETWEEN 6 AND 17 OR soft >= 1 THEN 4 END, CASE r.tier WHEN 'TPA' THEN 2 WHEN 'UNIVERSAL_RULE' THEN 4 WHEN 'TIER_2' THEN 3 WHEN 'TIER_3' THEN 3 END)"
    return f"SELECT doc_id, severity, CASE severity WHEN 1 THEN 'STOP' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'FLAG' WHEN 4 THEN 'ALERT' ELSE 'CLEAR' END AS status FROM (SELECT s.doc_id, {severity} AS severity FROM {selected(q, t).removesuffix(' AS selected_tests')} AS s LEFT JOIN {routed(q, t).removesuffix(' AS routed')} AS r ON r.doc_id = s.doc_id) AS a"


def fields(q, t) -> str:
    """Leaf fields of a document as the detectors give them (a) and as plain patterns over the text do (b)."""
    dob = r"(?i)(?:dob|date of birth)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
    b = {
        "patient.firstName": q.extract("text", r"(?:Patient|Name):?\s+([A-Z][a-z'-]+)\s+[A-Z][a-z'-]+", 1), "patient.lastName": q.extract("text", r"(?:Patient|Name):?\s+[A-Z][a-z'-]+\s+([A-Z][a-z'-]+)", 1), "patient.dob": q.extract("text", dob, 1),
        "patient.phone": q.extract("text", r"\(\d{3}\) \d{3}-\d{4}"), "procedure.cpt": q.extract("text", r"\b(9580[56]|9581[01]|9578[23]|G0399)\b", 1), "insurance.carrier": q.extract("text", r"Insurance:\s*([A-Z][a-z]+)", 1),
        "insurance.memberId": q.extract("text", r"Member ID:\s*([A-Z0-9]+)", 1), "provider.npi": q.extract("text", r"(?i)\bnpi\b\D{0,5}(\d{10})", 1),
    }
    number = "CASE WHEN digits IS NOT NULL THEN concat('(', substring(digits, 1, 3), ') ', substring(digits, 4, 3), '-', substring(digits, 7, 4)) END"
    a = {"patient.firstName": "first_name", "patient.lastName": "last_name", "patient.dob": "dob", "patient.phone": number, "procedure.cpt": "cpt", "insurance.carrier": "carrier", "insurance.memberId": "member_id", "provider.npi": "npi"}
    rows = f"SELECT facts.*, digits, npi FROM {facts(q, t)} LEFT JOIN {phone(q, t)} ON phone.doc_id = facts.doc_id LEFT JOIN (SELECT doc_id AS ndoc, npi FROM ({provider_npi(q, t)}) AS v0) AS v ON ndoc = facts.doc_id"
    pairs = q.array(*[f"CASE WHEN {a[k]} IS NOT NULL OR {b[k]} IS NOT NULL THEN concat('{k}|', coalesce({a[k]}, ''), '|', coalesce({b[k]}, '')) END" for k in a])
    each = f"SELECT doc_id, {q.explode(q.keep('pairs', 'v', 'v IS NOT NULL'))} AS pair FROM (SELECT doc_id, {pairs} AS pairs FROM ({rows}) AS r) AS p"
    part = lambda p: q.extract("pair", p, 1)
    return f"(SELECT doc_id, {part('^([^|]*)[|]')} AS path, nullif({part('^[^|]*[|]([^|]*)[|]')}, '') AS a, nullif({part('[|]([^|]*)$')}, '') AS b FROM ({each}) AS e) AS fields"


def compared(q, t) -> str:
    """Fields by what both sides say: exact, one side only, similar from 85 %, decided by the field's own rule, or a conflict."""
    pct = f"CAST(floor(100 * ({T.similarity(q, 'a', 'b')}) + 0.5) AS INT)"
    digits = lambda x: f"length({q.replace(x, '[^0-9]', '')})"
    clean = lambda x: f"length({q.replace(x, '[^A-Za-z0-9]', '')})"
    sep = lambda x: q.like(x, "[-/]")
    kind = f"CASE WHEN a IS NULL AND b IS NULL THEN 'both_empty' WHEN a = b THEN 'exact' WHEN a IS NULL THEN 'llm_only' WHEN b IS NULL THEN 'ocr_only' WHEN {pct} >= 85 THEN 'fuzzy' WHEN path IN ('patient.dob', 'patient.phone', 'insurance.memberId') THEN 'field_rule' ELSE 'conflict' END"
    resolved = f"""CASE kind WHEN 'ocr_only' THEN a WHEN 'field_rule' THEN CASE WHEN path = 'patient.dob' AND {sep('a')} AND NOT {sep('b')} THEN a WHEN path = 'patient.phone' AND {digits('a')} = 10 AND {digits('b')} <> 10 THEN a WHEN path = 'insurance.memberId' AND {clean('a')} > {clean('b')} THEN a ELSE b END ELSE b END"""
    rule = f"""CASE path WHEN 'patient.dob' THEN CASE WHEN {sep('a')} <> {sep('b')} THEN 80 ELSE 60 END WHEN 'patient.phone' THEN CASE WHEN ({digits('a')} = 10) <> ({digits('b')} = 10) THEN 85 ELSE 65 END ELSE CASE WHEN {clean('a')} > {clean('b')} THEN 75 ELSE 70 END END"""
    return t.stored("compared", f"(SELECT doc_id, path, a, b, kind, pct, {resolved} AS resolved, CASE kind WHEN 'exact' THEN 100 WHEN 'fuzzy' THEN pct WHEN 'field_rule' THEN {rule} WHEN 'conflict' THEN 50 WHEN 'both_empty' THEN 0 ELSE 75 END AS confidence FROM (SELECT doc_id, path, a, b, {pct} AS pct, {kind} AS kind FROM {fields(q, t)}) AS x)")


def agreed(q, t) -> str:
    half = "CAST(floor(CAST(count(CASE WHEN kind = 'exact' THEN 1 END) AS DOUBLE) / count(*) * 100 + 0.5) AS INT)"
    return f"(SELECT doc_id, count(*) AS n_fields, count(CASE WHEN kind = 'exact' THEN 1 END) AS n_exact, count(CASE WHEN kind = 'conflict' THEN 1 END) AS n_conflicts, {half} AS agreement FROM {compared(q, t)} GROUP BY 1) AS agreed"


def tree(q, t) -> str:
    """The five checks of each document, and what each asks for."""
    joins = [
        (f"(SELECT doc_id AS pdoc, digits AS phone FROM {phone(q, t)})", "pdoc"), (f"(SELECT doc_id AS vdoc, name AS provider FROM ({detect_provider(q, t)}) AS v0)", "vdoc"), (f"(SELECT doc_id AS fdoc, coalesce(phone, fax) AS contact FROM ({provider_phone_fax(q, t)}) AS f0)", "fdoc"),
        (f"(SELECT doc_id AS adoc, street, city, state, zip FROM {addresses(q, t)})", "adoc"),
    ]
    joined = " ".join(f"LEFT JOIN {sql} AS j{i} ON {key} = facts.doc_id" for i, (sql, key) in enumerate(joins))
    gaps = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ("street", "city", "state", "zip"))
    email = q.like("text", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}")
    rows = f"""SELECT facts.doc_id, first_name IS NOT NULL AND last_name IS NOT NULL AND dob IS NOT NULL AND (phone IS NOT NULL OR {email}) AS complete, carrier IS NOT NULL AND member_id IS NOT NULL AS insured, needs_auth AND reason AS auth,
      n_dx > 0 AS diagnosed, reason OR symptomatic AS reasoned, urgent AND reason AS is_urgent, provider IS NOT NULL AND contact IS NOT NULL AS provided, {gaps} AS gaps FROM {facts(q, t)} {joined}"""
    return f"(SELECT doc_id, complete AS completeness_ok, insured AND NOT auth AS insurance_ok, diagnosed AND reasoned AS clinical_ok, provided AS provider_ok, gaps = 0 AS demographics_ok, auth, insured, is_urgent, gaps FROM ({rows}) AS r) AS tree"


@both("tree_checks")
def tree_checks(q, t):
    return f"SELECT doc_id, completeness_ok, insurance_ok, clinical_ok, provider_ok, demographics_ok, is_urgent FROM {tree(q, t)}"


@both("tree_route")
def tree_route(q, t):
    """Critical failures and low agreement go to a person; then authorization, insurance, provider."""
    agreement = f"SELECT doc_id AS adoc2, agreement FROM {agreed(q, t)}"
    route = "CASE WHEN NOT completeness_ok OR (is_urgent AND NOT clinical_ok) THEN 'MANUAL_REVIEW' WHEN agreement > 0 AND agreement < 70 THEN 'MANUAL_REVIEW' WHEN auth THEN 'AUTHORIZATION_REQUEST' WHEN NOT insured THEN 'INSURANCE_VERIFICATION' WHEN NOT clinical_ok OR NOT provider_ok THEN 'PROVIDER_FOLLOWUP' WHEN gaps > 2 THEN 'MANUAL_REVIEW' ELSE 'READY_TO_SCHEDULE' END"
    return f"SELECT doc_id, {route} AS route FROM {tree(q, t)} LEFT JOIN ({agreement}) AS g ON adoc2 = tree.doc_id"


@both("tree_quality")
def tree_quality(q, t):
    passed = " + ".join(f"CASE WHEN {c}_ok THEN 1 ELSE 0 END" for c in ("completeness", "insurance", "clinical", "provider", "demographics"))
    return f"SELECT doc_id, CAST(s AS INT) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, ({passed}) * 20 AS s FROM {tree(q, t)}) AS a"


@both("merge_compare")
def merge_compare(q, t):
    return f"SELECT doc_id, path, kind, resolved, confidence FROM {compared(q, t)}"


@both("merge_documents")
def merge_documents(q, t):
    return f"SELECT doc_id, n_fields, n_exact, n_conflicts, agreement FROM {agreed(q, t)}"


@both("merge_quality")
def merge_quality(q, t):
    """Agreement, conflicts, the score of confidence (as it stands, up to 5.75, not a share; 0.5 if it is 0) and completeness."""
    rate = "(CAST(n_conflicts AS DOUBLE) / n_fields * 100)"
    s = f"CAST(floor(agreement * 0.4 + (100 - {rate}) * 0.3 + CASE WHEN score = 0 THEN 0.5 ELSE score END * 100 * 0.2 + (n_fields - n_conflicts) / CAST(n_fields AS DOUBLE) * 100 * 0.1 + 0.5) AS INT)"
    scores = f"SELECT doc_id AS sdoc, CAST({SCORE} AS DOUBLE) AS score FROM {facts(q, t)}"
    return f"SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT doc_id, {s} AS score FROM {agreed(q, t)} JOIN ({scores}) AS z ON sdoc = agreed.doc_id) AS b"


@both("cross_validate")
def cross_validate(q, t):
    """Fields in conflict, and fields that the other side fills."""
    return f"SELECT doc_id, path, kind IN ('conflict', 'field_rule') AS conflict, kind IN ('llm_only', 'ocr_only') AS fallback, CASE kind WHEN 'ocr_only' THEN a WHEN 'llm_only' THEN b END AS filled FROM {compared(q, t)}"


def unions(q, t) -> str:
    """Phones, diagnoses and symptoms that either side lists, each once, those of the text's plain patterns (b) before the detectors' (a)."""
    named = "(?i)\\b(" + "|".join(k.replace("_", " ") for k, _, _ in S.SYMPTOMS) + ")\\b"
    number, code = r"\(\d{3}\) \d{3}-\d{4}", r"\b[A-TV-Z]\d{2}\.\d{1,4}\b"
    plain = {
        "patient.phones": (number, q.each(q.extract_all("text", number), "v", q.replace("v", "[^0-9]", ""))), "diagnoses": (code, q.extract_all("text", code)),
        "symptoms": (named, q.each(q.extract_all("text", named), "v", f"lower({q.replace('v', ' ', '_')})")),
    }
    places = "explode(sequence(1, size(vs)))" if q.name == "spark" else "unnest(range(1, len(vs) + 1))"
    each = [f"SELECT doc_id, '{k}' AS path, {q.distinct(vs)} AS vs FROM {t.held(p)}" for k, (p, vs) in plain.items()]
    b = " UNION ALL ".join(f"SELECT doc_id, path, CAST(0 AS BIGINT) AS side, CAST(i AS BIGINT) AS i, {q.at('vs', 'i')} AS v FROM (SELECT doc_id, path, vs, {places} AS i FROM ({x}) AS e WHERE {q.size('vs')} > 0) AS n" for x in each)
    parted, order = symptom_hits(q, t.picked("symptoms", matching.having(SYMPTOMATIC)))
    confirmed = f"SELECT doc_id, label, min(CAST(line AS BIGINT) * 100 + {order}) AS spot FROM ({parted}) AS s WHERE status = 'confirmed' GROUP BY 1, 2"
    a = [
        f"SELECT doc_id, 'patient.phones' AS path, CAST(1 AS BIGINT) AS side, CAST(1 AS BIGINT) AS i, digits AS v FROM {phone(q, t)}",
        f"SELECT doc_id, 'diagnoses', CAST(1 AS BIGINT), CAST(place AS BIGINT), icd FROM {R.ranked_icds(q, t)}",
        f"SELECT doc_id, 'symptoms', CAST(1 AS BIGINT), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS BIGINT), label FROM ({confirmed}) AS c",
    ]
    first = "min(side * 1000000000000 + i)"
    held = lambda side: f"max(CASE WHEN side = {side} THEN v END)"
    return t.stored("unions", f"(SELECT doc_id, path, CAST(row_number() OVER (PARTITION BY doc_id, path ORDER BY {first}) AS INT) AS ord, v, {held(1)} AS a, {held(0)} AS b, min(CASE WHEN side = 1 THEN i END) AS a_place FROM ({b} UNION ALL {' UNION ALL '.join(a)}) AS u WHERE path <> 'patient.phones' OR length(v) >= 10 GROUP BY doc_id, path, v)")


@both("cross_validate_merged")
def cross_validate_merged(q, t):
    """The merged document, a row a value: the text's plain patterns (b) as the model's side, the detectors (a) for what it lacks.

    Names are compared in any case, birth dates by digits, ids and NPIs by all characters, carriers and codes not at all. Phones,
    diagnoses and symptoms are joined; the first of all diagnoses is the main one, unless only detectors have any: then theirs.
    """
    digits = lambda x: q.replace(x, "[^0-9]", "")
    differ = f"CASE WHEN path IN ('patient.firstName', 'patient.lastName') THEN {q.lower('a')} <> {q.lower('b')} WHEN path = 'patient.dob' THEN {digits('a')} <> {digits('b')} WHEN path IN ('insurance.memberId', 'provider.npi') THEN a <> b ELSE false END"
    single = f"SELECT doc_id, path, 1 AS ord, CASE WHEN path = 'insurance.carrier' THEN b ELSE coalesce(b, a) END AS value, b, a, a IS NOT NULL AND b IS NOT NULL AND {differ} AS conflict FROM {fields(q, t)} WHERE path <> 'patient.phone'"
    joined = unions(q, t)
    main = f"SELECT doc_id, 'clinical.primaryDiagnosis' AS path, 1 AS ord, coalesce(mb, ma) AS value, mb AS b, ma AS a, false AS conflict FROM (SELECT doc_id, max(CASE WHEN ord = 1 THEN b END) AS mb, max(CASE WHEN a_place = 1 THEN a END) AS ma FROM {joined} WHERE path = 'diagnoses' GROUP BY 1) AS m"
    rows = f"{single} UNION ALL SELECT doc_id, path, ord, v, b, a, false FROM {joined} UNION ALL {main}"
    filled = "b IS NULL AND a IS NOT NULL AND path IN ('patient.firstName', 'patient.lastName', 'patient.dob', 'provider.npi', 'procedure.cpt')"
    count = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS INT)"
    resolution = "CASE WHEN conflict THEN CASE WHEN path IN ('patient.dob', 'provider.npi') THEN 'flag_review' ELSE 'vlm' END END"
    dob = "conflict AND path = 'patient.dob'"
    return f"SELECT doc_id, path, ord, value, b AS vlm, a AS regex, conflict, {resolution} AS resolution, {count('conflict')} AS conflicts, {count(filled)} AS fallbacks, {count(dob)} > 0 AS verify_manually FROM ({rows}) AS x"


def verified(q, t) -> str:
    """Each resolved field of a document, and how its text has it: exactly, in other case, in letters and digits, in digits, or not."""
    bare = lambda x: q.replace(f"lower({x})", "[^a-z0-9]", "")
    digits = lambda x: q.replace(x, "[^0-9]", "")
    how = f"CASE WHEN length(v) < 2 THEN 'too_short' WHEN {q.contains('text', 'v')} THEN 'exact' WHEN {q.contains('lower(text)', 'lower(v)')} THEN 'case_insensitive' WHEN length({bare('v')}) > 2 AND {q.contains(bare('text'), bare('v'))} THEN 'normalized' WHEN length({digits('v')}) >= 7 AND {q.contains(digits('text'), digits('v'))} THEN 'digits' ELSE 'not_found' END"
    return f"(SELECT doc_id, path, v, {how} AS how FROM (SELECT c.doc_id, c.path, c.resolved AS v, coalesce(i.text, '') AS text FROM {compared(q, t).removesuffix(' AS compared')} AS c JOIN {t.intake.replace(' AS intake', ' AS i')} ON i.doc_id = c.doc_id) AS x) AS verified"


@both("verify_string")
def verify_string(q, t):
    """The share of a document's fields that its text holds, and those that it doesn't."""
    lost = "count(CASE WHEN how IN ('not_found', 'too_short') THEN 1 END)"
    return f"SELECT doc_id, count(*) AS checked, {lost} AS not_found, CAST(count(*) - {lost} AS DOUBLE) / count(*) AS score FROM {verified(q, t)} GROUP BY 1"


@both("verify_uncertainty")
def verify_uncertainty(q, t):
    """Points for fields that the text lacks, phones that are the provider's, missing names and dates, and very many numbers."""
    numbers = q.size(q.distinct(q.extract_all("text", r"\d{3}[\s.-]*\d{3}[\s.-]*\d{4}")))
    lost = f"SELECT doc_id AS ldoc, count(CASE WHEN how = 'not_found' AND path <> 'procedure.cpt' THEN 1 END) AS lost FROM {verified(q, t)} GROUP BY 1"
    shared = f"SELECT b.doc_id AS odoc, max(CASE WHEN b.digits = v.phone OR b.digits = v.fax THEN 1 ELSE 0 END) AS overlap FROM {best_phones(q, t).removesuffix(' AS best_phones')} AS b JOIN ({provider_phone_fax(q, t)}) AS v ON v.doc_id = b.doc_id GROUP BY 1"
    score = f"CASE WHEN lost > 0 THEN 2 ELSE 0 END + CASE WHEN overlap = 1 THEN 3 ELSE 0 END + CASE WHEN first_name IS NULL OR last_name IS NULL THEN 2 ELSE 0 END + CASE WHEN dob IS NULL THEN 1 ELSE 0 END + CASE WHEN {numbers} >= 8 THEN 1 ELSE 0 END"
    return f"SELECT doc_id, score, score >= 2 AS needs_review FROM (SELECT facts.doc_id, {score} AS score FROM {facts(q, t)} LEFT JOIN ({lost}) AS l ON ldoc = facts.doc_id LEFT JOIN ({shared}) AS o ON odoc = facts.doc_id) AS a"


@both("verify_status")
def verify_status(q, t):
    return f"SELECT doc_id, path, CASE kind WHEN 'conflict' THEN 'flagged' WHEN 'fuzzy' THEN 'auto_corrected' WHEN 'field_rule' THEN 'auto_corrected' WHEN 'llm_only' THEN 'vlm_confirmed' WHEN 'ocr_only' THEN 'unverified' ELSE 'confirmed' END AS status FROM {compared(q, t)}"


@both("code_validators")
def code_validators(q, t):
    """Codes of a text: procedure-like, diagnosis-like as the rule stands and as it is meant, children's codes by age, and home tests."""
    token = q.extract("text", r"\b(\d{5}|[A-TV-Z]\d{2}\.\d{1,4}|[A-Z]\d{4})\b")
    child = "code IN ('95782', '95783')"
    return f"SELECT c.doc_id, code, {q.like('code', r'^(\d{5}|[A-Z]\d{4})$')} AS cpt_like, {q.like('code', r'^[A-TV-Z]\d{2}(\.\d{1,2})?$')} AS icd_literal, {q.like('code', r'^[A-TV-Z]\d{2}(\.\d{1,4})?$')} AS icd_intended, CASE WHEN {child} AND age IS NOT NULL THEN age < 6 END AS age_ok, CASE WHEN code IN ('95806', 'G0399') THEN coalesce(age >= 18, true) END AS home_ok FROM (SELECT doc_id, {token} AS code FROM {t.intake}) AS c LEFT JOIN {ages(q, t)} ON ages.doc_id = c.doc_id WHERE code IS NOT NULL"


@both("pdf_model")
def pdf_model(q, t):
    """The report's model: its fields, and the required paths that are missing."""
    provider = f"SELECT doc_id AS vdoc, name AS provider FROM ({detect_provider(q, t)}) AS v0"
    paths = {"patient.last": "last_name", "patient.first": "first_name", "patient.dob": "dob", "insurance.primary.carrier": "carrier", "procedure.cpt": "cpt", "provider.name": "provider"}
    missing = q.join(q.some(*[f"CASE WHEN {c} IS NULL THEN '{k}' END" for k, c in paths.items()]), ",")
    return f"SELECT doc_id, 1 AS version, last_name, first_name, dob, carrier, member_id, cpt, primary_dx, provider, {missing} AS missing FROM {facts(q, t)} LEFT JOIN ({provider}) AS v ON vdoc = facts.doc_id"


@both("report_patient")
def report_patient(q, t):
    """A flat report, with dashes for what isn't known."""
    dash = lambda c: f"coalesce({c}, '-')"
    return f"SELECT doc_id, concat({dash('last_name')}, ', ', {dash('first_name')}) AS name, {dash('dob')} AS dob, {dash('carrier')} AS carrier, {dash('member_id')} AS member_id, {dash('cpt')} AS cpt, {dash('primary_dx')} AS diagnosis, n_dx, confidence FROM {decided(q, t)}"


@both("stream_rate_limit")
def stream_rate_limit(q, t):
    """Requests of a user within the last 60 seconds, this one included, and whether more than 120."""
    ms = q.millis("ts")
    return f"SELECT event_id, n, n > 120 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, {ms} AS ms FROM {t.events}) AS a) AS b"


@both("stream_running_stats")
def stream_running_stats(q, t):
    """Count, least and greatest so far, by type: within each hour, and carried over from the hours before it."""
    hour = f"CAST(floor({q.millis('ts')} / 3600000.0) AS BIGINT)"
    rows = f"SELECT event_id, event_type, value, ts, {hour} AS hour FROM {t.events}"
    before = "OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    hours = f"SELECT event_type, hour, coalesce(sum(n) {before}, 0) AS n0, min(least) {before} AS least0, max(most) {before} AS most0 FROM (SELECT event_type, hour, count(*) AS n, min(value) AS least, max(value) AS most FROM ({rows}) AS r GROUP BY 1, 2) AS h"
    own = "OVER (PARTITION BY event_type, hour ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    within = f"SELECT event_id, event_type, hour, count(*) {own} AS n1, min(value) {own} AS least1, max(value) {own} AS most1 FROM ({rows}) AS r"
    return f"SELECT event_id, CAST(n0 + n1 AS BIGINT) AS n, least(least0, least1) AS least, greatest(most0, most1) AS most FROM ({within}) AS w JOIN ({hours}) AS b ON b.event_type = w.event_type AND b.hour = w.hour"


@both("stream_poll_status")
def stream_poll_status(q, t):
    """The last state of each user's requests, and the kind of an error by words of its message."""
    state = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END"
    kind = f"CASE WHEN {q.like('message', '(?i)timeout|timed out')} THEN 'timeout' WHEN {q.like('message', '(?i)econnrefused|network|socket')} THEN 'network' WHEN {q.like('message', '(?i)ocr')} THEN 'ocr' WHEN {q.like('message', '(?i)parse|json')} THEN 'parse' WHEN {q.like('message', '(?i)not found|404')} THEN 'not_found' ELSE 'unknown' END"
    message = "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'connect ECONNREFUSED' WHEN 2 THEN 'OCR service 500' WHEN 3 THEN 'JSON parse failure' WHEN 4 THEN '404 Not Found' ELSE 'boom' END"
    last = f"SELECT user_id, {q.first_by('event_id', f'-({q.millis("ts")} * 1000000 + event_id)')} AS event_id, {q.first_by('event_type', f'-({q.millis("ts")} * 1000000 + event_id)')} AS event_type FROM {t.events} GROUP BY 1"
    return f"SELECT user_id, {state} AS status, CASE WHEN {state} = 'error' THEN {kind} END AS error FROM (SELECT user_id, event_type, {message} AS message FROM ({last}) AS l) AS m"


@both("sim_levenshtein")
def sim_levenshtein(q, t):
    nation = t.nation.replace(" AS nation", "")
    return f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(lower(a.n_name), lower(b.n_name)) AS distance, {T.similarity(q, 'a.n_name', 'b.n_name')} AS similarity FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


@both("iou_pairs")
def iou_pairs(q, t):
    """Overlap of the boxes of neighbouring lines of an order: place by quantity, size by discount and tax."""
    box = "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_quantity + 10 + l_discount * 100 AS x2 FROM " + t.lineitem.replace(" AS lineitem", "")
    inter = "greatest(CAST(0 AS DOUBLE), least(a.x2, b.x2) - greatest(a.x, b.x))"
    return f"SELECT a.l_orderkey, a.l_linenumber, {inter} / (a.x2 - a.x + b.x2 - b.x - {inter}) AS iou FROM ({box}) AS a JOIN ({box}) AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"


@both("filename_collisions")
def filename_collisions(q, t):
    """Last_First_CODE_date names, with _v2 and on for repeats."""
    base = f"concat({T.snake_case(q, 'c_mktsegment')}, '_', substring(CAST(o_orderdate AS {'STRING' if q.name == 'spark' else 'VARCHAR'}), 1, 10))"
    return f"SELECT o_orderkey, CASE WHEN r = 1 THEN concat(base, '.pdf') ELSE concat(base, '_v', r, '.pdf') END AS file_name FROM (SELECT o_orderkey, base, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, {base} AS base FROM {t.orders} JOIN {t.customer} ON o_custkey = c_custkey) AS a) AS b"


@both("json_path")
def json_path(q, t):
    return f"SELECT event_id, {q.json_int('props', 'k')} AS k FROM {t.events}"


@both("src_processed_upsert")
def src_processed_upsert(q, t):
    """Records by key, the last one kept."""
    return f"SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM {t.orders}) AS a WHERE place = 1"


@both("sink_purge")
def sink_purge(q, t):
    return f"SELECT o_orderkey FROM {t.orders} WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_custkey NOT IN (SELECT c_custkey FROM {t.customer} WHERE c_acctbal < 0)"


@both("sink_retention")
def sink_retention(q, t):
    return f"SELECT event_id FROM {t.events} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'"


@both("sink_ndjson_rotate")
def sink_ndjson_rotate(q, t):
    return f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM {t.events}) AS a WHERE place <= 300"


@both("sink_bulk_export")
def sink_bulk_export(q, t):
    """Results, newest first, with their place in the export."""
    return f"SELECT o_orderkey, place FROM {ranked(f'SELECT o_orderkey, o_orderdate FROM {t.orders}', ['o_orderdate', 'o_orderkey'], ['o_orderdate'], descending=True)}"


@both("sink_fhir")
def sink_fhir(q, t):
    """One row a resource of a document's bundle: the patient, the provider, the payer, the coverage, the order, and each diagnosis."""
    text = "STRING" if q.name == "spark" else "VARCHAR"
    uid = lambda kind: f"substring({q.sha256(f'concat({kind}, chr(58), CAST(doc_id AS {text}))')}, 1, 32)"
    provider = f"SELECT doc_id AS vdoc, name AS provider FROM ({detect_provider(q, t)}) AS v0"
    number = f"SELECT doc_id AS ndoc, npi FROM ({provider_npi(q, t)}) AS v1"
    dialed = f"SELECT doc_id AS pdoc, digits AS phone FROM {phone(q, t)}"
    rows = f"SELECT facts.*, provider, npi, phone FROM {facts(q, t)} LEFT JOIN ({provider}) AS v ON vdoc = facts.doc_id LEFT JOIN ({number}) AS n ON ndoc = facts.doc_id LEFT JOIN ({dialed}) AS p ON pdoc = facts.doc_id"
    kinds = q.some("'Patient'", "CASE WHEN provider IS NOT NULL THEN 'Practitioner' END", "CASE WHEN carrier IS NOT NULL THEN 'Organization' END", "CASE WHEN carrier IS NOT NULL THEN 'Coverage' END", "CASE WHEN cpt IS NOT NULL THEN 'ServiceRequest' END")
    each = f"SELECT *, {q.explode(kinds)} AS kind FROM ({rows}) AS r"
    date = "CASE WHEN dob IS NOT NULL THEN concat(substring(dob, 7, 4), '-', substring(dob, 1, 2), '-', substring(dob, 4, 2)) END"
    name = "CASE kind WHEN 'Patient' THEN last_name WHEN 'Practitioner' THEN provider WHEN 'Organization' THEN carrier END"
    patient = uid("'Patient'")
    subject = f"CASE WHEN kind IN ('Coverage', 'ServiceRequest') THEN {patient} END"
    identifier = "CASE kind WHEN 'Coverage' THEN member_id WHEN 'Practitioner' THEN npi END"
    bundle = f"SELECT doc_id, kind AS resource_type, {uid('kind')} AS id, {name} AS name, CASE WHEN kind = 'Patient' THEN first_name END AS given, CASE WHEN kind = 'Patient' THEN {date} END AS birth_date, CASE WHEN kind = 'Patient' THEN phone END AS telecom, {identifier} AS identifier, CASE WHEN kind = 'ServiceRequest' THEN cpt END AS code, {subject} AS subject FROM ({each}) AS e"
    none = ", ".join(f"CAST(NULL AS {text})" for _ in range(5))
    return f"{bundle} UNION ALL SELECT doc_id, 'Condition', {uid('icd')}, {none}, icd, {patient} FROM {R.ranked_icds(q, t)}"


@both("sink_pdf")
def sink_pdf(q, t):
    """The rows of a report's page: section, label and value, in the order in which they are set."""
    dash = lambda c: f"coalesce({c}, '-')"
    lines = [("Patient", "Name", f"concat({dash('last_name')}, ', ', {dash('first_name')})"), ("Patient", "Birth date", dash("dob")), ("Insurance", "Carrier", dash("carrier")), ("Insurance", "Member id", dash("member_id")), ("Procedure", "Code", dash("cpt")), ("Clinical", "Diagnosis", dash("primary_dx")), ("Review", "Confidence", "confidence")]
    entries = q.array(*[f"concat('{i}|{a}|{b}|', {c})" for i, (a, b, c) in enumerate(lines)])
    part = lambda p: q.extract("entry", p, 1)
    return f"SELECT doc_id, CAST({part('^([0-9]+)[|]')} AS INT) AS ord, {part('^[0-9]+[|]([^|]*)[|]')} AS section, {part('^[0-9]+[|][^|]*[|]([^|]*)[|]')} AS label, {part('^[0-9]+[|][^|]*[|][^|]*[|](.*)$')} AS value FROM (SELECT doc_id, {q.explode(entries)} AS entry FROM {decided(q, t)}) AS x"
