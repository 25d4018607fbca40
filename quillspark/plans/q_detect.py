"""Field detectors: lines or texts to candidates, and the best candidate of each document."""

from __future__ import annotations

from ..catalogs import carriers as C
from ..catalogs import icd as I
from ..catalogs import member_ids as M
from ..catalogs import symptoms as S
from ..functions import text as T
from . import q_result as R
from .both import both

# Patterns, phrases and weights.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
BUSINESS_EMAILS = ["athomesleepstudies@ymail.com", "athomesleepstudies@gmail.com", "test@test.com"]
PHONE = r"\(?\d{3}\)?[\s.-]*\d{3}[\s.-]*\d{4}"
PHONE_RAW = r"\b(?:\+?1[\s\-.()]*)?(?:\(?\d{3}\)?[\s\-.]*)\d{3}[\s\-.]*\d{4}\b"
PHONE_LISTED = ["7024638062", "7024638368", "7024363530"]
THIRD_PARTY_BUSINESS = r"(pharmacy|walgreens|cvs|rite\s*aid|drug\s*store|drugstore|quest\s*diagnostics|labcorp|laboratory|preferred\s*lab|preferred\s*imaging|radiology|imaging|psc\b|interventional\s*radiology|medical\s*imaging|pueblo\s*medical\s*imaging)"
INSURANCE_ANCHOR = r"(?i)(other\s+insurance|secondary\s+insurance|\bsecondary\b.*insurance|payer\s*[:\-]|plan\s*[:\-]|^\s*insurance\s*[:\-])"
SYMPTOM_SKIP = r"(sleep\s+apnea\s+is|symptoms\s+include|studies\s+indicate|literature\s+shows|patient\s+education|handout|brochure|definition:|examples:|generally|usually|commonly|often|check\s+all\s+that\s+apply|circle\s+one|mark\s+if\s+present|instructions:|please\s+indicate)"
SYMPTOM_CONDITIONAL = r"(if\s+patient|should\s+patient|would\s+indicate|rule\s+out|consider(?:ed)?|possible\b|maybe\b|might\b|could\b|to\s+be\s+evaluated|for\s+consideration|assess\s+for|differential\s+includes)"
SYMPTOM_FAMILY = r"(family\s+history|\bfh[:\s]|\bfhx\b)"
THIRD_PARTY = r"(mother|father|sister|brother|grandmother|grandfather|spouse|husband|wife|partner|child|son|daughter|kids|roommate|friend|coworker|colleague|neighbor)"
SYMPTOM_HISTORY = r"(history\s+of|hx\s+of|past\s+history|previously|former|used\s+to|remote\s+history|past\s+medical\s+history|\bpmh\b)"
SYMPTOM_STILL = r"(still|ongoing|continues|currently|active|now|persists|persistent)"
SYMPTOM_RESOLVED = r"(resolved|no\s+longer|discontinued|stopped|was\s+on|had\s+been|off\s+cpap|quit\s+therapy|previously\s+treated)"
SYMPTOM_MEDICATION = r"(?i)(oxycodone|morphine|fentanyl|hydrocodone|percocet|vicodin|opioid|pain\s+medication|lisinopril|metoprolol|amlodipine|bp\s+meds?|ace\s+inhibitor|beta\s+blocker|diuretic|ambien|trazodone|melatonin|sleep\s+aid|antidepressant|anxiety\s+medication|benzodiazepine)"
SYMPTOM_TEST = r"(?i)(previous\s+sleep\s+study|prior\s+psg|last\s+test|results\s+indicate|findings\s+show|report\s+states|ahi\s+was|rdi|oxygen\s+sat|desaturation|study\s+revealed|testing\s+showed|sleep\s+study)"
DME_ISSUES = [
    ("not_tolerating", r"(?i)not\s*tolerating|cannot\s*tolerate|intoleran"), ("pressure_high", r"(?i)pressure\s*too\s*high|high\s*pressure"), ("pressure_low", r"(?i)pressure\s*too\s*low|low\s*pressure"),
    ("mask_leak", r"(?i)mask\s*leak|air\s*leak"), ("mask_uncomfortable", r"(?i)mask\s*uncomfortable|uncomfortable\s*mask"), ("machine_broken", r"(?i)machine\s*broken|equipment\s*malfunction"),
    ("usage_limit", r"(?i)lifetime\s*usage\s*limit|insurance\s*limit\s*reached"), ("cpap_user", r"(?i)cpap\s*user|uses\s*cpap|on\s*cpap"), ("cpap_compliance", r"(?i)cpap\s*compliant|cpap\s*non-?compliant"),
    ("cpap_supplies", r"(?i)cpap\s*supplies|cpap\s*replacement"), ("dme_provider", r"(?i)dme\s*provider|equipment\s*provider"),
]
INSURANCE_WORDS = ["insurance", "insured", "carrier", "lnsurance", "insurence", "aetna", "aetha", "aethna", "anthem", "blue cross", "cigna", "humana", "united", "medicare", "medicaid", "primary", "hcd primary", "hed primary"]
MEMBER_SOURCES = {"labeled_id": 50, "labeled_primary": 45, "primary_window": 35, "labeled_fallback": 30, "proximity": 15}
# End of fixed values.

#: Texts without one of these have no member id: eight letters and digits in a row, with a digit among them.
MEMBER_MARK = "|".join(f"[A-Za-z0-9\u017f\u212a]{{{k}}}[0-9][A-Za-z0-9\u017f\u212a]{{{7 - k}}}" for k in range(8))


@both("detect_email")
def detect_email(q, t):
    """Of a text's addresses that aren't a business's the first that says patient, where the text labels one, else the first."""
    clean = q.each(q.extract_all("text", EMAIL), "v", q.replace("v", "[.,;:]+$", ""))
    listed = ", ".join(map(q.text, BUSINESS_EMAILS))
    open_ = q.keep(q.distinct("found"), "v", f"v <> '' AND lower(v) NOT IN ({listed})")
    named = q.get(q.keep("kept", "v", q.contains("lower(v)", "'patient'")), 1)
    found = f"SELECT doc_id, {q.like('text', r'(?i)patient\s*email')} AS labelled, {clean} AS found FROM {t.intake} WHERE {q.like('text', EMAIL)}"
    return f"SELECT doc_id, lower(CASE WHEN labelled AND {named} IS NOT NULL THEN {named} ELSE {q.get('kept', 1)} END) AS email FROM (SELECT doc_id, labelled, {open_} AS kept FROM ({found}) AS a) AS b WHERE {q.size('kept')} > 0"


@both("detect_emergency")
def detect_emergency(q, t):
    joined = "concat_ws(' | ', text, n1, n2)"
    return f"""SELECT doc_id, {q.extract('j', r"([A-Z][a-zA-Z'-]+\s+[A-Z][a-zA-Z'-]+)", 1)} AS name, {q.extract('j', r'\(\d{3}\)\s*\d{3}-\d{4}')} AS phone, lower({q.extract('j', r'(?i)(mother|father|parent|spouse|wife|husband|partner|daughter|son|sister|brother|caregiver|guardian|friend)')}) AS relation FROM (
      SELECT doc_id, {joined} AS j, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM (SELECT doc_id, line, text, lead(text, 1) OVER (PARTITION BY doc_id ORDER BY line) AS n1, lead(text, 2) OVER (PARTITION BY doc_id ORDER BY line) AS n2 FROM {t.lines}) AS a
      WHERE {q.like('text', r'(?i)in\s*case\s*of\s*emergency|emergency\s*contact|contact\s*.*emergency')}) AS b WHERE r = 1"""


def phones(q, t) -> str:
    """Distinct phone numbers of each document: where they stand first, why they are rejected, score and area frequency."""
    core = q.replace(q.replace("raw", "[^0-9]", ""), r"^1(\d{10})$", "$1")
    rows = f"SELECT doc_id, text, raw, {core} AS digits, {q.position('text', 'raw')} AS spot FROM (SELECT doc_id, text, {q.explode(q.distinct(q.extract_all('text', PHONE_RAW)))} AS raw FROM {t.held(PHONE_RAW)} WHERE {q.like('text', PHONE_RAW)}) AS a"
    first = f"SELECT doc_id, digits, text, spot, substring(text, 1, CAST(spot - 1 AS INT)) AS head, substring(text, CAST(spot AS INT), length(text)) AS tail FROM (SELECT doc_id, digits, text, spot, row_number() OVER (PARTITION BY doc_id, digits ORDER BY spot, raw) AS place FROM ({rows}) AS b) AS c WHERE place = 1 AND length(digits) = 10 AND digits NOT IN ({', '.join(map(q.text, PHONE_LISTED))})"
    # The head's last lines by their line ends in Spark: a pattern that ends with the text starts anew at each letter of a long line.
    cut = lambda x, p, n: f"substring_index({x}, {q.text(chr(10))}, {n})" if q.name == "spark" else q.extract(x, p)
    line = f"concat(coalesce({cut('head', r'[^\n]*\z', -1)}, ''), coalesce({cut('tail', r'^[^\n]*', 1)}, ''))"
    around = f"lower(concat(coalesce({cut('head', r'(?:[^\n]*\n){0,2}[^\n]*\z', -3)}, ''), coalesce({cut('tail', r'^[^\n]*(?:\n[^\n]*){0,2}', 3)}, '')))"
    near = lambda n: f"lower(substring(text, CAST(greatest(1, spot - {n}) AS INT), CAST(least(spot - 1, {n}) + {n} AS INT)))"
    seen = f"SELECT doc_id, digits, {q.size(q.split('head', chr(92) + 'n'))} - 1 AS line, {line} AS text, lower({line}) AS low, {near(80)} AS wide, {near(40)} AS ctx, {around} AS around FROM ({first}) AS d"
    has = lambda x, p: q.like(x, p)
    reason = f"""CASE WHEN NOT {T.valid_nanp(q, 'digits')} THEN 'nanp'
      WHEN {has('wide', r'\b(fax|fx|facsimile)\b')} OR {has('low', r'^\s*f[:\-\s]')} OR {T.is_fax(q, 'text')} OR {has('wide', r'f[ao0@][xk]([^a-z]|$)')} THEN 'fax'
      WHEN {T.is_from(q, 'text')} THEN 'from_header' WHEN {has('low', r'(provider|referring|physician|npi|ordering|office|clinic)')} OR {T.is_provider(q, 'text')} THEN 'provider_context'
      WHEN {has('low', r'^\s*phone\s*:')} AND {has('wide', r'ordering\s*(provider|physician)|provider|physician|office|clinic|facility')} THEN 'provider_label_near'
      WHEN {has('around', r'\bplace\s+of\s+surgery\b|\bhome\s+sleep\s+stud')} THEN 'facility_context' WHEN {has('concat(wide, around)', THIRD_PARTY_BUSINESS)} THEN 'third_party' END"""
    one = lambda x, p, w: f"CASE WHEN {has(x, p)} THEN {w} ELSE 0 END"
    fuzzy = q.replace(q.replace(q.replace(q.replace("low", "[0@]", "o"), "mobte|mobilc", "mobile"), "morme|morne|mome|homc|homr|homa", "home"), "phona", "phone")
    fuzzy = q.replace(fuzzy, "prnary|prmary|pnmary|prmry|pnmaty|prmaty", "primary")
    flag = lambda c: f"CAST({c} AS INT)"
    guard = f"{flag(T.is_patient(q, 'text'))} * 6 - {flag(T.is_header(q, 'text'))} * 5 - {flag(T.is_provider(q, 'text'))} * 6 - {flag(T.is_fax(q, 'text'))} * 8 - greatest(0, {T.context_score(q, 'text')}) * CAST(0.5 AS DOUBLE)"
    parts = [one("low", r"\b[hm]:\s*\(?\d{3}\)?", 20), one("ctx", r"patient\s*(information|phone|contact)", 15), one("fuzzy", r"\bhome\s*phone\b", 12), one("fuzzy", r"\bmobi[el]e?\s*phone\b", 12), one("low", r"\bhoma\s*phona\b", 12)]
    parts += [one("fuzzy", r"\bprimary\s*(home|mobile)\b", 5), one("around", r"(facesheet|demographics|patient\s*information)", 8), one("ctx", r"phone|tel|cell|mobile", 5), one("ctx", "patient", 3), one("ctx", "provider|office|clinic|facility|practice", -10)]
    parts += [one("ctx", "ordering|referring|physician", -10), one("ctx", "fax", -15), one("ctx", "insurance|auth|authorization", -5), one("ctx", r"\bplace\s+of\s+surgery\b", -8), one("ctx", r"\bsleep\s+stud", -6)]
    hints = " + ".join(f"CAST({has('ctx', p)} AS INT)" for p in (r"patient\s*(information|phone|contact)", r"\bhome\s*phone\b", r"\bmobile\s*phone\b", r"\bh:\s*\(?\d{3}", r"\bm:\s*\(?\d{3}"))
    scored = f"SELECT doc_id, digits, line, {reason} AS reason, {' + '.join(parts)} + {guard} AS base, {hints} AS hints FROM (SELECT *, {fuzzy} AS fuzzy FROM ({seen}) AS e) AS f"
    area = "count(CASE WHEN reason IS NULL THEN 1 END) OVER (PARTITION BY doc_id, substring(digits, 1, 3))"
    return t.stored("phones", f"(SELECT doc_id, digits, line, reason, hints, area, base + CASE WHEN reason IS NULL THEN area ELSE 0 END AS score FROM (SELECT *, {area} AS area FROM ({scored}) AS g) AS h)")


def best_phones(q, t) -> str:
    """Up to three numbers of a document: those above 12, else those of the most frequent area; the best is above 0."""
    kept = f"SELECT doc_id, digits, line, score, hints, max(score) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, substring(digits, 1, 3)) AS area_place, substring(digits, 1, 3) AS code FROM {phones(q, t)} WHERE reason IS NULL"
    area = f"SELECT *, max(CASE WHEN area_place = 1 THEN code END) OVER (PARTITION BY doc_id) AS main FROM ({kept}) AS a"
    some = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, digits) AS place FROM ({area}) AS b WHERE (top > 12 AND score > 12) OR (top <= 12 AND code = main)"
    return f"(SELECT doc_id, digits, line, score, place, score + CASE WHEN hints >= 2 THEN 8 ELSE 0 END AS fused, max(score) OVER (PARTITION BY doc_id) AS best FROM ({some}) AS c WHERE place <= 3) AS best_phones"


def phone(q, t) -> str:
    return f"(SELECT doc_id, digits, line, fused AS score FROM (SELECT doc_id, digits, line, fused, row_number() OVER (PARTITION BY doc_id ORDER BY fused DESC, score DESC, line, digits) AS first FROM {best_phones(q, t)} WHERE best > 0) AS x WHERE first = 1 AND fused >= 1) AS phone"


@both("detect_phone")
def detect_phone(q, t):
    return f"SELECT doc_id, digits, line, score FROM {phone(q, t)}"


@both("detect_phone_raw")
def detect_phone_raw(q, t):
    return f"SELECT doc_id, digits, line, coalesce(reason, 'kept') AS reason, score FROM {phones(q, t)}"


@both("detect_dob")
def detect_dob(q, t):
    return f"SELECT doc_id, dob, score FROM {R.births(q, t)}"


@both("detect_name")
def detect_name(q, t):
    return f"SELECT doc_id, first_name, last_name, score FROM {R.names(q, t)}"


def addresses(q, t) -> str:
    """Street, city, state and ZIP: after an address label with the city on one of the next five lines, else on one line."""
    label, one, csz = r"(?i)(?:address|addr|street|residence)\s*[:\-]?\s*(.+)", r"(\d{1,6} [A-Za-z0-9 .]+), ([A-Za-z .]+), ([A-Z]{2}) (\d{5})", r"^([A-Za-z\s]+),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)"
    noise = q.like("text", r"(?i)^page:|^\d+/\d+|fax|confidential|athena|disclaimer")
    ahead = ", ".join(f"lead(text, {k}) OVER (PARTITION BY doc_id ORDER BY line) AS n{k}" for k in range(1, 6))
    next_city = "coalesce(" + ", ".join(f"CASE WHEN {q.like(f'n{k}', csz)} THEN n{k} END" for k in range(1, 6)) + ")"
    rows = f"SELECT doc_id, line, text, {noise} AS noise, {q.extract('text', label, 1)} AS tail, {ahead} FROM {t.lines} WHERE line < 300"
    street = f"trim({q.replace('tail', ',.*$', '')})"
    labelled = f"SELECT doc_id, line, 0 AS tier, {street} AS street, {next_city} AS c FROM ({rows}) AS a WHERE NOT noise AND {q.like('tail', r'\d+\s+[A-Za-z]')} AND length(trim(tail)) > 5"
    parted = f"SELECT doc_id, line, tier, street, trim({q.extract('c', csz, 1)}) AS city, {q.extract('c', csz, 2)} AS state, {q.extract('c', csz, 3)} AS zip FROM ({labelled}) AS b"
    plain = f"SELECT doc_id, line, 1 AS tier, {q.extract('text', one, 1)} AS street, {q.extract('text', one, 2)} AS city, {q.extract('text', one, 3)} AS state, {q.extract('text', one, 4)} AS zip FROM {t.lines} WHERE {q.like('text', one)}"
    pick = ", ".join(f"{q.first_by(c, f'CASE WHEN {c} IS NOT NULL THEN tier * 100000 + line END')} AS {c}" for c in ("street", "city", "state", "zip"))
    return f"(SELECT doc_id, {pick} FROM ({parted} UNION ALL {plain}) AS e GROUP BY 1) AS addresses"


@both("detect_address")
def detect_address(q, t):
    return f"SELECT doc_id, street, city, state, zip FROM {addresses(q, t)}"


@both("detect_cpt")
def detect_cpt(q, t):
    return f"SELECT doc_id, cpt, candidates, ambiguity, intent, titration FROM {R.cpt(q, t)}"


@both("cpt_confidence")
def cpt_confidence(q, t):
    return f"SELECT doc_id, CASE WHEN n_ambiguity = 0 THEN 'high' WHEN n_ambiguity = 1 THEN 'medium' ELSE 'low' END AS confidence FROM {R.cpt(q, t)}"


def icd_table(q) -> str:
    """The accepted codes with their alert, chronicity, severity and note."""
    alerts, severity, notes = dict(I.ALERTS), dict(I.SEVERITY), dict(I.NOTES)
    rows = {c.replace(".", ""): (c.replace(".", ""), d, alerts.get(c), int(c in I.CHRONIC), severity.get(c), notes.get(c)) for c, d in I.ICD}
    for c, a in I.ALERTS:
        rows.setdefault(c.replace(".", ""), (c.replace(".", ""), None, a, 0, None, None))
    return q.values("codes", "alias, description, alert, chronic, severity, note", list(rows.values()))


@both("detect_icd")
def detect_icd(q, t):
    return f"SELECT doc_id, icd, pass, line, description, alert, chronic = 1 AS chronic, severity, note FROM {R.icd_codes(q, t)} LEFT JOIN {icd_table(q)} ON alias = {q.replace('icd', '[.]', '')}"


@both("icd_priority")
def icd_priority(q, t):
    return f"SELECT doc_id, icd, place FROM {R.ranked_icds(q, t)}"


@both("detect_carrier")
def detect_carrier(q, t):
    return f"SELECT doc_id, carrier, status, why FROM {R.main_carriers(q, t)} WHERE carrier IS NOT NULL"


def policy(q) -> tuple[str, str, str]:
    """Days to a contract's end, actions and notes of a row of carriers, as of AS_OF."""
    days = "CASE carrier " + " ".join(f"WHEN {q.text(n)} THEN {R.contract_days(n)}" for n, _ in C.CONTRACT_END) + " END"
    flags = [f"CASE WHEN {q.contains('u', q.text(' '.join(w.upper().split())))} THEN {q.text('insurance_auto_flag:' + w)} END" for w in C.AUTO_FLAG]
    ended = f"CASE WHEN {days} < 0 THEN 'insurance_contract_expired' WHEN {days} <= 30 THEN 'insurance_contract_expiring' END"
    notes: dict[str, list[str]] = {}
    for n, note in C.PLAN_NOTES:
        notes.setdefault(n, []).append(note)
    noted = "CASE carrier " + " ".join(f"WHEN {q.text(n)} THEN {q.text(' | '.join(x))}" for n, x in notes.items()) + " END"
    return days, q.join(q.some(ended, *flags), ","), noted


@both("carrier_policy")
def carrier_policy(q, t):
    """Contracts that ended are not accepted, those that end within 30 days expire; words of the text raise flags."""
    days, actions, notes = policy(q)
    return f"SELECT doc_id, carrier, status, days, actions, notes FROM (SELECT doc_id, carrier, status, {days} AS days, {actions} AS actions, {notes} AS notes FROM {R.carriers(q, t.intake)}) AS p WHERE carrier IS NOT NULL OR actions <> ''"


def member_hits(q, t) -> str:
    """Each hit of each rule: doc_id, source, weight, value, label."""
    label = lambda p: (f"{q.explode(q.extract_all('text', p))} AS hit", p)
    rules = [
        ("labeled_primary", 4.5, r"(?i)\b(member\s*(?:id|#|number)?)\s*[:#-]?\s*([A-Z0-9]{3,})\b"),
        ("labeled_fallback", 3.5, r"(?i)\b((?:subscriber|insured|policy)\s*(?:id|#|number))\s*[:#-]?\s*([A-Z0-9]{3,})\b"),
        ("labeled_id", 8.0, r"(?i)\b(ins(?:urance)?\s*(?:no\.?|#|id|number)?)\s*[:#-]?\s*([A-Z0-9]{3,})\b"),
    ]
    parts = [f"SELECT doc_id, '{n}' AS source, {k} AS ord, CAST({w} AS DOUBLE) AS weight, {q.extract('hit', p, 2)} AS raw, lower({q.extract('hit', p, 1)}) AS label FROM (SELECT doc_id, {label(p)[0]} FROM {t.held(MEMBER_MARK)} WHERE {q.like('text', p)}) AS h{k}" for k, (n, w, p) in enumerate(rules, 2)]
    window = r"(?i)(?:primary\s+insurance|insurance\s*\(ppo\)|insurance\b)[^\n]*(?:\n[^\n]*){0,7}"
    carrier = r"(?i)(?:aetna|anthem|cigna|humana|united|medicare|medicaid)\b[^\n]*(?:\n[^\n]*){0,7}"
    token, named = r"(?i)\b([A-Z]\d{8,10})\b", r"(?i)\b(?:ins(?:urance)?|id)\s*(?:no\.?|#|id|number)?\s*[:#-]?\s*([A-Z0-9]{6,})\b"
    block = f"SELECT doc_id, coalesce({q.extract('text', window)}, {q.extract('text', carrier)}) AS block FROM {t.held(MEMBER_MARK)}"
    parts.append(f"SELECT doc_id, 'primary_window' AS source, 1 AS ord, CAST(5 AS DOUBLE) AS weight, coalesce({q.extract('block', token, 1)}, {q.extract('block', named, 1)}) AS raw, CAST(NULL AS {'STRING' if q.name == 'spark' else 'VARCHAR'}) AS label FROM ({block}) AS w")
    parts.append(f"SELECT doc_id, 'proximity', 5, CAST(weight AS DOUBLE), token, CAST(NULL AS {'STRING' if q.name == 'spark' else 'VARCHAR'}) FROM {near_tokens(q, t)}")
    value = f"upper({q.replace('raw', '[^A-Za-z0-9]', '')})"
    return f"(SELECT doc_id, source, ord, weight, value, label FROM (SELECT doc_id, source, ord, weight, {value} AS value, label FROM ({' UNION ALL '.join(parts)}) AS p) AS v WHERE length(value) >= 8 AND {q.like('value', '[0-9]')}) AS member_hits"


def near_tokens(q, t) -> str:
    """Id-like tokens with a weight by the distance of their first place from the nearest insurance word."""
    token, words = r"\b[A-Z]\d{8,10}\b", "(?:" + "|".join(INSURANCE_WORDS) + ")"
    rows = f"SELECT doc_id, lower(text) AS low, token, {q.position('text', 'token')} AS spot FROM (SELECT doc_id, text, {q.explode(q.extract_all('text', token))} AS token FROM {t.held(token)} WHERE {q.like('text', token)}) AS a"
    before = f"CASE WHEN {q.like('head', words)} THEN spot - 1 - length({q.extract('head', r'^([\s\S]*)' + words, 1)}) END"
    after = f"nullif({q.first_at('tail', words)}, 0) - 1"
    sides = f"SELECT doc_id, token, spot, substring(low, 1, CAST(spot - 1 AS INT)) AS head, substring(low, CAST(spot AS INT), length(low)) AS tail FROM ({rows}) AS b"
    near = f"SELECT doc_id, token, least(coalesce({before}, 1000000), coalesce({after}, 1000000)) AS d FROM ({sides}) AS c"
    return f"(SELECT doc_id, token, CASE WHEN d = 1000000 THEN 1 ELSE greatest(1, 6 - CAST(floor(least(d, 800) / 120.0) AS INT)) END AS weight FROM ({near}) AS e) AS near_tokens"


def member_ids(q, t) -> str:
    """Values with their summed weight, hits, and the source and label of the first rule that found them."""
    return t.stored("member_ids", f"(SELECT doc_id, value, sum(weight) AS score, count(*) AS n, count(DISTINCT source) AS n_rules, {q.first_by('source', 'ord')} AS source, {q.first_by("coalesce(label, '')", f"concat(CAST(ord AS {'STRING' if q.name == 'spark' else 'VARCHAR'}), coalesce(label, ''))")} AS label FROM {member_hits(q, t)} GROUP BY 1, 2)")


@both("member_id_candidates")
def member_id_candidates(q, t):
    return f"SELECT doc_id, value, score, n, source FROM {member_ids(q, t)}"


def rule_scores(q, t, ids: str | None = None) -> str:
    """Candidates (member_ids, or others of the same columns) under their document's carrier's rule: first pattern, label, length, letters and digits; 10 and more where there is none."""
    aliases: dict[str, str] = {}
    for name, synonyms, *_ in M.RULES:
        for x in (name, *synonyms):
            aliases.setdefault(x.lower(), name)
    rules = q.values("rules", "own, low, high, mixed, letters, excluded", [(n, low, high, int(mixed), int(letters), "|".join(f"(?:{p})" for p in excluded) or None) for n, _, _, _, low, high, mixed, letters, excluded in M.RULES])
    labels = q.values("labels", "own, word", [(n, x.lower()) for n, _, words, *_ in M.RULES for x in words])
    patterns = q.values("patterns", "own, ord, pattern, points", [(c, i, "(?i)" + p, score - 5 * old) for c, i, p, score, old in M.PATTERNS])
    carrier = f"SELECT doc_id AS cdoc, carrier FROM {R.main_carriers(q, t)}"
    found = f"SELECT m.*, carrier, rule FROM {ids or member_ids(q, t).replace(' AS member_ids', ' AS m')} LEFT JOIN ({carrier}) AS k ON cdoc = m.doc_id LEFT JOIN {q.values('aliases', 'who, rule', sorted(aliases.items()))} ON who = lower(carrier)"
    matched = f"SELECT doc_id AS pdoc, value AS pvalue, {q.first_by('points', 'ord')} AS points FROM ({found}) AS f1 JOIN {patterns} ON own = rule AND {q.like_column('value', 'pattern')} GROUP BY 1, 2"
    labelled = f"SELECT DISTINCT doc_id AS ldoc, value AS lvalue FROM ({found}) AS f2 JOIN {labels} ON own = rule AND {q.contains('label', 'word')}"
    generic = f"10 + CASE WHEN {q.like('value', '[A-Z]')} AND {q.like('value', '[0-9]')} THEN 8 ELSE 0 END + CASE WHEN length(value) BETWEEN 8 AND 12 THEN 5 ELSE 0 END"
    ruled = f"coalesce(points, 0) + CASE WHEN ldoc IS NOT NULL THEN 20 ELSE 0 END - CASE WHEN length(value) NOT BETWEEN low AND high THEN 20 ELSE 0 END - CASE WHEN mixed = 1 AND NOT ({q.like('value', '[A-Z]')} AND {q.like('value', '[0-9]')}) THEN 15 ELSE 0 END - CASE WHEN letters = 1 AND {q.like('value', '^[0-9]+$')} THEN 10 ELSE 0 END - CASE WHEN coalesce({q.like_column('value', 'excluded')}, false) THEN 40 ELSE 0 END"
    return f"(SELECT doc_id, value, score, n, source, label, carrier, CASE WHEN rule IS NOT NULL THEN {ruled} ELSE {generic} END AS rule_score, CASE WHEN rule IS NOT NULL AND ldoc IS NOT NULL THEN 20 ELSE 0 END AS label_points FROM ({found}) AS f LEFT JOIN {rules} ON rules.own = rule LEFT JOIN ({matched}) AS p ON pdoc = doc_id AND pvalue = value LEFT JOIN ({labelled}) AS l ON ldoc = doc_id AND lvalue = value) AS rule_scores"


def placed_members(q, scores: str, sources: dict[str, int]) -> str:
    """Candidates by the worth of the first rule that found them and their carrier's rule; the label isn't handed to that rule here."""
    base = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sources.items()) + " ELSE 10 END"
    total = f"{base} + CASE WHEN carrier IS NOT NULL THEN greatest(0, rule_score - label_points) ELSE 0 END + CASE WHEN {T.likely_not_member_id(q, 'value')} THEN -40 ELSE 0 END + CASE WHEN {q.like('value', '[A-Z]')} AND {q.like('value', '[0-9]')} THEN 8 ELSE 0 END + CASE WHEN length(value) BETWEEN 8 AND 12 THEN 5 WHEN length(value) BETWEEN 13 AND 15 THEN 2 ELSE 0 END - CASE WHEN n > 3 THEN 3 * (n - 3) ELSE 0 END"
    return f"(SELECT doc_id, value, total, place FROM (SELECT doc_id, value, {total} AS total, row_number() OVER (PARTITION BY doc_id ORDER BY {total} DESC, n DESC, length(value) DESC, value) AS place FROM {scores}) AS x)"


def member_ranks(q, t) -> str:
    return t.stored("member_ranks", placed_members(q, rule_scores(q, t), MEMBER_SOURCES))


@both("member_id_rank")
def member_id_rank(q, t):
    return f"SELECT doc_id, value, total, place FROM {member_ranks(q, t)}"


@both("member_id_proximity")
def member_id_proximity(q, t):
    return f"SELECT doc_id, token, weight FROM {near_tokens(q, t)}"


@both("rule_engine_score")
def rule_engine_score(q, t):
    return f"SELECT doc_id, value, carrier, rule_score AS score FROM {rule_scores(q, t)}"


@both("group_id")
def group_id(q, t):
    """The first group number with a digit."""
    p = r"(?i)\bgroup\s*(?:id|#|number)?\s*[:#-]?\s*([A-Z0-9]{2,})\b"
    first = q.get(q.keep(q.extract_all("text", p, 1), "v", q.like("v", "[0-9]")), 1)
    return f"SELECT doc_id, {first} AS group_id FROM {t.intake} WHERE {first} IS NOT NULL"


@both("fused_split")
def fused_split(q, t):
    """Member and group numbers that were read as one word."""
    p = r"(?i)id:\s*([A-Z0-9]{3,}?)(group:|grp:?)\s*([A-Z0-9]{2,})"
    return f"SELECT doc_id, {q.extract('text', p, 1)} AS member_id, {q.extract('text', p, 3)} AS group_id FROM {t.intake} WHERE {q.like('text', p)}"


@both("detect_secondary_insurance")
def detect_secondary_insurance(q, t):
    """The best later anchor line whose eight-line block names another carrier; else of four lines below an insurance label."""
    member, group = r"(?i)(?:member|subscriber|policy)\s*(?:id|#|number)?[:\s]*([A-Z0-9]{4,})", r"(?i)group\s*(?:id|#|number)?[:\s]*([A-Z0-9]{3,})"
    ahead = lambda n: "concat_ws(chr(10), text, " + ", ".join(f"lead(text, {k}) OVER (PARTITION BY doc_id ORDER BY line)" for k in range(1, n)) + ")"
    rows = f"SELECT doc_id, line, text, {q.like('text', INSURANCE_ANCHOR)} AS anchor, {ahead(8)} AS block, {ahead(4)} AS short FROM {t.lines}"
    anchors = f"SELECT doc_id, line, text, block, short, min(line) OVER (PARTITION BY doc_id) AS first_line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM ({rows}) AS a WHERE anchor"
    later = f"(SELECT * FROM ({anchors}) AS b WHERE i > 1) AS later"
    keep = "doc_id, line, text, block, first_line, i"
    sec = R.carriers(q, later, "block", keep).replace(") AS carriers", ") AS s")
    weak = R.carriers(q, later, "short", "doc_id, line, text, short, i").replace(") AS carriers", ") AS s")
    main = R.carriers(q, t.intake).replace(") AS carriers", ") AS p")
    ids = f"(SELECT doc_id AS idoc, max(value) AS best FROM {member_ids(q, t)} GROUP BY 1) AS ids"
    explicit = q.like("s.text", r"(?i)(other\s+insurance|secondary\s+insurance|\bsecondary\b)")
    m, g = q.extract("s.block", member, 1), q.extract("s.block", group, 1)
    score = f"CASE WHEN {m} IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {g} IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN s.line - s.first_line > 1 THEN CAST(0.25 AS DOUBLE) ELSE 0 END + CASE WHEN {explicit} THEN CAST(1.5 AS DOUBLE) ELSE 0 END"
    accept = f"({explicit} OR ({m} IS NOT NULL AND ids.best IS NOT NULL AND ({g} IS NOT NULL OR {q.like('s.block', '(?i)group')})))"
    strong = f"SELECT p.doc_id, p.carrier AS primary_carrier, s.carrier AS secondary_carrier, s.status, {m} AS member_id, {g} AS group_id, {score} AS score, 0 AS tier, s.i FROM {sec} JOIN {main} ON p.doc_id = s.doc_id LEFT JOIN {ids} ON idoc = s.doc_id WHERE s.carrier IS NOT NULL AND p.carrier IS NOT NULL AND lower(s.carrier) <> lower(p.carrier) AND {accept}"
    m4, g4 = q.extract("s.short", member, 1), q.extract("s.short", group, 1)
    fallback = f"SELECT p.doc_id, p.carrier, s.carrier, s.status, {m4}, {g4}, CAST(0 AS DOUBLE), 1, s.i FROM {weak} JOIN {main} ON p.doc_id = s.doc_id WHERE s.carrier IS NOT NULL AND p.carrier IS NOT NULL AND lower(s.carrier) <> lower(p.carrier) AND {q.like('s.text', r'(?i)^\s*insurance\s*[:\-]')} AND {m4} IS NOT NULL AND {q.like('s.short', r'(?i)group\s*(?:id|#|number)?[:\-]|plan\s*[:\-]')}"
    return f"SELECT doc_id, primary_carrier, secondary_carrier, status, member_id, group_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, i) AS place FROM ({strong} UNION ALL {fallback}) AS u) AS v WHERE place = 1"


@both("detect_dme")
def detect_dme(q, t):
    """The first vendor, the distinct codes, and what is complained of."""
    e = R.equipment(q)
    issues = ", ".join(f"{q.like('text', p)} AS {k}" for k, p in DME_ISSUES)
    return f"SELECT doc_id, upper({q.extract('text', e['vendor'])}) AS vendor, {q.join(q.distinct(q.extract_all('text', e['code'])), ',')} AS codes, {issues} FROM {t.intake} WHERE {q.like('text', e['vendor'])} OR {q.like('text', e['code'])}"


METRICS = {
    "avg_hours": (r"(?i)(\d{1,2}(\.\d+)?)\s*(hrs?|hours?)\s*(per|/)?\s*night", 1), "ahi": (r"(?i)\bAHI\b[^0-9]{0,10}(\d{1,2}(\.\d+)?)", 1), "p90": (r"(?i)90%\s*pressure[^0-9]{0,10}(\d{1,2}(\.\d+)?)", 1),
    "usage_percent": (r"(?i)(\d{2,3})%\s*(of\s*)?(nights|usage)", 1), "pressure_min": (r"(?i)(\d{1,2})\s*[-to]{1,3}\s*(\d{1,2})\s*cm", 1), "pressure_max": (r"(?i)(\d{1,2})\s*[-to]{1,3}\s*(\d{1,2})\s*cm", 2), "pressure_any": (r"(?i)\b(\d{1,2})\s*cm\s*(?:h2o)?\b", 1),
}


@both("compliance_metrics")
def compliance_metrics(q, t):
    columns = ", ".join(f"{q.to_double(q.extract('text', p, g))} AS {k}" for k, (p, g) in METRICS.items())
    some = " OR ".join(q.like("text", p) for k, (p, _) in METRICS.items())
    fixed = "CASE WHEN pressure_min IS NULL THEN pressure_any END AS pressure_fixed"
    named = ", ".join(k for k in METRICS if k != "pressure_any")
    return f"SELECT doc_id, {named}, {fixed} FROM (SELECT doc_id, {columns} FROM {t.intake} WHERE {some}) AS m"


@both("detect_provider")
def detect_provider(q, t):
    name = r"(?:Dr\.?\s*)?([A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+)+)"
    tier = f"CASE WHEN {q.like('text', r'(?i)referring\s*(provider|physician)')} THEN 1 WHEN {q.like('text', r'(?i)ordering\s*(provider|physician)')} THEN 2 WHEN {q.like('text', r'(?i)\bprovider\b|\bdr\.?\b')} THEN 3 END"
    after = q.replace("text", r"^[^:]*:\s*", "")
    return f"""SELECT doc_id, name, credential FROM (SELECT doc_id, {q.replace(q.extract('body', name, 1), r'\s+(MD|DO|NP|PA|RN)$', '')} AS name, {q.extract('body', r'\b(MD|DO|NP|PA|RN)\b')} AS credential, row_number() OVER (PARTITION BY doc_id ORDER BY tier, line) AS place FROM (
      SELECT doc_id, line, {after} AS body, {tier} AS tier FROM {t.lines}) AS a WHERE tier IS NOT NULL AND {q.like('body', name)}) AS b WHERE place = 1"""


@both("provider_npi")
def provider_npi(q, t):
    p = r"(?i)\bnpi\b\s*[:#]?\s*(\d{10})\b"
    return f"SELECT doc_id, {q.extract('text', p, 1)} AS npi FROM {t.held(p)} WHERE {q.like('text', p)}"


@both("provider_practice")
def provider_practice(q, t):
    p = r"(?i)^(?:practice|clinic|facility)\s*[:-]\s*(.+)$"
    return f"SELECT doc_id, practice FROM (SELECT doc_id, {q.extract('text', p, 1)} AS practice, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM {t.lines} WHERE {q.like('text', p)}) AS a WHERE place = 1"


@both("provider_phone_fax")
def provider_phone_fax(q, t):
    """Numbers within four lines of a provider line; fax lines apart."""
    anchors = f"SELECT DISTINCT doc_id, line FROM {t.lines} WHERE {T.is_provider(q, 'text')}"
    numbers = f"SELECT doc_id, line, {q.replace(q.extract('text', PHONE), '[^0-9]', '')} AS digits, {T.is_fax(q, 'text')} AS fax FROM {t.lines} WHERE {q.like('text', PHONE)}"
    return f"SELECT n.doc_id, min(CASE WHEN fax THEN digits END) AS fax, min(CASE WHEN NOT fax THEN digits END) AS phone FROM ({numbers}) AS n WHERE EXISTS (SELECT 1 FROM ({anchors}) AS a WHERE a.doc_id = n.doc_id AND a.line BETWEEN n.line - 4 AND n.line + 4) GROUP BY 1"


@both("phone_reconcile")
def phone_reconcile(q, t):
    """Accepted numbers that no rejected line of the document also gives."""
    return f"SELECT doc_id, digits FROM {phones(q, t)} WHERE reason IS NULL EXCEPT SELECT doc_id, digits FROM {phones(q, t)} WHERE reason IN ('fax', 'provider_context')"


def symptom_hits(q, lines: str) -> tuple[str, str]:
    """All hits of lines by line, status and label, and the order of labels on a line."""
    low = "lower(trim(text))"
    skip = f"{q.like('low', SYMPTOM_SKIP)} OR {q.like('low', SYMPTOM_CONDITIONAL)} OR {q.like('low', SYMPTOM_FAMILY)} OR ({q.like('low', THIRD_PARTY)} AND NOT {q.like('low', r'(patient|pt)' + chr(92) + 'b')})"
    history = f"{q.like('low', SYMPTOM_HISTORY)} AND NOT {q.like('low', SYMPTOM_STILL)}"
    kept = f"SELECT doc_id, line, text, low, {history} AS past, NOT ({history}) AND {q.like('low', SYMPTOM_RESOLVED)} AS gone FROM (SELECT doc_id, line, text, {low} AS low FROM {lines} WHERE trim(text) <> '') AS a WHERE NOT ({skip})"
    any_of = lambda ps: q.like("text", "(?i)(" + "|".join(ps) + ")") if ps else "false"
    found = [f"CASE WHEN NOT past AND NOT gone AND {any_of(pos)} THEN CASE WHEN {any_of(neg)} THEN 'denied:{k}' ELSE 'confirmed:{k}' END WHEN NOT past AND NOT gone AND {any_of(neg)} THEN 'denied:{k}' END" for k, pos, neg in S.SYMPTOMS]
    found += ["CASE WHEN past THEN 'history:line' END", "CASE WHEN gone THEN 'resolution:line' END"]
    found += [f"CASE WHEN NOT past AND NOT gone AND {q.like('text', p)} THEN '{k}:line' END" for k, p in (("medication", SYMPTOM_MEDICATION), ("test", SYMPTOM_TEST))]
    hits = f"SELECT doc_id, line, {q.explode(q.some(*found))} AS hit FROM ({kept}) AS b"
    parted = f"SELECT doc_id, line, {q.replace('hit', ':.*$', '')} AS status, {q.replace('hit', '^[a-z]+:', '')} AS label FROM ({hits}) AS c"
    order = "CASE label " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _, _) in enumerate(S.SYMPTOMS)) + " ELSE 99 END"
    return parted, order


@both("detect_symptoms")
def detect_symptoms(q, t):
    """Each line's labels, confirmed or denied, and the lines that tell of history, resolution, medication or tests; 60 of a document."""
    parted, order = symptom_hits(q, t.lines)
    return f"SELECT doc_id, label, line, status FROM (SELECT doc_id, label, line, status, row_number() OVER (PARTITION BY doc_id, CASE WHEN label = 'line' THEN status ELSE 'symptom' END ORDER BY line, {order}) AS place FROM ({parted}) AS d) AS e WHERE place <= 60"


@both("vitals")
def vitals(q, t):
    s, d = (q.to_int(q.extract("text", r"\b(\d{2,3})/(\d{2,3})\b", g)) for g in (1, 2))
    return f"""SELECT doc_id, bmi, CASE WHEN sys BETWEEN 80 AND 220 AND dia BETWEEN 40 AND 140 THEN concat(sys, '/', dia) END AS bp, weight, height FROM (SELECT doc_id, {q.extract('text', r'(?i)BMI\s*:?\s*(\d{2}(\.\d)?)', 1)} AS bmi, {s} AS sys, {d} AS dia,
      {q.extract('text', r'(?i)(?:weight|wt)\s*:?\s*(\d{2,3})\s*(?:lbs?|pounds?)', 1)} AS weight, {q.extract('text', r"(?i)(?:height|ht)\s*:?\s*(\d'\s*\d{1,2})", 1)} AS height FROM {t.intake}) AS a WHERE bmi IS NOT NULL OR sys IS NOT NULL OR weight IS NOT NULL OR height IS NOT NULL"""


@both("info_alerts")
def info_alerts(q, t):
    tags = {"seizure": r"seizure|epilepsy", "cardiac_device": r"pacemaker|defibrillator|cardiac\s+device", "mobility": r"wheelchair|walker|limited\s+mobility|bedbound", "oxygen": r"oxygen|o2\s+dependent", "hearing_impaired": r"hearing\s+impaired|hard\s+of\s+hearing|deaf", "language_barrier": r"spanish\s+only|interpreter|translation\s+needed", "caretaker": r"caretaker|caregiver|guardian"}
    columns = ", ".join(f"{q.like('lower(text)', p)} AS {k}" for k, p in tags.items())
    ppe = f"CASE WHEN {q.like('lower(text)', r'isolation|airborne|droplet|ppe required|mask required')} THEN true WHEN {q.like('lower(text)', 'no ppe')} THEN false END"
    return f"SELECT doc_id, {ppe} AS ppe_required, {columns} FROM {t.intake}"


def dates(q, t) -> str:
    d = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
    kinds = [("referral", r"(?i)refer(?:ral)?\s*(?:date)?\s*[:-]?\s*" + d), ("order", r"(?i)order(?:ed)?\s*(?:date)?\s*[:-]?\s*" + d), ("service", r"(?i)(?:service|svc)\s*(?:date)?\s*[:-]?\s*" + d), ("study", r"(?i)(?:study|appt|appointment)\s*(?:date|scheduled)?\s*[:-]?\s*" + d)]
    labelled = " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS type, {q.extract('text', p, 1)} AS raw FROM {t.lines} WHERE {q.like('text', p)}" for k, p in kinds)
    loose = f"SELECT doc_id, line, 'unknown' AS type, {q.explode(q.extract_all('text', r'\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'))} AS raw FROM {t.lines}"
    return f"(SELECT doc_id, line, type, raw, {T.iso_date(q, 'raw')} AS iso FROM ({labelled} UNION ALL {loose}) AS a) AS dates"


@both("detect_dates")
def detect_dates(q, t):
    """Labelled dates, and others whose day no labelled one has, each type and day once."""
    return f"""SELECT doc_id, type, iso, line, CASE WHEN type = 'unknown' THEN 'low' ELSE 'high' END AS confidence FROM (SELECT doc_id, type, iso, min(line) AS line, max(CASE WHEN type <> 'unknown' THEN 1 ELSE 0 END) AS x, max(max(CASE WHEN type <> 'unknown' THEN 1 ELSE 0 END)) OVER (PARTITION BY doc_id, iso) AS labelled
      FROM {dates(q, t)} WHERE iso IS NOT NULL GROUP BY doc_id, type, iso) AS b WHERE type <> 'unknown' OR labelled = 0"""


@both("promote_dates")
def promote_dates(q, t):
    pick = ", ".join(f"{q.first_by(f"CASE WHEN type = '{k}' THEN iso END", f"CASE WHEN type = '{k}' THEN line END")} AS {k}_date" for k in ("referral", "order", "study"))
    return f"SELECT doc_id, {pick} FROM {dates(q, t)} WHERE iso IS NOT NULL AND type <> 'unknown' GROUP BY 1"


@both("text_hints")
def text_hints(q, t):
    return f"""SELECT doc_id, {q.extract('text', r'(?i)\bnpi\b\D{0,5}(\d{10})', 1)} AS npi, {q.extract('text', r'\b(9580[56]|9581[01]|9578[23]|G0399)\b')} AS cpt, {q.extract('text', r'\b[A-TV-Z]\d{2}\.\d{1,4}\b')} AS icd, {q.size(q.extract_all('text', PHONE))} AS n_phones FROM {t.intake}"""


@both("highlight_spans")
def highlight_spans(q, t):
    """Lines that hold the document's phone or birth date, three a field at most."""
    values = f"SELECT doc_id, 'phone' AS field, substring(digits, 7, 4) AS v FROM {phones(q, t)} WHERE reason IS NULL UNION ALL SELECT doc_id, 'date', iso FROM {dates(q, t)} WHERE iso IS NOT NULL AND type <> 'unknown'"
    return f"SELECT doc_id, field, line FROM (SELECT DISTINCT l.doc_id, field, l.line, dense_rank() OVER (PARTITION BY l.doc_id, field ORDER BY l.line) AS place FROM {t.lines.replace(' AS lines', ' AS l')} JOIN ({values}) AS v ON v.doc_id = l.doc_id AND {q.contains('l.text', 'v.v')}) AS x WHERE place <= 3"


@both("rule_engine_misc")
def rule_engine_misc(q, t):
    """Credentials of a line, and the kind of page that its words suggest; both from small tables, as the rule files are optional."""
    # Credentials.
    credentials = ["MD", "DO", "NP", "FNP", "PA-?C", "APRN", "ANP", "DC", "RN", "PhD"]
    # End of fixed values.
    found = q.hits("text", [(c.replace("?", ""), rf"\b{c}\b") for c in credentials])
    return f"SELECT doc_id, line, {q.explode(found)} AS credential FROM {t.lines}"
