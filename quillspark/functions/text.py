"""Predicates and scalars on lines and values, as SQL expressions for a dialect."""

from __future__ import annotations

import re

from .sqltext import Dialect

# Word lists that decide what a line or a token is.
HEADER_WORDS = [
    "fax", "efax", "referral", "order", "clinic", "medical", "services", "sleep", "home", "information", "summary",
    "patient information", "patient summary", "provider", "insurance", "authorization", "request", "signature", "physician",
    "doctor", "practice", "department", "center", "hospital", "imaging", "lab", "laboratory", "durable", "equipment", "dme",
    "specialty", "pages", "cover sheet", "attention", "attn", "subject", "re:", "from:",
    "preferred language", "language preferred", "reply please", "see please", "please reply", "please see",
    "language of correspondence", "preferred contact", "fax cover", "patient instructions", "patient notes",
    "documentation supporting", "sleep studies", "home sleep", "sleep study", "study sleep", "medical group",
    "medical center", "home care", "care team", "front desk", "forwarding", "forwarded", "referred",
]
NON_PERSON = [
    "fax", "efax", "referral", "order", "orders", "summary", "information", "info", "patient", "provider", "practice", "clinic",
    "medical", "medicine", "services", "service", "sleep", "home", "unknown", "report", "reports", "signature", "signed",
    "physician", "doctor", "md", "do", "pa", "np", "rn", "llc", "inc", "corp", "company", "group", "center", "centre",
    "hospital", "imaging", "lab", "laboratory", "department", "specialty", "care", "health", "insurance", "authorization",
    "auth", "request", "requests", "from", "to", "re", "attention", "attn", "unit", "units", "npi", "id", "member", "policy",
    "patientinformation", "patientinfo",
]
ADDRESS_STOP = [
    "road", "rd", "street", "st", "suite", "ste", "ave", "avenue", "blvd", "drive", "dr", "court", "ct", "lane", "ln",
    "circle", "cir", "parkway", "pkwy", "apt", "apartment", "unit", "floor", "fl", "highway", "hwy", "way", "terrace", "ter",
    "place", "pl", "north", "south", "east", "west", "n", "s", "e", "w", "city", "state", "zip", "address", "phone", "fax",
]
PLACEHOLDERS = ["—", "–", "-", "N/A", "n/a", "NA", "na", "pending", "PENDING", "unknown", "UNKNOWN", "TBD", "tbd", "...", "null", "NULL", "None", "none"]
COVER = r"^(fax|cover\s*sheet)\b|(confidential|unauthorized|disclosure|recipient|destroy)"
DEMOGRAPHICS = r"^(facesheet|face\s*sheet|demographics)\b"
PROVIDER = r"(ordering\s*(provider|physician)|referring\s*(provider|physician)|\bnpi\b|provider\s*name)"
PROVIDER_LINE = r"(?i)(ordering\s*(provider|physician)|referring\s*(provider|physician)|attending\s*(provider|physician)|\bprovider\b|\bprovder\b|\bphysician\b|\bnpi\b|\bdr\.?\b|from\s+provider|from\s+provder|from\s+company|from\s+facility)"
FAX_LINE = r"(?i)(\b(fax|fx|facsimile)\b|\bf[ao0@][xk]([^a-z]|$))"
PATIENT = r"(patient\b|pt\b|patient\s*(information|contact|phone))"
TOLL_FREE = ["800", "822", "833", "844", "855", "866", "877", "888", "900"]
# End of fixed values.

STRICT = "(" + "|".join(map(re.escape, HEADER_WORDS)).replace(r"\ ", " ") + ")"


NON_PERSONS = "(" + "|".join(NON_PERSON) + ")"


def normalized(q: Dialect, x: str) -> str:
    """Page text: hard spaces as spaces, runs of blanks as one, trimmed."""
    blank = q.replace(q.replace(f"coalesce({x}, '')", " ", " "), r"[ \t]+", " ")
    return q.replace(blank, r"^[ \t\r\n]+|[ \t\r\n]+$" if q.name == "duckdb" else r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def tag_section(q: Dialect, line: str) -> str:
    low = f"trim(lower({line}))"
    return f"CASE WHEN {low} = '' THEN NULL WHEN {q.like(low, COVER)} THEN 'cover' WHEN {q.like(low, DEMOGRAPHICS)} THEN 'demographics' WHEN {q.like(low, PROVIDER)} THEN 'provider' END"


def is_header(q: Dialect, line: str) -> str:
    return q.like(f"lower({line})", STRICT)


def is_non_patient(q: Dialect, line: str) -> str:
    return q.like(f"lower({line})", NON_PERSONS)


def is_provider(q: Dialect, line: str, literal: bool = False) -> str:
    """Provider-like lines. literal: as the reference's escaping leaves it, which matches nothing that occurs in text."""
    return "false" if literal else q.like(line, PROVIDER_LINE)


def is_fax(q: Dialect, line: str, literal: bool = False) -> str:
    return "false" if literal else q.like(line, FAX_LINE)


def is_from(q: Dialect, line: str) -> str:
    return q.like(line, r"(?i)^\s*from\b")


def is_patient(q: Dialect, line: str) -> str:
    return q.like(f"lower({line})", PATIENT)


def context_score(q: Dialect, line: str) -> str:
    one = lambda c: f"CAST({c} AS INT)"
    return f"({one(is_header(q, line))} * 2 + {one(is_provider(q, line))} * 2 + {one(is_fax(q, line))} + {one(is_non_patient(q, line))} - {one(is_patient(q, line))})"


def strip_address_tail(q: Dialect, x: str) -> str:
    """What stands before the first stop word, trimmed; all if there is none."""
    places = ", ".join(f"nullif({q.position(f'lower({x})', q.text(w))}, 0)" for w in ADDRESS_STOP)
    return f"CASE WHEN least({places}) IS NULL THEN {x} ELSE trim(substring({x}, 1, CAST(least({places}) AS INT) - 1)) END"


def plausible_name(q: Dialect, x: str) -> str:
    letters = q.replace(f"coalesce({x}, '')", r"[^\p{L}]", "")
    listed = ", ".join(q.text(w) for w in NON_PERSON)
    return f"(length({letters}) >= 2 AND (length({letters}) <= 2 OR (lower({letters}) NOT IN ({listed}) AND {q.like(f'lower({letters})', '[aeiouy]')})))"


def likely_not_member_id(q: Dialect, x: str) -> str:
    shapes = r"^(\d{2}/\d{2}/\d{4}|(19|20)\d{6}|\d{10}|\(\d{3}\)\s*\d{3}-?\d{4}|\d{5}(-\d{4})?|\d{3}-\d{2}-\d{4}|\d{9}|17027102839)$"
    return f"({x} IS NULL OR length({x}) NOT BETWEEN 6 AND 20 OR {q.like(x, shapes)})"


def valid_nanp(q: Dialect, digits: str, strict: bool = True) -> str:
    """Ten digits of a dialable number; strict: not toll-free."""
    shape = q.like(digits, r"^[2-9]\d{2}[2-9]\d{6}$")
    return f"({shape} AND substring({digits}, 1, 3) NOT IN ({', '.join(map(q.text, TOLL_FREE))}))" if strict else shape


def is_placeholder(q: Dialect, x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '' OR trim({x}) IN ({', '.join(map(q.text, PLACEHOLDERS))}))"


def icd_normalized(q: Dialect, x: str) -> str:
    bare = q.replace(f"upper(trim({x}))", r"[\s-]+", "")
    return f"CASE WHEN {q.like(bare, r'^[A-TV-Z]\d{4,6}$')} THEN concat(substring({bare}, 1, 3), '.', substring({bare}, 4, 10)) ELSE {bare} END"


def key_normalized(q: Dialect, x: str) -> str:
    return q.replace(f"lower({x})", "[^a-z0-9]", "")


def snake_case(q: Dialect, x: str) -> str:
    return q.replace(q.replace(f"lower(trim({x}))", "[^a-z0-9]+", "_"), "^_+|_+$", "")


def title_case(q: Dialect, x: str) -> str:
    """Lower case, with capitals after the start, a blank, a quote or a hyphen."""
    if q.name == "spark":
        return f"array_join(transform(split({q.lower(f'trim({x})')}, {q.pattern(r"(?<=[\s'-])")}), w -> concat({q.upper('substring(w, 1, 1)')}, substring(w, 2))), '')"
    pieces = rf"regexp_extract_all(lower(trim({x})), '[^\s''-]*[\s''-]?')"
    return f"array_to_string(list_transform({pieces}, lambda w: concat(upper(w[1:1]), w[2:])), '')"


def similarity(q: Dialect, a: str, b: str) -> str:
    """1 - distance / longer length of lower-case texts; 1 for two empty ones."""
    longer = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {longer} = 0 THEN 1.0D ELSE 1.0D - levenshtein(lower({a}), lower({b})) / CAST({longer} AS DOUBLE) END".replace("1.0D", "CAST(1 AS DOUBLE)")


def iso_date(q: Dialect, x: str) -> str:
    """m/d/y or m-d-y as yyyy-mm-dd; two-digit years from 70 are of the last century; days up to 31 in any month; else null."""
    part = lambda i: f"CAST({q.extract(x, r'^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$', i)} AS INT)"
    same = f"(({q.like(x, r'^\d+/\d+/\d+$')}) OR ({q.like(x, r'^\d+-\d+-\d+$')}))"
    y = f"CASE WHEN {q.like(x, r'[/-]\d{2}$')} THEN {part(3)} + CASE WHEN {part(3)} >= 70 THEN 1900 ELSE 2000 END ELSE {part(3)} END"
    ok = f"{same} AND {part(1)} BETWEEN 1 AND 12 AND {part(2)} BETWEEN 1 AND 31 AND ({y}) > 1900 AND ({y}) < 2100"
    pad = lambda e, n: f"lpad(CAST({e} AS {'STRING' if q.name == 'spark' else 'VARCHAR'}), {n}, '0')"
    return f"CASE WHEN {ok} THEN concat({pad(y, 4)}, '-', {pad(part(1), 2)}, '-', {pad(part(2), 2)}) END"


def redacted(q: Dialect, x: str) -> str:
    """Masks in this order: SSN, birth date, phone, e-mail, member id."""
    for p, name in (
        (r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
        (r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4}\b", "DOB"),
        (r"\b\d{3}[-.)]\s*\d{3}[-.\s]\d{4}\b", "PHONE"),
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"),
        (r"\b([A-Z]\d{8,10})\b", "MEMBERIDPATTERN"),
    ):
        x = q.replace(x, p, f"[{name}_REDACTED]")
    return x
