"""Member ids that a text proposes, merged where they read as one id: the order-dependent part of choosing a member id.

A document's rules, clusters and consensus hang on the order in which ids are found, so each document is one call of plain Python;
texts without an id-like run of letters and digits are left out before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

from ..catalogs import member_ids as M

ASCII = re.ASCII | re.IGNORECASE
ANCHORS = [re.compile(p, re.ASCII) for p in (r"primary\s+insurance|insurance\s*\(ppo\)|insurance\b", r"aetna\b|anthem\b|cigna\b|humana\b|united\b|medicare\b|medicaid\b")]
TOKEN, TOKEN_ANY_CASE = re.compile(r"\b([A-Z]\d{8,10})\b", re.ASCII), re.compile(r"\b([A-Z]\d{8,10})\b", ASCII)
NAMED = re.compile(r"\b(?:ins(?:urance)?|id)\s*(?:no\.?|#|id|number)?\s*[:#-]?\s*([A-Z0-9]{6,})\b", ASCII)
LABELED = [
    ("labeled_primary", 4.5, re.compile(r"\b(?:member\s*(?:id|#|number)?)\s*[:#-]?\s*([A-Z0-9]{3,})\b", ASCII)),
    ("labeled_fallback", 3.5, re.compile(r"\b(?:(?:subscriber|insured|policy(?!\s*holder))\s*(?:id|#|number))\s*[:#-]?\s*([A-Z0-9]{3,})\b", ASCII)),
    ("labeled_id", 8.0, re.compile(r"\b(?:ins(?:urance)?\s*(?:no\.?|#|id|number)?)\s*[:#-]?\s*([A-Z0-9]{3,})\b", ASCII)),
]
#: What a text with an id has beside a run of eight letters and digits: the one shape of a carrier's pattern that has none.
DASHED = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SCHEMA = "doc_id long, value string, score double, n long, source string, label string"
_LINE_START, _LINE_END = r"(?<![^\n\r\u2028\u2029])", r"(?![^\n\r\u2028\u2029])"


def carrier_patterns(carrier: str | None) -> list[re.Pattern]:
    """The patterns of the first listed carrier whose name is in the carrier's or holds it; of whole lines."""
    key = (carrier or "").lower()
    if not key:
        return []
    blue = lambda x: "bcbs" in x or re.search(r"blue\s*cross", x)
    own = key if key in M.ID_PATTERNS else next((k for k in M.ID_PATTERNS if k in key or key in k or ("anthem" in key and "anthem" in k) or (blue(key) and blue(k))), None)
    return [re.compile(_LINE_START + p.removeprefix("^").removesuffix("$") + _LINE_END, ASCII) for p in M.ID_PATTERNS.get(own, ())]


def found(text: str, patterns: list[re.Pattern], words: re.Pattern) -> list[list]:
    """[value, score, hits, first rule] of each id in the order of finding: the carrier's patterns and the first id in the eight lines
    from an insurance word on, labelled ids, id-like tokens by their distance from an insurance word, the carrier's patterns anywhere."""
    entries: dict[str, list] = {}

    def register(raw: str, weight: float, rule: str) -> None:
        value = re.sub("[^A-Za-z0-9]", "", raw).upper()
        if len(value) >= 8 and re.search("[0-9]", value):
            entry = entries.setdefault(value, [value, 0.0, 0, rule])
            entry[1] += weight
            entry[2] += 1

    def by_carrier(part: str, weight: float) -> None:
        hit = next((m for p in patterns if (m := p.search(part))), None)
        if hit:
            register(hit[0], weight, "carrier_pattern")

    lines = re.split(r"\r?\n", text)
    low = [x.lower() for x in lines]
    at = next((i for p in ANCHORS for i, x in enumerate(low) if p.search(x)), None)
    if at is not None:
        window = "\n".join(lines[at : at + 8])
        by_carrier(window, 7.5)
        pick = TOKEN_ANY_CASE.search(window) or NAMED.search(window)
        if pick:
            register(pick[1], 5.0, "primary_window")
    for rule, weight, p in LABELED:
        for m in p.finditer(text):
            register(m[1], weight, rule)
    tokens = list(TOKEN.finditer(text))
    spots = [m.start() for m in words.finditer(text.lower())] if tokens else []
    for m in tokens:
        k = bisect_left(spots, m.start())
        apart = min((abs(m.start() - s) for s in spots[max(0, k - 1) : k + 1]), default=None)
        register(m[1], 1.0 if apart is None else float(max(1, 6 - min(apart, 800) // 120)), "proximity")
    by_carrier(text, 6.0)
    return list(entries.values())


def gapped(long: str, short: str) -> tuple[int, str]:
    """The fewest substitutions, 4 standing for more, between a string and one of a character less, and the latter with its first such gap."""
    fits = ((min(4, sum(x != y for j, (x, y) in enumerate(zip(long, short[:i] + "-" + short[i:], strict=True)) if j != i)), i) for i in range(len(short) + 1))
    least, i = min(fits)
    return least, short[:i] + "-" + short[i:]


def similar(a: str, b: str) -> bool:
    """At most two substitutions, beside a character more in one of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    return abs(len(a) - len(b)) == 1 and gapped(*sorted((a, b), key=len, reverse=True))[0] <= 2


def consensus(group: list[list]) -> str:
    """Of all strings over the characters that the members have at each place of the longest the nearest to all by edit distance: least
    largest distance, then least sum weighted by scores, then first in order.

    A branch of the search ends once its edit distances so far, and what lengths add, can't give a better string."""
    longest = max(len(e[0]) for e in group)
    anchor = max((e for e in group if len(e[0]) == longest), key=lambda e: e[1])[0]
    options = [{c} for c in anchor]
    for value, *_ in group:
        aligned = gapped(anchor, value)[1] if len(value) == longest - 1 else value
        for spots, c in zip(options, aligned):  # a member of two characters less stays where it is
            if c != "-":
                spots.add(c)
    members = [(e[0], e[1] + 1) for e in group]
    best: list[tuple] = []

    def least(rows: list[list[int]], k: int) -> tuple[int, float]:
        far = [min(d + abs((longest - k) - (len(v) - j)) for j, d in enumerate(row)) for row, (v, _) in zip(rows, members, strict=True)]
        return max(far), sum(d * w for d, (_, w) in zip(far, members, strict=True))

    def after(row: list[int], v: str, c: str) -> list[int]:
        out = [row[0] + 1]
        for j, x in enumerate(v):
            out.append(min(row[j] + (x != c), row[j + 1] + 1, out[j] + 1))
        return out

    def search(rows: list[list[int]], chosen: str) -> None:
        k = len(chosen)
        if k == longest:
            whole = (*least(rows, k), chosen)
            if not best or whole < best[0]:
                best[:] = [whole]
            return
        steps = [[after(row, v, c) for row, (v, _) in zip(rows, members, strict=True)] for c in sorted(options[k])]
        branches = sorted(zip(((*least(r, k + 1), c) for r, c in zip(steps, sorted(options[k]), strict=True)), steps, strict=True), key=lambda b: b[0])
        for (top, total, c), r in branches:
            if best and (top, total) > best[0][:2]:
                continue
            search(r, chosen + c)

    search([list(range(len(v) + 1)) for v, _ in members], "")
    return best[0][2]


def merged(entries: list[list]) -> list[list]:
    """Clusters of similar ids, greedily from the best score, of equal ones from the first found; each becomes its consensus, with
    the scores and hits of all and the first rule of its first."""
    left, out = sorted(entries, key=lambda e: -e[1]), {}
    while left:
        head = left[0]
        group = [head, *[e for e in left[1:] if similar(head[0], e[0])]]
        taken = {e[0] for e in group}
        left = [e for e in left if e[0] not in taken]
        value = consensus(group) if len(group) > 1 else head[0]
        out[value] = [value, sum(e[1] for e in group), sum(e[2] for e in group), head[3]]
    return list(out.values())


def merged_batches(words: list[str]):
    """For mapInArrow over doc_id, text and carrier: the rows of SCHEMA. Words may overlap, so they are looked for ahead of each place."""
    near = re.compile("(?=" + "|".join(map(re.escape, words)) + ")")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list[re.Pattern]] = {}
        for b in batches:
            rows = []
            for doc, text, carrier in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "carrier")), strict=True):
                if carrier not in known:
                    known[carrier] = carrier_patterns(carrier)
                rows += [(doc, *e, "") for e in merged(found(text or "", known[carrier], near))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run
