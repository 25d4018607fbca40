"""The joins: equality, catalog, tiered, fuzzy, nearest in time, interval and full outer."""

from __future__ import annotations

from ..catalogs import bcbs as B
from ..catalogs import carriers as C
from ..catalogs import payers as P
from ..functions import text as T
from . import q_result as R
from .both import both
from .q_detect import member_ids

#: Names as a reader of scans may give them, for lookups that must stand misreading.
READ_NAMES = ["Aetna", "Aetha", "aetna medicare", "Humanna", "Cigna PPO", "United Heathcare", "united health group", "Tricare East", "Unlisted", "west valley", "Medicar", "Blue Cros/Blue Shield", "BCBS TX", "Premera BCBS of Washington"]
#: An alpha-prefix table of the same columns as a production one.
PREFIXES = [("ABC", "BCBS NV (Anthem)"), ("A11", "BCBS TX"), ("W12", "Horizon BCBS NJ"), ("C22", "BCBS IL")]


@both("join_preauth")
def join_preauth(q, t):
    rules = q.values("preauth", "who, code, action, note", [(c.lower(), p, a, n) for c, p, a, n in C.PREAUTH])
    return f"SELECT carriers.doc_id, carrier, cpt, action, note FROM {R.main_carriers(q, t)} JOIN {R.cpt(q, t)} ON carriers.doc_id = procedures.doc_id JOIN {rules} ON who = lower(carrier) AND code = cpt"


@both("join_regex_catalog")
def join_regex_catalog(q, t):
    """Every carrier of the catalog that a text names."""
    found = q.hits("text", [(n, "(?i)(?:" + ")|(?:".join(ps) + ")") for n, _, ps in C.CARRIERS])
    return f"SELECT doc_id, {q.explode(found)} AS name FROM {t.intake}"


def payer_of(q, names: str) -> str:
    """Of each carrier of names its route: exact, then either within the other, then most shared words; the first of a tier."""
    words = lambda x: q.keep(q.split(x, r"\s+"), "w", "length(w) > 2")
    shared = f"size(array_intersect({words('low')}, {words('key')}))" if q.name == "spark" else f"CAST(len(list_intersect({words('low')}, {words('key')})) AS INTEGER)"
    tier = f"CASE WHEN low = key THEN 1 WHEN {q.contains('low', 'key')} OR {q.contains('key', 'low')} THEN 2 WHEN {shared} > 0 THEN 3 END"
    routes = q.values("routes", "ord, key, payer", [(i, k, p) for i, (k, p) in enumerate(P.ROUTES)])
    tried = f"SELECT carrier, payer, ord, key, {tier} AS tier, CASE WHEN low <> key THEN {shared} ELSE 0 END AS overlap FROM (SELECT DISTINCT carrier, lower(trim(carrier)) AS low FROM {names}) AS named CROSS JOIN {routes}"
    return f"(SELECT carrier, payer, tier, key AS matched FROM (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY tier, CASE WHEN tier = 3 THEN -overlap ELSE 0 END, ord) AS place FROM ({tried}) AS a WHERE tier IS NOT NULL) AS b WHERE place = 1) AS payer_of"


def listed_names(q) -> str:
    return q.values("listed", "carrier", [(n,) for n in dict.fromkeys([n for n, _, _ in C.CARRIERS] + READ_NAMES)])


@both("join_payer_resolve")
def join_payer_resolve(q, t):
    return f"SELECT carrier, payer, tier, matched FROM {payer_of(q, listed_names(q))}"


def id_payer(q, x: str) -> str:
    """The payer of the first pattern that a member id has."""
    return "CASE " + " ".join(f"WHEN {q.like(x, p)} THEN {q.text(payer)}" for _, p, payer, _ in P.ID_ROUTES) + " END"


@both("join_payer_by_id")
def join_payer_by_id(q, t):
    return f"SELECT doc_id, value, {id_payer(q, 'value')} AS payer FROM {member_ids(q, t)}"


def allowables(q, wanted: str) -> str:
    """wanted (payer, cpt) with the first entry of the rates that names the payer, and its rate, null where the entry lacks the code."""
    flat = lambda x: " ".join(x.lower().replace("_", " ").replace("-", " ").split())
    entries = q.values("entries", "ord, entry, key, alias", [(i, n, flat(n), flat(a) if a else None) for i, (n, aliases, _) in enumerate(P.RATES) for a in (aliases or (None,))])
    rates = q.values("rates", "entry, code, rate", [(n, c, r) for n, _, rs in P.RATES for c, r in rs])
    p = q.replace("lower(payer)", r"[\s_-]+", " ")
    hit = f"key = p OR {q.contains('key', 'p')} OR {q.contains('p', 'key')} OR coalesce(alias = p OR {q.contains('alias', 'p')}, false)"
    first = f"SELECT payer, {q.first_by('entry', 'ord')} AS entry FROM (SELECT DISTINCT payer, {p} AS p FROM {wanted}) AS w JOIN {entries} ON {hit} GROUP BY 1"
    return f"(SELECT wanted.payer, wanted.cpt, f.entry, CAST(rate AS DOUBLE) AS rate FROM {wanted} LEFT JOIN ({first}) AS f ON f.payer = wanted.payer LEFT JOIN {rates} ON rates.entry = f.entry AND rates.code = wanted.cpt) AS allowables"


@both("join_allowable")
def join_allowable(q, t):
    payers, codes = sorted({p for _, p in P.ROUTES}), sorted({c for _, _, rs in P.RATES for c, _ in rs})
    return f"SELECT payer, cpt, entry, rate FROM {allowables(q, q.values('wanted', 'payer, cpt', [(p, c) for p in payers for c in codes]))}"


@both("join_payer_coverage")
def join_payer_coverage(q, t):
    """Returned pairs of supplier and part, and whether a sale that was kept covers the pair."""
    line = t.lineitem
    return f"SELECT r.l_suppkey, r.l_partkey, c.quantity IS NOT NULL AS covered, c.quantity FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {line} WHERE l_returnflag = 'R') AS r LEFT JOIN (SELECT l_suppkey, l_partkey, max(l_quantity) AS quantity FROM {line} WHERE l_returnflag <> 'R' GROUP BY 1, 2) AS c ON c.l_suppkey = r.l_suppkey AND c.l_partkey = r.l_partkey"


@both("join_bcbs_prefix")
def join_bcbs_prefix(q, t):
    """Member ids with the affiliate of their three-character prefix."""
    return f"SELECT doc_id, value, p, affiliate FROM (SELECT doc_id, value, {q.extract('value', '^[A-Z][A-Z0-9]{2}')} AS p FROM {member_ids(q, t)}) AS m LEFT JOIN {q.values('prefixes', 'prefix, affiliate', PREFIXES)} ON prefix = p"


def affiliate(q, x: str) -> str:
    """The first affiliate whose key or name a carrier's name holds."""
    return "CASE " + " ".join(f"WHEN {q.contains(f'lower({x})', q.text(k.replace('_', ' ')))} OR {q.contains(f'lower({x})', q.text(n.lower()))} THEN {q.text(k)}" for k, n in B.AFFILIATES) + " END"


@both("join_affiliate")
def join_affiliate(q, t):
    return f"SELECT carrier, {affiliate(q, 'carrier')} AS affiliate FROM {listed_names(q)}"


@both("join_fuzzy_correction")
def join_fuzzy_correction(q, t):
    """Each name as read with the most similar of the catalog, from 0.8; the catalog is bounded, so each name meets all of it."""
    sim = T.similarity(q, "name", "carrier")
    table = q.values("catalog", "ord, carrier", [(i, n) for i, (n, _, _) in enumerate(C.CARRIERS)])
    return f"SELECT name, carrier, sim FROM (SELECT name, carrier, sim, row_number() OVER (PARTITION BY name ORDER BY sim DESC, ord) AS place FROM (SELECT name, carrier, ord, {sim} AS sim FROM {q.values('seen', 'name', [(n,) for n in READ_NAMES])} CROSS JOIN {table}) AS a) AS b WHERE place = 1 AND sim >= 0.8"


#: Names to look up in a registry, as read.
WANTED = ["Suplier#000000001", "Supplier#00000002", "Supplier #000000003", "Suppl1er#000000004", "supplier#000000005", "Customer#000000001", "nobody"]


@both("join_npi_fuzzy")
def join_npi_fuzzy(q, t):
    """A stated set of names against the whole registry: for each the most similar entry, from 0.7. Grouped with combination."""
    sim = T.similarity(q, "wanted", "s_name")
    tried = f"SELECT wanted, s_suppkey, {sim} AS sim FROM {t.supplier} CROSS JOIN {q.values('wanted_names', 'wanted', [(n,) for n in WANTED])}"
    best = f"SELECT wanted AS w, max(sim) AS top FROM ({tried}) AS a GROUP BY 1"
    return f"SELECT wanted, min(s_suppkey) AS s_suppkey, sim FROM ({tried}) AS b JOIN ({best}) AS c ON w = wanted AND sim = top WHERE sim >= 0.7 GROUP BY wanted, sim"


@both("src_npi")
def src_npi(q, t):
    """A registry's entries by number: the providers of the texts that a table of numbers knows."""
    npi = q.extract("text", r"(?i)\bnpi\b\s*[:#]?\s*(\d{10})\b", 1)
    registry = q.values("registry", "number, name, taxonomy", [("1234567893", "Alice Carter", "Sleep Medicine"), ("1111111112", "Bob Stone", "Family Medicine")])
    return f"SELECT doc_id, npi, name, taxonomy FROM (SELECT doc_id, {npi} AS npi FROM {t.intake}) AS a JOIN {registry} ON number = npi"


def nearest(q, t, seconds: int, either: bool) -> str:
    """For each purchase the nearest signup within so many seconds, before it or on either side, by buckets of that width."""
    ms = q.millis("ts")
    a = f"SELECT event_id, ms, CAST(floor(ms / {seconds * 1000}.0) AS BIGINT) AS bucket FROM (SELECT event_id, {ms} AS ms FROM {t.events} WHERE event_type = 'purchase') AS p"
    b = " UNION ALL ".join(f"SELECT event_id AS other, ms AS oms, CAST(floor(ms / {seconds * 1000}.0) AS BIGINT) + {k} AS obucket FROM (SELECT event_id, {ms} AS ms FROM {t.events} WHERE event_type = 'signup') AS s" for k in (-1, 0, 1))
    near = f"abs(ms - oms) <= {seconds * 1000}" if either else f"ms - oms BETWEEN 0 AND {seconds * 1000}"
    return f"SELECT event_id, other, gap FROM (SELECT event_id, other, abs(ms - oms) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(ms - oms), other) AS place FROM ({a}) AS x JOIN ({b}) AS y ON bucket = obucket AND {near}) AS z WHERE place = 1"


@both("join_asof_summary")
def join_asof_summary(q, t):
    return nearest(q, t, 60, True)


@both("join_asof_hash")
def join_asof_hash(q, t):
    return nearest(q, t, 120, True)


@both("join_hash_original")
def join_hash_original(q, t):
    """Documents of equal text: each with the first of them."""
    h = q.sha256("coalesce(text, '')")
    return f"SELECT d.doc_id, first_id FROM (SELECT doc_id, {h} AS h FROM {t.documents}) AS d JOIN (SELECT {h} AS h, min(doc_id) AS first_id FROM {t.documents} GROUP BY 1) AS f ON d.h = f.h"


@both("join_table_cell")
def join_table_cell(q, t):
    """The cell to the right: the next line number of the same order."""
    line = t.lineitem.replace(" AS lineitem", "")
    return f"SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS next_quantity FROM {line} AS a JOIN {line} AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"


@both("join_line_window")
def join_line_window(q, t):
    return f"SELECT doc_id, line, before, after FROM (SELECT doc_id, line, section, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM {t.lines}) AS a WHERE section = 'provider'"


@both("join_provider_distance")
def join_provider_distance(q, t):
    anchors = f"SELECT doc_id, line FROM {t.lines} WHERE {T.is_provider(q, 'text')}"
    return f"SELECT l.doc_id, l.line FROM {t.lines.replace(' AS lines', ' AS l')} WHERE EXISTS (SELECT 1 FROM ({anchors}) AS a WHERE a.doc_id = l.doc_id AND abs(a.line - l.line) <= 4)"


@both("join_full_outer_paths")
def join_full_outer_paths(q, t):
    """Leaf paths of two documents: customers and suppliers by key, name and nation compared."""
    leaves = lambda table, key, name, nation: f"SELECT {key} AS id, 'name' AS path, {q.replace(name, '[^0-9]', '')} AS v FROM {table} UNION ALL SELECT {key}, 'nation', concat('n', {nation}) FROM {table}"
    return f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, CASE WHEN a.v IS NULL AND b.v IS NULL THEN 'both_empty' WHEN a.v = b.v THEN 'exact' WHEN a.v IS NULL THEN 'llm_only' WHEN b.v IS NULL THEN 'ocr_only' ELSE 'conflict' END AS kind
      FROM ({leaves(t.customer, 'c_custkey', 'c_name', 'c_nationkey')}) AS a FULL OUTER JOIN ({leaves(t.supplier, 's_suppkey', 's_name', 's_nationkey')}) AS b ON a.id = b.id AND a.path = b.path"""


@both("join_semi_anti")
def join_semi_anti(q, t):
    return f"SELECT c_custkey, 'with' AS kind FROM {t.customer} WHERE EXISTS (SELECT 1 FROM {t.orders} WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'without' FROM {t.customer} WHERE NOT EXISTS (SELECT 1 FROM {t.orders} WHERE o_custkey = c_custkey)"
