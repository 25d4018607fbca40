"""Aggregations, windows, rankings and set operations of the reports, over the driver's tables.

Orders stand for intake results (status, priority as action), events for logged feedback and latency samples, lineitem for
extracted fields and conversations for pages with a role.
"""

from __future__ import annotations

from .both import both

DAY = "CAST(o_orderdate AS DATE)"


def count_if(c: str) -> str:
    return f"count(CASE WHEN {c} THEN 1 END)"


@both("agg_batch_dates")
def agg_batch_dates(q, t):
    return f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS intake_date FROM {t.orders}"


@both("agg_actions")
def agg_actions(q, t):
    """Actions by count; of equal counts the first seen comes first."""
    return f"SELECT action, n, row_number() OVER (ORDER BY n DESC, first_seen) AS place FROM (SELECT o_orderpriority AS action, count(*) AS n, min(o_orderkey) AS first_seen FROM {t.orders} GROUP BY 1) AS a"


@both("agg_cover")
def agg_cover(q, t):
    forms = {"insurance_verification": "1-URGENT", "authorization_requests": "2-HIGH", "uts_referrals": "3-MEDIUM", "provider_follow_ups": "4-NOT SPECIFIED", "patient_contacts": "5-LOW"}
    counted = ", ".join(f"{count_if(f'o_orderpriority = {q.text(v)}')} AS {k}" for k, v in forms.items())
    return f"""SELECT {DAY} AS intake_date, count(*) AS processed, {count_if("o_orderstatus = 'F'")} AS done, {count_if("o_orderstatus = 'P'")} AS errors,
      {count_if("o_orderstatus NOT IN ('F', 'P')")} AS inprogress, {count_if("o_totalprice > 200000")} AS manual,
      {count_if("o_totalprice <= 200000 AND o_orderpriority = '5-LOW'")} AS ready, {count_if("NOT (o_totalprice <= 200000 AND o_orderpriority = '5-LOW')")} AS additional, {counted}
      FROM {t.orders} GROUP BY 1"""


@both("agg_problem_log")
def agg_problem_log(q, t):
    return f"SELECT o_orderkey AS id, {DAY} AS intake_date, coalesce(c_name, 'Unknown') AS name, o_orderpriority AS action FROM {t.orders} LEFT JOIN {t.customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000 OR o_orderpriority = '1-URGENT'"


@both("agg_checklist")
def agg_checklist(q, t):
    """Totals over all, items after the filters, newest first, 1000 at most."""
    return f"""SELECT o_orderkey AS id, category, total FROM (
      SELECT o_orderkey, o_orderdate, CASE WHEN o_totalprice > 250000 THEN 'manual' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'additional' ELSE 'ready' END AS category,
        count(*) OVER (PARTITION BY o_orderstatus) AS total, o_orderstatus FROM {t.orders}) AS a
      WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000"""


@both("agg_batch_data")
def agg_batch_data(q, t):
    return f"""SELECT o_orderpriority AS batch, count(*) AS documents, {count_if("o_orderstatus = 'P'")} AS problems, floor(avg(o_totalprice) * 10 + 0.5) / 10 AS average,
      floor(CAST({count_if("o_orderstatus = 'F'")} AS DOUBLE) / count(*) * 1000 + 0.5) / 10 AS success_percent FROM {t.orders} GROUP BY 1"""


@both("agg_validation5")
def agg_validation5(q, t):
    """Of each segment's customers how many have a name, a balance, a nation and an order."""
    return f"""SELECT c_mktsegment, {count_if("c_name IS NOT NULL AND c_name <> ''")} AS has_name, {count_if("c_acctbal IS NOT NULL")} AS has_balance, {count_if("c_nationkey IS NOT NULL")} AS has_nation,
      count(o_custkey) AS has_order, count(*) AS n FROM {t.customer} LEFT JOIN (SELECT DISTINCT o_custkey FROM {t.orders}) AS o ON o_custkey = c_custkey GROUP BY 1"""


@both("agg_latency_pct")
def agg_latency_pct(q, t):
    """Percentiles at index floor(p * (n - 1)) of the sorted samples, from counts by value: few types, but many values."""
    counted = f"SELECT event_type, value, count(*) AS c FROM {t.events} WHERE value IS NOT NULL GROUP BY 1, 2"
    placed = f"SELECT event_type, value, sum(c) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY event_type) AS n FROM ({counted}) AS v"
    pick = lambda p: f"min(CASE WHEN upto > CAST(floor({p} * (n - 1)) AS BIGINT) THEN value END)"
    return f"SELECT event_type, CAST(max(n) AS BIGINT) AS n, {pick(0.5)} AS p50, {pick(0.9)} AS p90, {pick(0.95)} AS p95, max(value) AS max_value FROM ({placed}) AS a GROUP BY 1"


def edges20(q, t) -> tuple[str, str]:
    """The first and the last 20 samples of each type. Each is a limit by group, which is taken before the shuffle too."""
    one = lambda order: f"SELECT event_id, event_type, value FROM (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {order}) AS place FROM {t.events}) AS x WHERE place <= 20"
    return one("ts, event_id"), one("ts DESC, event_id DESC")


@both("agg_conf_drift")
def agg_conf_drift(q, t):
    """Mean of the first against the last 20 samples of ten or more; alert beyond a tenth."""
    first, last = edges20(q, t)
    mean = lambda x, c: f"SELECT event_type, avg(value) AS {c} FROM ({x}) AS e GROUP BY 1"
    counted = f"SELECT event_type, count(value) AS n FROM {t.events} GROUP BY 1"
    return f"""SELECT c.event_type, n, base, recent, CASE WHEN base <> 0 THEN (recent - base) / base ELSE 0 END AS pct, CASE WHEN base <> 0 THEN abs((recent - base) / base) > 0.10 ELSE false END AS alert
      FROM ({counted}) AS c JOIN ({mean(first, 'base')}) AS f ON f.event_type = c.event_type JOIN ({mean(last, 'recent')}) AS l ON l.event_type = c.event_type WHERE n >= 10"""


@both("win_first_last20")
def win_first_last20(q, t):
    first, last = edges20(q, t)
    return f"SELECT coalesce(f.event_id, l.event_id) AS event_id, coalesce(f.event_type, l.event_type) AS event_type, f.event_id IS NOT NULL AS baseline, l.event_id IS NOT NULL AS recent FROM ({first}) AS f FULL OUTER JOIN ({last}) AS l ON l.event_id = f.event_id"


@both("agg_counters")
def agg_counters(q, t):
    return f"""SELECT event_type, count(*) AS n, {count_if('value < 1')} AS under_1s, {count_if('value >= 1 AND value < 5')} AS under_5s, {count_if('value >= 5 AND value < 15')} AS under_15s, {count_if('value >= 15')} AS over_15s FROM {t.events} GROUP BY 1"""


@both("agg_feedback_stats")
def agg_feedback_stats(q, t):
    """Acceptance by type: events with a high value are accepted, with a low one rejected, others undecided."""
    return f"""SELECT event_type AS path, count(*) AS n, {count_if('value > 60')} AS accepted, {count_if('value > 60 OR value < 30')} AS decided,
      CASE WHEN {count_if('value > 60 OR value < 30')} > 0 THEN CAST({count_if('value > 60')} AS DOUBLE) / {count_if('value > 60 OR value < 30')} ELSE 0 END AS acceptance_rate FROM {t.events} GROUP BY 1"""


@both("topk_suggestions")
def topk_suggestions(q, t):
    k = q.json_int("props", "k")
    return f"""SELECT path, value_of, n FROM (SELECT event_type AS path, {k} AS value_of, count(*) AS n, min(event_id) AS first_seen FROM {t.events} WHERE value > 60 GROUP BY 1, 2) AS a ORDER BY n DESC, first_seen LIMIT 5"""


@both("topk_actions")
def topk_actions(q, t):
    return f"SELECT action, n FROM (SELECT l_returnflag AS action, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM {t.lineitem} GROUP BY 1) AS a ORDER BY n DESC, first_seen LIMIT 5"


@both("topk_conditions")
def topk_conditions(q, t):
    return f"""SELECT part, n, floor(CAST(n AS DOUBLE) / total * 1000 + 0.5) / 10 AS percent FROM (SELECT l_partkey AS part, count(*) AS n, sum(count(*)) OVER () AS total, min(l_orderkey) AS first_seen FROM {t.lineitem} GROUP BY 1) AS a ORDER BY n DESC, first_seen, part LIMIT 10"""


@both("topk_paths")
def topk_paths(q, t):
    return f"SELECT user_id, n FROM (SELECT user_id, count(*) AS n, min(event_id) AS first_seen FROM {t.events} GROUP BY 1) AS a ORDER BY n DESC, first_seen LIMIT 5"


@both("limit_list")
def limit_list(q, t):
    return f"SELECT o_orderkey AS id, o_orderdate AS processed_at FROM {t.orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500"


def ranked(rows: str, keys: list[str], buckets: list[str], descending: bool = False) -> str:
    """rows with their place in the order of keys. buckets: expressions in the same order, few of whose rows are alike.

    Rows are numbered within their bucket, and the rows of earlier buckets are added: only the table of buckets meets in a task.
    """
    way = " DESC" if descending else ""
    named = ", ".join(f"{e} AS b{i}" for i, e in enumerate(buckets))
    of = ", ".join(f"b{i}" for i in range(len(buckets)))
    counts = f"SELECT {of}, sum(c) OVER (ORDER BY {', '.join(f'b{i}{way}' for i in range(len(buckets)))} ROWS UNBOUNDED PRECEDING) - c AS earlier FROM (SELECT {of}, count(*) AS c FROM (SELECT {named} FROM ({rows}) AS r0) AS r1 GROUP BY {of}) AS r2"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {of} ORDER BY {', '.join(k + way for k in keys)}) AS own FROM (SELECT *, {named} FROM ({rows}) AS r3) AS r4"
    match = " AND ".join(f"n.b{i} = e.b{i}" for i in range(len(buckets)))
    return f"(SELECT n.*, CAST(own + earlier AS BIGINT) AS place FROM ({numbered}) AS n JOIN ({counts}) AS e ON {match}) AS ranked"


@both("sort_severity")
def sort_severity(q, t):
    rows = f"SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INT) AS severity FROM {t.orders}"
    return f"SELECT o_orderkey AS id, severity, place FROM {ranked(rows, ['severity', 'o_orderkey'], ['severity', 'CAST(floor(o_orderkey / 65536.0) AS BIGINT)'])}"


@both("sort_string_lc")
def sort_string_lc(q, t):
    rows = f"SELECT p_partkey, p_name, lower(p_name) AS low FROM {t.part}"
    return f"SELECT p_partkey, place FROM {ranked(rows, ['low', 'p_name', 'p_partkey'], ['substring(low, 1, 4)'])}"


@both("argmax")
def argmax(q, t):
    """pick_best: score with section and page priors, then ties by section, score, later page, upper line; below 0 none."""
    boost = "CASE section WHEN 'demographics' THEN 10 WHEN 'provider' THEN -2 WHEN 'cover' THEN -6 ELSE 0 END"
    return f"""SELECT doc_id, line, text, fused FROM (SELECT doc_id, line, text, fused, row_number() OVER (PARTITION BY doc_id ORDER BY fused DESC, boost DESC, score DESC, page DESC, line) AS place FROM (
      SELECT doc_id, page, line, text, score, {boost} AS boost, score + {boost} + least(CAST(3 AS DOUBLE), 0.25 * (page - 1)) AS fused FROM (
        SELECT doc_id, page, line, text, section, CASE WHEN 20 - line > 0 THEN 20 - line ELSE 0 END AS score FROM {t.lines}) AS a) AS b) AS c WHERE place = 1 AND fused >= 0"""


@both("agg_analytics")
def agg_analytics(q, t):
    return f"""SELECT count(*) AS documents, CAST({count_if('quality = 0')} AS DOUBLE) / count(*) AS manual_correction_rate, CAST({count_if('toxic = 1')} AS DOUBLE) / count(*) AS ambiguous_rate FROM {t.labels}"""


@both("agg_ambiguous_rate")
def agg_ambiguous_rate(q, t):
    return f"SELECT avg(CASE WHEN n > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS rate FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM {t.lineitem} GROUP BY 1) AS a"


@both("agg_calibration")
def agg_calibration(q, t):
    s = "l_quantity / 10"
    tier = f"CASE WHEN {s} >= 4 THEN 'High' WHEN {s} >= 2.5 THEN 'Medium' ELSE 'Low' END"
    return f"""SELECT {tier} AS tier, floor({s} * 2 + 0.5) / 2 AS bucket, count(*) AS n, min({s}) AS least, max({s}) AS most, floor(avg({s}) * 1000 + 0.5) / 1000 AS mean, {count_if("l_returnflag = 'R'")} AS anchored FROM {t.lineitem} GROUP BY 1, 2"""


@both("agg_coverage")
def agg_coverage(q, t):
    return f"SELECT o_orderstatus AS status, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM {t.orders} GROUP BY 1"


@both("agg_corrections")
def agg_corrections(q, t):
    """Per key the value seen most often, the later one of ties, with its share."""
    return f"""SELECT l_suppkey AS key, value_of, n, CAST(n AS DOUBLE) / total AS confidence FROM (SELECT l_suppkey, l_returnflag AS value_of, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey) AS total,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, max(l_orderkey * 10 + l_linenumber) DESC) AS place FROM {t.lineitem} GROUP BY l_suppkey, l_returnflag) AS a WHERE place = 1"""


@both("agg_method_audit")
def agg_method_audit(q, t):
    rate = lambda c: f"avg(CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"""SELECT l_linestatus AS method, count(*) AS n, {rate('l_discount > 0')} AS discounted, {rate('l_tax > 0')} AS taxed, {rate("l_returnflag = 'R'")} AS returned, {rate('l_quantity >= 25')} AS large, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) AS place FROM {t.lineitem} GROUP BY 1"""


@both("agg_field_rates")
def agg_field_rates(q, t):
    return f"SELECT role, count(*) AS n, {count_if('length(text) > 0')} AS present, avg(CAST(length(text) AS DOUBLE)) AS mean_length FROM {t.conversations} GROUP BY 1"


@both("agg_kb_batch")
def agg_kb_batch(q, t):
    return f"SELECT event_type, floor(value / 10) AS bucket, count(*) AS n, min(value) AS least, max(value) AS most, count(props) AS present FROM {t.events} GROUP BY 1, 2"


@both("agg_log_pivot")
def agg_log_pivot(q, t):
    """One row a user: the last value of each kind of event."""
    last = lambda e: f"max_by(CASE WHEN event_type = '{e}' THEN value END, CASE WHEN event_type = '{e}' THEN {q.millis('ts')} * 1000000 + event_id END) AS last_{e}"
    return f"SELECT user_id, count(*) AS n, {', '.join(last(e) for e in ('signup', 'click', 'purchase'))} FROM {t.events} GROUP BY 1"


@both("agg_ocr_quality")
def agg_ocr_quality(q, t):
    return f"SELECT doc_id, count(*) AS boxes, CAST(sum(length(text)) AS BIGINT) AS chars, avg(CAST(length(text) AS DOUBLE) / 100) AS mean_conf FROM {t.lines} GROUP BY 1"


@both("agg_ocr_flags")
def agg_ocr_flags(q, t):
    conf = "(l_quantity / 50)"
    return f"""SELECT l_orderkey AS doc_id, avg({conf}) AS mean_conf, max(CASE WHEN l_returnflag = 'R' AND {conf} < 0.8 THEN 1 ELSE 0 END) = 1 AS low_critical,
      CAST({count_if(f'{conf} < 0.8')} AS DOUBLE) / count(*) > 0.45 AS unclear, CAST({count_if(f'{conf} < 0.6')} AS DOUBLE) / count(*) > 0.3 AS handwritten, avg({conf}) < 0.8 AS low_mean FROM {t.in_order('lineitem', 'l_orderkey')} GROUP BY 1"""


@both("agg_zone_hits")
def agg_zone_hits(q, t):
    hit = q.like("lower(text)", r"\b(the|der|la|le)\b")
    return f"""SELECT doc_id, {count_if(f'line < 0.25 * height AND hit')} AS top_hits, {count_if(f'line >= 0.75 * height AND hit')} AS bottom_hits FROM (SELECT doc_id, line, {hit} AS hit, max(line) OVER (PARTITION BY doc_id) + 1 AS height FROM {t.lines}) AS a GROUP BY 1"""


@both("agg_validations")
def agg_validations(q, t):
    """Per field the first record, replaced by the first correct one."""
    return f"""SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS correct FROM (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linenumber) AS place FROM {t.lineitem}) AS a WHERE place = 1"""


@both("agg_most_common")
def agg_most_common(q, t):
    return f"""SELECT l_partkey, value_of, n FROM (SELECT l_partkey, l_linestatus AS value_of, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) DESC) AS place FROM {t.lineitem} GROUP BY 1, 2) AS a WHERE place = 1"""


@both("agg_page_merge")
def agg_page_merge(q, t):
    """Per conversation the text of the role of highest priority, then the longest."""
    order = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"
    return f"""SELECT conv_id, role, turn, text, n, mean_length FROM (SELECT conv_id, role, turn, text, count(*) OVER (PARTITION BY conv_id) AS n, avg(CAST(length(text) AS DOUBLE)) OVER (PARTITION BY conv_id) AS mean_length, row_number() OVER (PARTITION BY conv_id ORDER BY {order}, length(text) DESC, turn) AS place FROM {t.conversations}) AS a WHERE place = 1"""


@both("agg_kb_flags")
def agg_kb_flags(q, t):
    """Flags by id, the first of each kept, and the highest severity."""
    return f"""SELECT o_custkey, min(severity) AS highest, count(*) AS flags, {count_if('severity = 1')} AS stop, {count_if('severity = 2')} AS pending, {count_if('severity = 3')} AS flag, {count_if('severity = 4')} AS alert, {count_if('severity = 5')} AS info FROM (
      SELECT o_custkey, CAST(substring(o_orderpriority, 1, 1) AS INT) AS severity, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS place FROM {t.orders}) AS a WHERE place = 1 GROUP BY 1"""


@both("agg_bench")
def agg_bench(q, t):
    return f"SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, avg(CAST(length(text) AS DOUBLE)) AS mean_chars, avg(CASE WHEN length(text) < 150 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS low_rate FROM {t.benchmark}"


@both("agg_median_height")
def agg_median_height(q, t):
    """The median of each role's text lengths, from counts by length."""
    counted = f"SELECT role, length(text) AS h, count(*) AS c FROM {t.conversations} WHERE length(text) > 0 GROUP BY 1, 2"
    placed = f"SELECT role, h, sum(c) OVER (PARTITION BY role ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY role) AS n FROM ({counted}) AS v"
    pick = lambda i: f"min(CASE WHEN upto >= {i} THEN h END)"
    return f"SELECT role, (CAST({pick('floor((n + 1) / 2.0)')} AS DOUBLE) + {pick('ceil((n + 1) / 2.0)')}) / 2 AS median FROM ({placed}) AS a GROUP BY 1"


# Windows


@both("win_session")
def win_session(q, t):
    """Sessions of a user: a new one after a gap of more than five minutes."""
    return f"""SELECT user_id, session, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM (SELECT user_id, ms, sum(CASE WHEN before IS NULL OR ms - before > 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
      SELECT user_id, event_id, {q.millis('ts')} AS ms, lag({q.millis('ts')}) OVER (PARTITION BY user_id ORDER BY {q.millis('ts')}, event_id) AS before FROM {t.events}) AS a) AS b GROUP BY 1, 2""".replace("sum(CASE", "CAST(sum(CASE").replace("PRECEDING) AS session", "PRECEDING) AS BIGINT) AS session")


@both("win_line_context")
def win_line_context(q, t):
    around = ", ".join(f"{'lag' if k < 0 else 'lead'}(text, {abs(k)}) OVER (PARTITION BY doc_id, page ORDER BY line)" if k else "text" for k in (-2, -1, 0, 1, 2))
    return f"SELECT doc_id, page, line, concat_ws(' ❘ ', {around}) AS context FROM {t.lines}"


@both("win_line_context1")
def win_line_context1(q, t):
    around = ", ".join(f"{'lag' if k < 0 else 'lead'}(text, {abs(k)}) OVER (PARTITION BY doc_id, page ORDER BY line)" if k else "text" for k in (-1, 0, 1))
    return f"SELECT doc_id, page, line, lower(concat_ws(' ', {around})) AS context FROM {t.lines}"


@both("win_lookahead")
def win_lookahead(q, t):
    ahead = ", ".join(f"lead(text, {k}) OVER (PARTITION BY doc_id, page ORDER BY line) AS next_{k}" for k in (1, 2))
    return f"SELECT * FROM (SELECT doc_id, page, line, text, section, {ahead} FROM {t.lines}) AS a WHERE section IS NOT NULL"


@both("win_char_context")
def win_char_context(q, t):
    at = q.position("text", "'@'")
    return f"SELECT doc_id, substring(text, CAST(greatest(spot - 40, 1) AS INT), CAST(spot - greatest(spot - 40, 1) + 41 AS INT)) AS context FROM (SELECT doc_id, text, {at} AS spot FROM {t.intake}) AS a WHERE spot > 0"


@both("win_area_freq")
def win_area_freq(q, t):
    area = q.extract("text", r"\((\d{3})\) \d{3}-\d{4}", 1)
    return f"SELECT doc_id, line, area, count(*) OVER (PARTITION BY doc_id, area) AS n FROM (SELECT doc_id, line, {area} AS area FROM {t.lines}) AS a WHERE area IS NOT NULL"


@both("win_rank_fuse")
def win_rank_fuse(q, t):
    return f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority, o_orderdate DESC, o_orderkey) AS place FROM {t.orders}"


@both("win_keep_first")
def win_keep_first(q, t):
    return f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM {t.documents}) AS a WHERE place = 1"


@both("win_last_n")
def win_last_n(q, t):
    return f"SELECT event_id, event_type, ts FROM (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM {t.events}) AS a WHERE place <= 10"


@both("win_char_vote")
def win_char_vote(q, t):
    """The character that most names of a nation have at each of their last five places."""
    places = " UNION ALL ".join(f"SELECT c_nationkey, {k} AS place, substring(c_name, length(c_name) - {k}, 1) AS ch FROM customer_names" for k in range(5))
    return f"""WITH customer_names AS (SELECT c_nationkey, c_name FROM {t.customer}) SELECT c_nationkey, place, ch, n FROM (SELECT c_nationkey, place, ch, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey, place ORDER BY count(*) DESC, ch) AS r FROM ({places}) AS a GROUP BY 1, 2, 3) AS b WHERE r = 1"""


# Sets


@both("set_union_distinct")
def set_union_distinct(q, t):
    return f"SELECT n_name AS name FROM {t.nation} UNION SELECT r_name FROM {t.region} UNION SELECT c_mktsegment FROM {t.customer}"


@both("set_except")
def set_except(q, t):
    return f"SELECT c_nationkey AS nation FROM {t.customer} EXCEPT SELECT s_nationkey FROM {t.supplier}"


@both("set_redundancy")
def set_redundancy(q, t):
    """Generic actions go where a specific one is there."""
    return f"""SELECT DISTINCT o_custkey, o_orderpriority AS action FROM {t.orders} WHERE NOT (o_orderpriority = '5-LOW' AND EXISTS (SELECT 1 FROM {t.orders.replace(' AS orders', '')} AS o2 WHERE o2.o_custkey = orders.o_custkey AND o2.o_orderpriority = '1-URGENT'))"""


@both("set_intersect_words")
def set_intersect_words(q, t):
    """Customers and suppliers whose names share words, and how many: joined by word, so names without one never meet."""
    words = lambda x: q.explode(q.distinct(q.keep(q.split(f"lower({x})", "[ #]+"), "w", "length(w) > 2")))
    return f"SELECT c_custkey, s_suppkey, count(*) AS shared FROM (SELECT c_custkey, {words('c_name')} AS word FROM {t.customer}) AS c JOIN (SELECT s_suppkey, {words('s_name')} AS word FROM {t.supplier}) AS s ON s.word = c.word GROUP BY 1, 2"


@both("set_pr_metrics")
def set_pr_metrics(q, t):
    """Precision, recall and F1 of toxic against low quality."""
    return f"""SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision_of, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall_of,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT {count_if('toxic = 1 AND quality = 1')} AS tp, {count_if('toxic = 1 AND quality = 0')} AS fp, {count_if('toxic = 0 AND quality = 1')} AS fn FROM {t.labels}) AS a"""


def boxes(q, t) -> str:
    """Order lines as boxes of a page: place by quantity and price, height by line number."""
    return f"SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS box, l_quantity * 4 AS x, CAST(l_linenumber % 3 AS DOUBLE) AS y, CAST(20 AS DOUBLE) AS w FROM {t.lineitem} UNION ALL SELECT o_custkey + 10000000, 1, o_orderkey, o_totalprice / 1000, CAST(o_orderkey % 7 AS DOUBLE), CAST(20 AS DOUBLE) FROM {t.orders}"


@both("win_gap_split")
def win_gap_split(q, t):
    """Boxes of a page in reading order: by column, top and left; two columns where the largest gap between the centres of the
    middle third is more than 2.5 times the mean of the five largest others, on pages of ten boxes or more."""
    page = "PARTITION BY doc_id, page"
    centred = f"SELECT *, x + w / 2 AS xc FROM ({boxes(q, t)}) AS b0"
    placed = f"SELECT *, row_number() OVER ({page} ORDER BY xc, box) - 1 AS i, xc - lag(xc) OVER ({page} ORDER BY xc, box) AS gap, count(*) OVER ({page}) AS n FROM ({centred}) AS b1"
    middle = "i >= 1 AND i >= floor(n / 3.0) AND i < greatest(floor(n / 3.0) + 1, floor(2 * n / 3.0))"
    best = f"SELECT *, row_number() OVER ({page} ORDER BY CASE WHEN {middle} THEN 0 ELSE 1 END, gap DESC, i) AS r FROM ({placed}) AS b2"
    others = f"SELECT *, max(CASE WHEN r = 1 THEN i END) OVER ({page}) AS split, row_number() OVER ({page} ORDER BY CASE WHEN r = 1 OR i = 0 THEN 1 ELSE 0 END, gap DESC, i) AS o FROM ({best}) AS b3"
    judged = f"SELECT *, max(CASE WHEN r = 1 THEN gap END) OVER ({page}) > 2.5 * avg(CASE WHEN o <= 5 AND r > 1 AND i > 0 THEN gap END) OVER ({page}) AS two FROM ({others}) AS b4"
    column = f"SELECT *, CASE WHEN n >= 10 AND coalesce(two, false) AND i >= split THEN 1 ELSE 0 END AS col FROM ({judged}) AS b5"
    return f"SELECT doc_id, page, box, col, row_number() OVER ({page} ORDER BY col, y, x, box) - 1 AS place FROM ({column}) AS b6"
