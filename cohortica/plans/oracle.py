"""DuckDB SQL of the catalogue's queries, written by itself: it shares no code with the DataFrame plans."""

from __future__ import annotations


def _mid(c: str, edges: list[int]) -> str:
    mids = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    whens = " ".join(f"WHEN {c} <= {hi} THEN {m!r}" for hi, m in zip(edges[1:], mids, strict=True))
    return f"CAST(CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= {edges[0]} THEN {mids[0]!r} {whens} ELSE {mids[-1]!r} END AS DOUBLE)"


def _index(c: str, edges: list[int]) -> str:
    return f"CASE WHEN {c} IS NULL THEN -1 " + " ".join(f"WHEN {c} <= {hi} THEN {k}" for k, hi in enumerate(edges[1:-1])) + f" ELSE {len(edges) - 2} END"


PRICE, BALANCE = [0, 50000, 100000, 150000, 200000, 300000], [-1000, 0, 2500, 5000, 7500, 10000]


def book(policy: str = "exclude", crr: bool = False) -> str:
    bad = "bad AND NOT relief" if policy == "exclude" else "bad"
    stop = "stops OR relief" if policy == "censor" else "stops"
    fall = "1 - (1 - pow(1 + 5.0 / 1200, -mod_term)) / (5.0 / 1200) / (CASE WHEN mod_rate > 0 THEN (1 - pow(1 + mod_rate / 1200, -mod_term)) / (mod_rate / 1200) ELSE mod_term END)"
    crr_sql = f"WHEN coalesce(month = last_kept AND mod_at = ended AND (terminal IS NULL OR terminal >= mod_at) AND (coalesce({fall} > 0.01, FALSE) OR coalesce(bad_at = mod_at, FALSE)), FALSE) THEN 'default'" if crr else ""
    return f"""
raw AS (SELECT l_orderkey AS loan, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS month, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS bad,
  bool_or(l_returnflag = 'A' AND l_discount >= 0.09) AS prepaid, bool_or(l_returnflag = 'N' AND l_tax >= 0.08) AS stops, bool_or(l_linestatus = 'O' AND l_quantity < 3) AS relief,
  max(l_tax) AS rate, CAST(max(l_quantity) AS INT) AS remaining FROM lineitem GROUP BY 1, 2),
loans AS (SELECT o_orderkey AS loan, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS origination_month, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status,
  CAST(year(o_orderdate) AS INT) AS vintage, c_acctbal AS acctbal, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
perf AS (SELECT loans.*, month, month - origination_month AS age, {bad} AS defaulted, prepaid, {stop} AS ends, stops AS modified, rate * 100 AS rate, remaining FROM raw JOIN loans USING (loan) WHERE month >= origination_month),
term AS (SELECT loan, min(month) FILTER (WHERE defaulted OR prepaid) AS terminal, min(month) FILTER (WHERE ends) AS ended, min(month) FILTER (WHERE modified) AS mod_at, min(month) FILTER (WHERE defaulted) AS bad_at,
  arg_min(rate, month) FILTER (WHERE modified) AS mod_rate, arg_min(remaining, month) FILTER (WHERE modified) AS mod_term FROM perf GROUP BY loan),
kept AS (SELECT perf.*, terminal, ended, mod_at, bad_at, mod_rate, mod_term, max(month) OVER (PARTITION BY perf.loan) AS last_kept FROM perf JOIN term USING (loan) WHERE (terminal IS NULL OR month <= terminal) AND (ended IS NULL OR month < ended)),
book AS (SELECT *, CASE WHEN defaulted AND month = terminal THEN 'default' {crr_sql} WHEN prepaid AND month = terminal THEN 'prepayment' ELSE 'none' END AS outcome FROM kept)"""


B = "WITH " + book()
CELLS = B + f""",
banded AS (SELECT {_mid("price", PRICE)} AS price, {_mid("acctbal", BALANCE)} AS acctbal, segment, priority, age, origination_month, outcome, vintage FROM book),
cells AS (SELECT price, acctbal, segment, priority, age, origination_month, outcome, vintage, count(*) AS loan_months FROM banded GROUP BY ALL)"""
RISK = CELLS + """,
risk AS (SELECT age, CAST(sum(loan_months) AS BIGINT) AS at_risk, CAST(coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS BIGINT) AS defaults, CAST(coalesce(sum(loan_months) FILTER (WHERE outcome = 'prepayment'), 0) AS BIGINT) AS prepayments FROM cells GROUP BY age)"""
SCORED = CELLS + """,
eta AS (SELECT *, origination_month + age AS month, 4.6 - 0.002 * price / 1000 + 0.00002 * acctbal + (CASE WHEN segment = 'BUILDING' THEN 0.2 ELSE 0.0 END) AS e FROM cells),
scored AS (SELECT * EXCLUDE (e), 1 - exp(-(pow((age + 1) / exp(e), exp(CAST(0.26 AS DOUBLE))) - pow(age / exp(e), exp(CAST(0.26 AS DOUBLE))))) AS hazard, CASE WHEN outcome = 'default' THEN loan_months ELSE 0 END AS d FROM eta)"""
AE = "CAST(sum(loan_months) AS BIGINT) AS loan_months, CAST(sum(d) AS BIGINT) AS actual, round(sum(loan_months * hazard), 6) AS expected, round(sum(d) / sum(loan_months * hazard), 6) AS actual_over_expected"
BUCKETS = SCORED + """,
hz AS (SELECT round(hazard, 12) AS hz, sum(loan_months) AS w FROM scored GROUP BY 1),
run AS (SELECT hz, w, sum(w) OVER (ORDER BY hz ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER () AS total FROM hz),
buckets AS (SELECT hz, CAST(least(floor(run * 10 / total), 9) AS INT) AS bucket FROM run)"""
CURVE = """prod AS (SELECT *, exp(sum(ln(greatest(1 - h, 1e-300))) OVER (ORDER BY age)) AS s FROM (SELECT *, (defaults + prepayments) / at_risk AS h FROM risk)),
aj AS (SELECT *, sum(entering * defaults / at_risk) OVER w AS fd, sum(entering * prepayments / at_risk) OVER w AS fp FROM (SELECT *, coalesce(lag(s) OVER (ORDER BY age), 1.0) AS entering FROM prod) WINDOW w AS (ORDER BY age))"""
MACRO = """macro AS (SELECT * FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month, avg(o_totalprice) AS price_index, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1)
  JOIN (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS month, avg(l_discount) AS discount_rate FROM lineitem GROUP BY 1) USING (month))"""
FAMILY = CELLS + ", " + MACRO + """,
fam AS (SELECT c.*, o.price_index AS op, o.discount_rate AS od, o.volume AS ov, g.price_index AS gp, g.discount_rate AS gd, g.volume AS gv, o12.price_index AS op12, g12.price_index AS gp12
  FROM cells c LEFT JOIN macro o ON o.month = c.origination_month + age - 3 LEFT JOIN macro g ON g.month = c.origination_month - 3
  LEFT JOIN macro o12 ON o12.month = c.origination_month + age - 15 LEFT JOIN macro g12 ON g12.month = c.origination_month - 15)"""


def _family(x: str) -> str:
    return FAMILY + f" SELECT origination_month, age, CAST(sum(loan_months) AS BIGINT) AS loan_months, CAST(sum(loan_months) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS covered, round(sum(loan_months * v) / sum(loan_months) FILTER (WHERE v IS NOT NULL), 6) AS value FROM (SELECT *, {x} AS v FROM fam) GROUP BY origination_month, age"


def _psi(levels: str) -> str:
    return f"""{SCORED}, both_ AS ({levels}), n AS (SELECT level, sum(r) AS r, sum(c) AS c FROM both_ GROUP BY level),
p AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS p, greatest(c / sum(c) OVER (), 1e-6) AS q FROM n) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM p"""


def _outcomes(policy: str, crr: bool = False) -> str:
    return f"WITH {book(policy, crr)} SELECT vintage, outcome, count(*) AS loan_months FROM book GROUP BY ALL"


GRADE = "CAST(CASE WHEN pd <= 0.0005 THEN 1 WHEN pd <= 0.001 THEN 2 WHEN pd <= 0.002 THEN 3 WHEN pd <= 0.004 THEN 4 WHEN pd <= 0.008 THEN 5 WHEN pd <= 0.016 THEN 6 WHEN pd <= 0.032 THEN 7 ELSE 8 END AS INT)"
BOTH = SCORED + """,
both_ AS (SELECT *, 1 - exp(-(pow((age + 1) / exp(5.0 + 0.00001 * acctbal), exp(CAST(0.1 AS DOUBLE))) - pow(age / exp(5.0 + 0.00001 * acctbal), exp(CAST(0.1 AS DOUBLE))))) AS hp FROM scored)"""
GRADED = SCORED + f""",
pds AS (SELECT *, greatest(1 - pow(1 - hazard, 12), 0.0005) AS pd FROM scored), graded AS (SELECT *, {GRADE} AS grade FROM pds)"""
LAGS = B + """, c AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE outcome = 'default') AS d FROM book GROUP BY 1), s AS (SELECT unnest(range((SELECT min(month) FROM c), (SELECT max(month) + 1 FROM c))) AS month), z AS (SELECT s.month, coalesce(n, 0) AS n, coalesce(d, 0) AS d FROM s LEFT JOIN c ON s.month = c.month), k AS (SELECT unnest(range(-6, 7)) AS shift),
lags AS (SELECT CAST(shift AS INT) AS shift, round(corr(a.d, b.n), 6) AS correlation, count(*) AS months FROM z a JOIN k ON TRUE JOIN z b ON b.month + shift = a.month GROUP BY shift)"""
CUT = 1996 * 12
MID = "(SELECT CAST(floor((min(month) + max(month)) / 2) AS INT) FROM scored)"


def _levels(c: str) -> str:
    return f"SELECT {c} AS level, CASE WHEN month <= {MID} THEN loan_months ELSE 0 END AS r, CASE WHEN month > {MID} THEN loan_months ELSE 0 END AS c FROM scored"


def _numbers(c: str) -> str:
    return f"SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda x: {c} >= x)) AS VARCHAR) AS level, CASE WHEN month <= {MID} THEN loan_months ELSE 0 END AS r, CASE WHEN month > {MID} THEN loan_months ELSE 0 END AS c FROM scored, (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored WHERE month <= {MID})"


SQL = {
    "default_rate_by_segment": B + f" SELECT segment, {_mid('price', PRICE)} AS price, count(*) AS loan_months, count(*) FILTER (WHERE outcome = 'default') AS events, round(count(*) FILTER (WHERE outcome = 'default') / count(*), 9) AS rate FROM book GROUP BY 1, 2",
    "book_outcomes": _outcomes("exclude"),
    "book_policy_censor": _outcomes("censor"),
    "book_policy_ignore": _outcomes("ignore"),
    "book_crr_restructuring": _outcomes("exclude", True),
    "cells": CELLS + " SELECT * FROM cells",
    "cells_quarterly": CELLS + ", q AS (SELECT CAST(floor(age / 3) * 3 AS INT) AS age, segment, outcome FROM banded) SELECT age, segment, outcome, count(*) AS loan_months FROM q GROUP BY ALL",
    "cell_compression": CELLS + ", c AS (SELECT price, acctbal, segment, priority, age, origination_month, outcome, sum(loan_months) AS n FROM cells GROUP BY ALL) SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS loan_months, round(sum(n) / count(*), 6) AS compression FROM c",
    "key_extension_cost": CELLS + """, s AS (SELECT 'base' AS specification, count(*) AS cells FROM (SELECT DISTINCT price, acctbal, segment, priority, age, origination_month, outcome FROM cells) UNION ALL
SELECT 'with_status', count(*) FROM (SELECT DISTINCT """ + _mid("price", PRICE) + ", " + _mid("acctbal", BALANCE) + """, segment, priority, status, age, origination_month, outcome FROM book))
SELECT specification, cells, round(cells / (SELECT cells FROM s WHERE specification = 'base'), 6) AS ratio, cells * 1.14 <= 250000000 AS fits FROM s""",
    "incomplete_cases": B + """, m AS (SELECT vintage, loan, bool_or(nation % 7 = 3 AND segment <> 'BUILDING') AS a, bool_or(acctbal < 0) AS b, CAST(bool_or(outcome = 'default') AS INT) AS bad FROM book GROUP BY 1, 2),
g AS (SELECT vintage, count(*) AS loans, count(*) FILTER (WHERE a OR b) AS dropped, count(*) FILTER (WHERE a) AS no_nation, count(*) FILTER (WHERE b) AS no_acctbal, avg(bad) FILTER (WHERE NOT (a OR b)) AS k, avg(bad) FILTER (WHERE a OR b) AS d FROM m GROUP BY 1)
SELECT vintage, loans, dropped, no_nation, no_acctbal, round(k, 9) AS default_rate_kept, round(d, 9) AS default_rate_dropped, round(dropped / loans, 9) AS dropped_share, round(CASE WHEN k <> 0 THEN d / k END, 6) AS relative_risk FROM g""",
    "exits_by_code": B + """, x AS (SELECT perf.loan, status AS code, min(perf.month) AS out_at, any_value(bad_at) AS d, any_value(ended) AS e FROM perf JOIN term USING (loan) WHERE prepaid GROUP BY 1, 2)
SELECT code, count(*) AS loans, count(*) FILTER (WHERE d < out_at) AS defaulted_before, count(*) FILTER (WHERE e < out_at) AS censored_before, count(*) FILTER (WHERE d = out_at) AS defaulted_at_exit FROM x GROUP BY code""",
    "defaults_by_month": B + ", c AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE outcome = 'default') AS d FROM book GROUP BY 1), s AS (SELECT unnest(range((SELECT min(month) FROM c), (SELECT max(month) + 1 FROM c))) AS month) SELECT CAST(s.month AS INT) AS month, coalesce(n, 0) AS loan_months, coalesce(d, 0) AS defaults FROM s LEFT JOIN c ON s.month = c.month",
    "calendar_lag_correlation": LAGS + " SELECT * FROM lags",
    "payment_state": """WITH u AS (SELECT user_id AS loan, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS age, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(errors) OVER (PARTITION BY loan ORDER BY age) AS before FROM u)
SELECT CASE WHEN before IS NULL OR before = 0 THEN 'current' WHEN before = 1 THEN 'one_month' WHEN before = 2 THEN 'two_months' ELSE 'three_or_more' END AS state, count(*) AS days, CAST(sum(errors) AS BIGINT) AS errors FROM p GROUP BY 1""",
    "outstanding_by_month": B + " SELECT month, count(*) AS contracts, round(sum(price), 2) AS balance FROM book GROUP BY month",
    "originations_by_month": "WITH " + book().split("perf AS")[0].rstrip().rstrip(",") + " SELECT origination_month, count(*) AS loans, round(sum(price), 2) AS volume, round(avg(price), 4) AS price, round(avg(acctbal), 4) AS acctbal FROM loans GROUP BY 1",
    "origination_mix": "WITH " + book().split("perf AS")[0].rstrip().rstrip(",") + " SELECT vintage, segment, count(*) AS loans, round(count(*) / sum(count(*)) OVER (PARTITION BY vintage), 9) AS share FROM loans GROUP BY 1, 2",
    "underwriting_quartiles": "WITH " + book().split("perf AS")[0].rstrip().rstrip(",") + ", l AS (SELECT vintage, 'price' AS covariate, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM loans GROUP BY 1 UNION ALL SELECT vintage, 'acctbal', quantile_cont(acctbal, [0.25, 0.5, 0.75]) FROM loans GROUP BY 1) SELECT vintage, covariate, round(q[1], 6) AS q25, round(q[2], 6) AS q50, round(q[3], 6) AS q75 FROM l",
    "profile_categorical": CELLS + """, n AS (SELECT 'segment' AS covariate, segment AS level, outcome, loan_months FROM cells UNION ALL SELECT 'priority', priority, outcome, loan_months FROM cells),
g AS (SELECT covariate, level, CAST(sum(loan_months) AS BIGINT) AS loan_months, CAST(coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS BIGINT) AS defaults FROM n GROUP BY 1, 2), s AS (SELECT *, loan_months / sum(loan_months) OVER (PARTITION BY covariate) AS p FROM g)
SELECT covariate, level, loan_months, defaults, round(p, 9) AS share, round(defaults / loan_months, 9) AS default_rate, CASE WHEN p < 0.05 THEN 'merge: below minimum share' ELSE 'keep' END AS verdict FROM s""",
    "profile_continuous": B + f" SELECT CAST({_index('price', PRICE)} AS INT) AS band, count(*) AS loan_months, count(*) FILTER (WHERE outcome = 'default') AS defaults, round(count(*) FILTER (WHERE outcome = 'default') / count(*), 9) AS default_rate FROM book GROUP BY 1",
    "monotone_bands": B + f", p AS (SELECT {_index('price', PRICE)} AS band, round(count(*) FILTER (WHERE outcome = 'default') / count(*), 9) AS r FROM book GROUP BY 1), s AS (SELECT r - lag(r) OVER (ORDER BY band) AS s FROM p WHERE band >= 0) SELECT count(s) AS steps, coalesce(min(s), 0) >= 0 AS rises, coalesce(max(s), 0) <= 0 AS falls FROM s",
    "cut_points": B + ", q AS (SELECT quantile_cont(price, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95]) AS q FROM book) SELECT CAST(k AS INT) AS k, round(q[k], 3) AS cut FROM q, (SELECT unnest(range(1, 7)) AS k)",
    "fill_rate": B + " SELECT 'price' AS covariate, round(avg(CAST(price IS NOT NULL AS INT)), 9) AS fill_rate FROM book UNION ALL SELECT 'nation', round(avg(CAST(CASE WHEN nation % 7 = 3 THEN NULL ELSE nation END IS NOT NULL AS INT)), 9) FROM book",
    "frequency_table": CELLS + ", n AS (SELECT segment AS level, CAST(sum(loan_months) AS BIGINT) AS exposure FROM cells GROUP BY 1 UNION ALL SELECT '<missing>', 0) SELECT level, exposure, round(exposure / sum(exposure) OVER (), 9) AS share FROM n",
    "concentration": CELLS + """, n AS (SELECT 'segment' AS covariate, segment AS level, sum(loan_months) AS w FROM cells GROUP BY 2 UNION ALL SELECT 'outcome', outcome, sum(loan_months) FROM cells GROUP BY 2)
SELECT covariate, arg_max(level, w) FILTER (WHERE level IS NOT NULL) AS largest, round(coalesce(max(w) FILTER (WHERE level IS NOT NULL) / sum(w), 1.0), 9) AS share, count(level) AS levels, coalesce(max(w) FILTER (WHERE level IS NOT NULL) / sum(w), 1.0) >= 0.99 AS dominated FROM n GROUP BY 1""",
    "hazard_by_level": CELLS + " SELECT segment, CAST(sum(loan_months) AS BIGINT) AS loan_months, round(coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) / sum(loan_months), 9) AS default_rate, round(coalesce(sum(loan_months) FILTER (WHERE outcome = 'prepayment'), 0) / sum(loan_months), 9) AS prepayment_rate, round(sum(loan_months) / sum(sum(loan_months)) OVER (), 9) AS share FROM cells GROUP BY 1",
    "book_by_segment_grouping_sets": B + """, r AS (SELECT book.*, r_name FROM book JOIN nation ON n_nationkey = nation JOIN region ON r_regionkey = n_regionkey), g AS (SELECT 'all' AS segment, 'all' AS "group", month, outcome, price FROM r UNION ALL SELECT 'segment', segment, month, outcome, price FROM r UNION ALL SELECT 'region', r_name, month, outcome, price FROM r UNION ALL SELECT 'status', status, month, outcome, price FROM r)
SELECT segment, "group", month, count(*) AS loan_months, count(*) FILTER (WHERE outcome = 'default') AS defaults, round(sum(price), 2) AS balance FROM g GROUP BY 1, 2, 3""",
    "lending_by_segment": B + """, f AS (SELECT loan, arg_min(vintage, month) AS vintage, arg_min(price, month) AS price, arg_min(segment, month) AS s, arg_min(priority, month) AS p FROM book GROUP BY 1), g AS (SELECT 'all' AS segment, 'all' AS "group", vintage, price FROM f UNION ALL SELECT 'segment', s, vintage, price FROM f UNION ALL SELECT 'priority', p, vintage, price FROM f),
t AS (SELECT segment, "group", vintage, count(*) AS loans, round(sum(price), 2) AS volume FROM g GROUP BY 1, 2, 3)
SELECT t.*, round(t.loans / a.loans, 9) AS loans_share, round(t.volume / a.volume, 9) AS volume_share FROM t JOIN t a ON a.segment = 'all' AND a.vintage = t.vintage""",
    "macro_monthly": "WITH " + MACRO + " SELECT month, round(price_index, 6) AS price_index, volume, round(discount_rate, 9) AS discount_rate FROM macro",
    "macro_ffill_trim": "WITH " + MACRO + ", g AS (SELECT month, CASE WHEN month % 5 = 2 THEN NULL ELSE price_index END AS price_index, CASE WHEN month < (SELECT min(month) + 4 FROM macro) THEN NULL ELSE volume END AS volume FROM macro), s AS (SELECT unnest(range((SELECT min(month) FROM g), (SELECT max(month) + 1 FROM g))) AS month), f AS (SELECT s.month, last_value(price_index IGNORE NULLS) OVER w AS price_index, last_value(volume IGNORE NULLS) OVER w AS volume, price_index IS NOT NULL AS hp, volume IS NOT NULL AS hv FROM s LEFT JOIN g ON s.month = g.month WINDOW w AS (ORDER BY s.month)), b AS (SELECT greatest(min(month) FILTER (WHERE hp), min(month) FILTER (WHERE hv)) AS lo, least(max(month) FILTER (WHERE hp), max(month) FILTER (WHERE hv)) AS hi FROM f) SELECT CAST(month AS INT) AS month, round(price_index, 6) AS price_index, volume FROM f, b WHERE month BETWEEN lo AND hi",
    "macro_level": _family("od"),
    "macro_gap": _family("od - gd"),
    "macro_yoy": _family("op / op12 - 1"),
    "macro_yoy_gap": _family("(op / op12 - 1) - (gp / gp12 - 1)"),
    "macro_term_switch": _family("-(CASE WHEN price <= 125000 THEN od - gd ELSE ov - gv END)"),
    "macro_mark_to_market": _family("80.0 * gp / op - 80.0"),
    "macro_note_spread": _family("acctbal - gp"),
    "regime_flag": CELLS + f" SELECT CAST(origination_month + age BETWEEN {CUT} AND {CUT + 18} AS INT) AS regime, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells GROUP BY 1",
    "episodes_bounds": CELLS + " SELECT outcome = 'default' AS event, age AS age_start, age + 1 AS age_stop, CAST(CASE WHEN outcome = 'default' THEN age ELSE age + 1 END AS DOUBLE) AS lower_bound, CAST(sum(loan_months) AS BIGINT) AS loan_months, count(*) FILTER (WHERE outcome <> 'default') AS right_censored FROM cells GROUP BY 1, 2, 3, 4",
    "split_train_test": SCORED + f" SELECT CASE WHEN month <= {MID} THEN 'train' ELSE 'test' END AS side, count(*) AS cells, CAST(sum(loan_months) AS BIGINT) AS loan_months, CAST(sum(d) AS BIGINT) AS defaults, max(month) AS last_month FROM scored GROUP BY 1",
    "parity_halves": CELLS + " SELECT CAST((origination_month // 12) % 2 AS INT) AS half, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells GROUP BY 1",
    "panel_validation_report": """WITH u AS (SELECT user_id AS loan, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS age, count(*) FILTER (WHERE event_type = 'error') >= 3 AS event FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(age) OVER w AS before, coalesce(max(CAST(event AS INT)) OVER (PARTITION BY loan ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM u WINDOW w AS (PARTITION BY loan ORDER BY age))
SELECT count(*) AS rows_checked, count(*) FILTER (WHERE age = before) AS repeated, count(*) FILTER (WHERE age - before > 1) AS gaps, count(*) FILTER (WHERE age < 0) AS negative, count(*) FILTER (WHERE event AND gone = 1) AS second_events, count(*) FILTER (WHERE gone = 1) AS after_event FROM p""",
    "risk_sets": RISK + " SELECT * FROM risk",
    "kaplan_meier_greenwood": RISK + """, p AS (SELECT *, defaults / at_risk AS hazard, exp(sum(ln(1 - defaults / at_risk)) OVER (ORDER BY age)) AS s, sum(defaults / (at_risk * CAST(at_risk - defaults AS DOUBLE))) OVER (ORDER BY age) AS v FROM risk)
SELECT age, at_risk, defaults, round(hazard, 9) AS hazard, round(s, 9) AS survival, round(s * sqrt(v), 9) AS se, round(greatest(0.0, s - 1.959963984540054 * s * sqrt(v)), 9) AS low, round(least(1.0, s + 1.959963984540054 * s * sqrt(v)), 9) AS high FROM p""",
    "km_by_segment": CELLS + ", r AS (SELECT segment, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d FROM cells GROUP BY 1, 2) SELECT segment, age, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS defaults, round(CASE WHEN max(d / n) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 9) AS survival FROM r WINDOW w AS (PARTITION BY segment ORDER BY age)",
    "vintage_curves": CELLS + ", r AS (SELECT vintage, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d FROM cells GROUP BY 1, 2) SELECT vintage, age, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS defaults, round(CASE WHEN max(d / n) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 9) AS survival FROM r WINDOW w AS (PARTITION BY vintage ORDER BY age)",
    "net_entries": RISK + """, s AS (SELECT unnest(range(0, (SELECT max(age) + 1 FROM risk))) AS age), r AS (SELECT s.age, coalesce(at_risk, 0) AS n, coalesce(defaults, 0) AS d FROM s LEFT JOIN risk ON s.age = risk.age),
e AS (SELECT age, n - lag(n - d) OVER (ORDER BY age) AS net FROM r) SELECT CAST(age AS INT) AS age, CAST(net AS BIGINT) AS net_entries FROM e WHERE net > 0""",
    "aalen_johansen": RISK + ", " + CURVE + " SELECT age, round(s, 9) AS survival, round(fd, 9) AS incidence_default, round(fp, 9) AS incidence_prepayment FROM aj",
    "aalen_johansen_se": RISK + ", " + CURVE + """, x AS (SELECT *, CASE WHEN at_risk > defaults + prepayments THEN (defaults + prepayments) / (at_risk * CAST(at_risk - defaults - prepayments AS DOUBLE)) ELSE 0 END AS a, entering * defaults / (CAST(at_risk AS DOUBLE) * at_risk) AS b, entering * entering * defaults * (at_risk - defaults) / pow(at_risk, 3) AS c FROM aj)
SELECT age, round(fd, 9) AS incidence, round(sqrt(greatest(fd * fd * sum(a) OVER w - 2 * fd * sum(fd * a) OVER w + sum(fd * fd * a) OVER w + sum(c) OVER w - 2 * (fd * sum(b) OVER w - sum(fd * b) OVER w), 0)), 8) AS se FROM x WINDOW w AS (ORDER BY age)""",
    "incidence_gap": SCORED + """, m AS (SELECT age, sum(loan_months) AS n, sum(d) AS d, sum(loan_months * hazard) / sum(loan_months) AS hz FROM scored GROUP BY age)
SELECT age, round(1 - exp(sum(ln(1 - d / n)) OVER w), 8) AS observed, round(1 - exp(sum(ln(1 - hz)) OVER w), 8) AS predicted FROM m WINDOW w AS (ORDER BY age)""",
    "curves_cross": CELLS + """, r AS (SELECT segment, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d FROM cells GROUP BY 1, 2), k AS (SELECT segment, age, n, round(exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER (PARTITION BY segment ORDER BY age)), 9) AS s FROM r),
t AS (SELECT age FROM k GROUP BY age HAVING min(n) >= 20 AND count(*) = (SELECT count(DISTINCT segment) FROM k))
SELECT a.segment AS first_group, b.segment AS second_group, count(*) AS ages, bool_or(a.s - b.s > 0.001) AND bool_or(a.s - b.s < -0.001) AS crosses FROM k a JOIN k b ON a.age = b.age AND a.segment < b.segment JOIN t ON a.age = t.age GROUP BY 1, 2""",
    "hazard_closed_form": SCORED + " SELECT age, segment, round(sum(loan_months * hazard), 6) AS expected, round(max(hazard), 9) AS highest FROM scored GROUP BY 1, 2",
    "actual_vs_expected": SCORED + f" SELECT vintage, {AE} FROM scored GROUP BY vintage",
    "calibration_deciles": BUCKETS + f" SELECT bucket, {AE} FROM scored JOIN buckets ON round(hazard, 12) = hz GROUP BY bucket",
    "weighted_gini": SCORED + """, h AS (SELECT round(hazard, 12) AS hz, sum(d) AS d, sum(loan_months) AS w FROM scored GROUP BY 1), t AS (SELECT *, sum(d) OVER (ORDER BY hz DESC) AS cd, sum(d) OVER () AS td, sum(w) OVER () AS tw FROM h)
SELECT CAST(max(td) AS BIGINT) AS defaults, round(CASE WHEN max(td) > 0 THEN 2 * (sum(w * (2 * cd - d)) / (2 * CAST(max(tw) AS DOUBLE) * max(td))) - 1 END, 8) AS gini FROM t""",
    "pd_12m_grade": SCORED + f", p AS (SELECT *, 1 - pow(1 - hazard, 12) AS pd FROM scored) SELECT {GRADE} AS grade, " + AE + " FROM p GROUP BY 1",
    "score_month": SCORED + f", p AS (SELECT *, greatest(1 - pow(1 - hazard, 12), 0.0005) AS pd FROM scored WHERE month = {MID}) SELECT segment, priority, {GRADE} AS grade, CAST(sum(loan_months) AS BIGINT) AS loan_months, round(sum(loan_months * pd) / sum(loan_months), 8) AS pd_12m FROM p GROUP BY 1, 2, 3",
    "decile_histogram": SCORED + """, h AS (SELECT CAST(floor((ln(hazard) + 20) / 20 * 10000) AS INT) AS bin, sum(loan_months) AS w FROM scored GROUP BY 1), r AS (SELECT *, floor((sum(w) OVER (ORDER BY bin) - 1) * 10 / sum(w) OVER ()) AS k FROM h)
SELECT CAST(k AS INT) AS decile, min(bin) AS first_bin, max(bin) AS last_bin, CAST(sum(w) AS BIGINT) AS loan_months FROM r GROUP BY k""",
    "psi_categorical": _psi(f"SELECT segment AS level, CASE WHEN month <= {MID} THEN loan_months ELSE 0 END AS r, CASE WHEN month > {MID} THEN loan_months ELSE 0 END AS c FROM scored"),
    "psi_numeric": _psi(f"SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda x: acctbal >= x)) AS VARCHAR) AS level, CASE WHEN month <= {MID} THEN loan_months ELSE 0 END AS r, CASE WHEN month > {MID} THEN loan_months ELSE 0 END AS c FROM scored, (SELECT list_sort(list_distinct(quantile_cont(acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored WHERE month <= {MID})"),
    "prepayment_cpr": BOTH + ", p AS (SELECT month, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'prepayment'), 0) AS k, sum(loan_months * hp) AS e FROM both_ GROUP BY 1) SELECT month, CAST(n AS BIGINT) AS loan_months, CAST(k AS BIGINT) AS prepayments, round(k / n, 9) AS smm, round(1 - pow(1 - k / n, 12), 8) AS cpr, round(e / n, 9) AS predicted_smm, round(1 - pow(1 - e / n, 12), 8) AS predicted_cpr, round(k / e, 6) AS ratio FROM p",
    "cycle_in_band": SCORED + ", y AS (SELECT month // 12 AS year, round(sum(d) / sum(loan_months * hazard), 6) AS r FROM scored GROUP BY 1), c AS (SELECT count(r) AS years, count(*) FILTER (WHERE r BETWEEN 0.8 AND 1.25) AS years_in_band, min(r) AS lowest, max(r) AS highest FROM y) SELECT *, round(years_in_band / years, 6) AS share_in_band, CAST(0.7 AS DOUBLE) AS threshold, years_in_band / years >= 0.7 AS passed FROM c",
    "thin_months": SCORED + ", m AS (SELECT month, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM scored GROUP BY 1) SELECT month, loan_months, loan_months < 0.1 * (SELECT quantile_cont(loan_months, 0.5) FROM m) AS thin FROM m",
    "age_band_by_vintage": SCORED + f" SELECT vintage, CASE WHEN age < 12 THEN 'under 12' WHEN age < 24 THEN '12 to 24' WHEN age < 36 THEN '24 to 36' WHEN age < 60 THEN '36 to 60' ELSE '60 and over' END AS age_band, {AE} FROM scored GROUP BY 1, 2",
    "weighted_covariance": SCORED + """, w AS (SELECT sum(loan_months) AS w, sum(loan_months * price) / sum(loan_months) AS p, sum(loan_months * acctbal) / sum(loan_months) AS b, sum(loan_months * price * price) / sum(loan_months) AS pp, sum(loan_months * price * acctbal) / sum(loan_months) AS pb, sum(loan_months * acctbal * acctbal) / sum(loan_months) AS bb FROM scored)
SELECT 'price' AS first, 'price' AS second, round(pp - p * p, 4) AS covariance, 1.0 AS correlation FROM w UNION ALL SELECT 'price', 'acctbal', round(pb - p * b, 4), round((pb - p * b) / sqrt((pp - p * p) * (bb - b * b)), 6) FROM w UNION ALL SELECT 'acctbal', 'acctbal', round(bb - b * b, 4), 1.0 FROM w""",
    "anchor_multiplier": SCORED + f" SELECT CAST(sum(loan_months) AS BIGINT) AS loan_months, CAST(sum(d) AS BIGINT) AS actual, round(sum(loan_months * hazard), 6) AS expected, round(sum(d) / sum(loan_months * hazard), 8) AS multiplier FROM scored WHERE month BETWEEN {CUT} AND {CUT + 23}",
    "top_cells": CELLS + " SELECT price, acctbal, segment, priority, origination_month, outcome, vintage, loan_months FROM cells WHERE age = 6 ORDER BY loan_months DESC, origination_month, segment, priority, price, acctbal, outcome LIMIT 20",
    "observation_window": CELLS + " SELECT min(origination_month + age) AS first_month, max(origination_month + age) AS last_month, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells",
    "projection_term_structure": SCORED + """, p AS (SELECT segment, price, priority, CAST(sum(loan_months) AS BIGINT) AS weight FROM cells WHERE age = 0 GROUP BY 1, 2, 3), x AS (SELECT *, 4.6 - 0.002 * price / 1000 + (CASE WHEN segment = 'BUILDING' THEN 0.2 ELSE 0.0 END) AS e FROM p, (SELECT unnest(range(0, 24)) AS step)),
c AS (SELECT segment, step, 1 - exp(-pow((step + 1) / exp(e), exp(CAST(0.26 AS DOUBLE)))) AS pd, weight FROM x), m AS (SELECT segment, step, sum(pd * weight) / sum(weight) AS f FROM c GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY segment ORDER BY step), 0.0) AS b FROM m)
SELECT segment, CAST(step AS INT) AS step, round(f, 8) AS cumulative_pd, round(f - b, 8) AS marginal_pd, round((f - b) / (1 - b), 8) AS hazard FROM l""",
    "competing_paths": CELLS + """, r AS (SELECT segment, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d, coalesce(sum(loan_months) FILTER (WHERE outcome = 'prepayment'), 0) AS p FROM cells GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN max((d + p) / n) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN d + p < n THEN ln(1 - (d + p) / n) ELSE 0 END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY segment ORDER BY age)), e AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY segment ORDER BY age), 1.0) AS b FROM s)
SELECT segment, age AS step, round(s, 9) AS survival, round(sum(b * d / n) OVER w, 9) AS incidence_default, round(sum(b * p / n) OVER w, 9) AS incidence_prepayment FROM e WINDOW w AS (PARTITION BY segment ORDER BY age)""",
    "scenario_pd": "WITH " + MACRO + """, l AS (SELECT * FROM macro ORDER BY month DESC LIMIT 1), f AS (SELECT s.scenario, k AS step, price_index * (CASE WHEN scenario = 'base' THEN 1.0 ELSE 1 + [-0.1, -0.2, -0.15][least(k, 3)] END) AS p FROM l, (SELECT unnest(range(1, 13)) AS k), (VALUES ('base'), ('adverse')) AS s(scenario)),
h AS (SELECT *, 1 - exp(-exp(-4 - p / 100000)) AS hz FROM f) SELECT scenario, CAST(step AS INT) AS step, round(1 - exp(sum(ln(1 - hz)) OVER (PARTITION BY scenario ORDER BY step)), 8) AS cumulative_pd FROM h""",
    "cells_fine": B + f" SELECT {_mid('price', list(range(0, 400001, 25000)))} AS price, {_mid('acctbal', BALANCE)} AS acctbal, segment, priority, age, origination_month, outcome, count(*) AS loan_months FROM book GROUP BY ALL",
    "cells_narrow": B + " SELECT segment, age, origination_month, outcome, count(*) AS loan_months FROM book GROUP BY ALL",
    "defaults_by_month_from_cells": B + ", c AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE outcome = 'default') AS d FROM book GROUP BY 1), s AS (SELECT unnest(range((SELECT min(month) FROM c), (SELECT max(month) + 1 FROM c))) AS month) SELECT CAST(s.month AS INT) AS month, coalesce(n, 0) AS loan_months, coalesce(d, 0) AS defaults FROM s LEFT JOIN c ON s.month = c.month",
    "durations_reconstructed": RISK + ", x AS (SELECT age, defaults, CAST(greatest(at_risk - defaults - coalesce(lead(at_risk) OVER (ORDER BY age), 0), 0) AS BIGINT) AS censored FROM risk) SELECT age + 1 AS duration, TRUE AS event, defaults AS loans FROM x WHERE defaults > 0 UNION ALL SELECT age + 1, FALSE, censored FROM x WHERE censored > 0",
    "survival_by_stratum": CELLS + ", r AS (SELECT price, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d FROM cells GROUP BY 1, 2) SELECT price, age, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS defaults, round(CASE WHEN max(d / n) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 9) AS survival FROM r WINDOW w AS (PARTITION BY price ORDER BY age)",
    "outcomes_by_age": CELLS + " SELECT age, outcome, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells GROUP BY 1, 2",
    "macro_long": "WITH " + MACRO + " SELECT month, 'price_index' AS series, round(price_index, 6) AS value FROM macro UNION ALL SELECT month, 'volume', volume FROM macro UNION ALL SELECT month, 'discount_rate', round(discount_rate, 6) FROM macro",
    "at_origination": """WITH u AS (SELECT user_id AS loan, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS age, CAST(count(*) FILTER (WHERE event_type = 'error') AS INT) AS errors, count(*) AS events FROM events GROUP BY 1, 2)
SELECT loan, age, errors, events FROM (SELECT *, row_number() OVER (PARTITION BY loan ORDER BY age) AS k FROM u) WHERE k = 1""",
    "to_loan_level": """WITH u AS (SELECT user_id AS loan, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS age, count(*) FILTER (WHERE event_type = 'error') >= 3 AS event, CASE WHEN count(*) > 1 THEN count(*) END AS events FROM events GROUP BY 1, 2)
SELECT loan, max(age) + 1 AS duration, bool_or(event) AS event, arg_min(events, age) AS events FROM u GROUP BY loan""",
    "macro_as_of": CELLS + ", " + MACRO + ", m AS (SELECT month, price_index FROM macro WHERE month % 4 = 1), c AS (SELECT origination_month + age AS month, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells GROUP BY 1) SELECT c.month, loan_months, round(m.price_index, 6) AS price_index FROM c ASOF LEFT JOIN m ON c.month >= m.month",
    "conditional_pd": SCORED + ", p AS (SELECT DISTINCT segment, price, 4.6 - 0.002 * price / 1000 + (CASE WHEN segment = 'BUILDING' THEN 0.2 ELSE 0.0 END) AS e FROM cells WHERE age = 0) SELECT segment, price, round(1 - exp(-(pow(18 / exp(e), exp(CAST(0.26 AS DOUBLE))) - pow(6 / exp(e), exp(CAST(0.26 AS DOUBLE))))), 8) AS pd_12m FROM p",
}

def _long(table: str) -> str:
    return f"SELECT 'all' AS seg, 'all' AS grp, * FROM {table} UNION ALL SELECT 'segment', segment, * FROM {table} UNION ALL SELECT 'priority', priority, * FROM {table}"


def _corr(a: str, b: str) -> str:
    m = lambda x: f"(sum(loan_months * {x}) / sum(loan_months))"
    cov = lambda x, y: f"({m(f'CAST({x} AS DOUBLE) * {y}')} - {m(x)} * {m(y)})"
    return f"round({cov(a, b)} / sqrt({cov(a, a)} * {cov(b, b)}), 6)"


def _pick(n: str, *texts: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} % {len(texts)} = {k} THEN {t}" for k, t in enumerate(texts)) + " END"


#: The records after cleaning, written from what the raw texts mean: no casts, sentinels or blanks are left.
RECORDS = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders),
orig AS (SELECT CAST(k AS VARCHAR) AS loan, CAST(CASE WHEN k % 23 = 0 OR k % 31 = 0 THEN NULL ELSE 300 + (c * 7 + k) % 551 END AS DOUBLE) AS credit_score, CAST(CASE WHEN k % 29 <> 0 THEN 20 + k * 13 % 78 END AS DOUBLE) AS original_ltv, CAST(CASE WHEN k % 29 <> 0 THEN 22 + k * 13 % 78 END AS DOUBLE) AS original_cltv,
  CAST(CASE WHEN k % 7 <> 0 AND k % 13 <> 0 THEN 5 + k * 3 % 50 END AS DOUBLE) AS debt_to_income, floor(p) AS original_balance, 3 + k % 4 + (k % 10) / 10 AS note_rate, CAST(CASE WHEN k % 3 = 0 THEN 180 ELSE 360 END AS INT) AS orig_term,
  CAST({_pick('k', '0', '25', '30', 'NULL', 'NULL')} AS DOUBLE) AS insurance_coverage, {_pick('k', "'West'", "'Northeast'", "'South'", "'Midwest'", "'Other'", "'South'", "'West'", "'Northeast'")} AS region, k % 4 = 3 AS harp_loan, k FROM o),
m AS (SELECT l_orderkey AS k, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS month, max(l_quantity) AS q, bool_or(l_returnflag = 'A' AND l_discount >= 0.09) AS paid, bool_or(l_returnflag = 'R' AND l_discount >= 0.1) AS loss, bool_or(l_returnflag = 'R' AND l_tax >= 0.08) AS sold,
  bool_or(l_returnflag = 'N' AND l_tax >= 0.08) AS modified, bool_or((l_linestatus = 'O' AND l_quantity <= 4 AND l_quantity <> 3) OR (l_linestatus = 'F' AND l_quantity = 1 AND l_tax >= 0.07)) AS relief FROM lineitem GROUP BY 1, 2),
perf AS (SELECT CAST(m.k AS VARCHAR) AS loan, month, CAST(month - (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS INT) AS age, CASE WHEN q > 49 THEN 'XX' WHEN q > 47 THEN 'RA' WHEN q > 45 THEN '4' WHEN q > 43 THEN '3' WHEN q > 38 THEN '2' WHEN q > 30 THEN '1' ELSE '0' END AS status, paid, NOT paid AND loss AS lost, NOT paid AND NOT loss AND sold AS sold, modified, relief FROM m JOIN orders ON m.k = o_orderkey)"""


def record_book(policy: str = "exclude", complete: bool = True) -> str:
    bad = "(status IN ('3', '4') OR lost)" + (" AND NOT relief" if policy == "exclude" else "")
    ends = "modified OR relief" if policy == "censor" else "modified"
    whole = "WHERE credit_score IS NOT NULL AND original_ltv IS NOT NULL AND (debt_to_income IS NOT NULL OR harp_loan)" if complete else ""
    return RECORDS + f""",
aged AS (SELECT *, {bad} AS bad, {ends} AS stops, lag(status) OVER (PARTITION BY loan ORDER BY month) AS previous FROM perf WHERE age >= 0),
term AS (SELECT loan, min(month) FILTER (WHERE bad OR paid OR sold) AS terminal, min(month) FILTER (WHERE stops) AS ended FROM aged GROUP BY loan),
rb AS (SELECT aged.*, orig.* EXCLUDE (loan), CASE WHEN bad AND month = terminal THEN 'default' WHEN paid AND month = terminal THEN 'prepayment' ELSE 'none' END AS outcome, sold AND month = terminal AS gone
  FROM aged JOIN term USING (loan) JOIN orig ON orig.loan = aged.loan {whole + ' AND' if whole else 'WHERE'} (terminal IS NULL OR month <= terminal) AND (ended IS NULL OR month < ended))"""


LEVELS = {
    "purpose": _pick("k", "'purchase'", "'cash_out_refinance'", "'rate_term_refinance'", "'rate_term_refinance'", "NULL"),
    "occupancy": _pick("k", "'owner_occupied'", "'second_home'", "'investment_property'", "NULL"),
    "channel": _pick("k", "'retail'", "'broker_or_correspondent'", "'broker_or_correspondent'", "'broker_or_correspondent'", "NULL"),
    "region": "region",
    "harp": "CASE WHEN harp_loan THEN 'harp' ELSE 'standard' END",
    "delinquency_state": "CASE WHEN previous IS NULL OR previous = '0' THEN 'current' WHEN previous = '1' THEN 'one_month' WHEN previous = '2' THEN 'two_months' WHEN previous IN ('3', '4') THEN 'three_or_more' END",
    "buyer_type": _pick("k", "'repeat'", "'first_time'", "NULL"),
    "property_type": _pick("k", "'single_family'", "'planned_unit_development'", "'condominium'", "'manufactured_or_coop'", "'manufactured_or_coop'", "NULL"),
    "units": _pick("k", "'one_unit'", "'two_to_four_units'", "'two_to_four_units'", "NULL", "NULL"),
    "term_years": "CASE WHEN orig_term <= 190 THEN '15' ELSE '30' END",
    "mortgage_insurance": "CASE WHEN insurance_coverage > 0 THEN 'insured' WHEN insurance_coverage = 0 THEN 'uninsured' END",
    "loan_size": _pick("k", "'conforming'", "'super_conforming'", "NULL"),
    "borrower_count": _pick("k", "'one'", "'two_or_more'", "'two_or_more'", "NULL", "NULL"),
}
_OUTCOMES = " SELECT region, outcome, count(*) AS loan_months, count(DISTINCT loan) AS loans, count(*) FILTER (WHERE gone) AS left_the_book, min(age) AS youngest FROM rb GROUP BY 1, 2"
_KEYS = ("purpose", "occupancy", "term_years", "mortgage_insurance", "buyer_type")
SEGMENTED = SCORED + f", lg AS ({_long('scored')})"
SQL |= {
    "late_entry_share": SQL["net_entries"].rsplit(" SELECT CAST(age", 1)[0] + ", t AS (SELECT CAST(coalesce(sum(net), 0) AS BIGINT) AS n FROM e WHERE net > 0), f AS (SELECT arg_min(at_risk, age) AS s FROM risk) SELECT n AS net_entries, round(n / (n + s), 9) AS share, n / (n + s) > 0.01 AS warned FROM t, f",
    "model_incidence": BOTH + """, a AS (SELECT age, CAST(sum(loan_months) AS BIGINT) AS n, sum(loan_months * hazard) / sum(loan_months) AS hd, sum(loan_months * hp) / sum(loan_months) AS hp FROM both_ GROUP BY 1), s AS (SELECT *, exp(sum(ln(1 - hd - hp)) OVER (ORDER BY age)) AS s FROM a), e AS (SELECT *, coalesce(lag(s) OVER (ORDER BY age), 1.0) AS b FROM s)
SELECT age, n AS at_risk, round(s, 9) AS survival, round(sum(b * hd) OVER w, 9) AS incidence_default, round(sum(b * hp) OVER w, 9) AS incidence_prepayment FROM e WINDOW w AS (ORDER BY age)""",
    "grade_rates": GRADED + """, g AS (SELECT grade, sum(loan_months) AS n, sum(d) AS d, sum(pd * loan_months) / sum(loan_months) AS p FROM graded GROUP BY 1), x AS (SELECT *, CASE WHEN d > 0 THEN p / (d / (n / 12)) - 1 END AS miss FROM g)
SELECT grade, CAST(n AS BIGINT) AS loan_months, CAST(d AS BIGINT) AS defaults, round(n / 12, 6) AS obligor_years, round(p, 9) AS predicted_pd, round(d / (n / 12), 9) AS actual_pd, round(miss, 6) AS relative_miss, abs(miss) <= 0.25 AS within_tolerance FROM x""",
    "scored_book": GRADED + " SELECT coalesce(CAST(grade AS VARCHAR), 'all') AS grade, CAST(sum(loan_months) AS BIGINT) AS loan_months, round(sum(pd * loan_months) / sum(loan_months), 8) AS pd_12m FROM graded GROUP BY ROLLUP (grade)",
    "window_criteria": SCORED + ", b AS (SELECT *, CASE WHEN age < 12 THEN 'under 12' WHEN age < 24 THEN '12 to 24' WHEN age < 36 THEN '24 to 36' WHEN age < 60 THEN '36 to 60' ELSE '60 and over' END AS age_band FROM scored) SELECT vintage, age_band, CAST(grouping(vintage, age_band) AS BIGINT) AS level, " + AE + " FROM b GROUP BY CUBE (vintage, age_band)",
    "screen_categoricals": B + """, n AS (SELECT 'segment' AS covariate, segment AS level, outcome FROM book UNION ALL SELECT 'priority', priority, outcome FROM book UNION ALL SELECT 'status', status, outcome FROM book UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), outcome FROM book),
g AS (SELECT covariate, level, count(*) AS loan_months, count(*) FILTER (WHERE outcome = 'default') AS defaults FROM n GROUP BY 1, 2), s AS (SELECT *, loan_months / sum(loan_months) OVER (PARTITION BY covariate) AS p FROM g)
SELECT covariate, level, loan_months, defaults, round(p, 9) AS share, round(defaults / loan_months, 9) AS default_rate, CASE WHEN p < 0.05 THEN 'merge: below minimum share' ELSE 'keep' END AS verdict FROM s""",
    "covariates_over_time": SCORED + """, l AS (SELECT 'price' AS covariate, month, loan_months AS w, price AS x FROM scored UNION ALL SELECT 'acctbal', month, loan_months, acctbal FROM scored), g AS (SELECT covariate, month, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q FROM l GROUP BY 1, 2)
SELECT covariate, month, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0)), 6) AS sd FROM g""",
    "cell_shape": CELLS + " SELECT 'segment' AS covariate, string_agg(DISTINCT segment, '|' ORDER BY segment) AS levels FROM cells UNION ALL SELECT 'priority', string_agg(DISTINCT priority, '|' ORDER BY priority) FROM cells UNION ALL SELECT 'outcome', string_agg(DISTINCT outcome, '|' ORDER BY outcome) FROM cells UNION ALL SELECT 'age', CAST(min(b - a) AS VARCHAR) FROM (SELECT age AS a, lead(age) OVER (ORDER BY age) AS b FROM (SELECT DISTINCT age FROM cells))",
    "levels_of_records": record_book(complete=False) + ", l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS covariate, {x} AS level FROM rb" for n, x in LEVELS.items()) + ") SELECT covariate, level, count(*) AS loan_months FROM l GROUP BY 1, 2",
    "cells_of_records": record_book() + ", x AS (SELECT " + ", ".join(f"{_mid(n, e)} AS {n}" for n, e in (("credit_score", [580, 660, 700, 740, 760, 820]), ("original_ltv", [30, 70, 80, 90, 100]), ("debt_to_income", [10, 28, 36, 43, 55]))) + ", " + ", ".join(f"{LEVELS[n]} AS {n}" for n in _KEYS if n != "term_years") + ", CAST(CASE WHEN orig_term <= 190 THEN 15 ELSE 30 END AS INT) AS term_years, age, month - age AS origination_month, outcome FROM rb) SELECT *, count(*) AS loan_months FROM x WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in _KEYS) + " GROUP BY ALL",
    "origination_of_records": RECORDS + " SELECT * EXCLUDE (k, harp_loan) FROM orig",
    "book_of_records": record_book() + _OUTCOMES,
    "book_of_records_censored": record_book("censor", False) + _OUTCOMES,
    "calibration_by_year_and_segment": SEGMENTED + f" SELECT seg AS segment, grp AS \"group\", CAST(month // 12 AS INT) AS year, {AE} FROM lg GROUP BY 1, 2, 3",
    "calibration_deciles_by_segment": SEGMENTED + f""", hz AS (SELECT seg, grp, round(hazard, 12) AS hz, sum(loan_months) AS w FROM lg GROUP BY 1, 2, 3), run AS (SELECT seg, grp, hz, sum(w) OVER (PARTITION BY seg, grp ORDER BY hz ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY seg, grp) AS total FROM hz),
j AS (SELECT lg.*, CAST(least(floor(run * 10 / total), 9) AS INT) AS bucket FROM lg JOIN run ON lg.seg = run.seg AND lg.grp = run.grp AND round(hazard, 12) = hz) SELECT seg AS segment, grp AS "group", bucket, {AE} FROM j GROUP BY 1, 2, 3""",
    "backtest_by_month_and_segment": SEGMENTED + f" SELECT seg AS segment, grp AS \"group\", month, {AE} FROM lg GROUP BY 1, 2, 3",
    "grades_by_segment": GRADED + f", lg AS ({_long('graded')}) SELECT seg AS segment, grp AS \"group\", grade, {AE} FROM lg GROUP BY 1, 2, 3",
    "to_monthly": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY 1) SELECT CAST(year(date) * 12 + month(date) - 1 AS INT) AS month, round(avg(price), 4) AS price, round(arg_max(price, date), 4) AS last_price FROM d GROUP BY 1",
    "absorb_not_reported": B + ", x AS (SELECT segment, CASE WHEN segment = 'BUILDING' AND loan % 5 = 0 THEN -1.0 ELSE acctbal END AS a FROM book) SELECT segment, count(a) AS known, count(*) FILTER (WHERE a = -1) AS absorbed, round(sum(a), 2) AS acctbal FROM x GROUP BY 1",
    "collinear_pairs": SCORED + ", r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, {_corr(a, b)} AS correlation FROM scored" for k, a in enumerate(("price", "acctbal", "age", "month", "origination_month")) for b in ("price", "acctbal", "age", "month", "origination_month")[k + 1 :]) + ") SELECT * FROM r WHERE abs(correlation) >= 0.5",
    "vif": CELLS + f", r AS (SELECT {_corr('price', 'acctbal')} AS a, {_corr('price', 'age')} AS b, {_corr('acctbal', 'age')} AS c FROM cells), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r) SELECT 'price' AS covariate, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'acctbal', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'age', round((1 - a * a) / det, 6) FROM d",
    "cells_in_window": CELLS + f" SELECT origination_month + age AS observation_month, segment, outcome, CAST(sum(loan_months) AS BIGINT) AS loan_months FROM cells WHERE origination_month + age BETWEEN {CUT} AND {CUT + 11} GROUP BY 1, 2, 3",
    "book_summary": CELLS + """, o AS (SELECT month, count(*) AS contracts, round(sum(price), 2) AS balance FROM book GROUP BY 1)
SELECT (SELECT CAST(min(vintage) AS VARCHAR) || ' - ' || CAST(max(vintage) AS VARCHAR) FROM loans) AS vintages, (SELECT count(*) FROM loans) AS loans_originated, (SELECT round(sum(price), 2) FROM loans) AS amount_originated, CAST(sum(contracts) AS BIGINT) AS loan_months_outstanding, max(contracts) AS peak_contracts, max(balance) AS peak_balance,
  (SELECT CAST(sum(loan_months) AS BIGINT) FROM cells) AS loan_months_modelled, (SELECT CAST(sum(loan_months) AS BIGINT) FROM cells WHERE outcome = 'default') AS defaults_modelled, (SELECT count(*) FROM lineitem) AS records FROM o""",
    "calendar_verdict": LAGS + ", b AS (SELECT * FROM lags WHERE correlation IS NOT NULL ORDER BY correlation DESC, abs(shift), shift LIMIT 1) SELECT shift AS best_shift, correlation, shift = 0 AS calendar_is_right FROM b",
    "weighted_mean_by_id": "WITH " + book().split("perf AS")[0].rstrip().rstrip(",") + ", g AS (SELECT avg(acctbal) AS x, count(*) AS w FROM loans GROUP BY segment, priority) SELECT count(*) AS rows, round(sum(x * w) / sum(w), 6) AS mean FROM g",
    "classed_with_labels": B + f""", x AS (SELECT {_mid("price", PRICE)} AS price_binned, CASE WHEN price < 50000 THEN 'under 50000' WHEN price < 100000 THEN '50000 to 100000' WHEN price < 150000 THEN '100000 to 150000' WHEN price < 200000 THEN '150000 to 200000' ELSE '200000 and over' END AS price_band,
  {_mid("acctbal", BALANCE)} AS acctbal_binned, CASE WHEN acctbal < 0 THEN 'under 0' WHEN acctbal < 2500 THEN '0 to 2500' WHEN acctbal < 5000 THEN '2500 to 5000' WHEN acctbal < 7500 THEN '5000 to 7500' ELSE '7500 and over' END AS acctbal_band FROM book) SELECT *, count(*) AS loan_months FROM x GROUP BY ALL""",
    "loan_family": B + ", " + MACRO + """, f AS (SELECT b.month, 60 + loan % 40 AS ltv, acctbal / 1000 AS note, o.price_index AS po, g.price_index AS pg, n.discount_rate AS dn, o.discount_rate - g.discount_rate AS gap FROM book b LEFT JOIN macro o ON o.month = b.month - 3 LEFT JOIN macro g ON g.month = origination_month - 3 LEFT JOIN macro n ON n.month = b.month)
SELECT month, count(*) AS loan_months, round(avg(ltv * pg / po), 6) AS indexed_cltv, round(avg(note - dn), 6) AS refinance_incentive, round(avg(gap), 9) AS gap_discount FROM f WHERE gap IS NOT NULL GROUP BY 1""",
    "projected_vintages": CELLS + """, st AS (SELECT vintage, price, acctbal, segment, priority, CAST(sum(loan_months) AS BIGINT) AS w, 4.6 - 0.002 * price / 1000 + 0.00002 * acctbal + (CASE WHEN segment = 'BUILDING' THEN 0.2 ELSE 0.0 END) AS e, 5.0 + 0.00001 * acctbal AS f FROM cells WHERE age = 0 GROUP BY ALL), x AS (SELECT * FROM st, (SELECT unnest(range(0, 24)) AS step)),
h AS (SELECT *, 1 - exp(-(pow((step + 1) / exp(e), exp(CAST(0.26 AS DOUBLE))) - pow(step / exp(e), exp(CAST(0.26 AS DOUBLE))))) AS hd, 1 - exp(-(pow((step + 1) / exp(f), exp(CAST(0.1 AS DOUBLE))) - pow(step / exp(f), exp(CAST(0.1 AS DOUBLE))))) AS hp FROM x),
s AS (SELECT *, exp(sum(ln(1 - hd - hp)) OVER (PARTITION BY vintage, price, acctbal, segment, priority ORDER BY step)) AS s FROM h), b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY vintage, price, acctbal, segment, priority ORDER BY step), 1.0) AS b FROM s),
i AS (SELECT vintage, step, w, sum(b * hd) OVER q AS fd, sum(b * hp) OVER q AS fp FROM b WINDOW q AS (PARTITION BY vintage, price, acctbal, segment, priority ORDER BY step)), p AS (SELECT vintage, CAST(step AS INT) AS age, round(sum(fd * w) / sum(w), 6) AS projected_default, round(sum(fp * w) / sum(w), 6) AS projected_prepayment FROM i GROUP BY 1, 2),
r AS (SELECT vintage, age, sum(loan_months) AS n, coalesce(sum(loan_months) FILTER (WHERE outcome = 'default'), 0) AS d, coalesce(sum(loan_months) FILTER (WHERE outcome = 'prepayment'), 0) AS k FROM cells GROUP BY 1, 2),
os AS (SELECT *, CASE WHEN max((d + k) / n) OVER z >= 1 THEN 0 ELSE exp(sum(CASE WHEN d + k < n THEN ln(1 - (d + k) / n) ELSE 0 END) OVER z) END AS s FROM r WINDOW z AS (PARTITION BY vintage ORDER BY age)), ob AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY vintage ORDER BY age), 1.0) AS b FROM os),
oi AS (SELECT vintage, age, round(round(sum(b * d / n) OVER z, 9), 6) AS observed_default, round(round(sum(b * k / n) OVER z, 9), 6) AS observed_prepayment FROM ob WINDOW z AS (PARTITION BY vintage ORDER BY age))
SELECT p.*, observed_default, observed_prepayment FROM p LEFT JOIN oi ON p.vintage = oi.vintage AND p.age = oi.age""",
    "projection_by_segment": CELLS + f""", p AS (SELECT segment, price, priority, CAST(sum(loan_months) AS BIGINT) AS w, 4.6 - 0.002 * price / 1000 + (CASE WHEN segment = 'BUILDING' THEN 0.2 ELSE 0.0 END) AS e FROM cells WHERE age = 0 GROUP BY 1, 2, 3), x AS (SELECT * FROM p, (VALUES ('base', 1.0), ('adverse', 1.5)) AS v(scenario, factor), (SELECT unnest(range(0, 12)) AS step)),
h AS (SELECT *, least(factor * (1 - exp(-(pow((step + 1) / exp(e), exp(CAST(0.26 AS DOUBLE))) - pow(step / exp(e), exp(CAST(0.26 AS DOUBLE)))))), 1) AS hz FROM x), c AS (SELECT segment, priority, scenario, step, w, 1 - exp(sum(ln(1 - hz)) OVER (PARTITION BY scenario, segment, price, priority ORDER BY step)) AS pd FROM h), lg AS ({_long('c')}),
m AS (SELECT seg, grp, scenario, step, sum(pd * w) / sum(w) AS f FROM lg GROUP BY 1, 2, 3, 4), l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY seg, grp, scenario ORDER BY step), 0.0) AS b FROM m)
SELECT seg AS segment, grp AS "group", scenario, CAST(step AS INT) AS step, round(f, 8) AS cumulative_pd, round(f - b, 8) AS marginal_pd, round((f - b) / (1 - b), 8) AS hazard FROM l""",
    "acceptance_by_segment": SCORED + f""", a AS (SELECT segment, {AE} FROM scored GROUP BY 1), hz AS (SELECT segment, round(hazard, 12) AS hz, sum(loan_months) AS w, sum(d) AS d FROM scored GROUP BY 1, 2),
run AS (SELECT *, sum(w) OVER (PARTITION BY segment ORDER BY hz ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY segment) AS total, sum(d) OVER (PARTITION BY segment ORDER BY hz DESC) AS cd, sum(d) OVER (PARTITION BY segment) AS td FROM hz),
b AS (SELECT scored.segment, least(floor(run * 10 / total), 9) AS bucket, round(sum(scored.d) / sum(loan_months * hazard), 6) AS r FROM scored JOIN run ON scored.segment = run.segment AND round(hazard, 12) = hz GROUP BY 1, 2), e AS (SELECT segment, min(r) AS worst, max(r) AS best FROM b GROUP BY 1),
g AS (SELECT segment, round(CASE WHEN max(td) > 0 THEN 2 * (sum(w * (2 * cd - d)) / (2 * CAST(max(total) AS DOUBLE) * max(td))) - 1 END, 8) AS gini FROM run GROUP BY 1)
SELECT a.*, worst, best, gini, coalesce(actual_over_expected BETWEEN 0.8 AND 1.25 AND worst >= 0.8 AND best <= 1.25 AND gini > 0.45, FALSE) AS passed FROM a JOIN e USING (segment) JOIN g USING (segment)""",
    "stability_report": "WITH " + ", ".join(f"p{k} AS ({q})" for k, q in enumerate((_psi(_levels("segment")), _psi(_levels("priority")), _psi(_numbers("acctbal")), _psi(_numbers("price"))))) + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS covariate, psi FROM p{k}" for k, c in enumerate(("segment", "priority", "acctbal", "price"))) + ") SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'shifted' ELSE 'unstable' END AS verdict FROM u",
}
