"""The registered queries again, in SQL over the same tables, written without the library's rewrites.

Links are plain band joins, medians and histograms use the engine's own functions, and the Poisson
coefficients are logarithms of group means.
"""

from __future__ import annotations

from eventlink.functions.labels import CATEGORY_NAMES, DEMOGRAPHIC_GROUPS, GROUP_NAMES
from eventlink.plans.proxy import WORK_TYPES

_ORDER_COLUMNS = {"high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}


def _fill(expr: str, width: int = 5) -> str:
    return f"CASE WHEN length({expr}) < {width} THEN lpad({expr}, {width}, '0') ELSE {expr} END"


def _whole(expr: str) -> str:
    return rf"CASE WHEN regexp_matches({expr}, '^\s*[+-]?[0-9]{{1,38}}\s*$') THEN trim({expr})::HUGEINT::VARCHAR END"


def _cycle(*values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE c_custkey % {len(values)} {cases} END"


_TS = "'%Y-%m-%d %H:%M:%S'"
_DAY = "'%Y-%m-%d'"
_GROUPS = ", ".join(f"('{g}', '{c}', {a}, {b})" for g, c, a, b in DEMOGRAPHIC_GROUPS)
_KEY_DATE = (
    "lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0')",
    "lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0')",
    "(c_custkey % 7 + 2010)::VARCHAR",
)
_DMY = f"{_KEY_DATE[0]} || '/' || {_KEY_DATE[1]} || '/' || {_KEY_DATE[2]}"

_VIEWS = f"""
WITH zone_dim AS (
  SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS zone, n_name AS zone_name,
         'WQ' || (n_nationkey % 10) AS wqz, 'CG' || (n_nationkey % 6) AS control_group, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (
  SELECT lpad(a.n_nationkey::VARCHAR, 5, '0') AS zone, lpad(b.n_nationkey::VARCHAR, 5, '0') AS neighbour
  FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) = 1),
reach AS (SELECT zone, zone AS near FROM zone_dim UNION ALL SELECT zone, neighbour FROM edges),
demographic_types AS (
  SELECT unnest(generate_series(a, b))::INTEGER AS acorn59, g AS acorn17, c AS acorn5
  FROM (VALUES {_GROUPS}) t(g, c, a, b)),
people AS (
  SELECT c_custkey AS customer, lpad(c_nationkey::VARCHAR, 5, '0') AS zone, 'B' || c_custkey AS postcode,
         (c_custkey % 62 + 1)::INTEGER AS acorn59, c_custkey % 50 + 100 AS households
  FROM customer),
ev AS (
  SELECT event_id AS id, ts, event_type AS type, value, zone, postcode
  FROM events JOIN people ON user_id = customer),
works AS (SELECT * FROM ev WHERE type IN ('click', 'purchase', 'signup')),
anomalies AS (SELECT * FROM ev WHERE type = 'view'),
complaints AS (
  SELECT *, ts::DATE AS date, CASE WHEN id % 3 = 0 THEN 'Appearance' ELSE 'Taste' END AS category
  FROM ev WHERE type = 'error'),
od AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS type, zone, year(o_orderdate)::INTEGER AS year
  FROM orders JOIN people ON o_custkey = customer),
ow AS (SELECT * FROM od WHERE type <> '1-URGENT'),
oc AS (SELECT * FROM od WHERE type = '1-URGENT'),
pairs AS (
  SELECT a.id AS a_id, a.type AS a_type, a.ts AS a_ts, a.zone AS a_zone, c.id AS c_id, c.ts AS c_ts, c.zone AS c_zone
  FROM works a JOIN reach r ON a.zone = r.zone
  JOIN complaints c ON c.zone = r.near AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 24 HOURS),
ab AS (
  SELECT a.id AS a_id, a.type AS a_type, b.id AS b_id
  FROM works a JOIN reach r ON a.zone = r.zone
  JOIN anomalies b ON b.zone = r.near AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOURS),
bc AS (
  SELECT b.id AS b_id, c.id AS c_id
  FROM anomalies b JOIN reach r ON b.zone = r.zone
  JOIN complaints c ON c.zone = r.near AND c.ts >= b.ts AND c.ts <= b.ts + INTERVAL 24 HOURS),
opairs AS (
  SELECT a.id AS a_id, a.type AS a_type, c.id AS c_id
  FROM ow a JOIN reach r ON a.zone = r.zone
  JOIN oc c ON c.zone = r.near AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 24 HOURS),
calendar AS (
  SELECT a.id AS a_id, c.id AS c_id, date_diff('day', a.ts::DATE, c.ts::DATE) AS days
  FROM works a JOIN reach r ON a.zone = r.zone
  JOIN complaints c ON c.zone = r.near AND date_diff('day', a.ts::DATE, c.ts::DATE) IN (0, 1)),
counted AS (
  SELECT a.id, a.type, count(p.c_id) AS n FROM works a LEFT JOIN pairs p ON a.id = p.a_id GROUP BY ALL),
ocounted AS (
  SELECT a.id, a.type, a.year, z.region, count(p.c_id) AS n
  FROM ow a LEFT JOIN opairs p ON a.id = p.a_id LEFT JOIN zone_dim z ON a.zone = z.zone GROUP BY ALL),
attributed AS (
  SELECT c.id, c.year, z.region,
         {", ".join(f"count(*) FILTER (WHERE p.a_type = '{t}') > 0 AS {n}" for n, t in _ORDER_COLUMNS.items())}
  FROM oc c LEFT JOIN opairs p ON c.id = p.c_id LEFT JOIN zone_dim z ON c.zone = z.zone GROUP BY ALL),
days AS (
  SELECT zone, date, count(*) AS n, dense_rank() OVER (ORDER BY date) AS day FROM complaints GROUP BY zone, date),
islands AS (
  SELECT *, day - row_number() OVER (PARTITION BY zone ORDER BY day) AS island FROM days),
sized AS (
  SELECT c.*, i.n AS daily, sum(i.n) OVER (PARTITION BY i.zone, i.island) AS whole FROM complaints c
  JOIN islands i ON c.zone = i.zone AND c.date = i.date),
runs AS (
  SELECT zone, date, n, sum(n) OVER w AS run_n, min(date) OVER w AS first_day FROM islands
  WINDOW w AS (PARTITION BY zone, island)),
clustered AS (
  SELECT c.*, r.n AS daily, r.run_n, r.zone || '/' || strftime(r.first_day, {_DAY}) AS cluster_id,
         hour(c.ts) + minute(c.ts) / 60 + second(c.ts) / 3600 AS decimal_hour,
         (isodow(c.ts) - 1) AS weekday
  FROM complaints c JOIN runs r ON c.zone = r.zone AND c.date = r.date),
classed AS (
  SELECT *, (CASE WHEN weekday < 5 THEN 'Weekday, ' ELSE 'Weekend, ' END)
         || (CASE WHEN daily >= 3 THEN 'clustered' ELSE 'non-clustered' END) AS kind FROM clustered),
ordinals AS (
  SELECT *, date_diff('day', DATE '0001-01-01', date) + 1 + decimal_hour / 24 AS ordinal FROM clustered),
profiled AS (
  SELECT c.*, p.acorn59, d.acorn17, d.acorn5 FROM complaints c
  LEFT JOIN people p ON c.postcode = p.postcode LEFT JOIN demographic_types d ON p.acorn59 = d.acorn59),
homes AS (SELECT p.*, d.acorn17, d.acorn5 FROM people p LEFT JOIN demographic_types d USING (acorn59)),
directory AS (
  SELECT NULL::TIMESTAMP AS start_ts, l_shipdate AS end_ts, 'Inferred from different SAP date fields' AS date_type,
         lpad(s_nationkey::VARCHAR, 5, '0') AS zone, NULL AS control_group, NULL AS region,
         l_orderkey::VARCHAR AS order_id, l_linenumber::VARCHAR AS operation, 'Valve Op' AS intervention_type,
         l_returnflag || ': ' || l_linestatus AS description, 'lineitem' AS source_file
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT ts, NULL, 'SAP Operation Created Date', CASE WHEN id % 5 <> 0 THEN zone END,
         CASE WHEN id % 10 = 0 THEN 'CG-own' END, CASE WHEN id % 10 < 5 THEN 'ASIA' END, '00' || id, NULL,
         'SAP Planned work', NULL, 'orders' FROM od
  UNION ALL
  SELECT ts, ts + INTERVAL 2 HOURS, 'Op created and latest task on NC incident tracker', zone, NULL, NULL,
         'E&' || id, NULL, 'NC Incident', 'Incident: ' || type, 'events' FROM ev),
finished AS (
  SELECT coalesce(d.start_ts, d.end_ts - INTERVAL 1 HOUR) AS start_ts,
         coalesce(d.end_ts, coalesce(d.start_ts, d.end_ts - INTERVAL 1 HOUR) + INTERVAL 1 HOUR) AS end_ts,
         d.start_ts AS given_start, coalesce(d.zone, 'unknown') AS zone, coalesce(z.wqz, 'unknown') AS wqz,
         coalesce(d.control_group, z.control_group, 'unknown') AS control_group,
         coalesce(d.region, z.region) AS region, d.order_id AS order_given,
         CASE WHEN d.order_id LIKE 'E&%' THEN substr(d.order_id, 3) ELSE d.order_id::BIGINT::VARCHAR END AS order_id,
         coalesce(d.operation, '0') AS operation, d.intervention_type
  FROM directory d LEFT JOIN zone_dim z ON d.zone = z.zone),
mess AS (
  SELECT c_custkey AS id, {_cycle(
      "c_nationkey::VARCHAR",
      "lpad(c_nationkey::VARCHAR, 5, '0') || ' Main St'",
      "'0'",
      "c_nationkey || '/' || lpad((c_custkey % 1000)::VARCHAR, 3, '0')",
      "'101050'",
      "'NATION_' || c_nationkey",
      "'Several'",
      "NULL",
      "c_nationkey || '*5 19'",
  )} AS zone_text,
  {_cycle("c_nationkey::VARCHAR", "'0' || c_nationkey", "'x'", "NULL")} AS district,
  {_cycle("(c_custkey % 1000)::VARCHAR", "'12 '", "'7.5'")} AS zone_number,
  {_cycle(
      "c_custkey::VARCHAR",
      "'00' || c_custkey",
      "c_custkey || ' 34'",
      "'A&' || c_custkey",
      "'x-y'",
      "NULL",
      "c_custkey || '/07'",
      "c_custkey || '-12'",
      "'7.9'",
  )} AS order_text,
  {_cycle(
      "(c_custkey % 24) || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0')",
      "(c_custkey % 24) || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || ':09'",
      "'Night shift'",
      "'tbc'",
      "NULL",
      "'TONIGHT'",
      "'10:30 am'",
  )} AS time_text,
  {_cycle(
      _DMY,
      f"{_DMY} || ' 13:05:59'",
      f"{_KEY_DATE[2]} || '-' || {_KEY_DATE[1]} || '-' || {_KEY_DATE[0]}",
      "'31/02/2016'",
      "'03/25/2016'",
      "'soon'",
      "NULL",
  )} AS date_text,
  {_cycle("'b' || c_custkey || ' 2 tt'", "' CV' || c_custkey || 'xx'", "NULL")} AS postcode_text,
  {_cycle(
      "'Not assigned'",
      "lpad(c_custkey::VARCHAR, 6, '4') || lpad(c_custkey::VARCHAR, 6, '2')",
      "NULL",
      "'#'",
      "'#/#'",
  )} AS xy,
  (c_custkey % 3)::DOUBLE AS x, 'CG' || (c_custkey % 9) AS given_group,
  {_cycle("'Rehab'", "'Infra'", "'LD'", "'Works'", "NULL", "'other'")} AS work_type
  FROM customer)
"""

_DATE_PARSE = (
    "coalesce(try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%d/%m/%Y %H:%M:%S'),"
    " try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%m/%d/%Y'))"
)
_CLOCK = (
    "coalesce(strftime(coalesce(try_strptime(time_text, '%H:%M'), try_strptime(time_text, '%H:%M:%S'),"
    " try_strptime(upper(time_text), '%I:%M %p')), '%H:%M:%S'),"
    " CASE WHEN lower(time_text) LIKE '%night%' THEN '22:00:00' END, '{default}')"
)
_FOLLOWED = """CASE WHEN count(*) FILTER (WHERE n > 0) > 0 AND count(*) FILTER (WHERE n = 0) > 0
  THEN round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 6) END"""
_RAW = "CASE WHEN count(*) FILTER (WHERE n > 0) > 0 THEN count(*) FILTER (WHERE n > 0) END"
_ANY = " OR ".join(_ORDER_COLUMNS)
_SUMS = ", ".join(f"sum({n}::BIGINT)::BIGINT AS {n}" for n in _ORDER_COLUMNS)
_HOURS = [f"h{h:02d}" for h in range(24)]


def _histogram(source: str, value: str, bins: int, group: str = "'all'", limits: str | None = None) -> str:
    span = limits or "min(v) AS lo, max(v) AS hi"
    return f"""{_VIEWS},
    known AS (SELECT {group} AS "group", ({value})::DOUBLE AS v FROM {source}),
    span AS (SELECT "group", {span} FROM known WHERE v IS NOT NULL GROUP BY "group"),
    placed AS (SELECT "group", least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1)::BIGINT AS bin
               FROM known JOIN span USING ("group")),
    grid AS (SELECT *, unnest(generate_series(0, {bins} - 1))::BIGINT AS bin FROM span)
    SELECT g."group", g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lower,
           round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS upper, count(p.bin) AS n
    FROM grid g LEFT JOIN placed p ON g."group" = p."group" AND g.bin = p.bin GROUP BY ALL"""


def _statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["link_pairs"] = """SELECT a_id AS id_cause, c_id AS id_complaint, a_zone = c_zone AS same_zone,
        a_zone <> c_zone AS neighbour_zone,
        CASE WHEN a_ts::DATE = c_ts::DATE THEN 'SameDay' ELSE 'NextDay' END AS day_label FROM pairs"""
    s["link_causes"] = "SELECT id, type, n AS number_of_complaint, n > 0 AS at_least_one_complaint FROM counted"
    s["link_effects"] = """SELECT c.id, count(p.a_id) AS number_of_cause, count(p.a_id) > 0 AS at_least_one_cause
        FROM complaints c LEFT JOIN pairs p ON c.id = p.c_id GROUP BY c.id"""
    s["link_outer"] = """SELECT a.id AS id_cause, a.type AS type_cause, a.n AS number_of_complaint_cause,
        c.id AS id_complaint, c.n AS number_of_cause_complaint
        FROM (SELECT k.*, p.c_id FROM counted k LEFT JOIN pairs p ON k.id = p.a_id) a
        FULL JOIN (SELECT c.id, count(p.a_id) AS n FROM complaints c LEFT JOIN pairs p ON c.id = p.c_id GROUP BY c.id) c
        ON a.c_id = c.id"""
    s["link_calendar"] = """SELECT a.id, count(p.c_id) AS number_of_complaint,
        count(p.c_id) > 0 AS at_least_one_complaint
        FROM works a LEFT JOIN calendar p ON a.id = p.a_id GROUP BY a.id"""
    s["link_calendar_pairs"] = """SELECT a_id AS id_cause, c_id AS id_complaint,
        CASE days WHEN 0 THEN 'SameDay' ELSE 'NextDay' END AS day_label FROM calendar"""
    s["link_calendar_any_zone"] = """SELECT a.id, count(c.id) AS number_of_complaint
        FROM works a LEFT JOIN complaints c ON c.date = a.ts::DATE OR c.date = a.ts::DATE + 1 GROUP BY a.id"""
    s["link_same_zone"] = """SELECT a.id, count(c.id) AS number_of_complaint FROM works a
        LEFT JOIN complaints c ON c.zone = a.zone AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 24 HOURS GROUP BY a.id"""
    s["link_three_days"] = """SELECT c.id, count(a.id) AS number_of_cause
        FROM complaints c JOIN reach r ON c.zone = r.near
        LEFT JOIN works a ON a.zone = r.zone AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 72 HOURS GROUP BY c.id"""
    s["abc_chain"] = """SELECT k.id, k.type, (SELECT count(*) FROM ab WHERE ab.a_id = k.id) AS number_of_anomaly,
        k.n AS number_of_complaint FROM counted k"""
    from_works = "(SELECT b_id FROM ab WHERE a_type IN ('click', 'purchase'))"
    counted_b = """SELECT b.id, count(bc.c_id) AS number_of_complaint
        FROM anomalies b LEFT JOIN bc ON b.id = bc.b_id WHERE b.id {test} GROUP BY b.id"""
    s["effects_from_works"] = counted_b.format(test=f"IN {from_works}")
    s["effects_not_from_works"] = counted_b.format(test=f"NOT IN {from_works}")
    s["from_works_flag"] = f"SELECT id, id IN {from_works} AS from_works FROM anomalies"
    s["from_work_related_anomaly"] = f"""SELECT id,
        id IN (SELECT c_id FROM bc WHERE b_id IN {from_works}) AS from_work_related_anomaly FROM complaints"""
    s["orders_with_lines"] = """SELECT id, type FROM od
        WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
    s["orders_without_lines"] = """SELECT id, type FROM od
        WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
    s["abc_shares"] = f"""SELECT count(*) AS n, count(*) FILTER (WHERE w) AS n_works,
        count(*) FILTER (WHERE b) AS n_bursts, count(*) FILTER (WHERE c) AS n_complaint,
        round(avg(w::INT), 6) AS share_works, round(avg(b::INT), 6) AS share_bursts,
        round(avg(c::INT), 6) AS share_complaint
        FROM (SELECT id IN {from_works} AS w, id IN (SELECT b_id FROM ab WHERE a_type = 'signup') AS b,
              id IN (SELECT b_id FROM bc) AS c FROM anomalies)"""

    places = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(WORK_TYPES, 1))
    s["type_pct_followed"] = f"""SELECT (CASE type {places} END)::BIGINT AS place, type, {_FOLLOWED} AS pct
        FROM counted GROUP BY type"""
    s["year_pct_followed"] = f"""SELECT year, type, {_FOLLOWED} AS pct FROM ocounted WHERE year >= 1997
        GROUP BY year, type"""
    by_year = f"SELECT year, type, {_FOLLOWED} AS pct FROM ocounted GROUP BY year, type"
    # Columns are whatever years and regions there are; pivots of all values leave out none.
    s["year_pct_followed_wide"] = f"""SELECT * FROM (PIVOT (SELECT type, 'y' || year AS y, pct FROM ({by_year}))
        ON y USING max(pct) GROUP BY type)"""
    s["year_pct_followed_long"] = f"""SELECT t.type, 'y' || y.year AS year, pct
        FROM (SELECT DISTINCT type FROM ocounted) t CROSS JOIN (SELECT DISTINCT year FROM ocounted) y
        LEFT JOIN ({by_year}) p ON p.type = t.type AND p.year = y.year"""
    s["region_pct_followed"] = f"SELECT region, type, {_FOLLOWED} AS pct FROM ocounted GROUP BY region, type"
    s["year_raw_followed"] = f"SELECT year, type, {_RAW} AS n_true FROM ocounted GROUP BY year, type"
    s["region_raw_followed"] = f"""SELECT * FROM (PIVOT (SELECT type, replace(lower(region), ' ', '_') AS r, n_true
        FROM (SELECT region, type, {_RAW} AS n_true FROM ocounted GROUP BY region, type)) ON r USING max(n_true) GROUP BY type)"""
    s["counts_by_year_region_type"] = "SELECT year, region, type, count(*) AS n FROM ocounted GROUP BY ALL"
    s["match_count_distribution"] = """SELECT k.n AS number_of_complaint, count(*) AS n FROM counted k GROUP BY k.n"""
    hot = ", ".join(f"(count(*) FILTER (WHERE p.a_type = '{t}') > 0)::INT AS {t}" for t in WORK_TYPES)
    s["attribution_multihot"] = f"""SELECT c.id, {hot}, count(p.a_id) > 0 AS any_cause
        FROM complaints c LEFT JOIN pairs p ON c.id = p.c_id GROUP BY c.id"""
    shares = ", ".join(f"round(100 * avg({n}::INT), 6) AS {n}" for n in _ORDER_COLUMNS)
    s["attribution_pct_by_year"] = f"""SELECT year, {shares}, round(100 * avg(({_ANY})::INT), 6) AS any_cause
        FROM attributed WHERE year >= 1997 GROUP BY year"""
    total = f"{_SUMS}, sum(({_ANY})::BIGINT)::BIGINT AS any_cause FROM attributed"
    s["attribution_totals"] = f"""SELECT 'year+region' AS "grouping", year, region, {total}
        WHERE year >= 1997 GROUP BY year, region
        UNION ALL SELECT 'region', NULL, region, {total} WHERE year >= 1997 GROUP BY region
        UNION ALL SELECT 'year', year, NULL, {total} WHERE year >= 1997 GROUP BY year"""
    s["attribution_in_region"] = f"SELECT year, {total} WHERE region = 'ASIA' GROUP BY year"
    s["poisson_by_type"] = """SELECT CASE type WHEN 'click' THEN 'Intercept' ELSE 'type_' || type END AS term,
        round(ln(m) - CASE type WHEN 'click' THEN 0
              ELSE ln((SELECT avg(n) FROM counted WHERE type = 'click')) END, 6) AS coefficient,
        true AS converged FROM (SELECT type, avg(n) AS m FROM counted GROUP BY type)"""
    s["random_baseline"] = """SELECT number_of_complaint, count(*) AS n FROM (
        SELECT d.id, count(c.id) AS number_of_complaint FROM (
          SELECT a.id, t.ts, z.zone FROM anomalies a
          JOIN (SELECT ts, row_number() OVER (ORDER BY md5(id::VARCHAR), id::VARCHAR) - 1 AS k FROM works) t
            ON t.k = ('0x' || substr(md5('time-' || a.id), 1, 15))::BIGINT % (SELECT count(*) FROM works)
          JOIN (SELECT zone, row_number() OVER (ORDER BY md5(id::VARCHAR), id::VARCHAR) - 1 AS k FROM works) z
            ON z.k = ('0x' || substr(md5('zone-' || a.id), 1, 15))::BIGINT % (SELECT count(*) FROM works)) d
        JOIN reach r ON d.zone = r.zone
        LEFT JOIN complaints c ON c.zone = r.near AND c.ts >= d.ts AND c.ts <= d.ts + INTERVAL 24 HOURS
        GROUP BY d.id) GROUP BY number_of_complaint"""

    s["cluster_sizes"] = """SELECT id, daily AS daily_cluster_size, run_n::BIGINT AS consecutive_cluster_size, cluster_id
        FROM clustered"""
    calendar_runs = """(SELECT *, sum(n) OVER w AS run_n, min(date) OVER w AS first_day FROM (
        SELECT zone, ts::DATE AS date, count(*) AS n,
               date_diff('day', DATE '1970-01-01', ts::DATE)
               - row_number() OVER (PARTITION BY zone ORDER BY ts::DATE) AS island
        FROM oc GROUP BY zone, ts::DATE) WINDOW w AS (PARTITION BY zone, island))"""
    s["cluster_sizes_calendar"] = f"""SELECT o.id, r.n AS daily_cluster_size,
        r.run_n::BIGINT AS consecutive_cluster_size, r.zone || '/' || strftime(r.first_day, {_DAY}) AS cluster_id
        FROM oc o JOIN {calendar_runs} r ON o.zone = r.zone AND o.ts::DATE = r.date"""
    s["cluster_catalogue"] = f"""SELECT zone || '/' || strftime(min(date), {_DAY}) AS cluster_id, zone,
        strftime(min(date), {_DAY}) AS first_day, strftime(max(date), {_DAY}) AS last_day, count(*) AS n_days,
        sum(n)::BIGINT AS n_complaints
        FROM (SELECT *, day - row_number() OVER (PARTITION BY zone ORDER BY day) AS island
              FROM (SELECT zone, ts::DATE AS date, count(*) AS n, dense_rank() OVER (ORDER BY ts::DATE) AS day
                    FROM oc GROUP BY zone, ts::DATE)) GROUP BY zone, island"""
    s["large_cluster_breakdown"] = """SELECT least, category = 'Appearance' AS incident_related,
        id IN (SELECT c_id FROM bc) AS at_least_one_anomaly, count(*) AS n
        FROM clustered JOIN (VALUES (3), (10)) t(least) ON run_n >= least GROUP BY ALL"""
    s["weekday_cluster_class"] = "SELECT kind, count(*) AS n FROM classed GROUP BY kind"
    hours = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS {n}" for h, n in enumerate(_HOURS))
    s["year_cluster_hour_pivot"] = f"SELECT year(ts)::INTEGER AS year, kind, {hours} FROM classed GROUP BY ALL"
    s["zone_date_counts"] = f"SELECT zone, strftime(date, {_DAY}) AS day, count(*) AS n FROM complaints GROUP BY ALL"
    s["points_per_zone"] = f"SELECT zone, strftime(date, {_DAY}) AS date, count(*) AS n FROM complaints GROUP BY ALL"
    s["value_limits"] = "SELECT round(min(ordinal), 6) AS lowest, round(max(ordinal), 6) AS highest FROM ordinals"
    s["demographic_rollup"] = "SELECT id, acorn59, acorn17, acorn5 FROM profiled"
    names = " ".join(f"WHEN '{g}' THEN '{g}: {n}'" for g, n in GROUP_NAMES.items())
    categories = " ".join(f"WHEN '{c}' THEN 'Category {c[-1]}: {n}'" for c, n in CATEGORY_NAMES.items())
    level = """SELECT '{level}' AS level, h.code, {label} AS label, h.households, c.n, c.n_chosen,
        round(100.0 * c.n / h.households, 6) AS per_100, round(100.0 * c.n_chosen / h.households, 6) AS chosen_per_100
        FROM (SELECT {level}::VARCHAR AS code, sum(households)::BIGINT AS households FROM homes GROUP BY {level}) h
        LEFT JOIN (SELECT {level}::VARCHAR AS code, count(*) AS n, nullif(count(*) FILTER (
          WHERE category = 'Appearance'), 0) AS n_chosen FROM profiled GROUP BY {level}) c ON h.code = c.code"""
    s["demographic_rates"] = " UNION ALL ".join(
        [
            level.format(level="acorn5", label=f"CASE h.code {categories} END"),
            level.format(level="acorn17", label=f"CASE h.code {names} END"),
            level.format(level="acorn59", label="NULL"),
        ]
    )
    s["rate_per_household"] = """SELECT h.zone, h.households, c.n, round(100.0 * c.n / h.households, 6) AS per_100
        FROM (SELECT zone, sum(households)::BIGINT AS households FROM people GROUP BY zone) h
        LEFT JOIN (SELECT zone, count(*) AS n FROM complaints GROUP BY zone) c ON h.zone = c.zone"""
    s["region_rate_per_1000"] = """SELECT c.region, h.households, c.n, round(1000.0 * c.n / h.households, 6) AS per_1000
        FROM (SELECT region, count(*) AS n FROM complaints JOIN zone_dim USING (zone) GROUP BY region) c
        LEFT JOIN (SELECT region, sum(households)::BIGINT AS households FROM people JOIN zone_dim USING (zone)
                   GROUP BY region) h ON h.region = c.region"""
    rates = ", ".join(
        f"round(1000.0 * nullif(count(*) FILTER (WHERE hour(ts) = {h}), 0) / any_value(h.households), 6) AS {n}"
        for h, n in enumerate(_HOURS)
    )
    s["hourly_profile_normalised"] = f"""SELECT p.acorn5, any_value(h.households)::BIGINT AS households, {rates}
        FROM profiled p LEFT JOIN (SELECT acorn5, sum(households) AS households FROM homes GROUP BY acorn5) h
        ON p.acorn5 = h.acorn5 GROUP BY p.acorn5"""

    s["union_directory"] = f"""SELECT strftime(start_ts, {_TS}) AS start_ts, strftime(end_ts, {_TS}) AS end_ts,
        date_type, zone, control_group, region, order_id, operation, intervention_type, description, source_file
        FROM directory"""
    s["zone_enrich"] = f"""SELECT order_given, order_id, operation, zone, wqz, control_group, region,
        strftime(given_start, {_DAY}) AS date, strftime(given_start, '%H:%M:%S') AS time,
        strftime(start_ts, {_TS}) AS start_ts, strftime(end_ts, {_TS}) AS end_ts FROM finished"""
    s["merge_event_spans"] = f"""SELECT order_id, operation, intervention_type, zone, wqz, control_group, region,
        strftime(min(start_ts), {_TS}) AS start_ts, strftime(max(end_ts), {_TS}) AS end_ts,
        year(min(start_ts))::INTEGER AS year, month(min(start_ts))::INTEGER AS month, strftime(min(start_ts), {_DAY}) AS start_date,
        strftime(max(end_ts), {_DAY}) AS end_date FROM finished WHERE region IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7"""
    s["merge_event_spans_q1"] = f"""SELECT order_id, operation, intervention_type, wqz,
        strftime(min(start_ts), {_TS}) AS start_ts, strftime(max(end_ts), {_TS}) AS end_ts,
        min(intervention_type) AS type, min(zone) AS zone FROM finished
        WHERE region IS NOT NULL AND start_ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-04-01'
        AND wqz IN ('WQ1', 'WQ2', 'WQ3') GROUP BY 1, 2, 3, 4"""
    s["missing_start"] = """SELECT intervention_type, zone, count(*) AS n FROM directory
        WHERE start_ts IS NULL GROUP BY ALL"""
    s["incident_rollup"] = f"""SELECT incident_name, strftime(min(task_ts), {_TS}) AS start_ts,
        strftime(max(task_ts), {_TS}) AS end_ts, min(lpad(l_linenumber::VARCHAR, 5, '0')) AS zone,
        min(l_orderkey::VARCHAR) AS order_id, count(*) AS n_records, round(median(l_extendedprice), 6) AS x,
        round(median(CASE WHEN l_quantity > 3 THEN l_quantity END), 6) AS y, min(l_returnflag) AS region
        FROM (SELECT *, 'Site ' || l_suppkey || '_' || year(l_shipdate) || '-01-01' AS incident_name,
              CASE WHEN l_linenumber > 1 THEN l_shipdate ELSE date_trunc('year', l_shipdate) END AS task_ts
              FROM lineitem WHERE l_suppkey % 10 <> 0) GROUP BY incident_name"""
    s["infer_span"] = f"""SELECT l_orderkey, l_linenumber,
        CASE greatest(a, b, c, d) WHEN a THEN 'date_created' WHEN b THEN 'date_dispatched'
          WHEN c THEN 'date_accepted' WHEN d THEN 'date_arrived' END AS latest_date,
        strftime(coalesce(greatest(a, b, c, d), e - INTERVAL 1 HOUR), {_TS}) AS start_ts,
        strftime(e, {_TS}) AS end_ts FROM (
          SELECT l_orderkey, l_linenumber, CASE WHEN k % 3 <> 0 THEN l_shipdate - INTERVAL 72 HOURS END AS a,
            CASE WHEN k % 4 <> 0 THEN l_shipdate - INTERVAL 48 HOURS END AS b,
            CASE WHEN k % 5 <> 0 THEN l_shipdate - INTERVAL 48 HOURS END AS c,
            CASE WHEN k % 7 = 0 THEN l_shipdate - INTERVAL 1 HOUR END AS d,
            CASE WHEN k % 2 = 0 THEN l_shipdate + INTERVAL 5 HOURS ELSE l_shipdate END AS e
          FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem) WHERE k % 6 <> 0)"""
    s["operations_per_order"] = """SELECT l_orderkey AS order_id, l_returnflag,
        string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS operations,
        string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS distinct_operations
        FROM lineitem GROUP BY l_orderkey, l_returnflag"""
    s["order_match_left"] = f"""SELECT l_orderkey AS order_id, l_linenumber, l_quantity, l_linestatus AS status,
        o_orderstatus AS status_right, strftime(o_orderdate, {_DAY}) AS o_orderdate,
        CASE WHEN o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS matched
        FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey"""
    s["reconcile_outer"] = """SELECT coalesce(r.l_linestatus, a.l_linestatus) AS status,
        CASE WHEN a.k IS NULL THEN 'left_only' WHEN r.k IS NULL THEN 'right_only' ELSE 'both' END AS merged,
        count(*) AS n
        FROM (SELECT l_orderkey || '/' || l_linenumber AS k, l_linestatus FROM lineitem WHERE l_returnflag = 'R') r
        FULL JOIN (SELECT l_orderkey || '/' || l_linenumber AS k, l_linestatus FROM lineitem WHERE l_returnflag = 'A') a
        ON r.k = a.k GROUP BY ALL"""
    s["order_zone_fill"] = f"""SELECT o.o_orderkey::VARCHAR AS order_id, o_orderstatus AS intervention_type,
        coalesce(w.zone, p.zone) AS zone, strftime(o_orderdate, {_TS}) AS start_ts
        FROM orders o JOIN people p ON o_custkey = customer
        LEFT JOIN (SELECT DISTINCT l_orderkey, lpad(s_nationkey::VARCHAR, 5, '0') AS zone
                   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) w
        ON w.l_orderkey = o.o_orderkey"""
    s["dedupe_readings"] = f"""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, {_DAY}) AS day, l_suppkey, l_quantity
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_shipdate, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1"""
    s["declared_columns"] = f"""SELECT o_orderkey::VARCHAR AS order_id, lpad((o_orderkey % 100000)::VARCHAR, 7, '0') AS code,
        CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderkey * 1000 AS key,
        CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, {_TS}) END AS status_ts, NULL::VARCHAR AS note FROM orders"""
    s["drop_all_null"] = "SELECT id, order_text FROM mess WHERE id % 11 <> 0"
    s["canonicalise_values"] = """SELECT id, CASE work_type WHEN 'Rehab' THEN 'Infra' WHEN 'Works' THEN 'Non-Infra'
        WHEN 'LD' THEN 'Leak Detection' ELSE work_type END AS work_type FROM mess"""
    s["unmatched_groups"] = """SELECT DISTINCT given_group FROM mess
        WHERE given_group NOT IN (SELECT control_group FROM zone_dim)"""
    s["adjacency_edges"] = """SELECT e.zone, e.neighbour, h.households::BIGINT AS neighbour_households FROM edges e
        LEFT JOIN (SELECT zone, sum(households) AS households FROM people GROUP BY zone) h ON h.zone = e.neighbour"""
    s["zones_in_region"] = """SELECT customer, zone FROM people
        WHERE zone IN (SELECT zone FROM zone_dim WHERE region = 'ASIA')"""
    s["sensors_in_zone"] = "SELECT c_custkey AS sensor_id FROM customer WHERE c_nationkey = 7"
    cleaned = "replace(replace(replace(zone_text, '/', ''), ' ', ''), '*', '')"
    s["zone_code_fix"] = f"""SELECT id, {_fill("trim(zone_text)")} AS filled,
        CASE zone_text WHEN '0' THEN NULL WHEN 'Several' THEN 'Multiple' ELSE {_fill(cleaned)} END AS free_text,
        coalesce(CASE WHEN regexp_matches(left(zone_text, 5), '^[0-9]+$') THEN left(zone_text, 5) END, z.zone) AS location,
        left(zone_text, 5) AS cropped,
        {_fill(f"({_whole('district')} || {_fill(f'({_whole("zone_number")})', 3)})")} AS district
        FROM mess LEFT JOIN zone_dim z ON zone_text = z.zone_name"""
    s["split_order_op"] = f"""SELECT id, p[1] AS order_part, p[2] AS operation_part, {_whole("p[2]")} AS operation,
        ({_whole("p[1]")}) || '/' || ({_whole("p[2]")}) AS order_op, id || '/00' AS default_op
        FROM (SELECT id, regexp_split_to_array(order_text, '[/-]') AS p FROM mess)"""
    s["lenient_order"] = f"""SELECT id, coalesce({_whole("order_text")}, {_whole("p[1]")}, {_whole("p[2]")}, order_text)
        AS order_id FROM (SELECT id, order_text, regexp_split_to_array(order_text, '[ &/-]') AS p FROM mess)"""
    s["postcode_normalise"] = "SELECT id, upper(replace(postcode_text, ' ', '')) AS postcode FROM mess"
    s["grid_split"] = """SELECT id, CASE WHEN xy <> 'Not assigned' THEN left(xy, 6) END AS x,
        CASE WHEN xy <> 'Not assigned' THEN right(xy, 6) END AS y,
        TRY_CAST(CASE WHEN xy <> 'Not assigned' THEN left(xy, 6) END AS DOUBLE) AS easting FROM mess"""
    s["sentinel_to_null"] = """SELECT id, CASE WHEN xy NOT IN ('Not assigned', '#', '#/#') THEN xy END AS xy,
        nullif(x, 0) AS x FROM mess"""
    s["parse_dates"] = f"""SELECT id, strftime(try_strptime(date_text, '%d/%m/%Y'), {_DAY}) AS day,
        strftime(try_strptime(date_text, '%d/%m/%Y %H:%M:%S'), {_TS}) AS fixed,
        strftime({_DATE_PARSE}, {_TS}) AS day_first,
        strftime(try_strptime(date_text || ' 08:00:01', '%d/%m/%Y %H:%M:%S'), {_TS}) AS joined FROM mess"""
    start, end = _CLOCK.format(default="00:00:00"), _CLOCK.format(default="23:59:59")
    s["free_text_time"] = f"""SELECT id, {start} AS start_time, {end} AS end_time,
        strftime({_DATE_PARSE}::DATE, {_DAY}) || ' ' || {start} AS start_ts FROM mess"""
    s["calendar_features"] = f"""SELECT id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, strftime(ts, {_DAY}) AS date,
        strftime(ts, '%H:%M:%S') AS time, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday,
        round(hour(ts) + minute(ts) / 60 + second(ts) / 3600, 6) AS decimal_hour,
        round(date_diff('day', DATE '0001-01-01', ts::DATE) + 1
              + (hour(ts) + minute(ts) / 60 + second(ts) / 3600) / 24, 6) AS ordinal_datetime,
        (minute(ts) + 60 * hour(ts))::INTEGER AS minute_of_day FROM ev"""
    s["filter_window_prefix"] = f"""SELECT id, zone, strftime(ts, {_TS}) AS ts FROM od
        WHERE zone LIKE '0001%' AND ts >= TIMESTAMP '1996-05-01' AND ts < TIMESTAMP '1997-07-01'"""
    s["filter_membership"] = """SELECT id, work_type FROM mess
        WHERE work_type IS NULL OR work_type NOT IN ('Works', 'LD')"""
    s["latest_events"] = f"""SELECT id, type, strftime(ts, {_TS}) AS ts FROM ev ORDER BY ev.ts DESC, id DESC LIMIT 10"""
    return {name: _VIEWS + body for name, body in s.items()}


def _profiles() -> dict[str, str]:
    weekday = "(SELECT c.*, z.region FROM clustered c JOIN zone_dim z USING (zone) WHERE weekday < 5)"
    matched = "(SELECT count(*) AS n FROM bc GROUP BY b_id)"
    whole = _histogram(matched, "n", 200)
    density = f"""{_VIEWS},
    known AS (SELECT CASE WHEN daily >= 3 THEN 'clustered' ELSE 'single' END AS g, ordinal AS v FROM ordinals),
    span AS (SELECT g, count(*) AS n, h, min(v) - 3 * h AS lo, (max(v) - min(v) + 6 * h) / 3649 AS step
             FROM known JOIN (VALUES ('clustered', 3.0::DOUBLE), ('single', 0.5::DOUBLE)) t(g, h) USING (g) GROUP BY g, h),
    placed AS (SELECT g, floor((v - lo) / step)::BIGINT AS cell, (v - lo) / step AS p FROM known JOIN span USING (g)),
    weights AS (SELECT g, cell, sum(w) AS w FROM (
      SELECT g, cell, 1 - (p - cell) AS w FROM placed UNION ALL SELECT g, cell + 1, p - cell FROM placed) GROUP BY g, cell)
    SELECT g AS "group", point, round(lo + point * step, 6) AS x,
      round(sum(w * exp(-0.5 * pow((point - cell) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
    FROM weights JOIN span USING (g) CROSS JOIN generate_series(0, 3649) t(point) GROUP BY g, point, lo, step, n, h"""
    return {
        "histogram_by_group": _histogram(weekday, "decimal_hour", 24, "region", "0.0::DOUBLE AS lo, 24.0::DOUBLE AS hi"),
        "histogram_own_range": _histogram("ev", "value", 48, "type"),
        "histogram_of_matches": f'SELECT bin, lower, upper, n FROM ({whole})',
        "density_curve": density,
    }


def oracle_sql() -> dict[str, str]:
    return {**_statements(), **_profiles()}
