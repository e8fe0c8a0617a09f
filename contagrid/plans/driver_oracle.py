"""The same results as SQL over the raw tables, for comparison in DuckDB.

Written independently of the operators: joins, filters and grouping sets only.
``SHARED`` holds the common table expressions, each naming those it reads.
"""

from __future__ import annotations

from contagrid import fixed_values
from contagrid.fixed_values import WEEKLY_LINES
from contagrid.functions.text import slug

SETTINGS = list(fixed_values.SETTINGS)
ALL_SETTINGS = [*SETTINGS, fixed_values.SCHOOL_SETTING, fixed_values.UNKNOWN_SETTING]
OUTCOMES = list(fixed_values.OUTCOMES)
SETTING_COLUMNS = [slug(x) for x in SETTINGS]
OUTCOME_COLUMNS = [slug(x) for x in OUTCOMES]
LABELS = list(fixed_values.OUTCOME_LABELS)
BANDS = [label for label, _, _ in fixed_values.AGE_BANDS]


def items(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pct(a, b, digits=1):
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100, {digits})"


def ratio(a, b, digits=1):
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits})"


def number_text(value: str) -> str:
    return rf"regexp_replace(CAST(CAST({value} AS DECIMAL(38, 3)) AS VARCHAR), '\.?0+$', '')"


def counts(column, levels, names, other="unknown"):
    out = [f"CAST(count(*) FILTER (WHERE {column} = '{v}') AS BIGINT) AS {n}" for v, n in zip(levels, names)]
    out.append(f"CAST(count(*) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in levels)})) AS BIGINT) AS {other}")
    return ", ".join(out)


def rolled(key, alias=None):
    alias = alias or key
    return f"CASE WHEN grouping(t.{key}) = 1 THEN 'Totals' ELSE t.{key} END AS {alias}, grouping(t.{key}) = 1 AS is_total"


SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "nations": ((), "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "cases": (
        (),
        """SELECT c_custkey AS cip, n_name AS sve, c_mktsegment AS origin,
             CAST(coalesce(u.k, 0) AS DOUBLE) AS n_contacts
           FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
           LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u
             ON u.o_custkey = c_custkey""",
    ),
    "contacts": (
        (),
        f"""SELECT o_orderkey AS contact_id, o_custkey AS case_cip, n_name AS sve,
             ({items(ALL_SETTINGS)})[(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) * 2 + o_custkey % 2 + 1] AS setting,
             ({items(OUTCOMES)})[(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 4 + o_orderkey % 4 + 1] AS outcome,
             (['Sí', 'No'])[o_orderkey % 3 + 1] AS symptoms_day0,
             CASE WHEN o_orderkey % 20 IN (0, 1, 2, 3) THEN NULL
                  WHEN o_orderkey % 20 = 4 AND day(born) <= 12 THEN make_date(year(born), day(born), month(born))
                  ELSE born END AS birth_date
           FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_custkey % 100 * 12 AS INT)) AS DATE) AS born0,
                   CASE WHEN CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_custkey % 100 * 12 AS INT)) AS DATE) >= DATE '1901-01-01'
                     THEN CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_custkey % 100 * 12 AS INT)) AS DATE) END AS born FROM orders) o
           LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "aged": (
        ("contacts",),
        f"""SELECT *, CASE WHEN age < 12 THEN '{BANDS[0]}' WHEN age < 20 THEN '{BANDS[1]}' WHEN age < 40 THEN '{BANDS[2]}'
             WHEN age < 60 THEN '{BANDS[3]}' WHEN age < 80 THEN '{BANDS[4]}' WHEN age >= 80 THEN '{BANDS[5]}' END AS age_band
           FROM (SELECT *, date_sub('year', birth_date, DATE '2003-06-15') AS age FROM contacts)""",
    ),
    "base": (
        ("aged",),
        "SELECT * FROM aged WHERE setting NOT IN ('escolar', 'desconegut') AND age_band IS NOT NULL",
    ),
    "gazetteer": (
        (),
        """SELECT upper(p_brand || '/' || p_size) AS place_name, n_name AS sve, p_partkey AS source_row,
             CASE p_type WHEN 'STANDARD' THEN 'Municipi' WHEN 'PROMO' THEN 'Barri' WHEN 'ECONOMY' THEN 'Veïnat'
               WHEN 'MEDIUM' THEN 'Caseria' WHEN 'LARGE' THEN 'Masia' END AS category
           FROM part LEFT JOIN nation ON p_partkey % 25 = n_nationkey""",
    ),
    "persons": (
        ("nations",),
        """SELECT CAST(o_orderkey AS VARCHAR) AS cip,
             CASE WHEN o_orderkey % 17 = 0 THEN 'NULL' WHEN o_orderkey % 19 = 0 THEN NULL
               ELSE upper('Brand#' || (o_custkey % 25 + 1) || '/' || (o_orderkey % 50 + 1)) END AS municipality,
             CASE WHEN o_orderkey % 10 = 0 THEN 'UVE' || (o_custkey % 30) END AS unit,
             CASE WHEN o_orderkey % 7 <> 0 THEN r_name END AS region
           FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nations ON c_nationkey = n_nationkey""",
    ),
    "places": (
        ("gazetteer",),
        """SELECT place_name,
             CASE WHEN count(*) FILTER (WHERE category IN ('Municipi', 'Poble')) > 0 THEN 'settlement'
               WHEN count(*) = 1 OR (count(*) = 2 AND count(*) > count(category)) THEN 'unique' ELSE 'ambiguous' END AS place_class,
             arg_min(sve, source_row) FILTER (WHERE category IN ('Municipi', 'Poble')) AS settlement_sve,
             arg_min(sve, source_row) AS first_sve
           FROM gazetteer GROUP BY place_name""",
    ),
    "resolved": (
        ("persons", "places", "gazetteer", "nations"),
        """SELECT cip, municipality, place_name, region,
             coalesce(by_unit, settlement_sve, CASE WHEN place_class = 'unique' AND NOT silent THEN first_sve END,
               CASE WHEN place_class = 'ambiguous' AND in_region THEN by_region END,
               CASE WHEN place_class = 'ambiguous' THEN first_sve END, by_region) AS sve,
             CASE WHEN by_unit IS NOT NULL THEN 'uve' WHEN settlement_sve IS NOT NULL THEN 'settlement'
               WHEN place_class = 'unique' AND NOT silent THEN 'unique_name'
               WHEN place_class = 'ambiguous' AND in_region THEN 'name_and_region'
               WHEN place_class = 'ambiguous' THEN 'first_name' WHEN by_region IS NOT NULL THEN 'region' END AS sve_source
           FROM (
             SELECT p.cip, p.municipality, p.name AS place_name, p.region, u.n_name AS by_unit, r.n_name AS by_region,
               d.place_class, d.settlement_sve, d.first_sve,
               p.name = 'NULL' AND p.region IS NOT NULL AS silent,
               g.place_name IS NOT NULL AS in_region
             FROM (SELECT *, CASE WHEN municipality = 'BRAND#1/1' THEN 'BRAND#2/2' ELSE municipality END AS name FROM persons) p
             LEFT JOIN nations u ON p.unit = 'UVE' || u.n_nationkey
             LEFT JOIN (SELECT r_name, arg_min(n_name, n_nationkey) AS n_name FROM nations GROUP BY 1) r ON p.region = r.r_name
             LEFT JOIN places d ON p.name = d.place_name
             LEFT JOIN (SELECT DISTINCT place_name, sve FROM gazetteer) g ON p.name = g.place_name AND g.sve = r.n_name)""",
    ),
    "ind": (
        ("cases",),
        f"""SELECT {rolled('sve')}, count(*) AS cases, nullif(count(*) FILTER (WHERE n_contacts > 0), 0) AS reporting_cases,
             {pct('nullif(count(*) FILTER (WHERE n_contacts > 0), 0)', 'count(*)')} AS reporting_pct,
             {ratio('sum(n_contacts) FILTER (WHERE n_contacts > 0)', 'count(*) FILTER (WHERE n_contacts > 0)')} AS contacts_per_case,
             sum(n_contacts) FILTER (WHERE n_contacts > 0) AS total_contacts,
             round(avg(n_contacts) FILTER (WHERE n_contacts > 0), 1) AS mean_contacts,
             quantile_cont(n_contacts, 0.5) FILTER (WHERE n_contacts > 0) AS median_contacts,
             quantile_cont(n_contacts, 0.75) FILTER (WHERE n_contacts > 0) - quantile_cont(n_contacts, 0.25) FILTER (WHERE n_contacts > 0) AS iqr_contacts,
             quantile_cont(n_contacts, 0.25) FILTER (WHERE n_contacts > 0) AS q25_contacts,
             quantile_cont(n_contacts, 0.75) FILTER (WHERE n_contacts > 0) AS q75_contacts,
             min(n_contacts) FILTER (WHERE n_contacts > 0) AS min_contacts, max(n_contacts) FILTER (WHERE n_contacts > 0) AS max_contacts
           FROM cases t GROUP BY ROLLUP (t.sve)""",
    ),
    "became": (
        ("contacts", "ind"),
        f"""SELECT {rolled('sve')}, CAST(sum(no_n) AS BIGINT) AS no_n, CAST(sum(yes_n) AS BIGINT) AS yes_n,
             CAST(sum(total_n) AS BIGINT) AS total_n, {pct('sum(no_n)', 'sum(no_n) + sum(yes_n)')} AS no_pct,
             {pct('sum(yes_n)', 'sum(no_n) + sum(yes_n)')} AS yes_pct
           FROM (SELECT y.sve, y.k AS yes_n, coalesce(cases, 0) AS total_n, coalesce(cases - k, 0) AS no_n
             FROM (SELECT sve, count(*) AS k FROM contacts WHERE outcome = 'és cas' GROUP BY 1) y
             LEFT JOIN ind i ON i.sve = y.sve AND NOT i.is_total) t GROUP BY ROLLUP (t.sve)""",
    ),
    "event_rows": (
        (),
        """SELECT *, n_name AS sve, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS snapshot_week
           FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey""",
    ),
    "slots": (
        ("event_rows",),
        """SELECT * FROM (
             SELECT event_id, sve, snapshot_week, 1 AS slot,
               CASE event_type WHEN 'click' THEN 'Realitzat' WHEN 'view' THEN 'Realitzat' WHEN 'purchase' THEN 'Pendent'
                 WHEN 'signup' THEN 'Anul·lat' END AS status,
               day + ([7, 10, 14, 8])[event_id % 4 + 1] AS slot_day, ([7, 10, 14, 8])[event_id % 4 + 1] AS day_offset,
               (['No', 'Sí'])[event_id % 3 + 1] AS isolated, (['motiu 0', 'motiu 1', 'motiu 2'])[event_id % 4 + 1] AS reason,
               CASE WHEN event_id % 7 < 3 THEN 'Sí' WHEN event_id % 7 < 6 THEN 'No' END AS symptoms
             FROM event_rows
             UNION ALL
             SELECT event_id, sve, snapshot_week, 2,
               (['Realitzat', 'Realitzat', 'Pendent', 'Anul·lat'])[event_id % 5 + 1],
               day + ([10, 7, 14, 10, 3, 14])[event_id % 6 + 1], ([10, 7, 14, 10, 3, 14])[event_id % 6 + 1],
               (['No', 'Sí'])[event_id % 2 + 1], (['motiu 0', 'motiu 1', 'motiu 2'])[user_id % 4 + 1],
               CASE WHEN user_id % 7 < 3 THEN 'Sí' WHEN user_id % 7 < 6 THEN 'No' END
             FROM event_rows)
           WHERE status IN ('Realitzat', 'Pendent') AND slot_day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'""",
    ),
    "allowed": (
        ("slots",),
        """SELECT * FROM slots WHERE (day_offset = 7 AND snapshot_week = DATE '2024-01-08')
             OR (day_offset = 10 AND snapshot_week IN (DATE '2024-01-08', DATE '2024-01-01'))
             OR (day_offset = 14 AND snapshot_week = DATE '2024-01-01')""",
    ),
    "by_status": (
        ("allowed",),
        """SELECT sve, status, count(DISTINCT event_id) FILTER (WHERE day_offset = 7) AS day7,
             count(DISTINCT event_id) FILTER (WHERE day_offset = 10) AS day10,
             count(DISTINCT event_id) FILTER (WHERE day_offset = 14) AS day14 FROM allowed GROUP BY 1, 2""",
    ),
    "evolution": (
        ("allowed", "event_rows"),
        f"""SELECT symptoms, sve, is_total, day0, day7, day10, day14, day0 + day7 + day10 + day14 AS total FROM (
             SELECT symptoms, {rolled('sve')}, CAST(count(*) FILTER (WHERE d = 0) AS BIGINT) AS day0,
               CAST(count(*) FILTER (WHERE d = 7) AS BIGINT) AS day7, CAST(count(*) FILTER (WHERE d = 10) AS BIGINT) AS day10,
               CAST(count(*) FILTER (WHERE d = 14) AS BIGINT) AS day14
             FROM (SELECT sve, symptoms, day_offset AS d FROM allowed WHERE symptoms IS NOT NULL
               UNION ALL SELECT sve, CASE event_type WHEN 'click' THEN 'Sí' ELSE 'No' END, 0 FROM event_rows
               WHERE event_type IN ('click', 'view') AND snapshot_week = DATE '2024-01-15') t
             GROUP BY GROUPING SETS ((symptoms, t.sve), (symptoms)))""",
    ),
    "measures": (
        ("ind", "evolution", "became"),
        """SELECT sve, coalesce(cases, 0) AS cases, coalesce(total_contacts, 0) AS contacts, coalesce(e.total, 0) AS symptomatic,
             coalesce(yes_n, 0) AS confirmed
           FROM (SELECT * FROM ind WHERE NOT is_total)
           FULL JOIN (SELECT * FROM evolution WHERE symptoms = 'Sí' AND NOT is_total) e USING (sve)
           FULL JOIN (SELECT * FROM became WHERE NOT is_total) b USING (sve)""",
    ),
    "verified": (
        ("contacts",),
        """SELECT * FROM (SELECT sve, count(*) FILTER (WHERE outcome IN ('CIP vàlid', 'error dades', 'rebutja', 'CIP no vàlid')
               OR (outcome = 'no contesta' AND setting IS DISTINCT FROM 'escolar')) AS verified,
             count(*) FILTER (WHERE outcome = 'CIP vàlid') AS accepted FROM contacts GROUP BY 1) WHERE verified > 0""",
    ),
    "breakdown": (
        ("contacts",),
        f"""SELECT CASE grouping_id WHEN 0 THEN 'item' WHEN 1 THEN 'block' ELSE 'total' END AS kind, block, label, n,
             {pct('n', 'max(n) OVER ()')} AS pct, CAST(CASE WHEN grouping_id = 0 THEN ord ELSE 12 END AS INT) AS ord
           FROM (SELECT block, label, CAST(sum(n) AS BIGINT) AS n, grouping(block, label) AS grouping_id, max(ord) AS ord
             FROM (SELECT l.label, l.block, l.ord, count(c.label) AS n
               FROM (VALUES {', '.join(f"('{label}', '{block}', {i})" for i, (label, block) in enumerate(LABELS, 1))}) l(label, block, ord)
               LEFT JOIN (SELECT CASE WHEN outcome = 'no contesta' AND setting = 'escolar' THEN '{LABELS[9][0]}'
                   ELSE (CASE outcome WHEN 'CIP vàlid' THEN 'Cip vàlid' WHEN 'error dades' THEN 'Error dades' WHEN 'rebutja' THEN 'Rebutja'
                     WHEN 'no contesta' THEN 'No contesta' WHEN 'CIP no vàlid' THEN 'Cip no vàlid' WHEN 'és cas' THEN 'És cas'
                     WHEN 'contacte altre cas' THEN 'Contacte altre cas' WHEN 'migrat SVE' THEN 'Migrat SVE'
                     WHEN 'no és contacte' THEN 'No és contacte' WHEN 'contacte no vàlid' THEN 'No és contacte' END) END AS label
                 FROM contacts WHERE outcome IS NOT NULL) c ON c.label = l.label
               GROUP BY 1, 2, 3) GROUP BY GROUPING SETS ((block, label), (block), ()))""",
    ),
    "graphic": (
        ("ind", "verified", "by_status", "evolution", "became"),
        f"""SELECT sve, is_total, coalesce(cases, 0) AS cases, coalesce(reporting_cases, 0) AS reporting_cases,
             coalesce(reporting_pct, 0) AS reporting_pct, coalesce(total_contacts, 0) AS total_contacts,
             coalesce(mean_contacts, 0) AS mean_contacts, coalesce(verified, 0) AS verified, coalesce(accepted, 0) AS accepted,
             coalesce({pct('accepted', 'verified')}, 0) AS accepted_pct, coalesce(in_followup, 0) AS in_followup,
             coalesce(total, 0) AS symptomatic, coalesce({pct('total', 'in_followup')}, 0) AS symptomatic_pct,
             coalesce(yes_n, 0) AS confirmed, coalesce({pct('yes_n', 'total_n')}, 0) AS confirmed_pct
           FROM ind
           FULL JOIN (SELECT {rolled('sve')}, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(accepted) AS BIGINT) AS accepted,
               CAST(sum(accepted + coalesce(done, 0)) AS BIGINT) AS in_followup
             FROM (SELECT v.*, d.done FROM verified v LEFT JOIN (SELECT sve, sum(day7 + day10 + day14) AS done FROM by_status
               WHERE status = 'Realitzat' GROUP BY 1) d ON d.sve = v.sve) t GROUP BY ROLLUP (t.sve)) USING (sve, is_total)
           FULL JOIN (SELECT sve, is_total, total FROM evolution WHERE symptoms = 'Sí') USING (sve, is_total)
           FULL JOIN (SELECT sve, is_total, yes_n, total_n FROM became) USING (sve, is_total)""",
    ),
    "weeks": (
        ("event_rows",),
        """SELECT snapshot_week, sve, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error' AND floor(value) > 0) AS ci
           FROM event_rows GROUP BY 1, 2""",
    ),
    "change": (
        ("weeks",),
        f"""SELECT sve, is_total, informed, total - informed AS not_informed, total, {pct('informed', 'total')} AS informed_pct,
             {pct('total - informed', 'total')} AS not_informed_pct, {pct('p_ci', 'p_total')} AS previous_informed_pct,
             {pct('p_total - p_ci', 'p_total')} AS previous_not_informed_pct,
             round({pct('informed', 'total')} - {pct('p_ci', 'p_total')}, 1) AS change_points
           FROM (SELECT {rolled('sve')}, CAST(sum(ci) AS BIGINT) AS informed, CAST(sum(total) AS BIGINT) AS total FROM weeks t
             WHERE snapshot_week = DATE '2024-01-15' GROUP BY ROLLUP (t.sve))
           LEFT JOIN (SELECT {rolled('sve')}, sum(ci) AS p_ci, sum(total) AS p_total FROM weeks t
             WHERE snapshot_week = DATE '2024-01-08' GROUP BY ROLLUP (t.sve)) USING (sve, is_total)""",
    ),
    "national": (
        ("measures",),
        f"""SELECT {rolled('sve')}, CAST(sum(cases) AS BIGINT) AS cases, sum(contacts) AS contacts,
             CAST(sum(symptomatic) AS BIGINT) AS symptomatic, CAST(sum(confirmed) AS BIGINT) AS confirmed
           FROM (SELECT * REPLACE (CASE WHEN sve IN ('NATION_3', 'NATION_4') THEN 'NATION_3 i NATION_4' ELSE sve END AS sve)
             FROM measures) t GROUP BY ROLLUP (t.sve)""",
    ),
    "silent": (
        ("contacts",),
        f"""SELECT sve, is_total, n, {pct('n', 'max(n) OVER ()')} AS pct FROM (SELECT {rolled('sve')}, count(*) AS n FROM contacts t
           WHERE outcome = 'no contesta' AND setting = 'escolar' GROUP BY ROLLUP (t.sve))""",
    ),
}


def cte(*names: str, select: str) -> str:
    """A SELECT preceded by the needed common table expressions, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in SHARED[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SHARED[n][1]})" for n in order) + "\n" + select


def crosstab_totals(source, key, column, levels, names, extra=""):
    return f"SELECT {rolled(key)}, {counts(column, levels, names)}{extra} FROM {source} t GROUP BY ROLLUP (t.{key})"


SETTING_ROW = " + ".join(SETTING_COLUMNS) + " + unknown"
BAND_ORDER = f"CAST(coalesce(list_position({items(BANDS)}, age_band), 7) AS INT)"

ORACLE: dict[str, str] = {
    "typed_scan_distinct": "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events",
    "snapshot_week_filter": cte("event_rows", select="""SELECT snapshot_week, count(*) AS n FROM event_rows
        WHERE snapshot_week IN (DATE '2024-01-08', DATE '2024-01-01') GROUP BY 1"""),
    "not_equal_or_null": cte("contacts", select="""SELECT sve, setting, count(*) AS n FROM contacts
        WHERE setting IS DISTINCT FROM 'escolar' GROUP BY 1, 2"""),
    "outcome_exclusions": cte("verified", select="SELECT * FROM verified"),
    "previous_week_window": """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY 1""",
    "literal_fixes": """SELECT CASE p_name WHEN 'small ring' THEN 'ring' WHEN 'red widget' THEN 'widget' WHEN 'blue gear' THEN 'gear'
        ELSE p_name END AS place_name, count(*) AS n FROM part GROUP BY 1""",
    "invalid_dates_to_null": cte("contacts", select="SELECT contact_id, birth_date FROM contacts"),
    "row_difference": cte("contacts", select="""SELECT setting, outcome, count(*) AS n FROM contacts
        WHERE NOT (outcome IS NOT DISTINCT FROM 'no contesta' AND setting IS NOT DISTINCT FROM 'escolar') GROUP BY 1, 2"""),
    "membership_filter": cte("cases", "contacts", select="""SELECT cip, sve FROM cases
        WHERE cip IN (SELECT case_cip FROM contacts WHERE setting = 'escolar')"""),
    "cases_without_contacts": cte("cases", "contacts", select="""SELECT DISTINCT cip FROM cases WHERE n_contacts > 0
        AND cip NOT IN (SELECT case_cip FROM contacts WHERE setting = 'escolar')"""),
    "followup_placeholder": """SELECT 'Sense seguiments' AS sve, 'Sense seguiments' AS status, CAST(count(*) AS BIGINT) AS followup_day99
        FROM events WHERE ts < TIMESTAMP '1900-01-01'""",
    "followup_without_placeholder": cte("slots", select="""SELECT sve, status, count(DISTINCT event_id) AS followup_day7 FROM slots
        WHERE day_offset = 7 AND snapshot_week = DATE '2024-01-08' GROUP BY 1, 2"""),
    "drifting_text_weeks": cte("event_rows", select="""SELECT snapshot_week, count(*) FILTER (event_id % 50 <> 0) AS n_rows,
        count(*) FILTER (event_id % 50 <> 0 AND snapshot_week <> DATE '2024-01-08') AS n_users,
        count(*) FILTER (event_id % 50 <> 0 AND snapshot_week = DATE '2024-01-15') AS n_stamps,
        count(DISTINCT event_id) FILTER (event_id % 50 <> 0) AS n_events, count(*) FILTER (event_id % 50 = 0) AS n_malformed
        FROM event_rows WHERE snapshot_week BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 1"""),
    "first_match_lookup": cte("persons", "gazetteer", select="""SELECT cip, municipality, g.sve AS first_sve FROM persons
        LEFT JOIN (SELECT place_name, arg_min(sve, source_row) AS sve FROM gazetteer GROUP BY 1) g ON municipality = place_name"""),
    "coalesced_territory": cte("contacts", "places", select="""SELECT contact_id, coalesce(settlement_sve, c.sve) AS sve FROM contacts c
        JOIN orders ON contact_id = o_orderkey LEFT JOIN places ON place_name = CASE
          WHEN o_custkey % 25 = 0 AND o_orderkey % 50 = 0 THEN 'BRAND#2/2'
          ELSE upper('Brand#' || (o_custkey % 25 + 1) || '/' || (o_orderkey % 50 + 1)) END"""),
    "scalar_lookup": cte("nations", select="""SELECT s_suppkey, n_name AS sve, r_name AS province FROM supplier
        LEFT JOIN nations ON s_nationkey = n_nationkey"""),
    "region_disambiguation": cte("resolved", select="""SELECT place_name, region, sve, sve_source, count(*) AS n FROM resolved
        WHERE sve_source IN ('name_and_region', 'first_name') GROUP BY 1, 2, 3, 4"""),
    "place_classes": cte("places", select="SELECT * FROM places"),
    "resolve_territory": cte("resolved", select="SELECT cip, place_name, sve, sve_source FROM resolved"),
    "unresolved_places": cte("resolved", select="SELECT DISTINCT cip, municipality FROM resolved WHERE sve IS NULL"),
    "left_join_named_keys": """SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey""",
    "duplicate_case_territories": cte("gazetteer", select="""SELECT place_name, count(DISTINCT sve) AS n_values FROM gazetteer
        GROUP BY 1 HAVING count(DISTINCT sve) > 1"""),
    "full_join_zero_fill": cte("cases", select="""SELECT sve, coalesce(a, 0) AS poor_customers, coalesce(b, 0) AS poor_suppliers,
        coalesce(c, 0) AS heavy_cases
        FROM (SELECT n_name AS sve, count(*) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900 GROUP BY 1)
        FULL JOIN (SELECT n_name AS sve, count(*) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0 GROUP BY 1) USING (sve)
        FULL JOIN (SELECT sve, count(*) AS c FROM cases WHERE n_contacts >= 6 GROUP BY 1) USING (sve)"""),
    "full_join_two_keys": cte("contacts", select="""SELECT sve, outcome, count(*) FILTER (WHERE symptoms_day0 = 'Sí') AS ill,
        count(*) FILTER (WHERE setting = 'escolar') AS school FROM contacts
        WHERE symptoms_day0 = 'Sí' OR setting = 'escolar' GROUP BY 1, 2"""),
    "case_contact_indicators": cte("ind", select="""SELECT * REPLACE (round(q25_contacts, 2) AS q25_contacts,
        round(median_contacts, 2) AS median_contacts, round(q75_contacts, 2) AS q75_contacts, round(iqr_contacts, 2) AS iqr_contacts) FROM ind"""),
    "origin_split": cte("cases", select=f"""SELECT {rolled('sve')}, count(*) FILTER (WHERE origin = 'AUTOMOBILE') AS first_n,
        count(*) FILTER (WHERE origin = 'BUILDING') AS second_n, {pct("count(*) FILTER (WHERE origin = 'AUTOMOBILE')", 'count(*)')} AS first_pct,
        {pct("count(*) FILTER (WHERE origin = 'BUILDING')", 'count(*)')} AS second_pct, count(*) AS total
        FROM cases t WHERE origin IN ('AUTOMOBILE', 'BUILDING') GROUP BY ROLLUP (t.sve)"""),
    "contacts_per_case_distribution": cte("cases", select=f"""SELECT n_contacts, count(*) AS informed_cases,
        {pct('count(*)', 'sum(count(*)) OVER ()', 3)} AS pct FROM cases WHERE n_contacts > 0 GROUP BY 1"""),
    "school_split": cte("cases", "contacts", select=f"""SELECT {rolled('sve')}, CAST(sum(a) AS BIGINT) AS cases_with_school,
        CAST(sum(b) AS BIGINT) AS cases_without_school, CAST(sum(c) AS BIGINT) AS school_contacts, CAST(sum(d) AS BIGINT) AS other_contacts,
        coalesce({ratio('sum(c)', 'sum(a)')}, 0) AS school_ratio, coalesce({ratio('sum(d)', 'sum(b)')}, 0) AS other_ratio
        FROM (SELECT sve, CAST(s AS INT) AS a, CAST(NOT s AND n_contacts > 0 AS INT) AS b, 0 AS c, 0 AS d FROM (
            SELECT *, cip IN (SELECT case_cip FROM contacts WHERE setting = 'escolar') AS s FROM cases)
          UNION ALL SELECT sve, 0, 0, CAST(setting IS NOT DISTINCT FROM 'escolar' AS INT), CAST(setting IS DISTINCT FROM 'escolar' AS INT)
          FROM contacts) t GROUP BY ROLLUP (t.sve)"""),
    "heavy_reporters": cte("contacts", select=f"""SELECT c_custkey AS cip, (['dona', 'home'])[c_custkey % 3 + 1] AS gender,
        CAST(date_sub('year', CAST(DATE '2001-02-28' - to_months(CAST(c_custkey % 1100 AS INT)) AS DATE), DATE '2003-06-15') AS INT) AS age,
        'PLACE ' || (c_custkey % 40) AS place_name, n_name AS sve, CAST(k AS DOUBLE) AS n_contacts_reported, p.* EXCLUDE (case_cip)
        FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1 HAVING count(*) >= 20) JOIN customer ON c_custkey = o_custkey
        JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT case_cip, {counts('setting', ALL_SETTINGS, SETTING_COLUMNS + ['escolar', 'desconegut'])},
          count(*) AS n_contacts_listed FROM contacts GROUP BY 1) p ON p.case_cip = c_custkey"""),
    "became_cases": cte("became", select="SELECT * FROM became"),
    "sum_all_measures": """SELECT n_name AS sve, round(sum(s_acctbal), 2) AS s_acctbal, CAST(sum(s_suppkey) AS BIGINT) AS s_suppkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "setting_totals": cte("base", select="SELECT setting, count(*) AS n_contacts FROM base GROUP BY 1"),
    "setting_by_territory": cte("base", select=crosstab_totals("base", "sve", "setting", SETTINGS, SETTING_COLUMNS)),
    "setting_by_age_band": cte("base", select=f"""SELECT *, {BAND_ORDER} AS ord FROM (
        {crosstab_totals('base', 'age_band', 'setting', SETTINGS, SETTING_COLUMNS)})"""),
    "setting_by_territory_age": cte("base", select=f"""SELECT *, {SETTING_ROW} AS total FROM (
        SELECT sve, age_band, {counts('setting', SETTINGS, SETTING_COLUMNS)} FROM base GROUP BY 1, 2)"""),
    "setting_by_outcome": cte("base", select=crosstab_totals("base", "setting", "outcome", OUTCOMES, OUTCOME_COLUMNS)),
    "outcome_by_territory": cte("contacts", select=crosstab_totals("contacts", "sve", "outcome", OUTCOMES, OUTCOME_COLUMNS)),
    "outcome_totals": cte("contacts", select="SELECT outcome, count(*) AS n_contacts FROM contacts GROUP BY 1"),
    "outcome_breakdown_blocks": cte("breakdown", select="SELECT * FROM breakdown"),
    "school_no_answer": cte("silent", select="SELECT * FROM silent"),
    "followup_counts": cte("by_status", select="""SELECT sve, FALSE AS is_total, status, day7, day10, day14 FROM by_status
        UNION ALL SELECT 'Totals', TRUE, '---', CAST(sum(day7) AS BIGINT), CAST(sum(day10) AS BIGINT), CAST(sum(day14) AS BIGINT) FROM by_status"""),
    "followup_single_slot": cte("slots", select="""SELECT sve, status, count(DISTINCT event_id) AS followup_day7 FROM slots
        WHERE slot = 1 AND day_offset = 7 AND snapshot_week = DATE '2024-01-08' GROUP BY 1, 2"""),
    "followup_reasons": cte("allowed", select="""SELECT sve, reason, count(*) FILTER (WHERE day_offset = 7) AS day7,
        count(*) FILTER (WHERE day_offset = 10) AS day10, count(*) FILTER (WHERE day_offset = 14) AS day14
        FROM allowed WHERE isolated = 'No' GROUP BY 1, 2"""),
    "symptom_evolution": cte("evolution", select="SELECT * EXCLUDE (symptoms) FROM evolution WHERE symptoms = 'Sí'"),
    "asymptomatic_evolution": cte("evolution", select="SELECT * EXCLUDE (symptoms) FROM evolution WHERE symptoms = 'No'"),
    "union_reaggregate": cte("slots", select="""SELECT sve, status, count(DISTINCT event_id) AS followup_day10 FROM slots
        WHERE day_offset = 10 AND snapshot_week IN (DATE '2024-01-08', DATE '2024-01-01') GROUP BY 1, 2"""),
    "week_over_week": cte("change", select="SELECT * FROM change"),
    "informed_unpivot": cte("change", select="""SELECT sve, 'I_SE3' AS state, informed_pct AS pct FROM change WHERE NOT is_total
        UNION ALL SELECT sve, 'I_SE2', previous_informed_pct FROM change WHERE NOT is_total
        UNION ALL SELECT sve, 'NI_SE3', not_informed_pct FROM change WHERE NOT is_total
        UNION ALL SELECT sve, 'NI_SE2', previous_not_informed_pct FROM change WHERE NOT is_total"""),
    "history_upsert": cte("weeks", select="""SELECT sve, ci, total - ci AS cni, CAST(2024 AS INT) AS iso_year,
        CAST(week(snapshot_week) AS INT) AS iso_week FROM weeks WHERE snapshot_week IN (DATE '2024-01-08', DATE '2024-01-15')"""),
    "weekly_cubes": cte("ind", select="""SELECT * REPLACE (round(q25_contacts, 2) AS q25_contacts,
        round(median_contacts, 2) AS median_contacts, round(q75_contacts, 2) AS q75_contacts, round(iqr_contacts, 2) AS iqr_contacts) FROM ind""").replace(
        f"cases AS ({SHARED['cases'][1]})",
        """cases AS (SELECT event_id AS cip, n_name AS sve, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END AS n_contacts
           FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey
           WHERE CAST(date_trunc('week', ts) AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-15')"""),
    "order_quartiles": """SELECT grouping(nation) = 1 AS is_total, nation, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
        round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75
        FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY ROLLUP (nation)""",
    "running_cases": """SELECT event_id, event_type, CAST(sum(CAST(floor(value) > 0 AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM events""",
    "digest_distinct": "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events",
    "missing_key_lookup": cte("persons", "gazetteer", select="""SELECT cip, municipality, g.sve AS first_sve FROM persons
        LEFT JOIN (SELECT place_name, arg_min(sve, source_row) AS sve FROM gazetteer GROUP BY 1) g ON municipality = place_name"""),
    "province_rollup": cte("measures", "nations", select=f"""SELECT {rolled('province')}, CAST(sum(cases) AS BIGINT) AS cases,
        round(sum(contacts), 2) AS contacts, CAST(sum(symptomatic) AS BIGINT) AS symptomatic, CAST(sum(confirmed) AS BIGINT) AS confirmed
        FROM (SELECT m.*, r_name AS province FROM measures m LEFT JOIN nations ON sve = n_name) t GROUP BY ROLLUP (t.province)"""),
    "published_report": cte("measures", "nations", select=f"""SELECT CASE WHEN grouping(t.province) = 1 THEN 'Totals' ELSE t.province END AS "Provincia",
        CAST(sum(cases) AS BIGINT) AS "Casos notificats", round(sum(contacts), 2) AS "Total de CE",
        CAST(sum(symptomatic) AS BIGINT) AS "CE que desenvolupen símptomes", CAST(sum(confirmed) AS BIGINT) AS "CE que es confirmen com a Casos"
        FROM (SELECT m.*, r_name AS province FROM measures m LEFT JOIN nations ON sve = n_name) t GROUP BY ROLLUP (t.province)"""),
    "indicator_sheet": cte("ind", select=rf"""SELECT sve AS "SVE", cases AS "1.1-casos_totals", reporting_cases AS "1.2-N_casos_reporten_contactes",
        {number_text('reporting_pct')} || '%' AS "1.3-%casos amb contactes", total_contacts AS "2.1-N total de CE", mean_contacts AS "2.2-Mitjana",
        median_contacts AS "2.2Mediana", {number_text('iqr_contacts')} || ' (' || {number_text('q25_contacts')} || '-' || {number_text('q75_contacts')} || ')' AS "2.2-IQR",
        min_contacts AS "2.2-Min", max_contacts AS "2.2-max" FROM ind"""),
    "chart_legend": cte("base", select="""SELECT age_band, upper(setting[1]) || setting[2:] AS setting, count(*) AS n_contacts,
        round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY age_band) AS DOUBLE), 6) AS share FROM base GROUP BY age_band, base.setting"""),
    "national_summary": cte("national", select=f"SELECT *, {pct('cases', 'max(cases) OVER ()')} AS cases_pct FROM national"),
    "national_summary_es": cte("national", select="""SELECT CASE WHEN is_total THEN 'Total' ELSE sve END AS "Subdivisión territorial epidemiológica",
        cases AS "Número total de casos notificados", contacts AS "Número total de contactos estrechos",
        symptomatic AS "Número de contactos estrechos que desarrollan síntomas",
        confirmed AS "Número de contactos estrechos que se confirman como casos" FROM national"""),
    "written_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS read FROM orders",
    "unreadable_dates": """SELECT 'orders' AS source, 'written' AS "column", count(*) AS n_written,
        count(*) FILTER (WHERE o_orderkey % 6 = 5) AS n_unreadable FROM orders""",
    "single_measures": cte("evolution", "became", select="""SELECT sve, is_total, coalesce(total, 0) AS symptomatic,
        coalesce(yes_n, 0) AS confirmed FROM (SELECT * FROM evolution WHERE symptoms = 'Sí') FULL JOIN became USING (sve, is_total)"""),
    "infographic": cte("graphic", select="SELECT * FROM graphic"),
    "running_share": cte("base", select=f"""SELECT setting, n_contacts, pct, round(running_pct, 2) AS running_pct,
        round(running_pct - pct / 2, 2) AS label_position FROM (
        SELECT *, sum(pct) OVER (ORDER BY setting ROWS UNBOUNDED PRECEDING) AS running_pct FROM (
          SELECT setting, count(*) AS n_contacts, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM base GROUP BY 1))"""),
    "reverse_running_share": cte("breakdown", select="""SELECT ord, label, n, pct, round(running_pct, 2) AS running_pct,
        round(sum(pct) OVER () - running_pct + pct / 2, 2) AS label_position FROM (
        SELECT *, sum(pct) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS running_pct FROM breakdown WHERE kind = 'item')"""),
    "share_in_group": cte("base", select="""SELECT age_band, setting, count(*) AS n_contacts,
        round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY age_band) AS DOUBLE), 6) AS share FROM base GROUP BY 1, 2"""),
    "territory_names": """SELECT 'UVE' || n_nationkey AS uve, CASE n_name WHEN 'NATION_1' THEN 'NATION_1 Ciutat'
        WHEN 'NATION_7' THEN 'NATION_78' WHEN 'NATION_8' THEN 'NATION_78' ELSE n_name END AS sve FROM nation""",
    "scalar_text": """SELECT page_id, upper(url) AS upper_case, upper(substr(url, 1, 1)) || lower(substr(url, 2)) AS sentence,
        regexp_replace(url, 'th', 'TH') AS first_replaced,
        regexp_replace(regexp_replace(url, '\\.example', '.sample', 'g'), 'x$', 'y') AS all_replaced,
        '(' || url || ')' AS in_brackets, 'ab' || url AS no_commas, 'Migrat SVE ' || page_id AS label,
        rtrim(rtrim(CAST(CAST(page_id / 8.0 AS DECIMAL(38, 3)) AS VARCHAR), '0'), '.') AS number_text, page_id || '%' AS percent_text
        FROM pages""",
    "scalar_dates": """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, isoyear(o_orderdate) AS iso_year,
        week(o_orderdate) AS iso_week, CAST(o_orderdate AS DATE) AS from_text,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '2003-06-15') AS days_since,
        CAST(date_trunc('week', o_orderdate) AS DATE) - 7 AS previous_monday FROM orders""",
    "scalar_numbers": """SELECT c_custkey, number, round(number / 7 * 100, 1) AS pct, round(number / nullif(c_custkey % 4, 0), 2) AS ratio,
        coalesce(number, 0) + 1 AS total FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS number FROM customer)""",
    "age_years": cte("aged", select="SELECT age, age_band, count(*) AS n FROM aged GROUP BY 1, 2"),
    "totals_last_sort": cte("ind", select="""SELECT sve, is_total, cases, row_number() OVER (ORDER BY is_total, sve) AS position FROM ind"""),
    "level_order_sort": cte("base", select=f"""SELECT setting, n_contacts, row_number() OVER (ORDER BY list_position({items(SETTINGS)}, setting)) AS position
        FROM (SELECT setting, count(*) AS n_contacts FROM base GROUP BY 1)"""),
    "measure_order_sort": cte("contacts", select="""SELECT outcome, n_contacts,
        row_number() OVER (ORDER BY n_contacts DESC, outcome NULLS LAST) AS position
        FROM (SELECT outcome, count(*) AS n_contacts FROM contacts GROUP BY 1)"""),
    "append_category_row": cte("base", select="""SELECT setting, count(*) AS n_contacts FROM base GROUP BY 1
        UNION ALL SELECT 'Totals', CAST(count(*) AS BIGINT) FROM base"""),
    "pivot_settings": cte("contacts", select=f"""SELECT case_cip, {counts('setting', ALL_SETTINGS, SETTING_COLUMNS + ['escolar', 'desconegut'])},
        count(*) AS row_total FROM contacts GROUP BY 1"""),
}

GRAPHIC_MEASURES = [
    "cases", "reporting_cases", "reporting_pct", "total_contacts", "mean_contacts", "verified", "accepted", "accepted_pct",
    "in_followup", "symptomatic", "symptomatic_pct", "confirmed", "confirmed_pct",
]
ORACLE["infographic_transpose"] = cte("graphic", select="\nUNION ALL ".join(
    "SELECT '{m}' AS measure, {cols} FROM graphic".format(
        m=m,
        cols=", ".join(
            f"CAST(max({m}) FILTER (WHERE sve = '{k}') AS DOUBLE) AS \"{k}\"" for k in [f"NATION_{i}" for i in range(25)] + ["Totals"]
        ),
    )
    for m in GRAPHIC_MEASURES
))


def weekly_line(ord_: int, label: str, measure: str | None, style: str | None) -> str:
    label = label.replace("'", "''")
    if measure is None:
        return f"SELECT {ord_} AS ord, '{label}' AS label, CAST(NULL AS VARCHAR) AS measure, CAST(NULL AS DOUBLE) AS value, '' AS value_text"
    text = {
        "number": number_text(measure),
        "percent": f"{number_text(measure)} || '%'",
        "text": f"{number_text('median_contacts')} || ' (' || {number_text('q25_contacts')} || '-' || {number_text('q75_contacts')} || ')'"
        if measure == "median_contacts"
        else f"'(' || {number_text('min_contacts')} || '-' || {number_text('max_contacts')} || ')'",
    }[style]
    return f"SELECT {ord_} AS ord, '{label}' AS label, '{measure}' AS measure, CAST({measure} AS DOUBLE) AS value, {text} AS value_text FROM one"


ORACLE["weekly_summary"] = cte("graphic", "breakdown", "silent", select="""
    SELECT 2024 AS iso_year, 3 AS iso_week, ord, label, measure, round(value, 2) AS value, value_text FROM (
    """ + "\nUNION ALL ".join(weekly_line(*line) for line in WEEKLY_LINES) + ")")
ORACLE["weekly_summary"] = ORACLE["weekly_summary"].replace("\n\n    SELECT 2024", f""",
one AS (SELECT g.*, i.median_contacts, i.q25_contacts, i.q75_contacts, i.min_contacts, i.max_contacts,
      (SELECT n FROM breakdown WHERE kind = 'total') AS all_outcomes,
      (SELECT n FROM breakdown WHERE kind = 'block' AND block = 'a') AS block_a,
      (SELECT n FROM breakdown WHERE kind = 'block' AND block = 'b') AS block_b,
      {pct('g.accepted', 'g.verified - (SELECT n FROM silent WHERE is_total)')} AS accepted_pct_no_school
    FROM graphic g JOIN ind i ON i.is_total AND g.is_total)
    SELECT 2024""", 1)
