"""DuckDB texts that compute the same results as ``plans.catalog``.

The stand-in views are repeated here as CTEs over the raw test tables, so
each text runs on a DuckDB connection that has only those tables.
"""

from __future__ import annotations

VIEWS = {
    "companies": """
  SELECT c_custkey AS company_id, c_name AS company_name,
         CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'IT' || CAST(c_custkey % 1200 AS VARCHAR) END
           AS vat_number,
         c_mktsegment AS contact_name,
         lower(replace(c_name, '#', '.') || '@example.org') AS contact_email,
         '+39 ' || CAST(c_nationkey AS VARCHAR) AS contact_phone,
         '' AS note,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_sole_trader
  FROM customer""",
    "roles": """
  SELECT s_suppkey AS role_id, s_name AS role_name FROM supplier""",
    "workers": """
  SELECT o_orderkey AS worker_id, substr(o_orderpriority, 3) AS given_name,
         'S' || CAST(o_orderkey % 997 AS VARCHAR) AS surname, o_custkey AS company_id,
         CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 137 END AS role_id,
         CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS badge_issued,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS expiry_date,
         CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS record_updated,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END
           AS badge_valid,
         o_orderstatus AS note,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END
           AS badge_cancelled,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_temporary,
         CASE WHEN o_orderstatus = 'P' THEN 'T' || CAST(o_orderkey AS VARCHAR) ELSE '' END
           AS badge_number
  FROM orders""",
    "recipients": """
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'weekly' ELSE 'expired' END AS list_name,
         CASE WHEN s_suppkey % 10 = 5 THEN '  '
              ELSE lower(replace(s_name, '#', '.') || '@example.org') END AS email
  FROM supplier""",
}

AS_OF = "DATE '1998-06-30'"
SECTION = ("CASE WHEN coalesce(is_temporary, 0) <> 0 THEN 'temporary' "
           "ELSE 'permanent' END")


def with_views(*names: str, extra: dict | None = None) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def ddate(col: str) -> str:
    return f"coalesce(strftime({col}, '%d/%m/%Y'), '')"


def is_set(col: str) -> str:
    return f"coalesce({col} = 1, false)"


ROSTER = """
  SELECT w.*, c.company_name, r.role_name
  FROM workers w JOIN companies c ON w.company_id = c.company_id
  LEFT JOIN roles r ON w.role_id = r.role_id"""

EXPIRED = f"""
  SELECT w.worker_id, w.given_name, w.surname, c.company_name, w.expiry_date,
         w.is_temporary, {SECTION} AS section, {ddate('w.expiry_date')} AS expiry_text
  FROM workers w JOIN companies c ON w.company_id = c.company_id
  WHERE w.expiry_date <= {AS_OF} AND w.badge_issued = 1 AND w.badge_cancelled = 0
    AND w.badge_valid = 1"""

WEEKLY = f"""
  SELECT worker_id, coalesce(company_name, '') AS company_name,
         coalesce(given_name, '') AS given_name, coalesce(surname, '') AS surname,
         coalesce(role_name, '') AS role_name, {ddate('expiry_date')} AS expiry_text,
         {SECTION} AS section
  FROM roster WHERE badge_valid = 1 AND badge_cancelled = 0"""

FULL = f"""
  SELECT worker_id, company_name, given_name, surname, coalesce(role_name, '') AS role_name,
         {ddate('expiry_date')} AS expiry_text,
         CASE WHEN badge_issued <> 0 THEN 'X' ELSE '' END AS issued_mark,
         CASE WHEN badge_valid <> 0 THEN 'X' ELSE '' END AS valid_mark
  FROM roster"""

WCR = ("workers", "companies", "roles")


def _widths(report: str, source: str, cols: list, headers: list, pad: int, cap=None,
            fixed=(), skip_empty=False) -> str:
    rows = []
    for i, (c, h) in enumerate(zip(cols, headers)):
        if i in fixed:
            w = f"{len(h)}"
        else:
            text = f"nullif(CAST({c} AS VARCHAR), '')" if skip_empty \
                else f"coalesce(CAST({c} AS VARCHAR), '')"
            m = f"coalesce(max(length({text})), 0)"
            if cap is not None:
                m = f"least({m}, {cap})"
            w = f"greatest({len(h)}, {m}) + {pad}"
        src = "" if i in fixed else f" FROM {source}"
        rows.append(f"SELECT {i} AS column_index, '{h}' AS header, CAST({w} AS INTEGER) AS width,"
                    f" '{report}' AS report{src}")
    return "\nUNION ALL ".join(rows)


def _list_workers(where: str) -> str:
    return with_views(*WCR, extra={"roster": ROSTER}) + f"""
  SELECT worker_id, company_name, given_name, surname, coalesce(role_name, '') AS role_name,
         coalesce(note, '') AS note, {ddate('expiry_date')} AS expiry_text,
         coalesce(badge_number, '') AS badge_number,
         {is_set('badge_issued')} AS issued, {is_set('record_updated')} AS updated,
         {is_set('badge_valid')} AS valid, {is_set('badge_cancelled')} AS cancelled,
         {is_set('is_temporary')} AS temporary
  FROM roster WHERE {where}"""


def _list_companies(where: str) -> str:
    return with_views("companies") + f"""
  SELECT company_id, company_name, coalesce(vat_number, '') AS vat_number,
         coalesce(contact_name, '') AS contact_name, coalesce(contact_email, '') AS contact_email,
         coalesce(contact_phone, '') AS contact_phone, coalesce(note, '') AS note,
         {is_set('is_sole_trader')} AS sole_trader
  FROM companies WHERE {where}"""


WEEKLY_HEADERS = ["COMPANY", "GIVEN NAME", "SURNAME", "ROLE", "DOCUMENTS EXPIRY"]
FULL_HEADERS = WEEKLY_HEADERS + ["BADGE ISSUED", "BADGE VALID"]
EXPIRED_HEADERS = ["GIVEN NAME", "SURNAME", "COMPANY", "DOCUMENTS EXPIRY"]

ORACLE_SQL: dict[str, str] = {
    "expired_badges": with_views("workers", "companies") + EXPIRED,
    "expired_counts": with_views("workers", "companies", extra={"ex": EXPIRED}) + """
  SELECT 'temporary' AS section, count(*) FILTER (WHERE section = 'temporary') AS n FROM ex
  UNION ALL SELECT 'permanent', count(*) FILTER (WHERE section = 'permanent') FROM ex
  UNION ALL SELECT 'total', count(*) FROM ex""",
    "weekly_valid": with_views(*WCR, extra={"roster": ROSTER}) + WEEKLY,
    "weekly_totals": with_views(*WCR, extra={"roster": ROSTER, "wk": WEEKLY}) + """
  SELECT count(DISTINCT nullif(company_name, '')) AS n_companies, count(*) AS n_workers
  FROM wk""",
    "roster_full": with_views(*WCR, extra={"roster": ROSTER}) + FULL,
    "column_widths": with_views(*WCR, extra={"roster": ROSTER, "wk": WEEKLY, "fl": FULL,
                                             "ex": EXPIRED})
    + _widths("weekly", "wk", ["company_name", "given_name", "surname", "role_name",
                               "expiry_text"], WEEKLY_HEADERS, 10)
    + "\nUNION ALL " + _widths("full", "fl", ["company_name", "given_name", "surname",
                                             "role_name", "expiry_text", "issued_mark",
                                             "valid_mark"], FULL_HEADERS, 10, fixed=(4, 5, 6))
    + "\nUNION ALL " + _widths("expired", "ex", ["given_name", "surname", "company_name",
                                                "expiry_date"], EXPIRED_HEADERS, 5, cap=50,
                               skip_empty=True),
    "report_lines": with_views(*WCR, extra={
        "roster": ROSTER, "wk": WEEKLY,
        "t": """SELECT count(*) FILTER (WHERE section = 'temporary') AS nt,
                       count(*) FILTER (WHERE section = 'permanent') AS np,
                       count(DISTINCT nullif(company_name, '')) AS nc, count(*) AS nw FROM wk""",
        "e": """SELECT *, 2 + CASE WHEN nt > 0 THEN nt + 1 ELSE 0 END AS ph,
                       2 + CASE WHEN nt > 0 THEN nt + 1 ELSE 0 END
                         + CASE WHEN np > 0 THEN np + 1 ELSE 0 END AS fin FROM t""",
        "d": """SELECT wk.*, row_number() OVER (ORDER BY CASE WHEN section = 'temporary'
                       THEN 0 ELSE 1 END, lower(company_name), lower(surname),
                       lower(given_name), worker_id) - 1 AS p FROM wk"""}) + """
  SELECT CAST(3 + p + CASE WHEN section = 'permanent' AND e.nt > 0 THEN 1 ELSE 0 END AS BIGINT)
           AS line_no, 'data' AS kind, section, company_name AS c0, given_name AS c1,
         surname AS c2, role_name AS c3, expiry_text AS c4 FROM d, e
  UNION ALL SELECT 0, 'title', NULL, 'Active badges by company, state of 30-06-1998', NULL, NULL, NULL, NULL
  UNION ALL SELECT 1, 'header', NULL, 'COMPANY', 'GIVEN NAME', 'SURNAME', 'ROLE', 'DOCUMENTS EXPIRY'
  UNION ALL SELECT 2, 'section', 'temporary', 'Short-term holders', NULL, NULL, NULL, NULL
    FROM e WHERE nt > 0
  UNION ALL SELECT ph, 'section', 'permanent', 'Regular holders', NULL, NULL, NULL, NULL FROM e WHERE np > 0
  UNION ALL SELECT fin + 2, 'total', NULL, CAST(nc AS VARCHAR) || ' companies listed',
    NULL, NULL, NULL, NULL FROM e
  UNION ALL SELECT fin + 3, 'total', NULL, CAST(nw AS VARCHAR) || ' badge holders listed',
    NULL, NULL, NULL, NULL FROM e""",
    "digest": with_views("workers", "companies", "recipients", extra={
        "ex": EXPIRED,
        "s": """SELECT count(*) FILTER (WHERE section = 'temporary') AS n_temporary,
                       count(*) FILTER (WHERE section = 'permanent') AS n_permanent,
                       count(*) AS n_total FROM ex""",
        "r": """SELECT list_name, email FROM recipients WHERE list_name = 'expired'
                UNION ALL SELECT 'expired', 'site-office@example.org'
                WHERE NOT EXISTS (SELECT 1 FROM recipients WHERE list_name = 'expired')"""}) + """
  SELECT r.list_name, r.email AS recipient,
         printf('Expired documents: %d workers (%s)', s.n_total, '30/06/1998') AS subject,
         printf('As of %s, %d temporary and %d permanent badge holders have expired documents.',
                '30/06/1998', s.n_temporary, s.n_permanent) AS body,
         'expired_badges_30-06-1998.csv' AS attachment,
         s.n_temporary, s.n_permanent, s.n_total
  FROM r, s WHERE s.n_total > 0""",
    "badge_status": with_views("workers") + f"""
  SELECT worker_id,
         CASE WHEN {is_set('badge_cancelled')} THEN 'cancelled'
              WHEN NOT {is_set('badge_issued')} THEN 'not_issued'
              WHEN NOT {is_set('badge_valid')} THEN 'suspended'
              WHEN expiry_date <= {AS_OF} THEN 'expired'
              ELSE 'admitted' END AS status
  FROM workers""",
    "workers_by_company": _list_workers("company_id = 7"),
    "workers_by_surname": _list_workers("instr(lower(surname), 's9') > 0"),
    "workers_cancelled": _list_workers("badge_cancelled = 1"),
    "companies_by_name": _list_companies("lower(company_name) = 'customer#000000042'"),
    "companies_all": _list_companies("true"),
    "company_picker": with_views("companies") + """
  SELECT company_id, company_name FROM companies
  WHERE instr(lower(company_name), '#0000001') > 0""",
    "role_list": with_views("roles") + "  SELECT role_id, role_name FROM roles",
}


# --- stand-in request frames ---------------------------------------------------
VIEWS.update({
    "cand_companies": """
  SELECT p_partkey AS seq,
         CASE WHEN (p_partkey // 12) % 2 = 0
                THEN 'Chain ' || CAST(p_partkey // 12 AS VARCHAR) || '-'
                     || CAST((p_partkey % 12) // 2 AS VARCHAR)
              WHEN p_partkey % 7 = 0
                THEN 'customer #' || lpad(CAST(p_partkey % 1500 AS VARCHAR), 9, '0')
              WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS company_name,
         CASE WHEN (p_partkey // 12) % 2 = 0
                THEN 'CH' || CAST(p_partkey // 12 AS VARCHAR) || '-'
                     || CAST((p_partkey % 12 + 1) // 2 AS VARCHAR)
              WHEN p_partkey % 5 = 0 THEN ''
              WHEN p_partkey % 5 = 1 THEN ' IT' || CAST(p_partkey % 1700 AS VARCHAR) || chr(9)
              ELSE 'IT' || CAST(p_partkey % 1700 AS VARCHAR) END AS vat_number,
         repeat(p_name, p_size) AS contact_name,
         replace(p_name, ' ', '.') || '@example.org' AS contact_email,
         CAST(p_size AS VARCHAR) AS contact_phone, p_type AS note
  FROM part""",
    "cand_workers": """
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderkey % 6 = 0 THEN lower(substr(o_orderpriority, 3))
              ELSE substr(o_orderpriority, 3) END AS given_name,
         CASE WHEN o_orderkey % 6 = 0 THEN 's' || CAST(o_orderkey % 997 AS VARCHAR)
              ELSE 'New' || CAST(o_orderkey % 300 AS VARCHAR) END AS surname,
         CASE WHEN o_orderkey % 6 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
              WHEN o_orderkey % 6 = 2 THEN ''
              WHEN o_orderkey % 6 = 3 THEN 'Ghost#' || CAST(o_orderkey AS VARCHAR)
              ELSE 'CUSTOMER#' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 9, '0') END
           AS company_name,
         CASE WHEN o_orderstatus = 'P' THEN 'on' END AS is_temporary,
         'B' || CAST(o_orderkey AS VARCHAR) AS badge_number,
         CASE WHEN o_orderkey % 6 = 5 THEN 'abc' WHEN o_orderkey % 4 = 0 THEN ''
              ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS role_id,
         CASE WHEN o_orderkey % 6 = 4 THEN (CASE WHEN o_orderkey % 4 = 0 THEN '2024-02-30'
                                                 ELSE '' END)
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS expiry_date,
         o_orderstatus AS note
  FROM orders""",
    "edits": """
  SELECT event_id AS seq,
         CAST(floor(event_id / 3) AS BIGINT) * 2
           + CASE WHEN event_id % 29 = 0 THEN 1000000000 ELSE 0 END AS worker_id,
         'G' || CAST(event_id AS VARCHAR) AS given_name,
         'E' || CAST(user_id AS VARCHAR) AS surname, user_id AS company_id,
         CASE WHEN event_id % 31 = 0 THEN 'r' WHEN event_id % 4 = 0 THEN ''
              ELSE CAST(event_id % 137 AS VARCHAR) END AS role_id,
         CASE WHEN event_type = 'purchase' THEN 'on' END AS is_temporary,
         'TB' || CAST(event_id AS VARCHAR) AS badge_number,
         CASE WHEN event_id % 37 = 0 THEN '2024-13-01' WHEN event_id % 11 = 0 THEN ''
              ELSE strftime(ts, '%Y-%m-%d') END AS expiry_date,
         CASE WHEN event_id % 13 = 0 THEN '1' ELSE '0' END AS clear_date_flag,
         props AS note
  FROM events""",
    "cedits": """
  SELECT event_id AS seq,
         CAST(floor(event_id / 4) AS BIGINT)
           + CASE WHEN event_id % 53 = 0 THEN 1000000000 ELSE 0 END AS company_id,
         'Firm ' || CAST(user_id AS VARCHAR) AS company_name,
         'IT' || CAST(event_id AS VARCHAR) AS vat_number, event_type AS contact_name,
         'e' || CAST(event_id AS VARCHAR) || '@example.org' AS contact_email,
         CAST(user_id AS VARCHAR) AS contact_phone, props AS note
  FROM events""",
    "fc": """
  SELECT event_id AS seq, 'user' || CAST(user_id % 4 AS VARCHAR) AS actor,
         CASE WHEN event_id % 103 = 0 THEN 'vehicle' WHEN event_type = 'error' THEN 'company'
              ELSE 'worker' END AS type,
         CASE WHEN event_id % 109 = 0 THEN NULL
              WHEN event_id % 107 = 0 THEN user_id + 1000000000 ELSE user_id END AS id,
         CASE WHEN event_id % 101 = 0 THEN 'colour'
              WHEN event_type = 'click' THEN 'badge_issued'
              WHEN event_type = 'view' THEN 'badge_valid'
              WHEN event_type = 'purchase' THEN 'badge_cancelled'
              WHEN event_type = 'signup' THEN 'record_updated'
              ELSE 'is_sole_trader' END AS field,
         CASE WHEN event_id % 79 = 0 THEN NULL
              WHEN event_id % 97 = 0 THEN '2' WHEN event_id % 89 = 0 THEN 'x'
              WHEN event_id % 83 = 0 THEN NULL
              WHEN event_id % 73 <> 0 AND event_id % 67 <> 0 AND event_id % 61 = 0 THEN 'x'
              WHEN value > 50 THEN '1' ELSE '0' END AS clicked,
         NOT (event_id % 79 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0
              AND event_id % 83 = 0) AS has_clicked
  FROM events""",
})

WS = "'^[\\s]+|[\\s]+$'"

NEW_COMPANIES = f"""
  SELECT c.* FROM cand_companies c
  WHERE NOT EXISTS (SELECT 1 FROM companies s
                    WHERE replace(lower(s.company_name), ' ', '')
                          = replace(lower(c.company_name), ' ', ''))
    AND NOT EXISTS (SELECT 1 FROM companies s
                    WHERE nullif(trim(s.vat_number), '')
                          = nullif(regexp_replace(c.vat_number, {WS}, '', 'g'), ''))"""

WORKER_FIELDS = ("worker_id, given_name, surname, company_id, role_id, badge_issued, "
                 "expiry_date, record_updated, badge_valid, note, badge_cancelled, "
                 "is_temporary, badge_number")
COMPANY_FIELDS = ("company_id, company_name, vat_number, contact_name, contact_email, "
                  "contact_phone, note, is_sole_trader")

RESOLVED_CAND = """
  SELECT c.*, lk.company_id FROM cand_workers c
  LEFT JOIN (SELECT lower(company_name) AS nk, min(company_id) AS company_id FROM companies
             WHERE company_name IS NOT NULL GROUP BY 1) lk ON lower(c.company_name) = lk.nk"""

FLAG_OUTCOMES = """
  SELECT fc.seq, fc.actor, fc.type, fc.id, fc.field,
         CASE WHEN TRY_CAST(fc.clicked AS INTEGER) IN (0, 1)
              THEN TRY_CAST(fc.clicked AS INTEGER) END AS value,
         CASE WHEN NOT fc.has_clicked THEN 'missing_clicked'
              WHEN TRY_CAST(fc.clicked AS INTEGER) IS NULL
                   OR TRY_CAST(fc.clicked AS INTEGER) NOT IN (0, 1) THEN 'bad_value'
              WHEN coalesce(fc.type, '') = '' OR fc.id IS NULL THEN 'missing_fields'
              WHEN fc.type NOT IN ('worker', 'company') THEN 'unknown_type'
              WHEN NOT ((fc.type = 'worker' AND fc.field IN ('record_updated', 'badge_issued',
                          'badge_valid', 'badge_cancelled'))
                        OR (fc.type = 'company' AND fc.field = 'is_sole_trader'))
                THEN 'unknown_field'
              WHEN fc.field = 'badge_issued' AND fc.actor NOT IN ('user0', 'user1')
                THEN 'forbidden'
              WHEN t.id IS NULL THEN 'not_found'
              ELSE 'applied' END AS reason
  FROM fc LEFT JOIN (SELECT 'worker' AS type, worker_id AS id FROM workers
                     UNION ALL SELECT 'company', company_id FROM companies) t
    ON fc.type = t.type AND fc.id = t.id"""

FLAG_LATEST = """
  SELECT type, id, field, arg_max(value, seq) AS value FROM fo WHERE reason = 'applied'
  GROUP BY type, id, field"""

FLAG_SNAPSHOT = with_views("workers", "companies", "fc", extra={
    "fo": FLAG_OUTCOMES, "fl": FLAG_LATEST}) + """
  SELECT w.worker_id, w.given_name, w.surname, w.company_id, w.role_id,
         coalesce(i.value, w.badge_issued) AS badge_issued, w.expiry_date,
         coalesce(u.value, w.record_updated) AS record_updated,
         coalesce(v.value, w.badge_valid) AS badge_valid, w.note,
         coalesce(x.value, w.badge_cancelled) AS badge_cancelled, w.is_temporary, w.badge_number
  FROM workers w
  LEFT JOIN fl i ON i.type = 'worker' AND i.field = 'badge_issued' AND i.id = w.worker_id
  LEFT JOIN fl u ON u.type = 'worker' AND u.field = 'record_updated' AND u.id = w.worker_id
  LEFT JOIN fl v ON v.type = 'worker' AND v.field = 'badge_valid' AND v.id = w.worker_id
  LEFT JOIN fl x ON x.type = 'worker' AND x.field = 'badge_cancelled' AND x.id = w.worker_id"""

LOADED_ROWS = """
  SELECT *, length(given_name) > 50 OR length(note) > 100 AS too_long,
         length(company_name) > 80 AS long_company
  FROM (SELECT k, (k // 16000) * 4 + k % 4 AS file_no,
         CASE WHEN odd THEN '' WHEN k % 41 = 0 THEN repeat('L', 81)
              WHEN k % 5 = 1 THEN 'FIRM ' || firm ELSE 'Firm ' || firm END AS company_name,
         CASE WHEN odd THEN '' WHEN k % 43 = 0 THEN repeat('G', 51)
              ELSE substr(o_orderpriority, 3) END AS given_name,
         CASE WHEN odd OR k % 19 = 0 THEN '' ELSE 'S' || CAST(k % 997 AS VARCHAR) END AS surname,
         CASE WHEN odd OR k % 19 = 0 THEN '' WHEN k % 47 = 0 THEN repeat('n', 101)
              WHEN k % 9 = 0 THEN 'a;b'
              WHEN k % 17 = 0 THEN 'line1' || chr(10) || 'line2'
              ELSE o_orderstatus END AS note,
         CASE WHEN NOT odd AND k % 19 <> 0 AND k % 6 IN (0, 1, 2)
              THEN CAST(o_orderdate AS DATE) END AS expiry_date,
         NOT odd AND k % 19 <> 0 AND k % 6 IN (3, 4) AS bad_date,
         CASE WHEN odd OR k % 19 = 0 THEN ''
              WHEN k % 6 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
              WHEN k % 6 = 1 THEN strftime(o_orderdate, '%-d/%-m/%Y')
              WHEN k % 6 = 2 THEN strftime(o_orderdate, '%-d-%-m-%Y')
              WHEN k % 6 = 3 THEN '31/02/2024'
              WHEN k % 6 = 4 THEN strftime(o_orderdate, '%d/%m/%y') ELSE '' END AS expiry_text,
         CASE WHEN NOT odd AND k % 19 <> 0 AND k % 3 = 0 THEN 1 ELSE 0 END AS badge_issued,
         CASE WHEN NOT odd AND k % 19 <> 0 AND k % 4 = 0 THEN 1 ELSE 0 END AS badge_valid
  FROM (SELECT *, o_orderkey AS k, CAST(o_custkey % 50 AS VARCHAR) AS firm,
               o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 AS odd
        FROM orders WHERE o_orderkey % 29 <> 0))"""

LOADED_COMPANIES = """
  SELECT company_name,
         (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY company_name)
           AS company_id
  FROM (SELECT DISTINCT company_name FROM lr WHERE NOT long_company)"""

ORACLE_SQL.update({
    "workers_by_ids": with_views("workers") + f"""
  SELECT {WORKER_FIELDS} FROM workers WHERE worker_id IN (SELECT user_id FROM events)""",
    "new_companies_accepted": with_views("companies", "cand_companies") + NEW_COMPANIES,
    "surrogate_keys": with_views("companies", "cand_companies", extra={"f": NEW_COMPANIES}) + """
  SELECT seq, (SELECT max(company_id) FROM companies) + row_number() OVER (ORDER BY seq)
           AS company_id FROM f""",
    "worker_duplicates_stored": with_views("workers", "companies", "cand_workers",
                                           extra={"r": RESOLVED_CAND}) + """
  SELECT r.seq, r.given_name, r.surname, r.company_id FROM r
  WHERE EXISTS (SELECT 1 FROM workers w WHERE lower(w.given_name) = lower(r.given_name)
                AND lower(w.surname) = lower(r.surname) AND w.company_id = r.company_id)""",
    "new_workers_outcomes": with_views("workers", "companies", "cand_workers", extra={
        "r0": RESOLVED_CAND,
        "r1": """
  SELECT r0.*,
         nullif(role_id, '') IS NOT NULL AND TRY_CAST(nullif(role_id, '') AS BIGINT) IS NULL
           AS bad_role,
         CAST(try_strptime(nullif(expiry_date, ''), '%Y-%m-%d') AS DATE) AS d,
         coalesce(expiry_date, '') <> ''
           AND try_strptime(nullif(expiry_date, ''), '%Y-%m-%d') IS NULL AS bad_date,
         CASE WHEN is_temporary = 'on' THEN 1 ELSE 0 END AS temp,
         lower(given_name) AS gk, lower(surname) AS sk,
         EXISTS (SELECT 1 FROM workers w WHERE lower(w.given_name) = lower(r0.given_name)
                 AND lower(w.surname) = lower(r0.surname) AND w.company_id = r0.company_id)
           AS stored
  FROM r0""",
        "r2": """
  SELECT r1.*, CASE WHEN company_name = '' THEN 'no_company' WHEN bad_role THEN 'bad_role'
                    WHEN bad_date THEN 'bad_date'
                    WHEN company_id IS NULL THEN 'company_unknown'
                    WHEN stored THEN 'duplicate' END AS early
  FROM r1""",
        "firsts": """
  SELECT gk, sk, company_id, min(seq) AS first FROM r2
  WHERE early IS NULL AND NOT (temp = 1 AND d IS NULL)
    AND gk IS NOT NULL AND sk IS NOT NULL AND company_id IS NOT NULL
  GROUP BY gk, sk, company_id""",
        "r3": """
  SELECT r2.seq, r2.company_id,
         coalesce(early, CASE WHEN f.first < r2.seq THEN 'duplicate' END,
                  CASE WHEN temp = 1 AND d IS NULL THEN 'temporary_without_date' END) AS reason
  FROM r2 LEFT JOIN firsts f ON r2.gk = f.gk AND r2.sk = f.sk AND r2.company_id = f.company_id"""
    }) + """
  SELECT seq, coalesce(reason, 'accepted') AS outcome, company_id,
         CASE WHEN reason IS NULL THEN (SELECT max(worker_id) FROM workers)
              + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END AS worker_id
  FROM r3""",
    "orphans": with_views(*WCR) + """
  SELECT worker_id, 'company_id' AS fk_column, company_id AS fk_value FROM workers
  WHERE company_id IS NOT NULL AND company_id NOT IN (SELECT company_id FROM companies)
  UNION ALL
  SELECT worker_id, 'role_id', role_id FROM workers
  WHERE role_id IS NOT NULL AND role_id NOT IN (SELECT role_id FROM roles)""",
    "duplicate_keys": with_views("companies") + """
  SELECT nullif(trim(vat_number), '') AS vat_key, count(*) AS n_rows FROM companies
  GROUP BY 1 HAVING count(*) > 1 AND nullif(trim(vat_number), '') IS NOT NULL""",
    "conformance_rejects": with_views("cand_companies") + "\nUNION ALL ".join(
        f"""
  SELECT seq, '{c}' AS "column", 'too_long' AS reason, CAST(length({c}) AS INTEGER) AS length
  FROM cand_companies WHERE length({c}) > {n}"""
        for c, n in (("company_name", 80), ("vat_number", 20), ("contact_name", 100),
                     ("contact_email", 50), ("contact_phone", 20), ("note", 100))),
    "temporary_without_date": with_views("workers") + """
  SELECT worker_id, company_id FROM workers WHERE is_temporary = 1 AND expiry_date IS NULL""",
    "worker_edits": with_views(*WCR, "edits", extra={
        "e1": """
  SELECT e.*, TRY_CAST(nullif(e.role_id, '') AS BIGINT) AS role,
         nullif(e.role_id, '') IS NOT NULL AND TRY_CAST(nullif(e.role_id, '') AS BIGINT) IS NULL
           AS bad_role,
         coalesce(e.clear_date_flag = '1', false) AS clr,
         CASE WHEN e.is_temporary = 'on' THEN 1 ELSE 0 END AS temp
  FROM edits e""",
        "e2": """
  SELECT e1.*,
         CASE WHEN clr THEN NULL
              ELSE CAST(try_strptime(nullif(expiry_date, ''), '%Y-%m-%d') AS DATE) END AS d,
         NOT clr AND coalesce(expiry_date, '') <> ''
           AND try_strptime(nullif(expiry_date, ''), '%Y-%m-%d') IS NULL AS bad_date
  FROM e1""",
        "e3": """
  SELECT e2.*,
         CASE WHEN bad_role THEN 'bad_role'
              WHEN w.worker_id IS NULL THEN 'not_found'
              WHEN bad_date THEN 'bad_date'
              WHEN temp = 1 AND d IS NULL THEN 'temporary_without_date'
              WHEN e2.company_id IS NOT NULL AND c.company_id IS NULL THEN 'company_unknown'
              WHEN role IS NOT NULL AND r.role_id IS NULL THEN 'role_unknown' END AS reason
  FROM e2 LEFT JOIN workers w ON e2.worker_id = w.worker_id
  LEFT JOIN companies c ON e2.company_id = c.company_id
  LEFT JOIN roles r ON e2.role = r.role_id""",
        "last": """
  SELECT * FROM (SELECT e3.*, row_number() OVER (PARTITION BY worker_id ORDER BY seq DESC) AS rn
                 FROM e3 WHERE reason IS NULL) WHERE rn = 1"""}) + """
  SELECT w.worker_id,
         CASE WHEN l.seq IS NOT NULL THEN l.given_name ELSE w.given_name END AS given_name,
         CASE WHEN l.seq IS NOT NULL THEN l.surname ELSE w.surname END AS surname,
         CASE WHEN l.seq IS NOT NULL THEN l.company_id ELSE w.company_id END AS company_id,
         CASE WHEN l.seq IS NOT NULL THEN l.role ELSE w.role_id END AS role_id,
         w.badge_issued,
         CASE WHEN l.seq IS NOT NULL THEN l.d ELSE w.expiry_date END AS expiry_date,
         w.record_updated, w.badge_valid,
         CASE WHEN l.seq IS NOT NULL THEN l.note ELSE w.note END AS note,
         w.badge_cancelled,
         CASE WHEN l.seq IS NOT NULL THEN l.temp ELSE w.is_temporary END AS is_temporary,
         CASE WHEN l.seq IS NOT NULL THEN (CASE WHEN l.temp = 1 THEN l.badge_number ELSE '' END)
              ELSE w.badge_number END AS badge_number
  FROM workers w LEFT JOIN last l ON w.worker_id = l.worker_id""",
    "company_edits": with_views("companies", "cedits", extra={
        "last": """
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.company_id ORDER BY seq DESC)
                   AS rn FROM cedits e WHERE e.company_id IN (SELECT company_id FROM companies))
  WHERE rn = 1"""}) + """
  SELECT c.company_id,
         CASE WHEN l.seq IS NOT NULL THEN l.company_name ELSE c.company_name END AS company_name,
         CASE WHEN l.seq IS NOT NULL THEN l.vat_number ELSE c.vat_number END AS vat_number,
         CASE WHEN l.seq IS NOT NULL THEN l.contact_name ELSE c.contact_name END AS contact_name,
         CASE WHEN l.seq IS NOT NULL THEN l.contact_email ELSE c.contact_email END
           AS contact_email,
         CASE WHEN l.seq IS NOT NULL THEN l.contact_phone ELSE c.contact_phone END
           AS contact_phone,
         CASE WHEN l.seq IS NOT NULL THEN l.note ELSE c.note END AS note,
         c.is_sole_trader
  FROM companies c LEFT JOIN last l ON c.company_id = l.company_id""",
    "flag_change_outcomes": with_views("workers", "companies", "fc") + FLAG_OUTCOMES,
    "stream_flag_outcomes": with_views("workers", "companies", "fc") + FLAG_OUTCOMES,
    "flag_changes_snapshot": FLAG_SNAPSHOT,
    "stream_flag_changes": FLAG_SNAPSHOT,
    "flag_changes_companies": with_views("workers", "companies", "fc", extra={
        "fo": FLAG_OUTCOMES, "fl": FLAG_LATEST}) + """
  SELECT c.company_id, c.company_name, c.vat_number, c.contact_name, c.contact_email,
         c.contact_phone, c.note, coalesce(s.value, c.is_sole_trader) AS is_sole_trader
  FROM companies c LEFT JOIN fl s ON s.type = 'company' AND s.field = 'is_sole_trader'
    AND s.id = c.company_id""",
    "delete_companies_cascade": with_views("workers") + f"""
  SELECT {WORKER_FIELDS} FROM workers
  WHERE company_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "role_set_null": with_views("workers") + f"""
  SELECT {WORKER_FIELDS.replace('role_id,', '''CASE WHEN role_id IN (SELECT s_suppkey
         FROM supplier WHERE s_nationkey = 7) THEN NULL ELSE role_id END AS role_id,''')}
  FROM workers""",
    "delete_workers": with_views("workers") + f"""
  SELECT {WORKER_FIELDS} FROM workers
  WHERE worker_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "upsert_by_key": with_views("companies", extra={
        "t": """SELECT company_id, contact_phone, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
                       TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM companies""",
        "u": """SELECT o_custkey * 2 AS company_id,
                       arg_max('+39 ' || CAST(o_orderkey AS VARCHAR), o_orderkey) AS contact_phone
                FROM orders GROUP BY 1"""}) + """
  SELECT coalesce(t.company_id, u.company_id) AS company_id,
         CASE WHEN u.company_id IS NOT NULL THEN u.contact_phone ELSE t.contact_phone END
           AS contact_phone,
         CASE WHEN t.company_id IS NOT NULL THEN t.created_at
              ELSE TIMESTAMP '2024-06-01 12:00:00' END AS created_at,
         CASE WHEN u.company_id IS NOT NULL THEN TIMESTAMP '2024-06-01 12:00:00'
              ELSE t.updated_at END AS updated_at
  FROM t FULL OUTER JOIN u ON t.company_id = u.company_id""",
    "bulk_load": "WITH lr AS (" + LOADED_ROWS + "),\nnc AS (" + LOADED_COMPANIES + """),
  allc AS (SELECT c_custkey AS company_id, c_name AS company_name FROM customer
           UNION ALL SELECT company_id, company_name FROM nc),
  lk AS (SELECT lower(company_name) AS nk, min(company_id) AS company_id FROM allc GROUP BY 1)
  SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY file_no, k)
           AS worker_id,
         given_name, surname, lk.company_id, CAST(NULL AS BIGINT) AS role_id, badge_issued,
         expiry_date, 1 AS record_updated, badge_valid, note,
         CAST(NULL AS INTEGER) AS badge_cancelled, CAST(NULL AS INTEGER) AS is_temporary,
         '' AS badge_number
  FROM lr LEFT JOIN lk ON lower(lr.company_name) = lk.nk WHERE NOT too_long""",
    "bulk_load_companies": "WITH lr AS (" + LOADED_ROWS + "),\nnc AS (" + LOADED_COMPANIES
    + """)
  SELECT CAST(company_id AS BIGINT) AS company_id, company_name,
         CAST(NULL AS VARCHAR) AS vat_number, CAST(NULL AS VARCHAR) AS contact_name,
         CAST(NULL AS VARCHAR) AS contact_email, CAST(NULL AS VARCHAR) AS contact_phone,
         CAST(NULL AS VARCHAR) AS note, 0 AS is_sole_trader
  FROM nc""",
})


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# The in-batch first-come rule simulated one request at a time: the
# recursion carries the name keys, VAT keys and seqs accepted so far.
GREEDY = _recursive(with_views("companies", "cand_companies", extra={
    "f": NEW_COMPANIES,
    "p": f"""
  SELECT seq, replace(lower(company_name), ' ', '') AS nk,
         nullif(regexp_replace(vat_number, {WS}, '', 'g'), '') AS vk,
         row_number() OVER (ORDER BY seq) AS rn FROM f""",
    "g": """
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS names,
         CAST([] AS VARCHAR[]) AS vats, CAST([] AS BIGINT[]) AS acc
  UNION ALL
  SELECT q.rn,
         CASE WHEN q.ok AND q.nk IS NOT NULL THEN list_append(q.names, q.nk) ELSE q.names END,
         CASE WHEN q.ok AND q.vk IS NOT NULL THEN list_append(q.vats, q.vk) ELSE q.vats END,
         CASE WHEN q.ok THEN list_append(q.acc, q.seq) ELSE q.acc END
  FROM (SELECT p.rn, p.nk, p.vk, p.seq, g.names, g.vats, g.acc,
               (p.nk IS NULL OR NOT list_contains(g.names, p.nk))
               AND (p.vk IS NULL OR NOT list_contains(g.vats, p.vk)) AS ok
        FROM g JOIN p ON p.rn = g.rn + 1) q""",
    "a": "SELECT unnest(acc) AS seq FROM g WHERE rn = (SELECT max(rn) FROM g)"})) + """
  SELECT c.seq,
         CASE WHEN a.seq IS NOT NULL THEN 'accepted' WHEN f.seq IS NOT NULL THEN 'duplicate'
              ELSE 'exists' END AS outcome,
         CASE WHEN a.seq IS NOT NULL THEN (SELECT max(company_id) FROM companies)
              + row_number() OVER (PARTITION BY a.seq IS NOT NULL ORDER BY c.seq) END
           AS company_id
  FROM cand_companies c LEFT JOIN f ON c.seq = f.seq LEFT JOIN a ON c.seq = a.seq"""

ORACLE_SQL["new_companies_greedy"] = GREEDY
ORACLE_SQL["worker_edit_outcomes"] = ORACLE_SQL["worker_edits"].split("\n  SELECT w.worker_id,")[0] \
    + """
  SELECT seq, worker_id, coalesce(reason, 'applied') AS outcome FROM e3"""


ORACLE_SQL.update({
    "worker_detail": with_views("workers", "companies") + """
  SELECT w.worker_id, w.given_name, w.surname, w.company_id, c.company_name, w.badge_issued,
         w.record_updated, w.note, w.expiry_date, w.badge_valid, w.badge_cancelled,
         coalesce(w.is_temporary, 0) AS is_temporary, coalesce(w.badge_number, '') AS badge_number,
         w.role_id, CAST(w.expiry_date IS NOT NULL AS INTEGER) AS has_date
  FROM workers w LEFT JOIN companies c ON w.company_id = c.company_id
  WHERE w.worker_id IN (SELECT user_id FROM events)""",
    "company_detail": with_views("companies") + """
  SELECT company_id, company_name, vat_number, contact_name, contact_email, contact_phone, note
  FROM companies WHERE company_id IN (SELECT user_id FROM events)""",
    "weekly_recipients": with_views("recipients") + f"""
  SELECT list_name, regexp_replace(email, {WS}, '', 'g') AS email FROM recipients
  WHERE list_name = 'weekly' AND regexp_replace(email, {WS}, '', 'g') <> ''""",
})


ORACLE_SQL["weekly_digest"] = with_views(*WCR, "recipients", extra={
    "roster": ROSTER, "wk": WEEKLY,
    "t": """SELECT count(DISTINCT nullif(company_name, '')) AS n_companies, count(*) AS n_workers
            FROM wk"""}) + f"""
  SELECT list_name, regexp_replace(email, {WS}, '', 'g') AS recipient,
         'Active badges on 30/06/1998' AS subject,
         printf('%d holders of an active badge from %d companies are listed, state of 30/06/1998.',
                t.n_workers, t.n_companies) AS body,
         'active_badges_30_06_1998.csv' AS attachment, t.n_companies, t.n_workers
  FROM recipients, t
  WHERE list_name = 'weekly' AND regexp_replace(email, {WS}, '', 'g') <> ''"""


ORACLE_SQL["bulk_load_outcomes"] = "WITH lr AS (" + LOADED_ROWS + ")" + """
  SELECT CASE WHEN NOT too_long THEN (SELECT max(o_orderkey) FROM orders)
              + row_number() OVER (PARTITION BY too_long ORDER BY file_no, k) END AS worker_id,
         CASE WHEN too_long THEN 'too_long' ELSE 'loaded' END AS outcome,
         CASE WHEN long_company THEN 'company_too_long'
              WHEN bad_date THEN 'unreadable_date' END AS warning
  FROM lr"""


# The first-come rule over the stored companies, one company at a time.
ORACLE_SQL["companies_first_come"] = _recursive(with_views("companies", extra={
    "p": """
  SELECT company_id AS seq, replace(lower(company_name), ' ', '') AS nk,
         nullif(trim(vat_number), '') AS vk,
         row_number() OVER (ORDER BY company_id) AS rn FROM companies""",
    "g": """
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS names,
         CAST([] AS VARCHAR[]) AS vats, CAST([] AS BIGINT[]) AS acc
  UNION ALL
  SELECT q.rn,
         CASE WHEN q.ok AND q.nk IS NOT NULL THEN list_append(q.names, q.nk) ELSE q.names END,
         CASE WHEN q.ok AND q.vk IS NOT NULL THEN list_append(q.vats, q.vk) ELSE q.vats END,
         CASE WHEN q.ok THEN list_append(q.acc, q.seq) ELSE q.acc END
  FROM (SELECT p.rn, p.nk, p.vk, p.seq, g.names, g.vats, g.acc,
               (p.nk IS NULL OR NOT list_contains(g.names, p.nk))
               AND (p.vk IS NULL OR NOT list_contains(g.vats, p.vk)) AS ok
        FROM g JOIN p ON p.rn = g.rn + 1) q""",
    "a": "SELECT unnest(acc) AS seq FROM g WHERE rn = (SELECT max(rn) FROM g)"})) + """
  SELECT c.company_id, a.seq IS NOT NULL AS kept
  FROM companies c LEFT JOIN a ON c.company_id = a.seq"""


def _positioned(sql: str, order: str) -> str:
    """The rows of ``sql`` with their position in ``order`` (from 0)."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS position FROM (\n{sql})"


for _name, _order in (("workers_by_surname", "surname NULLS FIRST, worker_id"),
                      ("companies_all", "company_name NULLS FIRST, company_id"),
                      ("company_picker", "company_name NULLS FIRST, company_id"),
                      ("role_list", "role_id")):
    ORACLE_SQL[_name] = _positioned(ORACLE_SQL[_name], _order)

ORACLE_SQL["weekly_valid_null_as_zero"] = ORACLE_SQL["weekly_valid"].replace(
    "AND badge_cancelled = 0", "AND coalesce(badge_cancelled, 0) = 0")
ORACLE_SQL["snapshot_roundtrip"] = with_views("workers") + f"""
  SELECT {WORKER_FIELDS} FROM workers"""
ORACLE_SQL["company_remap"] = with_views("workers") + f"""
  SELECT {WORKER_FIELDS.replace('company_id,', """CASE WHEN company_id IN (SELECT c_custkey
         FROM customer WHERE c_mktsegment = 'MACHINERY') THEN company_id + 5000000000
         ELSE company_id END AS company_id,""")} FROM workers"""
ORACLE_SQL["clean_csv_roundtrip"] = "WITH lr AS (" + LOADED_ROWS + """)
  SELECT company_name, given_name, surname, note, expiry_text,
         CASE WHEN badge_issued = 1 THEN 'X' ELSE '' END AS issued_mark,
         CASE WHEN badge_valid = 1 THEN 'X' ELSE '' END AS valid_mark FROM lr"""
ORACLE_SQL["full_lines"] = with_views(*WCR, extra={
    "roster": ROSTER, "fl": FULL,
    "d": """SELECT *, row_number() OVER (ORDER BY company_name NULLS FIRST, worker_id) - 1 AS p
            FROM fl"""}) + """
  SELECT CAST(2 + p AS BIGINT) AS line_no, 'data' AS kind, CAST(NULL AS VARCHAR) AS section,
         coalesce(company_name, '') AS c0, coalesce(given_name, '') AS c1,
         coalesce(surname, '') AS c2, role_name AS c3, expiry_text AS c4, issued_mark AS c5,
         valid_mark AS c6 FROM d
  UNION ALL SELECT 0, 'title', NULL, 'Site roster, state of 30-06-1998', NULL, NULL, NULL, NULL,
    NULL, NULL
  UNION ALL SELECT 1, 'header', NULL, 'COMPANY', 'GIVEN NAME', 'SURNAME', 'ROLE',
    'DOCUMENTS EXPIRY', 'BADGE ISSUED', 'BADGE VALID'"""
ORACLE_SQL["expired_lines"] = with_views("workers", "companies", extra={
    "ex": EXPIRED,
    "t": """SELECT count(*) FILTER (WHERE section = 'temporary') AS nt,
                   count(*) FILTER (WHERE section = 'permanent') AS np, count(*) AS n FROM ex""",
    "e": """SELECT *, CASE WHEN nt > 0 THEN 1 ELSE 0 END AS ht,
                   CASE WHEN np > 0 THEN 1 ELSE 0 END AS hp FROM t""",
    "d": """SELECT ex.*, row_number() OVER (
                     ORDER BY CASE WHEN section = 'temporary' THEN 0 ELSE 1 END,
                     is_temporary DESC NULLS LAST, company_name NULLS FIRST, surname NULLS FIRST,
                     given_name NULLS FIRST, worker_id) - 1 AS p FROM ex"""}) + """
  SELECT CAST(2 + ht + p + CASE WHEN section = 'permanent' THEN 1 ELSE 0 END AS BIGINT) AS line_no,
         'data' AS kind, section, coalesce(given_name, '') AS c0, coalesce(surname, '') AS c1,
         coalesce(company_name, '') AS c2, expiry_text AS c3 FROM d, e
  UNION ALL SELECT 0, 'title', NULL, 'Badges with lapsed documents, state of 30-06-1998',
    NULL, NULL, NULL
  UNION ALL SELECT 1, 'header', NULL, 'GIVEN NAME', 'SURNAME', 'COMPANY', 'DOCUMENTS EXPIRY'
  UNION ALL SELECT 2, 'section', 'temporary', 'Short-term holders', NULL, NULL, NULL
    FROM e WHERE nt > 0
  UNION ALL SELECT 2 + ht + nt, 'section', 'permanent', 'Regular holders', NULL, NULL, NULL
    FROM e WHERE np > 0
  UNION ALL SELECT 3 + ht + hp + n, 'total', NULL, CAST(nt AS VARCHAR) || ' short-term badges',
    NULL, NULL, NULL FROM e
  UNION ALL SELECT 4 + ht + hp + n, 'total', NULL, CAST(np AS VARCHAR) || ' regular badges',
    NULL, NULL, NULL FROM e
  UNION ALL SELECT 5 + ht + hp + n, 'total', NULL, CAST(n AS VARCHAR) || ' badges in all',
    NULL, NULL, NULL FROM e"""


# Deletions one after the other: the first request of a stored id finds it.
ORACLE_SQL["deletion_outcomes"] = """
WITH asked AS (
  SELECT event_id AS seq, CASE WHEN event_id % 41 = 0 THEN NULL
           WHEN event_id % 37 = 0 THEN user_id % 331 + 2000000000 ELSE user_id % 331 END AS id
  FROM events),
stored AS (
  SELECT 'worker' AS type, o_orderkey AS id FROM orders
  UNION ALL SELECT 'company', c_custkey FROM customer
  UNION ALL SELECT 'role', s_suppkey FROM supplier),
types AS (SELECT DISTINCT type FROM stored)
SELECT a.seq, a.id, CASE WHEN s.id IS NOT NULL
         AND a.seq = min(a.seq) OVER (PARTITION BY t.type, a.id) THEN 'deleted' ELSE 'not_found'
       END AS outcome, t.type
FROM asked a CROSS JOIN types t LEFT JOIN stored s ON s.type = t.type AND s.id = a.id"""

# Key changes simulated one request at a time: the recursion carries the present id
# of every company, in the order of the ids at the start.
KEY_CHANGES = _recursive("""WITH k AS (SELECT p_partkey AS seq, p_partkey % 50 AS link, p_partkey // 50 * 50 AS base,
             p_partkey // 50 * 50 + 7000000000 AS free FROM part),
r AS (
  SELECT seq, CASE WHEN link < 12 THEN base + 12 - link
      WHEN link < 15 THEN [base + 13, base + 14, free + 1][link - 11]
      WHEN link < 20 THEN base + link WHEN link < 28 THEN base + 20 + link % 2
      WHEN link < 32 THEN free WHEN link < 36 THEN base + 30 + link % 3
      WHEN link = 36 THEN base + 9000000000 WHEN link = 37 THEN NULL ELSE base + link - 8 END AS old_id,
    CASE WHEN link = 0 THEN free WHEN link < 12 THEN base + 13 - link
      WHEN link < 15 THEN [free + 1, base + 13, base + 14][link - 11]
      WHEN link < 20 THEN base + 15 + (link + 1) % 5 WHEN link < 28 THEN free + 2 + link % 3
      WHEN link < 32 THEN free + link WHEN link < 36 THEN base + 30 + link % 2
      WHEN link = 38 THEN NULL WHEN link = 39 THEN base + link - 8
      ELSE base + (link * 7) % 50 END AS new_id
  FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM r),
g AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS outcome,
         (SELECT list(c_custkey ORDER BY c_custkey) FROM customer) AS cur
  UNION ALL
  SELECT rn, outcome, CASE WHEN outcome = 'applied' THEN list_transform(
           cur, lambda x: CASE WHEN x = old_id THEN new_id ELSE x END) ELSE cur END
  FROM (SELECT p.rn, p.old_id, p.new_id, g.cur,
               CASE WHEN p.old_id IS NULL OR NOT list_contains(g.cur, p.old_id) THEN 'not_found'
                    WHEN p.new_id IS NULL THEN 'missing_key'
                    WHEN p.old_id = p.new_id THEN 'unchanged'
                    WHEN list_contains(g.cur, p.new_id) THEN 'key_taken' ELSE 'applied' END AS outcome
        FROM g JOIN p ON p.rn = g.rn + 1) q)""")
MOVED = KEY_CHANGES + """,
m AS (
  SELECT unnest((SELECT cur FROM g WHERE rn = 0)) AS old_id, unnest(cur) AS new_id
  FROM g WHERE rn = (SELECT max(rn) FROM g)),
"""
ORACLE_SQL["key_change_outcomes"] = KEY_CHANGES + """
SELECT p.seq, p.old_id, p.new_id, g.outcome FROM p JOIN g ON g.rn = p.rn"""
ORACLE_SQL["key_change_companies"] = MOVED + f"companies AS ({VIEWS['companies']})" + f"""
SELECT {COMPANY_FIELDS.replace('company_id', 'm.new_id AS company_id')}
FROM companies JOIN m ON m.old_id = companies.company_id"""
ORACLE_SQL["key_change_workers"] = MOVED + f"workers AS ({VIEWS['workers']})" + f"""
SELECT {WORKER_FIELDS.replace('company_id', 'coalesce(m.new_id, company_id) AS company_id')}
FROM workers LEFT JOIN m ON m.old_id = workers.company_id"""


# A mixed log simulated one row at a time.  The recursion carries the deleted ids, the
# companies added so far and the keys of the workers added so far; what a row can
# hit among the stored rows is listed beforehand.
LOG_STATE = _recursive(with_views("companies", "workers", extra={
    "k": "SELECT p_partkey AS k, p_partkey % 8 AS kind, CAST(p_partkey // 16 % 40 AS VARCHAR) AS num, "
         "lpad(CAST(p_partkey % 97 AS VARCHAR), 9, '0') AS cust, p_type AS note FROM part",
    "l": """
  SELECT k AS seq, note,
         CASE WHEN kind < 2 THEN 'add_company' WHEN kind = 2 THEN 'delete_company'
              WHEN kind = 3 THEN 'delete_worker' WHEN k % 16 = 7 THEN 'rename'
              ELSE 'add_worker' END AS op,
         CASE WHEN kind = 2 THEN CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN k + 1000000
                                      ELSE k % 97 END
              WHEN kind = 3 THEN CASE WHEN k % 11 = 0 THEN NULL ELSE k * 3 % 400 END END AS id,
         CASE WHEN kind < 2 THEN CASE WHEN k % 3 = 0 THEN 'Customer#' || cust
                WHEN k % 4 < 2 THEN 'Mixed ' || num ELSE 'MIXED' || num END
              WHEN k % 24 = 4 THEN '' WHEN k % 3 = 0 THEN 'customer#' || cust
              ELSE 'mixed ' || num END AS company_name,
         CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'IT' || (k % 97)
              ELSE 'MX' || (k % 50) END AS vk,
         CASE WHEN k % 2 = 0 THEN 'G' ELSE 'g' END || (k // 32 % 3) AS given_name,
         'S' || (k % 5) AS surname, k % 6 = 0 AS temp, k % 48 = 5 AS bad_role,
         CASE WHEN k % 2 = 0 THEN NULL ELSE 3 END AS role_id, k % 40 = 12 AS bad_date,
         CASE WHEN k % 4 = 0 THEN NULL ELSE DATE '2024-05-01' END AS expiry_date,
         'B' || k AS badge_number
  FROM k""",
    "p": """
  SELECT l.*, row_number() OVER (ORDER BY seq) AS rn, lower(l.company_name) AS nm,
         replace(lower(l.company_name), ' ', '') AS nk, lower(given_name) || '|' || lower(surname) AS wk,
         (SELECT coalesce(list(company_id), []) FROM companies c
           WHERE replace(lower(c.company_name), ' ', '') = replace(lower(l.company_name), ' ', '')
              OR nullif(trim(c.vat_number), '') = l.vk) AS hits,
         (SELECT coalesce(list(company_id), []) FROM companies c
           WHERE lower(c.company_name) = lower(l.company_name)) AS named,
         (SELECT coalesce(list({'w': worker_id, 'c': company_id}), []) FROM workers w
           WHERE lower(w.given_name) = lower(l.given_name) AND lower(w.surname) = lower(l.surname))
           AS same,
         (SELECT max(company_id) FROM workers w WHERE w.worker_id = l.id) AS of_company,
         l.id IN (SELECT company_id FROM companies) AS is_company,
         l.id IN (SELECT worker_id FROM workers) AS is_worker
  FROM l""",
    "g": """
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS cid,
         CAST(NULL AS BIGINT) AS wid, CAST([] AS BIGINT[]) AS dead, CAST([] AS BIGINT[]) AS deadw,
         CAST([] AS STRUCT(id BIGINT, nm VARCHAR, nk VARCHAR, vk VARCHAR)[]) AS newc,
         CAST([] AS VARCHAR[]) AS neww
  UNION ALL
  SELECT rn, outcome,
         CASE WHEN op = 'add_company' AND outcome = 'accepted' THEN next_c
              WHEN op = 'add_worker' THEN rid WHEN op = 'delete_company' THEN id END,
         CASE WHEN op = 'add_worker' AND outcome = 'accepted' THEN next_w
              WHEN op = 'delete_worker' THEN id END,
         CASE WHEN op = 'delete_company' AND outcome = 'deleted' THEN list_append(dead, id) ELSE dead END,
         CASE WHEN op = 'delete_worker' AND outcome = 'deleted' THEN list_append(deadw, id) ELSE deadw END,
         CASE WHEN op = 'add_company' AND outcome = 'accepted' THEN list_append(newc,
                {'id': next_c, 'nm': nm, 'nk': nk, 'vk': vk}) ELSE newc END,
         CASE WHEN op = 'add_worker' AND outcome = 'accepted' THEN list_append(neww, wk || '|' || rid)
              ELSE neww END
  FROM (SELECT r.*, CASE
          WHEN op = 'rename' THEN 'unknown_op'
          WHEN op = 'add_company' THEN CASE
            WHEN len(list_filter(hits, lambda x: NOT list_contains(dead, x))) > 0 THEN 'exists'
            WHEN len(list_filter(newc, lambda x: x.nk = nk OR coalesce(x.vk = vk, false))) > 0
              THEN 'duplicate' ELSE 'accepted' END
          WHEN op = 'delete_company' THEN CASE WHEN is_company AND NOT list_contains(dead, id)
            THEN 'deleted' ELSE 'not_found' END
          WHEN op = 'delete_worker' THEN CASE WHEN is_worker AND NOT list_contains(deadw, id)
            AND NOT coalesce(list_contains(dead, of_company), false) THEN 'deleted' ELSE 'not_found' END
          WHEN nm = '' THEN 'no_company' WHEN bad_role THEN 'bad_role' WHEN bad_date THEN 'bad_date'
          WHEN rid IS NULL THEN 'company_unknown'
          WHEN list_contains(neww, wk || '|' || rid) OR len(list_filter(same, lambda x:
                 x.c = rid AND NOT list_contains(deadw, x.w))) > 0 THEN 'duplicate'
          WHEN temp AND expiry_date IS NULL THEN 'temporary_without_date' ELSE 'accepted' END AS outcome
        FROM (SELECT p.*, g.dead, g.deadw, g.newc, g.neww,
                coalesce(list_min(list_filter(p.named, lambda x: NOT list_contains(g.dead, x))),
                  list_min(list_transform(list_filter(g.newc, lambda x: x.nm = p.nm), lambda x: x.id)))
                  AS rid,
                (SELECT max(company_id) FROM companies) + len(g.newc) + 1 AS next_c,
                (SELECT max(worker_id) FROM workers) + len(g.neww) + 1 AS next_w
              FROM g JOIN p ON p.rn = g.rn + 1) r) q"""}))
ORACLE_SQL["request_log_outcomes"] = LOG_STATE + """
SELECT p.seq, p.op, g.outcome, g.cid AS company_id, g.wid AS worker_id
FROM p JOIN g ON g.rn = p.rn"""
ORACLE_SQL["request_log_workers"] = LOG_STATE + f""",
final AS (SELECT dead, deadw FROM g ORDER BY rn DESC LIMIT 1),
gone AS (SELECT p.id, p.seq FROM p JOIN g ON g.rn = p.rn
         WHERE p.op = 'delete_company' AND g.outcome = 'deleted')
SELECT {WORKER_FIELDS} FROM workers, final
WHERE NOT coalesce(list_contains(dead, company_id), false) AND NOT list_contains(deadw, worker_id)
UNION ALL
SELECT g.wid, p.given_name, p.surname, g.cid, p.role_id, 0, p.expiry_date, 0, 0, p.note, 0,
       CAST(p.temp AS INT), CASE WHEN p.temp THEN p.badge_number ELSE '' END
FROM p JOIN g ON g.rn = p.rn LEFT JOIN gone ON gone.id = g.cid AND gone.seq > p.seq
WHERE p.op = 'add_worker' AND g.outcome = 'accepted' AND gone.id IS NULL"""


ORACLE_SQL["recipient_lines"] = with_views("recipients", extra={
    "r": """SELECT list_name, email FROM recipients WHERE list_name = 'expired'
            UNION ALL SELECT 'expired', 'site-office@example.org'
            WHERE NOT EXISTS (SELECT 1 FROM recipients WHERE list_name = 'expired')""",
    "n": "SELECT *, row_number() OVER (ORDER BY email) - 1 AS p, count(*) OVER () AS t FROM r"}) + """
  SELECT list_name, p // 7 AS line, min(p) + 1 AS first_recipient, count(*) AS n_in_line,
         string_agg(email, ', ' ORDER BY p) AS recipients, max(t) AS n_recipients
  FROM n GROUP BY list_name, p // 7"""
ORACLE_SQL["report_files"] = ("SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS position FROM ("
                              + ORACLE_SQL["report_lines"] + ")")
ORACLE_SQL["edit_date_texts"] = with_views("edits") + """
  SELECT seq, coalesce(strftime(try_cast(expiry_date AS DATE), '%d/%m/%Y'), expiry_date, '')
    AS expiry_text FROM edits"""
ORACLE_SQL["company_edit_outcomes"] = with_views("companies", "cedits") + """
  SELECT seq, e.company_id, CASE WHEN c.company_id IS NULL THEN 'not_found' ELSE 'applied' END
    AS outcome FROM cedits e LEFT JOIN companies c ON c.company_id = e.company_id"""
ORACLE_SQL["upsert_outcomes"] = """
  SELECT o_orderkey AS seq, o_custkey * 2 AS company_id,
         CASE WHEN c_custkey IS NULL AND o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey)
              THEN 'inserted' ELSE 'updated' END AS outcome
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2"""
