"""One SQL statement per registered query.

The plan reports are written the direct way: every row of the joined plan is built and a
correlated MAX picks the current revisions after the outer joins.
"""

from __future__ import annotations

from oracle.derived import week, with_tables

AS_OF = "DATE '1998-01-24'"
NOW = "TIMESTAMP '1998-01-24 00:00:00'"
STAMP = "24-JAN-1998 00:00:00"

_KEYS = ("product", "week_id", "demand_date")
_SUPPLIER = "upper(replace(f.supplier, '.', ''))"
_DEPT = "nullif(replace(replace(i.dept, chr(10), ''), chr(13), ''), '')"

_FORECAST = {
    "non_gsa_forecast": "f.req_plan_non_gsa", "gsa_forecast": "f.req_plan_gsa", "forecast": "f.req_plan_forecast",
    "buffer": "f.req_plan_buffer", "buffer_opt_adj": "f.req_plan_buffer_opt_adj",
    "original_forecast": "f.original_irp_total_original", "final_forecast": "f.final_irp_total_final",
}
_COMMIT = {"non_gsa_commit": "c.non_gsa_commit_qty", "gsa_commit": "c.gsa_commit_qty", "commit": "c.commit_quantity"}
_ADJUST = {"non_gsa_adjustment": "a.req_plan_non_gsa_adj", "gsa_adjustment": "a.req_plan_gsa_adj",
           "adjustment": "a.adjustment_quantity"}


def _sum_of(columns) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in columns) + ")"


TOTAL_FORECAST = _sum_of([*list(_FORECAST.values())[:3], *_ADJUST.values()])
TOTAL_COMMIT = _sum_of(_COMMIT.values())
VARIANCE = f"({TOTAL_FORECAST} - {TOTAL_COMMIT})"


def _newest(alias: str, table: str) -> str:
    same = " AND ".join(f"newer.{k} = {alias}.{k}" for k in _KEYS)
    return (f"{alias}.creation_date IS NOT DISTINCT FROM "
            f"(SELECT max(newer.creation_date) FROM {table} newer WHERE {same})")


def _left(alias: str, table: str) -> str:
    return (f"LEFT JOIN {table} {alias} ON {alias}.product = f.component_part "
            f"AND {alias}.week_id = f.week_id AND {alias}.demand_date = f.demand_date")


def spine(*tests: str, joins: str = "") -> str:
    where = [_newest("c", "fx_commits"), _newest("a", "fx_adjustments"), "m.organization_id = 128",
             "(m.planner_code LIKE '%CM' OR m.planner_code LIKE '%B2B')", *tests]
    return (f"FROM fx_forecast f JOIN fx_item_master i ON i.part_name = f.component_part "
            f"JOIN fx_system_items m ON m.segment1 = i.part_name "
            f"{_left('c', 'fx_commits')} {_left('a', 'fx_adjustments')} {joins} WHERE {' AND '.join(where)}")


def _vendor(condition: str) -> str:
    return f"{_SUPPLIER} IN (SELECT upper(vendor_name) FROM fx_suppliers WHERE {condition})"


def _filters(planner: str = "m.planner_code IS NOT NULL", vendor: str = "vendor_id IS NOT NULL",
             part: str = "i.part_name IS NOT NULL", family: str = "i.product_family IS NOT NULL",
             dept: str = f"{_DEPT} IS NOT NULL") -> list[str]:
    return [planner, _vendor(vendor), part, family, dept]


_ONE = dict(planner="m.planner_code = 'PL1B2B'", vendor="vendor_id = 5")
_SOME = dict(planner="m.planner_code IN ('PL1B2B', 'PL2CM', 'PL3XX', 'PL4CM')", vendor="vendor_id IN (1, 2, 3, 5, 8)",
             part="i.part_name LIKE '%3_50-1%'", family="i.product_family = i.product_family", dept=f"{_DEPT} = 'DEPT2'")
_MEASURES = {**_FORECAST, **_COMMIT, **_ADJUST}
_LABELS = {"PLNR": ("a.adjustment_type", "a.adjustment_comments"), "CM": ("c.commit_reason", "c.commit_comments"),
           "REQ": ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")}


def _variance_rows(role: str, **filters: str) -> str:
    kind, note = _LABELS[role]
    measures = ", ".join(f"coalesce({c}, 0) AS {m}" for m, c in _MEASURES.items())
    return with_tables(f"""
        SELECT f.component_part AS product, f.week_id AS week, f.demand_date AS monday,
               CAST(year(f.demand_date) AS INTEGER) AS year, {measures}, {VARIANCE} AS variance,
               {kind} AS adjustment_type, {note} AS adjustment_comment,
               i.part_site AS org, i.bu AS bu, i.build_type AS build_type
        {spine(*_filters(**filters))}""")


_BUCKETS = {
    "WEEK": (week("f.demand_date"), "f.demand_date"),
    "MONTH": ("CAST(month(f.demand_date) AS INTEGER)", "CAST(date_trunc('month', f.demand_date) AS DATE)"),
    "YEAR": ("CAST(year(f.demand_date) AS INTEGER)", "CAST(date_trunc('year', f.demand_date) AS DATE)"),
}


def _variance_by_view(role: str, view: str, **filters: str) -> str:
    kind, note = _LABELS[role]
    bucket, monday = _BUCKETS[view]
    measures = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {m}" for m, c in _MEASURES.items())
    return with_tables(f"""
        SELECT f.component_part AS product, {bucket} AS week, {monday} AS monday,
               CAST(year(f.demand_date) AS INTEGER) AS year, {measures}, CAST(sum({VARIANCE}) AS BIGINT) AS variance,
               {kind} AS adjustment_type, {note} AS adjustment_comment,
               i.part_site AS org, i.bu AS bu, i.build_type AS build_type
        {spine(f"f.week_id = {week(AS_OF)}", *_filters(**filters))}
        GROUP BY ALL""")


_OWNED = "m.planner_code IN (SELECT planner_code FROM fx_planners WHERE employee_id = 1001)"
_MINE = _vendor("vendor_id = 5")


def _exceptions_plnr() -> str:
    return f"""SELECT CAST(s.vendor_id AS VARCHAR) AS code, s.vendor_name AS name, count(f.supplier) AS no_of_exceptions,
               CAST(sum({VARIANCE}) AS BIGINT) AS exception_quantity
        {spine(_OWNED, joins=f"JOIN fx_suppliers s ON upper(s.vendor_name) = {_SUPPLIER}")}
        GROUP BY s.vendor_id, s.vendor_name"""


def _exceptions_cm() -> str:
    return f"""SELECT m.planner_code AS code, p.description AS name, count(f.supplier) AS no_of_exceptions,
               CAST(sum({VARIANCE}) AS BIGINT) AS exception_quantity
        {spine(_MINE, joins="JOIN fx_planners p ON p.planner_code = m.planner_code")}
        GROUP BY m.planner_code, p.description"""


def _pairs(test: str) -> str:
    return f"SELECT {TOTAL_FORECAST} AS total_forecast, {TOTAL_COMMIT} AS total_commit {spine(test)}"


def _receive(test: str) -> str:
    return f"""SELECT 'WEEK' AS view, f.demand_date AS forecast_date,
               CAST(sum({TOTAL_FORECAST}) AS BIGINT) AS total_forecast,
               CAST(sum({TOTAL_COMMIT}) AS BIGINT) AS total_commit, CAST(0 AS BIGINT) AS total_received
        {spine(test)} GROUP BY f.demand_date ORDER BY f.demand_date ASC NULLS LAST LIMIT 5"""


_TASK_COLUMNS = ("task_request_id, task_approval_id, product, forecast_date, variances, task_status, task_from, "
                 "task_to, task_subject, task_message")
_TASKS_PLNR = f"SELECT {_TASK_COLUMNS} FROM fx_tasks WHERE created_by = '7' AND upper(task_status) <> 'CLOSE'"
_TASKS_CM = (f"SELECT {_TASK_COLUMNS} FROM fx_tasks JOIN fx_suppliers ON task_to = vendor_name "
             f"WHERE vendor_id = 5 AND upper(task_status) <> 'CLOSE'")
_OPEN_POS = ("SELECT CAST(vendor_id AS VARCHAR) AS code, vendor_name AS name, 1 AS no_of_open_pos, "
             "10 AS open_pos_quantity FROM fx_suppliers WHERE vendor_id IN (0, 1, 2, 3, 4, 5)")


def _summary() -> str:
    def line(panel: str, sql: str, first: str, second: str) -> str:
        return (f"SELECT '{panel}' AS panel, count(*) AS row_count, CAST({first} AS BIGINT) AS total_1, "
                f"CAST({second} AS BIGINT) AS total_2 FROM ({sql})")

    tasks = _TASKS_PLNR.replace("'7'", "'1001'")
    return with_tables(" UNION ALL ".join([
        line("exceptions", _exceptions_plnr(), "sum(no_of_exceptions)", "sum(exception_quantity)"),
        line("forecast_vs_commit", _pairs(_OWNED), "sum(total_forecast)", "sum(total_commit)"),
        line("forecast_commit_receive", _receive(_OWNED), "sum(total_forecast)", "sum(total_commit)"),
        line("open_tasks", tasks, "NULL", "NULL"),
        line("open_pos", _OPEN_POS, "sum(no_of_open_pos)", "sum(open_pos_quantity)")]))


def _compare(day: str, wanted: tuple[str, ...] = (), **filters: str) -> str:
    sums = {"non_gsa_req": "non_gsa_forecast", "non_gsa_adj": "non_gsa_adjustment", "non_gsa_commit": "non_gsa_commit",
            "gsa_req": "gsa_forecast", "gsa_adj": "gsa_adjustment", "gsa_commit": "gsa_commit",
            "forecast_req": "forecast", "forecast_adj": "adjustment", "forecast_commit": "commit"}
    measures = ", ".join(f"CAST(sum(coalesce({_MEASURES[m]}, 0)) AS BIGINT) AS {c}" for c, m in sums.items())
    monday = f"CAST(date_trunc('week', {day}) AS DATE)"
    tests = [f"f.week_id = {week(AS_OF)}",
             *(wanted or (f"{week('f.demand_date')} = {week(AS_OF)}", f"year({day}) = 1998"))]
    return with_tables(f"""
        SELECT f.component_part AS product, {week(day)} AS week_id, {monday} AS forecast_date, {measures}
        {spine(*tests, *_filters(**filters))} GROUP BY f.component_part, {week(day)}, {monday}""")


def _search(prefixes: tuple[str, ...], reasons: str, kind: str) -> str:
    parts = " OR ".join(f"part_name LIKE '{p}%'" for p in prefixes)
    nothing = "CAST(NULL AS VARCHAR)"
    return with_tables(f"""
        SELECT 'VENDOR' AS role, CAST(vendor_id AS VARCHAR) AS role_id, vendor_name AS role_value
        FROM fx_suppliers WHERE vendor_id IN (0, 1, 2, 3, 4, 5)
        UNION SELECT 'PLANNER', planner_code, description FROM fx_planners
              WHERE (planner_code LIKE '%CM' OR planner_code LIKE '%B2B') AND organization_id = 128
        UNION SELECT 'PRODUCT', substr(part_name, 1, 50), {nothing} FROM fx_item_master WHERE {parts}
        UNION SELECT 'PRODUCT_FAMILY', substr(product_family, 1, 50), {nothing} FROM fx_item_master
              WHERE product_family IS NOT NULL
        UNION SELECT 'DEPARTMENT', nullif(replace(replace(dept, chr(10), ''), chr(13), ''), ''), {nothing}
              FROM fx_item_master WHERE dept IS NOT NULL
        UNION SELECT 'PRODUCT_LINE', 'PL', {nothing}
        UNION SELECT '{reasons}', ar_value, ar_value FROM fx_adj_reasons WHERE ar_type = '{kind}'""")


_ROLES = with_tables("""
    SELECT u.user_name,
           CASE WHEN u.employee_id IS NOT NULL THEN u.employee_id
                WHEN u.supplier_id IS NOT NULL AND v.n = 1 THEN v.vendor_id
                ELSE u.supplier_id END AS user_id,
           CASE WHEN u.employee_id IS NOT NULL THEN 'PLNR' WHEN u.supplier_id IS NOT NULL THEN 'CM' END AS user_type,
           u.description,
           CASE WHEN u.employee_id IS NULL AND u.supplier_id IS NULL THEN 'Invalid Username' END AS error
    FROM fx_users u LEFT JOIN (
        SELECT contact, count(*) AS n, max(vendor_id) AS vendor_id
        FROM (SELECT DISTINCT b.vendor_contact_id AS contact, s.vendor_id
              FROM fx_supplier_contacts b JOIN fx_supplier_sites s ON s.vendor_site_id = b.vendor_site_id)
        GROUP BY contact) v ON v.contact = u.supplier_id""")


def _append(log: str, key: str, planner: str, vendor: str, user: str, kinds: tuple[str, str], qty: tuple[str, str, str],
            whole: bool = True) -> str:
    kind, note = kinds
    a, b, c = qty
    before = f"SELECT * FROM {log} UNION ALL BY NAME" if whole else ""
    return with_tables(f"""
        {before}
        SELECT (SELECT max({key}) FROM {log}) + row_number() OVER (ORDER BY ord) AS {key}, '{planner}' AS planner_id,
               '{vendor}' AS supplier_id, product, non_gsa AS {a}, gsa AS {b}, fc AS {c}, kind AS {kind}, note AS {note},
               '{user}' AS created_by, {NOW} AS creation_date, '{user}' AS updated_by, {NOW} AS updation_date,
               {week(AS_OF)} AS week_id, monday AS demand_date
        FROM fx_revision_batch""")


_NEW = f"""
    SELECT (SELECT max(request_id) FROM fx_requests) + row_number() OVER (ORDER BY ord) AS request_id,
           '7' AS planner_id, CAST(NULL AS VARCHAR) AS supplier_id, product_family, product_line, product,
           request_quantity, request_type, request_comments, '7' AS created_by, {NOW} AS creation_date,
           '7' AS updated_by, {NOW} AS updation_date, CAST(NULL AS VARCHAR) AS approval_status,
           CAST(NULL AS VARCHAR) AS approval_workflow_id, approver AS approver_id, {NOW} AS approved_date,
           {week(AS_OF)} AS week_id
    FROM fx_new_requests
    WHERE product_family IS NOT NULL AND product_line IS NOT NULL AND product IS NOT NULL
      AND request_quantity IS NOT NULL AND request_type IS NOT NULL AND request_comments IS NOT NULL
      AND approver IS NOT NULL"""
_INSERTED = f"SELECT * FROM fx_requests UNION ALL BY NAME {_NEW}"
_KEPT = """
    SELECT * FROM inserted r WHERE NOT EXISTS (
        SELECT 1 FROM fx_remove_requests d
        WHERE d.request_date IS NOT NULL AND d.approver IS NOT NULL AND r.planner_id = '7' AND r.created_by = '7'
          AND r.product_family = d.product_family AND r.product_line = d.product_line AND r.product = d.product
          AND r.request_quantity = d.request_quantity AND r.request_type = d.request_type)"""
_SETTLED = """
    SELECT r.* REPLACE (
        CASE WHEN w.request_id IS NULL OR NOT (r.approval_status IS NULL OR r.approval_status = 'NEW')
             THEN r.approval_status WHEN w.ok THEN 'In Process' ELSE 'ERROR' END AS approval_status,
        CASE WHEN w.request_id IS NULL OR NOT (r.approval_status IS NULL OR r.approval_status = 'NEW')
             THEN r.approval_workflow_id ELSE w.workflow_id END AS approval_workflow_id)
    FROM kept r LEFT JOIN fx_approval_results w ON w.request_id = r.request_id"""

_CREATED = f"""
    SELECT ord AS born, (SELECT max(task_request_id) FROM fx_tasks) + row_number() OVER (ORDER BY ord) AS task_request_id,
           (SELECT max(task_request_id) FROM fx_tasks) + row_number() OVER (ORDER BY ord) AS task_approval_id,
           planner, p_from AS task_from, supplier, p_to AS task_to, product,
           CAST(forecast_date AS VARCHAR) AS forecast_date, CAST(variance AS VARCHAR) AS variances,
           status AS task_status, subject AS task_subject,
           '<U>{STAMP} [' || coalesce(p_from, '') || ']</U><BR/>' || coalesce(message, '') || '<BR/>' AS task_message,
           login_value AS created_by, {NOW} AS creation_date, login_value AS updated_by, {NOW} AS updation_date
    FROM fx_task_actions WHERE action = 'CREATE'"""
_BEFORE = "SELECT *, CAST(NULL AS BIGINT) AS born FROM fx_tasks UNION ALL BY NAME SELECT * FROM created"
_HITS = f"""
    SELECT t.task_request_id AS id, u.ord, u.status, u.login_value,
           CASE WHEN u.login_type IN ('PLNR', 'CM') THEN
               '<BR/><U>{STAMP} [' || coalesce(CASE u.login_type WHEN 'PLNR' THEN u.p_from ELSE u.p_to END, '')
               || ']</U><BR/>' || coalesce(u.message, '') || '<BR/>' ELSE '' END AS addition
    FROM fx_task_actions u JOIN before t ON t.task_request_id = u.request_id AND (t.born IS NULL OR t.born < u.ord)
    WHERE u.action = 'UPDATE'"""
_ACTION_STATUS = """
    SELECT u.ord, CASE WHEN u.action = 'CREATE' THEN 'CREATED' WHEN u.action <> 'UPDATE' OR u.request_id IS NULL THEN 'IGNORED'
                       WHEN EXISTS (SELECT 1 FROM before t WHERE t.task_request_id = u.request_id
                                    AND (t.born IS NULL OR t.born < u.ord)) THEN 'UPDATED'
                       ELSE 'UNKNOWN_TASK' END AS status
    FROM fx_task_actions u"""
_FOLDED = """
    SELECT id, string_agg(addition, '' ORDER BY ord) AS added, arg_max(status, ord) AS status,
           arg_max(login_value, ord) AS login_value
    FROM hits GROUP BY id"""
_UPDATED = f"""
    SELECT t.* EXCLUDE (born) REPLACE (
        CASE WHEN x.id IS NULL THEN t.task_status ELSE x.status END AS task_status,
        CASE WHEN x.id IS NULL THEN t.task_message ELSE coalesce(t.task_message, '') || x.added END AS task_message,
        CASE WHEN x.id IS NULL THEN t.updated_by ELSE x.login_value END AS updated_by,
        CASE WHEN x.id IS NULL THEN t.updation_date ELSE {NOW} END AS updation_date)
    FROM before t LEFT JOIN folded x ON x.id = t.task_request_id"""

_JUDGED = f"""
    SELECT r.*, {week('r.forecast_date')} AS request_week,
           EXISTS (SELECT 1 FROM fx_item_master i WHERE i.part_name = r.product) AS known,
           EXISTS (SELECT 1 FROM fx_forecast f WHERE f.component_part = r.product
                   AND {week('f.demand_date')} = {week('r.forecast_date')}) AS planned,
           (SELECT count(*) FROM fx_suppliers s WHERE s.vendor_id = r.vendor_id) = 1 AS sole
    FROM fx_adhoc r"""
_STATUS = """
    SELECT j.*, CASE WHEN NOT j.known THEN 'INVALID_PRODUCT'
                     WHEN j.planned OR EXISTS (
                         SELECT 1 FROM judged e WHERE e.product = j.product AND e.request_week = j.request_week
                         AND e.ord < j.ord AND e.known AND NOT e.planned AND e.sole) THEN 'PRESENT'
                     WHEN NOT j.sole THEN 'VENDOR_ERROR' ELSE 'ACCEPTED' END AS status
    FROM judged j"""


def statements() -> dict[str, str]:
    inserted, kept = ("inserted", _INSERTED), ("kept", _KEPT)
    tasks = (("created", _CREATED), ("before", _BEFORE), ("hits", _HITS), ("folded", _FOLDED))
    adhoc = (("judged", _JUDGED), ("decided", _STATUS))
    adjustments = ("fx_adjustments", "adjustment_id", "PL1B2B", "5", "PL1B2B", ("adjustment_type", "adjustment_comments"),
                   ("req_plan_non_gsa_adj", "req_plan_gsa_adj", "adjustment_quantity"))
    commits = ("fx_commits", "commit_id", "PL1B2B", "5", "5", ("commit_reason", "commit_comments"),
               ("non_gsa_commit_qty", "gsa_commit_qty", "commit_quantity"))
    queries = {
        "q_user_roles": _ROLES,
        "q_search_plnr": _search(("33210",), "ADJ_TYPE", "A"),
        "q_search_cm": _search(("3350", "3490"), "RESN_TYPE", "R"),
        "q_variance_rows": _variance_rows("PLNR"),
        "q_variance_rows_unset": _variance_rows("PLNR"),
        "q_variance_rows_family": _variance_rows("PLNR", family="i.product_family = 'Brand#13'"),
        "q_variance_rows_scoped": _variance_rows("CM", **_SOME),
        "q_variance_week": _variance_by_view("PLNR", "WEEK"),
        "q_variance_month": _variance_by_view("CM", "MONTH"),
        "q_variance_year": _variance_by_view("REQ", "YEAR"),
        "q_variance_week_single": _variance_by_view("PLNR", "WEEK", **_ONE),
        "q_append_adjustments": _append(*adjustments),
        "q_append_commits": _append(*commits),
        "q_append_adjustments_delta": _append(*adjustments, whole=False),
        "q_append_commits_delta": _append(*commits, whole=False),
        "q_snapshot_stamp": with_tables("SELECT * REPLACE (CAST(4 AS INTEGER) AS week_id) FROM fx_forecast"),
        "q_exceptions_plnr": with_tables(_exceptions_plnr()),
        "q_exceptions_cm": with_tables(_exceptions_cm()),
        "q_fvc_plnr": with_tables(_pairs(_OWNED)),
        "q_fvc_cm": with_tables(_pairs(_MINE)),
        "q_fcr_plnr": with_tables(_receive(_OWNED)),
        "q_fcr_cm": with_tables(_receive(_MINE)),
        "q_tasks_plnr": with_tables(_TASKS_PLNR),
        "q_tasks_cm": with_tables(_TASKS_CM),
        "q_open_pos": with_tables(_OPEN_POS),
        "q_dashboard_summary": _summary(),
        "q_submitted_requests": with_tables(
            "SELECT product_family, product_line, product, creation_date AS request_date, request_quantity, "
            "request_type, request_comments, approver_id AS approver FROM fx_requests"),
        "q_requests_insert": with_tables("SELECT * FROM inserted", inserted),
        "q_requests_delta": with_tables(_NEW),
        "q_requests_delete": with_tables("SELECT * FROM kept", inserted, kept),
        "q_requests_approval": with_tables("SELECT * FROM settled", inserted, kept, ("settled", _SETTLED)),
        "q_tasks_create": with_tables("SELECT * EXCLUDE (born) FROM created", ("created", _CREATED)),
        "q_tasks_update": with_tables("SELECT * FROM updated", *tasks, ("updated", _UPDATED)),
        "q_tasks_status": with_tables("SELECT * FROM statuses", ("created", _CREATED), ("before", _BEFORE),
                                      ("statuses", _ACTION_STATUS)),
        "q_preferences": with_tables(
            "SELECT * FROM fx_preferences WHERE user_id IN (SELECT user_id FROM fx_preference_batch)"),
        "q_preferences_replace": with_tables(
            "SELECT * FROM fx_preferences WHERE user_id NOT IN (SELECT user_id FROM fx_preference_batch) "
            "UNION ALL SELECT * FROM fx_preference_batch"),
        "q_adhoc_status": with_tables(
            "SELECT ord, product, forecast_date, request_week, status FROM decided", *adhoc),
        "q_adhoc_forecast": with_tables(f"""
            SELECT * FROM fx_forecast
            UNION ALL BY NAME
            SELECT {week(AS_OF)} AS week_id, d.product AS component_part, d.forecast_date AS demand_date,
                   CAST(0 AS BIGINT) AS req_plan_non_gsa, CAST(0 AS BIGINT) AS req_plan_gsa,
                   CAST(0 AS BIGINT) AS req_plan_forecast, CAST(0 AS BIGINT) AS req_plan_buffer,
                   CAST(0 AS BIGINT) AS req_plan_buffer_opt_adj, CAST(NULL AS BIGINT) AS original_irp_total_original,
                   CAST(NULL AS BIGINT) AS final_irp_total_final, d.product_family,
                   (SELECT min(s.vendor_name) FROM fx_suppliers s WHERE s.vendor_id = d.vendor_id) AS supplier,
                   d.note AS remarks
            FROM decided d WHERE d.status = 'ACCEPTED'""", *adhoc),
        "q_adhoc_adjustments": with_tables(f"""
            SELECT * FROM fx_adjustments
            UNION ALL BY NAME
            SELECT (SELECT max(adjustment_id) FROM fx_adjustments) + row_number() OVER (ORDER BY ord) AS adjustment_id,
                   planner AS planner_id, CAST(vendor_id AS VARCHAR) AS supplier_id, product,
                   non_gsa_adj AS req_plan_non_gsa_adj, gsa_adj AS req_plan_gsa_adj, forecast_adj AS adjustment_quantity,
                   kind AS adjustment_type, note AS adjustment_comments, planner AS created_by, {NOW} AS creation_date,
                   planner AS updated_by, {NOW} AS updation_date, {week(AS_OF)} AS week_id, forecast_date AS demand_date
            FROM decided WHERE status = 'ACCEPTED'""", *adhoc),
        "q_compare_last": _compare("(f.demand_date - INTERVAL 7 DAY)"),
        "q_compare_current": _compare("f.demand_date"),
        "q_compare_weeks": _compare("f.demand_date", (
            f"{week('f.demand_date')} = 3", "year(f.demand_date - INTERVAL 7 DAY) = 1998")),
    }
    # a stored ledger read back, or a report from kept totals, holds the same rows
    return queries | {"q_variance_week_kept": queries["q_variance_week"]} | {f"{name}_stored": queries[f"{name}_{step}"] for name, step in (
        ("q_requests", "approval"), ("q_tasks", "update"), ("q_preferences", "replace"))}
