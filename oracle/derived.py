"""The derived tables in SQL, as common table expressions over the test tables."""

from __future__ import annotations

_PART = ("CASE {k} % 3 WHEN 0 THEN '33210-' WHEN 1 THEN '3350-' ELSE '3490-' END || CAST({k} AS VARCHAR)")
_WEEK = "CAST(floor((dayofyear({d}) + 6) / 7) AS INTEGER)"


def part(key: str) -> str:
    return _PART.format(k=key)


def week(day: str) -> str:
    """Plan week: sevens counted from 1 January."""
    return _WEEK.format(d=day)


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_suppliers": ((), "SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier"),
    "fx_item_master": ((), f"""
        SELECT p_partkey AS item_id, {part('p_partkey')} AS part_name, 'SITE' || CAST(site AS VARCHAR) AS part_site,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS product_family,
               p_type AS build_type, 'BU' || CAST(p_size % 3 AS VARCHAR) AS bu,
               CASE WHEN p_partkey % 19 = 0 THEN NULL
                    WHEN p_partkey % 23 = 0 THEN chr(13) || chr(10)
                    WHEN p_partkey % 5 = 0 THEN 'DEPT' || CAST(p_size % 5 AS VARCHAR) || chr(13) || chr(10)
                    ELSE 'DEPT' || CAST(p_size % 5 AS VARCHAR) END AS dept
        FROM (SELECT *, unnest(CASE WHEN p_partkey % 10 = 0 THEN [1, 2] ELSE [1] END) AS site FROM part)"""),
    "fx_system_items": (("fx_item_master",), """
        SELECT segment1, unnest([128, 204]) AS organization_id,
               'PL' || CAST(item_id % 10 AS VARCHAR)
               || CASE item_id % 4 WHEN 1 THEN 'B2B' WHEN 3 THEN 'XX' ELSE 'CM' END AS planner_code
        FROM (SELECT DISTINCT item_id, part_name AS segment1 FROM fx_item_master)"""),
    "fx_planners": (("fx_system_items",), """
        SELECT DISTINCT planner_code, 'Planner ' || planner_code AS description, organization_id,
               CAST(1000 + CAST(substr(planner_code, 3, 1) AS INTEGER) AS BIGINT) AS employee_id
        FROM fx_system_items"""),
    "fx_lines": ((), f"""
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus,
               CAST(l_quantity AS BIGINT) AS qty, {part('l_partkey')} AS product,
               CAST(3 + l_linenumber % 3 AS INTEGER) AS week_id,
               CASE WHEN l_orderkey % 97 = 0 THEN NULL
                    ELSE CAST(date_trunc('week', l_shipdate) AS DATE) END AS demand_date
        FROM lineitem"""),
    "fx_forecast": (("fx_lines",), """
        SELECT week_id, product AS component_part, demand_date, qty AS req_plan_non_gsa,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS req_plan_gsa,
               CAST(l_orderkey % 13 AS BIGINT) AS req_plan_forecast, CAST(l_orderkey % 3 AS BIGINT) AS req_plan_buffer,
               CAST(l_orderkey % 2 AS BIGINT) AS req_plan_buffer_opt_adj,
               qty + 5 AS original_irp_total_original, qty + 7 AS final_irp_total_final,
               'FAM' || CAST(l_partkey % 5 AS VARCHAR) AS product_family,
               CASE WHEN l_orderkey % 2 = 0 THEN s_name ELSE s_name || '.' END AS supplier,
               CAST(NULL AS VARCHAR) AS remarks
        FROM fx_lines JOIN supplier ON s_suppkey = l_suppkey"""),
    "fx_commits": (("fx_lines",), """
        SELECT l_orderkey * 100 + l_linenumber * 10 + n AS commit_id, CAST(NULL AS VARCHAR) AS planner_id,
               CAST(l_suppkey AS VARCHAR) AS supplier_id, product, qty - n AS non_gsa_commit_qty,
               CAST(n AS BIGINT) AS gsa_commit_qty, CAST(l_orderkey % 7 AS BIGINT) AS commit_quantity,
               'R' || CAST(l_orderkey % 5 AS VARCHAR) AS commit_reason,
               'c' || CAST(l_orderkey % 2 AS VARCHAR) AS commit_comments, CAST(l_suppkey AS VARCHAR) AS created_by,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(demand_date - CAST(n % 3 AS INTEGER) AS TIMESTAMP) END AS creation_date,
               CAST(l_suppkey AS VARCHAR) AS updated_by,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(demand_date - CAST(n % 3 AS INTEGER) AS TIMESTAMP) END AS updation_date,
               week_id, CAST(demand_date + CASE WHEN l_returnflag = 'N' THEN 7 ELSE 0 END AS DATE) AS demand_date
        FROM (SELECT *, unnest([1, 2, 4]) AS n FROM fx_lines)"""),
    "fx_adjustments": (("fx_lines",), """
        SELECT l_orderkey * 100 + l_linenumber * 10 + n AS adjustment_id, CAST(NULL AS VARCHAR) AS planner_id,
               CAST(l_suppkey AS VARCHAR) AS supplier_id, product, qty - n AS req_plan_non_gsa_adj,
               CAST(n AS BIGINT) AS req_plan_gsa_adj, CAST(l_orderkey % 7 AS BIGINT) AS adjustment_quantity,
               'T' || CAST(l_orderkey % 5 AS VARCHAR) AS adjustment_type,
               'a' || CAST(l_orderkey % 2 AS VARCHAR) AS adjustment_comments, CAST(l_suppkey AS VARCHAR) AS created_by,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(demand_date - CAST(n % 3 AS INTEGER) AS TIMESTAMP) END AS creation_date,
               CAST(l_suppkey AS VARCHAR) AS updated_by,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(demand_date - CAST(n % 3 AS INTEGER) AS TIMESTAMP) END AS updation_date,
               week_id, CAST(demand_date + CASE WHEN l_linestatus = 'F' THEN 7 ELSE 0 END AS DATE) AS demand_date
        FROM (SELECT *, unnest([1, 2, 4]) AS n FROM fx_lines)"""),
    "fx_revision_batch": ((), f"""
        SELECT o_orderkey AS ord, {part('o_custkey')} AS product,
               CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, o_orderkey % 50 AS non_gsa,
               o_orderkey % 4 AS gsa, o_orderkey % 13 AS fc, 'T' || CAST(o_orderkey % 5 AS VARCHAR) AS kind,
               'note' || CAST(o_orderkey AS VARCHAR) AS note
        FROM orders"""),
    "fx_tasks": ((), """
        SELECT event_id AS task_request_id, event_id AS task_approval_id, 'PL' || CAST(user_id % 10 AS VARCHAR) AS planner,
               'Planner' || CAST(user_id AS VARCHAR) AS task_from, CAST(user_id % 10 AS VARCHAR) AS supplier,
               'Supplier#' || lpad(CAST(user_id % 10 AS VARCHAR), 9, '0') AS task_to,
               'P' || CAST(event_id % 30 AS VARCHAR) AS product, CAST(CAST(ts AS DATE) AS VARCHAR) AS forecast_date,
               CAST(event_id % 100 AS VARCHAR) AS variances,
               CASE event_type WHEN 'error' THEN 'Close' WHEN 'signup' THEN NULL ELSE event_type END AS task_status,
               'subject' AS task_subject, 'm' || CAST(event_id AS VARCHAR) AS task_message,
               CAST(user_id AS VARCHAR) AS created_by, ts AS creation_date, CAST(user_id AS VARCHAR) AS updated_by,
               ts AS updation_date
        FROM events"""),
    "fx_task_actions": ((), """
        SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' ELSE 'OTHER' END AS action,
               CASE event_type WHEN 'error' THEN event_id + 100000000 WHEN 'signup' THEN event_id * 2
                    ELSE event_id - event_id % 10 END AS request_id,
               CASE user_id % 3 WHEN 0 THEN 'PLNR' WHEN 1 THEN 'CM' ELSE 'REQ' END AS login_type,
               CAST(user_id AS VARCHAR) AS login_value, 'PL' || CAST(user_id % 10 AS VARCHAR) AS planner,
               'F' || CAST(user_id AS VARCHAR) AS p_from, CAST(user_id % 10 AS VARCHAR) AS supplier,
               CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'T' || CAST(user_id AS VARCHAR) END AS p_to,
               'P' || CAST(event_id % 30 AS VARCHAR) AS product, CAST(ts AS DATE) AS forecast_date,
               event_id % 100 AS variance, CASE WHEN event_id % 2 = 0 THEN 'Close' ELSE 'Open' END AS status,
               'asked' AS subject,
               CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'msg' || CAST(event_id AS VARCHAR) END AS message
        FROM events"""),
    "fx_requests": ((), f"""
        SELECT o_orderkey AS request_id, CAST(o_custkey % 20 AS VARCHAR) AS planner_id,
               CAST(NULL AS VARCHAR) AS supplier_id, 'Brand#' || CAST(o_orderkey % 25 + 1 AS VARCHAR) AS product_family,
               'PL' AS product_line, 'P' || CAST(o_orderkey % 40 AS VARCHAR) AS product,
               o_orderkey % 9 AS request_quantity, o_orderpriority AS request_type, 'comment' AS request_comments,
               CAST(o_custkey % 20 AS VARCHAR) AS created_by, CAST(o_orderdate AS TIMESTAMP) AS creation_date,
               CAST(o_custkey % 20 AS VARCHAR) AS updated_by, CAST(o_orderdate AS TIMESTAMP) AS updation_date,
               CASE o_orderstatus WHEN 'P' THEN 'NEW' WHEN 'O' THEN NULL ELSE 'In Process' END AS approval_status,
               CAST(NULL AS VARCHAR) AS approval_workflow_id, 'A' || CAST(o_orderkey % 4 AS VARCHAR) AS approver_id,
               CAST(NULL AS TIMESTAMP) AS approved_date, {week('o_orderdate')} AS week_id
        FROM orders"""),
    "fx_new_requests": ((), """
        SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'Brand#1' END AS product_family,
               CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE 'PL' END AS product_line,
               CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE 'P5' END AS product,
               CASE WHEN o_orderkey % 13 = 4 THEN NULL ELSE o_orderkey % 9 END AS request_quantity,
               o_orderpriority AS request_type, CASE WHEN o_orderkey % 17 = 5 THEN NULL ELSE 'why' END AS request_comments,
               CASE WHEN o_orderkey % 19 = 6 THEN NULL ELSE 'A' || CAST(o_orderkey % 4 AS VARCHAR) END AS approver
        FROM orders"""),
    "fx_remove_requests": (("fx_requests",), """
        SELECT product_family, product_line, product, request_quantity,
               CASE WHEN request_id % 9 = 0 THEN NULL ELSE request_type END AS request_type,
               creation_date AS request_date, approver_id AS approver
        FROM fx_requests"""),
    "fx_approval_results": ((), """
        SELECT o_orderkey * 2 AS request_id, 'WF' || CAST(o_orderkey AS VARCHAR) AS workflow_id,
               o_orderpriority <> '1-URGENT' AS ok
        FROM orders"""),
    "fx_users": ((), """
        SELECT c_name AS user_name, CASE WHEN c_custkey % 4 IN (0, 3) THEN 1000 + c_custkey % 10 END AS employee_id,
               CASE WHEN c_custkey % 4 IN (1, 3) THEN c_custkey END AS supplier_id, c_mktsegment AS description
        FROM customer"""),
    "fx_supplier_contacts": ((), """
        SELECT c_custkey AS vendor_contact_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey + k) % 10 END AS vendor_site_id
        FROM (SELECT *, unnest(CASE WHEN c_custkey % 13 = 0 THEN [0, 1, 3] WHEN c_custkey % 5 = 0 THEN [0, 1]
                               ELSE [0] END) AS k FROM customer)"""),
    "fx_supplier_sites": ((), """
        SELECT s_suppkey AS vendor_site_id, CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE s_suppkey - s_suppkey % 2 END AS vendor_id
        FROM supplier"""),
    "fx_preferences": ((), """
        SELECT c_custkey AS user_id, c_name AS user_name, unnest(['VIEW', 'THEME']) AS preference_name,
               c_mktsegment AS preference_value
        FROM customer"""),
    "fx_preference_batch": ((), """
        SELECT c_custkey * 2 AS user_id, c_name AS user_name, 'VIEW' AS preference_name, 'MONTH' AS preference_value
        FROM customer"""),
    "fx_adj_reasons": ((), """
        SELECT 'T' || CAST(r_regionkey + 1 AS VARCHAR) AS ar_value, 'A' AS ar_type FROM region
        UNION ALL SELECT 'Reason ' || CAST(n_nationkey AS VARCHAR), 'R' FROM nation"""),
    "fx_adhoc": ((), f"""
        SELECT p_partkey * 10 + n AS ord,
               CASE WHEN p_partkey % 6 = 1 THEN 'BAD-' || CAST(p_partkey AS VARCHAR) ELSE {part('p_partkey')} END AS product,
               CASE WHEN p_partkey % 31 = 0 THEN NULL
                    ELSE CAST(DATE '1998-01-05' + CAST(p_partkey % 180 AS INTEGER) AS DATE) END AS forecast_date,
               CAST(CASE WHEN p_partkey % 9 = 2 AND n = 1 THEN 999999 ELSE p_partkey % 10 END AS BIGINT) AS vendor_id,
               'PL' || CAST(p_partkey % 10 AS VARCHAR) || 'CM' AS planner, p_brand AS product_family,
               CAST(n AS BIGINT) AS non_gsa_adj, CAST(2 AS BIGINT) AS gsa_adj, p_partkey % 5 AS forecast_adj,
               'T' || CAST(p_partkey % 5 AS VARCHAR) AS kind, 'adhoc' || CAST(p_partkey AS VARCHAR) AS note
        FROM (SELECT *, unnest([1, 2]) AS n FROM part)"""),
}


def with_tables(body: str, *extra: tuple[str, str]) -> str:
    """`body` after the common table expressions it names; `extra` are further (name, SQL) pairs."""
    text = body + " ".join(sql for _, sql in extra)
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for dep in CTES[name][0]:
            need(dep)
        needed.append(name)

    for name in CTES:
        if any(w.strip("(),;") == name for w in text.split()):
            need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in needed] + [f"{n} AS ({sql})" for n, sql in extra]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
