"""Headline reports over stored plan tables; prints one JSON line.

BENCH_SF_DIR names the test-data folder, BENCH_CPUS the cores. The plan tables are derived
from it once and stored as Parquet under a fresh folder in BENCH_WORK_DIR ("prepare"); every
report then starts from the stored tables and is written to a sink that discards it (an append stores its rows). Each
report runs once to warm up and BENCH_RUNS times (default 1) for the clock; the least counts.

"comparison" is the weekly report in its direct SQL form (every row of the joined plan, a
correlated maximum per log) on the same tables and session; it is not part of "value".
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from supplyplan import EVERY, Tables, VarianceFilter
from supplyplan.operators import comparison, panels, plan_edits, variance
from supplyplan.plans.ledger import next_id
from supplyplan.sources.derived import AS_OF, PLAN_TABLES, DerivedTables
from supplyplan.sources.id_blocks import IdBlocks
from supplyplan.sources.schemas import conform
from supplyplan.sources.storage import append_rows, read_tables, write_version

WHOLE = VarianceFilter(planners=[None], vendors=EVERY)
SINGLE = VarianceFilter.single("PL1B2B", 5)
STORED = (*PLAN_TABLES, "tasks")


def _session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("supplyplan-bench")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _store(spark: SparkSession, folder: str, root: str, files: int) -> Tables:
    derived = DerivedTables(spark, folder)
    for name in STORED:
        df = conform(getattr(derived, name), name)
        # the test data is one file per table; plan tables of any size have many
        write_version(df.repartition(files, "week_id") if name in ("forecast", "commits", "adjustments") else df, root, name)
    return read_tables(spark, root, *STORED)


def _discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _dashboard(t: Tables) -> None:
    board = panels.dashboard(t, "PLNR", 1001, [0, 1, 2, 3, 4, 5])
    for df in board.panels().values():
        _discard(df)
    board.release()


DIRECT = """
    SELECT f.component_part, f.demand_date, year(f.demand_date) AS year, a.adjustment_type, a.adjustment_comments,
           i.part_site, i.bu, i.build_type,
           sum(coalesce(f.req_plan_non_gsa, 0)), sum(coalesce(f.req_plan_gsa, 0)), sum(coalesce(f.req_plan_forecast, 0)),
           sum(coalesce(f.req_plan_buffer, 0)), sum(coalesce(f.req_plan_buffer_opt_adj, 0)),
           sum(coalesce(f.original_irp_total_original, 0)), sum(coalesce(f.final_irp_total_final, 0)),
           sum(coalesce(c.non_gsa_commit_qty, 0)), sum(coalesce(c.gsa_commit_qty, 0)), sum(coalesce(c.commit_quantity, 0)),
           sum(coalesce(a.req_plan_non_gsa_adj, 0)), sum(coalesce(a.req_plan_gsa_adj, 0)),
           sum(coalesce(a.adjustment_quantity, 0))
    FROM {forecast} f JOIN {item_master} i ON i.part_name = f.component_part
    JOIN {system_items} m ON m.segment1 = i.part_name
    LEFT JOIN {commits} c ON c.product = f.component_part AND c.week_id = f.week_id AND c.demand_date = f.demand_date
    LEFT JOIN {adjustments} a ON a.product = f.component_part AND a.week_id = f.week_id AND a.demand_date = f.demand_date
    WHERE f.week_id = 4 AND m.organization_id = 128 AND (m.planner_code LIKE '%CM' OR m.planner_code LIKE '%B2B')
      AND c.creation_date <=> (SELECT max(n.creation_date) FROM {commits} n WHERE n.product = c.product
                               AND n.week_id = c.week_id AND n.demand_date = c.demand_date)
      AND a.creation_date <=> (SELECT max(n.creation_date) FROM {adjustments} n WHERE n.product = a.product
                               AND n.week_id = a.week_id AND n.demand_date = a.demand_date)
      AND upper(replace(f.supplier, '.', '')) IN (SELECT upper(vendor_name) FROM {suppliers})
      AND i.product_family IS NOT NULL AND nullif(translate(i.dept, '\\n\\r', ''), '') IS NOT NULL
    GROUP BY ALL ORDER BY 1, 2"""


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = _session(cpus)
    root = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_WORK_DIR", "/tmp"))

    start = time.perf_counter()
    t = _store(spark, folder, root, 2 * int(cpus) if cpus.isdigit() else 16)
    prepare = time.perf_counter() - start
    batch = DerivedTables(spark, folder).revision_batch
    ids = IdBlocks(spark, f"{root}/ids", lambda: next_id(t.adjustments, "adjustment_id"))

    reports = {
        "variance_week": lambda: _discard(variance.variance_by_view(t, "PLNR", "WEEK", WHOLE, AS_OF)),
        "variance_week_single": lambda: _discard(variance.variance_by_view(t, "PLNR", "WEEK", SINGLE, AS_OF)),
        "variance_rows": lambda: _discard(variance.variance_rows(t, "PLNR", WHOLE)),
        "exceptions_plnr": lambda: _discard(panels.exceptions_by_counterparty(t, "PLNR", 1001)),
        "forecast_commit_receive": lambda: _discard(panels.forecast_commit_receive(t, "CM", 5)),
        "dashboard": lambda: _dashboard(t),
        "week_comparison": lambda: [_discard(df) for df in comparison.week_comparison(t, WHOLE, AS_OF)],
        # the new rows only, numbered from a reserved block and stored
        "append_adjustments": lambda: append_rows(
            plan_edits.new_adjustments(t.adjustments, batch, "PL1B2B", "5", AS_OF, ids), f"{root}/appended", "adjustments"),
    }
    plan = {n: getattr(t, n) for n in PLAN_TABLES if n != "planners"}

    def seconds(run) -> float:
        run()
        best = float("inf")
        for _ in range(runs):
            begin = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - begin)
        return round(best, 3)

    # both forms of the weekly report run first and again below, on a warm JVM
    direct_run = lambda: _discard(spark.sql(DIRECT, **plan))
    for run in (reports["variance_week"], direct_run):
        run()
    times = {name: seconds(run) for name, run in reports.items()}
    direct = seconds(direct_run)
    print(json.dumps({
        "metric": "headline_reports_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"), "prepare": round(prepare, 3),
        "comparison": {"variance_week_direct_sql": direct}}))
    spark.stop()


if __name__ == "__main__":
    main()
