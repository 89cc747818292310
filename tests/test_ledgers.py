"""Stored ledgers and reserved ids: what is rewritten, what readers see, what two writers get."""

import threading

import pytest
from pyspark.sql import functions as F
from test_rules import AS_OF, _REQUEST, _new, table

from supplyplan.operators import plan_edits, preferences, requests, tasks
from supplyplan.sources.files import create_once, names, read_text
from supplyplan.sources.id_blocks import IdBlocks
from supplyplan.sources.ledgers import StoredLedger


def ids_of(df, column="request_id"):
    return sorted(r[0] for r in df.select(column).collect())


@pytest.fixture
def stored(spark, tmp_path):
    """Requests 1 to 100 of two users in ranges of ten, one without an id."""
    ledger = StoredLedger(spark, str(tmp_path), "requests", "request_id", width=10)
    rows = [dict(request_id=k, planner_id=str(k % 2), created_by=str(k % 2), approval_status="NEW", **{**_REQUEST, "product": f"P{k}"})
            for k in range(1, 101)]
    ledger.create(table(spark, "requests", *rows, dict(planner_id="1", created_by="1", **{**_REQUEST, "product": "none"})))
    return ledger


def removal(spark, *products):
    return spark.createDataFrame([("F", "PL", p, 3, "T", AS_OF, "a") for p in products],
                                 "product_family string, product_line string, product string, request_quantity int, "
                                 "request_type string, request_date timestamp_ntz, approver string")


def answers(spark, *ids):
    return spark.createDataFrame([(k, f"W{k}", True) for k in ids], "request_id long, workflow_id string, ok boolean")


def test_a_change_rewrites_only_files_of_its_keys(spark, stored):
    before = stored.files()
    assert len(before) >= 11 and sum(f.rows for f in before) == 101
    assert requests.store_requests(stored, "1", AS_OF, results=answers(spark, 5, 55, 999)) == 2
    after = stored.files()
    gone = [f for f in before if f not in after]
    assert len(gone) == 2 and all(f.low <= k <= f.high for f, k in zip(sorted(gone, key=lambda f: f.low), (5, 55)))
    assert len(set(after) - set(before)) <= 2
    moved = stored.read().where("approval_workflow_id IS NOT NULL")
    assert {(r.request_id, r.approval_workflow_id, r.approval_status) for r in moved.collect()} == {
        (5, "W5", "In Process"), (55, "W55", "In Process")}
    assert stored.read().count() == 101


def test_unknown_keys_rewrite_nothing(spark, stored):
    before = stored.files()
    requests.store_requests(stored, "1", AS_OF, results=answers(spark, 1000, -5))
    requests.store_requests(stored, "1", AS_OF, remove=removal(spark, "P2"))  # of the other user
    assert stored.files() == before


def test_old_versions_stay_readable(spark, stored):
    old = stored.read()
    requests.store_requests(stored, "1", AS_OF, remove=removal(spark, "P7", "P33", "none"))
    assert old.count() == 101 and stored.read(1).count() == 101
    assert stored.read().count() == 98 and not {7, 33} & set(ids_of(stored.read()))


def test_same_rows_as_the_whole_table_form(spark, stored):
    new = _new(spark, dict(request_comments="c", approver="A", **_REQUEST), dict(request_comments="c", **_REQUEST))
    steps = dict(new=new, remove=removal(spark, "P9", "P"), results=answers(spark, 4, 8, 101))
    expected = requests.apply_requests(stored.read(), "1", AS_OF, **steps)
    wanted = sorted(map(str, expected.collect()))
    requests.store_requests(stored, "1", AS_OF, **steps)
    assert sorted(map(str, stored.read().collect())) == wanted


def test_append_reads_and_rewrites_no_file(spark, stored):
    before = stored.files()
    more = table(spark, "requests", dict(request_id=3, planner_id="9"), dict(request_id=500, planner_id="9"))
    stored.append(more)
    assert set(before) <= set(stored.files()) and stored.read().count() == 103
    # a key that lies in two files changes in both, and a file that only spans it stays
    requests.store_requests(stored, "1", AS_OF, results=answers(spark, 3))
    assert stored.read().where("request_id = 3 AND approval_status = 'In Process'").count() == 2


def test_a_key_with_most_rows_is_split(spark, tmp_path):
    ledger = StoredLedger(spark, str(tmp_path), "preferences", "user_id", file_rows=100)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id")).alias("user_id"),
                                    F.lit("n").alias("preference_name"), F.col("id").cast("string").alias("preference_value"))
    ledger.create(rows)
    assert max(f.rows for f in ledger.files()) <= 100
    batch = table(spark, "preferences", dict(user_id=7, preference_name="n", preference_value=""))
    preferences.store_preferences(ledger, batch)
    assert [r.preference_value for r in ledger.read().where("user_id = 7").collect()] == [None]
    assert ledger.read().count() == 301


def test_empty_ledger_and_empty_batch(spark, tmp_path):
    ledger = StoredLedger(spark, str(tmp_path), "preferences", "user_id")
    none = table(spark, "preferences")
    assert ledger.read().count() == 0
    ledger.create(none)
    preferences.store_preferences(ledger, none)
    assert ledger.read().count() == 0 and ledger.version() == 2
    with pytest.raises(FileExistsError):
        ledger.create(none)


def test_a_second_writer_starts_again(spark, stored):
    """A change that loses the race is made anew on the version that won."""
    late = []

    def slow(rows):
        if not late:
            late.append(requests.store_requests(stored, "1", AS_OF, results=answers(spark, 1, 92)))
        return requests.remove_requests(rows, removal(spark, "P1"), "1")

    assert stored.change(spark.createDataFrame([(1,)], "request_id long"), slow) == 3
    rows = {r.request_id: r.approval_status for r in stored.read().collect()}
    assert 1 not in rows and rows[92] == "In Process" and len(rows) == 100


def test_tasks_in_a_stored_ledger(spark, tmp_path):
    ledger = StoredLedger(spark, str(tmp_path), "tasks", "task_request_id", width=10)
    rows = table(spark, "tasks", *[dict(task_request_id=k, task_status="Open", task_message="m") for k in range(40)])
    ledger.create(rows)
    columns = """ord long, action string, request_id string, login_type string, login_value string, planner string,
        p_from string, supplier string, p_to string, product string, forecast_date date, variance int, status string,
        subject string, message string"""
    action = lambda o, what, key, **r: (o, what, key, "PLNR", "l", "p", "from", None, "to", None, None, None, "Done", "s", f"x{o}")
    batch = spark.createDataFrame([action(1, "CREATE", None), action(2, "UPDATE", "15"), action(3, "UPDATE", "40"),
                                   action(4, "UPDATE", "bad"), action(5, "UPDATE", "15")], columns)
    expected = sorted(map(str, tasks.apply_task_actions(rows, batch, AS_OF).collect()))
    before = ledger.files()
    tasks.store_task_actions(ledger, batch, AS_OF, IdBlocks(spark, str(tmp_path / "ids"), 40))
    assert sorted(map(str, ledger.read().collect())) == expected
    assert len(set(before) - set(ledger.files())) == 1


def test_files_are_bounded_where_keys_span_many_ranges(spark, tmp_path):
    """Neighbouring ranges share a folder, so a ledger of many ranges has few files; keys are still found in them."""
    ledger = StoredLedger(spark, str(tmp_path), "preferences", "user_id", width=1)
    rows = spark.range(3000).select(F.when(F.col("id") % 500 != 7, F.col("id") * 1_000_003 - 10_000).alias("user_id"),
                                    F.lit("n").alias("preference_name"), F.col("id").cast("string").alias("preference_value"))
    ledger.create(rows)
    before = ledger.files()
    assert len(before) <= 300 and sum(f.rows for f in before) == 3000
    batch = table(spark, "preferences", dict(user_id=5 * 1_000_003 - 10_000, preference_name="n", preference_value="x"),
                  dict(user_id=4, preference_name="n", preference_value="y"))
    preferences.store_preferences(ledger, batch)
    assert len({f.path for f in before} - {f.path for f in ledger.files()}) == 1
    assert ledger.read().count() == 3001 and ledger.read().where("user_id IS NULL").count() == 6


# ids

def test_two_writers_get_disjoint_ids(spark, tmp_path):
    """Two appends that are built before either is stored, the log never read."""
    schema = "ord long, product string, monday date, non_gsa_adjustment int, gsa_adjustment int, adjustment int, adjustment_type string, adjustment_comment string"
    batch = spark.createDataFrame([(k, "P", None, 1, 1, 1, "T", "c") for k in range(50)], schema)
    unread = spark.createDataFrame([], table(spark, "adjustments").schema).where(F.raise_error("the log was read").cast("boolean"))
    ids = IdBlocks(spark, str(tmp_path / "ids"), 1001)
    a, b = (plan_edits.new_adjustments(unread, batch, "p", "v", AS_OF, ids) for _ in range(2))
    assert ids_of(a, "adjustment_id") == list(range(1001, 1051)) and ids_of(b, "adjustment_id") == list(range(1051, 1101))


def test_reservations_by_many_threads(spark, tmp_path):
    ids, got = IdBlocks(spark, str(tmp_path / "ids")), []
    work = lambda n: got.extend((ids(n), n) for _ in range(8))
    threads = [threading.Thread(target=work, args=(n,)) for n in (1, 3, 10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    taken = sorted(k for first, n in got for k in range(first, first + n))
    assert taken == list(range(1, 8 * 14 + 1))
    assert ids(0) == 113 and ids(1) == 113


def test_files_are_created_once(spark, tmp_path):
    path = str(tmp_path / "a" / "x")
    assert names(spark, str(tmp_path / "a")) == []
    assert create_once(spark, path, "one") and not create_once(spark, path, "two")
    assert read_text(spark, path) == "one" and names(spark, str(tmp_path / "a")) == ["x"]


def test_first_id_comes_from_the_log_once(spark, tmp_path):
    asked = []
    ids = IdBlocks(spark, str(tmp_path / "ids"), lambda: asked.append(1) or 7)
    assert [ids(2), ids(2), ids(1)] == [7, 9, 11] and asked == [1]
