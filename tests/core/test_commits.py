"""Committed tables: snapshots, failures, reruns, two writers, compaction; and the stores made of them."""

import pytest
from pyspark.sql import functions as F

from fieldcanon.operators import corrections, stores
from fieldcanon.sources import tables
from fieldcanon.sources.commits import CommittedTable, Conflict, put_if_absent

SCHEMA = "k string, v bigint"


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, f"file://{tmp_path}/t", SCHEMA)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()))


def folders(tmp_path):
    data = tmp_path / "t" / "data"
    return sorted(p.name for p in data.iterdir()) if data.exists() else []


def test_versions_and_snapshots(spark, table):
    assert table.version() == 0 and found(table.read()) == []
    assert table.append(rows(spark, ("a", 1))) == 1
    old = table.read()
    assert table.append(rows(spark, ("b", 2))) == 2 and table.replace(rows(spark, ("c", 3))) == 3
    assert found(old) == [("a", 1)] and found(table.read(2)) == [("a", 1), ("b", 2)] and found(table.read()) == [("c", 3)]
    assert found(table.since(1, 2)) == [("b", 2)]
    with pytest.raises(ValueError):
        table.since(1)


def test_a_failed_write_leaves_the_table(spark, table, tmp_path):
    table.append(rows(spark, ("a", 1)))
    before = folders(tmp_path)
    broken = rows(spark, ("b", 2), ("c", 0)).withColumn("v", F.expr("if(v = 0, cast(raise_error('lost') as bigint), v)"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert table.version() == 1 and found(table.read()) == [("a", 1)] and folders(tmp_path) == before


def test_a_rerun_adds_nothing(spark, table, tmp_path):
    for _ in range(3):
        table.append(rows(spark, ("a", 1)), "first")
    table.append(rows(spark, ("a", 1)), "second")
    assert table.version() == 2 and found(table.read()) == [("a", 1)] * 2 and len(folders(tmp_path)) == 2
    table.compact()
    table.append(rows(spark, ("a", 1)), "first")
    assert table.version() == 3  # batches are known after a rewrite, too


def test_two_writers(spark, table, tmp_path):
    """Both begin with the same version; the second one's first attempt fails and leaves nothing behind."""
    asked = []

    def unless_there(name):
        def make(now):
            asked.append(name)
            if asked == ["slow"]:  # while the slow one looks, the fast one writes
                table.change(unless_there("fast"))
            return rows(spark, ("x", len(asked))).join(now, "k", "left_anti")

        return make

    table.change(unless_there("slow"))
    assert asked == ["slow", "fast", "slow"] and found(table.read()) == [("x", 2)]
    with pytest.raises(Conflict):
        table.commit(rows(spark, ("y", 1)), 0)
    assert len(folders(tmp_path)) == table.version() == 2


def test_put_if_absent(spark, tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert (tmp_path / "log" / "1.json").read_text() == "one"
    assert [p.name for p in (tmp_path / "log").iterdir() if p.suffix != ".crc"] == ["1.json"]


def test_compaction_and_vacuum(spark, table, tmp_path):
    for n in range(5):
        table.append(rows(spark, (f"k{n}", n)))
    want = found(table.read())
    assert table.compact() == 6 and found(table.read()) == want and len(table._parts(None)) == 1
    assert found(table.read(3)) == want[:3]
    assert table.vacuum() == 5 and len(folders(tmp_path)) == 1 and found(table.read()) == want


SENT = "id string, submitted_at string, field_key string, country string, raw_value string, proposed string"


def sent(spark, *items):
    return spark.createDataFrame([(i, "2024", "brn_type", "", raw, label) for i, raw, label in items], SENT)


def decided(spark, *items):
    return spark.createDataFrame([(i, action, at, n, "", False) for n, (i, action, at) in enumerate(items)], stores.DECISION)


def test_queue_store(spark, tmp_path):
    queue = stores.QueueStore(spark, f"file://{tmp_path}/q", SENT)
    queue.submit(sent(spark, ("1", "x", "LEI"), ("2", " x ", "VAT Number"), ("3", "y", "LEI")), "id", "a")
    queue.submit(sent(spark, ("4", "x", "LEI"), ("5", "z", "LEI")), "id", "b")
    state = lambda: {r.id: r.status for r in queue.state().collect()}
    assert state() == {"1": "pending", "3": "pending", "5": "pending"}
    queue.decide(decided(spark, ("1", "approve", "2024-02"), ("3", "reject", "2024-02"), ("3", "approve", "2024-03")), "d")
    queue.compact()
    queue.decide(decided(spark, ("1", "approve", "2024-02"), ("3", "reject", "2024-02"), ("3", "approve", "2024-03")), "d")
    queue.decide(decided(spark, ("3", "approve", "2024-01"), ("1", "reject", "2024-09")), "late")
    assert state() == {"1": "approved", "3": "approved", "5": "pending"}  # taken earlier, although it came later
    assert queue.decisions.read().count() == 4  # of five different ones
    queue.submit(sent(spark, ("6", "x", "VAT Number")), "id", "c")
    assert state()["6"] == "pending"

    lookup = stores.lookup_store(spark, f"file://{tmp_path}/l")
    lookup.replace(spark.createDataFrame([("brn_type", "consistent", "", "x", "Tax ID Number")], stores.LOOKUP))
    old = lookup.read()
    for _ in range(2):
        queue.apply_to(lookup, "today")
    assert lookup.version() == 2 and {(r.raw, r.std) for r in lookup.read().collect()} == {("x", "LEI"), ("y", "LEI")}
    assert [r["std"] for r in old.collect()] == ["Tax ID Number"]


def test_two_submitters_cannot_both_pass(spark, tmp_path, monkeypatch):
    queue = stores.QueueStore(spark, f"file://{tmp_path}/q", SENT)
    queue.submissions.append(sent(spark, ("0", "other", "LEI")))
    looked, real = [], corrections.new_submissions

    def looking(*args):
        looked.append(1)
        if len(looked) == 1:
            queue.submit(sent(spark, ("fast", "x", "LEI")), "id", "fast")
        return real(*args)

    monkeypatch.setattr(stores, "new_submissions", looking)
    queue.submit(sent(spark, ("slow", "x", "VAT Number")), "id", "slow")
    assert sorted(r.id for r in queue.state().collect()) == ["0", "fast"] and len(looked) == 3


def test_events_and_records_of_a_rerun(spark, tmp_path):
    events = spark.createDataFrame([("1", "approve")], "id string, action string")
    for _ in range(2):
        tables.append_events(events, f"file://{tmp_path}/e", "b")
    assert tables.read_events(spark, f"file://{tmp_path}/e", "id string, action string").count() == 1
    assert tables.read_events(spark, f"file://{tmp_path}/none", "id string, action string").count() == 0
