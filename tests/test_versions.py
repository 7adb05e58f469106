"""Versions of the stored transactions and the index of their ids."""

from datetime import date, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import TX, dec
from purseflow.operators import changes as c, key_index
from purseflow.sources import versions
from test_changes import CHANGE

START = date(2020, 1, 1)


def stored(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, TX + ", description string")
    root = str(tmp_path / "table")
    return root, table, versions.create_versions(table, root)


def some_rows(n, days=700, seed=1):
    random = Random(seed)
    return [
        (i, 1 + i % 2, "outbound", 4, dec(10 * i + 1), "USD", "US", START + timedelta(random.randrange(days)), None, None)
        for i in range(1, n + 1)
    ]


def edit(seq, op, key, user, fields=(), day=None, amount="5", description=None):
    return (seq, op, list(fields), description, key, user, "outbound", 4, dec(amount), "USD", "US", day, None)


def plain(df):
    return sorted(map(tuple, df.drop("month").collect()), key=repr)


def files_under(tmp_path):
    return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "table" / "data").rglob("*.parquet")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_equal_whole_table_changes(spark, users, categories, tmp_path, seed):
    """Batches one after another leave what the whole-table operator leaves."""
    random = Random(seed)
    rows = some_rows(60, seed=seed)
    root, table, _ = stored(spark, rows, tmp_path)
    for step in range(2):
        batch = []
        for seq in range(1, 16):
            op = random.choice(["insert", "patch", "patch", "delete"])
            key = random.choice([*range(1, 70), 1000 + seq + 100 * step])
            day = START + timedelta(random.randrange(900))
            fields = random.sample(["amount", "occurred_on", "description"], 2)
            batch.append(edit(seq, op, key, random.choice([1, 2]), fields, day, random.choice(["7", "0"]), "n"))
        changes = spark.createDataFrame(batch, CHANGE)
        expected, refused = c.apply_transactions(table, changes, categories, users)
        before, after, rejected = versions.apply_batch(spark, root, changes, categories, users)
        columns = table.columns
        assert plain(versions.read_version(spark, root).select(columns)) == plain(expected.select(columns))
        assert sorted(r.seq for r in rejected.collect()) == sorted(r.seq for r in refused.collect())
        assert after.number == before.number + 1
        table = c.staged(expected, "expected")
    assert sum(after.rows.values()) == table.count()


def test_a_batch_rewrites_only_its_months(spark, users, categories, tmp_path):
    root, table, first = stored(spark, some_rows(200), tmp_path)
    held = files_under(tmp_path)
    day = {r.id: r.occurred_on for r in table.collect()}
    moved_to = date(2021, 3, 5)
    batch = [
        edit(1, "patch", 7, 2, ["occurred_on"], moved_to),
        edit(2, "delete", 8, 1),
        edit(3, "delete", 9, 1),  # another user's row
        edit(4, "insert", 900, 1, day=date(2030, 1, 1)),
    ]
    changes = spark.createDataFrame(batch, CHANGE)
    before, after, rejected = versions.apply_batch(spark, root, changes, categories, users)
    assert before == first
    touched = {d.replace(day=1).isoformat() for d in (day[7], day[8], moved_to, date(2030, 1, 1))}
    assert set(versions.changed_months(before, after)) == touched
    assert [r.seq for r in rejected.collect()] == [3]
    # Old files are as they were, and the old version still reads them.
    now = files_under(tmp_path)
    assert all(now[p] == t for p, t in held.items())
    assert plain(versions.read_version(spark, root, 1).select(table.columns)) == plain(table)
    new = versions.read_version(spark, root).select(table.columns)
    assert new.filter("id = 8").count() == 0 and new.filter("id = 7").first().occurred_on == moved_to


def test_writers_of_the_same_version_conflict(spark, users, categories, tmp_path, monkeypatch):
    """A writer that started from a version which another has followed up fails; nothing changes."""
    root, table, first = stored(spark, some_rows(20), tmp_path)
    changes = spark.createDataFrame([edit(1, "delete", 2, 1)], CHANGE)
    versions.apply_batch(spark, root, changes, categories, users)
    current = plain(versions.read_version(spark, root))
    monkeypatch.setattr(versions, "open_version", lambda *a: first)
    late = spark.createDataFrame([edit(1, "delete", 4, 1)], CHANGE)
    with pytest.raises(versions.VersionConflict):
        versions.apply_batch(spark, root, late, categories, users)
    monkeypatch.undo()
    assert plain(versions.read_version(spark, root)) == current
    assert not [p for p in (tmp_path / "table" / "versions").iterdir() if p.name.startswith(".") and "crc" not in p.name]


def test_rows_without_a_day_and_emptied_months(spark, users, categories, tmp_path):
    rows = some_rows(3, days=1) + [(50, 1, "outbound", 4, dec(1), "USD", "US", None, None, None)]
    root, table, first = stored(spark, rows, tmp_path)
    assert set(first.batches) == {"2020-01-01", versions.NO_MONTH}
    changes = spark.createDataFrame([edit(k, "delete", k, 1 + k % 2) for k in (1, 2, 3)], CHANGE)
    _, after, _ = versions.apply_batch(spark, root, changes, categories, users)
    assert set(after.batches) == {versions.NO_MONTH}
    changes = spark.createDataFrame([edit(1, "patch", 50, 1, ["occurred_on"], START)], CHANGE)
    _, after, _ = versions.apply_batch(spark, root, changes, categories, users)
    assert set(after.batches) == {"2020-01-01"} and after.number == 3
    _, same, _ = versions.apply_batch(spark, root, changes.limit(0), categories, users)
    assert same == after
    changes = spark.createDataFrame([edit(1, "delete", 50, 1)], CHANGE)
    _, last, _ = versions.apply_batch(spark, root, changes, categories, users)
    assert not last.batches and versions.read_version(spark, root).count() == 0
    changes = spark.createDataFrame([edit(1, "insert", 50, 1, day=START)], CHANGE)
    assert versions.apply_batch(spark, root, changes, categories, users)[1].rows == {"2020-01-01": 1}


def test_look_ups_read_only_months_that_may_hold_the_ids(spark, tmp_path):
    root, table, first = stored(spark, some_rows(400), tmp_path)
    day = {r.id: r.occurred_on for r in table.collect()}
    for wanted in ([5], [17, 230], [10**9], []):
        ids = spark.createDataFrame([(i,) for i in wanted], "id bigint")
        found = versions.months_that_may_hold(spark, root, first, ids)
        true = {day[i].replace(day=1).isoformat() for i in wanted if i in day}
        assert true <= set(found) and len(found) <= len(true) + 1
        rows = versions.in_months(versions.rows_of(spark, root, first), found)
        assert len(rows.inputFiles()) >= 0
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not found or "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_key_index_against_sets(spark):
    """No id is missed; false positives stay rare. Ranges alone decide for large batches."""
    rows = [(f"p{k % 5}", k * 7) for k in range(20_000)] + [("p1", None)]
    frame = spark.createDataFrame(rows, "part string, id bigint")
    sizes = {f"p{k}": 4000 for k in range(5)}
    index = c.staged(key_index.build(frame, sizes), "index")
    assert index.columns == [f.split()[0] for f in key_index.SCHEMA.split(", ")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    for k in (0, 3, 19_999):
        assert f"p{k % 5}" in key_index.parts_that_may_hold(index, ids(k * 7))
    absent = [k * 7 + 3 for k in range(0, 20_000, 101)]
    hits = sum(len(key_index.parts_that_may_hold(index, ids(i))) for i in absent[:12])
    assert hits <= 2
    assert key_index.parts_that_may_hold(index, ids(-5, 10**12)) == []
    assert key_index.parts_that_may_hold(index, ids(-5, 10**12), most_ids=1) == sorted(sizes)
    assert key_index.parts_that_may_hold(index, ids()) == []
    assert key_index.build(frame.limit(0), {}).count() == 0
    assert index.select(F.max(F.length("bits"))).first()[0] == key_index.BITMAP_BITS // 8
