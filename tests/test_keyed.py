import glob
import os
from datetime import date, datetime

from pyspark.sql import functions as F

from feedspan.sources.keyed import FOLDER, KeyedTable, drop_days_before, purge_days
from feedspan.sources.storage import write_by_day

from conftest import rows


def keyed(spark, path, n=400, folders=50):
    table = spark.range(n).selectExpr("id", "id % 7 AS user_id", "1 AS version", "'old ' || id AS name")
    return KeyedTable(spark, str(path), table.schema, ["id"], folders).create(table)


def written(path):
    """Folder -> its files with their times."""
    out = {}
    for f in glob.glob(f"{path}/{FOLDER}=*/*.parquet"):
        out.setdefault(os.path.basename(os.path.dirname(f)), set()).add((f, os.path.getmtime(f)))
    return out


def changed_folders(before, after):
    return {k for k in before | after if before.get(k) != after.get(k)}


def test_ten_changes_rewrite_ten_folders(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    before = written(tmp_path / "t")
    edits = spark.createDataFrame([(i, f"new {i}", i) for i in range(0, 400, 40)], "id bigint, name string, seq int")
    done = table.update(edits, ["name"], ["seq"])
    assert 0 < len(changed_folders(before, written(tmp_path / "t"))) <= 10
    assert rows(done.changed.select("id", "name")) == sorted(((i, f"new {i}") for i in range(0, 400, 40)), key=lambda t: tuple(map(str, t)))
    now = {r["id"]: r["name"] for r in table.read().collect()}
    assert len(now) == 400 and all(now[i] == (f"new {i}" if i % 40 == 0 else f"old {i}") for i in now)


def test_only_touched_folders_are_read(spark, tmp_path):
    """Files of other folders may be broken."""
    table = keyed(spark, tmp_path / "t")
    edit = spark.createDataFrame([(5, "new", 1)], "id bigint, name string, seq int")
    mine = str(edit.select(table.folder()).first()[0])
    for f in glob.glob(f"{tmp_path}/t/{FOLDER}=*/*.parquet"):
        if f"{FOLDER}={mine}/" not in f:
            open(f, "wb").write(b"broken")
    assert [r["name"] for r in table.update(edit, ["name"], ["seq"]).changed.collect()] == ["new"]


def test_versions_conflicts_and_unknown_keys(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    edits = spark.createDataFrame(
        [(1, 3, 1, 1, "a"), (2, 3, 1, 1, "b"), (3, 4, 4, 9, "stale"), (4, 999, 1, 1, "unknown"), (5, 5, 6, 1, "wrong user")],
        "seq int, id bigint, user_id bigint, version int, name string")
    edits = edits.withColumn("user_id", F.when(F.col("seq") < 4, F.col("id") % 7).otherwise(F.col("user_id")))
    done = table.update_versions(edits, ["name"], ["seq"], on=["id", "user_id"])
    assert sorted(r["seq"] for r in done.rejected.collect()) == [2, 3, 4, 5]
    got = {r["id"]: (r["name"], r["version"]) for r in table.read().collect()}
    assert got[3] == ("a", 2) and got[4] == ("old 4", 1) and got[5] == ("old 5", 1) and len(got) == 400


def test_deleting_all_rows_of_a_folder(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", n=30, folders=200)
    folders = len(written(tmp_path / "t"))
    done = table.delete(spark.createDataFrame([(1,), (2,), (77,)], "id bigint"))
    assert [r["id"] for r in done.rejected.collect()] == [77]
    assert sorted(r["id"] for r in table.read().collect()) == [0, *range(3, 30)]
    assert len(written(tmp_path / "t")) < folders
    again = table.delete(table.read().select("id"))
    assert again.changed.count() == 28 and not written(tmp_path / "t")


def test_inserts_append_and_number(spark, tmp_path):
    rows_in = spark.createDataFrame([(7, "u/7", 1), (9, "u/9", 2)], "id bigint, url string, user_id bigint")
    table = KeyedTable(spark, str(tmp_path / "t"), rows_in.schema, ["url"], 20).create(rows_in)
    before = written(tmp_path / "t")
    batch = spark.createDataFrame([(1, "u/7"), (2, "u/x"), (3, "u/x"), (4, "u/y")], "seq int, url string")
    done = table.insert(batch, ["seq"])
    assert sorted((r["seq"], r["id"]) for r in done.changed.collect()) == [(2, 10), (4, 11)]
    assert sorted(r["seq"] for r in done.rejected.collect()) == [1, 3]
    assert rows(table.read()) == [(10, "u/x", None), (11, "u/y", None), (7, "u/7", 1), (9, "u/9", 2)]
    after = written(tmp_path / "t")
    assert all(before[k] <= after[k] for k in before)


def test_expired_days_are_dropped_unread(spark, tmp_path):
    path = str(tmp_path / "days")
    schema = "id bigint, created_at timestamp_ntz"
    data = spark.range(96).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("created_at"))
    write_by_day(data, path)
    # What isn't read may be broken.
    for f in glob.glob(f"{path}/day=2024-01-01/*.parquet"):
        open(f, "wb").write(b"broken")
    kept = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=2024-01-0[34]/*.parquet")}
    gone = purge_days(spark, path, data.schema, datetime(2024, 1, 2, 12, 30), 60)
    assert gone == ["2024-01-01"]
    got = sorted(r["id"] for r in spark.read.schema(schema).parquet(path).collect())
    assert got == list(range(36, 96))
    assert all(os.path.getmtime(f) == t for f, t in kept.items())
    assert purge_days(spark, path, data.schema, datetime(2024, 1, 3), 0) == ["2024-01-02"]
    assert drop_days_before(spark, path, date(2025, 1, 1)) == ["2024-01-03", "2024-01-04"]
    assert purge_days(spark, str(tmp_path / "nothing"), data.schema, datetime(2024, 1, 3), 0) == []
