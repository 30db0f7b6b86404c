"""Versions of tables, observed checks, and batches of objects by commit."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from cairn.sources import files, sinks, versions


def test_a_reader_in_a_loop_never_misses_the_table(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    versions.write_version(spark.range(10), folder)
    stop, seen, wrong = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                pointer = versions.current(folder)
                seen.add(pointer["metrics"]["rows"])
                assert (tmp_path / "t" / pointer["version"] / "_SUCCESS").exists()
            except Exception as e:  # any miss at all
                wrong.append(e)

    thread = threading.Thread(target=read)
    thread.start()
    for n in range(11, 15):
        versions.write_version(spark.range(n), folder)
    stop.set()
    thread.join()
    assert not wrong and {10, 14} <= seen | {14} and versions.read_version(spark, folder).count() == 14
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2


def test_failed_writes_and_checks_change_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, folder)
    checks = versions.Checks({"largest": F.max("id")}, {"no row is beyond 5": lambda m: m["largest"] <= 5}, {"there are many": lambda m: m["rows"] > 100})
    first = versions.write_version(spark.range(5), folder, checks)
    assert first["metrics"] == {"rows": 5, "largest": 4} and first["warnings"] == ["there are many"]
    with pytest.raises(versions.CheckFailed, match="beyond 5"):
        versions.write_version(spark.range(50), folder, checks)
    with pytest.raises(Exception):
        versions.write_version(spark.range(3).select(F.raise_error(F.lit("x")).alias("id")), folder)
    assert versions.current(folder) == first and [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()] == [first["version"]]


def test_rows_are_scanned_once_for_write_and_counts(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(counted, "id bigint")
    found = versions.write_version(rows, f"file://{tmp_path}/t", versions.Checks({"sum": F.sum("id")}, {"all": lambda m: m["rows"] == 100}))
    assert found["metrics"]["sum"] == 4950 and scans.value == 100
    observed, _ = versions.Checks({"sum": F.sum("id")}).observed(spark.range(3))
    assert "CollectMetrics" in observed._jdf.queryExecution().executedPlan().toString()


def test_partitioned_versions(spark, tmp_path):
    versions.write_version(spark.range(10).withColumn("k", F.col("id") % 2), f"file://{tmp_path}/t", partition_by=("k",))
    assert versions.read_version(spark, f"file://{tmp_path}/t").where("k = 1").count() == 5


@pytest.mark.parametrize("key", ["a/b", "..", "../x", ".hidden", "", None, "a\nb", "x" * 300])
def test_keys_that_name_other_places_are_refused(spark, tmp_path, key):
    rows = spark.createDataFrame([("good", 1), (key, 2)], "key string, n int")
    for publish in (lambda: sinks.publish_batch(rows, f"file://{tmp_path}/o", "key", "b1"), lambda: sinks.publish_objects(rows, f"file://{tmp_path}/p", "key").collect()):
        with pytest.raises(Exception, match="not a key"):
            publish()
    assert not (tmp_path / "o/_summary.json").exists() and not list((tmp_path / "o").glob("*/*"))


def test_a_killed_task_leaves_no_visible_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/o"
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "key string, n int").repartition(4)
    sinks.publish_batch(rows, folder, "key", "first")
    before = (tmp_path / "o/_summary.json").read_text()
    broken = rows.withColumn("n", F.when(F.col("n") == 13, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="killed"):
        sinks.publish_batch(broken, folder, "key", "second")
    assert (tmp_path / "o/_summary.json").read_text() == before and len(list((tmp_path / "o/first").iterdir())) == 20
    sinks.publish_batch(rows.limit(3), folder, "key", "third")
    assert json.loads((tmp_path / "o/_summary.json").read_text())["objects"] == 3 and sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["third"]
    with pytest.raises(FileExistsError):
        sinks.publish_batch(rows, folder, "key", "third")
    with pytest.raises(ValueError, match="2 times"):
        sinks.publish_batch(rows.union(rows), folder, "key", "fourth")


def test_tables_of_queries_keep_the_old_one(spark):
    files.create_table_as(spark, "kept_old", "select 1 as k")
    with pytest.raises(Exception):
        files.create_table_as(spark, "kept_old", "select raise_error('x') as k").collect()
    assert spark.table("kept_old").first().k == 1
    assert files.create_table_as(spark, "kept_old", "select k + 1 as k from kept_old").first().k == 2
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("kept_old")] == ["kept_old"]
    spark.sql("drop table kept_old")


def test_snapshots_on_any_store(spark, tmp_path):
    at = tmp_path / "one.parquet"
    spark.createDataFrame([(1,), (2,), (3,)], "id bigint").toPandas().to_parquet(at)
    path, ids = f"file://{at}", spark.createDataFrame([(1,), (2,), (3,)], "id int")
    found = files.verify_snapshot(spark, path, {"rows": 3}, "id", ids)
    assert found["distinct_ids"] == 3 and found["missing_ids"] == found["unknown_ids"] == found["repeated_ids"] == 0
    assert files.verify_snapshot(spark, path, {k: found[k] for k in ("bytes", "sha256", "rows")}) == {k: found[k] for k in ("bytes", "sha256", "rows")}
    with pytest.raises(files.SnapshotError, match="missing_ids: expected 0, found 1"):
        files.verify_snapshot(spark, path, {}, "id", spark.createDataFrame([(1,), (2,), (9,)], "id int"))
    with pytest.raises(files.SnapshotError):
        files.verify_snapshot(spark, f"file://{tmp_path}/none", {})
