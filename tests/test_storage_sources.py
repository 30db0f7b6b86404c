"""Sources, sinks, validation and components."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn import storage
from cairn.operators import validation as V
from cairn.operators.graph import connected_components
from cairn.sources import files, records, sinks


def test_csv_strings_and_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines, and ""quotes"""\n2,\n')
    rows = files.read_csv_strings(spark, str(tmp_path / "a.csv"), ["id", "note"])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", 'two\nlines, and "quotes"'), ("2", "")]
    nested = rows.select("id", F.array("note").alias("list"), F.struct("note").alias("s"))
    sinks.write_csv(nested, str(tmp_path / "out"))
    assert files.read_csv_strings(spark, str(tmp_path / "out"), ["id", "list", "s"]).where("id = 2").first().list == '[""]'
    assert sinks.flat(nested, as_json=False).columns == ["id"]


def test_jsonl_and_parquet(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception, match="line 2"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert files.read_json_lenient(spark, str(tmp_path / "a.jsonl"), "a int").cache().where("_corrupt is not null").count() == 1
    target = f"file://{tmp_path}/table"
    sinks.write_parquet_atomic(spark.range(3), target)
    sinks.write_parquet_atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(Exception):
        sinks.write_parquet_atomic(spark.range(1).select(F.raise_error(F.lit("x"))), target)
    assert spark.read.parquet(target).count() == 5 and not list(tmp_path.glob("*new-*"))
    sinks.write_parquet_atomic(spark.range(2).select("id", F.lit(1).alias("more")), f"{target}2")
    assert files.read_parquet_union(spark, target, f"{target}2").where("more is null").count() == 5
    sinks.write_dual(spark.range(0), f"file://{tmp_path}/dual")
    assert spark.read.parquet(f"file://{tmp_path}/dual/parquet").columns == ["id"]


def test_objects_manifests_and_snapshots(spark, tmp_path):
    sinks.publish_objects(spark.createDataFrame([("k1", 1), ("k2", None)], "key string, n int"), f"file://{tmp_path}/objects", "key").collect()
    assert json.loads((tmp_path / "objects/k2.json").read_text()) == {"key": "k2", "n": None}
    objects = files.read_objects(spark, f"file://{tmp_path}/objects", r"\.json$")
    asked = spark.createDataFrame([("k1.json",), ("k9.json",)], "object_key string")
    assert {r.object_key: r.file_exists for r in files.attach_objects(asked, objects).collect()} == {"k1.json": True, "k9.json": False}
    sinks.write_manifest(spark, f"file://{tmp_path}/m.json", {"b": 1, "a": 2})
    contract = files.verify_snapshot(spark, f"file://{tmp_path}/m.json", {})
    assert files.verify_snapshot(spark, f"file://{tmp_path}/m.json", contract) == contract
    with pytest.raises(files.SnapshotError):
        files.verify_snapshot(spark, f"file://{tmp_path}/m.json", {"sha256": "0"})


def record(url, html):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html
    return gzip.compress(b"WARC/1.0\r\nWARC-Target-URI: " + url.encode() + b"\r\nWARC-Record-ID: <r>\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n")


def test_record_source(spark, tmp_path):
    parts = [record(f"http://h/{i}", b"<p>%d</p>" % i) for i in range(3)]
    (tmp_path / "a.gz").write_bytes(b"".join(parts))
    specs, at = [], 0
    for i, p in enumerate(parts):
        specs.append({"path": f"file://{tmp_path}/a.gz", "offset": at, "length": len(p), "url": f"http://h/{i}"})
        at += len(p)
    assert sorted((r.url, bytes(r.html)) for r in records.read_records(spark, specs).collect()) == [(f"http://h/{i}", b"<p>%d</p>" % i) for i in range(3)]
    with pytest.raises(Exception, match="http://h/0"):
        records.read_records(spark, [specs[0] | {"url": "http://h/9"}]).collect()
    with pytest.raises(records.RecordError):
        records.validate_specs([specs[0], specs[0]])


def test_validation(spark):
    parent, child = spark.createDataFrame([(1, "a"), (1, ""), (2, None)], "k int, t string"), spark.createDataFrame([(1,), (7,)], "k int")
    found = V.report([V.counted("p", parent, ("empty", F.trim("t") == "")), V.duplicate_keys("p", parent, "k"), V.orphans("c", child, "k", parent, "k"), V.childless("p", parent, "k", child, "k")], {"none": parent.limit(0)})
    assert found.facts == {"p.empty": 1, "p.duplicate_key": 1, "c.orphan_k": 1, "p.without_k": 1, "none.rows": 0} and len(found.errors) == 5
    with pytest.raises(V.ValidationError):
        found.raise_if_failed()
    assert V.schema_errors(parent, StructType.fromDDL("k bigint, u string")) == ["missing column u", "column k is int, not bigint", "unknown column t"]
    assert V.ensure_columns(parent, {"t": F.lit("x"), "z": F.lit(1)}).columns == ["k", "t", "z"]
    got = {r.k: r.binding for r in V.bound_outputs(parent.select("k"), spark.createDataFrame([(1,), (1,), (9,)], "k int"), "k").collect()}
    assert got == {1: "duplicate", 2: "missing", 9: "unexpected"}


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jsonl_errors_tell_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    with pytest.raises(Exception, match=r"a\.jsonl line 4"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    (tmp_path / "b.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": null}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int, b string").collect()] == [(1, "x"), (None, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", optional=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").collect()
    (tmp_path / "c.json").write_text('[{"k": {"x": 1}},\n {"k": {"x": 2}}]')
    assert sorted(r.x for r in files.read_json_auto(spark, str(tmp_path / "c.json"), multiline=True).select("k.x").collect()) == [1, 2]


def test_tables_in_memory_and_of_queries(spark):
    import pyarrow as pa

    files.from_arrow(spark, pa.table({"k": [1, 2], "v": ["a", None]}), "in_memory")
    for _ in range(2):
        assert files.create_table_as(spark, "kept", "select k + 1 as k from in_memory where v is not null").first().k == 2
    spark.sql("drop table kept")


def test_jdbc_snapshot_is_replaced_whole(spark):
    url, properties = "jdbc:derby:memory:cairn;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, "b")], "ID int, NOTE string").write.jdbc(url, "SNAP", properties=properties)
    sinks.write_jdbc_snapshot(spark.createDataFrame([(i, f"n{i}") for i in range(5, 0, -1)], "ID int, NOTE string"), url, "SNAP", properties)
    rows = files.read_jdbc_snapshot(spark, url, "SNAP", properties, order=["ID"], ranges=("ID", 1, 5, 2)).collect()
    assert [tuple(r) for r in rows] == [(i, f"n{i}") for i in range(1, 6)]
    with pytest.raises(Exception):
        sinks.write_jdbc_snapshot(spark.createDataFrame([(9, "x", 1)], "ID int, NOTE string, MORE int"), url, "SNAP", properties)
    assert files.read_jdbc_snapshot(spark, url, "SNAP", properties).count() == 5
    with pytest.raises(ValueError):
        sinks.write_jdbc_snapshot(spark.range(1), url, "SNAP; drop", properties)


def test_sorted_keys_and_atomic_formats(spark, tmp_path):
    rows = spark.sql("select 1 as id, named_struct('b', 1, 'a', array(named_struct('z', 1, 'y', cast(null as int)))) as s, map('k2', 1, 'k1', 2) as m")
    flat = sinks.flat(rows).first()
    assert (flat.s, flat.m) == ('{"a":[{"y":null,"z":1}],"b":1}', '{"k1":2,"k2":1}')
    target = f"file://{tmp_path}/lines"
    sinks.write_jsonl_atomic(rows, target)
    with pytest.raises(Exception):
        sinks.write_jsonl_atomic(rows.select(F.raise_error(F.lit("x"))), target)
    assert spark.read.json(target).count() == 1
    both = f"file://{tmp_path}/both"
    sinks.write_dual(spark.range(4), both)
    with pytest.raises(Exception):
        sinks.write_dual(spark.range(2).select(F.raise_error(F.lit("x")).alias("id")), both)
    sinks.write_dual(spark.range(3), both)
    assert spark.read.parquet(f"{both}/parquet").count() == spark.read.json(f"{both}/jsonl").count() == 3
    sinks.write_ordered(spark.range(1000).orderBy(F.rand(1)), f"file://{tmp_path}/ordered", F.col("id").desc())
    assert [r.id for r in spark.read.parquet(f"file://{tmp_path}/ordered").collect()][:1] == [999]


def test_batches_replace_each_other(spark, tmp_path):
    folder = f"file://{tmp_path}/batches"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    assert sinks.publish_batch(rows, folder, "key", "first")["objects"] == 2
    assert sinks.publish_batch(rows.limit(1), folder, "key", "second")["batch"] == "second"
    assert json.loads((tmp_path / "batches/_summary.json").read_text())["objects"] == 1
    assert sorted(p.name for p in (tmp_path / "batches").iterdir() if p.is_dir()) == ["second"]


def test_record_tasks_and_identity(spark, tmp_path):
    specs = [{"path": f"file:///a{i % 2}", "offset": i * 10, "length": 10} for i in range(9)]
    tasks = records.packed(specs, most_bytes=30, most_records=2)
    assert sorted(s["offset"] for t in tasks for s in t) == [i * 10 for i in range(9)]
    assert all(len(t) <= 2 and len({s["path"] for s in t}) == 1 for t in tasks) and len(records.packed(specs)) == 2
    data = record("http://h/1", b"<p>1</p>")
    (tmp_path / "r.gz").write_bytes(data)
    spec = {"path": f"{tmp_path}/r.gz", "offset": 0, "length": len(data)}
    good = spec | {"record_id": "<r>", "digest": records.payload_digest(b"<p>1</p>")}
    assert records.read_records(spark, [good]).count() == 1
    for odd in ({"record_id": "<other>"}, {"digest": "sha1:other"}, {"sha256": "0"}):
        with pytest.raises(Exception, match="record at 0"):
            records.read_records(spark, [spec | odd]).collect()


def test_stores_by_scheme():
    from pyarrow import fs

    from cairn.storage import open_store

    assert open_store("dbfs:/tmp/x")[1] == "/dbfs/tmp/x" and open_store("/tmp/x")[1] == "/tmp/x" and open_store("file:///tmp/x")[1] == "/tmp/x"
    store, path = open_store("s3a://bucket/key?region=us-east-1")
    assert isinstance(store, fs.S3FileSystem) and path == "bucket/key"


def test_contracts(spark):
    parent = spark.createDataFrame([("p1",)], "pid string")
    rows = spark.createDataFrame([(1, "open", 5.0, "p1"), (1, "odd", 50.0, "p9"), (2, None, None, None)], "k int, state string, score double, pid string")
    rules = {"state": V.Rule(required=True, one_of=("open", "closed")), "score": V.Rule(between=(0, 10)), "pid": V.Rule(pattern=r"^p\d$", refers_to=(parent, "pid"))}
    found = V.mart_contract("mart", rows, rows.schema, rules, ("k",))
    assert found.facts == {"mart.state_missing": 1, "mart.state_unknown": 1, "mart.score_out_of_range": 1, "mart.pid_malformed": 0, "mart.orphan_pid": 1, "mart.duplicate_key": 1}
    assert V.mart_contract("mart", rows, StructType.fromDDL("k int"), rules).errors == ["mart: unknown column state", "mart: unknown column score", "mart: unknown column pid"]
    counts = V.row_counts({"raw": spark.range(5), "kept": spark.range(3), "gone": spark.range(1)})
    rule = ("raw = kept + gone", lambda n: n["raw"] == n["kept"] + n["gone"])
    assert V.invariants(counts, rule) == [f"raw = kept + gone: {counts}"] and V.invariants(counts | {"gone": 2}, rule) == []
    summary = spark.sql("select 18L as pairs, cast(0.9348 as decimal(10,4)) as ratio")
    assert V.expected_results(summary, {"pairs": 18, "ratio": 0.9348}) == [] and V.expected_results(summary, {"pairs": 17, "none": 1}) == ["pairs: expected 17, found 18", "none: expected 1, found None"]


def test_stored_tables_are_cleaned_and_clusters_need_a_shared_folder(spark, tmp_path, monkeypatch):
    from cairn import storage

    kept = storage.store(spark.range(3), "kept")
    assert kept.df.count() == 3 and f"cairn-{spark.sparkContext.applicationId}/kept-" in kept.path
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}")
    other = storage.store(spark.range(2), "other")
    storage.clean(spark)
    assert not list(tmp_path.iterdir()) and kept.df.count() == 3
    with pytest.raises(Exception):
        other.df.count()

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(lambda: {})

        conf = {}

    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Cluster)


def test_shuffles_of_a_stored_table_are_removed_and_settings_stay(spark, tmp_path):
    frame = spark.range(50_000).groupBy(F.xxhash64("id").alias("k")).count()
    before = spark.conf.get(storage.SHUFFLE_CLEANUP, None)
    made = storage.store(frame, "once")
    assert spark.conf.get(storage.SHUFFLE_CLEANUP, None) == before
    # The frame itself, and a join of the table with it, can be run again.
    assert made.df.join(frame, "k").count() == frame.count() == 50_000
    again = storage.store(frame.join(made.df.select("k"), "k"), "twice")
    assert again.df.count() == 50_000
    storage.write(made.df.select((F.col("k") % 2).alias("odd"), "count"), f"{tmp_path}/parts", "odd")
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 50_000
    with pytest.raises(Exception, match="(?i)exists"):
        storage.write(made.df, f"{tmp_path}/parts")
    assert spark.conf.get(storage.SHUFFLE_CLEANUP, None) == before
    made.remove(), again.remove()
