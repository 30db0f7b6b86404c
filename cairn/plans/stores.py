"""Scans and sinks: every query writes a given table in one form, reads it back and tells what it found."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import tables as X
from cairn.operators import prompts as M
from cairn.operators import validation as V
from cairn.session import table
from cairn.sources import files, records, sinks, versions
from cairn.storage import open_store, scratch


def csv_round_trip(spark, sf_dir):
    """Delimited text with quotes, line ends and nested columns, read back as strings."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", F.array(F.substring("html", 1, 40), F.lit('a "b"')).alias("parts"))
    at = scratch(spark, "csv")
    sinks.write_csv(rows, at)
    back = files.read_csv_strings(spark, at, rows.columns)
    return back.select("page_id", "url", F.from_json("parts", "array<string>")[0].alias("head"), F.from_json("parts", "array<string>")[1].alias("quoted"))


def csv_without_nested(spark, sf_dir):
    """Delimited text of the columns that are not nested."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", F.struct("n_regionkey").alias("gone"))
    at = scratch(spark, "csv")
    sinks.write_csv(rows, at, as_json=False)
    return files.read_csv_strings(spark, at, ["k", "n_name"])


def jsonl_round_trip(spark, sf_dir):
    """JSON lines, read back by a schema; nulls stay nulls."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))
    at = scratch(spark, "jsonl")
    sinks.write_jsonl_atomic(rows, at)
    return files.read_jsonl(spark, at, "event_id bigint, event_type string, value double")


def json_inferred(spark, sf_dir):
    """JSON lines, read back by an inferred schema."""
    at = scratch(spark, "json")
    sinks.write_jsonl_atomic(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), at)
    return files.read_json_auto(spark, at).groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.min("s_name").alias("first_name"))


def json_lenient(spark, sf_dir):
    """Lines that are no JSON are kept as such, beside those that are."""
    at = scratch(spark, "lines")
    lines = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 == 0, "{broken").otherwise(F.to_json(F.struct("c_custkey"))).alias("value"))
    lines.write.text(at)
    return files.read_json_lenient(spark, at, "c_custkey bigint").select("c_custkey", "_corrupt").groupBy((F.col("_corrupt").isNotNull()).alias("broken")).agg(F.count("*").alias("lines"), F.sum("c_custkey").alias("keys"))


def dual_round_trip(spark, sf_dir):
    """One table as Parquet and as JSON lines: which keys either lacks, and how many both have."""
    at = scratch(spark, "dual")
    sinks.write_dual(table(spark, sf_dir, "part").select("p_partkey", "p_name"), at)
    a, b = spark.read.parquet(f"{at}/parquet"), files.read_jsonl(spark, f"{at}/jsonl", "p_partkey bigint, p_name string")
    return a.join(b, ["p_partkey", "p_name"], "full").agg(F.count("*").alias("parts"), F.count_if(F.col("p_name").isNull()).alias("odd"))


def parquet_union(spark, sf_dir):
    """Files of one table with different columns, united by name."""
    at = scratch(spark, "union")
    events = table(spark, sf_dir, "events")
    sinks.write_parquet_atomic(events.where("event_id % 2 = 0").select("event_id", "event_type"), f"{at}/a")
    sinks.write_parquet_atomic(events.where("event_id % 2 = 1").select("event_id", "event_type", "user_id"), f"{at}/b")
    rows = files.read_parquet_union(spark, f"{at}/a", f"{at}/b")
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("user_id").alias("with_user"))


def ordered_table(spark, sf_dir):
    """A table written in an order: how many of its files begin before the one before them ends."""
    at = scratch(spark, "ordered")
    sinks.write_ordered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), at, F.desc("o_totalprice"), "o_orderkey")
    rows = spark.read.parquet(at).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("first"), F.min("o_totalprice").alias("last"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("file"), "first", "last", "n")))  # a row a file
    whole = rows.agg(listed.alias("f"))
    wrong = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size("f"), F.lit(2))), lambda i: F.coalesce(F.try_element_at("f", i)["first"] > F.try_element_at("f", i - 1)["last"], F.lit(False))))
    return whole.select(wrong.cast("bigint").alias("out_of_order"), F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("orders"))


def table_versions(spark, sf_dir):
    """Two versions of a table, each checked by what was observed while it was written; readers see the second."""
    at, orders = scratch(spark, "versions"), table(spark, sf_dir, "orders")
    checks = versions.Checks({"keys": F.count("o_orderkey"), "open": F.count_if(F.col("o_orderstatus") == "O")}, {"every row has a key": lambda m: m["rows"] == m["keys"]}, {"some are open": lambda m: m["open"] > 0})
    versions.write_version(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), at, checks)
    versions.write_version(orders.select("o_orderkey", "o_orderstatus"), at, checks)
    return versions.read_version(spark, at).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


def observed_counts(spark, sf_dir):
    """What was observed of each version as it was written, as its pointer tells."""
    at, items = scratch(spark, "observed"), table(spark, sf_dir, "lineitem")
    checks = versions.Checks({"largest": F.max("l_quantity").cast("double"), "returned": F.count_if(F.col("l_returnflag") == "R")})
    found = versions.write_version(items, at, checks)["metrics"]
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(found.items())], "metric string, value double")


def keyed_objects(spark, sf_dir):
    """A batch of objects, published by commit, and read back with their keys and hashes."""
    at = scratch(spark, "objects")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("key"), "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("nation"))
    batch = sinks.publish_batch(rows, at, "key", "first")["batch"]
    found = files.read_objects(spark, f"{at}/{batch}", r"\.json$", r"([^/]+)\.json$")
    return found.select("object_key", "length", "sha256", F.get_json_object(F.decode("content", "utf-8"), "$.s_name").alias("s_name"))


def objects_of_manifest(spark, sf_dir):
    """Objects joined to the rows of a manifest that ask for them; those that are not there stay."""
    at = scratch(spark, "objects")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("object_key"), "n_name", "n_regionkey")
    batch = sinks.publish_batch(nations.where("n_regionkey <> 2"), at, "object_key", "first")["batch"]
    objects = files.read_objects(spark, f"{at}/{batch}", r"/n-\d+\.json$", r"([^/]+)\.json$")
    return files.attach_objects(nations, objects).groupBy("n_regionkey", "file_exists").agg(F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def table_of_query(spark, sf_dir):
    """A table of the catalog from a query over one that it then replaces."""
    name = f"cairn_kept_{M._name(table).rsplit('-', 2)[-2]}"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.saveAsTable(name)
    rows = files.create_table_as(spark, name, f"select n_regionkey, count(*) as nations, sum(n_nationkey) as keys from {name} group by all")
    stored = [tuple(r) for r in rows.collect()]  # a row a region
    spark.sql(f"drop table {name}")
    return spark.createDataFrame(stored, rows.schema)


def path_scan(spark, sf_dir):
    """SQL over paths and frames: neither needs a view of a name."""
    at = sf_dir.rstrip("/")
    return spark.sql(f"select r_name, count(*) as nations from parquet.`{at}/nation.parquet` join {{regions}} on n_regionkey = r_regionkey where n_nationkey >= :least group by all", args={"least": 5}, regions=table(spark, sf_dir, "region"))


def _archives(spark, sf_dir: str) -> DataFrame:
    """Every page as a captured record in archives of 64 pages; a manifest row a record."""
    at = scratch(spark, "archives")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")

    def run(batches):
        import gzip
        import uuid

        import pyarrow as pa

        store, root = open_store(at)
        store.create_dir(root, recursive=True)
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch, path, data, rows = whole.slice(first, 64), f"{uuid.uuid4().hex}.warc.gz", bytearray(), []
                for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (html or "").encode()
                    head = f"WARC/1.0\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <{len(rows)}>\r\nContent-Length: {len(http)}\r\n\r\n"
                    record = gzip.compress(head.encode() + http + b"\r\n\r\n", mtime=0)
                    rows.append((f"{at}/{path}", len(data), len(record), url))
                    data += record
                with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(bytes(data))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "offset", "length", "url"])

    made = scratch(spark, "places")
    pages.mapInArrow(run, "path string, offset bigint, length bigint, url string").write.parquet(made)
    return spark.read.parquet(made)


def captured_records(spark, sf_dir):
    """Records read by the byte ranges of a manifest, their identity checked: what was captured of each page."""
    rows = records.read_records(spark, _archives(spark, sf_dir))
    return rows.select("url", "content_type", F.sha2("html", 256).alias("html_sha256"), F.octet_length("html").cast("bigint").alias("n_bytes"))


def captured_of_urls(spark, sf_dir):
    """A filter on url, pushed into the manifest: only records that pass are fetched."""
    rows = records.read_records(spark, _archives(spark, sf_dir)).where("startswith(url, 'https')")
    return rows.select("url", F.octet_length("html").cast("bigint").alias("n_bytes"))


def html_blocks_by_sql(spark, sf_dir):
    """The blocks of all pages by a table function; how many each page has, and their length."""
    X.register(spark)
    return spark.sql("select page_id, count(*) as blocks, sum(char_length(block)) as n_chars, max(block_index) as last from html_page_blocks(table(select page_id, html from {pages})) group by all", pages=table(spark, sf_dir, "pages", spread=True))


def form_spans_by_sql(spark, sf_dir):
    """Form spans of every order by a table function."""
    X.register(spark)
    text = F.when(F.col("o_orderkey") % 8 == 0, "").otherwise(F.col("o_orderpriority"))
    form = F.to_json(F.struct(F.array(F.struct(F.lit("answer").alias("label"), text.alias("text"), F.array(F.lit(1), F.lit(1), (F.col("o_orderkey") % 5).cast("int"), F.lit(3)).alias("box"))).alias("form")))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_orderkey").alias("claim_id"), F.concat(F.lit("d"), "o_orderkey").alias("file_id"), form.alias("annotation_json"))
    return spark.sql("select field_name, field_value, valid_bbox, needs_review, count(*) as spans from claim_form_spans(table(select claim_id, file_id, annotation_json from {orders})) group by all", orders=orders)


def leading_events(spark, sf_dir):
    """The first three events of each user by a table function over partitions, which leaves the rest of a group unread."""
    X.register(spark)
    asked = "select cast(user_id as string) as user, lpad(event_id, 20, '0') as at, cast(event_id as string) as event from {events}"
    return spark.sql(f"select part as user_id, place, value as event_id from leading_rows(table({asked}) partition by user order by (at), 3)", events=table(spark, sf_dir, "events"))


def published_suite(spark, sf_dir):
    """A suite over three published tables: what it counted, and whether that is an error, a warning or neither."""
    read = lambda n: table(spark, sf_dir, n)
    orders, items, customers = read("orders"), read("lineitem"), read("customer")
    tables = {
        "orders": V.Published(orders, orders.schema, ("o_orderkey",), {"o_orderstatus": V.Rule(required=True, one_of=("F", "O", "P")), "o_totalprice": V.Rule(between=(0, 400_000))}, warn={"low": F.col("o_totalprice") < 2000}),
        "customer": V.Published(customers, customers.schema, ("c_custkey",), {"c_mktsegment": V.Rule(pattern="^[A-Z]+$")}),
        "lineitem": V.Published(items, items.schema, (), {"l_quantity": V.Rule(required=True, between=(1, 49))}),
    }
    found = V.suite(tables, (("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey")), ("an order has lines", lambda n: n["lineitem"] >= n["orders"]))
    kind = lambda check: "warning" if ".warn_" in check else "fact" if check.endswith(".rows") else "rule"
    return spark.createDataFrame([(c, n, kind(c)) for c, n in sorted(found.facts.items())], "rule string, n bigint, kind string")


def run_manifest(spark, sf_dir):
    """Facts of a run, written as a manifest and read back."""
    at, counts = scratch(spark, "manifest"), {n: table(spark, sf_dir, n).count() for n in ("region", "nation", "supplier")}
    sinks.write_manifest(spark, f"{at}/m.json", counts)
    store, root = open_store(f"{at}/m.json")
    with store.open_input_stream(root) as file:
        found = json.loads(file.read())
    return spark.createDataFrame(sorted(found.items()), "name string, n_rows bigint")


QUERIES = {
    f.__name__: f for f in (
        csv_round_trip, csv_without_nested, jsonl_round_trip, json_inferred, json_lenient, dual_round_trip, parquet_union, ordered_table, table_versions, observed_counts, keyed_objects,
        objects_of_manifest, table_of_query, path_scan, captured_records, captured_of_urls, html_blocks_by_sql, form_spans_by_sql, leading_events, published_suite, run_manifest,
    )
}
ORACLES = {
    "csv_round_trip": "select page_id::varchar as page_id, url, substr(html, 1, 40) as head, 'a \"b\"' as quoted from pages",
    "csv_without_nested": "select n_nationkey::varchar as k, n_name from nation",
    "jsonl_round_trip": "select event_id, event_type, case when event_id % 5 > 0 then value end as value from events",
    "json_inferred": "select s_nationkey, count(*) as suppliers, min(s_name) as first_name from supplier group by 1",
    "json_lenient": "select c_custkey % 4 = 0 as broken, count(*) as lines, sum(case when c_custkey % 4 > 0 then c_custkey end)::bigint as keys from customer group by 1",
    "dual_round_trip": "select count(*) as parts, 0::bigint as odd from part",
    "parquet_union": "select event_type, count(*) as events, count(*) filter (event_id % 2 = 1 and user_id is not null) as with_user from events group by 1",
    "ordered_table": "select 0::bigint as out_of_order, count(*)::bigint as orders from orders",
    "table_versions": "select o_orderstatus, count(*) as orders, sum(o_orderkey)::bigint as keys from orders group by 1",
    "observed_counts": "select 'rows' as metric, count(*)::double as value from lineitem union all select 'largest', max(l_quantity)::double from lineitem union all select 'returned', count(*) filter (l_returnflag = 'R')::double from lineitem",
    "keyed_objects": """with o as (select 's-' || s_suppkey as object_key, s_name, '{"key":"s-' || s_suppkey || '","nation":' || case when s_suppkey % 3 > 0 then s_nationkey::varchar else 'null' end || ',"s_name":"' || s_name || '"}' as body from supplier)
select object_key, strlen(body) as length, sha256(body) as sha256, s_name from o""",
    "objects_of_manifest": """select n_regionkey, n_regionkey <> 2 as file_exists, count(*) as objects, sum(case when n_regionkey <> 2 then strlen('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"object_key":"n-' || n_nationkey || '"}') else 0 end)::bigint as bytes from nation group by 1, 2""",
    "table_of_query": "select n_regionkey, count(*) as nations, sum(n_nationkey)::bigint as keys from nation group by 1",
    "path_scan": "select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey where n_nationkey >= 5 group by 1",
    "captured_records": "select url, 'text/html' as content_type, sha256(html) as html_sha256, strlen(html)::bigint as n_bytes from pages",
    "captured_of_urls": "select url, strlen(html)::bigint as n_bytes from pages where url like 'https%'",
    "form_spans_by_sql": "select 'answer_0' as field_name, case when o_orderkey % 8 = 0 then '' else o_orderpriority end as field_value, o_orderkey % 5 > 1 as valid_bbox, o_orderkey % 8 = 0 or o_orderkey % 5 <= 1 as needs_review, count(*) as spans from orders group by all",
    "leading_events": "select user_id::varchar as user_id, place, event_id::varchar as event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as place from events) where place <= 3",
    "published_suite": """select 'orders.rows' as rule, count(*) as n, 'fact' as kind from orders union all select 'customer.rows', count(*), 'fact' from customer union all select 'lineitem.rows', count(*), 'fact' from lineitem
union all select 'orders.warn_low', count(*) filter (o_totalprice < 2000), 'warning' from orders union all select 'orders.o_orderstatus_missing', count(*) filter (coalesce(trim(o_orderstatus), '') = ''), 'rule' from orders
union all select 'orders.o_orderstatus_unknown', count(*) filter (o_orderstatus not in ('F', 'O', 'P')), 'rule' from orders union all select 'orders.o_totalprice_out_of_range', count(*) filter (o_totalprice not between 0 and 400000), 'rule' from orders
union all select 'orders.duplicate_key', count(*), 'rule' from (select 1 from orders group by o_orderkey having count(*) > 1) union all select 'customer.duplicate_key', count(*), 'rule' from (select 1 from customer group by c_custkey having count(*) > 1)
union all select 'customer.c_mktsegment_malformed', count(*) filter (not regexp_full_match(c_mktsegment, '[A-Z]+')), 'rule' from customer union all select 'lineitem.l_quantity_missing', count(*) filter (l_quantity is null), 'rule' from lineitem
union all select 'lineitem.l_quantity_out_of_range', count(*) filter (l_quantity not between 1 and 49), 'rule' from lineitem
union all select 'orders.customer', count(*), 'rule' from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer) union all select 'lineitem.order', count(*), 'rule' from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from orders)""",
    "run_manifest": "select 'region' as name, count(*) as n_rows from region union all select 'nation', count(*) from nation union all select 'supplier', count(*) from supplier",
}
