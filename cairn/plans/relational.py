"""Relational operators over the star schema: joins of each kind, aggregates, windows, JSON, sampling, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import word_tokens
from cairn.operators import validation as V
from cairn.session import table
from cairn.storage import broadcast_if_small, store


def order_revenue(spark, sf_dir):
    """Inner joins and a partial aggregate: revenue by market segment and nation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    rows = items.join(orders, "l_orderkey").join(customers, "c_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rows.groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("r"), 0).alias("revenue"), F.count("*").alias("lines"))


def customers_without_orders(spark, sf_dir):
    """Anti-join."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def customers_with_urgent_orders(spark, sf_dir):
    """Semi-join."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def customer_orders_left(spark, sf_dir):
    """Left join on a pre-aggregated side."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))
    return table(spark, sf_dir, "customer").join(totals, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round("largest", 2).alias("largest"))


def same_supplier_pairs(spark, sf_dir):
    """Self-join with an inequality: the pairs are what is asked for, of a table of suppliers that does not grow with the
    orders; nothing else of this library lists the pairs of a group."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.withColumnRenamed("s_suppkey", "left_id").join(s.withColumnRenamed("s_suppkey", "right_id"), "s_nationkey").where("left_id < right_id")


def alias_join(spark, sf_dir):
    """Name-or-alias join as an equi-join on exploded labels."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array_distinct(F.array("n_name", F.lower("n_name")))).alias("label"))
    asked = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("label"), F.col("n_regionkey").alias("asked_by"))
    return asked.join(n, "label")


def filtered_aggregates(spark, sf_dir):
    """Aggregates with filters, and the value at the extreme of another column, nulls left out."""
    return spark.sql("""select event_type, count(*) as events, count(*) filter (where value > 50) as large, count(distinct user_id) as users, round(avg(value) filter (where value > 50), 6) as mean_large,
        max_by(event_id, struct(value, event_id)) filter (where value is not null) as top_event, bool_or(value > 99) as any_top, bool_and(value >= 0) as all_positive from {events} group by all having count(*) > 0""", events=table(spark, sf_dir, "events"))


def ordered_lists(spark, sf_dir):
    """Ordered and distinct string aggregates."""
    return spark.sql("select n_regionkey, listagg(n_name, ', ') within group (order by n_name desc) as names, listagg(distinct substring(n_name, 1, 1), '') within group (order by substring(n_name, 1, 1)) as initials from {nation} group by all", nation=table(spark, sf_dir, "nation"))


def latest_per_user(spark, sf_dir):
    """The first row of each user in an order with ties broken by id, and the user's count: partial aggregation, so a
    user with a third of all rows is neither sorted nor held by one task."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    order = F.struct(F.col("value").isNull(), -F.col("value"), "event_id")
    first = events.groupBy("user_id").agg(F.count("*").alias("events"), F.min_by(F.struct("event_id", "event_type"), order).alias("x"))
    return first.select("user_id", "x.event_id", "x.event_type", "events")


def ranked_orders(spark, sf_dir):
    """Windows over a customer's orders: place by price, running total by date, share of the customer's total."""
    of = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = rows.withColumn("place", F.row_number().over(of.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))
    rows = rows.withColumn("so_far", F.count("*").over(of.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("orders", F.count("*").over(of)).where("place <= 3").select("o_custkey", "o_orderkey", "place", "so_far", "orders")


def event_props(spark, sf_dir):
    """JSON paths and casts."""
    e = table(spark, sf_dir, "events")
    keys = F.array_sort(F.json_object_keys("props"))
    return e.groupBy(F.array_join(keys, ",").alias("keys"), "event_type").agg(F.count("*").alias("events"))


def json_lists(spark, sf_dir):
    """Lengths of JSON lists by path, and a field of all their members."""
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, '{"items":[]}').otherwise(F.concat(F.lit('{"items":[{"id":'), k, F.lit('},{"id":'), k, F.lit("}]}")))
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", text.alias("j"))
    ids = F.coalesce(F.from_json(F.get_json_object("j", "$.items[*].id"), "array<bigint>"), F.array().cast("array<bigint>"))
    rows = rows.select("o_orderstatus", F.json_array_length(F.get_json_object("j", "$.items")).alias("n"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda total, x: total + x).alias("ids"))
    return rows.groupBy("o_orderstatus", "n").agg(F.count("*").alias("orders"), F.sum("ids").cast("bigint").alias("ids"))


def filtered_lists(spark, sf_dir):
    """Lists in an order of another column, of the rows that pass a filter, null members kept."""
    named = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name"))
    listed = F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 4 > 0, named)))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(listed, lambda x: x["name"]).alias("names"))
    return rows.select("n_regionkey", F.to_json("names").alias("names"))


def priority_cases(spark, sf_dir):
    """A ladder of cases, with a lateral alias and a union of branches."""
    return spark.sql("""select bucket, branch, count(*) as orders from (
        select case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end as tier, concat(tier, '-', o_orderstatus) as bucket, 'all' as branch from {orders}
        union all select 'x' as tier, concat('urgent-', o_orderstatus) as bucket, 'urgent' as branch from {orders} where o_orderpriority in ('1-URGENT', '2-HIGH')) group by all""", orders=table(spark, sf_dir, "orders"))


def sample_by_hash(spark, sf_dir):
    """A deterministic sample: the 25 smallest digests."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest")).orderBy("digest", "c_custkey").limit(25)


def token_statistics(spark, sf_dir):
    """Tokens by language, by JVM functions alone."""
    return table(spark, sf_dir, "documents", spread=True).select("lang", F.size(word_tokens(F.col("text"))).alias("n")).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").cast("bigint").alias("tokens"), F.max("n").cast("bigint").alias("longest"))


def date_differences(spark, sf_dir):
    """Dates read tolerantly, their difference, and days by status."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderstatus", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("d"))
    return rows.groupBy("o_orderstatus").agg(F.count_if(F.col("d") > 30).alias("late"), F.min("d").alias("least"), F.max("d").alias("most"))


def benchmark_overlap(spark, sf_dir):
    """Documents that hold a run of eight words of a benchmark item: an equi-join of distinct grams, no pairs within either side."""
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 7, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 8), " ")))
    side = lambda name, key: table(spark, sf_dir, name, spread=name == "documents").select(key, word_tokens(F.col("text")).alias("w")).where(F.size("w") >= 8).select(key, F.explode_outer(gram(F.col("w"))).alias("g"))
    hashed = lambda rows: rows.withColumn("h", F.xxhash64("g"))
    items = store(hashed(side("benchmark", "item_id")), "benchmark-grams").df
    keys = items.select("item_id", "h")
    # A row of the hash table is two longs and its overhead, below 48 bytes; texts of grams are compared on hits alone.
    hits = hashed(side("documents", "doc_id")).join(broadcast_if_small(keys, 48 * items.count()), "h")
    return hits.join(items, ["item_id", "h", "g"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_grams"))


def output_binding(spark, sf_dir):
    """Outputs bound to requests by identity, whatever their order. Ids choose which rows stand for requests and which for
    outputs, so that each kind of binding occurs; both tables are read whole."""
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey")
    given = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.bound_outputs(asked, given, "o_orderkey").groupBy("binding").agg(F.count("*").alias("keys"), F.sum("outputs").alias("outputs"))


def _checks(spark, sf_dir: str) -> list[DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "documents", "labels")}
    return [
        V.counted("orders", t["orders"], ("empty_status", F.trim("o_orderstatus") == ""), ("negative_price", F.col("o_totalprice") < 0), ("odd_priority", ~F.col("o_orderpriority").rlike("^[1-5]-"))),
        V.counted("lineitem", t["lineitem"], ("discount_range", ~F.col("l_discount").between(0, 0.05)), ("no_shipdate", F.col("l_shipdate").isNull())),
        V.duplicate_keys("orders", t["orders"], "o_orderkey"), V.orphans("lineitem", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), V.childless("customer", t["customer"], "c_custkey", t["orders"], "o_custkey"),
        V.orphans("labels", t["labels"], "doc_id", t["documents"], "doc_id"),
    ]


def validation_counts(spark, sf_dir):
    return reduce(DataFrame.unionByName, _checks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (order_revenue, customers_without_orders, customers_with_urgent_orders, customer_orders_left, same_supplier_pairs, alias_join, filtered_aggregates, ordered_lists, latest_per_user, ranked_orders, event_props, json_lists, filtered_lists, priority_cases, sample_by_hash, token_statistics, date_differences, benchmark_overlap, output_binding, validation_counts)}
_GRAM = "select distinct {k}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from (select {k}, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from {t}) where len(w) >= 8"
ORACLES = {
    "order_revenue": "select c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all",
    "customers_without_orders": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "customers_with_urgent_orders": "select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
    "customer_orders_left": "select c_custkey, count(o_orderkey) as orders, round(max(o_totalprice), 2) as largest from customer left join orders on o_custkey = c_custkey group by 1",
    "same_supplier_pairs": "select a.s_nationkey, a.s_suppkey as left_id, b.s_suppkey as right_id from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey",
    "alias_join": "with a as (select case when n_nationkey % 2 = 0 then n_name else lower(n_name) end as label, n_regionkey as asked_by from nation) select a.label, asked_by, n_nationkey from a join nation n on a.label = n_name or a.label = lower(n_name)",
    "filtered_aggregates": "select event_type, count(*) as events, count(*) filter (value > 50) as large, count(distinct user_id) as users, round(avg(value) filter (value > 50), 6) as mean_large, arg_max(event_id, (value, event_id)) filter (value is not null) as top_event, bool_or(value > 99) as any_top, bool_and(value >= 0) as all_positive from events group by 1",
    "ordered_lists": "select n_regionkey, string_agg(n_name, ', ' order by n_name desc) as names, string_agg(distinct n_name[1], '' order by n_name[1]) as initials from nation group by 1",
    "latest_per_user": "select user_id, event_id, event_type, n as events from (select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by value desc nulls last, event_id) as rn from events) where rn = 1",
    "ranked_orders": "select o_custkey, o_orderkey, place, so_far, orders from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as so_far, count(*) over (partition by o_custkey) as orders from orders) where place <= 3",
    "json_lists": """with j as (select o_orderstatus, case when o_orderkey % 3 = 0 then '{"items":[]}' else '{"items":[{"id":' || o_orderkey || '},{"id":' || o_orderkey || '}]}' end as j from orders)
select o_orderstatus, json_array_length(j, '$.items')::int as n, count(*) as orders, coalesce(sum(list_sum(json_extract(j, '$.items[*].id')::bigint[])), 0)::bigint as ids from j group by all""",
    "filtered_lists": "select n_regionkey, to_json(list(case when n_nationkey % 3 > 0 then n_name end order by n_nationkey) filter (n_nationkey % 4 > 0))::varchar as names from nation group by 1",
    "event_props": "select array_to_string(list_sort(json_keys(props)), ',') as keys, event_type, count(*) as events from events group by all",
    "priority_cases": """select bucket, branch, count(*) as orders from (select case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end || '-' || o_orderstatus as bucket, 'all' as branch from orders
union all select 'urgent-' || o_orderstatus, 'urgent' from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) group by all""",
    "sample_by_hash": "select c_custkey, sha256(c_custkey::varchar) as digest from customer order by digest, c_custkey limit 25",
    "token_statistics": "select lang, count(*) as documents, sum(n)::bigint as tokens, max(n) as longest from (select lang, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as n from documents) group by 1",
    "date_differences": "select o_orderstatus, count(*) filter (d > 30) as late, min(d) as least, max(d) as most from (select o_orderstatus, date_diff('day', o_orderdate::date, l_shipdate::date) as d from orders join lineitem on o_orderkey = l_orderkey) group by 1",
    "benchmark_overlap": f"with d as ({_GRAM.format(k='doc_id', t='documents')}), b as ({_GRAM.format(k='item_id', t='benchmark')}) select doc_id, item_id, count(*) as shared_grams from d join b using (g) group by all",
    "output_binding": """with a as (select o_orderkey as k from orders where o_orderkey % 3 <> 0), g as (select l_orderkey as k, count(*) as n from lineitem where l_linenumber <= 2 group by 1),
j as (select a.k as ak, coalesce(n, 0) as n from a full join g on a.k = g.k) select case when ak is null then 'unexpected' when n = 0 then 'missing' when n > 1 then 'duplicate' else 'bound' end as binding, count(*) as keys, sum(n)::bigint as outputs from j group by 1""",
    "validation_counts": """select 'orders.empty_status' as "check", count(*) filter (trim(o_orderstatus) = '') as violations from orders union all select 'orders.negative_price', count(*) filter (o_totalprice < 0) from orders union all select 'orders.odd_priority', count(*) filter (not regexp_matches(o_orderpriority, '^[1-5]-')) from orders
union all select 'lineitem.discount_range', count(*) filter (not l_discount between 0 and 0.05) from lineitem union all select 'lineitem.no_shipdate', count(*) filter (l_shipdate is null) from lineitem union all select 'orders.duplicate_key', count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)
union all select 'lineitem.orphan_l_orderkey', count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey) union all select 'customer.without_o_custkey', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)
union all select 'labels.orphan_doc_id', count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)""",
}
