"""Queries over the star schema, one or more for each operator, with the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Field
from larkspur.functions import collections as C
from larkspur.functions import numbers as N
from larkspur.functions import strings as S
from larkspur.functions.typed import typed
from larkspur.lineage import cut, removed, shared_folder
from larkspur.operators import change
from larkspur.operators.graph import ALL, Graph, Result, schema_graph
from larkspur.operators.predicates import all_of, any_of, none_of, variant, where
from larkspur.operators.record_graph import record_graph
from larkspur.operators.select import INDEX, Agg, collect, exact_product, follow, select
from larkspur.sources import dump, tables
from larkspur.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def named(df: DataFrame, **names: str) -> DataFrame:
    """Output labels such as ``sum(x)`` under plain names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 2) for n in names})


# selection


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 2) AS price
    FROM lineitem WHERE l_quantity > 10 GROUP BY ALL"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", Agg("count"), Agg("sum", "l_quantity"), Agg("average", "l_extendedprice")], where("l_quantity", ">", 10), ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"])
    return rounded(named(got, l_returnflag="l_returnflag", l_linestatus="l_linestatus", n="count(*)", quantity="sum(l_quantity)", price="average(l_extendedprice)"), "quantity", "price")


@query("SELECT CAST(n_nationkey AS BIGINT) AS _index, * FROM nation ORDER BY n_name, n_nationkey LIMIT 5 OFFSET 5")
def scan_star_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "nation"), "*", sort_by=["n_name"], offset=5, limit=5)


@query("SELECT p_name, p_size, CAST(NULL AS VARCHAR) AS p_colour FROM part")
def project_unknown_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "part"), ["p_name", "p_size", "p_colour"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = all_of(where("o_totalprice", ">=", 400000), any_of(where("o_orderstatus", "=", "F"), where("o_orderpriority", "=", "1-URGENT")))
    return select(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], test)


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END > 100000, false)")
def filter_not_of_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return select(orders, ["o_orderkey"], none_of(where("known", ">", 100000)))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return select(orders, ["o_orderkey"], where("known", "=", None))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <> 5")
def filter_not_equal_skips_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return select(orders, ["o_orderkey"], where("known", "!=", 5))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def filter_starts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "part"), ["p_partkey", "p_name"], where("p_name", "starts with", "red"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) [a-m]')")
def filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "part"), ["p_partkey", "p_name"], where("p_name", "matches", "^(red|blue) [a-m]"))


@query("SELECT p_partkey FROM part WHERE length(p_name) > 10 AND ends_with(p_name, 't')")
def filter_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = all_of(where(S.length(F.col("p_name")), ">", 10), where(S.ends_with(F.col("p_name"), "t")))
    return select(table(spark, sf_dir, "part"), ["p_partkey"], test)


@query("SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND 1 = 1")
def filter_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "part"), ["p_partkey"], all_of(where("p_name", "!=", 5), none_of(where("p_name", "<", 5), where("p_name", "=", 5))))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def filter_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "events"), ["event_id", "value"], where("event_type", "=", "click"))


@query("SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_name NULLS FIRST, c_custkey LIMIT 10")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], sort_by=["c_acctbal", "c_name"], limit=10)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS buyer FROM orders ORDER BY buyer NULLS FIRST, o_orderkey LIMIT 50")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("buyer", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")))
    return select(orders, ["o_orderkey", "buyer"], sort_by=["buyer"], limit=50)


# aggregation


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def aggregate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "orders"), [Agg("count"), *(Agg(a, "o_totalprice") for a in ("sum", "average", "min", "max"))])
    return rounded(named(got, n="count(*)", total="sum(o_totalprice)", mean="average(o_totalprice)", low="min(o_totalprice)", high="max(o_totalprice)"), "total", "mean")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def aggregate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "orders"), ["o_orderpriority", Agg("count"), Agg("sum", "o_totalprice")], group_by=["o_orderpriority"])
    return rounded(named(got, o_orderpriority="o_orderpriority", n="count(*)", total="sum(o_totalprice)"), "total")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, arg_min(o_totalprice, o_orderkey) AS o_totalprice, count(*) AS n FROM orders GROUP BY o_custkey")
def aggregate_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_totalprice", Agg("count")], group_by=["o_custkey"])
    return got.withColumnRenamed("count(*)", "n")


@query(
    """SELECT o_custkey, o_totalprice, n FROM (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY o_custkey)
    ORDER BY o_totalprice, f LIMIT 20 OFFSET 10"""
)
def aggregate_groups_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice", Agg("count")], group_by=["o_custkey"], sort_by=["o_totalprice"], offset=10, limit=20)
    return got.withColumnRenamed("count(*)", "n")


@query("SELECT n_regionkey, CAST(product(n_nationkey + 1) AS DOUBLE) AS product FROM nation GROUP BY n_regionkey")
def aggregate_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") + 1)
    return named(select(nation, ["n_regionkey", Agg("product", "k")], group_by=["n_regionkey"]), n_regionkey="n_regionkey", product="product(k)")


@query("SELECT n_regionkey, CAST(CAST(product(n_nationkey + 1) AS BIGINT) AS VARCHAR) AS product FROM nation GROUP BY n_regionkey")
def aggregate_exact_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_product(table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") + 1), "k", ["n_regionkey"])


@query("SELECT count(*) AS n FROM orders")
def aggregate_count_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return named(select(orders, [Agg("count", "known")]), n="count(known)")


@query("SELECT round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)")
def aggregate_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select(table(spark, sf_dir, "orders"), [Agg("sum", "o_totalprice"), "o_orderkey"], limit=100)
    return rounded(named(got, total="sum(o_totalprice)", o_orderkey="o_orderkey"), "total")


@query("SELECT CAST(NULL AS DOUBLE) AS low, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM part")
def aggregate_text_and_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("is_large", F.col("p_size") > 25)
    return named(select(part, [Agg("min", "p_name"), Agg("sum", "is_large")]), low="min(p_name)", large="sum(is_large)")


# references and views


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def reference_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = follow(table(spark, sf_dir, "orders"), [("o_custkey", table(spark, sf_dir, "customer"), INDEX)], "c_name", "c_name")
    return got.select("o_orderkey", "c_name")


@query(
    """SELECT o_orderkey, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def reference_three_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = [("o_custkey", table(spark, sf_dir, "customer"), INDEX), ("c_nationkey", table(spark, sf_dir, "nation"), INDEX), ("n_regionkey", table(spark, sf_dir, "region"), INDEX)]
    return follow(table(spark, sf_dir, "orders"), path, "r_name", "r_name").select("o_orderkey", "r_name")


@query("SELECT o_orderkey, CASE WHEN c_nationkey <> 3 THEN c_name END AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def reference_to_deleted_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = change.delete(table(spark, sf_dir, "customer"), where("c_nationkey", "=", 3))
    return follow(table(spark, sf_dir, "orders"), [("o_custkey", left, INDEX)], "c_name", "c_name").select("o_orderkey", "c_name")


_PARTY = {"name": {"customer": "c_name", "supplier": "s_name"}, "nation": {"customer": "c_nationkey", "supplier": "s_nationkey"}, "balance": {"customer": "c_acctbal", "supplier": "s_acctbal"}}


def _party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.interface_view({t: table(spark, sf_dir, t) for t in ("customer", "supplier")}, _PARTY)


@query(
    """SELECT 'customer' AS _type, c_custkey AS _index, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000"""
)
def interface_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_party(spark, sf_dir), "*", where("balance", ">", 9000))


@query("SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation")
def interface_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_party(spark, sf_dir), ["nation", Agg("count")], group_by=["nation"]).withColumnRenamed("count(*)", "n")


@query(
    """SELECT 'customer' AS _source, c_custkey AS _index, 'c_acctbal' AS _field, c_acctbal AS _value FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, 's_acctbal', s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, 'p_retailprice', p_retailprice FROM part"""
)
def type_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"customer": "c_acctbal", "supplier": "s_acctbal", "part": "p_retailprice"}
    return tables.type_scan({t: table(spark, sf_dir, t) for t in names}, list(names.items()))


@query("SELECT 'events' AS _source, event_id AS _index, 'event_type' AS _field, event_type AS _variant, event_type AS value FROM events")
def enum_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.enum_overview({"events": table(spark, sf_dir, "events")}, [("events", "event_type")])


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.struct(F.col("user_id").alias("user"), F.col("value").alias("amount")))
    return table(spark, sf_dir, "events").select(INDEX, F.struct(F.col("event_type").alias("_variant"), paid.alias("purchase")).alias("action"))


@query("SELECT 'events' AS _source, event_id AS _index, 'action' AS _field, user_id AS user, value AS amount FROM events WHERE event_type = 'purchase' AND value > 10")
def enum_variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(tables.variant_scan("events", _shaped(spark, sf_dir), "action", "purchase"), "*", where("amount", ">", 10))


@query(
    """SELECT 'events' AS _source, event_id AS _index, 'action' AS _field, event_type AS _variant,
    CASE WHEN event_type = 'purchase' THEN 'purchase(user=' || user_id || ')' ELSE event_type END AS value FROM events"""
)
def enum_payload_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.struct(F.col("user_id").alias("user")))
    shaped = table(spark, sf_dir, "events").select(INDEX, F.struct(F.col("event_type").alias("_variant"), paid.alias("purchase")).alias("action"))
    return tables.enum_overview({"events": shaped}, [("events", "action")])


@query("SELECT event_id AS _index, 'k' AS key, CAST(json_extract(props, '$.k') AS INTEGER) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def entry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.entry_scan(table(spark, sf_dir, "events").withColumn("d", F.from_json("props", "map<string,int>")), "d")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 3, 11, 7)")
def rows_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([(0, 5), (1, 3), (2, 10**12), (3, 11), (4, 7)], "pos int, id long")
    return tables.rows_by_index(table(spark, sf_dir, "orders"), places).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 OR o_orderpriority = '1-URGENT'")
def collect_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return collect(orders.where("o_totalprice > 450000"), orders.where("o_orderpriority = '1-URGENT'")).select("o_orderkey", "o_totalprice")


# strings


@query(
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, upper(p_name[1]) || lower(p_name[2:]) AS cap, CAST(length(p_name) AS INTEGER) AS n,
    contains(p_name, 'ring') AS has, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'bolt') AS ends, reverse(p_name) AS back FROM part"""
)
def string_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.uppercase(name).alias("up"), S.lowercase(F.col("p_brand")).alias("low"), S.capitalize(name).alias("cap"), S.length(name).alias("n"), S.contains(name, "ring").alias("has"), S.starts_with(name, "red").alias("starts"), S.ends_with(name, "bolt").alias("ends"), S.reverse(name).alias("back"))


@query(
    """SELECT p_partkey, CAST(strpos(p_name, 'e') - 1 AS INTEGER) AS first, CAST(CASE WHEN strpos(p_name, 'e') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'e') END AS INTEGER) AS last,
    CASE WHEN length(p_name) < 12 THEN lpad(p_name, 12, '*') ELSE p_name END AS padded, CASE WHEN length(p_name) < 12 THEN rpad(p_name, 12, '.') ELSE p_name END AS filled, repeat(p_brand, 2) AS twice FROM part"""
)
def string_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.index_of(name, "e").alias("first"), S.last_index_of(name, "e").alias("last"), S.pad_start(name, 12, "*").alias("padded"), S.pad_end(name, 12, ".").alias("filled"), S.repeat(F.col("p_brand"), 2).alias("twice"))


@query(
    """SELECT p_partkey, p_name[1] AS first, p_name[-1] AS last, p_name[1:3] AS head, p_name[-4:] AS tail, regexp_replace(p_name, 'e', 'E') AS once, replace(p_name, 'e', 'E') AS every,
    string_split(p_brand, '#')[2] AS part, CASE WHEN regexp_matches(p_brand, '#([0-9])([0-9])') THEN regexp_extract(p_brand, '#([0-9])([0-9])', 2) END AS digit, trim(chr(9) || p_name || '  ', chr(9) || ' ') AS bare FROM part"""
)
def string_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.at(name, 0).alias("first"), S.at(name, -1).alias("last"), S.cut(name, 0, 3).alias("head"), S.cut(name, -4).alias("tail"), S.replace_first(name, "e", "E").alias("once"), S.replace_all(name, "e", "E").alias("every"),
        C.at(S.split(brand, "#"), 1).alias("part"), C.at(S.match(brand, "#([0-9])([0-9])"), 2).alias("digit"), S.trim(F.concat(F.lit("\t"), name, F.lit("  "))).alias("bare"),
    )


# arrays, sets and dictionaries


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of four numbers for each part, with a null in every third."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(k % 7, F.when(k % 3 > 0, k % 5), k % 11, k % 5).alias("a"))


_A = "SELECT p_partkey, [p_partkey % 7, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END, p_partkey % 11, p_partkey % 5] AS a FROM part"


def _text(c):
    return F.coalesce(F.array_join(F.transform(c, lambda e: e.cast("string")), ",", "null"), F.lit("none"))


def _sql_text(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ',')"


@query(
    f"""SELECT p_partkey, CAST(len(a) AS INTEGER) AS n, list_min(a) AS low, list_max(a) AS high, a[1] AS first, a[-1] AS last, a[9] AS beyond, {_sql_text("a[2:3]")} AS middle,
    list_contains(a, 4) AS has, {_sql_text("list_sort(a, 'ASC', 'NULLS LAST')")} AS up, {_sql_text("list_sort(a, 'DESC', 'NULLS FIRST')")} AS down, {_sql_text("list_reverse(a)")} AS back FROM ({_A})"""
)
def array_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return _sizes(spark, sf_dir).select("p_partkey", C.length(a).alias("n"), C.smallest(a).alias("low"), C.largest(a).alias("high"), C.at(a, 0).alias("first"), C.at(a, -1).alias("last"), C.at(a, 8).alias("beyond"), _text(C.cut(a, 1, 3)).alias("middle"), C.contains(a, 4).alias("has"), _text(C.sort(a)).alias("up"), _text(C.sort(a, (None, True))).alias("down"), _text(C.reverse(a)).alias("back"))


@query(
    f"""SELECT p_partkey, {_sql_text("list_concat(a, [8, 9])")} AS appended, {_sql_text("list_concat([8], a)")} AS prepended, {_sql_text("list_concat(list_concat(a[1:2], [8]), a[3:])")} AS inserted,
    {_sql_text("list_concat(a[1:1], a[3:])")} AS deleted, {_sql_text("[a[4], a[2], a[3], a[1]]")} AS swapped,
    {_sql_text("list_filter(a, lambda x: x IS NULL OR x <> 4)")} AS without, {_sql_text("list_transform(a, lambda x: CASE WHEN x = 4 THEN 0 ELSE x END)")} AS replaced,
    CASE WHEN list_position(a, 4) > 0 THEN {_sql_text("list_concat(a[1:list_position(a, 4) - 1], a[list_position(a, 4) + 1:])")} ELSE {_sql_text("a")} END AS removed FROM ({_A})"""
)
def array_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return _sizes(spark, sf_dir).select("p_partkey", _text(C.append(a, 8, 9)).alias("appended"), _text(C.prepend(a, 8)).alias("prepended"), _text(C.insert(a, 2, 8)).alias("inserted"), _text(C.delete(a, 1)).alias("deleted"), _text(C.swap(a, 0, 3)).alias("swapped"), _text(C.remove_all(a, 4)).alias("without"), _text(C.replace_all(a, 4, 0)).alias("replaced"), _text(C.remove(a, 4)).alias("removed"))


@query("SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 4) AS low, round(CAST(list_max(embedding) AS DOUBLE), 4) AS high, round(CAST(embedding[-1] AS DOUBLE), 4) AS last FROM embeddings")
def array_of_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.smallest(a), 4).alias("low"), F.round(C.largest(a), 4).alias("high"), F.round(C.at(a, -1), 4).alias("last"))


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best, round(CAST(min(l_extendedprice) AS DOUBLE), 2) AS low FROM lineitem GROUP BY l_orderkey")
def array_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, seven at most, as an array of rows: sorted by two keys, and the least by one."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice")).alias("a"))
    a = F.col("a")
    return per.select("l_orderkey", C.at(C.sort(a, ("l_extendedprice", True), ("l_linenumber", False)), 0)["l_linenumber"].alias("best"), F.round(C.smallest(a, "l_extendedprice"), 2).alias("low"))


@query(
    """SELECT p_partkey, array_to_string(list_concat(s, list_filter(t, lambda x: NOT list_contains(s, x))), '') AS either, array_to_string(list_filter(s, lambda x: list_contains(t, x)), '') AS both,
    array_to_string(list_filter(s, lambda x: NOT list_contains(t, x)), '') AS only,
    array_to_string(list_concat(list_filter(s, lambda x: NOT list_contains(t, x)), list_filter(t, lambda x: NOT list_contains(s, x))), '') AS one,
    array_to_string(CASE WHEN list_contains(s, '#') THEN s ELSE list_append(s, '#') END, '') AS added, list_contains(s, 'r') AS has
    FROM (SELECT p_partkey, CASE WHEN len(u) = 0 THEN u ELSE list_filter(u, lambda x, i: list_position(u, x) = i) END AS s, list_filter(v, lambda x, i: list_position(v, x) = i) AS t
    FROM (SELECT p_partkey, string_split(replace(p_name, ' ', ''), '') AS u, string_split(lower(p_type), '') AS v FROM part))"""
)
def set_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and their order: those of the first set, then the new ones of the second."""
    s, t = F.array_distinct(F.split(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), "")), F.array_distinct(F.split(F.lower("p_type"), ""))
    text = lambda x: F.array_join(x, "")
    return table(spark, sf_dir, "part").select("p_partkey", text(C.set_union(s, t)).alias("either"), text(C.set_intersect(s, t)).alias("both"), text(C.set_difference(s, t)).alias("only"), text(C.set_symmetric_difference(s, t)).alias("one"), text(C.set_add(s, "#")).alias("added"), C.contains(s, "r").alias("has"))


def _joined(a: Column) -> Column:
    return F.coalesce(F.array_join(a.cast("array<string>"), ","), F.lit(""))


@query(
    """SELECT event_id, k IS NOT NULL AS has, k AS value, CASE WHEN k IS NULL THEN '' ELSE 'k' END AS names, coalesce(CAST(k AS VARCHAR), '') AS inside, coalesce('k' || k, '') AS pairs, CAST(0 AS INTEGER) AS left_over
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
)
def dict_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.from_json("props", "map<string,int>")
    return table(spark, sf_dir, "events").select("event_id", C.has_key(d, "k").alias("has"), C.lookup(d, "k").alias("value"), _joined(C.keys(d)).alias("names"), _joined(C.values(d)).alias("inside"), _joined(F.transform(C.entries(d), lambda e: F.concat(e["key"], e["value"].cast("string")))).alias("pairs"), F.size(C.keys(C.drop_key(d, "k"))).alias("left_over"))


# numbers


@query(
    """SELECT p_partkey, CAST(floor((p_partkey - 500) / 7.0) AS BIGINT) AS quotient, CAST(p_partkey - 500 - 7 * floor((p_partkey - 500) / 7.0) AS BIGINT) AS remainder,
    CAST((p_partkey - 500) + 7 * floor((p_partkey - 500) / -7.0) AS BIGINT) AS negative, p_size / 4 AS ratio FROM part"""
)
def math_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") - 500
    return table(spark, sf_dir, "part").select("p_partkey", N.floor_div(k, F.lit(7)).alias("quotient"), N.floor_mod(k, F.lit(7)).alias("remainder"), N.floor_mod(k, F.lit(-7)).alias("negative"), N.true_div(F.col("p_size"), F.lit(4)).alias("ratio"))


@query(
    """SELECT p_partkey, CAST(greatest(least(p_size * 5 - 100, 127), -128) AS BIGINT) AS held, CAST(((p_size * 5 - 100 + 128) % 256 + 256) % 256 - 128 AS BIGINT) AS turned,
    CAST(least(p_size * 9, 255) AS BIGINT) AS unsigned FROM part"""
)
def math_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size") * 5
    return table(spark, sf_dir, "part").select("p_partkey", N.subtract(x, F.lit(100), 8, "saturating").alias("held"), N.subtract(x, F.lit(100), 8, "wrapping").alias("turned"), N.multiply(F.col("p_size"), F.lit(9), 8, "saturating", False).alias("unsigned"))


@query(
    """SELECT p_partkey, round(sqrt(p_size), 6) AS root, round(ln(p_size), 6) AS log, round_even(p_size / 2.0, 0) AS rounded, CAST(len(range(0, p_size, 3)) AS INTEGER) AS steps, round(pow(p_size, 2), 6) AS power FROM part"""
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.square_root(x), 6).alias("root"), F.round(N.logarithm(x), 6).alias("log"), N.round_half_even(x / 2).alias("rounded"), F.size(N.number_range(F.col("p_size"))).alias("_n"), F.size(N.number_range(0, F.col("p_size"), 3)).alias("steps"), F.round(F.pow(x, 2), 6).alias("power")).drop("_n")


@query("SELECT p_partkey, CAST(CAST(p_partkey AS HUGEINT) * 1000000000000 * 1000000000000 + 1 AS VARCHAR) AS big FROM part")
def math_big_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = N.big_add(N.big_multiply(F.col("p_partkey").cast("string"), F.lit(str(10**24))), F.lit("1"))
    return table(spark, sf_dir, "part").select("p_partkey", big.alias("big"))


@query("SELECT p_partkey, CAST((6 * p_size + 4) // gcd(6 * p_size + 4, 24) AS VARCHAR) AS num, CAST(24 // gcd(6 * p_size + 4, 24) AS VARCHAR) AS den FROM part")
def math_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = N.fraction_add(N.fraction(F.col("p_size"), F.lit(4)), N.fraction(F.lit(1), F.lit(6)))
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("f")).select("p_partkey", "f.num", "f.den")


@query(
    f"""SELECT p_partkey, CAST(coalesce(a[1], 0) + coalesce(a[2], 0) + coalesce(a[3], 0) + coalesce(a[4], 0) AS VARCHAR) AS total, round(list_avg(a), 6) AS mean,
    CAST(coalesce(a[1], 1) * coalesce(a[2], 1) * coalesce(a[3], 1) * coalesce(a[4], 1) AS VARCHAR) AS product FROM ({_A})"""
)
def math_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return _sizes(spark, sf_dir).select("p_partkey", N.list_sum(a).cast("string").alias("total"), F.round(N.list_average(a), 6).alias("mean"), N.list_product(a).cast("string").alias("product"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour, CAST(p_size % 3 + 5 AS INTEGER) AS level, p_size > 25 AS large FROM part")
def math_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = {"red": 5, "green": 6, "blue": 7}
    name = N.enum_name((F.col("p_size") % 3 + 5).cast("int"), colours)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("colour"), N.enum_value(name, colours).alias("level"), N.boolean(F.greatest(F.col("p_size") - 25, F.lit(0))).alias("large"))


@query("SELECT 5 AS a, 2 AS b, CAST(-4 AS BIGINT) AS c, 'x5' AS d")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(5).alias("a"), F.size(N.number_range(0, 10, 5)).alias("b"), N.floor_div(F.lit(-7), F.lit(2)).alias("c"), F.concat(F.lit("x"), F.lit(5).cast("string")).alias("d"))


# changes


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.update(table(spark, sf_dir, "customer"), {"c_acctbal": F.col("c_acctbal") * 2}, where("c_mktsegment", "=", "MACHINERY")).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.delete(table(spark, sf_dir, "customer"), any_of(where("c_acctbal", "<", 0), where("c_mktsegment", "=", "MACHINERY"))).select("c_custkey")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _index, c_custkey FROM customer WHERE c_acctbal >= 0")
def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = change.delete(table(spark, sf_dir, "customer"), where("c_acctbal", "<", 0))
    return change.compact(left)[0].select(INDEX, "c_custkey")


@query(
    """SELECT o_orderkey, n.k AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_acctbal >= 0) n ON o_custkey = n.c_custkey"""
)
def compact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = change.compact(change.delete(table(spark, sf_dir, "customer"), where("c_acctbal", "<", 0)))[1]
    return change.remap(table(spark, sf_dir, "orders"), "o_custkey", ids).select("o_orderkey", "o_custkey")


@query("SELECT CAST(r_regionkey AS BIGINT) AS _index, r_name FROM region UNION ALL SELECT * FROM (VALUES (CAST(5 AS BIGINT), 'OCEANIA'), (CAST(6 AS BIGINT), 'ARCTIC')) t(a, b)")
def create_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = spark.createDataFrame([("OCEANIA",), ("ARCTIC",)], "r_name string")
    return change.create(table(spark, sf_dir, "region"), fresh).select(INDEX, "r_name")


# text forms


@query("""SELECT '{"$id":"nation_' || n_nationkey || '","n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def dump_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_json(table(spark, sf_dir, "nation"), "nation")


@query("""SELECT '- &nation_' || n_nationkey || chr(10) || '  n_nationkey: ' || n_nationkey || chr(10) || '  n_name: "' || n_name || '"' || chr(10) || '  n_regionkey: ' || n_regionkey AS value FROM nation""")
def dump_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_yaml(table(spark, sf_dir, "nation"), "nation")


@query("""SELECT '<nation id="nation_' || n_nationkey || '"><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></nation>' AS value FROM nation""")
def dump_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_xml(table(spark, sf_dir, "nation"), "nation")


@query("""SELECT '$_nation_' || n_nationkey || ' = create nation(n_nationkey=' || n_nationkey || ', n_name="' || n_name || '", n_regionkey=' || n_regionkey || ')' AS value FROM nation""")
def dump_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_script(table(spark, sf_dir, "nation"), "nation")


# graphs


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations and customers, and the chains customer - nation - region."""
    ident = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = region.select(ident("r", "r_regionkey").alias("id"), F.lit("regions").alias("selector"), F.col("r_name").alias("name"))
    nodes = nodes.union(nation.select(ident("n", "n_nationkey"), F.lit("nations"), "n_name")).union(customer.select(ident("c", "c_custkey"), F.lit("customers"), "c_name"))
    edges = nation.select(F.lit("region").alias("axis"), ident("n", "n_nationkey").alias("source"), ident("r", "n_regionkey").alias("target"))
    edges = edges.union(customer.select(F.lit("nation"), ident("c", "c_custkey"), ident("n", "c_nationkey")))
    edges = edges.union(nation.where("n_nationkey > 0").select(F.lit("next"), ident("n", "n_nationkey"), F.concat(F.lit("n"), F.expr("n_nationkey DIV 2").cast("string"))))
    return Graph(nodes, edges, {"places": ["regions", "nations"], "up": ["nation", "region"]}, {"members": "nation"})


@query("SELECT 'n' || n_nationkey AS source, 'region' AS label, 'r' || n_regionkey AS target FROM nation")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.add(g.select("nations"), "region").table()


@query("SELECT 'n' || c_nationkey AS source, 'members' AS label, 'c' || c_custkey AS target FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'n3', '', '' WHERE (SELECT count(*) FROM customer WHERE c_nationkey = 3) = 0")
def graph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.add(g.select("nations", ["NATION_3"]), "members").table()


@query(
    """WITH RECURSIVE walk AS (SELECT 24 AS s, 12 AS t UNION SELECT t, t // 2 FROM walk WHERE t > 0)
    SELECT 'n' || s AS source, 'next' AS label, 'n' || t AS target FROM walk"""
)
def graph_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.add(g.select("nations", ["NATION_24"]), "next", ALL).table()


@query("SELECT 'n24' AS source, 'next' AS label, 'n12' AS target UNION ALL SELECT 'n12', 'next', 'n6'")
def graph_depth_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.add(g.select("nations", ["NATION_24"]), "next", 2).table()


@query("SELECT DISTINCT 'r' || n_regionkey AS source, '' AS label, '' AS target FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500")
def graph_pipe_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    start = g.select("customers")
    start.nodes = start.nodes.join(rich, "id", "left_semi")
    return g.pipe(g.pipe(start, "nation"), "region").table()


@query("SELECT 'n' || n_nationkey AS source, '' AS label, '' AS target FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')")
def graph_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return (g.select("places") & g.select("nations", ["NATION_1", "NATION_2"])).table()


@query(
    """SELECT 'n' || n_nationkey AS source, CASE WHEN n_regionkey = 1 THEN '' ELSE 'region' END AS label, CASE WHEN n_regionkey = 1 THEN '' ELSE 'r' || n_regionkey END AS target FROM nation
    UNION ALL SELECT 'r' || r_regionkey, '', '' FROM region WHERE r_regionkey <> 1 AND r_regionkey NOT IN (SELECT n_regionkey FROM nation)"""
)
def graph_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return (g.add(g.select("nations"), "region") - g.select("regions", ["AMERICA"])).table()


@query("SELECT 'r' || r_regionkey AS source, '' AS label, '' AS target FROM region WHERE r_name NOT IN ('ASIA') UNION ALL SELECT 'n' || n_nationkey, '', '' FROM nation")
def graph_union_and_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return (g.select("regions", ["ASIA"], but=True) | g.select("nations")).table()


@query("SELECT DISTINCT 'n' || c_nationkey AS source, 'region' AS label, 'r' || n_regionkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    start = g.select("customers")
    start.nodes = start.nodes.join(rich, "id", "left_semi")
    got = g.chain(start, ["nation", "region"])
    return got.edges.select("source", "label", "target")


@query("SELECT 'n' || n_nationkey AS source, r_name AS label, 'r' || n_regionkey AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.label(g.step(g.select("nations"), "region"), g.nodes.select("id", F.col("name").alias("label"))).edges.select("source", "label", "target")


@query("SELECT DISTINCT 'c' || c_custkey AS source, 'nation' AS label, 'r' || n_regionkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.project(g.step(g.select("customers"), "nation"), "region").edges.select("source", "label", "target")


@query(
    """WITH RECURSIVE walk AS (SELECT 24 AS s, 12 AS m, 6 AS t UNION SELECT t, t // 2, t // 4 FROM walk WHERE t // 2 > 0)
    SELECT 'n' || m AS source, 'next' AS label, 'n' || t AS target FROM walk"""
)
def graph_repeated_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of an axis at a time, until nothing is new."""
    g = graph(spark, sf_dir)
    return g.repeat(g.select("nations", ["NATION_24"]), ["next", "next"]).edges.select("source", "label", "target")


@query("SELECT value FROM (SELECT 'digraph {' AS value UNION ALL SELECT '}' UNION ALL SELECT '\"n' || n_nationkey || '\" -> \"r' || n_regionkey || '\" [label=\"region\"];' FROM nation)")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.add(g.select("nations"), "region").dot()


# numbers beyond integers, records with defaults, and graphs from records


@query(
    """SELECT p_partkey, p_retailprice + p_size AS total, round(p_retailprice * p_size, 4) AS product, CAST(floor(p_retailprice / 0.5) AS BIGINT) AS halves, CAST(floor(-p_retailprice / 7) AS BIGINT) AS sevenths FROM part"""
)
def math_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and products of lists of floats, and floor division by them."""
    price = F.col("p_retailprice").cast("double")
    pair = F.array(price, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", N.list_sum(pair).alias("total"), F.round(N.list_product(pair), 4).alias("product"), N.floor_div(price, F.lit(0.5)).alias("halves"), N.floor_div(-price, F.lit(7)).alias("sevenths"))


@query(
    """SELECT p_partkey, CAST(least(CAST(18446744073709551615 AS HUGEINT), CAST(p_partkey AS HUGEINT) * 12297829382473034411) AS VARCHAR) AS held,
    CAST((CAST(p_partkey AS HUGEINT) * 12297829382473034411) % 18446744073709551616 AS VARCHAR) AS turned, CAST(CAST(p_size AS HUGEINT) * 300000000000000000 AS VARCHAR) AS whole FROM part"""
)
def math_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of unsigned 64-bit numbers under each policy."""
    big = F.lit("12297829382473034411").cast("decimal(20,0)")
    product = lambda a, b, policy: N.multiply(a, b, 64, policy, False).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", product(F.col("p_partkey"), big, "saturating").alias("held"), product(big, F.col("p_partkey"), "wrapping").alias("turned"), product(F.col("p_size"), F.lit(300000000000000000), "error").alias("whole"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(CASE WHEN p_size > 25 THEN 1 WHEN p_size < 25 THEN -1 ELSE 0 END AS INTEGER) END AS side,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST((3 * p_size + 2) // gcd(3 * p_size + 2, 6) AS VARCHAR) || '/' || CAST(6 // gcd(3 * p_size + 2, 6) AS VARCHAR) END AS f FROM part"""
)
def math_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big numbers and fractions of which some are null."""
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    total = N.fraction_add(N.fraction(size, F.lit(2)), N.fraction(F.lit(1), F.lit(3)))
    rows = table(spark, sf_dir, "part").select("p_partkey", N.big_compare(size.cast("string"), F.lit("25")).alias("side"), total.alias("f"))
    return rows.select("p_partkey", "side", F.concat("f.num", F.lit("/"), "f.den").alias("f"))


@query("SELECT p_partkey, [p_size + 1, p_size + 10] AS plus, [p_size * 1, p_size * 10] AS times, [1 - p_size, 10 - p_size] AS minus, -p_size AS negative, [p_size, p_size, p_size] AS thrice FROM part")
def math_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with a value, lists with lists, and a value repeated."""
    size, pair = F.col("p_size"), F.array(F.lit(1), F.lit(10))
    each = lambda a, b, op, x, y: N.elementwise(a, b, op, x, y)
    return table(spark, sf_dir, "part").select("p_partkey", each(pair, size, lambda a, b: a + b, True, False).alias("plus"), each(F.array_repeat(size, 2), pair, lambda a, b: a * b, True, True).alias("times"), each(pair, size, lambda a, b: a - b, True, False).alias("minus"), (-size).alias("negative"), F.array_repeat(size, 3).alias("thrice"))


@query("SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS small, CAST(p_retailprice AS DOUBLE) AS wide, CAST(p_size AS VARCHAR) AS text, p_size > 0 AS yes, CAST(p_size % 2 = 0 AS INTEGER) AS bit FROM part")
def math_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values brought into declared types."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.convert(size * 2.0, 8, False).alias("small"), F.col("p_retailprice").cast("double").alias("wide"), size.cast("string").alias("text"), N.boolean(size).alias("yes"), (size % 2 == 0).cast("int").alias("bit"))


def shop(spark: SparkSession, sf_dir: str) -> tuple[Catalog, dict[str, DataFrame]]:
    """The star schema's people and places as typed records: references, arrays and dictionaries of copies, and a variant."""
    c = Catalog()
    c.alias("Money", "float64")
    c.composite("Place", [Field("name", "string"), Field("visits", "uint8", 7, "saturating"), Field("rank", "int8", None, "wrapping"), Field("tags", "string[]", ["new"])])
    c.forward("Land")
    c.composite("Region", [Field("name", "string"), Field("lands", "Land[]"), Field("by_name", "{string: Land}")])
    c.composite("Land", [Field("name", "string"), Field("region", "Region")])
    c.enum("Home", {"none": None, "at": [Field("land", "Land"), Field("since", "int32")]})
    c.composite("Person", [Field("name", "string"), Field("home", "Home"), Field("balance", "Money")])
    c.composite("Order", [Field("name", "string"), Field("total", "Money"), Field("person", "Person")])
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    land = nation.select(INDEX, F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    # 25 nations are all there are at any size
    inside = land.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("name", "region"))).alias("lands"))
    regions = region.join(inside, region[INDEX] == inside["region"], "left").select(INDEX, F.col("r_name").alias("name"), "lands", F.map_from_arrays(F.col("lands.name"), F.col("lands")).alias("by_name"))
    home = F.when(F.col("c_acctbal") < 0, F.struct(F.lit("none").alias("_variant"), F.lit(None).cast("struct<land:bigint,since:int>").alias("at"))).otherwise(F.struct(F.lit("at").alias("_variant"), F.struct(F.col("c_nationkey").cast("long").alias("land"), F.lit(1).alias("since")).alias("at")))
    person = customer.select(INDEX, F.col("c_name").alias("name"), home.alias("home"), F.col("c_acctbal").cast("double").alias("balance"))
    order = orders.select(INDEX, F.col("o_orderpriority").alias("name"), F.col("o_totalprice").cast("double").alias("total"), F.col("o_custkey").cast("long").alias("person"))
    return c, {"Region": regions, "Land": land, "Person": person, "Order": order}


def shop_graph(spark: SparkSession, sf_dir: str, axes: dict[str, list[str]], *selectors: str) -> Graph:
    kinds = {"regions": "Region", "lands": "Land", "people": "Person", "orders": "Order"}
    return record_graph(*shop(spark, sf_dir), {s: kinds[s] for s in selectors}, axes)


@query("SELECT n_name AS source, 'region' AS label, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_from_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = shop_graph(spark, sf_dir, {"region": ["lands.region"]}, "lands", "regions")
    return g.step(g.select("lands"), "region").edges.select("source", "label", "target")


@query("SELECT r_name AS source, 'lands' AS label, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of an array, which are copies known by their names."""
    g = shop_graph(spark, sf_dir, {"lands": ["regions.lands"]}, "regions", "lands")
    return g.step(g.select("regions"), "lands").edges.select("source", "label", "target")


@query("SELECT r_name AS source, 'named' AS label, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'back', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def graph_from_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a dictionary, and what their own fields refer to."""
    g = shop_graph(spark, sf_dir, {"named": ["regions.by_name.value"], "back": ["regions.by_name.value.region"]}, "regions", "lands")
    return g.either(g.select("regions"), ["named", "back"]).edges.select("source", "label", "target")


@query("SELECT c_name AS source, 'home' AS label, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 UNION ALL SELECT c_name, 'region', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0")
def graph_from_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of the variant that is there, and one path past it."""
    g = shop_graph(spark, sf_dir, {"home": ["people.home"], "region": ["people.home.at.land.region"]}, "people", "lands", "regions")
    return g.either(g.select("people"), ["home", "region"]).edges.select("source", "label", "target")


@query("SELECT DISTINCT n_name || '.' || segment AS source, n_name AS label, segment AS target FROM (SELECT n_name, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def graph_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose names occur more than once are known by the node that leads to them."""
    c = Catalog()
    c.composite("Segment", [Field("name", "string")])
    c.composite("Land", [Field("name", "string"), Field("segments", "Segment[]")])
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    inside = customer.groupBy(F.col("c_nationkey").alias("_n")).agg(F.collect_set(F.struct(F.col("c_mktsegment").alias("name"))).alias("segments"))
    lands = nation.join(inside, F.col("n_nationkey") == F.col("_n"), "left").select(INDEX, F.col("n_name").alias("name"), "segments")
    segments = customer.select(INDEX, F.col("c_mktsegment").alias("name"))
    g = record_graph(c, {"Land": lands, "Segment": segments}, {"lands": "Land", "segments": "Segment"}, {"of": ["lands.segments"]})
    return g.step(g.select("lands"), "of").edges.join(g.nodes, F.col("target") == F.col("id")).select(F.col("target").alias("source"), F.col("source").alias("label"), F.col("name").alias("target"))


@query("SELECT c_name AS source, r_name || '/' || n_name AS label, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0")
def graph_joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made of what two paths lead to from an edge's target."""
    g = shop_graph(spark, sf_dir, {"home": ["people.home"], "region": ["lands.region"]}, "people", "lands", "regions")
    return g.label_by(g.step(g.select("people"), "home"), [["region"], ["name"]], "/").edges.select("source", "label", "target")


def ring(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, each leading to the next of ten, round and round; the rest lead to themselves."""
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    onto = F.when(k < 10, (k + 1) % 10).otherwise(k)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = nation.select(name(k).alias("id"), F.lit("nations").alias("selector"), F.col("n_name").alias("name"))
    return Graph(nodes, nation.select(F.lit("next").alias("axis"), name(k).alias("source"), name(onto).alias("target")), {"ways": ["next", "before"], "both": ["ways"]}, {"before": "next"})


@query("SELECT 'edge' AS what, 'n' || n_nationkey AS a, 'n' || ((n_nationkey + 1) % 10) AS b FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'node', 'n' || n_nationkey, '' FROM nation WHERE n_nationkey BETWEEN 1 AND 9")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle to its end: the round that comes back gives its edge, and no node."""
    g = ring(spark, sf_dir)
    return _parts(g.step(g.select("nations", ["NATION_0"]), "next", ALL))


@query("SELECT 'edge' AS what, 'n' || n_nationkey AS a, 'n' || n_nationkey AS b FROM nation WHERE n_nationkey >= 10")
def graph_self_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step that finds nothing new: edges, and no nodes."""
    g = ring(spark, sf_dir)
    start = g.select("nations")
    start.nodes = start.nodes.where("CAST(substr(id, 2) AS INT) >= 10")
    return _parts(g.step(start, "next"))


@query("SELECT 'edge' AS what, 'n0' AS a, 'n1' AS b UNION ALL SELECT 'edge', 'n0', 'n9' UNION ALL SELECT 'edge', 'n1', 'n2' UNION ALL SELECT 'edge', 'n1', 'n0' UNION ALL SELECT 'edge', 'n9', 'n0' UNION ALL SELECT 'edge', 'n9', 'n8' UNION ALL SELECT 'node', x, '' FROM (VALUES ('n0'), ('n1'), ('n2'), ('n8'), ('n9')) t(x)")
def graph_axis_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps along a group of a forward and a reversed axis, by way of another group."""
    g = ring(spark, sf_dir)
    return _parts(g.step(g.select("nations", ["NATION_0"]), "both", 2))


def _parts(found: Result) -> DataFrame:
    edges = found.edges.select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    return edges.union(found.nodes.select(F.lit("node"), "id", F.lit("")))


@query(
    """SELECT CAST(r_regionkey AS BIGINT) AS _index, r_name AS name, CAST(r_regionkey AS INTEGER) AS visits, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS tags FROM region
    UNION ALL SELECT 5, 'OCEANIA', 255, 44, 'new' UNION ALL SELECT 6, 'ARCTIC', 0, -128, 'new'"""
)
def create_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields left out take their defaults; values beyond a field follow its policy; rows stay in order."""
    catalog = shop(spark, sf_dir)[0]
    old = table(spark, sf_dir, "region").select(INDEX, F.col("r_name").alias("name"), F.col("r_regionkey").cast("smallint").alias("visits"), F.lit(None).cast("tinyint").alias("rank"), F.lit(None).cast("array<string>").alias("tags"))
    rows = spark.createDataFrame([("OCEANIA", 300, 300), ("ARCTIC", -4, 128)], "name string, visits int, rank int")
    return change.create(old, rows, catalog, "Place").withColumns({"visits": F.col("visits").cast("int"), "rank": F.col("rank").cast("int"), "tags": F.array_join("tags", ",")})


@query("SELECT CAST(r_regionkey AS BIGINT) AS _index, r_name AS name, CAST(least(r_regionkey * 100, 255) AS INTEGER) AS visits FROM region UNION ALL SELECT 5, 'OCEANIA', 7")
def update_with_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default where nothing is given, then an update held by a field's policy."""
    catalog = shop(spark, sf_dir)[0]
    old = table(spark, sf_dir, "region").select(INDEX, F.col("r_name").alias("name"), F.col("r_regionkey").cast("smallint").alias("visits"))
    more = change.create(old, spark.createDataFrame([("OCEANIA",)], "name string"), catalog, "Place")
    return change.update(more, {"visits": F.col("visits").cast("int") * 100}, where("name", "!=", "OCEANIA"), catalog, "Place").select(INDEX, "name", F.col("visits").cast("int").alias("visits"))


@query("SELECT 'Person' AS _source, c_custkey AS _index, 'balance' AS _field, CAST(c_acctbal AS DOUBLE) AS _value FROM customer UNION ALL SELECT 'Order', o_orderkey, 'total', CAST(o_totalprice AS DOUBLE) FROM orders")
def alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of an alias, its fields found in the catalog."""
    catalog, records = shop(spark, sf_dir)
    return tables.type_scan(records, tables.typed_columns(catalog, records, "Money"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_size || '' || (p_size + 1), '12') OR regexp_matches(p_size || '' || (p_size + 1), '9$')")
def list_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text predicates on a list read its elements as one text."""
    rows = table(spark, sf_dir, "part").withColumn("pair", F.array(F.col("p_size"), F.col("p_size") + 1))
    return select(rows, ["p_partkey"], any_of(where("pair", "starts with", "12"), where("pair", "matches", "9$")))


_LAND_JSON = """'{"$id":"Land_' || n_nationkey || '","name":"' || n_name || '","region":{"$ref":"Region_' || n_regionkey || '"}}'"""


@query(f"SELECT 0 AS part, CAST(r_regionkey AS BIGINT) AS _index, '{{\"$id\":\"Region_' || r_regionkey || '\",\"name\":\"' || r_name || '\"}}' AS value FROM region UNION ALL SELECT 1, n_nationkey, {_LAND_JSON} FROM nation")
def dump_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in dependency order, with references between them."""
    records = shop(spark, sf_dir)[1]
    return dump.dump(_plain_places(), {"Region": records["Region"].select(INDEX, "name"), "Land": records["Land"]}, "json", ["Land"])


@query("SELECT '- &Land_' || n_nationkey || chr(10) || '  name: \"' || n_name || '\"' || chr(10) || '  region: *Region_' || n_regionkey AS value FROM nation")
def dump_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_yaml(shop(spark, sf_dir)[1]["Land"], "Land", dump.references_of(_plain_places(), "Land"))


@query("SELECT '<Land id=\"Land_' || n_nationkey || '\"><name>' || n_name || '</name><region ref=\"#Region_' || n_regionkey || '\"/></Land>' AS value FROM nation")
def dump_xml_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_xml(shop(spark, sf_dir)[1]["Land"], "Land", dump.references_of(_plain_places(), "Land"))


@query("SELECT '$_Land_' || n_nationkey || ' = create Land(name=\"' || n_name || '\", region=$_Region_' || n_regionkey || ')' AS value FROM nation")
def dump_script_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_script(shop(spark, sf_dir)[1]["Land"], "Land", dump.references_of(_plain_places(), "Land"))


def _plain_places() -> Catalog:
    c = Catalog()
    c.composite("Region", [Field("name", "string")])
    c.composite("Land", [Field("name", "string"), Field("region", "Region")])
    return c


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'none' ELSE 'at' END AS variant FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3")
def where_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum literals with and without payload."""
    people = shop(spark, sf_dir)[1]["Person"]
    return select(people, "*", any_of(variant("home", "at", land=3), where(F.col("home._variant"), "=", "none"))).select(F.col(INDEX).alias("c_custkey"), F.col("home._variant").alias("variant"))



# single rows, methods in updates, typed arithmetic, catalogs and archives


@query("SELECT CAST(p_partkey AS BIGINT) AS _index, p_name FROM part WHERE p_partkey = 7")
def row_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "part"), [INDEX, "p_name"], where(INDEX, "=", 7))


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def update_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.update(table(spark, sf_dir, "customer"), {"c_name": F.lit("renamed")}, where(INDEX, "=", 5)).select("c_custkey", "c_name")


@query("SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS numbers FROM lineitem GROUP BY l_orderkey")
def project_array_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of each element of an array of rows; an order has seven lines at most."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    return per.select("l_orderkey", F.array_join(F.col("a.l_linenumber").cast("array<string>"), ",").alias("numbers"))


@query(
    """SELECT p_partkey, ltrim(t) AS left_off, rtrim(t) AS right_off, t = '' AS nothing, p_size = 0 AS none, replace(p_name, 'a', 'bb') AS replaced
    FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN '' ELSE '  ' || p_name || ' ' END AS t FROM part)"""
)
def string_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    empty = C.is_empty(F.filter(F.array("p_size"), lambda x: x > 0))
    return table(spark, sf_dir, "part").select("p_partkey", S.trim_start(t).alias("left_off"), S.trim_end(t).alias("right_off"), S.is_empty(t).alias("nothing"), empty.alias("none"), S.replace_all(F.col("p_name"), "a", "bb").alias("replaced"))


@query(
    f"""SELECT p_partkey, {_sql_text("CASE WHEN p_partkey % 3 = 0 THEN list_concat(list_reverse(a), [8]) WHEN p_partkey % 3 = 1 THEN list_concat([7], a[2:]) ELSE a END")} AS a FROM ({_A})"""
)
def update_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of methods in updates of an array."""
    rows = _sizes(spark, sf_dir).select("p_partkey", "a", (F.col("p_partkey") % 3).alias("part"))
    rows = change.update(rows, {"a": C.append(C.reverse(F.col("a")), 8)}, where("part", "=", 0))
    return change.update(rows, {"a": C.prepend(C.delete(F.col("a"), 0), 7)}, where("part", "=", 1)).select("p_partkey", _text(F.col("a")).alias("a"))


@query(
    """SELECT p_partkey, upper(p_name) || '!' AS name, lower(p_name) AS type, CASE WHEN p_brand = 'Brand#1' THEN 'Brand#1' ELSE p_brand || ',Brand#1' END AS members, 'b' AS names FROM part"""
)
def update_texts_sets_and_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain on a text, a field from another one, a member added to a set, a key taken from a dictionary."""
    rows = table(spark, sf_dir, "part").select(INDEX, "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_brand").alias("members"), F.create_map(F.lit("a"), "p_size", F.lit("b"), F.lit(2)).alias("sizes"))
    rows = change.update(rows, {"type": S.lowercase(F.col("name")), "members": C.set_add(F.col("members"), "Brand#1"), "sizes": C.drop_key(F.col("sizes"), "a")})
    rows = change.update(rows, {"name": F.concat(S.uppercase(F.col("name")), F.lit("!"))})
    return rows.select("p_partkey", "name", "type", F.array_join("members", ",").alias("members"), _joined(C.keys(F.col("sizes"))).alias("names"))


@query(
    """SELECT p_partkey, CAST(least(p_size * 4 + 50, 127) AS BIGINT) AS held, CAST((p_size * 7 + 3) % 256 AS BIGINT) AS turned, CAST(p_size // 4 AS BIGINT) AS quotient,
    CAST((p_size - 60) - 7 * floor((p_size - 60) / 7.0) AS BIGINT) AS remainder, CAST(p_size AS DOUBLE) / 4 AS ratio, p_size || 'x' AS text FROM part"""
)
def math_type_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type and the policy of one operand, a literal or an alias, are those of the result."""
    c = Catalog()
    c.alias("Small", "int8")
    size = F.col("p_size")
    held, turned = typed(c, size, "Small", "saturating") * 4 + 50, 3 + typed(c, size, "uint8", "wrapping") * typed(c, 7, "uint8")
    four = typed(c, size, "int8") / typed(c, 4, "int8")
    return table(spark, sf_dir, "part").select("p_partkey", held.value.alias("held"), turned.value.alias("turned"), four.value.alias("quotient"), ((typed(c, size, "int16") - 60) % 7).value.alias("remainder"), (typed(c, size, "float64") / 4).value.alias("ratio"), typed(c, size, "int8").concat("x").alias("text"))


@query("SELECT p_partkey, CAST(p_size % 3 + 6 AS BIGINT) AS above, CAST(2 * (p_size % 3 + 5) AS BIGINT) AS twice FROM part")
def enum_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of an enum with a backing type count as numbers of it."""
    c = Catalog()
    c.enum("Colour", {"red": 5, "green": None, "blue": None}, "uint8")
    variant_ = N.enum_name((F.col("p_size") % 3 + 5).cast("int"), c.types["Colour"].variants)
    colour = typed(c, F.col("colour"), "Colour")
    return table(spark, sf_dir, "part").select("p_partkey", variant_.alias("colour")).select("p_partkey", (colour + 1).value.alias("above"), (colour + colour).value.alias("twice"))


@query("SELECT * FROM (VALUES ('Money', 'alias'), ('Place', 'composite'), ('Region', 'composite'), ('Land', 'composite'), ('Home', 'enum'), ('Person', 'composite'), ('Order', 'composite')) t(name, kind)")
def catalog_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir)[0].show(spark).where("kind <> 'primitive'")


@query(
    """SELECT * FROM (VALUES ('name', 'string', NULL), ('visits', 'saturating uint8', '7'), ('rank', 'wrapping int8', NULL), ('tags', 'string[]', '[''new'']'),
    ('none', '', NULL), ('at', 'land: Land, since: int32', NULL), ('land', 'Land', NULL), ('since', 'int32', NULL)) t(property, type, value)"""
)
def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite, an enum and one of its variants, from the catalog as it is kept."""
    c = Catalog.from_json(shop(spark, sf_dir)[0].to_json())
    return c.describe(spark, "Place").union(c.describe(spark, "Home")).union(c.describe(spark, "Home.at"))


@query("SELECT CAST(n_nationkey - (n_nationkey > 4)::INT AS BIGINT) AS _index, n_name AS name, CASE WHEN n_regionkey <> 1 THEN CAST(n_regionkey - (n_regionkey > 1)::INT AS BIGINT) END AS region FROM nation WHERE n_nationkey <> 4")
def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written with their catalog and read again: deleted rows leave no gaps, references follow, and those to deleted rows are null."""
    catalog, folder = _plain_places(), f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    land = shop(spark, sf_dir)[1]["Land"].where(F.col(INDEX) != 4)
    region = change.delete(table(spark, sf_dir, "region").select(INDEX, F.col("r_name").alias("name")), where(INDEX, "=", 1))
    dump.archive(spark, catalog, {"Region": region, "Land": land}, folder, {"Land": {"region": "Region"}})
    again = cut(dump.restore(spark, folder, ["Region", "Land"])[1]["Land"].select(INDEX, "name", "region"))
    removed(spark, folder)
    return again


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of JSON text as variants."""
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}")).alias("value")).write.text(folder)
    found = cut(tables.json_documents(spark, folder).select(F.try_variant_get("document", "$.id", "bigint").alias("event_id"), F.try_variant_get("document", "$.props.k", "int").alias("k")))
    removed(spark, folder)
    return found


@query("SELECT 'n' || n_nationkey AS source, 'region' AS label, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'members', 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_compound_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.either(g.select("nations"), ["region", "members"]).edges.select("source", "label", "target")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3 AND c_mktsegment <> 'MACHINERY'")
def graph_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes chosen by a boolean, an integer and a text."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("people").alias("selector"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("rich"), F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("segment"))
    g = Graph(people, spark.createDataFrame([], "axis string, source string, target string"))
    return g.select("people", where=F.col("rich") & (F.col("place") == 3) & (F.col("segment") != "MACHINERY")).nodes


@query("SELECT * FROM (VALUES ('fields', 'Region', 'Region.name'), ('type', 'Region.name', 'string'), ('fields', 'Land', 'Land.name'), ('type', 'Land.name', 'string'), ('fields', 'Land', 'Land.region'), ('type', 'Land.region', 'Region')) t(axis, source, target)")
def graph_of_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_graph(spark, _plain_places()).edges


@query(f"SELECT k, count(*) AS n FROM (SELECT {_sql_text('a[1:1]')} AS k FROM ({_A})) GROUP BY k")
def aggregate_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as the key of groups."""
    rows = _sizes(spark, sf_dir).select(F.col("p_partkey").alias(INDEX), C.cut(F.col("a"), 0, 1).alias("k"))
    return named(select(rows, ["k", Agg("count")], group_by=["k"]), k="k", n="count(*)").select(_text(F.col("k")).alias("k"), "n")


__all__ = ["ORACLE_SQL", "QUERIES", "graph"]
