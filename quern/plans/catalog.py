"""Registered queries of the engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import aggregates as agg
from quern.functions import scalars, windows
from quern.operators import joins
from quern.operators.control import each, each_key, each_object, each_value, it, when
from quern.operators.crud import Include, select
from quern.operators.filters import filter_by
from quern.operators.includes import include_many, include_one, json_many, json_one
from quern.operators.ordering import order_by, paginate
from quern.operators.projection import GroupByProjection, col, project_by, quoted, raw, row, val
from quern.operators.recursion import iterate
from quern.plans import manifest
from quern.plans.params import ctx, param
from quern.plans.query import Query, QueryAs, Recursive, sql
from quern.plans.registry import QueryRegistry, Request
from quern.plans.tables import Customer, Event, Item, Nation, Order, OrderSummary, Product, Region, database
from quern.sources.store import Store
from quern.sources.scratch import new_path
from quern.sources.tables import Database, Table

FLAGSHIP = "orders_by_status"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable:
    def keep(make: Callable[[Database], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(database(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return make

    return keep


def template(name: str, query: Query, oracle: str, params: dict[str, Any] | None = None, context: dict[str, Any] | None = None) -> None:
    register(name, oracle)(lambda db: query.dataframe(db, params, context))


O, C, I, P, N, R = Order, Customer, Item, Product, Nation, Region

# -- scans, projections, pages

register("orders_by_status", """
    SELECT o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS total FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 GROUP BY 1 ORDER BY n DESC NULLS FIRST LIMIT 10""")(
    lambda db: select(O).dataframe(db, {"filter_by": {"status": ["in", "F", "O"], "total": [">=", 1000.0]}, "select": ["status", ["count", "*", "n"], ["sum", "total", "total"]], "limit": 10}))

template("scan_all_columns", sql("select {all} from {t}", all=N.all, t=N), "SELECT n_nationkey AS nationKey, n_name AS name, n_regionkey AS regionKey FROM nation")
template("row_and_rename", sql("select {r} from {t} where {k} < {x}", r=row(C.c.custKey, C.c.name.as_("customer"), val("upper({s})", s=C.c.segment).as_("segment")), t=C, k=C.c.custKey, x=param("most")), "SELECT c_custkey AS custKey, c_name AS customer, upper(c_mktsegment) AS segment FROM customer WHERE c_custkey < 50", {"most": 50})
template("row_last_duplicate_wins", sql("select {r} from {t}", r=row(R.c.regionKey, R.c.name, R.c.regionKey.as_("name")), t=R), "SELECT r_regionkey AS regionKey, r_regionkey AS name FROM region")
template("raw_and_quote", sql("select count(*) as {n} from {t} where {x}", n=quoted("how many"), t=O, x=raw("1 = 1")), 'SELECT count(*) AS "how many" FROM orders')
template("named_expression", sql("select {a} + 1 as {n} from {t}", a=R.c.regionKey, n=col("next"), t=R), "SELECT r_regionkey + 1 AS next FROM region")
template("subquery_all_columns", (lambda s: sql("select {all} from {s} where {k} > 2", all=s.all, s=s, k=s.c.regionKey))(sql("select {r} from {t}", r=row(R.c.regionKey, R.c.name), t=R).named("inner_regions")), "SELECT r_regionkey AS regionKey, r_name AS name FROM region WHERE r_regionkey > 2")
template("scalar_subquery", sql("select {r} from {t}", r=row(N.c.name, val(sql("select count(*) from {c} where {a} = {b}", c=C, a=C.c.nationKey, b=N.out.nationKey)).as_("customers")), t=N), "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
template("distinct_rows", sql("select distinct {s}, {p} from {t}", s=O.c.status, p=O.c.priority, t=O), "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
template("count_star_of_table", sql("select count({all}) as n from {t}", all=O.all, t=O), "SELECT count(*) AS n FROM orders")
template("project_plain", sql("select {p} from {t}{g}", p=project_by(C), t=C, g=GroupByProjection(project_by(C))), "SELECT c_name AS name, c_mktsegment AS segment FROM customer", {"select": ["name", "segment"]})
template("project_grouped", sql("select {p} from {t}{g}", p=project_by(O), t=O, g=GroupByProjection(project_by(O))), "SELECT o_custkey AS custKey, o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS best, avg(o_totalprice) AS mean FROM orders GROUP BY ALL", {"select": ["custKey", "status", ["count", "*", "n"], ["max", "total", "best"], ["avg", "total", "mean"]]})
register("project_global_aggregates", "SELECT count(o_orderkey) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, sum(o_totalprice) AS total FROM orders")(
    lambda db: select(O).dataframe(db, {"select": [["count", "orderKey", "n"], ["min", "total", "low"], ["max", "total", "high"], ["sum", "total", "total"]]}))
register("crud_page", "SELECT o_orderkey AS orderKey, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")(
    lambda db: select(O, order_by={"total": "desc", "orderKey": "asc"}).dataframe(db, {"select": ["orderKey", "total"], "limit": 20, "offset": 40}))
register("crud_static_page", "SELECT c_custkey AS custKey, c_name AS name FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 3")(
    lambda db: select(C, select=("custKey", "name"), order_by={"custKey": "asc"}, limit=7, offset=3).dataframe(db))
template("template_page", sql("select {r} from {t} {o} {p}", r=row(C.c.custKey, C.c.balance), t=C, o=order_by(C), p=paginate()), "SELECT c_custkey AS custKey, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5", {"order_by": {"balance": "DESC", "custKey": None}, "limit": 15, "offset": 5})
template("order_nulls", sql("select k, v from (select {k} as k, nullif({s}, 'P') as v from {t}) as x order by v desc nulls first, k limit 30", k=O.c.orderKey, s=O.c.status, t=O), "SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS v FROM orders ORDER BY v DESC NULLS FIRST, k LIMIT 30")
register("top_k", "SELECT l_orderkey AS orderKey, l_linenumber AS line, l_extendedprice AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")(
    lambda db: select(I, select=("orderKey", "line", "price"), order_by={"price": "desc", "orderKey": "asc", "line": "asc"}, limit=25).dataframe(db))

# -- filters: one query for each operator, and combinations

_FILTERS: dict[str, tuple[Any, str]] = {
    "bare": ({"status": "F"}, "o_orderstatus = 'F'"),
    "equal": ({"status": ["=", "O"]}, "o_orderstatus = 'O'"),
    "not": ({"status": ["not", "O"]}, "o_orderstatus <> 'O'"),
    "not_equal": ({"status": ["!=", "P"]}, "o_orderstatus <> 'P'"),
    "greater": ({"total": [">", 300000.0]}, "o_totalprice > 300000"),
    "greater_equal": ({"custKey": [">=", 1400]}, "o_custkey >= 1400"),
    "less": ({"total": ["<", 5000.0]}, "o_totalprice < 5000"),
    "less_equal": ({"custKey": ["<=", 5]}, "o_custkey <= 5"),
    "between": ({"total": ["between", 10000.0, 20000.0]}, "o_totalprice BETWEEN 10000 AND 20000"),
    "between_nothing": ({"total": ["between"]}, "o_totalprice IS NULL"),
    "in": ({"custKey": ["in", 1, 2, 3]}, "o_custkey IN (1, 2, 3)"),
    "in_nothing": ({"custKey": ["in"]}, "o_custkey IS NULL"),
    "not_in": ({"status": ["notIn", "F", "O"]}, "o_orderstatus NOT IN ('F', 'O')"),
    "not_in_nothing": ({"status": ["notIn"]}, "o_orderstatus IS NOT NULL"),
    "like": ({"priority": ["like", "1%"]}, "o_orderpriority LIKE '1%'"),
    "not_like": ({"priority": ["notLike", "%O%"]}, "o_orderpriority NOT LIKE '%O%'"),
    "is_null": ({"status": ["isNull"]}, "o_orderstatus IS NULL"),
    "is_not_null": ({"status": ["isNotNull"]}, "o_orderstatus IS NOT NULL"),
    "null_equals_nothing": ({"status": None}, "o_orderstatus = NULL"),
    "empty": ([], "TRUE"),
    "and_list": ([{"status": "F"}, {"total": [">", 200000.0]}], "o_orderstatus = 'F' AND o_totalprice > 200000"),
    "or_group": ([{"or": [{"status": "P"}, {"total": ["<", 2000.0]}]}, {"custKey": [">", 10]}], "(o_orderstatus = 'P' OR o_totalprice < 2000) AND o_custkey > 10"),
    "or_in_one_mapping": ([{"or": [{"status": "P", "custKey": 7}]}], "(o_orderstatus = 'P' OR o_custkey = 7)"),
    "nested_or": ([{"or": [{"status": "P"}, {"or": [{"custKey": 1}, {"custKey": 2}]}]}], "(o_orderstatus = 'P' OR o_custkey IN (1, 2))"),
}


def _filter(name: str, given: Any, text: str) -> None:
    oracle = f"SELECT o_orderkey AS orderKey, o_orderstatus AS status FROM orders WHERE {text}"
    register(f"filter_{name}", oracle)(lambda db: select(O, select=("orderKey", "status")).dataframe(db, {"filter_by": given}))
    template(f"filter_text_{name}", sql("select {r} from {t} where {f}", r=row(O.c.orderKey, O.c.status), t=O, f=filter_by(O)), oracle, {"filter_by": given})


for _name, (_given, _text) in _FILTERS.items():
    _filter(_name, _given, _text)

register("filter_static_and_runtime", "SELECT o_orderkey AS orderKey FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 100")(
    lambda db: select(O, where={"status": "O"}, select=("orderKey",)).dataframe(db, {"filter_by": {"custKey": ["<", 100]}}))
template("filter_free_form", sql("select {r} from {t} where case when {a} > 250000 then 1 else 0 end = 1 and {c} * 2 + 1 > 100 and {s} is not null", r=row(O.c.orderKey), t=O, a=O.c.total, c=O.c.custKey, s=O.c.status), "SELECT o_orderkey AS orderKey FROM orders WHERE o_totalprice > 250000 AND o_custkey * 2 + 1 > 100")
template("filter_prefix", sql("select count(*) as n from {t} {f}", t=O, f=filter_by(O, prefix="where")), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", {"filter_by": {"status": "F"}})
template("having", sql("select {c} as custKey, count(*) as n from {t} group by {c} having count(*) >= {least}", c=O.c.custKey, t=O, least=param("least")), "SELECT o_custkey AS custKey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12", {"least": 12})
register("crud_having", "SELECT o_custkey AS custKey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 13")(
    lambda db: select(O, select=("custKey", ("count", "*", "n")), having="n > 13").dataframe(db))

# -- semi and anti joins, with SQL's null semantics

_rich = sql("select {k} from {t} where {b} > 9000", k=C.c.custKey, t=C, b=C.c.balance)
template("in_subquery", sql("select {r} from {t} where {k} in {q}", r=row(O.c.orderKey), t=O, k=O.c.custKey, q=_rich), "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
template("not_in_subquery", sql("select {r} from {t} where {k} not in {q}", r=row(O.c.orderKey), t=O, k=O.c.custKey, q=_rich), "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
template("exists_correlated", sql("select {r} from {t} where exists (select {all} from {o} where {a} = {b} and {x} > 400000)", r=row(C.c.custKey), t=C, all=O.all, o=O, a=O.c.custKey, b=C.c.custKey, x=O.c.total), "SELECT c_custkey AS custKey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
template("not_exists", sql("select {r} from {t} where not exists {q}", r=row(O.c.orderKey), t=O, q=sql("select {k} from {i} where {k} = {o}", k=I.c.orderKey, i=I, o=O.out.orderKey)), "SELECT o_orderkey AS orderKey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
register("where_in_frame", ORACLE["in_subquery"])(lambda db: joins.where_in(db.keyed(O), "custKey", _rich.dataframe(db)).select("orderKey"))
register("where_not_in_frame", ORACLE["not_in_subquery"])(lambda db: joins.where_not_in(db.keyed(O), "custKey", _rich.dataframe(db)).select("orderKey"))
register("where_not_in_with_null", "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 5) FROM customer WHERE c_custkey < 50)")(
    lambda db: joins.where_not_in(db.keyed(O), "custKey", db.keyed(C).where("custKey < 50").select(F.nullif("custKey", F.lit(5)).alias("k"))).select("orderKey"))
register("where_exists_frame", "SELECT c_custkey AS custKey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(
    lambda db: joins.where_exists(db.keyed(C), db.keyed(O).where("status = 'P'").select(F.col("custKey").alias("k")), {"custKey": "k"}).select("custKey"))

# -- joins

template("join_inner", sql("select {r} from {o} join {c} on {a} = {b}", r=row(O.c.orderKey, C.c.name), o=O, c=C, a=O.c.custKey, b=C.c.custKey), "SELECT o_orderkey AS orderKey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
template("join_left", sql("select {r} from {o} left join {i} on {a} = {b} and {q} > 45", r=row(O.c.orderKey, I.c.line, I.c.quantity), o=O, i=I, a=O.c.orderKey, b=I.c.orderKey, q=I.c.quantity), "SELECT o_orderkey AS orderKey, l_linenumber AS line, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
_B = C.as_("other")
template("join_self", sql("select {r} from {a} join {b} on {x} = {y} and {k} = {l} + 1", r=row(C.c.custKey, _B.c.custKey.as_("before")), a=C, b=_B, x=C.c.segment, y=_B.c.segment, k=C.c.custKey, l=_B.c.custKey), "SELECT a.c_custkey AS custKey, b.c_custkey AS before FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey = b.c_custkey + 1")
_first = sql("select {k}, min({n}) as line from {t} group by {k2}", k=I.c.orderKey, n=I.c.line, t=I, k2=I.c.orderKey).named("first_lines")
template("join_multi_condition", sql("select {r} from {i} join {f} on {a} = {x} and {b} = {y}", r=row(I.c.orderKey, I.c.partKey), i=I, f=_first, a=I.c.orderKey, x=_first.c.orderKey, b=I.c.line, y=_first.c.line), "SELECT l_orderkey AS orderKey, l_partkey AS partKey FROM lineitem JOIN (SELECT l_orderkey k, min(l_linenumber) n FROM lineitem GROUP BY 1) ON l_orderkey = k AND l_linenumber = n")
_totals = sql("select {k}, sum({v}) as total from {t} group by {k2}", k=O.c.custKey, v=O.c.total, t=O, k2=O.c.custKey).named("totals")
template("join_subquery", sql("select {n} as name, {t} as total from {c} join {q} on {a} = {b} where {t} > 1000000", n=C.c.name, t=_totals.c.total, c=C, q=_totals, a=C.c.custKey, b=_totals.c.custKey), "SELECT c_name AS name, total FROM customer JOIN (SELECT o_custkey k, sum(o_totalprice) total FROM orders GROUP BY 1) ON c_custkey = k WHERE total > 1000000")
template("join_lateral", sql("select {n} as name, best from {c}, lateral (select max({v}) as best from {o} where {a} = {b})", n=C.c.name, c=C, v=O.c.total, o=O, a=O.c.custKey, b=C.c.custKey), "SELECT c_name AS name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
register("join_right_full", "SELECT r_name AS region, n_name AS nation FROM (SELECT * FROM region WHERE r_regionkey > 1) FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON r_regionkey = n_regionkey")(
    lambda db: joins.join(db.keyed(R).where("regionKey > 1").toDF("rk", "region"), db.keyed(N).where("regionKey < 3").toDF("nk", "nation", "fk"), {"rk": "fk"}, "full").select("region", "nation"))
register("crud_join", "SELECT o_orderkey AS orderKey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")(
    lambda db: select(O, join=((C, {"custKey": "custKey"}, "inner"),)).dataframe(db, {"filter_by": {"status": "P"}}).select("orderKey", "segment"))

# -- aggregates

template("group_by_many", sql("select {f} as flag, {s} as status, sum({q}) as qty, sum({p} * (1 - {d})) as revenue, avg({q}) as mean, count(*) as n from {t} group by {f2}, {s2}", f=raw("l_returnflag"), s=raw("l_linestatus"), q=I.c.quantity, p=I.c.price, d=I.c.discount, t=I, f2=raw("l_returnflag"), s2=raw("l_linestatus")), "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2")
template("count_distinct", sql("select {s} , count(distinct {c}) as customers from {t} group by {s2}", s=O.c.status, c=O.c.custKey, t=O, s2=O.c.status), "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
template("sum_of_product", sql("select {o}, cast(sum(cast({p} as decimal(12, 2)) * cast({q} as decimal(12, 2))) as double) as value from {t} where {o2} < 100 group by {o3}", o=I.c.orderKey, p=I.c.price, q=I.c.quantity, t=I, o2=I.c.orderKey, o3=I.c.orderKey), "SELECT l_orderkey AS orderKey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS value FROM lineitem WHERE l_orderkey < 100 GROUP BY 1")
register("array_agg_keeps_nulls", "SELECT n_regionkey AS regionKey, array_to_string(list_transform(list_sort(array_agg(nullif(n_nationkey, 3)), 'ASC', 'NULLS LAST'), lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS keys FROM nation GROUP BY 1")(
    lambda db: db.keyed(N).withColumn("v", F.nullif("nationKey", F.lit(3))).groupBy("regionKey").agg(agg.array_agg("v").alias("keys")).select("regionKey", F.expr("array_join(transform(keys, x -> cast(x as string)), ',', '-')").alias("keys")))
register("string_agg_ordered", "SELECT n_regionkey AS regionKey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")(
    lambda db: db.keyed(N).groupBy("regionKey").agg(agg.string_agg("name", "; ", ["nationKey"]).alias("names")))
register("json_agg_ordered", "SELECT n_regionkey AS regionKey, '[' || string_agg('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' AS rows FROM nation GROUP BY 1")(
    lambda db: db.keyed(N).groupBy("regionKey").agg(F.array_sort(F.collect_list(F.struct("name", "nationKey"))).alias("r")).select("regionKey", F.to_json(F.transform("r", lambda x: F.struct(x["nationKey"].alias("k"), x["name"].alias("n")))).alias("rows")))
template("grouping_sets", sql("select {s} as status, {p} as priority, count(*) as n from {t} group by grouping sets (({s}, {p}), ({s}), ())", s=raw("o_orderstatus"), p=raw("o_orderpriority"), t=O), "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
register("rollup", "SELECT n_regionkey AS regionKey, n_nationkey AS nationKey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")(lambda db: db.keyed(N).rollup("regionKey", "nationKey").agg(F.count(F.lit(1)).alias("n")))
register("count_if", "SELECT o_custkey AS custKey, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY 1")(lambda db: db.keyed(O).groupBy("custKey").agg(agg.count_if("status = 'F'").alias("filled")))
template("view_scan", sql("select {r} from {v} where {n} > 5", r=row(OrderSummary.c.custKey, OrderSummary.c.orderCount, OrderSummary.c.latestAt), v=OrderSummary, n=OrderSummary.c.orderCount), "SELECT c_custkey AS custKey, count(o_orderkey) AS orderCount, max(o_orderdate) AS latestAt FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) > 5")

# -- windows

register("window_row_number", "SELECT o_orderkey AS orderKey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")(
    lambda db: windows.with_window(db.keyed(O), "n", "row_number", partition=("custKey",), order=(("orderDate", False), ("orderKey", False))).select("orderKey", "n"))
register("window_rank_in_nation", "SELECT c_custkey AS custKey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer")(
    lambda db: windows.with_window(windows.with_window(db.keyed(C), "r", "rank", partition=("nationKey",), order=(("balance", True),)), "d", "dense_rank", partition=("nationKey",), order=(("segment", False),)).select("custKey", "r", "d"))
template("window_global_rank", sql("select {k}, rank() over (order by {b} desc) as r from {t}", k=C.c.custKey, b=C.c.balance, t=C), "SELECT c_custkey AS custKey, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer")
template("window_running_sum", sql("select {k}, sum({q}) over (partition by {o} order by {l}) as running from {t}", k=I.c.orderKey, q=I.c.quantity, o=I.c.orderKey, l=I.c.line, t=I), "SELECT l_orderkey AS orderKey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running FROM lineitem")
template("window_lag_lead", sql("select {k}, lag({v}) over (partition by {c} order by {d}, {k2}) as before, lead({v}) over (partition by {c} order by {d}, {k2}) as after from {t}", k=O.c.orderKey, k2=O.c.orderKey, v=O.c.total, c=O.c.custKey, d=O.c.orderDate, t=O), "SELECT o_orderkey AS orderKey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
register("window_ntile", "SELECT c_custkey AS custKey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")(
    lambda db: windows.with_window(db.keyed(C), "quartile", "ntile", n=4, partition=("segment",), order=(("balance", False), ("custKey", False))).select("custKey", "quartile"))
register("window_frame", "SELECT o_orderkey AS orderKey, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean FROM orders")(
    lambda db: windows.with_window(db.keyed(O), "mean", "avg", "total", partition=("custKey",), order=(("orderDate", False), ("orderKey", False)), rows=(-2, 0)).select("orderKey", "mean"))
register("window_global_row_number", "SELECT o_orderkey AS orderKey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")(
    lambda db: windows.global_row_number(db.keyed(O).select("orderKey", "total"), (("total", True), ("orderKey", False)), "n").select("orderKey", "n"))

# -- branches and repetitions

_when = sql("select {r} from {t}{w}", r=row(O.c.orderKey), t=O, w=when("status", sql(" where {a} = {s}", a=O.c.status, s=param("status")), sql(" where {a} > 300000", a=O.c.total)))
template("when_true", _when, "SELECT o_orderkey AS orderKey FROM orders WHERE o_orderstatus = 'F'", {"status": "F"})
template("when_else", _when, "SELECT o_orderkey AS orderKey FROM orders WHERE o_totalprice > 300000")
template("when_negated", sql("select {r} from {t}{w}", r=row(O.c.orderKey), t=O, w=when("!all", raw(" where o_custkey < 10"))), "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey < 10")
template("when_zero_is_present", sql("select count(*) as n from {t}{w}", t=O, w=when("least", sql(" where {a} > {x}", a=O.c.custKey, x=param("least")))), "SELECT count(*) AS n FROM orders WHERE o_custkey > 0", {"least": 0})
template("each_in_list", sql("select {r} from {t} where {k} in ({e})", r=row(O.c.orderKey), t=O, k=O.c.custKey, e=each("ids")), "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey IN (3, 5, 8)", {"ids": [3, 5, 8]})
template("each_template", sql("select {r} from {t} where {e}", r=row(C.c.custKey), t=C, e=each("names", sql("{n} like {v}", n=C.c.name, v=it()), " or ")), "SELECT c_custkey AS custKey FROM customer WHERE c_name LIKE '%1' OR c_name LIKE '%22'", {"names": ["%1", "%22"]})
template("each_object_gated", sql("select {r} from {t} where {e}", r=row(O.c.orderKey), t=O, e=each_object("match", sql("{k} = {v}", k=each_key(), v=each_value()), " and ", O)), "SELECT o_orderkey AS orderKey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 9", {"match": {"status": "O", "custKey": 9, "unknown": 1}})
template("array_parameter", sql("select count(*) as n from {t} where {s} in ({p})", t=O, s=O.c.status, p=param("statuses")), "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')", {"statuses": ["F", "P"]})
template("array_parameter_empty", sql("select count(*) as n from {t} where {s} in ({p})", t=O, s=O.c.status, p=param("statuses")), "SELECT 0::BIGINT AS n", {"statuses": []})
template("array_interpolated", sql("select count(*) as n from {t} where {k} in ({x})", t=O, k=O.c.custKey, x=[1, 2, 3]), "SELECT count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3)")
template("inline_fragment", sql("select count(*) as n from {t} where {f}", t=O, f=sql("{a} > {x}", a=O.c.total, x=param("x")).inline()), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000", {"x": 100000.0})
template("context_value", sql("select {r} from {t} where {k} = {u}", r=row(O.c.orderKey), t=O, k=O.c.custKey, u=ctx("user.id")), "SELECT o_orderkey AS orderKey FROM orders WHERE o_custkey = 42", None, {"user": {"id": 42}})
template("default_parameter", sql("select {r} from {t} where {k} = {x}", r=row(O.c.orderKey), t=O, k=O.c.status, x=param("status", "P", values=["F", "O", "P"])), "SELECT o_orderkey AS orderKey FROM orders WHERE o_orderstatus = 'P'", {"status": "nonsense"})

# -- CTEs, recursion, sets

_big = sql("select {r} from {t} where {v} > 350000", r=row(O.c.orderKey, O.c.custKey, O.c.total), t=O, v=O.c.total).named("big_orders")
template("cte", sql("with {b} select {k} as custKey, count(*) as n from {b2} group by 1", b=_big, b2=_big, k=_big.c.custKey), "SELECT o_custkey AS custKey, count(*) AS n FROM orders WHERE o_totalprice > 350000 GROUP BY 1")
_few = sql("select {k} as custKey, count(*) as n from {b} group by 1", k=_big.c.custKey, b=_big).named("few")
template("cte_many", sql("with {b}, {f} select {n} as name, {m} as n from {c} join {f2} on {x} = {y}", b=_big, f=_few, n=C.c.name, m=_few.c.n, c=C, f2=_few, x=C.c.custKey, y=_few.c.custKey), "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey k, count(*) n FROM orders WHERE o_totalprice > 350000 GROUP BY 1) ON c_custkey = k")
_parent = "CASE WHEN c_custkey = 0 THEN NULL ELSE (c_custkey - 1) // 4 END"
_tree = Recursive(
    "tree",
    sql("select {k} as id, 0 as depth from {t} where {k} = 0", k=raw("c_custkey"), t=C),
    lambda me: sql("select c.c_custkey as id, tree.depth + 1 as depth from {t} as c join {me} on floor((c.c_custkey - 1) / 4) = tree.id and c.c_custkey > 0", t=QueryAs(sql("select c_custkey from {t}", t=C), "inner"), me=me),
).query
template("cte_recursive", sql("with recursive {t} select depth, count(*) as n from {t2} group by depth", t=_tree.render("with"), t2=_tree), f"WITH RECURSIVE tree AS (SELECT c_custkey AS id, 0 AS depth FROM customer WHERE c_custkey = 0 UNION ALL SELECT c_custkey, depth + 1 FROM customer JOIN tree ON {_parent} = id) SELECT depth, count(*) AS n FROM tree GROUP BY depth")


@register("recursion_by_loop", ORACLE["cte_recursive"])
def _loop(db: Database) -> DataFrame:
    c = db.keyed(C).select("custKey", F.expr("CASE WHEN custKey = 0 THEN NULL ELSE (custKey - 1) DIV 4 END").alias("parent"))
    step = lambda level: level.join(c, level["id"] == c["parent"]).select(c["custKey"].alias("id"), (level["depth"] + 1).alias("depth"))
    return iterate(c.where("parent IS NULL").select(F.col("custKey").alias("id"), F.lit(0).alias("depth")), step).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


template("union_all", sql("select {a} as k from {c} where {a} < 5 union all select {b} as k from {o} where {b2} < 3", a=raw("c_custkey"), c=C, b=raw("o_custkey"), o=O, b2=raw("o_custkey")), "SELECT c_custkey AS k FROM customer WHERE c_custkey < 5 UNION ALL SELECT o_custkey FROM orders WHERE o_custkey < 3")
template("union_distinct", sql("select c_nationkey as k from {c} union select n_nationkey as k from {n}", c=C, n=N), "SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation")
register("intersect_except", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda db: db.keyed(O).select("custKey").intersect(db.keyed(C).where("balance > 0").select("custKey")).subtract(db.keyed(C).where("segment = 'BUILDING'").select("custKey")).toDF("k"))

# -- includes

_OF = Include(O, {"custKey": "custKey"}, ("orderKey", "total"), order=(("total", True), ("orderKey", False)))
register("include_many", "SELECT c_custkey AS custKey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")(
    lambda db: select(C, include_many={"orders": Include(O, {"custKey": "custKey"}, ("orderKey",), {"status": "P"}, (("total", True), ("orderKey", False)))}).dataframe(db).select("custKey", F.expr("array_join(transform(orders, x -> cast(x.orderKey as string)), ',')").alias("orders")))
register("include_one", "SELECT c_custkey AS custKey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")(
    lambda db: select(C, include_one={"nation": Include(N, {"nationKey": "nationKey"})}).dataframe(db).select("custKey", "nation.name").toDF("custKey", "nation"))
register("include_one_latest", "SELECT c_custkey AS custKey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")(
    lambda db: select(C, include_one={"best": _OF}).dataframe(db).select("custKey", "best.orderKey").toDF("custKey", "best"))
register("include_nested", "SELECT c_custkey AS custKey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS items, coalesce(sum(l_quantity), 0) AS quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(
    lambda db: select(C, include_many={"orders": Include(O, {"custKey": "custKey"}, include_many={"items": Include(I, {"orderKey": "orderKey"}, ("line", "quantity"))})}).dataframe(db).selectExpr("custKey", "cast(size(orders) as bigint) as orders", "cast(aggregate(orders, 0, (a, o) -> a + size(o.items)) as bigint) as items", "aggregate(orders, 0d, (a, o) -> a + aggregate(o.items, 0d, (b, i) -> b + i.quantity)) as quantity"))
_PAGE = "SELECT c_custkey AS custKey, {} count(o_orderkey) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS orders FROM (SELECT * FROM customer ORDER BY {} LIMIT {}) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"
_paged = select(C, include_many={"orders": Include(O, {"custKey": "custKey"}, ("orderKey", "total"), order=(("orderKey", False),))})
_PAGE_COLUMNS = ("cast(size(orders) as bigint) as n", "array_join(transform(orders, x -> cast(x.orderKey as string)), ',') as orders")
register("include_page_ordered", _PAGE.format("c_name AS name,", "c_acctbal DESC, c_custkey", "9 OFFSET 4"))(
    lambda db: _paged.dataframe(db, {"order_by": {"balance": "desc", "custKey": "asc"}, "limit": 9, "offset": 4}).selectExpr("custKey", "name", *_PAGE_COLUMNS))
register("include_page_projected", _PAGE.format("", "c_custkey DESC", "6"))(
    lambda db: _paged.dataframe(db, {"order_by": {"custKey": "desc"}, "limit": 6, "select": ["custKey"]}).selectExpr("custKey", *_PAGE_COLUMNS))
_orders_of = sql("select {r} from {o} where {a} = {b}", r=row(O.c.orderKey, O.c.total), o=O, a=O.c.custKey, b=C.out.custKey).named("own_orders")
_many = sql("select {k}, {m} from {c}", k=C.c.custKey, m=json_many(_orders_of, order=(("total", True),)).as_("orders"), c=C)
_one = sql("select {k}, {m} from {c}", k=C.c.custKey, m=json_one(_orders_of, order=(("orderKey", False),)).as_("first"), c=C)
register("json_many_in_template", "SELECT c_custkey AS custKey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda db: _many.dataframe(db).selectExpr("custKey", "cast(size(orders) as bigint) as n", "array_join(transform(orders, x -> cast(x.orderKey as string)), ',') as orders"))
register("json_one_in_template", "SELECT c_custkey AS custKey, arg_min(o_totalprice, o_orderkey) AS total, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda db: _one.dataframe(db).selectExpr("custKey", "first.total as total", "first.orderKey as first"))

# -- scalar functions

template("coalesce_cast_case", sql("select {k}, coalesce(nullif({s}, 'F'), 'none') as s, cast({v} as decimal(12, 1)) as v, case when {p} like '1%' then 'high' when {p} like '5%' then 'low' else 'middle' end as p from {t}", k=O.c.orderKey, s=O.c.status, v=O.c.total, p=O.c.priority, t=O), "SELECT o_orderkey AS orderKey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, CAST(o_totalprice AS DECIMAL(12, 1)) AS v, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'middle' END AS p FROM orders")
register("json_field", "SELECT event_id AS eventId, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")(lambda db: db.keyed(Event).select("eventId", scalars.json_text(F.col("props"), "$.k").cast("long").alias("k")))
register("string_functions", "SELECT c_custkey AS custKey, c_name || '/' || c_mktsegment AS label, regexp_matches(c_name, '7$') AS seven FROM customer")(
    lambda db: db.keyed(C).select("custKey", F.concat("name", F.lit("/"), "segment").alias("label"), scalars.matches(F.col("name"), "7$").alias("seven")))

# -- changes on a copy-on-write store

_Account = Table("account", {k: C.columns[k] for k in ("custKey", "name", "balance", "segment")}, ("custKey",))
_START = "(SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer)"


def _store(db: Database) -> Store:
    store = Store(db.spark, new_path(db.spark))
    store.create(_Account, db.frame("customer"))
    return store


def _state(store: Store) -> DataFrame:
    return _Account.renamed(store.read(_Account))


_KEYS = "c_custkey AS custKey, c_name AS name, {b} AS balance, {s} AS segment"


@register("store_insert", f"SELECT {_KEYS.format(b='c_acctbal', s='c_mktsegment')} FROM {_START} UNION ALL SELECT -1, 'new', NULL, 'NONE' UNION ALL SELECT -2, 'newer', 1.5, 'NONE'")
def _insert(db: Database) -> DataFrame:
    store = _store(db)
    store.insert(_Account, [{"custKey": -1, "name": "new", "segment": "NONE", "balance": None}, {"custKey": -2, "name": "newer", "segment": "NONE", "balance": 1.5}])
    return _state(store)


@register("store_insert_from", f"SELECT {_KEYS.format(b='c_acctbal', s='c_mktsegment')} FROM {_START} UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'SUPPLIER' FROM supplier")
def _insert_from(db: Database) -> DataFrame:
    store = _store(db)
    store.insert_from(_Account, db.frame("supplier").selectExpr("s_suppkey AS custKey", "s_name AS name", "s_acctbal AS balance", "'SUPPLIER' AS segment"))
    return _state(store)


@register("store_update", f"SELECT {_KEYS.format(b='CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END', s='c_mktsegment')} FROM {_START}")
def _update(db: Database) -> DataFrame:
    store = _store(db)
    store.update(_Account, {"balance": 0.0}, "c_acctbal < 0")
    return _state(store)


@register("store_update_returning", "SELECT c_custkey AS custKey, c_name AS name, c_acctbal AS balance, 'X' AS segment FROM customer WHERE c_custkey < 20")
def _returning(db: Database) -> DataFrame:
    return _store(db).update(_Account, {"segment": "X"}, "c_custkey < 20")


@register("store_delete", f"SELECT {_KEYS.format(b='c_acctbal', s='c_mktsegment')} FROM {_START} WHERE NOT coalesce(nullif(c_mktsegment, 'MACHINERY') = 'BUILDING', false)")
def _delete(db: Database) -> DataFrame:
    store = _store(db)
    store.delete(_Account, "nullif(c_mktsegment, 'MACHINERY') = 'BUILDING'")
    return _state(store)


@register("store_upsert", f"SELECT c_custkey AS custKey, CASE WHEN c_custkey IN (1, 2) THEN 'up' ELSE c_name END AS name, CASE WHEN c_custkey IN (1, 2) THEN 9.5 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM {_START} UNION ALL SELECT -5, 'up', 9.5, NULL")
def _upsert(db: Database) -> DataFrame:
    store = _store(db)
    store.upsert(_Account, [{"custKey": k, "name": "up", "balance": 9.5} for k in (1, 2, -5)], ["custKey"])
    return _state(store)


@register("store_savepoint", f"SELECT {_KEYS.format(b='c_acctbal', s='c_mktsegment')} FROM {_START} WHERE c_custkey >= 10")
def _savepoint(db: Database) -> DataFrame:
    store = _store(db)
    with store.transaction() as t:
        t.delete(_Account, "c_custkey < 10")
        try:
            with t.savepoint():
                t.delete(_Account, force=True)
                raise RuntimeError("taken back")
        except RuntimeError:
            pass
    return _state(store)


# -- registry and manifest

_REMOTE = sql("select {r} from {t} where {k} = {u} and {f} {o} {p}", r=row(O.c.orderKey, O.c.total), t=O, k=O.c.custKey, u=ctx("user"), f=filter_by(O), o=order_by(O), p=paginate()).named("own")


@register("registry_by_hash", "SELECT o_orderkey AS orderKey, o_totalprice AS total FROM orders WHERE o_custkey = 17 AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 5")
def _registry(db: Database) -> DataFrame:
    registry = QueryRegistry(lambda: db)
    registry.register(_REMOTE)
    request = Request.of(_REMOTE, {"filter_by": {"total": [">", 1000.0]}, "order_by": {"orderKey": "asc"}, "limit": 5, "sneaky": 1})
    return db.spark.createDataFrame([(r["orderKey"], r["total"]) for r in registry.execute(request.to_json(), {"user": 17})], "orderKey long, total double")


register("manifest_round_trip", "SELECT o_orderkey AS orderKey, o_totalprice AS total FROM orders WHERE o_custkey = 23 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC LIMIT 3")(
    lambda db: manifest.loads(manifest.dumps({"own": _REMOTE}))["own"].dataframe(db, {"filter_by": {"status": ["!=", "P"]}, "order_by": {"total": "desc"}, "limit": 3}, {"user": 23}))
