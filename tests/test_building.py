"""Building text: what parts become, what is refused, hashes and manifests."""

import datetime

import pytest

from quern.errors import ErrorCode, QueryError
from quern.operators.control import each, each_key, each_object, it, when
from quern.operators.filters import filter_by, parse_filter
from quern.operators.includes import json_many
from quern.operators.mutations import DEFAULT, excluded, insert, insert_columns, insert_values, set_values, upsert
from quern.operators.ordering import order_by, paginate
from quern.operators.projection import GroupByProjection, col, project_by, quoted, raw, row, val
from quern.plans import manifest
from quern.plans.params import CONTEXT_VALUE, Param, ctx, inputs, merge, param
from quern.plans.query import Part, sql
from quern.plans.tables import Customer as C
from quern.plans.tables import Item as I
from quern.plans.tables import Order as O
from quern.plans.tables import OrderSummary


def text(q, params=None, context=None):
    return q.to_sql(None, params, context)


def refused(q, params=None, code=ErrorCode.BUILD_FAILED):
    with pytest.raises(QueryError) as e:
        text(q, params)
    assert e.value.code == code


def test_select_names_columns_by_key():
    assert text(sql("select {r} from {t}", r=row(C.c.custKey, C.c.name.as_("who")), t=C))[0] == "select `c_1`.`c_custkey` AS `custKey`, `c_1`.`c_name` AS `who` from `customer` AS `c_1`"


def test_values_never_enter_the_text():
    evil = "'; drop table x; --"
    got, args = text(sql("select 1 from {t} where {n} = {v} and {f}", t=C, n=C.c.name, v=param("v"), f=filter_by(C)), {"v": evil, "filter_by": {"name": ["in", evil, "b"]}})
    assert evil not in got and list(args.values()) == [evil, evil, "b"]


@pytest.mark.parametrize("bad", ["select ?", "select :x", "select * from t where a = :name"])
def test_raw_placeholders_are_refused(bad):
    refused(sql(bad))


def test_casts_and_quoted_placeholders_are_fine():
    assert text(sql("select '1'::int, ':x ?' as a"))[0] == "select '1'::int, ':x ?' as a"


@pytest.mark.parametrize(
    "given, want",
    [
        ({"status": "F"}, "`o_1`.`o_orderstatus` = :p0"),
        ({"status": ["not", "F"]}, "`o_1`.`o_orderstatus` <> :p0"),
        ({"total": ["between", 1, 2]}, "`o_1`.`o_totalprice` BETWEEN :p0 AND :p1"),
        ({"total": ["between"]}, "`o_1`.`o_totalprice` IS NULL"),
        ({"status": ["in"]}, "`o_1`.`o_orderstatus` IS NULL"),
        ({"status": ["notIn"]}, "`o_1`.`o_orderstatus` IS NOT NULL"),
        ({"status": ["notIn", "F", "O"]}, "`o_1`.`o_orderstatus` NOT IN (:p0, :p1)"),
        ([{"or": [{"status": "F"}, {"custKey": 1}]}, {"custKey": [">", 0]}], "(`o_1`.`o_orderstatus` = :p0 OR `o_1`.`o_custkey` = :p1) AND `o_1`.`o_custkey` > :p2"),
        (None, "TRUE"),
        ([], "TRUE"),
        ({}, "TRUE"),
    ],
)
def test_filter_text(given, want):
    assert text(sql("{f}", f=filter_by(O)), {"filter_by": given})[0] == want


@pytest.mark.parametrize("bad", [{"nope": 1}, {"status": ["~", "x"]}, {"status": [">"]}, {"status": ["isNull", 1]}, {"total": ["between", 1]}, {"status": {"a": 1}}, 5, [3]])
def test_filters_refused(bad):
    refused(sql("{f}", f=filter_by(O)), {"filter_by": bad})


def test_filter_include_and_omit():
    with pytest.raises(QueryError):
        parse_filter(O, {"status": "F"}, include=["total"])
    with pytest.raises(QueryError):
        parse_filter(O, {"status": "F"}, omit=["status"])
    assert text(sql("x{f}", f=filter_by(O, prefix=" where", suffix="and")), {})[0] == "x"


def test_order_and_pages():
    q = sql("{o} {p}", o=order_by(O), p=paginate())
    assert text(q, {"order_by": {"total": "DESC", "custKey": None}, "limit": 5})[0] == "ORDER BY `o_1`.`o_totalprice` DESC NULLS FIRST, `o_1`.`o_custkey` ASC NULLS LAST LIMIT :p0"
    assert text(q, {})[0] == " "
    for bad in ({"order_by": {"nope": "asc"}}, {"order_by": {"total": "up"}}, {"limit": -1}, {"offset": "3"}, {"limit": True}):
        refused(q, bad)


def test_projection():
    q = sql("select {p} from {t}{g}", p=project_by(O), t=O, g=GroupByProjection(project_by(O)))
    assert text(q, {"select": ["status", ["count", "*", "n"]]})[0] == "select `o_1`.`o_orderstatus` AS `status`, count(*) AS `n` from `orders` AS `o_1` GROUP BY `o_1`.`o_orderstatus`"
    assert "GROUP" not in text(q, {"select": [["sum", "total", "t"]]})[0] and "GROUP" not in text(q, {"select": ["status"]})[0]
    for bad in (["nope"], [["median", "total", "m"]], [["sum", "total"]], [["sum", "total", 'x" --']], [["sum", "*", "x"]]):
        refused(q, {"select": bad})


def test_branches_and_repetitions():
    q = sql("a{w}", w=when("x", raw(" yes"), raw(" no")))
    assert [text(q, {"x": v})[0] for v in (1, 0, "", False, None)] == ["a yes", "a yes", "a yes", "a no", "a no"] and text(q)[0] == "a no"
    assert text(sql("{w}", w=when("!x", raw("yes"))), {})[0] == "yes"
    assert text(sql("({e})", e=each("v")), {"v": []})[0] == "()"
    assert text(sql("{e}", e=each("v", sql("[{x}]", x=it()), "; ")), {"v": [1, 2]}) == ("[:p0]; [:p1]", {"p0": 1, "p1": 2})
    q = sql("{e}", e=each_object("m", sql("{k} = {v}", k=each_key(), v=it()), " and ", O))
    assert text(q, {"m": {"status": "F", "other": 1}})[0] == "`o_1`.`o_orderstatus` = :p0"
    assert text(sql("{e}", e=each_object("m", each_key())), {"m": {"a`b": 1}})[0] == "`a``b`"
    refused(sql("{x}", x=it()))
    refused(sql("{e}", e=each("v")), {"v": 3})


def test_parameters():
    assert param("a.b").resolve({"a": {"b": 3}}, None) == 3
    assert param("x", 7, least=10).resolve({"x": 1}, None) == 7 and param("x", 7).resolve({}, None) == 7
    for rules, value in [({"min_length": 2}, "a"), ({"max_length": 1}, "ab"), ({"pattern": "^a"}, "b"), ({"least": 3}, 2), ({"greatest": datetime.date(2020, 1, 1)}, datetime.date(2021, 1, 1)), ({"values": [1, 2]}, 3), ({"values": [1]}, True), ({"fields": ["a"]}, {"b": 1}), ({"check": lambda v: v > 5}, 5), ({"least": 3}, "x")]:
        with pytest.raises(QueryError) as e:
            param("x", **rules).resolve({"x": value}, None)
        assert e.value.code == ErrorCode.PARAM_VALIDATION_FAILED
    assert ctx("u").resolve({"u": 1}, {"u": 2}) == 2 and ctx("u").resolve({"u": 1}, {}) is None
    assert text(sql("{x}", x=ctx("u")), {"u": 1})[1] == {"p0": None} and text(sql("{x}", x=param("u")), {"u": CONTEXT_VALUE})[1] == {"p0": None}
    assert inputs().user.id() == Param("user.id") and merge({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert text(sql("x in ({p})", p=param("ids")), {"ids": []})[0] == "x in (NULL)"
    refused(sql("{p}", p=param("x")), {"x": {"an": "object"}})


def test_rows_to_write():
    rows = [{"status": "F", "orderKey": 1}, {"orderKey": 2, "status": "O"}]
    assert text(sql("insert into {t} {i}", t=O, i=insert(O)), {"rows": rows})[0] == "insert into `orders` (`o_orderkey`, `o_orderstatus`) VALUES (:p0, :p1), (:p2, :p3)"
    assert text(sql("{c}|{v}", c=insert_columns(O), v=insert_values(O)), {"rows": rows[:1]})[0] == "(`o_orderkey`, `o_orderstatus`)|(:p0, :p1)"
    assert text(sql("{i}", i=insert(O)), {"rows": [{"status": DEFAULT}]})[0] == "(`o_orderstatus`) VALUES (DEFAULT)"
    for bad in ([], [{"status": "F"}, {"orderKey": 1}], [{"nope": 1}], [{"status": "Z"}], 3):
        refused(sql("{i}", i=insert(O)), {"rows": bad})
    assert text(sql("update {t} set {s}", t=O, s=set_values(O)), {"set": {"status": "F"}})[0] == "update `orders` set `o_orderstatus` = :p0"
    for bad in ({}, None, {"nope": 1}, {"total": {"a": 1}}):
        refused(sql("{s}", s=set_values(O)), {"set": bad})
    merged = text(sql("{u}", u=upsert(O, ["orderKey"])), {"rows": rows})[0]
    assert "UPDATE SET target.`o_orderstatus` = source.`o_orderstatus`" in merged and "MATCHED THEN INSERT (`o_orderkey`, `o_orderstatus`)" in merged
    assert "UPDATE" not in text(sql("{u}", u=upsert(O, ["orderKey"])), {"rows": [{"orderKey": 1}]})[0]
    assert text(sql("{e}", e=excluded(O.c.status)))[0] == "source.`o_orderstatus`"
    refused(sql("{i}", i=insert(OrderSummary)), {"rows": [{"custKey": 1}]})


def test_scopes_and_forms():
    inner = sql("select {r} from {t}", r=row(O.c.orderKey), t=O).named("x")
    assert text(sql("with {a} select {k} from {b}", a=inner, k=inner.c.orderKey, b=inner))[0] == "with `x` AS (select `o_1`.`o_orderkey` AS `orderKey` from `orders` AS `o_1`) select `x`.`orderKey` AS `orderKey` from `x`"
    assert text(sql("select * from {b}", b=inner))[0].endswith("AS `x`")
    assert "AS `x`" not in text(sql("select 1 where 1 in {b}", b=inner))[0]
    refused(sql("select {o} from {t}", o=C.out.custKey, t=O))
    refused(sql("{x}", x=inner.render("odd")))
    refused(sql("{missing}"))
    assert text(sql("select count({a}) from {t}", a=O.all, t=O))[0].startswith("select count(*)")
    with pytest.raises(QueryError):
        inner.c.nope  # noqa: B018
    with pytest.raises(QueryError):
        C.c.nope  # noqa: B018
    with pytest.raises(QueryError):
        row(json_many(inner))
    refused(sql("select 1 from {t} where {j}", t=C, j=json_many(inner).as_("j")))


def test_tags_hash_and_custom_parts():
    a = sql("select 1 from {t}", t=O).authorize("orders")
    b = sql("select * from {a} where x = {p} and y = {c}", a=a, p=param("p"), c=ctx("c")).authorize("all")
    assert b.all_tags == ("all", "orders") and [p.name for p in b.parameters()] == ["p", "c"]
    again = sql("select * from {a} where x = {p} and y = {c}", a=sql("select 1 from {t}", t=O), p=param("p"), c=ctx("c"))
    assert again.hash == b.hash and sql("select 2").hash != sql("select 1").hash
    assert sql("{x}", x=filter_by(O)).hash != sql("{x}", x=filter_by(O, "other")).hash

    class Shout(Part):
        def write(self, w):
            return "'HEY'"

    assert text(sql("select {x}", x=Shout()))[0] == "select 'HEY'"
    assert text(sql("select {{x}} {q} {n}", q=quoted("a b"), n=col("c")))[0] == "select {x} `a b` `c`"
    assert text(sql("select 1").named("note"))[0] == "/* note */ select 1"


def test_manifest_round_trips():
    inner = sql("select {r} from {t}", r=row(O.c.orderKey, val("1 + {x}", x=param("x", 3, least=1)).as_("n")), t=O).named("inner_one").authorize("t")
    q = sql("select {k}, {p} from {i} where {f} and {w} {o} {g}", k=inner.c.orderKey, p=inner.c.n, i=inner, f=filter_by(O, omit=["total"]), w=when("a", raw("1=1"), raw("2=2")), o=order_by(O), g=paginate())
    back = manifest.loads(manifest.dumps({"q": q}))["q"]
    given = {"filter_by": {"status": "F"}, "x": 9, "a": 1, "order_by": {"total": "desc"}, "limit": 2}
    assert back.hash == q.hash and text(back, given) == text(q, given) and back.all_tags == ("t",)
    raw_text = manifest.dumps({"q": q})
    for bad in (raw_text.replace("1=1", "1=3"), "{}", raw_text.replace('"version": 1', '"version": 9')):
        with pytest.raises(QueryError):
            manifest.loads(bad)


def test_unused_import_guard():
    assert I.reference_to(O).columns == ("orderKey",)
