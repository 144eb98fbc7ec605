"""Execution, pipeline, registry, store, streams and command line."""

import io
import json
import threading
import time
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import cli
from quern.errors import ErrorCode, QueryError
from quern.functions import scalars
from quern.operators.crud import Include, select
from quern.operators.includes import include_many, include_one, json_many, json_one
from quern.operators.projection import row
from quern.operators.mutations import DEFAULT
from quern.operators.recursion import iterate
from quern.plans import manifest
from quern.plans.execution import Retry, Run, meta_of
from quern.plans.params import CONTEXT_VALUE, ctx, param
from quern.plans.pipeline import AuditLog, Authorizer, Execution, Pipeline, Plugin, RateLimiter, Tracing
from quern.plans.query import sql
from quern.plans.registry import LocalClient, QueryRegistry, Request
from quern.plans.tables import Customer, Order, database
from quern.sources.formats import as_text, read, write
from quern.sources.store import Store
from quern.sources.tables import ColumnInfo, Database, Table
from quern.streaming import files


@pytest.fixture(scope="module")
def db(spark, sf_dir):
    return database(spark, sf_dir)


def code_of(call):
    with pytest.raises(QueryError) as e:
        call()
    return e.value.code


def test_modes(db):
    q = sql("select {k} as k from {t} where {k} < {n} order by k", k=Order.c.orderKey, t=Order, n=param("n"))
    assert len(Run(q, db, {"n": 3}).all()) == 3 and Run(q, db, {"n": 1}).one() == {"k": 0}
    assert Run(q, db, {"n": 0}).first() is None and Run(q, db, {"n": 5}).any() == {"k": 0}
    assert code_of(lambda: Run(q, db, {"n": 0}).one()) == code_of(lambda: Run(q, db, {"n": 2}).one()) == ErrorCode.NOT_ONE_ROW
    rows = Run(q, db, {"n": 1}).all()
    assert meta_of(rows).params == {"n": 1} and "select" in meta_of(rows).sql
    assert code_of(lambda: Run(sql("select nope from {t}", t=Order), db).all()) == ErrorCode.QUERY_FAILED


def test_timeout_cancels(db):
    slow = sql("select sum(a.id * b.id % 7) from range(3000000) a join range(30000) b on a.id % 3 = b.id % 3")
    began = time.monotonic()
    assert code_of(lambda: Run(slow, db, timeout=1.5).all()) == ErrorCode.QUERY_TIMEOUT
    assert time.monotonic() - began < 60


def test_retry():
    seen = []

    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise QueryError(ErrorCode.QUERY_FAILED, "x", retryable=True)
        return "ok"

    assert Retry(3, lambda n: 0.0).run(flaky) == "ok" and len(seen) == 3
    seen.clear()
    assert code_of(lambda: Retry(2).run(flaky)) == ErrorCode.QUERY_FAILED
    with pytest.raises(ValueError):
        Retry(5).run(lambda: (_ for _ in ()).throw(ValueError()))


def run_of(tags=(), context=None):
    return Execution("q", "h", tuple(tags), {}, context or {})


def test_pipeline_order_and_end():
    log = []

    class Spy(Plugin):
        def init(self, e):
            log.append("init")

        def check(self, e):
            log.append("check")

        def before(self, e):
            log.append("before")

        def end(self, e):
            log.append(f"end {e.attempts} {e.error is None}")

    p = Pipeline([Spy()], retry=Retry(2, should_retry=lambda e: True))
    calls = iter([RuntimeError("once"), "fine"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert p.execute(run_of(), call) == "fine" and log == ["init", "check", "before", "before", "end 2 True"]
    log.clear()
    with pytest.raises(ZeroDivisionError):
        Pipeline([Spy()]).execute(run_of(), lambda: 1 / 0)
    assert log[-1] == "end 1 False"


def test_authorization():
    allow = Authorizer(lambda tag, c: tag in c.get("may", ()))
    assert Pipeline().execute(run_of(), lambda: 1) == 1
    assert code_of(lambda: Pipeline().execute(run_of(["a"]), lambda: 1)) == ErrorCode.UNAUTHORIZED
    assert Pipeline([allow]).execute(run_of(["a"], {"may": ["a"]}), lambda: 1) == 1
    assert code_of(lambda: Pipeline([allow]).execute(run_of(["a"], {"may": ["b"]}), lambda: 1)) == ErrorCode.UNAUTHORIZED
    tagged = sql("select 1").authorize("a")
    assert code_of(lambda: Pipeline().check_authorization([tagged])) == ErrorCode.UNAUTHORIZED
    Pipeline([allow]).check_authorization([tagged])


def test_limits_and_audit():
    limiter, records = RateLimiter(per_context=1), []
    p = Pipeline([limiter, AuditLog(records.append, lambda c: c["user"])])
    inside = lambda: code_of(lambda: p.execute(run_of(context={"user": "u"}), lambda: 1))
    assert p.execute(run_of(context={"user": "u"}), inside) == ErrorCode.RATE_LIMITED
    assert p.execute(run_of(context={"user": "u"}), lambda: 5) == 5 and limiter.contexts["u"].running == 0
    assert [r["ok"] for r in records] == [False, True, True] and records[0]["error"] == "RATE_LIMITED" and records[0]["context"] == "u"
    quiet: list = []
    Pipeline([AuditLog(quiet.append)]).execute(run_of(context={"secret": 1}), lambda: 1)
    assert "context" not in quiet[0]
    assert code_of(lambda: Pipeline([RateLimiter(limit=lambda e, q, c: False)]).execute(run_of(), lambda: 1)) == ErrorCode.RATE_LIMITED
    old = RateLimiter(ttl=-1.0)
    Pipeline([old]).execute(run_of(context={"user": "a"}), lambda: 1)
    Pipeline([old]).execute(run_of(context={"user": "b"}), lambda: 1)
    assert "a" not in old.contexts
    full = Pipeline(max_concurrent=1)
    assert full.execute(run_of(), lambda: code_of(lambda: full.execute(run_of(), lambda: 1))) == ErrorCode.RATE_LIMITED


def test_tracing():
    class Span:
        def __init__(self):
            self.seen = {}

        def set_attribute(self, k, v):
            self.seen[k] = v

        def record_exception(self, e):
            self.seen["error"] = e

        def end(self):
            self.seen["ended"] = True

    class Tracer:
        def start_span(self, name):
            self.span = Span()
            return self.span

    t = Tracer()
    with pytest.raises(ZeroDivisionError):
        Pipeline([Tracing(t)]).execute(run_of(), lambda: 1 / 0)
    assert t.span.seen["ended"] and t.span.seen["query.hash"] == "h"


def test_registry(db):
    q = sql("select {k} as k from {t} where {k} = {u}", k=Customer.c.custKey, t=Customer, u=ctx("user.id")).named("me")
    registry = QueryRegistry(lambda: db)
    registry.register(q)
    registry.check()
    client = LocalClient(lambda text: registry.execute(text, {"user.id": 3}))
    assert client.run(q, {"user": CONTEXT_VALUE, "other": 1}, "one") == {"k": 3}
    assert code_of(lambda: registry.execute(Request("nope"))) == code_of(lambda: registry.execute("{}")) == ErrorCode.QUERY_NOT_FOUND
    assert code_of(lambda: registry.execute(Request(q.hash, mode="odd"))) == ErrorCode.QUERY_NOT_FOUND


def test_registry_over_http(db):
    from quern.plans.http import http_transport, serve

    q = sql("select {k} as k from {t} where {k} = {u}", k=Customer.c.custKey, t=Customer, u=ctx("user"))
    broken = sql("select secret_column from {t}", t=Customer)
    registry = QueryRegistry(lambda: db)
    registry.register(q, broken)
    server = serve(registry, lambda headers: {"user": int(headers.get("X-User", -1))})
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/"
        client = LocalClient(http_transport(url, {"X-User": "4"}))
        assert client.run(q, mode="one") == {"k": 4} and client.run(q) == [{"k": 4}]
        assert LocalClient(http_transport(url)).run(q, mode="first") is None
        assert code_of(lambda: client.run(sql("select 1"))) == ErrorCode.QUERY_NOT_FOUND
        with pytest.raises(QueryError) as e:
            client.run(broken)
        assert e.value.code == ErrorCode.QUERY_FAILED and "secret" not in str(e.value)
    finally:
        server.shutdown()
        server.server_close()


Account = Table("account", {"id": ColumnInfo("account_id", T.LongType(), False), "name": ColumnInfo("name"), "status": ColumnInfo("status", default="new", enum=("new", "old")), "tags": ColumnInfo("tags", T.ArrayType(T.StringType()))}, ("id",))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create(Account)
    s.insert(Account, [{"id": 1, "name": "a"}, {"id": 2, "name": None}])
    s.insert(Account, [{"id": 3, "name": "c", "status": DEFAULT, "tags": ["x", "y"]}])
    return s


def rows(store, version=None):
    return sorted((r.account_id, r.name, r.status) for r in store.read(Account, version).collect())


def test_store_changes(store):
    assert rows(store) == [(1, "a", "new"), (2, None, "new"), (3, "c", "new")]
    before = store.files()["account"]
    changed = store.update(Account, {"status": "old"}, "name = 'c'")
    assert [r.asDict() for r in changed.collect()] == [{"id": 3, "name": "c", "status": "old", "tags": ["x", "y"]}]
    assert set(before) & set(store.files()["account"]), "files without affected rows stay"
    assert sorted(r.id for r in store.delete(Account, "name <> 'a'").collect()) == [3] and [r[0] for r in rows(store)] == [1, 2]
    assert code_of(lambda: store.delete(Account)) == ErrorCode.BUILD_FAILED
    back = store.upsert(Account, [{"id": 1, "name": "A"}, {"id": 9, "name": "z"}], ["id"])
    assert sorted((r.id, r.name) for r in back.collect()) == [(1, "A"), (9, "z")] and rows(store) == [(1, "A", "new"), (2, None, "new"), (9, "z", "new")]
    assert store.upsert(Account, [{"id": 1}], ["id"]).count() == 0 and len(rows(store)) == 3
    store.upsert(Account, [{"id": 1, "name": "q"}], ["id"], {"name": "concat(old.name, new.name)"})
    assert rows(store)[0][1] == "Aq"
    assert store.update(Account, {"name": "n"}, "false").count() == 0
    assert store.delete(Account, force=True).count() == 3 and rows(store) == []
    assert len(rows(store, 3)) == 3, "old versions can be read"


def test_store_refuses(store):
    for call in (
        lambda: store.insert(Account, []),
        lambda: store.insert(Account, [{"id": None, "name": "x"}]),
        lambda: store.insert(Account, [{"id": 1, "status": "odd"}]),
        lambda: store.update(Account, {"id": None}, "name = 'a'"),
        lambda: store.upsert(Account, [{"name": "x"}], ["id"]),
        lambda: store.upsert(Account, [{"id": 1, "name": "x"}, {"id": 1, "name": "y"}], ["id"]),
        lambda: store.create(Account),
    ):
        assert code_of(call) == ErrorCode.BUILD_FAILED


def test_transactions(store):
    with pytest.raises(RuntimeError):
        with store.transaction() as t:
            t.delete(Account, force=True)
            raise RuntimeError
    assert len(rows(store)) == 3
    with store.transaction() as t:
        t.delete(Account, "account_id = 1")
        with pytest.raises(RuntimeError):
            with t.savepoint():
                t.delete(Account, force=True)
                raise RuntimeError
        assert t.read(Account).count() == 2
    assert len(rows(store)) == 2

    def clash():
        with store.transaction() as t:
            t.insert(Account, {"id": 7, "name": "x"})
            store.insert(Account, {"id": 8, "name": "y"})

    assert code_of(clash) == ErrorCode.CONFLICT and [r[0] for r in rows(store)] == [2, 3, 8]
    with store.transaction(read_only=True) as t:
        assert code_of(lambda: t.insert(Account, {"id": 7, "name": "x"})) == ErrorCode.BUILD_FAILED


def test_page_before_includes(db):
    """Order, page and projection of the run count with includes too, and only the page's children are gathered."""
    many = select(Customer, include_many={"orders": Include(Order, {"custKey": "custKey"}, ("orderKey",))})
    whole = {r.custKey: r.orders for r in many.dataframe(db).collect()}
    for given in ({"order_by": {"custKey": "desc"}, "limit": 3, "offset": 2, "select": ["name"]}, {"order_by": {"custKey": "desc"}, "limit": 3, "offset": 2}):
        page = many.dataframe(db, given)
        assert page.columns == (["name", "orders"] if "select" in given else [*Customer.columns, "orders"])
        assert "LeftSemi" in page._jdf.queryExecution().optimizedPlan().toString()
        keys = sorted(whole, reverse=True)[2:5]
        assert [r.orders for r in page.collect()] == [whole[k] for k in keys]
    assert code_of(lambda: many.dataframe(db, {"select": ["nothing"]})) == code_of(lambda: select(Customer).dataframe(db, {"select": ["nothing"]}))


def test_include_edges(spark):
    parent = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    child = spark.createDataFrame([(1, "b", 1), (1, "a", None), (None, "n", 3)], "fk long, name string, rank int")
    many = {r.id: r.kids for r in include_many(parent, child, "kids", {"fk": "id"}, ["name", "rank"], (("rank", False),)).collect()}
    assert [k.name for k in many[1]] == ["b", "a"] and many[2] == [] and many[None] == []
    down = {r.id: r.kids for r in include_many(parent, child, "kids", {"fk": "id"}, ["name"], (("rank", True),)).collect()}
    assert [k.name for k in down[1]] == ["a", "b"], "nulls are greatest"
    for order, want in (((), "a"), ((("rank", False),), "b"), ((("rank", True),), "a"), ((("name", False),), "a")):
        one = {r.id: r.kid for r in include_one(parent, child, "kid", {"fk": "id"}, ["name"], order).collect()}
        assert one[1].name == want and one[2] is None


def test_includes_in_templates_order_ties(spark, db):
    own = sql("select {r} from {o} where {a} = {b}", r=row(Order.c.orderKey, Order.c.status), o=Order, a=Order.c.custKey, b=Customer.out.custKey).named("own")
    orders = db.frame("orders").where("o_custkey < 20").orderBy(F.desc("o_orderkey")).coalesce(1).localCheckpoint()
    frames = Database(spark, {"customer": db.frame("customer"), "orders": orders})
    order = (("status", True),)
    q = sql("select {k}, {m}, {f} from {c}", k=Customer.c.custKey, m=json_many(own, order=order).as_("many"), f=json_one(own, order=order).as_("first"), c=Customer)
    found = [r for r in q.dataframe(frames).where("custKey < 20").collect() if r.many]
    assert found and any(len({x.status for x in r.many}) < len(r.many) for r in found)
    for r in found:
        assert [x.orderKey for x in r.many] == [x.orderKey for x in sorted(sorted(r.many, key=lambda x: x.orderKey), key=lambda x: x.status, reverse=True)]
        assert r.first == r.many[0]


def test_select_rules(db):
    assert code_of(lambda: select(Order, limit=3)) == ErrorCode.BUILD_FAILED
    df = select(Order, order_by={"orderKey": "desc"}).dataframe(db, {"order_by": {"orderKey": "asc"}, "limit": 1})
    top = db.frame("orders").agg(F.max("o_orderkey")).first()[0]
    assert df.first().orderKey == top, "the static order counts"
    plan = select(Order, select=("orderKey",)).dataframe(db, {"filter_by": {"status": "F"}})._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    nested = select(Customer, include_many={"orders": Include(Order, {"custKey": "custKey"})}).dataframe(db)
    assert nested.schema["orders"].dataType.elementType.names == list(Order.columns)


def test_recursion_by_loop(spark):
    start = spark.createDataFrame([(0,)], "id long")
    deep = iterate(start, lambda level: level.where("id < 130").select((F.col("id") + 1).alias("id")))
    assert deep.count() == 131
    cycle = iterate(start, lambda level: level.select(((F.col("id") + 1) % 3).alias("id")), distinct=True)
    assert sorted(r.id for r in cycle.collect()) == [0, 1, 2]
    assert code_of(lambda: iterate(start, lambda level: level, max_levels=2)) == ErrorCode.QUERY_FAILED


def test_tables_from_elsewhere(spark, db):
    @dataclass
    class Person:
        id: int
        name: str | None = field(default=None, metadata={"name": "full_name"})
        tags: list[str] = field(default_factory=list)

    t = Table.from_dataclass(Person, pk=("id",))
    assert t.columns["name"].name == "full_name" and t.columns["name"].nullable and not t.columns["id"].nullable
    assert t.columns["tags"].type == T.ArrayType(T.StringType())
    view = Table.from_catalog(spark, db.view("orders"))
    assert view.crud == frozenset({"select"}) and "o_orderkey" in view.columns
    assert Table.from_dataframe("x", db.frame("nation")).columns["n_name"].type == T.StringType()
    with pytest.raises(QueryError):
        db.frame("nope")


def test_formats(spark, tmp_path):
    data = [{"a": 1, "b": None}, {"a": 22, "b": "x,y"}]
    assert as_text(data, ["a", "b"], "csv") == 'a,b\n1,\n22,"x,y"\n' and json.loads(as_text(data, ["a", "b"], "json")) == data
    assert as_text(data, ["a", "b"]).splitlines()[0] == "a  | b"
    for kind in ("json", "csv", "orc", "parquet"):
        write(spark.createDataFrame([(1, "x")], "a int, b string"), kind, f"{tmp_path}/{kind}", **({"header": True} if kind == "csv" else {}))
        assert read(spark, kind, f"{tmp_path}/{kind}", **({"header": True} if kind == "csv" else {})).first().b == "x"
    assert code_of(lambda: as_text(data, ["a"], "odd")) == code_of(lambda: read(spark, "odd", "x")) == ErrorCode.BUILD_FAILED


def test_jdbc_needs_bounds(spark):
    from quern.sources.formats import read_jdbc

    assert code_of(lambda: read_jdbc(spark, "jdbc:x", "t", parts=4)) == ErrorCode.BUILD_FAILED


def test_scalars(spark):
    row = spark.range(1).select(scalars.json_object(a=F.lit(1), b=F.lit("x")).alias("j"), scalars.to_number(F.lit("1.5")).alias("n"), scalars.to_number(F.lit("z")).alias("z"), scalars.case([(F.lit(False), 1), (F.lit(True), 2)], 3).alias("c")).first()
    assert row.j == '{"a":1,"b":"x"}' and float(row.n) == 1.5 and row.z is None and row.c == 2


def test_stream(spark, tmp_path, sf_dir):
    from quern.plans.tables import Event

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = files.filtered(files.read_stream(spark, Event, f"{tmp_path}/in", 1), Event, {"filter_by": {"value": [">", 0.0]}, "select": ["eventId", "type"]})
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    assert q.awaitTermination(120)
    assert spark.table("seen").count() == spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0").count()


def test_command_line(spark, sf_dir, tmp_path, capsys):
    q = sql("select {k} as k from {t} where {k} < {n} order by k", k=Order.c.orderKey, t=Order, n=param("n"))
    (tmp_path / "m.json").write_text(manifest.dumps({"few": q, "add": sql("insert into {t} values (1)", t=Order)}))
    out = io.StringIO()
    assert cli.main(["run", f"{tmp_path}/m.json", "few", "--dir", sf_dir, "--params", '{"n": 3}', "--format", "csv", "--limit", "2"], out) == 0
    assert out.getvalue().strip() == "k\n0\n1"
    out = io.StringIO()
    assert cli.main(["run", f"{tmp_path}/m.json", "few", "--params", '{"n": 3}', "--dry-run"], out) == 0 and ":p0" in out.getvalue()
    assert cli.main(["run", f"{tmp_path}/m.json", "add"], io.StringIO()) == 2
    assert cli.is_mutation("/* x */ delete from t") and not cli.is_mutation("select 'delete'")
    source = cli.codegen(spark, sf_dir)
    space: dict = {}
    exec(source, space)
    assert space["Orders"].columns["o_orderkey"].type == T.LongType()


def test_threads_share_a_registry(db):
    q = sql("select count(*) as n from {t}", t=Customer)
    registry = QueryRegistry(lambda: db)
    registry.register(q)
    found: list = []
    threads = [threading.Thread(target=lambda: found.append(registry.execute(Request(q.hash, mode="one")))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len({f["n"] for f in found}) == 1 and len(found) == 3


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "quern"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quern/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cte' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert isinstance(Database, type)
