"""The star schema at hand, declared as tables with camel-case keys."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.tables import ColumnInfo, Database, ForeignKey, Table

_TYPES = {"i": T.IntegerType(), "l": T.LongType(), "s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampNTZType()}


def _table(name: str, prefix: str, columns: str, pk: tuple = (), fk: tuple = (), **enums: tuple) -> Table:
    out = {}
    for entry in columns.split():
        key, physical, kind = entry.split(":")
        out[key] = ColumnInfo(prefix + physical, _TYPES[kind], enum=enums.get(key, ()))
    return Table(name, out, pk, fk)


Region = _table("region", "r_", "regionKey:regionkey:i name:name:s", ("regionKey",))
Nation = _table("nation", "n_", "nationKey:nationkey:i name:name:s regionKey:regionkey:i", ("nationKey",), (ForeignKey(("regionKey",), "region", ("regionKey",)),))
Customer = _table("customer", "c_", "custKey:custkey:l name:name:s nationKey:nationkey:i balance:acctbal:d segment:mktsegment:s", ("custKey",), (ForeignKey(("nationKey",), "nation", ("nationKey",)),))
Supplier = _table("supplier", "s_", "suppKey:suppkey:l name:name:s nationKey:nationkey:i balance:acctbal:d", ("suppKey",))
Product = _table("part", "p_", "partKey:partkey:l name:name:s brand:brand:s type:type:s size:size:i price:retailprice:d", ("partKey",))
Order = _table("orders", "o_", "orderKey:orderkey:l custKey:custkey:l status:orderstatus:s total:totalprice:d orderDate:orderdate:t priority:orderpriority:s", ("orderKey",), (ForeignKey(("custKey",), "customer", ("custKey",)),), status=("F", "O", "P"))
Item = _table("lineitem", "l_", "orderKey:orderkey:l partKey:partkey:l suppKey:suppkey:l line:linenumber:i quantity:quantity:d price:extendedprice:d discount:discount:d tax:tax:d returnFlag:returnflag:s lineStatus:linestatus:s shipDate:shipdate:t", (), (ForeignKey(("orderKey",), "orders", ("orderKey",)), ForeignKey(("partKey",), "part", ("partKey",))))
Event = Table("events", {"eventId": ColumnInfo("event_id", T.LongType()), "ts": ColumnInfo("ts", T.TimestampNTZType()), "userId": ColumnInfo("user_id", T.LongType()), "type": ColumnInfo("event_type"), "value": ColumnInfo("value", T.DoubleType()), "props": ColumnInfo("props")}, ("eventId",))
ALL = (Region, Nation, Customer, Supplier, Product, Order, Item, Event)

#: Select-only: customers with their number of orders and latest order.
OrderSummary = Table("order_summary", {"custKey": ColumnInfo("custKey", T.LongType()), "name": ColumnInfo("name"), "orderCount": ColumnInfo("orderCount", T.LongType()), "latestAt": ColumnInfo("latestAt", T.TimestampNTZType())}, crud=frozenset({"select"}))


def database(spark: SparkSession, sf_dir: str) -> Database:
    # with declared schemas, no job reads the files' footers beforehand
    db = Database(spark, {t.name: spark.read.schema(t.struct_type()).parquet(f"{sf_dir}/{t.name}.parquet") for t in ALL})
    counts = db.frame("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("latest")).withColumnRenamed("o_custkey", "k")
    joined = db.frame("customer").join(counts, db.frame("customer")["c_custkey"] == counts["k"], "left")
    db.bind("order_summary", joined.selectExpr("c_custkey AS custKey", "c_name AS name", "coalesce(n, 0L) AS orderCount", "latest AS latestAt"))
    return db
