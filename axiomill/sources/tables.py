"""Assertion views over ordinary tables: classes, roles and data properties of the star-schema tables as fact frames.

Individuals are ``urn:x/<table>/<key>``; doubles become decimals with two places before they are lexical forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.expressions import XSD
from ..plans.program import literal_column

V = "urn:v#"

#: class: (table, key, condition)
CLASSES = {
    "Region": ("region", "r_regionkey", None), "Nation": ("nation", "n_nationkey", None), "Customer": ("customer", "c_custkey", None), "Supplier": ("supplier", "s_suppkey", None),
    "Part": ("part", "p_partkey", None), "Order": ("orders", "o_orderkey", None), "Event": ("events", "event_id", None),
    **{f"{s.title()}Customer": ("customer", "c_custkey", f"c_mktsegment = '{s}'") for s in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")},
    **{f"{t.title()}Part": ("part", "p_partkey", f"p_type = '{t}'") for t in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")},
    **{f"{n}Order": ("orders", "o_orderkey", f"o_orderpriority = '{p}'") for n, p in (("Urgent", "1-URGENT"), ("High", "2-HIGH"), ("Low", "5-LOW"))},
}
#: role: (table, subject table, subject key, object table, object key)
ROLES = {
    "inRegion": ("nation", "nation", "n_nationkey", "region", "n_regionkey"), "cNation": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "sNation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), "placedBy": ("orders", "orders", "o_orderkey", "customer", "o_custkey"),
    "hasItemPart": ("lineitem", "orders", "l_orderkey", "part", "l_partkey"), "hasItemSupplier": ("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey"),
    "supplies": ("lineitem", "supplier", "l_suppkey", "part", "l_partkey"), "parent": ("customer", "customer", "c_custkey", "customer", "c_custkey div 2"),
    "succ": ("nation", "nation", "n_nationkey", "nation", "(n_nationkey + 1) % 25"), "nextPart": ("part", "part", "p_partkey", "part", "p_partkey + 1"),
}
#: data property: (table, subject table, key, value, datatype)
DATAS = {
    "balance": ("customer", "customer", "c_custkey", "cast(c_acctbal as decimal(18,2))", "decimal"), "price": ("part", "part", "p_partkey", "cast(p_retailprice as decimal(18,2))", "decimal"),
    "size": ("part", "part", "p_partkey", "p_size", "integer"), "brand": ("part", "part", "p_partkey", "p_brand", "string"), "segment": ("customer", "customer", "c_custkey", "c_mktsegment", "string"),
}


def node(table: str, key: str):
    return F.concat(F.lit(f"urn:x/{table}/"), F.expr(key).cast("string"))


def facts(spark: SparkSession, sf_dir: str, *names: str) -> dict[tuple, DataFrame]:
    """The named assertion views, as a program takes them."""
    out: dict[tuple, DataFrame] = {}
    read = {}

    def table(t: str) -> DataFrame:
        if t not in read:
            read[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return read[t]

    for n in names:
        if n in CLASSES:
            t, key, cond = CLASSES[n]
            df = table(t).where(cond) if cond else table(t)
            out[("c", V + n)] = df.select(node(t, key).alias("x"))
        elif n == "nextTurn":
            t = table("conversations").select("conv_id", "turn").distinct()
            after = t.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"))
            pairs = t.join(after, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left_semi")
            out[("r", V + n)] = pairs.select(F.expr("concat('urn:x/turn/', conv_id, '/', turn)").alias("s"), F.expr("concat('urn:x/turn/', conv_id, '/', turn + 1)").alias("o"))
        elif n in ROLES:
            t, st, sk, ot, ok = ROLES[n]
            df = table(t).where("c_custkey > 1") if n == "parent" else table(t)
            out[("r", V + n)] = df.select(node(st, sk).alias("s"), node(ot, ok).alias("o"))
        elif n in DATAS:
            t, st, key, value, dt = DATAS[n]
            out[("d", V + n)] = table(t).select(node(st, key).alias("s"), literal_column(F.expr(value), XSD + dt).alias("v"))
        else:
            raise KeyError(n)
    return out
