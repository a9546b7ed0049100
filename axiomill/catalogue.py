"""Reasoning queries over the star-schema tables, each with the SQL that states its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import expressions as E
from .model.expressions import XSD, And, Literal, Named, Or, Restricted, Role, Some, axiom
from .plans.conjunctive import answer
from .plans.horn import compile_horn
from .plans.program import Program, literal_column
from .sources.tables import V, facts, node

QUERIES: dict = {}
SQL: dict[str, str] = {}


def C(name: str) -> Named:
    return Named(V + name)


def R(name: str) -> Role:
    return Role(V + name)


def sub(a, b):
    return axiom("SubClassOf", a if not isinstance(a, str) else C(a), b if not isinstance(b, str) else C(b))


def program(spark, sf_dir, axioms, names, extra=None) -> Program:
    return Program(spark, compile_horn(axioms), facts(spark, sf_dir, *names) | (extra(spark, sf_dir) if extra else {}))


def atom(text: str) -> dict:
    """``Customer(?x)`` or ``placedBy(?o, ?c)``; a data property's name ends in ``!``, a datatype's begins with ``^``."""
    name, _, args = text.rstrip(")").partition("(")
    a = [x.strip() for x in args.split(",")]
    if name.startswith("^"):
        return {"datatype": XSD + name[1:], "arg": a[0]}
    if name == "differentFrom":
        return {"different_from": a}
    if len(a) == 1:
        return {"class": E.THING.iri if name == "Thing" else V + name, "arg": a[0]}
    if name.endswith("!"):
        return {"data_property": V + name[:-1], "subject": a[0], "value": a[1]}
    return {"object_property": V + name, "subject": a[0], "object": a[1]}


def conjunctive(name: str, axioms: list, names: list[str], atoms: list[str], sql: str, select: list[str] | None = None, extra=None) -> None:
    def run(spark, sf_dir) -> DataFrame:
        return answer(program(spark, sf_dir, axioms, names, extra), {"where": [atom(a) for a in atoms], "select": select}, check=False)

    QUERIES[name], SQL[name] = run, sql


def clash(name: str, axioms: list, names: list[str], sql: str, extra=None) -> None:
    QUERIES[name], SQL[name] = (lambda spark, sf_dir: program(spark, sf_dir, axioms, names, extra).clashes()), sql


def other(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


conjunctive("q01_class_scan", [], ["Customer"], ["Customer(?x)"], "SELECT DISTINCT 'urn:x/customer/' || c_custkey AS x FROM customer")
conjunctive(
    "q02_class_hierarchy", [sub("BuildingCustomer", "Customer"), sub("Customer", "Party"), sub("Supplier", "Party")], ["BuildingCustomer", "Supplier"], ["Party(?x)"],
    "SELECT 'urn:x/customer/' || c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'urn:x/supplier/' || s_suppkey FROM supplier",
)
conjunctive(
    "q03_deep_hierarchy", [sub("SmallPart", "CompactPart"), sub("CompactPart", "Part"), sub("Part", "Item"), sub("PromoPart", "Part")], ["SmallPart", "PromoPart"], ["Item(?x)"],
    "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE p_type IN ('SMALL', 'PROMO')",
)
conjunctive(
    "q04_sub_property", [axiom("SubObjectPropertyOf", V + "cNation", V + "inNation"), axiom("SubObjectPropertyOf", V + "sNation", V + "inNation")], ["cNation", "sNation"], ["inNation(?x, ?n)"],
    "SELECT 'urn:x/customer/' || c_custkey AS x, 'urn:x/nation/' || c_nationkey AS n FROM customer UNION SELECT 'urn:x/supplier/' || s_suppkey, 'urn:x/nation/' || s_nationkey FROM supplier",
)
conjunctive(
    "q05_inverse", [axiom("InverseObjectProperties", V + "places", V + "placedBy")], ["placedBy"], ["places(?c, ?o)"],
    "SELECT DISTINCT 'urn:x/customer/' || o_custkey AS c, 'urn:x/orders/' || o_orderkey AS o FROM orders",
)
conjunctive(
    "q06_domain_range", [axiom("ObjectPropertyDomain", V + "placedBy", V + "Placed"), axiom("ObjectPropertyRange", V + "placedBy", V + "Buyer"), sub("Buyer", "Active"), sub("Placed", "Active")], ["placedBy"], ["Active(?x)"],
    "SELECT 'urn:x/customer/' || o_custkey AS x FROM orders UNION SELECT 'urn:x/orders/' || o_orderkey FROM orders",
)
conjunctive(
    "q07_symmetric", [axiom("SymmetricObjectProperty", V + "nextPart")], ["nextPart"], ["nextPart(?a, ?b)"],
    "SELECT 'urn:x/part/' || p_partkey AS a, 'urn:x/part/' || (p_partkey + 1) AS b FROM part UNION SELECT 'urn:x/part/' || (p_partkey + 1), 'urn:x/part/' || p_partkey FROM part",
)
conjunctive(
    "q08_two_joins", [], ["Customer", "cNation", "inRegion"], ["Customer(?c)", "cNation(?c, ?n)", "inRegion(?n, ?r)"],
    "SELECT DISTINCT 'urn:x/customer/' || c_custkey AS c, 'urn:x/nation/' || n_nationkey AS n, 'urn:x/region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
conjunctive(
    "q09_five_joins", [], ["placedBy", "cNation", "inRegion", "hasItemPart", "SmallPart"],
    ["placedBy(?o, ?c)", "cNation(?c, ?n)", "inRegion(?n, urn:x/region/2)", "hasItemPart(?o, ?p)", "SmallPart(?p)"],
    "SELECT DISTINCT 'urn:x/customer/' || c_custkey AS c, 'urn:x/part/' || p_partkey AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE n_regionkey = 2 AND p_type = 'SMALL'",
    select=["?c", "?p"],
)
conjunctive(
    "q10_chain", [axiom("SubObjectPropertyChain", [V + "cNation", V + "inRegion"], V + "locatedIn")], ["cNation", "inRegion"], ["locatedIn(?c, ?r)"],
    "SELECT DISTINCT 'urn:x/customer/' || c_custkey AS c, 'urn:x/region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
conjunctive(
    "q11_transitive_path", [axiom("TransitiveObjectProperty", V + "nextTurn")], ["nextTurn"], ["nextTurn(?a, ?b)"],
    "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t) "
    "SELECT 'urn:x/turn/' || x.conv_id || '/' || x.turn AS a, 'urn:x/turn/' || y.conv_id || '/' || y.turn AS b FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.k = y.k AND x.turn < y.turn",
)
conjunctive(
    "q12_transitive_tree", [axiom("TransitiveObjectProperty", V + "parent")], ["parent"], ["parent(?x, ?y)"],
    "WITH RECURSIVE p AS (SELECT c_custkey AS x, c_custkey // 2 AS y FROM customer WHERE c_custkey > 1), t AS (SELECT x, y FROM p UNION SELECT t.x, p.y FROM t JOIN p ON t.y = p.x) "
    "SELECT 'urn:x/customer/' || x AS x, 'urn:x/customer/' || y AS y FROM t",
)
conjunctive(
    "q13_transitive_cycle", [axiom("TransitiveObjectProperty", V + "succ")], ["succ"], ["succ(?x, ?y)"],
    "WITH RECURSIVE p AS (SELECT n_nationkey AS x, (n_nationkey + 1) % 25 AS y FROM nation), t AS (SELECT x, y FROM p UNION SELECT t.x, p.y FROM t JOIN p ON t.y = p.x) "
    "SELECT 'urn:x/nation/' || x AS x, 'urn:x/nation/' || y AS y FROM t",
)
URGENT_BUYER = sub(Some(R("placedBy").inverse(), C("UrgentOrder")), "UrgentBuyer")
conjunctive(
    "q14_existential_body", [URGENT_BUYER], ["placedBy", "UrgentOrder"], ["UrgentBuyer(?x)"],
    "SELECT DISTINCT 'urn:x/customer/' || o_custkey AS x FROM orders WHERE o_orderpriority = '1-URGENT'",
)
conjunctive(
    "q15_intersection", [URGENT_BUYER, sub(And((C("UrgentBuyer"), C("BuildingCustomer"))), "Target")], ["placedBy", "UrgentOrder", "BuildingCustomer"], ["Target(?x)"],
    "SELECT DISTINCT 'urn:x/customer/' || o_custkey AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'",
)
conjunctive(
    "q16_union_body", [sub(Or((C("SmallPart"), C("LargePart"))), "Shippable")], ["SmallPart", "LargePart"], ["Shippable(?x)"],
    "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE p_type IN ('SMALL', 'LARGE')",
)
conjunctive(
    "q17_has_value", [sub(E.HasValue(R("inRegion"), E.Individual("urn:x/region/2")), "RegionTwo"), sub(Some(R("cNation"), C("RegionTwo")), "LocalCustomer")], ["inRegion", "cNation"], ["LocalCustomer(?x)"],
    "SELECT DISTINCT 'urn:x/customer/' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
)
conjunctive(
    "q18_recursive_propagation", [sub(Some(R("parent"), C("A")), "A"), axiom("ClassAssertion", V + "A", "urn:x/customer/2")], ["parent"], ["A(?x)"],
    "WITH RECURSIVE t AS (SELECT 2 AS c UNION SELECT c_custkey FROM customer JOIN t ON c_custkey // 2 = t.c WHERE c_custkey > 1) SELECT 'urn:x/customer/' || c AS x FROM t",
)


def _hq(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return {("r", V + "hasHQ"): s.select(node("nation", "s_nationkey").alias("s"), node("supplier", "s_suppkey").alias("o"))}


conjunctive(
    "q19_functional_merge", [axiom("FunctionalObjectProperty", V + "hasHQ")], [], ["hasHQ(?n, ?y)"],
    "SELECT 'urn:x/nation/' || s_nationkey AS n, min('urn:x/supplier/' || s_suppkey) AS y FROM supplier GROUP BY s_nationkey", extra=_hq,
)


def _accounts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return {("r", V + "hasAccount"): c.select(node("customer", "c_custkey").alias("s"), F.expr("concat('urn:x/account/', cast(floor(c_acctbal) as string))").alias("o"))}


conjunctive(
    "q20_inverse_functional", [axiom("InverseFunctionalObjectProperty", V + "hasAccount")], ["Customer"], ["Customer(?x)"],
    "SELECT min('urn:x/customer/' || c_custkey) AS x FROM customer GROUP BY floor(c_acctbal)", extra=_accounts,
)
conjunctive(
    "q21_has_key", [axiom("HasKey", V + "Customer", [V + "cNation"], [V + "segment"])], ["Customer", "cNation", "segment"], ["Customer(?x)", "cNation(?x, ?n)"],
    "SELECT min('urn:x/customer/' || c_custkey) AS x, 'urn:x/nation/' || c_nationkey AS n FROM customer GROUP BY c_nationkey, c_mktsegment",
)


def _same(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 < 3")
    return {("eq",): c.select(node("customer", "c_custkey").alias("a"), node("customer", "c_custkey - c_custkey % 10").alias("b"))}


_SAME_SQL = "WITH m AS (SELECT c_custkey AS k, min('urn:x/customer/' || j) AS rep FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS g FROM customer) c JOIN (SELECT c_custkey AS j, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS h FROM customer UNION SELECT c_custkey - c_custkey % 10, c_custkey - c_custkey % 10 FROM customer WHERE c_custkey % 10 < 3) d ON g = h GROUP BY c_custkey) "
conjunctive(
    "q22_same_as", [], ["placedBy"], ["placedBy(?o, ?c)"],
    _SAME_SQL + "SELECT DISTINCT 'urn:x/orders/' || o_orderkey AS o, coalesce(rep, 'urn:x/customer/' || o_custkey) AS c FROM orders LEFT JOIN m ON o_custkey = k", extra=_same,
)
conjunctive(
    "q23_different_from", [axiom("DifferentIndividuals", *(f"urn:x/region/{i}" for i in range(5)))], ["Region"], ["Region(?a)", "Region(?b)", "differentFrom(?a, ?b)"],
    "SELECT 'urn:x/region/' || x.r_regionkey AS a, 'urn:x/region/' || y.r_regionkey AS b FROM region x JOIN region y ON x.r_regionkey <> y.r_regionkey",
)


def _seed_low(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '5-LOW' OR o_orderkey % 100 = 0")
    return {("c", V + "LowOrder"): o.select(node("orders", "o_orderkey").alias("x"))}


clash(
    "q24_disjoint_classes", [axiom("DisjointClasses", V + "UrgentOrder", V + "LowOrder")], ["UrgentOrder"],
    "SELECT DISTINCT 'DisjointClasses' AS rule, 'urn:x/orders/' || o_orderkey AS detail FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 100 = 0", extra=_seed_low,
)


def _seed_roles(spark, sf_dir):
    p, o = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 50 = 0")
    back = p.where("p_partkey % 50 = 0").select(node("part", "p_partkey + 1").alias("s"), node("part", "p_partkey").alias("o"))
    loops = p.where("p_partkey % 70 = 0").select(node("part", "p_partkey").alias("s"), node("part", "p_partkey").alias("o"))
    return {
        ("r", V + "before"): p.select(node("part", "p_partkey").alias("s"), node("part", "p_partkey + 1").alias("o")).unionByName(back),
        ("r", V + "near"): loops, ("r", V + "refusedBy"): o.select(node("orders", "o_orderkey").alias("s"), node("customer", "o_custkey").alias("o")),
    }


clash(
    "q25_role_clashes",
    [axiom("AsymmetricObjectProperty", V + "before"), axiom("IrreflexiveObjectProperty", V + "near"), axiom("DisjointObjectProperties", V + "placedBy", V + "refusedBy")], ["placedBy"],
    "SELECT 'AsymmetricObjectProperty' AS rule, 'urn:x/part/' || p_partkey || ' urn:x/part/' || (p_partkey + 1) AS detail FROM part WHERE p_partkey % 50 = 0 "
    "UNION SELECT 'AsymmetricObjectProperty', 'urn:x/part/' || (p_partkey + 1) || ' urn:x/part/' || p_partkey FROM part WHERE p_partkey % 50 = 0 "
    "UNION SELECT 'IrreflexiveObjectProperty', 'urn:x/part/' || p_partkey FROM part WHERE p_partkey % 70 = 0 "
    "UNION SELECT 'DisjointObjectProperties', 'urn:x/orders/' || o_orderkey || ' urn:x/customer/' || o_custkey FROM orders WHERE o_orderkey % 50 = 0",
    extra=_seed_roles,
)


def _seed_values(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = c.select(node("customer", "c_custkey").alias("s"), literal_column(F.expr("cast(c_acctbal as decimal(18,2))"), XSD + "decimal").alias("v"))
    more = c.where("c_custkey % 20 = 0").select(node("customer", "c_custkey").alias("s"), literal_column(F.expr("cast(c_acctbal + 1 as decimal(18,2))"), XSD + "decimal").alias("v"))
    return {("d", V + "balance"): own.unionByName(more)}


_DEC = "'\"' || CAST({} AS DECIMAL(18,2)) || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>'"
clash(
    "q26_functional_data", [axiom("FunctionalDataProperty", V + "balance")], [],
    f"WITH p AS (SELECT c_custkey, {_DEC.format('c_acctbal')} AS a, {_DEC.format('c_acctbal + 1')} AS b FROM customer WHERE c_custkey % 20 = 0) "
    "SELECT 'FunctionalDataProperty' AS rule, a || ' ' || b || ' urn:x/customer/' || c_custkey AS detail FROM p UNION SELECT 'FunctionalDataProperty', b || ' ' || a || ' urn:x/customer/' || c_custkey FROM p",
    extra=_seed_values,
)
clash(
    "q27_negative_assertions",
    [axiom("NegativeObjectPropertyAssertion", V + "inRegion", f"urn:x/nation/{n}", f"urn:x/region/{n % 5}") for n in range(25)], ["inRegion"],
    "SELECT 'NegativeObjectPropertyAssertion' AS rule, '' AS detail FROM nation WHERE n_regionkey = n_nationkey % 5",
)
clash(
    "q28_range_facet", [axiom("DataPropertyRange", V + "balance", Restricted(XSD + "decimal", ((XSD + "minInclusive", Literal("0", XSD + "integer")),)))], ["balance"],
    f"SELECT DISTINCT 'DataPropertyRange' AS rule, 'urn:x/customer/' || c_custkey AS detail FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0",
)
conjunctive(
    "q29_pattern_facet",
    [sub(E.DataSome(V + "brand", Restricted(XSD + "string", ((XSD + "pattern", Literal("Brand#[0-9]")), (XSD + "length", Literal("7", XSD + "integer"))))), "OneDigit")], ["brand"], ["OneDigit(?x)"],
    "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]') AND length(p_brand) = 7",
)
conjunctive(
    "q30_datatype_atom", [axiom("DataPropertyRange", V + "size", E.Datatype(XSD + "integer"))], ["size", "SmallPart"], ["SmallPart(?p)", "size!(?p, ?v)", "^integer(?v)"],
    "SELECT DISTINCT 'urn:x/part/' || p_partkey AS p, '\"' || p_size || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS v FROM part WHERE p_type = 'SMALL'",
)

PART_TBOX = [sub("SmallPart", "CompactPart"), sub("PromoPart", "CompactPart"), sub("CompactPart", "Part"), sub("LargePart", "Part"), axiom("EquivalentClasses", V + "Part", V + "Item")]


@other("q31_direct_types", "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x, 'urn:v#' || CASE p_type WHEN 'SMALL' THEN 'SmallPart' WHEN 'PROMO' THEN 'PromoPart' ELSE 'LargePart' END AS type FROM part WHERE p_type IN ('SMALL', 'PROMO', 'LARGE')")
def direct_types(spark, sf_dir):
    from .plans.realise import types

    return types(program(spark, sf_dir, PART_TBOX, ["SmallPart", "PromoPart", "LargePart"]), direct=True)


@other(
    "q32_hierarchy",
    "WITH e AS (SELECT 'urn:v#nation' || n_nationkey AS child, 'urn:v#region' || n_regionkey AS parent FROM nation UNION SELECT 'urn:v#region' || r_regionkey, 'urn:v#Place' FROM region) SELECT child, parent FROM e",
)
def hierarchy(spark, sf_dir):
    from .plans.realise import class_hierarchy

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    told = n.selectExpr("concat('urn:v#nation', n_nationkey) child", "concat('urn:v#region', n_regionkey) parent")
    told = told.unionByName(n.selectExpr("concat('urn:v#region', n_regionkey) child", "'urn:v#Place' parent")).unionByName(n.selectExpr("concat('urn:v#nation', n_nationkey) child", "'urn:v#Place' parent"))
    return class_hierarchy(told)[1]


conjunctive(
    "q33_data_values", [axiom("SubDataPropertyOf", V + "price", V + "amount"), axiom("SubDataPropertyOf", V + "balance", V + "amount")], ["price", "balance"], ["amount!(?x, ?v)"],
    f"SELECT 'urn:x/part/' || p_partkey AS x, {_DEC.format('p_retailprice')} AS v FROM part UNION SELECT 'urn:x/customer/' || c_custkey, {_DEC.format('c_acctbal')} FROM customer",
)


@other("q34_by_same_as", "SELECT min('urn:x/supplier/' || s_suppkey) AS rep, string_agg('urn:x/supplier/' || s_suppkey, ',' ORDER BY 'urn:x/supplier/' || s_suppkey) AS members FROM supplier GROUP BY s_nationkey")
def by_same_as(spark, sf_dir):
    from .plans.realise import node_sets

    p = program(spark, sf_dir, [axiom("FunctionalObjectProperty", V + "hasHQ")], [], _hq)
    sets = node_sets(p, answer(p, {"where": [atom("hasHQ(?n, ?y)")], "select": ["?y"]}, check=False))
    return sets.select("rep", F.concat_ws(",", "members").alias("members"))


_VIP = [axiom("Rule", (("class", V + "BuildingCustomer", "?c"), ("object", V + "placedBy", "?o", "?c"), ("class", V + "UrgentOrder", "?o")), (("class", V + "VipOrder", "?o"), ("object", V + "vipOf", "?o", "?c")))]


@other(
    "q35_rule",
    "WITH j AS (SELECT DISTINCT 'urn:x/orders/' || o_orderkey AS o, 'urn:x/customer/' || c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT') "
    "SELECT 'VipOrder' AS head, o AS a, '' AS b FROM j UNION ALL SELECT 'vipOf', o, c FROM j",
)
def rule(spark, sf_dir):
    p = program(spark, sf_dir, _VIP, ["BuildingCustomer", "placedBy", "UrgentOrder"])
    one = answer(p, {"where": [atom("VipOrder(?a)")]}, check=False).select(F.lit("VipOrder").alias("head"), "a", F.lit("").alias("b"))
    return one.unionByName(answer(p, {"where": [atom("vipOf(?a, ?b)")]}, check=False).select(F.lit("vipOf").alias("head"), "a", "b"))


conjunctive(
    "q36_active_domain", [], ["Supplier", "cNation", "balance"], ["Thing(?x)"],
    "SELECT 'urn:x/supplier/' || s_suppkey AS x FROM supplier UNION SELECT 'urn:x/customer/' || c_custkey FROM customer UNION SELECT 'urn:x/nation/' || c_nationkey FROM customer",
)
conjunctive(
    "q37_boolean", [], ["UrgentOrder", "placedBy", "BuildingCustomer"], ["UrgentOrder(?o)", "placedBy(?o, ?c)", "BuildingCustomer(?c)"],
    "SELECT 'true' AS holds WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING')", select=[],
)


@other("q38_incremental", "WITH RECURSIVE t AS (SELECT 3 AS c UNION SELECT c_custkey FROM customer JOIN t ON c_custkey // 2 = t.c WHERE c_custkey > 1) SELECT 'urn:x/customer/' || c AS x FROM t")
def incremental(spark, sf_dir):
    """Facts in two halves: the second is inserted into what the first has derived."""
    from .streaming.changes import Materialized

    parent = facts(spark, sf_dir, "parent")[("r", V + "parent")]
    even = F.substring_index("s", "/", -1).cast("long") % 2 == 0
    axioms = [sub(Some(R("parent"), C("A")), "A"), axiom("ClassAssertion", V + "A", "urn:x/customer/3")]
    m = Materialized(Program(spark, compile_horn(axioms), {("r", V + "parent"): parent.where(even)}), [("c", V + "A")])
    m.insert({("r", V + "parent"): parent.where(~even)})
    return m.extension(("c", V + "A")).select("x")


# ------------------------------------------------------------------ what rules alone do not decide

FAMILY = [
    axiom("SubObjectPropertyOf", V + "mother", V + "parent"), axiom("SubObjectPropertyOf", V + "parent", V + "ancestor"), axiom("TransitiveObjectProperty", V + "ancestor"),
    axiom("InverseObjectProperties", V + "child", V + "parent"), axiom("DisjointUnion", V + "Person", V + "Adult", V + "Minor"), axiom("DisjointClasses", V + "Minor", V + "Driver"), sub("Driver", "Person"),
    axiom("ObjectPropertyDomain", V + "parent", V + "Person"), axiom("FunctionalObjectProperty", V + "mother"),
]
CLAIMS = [
    ("driver is adult", sub("Driver", "Adult"), True), ("adult is driver", sub("Adult", "Driver"), False), ("mother of parent is ancestor", axiom("SubObjectPropertyChain", [V + "mother", V + "parent"], V + "ancestor"), True),
    ("child is inverse of parent", axiom("InverseObjectProperties", V + "child", V + "parent"), True), ("parent is transitive", axiom("TransitiveObjectProperty", V + "parent"), False),
    ("mothers are persons' own", axiom("ObjectPropertyDomain", V + "mother", V + "Person"), True), ("one mother", sub(E.Min(2, R("mother")), E.NOTHING), True), ("ancestor is functional", axiom("FunctionalObjectProperty", V + "ancestor"), False),
]


@other("q39_entailments", "SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{str(v).lower()}')" for n, _, v in CLAIMS) + ") AS t(claim, verdict)")
def entailments(spark, sf_dir):
    from .reasoner import Reasoner

    found = Reasoner(FAMILY, spark=spark).entailments_frame([a for _, a, _ in CLAIMS])
    names = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(CLAIMS)], "seq int, claim string")
    return found.join(names, "seq").select("claim", F.col("entailed").cast("string").alias("verdict"))


@other("q40_disjunction", "SELECT 'urn:x/orders/' || o_orderkey AS x FROM orders WHERE o_orderstatus = 'P'")
def disjunction(spark, sf_dir):
    """Orders are open, filled or pending: one that is neither open nor filled is pending."""
    from .operators.kernel import KB, types_by_profile

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(node("orders", "o_orderkey").alias("x"), "o_orderstatus")
    rows = o.select("x", F.lit(V + "Order").alias("cls"), F.lit(True).alias("positive"))
    for cls, letter in (("Open", "O"), ("Filled", "F")):
        rows = rows.unionByName(o.where(F.col("o_orderstatus") != letter).select("x", F.lit(V + cls).alias("cls"), F.lit(False).alias("positive")))
    return types_by_profile(KB([axiom("DisjointUnion", V + "Order", V + "Open", V + "Filled", V + "Pending")]), rows, C("Pending"))


@other("q41_counting", "SELECT 'urn:x/nation/' || s_nationkey AS x FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey) > 2")
def counting(spark, sf_dir):
    """Nations with at most two headquarters that have three or more different ones: at most n + 1 fillers of each need a test."""
    from .operators.kernel import KB, test

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kb = KB([sub(E.THING, E.Max(2, R("hasHQ")))])
    few = s.groupBy("s_nationkey").agg(F.least(F.count_distinct("s_suppkey"), F.lit(3)).alias("fillers"))
    sizes = {}
    for n in range(1, 4):
        fillers = [E.Individual(f"urn:f{i}") for i in range(n)]
        facts = [("ObjectPropertyAssertion", (R("hasHQ"), E.Individual("urn:n"), f)) for f in fillers] + ([("DifferentIndividuals", tuple(fillers))] if n > 1 else [])
        sizes[n] = test(kb, None, facts)
    clash_at = [n for n, ok in sizes.items() if not ok]
    return few.where(F.col("fillers").isin(clash_at)).select(node("nation", "s_nationkey").alias("x"))


_ANIMALS = [
    sub("Cat", "Pet"), sub("Dog", "Pet"), axiom("EquivalentClasses", C("Pet"), Or((C("Cat"), C("Dog")))), axiom("DisjointClasses", V + "Cat", V + "Dog"),
    sub("Guard", "Pet"), sub("Guard", E.Not(C("Cat"))), sub("Purring", And((C("Pet"), E.Not(C("Dog"))))), sub("Both", And((C("Cat"), C("Dog")))),
]


@other("q42_classification", "SELECT 'urn:v#' || c AS child, 'urn:v#' || p AS parent FROM (VALUES ('Cat', 'Pet'), ('Dog', 'Pet'), ('Guard', 'Dog'), ('Purring', 'Cat')) AS t(c, p)")
def classification(spark, sf_dir):
    """A hierarchy with disjunctions: model labels first, remaining tests by the kernel."""
    from .reasoner import Reasoner

    h = Reasoner(_ANIMALS, spark=spark).class_hierarchy()
    rows = [(g[0].iri, h.groups[p][0].iri) for i, g in enumerate(h.groups) for p in h.parents[i] if E.THING not in h.groups[p] and E.NOTHING not in g]
    return spark.createDataFrame(rows, "child string, parent string")
