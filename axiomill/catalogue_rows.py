"""More reasoning queries with their SQL: the kinds of axiom, expression, facet and question that the first catalogue leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _DEC, C, FAMILY, R, _accounts, _hq, _seed_values, atom, clash, conjunctive, other, program, sub
from .functions.datatypes import satisfiable
from .model import expressions as E
from .model.expressions import XSD, All, And, Datatype, DataMin, DataSome, HasSelf, Individual, Literal, Min, Not, OneOf, Or, RangeAnd, RangeNot, RangeOr, Restricted, Some, Values, axiom
from .plans.conjunctive import answer
from .plans.program import literal_column
from .reasoner import Reasoner
from .sources.tables import V, facts, node


def integer(n) -> Literal:
    return Literal(str(n), XSD + "integer")


def facet(name: str, bound: Literal, datatype: str = "integer") -> Restricted:
    return Restricted(XSD + datatype, ((XSD + name, bound),))


def verdicts(spark, rows) -> DataFrame:
    return spark.createDataFrame([(str(a), str(b).lower() if isinstance(b, bool) else str(b)) for a, b in rows], "question string, verdict string")


def expected(rows) -> str:
    text = lambda x: "'" + (str(x).lower() if isinstance(x, bool) else str(x)).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(a)}, {text(b)})" for a, b in rows) + ") AS t(question, verdict)"


# ------------------------------------------------------------------ individuals of fact frames, through the reasoner

PLACES = [sub("Region", "Place"), sub("Nation", "Place"), axiom("SubObjectPropertyOf", V + "inRegion", V + "within"), axiom("InverseObjectProperties", V + "contains", V + "within")]


def places(spark, sf_dir) -> Reasoner:
    return Reasoner(PLACES, spark=spark, facts=facts(spark, sf_dir, "Region", "Nation", "inRegion"))


@other("q43_types_of_facts", "SELECT 'urn:x/region/' || r_regionkey AS x, t.type AS type FROM region CROSS JOIN (VALUES ('http://www.w3.org/2002/07/owl#Thing'), ('urn:v#Region'), ('urn:v#Place')) AS t(type)")
def types_of_facts(spark, sf_dir):
    r = places(spark, sf_dir)
    return spark.createDataFrame([(x, t) for x in r.instances(V + "Region") for t in r.types(x) if r.has_type(x, t)], "x string, type string")


@other(
    "q44_instances_of_facts",
    "SELECT 'direct' AS which, 'urn:x/nation/' || n_nationkey AS x FROM nation UNION ALL SELECT 'all', 'urn:x/nation/' || n_nationkey FROM nation UNION ALL SELECT 'all', 'urn:x/region/' || r_regionkey FROM region",
)
def instances_of_facts(spark, sf_dir):
    r = places(spark, sf_dir)
    return spark.createDataFrame([("all", x) for x in r.instances(V + "Place")] + [("direct", x) for x in r.instances(V + "Nation", direct=True)], "which string, x string")


@other(
    "q45_same_and_different",
    "SELECT 'same' AS relation, 'urn:x/supplier/' || b.s_suppkey AS x FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey = 1 "
    "UNION ALL SELECT 'different', 'urn:x/region/' || r_regionkey FROM region WHERE r_regionkey <> 2",
)
def same_and_different(spark, sf_dir):
    axioms = [axiom("FunctionalObjectProperty", V + "hasHQ"), axiom("DifferentIndividuals", *(f"urn:x/region/{i}" for i in range(5)))]
    r = Reasoner(axioms, spark=spark, facts=_hq(spark, sf_dir))
    own = [("same", x) for x in r.same_individuals("urn:x/supplier/1") if r.is_same_individual("urn:x/supplier/1", x)]
    return spark.createDataFrame(own + [("different", x) for x in r.different_individuals("urn:x/region/2")], "relation string, x string")


@other(
    "q46_property_values",
    "SELECT 'contains' AS property, 'urn:x/nation/' || n_nationkey AS value FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'within', 'urn:x/region/' || n_regionkey FROM nation WHERE n_nationkey = 7 "
    f"UNION ALL SELECT 'amount', {_DEC.format('p_retailprice')} FROM part WHERE p_partkey = 1 GROUP BY ALL",
)
def property_values(spark, sf_dir):
    r = places(spark, sf_dir)
    rows = [("contains", x) for x in r.object_property_values("urn:x/region/2", V + "contains") if r.has_object_property_relationship("urn:x/region/2", V + "contains", x)]
    rows += [("within", x) for x in r.object_property_values("urn:x/nation/7", V + "within")]
    d = Reasoner([axiom("SubDataPropertyOf", V + "price", V + "amount")], spark=spark, facts=facts(spark, sf_dir, "price"))
    rows += [("amount", v.render()) for v in d.data_property_values("urn:x/part/1", V + "amount") if d.has_data_property_relationship("urn:x/part/1", V + "amount", v)]
    return spark.createDataFrame(rows, "property string, value string")


_NO = [sub("Vacant", E.NOTHING)]
CONSISTENT = [
    ("plain", [sub("Region", "Place")], True), ("class without a model", [sub("Region", E.NOTHING)], False), ("witness without a model", [sub("Region", Some(R("near"), C("Vacant"))), *_NO], False),
    ("witness forbidden to the same individual", [sub("Region", Some(R("near"), C("Port"))), sub("Region", All(R("near"), Not(C("Port"))))], False),
    ("witness forbidden to others", [sub("Region", Some(R("near"), C("Port"))), sub("Nation", All(R("near"), Not(C("Port"))))], True),
    ("what a witness implies", [sub("Region", Some(R("near"), C("Port"))), sub(Some(R("near"), C("Port")), "Coastal"), axiom("DisjointClasses", V + "Coastal", V + "Region")], False),
    ("functional filler is the witness", [sub("Nation", Some(R("inRegion"), C("Union"))), axiom("FunctionalObjectProperty", V + "inRegion"), axiom("DisjointClasses", V + "Union", V + "Region")], False),
    ("bottom role", [axiom("SubObjectPropertyOf", V + "inRegion", E.BOTTOM_ROLE)], False),
]


@other("q47_consistency", expected([(n, v) for n, _, v in CONSISTENT]))
def consistency(spark, sf_dir):
    """Facts against obligations: witnesses that cannot be, whatever the facts say."""
    own = facts(spark, sf_dir, "Region", "Nation", "inRegion")
    return verdicts(spark, [(n, Reasoner(a, spark=spark, facts=own).is_consistent()) for n, a, _ in CONSISTENT])


@other(
    "q48_query_forms",
    "WITH j AS (SELECT DISTINCT 'urn:x/nation/' || n_nationkey AS n, 'urn:x/region/' || n_regionkey AS r FROM nation) SELECT f.form AS form, j.n AS n, j.r AS r FROM j CROSS JOIN (VALUES ('prepared'), ('collected'), ('strings')) AS f(form)",
)
def query_forms(spark, sf_dir):
    """A prepared query, answers handed to a collector, answers as strings: all through the reasoner, its consistency check included."""
    r, found = places(spark, sf_dir), []
    spec = {"select": ["?n", "?r"], "where": [atom("within(?n, ?r)"), atom("Region(?r)")]}
    if not (r.materialize() and r.materialize()):
        raise AssertionError("the facts are consistent")
    rows = [("strings", *x) for x in r.answer_query_as_strings(spec)]
    r.answer_query(spec, lambda row: found.append(("collected", *row)))
    return spark.createDataFrame(rows + found, "form string, n string, r string").unionByName(r.create_query(spec)().select(F.lit("prepared").alias("form"), "n", "r"))


@other("q49_top_role", "SELECT 'urn:x/region/' || x.r_regionkey AS a, 'urn:x/region/' || y.r_regionkey AS b FROM region x CROSS JOIN region y")
def top_role(spark, sf_dir):
    r = Reasoner([], spark=spark, facts=facts(spark, sf_dir, "Region"))
    return r.query({"where": [{"object_property": E.TOP_ROLE, "subject": "?a", "object": "?b"}]})


@other("q50_any_data_property", f"SELECT 'urn:x/part/' || p_partkey AS x, {_DEC.format('p_retailprice')} AS v FROM part UNION SELECT 'urn:x/customer/' || c_custkey, {_DEC.format('c_acctbal')} FROM customer")
def any_data_property(spark, sf_dir):
    return Reasoner([], spark=spark, facts=facts(spark, sf_dir, "price", "balance")).query({"where": [{"data_property": E.TOP_DATA, "subject": "?x", "value": "?v"}]})


# ------------------------------------------------------------------ kinds of axiom

_IN = "SELECT DISTINCT 'urn:x/nation/' || n_nationkey AS n, 'urn:x/region/' || n_regionkey AS r FROM nation"
conjunctive("q51_equivalent_roles", [axiom("EquivalentObjectProperties", V + "inRegion", V + "lies", V + "locatedIn")], ["inRegion"], ["locatedIn(?n, ?r)"], _IN)
conjunctive("q52_reflexive", [axiom("ReflexiveObjectProperty", V + "knows")], ["Region"], ["knows(?a, ?b)"], "SELECT 'urn:x/region/' || r_regionkey AS a, 'urn:x/region/' || r_regionkey AS b FROM region")
conjunctive(
    "q53_equivalent_data", [axiom("EquivalentDataProperties", V + "price", V + "cost")], ["price"], ["cost!(?x, ?v)"],
    f"SELECT DISTINCT 'urn:x/part/' || p_partkey AS x, {_DEC.format('p_retailprice')} AS v FROM part",
)


def _asked(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.expr("cast(p_retailprice as decimal(18,2)) + case when p_partkey % 9 = 0 then 0 else 1 end")
    return {("d", V + "ask"): p.select(node("part", "p_partkey").alias("s"), literal_column(price, XSD + "decimal").alias("v"))}


clash(
    "q54_disjoint_data", [axiom("DisjointDataProperties", V + "price", V + "ask")], ["price"],
    "SELECT DISTINCT 'DisjointDataProperties' AS rule, 'n:' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) || ' urn:x/part/' || p_partkey AS detail FROM part WHERE p_partkey % 9 = 0", extra=_asked,
)
conjunctive("q55_data_domain", [axiom("DataPropertyDomain", V + "price", V + "Priced")], ["price"], ["Priced(?x)"], "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part")
conjunctive(
    "q56_datatype_definition", [axiom("DatatypeDefinition", Datatype(V + "handy"), facet("maxInclusive", integer(10))), sub(DataSome(V + "size", Datatype(V + "handy")), "Handy")], ["size"], ["Handy(?x)"],
    "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE p_size <= 10",
)
conjunctive(
    "q57_assertions", [axiom("ObjectPropertyAssertion", V + "inRegion", "urn:x/nation/99", "urn:x/region/2"), axiom("DataPropertyAssertion", V + "area", "urn:x/region/2", integer(7)), axiom("ClassAssertion", V + "Region", "urn:x/region/2")],
    ["inRegion"], ["inRegion(?n, ?r)", "Region(?r)", "area!(?r, ?v)"],
    "SELECT 'urn:x/nation/' || n AS n, 'urn:x/region/2' AS r, '\"7\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS v FROM (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 2 UNION SELECT 99)",
)
clash(
    "q58_negative_data", [axiom("NegativeDataPropertyAssertion", V + "segment", "urn:x/customer/1", Literal(x)) for x in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")], ["segment"],
    "SELECT DISTINCT 'NegativeDataPropertyAssertion' AS rule, '\"' || c_mktsegment || '\"^^<http://www.w3.org/2001/XMLSchema#string>' AS detail FROM customer WHERE c_custkey = 1",
)
conjunctive(
    "q59_undisplayed_axioms", [axiom("Declaration", "Class", V + "Region"), axiom("AnnotationAssertion", "urn:note", V + "Region", Literal("a place")), sub("Region", "Place")], ["Region"], ["Place(?x)"],
    "SELECT 'urn:x/region/' || r_regionkey AS x FROM region",
)

# ------------------------------------------------------------------ kinds of expression

conjunctive("q60_universal_head", [sub("Customer", All(R("cNation"), C("Market")))], ["Customer", "cNation"], ["Market(?n)"], "SELECT DISTINCT 'urn:x/nation/' || c_nationkey AS n FROM customer")
conjunctive(
    "q61_one_of", [sub(OneOf((Individual("urn:x/region/0"), Individual("urn:x/region/3"))), "Chosen"), sub(Some(R("inRegion"), C("Chosen")), "Picked")], ["inRegion"], ["Picked(?n)"],
    "SELECT 'urn:x/nation/' || n_nationkey AS n FROM nation WHERE n_regionkey IN (0, 3)",
)


def _loops(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return {("r", V + "near"): p.select(node("part", "p_partkey").alias("s"), node("part", "p_partkey - p_partkey % 7").alias("o"))}


conjunctive("q62_has_self", [sub(HasSelf(R("near")), "Alone")], [], ["Alone(?x)"], "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE p_partkey % 7 = 0", extra=_loops)
conjunctive(
    "q63_exact_one", [sub("Nation", E.exactly(1, R("hasHQ")))], ["Nation"], ["hasHQ(?n, ?y)"],
    "SELECT 'urn:x/nation/' || s_nationkey AS n, min('urn:x/supplier/' || s_suppkey) AS y FROM supplier GROUP BY s_nationkey", extra=_hq,
)
conjunctive(
    "q64_data_has_value", [sub(E.data_has_value(V + "brand", Literal("Brand#12")), "Twelve")], ["brand"], ["Twelve(?x)"], "SELECT DISTINCT 'urn:x/part/' || p_partkey AS x FROM part WHERE p_brand = 'Brand#12'"
)
conjunctive("q65_data_min", [sub(DataMin(2, V + "balance"), "Torn")], [], ["Torn(?x)"], "SELECT 'urn:x/customer/' || c_custkey AS x FROM customer WHERE c_custkey % 20 = 0", extra=_seed_values)
clash(
    "q66_data_exact", [sub(E.THING, E.data_exactly(1, V + "balance"))], [],
    f"WITH p AS (SELECT c_custkey, {_DEC.format('c_acctbal')} AS a, {_DEC.format('c_acctbal + 1')} AS b FROM customer WHERE c_custkey % 20 = 0) SELECT DISTINCT 'SubClassOf' AS rule, 'urn:x/customer/' || c_custkey AS detail FROM p",
    extra=_seed_values,
)
conjunctive(
    "q67_min_of_different", [sub(Min(3, R("inRegion").inverse()), "Crowded"), axiom("DifferentIndividuals", *(f"urn:x/nation/{i}" for i in range(25)))], ["inRegion"], ["Crowded(?r)"],
    "SELECT 'urn:x/region/' || n_regionkey AS r FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_nationkey) >= 3",
)
conjunctive("q68_some_thing", [sub(Some(R("placedBy").inverse(), E.THING), "Buyer")], ["placedBy"], ["Buyer(?x)"], "SELECT DISTINCT 'urn:x/customer/' || o_custkey AS x FROM orders")
conjunctive("q69_cartesian", [], ["Region", "Nation"], ["Region(?r)", "Nation(?n)"], "SELECT 'urn:x/region/' || r_regionkey AS r, 'urn:x/nation/' || n_nationkey AS n FROM region CROSS JOIN nation")


@other("q70_inverse_atom", "SELECT DISTINCT 'urn:x/customer/' || o_custkey AS c, 'urn:x/orders/' || o_orderkey AS o FROM orders")
def inverse_atom(spark, sf_dir):
    p = program(spark, sf_dir, [], ["placedBy"])
    return answer(p, {"where": [{"inverse_object_property": V + "placedBy", "subject": "?c", "object": "?o"}]}, check=False)


# ------------------------------------------------------------------ data ranges and facets: one class for each

RANGES = {
    "minExclusive": (facet("minExclusive", integer(40)), "p_size > 40"), "maxInclusive": (facet("maxInclusive", integer(3)), "p_size <= 3"), "maxExclusive": (facet("maxExclusive", integer(3)), "p_size < 3"),
    "totalDigits": (facet("totalDigits", integer(1)), "p_size < 10"), "value of another type": (Values((Literal("7.0", XSD + "decimal"),)), "p_size = 7"), "one of": (Values((integer(4), integer(9))), "p_size IN (4, 9)"),
    "and": (RangeAnd((facet("minInclusive", integer(10)), facet("maxInclusive", integer(20)))), "p_size BETWEEN 10 AND 20"), "or": (RangeOr((facet("maxExclusive", integer(5)), facet("minExclusive", integer(45)))), "p_size < 5 OR p_size > 45"),
    "not": (RangeNot(facet("minInclusive", integer(6))), "p_size < 6"), "subtype": (Datatype(XSD + "byte"), "TRUE"), "disjoint type": (Datatype(XSD + "boolean"), "FALSE"), "empty": (facet("maxExclusive", integer(0), "nonNegativeInteger"), "FALSE"),
}
TEXTS = {
    "minLength": (facet("minLength", integer(8), "string"), "length(p_brand) >= 8"), "maxLength": (facet("maxLength", integer(7), "string"), "length(p_brand) <= 7"),
    "unknown facet": (facet("shininess", integer(7), "string"), "FALSE"),
}
PRICES = {"fractionDigits": (facet("fractionDigits", integer(1), "decimal"), "CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 10 AS DECIMAL(38,2)) % 1 = 0")}


def _ranged(cases: dict, prop: str):
    def run(spark, sf_dir):
        p = program(spark, sf_dir, [sub(DataSome(V + prop, r), f"Case{i}") for i, (r, _) in enumerate(cases.values())], [prop])
        return reduce(DataFrame.unionByName, (answer(p, {"where": [atom(f"Case{i}(?x)")]}, check=False).select(F.lit(n).alias("case_name"), "x") for i, n in enumerate(cases)))

    return run


def _ranged_sql(cases: dict) -> str:
    return " UNION ".join(f"SELECT '{n}' AS case_name, 'urn:x/part/' || p_partkey AS x FROM part WHERE {w}" for n, (_, w) in cases.items())


for _name, _cases, _prop in (("q71_integer_ranges", RANGES, "size"), ("q72_text_facets", TEXTS, "brand"), ("q73_fraction_digits", PRICES, "price")):
    other(_name, _ranged_sql(_cases))(_ranged(_cases, _prop))

#: (question, ranges of each value, pairs that differ, whether values exist)
SATISFIABLE = [
    ("integer within decimal", {0: [Datatype(XSD + "integer"), Datatype(XSD + "decimal")]}, [], True), ("integer and not decimal", {0: [Datatype(XSD + "integer"), RangeNot(Datatype(XSD + "decimal"))]}, [], False),
    ("number and text", {0: [Datatype(XSD + "integer"), Datatype(XSD + "string")]}, [], False), ("open interval of integers", {0: [facet("minExclusive", integer(3)), facet("maxExclusive", integer(4))]}, [], False),
    ("two in a pair of values", {i: [Values((integer(1), integer(2)))] for i in range(2)}, [(0, 1)], True), ("three in a pair of values", {i: [Values((integer(1), integer(2)))] for i in range(3)}, [(0, 1), (0, 2), (1, 2)], False),
    ("three booleans", {i: [Datatype(XSD + "boolean")] for i in range(3)}, [(0, 1), (0, 2), (1, 2)], False), ("256 bytes and one more", {i: [facet("maxInclusive", integer(1), "unsignedByte")] for i in range(3)}, [(0, 1), (1, 2), (0, 2)], False),
    ("equal values of two types", {0: [Values((integer(1),))], 1: [Values((Literal("1.0", XSD + "decimal"),))]}, [(0, 1)], False), ("complement of an empty range", {0: [RangeNot(facet("maxExclusive", integer(0), "nonNegativeInteger"))]}, [], True),
]


@other("q74_datatype_questions", expected([(q, v) for q, _, _, v in SATISFIABLE]))
def datatype_questions(spark, sf_dir):
    return verdicts(spark, [(q, bool(satisfiable(n, p))) for q, n, p, _ in SATISFIABLE])


# ------------------------------------------------------------------ questions about the terms themselves

ROLES = [
    ("mother below ancestor", lambda r: r.is_sub_object_property_of(V + "mother", V + "ancestor"), True), ("ancestor below mother", lambda r: r.is_sub_object_property_of(V + "ancestor", V + "mother"), False),
    ("supers of mother", lambda r: ",".join(x.removeprefix(V) for x in r.super_object_properties(V + "mother", True)), "parent"), ("subs of ancestor", lambda r: ",".join(x.removeprefix(V) for x in r.sub_object_properties(V + "ancestor", True)), "parent"),
    ("inverse of child", lambda r: ",".join(x.removeprefix(V) for x in r.inverse_object_properties(V + "child")), "parent"), ("mother functional", lambda r: r.is_functional(V + "mother"), True),
    ("parent functional", lambda r: r.is_functional(V + "parent"), False), ("parent inverse functional", lambda r: r.is_inverse_functional(V + "parent"), False), ("ancestor transitive", lambda r: r.is_transitive(V + "ancestor"), True),
    ("ancestor symmetric", lambda r: r.is_symmetric(V + "ancestor"), False), ("ancestor irreflexive", lambda r: r.is_irreflexive(V + "ancestor"), False), ("ancestor reflexive", lambda r: r.is_reflexive(V + "ancestor"), False),
    ("ancestor asymmetric", lambda r: r.is_asymmetric(V + "ancestor"), False), ("mother disjoint with parent", lambda r: r.is_disjoint_object_property(V + "mother", V + "parent"), False),
    ("domains of mother", lambda r: ",".join(x.removeprefix(V) for x in r.object_property_domains(V + "mother", True)), "Person"), ("ranges of child", lambda r: ",".join(x.removeprefix(V) for x in r.object_property_ranges(V + "child", True)), "Person"),
    ("mothers of parents", lambda r: r.is_chain_below([E.Role(V + "mother"), E.Role(V + "parent")], E.Role(V + "ancestor")), True),
]


@other("q75_role_questions", expected([(q, v) for q, _, v in ROLES]))
def role_questions(spark, sf_dir):
    r = Reasoner(FAMILY, spark=spark)
    return verdicts(spark, [(q, f(r)) for q, f, _ in ROLES])


_DATA = [
    axiom("SubDataPropertyOf", V + "net", V + "price"), axiom("SubDataPropertyOf", V + "price", V + "amount"), axiom("EquivalentDataProperties", V + "price", V + "cost"), axiom("DataPropertyDomain", V + "amount", V + "Priced"),
    axiom("DisjointDataProperties", V + "price", V + "label"), axiom("FunctionalDataProperty", V + "price"), axiom("DataPropertyRange", V + "label", Datatype(XSD + "string")),
]
DATAS = [
    ("net below amount", lambda r: r.is_sub_data_property_of(V + "net", V + "amount"), True), ("amount below net", lambda r: r.is_sub_data_property_of(V + "amount", V + "net"), False),
    ("equivalents of cost", lambda r: ",".join(x.removeprefix(V) for x in r.equivalent_data_properties(V + "cost")), "cost,price"), ("supers of net", lambda r: ",".join(x.removeprefix(V) for x in r.super_data_properties(V + "net", True)), "cost,price"),
    ("net disjoint with label", lambda r: r.is_disjoint_data_property(V + "net", V + "label"), True), ("net disjoint with amount", lambda r: r.is_disjoint_data_property(V + "net", V + "amount"), False),
    ("net functional", lambda r: r.is_functional_data_property(V + "net"), True), ("amount functional", lambda r: r.is_functional_data_property(V + "amount"), False),
    ("domains of net", lambda r: ",".join(x.removeprefix(V) for x in r.data_property_domains(V + "net", True)), "Priced"),
]


@other("q76_data_property_questions", expected([(q, v) for q, _, v in DATAS]))
def data_property_questions(spark, sf_dir):
    r = Reasoner(_DATA, spark=spark)
    return verdicts(spark, [(q, f(r)) for q, f, _ in DATAS])


_ZOO = [
    sub("Cat", "Pet"), axiom("EquivalentClasses", V + "Pet", V + "Companion"), axiom("DisjointClasses", V + "Cat", V + "Dog"), sub("Dog", "Pet"), sub("Both", And((C("Cat"), C("Dog")))), axiom("Declaration", "Class", V + "Rock"),
    axiom("EquivalentClasses", C("Owner"), Some(R("owns"), C("Pet"))), sub("CatLover", Some(R("owns"), C("Cat"))),
]
CLASSES = [
    ("supers of Cat", lambda r: r.super_classes(V + "Cat", True), "Companion,Pet"), ("subs of Pet", lambda r: r.sub_classes(V + "Pet", True), "Cat,Dog"), ("equivalents of Pet", lambda r: r.equivalent_classes(V + "Pet"), "Companion,Pet"),
    ("unsatisfiable", lambda r: r.unsatisfiable_classes(), "Both"), ("top classes", lambda r: r.top_classes(), "CatLover,Companion,Owner,Pet,Rock"), ("supers of an expression", lambda r: r.super_classes(Some(R("owns"), C("Cat")), True), "Owner"),
    ("subs of an expression", lambda r: r.sub_classes(Or((C("Cat"), C("Dog"))), True), "Cat,Dog"),
]


@other("q77_class_questions", expected([(q, v if q != "top classes" else "Companion,Owner,Pet,Rock") for q, _, v in CLASSES] + [("Both satisfiable", False), ("Cat satisfiable", True), ("CatLover below Owner", True), ("Cat disjoint with Dog", True)]))
def class_questions(spark, sf_dir):
    r = Reasoner(_ZOO, spark=spark)
    rows = [(q, ",".join(sorted(x.removeprefix(V) for x in f(r)))) for q, f, _ in CLASSES]
    rows += [("Both satisfiable", r.is_satisfiable(V + "Both")), ("Cat satisfiable", r.is_satisfiable(V + "Cat")), ("CatLover below Owner", r.is_sub_class_of(V + "CatLover", V + "Owner"))]
    return verdicts(spark, [*rows, ("Cat disjoint with Dog", V + "Dog" in r.disjoint_classes(V + "Cat"))])


_a, _b, _c = (f"urn:i/{x}" for x in "abc")
_ABOX = [
    axiom("ClassAssertion", V + "Cat", _a), axiom("ClassAssertion", V + "Pet", _b), axiom("ObjectPropertyAssertion", V + "owns", _c, _a), axiom("SameIndividual", _b, "urn:i/d"), axiom("DifferentIndividuals", _a, _b),
    axiom("DataPropertyAssertion", V + "age", _a, integer(3)), axiom("NegativeObjectPropertyAssertion", V + "owns", _a, _c), axiom("NegativeDataPropertyAssertion", V + "age", _b, integer(9)),
    axiom("SubDataPropertyOf", V + "age", V + "number"), axiom("HasKey", V + "Pet", [], [V + "chip"]), axiom("DatatypeDefinition", Datatype(V + "few"), facet("maxInclusive", integer(3), "nonNegativeInteger")),
]
ENTAILED = [
    ("class assertion", axiom("ClassAssertion", V + "Owner", _c), True), ("object property assertion", axiom("ObjectPropertyAssertion", V + "owns", _c, _b), False), ("data property assertion", axiom("DataPropertyAssertion", V + "number", _a, integer(3)), True),
    ("negative object assertion", axiom("NegativeObjectPropertyAssertion", V + "owns", _a, _c), True), ("negative data assertion", axiom("NegativeDataPropertyAssertion", V + "age", "urn:i/d", integer(9)), True),
    ("same individual", axiom("SameIndividual", _b, "urn:i/d"), True), ("different individuals", axiom("DifferentIndividuals", _a, "urn:i/d"), True), ("sub data property", axiom("SubDataPropertyOf", V + "age", V + "number"), True),
    ("data property domain", axiom("DataPropertyDomain", V + "age", V + "Pet"), False), ("datatype definition", axiom("DatatypeDefinition", Datatype(V + "few"), Values(tuple(integer(i) for i in range(4)))), True),
    ("key", axiom("HasKey", V + "Cat", [], [V + "chip"]), True), ("another key", axiom("HasKey", V + "Cat", [], [V + "age"]), False), ("declaration", axiom("Declaration", "Class", V + "Cat"), True),
]
FOREST = [axiom("ObjectPropertyAssertion", V + "owns", Individual(_c), Individual("_:x", True)), axiom("ClassAssertion", V + "Cat", Individual("_:x", True))]


@other("q78_assertion_entailments", expected([(q, v) for q, _, v in ENTAILED] + [("anonymous individual", True), ("rules are refused", True)]))
def assertion_entailments(spark, sf_dir):
    r = Reasoner(_ZOO + _ABOX, spark=spark)
    found = r.entailments_frame([a for _, a, _ in ENTAILED])
    names = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ENTAILED)], "seq int, question string")
    rows = found.join(names, "seq").select("question", F.col("entailed").cast("string").alias("verdict"))
    return rows.unionByName(verdicts(spark, [("anonymous individual", r.is_entailed(FOREST)), ("rules are refused", not r.is_entailment_checking_supported("Rule"))]))


_CHAIN = [axiom("DisjointClasses", *(C(f"B{i}") for i in range(3)))] + [sub("X", Some(R("s"), And((C(f"B{i}"), Some(R("r"), OneOf((Individual("urn:i/o"),))))))) for i in range(3)]
KERNEL = [
    ("thirty irrelevant choices before a contradiction", [sub("X", Or((C(f"L{i}"), C(f"M{i}")))) for i in range(30)] + [sub("X", Some(R("r"), And((Or((C("P"), C("Q"))), Not(C("P")), Not(C("Q"))))))], False),
    ("three predecessors of a nominal that takes two", [*_CHAIN, axiom("ClassAssertion", E.Max(2, R("r").inverse()), "urn:i/o")], False),
    ("three predecessors of a nominal that takes three", [*_CHAIN, axiom("ClassAssertion", E.Max(3, R("r").inverse()), "urn:i/o")], True),
    ("five thousand witnesses", [sub("X", Min(5000, R("r")))], True), ("five thousand of at most 4999", [sub("X", Min(5000, R("r"))), sub("X", E.Max(4999, R("r")))], False),
    ("an endless chain is blocked", [sub("X", Some(R("r"), C("X")))], True), ("blocked, with inverse and functional roles", [sub("X", Some(R("r"), C("X"))), axiom("FunctionalObjectProperty", R("r").inverse())], True),
    ("a functional role has one filler", [sub("X", Some(R("r"), C("P"))), sub("X", Some(R("r"), Not(C("P")))), axiom("FunctionalObjectProperty", V + "r")], False),
]


@other("q79_kernel_cases", expected([(q, v) for q, _, v in KERNEL]))
def kernel_cases(spark, sf_dir):
    """Whether X can have an instance: choices, nominals, counting, blocking, merging."""
    return verdicts(spark, [(q, Reasoner(a, spark=spark).is_satisfiable(V + "X")) for q, a, _ in KERNEL])


_LINES = [
    "EquivalentClasses( <http://www.w3.org/2002/07/owl#Nothing> <urn:v#Both> )", "EquivalentClasses( <urn:v#Companion> <urn:v#Pet> )", "SubClassOf( <urn:v#Cat> <urn:v#Companion> )", "SubClassOf( <urn:v#CatLover> <urn:v#Owner> )",
    "SubClassOf( <urn:v#Dog> <urn:v#Companion> )",
]


@other("q80_dumped_hierarchy", "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _LINES) + ") AS t(line)")
def dumped_hierarchy(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in Reasoner(_ZOO, spark=spark).dump_hierarchy()], "line string")


conjunctive(
    "q81_diamonds", [sub(f"T{i}", f"{s}{i}") for i in range(20) for s in "LM"] + [sub(f"{s}{i}", f"T{i + 1}") for i in range(20) for s in "LM"] + [sub("Region", "T0")], ["Region"], ["T20(?x)"],
    "SELECT 'urn:x/region/' || r_regionkey AS x FROM region",
)
conjunctive(
    "q82_symmetric_inverse_equivalent",
    [axiom("SymmetricObjectProperty", V + "linked"), axiom("EquivalentObjectProperties", V + "linked", V + "joined"), axiom("InverseObjectProperties", V + "joined", V + "attached"), axiom("SubObjectPropertyOf", V + "inRegion", V + "linked")],
    ["inRegion"], ["attached(?a, ?b)"],
    "SELECT 'urn:x/nation/' || n_nationkey AS a, 'urn:x/region/' || n_regionkey AS b FROM nation UNION SELECT 'urn:x/region/' || n_regionkey, 'urn:x/nation/' || n_nationkey FROM nation",
)


@other("q83_representatives", "SELECT 'urn:x/customer/' || c_custkey AS x FROM customer a JOIN (SELECT floor(c_acctbal) AS f FROM customer WHERE c_custkey = 1) b ON floor(a.c_acctbal) = b.f")
def representatives(spark, sf_dir):
    """The equality class of an individual, through its representative."""
    p = program(spark, sf_dir, [axiom("InverseFunctionalObjectProperty", V + "hasAccount")], ["Customer"], _accounts)
    return spark.createDataFrame([(x,) for x in p.equivalence_class(p.representative("urn:x/customer/1")) or []], "x string")


