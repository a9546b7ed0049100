"""The reasoner's public questions, configuration, monitors, prefixes, functional syntax and command line."""

import io

import pytest

from axiomill import cli
from axiomill.config import Configuration
from axiomill.model.expressions import NOTHING, THING, XSD, All, And, DataSome, Datatype, Individual, Literal, Min, Named, Not, OneOf, Or, RangeAnd, RangeNot, RangeOr, Restricted, Role, Some, Values, axiom
from axiomill.functions.datatypes import equal, facet_holds, in_datatype, member, satisfiable
from axiomill.monitors import CountingMonitor, MemoryMonitor, MonitorFork, Timer
from axiomill.prefixes import Prefixes
from axiomill.reasoner import Inconsistent, Reasoner, entails
from axiomill.sources.functional import facts_of_triples, load, parse, read_ntriples, resolve

N = "urn:"
INT = XSD + "integer"
A, B, C, D = (Named(N + x) for x in "ABCD")


def ax(k, *a):
    return axiom(k, *a)


FAMILY = [
    ax("SubObjectPropertyOf", N + "mother", N + "parent"), ax("SubObjectPropertyOf", N + "father", N + "parent"), ax("SubObjectPropertyOf", N + "parent", N + "ancestor"),
    ax("InverseObjectProperties", N + "child", N + "parent"), ax("TransitiveObjectProperty", N + "ancestor"), ax("ObjectPropertyDomain", N + "parent", N + "Person"),
]


def test_class_questions():
    r = Reasoner([ax("SubClassOf", A, B), ax("SubClassOf", B, C), ax("EquivalentClasses", C, D), ax("SubClassOf", N + "X", Or((A, And((B, N and Named(N + "Y"))))))])
    assert r.super_classes(A) == sorted([THING.iri, N + "B", N + "C", N + "D"]) and r.super_classes(A, True) == [N + "B"]
    assert r.equivalent_classes(C) == [N + "C", N + "D"] and r.sub_classes(C, True) == [N + "B"]
    assert r.is_sub_class_of(N + "X", C) and not r.is_sub_class_of(N + "X", A)
    assert r.super_classes(And((B, Named(N + "Y"))), True) == [N + "B", N + "Y"] or N + "B" in r.super_classes(And((B, Named(N + "Y"))))
    assert N + "C" in r.top_classes() and r.unsatisfiable_classes() == []


def test_deep_chain_and_unsatisfiable_classes():
    r = Reasoner([ax("SubClassOf", f"{N}C{i}", f"{N}C{i + 1}") for i in range(19)] + [ax("SubClassOf", N + "Bad", And((A, Not(A))))])
    assert len(r.super_classes(N + "C0")) == 20
    assert r.unsatisfiable_classes() == [N + "Bad"] and not r.is_satisfiable(N + "Bad")


def test_disjoint_classes():
    r = Reasoner([ax("DisjointClasses", A, B), ax("SubClassOf", C, B)])
    assert r.disjoint_classes(A) == sorted([N + "B", N + "C", NOTHING.iri])


def test_property_questions():
    r = Reasoner(FAMILY)
    assert r.super_object_properties(N + "mother", True) == [N + "parent"]
    assert r.sub_object_properties(N + "parent", True) == [N + "father", N + "mother"]
    assert r.inverse_object_properties(N + "parent") == [N + "child"]
    assert r.is_transitive(N + "ancestor") and not r.is_transitive(N + "parent")
    assert r.object_property_domains(N + "mother", True) == [N + "Person"] and r.object_property_ranges(N + "child", True) == [N + "Person"]
    assert r.is_chain_below((Role(N + "mother"), Role(N + "father")), N + "ancestor")
    assert not r.is_functional(N + "parent") and not r.is_symmetric(N + "parent")


@pytest.mark.parametrize("kind,question", [("FunctionalObjectProperty", "is_functional"), ("InverseFunctionalObjectProperty", "is_inverse_functional"), ("SymmetricObjectProperty", "is_symmetric"), ("AsymmetricObjectProperty", "is_asymmetric"), ("ReflexiveObjectProperty", "is_reflexive"), ("IrreflexiveObjectProperty", "is_irreflexive"), ("TransitiveObjectProperty", "is_transitive")])
def test_characteristics(kind, question):
    assert getattr(Reasoner([ax(kind, N + "R")]), question)(N + "R")
    assert not getattr(Reasoner([ax("Declaration", "ObjectProperty", N + "R")]), question)(N + "R")
    assert entails([ax(kind, N + "R")], [ax(kind, N + "R")])


def test_data_properties():
    r = Reasoner([ax("SubDataPropertyOf", N + "p", N + "q"), ax("FunctionalDataProperty", N + "q"), ax("DataPropertyDomain", N + "q", A), ax("DataPropertyRange", N + "q", Datatype(INT)), ax("DataPropertyAssertion", N + "p", "a", Literal("1", INT))])
    assert r.is_sub_data_property_of(N + "p", N + "q") and not r.is_sub_data_property_of(N + "q", N + "p")
    assert r.is_functional_data_property(N + "p") and r.data_property_domains(N + "p", True) == [N + "A"]
    assert r.data_property_values("a", N + "q") == [Literal("1", INT)] and r.has_type("a", A)
    assert r.has_data_property_relationship("a", N + "q", Literal("1", INT)) and not r.has_data_property_relationship("a", N + "q", Literal("2", INT))
    assert r.super_data_properties(N + "p", True) == [N + "q"]


def test_individuals():
    r = Reasoner([ax("SubClassOf", A, B), ax("SubClassOf", B, C), ax("ClassAssertion", A, "a1"), ax("ClassAssertion", B, "a2"), ax("ClassAssertion", C, "a3"), ax("FunctionalObjectProperty", N + "R"), *(ax("ObjectPropertyAssertion", N + "R", "a1", x) for x in ("a2", "a4")), ax("DifferentIndividuals", "a2", "a3")], {"individual_sets": "BY_SAME_AS"})
    assert r.types("a1", True) == [N + "A"] and r.types("a4", True) == [N + "B"]
    assert r.instances(B) == ["a1", "a2", "a4"] and r.instances(B, True) == ["a2", "a4"]
    assert r.same_individuals("a2") == ["a2", "a4"] and r.different_individuals("a3") == ["a2", "a4"]
    assert r.object_property_values("a1", N + "R") == ["a2", "a4"] and r.individual_sets(["a2", "a4", "a3"]) == [["a2", "a4"], ["a3"]]


ENTAILED = [
    ax("SubClassOf", A, C), ax("EquivalentClasses", C, D), ax("DisjointClasses", A, N + "E"), ax("ClassAssertion", C, "a"), ax("ObjectPropertyAssertion", N + "S", "a", "b"), ax("NegativeObjectPropertyAssertion", N + "T", "a", "a"),
    ax("DifferentIndividuals", "a", "e"), ax("SubObjectPropertyOf", N + "R", N + "S"), ax("DataPropertyAssertion", N + "q", "a", Literal("1", INT)), ax("HasKey", A, [N + "R"], []), ax("ObjectPropertyDomain", N + "R", A), ax("DataPropertyRange", N + "q", Datatype(XSD + "decimal")),
    ax("Declaration", "Class", N + "A"), ax("IrreflexiveObjectProperty", N + "T"), ax("DisjointUnion", N + "U", A, N + "E"),
]
PREMISE = [
    ax("SubClassOf", A, B), ax("SubClassOf", B, C), ax("EquivalentClasses", C, D), ax("DisjointClasses", A, N + "E"), ax("ClassAssertion", A, "a"), ax("ClassAssertion", N + "E", "e"), ax("ObjectPropertyAssertion", N + "R", "a", "b"),
    ax("SubObjectPropertyOf", N + "R", N + "S"), ax("AsymmetricObjectProperty", N + "T"), ax("DataPropertyAssertion", N + "p", "a", Literal("1", INT)), ax("SubDataPropertyOf", N + "p", N + "q"), ax("HasKey", A, [N + "R"], []), ax("ObjectPropertyDomain", N + "R", A),
    ax("DataPropertyRange", N + "q", Datatype(INT)), ax("EquivalentClasses", N + "U", Or((A, Named(N + "E")))),
]


@pytest.mark.parametrize("i", range(len(ENTAILED)))
def test_entailments_hold_and_do_not_hold_without_premise(i):
    a = ENTAILED[i]
    assert entails(PREMISE, [a])
    if a.kind != "Declaration":
        assert not entails([ax("Declaration", "Class", N + "A")], [a])


def test_anonymous_conclusions():
    x, y = Individual("_:x", True), Individual("_:y", True)
    kb = [ax("ClassAssertion", Some(Role(N + "R"), And((A, Some(Role(N + "S"), B)))), "a")]
    tree = [ax("ObjectPropertyAssertion", N + "R", "a", x), ax("ClassAssertion", A, x), ax("ObjectPropertyAssertion", N + "S", x, y), ax("ClassAssertion", B, y)]
    assert entails(kb, tree) and not entails(kb, [*tree, ax("ClassAssertion", C, y)])
    with pytest.raises(ValueError, match="cycle"):
        entails(kb, [ax("ObjectPropertyAssertion", N + "R", x, y), ax("ObjectPropertyAssertion", N + "R", y, x)])
    with pytest.raises(ValueError):
        entails(kb, [ax("Rule", (), ())])


def test_inconsistency_policy_and_fresh_witnesses():
    kb = [ax("ClassAssertion", A, "a"), ax("ClassAssertion", Not(A), "a")]
    with pytest.raises(Inconsistent):
        Reasoner(kb).is_sub_class_of(A, B)
    quiet = Reasoner(kb, {"throw_on_inconsistent": False})
    assert quiet.is_sub_class_of(A, B) and not quiet.is_satisfiable(A)
    assert not Reasoner([ax("SubClassOf", A, Some(Role(N + "R"), B)), ax("SubClassOf", B, NOTHING), ax("ClassAssertion", A, "a")]).is_consistent()


def test_changes_equal_a_new_reasoner():
    r = Reasoner([ax("SubClassOf", A, B), ax("ClassAssertion", A, "a"), ax("ClassAssertion", B, "b")])
    r.apply_change(True, ax("ClassAssertion", A, "b"))
    assert r.instances(A) == ["a"] and len(r.pending_changes()) == 1 and r.can_process_incrementally()
    r.flush()
    assert r.instances(A) == ["a", "b"]
    r.apply_change(False, ax("ClassAssertion", A, "a"))
    r.flush()
    assert r.instances(A) == ["b"] and not r.pending_changes()
    now = Reasoner([ax("ClassAssertion", A, "a")], {"buffer_changes": False})
    now.apply_change(True, ax("SubClassOf", A, B))
    assert now.has_type("a", B)


@pytest.mark.parametrize("blocking", ["OPTIMAL", "ANYWHERE", "ANCESTOR", "SIMPLE_CORE"])
@pytest.mark.parametrize("existential", ["CREATION_ORDER", "INDIVIDUAL_REUSE", "EL"])
def test_strategies_agree(blocking, existential):
    kb = [ax("SubClassOf", A, Some(Role(N + "R"), A)), ax("SubClassOf", A, Or((B, C))), ax("SubClassOf", B, Not(C)), ax("SubClassOf", B, Some(Role(N + "R"), C)), ax("ClassAssertion", A, "a")]
    r = Reasoner(kb, {"blocking": blocking, "existential": existential})
    assert r.is_consistent() and all(r.is_satisfiable(c) for c in (A, B, C)) and r.super_classes(A) == [THING.iri]


def test_configuration_checks_values():
    said = []
    Configuration(blocking="COMPLEX_CORE", warn=said.append)
    assert "not implemented" in said[0]
    for bad in ({"blocking": "ODD"}, {"monitor_type": "ODD"}, {"odd": 1}):
        with pytest.raises(ValueError):
            Configuration.of(bad)
    with pytest.raises(KeyError):
        r = Reasoner([ax("SubClassOf", A, B)], {"fresh_entities": "DISALLOW"})
        r._known(N + "Nobody")


def test_monitors():
    lines, count, memory = [], CountingMonitor(), MemoryMonitor()
    r = Reasoner([ax("SubClassOf", A, Or((B, C)))], {"monitor": MonitorFork(count, memory, Timer(lines.append))})
    r.is_satisfiable(And((A, Not(B))))
    s = count.summary()
    assert s["tests"] == 2 == len(lines) and s["nodes"] > 0 and memory.memory()["peak"] > 0 and count.patterns() == ["consistency", "satisfiability"]
    before = s["tests"]
    r.is_satisfiable(And((A, Not(B))))
    assert count.summary()["tests"] == before  # answers are kept


def test_told_horn_classification_needs_one_test_a_class():
    m = CountingMonitor()
    Reasoner([ax("SubClassOf", f"{N}C{i}", f"{N}C{i + 1}") for i in range(9)], {"monitor": m}).class_hierarchy()
    assert m.summary()["tests"] <= 1 + 10 + 10  # consistency, a model for each class, and whether the top lies below it


def test_prefixes():
    p = Prefixes({"a:": "urn:x#", "ab:": "urn:x#y"})
    assert p.abbreviate("urn:x#z") == "a:z" and p.abbreviate("urn:x#yz") == "ab:z" and p.abbreviate("urn:x#1/2") == "<urn:x#1/2>"
    assert p.expand("a:z") == "urn:x#z" and p.expand("<urn:q>") == "urn:q"
    for bad in (lambda: p.expand("no:z"), lambda: p.declare("c:", "urn:x#"), lambda: p.declare("1", "urn:q")):
        with pytest.raises(ValueError):
            bad()


DOC = """Prefix(:=<urn:>)
Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)
Ontology(<urn:onto>
# a comment
Declaration(Class(:A)) Declaration(NamedIndividual(:a))
SubClassOf(:A ObjectUnionOf(:B :C)) SubClassOf(:B :D) SubClassOf(:C :D)
SubClassOf(:D ObjectSomeValuesFrom(ObjectInverseOf(:R) ObjectMinCardinality(2 :S)))
SubObjectPropertyOf(ObjectPropertyChain(:R :S) :T)
DataPropertyRange(:p DatatypeRestriction(xsd:integer xsd:minInclusive "1"^^xsd:integer))
AnnotationAssertion(:note :A "a \\"quoted\\" text"@en)
HasKey(:A (:R) (:p))
DLSafeRule(Body(ClassAtom(:A Variable(:x)) DataPropertyAtom(:p Variable(:x) Variable(:v))) Head(ClassAtom(:E Variable(:x))))
ClassAssertion(:A :a) DataPropertyAssertion(:p :a "5"^^xsd:integer) ClassAssertion(:B _:n)
)
"""


def test_functional_syntax():
    o = parse(DOC)
    assert o.iri == "urn:onto" and {a.kind for a in o.axioms} >= {"SubClassOf", "HasKey", "Rule", "SubObjectPropertyChain"}
    r = Reasoner(o)
    assert r.is_sub_class_of("urn:A", "urn:D") and r.has_type("urn:a", "urn:E")
    for bad in ("Ontology(Odd(:A))", "Ontology(", 'Prefix(:=<urn:>)\nOntology(SubClassOf(:A ObjectOdd(:R)))'):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        resolve("http://example.org/remote")
    assert resolve("file:/x/y") == "/x/y" and resolve("z", "/x") == "/x/z"


def test_ntriples_as_facts(spark, tmp_path):
    (tmp_path / "t.nt").write_text('<urn:a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:A> .\n# no\n<urn:a> <urn:R> _:b .\n<urn:a> <urn:p> "x y"@en .\n<urn:a> <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<urn:a> <urn:p> "plain" .\n')
    f = facts_of_triples(read_ntriples(spark, str(tmp_path)))
    assert sorted(f) == [("c", "urn:A"), ("d", "urn:p"), ("r", "urn:R")]
    assert sorted(v for _, v in f[("d", "urn:p")].collect())[0].startswith('"5"^^')
    r = Reasoner([ax("SubClassOf", Named("urn:A"), B)], spark=spark, facts=f)
    assert [x for (x,) in r.query({"where": [{"class": N + "B", "arg": "?x"}]}).collect()] == ["urn:a"]
    assert {(x["x"], x["type"]) for x in r.types_frame().collect()} == {("urn:a", "urn:A"), ("urn:a", N + "B")}
    with pytest.raises(ValueError, match="disjunctive"):
        Reasoner([ax("SubClassOf", A, Or((B, C)))], spark=spark).query({"where": [{"class": N + "B", "arg": "?x"}]})


def run(*argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), out, err), out.getvalue(), err.getvalue()


def test_command_line(tmp_path):
    f, g = tmp_path / "o.ofn", tmp_path / "goal.ofn"
    f.write_text(DOC)
    g.write_text("Prefix(:=<urn:>)\nOntology(SubClassOf(:A :D))")
    assert run("-V")[1].startswith("AXIOMILL") and run("--help")[0] == 0
    code, out, _ = run("-c", str(f))
    assert code == 0 and "SubClassOf( <urn:B> <urn:D> )" in out and "owl#Thing" not in out
    assert "Declaration( Class( :A ) )" in run("-c", "-P", str(f))[1]
    assert "satisfiable" in run("-k:A", str(f))[1]
    assert run("-d", "-S", ":A", str(f))[1].splitlines()[1:] == ["\t:D"] or ":D" in run("-d", "-S", ":A", str(f))[1]
    assert run("-s", ":D", str(f))[1].count("\t") >= 3
    assert run("-E", "--conclusion", str(g), str(f))[1] == "true\n"
    assert "Deterministic rules" in run("--dump-clauses", str(f))[1]
    assert ":\turn:" in run("--print-prefixes", str(f))[1]
    assert run("-U", str(f))[1].startswith("Classes equivalent to owl:Nothing")
    o = tmp_path / "out.txt"
    assert run("-o", str(o), "-O", str(f))[0] == 0 and "SubObjectPropertyOf" not in o.read_text()
    for bad in (("--odd", str(f)), ("-E", str(f)), (), ("-o",), ("--block-strategy=odd", str(f)), (str(tmp_path / "none.ofn"), "-c")):
        assert run(*bad)[0] == 1
    assert run("--block-strategy=core", "-c", str(f))[2].startswith("Blocking strategy")
    assert load(str(f)).iri == "urn:onto"


def lit(x, dt=INT):
    return Literal(str(x), dt)


def between(a, b, dt=INT):
    return Restricted(dt, ((XSD + "minInclusive", lit(a)), (XSD + "maxInclusive", lit(b))))


CONSTRAINTS = [
    ([Datatype(INT)], True), ([Datatype(INT), Datatype(XSD + "string")], False), ([Datatype(XSD + "nonNegativeInteger"), Datatype(XSD + "negativeInteger")], False), ([between(1, 3), Datatype(XSD + "byte")], True),
    ([Restricted(INT, ((XSD + "minExclusive", lit(1)), (XSD + "maxExclusive", lit(2))))], False), ([Restricted(XSD + "decimal", ((XSD + "minExclusive", lit(1)), (XSD + "maxExclusive", lit(2))))], True),
    ([Values((lit(1), lit(2))), RangeNot(Values((lit(1),)))], True), ([Values((lit(1),)), RangeNot(Datatype(XSD + "decimal"))], False), ([Datatype(XSD + "byte"), RangeNot(Datatype(INT))], False),
    ([Values((lit("a", XSD + "string"),)), Restricted(XSD + "string", ((XSD + "length", lit(1)),))], True), ([Values((lit("ab", XSD + "string"),)), Restricted(XSD + "string", ((XSD + "length", lit(1)),))], False),
    ([Restricted(XSD + "string", ((XSD + "minLength", lit(5)), (XSD + "maxLength", lit(4))))], False), ([RangeOr((Datatype(XSD + "string"), between(1, 2))), Datatype(INT)], True), ([RangeAnd((between(1, 4), between(5, 6)))], False),
    ([Datatype(XSD + "boolean"), RangeNot(Values((lit("true", XSD + "boolean"),))), RangeNot(Values((lit("0", XSD + "boolean"),)))], False), ([Datatype("urn:unknown"), Datatype(INT)], True),
    ([Restricted(XSD + "dateTime", ((XSD + "minInclusive", lit("2020-01-02T00:00:00Z", XSD + "dateTime")), (XSD + "maxInclusive", lit("2020-01-01T00:00:00Z", XSD + "dateTime"))))], False),
]


@pytest.mark.parametrize("i", range(len(CONSTRAINTS)))
def test_constraints(i):
    parts, want = CONSTRAINTS[i]
    assert satisfiable({"v": parts}, []) is want


def test_unequal_values_are_coloured():
    two = [between(1, 2)]
    assert satisfiable({"a": two, "b": two, "c": two}, [("a", "b"), ("b", "c")])
    assert not satisfiable({"a": two, "b": two, "c": two}, [("a", "b"), ("b", "c"), ("a", "c")])


def test_values_and_facets():
    assert equal(lit(5), lit("5.0", XSD + "decimal")) and not equal(lit(5), lit("5", XSD + "string"))
    assert in_datatype(XSD + "byte", lit(200)) is False and in_datatype(XSD + "double", lit(5)) is True and in_datatype("urn:u", lit(5)) is None
    assert facet_holds("pattern", lit("a+", XSD + "string"), lit("baa", XSD + "string")) is False and facet_holds("odd", lit(1), lit(1)) is None
    assert facet_holds("totalDigits", lit(3), lit("012.3", XSD + "decimal")) is True and facet_holds("fractionDigits", lit(1), lit("1.25", XSD + "decimal")) is False
    assert member(RangeNot(Datatype("urn:u")), lit(1)) is None
    assert All and DataSome and Min and OneOf


def test_model_description_and_answers_one_by_one(spark):
    r = Reasoner([ax("SubClassOf", A, Some(Role(N + "R"), B)), ax("ClassAssertion", A, "a"), ax("SameIndividual", "a", "b")], spark=spark)
    text = r.describe_model()
    assert "a=b: urn:A" in text and "  urn:R -> _" in text
    from axiomill.plans.conjunctive import each

    got = []
    assert each(r.program(), {"where": [{"class": N + "A", "arg": "?x"}]}, got.append) == 1 and got == [("a",)]
