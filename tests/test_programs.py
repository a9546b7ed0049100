"""Rule programs, conjunctive queries, merging, clashes, realisation and changes, on fixtures with known answers and against a naive evaluator."""

import itertools
import random

import pytest

from axiomill.model.expressions import XSD, All, And, Datatype, DataSome, Individual, Literal, Max, Named, Not, OneOf, Or, Restricted, Role, Some, axiom
from axiomill.plans.conjunctive import answer
from axiomill.plans.horn import compile_horn
from axiomill.plans.program import Inconsistent, Program
from axiomill.plans.realise import class_hierarchy, node_sets, types
from axiomill.streaming.changes import Materialized, stream_into

N = "urn:"
INT = XSD + "integer"


def A(kind, *args):
    return axiom(kind, *args)


def C(x):
    return Named(N + x)


def R(x):
    return Role(N + x)


def ask(p, where, select=None, **k):
    return sorted(map(tuple, answer(p, {"where": where, "select": select}, **k).collect()))


def program(spark, *axioms, facts=None, **k):
    return Program(spark, compile_horn(axioms), facts or {}, **k)


def cls(c, x="?x"):
    return {"class": N + c, "arg": x}


def rel(r, a, b):
    return {"object_property": N + r, "subject": a, "object": b}


def edges(r, text):
    return [A("ObjectPropertyAssertion", N + r, *e.split("-")) for e in text.split()]


def test_recursive_classes(spark):
    p = program(
        spark, A("SubClassOf", Some(R("R"), C("A")), C("A")), A("SubClassOf", Some(R("R"), C("B")), C("B")), A("SubClassOf", And((C("A"), C("B"))), C("C")),
        A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("B"), "k"), *edges("R", "b-a c-b d-c l-k m-l c-m n-c"),
    )
    assert [x for (x,) in ask(p, [cls("A")])] == list("abcdn")
    assert [x for (x,) in ask(p, [cls("B")])] == list("cdklmn")
    assert [x for (x,) in ask(p, [cls("C")])] == list("cdn")
    assert len(ask(p, [rel("R", "?x", "?y")])) == 7


def test_functional_roles_merge(spark):
    p = program(spark, A("FunctionalObjectProperty", N + "R"), *edges("R", "b-a b-c d-c d-e f-e f-g"))
    assert p.equivalence_class("e") == ["a", "c", "e", "g"]
    assert ask(p, [rel("R", "?x", "?y")]) == [("b", "a"), ("d", "a"), ("f", "a")]
    assert p.equivalence_class("nobody") is None
    assert node_sets(p, answer(p, {"where": [rel("R", "b", "?y")]})).first()["members"] == ["a", "c", "e", "g"]


def test_ground_equality(spark):
    p = program(spark, *edges("R", "c-b d-e"), *edges("S", "c-a d-f"), A("SameIndividual", "a", "b"))
    assert ask(p, [rel("R", "?x", "a")]) == ask(p, [rel("S", "?x", "b")]) == [("c",)]


def test_existentials_make_no_facts(spark):
    p = program(spark, A("SubClassOf", C("A"), Some(R("R"), C("B"))), A("ClassAssertion", C("A"), "a"))
    assert ask(p, [cls("A")]) == [("a",)]
    assert ask(p, [rel("R", "?x", "?y")]) == []
    assert p.horn.obligations


def test_query_forms(spark):
    p = program(spark, A("SubClassOf", C("A"), C("B")), A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("B"), "c"), *edges("R", "a-b b-c"))
    assert ask(p, [cls("B")]) == [("a",), ("c",)]
    assert ask(p, [{"inverse_object_property": N + "R", "subject": "?x", "object": "?y"}]) == [("b", "a"), ("c", "b")]
    assert ask(p, [rel("R", "?x", "?y"), rel("R", "?y", "?z")], ["?x", "?z"]) == [("a", "c")]
    assert ask(p, [rel("R", "a", "?y")]) == [("b",)]
    assert ask(p, [rel("R", "a", "b")], []) == [("true",)]
    assert ask(p, [rel("R", "b", "a")], []) == []
    assert ask(p, [rel("R", "?x", "?x")]) == []
    assert ask(p, [cls("A")], ["?x", "urn:const"]) == [("a", "urn:const")]
    assert ask(p, [cls("Unknown")]) == ask(p, [rel("R", "unknown", "?y")]) == []
    for bad in ({"where": []}, {"where": [{"same_as": ["?x", "?y"]}]}, {"where": [cls("A")], "select": ["?y"]}, {"where": [{"odd": 1}]}):
        with pytest.raises(ValueError):
            answer(p, bad)


def test_literals_match_as_written(spark):
    p = program(spark, A("DataPropertyAssertion", N + "age", "a", Literal("42", INT)), A("DataPropertyAssertion", N + "age", "b", Literal.of("bob", lang="en")), A("DataPropertyRange", N + "age", Datatype(INT)))
    age = {"data_property": N + "age", "subject": "?x", "value": "?v"}
    assert ask(p, [age], check=False) == [("a", f'"42"^^<{INT}>'), ("b", '"bob@en"^^<http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral>')]
    assert ask(p, [age | {"value": Literal("42", INT)}], check=False) == [("a",)]
    assert ask(p, [age | {"value": Literal("42")}], check=False) == []
    assert ask(p, [{"datatype": INT, "arg": "?v"}], check=False)


def test_different_from_in_both_orientations_or_as_stored(spark):
    own = [A("DifferentIndividuals", "a", "b")]
    where = [{"different_from": ["?x", "?y"]}]
    assert ask(program(spark, *own), where) == [("a", "b"), ("b", "a")]
    assert ask(program(spark, *own, symmetric_different=False), where) == [("a", "b")]


CLASHES = [
    [A("DisjointClasses", C("A"), C("B")), A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("B"), "a")],
    [A("IrreflexiveObjectProperty", N + "R"), *edges("R", "a-a")], [A("AsymmetricObjectProperty", N + "R"), *edges("R", "a-b b-a")],
    [A("DisjointObjectProperties", N + "R", N + "S"), *edges("R", "a-b"), *edges("S", "a-b")],
    [A("NegativeObjectPropertyAssertion", N + "R", "a", "b"), *edges("R", "a-b")],
    [A("FunctionalObjectProperty", N + "R"), *edges("R", "a-b a-c"), A("DifferentIndividuals", "b", "c")],
    [A("FunctionalDataProperty", N + "p"), A("DataPropertyAssertion", N + "p", "a", Literal("1", INT)), A("DataPropertyAssertion", N + "p", "a", Literal("2", INT))],
    [A("DataPropertyRange", N + "p", Restricted(INT, ((XSD + "minInclusive", Literal("5", INT)),))), A("DataPropertyAssertion", N + "p", "a", Literal("4", INT))],
    [A("NegativeDataPropertyAssertion", N + "p", "a", Literal("1", INT)), A("DataPropertyAssertion", N + "p", "a", Literal("1.0", XSD + "decimal"))],
    [A("DisjointDataProperties", N + "p", N + "q"), A("DataPropertyAssertion", N + "p", "a", Literal("1", INT)), A("DataPropertyAssertion", N + "q", "a", Literal("01", INT))],
    [A("SubClassOf", C("A"), All(R("R"), Not(C("B")))), A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("B"), "b"), *edges("R", "a-b")],
    [A("ClassAssertion", Not(C("A")), "a"), A("ClassAssertion", C("A"), "a")],
]


@pytest.mark.parametrize("i", range(len(CLASHES)))
def test_clashes_and_their_absence(spark, i):
    p = program(spark, *CLASHES[i])
    assert not p.is_consistent()
    with pytest.raises(Inconsistent):
        answer(p, {"where": [cls("A")]})
    assert program(spark, *CLASHES[i][:-1]).is_consistent()


def test_keys_merge_named_individuals_by_value(spark):
    p = program(spark, A("HasKey", C("A"), [N + "R"], [N + "p"]), *(A("ClassAssertion", C("A"), x) for x in "abc"), *edges("R", "a-o b-o c-o"), *(A("DataPropertyAssertion", N + "p", x, Literal(v, INT)) for x, v in (("a", "1"), ("b", "01"), ("c", "2"))))
    assert p.equivalence_class("b") == ["a", "b"] and p.equivalence_class("c") == ["c"]


def test_horn_gate():
    assert not compile_horn([A("SubClassOf", C("A"), Or((C("B"), C("C"))))]).is_horn
    assert not compile_horn([A("SubClassOf", C("A"), Max(2, R("R")))]).is_horn
    assert compile_horn([A("SubClassOf", C("A"), Or((Not(C("B")), C("C"))))]).is_horn
    assert compile_horn([A("SubClassOf", C("A"), OneOf((Individual("a"),)))]).is_horn
    with pytest.raises(ValueError, match="unsupported"):
        axiom("Odd")


def test_rules_and_their_safety(spark):
    body = (("class", N + "A", "?x"), ("data", N + "p", "?x", "?v"), ("range", Restricted(INT, ((XSD + "maxInclusive", Literal("9", INT)),)), "?v"))
    p = program(spark, A("Rule", body, (("class", N + "B", "?x"), ("object", N + "R", "?x", "?x"))), A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("A"), "b"), A("DataPropertyAssertion", N + "p", "a", Literal("7", INT)), A("DataPropertyAssertion", N + "p", "b", Literal("70", INT)))
    assert ask(p, [cls("B")]) == [("a",)] and ask(p, [rel("R", "?x", "?y")]) == [("a", "a")]
    with pytest.raises(ValueError, match="not bound"):
        compile_horn([A("Rule", (("range", Datatype(INT), "?v"),), (("class", N + "B", "?x"),))])


def test_types_and_hierarchy(spark):
    p = program(spark, A("SubClassOf", C("A"), C("B")), A("SubClassOf", C("B"), C("C")), A("EquivalentClasses", C("C"), C("D")), A("ClassAssertion", C("A"), "a"), A("ClassAssertion", C("D"), "d"))
    assert sorted(map(tuple, types(p, direct=True).collect())) == [("a", N + "A"), ("d", N + "C")]
    assert types(p).count() == 6
    told = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("c", "d")], "child string, parent string")
    equiv, direct = class_hierarchy(told)
    assert dict(equiv.collect()) == {"a": "a", "b": "b", "c": "b", "d": "d"}
    assert sorted(map(tuple, direct.collect())) == [("a", "b"), ("b", "d")]


def naive(rules, facts):
    """All consequences of atoms (pred, args) by brute force over the active domain."""
    facts = set(facts)
    while True:
        dom = {t for _, args in facts for t in args}
        new = set()
        for body, head in rules:
            vs = sorted({t for _, args in [*body, head] for t in args})
            for combo in itertools.product(dom, repeat=len(vs)):
                b = dict(zip(vs, combo, strict=True))
                if all((q, tuple(b[t] for t in args)) in facts for q, args in body):
                    new.add((head[0], tuple(b[t] for t in head[1])))
        if new <= facts:
            return facts
        facts |= new


@pytest.mark.parametrize("seed", range(4))
def test_random_programs_equal_naive_evaluation(spark, seed):
    r = random.Random(seed)
    axioms, rules = [], []
    for _ in range(5):
        k = r.randrange(6)
        a, b, c, s, t = (r.choice("ABC"), r.choice("ABC"), r.choice("ABC"), r.choice("RS"), r.choice("RS"))
        if k == 0:
            axioms.append(A("SubClassOf", C(a), C(b)))
            rules.append(([(a, "x")], (b, "x")))
        elif k == 1:
            axioms.append(A("SubClassOf", Some(R(s), C(a)), C(b)))
            rules.append(([(s, "xy"), (a, "y")], (b, "x")))
        elif k == 2:
            axioms.append(A("SubClassOf", And((C(a), C(b))), C(c)))
            rules.append(([(a, "x"), (b, "x")], (c, "x")))
        elif k == 3:
            axioms.append(A("SubObjectPropertyChain", [N + s, N + t], N + s))
            rules.append(([(s, "xy"), (t, "yz")], (s, "xz")))
        elif k == 4:
            axioms.append(A("SubObjectPropertyOf", R(s), R(t).inverse()))
            rules.append(([(s, "xy")], (t, "yx")))
        else:
            axioms.append(A("SubClassOf", C(a), All(R(s), C(b))))
            rules.append(([(a, "x"), (s, "xy")], (b, "y")))
    facts = {(r.choice("ABC"), (f"n{r.randrange(6)}",)) for _ in range(4)} | {(r.choice("RS"), (f"n{r.randrange(6)}", f"n{r.randrange(6)}")) for _ in range(7)}
    axioms += [A("ClassAssertion", C(q), *args) if len(args) == 1 else A("ObjectPropertyAssertion", N + q, *args) for q, args in facts]
    p, want = program(spark, *axioms), naive([([(q, tuple(v)) for q, v in body], (h, tuple(w))) for body, (h, w) in rules], facts)
    for q in "ABC":
        assert {("%s" % x,) for (x,) in ask(p, [cls(q)])} == {args for pred, args in want if pred == q}
    for q in "RS":
        assert set(ask(p, [rel(q, "?x", "?y")])) == {args for pred, args in want if pred == q}


def test_insertion_and_deletion_equal_rebuilding(spark):
    axioms = [A("SubClassOf", Some(R("R"), C("A")), C("A")), A("ClassAssertion", C("A"), "n0")]
    frame = lambda rows: spark.createDataFrame(rows, "s string, o string")
    first, second = [("n1", "n0"), ("n3", "n2")], [("n2", "n1"), ("n4", "n3")]
    m = Materialized(Program(spark, compile_horn(axioms), {("r", N + "R"): frame(first)}), [("c", N + "A")])
    assert m.incremental
    m.insert({("r", N + "R"): frame(second)})
    assert sorted(x for (x,) in m.extension(("c", N + "A")).collect()) == ["n0", "n1", "n2", "n3", "n4"]
    m.delete({("r", N + "R"): frame([("n1", "n0")])})
    assert [x for (x,) in m.extension(("c", N + "A")).collect()] == ["n0"]


def test_streamed_changes(spark, tmp_path):
    axioms = [A("SubClassOf", Some(R("R"), C("A")), C("A")), A("ClassAssertion", C("A"), "n0")]
    rows = spark.createDataFrame([("r", N + "R", "n1", "n0", "insert"), ("r", N + "R", "n2", "n1", "insert")], "kind string, predicate string, a string, b string, op string")
    rows.write.parquet(str(tmp_path / "in"))
    m = Materialized(Program(spark, compile_horn(axioms), {("r", N + "R"): spark.createDataFrame([], "s string, o string")}), [("c", N + "A")])
    q = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    s = stream_into(q, m, str(tmp_path / "ck"))
    s.processAllAvailable()
    s.stop()
    assert sorted(x for (x,) in m.extension(("c", N + "A")).collect()) == ["n0", "n1", "n2"]


def test_empty_bodies_and_facet_conditions(spark):
    p = program(spark, A("SubClassOf", DataSome(N + "p", Restricted(XSD + "string", ((XSD + "pattern", Literal("a+")),))), C("B")), A("DataPropertyAssertion", N + "p", "x", Literal("aaa")), A("DataPropertyAssertion", N + "p", "y", Literal("baa")))
    assert ask(p, [cls("B")]) == [("x",)]


def test_ntriples_escapes_and_bad_lines(spark, tmp_path):
    from axiomill.sources.functional import read_ntriples

    f = tmp_path / "a.nt"
    f.write_text('<urn:a> <urn:p> "tab\\t quote\\" e\\u00e9" .\n# note\n\n<urn:a> <urn:q> <urn:b> .\n')
    rows = {r["p"]: r["o"] for r in read_ntriples(spark, str(f)).collect()}
    assert rows == {"urn:p": '"tab\t quote" e\u00e9"^^<http://www.w3.org/2001/XMLSchema#string>', "urn:q": "urn:b"}
    f.write_text("<urn:a> <urn:p> .\n<urn:a> <urn:q> <urn:b> .\n")
    assert read_ntriples(spark, str(f), strict=False).count() == 1
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(f)).collect()
