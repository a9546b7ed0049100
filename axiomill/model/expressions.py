"""Entities, class expressions, data ranges and axioms as immutable values.

Everything here is TBox-sized and lives on the driver; assertions in bulk are DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD, OWL, RDF, RDFS = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
PLAIN = RDF + "PlainLiteral"


@dataclass(frozen=True, order=True)
class Literal:
    """A constant: lexical form and datatype. A language tag folds into ``lex@tag`` of rdf:PlainLiteral; untyped is xsd:string."""

    lex: str
    datatype: str = XSD + "string"

    @staticmethod
    def of(lex: Any, datatype: str | None = None, lang: str | None = None) -> Literal:
        if lang:
            return Literal(f"{lex}@{lang}", PLAIN)
        return Literal(str(lex), datatype or XSD + "string")

    def render(self) -> str:
        return f'"{self.lex}"^^<{self.datatype}>'


@dataclass(frozen=True, order=True)
class Individual:
    iri: str
    anonymous: bool = False


@dataclass(frozen=True, order=True)
class Role:
    """An object property or its inverse."""

    iri: str
    inverted: bool = False

    def inverse(self) -> Role:
        return Role(self.iri, not self.inverted)


# ------------------------------------------------------------------ class expressions


class Expr:
    """A class expression."""


@dataclass(frozen=True, order=True)
class Named(Expr):
    iri: str


THING, NOTHING = Named(OWL + "Thing"), Named(OWL + "Nothing")
TOP_ROLE, BOTTOM_ROLE = OWL + "topObjectProperty", OWL + "bottomObjectProperty"
TOP_DATA, BOTTOM_DATA = OWL + "topDataProperty", OWL + "bottomDataProperty"


@dataclass(frozen=True)
class And(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Some(Expr):
    role: Role
    of: Expr


@dataclass(frozen=True)
class All(Expr):
    role: Role
    of: Expr


@dataclass(frozen=True)
class HasValue(Expr):
    role: Role
    of: Individual


@dataclass(frozen=True)
class OneOf(Expr):
    members: tuple[Individual, ...]


@dataclass(frozen=True)
class HasSelf(Expr):
    role: Role


@dataclass(frozen=True)
class Min(Expr):
    n: int
    role: Role
    of: Expr = THING


@dataclass(frozen=True)
class Max(Expr):
    n: int
    role: Role
    of: Expr = THING


def exactly(n: int, role: Role, of: Expr = THING) -> Expr:
    return And((Min(n, role, of), Max(n, role, of)))


# ------------------------------------------------------------------ data ranges


class Range:
    """A data range."""


@dataclass(frozen=True, order=True)
class Datatype(Range):
    iri: str


ANY_LITERAL = Datatype(RDFS + "Literal")


@dataclass(frozen=True)
class Restricted(Range):
    """A datatype with facets: (facet name, literal) pairs."""

    datatype: str
    facets: tuple[tuple[str, Literal], ...]


@dataclass(frozen=True)
class Values(Range):
    literals: tuple[Literal, ...]


@dataclass(frozen=True)
class RangeAnd(Range):
    parts: tuple[Range, ...]


@dataclass(frozen=True)
class RangeOr(Range):
    parts: tuple[Range, ...]


@dataclass(frozen=True)
class RangeNot(Range):
    of: Range


@dataclass(frozen=True)
class DataSome(Expr):
    prop: str
    of: Range


@dataclass(frozen=True)
class DataAll(Expr):
    prop: str
    of: Range


@dataclass(frozen=True)
class DataMin(Expr):
    n: int
    prop: str
    of: Range = ANY_LITERAL


@dataclass(frozen=True)
class DataMax(Expr):
    n: int
    prop: str
    of: Range = ANY_LITERAL


def data_has_value(prop: str, value: Literal) -> Expr:
    return DataSome(prop, Values((value,)))


def data_exactly(n: int, prop: str, of: Range = ANY_LITERAL) -> Expr:
    return And((DataMin(n, prop, of), DataMax(n, prop, of)))


# ------------------------------------------------------------------ axioms


@dataclass(frozen=True)
class Axiom:
    """An axiom: its kind (OWL 2 name) and arguments in the order of the functional syntax."""

    kind: str
    args: tuple = field(default=())


#: OWL 2 axiom kinds (fixed names)
CLASS_AXIOMS = ("SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion")
OBJECT_AXIOMS = (
    "SubObjectPropertyOf", "SubObjectPropertyChain", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "ObjectPropertyDomain",
    "ObjectPropertyRange", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty",
    "SymmetricObjectProperty", "AsymmetricObjectProperty", "TransitiveObjectProperty",
)
DATA_AXIOMS = ("SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "DataPropertyDomain", "DataPropertyRange", "FunctionalDataProperty", "DatatypeDefinition")
ASSERTIONS = (
    "ClassAssertion", "ObjectPropertyAssertion", "NegativeObjectPropertyAssertion", "DataPropertyAssertion", "NegativeDataPropertyAssertion", "SameIndividual", "DifferentIndividuals",
)
OTHER_AXIOMS = ("HasKey", "Rule", "Declaration", "AnnotationAssertion", "Import")
ALL_AXIOMS = CLASS_AXIOMS + OBJECT_AXIOMS + DATA_AXIOMS + ASSERTIONS + OTHER_AXIOMS


def named(iri: str | Expr) -> Expr:
    return Named(iri) if isinstance(iri, str) else iri


def role(iri: str | Role) -> Role:
    return Role(iri) if isinstance(iri, str) else iri


def ind(iri: str | Individual) -> Individual:
    return Individual(iri) if isinstance(iri, str) else iri


def axiom(kind: str, *args) -> Axiom:
    """An axiom from plain values: strings become entities where the kind says which.

    >>> axiom("SubClassOf", "urn:A", "urn:B")
    """
    if kind not in ALL_AXIOMS:
        raise ValueError(f"unsupported axiom type {kind}")
    if kind in ("SubClassOf", "EquivalentClasses", "DisjointClasses"):
        out = tuple(named(a) for a in args)
        if kind != "SubClassOf" and len(out) < 2:
            raise ValueError(f"{kind} needs two or more classes")
    elif kind == "DisjointUnion":
        out = (named(args[0]), *(named(a) for a in args[1:]))
    elif kind in ("ObjectPropertyDomain", "ObjectPropertyRange"):
        out = (role(args[0]), named(args[1]))
    elif kind == "SubObjectPropertyChain":
        chain, sup = args
        if not chain:
            raise ValueError("a property chain must not be empty")
        out = (tuple(role(r) for r in chain), role(sup))
    elif kind in OBJECT_AXIOMS:
        out = tuple(role(a) for a in args)
    elif kind == "DataPropertyDomain":
        out = (args[0], named(args[1]))
    elif kind == "ClassAssertion":
        out = (named(args[0]), ind(args[1]))
    elif kind in ("ObjectPropertyAssertion", "NegativeObjectPropertyAssertion"):
        out = (role(args[0]), ind(args[1]), ind(args[2]))
    elif kind in ("DataPropertyAssertion", "NegativeDataPropertyAssertion"):
        out = (args[0], ind(args[1]), args[2])
    elif kind in ("SameIndividual", "DifferentIndividuals"):
        out = tuple(ind(a) for a in args)
        if kind == "SameIndividual" and any(i.anonymous for i in out):
            raise ValueError("SameIndividual with anonymous individuals is not supported")
    elif kind == "HasKey":
        cls, objects, datas = args
        out = (named(cls), tuple(role(r) for r in objects), tuple(datas))
    else:
        out = tuple(args)
    return Axiom(kind, out)


# ------------------------------------------------------------------ normal form


def nnf(c: Expr, negated: bool = False) -> Expr:
    """Negation normal form with constant folding: negation stands before names, nominals and self only."""
    if isinstance(c, Named):
        if c == THING:
            return NOTHING if negated else THING
        if c == NOTHING:
            return THING if negated else NOTHING
        return Not(c) if negated else c
    if isinstance(c, Not):
        return nnf(c.of, not negated)
    if isinstance(c, (And, Or)):
        parts = [nnf(p, negated) for p in c.parts]
        return conj(parts) if isinstance(c, And) != negated else disj(parts)
    if isinstance(c, (Some, All)):
        of = nnf(c.of, negated)
        if isinstance(c, Some) != negated:
            return NOTHING if of == NOTHING else Some(c.role, of)
        return THING if of == THING else All(c.role, of)
    if isinstance(c, HasValue):
        return nnf(Some(c.role, OneOf((c.of,))), negated)
    if isinstance(c, OneOf):
        if not c.members:
            return THING if negated else NOTHING
        return Not(c) if negated else c
    if isinstance(c, HasSelf):
        return Not(c) if negated else c
    if isinstance(c, Min):
        if negated:
            return NOTHING if c.n == 0 else nnf(Max(c.n - 1, c.role, c.of))
        return THING if c.n == 0 else nnf(Some(c.role, c.of)) if c.n == 1 else Min(c.n, c.role, nnf(c.of))
    if isinstance(c, Max):
        if negated:
            return nnf(Min(c.n + 1, c.role, c.of))
        of = nnf(c.of)
        return THING if of == NOTHING else nnf(All(c.role, Not(of))) if c.n == 0 else Max(c.n, c.role, of)
    if isinstance(c, (DataSome, DataAll)):
        of = range_nnf(c.of, negated)
        return DataSome(c.prop, of) if isinstance(c, DataSome) != negated else DataAll(c.prop, of)
    if isinstance(c, DataMin):
        if negated:
            return NOTHING if c.n == 0 else nnf(DataMax(c.n - 1, c.prop, c.of))
        return THING if c.n == 0 else DataSome(c.prop, range_nnf(c.of)) if c.n == 1 else DataMin(c.n, c.prop, range_nnf(c.of))
    if isinstance(c, DataMax):
        if negated:
            return nnf(DataMin(c.n + 1, c.prop, c.of))
        return DataAll(c.prop, range_nnf(c.of, True)) if c.n == 0 else DataMax(c.n, c.prop, range_nnf(c.of))
    raise TypeError(f"not a class expression: {c!r}")


def range_nnf(r: Range, negated: bool = False) -> Range:
    if isinstance(r, RangeNot):
        return range_nnf(r.of, not negated)
    if isinstance(r, (RangeAnd, RangeOr)):
        parts = tuple(range_nnf(p, negated) for p in r.parts)
        return RangeAnd(parts) if isinstance(r, RangeAnd) != negated else RangeOr(parts)
    return RangeNot(r) if negated else r


def conj(parts) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        for q in p.parts if isinstance(p, And) else (p,):
            if q == NOTHING:
                return NOTHING
            if q != THING and q not in flat:
                flat.append(q)
    return THING if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def disj(parts) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        for q in p.parts if isinstance(p, Or) else (p,):
            if q == THING:
                return THING
            if q != NOTHING and q not in flat:
                flat.append(q)
    return NOTHING if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def walk(x):
    """Every expression, range, role and individual within a value."""
    yield x
    if isinstance(x, (And, Or, RangeAnd, RangeOr)):
        for p in x.parts:
            yield from walk(p)
    elif isinstance(x, (Not, RangeNot)):
        yield from walk(x.of)
    elif isinstance(x, (Some, All, Min, Max, HasValue)):
        yield x.role
        yield from walk(x.of)
    elif isinstance(x, HasSelf):
        yield x.role
    elif isinstance(x, OneOf):
        yield from x.members
    elif isinstance(x, (DataSome, DataAll, DataMin, DataMax)):
        yield from walk(x.of)
    elif isinstance(x, Axiom):
        for a in x.args:
            yield from walk(a)
    elif isinstance(x, tuple):
        for a in x:
            yield from walk(a)
