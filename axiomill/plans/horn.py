"""Axioms to Horn rules.

A rule is a conjunction of atoms with one head atom (or none: a clash). What cannot be a Horn rule is collected as
``non_horn``; what asks for a witness that no fact gives is collected as ``obligations``. Both are the kernel's business.

Atoms are tuples: ("c", class, x), ("r", property, x, y), ("d", property, x, v), ("g", datatype, v), ("in" / "out", range, v),
("eq", x, y), ("ne", x, y), ("vne", v, w), ("key", property, x, k), ("thing", x), ("named", x).
Terms: "?x" variables, Individual and Literal constants.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from ..model import expressions as E


@dataclass(frozen=True)
class Rule:
    body: tuple
    head: tuple | None
    label: str = ""


class NotHorn(Exception):
    pass


@dataclass
class Horn:
    rules: list[Rule] = field(default_factory=list)
    non_horn: list[E.Axiom] = field(default_factory=list)
    obligations: list[tuple] = field(default_factory=list)
    facts: list[tuple] = field(default_factory=list)
    negative: list[tuple] = field(default_factory=list)
    definitions: dict[str, E.Range] = field(default_factory=dict)
    classes: set[str] = field(default_factory=set)
    roles: set[str] = field(default_factory=set)
    datas: set[str] = field(default_factory=set)

    @property
    def is_horn(self) -> bool:
        return not self.non_horn


def plain_atoms(atoms) -> list[tuple]:
    """The same conjunction without atoms of the top role: it holds between any two individuals, so both ends only have to be some."""
    out: list[tuple] = []
    for a in atoms:
        out += [("thing", a[2]), ("thing", a[3])] if a[0] == "r" and a[1] == E.TOP_ROLE else [a]
    return list(dict.fromkeys(out))


class Compiler:
    def __init__(self, axioms):
        self.out, self.fresh = Horn(), itertools.count()
        self.functional = {a.args[0] for a in axioms if a.kind == "FunctionalObjectProperty"} | {a.args[0].inverse() for a in axioms if a.kind == "InverseFunctionalObjectProperty"}
        for a in axioms:
            self.signature(a)
            mark = len(self.out.rules), len(self.out.obligations), len(self.out.facts)
            try:
                self.axiom(a)
            except NotHorn:
                del self.out.rules[mark[0] :], self.out.obligations[mark[1] :], self.out.facts[mark[2] :]
                self.out.non_horn.append(a)

    def signature(self, a: E.Axiom) -> None:
        for x in E.walk(a):
            if isinstance(x, E.Named):
                self.out.classes.add(x.iri)
            elif isinstance(x, E.Role):
                self.out.roles.add(x.iri)
            elif isinstance(x, (E.DataSome, E.DataAll, E.DataMin, E.DataMax)):
                self.out.datas.add(x.prop)
        if a.kind in E.DATA_AXIOMS and a.kind != "DatatypeDefinition" or a.kind.endswith("DataPropertyAssertion"):
            self.out.datas.update(x for x in a.args if isinstance(x, str))
        if a.kind == "HasKey":
            self.out.datas.update(a.args[2])

    def var(self, hint: str = "y") -> str:
        return f"?_{hint}{next(self.fresh)}"

    # ---------------------------------------------------------- atoms

    @staticmethod
    def role_atom(r: E.Role, x, y) -> tuple:
        return ("r", r.iri, y, x) if r.inverted else ("r", r.iri, x, y)

    def bodies(self, c: E.Expr, x) -> list[list[tuple]]:
        """A condition as alternatives of atom lists."""
        if c == E.THING:
            return [[]]
        if c == E.NOTHING:
            return []
        if isinstance(c, E.Named):
            return [[("c", c.iri, x)]]
        if isinstance(c, E.And):
            return [[a for part in combo for a in part] for combo in itertools.product(*(self.bodies(p, x) for p in c.parts))]
        if isinstance(c, E.Or):
            return [b for p in c.parts for b in self.bodies(p, x)]
        if isinstance(c, E.Some):
            if isinstance(c.of, E.OneOf):
                return [[self.role_atom(c.role, x, m)] for m in c.of.members]
            y = self.var()
            return [[self.role_atom(c.role, x, y), *b] for b in self.bodies(c.of, y)]
        if isinstance(c, E.OneOf):
            return [[("eq", x, m)] for m in c.members]
        if isinstance(c, E.HasSelf):
            return [[("r", c.role.iri, x, x)]]
        if isinstance(c, E.Min):
            ys = [self.var() for _ in range(c.n)]
            out = [[]]
            for y in ys:
                out = [[*o, self.role_atom(c.role, x, y), *b] for o in out for b in self.bodies(c.of, y)]
            return [[*o, *(("ne", a, b) for a, b in itertools.combinations(ys, 2))] for o in out]
        if isinstance(c, E.DataSome):
            if isinstance(c.of, E.Values) and len(c.of.literals) == 1:
                v = self.var("v")
                return [[("d", c.prop, x, v), ("in", c.of, v)]]
            v = self.var("v")
            return [[("d", c.prop, x, v), *([] if c.of == E.ANY_LITERAL else [("in", c.of, v)])]]
        if isinstance(c, E.DataMin):
            vs = [self.var("v") for _ in range(c.n)]
            atoms = [a for v in vs for a in [("d", c.prop, x, v), *([] if c.of == E.ANY_LITERAL else [("in", c.of, v)])]]
            return [[*atoms, *(("vne", a, b) for a, b in itertools.combinations(vs, 2))]]
        raise NotHorn(c)

    def heads(self, c: E.Expr, x, body: list[tuple], label: str) -> None:
        """A consequence as rules."""
        if c == E.THING:
            return
        if c == E.NOTHING:
            self.rule(body, None, label)
        elif isinstance(c, E.Named):
            self.rule(body, ("c", c.iri, x), label)
        elif isinstance(c, E.And):
            for p in c.parts:
                self.heads(p, x, body, label)
        elif isinstance(c, E.All):
            y = self.var()
            self.heads(c.of, y, [*body, self.role_atom(c.role, x, y)], label)
        elif isinstance(c, E.Not):
            for b in self.bodies(c.of, x):
                self.rule([*body, *b], None, label)
        elif isinstance(c, E.Or):
            rest, bodies = [], [body]
            for p in c.parts:
                try:
                    neg = self.bodies(E.nnf(p, True), x)
                except NotHorn:
                    rest.append(p)
                    continue
                if isinstance(p, (E.Not, E.All, E.Max, E.DataAll, E.DataMax)) and not (isinstance(p, E.All) and not rest and p is c.parts[-1] and len(rest) == 0):
                    bodies = [[*b, *n] for b in bodies for n in neg]
                else:
                    rest.append(p)
            if len(rest) > 1:
                raise NotHorn(c)
            for b in bodies:
                self.heads(rest[0] if rest else E.NOTHING, x, b, label)
        elif isinstance(c, E.Some):
            if isinstance(c.of, E.OneOf) and len(c.of.members) == 1:
                self.rule(body, self.role_atom(c.role, x, c.of.members[0]), label)
            else:
                self.out.obligations.append((tuple(body), c, x))
                if c.role in self.functional and c.of != E.THING:  # a filler that is there already is the witness
                    y = self.var()
                    self.heads(c.of, y, [*body, self.role_atom(c.role, x, y)], label)
        elif isinstance(c, (E.Min, E.DataMin)):
            self.out.obligations.append((tuple(body), c, x))
        elif isinstance(c, E.OneOf):
            if len(c.members) != 1:
                raise NotHorn(c)
            self.rule(body, ("eq", x, c.members[0]), label)
        elif isinstance(c, E.HasSelf):
            self.rule(body, ("r", c.role.iri, x, x), label)
        elif isinstance(c, E.Max):
            if c.n != 1:
                raise NotHorn(c)
            y, z = self.var(), self.var()
            for b in self.bodies(c.of, y):
                for d in self.bodies(c.of, z):
                    self.rule([*body, self.role_atom(c.role, x, y), *b, self.role_atom(c.role, x, z), *d], ("eq", y, z), label)
        elif isinstance(c, E.DataSome):
            if isinstance(c.of, E.Values) and len(c.of.literals) == 1:
                self.rule(body, ("d", c.prop, x, c.of.literals[0]), label)
            else:
                self.out.obligations.append((tuple(body), c, x))
        elif isinstance(c, E.DataAll):
            v = self.var("v")
            self.rule([*body, ("d", c.prop, x, v), ("out", c.of, v)], None, label)
            if isinstance(c.of, E.Datatype):
                self.rule([*body, ("d", c.prop, x, v)], ("g", c.of.iri, v), label)
        elif isinstance(c, E.DataMax):
            vs = [self.var("v") for _ in range(c.n + 1)]
            atoms = [a for v in vs for a in [("d", c.prop, x, v), *([] if c.of == E.ANY_LITERAL else [("in", c.of, v)])]]
            self.rule([*body, *atoms, *(("vne", a, b) for a, b in itertools.combinations(vs, 2))], None, label)
        else:
            raise NotHorn(c)

    def rule(self, body, head, label: str) -> None:
        if head and (head[0] == "r" and head[1] == E.TOP_ROLE or head[0] == "d" and head[1] == E.TOP_DATA):
            return
        body = plain_atoms(body)
        bound = {t for a in body if a[0] not in ("eq", "ne", "vne", "in", "out", "named") for t in a[1:] if isinstance(t, str) and t.startswith("?")}
        for t in (head or ())[1:]:
            if isinstance(t, str) and t.startswith("?") and t not in bound:
                body.append(("thing", t))
                bound.add(t)
        self.out.rules.append(Rule(tuple(body), head, label))

    # ---------------------------------------------------------- axioms

    def axiom(self, a: E.Axiom) -> None:
        k, z = a.kind, a.args
        x, y = "?x", "?y"
        if k == "SubClassOf":
            self.include(z[0], z[1], k)
        elif k == "EquivalentClasses":
            for p, q in zip(z, z[1:] + z[:1], strict=True):
                self.include(p, q, k)
        elif k == "DisjointClasses":
            for p, q in itertools.combinations(z, 2):
                self.include(E.And((p, q)), E.NOTHING, k)
        elif k == "DisjointUnion":
            for p in z[1:]:
                self.include(p, z[0], k)
            for p, q in itertools.combinations(z[1:], 2):
                self.include(E.And((p, q)), E.NOTHING, k)
            self.include(z[0], E.Or(z[1:]), k)
        elif k == "SubObjectPropertyOf":
            if z[0].iri != E.BOTTOM_ROLE and z[1].iri != E.TOP_ROLE:
                self.rule([self.role_atom(z[0], x, y)], None if z[1].iri == E.BOTTOM_ROLE else self.role_atom(z[1], x, y), k)
        elif k == "SubObjectPropertyChain":
            ts = [f"?x{i}" for i in range(len(z[0]) + 1)]
            self.rule([self.role_atom(r, p, q) for r, p, q in zip(z[0], ts, ts[1:], strict=False)], self.role_atom(z[1], ts[0], ts[-1]), k)
        elif k == "EquivalentObjectProperties":
            for p, q in zip(z, z[1:] + z[:1], strict=True):
                self.rule([self.role_atom(p, x, y)], self.role_atom(q, x, y), k)
        elif k == "DisjointObjectProperties":
            for p, q in itertools.combinations(z, 2):
                self.rule([self.role_atom(p, x, y), self.role_atom(q, x, y)], None, k)
        elif k == "InverseObjectProperties":
            self.rule([self.role_atom(z[0], x, y)], self.role_atom(z[1], y, x), k)
            self.rule([self.role_atom(z[1], x, y)], self.role_atom(z[0], y, x), k)
        elif k == "ObjectPropertyDomain":
            self.heads(E.nnf(z[1]), x, [self.role_atom(z[0], x, y)], k)
        elif k == "ObjectPropertyRange":
            self.heads(E.nnf(z[1]), y, [self.role_atom(z[0], x, y)], k)
        elif k == "FunctionalObjectProperty":
            self.rule([self.role_atom(z[0], x, "?y1"), self.role_atom(z[0], x, "?y2")], ("eq", "?y1", "?y2"), k)
        elif k == "InverseFunctionalObjectProperty":
            self.rule([self.role_atom(z[0], "?y1", x), self.role_atom(z[0], "?y2", x)], ("eq", "?y1", "?y2"), k)
        elif k == "ReflexiveObjectProperty":
            self.rule([("thing", x)], self.role_atom(z[0], x, x), k)
        elif k == "IrreflexiveObjectProperty":
            self.rule([self.role_atom(z[0], x, x)], None, k)
        elif k == "SymmetricObjectProperty":
            self.rule([self.role_atom(z[0], x, y)], self.role_atom(z[0], y, x), k)
        elif k == "AsymmetricObjectProperty":
            self.rule([self.role_atom(z[0], x, y), self.role_atom(z[0], y, x)], None, k)
        elif k == "TransitiveObjectProperty":
            self.rule([self.role_atom(z[0], x, y), self.role_atom(z[0], y, "?z")], self.role_atom(z[0], x, "?z"), k)
        elif k == "SubDataPropertyOf":
            if z[0] == E.TOP_DATA:
                raise ValueError("topDataProperty may only be a super property")
            if z[0] != E.BOTTOM_DATA and z[1] != E.TOP_DATA:
                self.rule([("d", z[0], x, "?v")], ("d", z[1], x, "?v"), k)
        elif k == "EquivalentDataProperties":
            for p, q in zip(z, z[1:] + z[:1], strict=True):
                self.rule([("d", p, x, "?v")], ("d", q, x, "?v"), k)
        elif k == "DisjointDataProperties":
            for p, q in itertools.combinations(z, 2):
                self.rule([("key", p, x, "?k"), ("key", q, x, "?k")], None, k)
        elif k == "DataPropertyDomain":
            self.heads(E.nnf(z[1]), x, [("d", z[0], x, "?v")], k)
        elif k == "DataPropertyRange":
            self.heads(E.DataAll(z[0], z[1]), x, [], k)
        elif k == "FunctionalDataProperty":
            self.rule([("d", z[0], x, "?v"), ("d", z[0], x, "?w"), ("vne", "?v", "?w")], None, k)
        elif k == "DatatypeDefinition":
            self.out.definitions[z[0].iri if isinstance(z[0], E.Datatype) else z[0]] = z[1]
        elif k == "HasKey":
            body = [("named", x), ("named", y)]
            for who in (x, y):
                alts = self.bodies(E.nnf(z[0]), who)
                if len(alts) != 1:
                    raise NotHorn(z[0])
                body += alts[0]
            for i, r in enumerate(z[1]):
                body += [self.role_atom(r, x, f"?o{i}"), self.role_atom(r, y, f"?o{i}")]
            for i, p in enumerate(z[2]):
                body += [("key", p, x, f"?k{i}"), ("key", p, y, f"?k{i}")]
            self.rule(body, ("eq", x, y), k)
        elif k == "ClassAssertion":
            self.heads(E.nnf(z[0]), z[1], [], k)
        elif k == "ObjectPropertyAssertion":
            self.out.facts.append(self.role_atom(z[0], z[1], z[2]))
        elif k == "DataPropertyAssertion":
            self.out.facts.append(("d", *z))
        elif k == "NegativeObjectPropertyAssertion":
            self.out.negative.append(self.role_atom(z[0], z[1], z[2]))
            self.rule([self.role_atom(z[0], z[1], z[2])], None, k)
        elif k == "NegativeDataPropertyAssertion":
            self.out.negative.append(("d", *z))
            self.rule([("d", z[0], z[1], "?v"), ("in", E.Values((z[2],)), "?v")], None, k)
        elif k == "SameIndividual":
            self.out.facts += [("eq", p, q) for p, q in zip(z, z[1:], strict=False)]
        elif k == "DifferentIndividuals":
            self.out.facts += [("ne", p, q) for p, q in itertools.combinations(z, 2)]
        elif k == "Rule":
            self.swrl(*z)
        elif k not in ("Declaration", "AnnotationAssertion", "Import"):
            raise ValueError(f"unsupported axiom type {k}")

    def include(self, c: E.Expr, d: E.Expr, label: str) -> None:
        c, d = E.nnf(c), E.nnf(d)
        try:
            alts = self.bodies(c, "?x")
        except NotHorn:  # move the condition over: its complement may be a plain consequence
            self.heads(E.disj([E.nnf(c, True), d]), "?x", [("thing", "?x")], label)
            return
        for b in alts:
            self.heads(d, "?x", b or [("thing", "?x")], label)

    def swrl(self, body: tuple, head: tuple) -> None:
        """A DL-safe rule: variables range over named individuals; one rule for each head atom."""
        atoms: list[tuple] = []
        same: dict = {}

        def term(t):
            while t in same:
                t = same[t]
            return t

        for a in body:
            if a[0] == "same" and isinstance(a[1], str) and a[1].startswith("?"):
                same[term(a[1])] = a[2]
        for a in body:
            if a[0] == "same":
                continue
            if a[0] == "builtin":
                raise ValueError("rule built-ins are not supported")
            atoms += self.rule_atom(a, term, True)
        bound = {t for a in atoms if a[0] in ("c", "r", "d") for t in a[1:] if isinstance(t, str) and t.startswith("?")}
        for a in atoms:
            if a[0] in ("in", "out") and a[2] not in bound:
                raise ValueError(f"rule variable {a[2]} is not bound by a property or class atom")
        datas = {a[3] for a in atoms if a[0] == "d"}
        guards = [("named", t) for t in sorted(bound - datas)]
        for h in head:
            for atom in self.rule_atom(h, term, False):
                if atom[0] == "expr":
                    self.heads(atom[1], atom[2], [*atoms, *guards], "Rule")
                else:
                    self.rule([*atoms, *guards], atom if atom[0] != "clash" else None, "Rule")
        if not head:
            self.rule([*atoms, *guards], None, "Rule")

    def rule_atom(self, a: tuple, term, in_body: bool) -> list[tuple]:
        kind, rest = a[0], [term(t) for t in a[2:]] if a[0] not in ("same", "different") else [term(t) for t in a[1:]]
        if kind == "class":
            c = E.nnf(E.named(a[1]))
            if in_body:
                alts = self.bodies(c, rest[0])
                if len(alts) != 1:
                    raise NotHorn(c)
                return alts[0] or [("thing", rest[0])]
            return [("expr", c, rest[0])]
        if kind == "object":
            return [self.role_atom(E.role(a[1]), *rest)]
        if kind == "data":
            if in_body and isinstance(rest[1], E.Literal):
                v = self.var("v")
                return [("d", a[1], rest[0], v), ("in", E.Values((rest[1],)), v)]
            return [("d", a[1], *rest)]
        if kind == "range":
            return [("in", a[1], rest[0])] if in_body else [("g", a[1].iri, rest[0])]
        if kind == "same":
            return [("eq", *rest)]
        if kind == "different":
            return [("ne", *rest)]
        raise ValueError(f"unknown rule atom {kind}")


def compile_horn(axioms) -> Horn:
    return Compiler(axioms).out
