"""OWL functional syntax and N-Triples in, hierarchies and clauses out."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import expressions as E
from ..model.expressions import Axiom, Individual, Literal, Named, Role, axiom
from ..prefixes import Prefixes

TOKEN = re.compile(r'\s+|#[^\n]*|(\()|(\))|(=)|("(?:[^"\\]|\\.)*")|(\^\^)|(@[A-Za-z0-9\-]+)|(<[^>]*>)|([^\s()="<]+)')


class Ontology:
    """Axioms with an id, prefixes and imports; the in-memory source."""

    def __init__(self, axioms=(), iri: str | None = None, prefixes: Prefixes | None = None, imports=()):
        self.axioms, self.iri, self.prefixes, self.imports = list(axioms), iri, prefixes or Prefixes(), list(imports)

    @staticmethod
    def merged(*parts: Ontology) -> Ontology:
        """Several ontologies as one axiom set."""
        out = Ontology(iri=parts[0].iri if parts else None, prefixes=parts[0].prefixes if parts else None)
        for p in parts:
            out.axioms += [a for a in p.axioms if a not in out.axioms]
        return out


def resolve(ref: str, base: str | None = None) -> str:
    """A plain path or file: IRI; remote references are refused."""
    u = urlparse(ref)
    if u.scheme == "file":
        return unquote(u.path)
    if u.scheme and "://" in ref:
        raise ValueError(f"remote ontologies are not loaded: {ref}")
    return os.path.normpath(os.path.join(base or os.getcwd(), ref))


def load(ref: str, base: str | None = None, seen: set[str] | None = None) -> Ontology:
    """An ontology file in functional syntax, with its imports that are files."""
    path, seen = resolve(ref, base), seen if seen is not None else set()
    seen.add(path)
    with open(path, encoding="utf-8") as f:
        out = parse(f.read())
    for i in out.imports:
        try:
            p = resolve(i, os.path.dirname(path))
        except ValueError:
            continue
        if p not in seen and os.path.exists(p):
            out.axioms += [a for a in load(p, seen=seen).axioms if a not in out.axioms]
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected text at {text[at : at + 30]!r}")
            at = m.end()
            if m.lastindex:
                self.tokens.append(m[m.lastindex])
        self.i, self.prefixes = 0, Prefixes()

    def peek(self) -> str | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def next(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or want is not None and t != want:
            raise ValueError(f"expected {want or 'more text'}, found {t}")
        self.i += 1
        return t

    def iri(self) -> str:
        return self.prefixes.expand(self.next())

    def document(self) -> Ontology:
        while self.peek() == "Prefix":
            self.next()
            self.next("(")
            name = self.next()
            self.next("=")
            self.prefixes.by_name[name] = self.next()[1:-1]
            self.next(")")
        out = Ontology(prefixes=self.prefixes)
        self.next("Ontology")
        self.next("(")
        if (self.peek() or "").startswith("<"):
            out.iri = self.iri()
            if (self.peek() or "").startswith("<"):
                self.iri()
        while self.peek() != ")":
            if self.peek() == "Import":
                self.next()
                self.next("(")
                out.imports.append(self.iri())
                self.next(")")
            elif self.peek() == "Annotation":
                self.skip()
            else:
                a = self.axiom()
                if a is not None:
                    out.axioms.append(a)
        self.next(")")
        return out

    def skip(self) -> None:
        self.next()
        self.next("(")
        depth = 1
        while depth:
            t = self.next()
            depth += (t == "(") - (t == ")")

    def many(self, one) -> list:
        out = []
        while self.peek() != ")":
            out.append(one())
        return out

    def axiom(self) -> Axiom | None:
        if self.peek() in ("AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"):
            self.skip()
            return None
        kind = self.next()
        self.next("(")
        while self.peek() == "Annotation":
            self.skip()
        c, r, i, d = self.expression, self.role, self.individual, self.iri
        if kind == "Declaration":
            what = self.next()
            self.next("(")
            out = axiom(kind, what, d())
            self.next(")")
        elif kind in ("SubClassOf", "EquivalentClasses", "DisjointClasses"):
            out = axiom(kind, *self.many(c))
        elif kind == "DisjointUnion":
            out = axiom(kind, *self.many(c))
        elif kind == "SubObjectPropertyOf" and self.peek() == "ObjectPropertyChain":
            self.next()
            self.next("(")
            chain = self.many(r)
            self.next(")")
            out = axiom("SubObjectPropertyChain", chain, r())
        elif kind in ("ObjectPropertyDomain", "ObjectPropertyRange"):
            out = axiom(kind, r(), c())
        elif kind in E.OBJECT_AXIOMS:
            out = axiom(kind, *self.many(r))
        elif kind == "DataPropertyDomain":
            out = axiom(kind, d(), c())
        elif kind == "DataPropertyRange":
            out = axiom(kind, d(), self.range())
        elif kind == "DatatypeDefinition":
            out = axiom(kind, E.Datatype(d()), self.range())
        elif kind in E.DATA_AXIOMS:
            out = axiom(kind, *self.many(d))
        elif kind == "ClassAssertion":
            out = axiom(kind, c(), i())
        elif kind in ("ObjectPropertyAssertion", "NegativeObjectPropertyAssertion"):
            out = axiom(kind, r(), i(), i())
        elif kind in ("DataPropertyAssertion", "NegativeDataPropertyAssertion"):
            out = axiom(kind, d(), i(), self.literal())
        elif kind in ("SameIndividual", "DifferentIndividuals"):
            out = axiom(kind, *self.many(i))
        elif kind == "HasKey":
            cls = c()
            self.next("(")
            objects = self.many(r)
            self.next(")")
            self.next("(")
            datas = self.many(d)
            self.next(")")
            out = axiom(kind, cls, objects, datas)
        elif kind == "DLSafeRule":
            parts = []
            for _ in range(2):
                self.next()
                self.next("(")
                parts.append(tuple(self.many(self.rule_atom)))
                self.next(")")
            out = Axiom("Rule", tuple(parts))
        else:
            raise ValueError(f"unsupported axiom type {kind}")
        self.next(")")
        return out

    def rule_term(self):
        if self.peek() == "Variable":
            self.next()
            self.next("(")
            v = "?" + re.sub(r"\W", "_", self.iri())
            self.next(")")
            return v
        return self.literal() if (self.peek() or "").startswith('"') else self.individual()

    def rule_atom(self) -> tuple:
        kind = self.next()
        self.next("(")
        t = self.rule_term
        made = {
            "ClassAtom": lambda: ("class", self.expression(), t()), "ObjectPropertyAtom": lambda: ("object", self.role(), t(), t()), "DataPropertyAtom": lambda: ("data", self.iri(), t(), t()),
            "DataRangeAtom": lambda: ("range", self.range(), t()), "SameIndividualAtom": lambda: ("same", t(), t()), "DifferentIndividualsAtom": lambda: ("different", t(), t()),
        }
        if kind not in made:
            raise ValueError("rule built-ins are not supported")
        out = made[kind]()
        self.next(")")
        return out

    def role(self) -> Role:
        if self.peek() == "ObjectInverseOf":
            self.next()
            self.next("(")
            r = self.role().inverse()
            self.next(")")
            return r
        return Role(self.iri())

    def individual(self) -> Individual:
        t = self.peek() or ""
        if t.startswith("_:"):
            self.next()
            return Individual(t, True)
        return Individual(self.iri())

    def literal(self) -> Literal:
        lex = re.sub(r"\\(.)", r"\1", self.next()[1:-1])
        if self.peek() == "^^":
            self.next()
            return Literal(lex, self.iri())
        if (self.peek() or "").startswith("@"):
            return Literal.of(lex, lang=self.next()[1:])
        return Literal(lex)

    def range(self) -> E.Range:
        t = self.peek() or ""
        if t not in ("DataIntersectionOf", "DataUnionOf", "DataComplementOf", "DataOneOf", "DatatypeRestriction"):
            return E.Datatype(self.iri())
        self.next()
        self.next("(")
        if t == "DataComplementOf":
            out: E.Range = E.RangeNot(self.range())
        elif t == "DataOneOf":
            out = E.Values(tuple(self.many(self.literal)))
        elif t == "DatatypeRestriction":
            dt = self.iri()
            out = E.Restricted(dt, tuple(self.many(lambda: (self.iri(), self.literal()))))
        else:
            out = (E.RangeAnd if t == "DataIntersectionOf" else E.RangeOr)(tuple(self.many(self.range)))
        self.next(")")
        return out

    def expression(self) -> E.Expr:
        t = self.peek() or ""
        if not re.match(r"(Object|Data)[A-Z]\w*$", t):
            return Named(self.iri())
        self.next()
        self.next("(")
        number = lambda: int(self.next())
        more = lambda one, default: one() if self.peek() != ")" else default

        def counted(make, prop, one, default):
            n = number()
            p = prop()
            return make(n, p, more(one, default))

        made = {
            "ObjectIntersectionOf": lambda: E.And(tuple(self.many(self.expression))), "ObjectUnionOf": lambda: E.Or(tuple(self.many(self.expression))),
            "ObjectComplementOf": lambda: E.Not(self.expression()), "ObjectOneOf": lambda: E.OneOf(tuple(self.many(self.individual))),
            "ObjectSomeValuesFrom": lambda: E.Some(self.role(), self.expression()), "ObjectAllValuesFrom": lambda: E.All(self.role(), self.expression()),
            "ObjectHasValue": lambda: E.HasValue(self.role(), self.individual()), "ObjectHasSelf": lambda: E.HasSelf(self.role()),
            "ObjectMinCardinality": lambda: counted(E.Min, self.role, self.expression, E.THING), "ObjectMaxCardinality": lambda: counted(E.Max, self.role, self.expression, E.THING),
            "ObjectExactCardinality": lambda: counted(E.exactly, self.role, self.expression, E.THING),
            "DataSomeValuesFrom": lambda: E.DataSome(self.iri(), self.range()), "DataAllValuesFrom": lambda: E.DataAll(self.iri(), self.range()),
            "DataHasValue": lambda: E.data_has_value(self.iri(), self.literal()),
            "DataMinCardinality": lambda: counted(E.DataMin, self.iri, self.range, E.ANY_LITERAL), "DataMaxCardinality": lambda: counted(E.DataMax, self.iri, self.range, E.ANY_LITERAL),
            "DataExactCardinality": lambda: counted(E.data_exactly, self.iri, self.range, E.ANY_LITERAL),
        }
        if t not in made:
            raise ValueError(f"unknown expression {t}")
        out = made[t]()
        self.next(")")
        return out


def parse(text: str) -> Ontology:
    return Parser(text).document()


# ------------------------------------------------------------------ bulk assertions

TYPE = E.RDF + "type"


def unescaped(text):
    """A column with N-Triples escapes replaced by their characters; a four-digit escape pair stands for a character beyond the first plane."""
    body = F.regexp_replace(F.regexp_replace(text, r"\\\\U0000([0-9A-Fa-f]{4})", r"\\\\u$1"), r"\\\\'", "'")
    return F.when(text.contains("\\"), F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "v string")["v"], text)).otherwise(text)


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(s, p, o, literal boolean): triples of N-Triples files; objects that are literals are rendered ``"lex"^^<datatype>``, escapes replaced.

    Blank lines and comments are skipped. Any other line that is no triple is an error when the frame is read; not ``strict``: it is left out.
    """
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^(#.*)?$"))
    term, obj = r"(<[^>]*>|_:\S+)", r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w\-]+)?)'
    pattern = rf"^\s*{term}\s+(<[^>]*>)\s+{obj}\s*\.\s*(?:#.*)?$"
    t = lines.select(*(F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))), "value")
    t = t.withColumn("p", F.when(F.col("p") == "", F.raise_error(F.concat(F.lit("not a triple: "), "value"))).otherwise(F.col("p"))) if strict else t.where("p <> ''")
    bare = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    text = F.regexp_extract("o", r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[\w\-]+)?$', 1)
    tag, dt = F.regexp_extract("o", r'"@([\w\-]+)$', 1), F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1)
    text = unescaped(text)
    literal = F.col("o").startswith('"')
    rendered = F.when(tag != "", F.concat(F.lit('"'), text, F.lit("@"), tag, F.lit(f'"^^<{E.PLAIN}>'))).otherwise(F.concat(F.lit('"'), text, F.lit('"^^<'), F.when(dt != "", dt).otherwise(F.lit(E.XSD + "string")), F.lit(">")))
    return t.select(bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), F.when(literal, rendered).otherwise(bare(F.col("o"))).alias("o"), literal.alias("literal"))


def facts_of_triples(triples: DataFrame) -> dict[tuple, DataFrame]:
    """Triples as a program's facts, one frame for each predicate (the signature, not the data, is collected)."""
    out: dict[tuple, DataFrame] = {}
    preds = triples.groupBy("p", "literal").count().collect()
    for p, lit in sorted({(r["p"], r["literal"]) for r in preds}):
        own = triples.where((F.col("p") == p) & (F.col("literal") == lit))
        if p == TYPE:
            for c in [r[0] for r in own.select("o").distinct().collect()]:
                out[("c", c)] = own.where(F.col("o") == c).select(F.col("s").alias("x"))
        elif p == E.OWL + "sameAs":
            out[("eq",)] = own.select(F.col("s").alias("a"), F.col("o").alias("b"))
        elif p == E.OWL + "differentFrom":
            out[("ne",)] = own.select(F.col("s").alias("a"), F.col("o").alias("b"))
        else:
            out[("d" if lit else "r", p)] = own.select("s", F.col("o").alias("v" if lit else "o"))
    return out


# ------------------------------------------------------------------ sinks


def dump_hierarchy(groups: list[tuple[list[str], list[int]]], kind: str, render) -> list[str]:
    """Flat dump lines of a hierarchy of (members, parent indices): equivalences and direct edges, sorted; edges to top and from bottom are left out."""
    names = {"class": ("EquivalentClasses", "SubClassOf"), "object": ("EquivalentObjectProperties", "SubObjectPropertyOf"), "data": ("EquivalentDataProperties", "SubDataPropertyOf")}[kind]
    top, bottom = {"class": (E.THING.iri, E.NOTHING.iri), "object": (E.TOP_ROLE, E.BOTTOM_ROLE), "data": (E.TOP_DATA, E.BOTTOM_DATA)}[kind]
    out = []
    for members, parents in groups:
        if len(members) > 1:
            out.append(f"{names[0]}( {' '.join(render(m) for m in members)} )")
        for p in parents:
            if top not in groups[p][0] and bottom not in members:
                out.append(f"{names[1]}( {render(members[0])} {render(groups[p][0][0])} )")
    return sorted(out)


def print_hierarchy(groups, kind: str, prefixes: Prefixes, iri: str | None = None) -> str:
    """An indented, abbreviated ``Ontology( .. )`` document of a hierarchy."""
    lines = [f"Prefix( {n}=<{i}> )" for n, i in prefixes.items()] + ["", f"Ontology( {f'<{iri}>' if iri else ''}".rstrip(), ""]
    what = {"class": "Class", "object": "ObjectProperty", "data": "DataProperty"}[kind]
    for m in sorted({m for members, _ in groups for m in members}):
        lines.append(f"Declaration( {what}( {prefixes.abbreviate(m)} ) )")
    lines.append("")
    children: dict[int, list[int]] = {}
    for i, (_, parents) in enumerate(groups):
        for p in parents:
            children.setdefault(p, []).append(i)
    roots = [i for i, (_, parents) in enumerate(groups) if not parents]
    flat = dump_hierarchy(groups, kind, prefixes.abbreviate)
    depth: dict[int, int] = {}

    def visit(i: int, d: int) -> None:
        depth[i] = max(depth.get(i, 0), d)
        for c in children.get(i, ()):
            visit(c, d + 1)

    for r in roots:
        visit(r, 0)
    level = {prefixes.abbreviate(members[0]): depth.get(i, 0) for i, (members, _) in enumerate(groups)}
    lines += ["  " * level.get(x.split()[1], 0) + x for x in sorted(flat, key=lambda x: (level.get(x.split()[1], 0), x))]
    return "\n".join([*lines, "", ")"]) + "\n"


def dump_clauses(horn, prefixes: Prefixes) -> str:
    """Prefixes, rules, axioms outside them, facts and counts as text."""

    def atom(a) -> str:
        show = lambda t: t if isinstance(t, str) and t.startswith("?") else prefixes.abbreviate(t.iri) if isinstance(t, Individual) else t.render() if isinstance(t, Literal) else prefixes.abbreviate(t) if isinstance(t, str) else repr(t)
        return f"{show(a[1])}({', '.join(show(t) for t in a[2:])})" if a[0] in ("c", "r", "d", "g", "key") else f"{a[0]}({', '.join(show(t) for t in a[1:])})"

    rules = sorted(f"  {atom(r.head) if r.head else 'clash'} :- {', '.join(map(atom, r.body))}" for r in horn.rules)
    lines = ["Prefixes: [", *(f"  {n} = <{i}>" for n, i in prefixes.items()), "]", "Deterministic rules: [", *rules, "]", "Disjunctive axioms: [", *(f"  {a.kind}" for a in horn.non_horn), "]"]
    lines += ["ABox: [", *sorted(f"  {atom(f)}" for f in horn.facts), *sorted(f"  not {atom(f)}" for f in horn.negative), "]", "Statistics: ["]
    return "\n".join([*lines, f"  Number of deterministic rules: {len(rules)}", f"  Number of disjunctive axioms: {len(horn.non_horn)}", f"  Number of positive facts: {len(horn.facts)}", f"  Number of negative facts: {len(horn.negative)}", "]"]) + "\n"
