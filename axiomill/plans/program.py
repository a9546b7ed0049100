"""Evaluation of a rule program as DataFrame plans.

Predicates are evaluated on demand: only rules that a question reaches are planned. Rules that only rename - inclusions,
equivalences, inverse and symmetric roles - are followed to their sources before planning, each source once, so hierarchies of any shape are one
union with one distinct, and cycles of such rules are no cycles. A predicate outside any other cycle is a plain view - a
union of joins that Catalyst optimises as one plan, filters and columns pushed to the scans. A cycle runs a semi-naive loop whose
lineage is cut in the shared folder every round. Equality is solved by connected components over merge edges; facts are
then rewritten to representatives (the smallest IRI) until no rule merges more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.datatypes import NUMERIC, range_column
from ..model.expressions import BOTTOM_DATA, BOTTOM_ROLE, THING, TOP_DATA, TOP_ROLE, XSD, Individual, Literal
from ..operators.components import connected_components, cut
from .horn import Horn, Rule

#: (kind) -> columns of its extension
COLUMNS = {"c": ("x",), "r": ("s", "o"), "d": ("s", "v"), "g": ("v",), "ne": ("a", "b"), "thing": ("x",), "key": ("s", "k")}


def lex_of(v):
    return F.regexp_extract(v, r'(?s)^"(.*)"\^\^<[^>]*>$', 1)


def datatype_of(v):
    return F.regexp_extract(v, r'(?s)^".*"\^\^<([^>]*)>$', 1)


def value_key(v):
    """A column equal for rendered literals of equal value: numbers by decimal value, others as written."""
    lex, dt = lex_of(v), datatype_of(v)
    return F.when(dt.isin([XSD + n for n in NUMERIC]), F.coalesce(F.concat(F.lit("n:"), lex.try_cast("decimal(38,18)").cast("string")), v)).when(dt == XSD + "boolean", F.concat(F.lit("b:"), lex.isin("true", "1").cast("string"))).otherwise(v)


def literal_column(lex, datatype: str):
    """Rendered literals from a column."""
    return F.concat(F.lit('"'), lex.cast("string"), F.lit(f'"^^<{datatype}>'))


class Inconsistent(Exception):
    """The knowledge base has no model."""


class TooManyRounds(Exception):
    pass


class Program:
    """Rules over given facts. ``facts`` maps ("c", iri), ("r", iri), ("d", iri), ("g", iri), ("ne",) and ("eq",) to DataFrames
    with the columns of COLUMNS (("eq",): a, b), of strings; literals are rendered. Rows with nulls take no part."""

    def __init__(self, spark: SparkSession, horn: Horn, facts: dict[tuple, DataFrame], max_rounds: int = 200, symmetric_different: bool = True):
        self.spark, self.horn, self.max_rounds, self.symmetric = spark, horn, max_rounds, symmetric_different
        self.given: dict[tuple, DataFrame] = {}
        for k, df in facts.items():
            cols = COLUMNS.get(k[0], ("a", "b"))
            self.given[k] = df.toDF(*cols).dropna()
        self._ground()
        self.rules = [r for r in horn.rules if r.body]
        for k in (("r", BOTTOM_ROLE), ("d", BOTTOM_DATA)):  # no pair is one
            self.rules.append(Rule(((*k, "?x", "?y"),), None, "bottom property"))
        self.rounds = 0
        self.same: DataFrame | None = None
        self._memo: dict[tuple, DataFrame] = {}
        if ("eq",) in self.given or any(r.head and r.head[0] == "eq" for r in self.rules):
            self._merge()

    # ---------------------------------------------------------- facts

    def _ground(self) -> None:
        """Assertions among the axioms become small fact frames."""
        rows: dict[tuple, list[tuple]] = {}
        for f in [*self.horn.facts, *(r.head for r in self.horn.rules if not r.body and r.head)]:
            key = (f[0],) if f[0] in ("eq", "ne") else (f[0], f[1])
            rows.setdefault(key, []).append(tuple(self.constant(t) for t in (f[1:] if len(key) == 1 else f[2:])))
        for key, own in rows.items():
            cols = COLUMNS.get(key[0], ("a", "b"))
            own = list(dict.fromkeys(own))
            df = self.spark.createDataFrame(own, ", ".join(f"{c} string" for c in cols))
            self.given[key] = self.given[key].unionByName(df) if key in self.given else df

    @staticmethod
    def constant(t) -> str:
        return t.iri if isinstance(t, Individual) else t.render() if isinstance(t, Literal) else t

    def facts(self, key: tuple) -> DataFrame | None:
        df = self.given.get(key)
        if df is None or self.same is None:
            return df
        for c in {"c": ("x",), "r": ("s", "o"), "d": ("s",), "ne": ("a", "b")}.get(key[0], ()):
            m = self.same.select(F.col("node").alias("__n"), F.col("component").alias("__r"))
            df = df.join(m, F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__r", c)).drop("__n", "__r")
        return df

    def _merge(self) -> None:
        """Merge edges to components to rewritten facts, until nothing new merges."""
        edges: DataFrame | None = None
        for _ in range(self.max_rounds):
            self.forget()
            found = [self.merge_edges(r) for r in self.rules if r.head and r.head[0] == "eq" and self.possible(r.body)]
            if edges is None and ("eq",) in self.given:
                found.append(self.given[("eq",)].select("a", "b"))
            if not found:
                return
            new = cut(reduce(DataFrame.unionByName, found).where("a <> b").distinct())
            if new.isEmpty():
                break
            edges = new if edges is None else edges.unionByName(new)
            self.same = cut(connected_components(edges))
        else:
            raise TooManyRounds(f"merging did not settle in {self.max_rounds} rounds")
        self.forget()

    def forget(self) -> None:
        """Drop what was derived from facts that have changed."""
        self._memo = {}
        for k in ("_live", "_by_head", "_hard", "_consistent"):
            self.__dict__.pop(k, None)

    def merge_edges(self, r: Rule) -> DataFrame:
        """(a, b) pairs that a rule equates. Where the rule says "two with the same keys", as functional roles and keys do, each is
        paired with the least of its group, not with every other: rows stay in proportion to the facts."""
        u, w = r.head[1:]
        if isinstance(u, str) and isinstance(w, str) and u.startswith("?") and w.startswith("?"):
            one, two = [a for a in r.body if u in a[1:]], [a for a in r.body if w in a[1:]]
            if not any(w in a[1:] for a in one) and {tuple(u if t == w else t for t in a) for a in two} == set(one):
                atoms = tuple(a for a in r.body if a not in two)
                keys = sorted({t for a in atoms for t in a[1:] if isinstance(t, str) and t.startswith("?")} - {u})
                members = self.body(atoms, {}).select(F.col(f"`{u}`").alias("a"), *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
                if not keys:
                    return members.select("a").join(members.agg(F.min("a").alias("b")))
                least = members.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.min("a").alias("b"))
                return members.join(least, [f"k{i}" for i in range(len(keys))]).select("a", "b")
        return self.body(r.body, {}).select(self._term(u).alias("a"), self._term(w).alias("b"))

    def representative(self, iri: str) -> str:
        if self.same is None:
            return iri
        row = self.same.where(F.col("node") == iri).select("component").first()
        return row[0] if row else iri

    # ---------------------------------------------------------- evaluation

    def key_of(self, atom: tuple) -> tuple | None:
        return {"c": lambda: ("c", atom[1]), "r": lambda: ("r", atom[1]), "d": lambda: ("d", atom[1]), "g": lambda: ("g", atom[1]), "key": lambda: ("d", atom[1]), "ne": lambda: ("ne",), "thing": lambda: ("thing",)}.get(atom[0], lambda: None)()

    def possible(self, body: tuple) -> bool:
        """Whether every atom has facts or rules at all: rules that cannot fire are not planned."""
        if not hasattr(self, "_live"):
            live = {*self.given, ("thing",), ("c", THING.iri)}
            grown = True
            while grown:
                grown = False
                if ("d", TOP_DATA) not in live and any(k[0] == "d" for k in live):
                    live.add(("d", TOP_DATA))
                for r in self.rules:
                    if r.head and (h := self.key_of(r.head)) and h not in live and all((k := self.key_of(a)) is None or k in live for a in r.body):
                        live.add(h)
                        grown = True
            self._live = live
        return all((k := self.key_of(a)) is None or k in self._live for a in body)

    def rules_for(self, key: tuple) -> list[Rule]:
        if "_by_head" not in self.__dict__:
            self._by_head: dict[tuple, list[Rule]] = {}
            for r in self.rules:
                if r.head and self.possible(r.body):
                    self._by_head.setdefault(self.key_of(r.head), []).append(r)
        return self._by_head.get(key, [])

    def renames(self, r: Rule) -> tuple[tuple, bool] | None:
        """(source, swapped) of a rule that only renames its one atom: p(x) from q(x), r(x, y) from s(x, y) or s(y, x)."""
        if len(r.body) != 1 or r.head[0] not in ("c", "r", "d") or r.body[0][0] != r.head[0]:
            return None
        to, own = r.head[2:], r.body[0][2:]
        if len(set(own)) < len(own) or not all(isinstance(t, str) and t.startswith("?") for t in own):
            return None
        return (self.key_of(r.body[0]), to != own) if to in (own, own[::-1]) else None

    def _cycles(self) -> dict[tuple, list[tuple]]:
        """Each predicate of a cycle that does more than rename, with its strongly connected component: one depth-first pass over the rules."""
        if "_hard" in self.__dict__:
            return self._hard
        number: dict[tuple, int] = {}
        low: dict[tuple, int] = {}
        path: list[tuple] = []
        on: set[tuple] = set()
        self._hard = {}

        def below(k):
            return [d for r in self.rules_for(k) for a in r.body if (d := self.key_of(a)) is not None and d[0] != "thing"]

        for start in {self.key_of(r.head) for r in self.rules if r.head} - {None}:
            if start in number:
                continue
            work = [(start, iter(below(start)))]
            number[start] = low[start] = len(number)
            path.append(start)
            on.add(start)
            while work:
                k, rest = work[-1]
                for d in rest:
                    if d not in number:
                        number[d] = low[d] = len(number)
                        path.append(d)
                        on.add(d)
                        work.append((d, iter(below(d))))
                        break
                    if d in on:
                        low[k] = min(low[k], number[d])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[k])
                    if low[k] == number[k]:
                        scc = set()
                        while not scc or k not in scc:
                            scc.add(path.pop())
                        on -= scc
                        if any(self.renames(r) is None and any(self.key_of(a) in scc for a in r.body) for h in scc for r in self.rules_for(h)):
                            self._hard |= dict.fromkeys(scc, sorted(scc))
        return self._hard

    def cycle(self, key: tuple) -> list[tuple]:
        """The strongly connected component of a predicate whose cycle does more than rename ([] otherwise)."""
        return self._cycles().get(key, [])

    def extension(self, key: tuple) -> DataFrame:
        """The derived extension of a predicate: distinct rows in the columns of COLUMNS."""
        if key not in self._memo:
            if key[0] == "thing" or key == ("c", THING.iri):
                self._memo[key] = self.domain()
            elif key == ("r", TOP_ROLE):
                raise ValueError("all pairs of individuals are not enumerated")
            elif key == ("d", TOP_DATA):
                every = sorted({k for k in {*self.given, *(self.key_of(r.head) for r in self.rules if r.head)} if k and k[0] == "d" and k[1] not in (TOP_DATA, BOTTOM_DATA)})
                self._memo[key] = self.union(key, [self.extension(k) for k in every])
            elif scc := self.cycle(key):
                self._memo |= self.saturate(scc)
            else:
                self._memo[key] = self.union(key, self.sources(key))
        return self._memo[key]

    def sources(self, key: tuple) -> list[DataFrame]:
        """What a predicate is the union of besides its own facts: renaming rules are followed, every source is taken once in each orientation."""
        out, seen, todo = [], {(key, False)}, [(key, False)]
        while todo:
            k, flip = todo.pop(0)
            found: list[DataFrame] = []
            if k != key and self.cycle(k):
                found.append(self.extension(k))
            else:
                if (k, flip) != (key, False) and (f := self.facts(k)) is not None:
                    found.append(f)
                for r in self.rules_for(k):
                    if (step := self.renames(r)) is None:
                        found.append(self.derive(r, {}))
                    elif (to := (step[0], flip != step[1])) not in seen:
                        seen.add(to)
                        todo.append(to)
            cols = COLUMNS[k[0]]
            out += [f.select(*(F.col(c).alias(n) for c, n in zip(reversed(cols) if flip else cols, cols, strict=True))) for f in found]
        return out

    def union(self, key: tuple, derived: list[DataFrame]) -> DataFrame:
        parts = [x for x in (self.facts(key), *derived) if x is not None]
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[key[0]]))
        out = reduce(DataFrame.unionByName, parts)
        if key == ("ne",) and self.symmetric:
            out = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return out.distinct()

    def derive(self, r: Rule, sources: dict[int, DataFrame]) -> DataFrame:
        """The head rows of a rule; ``sources`` replaces the extension of single body atoms (deltas)."""
        key = self.key_of(r.head)
        terms = r.head[1:] if len(key) == 1 else r.head[2:]
        return self.body(r.body, sources).select(*(self._term(t).alias(c) for t, c in zip(terms, COLUMNS[key[0]], strict=True)))

    def _term(self, t):
        if isinstance(t, str) and t.startswith("?"):
            return F.col(f"`{t}`")
        return F.lit(self.representative(t.iri)) if isinstance(t, Individual) else F.lit(self.constant(t))

    def scan(self, atom: tuple, df: DataFrame | None = None) -> DataFrame:
        """An atom's extension with its columns renamed to variables; constants and repeated variables filter."""
        kind = atom[0]
        if df is None:
            df = self.extension(self.key_of(atom))
        if kind == "key":
            df = df.select("s", value_key(F.col("v")).alias("k")).distinct()
        terms = atom[1:] if kind in ("ne", "thing") else atom[2:]
        seen: dict[str, str] = {}
        for c, t in zip(COLUMNS[kind], terms, strict=True):
            if not (isinstance(t, str) and t.startswith("?")):
                df = df.where(F.col(c) == self._term(t if not isinstance(t, str) else Individual(t)))
            elif t in seen:
                df = df.where(F.col(seen[t]) == F.col(c))
            else:
                seen[t] = c
        return df.select(*(F.col(c).alias(t) for t, c in seen.items())) if seen else df.select(F.lit(1).alias("__one")).limit(1)

    def body(self, atoms: tuple, sources: dict[int, DataFrame]) -> DataFrame:
        """The bindings of a conjunction: equi-joins in bound-first order, guards as filters as soon as they are bound."""
        tables = [(i, a) for i, a in enumerate(atoms) if a[0] in COLUMNS]
        guards = [a for a in atoms if a[0] not in COLUMNS]
        bound: set[str] = set()
        out: DataFrame | None = None
        todo = list(tables)

        def variables(a):
            return {t for t in a[1:] if isinstance(t, str) and t.startswith("?")}

        def constants(a):
            return sum(isinstance(t, (Individual, Literal)) for t in a[1:])

        while todo or guards:
            if out is not None:
                for g in [g for g in guards if variables(g) <= bound]:
                    guards.remove(g)
                    out = out.where(self.guard(g))
                for g in [g for g in guards if g[0] == "eq" and variables(g) & bound]:
                    new = next(iter(variables(g) - bound))
                    old = g[1] if g[2] == new else g[2]
                    out = out.withColumn(new, self._term(old))
                    bound.add(new)
            if not todo:
                if guards and out is None:  # only constants
                    out = self.spark.range(1).select(F.lit(1).alias("__one"))
                    for g in [g for g in guards if g[0] == "eq" and len(variables(g)) == 1]:
                        v = next(iter(variables(g)))
                        out = out.withColumn(v, self._term(g[1] if g[2] == v else g[2]))
                        bound.add(v)
                        guards.remove(g)
                    continue
                if guards:
                    raise ValueError(f"unbound variables in {guards}")
                break
            # deltas first, then what shares variables, then what holds constants
            todo.sort(key=lambda ia: (not (bound & variables(ia[1])) if out is not None else False, ia[0] not in sources, -constants(ia[1]), ia[0]))
            i, a = todo.pop(0)
            s = self.scan(a, sources.get(i))
            if out is None:
                out = s
            else:
                on = [c for c in s.columns if c in out.columns and c.startswith("?")]
                if on:
                    out = out.join(s, on)
                else:  # a body that falls in two: the statement itself asks for all pairs
                    out = out.drop("__one").crossJoin(s.drop("__one")) if len(s.drop("__one").columns) and len(out.drop("__one").columns) else out.join(s.select(F.lit(True).alias("__hit")).limit(1), F.lit(True)).drop("__hit")
            bound |= variables(a)
        return out

    def guard(self, g: tuple):
        if g[0] in ("in", "out"):
            v = self._term(g[2])
            m = range_column(g[1], lex_of(v), datatype_of(v), self.horn.definitions)
            return F.coalesce(m, F.lit(False)) if g[0] == "in" else ~F.coalesce(m, F.lit(True))
        if g[0] == "vne":
            return value_key(self._term(g[1])) != value_key(self._term(g[2]))
        if g[0] == "eq":
            return self._term(g[1]) == self._term(g[2])
        if g[0] == "named":
            return ~F.col(f"`{g[1]}`").startswith("_:")
        raise ValueError(g)

    def saturate(self, scc: list[tuple]) -> dict[tuple, DataFrame]:
        """Semi-naive fixpoint of a cycle of predicates: every rule fires with one atom on the last round's new rows."""
        inner, outer = [], []
        for k in scc:
            for r in self.rules_for(k):
                at = [i for i, a in enumerate(r.body) if self.key_of(a) in scc]
                (inner if at else outer).append((k, r, at))
        full = {k: cut(self.union(k, [self.derive(r, {}) for h, r, _ in outer if h == k])) for k in scc}
        delta = dict(full)
        for n in range(self.max_rounds):
            self.rounds += 1
            fresh: dict[tuple, list[DataFrame]] = {}
            for h, r, at in inner:
                for i in at:
                    sources = {j: (delta if j == i else full)[self.key_of(r.body[j])] for j in at}
                    fresh.setdefault(h, []).append(self.derive(r, sources))
            new = {}
            for h, parts in fresh.items():
                df = cut(reduce(DataFrame.unionByName, parts).distinct().join(full[h], list(COLUMNS[h[0]]), "left_anti"))
                if not df.isEmpty():
                    new[h] = df
            if not new:
                return full
            for h, df in new.items():
                full[h] = full[h].unionByName(df)
                if n % 6 == 5:
                    full[h] = cut(full[h])
            empty = {k: full[k].limit(0) for k in scc}
            delta = empty | new
        raise TooManyRounds(f"no fixpoint in {self.max_rounds} rounds")

    def domain(self) -> DataFrame:
        """The active domain: every individual of any fact."""
        parts = []
        for k in self.given:
            df = self.facts(k)
            parts += [df.select(F.col(c).alias("x")) for c in {"c": ("x",), "r": ("s", "o"), "d": ("s",), "ne": ("a", "b")}.get(k[0], ())]
        if ("eq",) in self.given:
            parts += [self.same.select(F.col("component").alias("x"))] if self.same is not None else []
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "x string")

    # ---------------------------------------------------------- consistency

    def clashes(self) -> DataFrame:
        """(rule, detail): one row for every way in which a clash rule fires. Empty: consistent as far as facts and rules go."""
        parts = []
        for n, r in enumerate(r for r in self.rules if r.head is None):
            if self.possible(r.body):
                b = self.body(r.body, {})
                cols = sorted(c for c in b.columns if c.startswith("?") and not c.startswith("?_")) or sorted(c for c in b.columns if c.startswith("?"))
                detail = F.concat_ws(" ", *(F.col(f"`{c}`") for c in cols)) if cols else F.lit("")
                parts.append(b.select(F.lit(f"{r.label}").alias("rule"), detail.alias("detail")).distinct())
        ne = self.given.get(("ne",))
        if ne is not None:
            parts.append(self.facts(("ne",)).where("a = b").select(F.lit("DifferentIndividuals").alias("rule"), F.col("a").alias("detail")).distinct())
        if not parts:
            return self.spark.createDataFrame([], "rule string, detail string")
        return reduce(DataFrame.unionByName, parts)

    def is_consistent(self) -> bool:
        """Decided once for the facts as they are."""
        if "_consistent" not in self.__dict__:
            self._consistent = not any(r.head is None and not r.body for r in self.horn.rules) and self.clashes().isEmpty()
        return self._consistent

    def equivalence_class(self, iri: str) -> list[str] | None:
        """All names of an individual's class; None if no fact knows it."""
        rep = self.representative(iri)
        known = [r[0] for r in self.same.where(F.col("component") == rep).select("node").collect()] if self.same is not None else []
        if known:
            return sorted(known)
        return [iri] if not self.domain().where(F.col("x") == rep).isEmpty() else None
