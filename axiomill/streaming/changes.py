"""Changes to the assertions: a buffer, incremental insertion into derived facts, and Structured Streaming micro-batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut
from ..plans.program import COLUMNS, Program


class Materialized:
    """Derived extensions that follow insertions: the semi-naive loop goes on from the new facts instead of starting again.

    Deletions, and programs that merge individuals, rebuild (an equality that loses its reason splits a class, which only a
    rebuild of that class can see).
    """

    def __init__(self, program: Program, keys: list[tuple]):
        self.program, self.keys = program, keys
        self.full: dict[tuple, DataFrame] = {}
        self._build()

    def _needed(self) -> list[tuple]:
        seen, todo = set(), list(self.keys)
        while todo:
            k = todo.pop()
            if k in seen or k[0] == "thing":
                continue
            seen.add(k)
            todo += [d for r in self.program.rules if r.head and self.program.key_of(r.head) == k for a in r.body if (d := self.program.key_of(a))]
        return sorted(seen)

    def _build(self) -> None:
        self.full = {k: cut(self.program.extension(k)) for k in self._needed() if self.program.possible(((k[0], *k[1:], *("?x" + str(i) for i in range(len(COLUMNS[k[0]])))),))}

    def extension(self, key: tuple) -> DataFrame:
        return self.full.get(key, self.program.union(key, []))

    @property
    def incremental(self) -> bool:
        p = self.program
        return p.same is None and not any(r.head and r.head[0] == "eq" for r in p.rules) and not any(a[0] == "thing" for r in p.rules for a in r.body)

    def insert(self, facts: dict[tuple, DataFrame]) -> None:
        """Add facts and what follows from them."""
        p = self.program
        for k, df in facts.items():
            df = df.toDF(*COLUMNS.get(k[0], ("a", "b"))).dropna()
            p.given[k] = p.given[k].unionByName(df) if k in p.given else df
        p.forget()
        if not self.incremental:
            p._merge()
            self._build()
            return
        needed = self._needed()
        for k in needed:
            self.full.setdefault(k, p.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[k[0]])))
        delta = {}
        for k, df in facts.items():
            if k in self.full:
                new = cut(df.toDF(*COLUMNS[k[0]]).dropna().distinct().join(self.full[k], list(COLUMNS[k[0]]), "left_anti"))
                if not new.isEmpty():
                    delta[k] = new
        for _ in range(p.max_rounds):
            if not delta:
                return
            for k, df in delta.items():
                self.full[k] = self.full[k].unionByName(df)
            fresh: dict[tuple, list[DataFrame]] = {}
            for r in p.rules:
                h = p.key_of(r.head) if r.head else None
                if h not in self.full:
                    continue
                keys = [p.key_of(a) for a in r.body]
                for i, k in enumerate(keys):
                    if k in delta:
                        sources = {j: (delta[k] if j == i else self.full.get(d, p.union(d, []))) for j, d in enumerate(keys) if d is not None}
                        fresh.setdefault(h, []).append(p.derive(r, sources))
            delta = {}
            for h, parts in fresh.items():
                new = cut(reduce(DataFrame.unionByName, parts).distinct().join(self.full[h], list(COLUMNS[h[0]]), "left_anti"))
                if not new.isEmpty():
                    delta[h] = new
        raise RuntimeError("insertion did not settle")

    def delete(self, facts: dict[tuple, DataFrame]) -> None:
        """Remove asserted facts and rebuild what depended on them."""
        p = self.program
        for k, df in facts.items():
            if k in p.given:
                cols = COLUMNS.get(k[0], ("a", "b"))
                p.given[k] = cut(p.given[k].join(df.toDF(*cols), list(cols), "left_anti"))
        p.same = None
        p.forget()
        p._merge()
        self._build()


def stream_into(stream: DataFrame, target: Materialized, checkpoint: str | None = None):
    """Apply a stream of changes (kind, predicate, a, b, op) in micro-batches; kind is c, r, d or ne; op is insert or delete.

    There is no event time in the semantics: late facts are ordinary facts. Returns the started query.
    """

    def batch(df: DataFrame, _: int) -> None:
        df = cut(df)
        for op, act in (("delete", target.delete), ("insert", target.insert)):
            rows = df.where(F.col("op") == op)
            changes = {}
            for kind, pred in [(r[0], r[1]) for r in rows.select("kind", "predicate").distinct().collect()]:
                key = (kind,) if kind in ("ne", "eq") else (kind, pred)
                cols = COLUMNS.get(kind, ("a", "b"))
                own = rows.where((F.col("kind") == kind) & (F.coalesce("predicate", F.lit("")) == (pred or "")))
                changes[key] = own.select(*(F.col(c).alias(n) for c, n in zip(("a", "b"), cols, strict=False)))
            if changes:
                act(changes)

    w = stream.writeStream.foreachBatch(batch)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


class ChangeBuffer:
    """Pending axiom changes of a reasoner: (add, axiom) pairs, applied on flush; ``incremental`` says whether all are simple assertions."""

    SIMPLE = ("ClassAssertion", "ObjectPropertyAssertion", "NegativeObjectPropertyAssertion", "DataPropertyAssertion", "NegativeDataPropertyAssertion", "SameIndividual", "DifferentIndividuals")

    def __init__(self):
        self.pending: list[tuple[bool, object]] = []

    def add(self, axiom) -> None:
        self.pending.append((True, axiom))

    def remove(self, axiom) -> None:
        self.pending.append((False, axiom))

    def additions(self) -> set:
        return {a for add, a in self.pending if add}

    def removals(self) -> set:
        return {a for add, a in self.pending if not add}

    def incremental(self) -> bool:
        return all(a.kind in self.SIMPLE for _, a in self.pending)

    def apply(self, axioms: list) -> list:
        out = list(axioms)
        for add, a in self.pending:
            if add and a not in out:
                out.append(a)
            elif not add and a in out:
                out.remove(a)
        self.pending = []
        return out
