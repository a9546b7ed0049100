"""Realisation and hierarchies as DataFrames: types, most specific types, equivalence classes, direct edges, node sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.expressions import NOTHING, THING
from ..operators.components import cut
from .program import Program


def closure(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """The transitive closure of an edge table, paths doubling each round; lineage cut in the shared folder."""
    full = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    delta = full
    for _ in range(max_rounds):
        step = delta.select("u", F.col("v").alias("m")).join(full.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
        back = full.select("u", F.col("v").alias("m")).join(delta.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
        delta = cut(step.unionByName(back).distinct().join(full, ["u", "v"], "left_anti"))
        if delta.isEmpty():
            return full.select(F.col("u").alias(a), F.col("v").alias(b))
        full = cut(full.unionByName(delta))
    raise RuntimeError("closure did not settle")


def class_hierarchy(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(equiv(elem, rep), edges(child, parent)) of told inclusions (child, parent): equivalence classes by mutual
    reachability with the smallest name as representative, and direct edges only (no edge that a two-step path gives)."""
    full = cut(closure(told, "child", "parent"))
    back = full.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    mutual = full.join(back, ["child", "parent"])
    elems = told.select(F.col("child").alias("elem")).unionByName(told.select(F.col("parent").alias("elem"))).distinct()
    least = mutual.groupBy("child").agg(F.min("parent").alias("m"))
    equiv = elems.join(least, F.col("elem") == F.col("child"), "left").select("elem", F.least("elem", F.coalesce("m", "elem")).alias("rep"))
    a, b = equiv.select(F.col("elem").alias("child"), F.col("rep").alias("cr")), equiv.select(F.col("elem").alias("parent"), F.col("rep").alias("pr"))
    up = full.join(a, "child").join(b, "parent").select(F.col("cr").alias("child"), F.col("pr").alias("parent")).where("child <> parent").distinct()
    up = cut(up)
    two = up.select("child", F.col("parent").alias("m")).join(up.select(F.col("child").alias("m"), "parent"), "m").select("child", "parent").distinct()
    return equiv, up.join(two, ["child", "parent"], "left_anti")


def told_inclusions(p: Program) -> list[tuple[str, str]]:
    """Atomic inclusions among the rules."""
    return sorted({(r.body[0][1], r.head[1]) for r in p.horn.rules if r.head and r.head[0] == "c" and len(r.body) == 1 and r.body[0][0] == "c" and r.body[0][2] == r.head[2]})


def types(p: Program, direct: bool = False) -> DataFrame:
    """(x, type): every class of every individual; with ``direct`` the most specific ones (of equivalent classes the smallest name)."""
    names = sorted((p.horn.classes | {k[1] for k in p.given if k[0] == "c"}) - {THING.iri, NOTHING.iri})
    live = [n for n in names if p.possible((("c", n, "?x"),))]
    if not live:
        return p.spark.createDataFrame([], "x string, type string")
    every = reduce(DataFrame.unionByName, (p.extension(("c", n)).select("x", F.lit(n).alias("type")) for n in live))
    pairs = told_inclusions(p)
    if not direct or not pairs:
        return every.distinct()
    # told inclusions are axioms: their closure is the driver's business
    up: dict[str, set[str]] = {}
    for c, d in pairs:
        up.setdefault(c, set()).add(d)
    for c in up:
        seen, todo = set(), [c]
        while todo:
            for d in up.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        up[c] = seen
    least = {c: min([c, *(d for d in ds if c in up.get(d, ()))]) for c, ds in up.items()}
    equal = [(c, r) for c, r in least.items() if c != r]
    rep = every.distinct()
    if equal:
        rep = every.join(F.broadcast(p.spark.createDataFrame(equal, "type string, rep string")), "type", "left").select("x", F.coalesce("rep", "type").alias("type")).distinct()
    above = sorted({(least[c], least.get(d, d)) for c, ds in up.items() for d in ds if least[c] != least.get(d, d)})
    if not above:
        return rep
    strict = F.broadcast(p.spark.createDataFrame(above, "c string, p string"))
    covered = rep.join(strict, F.col("type") == F.col("c")).select(F.col("x").alias("x"), F.col("p").alias("type")).distinct()
    return rep.join(covered, ["x", "type"], "left_anti")


def node_sets(p: Program, found: DataFrame) -> DataFrame:
    """(rep, members array): a one-column answer grouped by equality class; members sorted."""
    col = found.columns[0]
    reps = found.select(F.col(col).alias("rep")).distinct()
    if p.same is None:
        return reps.select("rep", F.array("rep").alias("members"))
    sets = p.same.groupBy(F.col("component").alias("rep")).agg(F.sort_array(F.collect_set("node")).alias("members"))
    return reps.join(sets, "rep", "left").select("rep", F.coalesce("members", F.array("rep")).alias("members"))
