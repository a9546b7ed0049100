"""Conjunctive queries: a spec of atoms over a program's materialised facts, answered as joins with set semantics.

    {"select": ["?p", "?c"], "where": [{"class": "urn:Person", "arg": "?p"}, {"object_property": "urn:livesIn", "subject": "?p", "object": "?c"}]}

Atoms: class/arg, datatype/arg, object_property (or inverse_object_property)/subject/object, data_property/subject/value,
different_from: [a, b]. There is no same_as atom: equal individuals are merged, so equality is a repeated variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.expressions import Individual, Literal
from .horn import plain_atoms
from .program import Inconsistent, Program

KEYS = {
    "class": ("arg",), "datatype": ("arg",), "object_property": ("subject", "object"), "inverse_object_property": ("subject", "object"), "data_property": ("subject", "value"),
}


def term(t):
    """"?x" is a variable, other strings are IRIs; Literals and Individuals are themselves; {"literal": lex, "datatype" or "lang"} too."""
    if isinstance(t, (Individual, Literal)):
        return t
    if isinstance(t, str):
        return t if t.startswith("?") else Individual(t.strip("<>"))
    if isinstance(t, dict):
        if "variable" in t:
            return "?" + t["variable"].lstrip("?")
        if "individual" in t:
            return Individual(t["individual"])
        if "anonymous" in t:
            return Individual("_:" + t["anonymous"].removeprefix("_:"), True)
        if "literal" in t:
            return Literal.of(t["literal"], t.get("datatype"), t.get("lang"))
    raise ValueError(f"not a query term: {t!r}")


def atoms_of(where: list[dict]) -> list[tuple]:
    if not isinstance(where, (list, tuple)) or not where:
        raise ValueError("a query needs a non-empty list of atoms in 'where'")
    out = []
    for a in where:
        if "same_as" in a:
            raise ValueError("same_as is not an atom: equal individuals are merged, repeat the variable instead")
        if "different_from" in a:
            x, y = a["different_from"]
            out.append(("ne", term(x), term(y)))
            continue
        kind = next((k for k in KEYS if k in a), None)
        if kind is None:
            raise ValueError(f"unknown atom {a!r}")
        args = [term(a[k]) for k in KEYS[kind]]
        if kind == "class":
            out.append(("c", a[kind], *args))
        elif kind == "datatype":
            out.append(("g", a[kind], *args))
        elif kind == "data_property":
            out.append(("d", a[kind], *args))
        else:
            out.append(("r", a[kind], *(reversed(args) if kind.startswith("inverse") else args)))
    return out


def answer(program: Program, spec: dict, check: bool = True) -> DataFrame:
    """The answer set: one STRING column for each answer term (variables without "?"), rows distinct, order unspecified.

    ``select`` defaults to the variables in order of first appearance; ground terms echo as constants; an empty ``select`` is a boolean
    query: one row if it holds. Unknown constants match nothing. Raises on an inconsistent knowledge base (unless ``check`` is False),
    an empty body, or an answer variable that no atom binds.
    """
    atoms = plain_atoms(atoms_of(spec["where"]))
    given = [term(t) for a in spec["where"] for t in (a["different_from"] if "different_from" in a else [a[k] for k in ("arg", "subject", "object", "value") if k in a])]
    order = list(dict.fromkeys(t for t in given if isinstance(t, str) and t.startswith("?")))
    select = [term(t) for t in spec["select"]] if spec.get("select") is not None else order
    for t in select:
        if isinstance(t, str) and t not in order:
            raise ValueError(f"answer variable {t} does not occur in the body")
    if check and not program.is_consistent():
        raise Inconsistent("the knowledge base is unsatisfiable: every tuple is an answer")
    if not program.possible(tuple(atoms)):
        cols = ", ".join(f"`{t.lstrip('?') if isinstance(t, str) else f'c{i}'}` string" for i, t in enumerate(select)) or "holds string"
        return program.spark.createDataFrame([], cols)
    found = program.body(tuple(atoms), {})
    if not select:
        return found.select(F.lit("true").alias("holds")).limit(1)
    return found.select(*(program._term(t).alias(t[1:] if isinstance(t, str) else f"c{i}") for i, t in enumerate(select))).distinct()


def each(program: Program, spec: dict, collect, check: bool = True) -> int:
    """Hand every answer row to ``collect``, partition by partition, without holding them all; the number of rows."""
    n = 0
    for row in answer(program, spec, check).toLocalIterator():
        collect(tuple(row))
        n += 1
    return n
