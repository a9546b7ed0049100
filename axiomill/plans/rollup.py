"""Conclusions about anonymous individuals: forests of them are rolled up into class expressions of what they hang on."""

from __future__ import annotations

from ..model.expressions import THING, Axiom, Expr, HasValue, Some, axiom, conj, data_has_value


def rolled_up(axioms: list[Axiom]) -> list[Axiom]:
    """The same conclusion without anonymous individuals: each tree becomes an assertion of its named root, or - if no named individual
    touches it - the claim that something of that kind exists. Cycles of anonymous individuals raise."""
    out, own, links, datas = [], {}, {}, {}
    for a in axioms:
        z = a.args
        if a.kind == "ClassAssertion" and z[1].anonymous:
            own.setdefault(z[1], []).append(z[0])
        elif a.kind == "ObjectPropertyAssertion" and (z[1].anonymous or z[2].anonymous):
            links.setdefault(z[1], []).append((z[0], z[2]))
            links.setdefault(z[2], []).append((z[0].inverse(), z[1]))
        elif a.kind == "DataPropertyAssertion" and z[1].anonymous:
            datas.setdefault(z[1], []).append((z[0], z[2]))
        elif a.kind in ("SameIndividual", "DifferentIndividuals") and any(i.anonymous for i in z):
            raise ValueError(f"{a.kind} with anonymous individuals is not supported")
        else:
            out.append(a)
    every = {i for i in (*own, *links, *datas) if i.anonymous}
    done: set = set()

    def roll(x, came) -> Expr:
        if x in done:
            raise ValueError("anonymous individuals form a cycle")
        done.add(x)
        parts: list[Expr] = [*own.get(x, []), *(data_has_value(p, v) for p, v in datas.get(x, []))]
        skipped = False
        for r, y in links.get(x, []):
            if came is not None and not skipped and (r, y) == came:
                skipped = True
            elif y.anonymous:
                parts.append(Some(r, roll(y, (r.inverse(), x))))
            else:
                parts.append(HasValue(r, y))
        return conj(parts)

    for a in sorted(i for i in links if not i.anonymous):
        for r, y in links[a]:
            if y.anonymous and y not in done and any((s, b) == (r.inverse(), a) for s, b in links[y]):
                out.append(axiom("ClassAssertion", Some(r, roll(y, (r.inverse(), a))), a))
    for x in sorted(every - done):
        if x not in done:
            from ..model.expressions import TOP_ROLE, Individual, Role

            out.append(axiom("ClassAssertion", _exists(roll(x, None)), Individual("internal:any")))
    return [a for a in out if a.args and a.args[0] != THING]


def _exists(c: Expr) -> Expr:
    """Something is a ``c``: stated through the universal role."""
    from ..model.expressions import TOP_ROLE, Role

    return Some(Role(TOP_ROLE), c)
