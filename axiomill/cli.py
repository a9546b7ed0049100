"""Command line: load, classify, check, ask and dump ontologies in functional syntax."""

from __future__ import annotations

import sys

from .config import Configuration
from .model.expressions import NOTHING, THING, Axiom
from .prefixes import Prefixes
from .reasoner import NAME, VERSION, Reasoner
from .sources.functional import Ontology, load

HELP = """usage: axiomill [options] ontology...
  -h --help  -V --version  -v[N] -q[N]        help, version, more or less said
  -o FILE                                     write results to FILE (- is standard output)
  --premise FILE  --conclusion FILE           two knowledge bases for -E
  -l  -c  -O  -D  -P                          load only; classify classes, object, data properties; pretty-print
  -k[CLASS]  -d  -s CLASS  -S CLASS           satisfiability; direct; subclasses; superclasses
  -e CLASS  -U  -E                            equivalents; unsatisfiable classes; entailment of the conclusion
  -N  -p PN=IRI  --prefix=PN=IRI              no standard prefixes; declare a prefix
  --print-prefixes  --base DIR  --dump-clauses[=FILE]
  --block-match M  --block-strategy S  --blockersCache  --expansion-strategy X
  --ignoreUnsupportedDatatypes  --noInconsistentException
"""
VALUED = ("-o", "--premise", "--conclusion", "-s", "-S", "-e", "-p", "--prefix", "--base", "--block-match", "--block-strategy", "--expansion-strategy", "--subs", "--supers", "--equivalents")
LONG = {"--output": "-o", "--load": "-l", "--classify": "-c", "--classifyOPs": "-O", "--classifyDPs": "-D", "--prettyPrint": "-P", "--consistency": "-k", "--direct": "-d", "--subs": "-s", "--supers": "-S", "--equivalents": "-e", "--unsatisfiable": "-U", "--checkEntailment": "-E", "--no-prefixes": "-N"}
MATCH = {"single": "SINGLE", "pairwise": "PAIR_WISE", "pair-wise": "PAIR_WISE", "optimal": "OPTIMAL"}
STRATEGY = {"anywhere": "ANYWHERE", "ancestor": "ANCESTOR", "core": "SIMPLE_CORE", "optimal": "OPTIMAL"}
EXPANSION = {"creation": "CREATION_ORDER", "el": "EL", "reuse": "INDIVIDUAL_REUSE"}


class UsageError(Exception):
    pass


class Plan:
    def __init__(self):
        self.files, self.actions, self.settings = [], [], {"throw_on_inconsistent": True}
        self.output, self.base, self.conclusion, self.verbosity = "-", None, None, 1
        self.standard, self.prefixes, self.classify, self.pretty, self.info = True, [], [], False, None


def parse_arguments(argv: list[str]) -> Plan:
    """What the arguments ask for, without loading anything."""
    p, i, direct = Plan(), 0, False
    while i < len(argv):
        a, value = argv[i], None
        i += 1
        if a.startswith("--") and "=" in a:
            a, _, value = a.partition("=")
        a = LONG.get(a, a)

        def need(a=a, value=value):
            nonlocal i
            if value is not None:
                return value
            if i >= len(argv):
                raise UsageError(f"{a} needs a value")
            i += 1
            return argv[i - 1]

        if a in ("-h", "--help"):
            p.info = HELP
        elif a in ("-V", "--version"):
            p.info = f"{NAME} {VERSION}\n"
        elif a[:2] in ("-v", "-q") and (a[2:] == "" or a[2:].isdigit()):
            p.verbosity += int(a[2:] or 1) * (1 if a[1] == "v" else -1)
        elif a == "-o":
            p.output = need()
        elif a == "--premise":
            p.files.append(need())
        elif a == "--conclusion":
            p.conclusion = need()
        elif a == "-l":
            p.actions.append(("load",))
        elif a in ("-c", "-O", "-D"):
            p.classify.append({"-c": "class", "-O": "object", "-D": "data"}[a])
        elif a == "-P":
            p.pretty = True
        elif a.startswith("-k") and not a.startswith("--"):
            p.actions.append(("satisfiable", a[2:] or value or THING.iri))
        elif a == "-d":
            direct = True
        elif a in ("-s", "-S"):
            p.actions.append(("subs" if a == "-s" else "supers", need(), direct))
            direct = False
        elif a == "-e":
            p.actions.append(("equivalents", need()))
        elif a == "-U":
            p.actions.append(("equivalents", NOTHING.iri))
        elif a == "-E":
            p.actions.append(("entails",))
        elif a == "-N":
            p.standard = False
        elif a in ("-p", "--prefix"):
            name, eq, iri = need().partition("=")
            if not eq:
                raise UsageError("a prefix is declared as PN=IRI")
            p.prefixes.append((name if name.endswith(":") else name + ":", iri))
        elif a == "--base":
            p.base = need()
        elif a == "--print-prefixes":
            p.actions.append(("prefixes",))
        elif a == "--dump-clauses":
            p.actions.append(("clauses", value))
        elif a in ("--block-match", "--block-strategy", "--expansion-strategy"):
            field, table = {"--block-match": ("direct_blocking", MATCH), "--block-strategy": ("blocking", STRATEGY), "--expansion-strategy": ("existential", EXPANSION)}[a]
            v = need()
            if v not in table:
                raise UsageError(f"unknown value {v} of {a}")
            p.settings[field] = table[v]
        elif a == "--blockersCache":
            p.settings["signature_cache"] = "CACHED"
        elif a == "--ignoreUnsupportedDatatypes":
            p.settings["ignore_unsupported_datatypes"] = True
        elif a == "--noInconsistentException":
            p.settings["throw_on_inconsistent"] = False
        elif a.startswith("-") and a != "-":
            raise UsageError(f"unknown option {a}")
        else:
            p.files.append(a)
    if p.classify:
        p.actions.append(("classify", tuple(dict.fromkeys(p.classify))))
    if any(x[0] == "entails" for x in p.actions) and not p.conclusion:
        raise UsageError("-E needs --conclusion")
    return p


def main(argv: list[str], out=None, err=None) -> int:
    """Run; the exit code: 0, 1 for an error of use or loading, 2 for a reasoning error."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        p = parse_arguments(argv)
    except UsageError as e:
        err.write(f"{e}\n")
        return 1
    if p.info:
        out.write(p.info)
        return 0
    if not p.files:
        err.write("no ontology given\n")
        return 1
    try:
        onto = Ontology.merged(*(load(f, p.base) for f in p.files))
        prefixes = Prefixes({**onto.prefixes.by_name}, standard=False) if p.standard else Prefixes(standard=False)
        for n, iri in p.prefixes:
            prefixes.by_name[n] = iri
        r = Reasoner(onto, Configuration(**p.settings, warn=lambda m: err.write(m + "\n")))
    except (OSError, ValueError) as e:
        err.write(f"{e}\n")
        return 1
    sink = out if p.output == "-" else open(p.output, "w", encoding="utf-8")  # noqa: SIM115
    try:
        for action, *args in p.actions:
            run(r, action, args, prefixes, p, sink)
    except (ValueError, KeyError) as e:
        err.write(f"{e}\n")
        return 2
    except Exception as e:
        err.write(f"{type(e).__name__}: {e}\n")
        return 2
    finally:
        if sink is not out:
            sink.close()
    return 0


def run(r: Reasoner, action: str, args: list, prefixes: Prefixes, p: Plan, sink) -> None:
    def iri(text: str) -> str:
        return prefixes.expand(text) if text.startswith("<") or ":" in text and text.partition(":")[0] + ":" in prefixes.by_name else text

    def listing(head: str, names: list[str]) -> None:
        sink.write(head + "\n" + "".join(f"\t{prefixes.abbreviate(n)}\n" for n in names))

    if action == "classify":
        for kind in args[0]:
            sink.write(r.print_hierarchy(kind, prefixes) if p.pretty else "".join(f"{x}\n" for x in r.dump_hierarchy(kind)))
    elif action == "satisfiable":
        sink.write(f"{prefixes.abbreviate(iri(args[0]))} is {'' if r.is_satisfiable(iri(args[0])) else 'not '}satisfiable.\n")
    elif action in ("subs", "supers"):
        find = r.sub_classes if action == "subs" else r.super_classes
        listing(f"{'Direct' if args[1] else 'All'} {'sub' if action == 'subs' else 'super'}-classes of {prefixes.abbreviate(iri(args[0]))}:", find(iri(args[0]), args[1]))
    elif action == "equivalents":
        listing(f"Classes equivalent to {prefixes.abbreviate(iri(args[0]))}:", r.equivalent_classes(iri(args[0])))
    elif action == "entails":
        goal: list[Axiom] = load(p.conclusion, p.base).axioms
        sink.write(f"{str(r.is_entailed(goal)).lower()}\n")
    elif action == "prefixes":
        sink.write("Prefixes:\n" + "".join(f"\t{n}\t{i}\n" for n, i in prefixes.items()))
    elif action == "clauses":
        text = r.dump_clauses(prefixes)
        if args[0]:
            with open(args[0], "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sink.write(text)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
