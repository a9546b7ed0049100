"""Abbreviated IRIs."""

from __future__ import annotations

import re

from .model.expressions import OWL, RDF, RDFS, XSD

STANDARD = {"owl:": OWL, "rdf:": RDF, "rdfs:": RDFS, "xsd:": XSD}
LOCAL = re.compile(r"[A-Za-z_][\w.\-]*$")
NAME = re.compile(r"([A-Za-z_][\w.\-]*)?:$")


class Prefixes:
    def __init__(self, own: dict[str, str] | None = None, standard: bool = True):
        self.by_name: dict[str, str] = {}
        for n, iri in {**(STANDARD if standard else {}), **(own or {})}.items():
            self.declare(n, iri)

    def declare(self, name: str, iri: str) -> bool:
        """Declare ``name:`` for an IRI; True if that is new. An IRI carries one name only."""
        if not NAME.match(name):
            raise ValueError(f"not a prefix name: {name!r}")
        other = next((n for n, i in self.by_name.items() if i == iri), None)
        if other not in (None, name):
            raise ValueError(f"{iri} is already abbreviated by {other}")
        new = self.by_name.get(name) != iri
        self.by_name[name] = iri
        return new

    def abbreviate(self, iri: str) -> str:
        """By the longest matching prefix; ``<iri>`` if none fits or the rest is not a valid local name."""
        fits = [(len(p), n) for n, p in self.by_name.items() if iri.startswith(p)]
        if fits:
            size, n = max(fits)
            if LOCAL.match(iri[size:]):
                return n + iri[size:]
        return f"<{iri}>"

    def expand(self, text: str) -> str:
        if text.startswith("<"):
            if not text.endswith(">"):
                raise ValueError(f"not an IRI: {text}")
            return text[1:-1]
        name, colon, local = text.partition(":")
        if not colon:
            raise ValueError(f"not an abbreviated IRI: {text}")
        if name + ":" not in self.by_name:
            raise ValueError(f"unknown prefix {name}:")
        return self.by_name[name + ":"] + local

    def items(self):
        return sorted(self.by_name.items())
