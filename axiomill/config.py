"""Reasoner configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

BLOCKING = ("OPTIMAL", "ANYWHERE", "ANCESTOR", "SIMPLE_CORE", "COMPLEX_CORE")
DIRECT_BLOCKING = ("OPTIMAL", "PAIR_WISE", "SINGLE")
EXISTENTIAL = ("CREATION_ORDER", "INDIVIDUAL_REUSE", "EL")
CACHE = ("CACHED", "NOT_CACHED")
MONITORS = ("NONE", "TIMING", "TIMING_WITH_PAUSE", "DEBUGGER_NO_HISTORY", "DEBUGGER_HISTORY_ON")


@dataclass(frozen=True)
class Configuration:
    """Settings of a reasoner; unknown values raise. Core blocking is served by anywhere blocking, with a warning; labels are always
    compared with their parents' and edges' (pairwise), which is sound for every setting of ``direct_blocking``; witnesses are always fresh."""

    throw_on_inconsistent: bool = True
    buffer_changes: bool = True
    fresh_entities: str = "ALLOW"
    individual_sets: str = "BY_NAME"
    blocking: str = "OPTIMAL"
    direct_blocking: str = "OPTIMAL"
    existential: str = "CREATION_ORDER"
    signature_cache: str = "CACHED"
    ignore_unsupported_datatypes: bool = False
    use_disjunction_learning: bool = True
    task_timeout_ms: int = -1
    monitor_type: str = "NONE"
    monitor: object | None = None
    warn: Callable[[str], None] | None = None
    progress: Callable[[str, int, int], None] | None = None
    symmetric_different: bool = True

    def __post_init__(self):
        for name, allowed in (("blocking", BLOCKING), ("direct_blocking", DIRECT_BLOCKING), ("existential", EXISTENTIAL), ("signature_cache", CACHE), ("monitor_type", MONITORS), ("fresh_entities", ("ALLOW", "DISALLOW")), ("individual_sets", ("BY_NAME", "BY_SAME_AS"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.blocking.endswith("_CORE") and self.warn:
            self.warn(f"Blocking strategy {self.blocking} is not implemented; anywhere blocking is used")

    @staticmethod
    def of(value: Configuration | dict | None) -> Configuration:
        if isinstance(value, Configuration):
            return value
        known = {f.name for f in fields(Configuration)}
        if unknown := set(value or {}) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Configuration(**(value or {}))

    @property
    def kernel_blocking(self) -> str:
        return "ancestor" if self.blocking == "ANCESTOR" else "anywhere"
