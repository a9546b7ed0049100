"""Observers of satisfiability tests: counting, timing, memory; adapters and forks. A monitor never changes or breaks a test."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass


@dataclass
class Record:
    task: str
    ms: float
    satisfiable: bool
    nodes: int
    backtracks: int


class MonitorAdapter:
    """Every hook as a no-op: override what you need."""

    def describe(self, task: str) -> None: ...
    def start(self) -> None: ...
    def backtrack(self) -> None: ...
    def finish(self, state) -> None: ...


class MonitorFork(MonitorAdapter):
    """Each hook reaches all monitors."""

    def __init__(self, *monitors: MonitorAdapter):
        self.monitors = monitors

    def describe(self, task):
        for m in self.monitors:
            m.describe(task)

    def start(self):
        for m in self.monitors:
            m.start()

    def backtrack(self):
        for m in self.monitors:
            m.backtrack()

    def finish(self, state):
        for m in self.monitors:
            m.finish(state)


class CountingMonitor(MonitorAdapter):
    """Tests, time, backtracks and nodes, by task description."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.records: list[Record] = []
        self.task, self._began, self._back = "", 0.0, 0

    def describe(self, task):
        self.task = task

    def start(self):
        self._began, self._back = time.perf_counter(), 0

    def backtrack(self):
        self._back += 1

    def finish(self, state):
        nodes = len(state.nodes) if state is not None else 0
        self.records.append(Record(self.task, (time.perf_counter() - self._began) * 1000, state is not None, nodes, self._back))

    def summary(self) -> dict:
        r = self.records
        return {"tests": len(r), "time_ms": sum(x.ms for x in r), "backtracks": sum(x.backtracks for x in r), "nodes": sum(x.nodes for x in r), "clashes": sum(not x.satisfiable for x in r)}

    def patterns(self) -> list[str]:
        return sorted({r.task for r in self.records})

    def slowest(self, limit: int = 10, task: str | None = None) -> list[Record]:
        return sorted((r for r in self.records if task in (None, r.task)), key=lambda r: -r.ms)[:limit]


class Timer(CountingMonitor):
    """Prints a line for each test."""

    def __init__(self, write=None, pause: bool = False):
        super().__init__()
        self.write, self.pause = write or sys.stdout.write, pause

    def finish(self, state):
        super().finish(state)
        r = self.records[-1]
        self.write(f"{r.task or 'test'}: {'satisfiable' if r.satisfiable else 'unsatisfiable'} in {r.ms:.1f} ms, {r.nodes} nodes, {r.backtracks} backtracks\n")
        if self.pause and sys.stdin is not None and sys.stdin.isatty():
            input()


class MemoryMonitor(CountingMonitor):
    """Estimated bytes of completion graphs: current, average, peak."""

    def reset(self):
        super().reset()
        self.sizes: list[int] = []

    def finish(self, state):
        super().finish(state)
        self.sizes.append(0 if state is None else sum(sys.getsizeof(n.label) + 64 * len(n.label) for n in state.nodes.values()) + sum(128 * len(e) for e in state.edges.values()))

    def memory(self) -> dict:
        return {"current": self.sizes[-1] if self.sizes else 0, "average": sum(self.sizes) / len(self.sizes) if self.sizes else 0.0, "peak": max(self.sizes, default=0)}


def monitor_for(kind: str, own=None, write=None):
    """The monitor that a setting names, joined with one's own."""
    made = {"NONE": None, "TIMING": lambda: Timer(write), "TIMING_WITH_PAUSE": lambda: Timer(write, True)}.get(kind, CountingMonitor)
    made = made() if made else None
    return MonitorFork(made, own) if made and own else made or own
