"""Every catalogue query against its SQL in DuckDB, the driver entry, and the independence of the core from the corpus operators."""

import os
import re

import pytest

import __spark_entry__ as entry
from axiomill import catalogue, catalogue_rows  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    want = sql.sql(catalogue.SQL[name])
    cols = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.select(*cols).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_corpus_operators():
    for top, _, files in os.walk(os.path.join(ROOT, "axiomill")):
        if os.sep + "llm" in top:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(top, f), encoding="utf-8") as h:
                    assert not re.search(r"import.*\bllm\b|from\s+\S*\bllm\b", h.read()), f


def test_recursion_stops_on_cycles_and_reports_rounds(spark):
    from axiomill.model.expressions import axiom
    from axiomill.plans.horn import compile_horn
    from axiomill.plans.program import Program, TooManyRounds

    chain = [axiom("ObjectPropertyAssertion", "urn:R", f"n{i}", f"n{i + 1}") for i in range(20)]
    p = Program(spark, compile_horn([axiom("TransitiveObjectProperty", "urn:R"), *chain]), {}, max_rounds=2)
    with pytest.raises(TooManyRounds):
        p.extension(("r", "urn:R"))
