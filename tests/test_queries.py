"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tallyframe.plans.registry import QUERIES
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql is not None))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SF_DIR) is None


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    first = driver.entry(spark)
    assert first.columns == ["metric", "label", "other", "value"]
    assert first.count() > 0


def test_entry_without_the_optional_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(driver.queries()) == set(QUERIES) and "pipeline" not in driver.queries()
    assert set(driver.oracle_sql()) <= set(QUERIES)


def test_nothing_imports_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(driver.__file__).parent
    others = [f for f in (root / "tallyframe").rglob("*.py") if "llm" not in f.relative_to(root).parts]
    assert len(others) > 20 and not any("llm" in f.read_text() for f in others)
