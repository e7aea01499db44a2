"""Every query of the library against DuckDB, and the driver's contract."""

import pytest
from conftest import same_rows
from corpusloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, data, name):
    same_rows(catalog.queries()[name](spark, data).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


def test_sql_only_for_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["pos", "id", "chapter", "relevance"]


def test_library_does_not_need_the_training_data_subpackage():
    from pathlib import Path

    root = Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
