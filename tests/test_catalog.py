import pytest

import __spark_entry__ as e
from promptbook.plans import catalog
from tests.compare import both


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, small, name):
    cols, names, got, want = both(spark, small, catalog.QUERIES[name], catalog.SQL[name])
    assert cols == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"preset_summaries"}))
def test_query_without_sql_gives_rows(spark, small, name):
    rows = catalog.QUERIES[name](spark, small).collect()
    assert len(rows) == len(set(map(str, rows)))


def test_entry(spark):
    assert e.entry(spark).columns == ["cluster", "n_members", "top_words", "top_characters", "label"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_only_what_they_need(spark, small):
    plan = catalog.QUERIES["author_histogram"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "speech_text" not in plan and "theater" not in plan and "topic_label" not in plan
