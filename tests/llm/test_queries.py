import pytest

from promptbook.llm import queries as q
from tests.compare import both

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.SQL))
@pytest.mark.parametrize("folder", [SMALL, MORE])
def test_query_equals_its_sql(spark, name, folder):
    cols, names, got, want = both(spark, folder, q.QUERIES[name], q.SQL[name])
    assert cols == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_query_without_sql(spark, name):
    rows = q.QUERIES[name](spark, SMALL).collect()
    assert len(rows) == len(set(map(str, rows)))


FOUND = {"p1_found": ["group_key", "character_id"], "p2_found": ["field", "term", "mark"], "p3_found": ["tcp", "name_a", "name_b"], "p4_found": ["character_id", "term"], "p5_found": ["id_a", "id_b"], "p6_found": ["row_id", "kind", "piece"], "p7_found": ["character_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, name):
    assert q.QUERIES[name](spark, SMALL).columns == FOUND[name]
