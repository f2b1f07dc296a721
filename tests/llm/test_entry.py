import __spark_entry__ as entry
from kindred.llm.entry import oracle_sql, queries


def test_every_operator_has_one_query_and_sql_is_text():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries()) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
