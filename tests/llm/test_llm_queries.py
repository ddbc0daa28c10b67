import pytest

from plumbline.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(name, queries.QUERIES[name], oracle.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_query_runs(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_required_columns(spark, small):
    want = {
        "p1_found": [("block_group_id", "string"), ("group_id", "string")], "p2_found": [("station_key", "string"), ("field_name", "string"), ("solution_no", "bigint")],
        "p3_found": [("group_key", "string"), ("station_key", "string")], "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p8_found": [("doc_id", "bigint"), ("category", "string")],
    }
    for name, dtypes in want.items():
        assert queries.QUERIES[name](spark, small).dtypes == dtypes
