import pytest

from vitrine.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = sorted(map(str, [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]))
    if name in SQL:
        got = duck.execute(SQL[name])
        order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
        assert sorted(df.columns) == sorted(c[0] for c in got.description)
        assert rows == sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())
