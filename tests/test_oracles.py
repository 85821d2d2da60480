"""Every core query with SQL gives the same rows as the SQL."""

import pytest

from vitrine.plans import general, signals

SQL = {**general.SQL, **signals.SQL}
QUERIES = {**general.QUERIES, **signals.QUERIES}


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else None if v is None else str(v)
    return sorted(tuple(str(show(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).collect()
