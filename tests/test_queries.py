import duckdb
import pytest

from verdigris import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str([(k, round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v) for k, v in sorted(r.items())]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in got.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(rows) == plain([dict(zip(names, r, strict=True)) for r in found.fetchall()])
