import duckdb
import pytest

from lectern import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(sf):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return own


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, sf, base, name):
    rows = registry.QUERIES[name](spark, sf)
    columns = sorted(rows.columns)
    got = sorted((tuple(map(plain, r)) for r in rows.select(*columns).collect()), key=repr)
    if name in registry.ORACLES:
        want = base.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name].strip()})").fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    else:
        assert got
