"""Every query that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from millrace.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("None" if x is None or x != x else repr(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(found)
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        assert rows(found) == rows(con.execute(SQL[name]).df())
