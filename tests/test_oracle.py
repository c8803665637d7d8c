"""Every registered query of the engine itself against DuckDB, over whole tables."""

import duckdb
import pandas as pd
import pytest

from textloom.plans import catalogue, more

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


QUERIES, SQL = catalogue.queries() | more.queries(), catalogue.oracle_sql() | more.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x is None or x is pd.NaT or x != x else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    assert [tuple(map(str, x)) for x in a] == [tuple(map(str, x)) for x in b]


def test_classes_are_learnt(spark):
    """The one query without SQL: naive Bayes tells most of the labels that it learnt from."""
    got = QUERIES["classify"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality is not null")
    rows = got.select("prediction", "quality").collect()
    assert set(QUERIES) - set(SQL) == {"classify"} and sum(r.prediction == r.quality for r in rows) >= 0.8 * len(rows)
