"""Every registered query of the library against its SQL."""

import duckdb
import pandas as pd
import pytest

from lexforge.jobs import fixtures as X
from lexforge.jobs.oracles import ORACLES
from lexforge.jobs.queries import QUERIES
from lexforge.sources.stage import stored

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    # Whole numbers beside nulls come as floats from one side and as integers from the other.
    clean = lambda v: "null" if v is None or pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([clean(v) for v in r] for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def built(spark):
    """The point table, built once for the queries that only read it; the query ``payload`` and those of its parts build their own."""
    made, plain = {}, X.payload

    def payload(session, sf_dir, linked=False):
        if (sf_dir, linked) not in made:
            made[sf_dir, linked] = stored(plain(session, sf_dir, linked), "points")
        return made[sf_dir, linked]

    X.payload = payload
    yield
    X.payload = plain


@pytest.mark.usefixtures("built")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"payload", "row_ids"}))
def test_against_sql(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", ["payload", "row_ids"])
def test_build_against_sql(spark, name):
    compare(spark, name)


def compare(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["analyzer_defaults", "response"])
def test_whole_text(spark, name):
    """Questions without a rewritten form are the whole texts."""
    from lexforge.jobs.queries import QUERIES

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["query_id"]: r["query"] for r in QUERIES[name](spark, SF).select("query_id", "query").collect()}
    plain = [i for i in got if i % 3]
    assert any(len(text[i]) > 200 for i in plain) and all(got[i] == text[i] for i in plain)


def test_release(spark, tmp_path):
    from pathlib import Path

    from lexforge.sources import stage

    kept = stored(spark.range(3), "kept")
    path = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    others, stage._stored[:] = stage._stored[:-1], stage._stored[-1:]
    assert path.exists()
    stage.release(spark)
    assert not path.exists() and stage._stored == []
    stage._stored[:] = others


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
