import duckdb
import pytest

from lodestrata.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    want = con.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)


def test_small_chunks_follow_the_rule(spark):
    from .test_gear import walk

    texts = {r["path"]: bytes(r["content"]) for r in catalogue.tree(spark, SF).collect()}
    got = {}
    for r in catalogue.cdc_chunks(spark, SF).collect():
        got.setdefault(r["path"], []).append((r["seq"], r["offset"] + r["size"]))
    assert {p: [e for _, e in sorted(x)] for p, x in got.items()} == {p: walk(t, catalogue.SMALL) for p, t in texts.items() if t}


def test_plans_prune(spark):
    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "ReadSchema: struct<text:string>" in plan(catalogue.size_prescan_query(spark, SF))
    assert "Python" not in plan(catalogue.incremental_status(spark, SF)) and "Arrow" not in plan(catalogue.chunk_id_keyed(spark, SF))
    assert "text" not in plan(catalogue.parent_snapshot(spark, SF)).split("ReadSchema")[-1]
