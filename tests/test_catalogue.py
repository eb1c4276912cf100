"""Every registered query against its SQL."""

import duckdb
import pytest

from geosluice import catalogue

NAMES = list(catalogue.queries())


def plain(row):
    return tuple("%.9g" % v if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_parcels_are_whole(spark, sf, tmp_path):
    for name in catalogue.TABLES:
        if name != "customer":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    spark.range(9_998, 12_346).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    pnu = {r.c_custkey: r.pnu for r in catalogue.fixture(spark, str(tmp_path), "parcels").collect()}
    assert len(pnu) == 2348 and all(len(v) == 19 and v.isdigit() for v in pnu.values())
    got = {r.c_custkey: r.value for r in catalogue.queries()["fn_parcel"](spark, str(tmp_path)).collect()}
    assert len(got) == 2348 and got[12_345] == "27/345/415/45/1/2345/7035"


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(plain([r[i] for i in at]) for r in want.fetchall())
