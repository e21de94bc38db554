"""Every store query that SQL can express, against DuckDB at the smallest size."""

import duckdb
import pytest

from satchel.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "events", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(columns).collect())))
    duck.execute(catalog.oracles()[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in duck.fetchall())
    assert got == want


def test_drain_covers_all_pending(spark):
    t = catalog.tables(spark, DATA)
    done = {r.id: r for r in catalog.queries()["drain_outcomes"](spark, DATA).collect()}
    pending = t["queue"].filter("error is null").collect()
    assert set(done) == {r.id for r in pending}
    for r in pending:
        if r.action == "submit":
            assert done[r.id].outcome == "skipped"
        elif r.payload == "nope":
            assert (done[r.id].outcome, done[r.id].error) == ("parked", "malformed payload")


def test_page_filter_reaches_the_scan(spark):
    from satchel.operators import reads

    items = catalog.tables(spark, DATA)["items"]
    plan = reads.page(items, "en/src1", "asc", ("2024-01-01", 5))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(sort_key" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "retained_at" not in plan.split("ReadSchema")[1].split("\n")[0]
