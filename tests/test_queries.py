import pytest
from same import rows_of, rows_of_sql
from test_resolve import written

from conftest import SMALL
from quillon.plans import queries_history, queries_listings, queries_sources, queries_text

MODULES = (queries_listings, queries_text, queries_history, queries_sources)
ALL = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    found = rows_of(ALL[name](spark, SMALL))
    if name in SQL:
        assert found == rows_of_sql(duck, SQL[name])
    else:
        assert found[1]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ALL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The first 500 customers of sf0.01 six times, with shifted keys, and a connection that reads them."""
    import duckdb

    there, c = str(tmp_path_factory.mktemp("copied")), duckdb.connect()
    c.execute("create table nation as select * from '/root/testdata/sf0.01/nation.parquet'")
    c.execute("create table customer as select * replace (CAST(c_custkey + 1500 * i AS BIGINT) AS c_custkey) from '/root/testdata/sf0.01/customer.parquet', range(6) t(i) where c_custkey < 500")
    c.execute("alter table customer drop i")
    for t in ("nation", "customer"):
        c.execute(f"copy {t} to '{there}/{t}.parquet' (format parquet)")
    return there, c


@pytest.mark.parametrize("name", ["q_pass_counters", "q_seed_pass"])
def test_a_pass_over_copies(spark, copied, monkeypatch, name):
    """19 pairs among 500 customers; their copies differ in what is unknown of rent and surface alone: four kinds of each."""
    there, c = copied
    told = written(monkeypatch, "edges")
    assert rows_of(ALL[name](spark, there)) == rows_of_sql(c, SQL[name])
    assert 0 < told["edges"] <= 19 * 16  # pairs of listings: 543
