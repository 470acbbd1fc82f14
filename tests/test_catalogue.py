from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tessera.plans import catalogue


def same(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in Path(tiny).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_twin(spark, duck, tiny, name):
    df = contract.queries()[name](spark, tiny)
    want = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert same(df.collect(), df.columns) == same(want.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_of_the_catalogue_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_pages_diff_of_repeated_addresses(spark, tmp_path):
    """A row for each pair of pages with one address. Which of such pages comes first, the twin's order leaves open, so
    si and status aren't compared."""
    rows = [(i, f"http://a/{i % 40}/x", f"text {i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = contract.queries()["pages_diff"](spark, str(tmp_path)).select("ti", "path", "kind").collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select ti, path, kind from ({contract.oracle_sql()['pages_diff']}) where kind = 'exact'").fetchall()
    assert sorted(tuple(r) for r in got if r["kind"] == "exact") == sorted(want)
    assert len(want) > len({ti for ti, _, _ in want})
