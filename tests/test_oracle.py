"""Every query that SQL can express, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"


#: With page numbers of four digits, and counts of many rows.
LARGER = "/root/testdata/sf0.01"


def connect(folder=SF):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    found = entry.queries()[name](spark, SF)
    expected = connect().execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    values = expected.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, values)
    assert values


@pytest.mark.parametrize("name", ["problem_image_names", "file_names", "shares_as_text"])
def test_same_rows_of_more(spark, name):
    found = entry.queries()[name](spark, LARGER)
    expected = connect(LARGER).execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql())
