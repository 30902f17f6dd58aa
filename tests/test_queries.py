"""Every query of the library's own operators against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strandline import plans
from strandline.operators import ranges

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def listed(rows, columns, names):
    order = [columns.index(n) for n in sorted(names)]
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    found = sql.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert listed(df.collect(), df.columns, names) == listed(found.fetchall(), names, names)


@pytest.mark.parametrize("name", ["e03_average_precision", "e04_ordered_precision", "e09_equal_mass_bins", "e26_rank_auc", "m01_otsu_midgap", "m07_block_ap_parts"])
def test_query_by_ranges_equals_its_sql(spark, sql, name, monkeypatch):
    monkeypatch.setattr(ranges, "FEW_ROWS", 0)
    test_query_equals_its_sql(spark, sql, name)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_repeats_itself(spark, name):
    first, again = (plans.QUERIES[name](spark, SF) for _ in range(2))
    assert first.count() > 0
    assert listed(first.collect(), first.columns, first.columns) == listed(again.collect(), again.columns, again.columns)
