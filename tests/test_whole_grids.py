"""Resampling and step lengths over a whole table, at two sizes, against their SQL."""

import duckdb
import pytest

from catchment.grid import view
from catchment.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["resample_nearest_whole", "resample_bilinear_whole", "step_lengths_whole"])
def test_the_whole_table_is_worked_on(spark, name, sf):
    _, meta = view(spark, f"{DATA}/{sf}", "dem_part")
    got = sorted(tuple(r) for r in QUERIES[name](spark, f"{DATA}/{sf}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{DATA}/{sf}/part.parquet'")
    want = sorted(con.execute(ORACLE_SQL[name]).fetchall(), key=lambda r: r[:2])
    assert [r[:2] if name != "step_lengths_whole" else r[0] for r in got] == [r[:2] if name != "step_lengths_whole" else r[0] for r in want]
    assert all(a == b or abs(a - b) < 2e-6 for g, w in zip(got, want) for a, b in zip(g, w))
    last = got[-1][0] if name == "step_lengths_whole" else (got[-1][0] + 1) * 0.75 + 1.1
    assert last >= meta.height - (name == "step_lengths_whole")
