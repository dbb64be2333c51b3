"""Paths whose length is a whole number of sampling steps, where rounding decides."""

import duckdb
import pandas as pd

from tilewright.plans import catalog


def test_whole_numbers_of_steps(spark, tmp_path):
    """Two orders each on one meridian: keys 1,800 apart differ by 40 degrees of latitude or a multiple."""
    rows = [(100 * k + j, k + 1800 * i, pd.Timestamp("2024-01-01") + pd.Timedelta(days=e)) for k in range(60) for j in (1, 2, 3) for e, i in enumerate((0, j))]
    pd.DataFrame(rows, columns=["o_custkey", "o_orderkey", "o_orderdate"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(catalog.SQL["path_metrics"]).fetchall()
    got = [(r.path_id, r.n, r.total, r.samples) for r in catalog.QUERIES["path_metrics"](spark, str(tmp_path)).collect()]
    assert len(want) == 180 and sorted(got) == sorted(want)
