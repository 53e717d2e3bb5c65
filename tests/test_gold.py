"""The yearly mart of the supplied tables: keys without a value, and what travels by order."""

from __future__ import annotations

import datetime as dt
import re

from workload import gold

ROWS = [  # supplier, order, ship year
    (1, 10, 1996), (1, 10, 1996), (1, 11, 1996), (1, None, 1996), (1, 10, 1997),
    (None, 10, 1996), (None, 12, 1996), (None, 12, None), (2, None, 1998), (2, 13, None),
]


def supplied(spark, folder):
    rows = [(o, 1, s, 1, 1.0, 100.0, 0.0, 0.0, "R", "O", y and dt.datetime(y, 5, 1))
            for s, o, y in ROWS]
    spark.createDataFrame(rows, gold.TABLES["lineitem"]).write.parquet(f"{folder}/lineitem.parquet")
    return gold.mart(spark, str(folder))


def test_orders_are_counted_for_keys_with_and_without_a_value(spark, tmp_path):
    found = {(r["entity_id"], r["year"]): (r["event_count"], r["declaration_count"])
             for r in supplied(spark, tmp_path).collect()}
    assert found == {
        (1, 1996): (4, 2), (1, 1997): (1, 1), (None, 1996): (2, 2), (None, None): (1, 1),
        (2, 1998): (1, 0), (2, None): (1, 1)}


def test_no_sum_travels_by_order(spark, tmp_path):
    rows = supplied(spark, tmp_path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    by_order = re.findall(r"Aggregate\(keys=\[[^\]]*l_orderkey[^\]]*\], functions=\[(.)", plan(rows))
    assert set(by_order) == {"]"}  # keys alone
    # without the number of orders the lines are read once
    assert "Join" not in plan(rows.select("entity_id", "year", "event_count"))
