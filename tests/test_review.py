"""Checks of pictures, reviews and settings against small cases."""

import duckdb
import pandas as pd
import pytest

from geoloom.operators import review
from geoloom.plans import checks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_equals_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "customer", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(checks.ORACLE_SQL[name]).df(), checks.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=1e-6)


def test_blank_and_one_row(spark):
    one = spark.createDataFrame([(1, 0, 0, 5, 5, 5), (1, 0, 1, 5, 5, 5)], "image long, row long, col long, r long, g long, b long")
    assert review.readback(one).first().asDict() == {"image": 1, "spread": 0.0, "greys": 1, "is_real": False}
    assert review.horizon(one).first().asDict() == {"image": 1, "difference": None, "visible": False}


def test_review_without_answers(spark):
    hashes = spark.createDataFrame([("wide", "a"), ("close", None)], "slot string, hash string")
    asked = spark.createDataFrame([("wide", "q1", "blocker"), ("wide", "q2", "minor"), ("gone", "q1", "blocker")], "slot string, question string, severity string")
    said = spark.createDataFrame([], "slot string, question string, answer string")
    assert [tuple(r) for r in review.review_gate(hashes, hashes, asked, said).collect()] == [("wide", "q1", "missing")]
