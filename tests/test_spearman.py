import re

import numpy as np
import pandas as pd

from stopwise.operators.rank_tests import spearman


def table(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "y": np.where(rng.random(n) < 0.3, 0.0, rng.integers(0, 400, n) / 7),
            "flag": (rng.random(n) < 0.9).astype(float),
            "wide": rng.normal(size=n) * 1e6,
            "holes": np.where(rng.random(n) < 0.4, np.nan, rng.integers(-3, 3, n)),
            "same": np.full(n, 0.1),
        }
    )
    pdf["wide"] += pdf["y"] * 1e5
    pdf.loc[rng.random(n) < 0.05, "y"] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    names = ", ".join(f"{c} double" for c in pdf.columns)
    return pdf, spark.createDataFrame(rows, names).selectExpr("*", "CAST(NULL AS DOUBLE) AS never")


COLUMNS = ["flag", "wide", "holes", "same", "never"]


def test_spearman_of_ties_holes_and_constants(spark):
    pdf, df = table(spark)
    got = {r["column"]: r for r in spearman(df, COLUMNS, "y").collect()}
    assert set(got) == {"flag", "wide", "holes", "same"}
    for c in ("flag", "wide", "holes"):
        known = pdf[["y", c]].dropna()
        assert got[c]["n"] == len(known)
        assert abs(got[c]["rho"] - known["y"].rank().corr(known[c].rank())) < 1e-9
    assert got["same"]["rho"] is None


def test_no_row_is_joined_by_the_value_of_a_column(spark):
    """A flag has two values: all rows met at two keys when ranks were looked up by (column, value)."""
    plan = spearman(table(spark)[1], COLUMNS, "y")._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join .*", plan)
    assert joins and not [j for j in joins if re.search(r"\bx#\d+", j)]


def test_an_empty_table_has_no_rows(spark):
    assert spearman(table(spark)[1].limit(0), COLUMNS, "y").collect() == []
