"""Order statistics against brute force, with one group that holds most rows and values with many copies."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import order_stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdef"), n))
    value = np.round(rng.lognormal(3, 2, n) * rng.choice([-1, 1], n), 2)
    value[rng.random(n) < 0.35] = 0.0
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "v": value, "w": rng.normal(1000, 0.01, n)})
    df = spark.createDataFrame(pdf)
    with_gaps = df.withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v")))
    return with_gaps.cache(), pdf.assign(v=pdf.v.where(pdf.id % 17 != 0))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_equal_linear_interpolation(skewed, q):
    df, pdf = skewed
    found = {r["g"]: (r["v"], r["w"]) for r in order_stats.exact_quantiles(df, ["g"], ["v", "w"], q).collect()}
    for g, part in pdf.groupby("g"):
        assert found[g][0] == pytest.approx(np.percentile(part.v.dropna(), q * 100), abs=1e-9)
        assert found[g][1] == pytest.approx(np.percentile(part.w, q * 100), abs=1e-9)


def test_quantile_of_all_rows_and_of_an_empty_column(skewed):
    df, pdf = skewed
    empty = df.withColumn("none", F.lit(None).cast("double"))
    row = order_stats.exact_quantiles(empty, [], ["v", "none"], 0.5).first()
    assert row["v"] == pytest.approx(pdf.v.median()) and row["none"] is None


def test_running_totals(skewed):
    df, pdf = skewed
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for descending in (False, True):
        got = order_stats.running_totals(counts, ["g"], ["v"], ["n"], descending).toPandas()
        expected = pdf.dropna().groupby(["g", "v"]).size().rename("n").reset_index()
        expected = expected.sort_values(["g", "v"], ascending=[True, not descending])
        expected["upto"] = expected.groupby("g").n.cumsum()
        merged = got.merge(expected, on=["g", "v"])
        assert len(merged) == len(expected) and (merged.n_upto == merged.upto).all()
        assert (got.groupby("g").n_all.first() == expected.groupby("g").n.sum()).all()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_row_numbers(skewed, keys):
    df, pdf = skewed
    got = order_stats.row_numbers(df.where("v is not null"), keys, "v", "id", "rank").toPandas()
    expected = pdf.dropna().sort_values(["v", "id"], ascending=[False, True])
    ranks = expected.groupby(keys).cumcount() + 1 if keys else pd.Series(range(1, len(expected) + 1), expected.index)
    merged = got.merge(expected.assign(expected=ranks)[["id", "expected"]], on="id")
    assert len(merged) == len(expected) and (merged["rank"] == merged.expected).all()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=2, max_size=50))
def test_cells_keep_the_order(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    cells = rows.select("v", order_stats.value_cell(F.col("v")).alias("c")).collect()
    ordered = [r["c"] for r in sorted(cells, key=lambda r: r["v"])]
    assert ordered == sorted(ordered)


def test_no_task_sees_a_whole_group(skewed):
    """Windows over rows are partitioned by cell; those without are over counts per cell."""
    df, _ = skewed
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    plan = order_stats.running_totals(counts, ["g"], ["v"], ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_cell" in line for line in windows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=5), min_size=2, max_size=40))
def test_text_cells_keep_the_order(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    cells = rows.select("v", order_stats.tie_cell(rows, "v").alias("c")).orderBy("v").collect()
    ordered = [r["c"] for r in cells]
    assert ordered == sorted(ordered)
