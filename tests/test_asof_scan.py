"""Distributed running totals against a pandas brute force, with a hot key
holding most rows (so it spans many range partitions)."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrears.operators.asof import running_totals


def brute(pdf):
    pdf = pdf.sort_values(["k", "t", "id"]).copy()
    g = pdf.groupby("k")
    pdf["n_bf"] = g.cumcount()
    pdf["v_bf"] = g["v"].cumsum() - pdf["v"]
    return pdf


def check(spark, pdf, n_parts):
    df = spark.createDataFrame(pdf, "k string, t long, id long, v double")
    got = running_totals(df, ["k"], ["t", "id"], ["v"], num_partitions=n_parts).toPandas()
    m = brute(pdf).merge(got, on="id")
    assert len(m) == len(pdf)
    assert (m["n_prior"] == m["n_bf"]).all()
    assert np.allclose(m["v_prior"], m["v_bf"])


@pytest.mark.parametrize("n_parts", [1, 4, 17])
def test_hot_key(spark, n_parts):
    rng = np.random.default_rng(7)
    n = 3000
    keys = np.where(rng.random(n) < 0.7, "HOT", rng.choice(["a", "b", "c", "d"], n))
    pdf = pd.DataFrame({"k": keys, "t": rng.integers(0, 40, n), "id": np.arange(n),
                        "v": rng.integers(0, 9, n).astype(float)})
    check(spark, pdf, n_parts)


@settings(max_examples=8, deadline=None)
@given(data=st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.integers(0, 5),
                               st.integers(0, 3)), min_size=1, max_size=60),
       n_parts=st.integers(1, 9))
def test_property(spark, data, n_parts):
    pdf = pd.DataFrame(data, columns=["k", "t", "v"])
    pdf["id"] = np.arange(len(pdf))
    pdf["v"] = pdf["v"].astype(float)
    check(spark, pdf[["k", "t", "id", "v"]], n_parts)


def test_keep_narrows_output(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "b"], "t": [1, 2, 1], "id": [1, 2, 3],
                        "v": [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(pdf, "k string, t long, id long, v double")
    out = running_totals(df, ["k"], ["t", "id"], ["v"], num_partitions=2, keep=["id"])
    assert sorted(out.columns) == sorted(["id", "k", "n_prior", "v_prior"])
    got = {r["id"]: (r["n_prior"], r["v_prior"]) for r in out.collect()}
    assert got == {1: (0, 0.0), 2: (1, 1.0), 3: (0, 0.0)}
