"""Column rules against hand-computed rows (FIXTURES.md §1, §3)."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions import rules
from arrears.functions.rounding import round_half_even

REQUESTS = [
    # low risk, critical, standard
    ("low", 8000.0, 0, 500.0, dt.date(2024, 5, 2), dt.date(2024, 6, 1)),
    ("critical", 1000.0, 5, 25000.0, dt.date(2024, 1, 1), dt.date(2024, 6, 29)),
    ("standard", 45000.0, 2, 8500.50, dt.date(2024, 3, 15), dt.date(2024, 9, 20)),
]


@pytest.fixture()
def requests_df(spark):
    return spark.createDataFrame(
        REQUESTS, "name string, revenu double, inc long, amount double, d0 date, d1 date")


def test_serving_risk_delay_and_cold_scores(requests_df):
    out = requests_df.select(
        "name",
        rules.risk_score_serving("inc", "amount").alias("risk"),
        rules.case_delay("d0", "d1").alias("delay"),
        rules.lawyer_score_feature(F.lit(S.DEFAULT_SUCCESS_RATE),
                                   rules.case_delay("d0", "d1")).alias("f7"),
        rules.lawyer_score(F.lit(S.DEFAULT_SUCCESS_RATE), F.lit(S.DEFAULT_MEAN_DELAY)).alias("f8"),
    ).collect()
    got = {r["name"]: r for r in out}
    assert [got[n]["risk"] for n in ("low", "critical", "standard")] == [1, 75, 28]
    assert [got[n]["delay"] for n in ("low", "critical", "standard")] == [30, 180, 189]
    assert got["low"]["f7"] == pytest.approx(63.5)
    assert got["critical"]["f7"] == pytest.approx(56.0)
    assert got["standard"]["f7"] == pytest.approx(55.55)
    assert {r["f8"] for r in out} == {59.0}


def test_next_best_action_table(spark):
    rows = [(39, "Amiable", 3, 500, 20, "Relance amiable"),
            (40, "Amiable", 1, 10, 1, "Mise en demeure"),
            (70, "Judiciaire", 1, 10, 1, "Mise en demeure"),
            (71, "Judiciaire", 0, 10, 1, "Action judiciaire"),
            (71, "Amiable", 4, 301, 1, "Négociation"),
            (50, "Amiable", 0, 300, 11, "Négociation"),
            (50, "Amiable", 0, 300, 10, "Relance amiable")]
    df = spark.createDataFrame(rows, "s int, p string, d int, a int, i int, want string")
    got = df.select(rules.next_best_action("s", "p", "d", "a", "i").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_recovered_amount(spark):
    df = spark.createDataFrame([(s, 1000.0) for s in S.STATUSES], "st string, amt double")
    got = {r["st"]: r["v"] for r in df.select(
        "st", rules.recovered_amount("st", "amt", 0.25).alias("v")).collect()}
    assert got == {"Recouvré": 1000.0, "En cours": 250.0, "Échec": 0.0}


def test_half_even_rounding_matches_numpy(spark):
    import numpy as np
    vals = [2.675, 0.125, 0.135, 1.005, 59.25, 27.335, -0.5, 2.5, 66.7 - 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


@settings(max_examples=25, deadline=None)
@given(inc=st.integers(0, 50), amount=st.floats(0.01, 1e7, allow_nan=False),
       income=st.floats(1.0, 1e7, allow_nan=False))
def test_scores_stay_in_bounds(spark, inc, amount, income):
    df = spark.createDataFrame([(inc, amount, income)], "i long, a double, r double")
    r = df.select(rules.risk_score_serving("i", "a").alias("f1"),
                  rules.base_risk_score(rules.debt_ratio("a", "r")).alias("f3"),
                  rules.judicial_probability(rules.base_risk_score(
                      rules.debt_ratio("a", "r"))).alias("f4")).first()
    assert 1 <= r["f1"] <= 100 and 1 <= r["f3"] <= 100 and 0.0 <= r["f4"] <= 1.0
