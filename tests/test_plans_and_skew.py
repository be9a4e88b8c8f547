"""Plan shape (pruning, range scan, size-checked broadcast) and a skewed
fixture (one order holds a third of all lines) against the oracle."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from arrears.operators import asof
from arrears.operators import scorecards as sc
from arrears.plans import oracle
from arrears.sources import dossiers
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(dossiers.valid_cases(spark, SF_SMALL))
    li = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln][0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_returnflag:string," \
           "l_linestatus:string,l_shipdate" in li
    for unused in ("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                   "l_discount", "l_tax"):
        assert unused not in li


def test_asof_windows_only_over_partition_summaries(spark):
    """No window is keyed on an entity over the data: the only windows run
    over the per-partition summary rows (keyed on ``_last`` or unkeyed)."""
    hist = dossiers.testbed_history(spark, SF_SMALL)
    plan = plan_of(asof.asof_scorecards(hist))
    windows = [ln for ln in plan.splitlines() if ln.strip().startswith(("Window ", "+- Window ",
                                                                      ":- Window "))
               or " Window [" in ln]
    assert windows, plan
    for ln in windows:
        assert "entity" not in ln and "avocat_id" not in ln and "type_procedure" not in ln, ln


def test_card_joins_are_left_to_measured_sizes(spark):
    """No broadcast is forced: a lookup is broadcast if Spark measures the
    card to be small and shuffled otherwise, with equal results; the cases of
    the sentinel are then dealt out over several keys."""
    hist = dossiers.testbed_history(spark, SF_SMALL)
    cards = sc.snapshot(hist)
    cases = dossiers.valid_cases(spark, SF_SMALL)
    columns = ["id", "acteur_taux_succes", "tribunal_delai_moyen", "procedure_taux_succes", "score_huissier"]
    looked_up = sc.attach_scorecards(cases, cards).select(*columns)
    assert "BroadcastHashJoin" in plan_of(looked_up)
    want = sorted(looked_up.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = sc.attach_scorecards(cases, cards).select(*columns)
        plan = plan_of(shuffled)
        assert "BroadcastHashJoin" not in plan and ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan)
        assert sorted(shuffled.collect()) == want
        dealt = sc._join(cases, cards.lawyer, "avocat_id", True)._jdf.queryExecution().optimizedPlan().toString()
        assert "pmod(xxhash64" in dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_lineitem_exchange_and_pushed_date_rule(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(dossiers.valid_cases(spark, SF_SMALL))
        shown = dossiers.valid_cases(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # orders, lineitem, the order facts by customer, customer
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    # the date rule stands above the aggregate by order, below the customer join
    lines = shown.splitlines()
    customer = next(k for k, ln in enumerate(lines) if "Join Inner, (o_custkey" in ln)
    by_order = next(k for k, ln in enumerate(lines) if "Aggregate [o_orderkey" in ln)
    rule = [k for k, ln in enumerate(lines) if "Filter" in ln and "aggregateexpression" in ln and ">=" in ln]
    assert rule and all(customer < k < by_order for k in rule)
    assert "filter(array(" not in shown


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    """Orders/lineitem/customer where order 7 holds a third of the lines."""
    d = tmp_path_factory.mktemp("skewed")
    rng = np.random.default_rng(3)
    n_orders, n_lines = 60, 3000
    cust = pd.DataFrame({"c_custkey": np.arange(6, dtype=np.int64),
                         "c_name": [f"C{i}" for i in range(6)],
                         "c_nationkey": np.arange(6, dtype=np.int32) % 4,
                         "c_acctbal": rng.uniform(-900, 9000, 6).round(2),
                         "c_mktsegment": ["HOUSEHOLD", "MACHINERY", "AUTOMOBILE", "BUILDING",
                                          "FURNITURE", "HOUSEHOLD"]})
    start = dt.datetime(1995, 1, 1)
    orders = pd.DataFrame({
        "o_orderkey": np.arange(n_orders, dtype=np.int64),
        "o_custkey": rng.integers(0, 6, n_orders).astype(np.int64),
        "o_orderstatus": rng.choice(["F", "P", "O"], n_orders),
        "o_totalprice": rng.uniform(1000, 400000, n_orders).round(2),
        "o_orderdate": [start + dt.timedelta(days=int(x)) for x in rng.integers(0, 2000, n_orders)],
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], n_orders)})
    keys = np.where(np.arange(n_lines) < n_lines // 3, 7, rng.integers(0, n_orders, n_lines))
    li = pd.DataFrame({
        "l_orderkey": keys.astype(np.int64),
        "l_suppkey": rng.integers(0, 50, n_lines).astype(np.int64),
        "l_returnflag": rng.choice(["R", "A", "N"], n_lines),
        "l_linestatus": rng.choice(["O", "F"], n_lines),
        "l_shipdate": [start + dt.timedelta(days=int(x)) for x in rng.integers(0, 2500, n_lines)]})
    for name, pdf in (("customer", cust), ("orders", orders), ("lineitem", li)):
        pdf.to_parquet(d / f"{name}.parquet", index=False, coerce_timestamps="us")
    return str(d)


def test_skewed_cases_match_oracle(spark, skewed_dir):
    got = dossiers.cases(spark, skewed_dir).toPandas().sort_values("id").reset_index(drop=True)
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    want = con.sql("WITH " + ",".join([oracle.FACTS, oracle.RAW_CASES, oracle.CASES_SCORED])
                   + " SELECT * FROM cases ORDER BY id").df()
    assert len(got) == len(want)
    hot = got[got["id"] == 7].iloc[0]
    assert hot["nombre_evenements"] == (want[want["id"] == 7].iloc[0]["nombre_evenements"])
    assert hot["nombre_evenements"] >= 1000
    for c in ("historique_incidents", "nombre_echeances_impayees", "nombre_evenements",
              "nombre_retards", "score_risque", "avocat_id", "tribunal_id", "huissier_id",
              "statut_predit", "delai_estime_jours", "revenu_estime", "montant_impaye",
              "client_segment", "anciennete_impaye_jours", "derniere_action_age_jours"):
        assert list(got[c]) == list(want[c]), c
