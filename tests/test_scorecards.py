"""Scorecards, lookups, as-of replay and the recent view on the FIXTURES.md
§2 history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.operators import asof
from arrears.operators import scorecards as sc
from arrears.sources import history

ROWS = [
    (1, "AVO-001", "TRIB-01", "HUI-001", "Judiciaire", "Recouvré", 100.0),
    (2, "AVO-001", "TRIB-01", "HUI-001", "Judiciaire", "Échec", 200.0),
    (3, "AVO-001", "TRIB-02", "HUI-002", "Judiciaire", "Recouvré", 150.0),
    (4, "NONE", "NONE", "HUI-001", "Amiable", "En cours", 60.0),
]


@pytest.fixture()
def hist(spark):
    rows = [(i, a, t, h, p, s, d, dt.datetime(2024, 1, i)) for i, a, t, h, p, s, d in ROWS]
    return spark.createDataFrame(
        rows, "id long, avocat_id string, tribunal_id string, huissier_id string, "
              "type_procedure string, statut_predit string, delai_estime_jours double, "
              "created_at timestamp_ntz")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_lawyer(hist):
    got = by(sc.lawyer_scorecard(hist), "avocat_id")
    assert set(got) == {"AVO-001"}  # the sentinel is not a lawyer
    r = got["AVO-001"]
    assert (r["acteur_taux_succes"], r["acteur_delai_moyen"], r["score_avocat"]) == (0.667, 150.0, 59.2)


def test_court_procedure_bailiff(hist):
    courts = by(sc.court_scorecard(hist), "tribunal_id")
    assert {k: v["tribunal_delai_moyen"] for k, v in courts.items()} == {"TRIB-01": 150.0,
                                                                          "TRIB-02": 150.0}
    procs = by(sc.procedure_scorecard(hist), "type_procedure")
    assert {k: v["procedure_taux_succes"] for k, v in procs.items()} == {"Judiciaire": 0.667,
                                                                          "Amiable": 0.0}
    bail = by(sc.bailiff_scorecard(hist), "huissier_id")
    assert {k: v["score_huissier"] for k, v in bail.items()} == {"HUI-001": 27.33,
                                                                  "HUI-002": 92.5}


def test_lookups_and_cold_start(spark, hist):
    cards = sc.snapshot(hist)
    cases = spark.createDataFrame(
        [("c1", "AVO-001", "TRIB-01", "Judiciaire", "HUI-002", dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
         ("c2", "NONE", "NONE", "Amiable", "HUI-001", dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
         ("c3", "AVO-999", "TRIB-99", "Autre", "HUI-999", dt.date(2024, 1, 1), dt.date(2024, 1, 31))],
        "case string, avocat_id string, tribunal_id string, type_procedure string, "
        "huissier_id string, date_ouverture date, date_mise_a_jour date")
    got = by(sc.attach_scorecards(cases, cards), "case")
    assert (got["c1"]["acteur_taux_succes"], got["c1"]["acteur_delai_moyen"]) == (0.667, 150.0)
    assert got["c1"]["score_avocat"] == 59.2 and got["c1"]["score_huissier"] == 92.5
    assert got["c1"]["score_avocat_feature"] == pytest.approx(66.7 - 0.05 * 30)
    # sentinel lawyer -> defaults even though history has NONE rows; NONE court -> 0.0
    assert (got["c2"]["acteur_taux_succes"], got["c2"]["acteur_delai_moyen"]) == (0.65, 120.0)
    assert got["c2"]["tribunal_delai_moyen"] == 0.0 and got["c2"]["score_avocat"] == 59.0
    # unknown everything -> cold start
    assert got["c3"]["tribunal_delai_moyen"] == 180.0
    assert got["c3"]["procedure_taux_succes"] == 0.75
    assert got["c3"]["score_huissier"] == 65.0


def test_asof_replay(hist):
    got = by(asof.asof_scorecards(hist, num_partitions=3), "id")
    assert (got[3]["acteur_taux_succes"], got[3]["acteur_delai_moyen"]) == (0.5, 150.0)
    assert (got[1]["acteur_taux_succes"], got[1]["acteur_delai_moyen"]) == (0.65, 120.0)
    assert got[1]["tribunal_delai_moyen"] == 180.0 and got[2]["tribunal_delai_moyen"] == 100.0
    assert got[4]["tribunal_delai_moyen"] == 0.0
    # bailiff HUI-001 at id 4 sees ids 1, 2: rate 0.5, delay 150
    assert got[4]["score_huissier"] == 42.5


def test_asof_equals_scorecard_on_each_prefix(spark, hist):
    """W1 at row n equals A1 over the rows before n."""
    got = by(asof.asof_scorecards(hist, num_partitions=2), "id")
    for n in range(2, 5):
        prefix = hist.filter(F.col("id") < n)
        card = by(sc.lawyer_scorecard(prefix), "avocat_id")
        if got[n]["avocat_id"] in card:
            assert got[n]["acteur_taux_succes"] == card[got[n]["avocat_id"]]["acteur_taux_succes"]


def test_recent_history_and_idempotent_append(spark, hist, tmp_dir):
    rows = (hist.withColumn("dossier_id", F.format_string("DOS-%06d", "id"))
                .withColumn("procedure_id", F.concat(F.lit("PROC-"), F.col("id").cast("string"))))
    for c, v in [("client_segment", "Retail"), ("revenu_estime", 1000.0), ("score_risque", 10),
                 ("historique_incidents", 0), ("montant_impaye", 100.0),
                 ("anciennete_impaye_jours", 5), ("nombre_echeances_impayees", 1),
                 ("nombre_evenements", 0), ("nombre_retards", 0),
                 ("derniere_action_age_jours", 0), ("acteur_taux_succes", 0.65),
                 ("acteur_delai_moyen", 120.0), ("tribunal_delai_moyen", 0.0),
                 ("procedure_taux_succes", 0.75), ("cluster_segment_id", 1),
                 ("probabilite_recouvrement", 0.5), ("score_avocat", 59.0),
                 ("next_best_action", "Relance amiable")]:
        rows = rows.withColumn(c, F.lit(v))
    stored = history.to_history_rows(rows, "b1", created_at=F.col("created_at"))
    path = f"{tmp_dir}/history"
    assert history.append_history(spark, stored, path, "b1") == 4
    assert history.append_history(spark, stored, path, "b1") == 0  # retry adds nothing
    view = history.recent_history(history.read_history(spark, path), 2).collect()
    assert [r["id"] for r in view] == [4, 3]
    assert list(view[0].asDict()) == S.HISTORY_VIEW_COLUMNS


def test_history_as_sql_table(spark, tmp_dir):
    path = f"{tmp_dir}/sqlhist"
    t = history.register_history(spark, "arrears_history_test", path)
    assert t.count() == 0
    assert set(S.HISTORY_COLUMNS) <= set(t.columns)
    spark.sql("DROP TABLE IF EXISTS arrears_history_test")
