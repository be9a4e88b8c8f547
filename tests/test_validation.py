"""Intake contract (FIXTURES.md §1, invalid rows)."""

import json

import pytest

from arrears import schema as S
from arrears.sources.intake import parse_requests

# a sound case of our own, with fields the contract ignores
SOUND = {
    "dossier_id": "D-7", "procedure_id": "P-7", "client_segment": "Corporate", "revenu_estime": 1234.5,
    "historique_incidents": 1, "montant_impaye": 77.25, "anciennete_impaye_jours": 9,
    "nombre_echeances_impayees": 3, "date_ouverture": "2019-02-28", "date_mise_a_jour": "2019-03-02",
    "canal": "agence", "notes": ["a", {"dossier_id": 5}],
}


def variant(**changes):
    rec = dict(SOUND)
    for k, v in changes.items():
        if v is ...:
            rec.pop(k)
        else:
            rec[k] = v
    return json.dumps(rec)


CASES = [
    ("sound", variant(), True, []),
    ("vip", variant(client_segment="VIP"), False, ["client_segment"]),
    ("zero_income", variant(revenu_estime=0), False, ["revenu_estime"]),
    ("neg_incidents", variant(historique_incidents=-1), False, ["historique_incidents"]),
    ("missing_amount", variant(montant_impaye=...), False, ["montant_impaye"]),
    ("update_before", variant(date_mise_a_jour="2019-02-27"), False, ["date_mise_a_jour"]),
    ("update_equal", variant(date_mise_a_jour="2019-02-28"), True, []),
    ("two_faults", variant(client_segment="VIP", revenu_estime=-5), False,
     ["client_segment", "revenu_estime"]),
    ("bad_number", variant(montant_impaye="abc"), False, ["montant_impaye"]),
    ("bad_date", variant(date_ouverture="28/02/2019"), False, ["date_ouverture"]),
    ("number_for_text", variant(dossier_id=123), False, ["dossier_id"]),
    ("int_as_float", variant(historique_incidents=2.0), True, []),
    ("int_as_text", variant(historique_incidents="2"), True, []),
    ("half_int", variant(historique_incidents=2.5), False, ["historique_incidents"]),
    ("nan", variant(revenu_estime="NaN"), False, ["revenu_estime"]),
    ("infinite", variant(montant_impaye="Infinity"), False, ["montant_impaye"]),
    ("huge_amount", variant(montant_impaye=1e25), True, []),
    ("huge_count", variant(historique_incidents=2 * 10 ** 18), True, []),
    ("beyond_int", variant(anciennete_impaye_jours=3_000_000_000), False, ["anciennete_impaye_jours"]),
    ("beyond_long", variant(historique_incidents=10 ** 30), False, ["historique_incidents"]),
    ("explicit_null", variant(client_segment=None), False, ["client_segment"]),
    ("year_only", variant(date_ouverture="2019"), False, ["date_ouverture"]),
    ("date_time", variant(date_ouverture="2019-02-28T10:30:00"), False, ["date_ouverture"]),
    ("no_such_day", variant(date_ouverture="2019-02-30"), False, ["date_ouverture"]),
    ("bool_for_number", variant(revenu_estime=True), False, ["revenu_estime"]),
    ("array_for_text", variant(dossier_id=["x"]), False, ["dossier_id"]),
    ("malformed", "{not json", False, [""]),
    ("not_an_object", "[1, 2]", False, [""]),
    ("blank", "", False, [""]),
]


@pytest.fixture()
def parsed(spark):
    df = spark.createDataFrame([(n, v) for n, v, _, _ in CASES], "name string, value string")
    return {r["name"]: r for r in parse_requests(df).collect()}


@pytest.mark.parametrize("name,valid,fields", [(n, ok, f) for n, _, ok, f in CASES])
def test_contract(parsed, name, valid, fields):
    row = parsed[name]
    assert row["is_valid"] is valid
    assert len(row["errors"]) == len(fields)
    for msg, field in zip(row["errors"], fields, strict=True):
        assert msg.startswith(f"Erreur sur le champ '{field}' : ")


def test_messages(parsed):
    def text(name):
        return parsed[name]["errors"][0].split(" : ", 1)[1]

    assert text("vip") == f"{S.MSG_CHOICES_PREFIX} {S.MSG_SEGMENT_CHOICES}"
    assert text("zero_income") == text("neg_incidents") == text("nan") == S.MSG_POSITIVE
    assert text("missing_amount") == S.MSG_REQUIRED
    assert text("explicit_null") == f"{S.MSG_CHOICES_PREFIX} {S.MSG_NOT_STRING}"
    assert text("update_before") == S.MSG_DATE_ORDER
    assert text("malformed") == text("blank") == S.MSG_DECODE


def test_scores_of_hostile_values(spark):
    """Values that pass the contract do not overflow the risk score."""
    from arrears.functions import rules

    df = spark.createDataFrame([(2 * 10 ** 18, 1e25), (0, 1e25), (2 * 10 ** 18, 1.0), (0, 50.0), (3, 4999.0), (-5, 120_000.0)],
                               "i long, a double")
    assert [r[0] for r in df.select(rules.risk_score_serving("i", "a")).collect()] == [100, 100, 100, 1, 34, 70]


def sized(n_bytes):
    """The sound record padded with an ignored field to exactly n bytes."""
    rec = dict(SOUND, pad="")
    rec["pad"] = "x" * (n_bytes - len(json.dumps(rec).encode()))
    out = json.dumps(rec)
    assert len(out.encode()) == n_bytes
    return out


def test_record_size_guard(spark):
    huge = json.dumps({"procedure_id": "0123456789" * 200_000})
    rows = [("limit", sized(S.MAX_RECORD_BYTES)), ("over", sized(S.MAX_RECORD_BYTES + 1)), ("huge", huge)]
    got = {r["name"]: r for r in parse_requests(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert not got["limit"]["oversize"] and got["limit"]["is_valid"]
    for name in ("over", "huge"):
        assert got[name]["oversize"] and not got[name]["is_valid"]
        assert got[name]["errors"] == [S.MSG_OVERSIZE] and got[name]["dossier_id"] is None


def test_valid_plus_quarantined_is_input(spark):
    from pyspark.sql import functions as F

    from arrears.operators.validation import split_valid
    from arrears.sources import intake
    from tests.conftest import SF_SMALL

    recs = intake.request_records(spark, SF_SMALL)
    parsed = intake.parse_requests(recs)
    valid, bad = split_valid(parsed)
    n_valid, n_bad = valid.count(), bad.count()
    assert n_valid + n_bad == recs.count()
    assert n_bad > 0 and n_valid > 0
    assert bad.filter(F.size("errors") == 0).count() == 0
