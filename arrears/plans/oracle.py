"""DuckDB SQL for every checkable query (the correctness oracle).

Each string runs on the driver's pre-registered views. ``CASES`` is the
case mapping of ``arrears.sources.dossiers`` written as SQL; queries that
need it start with ``WITH`` + ``CASES_CTE``. Notes on parity:

* rounding is ``round_even`` (ties to even, like the Spark helper);
* decimal literals are written ``::DOUBLE`` because DuckDB types ``0.05``
  as DECIMAL;
* ``CAST(double AS INTEGER)`` rounds in DuckDB, so truncation is ``trunc``.
"""

from __future__ import annotations

FACTS = """
facts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice,
         o.o_orderdate, o.o_orderpriority,
         count(*) AS n_lines,
         count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_returned,
         count(*) FILTER (WHERE l.l_linestatus = 'O') AS n_open,
         count(*) FILTER (WHERE date_diff('day', CAST(o.o_orderdate AS DATE),
                                         CAST(l.l_shipdate AS DATE)) > 365) AS n_late,
         max(CAST(l.l_shipdate AS DATE)) AS last_ship,
         min(l.l_suppkey) AS min_supp
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice,
           o.o_orderdate, o.o_orderpriority
)"""

RAW_CASES = """
raw_cases AS (
  SELECT f.o_orderkey AS id,
         printf('DOS-%06d', f.o_orderkey) AS dossier_id,
         'PROC-' || CAST(f.o_orderkey AS VARCHAR) AS procedure_id,
         CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail'
                             WHEN 'FURNITURE' THEN 'Retail'
                             WHEN 'BUILDING' THEN 'Retail'
                             WHEN 'AUTOMOBILE' THEN 'Professionnel'
                             WHEN 'MACHINERY' THEN 'Corporate' END AS client_segment,
         greatest(500.0::DOUBLE, c.c_acctbal * 12) AS revenu_estime,
         greatest(50.0::DOUBLE, f.o_totalprice / 10) AS montant_impaye,
         f.n_returned AS historique_incidents,
         f.n_open AS nombre_echeances_impayees,
         f.n_lines AS nombre_evenements,
         f.n_late AS nombre_retards,
         CAST(f.o_orderdate AS DATE) AS date_ouverture,
         f.last_ship AS date_mise_a_jour,
         CAST(date_diff('day', CAST(f.o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER)
           AS anciennete_impaye_jours,
         CAST(date_diff('day', f.last_ship, DATE '2001-12-31') AS INTEGER)
           AS derniere_action_age_jours,
         CASE WHEN substr(f.o_orderpriority, 1, 1) IN ('1', '2')
              THEN 'Judiciaire' ELSE 'Amiable' END AS type_procedure,
         CASE WHEN substr(f.o_orderpriority, 1, 1) IN ('1', '2')
              THEN printf('AVO-%03d', f.min_supp) ELSE 'NONE' END AS avocat_id,
         CASE WHEN substr(f.o_orderpriority, 1, 1) IN ('1', '2')
              THEN printf('TRIB-%02d', c.c_nationkey) ELSE 'NONE' END AS tribunal_id,
         printf('HUI-%03d', f.o_custkey % 30) AS huissier_id,
         CASE f.o_orderstatus WHEN 'F' THEN 'Recouvré' WHEN 'P' THEN 'En cours'
                              WHEN 'O' THEN 'Échec' END AS statut_predit,
         CAST(date_diff('day', CAST(f.o_orderdate AS DATE), f.last_ship) AS DOUBLE)
           AS delai_estime_jours,
         f.o_orderdate AS created_at
  FROM facts f JOIN customer c ON c.c_custkey = f.o_custkey
)"""

CASES_SCORED = """
cases AS (
  SELECT *,
         CAST(least(greatest(historique_incidents * 10
                             + CAST(trunc(montant_impaye / 1000) AS BIGINT), 1), 100)
              AS INTEGER) AS score_risque
  FROM raw_cases
)"""

_FIELD = "Erreur sur le champ ''{}'' : "
_REQUIRED = "Field required"
_POSITIVE = "La valeur doit être strictement positive (supérieure à 0)."
_CHOICES = "Valeur non reconnue. Les choix possibles sont : "
_NUMBER = _CHOICES + "a valid number, unable to parse string as a number"
_INTEGER = _CHOICES + "a valid integer, unable to parse string as an integer"
_DATE = _CHOICES + "a valid date in the format YYYY-MM-DD"
_STRING = _CHOICES + "a valid string"
_RULES = [
    ("dossier_id", None, None), ("procedure_id", None, None),
    ("client_segment", "{} NOT IN ('Retail', 'Professionnel', 'Corporate')",
     _CHOICES + "''Retail'', ''Professionnel'' or ''Corporate''"),
    ("revenu_estime", "NOT ({0} > 0 AND {0} < 'inf'::DOUBLE)", _POSITIVE),
    ("historique_incidents", "{} < 0", _POSITIVE),
    ("montant_impaye", "NOT ({0} > 0 AND {0} < 'inf'::DOUBLE)", _POSITIVE),
    ("anciennete_impaye_jours", "{} < 0", _POSITIVE),
    ("nombre_echeances_impayees", "{} < 0", _POSITIVE),
    ("date_ouverture", None, None),
    ("date_mise_a_jour", "date_ouverture IS NOT NULL AND {} < date_ouverture",
     "Value error, date_mise_a_jour ne peut pas être antérieure à date_ouverture."),
]


def checks(type_errors: dict[str, tuple[str, str]] | None = None) -> str:
    """The contract as one SQL text of messages; ``type_errors`` gives, for a
    field, when it has a wrong type and the message."""
    out = []
    for field, broken, message in _RULES:
        head = _FIELD.format(field)
        whens = []
        if field in (type_errors or {}):
            when, text = type_errors[field]
            whens.append(f"WHEN {when} THEN '{head}{text}'")
        whens.append(f"WHEN {field} IS NULL THEN '{head}{_REQUIRED}'")
        if broken:
            whens.append(f"WHEN {broken.format(field)} THEN '{head}{message}'")
        out.append(f"CASE {' '.join(whens)} END")
    return "concat_ws(' | ',\n      " + ",\n      ".join(out) + ")"


VALIDATION = f"""
validated AS (
  SELECT *, {checks()} AS error_text
  FROM cases
),
valid AS (
  SELECT * EXCLUDE (error_text) FROM validated WHERE error_text = ''
)"""

CASES_CTE = ",".join([FACTS, RAW_CASES, CASES_SCORED, VALIDATION])

LAWYER_CARD = """
lawyer_card AS (
  SELECT avocat_id, count(*) AS n_dossiers,
         count(*) FILTER (WHERE statut_predit = 'Recouvré') AS n_recouvre,
         round_even(count(*) FILTER (WHERE statut_predit = 'Recouvré') / count(*), 3)
           AS acteur_taux_succes,
         round_even(sum(delai_estime_jours) / count(*), 1) AS acteur_delai_moyen
  FROM valid WHERE avocat_id <> 'NONE' GROUP BY avocat_id
)"""

COURT_CARD = """
court_card AS (
  SELECT tribunal_id, count(*) AS n_dossiers,
         round_even(sum(delai_estime_jours) / count(*), 1) AS tribunal_delai_moyen
  FROM valid WHERE tribunal_id <> 'NONE' GROUP BY tribunal_id
)"""

PROCEDURE_CARD = """
procedure_card AS (
  SELECT type_procedure, count(*) AS n_dossiers,
         count(*) FILTER (WHERE statut_predit = 'Recouvré') AS n_recouvre,
         round_even(count(*) FILTER (WHERE statut_predit = 'Recouvré') / count(*), 3)
           AS procedure_taux_succes
  FROM valid GROUP BY type_procedure
)"""

BAILIFF_CARD = """
bailiff_card AS (
  SELECT huissier_id, count(*) AS n_dossiers,
         count(*) FILTER (WHERE statut_predit = 'Recouvré') AS n_recouvre,
         round_even((count(*) FILTER (WHERE statut_predit = 'Recouvré') / count(*)) * 100
                    - (sum(delai_estime_jours) / count(*)) * 0.05::DOUBLE, 2) AS score_huissier
  FROM valid GROUP BY huissier_id
)"""


def with_cases(*ctes: str) -> str:
    return "WITH " + ",".join([CASES_CTE, *ctes]) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["lawyer_scorecard"] = with_cases(LAWYER_CARD) + """
SELECT avocat_id, n_dossiers, n_recouvre, acteur_taux_succes, acteur_delai_moyen,
       round_even(acteur_taux_succes * 100 - acteur_delai_moyen * 0.05::DOUBLE, 2) AS score_avocat
FROM lawyer_card
"""

ORACLE["court_scorecard"] = with_cases(COURT_CARD) + """
SELECT tribunal_id, n_dossiers, tribunal_delai_moyen FROM court_card
"""

ORACLE["procedure_scorecard"] = with_cases(PROCEDURE_CARD) + """
SELECT type_procedure, n_dossiers, n_recouvre, procedure_taux_succes FROM procedure_card
"""

ORACLE["bailiff_score"] = with_cases(BAILIFF_CARD) + """
SELECT huissier_id, n_dossiers, n_recouvre, score_huissier FROM bailiff_card
"""

ENRICHED = """
looked_up AS (
  SELECT v.*,
    CASE WHEN v.avocat_id = 'NONE' THEN 0.65::DOUBLE
         ELSE coalesce(l.acteur_taux_succes, 0.65::DOUBLE) END AS acteur_taux_succes,
    CASE WHEN v.avocat_id = 'NONE' THEN 120.0::DOUBLE
         ELSE coalesce(l.acteur_delai_moyen, 120.0::DOUBLE) END AS acteur_delai_moyen,
    CASE WHEN v.tribunal_id = 'NONE' THEN 0.0::DOUBLE
         ELSE coalesce(c.tribunal_delai_moyen, 180.0::DOUBLE) END AS tribunal_delai_moyen,
    coalesce(p.procedure_taux_succes, 0.75::DOUBLE) AS procedure_taux_succes,
    coalesce(b.score_huissier, 65.0::DOUBLE) AS score_huissier
  FROM valid v
  LEFT JOIN lawyer_card l ON l.avocat_id = v.avocat_id
  LEFT JOIN court_card c ON c.tribunal_id = v.tribunal_id
  LEFT JOIN procedure_card p ON p.type_procedure = v.type_procedure
  LEFT JOIN bailiff_card b ON b.huissier_id = v.huissier_id
),
enriched AS (
  SELECT *,
    round_even(acteur_taux_succes * 100 - acteur_delai_moyen * 0.05::DOUBLE, 2) AS score_avocat,
    acteur_taux_succes * 100
      - CAST(date_diff('day', date_ouverture, date_mise_a_jour) AS INTEGER) * 0.05::DOUBLE
      AS score_avocat_feature,
    statut_predit AS statut_final,
    CAST(date_diff('day', date_ouverture, date_mise_a_jour) AS INTEGER) AS delai_final_jours,
    round_even(CASE WHEN statut_predit = 'Recouvré' THEN montant_impaye
                    WHEN statut_predit = 'En cours' THEN montant_impaye * 0.25::DOUBLE
                    ELSE 0.0::DOUBLE END, 2) AS montant_recouvre_final,
    CASE WHEN score_risque < 40 AND type_procedure = 'Amiable' THEN 'Relance amiable'
         WHEN score_risque BETWEEN 40 AND 70 AND nombre_retards >= 1 THEN 'Mise en demeure'
         WHEN score_risque > 70 AND type_procedure = 'Judiciaire' THEN 'Action judiciaire'
         WHEN anciennete_impaye_jours > 300 OR nombre_echeances_impayees > 10 THEN 'Négociation'
         ELSE 'Relance amiable' END AS next_best_action
  FROM looked_up
)"""

CARDS = [LAWYER_CARD, COURT_CARD, PROCEDURE_CARD, BAILIFF_CARD]


def with_enriched(*ctes: str) -> str:
    return with_cases(*CARDS, ENRICHED, *ctes)


ORACLE["status_distribution"] = with_enriched() + """
SELECT statut_final, count(*) AS n FROM enriched GROUP BY statut_final
"""

ORACLE["action_distribution"] = with_enriched() + """
SELECT next_best_action, count(*) AS n FROM enriched GROUP BY next_best_action
"""

ORACLE["risk_score_serving"] = with_cases() + """
SELECT id, historique_incidents, montant_impaye, score_risque FROM valid
"""

ORACLE["risk_score_base"] = with_cases() + """
, base AS (
  SELECT id, montant_impaye / revenu_estime AS ratio_endettement,
         CAST(least(greatest(round_even(30.0::DOUBLE + 100 * (1.0::DOUBLE
              - exp(-(montant_impaye / revenu_estime) * 2)), 0), 1), 100) AS INTEGER) AS score_base
  FROM valid
)
SELECT id, ratio_endettement, score_base,
       round_even(1.0::DOUBLE / (1.0::DOUBLE + exp(-(score_base - 75) / 10.0::DOUBLE)), 6)
         AS prob_judiciaire
FROM base
"""

ORACLE["recovery_probability"] = with_enriched() + """
, lg AS (
  SELECT id, 1.0::DOUBLE - score_risque * 0.03::DOUBLE + acteur_taux_succes * 2.5::DOUBLE
             - historique_incidents * 0.1::DOUBLE - anciennete_impaye_jours * 0.001::DOUBLE
             + CASE WHEN type_procedure = 'Amiable' THEN 0.8::DOUBLE ELSE -0.5::DOUBLE END AS logit
  FROM enriched
)
SELECT id, round_even(logit, 6) AS logit_recouvrement,
       round_even(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) AS prob_recouvrement
FROM lg
"""

ORACLE["next_best_action"] = with_enriched() + """
SELECT id, score_risque, type_procedure, nombre_retards, anciennete_impaye_jours,
       nombre_echeances_impayees, next_best_action FROM enriched
"""

ORACLE["recovered_amount"] = with_enriched() + """
SELECT id, statut_predit, montant_impaye, montant_recouvre_final FROM enriched
"""

ORACLE["case_timeline"] = with_cases() + """
SELECT id, dossier_id, procedure_id, avocat_id, tribunal_id, huissier_id,
       strftime(date_ouverture, '%Y-%m-%d') AS date_ouverture,
       strftime(date_mise_a_jour, '%Y-%m-%d') AS date_mise_a_jour,
       CAST(date_diff('day', date_ouverture, date_mise_a_jour) AS INTEGER) AS delai_jours,
       strftime(CAST(date_ouverture + CAST(date_diff('day', date_ouverture, date_mise_a_jour)
                                           AS INTEGER) AS DATE), '%Y-%m-%d') AS date_recalculee
FROM cases
"""

ORACLE["floors_and_ratio"] = with_cases() + """
, fl AS (
  SELECT id, round_even(greatest(revenu_estime, 500.0::DOUBLE), 2) AS revenu_estime,
         round_even(greatest(montant_impaye, 50.0::DOUBLE), 2) AS montant_impaye
  FROM cases
)
SELECT id, revenu_estime, montant_impaye, montant_impaye / revenu_estime AS ratio_endettement
FROM fl
"""

ORACLE["procedure_priors"] = with_enriched() + """
SELECT id, type_procedure,
       CASE WHEN type_procedure = 'Judiciaire' THEN 0.65::DOUBLE ELSE 0.85::DOUBLE END
         AS procedure_taux_prior,
       CASE WHEN type_procedure = 'Judiciaire'
            THEN round_even(greatest(delai_estime_jours, 30.0::DOUBLE), 1)
            ELSE 0.0::DOUBLE END AS tribunal_delai_prior,
       round_even(greatest(delai_estime_jours, 10.0::DOUBLE), 1) AS acteur_delai_prior,
       round_even(least(greatest(procedure_taux_succes, 0.0::DOUBLE), 1.0::DOUBLE), 3)
         AS procedure_taux_borne,
       least(greatest(score_risque, 1), 100) AS score_borne
FROM enriched
"""

ORACLE["scored_lookup"] = with_enriched() + """
SELECT id, avocat_id, tribunal_id, type_procedure, huissier_id, acteur_taux_succes,
       acteur_delai_moyen, tribunal_delai_moyen, procedure_taux_succes, score_huissier,
       score_avocat, score_avocat_feature
FROM enriched
"""

ORACLE["dossier_validation"] = with_cases() + """
SELECT id, dossier_id, error_text = '' AS is_valid,
       CAST(CASE WHEN error_text = '' THEN 0
                 ELSE len(string_split(error_text, ' | ')) END AS INTEGER) AS n_errors,
       error_text
FROM validated
"""

ORACLE["validation_summary"] = with_cases() + """
SELECT error, count(*) AS n
FROM (SELECT unnest(CASE WHEN error_text = '' THEN ['OK']
                         ELSE string_split(error_text, ' | ') END) AS error
      FROM validated)
GROUP BY error
"""

# Intake: the same records, validated relationally (a JSON round trip is the
# identity on sound values). Orders without lines lack their line facts; what
# is made faulty by the remainder of the key is faulty here by the same rule.
_FAULT = "id % 211 = {}"
INTAKE = f"""
WITH facts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate,
         CASE WHEN count(l.l_orderkey) > 0
              THEN count(*) FILTER (WHERE l.l_returnflag = 'R') END AS n_returned,
         CASE WHEN count(l.l_orderkey) > 0
              THEN count(*) FILTER (WHERE l.l_linestatus = 'O') END AS n_open,
         max(CAST(l.l_shipdate AS DATE)) AS last_ship
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate
),
sent AS (
  SELECT f.o_orderkey AS id, printf('DOS-%06d', f.o_orderkey) AS dossier_id,
         'PROC-' || CAST(f.o_orderkey AS VARCHAR) AS procedure_id,
         CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail' WHEN 'FURNITURE' THEN 'Retail'
                             WHEN 'BUILDING' THEN 'Retail' WHEN 'AUTOMOBILE' THEN 'Professionnel'
                             WHEN 'MACHINERY' THEN 'Corporate' END AS client_segment,
         c.c_acctbal * 12 AS revenu_estime,
         f.n_returned AS historique_incidents,
         f.o_totalprice / 10 AS montant_impaye,
         date_diff('day', CAST(f.o_orderdate AS DATE), DATE '2001-12-31') AS anciennete_impaye_jours,
         f.n_open AS nombre_echeances_impayees,
         CAST(f.o_orderdate AS DATE) AS date_ouverture,
         f.last_ship AS date_mise_a_jour,
         CASE WHEN f.o_orderkey % 4001 = 8 THEN repeat('x', 1048576) ELSE '' END AS pad
  FROM facts f JOIN customer c ON c.c_custkey = f.o_custkey
),
sized AS (
  -- what else a record holds is far less than the limit
  SELECT * EXCLUDE (pad), strlen(pad) + strlen(dossier_id) > 1048576 AS oversize FROM sent
),
req AS (
  SELECT id, oversize,
         NOT oversize AND id % 211 = 7 AS malformed, NOT oversize AND id % 211 = 12 AS no_object,
         CASE WHEN id % 211 <> 11 THEN dossier_id END AS dossier_id, procedure_id,
         CASE WHEN id % 211 = 1 THEN 'VIP' ELSE client_segment END AS client_segment,
         CASE WHEN id % 211 = 3 THEN NULL WHEN id % 211 = 5 THEN 'nan'::DOUBLE ELSE revenu_estime END AS revenu_estime,
         CASE WHEN id % 211 = 2 AND historique_incidents IS NOT NULL THEN -1 ELSE historique_incidents END
           AS historique_incidents,
         CASE WHEN id % 211 = 4 THEN NULL WHEN id % 211 = 13 THEN 1e25::DOUBLE ELSE montant_impaye END AS montant_impaye,
         CASE WHEN id % 211 = 6 THEN NULL ELSE anciennete_impaye_jours END AS anciennete_impaye_jours,
         nombre_echeances_impayees,
         CASE WHEN id % 211 = 9 THEN NULL ELSE date_ouverture END AS date_ouverture, date_mise_a_jour
  FROM sized
),
checked AS (
  SELECT id, oversize, CASE WHEN NOT (oversize OR malformed OR no_object) THEN dossier_id END AS dossier_id,
    CASE WHEN oversize THEN 'Les données envoyées sont trop volumineuses. Pour des raisons de performance, la limite est fixée à 1 Mo.'
         WHEN malformed THEN 'Erreur sur le champ '''' : JSON decode error'
         WHEN no_object THEN 'Erreur sur le champ '''' : {_CHOICES}a valid dictionary or object to extract fields from'
         ELSE {checks({
             "dossier_id": (_FAULT.format(11), _STRING), "revenu_estime": (_FAULT.format(3), _NUMBER),
             "montant_impaye": (_FAULT.format(4), _NUMBER), "anciennete_impaye_jours": (_FAULT.format(6), _INTEGER),
             "date_ouverture": (_FAULT.format(9), _DATE)})}
    END AS error_text
  FROM req
)
"""

ORACLE["json_intake"] = INTAKE + """
SELECT id, dossier_id, oversize, error_text = '' AS is_valid,
       CAST(CASE WHEN error_text = '' THEN 0
                 ELSE len(string_split(error_text, ' | ')) END AS INTEGER) AS n_errors,
       error_text
FROM checked
"""

ORACLE["intake_error_summary"] = INTAKE + """
SELECT error, count(*) AS n
FROM (SELECT unnest(CASE WHEN error_text = '' THEN ['OK'] ELSE string_split(error_text, ' | ') END) AS error
      FROM checked)
GROUP BY error
"""

ORACLE["asof_scorecard"] = with_cases() + """
, w AS (
  SELECT id, avocat_id, tribunal_id, type_procedure, huissier_id,
    CASE WHEN statut_predit = 'Recouvré' THEN 1 ELSE 0 END AS ok, delai_estime_jours AS d,
    created_at FROM valid
),
prior AS (
  SELECT id, avocat_id, tribunal_id, type_procedure, huissier_id,
    count(*) OVER (PARTITION BY avocat_id ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_n,
    sum(ok) OVER (PARTITION BY avocat_id ORDER BY created_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_ok,
    sum(d) OVER (PARTITION BY avocat_id ORDER BY created_at, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_d,
    count(*) OVER (PARTITION BY tribunal_id ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_n,
    sum(d) OVER (PARTITION BY tribunal_id ORDER BY created_at, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_d,
    count(*) OVER (PARTITION BY type_procedure ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_n,
    sum(ok) OVER (PARTITION BY type_procedure ORDER BY created_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_ok,
    count(*) OVER (PARTITION BY huissier_id ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_n,
    sum(ok) OVER (PARTITION BY huissier_id ORDER BY created_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_ok,
    sum(d) OVER (PARTITION BY huissier_id ORDER BY created_at, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_d
  FROM w
),
m AS (
  SELECT id, avocat_id, tribunal_id, type_procedure, huissier_id,
    CASE WHEN avocat_id = 'NONE' THEN 0::BIGINT ELSE l_n END AS lawyer_n_prior,
    CASE WHEN avocat_id = 'NONE' OR l_n = 0 THEN 0.65::DOUBLE
         ELSE round_even(l_ok / l_n, 3) END AS acteur_taux_succes,
    CASE WHEN avocat_id = 'NONE' OR l_n = 0 THEN 120.0::DOUBLE
         ELSE round_even(l_d / l_n, 1) END AS acteur_delai_moyen,
    CASE WHEN tribunal_id = 'NONE' THEN 0.0::DOUBLE WHEN c_n = 0 THEN 180.0::DOUBLE
         ELSE round_even(c_d / c_n, 1) END AS tribunal_delai_moyen,
    CASE WHEN p_n = 0 THEN 0.75::DOUBLE ELSE round_even(p_ok / p_n, 3) END
      AS procedure_taux_succes,
    CASE WHEN b_n = 0 THEN 65.0::DOUBLE
         ELSE round_even((b_ok / b_n) * 100 - (b_d / b_n) * 0.05::DOUBLE, 2) END
      AS score_huissier
  FROM prior
)
SELECT *, round_even(acteur_taux_succes * 100 - acteur_delai_moyen * 0.05::DOUBLE, 2)
            AS score_avocat
FROM m
"""

ORACLE["recent_history"] = with_enriched() + """
SELECT id, dossier_id, client_segment, montant_impaye, statut_predit,
       round_even(1.0::DOUBLE / (1.0::DOUBLE + exp(-(
         1.0::DOUBLE - score_risque * 0.03::DOUBLE + acteur_taux_succes * 2.5::DOUBLE
         - historique_incidents * 0.1::DOUBLE - anciennete_impaye_jours * 0.001::DOUBLE
         + CASE WHEN type_procedure = 'Amiable' THEN 0.8::DOUBLE ELSE -0.5::DOUBLE END))), 6)
         AS probabilite_recouvrement,
       next_best_action, -1 AS cluster_segment_id, score_avocat, created_at
FROM enriched
ORDER BY created_at DESC, id DESC
LIMIT 50
"""

ORACLE["compacted_history"] = ORACLE["recent_history"]

ORACLE["table_profile"] = with_enriched() + """
SELECT 'dossiers' AS table_name, count(*) AS n_rows, 27 AS n_columns FROM enriched
UNION ALL SELECT 'orders', count(*), 6 FROM orders
UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem
UNION ALL SELECT 'customer', count(*), 5 FROM customer
"""

ORACLE["csv_round_trip"] = with_enriched() + """
SELECT sha256(dossier_id || '|' || procedure_id || '|' || 'testbed') AS feature_id,
       dossier_id, procedure_id, client_segment, historique_incidents,
       strftime(date_ouverture, '%Y-%m-%d') AS date_ouverture,
       revenu_estime, montant_impaye, anciennete_impaye_jours, nombre_echeances_impayees,
       score_risque, type_procedure, tribunal_id, avocat_id, huissier_id, nombre_evenements,
       nombre_retards, derniere_action_age_jours, acteur_taux_succes, acteur_delai_moyen,
       tribunal_delai_moyen, procedure_taux_succes, statut_final, delai_final_jours,
       strftime(date_mise_a_jour, '%Y-%m-%d') AS date_mise_a_jour,
       montant_recouvre_final, next_best_action
FROM enriched
"""

ORACLE["csv_bad_lines"] = with_enriched() + """
, lines AS (
  SELECT *, id % 97 = 0 OR id % 79 = 3 OR id % 89 = 1 OR id % 83 = 2 AS quarantined FROM enriched)
SELECT dossier_id, quarantined, CASE WHEN NOT quarantined THEN montant_impaye END AS montant_impaye,
       CASE WHEN NOT quarantined THEN next_best_action END AS next_best_action
FROM lines
"""

ORACLE["newest_models"] = with_cases() + """
, names AS (
  SELECT lower(client_segment) || CASE WHEN id % 7 = 0 THEN '_bis' ELSE '' END || '_'
         || strftime(CAST(created_at AS TIMESTAMP) + to_seconds(id % 86400), '%Y%m%d_%H%M%S') AS name FROM valid)
SELECT p.prefix, max(n.name) AS newest
FROM (VALUES ('retail'), ('retail_bis'), ('professionnel'), ('corporate'), ('corp'), ('retail_b')) p(prefix)
LEFT JOIN names n ON starts_with(n.name, p.prefix || '_') GROUP BY p.prefix
"""

ORACLE["asof_incremental"] = ORACLE["asof_stream"] = ORACLE["asof_scorecard"]

# ---------------------------------------------------------------------------
# Figures of given predictions and segments
# ---------------------------------------------------------------------------
ANSWERS = """
, answers AS (
  SELECT 'procedure' AS model, type_procedure AS label,
         CASE WHEN score_risque >= 40 THEN 'Judiciaire' ELSE 'Amiable' END AS prediction, NULL::DOUBLE AS error FROM enriched
  UNION ALL
  SELECT 'status', statut_final, CASE WHEN nombre_retards > 0 THEN 'Échec' WHEN historique_incidents > 1 THEN 'En cours'
                                      WHEN id % 50 <> 0 THEN 'Recouvré' END, NULL FROM enriched
  UNION ALL
  SELECT 'action', next_best_action,
         CASE WHEN score_risque + 10 < 40 AND type_procedure = 'Amiable' THEN 'Relance amiable'
              WHEN score_risque + 10 BETWEEN 40 AND 70 AND nombre_retards >= 1 THEN 'Mise en demeure'
              WHEN score_risque + 10 > 70 AND type_procedure = 'Judiciaire' THEN 'Action judiciaire'
              WHEN anciennete_impaye_jours > 300 OR nombre_echeances_impayees > 10 THEN 'Négociation'
              ELSE 'Relance amiable' END, NULL FROM enriched
  UNION ALL
  SELECT 'delay', NULL, NULL, (delai_final_jours - round_even(delai_final_jours / 30, 0) * 30) ** 2 FROM enriched)
"""

ORACLE["evaluation_confusion"] = with_enriched() + ANSWERS + """
SELECT model, label, prediction, count(*) AS n, sum(error) AS squared_error FROM answers GROUP BY model, label, prediction
"""

ORACLE["evaluation_figures"] = with_enriched() + ANSWERS + """
SELECT model, CASE WHEN model = 'delay' THEN 'rmse' ELSE 'accuracy' END AS metric,
       round(CASE WHEN model = 'delay' THEN sqrt(sum(error) / count(*))
                  ELSE count(*) FILTER (WHERE label = prediction) / count(*) END, 9) AS value, count(*) AS n
FROM answers GROUP BY model
"""

POINTS = """
, points AS (
  SELECT *, score_risque / 100 AS a, anciennete_impaye_jours / 1000 AS b, nombre_evenements / 7 AS c,
         CASE WHEN score_risque < 40 THEN 0 WHEN score_risque <= 70 THEN 1 ELSE 2 END AS segment
  FROM {})
"""

ORACLE["segment_silhouette"] = with_cases() + POINTS.format("valid") + """
, moments AS (
  SELECT segment, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(a * a + b * b + c * c) AS q FROM points GROUP BY segment),
away AS (
  SELECT p.id, p.segment, m.segment AS other, m.n,
         (a * a + b * b + c * c) + q / m.n - 2 * (a * sa / m.n + b * sb / m.n + c * sc / m.n) AS d
  FROM points p, moments m),
near AS (
  SELECT id, segment, max(CASE WHEN segment = other AND n > 1 THEN d * (n / (n - 1)) END) AS own,
         min(CASE WHEN segment <> other THEN d END) AS nearest
  FROM away GROUP BY id, segment)
SELECT segment, count(*) AS n,
       round(avg(CASE WHEN own IS NULL OR own = nearest THEN 0 WHEN own < nearest THEN 1 - own / nearest ELSE nearest / own - 1 END), 8)
         AS silhouette
FROM near GROUP BY segment
"""

ORACLE["segment_profile"] = with_enriched() + POINTS.format("enriched") + """
, quantiles AS (
  SELECT quantile_cont(a, [0.125, 0.375, 0.625, 0.875]) AS qa, quantile_cont(b, [0.125, 0.375, 0.625, 0.875]) AS qb,
         quantile_cont(c, [0.125, 0.375, 0.625, 0.875]) AS qc FROM points),
centres AS (
  SELECT k - 1 AS k, round(qa[k], 6) AS ca, round(qb[k], 6) AS cb, round(qc[k], 6) AS cc
  FROM quantiles, (SELECT unnest(range(1, 5)) AS k)),
away AS (
  SELECT p.id, k, (a - ca) * (a - ca) + (b - cb) * (b - cb) + (c - cc) * (c - cc) AS d FROM points p, centres),
own AS (
  SELECT id, k FROM away QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)
SELECT CAST(o.k AS INTEGER) AS segment, count(*) AS n, round(avg(a), 8) AS mean_score, round(avg(b), 8) AS mean_age,
       round(avg(c), 8) AS mean_events, round(avg(CASE WHEN statut_final = 'Recouvré' THEN 1.0::DOUBLE ELSE 0 END), 8) AS recovered_share,
       round(avg(montant_impaye), 4) AS mean_amount
FROM points p JOIN own o ON p.id = o.id GROUP BY o.k
"""

# ---------------------------------------------------------------------------
# Models: what surrounds the fits
# ---------------------------------------------------------------------------
_NUMBERS = {
    "base": ["revenu_estime", "score_risque", "montant_impaye", "historique_incidents",
             "anciennete_impaye_jours", "nombre_echeances_impayees"],
    "case": ["acteur_taux_succes", "score_avocat_feature", "nombre_evenements", "nombre_retards",
             "derniere_action_age_jours", "acteur_delai_moyen", "tribunal_delai_moyen", "procedure_taux_succes"],
}
_SHOWN = {"score_avocat_feature": "score_avocat"}


def _category_slots(column: str, first: str) -> str:
    return f"""
  SELECT {first} + CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS INTEGER) AS slot,
         '{column}_' || {column} AS feature, count(*) / any_value(n) AS mean,
         sqrt(count(*) * (1 - count(*) / any_value(n)) / (any_value(n) - 1)) AS std
  FROM enriched, (SELECT count(*)::DOUBLE AS n FROM enriched) GROUP BY {column}"""


def _number_slots(columns: list[str], first: str) -> str:
    return "".join(f"""
  UNION ALL SELECT {first} + {k}, '{_SHOWN.get(c, c)}', avg({c})::DOUBLE, stddev_samp({c})::DOUBLE FROM enriched"""
                   for k, c in enumerate(columns))


ORACLE["feature_matrix_stats"] = with_enriched() + f"""
, kinds AS (SELECT CAST(count(DISTINCT client_segment) AS INTEGER) AS segments,
                   CAST(count(DISTINCT type_procedure) AS INTEGER) AS procedures FROM enriched),
slots AS (
  {_category_slots("client_segment", "0")}
  {_number_slots(_NUMBERS["base"], "(SELECT segments FROM kinds)")}
  UNION ALL ({_category_slots("type_procedure", "(SELECT segments + 6 FROM kinds)")})
  {_number_slots(_NUMBERS["case"], "(SELECT segments + 6 + procedures FROM kinds)")}
)
SELECT slot, feature, round(mean, 6) AS mean, round(std, 6) AS std, 0.0::DOUBLE AS mean_after,
       CASE WHEN std = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS std_after
FROM slots
"""

ORACLE["label_order"] = with_enriched() + "".join(
    f"""{" UNION ALL " if k else ""}
SELECT '{label}' AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, {label}) - 1 AS INTEGER) AS label_index,
       {label} AS name FROM enriched GROUP BY {label}"""
    for k, label in enumerate(["type_procedure", "statut_final", "next_best_action"]))

ORACLE["train_split"] = with_cases() + """
SELECT id, CAST('0x' || substr(md5(sha256(dossier_id || '|' || procedure_id || '|testbed')), 1, 8) AS BIGINT) % 100 < 80
       AS in_training
FROM valid
"""

ORACLE["actor_assignment"] = with_cases() + """
SELECT id, score_risque, 0::BIGINT AS nombre_evenements, 0::BIGINT AS nombre_retards, 0 AS derniere_action_age_jours,
       CASE WHEN type_procedure = 'Judiciaire' THEN 'TRIB-AUTO' ELSE 'NONE' END AS tribunal_id,
       CASE WHEN type_procedure = 'Judiciaire' THEN 'AVO-AUTO' ELSE 'NONE' END AS avocat_id,
       'HUI-AUTO' AS huissier_id, tribunal_id AS tribunal_id_connu, avocat_id AS avocat_id_connu,
       huissier_id AS huissier_id_connu
FROM valid
"""

ORACLE["decoded_predictions"] = with_cases() + """
SELECT dossier_id, type_procedure AS meilleure_procedure,
       round_even((1 - (id % 1000) / 1000.0::DOUBLE) / 2, 4) AS taux_de_succes,
       CASE id % 4 WHEN 0 THEN 'Recouvré' WHEN 1 THEN 'En cours' WHEN 2 THEN 'Échec' ELSE 'Inconnu' END AS statut_final_predit,
       round_even(delai_estime_jours / 7, 2) AS delai_estime_jours,
       CASE id % 4 WHEN 0 THEN 'Relance amiable' WHEN 1 THEN 'Mise en demeure' WHEN 2 THEN 'Action judiciaire'
                   ELSE 'Négociation' END AS prochaine_action_recommandee,
       1 AS cluster_segment_id, 59.0::DOUBLE AS score_avocat, 65.0::DOUBLE AS score_huissier,
       0.65::DOUBLE AS acteur_taux_succes, 120.0::DOUBLE AS acteur_delai_moyen
FROM valid
"""

ORACLE["cascade_lookups"] = with_enriched() + """
SELECT id, avocat_id, tribunal_id, huissier_id, acteur_taux_succes, acteur_delai_moyen,
       tribunal_delai_moyen, procedure_taux_succes, score_huissier, score_avocat
FROM enriched
"""

ORACLE["stream_history"] = INTAKE + """
SELECT c.dossier_id, r.procedure_id, r.client_segment, r.montant_impaye,
       CAST(least(greatest(r.historique_incidents * 10
                           + CAST(trunc(least(r.montant_impaye / 1000, 1000000)) AS BIGINT), 1), 100) AS INTEGER) AS score_risque,
       0::BIGINT AS nombre_evenements, 0::BIGINT AS nombre_retards, 0 AS derniere_action_age_jours, 'HUI-AUTO' AS huissier_id
FROM checked c JOIN req r USING (id)
WHERE c.error_text = ''
"""
