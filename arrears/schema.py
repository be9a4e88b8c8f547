"""Schemas, domains and constants.

Everything in the "fixed values" blocks must stay equal to the application
this library re-implements, or results stop matching it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Domains and ids
# ---------------------------------------------------------------------------
SEGMENTS = ["Retail", "Professionnel", "Corporate"]
PROCEDURES = ["Amiable", "Judiciaire"]
STATUSES = ["Recouvré", "En cours", "Échec"]
ACTIONS = ["Relance amiable", "Mise en demeure", "Action judiciaire", "Négociation"]
NONE_ID = "NONE"
AUTO_COURT = "TRIB-AUTO"
AUTO_LAWYER = "AVO-AUTO"
AUTO_BAILIFF = "HUI-AUTO"
RECOVERED = "Recouvré"
IN_PROGRESS = "En cours"
FAILED = "Échec"
AMIABLE = "Amiable"
JUDICIAL = "Judiciaire"

# ---------------------------------------------------------------------------
# Cold-start defaults of the scorecards
# ---------------------------------------------------------------------------
DEFAULT_SUCCESS_RATE = 0.65
DEFAULT_MEAN_DELAY = 120.0
DEFAULT_COURT_DELAY = 180.0
DEFAULT_PROCEDURE_RATE = 0.75
NO_COURT_DELAY = 0.0
DEFAULT_BAILIFF_SCORE = 65.0  # round(0.65 * 100, 2), no delay term

# ---------------------------------------------------------------------------
# Intake limits and messages
# ---------------------------------------------------------------------------
MAX_RECORD_BYTES = 1048576
MSG_FIELD = "Erreur sur le champ '{field}' : {message}"
MSG_POSITIVE = "La valeur doit être strictement positive (supérieure à 0)."
MSG_CHOICES_PREFIX = "Valeur non reconnue. Les choix possibles sont :"
MSG_REQUIRED = "Field required"
MSG_SEGMENT_CHOICES = "'Retail', 'Professionnel' or 'Corporate'"
MSG_DATE_ORDER = ("Value error, date_mise_a_jour ne peut pas être antérieure "
                  "à date_ouverture.")
MSG_NOT_NUMBER = "a valid number, unable to parse string as a number"
MSG_NOT_INTEGER = "a valid integer, unable to parse string as an integer"
MSG_NOT_DATE = "a valid date in the format YYYY-MM-DD"
MSG_NOT_STRING = "a valid string"
MSG_DECODE = "JSON decode error"
MSG_NOT_OBJECT = "a valid dictionary or object to extract fields from"
MSG_OVERSIZE = ("Les données envoyées sont trop volumineuses. Pour des raisons de "
                "performance, la limite est fixée à 1 Mo.")

# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------
MODEL_PREFIXES = ["rf_procedure", "rf_classifier", "rf_regressor",
                  "rf_next_action", "kmeans_cluster"]
MODEL_STAMP_FORMAT = "%Y%m%d_%H%M%S"
RF_TREES = 50
RF_DEPTH = 5
SEED = 42
KMEANS_K = 4
TRAIN_FRACTION = 0.8

BASE_CATEGORICAL = ["client_segment"]
BASE_NUMERIC = ["revenu_estime", "score_risque", "montant_impaye",
                "historique_incidents", "anciennete_impaye_jours",
                "nombre_echeances_impayees"]
FULL_CATEGORICAL = ["client_segment", "type_procedure"]
FULL_NUMERIC = ["revenu_estime", "score_risque", "montant_impaye",
                "acteur_taux_succes", "score_avocat", "historique_incidents",
                "anciennete_impaye_jours", "nombre_echeances_impayees",
                "nombre_evenements", "nombre_retards",
                "derniere_action_age_jours", "acteur_delai_moyen",
                "tribunal_delai_moyen", "procedure_taux_succes"]

# ---------------------------------------------------------------------------
# Contracts (names, types and order are shared with clients)
# ---------------------------------------------------------------------------
# A case as it arrives: every field mandatory.
REQUEST_FIELDS = ["dossier_id", "procedure_id", "client_segment",
                  "revenu_estime", "historique_incidents", "montant_impaye",
                  "anciennete_impaye_jours", "nombre_echeances_impayees",
                  "date_ouverture", "date_mise_a_jour"]

REQUEST_SCHEMA = T.StructType([
    T.StructField("dossier_id", T.StringType()),
    T.StructField("procedure_id", T.StringType()),
    T.StructField("client_segment", T.StringType()),
    T.StructField("revenu_estime", T.DoubleType()),
    T.StructField("historique_incidents", T.LongType()),
    T.StructField("montant_impaye", T.DoubleType()),
    T.StructField("anciennete_impaye_jours", T.IntegerType()),
    T.StructField("nombre_echeances_impayees", T.LongType()),
    T.StructField("date_ouverture", T.DateType()),
    T.StructField("date_mise_a_jour", T.DateType()),
])

# Training table (27 columns, in contract order).
TRAINING_SCHEMA = T.StructType([
    T.StructField("feature_id", T.StringType()),
    T.StructField("dossier_id", T.StringType()),
    T.StructField("procedure_id", T.StringType()),
    T.StructField("client_segment", T.StringType()),
    T.StructField("historique_incidents", T.LongType()),
    T.StructField("date_ouverture", T.DateType()),
    T.StructField("revenu_estime", T.DoubleType()),
    T.StructField("montant_impaye", T.DoubleType()),
    T.StructField("anciennete_impaye_jours", T.IntegerType()),
    T.StructField("nombre_echeances_impayees", T.LongType()),
    T.StructField("score_risque", T.IntegerType()),
    T.StructField("type_procedure", T.StringType()),
    T.StructField("tribunal_id", T.StringType()),
    T.StructField("avocat_id", T.StringType()),
    T.StructField("huissier_id", T.StringType()),
    T.StructField("nombre_evenements", T.LongType()),
    T.StructField("nombre_retards", T.LongType()),
    T.StructField("derniere_action_age_jours", T.IntegerType()),
    T.StructField("acteur_taux_succes", T.DoubleType()),
    T.StructField("acteur_delai_moyen", T.DoubleType()),
    T.StructField("tribunal_delai_moyen", T.DoubleType()),
    T.StructField("procedure_taux_succes", T.DoubleType()),
    T.StructField("statut_final", T.StringType()),
    T.StructField("delai_final_jours", T.IntegerType()),
    T.StructField("date_mise_a_jour", T.DateType()),
    T.StructField("montant_recouvre_final", T.DoubleType()),
    T.StructField("next_best_action", T.StringType()),
])

# Prediction history (append-only table). Outcome columns are nullable and
# filled later; created_at is the scoring time.
HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("feature_id", T.StringType(), False),
    T.StructField("dossier_id", T.StringType(), False),
    T.StructField("procedure_id", T.StringType(), False),
    T.StructField("client_segment", T.StringType(), False),
    T.StructField("revenu_estime", T.DoubleType(), False),
    T.StructField("score_risque", T.IntegerType(), False),
    T.StructField("historique_incidents", T.LongType(), False),
    T.StructField("montant_impaye", T.DoubleType(), False),
    T.StructField("anciennete_impaye_jours", T.IntegerType(), False),
    T.StructField("nombre_echeances_impayees", T.LongType(), False),
    T.StructField("type_procedure", T.StringType(), False),
    T.StructField("tribunal_id", T.StringType(), False),
    T.StructField("avocat_id", T.StringType(), False),
    T.StructField("huissier_id", T.StringType(), False),
    T.StructField("nombre_evenements", T.LongType(), False),
    T.StructField("nombre_retards", T.LongType(), False),
    T.StructField("derniere_action_age_jours", T.IntegerType(), False),
    T.StructField("acteur_taux_succes", T.DoubleType(), False),
    T.StructField("acteur_delai_moyen", T.DoubleType(), False),
    T.StructField("tribunal_delai_moyen", T.DoubleType(), False),
    T.StructField("procedure_taux_succes", T.DoubleType(), False),
    T.StructField("cluster_segment_id", T.IntegerType(), False),
    T.StructField("statut_predit", T.StringType(), False),
    T.StructField("probabilite_recouvrement", T.DoubleType(), False),
    T.StructField("delai_estime_jours", T.DoubleType(), False),
    T.StructField("score_avocat", T.DoubleType(), False),
    T.StructField("next_best_action", T.StringType(), False),
    T.StructField("montant_recouvre_final", T.DoubleType(), True),
    T.StructField("delai_final_jours", T.IntegerType(), True),
    T.StructField("statut_final", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

HISTORY_COLUMNS = [f.name for f in HISTORY_SCHEMA.fields]

# Projection served by the "recent history" view.
HISTORY_VIEW_COLUMNS = ["id", "dossier_id", "client_segment", "montant_impaye",
                        "statut_predit", "probabilite_recouvrement",
                        "next_best_action", "cluster_segment_id",
                        "score_avocat", "created_at"]

# Response of a scored case: (output name, source column).
RESPONSE_COLUMNS = [
    ("meilleure_procedure", "type_procedure"),
    ("taux_de_succes", "probabilite_recouvrement"),
    ("statut_final_predit", "statut_predit"),
    ("delai_estime_jours", "delai_estime_jours"),
    ("prochaine_action_recommandee", "next_best_action"),
    ("cluster_segment_id", "cluster_segment_id"),
    ("score_avocat", "score_avocat"),
    ("score_huissier", "score_huissier"),
    ("acteur_taux_succes", "acteur_taux_succes"),
    ("acteur_delai_moyen", "acteur_delai_moyen"),
]
