"""The 27-column training table, derived from the valid cases.

Labels follow the mapping: final status = mapped status, final delay = case
delay (F9), next action = rule F12, recovered amount = F11 with a fixed
in-progress share. Historical metrics are the scorecard lookups (J1-J3)
against the same cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions import rules
from arrears.operators import scorecards as sc
from arrears.session import pin as pin_table
from arrears.sources import dossiers


def with_labels(cases: DataFrame) -> DataFrame:
    delay = rules.case_delay("date_ouverture", "date_mise_a_jour")
    return (cases
            .withColumn("statut_final", F.col("statut_predit"))
            .withColumn("delai_final_jours", delay)
            .withColumn("montant_recouvre_final",
                        rules.recovered_amount("statut_final", "montant_impaye",
                                               dossiers.RECOVERED_SHARE))
            .withColumn("next_best_action",
                        rules.next_best_action("score_risque", "type_procedure",
                                               "nombre_retards", "anciennete_impaye_jours",
                                               "nombre_echeances_impayees")))


def enriched_cases(spark: SparkSession, sf_dir: str, pin: bool = True,
                   only: tuple[str, ...] = sc.ALL_CARDS) -> DataFrame:
    """Valid cases + the scorecard lookups asked for (both lawyer scores) +
    labels."""
    history = dossiers.testbed_history(spark, sf_dir)
    if pin:
        # written once: both the scorecards and the lookups read it
        history = pin_table(history, "history")
    return enriched(history, pin, only)


def enriched(history: DataFrame, pin: bool = True, only: tuple[str, ...] = sc.ALL_CARDS) -> DataFrame:
    """``enriched_cases`` of cases that are there already."""
    cards = sc.snapshot(history, pin=pin, only=only)
    return with_labels(sc.attach_scorecards(history, cards, only=only))


def training_table(spark: SparkSession, sf_dir: str, pin: bool = True) -> DataFrame:
    return _in_schema(enriched_cases(spark, sf_dir, pin))


def table_of(cases: DataFrame) -> DataFrame:
    """The training table of written cases."""
    return _in_schema(enriched(cases))


def _in_schema(e: DataFrame) -> DataFrame:
    e = e.withColumn("feature_id", rules.feature_id("dossier_id", "procedure_id",
                                                    F.lit(dossiers.TESTBED_BATCH)))
    return e.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in S.TRAINING_SCHEMA.fields])
