"""Debt cases ("dossiers") derived from the driver's TPC-H-like tables.

Mapping (our design): one order is one case. Line items give the event
counts and the last activity date, the customer gives segment and income.

Plan shape, and why:

1. The narrow ``lineitem`` columns meet ``orders`` on the order key, the one
   shuffle of ``lineitem``. A pre-aggregate before it would save nothing: few
   lines of an order share a ship day. The aggregate by order that follows
   reuses the join's partitioning and adds no exchange.
2. An order with very many lines is a skewed join partition.
   ``spark.sql.adaptive.forceOptimizeSkewedJoin`` (set by ``build_session``)
   lets Spark split it and pay for a second shuffle, of partial aggregates,
   only then.
3. The customer join is a plain equi-join: Spark broadcasts ``customer``
   only when its measured size is under the broadcast threshold and uses a
   sort-merge join (with AQE skew splitting for a hot customer) otherwise.
4. Validity is a conjunction of comparisons, so what depends on the order
   alone (the date rule) is filtered before the customer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions import rules
from arrears.operators import validation
from arrears.sources import tables

# ---------------------------------------------------------------------------
# Fixed values of the mapping (our design, mirrored in the oracle SQL)
# ---------------------------------------------------------------------------
REFERENCE_DAY = "2001-12-31"
SEGMENT_OF_MARKET = {
    "HOUSEHOLD": "Retail",
    "FURNITURE": "Retail",
    "BUILDING": "Retail",
    "AUTOMOBILE": "Professionnel",
    "MACHINERY": "Corporate",
}
STATUS_OF_ORDER = {"F": "Recouvré", "P": "En cours", "O": "Échec"}
JUDICIAL_PRIORITIES = ["1", "2"]
INCOME_MONTHS = 12
AMOUNT_DIVISOR = 10
LATE_DAYS = 365
BAILIFF_POOL = 30
RECOVERED_SHARE = 0.25
TESTBED_BATCH = "testbed"


def map_values(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None
               else out.when(col == k, F.lit(v)))
    return out


def order_facts(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """One row per order with its line-item facts.

    ``how="left"`` keeps orders without lines (their facts are null), which
    is what the JSON intake uses to produce incomplete records.
    """
    li = tables.lineitem(spark, sf_dir).withColumn("ship_day", F.to_date("l_shipdate"))
    o = tables.orders(spark, sf_dir)
    joined = o.join(li, o["o_orderkey"] == li["l_orderkey"], how)
    late = F.datediff(F.col("ship_day"), F.to_date("o_orderdate")) > LATE_DAYS
    # The order columns are constant per order key. The two strings ride
    # along as extra grouping keys and the fixed-width ones through ``max``
    # (deterministic, unlike ``any_value``), so the buffers stay fixed-width
    # and Spark picks a hash aggregate (measured ~20% faster than carrying
    # the strings through ``max``, which forces a sort aggregate).
    carried = [F.max(c).alias(c) for c in ("o_custkey", "o_totalprice", "o_orderdate")]
    facts = (joined.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority")
                   .agg(*carried,
                        F.count("l_orderkey").alias("n_lines"),
                        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
                        F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
                        F.count_if(late).alias("n_late"),
                        F.max("ship_day").alias("last_ship"),
                        F.min("l_suppkey").alias("min_supp")))
    if how == "inner":
        return facts
    counts = ("n_lines", "n_returned", "n_open", "n_late")
    return facts.withColumns({c: F.when(F.col("n_lines") > 0, F.col(c)) for c in counts})


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mapped case, before validation (§7.2 of the survey)."""
    facts = order_facts(spark, sf_dir)
    cust = tables.customer(spark, sf_dir)
    j = facts.join(cust, facts["o_custkey"] == cust["c_custkey"], "inner")
    judicial = F.substring("o_orderpriority", 1, 1).isin(*JUDICIAL_PRIORITIES)
    ref = F.lit(REFERENCE_DAY).cast("date")
    opened = F.to_date("o_orderdate")
    out = j.select(
        F.col("o_orderkey").alias("id"),
        rules.format_id("DOS", 6, "o_orderkey").alias("dossier_id"),
        F.concat(F.lit("PROC-"), F.col("o_orderkey").cast("string")).alias("procedure_id"),
        map_values(F.col("c_mktsegment"), SEGMENT_OF_MARKET).alias("client_segment"),
        (F.col("c_acctbal") * INCOME_MONTHS).alias("revenu_brut"),
        (F.col("o_totalprice") / AMOUNT_DIVISOR).alias("montant_brut"),
        F.greatest(F.lit(rules.INCOME_FLOOR), F.col("c_acctbal") * INCOME_MONTHS).alias("revenu_estime"),
        F.greatest(F.lit(rules.AMOUNT_FLOOR), F.col("o_totalprice") / AMOUNT_DIVISOR).alias("montant_impaye"),
        F.col("n_returned").alias("historique_incidents"),
        F.col("n_open").alias("nombre_echeances_impayees"),
        F.col("n_lines").alias("nombre_evenements"),
        F.col("n_late").alias("nombre_retards"),
        opened.alias("date_ouverture"),
        F.col("last_ship").alias("date_mise_a_jour"),
        F.datediff(ref, opened).alias("anciennete_impaye_jours"),
        F.datediff(ref, F.col("last_ship")).alias("derniere_action_age_jours"),
        F.when(judicial, F.lit(S.JUDICIAL)).otherwise(F.lit(S.AMIABLE)).alias("type_procedure"),
        F.when(judicial, rules.format_id("AVO", 3, "min_supp"))
         .otherwise(F.lit(S.NONE_ID)).alias("avocat_id"),
        F.when(judicial, rules.format_id("TRIB", 2, "c_nationkey"))
         .otherwise(F.lit(S.NONE_ID)).alias("tribunal_id"),
        rules.format_id("HUI", 3, F.col("o_custkey") % BAILIFF_POOL).alias("huissier_id"),
        map_values(F.col("o_orderstatus"), STATUS_OF_ORDER).alias("statut_predit"),
        rules.case_delay(opened, F.col("last_ship")).cast("double").alias("delai_estime_jours"),
        F.col("o_orderdate").alias("created_at"),
    )
    return out.withColumn(
        "score_risque",
        rules.risk_score_serving("historique_incidents", "montant_impaye"))


def valid_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases passing the request contract."""
    return cases(spark, sf_dir).filter(validation.valid())


def testbed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cases seen as past predictions: the input of the scorecards."""
    return valid_cases(spark, sf_dir)
