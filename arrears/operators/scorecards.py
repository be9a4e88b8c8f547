"""Scorecards over the prediction history (A1-A7) and case lookups.

A scorecard is one ``groupBy`` per entity: count, successes and the delay sum
are algebraic, so Spark runs them as partial (map-side) plus final
aggregates and a hot entity never lands whole in one task. Rates and means
are formed from the totals afterwards and rounded half-even.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions import rules
from arrears.functions.rounding import round_half_even
from arrears.session import pin as pin_table

STATUS = "statut_predit"
DELAY = "delai_estime_jours"

def _totals(status: str, delay: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_dossiers"),
            F.count_if(F.col(status) == S.RECOVERED).alias("n_recouvre"),
            F.sum(delay).alias("delay_sum")]


def _rate(n_ok: str = "n_recouvre", n: str = "n_dossiers") -> Column:
    return F.col(n_ok) / F.col(n)


def _mean_delay(total: str = "delay_sum", n: str = "n_dossiers") -> Column:
    return F.col(total) / F.col(n)


def lawyer_scorecard(history: DataFrame, status: str = STATUS,
                     delay: str = DELAY) -> DataFrame:
    """A1 + F8: success rate (3 dp), mean delay (1 dp), score from the
    rounded parts. The sentinel ``NONE`` is not a lawyer: it has no row."""
    agg = (history.filter(F.col("avocat_id") != S.NONE_ID)
                  .groupBy("avocat_id").agg(*_totals(status, delay)))
    rate = round_half_even(_rate(), 3)
    mean = round_half_even(_mean_delay(), 1)
    return (agg.select("avocat_id", "n_dossiers", "n_recouvre",
                       rate.alias("acteur_taux_succes"),
                       mean.alias("acteur_delai_moyen"))
               .withColumn("score_avocat",
                           rules.lawyer_score("acteur_taux_succes", "acteur_delai_moyen")))


def court_scorecard(history: DataFrame, delay: str = DELAY) -> DataFrame:
    """A2: mean delay per court (1 dp); ``NONE`` has no row."""
    agg = (history.filter(F.col("tribunal_id") != S.NONE_ID)
                  .groupBy("tribunal_id")
                  .agg(F.count(F.lit(1)).alias("n_dossiers"),
                       F.sum(delay).alias("delay_sum")))
    return agg.select("tribunal_id", "n_dossiers",
                      round_half_even(_mean_delay(), 1).alias("tribunal_delai_moyen"))


def procedure_scorecard(history: DataFrame, status: str = STATUS) -> DataFrame:
    """A3: success rate per procedure type (3 dp)."""
    agg = (history.groupBy("type_procedure")
                  .agg(F.count(F.lit(1)).alias("n_dossiers"),
                       F.count_if(F.col(status) == S.RECOVERED).alias("n_recouvre")))
    return agg.select("type_procedure", "n_dossiers", "n_recouvre",
                      round_half_even(_rate(), 3).alias("procedure_taux_succes"))


def bailiff_scorecard(history: DataFrame, status: str = STATUS,
                      delay: str = DELAY) -> DataFrame:
    """A4: round(100*rate - 0.05*mean delay, 2) from the unrounded parts."""
    agg = history.groupBy("huissier_id").agg(*_totals(status, delay))
    score = rules.lawyer_score(_rate(), _mean_delay())
    return agg.select("huissier_id", "n_dossiers", "n_recouvre",
                      score.alias("score_huissier"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(column)))


# ---------------------------------------------------------------------------
# Lookups
# ---------------------------------------------------------------------------
@dataclass
class Scorecards:
    lawyer: DataFrame
    court: DataFrame
    procedure: DataFrame
    bailiff: DataFrame


ALL_CARDS = ("lawyer", "court", "procedure", "bailiff")
CARD_KEYS = [("lawyer", "avocat_id", True), ("court", "tribunal_id", True),
             ("procedure", "type_procedure", False), ("bailiff", "huissier_id", False)]


def _card_totals(history: DataFrame, status: str, delay: str, only: tuple[str, ...]) -> DataFrame:
    """The four cards' raw totals in one long table (card, key, n, ok, sum).

    Each history row is stacked into its four (card, key) entries and one
    ``groupBy(card, key)`` aggregates them: a single read of the history
    and a single, map-side-combined shuffle for all four cards.
    """
    entries = F.array(*[F.struct(F.lit(card).alias("card"), F.col(key).alias("key"))
                        for card, key, _ in CARD_KEYS if card in only])
    sentinel_cards = [card for card, _, skip in CARD_KEYS if skip]
    long = (history.select(F.inline(entries),
                           (F.col(status) == S.RECOVERED).alias("_ok"),
                           F.col(delay).alias("_delay"))
                   .filter(~(F.col("card").isin(*sentinel_cards)
                             & (F.col("key") == S.NONE_ID))))
    return long.groupBy("card", "key").agg(
        F.count(F.lit(1)).alias("n_dossiers"),
        F.count_if(F.col("_ok")).alias("n_recouvre"),
        F.sum("_delay").alias("delay_sum"))


def card_totals(history: DataFrame, status: str = STATUS, delay: str = DELAY,
                only: tuple[str, ...] = ALL_CARDS) -> DataFrame:
    """Raw totals of the four cards (card, key, n_dossiers, n_recouvre,
    delay_sum): algebraic, so totals of two histories merge by summing."""
    return _card_totals(history, status, delay, only)


def merge_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals of the union of two histories (small: one row per entity)."""
    return (old.unionByName(new).groupBy("card", "key")
               .agg(F.sum("n_dossiers").alias("n_dossiers"),
                    F.sum("n_recouvre").alias("n_recouvre"),
                    F.sum("delay_sum").alias("delay_sum")))


def cards_from_totals(totals: DataFrame, pin: bool = True) -> Scorecards:
    """Scorecards from raw totals. With ``pin`` the totals are written once,
    so every lookup of a batch sees the same snapshot and Spark knows their
    real size when it chooses a join."""
    if pin:
        totals = pin_table(totals, "cards")

    def card(name: str, key: str) -> DataFrame:
        return (totals.filter(F.col("card") == name).drop("card")
                      .withColumnRenamed("key", key))

    lawyer = card("lawyer", "avocat_id").select(
        "avocat_id", round_half_even(_rate(), 3).alias("acteur_taux_succes"),
        round_half_even(_mean_delay(), 1).alias("acteur_delai_moyen"))
    court = card("court", "tribunal_id").select(
        "tribunal_id", round_half_even(_mean_delay(), 1).alias("tribunal_delai_moyen"))
    procedure = card("procedure", "type_procedure").select(
        "type_procedure", round_half_even(_rate(), 3).alias("procedure_taux_succes"))
    bailiff = card("bailiff", "huissier_id").select(
        "huissier_id", rules.lawyer_score(_rate(), _mean_delay()).alias("score_huissier"))
    return Scorecards(lawyer, court, procedure, bailiff)


def snapshot(history: DataFrame, status: str = STATUS, delay: str = DELAY,
             pin: bool = True, only: tuple[str, ...] = ALL_CARDS) -> Scorecards:
    """Scorecards of a history as of now (one read, one shuffle). Cards not
    asked for are empty."""
    return cards_from_totals(card_totals(history, status, delay, only), pin)


#: parts that the cases of the sentinel actor are dealt to in a shuffle join
SALTS = 64


def _join(cases: DataFrame, card: DataFrame, key: str, sentinel: bool) -> DataFrame:
    """Left lookup. The sentinel id, which most cases carry, has no card row:
    its cases join on ids of their own making, dealt out by a hash of the
    case, so that they do not meet in one partition of a shuffle join."""
    if not sentinel:
        return cases.join(card, key, "left")
    part = F.pmod(F.xxhash64("dossier_id" if "dossier_id" in cases.columns else key), F.lit(SALTS))
    dealt = F.when(F.col(key) == S.NONE_ID, F.concat(F.lit(f"{S.NONE_ID}\0"), part.cast("string"))).otherwise(F.col(key))
    return cases.withColumn("_key", dealt).join(card.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def attach_scorecards(cases: DataFrame, cards: Scorecards,
                      case_delay: Column | None = None, only: tuple[str, ...] = ALL_CARDS) -> DataFrame:
    """J1-J4 with the cold-start rules (P9, P10) and both lawyer scores.

    * lawyer ``NONE`` (which has no row) or unknown -> 0.65 / 120.0
    * court ``NONE`` -> 0.0; unknown court -> 180.0
    * unknown procedure -> 0.75; unknown bailiff -> 65.0
    * ``score_avocat`` is F8 (rounded parts); ``score_avocat_feature`` is F7
      with the case's own delay, the value the models were trained on.
    """
    out = cases
    for name, key, sentinel in CARD_KEYS:
        if name in only:
            out = _join(out, getattr(cards, name), key, sentinel)
    known = {"procedure_taux_succes": S.DEFAULT_PROCEDURE_RATE, "score_huissier": S.DEFAULT_BAILIFF_SCORE,
             "acteur_taux_succes": S.DEFAULT_SUCCESS_RATE, "acteur_delai_moyen": S.DEFAULT_MEAN_DELAY,
             "tribunal_delai_moyen": S.DEFAULT_COURT_DELAY}
    out = out.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in known.items() if c in out.columns})
    if "court" in only:
        out = out.withColumn("tribunal_delai_moyen", F.when(F.col("tribunal_id") == S.NONE_ID, F.lit(S.NO_COURT_DELAY))
                             .otherwise(F.col("tribunal_delai_moyen")))
    if "lawyer" in only:
        delay = case_delay if case_delay is not None else rules.case_delay("date_ouverture", "date_mise_a_jour")
        out = (out.withColumn("score_avocat", rules.lawyer_score("acteur_taux_succes", "acteur_delai_moyen"))
                  .withColumn("score_avocat_feature", rules.lawyer_score_feature("acteur_taux_succes", delay)))
    return out
