"""Named queries: (spark, sf_dir) -> DataFrame, one per covered operator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions import rules
from arrears.functions.rounding import round_half_even
from arrears.operators import asof, evaluation, features, models, scoring
from arrears.operators import scorecards as sc
from arrears.operators import validation
from arrears.session import pin, scratch_path, stable_path
from arrears.sources import compaction, dossiers, history, intake, model_store, tables, training
from arrears.streaming import asof_stream, scoring_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


@query("lawyer_scorecard")
def lawyer_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lawyer on valid judicial cases."""
    return sc.lawyer_scorecard(dossiers.testbed_history(spark, sf_dir))


@query("court_scorecard")
def court_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return sc.court_scorecard(dossiers.testbed_history(spark, sf_dir))


@query("procedure_scorecard")
def procedure_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A5."""
    return sc.procedure_scorecard(dossiers.testbed_history(spark, sf_dir))


@query("bailiff_score")
def bailiff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    return sc.bailiff_scorecard(dossiers.testbed_history(spark, sf_dir))


# ---------------------------------------------------------------------------
# Distributions (A6, A7) over the training table
# ---------------------------------------------------------------------------
def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the labels do not depend on the scorecard lookups: no snapshot needed
    return training.with_labels(dossiers.valid_cases(spark, sf_dir))


@query("status_distribution")
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.distribution(_labelled(spark, sf_dir), "statut_final")


@query("action_distribution")
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.distribution(_labelled(spark, sf_dir), "next_best_action")


# ---------------------------------------------------------------------------
# Column rules (F1-F22), each over every valid case
# ---------------------------------------------------------------------------
@query("risk_score_serving")
def risk_score_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    v = dossiers.valid_cases(spark, sf_dir)
    return v.select("id", "historique_incidents", "montant_impaye",
                    rules.risk_score_serving("historique_incidents", "montant_impaye")
                    .alias("score_risque"))


@query("risk_score_base")
def risk_score_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, F4 (noise-free)."""
    v = dossiers.valid_cases(spark, sf_dir)
    ratio = rules.debt_ratio("montant_impaye", "revenu_estime")
    base = rules.base_risk_score(ratio)
    return v.select("id", ratio.alias("ratio_endettement"),
                    base.alias("score_base"),
                    round_half_even(rules.judicial_probability(base), 6).alias("prob_judiciaire"))


@query("recovery_probability")
def recovery_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6 with the looked-up lawyer rate; 6 dp."""
    e = training.enriched_cases(spark, sf_dir, only=("lawyer",))
    logit = rules.recovery_logit("score_risque", "acteur_taux_succes", "historique_incidents",
                                 "anciennete_impaye_jours", "type_procedure")
    return e.select("id", round_half_even(logit, 6).alias("logit_recouvrement"),
                    round_half_even(rules.sigmoid(logit), 6).alias("prob_recouvrement"))


@query("next_best_action")
def next_best_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    v = dossiers.valid_cases(spark, sf_dir)
    return v.select("id", "score_risque", "type_procedure", "nombre_retards",
                    "anciennete_impaye_jours", "nombre_echeances_impayees",
                    rules.next_best_action("score_risque", "type_procedure", "nombre_retards",
                                           "anciennete_impaye_jours",
                                           "nombre_echeances_impayees")
                    .alias("next_best_action"))


@query("recovered_amount")
def recovered_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 (in-progress share fixed at 0.25)."""
    v = dossiers.valid_cases(spark, sf_dir)
    return v.select("id", "statut_predit", "montant_impaye",
                    rules.recovered_amount("statut_predit", "montant_impaye",
                                           dossiers.RECOVERED_SHARE)
                    .alias("montant_recouvre_final"))


@query("case_timeline")
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, F14 over every mapped case (valid or not)."""
    c = dossiers.cases(spark, sf_dir)
    delay = rules.case_delay("date_ouverture", "date_mise_a_jour")
    iso = "yyyy-MM-dd"
    return c.select("id", "dossier_id", "procedure_id", "avocat_id", "tribunal_id",
                    "huissier_id",
                    F.date_format("date_ouverture", iso).alias("date_ouverture"),
                    F.date_format("date_mise_a_jour", iso).alias("date_mise_a_jour"),
                    delay.alias("delai_jours"),
                    F.date_format(rules.update_date("date_ouverture", delay), iso)
                    .alias("date_recalculee"))


@query("floors_and_ratio")
def floors_and_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 + F2 on the customer's and order's own amounts, not yet floored."""
    c = dossiers.cases(spark, sf_dir)
    income = rules.income_floor("revenu_brut")
    amount = rules.amount_floor("montant_brut")
    return c.select("id", income.alias("revenu_estime"), amount.alias("montant_impaye"),
                    rules.debt_ratio(amount, income).alias("ratio_endettement"))


@query("procedure_priors")
def procedure_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """priors and bounds applied to each case's own delay/rates."""
    e = training.enriched_cases(spark, sf_dir, only=("procedure",))
    return e.select("id", "type_procedure",
                    rules.procedure_prior_rate("type_procedure").alias("procedure_taux_prior"),
                    rules.court_delay_prior("type_procedure", "delai_estime_jours")
                    .alias("tribunal_delai_prior"),
                    rules.actor_delay_prior("delai_estime_jours").alias("acteur_delai_prior"),
                    rules.rate_bounds("procedure_taux_succes").alias("procedure_taux_borne"),
                    rules.clip("score_risque", rules.RISK_MIN, rules.RISK_MAX)
                    .alias("score_borne"))


# ---------------------------------------------------------------------------
# Lookups (J1-J4, P8-P10, P15/F7, F8)
# ---------------------------------------------------------------------------
@query("scored_lookup")
def scored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = training.enriched_cases(spark, sf_dir)
    return e.select("id", "avocat_id", "tribunal_id", "type_procedure", "huissier_id",
                    "acteur_taux_succes", "acteur_delai_moyen", "tribunal_delai_moyen",
                    "procedure_taux_succes", "score_huissier", "score_avocat",
                    "score_avocat_feature")


# ---------------------------------------------------------------------------
# Validation (P1-P7) and JSON intake
# ---------------------------------------------------------------------------
@query("dossier_validation")
def dossier_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validation.validate(dossiers.cases(spark, sf_dir))
    return v.select("id", "dossier_id", "is_valid",
                    F.size("errors").alias("n_errors"),
                    F.array_join("errors", " | ").alias("error_text"))


@query("validation_summary")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validation.validate(dossiers.cases(spark, sf_dir))
    reasons = v.select(F.explode_outer("errors").alias("error"))
    return (reasons.groupBy(F.coalesce("error", F.lit("OK")).alias("error"))
                   .agg(F.count(F.lit(1)).alias("n")))


@query("json_intake")
def json_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = intake.parse_requests(intake.request_records(spark, sf_dir))
    return parsed.select("id", "dossier_id", "oversize", "is_valid",
                         F.size("errors").alias("n_errors"),
                         F.array_join("errors", " | ").alias("error_text"))


@query("intake_error_summary")
def intake_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason keeps a record out."""
    parsed = intake.parse_requests(intake.request_records(spark, sf_dir))
    reasons = parsed.select(F.explode_outer("errors").alias("error"))
    return (reasons.groupBy(F.coalesce("error", F.lit("OK")).alias("error"))
                   .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# As-of replay
# ---------------------------------------------------------------------------
@query("asof_scorecard")
def asof_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each valid case scored against the history strictly before it
    (ordered by created_at, then id)."""
    return asof.asof_scorecards(dossiers.testbed_history(spark, sf_dir))


# ---------------------------------------------------------------------------
# History (S6-S8, T1, P14), profile (S2), CSV
# ---------------------------------------------------------------------------
def testbed_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cases as history rows: rule-scored probability and action,
    scorecard lookups, no cluster (-1), created at the order date."""
    e = training.enriched_cases(spark, sf_dir)
    e = (e.withColumn("probabilite_recouvrement", history.recovery_probability())
          .withColumn("cluster_segment_id", F.lit(-1))
          .drop("statut_final", "delai_final_jours", "montant_recouvre_final"))
    return history.to_history_rows(e, dossiers.TESTBED_BATCH, created_at=F.col("created_at"))


@query("recent_history")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 create, S7 append (run twice: the retry adds nothing), S6 read,
    T1 top 50 newest with id tie-break, P14 projection."""
    path = scratch_path(spark, "history")
    rows = testbed_history_rows(spark, sf_dir)
    history.append_history(spark, rows, path, dossiers.TESTBED_BATCH)
    history.append_history(spark, rows, path, dossiers.TESTBED_BATCH)
    return history.recent_history(history.read_history(spark, path), 50)


@query("compacted_history")
def compacted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7, T1 on a history of several batches: compacted after the second,
    again after the last, vacuumed; then a batch that is retried adds nothing,
    and the 50 newest are read from the files that may hold them."""
    path = scratch_path(spark, "history")
    rows = pin(testbed_history_rows(spark, sf_dir).drop(history.BATCH, "feature_id"), "rows")
    batches = [rows.where(F.pmod("id", F.lit(4)) == k).withColumn(history.BATCH, F.lit(f"b{k}")) for k in range(4)]
    batches = [b.withColumn("feature_id", rules.feature_id("dossier_id", "procedure_id", history.BATCH)) for b in batches]
    for k, batch in enumerate(batches):
        history.append_history(spark, batch, path, f"b{k}")
        if k in (1, 3):
            history.compact_history(spark, path)
    compaction.vacuum(spark, path)
    again = history.append_history(spark, batches[1], path, "b1")
    if again:
        raise AssertionError(f"a retried batch added {again} rows")
    return history.recent_of(spark, path, 50)


@query("table_profile")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 for the training table and the driver tables it reads. The training
    table has a row for each valid case; its lookups need not run."""
    rows = dossiers.valid_cases(spark, sf_dir)
    parts = [history.profile("dossiers", rows).withColumn("n_columns", F.lit(len(S.TRAINING_SCHEMA.fields)))]
    for name, read in (("orders", tables.ORDERS_COLS), ("lineitem", None), ("customer", tables.CUSTOMER_COLS)):
        stored = history.profile_file(spark, name, f"{sf_dir.rstrip('/')}/{name}.parquet")
        parts.append(stored)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("csv_round_trip")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 write (header, UTF-8) then S1 read with the declared schema."""
    path = scratch_path(spark, "csv")
    history.write_csv(training.training_table(spark, sf_dir), path)
    back = history.read_csv(spark, path, S.TRAINING_SCHEMA)
    iso = "yyyy-MM-dd"
    return (back.withColumn("date_ouverture", F.date_format("date_ouverture", iso))
                .withColumn("date_mise_a_jour", F.date_format("date_mise_a_jour", iso)))


#: fixed rules by which lines are spoilt: (divisor, remainder) of the case number
BAD_AMOUNT, BAD_DATE, LONG_LINE, SHORT_LINE = (97, 0), (79, 3), (89, 1), (83, 2)


@query("csv_bad_lines")
def csv_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over lines of which some are spoilt by key: an amount that is no
    number, a date that is none, a value too many, values missing. Every line
    comes back, as a row or in quarantine."""
    path = scratch_path(spark, "csv")
    case = F.substring("dossier_id", 5, 20).cast("long")

    def spoilt(rule: tuple[int, int]):
        return case % rule[0] == rule[1]

    text = training.training_table(spark, sf_dir).select(*[F.col(f.name).cast("string").alias(f.name) for f in S.TRAINING_SCHEMA.fields])
    text = (text.withColumn("montant_impaye", F.when(spoilt(BAD_AMOUNT), F.lit("abc")).otherwise(F.col("montant_impaye")))
                .withColumn("date_ouverture", F.when(spoilt(BAD_DATE), F.lit("2001-13-45")).otherwise(F.col("date_ouverture"))))
    line = F.to_csv(F.struct(*S.TRAINING_SCHEMA.names))
    line = (F.when(spoilt(LONG_LINE), F.concat(line, F.lit(",one more")))
             .when(spoilt(SHORT_LINE), F.substring_index(line, ",", 5)).otherwise(line))
    text.select(line.alias("value")).write.text(path)
    rows, bad = history.read_csv_lines(spark, path, S.TRAINING_SCHEMA, header=False)
    return rows.select("dossier_id", F.lit(False).alias("quarantined"), "montant_impaye", "next_best_action").unionByName(
        bad.select(F.split("line", ",")[1].alias("dossier_id"), F.lit(True).alias("quarantined"),
                   F.lit(None).cast("double").alias("montant_impaye"), F.lit(None).cast("string").alias("next_best_action")))


@query("newest_models")
def newest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of model names made from the cases (their segment, for
    some a longer prefix, and the stamp of their opening) the newest of every
    prefix; one prefix has none."""
    c = dossiers.valid_cases(spark, sf_dir)
    at = F.col("created_at").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 86400).cast("decimal(18,6)"))
    prefix = F.concat(F.lower("client_segment"), F.when(F.col("id") % 7 == 0, F.lit("_bis")).otherwise(F.lit("")))
    names = c.select(F.concat(prefix, F.lit("_"), model_store.stamp_of(at)).alias("name"))
    wanted = spark.createDataFrame([(p,) for p in ("retail", "retail_bis", "professionnel", "corporate", "corp", "retail_b")], "prefix string")
    return model_store.newest(names, wanted)


# ---------------------------------------------------------------------------
# As-of scorecards without the history
# ---------------------------------------------------------------------------
#: days from which a new batch begins
BATCH_DAYS = ("1994-01-01", "1996-06-01")


def _in_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The cases in three parts, by time."""
    cases = pin(dossiers.testbed_history(spark, sf_dir).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in asof_stream.CASES.fields]), "cases")
    day = F.col("created_at")
    first, second = (F.lit(d).cast("timestamp_ntz") for d in BATCH_DAYS)
    return [cases.where(day < first), cases.where((day >= first) & (day < second)), cases.where(day >= second)]


@query("asof_incremental")
def asof_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each replayed on the carry of those before it alone."""
    out, carry = None, None
    for batch in _in_batches(spark, sf_dir):
        scored = asof.asof_scorecards(batch, carry=carry)
        out = scored if out is None else out.unionByName(scored)
        own = asof.carry_of(batch)
        carry = pin(own if carry is None else asof.merge_carries(carry, own), "carry")
    return out


@query("asof_stream")
def asof_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches as files of a stream that is stopped after each."""
    base = scratch_path(spark, "asof_stream")
    for batch in _in_batches(spark, sf_dir):
        batch.write.mode("append").parquet(f"{base}/in")
        asof_stream.start(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return asof_stream.scored(spark, f"{base}/out")


# ---------------------------------------------------------------------------
# Figures of given predictions and segments
# ---------------------------------------------------------------------------
def given_answers() -> list[evaluation.Answer]:
    """Rules that answer instead of models, mirrored in the oracle."""
    action = rules.next_best_action(F.col("score_risque") + 10, "type_procedure", "nombre_retards", "anciennete_impaye_jours",
                                    "nombre_echeances_impayees")
    status = (F.when(F.col("nombre_retards") > 0, F.lit(S.STATUSES[2])).when(F.col("historique_incidents") > 1, F.lit(S.STATUSES[1]))
               .when(F.col("id") % 50 != 0, F.lit(S.STATUSES[0])))
    return [evaluation.Answer("procedure", F.col("type_procedure"), F.when(F.col("score_risque") >= 40, F.lit(S.JUDICIAL)).otherwise(F.lit(S.AMIABLE))),
            evaluation.Answer("status", F.col("statut_final"), status),
            evaluation.Answer("action", F.col("next_best_action"), action),
            evaluation.Answer("delay", F.col("delai_final_jours"), round_half_even(F.col("delai_final_jours") / 30, 0) * 30, number=True)]


@query("evaluation_confusion")
def evaluation_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each given answer is worth, label by label."""
    return evaluation.confusion(_labelled(spark, sf_dir), given_answers())


@query("evaluation_figures")
def evaluation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and RMSE of all given answers from one aggregate."""
    return (evaluation.figures(evaluation.confusion(_labelled(spark, sf_dir), given_answers()))
            .withColumn("value", F.round("value", 9)))


def _segment_features() -> dict:
    return {"score": F.col("score_risque") / 100, "age": F.col("anciennete_impaye_jours") / 1000, "events": F.col("nombre_evenements") / 7}


@query("segment_silhouette")
def segment_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of the segments that the bounds of F12 make."""
    cases = pin(dossiers.valid_cases(spark, sf_dir).withColumn(
        "segment", F.when(F.col("score_risque") < 40, 0).when(F.col("score_risque") <= 70, 1).otherwise(2)), "segments")
    return evaluation.silhouette(cases, "segment", list(_segment_features().values())).withColumn("silhouette", F.round("silhouette", 8))


@query("segment_profile")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of the nearest stored centre, the centres taken from
    exact quantiles, and what the cases of a segment have in common."""
    cases = pin(_labelled(spark, sf_dir), "segments")
    columns = _segment_features()
    centres = [[round(v, 6) for v in c] for c in evaluation.quantile_centres(cases, columns, S.KMEANS_K)]
    x = F.array(*columns.values())
    held = cases.withColumn("segment", evaluation.nearest_centre(x, centres))
    return held.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 8).alias(f"mean_{name}") for name, c in columns.items()],
        F.round(F.avg(F.when(F.col("statut_final") == S.RECOVERED, 1.0).otherwise(0.0)), 8).alias("recovered_share"),
        F.round(F.avg("montant_impaye"), 4).alias("mean_amount"))


# ---------------------------------------------------------------------------
# Spark ML (L1-L18, S4, S9, S10) and streaming (X1); rows-only checks
# ---------------------------------------------------------------------------
#: what the models of equal cases depend on besides the parameters below: a
#: new one whenever the training table or the fits change
MODEL_LAYOUT = "v3"


def model_root(spark: SparkSession, cases: DataFrame) -> str:
    """The store of the models of some cases: named by their rows, of which
    the training table is made, and the parameters of the fits, so other data
    or other parameters never find these models."""
    own = F.xxhash64(*cases.columns).cast("decimal(38,0)")
    rows = cases.agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("h")).first()
    params = (MODEL_LAYOUT, rows.n, rows.h, S.RF_TREES, S.RF_DEPTH, S.SEED, S.KMEANS_K, S.TRAIN_FRACTION,
              features.REQUEST_PART, features.CASE_PART)
    return stable_path(spark, "models", hashlib.sha1(repr(params).encode()).hexdigest()[:16])


def trained_models(spark: SparkSession, cases: DataFrame) -> dict:
    """Latest saved models for these written cases (S10), training them first
    if the store has none; only then the training table is made. What is
    returned was read from the store."""
    root = model_root(spark, cases)
    try:
        return model_store.load_all(spark, root)
    except FileNotFoundError:
        fitted, _ = models.train(spark, training.table_of(cases))
        model_store.save_models(fitted, root)
        return model_store.load_all(spark, root)


@query("feature_matrix_stats")
def feature_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per slot of the full feature vector, the mean and deviation it
    is standardised with, and what is left of them after (0 and 1; constant
    slots stay 0), to 6 decimals."""
    data = pin(models.prepare(training.training_table(spark, sf_dir)), "features")
    parts = (features.REQUEST_PART, features.CASE_PART)
    stages = features.fit_full(data)
    fitted = {parts[0].name: stages[:2], parts[1].name: stages[2:4]}
    scaled = features.transform(stages, data)
    after = scaled.select(Summarizer.metrics("mean", "std").summary(F.col(features.FULL)).alias("s")).first().s
    rows = []
    for part in parts:
        scaler = fitted[part.name][1]
        for name, mean, std in zip(features.slots(fitted[part.name], part, data), scaler.mean, scaler.std, strict=True):
            k = len(rows)
            rows.append((k, name, float(mean), float(std), float(after["mean"][k]), float(after["std"][k])))
    out = spark.createDataFrame(rows, "slot int, feature string, mean double, std double, mean_after double, std_after double")
    return out.select("slot", "feature", *[(F.round(F.col(c), 6) + 0.0).alias(c) for c in out.columns[2:]])


@query("label_order")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every label, by frequency, ties by name."""
    data = pin(_labelled(spark, sf_dir).select("type_procedure", "statut_final", "next_best_action"), "labels")
    rows = [(label, i, name) for label, idx, _, _ in models.SPECS.values() if idx is not None
            for i, name in enumerate(models.label_indexer(label, idx).fit(data).labelsArray[0])]
    return spark.createDataFrame(rows, "label string, label_index int, name string")


@query("train_split")
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of every case."""
    cases = dossiers.valid_cases(spark, sf_dir).withColumn("feature_id", rules.feature_id(
        "dossier_id", "procedure_id", F.lit(dossiers.TESTBED_BATCH)))
    train, test = models.split(cases)
    return train.select("id", F.lit(True).alias("in_training")).unionByName(test.select("id", F.lit(False).alias("in_training")))


@query("actor_assignment")
def actor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new case's columns and actors, without and with
    actors in the request."""
    cases = scoring.new_case_columns(dossiers.valid_cases(spark, sf_dir))
    named = scoring.assign_actors(cases)
    automatic = scoring.assign_actors(cases.drop("tribunal_id", "avocat_id", "huissier_id"))
    kept = ("tribunal_id", "avocat_id", "huissier_id")
    return (automatic.select("id", "score_risque", "nombre_evenements", "nombre_retards", "derniere_action_age_jours", *kept)
            .join(named.select("id", *[F.col(c).alias(f"{c}_connu") for c in kept]), "id"))


@query("decoded_predictions")
def decoded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and probability read at their fitted places,
    for given prediction columns (one index has no label), and the rounded
    answer."""
    c = dossiers.valid_cases(spark, sf_dir).select("id", "dossier_id", "type_procedure", "delai_estime_jours",
                                                   (F.col("id") % 4).cast("double").alias("statut_index"))
    share = (F.col("id") % 1000) / 1000.0
    probability = F.array((1 - share) / 2, share, (1 - share) / 2)
    decoded = c.select(
        "dossier_id", "type_procedure", scoring.decode("statut_index", S.STATUSES, scoring.FALLBACK_STATUS).alias("statut_predit"),
        scoring.probability_of(S.RECOVERED, probability, S.STATUSES[1:] + S.STATUSES[:1]).alias("probabilite_recouvrement"),
        (F.col("delai_estime_jours") / 7).alias("delai_estime_jours"),
        scoring.decode("statut_index", S.ACTIONS, scoring.FALLBACK_ACTION).alias("next_best_action"),
        F.lit(1).alias("cluster_segment_id"), F.lit(59.0).alias("score_avocat"), F.lit(65.0).alias("score_huissier"),
        F.lit(0.65).alias("acteur_taux_succes"), F.lit(120.0).alias("acteur_delai_moyen"))
    return scoring.response(decoded)


@query("train_metrics")
def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7-L17 fit + evaluate, S9 save with a timestamp, S10 reload latest;
    plus the duration RMSE without the leaking lawyer-score feature. The
    figures of a model are reported once it has been read back."""
    cases = pin(dossiers.valid_cases(spark, sf_dir), "cases")
    root = model_root(spark, cases)
    fitted, metrics = models.train(spark, training.table_of(cases))
    paths = model_store.save_models(fitted, root)
    loaded = model_store.load_all(spark, root)
    same = {k: [s.uid for s in loaded[k].stages] == [s.uid for s in fitted[k].stages] for k in S.MODEL_PREFIXES}
    latest = {p: model_store.latest_model_path(spark, root, p) for p in S.MODEL_PREFIXES}
    saved = spark.createDataFrame([(k, paths[k], latest[k], same[k]) for k in S.MODEL_PREFIXES],
                                  "model string, saved_path string, latest_path string, read_back boolean")
    return metrics.join(saved, "model", "left")


@query("batch_scoring")
def batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L18 cascade over every valid case, with the actors its request names,
    against a scorecard snapshot of the history, S7 append, P13 response."""
    cases = pin(dossiers.valid_cases(spark, sf_dir), "cases")
    fitted = trained_models(spark, cases)
    cards = sc.snapshot(cases)
    scored = pin(scoring.score(cases.select(*S.REQUEST_FIELDS, "tribunal_id", "avocat_id", "huissier_id"), cards, fitted), "scored")
    path = scratch_path(spark, "scored_history")
    history.append_history(spark, history.to_history_rows(scored, "batch"), path, "batch")
    return scoring.response(scored)


@query("cascade_lookups")
def cascade_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cascade looks up for each case's own actors,
    its mapped procedure taken as the predicted one."""
    cases = pin(dossiers.valid_cases(spark, sf_dir), "cases")
    out = sc.attach_scorecards(scoring.assign_actors(cases), sc.snapshot(cases))
    return out.select("id", "avocat_id", "tribunal_id", "huissier_id", "acteur_taux_succes", "acteur_delai_moyen",
                      "tribunal_delai_moyen", "procedure_taux_succes", "score_huissier", "score_avocat")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history a stream over all records leaves, run twice."""
    fitted = trained_models(spark, pin(dossiers.valid_cases(spark, sf_dir), "cases"))
    base = scratch_path(spark, "stream")
    src = f"{base}/in"
    intake.request_records(spark, sf_dir).select("value").write.text(src)
    hist, quarantine, ckpt = f"{base}/history", f"{base}/quarantine", f"{base}/ckpt"
    for _ in range(2):
        q = scoring_stream.start(spark, src, hist, quarantine, ckpt, fitted, max_bytes_per_trigger=scoring_stream.batch_bytes(spark))
        q.awaitTermination()
    return history.read_history(spark, hist)


@query("stream_scoring")
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records arrive as files; each micro-batch is validated,
    scored against the history so far and appended. A second run on the
    same checkpoint adds nothing."""
    return _streamed(spark, sf_dir).select(
        *S.HISTORY_VIEW_COLUMNS, "type_procedure", "avocat_id", "huissier_id", "batch_id")


@query("stream_history")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a streamed case that no model decides."""
    return _streamed(spark, sf_dir).select(
        "dossier_id", "procedure_id", "client_segment", "montant_impaye", "score_risque", "nombre_evenements",
        "nombre_retards", "derniere_action_age_jours", "huissier_id")
