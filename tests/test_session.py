"""The shared folder and batches of sessions in different zones."""

import pytest
from pyspark.sql import functions as F

from arrears import session
from arrears.sources import dossiers, history
from tests.conftest import SF_SMALL


class Unset:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return Unset.conf

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_told(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Unset)
    assert session.checkpoint_root(spark)


def test_scoring_time_is_utc(spark):
    rows = dossiers.testbed_history(spark, SF_SMALL).limit(1).withColumns(
        {c: F.lit(0.0) for c in ("acteur_taux_succes", "acteur_delai_moyen", "tribunal_delai_moyen", "procedure_taux_succes",
                                 "cluster_segment_id", "probabilite_recouvrement", "score_avocat")}).withColumn("next_best_action", F.lit("x"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = []
    try:
        for tz in ("Pacific/Auckland", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            times.append(history.to_history_rows(rows, "b").select(F.col("created_at").cast("string")).first()[0][:13])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert times[0] == times[1]
