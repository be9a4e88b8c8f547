"""As-of scorecards of arriving cases (J5, W1 on a stream).

Case files arrive in time order. Each micro-batch is replayed by
``asof.asof_scorecards`` on top of the carry, the totals of every card over
all cases before it, so a case sees exactly the history before it: earlier
batches through the carry, earlier cases of its own batch through the scan.
No earlier case is read again, and a card that most cases share is split among
tasks; one keyed state a card would hold it in one.

The carry is a table for each batch, below ``<out>/carry``, and the scored
cases one below ``<out>/cases``. A batch starts from the carry of the batch
before it and writes whole folders of its own, so a batch that is run again
after a crash, in this run or a later one, writes the same rows again. The two
newest carries are kept. One writer per ``out`` folder and checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from arrears.operators import asof
from arrears.session import delete_path, pin, scratch_path, scratch_scope
from arrears.sources.history import _exists

CASES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("avocat_id", T.StringType()), T.StructField("tribunal_id", T.StringType()),
    T.StructField("type_procedure", T.StringType()), T.StructField("huissier_id", T.StringType()),
    T.StructField("statut_predit", T.StringType()), T.StructField("delai_estime_jours", T.DoubleType())])
#: the newest and the one a replay of it starts from
KEPT_CARRIES = 2


def _carry_path(out: str, batch: int) -> str:
    return f"{out}/carry/{batch:020d}"


def replay_batch(cases: DataFrame, batch: int, out: str) -> None:
    """Scores the cases of one batch on the carry before it and moves the
    carry on."""
    spark = cases.sparkSession
    with scratch_scope(spark, scratch_path(spark, "asof_batch")):
        cases = pin(cases)
        before = _carry_path(out, batch - 1)
        carry = spark.read.parquet(before) if batch and _exists(spark, before) else None
        if batch and carry is None:
            raise FileNotFoundError(f"the carry before batch {batch} is gone: {before}")
        asof.asof_scorecards(cases, carry=carry).write.mode("overwrite").parquet(f"{out}/cases/batch={batch}")
        own = asof.carry_of(cases)
        after = own if carry is None else asof.merge_carries(carry, own)
        after.write.mode("overwrite").parquet(_carry_path(out, batch))
    if batch >= KEPT_CARRIES:
        delete_path(spark, _carry_path(out, batch - KEPT_CARRIES))


def start(spark: SparkSession, incoming: str, out: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Replays the Parquet files of ``incoming`` as they come; unless
    ``continuous``, those that are there now."""
    writer = (spark.readStream.schema(CASES).parquet(incoming).writeStream
              .option("checkpointLocation", checkpoint)
              .foreachBatch(lambda cases, batch: replay_batch(cases, batch, out)))
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def scored(spark: SparkSession, out: str) -> DataFrame:
    """The scored cases so far."""
    return spark.read.parquet(f"{out}/cases").drop("batch")
