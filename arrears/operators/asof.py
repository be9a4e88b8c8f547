"""As-of replay (J5, W1): each case sees only history committed before it.

A plain ``Window.partitionBy(entity).orderBy(time)`` puts a whole entity in
one task; the procedure type has two values and the sentinel ids cover
most rows, so that plan does not survive scale. ``running_totals`` is a
distributed exclusive prefix sum instead:

1. ``repartitionByRange`` on (key, order...) splits even a single hot key
   across many partitions (the bounds are sampled on the full sort key) and
   each partition holds one contiguous slice of the global order;
2. inside a partition, a vectorised pandas scan (``mapInPandas``) gives
   every row the totals of the earlier rows *of that partition*;
3. the same scan emits one summary row per partition (first key, last key,
   totals of the last key); its output is pinned (written once) so both
   uses see one partition layout. A window over the N summary rows (N <=
   spark.sql.shuffle.partitions) yields the carry-in of each partition's
   first key;
4. the N-row carry table is broadcast back and added.

One range shuffle and one pinned write of the input; everything else is
map-side or N rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears import schema as S
from arrears.functions import rules
from arrears.functions.rounding import round_half_even
from arrears.session import checkpoint_root, pin

PID = "_pid"
N_PRIOR = "n_prior"
SUMMARY = "_summary"


def _prior_name(v: str) -> str:
    return f"{v}_prior"


def _local_scan(keys: list[str], values: list[str], passthrough: list[str], weight: str | None):
    """Exclusive running totals per key within one (sorted) partition, plus
    one summary row for the partition: its first key (``_first_*``), its last
    key (in the key columns) and the totals of that last key. A row counts
    once, or as often as ``weight`` says."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key = None
        carry = None  # totals [n, values...] of the open (last) key group
        first_key = None
        pid = None
        template = None
        for pdf in batches:
            if pdf.empty:
                continue
            work = pd.DataFrame({"_one": np.ones(len(pdf), dtype=np.int64) if weight is None else pdf[weight].to_numpy()})
            for v in values:
                work[v] = pdf[v].to_numpy()
            cols = [pdf[k].to_numpy() for k in keys]
            incl = work.groupby(cols, sort=False).cumsum()
            plain = work.to_numpy(dtype=np.float64)
            excl = incl.to_numpy(dtype=np.float64) - plain

            def matches(key: tuple) -> np.ndarray:
                return np.logical_and.reduce([c == kv for c, kv in zip(cols, key)])

            if carry_key is not None:
                excl[matches(carry_key)] += carry
            else:
                first_key = tuple(c[0] for c in cols)
                pid = int(pdf[PID].iloc[0])
            last_key = tuple(c[-1] for c in cols)
            totals = plain[matches(last_key)].sum(axis=0)
            if carry_key is not None and last_key == carry_key:
                carry = carry + totals
            else:
                carry = totals
            carry_key = last_key
            out = pdf[passthrough].copy()
            out[N_PRIOR] = excl[:, 0].astype(np.int64)
            for i, v in enumerate(values, start=1):
                out[_prior_name(v)] = excl[:, i]
            out[SUMMARY] = False
            for k in keys:
                out[f"_first_{k}"] = None
            if template is None:
                template = out.iloc[:0]
            yield out
        if carry_key is not None:
            row = {c: None for c in template.columns}
            row[PID] = pid
            for k, kv in zip(keys, carry_key):
                row[k] = kv
            for k, kv in zip(keys, first_key):
                row[f"_first_{k}"] = kv
            row[N_PRIOR] = int(carry[0])
            for i, v in enumerate(values, start=1):
                row[_prior_name(v)] = float(carry[i])
            row[SUMMARY] = True
            yield pd.DataFrame([row], columns=template.columns)
    return scan


def running_totals(df: DataFrame, keys: list[str], order: list[str],
                   values: list[str], num_partitions: int | None = None,
                   keep: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Adds ``n_prior`` and ``<value>_prior``: count and sums of the rows with
    the same key strictly before each row in ``order``. Keys must be
    non-null; ``order`` must be a total order (end it with a unique id).
    With ``keep`` only those columns (and the keys) come back. A row whose
    ``weight`` is n stands for n rows of which ``values`` are the sums.

    The scanned rows are pinned (a table under ``spark.checkpoint.dir``): the
    carry step must see exactly the partition layout the scan saw, and a
    re-sampled range partitioner would not guarantee it.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    for v in values:
        df = df.withColumn(v, F.col(v).cast("double"))
    # without an explicit count AQE may merge adjacent ranges (they stay
    # contiguous and ordered); the count stays <= spark.sql.shuffle.partitions
    ranged = (df.repartitionByRange(num_partitions, *keys, *order) if num_partitions
              else df.repartitionByRange(*keys, *order))
    ranged = (ranged.sortWithinPartitions(*keys, *order)
                .withColumn(PID, F.spark_partition_id()))
    key_types = {f.name: f.dataType for f in ranged.schema.fields}
    # columns carried through the scan: all by default, or only ``keep``
    # (plus keys and partition id), which narrows the pinned write
    if keep is None:
        carried = [f.name for f in ranged.schema.fields]
    else:
        carried = [c for c in ranged.columns if c in set(keep) | set(keys) | {PID}]
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields
         if f.name in carried]
        + [T.StructField(N_PRIOR, T.LongType())]
        + [T.StructField(_prior_name(v), T.DoubleType()) for v in values]
        + [T.StructField(SUMMARY, T.BooleanType())]
        + [T.StructField(f"_first_{k}", key_types[k]) for k in keys])
    scanned = pin(ranged.mapInPandas(_local_scan(keys, values, carried, weight), out_schema),
                  "asof_scan")

    tot_cols = [N_PRIOR] + [_prior_name(v) for v in values]
    last = F.struct(*keys)
    first = F.struct(*[F.col(f"_first_{k}").alias(k) for k in keys])
    # one row per non-empty partition: at most spark.sql.shuffle.partitions
    summary = scanned.filter(F.col(SUMMARY)).select(
        PID, last.alias("_last"), first.alias("_first"), *tot_cols)
    run_w = (Window.partitionBy("_last").orderBy(PID)
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_pid = Window.orderBy(PID)
    runs = summary.select(PID, "_last", "_first",
                          *[F.sum(c).over(run_w).alias(f"_run_{c}") for c in tot_cols])
    carry = runs.select(
        PID, "_first",
        *[F.when(F.lag("_last").over(by_pid) == F.col("_first"),
                 F.lag(f"_run_{c}").over(by_pid)).otherwise(F.lit(0)).alias(f"_carry_{c}")
          for c in tot_cols])

    rows = scanned.filter(~F.col(SUMMARY)).drop(SUMMARY, *[f"_first_{k}" for k in keys])
    joined = rows.join(F.broadcast(carry), PID)
    is_first = last == F.col("_first")
    for c in tot_cols:
        joined = joined.withColumn(
            c, F.col(c) + F.when(is_first, F.col(f"_carry_{c}")).otherwise(F.lit(0)))
    out = joined.drop(PID, "_first", *[f"_carry_{c}" for c in tot_cols])
    return out.withColumn(N_PRIOR, F.col(N_PRIOR).cast("long"))


# ---------------------------------------------------------------------------
# As-of scorecards
# ---------------------------------------------------------------------------
_DIMS = [("lawyer", "avocat_id", True), ("court", "tribunal_id", True),
         ("procedure", "type_procedure", False), ("bailiff", "huissier_id", False)]


def _entries(history: DataFrame, status: str, delay: str, *kept: str) -> DataFrame:
    """A row for each case and card it counts for."""
    entries = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("entity"))
                        for d, c, _ in _DIMS])
    return (history.select(*kept, F.when(F.col(status) == S.RECOVERED, 1).otherwise(0).alias("ok"),
                           F.col(delay).alias("delay"), F.inline(entries))
                   .filter(~(F.col("dim").isin("lawyer", "court")
                             & (F.col("entity") == S.NONE_ID))))


def carry_of(history: DataFrame, status: str = "statut_predit", delay: str = "delai_estime_jours") -> DataFrame:
    """``(dim, entity, n, ok, delay)``: all that later cases need of a
    history, one row for each card. Two carries add up (``merge_carries``)."""
    return _entries(history, status, delay).groupBy("dim", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ok").cast("double").alias("ok"), F.sum("delay").cast("double").alias("delay"))


def merge_carries(*carries: DataFrame) -> DataFrame:
    """The carry of several histories put together."""
    out = carries[0]
    for more in carries[1:]:
        out = out.unionByName(more)
    return out.groupBy("dim", "entity").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "delay")])


def asof_scorecards(history: DataFrame, status: str = "statut_predit",
                    delay: str = "delai_estime_jours",
                    order: tuple[str, str] = ("created_at", "id"),
                    num_partitions: int | None = None,
                    carry: DataFrame | None = None) -> DataFrame:
    """Per history row: the four scorecards computed over the rows strictly
    before it (same rules and defaults as the live lookups).

    With the ``carry`` of an earlier history, ``history`` holds only the
    cases after it. Its cards enter the scan as one row each, in front of
    their key's cases, so nothing is joined and a card that a third of all
    cases share is still split among tasks.
    """
    ts, rid = order
    long = _entries(history, status, delay, rid, ts).withColumn("n", F.lit(1).cast("long")).withColumn("late", F.lit(1))
    if carry is not None:
        kinds = dict(long.dtypes)
        before = carry.select(*[F.col(c) for c in ("dim", "entity", "n", "ok", "delay")], F.lit(0).alias("late"),
                              *[F.lit(None).cast(kinds[c]).alias(c) for c in (rid, ts)])
        long = long.unionByName(before)
    scanned = running_totals(long, ["dim", "entity"], ["late", ts, rid], ["ok", "delay"],
                             num_partitions, keep=[rid, "late"], weight="n").where("late = 1").drop("late")

    def pick(dim: str, c: str):
        return F.max(F.when(F.col("dim") == dim, F.col(c)))

    # the entity ids come back from the stacked rows (a filtered sentinel
    # leaves no row: it is NONE), so the history is read only once
    wide = scanned.groupBy(rid).agg(
        *[pick(d, "entity").alias(c) for d, c, _ in _DIMS],
        *[pick(d, c).alias(f"{d}_{c}") for d, _, _ in _DIMS
          for c in (N_PRIOR, "ok_prior", "delay_prior")])
    out = wide
    for d, c, sentinel in _DIMS:
        if sentinel:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(S.NONE_ID)))

    def seen(d: str):
        return F.coalesce(F.col(f"{d}_{N_PRIOR}"), F.lit(0)) > 0

    def rate(d: str):
        return F.col(f"{d}_ok_prior") / F.col(f"{d}_{N_PRIOR}")

    def mean(d: str):
        return F.col(f"{d}_delay_prior") / F.col(f"{d}_{N_PRIOR}")

    none_lawyer = F.col("avocat_id") == S.NONE_ID
    lawyer_rate = (F.when(none_lawyer | ~seen("lawyer"), F.lit(S.DEFAULT_SUCCESS_RATE))
                    .otherwise(round_half_even(rate("lawyer"), 3)))
    lawyer_delay = (F.when(none_lawyer | ~seen("lawyer"), F.lit(S.DEFAULT_MEAN_DELAY))
                     .otherwise(round_half_even(mean("lawyer"), 1)))
    court = (F.when(F.col("tribunal_id") == S.NONE_ID, F.lit(S.NO_COURT_DELAY))
              .when(~seen("court"), F.lit(S.DEFAULT_COURT_DELAY))
              .otherwise(round_half_even(mean("court"), 1)))
    proc = (F.when(~seen("procedure"), F.lit(S.DEFAULT_PROCEDURE_RATE))
             .otherwise(round_half_even(rate("procedure"), 3)))
    bailiff = (F.when(~seen("bailiff"), F.lit(S.DEFAULT_BAILIFF_SCORE))
                .otherwise(rules.lawyer_score(rate("bailiff"), mean("bailiff"))))
    return out.select(
        rid, "avocat_id", "tribunal_id", "type_procedure", "huissier_id",
        F.coalesce(F.col(f"lawyer_{N_PRIOR}"), F.lit(0)).alias("lawyer_n_prior"),
        lawyer_rate.alias("acteur_taux_succes"),
        lawyer_delay.alias("acteur_delai_moyen"),
        court.alias("tribunal_delai_moyen"),
        proc.alias("procedure_taux_succes"),
        bailiff.alias("score_huissier"),
    ).withColumn("score_avocat", rules.lawyer_score("acteur_taux_succes", "acteur_delai_moyen"))
