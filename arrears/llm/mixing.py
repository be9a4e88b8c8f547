"""Operator 7: mixing sources to target weights by entropy balancing.

Documents get rates that stay as close as they can to 1 (in relative entropy
over words) while each source's expected words meet its target. The dual is
convex and has one multiplier for each source; the rates are the exponential
tilt ``exp(multiplier)``. Newton iterations run on the table of distinct
(source, size) counts, multipliers and moments being tables too, so nothing
depends on how many sources there are.

Rates become whole copies by carrying the rest: within a source, from large
documents to small, each size takes as many extra copies as bring the words
taken so far nearest to the words due so far. What is left over at the end is
about half of the smallest documents.

Sizes are words; a null text has none. A null source is a source of its own,
the last in order. A source without words has target 0. Documents without
words take no part in the balance and get the rounded rate. Equal rows are
told apart by nothing, so which of them is copied does not show. An empty
table gives an empty one. Other columns are kept, whatever their names;
``copies`` replaces those named like its output, ``mixed`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrears.session import pin

from .common import WORD, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-13
MAX_STEPS = 200


def word_count(text: str = "text"):
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def weighted_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                     most: float = MOST) -> DataFrame:
    """``totals(key, source, source_size)`` with ``target``.

    Sources in order of code point, null last, take the weights in turn. They
    share ``share`` of all words by weight; a target stops at ``most`` times
    its source's words and the excess goes to the rest by weight. Filled in
    order of how soon a source is full, the first that is not full sets the
    level for it and all after it. One row for each source passes here."""
    nth = W.orderBy(F.asc_nulls_last("source"))
    soonest = W.orderBy("fill", "key")
    before, after = soonest.rowsBetween(W.unboundedPreceding, -1), soonest.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy("fill", "key").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wheel = F.array(*[F.lit(float(x)) for x in weights])
    return (totals.withColumn("weight", F.element_at(wheel, (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int")))
            .withColumn("full", F.lit(most) * F.col("source_size"))
            .withColumn("fill", F.col("full") / F.col("weight"))
            .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything)
                                  - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
            .withColumn("open", F.col("fill") > F.col("level"))
            .withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")),
                                          F.when(F.col("open"), F.struct("fill", "key"))).over(everything))
            .select("key", "source", "source_size",
                    F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("full")).alias("target")))


def balance(sizes: DataFrame, targets: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Multipliers by Newton's method: ``targets`` with ``rate``.

    ``sizes(key, size, n)`` holds all documents. Each step sums the tilted
    words of every source and moves its multiplier by gradient over
    curvature; the dual's Hessian is diagonal, since a document has one
    source. Each step is written, as a table of one row for each source."""
    state = pin(targets.withColumn("multiplier", F.lit(0.0)), "mixing")
    for _ in range(max_steps):
        tilted = (sizes.join(state.select("key", "multiplier"), "key").groupBy("key")
                  .agg((F.sum(F.col("n") * F.col("size")) * F.exp(F.first("multiplier"))).alias("moment")))
        gap = F.col("target") - F.col("moment")
        state = pin(state.drop("moment", "off").join(tilted, "key")
                    .withColumn("multiplier", F.when(F.col("moment") > 0, F.col("multiplier") + gap / F.col("moment"))
                                .otherwise(F.col("multiplier")))
                    .withColumn("off", F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(F.lit(0.0))),
                    "mixing")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"balance: targets missed by {worst} after {max_steps} steps")
    # rates to twelve digits, so that the last step does not show
    rate = F.floor(F.exp("multiplier") * 1e12 + 0.5) / 1e12
    return state.withColumn("rate", F.when(F.col("target") > 0, rate).otherwise(F.lit(0.0)))


def carried(cells: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each size of one source, the rest carried on. One row
    for each distinct size."""
    cells = cells.sort_values("size", ascending=False)
    part = float(cells["rate"].iloc[0] - np.floor(cells["rate"].iloc[0]))
    rest, extra = 0.0, []
    for z, n in zip(cells["size"].tolist(), cells["n"].tolist(), strict=True):
        if z == 0:
            extra.append(n if part >= 0.5 else 0)
            continue
        rest = rest + part * (n * z)
        k = min(max(int(np.floor(rest / z + 0.5)), 0), n)
        rest = rest - k * z
        extra.append(k)
    return cells.assign(extra=extra)[["key", "size", "extra"]]


def _taken(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], share: float,
           most: float) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``size``,
    ``source_size``, ``target``, ``rate`` and ``copies``.

    Which documents of one source and size are copied once more goes by the
    digest of their ids. They are counted off in 256 groups by digest, so
    that a size which a third of all rows share is not in one task."""
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    slice_ = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 2)
    sized = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.col(source).cast("string").alias("source"),
                        word_count(text).alias("size"), slice_.alias("slice"),
                        F.col(doc_id).alias("id"))
    slices = pin(sized.groupBy("key", "source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "mixing")
    sizes = slices.groupBy("key", "size").agg(F.sum("n").alias("n"))
    totals = slices.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rates = balance(sizes, weighted_targets(totals, weights, share, most))
    extra = (sizes.join(rates.select("key", "rate"), "key").groupBy("key")
             .applyInPandas(carried, "key string, size long, extra long"))
    earlier = W.partitionBy("key", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    due = (slices.drop("source").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
           .join(extra, ["key", "size"]).join(rates.select("key", "source_size", "target", "rate"), "key").drop("n"))
    place = F.row_number().over(W.partitionBy("key", "size", "slice").orderBy("id"))
    return (sized.drop("source").withColumn("place", place).join(due, ["key", "size", "slice"])
            .withColumn("copies", (F.floor("rate") + F.when(F.col("before") + F.col("place") <= F.col("extra"), 1)
                                   .otherwise(0)).cast("int"))
            .select("row", "size", "source_size", "target", "rate", "copies"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and
    ``copies``, the number of times the mix takes each document."""
    own = ("size", "source_size", "target", "rate", "copies")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return _taken(docs, doc_id, text, source, weights, share, most).select(*kept, *own)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says, with the
    columns of ``docs`` and their values."""
    return (_taken(docs, doc_id, text, source, weights, share, most).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target",
                               (F.col("size") * F.col("copies")).alias("taken"))


#: the same by recursion over the sizes of each source, and the rate in closed form
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS slice
  FROM documents),
s AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key, source),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY fill, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT key, source_size,
             CASE WHEN fill > level THEN weight * (SELECT arg_min(level, (fill, key)) FROM l WHERE fill > level)
                  ELSE cap END AS target FROM l),
r AS (SELECT *, CASE WHEN target > 0 THEN floor(target / source_size * 1e12::DOUBLE + 0.5::DOUBLE) / 1e12::DOUBLE ELSE 0 END AS rate FROM t),
c AS (SELECT d.key, size, CAST(count(*) AS BIGINT) AS n, any_value(rate) - floor(any_value(rate)) AS part, any_value(rate) AS rate,
             row_number() OVER (PARTITION BY d.key ORDER BY size DESC) AS i
      FROM d JOIN r ON d.key = r.key GROUP BY d.key, size),
scan AS (
  SELECT key, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS rest, CAST(0 AS BIGINT) AS extra FROM r
  UNION ALL
  SELECT c.key, c.i,
         CASE WHEN c.size = 0 THEN scan.rest ELSE scan.rest + part * (n * c.size)
           - least(greatest(floor((scan.rest + part * (n * c.size)) / c.size + 0.5::DOUBLE), 0), n) * c.size END,
         CASE WHEN c.size = 0 THEN CASE WHEN part >= 0.5 THEN n ELSE 0 END
              ELSE CAST(least(greatest(floor((scan.rest + part * (n * c.size)) / c.size + 0.5::DOUBLE), 0), n) AS BIGINT) END
  FROM scan JOIN c ON c.key = scan.key AND c.i = scan.i + 1),
p AS (SELECT d.*, row_number() OVER (PARTITION BY key, size ORDER BY slice, doc_id) AS place FROM d)
SELECT p.doc_id, p.size, r.source_size, r.target,
       CAST(p.size * (floor(r.rate) + CASE WHEN place <= scan.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p JOIN r ON p.key = r.key JOIN c ON c.key = p.key AND c.size = p.size
JOIN scan ON scan.key = c.key AND scan.i = c.i
"""
