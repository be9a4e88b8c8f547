"""Linking what shares a bucket, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.session import pin

from .common import components, slots

#: pairs across components are compared at once if they are at most this many
#: times the bucket entries they come from
CROSS = 20
#: members of a bucket that are compared with as many others in one group
BLOCK = 500
#: members of a bucket that are paired with the rest in the first round; GROW
#: times as many in each later one
HUBS, GROW = 4, 4
#: a later round of which at most one in this many pairs is a link is the last of its kind
FEW = 10


def link_buckets(buckets: DataFrame, comparable: Callable[[Column, Column], Column],
                 verified: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Components ``(id, component)`` of all true links between members of
    one bucket; None if no bucket holds two members.

    ``buckets(bucket, c, about, weight)`` is a written table. ``comparable``
    tells from two ``about`` values that a link is possible, ``verified``
    keeps the true links of ``pairs(a, b)``. Only components are wanted, so
    pairs inside one are never formed: in each round a few members of every
    bucket, the heaviest of each of as many parts, are paired with those of
    their bucket in other components. Such a hub has then met all it shares the
    bucket with and leaves it, so every round makes every open bucket smaller.
    Once what is left across components is not much more than the entries it
    comes from, or a later round found next to no links, all of it is paired:
    more rounds would test the same pairs a few at a time. In each bucket those
    outside its largest component meet all others; both sides of a large
    bucket are cut into blocks of about BLOCK, which go to tasks of their own.
    A large group costs a few rows a member and round, the number of rounds
    grows with the logarithm of its size, no bucket is capped, and no pair that
    could join two components goes untested.
    """
    links = tested = found = None
    rest, hubs, fruitless = buckets, HUBS, False
    while True:
        if links is None:  # every member is a component of its own
            open_ = rest.withColumn("comp", F.col("c"))
            left = (open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
                    .withColumn("across", F.col("k") * (F.col("k") - 1) / 2).where("across > 0"))
        else:
            found = components(links)
            open_ = pin(rest.join(found.withColumnRenamed("id", "c"), "c", "left")
                        .withColumn("comp", F.coalesce("component", "c")).drop("component"), "linking")
            left = pin(open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
                       .agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.max("k").alias("most"),
                            F.max_by("comp", F.struct("k", "comp")).alias("main"))
                       .withColumn("across", (F.col("k") * F.col("k") - F.col("k2")) / 2).where("across > 0"), "linking")
        size = left.agg(F.coalesce(F.sum("across"), F.lit(0.0)).alias("across"),
                        F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
        if size.k == 0:
            return found
        last = links is not None and (size.across <= CROSS * size.k or fruitless)
        if links is not None:
            open_ = open_.join(left.select("bucket", "k", "most", "main"), "bucket")
        if last:
            pairs = _across(open_, comparable)
        else:
            open_ = open_ if links is None else pin(open_, "linking")
            other = pin(open_.groupBy("bucket", F.pmod(F.xxhash64("c"), F.lit(hubs)))
                        .agg(F.max_by(F.struct("c", "about", "comp"), F.struct("weight", -F.col("c"))).alias("hub"))
                        .select("bucket", "hub.*").toDF("bucket", "d", "about2", "comp2"), "linking")
            rest = open_.select("bucket", "c", "about", "weight").join(other.select("bucket", F.col("d").alias("c")), ["bucket", "c"], "left_anti")
            pairs = (open_.join(other, "bucket").where((F.col("comp") != F.col("comp2")) & comparable(F.col("about"), F.col("about2")))
                     .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))
        pairs = pairs.distinct()
        pairs = pin(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "linking")
        tested = pairs if tested is None else tested.unionAll(pairs)
        new = pin(verified(pairs), "linking")
        links = new if links is None else links.unionAll(new)
        if last:
            return components(links)
        fruitless = hubs > HUBS and FEW * new.count() <= pairs.count()
        hubs *= GROW


def _across(members: DataFrame, comparable: Callable[[Column, Column], Column]) -> DataFrame:
    """All comparable pairs ``(a, b)`` across components of one bucket, of
    ``members(bucket, c, about, comp, k, most, main)``: those outside the
    bucket's largest component (``k - most`` of ``k``) meet the rest."""
    def cut(n):
        return F.ceil(n / F.lit(BLOCK)).cast("int")

    def block(n):
        return F.pmod(F.xxhash64("c"), cut(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), cut(n) - 1))
    few = F.col("k") - F.col("most")
    one = members.select("bucket", "c", "about", "comp", "main", block(F.col("k")).alias("i"), every(few).alias("j"))
    two = (members.where("comp != main")
           .select("bucket", F.col("c").alias("d"), F.col("about").alias("about2"), F.col("comp").alias("comp2"),
                   block(few).alias("j"), every(F.col("k")).alias("i")))
    once = (F.col("comp") == F.col("main")) | (F.col("c") < F.col("d"))
    # dealt to all tasks: few rows make many comparisons
    parts = slots(members.sparkSession)
    return (one.repartition(parts, "bucket", "i", "j").join(two, ["bucket", "i", "j"])
            .where((F.col("comp") != F.col("comp2")) & once & comparable(F.col("about"), F.col("about2")))
            .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))
