"""Operator 4: near-duplicate documents by MinHash with tensored banding.

Two documents are linked if their sets of five-word shingles have a Jaccard
similarity of 0.75 or more. Candidates come from MinHash tables whose keys
are pairs: two small collections of HALVES half keys, each made of DEPTH
minimum hashes, give HALVES x HALVES tables of 2 x DEPTH hashes each. So 96
hashes a document serve 256 tables, where separate bands would need 1,536. A
pair at exactly 0.75 is missed with probability
1 - (1 - (1 - 0.75^3)^16)^2 = 0.0003, one at 0.8 with 0.00002. Every
candidate is verified on the full sets; no link is estimated.

Documents with equal sets are one class. Only half keys that another class has
too take part. The HALVES tables of one left half key are looked up together:
classes meet under the left key, and of those that do, the ones with an equal
right key have an equal table key. So a class takes a row for each left key
and not one for each table. With its keys a class carries a bitmap of its
shingles. What one bitmap has and the other lacks bounds from below how many
shingles the sets do not share, so candidates that cannot reach the similarity
are left before they are written, and no link is. Within a bucket, classes are
paired as ``linking.link_buckets`` says: not all with all, yet so that no
candidate that could join two components is left out, and without a cap.

Null and empty texts, or those of white space alone, have no shingles and are
linked with nothing, not with each other. Rows with equal ids count as rows of
their own, told apart by 128 bits of their texts. A null id takes part in
links; a component's id is its smallest id that is not null, or null. ``kept``
marks every row with that id (a null id is kept in a component without other
ids); ``stays`` marks one of them, the first by the hash of its text, then in
the table. An empty table gives an empty one. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

from .common import bloom, passes, table, text_or_empty, unpack
from .linking import link_buckets

HALVES, DEPTH = 16, 3
SIMILAR = 75  # per cent
#: 64-bit words of a class's bitmap
SKETCH = 16

_rng = np.random.default_rng(40490)
_SPREAD = _rng.integers(0, 1 << 63, 2 * HALVES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, 2 * HALVES * DEPTH, dtype=np.uint64)


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each hash function; bounded memory for long texts."""
    low = np.full(len(_SPREAD), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 2048):
        h = shingles[None, lo:lo + 2048] ^ _SALT[:, None]
        h *= _SPREAD[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, h.min(axis=1))
    return low


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """The half keys of both collections, one behind the other."""
    m = minimum_hashes(shingles).reshape(2 * HALVES, DEPTH)
    key = np.arange(2 * HALVES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(DEPTH):
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key += m[:, j]
    return key ^ key >> np.uint64(31)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for the place of each shingle."""
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[shingles % np.uint64(64 * SKETCH)] = 1
    return np.packbits(bits).view(np.int64)


_ROW = ["rid", "doc_id", "text1", "text2"]
_SIGNED = pa.schema([*((c, pa.int64()) for c in (*_ROW, "n", "set1", "set2")), ("halves", pa.list_(pa.int64())),
                     ("sketch", pa.list_(pa.int64()))])
_SIGNED_DDL = ", ".join(f"{c} long" for c in (*_ROW, "n", "set1", "set2")) + ", halves array<bigint>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    from .shingles import shingle_set

    for batch in batches:
        n, one, two, halves, sketch = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            own = shingle_set(text)
            n.append(len(own))
            name = xxhash.xxh3_128_digest(own.tobytes())
            one.append(int.from_bytes(name[:8], "little", signed=True))
            two.append(int.from_bytes(name[8:], "little", signed=True))
            halves.append(half_keys(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
            sketch.append(bitmap(own))
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, _ROW), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(halves, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], schema=_SIGNED)


def _packed_if(batches: Iterator[pa.RecordBatch], seen) -> Iterator[pa.RecordBatch]:
    """Compressed texts that may be wanted, by a filter of their first hashes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        wanted = batch.filter(pa.array(passes(seen.value, batch.column("text1").to_numpy().view(np.uint64))))
        yield wanted.set_column(2, "text", pa.array(map(squeeze, wanted.column("text").to_pylist()), pa.binary()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .shingles import shingle_set

    for batch in batches:
        own = [shingle_set(t).view(np.int64) for t in unpack(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(own, pa.list_(pa.int64()))], names=["c", "shingles"])


def _meeting(classes: DataFrame) -> DataFrame:
    """``(c, text1, text2, about, weight, left)``: the classes that share half
    keys of either side with others, and the keys they share. ``weight``
    counts what a class shares."""
    halves = classes.select("c", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    own = (halves.join(shared, "half").groupBy("c")
           .agg(F.collect_list(F.struct("place", "half")).alias("own"), F.sum("times").alias("weight")))

    def side(keep):
        return F.transform(F.filter("own", keep), lambda x: x["half"])
    left, right = side(lambda x: x["place"] < HALVES), side(lambda x: x["place"] >= HALVES)
    about = F.named_struct(F.lit("n"), F.col("n"), F.lit("sketch"), F.col("sketch"), F.lit("right"), right)
    return (own.where((F.size(left) > 0) & (F.size(right) > 0)).join(classes.select("c", "text1", "text2", "n", "sketch"), "c")
            .select("c", "text1", "text2", about.alias("about"), "weight", left.alias("left")))


def _comparable(a: Column, b: Column) -> Column:
    """With an equal left half key: whether an equal right one makes it an
    equal table key, and whether the bitmaps allow the similarity. The sets
    share at most what either has without the bits that the other lacks."""
    def most(x, y):
        lacks = F.zip_with(x["sketch"], y["sketch"], lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return x["n"] - F.aggregate(lacks, F.lit(0), lambda done, bits: done + bits)
    needed = F.lit(SIMILAR) * (a["n"] + b["n"])
    return ((F.lit(100) * F.least(a["n"], b["n"]) >= F.lit(SIMILAR) * F.greatest(a["n"], b["n"]))
            & (F.lit(100 + SIMILAR) * most(a, b) >= needed) & (F.lit(100 + SIMILAR) * most(b, a) >= needed)
            & F.arrays_overlap(a["right"], b["right"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    # only the sets that are asked for are shuffled
    one, two = (sets.join(pairs.select(F.col(side).alias("c")).distinct(), "c", "left_semi")
                .select(F.col("c").alias(side), F.col("shingles").alias(out)) for side, out in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(one, "a").join(two, "b").withColumn("both", both)
            .where(F.lit(100) * F.col("both") >= F.lit(SIMILAR) * (F.size("x") + F.size("y") - F.col("both")))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_id: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, stays)`` for each row; with
    the name of a column that numbers the rows, that column as well."""
    rid = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    whole = text_or_empty(text)
    rows = docs.select(rid.alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), whole).alias("text1"),
                       F.xxhash64(F.lit(2), whole).alias("text2"), whole.cast("binary").alias("text"))
    signed = pin(rows.mapInArrow(_sign, _SIGNED_DDL), "near_dups")
    # a class is the row that names it, with all it needs from there on
    low = F.struct(F.col("doc_id").isNull(), "doc_id", "text1", "rid")
    classes = pin(signed.where("n > 0").groupBy("set1", "set2").agg(
        F.min(low).alias("low"), F.min_by(F.struct("rid", "text1", "text2", "n", "halves", "sketch"), "rid").alias("one"))
        .select("set1", "set2", "low", F.col("one.rid").alias("c"), "one.text1", "one.text2", "one.n", "one.halves",
                "one.sketch"), "near_dups")
    meeting = pin(_meeting(classes), "near_dups")
    buckets = meeting.select(F.explode("left").alias("bucket"), "c", "about", "weight")

    # their sets, fetched once for all rounds; equal texts are one before they are joined
    seen = bloom(meeting, "text1")
    texts = (rows.select("text1", "text2", "text").mapInArrow(partial(_packed_if, seen=seen), "text1 long, text2 long, text binary")
             .groupBy("text1", "text2").agg(F.first("text").alias("text")))
    sets = pin(texts.join(meeting.select("c", "text1", "text2"), ["text1", "text2"]).select("c", "text")
               .mapInArrow(_sets, "c long, shingles array<bigint>"), "near_dups")
    found = link_buckets(buckets, _comparable, lambda pairs: _verified(pairs, sets))
    own = classes.select("set1", "set2", "c", "low")
    named = own.withColumnRenamed("low", "stays")
    if found is not None:
        linked = own.join(found.withColumnRenamed("id", "c"), "c")
        lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
        named = (own.join(linked.join(lowest, "component").select("c", "lowest"), "c", "left")
                 .withColumn("stays", F.coalesce("lowest", "low")))
    named = named.select("set1", "set2", F.col("stays.doc_id").alias("component_id"), F.col("stays.rid").alias("first"))
    shown = ("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
             (F.col("rid") == F.col("first")).alias("stays"), *([] if row_id is None else [F.col("rid").alias(row_id)]))
    alone = signed.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("first", F.col("rid"))
    return (signed.where("n > 0").select("rid", "doc_id", "n", "set1", "set2").join(named, ["set1", "set2"]).select(*shown)
            .unionByName(alone.select(*shown)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
