"""Operator 11: near-duplicate documents by SimHash and multi-index hashing.

A document's fingerprint has a bit where more than half of the XXH64 hashes of
its four-word shingles have it, repeats included. Fingerprints that differ in
at most DIFFER of 64 bits are linked, exactly: no link is missed or guessed.

The 64 bits are cut into two segments. Of 4 differing bits one segment has at
most 2, so the balls of radius 1 around both segments meet in a word. Each
fingerprint enters the table of each segment under the 33 words of its ball;
what meets in a word is a match, and the whole distance is then taken from the
fingerprints themselves. Segments are 32 bits wide, so unlike fingerprints
meet by chance once in 4 million pairs. The first pass writes no fingerprints:
it counts words, and only the members of words met twice are fetched.

Documents with equal fingerprints are one from the start. Members of a word
are never paired with each other in the output: a task links each to the
others it reaches, one row a member. Words with more than MOST members go
another exact way: each of their members enters 2,081 places, the ball of
radius 2 around all 64 bits. Two fingerprints are at most 4 bits apart exactly
if those balls meet, a place has at most 2,081 members, whatever the data, and
each of them is linked to the first. So no group grows with the data, no pair
within a group is written, and there is no cap.

A null or empty text, or one of white space alone, has the fingerprint zero
and is linked like any other. Null ids take part; a component's id is its
smallest id that is not null, or null. Rows with equal ids are rows of their
own. An empty table gives an empty one. Texts may be of any length and are
hashed whole, PART shingles at a time. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

from .common import bloom, components, passes, table, text_or_empty

#: words in a shingle, and the seed of XXH64
WORDS, SEED = 4, 42
BITS, DIFFER = 64, 4
#: a word with more members is linked through places of all 64 bits
MOST = 1024
#: shingles whose bits are counted at a time
PART = 1 << 16
#: rows that hold a fingerprint are looked up by broadcast if it is one of
#: fewer than this many that each hold more than this share of all rows
FREQUENT = 500

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, in order, repeats included."""
    import xxhash

    own = text.translate(_LOWER).split()  # bytes: cut at 20 and 09 to 0D
    if not own:
        return []
    joined = b" ".join(own)
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = (ends[:len(own) - words + 1] - np.fromiter(map(len, own[:len(own) - words + 1]), np.int64) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    each = [shingle_hashes(t) for t in texts]
    count = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((h for own in each for h in own), np.uint64, int(count.sum()))
    ones = np.zeros((len(each), BITS), np.int64)
    owner = np.repeat(np.arange(len(each)), count)
    for lo in range(0, len(flat), PART):
        bits = np.unpackbits(flat[lo:lo + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[lo:lo + PART]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        done = []
        size, part = 0, []
        for text in texts:
            part.append(text.as_py())
            size += len(part[-1])
            if size >= 1 << 20:
                done.append(fingerprints(part))
                size, part = 0, []
        if part:
            done.append(fingerprints(part))
        if done:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(done).view(np.int64))],
                                             names=["doc_id", "fp"])


def ball(width: int, radius: int) -> np.ndarray:
    """What to flip in a word of ``width`` bits to get each word at most
    ``radius`` bits away."""
    masks, edge = [np.zeros(1, np.uint64)], [(0, 0)]
    for _ in range(radius):
        edge = [(m | 1 << b, b + 1) for m, lo in edge for b in range(lo, width)]
        masks.append(np.array([m for m, _ in edge], np.uint64))
    return np.concatenate(masks)


def segment_words(fp: np.ndarray) -> np.ndarray:
    """The table keys of each fingerprint, a row each: its segments with at
    most one bit flipped, mixed so that keys of different tables differ."""
    half = BITS // 2
    near = ball(half, DIFFER // 4)
    low, high = fp & np.uint64((1 << half) - 1), fp >> np.uint64(half)
    # the table is the key's last bit; the mix is one to one on 64 bits
    key = np.concatenate([(low[:, None] ^ near) << np.uint64(1), (high[:, None] ^ near) << np.uint64(1) | np.uint64(1)], axis=1)
    for times in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        key ^= key >> np.uint64(31)
        key *= np.uint64(times)
    return key ^ key >> np.uint64(29)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = segment_words(batch.column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))], names=["word"])


def _members(seen):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys = segment_words(fp.view(np.uint64))
            keep = passes(seen.value, keys.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[keep].view(np.int64)), pa.array(np.repeat(fp, keys.shape[1])[keep])],
                                             names=["word", "fp"])

    return find


def link_few(fp: np.ndarray) -> np.ndarray:
    """For each of a few fingerprints the place of the first one it reaches
    among them, through links."""
    label = np.arange(len(fp))
    for k in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[k:] ^ fp[k]) <= DIFFER) + k
        roots = np.unique(label[near])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            fp = np.sort(members.values.to_numpy())
            label = link_few(fp.view(np.uint64))
            hung = np.flatnonzero(label != np.arange(len(fp)))
            a.append(fp[hung])
            b.append(fp[label[hung]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near = ball(BITS, DIFFER // 2)
    for batch in batches:
        every = batch.column("fp").to_numpy()
        for lo in range(0, len(every), 64):
            fp = every[lo:lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array((fp.view(np.uint64)[:, None] ^ near).ravel().view(np.int64)),
                                              pa.array(np.repeat(fp, len(near)))], names=["place", "fp"])


def near_links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of a written table
    ``distinct(fp)``: not all, but enough that what DIFFER or fewer bits
    connect is connected, and none between others."""
    met = pin(distinct.mapInArrow(_words, "word long").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash")
    members = pin(distinct.mapInArrow(_members(bloom(met, "word")), "word long, fp long").join(met, "word"), "simhash")
    few = (members.where(F.col("n") <= most).groupBy("word").agg(F.collect_list("fp").alias("members"))
           .select("members").mapInArrow(_link, "a long, b long"))
    places = members.where(F.col("n") > most).select("fp").distinct().mapInArrow(_places, "place long, fp long")
    first = places.groupBy("place").agg(F.collect_list("fp").alias("members")).where("size(members) > 1")
    many = (first.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a != b"))
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row; the fingerprint
    is a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    signed = pin(rows.mapInArrow(_sign, "doc_id long, fp long"), "simhash")
    distinct = pin(signed.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash")
    found = components(pin(near_links(distinct.select("fp"), most), "simhash")).withColumnRenamed("id", "fp")
    linked = distinct.join(found, "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
    named = pin(distinct.join(linked.join(lowest, "component").select("fp", "lowest"), "fp", "left")
                .select("fp", "n", F.coalesce("lowest", "low").alias("component_id")), "simhash")
    # a frequent fingerprint's rows stay where they are; there are fewer than FREQUENT of them
    total = signed.count()
    often = F.broadcast(named.where(F.col("n") * FREQUENT > total).select("fp", F.struct("component_id").alias("found")))
    here = signed.join(often, "fp", "left")
    rest = here.where("found is null").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    return (here.where("found is not null").select("doc_id", F.col("fp").alias("fingerprint"), F.col("found.component_id"))
            .unionByName(rest.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")))


def op11_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
