"""Operator 3: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (its lines; an empty text has
none). Each paragraph is hashed to a wide vector and the vectors are added,
every lane modulo a power of two. So the order of paragraphs does not count,
equal multisets have equal fingerprints, and a paragraph is inserted or
deleted by adding or subtracting its vector, without the rest of the text.

The vector has two kinds of lanes. EQUAL lanes of 64 bits come from one
cryptographic digest of the paragraph and decide equality. LIKE lanes of 16
bits hold the paragraph's byte shingles, each counted up or down in one lane
by its hash; the scalar product of two such sums estimates that of the two
multisets of shingles, which gives the likeness: 1 for equal fingerprints,
else the estimated cosine, held between 0 and 1.

Null texts count as empty. Two empty texts are equal (likeness 1); an empty
one and another have likeness 0. A multiset that counts one shingle more than
32,767 times wraps in its LIKE lane: likeness is then unreliable, equality is
not. Texts may be of any length. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slots, table, text_or_empty

EQUAL, LIKE, SHINGLE = 8, 256, 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE, np.int64) if like is None else like

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def lanes(self) -> np.ndarray:
        """The LIKE lanes modulo 2**16, as signed numbers."""
        return self.like.astype(np.uint64).astype("<u2").view("<i2")

    def text(self) -> str:
        return base64.b64encode(self.equal.astype("<u8").tobytes() + self.lanes().tobytes()).decode()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if (a.equal == b.equal).all():
        return 1.0
    x, y = a.lanes().astype(np.float64), b.lanes().astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return float(min(1.0, max(0.0, (x @ y) / norm))) if norm else 0.0


def fingerprint(text: str) -> Fingerprint:
    """The fingerprint of all paragraphs of a text."""
    if not text:
        return Fingerprint()
    raw = text.encode("utf-8", "surrogatepass")
    parts = raw.split(b"\n")
    equal = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in parts]), "<u8").reshape(-1, EQUAL)
    short = [p.ljust(SHINGLE, b"\0") for p in parts if len(p) < SHINGLE]
    grams = _shingles(raw)
    if short:
        grams = np.concatenate([grams, _shingles(b"\n".join(short))])
    slot = (grams >> np.uint64(55)).astype(np.int64)
    counts = np.bincount(slot, minlength=2 * LIKE).reshape(LIKE, 2)
    return Fingerprint(equal.sum(axis=0, dtype=np.uint64), counts[:, 0] - counts[:, 1])


def _shingles(raw: bytes) -> np.ndarray:
    """Hashes of all windows of SHINGLE bytes that hold no line break."""
    n = len(raw) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n + 8,), "<u8", raw, strides=(1,))
    h = words[:n] * _A ^ (words[8:] * _B >> np.uint64(7))
    h = (h ^ (h >> np.uint64(31))) * _C
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    if len(breaks):
        clear = np.ones(n, bool)
        for at in breaks.tolist() if len(breaks) < 64 else ():
            clear[max(0, at - SHINGLE + 1):at + 1] = False
        if len(breaks) >= 64:
            seen = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) == 10)])
            clear = seen[SHINGLE:] == seen[:n]
        h = h[clear]
    return h


def edited(text: str, successor: str) -> str:
    """The text with its last half replaced by as much of its successor."""
    half = len(text) // 2
    return text[:len(text) - half] + successor[:half]


def replace_tail(own: Fingerprint, text: str, new: str, kept: int) -> Fingerprint:
    """The fingerprint of ``new``, which shares its first ``kept`` code points
    with ``text``: the paragraphs from there on are deleted and inserted."""
    start = text.rfind("\n", 0, kept) + 1
    if start == 0:
        return fingerprint(new)
    return own - _tail(text, start) + _tail(new, start)


def _tail(text: str, start: int) -> Fingerprint:
    """Of the paragraphs from ``start`` on, of which there is one at least."""
    if start < len(text):
        return fingerprint(text[start:])
    empty = Fingerprint(np.frombuffer(hashlib.blake2b(b"").digest(), "<u8").copy())
    empty.like = fingerprint("\n").like // 2
    return empty


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the row that follows it in its bucket. Holds one row
    besides the batch."""
    before = None  # (bucket, doc_id, text, fingerprint)
    for batch in batches:
        rows = []
        for bucket, follows, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = fingerprint(text)
            if before is not None and before[0] == bucket:
                rows.append(_row(*before[1:], text, own))
            before = None if follows else (bucket, doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT]),
                                             schema=_SCHEMA, preserve_index=False)


def _row(doc_id, text, own, next_text, next_own):
    new = edited(text, next_text)
    changed = replace_tail(own, text, new, len(text) - len(text) // 2)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.text(),
            changed.text(), likeness(own, changed), likeness(own, next_own))


RESULT = ["doc_id long", "n_chars long", "edited_sha256 string", "fingerprint string",
          "edited_fingerprint string", "near_edited double", "near_next double"]
_SCHEMA = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[
    c.split(" ")[1]]) for c in RESULT])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text (see ``edited``;
    the successor is the next document by descending id, after the last the
    first) and their likeness.

    Ids are cut into as many ranges as the session has shuffle partitions,
    and whole texts are dealt out once, by range. The first document of each
    range is dealt to the range before too, where it follows the last one.
    Null ids come last; equal ids are ordered by their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    n = slots(spark)
    cuts = np.unique(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) or [0.0]).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(cuts) + 1, np.int32)
        out[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    # one row for each range: its first id
    heads = (rows.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket")
             .agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect())
    if not heads:
        return spark.createDataFrame([], ", ".join(RESULT))
    before = [(h.doc_id, heads[k - 1].bucket) for k, h in enumerate(heads)]
    firsts = spark.createDataFrame(before, "head_id long, bucket int")
    first_rows = (rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("head_id")))
                  .groupBy("bucket", "doc_id").agg(F.min("text").alias("text")))
    dealt = (rows.select(bucket("doc_id").alias("bucket"), F.lit(False).alias("follows"), "doc_id", "text")
             .unionByName(first_rows.select("bucket", F.lit(True).alias("follows"), "doc_id", "text")))
    ordered = (dealt.repartitionById(len(cuts) + 2, F.col("bucket"))
               .sortWithinPartitions("bucket", "follows", F.desc_nulls_last("doc_id"), "text")
               .select("bucket", "follows", "doc_id", "text"))
    return ordered.mapInArrow(_compare, ", ".join(RESULT))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
