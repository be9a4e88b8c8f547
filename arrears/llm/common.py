"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

#: a word: a maximal run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, in a session set up for whole texts."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Holds the Arrow batches of this session to ``rows`` rows and ``size``
    bytes: both the JVM and the Python worker keep a batch of whole texts
    outside the heap. Results do not depend on it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slots(spark: SparkSession) -> int:
    """Partitions a keyed shuffle is dealt to: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str) -> str:
    """A column name no input column is likely to have."""
    return f"__{name}_{next(_serial)}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bloom(keys: DataFrame, key: str, most_bits: int = 1 << 27):
    """A Bloom filter over a column of uniform 64-bit hashes, as a broadcast
    of at most ``most_bits`` bits (16 MB). With more keys it lets more pass;
    it only spares shuffles, and an exact join or count follows it."""
    n = keys.count()
    bits = min(most_bits, 1 << max(12, int(np.ceil(np.log2(12 * n + 1)))))
    level = bits.bit_length() - 1
    at = F.explode(F.array(F.shiftrightunsigned(key, 64 - level),
                           F.shiftrightunsigned(key, 20).bitwiseAND(F.lit(bits - 1)),
                           F.col(key).bitwiseAND(F.lit(bits - 1))))
    words = (keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow())
    filled = np.zeros(bits // 64, np.int64)
    filled[words["word"].to_numpy()] = words["mask"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(filled.view(np.uint64))


def passes(filled: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys may be in the filter."""
    bits = len(filled) * 64
    level = np.uint64(64 - (bits.bit_length() - 1))
    ok = np.ones(len(key), bool)
    for at in (key >> level, (key >> np.uint64(20)) & np.uint64(bits - 1), key & np.uint64(bits - 1)):
        ok &= (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the binary column ``text`` compressed, for a shuffle of
    whole texts; ``unpack`` reverses it."""
    names = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(map(squeeze, batch.column(at).to_pylist()), pa.binary()))

    return rows.select(*names).mapInArrow(pack, rows.schema)


def unpack(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist())


#: edges that one task contracts at a time
CHUNK = 1_000_000


def components(links: DataFrame, chunk: int = CHUNK, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``, a written table, as another,
    ``(id, component)``, the component being the smallest id reachable. Ids
    that stand in no link are absent; an empty table of links gives an empty
    result.

    First every task contracts its own chunk of at most about ``chunk`` edges:
    each vertex hangs on the smallest one it reaches inside the chunk. If one
    chunk holds all edges, that is the result. Else rounds of two grouping
    passes over the edges that are left (large star, then small star) hang
    every vertex's larger neighbours, then its smaller ones, on its smallest;
    their number grows with the logarithm of the longest chain of chunks. Each
    round is written as a table, so a lost executor costs one round. A vertex
    with very many neighbours is never gathered there: the smallest neighbour
    comes from a map-side combined ``min`` and is joined back, and AQE splits
    the join.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    chunks = -(-edges.count() // chunk)
    if chunks <= 1:
        return pin(edges.coalesce(1).mapInArrow(_whole, "id long, component long"))
    # coalesce cannot split a file that holds more than one chunk
    hung = pin(edges.repartition(chunks, F.xxhash64("u", "v")).mapInArrow(_contract, "u long, v long"))
    hung = _stars(hung.distinct(), max_rounds)
    return pin(hung.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        hung.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of a chunk of edges with the smallest one it reaches."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(c) for c in zip(*held, strict=True))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[:len(u)], place[len(u):]
    label = np.arange(len(ids))
    while True:
        a, b = label[u], label[v]
        differ = np.flatnonzero(a != b)
        if not len(differ):
            break
        np.minimum.at(label, np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ]))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a chunk that holds all edges, the smallest ones'
    own rows among them."""
    for hung in _contract(batches):
        roots = pc.unique(hung.column("v"))
        yield pa.RecordBatch.from_arrays([hung.column("u"), hung.column("v")], names=["id", "component"])
        yield pa.RecordBatch.from_arrays([roots, roots], names=["id", "component"])


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Large and small stars in turn, until nothing changes."""
    state = None
    for _ in range(max_rounds):
        edges = pin(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == (now.n, now.h):
            return edges
        state = (now.n, now.h)
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    hung = both.join(low, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()
