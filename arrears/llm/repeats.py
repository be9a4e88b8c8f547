"""Operator 1: removal of repeated substrings by distributed prefix doubling.

A byte is removed if a string of LENGTH bytes that covers it also starts
somewhere else, in the same document or in another. Strings lie within one
document and are judged on the input.

Sorting all positions would move many times the corpus. The doubling runs on
sampled positions instead, so chosen that none is missed: every window of
LENGTH bytes is ranked by the anchor it holds, the position whose first CORE
bytes have the smallest hash (the leftmost of equals). Equal windows have
their anchors at the same place. Neighbouring windows with one anchor form a
run, so that there are about 2 / (LENGTH - CORE) runs a byte.

1. In a task, ranks of 1, 2, 4, ... CORE bytes come from pairs of ranks at
   growing offsets; Spark groups the runs by the rank of their anchors. A run
   whose anchor is unique is done: none of its windows repeats.
2. Runs are ranked by their whole extent, offset by offset. Where all runs of
   an anchor are equal, all their windows repeat, and they are done too.
3. Runs that share an anchor but differ are ranked again at a greater length,
   half way to LENGTH, in halves; halves that are unique at it are done.
4. What is left is ranked at the full LENGTH, window by window, one
   representative standing for all equal runs.

Then the spans of each document are put together and joined to its text.

A null text counts as empty: nothing is removed from it. A null id is an id
like any other, and repeated rows are documents of their own that repeat each
other. Texts may be of any length. An empty table gives an empty one. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

from .common import bloom, packed, passes, table, text_or_empty, unpack

LENGTH, CORE = 200, 64
#: window starts per block in the second ranking
BLOCK = 8
#: bytes of text handled at a time in a task, and windows of a longer text
GROUP = 1 << 19
SEGMENT = 1 << 21

_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                                0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F,
                                0xE7037ED1A0B428DB)]


def _pair(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """The rank of two ranks that stand side by side."""
    out = left >> np.uint64(29)
    out ^= left
    out *= _STEP[k % len(_STEP)]
    out += right
    return out


def ranks(flat: np.ndarray, length: int) -> np.ndarray:
    """The rank (a 64-bit hash) of the ``length`` bytes from each position,
    by prefix doubling: of 1 byte, 2, 4, ..., the last step overlapping."""
    rank, have = _BYTE[flat], 1
    while have < length:
        step = min(have, length - have)
        rank = _pair(rank[:len(rank) - step], rank[step:], have.bit_length() if step == have else 8)
        have += step
    return rank


def anchors(core: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` positions in a row, the one of smallest rank."""
    n = len(core) - width + 1
    out = np.empty(max(n, 0), np.int64)
    chunk = (1 << 16) - width
    for lo in range(0, n, chunk):
        part = core[lo:lo + chunk + width - 1] & np.uint64(0xFFFFFFFFFFFF0000)
        part |= np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            part = np.minimum(part[:len(part) - step], part[step:])
            have += step
        out[lo:lo + len(part)] = (part & np.uint64(0xFFFF)).astype(np.int64) + lo
    return out


def core_of(length: int) -> int:
    """The length at which anchors are ranked."""
    return min(CORE, length // 3)


def runs(texts: list[bytes], length: int = LENGTH):
    """All runs of the texts: (index of the text, start, number of windows,
    rank of the anchor, rank of the extent)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    core_length = core_of(length)
    core = ranks(flat, core_length)
    anchor = anchors(core, length - core_length + 1)
    doc = np.repeat(np.arange(len(texts)), sizes)
    last = (starts + sizes - length)[doc[:len(anchor)]]
    at = np.arange(len(anchor))
    valid = np.flatnonzero(at <= last)
    if not len(valid):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = anchor[valid]
    new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(doc[valid], prepend=-1) != 0))
    lo = valid[new]
    n = np.diff(np.append(new, len(valid)))
    key = core[own[new]]
    end = lo + n - 1 + length - core_length
    extent = _pair(core[lo], n.astype(np.uint64), 0)
    span = int(n.max()) + length if len(n) else 0
    for j in range(core_length, span, core_length):
        extent = _pair(extent, core[np.minimum(lo + j, end)], 1 + j // core_length)
    extent = _pair(extent, (own[new] - lo).astype(np.uint64), 7)
    return doc[lo], lo - starts[doc[lo]], n, key, extent


def segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (index, offset, bytes) of about GROUP bytes in all. A text of
    more than SEGMENT windows comes in several that overlap by ``length - 1``
    bytes, so that each window is in one."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t if len(t) <= SEGMENT else t[lo:lo + SEGMENT + length - 1]
            group.append((i, lo, part))
            size += len(part)
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


_RUNS = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("at", pa.int32()), ("n", pa.int32()),
                   ("anchor", pa.int64()), ("extent", pa.int64())])
_RUNS_DDL = "doc_id long, row binary, at int, n int, anchor long, extent long"


def _find_runs(batches: Iterator[pa.RecordBatch], seen=None, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The runs of each row's text; of those whose anchor may repeat, if a
    filter is given."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for group in segments(texts, length):
            part, at, n, key, extent = runs([t for _, _, t in group], length)
            doc = np.array([i for i, _, _ in group], np.int64)[part]
            at = at + np.array([lo for _, lo, _ in group], np.int64)[part]
            if seen is not None:
                keep = passes(seen.value, key)
                doc, at, n, key, extent = doc[keep], at[keep], n[keep], key[keep], extent[keep]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(at.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(extent.view(np.int64))],
                schema=_RUNS)


def _contents(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that each wanted run of a document spans."""
    for batch in batches:
        for raw, wanted in zip(unpack(batch.column("text")), batch.column("wanted"), strict=True):
            rows = wanted.as_py()
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array([w["anchor"] for w in rows], pa.int64()),
                "extent": pa.array([w["extent"] for w in rows], pa.int64()),
                "copies": pa.array([w["copies"] for w in rows], pa.int64()),
                "bytes": pa.array([raw[w["at"]:w["at"] + w["n"] + length - 1] for w in rows], pa.binary())})


def blocks(contents: list[bytes], length: int = LENGTH):
    """The blocks of some runs: up to BLOCK windows with the same distance to
    the anchor, rounded down. Gives (index of the run, first window, number of
    windows, rank of the bytes all windows of the block share, rank of its
    extent) and the rank of every window with each block's offset in them."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    n = sizes - length + 1
    offset = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(contents) + bytes(BLOCK), np.uint8)
    lead = anchors(ranks(flat, core_of(length)), length - core_of(length) + 1)[offset] - offset
    run = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    block = (lead[run] - i) // BLOCK
    new = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    run1, i1, block1 = run[new], i[new], block[new]
    m = np.diff(np.append(new, len(run)))
    shared = ranks(flat, length - BLOCK + 1)
    core = _pair(shared[(offset + lead)[run1] - BLOCK * block1], block1.astype(np.uint64), 1)
    whole = ranks(flat, length)
    window = whole[(offset[run] + i)]
    place = (lead[run1] - i1 - BLOCK * block1).astype(np.uint64)
    extent = _pair(_pair(window[new], window[new + m - 1], 2), place * np.uint64(2 * BLOCK) + m.astype(np.uint64), 3)
    return run1, i1, m, core, extent, window, new


_BLOCKS = pa.schema([("anchor", pa.int64()), ("extent", pa.int64()), ("copies", pa.int64()), ("first", pa.int32()),
                     ("m", pa.int32()), ("core", pa.int64()), ("hull", pa.int64()), ("windows", pa.list_(pa.int64()))])
_BLOCKS_DDL = ("anchor long, extent long, copies long, first int, m int, core long, hull long, windows array<bigint>")


def _find_blocks(batches: Iterator[pa.RecordBatch], seen=None, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        run, first, m, core, hull, window, new = blocks(batch.column("bytes").to_pylist(), length)
        ends = new + m
        if seen is not None:
            keep = np.flatnonzero(passes(seen.value, core))
            run, first, m, core, hull, new, ends = (x[keep] for x in (run, first, m, core, hull, new, ends))
        take = pa.array(run)
        inside = np.repeat(new, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)),
                                         pa.array(window[inside].view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in ("anchor", "extent", "copies")), pa.array(first.astype(np.int32)),
             pa.array(m.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), lists],
            schema=_BLOCKS)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, text)`` with the text as bytes. ``row`` tells rows
    with one id apart by 128 bits of their texts, unless they are equal in both."""
    whole = text_or_empty(text).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(whole)).alias("row"), whole.alias("text"))


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of window starts that repeat: ``(doc_id, row, at, parts)`` for
    each run with any, ``parts`` being its (first window, number) pairs."""
    all_runs = rows.mapInArrow(partial(_find_runs, length=length), _RUNS_DDL)
    again = pin(all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeats")
    some = rows.mapInArrow(partial(_find_runs, seen=bloom(again, "anchor"), length=length), _RUNS_DDL)
    some = pin(some, "repeats")

    # equal runs, and anchors whose runs are not all equal
    kinds = pin(some.groupBy("anchor", "extent").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row", "at", "n")).alias("one")), "repeats")
    unlike = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    wanted = (kinds.join(unlike, "anchor").groupBy("one.doc_id", "one.row")
              .agg(F.collect_list(F.struct("anchor", "extent", "copies", "one.at", "one.n")).alias("wanted")))
    contents = (packed(rows).alias("d").join(wanted.alias("w"), _same("d", "w")).select("d.text", "w.wanted")
                .mapInArrow(partial(_contents, length=length), "anchor long, extent long, copies long, bytes binary"))
    contents = pin(contents, "repeats")

    # blocks of the representatives, at the greater length
    every = contents.mapInArrow(partial(_find_blocks, length=length), _BLOCKS_DDL)
    again = pin(every.groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1").select("core"), "repeats")
    some_blocks = pin(contents.mapInArrow(partial(_find_blocks, seen=bloom(again, "core"), length=length), _BLOCKS_DDL), "repeats")
    cores = pin(some_blocks.groupBy("core").agg(F.sum("copies").alias("n"), (F.min("hull") == F.max("hull")).alias("alike"))
                .where("n > 1").select("core", "alike"), "repeats")
    alike = some_blocks.join(cores.where("alike"), "core").select("anchor", "extent", "copies", F.col("first").alias("i"), "m")

    # single windows of the rest, at the full length
    windows = (some_blocks.join(cores.where("not alike"), "core")
               .select("anchor", "extent", "copies", "first", F.posexplode("windows").alias("k", "window")))
    twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    single = windows.join(twice, "window").select("anchor", "extent", "copies", (F.col("first") + F.col("k")).alias("i"),
                                                  F.lit(1).alias("m"))

    parts = (alike.unionAll(single).where("copies = 1").groupBy("anchor", "extent")
             .agg(F.collect_list(F.struct("i", "m")).alias("parts")))
    full = kinds.where("copies > 1").select("anchor", "extent", F.array(F.struct(F.lit(0).alias("i"), F.col("one.n").alias("m"))).alias("parts"))
    return some.join(full.unionAll(parts), ["anchor", "extent"]).select("doc_id", "row", "at", "parts")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by (start, end) pairs."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for raw, found in zip(unpack(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            spans = merged([(f["at"] + p["i"], f["at"] + p["i"] + p["m"] - 1 + length)
                            for f in found or () for p in f["parts"]])
            kept = b"".join([raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)],
                                                      strict=True)])
            for k, v in zip(rows, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                                   [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                rows[k].append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
             pa.array(rows["n_spans"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()),
             pa.array(rows["spans"], span), *([pa.array(rows["kept"], pa.binary())] if with_bytes else [])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_bytes])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per document: its bytes, what is removed of them, the removed spans
    and the digest of what is kept (and, if wanted, the kept bytes, which
    need not be whole characters)."""
    rows = keyed(docs, doc_id, text)
    found = (repeated_windows(rows, length).groupBy("doc_id", "row")
             .agg(F.collect_list(F.struct("at", "parts")).alias("found")))
    return (packed(rows).alias("d").join(found.alias("f"), _same("d", "f"), "left").select("d.doc_id", "d.text", "f.found")
            .mapInArrow(partial(_cut, length=length, with_bytes=with_bytes),
                        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                        "spans array<struct<start:bigint,end:bigint>>" + ", kept binary" * with_bytes))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
