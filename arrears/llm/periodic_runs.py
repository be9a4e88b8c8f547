"""Operator 12: periodic runs of words, by maximal pairs.

A run is a stretch of consecutive words with smallest period q and length
max(LEAST, 2 q) or more that no neighbouring word extends keeping q. Two
occurrences of the same words, q apart, that neither end can extend form a
maximal pair; with a common part of at least q words the pair covers exactly
a stretch of period q that cannot be extended. So the maximal pairs whose
distance is no more than their common part are the runs, without extending
anything. A stretch is found once for each multiple of its period; the
smallest stays.

The pairs are read off the tree of LCP intervals of the text's suffix array,
bottom-up. A node is the set of places where its ``lcp`` words stand, held in
order and as one list for each word to the left. Joining a child looks, for
each place of the smaller side, only at places of the larger side that are at
most ``lcp`` away and follow another word; a stretch of places after the same
word is leapt over. What is met is emitted, and a text of n words has O(n)
such pairs, so the work is O(n log^2 n) however often words repeat. Runs have
a common part of LEAST / 2 words or more, so the tree starts there: suffixes
are ranked by prefix doubling from that length on, only among those still
tied, for many documents at a time.

A run lies in one document, so documents need no shuffle: a task holds about
GROUP words at a time, or one whole text if that is longer. Texts may be of
any length and are never cut.

Null, empty and blank texts have no words and no runs; their collapsed text
is empty. A null id is a row like any other; repeated rows are rows of their
own. Of runs of equal length the first is the longest, of those the one with
the smallest period. An empty table gives an empty one. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: words a run has at least
LEAST = 12
#: words that a task ranks at a time
GROUP = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal words equal ones, a number of
    its own behind each text; and where each text starts."""
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for words in texts for w in (*words, None)]
    starts = np.cumsum([0] + [len(words) + 1 for words in texts])
    ids = np.array(flat, np.int64)
    ids[starts[1:] - 1] = len(known) + np.arange(len(texts))
    return ids, starts


def may_repeat(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which texts may hold the same ``length`` words twice: all that do, by
    a hash, and hardly any other."""
    n = len(ids) - length + 1
    if n < 2:
        return np.zeros(len(starts) - 1, bool)
    word = ids.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    word ^= word >> np.uint64(32)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    h = text.astype(np.uint64)
    for j in range(length):
        h = (h ^ h >> np.uint64(31)) * _ODD[j % len(_ODD)] + word[j:j + n]
    order = np.argsort(h, kind="stable")
    twice = order[1:][h[order[1:]] == h[order[:-1]]]
    out = np.zeros(len(starts) - 1, bool)
    out[text[twice]] = True
    return out


def _pairs_ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of small numbers: equal pairs equal ranks."""
    return np.unique(first * (second.max() + 1) + second, return_inverse=True)[1].ravel()


def tied_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share ``least`` words or more with another one, in
    suffix order, and the common words of each with the one before it (0 if
    fewer than ``least``). The last number must occur once."""
    n = len(ids)
    small = [(1, np.unique(ids, return_inverse=True)[1].ravel())]
    while 2 * small[-1][0] <= least:
        step, rank = small[-1]
        small.append((2 * step, _pairs_ranked(rank, np.append(rank[step:], np.zeros(step, np.int64)))))
    # the first rank covers `least` words, made of two parts that overlap or meet
    step, rank = small[-1]
    if step < least:
        rank = _pairs_ranked(rank, np.append(rank[least - step:], np.zeros(least - step, np.int64)))
    # a rank is the place of the first of its equals, so it stays while others are refined
    order = np.argsort(rank, kind="stable")
    new = np.append(True, rank[order[1:]] != rank[order[:-1]])
    place = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = place
    size = np.bincount(place, minlength=n)
    active = order[size[place] > 1]
    held, length, levels = active, least, []
    while len(active):
        levels.append((length, rank.copy()))
        after = rank[active + length]
        order = np.lexsort((after, rank[active]))
        active, after = active[order], after[order]
        own = rank[active]
        first = np.append(True, own[1:] != own[:-1])
        new = first | np.append(True, after[1:] != after[:-1])
        at = np.arange(len(active))
        rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        edge = np.append(np.flatnonzero(new), len(active))
        active = active[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        length *= 2
    held = held[np.argsort(rank[held], kind="stable")]
    common = np.zeros(len(held), np.int64)
    if len(held) > 1:
        x, y = held[:-1].copy(), held[1:].copy()
        for length, ranks in [*reversed(levels), *reversed(small)]:
            same = ranks[x] == ranks[y]
            x[same] += length
            y[same] += length
        common[1:] = x - held[:-1]
        common[common < least] = 0
    return held, common


class Places:
    """Places of one node: all in order, and in order for each word to the left."""

    __slots__ = ("all", "after")

    def __init__(self, place: int, left: int) -> None:
        self.all = [place]
        self.after = {left: [place]}

    def partners(self, place: int, left: int, near: int) -> list[int]:
        """The places at most ``near`` away that follow another word."""
        held = self.all
        lo, hi = bisect_left(held, place - near), bisect_right(held, place + near)
        own = self.after.get(left)
        if own is None or lo == hi:
            return held[lo:hi]
        k, k_end = bisect_left(own, place - near), bisect_right(own, place + near)
        if k_end - k == hi - lo:
            return []
        out = []
        while lo < hi:
            if k == k_end:
                return out + held[lo:hi]
            until = bisect_left(held, own[k], lo, hi)
            out += held[lo:until]
            # as long as both lists agree, all follow the same word
            few, many = 1, min(hi - until, k_end - k)
            while few < many:
                half = (few + many + 1) // 2
                if held[until + half - 1] == own[k + half - 1]:
                    few = half
                else:
                    many = half - 1
            lo, k = until + few, k + few
        return out

    def add(self, other: Places) -> None:
        for place in other.all:
            insort(self.all, place)
        for left, places in other.after.items():
            mine = self.after.get(left)
            if mine is None:
                self.after[left] = places
            else:
                for place in places:
                    insort(mine, place)


def maximal_pairs(held: np.ndarray, common: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(start, distance, common words)`` of the maximal pairs whose distance
    is at most their common words: the interval tree bottom-up."""
    if not len(held):
        return
    before = ids[held - 1]
    before[held == 0] = -1
    places, lefts, heights = held.tolist(), before.tolist(), [*common.tolist()[1:], 0]
    open_heights: list[int] = []
    open_nodes: list[Places] = []
    met: list[tuple[int, int, int]] = []

    def join(x: Places, y: Places, height: int) -> Places:
        if len(x.all) < len(y.all):
            x, y = y, x
        for left, own in y.after.items():
            for place in own:
                for other in x.partners(place, left, height):
                    met.append((min(place, other), abs(place - other), height))
        x.add(y)
        return x

    for place, left, height in zip(places, lefts, heights, strict=True):
        node = Places(place, left)
        while open_heights and open_heights[-1] > height:
            node = join(open_nodes.pop(), node, open_heights.pop())
        if height:
            if open_heights and open_heights[-1] == height:
                open_nodes[-1] = join(open_nodes[-1], node, height)
            else:
                open_heights.append(height)
                open_nodes.append(node)
        elif open_heights:
            raise AssertionError("an interval stayed open")
        if met:
            yield from met
            met.clear()


def runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each text, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    shared = max(1, least // 2)  # length = common + period, and the period is at most the common part
    at = np.flatnonzero(may_repeat(*numbers(texts), shared))
    if not len(at):
        return out
    ids, starts = numbers([texts[k] for k in at])
    period: dict[tuple[int, int], int] = {}
    for start, distance, common in maximal_pairs(*tied_suffixes(ids, shared), ids):
        if common + distance >= least:
            stretch = (start, common + distance)
            if distance < period.get(stretch, distance + 1):
                period[stretch] = distance
    found = sorted((start, length, q) for (start, length), q in period.items())
    text = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    for k, (start, length, q) in zip(text.tolist(), found, strict=True):
        out[at[k]].append((start - int(starts[k]), length, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


_FOUND = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch], least: int, edit: Edit | None) -> Iterator[pa.RecordBatch]:
    def flush(ids, texts):
        found = runs(texts, least)
        numbers = np.array([x for r in found for run in r for x in run], np.int64).reshape(-1, 3)
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0] + [len(r) for r in found]), pa.int32()),
            pa.StructArray.from_arrays([pa.array(numbers[:, k].copy()) for k in range(3)], fields=list(_RUNS.value_type)))
        kept = [b" ".join(collapsed(w, r)).decode("utf-8", "replace") for w, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(kept, pa.string())],
                                          names=["doc_id", "runs", "collapsed"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = text.as_py().split()  # bytes: cut at 20 and 09 to 0D
            ids.append(doc_id)
            texts.append(words if edit is None else edit(doc_id, words))
            size += len(words)
            if size >= GROUP:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, runs, collapsed)`` for each row: the runs
    ``(start, length, period)`` in words, and the text without the words that
    a run repeats, joined by spaces. ``edit`` may change a document's words
    before they are searched."""
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
            .mapInArrow(partial(_find, least=least, edit=edit), _FOUND))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's input: of one document in ten the words from some place on
    become periodic. A null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("longest", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                    (-F.col("longest.before")).alias("start"), F.col("longest.length").alias("length"),
                    (-F.col("longest.shorter")).alias("period"),
                    F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
                    F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


OP12_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(4294967295, list_reduce(
           [4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                                    lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM documents),
cut AS (
  SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS edits, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM docs),
texts AS (
  SELECT rid, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN edits AND i >= a
                                                                  THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) AS w
  FROM cut),
grams AS (
  SELECT rid, n, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT rid, n, w, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12)),
equal AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.rid = y.rid AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM equal) GROUP BY rid, q, island),
runs AS (
  SELECT rid, start, length, min(q) AS period FROM stretches WHERE length >= 12 AND length >= 2 * q GROUP BY rid, start, length),
listed AS (
  SELECT rid, list({'start': start, 'length': length, 'period': period} ORDER BY start, period) AS runs,
         list({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period)[1] AS longest
  FROM runs GROUP BY rid),
gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT t.rid, string_agg(t.word, ' ' ORDER BY t.i) AS text
  FROM (SELECT rid, unnest(range(n)) AS i, unnest(w) AS word FROM texts WHERE rid IN (SELECT rid FROM runs)) t
  ANTI JOIN gone g ON t.rid = g.rid AND t.i = g.i GROUP BY t.rid)
SELECT t.doc_id::BIGINT AS doc_id, coalesce(len(l.runs), 0)::BIGINT AS n_runs, l.longest.start::BIGINT AS start,
       l.longest.length::BIGINT AS length, l.longest.period::BIGINT AS period,
       (1000 * l.longest.length // l.longest.period)::BIGINT AS exponent_milli,
       sha256(coalesce(array_to_string(list_transform(l.runs, lambda r: concat(r.start, ',', r.length, ',', r.period, chr(10))), ''), '')) AS runs_sha256,
       sha256(CASE WHEN l.rid IS NULL THEN array_to_string(t.w, ' ') ELSE coalesce(k.text, '') END) AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON t.rid = l.rid LEFT JOIN kept k ON t.rid = k.rid
"""
