"""Operator 5: removal of near-equal lines by SimHash.

Lines are normalised (lower case, ASCII punctuation as white space, digits as
0, white space collapsed). Two lines are linked if their normalised texts have
an edit similarity (1 - distance / longer length) of SIMILAR or more and they
meet under a key. Of each connected group the first occurrence (smallest
doc_id, then line) stays and all others go.

A line has two fingerprints of BLOCKS blocks, each block the SimHash of some of
its words: in the first those of one stretch of the line (its quarters), in
the second those of one group by the words' hashes. A changed word changes one
block of the first and at most two of the second, an added or missing one
changes one block of the second. So of lines that differ by that little,
two blocks agree by the pigeonhole principle: they meet under each choice of two
blocks (of three, in lines of fewer than SHORT words, where two blocks hold
next to nothing). Found for certain are lines that differ by one word
changed, added or missing, and, from SHORT words on, by two words changed or two
added; of those that differ by more, some. Every pair that meets is verified
by its edit similarity on the whole lines.

The fingerprint of a whole line does not serve: one letter changed in a line of
ten words turns 13 of 64 bits of it, and blocks of so many bits are too short
to tell lines apart.

Equal normalised lines are counted first, so that a line that a third of all
documents hold is one row from there on. Entries whose key no other line has are
dropped by a filter before they are written. Within a bucket lines are paired as
``linking.link_buckets`` says, the most frequent first.

Lines without a letter or digit, empty ones among them, always stay; so a null
or empty text has one empty line and is left as it is. Lines of one word are
linked with equal ones only. Null ids sort first.
Rows with equal ids are rows of their own, in the order of the table: every
row has a number, written once with its text. Texts and lines may be of any length. An empty table gives an
empty one. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

from .common import bloom, fresh, packed, passes, slots, table, text_or_empty, unpack
from .linking import link_buckets
from .word_hashes import word_hashes

BLOCKS, BITS = 4, 16
#: words of a line from which on two blocks make a key, and that a key must hold
SHORT, HELD = 8, {2: 3, 3: 2}
SIMILAR = 0.85
#: texts are hashed in groups of about this many bytes
GROUP = 1 << 19
#: characters after which an edit distance is looked at
STEP = 32

#: line breaks stay, punctuation becomes white space, digits become 0, A-Z lower case
_PLAIN = bytes(10 if b == 10 else 32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else 48 if b < 58
               else b + 32 if b < 91 else b for b in range(256))
#: a byte's bits, each in a byte of its own
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def plain(text: str) -> bytes:
    """A text normalised but for the white space between words, of which
    blanks and line breaks are left."""
    return (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass").translate(_PLAIN)


def normal_lines(text: str) -> list[bytes]:
    """The lines of a text, normalised but for the white space between words."""
    return plain(text).split(b"\n")


def words_of(whole: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Plain lines, a line break before and after each: all their words, each
    with one byte after it, where each begins and ends there, and how many
    each line has."""
    raw = np.frombuffer(whole, np.uint8)
    gap = raw < 48
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    n = np.diff(np.searchsorted(begin, np.flatnonzero(raw == 10)))
    keep = ~gap
    keep[end] = True
    after = np.cumsum(end - begin + 1)
    return raw[keep].tobytes(), after - (end - begin + 1), after - 1, n


def simhashes(spread: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """The SimHash of blocks of ``size`` words, one after the other, 0 if one
    is empty: a bit is set if it is in more than half of the block's hashes,
    whose bits are ``spread`` over bytes, eight in a number."""
    out = np.zeros(len(size), np.uint16)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    count = size[full]
    # up to 255 ones are added in a byte; larger blocks come in several parts
    parts = -(-count // 255)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(count) - count - 255 * first, parts) + 255 * np.arange(parts.sum())
    ones = np.concatenate([np.add.reduceat(x, begin).view(np.uint8).reshape(-1, 8) for x in spread], axis=1)
    ones = np.add.reduceat(ones, first, axis=0, dtype=np.int32) if len(begin) > len(full) else ones.astype(np.int32)
    out[full] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u2").ravel()
    return out


def quarters(n: np.ndarray) -> np.ndarray:
    """How many words each stretch of a line of ``n`` words has."""
    ends = -(-np.arange(BLOCKS + 1) * n[:, None] // BLOCKS)
    return np.diff(ends, axis=1)


def blocks_of(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of ``n`` words each, one or more, the SimHashes of their
    blocks by place and by hash, 16 bits each in one number (0 if a block is
    empty), and how many words each block by hash has (8 bits each, at most
    255)."""
    bits = hashes.view(np.uint8).reshape(-1, 8)
    spread = [_SPREAD[bits[:, k]] for k in range(BITS // 8)]
    near = simhashes(spread, quarters(n).ravel())
    group, begin = bits[:, 7] >> 6, np.cumsum(n) - n
    bag, held = np.zeros((len(n), BLOCKS), np.uint16), np.zeros((len(n), BLOCKS), np.uint8)
    for g in range(BLOCKS):
        own = np.flatnonzero(group == g)
        count = np.diff(np.searchsorted(own, begin), append=len(own))
        bag[:, g] = simhashes([x[own] for x in spread], count)
        held[:, g] = np.minimum(count, 255)
    return near.view("<u8"), bag.view("<u8").ravel(), held.view("<u4").ravel()


def fingerprints(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words its blocks by place and by hash, how many words
    it has, and how many each block by hash has, see ``blocks_of``."""
    data, begin, end, n = words_of(b"\n".join([b"", *map(b" ".join, words), b""]))
    near, bag, held = blocks_of(word_hashes(data, begin, end), n)
    return near, bag, n, held


#: the order of lines' occurrences
PLACE = ("doc_id", "rid", "line")
_LINES = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()),
                    ("h2", pa.int64()), ("near", pa.int64()), ("bag", pa.int64()), ("words", pa.int32()), ("held", pa.int32()),
                    ("length", pa.int32())])
_LINES_DDL = "doc_id long, rid long, line int, h1 long, h2 long, near long, bag long, words int, held int, length int"


def _plain(column: pa.Array) -> Iterator[bytes]:
    """The plain texts of a column of texts, or of ``packed`` ones."""
    if not pa.types.is_binary(column.type):
        yield from map(plain, column.to_pylist())
        return
    for raw in unpack(column):
        yield raw.translate(_PLAIN) if raw.isascii() else plain(raw.decode("utf-8", "replace"))


def _find_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def found(batch, at, texts):
        """The lines of some texts that hold words; ``at`` is the first one's row."""
        data, begin, end, n = words_of(b"\n".join([b"", *texts, b""]))
        lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        full = np.flatnonzero(n)
        if not len(full):
            return
        row = np.repeat(np.arange(len(texts)), lines)[full]
        line = full - (np.cumsum(lines) - lines)[row]
        n = n[full]
        last = np.cumsum(n) - 1
        lo, hi = begin[last - n + 1], end[last]
        if data.isascii():
            length = hi - lo
        else:  # in characters
            more = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 == 0x80)
            length = hi - lo - (np.searchsorted(more, hi) - np.searchsorted(more, lo))
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]),
                              "<i8").reshape(-1, 2)
        near, bag, held = blocks_of(word_hashes(data, begin, end), n)
        take = pa.array(at + row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("rid").take(take), pa.array(line.astype(np.int32)),
             pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(near.view(np.int64)), pa.array(bag.view(np.int64)),
             pa.array(n.astype(np.int32)), pa.array(held.view(np.int32)), pa.array(length.astype(np.int32))], schema=_LINES)

    for batch in batches:
        at, texts, size = 0, [], 0
        for i, text in enumerate(_plain(batch.column("text"))):
            texts.append(text)
            size += len(text)
            if size >= GROUP:
                yield from found(batch, at, texts)
                at, texts, size = i + 1, [], 0
        if texts:
            yield from found(batch, at, texts)


def keys_of(near: np.ndarray, bag: np.ndarray, words: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some lines and whose they are. A key names the blocks it
    is of and how many words they hold, those by place the line's number of
    words too. Keys of blocks that hold few words are left out."""
    key, whose = [], []
    stretch = quarters(words)
    group = held.view(np.uint8).reshape(-1, BLOCKS).astype(np.int64)
    salt = 0
    for k in (2, 3):
        of_length = words < SHORT if k == 3 else words >= SHORT
        # a word more or less may change how many blocks a key has
        either = words <= SHORT if k == 3 else words >= SHORT
        for choice in combinations(range(BLOCKS), k):
            mask = np.uint64(sum(0xFFFF << BITS * c for c in choice))
            for blocks, sizes, fits, extra in ((near, stretch, of_length, words), (bag, group, either, None)):
                salt += 1
                in_key = sizes[:, choice]
                total = in_key.sum(axis=1)
                at = np.flatnonzero(fits & (total >= HELD[k]) & ((total < words) | (extra is None)))
                own = blocks[at] & mask
                for x in (np.full(len(at), salt), *in_key[at].T) if extra is None else (np.full(len(at), salt), extra[at]):
                    own = (own ^ own >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
                own = (own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                key.append(own ^ own >> np.uint64(32))
                whose.append(at)
    return np.concatenate(key), np.concatenate(whose)


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches joined to some of about ``rows`` rows."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if n >= rows or batch is None and n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
        if batch is not None:
            held.append(batch)
            n += batch.num_rows


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    near, bag, words, held = (batch.column(c).to_numpy() for c in ("near", "bag", "words", "held"))
    return keys_of(near.view(np.uint64), bag.view(np.uint64), words.astype(np.int64), np.ascontiguousarray(held))


def _find_keys(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The keys of lines, in a row for each of ``parts`` ranges of keys: a
    row a key costs many times what its eight bytes do. Of a key that many
    lines share two go into a row."""
    bound = [(1 << 64) * k // parts for k in range(1, parts)]
    for batch in _together(batches):
        key = np.sort(_keys(batch)[0])
        keep = np.ones(len(key), bool)
        keep[2:] = key[2:] != key[:-2]
        key = key[keep]
        end = np.append(np.searchsorted(key, np.array(bound, np.uint64)), len(key))
        begin = np.append(0, end[:-1])
        raw = key.tobytes()
        full = np.flatnonzero(begin < end)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)),
             pa.array([raw[8 * i:8 * j] for i, j in zip(begin[full].tolist(), end[full].tolist(), strict=True)], pa.binary())],
            names=["part", "keys"])


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keys of whole ranges, those that come more than once."""
    held = [np.frombuffer(raw, np.int64) for batch in batches for raw in batch.column("keys").to_pylist()]
    if held:
        key = np.sort(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[1:][key[1:] == key[:-1]]))], names=["bucket"])


def _find_buckets(batches: Iterator[pa.RecordBatch], seen) -> Iterator[pa.RecordBatch]:
    """The entries of lines whose key may be among those ``seen``, each with
    the line's first occurrence."""
    names = ["c", "length", "weight", "rid", "line"]
    for batch in _together(batches):
        key, whose = _keys(batch)
        keep = np.flatnonzero(passes(seen.value, key))
        take = pa.array(whose[keep])
        yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), *(batch.column(c).take(take) for c in names)],
                                         names=["bucket", *names])


def _comparable(a: Column, b: Column) -> Column:
    shorter, longer = F.least(a["length"], b["length"]), F.greatest(a["length"], b["length"])
    return shorter >= F.lit(SIMILAR) * longer


def apart(a: str, b: str) -> tuple[str, str]:
    """What is left of two texts without what both begin and end with; the
    edit distance is that of the rests."""
    top = step = min(len(a), len(b))
    lo = hi = 0
    while step:  # longest common beginning, by halves
        if lo + step <= top and a[lo:lo + step] == b[lo:lo + step]:
            lo += step
        else:
            step //= 2
    a, b = a[lo:], b[lo:]
    top = step = top - lo
    while step:
        if hi + step <= top and a[len(a) - hi - step:len(a) - hi] == b[len(b) - hi - step:len(b) - hi]:
            hi += step
        else:
            step //= 2
    return a[:len(a) - hi], b[:len(b) - hi]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance. What both begin and end with is set aside; the
    rest goes through one bit vector for each character of ``b``, whose bits
    tell where the distance rises and falls along ``a``. Once it is certain to
    exceed ``most``, some number above ``most`` is returned."""
    a, b = apart(a, b)
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down, done, distance = every, 0, 0, len(a)
    while done < len(b):
        for c in b[done:done + STEP]:
            same = at.get(c, 0)
            turn = same | down
            flat = ((((same & up) + up) ^ up) | turn) & every
            plus = ((down | (flat | up) ^ every) << 1 | 1) & every
            up = (up & flat) << 1 & every | (turn | plus) ^ every
            down = plus & turn
        done = min(done + STEP, len(b))
        distance = done + up.bit_count() - down.bit_count()
        # each character to come lowers the distance by one at most
        least = distance - (len(b) - done)
        if most is not None and least > most:
            return least
    return distance


def letters(text: str) -> np.ndarray:
    """How often each byte value is in a text; of a character of several
    bytes the first counts."""
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    count[128:192] = 0
    return count


def by_words(a: list[str], b: list[str], most: int) -> int:
    """The cost of one way from words to others, at least the edit distance of
    the lines: words are replaced, left out or put in as the next ones tell. It
    stops above ``most``."""
    cost = i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m and cost <= most:
        if a[i] == b[j]:
            i += 1
            j += 1
        elif a[i + 1:i + 2] == b[j + 1:j + 2]:
            cost += max(len(a[i]), len(b[j]))
            i += 1
            j += 1
        elif i + 1 < n and a[i + 1] == b[j]:
            cost += len(a[i]) + 1
            i += 1
        elif j + 1 < m and a[i] == b[j + 1]:
            cost += len(b[j]) + 1
            j += 1
        else:
            cost += max(len(a[i]), len(b[j]))
            i += 1
            j += 1
    return cost + sum(len(x) + 1 for x in chain(a[i:], b[j:]))


def similar(a: str, b: str) -> bool:
    most = int((1 - SIMILAR) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = apart(a, b)
    if max(len(a), len(b)) <= most or by_words(a.split(" "), b.split(" "), most) <= most:
        return True
    # an edit takes away one letter at most and adds one at most
    more = letters(a) - letters(b)
    if max(more[more > 0].sum(), -more[more < 0].sum()) > most:
        return False
    return edit_distance(a, b, most) <= most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted lines, with their normalised texts."""
    for batch in batches:
        row, c, line, text = [], [], [], []
        for k, (raw, wanted) in enumerate(zip(unpack(batch.column("text")), batch.column("wanted").to_pylist(), strict=True)):
            lines = raw.split(b"\n")
            for w in wanted:
                row.append(k)
                c.append(w["c"])
                line.append(w["line"])
                own, = normal_lines(lines[w["line"]].decode("utf-8", "replace"))
                text.append(b" ".join(own.split()).decode("utf-8", "replace"))
        row = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), batch.column("doc_id").take(row), batch.column("rid").take(row),
                                          pa.array(line, pa.int32()), pa.array(text, pa.string())], names=["c", *PLACE, "text"])


def numbered(docs: DataFrame, rid: str = "rid") -> DataFrame:
    """``docs`` with a number for each row, written so that it stays."""
    return pin(docs.withColumn(rid, F.monotonically_increasing_id()), "lines")


def repeated_lines(rows: DataFrame) -> DataFrame:
    """``(rid, gone)`` of ``rows(rid, doc_id, text)``, texts or ``packed``
    ones: the numbers of the lines that go."""
    lines = pin(rows.mapInArrow(_find_lines, _LINES_DDL), "lines")
    distinct = pin(lines.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct(*PLACE)).alias("one"),
        F.first(F.struct("near", "bag", "words", "held", "length")).alias("own")).select("h1", "h2", "weight", "one", "own.*").withColumn("c", F.monotonically_increasing_id()), "lines")
    about = distinct.select("c", "near", "bag", "words", "held", "length", "weight", "one.rid", "one.line")
    parts = slots(rows.sparkSession)
    met = pin(about.mapInArrow(partial(_find_keys, parts=4 * parts), "part int, keys binary").repartition(parts, "part")
              .mapInArrow(_met_again, "bucket long"), "lines")
    buckets = pin(about.mapInArrow(partial(_find_buckets, seen=bloom(met, "bucket")),
                                   "bucket long, c long, length int, weight long, rid long, line int")
                  .join(met, "bucket", "left_semi")
                  .select("bucket", "c", F.struct("length").alias("about"), "weight", "rid", "line"), "lines")
    # the texts of all lines that share a bucket, fetched once for all rounds
    wanted = buckets.groupBy("rid").agg(F.collect_set(F.struct("c", "line")).alias("wanted"))
    whole = rows.select("doc_id", "rid", "text")
    if whole.schema["text"].dataType.typeName() != "binary":
        whole = packed(whole.withColumn("text", F.col("text").cast("binary")))
    text = pin(whole.join(wanted, "rid").select("doc_id", "rid", "text", "wanted")
               .mapInArrow(_pick, "c long, doc_id long, rid long, line int, text string"), "lines")

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(text.select(F.col("c").alias("a"), F.col("text").alias("x")), "a")
                .join(text.select(F.col("c").alias("b"), F.col("text").alias("y")), "b"))
        return both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")

    found = link_buckets(buckets.select("bucket", "c", "about", "weight"), _comparable, verified)
    elsewhere = (F.col("rid") != F.col("one.rid")) | (F.col("line") != F.col("one.line"))
    # of equal lines all but the first go; of those that are linked, all first ones but the first of these
    gone = (lines.select("rid", "line", "h1", "h2").join(distinct.where("weight > 1").select("h1", "h2", "one"), ["h1", "h2"])
            .where(elsewhere).select("rid", "line"))
    if found is not None:
        linked = text.select("c", *PLACE).join(found.withColumnRenamed("id", "c"), "c")
        lowest = linked.groupBy("component").agg(F.min(F.struct(*PLACE)).alias("one"))
        gone = gone.unionAll(linked.join(lowest, "component").where(elsewhere).select("rid", "line"))
    return gone.groupBy("rid").agg(F.collect_list("line").alias("gone"))


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("n_lines", "n_removed", "kept_sha256", "kept")}
        for raw, gone in zip(unpack(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            lines = raw.split(b"\n")
            drop = set(gone or ())
            kept = b"\n".join([x for k, x in enumerate(lines) if k not in drop]) if drop else raw
            for k, v in zip(rows, (len(lines), len(drop), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["n_lines"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
             pa.array(rows["kept_sha256"], pa.string()),
             *([pa.array([x.decode("utf-8", "replace") for x in rows["kept"]], pa.string())] if with_text else [])],
            names=["doc_id", "n_lines", "n_removed", "kept_sha256", *["kept"] * with_text])


def dedup_lines(docs: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its lines, how many of them go, the digest of the text
    that stays (its lines joined again) and, if wanted, that text."""
    # packed once: the texts are read three times and shuffled twice
    rows = numbered(packed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))))
    return (rows.join(repeated_lines(rows), "rid", "left").select("doc_id", "text", "gone")
            .mapInArrow(partial(_cut, with_text=with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string"
                        + ", kept string" * with_text))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, the lines that go taken out of its
    texts. Null texts stay null; a text may become empty."""
    rid, lines = fresh("rid"), fresh("gone")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None or t is None else "\n".join([x for k, x in enumerate(t.split("\n")) if k not in drop])
                          for t, g in zip(texts, gone, strict=True) for drop in [set() if g is None else set(g.tolist())]],
                         dtype=object)

    docs, names = numbered(docs, rid), docs.columns
    gone = repeated_lines(docs.select(F.col(rid).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
                                      text_or_empty(text).alias("text"))).toDF(rid, lines)
    return (docs.join(gone, rid, "left")
            .withColumn(text, F.when(F.col(lines).isNull(), F.col(text)).otherwise(cut(text, lines))).select(*names))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
