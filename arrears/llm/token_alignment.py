"""Operator 13: alignment of two tokenizers by inverted pair bitmaps.

Every text is encoded once by a byte-level BPE (A) and once by a SentencePiece
model (B). Both give back the same bytes, so byte offsets where tokens of both
end cut the text into groups, and the two tokens that end there are a link.

What documents hold is kept inverted: for each pair of ids, and each block of
BLOCK documents, the documents' numbers as bitmaps, one for each bit of how
often the document links the pair (multiplicity planes). A plane is a list of
numbers while that is shorter, else a bitmap. A task writes the planes of what
it has encoded; pieces of one plane that come from several tasks are merged by
OR. Their popcounts give, for each pair, its documents (of the OR of its
planes) and its links (a bit of plane k counts 2^k), summed up map-side. Then
each plane meets its pair's count once and returns by block to the documents,
which add up what their links score.

So what is shuffled is about two bytes a document and pair, not a row. A pair
that all documents hold is one plane a block, spread over all tasks; a task
holds the sums of one block. The vocabularies are read by the tasks and have
the size of their files. Nothing is collected on the driver.

Null and empty texts have no tokens; nor do texts that one of the tokenizers
does not give back byte for byte. Their numbers are zero and their digest is
empty. Null ids and repeated rows are rows of their own: rows have numbers.
Ties for the highest count all count as best. Texts may be of any length and
are encoded whole. An empty table gives an empty one. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import pin

from .common import table, text_or_empty

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: documents whose planes are written together
BLOCK = 4096
#: a plane of at least so many documents is a bitmap, else a list of numbers of two bytes
DENSE = BLOCK // 16
#: document and pair entries held before planes are written
HELD = 1 << 21
#: encoded stretches that a Python worker keeps
KEPT = 300_000
#: texts are encoded together up to about this many bytes
GROUP = 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """The byte-level BPE; special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True
        cut = json.loads(self._own.to_str())["pre_tokenizer"] or {}
        self.cuts_at_spaces = cut.get("type") == "ByteLevel" and cut.get("use_regex", False) and not cut.get("add_prefix_space")
        letters = byte_level_alphabet()
        self.bytes = [b""] * self._own.get_vocab_size()
        for entry, i in self._own.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """The SentencePiece model, which puts the space in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(self._own.id_to_piece(i)[3:5], 16)]) if self._own.is_byte(i)
                      else self._own.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(self._own.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1)


#: what a space between words may stand between
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _solid(c: str) -> bool:
    return c in _PUNCTUATION or c.isalnum()


def stretches(text: str) -> list[str]:
    """The text cut at the single spaces between letters, digits and ASCII
    punctuation, without those spaces."""
    words = text.split(" ")
    out = words[:1]
    ends = bool(out[0]) and _solid(out[0][-1])
    for w in words[1:]:
        if ends and w and _solid(w[0]):
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}"
        ends = bool(w) and _solid(w[-1])
    return out


class Coder:
    """Groups and links of texts under both tokenizers.

    Neither tokenizer lets a token reach over a single space between solid
    characters to what stands before it: A cuts a text there before merging,
    and B has no piece with a space behind another character (else texts are
    encoded whole). So both encode a stretch the same wherever it stands, with
    the space in front, and a group ends with it. A stretch is encoded once
    and kept, as long as no more than KEPT are.
    """

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self._len = [list(map(len, x.bytes)) for x in (self.a, self.b)]
        self._text = [list(map(str, range(len(x.bytes)))) for x in (self.a, self.b)]
        self._apart = self.a.cuts_at_spaces and not any(b" " in x.lstrip(b" ") for x in self.b.bytes)
        self._known: dict[str, tuple[int, int, str, tuple[int, ...]] | None] = {}

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, str, tuple[int, ...]] | None]:
        """For each text its tokens under A and B, its groups and the pairs
        of its links, encoded whole; None if one does not give it back."""
        for text, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a.bytes.__getitem__, x)) != whole or b"".join(map(self.b.bytes.__getitem__, y)) != whole:
                yield None
            else:
                yield len(x), len(y), *self.groups(x, y)

    def _stretch(self, words: list[str]) -> Iterator[tuple[int, int, str, tuple[int, ...]] | None]:
        """As ``aligned``, for stretches: those that are solid at both ends
        are encoded many at a time."""
        joins = []
        for w in words:
            solid = self._apart and _solid(w[0]) and _solid(w[-1])
            if solid and joins and joins[-1][0] and len(joins[-1][1]) < 256:
                joins[-1][1].append(w)
            else:
                joins.append((solid, [w]))
        texts = [" ".join(own) for _, own in joins]
        for (_, own), text, x, y in zip(joins, texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a.bytes.__getitem__, x)) != whole or b"".join(map(self.b.bytes.__getitem__, y)) != whole:
                yield from self.aligned(own) if len(own) > 1 else [None]
                continue
            ends = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in own])
            p = q = 0
            for i, j in zip(*((np.searchsorted(np.cumsum([n[t] for t in ids]), ends) + 1).tolist()
                              for n, ids in zip(self._len, (x, y), strict=True)), strict=True):
                yield i - p, j - q, *self.groups(x[p:i], y[q:j])
                p, q = i, j

    def groups(self, x: list[int], y: list[int]) -> tuple[str, tuple[int, ...]]:
        """The groups as ``a1,a2|b1;a3|b2,b3``, and the pairs of the links, of
        two lists of tokens with the same bytes."""
        (len_x, len_y), (left, right) = self._len, self._text
        out, pairs = [], []
        last = len(x) - 1
        i = j = p = q = 0
        end_x, end_y = len_x[x[0]], len_y[y[0]]
        while True:
            if end_x == end_y:
                one, two = x[i], y[j]
                pairs.append(one << 32 | two)
                out.append((left[one] if i == p else ",".join([left[t] for t in x[p:i + 1]])) + "|"
                           + (right[two] if j == q else ",".join([right[t] for t in y[q:j + 1]])))
                if i == last:
                    return ";".join(out), tuple(pairs)
                p = i = i + 1
                q = j = j + 1
                end_x += len_x[x[i]]
                end_y += len_y[y[j]]
            elif end_x < end_y:
                i += 1
                end_x += len_x[x[i]]
            else:
                j += 1
                end_y += len_y[y[j]]

    def coded(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """For each text its tokens under A and B, its groups, its distinct
        pairs and how often it links each."""
        known = self._known
        if len(known) > KEPT:
            known.clear()
        parts = [(stretches(t) if self._apart else [t]) if t else [] for t in texts]
        new = list({p for own in parts for p in own if p not in known})
        known.update(zip(new, self._stretch(new), strict=True))
        none = np.zeros(0, np.int64)
        for text, own in zip(texts, parts, strict=True):
            each = [known[p] for p in own]
            if None in each:
                each = list(self.aligned([text])) if len(own) > 1 else each
            if not each or None in each:
                yield 0, 0, "", none, none
                continue
            n_a, n_b, groups, pairs = zip(*each, strict=True)
            pair = np.fromiter(chain.from_iterable(pairs), np.int64)
            yield sum(n_a), sum(n_b), ";".join(groups), *np.unique(pair, return_counts=True)


@cache
def coder(byte_level: str, pieces: str) -> Coder:
    """Serves all tasks of a Python worker."""
    return Coder(byte_level, pieces)


def planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """``(plane, pairs, documents each, contents)`` of one block's entries:
    ``doc`` links ``pair`` that many ``times``."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    for k in range(int(times.max(initial=0)).bit_length()):
        here = (times >> k & 1).astype(bool)
        own, docs = pair[here], doc[here].astype("<u2")
        edge = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        raw, lo = docs.tobytes(), (2 * edge).tolist()
        content = [raw[p:q] for p, q in zip(lo, lo[1:], strict=False)]
        size = np.diff(edge)
        for g in np.flatnonzero(size >= DENSE):
            content[g] = bitmap(docs[edge[g]:edge[g + 1]])
        yield k, own[edge[:-1]], size, content


def bitmap(docs: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK, np.uint8)
    bits[docs] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(content: bytes) -> np.ndarray:
    """The documents' numbers in a plane, in order."""
    if len(content) < 2 * DENSE:
        return np.frombuffer(content, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(content, np.uint8), bitorder="little"))


def merged(contents: list[bytes]) -> bytes:
    """OR of the pieces of one plane."""
    if len(contents) == 1:
        return contents[0]
    bits = np.zeros(BLOCK, np.uint8)
    for c in contents:
        bits[members(c)] = 1
    docs = np.flatnonzero(bits)
    return bitmap(docs) if len(docs) >= DENSE else docs.astype("<u2").tobytes()


_ROWS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("content", pa.binary())])
_ROWS_DDL = "rid long, doc_id long, n_a long, n_b long, n_links long, groups string, pair long, block long, plane int, content binary"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS],
                                      schema=_ROWS)


def _encode(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document (``pair`` null) and one for each plane."""
    import hashlib

    coded = coder(byte_level, pieces).coded
    pair, rid, times, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal pair, rid, times, held
        if pair:
            own, row, often = np.concatenate(pair), np.concatenate(rid), np.concatenate(times)
            for block in np.unique(row // BLOCK).tolist():
                here = row // BLOCK == block
                for k, pairs, _, content in planes(own[here], row[here] % BLOCK, often[here]):
                    for lo in range(0, len(pairs), 1 << 16):
                        part = pairs[lo:lo + (1 << 16)]
                        yield _rows(pair=part, block=np.full(len(part), block), plane=np.full(len(part), k, np.int32),
                                    content=content[lo:lo + (1 << 16)])
        pair, rid, times, held = [], [], [], 0

    for batch in batches:
        numbers, ids, texts = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < GROUP:
                size += len(texts[hi])
                hi += 1
            out = {"rid": numbers[lo:hi], "doc_id": ids[lo:hi], "n_a": [], "n_b": [], "n_links": [], "groups": []}
            for number, (n_a, n_b, groups, own, often) in zip(numbers[lo:hi], coded(texts[lo:hi]), strict=True):
                for name, value in zip(("n_a", "n_b", "n_links", "groups"), (
                        n_a, n_b, int(often.sum()),
                        groups if with_groups else hashlib.sha256(groups.encode()).hexdigest() if n_a else ""), strict=True):
                    out[name].append(value)
                if len(own):
                    pair.append(own)
                    rid.append(np.full(len(own), number))
                    times.append(often)
                    held += len(own)
            yield _rows(**out)
            if held >= HELD:
                yield from flush()
            lo = hi
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by pair, block and plane to whole planes, with the
    documents that each pair of a block has in all (in its first plane's row)."""
    names = ["pair", "block", "plane", "content", "links", "docs"]

    def done(rows: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["pair"], pa.int64()), pa.array(rows["block"], pa.int64()),
                                           pa.array(rows["plane"], pa.int32()), pa.array(rows["content"], pa.binary()),
                                           pa.array(rows["links"], pa.int64()), pa.array(rows["docs"], pa.int64())], names=names)

    def close(rows: dict, key: tuple[int, int], held: dict[int, list[bytes]]) -> None:
        whole = {k: merged(c) for k, c in held.items()}
        every = merged(list(whole.values()))
        for nth, (k, content) in enumerate(whole.items()):
            n = len(content) // 2 if len(content) < 2 * DENSE else int(np.bitwise_count(np.frombuffer(content, np.uint8)).sum())
            for name, value in zip(names, (*key, k, content, n << k, 0 if nth else len(members(every))), strict=True):
                rows[name].append(value)

    rows: dict[str, list] = {n: [] for n in names}
    key, held = None, {}
    for batch in batches:
        for own, block, plane, content in zip(batch.column("pair").to_pylist(), batch.column("block").to_pylist(),
                                              batch.column("plane").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if key != (own, block):
                if key is not None:
                    close(rows, key, held)
                key, held = (own, block), {}
            held.setdefault(plane, []).append(content)
        if rows["pair"]:
            yield done(rows)
            rows = {n: [] for n in names}
    if key is not None:
        close(rows, key, held)
        yield done(rows)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False,
            byte_level: str | None = None, pieces: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, postings)``. Documents: rid, doc_id, n_a, n_b, n_links
    and the groups (as text if wanted, else as SHA-256). Postings: for each
    pair (A's id << 32 | B's id), block and plane its content, its links, and
    once for each pair and block its documents."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    written = pin(rows.mapInArrow(partial(_encode, byte_level=byte_level or f"{TOKENIZERS}/{BYTE_LEVEL}",
                                          pieces=pieces or f"{TOKENIZERS}/{PIECES}", with_groups=with_groups), _ROWS_DDL), "alignment")
    own = written.where("pair is null").select("rid", "doc_id", "n_a", "n_b", "n_links", "groups")
    postings = (written.where("pair is not null").select("pair", "block", "plane", "content")
                .repartition("pair", "block").sortWithinPartitions("pair", "block", "plane")
                .mapInArrow(_merge, "pair long, block long, plane int, content binary, links long, docs long"))
    return own, pin(postings, "alignment")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(pair, a, b, docs, links, best)``: documents and links of each pair,
    and whether no other pair of its B id has more links."""
    counts = postings.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"),
                           F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "docs", "links")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Planes with their pair's score, sorted by block, to sums a document."""
    block, best, total = None, None, None

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), pa.array(best[at]), pa.array(total[at])], names=["rid", "n_best", "count_sum"])

    for batch in batches:
        contents = batch.column("content").to_pylist()
        if not contents:
            continue
        blocks, flags = batch.column("block").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
        weight = np.int64(1) << batch.column("plane").to_numpy().astype(np.int64)
        links = batch.column("links").to_numpy()
        dense = np.fromiter((len(c) >= 2 * DENSE for c in contents), bool, len(contents))
        edge = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(blocks)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if block != blocks[lo]:
                if block is not None:
                    yield done()
                block, best, total = int(blocks[lo]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            lists = [k for k in range(lo, hi) if not dense[k]]
            docs = np.frombuffer(b"".join([contents[k] for k in lists]), "<u2")
            owner = np.repeat(np.array(lists, np.int64), [len(contents[k]) // 2 for k in lists])
            np.add.at(total, docs, (links * weight)[owner])
            np.add.at(best, docs, (flags * weight)[owner])
            for k in range(lo, hi):
                if dense[k]:
                    at = members(contents[k])
                    total[at] += links[k] * weight[k]
                    best[at] += flags[k] * weight[k]
    if block is not None:
        yield done()


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """``(rid, n_best, count_sum)`` of the documents that have links."""
    return (postings.select("pair", "block", "plane", "content").join(counts.select("pair", "links", "best"), "pair")
            .select("block", "plane", "content", "links", "best").repartition("block").sortWithinPartitions("block")
            .mapInArrow(_return, "rid long, n_best long, count_sum long"))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False,
          byte_level: str | None = None, pieces: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: for each row its tokens, links, groups and
    scores, and for each pair of ids its documents, links and whether it is
    its B id's best."""
    own, postings = encoded(docs, doc_id, text, with_groups, byte_level, pieces)
    counts = pin(pair_counts(postings), "alignment")
    return (own.join(scores(postings, counts), "rid", "left")
            .select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", _or_zero("n_best"), _or_zero("count_sum"), "groups"),
            counts)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = align(table(spark, sf_dir, "documents"))
    return documents.withColumnRenamed("groups", "groups_sha256")
