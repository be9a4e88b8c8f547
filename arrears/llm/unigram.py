"""Operator 10: SentencePiece encoding and decoding with a unigram model.

A text is marked (every space becomes the white-space marker, one marker is
put in front) and cut into the pieces whose log scores add up to the most.
A character that no piece covers is encoded as its UTF-8 bytes.

Pieces stand in a double-array trie. No piece continues over a marker that
follows another character, so the best path of a text is the best paths of
its words put together. The words of an Arrow batch that a task has not met
before are solved together: the trie is walked from all their positions in
step, and the best paths grow by relative position. Words are remembered
within a bounded memory per task.

Nulls and empty texts have no pieces and decode to the empty text. Texts may
be of any length; no prefix is taken. A literal marker character in a text
decodes as a space, and invalid UTF-8 from stray byte pieces as U+FFFD.
Equal texts have equal pieces; among paths of equal score the one whose last
piece starts first wins at each position. An empty table gives an empty one.
Other columns of the input are kept whatever their names, except the output
columns' own names, which are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: what an uncovered character costs below the lowest score
UNKNOWN_PENALTY = 10.0
#: words a task remembers, and the longest that is worth remembering
REMEMBERED_WORDS = 250_000
REMEMBERED_BYTES = 64
#: words up to this many bytes are solved in step, longer ones one by one
STEP_BYTES = 96

_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    """A vocabulary: the trie arrays and what is needed to decode.

    ``base[node] + byte`` is the child of ``node`` for ``byte`` if ``check``
    there names ``node``; ``leaf`` is the id of the piece that ends at a node,
    or -1. ``surface`` holds the bytes each id stands for."""

    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    score: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    unknown: float


def build_pieces(pieces: list[tuple[bytes, float, int]], surface: list[bytes],
                 byte_ids: list[int]) -> Pieces:
    """The double array of ``(piece bytes, log score, id)``."""
    if any(b"\0" in p or not p for p, _, _ in pieces):
        raise ValueError("a piece must not be empty or hold a zero byte")
    mark = MARK.encode()
    if any(re.search(f"[^{MARK}]{MARK}", p.decode("utf-8")) for p, _, _ in pieces if mark in p):
        raise ValueError("a piece must not continue over a marker")
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for piece, _, i in pieces:
        node = 0
        for byte in piece:
            nxt = children[node].get(byte)
            if nxt is None:
                nxt = children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = i
    size = 2 * len(children) + 512
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    place = {0: 0}
    taken = bytearray(size)
    taken[0] = 1
    first_free, queue = 1, [0]
    for node in queue:
        own = children[node]
        at = place[node]
        leaf[at] = ends[node]
        if not own:
            continue
        codes = sorted(own)
        slot = max(first_free, codes[0] + 1)
        while True:
            slot = taken.find(0, slot)
            if slot < 0 or slot + 256 >= len(taken):
                grow = len(taken)
                taken.extend(bytes(grow))
                base, check, leaf = (np.concatenate([x, np.full(grow, fill, np.int32)])
                                     for x, fill in ((base, 0), (check, -1), (leaf, -1)))
                slot = max(slot, first_free)
                continue
            b = slot - codes[0]
            if b > 0 and not any(taken[b + c] for c in codes):
                break
            slot += 1
        base[at] = b
        for c in codes:
            taken[b + c] = 1
            check[b + c] = at
            place[own[c]] = b + c
            queue.append(own[c])
        first_free = max(first_free, taken.find(0, first_free))
    used = max(place.values()) + 257
    score = np.zeros(len(surface))
    for _, s, i in pieces:
        score[i] = s
    low = min((s for _, s, _ in pieces), default=0.0)
    return Pieces(base[:used].copy(), check[:used].copy(), leaf[:used].copy(), score, surface,
                  np.asarray(byte_ids, np.int32), low - UNKNOWN_PENALTY)


def load_pieces(path: str) -> Pieces:
    """The pieces and log scores of a model file, as they stand there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, surface, byte_ids = [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            pieces.append((piece.encode(), model.get_score(i), i))
            surface.append(piece.replace(MARK, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte fallback")
    return build_pieces(pieces, surface, byte_ids)


def _matches(p: Pieces, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every piece at every start position: (start, length, id)."""
    at, node = starts, np.zeros(len(starts), np.int64)
    found, depth = [], 0
    while len(at):
        nxt = p.base[node] + flat[at + depth]
        ok = (p.check[nxt] == node) & (flat[at + depth] != 0) & (nxt > 0)
        at, node = at[ok], nxt[ok].astype(np.int64)
        depth += 1
        ids = p.leaf[node]
        hit = ids >= 0
        found.append((at[hit], np.full(int(hit.sum()), depth), ids[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def segment(p: Pieces, words: list[bytes]) -> list[bytes]:
    """The piece ids of each word, as packed little-endian int32."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"\0".join(words) + b"\0" * (2 + len(p.surface[0])), np.uint8).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    total = int(offset[-1] + lens[-1]) + 1
    word_of = np.repeat(np.arange(len(words)), lens + 1)[:total]
    inside = np.ones(total, bool)
    inside[offset + lens] = False
    lead = inside & ((flat[:total] & 0xC0) != 0x80)
    starts = np.flatnonzero(lead)
    s, n, i = _matches(p, flat, starts)
    # the length of the character at each start, and those no piece covers
    edge = np.flatnonzero(lead | ~inside)
    width = np.zeros(total, np.int64)
    width[edge[:-1]] = np.diff(edge)
    covered = np.zeros(total, bool)
    covered[s[n == width[s]]] = True
    bare = starts[~covered[starts]]
    s = np.concatenate([s, bare])
    n = np.concatenate([n, width[bare]])
    i = np.concatenate([i, np.full(len(bare), -1)])
    gain = np.where(i >= 0, p.score[i], p.unknown)
    best = np.full(total, -np.inf)
    best[offset] = 0.0
    back_len, back_id = np.zeros(total, np.int64), np.zeros(total, np.int64)
    rel = s - offset[word_of[s]]
    quick = lens[word_of[s]] <= STEP_BYTES
    q = np.flatnonzero(quick)
    q = q[np.argsort(rel[q], kind="stable")]
    for m in np.split(q, np.flatnonzero(np.diff(rel[q])) + 1):
        end, cand = s[m] + n[m], best[s[m]] + gain[m]
        up = cand > best[end]
        m, end = m[up], end[up]
        best[end], back_len[end], back_id[end] = cand[up], n[m], i[m]
    slow = np.flatnonzero(~quick)
    if len(slow):
        slow = slow[np.lexsort((n[slow], s[slow]))]
        score = {int(o): 0.0 for o in offset[lens > STEP_BYTES]}
        for a, k, x, g in zip(s[slow].tolist(), n[slow].tolist(), i[slow].tolist(),
                              gain[slow].tolist(), strict=True):
            cand = score[a] + g
            if cand > score.get(a + k, -np.inf):
                score[a + k] = cand
                back_len[a + k], back_id[a + k] = k, x
    # walk back from all word ends in step
    cur = offset + lens
    live = np.flatnonzero(lens > 0)
    walked = []
    while len(live):
        end = cur[live]
        k = back_len[end]
        walked.append((live, end - k, k, back_id[end]))
        cur[live] = end - k
        live = live[end - k > offset[live]]
    if not walked:
        return [b""] * len(words)
    w, at, k, x = (np.concatenate(c) for c in zip(*walked, strict=True))
    order = np.argsort(at)
    w, at, k, x = w[order], at[order], k[order], x[order]
    times = np.where(x < 0, k, 1)
    w, at, x = np.repeat(w, times), np.repeat(at, times), np.repeat(x, times)
    nth = np.arange(len(w)) - np.repeat(np.cumsum(times) - times, times)
    ids = np.where(x < 0, p.byte_ids[flat[at + nth]], x).astype("<i4")
    packed, ends = ids.tobytes(), np.cumsum(np.bincount(w, minlength=len(words))) * 4
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Encodes texts with a bounded memory of words already solved."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        known, cut = self.known, [cut_words(t) for t in texts]
        new = list(set(itertools.chain.from_iterable(cut)).difference(known))
        if new:
            solved = segment(self.pieces, [(MARK + w).encode() for w in new])
            known.update(zip(new, solved, strict=True))
        for words in cut:
            yield b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > REMEMBERED_BYTES:
                del known[w]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(pieces: Pieces) -> Encoder:
    """This Python worker's encoder for a vocabulary; the words it remembers
    serve the worker's later batches and tasks."""
    known = _ENCODERS.get(id(pieces))
    if known is None or known.pieces is not pieces:
        _ENCODERS.clear()
        known = _ENCODERS[id(pieces)] = Encoder(pieces)
    return known


def cut_words(text: str) -> list[str]:
    """The words of a marked text, each without its first marker."""
    if not text:
        return []
    if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
        return [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    text = b"".join(map(pieces.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, so that memory is bounded."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def shared_pieces(spark: SparkSession, model: str | None = None):
    """The vocabulary as a broadcast; a few MB, by the size of the file."""
    return spark.sparkContext.broadcast(load_pieces(model or f"{TOKENIZERS}/{MODEL}"))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of each whole text, ``array<int>``."""
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(pieces.value)
        for part in parts:
            got = [np.frombuffer(x, "<i4") for g in _groups(part.tolist()) for x in encoder.batch(g)]
            yield pd.Series(got, dtype=object)

    return docs.withColumn(out, ids(text_or_empty(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with the text that each array of piece ids stands for."""
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([decode_ids(pieces.value, np.asarray(x)) if x is not None else "" for x in part],
                            dtype=object)

    return docs.withColumn(out, texts(F.col(ids)))


def digest(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with the struct ``encoded(n_pieces, n_byte_pieces, ids_sha256,
    round_trip)``: each whole text encoded, decoded again and compared with
    the text (its markers taken as spaces)."""
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf("n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
    def figures(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pieces.value
        encoder, is_byte = encoder_of(p), np.zeros(len(p.surface), bool)
        is_byte[p.byte_ids] = True
        for part in parts:
            rows = []
            for g in _groups(part.tolist()):
                for t, packed in zip(g, encoder.batch(g), strict=True):
                    ids = np.frombuffer(packed, "<i4")
                    rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(packed).hexdigest(),
                                 decode_ids(p, ids) == t.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    return docs.withColumn("encoded", figures(text_or_empty(text)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).select("doc_id", "encoded.*")
