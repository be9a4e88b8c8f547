"""Operators 1, 3, 9 and 10 against plain versions of themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import fingerprints, repeats, token_counts, unigram
from tests.llm.cases import awkward, empty, prose


def covered(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 31])
def test_repeats_match_brute_force(spark, length):
    docs = awkward(spark)
    texts = [(r.text or "").encode() for r in docs.collect()]
    got = repeats.remove_repeats(docs, length).drop("spans").toPandas()
    assert sorted(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == sorted(covered(texts, length))


def test_repeats_bytes_spans_and_empty_table(spark):
    r = repeats.remove_repeats(awkward(spark), with_bytes=True).where("doc_id = 14").first()
    assert sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_rows_without_id_are_told_apart(spark):
    """Two texts of equal 32-bit hash, neither with an id, and a copy of one."""
    text = F.concat(F.lit("lamp "), F.col("id"), F.lit(" "), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 12))
    names = spark.range(400_000).select(text.alias("text")).withColumn("h", F.hash(F.lit(True), "text"))
    one = names.groupBy("h").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first().texts
    docs = spark.createDataFrame([(None, one[0]), (None, one[1]), (1, one[0])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in repeats.remove_repeats(docs).collect())
    want = sorted([(0, c[0] - c[1]) for c in covered([t.encode() for t in (one[0], one[1], one[0])], 200)[:2]] + [(1, 0)])
    assert [k for _, k in got] == [k for _, k in want]


def test_long_texts_come_in_segments(monkeypatch):
    text = prose(3000, 11).encode()
    want = {(int(a), int(n)) for _, a, n, *_ in zip(*repeats.runs([text]), strict=True)}
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    windows = lambda runs: sorted(a + k for a, n in runs for k in range(n))
    got = set()
    for group in repeats.segments([text], 200):
        part, at, n, *_ = repeats.runs([t for _, _, t in group])
        got |= {(int(a) + group[p][1], int(k)) for p, a, k in zip(part, at, n, strict=True)}
    assert windows(got) == windows(want) == list(range(len(text) - 199))


def test_anchor_ranks_are_equal_for_equal_strings_only():
    raw = np.frombuffer(b"abcabcabdabcabc" * 20, np.uint8)
    for length in (1, 2, 3, 7, 64):
        r = repeats.ranks(raw, length)
        strings = [raw[i:i + length].tobytes() for i in range(len(raw) - length + 1)]
        assert len(r) == len(strings)
        assert len(set(zip(r.tolist(), strings, strict=True))) == len(set(strings)) == len(set(r.tolist()))


def test_fingerprints_against_plain_order(spark):
    docs = awkward(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        new = fingerprints.edited(t, rows[(k + 1) % len(rows)][1])
        want.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(t).text(),
                     fingerprints.fingerprint(new).text()))
    got = fingerprints.compare_with_next(docs).toPandas()
    seen = [("None" if i != i or i is None else str(int(i)), n, s, f, e) for i, n, s, f, e in
            zip(got.doc_id, got.n_chars, got.edited_sha256, got.fingerprint, got.edited_fingerprint, strict=True)]
    assert sorted(seen) == sorted(want)
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert fingerprints.compare_with_next(empty(spark)).count() == 0


def test_fingerprint_algebra():
    f = fingerprints.fingerprint
    a, b, c = "first line of it all\nshort\n", prose(50, 1), prose(70, 2)
    assert f(b + "\n" + c).text() == f(c + "\n" + b).text() == (f(b) + f(c)).text()
    assert (f(b + "\n" + c) - f(c)).text() == f(b).text()
    assert f(b + "\n" + b).text() != f(b).text()
    assert fingerprints.likeness(f(a), f(a)) == 1.0 and fingerprints.likeness(f(a), f("")) == 0.0
    half = fingerprints.likeness(f(prose(400, 3) + " " + prose(400, 4)), f(prose(400, 3) + " " + prose(400, 5)))
    assert 0.25 < half < 0.75
    many = "\n".join([prose(6, k) for k in range(100)])
    for kept in (0, 10, 700, len(many)):
        new = many[:kept] + "tail\nof it"
        assert fingerprints.replace_tail(f(many), many, new, kept).text() == f(new).text()


def test_token_histogram(spark):
    import tiktoken

    docs = awkward(spark)
    own = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, special_tokens={},
                            mergeable_ranks=token_counts.read_ranks(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}"))
    lens = [len(own.encode_ordinary(r.text or "")) for r in docs.collect()]
    got = token_counts.limits(token_counts.length_histogram(token_counts.encoded_lengths(docs))).collect()
    assert {r.n_tokens: r.n_docs for r in got} == Counter(lens)
    for r in got:
        assert r.docs_over == sum(x > r.n_tokens for x in lens)
        assert r.total_tokens == sum(lens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lens)
        assert r.quantile == sum(x <= r.n_tokens for x in lens) / len(lens)
    assert token_counts.limits(token_counts.length_histogram(token_counts.encoded_lengths(empty(spark)))).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return unigram.load_pieces(f"{unigram.TOKENIZERS}/{unigram.MODEL}")


def plain_viterbi(p, table, text):
    """Best path by dynamic programming over characters."""
    marked = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    best = [(0.0, None, None)] + [(-np.inf, None, None)] * len(marked)
    for i in range(len(marked)):
        single = marked[i] in table
        for j in range(i + 1, min(len(marked), i + 48) + 1):
            ok = marked[i:j] in table
            if ok or (j == i + 1 and not single):
                s = best[i][0] + (p.score[table[marked[i:j]]] if ok else p.unknown)
                if s > best[j][0]:
                    best[j] = (s, i, table[marked[i:j]] if ok else None)
    out, j = [], len(marked)
    while j:
        _, i, x = best[j]
        out = ([x] if x is not None else [int(p.byte_ids[b]) for b in marked[i:j].encode()]) + out
        j = i
    return out


def test_unigram_paths_and_round_trip(spark, pieces):
    table = {}
    for i, s in enumerate(pieces.surface):
        if s and i not in set(pieces.byte_ids.tolist()):
            table[s.decode().replace(" ", unigram.MARK)] = i
    docs = awkward(spark).where("length(text) < 5000 or text is null")
    rows = unigram.decode(unigram.encode(docs), out="back").collect()
    for r in rows:
        t = r.text or ""
        assert r.ids == plain_viterbi(pieces, table, t)
        assert r.back == t.replace(unigram.MARK, " ")
    assert unigram.encode(empty(spark)).count() == 0


def test_unigram_long_words_and_digest(spark, pieces):
    long = "ab" * 4000 + " " + "é" * 200
    got = unigram.Encoder(pieces).batch([long, long[:50], ""])
    ids = [np.frombuffer(x, "<i4") for x in got]
    assert unigram.decode_ids(pieces, ids[0]) == long and len(ids[2]) == 0
    rows = unigram.digest(awkward(spark)).select("encoded.*").collect()
    assert all(r.round_trip for r in rows)
    assert unigram.segment(pieces, [w.encode() for w in ("▁the", "▁then")]) == [
        next(unigram.Encoder(pieces).batch([w])) for w in ("the", "then")]
