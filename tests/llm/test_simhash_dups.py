"""Operator 11 against comparing all fingerprints with each other."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from arrears.llm import simhash_dups as op
from tests.llm.cases import awkward, empty, prose


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Component number of each fingerprint: all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(rows, got):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = groups(fps)
    low = defaultdict(list)
    for (i, _), g in zip(rows, label, strict=True):
        low[g] += [i] if i is not None else []
    want = [(str(i), f, str(min(low[g], default=None))) for (i, _), f, g in zip(rows, fps, label, strict=True)]
    assert sorted((str(r.doc_id), r.fingerprint % 2**64, str(r.component_id)) for r in got) == sorted(want)


def test_components_match_brute_force(spark):
    r = random.Random(3)
    rows = [(x.doc_id, x.text) for x in awkward(spark).collect()]
    for k in range(30):
        words = prose(r.choice([30, 200, 900]), 100 + k).split(" ")
        for j in range(6):
            near = words.copy()
            for _ in range(j):
                near[r.randrange(len(near))] = f"w{r.randrange(99)}"
            rows.append((1000 - 10 * k - j, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, op.near_duplicates(docs).collect())
    assert op.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1024, 1])
def test_links_connect_what_all_pairs_connect(spark, most):
    """Chains, dense balls and far fingerprints; with ``most`` 1 every word
    goes through the places of all 64 bits."""
    r = np.random.default_rng(5)
    held = {0, 2**64 - 1}
    for _ in range(12):
        x = int(r.integers(0, 2**64, dtype=np.uint64))
        for _ in range(20):
            held.add(x)
            flip = r.choice(64, r.integers(1, 7), replace=False)
            x ^= sum(1 << int(b) for b in flip)
            held.add(x ^ 1 << int(flip[0]))
    fps = sorted(held)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in op.near_links(frame, most).collect()]
    want = groups(fps)
    at = {f: k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert want[at[a]] == want[at[b]]
        root[find(at[a])] = find(at[b])
    assert len({find(k) for k in range(len(fps))}) == len(set(want))


def test_balls_and_words():
    assert [len(op.ball(w, r)) for w, r in ((32, 1), (64, 2), (5, 0))] == [33, 2081, 1]
    assert set(np.bitwise_count(op.ball(64, 2)).tolist()) == {0, 1, 2} and len(set(op.ball(64, 2).tolist())) == 2081
    fp = np.arange(50, dtype=np.uint64) << np.uint64(31)
    keys = op.segment_words(fp)
    assert keys.shape == (50, 66) and all(len(set(k.tolist())) == 66 for k in keys)


def test_long_text_counts_bits_in_parts(monkeypatch):
    text = prose(3000, 8).encode()
    whole = op.fingerprints([text, b"", b"one"])
    monkeypatch.setattr(op, "PART", 7)
    assert op.fingerprints([text, b"", b"one"]).tolist() == whole.tolist()
    assert whole[0] == plain_fingerprint(text.decode()) and whole[1] == 0


def test_query_columns(spark, tmp_dir):
    awkward(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    got = {(r.doc_id, r.fingerprint): r for r in op.op11_simhash_near_duplicates(spark, tmp_dir).collect()}
    assert (4, "0" * 16) in got and got[5, "0" * 16].component_id == got[6, "0" * 16].component_id == 4
