"""Operator 12 against comparing every word with the one q further on."""

import hashlib
import random

import pytest

from arrears.llm import periodic_runs as op
from tests.llm.cases import awkward, empty


def stretches(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [12, 5, 2])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(r.randrange(1, 6)):
            kinds = r.choice([1, 2, 3, 5, 30])
            words = [b"%d" % r.randrange(kinds) for _ in range(r.randrange(90))] * r.choice([1, 1, 2, 3])
            texts.append(op.repeated_tail(r.randrange(1000), words))
        assert op.runs(texts, least) == [stretches(w, least) for w in texts]


def test_a_repeated_phrase_after_many_words_and_a_fibonacci_word():
    phrase = b"the quick red fox jumps over it".split()
    assert op.runs([[x for k in range(3000) for x in (*phrase, b"%d" % k)]]) == [[]]
    one, two = [b"a"], [b"b"]
    while len(one) < 600:
        one, two = one + two, one
    assert op.runs([one, one * 2]) == [stretches(one, 12), stretches(one * 2, 12)]


def test_places_leap_over_equal_left_words():
    node = op.Places(0, 9)
    for place in range(2, 400, 2):
        node.add(op.Places(place, 7 if place != 200 else 5))
    assert node.partners(399, 7, 500) == [0, 200]
    assert node.partners(399, 5, 300) == [p for p in range(100, 400, 2) if p != 200]
    assert node.partners(201, 1, 3) == [198, 200, 202, 204]


def plain(doc_id, text):
    words = op.repeated_tail(doc_id, (text or "").encode().split())
    found = stretches(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_over_awkward_rows(spark, tmp_dir):
    docs = awkward(spark).where("doc_id is null or doc_id != 11")
    more = [(i, " ".join(str(k % 7) for k in range(40)), None, None, None, 1, "r", 1, "i") for i in range(20, 60)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    got = op.op12_periodic_runs(spark, tmp_dir).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [plain(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want)


def test_long_text_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "x y z " * 100_000, "q"), (None, None, "q")], "doc_id long, text string, runs string")
    rows = {r.doc_id: r for r in op.periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(0, 300_000, 3)] and rows[1].collapsed == "x y z"
    assert rows[None].runs == [] and rows[None].collapsed == ""
    assert op.periodic_runs(empty(spark)).count() == 0
