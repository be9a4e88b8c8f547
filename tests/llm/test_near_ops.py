"""Operators 4, 5, 6 and 7 and the linking of buckets, against brute force."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from arrears.llm import common, line_dedup, linking, mixing, near_dups, neighbours, shingles, word_hashes
from tests.llm.cases import SCHEMA, awkward, empty, prose


def groups(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def variants(spark, n=60):
    """Families of near copies of a hub that are not all similar to each other."""
    r = random.Random(7)
    rows = [(r_.doc_id, r_.text) for r_ in awkward(spark).where("doc_id is not null and doc_id <> 13").collect()]
    for family in range(3):
        hub = prose(200, 100 + family).split(" ")
        for k in range(n // 3):
            own = list(hub)
            for j in r.sample(range(200), 0 if k == 5 else 5):
                own[j] = f"w{r.randrange(10 ** 6)}"
            rows.append((1000 * (family + 1) + k, " ".join(own)))
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, None, None, None, 1, "", 2, "") for i, t in rows], SCHEMA)


def test_near_duplicates_match_brute_force(spark):
    docs = variants(spark)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = near_dups.near_duplicates(docs).collect()
    assert len(links) >= 50 and len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_awkward_and_empty(spark):
    got = near_dups.near_duplicates(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert [r.component_id for r in got if r.doc_id in (4, 5, 6)] == [r.doc_id for r in got if r.doc_id in (4, 5, 6)]
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert near_dups.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_rows_with_equal_ids(spark):
    """Of ids 1, 1, 2 with equal texts both rows of id 1 are kept, one stays;
    a row with the id of a copy is judged on its own text."""
    a, b = prose(80, 1), prose(80, 2)
    rows = [(1, a), (1, a), (2, a), (None, b), (None, a + " more"), (3, b), (3, prose(80, 3))]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "", 2, "") for i, t in rows], SCHEMA)
    got = near_dups.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("3", "3", True), ("None", "1", False), ("None", "3", False)]
    assert sorted(r.component_id for r in got if r.stays) == [1, 3, 3]


def test_bitmaps_bound_what_sets_share(spark):
    """No similar pair is left out, and most unlike ones are."""
    r = np.random.default_rng(5)
    rows, like = [], []
    for k in range(300):
        base = r.integers(0, 1 << 63, int(r.integers(1, 500)), dtype=np.uint64)
        share = int(len(base) * r.choice([0.3, 0.6, 0.87, 0.9]))
        other = np.concatenate([base[:share], r.integers(0, 1 << 63, len(base) - share, dtype=np.uint64)])
        both = len(np.intersect1d(base, other))
        like.append(100 * both >= 75 * (2 * len(base) - both))
        rows.append((k, *((len(x), near_dups.bitmap(x).tolist(), [1]) for x in (base, other))))
    about = "struct<n: long, sketch: array<long>, right: array<long>>"
    pairs = spark.createDataFrame(rows, f"k long, a {about}, b {about}")
    passed = {x.k for x in pairs.where(near_dups._comparable(pairs["a"], pairs["b"])).collect()}
    assert passed >= {k for k, x in enumerate(like) if x}
    assert len(passed - {k for k, x in enumerate(like) if x}) <= 30


def test_tables_find_similar_sets():
    r = np.random.default_rng(3)
    met = 0
    for _ in range(200):
        base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        other = np.concatenate([base[:345], r.integers(0, 1 << 63, 55, dtype=np.uint64)])  # Jaccard 0.758
        same = near_dups.half_keys(base) == near_dups.half_keys(other)
        met += bool(same[:near_dups.HALVES].any() and same[near_dups.HALVES:].any())
    assert met >= 198


def test_linking_of_a_bucket_without_a_hub(spark):
    """A chain in one bucket: no member is linked to all others."""
    n = 40
    buckets = common.pin(spark.createDataFrame([(b, c, c, 1) for b in (1, 2) for c in range(n)], "bucket long, c long, about long, weight long"))
    asked = []

    def verified(pairs):
        asked.append(pairs.count())
        return pairs.where("b - a = 1 and b % 10 <> 0")
    found = linking.link_buckets(buckets, lambda a, b: a.isNotNull(), verified).collect()
    want = groups(range(n), [(k, k + 1) for k in range(n - 1) if (k + 1) % 10])
    assert {r.id: r.component for r in found} == want
    assert sum(asked) <= n * (n - 1) // 2


@pytest.mark.parametrize(("n", "families"), [(200, 200), (120, 2)])
def test_linking_ends_when_a_bucket_stays_apart(spark, n, families):
    """Members that share a bucket and are not linked, and two families in one
    bucket: every pair across is asked for once, in few rounds."""
    buckets = common.pin(spark.createDataFrame([(1, c, c, 1) for c in range(n)], "bucket long, c long, about long, weight long"))
    asked = []

    def verified(pairs):
        asked.append(pairs.count())
        assert len(asked) <= 10
        return pairs.where(f"a % {families} = b % {families}")
    found = linking.link_buckets(buckets, lambda a, b: a.isNotNull(), verified).collect()
    assert {r.id: r.component for r in found} == ({} if families == n else {c: c % families for c in range(n)})
    assert sum(asked) == n * (n - 1) // 2 if families == n else sum(asked) >= (n // 2) ** 2


@pytest.mark.parametrize("block", [500, 7])
def test_linking_of_one_component_and_outsiders(spark, monkeypatch, block):
    """Outsiders that share the bucket of a linked group: few rounds, and every
    outsider is still compared with each member, whatever the blocks."""
    monkeypatch.setattr(linking, "BLOCK", block, raising=False)
    n, out = 400, 60
    buckets = common.pin(spark.createDataFrame([(1, c, c, 1) for c in range(n + out)], "bucket long, c long, about long, weight long"))
    asked = []

    def verified(pairs):
        asked.append(pairs.count())
        return pairs.where(f"b < {n} or a = {n - 7} and b = {n + out - 1}")
    found = linking.link_buckets(buckets, lambda a, b: a.isNotNull(), verified).collect()
    assert {r.id: r.component for r in found} == {c: 0 for c in [*range(n), n + out - 1]}
    assert len(asked) <= 3 and sum(asked) >= n * out + out * (out - 1) // 2


@pytest.mark.parametrize("chunk", [common.CHUNK, 20])
def test_components_of_a_chain_and_a_star(spark, chunk):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(7, 7)]
    random.Random(0).shuffle(links)
    got = common.components(spark.createDataFrame(links, "a long, b long").repartition(9), chunk).collect()
    assert {r.id: r.component for r in got} == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
    assert common.components(spark.createDataFrame([], "a long, b long"), chunk).count() == 0


def test_components_hold_a_chunk_a_task(spark, monkeypatch):
    contract = common._contract

    def bounded(batches):
        held = list(batches)
        assert sum(b.num_rows for b in held) <= 300
        yield from contract(iter(held))
    monkeypatch.setattr(common, "_contract", bounded)
    links = spark.createDataFrame([(k, k + 1) for k in range(1000)], "a long, b long").coalesce(1)
    assert {r.component for r in common.components(links, 100).collect()} == {0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 15)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.choice("abd"))
            del b[r.randrange(len(b))]
        assert line_dedup.edit_distance(a, "".join(b)) == distance(a, "".join(b))


def test_similar_lines_are_told_without_a_distance(monkeypatch):
    """What ``similar`` says is what the distance says; lines that differ by a
    few words, or by most letters, do not go through it."""
    r = random.Random(3)

    def changed(words):
        words = list(words)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(words))
            words[k:k + r.randint(0, 1)] = r.choice([["a"], ["bx", "éé"], ["q"], []])
            words = words or ["q"]
        return words
    for _ in range(2000):
        a = [r.choice(["a", "bb", "é", "ccc", "dd", "xyz"]) for _ in range(r.randint(1, 12))]
        x, y = " ".join(a), " ".join(changed(a))
        d, most = distance(x, y), r.randint(0, 8)
        got = line_dedup.edit_distance(x, y, most)
        assert got == d if d <= most else got > most
        assert line_dedup.similar(x, y) == (d <= (1 - line_dedup.SIMILAR) * max(len(x), len(y)) + 1e-9)
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *_: pytest.fail("a distance was asked for"))
    words = prose(60, 77).split(" ")
    for k in (0, 30, 59):
        for other in ([*words[:k], "new", *words[k:]], words[:k] + words[k + 1:], [*words[:k], "other", *words[k + 1:]]):
            assert line_dedup.similar(" ".join(words), " ".join(other))
    assert not line_dedup.similar("a" * 50 + " b", "c" * 50 + " b")


def test_lines_match_brute_force(spark):
    r = random.Random(2)
    base = [prose(60, 300 + k) for k in range(6)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(6):
            words = r.choice(base).split(" ")
            if r.random() < 0.6:
                words[r.randrange(len(words))] += r.choice(["a", "!", "9"])
            lines.append(" ".join(words).upper() if r.random() < 0.2 else " ".join(words))
        rows.append((d, "\n".join(lines + ["", "***"])))
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "", 2, "") for i, t in rows], SCHEMA)
    place, norm = {}, {}
    for d, t in rows:
        for k, line in enumerate(line_dedup.normal_lines(t)):
            if line.split():
                norm.setdefault(b" ".join(line.split()).decode(), []).append((d, k))
    names = list(norm)
    links = [(a, b) for a, b in itertools.combinations(names, 2)
             if abs(len(a) - len(b)) <= (1 - line_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9
             and line_dedup.edit_distance(a, b) <= (1 - line_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9]
    kept = defaultdict(list)
    for n, g in groups(names, links).items():
        kept[g] += norm[n]
    stay = {min(v) for v in kept.values()}
    every = {p for v in norm.values() for p in v}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) in stay or (d, k) not in every) for d, t in rows}
    got = {x.doc_id: x.kept for x in line_dedup.dedup_lines(docs, with_text=True).collect()}
    assert links and got == want
    again = {x.doc_id: x.text for x in line_dedup.without_repeats(docs).collect()}
    assert again == want


def change(words, how, r):
    """One letter changed, a word added or left out, or two words changed."""
    words = list(words)
    k = r.randrange(len(words))
    if how == "letter":
        i = r.randrange(len(words[k]))
        words[k] = words[k][:i] + r.choice([c for c in "qzjxv" if c != words[k][i]]) + words[k][i + 1:]
    elif how == "added":
        words.insert(k, "new")
    elif how == "left out":
        del words[k]
    else:
        for k in r.sample(range(len(words)), 2):
            words[k] += r.choice("qzjxv")
    return words


@pytest.mark.parametrize(("how", "least"), [("letter", 0.99), ("added", 0.9), ("left out", 0.9), ("two letters", 0.9)])
def test_near_equal_lines_are_found(spark, how, least):
    """By edit similarity alone, whatever the fingerprints say."""
    r = random.Random(how)
    pool = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    lengths = [8, 10, 20, 40, 80, 200] if how == "two letters" else [6, 10, 20, 40, 80, 200]
    rows, want = [], {n: set() for n in lengths}
    for n in lengths:
        for _ in range(100):
            words = [r.choice(pool) for _ in range(n)]
            other = change(words, how, r)
            d = len(rows)
            rows += [(d, " ".join(words)), (d + 1, " ".join(other))]
            a, b = rows[-2][1], rows[-1][1]
            if line_dedup.edit_distance(a, b) <= (1 - line_dedup.SIMILAR) * max(len(a), len(b)):
                want[n].add(d + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.dedup_lines(docs).where("n_removed = 1").collect()}
    assert gone <= set().union(*want.values())
    recall = {n: len(gone & w) / len(w) for n, w in want.items()}
    assert all(len(w) >= 40 for w in want.values()) and min(recall.values()) >= least, recall


def test_blocks_of_short_lines_and_repeated_words():
    lines = [b"a", b"a b", b"a b c", b"a a a a", b"a b c d e f g", b"x " * 600, b"a b c d e f g h i j k"]
    words = [x.split() for x in lines]
    near, bag, n, held = line_dedup.fingerprints(words)
    assert n.tolist() == [len(w) for w in words]
    for row, w in zip(line_dedup.quarters(n), words, strict=True):
        assert row.tolist() == [sum(i * 4 // len(w) == g for i in range(len(w))) for g in range(4)]
    key, whose = line_dedup.keys_of(near, bag, n, held)
    own = [set(key[whose == k].tolist()) for k in range(len(lines))]
    assert sum(map(len, own)) == len(key) and not own[0] and own[1] & own[2] and not own[4] & own[6]
    again = line_dedup.fingerprints(words[::-1])
    assert near.tolist() == again[0].tolist()[::-1] and bag.tolist() == again[1].tolist()[::-1]


def test_words_are_hashed_together_as_one_by_one():
    r = random.Random(11)
    words = [r.randbytes(r.randint(1, 24)) for _ in range(5000)]
    end = np.cumsum([len(w) for w in words])
    begin = end - np.array([len(w) for w in words])
    assert word_hashes.word_hashes(b"".join(words), begin, end).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert word_hashes.word_hashes(b"", begin[:0], end[:0]).tolist() == []


def test_lines_take_no_call_a_word(monkeypatch):
    """Words of up to 16 bytes are not hashed one at a time, and lines are
    what normalising one at a time gives."""
    monkeypatch.setattr(shingles.WordHashes, "__missing__", lambda *_: pytest.fail("a word was hashed alone"))
    shingles.KNOWN.clear()
    texts = ["Ab  c!d\n\n - \n  \u00e9t\u00e9 99 ", "", "\n", "\u65e5\u672c x\r\ty\x00z", "w " * 1500 + "\nv"]
    batch = pa.record_batch({"doc_id": pa.array([7, None, 8, 9, 9]), "rid": pa.array(range(5)), "text": texts})
    got = pa.Table.from_batches(line_dedup._find_lines(iter([batch]))).to_pylist()
    want = [(batch["doc_id"][i].as_py(), i, k, line.split()) for i, t in enumerate(texts)
            for k, line in enumerate(line_dedup.normal_lines(t)) if line.split()]
    assert [(x["doc_id"], x["rid"], x["line"], x["words"], x["length"]) for x in got] == [
        (d, i, k, len(w), len(b" ".join(w).decode())) for d, i, k, w in want]
    assert [x["h1"] for x in got] == [int.from_bytes(xxhash.xxh3_128_digest(b" ".join(w))[:8], "little", signed=True) for *_, w in want]
    shingles.KNOWN.clear()


def test_lines_are_compared_without_what_they_share(monkeypatch):
    """Beginnings and ends of any length; a rest that is short enough is not
    looked into word by word."""
    r = random.Random(13)
    for _ in range(300):
        x, y, a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(4))
        a, b = x + a + y, x + b + y
        c, d = line_dedup.apart(a, b)
        assert len(a) - len(c) == len(b) - len(d) and distance(a, b) == distance(c, d)
        assert not c or not d or c[0] != d[0] and c[-1] != d[-1]
    for _ in range(20):  # an edit distance is right across the steps it is looked at
        a = "".join(r.choice("abc") for _ in range(r.randint(60, 140)))
        b = "".join(r.choice([c, c, c, c, "", "ab", "d"]) for c in a)
        d, most = distance(a, b), r.randint(0, 80)
        got = line_dedup.edit_distance(a, b, most)
        assert line_dedup.edit_distance(a, b) == d and (got == d if d <= most else most < got <= d)
    monkeypatch.setattr(line_dedup, "by_words", lambda *_: pytest.fail("words were compared"))
    words = prose(60, 78).split(" ")
    assert line_dedup.similar(" ".join(words), " ".join([*words[:30], "new", *words[31:]]))


def test_lines_of_packed_texts():
    import zstandard

    texts = ["Ab  c!d\n\n - \n  \u00e9T\u00c9 99 ", "", "\u65e5\u672c x\r\ty\x00z", "w " * 1500 + "\nV"]
    raw = [zstandard.ZstdCompressor(level=1).compress(t.encode()) for t in texts]
    got = [pa.Table.from_batches(line_dedup._find_lines(iter([pa.record_batch({"doc_id": [3, 2, 1, 0], "rid": range(4), "text": x})])))
           for x in (pa.array(texts), pa.array(raw, pa.binary()))]
    assert got[0].num_rows == 5 and got[0].equals(got[1])
    assert got[0]["length"].to_pylist() == [len(" ".join(x)) for x in (["ab", "c", "d"], ["\u00e9t\u00e9", "00"],
                                                                        ["\u65e5\u672c", "x", "y", "z"], ["w"] * 1500, ["v"])]


def test_few_links_take_one_table_and_no_shuffle(spark, monkeypatch):
    """Links that one chunk holds: repeated, turned round and of an id with
    itself, in many files; their components are written once, as read."""
    links = common.pin(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5), (9, 8), (2, 3)], "a long, b long").repartition(6))
    plans, pin = [], common.pin
    monkeypatch.setattr(common, "pin", lambda df, *a: (plans.append(df._jdf.queryExecution().toString()), pin(df, *a))[1])
    got = common.components(links).collect()
    assert sorted((x.id, x.component) for x in got) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_first_lines_stay_of_equal_and_linked_ones(spark):
    """Groups of equal lines, linked ones and both: the texts are shuffled
    packed, as they are written, and of each group one line stays."""
    a, b = prose(40, 501).split(" "), prose(40, 502).split(" ")
    a1, a2 = " ".join([*a, "new"]), " ".join(["old", *a[1:]])
    a, b = " ".join(a), " ".join(b)
    rows = [(9, f"{a}\n{a}\n{b}"), (7, f"x\n{a1}"), (8, f"{b}\n{b}"), (3, f"{a2}\n{a1}\n{a1}"), (None, f"{b}\nonly here")]
    got = {x.doc_id: x.kept for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {None: f"{b}\nonly here", 3: a2, 7: "x", 8: "", 9: ""}


def test_keys_that_meet_go_packed():
    """A row for each range of keys, not for each key, tells all that meet."""
    r = np.random.default_rng(12)
    n = 4000
    batch = pa.record_batch({"near": r.integers(0, 1 << 62, n), "bag": r.integers(0, 1 << 62, n),
                             "words": r.integers(1, 60, n).astype(np.int32), "held": r.integers(0, 1 << 30, n).astype(np.int32)})
    batches = [batch.slice(0, 1000), batch.slice(500, 3000), *[batch.slice(0, 7)] * 5]
    key, count = np.unique(np.concatenate([line_dedup._keys(b)[0] for b in batches]).view(np.int64), return_counts=True)
    for parts in (1, 7, 50):
        rows = [x for b in batches for x in line_dedup._find_keys(iter([b]), parts)]
        assert all(x.num_rows <= parts for x in rows)
        met, = line_dedup._met_again(iter(rows))
        assert met["bucket"].to_pylist() == key[count > 1].tolist()
    assert not list(line_dedup._met_again(line_dedup._find_keys(iter([]), 7)))


def test_lines_awkward_and_empty(spark):
    docs = awkward(spark)
    got = line_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (5, None) in texts and (4, "") in texts and (6, " \t\n ") in texts
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_repeated_rows_are_rows_of_their_own(spark):
    """Rows equal in id and text, null ids among them, and one id with two texts."""
    a, b, c, d = (prose(60, 900 + k) for k in range(4))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, a), (2, c), (3, d)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "", 2, "") for i, t in rows], SCHEMA)
    cut = sorted((r.doc_id or 0, r.text) for r in line_dedup.without_repeats(docs).collect())
    assert cut == sorted([(1, a), (1, ""), (0, b), (0, ""), (2, ""), (2, c), (3, d)])
    assert sum(r.n_removed for r in line_dedup.dedup_lines(docs).collect()) == 3
    near = near_dups.near_duplicates(docs).collect()
    assert len(near) == 7 and sorted((r.doc_id or 0) for r in near if r.stays) == [0, 1, 2, 3]
    assert all(r.kept == (r.doc_id == r.component_id) for r in near)
    left = corpus_pipeline.documents_once(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, a), (0, b), (2, c), (3, d)])


def test_neighbours_recall_and_rules(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24))
    x[::50] = x[7]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23),
                                                        (5060, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for q in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        best = [v for v in np.lexsort((np.arange(len(x)), -s)) if v != q][:20]
        hit += len(set(best) & {v for _, v, _ in found})
        assert [k for k, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-z, v) for _, v, z in found] == sorted((-z, v) for _, v, z in found)
        assert np.allclose([z for *_, z in found], [s[v] for _, v, _ in found])
    assert hit / (20 * len(got)) >= 0.9
    few = neighbours.nearest(df.where("vec_id < 8")).collect()
    assert sorted(v.vec_id for v in few) == list(range(1, 8))
    assert neighbours.nearest(df.where("false")).count() == 0


def test_rows_with_one_id_are_queries_and_candidates_of_their_own(spark):
    """Repeated rows, and one id with two vectors."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 6)).round(3)
    rows = [(k // 3 * 10, v.tolist()) for k, v in enumerate(x)] + [(20, x[6].tolist()), (20, x[6].tolist()), (35, x[6].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scores = [(-float(np.cumsum(np.array(v) * np.array(u))[-1]), j) for c, (j, u) in enumerate(rows) if c != q]
            want += [(i, k, j, round(-z, 9)) for k, (z, j) in enumerate(sorted(scores)[:7], 1)]
    got = [(g.query_id, g.rank, g.vec_id, round(g.score, 9)) for g in neighbours.nearest(df, k=7).collect()]
    assert sorted(got) == sorted(want)
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])] * 5, "vec_id long, embedding array<double>"), k=3).count() == 15


def plain_targets(sizes, weights, share=1.5, most=2.0):
    total, out, rest = share * sum(sizes), {}, set(range(len(sizes)))
    while True:
        left = total - sum(out.values())
        w = sum(weights[k] for k in rest)
        over = {k for k in rest if left * weights[k] / w > most * sizes[k]}
        if not over:
            return {**out, **{k: left * weights[k] / w for k in rest}}
        out |= {k: most * sizes[k] for k in over}
        rest -= over


def test_mixing_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, prose(r.randint(1, 80)), "en", s, 1, 2, "", 3, "") for i, s in
            enumerate(r.choices(["a", "b", "c", None, "é"], [50, 3, 30, 10, 9], k=900))]
    rows += [(5000, None, None, "only empty", None, None, None, None, None), (5001, "x", None, "b", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.copies(docs).toPandas()
    assert len(got) == len(rows) and list(got.columns)[:4] == ["doc_id", "text", "lang", "source"]
    sources = ["a", "b", "c", "only empty", "é", None]
    size = [sum(len((t[1] or "").split()) for t in rows if t[3] == s) for s in sources]
    want = plain_targets(size, [5, 2, 1, 5, 2, 1])
    for k, s in enumerate(sources):
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert np.allclose(own.target, want[k]) and (own.source_size == size[k]).all()
        assert abs((own["size"] * own.copies).sum() - want[k]) <= 3
        assert (own.copies <= 2).all()
    again = mixing.copies(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))
    assert mixing.mixed(docs).count() == got.copies.sum() and mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("make", [awkward, empty])
def test_mixing_awkward(spark, make):
    docs = make(spark)
    assert mixing.copies(docs).count() == docs.count()
    # own columns named like the operator's keep their values
    left = mixing.mixed(docs)
    assert left.columns == docs.columns
    own = lambda rows: {(r.doc_id, r.text, r.size, r.rate, r.row) for r in rows}
    assert own(left.collect()) <= own(docs.collect())


def test_shingles_of_short_texts():
    s = shingles.shingle_set
    assert len(s(b"")) == len(s(b" \n\t")) == 0
    assert len(s(b"a b c")) == 1 and (s(b"A  b\x0bc") == s(b"a b c")).all()
    assert len(s(b"a b c d e f")) == 2 and s(b"a b") != s(b"b a")
