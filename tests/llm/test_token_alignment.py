"""Operator 13 against counting links text by text."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from arrears.llm import token_alignment as op
from tests.llm.cases import awkward, empty


def plain(texts):
    """A row of numbers for each text, and the links of each pair."""
    one = Tokenizer.from_file(f"{op.TOKENIZERS}/{op.BYTE_LEVEL}")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{op.TOKENIZERS}/{op.PIECES}")
    letters = op.byte_level_alphabet()
    each, links, docs = [], Counter(), defaultdict(set)
    for k, text in enumerate(texts):
        tokens = [[], []]
        if text:
            tokens[0] = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            tokens[1] = [(i, bytes([int(two.id_to_piece(i)[1:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())
                         for i in two.encode(text)]
            if any(b"".join(b for _, b in t) != (" " + text).encode() for t in tokens):
                tokens = [[], []]
        ends = []
        for t in tokens:
            at, own = 0, {}
            for i, b in t:
                at += len(b)
                own[at] = i
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        pairs = [(ends[0][e], ends[1][e]) for e in common]
        held = [defaultdict(list), defaultdict(list)]
        for own, into in zip(ends, held, strict=True):
            for e in own:
                into[common[bisect.bisect_left(common, e)]].append(str(own[e]))
        groups = ";".join("|".join(",".join(into[e]) for into in held) for e in common)
        each.append((len(tokens[0]), len(tokens[1]), pairs, groups))
        links.update(pairs)
        for p in pairs:
            docs[p].add(k)
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    rows = [(n_a, n_b, len(p), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p),
             hashlib.sha256(g.encode()).hexdigest() if n_a else "") for n_a, n_b, p, g in each]
    return rows, {p: (len(docs[p]), n, n == most[p[1]]) for p, n in links.items()}


def sample(spark):
    more = [(50, "<|endoftext|> and <s> </s> <unk> <0x41>"), (51, "a ▁ marker"), (52, "\x00\x01 \r\n\t x"), (53, " lead  and trail  "),
            (54, "日本語 テキスト ｆｕｌｌ ﬁ é é"), (55, "the " * 700)]
    rows = [(*r, None, None, None, 1, "r", 1, "i") for r in more]
    docs = awkward(spark)
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_documents_and_pairs_match_brute_force(spark):
    docs = sample(spark)
    rows = docs.collect()
    want, pairs = plain([r.text for r in rows])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got, counts = op.align(docs)
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got.collect()) == sorted(
        (str(r.doc_id), *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in counts.collect()} == pairs
    assert sum(1 for w in want if w[0]) > 10 and any(not w[0] for w in want)


def test_small_blocks_and_flushes_give_the_same(spark, monkeypatch, tmp_dir):
    docs = sample(spark).where("doc_id is null or doc_id != 11").coalesce(1)
    own, postings = op.encoded(docs)
    want = sorted(map(tuple, op.pair_counts(postings).collect()))
    pieces = postings.withColumnRenamed("docs", "d").select("pair", "block", "plane", "content").collect()
    split = []
    for r in pieces:  # every plane in two pieces, as two tasks would write them
        docs_in = op.members(r.content)
        for part in (docs_in[::2], docs_in[1::2]):
            if len(part):
                split.append((r.pair, r.block, r.plane, bytearray(part.astype("<u2").tobytes())))
    again = (spark.createDataFrame(split, "pair long, block long, plane int, content binary").repartition(3, "pair", "block")
             .sortWithinPartitions("pair", "block", "plane").mapInArrow(op._merge, "pair long, block long, plane int, content binary, links long, docs long"))
    assert sorted(map(tuple, op.pair_counts(again).collect())) == want


def test_stretches_are_encoded_as_in_the_whole_text():
    r = np.random.default_rng(6)
    words = ["lamp", "the", "don't", "", "x,", "(y)", "\n", "a\tb", "é", "日本語", "\u0301a", "\u00a0b", "\u2028", "\x1c", "▁", "12", "<s>", "\u200b", "..", "½", "²", "_"]
    texts = [" ".join(words[k] for k in r.integers(0, len(words), r.integers(1, 9))) for _ in range(3000)] + [" ", "  ", "a", ""]
    assert op.stretches("a  b c,  d \n e") == ["a  b", "c,  d \n e"]
    paths = f"{op.TOKENIZERS}/{op.BYTE_LEVEL}", f"{op.TOKENIZERS}/{op.PIECES}"
    apart, whole = op.Coder(*paths), op.Coder(*paths)
    assert apart._apart
    whole._apart = False
    for x, y in zip(apart.coded(texts), whole.coded(texts), strict=True):
        assert [v if isinstance(v, (int, str)) else v.tolist() for v in x] == [v if isinstance(v, (int, str)) else v.tolist() for v in y]


def test_planes_hold_lists_and_bitmaps():
    r = np.random.default_rng(4)
    doc = np.concatenate([r.permutation(op.BLOCK)[:n] for n in (1, 3, op.DENSE - 1, op.DENSE, 4000)])
    pair = np.repeat([5, 9, 7, 1, 8], [1, 3, op.DENSE - 1, op.DENSE, 4000])
    times = r.integers(1, 40, len(doc))
    back = Counter()
    for k, pairs, size, content in op.planes(pair, doc, times):
        for p, n, c in zip(pairs, size, content, strict=True):
            assert len(op.members(c)) == n and len(c) == (op.BLOCK // 8 if n >= op.DENSE else 2 * n)
            for d in op.members(c).tolist():
                back[int(p), d] += 1 << k
    assert back == {(p, d): t for p, d, t in zip(pair.tolist(), doc.tolist(), times.tolist(), strict=True)}
    assert op.merged([c1 := op.bitmap(np.arange(0, 600)), np.array([7, 4000], "<u2").tobytes()]) != c1


def test_query_columns_and_empty_table(spark, tmp_dir):
    assert op.align(empty(spark))[0].count() == 0
    sample(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    got = op.op13_token_alignment(spark, tmp_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
                                "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}
    assert {r.groups_sha256 for r in got.where("n_a = 0").collect()} == {""}
