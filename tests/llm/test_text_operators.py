"""Tokenizers, suffix dedup, SimHash, decontamination, language-model scores on small texts with every odd case."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import bpe, decontaminate, lm_score, simhash, suffix_dedup, token_count

from . import brute

RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces \n", "\nfoo bar", "▁x ▁", "日本語 テスト 😀", "tab\tand\r\ncr", "<s> hi </s><0x0A><|endoftext|>", "\x00x", "don't we'll I'm", "x" * 5000, "ab" * 3000 + " " + "é" * 100, " ".join(f"w{i}" for i in range(4000))]


def frame(spark, rows, ddl="doc_id bigint, text string"):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def odd(spark):
    # ids repeat and are null; a column's name clashes with those made
    rows = [(i % 7 or None, t, i) for i, t in enumerate(ODD)] + [(3, "a", 99)]
    return frame(spark, rows, "doc_id bigint, text string, n_tokens int")


def test_token_count(spark, odd):
    import sentencepiece

    spm = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_count.count_tokens(odd, PIECES).collect())
    texts = [*ODD, "a"]
    assert got == sorted((len((t or "").encode()), len(spm.encode(t or ""))) for t in texts)
    assert token_count.count_tokens(odd.limit(0), PIECES).count() == 0
    rng = random.Random(1)
    counter = token_count.PieceCounter(PIECES, remember=50)
    for _ in range(500):
        t = "".join(rng.choice("ab é\n\t  ción日😀'▁l12.,!x") for _ in range(rng.randint(0, 60)))
        assert counter.count(t) == len(spm.encode(t)), t
        counter.trim()


def test_byte_bpe(spark, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(odd, RANKS, P.PATTERN, decoded="back")
    assert out.columns == [*odd.columns, "ids", "back"]
    for r in out.collect():
        assert r.ids == own.encode_ordinary(r.text or "") and r.back == (r.text or "")
    again = bpe.decode(out, RANKS, P.PATTERN, text="twice").collect()
    assert all(r.twice == r.back for r in again)
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0
    codec = bpe.Codec(RANKS, P.PATTERN, remember=20)
    codec.fst.limit = 50  # states are dropped and made again
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice("ab é\n\t  ción日😀'sll12.,!x  ththe") for _ in range(rng.randint(0, 60)))
        assert codec.encode(t) == own.encode_ordinary(t), t
        codec.trim()


def test_utf8_stream():
    data = "aé日😀ࠀ퟿".encode() + b"\xff\xe2\x82" + "z".encode() + b"\xf0\x9f"
    for size in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        parts = [s.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join([*parts, s.feed(b"", last=True)]) == data.decode("utf-8", "replace")


def _repeating(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    texts += [t[: rng.randint(0, len(t))] + shared + t for t in texts[:12]]
    texts += [texts[3], texts[4], "ab" * 300, "The The The " * 40, "q" * 99, "q" * 100, "q" * 250, "", None, "é" * 200]
    return texts


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup(spark, hot):
    texts = _repeating(random.Random(5))
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    rows += [(7, texts[7], "k"), (None, texts[2], "null id"), (9, texts[5], "same id")]
    docs = frame(spark, rows, "doc_id bigint, text string, kept string").repartition(5)
    out = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert len(out) == len(rows)
    # a document is its id and text; a null id is last; texts of one id are in the order of a hash
    import xxhash

    order = sorted({(i if i is not None else 2**63 - 1, np.uint64(xxhash.xxh3_64_intdigest((t or "").encode())).astype(np.int64).item(), (t or "").encode()) for i, t, _ in rows})
    masks = brute.repeats([(k, b) for *k, b in order])
    want = {(i, b): bytes(np.frombuffer(b, np.uint8)[~m]) for (i, _, b), m in zip(order, masks)}
    for r in out:
        b = (r.text or "").encode()
        kept = want[(r.doc_id if r.doc_id is not None else 2**63 - 1, b)]
        assert bytes(r.kept) == kept and r.n_removed == len(b) - len(kept) and r.n_bytes == len(b)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_simhash(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["the", "of", "cat", "dog", "runs", "blue"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts = base + [t + " Tail" for t in base[:30]] + [t.upper() for t in base[:10]] + ["", None, "  \n", "one", "one two", "x" * 9000]
    docs = frame(spark, [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])])
    got = simhash.near_duplicates(docs).collect()
    fps = [brute.simhash(t) for t in texts]
    low = brute.components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert len(got) == len(texts) + 1
    for r in got:
        i = r.doc_id - 100
        assert r.fp % 2**64 == fps[i] and r.component_id == 100 + low[i]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b c"), (5, "a b c"), (None, "other words here")])).where("component_id = 5").count() == 2
    # parts dealt again when they are crowded give the same links
    from alphaloom.llm.common import Scratch

    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in set(fps)], "fp bigint").withColumn("first", F.col("fp"))
    a = {(r.fp, r.component) for r in simhash.link(nodes, Scratch(spark, "t"), 3).collect()}
    b = {(r.fp, r.component) for r in simhash.link(nodes, Scratch(spark, "t"), 3, hot=1).collect()}
    assert a == b and a


def test_similar_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    base = [[word() for _ in range(200)] for _ in range(40)]
    near = [[*t[:50], word(), *t[51:120], word(), *t[121:]] for t in base[:20]]  # similarity 0.9
    docs = frame(spark, [(i, " ".join(t)) for i, t in enumerate(base + near)] + [(900, None), (901, ""), (902, None)])
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    assert sum(got[40 + i] == i for i in range(20)) >= 19 and all(got[i] == i for i in range(40))
    assert got[900] == got[901] == got[902] == 900
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert set(range(40)) <= kept and 901 not in kept
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_similar_texts_are_checked_by_their_shingles(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(60)]

    def changed(t, n):  # n words far apart: 5n of 296 shingles
        t = list(t)
        for k in range(n):
            t[5 + k * (290 // n)] = word()
        return t

    near = [changed(t, 3 + k % 15) for k, t in enumerate(base)]  # 0.9 to 0.55 alike
    line = [word() for _ in range(10)]
    footer = [[*[word() for _ in range(60)], *line * 30] for _ in range(20)]  # 0.08 alike
    group = [changed(base[0], 1) for _ in range(60)]  # one crowded group of near copies
    texts = base + near + footer + group
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    low = brute.components(len(texts), pairs)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert all(low[got[i]] == low[i] for i in range(len(texts)))  # nothing below 0.8 is linked
    assert sum(got[i] == low[i] for i in range(len(texts))) >= 0.97 * len(texts)


def test_decontaminate(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(rng.randint(15, 60)) for _ in range(20)]
    docs = [text(rng.randint(1, 300)) for _ in range(60)]
    for i in range(20):
        passage = items[i].split()
        if i % 2:  # a paraphrase: every eighth word another, one dropped
            passage = [word() if k % 8 == 3 else w for k, w in enumerate(passage) if k != 5]
        docs[i] = f"{docs[i]}\n{' '.join(passage).capitalize()}. {text(80)}"
    rows = [(i, t) for i, t in enumerate(docs)] + [(0, docs[0]), (None, docs[1]), (70, None), (71, ""), (72, items[4] * 1)]
    df = frame(spark, rows, "doc_id bigint, text string").withColumn("leaks", F.lit(1))
    bench = frame(spark, [(i, t) for i, t in enumerate(items)] + [(None, items[0]), (50, None), (51, "")], "item_id bigint, text string")
    got = decontaminate.find_leaks(df, bench).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id").collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == {(i, i) for i in range(20)} | {(None, 1), (72, 4)}
    assert sum(1 for r in got if r.doc_id == 0) == 2
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_leaks(df, bench, max_words=3)


def test_decontaminate_leaks_in_many_rows(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [word() for _ in range(30)]
    items = [text(40), text(25), " ".join(common[:20]), text(30)]
    docs = [f"{text(60)} {' '.join(rng.sample(common, 12))} {text(60)}" for _ in range(300)]
    for i in range(100):  # a third of the rows, each in other surroundings
        docs[i] = f"{text(rng.randint(0, 90))} {items[0]} {docs[i]}"
    docs[150] += " " + " ".join(items[1].split()[3:])
    docs[160] += f" {items[2]} {text(50)}"  # words that are in most rows
    df = frame(spark, [*enumerate(docs), *((1000 + i, docs[0]) for i in range(50))], "doc_id bigint, text string")
    got = decontaminate.find_leaks(df, frame(spark, list(enumerate(items)), "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in got.select("doc_id", F.explode("leaks.item_id").alias("item_id")).collect()}
    assert found == {*((i, 0) for i in range(100)), *((1000 + i, 0) for i in range(50)), (150, 1), (160, 2)}


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([bytes([rng.randint(97, 101)]) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate.masks_of(a), len(a), b) == t[-1, -1]


def test_lm_score(spark):
    docs = [(1, "a b a b c"), (2, "a b c d"), (3, "z z z q"), (None, "a"), (4, None), (5, ""), (1, "b a")]
    df = frame(spark, docs).withColumn("n_tokens", F.lit("clash"))
    out = lm_score.score(df, frame(spark, [(1, None), (2, None), (None, None)]), vocabulary=4).collect()
    words = lm_score.shared_vocabulary(df, 4, "text")
    assert words == [b"a", b"b", b"z", b"c"]
    known = {w: i + 2 for i, w in enumerate(words)}
    n, tables = len(words) + 2, np.zeros((2, 6, 6))
    ids = lambda t: [1, *(known.get(w.encode(), 0) for w in (t or "").lower().split()), 1]
    for d, t in docs:
        x = ids(t)
        for a, b in zip(x, x[1:]):
            tables[1, a, b] += 1
            tables[0, a, b] += d in (1, 2)

    def loss(c, every, a, b):
        spare = 0.5 * c.sum() / every.sum()
        single = (c[:, b].sum() + spare) / (c.sum() + spare * n)
        before = c[a].sum()
        return -np.log(max(c[a, b] - 0.75, 0) / max(before, 1) + (0.75 * (c[a] > 0).sum() / before if before else 1) * single)

    for r in out:
        x = ids(r.text)
        others = tables.copy()
        for d, t in docs:  # a text and its copies (null: empty) are not in the models it is scored by
            if (t or "") == (r.text or ""):
                for a, b in zip(x, x[1:]):
                    others[1, a, b] -= 1
                    others[0, a, b] -= d in (1, 2)
        want = [np.mean([loss(c, others[1], a, b) for a, b in zip(x, x[1:])]) for c in others]
        assert np.allclose([r.target_loss, r.background_loss, r.difference], [*want, want[0] - want[1]], atol=1e-5)
        assert r.n_tokens == len(x) - 1
    assert lm_score.score(df.limit(0), frame(spark, []), vocabulary=4).count() == 0


def test_lm_score_knows_rare_words(spark):
    """Documents of words that are all rarer than the 2,000 most frequent still tell target from background."""
    rng = random.Random(20)
    often = [f"c{i}" for i in range(2100)]
    rare = [[f"r{k}x{i}" for i in range(40)] for k in range(2)]
    docs = [(i, " ".join(often)) for i in range(10)]
    docs += [(100 + i, " ".join(rng.choice(rare[i % 2]) for _ in range(30))) for i in range(8)]
    out = {r.doc_id: r for r in lm_score.score(frame(spark, docs), frame(spark, [(i, None) for i in (100, 102, 104)])).collect()}
    assert max(out[i].difference for i in (100, 102, 104, 106)) < min(out[i].difference for i in (101, 103, 105, 107))
    words = {w for _, t in docs for w in t.split()}
    counts = [sum(t.split().count("r0x1") for i, t in docs if i in some) for some in ({100, 102, 104}, set(dict(docs)))]
    assert counts[1] >= counts[0] > 0 and len(words) > 2_000
    assert out[0].n_tokens == 2101 and out[100].n_tokens == 31


@pytest.mark.parametrize("rows", [37, 1000])
def test_crowded_parts(rows):
    """Parts and cells with groups of near copies, in small and large batches, against all pairs."""
    rng = np.random.default_rng(rows)
    refs = simhash.pivots(8, 4)
    for distance in (10, 30, 48):
        n = 500
        fp = rng.integers(0, 2**64, (9, 4), dtype=np.uint64)[rng.integers(0, 9, n)]
        for k in range(n):
            for b in rng.integers(0, 256, rng.integers(0, 30)).tolist():
                fp[k, b // 64] ^= np.uint64(1 << (b % 64))
        apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
        part = rng.integers(0, 3, n)
        order = np.lexsort((np.bitwise_count(fp ^ refs[0]).sum(axis=1), part))
        batches = [
            pa.RecordBatch.from_arrays([pa.array(part[o]), pa.array(o), pa.array([x.tobytes() for x in fp[o]], pa.binary())], names=["part", "node", "fp"])
            for o in (order[i : i + rows] for i in range(0, n, rows))
        ]
        got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in simhash.link_partition(iter(batches), refs, distance)]
        want = np.argwhere((apart <= distance) & (part[:, None] == part))
        assert np.array_equal(simhash.forest(np.concatenate(got), n), simhash.forest(want, n))
        sets = [np.unique(rng.integers(0, 60, 40)).astype("<u4") for _ in range(n)]
        alike = [(i, j) for i, j in np.argwhere(apart <= distance).tolist() if i < j and len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))]
        links = simhash.similar_in_cell(fp, sets, np.arange(n), np.arange(n), distance, 0.4)
        assert np.array_equal(simhash.forest(np.array(links), n), simhash.forest(np.array(alike), n))


def test_keep_one_of_many_near_copies(spark):
    """Some thousands of copies with one word changed are one group."""
    base = [f"word{i}" for i in range(120)]
    docs = [(i, " ".join([*base[: i % 120], f"other{i}", *base[i % 120 + 1 :]])) for i in range(4000)] + [(4000 + i, f"text {i} of its own kind with words {i * 7} {i * 11} {i * 13}") for i in range(20)]
    out = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)).collect()
    assert sorted(r.doc_id for r in out) == [0, *range(4000, 4020)]
