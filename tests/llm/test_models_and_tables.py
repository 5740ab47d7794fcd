"""Embeddings, sharding, classifiers and the pipeline."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from alphaloom.llm import embedding_dedup, graph, quality, registry, sharding, toxicity
from alphaloom.llm.common import Scratch, held_out, read

from . import brute

SMALL = "/root/testdata/sf0.01"


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 480)] + [(5, 5)]
    edges = spark.createDataFrame(pairs + [(None, 1)], "src bigint, dst bigint")
    got = {r.node: r.component for r in graph.connected_components(edges, Scratch(spark, "t")).collect()}
    low = brute.components(500, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: low[x] for x in linked}
    assert graph.connected_components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    near = base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 24)) * rng.uniform(0.01, 0.5, (150, 1))
    vectors = [v.tolist() for v in np.concatenate([base, near, base[:5], base[:3] * 7.5])]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [None] * 24, 0), (1004, [float("inf")] * 24, 0), (1005, vectors[0], None), (1006, [1.0, 2.0], 0), (1007, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("kept", F.lit(1))
    fine = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows[: len(vectors)]]
    links = [(a, b) for a in range(len(fine)) for b in range(a) if fine[a][2] == fine[b][2] and fine[a][1] @ fine[b][1] >= 0.93]
    low = brute.components(len(fine), links)
    count = collections.Counter(x for p in links for x in p)
    for crowded in (2000, 3):
        out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, crowded=crowded).collect()}
        assert len(out) == len(rows)
        found = sum(out[i].n_links for i in range(len(fine)))
        assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
        assert all(out[i].n_links <= count[i] for i in range(len(fine)))
        assert np.mean([out[i].component_id == low[i] for i in range(len(fine))]) > 0.97
        assert all(out[i].n_links == 0 and out[i].kept for i in range(1000, 1008))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    got = {r.vec_id: r for r in registry.QUERIES["op3_embedding_dedup"](spark, "/root/testdata/sf0.1").collect()}
    e = read(spark, "/root/testdata/sf0.1", "embeddings").toPandas()
    x = np.stack(e.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T >= 0.93) & (e.label.values[:, None] == e.label.values[None])
    np.fill_diagonal(s, False)
    assert sum(r.n_links for r in got.values()) >= 0.9 * s.sum()


def test_sharding(spark):
    texts = [f"t{i}" for i in range(300)] + ["hot"] * 200 + [None] * 3 + [f"p{i // 3}" for i in range(90)]
    df = spark.createDataFrame([(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("slot", F.lit("x"))
    out = sharding.balanced_shards(df, ["text"], shards=7).collect()
    assert len(out) == len(texts)
    by = collections.defaultdict(list)
    groups = collections.defaultdict(set)
    for r in out:
        by[r.shard].append(r.slot)
        groups[r.text].add(r.shard)
    assert set(by) <= set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    small = [g for t, g in groups.items() if t and t[0] == "p"]
    assert sum(len(g) == 1 for g in small) >= 0.8 * len(small)
    assert len(groups["hot"]) <= 5
    assert sharding.balanced_shards(df.limit(0), ["text"], shards=7).count() == 0
    assert sharding.balanced_shards(df.limit(3), ["text"], shards=7).count() == 3


def test_sharding_of_a_large_class(spark):
    texts = ["hot"] * 4000 + [f"p{i // 4}" for i in range(2000)] + [f"t{i}" for i in range(6000)]
    out = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["text"]).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert len(out) == len(texts) and set(sizes.values()) == {500}
    assert len({r.shard for r in out if r.text == "hot"}) == 8


def _accuracy(spark, rows, label):
    lab = {r.doc_id: r[label] for r in read(spark, SMALL, "labels").collect()}
    rows = [r for r in rows if r.doc_id in lab and r.held_out]
    score, y = np.array([r.score for r in rows]), np.array([lab[r.doc_id] for r in rows])
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]), np.mean(np.array([r.predicted for r in rows]) == y)


def test_quality(spark):
    auc, right = _accuracy(spark, registry.QUERIES["op6_quality_crf"](spark, SMALL).collect(), "quality")
    assert auc > 0.95 and right > 0.93


def test_toxicity(spark):
    auc, right = _accuracy(spark, registry.QUERIES["op10_toxicity"](spark, SMALL).collect(), "toxic")
    assert auc > 0.8 and right > 0.93


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "You idiot. Nice day."), (2, None), (3, ""), (None, "idiot"), (1, "fine words"), (4, "a\n\n\n" * 3000)], "doc_id bigint, text string").withColumns({"quality": F.lit("x"), "toxicity": F.lit("y")})
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module, name in ((quality, "quality"), (toxicity, "toxicity")):
        model = module.train(docs, labels)  # nothing to learn from
        out = module.score(docs, model).collect()
        assert len(out) == 6 and all(0 <= r[name] <= 1 for r in out)
        assert module.score(docs.limit(0), model).count() == 0
    model = toxicity.Model(-6.0, {"idiot": 12.0})
    rows = {(r.doc_id, r.text): r for r in toxicity.score(docs, model).collect()}
    bad = rows[(1, "You idiot. Nice day.")].offending
    assert [(s.sentence, s.text) for s in bad] == [(0, "You idiot")] and rows[(2, None)].offending == []
    assert docs.where(held_out()).count() <= 6


def test_field_marginals():
    """Forward-backward against the sum over all labelings."""
    import itertools

    rng = np.random.default_rng(2)
    model = quality.Model(np.zeros(quality.FEATURES), rng.normal(size=(2, 2)))
    counts = np.array([1, 4, 3])
    odds = rng.normal(size=8)
    good, _, total = model.marginals(odds, counts)
    at = 0
    for k, n in enumerate(counts):
        z, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[at + t] * y[t] for t in range(n)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            z += w
            mass += w * np.array(y)
        assert np.allclose(good[at : at + n], mass / z) and np.isclose(total[k], np.log(z))
        at += n


def test_pipeline(spark):
    docs = read(spark, SMALL, "documents")
    scratch = Scratch(spark, "t")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, SMALL), name)
        assert docs.count() <= before.count()
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            lab = read(spark, SMALL, "labels")
            toxic, clean = (lab.where(f"toxic = {v}").join(before, "doc_id").count() for v in (1, 0))
            assert lab.where("toxic = 1").join(docs, "doc_id").count() <= 0.1 * toxic
            assert lab.where("toxic = 0").join(docs, "doc_id").count() >= 0.99 * clean
        if name == "simhash_near_dedup":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "suffix_dedup":
            rows = sorted((r.doc_id, r.text.encode()) for r in before.collect())
            got = {r.doc_id: r.text for r in docs.collect()}
            for (i, b), m in zip(rows, brute.repeats(rows)):
                assert got[i] == brute.without(b, m)
        if name == "decontamination":
            items = [r.text for r in read(spark, SMALL, "benchmark").collect()]
            left = [r.text for r in docs.collect()]
            assert not any(i in t for i in items for t in left)
        if name == "byte_bpe":
            assert docs.where("not round_trip").count() == 0 and docs.count() == before.count()
