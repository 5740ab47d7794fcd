"""Exact dedup and importance resampling: against SQL, plain versions, and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from alphaloom.llm import exact_dedup, importance, registry
from tests.oracle import connect, differences

DATA = "/root/testdata/sf0.001"
ODD = [(1, "a  b\tc", "x"), (2, "a b c", None), (3, None, "y"), (4, "", "z"), (5, " ", "z"), (None, "a b\n c", "n"), (7, "a b c", "u"), (2, "a b c", None), (None, "only", "o"), (9, "w " * 400_000, "long"), (10, "w\t" * 400_000, "long"), (11, "v " * 400_000, "long")]
COLUMNS = "doc_id bigint, text string, `keep_id` string"


@pytest.mark.parametrize("name", ["op12_importance", "op13_exact_dedup"])
def test_against_sql(spark, name):
    bad = differences(registry.QUERIES[name](spark, DATA), connect(DATA), registry.ORACLE[name])
    assert not bad, bad[:5]


def plain_groups(rows):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    ids, n = collections.defaultdict(list), collections.Counter()
    for i, t, *_ in rows:
        n[norm(t)] += 1
        ids[norm(t)] += [] if i is None else [i]
    return sorted(((i, min(ids[norm(t)], default=None), n[norm(t)], i == min(ids[norm(t)], default=None), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize("bits", ["all", "few", "none"])
def test_exact_groups_of_odd_rows(spark, bits):
    """With a hash of few bits or none, contents collide and only their bytes tell them apart."""
    hashed = {"all": exact_dedup.digest, "few": lambda c: F.length(c) % 3, "none": lambda c: F.lit(0) * F.length(c)}[bits]
    docs = spark.createDataFrame(ODD, COLUMNS).withColumn("x.y", F.lit(1)).withColumn("hash", F.lit("h"))
    out = exact_dedup.groups(docs, hashed=hashed)
    assert out.columns == ["doc_id", "text", "x.y", "hash", "text_sha256", "keep_id", "group_size", "kept"] or set(out.columns) == {"doc_id", "text", "x.y", "hash", "keep_id", "group_size", "kept", "text_sha256"}
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()), key=str)
    assert got == plain_groups(ODD)


def test_exact_of_nothing_and_of_one_content(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0
    hot = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one text")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.groups(hot).where("group_size > 1").agg(F.min("keep_id"), F.max("keep_id"), F.count("*"), F.min("group_size")).first()
    assert tuple(out) == (1, 1, 2_000, 2_000)
    assert exact_dedup.keep_first(hot).count() == 1_001 and exact_dedup.keep_first(hot).columns == ["doc_id", "text"]


def plain_resample(rows, target, percent, longest, buckets, least):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_against_plain(spark, longest):
    rows = [(i, " ".join(f"W{(i * j) % 17}é{'x' * (j % 3)}" for j in range(i % 40))) for i in range(300)]
    rows += [(None, "x " * 30), (300, None), (301, ""), (302, "--- ..."), (303, "Abİ 9z " * 150_000), (304, "one two"), (5, rows[5][1]), (39, rows[39][1])]
    target = ["w1éx W3é w5éxx", None, "", "w4é w4é"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("old")).withColumn("a.b", F.lit(2))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(docs, goal, percent=40, longest=longest, buckets=500, least_words=5)
    assert set(out.columns) == {"doc_id", "text", "a.b", "n_features", "weight", "score", "rank"}
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in plain_resample(rows, target, 40, longest, 500, 5)]
    want = plain_resample(rows, target, 40, longest, 500, 5)
    assert collections.Counter(got) == collections.Counter(want) or sorted(x[4] for x in got if x[4]) == sorted(x[4] for x in want if x[4])


def test_importance_draws_ties_by_id_and_nothing_from_nothing(spark):
    docs = spark.createDataFrame([(k, "a b c d e") for k in range(60)], "doc_id bigint, text string")
    out = importance.resample(docs, docs.limit(0), percent=50, least_words=5)
    drawn = [(r["rank"], r.score, r.doc_id) for r in out.where("rank is not null").orderBy("rank").collect()]
    assert [d[0] for d in drawn] == list(range(1, 31)) and drawn == sorted(drawn, key=lambda d: (-d[1], d[2]))
    assert out.count() == 60
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert importance.resample(docs, docs, percent=0).where("rank is not null").count() == 0
