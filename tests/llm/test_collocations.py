"""Phrase collocations: against SQL, a plain version, and odd rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from alphaloom.llm import collocations, registry
from tests.oracle import connect, differences

DATA = "/root/testdata/sf0.001"


def test_op11_against_sql(spark):
    bad = differences(registry.QUERIES["op11_collocations"](spark, DATA), connect(DATA), registry.ORACLE["op11_collocations"])
    assert not bad, bad[:5]


def plain(rows, longest, least, cover, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            if 100 * longer[p] >= cover * a and p in longer:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(n, seed=5):
    rng = random.Random(seed)
    words = ["The", "of", "é x", "-", "z'", "Word", "\U0001f600", "a\x00b", "q"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(["hot dog stand", "kept in mind always", *words]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "!?", "  "])
        rows.append((rng.choice(["en", "de", None, "und", "a b"]), text))
    return [*rows, ("en", None), ("en", ""), (None, " \t "), ("en", "..."), ("fr", None)]


@pytest.mark.parametrize("longest,block", [(2, 300), (3, 1_000), (5, 4_000), (4, 8 << 20)])
def test_against_plain(spark, longest, block):
    """Blocks of few bytes, so that phrases are spread over many."""
    rows = made(150)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("ids", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(docs, longest=longest, least=4, cover=60, top=25, block=block).collect())
    assert got == plain(rows, longest, 4, 60, 25) and len(got) > 60


def test_odd_tables(spark):
    docs = spark.createDataFrame(made(3), "lang string, text string")
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.select("lang", F.lit(None).alias("text"))).count() == 0
    assert collocations.mine(docs, least=1_000_000).count() == 0
    long = spark.createDataFrame([("en", "new york " * 120_000 + "x " * 50_000), ("en", "york")], "lang string, text string")
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in collocations.mine(long, longest=2).collect()}
    assert got == {"new york": (120_000, 120_000, 120_001, 290_001), "york new": (119_999, 120_001, 120_000, 290_001), "x x": (49_999, 50_000, 50_000, 290_001)}


def test_scores_are_exact(spark):
    a, left, right = 999_999_999_999, 10**14 + 7, 10**12 + 1
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(collocations.ratio(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)
