"""The latent space of the leak search rests on all of the benchmark, on no choice of documents."""

import random

from pyspark.sql import functions as F

from alphaloom.llm import decontaminate


def test_cosines_do_not_depend_on_which_documents_hash_low(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(4_300)]
    texts[::500] = [f"{t} {items[i]}" for i, t in enumerate(texts[::500])]

    def found(mark):
        # a last word that no item has: other hashes, the same words of the benchmark
        docs = spark.createDataFrame([(i, f"{t} {mark}{i}") for i, t in enumerate(texts)], "doc_id bigint, text string")
        rows = decontaminate.find_leaks(docs, bench).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.cosine").collect()
        return {(r.doc_id, r.item_id): round(r.cosine, 4) for r in rows}

    one, other = found("xa"), found("yb")
    assert len(one) >= len(texts[::500]) and one == other
