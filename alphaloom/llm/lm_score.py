"""Cross-entropy difference of matched n-gram models over one vocabulary."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, Scratch, checked_broadcast, give_back

UNKNOWN, BORDER = 0, 1  # instead of a word's hash: any other word; a document's edges
BLOCK = 8 << 20  # bytes of text whose pairs are counted at once
HOT = 10_000  # words that are this part of all tokens or more have their pairs dealt over all buckets
LOW = np.uint64((1 << 48) - 1)  # of a hash: what names a word after a given one
TOKENS = 1 << 18  # of a block scored at once, or one text's


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased, ended by ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shared_vocabulary(docs: DataFrame, size: int, text: str) -> list[bytes]:
    """The most frequent words of all documents: what both models know, ``size`` words at most."""

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0):
                counts.update(tokens(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    per = docs.select(F.col(text).cast("string")).mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return [bytes(r.w) for r in per.orderBy(F.desc("n"), "w").limit(size).collect()]


class Hashes(dict):
    """Words' 64-bit hashes, remembered up to a bound; with ``known`` words, all others are UNKNOWN."""

    def __init__(self, known: set[bytes] | None = None, bound: int = 200_000):
        from xxhash import xxh64_intdigest

        self.hashed, self.known, self.bound = xxh64_intdigest, known, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = UNKNOWN if self.known is not None and word not in self.known else self.hashed(word)
        return value


def neighbours(texts, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word before, word) for every word and end of the texts."""
    whose, before, word = [], [], []
    for i, t in enumerate(texts):
        found = tokens(t.as_py())
        ids = np.full(len(found) + 2, BORDER, np.uint64)
        ids[1:-1] = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
        whose.append(np.full(len(found) + 1, i, np.int64))
        before.append(ids[:-1])
        word.append(ids[1:])
    return tuple(np.concatenate(x) for x in (whose, before, word))


def pair_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit hash for two words."""
    z = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (word + (before >> np.uint64(29)))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def packed_texts(batch: pa.RecordBatch) -> tuple[bytes, list[dict]]:
    """Rows (h, t, target) as one binary value: each different text once, with its target rows and all its rows; these numbers again, to be read without the texts."""
    h, first, of = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
    target = np.bincount(of, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), len(h)).astype(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(h), batch.column(1).take(pa.array(first)), pa.array(target), pa.array(np.bincount(of, minlength=len(h)).astype(np.int64))], names=["h", "t", "target", "all"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(rows)
    return sink.getvalue().to_pybytes(), rows.drop_columns("t").to_pylist()


def unpacked_texts(payload) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


COPIES = pa.list_(pa.struct([("h", pa.int64()), ("target", pa.int64()), ("all", pa.int64())]))


def make_blocks(known: set[bytes] | None):
    """Rows (h, t, target) -> blocks of some megabytes of text, with the counts of the words that are frequent in them."""

    def run(batches):
        hashes = Hashes(known)
        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
                part = whole.slice(at, to - at)
                _, _, word = neighbours(part.column(1), hashes)
                words, n = np.unique(word, return_counts=True)
                some = n * 2 * HOT >= len(word)
                frequent = [{"w": w, "n": c} for w, c in zip(words[some].view(np.int64).tolist(), n[some].tolist())]
                packed, copies = packed_texts(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([len(word)], pa.int64()), pa.array([int(ends[to - 1]) - before], pa.int64()), pa.array([frequent], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))), pa.array([copies], COPIES), pa.array([packed], pa.binary())],
                    names=["block", "n_words", "n_bytes", "frequent", "copies", "texts"],
                )
                at = to

    return run


class Entries:
    """A block's different pairs in the order of the buckets that count them: by bucket, first word, second word.

    A pair is counted in its first word's bucket; pairs of a ``hot`` first word are dealt over all buckets by
    both words, so no bucket has all of a frequent word's pairs. Words are numbered in the order of their hashes, so
    that one number orders pairs; the numbers do not leave the block. ``head`` numbers the (bucket, first word) groups.
    """

    def __init__(self, texts, hashes: Hashes, hot: np.ndarray, buckets: int):
        self.whose, before, word = neighbours(texts, hashes)
        self.words, numbers = np.unique(np.append(before, np.uint64(BORDER)), return_inverse=True)
        first, border = numbers[:-1], numbers[-1]
        # a pair's second word is the next one's first, but for a text's edge
        second = np.append(first[1:], border)
        second[np.append(self.whose[1:] != self.whose[:-1], True)] = border
        size = len(self.words)
        of_word = (self.words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
        bucket = of_word[first].astype(np.int64)
        salted = np.isin(self.words, hot)[first]
        bucket[salted] = ((pair_of(before[salted], word[salted] & LOW) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        if buckets * size * size < 1 << 62:
            order = np.argsort((bucket * size + first) * size + second)
        else:
            order = np.lexsort((second, first, bucket))
        bucket, first, second = bucket[order], first[order], second[order]
        new_head = first_of(bucket, first)
        new = new_head | first_of(second)
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(new) - 1  # each token's entry
        self.order, self.first = order, np.flatnonzero(new)
        self.bucket, self.second = bucket[self.first], second[self.first]
        self.low = self.words[self.second] & LOW
        self.head_first = np.flatnonzero(new_head[self.first])  # each head's first entry
        self.head_bucket, self.head_number = self.bucket[self.head_first], first[self.first[self.head_first]]
        self.head_word = self.words[self.head_number]
        self.head = np.cumsum(new_head[self.first]) - 1

    def sums(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.whose[self.order]], self.first) if len(self.first) else np.empty(0, np.int64)


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Rows of sorted columns that differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def squeezed(*columns: np.ndarray) -> bytes:
    """Integer columns in few bytes."""
    raw = b"".join(np.array([len(c)], np.int64).tobytes() + c.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(payload: bytes) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n).T).view(np.int64).reshape(-1))
        at += 8 + 8 * n
    return out


def count_pairs(known: set[bytes] | None, hot: np.ndarray, buckets: int):
    """Blocks -> for each bucket the block's pairs: heads with their numbers of pairs, second words, counts in target and all."""

    def run(batches):
        hashes = Hashes(known)
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                texts = unpacked_texts(payload)
                e = Entries(texts.column("t"), hashes, hot, buckets)
                target, all_ = e.sums(texts.column("target").to_numpy()), e.sums(texts.column("all").to_numpy())
                low = np.ascontiguousarray(e.low).view(np.uint8).reshape(-1, 8)[:, :6]
                size = np.diff(np.append(e.head_first, len(e.low)))
                found = np.unique(e.bucket)
                heads, ends = np.searchsorted(e.head_bucket, [found, found + 1]), np.searchsorted(e.bucket, [found, found + 1])
                pay = []
                for h0, h1, r0, r1 in zip(*heads, *ends):
                    words = e.head_word[h0:h1].view(np.int64)
                    pay.append((squeezed(np.diff(words, prepend=0), size[h0:h1], target[r0:r1], all_[r0:r1]), low[r0:r1].tobytes()))
                counts, seconds = zip(*pay) if pay else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), block), pa.int64()), pa.array(counts, pa.binary()), pa.array(seconds, pa.binary())], names=["bucket", "block", "counts", "seconds"])
                del e, texts, target, all_, low, pay, counts, seconds
                give_back()

    return run


def merge_pairs(hot: np.ndarray):
    """A bucket's pairs from all blocks -> for each block the sums, in the block's order; the sums of hot first words; the bucket's totals."""

    def f(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_numpy()
        parts = [unsqueezed(x) for x in group.column("counts").to_pylist()]
        heads = [np.cumsum(p[0]).view(np.uint64) for p in parts]
        sizes = [p[1] for p in parts]
        first = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes)])
        six = np.frombuffer(b"".join(group.column("seconds").to_pylist()), np.uint8).reshape(-1, 6)
        second = np.zeros((len(six), 8), np.uint8)
        second[:, :6] = six
        second = second.view(np.uint64).reshape(-1)
        order = np.lexsort((second, first))
        f_ = first[order]
        new_head = first_of(f_)
        new = new_head | first_of(second[order])
        del first, second, six
        at = np.flatnonzero(new)
        sums = [np.add.reduceat(np.concatenate([p[k] for p in parts])[order], at) for k in (2, 3)]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        head_at = np.flatnonzero(new_head[at])
        words = f_[at[head_at]]
        del f_, order
        per_head = [np.add.reduceat(x, head_at) for s in sums for x in (s, (s > 0).astype(np.int64))]  # counts and kinds of followers, target then all
        salted = np.isin(words, hot)
        rows = []
        base = np.cumsum([0, *(int(s.sum()) for s in sizes)])
        for k, block in enumerate(blocks.tolist()):
            mine = entry[base[k] : base[k + 1]]
            of = np.searchsorted(words, heads[k])
            rows.append((block, "sums", squeezed(*(s[mine] for s in sums), *(p[of] for p in per_head))))
        for w, *values in zip(words[salted].view(np.int64).tolist(), *(p[salted].tolist() for p in per_head)):
            rows.append((w, "hot", squeezed(np.array(values))))
        rows.append((0, "total", squeezed(np.array([*(int(s.sum()) for s in sums), int((~salted & (words != BORDER)).sum())]))))
        ids, kinds, payloads = zip(*rows)
        bucket = group.column("bucket")[0].as_py()
        del parts, sums, entry
        give_back()
        return pa.table({"block": pa.array(ids, pa.int64()), "kind": pa.array(kinds), "bucket": pa.array([bucket] * len(ids), pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return f


def score_block(known: set[bytes] | None, hot: dict[int, tuple], total: tuple, words: int, buckets: int, discount: float, base: float):
    """A block's texts, the sums of its pairs and the copies of its texts elsewhere -> the losses of each text, summed over its tokens.

    -log p(word | word before) by absolute discounting towards smoothed single words, the same for both models, with
    a spare count for each word that follows the model's size. A text's own words, as often as the models counted them, are taken out of all sums before it is scored.
    """
    hot_words = np.array(sorted(hot), np.uint64)
    hot_sums = np.array([hot[w] for w in hot_words.tolist()], np.int64).reshape(-1, 4)

    def losses(e: Entries, i0: int, i1: int, span: slice, pair: list[np.ndarray], head: np.ndarray, of: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        """Of texts i0 to i1, whose tokens are ``span``."""
        of_text, own = np.unique((e.whose[span] - i0) * len(e.low) + e.at[span], return_counts=True)
        text, entry = np.divmod(of_text, len(e.low))
        size = len(e.words)
        # how often a text has a word before another; every word of a text is one, an edge for its end
        in_text, at = np.unique(text * size + e.head_number[e.head[entry]], return_inverse=True)
        before_own = np.bincount(at, own, len(in_text)).astype(np.int64)
        word_own = before_own[np.searchsorted(in_text, text * size + e.second[entry])]
        length = np.bincount(text, own, i1 - i0).astype(np.int64)[text]
        sums = []
        for k in (0, 1):
            times = copies[i0:i1, k][text]
            both = pair[k][entry] - times * own
            gone = np.bincount(at, (both == 0) & (times > 0), len(in_text)).astype(np.int64)
            before = head[e.head[entry], 2 * k] - times * before_own[at]
            kinds = head[e.head[entry], 2 * k + 1] - gone[at]
            # what a word gets that the model does not know follows the model's size, so it says nothing of the difference
            seen = total[k] - times * length
            spare = base * seen / np.maximum(total[1] - copies[i0:i1, 1][text] * length, 1)
            alone = np.where(seen > 0, (head[of[e.second[entry]], 2 * k] - times * word_own + spare) / np.maximum(seen + spare * words, base), 1 / words)
            rest = np.where(before > 0, discount * kinds / np.maximum(before, 1), 1.0)
            loss = -np.log(np.maximum(both - discount, 0) / np.maximum(before, 1) + rest * alone)
            sums.append(np.bincount(text, loss * own, i1 - i0))
        return sums

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, out = Hashes(known), []
        is_sum = pc.is_valid(right.column("payload"))
        elsewhere = right.filter(pc.invert(is_sum))
        right = right.filter(is_sum)
        for payload in left.column("texts"):
            texts = unpacked_texts(payload)
            e = Entries(texts.column("t"), hashes, hot_words, buckets)
            parts = [unsqueezed(x) for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist()))]
            pair = [np.concatenate([p[k] for p in parts]) for k in (0, 1)]
            head = np.stack([np.concatenate([p[k] for p in parts]) for k in range(2, 6)], axis=1)
            del parts
            if len(pair[0]) != len(e.low) or len(head) != len(e.head_word):
                raise RuntimeError("a block's pairs and their sums differ in number")
            if len(hot_words):
                i = np.minimum(np.searchsorted(hot_words, e.head_word), len(hot_words) - 1)
                is_hot = hot_words[i] == e.head_word
                head[is_hot] = hot_sums[i[is_hot]]
            # every second word is the first of another pair of its text, or a text's edge
            of = np.empty(len(e.words), np.int64)
            of[e.head_number] = np.arange(len(e.head_number))
            copies = np.stack([texts.column("target").to_numpy(), texts.column("all").to_numpy()], axis=1)
            if elsewhere.num_rows:  # texts are in the order of their hashes
                copies[np.searchsorted(texts.column("h").to_numpy(), elsewhere.column("h").to_numpy())] = np.stack([elsewhere.column("target").to_numpy(), elsewhere.column("all").to_numpy()], axis=1)
            ends = np.searchsorted(e.whose, np.arange(texts.num_rows), side="right")
            sums, i0 = [], 0
            while i0 < texts.num_rows:
                begin = int(ends[i0 - 1]) if i0 else 0
                i1 = max(i0 + 1, int(np.searchsorted(ends, begin + TOKENS, side="right")))
                sums.append(losses(e, i0, i1, slice(begin, int(ends[i1 - 1])), pair, head, of, copies))
                i0 = i1
            target, all_ = (np.concatenate(x) for x in zip(*sums))
            out.append(pa.table({"h": texts.column("h"), "n_tokens": pa.array(np.diff(ends, prepend=0)), "target": pa.array(target), "all": pa.array(all_)}))
        return pa.concat_tables(out) if out else pa.table({"h": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "target": pa.array([], pa.float64()), "all": pa.array([], pa.float64())})

    return f


def copies_elsewhere(blocks: DataFrame) -> DataFrame:
    """``(block, h, target, all)``: for each block's texts that stand in other blocks too, their rows in all blocks."""
    each = blocks.select("block", F.explode("copies").alias("x")).select("block", "x.*")
    everywhere = each.groupBy("h").agg(F.count("*").alias("n"), F.sum("target").alias("target"), F.sum("all").alias("all")).where("n > 1").drop("n")
    return each.select("block", "h").join(everywhere, "h").select("block", "h", "target", "all")


def score(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, discount: float = 0.75, base: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``target_loss``, ``background_loss`` and ``difference`` (their mean per token, target less background).

    The background model counts all documents, the target model those whose id is in ``target_ids``; both are
    two-word models over the shared vocabulary (all words of all documents; with ``vocabulary`` so many of the
    most frequent, and other words are one unknown word), smoothed alike, so a loss difference is due to the
    texts alone. A text is scored by the other texts: its own words, with those of its equal copies, are taken
    out of both models first, so the score does not say whether the target had it. Lower difference: more like
    the target. Texts are gathered in blocks of some megabytes; a block's different pairs of words go, packed, to the buckets that sum them over all blocks, and their sums come back to
    the block, where the texts are scored. A word is named by its 64-bit hash, and after a given word by 48 bits
    of it. Words that are a ten-thousandth of all tokens or more (10,000 at most, so their sums are sent to every
    task) have their pairs dealt over all buckets; nothing else of the models is on the driver or broadcast,
    unless ``vocabulary`` bounds it. Tokens are the document's words and its end; a null or empty text has
    the end alone. A text of any length is scored whole, and one longer than a block is a block. Ids may be null
    (never target) or repeat; other columns pass through, but for those named like the new ones; with an empty
    target its model is uniform over single words; an empty table stays empty.
    """
    made = ("n_tokens", "target_loss", "background_loss", "difference")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    src = docs.select(*[c for c in docs.columns if c not in made], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(f"{OWN}text"))
    src = src.withColumn(f"{OWN}h", F.xxhash64(f"{OWN}text"))
    known = None if vocabulary is None else set(shared_vocabulary(src, vocabulary, f"{OWN}text"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("bigint").alias(f"{OWN}id")).where(f"{OWN}id is not null").distinct()
    flagged = src.select(F.col(f"{OWN}text"), F.col(f"{OWN}h"), F.col(doc_id).cast("bigint").alias(f"{OWN}id")).join(checked_broadcast(ids.withColumn(f"{OWN}target", F.lit(True))), f"{OWN}id", "left")
    rows = flagged.select(F.col(f"{OWN}h").alias("h"), F.col(f"{OWN}text").alias("t"), F.coalesce(f"{OWN}target", F.lit(False)).alias("target"))
    blocks = scratch.keep(rows.mapInArrow(make_blocks(known), "block bigint, n_words bigint, n_bytes bigint, frequent array<struct<w:bigint,n:bigint>>, copies array<struct<h:bigint,target:bigint,all:bigint>>, texts binary"), "blocks")
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_bytes").alias("bytes")).first()
    frequent = blocks.select(F.explode("frequent").alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n")).where(F.col("n") * HOT >= (size.words or 0))
    hot = np.sort(np.array([r.w for r in frequent.select("w").collect()], np.int64).view(np.uint64))
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // BLOCK))
    pairs = blocks.select("block", "texts").mapInArrow(count_pairs(known, hot, buckets), "bucket int, block bigint, counts binary, seconds binary")
    sums = scratch.keep(pairs.groupBy("bucket").applyInArrow(merge_pairs(hot), "block bigint, kind string, bucket int, payload binary"), "sums")
    of_hot: dict[int, np.ndarray] = {}
    total = np.zeros(3, np.int64)
    for r in partial_sums(sums).collect():  # a row for each hot word, and one
        if r.kind == "total":
            total += np.array(r.values)[:3]
        else:
            of_hot[int(np.int64(r.block).view(np.uint64))] = np.array(r.values)
    words = len(known) if known is not None else int(total[2]) + sum(1 for w in of_hot if w != BORDER)
    known_of = sums.where("kind = 'sums'").select("block", "bucket", "payload").unionByName(copies_elsewhere(blocks), allowMissingColumns=True)
    scored = blocks.select("block", "texts").groupBy("block").cogroup(known_of.groupBy("block"))
    mean = scored.applyInArrow(score_block(known, {w: tuple(x.tolist()) for w, x in of_hot.items()}, tuple(total[:2].tolist()), words + 2, buckets, discount, base), "h bigint, n_tokens bigint, target double, all double")
    mean = mean.groupBy(F.col("h").alias(f"{OWN}h")).agg(F.min("n_tokens").alias("n_tokens"), F.min("target").alias("target"), F.min("all").alias("all"))
    mean = mean.select(f"{OWN}h", "n_tokens", (F.col("target") / F.col("n_tokens")).alias("target_loss"), (F.col("all") / F.col("n_tokens")).alias("background_loss"))
    out = src.drop(f"{OWN}text").join(scratch.keep(mean, "means"), f"{OWN}h").drop(f"{OWN}h")
    scratch.drop("blocks")
    scratch.drop("sums")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def partial_sums(sums: DataFrame) -> DataFrame:
    """The buckets' totals and hot words' sums, added up: one row each."""

    def run(batches):
        for b in batches:
            values = [[*unsqueezed(x)[0].tolist(), 0][:4] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([v[k] for v in values], pa.int64()) for k in range(4))], names=["block", "kind", "v0", "v1", "v2", "v3"])

    each = sums.where("kind <> 'sums'").select("block", "kind", "payload").mapInArrow(run, "block bigint, kind string, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
    return each.groupBy("block", "kind").agg(F.array(*[F.sum(f"v{k}") for k in range(4)]).alias("values"))
