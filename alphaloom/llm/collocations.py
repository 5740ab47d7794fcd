"""Phrase collocations by positional inverted lists, extended level by level."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch, give_back
from .lm_score import first_of, squeezed, unsqueezed
from .packed import deal, unpack

BLOCK = 4 << 20  # bytes of text whose positions form one block; a task holds some 60 bytes for each of its words
#: Characters that end a piece; phrases do not cross them.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(ENDS))
_TOKENS = re.compile(rb"[^ \t\n]+|\n")
#: What travels between blocks and buckets, and what is known to be frequent.
ROWS = "block bigint, bucket int, kind string, payload binary, ids array<bigint>, lang string, word string, n bigint"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.string()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, schema=_SCHEMA)


class _Numbers(dict):
    """Numbers of one language's words in a block, from 1; all languages of the block share the numbering."""

    def __init__(self, lang: str, terms: list[tuple[str, bytes]]):
        self.lang, self.terms = lang, terms

    def __missing__(self, word: bytes) -> int:
        self.terms.append((self.lang, word))
        self[word] = found = len(self.terms)
        return found


class Block:
    """Word numbers of some megabytes of text by position; 0 stands between pieces and between texts."""

    def __init__(self):
        self.terms: list[tuple[str, bytes]] = []
        self.of: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.n_bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.of.get(lang)
        if numbers is None:
            numbers = self.of[lang] = _Numbers(lang, self.terms)
        numbers[b"\n"] = 0
        found = _TOKENS.findall(text.translate(_TABLE))
        ids = np.zeros(len(found) + 1, np.int32)
        ids[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(ids)
        self.n_bytes += len(text)

    def packed(self, block: int, buckets: int) -> list[dict]:
        """The block, and for each bucket its words with the lengths of their lists."""
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream, minlength=len(self.terms) + 1)[1:]
        bucket = np.fromiter((zlib.crc32(w, zlib.crc32(g.encode())) % buckets for g, w in self.terms), np.int64, len(self.terms))
        out = [{"block": block, "kind": "block", "payload": squeezed(stream, bucket)}]
        if self.terms:
            langs, words = zip(*self.terms)
            rows = pa.RecordBatch.from_arrays([pa.array(langs).dictionary_encode(), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])
            out += [{"block": block, "bucket": b, "kind": kind, "payload": p} for b, kind, p in deal(rows, bucket, "words", compress=True)]
        return out


def make_blocks(buckets: int, block: int):
    """(lang, text) -> blocks and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, task = Block(), 0, TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, pc.cast(batch.column(1), pa.binary())):
                now.add(lang, text.as_py())
                if now.n_bytes >= block:
                    yield from _rows(now.packed(task << 32 | made, buckets)).to_batches()
                    now, made = Block(), made + 1
        if now.parts:
            yield from _rows(now.packed(task << 32 | made, buckets)).to_batches()
        give_back()

    return run


def merge_words(buckets: int, least: int):
    """A bucket's words from all blocks -> the frequent ones with a number each, each block's share of the numbers, totals by language."""

    def f(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        blocks = group.column("block").to_pylist()
        parts = [unpack(group.slice(i, 1), "words") for i in range(len(blocks))]
        whole = pa.concat_tables([p.set_column(0, "lang", p.column("lang").cast(pa.string())) for p in parts]).combine_chunks()
        term = pc.binary_join_element_wise(pc.cast(whole.column("lang"), pa.binary()), whole.column("word"), b" ").combine_chunks().dictionary_encode()  # words have no space
        code = term.indices.to_numpy()
        n = np.zeros(len(term.dictionary), np.int64)
        np.add.at(n, code, whole.column("n").to_numpy())
        frequent = n >= least
        number = np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket + 1, 0)
        ends = np.cumsum([0, *(p.num_rows for p in parts)])
        out = [{"block": b, "bucket": bucket, "kind": "found", "payload": squeezed(number[code[x:y]])} for b, x, y in zip(blocks, ends, ends[1:])]
        first = np.full(len(n), len(code))
        np.minimum.at(first, code, np.arange(len(code)))
        at = np.flatnonzero(frequent)
        some = whole.take(pa.array(first[at]))
        rows = pa.table([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(["frequent"] * len(at), pa.string()), pa.nulls(len(at), pa.binary()), pa.array(number[at].reshape(-1, 1).tolist(), pa.list_(pa.int64())), some.column("lang"), pc.cast(some.column("word"), pa.string()), pa.array(n[at])], schema=_SCHEMA)
        langs = whole.group_by("lang").aggregate([("n", "sum")])
        out += [{"kind": "total", "lang": g, "n": c} for g, c in zip(langs.column("lang").to_pylist(), langs.column("n_sum").to_pylist())]
        give_back()
        return pa.concat_tables([_rows(out), rows])

    return f


class Lists:
    """Inverted lists of a block's frequent phrases of one length.

    ``at`` are the positions of their first words in order, ``phrase`` the phrase of each position, ``ids`` the word
    numbers of each phrase; phrases are in the order of their numbers.
    """

    def __init__(self, at: np.ndarray, phrase: np.ndarray, ids: np.ndarray):
        self.at, self.phrase, self.ids = at, phrase, ids

    def extended(self, words: Lists) -> Lists:
        """Phrases one word longer: positions are joined with those of the phrase that starts one word on, which gives the last word.

        Both lists are in order of position, so the join is one merge; what is left of a phrase's list is exact.
        """
        k = self.ids.shape[1]
        next_ = np.searchsorted(self.at, self.at + 1)
        met = next_ < len(self.at)
        met[met] = self.at[next_[met]] == self.at[met] + 1
        at = self.at[met]
        last = words.phrase[np.searchsorted(words.at, at + k)]
        key = self.phrase[met] * np.int64(len(words.ids)) + last
        found, phrase = np.unique(key, return_inverse=True)
        ids = np.concatenate([self.ids[found // max(len(words.ids), 1)], words.ids[found % max(len(words.ids), 1)]], axis=1)
        return Lists(at, phrase, ids)

    def only(self, frequent: np.ndarray) -> Lists:
        stays = frequent[self.phrase] if len(self.phrase) else np.zeros(0, bool)
        return Lists(self.at[stays], (np.cumsum(frequent) - 1)[self.phrase[stays]], self.ids[frequent])

    def packed(self) -> list[np.ndarray]:
        return [np.diff(self.at, prepend=0), self.phrase, self.ids.T.reshape(-1), np.array([self.ids.shape[1]])]

    @staticmethod
    def unpacked(at, phrase, ids, k) -> Lists:
        return Lists(np.cumsum(at), phrase, ids.reshape(int(k[0]), -1).T)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def sent(block: int, lists: Lists, state: list[Lists], buckets: int) -> pa.Table:
    """A block's lists so far, and for each bucket its phrases with the lengths of their lists."""
    n = np.bincount(lists.phrase, minlength=len(lists.ids))
    bucket = bucket_of(lists.ids, buckets)
    order = np.argsort(bucket, kind="stable")
    out = [{"block": block, "kind": "block", "payload": squeezed(*(c for x in state for c in x.packed()))}]
    edges = np.flatnonzero(first_of(bucket[order]))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        mine = order[a:b]
        out.append({"block": block, "bucket": int(bucket[mine[0]]), "kind": "phrases", "payload": squeezed(np.diff(lists.ids[mine, 0], prepend=0), *lists.ids[mine, 1:].T, n[mine])})
    return _rows(out)


def pairs(buckets: int):
    """A block and the numbers of its frequent words -> the lists of its words, and its phrases of two."""

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            stream, bucket = unsqueezed(payload)
            number = np.zeros(len(bucket) + 1, np.int64)
            got = [unsqueezed(p)[0] for _, p in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist()))]
            number[np.argsort(bucket, kind="stable") + 1] = np.concatenate(got) if got else []
            ids = number[stream]
            at = np.flatnonzero(ids)
            found, word = np.unique(ids[at], return_inverse=True)
            words = Lists(at, word, found.reshape(-1, 1))
            out.append(sent(block, words.extended(words), [words], buckets))
        give_back()
        return pa.concat_tables(out) if out else _rows([])

    return f


def longer(buckets: int):
    """A block's lists of k - 1 words, and which of its phrases of k words are frequent -> their lists, and its phrases of k + 1 words."""

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            columns = unsqueezed(payload)
            words = Lists.unpacked(*columns[:4])
            before = Lists.unpacked(*columns[4:]) if len(columns) > 4 else words  # one word each
            now = before.extended(words)
            order = np.argsort(bucket_of(now.ids, buckets), kind="stable")
            frequent = np.zeros(len(now.ids), bool)
            got = [np.unpackbits(np.frombuffer(p[8:], np.uint8), count=int.from_bytes(p[:8], "little")) for _, p in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist()))]
            frequent[order] = np.concatenate(got) if got else []
            now = now.only(frequent)
            out.append(sent(block, now.extended(words), [words, now], buckets))
        give_back()
        return pa.concat_tables(out) if out else _rows([])

    return f


def merge_phrases(least: int):
    """A bucket's phrases from all blocks -> the frequent ones, and for each block which of its phrases they are."""

    def f(group: pa.Table) -> pa.Table:
        bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        parts = [unsqueezed(p) for p in group.column("payload").to_pylist()]
        ids = [np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]) - 1))]
        order = np.lexsort(ids[::-1])
        new = first_of(*(c[order] for c in ids))
        first = np.flatnonzero(new)
        n = np.add.reduceat(np.concatenate([p[-1] for p in parts])[order], first)
        frequent = n >= least
        flag = np.empty(len(order), bool)
        flag[order] = frequent[np.cumsum(new) - 1]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        out = [{"block": b, "bucket": bucket, "kind": "found", "payload": int(y - x).to_bytes(8, "little") + np.packbits(flag[x:y]).tobytes()} for b, x, y in zip(blocks, ends, ends[1:])]
        at = first[frequent]
        out += [{"kind": "frequent", "ids": i, "n": c} for i, c in zip(np.stack([c[order[at]] for c in ids], axis=1).tolist(), n[frequent].tolist())]
        give_back()
        return _rows(out)

    return f


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact for counts of up to 15 digits."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def frequent_phrases(docs: DataFrame, longest: int, least: int, scratch: Scratch, lang: str = "lang", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(ids, n, lang, word)`` for all words and phrases of up to ``longest`` words with ``least`` occurrences, and ``(lang, total)``.

    ``lang`` and ``word`` are set for single words, whose ``ids`` is one number; phrases are lists of such numbers.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (2 * block)))
    blocks = scratch.keep(src.mapInArrow(make_blocks(buckets, block), ROWS), "blocks1")
    # the operators below run on rows of a few kilobytes to megabytes; the keys are blocks and buckets, whose number grows with the text
    merged = scratch.keep(blocks.where("kind = 'words'").groupBy("bucket").applyInArrow(merge_words(buckets, least), ROWS), "merged1")
    found = [merged.where("kind = 'frequent'").select("ids", "n", "lang", "word")]
    totals = merged.where("kind = 'total'").groupBy("lang").agg(F.sum("n").alias("total"))
    for k in range(2, longest + 1):
        left = blocks.where("kind = 'block'").select("block", "payload").groupBy("block")
        right = merged.where("kind = 'found'").select("block", "bucket", "payload").groupBy("block")
        blocks = scratch.keep(left.cogroup(right).applyInArrow(pairs(buckets) if k == 2 else longer(buckets), ROWS), f"blocks{k}")
        merged = scratch.keep(blocks.where("kind = 'phrases'").groupBy("bucket").applyInArrow(merge_phrases(least), ROWS), f"merged{k}")
        scratch.drop(f"blocks{k - 1}")
        found.append(merged.where("kind = 'frequent'").select("ids", "n", "lang", "word"))
    scratch.drop(f"blocks{longest}")
    return reduce(DataFrame.unionAll, found), totals


def best(rows: DataFrame, group: str, order: list[Column], top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each group in ``order``, with ``rank``: first in each of ``salts`` shares of a group, then among what those leave."""
    salt = F.pmod(F.xxhash64("ids"), F.lit(salts)).alias("salt")
    some = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2_000, lang: str = "lang", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Positions of words are kept as inverted lists, block by block of text. Only words that are frequent over all
    blocks keep their lists; a frequent phrase is extended by merging its positions with those of the phrase that starts one
    word on. The lengths of a phrase's lists, summed over the blocks in buckets of phrases, are its exact
    frequency; blocks are told which of their phrases are frequent and go on with those. No block, bucket or group
    holds more than its share of the text, whatever the language or phrase; ``block`` is a block's bytes of text.

    Of a candidate (``least`` occurrences or more) the cut with the lowest score counts; candidates inside a longer one
    with ``cover`` percent of their occurrences are dropped. A null language is ``und``, a null text is empty, texts of any
    length are read whole, repeated rows count again; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    found, totals = frequent_phrases(docs, longest, least, scratch, lang, text, block)
    words = found.where("size(ids) = 1")
    candidates = found.where("size(ids) > 1").select("ids", F.col("n").alias("a"))
    of_length = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    inner = candidates.where("size(ids) > 2").select(F.explode(of_length).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).select("ids", "a")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    cuts = cuts.join(found.select(F.col("ids").alias("first"), F.col("n").alias("l"), "lang"), "first").join(found.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    scored = cuts.select("ids", "a", "lang", F.struct(ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("ids", "a").agg(F.max("lang").alias("lang"), F.min("cut").alias("cut")).select("lang", "ids", "a", "cut.score", "cut.l", "cut.r")
    scored = scratch.keep(scored, "scored")
    order = [F.desc("score"), F.desc("a")]
    # phrases are spelled out only from the last place's score and count upwards, ties included
    last = best(scored, "lang", order, top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    some = scored.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    spelled = some.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select(F.col("ids")[0].alias("id"), "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best(some.join(spelled, "ids"), "lang", [*order, F.asc("phrase")], top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
