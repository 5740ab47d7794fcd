"""Removal of long repeated strings: suffixes sampled by their least q-gram, refined by bucket pointers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, Scratch
from .packed import SCHEMA, as_batch, deal, per_bucket, unpack

Q = 25  # initial buckets: q-grams
LENGTH = 4 * Q  # two refinements double the compared length to 100 bytes
SPAN = LENGTH - Q + 1  # q-grams in a string of LENGTH
CHUNK = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
_BYTE = np.random.default_rng(25).integers(0, 2**64, 256, dtype=np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two strings side by side from theirs."""
    out = left * _A
    out += right
    out ^= out >> _C
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the Q bytes and of the LENGTH bytes from each position (shorter by Q - 1, LENGTH - 1)."""
    h1 = _BYTE[data]
    h2 = _joined(h1[:-1], h1[1:])
    h4 = _joined(h2[:-2], h2[2:])
    h8 = _joined(h4[:-4], h4[4:])
    h16 = _joined(h8[:-8], h8[8:])
    h24 = _joined(h16[:-8], h8[16:])
    hq = _joined(h24[:-1], h1[24:])
    half = _joined(hq[:-Q], hq[Q:])
    return hq, _joined(half[: -2 * Q], half[2 * Q :])


def _least(hq: np.ndarray) -> np.ndarray:
    """The least q-gram hash of each string of LENGTH."""
    low = hq
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    return np.minimum(low[: len(low) - (SPAN - 64)], low[SPAN - 64 :])


def _runs(buffer: np.ndarray, valid: np.ndarray):
    """Consecutive strings whose least q-gram is one and the same place: (q-gram hash, class of all the run's bytes, first start, strings).

    Equal strings have equal least q-grams at equal offsets, so only different runs with the same q-gram hash can
    hold equal strings. The place is the first of the least hash in the string, so a run has at most SPAN strings.
    """
    out = []
    for at in range(0, max(0, len(buffer) - LENGTH + 1), CHUNK):
        idx = np.flatnonzero(valid[at : at + CHUNK])
        if not len(idx):
            continue
        hq, whole = _hashes(buffer[at : at + CHUNK + LENGTH - 1])
        low = _least(hq)[idx]
        # a new run where the least hash changes, a gap is, or its first place in the string was just left behind
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (idx[1:] != idx[:-1] + 1) | (hq[idx[:-1]] == low[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(idx)))
        start = idx[first]
        all_bytes = _joined(whole[start], whole[start + size - 1]) ^ size.astype(np.uint64)
        out.append((low[first], all_bytes, start + at, size))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _documents(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Keys that order documents, (id, hash of the text), and the texts; a null id sorts last."""
    raw = [t.as_py() or b"" for t in texts]
    key = np.array(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), np.int64)
    return key, np.array([xxhash.xxh3_64_intdigest(t) for t in raw], np.uint64).view(np.int64), raw


def _concat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each document's first position, and where a string of LENGTH starts that ends in its document."""
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(t) for t in raw])
    first = ends - [len(t) for t in raw]
    valid = np.ones(len(buffer), bool)
    for a, b in zip(first.tolist(), ends.tolist()):
        valid[max(a, b - LENGTH + 1) : b] = False
    return buffer, first, valid


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)


def _doc_bucket(key: np.ndarray, text_hash: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(_joined(key.view(np.uint64), text_hash.view(np.uint64)), buckets)


def _rows(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before in any of the sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _repeats(order, classes, key, text_hash, start):
    """Of rows in ``order`` (by class, then document and start): those whose class has an earlier, different start; and the classes' first rows."""
    new = _first_of(*[c[order] for c in classes])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (key[order] == key[lead]) & (text_hash[order] == text_hash[lead]) & (start[order] == start[lead])
    return order[~same], order[new]


def _parts(batch: pa.RecordBatch, most: int = 4 << 20):
    """A batch in slices of some megabytes of text (a longer text alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sample_runs(buckets: int):
    """Documents -> packed runs by q-gram, one for each class of a batch; the batch's later members are repeats at once."""

    def run(batches):
        for b in (part for whole in batches for part in _parts(whole)):
            key, text_hash, raw = _documents(b.column(0), b.column(1))
            once = np.unique(np.stack([key, text_hash], axis=1), axis=0, return_index=True)[1]
            key, text_hash, raw = key[once], text_hash[once], [raw[i] for i in once]
            buffer, first, valid = _concat(raw)
            gram, whole, start, size = _runs(buffer, valid)
            doc = np.searchsorted(first, start, side="right") - 1
            # empty documents share a first position; the last of them with that position is the one that has bytes
            start = start - first[doc]
            order = np.lexsort((start, doc, whole, gram))  # documents are in key order
            again, lead = _repeats(order, (gram, whole), key[doc], text_hash[doc], start)
            found = []
            if len(again):
                d = doc[again]
                found += deal(_rows(key=key[d], text_hash=text_hash[d], start=start[again], size=size[again].astype(np.uint8)), _doc_bucket(key[d], text_hash[d], buckets), "covered")
            d = doc[lead]
            found += deal(_rows(gram=gram[lead], whole=whole[lead], key=key[d], text_hash=text_hash[d], start=start[lead], size=size[lead].astype(np.uint8)), _bucket(gram[lead], buckets), "runs")
            yield as_batch(found)

    return run


def _forward(group: pa.Table, kind: str) -> list:
    """Packed rows that only pass through."""
    at = [i for i, k in enumerate(group.column("kind").to_pylist()) if k == kind]
    return [(group.column("bucket")[i].as_py(), kind, group.column("payload")[i].as_py()) for i in at]


def match_runs(buckets: int, hot: int):
    """Runs of one q-gram: all members of a class but the first are repeats; q-grams with several classes need their bytes compared."""

    def f(group: pa.Table) -> list:
        out = _forward(group, "covered")
        t = unpack(group, "runs")
        if t is None:
            return out
        gram, whole, key, text_hash, start, size = (t.column(c).to_numpy() for c in ("gram", "whole", "key", "text_hash", "start", "size"))
        start = start.astype(np.int64)
        order = np.lexsort((start, text_hash, key, whole, gram))
        again, lead = _repeats(order, (gram, whole), key, text_hash, start)
        if len(again):
            out += deal(_rows(key=key[again], text_hash=text_hash[again], start=start[again], size=size[again]), _doc_bucket(key[again], text_hash[again], buckets), "covered")
        new = _first_of(gram[lead])
        classes = np.diff(np.append(np.flatnonzero(new), len(lead)))
        many = np.repeat(classes, classes)
        open_ = lead[many > 1]
        if len(open_):
            out += deal(_rows(gram=gram[open_], key=key[open_], text_hash=text_hash[open_], start=start[open_], size=size[open_], hot=many[many > 1] > hot), _doc_bucket(key[open_], text_hash[open_], buckets), "open")
        return out

    return f


def fetch_bytes(buckets: int):
    """A bucket's documents and open runs -> the runs' bytes, dealt by q-gram; runs of hot q-grams go as single strings, the first of each kind in this bucket only."""

    def f(group: pa.Table) -> list:
        runs, docs = unpack(group, "open"), unpack(group, "docs")
        if runs is None or docs is None:
            return []
        key, text_hash, raw = _documents(docs.column("key").combine_chunks(), docs.column("raw").combine_chunks())
        at = {k: i for i, k in enumerate(zip(key.tolist(), text_hash.tolist()))}
        runs = runs.sort_by([("key", "ascending"), ("text_hash", "ascending"), ("start", "ascending")])
        rk, rh, start, size, hot = (runs.column(c).to_numpy() for c in ("key", "text_hash", "start", "size", "hot"))
        doc = [at[k] for k in zip(rk.tolist(), rh.tolist())]
        cut = [raw[d][s : s + n + LENGTH - 1] for d, s, n in zip(doc, start.tolist(), size.tolist())]
        out, cold = [], ~hot
        if cold.any():
            i = np.flatnonzero(cold)
            gram = runs.column("gram").to_numpy()[i]
            out += deal(_rows(gram=gram, key=rk[i], text_hash=rh[i], start=start[i], size=size[i], raw=pa.array([cut[k] for k in i], pa.binary())), _bucket(gram, buckets), "bytes", compress=True)
        if hot.any():
            i = np.flatnonzero(hot)
            n = size[i].astype(np.int64)
            buffer = np.frombuffer(b"".join(cut[k] for k in i), np.uint8)
            base = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            whole = np.concatenate([_hashes(buffer[x : x + CHUNK + LENGTH - 1])[1] for x in range(0, len(buffer) - LENGTH + 1, CHUNK)])[base + inner]
            owner = np.repeat(i, n)
            s = start[owner] + inner
            order = np.lexsort((s, rh[owner], rk[owner], whole))
            again, lead = _repeats(order, (whole,), rk[owner], rh[owner], s)
            for rows, kind, to in ((again, "covered", None), (lead, "strings", whole[lead])):
                if len(rows):
                    o = owner[rows]
                    cols = {"key": rk[o], "text_hash": rh[o], "start": s[rows], "size": np.ones(len(o), np.uint8)}
                    out += deal(_rows(**({"whole": whole[rows]} if kind == "strings" else {}), **cols), _bucket(to, buckets) if kind == "strings" else _doc_bucket(rk[o], rh[o], buckets), kind)
        return out

    return f


def refine(buckets: int):
    """Bucket-pointer refinement of the open runs' suffixes.

    Each position starts in the bucket of its q-gram. Suffixes are then sorted on the pair (own bucket, bucket
    of the suffix Q later), which numbers the buckets of 2Q bytes; these numbers, reused at offset 2Q, give the
    buckets of LENGTH bytes. Positions alone in their bucket leave before the next sort. In each last bucket
    all strings but the first start are repeats.
    """

    def f(group: pa.Table) -> list:
        out = _forward(group, "covered")
        t = unpack(group, "strings")
        if t is not None:
            whole, key, text_hash, start = (t.column(c).to_numpy() for c in ("whole", "key", "text_hash", "start"))
            again, _ = _repeats(np.lexsort((start, text_hash, key, whole)), (whole,), key, text_hash, start)
            if len(again):
                out += deal(_rows(key=key[again], text_hash=text_hash[again], start=start[again], size=np.ones(len(again), np.uint8)), _doc_bucket(key[again], text_hash[again], buckets), "covered")
        t = unpack(group, "bytes")
        if t is None:
            return out
        t = t.sort_by("gram")
        gram = t.column("gram").to_numpy()
        edges = np.flatnonzero(_first_of(gram))
        # whole q-grams at a time, under a megabyte of bytes each: the sorts need some hundred times as much
        weight = np.cumsum(t.column("size").to_numpy().astype(np.int64) + LENGTH)
        cuts, last = [0], 0
        for e in edges[1:]:
            if weight[e - 1] - last > 800_000:
                cuts.append(int(e))
                last = weight[e - 1]
        for a, b in zip(cuts, [*cuts[1:], len(gram)]):
            out += _refined(t.slice(a, b - a), buckets)
        return out

    return f


def _refined(t: pa.Table, buckets: int) -> list:
    key, text_hash, start, size = (t.column(c).to_numpy() for c in ("key", "text_hash", "start", "size"))
    size = size.astype(np.int64)
    length = size + LENGTH - 1
    base = np.cumsum(length) - length
    buffer = np.frombuffer(b"".join(t.column("raw").to_pylist()), np.uint8)
    ids = _hashes(buffer)[0]  # q-gram buckets; those across two runs' bytes are never asked for
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owner = np.repeat(np.arange(len(size)), size)
    at = base[owner] + inner
    # buckets of 2Q bytes are needed at each string's start and 2Q later
    points = np.zeros(len(buffer), bool)
    points[at] = points[at + 2 * Q] = True
    p = np.flatnonzero(points)
    count = np.bincount(ids)
    alone = (count[ids[p]] == 1) | (count[ids[p + Q]] == 1)
    twice = np.full(len(buffer), -1, np.int64)
    p = p[~alone]
    twice[p] = np.unique(ids[p] * len(count) + ids[p + Q], return_inverse=True)[1]
    keep = (twice[at] >= 0) & (twice[at + 2 * Q] >= 0)
    at, owner, inner = at[keep], owner[keep], inner[keep]
    if not len(at):
        return []
    last = np.unique(twice[at] * (twice.max() + 1) + twice[at + 2 * Q], return_inverse=True)[1]
    s = start[owner] + inner
    again, _ = _repeats(np.lexsort((s, text_hash[owner], key[owner], last)), (last,), key[owner], text_hash[owner], s)
    if not len(again):
        return []
    again = again[np.lexsort((s[again], owner[again]))]
    o, s = owner[again], s[again]
    new = _first_of(o) | np.concatenate([[True], s[1:] != s[:-1] + 1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(s)))
    return list(deal(_rows(key=key[o[at]], text_hash=text_hash[o[at]], start=s[at], size=n.astype(np.uint8)), _doc_bucket(key[o[at]], text_hash[o[at]], buckets), "covered"))


def _spans(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings that start in the runs."""
    out: list[list[int]] = []
    for start, size in sorted(runs):
        end = min(n, start + size + LENGTH - 1)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _whole_characters(spans: list[tuple[int, int]], t: bytes) -> list[tuple[int, int]]:
    """Spans without the UTF-8 characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and t[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(t) and t[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = 5_000, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (array of (start, end)) and ``kept`` (the bytes left).

    A byte goes if a string of 100 bytes over it also starts earlier: in a document of smaller id, or earlier
    in its own. Overlaps count; strings are judged on the input. Texts are whole UTF-8 bytes, null is empty,
    and nothing matches across documents. A null id orders after all others; rows with one id are ordered by a
    hash of their texts, and rows equal in both are one document, so that a repeated row keeps what the row
    itself keeps. With ``whole_characters`` a character that a span covers in part stays, so ``kept`` is text again.
    Columns pass through, but for those named like the new ones; an empty table stays empty.

    A string's least q-gram (by hash) is the same wherever the string stands, so strings meet by that q-gram:
    the strings of about 38 starts in a row travel as one run. Copies of a run are settled by one hash of all
    its bytes, within a batch before any shuffle; runs that share the q-gram but differ elsewhere are compared
    by bucket-pointer refinement. A q-gram with over ``hot`` different runs is settled string by string, with
    one string of each kind from every bucket of documents, so no bucket gathers all of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    src = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    total = src.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 << 20)))
    matched = scratch.keep(per_bucket(src.mapInArrow(sample_runs(buckets), SCHEMA), match_runs(buckets, hot)), "matched")

    def pack(batches):
        for b in batches:
            key, text_hash, _ = _documents(b.column(0), b.column(1))
            yield as_batch(list(deal(b, _doc_bucket(key, text_hash, buckets), "docs", compress=True)))

    bytes_ = per_bucket(src.mapInArrow(pack, SCHEMA).unionAll(matched.where("kind = 'open'")), fetch_bytes(buckets))
    refined = scratch.keep(per_bucket(bytes_, refine(buckets)), "refined")
    covered = matched.where("kind = 'covered'").unionAll(refined)
    made = ("n_bytes", "n_removed", "spans", "kept")
    other = [c for c in docs.columns if c not in made]
    whole = docs.select(
        F.col(doc_id).cast("bigint").alias(f"{OWN}key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(f"{OWN}raw"),
        F.col(text).isNull().alias(f"{OWN}null"),
        *[c for c in other if c != text],
    )
    fields = [(f.name, "string" if f.name == text else f.dataType.simpleString()) for f in docs.select(*other).schema.fields]
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in fields), "n_bytes bigint", "n_removed bigint", "spans array<struct<start:bigint,end:bigint>>", "kept binary"])

    def finish(group: pa.Table) -> pa.Table:
        rows = unpack(group, "docs")
        if rows is None:
            raise RuntimeError("the documents changed while their repeats were looked for")
        hits = unpack(group, "covered")
        runs: dict[tuple, list] = {}
        if hits is not None:
            for k, h, s, n in zip(*(hits.column(c).to_pylist() for c in ("key", "text_hash", "start", "size"))):
                runs.setdefault((k, h), []).append((s, n))
        key, text_hash, raw = _documents(rows.column(f"{OWN}key").combine_chunks(), rows.column(f"{OWN}raw").combine_chunks())
        spans, kept = [], []
        for k, h, t in zip(key.tolist(), text_hash.tolist(), raw):
            found = _spans(runs[(k, h)], len(t)) if (k, h) in runs else []
            if whole_characters:
                found = _whole_characters(found, t)
            at = [0, *(x for ab in found for x in ab), len(t)]
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b"".join(t[a:b] for a, b in zip(at[::2], at[1::2])) if found else t)
        texts = [None if gone else t.decode("utf-8") for gone, t in zip(rows.column(f"{OWN}null").to_pylist(), raw)]
        sizes = pa.array([len(t) for t in raw], pa.int64())
        cols = {c: pa.array(texts, pa.string()) if c == text else rows.column(c) for c in other}
        cols |= {"n_bytes": sizes, "n_removed": pa.array([len(t) - len(k) for t, k in zip(raw, kept)], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
        return pa.table(cols)

    packed = whole.mapInArrow(pack, SCHEMA).unionAll(covered)
    return packed.groupBy("bucket").applyInArrow(finish, ddl)
