"""SimHash fingerprints and their links by pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch, checked_broadcast, slices
from .graph import connected_components

BITS = 64


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", keys: tuple[str, ...] = ("doc_id",), name: str = "fp", width: int = 1, sets: str | None = None) -> DataFrame:
    """``keys`` + ``name``: the 64-bit SimHash (a signed long) of each row's whole text.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, and a shingle is ``words`` of
    them joined by a space, repeats included. Fewer words form one shingle; none (null, empty or blank text)
    gives 0. A bit is 1 if it is set in over half of the shingles' XXH64 values. Keys may be null or repeat;
    other columns are ignored. With ``width`` over 1 the fingerprint is a binary of so many 64-bit words, the
    further words from further mixings of the same hashes. With ``sets`` each distinct shingle counts once, and a
    column of that name holds a hash of the set.
    """
    src = docs.select(*[F.col(k).alias(f"{OWN}k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").cast("binary").alias(f"{OWN}text"))

    def one(hashes) -> np.ndarray:
        ones, total = np.zeros((width, BITS), np.int64), 0
        for h in hashes:
            total += len(h)
            for k in range(width):
                ones[k] += np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<u8")[:, 0]

    def run(batches):
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1):
                raw = b.column(b.num_columns - 1)
                own = [distinct(t.as_py(), words, seed) for t in raw] if sets else []
                made = [one(np.split(h, range(1 << 14, len(h), 1 << 14))) for h in own] if sets else [one(shingles(t.as_py(), words, seed)) for t in raw]
                out = [pa.array([x.tobytes() for x in made], pa.binary()) if width > 1 else pa.array([int(x[0].astype(np.int64)) for x in made], pa.int64())]
                if sets:
                    out.append(pa.array(np.array([xxh64_intdigest(h.tobytes(), seed) for h in own], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], *names])

    names = [name, sets] if sets else [name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{name}` {'binary' if width > 1 else 'bigint'}", *([f"`{sets}` bigint"] if sets else [])])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"{OWN}k{i}").alias(k) for i, k in enumerate(keys)], *names)


def shingles(raw: bytes | None, words: int, seed: int):
    """The hashes of a text's shingles in order, in arrays of bounded length."""
    found = raw.lower().split() if raw else []
    total = max(1, len(found) - words + 1) if found else 0
    for at in range(0, total, 1 << 14):
        yield np.array([xxh64_intdigest(b" ".join(found[i : i + words]), seed) for i in range(at, min(total, at + (1 << 14)))], "<u8")


def distinct(raw: bytes | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingles(raw, words, seed)]))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent-looking hash made of one; the 0-th is itself."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def pivots(count: int, words: int = 1, seed: int = 9) -> np.ndarray:
    """Reference fingerprints (count x 64-bit words): random, so that a pair's distances to them differ as much as chance allows."""
    return np.random.default_rng(seed).integers(0, 2**64, (count, words), dtype=np.uint64)


def bands(distance: int, extra: int = 2) -> list[list[tuple[int, int]]]:
    """Bit ranges by which partitions are dealt: of distance + extra ranges, ``extra`` agree in any linked pair."""
    edges = np.linspace(0, BITS, distance + extra + 1).astype(int).tolist()
    return [list(x) for x in combinations(list(zip(edges, edges[1:])), extra)]


CROWD = 64  # rows of a part in one batch from which known links are used to leave pairs out


def crowd_links(fp: np.ndarray, table: np.ndarray, label: np.ndarray, fresh: int, distance: int) -> np.ndarray:
    """A forest of the links of one part's rows, sorted by the first coordinate; ``label`` (changed) names components.

    A row meets the rows within reach that are not of its component by then, so near copies cost about one pass,
    and unlike rows every pair. Pairs of rows before ``fresh`` have been compared before.
    """
    links, columns = [], np.ascontiguousarray(table.T)
    ends = np.searchsorted(columns[0], columns[0] + distance, side="right")
    for r in range(len(fp) - 1):
        at = max(r + 1, fresh)
        if at >= ends[r]:
            continue
        others = at + np.flatnonzero(label[at : ends[r]] != label[r])
        for c in columns[1:]:
            if not len(others):
                break
            others = others[np.abs(c[others] - c[r]) <= distance]
        if len(others):
            others = others[np.bitwise_count(fp[others] ^ fp[r]).sum(axis=1) <= distance]
        if len(others):
            joined, one = np.unique(label[others], return_index=True)
            links.append(np.stack([np.full(len(one), r), others[one]], axis=1))
            label[np.isin(label, joined)] = label[r]
    return np.concatenate(links) if links else np.empty((0, 2), np.int64)


def link_partition(batches, refs: np.ndarray, distance: int):
    """Links within the rows (part, node, fp) of a partition sorted by (part, first coordinate).

    Each fingerprint's distances to all references are tabulated once. A row meets those after it in its part
    while the first coordinates differ by no more than ``distance`` (they are sorted, so a miss ends the row's
    turn); pairs whose other coordinates differ by more go out one reference at a time; survivors are verified.
    What is carried from batch to batch are the rows of the last part still within reach, with what they are
    linked to; they do not meet each other again. Only a forest of each batch's links is passed on, since components
    are all that is asked for, and in a crowded part rows of one component are not compared.
    """
    held = None
    for b in batches:
        part, node, fp = b.column("part").to_numpy(), b.column("node").to_numpy(), b.column("fp")
        if not len(part):
            continue
        fp = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(part), -1) if pa.types.is_binary(fp.type) else fp.to_numpy().view(np.uint64)[:, None]
        group, fresh = node, 0
        if held is not None:
            fresh = len(held[0])
            part, node, fp, group = (np.concatenate(x) for x in zip(held, (part, node, fp, group)))
        table = np.stack([np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(edges, len(part)))
        found = []
        for i, n in zip(edges[sizes >= CROWD].tolist(), sizes[sizes >= CROWD].tolist()):
            label = np.unique(group[i : i + n], return_inverse=True)[1]
            links = crowd_links(fp[i : i + n], table[i : i + n], label, max(0, fresh - i), distance)
            if len(links):
                found.append(i + links)
        rows, step = np.flatnonzero(np.repeat(sizes < CROWD, sizes)[:-1]), 1
        while len(rows):
            rows = rows[rows + step < len(fp)]
            near = (part[rows] == part[rows + step]) & (table[rows + step, 0] - table[rows, 0] <= distance)
            rows = rows[near]
            left = rows[rows + step >= fresh]
            for r in range(1, len(refs)):
                if not len(left):
                    break
                left = left[np.abs(table[left, r] - table[left + step, r]) <= distance]
            if len(left):
                left = left[np.bitwise_count(fp[left] ^ fp[left + step]).sum(axis=1) <= distance]
                found.append(np.stack([left, left + step], axis=1))
                if sum(map(len, found)) > 1 << 20:  # what is linked already needs no list of pairs
                    root = forest(np.concatenate(found), len(fp))
                    moved = np.flatnonzero(root != np.arange(len(fp)))
                    found = [np.stack([root[moved], moved], axis=1)]
            step += 1
        reach = (part == part[-1]) & (table[-1, 0] - table[:, 0] <= distance)
        if found:
            pairs = np.concatenate(found)
            root = forest(pairs, len(fp))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["src", "dst"])
            # rows linked in an earlier batch are one component with what any of them is linked to now
            number = np.unique(group, return_inverse=True)[1]
            group = node[forest(np.concatenate([pairs, np.stack([np.unique(number, return_index=True)[1][number], np.arange(len(fp))], axis=1)]), len(fp))]
        held = part[reach], node[reach], fp[reach], group[reach]


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the smallest row linked to it, by pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        fresh = root.copy()
        for side in (root[pairs[:, 0]], root[pairs[:, 1]], pairs[:, 0], pairs[:, 1]):
            np.minimum.at(fresh, side, low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, root):
            return root
        root = fresh


def thinned(links: DataFrame, n: int, at_once: int = 1_000_000) -> DataFrame:
    """Links with the same components and fewer of them: tasks of ``at_once`` links each give a forest."""

    def run(batches):
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
        if held:
            names, pairs = np.unique(np.concatenate(held), return_inverse=True)
            root = forest(pairs.reshape(-1, 2), len(names))
            moved = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], names=["src", "dst"])

    return links.select("src", "dst").repartition(n // at_once + 1).mapInArrow(run, "src bigint, dst bigint")


def link(fps: DataFrame, scratch: Scratch, distance: int = 3, references: int = 24, hot: int = 20_000) -> DataFrame:
    """``fps(fp, first)``, one row per distinct fingerprint -> ``(fp, component)``, the smallest ``first`` reachable.

    Fingerprints are dealt into parts by agreeing bit ranges (an exact cover of all pairs within ``distance``);
    a part with more than ``hot`` rows is dealt again by its remaining bits, exactly as well. Inside a part the
    pivot table discards pairs. Fingerprints without a link are absent from the result.
    """
    value = F.col("fp")

    def bits(ranges):
        mask = sum((1 << hi) - (1 << lo) for lo, hi in ranges)
        return F.expr(f"fp & {mask - (1 << 64) if mask >> 63 else mask}L")

    sets = bands(distance)
    dealt = fps.select(value, F.explode(F.array(*[F.struct(F.lit(i).alias("band"), bits(s).alias("bits")) for i, s in enumerate(sets)])).alias("x"))
    dealt = dealt.select("fp", F.col("x.band").alias("band"), F.col("x.bits").alias("bits"))
    sizes = dealt.groupBy("band", "bits").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, ["band", "bits"])
    again = []  # distance + 1 ranges of the bits outside the band: one at least agrees
    for i, s in enumerate(sets):
        free = [b for b in range(BITS) if not any(lo <= b < hi for lo, hi in s)]
        again += [(i, k, [(b, b + 1) for b in chunk.tolist()]) for k, chunk in enumerate(np.array_split(free, distance + 1))]
    sub = F.coalesce(*[F.when(F.col("band") == i, F.array(*[F.struct(F.lit(k).alias("k"), bits(r).alias("more")) for j, k, r in again if j == i])) for i in range(len(sets))])
    one = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("bigint").alias("more")))
    dealt = dealt.select("fp", "band", "bits", F.explode(F.when(F.col("n") > hot, sub).otherwise(one)).alias("y"))
    refs = pivots(references)
    first = int(refs[0, 0].astype(np.int64))
    dealt = dealt.select(F.xxhash64("band", "bits", "y.k", "y.more").alias("part"), F.col("fp").alias("node"), "fp", F.expr(f"bit_count(fp ^ {first}L)").alias("d0"))
    sorted_ = dealt.repartition("part").sortWithinPartitions("part", "d0").select("part", "node", "fp")
    links = sorted_.mapInArrow(lambda bs: link_partition(bs, refs, distance), "src bigint, dst bigint").distinct()
    ids = fps.select(F.col("fp").alias("src"), F.col("first").alias("a"))
    named = links.join(ids, "src").join(ids.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    found = connected_components(named.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    return fps.join(found.withColumnRenamed("node", "first"), "first").select("fp", "component")


def shingle_sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """``texts(node, text)`` -> ``(node, shingles)``: the sorted distinct hashes, 32 bits of each, as bytes.

    Two different shingles of a pair of texts coincide with a chance of some n * n / 2^33 for n shingles in both.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(distinct(t.as_py(), words, seed).astype("<u4")).tobytes() for t in b.column(1)], pa.binary())], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(run, "node bigint, shingles binary")


def similar_in_cell(fp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, distance: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of the links of rows ``left`` and ``right`` (numbers of rows) of a cell.

    Pairs at ``distance`` bits or fewer are candidates; those of rows that are not connected by then are checked
    by their sets. Rows meet the others in slices, one row first and twice as many each time up to 64, nearest
    pairs first in a slice, so a cell of near copies is one component after few slices and few pairs are held.
    """
    root = list(range(len(fp)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, at, width = [], 0, 1
    while at < len(left):
        rows = left[at : at + width]
        label = np.array(root)
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        apart = label[rows][:, None] != label[right]
        if left is right:
            apart &= rows[:, None] < right
        x, y = np.nonzero(apart)
        d = np.bitwise_count(fp[rows[x]] ^ fp[right[y]]).sum(axis=1, dtype=np.int16)
        near = np.flatnonzero(d <= distance)
        near = near[np.argsort(d[near], kind="stable")]
        for i, j in zip(rows[x[near]].tolist(), right[y[near]].tolist()):
            a, b = find(i), find(j)
            if a == b:
                continue
            x_, y_ = sets[i], sets[j]
            n = len(x_) + len(y_)
            if min(len(x_), len(y_)) < similarity * max(len(x_), len(y_)):
                continue
            both = np.concatenate((x_, y_))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= similarity * (n - common):
                root[max(a, b)] = min(a, b)
                links.append((i, j))
        at, width = at + width, min(2 * width, 64)
    return links


def check_cells(distance: int, similarity: float):
    """Rows (cell, node, chunk, a, b, fp, shingles) sorted by cell -> a forest of each cell's links, chunk a against chunk b."""

    def settle(t: pa.Table) -> list[tuple[int, int]]:
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(t.num_rows, -1)
        sets = [np.frombuffer(x, "<u4") for x in t.column("shingles").to_pylist()]
        chunk, node = t.column("chunk").to_numpy(), t.column("node").to_numpy()
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        left = np.flatnonzero(chunk == a)
        right = left if a == b else np.flatnonzero(chunk == b)
        return [(int(node[i]), int(node[j])) for i, j in similar_in_cell(fp, sets, left, right, distance, similarity)] if len(left) and len(right) else []

    def run(batches):
        held: list[pa.RecordBatch] = []

        def closed():
            found = settle(pa.Table.from_batches(held).combine_chunks()) if sum(h.num_rows for h in held) > 1 else []
            held.clear()
            return found

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["src", "dst"])

        for b in batches:
            cell = b.column("cell").to_numpy()
            if not len(cell):
                continue
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            links = []
            for k, (i, j) in enumerate(zip(edges, edges[1:])):
                if held and (k or held[0].column("cell")[0].as_py() != int(cell[0])):
                    links += closed()
                held.append(b.slice(i, j - i))
            yield out(links)
        if held:
            yield out(closed())

    return run


def link_similar(nodes: DataFrame, sets_of, scratch: Scratch, similarity: float, distance: int, width: int, tables: int, sample: int, references: int = 8, seed: int = 21, most_rows: int = 2_000, most_bytes: int = 8 << 20) -> DataFrame:
    """``nodes(fp binary, node)``, one row per distinct set -> ``(node, component)``; without a link absent.

    For distances too wide for an exact cover: fingerprints share a part if they agree in one of ``tables``
    random sets of ``sample`` bits. A pair that differs in a share p of its bits is missed with chance
    (1 - (1 - p)^sample)^tables. Inside a part the pivot table and the verification are those of ``link``, and its
    links make clusters of candidates. In a cluster all pairs within the distance are candidates; they are linked
    if their sets (``sets_of(nodes)`` gives ``(node, shingles)``) are ``similarity`` alike. No list of pairs is made: each
    node's set goes to its cluster's cell once, or, where a cluster has over ``most_rows`` nodes or ``most_bytes`` of
    sets, to one cell for each chunk of it, and cells are tasks of their own that give a forest of their links.
    """
    rng = np.random.default_rng(seed)
    picks = np.stack([rng.choice(width * BITS, sample, replace=False) for _ in range(tables)])
    refs = pivots(references, width)

    def deal(batches):
        weight = (1 << np.arange(sample)).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                raw = b.column(0)
                fp = np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(b.num_rows, -1)
                bits = np.unpackbits(fp.view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
                parts = (bits[:, picks.ravel()].reshape(-1, tables, sample) @ weight + np.arange(tables) * (1 << sample)).ravel()
                d0 = np.bitwise_count(fp ^ refs[0]).sum(axis=1, dtype=np.int32)
                take = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(parts), b.column(1).take(take), raw.take(take), pa.array(d0).take(take)], names=["part", "node", "fp", "d0"])

    dealt = nodes.select("fp", "node").mapInArrow(deal, "part bigint, node bigint, fp binary, d0 int")
    rows = dealt.repartition("part").sortWithinPartitions("part", "d0").select("part", "node", "fp")
    near = scratch.keep(rows.mapInArrow(lambda bs: link_partition(bs, refs, distance), "src bigint, dst bigint").distinct(), "near")
    clusters = scratch.keep(connected_components(thinned(near, near.count()), scratch).withColumnRenamed("component", "cluster"), "clusters")
    members = clusters.join(nodes.select("node", "fp"), "node").join(sets_of(clusters.select("node")), "node")
    members = scratch.keep(members.select("node", "cluster", "fp", "shingles"), "members")
    parts = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum(F.length("shingles")) / most_bytes)).cast("int")
    large = members.groupBy("cluster").agg(parts.alias("parts")).where("parts > 1")
    placed = members.join(checked_broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.least("chunk", "other"), F.greatest("chunk", "other")
    cells = placed.select(F.xxhash64("cluster", a, b).alias("cell"), "node", "chunk", a.alias("a"), b.alias("b"), "fp", "shingles")
    links = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(check_cells(distance, similarity), "src bigint, dst bigint")
    links = scratch.keep(links, "similar")
    scratch.drop("members")
    return scratch.keep(connected_components(thinned(links, links.count()), scratch), "components")


def text_components(docs: DataFrame, scratch: Scratch, words: int, seed: int, width: int, distance: int, tables: int, sample: int, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, node)`` for every row, and ``(node, component)`` for every distinct set of shingles."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    made = scratch.keep(fingerprints(rows, words, seed, width=width, sets="node", keys=("doc_id", "text_hash")), "fingerprints")
    keyed = made.select("doc_id", "text_hash", "node")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("text"))
    nodes = scratch.keep(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min(row).alias("row")), "nodes")

    def sets_of(some: DataFrame) -> DataFrame:
        """Sets of some nodes, from the text of one row of each."""
        of = nodes.join(some, "node").select("node", "row.last", "row.id", "row.text")
        keys = rows.select(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("text"), F.col("text").alias("t"))
        return shingle_sets(keys.join(checked_broadcast(of), ["last", "id", "text"]).select("node", F.col("t").alias("text")), words, seed)

    found = link_similar(nodes.select("fp", "node"), sets_of, scratch, similarity, distance, width, tables, sample)
    return keyed, nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def similar_texts(docs: DataFrame, words: int = 5, seed: int = 42, width: int = 4, distance: int = 48, tables: int = 42, sample: int = 14, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` for every row: texts whose sets of shingles of five words are 0.8 alike or more are linked.

    Sets of shingles with similarity J differ in a share acos(2J / (1 + J)) / pi of SimHash bits: 0.15 at 0.8, or
    38 of the 256 bits used here, give or take 6; unrelated texts differ in 128. Pairs at ``distance`` bits or
    fewer (some 95 % of those exactly 0.8 alike) are candidates, and linked if their sets are ``similarity``
    alike by count. Nulls, blanks, repeated rows and ids as in ``near_duplicates``.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    keyed, named = text_components(docs, scratch, words, seed, width, distance, tables, sample, doc_id, text, similarity)
    per = keyed.groupBy("node").agg(F.min("doc_id").alias("low")).join(named, "node")
    low = per.groupBy("component").agg(F.min("low").alias("component_id"))
    return keyed.join(named.join(low, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest doc_id reachable by links, itself included.

    Equal fingerprints (exact copies, null, empty and blank texts among them) are one node, so a group of
    copies costs one row however large it is. Null ids take part by their text but are never a component's
    name unless no other id is there (then null). Repeated ids give repeated rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    keyed = scratch.keep(fingerprints(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), words, seed), "fingerprints")
    # nodes are named by their fingerprints, for ids may be null or shared; the smallest id follows at the end
    nodes = scratch.keep(keyed.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("first", F.col("fp")), "nodes")
    found = link(nodes.select("fp", "first"), scratch, distance)
    named = nodes.join(found, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(low, "component").select("fp", "component_id")
    return keyed.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, seed: int = 42, width: int = 4, distance: int = 48, tables: int = 42, sample: int = 14, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts.

    Groups are of texts, as ``similar_texts`` links them, so two rows of one id with different texts are two rows.
    Of a group the row with the smallest id stays; a null id is behind all others; of one id's rows that with the
    least text hash; of rows equal in both, that with the least hash of the other columns. Null, empty and
    blank texts are one group. All columns pass through; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    keyed, named = text_components(docs, scratch, words, seed, width, distance, tables, sample, doc_id, text, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("text"))
    first = keyed.groupBy("node").agg(F.min(order).alias("row")).join(named, "node").groupBy("component").agg(F.min("row").alias("row"))
    winners = scratch.keep(first.select(*[F.col(f"row.{c}").alias(f"{OWN}{c}") for c in ("last", "id", "text")]), "winners")
    own = F.col(f"`{doc_id}`").cast("bigint")
    keys = {"last": own.isNull(), "id": F.coalesce(own, F.lit(0)), "text": F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))}
    rows = docs.withColumns({f"{OWN}{k}": v for k, v in keys.items()}).join(winners, [f"{OWN}{k}" for k in keys], "left_semi")
    others = [f"`{c}`" for c in docs.columns]
    place = F.row_number().over(Window.partitionBy(*[f"{OWN}{k}" for k in keys]).orderBy(F.xxhash64(*others)))
    return rows.withColumn(f"{OWN}place", place).where(f"{OWN}place = 1").select(*others)
