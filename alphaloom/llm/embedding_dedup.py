"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import connected_components
from .simhash import forest


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def hashes(x: np.ndarray, tables: int, polytopes: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest cross-polytope vertices: arrays (rows, tables, polytopes)."""
    n, dim = x.shape
    wide = 1 << max(1, (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    padded = np.zeros((n, wide))
    padded[:, :dim] = x
    best, second = (np.empty((n, tables, polytopes), np.int64) for _ in range(2))
    for t in range(tables):
        for k in range(polytopes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), wide))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = np.take_along_axis(size, top, 1)
            top = np.where((swap[:, :1] >= swap[:, 1:]), top, top[:, ::-1])
            vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best[:, t, k], second[:, t, k] = vertex[:, 0], vertex[:, 1]
    return best, second


def probes(best: np.ndarray, second: np.ndarray, width: int) -> np.ndarray:
    """Bucket numbers (rows, tables, 1 + polytopes): the home bucket, then with one vertex replaced by the second nearest."""
    n, tables, polytopes = best.shape
    power = width ** np.arange(polytopes)
    out = [(best * power).sum(axis=2)]
    for k in range(polytopes):
        other = best.copy()
        other[:, :, k] = second[:, :, k]
        out.append((other * power).sum(axis=2))
    return np.stack(out, axis=2)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows' bucket numbers (pairs, tables, probes): the first (table, bucket) they share, at home or in a probe, as one number."""
    none = np.iinfo(np.int64).max
    bucket = np.full((len(a), a.shape[1]), none)
    for p in range(a.shape[2]):
        for q in range(b.shape[2]):
            hit = a[:, :, p] == b[:, :, q]
            bucket[hit] = np.minimum(bucket[hit], a[:, :, p][hit])
    table = np.argmax(bucket < none, axis=1)
    return table * (1 << 40) + bucket[np.arange(len(a)), table]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; divided by their largest component first, so that squares neither vanish nor overflow."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_links(ids, copies, x, buckets, here: int, chunk, pair, threshold: float):
    """Verified links inside one cell: (id, links to vectors of this cell's first meetings, id it hangs on)."""
    if pair[0] == pair[1]:
        left = right = np.arange(len(ids))
    else:
        left, right = np.flatnonzero(chunk == pair[0]), np.flatnonzero(chunk == pair[1])
    count, found = np.zeros(len(ids), np.int64), []
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold - 1e-9)
        i, j = rows[i], right[j]
        if pair[0] == pair[1]:
            i, j = i[i < j], j[i < j]
        # exact cosine in double precision, then only where this cell is the pair's first meeting
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        mine = first_shared(buckets[i], buckets[j]) == here
        i, j = i[mine], j[mine]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        if len(i):
            found.append(np.stack([i, j], axis=1))
    root = forest(np.concatenate(found), len(ids)) if found else np.arange(len(ids))
    some = np.flatnonzero(count)
    return ids[some], count[some], ids[root[some]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tables: int = 10, polytopes: int = 2, crowded: int = 2_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. Vectors that are null, zero, of another length than their label's others, or hold null or
    non-finite components link with nothing. Equal vectors of a label are one node with a count, so a group of
    copies costs one row. Repeated ids are one id in components, and each row counts as a vector; a null id has
    a null component unless others are linked to it. Other columns are ignored; an empty table stays empty.

    Candidates share a bucket of one of ``tables`` tables, each at home or in a probe; all candidates are verified, so no link below the threshold is given, and recall is what hashing
    finds (tests hold it against brute force). Vectors travel in the precision they have (``array<float>`` at half the
    bytes of doubles), bucket numbers as two vertices of each polytope. A bucket with over ``crowded`` vectors is compared in blocks
    that are tasks of their own. A pair counts only where it meets first, so no list of pairs is made.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    src = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("bigint").alias("label"))
    fine = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0) & F.col("label").isNotNull(),
        F.lit(False),
    )
    keyed = src.withColumn("fine", fine).withColumn("h", F.xxhash64("label", "v"))
    nodes = scratch.keep(
        keyed.where("fine").groupBy("label", "h", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "v")),
        "nodes",
    )
    width = 1 << 12
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4") if single else np.dtype("<f8")

    def place(batches):
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = np.stack([flat[ends[r] - dim : ends[r]] for r in rows])
                vertices = hashes(unit(x), tables, polytopes)
                all_ = probes(*vertices, width)
                raw = [r.tobytes() for r in x.astype(kind)]
                marks = [r.tobytes() for r in np.stack(vertices, axis=1).astype("<i2")]
                t, p = np.meshgrid(np.arange(tables), np.arange(polytopes + 1), indexing="ij")
                here = (t.ravel()[None, :] * (1 << 40) + all_.reshape(len(x), -1)).ravel()
                # one row per different bucket
                own = np.repeat(np.arange(len(x)), tables * (polytopes + 1))
                once = np.unique(np.stack([own, here], axis=1), axis=0)
                o = once[:, 0]
                take = pa.array(rows[o])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(np.full(len(o), dim), pa.int32()), b.column(2).take(take), b.column(3).take(take), pa.array(once[:, 1]), pa.array([raw[i] for i in o], pa.binary()), pa.array([marks[i] for i in o], pa.binary())],
                    names=["label", "dim", "node", "copies", "here", "x", "marks"],
                )

    placed = nodes.select("label", "v", "node", "copies").mapInArrow(place, "label bigint, dim int, node bigint, copies bigint, here bigint, x binary, marks binary")
    keys = ["label", "dim", "here"]
    crowd = placed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / crowded).cast("int")
    cells = placed.join(crowd, keys).withColumn("parts", parts).withColumn("chunk", F.pmod(F.col("node"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(F.xxhash64(*keys, F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "here", "node", "copies", "x", "marks", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def settle(t: pa.Table):
            x = unit(np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(t.num_rows, -1))
            vertices = np.frombuffer(b"".join(t.column("marks").to_pylist()), "<i2").astype(np.int64).reshape(t.num_rows, 2, tables, polytopes)
            marks = probes(vertices[:, 0], vertices[:, 1], width)
            return cell_links(t.column("node").to_numpy(), t.column("copies").to_numpy(), x, marks, t.column("here")[0].as_py(), t.column("chunk").to_numpy(), (t.column("a")[0].as_py(), t.column("b")[0].as_py()), threshold)

        def out(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if parts else pa.array([], pa.int64()) for c in (zip(*parts) if parts else ((), (), ()))], names=["node", "links", "root"])

        for b in batches:
            cell = b.column("cell").to_numpy()
            if not len(cell):
                continue
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            done = []
            for k, (i, j) in enumerate(zip(edges, edges[1:])):
                piece = b.slice(i, j - i)
                if k == 0 and held and held[0].column("cell")[0].as_py() != int(cell[0]):
                    done.append(settle(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                held.append(piece)
                if j < len(cell):
                    if held[0].num_rows > 1 or len(held) > 1:
                        done.append(settle(pa.Table.from_batches(held).combine_chunks()))
                    held = []
            yield out(done)
        if held:
            yield out([settle(pa.Table.from_batches(held).combine_chunks())])

    links = scratch.keep(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "node bigint, links bigint, root bigint"), "links")
    found = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("label", "h", "v", "node", "low", "copies").join(counts, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = keyed.where("fine").join(named, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionAll(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
