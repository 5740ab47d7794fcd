"""Rows packed by bucket: Arrow record batches that travel as one binary value for each bucket and batch.

Dealing packed rows spares Spark a row object for each of billions of small records; Spark still partitions
and shuffles the work, by the bucket column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back

SCHEMA = "bucket int, kind string, payload binary"
NAMES = ["bucket", "kind", "payload"]


def deal(rows: pa.RecordBatch, bucket: np.ndarray, kind: str, compress: bool = False) -> Iterator[tuple[int, str, bytes]]:
    """Splits a record batch by bucket number."""
    if not rows.num_rows:
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(pa.array(order)), bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    options = pa.ipc.IpcWriteOptions(compression="zstd" if compress else None)
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as to:
            to.write_batch(rows.slice(a, b - a))
        yield int(bucket[a]), kind, sink.getvalue().to_pybytes()


def as_batch(found: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(p, pa.binary())], names=NAMES)


def unpack(group: pa.Table, kind: str) -> pa.Table | None:
    """All rows of one kind in a bucket's group, or None."""
    kinds = group.column("kind").to_pylist()
    found = [pa.ipc.open_stream(group.column("payload")[i].as_buffer()).read_all() for i, k in enumerate(kinds) if k == kind]
    return pa.concat_tables(found).combine_chunks() if found else None


def per_bucket(rows: DataFrame, f: Callable[[pa.Table], list[tuple[int, str, bytes]]]) -> DataFrame:
    """Applies ``f`` to each bucket's packed rows; it returns packed rows again."""

    def run(group: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([as_batch(f(group))])
        give_back()
        return out

    return rows.groupBy("bucket").applyInArrow(run, SCHEMA)
