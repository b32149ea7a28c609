"""Documents dealt into buckets of bounded size, and compact messages between buckets and groups.

A bucket is the unit in which work on texts is combined before anything is shuffled: all its documents meet in one
task, in the same order whenever they are read. Messages are numpy arrays in binary columns: one row for each pair of
bucket and group instead of one for each word position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 4 << 20
SKIP = 65535


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about bucket_bytes of text each, and no fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))


def dealt(docs: DataFrame, n: int, keep: list[str], id_col: str, text: str) -> DataFrame:
    """bucket, id (long), text and `keep` columns as k0, k1, ..; the bucket comes from id and text."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text)), F.lit(n)).cast("int").alias("bucket"),
        F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"),
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])


def in_order(bucket: pa.Table) -> pa.Table:
    """Rows by id, nulls last; rows of one id by text."""
    bucket = bucket.combine_chunks()
    return bucket.take(pc.sort_indices(bucket, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


def ids_of(bucket: pa.Table) -> np.ndarray:
    """Ids as integers; a null id comes after all others."""
    return pc.fill_null(bucket.column("id"), np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers below 2 ** 32 as steps: of 16 bits, a longer one as several, or of 32 bits where that is shorter."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    skips = steps // SKIP
    more = int(skips.sum())
    if more > len(steps):
        return b"\x01" + steps.astype("<u4").tobytes()
    out = np.full(len(steps) + more, SKIP, "<u2")
    out[np.cumsum(skips + 1) - 1] = steps % SKIP
    return b"\x00" + out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.cumsum(np.frombuffer(raw, "<u4", offset=1), dtype=np.int64)
    steps = np.frombuffer(raw, "<u2", offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != SKIP]


def strings(data: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Arrow texts from bytes in a row; ends: n + 1 places."""
    kind = kind or pa.string()
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)),
                                                       pa.py_buffer(np.ascontiguousarray(data))])
