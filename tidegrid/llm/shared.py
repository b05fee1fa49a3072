"""Helpers that several operators share: parts of a corpus, hashed exchanges between parts, tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Sorts after every real doc_id: rows whose doc_id is null come last and precede nobody.
NO_ID = np.iinfo(np.int64).max
PART_BYTES = 4 << 20
ANSWERS = "part int, bucket int, stage int, bits binary"
ASKED = "part int, bucket int, n int, keys binary, more binary"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only where that is unset (tests, one machine), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_tidegrid_dir", None)
        if base is None:
            holder = tempfile.TemporaryDirectory(prefix="tidegrid-")
            atexit.register(holder.cleanup)
            base = spark._tidegrid_dir = holder.name
    return f"{base.rstrip('/')}/tidegrid-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: it cuts the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]


def parted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, at_least: int = 64) -> tuple[DataFrame, int]:
    """doc_id, text and part, and the number of parts: hashes of doc_id, of about part_bytes of text each.

    A part is the unit that meets its own answers again, so it is grouped by this column whatever the
    cluster's partitions are. Parts grow in number, not in size.
    """
    n = max(at_least, -(-text_bytes(docs, text) // part_bytes))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(n)).cast("int").alias("part")
    ), n


def bucket_bits(n_parts: int) -> int:
    """log2 of the number of hash buckets of an exchange: as many as parts, 64 at least."""
    return max(6, int(n_parts).bit_length())


def in_order(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """doc_ids and texts of a part, by doc_id and then text, so that any rerun sees the same order."""
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    text = table["text"].combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py() or "")))
    return ids[order], text.cast(pa.large_string()).take(pa.array(order))


def null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(U64)


def ask(part: int, hashes: np.ndarray, bits: int, width: int, keys: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket that has some of the sorted, distinct hashes: the top `bits` bits choose the bucket, `width` bytes of `keys` go there."""
    keys = hashes if keys is None else keys
    bucket = (hashes >> U64(64 - bits)).astype(np.int64)
    which = np.unique(bucket)
    lo, hi = np.searchsorted(bucket, which, "left"), np.searchsorted(bucket, which, "right")
    return pa.table(
        {
            "part": pa.array(np.full(len(which), part, np.int32)),
            "bucket": pa.array(which.astype(np.int32)),
            "n": pa.array((hi - lo).astype(np.int32)),
            "keys": pa.array([pack_keys(keys[a:b], width) for a, b in zip(lo, hi)], pa.binary()),
            "more": pa.array([None if more is None else more[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
        }
    )


def gathered(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A bucket's rows in the order of their parts, with all keys and the row of each."""
    table = table.sort_by("part")
    n = table["n"].to_numpy()
    return table, unpack_keys(b"".join(table["keys"].to_pylist()), width), np.repeat(np.arange(len(n)), n)


def reply(table: pa.Table, flags: np.ndarray, stage: int) -> pa.Table:
    """The flags of a bucket's keys, a bit each, on their way back to the parts."""
    at = np.concatenate([[0], np.cumsum(table["n"].to_numpy())])
    return pa.table(
        {
            "part": table["part"].cast(pa.int32()),
            "bucket": table["bucket"].cast(pa.int32()),
            "stage": pa.array(np.full(len(table), stage, np.int32)),
            "bits": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
        }
    )


def answered(table: pa.Table, stage: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The flag of each of the sorted, distinct hashes that a part asked about."""
    out = np.zeros(len(hashes), bool)
    bucket = (hashes >> U64(64 - bits)).astype(np.int64)
    for b, s, raw in zip(table["bucket"].to_pylist(), table["stage"].to_pylist(), table["bits"].to_pylist()):
        if s == stage:
            lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
            out[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).astype(bool)
    return out


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position and the length of each run of equal keys."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.append(at, len(sorted_keys)))


def give_back() -> None:
    """Returns freed memory to the system. Python workers are kept between tasks, so what one stage freed would else stay theirs beside the next stage's needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.Table], schema: str) -> DataFrame:
    """mapInArrow of one function from a batch to a table."""

    def run(batches):
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield from out.to_batches()
        del batches
        give_back()

    return docs.mapInArrow(run, schema)


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

