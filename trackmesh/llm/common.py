"""What the operators of this subpackage share: input shaping, the shared folder, vectorised word hashes."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmesh.shared import write_once as materialize  # noqa: F401

#: Rows are handed to per-document code in slices of at most this many.
SLICE_ROWS = 256


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) only; any other column, whatever its name, is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes for a scan); sets numbers of shards, never what is computed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 30


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def give_back() -> None:
    """Hand memory that is free but held back to the system: a worker goes on to other tasks beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of few rows, and of about max_bytes unless one row alone is larger."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and _sliced_bytes(batch, at, n) > max_bytes:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n
    give_back()


def _sliced_bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes


def map_rows(df: DataFrame, per_slice: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow over slices; per_slice returns the output columns by name."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(per_slice(part), schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_FLAT_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of columns of flat types; needs no session, so workers can call it."""
    return pa.schema([pa.field(name, _FLAT_TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


# --- vectorised word hashes -------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse powers modulo 2**64 for i < n."""
    have = _pow_cache.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            step, done = b, 1
            while done < size:  # doubling
                k = min(done, size - done)
                p[done : done + k] = p[:k] * np.uint64(step)
                done += k
                step = step * step & _MASK
            out.append(p)
        have = (out[0], out[1])
        if size <= 1 << 22:
            _pow_cache[base] = have
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: prefix sums of a polynomial modulo 2**64, so linear in the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(_BASE, len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p)))
    return mix64((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(_WORD))


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    p, inv = _powers(_WORD, len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((words ^ np.uint64(salt)) * p)))
    return mix64((total[n:] - total[:-n]) * inv[: len(words) - n + 1])


def text_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, word starts, word ends and word hashes of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data)
    return data, starts, ends, word_hashes(data, starts, ends)
