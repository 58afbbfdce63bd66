"""The binary column format of track samples: a head, then each column's values one after another, all little-endian.

A table is encoded in blocks of bounded size, one row of bytes each; a block is a whole file of the format.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.session import ship

#: Fixed values of the format: the head's mark and version; the columns in their order, whether they can be null, and their
#: type. A column that can be null begins with a bit a row (lowest first) for the rows that have a value.
MAGIC, VERSION = b"SLARROW1", 1
COLUMNS = (
    ("sample_id", False, "<u8"), ("supersedes", True, "<u8"), ("revision", False, "<u4"), ("idempotency_key", False, "<u8"), ("source_id", False, "<u4"), ("frame_index", False, "<u8"),
    ("pts_value", False, "<i8"), ("pts_timescale", False, "<u4"), ("track_id", False, "<u4"), ("track_uid", True, "<u8"), ("subject_id", True, "<u8"), ("class_id", True, "<u2"),
    ("left", False, "<f4"), ("top", False, "<f4"), ("right", False, "<f4"), ("bottom", False, "<f4"), ("confidence", False, "<f4"), ("mask_ref", False, "<u8"),
)
SCHEMA = ", ".join(f"{n} {'float' if t == '<f4' else 'long'}" for n, _, t in COLUMNS)
HEAD = len(MAGIC) + 8


def encode_block(columns: dict[str, tuple[np.ndarray, np.ndarray]], n: int) -> bytes:
    """columns: values, and which of them are there."""
    out = [MAGIC, np.array([VERSION, n], "<u4").tobytes()]
    for name, optional, kind in COLUMNS:
        values, there = columns[name]
        if optional:
            out.append(np.packbits(there, bitorder="little").tobytes())
        elif not there.all():
            raise ValueError(f"{name} has no value in some row")
        out.append(np.where(there, values, 0).astype(kind).tobytes())
    return b"".join(out)


def decode_block(data: bytes) -> dict[str, np.ma.MaskedArray]:
    """The columns of a block; bytes of another format, or too few, are a ValueError."""
    if len(data) < HEAD or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of track columns")
    version, n = np.frombuffer(data, "<u4", 2, len(MAGIC)).tolist()
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    at, out = HEAD, {}
    for name, optional, kind in COLUMNS:
        bits, size = -(-n // 8) if optional else 0, n * np.dtype(kind).itemsize
        if at + bits + size > len(data):
            raise ValueError(f"the file ends within {name}")
        there = np.unpackbits(np.frombuffer(data, np.uint8, bits, at), bitorder="little")[:n].astype(bool) if optional else np.ones(n, bool)
        out[name] = np.ma.MaskedArray(np.frombuffer(data, kind, n, at + bits), ~there)
        at += bits + size
    return out


def encode(samples: DataFrame) -> DataFrame:
    """(content): a block for each Arrow batch of samples, whose times are in nanoseconds; missing optional columns are null."""
    ship(samples.sparkSession)
    own = {"pts_value": F.col("pts_ns"), "pts_timescale": F.lit(1_000_000_000)}
    rows = samples.select(*[own.get(n, F.col(n) if n in samples.columns else F.lit(None)).cast("double" if t == "<f4" else "long").alias(n) for n, _, t in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = {c: np.asarray(batch.column(c).is_valid()) for c in batch.schema.names}
            filled = {c: (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False), there[c]) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict({"content": [encode_block(filled, batch.num_rows)]})

    return rows.mapInArrow(run, "content binary")


def decode(blocks: DataFrame, column: str = "content") -> DataFrame:
    """The samples of blocks, with pts_ns of their times (truncated towards zero)."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):  # block by block: no second copy of all that a batch holds
                found = decode_block(memoryview(value.as_buffer()))
                kinds = {n: pa.float32() if t == "<f4" else pa.int64() for n, _, t in COLUMNS}
                yield pa.RecordBatch.from_arrays([pa.array(found[n].data.astype(kinds[n].to_pandas_dtype()), kinds[n], mask=found[n].mask if found[n].mask.shape else None) for n in kinds], names=list(kinds))

    rows = blocks.select(column).mapInArrow(run, SCHEMA)
    from trackmesh.functions.scalars import media_time_ns

    return rows.withColumn("pts_ns", media_time_ns("pts_value", "pts_timescale"))
