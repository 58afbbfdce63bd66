"""Packages: entity tables saved as a numbered generation that becomes current only when it is whole; mask blobs; JSON."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmesh.session import ship

POINTER = "CURRENT"


class PackageError(RuntimeError):
    """A package that is missing, or whose files are not those that were saved."""


class _Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.gateway, self.conf = spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(self.conf)
        self.root = root.rstrip("/")

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def read_text(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        with_stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def put_text(self, name: str, text: str) -> None:
        """Write beside, then rename over: readers see the old text or the new."""
        stream = self.fs.create(self.at(name + ".new"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        over = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        files.rename(files.makeQualified(self.fs.makeQualified(self.at(name + ".new"))), files.makeQualified(self.fs.makeQualified(self.at(name))), how)


def _generations(folder: _Folder) -> list[int]:
    return sorted(int(n[4:]) for n in folder.names() if n.startswith("gen-") and n[4:].isdigit())


def _checksums(spark: SparkSession, where: str, names: list[str]) -> DataFrame:
    """Path within the generation, rows and digest (a sum and an xor of hashes of the rows) of every data file.

    Files are read row by row by the executors, so one of any size needs no more memory than another.
    """
    parts = []
    for name in names:
        rows = spark.read.parquet(f"{where}/{name}")
        hashed = rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)$", 1).alias("file"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("h"))
        digest = F.concat_ws(":", F.hex(F.bit_xor("h")), F.sum(F.col("h").cast("decimal(20,0)")).cast("string"))
        parts.append(hashed.groupBy("file").agg(F.count("*").alias("rows"), digest.alias("digest")))
    return reduce(DataFrame.unionByName, parts)


def save(spark: SparkSession, tables: dict[str, DataFrame], root: str, keep: int = 2) -> int:
    """Save a new generation: write, check what was written, rename, point to it, and drop generations before the last
    ``keep``. A failure before the pointer is set leaves the current generation as it was."""
    folder = _Folder(spark, root)
    number = max(_generations(folder), default=0) + 1
    pending = f"gen-{number}.tmp"
    folder.fs.delete(folder.at(pending), True)
    for name, df in tables.items():
        df.write.parquet(f"{folder.root}/{pending}/{name}")
    _checksums(spark, f"{folder.root}/{pending}", list(tables)).coalesce(1).write.parquet(f"{folder.root}/{pending}/_sums")
    _verify(spark, f"{folder.root}/{pending}", list(tables))
    if not folder.fs.rename(folder.at(pending), folder.at(f"gen-{number}")):
        raise PackageError("cannot rename the new generation")
    folder.put_text(POINTER, f"gen-{number}\n")
    for old in _generations(folder)[:-keep]:
        folder.fs.delete(folder.at(f"gen-{old}"), True)
    return number


def _verify(spark: SparkSession, where: str, names: list[str]) -> None:
    try:
        saved, now = spark.read.parquet(f"{where}/_sums"), _checksums(spark, where, names)
        differ = saved.join(now, ["file", "rows", "digest"], "full_outer").groupBy("file").count().filter("count > 1").limit(1).count() or saved.join(now, ["file", "rows", "digest"], "left_anti").limit(1).count()
    except (Py4JJavaError, PySparkException) as fault:  # a file that cannot be read any more
        raise PackageError(f"files of {where} cannot be read") from fault
    if differ:
        raise PackageError(f"files of {where} differ from those saved")


def load(spark: SparkSession, root: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of the current generation; a root without a pointer holds them directly."""
    folder = _Folder(spark, root)
    current = folder.read_text(POINTER)
    inner = _Folder(spark, f"{folder.root}/{current.strip()}") if current else folder
    names = [n for n in inner.names() if not n.startswith(("_", ".", "gen-")) and n != POINTER]
    if not names:
        raise PackageError(f"no package at {root}")
    if verify and current:
        _verify(spark, inner.root, names)
    return {n: spark.read.parquet(f"{inner.root}/{n}") for n in names}


# --- sessions: samples with the gallery beside them -------------------------------------------------------------------------

GALLERY = ("subject_refs", "embeddings", "identity_audit")


def save_session(spark: SparkSession, samples: DataFrame, gallery: dict[str, DataFrame], root: str, keep: int = 2) -> int:
    """One generation of samples and of what is there of the gallery's tables."""
    return save(spark, {"track_samples": samples, **{n: df for n, df in gallery.items() if n in GALLERY}}, root, keep)


def load_session(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """The samples, the gallery's tables, and each track's subject (source_id, track_id, subject_id): the last one that the
    audit gives, else the last one of its samples."""
    tables = load(spark, root)
    samples = tables["track_samples"]
    seen = samples.filter("subject_id is not null").groupBy("source_id", "track_id").agg(F.max_by("subject_id", "sample_id").alias("seen"))
    if "identity_audit" not in tables:
        return samples, {n: tables[n] for n in GALLERY if n in tables}, seen.withColumnRenamed("seen", "subject_id")
    told = tables["identity_audit"].filter("assigned_subject is not null").groupBy("source_id", "track_id").agg(F.max_by("assigned_subject", "audit_id").alias("told"))
    subjects = told.join(seen, ["source_id", "track_id"], "full_outer").select("source_id", "track_id", F.coalesce("told", "seen").alias("subject_id"))
    return samples, {n: tables[n] for n in GALLERY if n in tables}, subjects


def put_redactions(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Add redaction intervals to those at a path, or put them in their place."""
    rows.write.mode("overwrite" if replace else "append").parquet(path)


# --- mask blobs: little-endian handle and length of eight bytes each, then the bytes ----------------------------------------


def _eight(value: Column) -> Column:
    """A long as eight bytes, lowest first."""
    return F.unhex(F.concat_ws("", F.reverse(F.regexp_extract_all(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1)))))


def blob_entry(handle: Column, data: Column) -> Column:
    """One entry; entries joined in any order make a blob."""
    return F.concat(_eight(handle), _eight(F.octet_length(data)), data)


def read_blobs(files: DataFrame, column: str = "content") -> DataFrame:
    """(mask_ref, data) of blobs; one that ends within an entry is an error."""
    ship(files.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf[column].dropna():
                rows, at = [], 0
                while at < len(blob):
                    size = int.from_bytes(blob[at + 8 : at + 16], "little")
                    if at + 16 + size > len(blob):
                        raise ValueError("a mask blob ends within an entry")
                    rows.append((int.from_bytes(blob[at : at + 8], "little"), bytes(blob[at + 16 : at + 16 + size])))
                    at += 16 + size
                yield pd.DataFrame(rows, columns=["mask_ref", "data"])

    return files.select(column).mapInPandas(parse, "mask_ref long, data binary")


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a line of JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json(lines: DataFrame, schema) -> DataFrame:
    """Rows of lines of JSON; a line that does not parse is an error."""
    parsed = F.from_json("json", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")
