"""N-gram Jaccard join by MinHash banding.

Texts with the same word sequence are one class; only classes are compared. Bands and rows are chosen so that a pair at
the threshold meets in a band with the target probability. Band hashes are shuffled with ids alone. Every two classes
that meet in a band are verified once, in the first band they share, on the full n-gram sets. A bucket is cut into parts,
and each two parts are one block: so a group of any size is spread over many tasks. Of a block only each class's number
of links and the smallest class it is joined to leave the task, so no group is expanded into rows of pairs.

Cases: null or empty text has no n-gram; a text of fewer than n words is one n-gram of all its words. Both kinds join
only their own copies. Repeated rows are copies. A group is named by its smallest doc_id, and by null only where none of
its rows has one. Very long texts are compared whole. Other columns, whatever their names, play no part and are kept by
keep_first. Empty tables give no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.common import arrow_schema, doc_texts, gram_hashes, map_rows, materialize, mix64, slices, text_words


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose_banding(threshold: float, target_recall: float, most_hashes: int = 160) -> Banding:
    """The most rows a band (so the fewest chance meetings) that reach the target within most_hashes."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within most_hashes")
    return best


def signatures(grams: np.ndarray, banding: Banding) -> np.ndarray:
    """One 64-bit hash for each band of a set of n-gram hashes."""
    k = banding.bands * banding.rows
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    low = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(grams), 1024):
        part = grams[at : at + 1024]
        low = np.minimum(low, ((part[None, :] * seeds[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    per_band = low.reshape(banding.bands, banding.rows).astype(np.uint64)
    out = np.arange(banding.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(banding.rows):
        out = mix64(out ^ per_band[:, r])
    return out


def shingles(text: str, n: int) -> tuple[np.ndarray, tuple[int, int], int]:
    """Sorted distinct n-gram hashes, a 128-bit hash of the word sequence (two signed longs), and the number of words."""
    words = text_words(text)[3]
    if not len(words):
        return np.zeros(0, np.uint64), (0, 0), 0
    whole = [gram_hashes(words, len(words), salt)[0] for salt in (0x5BD1E995, 0x1B873593)]
    grams = np.unique(gram_hashes(words, n)) if len(words) >= n else np.array([whole[0]], np.uint64)
    return grams, (int(whole[0].astype(np.int64)), int(whole[1].astype(np.int64))), len(words)


SPREAD = 16
#: Classes in a part of a bucket; n-grams in a piece of a block's matrix; so many pairs are compared one by one.
BLOCK, COLUMNS, FEW_PAIRS = 128, 4096, 16


def _key() -> Column:
    """Tells rows of one doc_id but different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def class_bands(docs: DataFrame, n: int, banding: Banding) -> DataFrame:
    """doc_id, key, the hash of the word sequence (h1, h2) and band hashes; no bands for texts under n words."""

    def per_slice(batch: pa.RecordBatch) -> dict:
        h1, h2, bands = [], [], []
        for text in batch.column(2).to_pylist():
            grams, whole, words = shingles(text, n)
            h1.append(whole[0])
            h2.append(whole[1])
            bands.append(signatures(grams, banding).astype(np.int64) if words >= n else np.zeros(0, np.int64))
        return {"doc_id": batch.column(0), "key": batch.column(1), "h1": h1, "h2": h2, "bands": bands}

    rows = doc_texts(docs).select("doc_id", _key().alias("key"), "text")
    return map_rows(rows, per_slice, "doc_id long, key long, h1 long, h2 long, bands array<long>")


def _gram_sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(class, grams) of the needed classes, each of which names one document (doc_id and key) with its words (h1, h2)."""
    needed = materialize(needed.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "class", "h1", "h2"), "needed")
    # texts go to the needed classes' partitions, whose names are hashed there: the same plan at any size
    texts = doc_texts(docs).withColumn("key", _key()).join(needed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        got = [(c, grams) for c, h1, h2, (grams, whole, _) in ((c, h1, h2, shingles(text, n)) for c, h1, h2, text in rows) if whole == (h1, h2)]
        return {"class": [c for c, _ in got], "grams": [g.tobytes() for _, g in got]}

    # repeated rows of a class's document give its set again
    return materialize(map_rows(texts.select("class", "h1", "h2", "text"), per_slice, "class long, grams binary").dropDuplicates(["class"]), "grams")


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sorted sets have in common."""
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owners = every[order], owners[order]
    column = np.cumsum(np.concatenate(([False], every[1:] != every[:-1])), dtype=np.int32)
    del every, order
    several = np.bincount(column)[column] > 1  # what a single set has adds nothing
    owners, column = owners[several], column[several]
    column = np.cumsum(np.concatenate(([False], column[1:] != column[:-1])), dtype=np.int32) if len(column) else column
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owners[lo:hi], column[lo:hi] - at] = 1
        out += has @ has.T
    return out


def block_links(band: int, across: bool, own: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two classes of a block have at least the threshold on their full n-gram sets, as a symmetric matrix.

    Only pairs that meet in no earlier band, and that lie across the two halves of a block where it has two.
    """
    sizes = np.array([len(x) for x in sets], np.float64)
    asked = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    if across:
        asked &= own[:, None] != own[None, :]
    for b in range(band):
        asked &= bands[:, b][:, None] != bands[:, b][None, :]
    asked &= np.minimum.outer(sizes, sizes) >= (threshold - 1e-9) * np.maximum.outer(sizes, sizes)
    links = np.zeros_like(asked)
    x, y = np.nonzero(asked)
    if len(x) > FEW_PAIRS:
        shared = _in_common(sets)[x, y].astype(np.float64)
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.float64)
    links[x, y] = shared / (sizes[x] + sizes[y] - shared) >= threshold
    return links | links.T


def _firsts(links: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Of what links join: each name but the smallest, with the smallest."""
    out, unseen = [], links.any(axis=1)
    while unseen.any():
        todo = [int(np.argmax(unseen))]
        unseen[todo] = False
        for at in todo:  # grows on the way
            found = np.flatnonzero(links[at] & unseen)
            unseen[found] = False
            todo += found.tolist()
        joined = names[todo]
        out += [(int(c), int(joined.min())) for c in joined if c != joined.min()]
    return out


def _verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """(class, n_links, other): a class's number of links in a block; and the smallest class (other) that the block's links join it to.

    blocks: band, hash, i, j, own, class, bands, grams. The pairs of a block are not rows.
    """
    schema = "class long, n_links long, other long"
    arrow = arrow_schema(schema)

    def per_block(key: tuple, rows: list) -> list[tuple]:
        if len(rows) < 2:
            return []
        links = block_links(key[0], key[2] != key[3], np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows], threshold)
        names = [r[1] for r in rows]
        return [(c, int(n), None) for c, n in zip(names, links.sum(axis=1), strict=True) if n] + [(c, 0, first) for c, first in _firsts(links, np.array(names, np.int64))]

    def run(batches):
        key, rows, out = None, [], []
        for part in slices(batches):
            for *new, own, name, bands, grams in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (new := tuple(new)) != key:
                    out += per_block(key, rows)
                    key, rows = new, []
                rows.append((own, name, bands, grams))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out := per_block(key, rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    keys = ["band", "hash", "i", "j"]
    return blocks.select(*keys, "own", "class", "bands", "grams").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(class, component) for the classes of edges (a, b): the smallest class reachable.

    Rounds of taking the smallest label around and then the label of the label, each written to the shared folder, until
    no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), f"{name}-edges").toDF("a", "b")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("component")), name)
    while True:
        around = both.join(labels.withColumnsRenamed({"class": "b", "component": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(around.withColumnRenamed("a", "class"), "class").select("class", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        # a group's rows share a component: its label is spread over SPREAD copies, the rows over these
        named = step.select(F.col("component").alias("class")).distinct()
        jump = step.join(named, "class", "left_semi").select(F.col("class").alias("component"), F.col("component").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
        step = step.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(SPREAD)).cast("int"))
        labels = materialize(step.join(jump, ["component", "part"], "left").select("class", F.coalesce("further", "component").alias("component"), "was"), name)
        if labels.filter(F.col("component") != F.col("was")).isEmpty():
            return labels.select("class", "component")
        labels = labels.select("class", "component")


def class_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, key, h1, h2), and their classes: class, h1, h2, n_copies, copy_of, first (the row that stands for
    it), component (the smallest class that verified links lead to) and n_links (verified links to other classes).
    """
    banding = choose_banding(threshold, target_recall)
    rows = materialize(class_bands(docs, n, banding).withColumn("row", F.monotonically_increasing_id()), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    # a class is named by the number of one of its rows, which the written table keeps
    classes = materialize(rows.groupBy("h1", "h2").agg(F.min("row").alias("class"), F.count("*").alias("n_copies"), F.min("doc_id").alias("copy_of"), first, F.first("bands").alias("bands")), "classes")
    signed = classes.filter(F.size("bands") > 0).select("class", "bands")
    met = signed.select("class", F.posexplode("bands").alias("band", "hash"))
    full = met.groupBy("band", "hash").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).filter("n > 1")
    # of buckets with the same classes the one of the first band is enough
    full = full.groupBy("n", "x", "y").agg(F.min(F.struct("band", "hash")).alias("first")).select("first.band", "first.hash", "n")
    buckets = materialize(met.join(full, ["band", "hash"]), "buckets")
    sets = _gram_sets(docs, classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "h1", "h2", "first.doc_id", "first.key"), n)
    # a class is in the blocks of its part of the bucket with every part, so that every pair of a bucket is in one block
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = buckets.withColumn("own", F.pmod(F.xxhash64("class", F.lit(2)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class")
    found = materialize(_verify(blocks.join(sets.join(signed, "class"), "class"), threshold), "links")
    degree = found.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    # a class's many firsts are joined to the least of them, and the class to that one only: the same components
    joined = found.filter("other is not null").select("class", "other").distinct()
    least = joined.groupBy("class").agg(F.min("other").alias("a"), F.collect_set("other").alias("others")).select("a", F.explode(F.array_union(F.array("class"), "others")).alias("b"))
    labels = components(materialize(least.filter("a <> b").distinct(), "joined"))
    known = classes.drop("bands").join(labels, "class", "left").join(degree, "class", "left")
    return rows.select("doc_id", "key", "h1", "h2"), known.withColumn("component", F.coalesce("component", "class")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999) -> DataFrame:
    """One row per document: class_id, the smallest doc_id of its group; its links; its copies; the first of its copies.

    n_links counts the verified links of its word sequence to other word sequences, n_copies the rows with its own.
    """
    rows, classes = class_links(docs, n, threshold, target_recall)
    groups = classes.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    known = classes.join(groups, "component").select("h1", "h2", "class_id", "n_links", "n_copies", "copy_of")
    return rows.join(known, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_copies", "copy_of")


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group: the one of the smallest doc_id (a null comes last; of texts with one doc_id that with
    the smaller hash). Of rows that repeat it one stays."""
    _, classes = class_links(docs, n, threshold)
    first = classes.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_doc"), F.col("first.key").alias("_first"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), _key().alias("_key"))
    kept = rows.join(first, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_first")), "left_semi").dropDuplicates(["_id", "_key"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
