"""Identity: vector search, galleries, the resolver, calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.functions import scalars as s
from trackmesh.operators import ranks
from trackmesh.session import ship


@dataclass(frozen=True)
class ResolveConfig:
    accept: float = 0.8
    reject: float = 0.3
    negative: float = 0.75
    strict_unknown: bool = False


#: Vectors of a block: a pair of blocks is one matrix product.
BLOCK = 512
_BLOCKS = "dims int, ids binary, groups binary, labels binary, vectors binary"


def vector_blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, group, label, vector: longs and an array) packed into blocks of unit vectors of one length.

    Vectors that are null, empty, not finite or of norm zero have no cosine and are left out. A block never outgrows BLOCK
    rows, and the norm of a vector is taken once.
    """
    packed = rows.select("id", "group", "label", F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dims: int, rows: list[tuple]) -> pa.RecordBatch:
            longs = [np.concatenate([r[i] for r in rows]) for i in range(3)]
            parts = [(dims, *(x[a : a + BLOCK].tobytes() for x in (*longs, np.concatenate([r[3] for r in rows])))) for a in range(0, len(longs[0]), BLOCK)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[i] for p in parts], pa.binary()) for i in range(1, 5))], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            vectors = batch.column(3)
            sizes = np.where(np.asarray(vectors.is_valid()), np.diff(vectors.offsets.to_numpy()), 0)
            firsts, values = vectors.offsets.to_numpy()[:-1], np.asarray(vectors.values.to_numpy(zero_copy_only=False), float)
            longs = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]]
            for dims in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == dims)
                matrix = values[firsts[own][:, None] + np.arange(dims)]
                norm = np.sqrt((matrix * matrix).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                held.setdefault(dims, []).append((*(x[own[good]] for x in longs), matrix[good] / norm[good, None]))
                if sum(len(r[0]) for r in held[dims]) >= BLOCK:
                    yield out(dims, held.pop(dims))
        for dims, rows in held.items():
            yield out(dims, rows)

    return packed.mapInArrow(run, _BLOCKS)


def _block_pairs(store: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of the store with every block of the stated query set: work is their product, memory that of a pair."""
    ship(store.sparkSession)
    asked = vector_blocks(queries).select(*[F.col(c.split()[0]).alias("q_" + c.split()[0]) for c in _BLOCKS.split(", ")])
    return vector_blocks(store).crossJoin(asked).filter("dims = q_dims")


def _unpacked(row: tuple) -> tuple[np.ndarray, ...]:
    dims, ids, groups, labels, vectors = row
    return (*(np.frombuffer(x, np.int64) for x in (ids, groups, labels)), np.frombuffer(vectors, float).reshape(-1, dims))


HITS = "query_id long, embedding_ref long, score double, near boolean"


class Best:
    """The k best (score, then lower id) of each query of a block, over the blocks of the store that it has met."""

    def __init__(self, asked: np.ndarray, k: int) -> None:
        self.asked, self.k = asked, k
        self.x, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(asked), -2.0)  # what a row must reach to count

    def meet(self, q: np.ndarray, ids: np.ndarray, a: np.ndarray, scores: np.ndarray) -> None:
        least = self.floor
        if scores.shape[1] > self.k and (least == -2.0).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        x, y = np.nonzero(scores >= np.maximum(least, -1.5)[:, None] - 1e-9)  # ties of the last place too
        if not len(x):
            return
        # scores are taken again vector by vector, so that they do not hang on the block
        x, ids, scores = np.concatenate((self.x, x)), np.concatenate((self.ids, ids[y])), np.concatenate((self.scores, (q[x] * a[y]).sum(axis=1)))
        order = np.lexsort((ids, -scores, x))
        x, ids, scores = x[order], ids[order], scores[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        own = rank < self.k
        self.x, self.ids, self.scores = x[own], ids[own], scores[own]
        last = rank == self.k - 1
        self.floor[x[last]] = scores[last]

    def rows(self, near: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.asked[self.x]), pa.array(self.ids), pa.array(self.scores), pa.array(np.full(len(self.x), near))], names=["query_id", "embedding_ref", "score", "near"])


def _hits(store: DataFrame, queries: DataFrame, k: int, normals: np.ndarray | None = None) -> DataFrame:
    """(query_id, embedding_ref, score, near): of each task the k best of each query, so that what is shuffled does not grow
    with the pairs; given the normals of tables of planes, also the k best of those near it (see lsh_top_k)."""
    none = F.lit(0).cast("long")
    pairs = _block_pairs(
        store.select(F.col("embedding_ref").alias("id"), none.alias("group"), none.alias("label"), "vector"), queries.select(F.col("query_id").alias("id"), none.alias("group"), none.alias("label"), F.col("query").alias("vector"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[Best, Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a row is two blocks
                row = [c[i].as_py() for c in batch.columns]
                ids, _, _, a = _unpacked(row[:5])
                asked, _, _, q = _unpacked(row[5:])
                exact, near = best.setdefault((row[5], row[6]), (Best(asked, k), Best(asked, k)))
                scores = q @ a.T
                exact.meet(q, ids, a, scores)
                if normals is not None:
                    near.meet(q, ids, a, np.where(_share_a_bucket(q, a, normals), scores, -np.inf))
        for exact, near in best.values():
            yield exact.rows(False)
            if normals is not None:
                yield near.rows(True)

    return pairs.mapInArrow(run, HITS)


def ranked(hits: DataFrame, k: int, *more: str) -> DataFrame:
    w = W.partitionBy("query_id", *more).orderBy(F.desc("score"), "embedding_ref")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest vectors of each query (query_id, query) by cosine, then handle.

    The stated query set meets the store in blocks, at any size by the same plan.
    """
    return ranked(_hits(store, queries, k), k).select("query_id", "embedding_ref", "score", "rank")


def best_by_group(store: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, group, label, score): the best cosine of each query with each group and label of the store (group, label, vector)."""
    none = F.lit(0).cast("long")
    pairs = _block_pairs(store.select(none.alias("id"), "group", "label", "vector"), queries.select(F.col("query_id").alias("id"), none.alias("group"), none.alias("label"), F.col("query").alias("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, groups, labels, a = _unpacked(row[:5])
                asked, _, _, q = _unpacked(row[5:])
                order = np.lexsort((labels, groups))
                groups, labels = groups[order], labels[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(groups) != 0) | (np.diff(labels) != 0))))
                best = np.maximum.reduceat(q @ a[order].T, first, axis=1)
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(np.tile(groups[first], len(asked))), pa.array(np.tile(labels[first], len(asked))), pa.array(best.ravel())], names=["query_id", "group", "label", "score"])

    found = pairs.mapInArrow(run, "query_id long, group long, label long, score double")
    return found.groupBy("query_id", "group", "label").agg(F.max("score").alias("score"))


def _normals(dims: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(planes, dims))


def lsh_signature(vector: Column, dims: int, planes: int, seed: int) -> Column:
    """The sides of fixed random planes, as an integer."""
    normals = _normals(dims, planes, seed)
    bits = [F.when(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) >= 0, F.lit(1 << i)).otherwise(0) for i, row in enumerate(normals)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out.cast("long")


def _share_a_bucket(q: np.ndarray, a: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Whether, in any table, a vector lies in a query's bucket or across one plane of it (tables, planes, dims: normals)."""
    out = np.zeros((len(q), len(a)), bool)
    for planes in normals:
        weights = 1 << np.arange(len(planes))
        kind = np.uint8 if len(planes) <= 8 else np.uint64
        x, y = (((v @ planes.T >= 0) * weights).sum(axis=1).astype(kind) for v in (q, a))
        apart = x[:, None] ^ y[None, :]
        out |= apart & (apart - kind(1)) == 0  # one bit at most
    return out


def lsh_top_k(store: DataFrame, queries: DataFrame, k: int, dims: int, planes: int = 6, tables: int = 12) -> DataFrame:
    """Approximate search: a query meets the vectors that lie, in any table, in its bucket or across one plane of it.

    A query with fewer than k hits is searched exactly. Blocks meet as in the exact search, since so few planes leave most
    pairs in some common bucket: a join on buckets would make every such pair a row, several times over.
    """
    normals = np.stack([_normals(dims, planes, 1000 + t) for t in range(tables)])
    fits = lambda df, c: df.filter(F.size(c) == dims)
    found = ranked(_hits(fits(store, "vector"), fits(queries, "query"), k, normals), k, "near")
    enough = F.count_if("near").over(W.partitionBy("query_id")) >= k
    return found.withColumn("_enough", enough).filter(F.col("near") == F.col("_enough")).select("query_id", "embedding_ref", "score", "rank")


def mean_pool(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The element-wise mean of each group's vectors; partial sums are made before the shuffle."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(*keys, F.col("v.x").alias("pooled"))


def labeled_scores(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, genuine) with the cosine of their vectors."""
    a, b = store.select(F.col("embedding_ref").alias("a"), F.col("vector").alias("va")), store.select(F.col("embedding_ref").alias("b"), F.col("vector").alias("vb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "genuine", s.cosine(F.col("va"), F.col("vb")).alias("score"))


def roc(scores: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr, fnr) at each distinct score, by running sums from the top."""
    per = scores.groupBy("score").agg(F.count_if("genuine").alias("p"), F.count_if(~F.col("genuine")).alias("n"))
    total = scores.agg(F.count_if("genuine").alias("all_p"), F.count_if(~F.col("genuine")).alias("all_n"))
    rows = ranks.running(per.withColumnsRenamed({"p": "own_p", "n": "own_n"}), "score", [], {"p": "own_p", "n": "own_n"}, descending=True).crossJoin(F.broadcast(total))
    tpr, fpr = F.try_divide("p", "all_p"), F.try_divide("n", "all_n")
    return rows.select(F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (1 - tpr).alias("fnr"))


def equal_error(curve: DataFrame) -> DataFrame:
    """Where false accepts and rejects come closest; of equals the highest threshold."""
    best = curve.agg(F.min(F.struct(F.abs(F.col("fpr") - F.col("fnr")).alias("gap"), (-F.col("threshold")).alias("neg"), ((F.col("fpr") + F.col("fnr")) / 2).alias("eer"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.col("b.eer").alias("eer"))


def resolve(fragments: DataFrame, references: DataFrame, config: ResolveConfig = ResolveConfig(), candidates: DataFrame | None = None) -> DataFrame:
    """Fragments (fragment_id, query, topology) against references (subject_id, vector, is_positive): one row per pair
    of fragment and subject with the best similarity, the fused score, a decision, and a rank.

    Gates come first, then negatives, then a raw accept, then fused thresholds. Unlabelled references count only for
    subjects without a positive one. A stated set of fragments meets every reference in blocks; for
    many, give ``candidates`` (fragment_id, subject_id), such as those of `lsh_candidates`: joins on keys then do it.
    """
    label = F.when(F.col("is_positive"), 1).when(F.col("is_positive").isNull(), 0).otherwise(-1).cast("long").alias("label")
    if candidates is None:
        known = references.filter("subject_id is not null").select(F.col("subject_id").cast("long").alias("group"), label, "vector")
        best = best_by_group(known, fragments.select(F.col("fragment_id").alias("query_id"), "query"))
        scored = best.select(F.col("query_id").alias("fragment_id"), F.col("group").alias("subject_id"), "label", F.col("score").alias("c"))
    else:
        near = fragments.join(candidates.select("fragment_id", "subject_id").distinct(), "fragment_id").join(references.select("subject_id", "vector", label), "subject_id")
        scored = near.select("fragment_id", "subject_id", "label", s.cosine(F.col("query"), F.col("vector")).alias("c")).filter("c is not null")
    best = lambda n: F.max(F.when(F.col("label") == n, F.col("c")))
    per = scored.groupBy("fragment_id", "subject_id").agg(best(1).alias("pos"), best(0).alias("unl"), best(-1).alias("neg"))
    per = per.join(fragments.select("fragment_id", "topology"), "fragment_id")
    sim = F.coalesce("pos", "unl")
    per = per.withColumn("similarity", sim).filter("similarity is not null").withColumn("score", s.fused_identity(F.col("similarity"), F.col("topology")))
    decision = (
        F.when(F.col("topology") <= 0, "reject").when(F.coalesce(F.col("neg") >= config.negative, F.lit(False)) & (F.col("neg") >= F.col("similarity")), "reject")
        .when((F.col("similarity") >= config.accept) & (F.col("topology") >= 0.999), "accept").when(F.col("score") >= config.accept, "accept").when(F.col("score") <= config.reject, "reject").otherwise("uncertain")
    )
    rank = F.row_number().over(W.partitionBy("fragment_id").orderBy(F.desc("score"), "subject_id"))
    return per.withColumns({"decision": decision, "rank": rank}).select("fragment_id", "subject_id", "similarity", "score", "decision", "rank")


def lsh_candidates(fragments: DataFrame, references: DataFrame, dims: int, planes: int = 6, tables: int = 8) -> DataFrame:
    """(fragment_id, subject_id) that share a signature of random planes in some table: an equi-join on (table, signature).

    Signatures of a subject are made distinct before the join, so a subject of many references in a bucket is one row.
    """

    def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("table"), lsh_signature(F.col(vector), dims, planes, i).alias("signature")) for i in range(tables)])
        return df.select(key, F.explode(keys).alias("k")).select(key, "k.*").distinct()

    near = keyed(fragments, "fragment_id", "query").join(keyed(references.filter("subject_id is not null"), "subject_id", "vector"), ["table", "signature"])
    return near.select("fragment_id", "subject_id").distinct()


def assigned(audit: DataFrame) -> DataFrame:
    """The latest subject that each track was given."""
    return audit.filter("assigned_subject is not null").groupBy("source_id", "track_id").agg(F.max_by("assigned_subject", "audit_id").alias("subject_id"))


def open_cases(audit: DataFrame) -> DataFrame:
    """Cases without a manual answer whose best match is uncertain or that have several hypotheses."""
    return audit.filter(F.col("manual").isNull() & ((F.col("decision") == "uncertain") | (F.col("n_hypotheses") > 1)))


def evict(references: DataFrame, most: int) -> DataFrame:
    """The latest `most` references of each subject."""
    w = W.partitionBy("subject_id").orderBy(F.desc("embedding_ref"))
    return references.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def merge_subjects(references: DataFrame, keep: int, gone: int) -> DataFrame:
    return references.withColumn("subject_id", F.when(F.col("subject_id") == gone, F.lit(keep).cast("long")).otherwise(F.col("subject_id")))


def split_subject(references: DataFrame, subject: int, refs: list[int], new: int) -> DataFrame:
    return references.withColumn("subject_id", F.when((F.col("subject_id") == subject) & F.col("embedding_ref").isin(refs), F.lit(new).cast("long")).otherwise(F.col("subject_id")))


def last_seen(samples: DataFrame) -> DataFrame:
    """As-of: for each sample of a subject, the source and time of the one before it."""
    w = W.partitionBy("subject_id").orderBy("pts_ns", "sample_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.max_by(F.struct("source_id", "pts_ns"), F.struct("pts_ns", "sample_id")).over(w)
    return samples.filter("subject_id is not null").withColumn("_b", before).select("sample_id", "subject_id", "source_id", "pts_ns", F.col("_b.source_id").alias("last_source"), F.col("_b.pts_ns").alias("last_ns"))


# --- audit of decisions -----------------------------------------------------------------------------------------------------


def audit(matches: DataFrame, fragments: DataFrame) -> DataFrame:
    """A row per fragment (fragment_id, source_id, track_id): its ranked matches, and the best one's subject if accepted."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "subject_id", "score", "decision")))
    per = matches.groupBy("fragment_id").agg(ranked.alias("hypotheses"))
    best = F.try_element_at("hypotheses", F.lit(1))
    rows = fragments.select(F.col("fragment_id").alias("audit_id"), "fragment_id", "source_id", "track_id").join(per, "fragment_id", "left")
    return rows.select(
        "audit_id", "source_id", "track_id", "hypotheses", F.coalesce(F.size("hypotheses"), F.lit(0)).alias("n_hypotheses"), best["decision"].alias("decision"),
        F.when(best["decision"] == "accept", best["subject_id"]).alias("assigned_subject"), F.lit(None).cast("boolean").alias("manual"),
    )


def answer(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """The audit after manual answers (audit_id, subject_id; null dismisses the case), the only ones of their ids."""
    given = answers.select("audit_id", F.col("subject_id").alias("_given"), F.lit(True).alias("_answered"))
    rows = cases.join(given, "audit_id", "left")
    asked = F.coalesce(F.col("_answered"), F.lit(False))
    return rows.withColumns({
        "manual": F.when(asked, F.col("_given").isNotNull()).otherwise(F.col("manual")),
        "assigned_subject": F.when(asked, F.col("_given")).otherwise(F.col("assigned_subject")),
    }).drop("_given", "_answered")


def accept_hypotheses(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """As `answer`, where each subject must be among its case's hypotheses; another one is an error."""
    known = cases.select("audit_id", F.transform("hypotheses", lambda h: h["subject_id"]).alias("_known"))
    checked = answers.join(known, "audit_id", "left")
    fits = F.coalesce(F.array_contains("_known", F.col("subject_id")), F.lit(False))
    subject = F.when(fits, F.col("subject_id")).otherwise(F.raise_error(F.concat(F.lit("no such hypothesis of case "), F.col("audit_id").cast("string"))).cast("long"))
    return answer(cases, checked.select("audit_id", subject.alias("subject_id")))


def calibrated(config: ResolveConfig, accept: float, reject: float) -> ResolveConfig:
    """The configuration with thresholds of a calibration, the higher one to accept."""
    from dataclasses import replace

    return replace(config, accept=max(accept, reject), reject=min(accept, reject))


# --- photos -------------------------------------------------------------------------------------------------------------------


def enrol(references: DataFrame, photos: DataFrame, most: int) -> DataFrame:
    """References with photos (embedding_ref, subject_id, vector) added as positive ones; the latest ``most`` of a subject stay."""
    fresh = photos.select("embedding_ref", "subject_id", "vector", F.lit(True).alias("is_positive"))
    return evict(references.select(*fresh.columns).unionByName(fresh), most)


def photo_search(references: DataFrame, photos: DataFrame, k: int) -> DataFrame:
    """The k subjects nearest to each photo (query_id, vector): best cosine of a positive or unlabelled reference."""
    rows = references.filter("subject_id is not null and coalesce(is_positive, true)").select(F.col("subject_id").cast("long").alias("group"), F.lit(0).cast("long").alias("label"), "vector")
    per = best_by_group(rows, photos.select("query_id", F.col("vector").alias("query"))).select("query_id", F.col("group").alias("subject_id"), "score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "subject_id"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= k)
