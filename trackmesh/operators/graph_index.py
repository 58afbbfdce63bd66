"""A graph index of vectors: blocks of a small-world graph, searched by a beam that walks towards the query.

The store is cut into blocks of bounded size. In a block each vector is linked to its nearest ones, both ways, and to a few
others at random, which keep the graph in one piece. A query walks every block's graph and keeps its best; blocks are
built and searched in parallel, and no graph outgrows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.operators.identity import HITS, Best, ranked, vector_blocks
from trackmesh.session import ship

GRAPH = "dims int, ids binary, vectors binary, links binary, degree int"


def link(vectors: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each unit vector of a block: its nearest, those it is nearest to, and a few at random (-1: none)."""
    n = len(vectors)
    near = min(degree, n - 1)
    if near < 1:
        return np.full((n, 1), -1, np.int32)
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(best.tolist()):
        for j in row:
            if len(back[j]) < degree:
                back[j].append(i)
    others = np.random.default_rng(n).integers(0, n, (n, 4))
    out = np.full((n, near + degree + 4), -1, np.int32)
    out[:, :near], out[:, -4:] = best, others
    for i, some in enumerate(back):
        out[i, near : near + len(some)] = some
    return out


def visited(scores: np.ndarray, links: np.ndarray, beam: int) -> np.ndarray:
    """Which vectors of a block each query comes to (scores: queries by vectors) from a few fixed entries: of those it has
    come to, it goes on from the best ``beam``, all at once, until it has been at each of them."""
    n = scores.shape[1]
    there = links >= 0
    linked = np.zeros((n, n), np.float32)
    linked[np.nonzero(there)[0], links[there]] = 1
    seen, done = np.zeros(scores.shape, bool), np.zeros(scores.shape, bool)
    seen[:, np.linspace(0, n - 1, min(n, 8)).astype(np.int64)] = True
    live = np.arange(len(scores))
    while len(live):
        known = np.where(seen[live], scores[live], -np.inf)
        least = np.partition(known, n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(live), -np.inf)
        front = seen[live] & ~done[live] & (known >= least[:, None])
        on = front.any(axis=1)
        live, front = live[on], front[on]
        done[live] |= front
        seen[live] |= front.astype(np.float32) @ linked > 0
    return seen


def walk(vectors: np.ndarray, links: np.ndarray, query: np.ndarray, k: int, beam: int) -> np.ndarray:
    """Places of the best vectors that a beam search from a few fixed entries comes to."""
    scores = vectors @ query
    kept = np.flatnonzero(visited(scores[None], links, beam)[0])
    return kept[np.lexsort((kept, -scores[kept]))[:k]]


def _plain(rows: DataFrame, key: str, vector: str) -> DataFrame:
    none = F.lit(0).cast("long")
    return rows.select(F.col(key).alias("id"), none.alias("group"), none.alias("label"), F.col(vector).alias("vector"))


def build(store: DataFrame, degree: int = 16) -> DataFrame:
    """The index of a store (embedding_ref, vector): a row for each block."""
    ship(store.sparkSession)
    blocks = vector_blocks(_plain(store, "embedding_ref", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "vectors")), strict=True):
                links = link(np.frombuffer(vectors, float).reshape(-1, dims), degree)
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, vectors, links.tobytes())), pa.array([links.shape[1]], pa.int32())], names=[c.split()[0] for c in GRAPH.split(", ")])

    return blocks.mapInArrow(run, GRAPH)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 64) -> DataFrame:
    """The k nearest rows that walks find for each query (query_id, query): query_id, embedding_ref, score, rank."""
    asked = vector_blocks(_plain(queries, "query_id", "query"))
    pairs = index.crossJoin(asked.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))).filter("dims = q_dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a row is two blocks
                dims, ids, vectors, links, degree, _, q_ids, q_vectors = (c[i].as_py() for c in batch.columns)
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(vectors, float).reshape(-1, dims)
                graph, q = np.frombuffer(links, np.int32).reshape(-1, degree), np.frombuffer(q_vectors, float).reshape(-1, dims)
                scores = q @ v.T
                own = best.setdefault((dims, q_ids), Best(np.frombuffer(q_ids, np.int64), k))
                own.meet(q, ids, v, np.where(visited(scores, graph, max(beam, k)), scores, -np.inf))
        for own in best.values():
            yield own.rows(True)

    return ranked(pairs.mapInArrow(run, HITS), k).drop("near")
