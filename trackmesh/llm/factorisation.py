"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of a document's features interacts through low-rank factors. A score is linear in the features: for each
factor, half of (the square of the sum) less (the sum of squares). The machine is trained on the driver, on at most
`most_labels` labelled documents chosen by a hash of their ids, from rows that are not held out; lang, source, doc_id
and labels are no features. Scoring needs one broadcast of fixed size (2**bits rows of 1 + rank floats).

Cases: null text is the empty text and gets a score as any other. Labels without a document, null labels and labels
other than 0 and 1 are not learned from; of several labels of one document, the highest counts. Without usable labels
every score is 0.5. Equal texts get equal scores, repeated rows a score each; a score of just 0.5 predicts 1. Very long
texts are read whole. Words that share a hash are features each on their own. Other columns, whatever their names, play no
part. Empty tables give no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.common import doc_texts, held_out, is_held_out, map_rows, text_words

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>{}[]\\^~=@_", np.uint8)] = True
#: Structure statistics and metadata (size), each a feature of its own: hashed words start after them.
STATS = 14


@dataclass(frozen=True)
class FmConfig:
    bits: int = 16
    rank: int = 8
    most_labels: int = 6000
    epochs: int = 6
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values: statistics, then the words' weights, which have a norm of at most one."""
    data, starts, ends, words = text_words(text)
    n, size = max(len(words), 1), max(len(data), 1)
    lines = np.flatnonzero(data == 10)
    distinct, counts = np.unique(words, return_counts=True)
    three = words[:-2] ^ (words[1:-1] << np.uint64(1)) ^ (words[2:] << np.uint64(2)) if len(words) > 2 else words[:0]
    lower, upper = ((data >= 97) & (data <= 122)).sum(), ((data >= 65) & (data <= 90)).sum()
    first_upper = data[starts] if len(starts) else data[:0]
    last = data[ends - 1] if len(ends) else data[:0]
    stats = np.array(
        [
            np.log1p(len(words)) / 8,
            np.log1p(len(data)) / 10,
            len(distinct) / n,
            1 - len(np.unique(three)) / max(len(three), 1),
            counts.max() / n if len(counts) else 0,
            np.minimum((ends - starts).mean() / 10, 3) if len(words) else 0,
            np.minimum((ends - starts).max() / 50, 3) if len(words) else 0,
            upper / max(lower + upper, 1),
            ((data >= 48) & (data <= 57)).sum() / size * 4,
            _SYMBOLS[data].sum() / size * 4,
            np.isin(last, np.frombuffer(b".!?,;:", np.uint8)).mean() * 2 if len(last) else 0,
            np.isin(last, np.frombuffer(b"!", np.uint8)).mean() * 2 if len(last) else 0,
            ((first_upper >= 65) & (first_upper <= 90)).mean() if len(first_upper) else 0,
            np.log1p(len(lines) + 1) / 6,
        ]
    )
    weights = np.log1p(counts)
    ids = (STATS + distinct % np.uint64((1 << bits) - STATS)).astype(np.int64)
    return np.concatenate((np.arange(STATS), ids)), np.concatenate((stats, weights / max(np.sqrt((weights**2).sum()), 1))).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # (2**bits,)
    factors: np.ndarray  # (2**bits, rank)

    def raw(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of documents whose features start at `at`, and their factor sums, in linear time."""
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat(vx * vx, at, axis=0)
        linear = np.add.reduceat(self.weights[ids] * values, at)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: FmConfig = FmConfig()) -> Machine:
    """Logistic loss, adaptive gradient steps on small batches."""
    rng, dim = np.random.default_rng(config.seed), 1 << config.bits
    machine = Machine(0.0, np.zeros(dim, np.float32), rng.normal(0, 0.05, (dim, config.rank)).astype(np.float32))
    if not len(rows):
        machine.factors[:] = 0
        return machine
    gw, gv, gb = np.full(dim, 1e-6, np.float32), np.full((dim, config.rank), 1e-6, np.float32), 1e-6
    for _ in range(config.epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), config.batch):
            some = order[a : a + config.batch]
            ids, values, at = _stack([rows[i] for i in some])
            raw, sums = machine.raw(ids, values, at)
            error = ((_sigmoid(raw) - labels[some]) / len(some)).astype(np.float32)
            doc = np.repeat(np.arange(len(some)), np.diff(np.append(at, len(ids))))
            touched, place = np.unique(ids, return_inverse=True)
            step = error[doc] * values
            dw = np.bincount(place, step, len(touched)).astype(np.float32) + config.decay * machine.weights[touched]
            dv = np.zeros((len(touched), config.rank), np.float32)
            own = machine.factors[ids]
            np.add.at(dv, place, step[:, None] * (sums[doc] - own * values[:, None]))
            dv += config.decay * machine.factors[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            machine.weights[touched] -= config.rate * dw / np.sqrt(gw[touched])
            machine.factors[touched] -= config.rate * dv / np.sqrt(gv[touched])
            db = float(error.sum())
            gb += db * db
            machine.bias -= config.rate * db / gb**0.5
    return machine


def fit(docs: DataFrame, labels: DataFrame, config: FmConfig = FmConfig()) -> Machine:
    """Train on the documents of up to most_labels rows of labels that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    usable = usable.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    some = usable.orderBy(F.xxhash64("_id"), "_id").limit(config.most_labels)  # at most most_labels rows, so broadcast
    texts = doc_texts(docs).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    bits = config.bits

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [features(t, bits) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "label": batch.column(2), "ids": [i.astype("<i4").tobytes() for i, _ in rows], "values": [v.astype("<f4").tobytes() for _, v in rows]}

    found = map_rows(texts, per_slice, "doc_id long, label int, ids binary, values binary").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    ids, values = (found.column(c).to_pylist() for c in ("ids", "values"))
    rows = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4")) for i, v in zip(ids, values, strict=True)]
    return train(rows, np.array(found.column("label").to_pylist(), np.float32), config)


def score(docs: DataFrame, machine: Machine, bits: int) -> DataFrame:
    """Scores of every document by a trained machine."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def per_slice(batch: pa.RecordBatch) -> dict:
        scores = []
        for text in batch.column(1).to_pylist():  # one at a time: a score does not depend on the slice
            ids, values = features(text, bits)
            scores.append(float(_sigmoid(model.value.raw(ids, values, np.array([0]))[0].astype(np.float64))[0]))
        ids = batch.column(0)
        return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids.to_pylist()], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_rows(doc_texts(docs), per_slice, SCHEMA)


def quality_scores(docs: DataFrame, labels: DataFrame, config: FmConfig = FmConfig()) -> DataFrame:
    return score(docs, fit(docs, labels, config), config.bits)
