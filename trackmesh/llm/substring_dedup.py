"""Substring dedup: remove every word covered by a window of words whose sequence also starts earlier.

1. Confirm. Of each window of `window` words, the `phrase`-word gram with the least hash is its anchor (equal windows have
   equal anchors). A hash of id and text puts each row into a unit of bounded size. A task sends the words of each of its
   anchors once to the phrase's shard, with the units they stand in; the shard confirms, on the words themselves, what
   stands in two places.
2. Automata. Each unit gets its confirmed phrases, and nothing of where they stand. They are compiled into Aho-Corasick
   automata of bounded size, and all documents of the unit are streamed through each of them: a place comes from a hit
   alone. Automata are so sharded by the units that hold their phrases: the work over all grows with the text, not with
   text times phrases.
3. First places. Windows around located anchors are settled within the task, then per shard, by a 128-bit hash of their
   words. A window that starts earlier elsewhere covers its words.

A hot passage sends a shard its words once a task, and a number a unit, however many documents hold it. Windows are
judged on the input.

Cases: null or empty text has no word, and null stays null. A text shorter than a window is kept. Very long texts are
streamed whole; a unit is as large as its largest text at least. Rows that repeat both doc_id and text are at
the same place (doc_id, start), so neither makes the other go; of a tie between rows of one doc_id and different texts
neither is earlier. A null doc_id comes first. Other columns, whatever their names, play no part. Empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackmesh.llm.common import arrow_schema, gram_hashes, input_bytes, map_rows, slices, text_words

#: Input bytes (as stored) a shard of phrases, a shard of windows and a unit; text bytes that a task sends at once; characters of phrases in one automaton; entries that a task settles at once.
SHARD_BYTES, WINDOW_BYTES, UNIT_BYTES, SENT_BYTES, AUTOMATON_CHARS, ENTRIES = 4 << 20, 24 << 20, 1 << 20, 4 << 20, 1 << 20, 900_000
LEAST_SHARDS = 64
_FIRST = -(1 << 63)
_PHRASES = "shard int, phrases binary, twice binary, n_units binary, units binary"
_WINDOWS = "shard int, doc_id long, uid long, places binary, keys binary, checks binary, docs binary, uids binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def anchors(words: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes, and each window's anchor: the place of the least of its phrases' hashes, the first of equals."""
    grams = gram_hashes(words, phrase)
    span = window - phrase + 1
    if len(grams) < span:
        return grams, np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(grams, span)
    return grams, rows.argmin(axis=1) + np.arange(len(rows))


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _text(packed: bytes | None) -> str:
    return _unpacked(packed).decode("utf-8", "surrogatepass")


# --- 1. units of documents, and the phrases that recur ------------------------------------------------------


class Phrases:
    """The anchor phrases of some documents, and the units they stand in."""

    def __init__(self, shards: int) -> None:
        self.shards, self.size = shards, 0
        self._index: dict[bytes, int] = {}
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, unit: int, text: str, window: int, phrase: int) -> None:
        data, starts, ends, words = text_words(text)
        self.size += len(data)
        grams, at = anchors(words, window, phrase)
        if not len(at):
            return
        at = np.unique(at)
        joined = b" ".join(data.tobytes().split())
        place = np.concatenate(([0], np.cumsum(ends - starts + 1)))
        index, number = self._index, self._index.setdefault
        ids = [number(joined[a:b], len(index)) for a, b in zip(place[at].tolist(), (place[at + phrase] - 1).tolist(), strict=True)]
        self._parts.append((np.array(ids, np.int64), np.full(len(at), unit, np.int64), (grams[at] % np.uint64(self.shards)).astype(np.int64)))

    def flush(self) -> pa.RecordBatch:
        """For each shard its phrases, which of them stand in two places here, and their units."""
        rows: list[tuple] = []
        if self._parts:
            ids, units, shards = (np.concatenate(c) for c in zip(*self._parts, strict=True))
            pair = np.unique((ids << 32) | units)
            of, units = pair >> 32, (pair & 0xFFFFFFFF).astype("<u4")
            twice, n_units, shard = np.bincount(ids) > 1, np.bincount(of), np.zeros(len(self._index), np.int64)
            shard[ids] = shards
            first = np.cumsum(n_units) - n_units
            order = np.argsort(shard, kind="stable")
            words = list(self._index)
            for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                at = np.repeat(first[some] - np.concatenate(([0], np.cumsum(n_units[some])[:-1])), n_units[some]) + np.arange(n_units[some].sum())
                rows.append((int(shard[some[0]]), _packed(b"\n".join([words[i] for i in some.tolist()])), twice[some].tobytes(), n_units[some].astype("<u4").tobytes(), units[at].tobytes()))
        self.size, self._index, self._parts = 0, {}, []
        return _record_batch(rows, _PHRASES)


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)


def _send_phrases(shards: int, window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shards)
        for part in slices(batches):
            for unit, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                phrases.add(unit, text, window, phrase)
                if phrases.size >= SENT_BYTES:
                    yield phrases.flush()
        yield phrases.flush()

    return run


def _confirm(table: pa.Table) -> pa.Table:
    """Of a shard's phrases those that stand in two places, for each unit that holds them."""
    sent, times = [], Counter()
    for body, twice in zip(table.column("phrases").to_pylist(), table.column("twice").to_pylist(), strict=True):
        sent.append(_unpacked(body).split(b"\n"))
        times.update(sent[-1])
        times.update(p for p, more in zip(sent[-1], twice, strict=True) if more)
    words, units = [], []
    for some, n_units, of in zip(sent, table.column("n_units").to_pylist(), table.column("units").to_pylist(), strict=True):
        kept = np.fromiter((times[p] > 1 for p in some), bool, len(some))
        n = np.frombuffer(n_units, "<u4")
        units.append(np.frombuffer(of, "<u4")[np.repeat(kept, n)])
        words += [p for p, k, m in zip(some, kept.tolist(), n.tolist(), strict=True) if k for _ in range(m)]
    unit = np.concatenate([*units, np.zeros(0, np.uint32)]).astype(np.int64)
    order = np.argsort(unit, kind="stable")
    groups = [g for g in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1) if len(g)]
    return pa.table({"unit": pa.array([int(unit[g[0]]) for g in groups], pa.int64()), "body": pa.array([_packed(b"\n".join({words[i]: None for i in g.tolist()})) for g in groups], pa.binary())})


# --- 2. automata --------------------------------------------------------------------------------------------


def compile_automata(phrases: list[str]) -> list[ahocorasick.Automaton]:
    """Automata of all the phrases, each of at most about AUTOMATON_CHARS."""
    out, room = [], 0
    for p in phrases:
        if room <= 0:
            out.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH))
            room = AUTOMATON_CHARS
        out[-1].add_word(f" {p} ")
        room -= len(p)
    for automaton in out:
        automaton.make_automaton()
    return out


def locate(automata: list[ahocorasick.Automaton], text: str, phrase: int) -> np.ndarray:
    """The word places of all phrases in a text whose words are joined by one space."""
    spaced = f" {text} "
    hits = np.fromiter((end for a in automata for end, _ in a.iter(spaced)), np.int64)
    if not len(hits):
        return hits
    sizes = np.fromiter(map(len, text.split(" ")), np.int64)
    return np.searchsorted(np.cumsum(sizes + 1), hits) - (phrase - 1)  # a hit ends at the space after its last word


# --- 3. first places ----------------------------------------------------------------------------------------


class Settler:
    """Gathers windows (key, check, doc_id, uid, place): those later than the task's first one go out by row, firsts by shard."""

    def __init__(self, shards: int) -> None:
        self.shards, self.size, self._parts = shards, 0, []

    def add(self, keys: np.ndarray, checks: np.ndarray, doc_id: int, uid: int, places: np.ndarray) -> None:
        if len(keys):
            n = len(keys)
            self._parts.append((keys, checks, np.full(n, doc_id, np.int64), np.full(n, uid, np.int64), places.astype(np.int32)))
            self.size += n

    def flush(self) -> pa.RecordBatch:
        rows: list[tuple] = []
        if self._parts:
            keys, checks, docs, uids, places = (np.concatenate(c) for c in zip(*self._parts, strict=True))
            self._parts, self.size = [], 0
            order, lead, later = _settled(keys, checks, docs, places)
            keys, checks, docs, uids, places = (x[order] for x in (keys, checks, docs, uids, places))
            # what is settled passes through any shard
            rows += [((doc_id ^ uid) % self.shards, doc_id, uid, block, None, None, None, None) for doc_id, uid, block in _by_row(docs[later], uids[later], places[later])]
            shard = (keys[lead] % np.uint64(self.shards)).astype(np.int64)
            by_shard = np.lexsort((places[lead], docs[lead], shard))  # documents in runs, which compress
            for some in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
                k = lead[some]
                rows.append((int(shard[some[0]]), None, None, places[k].tobytes(), keys[k].tobytes(), checks[k].tobytes(), docs[k].tobytes(), uids[k].tobytes()))
        return _record_batch(rows, _WINDOWS)


def _settled(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, check, doc_id and place; in it, the first of each key; and which are strictly later than that."""
    order = np.lexsort((places, docs, checks, keys))
    if not len(order):
        return order, order, np.zeros(0, bool)
    k, c, d, p = (x[order] for x in (keys, checks, docs, places))
    lead = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    at = np.repeat(lead, np.diff(np.concatenate((lead, [len(k)]))))
    return order, lead, (d != d[at]) | (p != p[at])


def _by_row(docs: np.ndarray, uids: np.ndarray, places: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((places, uids, docs))
    docs, uids, places = docs[order], uids[order], places[order].astype("<i4")
    cuts = np.flatnonzero((np.diff(docs) != 0) | (np.diff(uids) != 0)) + 1
    return [(int(d[0]), int(u[0]), p.tobytes()) for d, u, p in zip(*(np.split(x, cuts) for x in (docs, uids, places)), strict=True) if len(d)]


def _settle_shard(table: pa.Table) -> pa.Table:
    is_settled = table.column("uid").is_valid()
    done, table = table.filter(is_settled).select(["doc_id", "uid", "places"]), table.filter(pc.invert(is_settled))
    unpack = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    keys, checks, docs, uids, places = (unpack(*x) for x in (("keys", "<u8"), ("checks", "<u8"), ("docs", "<i8"), ("uids", "<i8"), ("places", "<i4")))
    order, _, later = _settled(keys, checks, docs, places)
    rows = _by_row(docs[order][later], uids[order][later], places[order][later])
    late = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "uid": pa.array([r[1] for r in rows], pa.int64()), "places": pa.array([r[2] for r in rows], pa.binary())})
    return pa.concat_tables([done.cast(late.schema), late])


def _windows(shards: int, window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler, unit, phrases, automata = Settler(shards), None, [], None
        for part in slices(batches):
            for at, is_doc, doc_id, uid, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if at != unit:
                    unit, phrases, automata = at, [], None
                if not is_doc:  # the phrases of a unit come before its documents
                    phrases += _text(body).split("\n")
                    continue
                if automata is None:
                    automata, phrases = compile_automata(phrases), []
                text = b" ".join(_unpacked(body).split()).decode("utf-8", "surrogatepass") if automata else ""
                located = locate(automata, text, phrase)
                if not len(located):
                    continue
                words = text_words(text)[3]
                is_phrase = np.zeros(len(words), bool)
                is_phrase[located] = True
                starts = np.flatnonzero(is_phrase[anchors(words, window, phrase)[1]])
                settler.add(gram_hashes(words, window)[starts], gram_hashes(words, window, 0x51ED270B)[starts], doc_id, uid, starts)
                if settler.size >= ENTRIES:
                    yield settler.flush()
        yield settler.flush()

    return run


def _uid(docs: DataFrame) -> tuple[Column, Column]:
    """A row's names: its doc_id, a null before all others, and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid")


def _packed_text(rows: DataFrame, once: bool = False) -> DataFrame:
    """rows with the text (the last column) compressed, as a binary body, which halves what joins shuffle.

    once: a task sends rows that agree in all columns (but the text, which uid names) one time.
    """
    schema = StructType([f for f in rows.schema if f.name != "text"]).add("body", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for part in slices(batches):
            if once:
                names = list(zip(*(c.to_pylist() for c in part.columns[:-1]), strict=True))
                new = [i for i, name in enumerate(names) if not (name in seen or seen.add(name))]
                part = part if len(new) == len(names) else part.take(pa.array(new, pa.int64()))
            bodies = [None if t is None else _packed(t.encode("utf-8", "surrogatepass")) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns[:-1], arrow, strict=False)), pa.array(bodies, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)


def repeated_starts(docs: DataFrame, window: int = 20, phrase: int = 6) -> DataFrame:
    """(doc_id, uid, places): starts of the windows of each row whose words also start earlier."""
    size = input_bytes(docs)
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    uid = _uid(docs)
    # copies of a text are spread over units by their ids
    texts = docs.select(*uid, F.coalesce("text", F.lit("")).alias("text")).withColumn("unit", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(max(LEAST_SHARDS, -(-size // UNIT_BYTES)))))
    phrases = texts.select("unit", "text").mapInArrow(_send_phrases(shards, window, phrase), _PHRASES).groupBy("shard").applyInArrow(_confirm, "unit long, body binary")
    held = _packed_text(texts.select("unit", F.lit(True).alias("is_doc"), "doc_id", "uid", "text"), once=True)
    none = F.lit(None).cast("long")
    streamed = held.unionByName(phrases.select("unit", F.lit(False).alias("is_doc"), none.alias("doc_id"), none.alias("uid"), "body"))
    streamed = streamed.repartition("unit").sortWithinPartitions("unit", "is_doc")
    late = streamed.mapInArrow(_windows(max(LEAST_SHARDS, -(-size // WINDOW_BYTES)), window, phrase), _WINDOWS).groupBy("shard").applyInArrow(_settle_shard, "doc_id long, uid long, places binary")
    return late.groupBy("doc_id", "uid").agg(F.collect_list("places").alias("places"))


def with_repeats(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """docs as (row of the other columns, packed text as body) with the starts of windows found earlier elsewhere."""
    others = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = _packed_text(docs.select(others, *_uid(docs), "text"))
    return rows.join(repeated_starts(docs, window, phrase), ["doc_id", "uid"], "left").select("row", "body", "places")


def covered(n_words: int, places: list[bytes], window: int) -> np.ndarray:
    """Which words the windows at these starts cover."""
    starts = np.frombuffer(b"".join(places), "<i4")
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def dedup_digest(docs: DataFrame, window: int = 20, phrase: int = 6) -> DataFrame:
    """Words, removed words, and a digest of the kept ones, for each row."""

    def digest(packed: bytes | None, places: list[bytes] | None) -> tuple[int, int, str]:
        words = _unpacked(packed).split()
        if not places:
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        gone = covered(len(words), places, window).tolist()
        return len(words), sum(gone), hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest()

    def per_slice(batch: pa.RecordBatch) -> dict:
        cols = list(zip(*(digest(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)), strict=True))
        return {"doc_id": batch.column(0), "n_words": cols[0], "n_removed": cols[1], "kept_sha256": cols[2]}

    rows = with_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, phrase)
    return map_rows(rows.select("row.doc_id", "body", "places"), per_slice, DIGEST)


def drop_repeats(docs: DataFrame, window: int = 20, phrase: int = 6) -> DataFrame:
    """The documents without the covered words; the white space after each goes with it, all else stays as it is.

    A document of which nothing is left keeps its row, with an empty text; a null text stays null.
    """

    def cut(packed: bytes | None, places: list[bytes] | None) -> str | None:
        if packed is None or not places:
            return None if packed is None else _text(packed)
        data, starts, _, _ = text_words(_text(packed))
        gone = covered(len(starts), places, window)
        raw, after = data.tobytes(), np.concatenate((starts[1:], [len(data)]))
        lead = raw[: starts[0]] if not gone[0] else b""
        return (lead + b"".join(raw[a:b] for a, b in zip(starts[~gone].tolist(), after[~gone].tolist(), strict=True))).decode("utf-8", "surrogatepass")

    rows = with_repeats(docs, window, phrase)
    schema = StructType([rows.schema["row"]]).add("text", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [cut(*r) for r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(texts, pa.string())], schema=arrow)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
