"""Offset-mapped attribution of tokens to sections or fields.

A document is encoded whole, once, each new match of the splitting pattern by a search for its tokens rather than by the
automaton, whose moves few new words share. The tokens' character spans are joined to the sections' spans by merging two
sorted lists of intervals, and a token that crosses a boundary is allocated by an explicit rule: 'majority' (most characters;
ties to the earlier section), 'first' or 'last' (the section of its first or last character). A token that is part of
a character covers that character.

Cases: null text is the empty text, which has one empty section without a token. Sections tile the text, so that the
counts of a document's sections add up to its tokens. Repeated rows are counted each on their own.
Very long texts are encoded in bounded runs. Fields that are null are empty; fields are named by the caller, and other
columns, whatever their names, are left behind. Empty tables give no row.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.bpe_transducer import Codec, Memo, load_codec
from trackmesh.llm.common import doc_texts, map_rows

SCHEMA = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing_in long, n_crossing_out long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
RULES = ("majority", "first", "last")


class OffsetEncoder:
    """Character spans of a text's tokens."""

    def __init__(self, codec: Codec) -> None:
        self._codec = codec
        self._lengths = [*map(len, codec.transducer.tokens)]
        self._memo = Memo(self._spans)

    def _spans(self, match: str) -> bytes:
        """Start and end of each token in turn, from the match's start, packed; the first start is -1, to mark it."""
        data = match.encode("utf-8", "surrogatepass")
        ends = [*accumulate(map(self._lengths.__getitem__, self._codec.transducer.search(data)))]
        starts = [0, *ends[:-1]]
        if len(data) > len(match):  # from bytes to the characters that hold them
            begun = [*accumulate((b & 0xC0) != 0x80 for b in data)]
            starts, ends = [begun[s] - 1 for s in starts], [begun[e - 1] for e in ends]
        starts[0] = -1
        return array("i", chain.from_iterable(zip(starts, ends, strict=True))).tobytes()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        for run in self._codec.matches(text):
            found = np.frombuffer(b"".join(map(self._memo.__getitem__, run)), "<i4").reshape(-1, 2)
            if not len(found):
                continue
            first = np.flatnonzero(found[:, 0] < 0)
            n = np.diff(first, append=len(found))
            lengths = found[first + n - 1, 1]  # a match ends where its last token does
            at = np.cumsum(lengths, dtype=np.int64) - lengths + base
            shift = np.repeat(at, n)
            start = found[:, 0] + shift
            start[first] = at
            starts.append(start)
            ends.append(found[:, 1] + shift)
            base = int(at[-1] + lengths[-1])
        return (starts[1], ends[1]) if len(starts) == 2 else (np.concatenate(starts), np.concatenate(ends))


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line ends after its newline."""
    starts = np.cumsum([0, *(len(line) + 1 for line in text.split("\n")[:-1])])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section; how many of them cross a boundary; how many others reach into it.

    Both lists of intervals are sorted, so each boundary is looked up among the tokens, and only tokens across it are
    looked at one by one (at most one crosses a boundary).
    """
    bounds = np.append(sections, length)
    upto = np.searchsorted(starts, bounds, "left")  # tokens that start before each boundary
    upto[-1] = len(starts)
    n = np.diff(upto)
    own, other = np.zeros(len(sections), np.int64), np.zeros(len(sections), np.int64)
    before = upto[1:-1] - 1
    over = before[(before >= 0) & (ends[before] > bounds[1:-1])] if len(before) else before
    for t in np.unique(over).tolist():
        first = int(np.searchsorted(sections, starts[t], "right")) - 1
        last = int(np.searchsorted(sections, ends[t] - 1, "right")) - 1
        around = np.arange(first, last + 1)
        owner = first
        if rule == "majority":
            share = np.minimum(bounds[around + 1], ends[t]) - np.maximum(bounds[around], starts[t])
            owner = int(around[np.argmax(share)])
        elif rule == "last":
            owner = last
        n[first] -= 1
        n[owner] += 1
        other[around] += 1
        other[owner] -= 1
        own[owner] += 1
    return n, own, other


_encoders: dict[tuple[str, str], OffsetEncoder] = {}


def _encoder(path: str, pattern: str) -> OffsetEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = OffsetEncoder(load_codec(path, pattern))
    return _encoders[path, pattern]


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "majority", sections: Callable[[str], np.ndarray] = line_sections) -> DataFrame:
    """One row per section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def per_slice(batch: pa.RecordBatch) -> dict:
        encoder, rows = _encoder(path, pattern), []
        for text in batch.column(1).to_pylist():
            at = sections(text)
            rows.append((np.arange(len(at)), at, np.append(at[1:], len(text)), *attribute(*encoder.spans(text), at, len(text), rule)))
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        return dict(zip(_NAMES, [batch.column(0).take(pa.array(of)), *map(np.concatenate, zip(*rows, strict=True))], strict=True))

    return map_rows(doc_texts(docs), per_slice, SCHEMA)


def field_tokens(rows: DataFrame, key: str, fields: Sequence[str], path: str, pattern: str, separator: str = "\n", rule: str = "majority") -> DataFrame:
    """Tokens of each of several text columns that are encoded as one document; null fields are empty.

    A field's section includes the separator after it.
    """
    joined = rows.select(F.col(key).cast("long").alias("doc_id"), *[F.coalesce(F.col(f), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def per_slice(batch: pa.RecordBatch) -> dict:
        encoder, out = _encoder(path, pattern), {"doc_id": [], "field": [], "n_tokens": [], "n_crossing": []}
        for doc_id, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = separator.join(parts)
            at = np.cumsum([0, *(len(p) + len(separator) for p in parts[:-1])])
            n, own, _ = attribute(*encoder.spans(text), at, len(text), rule)
            out["doc_id"] += [doc_id] * len(parts)
            out["field"] += fields
            out["n_tokens"] += n.tolist()
            out["n_crossing"] += own.tolist()
        return out

    return map_rows(joined, per_slice, "doc_id long, field string, n_tokens long, n_crossing long")
