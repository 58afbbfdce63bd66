"""Bounded-space online packing of tokenised documents into sequences of at most max_tokens.

Each partition keeps a fixed number of open windows. A document's full windows go out as they are; its rest is placed
where it fits best. When it fits none, the fullest window is topped up with a cut of it and put out. At a partition's
end its open windows are merged and cut anew, which leaves one short window; the short windows of up to
merge_partitions partitions are then merged, and what is left at last is laid out in sequences whose lengths are powers
of two, which need no padding.

Cases: null or empty text is the end id alone. Repeated rows are packed each on their own. Pieces are exact cuts of a
document's ids; no id is dropped or repeated. A null doc_id stays null. A very long text is tokenised whole and cut into
windows. Of windows that fit equally well, or are equally full, the one opened first is taken. Other columns, whatever
their names, are left behind. Empty tables give no piece.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.bpe_transducer import Memo
from trackmesh.llm.common import arrow_schema, doc_texts, materialize, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WITH_REST = PIECES + ", partition long, rest binary"
_NAMES = [c.split()[0] for c in _WITH_REST.split(", ")]
#: Longer texts are not split into a list of matches at once.
RUN = 1 << 16
_MERGED = 1 << 30
#: Parts of a splitting pattern, and those that only the regex module is left with (of a backslash: all but four classes).
_PART = re.compile(r"\\[pP]\{\w+\}|\\.|\(\?[:!=]|\(\?|\[\^?\]?|[^\\]", re.DOTALL)
_OTHERWISE = ("", "(", "(?", "[]", "[^]", "{")


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of code points under 65,536, for the re module, which is faster: classes are written
    out as the regex module reads them. None if the pattern holds anything that the two might read differently.
    """
    out, at, within, every = [], 0, False, "".join(map(chr, range(1 << 16)))
    while at < len(pattern):
        part = _PART.match(pattern, at)
        piece = part.group() if part else ""
        if piece[:3] in ("\\p{", "\\P{", "\\s", "\\S"):
            members = "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(f"{piece}+", every))
            if not members:
                return None
            piece = members if within else f"[{members}]"
        elif piece in _OTHERWISE or piece[0] == "\\" or within and piece[0] in "[-&|~":
            return None
        elif piece[0] == "[" or piece == "]":
            within = piece != "]"
        out.append(piece)
        at = part.end()
    return re.compile("".join(out))


def _is_narrow(text: str) -> bool:
    try:
        return text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
    except UnicodeEncodeError:
        return False


class TokenizerIds:
    """A text's ids by the tokenizers library: the splitting pattern's matches, each distinct one by its model.

    A text that holds one of the vocabulary's added tokens is left to the library as a whole, which cuts it there.
    """

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._pattern = regex.compile(pattern)
        self._narrow = narrow_pattern(pattern) or self._pattern
        # how a byte-level vocabulary writes bytes: printable Latin-1 as itself, the others from code point 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._written = "".join(chr(others.get(b, b)) for b in range(256))
        self._memo = Memo(self._ids)

    def _ids(self, match: str) -> bytes:
        written = codecs.charmap_decode(match.encode("utf-8", "surrogatepass"), "strict", self._written)[0]
        return array("I", [t.id for t in self._model.tokenize(written)]).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(a in text for a in self._added):
            return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()
        pattern = self._narrow if _is_narrow(text) else self._pattern
        if len(text) <= RUN:
            return b"".join(map(self._memo.__getitem__, pattern.findall(text)))
        return b"".join(self._memo[m.group()] for m in pattern.finditer(text))


_loaded: dict[tuple[str, str], TokenizerIds] = {}


def load_tokenizer(path: str, pattern: str) -> TokenizerIds:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TokenizerIds(path, pattern)
    return _loaded[path, pattern]


class Window:
    """An open sequence: pieces (doc_id, start, doc_tokens, packed ids)."""

    def __init__(self) -> None:
        self.used, self.pieces = 0, []

    def add(self, doc_id, start: int, doc_tokens: int, packed: bytes) -> None:
        self.pieces.append((doc_id, start, doc_tokens, packed))
        self.used += len(packed) // 4


class OnlinePacker:
    """Packs documents as they come; every full window goes to the rows that take() and close() return."""

    def __init__(self, max_tokens: int, open_windows: int, first_sequence: int) -> None:
        self.size, self.limit, self._next = max_tokens, open_windows, first_sequence
        self.open: list[Window] = []

    def _put_out(self, window: Window) -> list[tuple]:
        rows, at, sequence = [], 0, self._next
        self._next += 1
        for doc_id, start, total, packed in window.pieces:
            rows.append((doc_id, start, len(packed) // 4, zlib.crc32(packed), total, sequence, at))
            at += len(packed) // 4
        return rows

    def take(self, doc_id, packed: bytes) -> list[tuple]:
        rows, total, start = [], len(packed) // 4, 0
        while total - start >= self.size:
            whole = Window()
            whole.add(doc_id, start, total, packed[4 * start : 4 * (start + self.size)])
            rows += self._put_out(whole)
            start += self.size
        while start < total:
            rest = total - start
            fitting = [w for w in self.open if self.size - w.used >= rest]
            if fitting:
                window = max(fitting, key=lambda w: w.used)
            elif len(self.open) < self.limit:
                window = Window()
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w.used)
            n = min(rest, self.size - window.used)
            window.add(doc_id, start, total, packed[4 * start : 4 * (start + n)])
            start += n
            if window.used == self.size:
                self.open.remove(window)
                rows += self._put_out(window)
        return rows

    def close(self) -> tuple[list[tuple], list[tuple]]:
        """Full windows of the merged open ones, and the pieces of the short one that is left."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w.used) for p in w.pieces]
        self.open = []
        rows, window = [], Window()
        for doc_id, start, total, packed in pieces:
            while packed:
                n = min(len(packed) // 4, self.size - window.used)
                window.add(doc_id, start, total, packed[: 4 * n])
                start, packed = start + n, packed[4 * n :]
                if window.used == self.size:
                    rows += self._put_out(window)
                    window = Window()
        return rows, window.pieces

    def powers(self, pieces: list[tuple]) -> list[tuple]:
        """A short window in sequences whose lengths are powers of two, the longest first."""
        left, rows = sum(len(p[3]) // 4 for p in pieces), []
        pieces = list(pieces)
        while left:
            room, window = 1 << (left.bit_length() - 1), Window()
            left -= room
            while room:
                doc_id, start, total, packed = pieces.pop(0)
                n = min(room, len(packed) // 4)
                window.add(doc_id, start, total, packed[: 4 * n])
                room -= n
                if 4 * n < len(packed):
                    pieces.insert(0, (doc_id, start + n, total, packed[4 * n :]))
            rows += self._put_out(window)
        return rows


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, max_tokens: int = 2048, open_windows: int = 8, merge_partitions: int = 64) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""
    schema = arrow_schema(_WITH_REST)
    end = np.array([end_id], "<u4").tobytes()

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        packer, ids = OnlinePacker(max_tokens, open_windows, partition << 32), load_tokenizer(tokenizer_path, pattern)
        for part in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows += packer.take(doc_id, ids.packed(text) + end)
            yield _batch([(*r, partition, None) for r in rows], schema)
        rows, left = packer.close()
        yield _batch([(*r, partition, None) for r in rows] + [(d, s, len(p) // 4, None, n, None, None, partition, p) for d, s, n, p in left], schema)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("partition", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        group = table.column("partition")[0].as_py() // merge_partitions
        packer = OnlinePacker(max_tokens, 1, (_MERGED | group) << 32)
        window = Window()
        for doc_id, start, total, rest in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "rest")), strict=True):
            window.add(doc_id, start, total, rest)
        packer.open = [window]
        rows, left = packer.close()
        return pa.Table.from_batches([_batch(rows + packer.powers(left), arrow_schema(PIECES))])

    packed = materialize(doc_texts(docs).mapInArrow(per_partition, _WITH_REST), "packing")
    names = _NAMES[:7]
    rests = packed.filter(F.col("rest").isNotNull()).groupBy(F.floor(F.col("partition") / merge_partitions)).applyInArrow(merge, PIECES)
    return packed.filter(F.col("rest").isNull()).select(*names).unionByName(rests.select(*names))
