"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer over bytes that is determinised as it is used. A sequence of
tokens is the encoding of its bytes exactly if every adjacent pair is (the pair's bytes encode to that pair), so each
prefix has one encoding, and a state need only hold the live hypotheses: the tokens completed since the last output
and a trie node for the token under way. Tokens go out as soon as all hypotheses agree on them; a hypothesis spans at
most the longest token, which bounds the lookahead. Decoding runs an incremental UTF-8 state machine.

Cases: null text is the empty text and gives no token and no byte. Equal rows give equal rows. Very long texts are
read in bounded runs of matches, and each match is linear in its bytes. An encoding has no ties: each text has one. Other
columns, whatever their names, are left behind. Null ids decode to the empty text. Empty tables give no row.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trackmesh.llm.common import doc_texts, map_rows

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"
#: Matches handled at once; bounds the memory for one text.
RUN = 1 << 16
#: Entries of a generation of the memo of whole matches, and transitions of the automaton, which starts anew when full.
MEMO, TRANSITIONS, PAIRS = 300_000, 700_000, 200_000
#: Pairs of tokens that a search keeps, by one integer each.
FITTING = 500_000
_ROOT = 0


class BpeTransducer:
    """The lazily determinised transducer of one rank table; feed() bytes, then finish()."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = _ROOT
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.lookahead = max(map(len, ranks))
        self._split: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._fitting: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the last token put out, and the hypotheses (tokens completed since, trie node)
        self._states: dict[tuple, int] = {}
        self._meaning: list[tuple[int, tuple]] = []
        self._moves: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
        self._start = self._intern((-1, (((), _ROOT),)))

    def _intern(self, state: tuple) -> int:
        found = self._states.get(state)
        if found is None:
            found = self._states[state] = len(self._meaning)
            self._meaning.append(state)
        return found

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token; a single byte, or a token that no merge makes, is its own halves."""
        found = self._split.get(token)
        if found is None:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self._split[token] = found
        return found

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two may be adjacent: no merge across the border comes before the merges that made them.

        Undo the merges of both sides from the latest to the earliest; at each step the two tokens at the border
        must not merge earlier than what was undone last. On equal ranks the left merge is the earlier one.
        """
        if before < 0:
            return len(self.tokens[token]) == 1 or self._halves(token)[0] != token
        tokens, ranks = self.tokens, self.ranks
        left, right, undone = before, token, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], 1 << 60) < undone:
                return False
            inner_left, inner_right = self._halves(left)[1], self._halves(right)[0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                undone, left = left, inner_left
            else:
                undone, right = right + 1, inner_right

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, hypotheses = self._meaning[state]
        children, token_at, pairs = self.children, self.token_at, self._pairs
        live, done = [], None  # in the order of where their token under way began
        for path, node in hypotheses:
            node = children[node].get(byte, -1)
            if node < 0:
                continue
            if children[node]:
                live.append((path, node))
            token = token_at[node]
            if token >= 0 and done is None:  # only one completed hypothesis can be right
                before = path[-1] if path else last
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[before, token] = self._fits(before, token)
                if fits:
                    done = ((*path, token), _ROOT)
        if done is not None:
            live.append(done)
        agreed, first = 0, live[0][0]
        if len(live) == 1:
            agreed = len(first)
        else:
            while agreed < len(first) and all(len(path) > agreed and path[agreed] == first[agreed] for path, _ in live):
                agreed += 1
        if not agreed:
            return self._intern((last, tuple(live))), ()
        out = first[:agreed]
        return self._intern((out[-1], tuple([(path[agreed:], node) for path, node in live]))), out

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one match of the splitting pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self._moves) >= TRANSITIONS:
            self._moves.clear()
            self._reset()
        moves, state, out = self._moves, self._start, []
        for byte in data:
            move = moves.get((state, byte))
            if move is None:
                if len(moves) >= TRANSITIONS:  # inside one very long match: keep the state, drop the rest
                    meaning = self._meaning[state]
                    moves.clear()
                    self._reset()
                    state = self._intern(meaning)
                move = moves[state, byte] = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        for path, node in self._meaning[state][1]:
            if node == _ROOT:
                return out + list(path)
        raise ValueError("bytes without a token")

    def search(self, data: bytes) -> list[int]:
        """The tokens of one match without the automaton, for words seen once: the longest token that fits, else a
        shorter one, else a shorter one before it. As each prefix has one encoding, no place is come to by two ways, so
        that the steps are at most the bytes times the longest token.
        """
        ranks, fitting, size = self.ranks, self._fitting, len(self.tokens)
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n, at, last, out = len(data), 0, -1, []
        end = min(n, self.lookahead)
        while at < n:
            while end > at:
                token = ranks.get(data[at:end])
                if token is not None:
                    pair = last * size + token
                    fits = fitting.get(pair)
                    if fits is None:
                        if len(fitting) >= FITTING:
                            fitting.clear()
                        fits = fitting[pair] = self._fits(-1, token) and self._fits(last, token)
                    if fits:
                        break
                end -= 1
            if end > at:
                out.append(token)
                at, last, end = end, token, min(n, end + self.lookahead)
            elif out:
                end = at - 1
                at -= len(self.tokens[out.pop()])
                last = out[-1] if out else -1
            else:
                raise ValueError("bytes without a token")
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: the state is the unfinished character's bytes (at most three)."""

    def __init__(self, errors: str = "replace") -> None:
        self._held, self._errors = b"", errors

    def feed(self, data: bytes) -> str:
        data = self._held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character starts in the last three bytes
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut -= back if need > back and byte < 0xF8 else 0
                break
            if byte < 0x80:
                break
        self._held = data[cut:]
        return data[:cut].decode("utf-8", self._errors)

    def finish(self) -> str:
        held, self._held = self._held, b""
        return held.decode("utf-8", self._errors)


class Memo(dict):
    """Results for matches seen before, the transducer's moves over whole matches. Of two bounded generations the older
    is dropped when the younger is full; what was used since has moved to the younger by then."""

    def __init__(self, make) -> None:
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, match: str):
        made = self._old.get(match)
        if made is None:
            made = self._make(match)
        if len(match) <= 32:
            if len(self) >= MEMO:
                self._old = dict(self)
                self.clear()
            self[match] = made
        return made


class Codec:
    """Encoder and decoder of one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = BpeTransducer(ranks)
        self._pattern = regex.compile(pattern)
        self._memo = Memo(lambda match: array("I", self.transducer.encode(match.encode("utf-8", "surrogatepass"))).tobytes())

    def matches(self, text: str) -> Iterator[list[str]]:
        """The text's matches in bounded runs."""
        if len(text) <= RUN:
            yield self._pattern.findall(text)
            return
        found = (m.group() for m in self._pattern.finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(chain.from_iterable(map(self._memo.__getitem__, run) for run in self.matches(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.tokens.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], run: int = RUN) -> Iterator[tuple[bytes, str]]:
        """Bytes and finished characters, a run of tokens at a time."""
        ids, state = list(ids), Utf8Stream()
        for at in range(0, len(ids), run):
            data = self.decode_bytes(ids[at : at + run] if len(ids) > run else ids)
            yield data, state.feed(data)
        if rest := state.finish():
            yield b"", rest


_codecs: dict[tuple[str, str], Codec] = {}


def load_codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in a worker process."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _codecs[path, pattern] = Codec(ranks, pattern)
        gc.set_threshold(200_000, 20, 1000)  # the automaton is many small tuples without cycles
    return _codecs[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to. path: a rank file on every machine."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def digest(text: str) -> tuple:
        codec = load_codec(path, pattern)
        packed = codec.encode_packed(text)
        sha, n_bytes, same, at = hashlib.sha256(), 0, True, 0
        for data, chars in codec.decode_stream(array("I", packed)):
            sha.update(data)
            n_bytes += len(data)
            same = same and text.startswith(chars, at)
            at += len(chars)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), sha.hexdigest(), n_bytes, same and at == len(text)

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [digest(t) for t in batch.column(1).to_pylist()]
        return dict(zip(names, [batch.column(0), *zip(*rows, strict=True)], strict=True))

    return map_rows(doc_texts(docs), per_slice, SCHEMA)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text: the operator's own output."""

    def per_slice(batch: pa.RecordBatch) -> dict:
        codec = load_codec(path, pattern)
        return {"doc_id": batch.column(0), "ids": [codec.encode(t) for t in batch.column(1).to_pylist()]}

    return map_rows(doc_texts(docs), per_slice, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def per_slice(batch: pa.RecordBatch) -> dict:
        codec = load_codec(path, pattern)
        return {"doc_id": batch.column(0), "text": ["".join(c for _, c in codec.decode_stream(ids or [])) for ids in batch.column(1).to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), per_slice, "doc_id long, text string")
