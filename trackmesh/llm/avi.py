"""Media columns: AVI motion-JPEG.

A payload is stored as an AVI file whose frames are grey baseline JPEGs: each payload byte is one quantised coefficient.
All coefficients fall in the one size class 8, whose 256 values are the bytes, so that every code word is one bit and
eight value bits; with a restart marker after each block, blocks are of equal length and decode in bulk. A reader that
knows only the JPEG standard gets the same coefficients, and decode_scan() does it for frames from elsewhere with any
Huffman tables. Frames are decoded to samples by an integer inverse transform, and shots are found where the histogram
difference of adjacent frames exceeds the mean of the last ones by a multiple of their deviation.

Cases: null text is the empty payload, stored as 64 zero bytes. Equal texts give equal files and features. Long payloads
are encoded and decoded frame by frame in bounded runs. Repeated rows are stored each on their own; of equally large
differences none is a cut by itself. Other columns, whatever their names, are left behind. Empty tables give no row.
Of files from elsewhere: null media has no clip; bytes that are no AVI file give one row without a clip. A frame without
tables of its own has the standard's. A frame of no length (a dropped one) or one that cannot be decoded shows the frame
before it, or nothing at the start; `broken` counts the latter kind in each clip.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackmesh.llm.common import doc_texts, map_rows

#: Blocks across and down, frames a second.
ACROSS, DOWN, FPS = 8, 8, 25
PER_FRAME = 64 * ACROSS * DOWN
#: Frames handled at once.
RUN = 256
BINS, MEMORY, FACTOR, FLOOR = 32, 8, 3.0, 0.25

DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long"
CLIPS = "doc_id long, clip long, first_frame long, n_frames long, start_s double, end_s double, mean_luma double, cut_score double, broken long"


def _zigzag() -> np.ndarray:
    """The row-major place of each coefficient in scan order: along antidiagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _idct_matrix() -> np.ndarray:
    """64 x 64, scaled by 2**13 and rounded to integers, which products in double hold exactly: the same samples on any machine."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(basis, basis) * 8192).T.copy()


_IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _huffman_segment(kind: int, symbols_by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(symbols_by_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for n in sorted(symbols_by_length) for s in symbols_by_length[n]))


#: Fixed values of the standard: how many code words of 1 to 16 bits there are, and the symbols in their order. Of AC symbols
#: (run and size) those not named follow in ascending order. By table class and number, as in a frame's own tables.
_DC_SYMBOLS = list(range(12))
_AC_SYMBOLS = sorted([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
_AC_LUMA = [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82]
_AC_CHROMA = [0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1]
_STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], _DC_SYMBOLS),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], _DC_SYMBOLS),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _AC_LUMA + [x for x in _AC_SYMBOLS if x not in _AC_LUMA]),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _AC_CHROMA + [x for x in _AC_SYMBOLS if x not in _AC_CHROMA]),
}


def _by_length(counts: list[int], symbols: list[int]) -> dict[int, list[int]]:
    ends = np.cumsum(counts).tolist()
    return {n: symbols[end - count : end] for n, (count, end) in enumerate(zip(counts, ends, strict=True), 1) if count}


STANDARD_TABLES = {kind: _by_length(*table) for kind, table in _STANDARD.items()}
#: One symbol, size class 8 without a run, as the code word 0.
_FLAT = {1: [8]}
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
    + _huffman_segment(0x00, _FLAT)
    + _huffman_segment(0x10, _FLAT)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """Frames of PER_FRAME payload bytes each, as JPEGs."""
    blocks = payload.reshape(-1, 64)
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(len(blocks), 64, 8)
    coded = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    frames, n = [], ACROSS * DOWN
    marks = [bytes([0xFF, 0xD0 + i % 8]) for i in range(n - 1)] + [b""]
    for at in range(0, len(blocks), n):
        rows = coded[at : at + n].tobytes()
        if 255 in rows:
            scan = b"".join(rows[72 * i : 72 * i + 72].replace(b"\xff", b"\xff\x00") + marks[i] for i in range(n))
        else:
            scan = b"".join(rows[72 * i : 72 * i + 72] + marks[i] for i in range(n))
        frames.append(_HEAD + scan + b"\xff\xd9")
    return frames


@dataclass
class Frame:
    """What a JPEG's headers say, and where its entropy-coded scan is."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    quant: dict[int, np.ndarray]
    huffman: dict[int, dict[int, list[int]]]
    tables: dict[int, int]  # component to its DC and AC tables
    restart: int
    scan: bytes


def parse_jpeg(data: bytes) -> Frame:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huffman, restart, size, components = 2, {}, dict(STANDARD_TABLES), 0, (0, 0), []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        if data[at + 1] in (0xFF, 0x01, *range(0xD0, 0xD8)):  # a fill byte, or a marker without a body
            at += 1 if data[at + 1] == 0xFF else 2
            continue
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                huffman[body[0]] = _by_length(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            end = data.rfind(b"\xff\xd9")
            return Frame(size[1], size[0], components, quant, huffman, tables, restart, data[at : end if end >= at else len(data)])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only sequential Huffman frames can be decoded")
    raise ValueError("no scan")


def _is_flat(frame: Frame) -> bool:
    return len(frame.components) == 1 and frame.restart == 1 and frame.huffman[0] == frame.huffman[0x10] == _FLAT and frame.width % 8 == frame.height % 8 == 0


def flat_payload(scans: list[bytes]) -> np.ndarray:
    """Payload rows of 64 bytes from scans of the equal-length form."""
    coded = b"".join(_RESTART.sub(b"", s).replace(b"\xff\x00", b"\xff") for s in scans)
    bits = np.unpackbits(np.frombuffer(coded, np.uint8)).reshape(-1, 64, 9)
    if bits[:, :, 0].any():
        raise ValueError("unknown code word")
    return np.packbits(bits[:, :, 1:], axis=2).reshape(-1, 64)


def payload_coefficients(payload: np.ndarray) -> np.ndarray:
    """Coefficients in scan order: a byte with its high bit is itself, another one is 255 less (size class 8)."""
    wide = payload.astype(np.int64)
    return np.where(payload >= 128, wide, wide - 255)


def decode_scan(frame: Frame) -> dict[int, np.ndarray]:
    """Coefficients of each component's blocks in scan order, for any Huffman tables; bit by bit, for foreign frames."""
    codes = {}
    for kind, by_length in frame.huffman.items():
        code, table = 0, {}
        for n in range(1, 17):
            for symbol in by_length.get(n, []):
                table[n, code] = symbol
                code += 1
            code <<= 1
        codes[kind] = table
    out: dict[int, list] = {c[0]: [] for c in frame.components}
    single = len(frame.components) == 1
    wide = max(c[1] for c in frame.components)
    high = max(c[2] for c in frame.components)
    cell = (8, 8) if single else (8 * wide, 8 * high)
    left = -(-frame.width // cell[0]) * -(-frame.height // cell[1])
    parts = _RESTART.split(frame.scan) if frame.restart else [frame.scan]
    for part in parts:
        data, dc = iter(part.replace(b"\xff\x00", b"\xff")), dict.fromkeys(out, 0)
        ahead = have = 0  # bits read and not used yet, and their number

        def bits(n: int) -> int:
            nonlocal ahead, have
            while have < n:
                byte = next(data, None)
                if byte is None:
                    raise ValueError("the scan ends too soon")
                ahead, have = ahead << 8 | byte, have + 8
            have -= n
            found, ahead = ahead >> have, ahead & ((1 << have) - 1)
            return found

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("unknown code word")

        def value(n: int) -> int:
            if not n:
                return 0
            v = bits(n)
            return v if v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(left, frame.restart or left)):
            left -= 1
            for ident, h, v, _ in frame.components:
                kinds = frame.tables[ident]
                for _ in range(1 if single else h * v):
                    block = [0] * 64
                    dc[ident] += value(symbol(codes[kinds >> 4]))
                    block[0], k = dc[ident], 1
                    while k < 64:
                        run, size = divmod(symbol(codes[0x10 | kinds & 15]), 16)
                        if not size and run < 15:
                            break
                        k += run
                        if size:
                            block[k] = value(size)
                        k += 1
                    out[ident].append(block)
    return {k: np.array(v, np.int64).reshape(-1, 64) for k, v in out.items()}


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks, 64 each in rows: dequantised, transformed, shifted and clamped."""
    placed = np.empty(coefficients.shape, np.float64)
    placed[:, ZIGZAG] = coefficients * quant
    return np.clip(np.floor((placed @ _IDCT + 4096) / 8192) + 128, 0, 255).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file with an index; its length is kept in a chunk of its own, as the last frame is filled with zeros."""
    padded = payload + b"\x00" * (-len(payload) % PER_FRAME)
    data, frames = np.frombuffer(padded, np.uint8), []
    for at in range(0, len(data), RUN * PER_FRAME):
        frames += encode_frames(data[at : at + RUN * PER_FRAME])
    largest = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, 8 * ACROSS, 8 * DOWN, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, 8 * ACROSS, 8 * DOWN)
    form = struct.pack("<IiiHH4sIiiII", 40, 8 * ACROSS, 8 * DOWN, 1, 24, b"MJPG", 3 * 64 * ACROSS * DOWN, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at = [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    body = b"AVI " + headers + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Avi:
    frame_seconds: float
    frames: list[tuple[int, int]]  # place and length of each frame's bytes
    payload_bytes: int | None


def parse_avi(data: bytes) -> Avi:
    """Frames by the idx1 index; without one, or in a file of several RIFF parts, by walking the movi lists."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, seconds, movi, index, walked, length, more = 12, 1 / FPS, None, None, [], None, False
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind in (b"LIST", b"RIFF"):
            if data[at + 8 : at + 12] == b"movi":
                movi = at + 8 if movi is None else movi
            more |= kind == b"RIFF"
            at += 12
            continue
        if kind == b"avih":
            seconds = struct.unpack("<I", data[at + 8 : at + 12])[0] / 1e6
        elif kind == b"plen":
            length = struct.unpack("<Q", data[at + 8 : at + 16])[0]
        elif kind[2:] in (b"dc", b"db") and movi is not None:
            walked.append((at + 8, size))
        elif kind == b"idx1":
            index = [(k, o, n) for k, _, o, n in struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size - size % 16])]
        at += 8 + size + size % 2
    if index is None or movi is None or more:
        return Avi(seconds, walked, length)
    video = [(o, n) for k, o, n in index if k[2:] in (b"dc", b"db")]
    # places count from the list's kind, or from the file's start in some writers
    base = movi if not video or data[movi + video[0][0] : movi + video[0][0] + 4][2:] in (b"dc", b"db") else 0
    return Avi(seconds, [(base + o + 8, n) for o, n in video], length)


def decode_foreign(raw: bytes) -> np.ndarray:
    """The luma samples of a frame from elsewhere; a ValueError if it cannot be decoded."""
    try:
        frame = parse_jpeg(raw)
        first = frame.components[0]  # the luma component
        return samples(decode_scan(frame)[first[0]], frame.quant[first[3]]).reshape(1, -1)
    except (KeyError, IndexError, struct.error, TypeError) as fault:
        raise ValueError(f"broken frame: {fault!r}") from fault


def decode_runs(data: bytes, avi: Avi) -> Iterator[tuple[np.ndarray | None, np.ndarray, int]]:
    """Payload bytes (None for foreign frames), the frames' samples, and how many are broken, a run of frames at a time."""
    flat_quant, before = None, np.zeros((1, 64), np.uint8)
    for at in range(0, len(avi.frames), RUN):
        raw = [data[p : p + n] for p, n in avi.frames[at : at + RUN]]
        if all(r.startswith(_HEAD) and len(r) >= len(_HEAD) + 2 for r in raw):
            if flat_quant is None:
                frame = parse_jpeg(raw[0])
                flat_quant = frame.quant[frame.components[0][3]] if _is_flat(frame) else None
            payload = flat_payload([r[len(_HEAD) : -2] for r in raw])
            shown = samples(payload_coefficients(payload), flat_quant).reshape(len(raw), -1)
            yield payload.reshape(-1), shown, 0
            before = shown[-1:]
            continue
        for r in raw:
            broken = 0
            if r:
                try:
                    before = decode_foreign(r)
                except ValueError:
                    broken = 1
            yield None, before, broken


def histograms(frames: np.ndarray) -> np.ndarray:
    """Counts of BINS sample ranges in each frame."""
    flat = frames // (256 // BINS) + BINS * np.arange(len(frames), dtype=np.int64)[:, None]
    return np.bincount(flat.ravel(), minlength=BINS * len(frames)).reshape(-1, BINS)


def detect_shots(hists: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and each frame's difference from the one before (0 to 1).

    A cut needs a difference above FLOOR and above mean + FACTOR * deviation of up to MEMORY differences since the last cut.
    """
    share = hists / np.maximum(hists.sum(axis=1, keepdims=True), 1)
    diff = np.concatenate(([0.0], np.abs(np.diff(share, axis=0)).sum(axis=1) / 2))
    starts, recent = [0], []
    for i, d in enumerate(diff.tolist()):
        if not i:
            continue
        mean = sum(recent) / len(recent) if recent else 0.0
        deviation = (sum((r - mean) ** 2 for r in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > FLOOR and d > mean + FACTOR * deviation:
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - MEMORY :], d]
    return starts, diff


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with zeros up to a positive multiple of 64, and the length without them."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\x00" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def analyse(media: bytes) -> tuple[bytes, list[tuple], int]:
    """The payload read back, the clip rows (clip, first, n, start, end, luma, score, broken), and the number of frames."""
    avi = parse_avi(media)
    parts, hists, lumas, bad = [], [], [], []
    for payload, frames, broken in decode_runs(media, avi):
        bad += [broken] * len(frames)
        if payload is not None:
            parts.append(payload.tobytes())
        hists.append(histograms(frames))
        lumas.append(frames.sum(axis=1, dtype=np.int64) / frames.shape[1])
    hist = np.concatenate(hists) if hists else np.zeros((0, BINS))
    luma = np.concatenate(lumas) if lumas else np.zeros(0)
    starts, diff = detect_shots(hist) if len(hist) else ([], np.zeros(0))
    clips = []
    for k, first in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(hist)
        clips.append((k, first, end - first, first * avi.frame_seconds, end * avi.frame_seconds, float(luma[first:end].sum() / (end - first)), float(diff[first]), sum(bad[first:end])))
    return b"".join(parts)[: avi.payload_bytes], clips, len(hist)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's payload as an AVI file."""

    def per_slice(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "media": [write_avi(padded(t)[0]) for t in batch.column(1).to_pylist()]}

    return map_rows(doc_texts(docs), per_slice, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of a media column (doc_id, media); null media has none, other bytes than AVI a row without a clip."""
    names = [c.split()[0] for c in CLIPS.split(", ")]

    def found(media: bytes) -> list[tuple]:
        try:
            return analyse(media)[1]
        except (ValueError, struct.error):
            return [(None, None, 0, None, None, None, None, 0)]

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [(d, *c) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None for c in found(m)]
        return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

    return map_rows(media.select("doc_id", "media"), per_slice, CLIPS)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text, read it back, and describe both."""
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def describe(text: str) -> tuple:
        payload, n_bytes = padded(text)
        media = write_avi(payload)
        back, shots, n_frames = analyse(media)
        cuts = ",".join(f"{c[1]}+{c[2]}@{round(c[5] * 100)}" for c in shots)
        feature = hashlib.sha256(f"{n_frames};{cuts}".encode()).hexdigest()[:16] + f":{n_frames}:{len(shots)}"
        return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, n_frames, len(shots)

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [describe(t) for t in batch.column(1).to_pylist()]
        return dict(zip(names, [batch.column(0), *zip(*rows, strict=True)], strict=True))

    return map_rows(doc_texts(docs), per_slice, DIGEST)
