"""AVI motion-JPEG columns: lossless grey frames, RIFF index reading, frame decoding and shot detection.

Frames are lossless JPEG (SOF3, predictor 1), since baseline JPEG can't keep samples exactly. Every frame row is one
restart interval, so the rows of all frames of a slice are coded and decoded side by side with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.words import text_slices

WIDTH = 64
FRAME_ROWS = 16
FPS = 25
HISTOGRAM_BINS = 16
#: Code length of each difference category 0..8; no code has ones only.
CODE_LENGTHS = {7: 2, 4: 2, 3: 3, 2: 3, 5: 4, 1: 4, 0: 4, 6: 5, 8: 6}
WINDOW = 14


def huffman_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical (code, length) by symbol, as the JPEG standard assigns them."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _sample_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of every difference -255..255, at index difference + 255."""
    codes, bits, count = huffman_codes(CODE_LENGTHS), np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits[d + 255], count[d + 255] = (code << size) | (d if d >= 0 else d + (1 << size) - 1), n + size
    return bits, count


BITS, BIT_COUNT = _sample_codes()


def decode_table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Difference and bits used by the next WINDOW bits; 0 bits where no code begins so."""
    value, used = np.zeros(1 << WINDOW, np.int64), np.zeros(1 << WINDOW, np.int64)
    for size, (code, n) in huffman_codes(lengths).items():
        for extra in range(1 << size):
            d = extra if size and extra >> (size - 1) else extra - (1 << size) + 1
            free = WINDOW - n - size
            at = ((code << size) | extra) << free
            value[at : at + (1 << free)], used[at : at + (1 << free)] = (d if size else 0), n + size
    return value, used


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(rows: int, width: int = WIDTH) -> bytes:
    """Everything before the entropy-coded data."""
    order = sorted(CODE_LENGTHS, key=lambda s: CODE_LENGTHS[s])
    counts = bytes(sum(CODE_LENGTHS[s] == n for s in order) for n in range(1, 17))
    return b"\xff\xd8" + _segment(0xC4, b"\x00" + counts + bytes(order)) + _segment(0xDD, struct.pack(">H", width)) + _segment(0xC3, struct.pack(">BHHBBBB", 8, rows, width, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_rows(samples: np.ndarray, last_of_frame: np.ndarray, row_in_frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all rows, each with its restart marker, or the end marker after a frame's last row; and the row offsets."""
    before = np.empty(samples.shape, np.int64)
    before[:, 0], before[:, 1:] = 128, samples[:, :-1]
    at = samples.astype(np.int64) - before + 255
    count = BIT_COUNT[at]
    used = count.sum(1)
    size = (used + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    bit = (np.cumsum(count, 1) - count + start[:-1, None] * 8).ravel()
    window = BITS[at].ravel() << (24 - (bit & 7) - count.ravel())
    byte = bit >> 3
    out = np.zeros(start[-1] + 2)
    for k in range(3):
        out += np.bincount(byte + k, (window >> (16 - 8 * k)) & 255, len(out))
    out = out[: start[-1]].astype(np.uint8)
    out[start[1:] - 1] |= ((1 << (size * 8 - used)) - 1).astype(np.uint8)
    stuffed = np.insert(out, np.flatnonzero(out == 255) + 1, 0)
    ends = start[1:] + np.cumsum(out == 255)[start[1:] - 1]
    markers = np.where(last_of_frame, 0xD9, 0xD0 + row_in_frame % 8).astype(np.uint8)
    return np.insert(stuffed, np.repeat(ends, 2), np.stack([np.full(len(ends), 255, np.uint8), markers], 1).ravel()), np.concatenate([[0], ends + 2 * np.arange(1, len(ends) + 1)])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(frames: list[bytes], rows: int, n_bytes: int, width: int = WIDTH) -> bytes:
    """A RIFF AVI with one MJPG stream, an idx1 index and the unpadded payload size in an info chunk."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, rows, 1, 8, b"MJPG", width * rows, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISZE", str(n_bytes).encode()))
    body, index, at = [], [], 4
    for x in frames:
        body.append(_chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[list[tuple[int, int]], dict]:
    """(offset, size) of every frame from the idx1 index, and n_bytes, fps and rows from the headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    facts, movi, frames, at = {}, 0, [], 12
    todo = [(at, len(media))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                facts |= {"fps": 1_000_000 / struct.unpack_from("<I", media, at + 8)[0]}
            elif name == b"ISZE":
                facts |= {"n_bytes": int(media[at + 8 : at + 8 + size])}
            elif name == b"idx1":
                frames = [struct.unpack_from("<II", media, at + 8 + k + 8) for k in range(0, size, 16) if media[at + 8 + k : at + 8 + k + 4] == b"00dc"]
            at += 8 + size + size % 2
    return [(movi + offset + 8, size) for offset, size in frames], facts


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def read_frame_header(media: bytes, at: int) -> tuple[int, int, int, bytes]:
    """(rows, width, start of the coded data, Huffman table) of a lossless JPEG frame at ``at``."""
    at, rows, width, table = at + 2, 0, 0, b""
    while True:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        if marker == 0xC3:
            rows, width = struct.unpack_from(">HH", media, at + 5)
        elif marker == 0xC4:
            table = media[at + 5 : at + 2 + size]
        elif marker == 0xDA:
            return rows, width, at + 2 + size, table
        elif marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("only lossless frames (SOF3) are decoded")
        at += 2 + size


def decode_rows(coded: np.ndarray, width: int, table: bytes) -> np.ndarray:
    """Samples of all rows in ``coded``, which holds coded data with restart and end markers; row by row side by side."""
    if table not in _TABLES:
        lengths, at = {}, 16
        for n in range(16):
            for symbol in table[at : at + table[n]]:
                lengths[symbol] = n + 1
            at += table[n]
        _TABLES[table] = decode_table(lengths)
    value, used = _TABLES[table]
    escape = np.flatnonzero(coded == 255)
    after = coded[escape + 1]
    marks = escape[after != 0]
    drop = np.zeros(len(coded), bool)
    drop[escape[after == 0] + 1] = True
    drop[marks] = drop[marks + 1] = True
    data = np.concatenate([coded[~drop], np.zeros(4, np.uint8)]).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(~drop)])
    bit = np.concatenate([[0], kept[marks[:-1] + 2]]) * 8
    wide = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out, now = np.empty((width, len(marks)), np.uint8), np.full(len(marks), 128, np.int64)
    for k in range(width):
        window = (wide[bit >> 3] >> (24 - WINDOW - (bit & 7))) & ((1 << WINDOW) - 1)
        now = now + value[window]
        bit = bit + used[window]
        out[k] = now
    return np.ascontiguousarray(out.T)


def shots(frames: np.ndarray) -> list[int]:
    """First frames of the shots. ``frames`` holds a histogram each. A cut is a difference above 0.25 and above the mean
    of all differences so far in the shot by three standard deviations."""
    cuts, seen = [0], []
    for k in range(1, len(frames)):
        d = float(np.abs(frames[k] - frames[k - 1]).sum() / 2)
        if d > 0.25 and len(seen) >= 2 and d > np.mean(seen) + 3 * np.std(seen):
            cuts.append(k)
            seen = []
        else:
            seen.append(d)
    return cuts


def encode_slice(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One AVI for each row: its bytes, zeros up to a positive multiple of WIDTH, as grey samples."""
    size = np.diff(at)
    rows = np.maximum(-(-size // WIDTH), 1)
    first = np.concatenate([[0], np.cumsum(rows)])
    samples = np.zeros(first[-1] * WIDTH, np.uint8)
    samples[np.repeat(first[:-1] * WIDTH - at[:-1], size) + np.arange(len(data))] = data
    number = np.arange(first[-1]) - np.repeat(first[:-1], rows)
    in_frame = number % FRAME_ROWS
    last = (in_frame == FRAME_ROWS - 1) | (number == np.repeat(rows, rows) - 1)
    coded, ends = encode_rows(samples.reshape(-1, WIDTH), last, in_frame)
    raw, headers, out = coded.tobytes(), {}, []
    for k, n in enumerate(rows.tolist()):
        frames = []
        for a in range(0, n, FRAME_ROWS):
            own = min(FRAME_ROWS, n - a)
            if own not in headers:
                headers[own] = frame_header(own)
            frames.append(headers[own] + raw[ends[first[k] + a] : ends[first[k] + a + own]])
        out.append(avi_file(frames, min(n, FRAME_ROWS), int(size[k])))
    return out


def decode_files(media: list[bytes]) -> list[tuple[np.ndarray, list[int], dict]]:
    """(samples, rows of each frame, facts) of every file; the rows of all files are decoded together."""
    groups: dict[tuple[int, bytes], list] = {}
    plan = []
    for x in media:
        frames, facts = read_avi(x)
        own = []
        for at, size in frames:
            rows, width, start, table = read_frame_header(x, at)
            parts = groups.setdefault((width, table), [0, []])
            own.append(((width, table), parts[0], rows))
            parts[0] += rows
            parts[1].append(x[start : at + size])
        plan.append((own, facts))
    decoded = {k: decode_rows(np.frombuffer(b"".join(v[1]), np.uint8), *k) for k, v in groups.items()}
    return [(np.concatenate([decoded[k][a : a + n].ravel() for k, a, n in own]), [n for *_, n in own], facts) for own, facts in plan]


def encode_media(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, media: an AVI motion-JPEG that holds the UTF-8 bytes of the text losslessly.

    A null or empty text becomes one row of zeros; a null doc_id stays null; repeated rows are encoded each; an empty
    table gives no rows; other columns are ignored. A text must be under 4 GB, RIFF's limit.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text"), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(encode_slice(data, at), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, media binary")


def _decoded(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes], list]]:
    values, first = batch.column("media"), 0
    while first < batch.num_rows:
        end, size, media = first, 0, []
        while end < batch.num_rows and (not media or size < most):
            media.append(values[end].as_py() or b"")
            size += len(media[-1])
            end += 1
        yield first, end, media, decode_files(media)
        first = end


def _histograms(samples: np.ndarray, rows: list[int]) -> np.ndarray:
    frame = np.repeat(np.arange(len(rows)), np.array(rows) * WIDTH)
    counts = np.bincount(frame * HISTOGRAM_BINS + samples // (256 // HISTOGRAM_BINS), minlength=len(rows) * HISTOGRAM_BINS).reshape(len(rows), -1)
    return counts / counts.sum(1, keepdims=True)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of ``media`` (doc_id, media): clip, first_frame, n_frames, start_s, end_s. A null file has none.

    Repeated files have the same rows each; a null doc_id stays null; an empty table gives none; other columns are
    ignored; an empty text has one clip, that of its padding.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for first, _, _, files in _decoded(batch):
                for k, (samples, own, facts) in enumerate(files):
                    starts = [*shots(_histograms(samples, own)), len(own)]
                    rows += [(doc_ids[first + k], i, a, b - a, a / facts["fps"], b / facts["fps"]) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(cut, "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double")


def media_features(media: DataFrame) -> DataFrame:
    """What reading ``media`` (doc_id, media) back gives: sizes, digests and a feature string of frames, cuts and grey levels.

    One row for each of ``media``, repeated ones too; a null doc_id stays null; an empty table gives none; other columns
    are ignored; files are read whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, files, got in _decoded(batch):
                rows = []
                for x, (samples, own, facts) in zip(files, got, strict=True):
                    payload = samples.tobytes()
                    histogram = _histograms(samples, own)
                    level = ",".join(f"{v:.4f}" for v in histogram.mean(0))
                    feature = f"frames={len(own)};cuts={','.join(map(str, shots(histogram)))};seconds={len(own) / facts['fps']:.2f};grey={level}"
                    rows.append((facts["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
