"""Media columns: AVI files of motion-JPEG frames, written and read inside a binary column.

Frames are lossless JPEG (SOF3, 8-bit grey, predictor 1) of 64 samples a row, one
restart interval a row.  Restart intervals are independent, so all rows of all
frames of a batch are coded and decoded together, sample by sample, as numpy
arrays.  Reading parses the RIFF chunks, takes the frames from the ``idx1``
index, decodes each and marks a shot where the difference of neighbouring
histograms exceeds a threshold that adapts to the clip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.rows import per_text, slices

WIDTH, HEIGHT, RATE = 64, 64, 25
#: Characters of text, or bytes of media, that a task codes at once.
AT_ONCE = 1_000_000
#: A cut: histogram difference (0 to 2) over FLOOR and, where at least FEW others lie within NEAR of it, over their
#: median + DEVIATIONS * their median absolute deviation.
DEVIATIONS, FLOOR, NEAR, FEW = 4.0, 0.25, 8, 4

# Huffman code of the nine difference sizes 0..8 as the number of codes of each length (fixed values of this format).
_COUNTS = (0, 1, 3, 2, 1, 1, 1)  # lengths 1..7
_SYMBOLS = (5, 4, 6, 3, 7, 2, 0, 1, 8)


def _codes(counts, symbols) -> list[tuple[int, int, int]]:
    """``(symbol, code, length)`` of a canonical JPEG Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255, at index difference + 255."""
    bits, length = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    table = {s: (c, n) for s, c, n in _codes(_COUNTS, _SYMBOLS)}
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        bits[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
        length[d + 255] = n + size
    return bits, length


_BITS, _LENGTH = _encoder()


def _scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every row, before stuffing: ``[rows, bytes]`` and the byte count of each row."""
    place = np.empty(rows.shape[::-1], np.int16)  # difference + 255, sample by sample
    columns = rows.T.astype(np.int16)
    place[0] = columns[0] + (255 - 128)
    place[1:] = columns[1:] - columns[:-1] + 255
    bits, length = _BITS[place], _LENGTH[place]
    n, most = len(rows), int(length.sum(axis=0, dtype=np.int64).max()) // 8 + 16
    out = np.full((n, most // 4 + 1), 0xFFFFFFFF, ">u4")
    held, count, at = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, k in zip(bits, length):
        held = held << k.astype(np.uint64) | b.astype(np.uint64)
        count += k
        full = np.flatnonzero(count >= 32)
        if len(full):
            left = count[full] - 32
            out[full, at[full]] = (held[full] >> left.astype(np.uint64)).astype(np.uint32)
            held[full] &= (np.uint64(1) << left.astype(np.uint64)) - np.uint64(1)
            count[full], at[full] = left, at[full] + 1
    pad = (32 - count).astype(np.uint64)  # ones fill the last byte, as the format asks
    out[np.arange(n), at] = (held << pad | (np.uint64(1) << pad) - np.uint64(1)).astype(np.uint32)
    return out.view(np.uint8).reshape(n, -1), at * 4 + -(-count // 8)


def _header(height: int) -> bytes:
    dht = struct.pack(">HB", 2 + 17 + len(_SYMBOLS), 0) + bytes(_COUNTS) + bytes(16 - len(_COUNTS)) + bytes(_SYMBOLS)
    sof = struct.pack(">HBHHBBBB", 11, 8, height, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8\xff\xc4" + dht + b"\xff\xc3" + sof + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


_HEADERS = {h: _header(h) for h in range(1, HEIGHT + 1)}


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file of MJPEG frames, with an index."""
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def payload(text: str) -> bytes:
    """UTF-8 bytes of a text, zero-padded to a positive multiple of WIDTH."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of WIDTH."""
    if not payloads:
        return []
    coded, size = _scan(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH))
    n = len(size)
    flat = coded[np.arange(coded.shape[1]) < size[:, None]]
    full = flat == 0xFF
    ends = np.cumsum(size)
    stuffed = np.zeros(len(flat) + int(full.sum()), np.uint8)
    moved = np.cumsum(full)
    stuffed[np.arange(len(flat)) + moved - full] = flat  # a zero byte follows each 0xFF
    ends = ends + moved[ends - 1]
    starts, data = np.r_[0, ends[:-1]].tolist(), stuffed.tobytes()
    ends = ends.tolist()
    out, row = [], 0
    for p in payloads:
        frames, last = [], row + len(p) // WIDTH
        for top in range(row, last, HEIGHT):
            height = min(HEIGHT, last - top)
            parts = [_HEADERS[height]]
            for i in range(height):
                parts += (data[starts[top + i] : ends[top + i]], b"\xff" + bytes((0xD0 + i % 8,)))
            parts[-1] = b"\xff\xd9"
            frames.append(b"".join(parts))
        out.append(_avi(frames))
        row = last
    assert row == n
    return out


def frames_of(media: bytes) -> list[bytes]:
    """The frames of an AVI file, by its ``idx1`` index, or in file order if it has none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, found = 12, 0, None, []
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi, found = at + 8, [(at + 12, at + 8 + size)]
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + size % 2
    if index:
        entries = struct.iter_unpack("<4sIII", media[index[0] : index[0] + index[1] // 16 * 16])
        return [media[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in entries if name[2:] == b"dc"]
    frames = []
    for at, end in found:
        while at + 8 <= end:
            size = struct.unpack_from("<I", media, at + 4)[0]
            if media[at + 2 : at + 4] == b"dc":
                frames.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return frames


def _segments(frame: bytes) -> tuple[int, int, tuple, int]:
    """Height, width, Huffman table and start of the scan of a lossless grey JPEG frame."""
    at, height, width, table, interval = 2, 0, 0, None, 0
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            counts = tuple(body[1:17])
            table = counts, tuple(body[17 : 17 + sum(counts)])
        elif marker == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if table is None or interval != width:
                raise ValueError("only lossless frames with one restart interval a row can be read")
            return height, width, table, at + 2 + size
        elif marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("a lossy frame can't be read without loss")
        at += 2 + size


def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Size and code length for every 8 leading bits."""
    size, length = np.zeros(256, np.int64), np.ones(256, np.int64)
    for symbol, code, n in _codes(*table):
        size[code << 8 - n : code + 1 << 8 - n], length[code << 8 - n : code + 1 << 8 - n] = symbol, n
    return size, length


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame, ``[height, width]``; frames of one width and table are decoded together."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple, list[tuple[int, int, int]]] = {}
    parsed: dict[bytes, tuple] = {}
    for i, f in enumerate(frames):
        head = f[: len(_HEADERS[1])]  # frames written here share few different headers
        height, width, table, at = parsed.get(head) or _segments(f)
        if at <= len(head):
            parsed[head] = height, width, table, at
        groups.setdefault((width, table), []).append((i, height, at))
    for (width, table), members in groups.items():
        raw = np.frombuffer(b"".join(frames[i][at:-2] + b"\xff\xd0" for i, _, at in members), np.uint8)
        follows = np.r_[False, raw[:-1] == 0xFF]
        zero = follows & (raw == 0)
        restart = np.flatnonzero(follows & ((raw & 0xF8) == 0xD0))  # second byte of each marker
        keep = ~zero
        place = np.cumsum(keep)
        ends = place[restart] - 2  # the marker's two bytes are not data
        flat = np.r_[raw[keep], np.zeros(8, np.uint8)].astype(np.uint32)
        starts = np.r_[0, ends[:-1] + 2]
        windows = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
        size_of, length_of = _lookup(table)
        at, before = starts * 8, np.full(len(starts), 128, np.int64)
        samples = np.empty((width, len(starts)), np.uint8)
        for k in range(width):
            bits = windows[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
            lead = bits >> 24
            size, length = size_of[lead], length_of[lead]
            value = (bits >> (32 - length - size)) & ((1 << size) - 1)
            before = before + value - np.where(value < (1 << size >> 1), (1 << size) - 1, 0)
            samples[k] = before
            at = at + length + size
        rows, top = samples.T, 0
        for i, height, _ in members:
            out[i] = rows[top : top + height]
            top += height
    return out


def _usual(diff: np.ndarray, i: int) -> float:
    """What the differences around ``diff[i]``, itself left out, reach without a cut; zero if they are too few to tell."""
    others = np.r_[diff[max(0, i - NEAR) : i], diff[i + 1 : i + 1 + NEAR]]
    if len(others) < FEW:
        return 0.0
    middle = np.median(others)
    return float(middle + DEVIATIONS * np.median(np.abs(others - middle)))


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """Frame ranges of the shots: a cut is where the histogram difference stands out from those around it."""
    if len(frames) < 2:
        return [(0, len(frames))]
    hists = np.stack([np.bincount(f.ravel() >> 3, minlength=32) / f.size for f in frames])
    diff = np.abs(np.diff(hists, axis=0)).sum(axis=1)
    cut = np.array([i for i in np.flatnonzero(diff > FLOOR) if diff[i] > _usual(diff, i)], np.int64) + 1
    edges = [0, *cut.tolist(), len(frames)]
    return list(zip(edges, edges[1:]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)`` per row of ``docs``: media is an AVI file that holds the text's bytes without loss.

    Null text counts as empty and is stored as one row of zeros.  Ids may be null or repeat.
    """

    def of(texts: list[str]) -> dict:
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "media": encode([payload(t) for t in texts])}

    return per_text(docs, of, "n_bytes bigint,media binary", id_col, text_col, AT_ONCE)


CLIPS = "array<struct<clip:int,first_frame:int,frames:int,start_ms:bigint,end_ms:bigint>>"


def read(stored: DataFrame) -> DataFrame:
    """What is read back from ``stored (doc_id, n_bytes, media)``: digests of payload and file, and the clips.  Null media gives no row."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            every = batch.column(2).to_pylist()
            for start, end in slices(every, AT_ONCE):
                media = every[start:end]
                per_file = [frames_of(m) for m in media]
                decoded, at, rows = decode([f for fs in per_file for f in fs]), 0, []
                for m, fs in zip(media, per_file):
                    frames, at = decoded[at : at + len(fs)], at + len(fs)
                    data = b"".join(f.tobytes() for f in frames)
                    clips = [{"clip": i, "first_frame": a, "frames": b - a, "start_ms": a * 1000 // RATE, "end_ms": b * 1000 // RATE} for i, (a, b) in enumerate(shots(frames))]
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), clips))
                columns = [pa.array(c, target.field(i + 2).type) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), *columns], schema=target)

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = stored.sparkSession.createDataFrame([], f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, clips {CLIPS}").schema
    return stored.where("media is not null").select("doc_id", "n_bytes", "media").mapInArrow(of, schema)


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows ``(doc_id, clip, first_frame, frames, start_ms, end_ms)`` of stored media."""
    return read(stored).select("doc_id", F.inline("clips"))


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read it back, and give its digests with the clips listed in ``feature``."""
    out = read(store(docs, id_col, text_col))
    listed = F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string")))
    return out.withColumn("feature", F.concat_ws(":", F.lit("shots"), F.size("clips").cast("string"), F.array_join(listed, ","))).drop("clips")
