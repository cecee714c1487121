"""Media columns: motion-JPEG in AVI.

Reads the RIFF index of an AVI file, decodes its intra frames (baseline JPEG) and cuts the frame sequence into shots where
the luma histogram changes more than its recent changes let expect.  A writer stores any byte string losslessly: JPEG's
unit is the quantised coefficient, and a coefficient of size category 8 holds exactly one byte, so each 8x8 block carries
64 bytes.  With a quantiser of one everywhere such frames are ordinary baseline JPEG files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate

SIDE = 64
PER_FRAME = SIDE * SIDE
FPS = 25
#: JPEG's zigzag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def _frame_head() -> bytes:
    """Everything of a frame before its entropy-coded data.

    Both Huffman tables have two codes: '0' for a coefficient of category 8 and '10' for none (DC) or end of block (AC).
    A restart after each block keeps DC values absolute and every full block at 72 bytes.
    """
    lengths = bytes([1, 1] + [0] * 14)
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + lengths + b"\x08\x00" + b"\x10" + lengths + b"\x08\x00"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


_EMPTY_BLOCK = 0b10101111  # codes '10' '10' and padding


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of 64x64 that hold payload (a multiple of 64 bytes), one byte per coefficient in zigzag order."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks.reshape(-1, 64, 1), axis=2)
    coded = np.packbits(bits.reshape(len(blocks), -1), axis=1)
    stuffed = (coded == 0xFF).any(1) if (coded == 0xFF).any() else None
    per, frames = PER_FRAME // 64, []
    mark = np.empty((per, 2), np.uint8)
    mark[:, 0], mark[:, 1] = 0xFF, 0xD0 + np.arange(per) % 8
    for low in range(0, len(blocks), per):
        part = coded[low : low + per]
        if stuffed is not None and stuffed[low : low + per].any():
            data = b"".join(p.tobytes().replace(b"\xff", b"\xff\x00") + m.tobytes() for p, m in zip(part, mark, strict=False))
        else:
            data = np.hstack([part, mark[: len(part)]]).tobytes()
        rest = np.empty((per - len(part), 3), np.uint8)
        rest[:, 0], rest[:, 1:] = _EMPTY_BLOCK, mark[len(part) :]
        frames.append(_frame_head() + (data + rest.tobytes())[:-2] + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload_bytes: int, width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF AVI file of JPEG frames with an idx1 index; payload_bytes goes into an INFO comment."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % payload_bytes))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> dict:
    """fps, width, height, payload_bytes (or None) and the frames of the first video stream.

    Frames come from the idx1 index, with offsets from the movi list or the file's start; without a usable index the movi
    list is walked.  Anything that is no AVI file raises ValueError.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"fps": float(FPS), "width": 0, "height": 0, "payload_bytes": None, "frames": []}
    movi, index, stream, streams = None, b"", None, 0

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, stream, streams
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name in (b"LIST", b"RIFF"):
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, stop)
                else:
                    walk(body + 4, stop)
            elif name == b"avih" and size >= 40:
                out["width"], out["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh":
                if data[body : body + 4] == b"vids" and stream is None:
                    stream = streams
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    out["fps"] = rate / scale if scale and rate else out["fps"]
                streams += 1
            elif name == b"ICMT" and data[body : body + 14] == b"payload_bytes=":
                out["payload_bytes"] = int(data[body + 14 : stop].rstrip(b"\0"))
            elif name == b"idx1":
                index = data[body:stop]
            at = body + size + size % 2

    walk(12, len(data))
    if movi is None:
        return out
    wanted = (b"%02ddc" % (stream or 0), b"%02ddb" % (stream or 0))
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0] in wanted]
    for base in (movi[0], 0):
        if entries and all(data[base + e[2] : base + e[2] + 4] == e[0] for e in (entries[0], entries[-1])):
            out["frames"] = [data[base + e[2] + 8 : base + e[2] + 8 + e[3]] for e in entries]
            return out
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            at += 12
            continue
        if name in wanted:
            out["frames"].append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: length of the Huffman code they begin with, times 256, and its symbol; 0 where there is none."""
    if sum(lengths) != len(symbols):
        raise ValueError("bad Huffman table")
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for bits, n in enumerate(lengths, 1):
        if code + n > 1 << bits:
            raise ValueError("bad Huffman table")
        for _ in range(n):
            table[code << 16 - bits : code + 1 << 16 - bits] = bits << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Head:
    """What a baseline JPEG says before its entropy-coded data: tables, size, components."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.quant, self.huffman, self.restart, self.parts, at = {}, {}, 0, [], 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("bad marker")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("only 8-bit frames of known size are supported")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG is supported")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = _lookup(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        else:
            raise ValueError("no scan")
        if not self.parts or set(scan) != {p[0] for p in self.parts} or any(not (1 <= p[1] <= 4 and 1 <= p[2] <= 4) for p in self.parts):
            raise ValueError("only one scan of all components is supported")
        if any(len(self.quant.get(p[3], ())) != 64 for p in self.parts):
            raise ValueError("bad quantisation table")
        self.raw = bytes(data[:at])
        self.tables = [(self.huffman[scan[p[0]][0]], self.huffman[16 | scan[p[0]][1]]) for p in self.parts]
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:  # blocks in raster order, whatever the sampling factors are
            self.parts, h, v = [(self.parts[0][0], 1, 1, self.parts[0][3])], 1, 1
        self.wide, self.high = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.units = self.wide * self.high
        self.blocks = self.units * self.parts[0][1] * self.parts[0][2]


#: Bytes after a segment's end that reading may still touch.
_PAD = 8


def _segments(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all segments between restart markers, without stuffing; start and size of each; segments per scan)."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    after = np.r_[raw[1:], np.uint8(1)] if len(raw) else raw
    after[np.cumsum(sizes)[sizes > 0] - 1] = 1
    full = raw == 0xFF
    mark = full & (after >= 0xD0) & (after <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | (full & (after == 0))[:-1]
    scan = np.repeat(np.arange(len(scans)), sizes)
    segment = (scan + np.cumsum(mark))[~drop]
    count = np.bincount(scan, weights=mark, minlength=len(scans)).astype(np.int64) + 1
    size = np.bincount(segment, minlength=count.sum())
    out = np.full(len(segment) + _PAD * (len(size) + 1), 0xFF, np.uint8)
    out[np.arange(len(segment)) + _PAD * segment] = raw[~drop]
    return out, np.cumsum(size) - size + _PAD * np.arange(len(size)), size, count


def _decode_scans(head: _Head, scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(scans x blocks x 64 quantised coefficients of the first component in zigzag order; whether each scan is sound).

    Huffman codes are decoded by the frame's own tables, one code of every segment at a time: segments between restart
    markers, and frames, do not depend on each other.
    """
    data, start, size, count = _segments(scans)
    interval = head.restart or head.units
    sound = (count == -(-head.units // interval)) & (np.fromiter(map(len, scans), np.int64, len(scans)) * 4 >= head.units)
    frame = np.repeat(np.arange(len(scans)), count)
    unit = (np.arange(len(frame)) - np.repeat(np.cumsum(count) - count, count)) * interval
    use = sound[frame]
    frame, unit, at, stop = frame[use], unit[use], 8 * start[use], 8 * (start + size)[use]
    units = np.minimum(interval, head.units - unit)
    wide = data.astype(np.uint32)
    window = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    out = np.zeros(len(scans) * head.blocks * 64, np.int32)
    level = np.zeros((len(head.parts), len(frame)), np.int64)
    broken = np.zeros(len(frame), bool)

    def peek(at: np.ndarray) -> np.ndarray:
        return (window.take(at >> 3, mode="clip") >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.int64)

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = peek(at) >> (16 - size)
        return np.where(v >> np.maximum(size - 1, 0), v, v - (1 << size) + 1)

    for m in range(int(units.max(initial=0))):
        live = np.flatnonzero((units > m) & ~broken)
        for c, (_, h, v, _) in enumerate(head.parts):
            dc, ac = head.tables[c]
            for k in range(h * v):
                number = unit[live] + m
                block = (number // head.wide * v + k // h) * head.wide * h + number % head.wide * h + k % h
                to = (frame[live] * head.blocks + block) * 64
                code = dc[peek(at[live])].astype(np.int64)
                bits = code & 255
                broken[live] |= (code == 0) | (bits > 11)
                bits = np.minimum(bits, 11)
                level[c, live] += value(at[live] + (code >> 8), bits)
                at[live] += (code >> 8) + bits
                if not c:
                    out[to] = level[c, live]
                who, place, pos = live, np.ones(len(live), np.int64), at[live]
                while len(who):
                    code = ac[peek(pos)].astype(np.int64)
                    bits, run = code & 15, code >> 4 & 15
                    pos = pos + (code >> 8)
                    found = (bits > 0) & (place + run < 64)
                    place = place + run
                    if not c:
                        v_ = value(pos, bits)
                        if found.all():
                            out[to + place] = v_
                        else:
                            out[(to + place)[found]] = v_[found]
                    pos = pos + bits
                    place += 1
                    broken[who] |= (code == 0) | (place > 64)
                    on = ((bits > 0) | (run == 15)) & (code > 0) & (place < 64)
                    if not on.all():
                        at[who[~on]] = pos[~on]
                        who, place, pos, to = who[on], place[on], pos[on], to[on]
    broken |= at > stop
    sound[frame[broken]] = False
    return out.reshape(len(scans), head.blocks, 64), sound


#: Blocks decoded at once: a bound of memory, not of a file's size.
CHUNK = 1 << 17


def decode_frames(frames: list[bytes], width: int = 0, height: int = 0):
    """Yields (quantised coefficients, 8-bit luma) by block of each intra frame, or None for one that cannot be decoded.

    Frames with equal headers are decoded together.  width and height, if given, are what frames must measure.
    """
    heads: dict[bytes, _Head] = {}

    def head_of(frame: bytes) -> _Head | None:
        for raw, head in heads.items():
            if frame.startswith(raw):
                return head
        try:
            head = _Head(frame)
            if width and height and (head.width, head.height) != (width, height) or head.units > 4 * len(frame):
                return None  # a unit takes two bits at least
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            return None
        if len(heads) >= 8:
            heads.clear()
        heads[head.raw] = head
        return head

    low = 0
    while low < len(frames):
        head, high = head_of(frames[low]), low + 1
        if head is None:
            yield None
            low = high
            continue
        while high < len(frames) and (high - low) * head.blocks < CHUNK and head_of(frames[high]) is head:
            high += 1
        scans = []
        for f in frames[low:high]:
            end = f.rfind(b"\xff\xd9")
            scans.append(f[len(head.raw) : end if end >= len(head.raw) else len(f)])
        found, sound = _decode_scans(head, scans)
        luma = luma_blocks(found.reshape(-1, 64), head.quant[head.parts[0][3]]).reshape(found.shape)
        for c, y, good in zip(found, luma, sound, strict=True):
            yield (c, y) if good else None
        low = high


def _to_coefficients(payload: np.ndarray) -> np.ndarray:
    p = payload.astype(np.int64)
    return np.where(p >= 128, p, p - 255)


def _to_payload(coefficients: np.ndarray) -> np.ndarray:
    return np.where(coefficients > 0, coefficients, coefficients + 255).astype(np.uint8)


@lru_cache(1)
def _basis() -> np.ndarray:
    """64 x 64: a block's pixels (row-major) from its coefficients in zigzag order, in whole multiples of 1/2**20."""
    k = np.arange(8)
    d = np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", d, d).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << 20))


def luma_blocks(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit pixels (blocks x 64) from quantised coefficients.  All sums are whole numbers that a double holds exactly, so
    a block's pixels do not depend on what is multiplied with it."""
    values = (coefficients * quant).astype(np.float64) @ _basis()
    return np.clip(np.floor(values / (1 << 20) + 128.5), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[first, last) frames of each shot.

    A cut stands where the histogram difference (half the L1 distance of shares) is at least `least` and above the mean
    plus factor deviations of the up to window differences since the previous cut.
    """
    n = len(histograms)
    if not n:
        return []
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    change = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, start = [0], 0
    for i, d in enumerate(change):
        past = change[max(start, i - window) : i]
        limit = past.mean() + factor * past.std() if len(past) else least
        if d >= max(least, limit):
            cuts.append(i + 1)
            start = i + 1
    return list(zip(cuts, cuts[1:] + [n], strict=True))


def store(payload: bytes) -> bytes:
    """payload with zeros up to a positive multiple of 64, as an AVI file; read back by load."""
    size = max(64, -(-len(payload) // 64) * 64)
    return write_avi(encode_frames(payload.ljust(size, b"\0")), size)


def load_all(media: list[bytes]) -> list[tuple[bytes, list[np.ndarray], float]]:
    """(payload, luma histogram of 64 bins per frame, frames a second) of stored files; ValueError for any other file."""
    files = [read_avi(m) for m in media]
    decoded, out = decode_frames([f for x in files for f in x["frames"]], SIDE, SIDE), []
    for avi in files:
        left, parts, histograms = avi["payload_bytes"], [], []
        if left is None:
            raise ValueError("a file without the size of its payload")
        for found in islice(decoded, len(avi["frames"])):
            if found is None:
                raise ValueError("a frame cannot be decoded")
            c, luma = found
            used = min(left // 64, len(c))
            parts.append(_to_payload(c[:used]).tobytes())
            left -= 64 * used
            histograms.append(np.bincount(luma[: max(used, 1)].ravel() >> 2, minlength=64))
        if left:
            raise ValueError("frames are missing")
        out.append((b"".join(parts), histograms, avi["fps"]))
    return out


def load(media: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """load_all() of one file."""
    return load_all([media])[0]


CLIPS = "array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double>>"


def _clips_of(data: bytes | None) -> list[dict]:
    try:
        avi = read_avi(data or b"")
    except (ValueError, struct.error):
        return []
    histograms = []
    for found in decode_frames(avi["frames"], avi["width"], avi["height"]):
        if found is None:
            return []
        histograms.append(np.bincount(found[1].ravel() >> 2, minlength=64))
    return [dict(clip=i, first_frame=x, last_frame=y - 1, start_s=x / avi["fps"], end_s=y / avi["fps"]) for i, (x, y) in enumerate(shots(np.array(histograms)))]


def clips(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """One row per shot of each AVI file in a binary column: keep columns, clip, first_frame, last_frame, start_s, end_s.

    A null, a file that is no AVI, a frame that is broken, not baseline or not of the file's size gives no rows for its file.
    """

    def find(batches):
        for b in batches:
            rows = []
            for data in b.column(b.num_columns - 1).to_pylist():
                rows.append(_clips_of(data))
            kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], [*b.schema.names[:-1], "clips"])

    source = media.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("m"))
    kinds = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    found = source.mapInArrow(find, f"{kinds}{', ' if kinds else ''}clips {CLIPS}")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.explode("clips").alias("c")).select(*[F.col(f"`{c}`") for c in keep], "c.*")


DIGEST = [
    ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"),
    ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("n_clips", "int"),
]


def digest_texts(texts: list[str | None]) -> list[tuple]:
    out = []
    sha = lambda b: hashlib.sha256(b).hexdigest()
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.cumsum([len(r) for r in raws])
    for part in np.split(np.arange(len(raws)), np.flatnonzero(np.diff(sizes // 2_000_000)) + 1):
        media = [store(raws[i]) for i in part]
        for i, m, (payload, histograms, fps) in zip(part, media, load_all(media), strict=True):
            cut = shots(np.array(histograms))
            spans = ",".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in cut)
            feature = f"frames={len(histograms)};shots={len(cut)};hist={zlib.crc32(np.concatenate(histograms).tobytes()):08x};clips={spans}"
            out.append((len(raws[i]), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(m), sha(m), feature, len(cut)))
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as an AVI file, read back, and described; null texts are empty ones.  One pass, no shuffle.

    Repeated rows get repeated results, an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}

    def make():
        def work(texts):
            rows = digest_texts(texts)
            return [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(DIGEST)]

        return work

    return annotate(docs, "text", ["doc_id"], DIGEST, make)
