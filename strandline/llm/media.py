"""Media columns: AVI files of motion JPEG, written, indexed, decoded and cut into shots.

Frames are JPEG images that stand alone. The writer uses JPEG's lossless process
(SOF3, 8-bit samples, predictor 1) with a Huffman table in which a difference of
category k has a code of 9 - k bits: code and extra bits are 9 bits for every
sample, so whole files are coded and decoded with array operations. The reader
takes any Huffman table, lossless frames with one component, and baseline frames
(SOF0, SOF1) in grey or colour with any subsampling and restart intervals.

A shot ends where the histograms of neighbouring frames differ by more than an
adaptive threshold, which follows the differences around it.
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
from pyspark.sql import types as T

from .common import map_batches
from .tokenise import groups as slices

WIDTH, HEIGHT = 64, 32
MS_A_FRAME = 40
#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Shots: bins of a histogram, frames on either side that set the threshold, deviations above their mean, least difference.
BINS, AROUND, DEVIATIONS, LEAST = 32, 8, 3.0, 0.15


# ---- JPEG, lossless process ----


def _nine_bit() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255 its 9 bits; by 9 bits the difference."""
    code, diff = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = (1 << (9 - k)) - 2  # 8 - k ones, then a zero
        bits = (prefix << k) | (d if d >= 0 else d + (1 << k) - 1)
        code[d + 255] = bits
        diff[bits] = d
    return code, diff


CODE, DIFF = _nine_bit()
#: Table 0: one code of each length 1 to 9, for categories 8 down to 0.
DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def jpeg_head(width: int, height: int) -> bytes:
    frame = struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    scan = struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)
    return b"\xff\xd8" + DHT + b"\xff\xc3" + frame + b"\xff\xda" + scan


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of uint8 frames (n, height, width); height * width is a multiple of 8."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = CODE[d + 255].reshape(n, -1, 8)
    out = np.zeros((n, v.shape[1], 9), np.uint8)
    for k in range(9):
        byte = v[:, :, k] >> (k + 1) if k < 8 else 0
        if k:
            byte = byte | ((v[:, :, k - 1] << (8 - k)) & 0xFF)
        out[:, :, k] = byte
    head = jpeg_head(width, height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in out.reshape(n, -1)]


# ---- JPEG, reading ----


class Huffman:
    """Codes by (length, code), as a table over 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lengths = [n for n in range(1, 17) for _ in range(counts[n - 1])]
        self.symbols = list(symbols)
        self.value, self.size = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code, last = 0, 0
        for n, s in zip(self.lengths, symbols):
            code <<= n - last
            last = n
            a, b = code << (16 - n), (code + 1) << (16 - n)
            self.value[a:b], self.size[a:b] = s, n
            code += 1

    def fixed(self) -> bool:
        """Whether it is the table that the writer uses."""
        return self.symbols == list(range(8, -1, -1)) and self.lengths == list(range(1, 10))


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.n = int.from_bytes(data + b"\xff" * 4, "big"), 0, (len(data) + 4) * 8

    def peek16(self) -> int:
        return (self.data >> (self.n - self.at - 16)) & 0xFFFF if self.n - self.at >= 16 else 0xFFFF

    def take(self, k: int) -> int:
        if self.at + k > self.n:
            raise ValueError("the entropy-coded data ends early")
        self.at += k
        return (self.data >> (self.n - self.at)) & ((1 << k) - 1)

    def symbol(self, table: Huffman) -> int:
        p = self.peek16()
        k = int(table.size[p])
        if not k:
            raise ValueError("no such Huffman code")
        self.at += k
        return int(table.value[p])

    def signed(self, k: int) -> int:
        if not k:
            return 0
        v = self.take(k)
        return v if v >> (k - 1) else v - (1 << k) + 1


def zigzag() -> list[int]:
    """Position in a block of each coefficient as coded: by diagonals, alternately up and down."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [y * 8 + x for y, x in cells]


ZIGZAG = zigzag()
_C = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def parse(data: bytes) -> dict:
    """The segments of a JPEG image: frame, scan, tables, and entropy-coded data by restart interval."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0}
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                out["huffman"][body[k]] = Huffman(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = struct.unpack_from(">64H", body, k + 1) if wide else tuple(body[k + 1 : k + 65])
                out["quant"][body[k] & 15] = values
                k += 129 if wide else 65
        elif marker in (0xC0, 0xC1, 0xC3):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of 8 bits only")
            out |= {"process": marker, "height": height, "width": width, "components": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} isn't read")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            out["predictor"] = body[1 + 2 * body[0]]
            end = at
            while True:  # up to a marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the image doesn't end")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            coded, parts, k = data[at:end], [], 0
            if out["restart"]:
                begin = 0
                while (k := coded.find(b"\xff", k)) >= 0:
                    if coded[k + 1]:
                        parts.append(coded[begin:k])
                        begin = k + 2
                    k += 2
                coded = coded[begin:]
            out["coded"] = [p.replace(b"\xff\x00", b"\xff") for p in (*parts, coded)]
            at = end
    if "coded" not in out or "process" not in out:
        raise ValueError("the image has no frame or scan")
    return out


def unpack_lossless(coded: np.ndarray, height: int, width: int) -> np.ndarray:
    """Frames (n, height, width) from rows of 9-bit codes."""
    n = len(coded)
    b = coded.reshape(n, -1, 9).astype(np.uint16)
    v = np.empty((n, b.shape[1], 8), np.uint16)
    for k in range(8):
        v[:, :, k] = ((b[:, :, k] << (k + 1)) | (b[:, :, k + 1] >> (7 - k))) & 0x1FF
    d = DIFF[v].reshape(n, height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFFFF).astype(np.uint8)


def decode_lossless(image: dict) -> np.ndarray:
    """By any table and predictor; one component."""
    (ident, *_), (height, width) = image["components"][0], (image["height"], image["width"])
    if len(image["components"]) != 1:
        raise ValueError("lossless frames of one component only")
    table = image["huffman"][image["scan"][ident] >> 4]
    if table.fixed() and image["predictor"] == 1 and not image["restart"] and height * width % 8 == 0:
        return unpack_lossless(np.frombuffer(image["coded"][0][: height * width * 9 // 8], np.uint8)[None], height, width)[0]
    out = np.zeros((height, width), np.int64)
    every, parts, bits = image["restart"] or height * width, iter(image["coded"]), None
    fresh = 0
    for i in range(height * width):
        y, x = divmod(i, width)
        if i % every == 0:
            bits, fresh = Bits(next(parts)), y
        if y == fresh:
            pred = 128 if x == 0 else int(out[y, x - 1])
        elif x == 0:
            pred = int(out[y - 1, 0])
        else:
            a, b, c = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
            pred = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[image["predictor"]]
        k = bits.symbol(table)
        out[y, x] = (pred + (32768 if k == 16 else bits.signed(k))) & 0xFFFF
    return out.astype(np.uint8)


def decode_baseline(image: dict) -> np.ndarray:
    """The first component's samples (luma, or grey): all that histograms need."""
    comps = image["components"]
    high_h, high_v = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        comps, high_h, high_v = [(comps[0][0], 1, 1, comps[0][3])], 1, 1
    across, down = -(-image["width"] // (8 * high_h)), -(-image["height"] // (8 * high_v))
    first = comps[0]
    blocks = np.zeros((down * first[2], across * first[1], 64))
    every, parts = image["restart"] or across * down, iter(image["coded"])
    bits, dc = None, {}
    for m in range(across * down):
        if m % every == 0:
            bits, dc = Bits(next(parts)), {c[0]: 0 for c in comps}
        for ident, h, v, _ in comps:
            dct, act = image["huffman"][image["scan"][ident] >> 4], image["huffman"][0x10 | (image["scan"][ident] & 15)]
            for by in range(v):
                for bx in range(h):
                    block = [0] * 64
                    dc[ident] += bits.signed(bits.symbol(dct))
                    block[0], k = dc[ident], 1
                    while k < 64:
                        rs = bits.symbol(act)
                        if rs == 0:
                            break
                        k += rs >> 4
                        if rs & 15:
                            if k > 63:
                                raise ValueError("too many coefficients in a block")
                            block[k] = bits.signed(rs & 15)
                        k += 1
                    if ident == first[0]:
                        blocks[m // across * v + by, m % across * h + bx, ZIGZAG] = block
    quant = np.zeros(64)
    quant[ZIGZAG] = image["quant"][first[3]]
    coefficients = (blocks * quant).reshape(*blocks.shape[:2], 8, 8)
    pixels = np.clip(np.rint(np.einsum("ux,abuv,vy->abxy", _C, coefficients, _C) + 128), 0, 255).astype(np.uint8)
    plane = pixels.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    height, width = -(-image["height"] * first[2] // high_v), -(-image["width"] * first[1] // high_h)
    return plane[:height, :width]


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """Samples of each image; images by the writer of this module are decoded together."""
    head = jpeg_head(WIDTH, HEIGHT)
    size = WIDTH * HEIGHT * 9 // 8
    coded = [x[len(head) : -2].replace(b"\xff\x00", b"\xff") if x.startswith(head) and x.endswith(b"\xff\xd9") else b"" for x in images]
    if images and all(len(x) == size for x in coded):
        return list(unpack_lossless(np.frombuffer(b"".join(coded), np.uint8).reshape(len(images), size), HEIGHT, WIDTH))
    out = []
    for x in images:
        image = parse(x)
        out.append(decode_lossless(image) if image["process"] == 0xC3 else decode_baseline(image))
    return out


# ---- AVI ----


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(images: list[bytes], width: int, height: int, ms: int = MS_A_FRAME, note: bytes = b"") -> bytes:
    """A RIFF file with one MJPG stream, an index, and a note in its INFO list."""
    most = max(map(len, images), default=0)
    avih = struct.pack("<14I", ms * 1000, most * 1000 // ms, 0, 0x10, len(images), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, ms, 1000, 0, len(images), most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", note))
    movi, index, at = [], [], 4
    for x in images:
        movi.append(chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of each chunk's body."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> dict:
    """ms a frame, note, and the images in the index's order, or in the file's without an index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"ms": MS_A_FRAME, "note": b"", "images": []}
    movi, index = None, None
    for name, a, b in chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            for n, x, _ in chunks(data, a + 4, b):
                if n == b"avih":
                    out["ms"] = struct.unpack_from("<I", data, x)[0] / 1000
        elif kind == b"INFO":
            out["note"] = next((data[x:y] for n, x, y in chunks(data, a + 4, b) if n == b"ICMT"), b"")
        elif kind == b"movi":
            movi = a
            end = b
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("the file has no movi list")
    if index is None:
        spans = [(x, y) for n, x, y in chunks(data, movi + 4, end) if n[2:] in (b"dc", b"db")]
    else:
        video = [(at, size) for n, _, at, size in index if n[2:] in (b"dc", b"db")]
        base = movi if video and data[movi + video[0][0] + 2 : movi + video[0][0] + 4] in (b"dc", b"db") else 0  # offsets are from movi, or from the file's start
        spans = [(base + at + 8, base + at + 8 + size) for at, size in video]
    out["images"] = [data[x:y] for x, y in spans if y > x]
    return out


# ---- shots ----


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last) frame of each shot."""
    if not frames:
        return []
    if len({f.shape for f in frames}) == 1:
        flat = np.stack(frames).reshape(len(frames), -1) >> 3
        hist = np.bincount((flat + (np.arange(len(frames)) * BINS)[:, None]).ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / flat.shape[1]
    else:
        hist = np.stack([np.bincount(f.ravel() >> 3, minlength=BINS) / f.size for f in frames])
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = []
    for i in np.flatnonzero(d >= LEAST):
        near = np.delete(d[max(0, i - AROUND) : i + AROUND + 1], min(i, AROUND))
        if not len(near) or d[i] > near.mean() + DEVIATIONS * near.std():
            cuts.append(int(i) + 1)
    return [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, len(frames)])]


# ---- columns ----


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and that padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def to_media(data: bytes) -> bytes:
    """An AVI file that holds the bytes as samples; the last frame is filled up with zeros."""
    size = WIDTH * HEIGHT
    frames = np.frombuffer(data + b"\0" * (-len(data) % size), np.uint8).reshape(-1, HEIGHT, WIDTH)
    return write_avi(encode_frames(frames), WIDTH, HEIGHT, note=b"payload=%d" % len(data))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as an AVI file. Null counts as empty; repeated rows are stored each."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            # Batches are bounded by characters, not by rows: very long texts go out one by one.
            for part in slices(texts):
                got = [payload(x) for x in texts[part]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array([n for n, _ in got], pa.int64()), pa.array([to_media(p) for _, p in got], pa.binary())], out.names)

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, out)


CLIP = "first_frame int, last_frame int, start_ms double, end_ms double"


def describe(media: DataFrame) -> DataFrame:
    """Per file of `store`: the payload read back, its checksums, the file's, and its clips.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (a line of the clips), clips (array of CLIP structs).
    """
    clip = T.StructType([T.StructField("first_frame", T.IntegerType()), T.StructField("last_frame", T.IntegerType()), T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType())])
    names = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    out = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *[T.StructField(n, t) for n, t in names], T.StructField("clips", T.ArrayType(clip))])
    arrow = pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())])

    def row(data: bytes) -> tuple:
        avi = read_avi(data)
        frames = decode_frames(avi["images"])
        back = b"".join(f.tobytes() for f in frames)[: int(avi["note"].removeprefix(b"payload="))]
        cut = shots(frames)
        clips = [{"first_frame": a, "last_frame": b, "start_ms": a * avi["ms"], "end_ms": (b + 1) * avi["ms"]} for a, b in cut]
        feature = f"frames={len(frames)};clips=" + ",".join(f"{a}-{b}" for a, b in cut)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(arrow))
        for batch in batches:
            got = [row(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)]], out.names)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, out)


def clips(described: DataFrame) -> DataFrame:
    """A row for each timed clip."""
    return described.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
