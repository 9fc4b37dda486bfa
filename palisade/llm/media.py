"""AVI motion-JPEG columns: write, parse and decode intra frames, and cut them into timed shots.

A frame is a 24 x 24 grey baseline JPEG of nine 8 x 8 blocks. JPEG samples pass through a cosine transform and
are not lossless, so payload bytes are stored as the format's unit, the quantised coefficients: byte b is
the coefficient b if b >= 128 else b - 255, which is exactly the set of values of size category 8.
The Huffman tables have one code each (0 -> category 8, no run), and every block follows a restart
marker, so a block is 64 codes of 1 + 8 bits: 72 bytes before byte stuffing.

Reading takes nothing of this for granted: the frame's own tables are parsed, blocks are entropy-decoded by
them, dequantised and transformed back to samples, and shots are found in the samples. Tables of one code are decoded
by whole arrays, any other baseline frame code by code.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import frugal, lean, text_slices

SIDE, BLOCK = 24, 64
FRAME_BYTES = SIDE * SIDE
BLOCKS = FRAME_BYTES // BLOCK
CODED = 72
FRAMES_PER_SECOND = 25
HISTOGRAM_BINS = 16
#: Blocks that one vectorised step holds.
STEP = 16_384
#: Diagonals of a block from the mean on, up and down in turn: (row, column) of each coefficient as stored.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int) -> bytes:
    # Class and id, counts of codes of length 1 to 16, the symbol: run 0, category 8.
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, 8]))


FRAME_HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _one_code(0x00) + _one_code(0x10) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
FRAME_TAIL = b"\xff\xd9"


def encode_blocks(samples: np.ndarray) -> np.ndarray:
    """(blocks, 64) bytes -> (blocks, 72) bytes of entropy code, before stuffing."""
    out = np.empty((len(samples), CODED), np.uint8)
    for first in range(0, len(samples), STEP):
        own = samples[first : first + STEP]
        bits = np.zeros((len(own), BLOCK, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(own, axis=1).reshape(len(own), BLOCK, 8)
        out[first : first + STEP] = np.packbits(bits.reshape(len(own), -1), axis=1)
    return out


def write_frames(payload: bytes) -> list[bytes]:
    """JPEG files of a payload whose length is a multiple of 576."""
    rows = encode_blocks(np.frombuffer(payload, np.uint8).reshape(-1, BLOCK))
    flat, frames = rows.tobytes(), []
    for first in range(0, len(rows), BLOCKS):
        parts = [FRAME_HEAD]
        for turn in range(BLOCKS):
            at = (first + turn) * CODED
            if turn:
                parts.append(bytes((0xFF, 0xD0 + (turn - 1) % 8)))
            parts.append(flat[at : at + CODED].replace(b"\xff", b"\xff\0"))
        parts.append(FRAME_TAIL)
        frames.append(b"".join(parts))
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], fps: int = FRAMES_PER_SECOND) -> bytes:
    """A RIFF AVI file with one MJPG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME_BYTES, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    body, index, at = [b"movi"], [], 4
    for frame in frames:
        body.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + lists + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames by the index, and frames per second. ValueError where the file is not an AVI of MJPG frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    movi, index, rate = -1, b"", 0.0
    at, ends = 12, len(data)
    while at + 8 <= ends:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind in (b"hdrl", b"strl"):
            at += 12
            continue
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"avih":
            rate = 1e6 / struct.unpack_from("<I", data, at + 8)[0]
        elif name == b"strh" and data[at + 12 : at + 16] != b"MJPG":
            raise ValueError("not a motion-JPEG stream")
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi < 0:
        raise ValueError("no movi list")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        start = movi + offset + 8
        if data[movi + offset : movi + offset + 4] != name or start + size > ends:
            raise ValueError("the index does not fit the frames")
        frames.append(data[start : start + size])
    return frames, rate


class Component(NamedTuple):
    """A colour component: blocks across and down in a unit, its quantisation and its two Huffman tables."""

    across: int
    down: int
    steps: tuple[int, ...]
    first: dict
    rest: dict


class Head(NamedTuple):
    """What the segments before a frame's scan say; tables are {(length, code): symbol}."""

    width: int
    height: int
    restart: int
    components: tuple[Component, ...]


@lru_cache(maxsize=64)
def parse_head(data: bytes) -> Head:
    """The segments from the first marker to the scan's, tables included. ValueError for what is no baseline frame."""
    steps: dict[int, tuple[int, ...]] = {}
    codes: dict[int, dict] = {}
    restart, shape, parts, at = 0, None, {}, 2
    while at + 4 <= len(data):
        mark, marker, size = struct.unpack_from(">BBH", data, at)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark != 0xFF or len(body) != size - 2:
            raise ValueError("a broken segment")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                table, code, place = {}, 0, 17
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code *= 2
                codes[body[0]] = table
                body = body[place:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            precision, height, width, count = struct.unpack_from(">BHHB", body)
            if precision != 8 or not height or not width:
                raise ValueError("samples of a kind that baseline frames have not")
            shape = (width, height)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if shape is None or body[0] != len(parts) or body[-3:] != b"\0\x3f\0":
                raise ValueError("a scan that is not the whole of a baseline frame")
            try:
                found = []
                for i in range(body[0]):
                    across, down, table = parts[body[1 + 2 * i]]
                    kinds = body[2 + 2 * i]
                    found.append(Component(across, down, steps[table], codes[kinds >> 4], codes[0x10 | kinds & 15]))
            except KeyError:
                raise ValueError("a table that the frame lacks") from None
            return Head(*shape, restart, tuple(found))
    raise ValueError("a frame without a scan")


def split_frame(frame: bytes) -> tuple[Head, bytes]:
    """The parsed head and the entropy-coded bytes, markers and stuffing still in them."""
    if frame[:2] != b"\xff\xd8" or frame[-2:] != FRAME_TAIL:
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return parse_head(frame[:at]), frame[at:-2]
    raise ValueError("a frame without a scan")


def _one_code_size(head: Head) -> int | None:
    """The category where both tables of a grey frame have one code, of one bit and without a run, and blocks stand alone; else None."""
    if len(head.components) == 1 and head.restart == 1 and not (head.width % 8 or head.height % 8):
        own = head.components[0]
        if own.first == own.rest and list(own.first) == [(1, 0)] and own.first[1, 0] == 8:
            return 8
    return None


def _restarts(coded: bytes) -> bytes:
    """Without restart markers and stuffing, where markers follow each other in order."""
    parts, at, turn = [], 0, 0
    while (mark := coded.find(bytes((0xFF, 0xD0 + turn % 8)), at)) >= 0:
        parts.append(coded[at:mark])
        at, turn = mark + 2, turn + 1
    return b"".join([*parts, coded[at:]]).replace(b"\xff\0", b"\xff")


def decode_blocks(coded: np.ndarray) -> np.ndarray:
    """(blocks, 72) bytes of one-code tables -> (blocks, 64) coefficients; ValueError where a code is not in the tables."""
    out = np.empty((len(coded), BLOCK), np.int16)
    for first in range(0, len(coded), STEP):
        own = coded[first : first + STEP]
        bits = np.unpackbits(own, axis=1).reshape(len(own), BLOCK, 9)
        if bits[:, :, 0].any():
            raise ValueError("a Huffman code that the frame's tables lack")
        values = np.packbits(bits[:, :, 1:].reshape(len(own), -1), axis=1).astype(np.int16)
        out[first : first + STEP] = np.where(values < 128, values - 255, values)
    return out


class _Bits:
    """Bits of one restart interval, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("a frame holds too little data")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a Huffman code that the frame's tables lack")

    def number(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, own: Component, before: int) -> list[int]:
    out = [0] * BLOCK
    out[0] = before + bits.number(bits.symbol(own.first))
    at = 1
    while at < BLOCK:
        run, size = divmod(bits.symbol(own.rest), 16)
        if not size and run < 15:
            break
        at += run
        if at >= BLOCK:
            raise ValueError("a block of more than 64 coefficients")
        out[at] = bits.number(size)
        at += 1
    return out


def decode_any(head: Head, coded: bytes) -> np.ndarray:
    """Coefficients of the first component's blocks, row by row, of any baseline frame, code by code."""
    many = len(head.components) > 1
    most_across, most_down = (max(c.across for c in head.components), max(c.down for c in head.components)) if many else (1, 1)
    units_across = -(-head.width // (8 * most_across))
    units = units_across * -(-head.height // (8 * most_down))
    every = head.restart or units
    parts, at = [], 0
    for turn in range(-(-units // every) - 1):
        mark = coded.find(bytes((0xFF, 0xD0 + turn % 8)), at)
        if mark < 0:
            raise ValueError("a restart marker is missing")
        parts.append(coded[at:mark])
        at = mark + 2
    own = head.components[0]
    across, down = (own.across, own.down) if many else (1, 1)
    out = np.zeros((units // units_across * down, units_across * across, BLOCK), np.int64)
    for turn, part in enumerate([*parts, coded[at:]]):
        bits, before = _Bits(part.replace(b"\xff\0", b"\xff")), [0] * len(head.components)
        for unit in range(turn * every, min(units, (turn + 1) * every)):
            row, column = divmod(unit, units_across)
            for which, component in enumerate(head.components):
                for place in range(component.across * component.down if many else 1):
                    block = _block(bits, component, before[which])
                    before[which] = block[0]
                    if which == 0:
                        y, x = divmod(place, across)
                        out[row * down + y, column * across + x] = block
    return out[: -(-head.height // 8), : -(-head.width // 8)].reshape(-1, BLOCK)


@lru_cache(maxsize=1)
def _waves() -> np.ndarray:
    """(coefficient as stored, sample): the inverse cosine transform of a block as one matrix."""
    x = np.arange(8)
    wave = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.stack([np.outer(wave[r], wave[c]).ravel() for r, c in ZIGZAG]).astype(np.float32)


def samples_of(coefficients: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """(blocks, 64) samples 0 to 255: dequantised, transformed back, shifted and clipped."""
    out, scaled = np.empty(coefficients.shape, np.uint8), _waves() * np.array(steps, np.float32)[:, None]
    for first in range(0, len(coefficients), STEP):
        levels = coefficients[first : first + STEP].astype(np.float32) @ scaled
        out[first : first + STEP] = np.clip(np.rint(levels + 128), 0, 255)
    return out


def pictures(blocks: np.ndarray, width: int, height: int) -> np.ndarray:
    """(frames, height, width) of the samples of their blocks, row by row."""
    across, down = -(-width // 8), -(-height // 8)
    whole = blocks.reshape(-1, down, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * down, 8 * across)
    return whole[:, :height, :width]


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all blocks, first component; samples as frames, height, width). Each frame decodes alone.

    All frames have one size. ValueError where a frame is no whole baseline JPEG.
    """
    if not frames:
        return np.zeros((0, BLOCK), np.int16), np.zeros((0, 0, 0), np.uint8)
    split = [split_frame(f) for f in frames]
    head = split[0][0]
    if any((h.width, h.height) != (head.width, head.height) for h, _ in split):
        raise ValueError("frames of several sizes")
    if all(h == head for h, _ in split) and _one_code_size(head):
        coded = b"".join(_restarts(c) for _, c in split)
        if len(coded) != len(frames) * head.width * head.height // BLOCK * CODED:
            raise ValueError("a frame holds too little or too much data")
        found = decode_blocks(np.frombuffer(coded, np.uint8).reshape(-1, CODED))
        return found, pictures(samples_of(found, head.components[0].steps), head.width, head.height)
    found = [decode_any(h, c) for h, c in split]
    shown = [samples_of(c, h.components[0].steps) for c, (h, _) in zip(found, split, strict=True)]
    return np.concatenate(found), pictures(np.concatenate(shown), head.width, head.height)


def payload_from(coefficients: np.ndarray) -> bytes:
    """The bytes that write_frames stored; ValueError for coefficients of other files."""
    if ((coefficients > -128) & (coefficients < 128)).any() or (np.abs(coefficients) > 255).any():
        raise ValueError("coefficients that are not bytes")
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def find_shots(frames: np.ndarray, window: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """(first frame, last frame + 1) of each shot of frames of samples.

    A cut stands where the histogram difference (half the L1 distance, 0 to 1) is over `least` and over mean
    plus `factor` standard deviations of the `window` differences before it in the same shot.
    """
    n, size = len(frames), int(np.prod(frames.shape[1:]))
    if not n:
        return []
    counts = np.empty((n, HISTOGRAM_BINS), np.int64)
    for first in range(0, n, 1024):
        own = frames[first : first + 1024].reshape(-1, size) // (256 // HISTOGRAM_BINS)
        cells = own.astype(np.int64) + np.arange(len(own))[:, None] * HISTOGRAM_BINS
        counts[first : first + 1024] = np.bincount(cells.ravel(), minlength=len(own) * HISTOGRAM_BINS).reshape(-1, HISTOGRAM_BINS)
    steps = np.abs(np.diff(counts, axis=0)).sum(1) / (2 * size)
    cuts, begin = [0], 0
    for at in np.flatnonzero(steps > least):
        past = steps[max(begin, at - window) : at]
        if not len(past) or steps[at] > past.mean() + factor * past.std():
            cuts.append(int(at) + 1)
            begin = int(at) + 1
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def payload_of(text: bytes) -> bytes:
    """The text, filled with bytes 255 up to a positive multiple of the frame size."""
    whole = max(1, -(-len(text) // FRAME_BYTES)) * FRAME_BYTES
    return text.ljust(whole, b"\xff")


CLIP = pa.struct([("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
MEDIA_SCHEMA = "media binary, payload binary, clips array<struct<start_frame:int,end_frame:int,start_ms:bigint,end_ms:bigint>>"


def _clips(frames: np.ndarray, rate: float) -> list[dict]:
    return [{"start_frame": a, "end_frame": b, "start_ms": round(1000 * a / rate), "end_ms": round(1000 * b / rate)} for a, b in find_shots(frames)]


def file_clips(files: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `clips` and `error` of a column of AVI motion-JPEG files, whoever wrote them.

    Shots are found in the first component (the brightness). Null and broken files, files of other
    kinds and frames that are not baseline have no clips and an error. Repeated rows stay. Names of other columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips, errors = [], []
            for data in batch.column(len(keep)):
                try:
                    frames, rate = read_avi(data.as_py() or b"")
                    clips.append(_clips(decode_frames(frames)[1], rate))
                    errors.append(None)
                except (ValueError, IndexError, struct.error, ZeroDivisionError) as wrong:
                    clips.append([])
                    errors.append(str(wrong))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(clips, pa.list_(CLIP)), pa.array(errors, pa.string())], [*keep, "clips", "error"])

    source = lean(files).select(*keep, F.col(column).cast("binary").alias("_file"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, clips array<struct<start_frame:int,end_frame:int,start_ms:bigint,end_ms:bigint>>, error string")


def media_columns(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `n_bytes`, `media` (AVI file of the text's bytes), `payload` (read back from it), `clips`.

    Null and empty texts make one frame of bytes 255. Each row stands for itself, so repeated rows and ties
    give equal values. Names of other columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_slices(batch.column(len(keep))):
                sizes, files, payloads, clips = [], [], [], []
                for text in texts:
                    data = text.encode()
                    sizes.append(len(data))
                    files.append(write_avi(write_frames(payload_of(data))))
                    frames, rate = read_avi(files[-1])
                    coefficients, shown = decode_frames(frames)
                    payloads.append(payload_from(coefficients))
                    clips.append(_clips(shown, rate))
                columns = [batch.column(i).slice(first, last - first) for i in range(len(keep))]
                columns += [pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(CLIP))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_bytes", "media", "payload", "clips"])

    source = lean(docs).select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, n_bytes long, {MEDIA_SCHEMA}")


def clip_rows(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per timed clip: the kept columns, clip number, frames and milliseconds."""
    return media.select(*keep, F.posexplode("clips").alias("clip", "_c")).select(*keep, "clip", "_c.*")
