"""Media columns: JPEG, baseline and progressive, to full-resolution RGB tensors.

The scans of a progressive file come band by band (spectral selection) and bit by bit (successive approximation); all of
them add to one array of coefficients for each component. At the end the blocks are dequantised and inverse-transformed as matrix products, chroma is
repeated up to full size, and YCbCr becomes RGB. The encoder makes progressive files for tests and tables that have no pictures.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hecespark.runtime import bind

ZIGZAG = np.array([8 * i + j for s in range(15) for i, j in sorted(((a, s - a) for a in range(8) if 0 <= s - a < 8), reverse=s % 2 == 0)])
#: Pixels of a picture, at most: a larger one is ``unsupported``, as its tensor alone would take 3 bytes a pixel of one task's memory.
MAX_PIXELS = 1 << 27
#: Blocks that are transformed together, so that wide temporaries stay small.
STRIP = 1 << 13
_basis = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


class Unsupported(Exception):
    pass


class Corrupt(Exception):
    pass


@lru_cache(256)
def code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next: length << 8 | symbol of the code they begin with; 0: none."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            begin = code << (16 - length)
            if begin >= 1 << 16:
                raise Corrupt("too many codes")
            out[begin : begin + (1 << (16 - length))] = length << 8 | s
            code += 1
        at += n
        code <<= 1
    return out.tolist()


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table
        self.quantisation = None
        self.coefficients: array | None = None  # from the first scan on


class Decoder:
    def __init__(self, data: bytes):
        self.data = data
        self.tables: dict[tuple[int, int], list[int]] = {}
        self.quantisation: dict[int, np.ndarray] = {}
        self.components: list[Component] = []
        self.restart = 0
        self.adobe: int | None = None
        self.truncated = False
        self.progressive = False

    def run(self) -> tuple[np.ndarray, str]:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise Corrupt("no start of image")
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                self.truncated = True
                break
            marker = data[at + 1]
            at += 1 if marker == 0xFF else 2
            if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD7:
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > len(data):
                self.truncated = True
                break
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                self.define_quantisation(body)
            elif marker == 0xC4:
                self.define_codes(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self.frame(body, marker == 0xC2)
            elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
                raise Unsupported(f"SOF {marker:x}")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self.scan(body, at)
        if not self.components:
            raise Corrupt("no frame")
        return self.picture(), "truncated" if self.truncated else "ok"

    def define_quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            values = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8)
            if len(values) != 64:
                raise Corrupt("short quantisation table")
            self.quantisation[number] = values.astype(np.int64)
            at += 1 + n

    def define_codes(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at] >> 4, body[at] & 15] = code_table(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def frame(self, body: bytes, progressive: bool) -> None:
        if self.components:
            raise Corrupt("two frames")
        if len(body) < 6 or len(body) < 6 + 3 * body[5]:
            raise Corrupt("short frame header")
        if body[0] != 8:
            raise Unsupported(f"{body[0]} bits")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        n = body[5]
        if n not in (1, 3):
            raise Unsupported(f"{n} components")
        if not self.height or not self.width:
            raise Unsupported("size to be defined later")
        if self.height * self.width > MAX_PIXELS:
            raise Unsupported("too many pixels")
        self.progressive = progressive
        made = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in made):
            raise Corrupt("sampling factors")
        self.hmax, self.vmax = max(c.h for c in made), max(c.v for c in made)
        self.mcu_x, self.mcu_y = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in made:
            c.wide, c.high = self.mcu_x * c.h, self.mcu_y * c.v  # blocks, with those that only fill up MCUs
            c.own_wide = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.own_high = -(-(-(-self.height * c.v // self.vmax)) // 8)
        # a scan has a bit at least for each block that it codes first, so that a header can't ask for more than the file may hold
        if sum(c.wide * c.high for c in made) > 8 * len(self.data):
            raise Corrupt("more blocks than bits")
        self.components = made

    def scan(self, body: bytes, at: int) -> int:
        data = self.data
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                self.truncated = True
                break
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        if not self.components:
            raise Corrupt("scan before frame")
        n = body[0] if body else 0
        if len(body) < 4 + 2 * n or not 1 <= n <= 3:
            raise Corrupt("short scan header")
        chosen = []
        for i in range(n):
            found = [c for c in self.components if c.number == body[1 + 2 * i]]
            if not found:
                raise Corrupt("unknown component")
            chosen.append((found[0], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
            if found[0] in [c for c, _, _ in chosen[:-1]]:
                raise Corrupt("a component twice")
            found[0].quantisation = self.quantisation.get(found[0].table, found[0].quantisation)
            if found[0].coefficients is None:
                found[0].coefficients = array("h", bytes(128 * found[0].wide * found[0].high))
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if first > last or last > 63 or (self.progressive and first and n > 1):
            raise Corrupt("spectral band")
        if n == 1:
            c = chosen[0][0]
            total = c.own_high * c.own_wide
            unit = lambda k: ((0, c.wide * (k // c.own_wide) + k % c.own_wide),)
        else:
            total = self.mcu_y * self.mcu_x
            places = [(i, c.wide, c.v, v, c.h, h) for i, (c, _, _) in enumerate(chosen) for v in range(c.v) for h in range(c.h)]
            unit = lambda k: [(i, wide * (k // self.mcu_x * cv + v) + k % self.mcu_x * ch + h) for i, wide, cv, v, ch, h in places]
        raw = data[at:end]
        parts = [raw]
        if self.restart:
            parts, begin, k = [], 0, raw.find(b"\xff")
            while k >= 0:
                if k + 1 < len(raw) and 0xD0 <= raw[k + 1] <= 0xD7:
                    parts.append(raw[begin:k])
                    begin = k + 2
                k = raw.find(b"\xff", k + 2)
            parts.append(raw[begin:])
        step = self.restart or total
        for part, k in zip(parts, range(0, total, step)):
            try:
                self.decode_part(part.replace(b"\xff\x00", b"\xff"), map(unit, range(k, min(total, k + step))), chosen, first, last, high, low)
            except IndexError:
                self.truncated = True
        if len(parts) * step < total:
            self.truncated = True
        return end

    def decode_part(self, raw: bytes, units: Iterable, chosen: list, first: int, last: int, high: int, low: int) -> None:
        """The units of one restart interval. The bits are read from 32-bit windows that start at each byte; beyond the end is an IndexError."""
        b = np.frombuffer(raw + b"\0\0\0\0\0", np.uint8).astype(np.int64)
        bits = (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tolist()
        p = 0
        eob = 0
        predicted = [0] * len(chosen)
        one = 1 << low
        try:
            dc = [self.tables.get((0, d)) for _, d, _ in chosen]
            ac = [self.tables.get((1, a)) for _, _, a in chosen]
            for unit in units:
                for i, block in unit:
                    x = chosen[i][0].coefficients
                    base = 64 * block
                    k = first
                    if k == 0:
                        if high:
                            if bits[p >> 3] >> (31 - (p & 7)) & 1:
                                x[base] |= one
                            p += 1
                        else:
                            t = dc[i][bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                            if not t:
                                raise Corrupt("code")
                            p += t >> 8
                            s = t & 255
                            if s:
                                if s > 15:
                                    raise Corrupt("size")
                                v = bits[p >> 3] >> (32 - s - (p & 7)) & ((1 << s) - 1)
                                p += s
                                predicted[i] += v if v >> (s - 1) else v - (1 << s) + 1
                            x[base] = predicted[i] << low
                        k = 1
                        if self.progressive:
                            continue
                    table = ac[i]
                    if not high:
                        if eob:
                            eob -= 1
                            continue
                        while k <= last:
                            t = table[bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                            if not t:
                                raise Corrupt("code")
                            p += t >> 8
                            r, s = t >> 4 & 15, t & 15
                            if s:
                                k += r
                                v = bits[p >> 3] >> (32 - s - (p & 7)) & ((1 << s) - 1)
                                p += s
                                if k > last:
                                    raise Corrupt("run")
                                x[base + k] = (v if v >> (s - 1) else v - (1 << s) + 1) << low
                                k += 1
                            elif r == 15:
                                k += 16
                            else:
                                if r:
                                    eob = (1 << r) - 1 + (bits[p >> 3] >> (32 - r - (p & 7)) & ((1 << r) - 1))
                                    p += r
                                break
                        continue
                    if not eob:
                        while k <= last:
                            t = table[bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                            if not t:
                                raise Corrupt("code")
                            p += t >> 8
                            r, s = t >> 4 & 15, t & 15
                            value = 0
                            if s:
                                value = one if bits[p >> 3] >> (31 - (p & 7)) & 1 else -one
                                p += 1
                            elif r < 15:
                                eob = 1 << r
                                if r:
                                    eob += bits[p >> 3] >> (32 - r - (p & 7)) & ((1 << r) - 1)
                                    p += r
                                break
                            while k <= last:
                                c = x[base + k]
                                if c:
                                    if bits[p >> 3] >> (31 - (p & 7)) & 1 and not abs(c) & one:
                                        x[base + k] = c + one if c > 0 else c - one
                                    p += 1
                                elif r:
                                    r -= 1
                                else:
                                    if value:
                                        x[base + k] = value
                                    k += 1
                                    break
                                k += 1
                    if eob:
                        while k <= last:
                            c = x[base + k]
                            if c:
                                if bits[p >> 3] >> (31 - (p & 7)) & 1 and not abs(c) & one:
                                    x[base + k] = c + one if c > 0 else c - one
                                p += 1
                            k += 1
                        eob -= 1
        except TypeError:
            raise Corrupt("no code table") from None
        except OverflowError:
            raise Corrupt("a coefficient of more than 16 bits") from None

    def plane(self, c: Component) -> np.ndarray:
        """The component's samples, without those that only fill up its blocks; grey where no scan has told of it."""
        q = c.quantisation if c.quantisation is not None else self.quantisation.get(c.table)
        if q is None:
            raise Corrupt("no quantisation table")
        if c.coefficients is None:
            return np.full((8 * c.high, 8 * c.wide), 128, np.uint8)
        x = np.frombuffer(c.coefficients, np.int16).reshape(c.high, c.wide, 64)
        out = np.empty((8 * c.high, 8 * c.wide), np.uint8)
        rows = max(1, STRIP // c.wide)
        for y in range(0, c.high, rows):
            part = x[y : y + rows]
            blocks = np.zeros((part.shape[0] * c.wide, 64))
            blocks[:, ZIGZAG] = part.reshape(-1, 64) * q
            pixels = _basis.T @ blocks.reshape(-1, 8, 8) @ _basis + 128
            pixels = pixels.reshape(-1, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.wide)
            out[8 * y : 8 * (y + rows)] = np.clip(np.rint(pixels), 0, 255)
        return out

    def picture(self) -> np.ndarray:
        planes = [self.plane(c) for c in self.components]
        for c in self.components:
            c.coefficients = None
        across = [np.arange(self.width) * c.h // self.hmax for c in self.components]
        plain = self.adobe == 0 or (self.adobe is None and [c.number for c in self.components] == [82, 71, 66])
        out = np.empty((self.height, self.width, 3), np.uint8)
        rows = max(1, 64 * STRIP // self.width)
        for y in range(0, self.height, rows):
            at = np.arange(y, min(self.height, y + rows))
            full = [p[at * c.v // self.vmax][:, columns] for p, c, columns in zip(planes, self.components, across)]
            if len(full) == 1 or plain:
                out[y : y + rows] = np.stack(full if len(full) == 3 else full * 3, axis=2)
                continue
            luma, cb, cr = full[0].astype(np.float64), full[1] - 128.0, full[2] - 128.0
            rgb = np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], axis=2)
            out[y : y + rows] = np.clip(np.rint(rgb), 0, 255)
        return out


def decode_jpeg(data: bytes) -> tuple[np.ndarray | None, str]:
    """height x width x 3 bytes, and ok or truncated (what the file has, the rest grey); or nothing, and unsupported or corrupt.

    corrupt is also a file whose header tells of more blocks than it has bits; unsupported, one of more than MAX_PIXELS or than memory has room for."""
    try:
        return Decoder(data).run()
    except (Unsupported, MemoryError):
        return None, "unsupported"
    except (Corrupt, IndexError):
        return None, "corrupt"


SCHEMA = "height int, width int, rgb binary, status string"


def decode_kernel(batches: Iterator[pa.RecordBatch], column: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done: list[tuple] = []
        size = begin = 0

        def flush(stop: int):
            part = batch.slice(begin, stop - begin)
            made = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "height", "width", "rgb", "status"])

        for k, data in enumerate(batch.column(column)):
            raw = data.as_py()
            if raw is None:
                done.append((None, None, None, None))
            else:
                rgb, status = decode_jpeg(raw)
                done.append((None, None, None, status) if rgb is None else (*rgb.shape[:2], rgb.data.cast("B"), status))
                size += 0 if rgb is None else rgb.size
            if size > 16 << 20:
                yield flush(k + 1)
                done, size, begin = [], 0, k + 1
        if done:
            yield flush(batch.num_rows)


def decode(df: DataFrame, keep: tuple[str, ...], column: str = "media") -> DataFrame:
    """Columns ``keep``, then height, width, rgb (rows of pixels of 3 bytes) and status, for each row: ok, truncated, unsupported or
    corrupt; the other three are null for the last two, and all four where the column is null. Grey pictures get three equal channels."""
    if clash := {c.lower() for c in keep} & {"height", "width", "rgb", "status"}:
        raise ValueError(f"columns that the result has itself can't be kept: {sorted(clash)}")
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *([column] if column not in keep else [])).mapInArrow(bind(__name__, "decode_kernel", column, list(keep)), f"{kept}, {SCHEMA}")


# --- encoder -----------------------------------------------------------------------------------------------

_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_CHROMA = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99] + [99] * 36)
_DC_COUNTS, _DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))


@lru_cache(1)
def flat_codes() -> tuple[bytes, bytes]:
    """A code of AC symbols (run << 4 | size, size up to 10) that has no run of ends: short codes for short runs of small values."""
    symbols = sorted([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))], key=lambda x: ((x >> 4) + 2 * (x & 15) if x & 15 else (2 if x == 0 else 12), x))
    counts = [0] * 16
    counts[3], counts[4], counts[5] = 8, 8, 8  # 8/16 + 8/32 + 8/64 of the code space
    counts[7] = 16  # 16/256: 1/16 is left
    rest = len(symbols) - 40
    counts[10] = rest
    return bytes(counts), bytes(symbols)


@lru_cache(4)
def code_of(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = code, length
            code += 1
        at += n
        code <<= 1
    return out


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.n = self.value << n | value, self.n + n

    def done(self) -> bytes:
        fill = -self.n % 8
        return ((self.value << fill | ((1 << fill) - 1)).to_bytes((self.n + fill) // 8, "big")).replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def quantised(rgb: np.ndarray, quality: int, subsampled: bool) -> list[np.ndarray]:
    """Zigzag coefficients of Y, Cb and Cr: (rows of blocks, columns of blocks, 64), filled up to whole MCUs."""
    x = rgb.astype(np.float64)
    y = x @ [0.299, 0.587, 0.114]
    planes = [y, (x[:, :, 2] - y) * 0.564334 + 128, (x[:, :, 0] - y) * 0.713267 + 128]
    unit = 16 if subsampled else 8
    pad = [(0, -rgb.shape[0] % unit), (0, -rgb.shape[1] % unit)]
    out = []
    for k, p in enumerate(planes):
        p = np.pad(p, pad, mode="edge")
        if k and subsampled:
            p = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))
        blocks = (p - 128).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        spectrum = (_basis @ blocks @ _basis.T).reshape(*blocks.shape[:2], 64)[:, :, ZIGZAG]
        out.append(np.rint(spectrum / scaled(_CHROMA if k else _LUMA, quality)[ZIGZAG]).astype(np.int64))
    return out


def scaled(table: np.ndarray, quality: int) -> np.ndarray:
    factor = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * factor + 50) // 100, 1, 255).astype(np.int64)


#: (components, first, last, high, low) of the scans: bands and bits as common encoders have them.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))


def encode_jpeg(rgb: np.ndarray, quality: int = 80, subsampled: bool = True) -> bytes:
    """A progressive JPEG of SCANS."""
    height, width = rgb.shape[:2]
    planes = quantised(rgb, quality, subsampled)
    h = 2 if subsampled else 1
    out = [b"\xff\xd8", segment(0xDB, b"\x00" + bytes(scaled(_LUMA, quality)[ZIGZAG].astype(np.uint8)) + b"\x01" + bytes(scaled(_CHROMA, quality)[ZIGZAG].astype(np.uint8)))]
    out.append(segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, h << 4 | h, 0, 2, 0x11, 1, 3, 0x11, 1])))
    counts, symbols = flat_codes()
    out.append(segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS + b"\x10" + counts + symbols))
    dc, ac = code_of(_DC_COUNTS, _DC_SYMBOLS), code_of(counts, symbols)
    for chosen, first, last, high, low in SCANS:
        bits = Bits()
        if first == 0:
            before = [0, 0, 0]
            mcu_y, mcu_x = planes[1].shape[:2]
            values = [(p[:, :, 0] >> low).tolist() for p in planes]
            for my in range(mcu_y):
                for mx in range(mcu_x):
                    for i in chosen:
                        f = h if i == 0 else 1
                        for v in range(f):
                            for u in range(f):
                                value = values[i][my * f + v][mx * f + u]
                                if high:
                                    bits.put(value & 1, 1)
                                    continue
                                d, before[i] = value - before[i], value
                                n = abs(d).bit_length()
                                bits.put(*dc[n])
                                bits.put(d if d > 0 else d + (1 << n) - 1, n)
        else:
            i = chosen[0]
            f = h if i == 0 else 1
            high_blocks, wide_blocks = -(-(-(-height * f // h)) // 8), -(-(-(-width * f // h)) // 8)
            for block in planes[i][:high_blocks, :wide_blocks].reshape(-1, 64).tolist():
                (refine_band if high else first_band)(block, first, last, low, bits, ac)
        out.append(segment(0xDA, bytes([len(chosen), *(x for i in chosen for x in (i + 1, 0)), first, last, high << 4 | low])) + bits.done())
    return b"".join(out) + b"\xff\xd9"


def first_band(block: list[int], first: int, last: int, low: int, bits: Bits, codes: dict) -> None:
    run = 0
    for c in block[first : last + 1]:
        t = abs(c) >> low
        if not t:
            run += 1
            continue
        while run > 15:
            bits.put(*codes[0xF0])
            run -= 16
        n = t.bit_length()
        bits.put(*codes[run << 4 | n])
        bits.put(t if c > 0 else ~t & ((1 << n) - 1), n)
        run = 0
    if run:
        bits.put(*codes[0])


def refine_band(block: list[int], first: int, last: int, low: int, bits: Bits, codes: dict) -> None:
    sizes = [abs(c) >> low for c in block]
    end = max((k for k in range(first, last + 1) if sizes[k] == 1), default=-1)
    run, corrections = 0, []
    for k in range(first, last + 1):
        t = sizes[k]
        if not t:
            run += 1
            continue
        while run > 15 and k <= end:
            bits.put(*codes[0xF0])
            for b in corrections:
                bits.put(b, 1)
            corrections = []
            run -= 16
        if t > 1:
            corrections.append(t & 1)
            continue
        bits.put(*codes[run << 4 | 1])
        bits.put(int(block[k] > 0), 1)
        for b in corrections:
            bits.put(b, 1)
        run, corrections = 0, []
    if run or corrections:
        bits.put(*codes[0])
        for b in corrections:
            bits.put(b, 1)


def thumbnail(embedding: np.ndarray) -> np.ndarray:
    """A 24 x 24 picture of 64 numbers: as an 8 x 8 grid, its transpose and its reverse in the three channels, enlarged between the points."""
    x = np.resize(np.nan_to_num(embedding.astype(np.float64)), 64).reshape(8, 8)
    x = 127.5 + 127.5 * np.tanh(3 * x)
    at = np.clip((np.arange(24) + 0.5) / 3 - 0.5, 0, 7)
    low = np.minimum(at.astype(int), 6)
    part = at - low
    tall = x[low] * (1 - part)[:, None] + x[low + 1] * part[:, None]
    full = tall[:, low] * (1 - part) + tall[:, low + 1] * part
    return np.rint(np.stack([full, full.T, full[::-1, ::-1]], axis=2)).astype(np.uint8)


def thumbnail_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [encode_jpeg(thumbnail(e.values.to_numpy(zero_copy_only=False))) if e.is_valid and len(e.values) else None for e in batch.column("embedding")]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], names=["vec_id", "media"])


def thumbnails(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): a progressive JPEG for each embedding; null for a null or empty one."""
    return embeddings.select("vec_id", "embedding").mapInArrow(bind(__name__, "thumbnail_kernel"), "vec_id bigint, media binary")
