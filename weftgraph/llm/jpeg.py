"""Media columns: progressive JPEG to full-resolution RGB tensors.

``decode`` accumulates the scans of a file (spectral selection and successive approximation, with or without restart
intervals; sequential files are one scan) into the coefficient array of each component, dequantises and
inverse-transforms all blocks at once in numpy, repeats subsampled chroma to full resolution and converts to RGB. Grey
pictures have three equal channels; an Adobe marker with transform 0 means RGB. ``encode`` writes progressive files.

A column of files becomes width, height, scans, pixels (rows of RGB bytes, height * width * 3) and error. A NULL, empty,
damaged or unsupported file (arithmetic coding, 12 bits, four components) has NULL pixels and says so in error; so has
one of more than MAX_PIXELS, whose tensor no column can hold (2 GB). A file can't claim more blocks than its bytes can
code, so memory follows the file: some 8 bytes a pixel, inverse-transformed in strips. Tensors leave the worker in
batches of about BATCH_MB. Each row is decoded by itself, so repeated rows, ties and NULL ids are no matter; other
columns are carried, and new names get a leading underscore where they clash. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from weftgraph.llm.kernel import arrow_map, unused

#: Pixels whose three bytes each fill a cell of a table.
MAX_PIXELS = ((1 << 31) - 64) // 3
#: MB of tensors that a worker holds before it hands them on; rows of blocks that are transformed at once.
BATCH_MB, STRIP = 16, 32
ZIGZAG = np.array([i * 8 + s - i if s % 2 else (s - i) * 8 + i for s in range(15) for i in range(max(0, s - 7), min(s, 7) + 1)])
_STEPS = np.arange(8)
#: Row k holds the basis function of frequency k.
BASIS = np.cos((2 * _STEPS[None, :] + 1) * _STEPS[:, None] * np.pi / 16) * np.where(_STEPS == 0, np.sqrt(1 / 8), 0.5)[:, None]


class JpegError(ValueError):
    """A file that can't be decoded."""


@dataclass
class Component:
    """One component: sampling factors, tables, blocks in rows and columns (padded to whole units), coefficients."""

    name: int
    h: int
    v: int
    table: int
    rows: int = 0
    columns: int = 0
    own_rows: int = 0
    own_columns: int = 0
    coefficients: array = field(default_factory=lambda: array("h"))


class _Bits:
    """Reads bits of one restart interval; ones are added at the end, and running far past it is an error."""

    __slots__ = ("count", "data", "held", "past", "place")

    def __init__(self, data: bytes):
        self.data, self.place, self.held, self.count, self.past = data, 0, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.place : self.place + 6]
        self.place += 6
        if len(more) < 6:
            self.past += 6 - len(more)
            if self.past > 24:
                raise JpegError("the entropy-coded data end too soon")
            more += b"\xff" * (6 - len(more))
        self.held = (self.held & (1 << self.count) - 1) << 48 | int.from_bytes(more)
        self.count += 48

    def take(self, n: int) -> int:
        if self.count < n:
            self.fill()
        self.count -= n
        return self.held >> self.count & (1 << n) - 1

    def symbol(self, table: tuple[int, list, dict]) -> int:
        width, fast, slow = table
        if self.count < 16:
            self.fill()
        found = fast[self.held >> (self.count - width) & (1 << width) - 1]
        if found is not None:
            self.count -= found[0]
            return found[1]
        for n in range(width + 1, 17):
            key = (n, self.held >> (self.count - n) & (1 << n) - 1)
            if key in slow:
                self.count -= n
                return slow[key]
        raise JpegError("no such Huffman code")

    def signed(self, n: int) -> int:
        if n > 15:
            raise JpegError("a coefficient is too long")
        value = self.take(n) if n else 0
        return value if not n or value >> n - 1 else value - (1 << n) + 1


def _huffman(counts: bytes, symbols: bytes) -> tuple[int, list, dict]:
    """(bits of the fast table, fast table of (length, symbol), longer codes)."""
    width = max(1, min(9, max((k + 1 for k, n in enumerate(counts) if n), default=1)))
    fast: list = [None] * (1 << width)
    slow: dict[tuple[int, int], int] = {}
    code = at = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            if code >> n or at >= len(symbols):
                raise JpegError("bad Huffman table")
            if n <= width:
                low = code << width - n
                fast[low : low + (1 << width - n)] = [(n, symbols[at])] * (1 << width - n)
            else:
                slow[n, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return width, fast, slow


def _dc(bits: _Bits, out: array, at: int, table, before: int, low: int) -> int:
    """First pass over a DC coefficient; returns the new prediction."""
    before += bits.signed(bits.symbol(table))
    out[at] = before << low
    return before


def _ac_first(bits: _Bits, out: array, at: int, table, first: int, last: int, low: int, run: int) -> int:
    """First pass over a band; returns how many blocks to come end at once."""
    if run:
        return run - 1
    k = first
    while k <= last:
        s = bits.symbol(table)
        r, n = s >> 4, s & 15
        if n:
            k += r
            if k > 63:
                raise JpegError("a run is too long")
            out[at + k] = bits.signed(n) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + (bits.take(r) if r else 0) - 1
    return 0


def _ac_more(bits: _Bits, out: array, at: int, table, first: int, last: int, low: int, run: int) -> int:
    """A further bit of each coefficient of a band; returns how many blocks to come have no new ones."""
    one, k = 1 << low, first
    if not run:
        while k <= last:
            s = bits.symbol(table)
            r, n = s >> 4, s & 15
            new = 0
            if n:
                new = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + (bits.take(r) if r else 0)
                break
            while k <= last:
                value = out[at + k]
                if value:
                    if bits.take(1) and not abs(value) & one:
                        out[at + k] += one if value > 0 else -one
                elif r:
                    r -= 1
                else:
                    if new:
                        out[at + k] = new
                    k += 1
                    break
                k += 1
        if not run:
            return 0
    while k <= last:
        value = out[at + k]
        if value and bits.take(1) and not abs(value) & one:
            out[at + k] += one if value > 0 else -one
        k += 1
    return run - 1


class Picture:
    """A file's components with accumulated coefficients."""

    def __init__(self, data: bytes):
        self.width = self.height = self.scans = self.interval = 0
        self.size = len(data)
        self.progressive, self.transform = False, None
        self.components: list[Component] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], tuple] = {}
        if data[:2] != b"\xff\xd8":
            raise JpegError("not a JPEG file")
        at = 2
        try:
            while True:
                while data[at] != 0xFF:
                    at += 1
                while data[at] == 0xFF:
                    at += 1
                marker, at = data[at], at + 1
                if marker == 0xD9:
                    break
                if marker == 1 or 0xD0 <= marker <= 0xD7:
                    continue
                (size,) = struct.unpack(">H", data[at : at + 2])
                body, at = data[at + 2 : at + size], at + size
                if marker == 0xDA:
                    at = self._scan(body, data, at)
                elif marker == 0xDB:
                    self._quantisers(body)
                elif marker == 0xC4:
                    self._tables(body)
                elif marker in (0xC0, 0xC1, 0xC2):
                    self._frame(body, marker == 0xC2)
                elif 0xC0 <= marker <= 0xCF:
                    raise JpegError("arithmetic, lossless and hierarchical coding aren't supported")
                elif marker == 0xDD:
                    (self.interval,) = struct.unpack(">H", body[:2])
                elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                    self.transform = body[11]
        except (IndexError, struct.error, KeyError, OverflowError) as e:
            raise JpegError("the file is damaged or ends too soon") from e
        if not self.components or not self.scans:
            raise JpegError("the file has no picture")

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            raw = body[at + 1 : at + 1 + 64 * (1 + wide)]
            if wide > 1 or len(raw) < 64 * (1 + wide):
                raise JpegError("bad quantisation table")
            self.quantisers[name] = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.int64)
            at += 1 + 64 * (1 + wide)

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            if len(counts) < 16:
                raise JpegError("bad Huffman table")
            n = sum(counts)
            self.tables[body[at] >> 4, body[at] & 15] = _huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if self.components or depth != 8 or n not in (1, 3) or not self.width or not self.height:
            raise JpegError("unsupported depth, size or number of components")
        if self.width * self.height > MAX_PIXELS:
            raise JpegError("the picture is too large")
        self.progressive = progressive
        self.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        if any(not 1 <= f <= 4 for c in self.components for f in (c.h, c.v)):
            raise JpegError("bad sampling factors")
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        for c in self.components:
            units = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
            c.columns, c.rows = units[0] * c.h, units[1] * c.v
            c.own_columns, c.own_rows = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
        # each takes a bit at least
        if sum(c.own_columns * c.own_rows for c in self.components) > 8 * self.size:
            raise JpegError("the file is too short for its size")
        for c in self.components:
            c.coefficients = array("h", bytes(c.columns * c.rows * 128))

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        named = {c.name: c for c in self.components}
        own = [(named[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if not own or first > last or last > 63 or low > 13 or (self.progressive and (first and n > 1 or not first and last or high and high != low + 1)):
            raise JpegError("bad scan")
        parts, start, end = [], at, at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0:
                end += 2
            elif 0xD0 <= data[end + 1] <= 0xD7:
                parts.append(data[start:end])
                start = end = end + 2
            else:
                break
        parts.append(data[start:end])
        # (place in own, first place and further places a row and a column of units, columns of blocks) of each block of a unit
        c = own[0][0]
        if n == 1:
            wide, tall, blocks = c.own_columns, c.own_rows, [(0, 0, c.columns, 1)]
        else:
            wide, tall = c.columns // c.h, c.rows // c.v
            blocks = [(k, y * c.columns + x, c.v * c.columns, c.h) for k, (c, _, _) in enumerate(own) for y in range(c.v) for x in range(c.h)]
        step = self.interval or wide * tall
        for part, unit in zip(parts, range(0, wide * tall, step)):
            self._interval(_Bits(part.replace(b"\xff\0", b"\xff")), own, blocks, wide, range(unit, min(unit + step, wide * tall)), first, last, high, low)
        if -(-wide * tall // step) > len(parts):
            raise JpegError("restart intervals are missing")
        self.scans += 1
        return end

    def _interval(self, bits: _Bits, own: list, blocks: list, wide: int, units: range, first: int, last: int, high: int, low: int) -> None:
        before, run = [0] * len(own), 0
        for unit in units:
            row, column = divmod(unit, wide)
            for k, start, down, right in blocks:
                at = (start + row * down + column * right) * 64
                c, dc, ac = own[k]
                out = c.coefficients
                if not self.progressive:
                    before[k] = _dc(bits, out, at, self.tables[0, dc], before[k], 0)
                    _ac_first(bits, out, at, self.tables[1, ac], 1, 63, 0, 0)
                elif first:
                    run = (_ac_more if high else _ac_first)(bits, out, at, self.tables[1, ac], first, last, low, run)
                elif high:
                    out[at] |= bits.take(1) << low
                else:
                    before[k] = _dc(bits, out, at, self.tables[0, dc], before[k], low)

    def pixels(self) -> np.ndarray:
        """height x width x 3 bytes."""
        planes = []
        for c in self.components:
            blocks = np.frombuffer(c.coefficients, np.int16).reshape(c.rows, c.columns, 64)
            plane = np.empty((c.rows * 8, c.columns * 8), np.uint8)
            for low in range(0, c.rows, STRIP):
                own = blocks[low : low + STRIP] * self.quantisers[c.table]
                natural = np.zeros(own.shape)
                natural[..., ZIGZAG] = own
                samples = BASIS.T @ natural.reshape(*own.shape[:2], 8, 8) @ BASIS + 128
                plane[low * 8 : (low + len(own)) * 8] = np.clip(np.rint(samples), 0, 255).swapaxes(1, 2).reshape(-1, c.columns * 8)
            planes.append((plane, np.arange(self.width) * c.h // self.h, c.v))
        out = np.empty((self.height, self.width, 3), np.uint8)
        for low in range(0, self.height, 8 * STRIP):
            y = np.arange(low, min(low + 8 * STRIP, self.height))
            own = [plane[(y * v // self.v)[:, None], x[None, :]] for plane, x, v in planes]
            if len(own) == 1:
                own *= 3
            elif self.transform != 0:
                grey, b, r = own[0].astype(float), own[1] - 128.0, own[2] - 128.0
                own = [np.clip(np.rint(x), 0, 255) for x in (grey + 1.402 * r, grey - 0.344136286 * b - 0.714136286 * r, grey + 1.772 * b)]
            out[low : low + len(y)] = np.stack(own, 2)
        return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(height x width x 3 bytes, number of scans)."""
    try:
        picture = Picture(data)
        return picture.pixels(), picture.scans
    except KeyError as e:
        raise JpegError("a quantisation table is missing") from e
    except JpegError:
        raise
    except (ValueError, ArithmeticError, LookupError, MemoryError) as e:
        raise JpegError(f"the file can't be decoded: {e}") from e


class _Writer:
    """Symbols and bits of one scan, written with a Huffman table of codes of one length."""

    def __init__(self) -> None:
        self.items: list[tuple[int | None, int, int]] = []
        self.run, self.later = 0, []

    def put(self, symbol: int | None, value: int = 0, n: int = 0) -> None:
        self.items.append((symbol, value, n))

    def end_run(self) -> None:
        if self.run:
            n = self.run.bit_length() - 1
            self.put(n << 4, self.run - (1 << n), n)
            self.items += [(None, b, 1) for b in self.later]
            self.run, self.later = 0, []

    def signed(self, symbol: int, value: int) -> None:
        n = abs(value).bit_length()
        self.put(symbol | n, value if value > 0 else value + (1 << n) - 1, n)

    def finish(self, kind: int) -> tuple[bytes, bytes]:
        """(table segment or nothing, coded bytes)."""
        self.end_run()
        used = sorted({s for s, _, _ in self.items if s is not None})
        length = len(used).bit_length()
        codes = {s: k for k, s in enumerate(used)}
        value = count = 0
        out = bytearray()
        for s, extra, n in self.items:
            if s is not None:
                value, count = value << length | codes[s], count + length
            value, count = value << n | extra, count + n
            if count >= 256:
                out += (value >> count % 8).to_bytes(count // 8)
                count %= 8
                value &= (1 << count) - 1
        pad = -count % 8
        out += (value << pad | (1 << pad) - 1).to_bytes((count + pad) // 8)
        table = b""
        if used:
            table = _segment(0xC4, bytes([kind << 4]) + bytes(len(used) if k + 1 == length else 0 for k in range(16)) + bytes(used))
        return table, bytes(out).replace(b"\xff", b"\xff\0")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dc_scan(writer: _Writer, blocks: list[np.ndarray], order: list[tuple[int, int]], high: int, low: int) -> None:
    before = [0] * len(blocks)
    for k, at in order:
        value = int(blocks[k][at, 0]) >> low
        if high:
            writer.put(None, value & 1, 1)
        else:
            writer.signed(0, value - before[k])
            before[k] = value


def _ac_scan(writer: _Writer, block: list[int], first: int, last: int, high: int, low: int) -> None:
    size = [abs(v) >> low for v in block]
    newest = max((k for k in range(first, last + 1) if size[k] == 1), default=0) if high else 64
    r, bits = 0, []
    for k in range(first, last + 1):
        if not size[k]:
            r += 1
            continue
        if not high or size[k] == 1 or (r > 15 and k <= newest):
            writer.end_run()
        while r > 15 and k <= newest:
            writer.put(0xF0)
            r -= 16
            for b in bits:
                writer.put(None, b, 1)
            bits = []
        if high and size[k] > 1:
            bits.append(size[k] & 1)
            continue
        if high:
            writer.put(r << 4 | 1, int(block[k] > 0), 1)
            for b in bits:
                writer.put(None, b, 1)
            bits = []
        else:
            writer.signed(r << 4, size[k] if block[k] > 0 else -size[k])
        r = 0
    if r or bits:
        writer.run += 1
        writer.later += bits
        if writer.run == 0x7FFF:
            writer.end_run()


#: (components, first and last coefficient, bits before and now) of each scan of a colour and of a grey picture.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))
GREY = (((0,), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0,), 0, 0, 1, 0), ((0,), 1, 63, 1, 0))


def encode_blocks(blocks: list[np.ndarray], width: int, height: int, sampling: list[tuple[int, int]], quantiser: np.ndarray, interval: int = 0) -> bytes:
    """A progressive file of given coefficients: for each component rows x columns x 64 in zigzag order."""
    h, v = max(a for a, _ in sampling), max(b for _, b in sampling)
    out = [b"\xff\xd8", _segment(0xDB, b"\0" + bytes(quantiser.astype(np.uint8)))]
    frame = struct.pack(">BHHB", 8, height, width, len(blocks)) + b"".join(bytes([k + 1, a << 4 | b, 0]) for k, (a, b) in enumerate(sampling))
    out.append(_segment(0xC2, frame))
    if interval:
        out.append(_segment(0xDD, struct.pack(">H", interval)))
    flat = [b.reshape(-1, 64) for b in blocks]
    for own, first, last, high, low in SCRIPT if len(blocks) == 3 else GREY:
        if len(own) == 1:
            k = own[0]
            a, b = sampling[k]
            wide, tall = -(-(-(-width * a // h)) // 8), -(-(-(-height * b // v)) // 8)
            units = [[(k, y * blocks[k].shape[1] + x)] for y in range(tall) for x in range(wide)]
        else:
            wide, tall = blocks[0].shape[1] // sampling[0][0], blocks[0].shape[0] // sampling[0][1]
            units = [[(k, (my * sampling[k][1] + y) * blocks[k].shape[1] + mx * sampling[k][0] + x) for k in own for y in range(sampling[k][1]) for x in range(sampling[k][0])] for my in range(tall) for mx in range(wide)]
        writers = []
        for start in range(0, len(units), interval or len(units)):
            writer = _Writer()
            part = [x for unit in units[start : start + (interval or len(units))] for x in unit]
            if first:
                for k, at in part:
                    _ac_scan(writer, flat[k][at].tolist(), first, last, high, low)
            else:
                _dc_scan(writer, flat, part, high, low)
            writer.end_run()
            writers.append(writer)
        joint = _Writer()
        joint.items = [x for w in writers for x in w.items]
        table, coded = joint.finish(int(first > 0))
        if interval:
            used = sorted({s for s, _, _ in joint.items if s is not None})
            parts = [_coded(w, used) for w in writers]
            coded = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
        out.append(table)
        out.append(_segment(0xDA, bytes([len(own)]) + b"".join(bytes([k + 1, 0]) for k in own) + bytes([first, last, high << 4 | low])))
        out.append(coded)
    return b"".join(out) + b"\xff\xd9"


def _coded(writer: _Writer, used: list[int]) -> bytes:
    """The bits of one interval with the codes of all."""
    length = len(used).bit_length()
    codes = {s: k for k, s in enumerate(used)}
    text = "".join((f"{codes[s]:0{length}b}" if s is not None else "") + (f"{extra:0{n}b}" if n else "") for s, extra, n in writer.items)
    text += "1" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\0")


def encode(rgb: np.ndarray, quality: int = 4, subsample: bool = True, interval: int = 0) -> bytes:
    """A progressive file of a height x width x 3 array; quality is the step of the quantiser."""
    height, width = rgb.shape[:2]
    r, g, b = np.moveaxis(rgb.astype(float), 2, 0)
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b]
    factor = 2 if subsample else 1
    sampling = [(factor, factor), (1, 1), (1, 1)]
    quantiser = np.full(64, quality)
    blocks = []
    for plane, (h, v) in zip(planes, sampling):
        unit = 8 * factor
        whole = np.pad(plane, ((0, -height % unit), (0, -width % unit)), "edge")
        y, x = factor // v, factor // h
        whole = whole.reshape(whole.shape[0] // y, y, whole.shape[1] // x, x).mean((1, 3))
        cut = whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8).swapaxes(1, 2) - 128
        blocks.append(np.rint((BASIS @ cut @ BASIS.T).reshape(*cut.shape[:2], 64)[..., ZIGZAG] / quantiser).astype(np.int64))
    return encode_blocks(blocks, width, height, sampling, quantiser, interval)


def decode_column(media: DataFrame, column: str) -> DataFrame:
    """media with width, height, scans, pixels and error of the files in a binary column, which is dropped."""
    at = media.columns.index(column)
    carried = [k for k in range(len(media.columns)) if k != at]
    fields = [media.schema.fields[k] for k in carried]
    for name, kind in (("width", IntegerType()), ("height", IntegerType()), ("scans", IntegerType()), ("pixels", BinaryType()), ("error", StringType())):
        fields.append(StructField(unused(media, name), kind))
    schema = StructType(fields)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = start = 0

        def done(end: int) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in carried), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], schema.names)

        for n, data in enumerate(batch.column(at)):
            raw = data.as_py()
            try:
                if not raw:
                    raise JpegError("no file")
                pixels, scans = decode(raw)
                rows.append((pixels.shape[1], pixels.shape[0], scans, pixels.tobytes(), None))
                held += pixels.size
            except JpegError as e:
                rows.append((None, None, None, None, str(e)))
            if held > BATCH_MB << 20:
                yield done(n + 1)
                rows, held, start = [], 0, n + 1
        if rows:
            yield done(batch.num_rows)

    return arrow_map(media, work, schema)


def picture_of(vector: list[float] | None) -> np.ndarray | None:
    """A vector as a square picture, three by three pixels for each number; None for NULL and empty ones."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float), posinf=0, neginf=0)
    side = int(np.ceil(np.sqrt(len(v))))
    v = np.concatenate([v, np.zeros(side * side - len(v))]) / (np.abs(v).max() or 1)
    grid = np.kron(v.reshape(side, side), np.ones((3, 3)))
    return np.clip(np.rint(np.stack([128 + 127 * grid, 128 + 127 * grid[::-1], 128 - 127 * grid.T], 2)), 0, 255).astype(np.uint8)


def pictures(embeddings: DataFrame) -> DataFrame:
    """vec_id, image: each embedding drawn and stored as a progressive file."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        drawn = [picture_of(v.as_py()) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else encode(p) for p in drawn], pa.binary())], ["vec_id", "image"])

    return arrow_map(embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding")), work, "vec_id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensor of every picture; the tables hold no media, so the embeddings are drawn (64 numbers: 24 x 24 pixels)."""
    return decode_column(pictures(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "image")
