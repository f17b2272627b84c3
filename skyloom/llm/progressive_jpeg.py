"""Progressive JPEG in numpy: scans to coefficient arrays and back, and RGB tensors.

The reader takes any progressive Huffman file of one or three components with
8-bit samples: spectral selection, successive approximation, end-of-band runs,
restart intervals and sampling factors. Scans of uniform structure, as the
payload writer makes them, are read with array operations; all others symbol
by symbol.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

SOI, EOI, SOF2, DHT, DQT, SOS, DRI, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDA, 0xDD, 0xFE


def _zigzag() -> np.ndarray:
    """Natural place of each zigzag place, from the rule of its diagonals."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Row k: the 64 samples of the k-th zigzag coefficient."""
    u = np.arange(8)
    one = np.where(u == 0, math.sqrt(0.125), 0.5)[:, None] * np.cos((2 * np.arange(8)[None, :] + 1) * u[:, None] * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


@dataclass
class Component:
    """Sampling factors and coefficients, as (rows, columns, 64) of blocks in zigzag order."""

    h: int
    v: int
    coefficients: np.ndarray
    table: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


# ---- bits


def pack_codes(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The low ``sizes`` bits of each value in a row, filled up with ones."""
    sizes = sizes.astype(np.int64)
    n = int(sizes.sum())
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(n)
    bits = ((np.repeat(values.astype(np.int64), sizes) >> shift) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-n % 8, np.uint8)])).tobytes()


class Bits:
    """Bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.at, self.size = 0, 8 * len(data)
        self._words: list[int] | None = None

    def words(self) -> list[int]:
        if self._words is None:
            d = np.concatenate([self.data, np.full(8, 255, np.uint8)]).astype(np.uint64)
            self._words = ((d[:-4] << np.uint64(32)) | (d[1:-3] << np.uint64(24)) | (d[2:-2] << np.uint64(16)) | (d[3:-1] << np.uint64(8)) | d[4:]).tolist()
        return self._words

    def peek(self, n: int) -> int:
        return (self.words()[min(self.at >> 3, len(self.data) + 3)] >> (40 - n - (self.at & 7))) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        got = self.peek(n) if n else 0
        self.at += n
        return got

    def array(self, n: int) -> np.ndarray:
        """The next n bits, one in a byte."""
        first = self.at >> 3
        bits = np.unpackbits(self.data[first : (self.at + n + 7) >> 3])[self.at & 7 :][:n]
        self.at += n
        if len(bits) < n:
            raise ValueError("scan ends early")
        return bits


class Huffman:
    """Canonical codes from counts by length and symbols."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        self.lookup: dict[tuple[int, int], int] = {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[symbols[k]] = (code, length)
                self.lookup[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    @cached_property
    def table(self) -> list[tuple[int, int]]:
        """Symbol and length for each 16 bits that begin with a code."""
        found = [(0, 0)] * 65536
        for symbol, (code, length) in self.codes.items():
            low = code << (16 - length)
            found[low : low + (1 << (16 - length))] = [(symbol, length)] * (1 << (16 - length))
        return found

    @staticmethod
    @lru_cache(maxsize=256)
    def held(counts: bytes, symbols: bytes) -> Huffman:
        """The table of a DHT segment, kept for the next file that has it."""
        return Huffman(list(counts), symbols)

    def read(self, bits: Bits) -> int:
        symbol, length = self.table[bits.peek(16)]
        if not length:
            raise ValueError("no such code")
        bits.at += length
        return symbol

    @classmethod
    def flat(cls, symbols: list[int]) -> tuple[Huffman, bytes]:
        """Codes of one length for all symbols (no code is all ones), and the table's bytes."""
        symbols = sorted(set(symbols)) or [0]
        length = max(1, len(symbols).bit_length())
        counts = [len(symbols) if i == length else 0 for i in range(1, 17)]
        return cls.held(bytes(counts), bytes(symbols)), bytes(counts) + bytes(symbols)


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


# ---- writing


def _marker(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(members: list[tuple[int, int, int]], band: tuple[int, int], approx: tuple[int, int], data: bytes) -> bytes:
    head = bytes([len(members)]) + b"".join(bytes((c, dc << 4 | ac)) for c, dc, ac in members) + bytes((*band, approx[0] << 4 | approx[1]))
    return _marker(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def _mcu_order(c: Component, rows: int, cols: int) -> np.ndarray:
    """Blocks of a component in the order of an interleaved scan: (rows * cols, h * v)."""
    grid = np.arange(rows * c.v * cols * c.h).reshape(rows, c.v, cols, c.h)
    return grid.transpose(0, 2, 1, 3).reshape(rows * cols, c.v * c.h)


def _ac_first_symbols(blocks: np.ndarray, band: tuple[int, int], al: int) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, their number) of a first AC scan."""
    out, eob = [], 0

    def flush():
        nonlocal eob
        if eob:
            r = eob.bit_length() - 1
            out.append((r << 4, eob - (1 << r), r))
            eob = 0

    for block in (np.sign(blocks) * (np.abs(blocks) >> al))[:, band[0] : band[1] + 1].tolist():
        run = 0
        for value in block:
            if not value:
                run += 1
                continue
            flush()
            while run > 15:
                out.append((0xF0, 0, 0))
                run -= 16
            size = abs(value).bit_length()
            out.append((run << 4 | size, value if value > 0 else value + (1 << size) - 1, size))
            run = 0
        if run:
            eob += 1
            if eob == 32767:
                flush()
    flush()
    return out


def _ac_refine_symbols(blocks: np.ndarray, band: tuple[int, int], al: int) -> list[tuple[int, int, int]]:
    """As _ac_first_symbols for a refining scan; symbol -1 stands for bits without a code."""
    out: list[tuple[int, int, int]] = []
    eob, later = 0, []

    def flush():
        nonlocal eob, later
        if eob:
            r = eob.bit_length() - 1
            out.append((r << 4, eob - (1 << r), r))
            out.extend((-1, b, 1) for b in later)
            eob, later = 0, []

    for block, signs in zip((np.abs(blocks) >> al)[:, band[0] : band[1] + 1].tolist(), (blocks < 0)[:, band[0] : band[1] + 1].tolist(), strict=True):
        fresh = [i for i, v in enumerate(block) if v == 1]
        last, run, bits = fresh[-1] if fresh else -1, 0, []
        for i, v in enumerate(block):
            if v == 0:
                run += 1
                continue
            while run > 15 and i <= last:
                flush()
                out.append((0xF0, 0, 0))
                out.extend((-1, b, 1) for b in bits)
                run, bits = run - 16, []
            if v > 1:
                bits.append(v & 1)
                continue
            flush()
            out.append((run << 4 | 1, 0 if signs[i] else 1, 1))
            out.extend((-1, b, 1) for b in bits)
            run, bits = 0, []
        if run or bits:
            eob += 1
            later += bits
            if eob == 32767:
                flush()
    flush()
    return out


def _coded(symbols: list[tuple[int, int, int]]) -> tuple[bytes, bytes]:
    """DHT body of a flat AC table, and the bits."""
    code, body = Huffman.flat([s for s, _, _ in symbols if s >= 0])
    values, sizes = [], []
    for s, extra, n in symbols:
        c, length = code.codes[s] if s >= 0 else (0, 0)
        values.append(c << n | extra)
        sizes.append(length + n)
    return body, pack_codes(np.array(values, np.int64), np.array(sizes, np.int64))


def _dense_first(values: np.ndarray) -> tuple[bytes, bytes]:
    """As _coded, for coefficients that all are of size 8 and lose one bit: a zero and seven bits each."""
    half = np.abs(values) >> 1
    extra = np.where(values > 0, half, 127 - half).astype(np.uint8)
    return bytes([1] + [0] * 15 + [0x07]), extra.tobytes()


def _dense_refine(values: np.ndarray) -> tuple[bytes, bytes]:
    """As _coded, for blocks without zeros: end-of-band runs, each followed by one bit for each coefficient."""
    blocks, low = len(values), (np.abs(values) & 1).astype(np.uint8)
    parts, used = [], []
    for at in range(0, blocks, 32767):
        n = min(32767, blocks - at)
        used.append(n.bit_length() - 1)
        parts.append((n, low[at : at + 32767].ravel()))
    code, body = Huffman.flat([r << 4 for r in used])
    bits = []
    for (n, own), r in zip(parts, used, strict=True):
        c, length = code.codes[r << 4]
        word = c << r | (n - (1 << r))
        bits += [np.array([int(x) for x in f"{word:0{length + r}b}"], np.uint8), own]
    joined = np.concatenate(bits)
    return body, np.packbits(np.concatenate([joined, np.ones(-len(joined) % 8, np.uint8)])).tobytes()


def write_progressive(image: Image, bands: tuple[tuple[int, int], ...] = ((1, 5), (6, 63))) -> bytes:
    """A progressive file: DC and AC bands without their lowest bit, then the lowest bits."""
    parts = [b"\xff\xd8"]
    if image.comment:
        parts.append(_marker(COM, image.comment))
    for k, q in image.quant.items():
        parts.append(_marker(DQT, bytes([k]) + q.astype(np.uint8).tobytes()))
    comps = image.components
    frame = bytes([8]) + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + bytes([len(comps)])
    parts.append(_marker(SOF2, frame + b"".join(bytes((i + 1, c.h << 4 | c.v, c.table)) for i, c in enumerate(comps))))
    rows, cols = comps[0].coefficients.shape[0] // comps[0].v, comps[0].coefficients.shape[1] // comps[0].h
    flat = [c.coefficients.reshape(-1, 64) for c in comps]
    orders = [_mcu_order(c, rows, cols) for c in comps]
    dc = [f[o.ravel(), 0].astype(np.int64) >> 1 for f, o in zip(flat, orders, strict=True)]
    steps = [np.diff(d, prepend=0) for d in dc]
    sizes = [np.frexp(np.abs(s))[1].astype(np.int64) for s in steps]
    code, body = Huffman.flat(list(range(12)))
    parts.append(_marker(DHT, b"\x00" + body))
    length = code.codes[0][1]
    coded = [((s_ << z) | np.where(d > 0, d, d + (1 << z) - 1), z + length) for d, z in zip(steps, sizes, strict=True) for s_ in [z]]
    shape = [(rows * cols, c.h * c.v) for c in comps]
    values = np.concatenate([v.reshape(s) for (v, _), s in zip(coded, shape, strict=True)], axis=1).ravel()
    widths = np.concatenate([w.reshape(s) for (_, w), s in zip(coded, shape, strict=True)], axis=1).ravel()
    everyone = [(i + 1, 0, 0) for i in range(len(comps))]
    parts.append(_scan(everyone, (0, 0), (0, 1), pack_codes(values, widths)))
    dense = [bool((np.abs(f[:, 1:]) >= 128).all() and (np.abs(f[:, 1:]) < 256).all()) for f in flat]
    for band in bands:
        for i, f in enumerate(flat):
            body, data = _dense_first(f[:, band[0] : band[1] + 1]) if dense[i] else _coded(_ac_first_symbols(f, band, 1))
            parts += [_marker(DHT, b"\x10" + body), _scan([(i + 1, 0, 0)], band, (0, 1), data)]
    low = np.concatenate([f[o, 0] & 1 for f, o in zip(flat, orders, strict=True)], axis=1).ravel().astype(np.uint8)
    parts.append(_scan(everyone, (0, 0), (1, 0), np.packbits(np.concatenate([low, np.ones(-len(low) % 8, np.uint8)])).tobytes()))
    for i, f in enumerate(flat):
        body, data = _dense_refine(f[:, 1:]) if dense[i] else _coded(_ac_refine_symbols(f, (1, 63), 0))
        parts += [_marker(DHT, b"\x10" + body), _scan([(i + 1, 0, 0)], (1, 63), (1, 0), data)]
    return b"".join([*parts, b"\xff\xd9"])


# ---- reading


def _dc_first(bits: Bits, outs: list[tuple[np.ndarray, np.ndarray, Huffman]], al: int, mcus: range) -> None:
    before = [0] * len(outs)
    plan = [(k, o.shape[1], t) for k, (_, o, t) in enumerate(outs)]
    got: list[list[int]] = [[] for _ in outs]
    words, at = bits.words(), bits.at
    longest = len(words) - 1
    for _ in mcus:
        for k, n, t in plan:
            table, keep = t.table, got[k]
            for _ in range(n):
                symbol, length = table[(words[min(at >> 3, longest)] >> (24 - (at & 7))) & 0xFFFF]
                at += length
                if symbol:
                    v = (words[min(at >> 3, longest)] >> (40 - symbol - (at & 7))) & ((1 << symbol) - 1)
                    at += symbol
                    before[k] += v if v >> (symbol - 1) else v - (1 << symbol) + 1
                keep.append(before[k])
    bits.at = at
    for k, (f, o, _) in enumerate(outs):
        f[o[mcus.start : mcus.stop].ravel(), 0] = np.array(got[k], np.int64) << al


def _ac_first(bits: Bits, f: np.ndarray, band: tuple[int, int], table: Huffman, al: int) -> None:
    lo, hi = band
    n = len(f) * (hi - lo + 1)
    if len(table.codes) == 1 and n:
        symbol, (code, length) = next(iter(table.codes.items()))
        size = symbol & 15
        stride = length + size
        if symbol >> 4 == 0 and size and bits.at + n * stride <= bits.size:
            if stride == 8 and bits.at == 0:
                raw = bits.data[:n]
                same, extra = (raw >> size) == code, (raw & ((1 << size) - 1)).astype(np.int32)
            else:
                grid = np.unpackbits(bits.data)[bits.at : bits.at + n * stride].reshape(n, stride).astype(np.int32)
                same = (grid[:, :length] @ (1 << np.arange(length)[::-1])) == code
                extra = grid[:, length:] @ (1 << np.arange(size)[::-1])
            if same.all():
                bits.at += n * stride
                value = np.where(extra >> (size - 1), extra, extra - (1 << size) + 1)
                f[:, lo : hi + 1] = (np.sign(value) * (np.abs(value) << al)).reshape(len(f), -1)
                return
    eob = 0
    for block in f:
        if eob:
            eob -= 1
            continue
        k = lo
        while k <= hi:
            symbol = table.read(bits)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                value = _extend(bits.take(size), size)
                block[k] = (abs(value) << al) * (1 if value > 0 else -1)
                k += 1
            elif run == 15:
                k += 16
            else:
                eob = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(bits: Bits, f: np.ndarray, band: tuple[int, int], table: Huffman, al: int) -> None:
    lo, hi = band
    view = f[:, lo : hi + 1]
    done = 0
    if view.all():
        while done < len(f):
            symbol = table.read(bits)
            run = symbol >> 4
            if symbol & 15 or run == 15:
                raise ValueError("a new coefficient where none is zero")
            n = (1 << run) + bits.take(run)
            part = view[done : done + n]
            add = bits.array(part.size).reshape(part.shape).astype(part.dtype) << al
            part += np.where(part > 0, add, -add)
            done += n
        return
    eob = 0
    for block in f:
        k = lo
        if not eob:
            while k <= hi:
                symbol = table.read(bits)
                run, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = (1 if bits.take(1) else -1) << al
                elif run < 15:
                    eob = (1 << run) + bits.take(run)
                    break
                while k <= hi:
                    if block[k]:
                        if bits.take(1):
                            block[k] += (1 << al) if block[k] > 0 else -(1 << al)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if value and k <= hi:
                    block[k] = value
                k += 1
        if eob:
            for i in range(k, hi + 1):
                if block[i] and bits.take(1):
                    block[i] += (1 << al) if block[i] > 0 else -(1 << al)
            eob -= 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart segments of a scan, without stuffing, and the place of the next marker."""
    parts, begin = [], at
    while True:
        stop = data.find(b"\xff", at)
        if stop < 0:
            raise ValueError("a scan without end")
        kind = data[stop + 1]
        if kind == 0:
            at = stop + 2
        elif 0xD0 <= kind <= 0xD7:
            parts.append(data[begin:stop].replace(b"\xff\x00", b"\xff"))
            at = begin = stop + 2
        else:
            parts.append(data[begin:stop].replace(b"\xff\x00", b"\xff"))
            return parts, stop


def read_progressive(data: bytes) -> Image:
    """Accumulate all scans of a progressive file into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, image, restart, comment = 2, {}, {}, None, 0, b""
    names: dict[int, int] = {}
    rows = cols = 0
    while True:
        kind, size = data[at + 1], 0
        if kind == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == COM:
            comment = body
        elif kind == DQT:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Huffman.held(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == DRI:
            restart = int.from_bytes(body[:2], "big")
        elif kind == SOF2:
            height, width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            shape = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(s[1] for s in shape), max(s[2] for s in shape)
            rows, cols = -(-height // (8 * most_v)), -(-width // (8 * most_h))
            comps = [Component(h, v, np.zeros((rows * v, cols * h, 64), np.int16), q) for _, h, v, q in shape]
            names = {s[0]: i for i, s in enumerate(shape)}
            image = Image(width, height, comps)
        elif kind == SOS:
            n = body[0]
            members = [(names[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            lo, hi, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            parts, at = _segments(data, at)
            if n > 1:
                orders = [_mcu_order(image.components[i], rows, cols) for i, _, _ in members]
            else:
                c = image.components[members[0][0]]
                high = -(-(-(-image.height * c.v // most_v)) // 8)
                broad = -(-(-(-image.width * c.h // most_h)) // 8)
                orders = [np.arange(c.coefficients.shape[0] * c.coefficients.shape[1]).reshape(c.coefficients.shape[:2])[:high, :broad].reshape(-1, 1)]
            flat = [image.components[i].coefficients.reshape(-1, 64) for i, _, _ in members]
            units = len(orders[0])
            for k, part in enumerate(parts):
                span = range(k * restart, min(units, (k + 1) * restart)) if restart else range(units)
                bits = Bits(part)
                if lo == 0 and not ah:
                    _dc_first(bits, [(f, o, tables[m[1]]) for f, o, m in zip(flat, orders, members, strict=True)], al, span)
                elif lo == 0:
                    places = [o[span.start : span.stop] for o in orders]
                    got = bits.array(sum(p.size for p in places)).reshape(len(span), -1)
                    col = 0
                    for f, p in zip(flat, places, strict=True):
                        f[p.ravel(), 0] |= got[:, col : col + p.shape[1]].ravel().astype(np.int16) << al
                        col += p.shape[1]
                else:
                    own = orders[0][span.start : span.stop, 0]
                    whole = len(own) == len(flat[0])
                    block = flat[0] if whole else flat[0][own]
                    table = tables[0x10 | members[0][2]]
                    (_ac_refine if ah else _ac_first)(bits, block, (lo, hi), table, al)
                    if not whole:
                        flat[0][own] = block
            continue
    if image is None:
        raise ValueError("no progressive frame")
    image.quant, image.comment = quant, comment
    return image


def to_rgb(image: Image) -> np.ndarray:
    """Full-resolution RGB samples (height, width, 3): inverse transform, chroma repeated, colours turned."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        rows, cols = c.coefficients.shape[:2]
        flat = c.coefficients.reshape(-1, 64).astype(np.float32)
        if c.table in image.quant:
            flat *= image.quant[c.table].astype(np.float32)
        samples = np.clip(np.rint(flat @ BASIS) + 128, 0, 255).astype(np.uint8)
        plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(np.repeat(np.repeat(plane, most_v // c.v, axis=0), most_h // c.h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    rgb = np.empty((*y.shape, 3), np.uint8)
    rgb[..., 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    rgb[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    rgb[..., 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return rgb
