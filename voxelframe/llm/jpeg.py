"""Media columns: progressive JPEG.

encode_payload keeps bytes without loss in the format's own unit, the quantised
coefficient (all quantisers are 1): AC coefficients hold byte + 256, DC ones
byte - 128, over luma and two half-resolution chroma components, written as a
progressive stream: DC and AC bands (spectral selection) without their lowest
bit, then refinement scans (successive approximation). Each block is a restart
interval, so that a lost piece costs one block and many blocks are decoded at once.

decode accumulates all scans of a stream into coefficient arrays; it follows
the entropy-coded syntax in general (Huffman tables, zero and end-of-band runs,
restart intervals, refinement) for 8-bit progressive frames, all restart
intervals of a batch of images in step; DC scans that interleave components are
followed in order of their coded units, with the padding blocks beyond the
edges. The inverse transform is a matrix product in numpy; chroma is repeated to full
resolution and colours, by whole-number tables, become RGB tensors (height, width, 3).

Cases. An empty or null text is one unit of padding. Streams of other kinds
(baseline, arithmetic coding), cut ones and such as don't keep to the syntax
are refused with ValueError; ``decode_rgb`` gives a row without a tensor, with
the reason, for each of them and for a null. Repeated rows are answered each.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

UNIT = 576
#: Payload bytes worked on at once.
BATCH = 1_500_000
MOST_ACROSS = 4095  # 16-pixel units in a row: a side has at most 65535 pixels


def zigzag() -> np.ndarray:
    """Natural index of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def _dct_basis() -> np.ndarray:
    """(64 natural coefficients, 64 samples)."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    return np.kron(a, a)


BASIS = _dct_basis()
#: (components, first coefficient, last, high bit, low bit); -1 for Ah = 0.
SCANS = ((0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (2, 0, 0, 0, 1), (0, 1, 5, 0, 1), (0, 6, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 0, 0, 1, 0), (1, 0, 0, 1, 0), (2, 0, 0, 1, 0), (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0))
DC_CODES = (4, list(range(12)))  # all of four bits
AC_CODES = (1, [0x08])  # one code of one bit: no zeros, eight magnitude bits
END_CODES = (1, [0x00])  # end of band


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(slot: int, codes: tuple[int, list[int]]) -> bytes:
    bits, symbols = codes
    return _segment(0xC4, bytes([slot]) + bytes(len(symbols) if k == bits else 0 for k in range(1, 17)) + bytes(symbols))


def _geometry(blocks: int) -> tuple[int, int]:
    """Units across and down for so many payload blocks, six to a unit."""
    units = -(-blocks // 6)
    across = min(units, MOST_ACROSS)
    return across, -(-units // across)


def _head(across: int, down: int, payload: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % payload) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xDD, struct.pack(">H", 1))


_TABLES = {True: _huffman(0x00, DC_CODES), False: _huffman(0x10, AC_CODES)}
_END_TABLE = _huffman(0x10, END_CODES)


def _scan_head(scan: tuple[int, ...]) -> bytes:
    comp, first, last, high, low = scan
    tables = b"" if first == 0 and high else _END_TABLE if high else _TABLES[first == 0]
    return tables + _segment(0xDA, bytes([1, comp + 1, 0x00, first, last, high << 4 | low]))


def _entropy(c: np.ndarray, scan: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, mask): rows of coefficients (n, 64) as one byte-aligned segment each."""
    _, first, last, high, low = scan
    n = len(c)
    if first == 0 and high:
        bits = np.ones((n, 8), np.uint8)
        bits[:, 0] = c[:, 0] & 1
        return np.packbits(bits, axis=1), np.ones((n, 1), bool)
    if first == 0:
        v = c[:, 0].astype(np.int32) >> low
        size = np.zeros(n, np.int32)
        for k in range(8):
            size += np.abs(v) >= 1 << k
        code = (size << 12) | (np.where(v < 0, v + (1 << size) - 1, v) << (12 - size)) | ((1 << (12 - size)) - 1)
        used = (4 + size + 7) // 8
        return np.stack([code >> 8, code & 255], axis=1).astype(np.uint8), np.arange(2)[None, :] < used[:, None]
    band = c[:, first : last + 1]
    if high:
        bits = np.zeros((n, 1 + band.shape[1]), np.uint8)
        bits[:, 1:] = band & 1
    else:
        bits = np.zeros((n, band.shape[1], 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits((band >> low).astype(np.uint8)[:, :, None], axis=2)
        bits = bits.reshape(n, -1)
    pad = -bits.shape[1] % 8
    if pad:
        bits = np.concatenate([bits, np.ones((n, pad), np.uint8)], axis=1)
    out = np.packbits(bits, axis=1)
    return out, np.ones(out.shape, bool)


def _stream(segments: np.ndarray, mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of all segments with restart markers between those of one
    image (``starts``: first segment of each); and where each image begins."""
    n = mask.sum(axis=1)
    data = segments[mask]
    full = data == 255
    seg = np.repeat(np.arange(len(n)), n)
    begins = np.zeros(len(n), bool)
    begins[starts] = True
    marks = np.cumsum(~begins)  # markers up to and with each segment
    place = np.arange(len(data)) + np.cumsum(full) - full + 2 * marks[seg]
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(marks[-1]), np.uint8)
    out[place] = data
    first = place[np.cumsum(n) - n]
    inner = np.flatnonzero(~begins)
    ordinal = np.arange(len(n)) - np.repeat(starts, np.diff([*starts, len(n)]))
    out[first[inner] - 2] = 255
    out[first[inner] - 1] = 0xD0 + (ordinal[inner] - 1) % 8
    return out, np.append(first[starts], len(out))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive stream for each payload (lengths: multiples of 64)."""
    shapes = [_geometry(len(p) // 64) for p in payloads]
    parts: list[list[np.ndarray]] = [[], [], []]
    for p, (w, h) in zip(payloads, shapes, strict=True):
        units = w * h
        x = np.full(units * 384, 255, np.uint8)
        x[: len(p)] = np.frombuffer(p, np.uint8)
        c = x.reshape(-1, 64).astype(np.int16) + 256
        c[:, 0] -= 384
        for k, (a, b) in enumerate(((0, 4), (4, 5), (5, 6))):
            parts[k].append(c[a * units : b * units])
    comps = [np.concatenate(p) for p in parts]
    starts = [np.cumsum([0] + [len(x) for x in p])[:-1] for p in parts]
    out = [[_head(w, h, len(p))] for p, (w, h) in zip(payloads, shapes, strict=True)]
    for scan in SCANS:
        data, at = _stream(*_entropy(comps[scan[0]], scan), starts[scan[0]])
        head, raw = _scan_head(scan), data.tobytes()
        for k, o in enumerate(out):
            o.append(head)
            o.append(raw[at[k] : at[k + 1]])
    return [b"".join(o) + b"\xff\xd9" for o in out]


@dataclass
class Image:
    height: int = 0
    width: int = 0
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    note: bytes = b""
    grid: list[tuple[int, int]] = field(default_factory=list)  # blocks down, across, by component
    at: list[int] = field(default_factory=list)  # first row of each component in the coefficient array


@dataclass
class Scan:
    image: int
    comp: int
    first: int
    last: int
    high: int
    low: int
    interval: int
    table: bytes
    begin: int
    end: int
    mixed: tuple[tuple[int, bytes], ...] = ()  # (component, table) of a scan that interleaves several


def _grid(im: Image) -> None:
    hm, vm = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    for _, h, v, _ in im.comps:
        im.grid.append((-(-(-(-im.height * v // vm)) // 8), -(-(-(-im.width * h // hm)) // 8)))


_OTHER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def _parse(data: bytes, index: int, base: int) -> tuple[Image, list[Scan]]:
    try:
        return _parsed(data, index, base)
    except (IndexError, AttributeError, KeyError, struct.error) as e:
        raise ValueError(f"a cut or broken JPEG stream ({type(e).__name__})") from None


def _parsed(data: bytes, index: int, base: int) -> tuple[Image, list[Scan]]:
    im, scans, tables, interval, at = Image(), [], {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xD9:
            if not im.comps or not scans:
                raise ValueError("no frame or no scan")
            return im, scans
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE:
            im.note = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                if len(body) < k + 1 + 64 * (1 + wide):
                    raise ValueError("a cut quantiser table")
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
                im.quant[body[k] & 15] = q.astype(float)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC2:
            im.height, im.width = struct.unpack(">HH", body[1:5])
            im.comps = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not im.height or not im.width or len(im.comps) not in (1, 3) or any(not 1 <= f <= 4 for c in im.comps for f in c[1:3]):
                raise ValueError("a frame of no size or of other than one or three components")
            _grid(im)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                m = 17 + sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + m]
                k += m
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            names = [c[0] for c in im.comps]
            parts = [(names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            first, last, both = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            if last > 63 or first > last or (first == 0) != (last == 0) or len(parts) > 1 and first:
                raise ValueError("a scan of a band that progressive frames don't have")
            table = lambda slots: tables.get(slots >> 4 if first == 0 else 0x10 | slots & 15, b"")  # noqa: E731, B023
            if not both >> 4 and not all(len(table(slots)) > 16 for _, slots in parts):
                raise ValueError("a scan without its table")
            found = _OTHER.search(data, at)
            if not found:
                raise ValueError("a stream without an end")
            mixed = tuple((c, table(slots)) for c, slots in parts) if len(parts) > 1 else ()
            scans.append(Scan(index, parts[0][0], first, last, both >> 4, both & 15, interval, table(parts[0][1]), base + at, base + found.start(), mixed))
            at = found.start()
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive Huffman frame")


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next 16 bits."""
    if table not in _LOOKUPS:
        symbol, length = np.zeros(1 << 16, np.int64), np.full(1 << 16, 17, np.int64)
        code, k = 0, 16
        for bits in range(1, 17):
            for _ in range(table[bits - 1]):
                a = code << (16 - bits)
                symbol[a : a + (1 << (16 - bits))] = table[k]
                length[a : a + (1 << (16 - bits))] = bits
                code, k = code + 1, k + 1
            code <<= 1
        _LOOKUPS[table] = symbol, length
    return _LOOKUPS[table]


class _Bits:
    """Bits of unstuffed data at many places at once."""

    def __init__(self, data: np.ndarray) -> None:
        x = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
        self.words = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n (0 to 16) bits at bit places ``at``."""
        return (self.words[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v)


def _dc(co: np.ndarray, bits: _Bits, at: np.ndarray, row: np.ndarray, end: np.ndarray, s: Scan) -> None:
    pred = np.zeros(len(at), np.int64)
    while len(at):
        if s.high:
            co[row, 0] |= (bits.peek(at, 1) << s.low).astype(np.int16)
            at = at + 1
        else:
            sym, length = _lookup(s.table)
            v = bits.peek(at, 16)
            size = sym[v]
            at = at + length[v]
            pred = pred + np.where(size > 0, _extend(bits.peek(at, size), size), 0)
            at += size
            co[row, 0] = pred << s.low
        row = row + 1
        go = row < end
        at, row, end, pred = at[go], row[go], end[go], pred[go]


def _units(im: Image, mixed: tuple[tuple[int, bytes], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(units, blocks of a unit): the coefficient row of each block of each
    coded unit of an interleaved scan, -1 beyond the component's edge; and
    which of the scan's components each block of a unit belongs to."""
    hm, vm = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    across, down = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
    my, mx = np.divmod(np.arange(across * down), across)
    rows, which = [], []
    for k, (c, _) in enumerate(mixed):
        _, h, v, _ = im.comps[c]
        high, wide = im.grid[c]
        for y in range(v):
            for x in range(h):
                r, q = my * v + y, mx * h + x
                rows.append(np.where((r < high) & (q < wide), im.at[c] + r * wide + q, -1))
                which.append(k)
    return np.stack(rows, axis=1), np.array(which)


def _dc_mixed(co: np.ndarray, bits: _Bits, at: np.ndarray, im: Image, s: Scan) -> None:
    """A DC scan of several components; ``at``: where each restart interval begins."""
    rows, which = _units(im, s.mixed)
    step = s.interval or len(rows)
    if len(at) != -(-len(rows) // step):
        raise ValueError("restart intervals don't match the frame")
    first = np.arange(len(at)) * step
    pred = np.zeros((len(at), len(s.mixed)), np.int64)
    for unit in range(min(step, len(rows))):
        go = first + unit < len(rows)
        for block, k in enumerate(which):
            place = at[go]
            if s.high:
                value = bits.peek(place, 1) << s.low
                place = place + 1
            else:
                sym, length = _lookup(s.mixed[k][1])
                v = bits.peek(place, 16)
                size = sym[v]
                place = place + length[v]
                pred[go, k] += np.where(size > 0, _extend(bits.peek(place, size), size), 0)
                place = place + size
                value = pred[go, k] << s.low
            at[go] = place
            row = rows[first[go] + unit, block]
            in_ = row >= 0
            if s.high:
                co[row[in_], 0] |= value[in_].astype(np.int16)
            else:
                co[row[in_], 0] = value[in_]


def _ac_first(co: np.ndarray, bits: _Bits, at: np.ndarray, row: np.ndarray, end: np.ndarray, s: Scan) -> None:
    sym, length = _lookup(s.table)
    k = np.full(len(at), s.first)
    while len(at):
        v = bits.peek(at, 16)
        code = sym[v]
        run, size = code >> 4, code & 15
        at = at + length[v]
        value = size > 0
        band = ~value & (run < 15)
        extra = np.where(value, size, np.where(band, run, 0))
        v = bits.peek(at, extra)
        at += extra
        k = k + run
        hit = np.flatnonzero(value)
        co[row[hit], k[hit]] = _extend(v[hit], size[hit]) << s.low
        k += 1
        over = band | (k > s.last)
        row = row + np.where(band, (1 << run) + v, over)
        k = np.where(over, s.first, k)
        if over.any():
            go = row < end
            if not go.all():
                at, row, end, k = at[go], row[go], end[go], k[go]


def _ac_refine(co: np.ndarray, bits: _Bits, at: np.ndarray, row: np.ndarray, end: np.ndarray, s: Scan) -> None:
    sym, length = _lookup(s.table)
    n = len(at)
    k, run, new, inside, band = np.full(n, s.first), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    one = 1 << s.low
    at = at.copy()
    while len(at):
        ask = np.flatnonzero(~inside & (band == 0))
        if len(ask):
            v = bits.peek(at[ask], 16)
            code = sym[v]
            r, size = code >> 4, code & 15
            at[ask] += length[v]
            ends = (size == 0) & (r < 15)
            extra = np.where(ends, r, size)
            v = bits.peek(at[ask], extra)
            at[ask] += extra
            band[ask] = np.where(ends, (1 << r) + v, 0)
            inside[ask] = ~ends
            run[ask] = r
            new[ask] = np.where(size > 0, np.where(v > 0, one, -one), 0)
        c = co[row, k].astype(np.int64)
        old = c != 0
        bit = np.where(old, bits.peek(at, 1), 0)
        at += old
        put = ~old & inside & (run == 0)
        co[row, k] = c + np.where(old, np.sign(c) * bit * one, np.where(put, new, 0))
        run -= ~old & inside
        inside &= ~put
        k = k + 1
        over = k > s.last
        if over.any():
            row = row + over
            band -= over & (band > 0)
            inside &= ~over
            k[over] = s.first
            go = row < end
            if not go.all():
                at, row, end, k, run, new, inside, band = (x[go] for x in (at, row, end, k, run, new, inside, band))


def decode_coefficients(streams: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The frames, and the coefficients (blocks, 64) in zigzag order of all
    components of all of them, accumulated over all scans."""
    images, groups, base, rows = [], {}, 0, 0
    for k, data in enumerate(streams):
        im, scans = _parse(data, k, base)
        if not set(c[3] for c in im.comps) <= set(im.quant):
            raise ValueError("a component without its quantiser")
        for down, across in im.grid:
            im.at.append(rows)
            rows += down * across
        images.append(im)
        for number, s in enumerate(scans):
            groups.setdefault((number, s.first, s.last, s.high, s.low, s.table, s.mixed, k if s.mixed else -1), []).append(s)
        base += len(data)
    raw = np.frombuffer(b"".join(streams), np.uint8)
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    moved = np.cumsum(stuffed)
    bits = _Bits(raw[~stuffed])
    restart = np.zeros(len(raw), bool)
    restart[:-1] = (raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
    restarts = np.flatnonzero(restart)
    co = np.zeros((rows, 64), np.int16)
    for key in sorted(groups, key=lambda g: g[0]):
        scans = groups[key]
        begin, end = np.array([s.begin for s in scans]), np.array([s.end for s in scans])
        a, b = np.searchsorted(restarts, begin), np.searchsorted(restarts, end)
        n = b - a + 1
        own = np.repeat(np.arange(len(scans)), n)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        place = begin[own]
        later = inner > 0
        place[later] = restarts[(a[own] + inner - 1)[later]] + 2
        if scans[0].mixed:
            _dc_mixed(co, bits, (place - moved[place]) * 8, images[scans[0].image], scans[0])
            continue
        total = np.array([images[s.image].grid[s.comp][0] * images[s.image].grid[s.comp][1] for s in scans])
        step = np.array([s.interval or t for s, t in zip(scans, total, strict=True)])
        first = np.array([images[s.image].at[s.comp] for s in scans])
        row = first[own] + inner * step[own]
        last = np.minimum(row + step[own], first[own] + total[own])
        at = (place - moved[place]) * 8
        s = scans[0]
        (_dc if s.first == 0 else _ac_refine if s.high else _ac_first)(co, bits, at, row, last, s)
    return images, co


def inverse_transform(images: list[Image], co: np.ndarray) -> np.ndarray:
    """Samples (blocks, 64) of 8 bits of all components of all images."""
    out = np.empty((len(co), 64), np.uint8)
    natural = np.empty((min(len(co), 4096), 64))
    scale = np.ones((len(co), 64)) if any((q != 1).any() for im in images for q in im.quant.values()) else None
    if scale is not None:
        for im in images:
            for (_, _, _, t), (down, across), at in zip(im.comps, im.grid, im.at, strict=True):
                scale[at : at + down * across] = im.quant[t]
    for at in range(0, len(co), 4096):
        part = co[at : at + 4096] if scale is None else co[at : at + 4096] * scale[at : at + 4096]
        natural[: len(part), ZIGZAG] = part
        x = natural[: len(part)] @ BASIS
        x += 128.5 + 1e-6  # beyond rounding differences of matrix products
        np.clip(x, 0, 255, out=x)
        out[at : at + 4096] = x  # truncated
    return out


_CENTRED = np.arange(256) - 128.0
_RED, _GREEN_B, _GREEN_R, _BLUE = (np.rint(f * _CENTRED).astype(np.int16) for f in (1.402, -0.344136, -0.714136, 1.772))


def to_rgb(im: Image, samples: np.ndarray) -> np.ndarray:
    """(height, width, 3) of 8 bits from the samples of inverse_transform."""
    hm, vm = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    planes, factors = [], []
    for (_, h, v, _), (down, across), at in zip(im.comps, im.grid, im.at, strict=True):
        planes.append(samples[at : at + down * across].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across))
        factors.append((vm // v, hm // h))

    def full(x: np.ndarray, by: tuple[int, int]) -> np.ndarray:
        """Chroma upsampling: each value repeated ``by`` down and across."""
        if by != (1, 1):
            x = np.repeat(np.repeat(x, by[1], axis=1), by[0], axis=0)
        return x[: im.height, : im.width]

    y = full(planes[0], factors[0])
    if len(planes) == 1:
        return np.stack([y, y, y], axis=2)
    y = y.astype(np.int16)
    cb, cr = planes[1:]
    out = np.empty((im.height, im.width, 3), np.uint8)
    green = full(_GREEN_B[cb] + _GREEN_R[cr], factors[1]) if factors[1] == factors[2] else full(_GREEN_B[cb], factors[1]) + full(_GREEN_R[cr], factors[2])
    for k, add in enumerate((full(_RED[cr], factors[2]), green, full(_BLUE[cb], factors[1]))):
        out[:, :, k] = np.clip(y + add, 0, 255)
    return out


def payload_of(im: Image, co: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    rows = co[im.at[0] : im.at[-1] + im.grid[-1][0] * im.grid[-1][1]].copy()
    rows[:, 0] += 384
    return (rows - 256).astype(np.uint8).tobytes()[: int(im.note.split()[1])]


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _grouped(sizes: list[int]) -> Iterator[slice]:
    at = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= BATCH:
            yield slice(at, k + 1)
            at, total = k + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media: binary): texts as padded UTF-8 in a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _grouped([len(t.as_py()) for t in b.column(1)]):
                raws = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)[part]]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array([len(r) for r in raws], pa.int64()), pa.array(encode_payloads([padded(r) for r in raws]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensors(streams: list[bytes]) -> list[tuple[int, int, bytes] | str]:
    """(height, width, RGB bytes) of each stream, or why it can't be read."""
    try:
        images, co = decode_coefficients(streams)
        samples = inverse_transform(images, co)
        return [(im.height, im.width, to_rgb(im, samples).tobytes()) for im in images]
    except (ValueError, IndexError) as e:
        if len(streams) == 1:
            return [str(e) if isinstance(e, ValueError) else "coded data that don't keep to the syntax"]
    return [t for s in streams for t in tensors([s])]


def decode_rgb(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, height, width, rgb: binary, error): full-resolution tensors; a
    stream that can't be read, or null, has no tensor but an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            for part in _grouped([len(m or b"") for m in data]):
                out: list = ["no stream"] * (part.stop - part.start)
                have = [k for k, m in enumerate(data[part]) if m is not None]
                for k, t in zip(have, tensors([data[part][k] for k in have]) if have else [], strict=True):
                    out[k] = t
                got = [(*t, None) if isinstance(t, tuple) else (None, None, None, t) for t in out]
                cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], *cols], ["doc_id", "height", "width", "rgb", "error"])

    rows = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media"))
    return rows.mapInArrow(run, "doc_id long, height int, width int, rgb binary, error string")


def media_digests(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): digests of the payload read back, and a
    feature: size, mean colour and checksum of the RGB tensor."""

    def row(data: bytes, im: Image, co: np.ndarray, samples: np.ndarray) -> tuple:
        p, rgb = payload_of(im, co), to_rgb(im, samples)
        mean = ",".join(f"{s / (im.height * im.width):.3f}" for s in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist())
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{im.height}x{im.width}:{mean}:{zlib.crc32(rgb.tobytes()):08x}"

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(2).to_pylist()
            for part in _grouped([len(m) for m in data]):
                images, co = decode_coefficients(data[part])
                samples = inverse_transform(images, co)
                out = list(zip(*(row(m, im, co, samples) for m, im in zip(data[part], images, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
