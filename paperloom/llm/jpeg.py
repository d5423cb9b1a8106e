"""Media columns in progressive JPEG.

A payload's bytes are stored as quantised coefficients, the format's unit, so that nothing is
lost: each block of 64 bytes is one block of coefficients, in zigzag order, of a 4:2:0 colour
image. Spectral-selection and successive-approximation scans are read into coefficient arrays
in lockstep: one symbol of every restart interval of many images at a time. Coefficients are
inverse-transformed with exact integer sums, chroma is upsampled, and full-resolution RGB
tensors come out. The reader takes any Huffman-coded progressive image of 8-bit samples in one
or three components; the writer writes payloads alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_rows, in_arrow, ragged

#: Blocks between restart markers, and bytes of media that a step handles at once.
RESTART, STEP = 2, 3 << 19
_TAG = b"payload:"

ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))

#: Code lengths of the writer's Huffman tables by symbol: (DC differences), (AC, first scans), (AC, refinement).
_DC = {s: 4 for s in range(9)}
_AC = {4: 2, 3: 2, 6: 3, 5: 3, 7: 4, 2: 5, 1: 6, 0: 7}
_FINE = {0: 1}
#: Components of scans with their first and last coefficient, and successive-approximation bits high and low.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 32, 0, 1), ((0,), 33, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in code order, and (code, length) by symbol: JPEG's canonical codes."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return counts, symbols, _canonical(counts, symbols)


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, int]) -> bytes:
    counts, symbols, _ = _codes(lengths)
    return bytes([kind << 4 | number, *counts, *symbols])


# --- writing ---------------------------------------------------------------------------------

_VALUE = np.array([b - 126 if b >= 128 else b - 129 for b in range(256)], np.int64)  # never -1, 0 or 1
_HALF = np.sign(_VALUE) * (np.abs(_VALUE) >> 1)


def _value_code(value: int, codes: dict[int, tuple[int, int]]) -> tuple[int, int]:
    size = abs(value).bit_length()
    code, n = codes[size]
    return code << size | (value if value >= 0 else value + (1 << size) - 1), n + size


_AC_CODE = np.array([_value_code(int(v), _codes(_AC)[2]) for v in _HALF], np.int64)
#: Codes of two coefficients in a row, by 256 times the first's byte and the second's; those of one follow.
_PAIR_LENGTH = np.append((_AC_CODE[:, None, 1] + _AC_CODE[None, :, 1]).ravel(), _AC_CODE[:, 1])
_PAIR_CODE = np.append(((_AC_CODE[:, None, 0] << _AC_CODE[None, :, 1]) | _AC_CODE[None, :, 0]).ravel(), _AC_CODE[:, 0]).astype(np.uint64)
_DC_CODE = np.array([_value_code(v, _codes(_DC)[2]) for v in range(-255, 256)], np.uint64)


_TABLES = _table(0, 0, _DC) + _table(1, 0, _AC) + _table(1, 1, _FINE)


def _header(n_mcu: tuple[int, int], n_bytes: int) -> bytes:
    width, height = n_mcu[0] * 16, n_mcu[1] * 16
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, _TAG + struct.pack(">Q", n_bytes)) + _segment(0xDB, bytes(1) + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, _TABLES) + _segment(0xDD, struct.pack(">H", RESTART))


def _scan_header(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *[x for c in components for x in (c + 1, int(high > 0 and first > 0))], first, last, high << 4 | low]))


def _bit_segments(segment: np.ndarray, code: np.ndarray, length: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, filled up with ones, and each one's first byte and the end. Codes are ordered by segment; up to 32 bits each."""
    bits = np.bincount(segment, length, n_segments).astype(np.int64)
    size = -(-bits // 8)
    starts = np.concatenate(([0], np.cumsum(size)))
    before = np.cumsum(length) - length
    first = np.cumsum(bits) - bits
    pad = 8 * size - bits
    at = before - first[segment] + 8 * starts[segment]
    words = np.zeros(int(starts[-1]) // 4 + 3, np.uint64)
    for where, value, n in ((at, code, length), (8 * starts[1:] - pad, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1), pad)):
        if not len(where):
            continue
        value = value << (64 - (where & 31) - n).astype(np.uint64) if len(value) else value
        word = where >> 5
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
        words[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    return words.astype(">u4").view(np.uint8)[: starts[-1]], starts


def encode(payload: np.ndarray, blocks: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Media of many payloads. payload: all their bytes, ``blocks`` of 64 for each; returns all media bytes and where each begins."""
    images = len(blocks)
    mcus = -(-blocks // 6)
    wide = np.ceil(np.sqrt(mcus)).astype(np.int64)
    tall = -(-mcus // wide)
    area = wide * tall
    data = payload.reshape(-1, 64)
    base = np.cumsum(blocks) - blocks
    # data blocks of a component lie together: luma first, then either chroma
    filled = [np.minimum(blocks, 4 * area), np.clip(blocks - 4 * area, 0, area), np.clip(blocks - 5 * area, 0, area)]
    first = [base, base + 4 * area, base + 5 * area]
    total = [4 * area, area, area]
    parts = []
    for components, low, high, ah, _ in SCRIPT:
        if low == 0:
            segments = -(-area // RESTART)
            code, length, unit = _dc_codes(data, wide, area, base, blocks, ah)
            per = 6
        else:
            c = components[0]
            segments = -(-total[c] // RESTART)
            code, length, unit = (_fine_codes if ah else _ac_codes)(data[ragged(first[c], filled[c])], filled[c], total[c], low, high)
            per = 1
        # unit: the running number of each code's block (in MCUs' order) in all images' scans
        count = total[components[0]] if per == 1 else 6 * area
        image = np.repeat(np.arange(images), count)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        segment_of_unit = (np.cumsum(segments) - segments)[image] + within // (per * RESTART)
        parts.append((*_bit_segments(segment_of_unit[unit], code, length, int(segments.sum())), segments))
    return _assembled(parts, wide, tall, n_bytes)


def _ac_codes(data: np.ndarray, filled: np.ndarray, total: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    end = _codes(_AC)[2][0]
    start = np.cumsum(total) - total
    has = np.zeros(int(total.sum()), bool)
    has[ragged(start, filled)] = True
    pairs = data[:, low : high + 1 - (high - low + 1) % 2 : 2].astype(np.int64)
    pairs <<= 8
    pairs |= data[:, low + 1 : high + 1 - (high - low + 1) % 2 : 2]
    if (high - low) % 2 == 0:
        pairs = np.concatenate((pairs, 65536 + data[:, high : high + 1].astype(np.int64)), axis=1)
    owner = np.repeat(np.arange(len(has)), np.where(has, pairs.shape[1], 1))
    if has.all():
        pairs = pairs.ravel()
        return _PAIR_CODE[pairs], _PAIR_LENGTH[pairs], owner
    coded = has[owner]
    code = np.full(len(owner), np.uint64(end[0]))
    length = np.full(len(owner), end[1], np.int64)
    code[coded], length[coded] = _PAIR_CODE[pairs.ravel()], _PAIR_LENGTH[pairs.ravel()]
    return code, length, owner


def _fine_codes(data: np.ndarray, filled: np.ndarray, total: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's end-of-block code, one zero bit, then the lowest bit of each of its coefficients: two halves of 32 bits."""
    start = np.cumsum(total) - total
    has = np.zeros(int(total.sum()), bool)
    has[ragged(start, filled)] = True
    owner = np.repeat(np.arange(len(has)), np.where(has, 2, 1))
    bits = (np.abs(_VALUE) & 1).astype(np.uint8)[data]
    bits[:, 0] = 0
    code = np.zeros(len(owner), np.uint64)
    code[has[owner]] = np.packbits(bits, axis=1).view(">u4").ravel()
    return code, np.where(has, 32, 1)[owner].astype(np.int64), owner


def _dc_codes(data: np.ndarray, wide: np.ndarray, area: np.ndarray, base: np.ndarray, blocks: np.ndarray, ah: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    image = np.repeat(np.arange(len(area)), area)
    mcu = np.arange(len(image)) - np.repeat(np.cumsum(area) - area, area)
    row, col = mcu // wide[image], mcu % wide[image]
    left = 2 * row * 2 * wide[image] + 2 * col
    place = np.stack([left, left + 1, left + 2 * wide[image], left + 2 * wide[image] + 1, 4 * area[image] + mcu, 5 * area[image] + mcu], axis=1)
    there = place < blocks[image][:, None]
    value = np.zeros(place.shape, np.int64)
    value[there] = _VALUE[data[(base[image][:, None] + place)[there], 0]]
    n = place.size
    if ah:
        return (value & 1).ravel().astype(np.uint64), np.ones(n, np.int64), np.arange(n)
    value >>= 1
    diff = value.copy()
    diff[:, 1:4] -= value[:, 0:3]
    fresh = mcu % RESTART == 0  # predictions begin anew after a restart marker
    before = np.where(fresh[1:, None], 0, value[:-1][:, [3, 4, 5]])
    diff[1:, [0, 4, 5]] -= before
    found = _DC_CODE[diff.ravel() + 255]
    return found[:, 0], found[:, 1].astype(np.int64), np.arange(n)


def _assembled(parts: list, wide: np.ndarray, tall: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    images, heads = len(wide), [_scan_header(*x) for x in SCRIPT]
    header = np.frombuffer(b"".join(_header((int(w), int(h)), int(n)) for w, h, n in zip(wide, tall, n_bytes, strict=True)), np.uint8).reshape(images, -1)
    stuffed, sizes = [], np.zeros((images, len(parts)), np.int64)
    for k, (data, starts, segments) in enumerate(parts):
        ff = np.concatenate(([0], np.cumsum(data == 255)))
        size = np.diff(starts) + ff[starts[1:]] - ff[starts[:-1]]
        image = np.repeat(np.arange(images), segments)
        sizes[:, k] = np.bincount(image, size, images).astype(np.int64) + 2 * (segments - 1)
        stuffed.append((ff, size, image))
    whole = header.shape[1] + sum(map(len, heads)) + sizes.sum(axis=1) + 2
    begin = np.concatenate(([0], np.cumsum(whole)))
    out = np.zeros(int(begin[-1]), np.uint8)
    at = begin[:-1].copy()
    out[at[:, None] + np.arange(header.shape[1])] = header
    at += header.shape[1]
    for k, ((data, starts, segments), (ff, size, image), head) in enumerate(zip(parts, stuffed, heads, strict=True)):
        out[at[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
        at += len(head)
        number = np.arange(len(image)) - (np.cumsum(segments) - segments)[image]
        before = np.cumsum(size) - size
        place = at[image] + before - before[(np.cumsum(segments) - segments)][image] + 2 * number
        of = np.repeat(np.arange(len(image)), np.diff(starts))
        out[np.arange(len(data)) - starts[of] + ff[:-1] - ff[starts[of]] + place[of]] = data
        marked = number > 0
        out[place[marked] - 2], out[place[marked] - 1] = 255, 0xD0 + (number[marked] - 1) % 8
        at += sizes[:, k]
    out[at], out[at + 1] = 255, 0xD9
    return out, begin


# --- reading ---------------------------------------------------------------------------------


@dataclass
class _Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks, as they are stored: whole MCUs
    tall: int = 0
    own_wide: int = 0  # blocks that scans of this component alone have
    own_tall: int = 0
    base: int = 0  # its first row in the coefficient array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[_Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)
    mcu_wide: int = 0
    mcu_tall: int = 0


def _parsed(data: bytes, at: int, marks: np.ndarray, ids: list[int]) -> Image:
    image, tables, restart = Image(), {}, 0
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at += 2
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            image.height, image.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            image.components = [_Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            ids[:] = [body[6 + 3 * k] for k in range(body[5])]
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            image.mcu_wide, image.mcu_tall = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            for c in image.components:
                c.wide, c.tall = image.mcu_wide * c.h, image.mcu_tall * c.v
                c.own_wide, c.own_tall = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only Huffman-coded progressive images are read")
        elif marker == 0xDA:
            n = body[0]
            which = tuple(ids.index(body[1 + 2 * k]) for k in range(n))
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            if first == 0:
                used = tuple(tables.get(body[2 + 2 * k] >> 4, b"") for k in range(n))
            else:
                used = (tables[16 | body[2] & 15],)
            stop = int(marks[np.searchsorted(marks, at)])
            image.scans.append((which, first, last, high, low, used, restart, at, stop))
            at = stop


_LOOKUPS: dict[tuple[bytes, bool], np.ndarray] = {}


def _lookup(table: bytes, ac: bool) -> np.ndarray:
    """By the next 16 bits: bits of the code (5), further bits (4), coefficients to go on (5), kind (2): 0 value, 1 end of blocks, 2 none; -1: no code."""
    key = (table, ac)
    if key not in _LOOKUPS:
        out = np.full(65536, -1, np.int64)
        for symbol, (code, n) in _canonical(list(table[:16]), list(table[16:])).items():
            run, size = symbol >> 4, symbol & 15
            if not ac:
                entry = n | symbol << 5
            elif size:
                entry = n | size << 5 | (run + 1) << 9
            elif run < 15:
                entry = n | run << 5 | 1 << 14
            else:
                entry = n | 16 << 9 | 2 << 14
            out[code << (16 - n) : (code + 1) << (16 - n)] = entry
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[key] = out
    return _LOOKUPS[key]


class _Bits:
    """Entropy-coded bytes without stuffing, as 64-bit windows at each byte."""

    def __init__(self, data: np.ndarray):
        pad = np.concatenate((data, np.full(16, 255, np.uint8)))
        self.words = np.ndarray((len(pad) - 7,), ">u8", pad, 0, (1,)).astype(np.uint64)
        self.last = 8 * (len(data) + 8)
        self.data = data
        self._single = None

    def at(self, bit: np.ndarray) -> np.ndarray:
        bit = np.minimum(bit, self.last)
        return self.words[bit >> 3] << (bit & 7).astype(np.uint64)

    @property
    def single(self) -> np.ndarray:
        if self._single is None:
            self._single = np.concatenate((np.unpackbits(self.data), np.zeros(128, np.uint8)))
        return self._single


def _entries(table: np.ndarray, window: np.ndarray) -> np.ndarray:
    entry = table[(window >> np.uint64(48)).astype(np.int64)]
    if len(entry) and entry.min() < 0:
        raise ValueError("a bit sequence that is no code of its table")
    return entry


def _further(window: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extended(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    return value + (value < (1 << n >> 1)) * (1 - (1 << n))


def _first_ac(bits: _Bits, at: np.ndarray, block: np.ndarray, stop: np.ndarray, coef: np.ndarray, place, table: np.ndarray, low: int, high: int, shift: int) -> None:
    flat = coef.reshape(-1)
    k = np.full(len(at), low, np.int64)
    on = np.flatnonzero(block < stop)
    at, block, stop, k = at[on], block[on], stop[on], k[on]
    while len(at):
        window = bits.at(at)
        entry = _entries(table, window)
        length, n, kind = entry & 31, entry >> 5 & 15, entry >> 14
        value = _further(window, length, n)
        at = at + length + n
        k = k + (entry >> 9 & 31)
        if kind.any():
            plain = np.flatnonzero(kind == 0)
            if (k[plain] > high + 1).any():
                raise ValueError("a coefficient beyond its scan")
            flat[place(block[plain]) * 64 + k[plain] - 1] = _extended(value[plain], n[plain]) << shift
            end = kind == 1
            block = block + np.where(end, (1 << n) + value, 0)
            k = np.where(end, low, k)
        else:
            if (k > high + 1).any():
                raise ValueError("a coefficient beyond its scan")
            flat[place(block) * 64 + k - 1] = _extended(value, n) << shift
        over = k > high
        if over.any():
            block = block + over
            k = np.where(over, low, k)
            on = block < stop
            if not on.all():
                at, block, stop, k = at[on], block[on], stop[on], k[on]
        elif kind.any():
            on = block < stop
            at, block, stop, k = at[on], block[on], stop[on], k[on]


def _fine_ac(bits: _Bits, at: np.ndarray, block: np.ndarray, stop: np.ndarray, coef: np.ndarray, place, table: np.ndarray, low: int, high: int, shift: int) -> None:
    span = np.arange(low, high + 1)
    k = np.full(len(at), low, np.int64)
    ending = np.zeros(len(at), np.int64)  # blocks whose end is known
    on = np.flatnonzero(block < stop)
    at, block, stop, k, ending = at[on], block[on], stop[on], k[on], ending[on]
    single = bits.single
    while len(at):
        asks = np.flatnonzero(ending == 0)
        zeros = np.full(len(at), 99, np.int64)  # zero coefficients to pass before the place
        new = np.zeros(len(at), np.int64)
        if len(asks):
            window = bits.at(at[asks])
            entry = _entries(table, window)
            length, n, kind = entry & 31, entry >> 5 & 15, entry >> 14
            value = _further(window, length, n)
            at[asks] += length + n
            ending[asks] = np.where(kind == 1, (1 << n) + value, 0)
            zeros[asks] = np.where(kind == 1, 99, np.where(kind == 2, 15, (entry >> 9 & 31) - 1))
            new[asks] = np.where(kind == 0, np.where(value == 1, 1, -1) << shift, 0)
        row = place(block)
        now = coef[row, low : high + 1]
        todo = span >= k[:, None]
        old = (now != 0) & todo
        if (ending > 0).all():
            reach = todo
            target = np.full(len(at), high + 1, np.int64)
        else:
            passed = np.cumsum(~old & todo, axis=1)
            found = (passed == zeros[:, None] + 1) & ~old & todo
            target = np.where(found.any(axis=1), low + found.argmax(axis=1), high + 1)
            reach = span < target[:, None]
        fix = old & reach
        order = np.cumsum(fix, axis=1)
        where = np.minimum(at[:, None] + order - 1, len(single) - 1)
        on_bits = fix & (single[np.where(fix, where, 0)] == 1)
        now = now + on_bits * (np.sign(now) * (1 << shift))
        at = at + order[:, -1]
        put = np.flatnonzero((new != 0) & (target <= high))
        now[put, target[put] - low] = new[put]
        coef[row, low : high + 1] = now
        k = target + 1
        over = (k > high) | (ending > 0)
        ending = np.maximum(ending - 1, 0)
        block = block + over
        k = np.where(over, low, k)
        on = block < stop
        if not on.all():
            at, block, stop, k, ending = at[on], block[on], stop[on], k[on], ending[on]


def decode_coefficients(media: np.ndarray, begin: np.ndarray) -> tuple[list[Image], np.ndarray]:
    """The images in ``media``, each from ``begin``, and their coefficients in zigzag order: a row for each block."""
    after = np.flatnonzero(media[:-1] == 255)
    kinds = media[after + 1]
    resting = (kinds & 0xF8) == 0xD0
    marks, rests = after[(kinds != 0) & (kinds != 255) & ~resting], after[resting]
    keep = np.ones(len(media), bool)
    keep[after[kinds == 0] + 1] = False
    moved = np.concatenate(([0], np.cumsum(keep)))
    bits = _Bits(media[keep])
    data, images, rows = media.tobytes(), [], 0
    for at in begin[:-1]:
        image = _parsed(data, int(at), marks, [])
        for c in image.components:
            c.base, rows = rows, rows + c.wide * c.tall
        images.append(image)
    coef = np.zeros((rows, 64), np.int32)
    for step in range(max((len(x.scans) for x in images), default=0)):
        groups = defaultdict(list)
        for image in images:
            if step < len(image.scans):
                groups[image.scans[step][:6] + tuple((c.h, c.v) for c in image.components)].append((image, image.scans[step]))
        for (which, first, last, high, low, used, *_), members in groups.items():
            _scan(bits, moved, rests, coef, which, first, last, high, low, used, members)
    return images, coef


def _scan(bits, moved, rests, coef, which, first, last, high, low, used, members) -> None:
    alone = len(which) == 1
    if alone:
        units = np.array([x.components[which[0]].own_wide * x.components[which[0]].own_tall for x, _ in members])
    else:
        units = np.array([x.mcu_wide * x.mcu_tall for x, _ in members])
    every = np.array([s[6] or n for (_, s), n in zip(members, units, strict=True)])
    starts, stops = np.array([s[7] for _, s in members]), np.array([s[8] for _, s in members])
    segments = -(-units // every)
    a, b = np.searchsorted(rests, starts), np.searchsorted(rests, stops)
    if ((b - a) < segments - 1).any():
        raise ValueError("too few restart markers")
    owner = np.repeat(np.arange(len(members)), segments)
    number = np.arange(len(owner)) - (np.cumsum(segments) - segments)[owner]
    at = starts[owner]
    later = number > 0
    at[later] = rests[a[owner[later]] + number[later] - 1] + 2
    at = 8 * moved[at]
    from_, to = number * every[owner], np.minimum((number + 1) * every[owner], units[owner])
    if first > 0:
        parts = [x.components[which[0]] for x, _ in members]
        # units of all members get running numbers; place() turns them into rows
        start = np.cumsum(units) - units
        base, wide, own = (np.array([getattr(c, k) for c in parts]) for k in ("base", "wide", "own_wide"))
        if (wide == own).all():
            rows = ragged(base, units)
        else:
            of = np.repeat(np.arange(len(members)), units)
            n = np.arange(len(of)) - start[of]
            rows = base[of] + n // own[of] * wide[of] + n % own[of]
        place = lambda block: rows[block]
        (_fine_ac if high else _first_ac)(bits, at, from_ + start[owner], to + start[owner], coef, place, _lookup(used[0], True), first, last, low)
        return
    # DC: the rows of each unit's blocks, in their order, and the component of each
    shape = [(j, y, x) for j, c in enumerate(which) for y in range(1 if alone else members[0][0].components[c].v) for x in range(1 if alone else members[0][0].components[c].h)]
    of = np.repeat(np.arange(len(members)), units)
    start = np.cumsum(units) - units
    n = np.arange(len(of)) - start[of]
    rows = np.zeros((len(of), len(shape)), np.int64)
    for k, (j, y, x) in enumerate(shape):
        parts = [m.components[which[j]] for m, _ in members]
        base, wide, across = np.array([c.base for c in parts]), np.array([c.wide for c in parts]), np.array([c.own_wide if alone else m.mcu_wide for c, (m, _) in zip(parts, members, strict=True)])
        h, v = (1, 1) if alone else (parts[0].h, parts[0].v)
        rows[:, k] = base[of] + (n // across[of] * v + y) * wide[of] + n % across[of] * h + x
    unit, stop = from_ + start[owner], to + start[owner]
    if high:
        size = (stop - unit) * len(shape)
        bit = bits.single[ragged(at, size)].astype(np.int32)
        coef[rows[ragged(unit, stop - unit)].ravel(), 0] |= bit << low
        return
    tables = [_lookup(x, False) for x in used]
    predicted = np.zeros((len(at), len(which)), np.int64)
    while True:
        on = unit < stop
        if not on.all():
            at, unit, stop, predicted = at[on], unit[on], stop[on], predicted[on]
        if not len(at):
            return
        for k, (j, _, _) in enumerate(shape):
            window = bits.at(at)
            entry = _entries(tables[j], window)
            length, size = entry & 31, entry >> 5
            predicted[:, j] += _extended(_further(window, length, size), size)
            at = at + length + size
            coef[rows[unit, k], 0] = predicted[:, j] << low
        unit = unit + 1


def _basis() -> np.ndarray:
    """The inverse transform of 64 coefficients in zigzag order into 64 samples, in units of 1 / 2^26: sums of integers stay exact in doubles."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.rint(np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5) * 8192)
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return both[ZIGZAG]


_BASIS = _basis()


def tensors(images: list[Image], coef: np.ndarray) -> list[np.ndarray]:
    """RGB of each image, (height, width, 3) of uint8; one component gives grey."""
    out = []
    quants = [(c, q) for image in images for c in image.components if (q := image.quants[c.quant]).max() > 1]
    if quants:
        coef = coef.astype(np.int64)
        for c, q in quants:
            coef[c.base : c.base + c.wide * c.tall] *= q
    samples = np.empty(coef.shape, np.int16)
    for k in range(0, len(coef), 2048):
        part = coef[k : k + 2048].astype(np.float64) @ _BASIS
        part *= 2.0**-26
        part += 128.5
        np.clip(np.floor(part, out=part), 0, 255, out=part)
        samples[k : k + 2048] = part
    for image in images:
        h, v = max(c.h for c in image.components), max(c.v for c in image.components)
        planes = [samples[c.base : c.base + c.wide * c.tall].reshape(c.tall, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.tall, 8 * c.wide) for c in image.components]
        rgb = np.empty((image.height, image.width, 3), np.uint8)
        full = lambda x, c: _upsampled(x, h // c.h, v // c.v)[: image.height, : image.width]
        y = full(planes[0], image.components[0])
        if len(planes) == 1:
            rgb[:] = y[:, :, None]
        else:
            # what chroma adds is found before it is upsampled
            cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
            b, r = image.components[1:]
            for k, x in enumerate((full(_part(91881 * cr), r), full(_part(-22554 * cb), b) + full(_part(-46802 * cr), r), full(_part(116130 * cb), b))):
                np.clip(y + x, 0, 255, out=rgb[:, :, k], casting="unsafe")
        out.append(rgb)
    return out


def _part(x: np.ndarray) -> np.ndarray:
    return ((x + 32768) >> 16).astype(np.int16)


def _upsampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    if across > 1:
        plane = plane.repeat(across, axis=1)
    return plane.repeat(down, axis=0) if down > 1 else plane


def payloads(images: list[Image], coef: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(unpadded bytes, payload) of images that ``encode`` wrote."""
    first = coef[:, :1] != 0
    stored = np.where(coef > 0, coef + 126, coef + 129).astype(np.uint8)
    out = []
    for image in images:
        if not image.comment.startswith(_TAG):
            raise ValueError("an image without a payload")
        n = struct.unpack(">Q", image.comment[len(_TAG) :])[0]
        blocks = n // 64 + 1 if n % 64 or not n else n // 64
        rows = image.components[0].base
        if not first[rows : rows + blocks].all():
            raise ValueError("a payload's block is missing")
        out.append((n, stored[rows : rows + blocks].ravel()))
    return out


# --- columns ---------------------------------------------------------------------------------


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each text's UTF-8 bytes, zeros up to a positive multiple of 64, as an image.

    A null text counts as empty and is 64 zeros. Equal texts give equal media. Repeated rows
    stay, an empty table gives an empty one; columns but doc_id and text are left out.
    """

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            data, at = byte_rows(batch.column("text"))
            n = np.diff(at)
            blocks = np.maximum(-(-n // 64), 1)
            start = 64 * (np.cumsum(blocks) - blocks)
            payload = np.zeros(64 * int(blocks.sum()), np.uint8)
            payload[ragged(start, n)] = data
            media, begin = encode(payload, blocks, n)
            raw = memoryview(media)
            return {"doc_id": batch.column("doc_id"), "media": [bytes(raw[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, media binary", step_bytes=STEP)


def _read(batch: pa.RecordBatch):
    media, begin = byte_rows(batch.column("media"))
    images, coef = decode_coefficients(media, begin)
    return media, begin, images, coef


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, height, width, rgb binary) of (doc_id, media): the payload with its zeros and the RGB tensor, by rows."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            _, _, images, coef = _read(batch)
            found = payloads(images, coef)
            return {"doc_id": batch.column("doc_id"), "n_bytes": [n for n, _ in found], "payload": [x.tobytes() for _, x in found], "height": [x.height for x in images], "width": [x.width for x in images], "rgb": [x.tobytes() for x in tensors(images, coef)]}

        return step

    return in_arrow(media, begin, "doc_id long, n_bytes long, payload binary, height int, width int, rgb binary", weigh="media", step_bytes=STEP)


def digests(media: DataFrame) -> DataFrame:
    """``decode_media`` reduced to sizes, hashes and ``feature``: the image's size and its mean red, green and blue in millionths."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            media, begin, images, coef = _read(batch)
            raw, found = memoryview(np.ascontiguousarray(media)), payloads(images, coef)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            feature = []
            for image, rgb in zip(images, tensors(images, coef), strict=True):
                sums, area = rgb.sum(axis=(0, 1), dtype=np.int64).tolist(), image.width * image.height
                feature.append(f"{image.width}x{image.height}:" + ":".join(str(x * 1_000_000 // area) for x in sums))
            return {
                "doc_id": batch.column("doc_id"),
                "n_bytes": [n for n, _ in found],
                "payload_bytes": [len(x) for _, x in found],
                "payload_sha256": [sha(x) for _, x in found],
                "tail_crc32": [zlib.crc32(x[-64:]) for _, x in found],
                "media_bytes": np.diff(begin),
                "media_sha256": [sha(raw[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)],
                "feature": feature,
            }

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return in_arrow(media, begin, schema, weigh="media", step_bytes=STEP)
