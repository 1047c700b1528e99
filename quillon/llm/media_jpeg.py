"""Progressive JPEG as a lossless container of bytes, and its decoder.

A payload byte is one quantised DCT coefficient (frequent text bytes get small values),
so a file keeps the payload exactly although the pixels it shows are rounded.  Images
are YCbCr 4:2:0 with unit quantisers.  Files hold nine scans: DC and AC with spectral
selection at a point transform of one bit, then one refinement of each (successive
approximation), all cut into restart intervals.

The decoder takes many files at once: every restart interval of every file is a lane,
and all lanes advance one symbol (or, in refinements, one coefficient) a step in numpy,
accumulating the scans into one coefficient array.  Pixels come from an inverse
transform in whole numbers (exact in doubles, so equal files give equal tensors), chroma
is doubled in both directions, and RGB is full resolution.

Null and empty texts give the least payload (all padding).  Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

UNIT = 576
RESTART = 4
BATCH_BYTES = 2 << 20
#: Bytes in the order in which they get small coefficients; the rest follow by number.
FREQUENT = b" etaoinshrdlucmfwypvbgkjxqz"
# The zigzag order of an 8 x 8 block, from its rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_ORDER = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)])
TO_COEF = np.zeros(256, np.int16)
TO_COEF[_ORDER] = [(k + 1) // 2 * (1 if k % 2 else -1) for k in range(256)]
TO_BYTE = np.zeros(257, np.uint8)
TO_BYTE[TO_COEF + 128] = np.arange(256)
SCANS = (("dc", 0, 0, 0), ("ac", 0, 1, 5), ("ac", 1, 1, 63), ("ac", 2, 1, 63), ("ac", 0, 6, 63), ("dcr", 0, 0, 0), ("acr", 0, 1, 63), ("acr", 1, 1, 63), ("acr", 2, 1, 63))
_C = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Inverse transform of a block's 64 coefficients in zigzag order, in parts of 2**20.
INVERSE = np.round(np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64)[ZIGZAG] * 2**20)


# --- Huffman tables ----------------------------------------------------------


class Table:
    """A canonical Huffman code from symbol weights, or from a file's own table."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.lut = np.full(1 << 16, 16 << 8, np.int32)
        code = k = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[k : k + n]:
                self.code[s], self.size[s] = code, length
                self.lut[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
                code += 1
            k += n
            code <<= 1

    @classmethod
    def of(cls, weights: dict[int, float]) -> Table:
        heap = [(max(w, 2.0**-11), s, (s,)) for s, w in weights.items()] + [(2.0**-12, 256, (256,))]  # 256 takes the code of ones
        heapq.heapify(heap)
        size = dict.fromkeys([*weights, 256], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                size[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        longest = max(size.values())
        order = sorted(size, key=lambda s: (size[s], s))
        if longest > 16 or size[256] != longest:
            raise AssertionError("weights too uneven for a 16-bit code")
        counts = [sum(size[s] == n for s in order if s != 256) for n in range(1, 17)]
        return cls(counts, [s for s in order if s != 256])

    def segment(self, number: int) -> bytes:
        body = bytes([number, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _tables() -> tuple[Table, Table, Table]:
    dc = Table.of({s: 2.0 ** -abs(s - 4) for s in range(10)})
    sizes = {1: 0.34, 2: 0.33, 3: 0.2, 4: 0.06, 5: 0.04, 6: 0.02, 7: 0.01}
    ac = {r << 4 | s: 0.6 * 0.4**r * p for r in range(16) for s, p in sizes.items()}
    ac |= {0x00: 0.02, 0xF0: 1e-4}
    ref = {r << 4 | 1: 0.22 * 0.8**r for r in range(16)} | {0x00: 0.05, 0xF0: 0.005}
    return dc, Table.of(ac), Table.of(ref)


DC, AC, ACR = _tables()


# --- layout ------------------------------------------------------------------


def geometry(n: int) -> tuple[int, int]:
    """(columns, rows) of 16 x 16 units for a payload of n bytes."""
    units = max(1, -(-n // 384))
    w = int(np.ceil(np.sqrt(units)))
    return w, -(-units // w)


_UNIT_ORDER: dict[tuple[int, int], np.ndarray] = {}


def unit_order(w: int, h: int) -> np.ndarray:
    """Blocks (luma by rows, then the two chromas) in the order of interleaved scans."""
    if (w, h) not in _UNIT_ORDER:
        if len(_UNIT_ORDER) > 2_000:
            _UNIT_ORDER.clear()
        i, j = (x.ravel() for x in np.mgrid[0:h, 0:w])
        y = 4 * i * w + 2 * j
        c = 4 * w * h + i * w + j
        _UNIT_ORDER[w, h] = np.stack((y, y + 1, y + 2 * w, y + 2 * w + 1, c, c + w * h), 1).ravel()
    return _UNIT_ORDER[w, h]


class Layout:
    """Blocks and lanes of a batch of files, from their units' columns and rows."""

    def __init__(self, shapes: list[tuple[int, int]]):
        self.shapes = shapes
        units = np.array([w * h for w, h in shapes], np.int64)
        self.first = np.concatenate(([0], np.cumsum(6 * units)))  # first block of each file
        n = len(shapes)
        of_comp = [[4 * u, u, u] for u in units]
        self.lanes = np.array([[-(-u // RESTART) if kind.startswith("dc") else -(-of_comp[d][c] // RESTART) for kind, c, _, _ in SCANS] for d, u in enumerate(units)], np.int64).reshape(n, len(SCANS))
        self.lane0 = np.concatenate(([0], np.cumsum(self.lanes.ravel())))[:-1].reshape(self.lanes.shape)
        self.n_lanes = int(self.lanes.sum())
        order = [unit_order(w, h) + f for (w, h), f in zip(shapes, self.first)]
        self.unit_blocks = np.concatenate(order) if n else np.empty(0, np.int64)
        place = np.concatenate([np.arange(6 * u) // (6 * RESTART) for u in units]) if n else np.empty(0, np.int64)
        doc = np.repeat(np.arange(n), 6 * units)
        self.unit_lane = self.lane0[doc, 0] + place  # lanes of the first DC scan; others by offset
        self.unit_doc = doc
        self.unit_comp = np.tile(np.array([0, 0, 0, 0, 1, 2]), int(units.sum()))
        self.blocks: list[np.ndarray] = []  # of each component, in scan order
        self.block_doc: list[np.ndarray] = []
        self.block_place: list[np.ndarray] = []
        for c in range(3):
            size = np.array([x[c] for x in of_comp], np.int64)
            start = self.first[:-1] + np.array([[0, 4 * u, 5 * u][c] for u in units], np.int64)
            d = np.repeat(np.arange(n), size)
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self.blocks.append(start[d] + k)
            self.block_doc.append(d)
            self.block_place.append(k)

    def lane_of(self, scan: int) -> np.ndarray:
        c = SCANS[scan][1]
        return self.lane0[self.block_doc[c], scan] + self.block_place[c] // RESTART


#: Binary digits of numbers below 2**9.
_DIGITS = np.array([int(i).bit_length() for i in range(512)], np.int64)


# --- encoder -----------------------------------------------------------------


def _dc_items(z: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = z[lay.unit_blocks, 0].astype(np.int64) >> 1
    diff = v.copy()
    for c in range(3):
        i = np.flatnonzero(lay.unit_comp == c)
        same = lay.unit_lane[i][1:] == lay.unit_lane[i][:-1]
        diff[i[1:]] -= np.where(same, v[i[:-1]], 0)
    s = _DIGITS[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    return lay.unit_lane, DC.code[s] << s | extra, DC.size[s] + s


def _after(mask: np.ndarray, count: np.ndarray) -> np.ndarray:
    """In each row: ``count`` (a running sum) since the last place where ``mask`` held."""
    return count - np.maximum.accumulate(np.where(mask, count, 0), 1)


def _ac_items(z: np.ndarray, lay: Layout, scan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols stand at their coefficient, a run of 16 zeros at its last one, the end in a column of its own."""
    _, c, lo, hi = SCANS[scan]
    band = z[lay.blocks[c], lo : hi + 1]
    mag = np.abs(band) >> 1
    has = mag > 0
    nth = _after(has, np.cumsum(~has, 1, dtype=np.int8))
    width = hi - lo + 1
    last = np.where(has.any(1), width - 1 - np.argmax(has[:, ::-1], 1), -1)
    code, size = np.zeros((len(band), width + 1), np.int32), np.zeros((len(band), width + 1), np.int8)
    if width > 16:
        skip = (nth & 15 == 0) & (nth > 0) & (np.arange(width) < last[:, None])
        code[:, :-1][skip], size[:, :-1][skip] = AC.code[0xF0], AC.size[0xF0]
    at = np.flatnonzero(has)
    m = mag.reshape(-1)[at].astype(np.int64)
    before = np.concatenate((np.zeros((len(band), 1), np.int8), nth[:, :-1]), 1).reshape(-1)[at]
    d = _DIGITS[m]
    sym = (before & 15).astype(np.int64) << 4 | d
    to = at + at // width
    code.reshape(-1)[to] = AC.code[sym] << d | np.where(band.reshape(-1)[at] < 0, (1 << d) - 1 - m, m)
    size.reshape(-1)[to] = AC.size[sym] + d
    end = last < width - 1
    code[end, -1], size[end, -1] = AC.code[0], AC.size[0]
    i = np.flatnonzero(size)
    return lay.lane_of(scan)[i // (width + 1)], code.reshape(-1)[i], size.reshape(-1)[i]


def _acr_items(z: np.ndarray, lay: Layout, scan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stretch's symbol stands in the even column of its first coefficient, correction bits in odd ones."""
    _, c, _, _ = SCANS[scan]
    a = z[lay.blocks[c], 1:]
    mag = np.abs(a)
    fresh, old, zero = mag == 1, mag > 1, mag == 0
    nth = _after(fresh, np.cumsum(zero, 1, dtype=np.int8))
    final = np.where(fresh.any(1), 62 - np.argmax(fresh[:, ::-1], 1), -1)
    event = fresh | zero & (nth & 15 == 0) & (nth > 0) & (np.arange(63) < final[:, None])
    code, size = np.zeros((len(a), 128), np.int32), np.zeros((len(a), 128), np.int8)
    at = np.flatnonzero(event)
    row, k = at // 63, at % 63
    prev = np.concatenate(([0], np.where(row[1:] == row[:-1], k[:-1] + 1, 0))) if len(at) else at
    new = fresh.reshape(-1)[at]
    before = np.where(k > 0, nth.reshape(-1)[np.maximum(at - 1, 0)], 0) & 15
    sym = np.where(new, before, 15).astype(np.int64) << 4 | new
    code[row, 2 * prev] = ACR.code[sym] << new | (new & (a.reshape(-1)[at] > 0))
    size[row, 2 * prev] = ACR.size[sym] + new
    last = np.where(event.any(1), 62 - np.argmax(event[:, ::-1], 1), -1)
    end = np.flatnonzero(last < 62)
    code[end, 2 * last[end] + 2], size[end, 2 * last[end] + 2] = ACR.code[0], ACR.size[0]
    code[:, 1:127:2][old] = mag[old] & 1
    size[:, 1:127:2] = old
    i = np.flatnonzero(size)
    return lay.lane_of(scan)[i >> 7], code.reshape(-1)[i], size.reshape(-1)[i]


def _header(w: int, h: int, n: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    note = struct.pack(">Q", n)
    return b"".join(
        (
            b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00",
            b"\xff\xfe" + struct.pack(">H", 2 + len(note)) + note,
            b"\xff\xdb\x00\x43\x00" + b"\x01" * 64,
            b"\xff\xc2" + struct.pack(">H", 2 + len(frame)) + frame,
            DC.segment(0x00),
            AC.segment(0x10),
            ACR.segment(0x11),
            b"\xff\xdd\x00\x04" + struct.pack(">H", RESTART),
        )
    )


def _scan_header(kind: str, c: int, lo: int, hi: int) -> bytes:
    comps = [1, 2, 3] if kind.startswith("dc") else [c + 1]
    table = 0x01 if kind == "acr" else 0x00
    body = bytes([len(comps), *(x for i in comps for x in (i, table)), lo, hi, 0x10 if kind.endswith("r") else 0x01])
    return b"\xff\xda" + struct.pack(">H", 2 + len(body)) + body


_SCAN_HEADERS = [_scan_header(*s) for s in SCANS]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive file for each payload."""
    shapes = [geometry(len(p)) for p in payloads]
    lay = Layout(shapes)
    z = np.zeros((int(lay.first[-1]), 64), np.int16)
    flat = z.reshape(-1)
    for p, f in zip(payloads, lay.first):
        flat[64 * f : 64 * f + len(p)] = TO_COEF[np.frombuffer(p, np.uint8)]
    items = []
    for scan, (kind, *_) in enumerate(SCANS):
        if kind == "dc":
            items.append(_dc_items(z, lay))
        elif kind == "dcr":
            shift = lay.lane0[:, scan] - lay.lane0[:, 0]
            items.append((lay.unit_lane + shift[lay.unit_doc], z[lay.unit_blocks, 0].astype(np.int64) & 1, np.ones(len(lay.unit_blocks), np.int64)))
        else:
            items.append((_ac_items if kind == "ac" else _acr_items)(z, lay, scan))
    bits = np.zeros(lay.n_lanes, np.int64)
    for lane, _, size in items:
        bits += np.bincount(lane, size, minlength=lay.n_lanes).astype(np.int64)
    n_bytes = -(-bits // 8)
    start = np.cumsum(n_bytes) - n_bytes
    total = int(n_bytes.sum())
    words = np.zeros(total // 4 + 3)
    for lane, code, size in items:  # a lane's items come from one scan, in order
        if not len(lane):
            continue
        before = np.cumsum(size, dtype=np.int64) - size
        new = np.concatenate(([True], lane[1:] != lane[:-1]))
        off = before - before[new][np.cumsum(new) - 1] + 8 * start[lane]
        word = code.astype(np.int64) << (64 - size.astype(np.int64) - (off & 31)) - 1  # 63 bits: two words of 32 and 31
        at = off >> 5
        words += np.bincount(at, word >> 31, minlength=len(words)) + np.bincount(at + 1, (word & (1 << 31) - 1) << 1, minlength=len(words))
    raw = words.astype(np.uint32).astype(">u4").view(np.uint8)[:total].copy()
    pad = 8 * n_bytes - bits
    raw[start + n_bytes - 1] += ((1 << pad) - 1).astype(np.uint8)
    ff = raw == 255
    stuffed = np.repeat(raw, 1 + ff)
    at = np.arange(total) + np.cumsum(ff) - ff
    stuffed[at[ff] + 1] = 0
    cut = np.concatenate((at, [len(stuffed)]))[np.concatenate((start, [total]))].tolist()
    data = stuffed.tobytes()
    files = []
    for d, p in enumerate(payloads):
        parts = [_header(*shapes[d], len(p))]
        for scan in range(len(SCANS)):
            parts.append(_SCAN_HEADERS[scan])
            first, n = int(lay.lane0[d, scan]), int(lay.lanes[d, scan])
            for i in range(n):
                parts.append(data[cut[first + i] : cut[first + i + 1]])
                if i < n - 1:
                    parts.append(bytes((255, 0xD0 + i % 8)))
        parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


# --- decoder -----------------------------------------------------------------


def _parse(f: bytes, base: int, lanes: list[int]) -> tuple[tuple[int, int], int, dict[int, bytes]]:
    """Read one file's segments; append the byte place of each restart interval to ``lanes``."""
    i, n, tables, shape = 2, 0, {}, (0, 0)
    scans = 0
    while True:
        if f[i] != 255:
            raise ValueError("not a marker")
        m = f[i + 1]
        if m == 0xD9:
            break
        size = struct.unpack_from(">H", f, i + 2)[0]
        body = f[i + 4 : i + 2 + size]
        i += 2 + size
        if m == 0xFE:
            n = struct.unpack(">Q", body)[0]
        elif m == 0xC2:
            h, w = struct.unpack_from(">HH", body, 1)
            shape = (w // 16, h // 16)
        elif m == 0xC4:
            tables[body[0]] = body[1:]
        elif m == 0xDA:
            if f[i - size - 2 : i] != _SCAN_HEADERS[scans]:
                raise ValueError("a scan script of another encoder")
            scans += 1
            lanes.append(base + i)
            while True:
                i = f.index(b"\xff", i)
                if f[i + 1] == 0:
                    i += 2
                elif 0xD0 <= f[i + 1] <= 0xD7:
                    i += 2
                    lanes.append(base + i)
                else:
                    break
    return shape, n, tables


_LUTS: dict[bytes, np.ndarray] = {}


def _lut(body: bytes) -> np.ndarray:
    if body not in _LUTS:
        _LUTS[body] = Table(list(body[:16]), list(body[16:])).lut
    return _LUTS[body]


def _first_and_size(block_lane: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes in order, with the first block and the block count of each."""
    start = np.concatenate(([0], np.flatnonzero(np.diff(block_lane)) + 1))
    return block_lane[start], blocks[start], np.diff(np.concatenate((start, [len(blocks)])))


def coefficients(files: list[bytes]) -> tuple[np.ndarray, Layout, list[int]]:
    """(blocks x 64 in zigzag order, layout, payload lengths) from all scans of the files."""
    places: list[int] = []
    shapes, lengths, base = [], [], 0
    tables: dict[int, bytes] = {}
    for f in files:
        shape, n, own = _parse(f, base, places)
        if tables and own != tables:
            raise ValueError("files with different tables in one batch")
        tables = own
        shapes.append(shape)
        lengths.append(n)
        base += len(f)
    lay = Layout(shapes)
    raw = np.frombuffer(b"".join(files) + b"\0" * 8, np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
    keep[-8:] = True
    where = np.cumsum(keep) - 1
    b = raw[keep].astype(np.int64)
    window = np.zeros(len(b), np.int64)  # 40 bits from each byte on
    for k in range(5):
        window[: len(b) - k] |= b[k:] << (32 - 8 * k)
    bit = 8 * where[np.array(places, np.int64)]
    z = np.zeros(64 * int(lay.first[-1]), np.int64)
    dc, ac, acr = (_lut(tables[k]) for k in (0x00, 0x10, 0x11))

    # first DC scan: a block a step, each component with its own prediction
    lane, _, size = _first_and_size(lay.unit_lane, lay.unit_blocks)
    start = np.cumsum(size) - size
    pos, pred = bit[lane].copy(), np.zeros((len(lane), 3), np.int64)
    for i in range(int(size.max(initial=0))):
        a = np.flatnonzero(i < size)
        block, comp = lay.unit_blocks[start[a] + i], lay.unit_comp[start[a] + i]
        p = pos[a]
        w, o = window[p >> 3], p & 7
        e = dc[w >> (24 - o) & 0xFFFF]
        s, ln = (e & 255).astype(np.int64), (e >> 8).astype(np.int64)
        x = w >> (40 - o - ln - s) & (1 << s) - 1
        x = np.where((s > 0) & (x < 1 << np.maximum(s - 1, 0)), x - (1 << s) + 1, x)
        pred[a, comp] += x
        z[64 * block] = pred[a, comp] << 1
        pos[a] += ln + s
    # its refinement: one plain bit a block
    shift = lay.lane0[:, 5] - lay.lane0[:, 0]
    p = bit[lay.unit_lane + shift[lay.unit_doc]] + np.arange(len(lay.unit_lane)) - np.repeat(start, size)
    z[64 * lay.unit_blocks] |= window[p >> 3] >> (39 - (p & 7)) & 1

    parts = [_first_and_size(lay.lane_of(s), lay.blocks[SCANS[s][1]]) for s in range(len(SCANS)) if SCANS[s][0] == "ac"]
    lo = np.concatenate([np.full(len(p[0]), SCANS[s][2]) for p, s in zip(parts, (1, 2, 3, 4))])
    hi = np.concatenate([np.full(len(p[0]), SCANS[s][3]) for p, s in zip(parts, (1, 2, 3, 4))])
    lane, block, size = (np.concatenate(x) for x in zip(*parts))
    _ac_first(z, window, ac, bit[lane], block, block + size, lo, hi)
    parts = [_first_and_size(lay.lane_of(s), lay.blocks[SCANS[s][1]]) for s in range(len(SCANS)) if SCANS[s][0] == "acr"]
    lane, block, size = (np.concatenate(x) for x in zip(*parts))
    _ac_refine(z, window, acr, bit[lane], block, block + size)
    return z.reshape(-1, 64), lay, lengths


def _ac_first(z, window, lut, pos, block, end, lo, hi) -> None:
    """A symbol a step in every lane."""
    k = lo.copy()
    while len(pos):
        w, o = window[pos >> 3], pos & 7
        e = lut[w >> (24 - o) & 0xFFFF].astype(np.int64)
        ln, s, r = e >> 8, e & 15, e >> 4 & 15
        x = w >> (40 - o - ln - s) & (1 << s) - 1
        has = s > 0
        x = np.where(x < 1 << np.maximum(s - 1, 0), x - (1 << s) + 1, x)
        k += r
        at = np.flatnonzero(has)
        v = x[at]
        z[64 * block[at] + k[at]] = np.sign(v) * (np.abs(v) << 1)
        k = np.where(has | (r == 15), k + 1, 64)
        pos = pos + ln + s
        over = k > hi
        if over.any():
            block = block + over
            k = np.where(over, lo, k)
            live = block < end
            if not live.all():
                pos, block, end, lo, hi, k = (a[live] for a in (pos, block, end, lo, hi, k))


def _ac_refine(z, window, lut, pos, block, end) -> None:
    """A coefficient a step in every lane: all lanes of equal size stay in step."""
    n = len(pos)
    run, new = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _ in range(int((end - block).max(initial=0))):
        need = np.ones(len(pos), bool)
        for k in range(1, 64):
            i = np.flatnonzero(need)
            if len(i):
                p = pos[i]
                w, o = window[p >> 3], p & 7
                e = lut[w >> (24 - o) & 0xFFFF].astype(np.int64)
                ln, s, r = e >> 8, e & 15, e >> 4 & 15
                sign = w >> (39 - o - ln) & 1
                run[i] = np.where((s == 0) & (r < 15), 99, r)
                new[i] = np.where(s > 0, 2 * sign - 1, 0)
                pos[i] = p + ln + s
                need[i] = False
            at = 64 * block + k
            v = z[at]
            old = v != 0
            i = np.flatnonzero(old)
            p = pos[i]
            z[at[i]] += np.sign(v[i]) * (window[p >> 3] >> (39 - (p & 7)) & 1)
            pos[i] += 1
            hit = ~old & (run == 0)
            i = np.flatnonzero(hit)
            z[at[i]] = new[i]
            need = hit
            run -= ~old
        block = block + 1
        live = block < end
        if not live.all():
            pos, block, end, run, new = (a[live] for a in (pos, block, end, run, new))


def payloads_of(z: np.ndarray, lay: Layout, lengths: list[int]) -> list[bytes]:
    flat = TO_BYTE[z.reshape(-1) + 128]
    return [flat[64 * f : 64 * f + n].tobytes() for f, n in zip(lay.first, lengths)]


def _pixels(z: np.ndarray) -> np.ndarray:
    """Samples 0..255 of each block, 8 x 8."""
    out = np.empty((len(z), 64), np.uint8)
    for lo in range(0, len(z), 4096):
        x = z[lo : lo + 4096].astype(np.float64) @ INVERSE
        out[lo : lo + 4096] = np.clip((x.astype(np.int64) + (1 << 19) >> 20) + 128, 0, 255)
    return out.reshape(-1, 8, 8)


def _to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Whole-number conversion of equal-shaped planes."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    rgb = (y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr + half >> 16), y + (116130 * cb + half >> 16))
    return np.stack([np.clip(p, 0, 255).astype(np.uint8) for p in rgb], -1)


def _file_rgb(px: np.ndarray, w: int, h: int, first: int) -> np.ndarray:
    n = w * h
    y = px[first : first + 4 * n].reshape(2 * h, 2 * w, 8, 8).transpose(0, 2, 1, 3).reshape(16 * h, 16 * w)
    chroma = (px[first + k * n : first + (k + 1) * n].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w) for k in (4, 5))
    return _to_rgb(y, *(p.repeat(2, 0).repeat(2, 1) for p in chroma))


def decode_rgb(files: list[bytes]) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) tensors."""
    z, lay, _ = coefficients(files)
    px = _pixels(z)
    return [_file_rgb(px, w, h, f) for (w, h), f in zip(lay.shapes, lay.first)]


def features(rgb: np.ndarray) -> str:
    """Size, mean and spread of each channel (hundredths), and a checksum of the tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    flat = rgb.reshape(-1, 3)
    s = flat.sum(0, dtype=np.int64)
    q = np.array([int((np.bincount(flat[:, c], minlength=256) * np.arange(256) ** 2).sum()) for c in range(3)])
    mean, var = 100 * s // n, (100 * (n * q - s * s)) // (n * n)
    return f"{rgb.shape[1]}x{rgb.shape[0]};{','.join(map(str, mean))};{','.join(map(str, var))};{zlib.crc32(rgb):08x}"


# --- Spark -------------------------------------------------------------------


def payload_bytes(b: bytes) -> bytes:
    """A text's bytes with 255 appended up to a positive multiple of the unit."""
    return b + b"\xff" * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: every text as a progressive JPEG file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, texts in U.slices(b.column(1), BATCH_BYTES):
                files = encode([payload_bytes(t) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(texts)], pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def rgb_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, height, width, rgb``: full-resolution tensors of stored files."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, m in zip(b.column(0), b.column(1)):
                x = decode_rgb([m.as_py()])[0]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.column(0).type), pa.array([x.shape[0]], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], [id_col, "height", "width", "rgb"])

    return media.where(F.col(media_col).isNotNull()).select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, rgb binary")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored files hold: the payload read back, the file's digest, pixel features."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            sizes = np.cumsum(b.column(1).to_numpy() + UNIT) // BATCH_BYTES
            lo = 0
            while lo < len(b):
                hi = int(np.searchsorted(sizes, sizes[lo], side="right"))
                files = b.column(2)[lo:hi].to_pylist()
                z, lay, lengths = coefficients(files)
                back = payloads_of(z, lay, lengths)
                px = _pixels(z)
                feats = []
                for (w, h), f in zip(lay.shapes, lay.first):
                    feats.append(features(_file_rgb(px, w, h, f)))
                cols = [
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array(feats),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *cols], [id_col, "n_bytes", *names])
                lo = hi

    return media.select(id_col, "n_bytes", "media").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
