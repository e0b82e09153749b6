"""AVI motion-JPEG columns: write payloads as intra frames, parse RIFF indexes, decode frames, cut shots.

A payload byte is one quantised DCT coefficient (its value less 128, in zigzag order), the lossless
unit of baseline JPEG: an 8 x 8 block holds 64 bytes. The frames written are grey, 64 pixels wide and 32 high.
Frames read may have several components in one interleaved scan; shots follow the first, which is luminance.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows

BLOCK, WIDE, HIGH, BLOCKS, MICROS = 64, 64, 32, 32, 40_000
FRAME = BLOCK * BLOCKS
#: Frames coded or decoded together; bounds the memory of a step.
GROUP = 192

#: Huffman code lengths by rule: in AC, a value with no zeros before it, the end of block and 16 zeros take 4 bits, all else 12; in DC, 4 bits.
AC_SHORT = [0x00, *range(0x01, 0x09), 0xF0]
AC_LONG = [r << 4 | s for r in range(16) for s in range(1, 11) if not (r == 0 and s <= 8)]
DC_ALL = list(range(12))


def _dht(cls: int, by_length: dict[int, list[int]]) -> bytes:
    body = bytes([cls << 4]) + bytes(len(by_length.get(n, ())) for n in range(1, 17)) + bytes(s for n in sorted(by_length) for s in by_length[n])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)"""
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


_AC = _canonical([len(AC_SHORT) if n == 4 else len(AC_LONG) if n == 12 else 0 for n in range(1, 17)], AC_SHORT + AC_LONG)
_DC = _canonical([len(DC_ALL) if n == 4 else 0 for n in range(1, 17)], DC_ALL)
HEAD = (
    b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64
    + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, HIGH, WIDE, 1, 1, 0x11, 0)
    + _dht(0, {4: DC_ALL}) + _dht(1, {4: AC_SHORT, 12: AC_LONG})
    + b"\xff\xdd\x00\x04\x00\x01" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
)


def _zigzag() -> np.ndarray:
    """Place in the block, row by row, of each zigzag index."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in order])


def _inverse_dct() -> np.ndarray:
    """Zigzag coefficients to pixels, as whole numbers of 2**-14: their float64 sums are exact, so equal in any batch."""
    k = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return np.rint(np.kron(k, k)[_zigzag()] * 2**14)


IDCT = _inverse_dct()
_VALUES = np.arange(-128, 128)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-128, 128)])
_BITS = np.where(_VALUES < 0, _VALUES + (1 << _SIZE) - 1, _VALUES)
_AC_CODE, _AC_LEN = (np.array([_AC.get(s, (0, 0))[i] for s in range(256)], np.int64) for i in (0, 1))
_DC_CODE, _DC_LEN = (np.array([_DC[s][i] for s in range(12)], np.int64) for i in (0, 1))
#: Code and length of each byte as a DC value, and as an AC value with no zeros before it.
_DC_TOKEN, _DC_BITS = _DC_CODE[_SIZE] << _SIZE | _BITS, _DC_LEN[_SIZE] + _SIZE
_AC_TOKEN, _AC_BITS = np.where(_SIZE > 0, _AC_CODE[_SIZE] << _SIZE | _BITS, 0), np.where(_SIZE > 0, _AC_LEN[_SIZE] + _SIZE, 0)


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths, 66 for each block: DC, 63 AC values (length 0 where zero), end of block, padding to whole bytes."""
    n = len(data)
    value, length = np.zeros((n, 66), np.int64), np.zeros((n, 66), np.int64)
    value[:, :64], length[:, :64] = _AC_TOKEN[data], _AC_BITS[data]
    value[:, 0], length[:, 0] = _DC_TOKEN[data[:, 0]], _DC_BITS[data[:, 0]]
    rows = np.nonzero((data[:, 1:] == 128).any(axis=1))[0]
    if len(rows):
        r, c = np.nonzero(data[rows, 1:] != 128)
        first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
        run = c - np.where(first, 0, np.r_[0, c[:-1] + 1]) if len(r) else c
        at = run > 0
        r, c, run = rows[r[at]], c[at] + 1, run[at]
        byte = data[r, c]
        size, zeros = _SIZE[byte], run >> 4
        v, w = _AC_CODE[(run & 15) << 4 | size] << size | _BITS[byte], _AC_LEN[(run & 15) << 4 | size] + size
        for k in (1, 2, 3):
            v = np.where(zeros >= k, _AC_CODE[0xF0] << w | v, v)
            w = np.where(zeros >= k, w + _AC_LEN[0xF0], w)
        value[r, c], length[r, c] = v, w
        short = rows[data[rows, 63] == 128]
        value[short, 64], length[short, 64] = _AC_CODE[0], _AC_LEN[0]
    length[:, 65] = -length.sum(axis=1) & 7
    value[:, 65] = (1 << length[:, 65]) - 1
    return value, length


def encode_scans(data: np.ndarray, frame_blocks: int) -> list[bytes]:
    """Entropy-coded data of frames of frame_blocks blocks. data: (n, 64) bytes, a coefficient being its byte less 128.

    A restart marker stands after every block, so decoders can start at any of them.
    """
    n = len(data)
    value, length = _tokens(data)
    room = length.sum(axis=1) >> 3
    while int(length.max()) <= 28 and value.shape[1] % 2 == 0:  # neighbours in one number, of 56 bits at most
        value, length = value[:, ::2] << length[:, 1::2] | value[:, 1::2], length[:, ::2] + length[:, 1::2]
    value, length = value.ravel(), length.ravel()
    end = np.cumsum(length)
    at = end - length
    word, end = at >> 5, (at & 31) + length
    words = np.zeros(int(room.sum()) // 4 + 4, np.int64)
    for k in range(3):
        shift = 32 * (k + 1) - end
        part = np.where(shift >= 0, value << np.clip(shift, 0, 32), value >> np.clip(-shift, 0, 63)) & 0xFFFFFFFF
        words += np.bincount(word + k, weights=part, minlength=len(words))[: len(words)].astype(np.int64)
        keep = end > 32 * (k + 1)
        value, word, end = value[keep], word[keep], end[keep]
    raw = words.astype(">u4").view(np.uint8)[: int(room.sum())]
    ends = np.cumsum(room)
    last = np.arange(n) % frame_blocks == frame_blocks - 1
    stuff, marks = np.nonzero(raw == 255)[0] + 1, ends[~last]
    places = np.concatenate([stuff, marks, marks])
    order = np.argsort(places, kind="stable")
    extra = np.concatenate([np.zeros(len(stuff), np.uint8), np.full(len(marks), 255, np.uint8), (0xD0 + (np.nonzero(~last)[0] % frame_blocks & 7)).astype(np.uint8)])[order]
    wide = np.insert(raw, places[order], extra)
    stops = ends[last] + np.searchsorted(stuff, ends[last], "right") + 2 * (frame_blocks - 1) * np.arange(1, int(last.sum()) + 1)
    return [wide[a:b].tobytes() for a, b in zip(np.r_[0, stops[:-1]], stops, strict=True)]


def write_avi(payload: bytes, scans: list[bytes]) -> bytes:
    frames = [HEAD + s + b"\xff\xd9" for s in scans]
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c := chunk(b"00dc", f))
        at += len(c)
    avih = struct.pack("<14I", MICROS, 0, 0, 0x10, len(frames), 0, 1, 0, WIDE, HIGH, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, MICROS, 1_000_000, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, WIDE, HIGH)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDE, HIGH, 1, 8, b"MJPG", WIDE * HIGH, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", str(len(payload)).encode()))
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_index(avi: bytes) -> tuple[int, int | None, list[tuple[int, int]]]:
    """Microseconds a frame, payload length if noted, and (offset, size) of each frame by idx1, or by the chunks of movi where there is none."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, noted, movi, listed = MICROS, None, None, None
    todo = [(12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            tag, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            if tag == b"LIST":
                kind = avi[at + 8 : at + 12]
                if kind == b"movi":
                    movi = (at + 8, min(end, at + 8 + size))
                elif kind in (b"hdrl", b"INFO"):
                    todo.append((at + 12, at + 8 + size))
            elif tag == b"avih":
                micros = struct.unpack_from("<I", avi, at + 8)[0] or MICROS
            elif tag == b"ICMT":
                noted = int(avi[at + 8 : at + 8 + size])
            elif tag == b"idx1":
                listed = [struct.unpack_from("<4sIII", avi, at + 8 + 16 * i) for i in range(size // 16)]
            at += 8 + size + (size & 1)
    if movi is None:
        return micros, noted, []
    if listed:
        tag, _, at, _ = listed[0]
        base = movi[0] if avi[movi[0] + at : movi[0] + at + 4] == tag else 0  # offsets count from movi, in some files from the start
        return micros, noted, [(base + at + 8, size) for tag, _, at, size in listed if tag[2:] in (b"dc", b"db")]
    out, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", avi, at + 4)[0]
        if avi[at + 2 : at + 4] in (b"dc", b"db"):
            out.append((at + 8, size))
        at += 8 + size + (size & 1)
    return micros, noted, out


#: For each size of a value: its bits, the least that is positive, what is added to those below.
_MASK, _HALF, _BELOW = (np.array(x) for x in ([(1 << s) - 1 for s in range(16)], [(1 << s) >> 1 for s in range(16)], [1 - (1 << s) for s in range(16)]))

#: What raises where a file isn't sound, or isn't of a kind that is decoded.
UNSOUND = (ValueError, KeyError, IndexError, struct.error)


class Head:
    """What a frame's header says: where the scan starts, blocks, restart interval in blocks, and for the blocks of a unit
    their component and their Huffman tables.

    look holds, for each pair of tables, each kind of value (DC, AC) and each 16 bits: size, code and size (0 for no code),
    zeros before. tables are DHT segments for frames that bring none.
    """

    def __init__(self, frame: bytes, tables: bytes = b""):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        quant, codes, parts, self.restart = {}, {}, None, 0
        self._huffman(tables, codes)
        at = 2
        while True:
            mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            if frame[at] != 0xFF or size < 2:
                raise ValueError("damaged header")
            body = frame[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    step = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if step == 2 else "u1").astype(np.int64)
                    body = body[1 + 64 * step :]
            elif mark == 0xC0:
                high, wide = struct.unpack_from(">HH", body, 1)
                parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames are decoded")
            elif mark == 0xC4:
                self._huffman(body, codes)
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                break
        if parts is None or body[0] != len(parts):
            raise ValueError("only frames of one scan are decoded")
        scan = [(body[i], body[i + 1] >> 4, 16 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
        across, down = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
        if len(parts) == 1:
            units, each = -(-wide // 8) * -(-high // 8), [1]
        else:
            units, each = -(-wide // (8 * across)) * -(-high // (8 * down)), [parts[c][0] * parts[c][1] for c, _, _ in scan]
        self.part = np.repeat(np.arange(len(scan)), each)
        self.per, self.blocks, self.start, self.parts = len(self.part), units * len(self.part), at, len(scan)
        self.restart *= self.per
        self.quant = quant[parts[scan[0][0]][2]]
        self.table = self.part << 17
        self.look = np.zeros((3, len(scan) << 17), np.int64)
        for i, (_, dc, ac) in enumerate(scan):
            for half, key in ((0, dc), (1, ac)):
                for s, (code, n) in codes[key].items():
                    a = i << 17 | half << 16 | code << (16 - n)
                    skip = 64 if half and not s else s >> 4 if half else 0
                    self.look[:, a : a + (1 << (16 - n))] = np.array([[s & 15], [n + (s & 15)], [skip]])

    @staticmethod
    def _huffman(body: bytes, codes: dict) -> None:
        while body:
            n = sum(body[1:17])
            codes[body[0]] = _canonical(list(body[1:17]), list(body[17 : 17 + n]))
            body = body[17 + n :]


_heads: dict[tuple[bytes, bytes], Head] = {}


def head_of(frame: bytes, tables: bytes = b"") -> Head:
    at = frame.index(b"\xff\xda")
    raw = frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]]
    if (raw, tables) not in _heads:
        if len(_heads) > 16:
            _heads.clear()
        _heads[raw, tables] = Head(raw, tables)
    return _heads[raw, tables]


def decode_frames(frames: list[bytes], tables: bytes = b"") -> list[np.ndarray]:
    """Quantised coefficients, (blocks, 64) in zigzag order and the order of the scan, of each frame. All restart segments advance together."""
    out: list[np.ndarray] = [np.zeros((0, 64), np.int64)] * len(frames)
    by_head: dict[int, tuple[Head, list[int]]] = {}
    for i, f in enumerate(frames):
        head = head_of(f, tables)
        by_head.setdefault(id(head), (head, []))[1].append(i)
    for head, group in by_head.values():
        for i, coef in zip(group, _decode(head, [frames[i] for i in group]), strict=True):
            out[i] = coef
    return out


def _decode(head: Head, frames: list[bytes]) -> np.ndarray:
    each, stride = head.blocks, head.restart or head.blocks
    size_of, used_of, skip_of = head.look
    raws = [np.frombuffer(f, np.uint8, len(f) - head.start - 2, head.start) for f in frames]
    raw = np.concatenate(raws)
    bounds = np.cumsum([len(r) for r in raws])
    ff = np.nonzero(raw[:-1] == 255)[0]
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.r_[0, np.cumsum(keep)]
    data = np.r_[raw[keep], np.zeros(8, np.uint8)].astype(np.int64)
    begins = np.sort(np.concatenate([np.r_[0, bounds[:-1]], marks + 2]))
    stops = np.sort(np.concatenate([bounds, marks]))
    frame = np.searchsorted(bounds, begins, "right")
    nth = np.arange(len(begins)) - np.searchsorted(frame, frame)
    if len(begins) != len(frames) * -(-each // stride) or (np.diff(frame) < 0).any() or (nth * stride >= each).any():
        raise ValueError("restart markers don't fit the frame")
    first = frame * each + nth * stride
    left = np.minimum(stride, (frame + 1) * each - first)
    window = data[:-5] << 32 | data[1:-4] << 24 | data[2:-3] << 16 | data[3:-2] << 8 | data[4:-1]
    coef = np.zeros(len(frames) * each * 64 + 64, np.int64)
    pos, end, block, k = place[begins] * 8, place[stops] * 8, first * 64, np.zeros(len(begins), np.int64)
    table, unit = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
    pred = np.zeros((len(begins), head.parts), np.int64) if (left > 1).any() else None
    while len(pos):
        w = window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7) & 0xFFFFFFFFFF
        code = (w >> 24) | (k > 0) << 16 | table
        s, used = size_of[code], used_of[code]
        v = (w >> (40 - used)) & _MASK[s]
        v += (v < _HALF[s]) * _BELOW[s]
        pos = pos + used
        if not used.all() or (pos > end).any():
            raise ValueError("damaged scan")
        if pred is not None and (dc := np.nonzero(k == 0)[0]).size:
            part = head.part[unit[dc]]
            pred[dc, part] += v[dc]
            v[dc] = pred[dc, part]
        k += skip_of[code]
        put = k < 64
        if put.all():
            coef[block + k] = v
        else:
            coef[(block + k)[put]] = v[put]
        k += 1
        over = k >= 64
        if over.any():
            left = left - over
            block, k = block + 64 * over, np.where(over, 0, k)
            if head.per > 1:
                unit = (unit + over) % head.per
                table = head.table[unit]
            on = left > 0
            if not on.all():
                pos, end, block, k, left, table, unit = (x[on] for x in (pos, end, block, k, left, table, unit))
                pred = None if pred is None else pred[on]
    return coef[:-64].reshape(len(frames), each, 64)


def histogram(coef: np.ndarray, quant: np.ndarray | int = 1, bins: int = 16) -> np.ndarray:
    pixels = np.clip(np.rint((coef * quant).astype(np.float64) @ IDCT / 2**14) + 128, 0, 255).astype(np.int64)
    return np.bincount((pixels * bins // 256).ravel(), minlength=bins)


def shots(hists: list[np.ndarray], window: int = 12, factor: float = 2.0, floor: float = 0.1) -> list[int]:
    """First frames of shots. A cut needs a histogram difference over the floor and over mean + factor * deviation of those before it."""
    starts, recent = [0] if hists else [], []
    for i in range(1, len(hists)):
        d = int(np.abs(hists[i] - hists[i - 1]).sum()) / max(1, int(hists[i].sum() + hists[i - 1].sum()))
        mean = sum(recent) / len(recent) if recent else 0.0
        dev = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(floor, mean + factor * dev):
            starts.append(i)
            recent = []
        else:
            recent = [*recent, d][-window:]
    return starts


def store_as_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled up with 0 to a positive multiple of 64, as an AVI file.

    Null counts as empty. Equal texts give equal files. Texts of any length are coded in groups of frames.
    """

    def make():
        def step(ids, texts):
            raw = [(t or "").encode() for t in texts]
            payloads = [b + b"\0" * (-len(b) % 64 or 64 * (not b)) for b in raw]
            scans: list[list[bytes]] = [[] for _ in raw]
            todo = [(i, p[a : a + FRAME]) for i, p in enumerate(payloads) for a in range(0, len(p), FRAME)]
            for a in range(0, len(todo), GROUP):
                part = todo[a : a + GROUP]
                data = np.frombuffer(b"".join(p.ljust(FRAME, b"\x80") for _, p in part), np.uint8).reshape(-1, 64)
                for (i, _), s in zip(part, encode_scans(data, BLOCKS), strict=True):
                    scans[i].append(s)
            return ids, [len(b) for b in raw], [write_avi(p, s) for p, s in zip(payloads, scans, strict=True)]

        return step

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def read_avi(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", tables: bytes = b"") -> DataFrame:
    """(id, payload, frames, clips, error) of each file, clips being array of (shot, start_frame, end_frame, start_s, end_s).

    The payload is what store_as_avi wrote. A null file gives null payload and clips. So does a file that isn't sound or not
    baseline motion-JPEG in one scan; error says why, and all other files are read. tables are DHT segments for
    frames without Huffman tables. A frame of no bytes repeats the one before. Rows may repeat, ids may be null.
    """

    def make():
        def index_of(f):
            try:
                return None if f is None else read_index(f)
            except UNSOUND as e:
                return str(e) or "damaged file"

        def decode(part, frames, errors):
            """Coefficients of frames; of those that can't be read none."""
            try:
                return decode_frames(frames, tables)
            except UNSOUND as e:
                if len(frames) == 1:
                    errors.setdefault(part[0], str(e) or "damaged frame")
                    return [None]
                return [c for i, f in zip(part, frames, strict=True) for c in decode([i], [f], errors)]

        def step(ids, files):
            index = [index_of(f) for f in files]
            errors = {i: x for i, x in enumerate(index) if isinstance(x, str)}
            parts: list[list[bytes]] = [[] for _ in files]
            hists: list[list[np.ndarray]] = [[] for _ in files]
            todo = [(i, at, size) for i, x in enumerate(index) if x and i not in errors for at, size in x[2]]
            for a in range(0, len(todo), GROUP):
                some = [x for x in todo[a : a + GROUP] if x[2]]
                frames = [files[i][at : at + size] for i, at, size in some]
                coefs = iter(decode([i for i, _, _ in some], frames, errors) if some else ())
                frames = iter(frames)
                for i, _, size in todo[a : a + GROUP]:
                    if not size:
                        hists[i] += hists[i][-1:]
                        continue
                    coef, frame = next(coefs), next(frames)
                    if coef is not None:
                        head = head_of(frame, tables)
                        parts[i].append((coef + 128).astype(np.uint8).tobytes())
                        hists[i].append(histogram(coef[head.part[np.arange(len(coef)) % head.per] == 0], head.quant))
            payloads, clips = [], []
            for i, x in enumerate(index):
                if x is None or i in errors:
                    payloads.append(None)
                    clips.append(None)
                    continue
                payloads.append(b"".join(parts[i])[: x[1]])
                cut = [*shots(hists[i]), len(hists[i])]
                clips.append([{"shot": n, "start_frame": a, "end_frame": b, "start_s": a * x[0] / 1e6, "end_s": b * x[0] / 1e6} for n, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
            return ids, payloads, [None if i in errors else len(h) for i, h in enumerate(hists)], clips, [errors.get(i) for i in range(len(files))]

        return step

    return map_rows(media.select(id_col, media_col), make, f"{id_col} {dict(media.dtypes)[id_col]}, payload binary, frames long, clips array<struct<shot:long,start_frame:long,end_frame:long,start_s:double,end_s:double>>, error string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Sizes and digests of stored and read-back bytes, with the shots as the feature; both steps run in one stage.

    Null counts as empty; ids may repeat or be null: a row comes back for each row.
    """
    media = store_as_avi(docs)
    stored = media.select("doc_id", "n_bytes", "media")
    back = read_avi(stored.select(F.struct("doc_id", "n_bytes", F.length("media").alias("size"), F.sha2("media", 256).alias("sha")).alias("key"), "media"), "key")
    tail = F.expr("substring(payload, length(payload) - 63, 64)")
    clips = F.array_join(F.transform("clips", lambda c: F.concat(F.format_string("%.2f", c["start_s"]), F.lit("-"), F.format_string("%.2f", c["end_s"]))), ",")
    return back.select(
        F.col("key.doc_id").alias("doc_id"), F.col("key.n_bytes").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.col("key.size").cast("long").alias("media_bytes"), F.col("key.sha").alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("frames"), F.lit(";shots="), F.size("clips"), F.lit(";clips="), clips).alias("feature"),
    )


def clip_rows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each shot: id, shot, start_frame, end_frame (exclusive), start_s, end_s."""
    return read_avi(media, id_col).select(id_col, F.inline("clips"))
