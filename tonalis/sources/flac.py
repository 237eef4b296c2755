"""FLAC streams: headers, and frames of samples, which can be found and read from any byte on.

A frame's header tells which samples it holds, and two checksums tell a frame from bytes that look like one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np


class Broken(Exception):
    """Not a stream or frame, or a damaged one."""


@dataclass(frozen=True)
class Stream:
    """Of the stream's first block: rate, channels, bits, samples a channel (0: unknown), samples a frame, bytes of the largest frame; and the first frame's byte."""

    rate: int
    channels: int
    bits: int
    n: int
    block: int
    most: int
    first: int


def stream(read, size: int) -> Stream:  # noqa: ANN001
    """read(n, offset) gives bytes of a file of ``size``; metadata blocks are passed over."""
    at, info = 4, None
    if read(4, 0) != b"fLaC":
        raise Broken("no mark of a stream")
    while True:
        head = read(4, at)
        if len(head) < 4:
            raise Broken("metadata without an end")
        length = int.from_bytes(head[1:], "big")
        if info is None:
            if head[0] & 0x7F or length < 34:
                raise Broken("no stream information")
            info = read(18, at + 4)
            if len(info) < 18:
                raise Broken("no stream information")
        at += 4 + length
        if head[0] & 0x80:
            break
    word = int.from_bytes(info[10:18], "big")
    rate, channels, bits = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1
    block = int.from_bytes(info[2:4], "big")
    if not rate or not block:
        raise Broken("no rate or size of blocks")
    # A frame can't be much larger than its samples as they are.
    bound = (block * channels * (bits + 1) + 7) // 8 + 64 + 8 * channels
    return Stream(rate, channels, bits, word & (1 << 36) - 1, block, int.from_bytes(info[7:10], "big") or bound, at)


def _crc_table(poly: int, bits: int) -> list[int]:
    top, out = 1 << (bits - 1), []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1) ^ (poly if v & top else 0)
        out.append(v & (1 << bits) - 1)
    return out


#: Polynomials of the two checksums; fixed values.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = CRC8[c ^ b]
    return c


def crc16(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = (c << 8 & 0xFF00) ^ CRC16[c >> 8 ^ b]
    return c


#: Bits of a sample by the header's code (0: as in the stream); a fixed value.
SAMPLE_BITS = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@dataclass(frozen=True)
class Head:
    start: int
    n: int
    mode: int
    bits: int
    length: int


def head(raw: bytes, s: Stream) -> Head:
    """Of a frame at the beginning of ``raw``; ``mode`` is the channel assignment."""
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8 or raw[3] & 1:
        raise Broken("no frame")
    size, rate, mode, width = raw[2] >> 4, raw[2] & 15, raw[3] >> 4, raw[3] >> 1 & 7
    if not size or rate == 15 or mode > 10 or width not in SAMPLE_BITS or (mode + 1 if mode < 8 else 2) != s.channels:
        raise Broken("no frame of this stream")
    more = 0 if raw[4] < 0x80 else 8 - (raw[4] ^ 0xFF).bit_length()
    if more == 1 or more > 7 or len(raw) < 4 + max(1, more):
        raise Broken("no number")
    number = raw[4] & (0x7F if not more else (1 << (7 - more)) - 1)
    for b in raw[5 : 4 + more]:
        if b & 0xC0 != 0x80:
            raise Broken("no number")
        number = number << 6 | b & 0x3F
    at = 4 + max(1, more)
    if size in (6, 7):
        wide = size - 5
        n = int.from_bytes(raw[at : at + wide], "big") + 1
        at += wide
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if n > s.block:
        raise Broken("a frame larger than the stream's")
    if len(raw) <= at or crc8(raw[:at]) != raw[at]:
        raise Broken("checksum of a header")
    return Head(number if raw[1] & 1 else number * s.block, n, mode, SAMPLE_BITS[width] or s.bits, at + 1)


class _Bits:
    """Bits of a frame; ``one[i]`` is the place of the first 1 from i on."""

    def __init__(self, raw: bytes, at: int) -> None:
        self.raw, self.at, self.bits, self.one = raw, at * 8, np.unpackbits(np.frombuffer(raw, np.uint8)), None

    def take(self, n: int, signed: bool = False) -> int:
        a, b = self.at, self.at + n
        if b > len(self.raw) * 8:
            raise Broken("a frame that ends early")
        self.at = b
        v = int.from_bytes(self.raw[a >> 3 : (b + 7) >> 3], "big") >> (-b & 7) & (1 << n) - 1
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def table(self, n: int, width: int) -> np.ndarray:
        """n signed numbers of ``width`` bits."""
        if self.at + n * width > len(self.bits):
            raise Broken("a frame that ends early")
        if not width:
            return np.zeros(n, np.int64)
        got = self.bits[self.at : self.at + n * width].reshape(n, width).astype(np.int64)
        self.at += n * width
        v = got @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return v - (got[:, 0] << width)

    def _ones(self) -> list[int]:
        if self.one is None:
            far = len(self.bits) + 64
            where = np.where(self.bits, np.arange(len(self.bits)), far)
            self.one = np.minimum.accumulate(where[::-1])[::-1].tolist()
        return self.one

    def unary(self) -> int:
        q = self._ones()[self.at] - self.at
        self.at += q + 1
        return q

    def rice(self, n: int, k: int) -> np.ndarray:
        """n numbers, each a run of zeros, a one and k bits; only where the codes begin is found one by one."""
        one, p, begins = self._ones(), self.at, []
        step = k + 1
        try:
            for _ in range(n):
                begins.append(p)
                p = one[p] + step
        except IndexError:
            raise Broken("a frame that ends early") from None
        if p > len(self.bits):
            raise Broken("a frame that ends early")
        self.at = p
        b = np.array(begins, np.int64)
        ends = np.array([one[i] for i in begins], np.int64)
        low = np.zeros(n, np.int64)
        for j in range(1, step):
            low = low << 1 | self.bits[ends + j]
        u = ends - b << k | low
        return u >> 1 ^ -(u & 1)


def _residual(b: _Bits, n: int, order: int) -> np.ndarray:
    method, parts = b.take(2), 1 << b.take(4)
    if method > 1 or n % parts or n // parts < order:
        raise Broken("partitions of a residual")
    wide, out = 4 + method, []
    for i in range(parts):
        m = n // parts - (order if i == 0 else 0)
        k = b.take(wide)
        out.append(b.table(m, b.take(5)) if k == (1 << wide) - 1 else b.rice(m, k))
    return np.concatenate(out)


def _subframe(b: _Bits, n: int, bits: int) -> np.ndarray:
    if b.take(1):
        raise Broken("no subframe")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bits -= wasted
    if bits < 1:
        raise Broken("no bits left")
    if kind == 0:
        x = np.full(n, b.take(bits, True), np.int64)
    elif kind == 1:
        x = b.table(n, bits)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > n:
            raise Broken("more to begin with than samples")
        first = b.table(order, bits)
        if kind < 32:
            x = _summed(first, _residual(b, n, order))
        else:
            precision, shift = b.take(4) + 1, b.take(5, True)
            if precision == 16 or shift < 0:
                raise Broken("precision of a predictor")
            x = _predicted(first, b.table(order, precision), shift, _residual(b, n, order))
    else:
        raise Broken("a reserved subframe")
    return x << wasted


def _summed(first: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A residual of differences of the order of ``first``, summed up again as often."""
    x = residual
    for k in range(len(first) - 1, -1, -1):
        x = np.cumsum(np.r_[np.diff(first, k)[-1:], x])[1:]
    return np.r_[first, x]


def _predicted(first: np.ndarray, coefficients: np.ndarray, shift: int, residual: np.ndarray) -> np.ndarray:
    x, c = first.tolist(), coefficients[::-1].tolist()
    for i, r in enumerate(residual.tolist()):
        x.append(r + (sum(map(mul, c, x[i:])) >> shift))
    return np.array(x, np.int64)


def frame(raw: bytes, s: Stream) -> tuple[Head, np.ndarray, int]:
    """The frame at the beginning of ``raw``: header, samples (channels by n) and its length in bytes."""
    h = head(raw, s)
    b = _Bits(raw, h.length)
    side = {8: 1, 9: 0, 10: 1}.get(h.mode)
    try:
        x = np.array([_subframe(b, h.n, h.bits + (c == side)) for c in range(s.channels)])
    except (IndexError, OverflowError):
        raise Broken("a damaged frame") from None
    end = (b.at + 7) // 8
    if len(raw) < end + 2 or crc16(raw[:end]) != int.from_bytes(raw[end : end + 2], "big"):
        raise Broken("checksum of a frame")
    if h.mode == 8:
        x[1] = x[0] - x[1]
    elif h.mode == 9:
        x[0] = x[0] + x[1]
    elif h.mode == 10:
        mid = x[0] << 1 | x[1] & 1
        x = np.array([mid + x[1] >> 1, mid - x[1] >> 1])
    return h, x, end + 2


def frames(read, size: int, s: Stream, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:  # noqa: ANN001
    """(start, samples) of the frames that begin in bytes [begin, end) of the file: the mean over channels, scaled to -1 to 1. Damaged ones are passed over. One frame is held at a time."""
    at, chunk = max(begin, s.first), b""
    base = at
    while at < min(end, size):
        if at - base + s.most > len(chunk) and base + len(chunk) < size:
            base, chunk = at, read(min(4 * s.most, size - at), at)
        try:
            h, x, n = frame(chunk[at - base : at - base + s.most], s)
        except Broken:
            # To the next byte that could begin one.
            found = chunk.find(b"\xff", at - base + 1)
            at = base + (len(chunk) if found < 0 else found)
            continue
        yield h.start, (x.mean(axis=0) / (1 << (h.bits - 1))).astype(np.float32)
        at += n


def length(read, size: int, s: Stream) -> int:  # noqa: ANN001
    """Samples a channel: where the last whole frame ends, which is looked for from the end of the file."""
    back = 2 * s.most
    while True:
        begin = max(s.first, size - back)
        last = 0
        for start, x in frames(read, size, s, begin, size):
            last = max(last, start + len(x))
        if last or begin == s.first:
            return last
        back *= 4
