"""FLAC frames against a plain writer of the format, which writes every kind of subframe."""

import numpy as np
import pytest

from tonalis.sources import audio, flac, readers


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [int(v) >> (n - 1 - i) & 1 for i in range(n)]

    def unary(self, q):
        self.bits += [0] * int(q) + [1]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def remainder(raw, poly, n):
    """Checksum by long division, bit by bit."""
    c, mask = 0, (1 << n) - 1
    for b in raw:
        for i in range(7, -1, -1):
            top = c >> (n - 1) & 1 ^ b >> i & 1
            c = c << 1 & mask
            c ^= poly if top else 0
    return c


def residual(w, r, order, method, parts, k):
    """k: parameter, None for samples as they are."""
    wide = 4 + method
    w.put(method, 2)
    w.put(parts, 4)
    n = (len(r) + order) >> parts
    for i in range(1 << parts):
        a, b = max(0, i * n - order), (i + 1) * n - order
        if k is None:
            width = max((int(abs(v)).bit_length() + 1 for v in r[a:b]), default=0)
            w.put((1 << wide) - 1, wide)
            w.put(width, 5)
            for v in r[a:b]:
                w.put(v, width)
        else:
            w.put(k, wide)
            for v in r[a:b]:
                u = 2 * v if v >= 0 else -2 * v - 1
                w.unary(u >> k)
                w.put(u & (1 << k) - 1, k)


def subframe(w, x, bits, kind, method=0, parts=0, k=3):
    x = [int(v) for v in x]
    wasted = 0
    while any(x) and not any(v >> wasted & 1 for v in x):
        wasted += 1
    w.put(0, 1)
    w.put({"constant": 0, "verbatim": 1}.get(kind[0], kind[1] + (8 if kind[0] == "fixed" else 31)), 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.unary(wasted - 1)
    x, bits = [v >> wasted for v in x], bits - wasted
    if kind[0] == "constant":
        w.put(x[0], bits)
    elif kind[0] == "verbatim":
        for v in x:
            w.put(v, bits)
    else:
        order = kind[1]
        for v in x[:order]:
            w.put(v, bits)
        if kind[0] == "fixed":
            r = [int(v) for v in np.diff(np.array(x, np.int64), order)]
        else:
            c, shift = kind[2], kind[3]
            w.put(11, 4)
            w.put(shift, 5)
            for v in c:
                w.put(v, 12)
            r = [x[i] - (sum(c[j] * x[i - 1 - j] for j in range(order)) >> shift) for i in range(order, len(x))]
        residual(w, r, order, method, parts, k)


def number(v):
    if v < 0x80:
        return [v]
    out = []
    n = 2
    while v >= 1 << (5 * n + 1):
        n += 1
    for _ in range(n - 1):
        out.insert(0, 0x80 | v & 0x3F)
        v >>= 6
    return [0xFF << (8 - n) & 0xFF | v, *out]


def frame(x, at, bits, kinds, mode=None, variable=False, **how):
    """x: channels by samples."""
    x = np.asarray(x, np.int64)
    head = [0xFF, 0xF8 | variable, 7 << 4, (len(x) - 1 if mode is None else mode) << 4 | {8: 1, 16: 4, 24: 6}[bits] << 1, *number(at), *(x.shape[1] - 1).to_bytes(2, "big")]
    w = Writer()
    for b in [*head, remainder(head, 0x07, 8)]:
        w.put(b, 8)
    side = x[0] - x[-1]
    coded = {None: list(x), 8: [x[0], side], 9: [side, x[-1]], 10: [x[0] + x[-1] >> 1, side]}[mode]
    for c, (v, kind) in enumerate(zip(coded, kinds, strict=True)):
        subframe(w, v, bits + (mode is not None and c == {8: 1, 9: 0, 10: 1}[mode]), kind, **how)
    raw = w.bytes()
    return raw + remainder(raw, 0x8005, 16).to_bytes(2, "big")


def file(frames, rate, channels, bits, n, block, most=0):
    info = block.to_bytes(2, "big") * 2 + bytes(3) + most.to_bytes(3, "big") + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x81\0\0\x09" + b"\xff\xf8 extra" + b"!" + b"".join(frames)


KINDS = [("constant", 0), ("verbatim", 0), *(("fixed", k) for k in range(5)), ("lpc", 1, [1000], 10), ("lpc", 3, [1500, -700, 90], 10), ("lpc", 32, [30 - i for i in range(32)], 9)]


def signal(n, channels=1, bits=16, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    scale = 1 << (bits - 3)
    return np.array([np.rint(scale * np.sin(t / (9 + 4 * c)) + rng.normal(0, scale / 60, n)) for c in range(channels)], np.int64)


def read_all(raw):
    read = lambda n, at: raw[at : at + n]
    s = flac.stream(read, len(raw))
    return s, list(flac.frames(read, len(raw), s, 0, len(raw)))


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: f"{k[0]}{k[1]}")
@pytest.mark.parametrize("how", [{}, {"method": 1, "parts": 2, "k": 6}, {"k": None, "parts": 1}, {"k": 0}], ids=str)
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_subframes(kind, how, bits):
    x = signal(160, bits=bits) if bits == 8 or how.get("k", 3) else signal(160, bits=bits) // (1 << (bits - 8))
    x = np.full((1, 160), -5) if kind[0] == "constant" else x << 2 if kind[0] == "verbatim" and bits > 8 else x
    x = np.clip(x, -(1 << (bits - 1)), (1 << (bits - 1)) - 4)
    raw = frame(x, 0, bits, [kind], **({"k": 12} if bits == 24 and how == {} else how))
    h, got, n = flac.frame(raw, flac.Stream(8000, 1, bits, 160, 160, len(raw), 0))
    assert np.array_equal(got, x) and n == len(raw) and h.bits == bits


@pytest.mark.parametrize("mode", [None, 8, 9, 10])
def test_channels(mode):
    x = signal(200, 2)
    h, got, _ = flac.frame(frame(x, 3, 16, [("fixed", 2)] * 2, mode, k=9), flac.Stream(8000, 2, 16, 0, 200, 9999, 0))
    assert np.array_equal(got, x) and h.start == 600


def test_checksums_and_numbers():
    rng = np.random.default_rng(4)
    for _ in range(20):
        raw = rng.bytes(int(rng.integers(0, 50)))
        assert flac.crc8(raw) == remainder(raw, 0x07, 8) and flac.crc16(raw) == remainder(raw, 0x8005, 16)
    for at in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21, 1 << 26, (1 << 31) - 1, (1 << 36) - 1):
        assert flac.head(frame(signal(20), at, 16, [("verbatim", 0)], variable=True), flac.Stream(8000, 1, 16, 0, 20, 999, 0)).start == at
    with pytest.raises(flac.Broken):
        flac.stream(lambda n, at: b"fLaC"[at : at + n], 4)


def test_damage_costs_only_its_frames():
    x = signal(1000, seed=3)
    parts = [frame(x[:, a : a + 100], a // 100, 16, [("fixed", 1)], k=9) for a in range(0, 1000, 100)]
    whole = file(parts, 8000, 1, 16, 1000, 100)
    s, got = read_all(whole)
    assert [a for a, _ in got] == list(range(0, 1000, 100)) and np.array_equal(np.concatenate([v for _, v in got]), (x[0] / 32768).astype(np.float32))
    hurt = bytearray(whole)
    hurt[s.first + len(parts[0]) + 40] ^= 1
    assert [a for a, _ in read_all(bytes(hurt))[1]] == [0, *range(200, 1000, 100)]
    rate, y = audio.decoded(bytes(hurt[:-7]))
    want = (x[0, :900] / 32768).astype(np.float32)
    want[100:200] = 0
    assert rate == 8000 and np.array_equal(y, want)
    with pytest.raises(audio.Unreadable):
        audio.decoded(whole[:20])


@pytest.mark.parametrize("variable", [False, True])
@pytest.mark.parametrize("chunk", [64, 700, 1 << 18])
def test_blocks_of_files(spark, tmp_path, variable, chunk):
    want = {}
    for name, n, channels in (("a", 3300, 2), ("b", 90, 1), ("c", 1000, 1), ("d", 1, 1)):
        x = signal(n, channels, seed=len(name))
        ends = [0, *(range(128, n, 128) if not variable else sorted({n * k // 17 for k in range(1, 17)} - {0})), n]
        parts = [frame(x[:, a:b], a if variable else i, 16, [("verbatim", 0) if b - a < 4 else ("lpc", 3, [1500, -700, 90], 10)] * channels, k=9, variable=variable) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        (tmp_path / f"{name}.flac").write_bytes(file(parts, 1000, channels, 16, 0 if name == "c" else n, 256 if variable else 128, max(map(len, parts)) if name == "a" else 0))
        want[name] = (x.mean(axis=0) / 32768).astype(np.float32)
    (tmp_path / "bad.flac").write_bytes(b"fLaC\0\0")
    (tmp_path / "none.flac").write_bytes(file([], 1000, 1, 16, 0, 128))
    files = readers.audio_files(spark, str(tmp_path))
    got = {}
    for r in audio.flac_blocks(files, size=300, chunk=chunk).orderBy("path", "block").collect():
        own = got.setdefault(r.path.rsplit("/", 1)[1][:-5], [])
        assert r.start == sum(map(len, own)) and r.start == r.block * 300
        own.append(r.samples)
    assert {k: len(np.concatenate(v)) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(np.array_equal(np.concatenate(got[k]), v.astype(np.float64)) for k, v in want.items())
    whole = {r.path.rsplit("/", 1)[1][:-5]: r.samples for r in readers.decode(files).collect()}
    assert all(np.array_equal(np.array(whole[k], np.float32), v) for k, v in want.items())


def test_recordings_of_both_kinds_are_framed_alike(spark, tmp_path):
    from tonalis.sources import sinks as K

    x = signal(5000)
    (tmp_path / "x.wav").write_bytes(K.wav_bytes(x[0] / 32767, 1000))
    (tmp_path / "x.flac").write_bytes(file([frame(x[:, a : a + 512], a // 512, 16, [("fixed", 2)], k=9) for a in range(0, 5000, 512)], 1000, 1, 16, 5000, 512))
    got = {}
    for r in audio.recording_blocks(readers.audio_files(spark, str(tmp_path)), size=700).collect():
        got.setdefault(r.path[-4:], {})[r.start] = r.samples
    assert got[".wav"] == got["flac"] and sorted(got[".wav"]) == list(range(0, 4900, 700))
