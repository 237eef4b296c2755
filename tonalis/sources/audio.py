"""Audio files by byte ranges: headers, and blocks of samples of WAV and FLAC files of any length.

Spark lists the files, with the scheme of the file system that they are on; tasks read headers,
and each block of samples is a row whose task reads its own bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.sources import flac

#: Format tags of WAV; fixed values.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class Unreadable(Exception):
    """Not an audio file that is known here, or a broken one."""


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are: ``n`` frames of all channels from ``offset`` on. ``kind``: int, float or flac."""

    kind: str
    rate: int
    channels: int
    bits: int
    offset: int
    n: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def opened(path: str) -> pa.NativeFile:
    """A file of the local or shared file system, or of a store that ``pyarrow.fs`` opens by URI. A path without scheme is local: Spark's own listing always gives one."""
    fs, name = (pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def layout(f: pa.NativeFile) -> Layout:
    """From the headers alone; a data chunk that is longer than the file, as of a broken-off recording, ends with it."""
    size = f.size()
    head = f.read_at(min(size, 42), 0)
    if head[:4] == b"fLaC":
        return _flac(head)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise Unreadable("neither RIFF nor FLAC")
    at, form, large = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", f.read_at(8, at))
        at += 8
        if name == b"ds64":
            large = struct.unpack("<QQ", f.read_at(16, at))[1]
        elif name == b"fmt ":
            if length < 16:
                raise Unreadable("a short format chunk")
            form = f.read_at(min(length, 40), at)
        elif name == b"data":
            if form is None:
                raise Unreadable("no format before the samples")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if tag == EXTENSIBLE and len(form) >= 26:
                tag = struct.unpack("<H", form[24:26])[0]
            if tag not in (PCM, FLOAT) or not channels or not rate or bits not in ((8, 16, 24, 32) if tag == PCM else (32, 64)):
                raise Unreadable(f"format {tag} of {bits} bits")
            length = large if large is not None and length == 0xFFFFFFFF else length
            return Layout("int" if tag == PCM else "float", rate, channels, bits, at, min(length, size - at) // (channels * bits // 8))
        at += length + length % 2
    raise Unreadable("no samples")


def _flac(head: bytes) -> Layout:
    """From STREAMINFO, which comes first: 20 bits of rate, 3 of channels less one, 5 of bits less one, 36 of the number of samples, from byte 18 on."""
    if len(head) < 42 or head[4] & 0x7F:
        raise Unreadable("no stream information")
    word = int.from_bytes(head[18:26], "big")
    rate = word >> 44
    if not rate:
        raise Unreadable("no sample rate")
    return Layout("flac", rate, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, 0, word & (1 << 36) - 1)


def samples(raw: bytes, at: Layout) -> np.ndarray:
    """Mean over channels of whole frames, whole numbers scaled to -1 to 1."""
    if at.kind == "float":
        x = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[at.bits]).astype(np.float32)
    elif at.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif at.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {16: "<i2", 32: "<i4"}[at.bits]).astype(np.float32) / (1 << (at.bits - 1))
    return x.reshape(-1, at.channels).mean(axis=1).astype(np.float32)


def wav_blocks(files: DataFrame, ident: str = "path", size: int = 1 << 16) -> DataFrame:
    """Blocks (``operators.blocks``) of WAV files: <ident>, sample_rate_hz, n, block, start, samples. FLAC, unreadable and empty files give none.

    Of ``files`` only ``path`` is used, so that Spark doesn't load the content; filters on it
    come before any file is opened. A task holds one block of one file at a time.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        at = layout(f)
                except (Unreadable, OSError, ValueError):
                    continue
                if at.kind != "flac" and at.n:
                    rows.append((path, at.kind, at.rate, at.channels, at.bits, at.offset, at.n))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "kind", "rate", "channels", "bits", "offset", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = Layout(r["kind"], r["rate"], r["channels"], r["bits"], r["offset"], r["n"])
                start = r["block"] * size
                stop = at.n if r["block"] == r["last"] else start + size
                with opened(r["path"]) as f:
                    x = samples(f.read_at((stop - start) * at.frame, at.offset + start * at.frame), at)
                yield pa.record_batch([pa.array([r["path"]]), pa.array([at.rate], pa.int32()), pa.array([at.n], pa.int64()), pa.array([r["block"]], pa.int32()), pa.array([start], pa.int64()), pa.array([x.astype(np.float64)], pa.list_(pa.float64()))], names=[ident, "sample_rate_hz", "n", "block", "start", "samples"])

    head = files.select("path").mapInArrow(heads, "path string, kind string, rate int, channels int, bits int, offset long, n long")
    last = (F.greatest(F.floor(F.col("n") / size), F.lit(1)) - 1).cast("int")
    each = head.withColumn("last", last).withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "path", "block").mapInArrow(read, f"{ident} string, sample_rate_hz int, n long, block int, start long, samples array<double>")


def decoded(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (mean over channels) of a whole file's bytes."""
    at = layout(pa.BufferReader(raw))
    if at.kind != "flac":
        return at.rate, samples(raw[at.offset : at.offset + at.n * at.frame], at)
    read = lambda n, offset: raw[offset : offset + n]
    try:
        s = flac.stream(read, len(raw))
    except flac.Broken as e:
        raise Unreadable(str(e)) from None
    x = np.zeros(flac.length(read, len(raw), s), np.float32)
    for start, part in flac.frames(read, len(raw), s, 0, len(raw)):
        x[start : start + len(part)] = part[: max(0, len(x) - start)]
    return s.rate, x


def flac_blocks(files: DataFrame, ident: str = "path", size: int = 1 << 16, chunk: int = 1 << 18) -> DataFrame:
    """The same blocks of FLAC files; others, and those without a whole frame, give none.

    A task reads ``chunk`` bytes: it looks for the first frame that begins there and reads the frames
    from there on, one at a time; frames say which samples they hold, and blocks are put together
    from them. A file ends with its last whole frame; samples of damaged frames before it are 0.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        s = flac.stream(f.read_at, f.size())
                        n = flac.length(f.read_at, f.size(), s)
                        if n:
                            rows.append((path, s.rate, n, s.first, f.size()))
                except (flac.Broken, OSError, ValueError):
                    continue
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "rate", "n", "first", "bytes"])

    def piece(path: str, block: int, start: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts).astype(np.float64)
        return pa.record_batch([pa.array([path]), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([x], pa.list_(pa.float64()))], names=["path", "block", "start", "samples"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                path, n, last = r["path"], r["n"], r["last"]
                begin = r["first"] + r["k"] * chunk
                with opened(path) as f:
                    now, parts, till = (0, 0), [], -1  # block and start of what is gathered, and where it ends
                    for start, x in flac.frames(f.read_at, r["bytes"], flac.stream(f.read_at, r["bytes"]), begin, begin + chunk):
                        x = x[: max(0, n - start)]
                        while len(x):
                            block = min(start // size, last)
                            m = len(x) if block == last else min(len(x), (block + 1) * size - start)
                            if parts and (block, start) != (now[0], till):
                                yield piece(path, *now, parts)
                                parts = []
                            if not parts:
                                now = (block, start)
                            parts.append(x[:m])
                            start, x = start + m, x[m:]
                            till = start
                    if parts:
                        yield piece(path, *now, parts)

    last = (F.greatest(F.floor(F.col("n") / size), F.lit(1)) - 1).cast("int")
    head = files.select("path").mapInArrow(heads, "path string, rate int, n long, first long, bytes long").withColumn("last", last)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = head.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - F.col("first") - 1) / chunk))))
    got = ranges.repartition(n, "path", "k").mapInArrow(read, "path string, block int, start long, samples array<double>")
    got = got.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("start", "samples"))).alias("_z"))  # a block's samples
    grid = head.select("path", "rate", "n", "last", F.explode(F.sequence(F.lit(0), "last")).alias("block")).withColumn("_from", F.col("block").cast("long") * size)
    none = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    before = lambda i: F.coalesce(F.get("_z", i - 1)["start"] + F.size(F.get("_z", i - 1)["samples"]), F.col("_from"))
    filled = F.flatten(F.transform("_z", lambda p, i: F.concat(none(p["start"] - before(i)), p["samples"])))
    long = F.when(F.col("block") == F.col("last"), F.col("n") - F.col("_from")).otherwise(F.lit(size))
    each = grid.join(got, ["path", "block"], "left").withColumn("_x", F.coalesce(filled, F.expr("cast(array() as array<double>)")))
    return each.select(F.col("path").alias(ident), F.col("rate").alias("sample_rate_hz"), "n", "block", F.col("_from").alias("start"), F.concat("_x", none(long - F.size("_x"))).alias("samples"))


def recording_blocks(files: DataFrame, ident: str = "path", size: int = 1 << 16) -> DataFrame:
    """Blocks of all files that can be read, WAV and FLAC."""
    named = F.lower("path").rlike(r"\.flac$")
    return wav_blocks(files.filter(~named), ident, size).unionByName(flac_blocks(files.filter(named), ident, size))
