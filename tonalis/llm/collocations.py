"""Phrase collocation mining: count streams in prefix and suffix order, merged in lockstep.

One window is made for each word: the word and up to four after it in its piece. A window stands
for all phrases that begin at its word, so one sorted stream of windows holds the counts of every
order: ``f(phrase)`` is the sum over the windows that begin with it, a run in prefix order.

* A task sorts the windows of a chunk of words into a run, adds up equal ones, and cuts the run
  into blocks: at the borders of ranges and after every ``BLOCK`` windows. A block has a small
  vocabulary of its own, so that a window is five small numbers.
* There are as many ranges as give each about ``RANGE`` windows (at least one for each partition
  of a shuffle), so that a range stays as large as it is however many chunks there are.
* Blocks go to their range, where Spark sorts them by their first window. A range is merged in
  lockstep: what lies before the first window of the next block is complete, and is added up and
  let go. A task holds about ``HELD`` windows, and no more than two blocks of each chunk besides.
  What can't go yet is merged anew only when it has doubled, not with each block.
* Phrases below the least count leave there, but for those that a border cuts, which are added up
  afterwards. No table of words or phrases is broadcast, and nothing is found by hashing.

The counts that are left are streamed twice, in prefix and in suffix order. Phrases that begin
(end) alike are neighbours, shorter ones first, so one pass gives each phrase the counts of its
first (last) parts and the largest count of a phrase that is longer by a word. The two streams
then meet in a merge join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalis.llm._util import cut, prepare, table, text_or_empty

WORDS, LEAST, TOP = 5, 100, 2000
#: Share of a phrase's count, in hundredths, from which a longer phrase replaces it.
ABSORB = 100
#: Words of a chunk, windows of a block, windows of a range and windows that a merging task lets gather.
CHUNK, BLOCK, RANGE, HELD = 3_000_000, 4096, 1_500_000, 2_000_000
#: Lower-cases A-Z; ends of pieces become one byte that no text has, tabs become spaces.
_END, _SPACE = b"\xff", 32
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _END * 10 + b" ")
#: Ends a word in a key. As no word has it, keys in byte order are phrases in prefix order.
_TAB = b"\t"


@dataclass
class Run:
    """Sorted distinct windows: ``at`` has a row for each of WORDS words, with places in ``words`` plus 1 (0 beyond a window's end), and a column for each window; their counts. ``words`` end in _TAB and are sorted."""

    words: pa.LargeBinaryArray
    at: np.ndarray
    n: np.ndarray

    def key(self, i: int, upto: int = WORDS) -> bytes:
        return b"".join(self.words[int(x) - 1].as_py() for x in self.at[:upto, i] if x)

    def places(self, keys: list[bytes]) -> list[int]:
        """Windows before each of ``keys``."""
        words = self.words.to_pylist()
        return [self._place(words, key) for key in keys]

    def _place(self, words: list[bytes], key: bytes) -> int:
        lo, hi = 0, len(self.n)
        for j, word in enumerate(key.split(_TAB)[:-1]):
            word += _TAB
            rank = bisect_left(words, word)
            row = self.at[j, lo:hi]
            lo, hi = lo + int(np.searchsorted(row, row.dtype.type(rank + 1))), lo + int(np.searchsorted(row, row.dtype.type(rank + 1), "right"))
            if rank == len(words) or words[rank] != word:
                return lo
        return lo

    def part(self, a: int, b: int) -> Run:
        return Run(self.words, self.at[:, a:b], self.n[a:b])

    def small(self) -> Run:
        """The same with no more words than it needs."""
        used, at = _used(self.at, len(self.words))
        return Run(self.words.take(pa.array(used - 1)), at, self.n)

    def packed(self) -> bytes:
        own = self.small()
        n, at = (x.astype(np.min_scalar_type(most)) for x, most in ((own.n, int(own.n.max(initial=0))), (own.at, len(own.words))))
        body = [np.array([len(n), n.itemsize, at.itemsize], np.int64).tobytes(), n.tobytes(), at.tobytes(), _bytes(own.words).tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @staticmethod
    def unpacked(data: bytes) -> Run:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, *sizes = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        counts = np.frombuffer(raw, f"u{sizes[0]}", n, 24)
        at = np.frombuffer(raw, f"u{sizes[1]}", WORDS * n, 24 + counts.nbytes).reshape(WORDS, n)
        words = np.frombuffer(raw, np.uint8, offset=24 + counts.nbytes + at.nbytes)
        return Run(_array(words, np.flatnonzero(words == _TAB[0]) + 1), at, counts.astype(np.int64))


def _array(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Strings that lie one behind the other in ``data``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])


def _ends(words: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)


def _bytes(words: pa.LargeBinaryArray) -> np.ndarray:
    ends = _ends(words)
    return np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.zeros(0, np.uint8)


def _used(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places but 0 that ``at`` holds, of 1 to n; ``at`` as places in those, plus 1."""
    if 16 * at.size < n:
        used = np.unique(at)
        used = used[used > 0]
        return used, np.where(at > 0, np.searchsorted(used, at) + 1, 0).astype(np.int32)
    has = np.zeros(n + 1, bool)
    has[at] = True
    has[0] = False
    used = np.flatnonzero(has)
    to = np.zeros(n + 1, np.int32)
    to[used] = np.arange(1, len(used) + 1)
    return used, to[at]


def _ranked(words: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct ones of ``words`` in order, and the place of each of ``words`` in them, plus 1; 0 for a lone _TAB, which is none."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    order = order[np.diff(_ends(coded.dictionary))[order] > 1]
    place = np.zeros(len(coded.dictionary), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _sorted(words: pa.LargeBinaryArray, at: np.ndarray, n: np.ndarray) -> Run:
    """Windows in any order as a run: by their first three words, and by the other two where those are the same."""
    bits = len(words).bit_length()
    if not len(n):
        return Run(words, at, n)
    if 3 * bits > 63:
        order = np.lexsort(at[::-1])
        own = at[:, order]
        first = np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)]
    else:
        head = at[0].astype(np.int64) << 2 * bits | at[1].astype(np.int64) << bits | at[2]
        order = np.argsort(head, kind="stable")
        head = head[order]
        first = np.r_[True, head[1:] != head[:-1]]
        tied = np.flatnonzero(~(first & np.r_[first[1:], True]))
        group, own = np.cumsum(first[tied]), order[tied]
        tail = at[3, own].astype(np.int64) << bits | at[4, own]
        inner = np.argsort(group << 2 * bits | tail) if len(tied).bit_length() + 2 * bits < 64 else np.lexsort((tail, group))
        order[tied], tail = own[inner], tail[inner]
        first[tied[1:]] |= tail[1:] != tail[:-1]
    start = np.flatnonzero(first)
    return Run(words, at[:, order[start]], np.add.reduceat(n[order], start))


def windows(ids: np.ndarray, words: pa.LargeBinaryArray, size: int) -> Iterator[Run]:
    """Runs of the windows of a text of ids (places in ``words`` plus 1; 0 ends a piece), at most ``size`` words each."""
    for a in range(0, len(ids), size):
        used, own = _used(ids[a : a + size + WORDS - 1], len(words))
        begin = np.flatnonzero(own[:size])
        own = np.r_[own, np.zeros(WORDS - 1, np.int32)]
        at = np.empty((WORDS, len(begin)), np.int32)
        at[0] = own[begin]
        for j in range(1, WORDS):
            at[j] = own[begin + j] * (at[j - 1] > 0)
        yield _sorted(words.take(pa.array(used - 1)), at, np.ones(len(begin), np.int64))


def merged(runs: list[Run]) -> Run:
    """One run of several; a block's words are few, so those of about HELD windows fit."""
    if len(runs) == 1:
        return Run(runs[0].words, runs[0].at.astype(np.int32), runs[0].n)
    words, to = _ranked(pa.concat_arrays([r.words for r in runs]))
    at, x, y = np.empty((WORDS, sum(len(r.n) for r in runs)), np.int32), 0, 0
    for r in runs:
        at[:, x : x + len(r.n)] = np.r_[np.int32(0), to[y : y + len(r.words)]][r.at]
        x, y = x + len(r.n), y + len(r.words)
    return _sorted(words, at, np.concatenate([r.n for r in runs]))


def _slots(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words (or nothing) with the byte behind each, a space or _END, which also ends each text; where each text's begin (and, last, the end)."""
    data = np.frombuffer((_END.join(texts) + _END).translate(_TABLE), np.uint8)
    ends = np.flatnonzero((data == _SPACE) | (data == _END[0])) + 1
    return _array(data, ends).dictionary_encode(), np.r_[0, np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]), "right")]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Run]]:
    """Runs of (lang, text in UTF-8) batches, one language each."""
    held, vocabularies, total, read = {}, [], 0, 0  # slots by language, of a vocabulary each; slots and bytes

    def out() -> Iterator[tuple[str, Run]]:
        words, place = _ranked_slots(vocabularies)
        for lang in list(held):
            ids = np.concatenate([place[v][:, x] for v, x in held.pop(lang)], axis=1).T.ravel()
            for run in windows(ids[ids >= 0], words, size + size // 4):
                yield lang, run

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        while order:
            # Some texts at a time, of at most an eighth of a chunk's words, but for a longer one.
            upto = np.cumsum([len(texts[i]) + 1 for i in order])
            n = max(1, int(np.searchsorted(upto, size // 4, "right")))
            some, order = order[:n], order[n:]
            coded, at = _slots([texts[i] for i in some])
            codes, x = coded.indices.to_numpy(), 0
            for lang, group in groupby(langs[i] for i in some):
                y = x + sum(1 for _ in group)
                held.setdefault(lang, []).append((len(vocabularies), codes[at[x] : at[y]]))
                x = y
            vocabularies.append(coded.dictionary)
            total, read = total + len(codes), read + int(upto[n - 1])
            if total >= size or read >= 16 * size:
                yield from out()
                held, vocabularies, total, read = {}, [], 0, 0
    if total:
        yield from out()


def _ranked_slots(vocabularies: list[pa.LargeBinaryArray]) -> tuple[pa.LargeBinaryArray, list[np.ndarray]]:
    """The words of several vocabularies of slots, each with _TAB behind it; for each vocabulary the place of its words plus 1 (-1 for none) and, below, 0 where a piece ends (else -1)."""
    slots = pa.concat_arrays(vocabularies)
    data, ends = _bytes(slots).copy(), _ends(slots)[1:] - _ends(slots)[0]
    stop = data[ends - 1] == _END[0]
    data[ends - 1] = _TAB[0]
    words, place = _ranked(_array(data, ends))
    both = np.array([np.where(place > 0, place, -1), np.where(stop, 0, -1)], np.int32)
    return words, np.split(both, np.cumsum([len(v) for v in vocabularies])[:-1], axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))


Border = tuple[str, bytes]


def _borders(texts: DataFrame, n: int, size: int, each: int = 2048, most: int = 4000) -> list[Border]:
    """Borders of n ranges of about as many windows, or of more where ranges would have over ``size``; by the windows of some ``most`` documents, or of one in 300. They shape the work, not the result."""
    rows = texts.count()
    rate = min(1.0, max(most, 20 * n, rows // 300) / max(1, rows))
    some = texts.filter((F.xxhash64("lang", "text").bitwiseAND(F.lit(2**31 - 1))) <= int(rate * 2**31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, r in _chunks(batches, CHUNK):
            at = np.unique(np.linspace(0, len(r.n), min(each, len(r.n) // 512 + 1), endpoint=False).astype(int)) if len(r.n) else []
            weight = len(r.n) / max(1, len(at))
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([r.key(i) for i in at], pa.binary()), pa.array([weight] * len(at), pa.float64())], names=["lang", "key", "weight"])

    found = sorted((x.lang, bytes(x.key), x.weight) for x in some.coalesce(max(1, n // 4)).mapInArrow(run, "lang string, key binary, weight double").collect())
    return _cuts(found, max(n, int(sum(w for *_, w in found) / rate / size) + 1))


def _cuts(found: list[tuple[str, bytes, float]], n: int) -> list[Border]:
    upto = np.cumsum([w for *_, w in found])
    at = np.searchsorted(upto, np.arange(1, n) * (upto[-1] / n)) if len(found) else []
    return sorted({found[i][:2] for i in at})


def counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, block: int = BLOCK, size: int = RANGE, held: int = HELD) -> DataFrame:
    """lang, phrase (words, each followed by a tab), f: of phrases of 1 to WORDS words with f >= least, and of the empty phrase (f: all words)."""
    spark = docs.sparkSession
    prepare(spark)
    texts, n_parts = _texts(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(_borders(texts, n_parts, size))  # fewer than there are ranges
    n_parts = max(n_parts, len(sent.value) + 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = sent.value
        for lang, run in _chunks(batches, chunk):
            own = [(i, k) for i, (x, k) in enumerate(borders) if x == lang]
            part0 = bisect_right(borders, (lang, b""))
            cuts = [(part0, 0), *zip((i + 1 for i, _ in own), run.places([k for _, k in own]), strict=True)]
            rows = []
            for (part, a), b in zip(cuts, [*(c for _, c in cuts[1:]), len(run.n)], strict=True):
                rows += [(part, x, min(x + block, b)) for x in range(a, b, block)]
            for x in range(0, len(rows), 64):
                some = rows[x : x + 64]
                yield pa.record_batch(
                    [pa.array([p for p, *_ in some], pa.int32()), pa.array([lang] * len(some)), pa.array([run.key(a) for _, a, _ in some], pa.binary()), pa.array([run.part(a, b).packed() for _, a, b in some], pa.binary())],
                    names=["part", "lang", "first", "block"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(batches, sent.value, least, held)

    dealt = texts.mapInArrow(blocks, "part int, lang string, first binary, block binary").repartitionById(n_parts, "part").sortWithinPartitions("lang", "first")
    # A phrase comes from one range, but for those that a border cuts.
    return dealt.mapInArrow(merge, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= F.when(F.length("phrase") == 0, 1).otherwise(least))


def _merge(batches: Iterator[pa.RecordBatch], borders: list[Border], least: int, held: int) -> Iterator[pa.RecordBatch]:
    lang, runs, total, part, most = None, [], 0, 0, held
    open_: dict[bytes, int] = {}  # counts so far of phrases that go on behind the last flush

    def flush(run: Run) -> pa.RecordBatch:
        cutting = {k[:i] for x, k in borders[max(0, part - 1) : part + 1] if x == lang for i in range(len(k) + 1) if not i or k[i - 1 : i] == _TAB}
        found = []
        last = {run.key(len(run.n) - 1, k) for k in range(WORDS + 1)}
        alike = np.cumprod(run.at[:, 1:] == run.at[:, :-1], axis=0, dtype=np.int8).sum(axis=0, dtype=np.int8)  # words that a window begins with as the one before does
        upto = np.r_[0, np.cumsum(run.n)]
        for k in range(WORDS + 1):
            start = np.r_[0, np.flatnonzero(alike < k) + 1]
            f = np.diff(upto[np.r_[start, len(run.n)]])
            if k:
                has = run.at[k - 1, start] > 0
                start, f = start[has], f[has]
            if not len(f):
                continue
            # The first and last may be open or cut, whatever their count.
            for i in np.unique(np.r_[0, np.flatnonzero(f >= least), len(f) - 1]):
                found.append((run.key(start[i], k), int(f[i])))
        out = {}
        for key, f in found:
            f += open_.pop(key, 0)
            if key in last:
                out[key] = (f, True)
            elif f >= least or key in cutting:
                out[key] = (f, False)
        gone = [(k, f) for k, f in open_.items() if f >= least or k in cutting]
        open_.clear()
        open_.update({k: f for k, (f, goes) in out.items() if goes})
        return rows(gone + [(k, f) for k, (f, goes) in out.items() if not goes])

    def close() -> pa.RecordBatch:
        out = list(open_.items())  # at the end of a range or language; what is too rare is left out after adding up
        open_.clear()
        return rows(out)

    def rows(x: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([lang] * len(x), pa.string()), pa.array([k for k, _ in x], pa.binary()), pa.array([f for _, f in x], pa.int64())], names=["lang", "phrase", "f"])

    for b in batches:
        for p, x, first, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if x != lang or p != part:
                if runs:
                    yield flush(merged(runs))
                    yield close()
                lang, part, runs, total, most = x, p, [], 0, held
            elif total >= most:
                whole = merged(runs)
                done = whole.places([first])[0]
                if done:
                    yield flush(whole.part(0, done))
                rest = whole.part(done, len(whole.n)).small()
                runs, total = [rest] if len(rest.n) else [], len(rest.n)
                most = max(held, 2 * total)  # else what can't go yet is merged anew with each block
            runs.append(Run.unpacked(data))
            total += len(runs[-1].n)
    if runs:
        yield flush(merged(runs))
        yield close()


def _turned(phrase: bytes) -> bytes:
    """The key in suffix order: the words from last to first."""
    return b"".join(w + _TAB for w in reversed(phrase.split(_TAB)[:-1]))


def stream(found: DataFrame, suffix: bool = False) -> DataFrame:
    """The counts in one order: lang, phrase, parts (array: f of its first 0, 1, ... words, or with ``suffix`` of its last ones; the phrase's own count comes last), longer (the largest f of a phrase longer by a word at its end, or at its beginning).

    Phrases that a border of ranges begins with are sent to both sides of it, so that each task
    sees the parts of all its phrases; ``longer`` is then the larger of both.
    """
    spark = found.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = _turned if suffix else lambda x: x
    rate = min(1.0, 200.0 * n_parts / max(1, found.count()))
    some = found.filter(F.xxhash64("lang", "phrase").bitwiseAND(F.lit(2**31 - 1)) <= int(rate * 2**31)).select("lang", "phrase").collect()
    borders = _cuts(sorted((x.lang, turn(bytes(x.phrase)), 1.0) for x in some), n_parts)
    sent = spark.sparkContext.broadcast(borders)  # fewer than there are ranges

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                key = turn(phrase)
                p = bisect_right(sent.value, (lang, key))
                out.append((p, lang, key, f))
                while p < len(sent.value) and sent.value[p][0] == lang and sent.value[p][1].startswith(key):
                    p += 1
                    out.append((p, lang, key, f))
            p, lang, key, f = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.record_batch([pa.array(p, pa.int32()), pa.array(lang, pa.string()), pa.array(key, pa.binary()), pa.array(f, pa.int64())], names=["part", "lang", "key", "f"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path = None, []  # the phrase and those that it begins with: [key, f, longer]
        for b in batches:
            out = []

            def leave(out: list = out) -> None:
                key, f, longer = path.pop()
                out.append((now, turn(key), [x[1] for x in path] + [f], longer))
                if path and key.count(_TAB) == path[-1][0].count(_TAB) + 1:
                    path[-1][2] = max(path[-1][2], f)

            for lang, key, f in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                while path and (lang != now or not key.startswith(path[-1][0])):
                    leave()
                now = lang
                path.append([key, f, 0])
            yield _walked(out)
        out = []
        while path:
            leave(out)
        yield _walked(out)

    dealt = found.select("lang", "phrase", "f").mapInArrow(deal, "part int, lang string, key binary, f long").repartitionById(n_parts, "part").sortWithinPartitions("lang", "key")
    return dealt.mapInArrow(walk, "lang string, phrase binary, parts array<long>, longer long").groupBy("lang", "phrase").agg(F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def _walked(out: list[tuple]) -> pa.RecordBatch:
    lang, phrase, parts, longer = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array(longer, pa.int64())], names=["lang", "phrase", "parts", "longer"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorb: int = ABSORB, **sizes: int) -> DataFrame:
    """Per language the ``top`` phrases that hold together most: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 5 words has a = f(phrase) >= least. Of its cuts in two the one with the
    lowest score floor(1000 a n / (l r)) counts, ties to the shortest first part. A phrase inside
    a longer one that has at least ``absorb`` hundredths of its count is left out. (A longer
    phrase by several words has one by a single word between that is no rarer, so phrases longer
    by one word decide.)

    A null text is empty; empty texts, and texts of separators alone, count nothing. A null lang
    is ``und``. Rows that repeat count each time, and a null doc_id matters as little as any:
    the identifier isn't read. Ties in score and count go by the phrase's bytes. An empty table,
    and a language without a phrase frequent enough, give no rows. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    found = cut(counts(docs, least, **sizes))
    ahead = stream(found).filter("length(phrase) > 0")
    behind = stream(found, suffix=True).select("lang", "phrase", F.col("parts").alias("ends"), F.col("longer").alias("before"))
    both = ahead.join(behind.hint("merge"), ["lang", "phrase"]).filter("size(parts) > 2")
    whole = lambda x: x.cast("decimal(19,0)")
    a, n, m = F.element_at("parts", -1), F.col("parts")[0], F.size("parts") - 1
    each = F.transform(
        F.sequence(F.lit(1), m - 1),
        lambda k: F.struct(F.call_function("div", whole(a) * F.lit(1000).cast("decimal(4,0)") * whole(n), whole(F.get("parts", k)) * whole(F.get("ends", m - k))).alias("score"), k.alias("k")),
    )
    kept = both.filter(F.lit(100) * F.greatest("longer", "before") < F.lit(absorb) * a).withColumn("cut", F.array_min(each))
    text = F.regexp_replace(F.rtrim(F.col("phrase").cast("string"), F.lit("\t")), "\t", " ")
    rows = kept.select("lang", text.alias("phrase"), a.alias("a"), F.get("parts", F.col("cut.k")).alias("l"), F.get("ends", m - F.col("cut.k")).alias("r"), n.alias("n"), F.col("cut.score").alias("score"))
    # Ranks beyond ``top`` leave each task before the shuffle by language.
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, str(max(top, int(spark.conf.get(name)))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, unnest([w[i:i + j] FOR j IN range(0, 5) IF i + j <= len(w)]) AS g FROM s),
c AS (SELECT lang, g, len(g) AS m, count(*) AS f FROM g GROUP BY lang, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, g, m, f AS a FROM c WHERE m > 1 AND f >= 100),
cuts AS (SELECT lang, g, a, m, unnest(range(1, m)) AS k FROM k),
scored AS (SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts JOIN c x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN c y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:] JOIN n ON n.lang = cuts.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
sizes AS (SELECT lang, g, a, m, unnest(range(2, m)) AS j FROM k),
inside AS (SELECT lang, unnest([g[i:i + j - 1] FOR i IN range(1, m - j + 2)]) AS g, a AS longer FROM sizes),
gone AS (SELECT lang, g, max(longer) AS longer FROM inside GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM low LEFT JOIN gone USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000"""
}
