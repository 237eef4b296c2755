"""Secret scans: multipart credential linking.

Three base patterns always count. Weaker parts (client identifiers, bare secrets, endpoints)
are too common to report alone: they are interval-joined with the other parts of the same
document, and a weak part counts only where complementary parts lie in its scope, i.e. start
within ``scope`` code points of it in the same paragraph (no empty line between) and are
reported themselves. A document is
one row, so the join runs inside the row, over sorted starts; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._util import prepare, table

#: Code points between the starts of parts of one credential.
SCOPE = 400
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: an identifier given by name, a bare 32 to 64 character secret, an address.
IDENT = re.compile(r"""(?ai)\b(?:access_key_id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""")
SECRET = re.compile(r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{32,64}={0,2}(?![A-Za-z0-9/+=_-])")
ENDPOINT = re.compile(r"""(?ai)\b(?:https?|wss?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+""")
#: What must lie in a weak part's scope: for each kind, kinds of which one is enough.
NEEDS = {3: (0, 2, 4), 4: (1, 3), 5: (0, 2, 4)}


def find(text: str, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans: base ones, and linked weak ones; by start, then kind."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    weak = [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in SECRET.finditer(text) if _mixed(m[0])]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if base or weak else []
    weak = _apart(weak, base)
    if not weak or len(base) + len(weak) < 2:
        return base
    return sorted([*base, *_linked(text, base, weak, scope)])


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def _apart(weak: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no base span: the furthest end of the base spans that start before a part's end must not exceed its start."""
    if not weak or not base:
        return weak
    start = np.array([b[0] for b in base], np.int64)
    end = np.maximum.accumulate(np.array([b[2] for b in base], np.int64))
    before = np.searchsorted(start, [w[2] for w in weak])
    return [w for w, k in zip(weak, before.tolist(), strict=True) if not k or end[k - 1] <= w[0]]


def _linked(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Weak parts with a complementary part in scope that is reported itself.

    Weak parts without one are dropped until nothing changes: an identifier and a secret can
    carry each other, but a part can't rest on one that goes itself.
    """
    parts = sorted([*base, *weak])
    gaps = np.array([-1, *[m.start() for m in re.finditer(r"\n\s*\n", text)], len(text)], np.int64)
    start = np.array([p[0] for p in parts], np.int64)
    kind = np.array([p[1] for p in parts])
    para = np.searchsorted(gaps, start)  # the paragraph lies behind one gap, up to the next
    lo = np.searchsorted(start, np.maximum(start - scope, gaps[para - 1] + 1))
    hi = np.searchsorted(start, np.minimum(start + scope, gaps[para]), "right")
    left = np.ones(len(parts), bool)
    while True:
        keep = left.copy()
        for k, needs in NEEDS.items():
            upto = np.r_[0, np.cumsum(left & np.isin(kind, needs))]
            keep &= (kind != k) | (upto[hi] > upto[lo])
        if (keep == left).all():
            return [p for p, ok in zip(parts, keep.tolist(), strict=True) if ok and p[1] > 2]
        left = keep


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Offsets are code points, ends exclusive. Null text counts as empty: zero counts, the digest
    of the empty string, no spans. Whole texts are scanned, however long. A null doc_id stays
    null. Repeated rows each give their row; an empty table gives none. Other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(t or "", scope) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _row(text: str, scope: int) -> tuple[int, int, int, str, str, int]:
    spans = find(text, scope)
    said = [f"{KINDS[k]}:{a}:{z}" for a, k, z in spans]
    n = [sum(k == i for _, k, _ in spans) for i in range(3)]
    base = ",".join(s for s, (_, k, _) in zip(said, spans, strict=True) if k < 3)
    return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(spans) - sum(n)


def op6_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
