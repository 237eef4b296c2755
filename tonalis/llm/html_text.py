"""HTML extraction: nearest-URL page differencing.

1. Each page is parsed into text lines, one per block, in page order, menus and footers and all,
   with what its structure says of each (``scan``): inside an article element, open, or ruled out.
2. Pages are put in order of host and URL path by a range shuffle of light rows (hashes of
   lines, no text), so that the nearest pages by path stand next to each other; the pages at
   the ends of each partition go to the driver and its neighbours (four light rows a partition).
3. Pages that follow one another on a host and share most of their own text are a run of
   copies. Own text is what isn't among the lines common to the two neighbours of the host
   that have least in common; a host all of whose neighbours share over 0.9 of the text is one
   run, as nothing tells its template from its text. Each page's lines are aligned with those of the page before and the page
   after its run, however far, by longest common subsequence. Lines in the common subsequence
   are the site's template and are deleted; those inside an article element are if they are common to both
   neighbours' articles and stand at its head or foot, with text of its own between.
4. What no neighbour shares goes by structure: elements that aren't text (menus, footers, asides,
   forms), and all that stands beside the article where article or main elements hold most of the text.
   Names that authors give to elements (``HINT``) count only where no structure says more: inside
   the article, and on pages without one. Adverts and menus that differ from page to page, as all do on
   the test pages, can go by this step alone.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._util import cut, prepare, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Elements whose content is not text at all, up to their own end tag.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea xmp plaintext".split())
#: Those of them that hold the rest of the page if they have no end tag; of the others only the start tag then goes.
GREEDY = frozenset("script style textarea xmp iframe plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text, and class or id words that say the same of any element.
ASIDE = frozenset("nav footer aside form head title dialog menu select button datalist".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notice|newsletter|subscri\w+|popup|modal|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widgets?|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|comments?\w*|disqus|respon[ds]\w*|reply|replies|pagination|pager|login|signup|search|skip|copyright|legal|tagcloud)(?=$|[\s_-])",
    re.I,
)
ROLE = re.compile(r"role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
CLASS = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MAIN = frozenset(("article", "main"))
#: Start tags that close an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _boiler(name: str, attrs: str, inside: bool) -> bool:
    if name in ASIDE or name == "header" and not inside:
        return True
    if not attrs or name in MAIN and not inside or name in ("html", "body"):
        return False
    if ROLE.search(attrs) or HIDDEN.search(attrs):
        return True
    said = [h for m in CLASS.findall(attrs) if (h := HINT.search(next(filter(None, m), "")))]
    return any(not inside or not re.search("head", h[0], re.I) for h in said)


def _ends(page: str, name: str) -> dict[int, int]:
    """Where elements of this name start, and where their own end tag ends; those without one are left out."""
    out: dict[int, int] = {}
    held: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                held.append(m.start())
        elif held:
            out[held.pop()] = m.end()
    return out


#: What markup says of a line: nothing, inside an article element, ruled out.
OPEN, INSIDE, OUT = 0, 1, 2


def parse(page: str) -> tuple[list[str], list[bool]]:
    """Lines of the page, without those that markup rules out, and which of them stand inside the article."""
    lines, marks = scan(page)
    return [x for x, m in zip(lines, marks, strict=True) if m != OUT], [m == INSIDE for m in marks if m != OUT]


def scan(page: str) -> tuple[list[str], list[int]]:
    """All lines of the page, and what markup says of each. What is ruled out inside a line is a line of its own, behind it.

    Where article and main elements hold at least half of the text that isn't ruled out, lines beside them, but
    for headings of the first rank, are ruled out. A main element makes no line INSIDE: sites put menus and footers in it.
    """
    lines: list[str] = []
    marks: list[int] = []
    beside: list[bool] = []  # outside article and main, and no first heading
    piece: list[str] = []
    aside: list[str] = []
    stack: list[tuple[str, bool]] = []  # open block or boilerplate elements: name, and whether it is ruled out
    ends: dict[str, dict[int, int]] = {}
    out = inside = main = at = 0

    def flush() -> None:
        for held, mark in ((piece, INSIDE if inside else OPEN), (aside, OUT)):
            if held:
                if s := " ".join(entities.unescape("".join(held)).split()):
                    lines.append(s)
                    marks.append(mark)
                    beside.append(not inside and not main and not any(n == "h1" for n, _ in stack))
                held.clear()

    def pop() -> None:
        nonlocal out, inside, main
        name, bad = stack.pop()
        out -= bad
        inside -= name == "article" and not bad
        main -= name == "main" and not bad

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            (aside if out else piece).append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                (aside if out else piece).append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if not m[3].endswith("/"):
                if name in GREEDY:
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    if name not in ends:
                        ends[name] = _ends(page, name)
                    at = ends[name].get(m.start(), at)
            continue
        if name == "br":
            (aside if out else piece).append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        if closing:
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        else:
            if stack and (name in CLOSES and stack[-1][0] in CLOSES[name] or block and stack[-1][0] == "p"):
                pop()
            bad = _boiler(name, m[3], inside + main > 0)
            if (block or bad or out and any(s[0] == name for s in stack)) and name not in VOID and not m[3].endswith("/"):
                if bad and not block and not out:
                    piece.append(" ")
                stack.append((name, bad))
                out += bad
                inside += name == "article" and not bad
                main += name == "main" and not bad
    if at < len(page):
        (aside if out else piece).append(page[at:])
    flush()
    size = [0, 0]
    for x, m, b in zip(lines, marks, beside, strict=True):
        size[b] += len(x) * (m != OUT)
    if size[0] and size[0] >= size[1]:
        marks = [OUT if b else m for m, b in zip(marks, beside, strict=True)]
    return lines, marks


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence of a and b (hashes)."""
    out = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out[:head] = True
    out[len(a) - tail :] = True
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = np.intersect1d(x, y)
    i, j = np.flatnonzero(np.isin(x, both)), np.flatnonzero(np.isin(y, both))
    x, y = x[i], y[j]
    if not len(x) or not len(y):
        return out
    n = np.unique(x, return_counts=True)[1].astype(float) @ np.unique(y, return_counts=True)[1]
    found = _by_bits(x.tolist(), y.tolist()) if n > FEW * (len(x) + len(y)) else _by_matches(x.tolist(), y.tolist())
    out[head + i[found]] = True
    return out


#: Pairs of equal lines, as a multiple of the lines, up to which an alignment lists them.
FEW = 8


def _by_matches(x: list[int], y: list[int]) -> list[int]:
    """Places in x of a longest common subsequence. After Hunt and Szymanski: the longest rising run of matching places, in (matches) log (lines)."""
    places: dict[int, list[int]] = {}
    for k, v in enumerate(y):
        places.setdefault(v, []).append(k)
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for r, v in enumerate(x):
        for k in reversed(places[v]):
            p = bisect_left(ends, k)
            link = (r, links[p - 1] if p else None)
            if p == len(ends):
                ends.append(k)
                links.append(link)
            elif k < ends[p]:
                ends[p], links[p] = k, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _by_bits(x: list[int], y: list[int]) -> list[int]:
    """The same for lines that repeat: after Hirschberg, y is halved at the best place in x, in linear space; the lengths that this takes are a sum over words of bits (after Crochemore and others), whatever repeats."""
    out, parts = [], [(0, len(x), 0, len(y))]
    while parts:
        a, z, b, w = parts.pop()
        while a < z and b < w and x[a] == y[b]:
            out.append(a)
            a, b = a + 1, b + 1
        while a < z and b < w and x[z - 1] == y[w - 1]:
            z, w = z - 1, w - 1
            out.append(z)
        if w - b == 1 or z - a == 1:
            if (k := next((i for i in range(a, z) if x[i] in y[b:w]), None) if z - a == 1 else next((i for i in range(a, z) if x[i] == y[b]), None)) is not None:
                out.append(k)
        elif a < z and b < w:
            mid = (b + w) // 2
            k = a + int((_lengths(x[a:z], y[b:mid]) + _lengths(x[a:z][::-1], y[mid:w][::-1])[::-1]).argmax())
            parts += [(a, k, b, mid), (k, z, mid, w)]
    return sorted(out)


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of y and the first 0, 1, ... lines of x."""
    n, wanted = len(x), set(y)
    places: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        if v in wanted:
            places.setdefault(v, []).append(i)
    often = {}
    for v, at in places.items():
        if len(at) > 16:
            bits = np.zeros(n, bool)
            bits[at] = True
            often[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = row = (1 << n) - 1
    for v in y:
        if v in places:
            hit = row & (often[v] if v in often else sum(1 << i for i in places[v]))
            row = (row + hit | row - hit) & full
    rises = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n] == 0
    return np.r_[0, np.cumsum(rises)]


def _address(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").removeprefix("www."), u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return "", url or ""


LIGHT = "page_id long, row long, host string, path string, lines array<long>, marks array<tinyint>, size array<int>"


def _light(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, url, page = (b.column(k).to_pylist() for k in range(3))
            got = [scan(p or "") for p in page]
            where = [_address(u) for u in url]
            key = [_row_key(u, p) for u, p in zip(url, page, strict=True)]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(key, pa.int64()), pa.array([w[0] for w in where]), pa.array([w[1] for w in where]), pa.array([[xxhash.xxh64_intdigest(s) - (1 << 63) for s in g[0]] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int8())), pa.array([[len(s) for s in g[0]] for g in got], pa.list_(pa.int32()))],
                names=["page_id", "row", "host", "path", "lines", "marks", "size"],
            )

    return pages.mapInArrow(run, LIGHT)


def _row_key(url: str | None, page: str | None) -> int:
    """Tells apart rows that repeat a page_id."""
    return xxhash.xxh64_intdigest(f"{url}\0{page}".encode("utf-8", "surrogatepass")) - (1 << 63)


Page = tuple[np.ndarray, np.ndarray, np.ndarray]  # hashes of lines, their marks, their sizes


def _body(p: Page) -> np.ndarray:
    for own in (p[1] == INSIDE, p[1] == OPEN):
        if own.any():
            return own
    return np.ones(len(p[0]), bool)


def _share(x: Page, y: Page, hit: np.ndarray, template: np.ndarray) -> float:
    """Part of the smaller one's own text (lines that are no template) in the lines of x that y has too."""
    own = _body(x) & ~np.isin(x[0], template)
    least = min(x[2][own].sum(), y[2][_body(y) & ~np.isin(y[0], template)].sum())
    return float(x[2][hit & own].sum() / least) if least else 0.0


def _copies(x: Page, y: Page, template: np.ndarray, copy: float) -> bool:
    return np.array_equal(x[0], y[0]) or _share(x, y, common(x[0], y[0]), template) > copy


Least = tuple[float, np.ndarray]  # of a host: the least share of two neighbours, and their common lines


def _least(known: Least, x: Page, y: Page, hit: np.ndarray, nearly: float = 0.9) -> Least:
    """Pairs with nothing in common or nearly all say nothing, nor do pages without open lines."""
    s = _share(x, y, hit, x[0][:0])
    return (s, np.unique(x[0][hit])) if 0 < s <= nearly and s < known[0] and (x[1] == OPEN).any() and (y[1] == OPEN).any() else known


NONE: Least = (1.0, np.empty(0, np.int64))


class _Part:
    """A partition of light rows, in order, in runs of copies that follow one another on a host.

    ``least`` has what its neighbours say of each host; ``given`` the same for hosts that other partitions have too.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], copy: float, given: dict[int, dict[str, Least]] | None = None) -> None:
        held = [b for b in batches if b.num_rows]
        self.n = sum(b.num_rows for b in held)
        if not self.n:
            return
        column = {k: pa.concat_arrays([b.column(k) for b in held]) for k in held[0].schema.names}
        self.ids, self.rows, self.host, self.part = (column[k].to_pylist() for k in ("page_id", "row", "host", "part"))
        at = column["lines"].offsets.to_numpy()
        flat = [column[k].flatten().to_numpy(zero_copy_only=False) for k in ("lines", "marks", "size")]
        self.page = lambda i: tuple(v[at[i] : at[i + 1]] for v in flat)
        self.least: dict[str, Least] = {}
        hits: list[np.ndarray | None] = [None] * self.n
        for i in range(1, self.n):
            h, x, y = self.host[i], self.page(i - 1), self.page(i)
            if h == self.host[i - 1] and not np.array_equal(x[0], y[0]):
                hits[i] = np.packbits(hit := common(x[0], y[0]))
                self.least[h] = _least(self.least.get(h, NONE), x, y, hit)
        self.least.update((given or {}).get(self.part[0], {}))
        self.start = [0]  # of each run
        for i in range(1, self.n):
            x, y = self.page(i - 1), self.page(i)
            if self.host[i] != self.host[i - 1] or hits[i] is not None and _share(x, y, np.unpackbits(hits[i], count=len(x[0])).astype(bool), self.known(i)) <= copy:
                self.start.append(i)

    def known(self, i: int) -> np.ndarray:
        return self.least.get(self.host[i], NONE)[1]

    def ends(self) -> dict:
        """What the partitions before and after need to know."""
        s, z = [*self.start, self.n], self.n - 1
        return {
            "hosts": (self.host[0], self.host[z]), "pages": (self.page(0), self.page(z)), "known": (self.known(0), self.known(z)), "least": {self.host[i]: self.least.get(self.host[i], NONE) for i in (0, z)}, "whole": len(self.start) == 1,
            "next": (self.page(s[-2] - 1) if s[-2] and self.host[s[-2] - 1] == self.host[z] else None, self.page(s[1]) if s[1] < self.n and self.host[s[1]] == self.host[0] else None),
        }


def _beyond(parts: list[dict], p: int, side: int, copy: float) -> Page | None:
    """The nearest page before (side -1) or after (1) partition p on its host that is no copy of the run at p's end, however far it lies."""
    me, it = int(side > 0), p
    while 0 <= it + side < len(parts):
        mine, other = parts[it], parts[it + side]
        if other["hosts"][1 - me] != mine["hosts"][me]:
            return None
        page = other["pages"][1 - me]
        if not _copies(mine["pages"][me], page, np.union1d(mine["known"][me], other["known"][1 - me]), copy):
            return page
        if other["next"][me] is not None or not other["whole"]:
            return other["next"][me]
        it += side
    return None


def _shared(me: Page, left: Page | None, right: Page | None, articles: bool) -> np.ndarray:
    """Lines to delete: those common with the page on either side. Of an article's, those common with the articles of both that lead to its head or foot, if lines of its own are left."""
    hits = [common(me[0], o[0]) if o is not None else np.zeros(len(me[0]), bool) for o in (left, right)]
    drop = (hits[0] | hits[1]) & (me[1] != INSIDE)
    own = np.flatnonzero(me[1] == INSIDE)
    if articles and left is not None and right is not None and len(own):
        both = (hits[0] & hits[1])[own] & np.isin(me[0][own], np.intersect1d(left[0][left[1] == INSIDE], right[0][right[1] == INSIDE]))
        if not both.all():
            drop[own[: both.argmin()]] = True
            drop[own[len(own) - both[::-1].argmin() :]] = True
    return drop


def templates(pages: DataFrame, copy: float = 0.5, articles: bool = True) -> DataFrame:
    """page_id, row, drop array<int>, n_shared: places of template lines among those that markup doesn't rule out, and how many they are, for pages that have some."""
    light = cut(_light(pages).filter("size(lines) > 0"))  # parsed once, not once more for the bounds of the ranges
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = light.repartitionByRange(n, "host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row").withColumn("part", F.spark_partition_id())
    near = cut(near)

    def ends(given: dict[int, dict[str, Least]]) -> list[tuple[int, dict]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _Part(batches, copy, given)
            if t.n:
                yield pa.record_batch([pa.array([t.part[0]], pa.int32()), pa.array([pickle.dumps(t.ends())], pa.binary())], names=["part", "ends"])

        return sorted(((r["part"], pickle.loads(bytes(r["ends"]))) for r in near.mapInArrow(run, "part int, ends binary").collect()), key=lambda x: x[0])  # four light pages per partition

    border = ends({})
    least: dict[str, Least] = {}
    for k, (_, e) in enumerate(border):
        for h, v in e["least"].items():
            least[h] = min(least.get(h, NONE), v, key=lambda v: v[0])
        if k and border[k - 1][1]["hosts"][1] == (h := e["hosts"][0]):
            x, y = border[k - 1][1]["pages"][1], e["pages"][0]
            least[h] = _least(least[h], x, y, common(x[0], y[0]))
    given = {p: {h: least[h] for h in e["least"]} for p, e in border}
    border = ends(given)
    parts = [x for _, x in border]
    beyond = {p: (_beyond(parts, k, -1, copy), _beyond(parts, k, 1, copy), given[p]) for k, (p, _) in enumerate(border)}
    sent = pages.sparkSession.sparkContext.broadcast(beyond)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Part(batches, copy, {p: x[2] for p, x in sent.value.items()})
        out = []
        stops = [*t.start[1:], t.n] if t.n else []
        for a, z in zip(t.start if t.n else [], stops, strict=True):
            left = sent.value[t.part[0]][0] if not a else t.page(a - 1) if t.host[a - 1] == t.host[a] else None
            right = sent.value[t.part[0]][1] if z == t.n else t.page(z) if t.host[z] == t.host[a] else None
            last = drop = None
            for i in range(a, z):
                me = t.page(i)
                if last is None or not (np.array_equal(me[0], last[0]) and np.array_equal(me[1], last[1])):
                    drop = _shared(me, left, right, articles)[me[1] != OUT]
                    shared, drop = int(drop.sum()), np.flatnonzero(drop).tolist()
                last = me
                if shared:
                    out.append((t.ids[i], t.rows[i], drop, shared))
        for k in range(0, len(out), 1000):
            ids, keys, places, n = zip(*out[k : k + 1000], strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["page_id", "row", "drop", "n_shared"])

    return near.mapInArrow(run, "page_id long, row long, drop array<int>, n_shared long")


def extract(pages: DataFrame, copy: float = 0.5, articles: bool = True) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_shared (lines that page differencing deleted and markup alone would keep).

    With ``articles`` false, article elements are left whole, whatever their heads and feet share.
    Character references are decoded, white space inside a block is one space, blocks are joined
    by a line feed; nothing is capped: a page of any length is aligned whole. A null or empty
    page, or one without article text, gives an empty text. A null url belongs to the host "".
    Pages of one path are in order of page_id and content, so that the nearest page is always
    the same; a null page_id comes first. Repeated rows are rows of their own and may be each
    other's neighbours (they count as copies, and get the same text). A page alone on its host
    has no template. An empty table gives no rows. Other columns are ignored.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    drop = templates(own, copy, articles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            url, page = b.column(1).to_pylist(), b.column(2).to_pylist()
            text = ["\n".join(parse(p or "")[0]) for p in page]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text), pa.array([_row_key(u, p) for u, p in zip(url, page, strict=True)], pa.int64())], names=["page_id", "url", "text", "row"])

    text = own.mapInArrow(run, "page_id long, url string, text string, row long").withColumn("_id", F.coalesce("page_id", F.lit(0)))
    drop = drop.groupBy(F.coalesce("page_id", F.lit(0)).alias("_id"), "row").agg(F.first("drop").alias("drop"), F.first("n_shared").alias("n_shared"))
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("drop", i))
    joined = text.join(drop, ["_id", "row"], "left")
    body = F.when(F.coalesce(F.size("drop"), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select("page_id", "url", body.alias("text"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op1_nearest_url_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; articles stay whole, as texts in the table end in lines that other texts have too."""
    return extract(table(spark, sf_dir, "pages"), articles=False)
