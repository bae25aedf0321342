"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the leftmost M-word group with the least hash. A run of
windows with the same minimiser position, a super-k-mer, travels as one packed string of its words to the
bucket of that minimiser. Equal windows have the same minimiser, so they meet there; rows sorted by document and
start then show which windows occurred earlier. Within a task, equal packed strings travel once, as their earliest.

A first pass sends only minimisers and row ids, and finds those that occur more than once; the strings of the others,
most of a corpus, never travel. The texts are shuffled once, and both later passes read that exchange.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

M = 5
#: Bytes of text that a task cuts at a time.
SLICE_BYTES = 8_000_000
PLACE_BITS = 26
#: Bytes that are measured at once.
PIECE = 2_000_000
BLANK = re.compile(rb"[ \t-\r]")
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])
#: Powers of an odd number, by a byte's place in its word.
POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
#: Different windows of one minimiser that a task remembers.
MOST_WINDOWS = 200_000
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
NAMES = ["key", "doc", "rid", "start", "n", "packed"]
ROW = "key long, doc long, rid long, start int, n int, packed binary"


def words_of(text: str | None) -> list[bytes]:
    """Words between space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def minimiser_places(h: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of word hashes h: the place of its minimiser; and each place's hash."""
    g = np.zeros(len(h) - m + 1, np.uint64)
    for i in range(m):
        g = (g ^ h[i : len(h) - m + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    low = np.uint64(2**PLACE_BITS - 1)
    packed = g & ~low | np.arange(len(g), dtype=np.uint64) & low
    span, least = 1, packed
    while span * 2 <= window - m + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := window - m + 1 - span:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & low).astype(np.int64), g


def pieces(texts: list[str | None], window: int) -> Iterator[tuple[int, int, bytes]]:
    """Row, first word's number and bytes of each text; one of over PIECE bytes comes in pieces that share window - 1 words."""
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        base = at = 0
        while len(raw) - at > PIECE and (gap := BLANK.search(raw, at + PIECE)):
            part = raw[at : gap.start()]
            n = len(part.split())
            if n < window:
                break
            yield i, base, part
            at += len(part.rsplit(None, window - 1)[0])
            base += n - window + 1
        yield i, base, raw[at:]


def super_kmers(texts: list[str | None], window: int, m: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of about PIECE bytes: the bytes, and each super-k-mer's row, first window, windows, key, begin and end in the bytes."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for piece in itertools.chain(pieces(texts, window), [None]):
        if group and (piece is None or size + len(piece[2]) > PIECE):
            if found := measured(group, window, m):
                yield found
            group, size = [], 0
        if piece is not None:
            group.append(piece)
            size += len(piece[2])


def measured(group: list[tuple[int, int, bytes]], window: int, m: int) -> tuple | None:
    """The super-k-mers of some pieces, all at once; None without any."""
    joined = b"\n".join([p[2] for p in group]) + b"\n"
    chars = np.frombuffer(joined, np.uint8)
    inside = ~BLANKS[chars]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.r_[0, edge] if inside[0] else edge
    begin, end = edge[0::2], edge[1::2]
    if len(begin) < window:
        return None
    body, first = chars[begin[0] :], begin - begin[0]
    place_in_word = np.arange(len(body), dtype=np.int32) - np.repeat(first, np.diff(np.r_[first, len(body)])).astype(np.int32)
    worth = (body.astype(np.uint64) + np.uint64(1)) * POWERS[place_in_word & (len(POWERS) - 1)]
    worth[~inside[begin[0] :]] = 0
    h = np.add.reduceat(worth, first)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum([0, *[len(p[2]) + 1 for p in group]])
    owner = np.searchsorted(starts, begin, side="right") - 1
    first_word = np.searchsorted(begin, starts[:-1])
    place, g = minimiser_places(h, window, m)
    whole = owner[: len(place)] == owner[window - 1 :]
    fresh = whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]]
    cuts = np.flatnonzero(fresh | ~whole)
    upto = np.r_[cuts[1:], len(place)]
    s, e = cuts[fresh[cuts]], upto[fresh[cuts]]
    if not len(s):
        return None
    own = owner[s]
    row, base = np.array([p[0] for p in group])[own], np.array([p[1] for p in group])[own]
    return joined, row, base + s - first_word[own], e - s, g[place[s]].view(np.int64), begin[s], end[e + window - 2]


def keys_of(ids: list[int], texts: list[str | None], window: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Minimiser, row id and number of super-k-mers, for each minimiser of each row of a block."""
    rid = np.array(ids, np.int64)
    for _, row, _, _, key, _, _ in super_kmers(texts, window, m):
        o = np.lexsort((key, row))
        row, key = row[o], key[o]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
        yield key[new], rid[row[new]], np.diff(np.r_[new, len(row)]).astype(np.int32)


def cut_slice(docs: list[int | None], ids: list[int], texts: list[str | None], wanted: list[list[int]], window: int, m: int) -> Iterator[tuple]:
    """Super-k-mers (key, doc, rid, start, n, packed) with wanted minimisers, equal ones once as their earliest; a
    repeat is a row without packed string that says which windows of its document occurred earlier."""
    seen: dict[bytes | tuple, tuple] = {}
    docs = [-(2**63) if d is None else d for d in docs]
    mark = lambda row, key: key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    # a mark that two pairs share only lets a super-k-mer through that meets no other
    marks = mark(np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]), np.array([k for x in wanted for k in x], np.int64))
    for joined, *columns in super_kmers(texts, window, m):
        chosen = np.isin(mark(columns[0], columns[3]), marks)
        for i, start, n, key, a, b in zip(*[x[chosen].tolist() for x in columns]):
            packed = b" ".join(joined[a:b].split())
            row = (key, docs[i], ids[i], start, n, packed)
            old = seen.setdefault(packed, row)
            if old is not row:
                early, late = (old, row) if (old[1], old[3]) <= (row[1], start) else (row, old)
                seen[packed] = early
                if (early[1], early[3]) != (late[1], late[3]):
                    yield (late[2], *late[1:5], None)  # spread by row: a hot minimiser's repeats don't meet
                elif late[2] != early[2]:  # another text with the same key: an earlier occurrence elsewhere has to reach both
                    seen[packed, late[2]] = late
    yield from seen.values()


class Bucket:
    """The windows of one minimiser, added in order of document and start.

    Up to MOST_WINDOWS different windows are remembered; a window beyond that is passed on, and all its
    occurrences with it, to a second exchange by the window itself.
    """

    def __init__(self, key: int, window: int):
        self.key, self.window = key, window
        self.first: dict[bytes, tuple] = {}
        self.whole: dict[bytes, tuple] = {}  # the first row of each packed string

    def add(self, doc: int, rid: int, start: int, n: int, packed: bytes) -> Iterator[tuple]:
        """Rows (key, doc, rid, start, n, packed): repeats with packed None and the row as key, and windows passed on."""
        if old := self.whole.get(packed):
            if old[:2] != (doc, start):
                yield rid, doc, rid, start, n, None
            if old[:2] != (doc, start) or old[2] == rid:
                return  # another text with the same key and start goes on: what was late in the first one is late in it too
        elif len(self.first) < MOST_WINDOWS:
            self.whole[packed] = (doc, start, rid)
        offs = [0, *(i + 1 for i, c in enumerate(packed) if c == 32), len(packed) + 1]
        begun = None
        for j in range(n):
            w = packed[offs[j] : offs[j + self.window] - 1]
            known = self.first.get(w) if len(self.first) >= MOST_WINDOWS else self.first.setdefault(w, (doc, start + j))
            if known is None:
                yield xxhash.xxh64_intdigest(w) - 2**63, doc, rid, start + j, 1, w
            late = known is not None and known != (doc, start + j)
            if late and begun is None:
                begun = j
            if not late and begun is not None:
                yield rid, doc, rid, start + begun, j - begun, None
                begun = None
        if begun is not None:
            yield rid, doc, rid, start + begun, n - begun, None


def slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    begin, size = 0, 0
    for i, x in enumerate(b.column(text)):
        n = len(t) if (t := x.as_py()) else 0
        if size and size + n > SLICE_BYTES:
            yield b.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < b.num_rows:
        yield b.slice(begin)


def repeats(rows: DataFrame, window: int = 20, m: int = M) -> DataFrame:
    """rid, start, n: the n windows from word start of a row whose words also start earlier. rows has doc, rid and text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                for got in keys_of(*[c.to_pylist() for c in part.columns], window, m):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["key", "rid", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the minimisers that occur more than once; only the last row of a batch may have to wait."""
        wait = None
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            if b is None:
                if wait is not None and wait[2] > 1:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in wait[1::-1]], ["rid", "key"])
                return
            key, rid, n = (c.to_numpy() for c in b.columns)
            if wait is not None:
                key, rid, n = np.r_[wait[0], key], np.r_[wait[1], rid], np.r_[wait[2], n]
            run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            many = np.bincount(run, n)[run] > 1
            last = len(key) - 1
            # the last row stays back; if it is known to repeat, its count says so to the next batch
            wait = (key[last], rid[last], 2 if many[last] else 1)
            out = np.flatnonzero(many[:last])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(key[out])], ["rid", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                found = cut_slice(*[c.to_pylist() for c in part.columns], window, m)
                while some := list(itertools.islice(found, 20_000)):
                    yield told(some)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting = None, None
        for b in batches:
            passed = b.filter(b.column(5).is_null())
            if passed.num_rows:
                yield passed
            b = b.filter(b.column(5).is_valid())
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            # rows alone with their minimiser can't repeat; the first and last ones may belong to other batches
            wanted = np.flatnonzero((np.bincount(run)[run] > 1) | (run == run[-1]) | (run == 0))
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.take(pa.array(wanted)).columns]):
                if waiting is not None and waiting[0] == row[0]:
                    bucket = Bucket(row[0], window)
                    out += bucket.add(*waiting[1:])
                    waiting = None
                if bucket is not None and bucket.key == row[0]:
                    out += bucket.add(*row[1:])
                else:
                    bucket, waiting = None, row
                if len(out) > 20_000:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for b in batches:
            passed = b.filter(b.column(5).is_null())
            if passed.num_rows:
                yield passed
            out = []
            for key, doc, rid, start, n, w in zip(*[c.to_pylist() for c in b.filter(b.column(5).is_valid()).columns]):
                if w != last:
                    last, first = w, (doc, start)
                elif first != (doc, start):
                    out.append((rid, doc, rid, start, n, None))
            if out:
                yield told(out)

    counted = rows.select("rid", "text").mapInArrow(keys, "key long, rid long, n int").repartition("key").sortWithinPartitions("key")
    wanted = counted.mapInArrow(shared, "rid long, key long").groupBy("rid").agg(F.collect_set("key").alias("wanted"))
    cuts = rows.join(wanted, "rid").select("doc", "rid", "text", "wanted").mapInArrow(cut, ROW).repartition("key").sortWithinPartitions("key", "doc", "start")
    rest = cuts.mapInArrow(count, ROW).repartition("key").sortWithinPartitions("key", "packed", "doc", "start")
    return rest.mapInArrow(compare, ROW).select("rid", "start", "n")


def without_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 20) -> DataFrame:
    """key, n_words, n_removed, and kept_text: the words that no repeated window covers, joined by one space.

    Repeats are judged on the input: a window is removed if its words also start in a row with a smaller key, or earlier
    in its own. Whole numbers are in their own order, other keys in that of their hashes. Texts of any length are read
    whole, in pieces. Rows that share a key count as one document for that order, so equal
    starts in them remove nothing. A null key comes first. Null, empty and short texts have no window and keep
    their words. An empty table gives an empty result; other columns are not read.
    """
    t = F.col(f"`{text}`").cast("string")
    kind = df.schema[key].dataType
    whole = isinstance(kind, T.IntegralType)
    name, own = ("doc", []) if whole else ("own", [F.col(f"`{key}`").alias("own")])
    doc = F.col(f"`{key}`").cast("long") if whole else F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`").cast("string")))
    rows = df.select(doc.alias("doc"), F.xxhash64(F.col(f"`{key}`").cast("string"), t).alias("rid"), t.alias("text"), *own)
    spans = repeats(rows, window).groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    joined = rows.join(spans, "rid", "left").select(name, "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("ns"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                total, gone, kept = [], [], []
                for words, starts, ns in ((words_of(t), s, n) for t, s, n in zip(*[c.to_pylist() for c in part.columns[1:]])):
                    hit = np.zeros(len(words) + 1, np.int32)
                    for s, n in zip(starts or (), ns or ()):
                        hit[s] += 1
                        hit[s + n + window - 1] -= 1
                    hit = np.cumsum(hit)[:-1] > 0
                    total.append(len(words))
                    gone.append(int(hit.sum()))
                    kept.append(b" ".join(itertools.compress(words, (~hit).tolist())).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [key, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cover, f"`{key}` {'long' if whole else kind.simpleString()}, n_words long, n_removed long, kept_text string")
