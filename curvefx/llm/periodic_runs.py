"""Periodic runs of words: recompression builds a run-length grammar, whose LCE queries extend harmonic-grid candidates.

A stretch of period q that is at least 4 q long holds three whole blocks of the grid 0, q, 2 q, ...; so every run starts
from a grid place whose next two blocks repeat it. Places are filtered by single words and then extended exactly, both
ways, by longest-common-extension queries on a grammar: blocks of one symbol and pairs of symbols are renamed in turn, the
same way wherever they stand, until each text is one symbol. No suffix array is built. All of it is NumPy over a slice of
many texts at once, inside Arrow tasks; rows need no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, unused

ship(__name__)

#: Bytes of text that are searched together; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Grid places that are made at once.
PLACES = 2_000_000
#: Passes over the first places of streaks, before all that are left are extended at once.
PASSES = 4
#: Where in its two periods a place is probed after the first word, in eighths of a period.
PROBES = (8, 4, 12, 2, 10, 6, 14, 7, 15, 1, 9)
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Grammar:
    """Levels of symbols, one after the other in flat arrays; level 0 is the given sequence.

    symbols: non-negative numbers of words and, at both ends and between texts, distinct negative ones, which are never
    part of a rule. Equal symbols of a level stand for equal words, and different ones for different words.
    """

    def __init__(self, symbols: np.ndarray):
        level, at, n = symbols.astype(np.int64), np.arange(len(symbols), dtype=np.int64), len(symbols)
        name, base, k = int(symbols.max(initial=0)) + 1, 0, 0
        sym, up, first, left, right, place = [], [], [np.full(n, -1)], [], [], [at]
        while True:
            same = (level[1:] == level[:-1]) if k % 2 == 0 else self._paired(level, k)
            if k % 2 and not ((level[1:] >= 0) & (level[:-1] >= 0)).any():
                break  # each text is one symbol
            start = np.ones(len(level), bool)
            start[1:] = ~same
            heads = np.flatnonzero(start)
            size = np.diff(np.append(heads, len(level)))
            above = np.cumsum(start) - 1
            new = level[heads]
            joined = size > 1
            key = new[joined] << 32 | (size[joined] if k % 2 == 0 else level[heads[joined] + 1])
            kinds, number = np.unique(key, return_inverse=True)
            new[joined] = name + number
            name += len(kinds)
            inside = np.arange(len(level)) - heads[above]
            sym.append(level)
            up.append(base + len(level) + above)
            left.append(inside + 1)
            right.append(size[above] - inside)
            first.append(base + heads)
            at = at[heads]
            place.append(at)
            base += len(level)
            level, k = new, k + 1
        sym.append(level)
        up.append(np.full(len(level), -1))
        left.append(np.ones(len(level), np.int64))
        right.append(np.ones(len(level), np.int64))
        self.sym, self.up, self.first, self.left, self.right, self.place = (np.concatenate(x).astype(np.int64) for x in (sym, up, first, left, right, place))
        self.block = np.concatenate([np.full(len(x), i % 2 == 0) for i, x in enumerate(sym)])

    @staticmethod
    def _paired(level: np.ndarray, k: int) -> np.ndarray:
        """Whether a symbol and the next become one: by a seeded bit of each, so alike everywhere."""
        mixed = (level.astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        bit = ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)
        return (bit[:-1] == 0) & (bit[1:] == 1) & (level[:-1] >= 0) & (level[1:] >= 0)

    def _last(self, i: np.ndarray) -> np.ndarray:
        """The last child of each node."""
        head = self.first[i]
        return head + self.right[head] - 1

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from a and from b on (back: from them to the left) are equal; places of level 0.

        A query climbs while both places begin (back: end) a node and the nodes are equal, steps over equal nodes, of a
        block as many as both have left, and descends where nodes differ: a bounded number of steps on each level.
        """
        side, other, step = (self.left, self.right, -1) if back else (self.right, self.left, 1)
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        x, y, whence = a.astype(np.int64), b.astype(np.int64), a.astype(np.int64)
        while len(live):
            equal = self.sym[x] == self.sym[y]
            ux, uy = self.up[x], self.up[y]
            climb = equal & (ux >= 0) & (other[x] == 1) & (other[y] == 1)
            climb[climb] = self.sym[ux[climb]] == self.sym[uy[climb]]
            walk = equal & ~climb
            down = ~equal & (self.first[x] >= 0)
            end = ~equal & ~down
            if end.any():
                out[live[end]] = np.abs(self.place[x[end]] - whence[end])
            go = np.where(self.block[x], np.minimum(side[x], side[y]), 1) * step
            nx, ny = np.where(climb, ux, np.where(walk, x + go, x)), np.where(climb, uy, np.where(walk, y + go, y))
            if down.any():
                pick = self._last if back else self.first.__getitem__
                nx[down], ny[down] = pick(x[down]), pick(y[down])
            keep = ~end
            live, x, y, whence = live[keep], nx[keep], ny[keep], whence[keep]
        return out


def grid(starts: np.ndarray, sizes: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places k q (in the whole sequence), their q and streak group, of q from low to 2 low - 1 with 4 q words in the text, in bounded lots."""
    most = np.minimum(sizes // 4, 2 * low - 1)
    have = np.flatnonzero(most >= low)
    n_q = most[have] - low + 1
    doc = np.repeat(have, n_q)
    q = low + np.arange(len(doc)) - np.repeat(np.cumsum(n_q) - n_q, n_q)
    count = sizes[doc] // q - 2
    lot = (np.cumsum(count) - count) // PLACES
    for cut in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(lot)) + 1):
        if len(cut):
            c, qs = count[cut], q[cut]
            step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            each = np.repeat(qs, c)
            yield np.repeat(starts[doc[cut]], c) + step * each, each, np.repeat(cut, c)


def stretches(seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Start, end and smallest period of every run of the sequence's texts, sorted; times is at least 4, and 3 blocks find it."""
    grammar: Grammar | None = None
    far, period = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)  # end and period of the run around a place that reaches furthest
    found = [np.zeros((0, 3), np.int64)]
    low = 1
    while (sizes // 4 >= low).any():
        new = [np.zeros((0, 3), np.int64)]
        for at, q, group in grid(starts, sizes, low):
            ok = seq[at] == seq[at + q]
            at, q, group = at[ok], q[ok], group[ok]
            for eighths in PROBES:
                shift = at + q * eighths // 8
                ok = seq[shift] == seq[shift + q]
                at, q, group = at[ok], q[ok], group[ok]
            ok = ~((far[at] >= at + 3 * q) & (q % period[at] == 0))  # a known run of a divisor of q is all that is here
            at, q, group = at[ok], q[ok], group[ok]
            for turn in range(PASSES + 1):
                if not len(at):
                    break
                grammar = grammar or Grammar(seq)
                head = np.ones(len(at), bool)
                if turn < PASSES:  # the next place of a streak mostly lies in the same stretch
                    head[1:] = (group[1:] != group[:-1]) | (at[1:] != at[:-1] + q[1:])
                a, b = at[head], q[head]
                begin = a - grammar.extension(a - 1, a + b - 1, back=True)
                end = a + b + grammar.extension(a, a + b)
                long = end - begin >= np.maximum(least, times * b)
                new.append(np.stack([begin[long], end[long], b[long]], 1))
                covers = np.where(long, end, 0)[np.cumsum(head) - 1]  # those of a streak that its first stretch holds
                left = ~head & (at + 2 * q > covers)
                at, q, group = at[left], q[left], group[left]
        for s, e, p in (rows := np.unique(np.concatenate(new), axis=0)):
            wide = far[s:e] < e
            far[s:e][wide], period[s:e][wide] = e, p
        found.append(rows)
        low *= 2
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # a stretch of several periods has all of the smallest one, which comes first
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the number of each word in turn, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(doc, minlength=len(sizes)).astype(np.int64)


def searched(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    """n_words, runs, top and collapsed of some texts."""
    names, word, sizes = words_of(texts)
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    starts = np.cumsum(sizes) - sizes + np.arange(n) + 1  # a bar stands before each text and at the end
    seq = np.empty(len(word) + n + 1, np.int64)
    seq[np.append(starts - 1, len(seq) - 1)] = -1 - np.arange(n + 1)
    seq[np.arange(len(word)) + doc + 1] = word
    rows = stretches(seq, starts, sizes, least, times)
    of = np.searchsorted(starts, rows[:, 0], "right") - 1
    begin, length, period = rows[:, 0] - starts[of], rows[:, 1] - rows[:, 0], rows[:, 2]
    edge = np.zeros(len(seq) + 1, np.int64)  # dropped words: from a run's second period to its end
    np.add.at(edge, rows[:, 0] + period, 1)
    np.add.at(edge, rows[:, 1], -1)
    kept = np.cumsum(edge)[np.arange(len(word)) + doc + 1] == 0
    left = np.bincount(doc[kept], minlength=n)
    offsets = pa.array(np.append(0, np.cumsum(left)), pa.int32())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(word[kept]))), " ")
    per = np.append(0, np.cumsum(np.bincount(of, minlength=n)))
    runs = [pa.array(x, pa.int64()) for x in (begin, length, period)]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    top = []
    for k in range(n):
        best = None
        for s, e, p in zip(*(x[per[k] : per[k + 1]].tolist() for x in (begin, length, period))):
            if best is None or e * best[2] > best[1] * p:  # in order of start, then period: the first of equal ones stays
                best = (s, e, p)
        top.append(best and dict(zip(("start", "length", "period"), best)))
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(runs, fields=list(kind))), pa.array(top, kind), collapsed.cast(pa.string())]


def periodic_runs(df: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """df with n_words, runs (start, length, period), top (the run of the greatest length over period) and collapsed.

    Words are what stands between spaces and \\t \\n \\v \\f \\r. A run is a stretch of words with smallest period q and at
    least max(least, times * q) words that no neighbour extends; runs are sorted by start, then period, and of equal
    quotients the first is the top one. collapsed joins by one space the words that no run holds after its first period.
    times is 4 or more. Null and empty texts have no words, no runs, a null top and an empty collapsed text. Texts are read
    whole, a very long one by one task. Rows stay as they are, repeated ones and nulls in other columns included; an empty
    table gives an empty result. Columns of df that are called like a new one are replaced.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods aren't found")
    new = ("n_words", "runs", "top", "collapsed")
    keep = [c for c in df.columns if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused(df, "_text")))
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, top {RUN}, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.columns[-1]), 0).to_numpy(zero_copy_only=False)
            lot = (np.cumsum(size) - size) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    part = b.slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *searched(part.columns[-1], least, times)], [*keep, *new])

    return src.mapInArrow(run, schema)
