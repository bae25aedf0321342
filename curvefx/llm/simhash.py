"""SimHash near-duplicates, linked through the anchors of a covering code.

The code is two binary Golay codes of length 23 on bits 0-22 and 23-45 of the fingerprint; the other bits take
no part in choosing anchors. Each block lies within RADIUS = 3 bits of exactly one codeword. If x and y differ
in at most t bits, then y lies within RADIUS + t1 and RADIUS + t2 bits of the codewords nearest to x, where
t1 + t2 <= t. Every fingerprint therefore goes to all anchors at such distances, about 61 for t = 2, and any
linked pair meets at the anchor nearest to either one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored, unused

ship(__name__)

BLOCK, CHECK_BITS, RADIUS = 23, 11, 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code.
GENERATOR = 0b101011100011
#: Groups at an anchor above this size are linked through shared neighbours, in linear time.
PAIRWISE = 32
#: Members of an anchor that a task holds; those of a larger one go on to an exchange by one-bit neighbour.
MOST_MEMBERS = 500_000


def remainder(word: int) -> int:
    for bit in range(BLOCK - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def code_tables(threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The remainders of single bytes at three offsets; for each excess 0 .. threshold over RADIUS, the error
    patterns of every remainder, padded with -1. Excess 0 holds all patterns of at most RADIUS bits."""
    bits = [remainder(1 << b) for b in range(BLOCK)]
    single = []
    for offset in (0, 8, 16):
        t = np.zeros(256, np.int64)
        for b in range(min(8, BLOCK - offset)):
            t[(np.arange(256) >> b & 1) == 1] ^= bits[offset + b]
        single.append(t)
    found = []
    for excess in range(threshold + 1):
        lists: list[list[int]] = [[] for _ in range(2**CHECK_BITS)]
        for weight in range(RADIUS + 1) if not excess else [RADIUS + excess]:
            for chosen in itertools.combinations(range(BLOCK), weight):
                s = p = 0
                for b in chosen:
                    s ^= bits[b]
                    p |= 1 << b
                lists[s].append(p)
        table = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for s, row in enumerate(lists):
            table[s, : len(row)] = row
        found.append(table)
    return single, found


def anchors(fps: np.ndarray, single: list[np.ndarray], patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of fps and the anchor of each copy."""
    sides = []
    for shift in (0, BLOCK):
        x = (fps >> np.uint64(shift)).astype(np.int64) & (2**BLOCK - 1)
        s = single[0][x & 255] ^ single[1][x >> 8 & 255] ^ single[2][x >> 16]
        side = []
        for table in patterns:
            e = table[s]
            side.append((np.where(e < 0, -1, (x[:, None] ^ e) >> CHECK_BITS)))
        sides.append(side)
    rows, keys = [], []
    for i, j in ((i, j) for i in range(len(patterns)) for j in range(len(patterns)) if i + j < len(patterns)):
        a, b = sides[0][i][:, :, None], sides[1][j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        r, p, q = np.nonzero(ok)
        rows.append(r)
        keys.append(sides[0][i][r, p] << (BLOCK - CHECK_BITS) | sides[1][j][r, q])
    return np.concatenate(rows), np.concatenate(keys)


def majority(parts: Iterator[np.ndarray]) -> int:
    """The 64 bits that over half of all hashes have set; hashes come in parts."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        for at in range(0, len(h), 65536):
            part = np.ascontiguousarray(h[at : at + 65536])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int) -> int:
    """64 majority bits of the XXH64 (seed 42) of the text's word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    grams = map(join, zip(*[words[i:] for i in range(size)])) if len(words) > size else iter([join(words)])
    hashes = (np.fromiter((digest(g, 42) for g in part), np.uint64) for part in iter(lambda: list(itertools.islice(grams, 65536)), []))
    return majority(hashes)


def fingerprints(df: DataFrame, text: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """df without the text column, with a 64-bit fingerprint as a signed long. Null and wordless texts have fingerprint 0."""
    keep = [c for c in df.columns if c not in (text, out)]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused(df, "_text")))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*keep, out])

    return src.mapInArrow(run, schema)


def neighbour_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of fps within two bits: such a pair shares a word within one bit of both, and any two that share one are within two bits."""
    keys, _ = one_bit_words(fps)
    owner = np.repeat(np.arange(len(fps)), 65)
    o = np.argsort(keys, kind="stable")
    k, w = keys[o], owner[o]
    same = k[1:] == k[:-1]
    pairs = np.unique(np.stack([w[:-1][same], w[1:][same]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between 0 .. n - 1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = find(x), find(y)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def group_links(anchor: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows that share an anchor; connects just what the threshold connects."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    left, right = [], []
    small = np.repeat((sizes <= PAIRWISE) | (threshold != 2), sizes)
    for k in range(1, int(sizes[(sizes <= PAIRWISE) | (threshold != 2)].max(initial=1))):
        i = np.flatnonzero((anchor[k:] == anchor[:-k]) & small[:-k])
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= threshold]
        left.append(fps[i])
        right.append(fps[i + k])
    for s, m in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE]) if threshold == 2 else ():
        own = fps[s : s + m]
        tree = np.array(spanning(m, *neighbour_links(own)), np.int64).reshape(-1, 2)
        left.append(own[tree[:, 0]])
        right.append(own[tree[:, 1]])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def one_bit_words(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words within one bit of each of fps, and the fingerprint of each."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return (fps[:, None] ^ flips[None, :]).ravel(), np.repeat(fps, 65)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs a, b of distinct fingerprints whose links connect all that differ in at most threshold bits, 2 at most.

    fps has distinct values in column fp. Groups of up to PAIRWISE fingerprints at an anchor give all their
    links; larger ones a spanning forest of them, so no group emits its pairs. A task holds MOST_MEMBERS of an anchor: if
    there are more, every member goes to all words within one bit of it, where neighbours in order are linked.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("fingerprints are linked at two bits or fewer")
    single, patterns = code_tables(threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 2048):
                r, key = anchors(x[at : at + 2048], single, patterns)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(x[at + r].view(np.int64))], ["anchor", "fp"])

    def told(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def passed_on(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fp), 10_000):
            yield told(*one_bit_words(fp[at : at + 10_000]), 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (kind 0), and words with a fingerprint each (kind 1) of anchors that are too large."""
        anchor, fp, large = np.zeros(0, np.int32), np.zeros(0, np.uint64), -1
        for b in itertools.chain(batches, [None]):
            if b is not None:
                anchor = np.concatenate([anchor, b.column(0).to_numpy()])
                fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            rest = int(np.searchsorted(anchor, large, side="right"))  # more of the large anchor
            yield from passed_on(fp[:rest])
            anchor, fp = anchor[rest:], fp[rest:]
            cut = int(np.searchsorted(anchor, anchor[-1])) if b is not None and len(anchor) else len(anchor)
            if cut:
                a, c = group_links(anchor[:cut], fp[:cut], threshold)
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0)
                    yield told(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), 0)
                anchor, fp = anchor[cut:], fp[cut:]
            if threshold == 2 and len(anchor) > MOST_MEMBERS:
                large = int(anchor[0])
                yield from passed_on(fp)
                anchor, fp = anchor[:0], fp[:0]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links, and of each word the fingerprints that follow each other."""
        word, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            a, c, kind = (x.to_numpy() for x in b.columns)
            own = kind == 0
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(c[own])], ["a", "b"])
            w, f = a[~own], c[~own]
            if not len(w):
                continue
            if word is not None:
                w, f = np.r_[word, w], np.r_[last, f]
            same = (w[1:] == w[:-1]) & (f[1:] != f[:-1])
            x, y = f[:-1][same].view(np.uint64), f[1:][same].view(np.uint64)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))], ["a", "b"])
            word, last = w[-1], f[-1]

    copies = fps.select("fp").mapInArrow(spread, "anchor int, fp long")
    found = copies.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(meet, "a long, b long, kind int")
    return found.repartition("a").sortWithinPartitions("kind", "a", "b").mapInArrow(neighbours, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the edges; root is the smallest node of its connected part.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = stored(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        e = stored(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, threshold: int = 2) -> DataFrame:
    """key, fp (signed long) and component_id, the smallest key that the row reaches over links, itself included.

    One result row for each row of df; repeated rows and equal keys repeat. Null and wordless texts have
    fingerprint 0 and are linked like any other; texts of any length are read whole. A row with a null key takes part in linking and gets the
    smallest non-null key it reaches, or null. An empty table gives an empty result; other columns are not read.
    """
    rows = stored(fingerprints(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_text", size))
    own = rows.groupBy("fp").agg(F.min("_key").alias("first_key"))
    roots = components(links(own.select("fp"), threshold))
    linked = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = linked.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = linked.join(firsts, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("_key").alias(key), "fp", "component_id")
