"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8, and what they connect.

Candidates meet at the anchors of the covering code that simhash.py describes. A text has three fingerprints of 64 majority
bits, each of which goes to about 61 anchors. Fingerprints are of its two-word shingles, of which a changed word touches
two, not five: with scattered changes, similarity 0.8 means that about a tenth of the bits differ. That is more than the
code guarantees, but pairs so close still share an anchor of one of the fingerprints, also where they differ in one long
passage and a seventh of the bits differ (README has measured shares). At an anchor all pairs that differ in
at most MOST_BITS of all three are candidates, and every link is checked on the whole five-word sets.
Where an anchor has more than LINEAR candidate pairs a member, as in a family of near copies, no pairs go out, but members, each with
one that has many candidates, the anchor's hub. Anchors with the same hub, as a family's mostly are, become
one group, in which each of their members stands once and any two that met at one of them meet again. A member of many groups
is compared with two of its hubs, the least and the closest one, and pairs of other anchors are left to a group that both are in.
In the groups, those that this leaves apart are compared with their closest one, and at last the sets of what is
still unconnected meet, where every remaining
candidate is checked in place and only links leave. So pairs grow with members and not with pairs or groups, and no candidate is
left out.
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

from .common import ship, stored
from .simhash import anchors, code_tables, components, majority

ship(__name__)

#: Words of a shingle, for the similarity and for fingerprints.
SIZE, PRINTED = 5, 2
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Guaranteed bits of the anchors, and the most bits of 192 in which candidates differ: a similarity of 0.8 means 18 to 28 of
#: them, with a deviation of five.
THRESHOLD, MOST_BITS = 2, 44
#: Candidate pairs a member that an anchor sends out; members whose sets meet in one task; and, where an anchor has more,
#: members of which one becomes its hub.
LINEAR, TILE, HUBS = 4, 10_000, 64
#: Groups of a member, the largest ones, in which a pair of other anchors is looked for.
GROUPS = 16
#: Rows that a task holds to name each of them once before they leave.
HELD = 300_000
PRINTS = ["fp", "fq", "fr"]
PRINT_KINDS = "fp long, fq long, fr long"


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The different XXH64 of the text's word shingles, sorted, A-Z lower-cased; one of all words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    grams = map(join, zip(*[words[i:] for i in range(size)])) if len(words) > size else [join(words)]
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def fingerprints(hashes: np.ndarray) -> list[int]:
    """Majority bits of a set's hashes, and of the same hashes mixed once and twice more; 0 for an empty set."""
    out = []
    for _ in PRINTS:
        out.append(majority(iter([hashes])))
        hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ hashes >> np.uint64(32)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of at least NUMERATOR / DENOMINATOR."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, _row, node (a digest of the shingle set), n (its size) and its fingerprints."""
    src = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_row"), F.col("text").cast("string"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"_row long, node long, n int, {PRINT_KINDS}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints = [], [], []
            for t in b.column(2):
                h = shingles(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 7) - 2**63)
                sizes.append(len(h))
                prints.append(fingerprints(shingles(t.as_py(), PRINTED)))
            p = np.array(prints, np.uint64).reshape(-1, len(PRINTS)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(c) for c in p.T]], ["doc_id", "_row", "node", "n", *PRINTS])

    return src.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of runs of whole anchors, which stand in order in the first column."""
    held: list[list[np.ndarray]] = []  # parts of one anchor
    whole = lambda: [np.concatenate(x) for x in zip(*held)]
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if held and (cut or held[0][0][0] != new[0][0]):
            held.append([c[:cut] for c in new])
            yield whole()
            held = []
        elif cut:
            yield [c[:cut] for c in new]
        held.append([c[cut:] for c in new])
    if held:
        yield whole()


def apart(prints: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which the pairs i, j differ."""
    return sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(int) for p in prints)


def candidates(prints: list[np.ndarray], rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places i < j of all pairs that differ in at most MOST_BITS bits, or all i, j of which i is in rows; some at a time."""
    n = len(prints[0])
    step = max(1, 2_000_000 // max(n, 1))
    for at in range(0, n if rows is None else len(rows), step):
        own = np.arange(at, min(at + step, n)) if rows is None else rows[at : at + step]
        low = at if rows is None else 0
        bits = sum(np.bitwise_count((p[own, None] ^ p[None, low:]).view(np.uint64)) for p in prints)
        i, j = np.nonzero(bits <= MOST_BITS)
        i, j = own[i], j + low
        use = i < j if rows is None else i != j
        yield i[use], j[use]


def met(members: DataFrame) -> DataFrame:
    """a, b, hub, bits and fingerprints: candidate pairs a < b of nodes, and, with null b, members a of anchors with too many of them, bits from the hub.

    A task names a pair, or a member of a hub's anchors, once for every HELD rows; other tasks may name it again.

    The hub of such an anchor is the least node with half the most candidates; of other ones all pairs go out. An
    anchor of more than TILE members has too many by itself, and its hub is one of HUBS members.
    """
    single, patterns = code_tables(THRESHOLD)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, *prints = (c.to_numpy() for c in b.columns)
            for at in range(0, len(node), 2048):
                for k in range(len(PRINTS)):
                    r, key = anchors(prints[k][at : at + 2048].view(np.uint64), single, patterns)
                    r = r + at
                    yield pa.RecordBatch.from_arrays([pa.array((key << 2 | k).astype(np.int32)), pa.array(node[r]), *[pa.array(p[r]) for p in prints]], ["anchor", "node", *PRINTS])

    def told(pairs: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
        out, member = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(members), axis=0)
        n, m = len(out), len(member)
        columns = [pa.array(np.r_[out[:, 0], member[:, 1]]), pa.array(np.r_[out[:, 1], member[:, 1]], mask=np.arange(n + m) >= n)]
        rest = [pa.array(np.r_[np.zeros(n, np.int64), c]) for c in (member[:, 0], *member[:, 2:].T)]
        return pa.RecordBatch.from_arrays([*columns, *rest], ["a", "b", "hub", "bits", *PRINTS])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda: ([np.zeros((0, 2), np.int64)], [np.zeros((0, 3 + len(PRINTS)), np.int64)])
        pairs, large = none()
        for anchor, node, *prints in groups(batches):
            cuts = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)]
            two = np.flatnonzero(np.diff(cuts) == 2)  # most anchors that are shared at all
            i = cuts[two]
            i = i[apart(prints, i, i + 1) <= MOST_BITS]
            pairs.append(np.stack([node[i], node[i + 1]], 1))
            for s, e in zip(cuts[:-1][np.diff(cuts) > 2], cuts[1:][np.diff(cuts) > 2]):
                degree, found, n, own = np.zeros(e - s, np.int64), [], 0, [p[s:e] for p in prints]
                some = np.linspace(0, e - s - 1, HUBS).astype(int) if e - s > TILE else None
                for i, j in candidates(own, some):
                    degree += np.bincount(i, minlength=e - s) + (np.bincount(j, minlength=e - s) if some is None else 0)
                    n += len(i)
                    if n <= LINEAR * (e - s):
                        found.append(np.stack([node[s + i], node[s + j]], 1))
                if n > LINEAR * (e - s) or some is not None:
                    hub = int((2 * degree >= degree.max()).argmax())  # the least node of many candidates, which is the same at many anchors
                    j = np.flatnonzero(degree) if some is None else np.arange(e - s)
                    large.append(np.stack([np.full(len(j), node[s + hub]), node[s + j], apart(own, np.full(len(j), hub), j), *[p[j] for p in own]], 1))
                    found = []
                pairs += found
            if sum(map(len, pairs)) + sum(map(len, large)) > HELD:
                yield told(pairs, large)
                pairs, large = none()
        yield told(pairs, large)

    copies = members.select("node", *PRINTS).mapInArrow(spread, f"anchor int, node long, {PRINT_KINDS}")
    return copies.repartition("anchor").sortWithinPartitions("anchor", "node").mapInArrow(meet, f"a long, b long, hub long, bits long, {PRINT_KINDS}")


def by_hub(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Begin and end of each hub's group whose members have different roots (the second column)."""
    hub, root = columns[:2]
    cuts = np.r_[np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]]), len(hub)]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if (root[s:e] != root[s]).any():
            yield s, e


def closest(placed: DataFrame) -> DataFrame:
    """a, b: for each node outside the largest root of a hub's group, its closest candidate with another root."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(batches):
            _, root, node, *prints = columns
            pairs = [np.zeros((0, 2), np.int64)]
            for s, e in by_hub(columns):
                names, counts = np.unique(root[s:e], return_counts=True)
                for i in s + np.flatnonzero(root[s:e] != names[counts.argmax()]):
                    j = s + np.flatnonzero(root[s:e] != root[i])
                    bits = apart(prints, np.full(len(j), i), j)
                    if bits.min() <= MOST_BITS:
                        pairs.append(np.sort(node[[i, j[bits.argmin()]]])[None, :])
            out = np.unique(np.concatenate(pairs), axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    rows = placed.select("hub", "root", "node", *PRINTS)
    return rows.repartition("hub").sortWithinPartitions("hub", "node").mapInArrow(meet, "a long, b long").distinct()


def unconnected(placed: DataFrame) -> DataFrame:
    """hub, root, node and fingerprints: the members of hubs' groups that are in a candidate pair of different roots.

    Such a pair has a member outside the group's largest root, so only those are compared with all.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(batches):
            _, root, _, *prints = columns
            use = np.zeros(len(root), bool)
            for s, e in by_hub(columns):
                names, counts = np.unique(root[s:e], return_counts=True)
                for i, j in candidates([p[s:e] for p in prints], np.flatnonzero(root[s:e] != names[counts.argmax()])):
                    apart_ = root[s + i] != root[s + j]
                    use[s + i[apart_]] = use[s + j[apart_]] = True
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in columns], ["hub", "root", "node", *PRINTS])

    rows = placed.select("hub", "root", "node", *PRINTS)
    return rows.repartition("hub").sortWithinPartitions("hub", "node").mapInArrow(meet, f"hub long, root long, node long, {PRINT_KINDS}")


def sets_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its packed set, from one text of each."""
    places = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_row").alias("_row"))
    own = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_row"), F.col("text").cast("string").alias("text"))
    texts = own.join(places, "_row").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def settled(left: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between the different roots of unconnected(), each candidate checked on whole sets unless a link found before spares it.

    A hub's group of more than TILE members is dealt over tiles, so that any two of its members meet in one of them.
    """
    tiles = left.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int")
    dealt = left.join(tiles, "hub").withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    dealt = dealt.withColumn("tile", F.xxhash64("hub", F.least("_own", "_with"), F.greatest("_own", "_with"))).join(sets, "node").select("tile", "root", "node", "set", *PRINTS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(batches):
            tile, root, node, packed, *prints = columns
            links = []
            cuts = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = [np.frombuffer(x, np.uint64) for x in packed[s:e]]
                now = np.unique(root[s:e], return_inverse=True)[1]
                for i, j in candidates([p[s:e] for p in prints]):
                    for x, y in zip(i[now[i] != now[j]].tolist(), j[now[i] != now[j]].tolist()):
                        if now[x] != now[y] and similar(own[x], own[y]):
                            links.append((node[s + x], node[s + y]))
                            now[now == now[y]] = now[x]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return dealt.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(meet, "a long, b long").distinct()


def to_hubs(large: DataFrame) -> DataFrame:
    """a, b: each member of hubs' groups with the least and with the closest hub that it is a candidate of, so two pairs a member at most."""
    near = large.where((F.col("bits") <= MOST_BITS) & (F.col("node") != F.col("hub")))
    two = near.groupBy("node").agg(F.min("hub").alias("_least"), F.min(F.struct("bits", "hub")).alias("_closest"))
    both = two.select("node", F.col("_least").alias("hub")).union(two.select("node", "_closest.hub"))
    return both.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def apart_from_hubs(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs a, b that are not in one hub's group, where they would meet again: not in one of the GROUPS largest of each."""
    sizes = large.groupBy("hub").agg(F.count("*").alias("_size"))
    own = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("s"), "hub"))), 1, GROUPS)
    hubs = large.select("node", "hub").join(sizes, "hub").groupBy("node").agg(F.transform(own, lambda e: e["hub"]).alias("_hubs"))
    x, y = hubs.select(F.col("node").alias("a"), F.col("_hubs").alias("_x")), hubs.select(F.col("node").alias("b"), F.col("_hubs").alias("_y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(~F.coalesce(F.arrays_overlap("_x", "_y"), F.lit(False))).select("a", "b")


def checked(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b of nodes whose whole sets are similar, read again from one text of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("_row").alias("_row"))
    own = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_row"), F.col("text").cast("string").alias("text"))
    texts = stored(own.join(places, "_row").groupBy("node").agg(F.first("text").alias("text")))
    b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, own = a, shingles(batch.column(2)[i].as_py())
                out.append(similar(own, shingles(batch.column(3)[i].as_py())))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, _row (the hash of id and text) and component, the same number for all rows that similarity connects.

    One result row for each row of docs, repeated rows too; an empty table gives an empty result. Texts are read whole.
    Rows without words are connected with each other; a null id is like any other. Ties have no effect: a component's
    number only says which rows it holds. Only doc_id and text are read.
    """
    rows = stored(signed(docs))
    members = rows.groupBy("node").agg(F.first("n").alias("n"), *[F.first(p).alias(p) for p in PRINTS])
    found = stored(met(members.where("n > 0")))
    sizes = members.select("node", "n")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        x, y = sizes.select(F.col("node").alias("a"), F.col("n").alias("_x")), sizes.select(F.col("node").alias("b"), F.col("n").alias("_y"))
        fits = F.least("_x", "_y") * DENOMINATOR >= F.greatest("_x", "_y") * NUMERATOR
        return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b")

    large = stored(found.where("b IS NULL").select(F.col("a").alias("node"), "hub", "bits", *PRINTS).dropDuplicates(["hub", "node"]))
    placed = lambda: large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tree = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    tried = stored(fitting(to_hubs(large).union(apart_from_hubs(pairs, large)).distinct()))
    roots = stored(components(checked(tried, rows, docs)))
    near = stored(fitting(closest(placed())).join(tried, ["a", "b"], "left_anti"))
    roots = stored(components(checked(near, rows, docs).union(tree())))
    left = stored(unconnected(placed()))
    sets = sets_of(left.select("node").distinct(), rows, docs)
    roots = components(settled(left, sets).union(tree()))
    return rows.join(roots, "node", "left").select("doc_id", "_row", F.coalesce("root", "node").alias("component"))
