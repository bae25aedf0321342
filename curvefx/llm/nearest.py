"""Nearest vectors by inner product: collision counting over query-centred windows of sorted projections.

A vector of norm at most M gets one more entry, so that all have norm M and a larger inner product is a smaller distance.
Every block of vectors has, for each random line, the array of its projections in order. A query's windows are centred at
its own projections and as wide as a radius; they grow by virtual rehashing, which reuses the arrays at any radius.
Vectors that lie in enough of the windows are verified in double precision. Growth ends once the radius reaches the distance
of the k-th best vector known so far: one that is nearer would lie in each window with a known chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored

ship(__name__)

#: Random lines; half a window's width in radii; the chance that a vector at the very radius is passed over.
LINES, HALF, MISS = 128, 1.0, 0.1
#: Windows grow to the radius by this factor, in so many steps.
GROWTH, STEPS = 4.0, 2
#: One row of so many, and at most so many bytes of rows, are compared with every query first: they bound its radius.
SHARE, SAMPLE_BYTES = 8, 8_000_000
#: Bytes of vectors in a block, and of queries in a block.
BLOCK_BYTES, QUERY_BYTES = 3_000_000, 2_000_000
#: Windows with a smaller share of all entries are read from the arrays; of wider ones, ranks are compared with their ends.
NARROW = 0.05


def least_collisions() -> int:
    """The count that a vector at the radius reaches but for a chance of at most MISS: a binomial quantile."""
    p, tail = math.erf(HALF / math.sqrt(2)), 0.0
    for c in range(LINES + 1):
        tail += math.comb(LINES, c) * p**c * (1 - p) ** (LINES - c)
        if tail > MISS:
            return c
    return LINES


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim + 1, LINES))


def vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in one order for every row, so that equal vectors score alike."""
    return (rows * query).sum(1)


class Block:
    """Vectors, with their sorted projections on every line. most: the largest norm of all vectors."""

    def __init__(self, rows: np.ndarray, most: float):
        self.rows, self.most = rows, most
        spare = np.sqrt(np.maximum(most**2 - (rows * rows).sum(1), 0.0))
        values = (np.hstack([rows, spare[:, None]]) @ lines(rows.shape[1])).T
        self.order = np.argsort(values, axis=1)
        self.values = np.take_along_axis(values, self.order, 1)
        self.rank = np.empty(values.shape, np.uint16 if len(rows) < 2**16 else np.uint32)  # each vector's place in each array
        np.put_along_axis(self.rank, self.order, np.arange(len(rows), dtype=self.rank.dtype)[None, :], 1)
        self.rough = rows.astype(np.float32)

    def collisions(self, ends: np.ndarray) -> np.ndarray:
        """In how many of a query's windows (lines, 2) each vector lies."""
        size = ends[:, 1] - ends[:, 0]
        if size.sum() < NARROW * self.rank.size:
            return np.bincount(np.concatenate([o[a:b] for o, (a, b) in zip(self.order, ends.tolist())]), minlength=len(self.rows))
        kind = self.rank.dtype
        inside = self.rank - ends[:, :1].astype(kind) < size[:, None].astype(kind)  # ranks below a window wrap around
        return inside.view(np.uint8).sum(0, dtype=np.uint8 if LINES < 256 else np.int64)

    def radius(self, query: np.ndarray, score: float) -> float:
        """The distance of a vector with this inner product to the query brought to the largest norm."""
        return math.sqrt(max(0.0, 2 * self.most**2 - 2 * score * self.most / math.sqrt(query @ query)))

    def windows(self, centres: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Begin and end in each line's order of each query's window: (queries, lines, 2)."""
        sides = centres[:, :, None] + half[:, None, None] * np.array([-1.0, 1.0])
        return np.stack([v.searchsorted(sides[:, i]) for i, v in enumerate(self.values)], 1)

    def search(self, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of its k best rows that reach its floor, among those with enough collisions."""
        need, slack = least_collisions(), 1e-9 * (self.most + 1)
        scaled = queries * (self.most / np.sqrt((queries * queries).sum(1)))[:, None]
        centres = np.hstack([scaled, np.zeros((len(queries), 1))]) @ lines(self.rows.shape[1])
        n = len(self.rows)
        wholes = np.array([self.radius(q, f) if f > -np.inf else 0.0 for q, f in zip(queries, floors)])
        planned = np.array([self.windows(centres, HALF * wholes * GROWTH ** (step + 1 - STEPS) + slack) for step in range(STEPS)])
        for at, (query, centre, floor, whole) in enumerate(zip(queries, centres, floors, wholes)):
            if floor == -np.inf:  # fewer than k rows bound it: all are compared
                some = np.arange(n)
                got = scores(self.rows, query)
            else:
                kth, some, got, seen = floor, np.zeros(0, np.int64), np.zeros(0), np.zeros(n, bool)
                for step in range(STEPS):
                    reach, ends = whole * GROWTH ** (step + 1 - STEPS), planned[step, at]
                    if self.radius(query, kth) < reach:  # better ones are known by now
                        reach = self.radius(query, kth)
                        ends = self.windows(centre[None], np.array([HALF * reach + slack]))[0]
                    new = np.flatnonzero((self.collisions(ends) >= need) & ~seen)
                    if len(new):
                        seen[new] = True
                        near = new[self.rough[new] @ query.astype(np.float32) >= kth - 1e-5 * self.most * np.sqrt(query @ query)]
                        some, got = np.append(some, near), np.append(got, scores(self.rows[near], query))
                        if len(got) >= k:
                            kth = max(kth, np.partition(got, -k)[-k])
                    if reach >= self.radius(query, kth):
                        break
            if len(got) > k:  # all that tie with the k-th stay: ids settle them
                keep = got >= np.partition(got, -k)[-k]
                some, got = some[keep], got[keep]
            yield some, got


def usable(df: DataFrame, key: str, vector: str, ask: Column) -> DataFrame:
    """id, v, ask and norm2 of the rows with a vector that takes part."""
    src = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(ask, F.lit(False)).alias("ask")).where("v IS NOT NULL")
    schema = T.StructType([src.schema["id"], *T.StructType.fromDDL("ask boolean, v array<double>, dim int, norm2 double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(size)), size)
            fine = np.bincount(of, ~np.isfinite(flat), len(size)) == 0
            norm2 = np.bincount(of, np.where(np.isfinite(flat), flat, 0.0) ** 2, len(size))
            rows = pa.array(np.flatnonzero(fine & (norm2 > 0)))
            got = b.take(rows)
            yield pa.RecordBatch.from_arrays([got.column("id"), got.column("ask"), got.column("v"), pa.array(size).take(rows).cast(pa.int32()), pa.array(norm2).take(rows)], schema.names)

    return src.mapInArrow(run, schema)


def nearest(df: DataFrame, ask: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank from 1, the key column and score: the k nearest rows found for every row where ask is true.

    Nearness is the inner product in double precision, largest first, then the smaller key (nulls last), then either row.
    Candidates are all rows but the query's own; all of them come where there are fewer than k. Vectors that are null, empty,
    zero (also by underflow of the squares), or hold null or non-finite entries take no part, nor do those of another length
    than the commonest (the longest of equally common ones). Repeated rows are candidates each, keys may repeat or be null;
    a null ask isn't asked. An empty table gives an empty result. A row of SHARE, at most SAMPLE_BYTES, is compared with every
    query; the rest is met in blocks, each block of queries with each block of rows, both of bounded bytes.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    base = stored(usable(df, key, vector, ask).withColumn("row", F.monotonically_increasing_id()))
    sizes = base.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("ask").cast("long")).alias("asked"), F.max("norm2").alias("top")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes or not sizes[0]["asked"]:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.DoubleType())]))
    dim, n, asked, most = sizes[0]["dim"], sizes[0]["n"], sizes[0]["asked"], math.sqrt(sizes[0]["top"])
    base = base.where(F.col("dim") == dim)
    picked = F.xxhash64("row")
    sample = base.orderBy(picked, "row").limit(max(1, min(n // SHARE, SAMPLE_BYTES // (8 * dim)))).select("row", "v", picked.alias("hash")).collect()
    last = (sample[-1]["hash"], sample[-1]["row"])
    drawn, drawn_row = np.array([r["v"] for r in sample]), np.array([r["row"] for r in sample])

    queries_schema = "row bigint, v array<double>, floor double, found array<struct<row: bigint, score: double>>"

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the k best of the sample and the score of the k-th."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v, row = vectors(part.column("v")), part.column("row").to_numpy()
                rough = v @ drawn.T
                rough[row[:, None] == drawn_row] = -np.inf
                floors, found = [], []
                for q, r in zip(v, rough):
                    if len(r) > k:
                        near = np.flatnonzero(r >= np.partition(r, -k)[-k] - 1e-9 * most * (most + 1))
                    else:
                        near = np.arange(len(r))
                    near = near[r[near] > -np.inf]
                    s = scores(drawn[near], q)
                    floors.append(np.sort(s)[-k] if len(s) >= k else -np.inf)
                    found.append([{"row": int(drawn_row[i]), "score": float(x)} for i, x in zip(near, s) if x >= floors[-1]])
                kinds = pa.list_(pa.struct([("row", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("v"), pa.array(floors, pa.float64()), pa.array(found, kinds)], ["row", "v", "floor", "found"])

    queries = stored(base.where("ask").select("row", "v").mapInArrow(bounded, queries_schema))
    blocks, query_blocks = (max(1, math.ceil(m * dim * 8 / size)) for m, size in ((n, BLOCK_BYTES), (asked, QUERY_BYTES)))
    deal = lambda seed, count: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")
    rest = base.where((picked > last[0]) | (picked == last[0]) & (F.col("row") > last[1]))
    left = rest.select("row", "v", deal(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("queries"))
    right = queries.select("row", "v", "floor", deal(2, query_blocks).alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            row, asker = a["row"].to_numpy(), b["row"].to_numpy()
            block = Block(vectors(a["v"].combine_chunks()), most)
            for q, (some, got) in zip(asker, block.search(vectors(b["v"].combine_chunks()), b["floor"].to_numpy(), k)):
                other = row[some] != q
                out[0] += [q] * int(other.sum())
                out[1] += row[some][other].tolist()
                out[2] += got[other].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["asker", "row", "score"])

    pairs = left.groupBy("block", "queries").cogroup(right.groupBy("block", "queries")).applyInArrow(met, "asker bigint, row bigint, score double")
    pairs = pairs.unionByName(queries.select(F.col("row").alias("asker"), F.inline("found")))
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last(key), "row")
    ids = base.select("row", F.col("id").alias(key))
    top = pairs.join(ids, "row").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(base.select(F.col("row").alias("asker"), F.col("id").alias("query_id")), "asker").select("query_id", "rank", key, "score")
