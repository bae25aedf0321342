"""K-d tree sharding: recursive splits at distributed weighted medians of the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, stored

#: Bits of a dimension's code, and of each of the two tie-breaking hash digits below it.
DIGIT_BITS = 12
DIGITS = 3
SLOT_BUCKETS = 256
#: A text group of more than 1/HEAVY of a leaf is placed by remaining room.
HEAVY = 16


@dataclass(frozen=True)
class Node:
    """Shards first .. first + shards - 1 below one node of the tree, and the heavy texts placed there."""

    node: int
    first: int
    shards: int
    heavy: tuple[tuple[str, int], ...] = ()


def size_code(size: Column) -> Column:
    """log2 of the size in 1/100 steps, below 2**DIGIT_BITS."""
    return F.least(F.floor(F.log2(size.cast("double")) * 100), F.lit(2**DIGIT_BITS - 1)).cast("long")


def name_code(name: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(2**DIGIT_BITS)).cast("long")


def with_shares(groups: DataFrame, dims: int) -> DataFrame:
    """groups with _s0, _s1, ...: where each code stands in its dimension, as the share of all weight below its middle.

    So all dimensions have the same scale: names, of which there may be two or thousands, and sizes. A dimension has at
    most 2**DIGIT_BITS codes, which bounds what is broadcast and what one window orders.
    """
    for d in range(dims):
        code = F.shiftright(f"_k{d}", DIGIT_BITS * (DIGITS - 1))
        sums = groups.groupBy(code.alias("_code")).agg(F.sum("_weight").cast("double").alias("_w"))
        upto = sums.select("_code", "_w", F.sum("_w").over(Window.orderBy("_code").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_w").over(Window.partitionBy(F.lit(1))).alias("_all"))
        shares = upto.select("_code", F.try_divide(F.col("_upto") - F.col("_w") / 2, F.col("_all")).alias(f"_s{d}"))
        groups = groups.join(F.broadcast(shares), code == F.col("_code")).drop("_code")
    return groups


def case_of(node: Column, values: dict[int, object], kind: str) -> Column:
    """A value for each tree node; there are at most as many nodes as shards."""
    out = None
    for k, v in values.items():
        out = F.when(node == k, F.lit(v)) if out is None else out.when(node == k, F.lit(v))
    return (out if out is not None else F.lit(None)).cast(kind)


def halve(node: Node, light: float) -> tuple[Node, Node, float]:
    """Both halves of a node with its heavy texts dealt by remaining room, and the light weight due to the lower half."""
    low = node.shards // 2
    total = light + sum(w for _, w in node.heavy)
    room = [total * low / node.shards, total * (node.shards - low) / node.shards]
    sides: tuple[list, list] = ([], [])
    for g, w in sorted(node.heavy, key=lambda x: (-x[1], x[0])):
        side = int(room[1] > room[0])
        sides[side].append((g, w))
        room[side] -= w
    halves = Node(2 * node.node, node.first, low, tuple(sides[0])), Node(2 * node.node + 1, node.first + low, node.shards - low, tuple(sides[1]))
    return *halves, min(max(room[0], 0.0), light)


def widths(groups: DataFrame, dims: int) -> dict[int, tuple[float, int]]:
    """For each node: its weight, and the dimension with the widest range of shares (the first one at a tie)."""
    spans = groups.groupBy("_node").agg(F.sum("_weight").cast("double").alias("w"), *[(F.max(f"_s{d}") - F.min(f"_s{d}")).alias(f"s{d}") for d in range(dims)])
    return {r["_node"]: (r["w"], max(range(dims), key=lambda d: (r[f"s{d}"], -d))) for r in spans.collect()}


def weighted_cuts(groups: DataFrame, dim: dict[int, int], goal: dict[int, float]) -> dict[int, int]:
    """For each node, the key below which the weight comes nearest to its goal.

    A radix selection: each round sums the weight of each digit value in the part still open, so every row
    takes part and one small row for each node reaches the driver.
    """
    key = F.lit(None).cast("long")
    for d in set(dim.values()):
        key = F.when(F.col("_node").isin([n for n, k in dim.items() if k == d]), F.col(f"_k{d}")).otherwise(key)
    prefix, below = dict.fromkeys(dim, 0), dict.fromkeys(dim, 0.0)
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        part = groups.where(F.col("_node").isin(list(dim))).select("_node", F.col("_weight").alias("_w"), key.alias("_key"))
        if digit:
            part = part.where(F.shiftright("_key", shift + DIGIT_BITS) == case_of(F.col("_node"), prefix, "long"))
        sums = part.groupBy("_node", F.shiftright("_key", shift).alias("_digit")).agg(F.sum("_w").cast("double").alias("_w"))
        run = sums.withColumn("_upto", F.sum("_w").over(Window.partitionBy("_node").orderBy("_digit")))
        left = {n: goal[n] - below[n] for n in dim}
        hit = run.groupBy("_node").agg(F.min_by(F.struct("_digit", "_upto", "_w"), F.struct(F.col("_upto") < case_of(F.col("_node"), left, "double"), F.when(F.col("_upto") < case_of(F.col("_node"), left, "double"), -F.col("_upto")).otherwise(F.col("_upto")))).alias("h"))
        for r in hit.collect():
            n, h = r["_node"], r["h"]
            prefix[n], at = h["_digit"], h["_upto"] - h["_w"]
            if digit == DIGITS - 1 and left[n] - at > h["_upto"] - left[n]:
                prefix[n] += 1  # the cut above this key is nearer
            below[n] += at
    return prefix


def kd_shards(df: DataFrame, shards: int = 24, text: str = "text", names: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """df with size, text_crc32, shard and slot columns: a k-d tree over names and size, all shards near equal in size.

    Rows with equal texts form a group that stays in one shard, placed by its smallest names. Size is the
    text's UTF-8 bytes plus 8. A node is cut along its widest dimension, widths being measured in shares of all
    weight (with_shares). A leaf's target is the total size over the number of shards; a node of k
    shards is cut where its lower k // 2 shards get their share. Groups heavier than 1/HEAVY of a leaf (at
    most HEAVY x shards of them) are dealt to the side with more room, and one that fills a leaf alone gets
    its own. Slots number the rows of a shard without gaps. Null texts have size 8 and the crc32 of the empty
    text and form one group, apart from empty texts; null names sort as empty ones. Repeated rows are rows
    of their own; an empty table gives an empty result. Texts of any length are measured whole; beyond the first pass only
    their sizes and hashes travel. Columns called like a new column are replaced.
    """
    df = df.drop(*[c for c in df.columns if c in ("size", "text_crc32", "shard", "slot")])
    by_id = [F.col("_all.doc_id")] if "doc_id" in df.columns else []
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), *[column_or_null(df, n, "string").alias(f"_name{i}") for i, n in enumerate(names)], (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(t.cast("binary")), F.lit("-")).alias("_group"))
    dims = len(names) + 1
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_weight"), F.first("size").alias("_size"), *[F.min(f"_name{i}").alias(f"_name{i}") for i in range(len(names))])
    tie = F.pmod(F.xxhash64("_group"), F.lit(2 ** (DIGIT_BITS * (DIGITS - 1)))).cast("long")
    codes = [*[name_code(F.col(f"_name{i}")) for i in range(len(names))], size_code(F.col("_size"))]
    groups = stored(groups.select("_group", "_weight", *[(F.shiftleft(c, DIGIT_BITS * (DIGITS - 1)) + tie).alias(f"_k{d}") for d, c in enumerate(codes)]))
    groups = with_shares(groups, dims)

    total = groups.agg(F.sum("_weight")).first()[0] or 0
    heavy = [(r["_group"], r["_weight"]) for r in groups.where(F.col("_weight") * (HEAVY * shards) >= total).orderBy(F.desc("_weight"), "_group").limit(HEAVY * shards).collect()]
    shard_of, first = {}, 0
    light = groups.join(F.broadcast(df.sparkSession.createDataFrame([(g,) for g, _ in heavy], "_group string")), "_group", "left_anti") if heavy else groups
    while heavy and shards - first > 1 and heavy[0][1] * (shards - first) >= total:
        g, w = heavy.pop(0)
        shard_of[g], total, first = first, total - w, first + 1

    tree, place = [Node(1, first, shards - first, tuple(heavy))], F.lit(1)
    while any(n.shards > 1 for n in tree):
        at = light.withColumn("_node", place)
        known = widths(at, dims)
        goal, step, following = {}, place, [n for n in tree if n.shards == 1]
        for n in (n for n in tree if n.shards > 1):
            low, high, goal[n.node] = halve(n, known.get(n.node, (0.0, 0))[0])
            following += [low, high]
        dim = {n: known[n][1] for n in goal if n in known}
        cut = weighted_cuts(at, dim, goal) if dim else {}
        for n, d in dim.items():
            step = F.when(place == n, F.when(F.col(f"_k{d}") < cut[n], 2 * n).otherwise(2 * n + 1)).otherwise(step)
        light = stored(at.withColumn("_next", step.cast("int")).select("_group", "_weight", *[f"_{c}{d}" for c in "ks" for d in range(dims)], F.col("_next").alias("_place")))
        tree, place = following, F.col("_place")
    shard_of |= {g: n.first for n in tree for g, _ in n.heavy}
    leaf = light.select("_group", case_of(place, {n.node: n.first for n in tree}, "int").alias("shard"))
    if shard_of:
        leaf = leaf.union(df.sparkSession.createDataFrame(sorted(shard_of.items()), "_group string, shard int"))
    placed = rows.join(leaf, "_group").withColumn("_bucket", F.pmod(F.xxhash64(*(by_id or [F.col("_group")])), F.lit(SLOT_BUCKETS)).cast("int"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*by_id, "_group")))
    # starts has at most shards x SLOT_BUCKETS rows
    return numbered.join(F.broadcast(starts), ["shard", "_bucket"]).select("_all.*", "size", "text_crc32", "shard", (F.col("_row") - 1 + F.col("_start")).cast("long").alias("slot"))
