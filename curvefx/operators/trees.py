"""Histogram trees shared by two arms, grown level by level as Spark jobs, for many models at once.

A training row is a unit, with one entry for each model in its arrays: x ARRAY<DOUBLE> (features, common to all models),
a ARRAY<INT> (arms), t ARRAY<INT> (1 where the model trains on the unit), mass ARRAY<DOUBLE>, v ARRAY<DOUBLE> (targets, model
after model) and, for the contrast rule, w ARRAY<DOUBLE> (arm less propensity). So rows don't grow with models. A split's gain
is |V_left|^2 / M_left + |V_right|^2 / M_right - |V|^2 / M with sums V of v and M of mass; with v = target and mass 1 that
is the drop of the pooled squared error. Each level is one job for all models: tasks add up histograms by model, node,
feature, bin and arm, Spark reduces them and finds each feature's best cut, and one small row for each model, node and
feature reaches the driver, with the sums on both sides of the cut, so leaves need no job of their own. Cuts are midpoints of distinct values while there are at most BINS, else of quantile bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

ship(__name__)

BINS = 32
SUMS = "n long, mass double, ss double, w double, ww double, vec array<double>, wvec array<double>"
HIST = f"model int, node int, feature int, bin int, arm int, {SUMS}"
NODES = "model int, node int, feature int, cut double, low int, high int, share double, value0 array<double>, value1 array<double>"


@dataclass
class Forest:
    """One tree for each model as node arrays. A leaf has feature -1; values are by arm, or b and d under the contrast rule.

    Node numbers are places in the arrays; root is -1 for a model without a tree, which predicts zeros.
    """

    root: np.ndarray
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    value: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contrast: bool = False

    def add(self) -> int:
        for c, v in ((self.feature, -1), (self.cut, np.nan), (self.low, -1), (self.high, -1), (self.share, 0.0)):
            c.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float) -> list[int]:
        self.feature[node], self.cut[node] = feature, cut
        self.low[node], self.high[node] = self.add(), self.add()
        return [self.low[node], self.high[node]]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each model's tree, walked level by level for all models at once."""
        node = np.repeat(self.root[None, :], len(x), 0)
        feature, cut, low, high = np.array(self.feature + [-1]), np.array(self.cut + [np.nan]), np.array(self.low + [-1]), np.array(self.high + [-1])
        row = np.arange(len(x))[:, None]
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = x[row, np.maximum(f, 0)] > cut[node]
            node = np.where(inner, np.where(right, high[node], low[node]), node)

    def predict(self, x: np.ndarray, arm: np.ndarray, e: np.ndarray | None = None) -> np.ndarray:
        """(rows, models, values) for arms (rows, models); e has propensities for the contrast rule, else the leaf's treated share is used."""
        return self.values(self.route(x), arm, e)

    def values(self, leaf: np.ndarray, arm: np.ndarray, e: np.ndarray | None = None) -> np.ndarray:
        """What predict() gives at leaves of route(), for arms and e of the same shape."""
        width = len(next(iter(self.value.values()))[0]) if self.value else 1
        table = np.zeros((len(self.feature) + 1, 2, width))
        for k, pair in self.value.items():
            table[k] = pair
        if not self.contrast:
            return table[leaf, arm]
        centre = np.array(self.share + [0.0])[leaf] if e is None else e
        return table[leaf, 0] + (arm - centre)[..., None] * table[leaf, 1]

    def splits(self, model: int = 0) -> dict[int, tuple[int, float]]:
        """Splits of one tree by heap number, the root being 1."""
        out, todo = {}, [(1, int(self.root[model]))]
        while todo:
            k, node = todo.pop()
            if node >= 0 and self.feature[node] >= 0:
                out[k] = (self.feature[node], self.cut[node])
                todo += [(2 * k, self.low[node]), (2 * k + 1, self.high[node])]
        return dict(sorted(out.items()))

    def leaves(self, model: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Values of one tree's leaves by heap number."""
        out, todo = {}, [(1, int(self.root[model]))]
        while todo:
            k, node = todo.pop()
            if node >= 0 and self.feature[node] >= 0:
                todo += [(2 * k, self.low[node]), (2 * k + 1, self.high[node])]
            elif node in self.value:
                out[k] = self.value[node]
        return dict(sorted(out.items()))

    def rows(self) -> list[tuple]:
        """The node table NODES; model is set at roots only."""
        roots = {int(r): m for m, r in enumerate(self.root) if r >= 0}
        vec = lambda k, i: [float(v) for v in self.value[k][i]] if k in self.value else None
        return [(roots.get(k), k, self.feature[k], None if np.isnan(self.cut[k]) else float(self.cut[k]), self.low[k], self.high[k], float(self.share[k]), vec(k, 0), vec(k, 1)) for k in range(len(self.feature))]

    @classmethod
    def of_rows(cls, rows: list, models: int, contrast: bool = False) -> Forest:
        out = cls(np.full(models, -1), contrast=contrast)
        for r in sorted(rows, key=lambda r: r["node"]):
            k = out.add()
            out.feature[k], out.low[k], out.high[k], out.share[k] = r["feature"], r["low"], r["high"], r["share"]
            out.cut[k] = np.nan if r["cut"] is None else r["cut"]
            if r["value0"] is not None:
                out.value[k] = np.array(r["value0"]), np.array(r["value1"])
            if r["model"] is not None:
                out.root[r["model"]] = k
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODES)


@dataclass(frozen=True)
class Rules:
    """Growth limits and the leaf rule: forced, arm_shrinkage, ridge, threshold, independent, r_loss or contrast; penalty by model.

    gain "solve" (contrast only) takes what b + w d explains on each side of a cut in place of what b explains.
    """

    depth: int = 2
    leaf: int = 5
    arm_leaf: int = 2
    rule: str = "ridge"
    penalty: dict[int, float] = field(default_factory=dict)
    shared: float = 1.0
    gain: str = "pooled"


def cut_points(df: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Candidate cuts of each feature, over all rows of df: features alone, so held-out rows may be among them."""
    rows = df.select(*[F.get("x", F.lit(f)).alias(f"x{f}") for f in range(width)])
    few = rows.agg(*[F.approx_count_distinct(f"x{f}").alias(f"x{f}") for f in range(width)]).first()
    sets = {f: F.collect_set(F.struct(f"x{f}")) for f in range(width) if few[f] <= bins * 2}  # about 2 bins values at most; a null is one
    probs = [i / bins for i in range(1, bins)]
    got = rows.agg(*[s.alias(f"set{f}") for f, s in sets.items()], *[F.percentile_approx(f"x{f}", probs, 10000).alias(f"x{f}") for f in range(width)]).first()
    out = []
    for f in range(width):
        values = [r[0] for r in got[f"set{f}"]] if f in sets else []
        v = np.unique(np.array(values if 0 < len(values) <= bins else got[f"x{f}"], float))
        out.append(((v[:-1] + v[1:]) / 2).tolist() if len(v) > 1 else [])
    return out


def matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as rows, or of numbers as rows of one."""
    c = b.column(b.schema.get_field_index(name))
    if not pa.types.is_list(c.type):
        return c.to_numpy(zero_copy_only=False).reshape(-1, 1)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def row_sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each of n groups, column by column and in order, so to the last bit those of np.add.at."""
    return np.stack([np.bincount(group, c, n) for c in values.T], 1) if values.shape[1] else np.zeros((n, 0))


Getter = Callable[[str], np.ndarray]


def nodes_by_model(forest: Forest, wanted: set[int]) -> list[list[int]]:
    """The wanted nodes of each model's tree."""
    out = []
    for root in forest.root.tolist():
        found, todo = [], [root] if root >= 0 else []
        while todo:
            k = todo.pop()
            if k in wanted:
                found.append(k)
            if forest.feature[k] >= 0:
                todo += [forest.low[k], forest.high[k]]
        out.append(sorted(found))
    return out


def histograms(rows: DataFrame, forest: Forest, open_nodes: list[int], cuts: list[list[float]], by_feature: bool, target: Callable[[Getter], np.ndarray] | None = None, view: Callable[[Getter], Getter] | None = None, at_once: int | None = None) -> DataFrame:
    """Sums by model, node, feature, bin and arm over rows in open nodes; one feature -1 and bin 0 without by_feature.

    target makes v from a function that gives a column y, f or w as a matrix, where rows have no v; w is then for it alone.
    view makes from the function that gives the columns of rows another one, which has all of x, a, t and mass (and v, or what target asks for).
    at_once is the number of rows that are laid out at a time, all of a batch unless given.
    """
    width, models, own_nodes = len(cuts), len(forest.root), nodes_by_model(forest, set(open_nodes))
    named = rows.columns if view else [c for c in ("x", "a", "t", "mass", "w", *(("v",) if target is None else ("y", "f"))) if c in rows.columns]
    place = np.full(len(forest.feature) + 1, -1)  # the last is for a model without a tree
    for nodes in own_nodes:
        place[nodes] = np.arange(len(nodes))
    bins, contrast = max(map(len, cuts), default=0) + 1 if by_feature else 1, "w" in rows.columns and target is None
    features = list(range(width)) if by_feature else [-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # by model and feature: a row for each node, bin and arm, a column for each part
        dim = 0
        for b in (b.slice(at, at_once or b.num_rows) for b in batches if b.num_rows for at in range(0, b.num_rows, at_once or b.num_rows)):
            get = lambda name, b=b: matrix(b, name)
            get = view(get) if view else get
            x, arm, train, mass = (get(c) for c in ("x", "a", "t", "mass"))
            v = (get("v") if target is None else target(get)).reshape(len(x), models, -1)
            w = get("w") if contrast else None
            dim = v.shape[2]
            binned = [np.searchsorted(np.array(cuts[f]), x[:, f], side="left") if f >= 0 else 0 for f in features]
            at = place[forest.route(x)]
            for m in range(models):
                own = np.flatnonzero((train[:, m] != 0) & (at[:, m] >= 0))
                if not len(own):
                    continue
                vm, size = v[own, m], len(own_nodes[m]) * bins * 2
                parts = [mass[own, m], (vm**2).sum(1), *vm.T]
                if w is not None:
                    wm = w[own, m]
                    parts += [wm, wm * wm, *(wm[:, None] * vm).T]
                parts = np.stack(parts).T
                head, arms = at[own, m] * bins, arm[own, m].astype(np.int64)
                for f, bin_ in zip(features, binned):
                    key = (head + (bin_[own] if f >= 0 else 0)) * 2 + arms
                    new = np.concatenate([np.bincount(key, minlength=size)[:, None], row_sums(key, parts, size)], 1)
                    if (m, f) in sums:
                        sums[m, f] += new
                    else:
                        sums[m, f] = new
        for (m, f), total in sums.items():
            u = np.flatnonzero(total[:, 0])
            n, mass, ss, *rest = total[u].T
            none = np.zeros(len(u))
            w, ww = rest[dim : dim + 2] if contrast else (none, none)
            lists = [np.stack(rest[:dim], 1), np.stack(rest[dim + 2 :], 1) if contrast else np.zeros((len(u), dim))]
            keys = [np.full(len(u), m), np.array(own_nodes[m])[u // (2 * bins)], np.full(len(u), f), u // 2 % bins, u % 2]
            flat = [pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), pa.array(c.ravel())) for c in lists]
            yield pa.RecordBatch.from_arrays([*[pa.array(k.astype(np.int32)) for k in keys], pa.array(n.astype(np.int64)), *map(pa.array, (mass, ss, w, ww)), *flat], HIST_NAMES)

    return rows.select(*named).mapInArrow(run, HIST)


HIST_NAMES = [c.split()[0] for c in HIST.split(", ")]


def first_improvement(gains: np.ndarray, slack: float = 1e-15) -> int | None:
    """The index that a scan settles on which moves only for a gain above the best so far by slack."""
    best, at = -np.inf, None
    for i, g in enumerate(gains.tolist()):
        if np.isfinite(g) and g > best + slack:
            best, at = g, i
    return at


def explained(n: np.ndarray, mass: np.ndarray, w: np.ndarray, ww: np.ndarray, vec: np.ndarray, wvec: np.ndarray, solve: bool) -> np.ndarray:
    """What a leaf explains of its squares: by b alone, or (solve) by b + w d, from the sums of each side."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (vec**2).sum(-1) / mass
        if solve:
            spread = ww - w * w / n
            cross = wvec - (w / n)[..., None] * vec
            out = out + np.where(spread > 1e-12, (cross**2).sum(-1) / np.where(spread > 1e-12, spread, 1.0), 0.0)
    return out


def best_cut(pdf: pd.DataFrame, leaf: int, arm_leaf: int, solve: bool = False) -> tuple[int, float] | None:
    """The bin after which to cut one feature of one node, and its gain."""
    bins = int(pdf.bin.max()) + 1
    dim = len(pdf.vec.iloc[0])
    arms, plain, vec, wvec = np.zeros((bins, 2)), np.zeros((bins, 3)), np.zeros((bins, dim)), np.zeros((bins, dim))
    np.add.at(arms, (pdf.bin.to_numpy(), pdf.arm.to_numpy()), pdf.n.to_numpy())
    np.add.at(plain, pdf.bin.to_numpy(), pdf[["mass", "w", "ww"]].to_numpy())
    np.add.at(vec, pdf.bin.to_numpy(), np.stack(pdf.vec))
    np.add.at(wvec, pdf.bin.to_numpy(), np.stack(pdf.wvec))
    left, ln = [np.cumsum(c, 0)[:-1] for c in (plain, vec, wvec)], np.cumsum(arms, 0)[:-1]
    right, rn = [c.sum(0) - s for c, s in zip((plain, vec, wvec), left)], arms.sum(0) - ln
    fine = (ln.sum(1) >= leaf) & (rn.sum(1) >= leaf) & (np.minimum(ln, rn).min(1) >= arm_leaf) & (left[0][:, 0] > 0) & (right[0][:, 0] > 0)
    of = lambda n, s: explained(n.sum(-1), s[0][..., 0], s[0][..., 1], s[0][..., 2], s[1], s[2], solve)
    gain = of(ln, left) + of(rn, right) - of(arms.sum(0), [plain.sum(0), vec.sum(0), wvec.sum(0)])
    # a cut after an empty bin repeats the one before it
    fine &= arms.sum(1)[:-1] > 0
    at = first_improvement(np.where(fine, gain, -np.inf))
    return None if at is None else (at, float(gain[at]))


def contrast_values(n: np.ndarray, w: np.ndarray, ww: np.ndarray, vec: np.ndarray, wvec: np.ndarray, penalty: float, leaf_share: bool) -> tuple[np.ndarray, np.ndarray]:
    """b and d of the regression of v on w = arm - propensity with a ridge on d, from sums by arm; leaf_share centres arms at the leaf's own share."""
    total, g = n.sum(), vec.sum(0) / n.sum()
    if leaf_share:
        mean, spread, cross = 0.0, n[0] * n[1] / total, vec[1] - n[1] / total * vec.sum(0)
    else:
        mean = w.sum() / total
        spread, cross = ww.sum() - total * mean**2, wvec.sum(0) - mean * vec.sum(0)
    d = cross / spread * (spread / (spread + penalty)) if spread > 1e-12 else np.zeros_like(g)
    return g - mean * d, d


def leaf_values(n: np.ndarray, mass: np.ndarray, ss: np.ndarray, vec: np.ndarray, rules: Rules, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Values for both arms from their counts, masses, squares and sums."""
    if rules.rule == "r_loss":  # masses are squared residual treatments, with a ridge on their sum
        tau = vec.sum(0) / (mass.sum() + penalty)
        return tau, tau
    pooled = vec.sum(0) / max(mass.sum(), 1e-300)
    if rules.rule == "forced" or n.min() == 0:
        return pooled, pooled
    means = vec / np.maximum(mass[:, None], 1e-300)
    if rules.rule == "independent":
        return means[0], means[1]
    if rules.rule == "arm_shrinkage":
        return tuple((vec[a] + penalty * pooled) / (mass[a] + penalty) for a in (0, 1))
    gap = means[1] - means[0]
    if rules.rule == "ridge":
        effective = n[0] * n[1] / n.sum()
        factor = effective / (effective + penalty)
    else:
        square = float(gap @ gap)
        noise = sum(max(ss[a] - (vec[a] ** 2).sum() / n[a], 0.0) / (n[a] - 1) / n[a] for a in (0, 1) if n[a] > 1)
        factor = max(0.0, 1 - penalty * noise / square) if square > 0 else 0.0
    share = n[1] / n.sum()
    return pooled - share * factor * gap, pooled + (1 - share) * factor * gap


PARTS = ("n", "mass", "ss", "w", "ww")


def sides(pdf: pd.DataFrame, at: int | None) -> list[float]:
    """Sums by side of a cut after bin at (all on the lower side without one) and arm: PARTS, vec and wvec of each, one after another."""
    dim = len(pdf.vec.iloc[0])
    out = np.zeros((2, 2, len(PARTS) + 2 * dim))
    side = np.zeros(len(pdf), np.int64) if at is None else (pdf.bin.to_numpy() > at).astype(np.int64)
    np.add.at(out, (side, pdf.arm.to_numpy()), np.hstack([pdf[list(PARTS)].to_numpy(float), np.stack(pdf.vec), np.stack(pdf.wvec)]))
    return out.ravel().tolist()


def grow(rows: DataFrame, models: int, cuts: list[list[float]], rules: Rules, alive: list[int] | None = None, target: Callable | None = None, view: Callable | None = None, at_once: int | None = None) -> Forest:
    """One tree for each model (or each of alive); rows are read once for each level. target, view and at_once are as for histograms()."""
    forest = Forest(np.full(models, -1), contrast=rules.rule == "contrast")
    for m in range(models) if alive is None else alive:
        forest.root[m] = forest.add()
    open_nodes, leaf, arm_leaf, solve = list(range(len(forest.feature))), rules.leaf, rules.arm_leaf, rules.gain == "solve"
    model_of = {int(k): m for m, k in enumerate(forest.root) if k >= 0}
    sums: dict[int, np.ndarray] = {}  # by node, with a row for each arm

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        at, gain = best_cut(pdf, leaf, arm_leaf, solve) or (-1, -np.inf)
        head = pdf.iloc[0]
        return pd.DataFrame([(head.node, head.feature, at, gain, sides(pdf, at if at >= 0 else None))], columns=["node", "feature", "bin", "gain", "sides"])

    for _ in range(rules.depth):
        if not open_nodes or not cuts:
            break
        found = histograms(rows, forest, open_nodes, cuts, True, target, view, at_once).groupBy("model", "node", "feature").applyInPandas(search, "node int, feature int, bin int, gain double, sides array<double>").collect()
        best: dict[int, tuple] = {}
        for r in sorted(found, key=lambda r: (r["node"], r["feature"])):
            both = np.array(r["sides"]).reshape(2, 2, -1)
            sums.setdefault(r["node"], both.sum(0))
            if r["bin"] >= 0 and r["gain"] > best.get(r["node"], (0, 0, 1e-15))[2] + 1e-15:
                best[r["node"]] = (r["feature"], r["bin"], r["gain"], both)
        open_nodes = []
        for node, (f, b, _, both) in sorted(best.items()):
            for k, own in zip(forest.split(node, f, cuts[f][b]), both):
                model_of[k], sums[k] = model_of[node], own
                open_nodes.append(k)
    if not rules.depth or not cuts:  # roots that no level was searched for
        for r in histograms(rows, forest, open_nodes, cuts, False, target, view, at_once).groupBy("model", "node", "arm").applyInPandas(added, f"model int, node int, arm int, {SUMS}").collect():
            sums.setdefault(r["node"], np.zeros((2, len(PARTS) + 2 * len(r["vec"]))))[r["arm"]] = [*[r[c] for c in PARTS], *r["vec"], *r["wvec"]]
    for node, s in sums.items():
        if forest.feature[node] >= 0:
            continue
        n, mass, ss, w, ww = s[:, : len(PARTS)].T
        vec, wvec = np.split(s[:, len(PARTS) :], 2, 1)
        penalty = rules.penalty.get(model_of[node], rules.shared)
        forest.share[node] = float(n[1] / n.sum())
        forest.value[node] = contrast_values(n, w, ww, vec, wvec, penalty, "w" not in rows.columns) if forest.contrast else leaf_values(n, mass, ss, vec, rules, penalty)
    return forest


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one node and arm added up."""
    head = pdf.iloc[0]
    names = ["n", "mass", "ss", "w", "ww"]
    return pd.DataFrame([(head.model, head.node, head.arm, *[pdf[c].sum() for c in names], np.sum(np.stack(pdf.vec), 0), np.sum(np.stack(pdf.wvec), 0))], columns=["model", "node", "arm", *names, "vec", "wvec"])
