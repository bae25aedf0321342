"""Learners, row by row, against slow definitions in NumPy that share no code with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.functions import curves as C
from curvefx.operators import boost, laws, learners, monotone, trees

ROUND = {"rel": 1e-7, "abs": 1e-7}


def made(n=150, seed=4, k=4, shift=2.0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n)], 1).astype(float)
    a = rng.integers(0, 2, n)
    q = np.sort(rng.normal(size=(n, k)) * 0.3 + x[:, :1] / 6 + shift * a[:, None] * (x[:, 1:] > 2), 1)
    return x, a, q, np.arange(n) % 3


def frame(spark, x, a, q, fold):
    return spark.createDataFrame([(i, int(a[i]), x[i].tolist(), q[i].tolist(), int(fold[i])) for i in range(len(x))], "unit_id int, a int, x array<double>, q array<double>, fold int").repartition(4)


def slow_cuts(x):
    out = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        out.append((v[:-1] + v[1:]) / 2)
    return out


class SlowTree:
    """Exhaustive search, one node at a time; fits says what a leaf explains, value what it holds."""

    def __init__(self, x, a, v, cuts, depth, leaf, arm_leaf, fits, value):
        self.split = None
        if depth:
            best = None
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    low = x[:, f] <= c
                    sides = [low, ~low]
                    if any(s.sum() < leaf or min((a[s] == 0).sum(), (a[s] == 1).sum()) < arm_leaf for s in sides):
                        continue
                    gain = sum(fits(s) for s in sides) - fits(np.ones(len(x), bool))
                    if np.isfinite(gain) and gain > (best[0] if best else 1e-15) + 1e-15:
                        best = gain, f, c, low
            if best:
                _, f, c, low = best
                self.split = f, c
                part = lambda s: SlowTree(x[s], a[s], None, cuts, depth - 1, leaf, arm_leaf, lambda m, s=s: fits(expand(s, m)), lambda m, s=s: value(expand(s, m)))
                self.kids = part(low), part(~low)
        self.value = value(np.ones(len(x), bool))

    def at(self, row):
        t = self
        while t.split:
            t = t.kids[int(row[t.split[0]] > t.split[1])]
        return t.value


def expand(outer, inner):
    out = outer.copy()
    out[np.flatnonzero(outer)] = inner
    return out


def slow_tree(x, a, v, cuts, depth=2, leaf=10, arm_leaf=0, mass=None, penalty=0.0, w=None, solve=False):
    mass = np.ones(len(x)) if mass is None else mass

    def fits(m):
        out = (v[m].sum(0) ** 2).sum() / mass[m].sum() if mass[m].sum() > 0 else np.nan
        if solve:
            c = w[m] - w[m].mean()
            out += ((c[:, None] * v[m]).sum(0) ** 2).sum() / (c**2).sum() if (c**2).sum() > 1e-12 else 0.0
        return out

    def value(m):
        if w is None:
            return v[m].sum(0) / (mass[m].sum() + penalty)
        c = w[m] - w[m].mean()
        d = (c[:, None] * v[m]).sum(0) / ((c**2).sum() + penalty) if (c**2).sum() > 1e-12 else 0 * v[0]
        return v[m].mean(0) - w[m].mean() * d, d

    return SlowTree(x, a, v, cuts, depth, leaf, arm_leaf, fits, value)


def slow_boost(x, y, train, cuts, steps, rate=0.3):
    f = np.repeat(y[train].mean(0)[None], len(x), 0)
    for _ in range(steps):
        t = slow_tree(x[train], np.zeros(train.sum(), int), (y - f)[train], cuts)
        f = f + rate * np.array([t.at(r) for r in x])
    return f


def slow_effects(x, a, y, w, train, cuts, steps, penalty, rate=0.3):
    f = np.zeros_like(y)
    for _ in range(steps):
        t = slow_tree(x[train], a[train], (w[:, None] * (y - w[:, None] * f))[train], cuts, arm_leaf=2, mass=w[train] ** 2, penalty=penalty)
        f = f + rate * np.array([t.at(r) for r in x])
    return f


@pytest.mark.parametrize("solve", [False, True])
@pytest.mark.parametrize("shared", [False, True])
def test_contrast_leaves_equal_an_exhaustive_search(spark, solve, shared):
    x, a, q, _ = made(seed=8)
    e = np.clip(0.3 + 0.05 * x[:, 1], 0, 1)
    w = a - e
    d = frame(spark, x, a, q, a).select(F.array("a").alias("a"), "x", F.array(F.lit(1)).alias("t"), F.array(F.lit(1.0)).alias("mass"), F.col("q").alias("v"), F.array(F.col("a") - (0.3 + 0.05 * F.get("x", F.lit(1)))).alias("w"))
    if shared:  # leaf shares as the propensity: no w column; then b is the pooled mean
        if solve:
            return
        d = d.drop("w")
    cuts = slow_cuts(x)
    forest = trees.grow(d, 1, [c.tolist() for c in cuts], trees.Rules(depth=2, leaf=12, arm_leaf=3, rule="contrast", shared=7.0, gain="solve" if solve else "pooled"))
    slow = slow_tree(x, a, q, cuts, leaf=12, arm_leaf=3, penalty=7.0, w=w, solve=solve)
    arm, other = a[:, None].astype(np.int64), 1 - a[:, None].astype(np.int64)
    if not shared:
        for arms in (arm, other):
            want = [b + (k - p) * c for (b, c), k, p in zip([slow.at(r) for r in x], arms[:, 0], e)]
            assert forest.predict(x, arms, e[:, None])[:, 0] == pytest.approx(np.array(want), **ROUND)
    else:
        leaf = forest.route(x)[:, 0]
        for k in np.unique(leaf):
            own = leaf == k
            share, c = a[own].mean(), a[own] - a[own].mean()
            slope = (c[:, None] * q[own]).sum(0) / ((c**2).sum() + 7.0)
            assert forest.predict(x[own], arm[own])[:, 0] == pytest.approx(q[own].mean(0) + c[:, None] * slope, **ROUND) and abs(share - forest.share[k]) < 1e-12


def test_boosted_means_nuisances_and_new_rows(spark):
    x, a, q, fold = made()
    y, cuts = q[:, :2], slow_cuts(x)
    u = frame(spark, x, a, q, fold).withColumn("y", F.slice("q", 1, 2))
    target = np.concatenate([a[:, None].astype(float), y], 1)
    by_fold = [slow_boost(x, target, fold != f, cuts, 3) for f in range(3)]
    want = np.array([by_fold[fold[i]][i] for i in range(len(x))])
    got = {r["unit_id"]: [r["e"], *r["m"]] for r in learners.nuisances(u, 3, 3).collect()}
    want[:, 0] = np.clip(want[:, 0], 0.02, 0.98)
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(want, **ROUND)
    fresh = spark.createDataFrame([(1000 + i, x[i].tolist()) for i in range(20)], "unit_id int, x array<double>")
    got = {r["unit_id"]: [r["e"], *r["m"]] for r in learners.nuisances(u, 3, 3, fresh).collect()}
    mean = np.mean(by_fold, 0)
    mean[:, 0] = np.clip(mean[:, 0], 0.02, 0.98)
    assert len(got) == len(x) + 20 and np.array([got[1000 + i] for i in range(20)]) == pytest.approx(mean[:20], **ROUND) and np.array([got[i] for i in range(len(x))]) == pytest.approx(want, **ROUND)
    half = learners.nuisances(u, 3, 3, given={"e": lambda x: F.get(x, F.lit(1)) / 10}).collect()  # a nuisance as a function of x
    assert all(r["e"] == pytest.approx(np.clip(x[r["unit_id"], 1] / 10, 0.02, 0.98)) and r["m"] == pytest.approx(want[r["unit_id"], 1:], **ROUND) for r in half)


@pytest.mark.parametrize("per_column", [False, True])
def test_r_learner(spark, per_column):
    x, a, q, fold = made()
    y, cuts, penalties = q[:, [0, 3]], slow_cuts(x), [1.0, 40.0]
    u = frame(spark, x, a, q, fold).withColumn("y", F.array(F.get("q", F.lit(0)), F.get("q", F.lit(3))))
    by_fold = [slow_boost(x, np.concatenate([a[:, None].astype(float), y], 1), fold != f, cuts, 2) for f in range(3)]
    out = np.array([by_fold[fold[i]][i] for i in range(len(x))])
    e, m = np.clip(out[:, 0], 0.02, 0.98), out[:, 1:]
    w, rest = a - e, y - m
    taus = [np.zeros_like(y), np.zeros_like(y)]
    for i, p in enumerate(penalties):
        for f in range(3):
            taus[i][fold == f] = slow_effects(x, a, rest, w, fold != f, cuts, 2, p)[fold == f]
    loss = np.array([((rest - w[:, None] * t) ** 2).mean(0) for t in taus])
    best = [min((0, 1), key=lambda i: (loss[i, k], -penalties[i])) for k in (0, 1)] if per_column else [min((0, 1), key=lambda i: (loss[i].sum(), -penalties[i]))] * 2
    chosen, t = learners.r_learner(u, penalties, 3, 2, per_column=per_column)
    assert chosen == ([penalties[i] for i in best] if per_column else penalties[best[0]])
    rows = {r["unit_id"]: r for r in t.collect()}
    tau = np.stack([taus[best[k]][:, k] for k in (0, 1)], 1)
    each = lambda name: np.array([rows[i][name] for i in range(len(x))])
    assert each("tau") == pytest.approx(tau, **ROUND)
    assert each("mu0") == pytest.approx(m - e[:, None] * tau, **ROUND) and each("mu1") == pytest.approx(m + (1 - e[:, None]) * tau, **ROUND)


def test_x_learner(spark):
    x, a, q, fold = made()
    y, cuts = q[:, :1], slow_cuts(x)
    u = frame(spark, x, a, q, fold).withColumn("y", F.slice("q", 1, 1))

    def by_arm(y):
        out = np.zeros((2, *y.shape))
        for arm in (0, 1):
            for f in range(3):
                out[arm][fold == f] = slow_boost(x, y, (fold != f) & (a == arm), cuts, 2)[fold == f]
        return out

    mu = by_arm(y)
    effect = np.where(a[:, None] == 1, y - mu[0], mu[1] - y)
    tau = by_arm(effect)
    e = np.zeros(len(x))
    for f in range(3):
        e[fold == f] = slow_boost(x, np.concatenate([a[:, None].astype(float), y], 1), fold != f, cuts, 2)[fold == f, 0]
    e = np.clip(e, 0.02, 0.98)[:, None]
    got = {r["unit_id"]: r["tau"] for r in learners.x_learner(u, 3, 2).collect()}
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(e * tau[0] + (1 - e) * tau[1], **ROUND)


def slow_particles(x, a, q, train, cuts, particles, steps, rate, halvings, leaf, arm_leaf, penalty, eps=1e-3):
    """One booster with ridge leaves, a row at a time."""
    k = q.shape[1]
    order = np.lexsort((np.flatnonzero(train), q[train].sum(1)))
    start = q[train][order][[int((i + 0.5) * train.sum() / particles) for i in range(particles)]]
    p = np.repeat(start[None], len(x), 0)

    def score(p, y):
        att = np.sqrt(((p - y) ** 2).mean(1) + eps**2) - eps
        return att.mean() - 0.5 * (np.sqrt(((p[:, None] - p) ** 2).mean(2) + eps**2) - eps).mean()

    def pull(p, y):
        out = np.zeros_like(p)
        for i in range(len(p)):
            d = p[i] - y
            out[i] -= d / np.sqrt((d**2).mean() + eps**2)
            for j in range(len(p)):
                d = p[i] - p[j]
                out[i] += d / np.sqrt((d**2).mean() + eps**2) / len(p)
        return out.ravel()

    def iso(row):
        s = np.concatenate([[0], np.cumsum(row)])
        return np.array([max(min((s[j + 1] - s[i]) / (j + 1 - i) for j in range(c, k)) for i in range(c + 1)) for c in range(k)])

    for _ in range(steps):
        g = np.array([pull(p[i], q[i]) for i in np.flatnonzero(train)])
        xt, at = x[train], a[train]
        tree = SlowTree(xt, at, None, cuts, 2, leaf, arm_leaf, lambda m: (g[m].sum(0) ** 2).sum() / m.sum(), lambda m: ridge(g[m], at[m], penalty))
        change = np.array([tree.at(x[i])[a[i]] for i in range(len(x))]).reshape(p.shape)
        before = np.mean([score(p[i], q[i]) for i in np.flatnonzero(train)])
        for h in range(halvings):
            new = p + rate / 2**h * change
            new = np.array([[r if (np.diff(r) >= 0).all() else iso(r) for r in u] for u in new])
            if np.mean([score(new[i], q[i]) for i in np.flatnonzero(train)]) <= before + 1e-12:
                p = new
                break
        else:
            break
    return p


def ridge(g, a, penalty):
    pooled = g.mean(0)
    if min((a == 0).sum(), (a == 1).sum()) == 0:
        return pooled, pooled
    gap, share = g[a == 1].mean(0) - g[a == 0].mean(0), a.mean()
    n = len(a) * share * (1 - share)
    return pooled - share * n / (n + penalty) * gap, pooled + (1 - share) * n / (n + penalty) * gap


def test_booster_of_several_models_equals_slow_ones_row_by_row(spark):
    """Folds and penalties in lock step give what each model gives alone; laws come back from node tables."""
    x, a, q, fold = made(n=90)
    u = frame(spark, x, a, q, fold)
    rows = learners.with_models(u, 3, 2)
    penalty = {i * 3 + f: p for i, p in enumerate((0.0, 20.0)) for f in range(3)}
    book, state = boost.fit(rows, particles=3, steps=2, halvings=3, rules=trees.Rules(leaf=8, arm_leaf=2, penalty=penalty))
    got = {r["unit_id"]: np.array(r["p"]).reshape(6, 3, 4) for r in state.collect()}
    cuts = slow_cuts(x)
    for m in (0, 2, 4):
        want = slow_particles(x, a, q, fold != m % 3, cuts, 3, 2, 0.5, 3, 8, 2, penalty[m])
        assert np.array([got[i][m] for i in range(90)]) == pytest.approx(want, rel=1e-6, abs=1e-6)
    again = boost.Booster.of_table(book.table(spark).repartition(3))
    ask = rows.select("unit_id", "x", "a")
    for b in (book, again):
        p = {r["unit_id"]: np.array(r["p"]).reshape(6, 3, 4) for r in boost.predict(b, ask).collect()}
        for i in range(90):
            for m in range(6):
                want = got[i][m][np.lexsort(got[i][m].T[::-1])]
                assert p[i][m] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_cross_fitted_laws_pick_the_least_held_out_risk(spark):
    x, a, q, fold = made(n=90)
    chosen, risks, state, book = learners.cross_fitted_laws(frame(spark, x, a, q, fold), [0.0, 20.0], 3, particles=3, steps=2, halvings=3, rules=trees.Rules(leaf=8, arm_leaf=2))
    table = {r["penalty"]: r["risk"] for r in risks.collect()}
    cuts, want = slow_cuts(x), {}
    for p in (0.0, 20.0):
        each = []
        for f in range(3):
            law = slow_particles(x, a, q, fold != f, cuts, 3, 2, 0.5, 3, 8, 2, p)
            each.append(boost.scores(law[fold == f], q[fold == f], 1e-3).mean())
        want[p] = np.mean(each)
    assert table == pytest.approx(want, rel=1e-6) and chosen == [min(want, key=lambda p: (want[p], -p))]
    mu = {r["unit_id"]: r for r in learners.arm_means(state, book, {"mean": C.curve_mean}).collect()}
    assert len(mu) == 90 and book.start.shape[0] == 3
    own = {r["unit_id"]: np.array(r["p"]).reshape(3, 3, 4) for r in state.collect()}
    for i in range(90):
        assert mu[i][f"mu{a[i]}_mean"] == pytest.approx(own[i][fold[i]].mean(), rel=1e-9)


def test_runs_share_one_fit_and_deal_placebos(spark):
    """Seeds and a placebo as models: rows don't grow, arms keep their counts, and a run alone gives the same numbers."""
    x, a, q, _ = made(n=90)
    u = frame(spark, x, a, q, a).drop("fold")
    runs = learners.in_runs(u.select("unit_id", "a"), [1, 2], [5])
    rows = {r["unit_id"]: r for r in runs.collect()}
    arms, folds = np.array([rows[i]["a"] for i in range(90)]), np.array([rows[i]["fold"] for i in range(90)])
    assert (arms[:, 0] == a).all() and (arms[:, 1] == a).all() and arms[:, 2].sum() == a.sum() and (arms[:, 2] != a).any()
    for g in range(3):
        for k in (0, 1):
            n = np.bincount(folds[arms[:, g] == k, g], minlength=3)
            assert n.max() - n.min() <= 1
    assert (folds[:, 0] != folds[:, 1]).any()
    hs, settings = {"mean": C.curve_mean}, {"particles": 3, "steps": 2, "halvings": 3, "rules": trees.Rules(leaf=8, arm_leaf=2)}
    many = u.drop("a").join(runs, "unit_id")
    chosen, s = learners.calibrated_runs(many, [0.0, 20.0], hs, propensity_steps=2, **settings)
    got = {(r["run"], r["unit_id"]): r["psi_mean"] for r in s.collect()}
    assert len(got) == 270
    last = many.withColumns({"a": F.slice("a", 3, 1), "fold": F.slice("fold", 3, 1)})
    alone, s = learners.calibrated_runs(last, [0.0, 20.0], hs, propensity_steps=2, **settings)
    assert alone == chosen[2:] and {r["unit_id"]: r["psi_mean"] for r in s.collect()} == pytest.approx({i: got[2, i] for i in range(90)}, rel=1e-6)
    effect = [np.mean([got[g, i] for i in range(90)]) for g in range(3)]
    assert min(effect[:2]) > 0.4 and abs(effect[2]) < 0.3


def test_two_part_laws(spark):
    x, a, q, fold = made(n=120)
    zero = x[:, 1] == 0
    u = frame(spark, x, a, q, fold).withColumn("zero", F.get("x", F.lit(1)) == 0)
    law = learners.two_part_laws(u, "zero", particles=3, steps=2, halvings=3, rules=trees.Rules(leaf=8, arm_leaf=2, shared=5.0))
    assert all(r["ok"] for r in laws.law_check(law).collect()) and law.select("unit_id", "arm").distinct().count() == 240
    p = {(r["unit_id"], r["arm"]): r["zero"] for r in laws.zero_mass(law, 0.0).collect()}
    rates = {(r["unit_id"], r["arm"]): r["p"] for r in learners.zero_rates(u, "zero", 8, 3).collect()}
    assert all(abs(p[k] - np.clip(rates[k], 1e-9, 1 - 1e-9)) < 1e-9 for k in p)
    assert np.mean([p[i, 0] for i in range(120) if zero[i]]) > np.mean([p[i, 0] for i in range(120) if not zero[i]]) + 0.2
    keep, cuts = ~zero, slow_cuts(x)
    want = slow_particles(x, a, q, keep & (fold != 1), cuts, 3, 2, 0.5, 3, 8, 2, 5.0)
    atoms = {}
    for r in law.where("atom_id > 0").collect():
        atoms.setdefault((r["unit_id"], r["arm"]), []).append(r["q"])
    for i in np.flatnonzero(fold == 1)[:20].tolist():
        assert np.array(sorted(atoms[i, a[i]])) == pytest.approx(np.array(sorted(want[i].tolist())), rel=1e-6, abs=1e-6)
    few = u.withColumn("zero", F.col("unit_id") >= 5)
    small = learners.two_part_laws(few, "zero", particles=3, steps=1)
    assert small.where("atom_id > 0").select("q").distinct().count() == 1 and all(r["ok"] for r in laws.law_check(small).collect())


def test_propensity_factories(spark):
    """Names and a callable; each unit is scored out of fold, and one-armed parts give their rate."""
    from pyspark.ml.classification import LogisticRegression

    x, a, q, fold = made(n=120)
    u = frame(spark, x, a, q, fold)
    asked = []

    def factory(seed):
        asked.append(seed)
        return LogisticRegression(labelCol="a", regParam=1.0 / 80, standardization=False)

    got = {r["unit_id"]: r["e"] for r in learners.propensities(u, factory, seed=9).collect()}
    assert asked == [9, 9, 9] and len(got) == 120
    named = {r["unit_id"]: r["e"] for r in learners.propensities(u, "logistic").collect()}
    assert got == pytest.approx(named, abs=1e-6)
    for f in range(3):  # the penalised likelihood's gradient is zero
        tr = fold != f
        z = np.concatenate([x[tr], np.ones((tr.sum(), 1))], 1)
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ b))
            pen = np.array([1, 1, 0]) / tr.sum()
            b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / tr.sum() + np.diag(pen), z.T @ (p - a[tr]) / tr.sum() + pen * b)
        own = np.flatnonzero(fold == f)
        want = np.clip(1 / (1 + np.exp(-(x[own] @ b[:2] + b[2]))), 0.02, 0.98)
        assert np.array([named[i] for i in own]) == pytest.approx(want, abs=1e-4)
    assert {r["e"] for r in learners.propensities(u.withColumn("a", F.lit(1)), "forest").collect()} == {0.98}


def test_stack_pooling_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    q, w = rng.normal(size=(60, 9)).round(1), rng.random(9) + 0.1

    def closed(row, w):
        s, m = np.concatenate([[0], np.cumsum(row * w)]), np.concatenate([[0], np.cumsum(w)])
        return [max(min((s[j + 1] - s[i]) / (m[j + 1] - m[i]) for j in range(c, len(row))) for i in range(c + 1)) for c in range(len(row))]

    assert monotone.pooled(q) == pytest.approx(np.array([closed(r, np.ones(9)) for r in q]), **ROUND)
    assert monotone.pooled(q, w) == pytest.approx(np.array([closed(r, w) for r in q]), **ROUND)
    long = np.concatenate([np.cumsum(rng.normal(size=(8, 500)), 1), np.arange(500.0, 0, -1)[None], np.arange(500.0)[None]])
    rows = [(i, r.tolist()) for i, r in enumerate(long)] + [(10, None)]
    got = {r["i"]: r["q"] for r in monotone.projected(spark.createDataFrame(rows, "i int, q array<double>").repartition(3), "q").collect()}
    assert got[10] is None and got[9] == long[9].tolist() and got[8] == pytest.approx([250.5] * 500)
    for i in range(8):
        assert got[i] == pytest.approx(closed(long[i], np.ones(500)), **ROUND)
    assert monotone.projected(spark.createDataFrame([], "q array<double>"), "q").count() == 0


def test_row_sums_and_steps_are_the_plain_ones():
    """Sums of groups are to the last bit those of np.add.at, and one prediction serves all step sizes."""
    rng = np.random.default_rng(3)
    group, values = rng.integers(0, 7, 500), rng.normal(size=(500, 6)) * 1e5
    want = np.zeros((8, 6))
    np.add.at(want, group, values)
    assert (trees.row_sums(group, values, 8) == want).all()
    p, change, sizes = np.sort(rng.normal(size=(9, 3, 2, 4))), rng.normal(size=(9, 3, 2, 4)), np.array([0.5, 0.0, 0.25])
    got = boost.stepped(p, change, sizes)
    assert (got[:, 1] == p[:, 1]).all() and (np.diff(got) >= -1e-12).all()
    for m in (0, 2):
        assert np.allclose(got[:, m], boost.project((p[:, m] + sizes[m] * change[:, m]).reshape(-1, 4)).reshape(9, 2, 4))
