"""Cross-fitted learners over unit tables: curve laws, mean regressors, R- and X-learners, two-part laws, propensities.

All models of a learner train in lock step: a unit is one row, with arrays over models (boost.py, trees.py).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import boost, laws, prep, trees
from .boost import Booster
from .effects import aipw, clipped
from .ordered import stored
from .trees import Rules

ship(__name__)


def in_runs(units: DataFrame, seeds: list[int], placebos: list[int] = [], folds: int = 3, arm: str = "a", key: str = "unit_id") -> DataFrame:  # noqa: B006
    """key, a and fold ARRAYS: an entry for each seed, with the real arms, then for each placebo, with arms dealt anew.

    A placebo's arms are those of all units in the order of seeded hashes, so their counts stay. Folds go round within a
    run's arms in the order of another seeded hash. All runs are ranked together, so the jobs don't grow with their number.
    """
    runs = [(s, False) for s in seeds] + [(s, True) for s in placebos]
    own = stored(units.select(F.col(key).alias("_key"), F.col(arm).cast("int").alias("_a")))
    natural = prep.rank_in_group(own.withColumn("_g", F.lit(0)), "_g", [F.col("_key")], "_r").select("_r", F.col("_a").alias("_dealt"))
    table = F.array(*[F.struct(F.lit(i).alias("_run"), F.lit(s).alias("_seed"), F.lit(p).alias("_placebo")) for i, (s, p) in enumerate(runs)])
    many = own.select("_key", "_a", F.inline(table))
    hashed = lambda text: F.md5(F.concat(F.lit(text), F.col("_seed"), F.lit(":"), F.col("_key").cast("string")))
    dealt = prep.rank_in_group(many.where("_placebo").withColumn("_h", hashed("arm:")), "_run", [F.col("_h"), F.col("_key")], "_r").join(natural, "_r")
    both = many.where("NOT _placebo").select("_key", "_run", "_seed", "_a").unionByName(dealt.select("_key", "_run", "_seed", F.col("_dealt").alias("_a")))
    both = both.withColumn("_cell", F.col("_run") * 2 + F.col("_a")).withColumn("_h", hashed("fold:"))
    ranked = prep.folds_by_rank(both, "_cell", [F.col("_h"), F.col("_key")], folds)
    entries = F.array_sort(F.collect_list(F.struct("_run", F.col("_a").alias("a"), "fold")))
    lists = ranked.groupBy(F.col("_key").alias(key)).agg(entries.alias("_e"))
    return lists.select(key, F.transform("_e", lambda e: e["a"]).alias("a"), F.transform("_e", lambda e: e["fold"]).alias("fold"))


def as_array(df: DataFrame, name: str, kind: str = "int") -> Column:
    """An array column, or a single run's value as an array of one."""
    return F.col(name) if df.schema[name].dataType.typeName() == "array" else F.array(F.col(name).cast(kind))


def with_models(units: DataFrame, folds: int, variants: int) -> DataFrame:
    """units with arrays a, t and, if it is there, e over models (run * variants + variant) * folds + held-out fold; t is 1 where the unit's fold isn't held out.

    a, fold and e may be arrays over runs, or a single run's values.
    """
    each = folds * variants
    if "e" in units.columns:
        units = units.withColumn("e", F.flatten(F.transform(as_array(units, "e", "double"), lambda e: F.array_repeat(e, each))))
    arms = F.flatten(F.transform(as_array(units, "a"), lambda a: F.array_repeat(a, each)))
    train = F.flatten(F.transform(as_array(units, "fold"), lambda f: F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda m: (m % folds != f).cast("int"))))
    return units.withColumns({"t": train, "a": arms})


def cross_fitted_laws(units: DataFrame, penalties: list[float], folds: int = 3, **settings) -> tuple[list[float], DataFrame, DataFrame, Booster]:
    """For each run the penalty with the least held-out risk (the stronger at a tie); run, penalty, risk; units with p, and the winners' booster.

    units: unit_id, a, x, q, fold and optionally e (as arrays over runs, or single values). All runs, penalties and folds
    train in lock step. The booster has models run * folds + fold, and p their laws of every unit's own arm, in or out of fold.
    """
    runs = len(units.select(as_array(units, "a").alias("a")).first()["a"])
    variants = len(penalties)
    rows = with_models(units.withColumn("_own", F.struct(*[F.col(f"`{c}`") for c in units.columns])), folds, variants)
    rules = settings.pop("rules", Rules())
    by_model = {(g * variants + i) * folds + f: p for g in range(runs) for i, p in enumerate(penalties) for f in range(folds)}
    rules = Rules(rules.depth, rules.leaf, rules.arm_leaf, rules.rule, by_model, rules.shared, rules.gain)
    book, _ = boost.fit(rows, rules=rules, **settings)
    risk = boost.held_out_risk(book, rows).reshape(runs, variants, folds).mean(2)
    best = [min(range(variants), key=lambda i, g=g: (risk[g, i], -penalties[i])) for g in range(runs)]
    table = units.sparkSession.createDataFrame([(g, float(penalties[i]), float(risk[g, i])) for g in range(runs) for i in range(variants)], "run int, penalty double, risk double")
    kept = [(g * variants + best[g]) * folds + f for g in range(runs) for f in range(folds)]
    own = lambda c: F.array(*[F.get(c, F.lit(m)) for m in kept]).alias(c)
    state = boost.followed(book.only(kept), rows.select("_own", "x", *[own(c) for c in ("a", "e") if c in rows.columns]))
    return [penalties[i] for i in best], table, state.select(*[F.col(f"_own.`{c}`") for c in units.columns if c != "p"], "p"), book.only(kept)


def arm_means(units: DataFrame, book: Booster, functionals: dict[str, Callable[[Column], Column]], folds: int = 3) -> DataFrame:
    """unit_id, run, a, fold and mu0_h, mu1_h: each functional's mean under the out-of-fold laws of both arms, a row for each run.

    book has models run * folds + fold, as cross_fitted_laws() gives it.
    """
    models, _, k = book.start.shape
    rows = with_models(units.withColumns({"_arms": as_array(units, "a"), "_folds": as_array(units, "fold")}), folds, 1)
    named = ["unit_id", "x", "a", "_arms", "_folds", *(["e"] if "e" in units.columns else [])]
    both = boost.predict(book, boost.predict(book, rows.select(*named), 0).withColumnRenamed("p", "p0"), 1).withColumnRenamed("p", "p1")
    mean_of = lambda h: lambda own: F.aggregate(F.transform(boost.atoms_of(own, k), lambda q: h(q)), F.lit(0.0), lambda s, v: s + v) * k / F.size(own)
    own_fold = lambda p: lambda f, g: boost.law_of(g * folds + f, models, p)
    out = [F.transform(F.transform("_folds", own_fold(f"p{arm}")), mean_of(h)).alias(f"mu{arm}_{n}") for arm in (0, 1) for n, h in functionals.items()]
    zipped = both.select("unit_id", F.col("_arms").alias("a"), F.col("_folds").alias("fold"), *out)
    cols = [c for c in zipped.columns if c != "unit_id"]
    return zipped.select("unit_id", F.posexplode(F.arrays_zip(*cols)).alias("run", "z")).select("unit_id", "run", *[F.col(f"z.{c}").alias(c) for c in cols])


def calibrated_runs(units: DataFrame, penalties: list[float], functionals: dict[str, Callable[[Column], Column]], folds: int = 3, propensity_steps: int = 5, **settings) -> tuple[list[float], DataFrame]:
    """Penalties by run, and unit_id, run, a, e and psi_h: doubly robust scores of every run from its own laws and propensities.

    units: unit_id, x, q, and a and fold as arrays over runs (in_runs). One fit of laws and one of propensities serve all runs.
    """
    chosen, _, _, book = cross_fitted_laws(units, penalties, folds, **settings)
    mu = arm_means(units, book, functionals, folds)
    rows = with_models(units.select("unit_id", "x", "a", "fold"), folds, 1)
    fitted = boost_mean(rows.select("unit_id", "x", "t", "fold", F.transform("a", lambda a: a.cast("double")).alias("y")), propensity_steps)
    e = fitted.select("unit_id", F.posexplode(F.transform("fold", lambda f, g: F.get("f", g * folds + f))).alias("run", "e"))
    values = units.select("unit_id", *[h(F.col("q")).alias(f"h_{n}") for n, h in functionals.items()])
    j = mu.join(e, ["unit_id", "run"]).join(values, "unit_id").withColumn("e", clipped(F.col("e")))
    psi = [aipw(F.col(f"h_{n}"), F.col("a"), F.col("e"), F.col(f"mu0_{n}"), F.col(f"mu1_{n}")).alias(f"psi_{n}") for n in functionals]
    return chosen, j.select("unit_id", "run", "a", "e", *psi)


#: Rows that boosted means, whose rows are short, hold as matrices at a time.
ROWS = 8192


def boost_mean(rows: DataFrame, steps: int = 10, rate: float = 0.3, rules: Rules = Rules(depth=2, leaf=10, arm_leaf=0, rule="forced"), folds: int | None = None, variants: int = 1, cuts: list[list[float]] | None = None) -> DataFrame:
    """rows (unit_id, x, t, y; optionally a and w; arrays over models) with f: boosted means, or effects where w = a - e is given.

    y and f have a model's columns after another's. With w the loss is (y - w f)^2, whose leaves are sum(w r) / sum(w^2);
    without, every model starts from the mean of the rows that it trains on. With folds, rows hold fold in place of t, and
    one y (and number a and w) that all models share: model variant * folds + held-out fold trains on the other folds from 0
    up, so rows don't grow with models but for f. cuts are those of trees.cut_points() if they are known.
    """
    first = rows.select("x", "y", *([] if folds else ["t"])).first()
    models, weighted = folds * variants if folds else len(first["t"]), "w" in rows.columns
    columns = len(first["y"]) // (1 if folds else models)
    cuts = trees.cut_points(rows, len(first["x"])) if cuts is None else cuts

    def view(get):
        def own(name):
            if name == "mass":
                return own("w") ** 2 if weighted else np.ones((len(get("x")), models))
            if name == "a" and not weighted:
                return np.zeros((len(get("x")), models), np.int64)
            if not folds or name in ("x", "f"):
                return get(name)
            if name == "t":
                return ((np.arange(models) % folds != get("fold")) & (get("fold") >= 0)).astype(np.int64)
            return np.tile(get(name), (1, models))

        return own

    if weighted:
        start = np.zeros(models * columns)
    else:

        def at(get):
            y, t = view(get)("y").reshape(-1, models, columns), view(get)("t")
            return np.concatenate([(y * t[:, :, None]).sum(0), t.sum(0)[:, None]], 1)

        s = boost.summed(rows.select("x", "y", "fold" if folds else "t"), at)
        start = (s[:, :-1] / np.maximum(s[:, -1:], 1)).ravel()
    state = stored(boost.mapped(rows, lambda get: np.repeat(start[None, :], len(get("x")), 0), "f", ROWS))

    def target(get):
        y, f = (get(c).reshape(-1, models, columns) for c in "yf")
        w = get("w")[:, :, None] if weighted else 1.0
        return w * (y - w * f)

    named = ["x", "y", "f", "fold" if folds else "t", *(["a", "w"] if weighted else [])]
    for _ in range(steps):
        forest = trees.grow(state.select(*named), models, cuts, rules, target=target, view=view)
        move = lambda get, forest=forest: get("f") + rate * forest.predict(get("x"), np.zeros((len(get("x")), models), np.int64)).reshape(len(get("x")), -1)
        state = stored(boost.mapped(state, move, "f", ROWS))
    return state


def of_model(model: Column, models: int, column: str = "f") -> Column:
    """One model's entries of an array over models."""
    return boost.law_of(model, models, column)


def average(models: int, column: str = "f") -> Column:
    """The average over models of an array with several entries for each."""
    size = (F.size(column) / models).cast("int")
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(models - 1)), lambda m: F.get(column, m * size + i)), F.lit(0.0), lambda s, v: s + v) / models)


def with_nuisances(units: DataFrame, folds: int, steps: int, new: DataFrame | None = None, given: dict | None = None, cuts: list[list[float]] | None = None) -> DataFrame:
    """unit_id, a, x, fold and y of units (and of new, where a and y are fillers), with e and m as nuisances() has them, without a join."""
    given = {k: v(F.col("x")) if callable(v) and not isinstance(v, Column) else v for k, v in (given or {}).items()}
    asked = units if new is None else units.unionByName(new.withColumn("fold", F.lit(-1)), allowMissingColumns=True)
    if set(given) == {"e", "m"}:
        return asked.select("unit_id", "a", "x", "fold", "y", clipped(given["e"]).alias("e"), given["m"].alias("m"))
    width = len(units.select("y").first()["y"]) + 1
    target = F.when(F.col("a").isNotNull(), F.concat(F.array(F.col("a").cast("double")), "y")).otherwise(F.array_repeat(F.lit(0.0), width))
    rows = asked.select("unit_id", F.coalesce("a", F.lit(0)).alias("a"), "x", "fold", target.alias("y"), *[v.alias(f"_{k}") for k, v in given.items()])
    state = boost_mean(rows, steps, folds=folds, cuts=cuts)
    f = F.when(F.col("fold") >= 0, of_model(F.col("fold"), folds)).otherwise(average(folds))
    rest = lambda c: F.slice(c, 2, width - 1)
    e, m = [F.col(f"_{k}") if k in given else own for k, own in (("e", F.get("f", F.lit(0))), ("m", rest("f")))]
    return state.withColumn("f", f).select("unit_id", "a", "x", "fold", rest("y").alias("y"), clipped(e).alias("e"), m.alias("m"))


def nuisances(units: DataFrame, folds: int = 3, steps: int = 10, new: DataFrame | None = None, given: dict[str, Callable[[Column], Column] | Column] | None = None) -> DataFrame:
    """unit_id with out-of-fold e and m ARRAY, each row scored once by models that didn't see its fold.

    Rows of new (unit_id, x) are scored by the average of the fold models. given may hold e or m (m an array) as
    columns of units or as functions of x; what is given isn't fitted.
    """
    return with_nuisances(units, folds, steps, new, given).select("unit_id", "e", "m")


def r_learner(units: DataFrame, penalties: list[float], folds: int = 3, steps: int = 10, per_column: bool = False, given: dict | None = None) -> tuple[float | list[float], DataFrame]:
    """The chosen mass penalty, and unit_id with out-of-fold tau, mu0 = m - e tau and mu1 = m + (1 - e) tau (arrays).

    The penalty has the least held-out loss summed over columns, the stronger one at a tie; with per_column each column
    of y has its own, and a list is returned. given is as for nuisances. Units keep what they need from step to step, so
    nothing is joined back, and the cuts of x are found once.
    """
    first = units.select("x", "y").first()
    columns, variants, cuts = range(len(first["y"])), len(penalties), trees.cut_points(units, len(first["x"]))
    n = with_nuisances(units, folds, steps, given=given, cuts=cuts)
    rows = n.select("unit_id", "a", "x", "fold", "e", "m", F.zip_with("y", "m", lambda y, m: y - m).alias("y"), (F.col("a") - F.col("e")).alias("w"))
    rules = Rules(2, 10, 2, "r_loss", {i * folds + f: p for i, p in enumerate(penalties) for f in range(folds)})
    state = boost_mean(rows, steps, rules=rules, folds=folds, variants=variants, cuts=cuts)
    fitted = lambda i, k: F.get("f", (F.col("fold") + i * folds) * len(columns) + k)
    lost = lambda i, k: F.get("y", F.lit(k)) - F.col("w") * fitted(i, k)
    risk = state.agg(*[F.avg(lost(i, k) * lost(i, k)).alias(f"{i}_{k}") for i in range(variants) for k in columns]).first()
    choose = lambda ks: min(range(variants), key=lambda i: (sum(risk[f"{i}_{k}"] for k in ks), -penalties[i]))
    best = [choose([k]) if per_column else choose(columns) for k in columns]
    own = state.select("unit_id", "e", "m", F.array(*[fitted(i, k) for k, i in zip(columns, best)]).alias("f"))
    e = F.col("e")
    out = own.select("unit_id", "e", F.col("f").alias("tau"), F.zip_with("m", "f", lambda m, t: m - e * t).alias("mu0"), F.zip_with("m", "f", lambda m, t: m + (1 - e) * t).alias("mu1"))
    return [penalties[i] for i in best] if per_column else penalties[best[0]], out


def by_arm(units: DataFrame, folds: int, steps: int, y: Column) -> DataFrame:
    """unit_id, f0, f1: out-of-fold means of y (an array) from models of the units of either arm."""
    rows = with_models(units.withColumns({"_arm": F.col("a"), "_y": y}), folds, 2)
    rows = rows.withColumn("t", F.transform("t", lambda t, m: F.when(F.floor(m / folds) == F.col("_arm"), t).otherwise(0)))
    state = boost_mean(rows.select("unit_id", "x", "t", "fold", F.flatten(F.array_repeat("_y", 2 * folds)).alias("y")), steps)
    return state.select("unit_id", *[of_model(F.lit(a * folds) + F.col("fold"), 2 * folds).alias(f"f{a}") for a in (0, 1)])


def x_learner(units: DataFrame, folds: int = 3, steps: int = 10) -> DataFrame:
    """unit_id, tau ARRAY: imputed effects of both arms, blended by the propensity; out of fold throughout."""
    n = nuisances(units, folds, steps).select("unit_id", "e")
    d = stored(units.join(by_arm(units, folds, steps, F.col("y")), "unit_id"))
    effect = F.when(F.col("a") == 1, F.zip_with("y", "f0", lambda y, m: y - m)).otherwise(F.zip_with("f1", "y", lambda m, y: m - y))
    tau = by_arm(d.drop("f0", "f1").join(d.select("unit_id", effect.alias("_effect")), "unit_id"), folds, steps, F.col("_effect"))
    return tau.join(n, "unit_id").select("unit_id", F.zip_with("f0", "f1", lambda a, b: F.col("e") * a + (1 - F.col("e")) * b).alias("tau"))


def propensity_model(kind: str | Callable, n: int, seed: int = 0):
    """A pyspark.ml classifier by name, or a callable's result for seed."""
    if callable(kind):
        return kind(seed)
    if kind == "logistic":
        return LogisticRegression(labelCol="a", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)
    if kind == "boosted":
        return GBTClassifier(labelCol="a", maxIter=10, maxDepth=3, seed=seed)
    return RandomForestClassifier(labelCol="a", numTrees=200, minInstancesPerNode=5, seed=seed)


def propensities(units: DataFrame, kind: str | Callable = "logistic", folds: int = 3, seed: int = 0, new: DataFrame | None = None) -> DataFrame:
    """unit_id, e: out-of-fold probabilities, clipped; a training part with one arm gives its constant rate.

    Rows of new (unit_id, x) get the average of the fold models.
    """
    d = stored(units.select("unit_id", "a", "fold", array_to_vector("x").alias("features")))
    fresh = stored(new.select("unit_id", array_to_vector("x").alias("features"))) if new is not None else None
    parts, extra = [], []
    for f in range(folds):
        train = d.where(F.col("fold") != f)
        s = train.agg(F.count("*").alias("n"), F.avg("a").alias("p")).first()
        test = d.where(F.col("fold") == f)
        if not s["n"] or s["p"] in (0.0, 1.0):
            score = lambda df, p=float(s["p"] or 0.0): df.select("unit_id", F.lit(p).alias("e"))
        else:
            model = propensity_model(kind, s["n"], seed).fit(train)
            score = lambda df, model=model: model.transform(df).select("unit_id", vector_to_array("probability")[1].alias("e"))
        parts.append(score(test))
        if fresh is not None:
            extra.append(score(fresh))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if extra:
        more = extra[0]
        for p in extra[1:]:
            more = more.unionByName(p)
        out = out.unionByName(more.groupBy("unit_id").agg(F.avg("e").alias("e")))
    return out.withColumn("e", clipped(F.col("e")))


def zero_rates(units: DataFrame, zero: str, least: int = 8, folds: int = 0) -> DataFrame:
    """unit_id, arm, p: the chance of a zero curve in both arms, by a logistic model of each arm; one class gives its rate.

    With folds, units' fold is held out of the models that score them. Fewer than least rows give their rate, too.
    """
    d = stored(units.select("unit_id", F.col("a").alias("arm"), *(["fold"] if folds else []), F.col(zero).cast("int").alias("a"), array_to_vector("x").alias("features")))
    out = None
    for held in range(folds) if folds else [None]:
        asked = d if held is None else d.where(F.col("fold") == held)
        for arm in (0, 1):
            own = d.where((F.col("arm") == arm) & (F.lit(True) if held is None else F.col("fold") != held))
            s = own.agg(F.count("*").alias("n"), F.avg("a").alias("p")).first()
            if not s["n"] or s["p"] in (0.0, 1.0) or s["n"] < least:
                got = asked.select("unit_id", F.lit(arm).alias("arm"), F.lit(float(s["p"] or 0.0)).alias("p"))
            else:
                got = propensity_model("logistic", s["n"]).fit(own).transform(asked).select("unit_id", F.lit(arm).alias("arm"), vector_to_array("probability")[1].alias("p"))
            out = got if out is None else out.unionByName(got)
    return out


def two_part_laws(units: DataFrame, zero: str, folds: int = 3, least: int = 8, **settings) -> DataFrame:
    """unit_id, arm, atom_id, mass, q: out-of-fold laws of both arms, a zero curve with the chance of zero_rates() and fitted atoms.

    units: unit_id, a, x, q, fold and the boolean zero. The booster trains on non-zero units alone and predicts all. With
    fewer than least of them outside some fold the atoms are one curve, the mean of all non-zero ones; without any, zero.
    """
    rates = zero_rates(units, zero, least, folds)
    masked = F.transform("t", lambda t: F.when(F.col(zero), 0).otherwise(t))
    rows = with_models(units, folds, 1).withColumn("t", masked)
    counts = [r["n"] for r in units.where(~F.col(zero)).groupBy("fold").agg(F.count("*").alias("n")).collect()]  # a row for each fold
    if sum(counts) - max(counts, default=0) < least:
        levels = len(units.select("q").first()["q"])
        mean = units.where(~F.col(zero)).agg(*[F.coalesce(F.avg(F.get("q", F.lit(i))), F.lit(0.0)).alias(f"q{i}") for i in range(levels)]).first()
        law = units.select("unit_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("arm"), F.lit(0).alias("atom_id"), F.lit(1.0).alias("mass"), F.array(*[F.lit(float(v)) for v in mean]).alias("q"))
        return laws.two_part(law, rates)
    book, _ = boost.fit(rows, **settings)
    models, _, k = book.start.shape
    law = None
    for arm in (0, 1):
        made = boost.predict(book, rows.select("unit_id", "x", "a", "fold"), arm)
        own = made.select("unit_id", F.lit(arm).alias("arm"), boost.law_of(F.col("fold"), models).alias("p"))
        law = boost.as_law(own, k, "arm") if law is None else law.unionByName(boost.as_law(own, k, "arm"))
    return laws.two_part(law, rates)
