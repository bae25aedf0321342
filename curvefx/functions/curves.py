"""Expressions over quantile curves q ARRAY<DOUBLE>; w is an array of grid weights that sum to 1, equal ones if None.

A null curve gives null everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once where body uses it often, as inside a lambda over an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def not_negative(v: Column) -> Column:
    """v, or 0 below it; null and NaN stay."""
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


def total(a: Column) -> Column:
    """Sum of an array, from the left."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(q: Curve, w: Column | None = None) -> Column:
    """Weighted sum; the plain average without weights."""
    return total(q) / F.size(q) if w is None else total(F.zip_with(q, w, lambda a, b: a * b))


def curve_mean(q: Curve, w: Column | None = None) -> Column:
    return dot(q, w)


def moment_about(q: Curve, mean: Column, power: int, w: Column | None = None) -> Column:
    def raised(x: Column) -> Column:
        d = x - mean
        out = d
        for _ in range(power - 1):
            out = out * d
        return out

    return dot(F.transform(q, raised), w)


def central_moment(q: Curve, power: int, w: Column | None = None) -> Column:
    return let(dot(q, w), lambda mean: moment_about(q, mean, power, w))


def curve_sd(q: Curve, w: Column | None = None) -> Column:
    return F.sqrt(let(central_moment(q, 2, w), not_negative))


def curve_skew(q: Curve, w: Column | None = None, floor: float = 1e-12) -> Column:
    """Third moment over sd cubed; 0 where the sd is at most floor."""

    def about(mean: Column) -> Column:
        sd = F.sqrt(let(moment_about(q, mean, 2, w), not_negative))
        return let(sd, lambda s: F.when(s > floor, moment_about(q, mean, 3, w) / (s * s * s)).otherwise(F.when(s.isNotNull(), F.lit(0.0))))

    return let(dot(q, w), about)


def curve_skew_by_variance(q: Curve, w: Column | None = None) -> Column:
    """The other convention: 0 only where the variance is 0."""

    def about(mean: Column) -> Column:
        return let(moment_about(q, mean, 2, w), lambda var: F.when(var > 0, moment_about(q, mean, 3, w) / F.pow(var, 1.5)).otherwise(F.when(var.isNotNull(), F.lit(0.0))))

    return let(dot(q, w), about)


def curve_tail(q: Curve, k: int) -> Column:
    """Average of the upper half, from coordinate k // 2 of k on, under equal weights."""
    return total(F.slice(q, k // 2 + 1, k - k // 2)) / (k - k // 2)


def curve_at(q: Curve, k: int) -> Column:
    """Coordinate k, counted from 0."""
    return F.get(q, F.lit(k))


def curve_dist2(a: Curve, b: Curve, w: Column | None = None) -> Column:
    return dot(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w)


def curve_distance(a: Curve, b: Curve, w: Column | None = None) -> Column:
    return F.sqrt(let(curve_dist2(a, b, w), not_negative))


def smoothed_distance(a: Curve, b: Curve, eps: float = 0.0, w: Column | None = None) -> Column:
    """sqrt(d2 + eps^2) - eps."""
    return F.sqrt(let(curve_dist2(a, b, w), not_negative) + eps * eps) - eps


def to_rescaled(q: Curve, w: Column | None = None) -> Column:
    """z = sqrt(w) q, so that Euclidean distance of z is weighted distance of q."""
    return F.transform(q, lambda x: x / F.sqrt(F.size(q))) if w is None else F.zip_with(q, w, lambda x, y: x * F.sqrt(y))


def from_rescaled(z: Column, w: Column | None = None) -> Column:
    return F.transform(z, lambda x: x * F.sqrt(F.size(z))) if w is None else F.zip_with(z, w, lambda x, y: x / F.sqrt(y))


def adjacent(q: Curve) -> Column:
    """Differences of neighbouring coordinates."""
    return let(q, lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: x - F.get(c, i)))


def is_monotone(q: Curve, atol: float = 1e-12) -> Column:
    return F.forall(adjacent(q), lambda d: d >= -atol)


def violations(q: Curve) -> Column:
    """Number of falling steps."""
    return F.size(F.filter(adjacent(q), lambda d: d < 0))


def running_max(q: Curve) -> Column:
    last = lambda s, x: F.coalesce(F.greatest(F.try_element_at(s, F.lit(-1)), x), x)
    return F.aggregate(q, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(last(s, x))))


def project_monotone(q: Curve, w: Column | None = None) -> Column:
    """The nearest nondecreasing curve in the weighted norm, by pooling; rising curves are returned as they are.

    One fold over the levels keeps the weighted sums S, M so far and those before each block. A new level's block starts
    at the one of the open starts from which the average to here is largest. Each block takes its average.
    """
    weight = lambda i: F.lit(1.0) if w is None else F.get(w, i)
    levels = F.transform(q, lambda x, i: F.struct((x * weight(i)).alias("p"), weight(i).alias("m"), i.alias("i")))
    start = F.struct(F.lit(0.0).alias("S"), F.lit(0.0).alias("M"), F.array().cast("array<struct<s:double,m:double,i:int>>").alias("starts"))

    def best(a: Column) -> Column:
        """How many starts stay: up to the one with the largest average, the first at a tie."""
        tried = F.transform(a["starts"], lambda b, j: F.struct(((a["S"] - b["s"]) / (a["M"] - b["m"])).alias("v"), (-j - 1).alias("j")))
        return -F.array_max(tried)["j"]

    def add(a: Column, e: Column) -> Column:
        opened = F.concat(a["starts"], F.array(F.struct(a["S"].alias("s"), a["M"].alias("m"), e["i"].alias("i"))))
        grown = F.struct((a["S"] + e["p"]).alias("S"), (a["M"] + e["m"]).alias("M"), opened.alias("starts"))
        return let(grown, lambda g: F.struct(g["S"], g["M"], F.slice(g["starts"], F.lit(1), best(g)).alias("starts")))

    def values(a: Column) -> Column:
        ends = F.concat(a["starts"], F.array(F.struct(a["S"].alias("s"), a["M"].alias("m"), F.size(q).alias("i"))))
        value = lambda b, n: (n["s"] - b["s"]) / (n["m"] - b["m"])
        return F.flatten(F.transform(a["starts"], lambda b, j: let(F.get(ends, j + 1), lambda n: F.array_repeat(value(b, n), n["i"] - b["i"]))))

    return F.when(violations(q) > 0, let(F.aggregate(levels, start, add), values)).otherwise(q)


def curve_cap(q: Curve, levels: list[float], level: float) -> Column:
    """Elementwise minimum with the curve's value at a level."""
    return let(value_at(q, levels, level), lambda top: F.transform(q, lambda x: F.least(x, top)))


def value_at(q: Curve, levels: list[float], u: float) -> Column:
    """Linear interpolation at one level, constant beyond the ends."""
    if u <= levels[0]:
        return F.get(q, F.lit(0))
    if u >= levels[-1]:
        return F.get(q, F.lit(len(levels) - 1))
    j = next(i for i, x in enumerate(levels) if x >= u)
    a, b = levels[j - 1], levels[j]
    return F.get(q, F.lit(j - 1)) + (u - a) / (b - a) * (F.get(q, F.lit(j)) - F.get(q, F.lit(j - 1)))


def curve_resample(q: Curve, source: list[float], target: list[float]) -> Column:
    return F.array(*[value_at(q, source, u) for u in target])


def curve_minus(a: Curve, b: Curve) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def curve_diff(now: Curve, before: Curve) -> Column:
    """First difference of two curves made monotone under equal weights."""
    return project_monotone(curve_minus(now, before))


def ramp(delta: Column, levels: list[float]) -> Column:
    """delta (1 - u) at each level."""
    return F.array(*[delta * (1.0 - u) for u in levels])


def is_zero_curve(q: Curve, tol: float = 0.0) -> Column:
    return F.array_max(F.transform(q, F.abs)) <= tol


def shifted_log(q: Curve, floor: Column) -> Column:
    return F.transform(q, lambda x: F.log(x - floor))


def unshifted_log(z: Column, floor: Column) -> Column:
    return F.transform(z, lambda x: F.exp(x) + floor)


FUNCTIONALS: dict[str, Callable[[Curve, Curve], Column]] = {
    "mean": lambda q, star: curve_mean(q),
    "sd": lambda q, star: curve_sd(q),
    "skew": lambda q, star: curve_skew(q),
    "tail": lambda q, star: curve_tail(q, 25),
    "reference": lambda q, star: curve_distance(q, star),
}


def functionals(q: Curve, star: Curve, more: dict[str, Callable[[Curve, Curve], Column]] | None = None) -> list[Column]:
    """The declared functionals of a 25-level curve and any user-given ones, each aliased by name."""
    return [f(q, star).alias(name) for name, f in {**FUNCTIONALS, **(more or {})}.items()]


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value by the rational approximation of Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * 0.3989422804014327 * F.exp(-x * x / 2.0) * poly)


#: The same p-value as SQL text over an expression.
def normal_tail_sql(z: str) -> str:
    t = f"(1::DOUBLE/(1::DOUBLE+0.2316419::DOUBLE*abs({z})))"
    return f"least(1::DOUBLE, 2::DOUBLE*0.3989422804014327::DOUBLE*exp(-({z})*({z})/2)*{t}*(0.319381530::DOUBLE+{t}*(-0.356563782::DOUBLE+{t}*(1.781477937::DOUBLE+{t}*(-1.821255978::DOUBLE+{t}*1.330274429::DOUBLE)))))"
