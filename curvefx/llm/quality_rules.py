"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects texts whose feature reaches a cutoff. A labelled holdout gives, for each stratum, rule and cutoff of
a fixed grid, the number of good documents and of good ones rejected. A cutoff may be used if the exact
binomial test rejects "the rule drops more than ALPHA of good documents" at level DELTA over the number of all
tests (Bonferroni over strata, rules and grid), which is the Clopper-Pearson bound. The strictest such cutoff is
taken, and a rule without one is not applied in that stratum. At most ALPHA x rules of a stratum's good documents
are then lost, with probability 1 - DELTA for all strata at once: that is the bound on what a document faces that
all rules judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, stored

ALPHA, DELTA = 0.01, 0.05
SPACES = r"[ \x09-\x0D]+"
#: A rule's feature and the grid of its cutoffs, from lenient to strict.
RULES = {
    "symbols": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "shouting": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "word_length": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],
}


def repeated_words(grams: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; grams is an array of structs h, i sorted by both."""
    twice = F.filter(grams, lambda e, j: (F.get(grams, j - 1)["h"] == e["h"]) | (F.get(grams, j + 1)["h"] == e["h"]))
    return F.array_sort(F.transform(twice, lambda e: e["i"]))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text column, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_loud.

    n_loud counts A-Z and "!". A null or wordless text has 0 everywhere but n_symbols and n_loud, which count
    its characters. Columns of df with such names are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_loud")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (*new, text)]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    a = df.select(*keep, t.alias("_t"), F.filter(F.split(t, SPACES), lambda w: w != "").alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("_l"))
    names = [F.col(f"`{c}`") for c in a.columns if c not in ("_t", "_w", "_l")]
    n = F.size("_w")
    counts = a.select(
        *names, "_w", n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[A-Z!]", ""))).cast("long").alias("n_loud"),
    )
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))).otherwise(F.array().cast("array<long>"))
    kept = [F.col(f"`{c}`") for c in counts.columns if c != "_w"]
    grams = counts.select(*kept, three.alias("_g"))
    # most texts repeat no window and need no sorting
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    places = grams.select(*kept, pairs.alias("_p")).select(*kept, repeated_words(F.col("_p")).alias("_i"))
    gaps = F.transform("_i", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_i"), k + 1) - i, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    return places.select(*[c for c in kept], covered.alias("n_repeat_words"))


def rule_values(df: DataFrame) -> dict[str, Column]:
    """Each rule's feature as a column over the counts of features()."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") * 8 / words, "repeats": F.col("n_repeat_words") / words, "shouting": F.col("n_loud") / chars, "word_length": F.col("word_chars") / words}


def log_factorial(x: Column) -> Column:
    """ln x! of a whole number: exact below 16, else by Stirling's series, with an error below 1e-10."""
    d = F.greatest(x, F.lit(16)).cast("double")
    series = d * F.log(d) - d + F.log(2 * F.pi() * d) / 2 + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
    return F.when(x < 16, F.log(F.factorial(F.least(x, F.lit(16)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p) and k of at most np: the terms from k downward, which only get smaller.

    Terms further than twelve standard deviations below k are left out; they add less than 1e-30 of the sum, so that the
    number of terms grows with the root of n.
    """
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p)))
    rest = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(terms.cast("long"), F.lit(1)) - 1), start, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return top * rest


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, and for each rule the strictest admissible cutoff or null.

    labelled has the counts of features(), a stratum and good (boolean). The counts over all labelled rows make one
    small row for each stratum, rule and cutoff.
    """
    value = rule_values(labelled)
    tests = [(r, c) for r, grid in RULES.items() for c in grid]
    good = labelled.where("good").groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(value[r] >= c, 1)).alias(f"k{i}") for i, (r, c) in enumerate(tests)])
    long = good.select("stratum", "n", F.count("*").over(Window.partitionBy(F.lit(1))).alias("strata"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tests)])).alias("x")).select("stratum", "n", "strata", "x.*")
    safe = long.where(F.col("k") <= alpha * F.col("n")).where(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / (F.col("strata") * len(tests)))
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """key, _row, the counts, base_failed, kept and the rule that rejects, for each row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept is false for those and
    for texts that reach an admissible cutoff of their stratum. labels says of keys whether they are good (1);
    rows with null keys or labels are left out, and a key with several labels counts as good if all are.
    Null strata form one stratum. Without labels no cutoff is admissible and only the base rule rejects.
    Texts are read whole at any length. Repeated rows repeat; an empty table gives an empty result. Ties at a cutoff
    reject. _row hashes key and text.
    """
    k = F.col(f"`{key}`")
    rows = docs.select(k.alias("_key"), F.xxhash64(k.cast("string"), F.col(f"`{text}`").cast("string")).alias("_row"), F.coalesce(column_or_null(docs, stratum, "string"), F.lit("")).alias("stratum"), F.col(f"`{text}`").alias("_text"))
    counted = stored(features(rows, "_text"))
    marks = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg((F.min(f"`{label}`") == 1).alias("good"))
    cuts = stored(cutoffs(counted.join(marks, "_key"), alpha, delta))
    value = rule_values(counted)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    broken = F.coalesce(*[F.when(value[r] >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    out = counted.join(cuts, "stratum", "left").select("*", base.alias("base_failed"), F.when(base, F.lit("base")).otherwise(broken).alias("rule"))
    return out.select(F.col("_key").alias(key), "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").isNull().alias("kept"), "rule")
