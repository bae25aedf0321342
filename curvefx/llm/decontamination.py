"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of every GUARANTEE - GRAM + 1 consecutive GRAM-word groups, the one with the least hash is kept as a fingerprint, in
documents and items alike. Any GUARANTEE words that a document shares with an item hold such a group in
both, so joining fingerprints finds a place in every shared window. Each hit is then extended to the windows
around it, which are compared word for word with the items' windows. Items shorter than a window are windows
of their own length and are looked up by their first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chars, stored

#: Words of a fingerprinted group, and of a window.
GRAM, GUARANTEE = 5, 13
#: A fingerprint's low bits hold its word position, the rest is the head of its hash.
PLACE_BITS = 28
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, UTF-8 bytes as characters; none for null."""
    return F.coalesce(F.filter(F.split(byte_chars(text), NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def kept_fingerprints(df: DataFrame, keys: list[str], gram: int = GRAM, guarantee: int = GUARANTEE) -> DataFrame:
    """keys, fp, place: the fingerprints of df's _words that winnowing keeps, for rows of guarantee words or more."""
    mask = F.lit(2**PLACE_BITS - 1).cast("long")
    window = guarantee - gram + 1
    hashed = df.where(F.size("_words") >= guarantee).withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    group = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(gram)])
    packed = F.transform(F.sequence(F.lit(0), F.size("_h") - gram), lambda i: group(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long").bitwiseAND(mask)))
    grams = hashed.withColumn("_g", packed)
    # _g is used twice, so that it stays a column of its own and isn't computed again for each window
    least = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_g") - window), lambda i: F.array_min(F.slice(F.col("_g"), i + 1, window))))
    kept = grams.select(*keys, F.explode(least).alias("_f"))
    return kept.select(*keys, F.shiftright("_f", PLACE_BITS).alias("fp"), F.col("_f").bitwiseAND(mask).cast("int").alias("place"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = GUARANTEE) -> DataFrame:
    """key, n_words, n_hit, n_items, items: the words of each document that lie in a window of an item.

    items is the array of the item keys, as strings in string order, that have a window in the document. One
    row for each row of docs; repeated rows repeat. Null and wordless texts have no words and no hits, items
    without words none either; null item keys are left out of items. Items with equal windows all count. Empty
    tables give no rows, or no hits. Texts of any length are read whole, as one array of words in a task. Only the named
    columns are read.
    """
    spans = items.select(F.col(f"`{item_key}`").cast("string").alias("item"), words(F.col(f"`{item_text}`").cast("string")).alias("_words")).where(F.size("_words") > 0).dropDuplicates()
    size = F.least(F.size("_words"), F.lit(window))
    windows = spans.select("item", size.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("_words") - size), lambda i: F.array_join(F.slice(F.col("_words"), i + 1, size), " "))).alias("w"))
    windows = stored(windows.groupBy("w", "n").agg(F.array_sort(F.collect_set("item")).alias("items")))
    lengths = [r["n"] for r in windows.select("n").where(F.col("n") < window).distinct().collect()]  # fewer than a window's words
    fps = kept_fingerprints(spans, [], guarantee=window).select("fp").distinct()

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")).alias("_row"))
    found = kept_fingerprints(rows.select("_row", words(F.col("_text")).alias("_words")), ["_row"], guarantee=window).join(fps, "fp", "left_semi")
    places = found.groupBy("_row").agg(F.collect_set("place").alias("_places"))

    near = rows.withColumn("_id", F.monotonically_increasing_id()).join(places, "_row", "left").select("_id", "_key", "_row", "_places", words(F.col("_text")).alias("_words")).withColumn("_n", F.size("_words"))
    reach = window - GRAM
    starts = F.array_distinct(F.flatten(F.transform("_places", lambda p: F.sequence(F.greatest(p - reach, F.lit(0)), F.least(p, F.col("_n") - window)))))
    tries = F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_join(F.slice(F.col("_words"), s + 1, window), " ").alias("w")))
    tries = F.coalesce(tries, F.array().cast("array<struct<s:int,w:string>>"))
    for n in lengths:  # short items: every place of a document is a try
        tries = F.concat(tries, F.when(F.col("_n") >= n, F.transform(F.sequence(F.lit(0), F.col("_n") - n), lambda s: F.struct(s.alias("s"), F.array_join(F.slice(F.col("_words"), s + 1, n), " ").alias("w")))).otherwise(F.array().cast("array<struct<s:int,w:string>>")))
    tried = near.select("_id", "_key", "_row", "_n", F.explode_outer(tries).alias("t")).select("_id", "_key", "_row", "_n", "t.s", "t.w")
    hits = tried.join(windows, "w", "left")
    per_row = hits.groupBy("_id", "_key", "_row", "_n").agg(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(F.array_sort("_hits"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["sum"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).alias("sum")), lambda a: a["sum"])
    return per_row.select(F.col("_key").alias(key), F.col("_n").cast("long").alias("n_words"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "_row")
