"""Very long texts through the operators that read documents, and empty tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from curvefx.llm import decontamination, language_id, quality_rules, sharding, simhash, url_filter  # noqa: E402

PASSAGE = " ".join(f"bench{i}" for i in range(20))
LONG = " ".join(f"word{i % 5000}" for i in range(200_000))
NAMES = "doc_id long, text string, lang string, source string"


def docs(spark):
    return spark.createDataFrame([(1, f"{LONG} {PASSAGE}", "en", "s"), (2, LONG, "en", "s"), (3, LONG + "x", "en", "s"), (4, "short", "de", None), (5, "w" * 2_000_000, None, None)], NAMES)


def test_op1_finds_a_passage_at_the_end(spark):
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs(spark), items).collect()}
    assert got[1] == (200_020, 20, ["7"]) and got[2] == (200_000, 0, []) and got[5] == (1, 0, [])


def test_op2_measures_whole_texts(spark):
    rows = {r["doc_id"]: r for r in sharding.kd_shards(docs(spark), 3).collect()}
    assert rows[2]["size"] == len(LONG) + 8 and rows[5]["size"] == 2_000_008 and len(rows) == 5
    assert {(r["shard"], r["slot"]) for r in rows.values()} == {(s, i) for s in range(3) for i in range(sum(r["shard"] == s for r in rows.values()))}


def test_op4_and_op6_read_whole_texts(spark):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.near_duplicates(docs(spark)).collect()}
    for i, t in ((2, LONG), (5, "w" * 2_000_000)):
        assert got[i] == simhash.fingerprint(t, 3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs(spark), labels).collect()}
    assert rows[2]["n_words"] == 200_000 and rows[5]["word_chars"] == 2_000_000 and not rows[5]["kept"]
    want = brute.op6(f"{LONG} {PASSAGE}")
    assert rows[1]["n_repeat_words"] == want[4]


def test_op9_long_and_missing_urls(spark):
    long = "http://a.b.net/" + "p/" * 500_000
    none = spark.createDataFrame([], "url string, bad int")
    pages = spark.createDataFrame([(1, long), (2, None), (3, "http://" + "h." * 100_000 + "net/x")], "page_id int, url string")
    rows = {r["page_id"]: r for r in url_filter.judged(pages, none, [("block", "b.net", "/p/")]).collect()}
    assert rows[1]["verdict"] == "block" and len(rows[1]["path"]) == 1_000_001 and rows[2]["verdict"] == rows[3]["verdict"] == "allow"
    assert url_filter.judged(pages.limit(0), none, []).count() == 0
    some = spark.createDataFrame([("http://a.b.net/1", 1)], "url string, bad int")
    assert url_filter.judged(pages.limit(0), some, []).count() == 0


def test_op10_reads_whole_texts(spark):
    train = spark.createDataFrame([("the cat and the dog and the house " * 20, "en"), ("der hund und die katze und das haus " * 20, "de")] * 5, "text string, lang string").withColumn("doc_id", F.monotonically_increasing_id())
    long = spark.createDataFrame([(1, "1 " * 300_000 + "und die katze und der hund " * 20_000), (2, "7 " * 500_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(long, language_id.learnt(train)).collect()}
    assert got == {1: "de", 2: "und"}
