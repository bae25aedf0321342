"""run() against the stages put together in plain Python."""

import hashlib
import os
import struct
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_near_copies import brute as jaccard_groups  # noqa: E402
from test_operators import python_cutoffs, tiktoken_encoding  # noqa: E402

from curvefx.llm import common, pii, quality_rules  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_run(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    raw = quality_rules.features(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("stratum", F.coalesce("lang", F.lit("")))).collect()
    cuts, value = python_cutoffs(raw, labels)
    kept = [r["doc_id"] for r in raw if not brute.op6(docs[r["doc_id"]]["text"])[5] and not any(value(r)[k] >= c for (s, k), c in cuts.items() if s == r["stratum"])]
    root = jaccard_groups([docs[d]["text"] or "" for d in kept])  # five words, similarity 0.8
    kept = [d for d, r in zip(kept, root) if d == min(x for x, y in zip(kept, root) if y == r)]
    dirty = brute.op1([(d, docs[d]["text"]) for d in kept], items)
    kept = [d for d in kept if not dirty[d][4]]
    frame = spark.createDataFrame([(d, docs[d]["text"]) for d in kept], "doc_id long, text string")
    model, e = pii.trained(frame, "text", "doc_id"), tiktoken_encoding()
    want = {}
    for d in kept:
        t = docs[d]["text"]
        t = pii.redacted(t, pii.all_spans(t, pii.base_spans(t), model, {}))
        assert not brute.op7(t)
        ids = e.encode_ordinary(t)
        want[d] = (len(t), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), brute.sha(t))
    before = len(common.STORED)
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 100
    left = common.STORED[before:]
    assert len(left) == 1 and os.path.isdir(left[0].removeprefix("file:")) and len(os.listdir(os.path.dirname(left[0].removeprefix("file:")))) >= 1


def test_stages_keep_columns_and_odd_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good + " x y z", None, None, None), (3, None, "en", None, 0), (4, "short", "en", "s", 5)], names)
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality rules"](spark, docs, DATA)
    assert sorted(str(r["doc_id"]) for r in a.collect()) == ["1", "1", "None"]
    b = stages["simhash near-dedup"](spark, a, DATA)
    assert a.columns == b.columns == docs.columns and "1" in [str(r["doc_id"]) for r in b.collect()] and b.where("doc_id = 1").count() == 1
    c = stages["pii"](spark, stages["benchmark decontamination"](spark, b, DATA), DATA)
    assert c.columns == docs.columns and c.count() == b.count()
    assert stages["byte-level bpe"](spark, c, DATA).count() == b.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
