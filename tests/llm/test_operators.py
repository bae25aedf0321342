"""The text queries on a small fixture with edge cases, against plain Python, tiktoken or planted truths."""

import base64
import collections
import hashlib
import html
import math
import os
import re
import struct
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from curvefx.llm import bpe, decontamination, html_extract, language_id, pii, quality_rules, queries, sharding, simhash, substring_dedup, url_filter  # noqa: E402

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort eins zwei " * 4000


def edges():
    two = "The same words stand in two documents so that a window of twenty words or more is found in both of them, once and again, here and there."
    rows = [(10001, None), (10002, ""), (10003, " \n\t "), (10004, LONG), (10005, "x" * 70000), (10006, two), (10007, two), (10008, two + " And a tail."), (10009, "12" * 3000 + " a@b " + "q" * 3000 + "@x.y"), (10010, "İß ÀÉ one two three é É")]
    return [(i, t, None if i % 2 else "en", None if i % 3 else "src1", None) for i, t in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """sf0.001 with edge rows and clashing extra columns in documents."""
    d = str(tmp_path_factory.mktemp("sf"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "no scheme", ""), (9003, "HTTP://A.Org:80/x?y", "plain text only"), (9004, "https://Example.ORG", "<p>a<p>b<br>c &amp; d")], pages.schema)
    pages.union(odd).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(spark.createDataFrame(edges(), DOC))
    clash = ["size", "shard", "slot", "fp", "n_words", "spans", "base", "n_email", "ids_sha256", "lang_pred", "score", "key", "hash", "rid", "start", "anchor", "_text", "stratum"]
    docs.select("*", *[F.lit("clash").alias(c) for c in clash]).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, sf, name):
    return {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(spark, sf, "op1_decontamination") == brute.op1(texts, items)


def test_op1_short_items_ties_and_nulls(spark):
    items = [(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "!!"), (None, "gamma"), (5, " ".join(f"w{i}" for i in range(20)))]
    docs = [(1, "Alpha, BETA gamma"), (2, None), (3, "beta alpha"), (4, " ".join(f"W{i}" for i in range(3, 17)) + " tail"), (4, "alpha beta alpha beta"), (None, "x alpha beta")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in decontamination.contamination(d, i).collect()}
    assert got == {(1, 3): (3, ["1", "2"]), (2, 0): (0, []), (3, 2): (0, []), (4, 15): (14, ["5"]), (4, 4): (4, ["1", "2"]), (None, 3): (2, ["1", "2"])}
    assert decontamination.contamination(d.where("false"), i).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(d, i.where("false")).collect()} == {0}
    twice = decontamination.contamination(d.where("doc_id = 1").union(d.where("doc_id = 1")), i)
    assert [r["n_hit"] for r in twice.collect()] == [3, 3]


def test_op2(spark, sf, texts):
    got = rows_of(spark, sf, "op2_sharding")
    by, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for d, t in texts:
        raw = (t or "").encode()
        size, crc, law, shard, slot, grown = got[d]
        assert (size, crc, law, grown) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by[shard] += size
        slots[shard].append(slot)
        groups[t].add(shard)
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, groups.values())) == 1


def test_op2_balance_with_a_hot_group(spark):
    docs = [(i, f"text {i} " * (1 + i % 40), f"s{i % 7}", "en") for i in range(3000)] + [(5000 + i, "hot words " * 30, "s1", "en") for i in range(1500)] + [(9000, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = sharding.kd_shards(d, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = sorted(r["b"] for r in got)
    hot = 1500 * (10 * 30 + 8)
    rest = (sum(sizes) - hot) / 7
    assert sizes[-1] >= hot and len(sizes) == 8
    assert all(abs(s - rest) < 0.12 * rest for s in sizes[:-1])
    assert sharding.kd_shards(d.where("false"), 8).count() == 0


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, sf, texts):
    e, got = tiktoken_encoding(), rows_of(spark, sf, "op3_bpe")
    for d, t in texts:
        ids = e.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), brute.sha(t or "")), d


def test_op3_round_trip_and_odd_text(spark):
    import public_tokenizers as P

    odd = ["", None, "a\u2009 \u202f b\u3000\u1680c\u200b-d", "\x1c\x85    x", "aaaa aaaaaaa aaa", "don't DON'T we'll", "\U0001f600́ ١٢٣", "a\n\n \n b  ", "日本語テキスト"]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    m, e = bpe.Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}), tiktoken_encoding()
    for r in bpe.encoded(d, queries.RANKS, P.PATTERN, outputs=("ids",)).collect():
        t = odd[r["doc_id"]] or ""
        assert r["ids"] == e.encode_ordinary(t) and bpe.decoded(r["ids"], m.tokens) == t.encode()


def test_replay_takes_late_pairs_in_the_words_own_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"aaa": 300, b"aa": 301, b"ba": 302, b"baa": 303}
    m = bpe.Merges(ranks)
    for word in (b"aaaa", b"aaaaa", b"baaab", b"abaaaba"):
        ids, starts = bpe.replay([word, b"zz"], m)
        assert ids[: starts[1]].tolist() == m.alone(word) and ids[starts[1] :].tolist() == [122, 122]


def test_op4(spark, sf, texts):
    assert rows_of(spark, sf, "op4_simhash") == brute.op4(texts)


def test_op4_links_at_any_two_bits(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    fps = set(base)
    for b in base[:20]:
        x = b
        for _ in range(5):
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps |= {base[21] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    d = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(d)).collect()}
    sets = collections.defaultdict(set)
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        sets[got.get(s, s)].add(f)
    want = collections.defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))


def test_op4_nulls_and_repeats(spark):
    d = spark.createDataFrame([(3, None), (2, ""), (None, "!"), (2, ""), (None, None)], "doc_id long, text string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in simhash.near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(3, 2), (2, 2), (2, 2), (None, 2), (None, None)], key=str)
    assert simhash.near_duplicates(d.where("false")).count() == 0


def test_op5(spark, sf, texts):
    assert rows_of(spark, sf, "op5_substring_dedup") == brute.op5(texts)


@pytest.mark.parametrize("piece", [2_000_000, 150])
def test_op5_beyond_the_remembered_windows(spark, monkeypatch, piece):
    """Few windows are remembered, and texts come in pieces."""
    monkeypatch.setattr(substring_dedup, "MOST_WINDOWS", 3)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["a", "b", "c"], 60)) for _ in range(12)]
    docs = [(i, base[i % 12] + f" {i}") for i in range(40)] + [(100, " \t".join(base) + "\n\n" + base[0]), (101, "é " + base[3].replace(" ", "  "))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2], brute.sha(r[3])) for r in substring_dedup.without_repeats(d).collect()}
    assert got == brute.op5(docs)


def test_op5_shared_ids_nulls_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(25))
    d = spark.createDataFrame([(1, t), (1, t), (None, None), (2, "v " + t)], "doc_id long, text string")
    got = sorted((str(r[0]), r[1], r[2]) for r in substring_dedup.without_repeats(d).collect())
    assert got == [("1", 25, 0), ("1", 25, 0), ("2", 26, 25), ("None", 0, 0)]
    assert substring_dedup.without_repeats(d.where("false")).count() == 0


def python_cutoffs(rows, labels):
    """rows: doc_id, stratum, counts with n_loud; the admissible cutoffs by an independent binomial sum."""
    good = {d for d, q in labels if q == 1}
    value = lambda r: {"symbols": r["n_symbols"] / max(r["n_words"], 1), "dup_lines": r["n_dup_lines"] * 8 / max(r["n_words"], 1), "repeats": r["n_repeat_words"] / max(r["n_words"], 1), "shouting": r["n_loud"] / max(r["word_chars"], 1), "word_length": r["word_chars"] / max(r["n_words"], 1)}
    by = collections.defaultdict(list)
    for r in rows:
        if r["doc_id"] in good:
            by[r["stratum"]].append(value(r))
    tests = len(by) * sum(map(len, quality_rules.RULES.values()))
    out, a = {}, quality_rules.ALPHA
    for s, vs in by.items():
        for rule, grid in quality_rules.RULES.items():
            n, ok = len(vs), []
            for c in grid:
                k = sum(v[rule] >= c for v in vs)
                if k <= a * n and sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)) <= quality_rules.DELTA / tests:
                    ok.append(c)
            if ok:
                out[s, rule] = min(ok)
    return out, value


def test_op6_counts(spark, sf, texts):
    got = rows_of(spark, sf, "op6_quality_rules")
    assert {d: g[:6] for d, g in got.items()} == {d: brute.op6(t) for d, t in texts}
    assert all(not (g[5] and g[6]) for g in got.values())


def test_op6_thresholds(spark):
    docs = [(i, ("word %d goes on and ever on " % i) * (1 if i % 2 else 2) + " ".join(f"{i}t{k}" for k in range(60)) + ("$ " * (i % 97 == 0)) + (" $#%" * 90 if i >= 1900 else ""), "en" if i % 3 else None) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i < 1900)) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judged(d, lab).collect()}
    raw = quality_rules.features(d.withColumn("stratum", F.coalesce("lang", F.lit("")))).collect()
    cuts, value = python_cutoffs(raw, [(r[0], r[1]) for r in lab.collect()])
    assert cuts
    for r in raw:
        bad = any(value(r)[k] >= c for (s, k), c in cuts.items() if s == r["stratum"])
        assert got[r["doc_id"]]["kept"] == (not bad and not got[r["doc_id"]]["base_failed"])
    assert not any(got[i]["kept"] for i in range(1900, 2000) if i % 3)
    assert {r["kept"] for r in quality_rules.judged(d.limit(50), lab.where("false")).collect()} == {True}
    assert quality_rules.judged(d.where("false"), lab).count() == 0


def test_op7(spark, sf, texts):
    got = rows_of(spark, sf, "op7_pii")
    for d, t in texts:
        base = brute.op7(t)
        text = [f"{k}:{s}:{e}" for k, s, e in base]
        assert got[d][:5] == (*[sum(k == n for k, _, _ in base) for n in ("email", "ip", "card", "phone")], brute.sha(",".join(text))), d
        assert set(text) <= set(filter(None, got[d][5].split(",")))


def test_op7_adds_secrets_and_redacts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.trained(d, "text", "doc_id")
    t = 'A token = "' + "0a1b" * 10 + '" and me@x.org or 4111 1111 1111 1111.'
    one = spark.createDataFrame([(1, t), (2, None), (1, t), (3, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.found(one, model=model, replace=True).collect()}
    assert got == {1: 'A token = "<SECRET>" and <EMAIL> or <CARD>.', 2: None, 3: "nothing here"}
    assert pii.found(one.where("false")).count() == 0


def test_op7_dynamic_program_is_the_best_segmentation():
    model = pii.Model()
    rng = np.random.default_rng(0)
    model.w, model.t = rng.normal(size=model.w.shape), rng.normal(size=model.t.shape)
    text = "+1 (826) 555-4081 190.137.223.204 a@b.c"
    run = pii.runs(text)[0]
    segs = pii.segments(text, run)
    score = {(i, n): s for (i, n, _), s in zip(segs, model.scores(segs))}

    def every(at, prev):
        if at == len(run):
            return [(0.0, [])]
        return [(score[at, n][y] + model.t[prev, y] + s, [(at, n, y), *p]) for n in range(1, min(pii.MOST_TOKENS, len(run) - at) + 1) for y in range(len(pii.TYPES)) if n == 1 or y for s, p in every(at + n, y)]

    assert model.best(len(run), segs) == max(every(0, len(pii.TYPES)))[1]


def test_op8(spark, sf):
    got = {r["page_id"]: r for r in queries.QUERIES["op8_html_extract"](spark, sf).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (want, len(want))
    assert [got[i]["text"] for i in (9001, 9002, 9003, 9004)] == ["", "", "plain text only", "a b c & d"]


def test_op8_leaves_out_furniture():
    page = """<html><head><title>T</title></head><body><header>Top</header><div id="main-menu"><a href=x>One</a></div>
    <div class=content><h1>Head</h1><p>First, with a comma, and <b>bold</b>&nbsp;words that go on.</p><ul><li>point</li></ul><form>sign</form></div>
    <aside>side</aside><div class="comments"><p>Great post, really, I mean it, thanks a lot for it!</p></div><p hidden>no</p><!-- <p>x</p> --></body>"""
    assert html_extract.main_text(page) == "Head First, with a comma, and bold words that go on. point"
    assert html_extract.main_text("<script>a<b</script><p>x</p><style>p{}") == "x"


def test_op9(spark, sf):
    rules = queries.RULES
    got = {r["page_id"]: r for r in queries.QUERIES["op9_url_filter"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        _, found, rest = (p["url"] or "").partition("://")
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(brute.LOW)
        fits = [(len(h + q), h + q, a) for a, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_op9_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([("http://bad.x.com/1",), ("http://good.x.com/1",), ("http://new.y.net/",), (None,)], "url string")
    seen = spark.createDataFrame([(f"http://bad.x.com/{i}", 1) for i in range(60)] + [(f"http://good.x.com/{i}", int(i % 20 == 0)) for i in range(60)] + [("x", 1), ("http://g.y.net/", None)], "url string, bad int")
    got = {r["url"]: r["verdict"] for r in url_filter.judged(pages, seen, []).collect()}
    assert got == {"http://bad.x.com/1": "block", "http://good.x.com/1": "allow", "http://new.y.net/": "allow", None: "allow"}
    assert {r["verdict"] for r in url_filter.judged(pages, seen.where("false"), []).collect()} == {"allow"}


def test_op10(spark, sf, texts):
    got = rows_of(spark, sf, "op10_language_id")
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(g[0] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, g in got.items())
    held = [d for d in lang if got[d][0]]
    assert sum(got[d][1] == lang[d] for d in held) >= 0.95 * len(held)
    assert all(got[i][1:] == ("und", 0.0) for i in (10001, 10002, 10003)) and all(0 <= g[2] <= 1 for g in got.values())


def test_op10_without_training_rows(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = language_id.identified(d, language_id.learnt(d.where("false"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_columns_that_clash_with_inner_names(spark):
    import public_tokenizers as P

    inner = ["_text", "_html", "_all", "_group", "_bucket", "_row", "_start", "_action", "_id", "_hash", "_key", "low", "_n", "_w"]
    d = spark.createDataFrame([(1, "one two three", "en", "http://a.b/c"), (2, None, None, None)], "doc_id long, text string, lang string, url string").select("*", *[F.lit(c).alias(c) for c in inner])
    for out in (
        bpe.encoded(d, queries.RANKS, P.PATTERN), pii.found(d), pii.found(d, replace=True), html_extract.extracted(d.withColumnRenamed("text", "html")), language_id.identified(d, language_id.Profiles({})),
        sharding.kd_shards(d, 3), url_filter.judged(d.drop("low"), d.select("url", F.lit(1).alias("bad")), []), simhash.fingerprints(d), quality_rules.judged(d, d.select("doc_id", F.lit(1).alias("quality"))), decontamination.contamination(d, d.withColumnRenamed("doc_id", "item_id")), substring_dedup.without_repeats(d), simhash.near_duplicates(d),
    ):
        rows = out.collect()
        assert len(rows) == 2 and all(r[c] == c for r in rows for c in inner if c in out.columns and c not in ("low", "_row"))
