"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from curvefx.llm import near_copies, simhash  # noqa: E402

NAMES = "doc_id long, text string"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts):
    """Groups of places that similarity of at least 0.8 connects."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_stage_drops_copies_beyond_two_bits(spark):
    words = [f"w{i * i % 997}" for i in range(200)]
    other = words[:60] + ["changed"] + words[61:130] + ["again"] + words[131:]
    a, b = " ".join(words), " ".join(other)
    assert (simhash.fingerprint(a, 3) ^ simhash.fingerprint(b, 3)).bit_count() > 2
    docs = spark.createDataFrame([(7, b), (3, a), (9, "another text of more than five words")], NAMES)
    assert sorted(r[0] for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "").collect()) == [3, 9]


def test_groups_equal_brute_force(spark):
    """Families of drifting copies, so that a bucket holds members that are not similar to its least one."""
    rng = random.Random(5)
    texts = []
    for _ in range(4):
        words = [f"v{rng.randrange(900)}" for _ in range(150)]
        for _ in range(40):
            texts.append(" ".join(words))
            if rng.random() < 0.5:
                words = list(words)
                for _ in range(rng.choice([1, 3, 6])):
                    words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    docs = spark.createDataFrame(list(enumerate(texts)), NAMES)
    root, got = brute(texts), {r["doc_id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    groups = lambda of: {frozenset(i for i in range(len(texts)) if of[i] == c) for c in set(of)}
    assert groups([got[i] for i in range(len(texts))]) == groups(root) and len(set(root)) > 4


def test_rows_with_null_or_equal_ids_stay(spark):
    """Unrelated texts without ids all stay; of two texts with one id, only the one that copies a smaller id goes."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (2, text("c")), (5, text("c")), (5, text("d")), (5, text("e")), (6, text("a")), (None, text("d"))]
    got = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, spark.createDataFrame(rows, NAMES), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, text("c")), (5, text("d")), (5, text("e")), (6, text("a")), (None, text("b"))], key=str)


def test_similar_pairs_of_the_tables_meet(spark):
    """Of all pairs of texts of sf0.01 with a similarity of 0.8 or more, nine tenths or more are joined, and no others."""
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    root, got = brute([t or "" for _, t in rows]), {r["doc_id"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(rows, NAMES)).collect()}
    want = {}
    for (i, _), g in zip(rows, root):
        want.setdefault(g, []).append(i)
    by = {}
    for i, c in got.items():
        by.setdefault(c, []).append(i)
    place = {i: g for g, ids in want.items() for i in ids}
    assert all(len({place[i] for i in ids}) == 1 for ids in by.values())
    linked = [(a, b) for ids in want.values() for a, b in zip(ids, ids[1:])]
    assert len(linked) > 20 and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)


def test_large_families_at_one_anchor(spark, monkeypatch):
    """No pairs are sent out, so that the hubs, the closest ones and the tiles of two sets do the work."""
    monkeypatch.setattr(near_copies, "LINEAR", 0)
    monkeypatch.setattr(near_copies, "TILE", 5)
    rng = random.Random(9)
    base = [f"b{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in range(k, k + 2 + k % 3):
            words[at * 5 % 300] = f"x{k}.{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"z{rng.randrange(5000)}" for _ in range(300)), None, "", None]
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), NAMES)).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[60] != got[0] and got[61] == got[62] == got[63]
    assert near_copies.near_copies(spark.createDataFrame([], NAMES)).count() == 0


def changed(rng, kind, words, fresh):
    n = len(words)
    if kind == "appended":
        return words + fresh(int(n * rng.uniform(0.17, 0.25)))
    if kind == "replaced":
        m = int(n * rng.uniform(0.08, 0.12))
        at = rng.randrange(n - m)
        return words[:at] + fresh(m) + words[at + m :]
    out = list(words)
    for _ in range(max(1, int(n * rng.uniform(0.015, 0.026)))):
        out[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
    return out


def test_recall_of_three_kinds_of_changes(spark):
    """Pairs of similarity 0.80 to 0.84: at least nine tenths of each kind are linked, and no two pairs are."""
    rng = random.Random(21)
    weights = [1 / (i + 2) for i in range(3000)]
    fresh = lambda n: rng.choices([f"w{i}" for i in range(3000)], weights, k=n)
    texts, kinds = [], ("appended", "replaced", "scattered")
    for kind in kinds:
        for n in (150, 400):
            made = 0
            while made < 50:
                a = fresh(n)
                b = changed(rng, kind, a, fresh)
                x, y = grams(" ".join(a)), grams(" ".join(b))
                if 0.8 <= len(x & y) / len(x | y) <= 0.84:
                    texts += [" ".join(a), " ".join(b)]
                    made += 1
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), NAMES)).collect()}
    for k in range(3):
        assert sum(got[i] == got[i + 1] for i in range(200 * k, 200 * k + 200, 2)) >= 90
    assert len(set(got.values())) >= 300


def test_anchors_beyond_a_tile(spark, monkeypatch):
    """An anchor of more members than a tile isn't compared pair by pair, and loses no link."""
    monkeypatch.setattr(near_copies, "TILE", 20)
    monkeypatch.setattr(near_copies, "HUBS", 4)
    rng = random.Random(2)
    texts = []
    for _ in range(3):
        words = [f"v{rng.randrange(900)}" for _ in range(150)]
        for _ in range(60):
            texts.append(" ".join(words))
            if rng.random() < 0.5:
                words = list(words)
                for _ in range(rng.choice([1, 3, 6])):
                    words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    root, got = brute(texts), {r["doc_id"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), NAMES)).collect()}
    groups = lambda of: {frozenset(i for i in range(len(texts)) if of[i] == c) for c in set(of)}
    assert groups([got[i] for i in range(len(texts))]) == groups(root)


def test_pairs_checked_grow_with_members(spark, monkeypatch):
    """A family of near copies, whose members meet at many anchors under many hubs, sends out few pairs a member and is one group all the same."""
    rng, texts = random.Random(9), []
    base = [f"u{rng.randrange(10**6)}" for _ in range(120)]
    for _ in range(400):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    made, checked = [], near_copies.checked
    monkeypatch.setattr(near_copies, "checked", lambda pairs, *more: made.append(pairs.count()) or checked(pairs, *more))
    got = [r["component"] for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), NAMES)).collect()]
    assert len(got) == 400 and len(set(got)) == 1
    assert sum(made) <= 8 * 400
