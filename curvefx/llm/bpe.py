"""Byte-level BPE by corpus-level merge replay.

Tasks cut the texts into words, block by block of BLOCK_BYTES of text: a block has its own numbering of words, and a text
becomes a row of numbers. The distinct words of all blocks are dealt by hash to buckets, and a bucket lays its distinct
words out as one linked list of tokens with an inverted index from a pair's rank to the positions of that pair. Ranks are
replayed in order over all of them at once; a merge touches only its neighbours, whose new pairs enter the index. At
last every block gets the tokens of its own words back, which its size bounds, and puts its texts together. So each
word of the corpus is merged once, and no word's occurrences are shuffled, only one entry for each block it is in.

Numbers, words and tokens travel packed, in two exchanges: texts by block and words by bucket in the first, tokens by block
in the second.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

BLOCK_BYTES = 12_000_000
#: Bytes of distinct words that are replayed at once.
REPLAY_BYTES = 8_000_000
#: Bytes of packed-out words of a bucket that are held at a time; a larger bucket is replayed in slices, a word once in each.
BUCKET_BYTES = 64_000_000
NONE = np.int32(2**31 - 1)
#: White_Space of Unicode, which the pattern's \s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Columns of a block's tokens from one bucket.
NAMES, KINDS = ["name", "nos", "n", "sizes", "ids", "n_ids"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 token and rank."""
    return {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if len(x) == 2}


def splitter(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Merges:
    """Sorted pair keys (left id << 32 | right id) with the rank of the merged token, and each token's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for s in range(1, len(token)):
                a, b = ranks.get(token[:s]), ranks.get(token[s:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        #: Tokens that take part in a pair of a lower rank than their own, so that a merge may put an earlier one before its like.
        self.late = {t for k, rank in pairs.items() for t in (k >> 32, k & 0xFFFFFFFF) if rank < t}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {r: t for t, r in ranks.items()}
        self.by_bytes = ranks

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for pairs that don't merge and where right is below 0."""
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word by repeated merging of its lowest-ranked, leftmost pair: a heap of pairs over a linked list."""
        n, by_bytes = len(word), self.by_bytes
        parts = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [by_bytes.get(word[i : i + 2], -1) for i in range(n - 1)] + [-1] * (n > 0)
        heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:  # the pair is gone
                continue
            j = after[i]
            k = after[j]
            parts[i] += parts[j]
            parts[j], rank[j], after[i] = b"", -1, k
            if k < n:
                before[k] = i
            for x, y in ((i, k), (before[i], i)):
                if x >= 0 and y < n:
                    rank[x] = by_bytes.get(parts[x] + parts[y], -1)
                    if rank[x] >= 0:
                        heapq.heappush(heap, (rank[x], x))
                elif x >= 0:
                    rank[x] = -1
        return [by_bytes[p] for p in parts if p]


def first_of_runs(pos: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which merges apply when neighbouring ones overlap: from the left, each second one of a run."""
    keep, taken = [], -1
    for p, q in zip(pos.tolist(), right.tolist()):
        keep.append(p != taken)
        taken = q if p != taken else -1
    return np.array(keep)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and the start of each word in them."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lens.sum())
    ends = np.cumsum(lens)
    token = np.append(merges.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n
    before[(ends - lens)] = n
    rank = np.append(merges.pair_ranks(token[:n], token[after[:n]]), NONE)
    live = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    odd: list[np.ndarray] = []

    def enter(pos: np.ndarray) -> None:
        r = rank[pos]
        pos, r = pos[r < NONE], r[r < NONE]
        o = np.argsort(r, kind="stable")
        pos, r = pos[o], r[o]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, part in zip(r[np.r_[0, cuts]].tolist() if len(r) else (), np.split(pos, cuts)):
            if k not in index:
                index[k] = []
                heapq.heappush(queue, k)
            index[k].append(part)

    enter(np.arange(n, dtype=np.int32))
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        pos = pos[rank[pos] == r]
        if not len(pos):
            continue
        right = after[pos]
        if len(pos) > 1 and (right[:-1] == pos[1:]).any():
            keep = first_of_runs(pos, right)
            pos, right = pos[keep], right[keep]
        follow = after[right]
        token[pos] = r
        rank[right] = NONE
        live[right] = False
        after[pos] = follow
        before[follow] = pos
        prior = before[pos]
        touched = np.unique(np.concatenate([pos, prior[prior < n]]))
        rank[touched] = merges.pair_ranks(token[touched], token[after[touched]])
        if len(pos) > 1 and r in merges.late:
            # a word with several such merges may need another one between them: it is done alone
            word = np.searchsorted(ends, pos, side="right")
            odd.append(pos[1:][word[1:] == word[:-1]])
        enter(touched)
    ids = token[:n][live]
    starts = np.r_[0, np.cumsum(live)][np.r_[0, ends]]
    if odd:
        word_of = np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist()
        pieces = np.split(ids, starts[1:-1])
        for w in word_of:
            pieces[w] = np.array(merges.alone(words[w]), np.int32)
        ids, starts = np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
    return ids, starts


def packed(codes: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their low bytes first, then the next ones."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(codes) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def cut(texts: list[str | None], split: regex.Pattern) -> tuple[list[bytes], list[int], list[bytes]]:
    """Of a block's texts: the packed numbers and the number of their words; and the words in the order of their numbers."""
    number: dict[str, int] = {}
    codes, sizes = [], []
    for t in texts:
        row = np.fromiter((number.setdefault(w, len(number)) for w in split.findall(t or "")), np.int64)
        codes.append(packed(row))
        sizes.append(len(row))
    return codes, sizes, [w.encode() for w in number]


def packed_words(words: list[bytes]) -> bytes:
    """Lengths and bytes of words, compressed."""
    raw = np.fromiter(map(len, words), "<u4", len(words)).tobytes() + b"".join(words)
    return len(words).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked_words(raw: bytes) -> list[bytes]:
    n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    raw = pa.Codec("zstd").decompress(raw[8:], size, asbytes=True)
    ends = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"), dtype=np.int64) + 4 * n
    return [raw[i:j] for i, j in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def unpacked_size(raw: bytes) -> int:
    return int.from_bytes(raw[4:8], "little")


def dealt(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has words, and the numbers of its words."""
    which = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(which, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(words) else ():
        yield int(which[part[0]]), part


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Tables of about BLOCK_BYTES, a single longer text alone."""
    held, size = [], 0
    for b in itertools.chain(batches, [None]):
        for at in range(0, b.num_rows, 256) if b is not None else [None]:
            part = b.slice(at, 256) if b is not None else None
            if held and (part is None or size + part.nbytes > BLOCK_BYTES):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            if part is not None and part.num_rows:
                held.append(part)
                size += part.nbytes


def replayed(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words and the start of each word, REPLAY_BYTES of words at a time."""
    ids, sizes, at, size = [], [], 0, 0
    for i, w in enumerate([*words, None]):
        if i > at and (w is None or size + len(w) > REPLAY_BYTES):
            got, starts = replay(words[at:i], merges)
            ids.append(got)
            sizes.append(np.diff(starts))
            at, size = i, 0
        size += len(w or b"")
    return (np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))]) if ids else (np.zeros(0, np.int32), np.zeros(1, np.int64))


def bucket_tokens(rows: list[tuple[int, bytes, bytes, int]], merges: Merges) -> Iterator[tuple[int, bytes, int, bytes, bytes, int]]:
    """For a bucket's rows (block, packed words, packed numbers, how many): block, packed numbers, how many, packed numbers of tokens, packed tokens, how many."""
    known: dict[bytes, int] = {}
    which = [np.fromiter((known.setdefault(w, len(known)) for w in unpacked_words(words)), np.int64, n) for _, words, _, n in rows]
    ids, starts = replayed(list(known), merges)
    size = np.diff(starts)
    for (block, _, nos, count), own in zip(rows, which):
        n = size[own]
        ends = np.cumsum(n)
        tokens = ids[np.repeat(starts[own] - (ends - n), n) + np.arange(int(ends[-1]))]
        yield block, nos, count, packed(n), packed(tokens), len(tokens)


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """df without the text column, with the chosen OUTPUTS: token ids, their number, and SHA-256 digests.

    path names a file of ranks on the driver, whose size is that of the vocabulary; pattern splits texts, and no
    special tokens are used. Ids are hashed as little-endian unsigned 32-bit integers; decoding joins the tokens'
    bytes. A null text counts as empty: no ids. Texts and words of any length are encoded whole; a word of n bytes takes
    time in the order of n log n. One result row for each row of df, repeated rows too; an empty table gives an empty
    result. Columns of df that are called like an output are replaced.
    """
    with open(path, "rb") as f:
        # as plain values: workers need no copy of the package to read a broadcast
        shared = df.sparkSession.sparkContext.broadcast(vars(Merges(read_ranks(f))))
    keep = [c for c in df.columns if c != text and c not in outputs]
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    # the kept columns travel by position, so that no name can clash
    held = [f"c{i}" for i in range(len(keep))]
    src = own.toDF(*held, "_text")
    fields = [T.StructField(h, src.schema[h].dataType) for h in held]
    spelled = splitter(pattern)
    buckets = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = T.StructType.fromDDL("_key long, _size long, _codes binary, _words binary, _block long").fields

    def vocabulary() -> Merges:
        m = Merges.__new__(Merges)
        m.__dict__ = shared.value
        return m

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts (by the odd name of their block, which its words give it), then the words (by an even bucket)."""
        split = regex.compile(spelled)
        for whole in blocks(batches, len(held)):
            codes, sizes, words = cut(whole.column(len(held)).to_pylist(), split)
            n, digest = whole.num_rows, xxhash.xxh64()
            for w in words:
                digest.update(w + b"\0")
            digest.update(np.array(sizes).tobytes())
            name = (digest.intdigest() - 2**63) | 1
            parts = list(dealt(words, buckets))
            m = len(parts)
            kept = [pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, pa.nulls(m, c.type)]) for c in whole.columns[:-1]]
            columns = [
                pa.array([name] * n + [2 * k for k, _ in parts], pa.int64()), pa.array(sizes + [len(p) for _, p in parts], pa.int64()),
                pa.array(codes + [packed(p) for _, p in parts], pa.binary()), pa.array([None] * n + [packed_words([words[i] for i in p.tolist()]) for _, p in parts], pa.binary()), pa.array([name] * (n + m), pa.int64()),
            ]
            yield from pa.Table.from_arrays([*kept, *columns], names=[*held, *[f.name for f in inner]]).to_batches(max_chunksize=4096)

    def replay_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, size, m = None, [], 0, vocabulary()
        for b in itertools.chain(batches, [None]):
            part = b.filter(b.column("_words").is_valid()).select(["_key", "_block", "_words", "_codes", "_size"]).to_pylist() if b is not None else [None]
            for x in part:
                if rows and (x is None or x["_key"] != at or size > BUCKET_BYTES):
                    for out in itertools.batched(bucket_tokens(rows, m), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], NAMES)
                    rows, size = [], 0
                if x is not None:
                    at = x["_key"]
                    size += unpacked_size(x["_words"])
                    rows.append((x["_block"], x["_words"], x["_codes"], x["_size"]))

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pa.compute.is_null(left.column("_words")))
        m = vocabulary()
        parts = [(unpacked(x["nos"], x["n"]), unpacked(x["sizes"], x["n"]), unpacked(x["ids"], x["n_ids"])) for x in right.to_pylist()]
        no, sizes, ids = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*parts) if parts else ((), (), ())))
        size, starts = np.zeros((2, len(no)), np.int64)
        size[no] = sizes
        starts[no] = np.cumsum(sizes) - sizes
        cols: dict[str, list] = {c: [] for c in outputs}
        for raw, n_words in zip(left.column("_codes").to_pylist(), left.column("_size").to_pylist()):
            row = unpacked(raw, n_words)
            n = size[row]  # a number without tokens, as after a source that gave other rows when read again, is an error here
            ends = np.cumsum(n)
            total = int(ends[-1]) if n_words else 0
            got = ids[np.repeat(starts[row] - (ends - n), n) + np.arange(total)]
            for c in outputs:
                if c == "ids":
                    cols[c].append(got)
                elif c == "n_tokens":
                    cols[c].append(total)
                elif c == "ids_sha256":
                    cols[c].append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                else:
                    cols[c].append(hashlib.sha256(b"".join(map(m.tokens.__getitem__, got.tolist()))).hexdigest())
        kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        return pa.Table.from_arrays([*[left.column(h) for h in held], *[pa.array(cols[c], kinds.get(c, pa.string())) for c in outputs]], names=[*held, *outputs])

    added = T.StructType.fromDDL(", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)).fields
    # one exchange of texts and words, which both sides read
    first = src.mapInArrow(number, T.StructType([*fields, *inner])).repartition("_key")
    back = first.sortWithinPartitions("_key").mapInArrow(replay_buckets, "name long, nos binary, n long, sizes binary, ids binary, n_ids long")
    out = first.groupBy("_key").cogroup(back.groupBy("name")).applyInArrow(put, T.StructType([*fields, *added]))
    return out.toDF(*keep, *outputs)


def decoded(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(tokens[i] for i in ids)
