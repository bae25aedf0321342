"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, unused

ship(__name__)

#: N-grams of a profile, the longest ones, and about how many documents of each language a profile is learnt from.
TOP, ORDER, SAMPLE = 300, 3, 2000
#: Anything but \w, digits and underscore is no letter (Unicode's L*), nor are the numbers of categories Nl and No.
NOT_LETTERS = re.compile(r"[\W\d_]+")
NUMBERS = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]


def counted(letters: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of words that stand between single blanks; a code holds three characters of 21 bits."""
    if not letters:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, code = [], np.zeros(len(c), np.uint64)
    for n in range(1, order + 1):
        code = (code[:-1] if n > 1 else code) << np.uint64(21) | c[n - 1 :]
        parts.append(code)
    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
    own = codes != np.uint64(32)
    return codes[own], counts[own]


def gram_counts(text: str | None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams, 1 to order <= 3, of the letters of a whole text.

    Letters are lower-cased, and anything else is a blank at word ends.
    """
    letters = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    codes, counts = counted(letters, order)
    single = codes[: np.searchsorted(codes, np.uint64(2**21))]
    if len(odd := single[np.isin(single, np.array(NUMBERS, np.uint64))]):  # few texts hold such numbers
        letters = NOT_LETTERS.sub(" ", letters.translate(dict.fromkeys(odd.tolist(), " "))).strip()
        codes, counts = counted(letters, order)
    return codes, counts


def ranking(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The codes of the most frequent n-grams, in order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """For every n-gram of any profile, its place in each language's; top where it has none."""

    def __init__(self, ranked: dict[str, np.ndarray], top: int = TOP):
        self.languages = sorted(ranked)
        self.top = top
        self.codes = np.unique(np.concatenate([*ranked.values(), np.zeros(0, np.uint64)]).astype(np.uint64))
        self.place = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.place[np.searchsorted(self.codes, ranked[name]), k] = np.arange(len(ranked[name]))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance and how far below the worst possible that is, 0 to 1."""
        own = ranking(*gram_counts(text), self.top)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == own, at, len(self.codes))
        place = self.place[at]
        far = np.where(place < 0, self.top, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.languages[best], float(1 - far[best] / (self.top * len(own)))


def learnt(df: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles from about sample documents of each language, chosen by the hash of their key; whole texts.

    Rows without language are left out; null and wordless texts add nothing. Repeated rows are drawn together,
    and rows with null keys too. Tasks count n-grams, Spark adds them up and keeps the first TOP; ties go to the
    lower code. An empty table gives no profiles.
    """
    rows = df.select(F.col(f"`{language}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(2**20)).alias("draw")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(2**20 * min(1.0, sample / n)))) for k, n in sizes.items()], F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for at in range(0, len(texts), 256):
                    got = [gram_counts(t) for t in texts[at : at + 256]]
                    codes, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                    sums = np.bincount(inverse, np.concatenate([g[1] for g in got]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    sums = rows.where(F.col("draw") < share).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tops: dict[str, list] = {k: [] for k in sizes}
    if sizes:
        from pyspark.sql import Window

        w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        for r in sums.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP).orderBy("lang", "r").collect():
            tops[r["lang"]].append(r["gram"])
    return Profiles({k: np.array(v, np.uint64) for k, v in tops.items() if v})


def identified(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df without the text column, with lang_pred and score, from the text alone.

    Null texts and texts without a letter (Unicode's L*) are und with score 0, as are all without profiles. Texts of
    any length are read whole, in memory for their n-grams in proportion to them. Equal distances go to the first
    language by name. Repeated rows repeat; an empty table gives an empty result; columns called lang_pred or
    score are replaced.
    """
    keep = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused(df, "_text")))
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.classify(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
